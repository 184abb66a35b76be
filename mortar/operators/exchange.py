"""Ghost exchange: transfers joined with taps and points, summed by target.

Order of the stages: all transfers that read owned points only (copies, restrictions, and prolongations whose window stays
inside the block), outer ghosts, then the others by ascending level of the target, each reading what is filled so far.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping
from dataclasses import dataclass
from itertools import product

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mortar.functions.lineage import cut
from mortar.operators.bounded import bounded_sum
from mortar.operators.fields import index_names, within
from mortar.operators.geometry import positions
from mortar.plans import transfers as plans
from mortar.plans import weights
from mortar.plans.spec import Layout, MeshSpec, Operators, directions


def apply(transfers: DataFrame, taps: DataFrame, points: DataFrame, dims: int, variables: tuple[str, ...]) -> DataFrame:
    """Target points as weighted sums of source points, bounded where the taps say so: one join by group, one by
    source point, one aggregate."""
    names = index_names(dims)
    wanted = transfers.join(taps, "grp")
    read = points.select(F.col("leaf").alias("src"), *[F.col(n).alias(f"s{d + 1}") for d, n in enumerate(names)], *variables)
    terms = wanted.join(read, ["src", *[f"s{d + 1}" for d in range(dims)]])
    sums = terms.groupBy("tgt", *[f"t{d + 1}" for d in range(dims)]).agg(*[(bounded_sum(v, dims) if "mode" in taps.columns else F.sum(F.col("w") * F.col(v))).alias(v) for v in variables])
    return sums.select(F.col("tgt").alias("leaf"), *[F.col(f"t{d + 1}").alias(n) for d, n in enumerate(names)], *variables)


@dataclass(frozen=True)
class Directed:
    """A boundary value by position and direction: ``f(x1, .., d1, ..)``."""

    f: Callable[..., Column]


@dataclass(frozen=True)
class Relative:
    """A boundary value relative to the nearest evolved point r: u(x) = f(x) + u(r) - f(r)."""

    f: Callable[..., Column]


def beyond(mesh: MeshSpec, layout: Layout, d: int, step: int) -> range:
    """The rows of a region beyond an outer face; a symmetric low wall's plane is one of them."""
    rows = weights.targets(mesh.cells, layout.ghosts[d], layout.stagger[d], step)
    return range(rows.start, rows.stop + 1) if step < 0 and layout.walls == "symmetric" and layout.stagger[d] else rows


def region_points(regions: DataFrame, mesh: MeshSpec, layout: Layout) -> DataFrame:
    """``(leaf, d1 .., i1 ..)`` for every ghost of the regions."""
    spark, names = regions.sparkSession, index_names(mesh.dims)
    rows = []
    for step in directions(mesh.dims):
        ranges = [weights.targets(mesh.cells, g, c, s) for g, c, s in zip(layout.ghosts, layout.stagger, step, strict=True)]
        index = [()]
        for r in ranges:
            index = [(*i, j) for i in index for j in r]
        rows += [(*step, *i) for i in index]
    ds = [f"d{d + 1}" for d in range(mesh.dims)]
    shape = spark.createDataFrame(rows, ", ".join(f"{x} int" for x in [*ds, *names]))
    return regions.join(shape, ds)


def wall_rows(mesh: MeshSpec, layout: Layout, ops: Operators, d: int) -> list[tuple]:
    """``(d, out, i, s, w, mirrored, derived)``: what the rows of a dimension read inside the block, for rows beyond a wall and others.

    A reflecting wall mirrors, and derives a vertex plane from the rows beside it; an outflow wall takes the nearest evolved row."""
    g, n, c, out = layout.ghosts[d], mesh.cells, layout.stagger[d], []
    for step in (-1, 0, 1):
        for i in weights.targets(n, g, c, step):
            out.append((step, False, i, i, 1.0, False, False))
    symmetric = layout.walls == "symmetric" and c
    for side, step in ((0, -1), (1, 1)):
        for i in beyond(mesh, layout, d, step):
            plane = c and i == (g + n + 1 if side else g + 1)
            if (d, side) in mesh.reflecting and plane:
                # bounded, the value stays between the rows on either side of the wall, which are one by symmetry
                order = 2 if ops.bounded else ops.order_along(1)
                out += [(step, True, i, s, float(w), False, True) for s, w in weights.wall_plane(n, g, order, side)]
            elif (d, side) in mesh.reflecting:
                out.append((step, True, i, (2 * (g + n) if side else 2 * g) + 1 + c - i, 1.0, True, False))
            elif (d, side) in mesh.outflow:
                out.append((step, True, i, g + n if side else g + 1 + int(symmetric), 1.0, False, False))
    return out


def walls(regions: DataFrame, points: DataFrame, mesh: MeshSpec, layout: Layout, ops: Operators) -> DataFrame:
    """Ghosts beyond reflecting faces (mirrored, times the variable's parity; a vertex plane derived, times (1 + parity) / 2)
    and outflow faces (clamped), from stored points of the same block.  Regions that also leave through an outer face are left out."""
    spark, names = regions.sparkSession, index_names(mesh.dims)
    wanted, factor, fits = regions, {v: F.lit(1.0) for v in layout.variables}, F.lit(False)
    for d, name in enumerate(names):
        k = d + 1
        table = spark.createDataFrame(wall_rows(mesh, layout, ops, d), f"d{k} int, _out{k} boolean, {name} int, _s{k} int, _w{k} double, _m{k} boolean, _p{k} boolean")
        wanted, fits = wanted.join(F.broadcast(table), [f"d{k}", f"_out{k}"]), fits | F.col(f"_out{k}")  # as many rows as a block is wide
        for v in layout.variables:
            sigma = float(layout.parity.get(v, {}).get(d, 1))
            factor[v] = factor[v] * F.when(F.col(f"_m{k}"), sigma).when(F.col(f"_p{k}"), (1 + sigma) / 2).otherwise(1.0)
    weight = F.col("_w1")
    for d in range(1, mesh.dims):
        weight = weight * F.col(f"_w{d + 1}")
    source = [f"_s{d + 1}" for d in range(mesh.dims)]
    read = points.select("leaf", *[F.col(n).alias(x) for n, x in zip(names, source, strict=True)], *layout.variables)
    parts = wanted.where(fits).select("leaf", *names, *source, weight.alias("_w"), *[f.alias(f"_f_{v}") for v, f in factor.items()])
    ready = parts.join(read, ["leaf", *source], "left").groupBy("leaf", *names)
    sums = [F.sum(F.col("_w") * F.col(f"_f_{v}") * F.col(v)).alias(v) for v in layout.variables]
    missing = F.max(F.col(layout.variables[0]).isNull() & (F.col("_w") != 0))  # a source that is filled later
    return ready.agg(*sums, missing.alias("_missing")).where(~F.col("_missing")).select("leaf", *names, *layout.variables)


def wall_planes(points: DataFrame, leaves: DataFrame, mesh: MeshSpec, layout: Layout, ops: Operators, boundary: Mapping) -> DataFrame:
    """``points`` with the owned low wall planes of a set with symmetric walls written by their faces' rule."""
    names, n = index_names(mesh.dims), mesh.dims
    low = [(d, g) for d, (g, c) in enumerate(zip(layout.ghosts, layout.stagger, strict=True)) if c and not mesh.periodic[d]]
    if layout.walls != "symmetric" or not low:
        return points
    steps = [s for s in product((-1, 0), repeat=n) if any(s) and all(not x or d in dict(low) for d, x in enumerate(s))]
    every = F.array(*[F.struct(*[F.lit(x).alias(f"d{d + 1}") for d, x in enumerate(s)]) for s in steps])
    at = leaving(leaves.select("leaf", "level", F.explode(every).alias("_d")).select("leaf", "level", "_d.*"), leaves, mesh, "level")
    on = F.lit(False)
    for d, g in low:
        on = on | (F.col(f"_low{d + 1}") & (F.col(names[d]) == g + 1))
    flags = leaves.select("leaf").join(at.groupBy("leaf").agg(*[F.max(F.col(f"_out{d + 1}")).alias(f"_low{d + 1}") for d, _ in low]), "leaf")
    marked = points.join(flags, "leaf").withColumn("_on", on)
    inner = marked.where(~F.col("_on")).select(points.columns)
    whole = F.lit(True)  # every stepped dimension leaves through a face with a rule
    ruled = F.lit(True)
    for d in range(n):
        whole = whole & ((F.col(f"d{d + 1}") == 0) | F.col(f"_out{d + 1}"))
        if (d, 0) not in mesh.reflecting | mesh.outflow:
            ruled = ruled & (F.col(f"d{d + 1}") == 0)
    made = walls(at.where(whole & ruled), inner, mesh, layout, ops).where(within(layout.owned(mesh.cells)))
    made = made.join(marked.where("_on").select("leaf", *names), ["leaf", *names], "left_semi")
    rest = marked.where("_on").join(made.select("leaf", *names), ["leaf", *names], "left_anti").select(points.columns)
    if boundary and any((d, 0) not in mesh.reflecting | mesh.outflow for d, _ in low):
        rest = hooked(rest.select("leaf", *names, *[F.lit(-1 if d in dict(low) else 0).alias(f"d{d + 1}") for d in range(n)]), inner, leaves, mesh, layout, boundary)
    return inner.unionByName(made).unionByName(rest)


def hooked(where: DataFrame, points: DataFrame, leaves: DataFrame, mesh: MeshSpec, layout: Layout, boundary: Mapping) -> DataFrame:
    """Outer ghosts ``(leaf, i1 .., d1 ..)`` by the hooks: a function of position, of position and direction, or a relative one."""
    names, ds, n = index_names(mesh.dims), [f"d{d + 1}" for d in range(mesh.dims)], mesh.dims
    placed = positions(where, leaves, mesh, layout)
    xs = [F.col(f"x{d + 1}") for d in range(n)]
    if any(isinstance(f, Relative) for f in boundary.values()):
        for d, name in enumerate(names):
            g = layout.ghosts[d]
            first = g + 1 + int(layout.walls == "symmetric" and layout.stagger[d])
            placed = placed.withColumn(f"_r{d + 1}", F.least(F.greatest(F.col(name), F.lit(first)), F.lit(g + mesh.cells)))
        own = positions(points, leaves, mesh, layout)
        near = [f"_r{d + 1}" for d in range(n)]
        read = own.select("leaf", *[F.col(x).alias(r) for x, r in zip(names, near, strict=True)], *[F.col(f"x{d + 1}").alias(f"_x{d + 1}") for d in range(n)], *[F.col(v).alias(f"_u_{v}") for v in layout.variables])
        placed = placed.join(read, ["leaf", *near])
    there = [F.col(f"_x{d + 1}") for d in range(n)]

    def value(v: str) -> Column:
        f = boundary[v]
        if isinstance(f, Relative):
            return f.f(*xs) + (F.col(f"_u_{v}") - f.f(*there))
        return f.f(*xs, *map(F.col, ds)) if isinstance(f, Directed) else f(*xs)

    return placed.select("leaf", *names, *[value(v).cast("double").alias(v) for v in layout.variables])


def by_region(where: DataFrame, leaves: DataFrame, mesh: MeshSpec, layout: Layout, hook: Callable) -> DataFrame:
    """Outer ghosts by a pandas function that sees one region of one block at a time: leaf, d1 .., i1 .., x1 .."""
    names, ds = index_names(mesh.dims), [f"d{d + 1}" for d in range(mesh.dims)]
    placed = positions(where, leaves, mesh, layout).select("leaf", *ds, *names, *[f"x{d + 1}" for d in range(mesh.dims)])
    schema = ", ".join(["leaf long", *[f"{x} int" for x in names], *[f"{v} double" for v in layout.variables]])
    columns = ["leaf", *names, *layout.variables]
    return placed.groupBy("leaf", *ds).applyInPandas(lambda region: hook(region)[columns], schema)


def leaving(regions: DataFrame, leaves: DataFrame, mesh: MeshSpec, *known: str) -> DataFrame:
    """Adds level and ``_out1 ..``: whether the region leaves the brick along a dimension."""
    out, stride = regions.drop(*known).join(leaves.select("leaf", "root", "level", *[f"c{d + 1}" for d in range(mesh.dims)]), "leaf"), 1
    for d in range(mesh.dims):
        place = F.floor(F.col("root") / stride) % mesh.roots[d]
        top = (F.lit(mesh.roots[d]) * F.pow(F.lit(2.0), F.col("level"))).cast("long") - 1
        at = (place * F.pow(F.lit(2.0), F.col("level"))).cast("long") + F.col(f"c{d + 1}")
        low, high = (F.col(f"d{d + 1}") == -1) & (at == 0), (F.col(f"d{d + 1}") == 1) & (at == top)
        out = out.withColumn(f"_out{d + 1}", (low | high) & F.lit(not mesh.periodic[d]))
        stride *= mesh.roots[d]
    return out.drop("root", *[f"c{d + 1}" for d in range(mesh.dims)])


@dataclass(frozen=True)
class GhostPlan:
    """What a fill needs besides the points; it is of one mesh and generation, one layout and one operator family."""

    mesh: MeshSpec
    layout: Layout
    ops: Operators
    late: list[str]
    taps: DataFrame
    transfers: DataFrame
    regions: DataFrame | None


def plan_ghosts(leaves: DataFrame, mesh: MeshSpec, layout: Layout, ops: Operators) -> GhostPlan:
    """The plan of a fill, to be made once for many fills over the same leaves."""
    mesh.without_seam()
    rows = plans.tap_rows(mesh, layout, ops)
    late, taps = plans.waiting(rows, mesh, layout), plans.taps(leaves.sparkSession, mesh, layout, ops, rows=rows)
    each = plans.ghost_transfers(leaves, mesh)
    if late:
        each = cut(each.withColumn("stage", F.when(F.col("grp").isin(late), F.col("stage")).otherwise(0)))
    else:
        each = each.withColumn("stage", F.lit(0))
    regions = None
    if not all(mesh.periodic) and layout.centering[0] != "element":
        regions = cut(leaving(plans.outer_regions(leaves, mesh), leaves, mesh))
    return GhostPlan(mesh, layout, ops, late, taps, each, regions)


def fill_ghosts(
    points: DataFrame, leaves: DataFrame, mesh: MeshSpec, layout: Layout, ops: Operators, boundary: Mapping | None = None, region_hook: Callable | None = None, made: GhostPlan | None = None,
) -> DataFrame:
    """Owned points with all ghosts that have a source, a wall, or a hook beyond an outer face.

    ``boundary`` has a function of position by variable, or ``Directed`` or ``Relative`` ones; ``region_hook`` is a pandas function of
    one block's region.  Transfers that read owned points alone are one stage; those that read ghosts follow by level.
    ``made`` is a plan of these leaves, if there is one."""
    made = made or plan_ghosts(leaves, mesh, layout, ops)
    if (made.mesh, made.layout, made.ops) != (mesh, layout, ops):
        raise ValueError("the plan is of another mesh, generation, layout or operators")
    dims, names = mesh.dims, index_names(mesh.dims)
    columns = ["leaf", *names, *layout.variables]
    late, taps, plan, regions = made.late, made.taps, made.transfers, made.regions
    held = wall_planes(points.select(*columns), leaves, mesh, layout, ops, boundary or {})
    if layout.walls == "symmetric":
        held = cut(held)
    filled = held.unionByName(apply(plan.where("stage = 0"), taps, held, dims, layout.variables))
    if layout.centering[0] == "element":
        if boundary or region_hook or mesh.reflecting or mesh.outflow:
            raise ValueError("an element set's outer faces are the scheme's own")
        return filled
    if boundary or region_hook:
        free = F.lit(False)
        for d in range(dims):
            for side, sign in ((0, -1), (1, 1)):
                if not mesh.periodic[d] and (d, side) not in mesh.reflecting | mesh.outflow:
                    free = free | (F.col(f"_out{d + 1}") & (F.col(f"d{d + 1}") == sign))
        ds = [f"d{d + 1}" for d in range(dims)]
        where = region_points(regions.where(free).select("leaf", *ds), mesh, layout).select("leaf", *ds, *names)
        outer = by_region(where, leaves, mesh, layout, region_hook) if region_hook else hooked(where, held, leaves, mesh, layout, boundary)
        filled = filled.unionByName(outer)
    walled = bool(mesh.reflecting or mesh.outflow)
    if walled:
        got = walls(regions, filled, mesh, layout, ops)
        filled = cut(filled.unionByName(got.join(filled, ["leaf", *names], "left_anti")))
    levels = sorted(r["stage"] for r in plan.where("stage > 0").select("stage").distinct().collect()) if late else []
    for level in levels:
        more = apply(plan.where(F.col("stage") == level), taps, filled, dims, layout.variables)
        filled = cut(filled.unionByName(more))
        if walled:
            got = walls(regions.where(F.col("level") == level), filled, mesh, layout, ops)
            filled = cut(filled.unionByName(got.join(filled, ["leaf", *names], "left_anti")))
    return filled


def relative_boundary(points: DataFrame, leaves: DataFrame, mesh: MeshSpec, layout: Layout, values: Mapping[str, Callable[..., Column]]) -> DataFrame:
    """Outer ghosts by u(x) = f(x) + u(r) - f(r), r being the nearest owned point of the same block: (leaf, i1 .., variables)."""
    names, ds = index_names(mesh.dims), [f"d{d + 1}" for d in range(mesh.dims)]
    at = region_points(plans.outer_regions(leaves, mesh), mesh, layout).select("leaf", *ds, *names)
    ghost = positions(at, leaves, mesh, layout)
    near = []
    for d, name in enumerate(names):
        g = layout.ghosts[d]
        near.append(F.least(F.greatest(F.col(name), F.lit(g + 1)), F.lit(g + mesh.cells)).alias(f"_r{d + 1}"))
    own = positions(points, leaves, mesh, layout)
    read = own.select("leaf", *[F.col(n).alias(f"_r{d + 1}") for d, n in enumerate(names)], *[F.col(f"x{d + 1}").alias(f"_x{d + 1}") for d in range(mesh.dims)], *[F.col(v).alias(f"_{v}") for v in layout.variables])
    both = ghost.select("leaf", *names, *near, *[f"x{d + 1}" for d in range(mesh.dims)]).join(read, ["leaf", *[f"_r{d + 1}" for d in range(mesh.dims)]])
    here, there = ([F.col(f"{p}{d + 1}") for d in range(mesh.dims)] for p in ("x", "_x"))
    return both.select("leaf", *names, *[(values[v](*here) + F.col(f"_{v}") - values[v](*there)).alias(v) for v in layout.variables])
