"""Transfer plans: which leaf fills which ghosts of which leaf, and by which taps.

A transfer names its target, its source and a group: kind (copy, restrict, prolong), direction and
child offset.  Taps belong to groups, so their number does not depend on the mesh.
"""

from __future__ import annotations

from dataclasses import replace
from itertools import product

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from mortar.functions.keys import coords, node
from mortar.operators import leaves as tree
from mortar.plans import elements, weights
from mortar.plans.spec import Layout, MeshSpec, Operators, directions


def group_name(kind: str, step: tuple[int, ...], offset: tuple[int, ...]) -> str:
    return f"{kind}:{','.join(map(str, step))}:{','.join(map(str, offset))}"


def group_column(kind: Column, steps: list[Column], offsets: list[Column]) -> Column:
    return F.concat_ws(":", kind, F.concat_ws(",", *[s.cast("string") for s in steps]), F.concat_ws(",", *[o.cast("string") for o in offsets]))


def stencils(kind: str, step: tuple[int, ...], offset: tuple[int, ...], mesh: MeshSpec, layout: Layout, ops: Operators) -> list[weights.Stencil]:
    out = []
    if layout.centering[0] == "element":
        if sum(map(abs, step)) > 1:
            return [{}]  # only face ghosts of elements are filled
        return [elements.stencil(kind, mesh.cells, g, layout.order, s, o, not any(step)) for g, s, o in zip(layout.ghosts, step, offset, strict=True)]
    for d, s, o in zip(range(mesh.dims), step, offset, strict=True):
        shape = mesh.cells, layout.ghosts[d], layout.stagger[d]
        if kind == "copy":
            out.append(weights.copy(*shape, s))
        elif kind == "restrict":
            out.append(weights.restrict(*shape, s, o, ops.restriction))
        else:
            out.append(weights.prolong(*shape, s, o, ops.order_along(layout.stagger[d]), ops.family == "conservative"))
    return out


def bound_mode(kind: str, layout: Layout, ops: Operators) -> str | None:
    """How a group is bounded: by limited slopes, by its bracket, or not; only what can make a new extremum is."""
    if not ops.bounded:
        return None
    if ops.family == "conservative":
        return "slopes" if kind == "prolong" and ops.prolongation == 3 else None
    steep = (kind == "prolong" and ops.prolongation > 2) or (kind == "restrict" and ops.restriction > 2 and not all(layout.stagger))
    return "bracket" if steep else None


def bounds(mode: str, found: list[weights.Stencil], linear: list[weights.Stencil], t: tuple[int, ...], s: tuple[int, ...]) -> tuple[bool, int, list[int]]:
    """Of one tap: whether it is in the target's bracket; its role (0 the parent, 2 d + 1 and 2 d + 2 its
    neighbours below and above in dimension d, -1 others); and the target's side of the parent by dimension."""
    if mode == "bracket":
        return all(any(x == k and w for x, w in st[j]) for st, j, k in zip(linear, t, s, strict=True)), -1, [0] * len(t)
    rows = [st[j] for st, j in zip(found, t, strict=True)]
    off = [k - row[1][0] for row, k in zip(rows, s, strict=True)]
    out = [d for d, x in enumerate(off) if x]
    role = 0 if not out else 2 * out[0] + (1 if off[out[0]] < 0 else 2) if len(out) == 1 else -1
    return False, role, [1 if row[2][1] > row[0][1] else -1 for row in rows]


def tap_rows(mesh: MeshSpec, layout: Layout, ops: Operators, steps: list[tuple[int, ...]] | None = None) -> list[tuple]:
    """``(grp, t1 .., s1 .., w)``: every group's weights, zero weights left out; bounded operators add mode, near, role, g1 .."""
    ops.check(layout, mesh.cells)
    if ops.bounded and ops.family == "conservative" and any(layout.stagger):
        raise ValueError("bounded conservative prolongation takes cells in all dimensions")
    if layout.centering[0] == "element" and not all(layout.ghosts) and steps is None:
        raise ValueError("an element set without ghosts has none to fill")
    rows, zero = [], (0,) * mesh.dims
    plain = replace(ops, prolongation=2, restriction=2) if ops.family == "point" else ops
    for step in steps or directions(mesh.dims):
        for kind in ("copy", "restrict", "prolong"):
            for offset in [zero] if kind == "copy" else product((0, 1), repeat=mesh.dims):
                found = stencils(kind, step, offset, mesh, layout, ops)
                if all(found):
                    each = [(group_name(kind, step, offset), *t, *s, w) for t, s, w in weights.tensor(found)]
                    if ops.bounded:
                        mode, linear = bound_mode(kind, layout, ops), stencils(kind, step, offset, mesh, layout, plain)
                        d = mesh.dims
                        more = [bounds(mode, found, linear, r[1 : 1 + d], r[1 + d : 1 + 2 * d]) if mode else (False, -1, zero) for r in each]
                        each = [(*r, mode, near, role, *sides) for r, (near, role, sides) in zip(each, more, strict=True)]
                    rows += each
    return rows


def taps(spark: SparkSession, mesh: MeshSpec, layout: Layout, ops: Operators, steps: list[tuple[int, ...]] | None = None, rows: list[tuple] | None = None) -> DataFrame:
    """``tap_rows`` as a table."""
    names = [f"{x}{d + 1} int" for x in "ts" for d in range(mesh.dims)]
    extra = ", mode string, near boolean, role int, " + ", ".join(f"g{d + 1} int" for d in range(mesh.dims)) if ops.bounded else ""
    return spark.createDataFrame(tap_rows(mesh, layout, ops, steps) if rows is None else rows, f"grp string, {', '.join(names)}, w double{extra}")


def waiting(rows: list[tuple], mesh: MeshSpec, layout: Layout) -> list[str]:
    """Groups that read ghosts, so that they must wait for the stage that fills them; all others read owned points alone
    and go into one stage, whatever their level."""
    owned = layout.owned(mesh.cells)
    first = 1 + mesh.dims
    return sorted({r[0] for r in rows if any(x not in o for x, o in zip(r[first : first + mesh.dims], owned, strict=True))})


def ghost_transfers(leaves: DataFrame, mesh: MeshSpec) -> DataFrame:
    """``(tgt, src, grp, stage)``: stage 0 copies and restricts, stage l prolongs onto level l."""
    cs, ds = coords(mesh.dims), [f"d{d + 1}" for d in range(mesh.dims)]
    near = tree.neighbours(leaves, mesh)
    own = leaves.select("leaf", F.col("level").alias("_l"), *[(F.col(c) % 2).alias(f"_o_{c}") for c in cs])
    other = leaves.select(F.col("leaf").alias("neighbour"), *[(F.col(c) % 2).alias(f"_s_{c}") for c in cs])
    rows = near.join(own, "leaf").join(other, "neighbour")
    kind = F.when(F.col("n_level") == F.col("_l"), "copy").when(F.col("n_level") > F.col("_l"), "restrict").otherwise("prolong")
    offset = [F.when(kind == "copy", F.lit(0)).when(kind == "restrict", F.col(f"_s_{c}")).otherwise(F.col(f"_o_{c}")) for c in cs]
    stage = F.when(kind == "prolong", F.col("_l")).otherwise(0)
    return rows.select(F.col("leaf").alias("tgt"), F.col("neighbour").alias("src"), group_column(kind, [F.col(d) for d in ds], offset).alias("grp"), stage.alias("stage"))


def regrid_transfers(old: DataFrame, new: DataFrame, dims: int) -> DataFrame:
    """``(tgt, src, grp, stage)`` from old leaves to new ones: the same node, its parent, or its children."""
    cs = coords(dims)
    still = F.lit(0)
    zeros = [still] * dims
    named = new.select(*node(dims), F.col("leaf").alias("tgt"))
    before = old.select(*node(dims), F.col("leaf").alias("src"))
    same = named.join(before, node(dims)).select("tgt", "src", group_column(F.lit("copy"), zeros, zeros).alias("grp"))
    up = [F.shiftright(c, 1).alias(c) for c in cs]
    odd = [(F.col(c) % 2).alias(f"_o_{c}") for c in cs]
    offsets = [F.col(f"_o_{c}") for c in cs]
    finer = named.where("level > 0").select("tgt", "root", (F.col("level") - 1).alias("level"), *up, *odd).join(before, node(dims))
    coarser = before.where("level > 0").select("src", "root", (F.col("level") - 1).alias("level"), *up, *odd).join(named, node(dims))
    out = same.unionByName(finer.select("tgt", "src", group_column(F.lit("prolong"), zeros, offsets).alias("grp")))
    return out.unionByName(coarser.select("tgt", "src", group_column(F.lit("restrict"), zeros, offsets).alias("grp")))


def outer_regions(leaves: DataFrame, mesh: MeshSpec) -> DataFrame:
    """``(leaf, d1 ..)``: directions that leave the brick."""
    ds = [f"d{d + 1}" for d in range(mesh.dims)]
    every = F.array(*[F.struct(*[F.lit(x).alias(n) for n, x in zip(ds, s, strict=True)]) for s in directions(mesh.dims)])
    pairs = leaves.select("leaf", F.explode(every).alias("_d")).select("leaf", *[F.col(f"_d.{d}").alias(d) for d in ds])
    return pairs.join(tree.step(leaves, mesh, "leaf").select("leaf", *ds), ["leaf", *ds], "left_anti")
