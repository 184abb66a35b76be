"""Point location and interpolation.

A query point is folded into the brick, its finest-level cell computed, and the leaf found by an
equi-join of the cell's ancestors with the leaves: one match by tiling.  A shared face belongs to the upper
leaf, the brick's own upper face to the last.
"""

from __future__ import annotations

from itertools import product

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mortar.functions.keys import coords
from mortar.operators import leaves as tree
from mortar.operators.fields import index_names
from mortar.operators.geometry import with_geometry
from mortar.plans.spec import Layout, MeshSpec


def names_of(dims: int) -> list[str]:
    return [f"x{d + 1}" for d in range(dims)]


def fold(mesh: MeshSpec, d: int) -> tuple[Column, Column, Column]:
    """The folded coordinate, whether it was mirrored, and whether it is inside (the closed box)."""
    x, (lo, hi) = F.col(f"x{d + 1}"), mesh.extents[d]
    mirrored = F.lit(False)
    if mesh.periodic[d]:
        turned = x - F.floor((x - lo) / (hi - lo)) * (hi - lo)
        y = F.when((x >= lo) & (x <= hi), x).when(turned >= hi, F.lit(lo)).otherwise(turned)
        return y, mirrored, ~F.isnan(x) & (F.abs(x) < float("inf"))
    y = x
    if (d, 0) in mesh.reflecting:
        mirrored, y = mirrored | (x < lo), F.when(x < lo, 2 * lo - x).otherwise(y)
    if (d, 1) in mesh.reflecting:
        mirrored, y = mirrored | (x > hi), F.when(x > hi, 2 * hi - x).otherwise(y)
    return y, mirrored, (y >= lo) & (y <= hi) & ~F.isnan(x)


def locate(query: DataFrame, leaves: DataFrame, mesh: MeshSpec, levels: int, outside: str = "mark") -> DataFrame:
    """``(pid, x1 .., leaf, fold, inside)``: folded positions, a bit a mirrored dimension, and the leaf."""
    dims, xs = mesh.dims, names_of(mesh.dims)
    inside, code, y, cell, root, stride = F.lit(True), F.lit(0), [], [], F.lit(0), 1
    for d in range(dims):
        at, mirrored, ok = fold(mesh, d)
        (lo, hi), n = mesh.extents[d], mesh.roots[d] << levels
        inside, code = inside & ok, code + F.when(mirrored, 1 << d).otherwise(0)
        y.append(at.alias(xs[d]))
        whole = F.least(F.floor((at - lo) / (hi - lo) * n).cast("long"), F.lit(n - 1))
        root, stride = root + F.shiftright(whole, levels) * stride, stride * mesh.roots[d]
        cell.append((whole % (1 << levels)).alias(coords(dims)[d]))
    folded = query.withColumn("_in", inside).select("pid", *y, code.alias("fold"), F.col("_in").alias("inside"), F.when(F.col("_in"), root).cast("int").alias("root"), F.lit(levels).alias("level"), *cell)
    hit = tree.covering(leaves, folded.where("inside"), dims, "pid")
    out = folded.join(hit, "pid", "left").select("pid", *xs, "leaf", "fold", "inside")
    if outside == "error" and out.where(~F.col("inside")).limit(1).count():
        raise ValueError("a point is outside the mesh")
    return out


def multi_indices(dims: int, order: int) -> list[tuple[int, ...]]:
    """The derivatives of total order ``order`` (2 at most) and less, lower orders first."""
    if not 0 <= order <= 2:
        raise ValueError("derivatives of total order 2 at most")
    return sorted((m for m in product(range(order + 1), repeat=dims) if sum(m) <= order), key=lambda m: (sum(m), [-k for k in m]))


def lagrange_columns(y: Column, first: Column, n: int, derivative: int = 0) -> list[Column]:
    """Weights of ``n`` nodes at ``first`` + k for the value, first or second derivative at ``y`` (in cells)."""
    t, out = y - first, []
    for k in range(n):
        others = [j for j in range(n) if j != k]
        scale = 1.0
        for j in others:
            scale *= k - j

        def terms(left: list[int]) -> Column:
            w = F.lit(1.0)
            for j in left:
                w = w * (t - float(j))
            return w

        if derivative == 0:
            total = terms(others)
        elif derivative == 1:
            total = sum((terms([j for j in others if j != a]) for a in others), F.lit(0.0))
        else:
            total = sum((terms([j for j in others if j not in (a, b)]) for a in others for b in others if a != b), F.lit(0.0))
        out.append(total / scale)
    return out


def interpolate(located: DataFrame, points: DataFrame, leaves: DataFrame, mesh: MeshSpec, layout: Layout, n: int, derivs: list[tuple[int, ...]], exclude=None, fill: float | None = None) -> DataFrame:
    """``(pid, k, variables, excluded)``: value or derivative ``derivs[k]`` of the n-point Lagrange polynomial in each dimension.

    The stencil is the n stored points around the position, moved inward at the array's ends; ghosts must be
    filled if it reaches them.  ``exclude(x1, ..)`` flags results whose stencil holds such a point.  Points outside have
    no rows, or with ``fill`` (NaN, say) rows of that value, not excluded, and a column ``inside``."""
    dims = mesh.dims
    for m in derivs:
        if len(m) != dims or sum(m) > 2 or max(m) >= n:
            raise ValueError("derivatives of total order 2 at most, each less than the points")
    placed = with_geometry(leaves, mesh).select("leaf", "h", *[f"lo{d + 1}" for d in range(dims)])
    rows = located.where("inside").join(placed, "leaf")
    for d in range(dims):
        g, c = layout.ghosts[d], layout.stagger[d]
        at = (F.col(f"x{d + 1}") - F.col(f"lo{d + 1}")) / F.col("h") + (g + (1.0 if c else 0.5))
        last = mesh.cells + 2 * g + c - n + 1
        rows = rows.withColumn(f"_y{d + 1}", at)
        low = F.floor(F.col(f"_y{d + 1}") - (n - 2) / 2.0) if n % 2 == 0 else F.floor(F.col(f"_y{d + 1}") - (n - 1) / 2.0 + 0.5)
        rows = rows.withColumn(f"_s{d + 1}", F.least(F.greatest(low, F.lit(1)), F.lit(last)).cast("int"))
        for order in range(3):
            rows = rows.withColumn(f"_w{d + 1}_{order}", F.array(*lagrange_columns(F.col(f"_y{d + 1}"), F.col(f"_s{d + 1}"), n, order)) if order < n else F.lit(None).cast("array<double>"))
    taps = F.array(*[F.struct(*[F.lit(x).alias(f"k{d + 1}") for d, x in enumerate(k)]) for k in product(range(n), repeat=dims)])
    spread = rows.withColumn("_t", F.explode(taps))
    index = [(F.col(f"_s{d + 1}") + F.col(f"_t.k{d + 1}")).alias(f"i{d + 1}") for d in range(dims)]
    ws = []
    for k, m in enumerate(derivs):
        w = F.lit(1.0)
        for d in range(dims):
            w = w * F.element_at(F.col(f"_w{d + 1}_{m[d]}"), F.col(f"_t.k{d + 1}") + 1)
        w = w / F.pow(F.col("h"), F.lit(float(sum(m))))
        for d in range(dims):  # a mirrored dimension turns odd derivatives
            if m[d] % 2:
                w = w * F.when(F.shiftright("fold", d).bitwiseAND(F.lit(1)) == 1, -1.0).otherwise(1.0)
        ws.append(w.alias(f"_d{k}"))
    if exclude is not None:
        xs = []
        for d in range(dims):
            c = layout.stagger[d]
            xs.append(F.col(f"lo{d + 1}") + (F.col(f"_s{d + 1}") + F.col(f"_t.k{d + 1}") - (layout.ghosts[d] + (1.0 if c else 0.5))) * F.col("h"))
        ws.append(exclude(*xs).alias("_ex"))
    else:
        ws.append(F.lit(False).alias("_ex"))
    joined = spread.select("pid", "leaf", *index, *ws).join(points, ["leaf", *index_names(dims)])
    sums = [F.sum(F.col(f"_d{k}") * F.col(v)).alias(f"_{v}_{k}") for k in range(len(derivs)) for v in layout.variables]
    done = joined.groupBy("pid").agg(F.max("_ex").alias("excluded"), *sums)
    each = F.array(*[F.struct(F.lit(k).alias("k"), *[F.col(f"_{v}_{k}").alias(v) for v in layout.variables]) for k in range(len(derivs))])
    out = done.withColumn("_e", F.explode(each)).select("pid", "_e.*", "excluded")
    if fill is None:
        return out
    every = F.explode(F.array(*[F.lit(k) for k in range(len(derivs))]))
    beyond = located.where(~F.coalesce("inside", F.lit(False))).select("pid", every.alias("k"), *filled(layout, fill), F.lit(False).alias("excluded"))
    return out.withColumn("inside", F.lit(True)).unionByName(beyond.withColumn("inside", F.lit(False)))


def filled(layout: Layout, fill: float) -> list[Column]:
    return [F.lit(float(fill)).alias(v) for v in layout.variables]


def ellipsoid(centre: tuple[float, ...], axes: tuple[float, ...]):
    """A region predicate over position columns."""
    return lambda *xs: sum((F.pow((x - c) / a, F.lit(2.0)) for x, c, a in zip(xs, centre, axes, strict=True)), F.lit(0.0)) < 1.0


def uniform_grid(spark, mesh: MeshSpec, counts: tuple[int, ...]) -> DataFrame:
    """``(pid, x1 ..)``: cell centres of a uniform grid over the brick, the first dimension fastest."""
    total = 1
    for n in counts:
        total *= n
    out, stride = spark.range(total).withColumnRenamed("id", "pid"), 1
    for d, n in enumerate(counts):
        lo, hi = mesh.extents[d]
        k = F.floor(F.col("pid") / stride) % n
        out, stride = out.withColumn(f"x{d + 1}", F.lit(lo) + (k + 0.5) * F.lit((hi - lo) / n)), stride * n
    return out


def box_grid(spark, lo: tuple[float, ...], hi: tuple[float, ...], counts: tuple[int, ...]) -> DataFrame:
    """``(pid, x1 ..)``: a regular grid that fills the box, both corners included; one point along a dimension lies at ``lo``."""
    if not len(lo) == len(hi) == len(counts) or min(counts) < 1:
        raise ValueError("a corner, a corner and a positive count for each dimension")
    zero = [0.0] * len(lo)
    steps = [(b - a) / (n - 1) if n > 1 else 0.0 for a, b, n in zip(lo, hi, counts, strict=True)]
    return affine_grid(spark, lo, tuple(tuple(s if d == k else 0.0 for d in range(len(zero))) for k, s in enumerate(steps)), counts)


def affine_grid(spark, origin: tuple[float, ...], axes: tuple[tuple[float, ...], ...], counts: tuple[int, ...]) -> DataFrame:
    """``(pid, x1 ..)``: the points origin + sum of i_k axes[k], i_k from 0, the first axis fastest: a line, plane or box at any angle."""
    if not 1 <= len(axes) <= len(origin) or any(len(a) != len(origin) for a in axes) or len(counts) != len(axes) or min(counts) < 1:
        raise ValueError("one to D axes of D components, and a positive count for each")
    total = 1
    for n in counts:
        total *= n
    out, stride, xs = spark.range(total).withColumnRenamed("id", "pid"), 1, [F.lit(float(o)) for o in origin]
    for axis, n in zip(axes, counts, strict=True):
        k = (F.floor(F.col("pid") / stride) % n).cast("double")
        xs, stride = [x + k * F.lit(float(a)) for x, a in zip(xs, axis, strict=True)], stride * n
    return out.select("pid", *[x.alias(f"x{d + 1}") for d, x in enumerate(xs)])


def patch_grid(grid: DataFrame, patch: int) -> DataFrame:
    """A grid's points as points of a patch of a forest: ``(pid, patch, x1 ..)``."""
    return grid.select("pid", F.lit(patch).alias("patch"), *[c for c in grid.columns if c != "pid"])


def lattice(leaves: DataFrame, mesh: MeshSpec, k: int) -> DataFrame:
    """``(pid, leaf, x1 ..)``: the k**D sub-centres of every cell, located without a search."""
    rows = with_geometry(leaves, mesh)
    per, pid = mesh.cells * k, (F.col("leaf") - 1) * (mesh.cells * k) ** mesh.dims
    for d in range(mesh.dims):
        rows = rows.withColumn(f"_k{d + 1}", F.explode(F.sequence(F.lit(0), F.lit(per - 1))))
        pid = pid + F.col(f"_k{d + 1}") * per**d
    return rows.select(pid.alias("pid"), "leaf", *[(F.col(f"lo{d + 1}") + (F.col(f"_k{d + 1}") + 0.5) * F.col("h") / k).alias(f"x{d + 1}") for d in range(mesh.dims)])

