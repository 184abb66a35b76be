"""Bounded prolongation: no new extrema, NaN propagates.

``minmod`` rebuilds a parent's children from limited slopes (conservative, order 3); ``bracket`` clamps
a point-value result to the range of the values that linear interpolation would use."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mortar.operators.fields import index_names


def minmod(*xs: Column) -> Column:
    """The argument of least size if all have one sign, else 0; NaN if one is NaN."""
    low, high, bad = F.least(*xs), F.greatest(*xs), F.lit(False)
    for x in xs:
        bad = bad | F.isnan(x)
    return F.when(bad, F.lit(float("nan"))).when(low > 0, low).when(high < 0, high).otherwise(0.0)


def mc_slope(before: Column, here: Column, after: Column) -> Column:
    """The monotonised central slope."""
    a, b = here - before, after - here
    return minmod(2 * a, 2 * b, (a + b) / 2)


def split_cells(points: DataFrame, dims: int, variable: str) -> DataFrame:
    """Each cell with all 2 D neighbours stored becomes its 2**D children: (leaf, i1 .. in half cells from 2 i - 1, value).

    value = u + phi sum(sigma_d s_d / 4); phi scales the slopes so that no child leaves the range of the cell and its
    neighbours; the children's mean is u exactly."""
    names, rows = index_names(dims), points.select("leaf", *index_names(dims), F.col(variable).alias("_u"))
    wide = rows
    for d in range(dims):
        for tag, shift in (("l", 1), ("h", -1)):
            moved = rows.select("leaf", *[(F.col(n) + (shift if k == d else 0)).alias(n) for k, n in enumerate(names)], F.col("_u").alias(f"_{tag}{d}"))
            wide = wide.join(moved, ["leaf", *names])
    u = F.col("_u")
    near = [F.col(f"_{tag}{d}") for d in range(dims) for tag in "lh"]
    top, bottom = F.greatest(u, *near), F.least(u, *near)
    slopes = [mc_slope(F.col(f"_l{d}"), u, F.col(f"_h{d}")) for d in range(dims)]
    reach = sum((F.abs(s) for s in slopes), F.lit(0.0)) / 4
    room = F.least(top - u, u - bottom)
    phi = F.when(reach > room, room / reach).otherwise(1.0)
    guard = (top - bottom) * 0.0  # NaN or infinity anywhere stays visible
    signs = F.array(*[F.struct(*[F.lit(k >> d & 1).alias(f"o{d}") for d in range(dims)]) for k in range(2**dims)])
    out = wide.withColumns({"_p": phi, "_g": guard, **{f"_s{d}": s for d, s in enumerate(slopes)}}).withColumn("_o", F.explode(signs))
    value = u + F.col("_g") + F.col("_p") * sum((F.col(f"_s{d}") * (F.col(f"_o.o{d}") * 2 - 1) / 4 for d in range(dims)), F.lit(0.0))
    return out.select("leaf", *[(F.col(n) * 2 - 1 + F.col(f"_o.o{d}")).alias(n) for d, n in enumerate(names)], value.alias(variable))


def bracket(total: Column, low: Column, high: Column) -> Column:
    """``total`` clamped to the bracket's range; NaN in the bracket stays visible."""
    return F.greatest(F.least(total, high), low) + (high - low) * 0.0


def bounded_sum(variable: str, dims: int) -> Column:
    """The aggregate of one target's taps (w, mode, near, role, g1 ..): plain, clamped to its bracket, or by limited slopes."""
    v = F.col(variable)
    total = F.sum(F.col("w") * v)
    low, high = (f(F.when(F.col("near"), v)) for f in (F.min, F.max))
    clamped = F.when(F.isnan(total), total).otherwise(bracket(total, low, high))
    at = lambda k: F.max(F.when(F.col("role") == k, v))
    u, near = at(0), [at(k) for k in range(1, 2 * dims + 1)]
    top, bottom = F.greatest(u, *near), F.least(u, *near)
    slopes = [mc_slope(near[2 * d], u, near[2 * d + 1]) for d in range(dims)]
    reach = sum((F.abs(s) for s in slopes), F.lit(0.0)) / 4
    room = F.least(top - u, u - bottom)
    change = sum((s * F.max(f"g{d + 1}") for d, s in enumerate(slopes)), F.lit(0.0)) / 4
    limited = u + F.when(reach > room, room / reach).otherwise(1.0) * change + (top - bottom) * 0.0
    mode = F.max("mode")
    return F.when(mode == "bracket", clamped).when(mode == "slopes", limited).otherwise(total)
