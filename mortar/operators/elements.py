"""Element sets: blocks of elements of order P with Gauss-Lobatto nodes, P + 1 stored points an element."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mortar.operators.fields import index_names
from mortar.operators.geometry import with_geometry
from mortar.operators.locate import filled
from mortar.plans import elements
from mortar.plans.spec import Layout, MeshSpec


def literal(values) -> Column:
    return F.array(*[F.lit(float(v)) for v in values])


def positions(points: DataFrame, leaves: DataFrame, mesh: MeshSpec, layout: Layout) -> DataFrame:
    """Adds ``x1 ..`` and ``weight``, the tensor quadrature weight, to points of an element set; a ghost lies on its face and weighs nothing."""
    n = layout.order + 1
    nodes, ws = (literal(v) for v in elements.lobatto(layout.order))
    placed = with_geometry(leaves, mesh).select("leaf", "h", *[f"lo{d + 1}" for d in range(mesh.dims)])
    out, weight = points.join(placed, "leaf"), F.lit(1.0)
    for d, name in enumerate(index_names(mesh.dims)):
        at = F.col(name) - layout.ghosts[d] - 1
        element = F.floor(at / n)
        wide = F.col("h") * n
        inside, k = at.between(0, mesh.cells - 1), F.pmod(at, F.lit(n)) + 1
        place = F.when(inside, wide * (element + (1 + F.element_at(nodes, k.cast("int"))) / 2)).when(at < 0, 0.0).otherwise(F.col("h") * mesh.cells)
        out = out.withColumn(f"x{d + 1}", F.col(f"lo{d + 1}") + place)
        weight = weight * F.when(inside, F.element_at(ws, k.cast("int")) * wide / 2).otherwise(0.0)
    return out.withColumn("weight", weight).drop("h", *[f"lo{d + 1}" for d in range(mesh.dims)])


def quadrature(placed: DataFrame, variable: str) -> DataFrame:
    """The integral over the brick."""
    return placed.agg(F.sum(F.col(variable) * F.col("weight")).alias("integral"))


def basis_columns(xi: Column, order: int) -> list[Column]:
    """The nodal polynomials at a reference coordinate in [-1, 1]."""
    nodes = [float(x) for x in elements.lobatto(order)[0]]
    out = []
    for k, a in enumerate(nodes):
        v = F.lit(1.0)
        for j, b in enumerate(nodes):
            if j != k:
                v = v * (xi - b) / (a - b)
        out.append(v)
    return out


def interpolate(located: DataFrame, points: DataFrame, leaves: DataFrame, mesh: MeshSpec, layout: Layout, fill: float | None = None) -> DataFrame:
    """``(pid, variables)``: each point's element polynomial; a shared face belongs to the upper element; no ghosts are read.
    Points outside have no rows, or with ``fill`` rows of that value, and a column ``inside``."""
    n, dims = layout.order + 1, mesh.dims
    placed = with_geometry(leaves, mesh).select("leaf", "h", *[f"lo{d + 1}" for d in range(dims)])
    rows, per = located.where("inside").join(placed, "leaf"), mesh.cells // n
    for d in range(dims):
        at = (F.col(f"x{d + 1}") - F.col(f"lo{d + 1}")) / (F.col("h") * n)
        e = F.least(F.floor(at), F.lit(per - 1))
        rows = rows.withColumn(f"_e{d + 1}", e.cast("int")).withColumn(f"_w{d + 1}", F.array(*basis_columns(2 * (at - e) - 1, layout.order)))
    for d in range(dims):
        rows = rows.withColumn(f"_k{d + 1}", F.explode(F.sequence(F.lit(0), F.lit(n - 1))))
    weight = F.lit(1.0)
    for d in range(dims):
        weight = weight * F.element_at(F.col(f"_w{d + 1}"), F.col(f"_k{d + 1}") + 1)
    index = [(F.col(f"_e{d + 1}") * n + F.col(f"_k{d + 1}") + layout.ghosts[d] + 1).cast("int").alias(name) for d, name in enumerate(index_names(dims))]
    taps = rows.select("pid", "leaf", *index, weight.alias("_w"))
    out = taps.join(points, ["leaf", *index_names(dims)]).groupBy("pid").agg(*[F.sum(F.col("_w") * F.col(v)).alias(v) for v in layout.variables])
    if fill is None:
        return out
    beyond = located.where(~F.coalesce("inside", F.lit(False))).select("pid", *filled(layout, fill))
    return out.withColumn("inside", F.lit(True)).unionByName(beyond.withColumn("inside", F.lit(False)))
