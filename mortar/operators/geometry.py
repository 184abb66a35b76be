"""Positions of blocks and nodes as columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mortar.functions.keys import coords
from mortar.plans.spec import Layout, MeshSpec


def spacing(mesh: MeshSpec, level: Column | None = None) -> Column:
    """Cell width at a level."""
    return F.lit(mesh.root_spacing) / F.pow(F.lit(2.0), F.col("level") if level is None else level)


def minimum_spacing(leaves: DataFrame, mesh: MeshSpec) -> DataFrame:
    return leaves.agg(F.max("level").alias("maxlevel"), F.min(spacing(mesh)).alias("h"))


def origin(mesh: MeshSpec, d: int) -> Column:
    """Lower corner of a block's interior along dimension ``d``."""
    stride = 1
    for r in mesh.roots[:d]:
        stride *= r
    at = F.floor(F.col("root") / stride) % mesh.roots[d]
    width = (mesh.extents[d][1] - mesh.extents[d][0]) / mesh.roots[d]
    return F.lit(mesh.extents[d][0]) + F.lit(width) * (at + F.col(coords(mesh.dims)[d]) / F.pow(F.lit(2.0), F.col("level")))


def with_geometry(leaves: DataFrame, mesh: MeshSpec) -> DataFrame:
    """Adds ``h``, and ``lo1, hi1 ..`` of each block; blocks tile the brick exactly."""
    out = leaves.withColumn("h", spacing(mesh))
    for d in range(mesh.dims):
        out = out.withColumn(f"lo{d + 1}", origin(mesh, d))
        out = out.withColumn(f"hi{d + 1}", F.col(f"lo{d + 1}") + F.col("h") * mesh.cells)
    return out


def positions(points: DataFrame, leaves: DataFrame, mesh: MeshSpec, layout: Layout) -> DataFrame:
    """Adds ``x1 ..`` and ``h`` to points: cell centres half a width in, vertices on the planes."""
    where = leaves.select("leaf", F.col("level").alias("_level"), spacing(mesh).alias("h"), *[origin(mesh, d).alias(f"_o{d + 1}") for d in range(mesh.dims)])
    out = points.join(where, "leaf")
    for d, (g, c) in enumerate(zip(layout.ghosts, layout.stagger, strict=True)):
        shift = g + (1.0 if c else 0.5)
        out = out.withColumn(f"x{d + 1}", F.col(f"_o{d + 1}") + (F.col(f"i{d + 1}") - shift) * F.col("h"))
    return out.drop("_level", *[f"_o{d + 1}" for d in range(mesh.dims)])
