"""Meshes and fields derived from tables, in integer arithmetic."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mortar.functions.lineage import cut
from mortar.operators import leaves as tree
from mortar.plans.spec import MeshSpec

LEVELS, PARTS = 6, 66
#: One root of [0, 1]^2, blocks of 4 x 4 cells.
UNIT2 = MeshSpec(roots=(1, 1), cells=4)
PERIODIC2 = MeshSpec(roots=(1, 1), cells=4, periodic=(True, True))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def cells2d(spark: SparkSession, sf_dir: str, bits: int = LEVELS) -> DataFrame:
    """``(c1, c2, cnt, mass)``: line items over 2**bits x 2**bits cells of squared part and supplier keys."""
    items = table(spark, sf_dir, "lineitem").select("l_partkey", "l_suppkey", "l_quantity")
    top = items.agg(F.max("l_partkey") + 1, F.max("l_suppkey") + 1).first()
    p, s = (int(x or 1) for x in top)
    n = 1 << bits
    c1 = F.expr(f"(l_partkey * l_partkey * {n}L) div ({p}L * {p}L)")
    c2 = F.expr(f"(l_suppkey * l_suppkey * {n}L) div ({s}L * {s}L)")
    return items.groupBy(c1.alias("c1"), c2.alias("c2")).agg(F.count("*").alias("cnt"), F.sum("l_quantity").alias("mass"))


def totals2d(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tree.occupied(cells2d(spark, sf_dir), 2, LEVELS, "cnt", "mass")


def leaves2d(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The adaptive mesh: nodes with more than 1 / PARTS of all rows split; numbered along the curve."""
    totals = cut(totals2d(spark, sf_dir))
    n = totals.where("level = 0").agg(F.sum("cnt")).first()[0] or 0
    split = F.col("cnt") * PARTS > n
    return cut(tree.numbered(tree.thresholded(totals, split, 2, LEVELS, tree.roots(spark, UNIT2)), 2, LEVELS))


def balanced2d(spark: SparkSession, sf_dir: str, mesh: MeshSpec = UNIT2) -> DataFrame:
    return cut(tree.numbered(tree.balance(leaves2d(spark, sf_dir), mesh, LEVELS), 2, LEVELS))


def two_levels(spark: SparkSession, sf_dir: str, base: int = 3) -> DataFrame:
    """The nodes of level ``base``, split where they hold more rows than an equal share; numbered."""
    totals = cut(totals2d(spark, sf_dir))
    n = totals.where("level = 0").agg(F.sum("cnt")).first()[0] or 0
    grid = F.sequence(F.lit(0), F.lit((1 << base) - 1))
    flat = spark.range(1).select(F.lit(0).alias("root"), F.lit(base).alias("level"), F.explode(grid).alias("c1")).withColumn("c2", F.explode(grid))
    flat = flat.withColumns({"c1": F.col("c1").cast("long"), "c2": F.col("c2").cast("long")})
    heavy = totals.where((F.col("level") == base) & (F.col("cnt") * (1 << 2 * base) > n)).select("root", "level", "c1", "c2")
    return cut(tree.numbered(tree.refine(flat, heavy, 2), 2, base + 1))


#: Four roots of [0, 1]^2 x [0, 0.5], blocks of 4 cells a side.
BRICK3 = MeshSpec(roots=(2, 2, 1), cells=4, extents=((0.0, 1.0), (0.0, 1.0), (0.0, 0.5)))


def leaves3d(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Four roots, of which those that get a quarter or more of the orders by customer key are split; numbered."""
    share = table(spark, sf_dir, "orders").groupBy((F.col("o_custkey") % 4).cast("int").alias("root")).agg(F.count("*").alias("n"))
    total = share.agg(F.sum("n")).first()[0] or 0
    split = tree.roots(spark, BRICK3).join(share.where(F.col("n") * 4 >= total), "root", "left_semi")
    return cut(tree.numbered(tree.refine(tree.roots(spark, BRICK3), split, 3), 3, 1))


def points2d(spark: SparkSession, sf_dir: str, leaves: DataFrame, mesh: MeshSpec = UNIT2) -> DataFrame:
    """The field ``v1``: the quantity in each owned cell of each block, 0 where there is none: (leaf, i1, i2, v1), no ghosts."""
    bits = LEVELS + mesh.cells.bit_length() - 1
    up = tree.occupied(cells2d(spark, sf_dir, bits), 2, bits, "mass").drop("root").withColumnRenamed("level", "l")
    grid = F.sequence(F.lit(1), F.lit(mesh.cells))
    own = leaves.select("leaf", "level", "c1", "c2", F.explode(grid).alias("i1")).withColumn("i2", F.explode(grid))
    at = own.withColumns({"l": F.col("level") + (mesh.cells.bit_length() - 1), "x1": F.col("c1") * mesh.cells + F.col("i1") - 1, "x2": F.col("c2") * mesh.cells + F.col("i2") - 1})
    data = up.select("l", F.col("c1").alias("x1"), F.col("c2").alias("x2"), "mass")
    return at.join(data, ["l", "x1", "x2"], "left").select("leaf", "i1", "i2", F.coalesce("mass", F.lit(0.0)).alias("v1"))
