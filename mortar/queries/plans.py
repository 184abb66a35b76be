"""Weights, element tables, saving and streaming."""

from __future__ import annotations

import uuid
from fractions import Fraction

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mortar.functions.lineage import shared_folder
from mortar.plans import elements, weights
from mortar.plans.spec import Layout, cellcentered
from mortar.queries import sql
from mortar.sources import meshes, store
from mortar.streaming import folds

QUERIES, ORACLES = {}, {}


def query(oracle: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if oracle:
            ORACLES[f.__name__] = oracle
        return f

    return register


@query("""SELECT p, k, round(product((p / 2 - 1 + 0.25 - j) / (k - j)), 9) AS w FROM (SELECT unnest([2, 4, 6]) AS p), (SELECT CAST(range AS INTEGER) AS k FROM range(6)),
(SELECT CAST(range AS INTEGER) AS j FROM range(6)) WHERE k < p AND j < p AND j <> k GROUP BY p, k""")
def w03_lagrange_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Weights a quarter cell beyond the node left of the middle, orders 2, 4 and 6."""
    rows = [(p, k, round(float(w), 9)) for p in (2, 4, 6) for k, w in enumerate(weights.lagrange(p, Fraction(p // 2 - 1) + Fraction(1, 4)))]
    return spark.createDataFrame(rows, "p int, k int, w double")


@query("SELECT * FROM (VALUES (1, 0, 0, 1.0::DOUBLE), (1, 1, 0, 1.0), (3, 0, 0, 0.125), (3, 0, 1, 1.0), (3, 0, 2, -0.125), (3, 1, 0, -0.125), (3, 1, 1, 1.0), (3, 1, 2, 0.125)) t(p, half, k, w)")
def w04_subcell_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = [(p, half, k, float(w)) for p in (1, 3) for half in (0, 1) for k, w in enumerate(weights.subcell(p)[half])]
    return spark.createDataFrame(rows, "p int, half int, k int, w double")


@query("""SELECT * FROM (SELECT d1 AS step, CAST(j.range AS INTEGER) AS t, CAST(j.range - 4 * d1 AS INTEGER) AS s, 1.0::DOUBLE AS w
FROM (SELECT unnest([-1, 0, 1]) AS d1), range(1, 9) j WHERE CASE d1 WHEN -1 THEN j.range <= 2 WHEN 1 THEN j.range >= 7 ELSE j.range BETWEEN 3 AND 6 END)""")
def w05_w06_copy_taps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Four cells and two ghosts."""
    rows = [(step, t, s, float(w)) for step in (-1, 0, 1) for t, row in weights.copy(4, 2, 0, step).items() for s, w in row]
    return spark.createDataFrame(rows, "step int, t int, s int, w double")


@query("""SELECT * FROM (VALUES (1, 0, -1.0::DOUBLE, 1.0::DOUBLE), (1, 1, 1.0, 1.0), (2, 0, -1.0, 1.0 / 3), (2, 1, 0.0, 4.0 / 3), (2, 2, 1.0, 1.0 / 3),
(3, 0, -1.0, 1.0 / 6), (3, 1, -sqrt(0.2), 5.0 / 6), (3, 2, sqrt(0.2), 5.0 / 6), (3, 3, 1.0, 1.0 / 6),
(4, 0, -1.0, 0.1), (4, 1, -sqrt(3.0 / 7), 49.0 / 90), (4, 2, 0.0, 32.0 / 45), (4, 3, sqrt(3.0 / 7), 49.0 / 90), (4, 4, 1.0, 0.1)) t(p, k, x, w)""".replace("SELECT *", "SELECT p, k, round(x, 9) AS x, round(w, 9) AS w"))
def w17_lobatto_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = [(p, k, round(float(x), 9) + 0.0, round(float(w), 9)) for p in (1, 2, 3, 4) for k, (x, w) in enumerate(zip(*elements.lobatto(p), strict=True))]
    return spark.createDataFrame(rows, "p int, k int, x double, w double")


@query(f"WITH {sql.GRADED}, {sql.values()} SELECT level, leaf, i1, i2, v1 FROM val")
def f16_l09_save_and_reload(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = f"{shared_folder(spark)}/mesh-{uuid.uuid4().hex}"
    leaves = meshes.leaves2d(spark, sf_dir)
    store.save(path, meshes.UNIT2, Layout(cellcentered(2), (0, 0)), leaves, meshes.points2d(spark, sf_dir, leaves))
    _, _, again, points = store.load(spark, path, meshes.LEVELS)
    return points.join(again.select("leaf", "level"), "leaf").select("level", "leaf", "i1", "i2", "v1")


@query("SELECT event_type, count(*) AS n, max(value) AS high, min(value) AS low, CAST(date_trunc('day', ts) AS DATE) AS day FROM events GROUP BY ALL")
def s01_stream_folds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Daily folds of events by Structured Streaming, run to the end of the table."""
    return folds.run_to_end(spark, f"{sf_dir}/events.parquet").select("event_type", "n", "high", "low", F.col("start").cast("date").alias("day"))
