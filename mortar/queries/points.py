"""Point location, point grids and interpolation over the graded mesh of line items."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mortar.operators import atlas, elements, fields, locate
from mortar.plans.spec import Layout, MeshSpec, cellcentered, elementcentered
from mortar.queries import sql
from mortar.sources import meshes
from mortar.sources.meshes import LEVELS, PERIODIC2, UNIT2

WITH = f"WITH {sql.GRADED}, {sql.values()}"
QUERIES, ORACLES = {}, {}


def query(oracle: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if oracle:
            ORACLES[f.__name__] = oracle
        return f

    return register


def order_points(spark: SparkSession, sf_dir: str, shift: float = 0.0) -> DataFrame:
    """Orders as points at odd multiples of 1 / 512, so none lies on a face."""
    spot = lambda c, m: ((F.col(c) * m) % 256 * 2 + 1) / 512.0 + shift
    orders = meshes.table(spark, sf_dir, "orders")
    return orders.select(F.col("o_orderkey").alias("pid"), spot("o_custkey", 1).alias("x1"), spot("o_orderkey", 7).alias("x2"))


POINT = "SELECT o_orderkey AS pid, (o_custkey % 256 * 2 + 1) / 512.0 AS x1, (o_orderkey * 7 % 256 * 2 + 1) / 512.0 AS x2 FROM orders"
HIT = "floor({x}1 * (1 << level)) = c1 AND floor({x}2 * (1 << level)) = c2"


@query(f"WITH {sql.GRADED}, q AS ({POINT}) SELECT pid, leaf FROM q JOIN leaf ON {HIT.format(x='x')}")
def p02_locate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return locate.locate(order_points(spark, sf_dir), meshes.leaves2d(spark, sf_dir), UNIT2, LEVELS).select("pid", "leaf")


@query(f"WITH {sql.GRADED}, q AS (SELECT pid, x1 - 1.25 - floor(x1 - 1.25) AS x1, x2 - 1.25 - floor(x2 - 1.25) AS x2 FROM ({POINT})) SELECT pid, x1, x2, leaf FROM q JOIN leaf ON {HIT.format(x='x')}")
def p01_fold_periodic(spark: SparkSession, sf_dir: str) -> DataFrame:
    return locate.locate(order_points(spark, sf_dir, -1.25), meshes.leaves2d(spark, sf_dir), PERIODIC2, LEVELS).select("pid", "x1", "x2", "leaf")


@query(f"""WITH {sql.GRADED}, q AS (SELECT pid, x1 - 0.5 AS g1, x2 - 0.5 AS g2 FROM ({POINT})),
f AS (SELECT pid, abs(g1) AS x1, g2 AS x2, CASE WHEN g1 < 0 THEN 1 ELSE 0 END AS fold, g2 >= 0 AS inside FROM q)
SELECT pid, x1, x2, fold, inside, leaf FROM f LEFT JOIN leaf ON inside AND {HIT.format(x='x')}""")
def p01_p04_fold_reflecting(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Half of the points lie beyond a reflecting face, half of the others outside."""
    mesh = MeshSpec(roots=(1, 1), cells=4, reflecting=frozenset({(0, 0)}))
    found = locate.locate(order_points(spark, sf_dir, -0.5), meshes.leaves2d(spark, sf_dir), mesh, LEVELS)
    return found.select("pid", "x1", "x2", "fold", "inside", "leaf")


@query("SELECT range AS pid, CAST((range % 5 + 0.5) * 0.2 AS DOUBLE) AS x1, CAST((range // 5 + 0.5) * 0.25 AS DOUBLE) AS x2 FROM range(20)")
def p15_uniform_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return locate.uniform_grid(spark, UNIT2, (5, 4))


@query(f"""WITH {sql.GRADED} SELECT (leaf - 1) * 64 + i.range + 8 * j.range AS pid, leaf, c1 / power(2, level) + (i.range + 0.5) / 8 / power(2, level) AS x1,
c2 / power(2, level) + (j.range + 0.5) / 8 / power(2, level) AS x2 FROM leaf, range(8) i, range(8) j""")
def p16_p17_lattice(spark: SparkSession, sf_dir: str) -> DataFrame:
    return locate.lattice(meshes.leaves2d(spark, sf_dir), UNIT2, 2)


@query(f"""{WITH}, q AS ({POINT}), z AS (SELECT pid, leaf, x1, x2, (x1 * (1 << level) - c1) * 4 + 0.5 AS y1, (x2 * (1 << level) - c2) * 4 + 0.5 AS y2, 0.25 / power(2, level) AS h FROM q JOIN leaf ON {HIT.format(x='x')}),
s AS (SELECT *, least(greatest(floor(y1), 1), 3) AS s1, least(greatest(floor(y2), 1), 3) AS s2 FROM z),
t AS (SELECT s.*, a.v1 AS u00, b.v1 AS u10, c.v1 AS u01, d.v1 AS u11 FROM s
  JOIN val a ON a.leaf = s.leaf AND a.i1 = s1 AND a.i2 = s2 JOIN val b ON b.leaf = s.leaf AND b.i1 = s1 + 1 AND b.i2 = s2
  JOIN val c ON c.leaf = s.leaf AND c.i1 = s1 AND c.i2 = s2 + 1 JOIN val d ON d.leaf = s.leaf AND d.i1 = s1 + 1 AND d.i2 = s2 + 1)
SELECT pid, 0 AS k, round((1 - (y1 - s1)) * (1 - (y2 - s2)) * u00 + (y1 - s1) * (1 - (y2 - s2)) * u10 + (1 - (y1 - s1)) * (y2 - s2) * u01 + (y1 - s1) * (y2 - s2) * u11, 6) AS v1 FROM t
UNION ALL SELECT pid, 1, round(((1 - (y2 - s2)) * (u10 - u00) + (y2 - s2) * (u11 - u01)) / h, 6) FROM t""")
def p05_p07_interpolate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Linear interpolation of the field at orders' points, and its derivative along the first dimension."""
    leaves = meshes.leaves2d(spark, sf_dir)
    found = locate.locate(order_points(spark, sf_dir), leaves, UNIT2, LEVELS)
    got = locate.interpolate(found, meshes.points2d(spark, sf_dir, leaves), leaves, UNIT2, Layout(cellcentered(2), (0, 0)), 2, [(0, 0), (1, 0)])
    return got.select("pid", "k", F.round("v1", 6).alias("v1"))


ELEMENTS = Layout(elementcentered(2), (0, 0), order=1)


@query(f"""WITH {sql.GRADED}, e AS (SELECT leaf, (c1 + (i.range // 2 + i.range % 2) / 2.0) / power(2, level) AS x1, (c2 + (j.range // 2 + j.range % 2) / 2.0) / power(2, level) AS x2, power(0.25 / power(2, level), 2) AS w
FROM leaf, range(4) i, range(4) j) SELECT round(sum((x1 * x2 + 1) * w), 9) AS integral FROM e""")
def a08_element_quadrature(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The integral of x y + 1 over linear elements."""
    leaves = meshes.leaves2d(spark, sf_dir)
    placed = elements.positions(fields.grid(leaves, ELEMENTS.owned(4)), leaves, UNIT2, ELEMENTS)
    return elements.quadrature(placed.withColumn("v1", F.col("x1") * F.col("x2") + 1), "v1").select(F.round("integral", 9).alias("integral"))


@query(f"SELECT pid, round(x1 * x2 + 1, 9) AS v1 FROM ({POINT})")
def p06_element_interpolation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Linear elements reproduce x y + 1 at orders' points."""
    leaves = meshes.leaves2d(spark, sf_dir)
    placed = elements.positions(fields.grid(leaves, ELEMENTS.owned(4)), leaves, UNIT2, ELEMENTS)
    points = placed.select("leaf", "i1", "i2", (F.col("x1") * F.col("x2") + 1).alias("v1"))
    found = locate.locate(order_points(spark, sf_dir), leaves, UNIT2, LEVELS)
    return elements.interpolate(found, points, leaves, UNIT2, ELEMENTS).select("pid", F.round("v1", 9).alias("v1"))


@query(f"""SELECT pid, round(2 * (x1 + 1) * cos(x2), 6) AS ux, round((x1 + 1) * sin(x2), 6) AS uy, 2.0::DOUBLE AS uxx, 0.0::DOUBLE AS uxy, 0.0::DOUBLE AS uyy FROM ({POINT})""".replace("round((x1 + 1) * sin(x2), 6) AS uy", "3.0::DOUBLE AS uy"))
def p12_p13_chain_rule(spark: SparkSession, sf_dir: str) -> DataFrame:
    """u = X^2 + 3 Y in polar coordinates (radius x1 + 1, angle x2): physical derivatives from logical ones."""
    rows = order_points(spark, sf_dir)
    r, a = F.col("x1") + 1, F.col("x2")
    grad = [2 * r * F.cos(a) ** 2 + 3 * F.sin(a), -2 * r * r * F.cos(a) * F.sin(a) + 3 * r * F.cos(a)]
    hess = [[2 * F.cos(a) ** 2, -4 * r * F.cos(a) * F.sin(a) + 3 * F.cos(a)], [None, -2 * r * r * (F.cos(a) ** 2 - F.sin(a) ** 2) - 3 * r * F.sin(a)]]
    hess[1][0] = hess[0][1]
    d1, d2 = atlas.first(atlas.Polar(), [r, a], grad), atlas.second(atlas.Polar(), [r, a], grad, hess)
    show = lambda c: F.round(c, 6) + 0.0
    return rows.select("pid", show(d1[0]).alias("ux"), show(d1[1]).alias("uy"), show(d2[0][0]).alias("uxx"), show(d2[0][1]).alias("uxy"), show(d2[1][1]).alias("uyy"))
