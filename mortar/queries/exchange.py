"""Fills of every centering, walls, hooks, elements and glued forests over meshes of line items and orders."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mortar.functions.lineage import cut
from mortar.operators import atlas, exchange, fields, forest, geometry, locate, patched, regrid
from mortar.operators import elements as element_ops
from mortar.operators import leaves as tree
from mortar.plans import spec, weights
from mortar.plans.patches import Glue, PatchMesh, both_ways, of_brick
from mortar.plans.spec import Layout, MeshSpec, Operators, cellcentered, vertexcentered
from mortar.queries import sql
from mortar.queries.mesh import touching
from mortar.sources import meshes
from mortar.sources.meshes import BRICK3, LEVELS, PERIODIC2

QUERIES, ORACLES = {}, {}
UNIT8 = MeshSpec(roots=(1, 1), cells=8)
BAL = f"WITH RECURSIVE {sql.GRADED}, {sql.balanced('leaf', 'bal')}"


def query(oracle: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if oracle:
            ORACLES[f.__name__] = oracle
        return f

    return register


# -- ghosts of polynomials: exact where the order says so, whatever fills them -----------------


def sampled(layout: Layout, poly: str, cells: int = 8, leaves: str = "bal") -> str:
    """All stored points of the leaves with a function of their position."""
    axes = range(1, len(layout.ghosts) + 1)
    index = [f"CAST(r{d}.range AS INTEGER) AS i{d}" for d in axes]
    at, ranges = [], []
    for d, (g, c) in zip(axes, zip(layout.ghosts, layout.stagger, strict=True), strict=True):
        at.append(f"(c{d} + (r{d}.range - {g + (1.0 if c else 0.5)}) / {cells}.0) / power(2, level)")
        ranges.append(f"range(1, {cells + 2 * g + c + 1}) r{d}")
    xs = ", ".join(f"{x} AS {n}" for x, n in zip(at, "xyz", strict=False))
    return f"SELECT leaf, {', '.join(f'i{d}' for d in axes)}, round({poly}, 7) AS v1 FROM (SELECT leaf, {', '.join(index)}, {xs} FROM {leaves}, {', '.join(ranges)})"


def fill_of(leaves: DataFrame, mesh: MeshSpec, layout: Layout, ops: Operators, f) -> DataFrame:
    points = fields.fill_by_coordinates(leaves, mesh, layout, {"v1": f})
    return exchange.fill_ghosts(points, leaves, mesh, layout, ops, {"v1": f}).withColumn("v1", F.round("v1", 7))


CUBIC = "1 + x - x * y / 2 + x * x * x * y * y + y * y * y"
POINT4 = Operators("point", 4, 4)
CELLS, VERTICES, FACES, EDGES = Layout(cellcentered(2), (2, 2)), Layout(vertexcentered(2), (1, 1)), Layout(("vertex", "cell"), (1, 2)), Layout(("cell", "vertex"), (2, 1))


def cubic(x, y):
    return 1 + x - x * y / 2 + x * x * x * y * y + y * y * y


@query(f"{BAL} {sampled(CELLS, CUBIC)}")
def x01_x03_fill_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Point values in cells, order 4: two ghosts, copied, restricted in shifted windows and prolonged, and an outer hook."""
    return fill_of(meshes.balanced2d(spark, sf_dir), UNIT8, CELLS, POINT4, cubic)


@query(f"{BAL} {sampled(VERTICES, CUBIC)}")
def x01_f02_fill_vertices(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fill_of(meshes.balanced2d(spark, sf_dir), UNIT8, VERTICES, POINT4, cubic)


@query(f"{BAL} {sampled(FACES, CUBIC)}")
def x01_f02_fill_faces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fill_of(meshes.balanced2d(spark, sf_dir), UNIT8, FACES, POINT4, cubic)


@query(f"{BAL} {sampled(EDGES, CUBIC)}")
def x01_f02_fill_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fill_of(meshes.balanced2d(spark, sf_dir), UNIT8, EDGES, POINT4, cubic)


STAGGERED = Layout(("vertex", "cell"), (1, 1))


@query(f"{BAL} {sampled(STAGGERED, '1 + x * x * x + 2 * x * y')}")
def w01_w10_fill_staggered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A conservative set with a vertex dimension: averages along the cells, order 4 points along the vertices."""
    ops = Operators("conservative", 3, 2, vertex_prolongation=4)
    return fill_of(meshes.balanced2d(spark, sf_dir), UNIT8, STAGGERED, ops, lambda x, y: 1 + x * x * x + 2 * x * y)


LEAVES3 = """kid AS (SELECT CAST(x.range AS BIGINT) AS a, CAST(y.range AS BIGINT) AS b, CAST(z.range AS BIGINT) AS c FROM range(2) x, range(2) y, range(2) z),
big AS (SELECT o_custkey % 4 AS root FROM orders GROUP BY 1 HAVING count(*) * 4 >= (SELECT count(*) FROM orders)),
raw AS (SELECT range AS root, 0 AS level, 0 AS a, 0 AS b, 0 AS c FROM range(4) WHERE range NOT IN (SELECT root FROM big) UNION ALL SELECT root, 1, a, b, c FROM big, kid),
leaf AS (SELECT row_number() OVER (ORDER BY root, a, b, c) AS leaf, level, (root % 2) * (1 << level) + a AS c1, (root // 2) * (1 << level) + b AS c2, c AS c3 FROM raw)"""
CELLS3, VERTICES3 = Layout(cellcentered(3), (1, 1, 1)), Layout(vertexcentered(3), (1, 1, 1))


def half_spaced(layout: Layout, poly: str) -> str:
    """Roots are half a unit wide."""
    text = sampled(layout, poly, 4, "leaf")
    return text.replace("/ power(2, level)", "/ power(2, level + 1)")


@query(f"WITH {LEAVES3} {half_spaced(CELLS3, '1 + x + 2 * y * z - x * y * z')}")
def x01_fill_cells_3d(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fill_of(meshes.leaves3d(spark, sf_dir), BRICK3, CELLS3, Operators("point", 2, 2), lambda x, y, z: 1 + x + 2 * y * z - x * y * z)


@query(f"WITH {LEAVES3} {half_spaced(VERTICES3, '1 + x * x * x + 2 * y * y * z - x * y * z * z')}")
def x01_fill_vertices_3d(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fill_of(meshes.leaves3d(spark, sf_dir), BRICK3, VERTICES3, POINT4, lambda x, y, z: 1 + x * x * x + 2 * y * y * z - x * y * z * z)


# -- bounded fills -------------------------------------------------------------------------

TWO = f"""{sql.cells(sql.L)}, {sql.totals(sql.L)},
split AS (SELECT c1, c2 FROM tot WHERE level = 3 AND cnt * 64 > (SELECT count(*) FROM lineitem)),
two_raw AS (SELECT 3 AS level, CAST(x.range AS BIGINT) AS c1, CAST(y.range AS BIGINT) AS c2 FROM range(8) x, range(8) y WHERE (x.range, y.range) NOT IN (SELECT (c1, c2) FROM split)
  UNION ALL SELECT 4, c1 * 2 + a, c2 * 2 + b FROM split, {sql.KIDS}), {sql.numbered('two_raw', 'two')}, {sql.values('two')}"""
MINMOD = "CASE WHEN least({0}) > 0 THEN least({0}) WHEN greatest({0}) < 0 THEN greatest({0}) ELSE 0 END"


def slope(lo: str, hi: str) -> str:
    return MINMOD.format(f"2 * (u - {lo}), 2 * ({hi} - u), ({hi} - {lo}) / 2")


LIMITED = Layout(cellcentered(2), (1, 1))


@query(f"""WITH {TWO},
coarse AS (SELECT x1, x2, v1 AS u FROM val WHERE level = 3 UNION ALL SELECT x1 >> 1, x2 >> 1, sum(v1) / 4 FROM val WHERE level = 4 GROUP BY ALL),
around AS (SELECT a.x1, a.x2, a.u, l.u AS l1, r.u AS h1, d.u AS l2, t.u AS h2 FROM coarse a
  JOIN coarse l ON l.x1 = (a.x1 + 31) % 32 AND l.x2 = a.x2 JOIN coarse r ON r.x1 = (a.x1 + 1) % 32 AND r.x2 = a.x2
  JOIN coarse d ON d.x1 = a.x1 AND d.x2 = (a.x2 + 31) % 32 JOIN coarse t ON t.x1 = a.x1 AND t.x2 = (a.x2 + 1) % 32),
sloped AS (SELECT *, {slope("l1", "h1")} AS s1, {slope("l2", "h2")} AS s2, greatest(u, l1, h1, l2, h2) - u AS up, u - least(u, l1, h1, l2, h2) AS down FROM around),
child AS (SELECT x1 * 2 + a AS x1, x2 * 2 + b AS x2,
    u + CASE WHEN (abs(s1) + abs(s2)) / 4 > least(up, down) THEN least(up, down) / ((abs(s1) + abs(s2)) / 4) ELSE 1.0 END * (s1 * (2 * a - 1) + s2 * (2 * b - 1)) / 4 AS v1 FROM sloped, {sql.KIDS}),
g AS (SELECT leaf, level, CAST(i.range AS INTEGER) AS i1, CAST(j.range AS INTEGER) AS i2,
    (c1 * 4 + i.range - 2 + (4 << level)) % (4 << level) AS x1, (c2 * 4 + j.range - 2 + (4 << level)) % (4 << level) AS x2 FROM two, range(1, 7) i, range(1, 7) j)
SELECT g.leaf, g.i1, g.i2, round(coalesce(s.v1, CASE g.level WHEN 3 THEN c.u ELSE k.v1 END), 6) AS v1 FROM g
LEFT JOIN val s ON s.level = g.level AND s.x1 = g.x1 AND s.x2 = g.x2
LEFT JOIN coarse c ON g.level = 3 AND c.x1 = g.x1 AND c.x2 = g.x2 LEFT JOIN child k ON g.level = 4 AND k.x1 = g.x1 AND k.x2 = g.x2""")
def x04_w20_fill_bounded(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ghosts of a two-level periodic mesh by limited slopes of the coarse cells, and averages of fine ones."""
    leaves = meshes.two_levels(spark, sf_dir)
    points = meshes.points2d(spark, sf_dir, leaves, PERIODIC2).withColumns({"i1": F.col("i1") + 1, "i2": F.col("i2") + 1})
    full = exchange.fill_ghosts(points, leaves, PERIODIC2, LIMITED, Operators("conservative", 3, 2, bounded=True))
    return full.withColumn("v1", F.round("v1", 6))


# -- walls and hooks ------------------------------------------------------------------------

MIRRORED = MeshSpec(roots=(1, 1), cells=8, reflecting=frozenset({(0, 0), (0, 1)}), periodic=(False, True))
EVEN_ODD = Layout(("vertex", "cell"), (1, 2), ("v1", "v2"), walls="symmetric", parity={"v2": {0: -1}})


@query(f"""{BAL}, own AS (SELECT leaf, c1, level, CAST(i.range AS INTEGER) AS i1, CAST(j.range AS INTEGER) AS i2, CAST((leaf * 7 + i.range * 5 + j.range * 3) % 31 AS DOUBLE) AS v FROM bal, range(2, 10) i, range(3, 11) j),
ed AS (SELECT leaf, i2, c1, level, max(v) FILTER (i1 = 3) AS a, max(v) FILTER (i1 = 4) AS b, max(v) FILTER (i1 = 9) AS y, max(v) FILTER (i1 = 8) AS z FROM own GROUP BY ALL)
SELECT leaf, 1 AS i1, i2, round(a, 7) AS v1, round(-a, 7) AS v2 FROM ed WHERE c1 = 0 UNION ALL SELECT leaf, 2, i2, round((4 * a - b) / 3, 7), 0.0 FROM ed WHERE c1 = 0
UNION ALL SELECT leaf, 10, i2, round((4 * y - z) / 3, 7), 0.0 FROM ed WHERE c1 = (1 << level) - 1 UNION ALL SELECT leaf, 11, i2, round(y, 7), round(-y, 7) FROM ed WHERE c1 = (1 << level) - 1""")
def x15_w15_symmetric_walls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vertex planes on both reflecting walls, derived from the rows beside them times (1 + parity) / 2, and the ghosts beyond."""
    balanced = meshes.balanced2d(spark, sf_dir)
    leaves = balanced.withColumn("_", F.lit(0)).drop("_")
    value = ((F.col("leaf") * 7 + F.col("i1") * 5 + F.col("i2") * 3) % 31).cast("double")
    points = fields.grid(leaves, EVEN_ODD.owned(8)).withColumns({"v1": value, "v2": value})
    full = exchange.fill_ghosts(points, leaves, MIRRORED, EVEN_ODD, POINT4).join(leaves.select("leaf", "level", "c1"), "leaf")
    low, high = (F.col("c1") == 0) & F.col("i1").isin(1, 2), (F.col("c1") == F.pow(F.lit(2), F.col("level")) - 1) & F.col("i1").isin(10, 11)
    rows = full.where((low | high) & F.col("i2").between(3, 10))
    return rows.select("leaf", "i1", "i2", F.round("v1", 7).alias("v1"), (F.round("v2", 7) + 0.0).alias("v2"))


OUTER = f"""{BAL}, reg AS (SELECT leaf, level, c1, c2, d1, d2 FROM bal, {sql.DIRS}
  WHERE (d1 = -1 AND c1 = 0) OR (d1 = 1 AND c1 = (1 << level) - 1) OR (d2 = -1 AND c2 = 0) OR (d2 = 1 AND c2 = (1 << level) - 1)),
gh AS (SELECT *, CAST(i.range AS INTEGER) AS i1, CAST(j.range AS INTEGER) AS i2, (c1 + (i.range - 1.5) / 8.0) / power(2, level) AS x, (c2 + (j.range - 1.5) / 8.0) / power(2, level) AS y FROM reg, range(1, 11) i, range(1, 11) j
  WHERE CASE d1 WHEN -1 THEN i.range = 1 WHEN 1 THEN i.range = 10 ELSE i.range BETWEEN 2 AND 9 END AND CASE d2 WHEN -1 THEN j.range = 1 WHEN 1 THEN j.range = 10 ELSE j.range BETWEEN 2 AND 9 END)"""
ONE = Layout(cellcentered(2), (1, 1))


def outer_ghosts(spark: SparkSession, sf_dir: str, **hooks) -> DataFrame:
    leaves = meshes.balanced2d(spark, sf_dir)
    points = fields.fill_by_coordinates(leaves, UNIT8, ONE, {"v1": lambda x, y: 1 + x})
    full = exchange.fill_ghosts(points, leaves, UNIT8, ONE, Operators("point", 2, 2), **hooks)
    at = geometry.positions(full, leaves, UNIT8, ONE)
    return at.where("x1 < 0 OR x1 > 1 OR x2 < 0 OR x2 > 1").select("leaf", "i1", "i2", F.round("v1", 7).alias("v1"))


@query(f"{OUTER} SELECT leaf, i1, i2, round(x + y + 10 * d1 + 100 * d2, 7) AS v1 FROM gh")
def x09_directed_hook(spark: SparkSession, sf_dir: str) -> DataFrame:
    return outer_ghosts(spark, sf_dir, boundary={"v1": exchange.Directed(lambda x, y, d1, d2: x + y + 10 * d1 + 100 * d2)})


def doubled(region: pd.DataFrame) -> pd.DataFrame:
    return region.assign(v1=region.x1 * 2 + region.d2)


@query(f"{OUTER} SELECT leaf, i1, i2, round(2 * x + d2, 7) AS v1 FROM gh")
def x08_j03_region_hook(spark: SparkSession, sf_dir: str) -> DataFrame:
    return outer_ghosts(spark, sf_dir, region_hook=doubled)


@query(f"""{OUTER} SELECT leaf, i1, i2, round(x * x + (1 + r) - r * r, 7) AS v1 FROM (SELECT *, (c1 + (least(greatest(i1, 2), 9) - 1.5) / 8.0) / power(2, level) AS r FROM gh)""")
def x10_relative_hook(spark: SparkSession, sf_dir: str) -> DataFrame:
    return outer_ghosts(spark, sf_dir, boundary={"v1": exchange.Relative(lambda x, y: x * x)})


# -- elements -----------------------------------------------------------------------------

ELEMENTS = Layout(spec.elementcentered(2), (1, 1), order=1)


@query(f"""{BAL}, nd AS (SELECT leaf, level, c1 * 4 + i.range AS x, c2 * 4 + j.range AS y, CAST((leaf * 11 + i.range * 5 + j.range * 3) % 17 AS DOUBLE) AS v FROM bal, range(4) i, range(4) j),
want AS (SELECT leaf, level, CAST(CASE side WHEN 0 THEN 1 ELSE 6 END AS INTEGER) AS f, CAST(k.range + 2 AS INTEGER) AS t, ax,
    CASE ax WHEN 1 THEN c1 ELSE c2 END * 4 + CASE side WHEN 0 THEN -1 ELSE 4 END AS nx, CASE ax WHEN 1 THEN c2 ELSE c1 END * 4 + k.range AS ty
  FROM bal, (SELECT unnest([1, 2]) AS ax), (SELECT unnest([0, 1]) AS side), range(4) k),
turn AS (SELECT 1 AS ax, level, x AS n, y AS t, v FROM nd UNION ALL SELECT 2, level, y, x, v FROM nd),
same AS (SELECT w.*, v FROM want w JOIN turn s ON s.ax = w.ax AND s.level = w.level AND s.n = w.nx AND s.t = w.ty),
up(a, b, w) AS (VALUES (0, 0, 1.0), (1, 0, 0.5), (1, 1, 0.5), (2, 0, 0.5), (2, 1, 0.5), (3, 1, 1.0)),
par AS (SELECT w.leaf, w.ax, w.f, w.t, sum(u.w * s.v) AS v FROM want w JOIN up u ON u.a = w.ty % 4 JOIN turn s ON s.ax = w.ax AND s.level = w.level - 1
    AND s.n = CASE w.f WHEN 6 THEN (w.nx // 4 // 2) * 4 ELSE (w.nx // 4 // 2) * 4 + 3 END AND s.t = (w.ty // 4) * 2 + u.b
    WHERE CASE w.f WHEN 6 THEN (w.nx // 4) % 2 = 0 ELSE w.nx >= 0 AND (w.nx // 4) % 2 = 1 END GROUP BY ALL),
down(a, f, w) AS (VALUES (0, 0, 0.5), (0, 1, 0.25), (0, 2, 0.25), (1, 1, 0.25), (1, 2, 0.25), (1, 3, 0.5)),
kid AS (SELECT w.leaf, w.ax, w.f, w.t, sum(r.w * s.v) AS v FROM want w JOIN down r ON r.a = w.ty % 2 JOIN turn s ON s.ax = w.ax AND s.level = w.level + 1
    AND s.n = CASE w.f WHEN 6 THEN (w.nx // 4) * 8 ELSE (w.nx // 4) * 8 + 7 END AND s.t = (w.ty // 2) * 4 + r.f WHERE w.nx >= 0 GROUP BY ALL),
ghost AS (SELECT leaf, ax, f, t, v FROM same UNION ALL SELECT * FROM par UNION ALL SELECT * FROM kid)
SELECT leaf, CAST(x - (SELECT min(x) FROM nd b WHERE b.leaf = nd.leaf) + 2 AS INTEGER) AS i1, CAST(y - (SELECT min(y) FROM nd b WHERE b.leaf = nd.leaf) + 2 AS INTEGER) AS i2, v AS v1 FROM nd
UNION ALL SELECT leaf, CASE ax WHEN 1 THEN f ELSE t END, CASE ax WHEN 1 THEN t ELSE f END, v FROM ghost""")
def x16_w16_element_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Face ghosts of linear elements: the face node copied, parents interpolated and children restricted along the face."""
    leaves = meshes.balanced2d(spark, sf_dir)
    value = ((F.col("leaf") * 11 + (F.col("i1") - 2) * 5 + (F.col("i2") - 2) * 3) % 17).cast("double")
    points = fields.grid(leaves, ELEMENTS.owned(4)).withColumn("v1", value)
    return exchange.fill_ghosts(points, leaves, meshes.UNIT2, ELEMENTS, Operators("element"))


def bilinear(x, y):
    return 1 + x + 2 * x * y


@query(f"""{BAL}, split AS (SELECT level, c1, c2 FROM bal WHERE leaf % 5 = 0 AND level < {LEVELS}),
par AS (SELECT level - 1 AS level, c1 >> 1 AS c1, c2 >> 1 AS c2 FROM bal WHERE level = {LEVELS} GROUP BY ALL HAVING count(*) = 4),
changed AS (SELECT level, c1, c2 FROM bal ANTI JOIN split USING (level, c1, c2) WHERE (level - 1, c1 >> 1, c2 >> 1) NOT IN (SELECT (level, c1, c2) FROM par)
  UNION ALL SELECT level + 1, c1 * 2 + a, c2 * 2 + b FROM split, {sql.KIDS} UNION ALL SELECT * FROM par), {sql.balanced('changed', 'fresh')}
SELECT leaf, CAST(i AS INTEGER) AS i1, CAST(j AS INTEGER) AS i2, round(1 + x + 2 * x * y, 7) AS v1 FROM (
  SELECT leaf, i.range AS i, j.range AS j, (c1 + ((i.range - 2) // 2 + (i.range - 2) % 2) / 2) / power(2, level) AS x, (c2 + ((j.range - 2) // 2 + (j.range - 2) % 2) / 2) / power(2, level) AS y
  FROM fresh, range(2, 6) i, range(2, 6) j)""")
def r08_w16_element_regrid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Linear elements moved to a mesh that is refined and coarsened: interpolated and projected, both exact for bilinear data."""
    old = meshes.balanced2d(spark, sf_dir)
    placed = element_ops.positions(fields.grid(old, ELEMENTS.owned(4)), old, meshes.UNIT2, ELEMENTS)
    points = placed.select("leaf", "i1", "i2", bilinear(F.col("x1"), F.col("x2")).alias("v1"))
    flag = F.when(F.col("level") == LEVELS, regrid.COARSEN).when(F.col("leaf") % 5 == 0, regrid.REFINE).otherwise(regrid.KEEP)
    begun = forest.Forest(old, meshes.UNIT2, LEVELS)
    _, moved, _ = forest.regrid_sets(begun, {"e": forest.FieldSet(points, ELEMENTS, Operators("element"))}, regrid.flag_blocks(old, flag))
    return moved["e"].points.select("leaf", "i1", "i2", F.round("v1", 7).alias("v1"))


# -- regrids of several sets ---------------------------------------------------------------------


@query(f"""WITH RECURSIVE {sql.GRADED}, {sql.balanced('leaf', 'bal')}, {sql.values('bal')},
split AS (SELECT level, c1, c2 FROM bal WHERE leaf % 7 = 0 AND level < {LEVELS}),
changed AS (SELECT level, c1, c2 FROM bal ANTI JOIN split USING (level, c1, c2) UNION ALL SELECT level + 1, c1 * 2 + a, c2 * 2 + b FROM split, {sql.KIDS}), {sql.balanced('changed', 'fresh')},
g AS (SELECT leaf, level, CAST(i.range AS INTEGER) AS i1, CAST(j.range AS INTEGER) AS i2, c1 * 4 + i.range - 1 AS x1, c2 * 4 + j.range - 1 AS x2 FROM fresh, range(1, 5) i, range(1, 5) j)
SELECT g.leaf, g.i1, g.i2, coalesce(s.v1, c.v1) AS v1, round(1 + (g.x1 + 0.5) / (4 << g.level), 7) AS w1, 0.0::DOUBLE AS z1, CAST(1 AS INTEGER) AS generation FROM g
LEFT JOIN val s ON s.level = g.level AND s.x1 = g.x1 AND s.x2 = g.x2 LEFT JOIN val c ON c.level = g.level - 1 AND c.x1 = g.x1 >> 1 AND c.x2 = g.x2 >> 1""")
def r08_l15_regrid_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three sets in one regrid: averages, point values of order 2 whose ghosts are filled first, and one that is only resized."""
    old = meshes.balanced2d(spark, sf_dir)
    bare, halo = Layout(cellcentered(2), (0, 0)), Layout(cellcentered(2), (1, 1))
    line = lambda x, y: 1 + x
    sets = {
        "v": forest.FieldSet(meshes.points2d(spark, sf_dir, old), bare, Operators("conservative", 1, 2)),
        "w": forest.FieldSet(fields.fill_by_coordinates(old, meshes.UNIT2, halo, {"v1": line}), halo, Operators("point", 2, 2), {"v1": line}),
        "z": forest.FieldSet(meshes.points2d(spark, sf_dir, old), bare),
    }
    flag = F.when((F.col("leaf") % 7 == 0) & (F.col("level") < LEVELS), regrid.REFINE).otherwise(regrid.KEEP)
    after, moved, _ = forest.regrid_sets(forest.Forest(old, meshes.UNIT2, LEVELS), sets, regrid.flag_blocks(old, flag))
    v, z = (moved[k].points.select("leaf", "i1", "i2", F.col("v1").alias(f"{k}1")) for k in "vz")
    w = moved["w"].points.select("leaf", (F.col("i1") - 1).alias("i1"), (F.col("i2") - 1).alias("i2"), F.round("v1", 7).alias("w1"))
    return v.join(w, ["leaf", "i1", "i2"]).join(z, ["leaf", "i1", "i2"]).withColumn("generation", F.lit(after.mesh.generation))


@query(f"""WITH {sql.GRADED}, n AS (SELECT count(*) AS n FROM leaf), part AS (SELECT leaf, CAST(CASE WHEN leaf - 1 < (n // 5 + 1) * (n % 5) THEN (leaf - 1) // (n // 5 + 1) ELSE n % 5 + (leaf - 1 - (n // 5 + 1) * (n % 5)) // (n // 5) END AS INTEGER) AS part FROM leaf, n),
{touching('leaf', False)} SELECT DISTINCT p.part, q.part AS other, near.leaf, near.neighbour FROM near JOIN part p USING (leaf) JOIN part q ON q.leaf = near.neighbour WHERE p.part <> q.part""")
def l29_remote_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tree.remote_neighbours(meshes.leaves2d(spark, sf_dir), meshes.UNIT2, 5)


@query(f"WITH {sql.GRADED} SELECT (SELECT count(*) FROM leaf) AS n_blocks, root, level, c1, c2 FROM leaf WHERE leaf = 7")
def f04_block_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fields.block_key(meshes.leaves2d(spark, sf_dir), 2, 7)


GROWN = 8


@query(f"""WITH RECURSIVE {sql.cells(GROWN)}, {sql.totals(GROWN)}, big AS (SELECT level, c1, c2 FROM tot WHERE cnt > 48 AND level < {GROWN}),
{sql.from_inner('big', 'raw')}, need AS (SELECT level, c1, c2 FROM raw
  UNION SELECT level - 1, CAST((n.c1 >> 1) + x AS BIGINT), CAST((n.c2 >> 1) + y AS BIGINT) FROM need n, (SELECT CAST(p.range - 1 AS INTEGER) AS x, CAST(q.range - 1 AS INTEGER) AS y FROM range(3) p, range(3) q)
  WHERE level > 0 AND (n.c1 >> 1) + x BETWEEN 0 AND (1 << (level - 1)) - 1 AND (n.c2 >> 1) + y BETWEEN 0 AND (1 << (level - 1)) - 1),
kin AS (SELECT DISTINCT level - 1 AS level, c1 >> 1 AS c1, c2 >> 1 AS c2 FROM need WHERE level > 0), {sql.from_inner('kin', 'done')}
SELECT level, count(*) AS n, sum(c1 * 7 + c2 * 3) AS places FROM done GROUP BY level""")
def l27_growing_mesh(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A mesh that grows with the table: nodes of over 48 line items split, eight levels at most, balanced; counted by level."""
    totals = tree.occupied(meshes.cells2d(spark, sf_dir, GROWN), 2, GROWN, "cnt")
    leaves = tree.thresholded(cut(totals), F.col("cnt") > 48, 2, GROWN, tree.roots(spark, meshes.UNIT2))
    return tree.balance(cut(leaves), meshes.UNIT2, GROWN).groupBy("level").agg(F.count("*").alias("n"), F.sum(F.col("c1") * 7 + F.col("c2") * 3).alias("places"))


# -- glued forests --------------------------------------------------------------------------

PAIR = PatchMesh(((1, 1), (1, 1)), both_ways(Glue(0, 0, 1, 1, 0, 0, (0, 1), (False, False))))


@query(f"""WITH RECURSIVE {sql.GRADED}, start AS (SELECT level, c1 AS x, c2 AS y FROM leaf UNION ALL SELECT 0, 1, 0),
need AS (SELECT CAST(level AS INTEGER) AS level, CAST(x AS BIGINT) AS x, CAST(y AS BIGINT) AS y FROM start
  UNION SELECT CASE k WHEN 0 THEN level - 1 ELSE level END, CASE k WHEN 0 THEN (x >> 1) + a ELSE (2 << level) - 1 - ((x >> 1) * 2 + a) END, CASE k WHEN 0 THEN (y >> 1) + b ELSE (y >> 1) * 2 + b END
  FROM need, (SELECT 0 AS k, x.range - 1 AS a, y.range - 1 AS b FROM range(3) x, range(3) y UNION ALL SELECT 1, x.range, y.range FROM range(2) x, range(2) y)
  WHERE level > 0 AND CASE k WHEN 0 THEN (x >> 1) + a BETWEEN 0 AND (1 << level) - 1 AND (y >> 1) + b BETWEEN 0 AND (1 << (level - 1)) - 1 ELSE (x >> 1) * 2 + a IN ((1 << level) - 1, 1 << level) END),
kin AS (SELECT DISTINCT level - 1 AS level, x >> 1 AS x, y >> 1 AS y FROM need WHERE level > 0),
every AS (SELECT 0 AS level, range AS x, 0 AS y FROM range(2) UNION ALL SELECT level + 1, x * 2 + a, y * 2 + b FROM kin, {sql.KIDS})
SELECT CAST(x >> level AS INTEGER) AS root, level, CAST(x % (1 << level) AS BIGINT) AS c1, CAST(y AS BIGINT) AS c2 FROM every ANTI JOIN kin USING (level, x, y)""")
def l27_x14_glued_balance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The graded mesh beside an unrefined patch: touching leaves differ by a level at most, and by none across the glue."""
    graded = meshes.leaves2d(spark, sf_dir).select("root", "level", "c1", "c2")
    other = patched.roots(spark, PAIR).where("root = 1")
    return patched.balance(graded.unionByName(other), PAIR, LEVELS)


# -- charts and plans ----------------------------------------------------------------------


@query(f"""WITH {sql.GRADED}, pt AS (SELECT range AS pid, (range % 30 + 0.35) / 25 AS x, (range // 30 + 0.35) / 25 AS y FROM range(900)),
lg AS (SELECT pid, sqrt(x * x + y * y) AS r, atan2(y, x) AS t FROM pt)
SELECT pid, leaf FROM lg LEFT JOIN leaf ON r <= 1 AND t <= 1 AND floor(r * (1 << level)) = c1 AND floor(t * (1 << level)) = c2""")
def p12_p04_chart_locate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Points of the plane through polar coordinates to leaves of the unit square; those outside it have none."""
    leaves = meshes.leaves2d(spark, sf_dir)
    plane = locate.affine_grid(spark, (0.35 / 25, 0.35 / 25), ((0.04, 0.0), (0.0, 0.04)), (30, 30))
    logical = atlas.chart_locate(plane, atlas.from_plane, meshes.UNIT2)
    return locate.locate(logical, leaves, meshes.UNIT2, LEVELS).select("pid", "leaf")


@query(f"{BAL} {sampled(CELLS, '2 + x').replace('SELECT leaf', 'SELECT 1 AS turn, leaf', 1)} UNION ALL {sampled(CELLS, '3 - y').replace('SELECT leaf', 'SELECT 2 AS turn, leaf', 1)}")
def j05_plan_of_two_fills(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One plan, two fields."""
    leaves, out = meshes.balanced2d(spark, sf_dir), []
    made = exchange.plan_ghosts(leaves, UNIT8, CELLS, POINT4)
    for turn, f in enumerate((lambda x, y: 2 + x, lambda x, y: 3 - y), 1):
        points = fields.fill_by_coordinates(leaves, UNIT8, CELLS, {"v1": f})
        full = exchange.fill_ghosts(points, leaves, UNIT8, CELLS, POINT4, {"v1": f}, made=made)
        out.append(full.select(F.lit(turn).alias("turn"), "leaf", "i1", "i2", F.round("v1", 7).alias("v1")))
    return out[0].unionByName(out[1])


# -- grids, regions, refusals, weights --------------------------------------------------------


@query("SELECT range AS pid, round(0.125::DOUBLE + (range % 40) * 0.01 + (range // 40) * 0.004, 9) AS x1, round(0.5::DOUBLE - (range % 40) * 0.0025 + (range // 40) * 0.016, 9) AS x2 FROM range(1000)")
def p15_affine_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    grid = locate.affine_grid(spark, (0.125, 0.5), ((0.01, -0.0025), (0.004, 0.016)), (40, 25))
    return grid.withColumns({"x1": F.round("x1", 9), "x2": F.round("x2", 9)})


@query("SELECT range AS pid, 3 AS patch, round((range % 5) * 0.25::DOUBLE, 9) AS x1, round(1 + (range // 5) * 0.5::DOUBLE, 9) AS x2 FROM range(15)")
def p15_box_grid_of_patch(spark: SparkSession, sf_dir: str) -> DataFrame:
    grid = locate.patch_grid(locate.box_grid(spark, (0.0, 1.0), (1.0, 2.0), (5, 3)), 3)
    return grid.withColumns({"x1": F.round("x1", 9), "x2": F.round("x2", 9)})


@query(f"""WITH {sql.GRADED}, pt AS (SELECT range AS pid, (range % 20 + 0.5) / 20 AS x1, (range // 20 + 0.5) / 20 AS x2 FROM range(400)),
hit AS (SELECT pid, x1, x2, level, c1, c2 FROM pt JOIN leaf ON floor(x1 * (1 << level)) = c1 AND floor(x2 * (1 << level)) = c2),
s AS (SELECT *, least(greatest(floor((x1 - c1 / power(2, level)) * 8 * power(2, level) + 0.5), 1), 7) AS a, least(greatest(floor((x2 - c2 / power(2, level)) * 8 * power(2, level) + 0.5), 1), 7) AS b FROM hit),
p AS (SELECT pid, x1, x2, (c1 + (a + k.range - 0.5) / 8) / power(2, level) AS r, (c2 + (b + l.range - 0.5) / 8) / power(2, level) AS t FROM s, range(2) k, range(2) l)
SELECT pid, round(1 + x1 + 2 * x2, 7) AS v1, bool_or(power(r * cos(t) - 0.4, 2) + power(r * sin(t) - 0.3, 2) < 0.04) AS excluded FROM p GROUP BY pid, x1, x2""")
def p14_mapped_region(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A disc of the plane, seen through polar coordinates, flags values whose stencil holds a point of it."""
    layout = Layout(cellcentered(2), (0, 0))
    leaves = meshes.leaves2d(spark, sf_dir)
    points = fields.fill_by_coordinates(leaves, UNIT8, layout, {"v1": lambda x, y: 1 + x + 2 * y})
    located = locate.locate(locate.uniform_grid(spark, UNIT8, (20, 20)), leaves, UNIT8, LEVELS)
    region = atlas.mapped(locate.ellipsoid((0.4, 0.3), (0.2, 0.2)), atlas.Polar())
    out = locate.interpolate(located, points, leaves, UNIT8, layout, 2, [(0, 0)], region)
    return out.select("pid", F.round("v1", 7).alias("v1"), "excluded")


@query("""SELECT o, p, t, s, round(w, 9) AS w FROM (SELECT o, p, t, s, product((pos - j) / (k - j)) AS w FROM (
  SELECT o, p, CAST(t AS INTEGER) AS t, CAST(low + k AS INTEGER) AS s, k, 2 * (t - 3) - 8 * o + 3 + 0.5 - low AS pos FROM (SELECT o, p, t, least(greatest(2 * (t - 3) - 8 * o + 3 - p // 2 + 1, 3), 11 - p) AS low
    FROM (SELECT unnest([0, 1]) AS o), (SELECT unnest([2, 4]) AS p), (SELECT range AS t FROM range(3, 11)) WHERE t BETWEEN 3 + 4 * o AND 6 + 4 * o), (SELECT range AS k FROM range(4)) WHERE k < p),
  (SELECT range AS j FROM range(4)) WHERE j < p AND j <> k GROUP BY ALL)""")
def w07_restriction_taps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Eight cells and two ghosts, orders 2 and 4, for both child offsets: windows stay in the fine interior."""
    rows = [(o, p, t, s, round(float(w), 9)) for o in (0, 1) for p in (2, 4) for t, row in weights.restrict(8, 2, 0, 0, o, p).items() for s, w in row]
    return spark.createDataFrame(rows, "o int, p int, t int, s int, w double")


@query("""SELECT c, o, p, t, s, round(w, 9) AS w FROM (SELECT c, o, p, t, s, product((pos - j) / (k - j)) AS w FROM (
  SELECT c, o, p, CAST(t AS INTEGER) AS t, CAST(low + k AS INTEGER) AS s, k, place - low AS pos FROM (SELECT *, least(greatest(floor(place) - p // 2 + 1, 1), 13 + c - p) AS low FROM (
    SELECT c, o, p, t, 3 + (8 * o + t - 3) / 2 - (1 - c) / 4 AS place FROM (SELECT unnest([0, 1]) AS c), (SELECT unnest([0, 1]) AS o), (SELECT unnest([2, 4]) AS p), (SELECT range AS t FROM range(3, 11)))), (SELECT range AS k FROM range(4)) WHERE k < p),
  (SELECT range AS j FROM range(4)) WHERE j < p AND j <> k GROUP BY ALL) WHERE abs(w) > 1e-12""")
def w08_w09_prolongation_taps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Eight points and two ghosts, cells and vertices, orders 2 and 4, for both child offsets."""
    rows = [
        (c, o, p, t, s, round(float(w), 9)) for c in (0, 1) for o in (0, 1) for p in (2, 4) for t, row in weights.prolong(8, 2, c, 0, o, p, False).items() for s, w in row if w
    ]
    return spark.createDataFrame(rows, "c int, o int, p int, t int, s int, w double")


@query("""SELECT p, side, away, round(w, 9) AS w FROM (VALUES (4, 0, 2, -1.0 / 3), (4, 0, 1, 4.0 / 3), (4, 1, 2, -1.0 / 3), (4, 1, 1, 4.0 / 3), (6, 0, 1, 1.5), (6, 0, 2, -0.6), (6, 0, 3, 0.1), (6, 1, 1, 1.5), (6, 1, 2, -0.6), (6, 1, 3, 0.1)) v(p, side, away, w)""")
def w15_wall_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A vertex plane on a wall from the rows beside it."""
    rows = [(p, side, abs(s - (11 if side else 3)), round(float(w), 9)) for p in (4, 6) for side in (0, 1) for s, w in weights.wall_plane(8, 2, p, side)]
    return spark.createDataFrame(rows, "p int, side int, away int, w double")


#: Cases that are refused when they are made, and like ones that are not.
CASES = {
    "mesh of four dimensions": (lambda: MeshSpec(roots=(1, 1, 1, 1)), True),
    "odd cells": (lambda: MeshSpec(roots=(1,), cells=3), True),
    "even cells": (lambda: MeshSpec(roots=(1,), cells=6), False),
    "reflecting face of a periodic dimension": (lambda: MeshSpec(roots=(1,), periodic=(True,), reflecting=frozenset({(0, 0)})), True),
    "roots that are no cubes": (lambda: MeshSpec(roots=(1, 1), extents=((0.0, 1.0), (0.0, 2.0))), True),
    "two seams": (lambda: MeshSpec(roots=(2, 2), rotating=(0, 1), halfturn=(0, 1)), True),
    "quarter turn of unequal roots": (lambda: MeshSpec(roots=(2, 3), rotating=(0, 1)), True),
    "half turn of odd roots across": (lambda: MeshSpec(roots=(2, 3), halfturn=(0, 1)), True),
    "half turn as glue": (lambda: of_brick(MeshSpec(roots=(2, 4), halfturn=(0, 1))), False),
    "steps across a seam in a brick": (lambda: MeshSpec(roots=(2, 2), rotating=(0, 1)).without_seam(), True),
    "elements and cells in one set": (lambda: Layout(("element", "cell"), (1, 1), order=1), True),
    "elements with two ghosts": (lambda: Layout(("element",), (2,), order=1), True),
    "ghosts wider than half a block": (lambda: Layout(("cell",), (3,)).check(4), True),
    "point values of odd order": (lambda: Operators("point", 3, 2), True),
    "conservative of even order": (lambda: Operators("conservative", 2, 2), True),
    "bounded conservative of order 5": (lambda: Operators("conservative", 5, 2, bounded=True), True),
    "bounded conservative of order 3": (lambda: Operators("conservative", 3, 2, bounded=True), False),
    "element family with an order": (lambda: Operators("element", 2), True),
    "vertex order of point values": (lambda: Operators("point", 2, 2, vertex_prolongation=2), True),
    "odd vertex order": (lambda: Operators("conservative", 3, 2, vertex_prolongation=3), True),
    "conservative vertices without a vertex order": (lambda: Operators("conservative", 3, 2).check(VERTICES, 8), True),
    "conservative vertices": (lambda: Operators("conservative", 3, 2, vertex_prolongation=4).check(VERTICES, 8), False),
    "too few ghosts": (lambda: Operators("point", 4, 4).check(ONE, 8), True),
    "cells by the element family": (lambda: Operators("element").check(ONE, 8), True),
    "elements that do not fill a block": (lambda: Operators("element").check(Layout(("element",), (1,), order=2), 4), True),
    "a stencil that extrapolates": (lambda: weights.window(4, weights.Fraction(1, 2), 1, 8), True),
    "a stencil at the end": (lambda: weights.window(4, weights.Fraction(3, 2), 1, 8), False),
    "glue in one direction": (lambda: PatchMesh(((1, 1), (1, 1)), PAIR.glue[:1]), True),
    "glue that does not turn inward": (lambda: both_and(Glue(0, 0, 1, 1, 0, 1, (0, 1), (False, False))), True),
    "derivatives of order three": (lambda: locate.multi_indices(2, 3), True),
    "derivatives of order two": (lambda: locate.multi_indices(2, 2), False),
}


def both_and(g: Glue) -> PatchMesh:
    return PatchMesh(((1, 1), (1, 1)), both_ways(g))


def is_refused(make) -> bool:
    try:
        make()
    except ValueError:
        return True
    return False


@query("SELECT * FROM (VALUES " + ", ".join(f"('{name}', {str(no).upper()})" for name, (_, no) in CASES.items()) + ") v(what, refused)")
def l11_l12_w01_w02_w11_refusals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.createDataFrame([(name, is_refused(make)) for name, (make, _) in CASES.items()], "what string, refused boolean")


@query("SELECT k, m1, m2 FROM (VALUES (0, 0, 0), (1, 1, 0), (2, 0, 1), (3, 2, 0), (4, 1, 1), (5, 0, 2)) v(k, m1, m2)")
def p11_multi_indices(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.createDataFrame([(k, *m) for k, m in enumerate(locate.multi_indices(2, 2))], "k int, m1 int, m2 int")
