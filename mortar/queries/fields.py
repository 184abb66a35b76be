"""Field sets, reductions, halo exchange and regridding over the graded mesh of line items."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mortar.functions.lineage import cut
from mortar.operators import bounded, exchange, fields, geometry, interfaces, reduce, regrid
from mortar.operators import leaves as tree
from mortar.plans import transfers
from mortar.plans.spec import Layout, MeshSpec, Operators, cellcentered, facecentered, vertexcentered
from mortar.queries import sql
from mortar.queries.mesh import touching
from mortar.sources import meshes
from mortar.sources.meshes import LEVELS, PERIODIC2, UNIT2

BARE = Layout(cellcentered(2), (0, 0))
HALO = Layout(cellcentered(2), (1, 1))
FLAT = Operators("conservative", 1, 2)
WITH = f"WITH {sql.GRADED}, {sql.values()}"
BALANCED = f"WITH RECURSIVE {sql.GRADED}, {sql.balanced('leaf', 'bal', True)}, {sql.values('bal')}"
QUERIES, ORACLES = {}, {}


def query(oracle: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if oracle:
            ORACLES[f.__name__] = oracle
        return f

    return register


def mesh_and_points(spark: SparkSession, sf_dir: str):
    leaves = meshes.leaves2d(spark, sf_dir)
    return leaves, meshes.points2d(spark, sf_dir, leaves)


def with_ghosts(points: DataFrame, layout: Layout) -> DataFrame:
    """Interior indices to stored ones."""
    return points.withColumns({f"i{d + 1}": F.col(f"i{d + 1}") + g for d, g in enumerate(layout.ghosts)})


@query(f"{WITH} SELECT leaf, i1, i2, v1 FROM val")
def f08_fill_from_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mesh_and_points(spark, sf_dir)[1]


@query(f"""WITH {sql.GRADED} SELECT leaf, CAST(i.range AS INTEGER) AS i1, CAST(j.range AS INTEGER) AS i2, 0.0::DOUBLE AS v1 FROM leaf, range(1, 8) i, range(1, 7) j""")
def f01_f09_allocate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Zeroed storage of one vertex and one cell dimension, ghosts included."""
    return fields.allocate(meshes.leaves2d(spark, sf_dir), UNIT2, Layout(("vertex", "cell"), (1, 1)))


@query(f"""WITH {sql.GRADED} SELECT leaf, CAST(i.range AS INTEGER) AS i1, CAST(j.range AS INTEGER) AS i2 FROM leaf, range(2, 6) i, range(2, 6) j WHERE leaf <= 9""")
def f05_f06_interior(spark: SparkSession, sf_dir: str) -> DataFrame:
    layout = Layout(("vertex", "cell"), (1, 1))
    all_ = fields.grid(meshes.leaves2d(spark, sf_dir).where("leaf <= 9"), layout.stored(4))
    return fields.interior(all_, UNIT2, layout)


@query(f"""WITH {sql.GRADED} SELECT leaf, CAST(i.range AS INTEGER) AS i1, CAST(j.range AS INTEGER) AS i2 FROM leaf, range(2, 7) i, range(2, 6) j WHERE leaf = 3""")
def f05_f07_closed(spark: SparkSession, sf_dir: str) -> DataFrame:
    layout = Layout(("vertex", "cell"), (1, 1))
    return fields.closed(fields.block(fields.grid(meshes.leaves2d(spark, sf_dir), layout.stored(4)), 3), UNIT2, layout)


@query(f"""WITH {sql.GRADED}, x AS (SELECT leaf, i.range AS i1, j.range AS i2, (c1 + (i.range - 1) / 4.0) / power(2, level) AS x1, (c2 + (j.range - 1) / 4.0) / power(2, level) AS x2
FROM leaf, range(1, 5) i, range(1, 5) j) SELECT leaf, CAST(i1 AS INTEGER) AS i1, CAST(i2 AS INTEGER) AS i2, x1 * 3 + x2 AS v1 FROM x""")
def g07_f08_vertex_positions(spark: SparkSession, sf_dir: str) -> DataFrame:
    layout = Layout(vertexcentered(2), (0, 0))
    return fields.fill_by_coordinates(meshes.leaves2d(spark, sf_dir), UNIT2, layout, {"v1": lambda x, y: x * 3 + y})


@query(f"{WITH} SELECT (leaf - 1) * 16 + (i1 - 1) + (i2 - 1) * 4 AS place, v1 FROM val")
def f10_gather(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, points = mesh_and_points(spark, sf_dir)
    return fields.gather(with_ghosts(points, HALO), UNIT2, HALO).select("place", "v1")


@query(f"{WITH} SELECT leaf, i1, i2, v1 * 2 AS v1 FROM val")
def f10_f12_map_and_scatter(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, points = mesh_and_points(spark, sf_dir)
    return fields.scatter(points, fields.map_points(points, {"v1": F.col("v1") * 2}), UNIT2, BARE)


@query(f"WITH {sql.GRADED}, n AS (SELECT count(*) * 16 AS n FROM leaf) SELECT 0 AS set_id, n AS length, CAST(0 AS BIGINT) AS first, n AS last FROM n UNION ALL SELECT 1, 2 * n, n, 3 * n FROM n")
def f11_state_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fields.state_length(meshes.leaves2d(spark, sf_dir), UNIT2, [BARE, Layout(cellcentered(2), (0, 0), ("v1", "v2"))])


@query(f"""{WITH} SELECT a.leaf, a.i1, a.i2, b.v1 - a.v1 AS slope FROM val a LEFT JOIN val b ON b.leaf = a.leaf AND b.i1 = a.i1 + 1 AND b.i2 = a.i2""")
def f12_stencil_kernel(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, points = mesh_and_points(spark, sf_dir)
    return fields.shifted(points, 2, (1, 0), "v1", "up").select("leaf", "i1", "i2", (F.col("up") - F.col("v1")).alias("slope"))


@query(f"{WITH} SELECT leaf, sum(v1) AS total, max(v1) AS high, min(v1) AS low, count(*) FILTER (v1 > 0) AS n_used FROM val GROUP BY leaf")
def a01_a03_block_fold(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, points = mesh_and_points(spark, sf_dir)
    return reduce.block_fold(points, {"total": F.sum("v1"), "high": reduce.largest(F.col("v1")), "low": reduce.smallest(F.col("v1")), "n_used": F.count(F.when(F.col("v1") > 0, 1))})


@query(f"""{WITH} SELECT sum(b.s / power(4, level)) AS value FROM (SELECT leaf, sum(v1) AS s FROM val GROUP BY leaf) b JOIN leaf USING (leaf)""")
def a02_mesh_mapreduce(spark: SparkSession, sf_dir: str) -> DataFrame:
    leaves, points = mesh_and_points(spark, sf_dir)
    return reduce.mesh_mapreduce(points, leaves, F.col("v1"), F.pow(F.lit(4.0), -F.col("level")))


@query(f"""{WITH} SELECT level, sum(v1) AS total, max(v1) AS high, sum(v1) FILTER (i1 = 1) AS bin1, sum(v1) FILTER (i1 = 2) AS bin2, sum(v1) FILTER (i1 = 3) AS bin3 FROM val GROUP BY level""")
def a04_a06_mesh_fold(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sums, maxima and bins by the tag ``level``, in one pass; the slot 4 counts nowhere."""
    leaves, points = mesh_and_points(spark, sf_dir)
    bins = {f"bin{k + 1}": c for k, c in enumerate(reduce.binned(F.col("v1"), F.col("i1"), 3))}
    return reduce.mesh_fold(points.join(leaves.select("leaf", "level"), "leaf"), {"total": F.sum("v1"), "high": reduce.largest(F.col("v1")), **bins}, ["level"])


@query("""SELECT event_type, CASE WHEN bool_or(isnan(w)) THEN 'NaN'::DOUBLE ELSE min(w) END AS low, max(w) AS high
FROM (SELECT event_type, CASE WHEN event_id % 997 = 5 THEN 'NaN'::DOUBLE ELSE value END AS w FROM events) GROUP BY event_type""")
def a05_nan_monoids(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = F.when(F.col("event_id") % 997 == 5, float("nan")).otherwise(F.col("value"))
    rows = meshes.table(spark, sf_dir, "events").select("event_type", x.alias("w"))
    return reduce.mesh_fold(rows, {"low": reduce.smallest(F.col("w")), "high": reduce.largest(F.col("w"))}, ["event_type"])


@query(f"""{WITH} SELECT round(sqrt(sum(v1 * v1 / power(16, level)) / sum(1 / power(16, level))), 6) AS l2, max(abs(v1)) AS linf FROM val""".replace("power(16, level)", "power(4, level)"))
def a07_norms(spark: SparkSession, sf_dir: str) -> DataFrame:
    leaves, points = mesh_and_points(spark, sf_dir)
    at = geometry.positions(points, leaves, UNIT2, BARE)
    return at.agg(F.round(reduce.norm(2, "v1", 2), 6).alias("l2"), reduce.norm(2, "v1", float("inf")).alias("linf"))


@query(f"{WITH} SELECT max(v1 * 4 * power(2, level)) AS speed FROM val")
def a09_cfl(spark: SparkSession, sf_dir: str) -> DataFrame:
    leaves, points = mesh_and_points(spark, sf_dir)
    return geometry.positions(points, leaves, UNIT2, BARE).agg(reduce.largest(F.abs(F.col("v1")) / F.col("h")).alias("speed"))


@query(f"{WITH} SELECT sum(v1 / 16 / power(4, level)) AS mass FROM val")
def r10_total_mass(spark: SparkSession, sf_dir: str) -> DataFrame:
    leaves, points = mesh_and_points(spark, sf_dir)
    return reduce.total_mass(geometry.positions(points, leaves, UNIT2, BARE), 2, "v1")


@query(f"""WITH RECURSIVE {sql.GRADED}, {sql.balanced('leaf', 'bal', True)}, {touching('bal', True)}
SELECT n.leaf AS tgt, n.neighbour AS src, concat(k, ':', d1, ',', d2, ':', o1, ',', o2) AS grp, CAST(CASE k WHEN 'prolong' THEN level ELSE 0 END AS INTEGER) AS stage FROM (
  SELECT n.*, a.level, k, CASE k WHEN 'copy' THEN 0 WHEN 'restrict' THEN b.c1 % 2 ELSE a.c1 % 2 END AS o1, CASE k WHEN 'copy' THEN 0 WHEN 'restrict' THEN b.c2 % 2 ELSE a.c2 % 2 END AS o2
  FROM (SELECT n.*, CASE WHEN n_level = a.level THEN 'copy' WHEN n_level > a.level THEN 'restrict' ELSE 'prolong' END AS k FROM near n JOIN bal a USING (leaf)) n
  JOIN bal a USING (leaf) JOIN bal b ON b.leaf = n.neighbour) n""")
def j01_j06_transfers(spark: SparkSession, sf_dir: str) -> DataFrame:
    plan = transfers.ghost_transfers(meshes.balanced2d(spark, sf_dir, PERIODIC2), PERIODIC2)
    return plan.select("tgt", "src", "grp", F.col("stage").cast("int").alias("stage"))


@query(f"""{BALANCED}, g AS (
  SELECT leaf, level, CAST(i.range AS INTEGER) AS i1, CAST(j.range AS INTEGER) AS i2,
    (c1 * 4 + i.range - 2 + (4 << level)) % (4 << level) AS x1, (c2 * 4 + j.range - 2 + (4 << level)) % (4 << level) AS x2
  FROM bal, range(1, 7) i, range(1, 7) j),
half AS (SELECT level - 1 AS level, x1 >> 1 AS x1, x2 >> 1 AS x2, sum(v1) / 4 AS v1 FROM val GROUP BY ALL)
SELECT g.leaf, g.i1, g.i2, coalesce(s.v1, c.v1, f.v1) AS v1 FROM g
LEFT JOIN val s ON s.level = g.level AND s.x1 = g.x1 AND s.x2 = g.x2
LEFT JOIN val c ON c.level = g.level - 1 AND c.x1 = g.x1 >> 1 AND c.x2 = g.x2 >> 1
LEFT JOIN half f ON f.level = g.level AND f.x1 = g.x1 AND f.x2 = g.x2""")
def x01_x12_fill_ghosts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All ghosts of the balanced periodic mesh: copies, averages of finer cells, values of coarser cells."""
    leaves = meshes.balanced2d(spark, sf_dir, PERIODIC2)
    points = with_ghosts(meshes.points2d(spark, sf_dir, leaves, PERIODIC2), HALO)
    return exchange.fill_ghosts(points, leaves, PERIODIC2, HALO, FLAT)


FIRING = f"""SELECT leaf, CAST(count(*) FILTER (v1 > 200) AS BIGINT) AS n_firing, coalesce(min(i1) FILTER (v1 > 200), 1) AS lo_i1, coalesce(max(i1) FILTER (v1 > 200), 0) AS hi_i1,
coalesce(min(i2) FILTER (v1 > 200), 1) AS lo_i2, coalesce(max(i2) FILTER (v1 > 200), 0) AS hi_i2 FROM val GROUP BY leaf"""


@query(f"{WITH} {FIRING}")
def r02_firing_boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    leaves, points = mesh_and_points(spark, sf_dir)
    return regrid.firing_boxes(points, leaves, F.col("v1") > 200, UNIT2, BARE)


MARKS = f"""CASE WHEN n_firing >= 4 AND level < {LEVELS} THEN 2 WHEN n_firing > 0 THEN 1 ELSE 0 END"""


@query(f"{WITH}, fire AS ({FIRING}) SELECT leaf, {MARKS} AS flag FROM fire JOIN leaf USING (leaf)")
def r01_r03_marks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return marks(*mesh_and_points(spark, sf_dir)).select("leaf", "flag")


def marks(leaves: DataFrame, points: DataFrame) -> DataFrame:
    boxes = regrid.firing_boxes(points, leaves, F.col("v1") > 200, UNIT2, BARE).join(leaves.select("leaf", "level"), "leaf")
    return boxes.withColumn("flag", F.expr(MARKS)).drop("level")


BUFFERED = f"""fire AS ({FIRING}), mark AS (SELECT fire.*, level, {MARKS} AS flag FROM fire JOIN leaf USING (leaf)), {touching('leaf', False)},
want AS (SELECT neighbour AS leaf, max(level + CASE flag WHEN 2 THEN 1 ELSE 0 END) AS wanted FROM near JOIN mark USING (leaf)
  WHERE flag <> 0 AND hi_i1 >= lo_i1 AND CASE d1 WHEN -1 THEN lo_i1 - 2 < 1 WHEN 1 THEN hi_i1 + 2 > 4 ELSE TRUE END AND CASE d2 WHEN -1 THEN lo_i2 - 2 < 1 WHEN 1 THEN hi_i2 + 2 > 4 ELSE TRUE END GROUP BY neighbour),
flags AS (SELECT leaf, CASE WHEN level < wanted THEN 2 WHEN level = wanted AND flag = 0 THEN 1 ELSE flag END AS flag FROM mark LEFT JOIN want USING (leaf))"""


@query(f"{WITH}, {BUFFERED} SELECT leaf, flag FROM flags")
def r04_r06_buffered(spark: SparkSession, sf_dir: str) -> DataFrame:
    leaves, points = mesh_and_points(spark, sf_dir)
    return regrid.buffered(marks(leaves, points), leaves, UNIT2, 2)


COMPLETE = f"""WITH RECURSIVE {sql.GRADED}, {sql.values()}, {BUFFERED},
keyed AS (SELECT leaf.*, flag FROM leaf JOIN flags USING (leaf)),
par AS (SELECT level - 1 AS level, c1 >> 1 AS c1, c2 >> 1 AS c2 FROM keyed WHERE flag = 0 AND level > 0 GROUP BY ALL HAVING count(*) = 4),
changed AS (SELECT k.level, k.c1, k.c2 FROM keyed k WHERE flag <> 2 AND (level - 1, c1 >> 1, c2 >> 1) NOT IN (SELECT (level, c1, c2) FROM par)
  UNION ALL SELECT * FROM par UNION ALL SELECT level + 1, c1 * 2 + a, c2 * 2 + b FROM keyed, {sql.KIDS} WHERE flag = 2), {sql.balanced('changed', 'fresh')}"""


@query(f"{COMPLETE} SELECT root, level, c1, c2 FROM fresh")
def r07_complete_marks(spark: SparkSession, sf_dir: str) -> DataFrame:
    leaves, points = mesh_and_points(spark, sf_dir)
    return regrid.completed(regrid.buffered(marks(leaves, points), leaves, UNIT2, 2), leaves, UNIT2, LEVELS + 1)


REFINED = f"""WITH RECURSIVE {sql.GRADED}, {sql.balanced('leaf', 'bal')}, {sql.values('bal')},
split AS (SELECT level, c1, c2 FROM bal WHERE leaf % 7 = 0 AND level < {LEVELS}),
changed AS (SELECT level, c1, c2 FROM bal ANTI JOIN split USING (level, c1, c2) UNION ALL SELECT level + 1, c1 * 2 + a, c2 * 2 + b FROM split, {sql.KIDS}), {sql.balanced('changed', 'fresh')}"""


@query(f"""{REFINED}, g AS (SELECT leaf, level, CAST(i.range AS INTEGER) AS i1, CAST(j.range AS INTEGER) AS i2, c1 * 4 + i.range - 1 AS x1, c2 * 4 + j.range - 1 AS x2 FROM fresh, range(1, 5) i, range(1, 5) j)
SELECT g.leaf, g.i1, g.i2, coalesce(s.v1, c.v1) AS v1 FROM g LEFT JOIN val s ON s.level = g.level AND s.x1 = g.x1 AND s.x2 = g.x2
LEFT JOIN val c ON c.level = g.level - 1 AND c.x1 = g.x1 >> 1 AND c.x2 = g.x2 >> 1""")
def r08_j10_regrid_refine(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every seventh block refined, the mesh balanced again, and the field moved to it."""
    old = meshes.balanced2d(spark, sf_dir)
    points = meshes.points2d(spark, sf_dir, old)
    split = old.where((F.col("leaf") % 7 == 0) & (F.col("level") < LEVELS))
    new = cut(tree.numbered(tree.balance(tree.refine(old, split, 2), UNIT2, LEVELS), 2, LEVELS))
    return regrid.transfer(points, old, new, UNIT2, BARE, FLAT)


@query(f"""WITH RECURSIVE {sql.GRADED}, {sql.balanced('leaf', 'bal')}, {sql.values('bal')},
par AS (SELECT level - 1 AS level, c1 >> 1 AS c1, c2 >> 1 AS c2 FROM bal WHERE level = {LEVELS} GROUP BY ALL HAVING count(*) = 4),
new_raw AS (SELECT level, c1, c2 FROM bal WHERE (level - 1, c1 >> 1, c2 >> 1) NOT IN (SELECT (level, c1, c2) FROM par) UNION ALL SELECT * FROM par), {sql.numbered('new_raw', 'fresh')},
g AS (SELECT leaf, level, CAST(i.range AS INTEGER) AS i1, CAST(j.range AS INTEGER) AS i2, c1 * 4 + i.range - 1 AS x1, c2 * 4 + j.range - 1 AS x2 FROM fresh, range(1, 5) i, range(1, 5) j),
half AS (SELECT level - 1 AS level, x1 >> 1 AS x1, x2 >> 1 AS x2, sum(v1) / 4 AS v1 FROM val GROUP BY ALL)
SELECT g.leaf, g.i1, g.i2, coalesce(s.v1, f.v1) AS v1 FROM g LEFT JOIN val s ON s.level = g.level AND s.x1 = g.x1 AND s.x2 = g.x2
LEFT JOIN half f ON f.level = g.level AND f.x1 = g.x1 AND f.x2 = g.x2""")
def r08_j10_regrid_coarsen(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The deepest complete groups of siblings merged, and the field averaged onto them."""
    old = meshes.balanced2d(spark, sf_dir)
    points = meshes.points2d(spark, sf_dir, old)
    new = cut(tree.numbered(tree.coarsen(old, tree.parent(old.where(F.col("level") == LEVELS), 2), 2), 2, LEVELS))
    return regrid.transfer(points, old, new, UNIT2, BARE, FLAT)


FACES = Layout(facecentered(2, 0), (0, 0))


@query(f"""WITH RECURSIVE {sql.GRADED}, {sql.balanced('leaf', 'bal')},
flux AS (SELECT leaf, level, c1, c2, CAST(i.range AS INTEGER) AS i1, CAST(j.range AS INTEGER) AS i2, CAST(leaf * 64 + i.range * 8 + j.range AS DOUBLE) AS v1 FROM bal, range(1, 6) i, range(1, 5) j),
plane AS (SELECT level, c1, c2, i2, CASE i1 WHEN 1 THEN c1 ELSE c1 + 1 END AS pos, i1, v1 FROM flux WHERE i1 IN (1, 5)),
fine AS (SELECT level - 1 AS level, pos, 5 - (i1 - 1) AS other, (c2 * 4 + i2 - 1) >> 1 AS y, avg(v1) AS v1 FROM plane WHERE pos % 2 = 0 GROUP BY ALL)
SELECT f.leaf, f.i1, f.i2, coalesce(g.v1, f.v1) AS v1 FROM flux f LEFT JOIN (SELECT *, pos // 2 AS half FROM fine) g
ON g.level = f.level AND g.y = f.c2 * 4 + f.i2 - 1 AND g.other = f.i1 AND g.half = CASE f.i1 WHEN 1 THEN f.c1 ELSE f.c1 + 1 END""")
def j09_x17_w18_interfaces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fluxes along the first dimension; coarse planes at finer neighbours become the fine means."""
    leaves = meshes.balanced2d(spark, sf_dir)
    flux = fields.grid(leaves, FACES.closed(4)).withColumn("v1", (F.col("leaf") * 64 + F.col("i1") * 8 + F.col("i2")).cast("double"))
    return interfaces.restrict_interfaces(flux, leaves, UNIT2, FACES)


MINMOD = "CASE WHEN least({0}) > 0 THEN least({0}) WHEN greatest({0}) < 0 THEN greatest({0}) ELSE 0 END"


def _slope(lo: str, hi: str) -> str:
    return MINMOD.format(f"2 * (u - {lo}), 2 * ({hi} - u), ({hi} - {lo}) / 2")


@query(f"""{WITH}, w AS (SELECT a.leaf, a.i1, a.i2, a.v1 AS u, b.v1 AS l1, c.v1 AS h1, d.v1 AS l2, e.v1 AS h2 FROM val a
  JOIN val b ON b.leaf = a.leaf AND b.i1 = a.i1 - 1 AND b.i2 = a.i2 JOIN val c ON c.leaf = a.leaf AND c.i1 = a.i1 + 1 AND c.i2 = a.i2
  JOIN val d ON d.leaf = a.leaf AND d.i1 = a.i1 AND d.i2 = a.i2 - 1 JOIN val e ON e.leaf = a.leaf AND e.i1 = a.i1 AND e.i2 = a.i2 + 1),
s AS (SELECT *, {_slope("l1", "h1")} AS s1, {_slope("l2", "h2")} AS s2, greatest(u, l1, h1, l2, h2) - u AS up, u - least(u, l1, h1, l2, h2) AS down FROM w),
f AS (SELECT *, CASE WHEN (abs(s1) + abs(s2)) / 4 > least(up, down) THEN least(up, down) / ((abs(s1) + abs(s2)) / 4) ELSE 1.0 END AS phi FROM s)
SELECT leaf, CAST(i1 * 2 - 1 + a AS INTEGER) AS i1, CAST(i2 * 2 - 1 + b AS INTEGER) AS i2, round(u + phi * (s1 * (a * 2 - 1) / 4 + s2 * (b * 2 - 1) / 4), 6) AS v1 FROM f, {sql.KIDS}""")
def x04_w12_bounded_prolongation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Inner cells of every block split with limited slopes."""
    _, points = mesh_and_points(spark, sf_dir)
    return bounded.split_cells(points, 2, "v1").withColumn("v1", F.round("v1", 6))


@query(f"{WITH}, f AS (SELECT leaf, min(v1) AS lo, max(v1) AS hi, avg(v1) * 1.5 AS t FROM val WHERE i1 <= 2 AND i2 <= 2 GROUP BY leaf) SELECT leaf, greatest(least(t, hi), lo) AS v1 FROM f")
def x05_bracket_clamp(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An overshooting value clamped to its bracket."""
    _, points = mesh_and_points(spark, sf_dir)
    box = points.where("i1 <= 2 AND i2 <= 2").groupBy("leaf").agg(F.min("v1").alias("lo"), F.max("v1").alias("hi"), (F.avg("v1") * 1.5).alias("t"))
    return box.select("leaf", bounded.bracket(F.col("t"), F.col("lo"), F.col("hi")).alias("v1"))


@query(f"""{WITH}, b AS (SELECT leaf, level, c1, c2, CAST(i.range AS INTEGER) AS i1, CAST(j.range AS INTEGER) AS i2 FROM leaf, range(1, 7) i, range(1, 7) j),
g AS (SELECT * FROM b WHERE (i1 = 1 AND c1 = 0) OR (i1 = 6 AND c1 = (1 << level) - 1) OR (i2 = 1 AND c2 = 0) OR (i2 = 6 AND c2 = (1 << level) - 1)),
n AS (SELECT g.*, v1, ((i1 - 1.5) / 4 + c1) / power(2, level) - ((least(greatest(i1, 2), 5) - 1.5) / 4 + c1) / power(2, level) AS dx FROM g JOIN (SELECT leaf, i1 + 1 AS r1, i2 + 1 AS r2, v1 FROM val) v
  ON v.leaf = g.leaf AND r1 = least(greatest(i1, 2), 5) AND r2 = least(greatest(i2, 2), 5))
SELECT leaf, i1, i2, round(v1 + 16 * dx, 9) AS v1 FROM n WHERE i1 IN (1, 6) OR i2 IN (1, 6)""")
def x10_relative_boundary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Outer ghosts by the function 16 x, relative to the nearest owned point."""
    leaves, points = mesh_and_points(spark, sf_dir)
    got = exchange.relative_boundary(with_ghosts(points, HALO), leaves, UNIT2, HALO, {"v1": lambda x, y: 16 * x})
    return got.withColumn("v1", F.round("v1", 9))


WALLED = MeshSpec(roots=(1, 1), cells=4, reflecting=frozenset({(0, 0), (0, 1)}), outflow=frozenset({(1, 0), (1, 1)}))
ODD = Layout(cellcentered(2), (1, 1), ("v1", "v2"), parity={"v2": {0: -1}})


@query(f"""WITH RECURSIVE {sql.GRADED}, {sql.balanced('leaf', 'bal')}, {sql.values('bal')}
SELECT leaf, 1 AS i1, i2 + 1 AS i2, v1, -v1 AS v2 FROM val JOIN bal USING (leaf) WHERE c1 = 0 AND i1 = 1
UNION ALL SELECT leaf, 6, i2 + 1, v1, -v1 FROM val JOIN bal USING (leaf) WHERE c1 = (1 << bal.level) - 1 AND i1 = 4
UNION ALL SELECT leaf, i1 + 1, 1, v1, v1 FROM val JOIN bal USING (leaf) WHERE c2 = 0 AND i2 = 1
UNION ALL SELECT leaf, i1 + 1, 6, v1, v1 FROM val JOIN bal USING (leaf) WHERE c2 = (1 << bal.level) - 1 AND i2 = 4""")
def j02_x13_f13_walls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ghosts beyond reflecting and outflow faces, edges left out: mirrored times the parity, and clamped."""
    leaves = meshes.balanced2d(spark, sf_dir)
    points = with_ghosts(meshes.points2d(spark, sf_dir, leaves), ODD).withColumn("v2", F.col("v1"))
    full = exchange.fill_ghosts(points, leaves, WALLED, ODD, FLAT).join(leaves.select("leaf", "level", "c1", "c2"), "leaf")
    last = F.pow(F.lit(2.0), F.col("level")).cast("long") - 1
    beyond = [((F.col("c1") == 0) & (F.col("i1") == 1)) | ((F.col("c1") == last) & (F.col("i1") == 6)), ((F.col("c2") == 0) & (F.col("i2") == 1)) | ((F.col("c2") == last) & (F.col("i2") == 6))]
    inner = [F.col(i).between(2, 5) for i in ("i1", "i2")]
    return full.where((beyond[0] & inner[1]) | (beyond[1] & inner[0])).select("leaf", "i1", "i2", "v1", "v2")


@query(f"{WITH} SELECT leaf, i1, i2, v1, v1 * 2 + leaf AS v2 FROM val")
def f10_several_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two sets in one state, told apart by ``set_id``, and put side by side."""
    _, points = mesh_and_points(spark, sf_dir)
    other = points.withColumn("v1", F.col("v1") * 2 + F.col("leaf"))
    both = points.withColumn("set_id", F.lit(0)).unionByName(other.withColumn("set_id", F.lit(1)))
    return both.groupBy("leaf", "i1", "i2").agg(F.max(F.when(F.col("set_id") == 0, F.col("v1"))).alias("v1"), F.max(F.when(F.col("set_id") == 1, F.col("v1"))).alias("v2"))
