"""Leaf algebra and geometry over the graded mesh of line items."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mortar.functions import keys
from mortar.functions.lineage import cut
from mortar.operators import geometry, patched
from mortar.operators import leaves as tree
from mortar.plans.patches import Glue, PatchMesh, both_ways, half_turn, quarter_turn
from mortar.plans.spec import MeshSpec, directions
from mortar.queries import sql
from mortar.sources import meshes
from mortar.sources.meshes import LEVELS, PERIODIC2, UNIT2

NODE = ["root", "level", "c1", "c2"]
WITH = f"WITH {sql.GRADED}"
QUERIES, ORACLES = {}, {}


def query(oracle: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if oracle:
            ORACLES[f.__name__] = oracle
        return f

    return register


@query(f"""WITH RECURSIVE {sql.GRADED}, {sql.balanced("leaf", "bal")}
SELECT b.level, count(*) AS n_leaves, sum(t.cnt)::BIGINT AS cnt, sum(t.mass) AS mass FROM bal b LEFT JOIN (SELECT level, c1, c2, cnt, mass FROM tot) t
USING (level, c1, c2) GROUP BY b.level""")
def mesh_flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Threshold, balance, and fold the occupancy by level."""
    totals = meshes.totals2d(spark, sf_dir)
    return meshes.balanced2d(spark, sf_dir).join(totals, NODE, "left").groupBy("level").agg(F.count("*").alias("n_leaves"), F.sum("cnt").alias("cnt"), F.sum("mass").alias("mass"))


@query(f"{WITH} SELECT root, level, c1, c2, (root >= 0 AND level BETWEEN 0 AND 32 AND c1 >= 0 AND c1 < (1 << level) AND c2 >= 0 AND c2 < (1 << level)) AS valid FROM leaf")
def l01_l02_valid_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    return meshes.leaves2d(spark, sf_dir).select(*NODE, keys.is_valid(2).alias("valid"))


@query(f"{WITH} SELECT DISTINCT root, level - 1 AS level, c1 >> 1 AS c1, c2 >> 1 AS c2 FROM leaf WHERE level > 0")
def l03_parents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tree.parent(meshes.leaves2d(spark, sf_dir), 2).distinct()


@query(f"{WITH} SELECT root, level + 1 AS level, c1 * 2 + a AS c1, c2 * 2 + b AS c2 FROM leaf, {sql.KIDS}")
def l04_l05_children(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tree.children(meshes.leaves2d(spark, sf_dir), 2)


@query(f"""{WITH} SELECT a.level AS a_level, a.c1 AS a_c1, a.c2 AS a_c2, b.leaf FROM tot a JOIN leaf b
ON a.level < b.level AND (b.c1 >> (b.level - a.level)) = a.c1 AND (b.c2 >> (b.level - a.level)) = a.c2""")
def l06_ancestors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Occupied nodes that are ancestors of each leaf: the join on exploded ancestors."""
    over = tree.ancestors(meshes.leaves2d(spark, sf_dir), 2, "leaf", strict=True)
    hit = over.join(meshes.totals2d(spark, sf_dir).select(*NODE), NODE)
    return hit.select(F.col("level").alias("a_level"), F.col("c1").alias("a_c1"), F.col("c2").alias("a_c2"), "leaf")


@query(f"{WITH} SELECT root, level, c1, c2, skey, leaf FROM leaf")
def l07_l15_curve_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    return meshes.leaves2d(spark, sf_dir).select(*NODE, "skey", "leaf")


@query("SELECT CAST(range AS INTEGER) AS root, 0 AS level, CAST(0 AS BIGINT) AS c1, CAST(0 AS BIGINT) AS c2 FROM range(6)")
def l09_roots(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tree.roots(spark, MeshSpec(roots=(3, 2), cells=4))


@query(f"""{WITH} SELECT count(*) AS n_leaves, CAST(0 AS BIGINT) AS n_misplaced, sum(power(4, {LEVELS} - level)) = {4**LEVELS} AS tiles FROM leaf""")
def l14_tiling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tree.check_tiling(meshes.leaves2d(spark, sf_dir), UNIT2, LEVELS)


@query(f"{WITH} SELECT count(*) AS nleaves, max(level) AS maxlevel FROM leaf")
def l15_scalars(spark: SparkSession, sf_dir: str) -> DataFrame:
    return meshes.leaves2d(spark, sf_dir).agg(F.count("*").alias("nleaves"), F.max("level").alias("maxlevel"))


@query("SELECT CAST(range AS INTEGER) AS root, CAST(range % 3 AS INTEGER) AS p1, CAST((range // 3) % 2 AS INTEGER) AS p2, CAST(range // 6 AS INTEGER) AS p3 FROM range(24)")
def l16_root_positions(spark: SparkSession, sf_dir: str) -> DataFrame:
    mesh = MeshSpec(roots=(3, 2, 4), cells=4)
    rows = [(k, *mesh.root_position(k)) for k in range(24)]
    assert all(mesh.root_index(r[1:]) == r[0] for r in rows)
    return spark.createDataFrame(rows, "root int, p1 int, p2 int, p3 int")


@query("SELECT CAST(a.range - 1 AS INTEGER) AS d1, CAST(b.range - 1 AS INTEGER) AS d2, CAST(c.range - 1 AS INTEGER) AS d3 FROM range(3) a, range(3) b, range(3) c WHERE NOT (a.range = 1 AND b.range = 1 AND c.range = 1)")
def l17_directions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.createDataFrame(directions(3), "d1 int, d2 int, d3 int")


@query(f"{WITH} SELECT t.level, t.c1, t.c2, l.leaf FROM tot t LEFT JOIN leaf l USING (level, c1, c2)")
def l18_find(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes = meshes.totals2d(spark, sf_dir).select(*NODE)
    return tree.find(meshes.leaves2d(spark, sf_dir), nodes, 2).select("level", "c1", "c2", "leaf")


@query(f"""{WITH} SELECT t.level * 4096 + t.c1 * 64 + t.c2 AS key, l.leaf FROM tot t JOIN leaf l
ON l.level <= t.level AND (t.c1 >> (t.level - l.level)) = l.c1 AND (t.c2 >> (t.level - l.level)) = l.c2""")
def l19_covering(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes = meshes.totals2d(spark, sf_dir).withColumn("key", (F.col("level") * 4096 + F.col("c1") * 64 + F.col("c2")).cast("long"))
    return tree.covering(meshes.leaves2d(spark, sf_dir), nodes, 2, "key")


@query(f"""{WITH} SELECT leaf, d1, d2, (c1 + d1 + (1 << level)) % (1 << level) AS n_c1, (c2 + d2 + (1 << level)) % (1 << level) AS n_c2 FROM leaf, {sql.DIRS}""")
def l20_steps_periodic(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tree.step(meshes.leaves2d(spark, sf_dir), PERIODIC2, "leaf").select("leaf", "d1", "d2", "n_c1", "n_c2")


def touching(leaf: str, periodic: bool) -> str:
    """Neighbours by box geometry, in finest cells."""
    wrap = lambda x: f"(({x} + (1 << a.level)) % (1 << a.level))" if periodic else x
    inside = "" if periodic else " WHERE x1 BETWEEN 0 AND (1 << level) - 1 AND x2 BETWEEN 0 AND (1 << level) - 1"
    up = lambda c, level: f"({c} << ({LEVELS} - {level}))"
    near = " AND ".join(f"(CASE d{d} WHEN 1 THEN {up(f'b.c{d}', 'b.level')} = {up(f'x{d}', 's.level')} WHEN -1 THEN {up(f'(b.c{d} + 1)', 'b.level')} = {up(f'(x{d} + 1)', 's.level')} ELSE TRUE END)" for d in (1, 2))
    return f"""stepped AS (SELECT * FROM (SELECT a.leaf, a.level, d1, d2, {wrap("(a.c1 + d1)")} AS x1, {wrap("(a.c2 + d2)")} AS x2 FROM {leaf} a, {sql.DIRS}){inside}),
near AS (
  SELECT s.leaf, s.d1, s.d2, b.leaf AS neighbour, b.level AS n_level FROM stepped s JOIN {leaf} b
  ON b.level <= s.level AND (s.x1 >> (s.level - b.level)) = b.c1 AND (s.x2 >> (s.level - b.level)) = b.c2
  UNION ALL
  SELECT s.leaf, s.d1, s.d2, b.leaf, b.level FROM stepped s JOIN {leaf} b
  ON b.level > s.level AND (b.c1 >> (b.level - s.level)) = s.x1 AND (b.c2 >> (b.level - s.level)) = s.x2 AND {near})"""


@query(f"{WITH}, {touching('leaf', False)} SELECT * FROM near")
def l23_l24_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tree.neighbours(meshes.leaves2d(spark, sf_dir), UNIT2)


@query(f"{WITH}, {touching('leaf', True)} SELECT * FROM near")
def l24_neighbours_periodic(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tree.neighbours(meshes.leaves2d(spark, sf_dir), PERIODIC2)


@query(f"""{WITH}, hit AS (SELECT * FROM leaf WHERE leaf % 5 = 0 AND level < {LEVELS})
SELECT root, level, c1, c2 FROM leaf WHERE leaf NOT IN (SELECT leaf FROM hit)
UNION ALL SELECT root, level + 1, c1 * 2 + a, c2 * 2 + b FROM hit, {sql.KIDS}""")
def l26_refine(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every fifth leaf above the deepest level split."""
    leaves = meshes.leaves2d(spark, sf_dir)
    return tree.refine(leaves, leaves.where((F.col("leaf") % 5 == 0) & (F.col("level") < LEVELS)), 2)


@query(f"""{WITH}, up AS (SELECT level - 1 AS level, c1 >> 1 AS c1, c2 >> 1 AS c2 FROM leaf WHERE level > 0 GROUP BY ALL HAVING count(*) = 4),
hit AS (SELECT * FROM up WHERE (c1 + c2) % 2 = 0)
SELECT root, level, c1, c2 FROM leaf WHERE (level - 1, c1 >> 1, c2 >> 1) NOT IN (SELECT (level, c1, c2) FROM hit)
UNION ALL SELECT 0, level, c1, c2 FROM hit""")
def l26_coarsen(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Complete groups of siblings under every other parent merged."""
    leaves = meshes.leaves2d(spark, sf_dir)
    return tree.coarsen(leaves, tree.parent(leaves, 2).where((F.col("c1") + F.col("c2")) % 2 == 0), 2)


@query(f"WITH RECURSIVE {sql.GRADED}, {sql.balanced('leaf', 'bal')} SELECT root, level, c1, c2 FROM bal")
def l27_balance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tree.balance(meshes.leaves2d(spark, sf_dir), UNIT2, LEVELS)


@query(f"WITH RECURSIVE {sql.GRADED}, {sql.balanced('leaf', 'bal', True)} SELECT root, level, c1, c2 FROM bal")
def l27_balance_periodic(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tree.balance(meshes.leaves2d(spark, sf_dir), PERIODIC2, LEVELS)


@query(f"""WITH RECURSIVE {sql.GRADED}, {sql.balanced('leaf', 'bal')}, {touching('bal', False)}
SELECT coalesce(max(abs(b.level - n_level)), 0) AS max_gap, coalesce(max(abs(b.level - n_level)), 0) <= 1 AS balanced FROM near JOIN bal b USING (leaf)""")
def l27_is_balanced(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tree.is_balanced(meshes.balanced2d(spark, sf_dir), UNIT2)


@query(f"""{WITH}, n AS (SELECT count(*) // 7 AS short, count(*) % 7 AS extra FROM leaf)
SELECT leaf, CAST(CASE WHEN leaf - 1 < (short + 1) * extra THEN (leaf - 1) // (short + 1) ELSE extra + (leaf - 1 - (short + 1) * extra) // greatest(short, 1) END AS INTEGER) AS part FROM leaf, n""")
def l29_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tree.split_parts(meshes.leaves2d(spark, sf_dir), 7).select("leaf", "part")


@query(f"""{WITH} SELECT leaf, 0.25 / power(2, level) AS h, c1 / power(2, level) AS lo1, c2 / power(2, level) AS lo2,
(c1 + 1) / power(2, level) AS hi1, (c2 + 1) / power(2, level) AS hi2 FROM leaf""")
def g01_g06_block_geometry(spark: SparkSession, sf_dir: str) -> DataFrame:
    return geometry.with_geometry(meshes.leaves2d(spark, sf_dir), UNIT2).select("leaf", "h", "lo1", "lo2", "hi1", "hi2")


@query(f"{WITH} SELECT max(level) AS maxlevel, min(0.25 / power(2, level)) AS h FROM leaf")
def g03_minimum_spacing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return geometry.minimum_spacing(meshes.leaves2d(spark, sf_dir), UNIT2)


#: Two patches of 2 x 3 and 3 x 2 roots; the first's high x meets the second's high y, axes swapped, so that its y runs backwards
#: along the second's x.
PAIR = PatchMesh(((2, 3), (3, 2)), both_ways(Glue(0, 0, 1, 1, 1, 1, (1, 0), (True, True))))
PAIR_ROOTS = """SELECT CAST(range AS INTEGER) AS root, range + 1 AS leaf, CAST(CASE WHEN range < 6 THEN 0 ELSE 1 END AS INTEGER) AS patch,
CASE WHEN range < 6 THEN range % 2 ELSE (range - 6) % 3 END AS x, CASE WHEN range < 6 THEN range // 2 ELSE (range - 6) // 3 END AS y FROM range(12)"""


@query(f"SELECT root, patch, x AS p1, y AS p2 FROM ({PAIR_ROOTS})")
def l28_patches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The patch of every root, and its place there."""
    rows = patched.roots(spark, PAIR).withColumn("patch", patched.patch_of(PAIR))
    at = F.col("root") - F.when(F.col("patch") == 0, 0).otherwise(6)
    wide = F.when(F.col("patch") == 0, 2).otherwise(3)
    return rows.select("root", F.col("patch").cast("int").alias("patch"), (at % wide).cast("long").alias("p1"), F.floor(at / wide).cast("long").alias("p2"))


@query(f"""WITH r AS ({PAIR_ROOTS}), s AS (SELECT r.*, d1, d2, x + d1 AS nx, y + d2 AS ny, CASE patch WHEN 0 THEN 2 ELSE 3 END AS w, CASE patch WHEN 0 THEN 3 ELSE 2 END AS h FROM r, {sql.DIRS})
SELECT s.leaf, d1, d2, CAST(NULL AS INTEGER) AS crossed, t.leaf AS neighbour FROM s JOIN r t ON t.patch = s.patch AND t.x = nx AND t.y = ny
UNION ALL SELECT s.leaf, d1, d2, 0, t.leaf FROM s JOIN r t ON s.patch = 0 AND nx = 2 AND ny BETWEEN 0 AND 2 AND t.patch = 1 AND t.x = 2 - ny AND t.y = 1
UNION ALL SELECT s.leaf, d1, d2, 1, t.leaf FROM s JOIN r t ON s.patch = 1 AND ny = 2 AND nx BETWEEN 0 AND 2 AND t.patch = 0 AND t.x = 1 AND t.y = 2 - nx""")
def l10_l22_glued_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Neighbours inside the two patches and across the glued faces."""
    leaves = patched.roots(spark, PAIR).withColumn("leaf", (F.col("root") + 1).cast("long"))
    return patched.neighbours(leaves, PAIR)


CELLS3 = """cell AS (SELECT (l_partkey * l_partkey * 8) // (p * p) AS c1, (l_suppkey * l_suppkey * 8) // (s * s) AS c2, CAST((l_linenumber * 8) // (n + 1) AS BIGINT) AS c3, count(*) AS cnt
FROM lineitem, (SELECT max(l_partkey) + 1 AS p, max(l_suppkey) + 1 AS s, max(l_linenumber) AS n FROM lineitem) GROUP BY ALL)"""
KIDS3 = sql.KIDS + ", (SELECT CAST(range AS BIGINT) AS c FROM range(2))"
ALL3 = "(SELECT CAST(x.range - 1 AS INTEGER) AS d1, CAST(y.range - 1 AS INTEGER) AS d2, CAST(z.range - 1 AS INTEGER) AS d3 FROM range(3) x, range(3) y, range(3) z) d"
IN3 = " AND ".join(f"(n.c{k} >> 1) + d{k} BETWEEN 0 AND (1 << (level - 1)) - 1" for k in (1, 2, 3))


@query(f"""WITH RECURSIVE {CELLS3}, tot AS (SELECT l.l AS level, c1 >> (3 - l.l) AS c1, c2 >> (3 - l.l) AS c2, c3 >> (3 - l.l) AS c3, sum(cnt) AS cnt FROM cell, (SELECT CAST(range AS INTEGER) AS l FROM range(4)) l GROUP BY ALL),
inn AS (SELECT level, c1, c2, c3 FROM tot WHERE cnt * 20 > (SELECT count(*) FROM lineitem) AND level < 3),
raw AS (SELECT n.* FROM (SELECT 0 AS level, CAST(0 AS BIGINT) AS c1, CAST(0 AS BIGINT) AS c2, CAST(0 AS BIGINT) AS c3 UNION ALL SELECT level + 1, c1 * 2 + a, c2 * 2 + b, c3 * 2 + c FROM inn, {KIDS3}) n ANTI JOIN inn USING (level, c1, c2, c3)),
need AS (SELECT level, c1, c2, c3 FROM raw UNION SELECT level - 1, (n.c1 >> 1) + d1, (n.c2 >> 1) + d2, (n.c3 >> 1) + d3 FROM need n, {ALL3} WHERE level >= 1 AND {IN3}),
more AS (SELECT DISTINCT level - 1 AS level, c1 >> 1 AS c1, c2 >> 1 AS c2, c3 >> 1 AS c3 FROM need WHERE level > 0)
SELECT 0 AS root, n.* FROM (SELECT 0 AS level, CAST(0 AS BIGINT) AS c1, CAST(0 AS BIGINT) AS c2, CAST(0 AS BIGINT) AS c3 UNION ALL SELECT level + 1, c1 * 2 + a, c2 * 2 + b, c3 * 2 + c FROM more, {KIDS3}) n ANTI JOIN more USING (level, c1, c2, c3)""")
def l27_balance_3d(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The balanced mesh of line items in three dimensions."""
    mesh = MeshSpec(roots=(1, 1, 1), cells=4)
    items = meshes.table(spark, sf_dir, "lineitem")
    p, s, n = (int(x or 1) for x in items.agg(F.max("l_partkey") + 1, F.max("l_suppkey") + 1, F.max("l_linenumber") + 1).first())
    c1, c2 = F.expr(f"(l_partkey * l_partkey * 8L) div ({p}L * {p}L)"), F.expr(f"(l_suppkey * l_suppkey * 8L) div ({s}L * {s}L)")
    cells = items.groupBy(c1.alias("c1"), c2.alias("c2"), F.expr(f"(l_linenumber * 8L) div {n}L").alias("c3")).agg(F.count("*").alias("cnt"))
    totals = cut(tree.occupied(cells, 3, 3, "cnt"))
    all_ = totals.where("level = 0").agg(F.sum("cnt")).first()[0] or 0
    leaves = cut(tree.thresholded(totals, F.col("cnt") * 20 > all_, 3, 3, tree.roots(spark, mesh)))
    return tree.balance(leaves, mesh, 3)


@query(f"""WITH c AS (SELECT CAST(date_diff('day', TIMESTAMP '2024-01-01', ts) * 2 + (hour(ts) // 12) AS BIGINT) AS c1, count(*) AS cnt FROM events GROUP BY 1),
tot AS (SELECT l.l AS level, c1 >> (6 - l.l) AS c1, CAST(sum(cnt) AS BIGINT) AS cnt FROM c, (SELECT CAST(range AS INTEGER) AS l FROM range(7)) l WHERE c1 BETWEEN 0 AND 63 GROUP BY ALL) SELECT 0 AS root, * FROM tot""")
def l19_occupancy_1d(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events by half days, totalled over every node above."""
    ts = F.col("ts").cast("timestamp")
    half = F.datediff(ts, F.lit("2024-01-01")) * 2 + F.floor(F.hour(ts) / 12)
    cells = meshes.table(spark, sf_dir, "events").groupBy(half.cast("long").alias("c1")).agg(F.count("*").alias("cnt")).where("c1 BETWEEN 0 AND 63")
    return tree.occupied(cells, 1, 6, "cnt")


def seam_sql(across: str) -> str:
    """Neighbours on 4 x 4 leaves of one level below 2 x 2 roots, inside and ``across`` a seam."""
    return f"""WITH r AS (SELECT x.range AS x, y.range AS y, (y.range // 2 * 2 + x.range // 2) * 4 + (x.range % 2) * 2 + y.range % 2 + 1 AS leaf FROM range(4) x, range(4) y),
s AS (SELECT r.*, d1, d2, x + d1 AS nx, y + d2 AS ny FROM r, {sql.DIRS})
SELECT s.leaf, d1, d2, t.leaf AS neighbour FROM s JOIN r t ON t.x = nx AND t.y = ny
UNION ALL {across}"""


def refined_once(spark: SparkSession, mesh: PatchMesh) -> DataFrame:
    first = tree.children(patched.roots(spark, mesh), 2)
    return first.withColumn("leaf", F.col("root").cast("long") * 4 + F.col("c1") * 2 + F.col("c2") + 1)


@query(seam_sql("""SELECT s.leaf, d1, d2, t.leaf FROM s JOIN r t ON nx = -1 AND ny BETWEEN 0 AND 3 AND t.x = ny AND t.y = 0
UNION ALL SELECT s.leaf, d1, d2, t.leaf FROM s JOIN r t ON ny = -1 AND nx BETWEEN 0 AND 3 AND t.x = 0 AND t.y = nx"""))
def l13_l21_quarter_turn(spark: SparkSession, sf_dir: str) -> DataFrame:
    mesh = quarter_turn((2, 2))
    return patched.neighbours(refined_once(spark, mesh), mesh).drop("crossed")


@query(seam_sql("SELECT s.leaf, d1, d2, t.leaf FROM s JOIN r t ON nx = -1 AND ny BETWEEN 0 AND 3 AND t.x = 0 AND t.y = 3 - ny"))
def l13_l21_half_turn(spark: SparkSession, sf_dir: str) -> DataFrame:
    mesh = half_turn((2, 2))
    return patched.neighbours(refined_once(spark, mesh), mesh).drop("crossed")


@query("""WITH r AS (SELECT x.range AS x, y.range AS y, (y.range // 2 * 2 + x.range // 2) * 4 + (x.range % 2) * 2 + y.range % 2 + 1 AS leaf FROM range(4) x, range(4) y),
p AS (SELECT leaf, x * 4 + i.range AS gx, y * 4 + j.range AS gy, i.range + 2 AS i1, j.range + 2 AS i2, CAST(leaf * 100 + i.range * 10 + j.range AS DOUBLE) AS s, CAST(leaf + i.range AS DOUBLE) AS u, CAST(leaf - j.range AS DOUBLE) AS w FROM r, range(4) i, range(4) j)
SELECT r.leaf, 1 AS i1, CAST(j.range + 2 AS INTEGER) AS i2, s, -w AS u, u AS w FROM r, range(4) j, p WHERE x = 0 AND gx = y * 4 + j.range AND gy = 0
UNION ALL SELECT r.leaf, CAST(i.range + 2 AS INTEGER), 1, s, w, -u FROM r, range(4) i, p WHERE y = 0 AND gy = x * 4 + i.range AND gx = 0""")
def x06_x14_f14_turned_ghosts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ghosts across a quarter turn: a scalar, and a vector (u, w) whose components change places and sign."""
    mesh = quarter_turn((2, 2))
    leaves = refined_once(spark, mesh)
    grid = F.sequence(F.lit(2), F.lit(5))
    points = leaves.select("leaf", F.explode(grid).alias("i1")).withColumn("i2", F.explode(grid))
    values = {"s": F.col("leaf") * 100 + (F.col("i1") - 2) * 10 + F.col("i2") - 2, "u": F.col("leaf") + F.col("i1") - 2, "w": F.col("leaf") - F.col("i2") + 2}
    data = points.withColumns({k: v.cast("double") for k, v in values.items()})
    return patched.glued_ghosts(data, leaves, mesh, 1, ("s",), ("u", "w"))


@query(f"""WITH r AS ({PAIR_ROOTS}), q AS (SELECT o_orderkey AS pid, CAST(o_custkey % 2 AS INTEGER) AS patch, (o_orderkey % 13) / 4.0 AS x1, (o_custkey % 11) / 4.0 AS x2 FROM orders)
SELECT q.pid, r.leaf FROM q LEFT JOIN r ON r.patch = q.patch AND q.x1 <= (CASE q.patch WHEN 0 THEN 2 ELSE 3 END) AND q.x2 <= (CASE q.patch WHEN 0 THEN 3 ELSE 2 END)
AND r.x = least(floor(q.x1), CASE q.patch WHEN 0 THEN 1 ELSE 2 END) AND r.y = least(floor(q.x2), CASE q.patch WHEN 0 THEN 2 ELSE 1 END)""")
def p03_patch_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as points of the two patches, on faces too; a face belongs to the upper root, a patch's own to its last."""
    orders = meshes.table(spark, sf_dir, "orders")
    rows = orders.select(F.col("o_orderkey").alias("pid"), (F.col("o_custkey") % 2).cast("int").alias("patch"), ((F.col("o_orderkey") % 13) / 4.0).alias("x1"), ((F.col("o_custkey") % 11) / 4.0).alias("x2"))
    leaves = patched.roots(spark, PAIR).withColumn("leaf", (F.col("root") + 1).cast("long"))
    return patched.locate(rows, leaves, PAIR, 4)
