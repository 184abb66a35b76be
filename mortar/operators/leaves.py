"""Leaf algebra: the tree as a table of leaves.

A node is (root, level, c1 .. cD); leaves tile the brick.  Every operator takes and returns
DataFrames; searches are equi-joins on computed keys.  ``leaves`` may be small (it is then
broadcast by Spark's own size rule) or as large as the data.
"""

from __future__ import annotations

from itertools import product

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from mortar.functions.keys import coords, morton, node, shift_left, shift_right
from mortar.functions.lineage import cut
from mortar.plans.spec import MAX_LEVEL, MeshSpec, directions


def roots(spark: SparkSession, mesh: MeshSpec) -> DataFrame:
    """The unrefined mesh: one leaf a root."""
    n = 1
    for r in mesh.roots:
        n *= r
    zeros = [F.lit(0).cast("long").alias(c) for c in coords(mesh.dims)]
    return spark.range(n).select(F.col("id").cast("int").alias("root"), F.lit(0).alias("level"), *zeros)


def parent(nodes: DataFrame, dims: int) -> DataFrame:
    """Parents of nodes below the roots."""
    up = [F.shiftright(c, 1).alias(c) for c in coords(dims)]
    return nodes.where("level > 0").select("root", (F.col("level") - 1).alias("level"), *up)


def children(nodes: DataFrame, dims: int) -> DataFrame:
    """The 2**D children of nodes above the deepest level, in curve order of their parent."""
    offsets = F.array(*[F.struct(*[F.lit(x).alias(f"o{d + 1}") for d, x in enumerate(o)]) for o in product((0, 1), repeat=dims)])
    down = [(F.col(c) * 2 + F.col(f"o.o{d + 1}")).cast("long").alias(c) for d, c in enumerate(coords(dims))]
    return nodes.where(F.col("level") < MAX_LEVEL).withColumn("o", F.explode(offsets)).select("root", (F.col("level") + 1).alias("level"), *down)


def ancestors(nodes: DataFrame, dims: int, *keep: str, strict: bool = False) -> DataFrame:
    """Each node's ancestors, itself included unless ``strict``, with the columns ``keep``."""
    up = F.sequence(F.lit(1 if strict else 0), F.col("level"))
    rows = nodes.where("level > 0") if strict else nodes
    over = [shift_right(F.col(c), F.col("up")).alias(c) for c in coords(dims)]
    return rows.withColumn("up", F.explode(up)).select(*keep, "root", (F.col("level") - F.col("up")).alias("level"), *over)


def numbered(leaves: DataFrame, dims: int, levels: int) -> DataFrame:
    """Adds ``skey`` (the place on the curve) and ``leaf`` (the rank along it, from 1).

    Ranks are sums of counts: buckets of the curve's first levels, buckets of the next levels inside each, and so on, then a
    window inside the last.  A window holds one row a bucket of one tier, 2**12 at most (times the roots in the first),
    so neither many leaves nor a mesh refined into one corner meet in a task."""
    tier = 6 if dims < 3 else 4
    rows, keys, rank = leaves.withColumn("skey", morton(dims, levels)), ["root"], F.lit(0).cast("long")
    for k, depth in enumerate(range(tier, max(levels, 1) + tier, tier)):
        name = f"_b{k}"
        rows = rows.withColumn(name, F.shiftright("skey", dims * max(0, levels - depth)))
        counts = rows.groupBy(*keys, name).agg(F.count("*").alias("_n"))
        ahead = Window.orderBy("root", name) if k == 0 else Window.partitionBy(*keys).orderBy(name)
        rows = rows.join(counts.withColumn(f"_f{k}", F.sum("_n").over(ahead) - F.col("_n")).drop("_n"), [*keys, name])
        keys, rank = [*keys, name], rank + F.col(f"_f{k}")
    within = F.row_number().over(Window.partitionBy(*keys).orderBy("skey"))
    return rows.withColumn("leaf", (rank + within).cast("long")).select(*leaves.columns, "skey", "leaf")


def occupied(cells: DataFrame, dims: int, levels: int, *sums: str) -> DataFrame:
    """Totals of finest cells over every node above them that holds any."""
    over = ancestors(cells.withColumn("level", F.lit(levels)).withColumn("root", F.lit(0)), dims, *sums)
    return over.groupBy(*node(dims)).agg(*[F.sum(s).alias(s) for s in sums])


def thresholded(totals: DataFrame, split: Column, dims: int, levels: int, base: DataFrame) -> DataFrame:
    """Leaves of the tree whose nodes split where ``split`` holds (a node's ancestors must split too)."""
    inner = totals.where(split & (F.col("level") < levels)).select(*node(dims))
    return base.unionByName(children(inner, dims)).join(inner, node(dims), "left_anti")


def refine(leaves: DataFrame, keys: DataFrame, dims: int, strict: bool = False) -> DataFrame:
    """Replaces the leaves ``keys`` by their children; keys that are no leaves change nothing, or are refused if ``strict``."""
    if strict and not keys.select(*node(dims)).join(leaves, node(dims), "left_anti").isEmpty():
        raise ValueError("only leaves can be refined")
    hit = leaves.join(keys.select(*node(dims)).distinct(), node(dims), "left_semi").select(*node(dims))
    return leaves.select(*node(dims)).join(hit, node(dims), "left_anti").unionByName(children(hit, dims))


def coarsen(leaves: DataFrame, parents: DataFrame, dims: int, strict: bool = False) -> DataFrame:
    """Replaces complete groups of siblings by the named parents; others change nothing, or are refused if ``strict``."""
    full = parent(leaves, dims).groupBy(*node(dims)).agg(F.count("*").alias("_n")).where(F.col("_n") == 2**dims).drop("_n")
    hit = full.join(parents.select(*node(dims)).distinct(), node(dims), "left_semi")
    if strict and not parents.select(*node(dims)).join(full, node(dims), "left_anti").isEmpty():
        raise ValueError("only parents of leaves alone can take their place")
    return leaves.select(*node(dims)).join(children(hit, dims), node(dims), "left_anti").unionByName(hit)


def find(leaves: DataFrame, keys: DataFrame, dims: int) -> DataFrame:
    """``keys`` with the number of the leaf that equals them, null where none does."""
    return keys.join(leaves.select(*node(dims), "leaf"), node(dims), "left")


def covering(leaves: DataFrame, keys: DataFrame, dims: int, key_id: str) -> DataFrame:
    """For each key the leaf that is it or covers it: (key_id, leaf); keys refined below have none."""
    return ancestors(keys, dims, key_id).join(leaves.select(*node(dims), "leaf"), node(dims)).select(key_id, "leaf")


def step(nodes: DataFrame, mesh: MeshSpec, *keep: str) -> DataFrame:
    """Each node's same-level neighbours ``n_root, level, n_c1 ..`` across every direction ``d1 ..``; steps beyond
    a face that is not periodic are left out."""
    mesh.without_seam()
    dims = mesh.dims
    dirs = F.array(*[F.struct(*[F.lit(x).alias(f"d{d + 1}") for d, x in enumerate(s)]) for s in directions(dims)])
    rows = nodes.withColumn("_dir", F.explode(dirs)).select(*keep, *node(dims), *[F.col(f"_dir.d{d + 1}").alias(f"d{d + 1}") for d in range(dims)])
    inside, index, stride, out = F.lit(True), F.lit(0), 1, []
    for d, c in enumerate(coords(dims)):
        n = shift_left(F.lit(mesh.roots[d]), F.col("level"))
        at = F.floor(F.col("root") / stride).cast("long") % mesh.roots[d]
        moved = shift_left(at, F.col("level")) + F.col(c) + F.col(f"d{d + 1}")
        if mesh.periodic[d]:
            moved = F.pmod(moved, n)
        else:
            inside = inside & (moved >= 0) & (moved < n)
        out.append((moved - shift_left(shift_right(moved, F.col("level")), F.col("level"))).alias(f"n_{c}"))
        index = index + shift_right(moved, F.col("level")) * stride
        stride *= mesh.roots[d]
    return rows.where(inside).select(*keep, "level", *[f"d{d + 1}" for d in range(dims)], index.cast("int").alias("n_root"), *out)


def neighbours(leaves: DataFrame, mesh: MeshSpec) -> DataFrame:
    """Leaves that abut each leaf across each direction: (leaf, d1 .., neighbour, n_level).

    The leaf that is, or covers, the stepped node; else all leaves inside the stepped node that
    touch the shared face, edge or corner.  The tree need not be balanced."""
    dims = mesh.dims
    ds = [f"d{d + 1}" for d in range(dims)]
    anchors = step(leaves, mesh, "leaf").select("leaf", F.col("level").alias("a_level"), *ds, F.col("n_root").alias("root"), "level", *[F.col(f"n_{c}").alias(c) for c in coords(dims)])
    known = leaves.select(*node(dims), F.col("leaf").alias("neighbour"))
    above = ancestors(anchors, dims, "leaf", *ds).join(known, node(dims)).select("leaf", *ds, "neighbour", F.col("level").alias("n_level"))
    # leaves below: their strict ancestors equal the anchor; they touch the near side in every stepped dimension
    fine = leaves.select("root", "level", *coords(dims), F.col("leaf").alias("neighbour"), F.col("level").alias("n_level"), *[F.col(c).alias(f"f_{c}") for c in coords(dims)])
    under = ancestors(fine, dims, "neighbour", "n_level", *[f"f_{c}" for c in coords(dims)], strict=True)
    near = F.lit(True)
    for d, c in enumerate(coords(dims)):
        gap = F.col("n_level") - F.col("a_level")
        low = F.col(f"f_{c}") == shift_left(F.col(c), gap)
        high = F.col(f"f_{c}") == shift_left(F.col(c) + 1, gap) - 1
        near = near & F.when(F.col(ds[d]) == 1, low).when(F.col(ds[d]) == -1, high).otherwise(True)
    below = anchors.join(under, node(dims)).where(near).select("leaf", *ds, "neighbour", "n_level")
    return above.unionByName(below)


def balance(leaves: DataFrame, mesh: MeshSpec, levels: int) -> DataFrame:
    """The coarsest 2:1 balanced refinement of the leaves: touching leaves differ by one level at most.

    One sweep from the finest level: a node that must exist makes its parent's neighbours exist;
    nodes above those that must exist are split."""
    dims = mesh.dims
    keys = leaves.select(*node(dims))
    need = keys.where(F.col("level") == levels)
    inner = None
    for level in range(levels, 0, -1):
        up = cut(parent(need, dims).distinct())  # a level's nodes are used thrice
        inner = up if inner is None else inner.unionByName(up)
        if level > 1:
            around = step(up, mesh).select(F.col("n_root").alias("root"), "level", *[F.col(f"n_{c}").alias(c) for c in coords(dims)])
            need = keys.where(F.col("level") == level - 1).unionByName(up).unionByName(around).distinct()
    if inner is None:
        return keys
    base = roots(leaves.sparkSession, mesh)
    return base.unionByName(children(inner, dims)).join(inner, node(dims), "left_anti")


def is_balanced(leaves: DataFrame, mesh: MeshSpec) -> DataFrame:
    """One row: the largest difference of levels between touching leaves, and whether it is 1 at most."""
    pairs = neighbours(leaves, mesh).join(leaves.select("leaf", "level"), "leaf")
    gap = F.coalesce(F.max(F.abs(F.col("level") - F.col("n_level"))), F.lit(0))
    return pairs.agg(gap.cast("int").alias("max_gap"), (gap <= 1).alias("balanced"))


def check_tiling(leaves: DataFrame, mesh: MeshSpec, levels: int) -> DataFrame:
    """One row: leaves, leaves that stand twice or below another leaf, and whether they tile the brick exactly.

    Volumes are counted in finest cells, exactly; overlaps are equi-joins with the leaves' ancestors."""
    dims = mesh.dims
    keys, total = node(dims), 1
    for r in mesh.roots:
        total *= r
    size = F.call_function("shiftleft", F.lit(1).cast("long"), (F.lit(levels) - F.col("level")) * dims)
    each = leaves.groupBy(*keys).agg(F.count("*").alias("_k"))
    tagged = each.withColumns({f"_{c}": F.col(c) for c in keys})
    below = ancestors(tagged, dims, *[f"_{c}" for c in keys], strict=True).join(each.select(*keys), keys, "left_semi").select(*[F.col(f"_{c}").alias(c) for c in keys]).distinct()
    marked = each.join(below.withColumn("_below", F.lit(1)), keys, "left")
    bad = F.when(F.col("_below") == 1, F.col("_k")).otherwise(F.col("_k") - 1)
    sums = marked.withColumns({"_bad": bad.cast("long"), "_v": size * F.col("_k")})
    full = F.sum("_v") == total * (1 << (dims * levels))
    return sums.agg(F.coalesce(F.sum("_k"), F.lit(0)).alias("n_leaves"), F.coalesce(F.sum("_bad"), F.lit(0)).alias("n_misplaced"), F.coalesce(full & (F.sum("_bad") == 0), F.lit(False)).alias("tiles"))


def split_parts(leaves: DataFrame, parts: int) -> DataFrame:
    """Adds ``part``: an equal split of the curve into ``parts`` runs of leaves, whose sizes differ by one at most."""
    short, extra = divmod(leaves.count(), parts)
    first, at = (short + 1) * extra, F.col("leaf") - 1
    part = F.when(at < first, F.floor(at / (short + 1))).otherwise(extra + F.floor((at - first) / max(short, 1)))
    return leaves.withColumn("part", part.cast("int"))


def part_range(n: int, parts: int, part: int) -> tuple[int, int]:
    """The first and last leaf of a part of ``split_parts``, from 1; last is first - 1 if it is empty."""
    short, extra = divmod(n, parts)
    first = part * short + min(part, extra) + 1
    return first, first + short + (part < extra) - 1


def remote_neighbours(leaves: DataFrame, mesh: MeshSpec, parts: int) -> DataFrame:
    """``(part, other, leaf, neighbour)``: leaves that touch a leaf of another part."""
    placed = split_parts(leaves, parts)
    near = neighbours(leaves, mesh).select("leaf", "neighbour").distinct()
    both = near.join(placed.select("leaf", "part"), "leaf").join(placed.select(F.col("leaf").alias("neighbour"), F.col("part").alias("other")), "neighbour")
    return both.where("part <> other").select("part", "other", "leaf", "neighbour")
