"""K-d tree sharding by distributed weighted medians (operator 9), DataFrame functions only.

The rows' metadata (size, id, language, source, CRC-32 of the text) is written once to a
checkpoint.  A node that must give k shards is split along its widest dimension, at
the weighted median (the k // 2 : k - k // 2 quantile of bytes), until every
leaf has one shard's bytes.  A dimension is scaled to 24 bits over the whole
table and continued by 32 bits of a row hash, so equal values, down to
groups of equal texts, can be split and sizes come out near equal.  The
median is found by histogram refinement: four grouped sums of 2**14 bins, of
which only the bins along the way go to the driver.

Slots number a shard's rows from 0 without gaps: each shard is cut into blocks
of about ``SLOT_ROWS`` rows by row hash; a window numbers each block, and the blocks'
counts give the offsets.  No task holds a shard.

Law: ``bytes`` (sizes of the shards near equal).  ``grown_shard`` is null.

Cases.  A null text has no bytes (size 1, CRC 0).  Null metadata sort first.
Repeated rows are rows of their own.  An empty table gives an empty table.
Other columns are not read, and missing ``lang`` or ``source`` count as null.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import NumericType
from pyspark.sql.window import Window

from . import common

SCALE_BITS, TIE_BITS, STEP_BITS, SLOT_ROWS = 24, 32, 14, 50_000
DIMENSIONS = ("size", "id", "lang", "source", "text_crc32")


def ordinal(text: Column) -> Column:
    """Strings as longs in byte order of their first six bytes."""
    return F.conv(F.rpad(F.hex(F.substring(F.encode(text, "UTF-8"), 1, 6)), 12, "0"), 16, 10).cast("long")


def metadata(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    raw = F.col(text_col).cast("binary")
    named = {c: F.col(c) if c in docs.columns else F.lit(None).cast("string") for c in ("lang", "source")}
    number = F.col(id_col).cast("long") if isinstance(docs.schema[id_col].dataType, NumericType) else ordinal(F.col(id_col).cast("string"))
    rows = docs.select(
        F.col(id_col).alias("_id"),
        (F.coalesce(F.octet_length(raw), F.lit(0)).cast("long") + 1).alias("size"),
        F.coalesce(F.crc32(raw), F.lit(0)).cast("long").alias("text_crc32"),
        *[F.coalesce(ordinal(c.cast("string")), F.lit(-1)).alias(name) for name, c in named.items()],
        F.coalesce(number, F.lit(-1)).alias("id"),
        F.monotonically_increasing_id().alias("_row"),
    )
    tie = F.pmod(F.xxhash64("_id", "text_crc32", "_row"), F.lit(1 << TIE_BITS))
    return rows.withColumn("_tie", tie)


def of_node(values: dict[int, Column | int]) -> Column:
    """The value that belongs to a row's node."""
    first, *rest = values.items()
    case = F.when(F.col("_node") == first[0], first[1])
    for n, v in rest:
        case = case.when(F.col("_node") == n, v)
    return case


def split_points(rows: DataFrame, shares: dict[int, float]) -> dict[int, int]:
    """For each node the key t such that rows with _key <= t hold about its share of the node's bytes.

    Keys have SCALE_BITS + TIE_BITS bits; each pass fixes STEP_BITS more of t."""
    head, before, total = dict.fromkeys(shares, 0), dict.fromkeys(shares, 0), {}
    for left in range(SCALE_BITS + TIE_BITS - STEP_BITS, -1, -STEP_BITS):
        inside = rows.where(F.shiftright("_key", left + STEP_BITS) == of_node({n: F.lit(h).cast("long") for n, h in head.items()}))
        by: dict[int, list] = {n: [] for n in shares}
        for r in inside.groupBy("_node", F.shiftright("_key", left).alias("b")).agg(F.sum("size").alias("w")).collect():
            by[r["_node"]].append((r["b"], r["w"]))
        for n, found in by.items():
            found.sort()
            total.setdefault(n, sum(w for _, w in found))
            aim = shares[n] * total[n]
            for k, (b, w) in enumerate(found):
                if before[n] + w >= aim or k == len(found) - 1:
                    head[n] = b
                    if left == 0 and aim - before[n] < before[n] + w - aim:
                        head[n] = b - 1  # nearer without the last row
                    break
                before[n] += w
    return head


def kd_shards(docs: DataFrame, shards: int = 8, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: id, size, text_crc32, law, shard, slot, grown_shard."""
    rows = common.cut(metadata(docs, id_col, text_col))
    n_rows = rows.count()
    range_of = rows.agg(*[f(d).alias(f"{f.__name__}_{d}") for d in DIMENSIONS for f in (F.min, F.max)]).first()

    def scaled(d: str) -> Column:
        low, high = range_of[f"min_{d}"], range_of[f"max_{d}"]
        step = ((F.col(d) - F.lit(low)).cast("double") / float(high - low + 1) * (1 << SCALE_BITS)).cast("long")
        return F.shiftleft(F.least(step, F.lit((1 << SCALE_BITS) - 1)), TIE_BITS).bitwiseOR(F.col("_tie"))

    rows, leaves = rows.withColumn("_node", F.lit(0)), {0: (0, shards)}  # node -> its first shard, and how many
    while n_rows and any(k > 1 for _, k in leaves.values()):
        wide = rows.groupBy("_node").agg(*[(F.max(d) - F.min(d)).cast("double").alias(d) for d in DIMENSIONS]).collect()
        pick = {r["_node"]: max(DIMENSIONS, key=lambda d: r[d] / (range_of[f"max_{d}"] - range_of[f"min_{d}"] + 1)) for r in wide}  # noqa: B023
        open_ = {n: v for n, v in leaves.items() if v[1] > 1 and n in pick}
        if not open_:
            break
        keyed = common.cut(rows.withColumn("_key", of_node({n: scaled(pick[n]) for n in open_})))
        points = split_points(keyed, {n: (k // 2) / k for n, (_, k) in open_.items()})
        low = F.col("_key") <= of_node({n: F.lit(p).cast("long") for n, p in points.items()})
        after = {n: v for n, v in leaves.items() if n not in open_}
        for n, (first, k) in open_.items():
            after[2 * n + 1], after[2 * n + 2] = (first, k // 2), (first + k // 2, k - k // 2)
        child = F.when(low, 2 * F.col("_node") + 1).when(~low, 2 * F.col("_node") + 2).otherwise(F.col("_node"))
        rows, leaves = keyed.withColumn("_node", child).drop("_key"), after
    placed = rows.withColumn("shard", of_node({n: F.lit(first) for n, (first, _) in leaves.items()}).cast("int"))
    blocks = max(1, math.ceil(n_rows / SLOT_ROWS))
    placed = common.cut(placed.withColumn("_block", F.pmod("_tie", F.lit(blocks))))
    counts = placed.groupBy("shard", "_block").agg(F.count("*").alias("_c"))
    offsets = counts.withColumn("_from", F.sum("_c").over(Window.partitionBy("shard").orderBy("_block")) - F.col("_c")).drop("_c")
    within = F.row_number().over(Window.partitionBy("shard", "_block").orderBy("text_crc32", "_id", "_row"))
    numbered = placed.withColumn("_rank", within).join(offsets, ["shard", "_block"])
    return numbered.select(
        F.col("_id").alias(id_col), "size", "text_crc32", F.lit("bytes").alias("law"), "shard",
        (F.col("_from") + F.col("_rank") - 1).cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"),
    )
