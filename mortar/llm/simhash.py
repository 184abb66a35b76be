"""SimHash near-dedup over pivot distance tables (operator 10).

A text's words are the runs between ASCII white space after A-Z is lowered; its
3-word shingles, repeats included, are hashed by XXH64 (seed 42), and a
fingerprint bit is set where over half the hashes set it.  Fingerprints link
at ``distance`` (3) differing bits or fewer.

Search.  The 64 bits are split into ``SEGMENTS`` (5); fingerprints that differ
in at most 3 bits agree on at least two whole segments.  For each pair of
segments there is a table of the distances, on these segments, from
``PIVOTS`` (12) reference fingerprints: equal segments give equal distances,
so an equi-join on a table's row of distances finds every link.  Candidates
whose distances from 16 full-length reference fingerprints differ by more than
3 in any coordinate are discarded (triangle inequality), and the survivors'
bits are compared.  Nothing is approximate: every link is found.

Equal fingerprints are one node.  A table row with many nodes is compared in
cells of two blocks, each giving a spanning forest, so a group of near copies
never becomes its list of pairs.

Cases.  Null and empty texts have fingerprint zero and link like any other.
Repeated rows give one row each.  A null ``doc_id`` keeps its row; a component
of only such rows has a null ``component_id``.  An empty table gives an empty
table.  Other columns are not read.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

SEGMENTS, PIVOTS, GLOBAL_PIVOTS, BLOCK = 5, 12, 16, 1024
ALL = (1 << 64) - 1


def fingerprint(text: bytes | None, words: int = 3, at_once: int = 1 << 16) -> int:
    """The unsigned fingerprint of UTF-8 ``text``; memory is bounded by the text and ``at_once`` hashes."""
    tokens = (text or b"").lower().split()
    if not tokens:
        return 0
    line = b" ".join(tokens)
    ends = np.cumsum(np.fromiter(map(len, tokens), np.int64, len(tokens)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    if len(tokens) >= words:
        starts, ends = starts[: len(tokens) - words + 1], ends[words - 1 :]
    else:
        starts, ends = starts[:1], ends[-1:]
    digest, counts = xxhash.xxh64_intdigest, np.zeros(64, np.int64)
    for k in range(0, len(starts), at_once):
        pairs = zip(starts[k : k + at_once].tolist(), ends[k : k + at_once].tolist(), strict=True)
        hashes = np.array([digest(line[s:e], 42) for s, e in pairs], dtype=">u8")
        counts += np.add.reduce(np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1), axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(counts * 2 > len(starts)).tobytes(), "big")


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(id, fp)``; ``fp`` is the fingerprint as a signed long."""
    kind = docs.schema[id_col].dataType.simpleString()
    common.small_batches(docs.sparkSession)

    def batch(rows: pa.RecordBatch) -> pa.RecordBatch:
        texts = rows.column(1)
        fps = np.fromiter((fingerprint(t.as_py()) for t in texts), np.uint64, len(texts))
        return pa.RecordBatch.from_arrays([rows.column(0), pa.array(fps.view(np.int64))], names=["id", "fp"])

    return common.map_rows(docs.select(F.col(id_col), F.col(text_col).cast("binary")), batch, f"id {kind}, fp long")


def signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def pivots(n: int, seed: int) -> list[int]:
    """Fixed pseudo-random reference fingerprints."""
    return [xxhash.xxh64_intdigest(f"pivot {i}".encode(), seed) for i in range(n)]


def masks(segments: int = SEGMENTS, agree: int = 2) -> list[int]:
    """The bits of each table: every choice of ``agree`` of the segments."""
    cuts = [64 * i // segments for i in range(segments + 1)]
    parts = [((1 << b) - 1) ^ ((1 << a) - 1) for a, b in zip(cuts, cuts[1:], strict=False)]
    return [sum(chosen) for chosen in combinations(parts, agree)]


def pivot_rows(fps: DataFrame, segments: int = SEGMENTS, agree: int = 2) -> DataFrame:
    """``(fp, t, k)``: for each table t the packed distances k of ``fp`` from its reference fingerprints."""
    tables = []
    for t, mask in enumerate(masks(segments, agree)):
        key = F.lit(0).cast("long")
        for p in pivots(PIVOTS, t + 1):
            far = F.bit_count(F.col("fp").bitwiseXOR(F.lit(signed(p))).bitwiseAND(F.lit(signed(mask))))
            key = F.shiftleft(key, 5).bitwiseOR(far.cast("long"))
        tables.append(F.struct(F.lit(t).alias("t"), key.alias("k")))
    return fps.select("fp", F.explode(F.array(*tables)).alias("x")).select("fp", "x.t", "x.k")


def links(fps: DataFrame, distance: int = 3, block: int = BLOCK, segments: int = SEGMENTS) -> DataFrame:
    """Edges ``(a, b)`` that join exactly the distinct fingerprints ``fps.fp`` which links of ``distance`` bits join."""
    agree = segments - distance
    refs = np.array(pivots(GLOBAL_PIVOTS, 0), np.uint64)

    def cell(x: dict) -> list | None:
        v = x["fp"].to_numpy().view(np.uint64)
        own = x["own"].to_numpy()
        order = np.argsort(own, kind="stable")
        v, own = v[order], own[order]
        rows, left = len(v), int(np.searchsorted(own, own[-1]))  # two blocks, or one if left is 0
        far = np.bitwise_count(v[None, :] ^ refs[:, None]).astype(np.int8)

        def found():
            for i in range(left or rows - 1):
                others = np.arange(left or i + 1, rows)
                for d in far:  # discard by one coordinate after another
                    others = others[np.abs(d[others] - d[i]) <= distance]
                    if not len(others):
                        break
                else:
                    yield i, others[np.bitwise_count(v[others] ^ v[i]) <= distance]

        edges = common.spanning(rows, found())
        if not edges:
            return None
        e = np.array(edges)
        return [v[e[:, 0]].view(np.int64), v[e[:, 1]].view(np.int64)]

    dealt = common.cells(pivot_rows(fps, segments, agree), ["t", "k"], F.col("fp"), block)
    return common.each_cell(dealt, ["t", "k", "bi", "bj"], cell, "a long, b long")


def classes(each: DataFrame, distance: int) -> DataFrame:
    """``(fp, rep, root)``: every fingerprint, its smallest id, and its component's smallest fingerprint."""
    nodes = each.groupBy("fp").agg(F.min("id").alias("rep"))
    tree = common.components(links(nodes.select("fp"), distance), "a", "b").withColumnRenamed("node", "fp")
    return nodes.join(tree, "fp", "left").withColumn("root", F.coalesce("root", "fp"))


def near_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", distance: int = 3) -> DataFrame:
    """One row per row of ``docs``: id, fingerprint (16 hex digits), component_id (smallest id reachable)."""
    each = common.cut(fingerprints(docs, id_col, text_col))
    rooted = classes(each, distance)
    lowest = rooted.groupBy("root").agg(F.min("rep").alias("component_id"))
    named = rooted.join(lowest, "root").select("fp", "component_id")
    return each.join(named, "fp").select(F.col("id").alias(id_col), F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", distance: int = 3) -> DataFrame:
    """``docs`` with one row of each component: that of the smallest id (of rows that share it and the fingerprint, the first by content).

    Whole rows are shuffled once, by id; only rows whose id is null or comes again are hashed once more."""
    each = common.cut(fingerprints(docs, id_col, text_col))
    rooted = classes(each, distance)
    first = F.min(F.struct(F.col("rep").isNull().alias("none"), "rep", "fp")).alias("m")
    rep, kept_fp, fp = (common.unused(docs, x) for x in ("rep", "kept", "fp"))
    kept = common.cut(rooted.groupBy("root").agg(first).select(F.col("m.rep").alias(rep), F.col("m.fp").alias(kept_fp)))
    again = common.cut(each.groupBy("id").count().where("count > 1 or id is null").select(F.col("id").alias(rep)))
    single = docs.join(kept.join(again, rep, "left_anti").where(F.col(rep).isNotNull()), F.col(id_col) == F.col(rep), "left_semi")
    if again.isEmpty():
        return single

    @F.arrow_udf("long")
    def hashed(texts: pa.Array) -> pa.Array:
        return pa.array(np.fromiter((fingerprint(t.as_py()) for t in texts), np.uint64, len(texts)).view(np.int64))

    shared = docs.join(again, F.col(id_col).eqNullSafe(F.col(rep)), "left_semi").withColumn(fp, hashed(F.col(text_col).cast("binary")))
    found = shared.join(kept, (F.col(fp) == F.col(kept_fp)) & F.col(id_col).eqNullSafe(F.col(rep)), "left_semi")
    row = F.struct(*docs.columns)
    one = found.groupBy(id_col, fp).agg(F.min_by(row, F.struct(F.col(text_col), F.xxhash64(F.to_json(row)))).alias(rep))
    return single.unionByName(one.select(f"{rep}.*"))
