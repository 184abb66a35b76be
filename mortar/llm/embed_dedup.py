"""Embedding near-dedup by random hyperplanes (operator 2).

Vectors of one label (and length) link at cosine >= ``threshold`` (0.98), computed in double
precision.  Equal vectors of a label are one class, so copies are never compared.

Search.  Each class gets, in several tables, the signs of its products with ``bits`` random
hyperplanes; ``bits`` grows with the logarithm of the rows (12 at least), which keeps buckets small, and there are
as many tables as make the chance to miss a link at the threshold itself less than
``MISS`` (1e-4; less for closer vectors).  Only table, bucket and class number are shuffled to find buckets with two
classes or more; vectors join these rows alone.  A bucket is compared in cells of two blocks by matrix
products.  A cell counts a pair only in the first table where it meets, so
every link is counted once, and gives a spanning forest of its links, so no group becomes
its list of pairs.  Components come from these forests.

Cases.  Vectors that are null, empty, zero, or hold null, NaN or infinite components, and rows
without a label, link with nothing (``n_links`` 0, a component of their own).  Repeated rows are rows of their own
and link with each other.  A null id is kept.  Empty tables are fine.  Other columns are not read.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

THRESHOLD, MISS, LEAST_BITS, BLOCK, SEED = 0.98, 1e-4, 12, 1024, 20240


def tables_for(bits: int, threshold: float, miss: float = MISS) -> int:
    """Tables so that a pair at the threshold shares a bucket in one of them but for ``miss``."""
    same = (1 - math.acos(threshold) / math.pi) ** bits
    return math.ceil(math.log(miss) / math.log(1 - same))


def codes_of(x: np.ndarray, bits: int, tables: int) -> np.ndarray:
    """Rows by tables: the signs of products with fixed hyperplanes, as integers."""
    planes = np.random.default_rng(SEED).standard_normal((tables * bits, x.shape[1]))
    signs = (x @ planes.T >= 0).reshape(len(x), tables, bits)
    return signs @ (1 << np.arange(bits, dtype=np.int64))


def near_dedup(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", threshold: float = THRESHOLD, block: int = BLOCK, bits: int | None = None) -> DataFrame:
    """One row per row of ``vectors``: id, n_links, component_id, kept."""
    rows = vectors.select(F.col(id_col).alias("id"), F.col(label_col).alias("label"), F.col(vector_col).cast("array<double>").alias("v"))
    fine = lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))
    ok = F.col("label").isNotNull() & F.coalesce(F.forall("v", fine) & F.exists("v", lambda c: c != 0), F.lit(False))
    valid = rows.where(ok)
    grouped = valid.groupBy("label", "v").agg(F.count("*").alias("w"), F.min("id").alias("rep"))
    classes = common.cut(grouped.withColumn("c", F.monotonically_increasing_id()))
    n = classes.count()
    bits = bits or max(LEAST_BITS, math.ceil(math.log2(max(2, n))))
    tables = tables_for(bits, threshold)

    def signs(batch: pa.RecordBatch) -> pa.RecordBatch:
        lists = batch.column(1)
        flat, size = lists.flatten().to_numpy(zero_copy_only=False), np.diff(lists.offsets.to_numpy())
        first = np.cumsum(size) - size
        codes = np.empty((len(size), tables), np.int64)
        for width in np.unique(size):
            at = np.flatnonzero(size == width)
            x = flat[first[at][:, None] + np.arange(width)]
            codes[at] = codes_of(x, bits, tables)
        out = pa.ListArray.from_arrays(pa.array(np.arange(len(size) + 1) * tables, pa.int32()), pa.array(codes.ravel()))
        return pa.RecordBatch.from_arrays([batch.column(0), out, pa.array(size, pa.int32())], names=["c", "codes", "d"])

    coded = common.map_rows(classes.select("c", "v"), signs, "c long, codes array<long>, d int")
    keyed = common.cut(coded.join(classes.select("c", "label"), "c"))
    spread = keyed.select("c", "label", "d", F.posexplode("codes").alias("t", "k"))
    dealt = common.cells(spread, ["label", "d", "t", "k"], F.col("c"), block)
    vectors_of = classes.select("c", "v", "w").join(keyed.select("c", "codes"), "c")
    full = dealt.join(vectors_of, "c").withColumn("l", F.xxhash64("label"))

    def cell(x: dict) -> list | None:
        own, t = x["own"].to_numpy(), int(x["t"][0].as_py())
        order = np.argsort(own, kind="stable")
        own = own[order]
        ids, w = x["c"].to_numpy()[order], x["w"].to_numpy()[order]
        size = len(ids)
        v = x["v"].flatten().to_numpy(zero_copy_only=False).reshape(size, -1)[order]
        v = v / np.sqrt((v * v).sum(1))[:, None]
        codes = x["codes"].flatten().to_numpy(zero_copy_only=False).reshape(size, -1)[order, :t]
        left = int(np.searchsorted(own, own[-1]))
        degree, linked = np.zeros(size, np.int64), []
        near = v[: left or size] @ v[left:].T >= threshold

        for i in range(left or size):
            others = np.flatnonzero(near[i]) + left
            others = others[others > i]
            if len(others):
                linked.append((i, others))
                new = others[~(codes[others] == codes[i]).any(1)]  # met in no earlier table
                degree[i] += w[new].sum()
                degree[new] += w[i]
        if not linked:
            return None
        edges = np.array(common.spanning(size, iter(linked)))
        at = np.flatnonzero(degree)
        a = np.concatenate([ids[edges[:, 0]], ids[at]])
        b = pa.array(np.concatenate([ids[edges[:, 1]], ids[at]]))
        return [a, b, np.concatenate([np.zeros(len(edges), np.int64), degree[at]])]

    found = common.cut(common.each_cell(full, ["l", "d", "t", "k", "bi", "bj"], cell, "a long, b long, n long"))
    degrees = found.where("n > 0").groupBy(F.col("a").alias("c")).agg(F.sum("n").alias("n"))
    tree = common.components(found.where("n = 0"), "a", "b").withColumnRenamed("node", "c")
    rooted = classes.select("c", "label", "v", "w", "rep").join(tree, "c", "left").withColumn("root", F.coalesce("root", "c"))
    lowest = rooted.groupBy("root").agg(F.min("rep").alias("component_id"))
    known = rooted.join(lowest, "root").join(degrees, "c", "left").select("label", "v", "component_id", (F.coalesce("n", F.lit(0)) + F.col("w") - 1).alias("n_links"))
    told = valid.join(known, ["label", "v"]).select("id", "n_links", "component_id")
    alone = rows.where(~ok).select("id", F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id"))
    both = told.unionByName(alone)
    return both.select(F.col("id").alias(id_col), "n_links", "component_id", F.col("id").eqNullSafe(F.col("component_id")).alias("kept"))
