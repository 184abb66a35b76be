"""Pieces that several operators share: tables, checkpoints, cells, components.

*Cells* compare the rows of one bucket without emitting the bucket's pairs:
a bucket of any size is split into blocks of about ``block`` rows, each pair
of blocks is one cell, and a Python function sees one cell (two blocks) at a
time, in a stream over a sorted partition.  A function that returns a spanning
forest of the links it finds keeps the output linear in the rows it reads.

*Components* are the alternating large-star/small-star rounds on an edge
table.  Every step is an aggregate and a join on one key; the join's small
side has one row a key, so AQE can split a hot hub.  The lineage of a round is
cut by a reliable checkpoint.
"""

from __future__ import annotations

import contextlib
import ctypes
import tempfile
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder for checkpoints that the cluster names (a temporary one only
    where the session names none, as in tests)."""
    context = spark.sparkContext
    if not context.getCheckpointDir():
        named = context.getConf().get("spark.checkpoint.dir")
        if not named and not context.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        context.setCheckpointDir(named or tempfile.mkdtemp(prefix="mortar-"))
    return context.getCheckpointDir()


def cut(df: DataFrame) -> DataFrame:
    """Reliable checkpoint in the shared folder."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def remove(spark: SparkSession, path: str) -> None:
    """Removes a folder, wherever Spark writes."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def unused(df: DataFrame, stem: str) -> str:
    """A column name that ``df`` does not have."""
    name = f"_{stem}"
    while name.lower() in {c.lower() for c in df.columns}:
        name = f"_{name}"
    return name


def small_batches(spark: SparkSession, size: str = "8m") -> None:
    """Arrow batches of at most ``size`` for the session, so that a batch of long texts stays small in every worker."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", size)


def short_plans(spark: SparkSession, size: str = "100k") -> None:
    """Plans of the session are described in ``size`` characters at most, so that literal tables do not fill the driver's records."""
    spark.conf.set("spark.sql.maxPlanStringLength", size)


def lower_ascii(text: Column) -> Column:
    """A-Z to lower case, all else as it is."""
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def trim() -> None:
    """Gives what was freed back to the system: a worker outlives its task, and what it holds counts beside the next."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(AttributeError, OSError):  # glibc alone has it
        ctypes.CDLL(None).malloc_trim(0)


def map_rows(df: DataFrame, fn: Callable, schema: str) -> DataFrame:
    """``fn`` maps a record batch to a record batch or a list of columns; column names come from ``schema``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                yield fn(batch)
        trim()

    return df.mapInArrow(run, schema)


# -- cells ------------------------------------------------------------------


def cells(rows: DataFrame, key: list[str], salt: Column, block: int) -> DataFrame:
    """Rows of buckets with two rows or more, dealt to cells.

    Adds ``bi <= bj`` (the cell's blocks) and ``own`` (the row's block).
    A bucket of n rows has ceil(n / block) blocks; ``salt`` deals its rows to
    them, so it must differ between the rows of a bucket.
    """
    sizes = rows.groupBy(*key).agg(F.count("*").alias("_n")).where("_n > 1")
    blocks = F.ceil(F.col("_n") / block).cast("int")
    own = F.pmod(F.xxhash64(salt), F.col("_b")).cast("int")
    dealt = rows.join(sizes, key).withColumn("_b", blocks).withColumn("own", own)
    other = dealt.withColumn("_o", F.explode(F.sequence(F.lit(0), F.col("_b") - 1)))
    return other.withColumns({"bi": F.least("own", "_o"), "bj": F.greatest("own", "_o")}).drop("_n", "_b", "_o")


def each_cell(df: DataFrame, cell: list[str], fn: Callable, schema: str) -> DataFrame:
    """``fn(columns)`` for every cell; ``columns`` maps names to Arrow arrays of
    the cell's rows, and what it returns (a list of arrays, or None) is put out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = None
        held: list[pa.RecordBatch] = []
        out: list[list] = []

        def flush(part: pa.Table) -> None:
            part = part.combine_chunks()
            got = fn({c: part.column(c).combine_chunks() if part.num_rows else None for c in part.column_names})
            if got is not None and len(got[0]):
                out.append(got)

        def packed() -> pa.RecordBatch:
            columns = [pa.concat_arrays([pa.array(x[i]) for x in out]) for i in range(len(out[0]))]
            out.clear()
            return pa.RecordBatch.from_arrays(columns, names=names)

        names = [x.split()[0] for x in schema.split(",")]
        for batch in batches:
            if not batch.num_rows:
                continue
            change = np.zeros(batch.num_rows, dtype=bool)
            for c in cell:
                v = batch.column(c).to_numpy(zero_copy_only=False)
                change[1:] |= v[1:] != v[:-1]
            if held:
                last = held[-1]
                change[0] = any(last.column(c)[-1] != batch.column(c)[0] for c in cell)
            starts = np.flatnonzero(change)
            if not len(starts):
                held.append(batch)
                continue
            if starts[0] > 0:
                held.append(batch.slice(0, int(starts[0])))
            if held:
                flush(pa.Table.from_batches(held))
            ends = [*starts[1:], batch.num_rows]
            whole = pa.Table.from_batches([batch])
            for s, e in zip(starts[:-1], ends[:-1], strict=True):
                flush(whole.slice(int(s), int(e - s)))
            held = [batch.slice(int(starts[-1]))]
            if out:
                yield packed()
        if held:
            flush(pa.Table.from_batches(held))
        if out:
            yield packed()

    return df.repartition(*cell).sortWithinPartitions(*cell).mapInArrow(run, schema)


class Forest:
    """Union-find over small integers; ``link`` says whether two sets were joined."""

    def __init__(self, n: int) -> None:
        self.up = list(range(n))

    def find(self, x: int) -> int:
        up = self.up
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    def link(self, x: int, y: int) -> bool:
        x, y = self.find(x), self.find(y)
        if x == y:
            return False
        self.up[max(x, y)] = min(x, y)
        return True


def spanning(n: int, rows: Iterator[tuple[int, np.ndarray]]) -> list[tuple[int, int]]:
    """A spanning forest of the links that ``rows`` yields as (i, partners of i)."""
    forest, edges = Forest(n), []
    label = np.arange(n)
    for i, partners in rows:
        if not len(partners):
            continue
        for j in partners[np.unique(label[partners], return_index=True)[1]].tolist():
            if forest.link(i, j):
                edges.append((i, j))
                a, b = label[i], label[j]
                label[label == max(a, b)] = min(a, b)
    return edges


# -- connected components ----------------------------------------------------


def components(edges: DataFrame, a: str, b: str) -> DataFrame:
    """``(node, root)`` for every node of an edge that is not its component's
    smallest node; ``root`` is that smallest node.  Loops and repeats are allowed."""

    def tidy(x: DataFrame) -> DataFrame:
        return x.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()

    def mark(x: DataFrame) -> tuple:
        return tuple(x.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())

    now = cut(tidy(edges.select(F.col(a).alias("u"), F.col(b).alias("v")).where("u is not null and v is not null")))
    seen = mark(now)
    while seen[0]:
        # large star: a node's larger neighbours go to its smallest neighbour
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("v"), F.least("u", "m").alias("m"))
        large = tidy(now.join(low, "v").select("u", F.col("m").alias("v")))
        # small star: a node and its smaller neighbours go to the smallest of them
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        now = cut(tidy(small.unionByName(least.select("u", F.col("m").alias("v")))))
        if (mark_now := mark(now)) == seen:
            break
        seen = mark_now
    return now.select(F.col("u").alias("node"), F.col("v").alias("root"))
