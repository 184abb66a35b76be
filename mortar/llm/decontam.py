"""Benchmark decontamination by a prefix-filtered set join (operator 7).

Words are the runs of ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]`` after A-Z is lowered.  An
item's windows are its runs of ``WINDOW`` (10) consecutive words, or all its words
if it has fewer.  A document word inside any occurrence of a window is hit.

A window is a set of 3-word shingles (of all its words if it has fewer than 3).
A first pass over all documents counts how often each benchmark shingle occurs;
rarity is the order of the shingles.  Containment of the whole window needs all its
shingles, so its prefix is one: the rarest.  The second pass joins the documents'
shingles to the prefixes.  Each hit fixes where the window would start in the
document (positional bound); windows that would not fit between the document's
ends are dropped (length bound), the rest compare word hashes, and then the
words themselves.

Both passes are narrow: no text is shuffled.  The benchmark side goes out in
chunks of at most ``CHUNK_BYTES`` of text, each a broadcast of bounded size.  One
chunk is the usual case; beyond it every chunk is another pass over the
documents, and the hit runs are merged per row.

Cases.  Null and empty texts have no words, on both sides.  Repeated documents
are rows of their own; item rows with the same id count once; a null item id
hits words but is not listed.  An empty benchmark or documents table is
fine.  Other columns are not read.  Long texts are hashed in pieces of
about 1 MB, cut between words.
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common

WINDOW, SHINGLE, CHUNK_BYTES, PIECE = 10, 3, 32 << 20, 1 << 20
BASE = 0x9E3779B97F4A7C15
INVERSE = pow(BASE, -1, 1 << 64)
MIX = (0xBF58476D1CE4E5B9, 0x94D049BB133111EB, 0xD6E8FEB86659FD93)
BITS = 20  # of the first, cheap test whether a shingle is known


def word_table() -> np.ndarray:
    t = np.zeros(256, dtype=bool)
    t[0x30:0x3A] = t[0x61:0x7B] = t[0x80:] = True
    return t


class Words(NamedTuple):
    text: bytes
    start: np.ndarray
    end: np.ndarray
    hash: np.ndarray


class Hasher:
    """Words of a byte string, with 64-bit hashes, in array operations."""

    def __init__(self) -> None:
        self.is_word = word_table()
        self.power = self.back = np.ones(1, np.uint64)
        self.grow(PIECE + (PIECE >> 2))

    def grow(self, n: int) -> None:
        if n >= len(self.power):
            self.power, self.back = (np.cumprod(np.full(n + 1, x, np.uint64)) * np.uint64(pow(x, -1, 1 << 64)) for x in (BASE, INVERSE))

    def piece(self, part: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        raw = np.frombuffer(part, np.uint8)
        inside = np.zeros(len(raw) + 2, np.int8)
        inside[1:-1] = self.is_word[raw]
        edge = np.diff(inside)
        start, end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
        self.grow(len(raw))
        sums = np.zeros(len(raw) + 1, np.uint64)
        np.cumsum((raw.astype(np.uint64) + np.uint64(1)) * self.power[: len(raw)], out=sums[1:])
        h = (sums[end] - sums[start]) * self.back[start]
        h ^= h >> np.uint64(29)
        h *= np.uint64(MIX[0])
        h ^= h >> np.uint64(32)
        return start, end, h

    def words(self, text: bytes) -> Words:
        text = text.lower()
        if len(text) <= PIECE:
            return Words(text, *self.piece(text))
        found, at = [], 0
        while at < len(text):
            to = at + PIECE
            while to < len(text) and self.is_word[text[to]]:
                to += 1
            s, e, h = self.piece(text[at:to])
            found.append((s + at, e + at, h))
            at = to
        return Words(text, *(np.concatenate(x) for x in zip(*found, strict=True)))


def shingles(h: np.ndarray, width: int) -> np.ndarray:
    """A hash for each run of ``width`` word hashes."""
    n = len(h) - width + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = np.full(n, width, np.uint64)
    for k in range(width):
        out = (out ^ h[k : k + n]) * np.uint64(MIX[k % 3])
        out ^= out >> np.uint64(31)
    return out


class Known:
    """A sorted set of shingle hashes with a bitmap before it."""

    def __init__(self, values: np.ndarray) -> None:
        self.values = np.unique(values)
        self.map = np.zeros(1 << BITS, dtype=bool)
        self.map[(self.values >> np.uint64(64 - BITS)).astype(np.int64)] = True

    def find(self, s: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Positions in ``s`` that are known, and their places in ``values``."""
        at = np.flatnonzero(self.map[(s >> np.uint64(64 - BITS)).astype(np.int64)])
        if not len(at) or not len(self.values):
            return at[:0], at[:0]
        k = np.searchsorted(self.values, s[at])
        k[k == len(self.values)] = 0
        ok = self.values[k] == s[at]
        return at[ok], k[ok]


class Item(NamedTuple):
    name: str | None
    words: list[bytes]
    hash: np.ndarray
    width: int  # of its shingles
    length: int  # of its windows


def items_of(rows: list[tuple[str | None, bytes]]) -> list[Item]:
    hasher, out = Hasher(), []
    for name, text in rows:
        w = hasher.words(text)
        if n := len(w.hash):
            cut = [w.text[s:e] for s, e in zip(w.start.tolist(), w.end.tolist(), strict=True)]
            out.append(Item(name, cut, w.hash, min(SHINGLE, n), min(WINDOW, n)))
    return out


def prefixes(items: list[Item], known: Known, counts: np.ndarray) -> tuple[Known, list[list[tuple[int, int, int]]]]:
    """The windows by their rarest shingle: for each, (item, window start, shingle's offset in the window)."""
    by: dict[int, list[tuple[int, int, int]]] = {}
    for i, item in enumerate(items):
        s = shingles(item.hash, item.width)
        rarity = counts[np.searchsorted(known.values, s)]
        span, seen = item.length - item.width + 1, set()
        for at in range(len(item.hash) - item.length + 1):
            if (text := tuple(item.words[at : at + item.length])) in seen:
                continue  # a window that the item repeats
            seen.add(text)
            o = min(range(span), key=lambda k: (rarity[at + k], s[at + k]))  # noqa: B023
            by.setdefault(int(s[at + o]), []).append((i, at, o))
    rare = Known(np.array(sorted(by), np.uint64))
    return rare, [by[int(v)] for v in rare.values]


def runs(w: Words, items: list[Item], rare: Known, windows: list, widths: list[int]) -> tuple[list[tuple[int, int]], set]:
    """The hit runs of words, merged and in order, and the names of the items with windows in ``w``."""
    n, marks, names = len(w.hash), [], set()
    for width in widths:
        for p, k in zip(*(x.tolist() for x in rare.find(shingles(w.hash, width))), strict=True):
            for i, at, o in windows[k]:
                item, start = items[i], p - o
                if item.width != width or start < 0 or start + item.length > n:
                    continue
                if not np.array_equal(w.hash[start : start + item.length], item.hash[at : at + item.length]):
                    continue
                spans = zip(w.start[start : start + item.length].tolist(), w.end[start : start + item.length].tolist(), strict=True)
                if [w.text[s:e] for s, e in spans] == item.words[at : at + item.length]:
                    marks.append((start, start + item.length))
                    names.add(item.name)
    merged: list[tuple[int, int]] = []
    for s, e in sorted(marks):
        if merged and s <= merged[-1][1]:
            merged[-1] = (merged[-1][0], max(e, merged[-1][1]))
        else:
            merged.append((s, e))
    return merged, names - {None}


def chunked(benchmark: DataFrame, item_col: str, text_col: str, chunk_bytes: int):
    """Items in chunks of about ``chunk_bytes`` of text at most."""
    rows = benchmark.select(F.col(item_col).cast("string").alias("name"), F.encode(F.coalesce(F.col(text_col), F.lit("")), "UTF-8").alias("text"))
    total = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = max(1, -(-total // chunk_bytes))
    for i in range(n):
        part = rows if n == 1 else rows.where(F.pmod(F.xxhash64("name", "text"), F.lit(n)) == i)
        yield n, [(r["name"], bytes(r["text"])) for r in part.collect()]


def tables(source: DataFrame, benchmark: DataFrame, item_col: str, item_text: str, chunk_bytes: int):
    """For each chunk of the benchmark: how many there are, and the broadcast that ``runs`` needs.

    ``source`` has the documents' ``text`` as binary; the shingles are counted over all of it."""
    context = source.sparkSession.sparkContext
    for n, rows in chunked(benchmark, item_col, item_text, chunk_bytes):
        items = items_of(rows)
        widths = sorted({x.width for x in items})
        known = Known(np.concatenate([shingles(x.hash, x.width) for x in items] or [np.zeros(0, np.uint64)]))
        sent = context.broadcast((known, widths))

        def count(batches, sent=sent):
            known, widths = sent.value
            hasher, total = Hasher(), np.zeros(len(known.values), np.int64)
            for batch in batches:
                for t in batch.column(0):
                    h = hasher.words(t.as_py() or b"").hash
                    for width in widths:
                        total += np.bincount(known.find(shingles(h, width))[1], minlength=len(total))
            at = np.flatnonzero(total)
            yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], names=["k", "n"])

        counts = np.zeros(len(known.values), np.int64)
        if items:
            for r in source.select("text").mapInArrow(count, "k long, n long").groupBy("k").agg(F.sum("n").alias("n")).collect():
                counts[r["k"]] = r["n"]
        yield n, context.broadcast((items, *prefixes(items, known, counts), widths))


def clean(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id", item_text: str = "text", chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """The rows of ``docs`` without a hit word."""
    out = docs
    for _, held in tables(docs.select(F.col(text_col).cast("binary").alias("text")), benchmark, item_col, item_text, chunk_bytes):
        out = out.where(~has_hit(F.col(text_col).cast("binary"), held))
    return out


def has_hit(text: Column, held: Broadcast) -> Column:
    @F.arrow_udf("boolean")
    def hit(texts: pa.Array) -> pa.Array:
        hasher = Hasher()
        return pa.array([bool(runs(hasher.words(t.as_py() or b""), *held.value)[0]) for t in texts], pa.bool_())

    return hit(text)


def decontaminate(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text", chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """One row per row of ``docs``: id, n_words, n_hit, n_items, items_sha256, contaminated."""
    kind = docs.schema[id_col].dataType.simpleString()
    source = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("binary").alias("text"), F.monotonically_increasing_id().alias("row"))
    parts, fixed = None, None
    for n, held in tables(source, benchmark, item_col, item_text, chunk_bytes):
        if n > 1 and fixed is None:
            fixed = common.cut(source)  # the row numbers must hold over the passes

        def scan(rows: pa.RecordBatch, held=held) -> pa.RecordBatch:
            hasher = Hasher()
            n_words, hit, names = [], [], []
            for t in rows.column(1):
                w = hasher.words(t.as_py() or b"")
                merged, found = runs(w, *held.value)
                n_words.append(len(w.hash))
                hit.append([{"s": s, "e": e} for s, e in merged])
                names.append(sorted(found))
            run = pa.struct([("s", pa.int64()), ("e", pa.int64())])
            columns = [rows.column(0), rows.column(2), pa.array(n_words, pa.int64()), pa.array(hit, pa.list_(run)), pa.array(names, pa.list_(pa.string()))]
            return pa.RecordBatch.from_arrays(columns, names=["id", "row", "n_words", "hit", "names"])

        found = common.map_rows(fixed or source, scan, f"id {kind}, row long, n_words long, hit array<struct<s:long,e:long>>, names array<string>")
        parts = found if parts is None else parts.unionByName(found)
    if n > 1:
        parts = parts.groupBy("row").agg(
            F.first("id").alias("id"), F.first("n_words").alias("n_words"),
            F.array_sort(F.flatten(F.collect_list("hit"))).alias("hit"), F.flatten(F.collect_list("names")).alias("names"),
        )
    # words covered by the runs, which are in order of their starts
    step = lambda a, r: F.struct(
        (a["n"] + F.greatest(F.lit(0).cast("long"), r["e"] - F.greatest(r["s"], a["to"]))).alias("n"), F.greatest(a["to"], r["e"]).alias("to")
    )
    zero = F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).cast("long").alias("to"))
    names = F.array_sort(F.array_distinct("names"))
    n_hit = F.aggregate("hit", zero, step, lambda a: a["n"])
    return parts.select(
        F.col("id").alias(id_col), "n_words", n_hit.alias("n_hit"), F.size(names).cast("long").alias("n_items"),
        F.sha2(F.concat_ws(",", names).cast("binary"), 256).alias("items_sha256"), (n_hit > 0).alias("contaminated"),
    )
