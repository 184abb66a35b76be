"""Substring dedup over paragraphs by MinHash banding (operator 5).

Words are the runs between ASCII white space after A-Z is lowered.  A paragraph is a line of
``MIN_WORDS`` (20) words or more, a run of shorter lines joined until it has as many, or a whole text that has fewer.
Two paragraphs are near copies if the Jaccard similarity of their sets of 5-word shingles (64-bit hashes) is 0.8 or more.

Equal paragraphs (by a 128-bit hash of their words) are one class.  A class's MinHash has
``BANDS`` (12) bands of ``ROWS`` (3) minima; a pair at the threshold meets in a
band but for (1 - 0.8**3)**12 = 2e-4.  Only band hashes and class numbers are shuffled to
find bands with two classes or more; just those classes' shingles are then made again
from their documents and compared exactly, in cells of two blocks.  A cell gives a spanning forest of
its links, so no group becomes its list of pairs.  Components of classes are the clusters.

A passage may begin or end inside a line, and a few short lines may stand between long ones, so windows of ``WINDOW`` (20)
words of the whole text are compared as well, line ends being white space.  They begin where the
hash of 5 words is the least of ``REACH`` (30) beginnings in a row, which depends on the words alone:
every run of 49 words that two documents share holds a window that both have.  Windows with equal
words (128 bits) in two documents or more are listed.  Windows have no bands: a word that
differs inside 20 takes up to 5 of 16 shingles of each, which leaves 0.8 only at either end.

The result lists each paragraph of a cluster that spans two documents or more, and each such window
whose first and last word do not both lie in the document's listed paragraphs; the first
(least document id, then place) is kept, the others are removals.

Cases.  Null and empty texts have no paragraphs.  Ids may have any type that is ordered; rows with a null id are
left out of the clusters.  Repeated rows with one id count as one document.  Empty tables give empty results.
Other columns are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

MIN_WORDS, SHINGLE, BANDS, ROWS, THRESHOLD, BLOCK, SEED = 20, 5, 12, 3, 0.8, 512, 7
WINDOW, REACH = 20, 30


# Words are hashed as polynomials of their bytes modulo 2**64, from sums over the whole text.
STEP = 0x9E3779B97F4A7C15
BACK = pow(STEP, -1, 1 << 64)
OF_BYTE = np.random.default_rng(SEED).integers(0, 1 << 64, 256, dtype=np.uint64)
SPACE = np.isin(np.arange(256), [9, 10, 11, 12, 13, 32])


class Powers:
    """Powers of STEP and of its inverse, as many as the longest text needs."""

    up, down = np.ones(1, np.uint64), np.ones(1, np.uint64)

    @classmethod
    def grow(cls, n: int) -> None:
        while len(cls.up) < n:
            k = len(cls.up)
            cls.up = np.concatenate([cls.up, cls.up * np.uint64(pow(STEP, k, 1 << 64))])
            cls.down = np.concatenate([cls.down, cls.down * np.uint64(pow(BACK, k, 1 << 64))])


class Text:
    """A text's word hashes, its paragraphs as (line, first word, end) and its shingles' hashes."""

    def __init__(self, text: bytes) -> None:
        raw = np.frombuffer(text.lower(), np.uint8)
        edges = np.flatnonzero(np.diff(SPACE[raw], prepend=True, append=True))
        starts, stops = edges[::2], edges[1::2]
        Powers.grow(len(raw) + 1)
        sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(OF_BYTE[raw] * Powers.up[: len(raw)])])
        self.words = (sums[stops] - sums[starts]) * Powers.down[starts]
        self.words = (self.words ^ (self.words >> np.uint64(29))) * np.uint64(STEP)
        self.ends = np.append(np.searchsorted(starts, np.flatnonzero(raw == 10)), len(starts))
        self.paragraphs = paragraphs(np.diff(self.ends, prepend=0).tolist())
        size = max(0, len(self.words) - SHINGLE + 1)
        self.grams = np.zeros(size, np.uint64)
        for k in range(SHINGLE):
            self.grams = (self.grams ^ self.words[k : k + size]) * np.uint64(STEP)
            self.grams ^= self.grams >> np.uint64(29)

    def key(self, start: int, end: int) -> bytes:
        return xxhash.xxh3_128_digest(self.words[start:end].tobytes())

    def shingles(self, start: int, end: int) -> np.ndarray:
        """A paragraph's shingles, repeats included; fewer words are one shingle."""
        if end - start < SHINGLE:
            return np.array([xxhash.xxh64_intdigest(self.words[start:end].tobytes())], np.uint64)
        return self.grams[start : end - SHINGLE + 1]

    def windows(self) -> np.ndarray:
        """The first words of the chosen windows: of every REACH beginnings in a row the last of the least hash."""
        size = len(self.words) - WINDOW + 1
        if size < 1:
            return np.zeros(0, np.int64)
        reach, of = min(REACH, size), self.grams[:size]
        least, width = of, 1
        while width < reach:
            more = min(width, reach - width)
            least, width = np.minimum(least[: len(least) - more], least[more:]), width + more
        # a new choice is made where the least hash changes or comes again
        new = np.append(True, (least[1:] != least[:-1]) | (least[1:] == of[reach:]))
        from_ = np.flatnonzero(new)
        back = np.lib.stride_tricks.sliding_window_view(of, reach)[from_, ::-1].argmin(axis=1)
        return np.unique(from_ + reach - 1 - back)

    def within(self, word: np.ndarray) -> np.ndarray:
        """The line that the words' paragraph begins in; -1 for words in no paragraph."""
        line, start, end = np.array(self.paragraphs, np.int64).T
        k = np.searchsorted(start, word, "right") - 1
        return np.where((k >= 0) & (word < end[k]), line[k], -1)


def paragraphs(sizes: list[int]) -> list[tuple[int, int, int]]:
    """``(line, first word, end)`` of the paragraphs of lines with so many words."""
    out, line, start, at = [], 0, 0, 0  # from start on, words of short lines wait
    for k, n in enumerate(sizes):
        if start == at:
            line = k
        if n >= MIN_WORDS:
            line, start = k, at
        at += n
        if at - start >= MIN_WORDS:
            out.append((line, start, at))
            start = at
    return out or ([(line, 0, at)] if at else [])


class MinHash:
    def __init__(self, bands: int = BANDS, rows: int = ROWS) -> None:
        rng = np.random.default_rng(SEED)
        self.shape = bands, rows
        self.a = rng.integers(1, 1 << 63, bands * rows, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
        self.b = rng.integers(0, 1 << 63, bands * rows, dtype=np.uint64)

    def bands(self, sets: list[np.ndarray]) -> np.ndarray:
        """One row of band hashes for each list of shingles."""
        starts = np.concatenate(([0], np.cumsum([len(s) for s in sets])[:-1]))
        h = np.concatenate(sets)
        least = np.empty((len(self.a), len(sets)), np.uint64)
        for k in range(len(self.a)):  # one at a time: a paragraph may be long
            mixed = h * self.a[k] + self.b[k]
            mixed ^= mixed >> np.uint64(31)
            least[k] = np.minimum.reduceat(mixed, starts)
        out = np.repeat(np.arange(1, self.shape[0] + 1, dtype=np.uint64), len(sets)).reshape(self.shape[0], -1)
        for r in range(self.shape[1]):
            out = (out ^ least[r :: self.shape[1]]) * np.uint64(0x9E3779B97F4A7C15)
            out ^= out >> np.uint64(29)
        return out.T


def listed(values: np.ndarray) -> pa.ListArray:
    """Rows of a matrix as lists."""
    n, width = values.shape
    return pa.ListArray.from_arrays(pa.array(np.arange(n + 1) * width, pa.int32()), pa.array(values.ravel()))


def texts_of(batch: pa.RecordBatch):
    """``(row, text)`` of a batch's texts that have words."""
    for k, t in enumerate(batch.column(1)):
        if (x := Text(t.as_py() or b"")).paragraphs:
            yield k, x


def halves(keys: list[bytes]) -> list[pa.Array]:
    """128-bit keys as two columns."""
    return [pa.array(c.copy()) for c in np.frombuffer(b"".join(keys), np.int64).reshape(-1, 2).T]


def each_text(docs: DataFrame, id_col: str, text_col: str, fn, columns: str) -> DataFrame:
    """``fn(batch, texts)`` over (id, text) of the rows that have an id; it gives the ids' rows and the other columns."""
    names = ["id", *(x.split()[0] for x in columns.split(","))]

    def run(batches):
        for batch in batches:
            rows, *rest = fn(batch, texts_of(batch))
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(rows, pa.int32())), *rest], names=names)

    have = docs.where(F.col(id_col).isNotNull()).select(F.col(id_col).alias("id"), F.col(text_col).cast("binary").alias("t"))
    return have.mapInArrow(run, f"id {docs.schema[id_col].dataType.simpleString()}, {columns}")


def parts(docs: DataFrame, id_col: str, text_col: str, with_bands: bool = True) -> DataFrame:
    """``(id, par, n_words, k1, k2, bands)`` of every paragraph; ``bands`` is empty on request."""

    def fn(batch, texts):
        mins, rows, places, keys, sets, held, bands = MinHash(), [], [], [], [], 0, [np.zeros((0, BANDS), np.uint64)]
        for k, x in texts:
            for line, start, end in x.paragraphs:
                rows.append(k)
                places.append((line, end - start))
                keys.append(x.key(start, end))
                if with_bands:
                    sets.append(x.shingles(start, end))
                    held += len(sets[-1])
                    if len(sets) >= 256 or held >= 1 << 18:
                        bands.append(mins.bands(sets))
                        sets, held = [], 0
        if sets:
            bands.append(mins.bands(sets))
        lists = listed(np.concatenate(bands).view(np.int64)) if with_bands else pa.array([[]] * len(rows), pa.list_(pa.int64()))
        par, n = (pa.array(c.copy()) for c in np.array(places, np.int32).reshape(-1, 2).T)
        return rows, par, n, *halves(keys), lists

    return each_text(docs, id_col, text_col, fn, "par int, n_words int, k1 long, k2 long, bands array<long>")


def window_parts(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``(id, word, par, k1, k2, p1, p2)`` of every chosen window: p1 and p2 are the paragraphs of its first and last word."""

    def fn(batch, texts):
        rows, keys, places = [], [], [np.zeros((0, 4), np.int32)]
        for k, x in texts:
            at = x.windows()
            rows += [k] * len(at)
            keys += [x.key(a, a + WINDOW) for a in at.tolist()]
            places.append(np.stack([at, np.searchsorted(x.ends, at, "right"), x.within(at), x.within(at + WINDOW - 1)], axis=1).astype(np.int32))
        word, par, p1, p2 = (pa.array(c.copy()) for c in np.concatenate(places).T)
        return rows, word, par, *halves(keys), p1, p2

    return each_text(docs, id_col, text_col, fn, "word int, par int, k1 long, k2 long, p1 int, p2 int")


def equal_windows(docs: DataFrame, listed_lines: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``(id, word, par, head)``: windows that two documents have, less those that begin and end in ``listed_lines`` (id, par)."""
    # both sides read the same columns of the same exchange, so that the windows are made and shuffled once
    each = window_parts(docs, id_col, text_col).where("k1 is not null and k2 is not null").repartition("k1", "k2")
    shared = each.groupBy("k1", "k2").agg(F.min(F.struct("id", "word", "par", "p1", "p2")).alias("head"), F.max("id").alias("last")).where("head.id <> last")
    shared = shared.select("k1", "k2", F.struct("head.id", "head.word", "head.par").alias("head"))
    found = each.join(shared, ["k1", "k2"]).drop("k1", "k2")
    # a document's lines are one row, as many as it has itself
    by_doc = listed_lines.groupBy("id").agg(F.collect_set("par").alias("pars"))
    inside = F.coalesce(F.array_contains("pars", F.col("p1")) & F.array_contains("pars", F.col("p2")), F.lit(False))
    return found.join(by_doc, "id", "left").where(~inside).select("id", "word", "par", "head")


def shingles_of(docs: DataFrame, wanted: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``(c, h)``: the shingle hashes of the wanted classes, ``wanted`` being (c, id, par)."""

    def run(batches):
        for batch in batches:
            cs, sets, pairs = [], [np.zeros(0, np.int64)], batch.column(2).to_pylist()
            for k, x in texts_of(batch):
                need = {p["par"]: p["c"] for p in pairs[k]}
                for line, start, end in x.paragraphs:
                    if line in need:
                        cs.append(need[line])
                        sets.append(np.unique(x.shingles(start, end)).view(np.int64))
            offsets = np.cumsum([len(s) for s in sets]).astype(np.int32)
            yield pa.RecordBatch.from_arrays([pa.array(cs, pa.int64()), pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(sets)))], names=["c", "h"])

    by_doc = wanted.groupBy("id").agg(F.collect_list(F.struct("par", "c")).alias("pairs"))
    # an id may have several rows: each gives what it has, and repeats go by class; texts are shuffled once
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("binary").alias("t"))
    return texts.join(by_doc, "id").select("id", "t", "pairs").mapInArrow(run, "c long, h array<long>").dropDuplicates(["c"])


def compare(x: dict) -> list | None:
    """A spanning forest of the links in one cell."""
    own = x["own"].to_numpy()
    order = np.argsort(own, kind="stable")
    own, ids = own[order], x["c"].to_numpy()[order]
    sets = [s.values.to_numpy() for s in x["h"]]
    sets = [sets[k] for k in order]
    size, left = len(ids), int(np.searchsorted(own, own[-1]))
    near = lambda both, i, j: both * 10 >= (len(sets[i]) + len(sets[j]) - both) * round(THRESHOLD * 10)
    if size <= 4:  # the usual cell
        pairs = [(i, j) for j in range(size) for i in range(j) if not left or i < left <= j]
        ok = [p for p in pairs if near(len(np.intersect1d(sets[p[0]], sets[p[1]], assume_unique=True)), *p)]
        return [ids[[i for i, _ in ok]], ids[[j for _, j in ok]]] if ok else None
    # count common shingles by sorting all shingles of the cell
    flat, who = np.concatenate(sets), np.repeat(np.arange(size), [len(s) for s in sets])
    by = np.argsort(flat, kind="stable")
    flat, who = flat[by], who[by]
    start = np.searchsorted(flat, flat, "left")
    n = np.array([len(s) for s in sets])
    where: list[list[int]] = [[] for _ in range(size)]
    for k, w in enumerate(who.tolist()):
        where[w].append(k)
    stop = np.searchsorted(flat, flat, "right")

    def found():
        for i in range(left or size):
            common_ = np.zeros(size, np.int64)
            for k in where[i]:
                common_[who[start[k] : stop[k]]] += 1
            union = n[i] + n - common_
            ok = np.flatnonzero(common_ * 10 >= union * round(THRESHOLD * 10))
            yield i, ok[(ok > i) & (ok >= left)]

    edges = np.array(common.spanning(size, found())).reshape(-1, 2)
    return [ids[edges[:, 0]], ids[edges[:, 1]]] if len(edges) else None


def near_paragraphs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", block: int = BLOCK) -> DataFrame:
    """One row per paragraph of a cluster: id, paragraph (line number from 0), n_words, component_id and
    component_paragraph (the cluster's first paragraph), kept; word and component_word are null.  One row
    per window likewise: paragraph is the line it begins in, word its first word's number in the text, from 0."""
    each = parts(docs, id_col, text_col)
    first = F.struct("id", "par")
    rows = common.cut(each.groupBy("k1", "k2").agg(F.min(first).alias("rep"), F.max("id").alias("last"), F.first("bands").alias("bands")).withColumn("c", F.monotonically_increasing_id()))
    spread = rows.select("c", F.explode("bands").alias("k"))
    dealt = common.cut(common.cells(spread, ["k"], F.col("c"), block))
    wanted = dealt.select("c").distinct().join(rows.select("c", "rep.id", "rep.par"), "c")
    full = dealt.join(shingles_of(docs, wanted, id_col, text_col), "c")
    links = common.each_cell(full, ["k", "bi", "bj"], compare, "a long, b long")
    tree = common.components(links, "a", "b").withColumnRenamed("node", "c")
    rooted = rows.select("k1", "k2", "c", "rep", "last").join(tree, "c", "left").withColumn("root", F.coalesce("root", "c"))
    clusters = rooted.groupBy("root").agg(F.min("rep").alias("head"), F.max("last").alias("last")).where("head.id <> last")
    named = rooted.join(clusters.drop("last"), "root").select("k1", "k2", "head")
    lines = common.cut(parts(docs, id_col, text_col, with_bands=False).join(named, ["k1", "k2"]).select("id", "par", "n_words", "head"))
    passages = equal_windows(docs, lines.select("id", "par").distinct(), id_col, text_col)
    none = F.lit(None).cast("int")
    out = lines.select("id", "par", "n_words", F.struct("head.id", none.alias("word"), "head.par").alias("head"), none.alias("word"))
    out = out.unionByName(passages.withColumn("n_words", F.lit(WINDOW)))
    return out.select(
        F.col("id").alias(id_col), F.col("par").alias("paragraph"), "n_words", F.col("head.id").alias("component_id"), F.col("head.par").alias("component_paragraph"),
        ((F.col("id") == F.col("head.id")) & (F.col("par") == F.col("head.par")) & F.col("word").eqNullSafe(F.col("head.word"))).alias("kept"),
        "word", F.col("head.word").alias("component_word"),
    )
