"""Byte-level BPE encoding and decoding (operator 8).

Encoding is one narrow stage, without a shuffle:

0. The first ``SAMPLE_ROWS`` rows of one partition (``SAMPLE_CHARS`` characters of each) give the commonest words, at most
   ``KNOWN_WORDS``; they are folded as in step 2 once for all tasks and sent to them.  A word that is not among them is folded by each task that meets it.
1. A Python function splits texts by the tokenizer's pattern and gives, for each block
   of about ``BLOCK_BYTES`` of text, the distinct words that are new to the task as arrays of bytes' tokens, and each
   text's words as numbers.  After ``CACHE_WORDS`` new words the numbers start anew.
2. Higher-order functions fold the ranked merges over each distinct word's array: every
   step merges the leftmost pair of least rank, until no pair has a rank.  The state carries
   the ranks of all pairs, so a step looks up only the two pairs beside the merge.
   The rank map is a literal (see ``Merges``).
3. A Python function puts each text's token ids together by index.

A word that is a token needs no merges and is not folded.  A step copies the
word's array, so words of more than ``FOLD_BYTES`` bytes (long runs without a break) are
merged in step 1 by a heap, which takes n log n; the result is the same.

Decoding maps ids to their pieces, a literal array, and concatenates them.

Cases.  Null and empty texts have no tokens.  Repeated rows and null ids
are kept.  An empty table gives an empty table.  Other columns are not read.
Memory is bounded by a block, or by one text if that is longer.
"""

from __future__ import annotations

import base64
import heapq
import json
import pickle
from collections import Counter, defaultdict
from collections.abc import Callable, Iterable
from itertools import chain, count, islice

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

BLOCK_BYTES, FOLD_BYTES, CACHE_WORDS = 2 << 20, 2048, 450_000
SAMPLE_ROWS, SAMPLE_CHARS, KNOWN_WORDS = 6000, 4000, 250_000

#: A pair's value is BIAS + rank, or null or something greater where the pair has no rank; tokens are not negative.
BIAS = -(1 << 33)


def load_ranks(path: str) -> dict[bytes, int]:
    """Ranks from a file of base64 pieces and numbers."""
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


def wide(raw: bytes) -> str:
    """Bytes as characters U+0000 to U+00FF."""
    return raw.decode("latin-1")


def bound(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def displaced(pairs: dict[tuple[int, int], int], n: int, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """The pairs' ranks as rows of one array that are shifted into each other's gaps: ``(shift, cells)``.

    ``cells[shift[a] + b]`` holds BIAS + (a << bits) + rank for a pair (a, b) that has a rank; else it is 0, which stands
    for null, or another token's.
    """
    rows: dict[int, list[int]] = {}
    for a, b in pairs:
        rows.setdefault(a, []).append(b)
    size = 3 * len(pairs) // 2 + n
    taken, shift = np.zeros(size + n, bool), np.zeros(n + 1, np.int64)
    rng, near = np.random.default_rng(1), 0
    for a, row in sorted(rows.items(), key=lambda x: (-len(x[1]), x[0])):
        bs = np.array(row)
        if len(bs) > 16:  # the next place that is free
            ok = np.zeros(0, np.int64)
            while not len(ok):
                if near + 512 > size - n:
                    size *= 2
                    taken = np.concatenate([taken, np.zeros(size + n - len(taken), bool)])
                ok = np.arange(near, near + 512)
                for k in range(0, len(bs), 64):
                    ok = ok[~taken[ok[:, None] + bs[k : k + 64]].any(axis=1)]
                near = int(ok[0]) if len(ok) else near + 512
            at = near
        else:
            while taken[(at := int(rng.integers(0, size - n))) + bs].any():
                pass
        taken[at + bs] = True
        shift[a] = at
    cells = np.zeros(int(np.flatnonzero(taken)[-1]) + 1 if pairs else 1, np.int64)
    for (a, b), rank in pairs.items():
        cells[shift[a] + b] = BIAS + (a << bits) + rank
    return shift, cells


def one_row(values: pa.Array) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array([0, len(values)], pa.int32()), values)


class States:
    """The arrays that are folded, one a word: token, value of the pair, token, ..., token, with a token that no
    pair has (``end``) before and behind.  The least element is thus the pair to merge."""

    def __init__(self, pairs: dict[tuple[int, int], int], ranks: dict[bytes, int]) -> None:
        self.end = max(ranks.values(), default=-1) + 1
        self.bits = (self.end + 1).bit_length()
        if self.bits > 16:
            raise ValueError("the literal table holds tokens of 16 bits")
        self.none = BIAS + (1 << self.bits)
        self.single = np.array([ranks.get(bytes([k]), self.end) for k in range(256)], np.int64)
        of = lambda a, b: BIAS + pairs[a, b] if (a, b) in pairs else self.none
        self.of_bytes = np.array([[of(a, b) for b in self.single.tolist()] for a in self.single.tolist()], np.int64)

    def begin(self, words: list[bytes]) -> pa.ListArray:
        """The states of words before any merge."""
        text, n = np.frombuffer(b"".join(words), np.uint8), np.array([len(w) for w in words], np.int64)
        offsets = np.concatenate(([0], np.cumsum(2 * n + 3)))
        out = np.full(int(offsets[-1]), self.end, np.int64)
        at = np.repeat(offsets[:-1] + 2 - 2 * (np.cumsum(n) - n), n) + 2 * np.arange(len(text))
        out[at] = self.single[text]
        out[at[:-1] + 1] = self.of_bytes[text[:-1], text[1:]]
        out[offsets[:-1] + 1] = out[offsets[1:] - 2] = self.none
        return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(out))

    def tokens(self, states: pa.ListArray) -> tuple[np.ndarray, np.ndarray]:
        """The tokens of all states in a row, and how many each has."""
        flat = states.flatten().fill_null(self.none).to_numpy(zero_copy_only=False)
        return flat[(flat >= 0) & (flat != self.end)], (np.diff(states.offsets.to_numpy()) - 3) // 2


class Merges:
    """Folds and look-ups over literal tables of the ranks."""

    def __init__(self, ranks: dict[bytes, int]) -> None:
        pairs = {}
        for piece, rank in ranks.items():
            for k in range(1, len(piece)):
                if (a := ranks.get(piece[:k])) is not None and (b := ranks.get(piece[k:])) is not None:
                    pairs[a, b] = rank
        self.states = States(pairs, ranks)
        self.bits = self.states.bits
        shift, cells = displaced(pairs, self.states.end, self.bits)
        numbers = lambda x: F.from_json(F.lit(json.dumps(x, separators=(",", ":"))), "array<long>")
        self.shift, self.cells = numbers(shift.tolist()), numbers([x or None for x in cells.tolist()])

    def fold(self, states: Column) -> Column:
        """The states after all merges."""
        rest, bits = F.lit(1 << 30), self.bits

        def merge(state: Column, shift: Column, cells: Column) -> Column:
            def beside(a: Column, b: Column) -> Column:
                return F.get(cells, F.get(shift, a) + b).bitwiseXOR(F.shiftleft(a, bits))

            def at(least: Column, p: Column) -> Column:
                new = least.bitwiseAND((1 << bits) - 1)
                left, right = F.get(state, p - 4), F.get(state, p + 2)
                parts = F.slice(state, F.lit(1), p - 3), F.array(beside(left, new), new, beside(new, right)), F.slice(state, p + 3, rest)
                return F.flatten(F.array(*parts))  # concat walks its arguments as a lazy list, which takes longer than the rest of a step

            place = lambda least: bound(F.array_position(state, least).cast("int"), lambda p: at(least, p))
            return bound(F.array_min(state), lambda least: F.when(least < BIAS + (1 << bits), place(least)).otherwise(state))

        def word(state: Column, shift: Column, cells: Column) -> Column:
            steps = F.sequence(F.lit(5), F.size(state), F.lit(2))  # a state of 2n + 3 elements has n - 1 merges at most
            return F.aggregate(steps, state, lambda s, _: merge(s, shift, cells))

        return bound(self.shift, lambda shift: bound(self.cells, lambda cells: F.transform(states, lambda s: word(s, shift, cells))))


def decode_ids(ids: Column, ranks: dict[bytes, int]) -> Column:
    """The bytes that tokens stand for, by a literal array of pieces."""
    pieces = [""] * (max(ranks.values(), default=-1) + 1)
    for piece, rank in ranks.items():
        pieces[rank] = wide(piece)
    known = F.from_json(F.lit(json.dumps(pieces)), "array<string>")
    return F.encode(F.array_join(F.transform(ids, lambda i: F.element_at(known, i + 1)), ""), "ISO-8859-1")


def merge_long(word: bytes, ranks: dict[bytes, int]) -> list[int]:
    """The ids of ``word`` by a heap of pairs, in order of rank and place."""
    n = len(word)
    if word in ranks:
        return [ranks[word]]
    end = list(range(1, n + 1))  # of the piece that starts here; 0 once it is merged away
    before = list(range(-1, n - 1))
    heap: list[tuple[int, int, int]] = []

    def offer(i: int) -> None:
        if i >= 0 and (j := end[i]) < n and (r := ranks.get(word[i : end[j]])) is not None:
            heapq.heappush(heap, (r, i, end[j]))

    for i in range(n - 1):
        offer(i)
    while heap:
        _, i, to = heapq.heappop(heap)
        if not end[i] or end[i] >= n or end[end[i]] != to:
            continue  # one of the two has changed
        j = end[i]
        end[i], end[j] = to, 0
        if to < n:
            before[to] = i
        offer(before[i])
        offer(i)
    out, i = [], 0
    while i < n:
        out.append(ranks[word[i : end[i]]])
        i = end[i]
    return out


def common_words(texts: Iterable[str], ranks: dict[bytes, int], pattern: str, fold_bytes: int) -> list[str]:
    """The commonest words of ``texts`` that are folded, at most ``KNOWN_WORDS``."""
    split, counts = regex.compile(pattern).findall, Counter()
    for t in texts:
        counts.update(split(t))
    return [w for w, _ in counts.most_common() if (b := w.encode()) not in ranks and len(b) <= fold_bytes][:KNOWN_WORDS]


def sampled_words(docs: DataFrame, text_col: str, pattern: str, fold_bytes: int, rows: int, sent, block: int = 4096) -> list[bytes]:
    """Pickled lists of the common words of the middle partition's first ``rows`` rows, read and counted by one task: the driver holds no text."""
    texts = docs.select(F.substring(F.col(text_col).cast("string"), 1, SAMPLE_CHARS)).rdd

    def task(part):
        words = common_words((t for (t,) in islice(part, rows) if t), sent.value[0], pattern, fold_bytes)
        return [pickle.dumps(words[k : k + block]) for k in range(0, len(words), block)]

    parts = texts.getNumPartitions()
    return docs.sparkSession.sparkContext.runJob(texts, task, [parts // 2]) if parts and rows else []


def folded_words(spark: SparkSession, words: list[bytes], merges: Merges, sent) -> tuple[np.ndarray, np.ndarray]:
    """The ids of all words of the pickled lists in a row, and how many each has."""
    if not words:
        return np.zeros(0, np.int32), np.zeros(0, np.int64)

    def begin(batch: pa.RecordBatch) -> pa.RecordBatch:
        states = [one_row(sent.value[1].begin([w.encode() for w in pickle.loads(x.as_py())])) for x in batch.column(1)]
        return pa.RecordBatch.from_arrays([batch.column(0), pa.concat_arrays(states)], names=["k", "words"])

    def end(batch: pa.RecordBatch) -> pa.RecordBatch:
        got = [sent.value[1].tokens(x.values) for x in batch.column(1)]
        columns = [batch.column(0), pa.array([v.astype(np.int32).tobytes() for v, _ in got]), pa.array([n.astype(np.int64).tobytes() for _, n in got])]
        return pa.RecordBatch.from_arrays(columns, names=["k", "ids", "sizes"])

    rows = spark.createDataFrame([(k, bytearray(x)) for k, x in enumerate(words)], "k int, words binary")
    states = common.map_rows(rows, begin, "k int, words array<array<long>>")
    found = sorted(common.map_rows(states.withColumn("words", merges.fold(F.col("words"))), end, "k int, ids binary, sizes binary").collect())
    ids, sizes = (b"".join(bytes(r[c]) for r in found) for c in ("ids", "sizes"))
    return np.frombuffer(ids, np.int32), np.frombuffer(sizes, np.int64)


def encode(
    docs: DataFrame, ranks: dict[bytes, int], pattern: str, id_col: str = "doc_id", text_col: str = "text",
    block_bytes: int = BLOCK_BYTES, cache_words: int = CACHE_WORDS, fold_bytes: int = FOLD_BYTES, sample_rows: int = SAMPLE_ROWS,
) -> DataFrame:
    """One row per row of ``docs``: id and ``tokens``, an array of ids."""
    kind = docs.schema[id_col].dataType.simpleString()
    common.small_batches(docs.sparkSession)
    common.short_plans(docs.sparkSession)
    merges = Merges(ranks)
    context = docs.sparkSession.sparkContext
    sent = context.broadcast((ranks, merges.states))
    sample = sampled_words(docs, text_col, pattern, fold_bytes, sample_rows, sent)
    known, known_ids = context.broadcast(sample), context.broadcast(folded_words(docs.sparkSession, sample, merges, sent))
    common.trim()  # the driver's share: the tables were made in pieces

    def words(batches):
        (ranks, start), split, id_type = sent.value, regex.compile(pattern).findall, None
        index: defaultdict[str, int] = defaultdict()  # the words of this epoch, numbered as they come
        index.default_factory = index.__len__

        def anew() -> int:
            index.clear()
            index.update(zip(chain.from_iterable(map(pickle.loads, known.value)), count(), strict=False))
            return len(index)

        sent_words = n_known = anew()
        fresh = True
        ids, codes, counts, held = [], [], [], 0

        def block() -> pa.RecordBatch:
            new = [w.encode() for w in islice(index, sent_words, None)]
            done = np.array([w in ranks or len(w) > fold_bytes for w in new], bool)
            columns = [
                pa.array([ids], pa.list_(id_type)), one_row(start.begin([w for w, d in zip(new, done, strict=True) if not d])),
                pa.array([[merge_long(w, ranks) for w, d in zip(new, done, strict=True) if d]], pa.list_(pa.list_(pa.int32()))),
                pa.array([done.tobytes()], pa.binary()), pa.array([np.concatenate(codes).tobytes()], pa.binary()),
                pa.array([counts], pa.list_(pa.int32())), pa.array([fresh]),
            ]
            return pa.RecordBatch.from_arrays(columns, names=["ids", "words", "done", "is_done", "codes", "counts", "fresh"])

        for batch in batches:
            id_type = batch.column(0).type
            for i, t in zip(batch.column(0), batch.column(1), strict=True):
                text = t.as_py() or ""
                found = split(text)
                ids.append(i.as_py())
                counts.append(len(found))
                codes.append(np.fromiter(map(index.__getitem__, found), np.int32, len(found)))
                held += len(text)
                if held >= block_bytes:
                    yield block()
                    sent_words, fresh = len(index), len(index) - n_known > cache_words
                    if fresh:
                        sent_words = anew()
                    ids, codes, counts, held = [], [], [], 0
                    pa.default_memory_pool().release_unused()
        if ids:
            yield block()
        index.clear()
        common.trim()

    def together(batches):
        start = sent.value[1]
        values, first, size = np.zeros(0, np.int32), np.zeros(0, np.int64), np.zeros(0, np.int64)
        for batch in batches:
            for k in range(batch.num_rows):
                ids, folded, done, kinds, packed, counts, fresh = (batch.column(c)[k] for c in range(7))
                if fresh.as_py():
                    values, size = known_ids.value
                    first = np.cumsum(size) - size
                # the new words' ids go behind those of the epoch's words so far
                is_done = np.frombuffer(kinds.as_py(), bool)
                new_first, new_size = np.zeros(len(is_done), np.int64), np.zeros(len(is_done), np.int64)
                whole = done.values.flatten().to_numpy(zero_copy_only=False), np.diff(done.values.offsets.to_numpy())
                for (flat, n), mask in ((start.tokens(folded.values), ~is_done), (whole, is_done)):
                    new_size[mask], new_first[mask] = n, len(values) + np.cumsum(n) - n
                    values = np.concatenate([values, flat.astype(np.int32)])
                first, size = np.concatenate([first, new_first]), np.concatenate([size, new_size])
                code = np.frombuffer(packed.as_py(), np.int32)
                at, offsets, chunks = 0, [0], []
                for end in np.cumsum(counts.values.to_numpy()).tolist():  # text by text: no array is longer than a text's tokens
                    n, f = size[code[at:end]], first[code[at:end]]
                    total = int(n.sum())
                    chunks.append(values[np.repeat(f - (np.cumsum(n) - n), n) + np.arange(total)])
                    offsets.append(offsets[-1] + total)
                    at = end
                tokens = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(np.concatenate(chunks)))
                yield pa.RecordBatch.from_arrays([ids.values, tokens], names=["id", "tokens"])
                pa.default_memory_pool().release_unused()
        del values, first, size
        common.trim()

    blocks = docs.select(id_col, F.col(text_col).cast("string").alias("t")).mapInArrow(words, f"ids array<{kind}>, words array<array<long>>, done array<array<int>>, is_done binary, codes binary, counts array<int>, fresh boolean")
    folded = blocks.withColumn("words", merges.fold(F.col("words")))
    return folded.mapInArrow(together, f"id {kind}, tokens array<int>").withColumnRenamed("id", id_col)


def decode(tokens: DataFrame, ranks: dict[bytes, int], tokens_col: str = "tokens", out: str = "decoded") -> DataFrame:
    """Adds the bytes that a row's tokens stand for."""
    return tokens.withColumn(out, decode_ids(F.col(tokens_col), ranks))


def digests(docs: DataFrame, ranks: dict[bytes, int], pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: id, n_tokens, ids_sha256, decoded_sha256."""
    both = decode(encode(docs, ranks, pattern, id_col, text_col), ranks)
    return both.select(
        id_col, F.size("tokens").cast("long").alias("n_tokens"),
        F.sha2(F.concat_ws(" ", F.col("tokens").cast("array<string>")).cast("binary"), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )
