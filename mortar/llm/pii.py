"""PII spans by weak supervision (operator 3).

Base spans come from four patterns, each leftmost and without overlap, and checks
(see ``base_spans``); they always stay.  Further candidates come from looser patterns: spelt-out
addresses, numbers without a plus sign, other separators, digits that fail a check.

Labelers vote on every candidate, 1, 0 or abstain: *regex* (is the form one that the
kind really has), *gazetteer* (known mail words, top-level domains, calling codes, card
issuers), *context* (words around it that announce the kind, or versions, sums, ids) and
*check* (Luhn sums, octets, digit counts).  Expectation-maximisation over the counts
of vote patterns (all candidates of all documents, grouped on the executors)
estimates every labeler's reliability and each pattern's posterior; a logistic span
classifier is then trained on votes and shape with these posteriors as
targets, and adds the candidates it gives ``threshold`` or more, unless they overlap a base span.

What goes to the driver is one row per pattern of votes and shape, of which there are
at most 4 kinds x 3^4 votes x 8 shapes; texts and spans stay on the executors.

Cases.  Null and empty texts have no spans.  Repeated rows and null ids are kept.  Empty tables are
fine.  Other columns are not read.  All scans are linear in the text, also over
long runs of digits, dots or letters.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

KINDS = ("email", "ip", "card", "phone")
LABELERS = ("regex", "gazetteer", "context", "check")
ABSTAIN = 2
AROUND = 48  # characters of context on either side

# every text with a base span or a loose candidate has one of these
TRIGGER = re.compile(r"[0-9@]|(?i:\(at\)|\[at\]|\bat\b ?[a-z0-9-]{1,63} ?(?:\(dot\)|\[dot\]|\bdot\b|\.) ?[a-z0-9-])|[A-Fa-f]:[A-Fa-f]{1,4}:")
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)+")
IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
CARD = re.compile(r"[0-9](?:[ -]?[0-9])++")
PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")

LOOSE = {
    "email": re.compile(r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9][A-Za-z0-9._%+-]{0,63} ?(?i:\(at\)|\[at\]|\bat\b) ?[A-Za-z0-9-]{1,63}(?: ?(?i:\(dot\)|\[dot\]|\bdot\b|\.) ?[A-Za-z0-9-]{1,63})+"),
    "ip": re.compile(r"(?<![0-9A-Za-z.:])(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}(?![0-9A-Za-z:])"),
    "card": re.compile(r"(?<![0-9A-Za-z])[0-9]{4}(?:[ ./_-]?[0-9]{4}){2}[ ./_-]?[0-9]{1,7}(?![0-9A-Za-z])"),
    "phone": re.compile(r"(?<![0-9A-Za-z.+-])(?:00[1-9][0-9]{0,2}[ .-]?)?(?:\([0-9]{2,4}\)|[0-9]{2,4})[ .-][0-9]{3,4}[ .-][0-9]{3,4}(?![0-9A-Za-z])"),
}

# Small gazetteers.
MAIL_WORDS = ("mail", "post", "gmail", "yahoo", "outlook", "example", "inbox")
TOP_DOMAINS = frozenset("com net org edu gov info io de fr es uk eu it nl ch at be pt".split())
CALLING_CODES = ("1", "33", "34", "39", "41", "43", "44", "49", "31", "32", "351")
CARD_ISSUERS = re.compile(r"4|5[1-5]|2[2-7]|3[47]|6011|65|35")
ANNOUNCE = {
    "email": re.compile(r"(?i)e-?mail|contact|write|correo|courriel|schreib"),
    "ip": re.compile(r"(?i)\bip\b|ipv[46]|address|host|server|adresse"),
    "card": re.compile(r"(?i)\bcard|visa|mastercard|credit|tarjeta|carte|karte"),
    "phone": re.compile(r"(?i)phone|\btel\b|mobile|call|fax|tel[eé]fono|t[eé]l[eé]phone|telefon"),
}
DENY = re.compile(r"(?i)version|\bv\.? ?$|isbn|order|invoice|\bid\b|token|hash|sha")


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = int(c) * (1 + k % 2)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def only_digits(s: str) -> str:
    return "".join(c for c in s if "0" <= c <= "9")


def emails(text: str) -> Iterator[tuple[int, int]]:
    done, at = 0, text.find("@")
    while at >= 0:
        if at >= done:
            start = at
            while start > done and text[start - 1] in LOCAL:
                start -= 1
            if start < at and (m := DOMAIN.match(text, at + 1)):
                yield start, m.end()
                done = m.end()
        at = text.find("@", at + 1)


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """The contract's spans by start, then kind; matches that fail their check are dropped."""
    out = [("email", s, e) for s, e in emails(text)] if "@" in text else []
    out += [("ip", m.start(), m.end()) for m in IP.finditer(text) if all(len(p.lstrip("0")) < 4 and int(p[-4:]) <= 255 for p in m[0].split("."))]
    for m in CARD.finditer(text):
        if m.end() - m.start() <= 37 and 12 <= len(d := only_digits(m[0])) <= 19 and luhn(d):
            out.append(("card", m.start(), m.end()))
    if "+" in text:
        out += [("phone", m.start(), m.end()) for m in PHONE.finditer(text) if 9 <= len(only_digits(m[0])) <= 15]
    return sorted(out, key=lambda x: (x[1], KINDS.index(x[0]), x[2]))


def votes(kind: str, text: str, s: int, e: int, base: bool) -> tuple[list[int], int]:
    """The labelers' votes (1, 0, ABSTAIN) and the span's shape (0 to 7)."""
    span, before, after = text[s:e], text[max(0, s - AROUND) : s], text[e : e + AROUND]
    digits = only_digits(span)
    if kind == "email":
        form = bool(re.fullmatch(r"[A-Za-z0-9][A-Za-z0-9._%+-]*@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", span)) or None
        tail = re.split(r"[^A-Za-z0-9]+", span.lower())
        known = 1 if tail[-1] in TOP_DOMAINS else 1 if any(w in span.lower() for w in MAIL_WORDS) else 0
        check = 1 if 2 <= len(tail[-1]) <= 6 and tail[-1].isalpha() else 0
    elif kind == "ip":
        form = True if base or ":" in span else None
        known, check = (0 if span.startswith(("0.", "127.", "255.")) else ABSTAIN), 1
    elif kind == "card":
        form = True if re.fullmatch(r"[0-9]+|[0-9]{4}([ -][0-9]{4}){3}", span) else False
        known, check = (1 if CARD_ISSUERS.match(digits) else 0), int(12 <= len(digits) <= 19 and luhn(digits))
    else:
        form = True if span.startswith("+") else None
        known = 1 if digits.lstrip("0").startswith(CALLING_CODES) and span.startswith(("+", "00")) else ABSTAIN
        check = 1 if 9 <= len(digits) <= 15 else 0
    context = 0 if DENY.search(before) else 1 if ANNOUNCE[kind].search(before + " " + after) else ABSTAIN
    edge = (not before or not (before[-1].isalnum() or before[-1] in "_=\"'/")) and (not after or not (after[0].isalnum() or after[0] in "_/"))
    return [ABSTAIN if form is None else int(form), known, context, check], 4 * base + 2 * edge + (len(span) > 14)


def code_of(text: str, span: tuple[str, int, int], base: bool) -> int:
    """Votes and shape as one number."""
    found, shape = votes(span[0], text, span[1], span[2], base)
    code = 0
    for x in found:
        code = 3 * code + x
    return 8 * code + shape


def candidates(text: str, base: list[tuple[str, int, int]]) -> list[tuple[str, int, int]]:
    """Looser spans that do not overlap a base span."""
    out, starts, reach = [], [s for _, s, _ in base], list(accumulate((e for *_, e in base), max))  # base is in order of start
    for kind in KINDS:
        last = -1
        for m in LOOSE[kind].finditer(text):
            before = bisect_left(starts, m.end())  # base spans that begin before its end
            if m.start() >= last and (not before or reach[before - 1] <= m.start()):
                out.append((kind, m.start(), m.end()))
                last = m.end()
    return out


def scan(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``(id, base, found)`` of every row: base spans as text, candidates as structs of span, pattern code and base flag."""
    kind_type = docs.schema[id_col].dataType.simpleString()
    span = pa.struct([("kind", pa.int32()), ("s", pa.int32()), ("e", pa.int32()), ("code", pa.int32()), ("base", pa.bool_())])

    def run(rows: pa.RecordBatch) -> pa.RecordBatch:
        found = []
        for t in rows.column(1):
            text, here = t.as_py() or "", []
            if TRIGGER.search(text):
                base = base_spans(text)
                for is_base, spans in ((True, base), (False, candidates(text, base))):
                    for k, s, e in spans:
                        here.append({"kind": KINDS.index(k), "s": s, "e": e, "code": code_of(text, (k, s, e), is_base), "base": is_base})
            found.append(here)
        return pa.RecordBatch.from_arrays([rows.column(0), pa.array(found, pa.list_(span))], names=["id", "found"])

    return common.map_rows(docs.select(id_col, F.col(text_col).cast("string").alias("t")), run, f"id {kind_type}, found array<struct<kind:int,s:int,e:int,code:int,base:boolean>>")


def votes_of(code: int) -> list[int]:
    code //= 8
    return [code // 3 ** (len(LABELERS) - 1 - k) % 3 for k in range(len(LABELERS))]


def expect(counts: dict[int, int], rounds: int = 50) -> tuple[dict[int, float], np.ndarray]:
    """Posteriors of the vote patterns and the labelers' reliabilities P(vote | class), by EM."""
    codes = sorted(counts)
    v, n = np.array([votes_of(c) for c in codes]), np.array([counts[c] for c in codes], float)
    tally = (v == 1).sum(1) - (v == 0).sum(1)
    q = 1 / (1 + np.exp(-1.5 * tally + 0.5))
    for _ in range(rounds):
        prior = np.clip((n * q).sum() / n.sum(), 0.01, 0.99)
        table = np.empty((len(LABELERS), 2, 3))
        for k in range(len(LABELERS)):
            for y, w in ((1, n * q), (0, n * (1 - q))):
                # prior counts: a labeler is right more often than wrong
                seen = np.bincount(v[:, k], w, 3) + np.array([4.0, 1.0, 2.0] if y == 0 else [1.0, 4.0, 2.0])
                table[k, y] = seen / seen.sum()
        odds = np.log(prior / (1 - prior)) + sum(np.log(table[k, 1, v[:, k]] / table[k, 0, v[:, k]]) for k in range(len(LABELERS)))
        q = 1 / (1 + np.exp(-odds))
    return dict(zip(codes, q.tolist(), strict=True)), table


def inputs(code: int) -> list[float]:
    """The classifier's view of a candidate: which votes it has, and its shape."""
    shape = code % 8
    return [1.0, *[float(x == y) for x in votes_of(code) for y in (0, 1)], float(shape >> 1 & 1), float(shape & 1)]


def train(counts: dict[int, int], posterior: dict[int, float], steps: int = 500) -> dict[int, float]:
    """A logistic classifier fitted to the posteriors, weighted by counts; its probability for every pattern."""
    codes = sorted(counts)
    x, n, y = np.array([inputs(c) for c in codes]), np.array([counts[c] for c in codes], float), np.array([posterior[c] for c in codes])
    n, w = n / n.sum(), np.zeros(x.shape[1])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-x @ w))
        hess = (x * (n * p * (1 - p))[:, None]).T @ x + 1e-3 * np.eye(len(w))
        step = np.linalg.solve(hess, x.T @ (n * (p - y)) + 1e-3 * w)
        w -= step
        if np.abs(step).max() < 1e-8:
            break
    return dict(zip(codes, (1 / (1 + np.exp(-x @ w))).tolist(), strict=True))


def accepted(rows: DataFrame, threshold: float) -> dict[int, list[int]]:
    """For each kind the patterns whose candidates become spans, from all candidates."""
    by: dict[int, dict[int, int]] = {}
    each = rows.select(F.explode("found").alias("f")).groupBy("f.kind", "f.code").count()
    for r in each.collect():
        by.setdefault(r["kind"], {})[r["code"]] = r["count"]
    out = {}
    for kind, counts in by.items():
        p = train(counts, expect(counts)[0])
        out[kind] = [c for c, x in p.items() if x >= threshold]
    return out


def find(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.9) -> DataFrame:
    """``(id, base, spans)``: arrays of (kind, s, e), code points, end exclusive, in the order of start, then kind."""
    rows = common.cut(scan(docs, id_col, text_col))
    chosen = accepted(rows, threshold)
    known = lambda f: f["base"]

    def added(f):
        ok = F.lit(False)
        for kind, codes in chosen.items():
            if codes:
                ok = ok | ((f["kind"] == kind) & f["code"].isin(codes))
        return known(f) | ok

    slim = lambda f: F.struct(f["s"].alias("s"), f["kind"].alias("kind"), f["e"].alias("e"))
    part = lambda test: F.array_sort(F.transform(F.filter("found", test), slim))
    return rows.select(F.col("id").alias(id_col), part(known).alias("base"), part(added).alias("spans"))


def listed(spans: str) -> F.Column:
    names = F.array(*map(F.lit, KINDS))
    return F.concat_ws(",", F.transform(spans, lambda x: F.concat_ws(":", F.element_at(names, x["kind"] + 1), x["s"], x["e"])))


def report(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: id, counts of base spans by kind, base_sha256, spans."""
    found = find(docs, id_col, text_col)
    of_kind = lambda k: F.size(F.filter("base", lambda x: x["kind"] == k)).cast("long")
    counts = [of_kind(k).alias(f"n_{name}") for k, name in enumerate(KINDS)]
    return found.select(id_col, *counts, F.sha2(listed("base").cast("binary"), 256).alias("base_sha256"), listed("spans").alias("spans"))


def redact(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.9) -> DataFrame:
    """``docs`` with every span of its texts, base or added, replaced by its kind in angle brackets."""
    chosen = {k: frozenset(c) for k, c in accepted(common.cut(scan(docs, id_col, text_col)), threshold).items()}

    @F.arrow_udf("string")
    def redacted(texts: pa.Array) -> pa.Array:
        return pa.array([None if t is None else clean(t, chosen) for t in texts.to_pylist()], pa.string())

    return docs.withColumn(text_col, redacted(text_col))


def clean(text: str, chosen: dict[int, frozenset]) -> str:
    if not TRIGGER.search(text):
        return text
    base = base_spans(text)
    spans = base + [c for c in candidates(text, base) if code_of(text, c, False) in chosen.get(KINDS.index(c[0]), ())]
    out, at = [], 0
    for k, s, e in sorted(spans, key=lambda x: x[1:]):
        if s >= at:
            out += [text[at:s], f"<{k}>"]
        at = max(at, e)
    return "".join([*out, text[at:]])
