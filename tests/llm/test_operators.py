"""The ten operators against brute force, with odd rows: nulls, empty and long texts, ties,
repeated rows, empty tables, extra columns with clashing names."""

import hashlib
import pickle
import random
import re
from collections import defaultdict
from itertools import combinations

import numpy as np
import pytest
import xxhash
from mortar.llm import bpe, common, decontam, embed_dedup, license_scan, para_dedup, pii, quality, sharding, simhash, url_rules
from pyspark.sql import functions as F

DOC = "doc_id long, text string, id string, fp string, row string, t string, lang string, source string"


def documents(spark, pairs):
    """Rows with extra columns whose names clash with those the operators use inside."""
    return spark.createDataFrame([(i, t, "x", "x", "x", "x", None, "s") for i, t in pairs], DOC)


def odd_texts():
    rng = random.Random(5)
    vocab = ["the", "and", "of", "to", "Thé", "ünd", "ion", "ing", "er", "a1", "b-2", "日本"]
    text = lambda n: " ".join(rng.choice(vocab) + rng.choice(["", "x", "y", "z", "q"]) for _ in range(n))
    base = [text(rng.randint(1, 90)) for _ in range(30)]
    near = [b + " tail" for b in base[:8]]
    return [None, "", " \n\t", "one", "two words", "word " * 3000, *base, *near, base[0], base[0]]


def smallest_reachable(n, links):
    label = list(range(n))
    while True:
        changed = False
        for a, b in links:
            m = min(label[a], label[b])
            changed |= label[a] != m or label[b] != m
            label[a] = label[b] = m
        if not changed:
            return label


# -- components --------------------------------------------------------------


def test_components(spark):
    rng = random.Random(1)
    chain = [(k, k + 1) for k in range(40)]
    edges = chain + [(100, k) for k in range(101, 130)] + [(rng.randint(200, 260), rng.randint(200, 260)) for _ in range(40)] + [(7, 7), (0, 1)]
    got = {r["node"]: r["root"] for r in common.components(spark.createDataFrame(edges, "a long, b long"), "a", "b").collect()}
    nodes = sorted({x for e in edges for x in e})
    at = {x: k for k, x in enumerate(nodes)}
    label = smallest_reachable(len(nodes), [(at[a], at[b]) for a, b in edges])
    assert {x: got.get(x, x) for x in nodes} == {x: nodes[label[at[x]]] for x in nodes}
    assert common.components(spark.createDataFrame([], "a long, b long"), "a", "b").count() == 0


# -- 1 quality ---------------------------------------------------------------


def test_quality_held_out(spark):
    rng = random.Random(2)
    words = ["bread", "river", "stone", "green", "window", "market"]
    good = lambda: " ".join(rng.choice(words) for _ in range(40)) + "."
    bad = lambda: " ".join(rng.choice(words).upper() + "!!" for _ in range(40))
    rows = [(k, good() if k % 10 else bad()) for k in range(800)]
    docs = documents(spark, [*rows, (900, None), (901, ""), (None, "a text"), (5, rows[5][1])])
    labels = spark.createDataFrame([(k, int(k % 10 > 0), "x") for k in range(0, 800, 2)] + [(2, 1, "x"), (3, None, "x"), (None, 1, "x")], "doc_id long, quality int, id string")
    got = quality.classify(docs, labels).toPandas()
    assert len(got) == 804 and got.score.between(0, 1).all() and (got.predicted == (got.score >= 0.3)).all()
    held = got[got.held_out & (got.doc_id < 800)]
    assert ((held.predicted == 1) == (held.doc_id % 10 > 0)).mean() > 0.98
    import zlib

    assert all(h == (zlib.crc32(str(int(i)).encode()) % 5 == 0) for i, h in zip(got.doc_id, got.held_out, strict=True) if i == i)


def test_quality_of_the_labelled_table(spark):
    """Held-out labels: nearly all of either kind on the right side of 0.3, and the two kinds apart."""
    docs, labels = (common.table(spark, "/root/testdata/sf0.1", n) for n in ("documents", "labels"))
    got = quality.classify(docs, labels).join(labels.select("doc_id", "quality"), "doc_id").where("held_out AND quality IS NOT NULL").toPandas()
    good, bad = got[got.quality == 1], got[got.quality == 0]
    assert len(good) > 500 and len(bad) > 100
    assert good.predicted.mean() > 0.98 and bad.predicted.mean() < 0.02
    assert (good.score.to_numpy()[:, None] > bad.score.to_numpy()[None, :]).mean() > 0.99


def test_quality_sums_the_unlabelled_risk_over_all_rows(spark):
    """With a sample of a few rows the last steps still see every row: they lower the whole risk, not the sample's."""
    docs, labels = (common.table(spark, "/root/testdata/sf0.001", n) for n in ("documents", "labels"))
    rows = quality.features(docs, "doc_id", "text")
    x = np.array([r["x"] for r in rows.where("NOT held_out").select("x").collect()])

    def mean_score(passes):
        model = quality.fit(rows, labels, sample=25, passes=passes)
        return model, float(model.score(x).mean())

    before, after = mean_score(0), mean_score(40)
    assert before[0].prior == after[0].prior and abs(after[1] - after[0].prior) <= abs(before[1] - before[0].prior) + 0.02


def test_quality_ignores_held_out_labels(spark):
    docs = documents(spark, [(k, f"text {k} " * 9) for k in range(60)])
    labels = spark.createDataFrame([(k, 1) for k in range(60)], "doc_id long, quality int")
    import zlib

    flipped = labels.withColumn("quality", F.when(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0, 0).otherwise(1))
    rows = lambda l: sorted(map(tuple, quality.classify(docs, l).collect()))
    assert rows(labels) == rows(flipped) and zlib
    assert quality.classify(docs.limit(0), labels).count() == 0
    assert quality.classify(docs, labels.limit(0)).count() == 60


# -- 2 embeddings --------------------------------------------------------------


@pytest.mark.parametrize("block", [8, 1024])
def test_embeddings(spark, block):
    rng = np.random.default_rng(3)
    centre = rng.standard_normal((6, 16))
    vectors = []
    for k in range(160):
        c = centre[k % 6] / np.linalg.norm(centre[k % 6])
        vectors.append((k, (c + rng.standard_normal(16) * rng.choice([0.01, 0.03, 0.05, 0.3])).astype(np.float32).tolist(), k % 2 if k % 7 else None))
    vectors += [(200, vectors[1][1], 1), (201, vectors[1][1], 1), (201, vectors[1][1], 1), (202, [0.0] * 16, 1), (203, None, 1), (204, [float("nan")] * 16, 1), (205, [None] * 16, 1), (206, [], 1), (207, [float("inf")] + [1.0] * 15, 1), (208, [1.0, 2.0], 1), (209, [2.0, 4.0], 1)]
    df = spark.createDataFrame([(*v, "x", "x") for v in vectors], "vec_id long, embedding array<float>, label int, c string, w string")
    got = sorted((r["vec_id"], r["n_links"], r["component_id"], r["kept"]) for r in embed_dedup.near_dedup(df, block=block).collect())
    ok = [v is not None and len(v) > 0 and all(x is not None and np.isfinite(x) for x in v) and any(v) and lab is not None for _, v, lab in vectors]
    links = []
    for a, b in combinations(range(len(vectors)), 2):
        if ok[a] and ok[b] and vectors[a][2] == vectors[b][2] and len(vectors[a][1]) == len(vectors[b][1]):
            x, y = (np.array(vectors[k][1], float) for k in (a, b))
            if x @ y / (np.linalg.norm(x) * np.linalg.norm(y)) >= 0.98:
                links.append((a, b))
    order = sorted(range(len(vectors)), key=lambda k: vectors[k][0])
    place = {k: n for n, k in enumerate(order)}
    label = smallest_reachable(len(vectors), [(place[a], place[b]) for a, b in links])
    degree = defaultdict(int)
    for a, b in links:
        degree[a] += 1
        degree[b] += 1
    want = sorted((vectors[k][0], degree[k], vectors[order[label[place[k]]]][0], vectors[k][0] == vectors[order[label[place[k]]]][0]) for k in range(len(vectors)))
    assert got == want
    assert embed_dedup.near_dedup(df.limit(0)).count() == 0


def test_tables_reach_recall():
    for bits in (12, 16, 24):
        same = (1 - np.arccos(0.98) / np.pi) ** bits
        assert (1 - same) ** embed_dedup.tables_for(bits, 0.98) <= 1e-4


# -- 3 personal data ---------------------------------------------------------------


def brute_spans(t):
    digits = lambda s: re.sub("[^0-9]", "", s)

    def luhn(d):
        twice = [int(c) * (1 + k % 2) for k, c in enumerate(d[::-1])]
        return sum(x - 9 if x > 9 else x for x in twice) % 10 == 0

    out = [("email", *m.span()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", t)]
    out += [("ip", *m.span()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", t) if all(int(x) <= 255 for x in m[0].split("."))]
    out += [("card", *m.span()) for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", t) if 12 <= len(digits(m[0])) <= 19 and luhn(digits(m[0]))]
    out += [("phone", *m.span()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", t) if 9 <= len(digits(m[0])) <= 15]
    return sorted(out, key=lambda x: (x[1], pii.KINDS.index(x[0])))


def test_base_spans_at_random():
    rng = random.Random(4)
    for k in range(20_000):
        t = "".join(rng.choice(["0123456789. -+@()aZ._%\né", "01.+@a-", "4111 -"][k % 3]) for _ in range(rng.randint(0, 60)))
        assert pii.base_spans(t) == brute_spans(t), repr(t)


def test_base_spans_are_linear():
    long = "1" * 100_000 + "@" + "a" * 100_000 + "+1" + "(" * 50_000 + "1." * 50_000
    assert pii.base_spans(long) is not None


def test_pii_trigger_covers_loose_patterns(spark):
    texts = ["write to john at example.com", "john at example dot com", "john AT example[dot]com", "a.b at c .d", "john (at) example.com", "at abcd:ef:ab:cd:ef:ab:cd:ef now"]
    assert all(pii.candidates(t, []) and pii.TRIGGER.search(t) for t in texts)
    rng = random.Random(11)
    bits = ["john", "at", "AT", " ", ".", "dot", "(dot)", "[DOT]", "[at]", "example", "-", ":", "ab", "f", "é", "\n"]
    for _ in range(20_000):
        t = "".join(rng.choice(bits) for _ in range(rng.randint(4, 14)))
        assert pii.TRIGGER.search(t) or not pii.candidates(t, []), repr(t)
    found = pii.scan(documents(spark, [(1, texts[0])]), "doc_id", "text").first()["found"]
    assert [(x["s"], x["e"], x["base"]) for x in found] == [(9, 28, False)]


def test_pii_report(spark):
    texts = [None, "", "mail a.b@c.org or 10.0.0.1", "call +1 (509) 555-6973 now", "pay 4111 1111 1111 1111 é", "é 4111-1111-1111-1112 no", "x" * 50_000 + " a@b.co"]
    docs = documents(spark, [*enumerate(texts), (2, texts[2]), (None, texts[3])])
    got = pii.report(docs).collect()
    assert len(got) == len(texts) + 2
    for r in got:
        t = (texts[r["doc_id"]] if r["doc_id"] is not None else texts[3]) or ""
        want = ",".join(f"{k}:{s}:{e}" for k, s, e in brute_spans(t))
        assert r["base_sha256"] == hashlib.sha256(want.encode()).hexdigest()
        assert set(filter(None, want.split(","))) <= set(r["spans"].split(","))
        assert [r[f"n_{k}"] for k in pii.KINDS] == [sum(s[0] == k for s in brute_spans(t)) for k in pii.KINDS]
    clean = {r["doc_id"]: r["text"] for r in pii.redact(docs).where("doc_id < 3").collect()}
    assert clean[0] is None and clean[2] == "mail <email> or <ip>"
    assert pii.report(docs.limit(0)).count() == 0


def test_em_tells_reliable_patterns():
    code = lambda *v: 8 * sum(x * 3**k for k, x in enumerate(reversed(v)))
    counts = {code(1, 1, 2, 1): 500, code(0, 0, 2, 0): 400, code(1, 0, 2, 1): 20}
    q, table = pii.expect(counts)
    assert q[code(1, 1, 2, 1)] > 0.95 and q[code(0, 0, 2, 0)] < 0.05
    assert table[0, 1, 1] > table[0, 0, 1]
    assert pii.train(counts, q)[code(1, 1, 2, 1)] > 0.9


def test_added_spans_by_brute_force(spark):
    """EM and a logistic classifier over single candidates, without patterns or counts, add the same spans."""
    rng = random.Random(13)
    bits = ["mail bob at example.com", "write to x_y (at) mail [dot] org", "at home. at last", "555-697-3412", "tel 0049 30 123-4567", "version 2001:db8:0:1:1:1:1:1", "card 4111 1111 1111 1111", "4111/1111/1111/1112",
            "order 1234-5678-9012-3456", "ip 10.1.2.3", "fe80:1:2:3:4:5:6:7", "call +1 (509) 555-6973", "a.b@c.org", "id 123-456-7890", "some words", "plain text here"]
    texts = [" ".join(rng.choice(bits) for _ in range(rng.randint(1, 8))) for _ in range(300)]
    each = []
    for i, t in enumerate(texts):
        base = brute_spans(t)
        found = [(s, True) for s in base]
        for kind in pii.KINDS:
            last = -1
            for m in pii.LOOSE[kind].finditer(t):
                if m.start() >= last and not any(m.start() < e and s < m.end() for _, s, e in base):
                    found.append(((kind, *m.span()), False))
                    last = m.end()
        each += [(i, s, b, *pii.votes(s[0], t, s[1], s[2], b)) for s, b in found]
    want = {i: set(brute_spans(t)) for i, t in enumerate(texts)}
    for kind in pii.KINDS:
        mine = [x for x in each if x[1][0] == kind]
        v = np.array([x[3] for x in mine])
        q = 1 / (1 + np.exp(-1.5 * ((v == 1).sum(1) - (v == 0).sum(1)) + 0.5))
        for _ in range(50):
            prior = min(max(q.mean(), 0.01), 0.99)
            odds = np.full(len(v), np.log(prior / (1 - prior)))
            for k in range(4):
                yes, no = np.array([1.0, 4.0, 2.0]), np.array([4.0, 1.0, 2.0])
                for x, w in zip(v[:, k], q, strict=True):
                    yes[x], no[x] = yes[x] + w, no[x] + 1 - w
                odds += np.log(yes[v[:, k]] / yes.sum()) - np.log(no[v[:, k]] / no.sum())
            q = 1 / (1 + np.exp(-odds))
        x = np.array([[1.0, *[float(a == b) for a in votes for b in (0, 1)], float(shape >> 1 & 1), float(shape & 1)] for *_, votes, shape in mine])
        w = np.zeros(x.shape[1])
        for _ in range(200):  # Newton steps of the ridge logistic loss
            p = 1 / (1 + np.exp(-x @ w))
            w -= np.linalg.solve((x.T * (p * (1 - p))) @ x / len(x) + 1e-3 * np.eye(len(w)), x.T @ (p - q) / len(x) + 1e-3 * w)
        for (i, span, *_), p in zip(mine, 1 / (1 + np.exp(-x @ w)), strict=True):
            if p >= 0.9:
                want[i].add(span)
    got = {r["doc_id"]: r["spans"] for r in pii.report(documents(spark, enumerate(texts))).collect()}
    for i, spans in want.items():
        assert got[i] == ",".join(f"{k}:{s}:{e}" for k, s, e in sorted(spans, key=lambda x: (x[1], pii.KINDS.index(x[0])))), texts[i]
    assert sum(len(x) for x in want.values()) > sum(len(brute_spans(t)) for t in texts)


def test_candidates_take_linear_time():
    import time

    def took(n):
        t = "a@b.co john at example.com " * n
        base = pii.base_spans(t)
        began = time.perf_counter()
        assert len(pii.candidates(t, base)) == n
        return time.perf_counter() - began

    took(500)
    assert min(took(16_000) for _ in range(3)) < 12 * min(took(4_000) for _ in range(3))


# -- 4 URLs ----------------------------------------------------------------------


def test_url_rules(spark):
    from mortar.llm.queries import RULES

    urls = [None, "", "no scheme", "http://", "https://A.Example.COM/en/70?x", "http://example.com/en/6", "http://com/en/", "http://xcom/en/", "http://b.example.net/de/8#t", "http://example.net/de/", "http://example.net?/de/", "ftp://x.org/es/1", "http://a.org/ES/", "http://" + "a." * 3000 + "com/en/" + "y" * 9000, "x://y://com/en/"]
    pages = spark.createDataFrame([(k, u, "x", "x", "x") for k, u in enumerate(urls)] + [(4, urls[4], "x", "x", "x"), (None, urls[5], "x", "x", "x")], "page_id long, url string, host string, path string, rule string")
    got = url_rules.judge(pages, RULES).collect()
    assert len(got) == len(urls) + 2
    for r in got:
        u = (urls[r["page_id"]] if r["page_id"] is not None else urls[5]) or ""
        rest = u.split("://", 1)[1] if "://" in u else ""
        host = re.match(r"[^/?#]*", rest)[0]
        path = re.match(r"[^?#]*", rest[len(host) :])[0]
        host = "".join(c.lower() if "A" <= c <= "Z" else c for c in host)
        fits = [(len(h + p), h + p, v) for h, p, v in RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
        best = max(fits, default=(0, None, "allow"))
        assert tuple(r)[1:] == (host, path, best[1], best[2]), u
    assert url_rules.judge(pages.limit(0), RULES).count() == 0
    assert {r["verdict"] for r in url_rules.judge(pages, []).collect()} == {"allow"}


# -- 5 paragraphs -------------------------------------------------------------------


def split_paragraphs(text):
    """Lines of 20 words, or shorter ones joined until they have as many, or a whole short text: by their first line."""
    found, run, first = {}, [], 0
    for k, line in enumerate((text or "").lower().split("\n")):
        words = line.split()
        if len(words) >= 20:
            found[k], run = words, []
        elif words:
            first = first if run else k
            run = run + words
            if len(run) >= 20:
                found[first], run = run, []
    return found or ({first: run} if run else {})


@pytest.mark.parametrize("block", [4, 512])
def test_paragraphs(spark, block):
    rng = random.Random(6)
    line = lambda n: " ".join(f"w{rng.randint(0, 400)}" for _ in range(n))
    lines = [line(60) for _ in range(20)]
    edited = [" ".join(x.split()[:-2] + ["new", "end"]) for x in lines[:10]]
    short = [line(9) + "\n\n" + line(8) + "\n" + line(7) for _ in range(4)]
    docs_ = [(f"{k:04}", "\n".join([line(30), rng.choice(lines + edited), "short line", line(25), *rng.choice([short, [], []])])) for k in range(60)]
    docs_ += [("0100", None), ("0101", ""), ("0102", lines[0] + "\n" + lines[0]), ("0103", line(20000)), (None, lines[1]), ("0005", docs_[5][1]), ("0104", lines[0].upper())]
    docs_ += [("0105", "Two words"), ("0106", " \n"), ("0107", "two\nwords")]
    df = spark.createDataFrame([(i, t, "x", "x", 1) for i, t in docs_], "doc_id string, text string, id string, head string, c long")
    got = {(r["doc_id"], r["paragraph"]): (r["component_id"], r["component_paragraph"], r["kept"]) for r in para_dedup.near_paragraphs(df, block=block).collect() if r["word"] is None}
    parts = [(i, par, set(zip(*(ws[k:] for k in range(5)), strict=False)) or {tuple(ws)}) for i, t in dict(d for d in docs_ if d[0] is not None).items() for par, ws in split_paragraphs(t).items()]
    parts.sort(key=lambda p: p[:2])
    links = [(a, b) for a, b in combinations(range(len(parts)), 2) if len(parts[a][2] & parts[b][2]) * 10 >= 8 * len(parts[a][2] | parts[b][2])]
    label, groups = smallest_reachable(len(parts), links), defaultdict(list)
    for k, m in enumerate(label):
        groups[m].append(k)
    want = {parts[k][:2]: (*parts[m][:2], k == m) for m, ks in groups.items() if len({parts[k][0] for k in ks}) > 1 for k in ks}
    assert got == want and len(want) > 20
    assert para_dedup.near_paragraphs(df.limit(0)).count() == 0


def test_passages_inside_lines_and_across_short_ones(spark):
    rng = random.Random(8)
    text = lambda n: [f"w{rng.randint(0, 10**6)}" for _ in range(n)]
    passages, docs_ = [text(50) for _ in range(20)], []
    for k, x in enumerate(passages):
        docs_.append((3 * k, " ".join(text(90) + x + text(70))))
        docs_.append((3 * k + 1, " ".join(text(60)) + "\n" + " ".join(text(80) + [w.upper() for w in x] + text(95))))
        docs_.append((3 * k + 2, "\n".join(" ".join((text(7) + x + text(9))[at : at + 11]) for at in range(0, 66, 11))))
    docs_ += [(1000 + k, " ".join(text(200))) for k in range(20)] + [(2000, " ".join(text(40) * 3))]
    got = para_dedup.near_paragraphs(documents(spark, docs_)).collect()
    assert {r["doc_id"] for r in got} == set(range(60))
    where = {i: t.lower().split() for i, t in docs_}
    for r in got:
        x = passages[r["doc_id"] // 3]
        run = where[r["doc_id"]][r["word"] : r["word"] + r["n_words"]]
        assert " ".join(run) in " ".join(x) and run == where[r["component_id"]][r["component_word"] : r["component_word"] + r["n_words"]]
        assert r["doc_id"] // 3 * 3 <= r["component_id"] <= r["doc_id"] and r["kept"] == (r["component_id"] == r["doc_id"])
    assert {r["doc_id"] for r in got if r["component_id"] == r["doc_id"] // 3 * 3} == set(range(60))


# -- 6 licenses ------------------------------------------------------------------------


def test_licenses(spark):
    files = [
        (1, "p/LICENSE", "Released under the MIT License."),
        (2, "p/src/a.py", "text of a file"),
        (3, "p/src/b.py", "code " * 20 + "\nLicensed under the Apache License, Version 2.0.\nmore"),
        (4, "q/x", "a licence is not named here at all, only spoken of"),
        (5, None, "Licensed under CC BY-NC 4.0."),
        (6, "p/src/deep/COPYING", "This work is licensed under the GNU General Public License, version 3."),
        (7, "p/src/deep/er/c.py", None),
        (8, "top", ""),
        (2, "p/src/a.py", "text of a file"),
        (9, "q/y", "z " * 5000 + "Released under the MIT License." + " z" * 3000),
    ]
    df = spark.createDataFrame([(*f, "x", "x") for f in files], "doc_id long, path string, text string, license string, line string")
    got = sorted({(r["doc_id"], r["license"], r["inherited_from"]) for r in license_scan.scan(df).collect()}, key=str)
    assert got == [(1, "MIT", None), (2, "MIT", "p/"), (3, "Apache-2.0", None), (4, None, None), (5, "CC-BY-NC-4.0", None), (6, "GPL-3.0", None), (7, "GPL-3.0", "p/src/deep/"), (8, None, None), (9, "MIT", None)]
    assert license_scan.scan(df).count() == len(files) and license_scan.scan(df.limit(0)).count() == 0


def test_notices_among_other_text(spark):
    files = [
        (1, "a/1", "Copyright (c) 2020 Foo. Released under the MIT License.", "MIT"),
        (2, "a/2", 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License.', "Apache-2.0"),
        (3, "a/3", "// SPDX-License-Identifier: MIT\nint main() {}", "MIT"),
        (4, "a/4", "# SPDX-License-Identifier: Apache-2.0", "Apache-2.0"),
        (5, "a/5", "# SPDX-License-Identifier: Foo-Bar", None),
        (6, "a/6", "# This work is licensed under the GNU\n# General Public License,\n# version 3.\ncode", "GPL-3.0"),
        (7, "a/7", "Permission is hereby granted, free of charge, to any person obtaining a copy\nof this software and associated documentation files (the \"Software\"), to deal\nin the Software without restriction, including", "MIT"),
        (8, "a/8", "all sales are under the license of the seller, as the tenant was told", None),
    ]
    df = spark.createDataFrame([f[:3] for f in files], "doc_id long, path string, text string")
    got = {r["doc_id"]: r["license"] if r["inherited_from"] is None else None for r in license_scan.scan(df).collect()}
    assert got == {f[0]: f[3] for f in files}


def test_cosines_of_licenses(spark):
    """Against plain vectors of every window, header and whole file, in which words outside the templates count one by one."""
    rng, find = random.Random(12), lambda t: re.findall(r"[a-z0-9]+(?:\.[0-9]+)*", t.lower())
    templates = [("A", "use of the alpha code is free"), ("A", "alpha"), ("B", "the beta terms 2.0 of use and of beta code"), ("C", "use the gamma code")]
    pool = ["use", "of", "the", "alpha", "code", "is", "free", "beta", "terms", "2.0", "and", "x", "y", "gamma", "other"]
    texts = ["", None, "nothing here"] + ["".join(rng.choice(pool) + rng.choice([" ", " ", " ", "\n", "\n\n", "; "]) for _ in range(rng.randint(1, 60))) for _ in range(150)]
    df = spark.createDataFrame([(k, None, t, "x", "x") for k, t in enumerate(texts)], "doc_id long, path string, text string, held string, row string")
    got = {r["doc_id"]: (r["license"], r["cosine"]) for r in license_scan.scan(df, spark.createDataFrame(templates, "license string, text string")).collect()}
    vocabulary = {w for _, t in templates for w in find(t)}
    seen = {w: sum(w in find(t or "") for t in texts) for w in vocabulary}
    idf = lambda w: np.log((1 + len(texts)) / (1 + seen.get(w, 0))) + 1
    names = {n for n, _ in templates}
    tells = {w for w in vocabulary if 2 * len({n for n, t in templates if w in find(t)}) <= max(2, len(names))}

    def square(unit):
        return sum((unit.count(w) * idf(w)) ** 2 for w in set(unit) & vocabulary) + sum(idf("") ** 2 for w in unit if w not in vocabulary)

    want = {}
    for k, text in enumerate(texts):
        ws, head, found = find(text or ""), find(re.split(r"\n[ \t\r]*\n", text or "")[0]), []
        for name, t in templates:
            v = find(t)
            units = [ws[at : at + len(v)] for at in range(len(ws))] + [u for u in (head, ws) if len(u) <= 4 * len(v)]
            for u in units:
                if set(u) & set(v) & tells:
                    c = sum(u.count(w) * v.count(w) * idf(w) ** 2 for w in set(u) & set(v)) / np.sqrt(square(u) * square(v))
                    found.append((round(c, 9), name))
        top = max((c for c, _ in found), default=0)
        want[k] = (min(n for c, n in found if c == top), top) if top >= 0.6 else (None, None)
    assert {k: n for k, (n, _) in want.items()} == {k: n for k, (n, _) in got.items()}
    assert all(c is None or abs(c - want[k][1]) < 1e-8 for k, (_, c) in got.items())
    assert {n for n, _ in want.values()} == {None, "A", "B", "C"}


def test_windows_are_made_and_shuffled_once(spark):
    words = " ".join(f"w{k}" for k in range(90))
    lines = spark.createDataFrame([], "id long, par int")
    got = para_dedup.equal_windows(documents(spark, [(1, "a " + words), (2, "b " + words), (3, "c d e")]), lines, "doc_id", "text")
    assert {r["id"] for r in got.collect()} == {1, 2}
    plan = got._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    assert plan.count("MapInArrow") == 1 and "ReusedExchange" in plan


# -- 7 benchmark ---------------------------------------------------------------------------


@pytest.mark.parametrize("chunk", [200, 1 << 20])
def test_decontamination(spark, chunk):
    rng = random.Random(8)
    word = lambda: rng.choice(["a", "b", "c", "dé", "E1"])
    items = [(k, " ".join(word() for _ in range(rng.choice([1, 2, 3, 9, 10, 11, 25])))) for k in range(12)] + [(50, None), (51, ""), (None, "zz yy xx"), (3, "q r s t")]
    docs_ = [(k, "-".join(word() for _ in range(rng.randint(0, 120)))) for k in range(60)] + [(70, None), (71, ""), (72, "Q! r s, T zz yy xx"), (None, "q r s t"), (1, "a b")]
    bench = spark.createDataFrame([(*i, "x") for i in items], "item_id long, text string, name string")
    got = sorted((tuple(r) for r in decontam.decontaminate(documents(spark, docs_), bench, chunk_bytes=chunk).collect()), key=str)
    cut = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    want = []
    for i, t in docs_:
        w, hit, names = cut(t), set(), set()
        for name, text in items:
            words = cut(text)
            n = min(10, len(words))
            for s in range(len(words) - n + 1 if n else 0):
                for p in range(len(w) - n + 1):
                    if w[p : p + n] == words[s : s + n]:
                        hit |= set(range(p, p + n))
                        names |= {str(name)} if name is not None else set()
        want.append((i, len(w), len(hit), len(names), hashlib.sha256(",".join(sorted(names)).encode()).hexdigest(), bool(hit)))
    assert got == sorted(want, key=str)
    kept = decontam.clean(documents(spark, docs_), bench, chunk_bytes=chunk)
    assert kept.count() == sum(not w[-1] for w in want) and kept.columns == documents(spark, []).columns
    assert decontam.decontaminate(documents(spark, []), bench).count() == 0
    assert {r["n_hit"] for r in decontam.decontaminate(documents(spark, docs_), bench.limit(0)).collect()} == {0}


def test_long_texts_hash_in_pieces():
    text = b"word another " * 200_000
    w = decontam.Hasher().words(text)
    assert len(w.hash) == 400_000 and len(set(w.hash.tolist())) == 2
    assert text[w.start[-1] : w.end[-1]] == b"another"


# -- 8 byte-level BPE --------------------------------------------------------------------------


def test_bpe_equals_tiktoken(spark):
    import public_tokenizers
    import tiktoken

    ranks = bpe.load_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken"))
    coder = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    texts = [*odd_texts(), "a" * 3000, "  \n\t x\x1c y \u2028z", "日本語テキスト" * 99, "don't we'LL 12345 <|endoftext|>", "ÿþ\x00\x01 zqxj" * 20, "\U0001f600\u0301 é"]
    got = bpe.digests(documents(spark, [*enumerate(texts), (None, "null id")]), ranks, public_tokenizers.PATTERN).collect()
    assert len(got) == len(texts) + 1
    for r in got:
        t = (texts[r["doc_id"]] if r["doc_id"] is not None else "null id") or ""
        ids = coder.encode_ordinary(t)
        assert (r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) == (len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(t.encode()).hexdigest()), t[:50]
    texts += ["a" * 700, "zqxj" * 300]
    # word numbers start anew after every block, and a heap merges what is over 9 bytes
    small = bpe.encode(documents(spark, enumerate(texts)), ranks, public_tokenizers.PATTERN, block_bytes=50, cache_words=5, fold_bytes=9)
    assert {r["doc_id"]: r["tokens"] for r in small.collect()} == {k: coder.encode_ordinary(t or "") for k, t in enumerate(texts)}
    small = bpe.encode(documents(spark, enumerate(texts)), ranks, public_tokenizers.PATTERN, block_bytes=3000)
    assert {r["doc_id"]: r["tokens"] for r in small.collect()} == {k: coder.encode_ordinary(t or "") for k, t in enumerate(texts)}
    assert bpe.digests(documents(spark, []), ranks, public_tokenizers.PATTERN).count() == 0


def test_common_words_are_folded_once_for_all_tasks(spark):
    import public_tokenizers
    import tiktoken

    ranks = bpe.load_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken"))
    coder = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    rng = random.Random(5)
    texts = [" ".join("".join(rng.choice("aeiothnrsé中") for _ in range(rng.randint(1, 12))) for _ in range(40)) for _ in range(30)] + [None, "", "x" * 9000]
    want = [coder.encode_ordinary(t or "") for t in texts]
    docs = documents(spark, enumerate(texts)).repartition(3)
    merges, sent = bpe.Merges(ranks), spark.sparkContext.broadcast((ranks, bpe.Merges(ranks).states))
    words = bpe.common_words([t for t in texts if t], ranks, public_tokenizers.PATTERN, 30)
    assert words and all(w.encode() not in ranks and len(w.encode()) <= 30 for w in words)
    ids, sizes = bpe.folded_words(spark, [pickle.dumps(words[:50]), pickle.dumps(words[50:])], merges, sent)
    assert [x.tolist() for x in np.split(ids, np.cumsum(sizes)[:-1])] == [coder.encode_ordinary(w) for w in words]
    sampled = bpe.sampled_words(docs.coalesce(1), "text", public_tokenizers.PATTERN, 30, 100, sent)
    assert {w for x in sampled for w in pickle.loads(x)} == set(words)
    for rows in (0, 7, 100):  # none, some or all words are known beforehand
        got = bpe.encode(docs, ranks, public_tokenizers.PATTERN, block_bytes=500, cache_words=60, sample_rows=rows).collect()
        assert {r["doc_id"]: r["tokens"] for r in got} == dict(enumerate(want))


def test_heap_merges_equal_the_library():
    import public_tokenizers
    import tiktoken

    ranks = bpe.load_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken"))
    coder = tiktoken.Encoding("own", pat_str=r"[\s\S]+", mergeable_ranks=ranks, special_tokens={})
    rng = random.Random(9)
    for _ in range(400):
        w = "".join(rng.choice("abcdeinrst é") for _ in range(rng.randint(1, 80)))
        assert bpe.merge_long(w.encode(), ranks) == coder.encode_ordinary(w)


# -- 9 shards --------------------------------------------------------------------------------------


def test_shards(spark):
    rng = random.Random(10)
    rows = [(k, "y" * rng.randint(0, 200)) for k in range(3000)] + [(9000, None), (9001, "")] + [(5, "same text")] * 1500 + [(None, "z")]
    docs = documents(spark, rows).repartition(7)
    got = sharding.kd_shards(docs).toPandas()
    import zlib

    texts = defaultdict(set)
    for i, t in rows:
        texts[i].add((len((t or "").encode()) + 1, zlib.crc32((t or "").encode())))
    assert len(got) == len(rows) and set(got["law"]) == {"bytes"} and got.grown_shard.isna().all()
    assert all((s, c) in texts[None if i != i else int(i)] for i, s, c in zip(got.doc_id, got["size"], got.text_crc32, strict=True))
    size = got.groupby("shard")["size"].sum()
    assert list(size.index) == list(range(8)) and size.max() - size.min() <= 2 * 201
    for _, part in got.groupby("shard"):
        assert sorted(part["slot"]) == list(range(len(part)))
    five = sharding.kd_shards(docs, shards=5).groupBy("shard").agg(F.sum("size").alias("b")).toPandas().b
    assert len(five) == 5 and five.max() - five.min() <= 4 * 201
    assert sharding.kd_shards(docs.limit(0)).count() == 0
    assert sharding.kd_shards(docs.select("doc_id", "text").limit(1)).count() == 1


# -- 10 SimHash ------------------------------------------------------------------------------------------


def brute_fingerprint(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    grams = [" ".join(words[k : k + 3]) for k in range(len(words) - 2)] if len(words) >= 3 else [" ".join(words)] if words else []
    h = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if sum(x >> b & 1 for x in h) * 2 > len(h)) if h else 0


def test_simhash(spark):
    texts = odd_texts()
    docs = documents(spark, [*enumerate(texts), (7, texts[7]), (None, texts[9])])
    got = simhash.near_dedup(docs).collect()
    assert len(got) == len(texts) + 2
    fps = [brute_fingerprint(t) for t in texts]
    label = smallest_reachable(len(texts), [(a, b) for a, b in combinations(range(len(texts)), 2) if (fps[a] ^ fps[b]).bit_count() <= 3])
    for r in got:
        k = r["doc_id"] if r["doc_id"] is not None else 9
        assert (r["fingerprint"], r["component_id"]) == (f"{fps[k]:016x}", label[k])
    kept = simhash.keep_one(docs)
    assert sorted(r["doc_id"] for r in kept.collect()) == sorted(set(label)) and kept.columns == docs.columns
    assert simhash.near_dedup(docs.limit(0)).count() == 0


def test_keep_one_of_any_columns(spark):
    """Columns named like the operator's own, rows that share an id, null ids."""
    schema = "doc_id string, text string, _rep string, _kept long, _fp long, id string, fp long"
    long = "one two three four five six seven eight nine ten " * 20
    rows = [("b", long, "r", 1, 2, "x", 3), ("a", long, "r", 4, 5, "y", 6), ("a", long, "s", 4, 5, "y", 6), ("c", "other words of another text", None, None, None, None, None), (None, "a third text that has no id", "t", 0, 0, "z", 0), (None, "a third text that has no id", "t", 0, 0, "z", 0)]
    df = spark.createDataFrame(rows, schema)
    got = [tuple(r) for r in simhash.keep_one(df).collect()]
    assert simhash.keep_one(df).columns == df.columns and len(got) == 3
    assert {r[0] for r in got} == {"a", "c", None} and set(got) <= set(rows)
    assert got == [tuple(r) for r in simhash.keep_one(df.orderBy(F.desc("_rep"))).collect()] or sorted(got, key=str) == sorted((tuple(r) for r in simhash.keep_one(df.orderBy(F.desc("_rep"))).collect()), key=str)


def test_shards_of_string_ids(spark):
    df = spark.createDataFrame([(f"k{n}", "t" * (n % 50), "en") for n in range(400)] + [(None, None, None)], "doc_id string, text string, lang string")
    got = sharding.kd_shards(df).toPandas()
    assert len(got) == 401 and sorted(got.shard.unique()) == list(range(8))
    assert all(sorted(g.slot) == list(range(len(g))) for _, g in got.groupby("shard"))


@pytest.mark.parametrize("block", [4, 1024])
def test_simhash_links_in_a_dense_ball(spark, block):
    """Fingerprints around a few centres: every link of up to 3 bits is found, none beyond."""
    rng = random.Random(11)
    centres = [rng.getrandbits(64) for _ in range(4)]
    fps = sorted({c ^ sum(1 << b for b in rng.sample(range(64), rng.randint(0, 6))) for c in centres for _ in range(60)})
    edges = simhash.links(spark.createDataFrame([(simhash.signed(x),) for x in fps], "fp long"), block=block)
    at = {simhash.signed(x): k for k, x in enumerate(fps)}
    found = [(at[r["a"]], at[r["b"]]) for r in edges.collect()]
    assert all((fps[a] ^ fps[b]).bit_count() <= 3 for a, b in found)
    want = [(a, b) for a, b in combinations(range(len(fps)), 2) if (fps[a] ^ fps[b]).bit_count() <= 3]
    assert smallest_reachable(len(fps), found) == smallest_reachable(len(fps), want)
