"""The corpus pipeline against a brute-force version of each stage, on its own input."""

import hashlib

import corpus_pipeline
from mortar.llm import common, decontam, pii, quality, simhash
from pyspark.sql import functions as F


def test_stages_and_run(spark, data):
    docs = common.table(spark, data, "documents")
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["quality", "near_dedup", "decontaminate", "redact", "encode"]
    outs, given = {}, docs
    for name, stage in corpus_pipeline.STAGES:
        outs[name] = (given.toPandas(), stage(spark, given, data).cache())
        given = outs[name][1]
        if name != "encode":
            assert given.columns == docs.columns

    # 1: rows that the classifier scores 0.3 or more, with their texts as they were
    before, after = outs["quality"]
    rows = quality.features(docs, "doc_id", "text")
    model = quality.fit(rows, common.table(spark, data, "labels"))
    want = {i for i, t in zip(before.doc_id, before.text, strict=True) if model.score(quality.matrix(pa_array([t])))[0] >= 0.3}
    assert {r["doc_id"] for r in after.collect()} == want and len(want) > len(before) * 0.6

    # 2: the smallest id of each group of fingerprints within 3 bits
    before, after = outs["near_dedup"]
    items = sorted((i, simhash.fingerprint(t.encode())) for i, t in zip(before.doc_id, before.text, strict=True))
    label = list(range(len(items)))
    changed = True
    while changed:
        changed = False
        for a in range(len(items)):
            for b in range(a):
                if label[a] != label[b] and (items[a][1] ^ items[b][1]).bit_count() <= 3:
                    label[a] = label[b] = min(label[a], label[b])
                    changed = True
    assert sorted(r["doc_id"] for r in after.collect()) == sorted({items[m][0] for m in label})

    # 3: documents without a benchmark window
    before, after = outs["decontaminate"]
    windows = set()
    for r in common.table(spark, data, "benchmark").collect():
        w = decontam.Hasher().words((r["text"] or "").encode())
        words = [w.text[s:e] for s, e in zip(w.start, w.end, strict=True)]
        n = min(10, len(words))
        windows |= {tuple(words[k : k + n]) for k in range(len(words) - n + 1) if n}
    sizes, kept = {len(w) for w in windows}, set()
    for i, t in zip(before.doc_id, before.text, strict=True):
        w = decontam.Hasher().words(t.encode())
        words = [w.text[s:e] for s, e in zip(w.start, w.end, strict=True)]
        if not any(tuple(words[k : k + n]) in windows for n in sizes for k in range(len(words) - n + 1)):
            kept.add(i)
    assert {r["doc_id"] for r in after.collect()} == kept

    # 4: every base span is gone, texts without candidates are as they were
    before, after = outs["redact"]
    texts = dict(zip(before.doc_id, before.text, strict=True))
    assert after.count() == len(before)
    for r in after.collect():
        old = texts[r["doc_id"]]
        for k, s, e in pii.base_spans(old):
            assert f"<{k}>" in r["text"] and old[s:e] not in r["text"].replace(f"<{k}>", "")
        if not pii.TRIGGER.search(old):
            assert r["text"] == old

    # 5: the library's ids, and the text again
    import public_tokenizers
    import tiktoken
    from mortar.llm import bpe

    coder = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.load_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken")), special_tokens={})
    before, after = outs["encode"]
    texts = dict(zip(before.doc_id, before.text, strict=True))
    got = after.collect()
    assert len(got) == len(texts) and all(r["tokens"] == coder.encode_ordinary(texts[r["doc_id"]]) and r["text"] == texts[r["doc_id"]] and r["n_tokens"] == len(r["tokens"]) for r in got)

    digest = lambda df: sorted((r["doc_id"], r["n_tokens"], hashlib.sha256(r["text"].encode()).hexdigest()) for r in df.collect())
    assert digest(corpus_pipeline.run(spark, data)) == digest(after)


def pa_array(texts):
    import pyarrow as pa

    return pa.array([t.encode() for t in texts])


def test_odd_rows_pass_every_stage(spark, data):
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    odd = spark.createDataFrame([(None, None, None, None, None), (1, "", "en", "s", 0), (2, "a b c d e. " * 30, "en", "s", None), (2, "a b c d e. " * 30, "en", "s", None), (3, None, None, None, None), (4, "x" * 60_000, "de", None, 1)], schema)
    for docs in (odd, odd.limit(0)):
        for _, stage in corpus_pipeline.STAGES:
            docs = stage(spark, docs, data)
            docs.select(F.count("*")).collect()
