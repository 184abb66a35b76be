"""The corpus pipeline: five stages over ``documents``, each by one operator of mortar.llm.

``run`` reads the table, applies the stages in order, and writes each result as Parquet in the
cluster's shared folder; the next stage reads it again, so an executor that is lost costs
one stage's tasks and no more; a stage's folder is removed once the next one is written.

1. quality (operator 1): documents scored under 0.3 go.
2. near_dedup (operator 10): of each group of linked fingerprints the document with the smallest id stays.
3. decontaminate (operator 7): documents with a word inside a benchmark window go.
4. redact (operator 3): spans of personal data are replaced by their kind.
5. encode (operator 8): one row per document with its token ids and the decoded text; the other columns end here.

Nulls, empty texts, repeated rows and empty tables are treated as the operators' docstrings say; a
group of near copies of which all ids are null keeps one row.
"""

from __future__ import annotations

import uuid

from mortar.llm import bpe, common, decontam, pii, quality, simhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    rows = quality.features(docs, "doc_id", "text")
    model = quality.fit(rows, common.table(spark, sf_dir, "labels"))
    return docs.where(model.score_column(F.col("text")) >= quality.THRESHOLD)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return simhash.keep_one(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontam.clean(docs, common.table(spark, sf_dir, "benchmark"))


def redact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return pii.redact(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    import public_tokenizers

    ranks = bpe.load_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken"))
    tokens = bpe.encode(docs, ranks, public_tokenizers.PATTERN)
    return bpe.decode(tokens, ranks).select("doc_id", F.size("tokens").cast("long").alias("n_tokens"), "tokens", F.decode("decoded", "UTF-8").alias("text"))


STAGES = [("quality", keep_quality), ("near_dedup", near_dedup), ("decontaminate", decontaminate), ("redact", redact), ("encode", encode)]

#: The classifier, the hashing and the tokenizer are no SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents")
    place = f"{common.shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    before = None
    for name, stage in STAGES:
        stage(spark, docs, sf_dir).write.parquet(f"{place}/{name}")
        docs = spark.read.parquet(f"{place}/{name}")
        if before:
            common.remove(spark, before)
        before = f"{place}/{name}"
    return docs
