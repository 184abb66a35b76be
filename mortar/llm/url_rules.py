"""URL filters by hashed expressions (operator 4), DataFrame functions only.

A rule is (host, path, verdict); it fits its host and all subdomains when the
URL's path starts with the rule's path, and the longest fitting rule wins
(length of host and path together; ties: the block rule, then the greater string).

Each distinct (host, path) is expanded into the host suffixes and path
prefixes that have as many labels, or characters, as some rule has; nothing
longer can match.  The expressions' SHA-256 digests are joined to the rules'
on their first 4 bytes, full digests then confirm, and the winner is taken
per (host, path).  The join back to the URLs is by an equi-join with one row a
key on the rules' side, which AQE can split where a host is hot.  Rules are
broadcast only if Spark's own size threshold allows.

Cases.  A null URL, or one without ``://``, has empty host and path, and no
rule unless a rule is empty too.  Repeated rows give one row each; a null id is
kept.  Empty tables give empty tables.  Other columns are not read.  Without a
rule the verdict is ``default``.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common

RULE_SCHEMA = "host string, path string, verdict string"
PREFIX_HEX = 8


def host_and_path(url: Column) -> tuple[Column, Column]:
    at = F.coalesce(F.instr(url, "://"), F.lit(0))
    rest = F.when(at > 0, url.substr(at + 3, F.length(url))).otherwise(F.lit(""))
    host = common.lower_ascii(F.regexp_extract(rest, "^[^/?#]*", 0))
    return host, F.regexp_extract(rest, "^[^/?#]*([^?#]*)", 1)


def digest(expression: Column) -> Column:
    return F.sha2(expression.cast("binary"), 256)


def judge(pages: DataFrame, rules: Iterable[tuple[str, str, str]] | DataFrame, default: str = "allow", id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """One row per row of ``pages``: id, host, path, rule, verdict."""
    spark = pages.sparkSession
    given = rules if isinstance(rules, DataFrame) else spark.createDataFrame(list(rules), RULE_SCHEMA)
    given = given.select("host", "path", "verdict").distinct()
    # label counts and path lengths that occur: two sets of small integers
    shape = given.agg(F.collect_set(F.size(F.split("host", "\\."))).alias("labels"), F.collect_set(F.length("path")).alias("lengths")).first()
    labels, lengths = sorted(shape["labels"]), sorted(shape["lengths"])
    longest = max(lengths, default=0)
    rule = F.concat("host", "path")
    known = given.select(rule.alias("rule"), "verdict", digest(rule).alias("full")).withColumn("short", F.substring("full", 1, PREFIX_HEX))

    host, path = host_and_path(F.col(url_col))
    each = pages.select(F.col(id_col), host.alias("host"), path.alias("path")).withColumn("_head", F.substring("path", 1, longest))
    keys = each.select("host", "_head").distinct()
    suffixes = F.array_distinct(F.array(*[F.substring_index("host", ".", -n) for n in labels] or [F.col("host")]))
    prefixes = F.array_distinct(F.array(*[F.substring("_head", 1, n) for n in lengths] or [F.col("_head")]))
    pairs = F.flatten(F.transform(suffixes, lambda s: F.transform(prefixes, lambda p: F.concat(s, p))))
    asked = keys.select("host", "_head", F.explode(pairs).alias("_e")).select("host", "_head", digest(F.col("_e")).alias("_full"))
    asked = asked.withColumn("short", F.substring("_full", 1, PREFIX_HEX))
    hit = asked.join(known, "short").where("full = _full")
    rank = F.struct(F.length("rule"), F.col("verdict") == "block", F.col("rule"), F.col("verdict"))
    won = hit.groupBy("host", "_head").agg(F.max(rank).alias("w")).select("host", "_head", F.col("w.rule").alias("rule"), F.col("w.verdict").alias("_v"))
    judged = each.join(won, ["host", "_head"], "left")
    return judged.select(id_col, "host", "path", "rule", F.coalesce("_v", F.lit(default)).alias("verdict"))
