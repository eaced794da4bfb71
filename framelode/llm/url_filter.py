"""URL filters, in DataFrame operations only: expressions of host suffix and path prefix, joined on short hash prefixes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rules of the query: host, path, verdict.
RULES = (("org", "/", "allow"), ("example.org", "/es/", "block"), ("example.org", "/en/1", "block"), ("com", "/fr/", "allow"), ("com", "/de/", "block"))
#: Hex digits of the digest that the join sees first; rules up to so many rows are broadcast.
PREFIX, BROADCAST_ROWS = 8, 200_000


def rules_table(spark: SparkSession, rules=RULES) -> DataFrame:
    rows = F.array(*[F.struct(F.lit(h).alias("rule_host"), F.lit(p).alias("rule_path"), F.lit(v).alias("rule_verdict")) for h, p, v in rules])
    return spark.range(1).select(F.inline(rows))


def lower_ascii(c: Column) -> Column:
    return F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def url_parts(url: Column) -> tuple[Column, Column]:
    """Host and path: what follows the first ://, up to its end marks; both empty without one."""
    parts = r"(?s)^.*?://([^/?#]*)([^?#]*)"
    return lower_ascii(F.coalesce(F.regexp_extract(url, parts, 1), F.lit(""))), F.coalesce(F.regexp_extract(url, parts, 2), F.lit(""))


def label_count(host: Column) -> Column:
    return F.length(host) - F.length(F.replace(host, F.lit("."))) + 1


def judge(pages: DataFrame, rules: DataFrame, default: str = "allow", prefix: int = PREFIX) -> DataFrame:
    """page_id, host, path, rule and verdict of each row of pages.

    A rule fits its host and the hosts below it where the path starts with the rule's. Of those that fit, the longest
    (characters of host and path together) wins; of equally long ones the one with the longer host, of equal rules one
    that blocks. No rule: null and the default verdict. A null url has an empty host and path, and repeated or null
    page_ids are judged row by row.
    Each url is expanded into one suffix of its host for each number of labels that a rule's host has and, for each length
    of a rule's path, one prefix of its path; so a host of very many labels costs no more than another. Expressions meet rules on `prefix` hex
    digits of their digests, and a rule counts only where the whole digests agree. The first aggregation is partial and
    finds all expressions of a row in one task, so one row a page is shuffled. Rules over BROADCAST_ROWS are joined by shuffle, where
    AQE splits hot prefixes.
    """
    rules = rules.select(lower_ascii(F.col("rule_host")).alias("rule_host"), "rule_path", "rule_verdict").where("rule_host is not null and rule_path is not null")
    shape = rules.agg(F.count(F.lit(1)).alias("n"), F.array_sort(F.collect_set(F.length("rule_path"))).alias("lengths"), F.array_sort(F.collect_set(label_count(F.col("rule_host")))).alias("labels")).first()
    digest = lambda h, p: F.sha2(F.concat(h, F.lit("\x00"), p), 256)
    keyed = rules.withColumn("_full", digest(F.col("rule_host"), F.col("rule_path"))).withColumn("_short", F.substring("_full", 1, prefix))
    keyed = F.broadcast(keyed) if shape["n"] <= BROADCAST_ROWS else keyed

    host, path = url_parts(F.col("url"))
    rows = pages.select("page_id", host.alias("host"), path.alias("path"), F.monotonically_increasing_id().alias("_row"))
    suffixes = F.array_compact(F.array(*[F.when(label_count(F.col("host")) >= n, F.substring_index("host", ".", -n)) for n in shape["labels"]])) if shape["labels"] else F.array().cast("array<string>")
    prefixes = F.array_compact(F.array(*[F.when(F.length("path") >= n, F.substring("path", 1, n)) for n in shape["lengths"]])) if shape["lengths"] else F.array().cast("array<string>")
    parts = rows.withColumn("_suffix", F.explode_outer(suffixes)).withColumn("_prefix", F.explode_outer(prefixes))
    parts = parts.withColumn("_digest", digest(F.col("_suffix"), F.col("_prefix")))
    # the join knows short prefixes alone; what it brings is confirmed by the whole digest after it
    met = parts.withColumn("_short", F.substring("_digest", 1, prefix)).join(keyed, "_short", "left")
    rank = F.when(F.col("_digest") == F.col("_full"), F.struct((F.length("rule_host") + F.length("rule_path")).alias("a"), F.length("rule_host").alias("b"), (F.col("rule_verdict") == "block").alias("c"), F.concat("rule_host", "rule_path").alias("rule"), F.col("rule_verdict").alias("verdict")))
    best = met.groupBy("_row", "page_id", "host", "path").agg(F.max(rank).alias("_best"))
    return best.select("page_id", "host", "path", F.col("_best.rule").alias("rule"), F.coalesce(F.col("_best.verdict"), F.lit(default)).alias("verdict"))
