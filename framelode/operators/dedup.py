"""Deduplication by digest, review rebinding and the reuse of cached digests."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..scratch import settle
from .matching import hamming_pairs, hamming_semi


def latest_wins(df: DataFrame, key: str, order: list[str]) -> DataFrame:
    """One row a key: the greatest of the order's columns, null before all. The window's group limit drops losers before the shuffle."""
    w = W.partitionBy(key).orderBy(*[F.col(c).desc_nulls_last() for c in order])
    return df.withColumn("_at", F.row_number().over(w)).where("_at = 1").drop("_at")


def latest_reasons(df: DataFrame, key: str, rank: list[str], arrival: str) -> DataFrame:
    """What happens to each row as rows arrive: kept if it leads and stays leader, superseded if it comes behind the leader
    (by is the leader), replaced if a later row takes the lead (by is that row)."""
    w = W.partitionBy(key).orderBy(arrival)
    me = F.struct(*rank, arrival)
    before = F.max(me).over(w.rowsBetween(W.unboundedPreceding, -1))
    leads = F.coalesce(me > before, F.lit(True))
    df = df.withColumn("_leads", leads).withColumn("_before", before[arrival])
    next_leader = F.first(F.when(F.col("_leads"), F.col(arrival)), ignorenulls=True).over(w.rowsBetween(1, W.unboundedFollowing))
    df = df.withColumn("_next", next_leader)
    fate = F.when(~F.col("_leads"), "superseded").when(F.col("_next").isNotNull(), "replaced").otherwise("kept")
    by = F.when(~F.col("_leads"), F.col("_before")).otherwise(F.col("_next"))
    return df.withColumn("fate", fate).withColumn("by", by).drop("_leads", "_before", "_next")


def bulk_rebind(reviews: DataFrame, listing: DataFrame, key: str, revision: list[str]) -> DataFrame:
    """action for each key of reviews and listing: orphan (no file), rewrite (another revision), add (no review), keep."""
    old = reviews.select(key, F.struct(*revision).alias("_was"), F.lit(True).alias("_reviewed"))
    new = listing.select(key, F.struct(*revision).alias("_is"), F.lit(True).alias("_listed"))
    both = old.join(new, key, "full")
    action = F.when(F.col("_listed").isNull(), "orphan").when(F.col("_reviewed").isNull(), "add").when(~F.col("_was").eqNullSafe(F.col("_is")), "rewrite").otherwise("keep")
    return both.select(key, action.alias("action"))


def cached_digests(files: DataFrame, cache: DataFrame, content: Column, key: list[str]) -> DataFrame:
    """files with digest: the cache's where size, time and fingerprint (key) agree, else computed; and whether it was reused."""
    known = cache.select(*key, F.col("digest").alias("_digest"))
    both = files.join(known, key, "left")
    return both.withColumn("reused", F.col("_digest").isNotNull()).withColumn("digest", F.coalesce("_digest", F.sha2(content, 256))).drop("_digest")


def accept_in_order(candidates: DataFrame, source: str, content: str, order: str, wanted: int, most_rounds: int = 1000) -> DataFrame:
    """candidates that are accepted: each source, in the order of sources, takes its first `wanted` contents (by order) that no
    source before it has taken.

    Sources choose at once and in rounds: of a content that several hold the first source keeps it, the others lose it for
    good and choose again among what is left. As all contents prefer the same sources, this ends with what one source after
    the other would take. Each round's losses are written; rounds end when nothing new is lost.
    """
    rows = settle(candidates.groupBy(source, content).agg(F.min(order).alias(order)), "candidates")
    lost = rows.select(source, content).limit(0)
    for _ in range(most_rounds):
        left = rows.join(lost, [source, content], "left_anti")
        place = F.row_number().over(W.partitionBy(source).orderBy(order, content))
        chosen = left.withColumn("_n", place).where(F.col("_n") <= wanted).drop("_n")
        first = chosen.groupBy(content).agg(F.min(source).alias("_first"))
        beaten = settle(chosen.join(first, content).where(F.col(source) != F.col("_first")).select(source, content), "beaten")
        if beaten.isEmpty():
            return chosen
        lost = lost.unionByName(beaten)
    raise RuntimeError("sources didn't settle")


def accept_near_in_order(candidates: DataFrame, source: str, order: str, bits: str, wanted: int, radius: int, reference: DataFrame | None = None, most_rounds: int = 1000) -> DataFrame:
    """candidates that are accepted when each source in turn takes its first `wanted` images (by order) that lie more than
    radius bits away from all that were taken before, by itself or by the sources before it; and from reference (bits).

    What source after source would do is decided in rounds over all of them. An image goes once an accepted one before it is
    near; it is accepted once nothing undecided before it is near and it is among the first `wanted` of its source that aren't
    gone; a source that has its images gives up the rest. The first undecided image is decided in every round, and far more
    where conflicts are few. Neighbours are those of distinct patterns, found by bands once, and rounds pass the least
    place of a pattern along them: copies of an image cost one row each, never pairs. Each round is written.
    """
    rows = candidates.select(source, order, F.col(bits).cast("long").alias(bits)).distinct()
    if reference is not None:
        rows = hamming_semi(rows, reference.select(F.col(bits).cast("long").alias(bits)), bits, radius, "left_anti")
    rows = settle(rows.withColumn("_taken", F.lit(False)), "candidates")
    values = rows.select(bits).distinct()
    near = values.select(F.col(bits).alias("_of"), F.col(bits).alias("_near"))
    if radius:
        pairs = hamming_pairs(values, values, bits, radius)
        near = near.unionByName(pairs.select(F.col(f"a.{bits}").alias("_of"), F.col(f"b.{bits}").alias("_near")).where("_of <> _near"))
    near = settle(near, "near")
    me = F.struct(source, order)
    for _ in range(most_rounds):
        least = rows.groupBy(F.col(bits).alias("_near")).agg(F.min(F.when(F.col("_taken"), me)).alias("_t"), F.min(F.when(~F.col("_taken"), me)).alias("_u"))
        around = near.join(least, "_near").groupBy(F.col("_of").alias(bits)).agg(F.min("_t").alias("_t"), F.min("_u").alias("_u"))
        place = F.row_number().over(W.partitionBy(source).orderBy(order, bits))
        first = rows.withColumn("_n", place).where(F.col("_n") <= wanted).groupBy(source).agg(F.max(order).alias("_last"), (F.count_if(F.col("_taken")) >= wanted).alias("_full"))
        seen = rows.join(around, bits).join(first, source)
        gone = ~F.col("_taken") & (F.coalesce(F.col("_t") < me, F.lit(False)) | F.col("_full"))
        free = F.col("_taken") | (F.coalesce(F.col("_u") == me, F.lit(True)) & (F.col(order) <= F.col("_last")))
        rows = settle(seen.where(~gone).select(source, order, bits, free.alias("_taken")), "decided")
        if rows.where("not _taken").isEmpty():
            return rows.drop("_taken")
    raise RuntimeError("sources didn't settle")


def second_pass_union(rows: DataFrame, group: str, item: str, first: Column, mean: Column, fraction: Column, tried: Column, mean_gate: float, fraction_gate: float) -> DataFrame:
    """group and items: what the first pass found, together with the second pass's items that weren't tried before and reach both
    gates; and how many the second pass adds. A group without either isn't there."""
    second = F.coalesce(~tried & (mean >= mean_gate) & (fraction >= fraction_gate), F.lit(False))
    marked = rows.select(group, item, F.coalesce(first, F.lit(False)).alias("_first"), second.alias("_second")).where("_first or _second")
    one = marked.groupBy(group, item).agg(F.bool_or("_first").alias("_first"))
    return one.groupBy(group).agg(F.array_sort(F.collect_list(item)).alias("items"), F.count_if(~F.col("_first")).alias("added"))
