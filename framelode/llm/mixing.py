"""Mixing sources to target weights by weighted fair queueing, in DataFrame operations only.

Each document, in a shuffled order of its source, gets the virtual finish time (source words so far) / (target of the
source); a document may pass once for each epoch. The mix is the global order of virtual finish times up to the budget.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .common import hashed_slot, running_total, settle, word_count

#: Bins of virtual time in each of the two passes that look for the cut.
BINS = 4096


def source_targets(sizes: DataFrame, weights: tuple[float, ...], share: float, epochs: int) -> DataFrame:
    """Targets by water-filling: weight times a common level, at most epochs times the source's size.

    sizes: source_key, source, source_size. In order of the level at which a source is full, each row's level supposes
    that all before it are full; the first source that isn't full has the final one. One row a source, so the windows
    without a key see as many rows as there are sources.
    """
    ranked = sizes.withColumn("_rank", F.row_number().over(W.orderBy(F.col("source").asc_nulls_last())) - 1)
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("_rank") % len(weights) + 1).cast("int"))
    ranked = ranked.withColumn("_weight", weight).withColumn("_cap", F.col("source_size") * float(epochs)).withColumn("_full_at", F.col("_cap") / F.col("_weight"))
    order = W.orderBy("_full_at", "_rank")
    budget = F.sum("source_size").over(W.partitionBy()) * float(share)
    earlier = F.coalesce(F.sum("_cap").over(order.rowsBetween(W.unboundedPreceding, -1)), F.lit(0.0))
    left = F.sum("_weight").over(order.rowsBetween(0, W.unboundedFollowing))
    ranked = ranked.withColumn("_level", (budget - earlier) / left)
    level = F.first(F.when(F.col("_full_at") > F.col("_level"), F.col("_level")), ignorenulls=True).over(order.rowsBetween(W.unboundedPreceding, W.unboundedFollowing))
    target = F.when(level.isNull(), F.col("_cap")).otherwise(F.least(F.col("_cap"), F.col("_weight") * level))
    return ranked.select("source_key", F.col("source_size"), target.alias("target"))


def finish_times(units: DataFrame, weights: tuple[float, ...], share: float, epochs: int) -> DataFrame:
    """units (source_key, source, unit_size, slot, tie) with source_size, target and virtual finish times, one an epoch."""
    sizes = units.groupBy("source_key").agg(F.first("source").alias("source"), F.sum("unit_size").alias("source_size"))
    targets = source_targets(sizes, weights, share, epochs)
    timed = running_total(units, "source_key", "slot", ["tie"], "unit_size", "_words", per_group=targets).drop("_total")
    times = [F.when(F.col("target") > 0, (F.lit(e) * F.col("source_size") + F.col("_words")) / F.col("target")) for e in range(epochs)]
    return timed.withColumn("finish", F.array(*times)).drop("_words")


def cut(timed: DataFrame, epochs: int) -> tuple[float, int] | None:
    """Where the global order of virtual times reaches the budget: the last (time, tie) that is in, or None for none.

    Two histograms of BINS bins narrow the virtual time down, then a window runs over the rows of one bin of the second.
    Only histograms, whose size is fixed, and one row come to the driver.
    """
    passes = timed.select(F.posexplode("finish").alias("_epoch", "_at"), "tie", "unit_size").where(F.col("_at").isNotNull() & (F.col("unit_size") > 0))
    passes = passes.withColumn("_tie", F.xxhash64("tie", "_epoch"))
    budget = timed.groupBy("source_key").agg(F.first("target").alias("t")).agg(F.sum("t")).first()[0]
    if not budget:
        return None
    # a hair more, so that sums of doubles don't cut off the last document of a mix that takes everything
    left, lo, width, best = int(budget + 1e-6), 0.0, 4.0 / BINS, None
    for _ in range(2):
        number = F.least(F.floor((F.col("_at") - lo) / width), F.lit(BINS)).cast("int")
        found = passes.groupBy(number.alias("bin")).agg(F.sum("unit_size").alias("n"), F.max(F.struct("_at", "_tie")).alias("last")).orderBy("bin").collect()
        stop = None
        for row in found:
            if row["n"] > left:
                stop = row["bin"]
                break
            left, best = left - row["n"], (row["last"]["_at"], row["last"]["_tie"])
        if stop is None:
            return best
        passes = passes.where(number == stop)
        if stop == BINS:
            break
        lo, width = lo + stop * width, width / BINS
    passes = passes.withColumn("_sum", F.sum("unit_size").over(W.orderBy("_at", "_tie").rowsBetween(W.unboundedPreceding, 0)))
    last = passes.where(F.col("_sum") <= left).agg(F.max(F.struct("_at", "_tie")).alias("last")).first()["last"]
    return (last["_at"], last["_tie"]) if last else best


def decide(rows: DataFrame, weights: tuple[float, ...] = (3.0, 1.0, 2.0), share: float = 1.5, epochs: int = 2) -> DataFrame:
    """How often the mix takes each document.

    rows: doc_id, source, size. Rows that agree in all three are one unit, which is taken or left together. Returns
    doc_id, source, size, n (rows of the unit), source_size, target, copies (0 to epochs) and finish, an array of the
    virtual times of the passes. Nulls: a null source is a source of its own and the last in order; a null doc_id is
    an id like others. Documents without words always pass once and take nothing. An empty table gives an empty one.
    """
    key = F.when(F.col("source").isNull(), F.lit("-")).otherwise(F.concat(F.lit("+"), F.col("source")))
    units = rows.groupBy("doc_id", "source", "size").agg(F.count(F.lit(1)).alias("n"))
    units = units.select("*", key.alias("source_key"), (F.col("size") * F.col("n")).alias("unit_size"), hashed_slot("doc_id", "source", "size").alias("slot"), F.xxhash64(F.lit(7), "doc_id", "source", "size").alias("tie"))
    units = settle(units, "mix-units")
    timed = settle(finish_times(units, weights, share, epochs), "mix-times")
    end = cut(timed, epochs)

    def passed(e: int) -> Column:
        at = F.col("finish")[e]
        if end is None:
            return F.lit(0)
        return F.when((at < end[0]) | ((at == end[0]) & (F.xxhash64("tie", F.lit(e)) <= end[1])), 1).otherwise(0)

    copies = F.when(F.col("unit_size") == 0, F.lit(1)).otherwise(reduce(lambda a, b: a + b, [passed(e) for e in range(epochs)]))
    return timed.select("doc_id", "source", "size", "n", "source_size", "target", copies.cast("int").alias("copies"), "finish")


def sized(docs: DataFrame) -> DataFrame:
    return docs.select("doc_id", "source", word_count(F.col("text")).alias("size"))


def mixed_documents(docs: DataFrame, weights: tuple[float, ...] = (3.0, 1.0, 2.0), share: float = 1.5, epochs: int = 2) -> DataFrame:
    """The mix itself: rows of docs, one for each pass, range-sorted by virtual finish time; columns as in docs."""
    chosen = decide(sized(docs), weights, share, epochs).where("copies > 0")
    chosen = chosen.select(F.col("doc_id").alias("_id"), F.col("source").alias("_source"), F.col("size").alias("_size"), "copies", "finish")
    # rows travel as one column, so that none of theirs clashes with those of the mix
    keyed = docs.select(F.struct("*").alias("_row"), F.col("doc_id").alias("_doc"), F.col("source").alias("_of"), word_count(F.col("text")).alias("_words"))
    both = keyed.join(chosen, keyed["_doc"].eqNullSafe(chosen["_id"]) & keyed["_of"].eqNullSafe(chosen["_source"]) & (keyed["_words"] == chosen["_size"]))
    passes = both.select("_row", F.explode(F.slice("finish", 1, F.col("copies"))).alias("_at"))
    return passes.orderBy("_at").select("_row.*")
