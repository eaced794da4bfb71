"""What the operators of this folder share: words, scratch tables, running totals without hot windows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..scratch import settle

__all__ = ["WORD", "hashed_slot", "read_table", "running_total", "settle", "word_count"]

#: A word is a maximal run of bytes other than the ASCII white space characters.
WORD = r"[^\x20\x09-\x0D]+"


def word_count(text: Column) -> Column:
    """Words of a text; null counts as empty."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def running_total(df: DataFrame, group: str, slot: str, order: list[str], value: str, out: str, per_group: DataFrame | None = None, shifts: tuple[int, int] = (16, 24)) -> DataFrame:
    """Inclusive running sum of value per group in the order (slot, *order), with the group's total as _total.

    slot is a non-negative long. No task sees a whole group: rows are summed in runs of slots (slot >> shifts[0]), the
    runs in runs of runs (slot >> shifts[1]), and each level adds the offset of the level above. per_group holds more
    columns for each group; they are joined at the upper level, so that a hot group costs a few hundred rows there.
    """
    df = df.withColumn("_run", F.shiftright(F.col(slot), shifts[0]))
    runs = df.groupBy(group, "_run").agg(F.sum(value).alias("_sum")).withColumn("_upper", F.shiftright(F.col("_run"), shifts[1] - shifts[0]))
    before = lambda c, *keys, by: F.coalesce(F.sum(c).over(W.partitionBy(*keys).orderBy(by).rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    upper = runs.groupBy(group, "_upper").agg(F.sum("_sum").alias("_usum"))
    upper = upper.withColumn("_ustart", before("_usum", group, by="_upper")).withColumn("_total", F.sum("_usum").over(W.partitionBy(group))).drop("_usum")
    if per_group is not None:
        upper = upper.join(per_group, group)
    runs = runs.join(upper, [group, "_upper"]).withColumn("_start", F.col("_ustart") + before("_sum", group, "_upper", by="_run")).drop("_ustart", "_sum", "_upper")
    inside = F.sum(value).over(W.partitionBy(group, "_run").orderBy(slot, *order).rowsBetween(W.unboundedPreceding, 0))
    return df.join(runs, [group, "_run"]).withColumn(out, F.col("_start") + inside).drop("_start", "_run")


def hashed_slot(*columns: str) -> Column:
    """32 even bits of a row, as a slot for running_total: a shuffle that reruns repeat."""
    return F.xxhash64(F.lit(20), *columns).bitwiseAND(F.lit(0xFFFFFFFF))


def read_table(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return df.select(*columns) if columns else df
