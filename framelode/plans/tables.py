"""Frames, boxes, samples and votes as the supplied tables have them, in Spark and, with the same columns, in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as a frame stream: one group a user, frames counted from 0 in the order of time."""
    at = F.row_number().over(W.partitionBy("user_id").orderBy("ts", "event_id")) - 1
    return read(spark, sf_dir, "events").select(F.col("user_id").alias("grp"), at.cast("long").alias("frame"), "event_id", "ts", "event_type", "value", "props")


FRAMES = "frames AS (SELECT user_id AS grp, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS frame, event_id, ts, event_type, value, props FROM events)"


def boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of orders as detections: one frame an order, a box of four doubles, confidence and class."""
    at = F.row_number().over(W.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice"))
    x, y = (F.col("l_partkey") % 60).cast("double"), (F.col("l_suppkey") % 40).cast("double")
    # numbered first: what is derived then doesn't go through the shuffle, and its partitions serve groups by frame
    return read(spark, sf_dir, "lineitem").withColumn("det", at.cast("long")).select(
        F.col("l_orderkey").alias("frame"), "det", x.alias("x1"), y.alias("y1"), (x + 20 + F.col("l_quantity")).alias("x2"), (y + 15 + 8 * F.col("l_linenumber")).alias("y2"),
        (F.col("l_discount") * 9 + 0.05).alias("conf"), (F.col("l_linenumber") % 2).cast("long").alias("cls"),
    )


BOXES = """boxes AS (SELECT l_orderkey AS frame, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS det,
  CAST(l_partkey % 60 AS DOUBLE) AS x1, CAST(l_suppkey % 40 AS DOUBLE) AS y1, CAST(l_partkey % 60 AS DOUBLE) + 20 + l_quantity AS x2, CAST(l_suppkey % 40 AS DOUBLE) + 15 + 8 * l_linenumber AS y2,
  l_discount * 9 + 0.05 AS conf, CAST(l_linenumber % 2 AS BIGINT) AS cls FROM lineitem)"""


def box(prefix: str = "") -> F.Column:
    return F.array(*[F.col(prefix + c) for c in ("x1", "y1", "x2", "y2")])


def samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as samples, with their content's digest and their labels where there are any."""
    labels = read(spark, sf_dir, "labels")
    return read(spark, sf_dir, "documents").withColumn("sha", F.sha2("text", 256)).join(labels, "doc_id", "left")


SAMPLES = "samples AS (SELECT d.*, sha256(d.text) AS sha, l.quality, l.toxic FROM documents d LEFT JOIN labels l USING (doc_id))"


def split_of(source: F.Column) -> F.Column:
    """The split of a source by its number: 0-6 train, 7-8 val, 9 test, modulo 10."""
    n = F.regexp_extract(source, r"(\d+)$", 1).cast("int") % 10
    return F.when(n < 7, "train").when(n < 9, "val").otherwise("test")


SPLIT = "CASE WHEN CAST(regexp_extract(source, '(\\d+)$', 1) AS INTEGER) % 10 < 7 THEN 'train' WHEN CAST(regexp_extract(source, '(\\d+)$', 1) AS INTEGER) % 10 < 9 THEN 'val' ELSE 'test' END"
