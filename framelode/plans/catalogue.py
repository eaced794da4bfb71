"""Every query of the library by the name of its operator, with the SQL that states the same."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import dedup, gates, splits
from . import documents, relations, rows, sequences, workbench
from .tables import SAMPLES, SPLIT, samples, split_of

MODULES = [rows, relations, sequences, documents, workbench]


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dataset build: gate, keep the latest of each content, take frozen splits, and count by split and source."""
    rules = [("short", F.col("n_chars") >= 100), ("unreviewed", F.col("quality").isNotNull()), ("rejected", F.col("quality") == 1)]
    kept, _ = gates.split_gated(gates.gate_cascade(samples(spark, sf_dir), rules))
    latest = dedup.latest_wins(kept, "sha", ["n_chars", "doc_id"])
    groups = latest.select("source").distinct()
    before = groups.where(F.regexp_extract("source", r"(\d+)$", 1).cast("int") < 15).withColumn("split", split_of(F.col("source")))
    assigned = latest.join(splits.frozen(groups, before, "source"), "source")
    return assigned.groupBy("split", "source").agg(F.count(F.lit(1)).alias("samples"), F.count_if(F.col("toxic") == 1).alias("toxic"), F.sum("n_chars").alias("chars"))


FLAGSHIP = f"""WITH {SAMPLES}, k AS (SELECT *, row_number() OVER (PARTITION BY sha ORDER BY n_chars DESC, doc_id DESC) AS n FROM samples WHERE n_chars >= 100 AND quality = 1),
s AS (SELECT *, CASE WHEN CAST(regexp_extract(source, '(\\d+)$', 1) AS INTEGER) < 15 THEN {SPLIT} ELSE 'train' END AS split FROM k WHERE n = 1)
SELECT split, source, count(*) AS samples, count(*) FILTER (WHERE toxic = 1) AS toxic, CAST(sum(n_chars) AS BIGINT) AS chars FROM s GROUP BY ALL"""


def _all() -> dict:
    out = {"dataset_build": (flagship, FLAGSHIP)}
    for module in MODULES:
        out |= module.Q
    return out


def queries() -> dict:
    return {name: f for name, (f, _) in _all().items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for name, (_, sql) in _all().items() if sql}
