"""Packing into optimal length buckets, in DataFrame operations only.

Texts are cut into pieces of at most max_words words. Dynamic programming over the histogram of piece lengths, which has
at most max_words + 1 rows, chooses the bucket bounds with the least padding in total; each bucket is then dealt, in a
shuffled order, into batches that hold as many pieces, padded to the bound, as the token budget allows.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import hashed_slot, running_total, settle, word_count


def bucket_bounds(histogram: dict[int, int], buckets: int) -> list[int]:
    """Upper bounds, increasing, of at most buckets buckets with the least sum of (bound - length) over all pieces."""
    lengths = np.array(sorted(k for k, n in histogram.items() if n > 0), dtype=np.int64)
    if not len(lengths):
        return []
    counts = np.array([histogram[int(k)] for k in lengths], dtype=np.float64)
    n, words = np.concatenate([[0.0], np.cumsum(counts)]), np.concatenate([[0.0], np.cumsum(counts * lengths)])
    u = len(lengths)
    best, choice = np.full(u + 1, np.inf), []
    best[0] = 0.0
    for _ in range(min(buckets, u)):
        step, came = np.full(u + 1, np.inf), np.zeros(u + 1, dtype=np.int64)
        for j in range(1, u + 1):
            cost = best[:j] + lengths[j - 1] * (n[j] - n[:j]) - (words[j] - words[:j])
            came[j] = int(np.argmin(cost))
            step[j] = cost[came[j]]
        choice.append(came)
        best = step
    bounds, j = [], u
    for came in reversed(choice):
        bounds.append(int(lengths[j - 1]))
        j = int(came[j])
        if j == 0:
            break
    return bounds[::-1]


def pieces(docs: DataFrame, max_words: int, with_text: bool) -> DataFrame:
    """One row for each piece: doc_id, piece, start (its first word), length, and its text if asked for."""
    n = word_count(F.col("text"))
    many = F.greatest(F.lit(1), F.ceil(n / max_words)).cast("int")
    if not with_text:
        rows = docs.select("doc_id", n.alias("_n"), F.explode(F.sequence(F.lit(0), many - 1)).alias("piece"))
    else:
        # each piece takes the white space before its words, the last one also that behind them: the pieces join to the text
        cut = F.regexp_extract_all(F.col("text"), F.lit(rf"(?:[\x20\x09-\x0D]*+[^\x20\x09-\x0D]++){{1,{max_words}}}+(?:[\x20\x09-\x0D]++\z)?"), F.lit(0))
        texts = F.when(n <= max_words, F.array(F.coalesce(F.col("text"), F.lit("")))).otherwise(cut)
        rows = docs.select("doc_id", n.alias("_n"), F.posexplode(texts).alias("piece", "text"))
    start = F.col("piece").cast("long") * max_words
    return rows.select("doc_id", "piece", start.alias("start"), F.least(F.lit(max_words), F.col("_n") - start).alias("length"), *(["text"] if with_text else []))


def pack(docs: DataFrame, max_words: int = 2048, buckets: int = 8, batch_words: int = 16384, with_text: bool = False) -> DataFrame:
    """doc_id, piece, start, length, bucket (bound in words), padding, batch, place (in the batch) and, if asked for, text.

    batch numbers count from 0 within a bucket; (bucket, batch) names a batch, of floor(batch_words / bucket) places but
    at least one; a bucket of bound 0 is dealt as one of bound 1. A null or empty text is one piece of length 0. Rows with
    equal ids are dealt one by one. An empty table gives an empty one.
    """
    rows = pieces(docs, max_words, with_text)
    narrow = settle(rows, "pack-pieces") if not with_text else rows
    lengths = pieces(docs, max_words, False) if with_text else narrow
    histogram = {r["length"]: r["n"] for r in lengths.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}
    bounds = bucket_bounds(histogram, buckets)

    def bucket_of(length: Column) -> Column:
        out = F.lit(bounds[-1] if bounds else 0)
        for b in reversed(bounds[:-1]):
            out = F.when(length <= b, F.lit(b)).otherwise(out)
        return out.cast("long")

    placed = narrow.withColumn("bucket", bucket_of(F.col("length"))).withColumn("_slot", hashed_slot("doc_id", "piece", "length")).withColumn("_one", F.lit(1).cast("long"))
    if with_text:
        # texts wait in files while the narrow rows find their places
        placed = settle(placed, "pack-texts")
    placed = running_total(placed, "bucket", "_slot", ["doc_id", "piece", "length"], "_one", "_at").drop("_total")
    places = F.greatest(F.lit(1), F.floor(F.lit(batch_words) / F.greatest(F.lit(1), F.col("bucket")))).cast("long")
    at = F.col("_at") - 1
    return placed.select("doc_id", "piece", "start", "length", "bucket", (F.col("bucket") - F.col("length")).alias("padding"), F.floor(at / places).cast("long").alias("batch"), (at % places).cast("int").alias("place"), *(["text"] if with_text else []))
