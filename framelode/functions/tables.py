"""Table functions over Arrow batches: rows in, more rows out, without a shuffle of what comes between."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .geometry import _samples


class _Samples:
    """A table (id, lines, spacing) as one row a sample: the samples of sample_polylines, placed from 0 within their row.

    A null or empty set of lines has no samples. All rows of a batch with one spacing are sampled at once.
    """

    kind = np.float32

    def eval(self, rows: pa.RecordBatch) -> Iterator[pa.Table]:
        ids, lines, spacing = (rows.column(c) for c in ("id", "lines", "spacing"))
        for value in pc.unique(spacing).to_pylist():
            own = pc.equal(spacing, value) if value is not None else pc.is_null(spacing)
            some, kept = lines.filter(own), ids.filter(own)
            at, row = _samples(some, 2.0 if value is None else value, self.kind)
            first = np.searchsorted(row, row, side="left")
            points = at.astype(np.float64)
            yield pa.table({"id": kept.take(pa.array(row, type=pa.int64())), "place": pa.array(np.arange(len(row)) - first), "x": pa.array(points[:, 0]), "y": pa.array(points[:, 1])})


class _DoubleSamples(_Samples):
    """The same in double precision throughout."""

    kind = np.float64


PolylineSamples, DoublePolylineSamples = (F.arrow_udtf(c, returnType="id long, place long, x double, y double") for c in (_Samples, _DoubleSamples))


def register_tables(spark: SparkSession) -> None:
    """Make the table functions known to SQL: SELECT * FROM polyline_samples(TABLE(lines))."""
    spark.udtf.register("polyline_samples", PolylineSamples)


def polyline_samples(rows: DataFrame, double: bool = False) -> DataFrame:
    """rows (id, lines, spacing) as samples (id, place, x, y); in single precision, as sample_polylines has them, or in double."""
    return (DoublePolylineSamples if double else PolylineSamples)(rows.select(F.col("id").cast("long"), "lines", F.col("spacing").cast("double")).asTable())
