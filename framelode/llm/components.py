"""Connected components of a table of links, by alternating star contractions; nothing but counts comes to the driver."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from .common import settle


def _contracted(links: DataFrame, most: int = 1 << 16) -> DataFrame:
    """Links tied to the least node that `most` links of a task, taken together, connect them with: shorter paths, fewer rows."""

    def stars(a: list[int], b: list[int]) -> pa.RecordBatch:
        up: dict[int, int] = {}

        def top(x: int) -> int:
            root = x
            while (above := up.get(root, root)) != root:
                root = above
            while x != root:
                up[x], x = root, up.get(x, x)
            return root

        for x, y in zip(a, b, strict=True):
            x, y = top(x), top(y)
            up[max(x, y)] = min(x, y)
        ties = [(root, x) for x in up if (root := top(x)) != x]
        return pa.RecordBatch.from_arrays([pa.array([t[i] for t in ties], type=pa.int64()) for i in (0, 1)], names=["a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a, b = [], []
        for batch in batches:
            a += batch.column(0).to_pylist()
            b += batch.column(1).to_pylist()
            if len(a) >= most:
                yield stars(a, b)
                a, b = [], []
        if a:
            yield stars(a, b)

    return links.select("a", "b").mapInArrow(run, "a long, b long")


def _stars(edges: DataFrame, upward: bool) -> DataFrame:
    """One contraction: each node's neighbours that lie above it (upward), or not above it, are tied to the least of all."""
    both = edges.select(F.col("b").alias("u"), F.col("a").alias("v"))
    if upward:
        both = both.unionByName(edges.select(F.col("a").alias("u"), F.col("b").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("of"), F.least("u", "m").alias("m"))
    tied = both.join(least, F.col("u") == F.col("of"))
    if upward:
        out = tied.where("v > u").select(F.col("m").alias("a"), F.col("v").alias("b"))
    else:
        out = tied.select("m", F.explode(F.array("u", "v")).alias("b")).select(F.col("m").alias("a"), "b")
    return out.where("a < b").distinct()


def components(links: DataFrame, most_rounds: int = 60) -> DataFrame:
    """links (a, b) of longs -> (node, root): root is the least node that can be reached. Nodes without links don't occur.

    Every round at least halves the distance to the least node; rounds end when one changes nothing, which is seen by
    counts taken while it is written (a repeated task may ask for one more round). The rows of each contraction are written
    to the shared folder, so a lost executor repeats one of them at most. The least neighbours come from partial
    aggregation and meet their nodes in a join, so a node with very many links may be split.
    """

    def written(edges: DataFrame, label: str) -> tuple[DataFrame, tuple]:
        seen = Observation()
        found = settle(edges.observe(seen, F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("sum")), label)
        return found, tuple(seen.get.values())

    edges, was = written(_contracted(links.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a < b")).distinct(), "links")
    for _ in range(most_rounds):
        if not was[0]:
            break
        edges, now = written(_stars(settle(_stars(edges, True), "stars"), False), "stars")
        if now == was:
            break
        was = now
    else:
        raise RuntimeError("components didn't settle")
    return edges.select(F.col("b").alias("node"), F.col("a").alias("root")).unionByName(edges.select(F.col("a").alias("node"), F.col("a").alias("root")).distinct())
