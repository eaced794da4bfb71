"""Approximate nearest neighbours by balanced posting lists.

Centroids of a bounded sample are the heads of posting lists; every vector goes to the lists of its nearest head and of
further ones about as near, unless a head lies nearer to one chosen before than the vector does. A graph of the
heads, held in memory, is searched for the heads near a query, and all those are probed whose distance is within a ratio of
that of the fifth one: the ratio alone decides how many. Lists meet queries block by block, both of bounded size, so a
long or popular list is the work of many tasks.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .common import settle

#: Vectors that centroids are fitted on, at most; vectors a list should hold; heads, at most.
SAMPLE, LIST_SIZE, MOST_HEADS = 32_768, 48, 8192
#: Copies of a boundary vector; how much farther a head may be (squared distances) for a copy; and for a probe than the
#: fifth nearest head.
REPLICAS, COPY_RATIO, PROBE_RATIO = 4, 1.25, 1.3
#: Neighbours of a head in the graph, heads that a search begins with, heads followed in one step of it, vectors of a list
#: and queries of a list in one block.
DEGREE, BEAM, STEP, BLOCK, ASKED = 16, 64, 8, 512, 4096
#: Products by BLAS are off by less than this; what lies as near to the last one chosen is compared exactly.
SLACK = 1e-12


def _unit(x: np.ndarray) -> np.ndarray:
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def balanced_heads(x: np.ndarray, heads: int, rounds: int = 8) -> np.ndarray:
    """k-means whose assignment pays for a list's length, so that lists are of about equal size."""
    rng = np.random.default_rng(4)
    heads = max(1, min(heads, len(x)))
    c = x[rng.permutation(len(x))[:heads]].copy()
    size = np.full(heads, len(x) / heads)
    for _ in range(rounds):
        near = np.empty(len(x), dtype=np.int64)
        for at in range(0, len(x), 4096):
            near[at : at + 4096] = np.argmin(2 - 2 * x[at : at + 4096] @ c.T + 0.02 * (size / (len(x) / heads) - 1), axis=1)
        now = np.bincount(near, minlength=heads)
        size = 0.5 * size + 0.5 * now
        sums = np.zeros_like(c)
        np.add.at(sums, near, x)
        filled = now > 0
        c[filled] = sums[filled] / now[filled, None]
        c[~filled] = x[rng.integers(0, len(x), int((~filled).sum()))]
        norm = np.linalg.norm(c, axis=1, keepdims=True)
        c = np.where(norm > 1e-9, c / np.maximum(norm, 1e-9), c)
    return c.astype(np.float32)


def head_graph(c: np.ndarray, degree: int = DEGREE) -> np.ndarray:
    """Neighbours of each head: its nearest ones, of which one that lies nearer to a chosen one comes later, and links back."""
    k = len(c)
    degree = min(degree, k - 1)
    if degree < 1:
        return np.zeros((k, 1), dtype=np.int32)
    out = np.empty((k, degree), dtype=np.int32)
    for at in range(0, k, 1024):
        d = 2 - 2 * c[at : at + 1024] @ c.T
        d[np.arange(len(d)), np.arange(at, at + len(d))] = np.inf
        pool = min(k - 1, 3 * degree)
        near = np.argpartition(d, pool - 1, axis=1)[:, :pool]
        for i in range(len(d)):
            order = near[i][np.argsort(d[i, near[i]], kind="stable")]
            apart = 2 - 2 * c[order] @ c[order].T
            chosen: list[int] = []
            rest: list[int] = []
            for j in range(len(order)):
                if len(chosen) < degree and all(apart[j, m] > d[i, order[j]] for m in chosen):
                    chosen.append(j)
                else:
                    rest.append(j)
            out[at + i] = order[(chosen + rest)[:degree]]
    return out


def graph_search(q: np.ndarray, c: np.ndarray, graph: np.ndarray, beam: int) -> tuple[np.ndarray, np.ndarray]:
    """The beam of heads found near each query, nearest first, with squared distances: best-first over the graph, all
    queries at once, the STEP best heads of each that aren't followed yet at a time."""
    n, k = len(q), len(c)
    beam = min(beam, k)
    step = min(STEP, beam)
    entries = np.linspace(0, k - 1, min(k, 32)).astype(np.int64)
    ids = np.full((n, beam), -1, dtype=np.int64)
    dist = np.full((n, beam), np.inf, dtype=np.float32)
    done = np.ones((n, beam), dtype=bool)
    seen = np.zeros((n, k), dtype=bool)

    def merge(rows: np.ndarray, new: np.ndarray, d: np.ndarray) -> None:
        all_ids = np.concatenate([ids[rows], new], axis=1)
        all_d = np.concatenate([dist[rows], d], axis=1)
        all_done = np.concatenate([done[rows], np.isinf(d)], axis=1)
        order = np.argsort(all_d, axis=1, kind="stable")[:, :beam]
        ids[rows], dist[rows], done[rows] = (np.take_along_axis(a, order, axis=1) for a in (all_ids, all_d, all_done))

    seen[:, entries] = True
    merge(np.arange(n), np.tile(entries, (n, 1)), 2 - 2 * q @ c[entries].T)
    while True:
        open_d = np.where(done, np.inf, dist)
        best = np.argpartition(open_d, step - 1, axis=1)[:, :step]
        rows = np.flatnonzero(np.isfinite(open_d.min(axis=1)))
        if not len(rows):
            return np.where(np.isinf(dist), -1, ids), dist
        best = best[rows]
        live = np.isfinite(open_d[rows[:, None], best])
        done[rows[:, None], best] = True
        new = np.where(live[:, :, None], graph[np.maximum(ids[rows[:, None], best], 0)], -1).reshape(len(rows), -1).astype(np.int64)
        new.sort(axis=1)
        again = (new < 0) | np.concatenate([np.zeros((len(rows), 1), dtype=bool), new[:, 1:] == new[:, :-1]], axis=1)
        new = np.maximum(new, 0)
        again |= seen[rows[:, None], new]
        d = np.where(again, np.inf, 2 - 2 * np.einsum("nd,nkd->nk", q[rows], c[new])).astype(np.float32)
        fresh, at = np.nonzero(~again)
        seen[rows[fresh], new[fresh, at]] = True
        merge(rows, new, d)


def near_heads(q: np.ndarray, c: np.ndarray, graph: np.ndarray, ratio: float = PROBE_RATIO) -> tuple[np.ndarray, np.ndarray]:
    """(row, head) of the heads within ratio times the distance of the fifth nearest one, however many; the beam widens
    for the queries whose last head found is still within."""
    rows, out, beam = np.arange(len(q)), [], BEAM
    while len(rows):
        ids, d = graph_search(q[rows], c, graph, beam)
        limit = ratio * np.maximum(d[:, min(4, d.shape[1] - 1)], 1e-6)
        limit = np.where(np.isfinite(limit), limit, np.inf)[:, None]
        within = (d <= limit) & (ids >= 0)
        full = within[:, -1] if beam < len(c) else np.zeros(len(rows), dtype=bool)
        at, place = np.nonzero(within & ~full[:, None])
        out.append((rows[at], ids[at, place]))
        rows, beam = rows[full], 4 * beam
    return np.concatenate([r for r, _ in out] or [np.empty(0, np.int64)]), np.concatenate([h for _, h in out] or [np.empty(0, np.int64)])


def chosen_lists(x: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, list) of each vector: its nearest head, and up to REPLICAS - 1 further ones within COPY_RATIO."""
    d = 2 - 2 * x @ c.T
    pool = min(len(c), 3 * REPLICAS)
    near = np.argpartition(d, pool - 1, axis=1)[:, :pool]
    near = np.take_along_axis(near, np.argsort(np.take_along_axis(d, near, axis=1), axis=1, kind="stable"), axis=1)
    own = np.take_along_axis(d, near, axis=1)
    take = np.zeros(near.shape, dtype=bool)
    take[:, 0] = True
    for j in range(1, pool):
        fits = (own[:, j] <= COPY_RATIO * np.maximum(own[:, 0], 1e-6)) & (take.sum(axis=1) < REPLICAS)
        for m in range(j):
            between = 2 - 2 * np.einsum("nd,nd->n", c[near[:, j]], c[near[:, m]])
            fits &= ~take[:, m] | (between > own[:, j])
        take[:, j] = fits
    rows, at = np.nonzero(take)
    return rows, near[rows, at]


def valid(vectors: DataFrame) -> tuple[DataFrame, int]:
    """Rows whose vector has numbers only, isn't zero and has the commonest length (of equally common ones the least).

    Vectors are scaled by a power of two, which changes no digit, so that their squares neither vanish nor overflow.
    """
    good = F.col("embedding").isNotNull() & F.forall("embedding", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))) & F.exists("embedding", lambda v: v != 0)
    rows = vectors.where(good).withColumn("_size", F.size("embedding"))
    found = rows.groupBy("_size").count().orderBy(F.desc("count"), "_size").first()
    size = found["_size"] if found else 0
    largest = F.array_max(F.transform("embedding", F.abs))
    scale = F.pow(F.lit(2.0), -F.greatest(F.lit(-1000.0), F.least(F.lit(1000.0), F.floor(F.log2(largest)).cast("double"))))
    return rows.where(F.col("_size") == size).withColumn("_scale", scale).select("vec_id", F.transform("embedding", lambda v: v * F.col("_scale")).alias("embedding")), size


def _matrix(column: pa.Array, size: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, size)


def build(rows: DataFrame, n: int, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Heads and their graph, fitted on the SAMPLE distinct vectors with the least hashes."""
    heads = int(min(MOST_HEADS, max(1, n // LIST_SIZE)))
    range_end = ((1 << 63) - 1) * min(n, 2 * SAMPLE) // max(1, n)
    some = rows.withColumn("_h", F.shiftrightunsigned(F.xxhash64(F.lit(4), "embedding"), 1)).where(F.col("_h") <= range_end).orderBy("_h").limit(SAMPLE).select("embedding").toArrow()
    x = _unit(_matrix(some.column(0).combine_chunks(), size)).astype(np.float32) if some.num_rows else np.zeros((1, max(1, size)), dtype=np.float32)
    c = balanced_heads(x, heads)
    return c, head_graph(c)


def _in_order(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Dot product of each pair of rows, summed from the first component on: the same value wherever a pair meets."""
    total = np.zeros(len(a))
    for j in range(a.shape[1]):
        total += a[:, j] * b[:, j]
    return total


def best_of_block(asks: np.ndarray, x: np.ndarray, ids: np.ndarray, keep: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row of asks, id, cosine) of the `keep` nearest rows of x to each row of asks, ties to the smaller id."""
    norm_q, norm_x = np.sqrt(_in_order(asks, asks)), np.sqrt(_in_order(x, x))
    score = (asks @ x.T) / (norm_q[:, None] * norm_x)
    last = np.partition(score, -min(keep, len(x)), axis=1)[:, -min(keep, len(x))]
    row, at = np.nonzero(score >= last[:, None] - SLACK)
    exact = _in_order(asks[row], x[at]) / (norm_q[row] * norm_x[at])
    order = np.lexsort((ids[at], -exact, row))
    row, at, exact = row[order], at[order], exact[order]
    begin = np.searchsorted(row, np.arange(len(asks)))
    first = np.arange(len(row)) - begin[row] < keep
    return row[first], ids[at[first]], exact[first]


def search(vectors: DataFrame, is_query, k: int = 5, ratio: float = PROBE_RATIO) -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest by cosine found for each row for which is_query(vec_id) holds.

    vectors: vec_id, embedding. A query's own row is no candidate of it; equal scores are ordered by vec_id. Vectors that
    are null, zero, of another length than most, or hold what isn't a finite number take no part, however small or large
    others are; with fewer candidates than k all that the probed lists hold are returned. An infinite ratio probes all
    lists and is exact. Equal vectors are one entry with their k + 1 least ids, so a vector that many rows share is no
    long list; a null vec_id takes no part; rows that repeat both id and vector count once. Heads and graph are of
    bounded size (MOST_HEADS) and go to every task; an empty table gives an empty result.
    """
    rows, size = valid(vectors.select(F.col("vec_id").cast("long"), F.col("embedding").cast("array<double>")).where("vec_id is not null"))
    least = F.row_number().over(W.partitionBy("embedding").orderBy("vec_id"))
    twins = rows.distinct().withColumn("_r", least)
    entries = settle(twins.where(F.col("_r") <= k + 1).groupBy("embedding").agg(F.array_sort(F.collect_list("vec_id")).alias("ids")).withColumn("entry", F.element_at("ids", 1)), "entries")
    n = entries.count()
    c, graph = build(entries, n, size)
    sent = entries.sparkSession.sparkContext.broadcast((c, graph))

    def post(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        heads, _ = sent.value
        for batch in batches:
            for at in range(0, batch.num_rows, 2048):
                some = batch.slice(at, 2048)
                rows, lists = chosen_lists(_unit(_matrix(some.column(1), size)).astype(np.float32), heads)
                yield pa.RecordBatch.from_arrays([pa.array(lists), some.column(0).take(pa.array(rows))], names=["list", "entry"])

    def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        heads, links = sent.value
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                some = batch.slice(at, 512)
                x = _unit(_matrix(some.column(1), size)).astype(np.float32)
                if np.isinf(ratio):
                    rows, lists = (v.ravel() for v in np.indices((len(x), len(heads))))
                else:
                    rows, lists = near_heads(x, heads, links, ratio)
                yield pa.RecordBatch.from_arrays([pa.array(lists), some.column(0).take(pa.array(rows))], names=["list", "query"])

    # lists and probes are pairs of numbers; vectors join them when both are dealt into blocks
    posted = settle(entries.select("entry", "embedding").mapInArrow(post, "list long, entry long"), "postings")
    asked = rows.where(is_query(F.col("vec_id"))).select("embedding").distinct().join(entries.select("embedding", "entry"), "embedding").select(F.col("entry").alias("query"), "embedding")
    asked = settle(asked, "asked")
    probes = settle(asked.mapInArrow(probe, "list long, query long"), "probes")
    parts = lambda t, per, name: t.groupBy("list").agg(F.ceil(F.count(F.lit(1)) / per).alias(name))
    sizes = settle(parts(posted, BLOCK, "blocks").join(parts(probes, ASKED, "turns"), "list"), "list-sizes").withColumnRenamed("list", "of")
    spread = lambda t, own, other, item: t.join(sizes, F.col("list") == F.col("of")).select("list", F.pmod(F.xxhash64(item), F.col(own[0])).alias(own[1]), F.explode(F.sequence(F.lit(0).cast("long"), F.col(other[0]) - 1)).alias(other[1]), item)
    left = spread(posted, ("blocks", "block"), ("turns", "turn"), "entry").join(entries.select("entry", "embedding"), "entry").select("list", "block", "turn", "entry", "embedding")
    right = spread(probes, ("turns", "turn"), ("blocks", "block"), "query").join(asked, "query").select("list", "block", "turn", "query", "embedding")

    def meet(key: tuple, lists: pa.Table, queries: pa.Table) -> pa.Table:
        out = [[np.empty(0, np.int64)], [np.empty(0, np.int64)], [np.empty(0)]]
        if lists.num_rows and queries.num_rows:
            x, ids = _matrix(lists.column("embedding").combine_chunks(), size), lists.column("entry").to_numpy()
            asks, names = _matrix(queries.column("embedding").combine_chunks(), size), queries.column("query").to_numpy()
            for at in range(0, len(asks), 256):
                row, entry, score = best_of_block(asks[at : at + 256], x, ids, k + 1)
                for column, found in zip(out, (names[at : at + 256][row], entry, score), strict=True):
                    column.append(found)
        return pa.table(dict(zip(("query", "entry", "score"), map(np.concatenate, out), strict=True)))

    keys = ["list", "block", "turn"]
    met = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(meet, "query long, entry long, score double")
    # an entry may come from several lists, with the same score
    found = met.groupBy("query", "entry").agg(F.max("score").alias("score"))
    best = found.withColumn("_r", F.row_number().over(W.partitionBy("query").orderBy(F.desc("score"), "entry"))).where(F.col("_r") <= k + 1)
    single = best.join(entries.select("entry", "ids"), "entry").select("query", F.explode("ids").alias("vec_id"), "score")
    top = single.withColumn("_r", F.row_number().over(W.partitionBy("query").orderBy(F.desc("score"), "vec_id"))).where(F.col("_r") <= k + 1)
    # back to all ids of a query's vector, each without itself
    named = rows.where(is_query(F.col("vec_id"))).distinct().join(entries.select("embedding", F.col("entry").alias("query")), "embedding").select(F.col("vec_id").alias("query_id"), "query")
    final = named.join(top.drop("_r"), "query").where(F.col("vec_id") != F.col("query_id"))
    rank = F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return final.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
