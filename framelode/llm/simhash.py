"""SimHash near-duplicates by the generalised pigeonhole principle.

Correlated bits of the fingerprints are grouped into partitions; a partition of threshold t is compared by its values with
t bits masked out, in every way, so it finds what differs in at most t of its bits. Dynamic programming over estimated
candidate counts chooses bounds and thresholds, which may differ and may be -1 (a partition that isn't probed); what meets
is verified.

near_duplicates() links 64-bit fingerprints within a radius: the sum of (t + 1) over partitions is radius + 1, so each such
pair agrees in a masked value of some partition. duplicates_by_similarity() links texts by the Jaccard similarity of their
distinct shingles. Such pairs differ in a share of bits that follows from the similarity, about 0.15 at 0.8: of 64 bits ten,
for which no set of partitions is both complete and cheap. So its fingerprints have 512 bits, the sum is one of log misses
of a pair just at the bound, and links are verified on the shingles themselves.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import combinations
from math import acos, comb, log, pi, sqrt

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .common import settle
from .components import components

#: Bits of the blocks that partitions are made of; cost of a signature row and of a candidate pair in the programs below.
BLOCK, ROW_COST, PAIR_COST = 4, 1.0, 0.01
#: Groups of signatures up to this size are compared pair by pair on whole arrays, larger ones, and those in which nearly all are
#: near, by a search that drops what it has reached; of up to so many connected members all links are verified at once, the rest
#: of a crowded group's pairs later, in cells of at most about so many rows of a group by as many, and so many shingles. A group
#: has LEAST_BLOCKS blocks at least, unless it is small.
PAIRWISE, SMALL, CELL, SHARE, LEAST_BLOCKS = 128, 24, 1024, 1_000_000, 8
#: Longs of a fingerprint of texts that are linked by similarity, and those of them that go with a signature; share of pairs
#: just at the bound that may have no candidate; standard deviations beyond the bits that such a pair is expected to differ in.
LONGS, SENT, MISS, DEVIATIONS = 8, 2, 0.003, 3.5
#: Odd constants that make further longs of a shingle's hash.
SPREAD = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xFF51AFD7ED558CCD, 0xC4CEB9FE1A85EC53, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB], dtype=np.uint64)


def shingle_hashes(text: bytes | None, width: int) -> np.ndarray:
    """XXH64 of each word shingle, repeats included; A-Z are lower-cased, fewer words than width are one shingle."""
    words = (text or b"").lower().split()
    if not words:
        return np.empty(0, dtype=np.uint64)
    joined = b" ".join(words)
    if len(words) <= width:
        return np.array([xxhash.xxh64_intdigest(joined, 42)], dtype=np.uint64)
    ends = np.cumsum(np.fromiter(map(len, words), dtype=np.int64, count=len(words)) + 1) - 1
    starts = np.concatenate([[0], ends[:-width] + 1]).tolist()
    digest = xxhash.xxh64_intdigest
    return np.fromiter((digest(joined[s:e], 42) for s, e in zip(starts, ends[width - 1 :].tolist(), strict=True)), dtype=np.uint64, count=len(starts))


def majority(hashes: np.ndarray) -> np.ndarray:
    """hashes (shingles, longs): a bit is 1 if it is set in over half of the rows; without rows all are 0."""
    n, longs = hashes.shape
    ones = np.zeros(64 * longs, dtype=np.int64)
    for at in range(0, n, 255 * 64):
        bits = np.unpackbits(np.ascontiguousarray(hashes[at : at + 255 * 64]).view(np.uint8), bitorder="little").reshape(-1, 64 * longs)
        # sums of up to 255 rows fit in a byte
        for k in range(0, len(bits), 255):
            ones += np.add.reduce(bits[k : k + 255], axis=0, dtype=np.uint8)
    return np.packbits(ones * 2 > n, bitorder="little").view(np.int64)


def widened(hashes: np.ndarray, longs: int) -> np.ndarray:
    """(shingles, longs): the hashes, and for each further long the hashes mixed with a constant of its own."""
    with np.errstate(over="ignore"):
        x = (hashes ^ (hashes >> np.uint64(32)))[:, None] * SPREAD[: longs - 1]
        x = (x ^ (x >> np.uint64(29))) * SPREAD[-1]
    return np.concatenate([hashes[:, None], x ^ (x >> np.uint64(32))], axis=1)


def fingerprint(text: bytes | None, width: int = 4) -> int:
    """SimHash of the word shingles of a text, repeats included; no words give 0."""
    return int(majority(shingle_hashes(text, width)[:, None])[0]) & (1 << 64) - 1


def fingerprints(docs: DataFrame, width: int = 4) -> DataFrame:
    """doc_id and fp (the 64 bits as a long) of each row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            prints = [majority(shingle_hashes(t.as_py(), width)[:, None]) for t in batch.column(1).cast(pa.binary())]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.concatenate(prints or [np.empty(0, np.int64)]))], names=["doc_id", "fp"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, fp long")


def wide_fingerprints(docs: DataFrame, width: int, longs: int = LONGS) -> DataFrame:
    """doc_id, k1, k2 (128 bits of hashes of the text) and f0, f1 ...: the majority bits of the distinct shingles of each row.

    The longs after the first are majorities of the shingles' hashes, mixed with a constant of their own.
    """
    names = ["doc_id", "k1", "k2", *(f"f{i}" for i in range(longs))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [majority(widened(np.unique(shingle_hashes(t.as_py(), width)), longs)) for t in batch.column(3).cast(pa.binary())]
            prints = np.array(rows, dtype=np.int64).reshape(-1, longs)
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], *(pa.array(np.ascontiguousarray(prints[:, i])) for i in range(longs))], names=names)

    return docs.select(F.col("doc_id").cast("long"), *text_key(), "text").mapInArrow(run, ", ".join(f"{n} long" for n in names))


def text_key() -> tuple[Column, Column]:
    """128 bits of hashes of a text; a null text has a key of its own."""
    return F.xxhash64("text").alias("k1"), F.xxhash64(F.lit(2), "text", F.length("text")).alias("k2")


def _bits(fps: np.ndarray) -> np.ndarray:
    """(rows, longs) as (rows, bits)."""
    return np.unpackbits(np.ascontiguousarray(fps, dtype=np.int64).view(np.uint8), bitorder="little").reshape(len(fps), -1)


def _columns(table: DataFrame) -> list[str]:
    return [c for c in table.columns if c == "fp" or c[0] == "f" and c[1:].isdigit()]


def _stacked(batch: pa.RecordBatch, first: int = 0) -> np.ndarray:
    return np.stack([c.to_numpy() for c in batch.columns[first:]], axis=1) if batch.num_rows else np.empty((0, batch.num_columns - first), np.int64)


def _summed(table: DataFrame, count: Callable[[np.ndarray], np.ndarray], cells: int, fan: int = 32) -> np.ndarray:
    """Sums of count(fps) over all rows: cells numbers, whatever the number of rows or tasks.

    Each task has one row of sums, packed; `fan` tasks add these up as they stream by, then one adds theirs, so a table of
    very many tasks costs a row each, and the driver gets one.
    """

    def packed(total: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([total.tobytes()], type=pa.binary())], names=["sums"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, seen = np.zeros(cells, dtype=np.int64), False
        for batch in batches:
            fps, seen = _stacked(batch), seen or batch.num_rows > 0
            for at in range(0, len(fps), 16_384):
                total += count(fps[at : at + 16_384])
        if seen:
            yield packed(total)

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, seen = np.zeros(cells, dtype=np.int64), False
        for batch in batches:
            for sums in batch.column(0):
                total += np.frombuffer(sums.as_py(), dtype=np.int64)
                seen = True
        if seen:
            yield packed(total)

    parts = table.select(*_columns(table)).mapInArrow(run, "sums binary").withColumn("_to", F.pmod(F.spark_partition_id(), F.lit(fan)))
    found = parts.repartition(fan, "_to").select("sums").mapInArrow(add, "sums binary").repartition(1).mapInArrow(add, "sums binary").collect()
    return np.frombuffer(bytes(found[0].sums), dtype=np.int64) if found else np.zeros(cells, dtype=np.int64)


def bit_order(distinct: DataFrame) -> tuple[list[int], int]:
    """All bits in a chain in which each is followed by the free one that correlates most with it; and the number of rows."""
    bits = 64 * len(_columns(distinct))

    def count(fps: np.ndarray) -> np.ndarray:
        x = _bits(fps).astype(np.float32)
        return np.append(np.rint(x.T @ x).astype(np.int64).ravel(), len(fps))

    found = _summed(distinct, count, bits * bits + 1)
    both, n = found[:-1].reshape(bits, bits).astype(float), max(1.0, float(found[-1]))
    p = np.diag(both) / n
    spread = np.sqrt(np.maximum(p * (1 - p), 1e-12))
    r = np.abs(both / n - np.outer(p, p)) / np.outer(spread, spread)
    np.fill_diagonal(r, -1)
    chain = [int(np.unravel_index(np.argmax(r), r.shape)[0])]
    free = np.ones(bits, dtype=bool)
    for _ in range(bits - 1):
        free[chain[-1]] = False
        chain.append(int(np.argmax(np.where(free, r[chain[-1]], -2))))
    return chain, int(found[-1])


def block_distances(distinct: DataFrame, chain: list[int], radius: int) -> np.ndarray:
    """For each block of the chain, the share of pairs of all fingerprints that differ in 0, 1 ... radius of its bits."""
    blocks, values = len(chain) // BLOCK, 1 << BLOCK
    weight = 1 << np.arange(BLOCK)

    def count(fps: np.ndarray) -> np.ndarray:
        value = _bits(fps)[:, chain].reshape(-1, blocks, BLOCK) @ weight + values * np.arange(blocks)
        return np.bincount(value.ravel(), minlength=blocks * values)

    h = _summed(distinct, count, blocks * values).reshape(blocks, values).astype(float)
    h /= np.maximum(1.0, h.sum(axis=1, keepdims=True))
    apart = np.array([[(i ^ j).bit_count() for j in range(values)] for i in range(values)])
    return np.array([[float(x @ ((apart == d) @ x)) for d in range(radius + 1)] for x in h])


def _costs(distances: np.ndarray, n: int, most: int) -> dict[tuple[int, int, int], float]:
    """Cost of each run of blocks (first, end) with threshold t, 0 to most and 3.

    It has C(bits, t) signatures a fingerprint, and for each pair that differs in d <= t of its bits C(bits - d, t - d)
    comparisons. A run has 32 bits at most.
    """
    out = {}
    for first in range(len(distances)):
        within = np.zeros(distances.shape[1])
        within[0] = 1.0
        for end in range(first + 1, min(len(distances), first + 32 // BLOCK) + 1):
            within = np.convolve(within, distances[end - 1])[: distances.shape[1]]
            bits = BLOCK * (end - first)
            for t in range(min(most, 3) + 1):
                pairs = sum(within[d] * comb(bits - d, t - d) for d in range(t + 1))
                out[first, end, t] = ROW_COST * n * comb(bits, t) + PAIR_COST * n * n / 2 * pairs
    return out


def allocate(distances: np.ndarray, n: int, radius: int) -> list[tuple[int, int, int]]:
    """(first block, end block, threshold) of each probed partition, such that all pairs within the radius meet, at least cost.

    The program runs over block bounds and over what is used of radius + 1.
    """
    blocks = len(distances)
    cost = _costs(distances, n, radius)
    best: dict[tuple[int, int], tuple[float, tuple]] = {(0, 0): (0.0, ())}
    for end in range(1, blocks + 1):
        for first in range(end):
            for used in range(radius + 2):
                if (first, used) not in best:
                    continue
                old = best[first, used]
                for t in range(-1, radius + 1 - used):
                    if t >= 0 and (first, end, t) not in cost:
                        continue
                    new = (old[0] + (cost[first, end, t] if t >= 0 else 0.0), (*old[1], (first, end, t)) if t >= 0 else old[1])
                    if new[0] < best.get((end, used + t + 1), (np.inf,))[0]:
                        best[end, used + t + 1] = new
    return list(best[blocks, radius + 1][1])


def allocate_for(distances: np.ndarray, n: int, apart: float, miss: float = MISS, units: int = 64) -> list[tuple[int, int, int]]:
    """As allocate(), for pairs that differ in each bit with probability apart: all but a share `miss` of them meet.

    A partition misses such a pair with the probability of more than t differing bits; the program runs over block bounds
    and over what is used of -log(miss), in `units` steps, partitions counting in whole steps.
    """
    blocks, step = len(distances), -log(miss) / units
    cost = _costs(distances, n, 2)
    gain = {}
    for bits in range(BLOCK, 33, BLOCK):
        for t in range(3):
            found = sum(comb(bits, d) * apart**d * (1 - apart) ** (bits - d) for d in range(t + 1))
            gain[bits, t] = min(units, int(-log(max(1e-12, 1 - found)) / step))
    best = np.full((blocks + 1, units + 1), np.inf)
    best[0, 0] = 0.0
    came: dict[tuple[int, int], tuple[int, int, int]] = {}
    for end in range(1, blocks + 1):
        best[end] = best[end - 1]
        for used in range(units + 1):
            came[end, used] = (end - 1, used, -1)
        for first in range(max(0, end - 32 // BLOCK), end):
            for t in range(3):
                own, plus = gain[BLOCK * (end - first), t], cost[first, end, t]
                for used in np.flatnonzero(np.isfinite(best[first])).tolist():
                    to = min(units, used + own)
                    if own and best[first, used] + plus < best[end, to]:
                        best[end, to] = best[first, used] + plus
                        came[end, to] = (first, used, t)
    out, at = [], (blocks, int(np.flatnonzero(np.isfinite(best[blocks]))[-1]))
    while at[0]:
        first, used, t = came[at]
        if t >= 0:
            out.append((first, at[0], t))
        at = (first, used)
    return out[::-1]


def signatures(distinct: DataFrame, chain: list[int], parts: list[tuple[int, int, int]], sent: int = 1) -> DataFrame:
    """(key, node, first longs): for each partition and each set of masked bits, the remaining value, tagged with both."""
    plans = []
    for number, (first, end, t) in enumerate(parts):
        bits = chain[first * BLOCK : end * BLOCK]
        masks = [np.int64((1 << len(bits)) - 1 - sum(1 << i for i in m)) for m in combinations(range(len(bits)), t)]
        plans.append((number, bits, masks))
    names = _columns(distinct)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bits = _bits(_stacked(batch, 1)).astype(np.int64)
            for number, own, masks in plans:
                value = bits[:, own] @ (np.int64(1) << np.arange(len(own), dtype=np.int64))
                for k, mask in enumerate(masks):
                    key = (value & mask) | np.int64((number << 16 | k) << 32)
                    yield pa.RecordBatch.from_arrays([pa.array(key), *batch.columns[: 1 + sent]], names=["key", "node", *names[:sent]])

    return distinct.select("node", *names).mapInArrow(run, ", ".join(f"{c} long" for c in ("key", "node", *names[:sent])))


def _near(a: np.ndarray, b: np.ndarray, radius: int) -> np.ndarray:
    return np.bitwise_count((a ^ b).view(np.uint64)).sum(axis=-1) <= radius


def spanning_links(nodes: np.ndarray, fps: np.ndarray, radius: int, more: bool = False) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """Links that connect what lies within the radius in one group, by breadth-first search over the not yet reached.

    With more, for links that are still to be verified: all of up to SMALL connected members, and of further ones also
    those that connect what lies within half of the radius.
    """
    a, b, rest = [], [], np.arange(len(nodes))
    while len(rest):
        queue, rest = [rest[0]], rest[1:]
        at = 0
        while at < len(queue) and len(rest):
            x = queue[at]
            at += 1
            near = _near(fps[rest], fps[x], radius)
            if near.any():
                found, rest = rest[near], rest[~near]
                a.append(np.full(len(found), nodes[x]))
                b.append(nodes[found])
                queue.extend(found.tolist())
        if more and 2 < len(queue) <= SMALL:
            own = np.array(queue)
            i, j = np.triu_indices(len(own), 1)
            near = _near(fps[own[i]], fps[own[j]], radius)
            a.append(nodes[own[i[near]]])
            b.append(nodes[own[j[near]]])
        elif more and len(queue) > SMALL:
            own = np.array(queue)
            x, y = spanning_links(nodes[own], fps[own], radius // 2)
            a += x
            b += y
    return a, b


def few_links(nodes: np.ndarray, fps: np.ndarray, radius: int, fold: int = 3) -> tuple[list[np.ndarray], list[np.ndarray]] | None:
    """All links within the radius in one group; None if these are more than fold times its members."""
    a, b, found = [], [], 0
    for i in range(len(nodes) - 1):
        near = _near(fps[i + 1 :], fps[i], radius)
        b.append(nodes[i + 1 :][near])
        a.append(np.full(len(b[-1]), nodes[i]))
        found += len(b[-1])
        if found > fold * len(nodes):
            return None
    return a, b


def near_links(signed: DataFrame, radius: int, more: bool = False) -> DataFrame:
    """(a, b): links of nodes within the radius, enough of them to connect all that each group of equal keys connects.

    With more, for links that are still to be verified: (a, b, crowd) with all links of a group, but for a crowded one, with
    over three links a member: it gives spanning links, marked by crowd; what else is within reach of each other in it comes
    from links_of_crowds().
    """
    names = ["a", "b", "crowd"] if more else ["a", "b"]

    def solve(columns: list[np.ndarray]) -> pa.RecordBatch:
        keys, nodes, fps = columns[0], columns[1], np.stack(columns[2:], axis=1)
        new = np.concatenate([[True], keys[1:] != keys[:-1]])
        starts, group = np.flatnonzero(new), np.cumsum(new) - 1
        sizes = np.diff(np.concatenate([starts, [len(keys)]]))
        a, b, of = [], [], []
        place = np.arange(len(keys)) - starts[group]
        left = np.where(sizes[group] > PAIRWISE, 0, sizes[group] - place - 1)  # rows of the group that follow
        at, step = np.flatnonzero(left > 0), 1
        while len(at):
            near = at[_near(fps[at], fps[at + step], radius)]
            a.append(nodes[near])
            b.append(nodes[near + step])
            of.append(group[near])
            step += 1
            at = at[left[at] >= step]
        dense = sizes > PAIRWISE
        if of:
            a, b, of = (np.concatenate(x) for x in (a, b, of))
            dense |= np.bincount(of, minlength=len(sizes)) > 3 * sizes
            a, b = [a[~dense[of]]], [b[~dense[of]]]
        crowd = [np.zeros(len(x), dtype=np.int64) for x in a]
        for at in np.flatnonzero(dense):
            own = slice(starts[at], starts[at] + sizes[at])
            if more and sizes[at] > PAIRWISE and (all_of := few_links(nodes[own], fps[own], radius)) is not None:
                (x, y), crowded = all_of, 0
            else:
                (x, y), crowded = spanning_links(nodes[own], fps[own], radius, more), 1
            a += x
            b += y
            crowd += [np.full(len(z), crowded) for z in x]
        a, b, crowd = (np.concatenate(x) if x else np.empty(0, np.int64) for x in (a, b, crowd))
        keep = a != b
        found = [np.minimum(a, b)[keep], np.maximum(a, b)[keep], *([crowd[keep]] if more else [])]
        found = np.unique(np.stack(found, axis=1), axis=0)
        return pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(x)) for x in found.T], names=names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[list[np.ndarray]] = []
        for batch in batches:
            now = [c.to_numpy() for c in batch.columns]
            k = now[0]
            if not len(k):
                continue
            if (held[0][0][0] if held else k[0]) != k[-1]:
                last = int(np.searchsorted(k, k[-1]))  # the last group may go on in the next batch
                yield solve([np.concatenate([*(h[i] for h in held), now[i][:last]]) for i in range(len(now))])
                held = [[c[last:] for c in now]]
            else:
                held.append(now)
        if held:
            yield solve([np.concatenate([h[i] for h in held]) for i in range(len(held[0]))])

    return signed.repartition("key").sortWithinPartitions("key").mapInArrow(run, ", ".join(f"{c} long" for c in names))


def links_between(members: DataFrame, linked: DataFrame, within: float, cell: int = CELL, share: int = SHARE) -> DataFrame:
    """(a, b): links between members of one group that are of different components so far.

    members: key, node and first longs, for all links that differ in `within` bits at most; or key, node and hashes (a set), for
    links of at least this Jaccard similarity: verified where sets meet, and enough of them to connect all that they connect,
    so a cell gives fewer links than it has rows. linked: node, root. A group is dealt into blocks, each pair of which is
    compared by itself, so that neither rows nor links of a large group meet in one task. Groups of one component have nothing
    to give.
    """
    longs, sets = _columns(members), "hashes" in members.columns
    light = members.select("key", "node", (F.size("hashes") if sets else F.lit(1)).alias("size"))
    rooted = light.join(linked, "node", "left").withColumn("root", F.coalesce("root", "node"))
    n = F.count(F.lit(1))
    blocks = F.ceil(F.greatest(n / cell, F.sum("size") / share, F.least(n * LEAST_BLOCKS / cell, F.lit(LEAST_BLOCKS)))).cast("int")
    mixed = rooted.groupBy("key").agg(F.min("root").alias("_least"), F.max("root").alias("_most"), blocks.alias("_blocks"))
    dealt = rooted.join(mixed.where("_least < _most"), "key").withColumn("own", F.pmod(F.xxhash64("node"), F.col("_blocks")).cast("int"))
    dealt = dealt.withColumn("_other", F.explode(F.sequence(F.lit(0), F.col("_blocks") - 1)))
    dealt = dealt.select("key", F.least("own", "_other").alias("low"), F.greatest("own", "_other").alias("high"), "own", "node", "root")
    dealt = dealt.join(members, ["key", "node"])

    def arranged(rows: pa.Table) -> tuple[pa.Table, np.ndarray, np.ndarray, int]:
        """Rows, nodes and roots with those of the lower block first, and the number of these."""
        lower = rows.column("own").to_numpy() == rows.column("low").to_numpy()
        rows = rows.take(np.argsort(~lower, kind="stable"))
        return rows, rows.column("node").to_numpy(), rows.column("root").to_numpy(), int(lower.sum())

    def links(a: list[np.ndarray], b: list[np.ndarray]) -> pa.Table:
        a, b = (np.concatenate([np.empty(0, np.int64), *x]) for x in (a, b))
        return pa.table({"a": np.minimum(a, b), "b": np.maximum(a, b)})

    def compare(rows: pa.Table) -> pa.Table:
        rows, nodes, roots, split = arranged(rows)
        fps = np.stack([rows.column(c).to_numpy() for c in longs], axis=1)
        a, b = [], []
        for i in range(split):
            rest = slice(split if split < len(nodes) else i + 1, None)
            near = (roots[rest] != roots[i]) & _near(fps[rest], fps[i], within)
            b.append(nodes[rest][near])
            a.append(np.full(len(b[-1]), nodes[i]))
        return links(a, b)

    def verify(rows: pa.Table) -> pa.Table:
        rows, nodes, roots, split = arranged(rows)
        roots, column = roots.copy(), rows.column("hashes").combine_chunks()
        starts = column.offsets.to_numpy().astype(np.int64)
        values, ids = np.unique(column.values.to_numpy()[starts[0] : starts[-1]], return_inverse=True)
        starts, held = starts - starts[0], np.zeros(len(values), dtype=bool)
        sizes = np.diff(starts)
        a, b = [], []
        for i in range(split):
            first = split if split < len(nodes) else i + 1
            if (roots[first:] == roots[i]).all():
                continue
            own = ids[starts[i] : starts[i + 1]]
            held[own] = True
            met = np.concatenate([[0], np.cumsum(held[ids[starts[first] :]])])[starts[first:] - starts[first]]
            held[own] = False
            common = np.diff(met)
            similar = first + np.flatnonzero((roots[first:] != roots[i]) & (common >= within * (sizes[i] + sizes[first:] - common) - 1e-9))
            _, one = np.unique(roots[similar], return_index=True)  # a link for each component that is met
            b.append(nodes[similar[one]])
            a.append(np.full(len(one), nodes[i]))
            roots[np.isin(roots, roots[similar])] = roots[i]
        return links(a, b)

    return dealt.groupBy("key", "low", "high").applyInArrow(verify if sets else compare, "a long, b long").distinct()


def near_duplicates(docs: DataFrame, width: int = 4, radius: int = 4) -> DataFrame:
    """doc_id, fp (long) and component_id of each row of docs.

    A null text has no words; no words give fingerprint 0, which is linked like any other. Rows may repeat. component_id
    is the least doc_id that can be reached by links, null where all of the component's ids are null. An empty table
    gives an empty one. Copies share a fingerprint and are one node; a group of near copies is connected by a search
    that gives one link for each member and key, not by all its pairs.
    """
    prints = settle(fingerprints(docs, width), "prints")
    distinct = settle(prints.groupBy("fp").agg(F.min("doc_id").alias("least")).withColumn("node", F.col("fp")), "distinct")
    chain, n = bit_order(distinct)
    parts = allocate(block_distances(distinct, chain, radius), n, radius)
    linked = components(near_links(signatures(distinct, chain, parts), radius))
    of_node = distinct.join(linked.withColumnRenamed("node", "of"), F.col("fp") == F.col("of"), "left").withColumn("root", F.coalesce("root", "fp"))
    of_root = of_node.groupBy("root").agg(F.min("least").alias("component_id"))
    nodes = settle(of_node.join(of_root, "root").select("fp", "component_id"), "nodes")
    return prints.join(nodes, "fp").select("doc_id", "fp", "component_id")


def _shingle_sets(docs: DataFrame, wanted: DataFrame, width: int) -> DataFrame:
    """node and hashes (the distinct ones, sorted) of the texts of wanted (node, k1, k2); copies of a text give one row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now = None
        for batch in batches:
            nodes, sets = [], []
            for node, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                if node != now:
                    now = node
                    nodes.append(node)
                    sets.append(np.unique(shingle_hashes((text.as_py() or "").encode("utf-8", "surrogatepass"), width)).view(np.int64))
            yield pa.RecordBatch.from_arrays([pa.array(nodes, type=pa.int64()), pa.array(sets, type=pa.list_(pa.int64()))], names=["node", "hashes"])

    texts = docs.select(*text_key(), "text").join(wanted, ["k1", "k2"])
    return texts.sortWithinPartitions("k1", "k2").select("node", "text").mapInArrow(run, "node long, hashes array<long>")


def similar_links(sets: DataFrame, links: DataFrame, similarity: float) -> DataFrame:
    """The links (a, b) whose nodes have sets (node, hashes) of at least this Jaccard similarity."""
    side = lambda name: sets.select(F.col("node").alias(name), F.col("hashes").alias(f"of_{name}"))
    both = links.join(side("a"), "a").join(side("b"), "b")
    common = F.size(F.array_intersect("of_a", "of_b"))
    return both.where(common >= similarity * (F.size("of_a") + F.size("of_b") - common) - 1e-9).select("a", "b")


def links_of_crowds(sets: DataFrame, crowded: DataFrame, linked: DataFrame, similarity: float) -> DataFrame:
    """(a, b): links of at least this similarity between what crowded links (a, b) connect and linked (node, root) doesn't yet.

    What crowded links connect, taken over the components so far, is one group; its texts are compared by their sets, all with
    all, and no pair becomes a row unless it is similar.
    """
    of = lambda side: linked.select(F.col("node").alias(side), F.col("root").alias(f"root_{side}"))
    ends = crowded.join(of("a"), "a", "left").join(of("b"), "b", "left").select(F.coalesce("root_a", "a").alias("a"), F.coalesce("root_b", "b").alias("b"))
    groups = components(ends.where("a <> b")).select(F.col("node").alias("root"), F.col("root").alias("key"))
    nodes = crowded.select(F.explode(F.array("a", "b")).alias("node")).distinct().join(linked, "node", "left").select("node", F.coalesce("root", "node").alias("root"))
    return links_between(nodes.join(groups, "root").select("key", "node").join(sets, "node"), linked, similarity)


def duplicates_by_similarity(docs: DataFrame, width: int = 5, similarity: float = 0.8) -> DataFrame:
    """doc_id, k1, k2 and root of each distinct (id, text) that stands for its near-duplicates: the one with the least id.

    Texts of at least this Jaccard similarity of distinct shingles of `width` words are linked, and linked ones are one
    group; see the module's text for how they are found. Texts of equal fingerprints are taken as equal. A null text has
    no words, and texts without words are one group. Null ids come last; of equal ids the least hash of the text.
    """
    prints = settle(wide_fingerprints(docs, width), "prints")
    longs = _columns(prints)
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "k1", "k2")).alias("first")
    nodes = prints.groupBy(*longs).agg(first).select(F.monotonically_increasing_id().alias("node"), *longs, "first")
    nodes = settle(nodes, "nodes")
    cosine = 2 * similarity / (1 + similarity)
    apart = acos(cosine) / pi
    bits = 64 * SENT
    radius = int(bits * apart + DEVIATIONS * sqrt(bits * apart * (1 - apart)))
    chain, n = bit_order(nodes)
    parts = allocate_for(block_distances(nodes, chain, 2), n, apart)
    met = settle(near_links(signatures(nodes, chain, parts, SENT), radius, more=True), "candidates")
    keys = nodes.select("node", F.col("first.k1").alias("k1"), F.col("first.k2").alias("k2"))
    links = met.select("a", "b").distinct()
    wanted = keys.join(links.select(F.explode(F.array("a", "b")).alias("node")).distinct(), "node", "left_semi")
    # a hot copy's rows may be split over tasks, each of which gives its set
    sets = settle(_shingle_sets(docs, wanted, width), "shingles").dropDuplicates(["node"])
    similar = settle(similar_links(sets, links, similarity), "similar")
    linked = settle(components(similar), "linked")
    # the rest of crowded groups: all pairs of what isn't connected by then
    rest = settle(links_of_crowds(sets, met.where("crowd = 1").select("a", "b").distinct(), linked, similarity), "rest")
    if not rest.isEmpty():
        linked = components(similar.unionByName(rest))
    rooted = nodes.select("node", "first").join(linked.withColumnRenamed("node", "of"), F.col("node") == F.col("of"), "left").select(F.coalesce("root", "node").alias("root"), "first")
    return rooted.groupBy("root").agg(F.min("first").alias("first")).select("first.doc_id", "first.k1", "first.k2", "root")


def deduplicated(docs: DataFrame, width: int = 5, similarity: float = 0.8) -> DataFrame:
    """One row of docs for each group of near-duplicates, columns as in docs; see duplicates_by_similarity().

    Rows are told apart by id and text, so that texts under one id, or none, are judged one by one; of rows that agree in
    both, the first in the order of their columns stays. An empty table gives an empty one.
    """
    kept = settle(duplicates_by_similarity(docs, width, similarity), "kept").select("k1", "k2", F.col("doc_id").alias("id"), F.col("doc_id").isNull().alias("none"))
    rows = docs.select(*text_key(), F.col("doc_id").cast("long").alias("id"), F.struct("*").alias("row"))
    met = rows.join(kept.withColumnsRenamed({"id": "_id"}), ["k1", "k2"]).where((F.col("id") == F.col("_id")) | (F.col("none") & F.col("id").isNull()))
    # what is left, about one row a group, is dealt anew: so the join's side of a text that very many rows hold may be split
    met = met.select(F.concat_ws(",", "k1", "k2", "id").alias("unit"), "row")
    order = [F.col(f"row.`{c}`") for c in docs.columns if c != "doc_id" and not docs.schema[c].dataType.simpleString().startswith(("map", "variant"))]
    return met.withColumn("at", F.row_number().over(W.partitionBy("unit").orderBy(*order or [F.lit(0)]))).where("at = 1").select("row.*")
