"""Removal of repeated passages by suffix arrays of shards.

A string of LENGTH bytes that occurs twice has the same minimiser, the least of the hashes of its GRAM-byte strings, at
the same place in both. So each text is cut into contexts, runs of starts whose strings share a minimiser: only
minimisers that stand at two places go on. Equal contexts are settled as they stand (all their strings repeat), and one of
each kind of a minimiser with several kinds goes, with its bytes, to a shard whose suffix array is induced; its permuted
common prefixes say which other strings repeat.

A text is known by 128 bits of hashes, and rows with equal texts are one text: it goes whole, and stands for its copies.
A minimiser that very many texts share is never one group: equal contexts are combined where texts are read, minimisers
and kinds are counted by partial aggregation, and rows meet these counts in joins whose large side can be split.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import settle
from .suffix_array import permuted_lcp, suffix_array, words_of

#: Bytes of a minimiser; bytes of text hashed at a time; bytes of a shard's suffix array; contexts combined at a time.
GRAM, CHUNK, SHARD, HELD = 64, 1 << 19, 1 << 20, 1 << 18
#: A place is packed as the start of the minimiser, and in 8 bits each the starts before it and the starts in all.
_MULT = np.uint64(0x9E3779B97F4A7C15)


def _table() -> np.ndarray:
    """A 64-bit number for each byte, from a fixed recurrence."""
    x, out = np.uint64(88172645463325252), []
    for _ in range(256):
        x ^= x << np.uint64(13)
        x ^= x >> np.uint64(7)
        x ^= x << np.uint64(17)
        out.append(x)
    return np.array(out, dtype=np.uint64)


TABLE = _table()


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(29))


def gram_hashes(data: np.ndarray, size: int) -> np.ndarray:
    """Hash of the `size` (a power of two) bytes from each position; one shorter by size - 1 than data."""
    h, mult, width = TABLE[data], _MULT, 1
    with np.errstate(over="ignore"):
        while width < size:
            h = h[:-width] * mult + h[width:]
            mult = mult * mult
            width *= 2
        return _mix(h)


def contexts(data: np.ndarray, offsets: np.ndarray, length: int, gram: int = GRAM) -> tuple[np.ndarray, ...]:
    """Runs of starts that share a minimiser, in texts that stand one after the other at offsets (with the end as the last).

    Returns the minimiser's start, the first and the last start, and the minimiser's hash of each run.
    """
    h = gram_hashes(data, gram)
    where = np.uint64((1 << 24) - 1)
    low = (h & ~where) | np.arange(len(h), dtype=np.uint64)
    span, width = length - gram + 1, 1
    while width * 2 <= span:
        low = np.minimum(low[:-width], low[width:])
        width *= 2
    if width < span:
        low = np.minimum(low[: len(low) - (span - width)], low[span - width :])
    at = (low & where).astype(np.int64)
    inside = np.zeros(len(data) + 1, dtype=np.int8)
    long = offsets[1:] - offsets[:-1] >= length
    inside[offsets[:-1][long]] += 1
    inside[offsets[1:][long] - length + 1] -= 1
    inside = np.cumsum(inside)[: len(at)] > 0
    first = np.flatnonzero(np.concatenate([[True], (at[1:] != at[:-1]) | (inside[1:] != inside[:-1])]))
    last = np.concatenate([first[1:], [len(at)]]) - 1
    own = inside[first]
    first, last = first[own], last[own]
    return at[first], first, last, h[at[first]]


def _prefix_hashes(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sums of byte number times a power of an odd constant, and powers of its inverse: hashes of any substring."""
    n = len(data)
    with np.errstate(over="ignore"):
        powers = np.cumprod(np.concatenate([[np.uint64(1)], np.full(n, np.uint64(0xD6E8FEB86659FD93))]), dtype=np.uint64)
        inverse = np.uint64(pow(0xD6E8FEB86659FD93, -1, 1 << 64))
        back = np.cumprod(np.concatenate([[np.uint64(1)], np.full(n, inverse)]), dtype=np.uint64)
        sums = np.concatenate([[np.uint64(0)], np.cumsum(TABLE[data] * powers[:n], dtype=np.uint64)])
    return sums, back


def _minimisers(texts: DataFrame, length: int) -> DataFrame:
    """Contexts of texts (k1, k2, text), equal texts of a task once: (gram, ctx, k1, k2, loc, settled).

    gram and ctx are hashes of the minimiser and of the context's bytes, loc is its place. Of equal contexts of a batch one
    keeps its gram; the others are settled and have a null one. Short texts are hashed together, long ones in chunks
    that overlap by length - 1 bytes.
    """

    def hashed(texts: list[bytes], keys: list[tuple[int, int]], begin: int) -> np.ndarray:
        data = np.frombuffer(b"".join(texts), dtype=np.uint8)
        offsets = np.concatenate([[0], np.cumsum([len(t) for t in texts])])
        at, first, last, h = contexts(data, offsets, length)
        sums, back = _prefix_hashes(data)
        with np.errstate(over="ignore"):
            ctx = _mix((sums[last + length] - sums[first]) * back[first] + (at - first).astype(np.uint64))
        text = np.searchsorted(offsets, first, side="right") - 1
        loc = (at - offsets[text] + begin) << 16 | (at - first) << 8 | (last - first)
        own = np.array(keys, dtype=np.int64)[text]
        return np.stack([h.view(np.int64), ctx.view(np.int64), own[:, 0], own[:, 1], loc])

    def combined(found: list[np.ndarray]) -> pa.RecordBatch:
        gram, ctx, k1, k2, loc = np.concatenate(found, axis=1)
        order = np.lexsort((ctx, gram))
        gram, ctx, k1, k2, loc = (x[order] for x in (gram, ctx, k1, k2, loc))
        same = (gram[1:] == gram[:-1]) & (ctx[1:] == ctx[:-1])
        later = np.concatenate([[False], same])
        return pa.RecordBatch.from_arrays([pa.array(gram, mask=later), pa.array(ctx, mask=later), pa.array(k1), pa.array(k2), pa.array(loc), pa.array(later | np.concatenate([same, [False]]))], names=["gram", "ctx", "k1", "k2", "loc", "settled"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, found, rows = set(), [], 0
        for batch in batches:
            texts, keys, size = [], [], 0
            for k1, k2, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).cast(pa.binary()), strict=True):
                if (k1, k2) in known:
                    continue
                known.add((k1, k2))
                text = text.as_py()
                if len(text) > CHUNK:
                    found += [hashed([text[begin : begin + CHUNK + length - 1]], [(k1, k2)], begin) for begin in range(0, len(text) - length + 1, CHUNK)]
                    rows += sum(x.shape[1] for x in found[-(-(-(len(text) - length + 1) // CHUNK)) :])
                else:
                    texts.append(text)
                    keys.append((k1, k2))
                    size += len(text)
                if size > CHUNK:
                    found.append(hashed(texts, keys, 0))
                    rows += found[-1].shape[1]
                    texts, keys, size = [], [], 0
                if rows > HELD:
                    yield combined(found)
                    found, rows = [], 0
            if texts:
                found.append(hashed(texts, keys, 0))
                rows += found[-1].shape[1]
        if found:
            yield combined(found)

    return texts.mapInArrow(run, "gram long, ctx long, k1 long, k2 long, loc long, settled boolean")


def _unpack(loc: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    at = loc >> 16
    first = at - (loc >> 8 & 255)
    return at, first, first + (loc & 255)


def _spans(contexts: DataFrame, length: int) -> DataFrame:
    """(k1, k2, lo, hi) of contexts all of whose strings repeat."""
    first = F.shiftright("loc", 16) - F.shiftright("loc", 8).bitwiseAND(F.lit(255))
    return contexts.select("k1", "k2", first.alias("lo"), (first + F.col("loc").bitwiseAND(F.lit(255)) + length).alias("hi"))


def _repeated(found: DataFrame, length: int) -> tuple[DataFrame, DataFrame]:
    """Spans of contexts that occur twice, and (k1, k2, loc, settled) of one context of each kind of a minimiser with several.

    A context's place is compared by a hash of 64 bits among those of one minimiser. Both aggregations are partial and
    hold four longs a group; the rows with a common minimiser may be split in the joins.
    """
    named = found.where("gram is not null").withColumn("place", F.xxhash64("k1", "k2", "loc"))
    edges = lambda c: (F.min(c).alias(f"{c}_min"), F.max(c).alias(f"{c}_max"))
    grams = named.groupBy("gram").agg(*edges("ctx"), *edges("place")).where("place_min <> place_max")
    live = settle(named.join(grams.select(F.col("gram").alias("of"), (F.col("ctx_min") != F.col("ctx_max")).alias("mixed")), F.col("gram") == F.col("of")).drop("of"), "live")
    mixed = live.where("mixed")
    kinds = mixed.groupBy("gram", "ctx").agg(*edges("place"), F.max("settled").alias("known"))
    kinds = kinds.select(F.col("gram").alias("of"), F.col("ctx").alias("kind"), F.col("place_min").alias("one"), ((F.col("place_min") != F.col("place_max")) | F.col("known")).alias("twice"))
    kinds = settle(mixed.join(kinds, (F.col("gram") == F.col("of")) & (F.col("ctx") == F.col("kind"))).select("k1", "k2", "loc", "settled", "twice", (F.col("place") == F.col("one")).alias("asked")), "kinds")
    spans = _spans(found.where("gram is null or settled"), length).unionByName(_spans(live.where("not mixed and not settled"), length)).unionByName(_spans(kinds.where("twice and not settled"), length))
    return spans, kinds.where("asked").select("k1", "k2", "loc", F.col("twice").alias("settled")).distinct()


def _asked_bytes(asked: DataFrame, length: int, gram: int = GRAM) -> DataFrame:
    """asked (k1, k2, text, locs: array of loc and settled) -> (side, ctx, k1, k2, first, settled): bytes of contexts.

    A context is cut in two: starts whose strings hold half of the other bytes before the minimiser, and the rest, which
    hold half of them after it. side is a hash of these bytes and the minimiser, so that a common minimiser with many
    surroundings isn't one group. Rows with one text follow each other, and the first of them is taken.
    """
    half = (length - gram) // 2
    kinds = [pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.int64(), pa.bool_()]

    def packed(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(list(c), type=k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=["side", "ctx", "k1", "k2", "first", "settled"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now = None
        for batch in batches:
            out, size = [], 0
            for k1, k2, text, locs in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), batch.column(3), strict=True):
                if (k1, k2) == now:
                    continue
                now, text = (k1, k2), text.as_py().encode("utf-8", "surrogatepass")
                for x in locs.as_py():
                    at, first, last = (int(v) for v in _unpack(np.int64(x["loc"])))
                    for lo, hi, common in ((first, min(last, at - half), slice(at - half, at + gram)), (max(first, at - half + 1), last, slice(at, at + length - half))):
                        if lo <= hi:
                            side = xxhash.xxh64_intdigest(text[common]) - (1 << 63)
                            out.append((side, text[lo : hi + length], k1, k2, lo, x["settled"]))
                            size += hi + length - lo
                if size > 1 << 22:
                    yield packed(out)
                    out, size = [], 0
            if out:
                yield packed(out)

    return asked.mapInArrow(run, "side long, ctx binary, k1 long, k2 long, first long, settled boolean")


def repeats_in_shard(shard: list[bytes], length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Runs of starts, in the contexts of a shard, of strings that another place of the shard holds too.

    Returns the context's number and the first and last start. Contexts are joined by marks below all bytes, so that no
    common prefix counts beyond a context's end.
    """
    raw = np.frombuffer(b"\0".join(shard) + b"\0", dtype=np.uint8)
    sizes = np.array([len(c) for c in shard])
    ends = np.cumsum(sizes + 1) - 1
    t = raw.astype(np.uint16) + 2
    t[ends] = 1
    t = np.concatenate([t, [0]]).astype(np.uint8 if raw.max() < 0xFE else np.uint16)
    sa = suffix_array(t, 258)
    lcp = permuted_lcp(t, sa, words_of(np.concatenate([raw, [0]])), int(sizes.max()) + 8, ends - sizes)
    rest = np.append(np.repeat(ends, sizes + 1) - np.arange(len(raw)), 0)
    before = np.zeros(len(t), dtype=np.int64)
    before[sa[1:]] = sa[:-1]
    hit = np.flatnonzero((lcp >= length) & (rest >= length) & (rest[before] >= length))
    repeated = np.zeros(len(t) + 1, dtype=np.int8)
    repeated[hit] = repeated[before[hit]] = 1
    edge = np.flatnonzero(np.diff(np.concatenate([[0], repeated])))
    first, last = edge[::2], edge[1::2] - 1
    which = np.searchsorted(ends, first)
    begin = (ends - sizes)[which]
    return which, first - begin, last - begin


def _from_shards(pieces: DataFrame, length: int) -> DataFrame:
    """(k1, k2, lo, hi) of what the suffix arrays find in contexts grouped by side.

    Groups follow each other in a partition and are gathered into shards of SHARD bytes; equal contexts of a group, at
    different places, are settled and one of them goes on, and a group of one kind needs no array. A group stays in one shard.
    """

    def solve(shard: list[tuple[bytes, list[tuple[int, int, int]]]]) -> list[tuple[int, int, int, int]]:
        out = []
        for which, lo, hi in zip(*(x.tolist() for x in repeats_in_shard([c for c, _ in shard], length)), strict=True):
            out += [(k1, k2, first + lo, first + hi + length) for k1, k2, first in shard[which][1]]
        return out

    def packed(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, type=pa.int64()) for c in zip(*rows, strict=True)], names=["k1", "k2", "lo", "hi"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, size, side, group, place = [], 0, None, [], None
        for batch in batches:
            out = []
            for s, ctx, k1, k2, first, settled in zip(*(batch.column(i).to_pylist() for i in range(6)), strict=True):
                if s != side:
                    if len(group) > 1:
                        shard += group
                        size += sum(len(c) for c, _ in group)
                        if size > SHARD:
                            out += solve(shard)
                            shard, size = [], 0
                    side, group, place = s, [], None
                if group and group[-1][0] == ctx:
                    if (k1, k2, first) == place:
                        continue
                    c, waiting = group[-1]
                    out += [(*w, w[2] + len(c)) for w in waiting]
                    if not settled:
                        out.append((k1, k2, first, first + len(ctx)))
                    group[-1] = (c, [])
                else:
                    group.append((ctx, [] if settled else [(k1, k2, first)]))
                place = (k1, k2, first)
            if out:
                yield packed(out)
        if len(group) > 1:
            shard += group
        if shard and (out := solve(shard)):
            yield packed(out)

    return pieces.repartition("side").sortWithinPartitions("side", "ctx", "k1", "k2", "first").mapInArrow(run, "k1 long, k2 long, lo long, hi long")


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Overlapping or touching spans as one, in order."""
    out: list[list[int]] = []
    for lo, hi in sorted(spans):
        if out and lo <= out[-1][1]:
            out[-1][1] = max(out[-1][1], hi)
        else:
            out.append([lo, hi])
    return [(a, b) for a, b in out]


def _key() -> tuple[Column, Column]:
    """128 bits of hashes of a text, null as empty."""
    text = F.coalesce("text", F.lit(""))
    return F.xxhash64(text).alias("k1"), F.xxhash64(F.lit(10), text).alias("k2")


def repeated_spans(docs: DataFrame, length: int = 200) -> tuple[DataFrame, DataFrame]:
    """The rows of docs with doc_id, k1, k2 and text (null as empty); and all found spans (k1, k2, spans), by text.

    Ids play no part: rows with one id, or none, stay apart if their texts differ, and equal texts share their spans.
    """
    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), *_key(), F.coalesce("text", F.lit("")).alias("text"))
    size = F.octet_length("text")
    found = settle(_minimisers(base.select("k1", "k2", "text").where(size >= length), length), "contexts")
    spans, asked = _repeated(found, length)
    asked = asked.groupBy("k1", "k2").agg(F.collect_list(F.struct("loc", "settled")).alias("locs"))
    # with doc_id, though unused, the exchange of texts is the same as that of the join with the spans
    pieces = _asked_bytes(base.join(asked, ["k1", "k2"]).sortWithinPartitions("k1", "k2").select("k1", "k2", "text", "locs", "doc_id"), length)
    copies = base.where(size >= length).groupBy("k1", "k2").agg(F.count(F.lit(1)).alias("n"), F.max(size.cast("long")).alias("hi")).where("n > 1")
    spans = spans.unionByName(_from_shards(pieces, length)).unionByName(copies.select("k1", "k2", F.lit(0).cast("long").alias("lo"), "hi"))
    return base, spans.groupBy("k1", "k2").agg(F.collect_set(F.struct("lo", "hi")).alias("spans"))


def _without(text: bytes, spans: list[dict] | None) -> tuple[bytes, int]:
    """What is left of a text, and how many runs of bytes are removed."""
    cut = merged([(x["lo"], x["hi"]) for x in spans or []])
    if not cut:
        return text, 0
    bounds = [0, *(v for span in cut for v in span), len(text)]
    return b"".join(text[a:b] for a, b in zip(bounds[::2], bounds[1::2], strict=True)), len(cut)


def cut_documents(docs: DataFrame, length: int = 200) -> DataFrame:
    """The rows of docs with repeated passages removed from text, and n_chars, if there, counted anew; columns as in docs.

    What is left of a character that was cut is left out; a null text stays null. A text of which nothing is left is empty.
    """
    _, spans = repeated_spans(docs, length)
    both = docs.select(*_key(), F.struct("*").alias("row")).join(spans, ["k1", "k2"], "left").select("row", "spans")
    at = docs.columns.index("text")
    counted = docs.columns.index("n_chars") if "n_chars" in docs.columns else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for begin in range(0, batch.num_rows, 512):
                some = batch.slice(begin, 512)
                rows = some.column(0)
                columns = [rows.field(i) for i in range(rows.type.num_fields)]
                texts = []
                for text, found in zip(columns[at], some.column(1), strict=True):
                    said, found = text.as_py(), found.as_py()
                    texts.append(_without(said.encode("utf-8", "surrogatepass"), found)[0].decode("utf-8", "ignore") if found else said)
                columns[at] = pa.array(texts, type=columns[at].type)
                if counted is not None:
                    columns[counted] = pa.array([None if t is None else len(t) for t in texts], type=pa.int64()).cast(columns[counted].type)
                yield pa.RecordBatch.from_arrays([pa.StructArray.from_arrays(columns, fields=list(rows.type))], names=["row"])

    return both.mapInArrow(run, both.select("row").schema).select("row.*")


def removal(docs: DataFrame, length: int = 200) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans and kept_sha256 of each row.

    Texts are UTF-8 bytes; every byte that lies in a string of `length` bytes which starts at another place too, in
    the same or another row, is removed. Null texts are empty. An empty table gives an empty one.
    """
    base, spans = repeated_spans(docs, length)
    both = base.join(spans, ["k1", "k2"], "left").select("doc_id", "text", "spans")
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string()]
    names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for begin in range(0, batch.num_rows, 512):
                rows = []
                some = batch.slice(begin, 512)
                for doc, text, found in zip(some.column(0).to_pylist(), some.column(1).cast(pa.binary()).to_pylist(), some.column(2).to_pylist(), strict=True):
                    kept, runs = _without(text, found)
                    rows.append((doc, len(text), len(text) - len(kept), runs, hashlib.sha256(kept).hexdigest()))
                yield pa.RecordBatch.from_arrays([pa.array(list(c), type=k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)

    return both.mapInArrow(run, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")
