"""Periodic runs: stretches of words that repeat with a period at least three times, and texts without the repeats."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: A run has at least LEAST words and FOLD periods.
LEAST, FOLD = 24, 3
#: Words of a run all lie in k-grams that occur again a period later: k is the least overlap of a run with itself moved by its period.
OVERLAP = min(max(LEAST, FOLD * q) - q for q in range(1, LEAST + 1))
WORDS = re.compile(r"[^\x20\x09-\x0D]+")
KIND = "doc_id long, n_words long, runs array<struct<start:long,length:long,period:long>>, collapsed string"

_MIX = np.random.default_rng(11)
#: Numbers of words modulo a power of two stand for the words in hashes of k-grams; equal hashes only keep words, so they need no check.
_NUMBERS = _MIX.integers(1, 1 << 63, size=1 << 16, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = 0x9E3779B97F4A7C15


def surviving(ids: np.ndarray, k: int = OVERLAP) -> list[tuple[int, int]]:
    """(start, end) of the longest stretches all of whose words lie in k-grams that occur twice in ids; no run is cut."""
    if len(ids) <= k:
        return []
    grams, width, base = _NUMBERS[ids & 0xFFFF] ^ (ids.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)), 1, _BASE
    whole, spare = None, 0
    bits = k
    while bits:  # k-grams from grams of powers of two
        if bits & 1:
            n = len(ids) - (spare + width) + 1
            whole = grams[:n] if whole is None else whole[:n] * np.uint64(pow(_BASE, width, 1 << 64)) + grams[spare : spare + n]
            spare += width
        bits >>= 1
        if bits:
            grams = grams[:-width] * np.uint64(base) + grams[width:]
            width, base = 2 * width, base * base % (1 << 64)
    order = np.argsort(whole, kind="stable")
    same = whole[order[1:]] == whole[order[:-1]]
    twice = np.zeros(len(whole), dtype=bool)
    twice[order[1:][same]] = twice[order[:-1][same]] = True
    edge = np.zeros(len(ids) + 1, dtype=np.int64)
    at = np.flatnonzero(twice)
    np.add.at(edge, at, 1)
    np.add.at(edge, at + k, -1)
    turn = np.flatnonzero(np.diff(np.concatenate([[0], (np.cumsum(edge[:-1]) > 0).astype(np.int8), [0]])))
    return list(zip(turn[::2].tolist(), turn[1::2].tolist(), strict=True))


def _z(s: list[int]) -> list[int]:
    """Length of the longest common prefix of s and each of its suffixes."""
    n = len(s)
    z = [0] * n
    z[0] = n
    left = right = 0
    for i in range(1, n):
        k = min(right - i, z[i - left]) if i < right else 0
        while i + k < n and s[k] == s[i + k]:
            k += 1
        z[i] = k
        if i + k > right:
            left, right = i, i + k
    return z


def _crossing(s: list[int], low: int, mid: int, high: int, least: int, fold: int) -> Iterator[tuple[int, int, int]]:
    """(start, end, period) of stretches in s[low:high] around mid that no neighbour in it extends, with `fold` periods or more."""
    u, v = s[low:mid], s[mid:high]
    most = min(len(u) + len(v), high - low) // fold
    r = u[::-1]
    ahead, behind = _z(v), _z(r)  # v against itself moved on, u against itself moved back
    over = _z([*v, -1, *u[-most:], *v])  # v against what begins in u
    under = _z([*r, -1, *v[:most][::-1], *r])  # u, from its end, against what ends in v
    from_u, from_v = len(v) + 1 + min(most, len(u)), len(u) + 1 + min(most, len(v))
    for p in range(1, most + 1):
        shortest = max(least, fold * p)
        if p <= len(u):  # words from mid - p on equal those from mid on
            right = min(over[from_u - p], len(v))
            left = behind[p] if p < len(u) else 0
            if left + right + p >= shortest:
                yield mid - p - left, mid + right, p
        if p <= len(v):
            right = ahead[p] if p < len(v) else 0
            left = min(under[from_v - p], len(u))
            if left + right + p >= shortest:
                yield mid - left, mid + p + right, p


def runs_within(s: list[int], least: int = LEAST, fold: int = FOLD) -> list[tuple[int, int, int]]:
    """(start, length, period) of all maximal runs of s, by start and period.

    Main and Lorentz: halves are searched alone, then what crosses their middle by common extensions of all periods at
    once, in time n log n. A stretch that a word beyond its block extends is left to the block that holds all of it; of
    the periods of one stretch the least counts.
    """
    found: dict[tuple[int, int], int] = {}
    stack = [(0, len(s))]
    while stack:
        low, high = stack.pop()
        if high - low < least:
            continue
        mid = (low + high) // 2
        stack += [(low, mid), (mid, high)]
        for start, end, p in _crossing(s, low, mid, high, least, fold):
            if (start and s[start - 1] == s[start - 1 + p]) or (end < len(s) and s[end] == s[end - p]):
                continue
            found[start, end] = min(p, found.get((start, end), p))
    return sorted((start, end - start, p) for (start, end), p in found.items())


def find(words: list[str]) -> list[tuple[int, int, int]]:
    """(start, length, period) of the runs of a list of words."""
    if len(words) < LEAST:
        return []
    known: dict[str, int] = {}
    ids = np.fromiter((known.setdefault(w, len(known)) for w in words), dtype=np.int64, count=len(words))
    if len(words) - len(known) < LEAST - LEAST // FOLD:
        return []  # a run repeats at least so many words
    return [(start + a, n, p) for start, end in surviving(ids) for a, n, p in runs_within(ids[start:end].tolist())]


def periodic_runs(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, runs (start, length, period; by start, then period), collapsed of each row of docs.

    Words are `[^\\x20\\x09-\\x0D]+` of the whole text, numbered from 0. A run is a stretch of words with least period p
    and at least max(24, 3 p) words that no neighbour extends. collapsed has the words that no run holds after its
    first p words, joined by one space. A null text has no words; repeated rows and null ids are rows as any other; an
    empty table gives an empty one; other columns take no part.

    Words outside of k-grams that occur twice in their text can't join a run (k = 16 for these lengths), so most texts
    end there; the rest is searched segment by segment. A task holds a batch of texts, each is judged alone: nothing is
    shuffled.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pair = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])
        kind = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("runs", pa.list_(pair)), ("collapsed", pa.string())])
        for batch in batches:
            sizes, runs, left = [], [], []
            for value in batch.column(1):
                words = WORDS.findall(value.as_py() or "")
                found = find(words)
                if found:
                    keep = np.ones(len(words), dtype=bool)
                    for start, n, p in found:
                        keep[start + p : start + n] = False
                    left.append(" ".join([words[i] for i in np.flatnonzero(keep)]))
                else:
                    left.append(" ".join(words))
                sizes.append(len(words))
                runs.append([{"start": a, "length": n, "period": p} for a, n, p in found])
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, type=t) for c, t in zip((sizes, runs, left), kind.types[1:], strict=True))], schema=kind)

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, KIND)


def planted(docs: DataFrame) -> DataFrame:
    """docs (doc_id, text) with a periodic tail in every tenth document: from word a on, word i is word a + (i - a) % p.

    h is the checksum of the id's decimal digits, g = h // 10, a = g % n, p = 1 + (n - a) // (3 + g % 8) for a text of n
    words. A text with a null id or without words is left as it is.
    """
    docs = docs.select("doc_id", "text", F.crc32(F.col("doc_id").cast("string")).alias("_h"))
    docs = docs.withColumn("_words", F.when(F.col("_h") % 10 == 0, F.regexp_extract_all("text", F.lit(r"([^\x20\x09-\x0D]+)"))))
    docs = docs.withColumn("_n", F.size("_words").cast("long")).withColumn("_g", F.expr("_h div 10"))
    docs = docs.withColumn("_a", F.when(F.col("_n") > 0, F.expr("_g % _n"))).withColumn("_p", F.expr("1 + (_n - _a) div (3 + _g % 8)"))
    tail = F.expr("array_join(transform(_words, (w, i) -> if(i < _a, w, element_at(_words, int(_a + (i - _a) % _p + 1)))), ' ')")
    return docs.select("doc_id", F.when(F.col("_n") > 0, tail).otherwise(F.col("text")).alias("text"))


def run_digests(found: DataFrame) -> DataFrame:
    """doc_id, n_runs, the strongest run (start, length, period, exponent_milli; null without one) and digests of runs and text."""
    line = lambda r: F.concat_ws(",", r["start"].cast("string"), r["length"].cast("string"), r["period"].cast("string"))
    stronger = lambda a, r: a.isNull() | (r["length"] * a["period"] > a["length"] * r["period"])
    none = F.expr("cast(null as struct<start:long,length:long,period:long>)")
    best = F.aggregate("runs", none, lambda a, r: F.when(stronger(a, r), r).otherwise(a))
    rows = found.withColumn("_best", best)
    return rows.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), *(F.col(f"_best.{c}").alias(c) for c in ("start", "length", "period")),
        F.expr("1000 * _best.length div _best.period").alias("exponent_milli"),
        F.sha2(F.concat_ws("", F.transform("runs", lambda r: F.concat(line(r), F.lit("\n")))), 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )
