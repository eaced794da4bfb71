"""Suffix arrays by induced sorting and permuted common prefixes, on numpy arrays.

The induction goes bucket by bucket: all suffixes that a bucket holds put their predecessors into the later buckets in
one step, in order; only predecessors in the same bucket need another round. So the work is linear and is done on
whole arrays; strings of names, to which the recursion goes on, are a third of the text or less.
"""

from __future__ import annotations

from itertools import accumulate

import numpy as np


def _types(t: np.ndarray) -> np.ndarray:
    """True where a suffix is smaller than the next one (the last one counts as smaller)."""
    n = len(t)
    change = np.flatnonzero(t[1:] != t[:-1])
    up = np.ones(n, dtype=bool)
    if len(change):
        rises = t[change] < t[change + 1]
        at = np.searchsorted(change, np.arange(n))
        inside = at < len(change)
        up[inside] = rises[at[inside]]
        up[~inside] = False
    up[n - 1] = True
    return up


def _place(sa: np.ndarray, t: np.ndarray, suffixes: np.ndarray, heads: np.ndarray, step: int) -> None:
    """Put suffixes, in order, at the moving ends of their buckets."""
    chars = t[suffixes]
    order = np.argsort(chars, kind="stable")
    counts = np.bincount(chars, minlength=len(heads))
    rank = np.arange(len(order)) - np.repeat(np.cumsum(counts) - counts, counts)
    sorted_chars = chars[order]
    sa[heads[sorted_chars] + step * rank] = suffixes[order]
    heads += step * counts


def _induce(t: np.ndarray, up: np.ndarray, lms: np.ndarray, sigma: int) -> np.ndarray:
    """The suffix array that follows from the order of the leftmost-smaller suffixes."""
    n = len(t)
    counts = np.bincount(t, minlength=sigma)
    ends = np.cumsum(counts)
    starts = ends - counts
    used = np.flatnonzero(counts)
    sa = np.full(n, -1, dtype=np.int64)
    # leftmost-smaller suffixes by bucket, in the order given
    chars = t[lms]
    grouped = lms[np.argsort(chars, kind="stable")]
    own = np.bincount(chars, minlength=sigma)
    own_ends = np.cumsum(own)
    heads = starts.copy()
    for c in used:
        done = starts[c]
        while done < heads[c]:
            upto = heads[c]
            before = sa[done:upto] - 1
            before = before[before >= 0]
            before = before[~up[before]]
            done = upto
            if len(before):
                _place(sa, t, before, heads, 1)
        before = grouped[own_ends[c] - own[c] : own_ends[c]] - 1
        before = before[before >= 0]
        if len(before):
            _place(sa, t, before, heads, 1)  # the predecessor of such a suffix is larger than it
    tails = ends - 1
    larger = heads  # ends of the larger suffixes of each bucket
    for c in used[::-1]:
        done = ends[c] - 1
        while done > tails[c]:
            upto = tails[c]
            before = sa[done:upto:-1] - 1 if upto >= 0 else sa[done::-1] - 1
            before = before[before >= 0]
            before = before[up[before]]
            done = upto
            if len(before):
                _place(sa, t, before, tails, -1)
        before = sa[starts[c] : larger[c]][::-1] - 1
        before = before[before >= 0]
        before = before[up[before]]
        if len(before):
            _place(sa, t, before, tails, -1)
    sa[0] = n - 1
    return sa


def _names_sorted(t: list[int], sigma: int) -> list[int]:
    """Suffix array of a string of names that ends with its only 0, by the same induction element by element.

    A string of names has about as many buckets as elements, so steps by buckets on whole arrays would gain nothing here.
    """
    n = len(t)
    if n == 1:
        return [0]
    up = bytearray(n)
    up[-1] = 1
    for i in range(n - 2, -1, -1):
        up[i] = t[i] < t[i + 1] or t[i] == t[i + 1] and up[i + 1]
    lms = [i for i in range(1, n) if up[i] and not up[i - 1]]
    counts = [0] * sigma
    for c in t:
        counts[c] += 1
    ends = list(accumulate(counts))
    starts = [e - k for e, k in zip(ends, counts, strict=True)]

    def induced(seeds: list[int]) -> list[int]:
        sa = [-1] * n
        tails = ends.copy()
        for i in reversed(seeds):
            tails[t[i]] -= 1
            sa[tails[t[i]]] = i
        heads = starts.copy()
        for j in range(n):
            i = sa[j] - 1
            if i >= 0 and not up[i]:
                sa[heads[t[i]]] = i
                heads[t[i]] += 1
        tails = ends.copy()
        for j in range(n - 1, -1, -1):
            i = sa[j] - 1
            if i >= 0 and up[i]:
                tails[t[i]] -= 1
                sa[tails[t[i]]] = i
        return sa

    following = dict(zip(lms, [*lms[1:], n - 1], strict=True))
    ordered = [i for i in induced(lms) if i in following]
    names, last, piece = {}, -1, None
    for i in ordered:
        own = t[i : following[i] + 1]
        if own != piece:
            last, piece = last + 1, own
        names[i] = last
    if last + 1 < len(lms):
        ordered = [lms[k] for k in _names_sorted([names[i] for i in lms], last + 1)]
    return induced(ordered)


def suffix_array(t: np.ndarray, sigma: int) -> np.ndarray:
    """Suffix array of t, whose last element is 0 and occurs only there."""
    n = len(t)
    if n == 1:
        return np.zeros(1, dtype=np.int64)
    up = _types(t)
    lms = np.flatnonzero(up[1:] & ~up[:-1]) + 1
    if len(lms) == 1:
        return _induce(t, up, lms, sigma)
    # sort the leftmost-smaller substrings by one induction from any order, then name them
    sa = _induce(t, up, lms, sigma)
    is_lms = np.zeros(n, dtype=bool)
    is_lms[lms] = True
    ordered = sa[is_lms[sa]]
    number = np.zeros(n, dtype=np.int64)
    number[lms] = np.arange(len(lms))
    end = np.concatenate([lms[1:], [n - 1]])[number[ordered]]
    length = end - ordered
    same = np.zeros(len(ordered), dtype=bool)
    same[1:] = length[1:] == length[:-1]
    live, k = np.flatnonzero(same), 0
    while len(live):  # compare neighbours element by element; few live long
        live = live[np.where(k <= length[live], True, False)]
        a, b = ordered[live] + k, ordered[live - 1] + k
        differs = (t[np.minimum(a, n - 1)] != t[np.minimum(b, n - 1)]) & (k <= length[live])
        same[live[differs]] = False
        live = live[~differs & (k < length[live])]
        k += 1
    names = np.empty(len(lms), dtype=np.int64)
    named = np.cumsum(~same) - 1
    names[number[ordered]] = named
    if named[-1] == len(lms) - 1:
        return _induce(t, up, ordered, sigma)
    # the string of names ends with the name 0, which is the end mark's own
    order = np.array(_names_sorted(names.tolist(), int(named[-1]) + 1))
    return _induce(t, up, lms[order], sigma)


def permuted_lcp(t: np.ndarray, sa: np.ndarray, words: np.ndarray, longest: int, begins: np.ndarray | None = None) -> np.ndarray:
    """Common prefix of each suffix, in text order, with its predecessor in sa; cut off at `longest`.

    words: the 8 elements from each position as one number. Only where the elements before the two suffixes differ is
    a prefix compared; elsewhere it is one shorter than at the position before. So that a prefix which was cut off doesn't
    shorten later ones, begins holds positions that are compared anyway: at most `longest` apart, if given.
    """
    n = len(t)
    phi = np.full(n, -1, dtype=np.int64)
    phi[sa[1:]] = sa[:-1]
    fresh = np.ones(n, dtype=bool)
    at = np.flatnonzero((phi > 0) & (np.arange(n) > 0))
    fresh[at] = t[at - 1] != t[phi[at] - 1]
    if begins is not None:
        fresh[begins] = True
    live = np.flatnonzero(fresh & (phi >= 0))
    found = np.zeros(n, dtype=np.int64)
    k = 0
    while len(live) and k < longest:
        a, b = words[np.minimum(live + k, n)], words[np.minimum(phi[live] + k, n)]
        differ = a ^ b
        stop = differ != 0
        low = differ[stop] & (~differ[stop] + np.uint64(1))
        found[live[stop]] = k + np.bitwise_count(low - np.uint64(1)).astype(np.int64) // 8
        live = live[~stop]
        k += 8
    found[live] = k
    last = np.maximum.accumulate(np.where(fresh, np.arange(n), 0))
    return np.maximum(0, found[last] - (np.arange(n) - last))


def words_of(t: np.ndarray) -> np.ndarray:
    """For each position 0..n the 8 elements (below 256) from it on, zeros after the end."""
    x = np.concatenate([t.astype(np.uint64), np.zeros(16, dtype=np.uint64)])
    for shift in (1, 2, 4):
        x = x[: len(x) - shift] | x[shift:] << np.uint64(8 * shift)
    return x[: len(t) + 1]
