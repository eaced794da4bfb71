"""Masks as arrays of rows: components, skeleton paths and support. Arrow functions over whole batches; decoding of images is not here."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F

from .geometry import _samples, resample

#: Steps to the eight neighbours of a pixel, in the order in which searches take them.
NEIGHBOURS = [(-1, -1), (-1, 0), (-1, 1), (0, -1), (0, 1), (1, -1), (1, 0), (1, 1)]


class Pixels:
    """The pixels of a batch of masks in one flat order: masks, their rows, their columns. Masks may differ in size."""

    def __init__(self, masks: pa.Array) -> None:
        size = lambda a: pc.fill_null(pc.list_value_length(a), 0).to_numpy().astype(np.int64)
        lines = pc.list_flatten(masks)
        self.heights, self.widths = size(masks), size(lines)
        self.values = pc.fill_null(pc.list_flatten(lines), 0).to_numpy(zero_copy_only=False) != 0
        mask_of_row = np.repeat(np.arange(len(masks)), self.heights)
        self.row = np.repeat(np.arange(len(lines)), self.widths)
        starts = np.cumsum(self.widths) - self.widths
        self.x = np.arange(len(self.values)) - starts[self.row]
        self.mask = mask_of_row[self.row]
        self.y = self.row - (np.cumsum(self.heights) - self.heights)[self.mask]
        # past both ends there are rows without pixels
        self._starts, self._widths = np.append(starts, 0), np.append(self.widths, 0)
        self._mask_of_row = np.append(mask_of_row, -1)

    def neighbour(self, at: np.ndarray, dy: int, dx: int) -> np.ndarray:
        """Places of the pixels one step from those at, -1 where there is none or it isn't set."""
        row, x = self.row[at] + dy, self.x[at] + dx
        row = np.where((row >= 0) & (self._mask_of_row[row] == self.mask[at]), row, len(self._starts) - 1)
        fits = (x >= 0) & (x < self._widths[row])
        to = np.where(fits, self._starts[row] + x, 0)
        return np.where(fits & self.values[to], to, -1) if len(self.values) else np.full(len(at), -1)

    def labels(self) -> np.ndarray:
        """For each set pixel the first pixel of its 8-connected component, else -1: labels sink to the least neighbour's and
        along themselves until nothing changes, all masks at once."""
        label = np.where(self.values, np.arange(len(self.values)), -1)
        on = np.flatnonzero(self.values)
        a, b = [], []
        for dy, dx in NEIGHBOURS[4:]:
            to = self.neighbour(on, dy, dx)
            a.append(on[to >= 0])
            b.append(to[to >= 0])
        a, b = np.concatenate(a), np.concatenate(b)
        while len(a):
            low = np.minimum(label[a], label[b])
            np.minimum.at(label, label[a], low)
            np.minimum.at(label, label[b], low)
            while not np.array_equal(jumped := label[label[on]], label[on]):
                label[on] = jumped
            apart = label[a] != label[b]
            a, b = a[apart], b[apart]
        return label

    def search(self, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Breadth-first searches from one pixel a mask, all at once: the last pixel that each reaches, and where each pixel was
        come from (-1 at a start, -2 if not reached). Pixels of a level keep the order of their search."""
        came = np.full(len(self.values), -2)
        came[starts] = -1
        last, front = starts.copy(), starts
        place = np.full(int(self.mask.max(initial=-1)) + 1, -1)
        place[self.mask[starts]] = np.arange(len(starts))
        while len(front):
            last[place[self.mask[front]]] = front  # of several the last one stays
            to = np.stack([self.neighbour(front, dy, dx) for dy, dx in NEIGHBOURS], axis=1).ravel()
            of = np.repeat(front, len(NEIGHBOURS))
            new = (to >= 0) & (came[to] == -2)
            to, of = to[new], of[new]
            first = np.sort(np.unique(to, return_index=True)[1])
            front = to[first]
            came[front] = of[first]
        return last, came


def longest_paths(masks: pa.Array, most: int = 64) -> list[list[list[float]]]:
    """For each mask the longest of the shortest paths between pixels of its largest component, as x, y: two searches; at most `most` points."""
    pixels = Pixels(masks)
    label = pixels.labels()
    out: list[list[list[float]]] = [[] for _ in range(len(masks))]
    roots, sizes = np.unique(label[label >= 0], return_counts=True)
    if not len(roots):
        return out
    order = np.lexsort((roots, -sizes, pixels.mask[roots]))
    roots = roots[order]
    starts = roots[np.concatenate([[True], pixels.mask[roots][1:] != pixels.mask[roots][:-1]])]
    ends, _ = pixels.search(starts)
    at, came = pixels.search(ends)
    of = pixels.mask[at]
    while len(at):
        for m, x, y in zip(of.tolist(), pixels.x[at].tolist(), pixels.y[at].tolist(), strict=True):
            out[m].append([float(x), float(y)])
        at = came[at]
        at, of = at[at >= 0], of[at >= 0]
    for m, path in enumerate(out):
        if len(path) > most:
            along = resample(np.array(path), 0.25)
            out[m] = along[np.linspace(0, len(along) - 1, most).astype(int)].astype(float).tolist()
    return out


def _alone(mask: np.ndarray) -> pa.Array:
    return pa.array([np.asarray(mask).tolist()], type=pa.list_(pa.list_(pa.int32())))


def components(mask: np.ndarray) -> list[list[tuple[int, int]]]:
    """Pixels (y, x) of each 8-connected component of one mask, in the order of their first pixel."""
    pixels = Pixels(_alone(mask))
    label = pixels.labels()
    return [[(int(pixels.y[i]), int(pixels.x[i])) for i in np.flatnonzero(label == root)] for root in np.unique(label[label >= 0])]


def without_small(mask: np.ndarray, least: int) -> np.ndarray:
    out = np.zeros_like(mask)
    for c in components(mask):
        if len(c) >= least:
            out[tuple(np.array(c).T)] = 1
    return out


def longest_path(mask: np.ndarray, most: int = 64) -> list[list[float]]:
    return longest_paths(_alone(mask), most)[0]


def inside(points: np.ndarray, polygon: np.ndarray) -> np.ndarray:
    """Whether points lie in a polygon, by the number of edges to the right of them."""
    odd = np.zeros(len(points), dtype=bool)
    for (x1, y1), (x2, y2) in zip(polygon, np.roll(polygon, -1, axis=0), strict=True):
        between = (y1 > points[:, 1]) != (y2 > points[:, 1])
        with np.errstate(divide="ignore", invalid="ignore"):
            odd ^= between & (points[:, 0] < (x2 - x1) * (points[:, 1] - y1) / (y2 - y1) + x1)
    return odd


def small_components_removed(mask: Column, least: int) -> Column:
    """A mask without its 8-connected components of fewer than `least` pixels, as 0 and 1; null as an empty one."""

    @F.arrow_udf("array<array<int>>")
    def run(a: pa.Array) -> pa.Array:
        pixels = Pixels(a)
        label = pixels.labels()
        sizes = np.bincount(label[label >= 0], minlength=max(1, len(label)))
        kept = (label >= 0) & (sizes[label] >= least)
        ends = lambda sizes: pa.array(np.concatenate([[0], np.cumsum(sizes)]), type=pa.int32())
        return pa.ListArray.from_arrays(ends(pixels.heights), pa.ListArray.from_arrays(ends(pixels.widths), pa.array(kept.astype(np.int32))))

    return run(mask)


def skeleton_path(mask: Column, most: int = 64) -> Column:
    @F.arrow_udf("array<array<double>>")
    def run(a: pa.Array) -> pa.Array:
        return pa.array(longest_paths(a, most), type=pa.list_(pa.list_(pa.float64())))

    return run(mask)


def _shares(lines: pa.Array, masks: pa.Array, spacing: float, most_pairs: int = 1 << 21) -> np.ndarray:
    """For each row the share of its line's samples in one of its polygons: samples of all rows against the polygons of theirs, edge by edge."""
    n = len(lines)
    one_each = pa.ListArray.from_arrays(pa.array(np.arange(n + 1), type=pa.int32()), lines)
    at, row = _samples(one_each, spacing)
    at, hit = at.astype(np.float64), np.zeros(len(at), dtype=bool)
    polygons = pc.list_flatten(masks)
    sizes = pc.fill_null(pc.list_value_length(polygons), 0).to_numpy().astype(np.int64)
    corners = pc.list_flatten(pc.list_flatten(polygons)).to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, 2)
    starts = np.cumsum(sizes) - sizes
    count = np.bincount(pc.list_parent_indices(masks).to_numpy(), minlength=n)
    first = np.cumsum(count) - count
    edges = np.cumsum(count[row])
    low = 0
    while low < len(row):
        high = max(low + 1, int(np.searchsorted(edges, (edges[low - 1] if low else 0) + most_pairs, side="right")))
        times = count[row[low:high]]
        sample = np.repeat(np.arange(low, high), times)
        polygon = np.repeat(first[row[low:high]], times) + np.arange(len(sample)) - np.repeat(np.cumsum(times) - times, times)
        odd = np.zeros(len(sample), dtype=bool)
        for k in range(int(sizes[polygon].max(initial=0))):
            live = np.flatnonzero(sizes[polygon] > k)
            a, b = starts[polygon[live]] + k, starts[polygon[live]] + (k + 1) % sizes[polygon[live]]
            (x1, y1), (x2, y2), (x, y) = corners[a].T, corners[b].T, at[sample[live]].T
            with np.errstate(divide="ignore", invalid="ignore"):
                odd[live] ^= ((y1 > y) != (y2 > y)) & (x < (x2 - x1) * (y - y1) / (y2 - y1) + x1)
        hit[sample[odd]] = True
        low = high
    total = np.bincount(row, minlength=n)
    return np.where(total > 0, np.bincount(row, weights=hit, minlength=n) / np.maximum(1, total), 0.0)


def mask_support(line: Column, polygons: Column, spacing: float = 2.0) -> Column:
    """Share of a line's samples that lie in one of the polygons; 0 without samples."""

    @F.arrow_udf("double")
    def run(lines: pa.Array, masks: pa.Array) -> pa.Array:
        return pa.array(_shares(lines, masks, spacing))

    return run(line, polygons)


def descriptor(histogram: Column) -> Column:
    """A vector of length 1 of the same direction; zeros stay zeros."""
    length = F.sqrt(F.aggregate(histogram, F.lit(0.0), lambda s, v: s + v * v))
    return F.transform(histogram, lambda v: F.when(length > 0, v / length).otherwise(0.0))
