"""Geometry of boxes, points and polylines as column expressions; resampling and centreline metrics as Arrow functions.

Boxes are arrays x1, y1, x2, y2; points arrays x, y; polylines arrays of points. Null in, null out.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F


def half_even(x: Column, digits: int) -> Column:
    """Rounding to even, as floats are rounded in reports."""
    return F.bround(x, digits)


def bbox_valid(b: Column) -> Column:
    return F.coalesce((F.size(b) == 4) & (b[2] > b[0]) & (b[3] > b[1]), F.lit(False))


def bbox_iou(a: Column, b: Column) -> Column:
    """Intersection over union; 0 where the union is empty."""
    w = F.greatest(F.lit(0.0), F.least(a[2], b[2]) - F.greatest(a[0], b[0]))
    h = F.greatest(F.lit(0.0), F.least(a[3], b[3]) - F.greatest(a[1], b[1]))
    area = lambda c: F.greatest(F.lit(0.0), c[2] - c[0]) * F.greatest(F.lit(0.0), c[3] - c[1])
    union = area(a) + area(b) - w * h
    return F.when(union > 0, w * h / union).otherwise(0.0)


def bbox_center(b: Column) -> Column:
    return F.array((b[0] + b[2]) / 2, (b[1] + b[3]) / 2)


def bbox_diagonal(b: Column) -> Column:
    return F.hypot(b[2] - b[0], b[3] - b[1])


def distance(p: Column, q: Column) -> Column:
    return F.sqrt((p[0] - q[0]) * (p[0] - q[0]) + (p[1] - q[1]) * (p[1] - q[1]))


def point_box_distance(p: Column, b: Column) -> Column:
    """0 inside the box."""
    dx = F.greatest(b[0] - p[0], F.lit(0.0), p[0] - b[2])
    dy = F.greatest(b[1] - p[1], F.lit(0.0), p[1] - b[3])
    return F.sqrt(dx * dx + dy * dy)


def point_segment_distance(p: Column, a: Column, b: Column) -> Column:
    """Distance to the nearest point of a segment; a segment of length 0 is its point."""
    dx, dy = b[0] - a[0], b[1] - a[1]
    square = dx * dx + dy * dy
    t = F.when(square > 0, F.greatest(F.lit(0.0), F.least(F.lit(1.0), ((p[0] - a[0]) * dx + (p[1] - a[1]) * dy) / square))).otherwise(0.0)
    ex, ey = p[0] - (a[0] + t * dx), p[1] - (a[1] + t * dy)
    return F.sqrt(ex * ex + ey * ey)


def path_anchor(p: Column, b: Column, share: float = 0.06) -> Column:
    """yoyo near the box (within 8 pixels or a share of its diagonal), else unknown; unknown without a box."""
    near = point_box_distance(p, b) <= F.greatest(F.lit(8.0), share * bbox_diagonal(b))
    return F.when(bbox_valid(b) & near, "yoyo").otherwise("unknown")


def bbox_yolo_line(b: Column, width: Column, height: Column, name: int = 0) -> Column:
    """class, centre and size as shares of the image with six decimals; empty where nothing of the box is inside."""
    x1, y1 = F.greatest(F.lit(0.0), F.least(b[0], width)), F.greatest(F.lit(0.0), F.least(b[1], height))
    x2, y2 = F.greatest(F.lit(0.0), F.least(b[2], width)), F.greatest(F.lit(0.0), F.least(b[3], height))
    line = F.format_string(f"{name} %.6f %.6f %.6f %.6f", *[half_even(v, 6) for v in ((x1 + x2) / 2 / width, (y1 + y2) / 2 / height, (x2 - x1) / width, (y2 - y1) / height)])
    return F.when((x2 > x1) & (y2 > y1), line).otherwise("")


def crop_box(b: Column, width: Column, height: Column) -> Column:
    """A square around the box, three times its larger side but at least 0.12 of the image's smaller side and at most all of
    it; without a box 0.28 of it in the middle. Moved inside the image; sides rounded to even."""
    least = F.least(width, height)
    has = bbox_valid(b)
    side = F.when(has, F.least(least, F.greatest(3 * F.greatest(b[2] - b[0], b[3] - b[1]), 0.12 * least))).otherwise(0.28 * least)
    cx, cy = F.when(has, (b[0] + b[2]) / 2).otherwise(width / 2), F.when(has, (b[1] + b[3]) / 2).otherwise(height / 2)
    x = F.greatest(F.lit(0.0), F.least(cx - side / 2, width - side))
    y = F.greatest(F.lit(0.0), F.least(cy - side / 2, height - side))
    return F.array(*[F.bround(v, 0).cast("int") for v in (x, y, x + side, y + side)])


def polyline_length(points: Column) -> Column:
    """Sum of the lengths of segments; 0 for fewer than two points."""
    ends = F.slice(points, 2, F.greatest(F.size(points) - 1, F.lit(0)))
    steps = F.zip_with(F.slice(points, 1, F.greatest(F.size(points) - 1, F.lit(0))), ends, distance)
    return F.aggregate(steps, F.lit(0.0), lambda s, v: s + v)


def polygon_area(points: Column) -> Column:
    """Area by the sum of cross products of successive corners."""
    following = F.concat(F.slice(points, 2, F.greatest(F.size(points) - 1, F.lit(0))), F.slice(points, 1, 1))
    cross = F.zip_with(points, following, lambda p, q: p[0] * q[1] - q[0] * p[1])
    return F.abs(F.aggregate(cross, F.lit(0.0), lambda s, v: s + v)) / 2


def polygon_axis(points: Column) -> Column:
    """Ends of the principal axis: the mean plus and minus the extent along the larger eigenvector of the covariance."""
    n = F.size(points)
    mean = lambda i: F.aggregate(points, F.lit(0.0), lambda s, p: s + p[i]) / n
    mx, my = mean(0), mean(1)
    moment = lambda f: F.aggregate(points, F.lit(0.0), lambda s, p: s + f(p[0] - mx, p[1] - my))
    angle = 0.5 * F.atan2(2 * moment(lambda x, y: x * y), moment(lambda x, y: x * x) - moment(lambda x, y: y * y))
    along = F.transform(points, lambda p: (p[0] - mx) * F.cos(angle) + (p[1] - my) * F.sin(angle))
    at = lambda v: F.array(mx + v * F.cos(angle), my + v * F.sin(angle))
    return F.array(at(F.array_min(along)), at(F.array_max(along)))


def nearest_distances(source: Column, target: Column) -> Column:
    """For each point of source the distance to the nearest of target; infinite if target is empty."""
    return F.transform(source, lambda p: F.coalesce(F.array_min(F.transform(target, lambda q: distance(p, q))), F.lit(float("inf"))))


def coordinate_transform(points: Column, frame: Column, width: Column, height: Column, crop: Column, rendered: Column) -> Column:
    """Points of a declared frame in source pixels, to three decimals.

    original: as they are; normalized: 0..999 over the image; rendered: over an image of size `rendered`; crop: moved by the
    crop's corner; crop_resized: scaled from `rendered` to the crop, then moved. Another frame gives null.
    """
    scaled, moved = F.lower(frame).isin("rendered", "crop_resized"), F.lower(frame).isin("crop", "crop_resized")
    span = lambda i, size: F.when(F.lower(frame) == "crop_resized", crop[i + 2] - crop[i]).otherwise(size)
    sx = F.when(F.lower(frame) == "normalized", (width - 1) / 999.0).when(scaled, span(0, width) / rendered[0]).otherwise(1.0)
    sy = F.when(F.lower(frame) == "normalized", (height - 1) / 999.0).when(scaled, span(1, height) / rendered[1]).otherwise(1.0)
    ox, oy = F.when(moved, crop[0]).otherwise(0.0), F.when(moved, crop[1]).otherwise(0.0)
    known = F.lower(frame).isin("original", "normalized", "rendered", "crop", "crop_resized")
    return F.when(known, F.transform(points, lambda p: F.array(F.bround(p[0] * sx + ox, 3), F.bround(p[1] * sy + oy, 3))))


def resample(points: np.ndarray, spacing: float) -> np.ndarray:
    """Points at even steps of arc length, at most `spacing` apart and two at least; one for a line without length."""
    points = np.asarray(points, dtype=np.float32).reshape(-1, 2)
    return resampled(points, np.zeros(len(points), dtype=np.int64), spacing)[0]


def resampled(points: np.ndarray, line: np.ndarray, spacing: float, kind: type = np.float32) -> tuple[np.ndarray, np.ndarray]:
    """The samples of many lines at once, with the line of each. points: (n, 2) floats; line: the line of each, not falling;
    kind: the precision of points, lengths and samples. A length next to a multiple of the spacing may round across it in single."""
    points = points.astype(kind)
    if not len(points):
        return points, line
    names, first, size = np.unique(line, return_index=True, return_counts=True)
    own = np.repeat(np.arange(len(names)), size)
    place = np.arange(len(points)) - first[own]
    step = np.zeros(len(points), dtype=kind)
    step[1:] = np.where(place[1:] > 0, np.hypot(*np.diff(points, axis=0).T), 0)
    along = np.zeros(len(points), dtype=kind)
    for k in range(1, int(size.max())):  # sums go along a line in its precision, all lines at once
        at = first[size > k] + k
        along[at] = along[at - 1] + step[at]
    along = along.astype(np.float64)
    total = along[first + size - 1]
    count = np.where(total > 1e-6, np.maximum(2, np.ceil(total / max(0.25, spacing)).astype(np.int64) + 1), 1)
    of = np.repeat(np.arange(len(names)), count)
    k = np.arange(len(of)) - np.repeat(np.cumsum(count) - count, count)
    last = k == count[of] - 1
    at = np.where(last, total[of], k * (total / np.maximum(1, count - 1))[of])
    at = np.where(count[of] == 1, 0.0, at)
    # the segment of each sample: places along the lines, each scaled to 1, one line after the other
    scale = np.maximum(total, 1e-6)
    right = np.searchsorted(along / scale[own] * 0.5 + own, at / scale[of] * 0.5 + of, side="right")
    low = np.clip(right - 1, first[of], np.maximum(first[of], first[of] + size[of] - 2))
    high = np.minimum(low + 1, first[of] + size[of] - 1)
    width = along[high] - along[low]
    share = np.where(width > 0, (at - along[low]) / np.where(width > 0, width, 1), 0.0)[:, None]
    found = points[low].astype(np.float64) + (points[high].astype(np.float64) - points[low]) * share
    found = np.where((last & (count[of] > 1))[:, None], points[first[of] + size[of] - 1], found)
    return found.astype(kind), names[of]


def _samples(lines: pa.Array, spacing: float, kind: type = np.float32) -> tuple[np.ndarray, np.ndarray]:
    """Samples of all polylines of all rows of an array of rows of lines of points, and the row of each."""
    row_of_line = pc.list_parent_indices(lines).to_numpy()
    flat = pc.list_flatten(lines)
    points = pc.list_flatten(flat)
    xy = pc.list_flatten(points).to_numpy(zero_copy_only=False).astype(kind).reshape(-1, 2)
    at, line = resampled(xy, pc.list_parent_indices(flat).to_numpy(), spacing, kind)
    return at, row_of_line[line] if len(line) else line


def _nearest(a: np.ndarray, b: np.ndarray, rows_a: np.ndarray, rows_b: np.ndarray, n: int, cells: int = 1 << 21) -> tuple[np.ndarray, np.ndarray]:
    """For each point of a, and of b, the distance to the nearest of the other side in its row, infinite without one.

    Rows of like size are compared together, filled up to the largest of them, in blocks of about `cells` distances.
    """
    na, nb = np.bincount(rows_a, minlength=n), np.bincount(rows_b, minlength=n)
    sa, sb = np.cumsum(na) - na, np.cumsum(nb) - nb
    da, db = np.full(len(a), np.inf, dtype=np.float32), np.full(len(b), np.inf, dtype=np.float32)
    order = np.flatnonzero((na > 0) & (nb > 0))
    order = order[np.lexsort((nb[order], na[order]))]
    at = 0
    while at < len(order):
        take = max(1, min(len(order) - at, cells // max(1, int(na[order[at]]) * int(nb[order[at]]))))
        own = order[at : at + take]
        while len(own) > 1 and int(na[own].max()) * int(nb[own].max()) * len(own) > 2 * cells:
            own = own[: len(own) // 2]
        at += len(own)
        ka, kb = np.arange(na[own].max()), np.arange(nb[own].max())
        ia, ib = sa[own][:, None] + ka, sb[own][:, None] + kb
        va, vb = ka < na[own][:, None], kb < nb[own][:, None]
        pa_, pb_ = a[np.where(va, ia, 0)], b[np.where(vb, ib, 0)]
        block = max(1, 2 * cells // max(1, len(own) * len(kb)))
        best_b = np.full(ib.shape, np.inf, dtype=np.float32)
        for lo in range(0, len(ka), block):
            part = pa_[:, lo : lo + block]
            far = (part[:, :, None, 0] - pb_[:, None, :, 0]) ** 2
            far += (part[:, :, None, 1] - pb_[:, None, :, 1]) ** 2
            far[~va[:, lo : lo + block]] = np.inf
            np.minimum(best_b, far.min(axis=1), out=best_b)
            far.transpose(0, 2, 1)[~vb] = np.inf
            near = np.sqrt(far.min(axis=2))
            inside = va[:, lo : lo + block]
            da[ia[:, lo : lo + block][inside]] = near[inside]
        db[ib[vb]] = np.sqrt(best_b[vb])
    return da, db


def _percentile(values: np.ndarray, rows: np.ndarray, sizes: np.ndarray, q: float) -> np.ndarray:
    """Percentile of each row's values, between neighbours by proportion; nan for a row without values."""
    order = np.lexsort((values, rows))
    ordered, starts = values[order].astype(np.float64), np.cumsum(sizes) - sizes
    at = q * np.maximum(0, sizes - 1)
    low = np.floor(at).astype(np.int64)
    out = np.full(len(sizes), np.nan)
    has = sizes > 0
    a, b = ordered[(starts + low)[has]], ordered[(starts + np.minimum(low + 1, sizes - 1))[has]]
    with np.errstate(invalid="ignore"):
        out[has] = np.where(a == b, a, a + (b - a) * (at - low)[has])
    return out


CENTERLINE = "target_samples int, prediction_samples int, chamfer double, hd95 double, tolerances array<struct<tolerance:double,target_hits:int,prediction_hits:int,precision:double,recall:double,f1:double>>"


def centerline_metrics(target: Column, prediction: Column, tolerances: tuple[float, ...] = (2.0, 4.0, 8.0), spacing: float = 2.0) -> Column:
    """Struct CENTERLINE of two sets of polylines: the mean and the 95th percentile of both directions' distances pooled,
    and for each tolerance what share of samples has the other side within it. A side that is empty has nothing near."""

    @F.arrow_udf(CENTERLINE)
    def measure(t: pa.Array, p: pa.Array) -> pa.Array:
        n = len(t)
        (a, ra), (b, rb) = _samples(t, spacing), _samples(p, spacing)
        da, db = _nearest(a, b, ra, rb, n)
        na, nb = np.bincount(ra, minlength=n), np.bincount(rb, minlength=n)
        rows, both = np.concatenate([ra, rb]), np.concatenate([da, db])
        with np.errstate(invalid="ignore", divide="ignore"):
            mean = np.bincount(rows, weights=both, minlength=n) / (na + nb)
            hd95 = _percentile(both, rows, na + nb, 0.95)
            finite = np.bincount(rows, weights=np.isfinite(both), minlength=n) > 0
        per = []
        for tol in tolerances:
            ha, hb = np.bincount(ra, weights=da <= tol, minlength=n), np.bincount(rb, weights=db <= tol, minlength=n)
            precision, recall = hb / np.maximum(1, nb), ha / np.maximum(1, na)
            f1 = np.where(precision + recall > 0, 2 * precision * recall / np.where(precision + recall > 0, precision + recall, 1), 0.0)
            per.append([np.full(n, tol), ha.astype(np.int32), hb.astype(np.int32), np.round(precision, 6), np.round(recall, 6), np.round(f1, 6)])
        # the tolerances of a row follow each other
        columns = [pa.array(np.stack([q[k] for q in per], axis=1).ravel()) for k in range(6)]
        kinds = [pa.float64(), pa.int32(), pa.int32(), pa.float64(), pa.float64(), pa.float64()]
        flat = pa.StructArray.from_arrays([c.cast(k) for c, k in zip(columns, kinds, strict=True)], names=["tolerance", "target_hits", "prediction_hits", "precision", "recall", "f1"])
        listed = pa.ListArray.from_arrays(pa.array(np.arange(n + 1) * len(tolerances), type=pa.int32()), flat)
        shown = lambda v: pa.array(np.round(v, 4), mask=~finite)
        return pa.StructArray.from_arrays([pa.array(na.astype(np.int32)), pa.array(nb.astype(np.int32)), shown(mean), shown(hd95), listed], names=["target_samples", "prediction_samples", "chamfer", "hd95", "tolerances"])

    return measure(target, prediction)


def sample_polylines(lines: Column, spacing: float = 2.0) -> Column:
    """Samples of all polylines of a row, in order."""

    @F.arrow_udf("array<array<double>>")
    def sample(a: pa.Array) -> pa.Array:
        at, row = _samples(a, spacing)
        ends = np.cumsum(np.bincount(row, minlength=len(a)))
        points = pa.ListArray.from_arrays(pa.array(2 * np.arange(len(at) + 1), type=pa.int32()), pa.array(at.astype(np.float64).ravel()))
        listed = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], ends]), type=pa.int32()), points)
        return pc.if_else(a.is_valid(), listed, pa.scalar(None, listed.type)) if a.null_count else listed

    return sample(lines)
