"""Scalar, string, hash and vector functions as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def cosine_distance(a: Column, b: Column) -> Column:
    """1 - dot product of unit vectors, the product kept within -1 and 1."""
    dot = F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y), F.lit(0.0), lambda s, v: s + v)
    return 1 - F.greatest(F.lit(-1.0), F.least(F.lit(1.0), dot))


def hamming(a: Column, b: Column) -> Column:
    """Bits in which two 64-bit patterns differ."""
    return F.bit_count(a.bitwiseXOR(b))


def difference_hash(gray: Column) -> Column:
    """64 bits of an image of 8 rows of 9 greys, row by row: set where a grey exceeds its left neighbour; as a signed long."""
    bit = lambda i: (F.element_at(gray, F.lit(i // 8 * 9 + i % 8 + 2)) > F.element_at(gray, F.lit(i // 8 * 9 + i % 8 + 1))).cast("long")
    out = F.lit(0).cast("long")
    for i in range(64):
        out = F.shiftleft(out, 1).bitwiseOR(bit(i))
    return out


def logit_fuse(primary: Column, secondary: Column, alpha: float, primary_threshold: float, secondary_threshold: float) -> Column:
    """Two probabilities blended as log odds relative to their thresholds; at both thresholds the result is 0.5."""
    eps = 1e-5
    logit = lambda p: F.ln(p / (1 - p))
    clip = lambda p: F.greatest(F.lit(eps), F.least(F.lit(1 - eps), p))
    a = logit(clip(primary)) - logit(clip(F.lit(primary_threshold)))
    b = logit(clip(secondary)) - logit(clip(F.lit(secondary_threshold)))
    return 1 / (1 + F.exp(-((1 - alpha) * a + alpha * b)))


def scalar_confidence(value: Column) -> Column:
    """A number from text within 0..1 to four decimals; what isn't one is 0."""
    number = value.try_cast("double")
    good = number.isNotNull() & ~F.isnan(number)
    return F.when(good, F.bround(F.greatest(F.lit(0.0), F.least(F.lit(1.0), number)), 4)).otherwise(0.0)


def parse_time(value: Column) -> Column:
    """Seconds of SS, MM:SS or HH:MM:SS; null where a part isn't a number or, in times with minutes, isn't under 60."""
    parts = F.transform(F.split(F.trim(value), ":"), lambda p: p.try_cast("double"))
    n = F.size(parts)
    tail = F.slice(parts, 2, F.greatest(n - 1, F.lit(0)))
    good = (n <= 3) & F.forall(parts, lambda p: p.isNotNull() & (p >= 0)) & F.forall(tail, lambda p: p < 60)
    return F.when(good, F.aggregate(parts, F.lit(0.0), lambda s, p: s * 60 + p))


def parse_offsets(value: Column) -> Column:
    """Whole numbers of a comma list, distinct, without 0, in order."""
    numbers = F.transform(F.split(value, ","), lambda p: F.trim(p).try_cast("int"))
    return F.array_sort(F.array_distinct(F.filter(numbers, lambda n: n.isNotNull() & (n != 0))))


def frame_index(stem: Column) -> Column:
    """The number at a stem's end, null without one."""
    digits = F.regexp_extract(stem, r"(\d+)$", 1)
    return F.when(digits != "", digits.cast("long"))


def is_sha256(value: Column) -> Column:
    return F.coalesce(value.rlike("^[0-9a-fA-F]{64}$"), F.lit(False))


def safe_name(value: Column, fallback: str = "unknown", strip: str = "-.") -> Column:
    """Letters, digits and -_. of a name, others as -; without the strip characters at the ends; the fallback if none is left."""
    kept = F.regexp_replace(value, r"[^\p{L}\p{N}_.-]+", "-")
    bare = F.regexp_replace(kept, f"^[{strip}]+|[{strip}]+$", "")
    return F.when(F.coalesce(bare, F.lit("")) == "", fallback).otherwise(bare)


def relative_stem(stem: Column, digest: Column) -> Column:
    """The stem with one -hash8 at its end, whatever the number there was before."""
    short = F.substring(digest, 1, 8)
    return F.concat(F.regexp_replace(stem, F.concat(F.lit("(-"), short, F.lit(")+$")), F.lit("")), F.lit("-"), short)


def support_stats(samples: Column, threshold: float = 0.5) -> Column:
    """Mean, P50 and P90 of an array of probabilities, and the shares at or over 0.10, 0.20 and the threshold; zeros if empty."""
    n = F.size(samples)
    ordered = F.array_sort(samples)

    def quantile(q: float) -> Column:
        at = q * (n - 1)
        low = F.floor(at).cast("int")
        a, b = F.get(ordered, low), F.get(ordered, F.least(low + 1, n - 1))
        return a + (b - a) * (at - low)

    share = lambda t: F.size(F.filter(samples, lambda v: v >= t)) / n
    mean = F.aggregate(samples, F.lit(0.0), lambda s, v: s + v) / n
    names = ("mean", "p50", "p90", "share_10", "share_20", "share_threshold")
    values = (mean, quantile(0.5), quantile(0.9), share(0.10), share(0.20), share(threshold))
    return F.struct(*[F.when(n > 0, v).otherwise(0.0).alias(c) for c, v in zip(names, values, strict=True)])


def linear_blend(a: Column, b: Column, alpha: float) -> Column:
    """(1 - alpha) a + alpha b of two arrays."""
    return F.zip_with(a, b, lambda x, y: (1 - alpha) * x + alpha * y)


def caption(label: Column, confidence: Column, flags: Column) -> Column:
    """One line of a review: label, confidence and flags."""
    return F.concat_ws(" | ", label, F.format_string("%.2f", confidence), F.when(F.size(flags) > 0, F.array_join(F.array_sort(flags), ",")))


#: Names of metrics in files and in summaries: fixed values.
METRIC_NAMES = {
    "metrics/precision(B)": "box_precision",
    "metrics/recall(B)": "box_recall",
    "metrics/mAP50(B)": "map50",
    "metrics/mAP50-95(B)": "map50_95",
    "metrics/precision(M)": "mask_precision",
    "metrics/recall(M)": "mask_recall",
    "metrics/mAP50(M)": "mask_map50",
    "metrics/mAP50-95(M)": "mask_map50_95",
    "metrics/accuracy_top1": "top1_accuracy",
    "metrics/accuracy_top5": "top5_accuracy",
}
#: Names that are the same in both.
METRIC_KEPT = ("map50", "map50_95", "negative_mean_false_positive_pixels", "macro_recall")


def metric_summary(metrics: Column) -> Column:
    """A map of metrics under the names of summaries, ordered by them, without nulls and without metrics of other names."""
    names = F.create_map(*[F.lit(v) for pair in (METRIC_NAMES | {n: n for n in METRIC_KEPT}).items() for v in pair])
    entries = F.filter(F.map_entries(metrics), lambda e: e["value"].isNotNull() & F.map_contains_key(names, e["key"]))
    return F.map_from_entries(F.array_sort(F.transform(entries, lambda e: F.struct(F.element_at(names, e["key"]).alias("key"), e["value"].alias("value")))))
