"""Joins and set operations of manifests, reviews, predictions and hashes."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W


def prediction_left_join(truth: DataFrame, predictions: DataFrame, frame: str, line: str) -> DataFrame:
    """truth with the last prediction line of its frame; the group plays no part, as predictions carry none."""
    w = W.partitionBy(frame).orderBy(F.col(line).desc())
    last = predictions.withColumn("_at", F.row_number().over(w)).where("_at = 1").drop("_at", line)
    return truth.join(last, frame, "left")


def import_by_hash(selected: DataFrame, manifest: DataFrame, key: str) -> DataFrame:
    """status of each hash: matched, missing (not in the manifest), unselected, duplicate (twice on a side)."""
    a = selected.groupBy(key).agg(F.count(F.lit(1)).alias("_a"))
    b = manifest.groupBy(key).agg(F.count(F.lit(1)).alias("_b"))
    status = F.when((F.col("_a") > 1) | (F.col("_b") > 1), "duplicate").when(F.col("_b").isNull(), "missing").when(F.col("_a").isNull(), "unselected").otherwise("matched")
    return a.join(b, key, "full").select(key, status.alias("status"))


def two_stage_match(images: DataFrame, records: DataFrame, path: str, hash_key: list[str], record: str) -> DataFrame:
    """record of each image: by path, else by hash and group; only if exactly one fits."""
    one = lambda keys: records.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"), F.min(record).alias("_r")).select(*keys, F.when(F.col("_n") == 1, F.col("_r")).alias("_r"), F.lit(True).alias("_there"))
    by_path = one([path]).withColumnsRenamed({"_r": "_pr", "_there": "_p"})
    by_hash = one(hash_key).withColumnsRenamed({"_r": "_hr", "_there": "_h"})
    both = images.join(by_path, path, "left").join(by_hash, hash_key, "left")
    return both.withColumn(record, F.when(F.col("_p"), F.col("_pr")).otherwise(F.col("_hr"))).drop("_pr", "_p", "_hr", "_h")


def output_parts(labels: DataFrame, images: DataFrame, overlays: DataFrame, expected: DataFrame, key: str) -> DataFrame:
    """For each key of the outputs: has_label, has_image, has_overlay, expected, and delete (incomplete, or not expected)."""
    mark = lambda df, name: df.select(key).distinct().withColumn(name, F.lit(True))
    names = ("has_label", "has_image", "has_overlay", "expected")
    out = mark(labels, names[0]).join(mark(images, names[1]), key, "full").join(mark(overlays, names[2]), key, "full").join(mark(expected, names[3]), key, "left")
    out = out.select(key, *[F.coalesce(c, F.lit(False)).alias(c) for c in names])
    return out.withColumn("delete", ~(F.col("has_label") & F.col("has_image") & F.col("has_overlay") & F.col("expected")))


def range_window(left: DataFrame, right: DataFrame, group: str, at: str, window: int, how: str = "left_semi") -> DataFrame:
    """Rows of left with a row of right of the same group at most `window` away (or, left_anti, without one).

    Both sides are put into buckets of window + 1, right into three, so that the join is by equality of group and bucket.
    """
    bucket = F.floor(F.col(at) / (window + 1))
    near = right.select(F.col(group).alias("_g"), F.col(at).alias("_at")).distinct().withColumn("_bucket", F.explode(F.array(*[F.floor(F.col("_at") / (window + 1)) + d for d in (-1, 0, 1)])))
    keyed = left.withColumn("_b", bucket)
    met = (keyed[group] == near["_g"]) & (keyed["_b"] == near["_bucket"]) & (F.abs(keyed[at] - near["_at"]) <= window)
    return keyed.join(near, met, how).drop("_b")


def bands(value: Column, count: int) -> Column:
    """A 64-bit pattern cut into count bands of nearly equal width: structs of number and value."""
    edges = [64 * k // count for k in range(count + 1)]
    part = lambda lo, hi: F.shiftrightunsigned(value, lo).bitwiseAND(F.lit(-1 if hi - lo == 64 else (1 << (hi - lo)) - 1))
    return F.array(*[F.struct(F.lit(k).alias("number"), part(lo, hi).alias("value")) for k, (lo, hi) in enumerate(zip(edges[:-1], edges[1:], strict=True))])


def hamming_semi(left: DataFrame, right: DataFrame, value: str, radius: int, how: str = "left_semi") -> DataFrame:
    """Rows of left whose 64-bit pattern lies within radius bits of one of right (or of none, left_anti).

    Of radius + 1 bands two such patterns share one, so bands are joined by equality and checked. Radius 0 is an equality.
    """
    targets = right.select(F.col(value).alias("_v")).distinct()
    if radius == 0:
        return left.join(targets, left[value] == targets["_v"], how)
    probes = left.select(value).distinct().withColumn("_band", F.explode(bands(F.col(value), radius + 1)))
    index = targets.withColumn("_tband", F.explode(bands(F.col("_v"), radius + 1)))
    near = probes.join(index, (F.col("_band") == F.col("_tband")) & (F.bit_count(F.col(value).bitwiseXOR(F.col("_v"))) <= radius), "left_semi")
    found = near.select(F.col(value).alias("_found")).distinct()
    return left.join(found, left[value] == found["_found"], how)


def hamming_pairs(left: DataFrame, right: DataFrame, value: str, radius: int) -> DataFrame:
    """Pairs of rows (structs a and b) whose 64-bit patterns lie within radius bits, each once."""
    banded = lambda df, name: df.select(F.struct(*df.columns).alias(name), F.explode(bands(F.col(value), radius + 1)).alias(f"_{name}"))
    met = banded(left, "a").join(banded(right, "b"), F.col("_a") == F.col("_b"))
    first = F.array_min(F.transform(F.filter(F.arrays_zip(bands(F.col(f"a.{value}"), radius + 1).alias("x"), bands(F.col(f"b.{value}"), radius + 1).alias("y")), lambda p: p["x"] == p["y"]), lambda p: p["x"]["number"]))
    # a pair that shares several bands counts at the first of them
    return met.where((F.bit_count(F.col(f"a.{value}").bitwiseXOR(F.col(f"b.{value}"))) <= radius) & (F.col("_a.number") == first)).select("a", "b")


def confirmed(samples: DataFrame, reviews: DataFrame, key: str, ok: str) -> DataFrame:
    """key and status of every sample: exported, rejected or unreviewed; and of reviews without a sample: unknown key, which an
    export must not go on with."""
    both = samples.select(key, F.lit(True).alias("_sample")).join(reviews.select(key, F.col(ok).alias("_ok"), F.lit(True).alias("_review")), key, "full")
    status = F.when(F.col("_sample").isNull(), "unknown key").when(F.col("_review").isNull(), "unreviewed").when(F.col("_ok"), "exported").otherwise("rejected")
    return both.select(key, status.alias("status"))


def strict_problems(baseline: DataFrame, rebuilt: DataFrame, key: str, group: str, split: str, ratios: dict[str, float], most: float, train: str = "train") -> DataFrame:
    """rule and n: keys that come into, leave or move between evaluation splits, change their group or are gone, and splits whose
    share of the rebuilt manifest is more than `most` off its ratio."""
    a = baseline.select(key, F.col(group).alias("_ga"), F.col(split).alias("_sa"))
    b = rebuilt.select(key, F.col(group).alias("_gb"), F.col(split).alias("_sb"))
    evaluated = lambda c: F.coalesce(F.col(c) != train, F.lit(False))
    off = [F.count_if(F.col("_sb") == s).alias(f"_n_{s}") for s in ratios]
    one = a.join(b, key, "full").agg(F.count_if((evaluated("_sa") | evaluated("_sb")) & ~F.col("_sa").eqNullSafe(F.col("_sb"))).alias("evaluation changed"), F.count_if(F.col("_ga") != F.col("_gb")).alias("regrouped"), F.count_if(F.col("_sb").isNull()).alias("missing"), F.count("_sb").alias("_n"), *off)
    far = [F.when(F.abs(F.coalesce(F.col(f"_n_{s}") / F.nullif(F.col("_n"), F.lit(0)), F.lit(0.0)) - r) > most, 1).otherwise(0) for s, r in ratios.items()]
    one = one.withColumn("ratio", reduce(lambda x, y: x + y, far).cast("long"))
    rules = ("evaluation changed", "regrouped", "missing", "ratio")
    return one.select(F.inline(F.array(*[F.struct(F.lit(r).alias("rule"), F.col(r).alias("n")) for r in rules])))


def manifest_diff(baseline: DataFrame, rebuilt: DataFrame, key: str, group: str, split: str) -> DataFrame:
    """status of each key of two manifests: same, moved (another split), regrouped (another group), missing, new."""
    a = baseline.select(key, F.col(group).alias("_ga"), F.col(split).alias("_sa"), F.lit(True).alias("_a"))
    b = rebuilt.select(key, F.col(group).alias("_gb"), F.col(split).alias("_sb"), F.lit(True).alias("_b"))
    status = F.when(F.col("_b").isNull(), "missing").when(F.col("_a").isNull(), "new").when(~F.col("_ga").eqNullSafe(F.col("_gb")), "regrouped").when(~F.col("_sa").eqNullSafe(F.col("_sb")), "moved").otherwise("same")
    return a.join(b, key, "full").select(key, status.alias("status"))


def merge_append(existing: DataFrame, addition: DataFrame, keys: list[str]) -> tuple[DataFrame, DataFrame]:
    """Both manifests as one, and the collisions: values of a key that two records have, which make the merge an error."""
    both = existing.unionByName(addition)
    found = [both.where(F.col(k).isNotNull()).groupBy(F.col(k).cast("string").alias("value")).agg(F.count(F.lit(1)).alias("n")).where("n > 1").select(F.lit(k).alias("key"), "value", "n") for k in keys]
    out = found[0]
    for other in found[1:]:
        out = out.unionByName(other)
    return both, out


def merged_manifest(existing: DataFrame, addition: DataFrame, keys: list[str], reference: str, order: list[str]) -> tuple[DataFrame, DataFrame]:
    """The records of both manifests with `collides` (the keys whose value another record has too: the merge is an error if
    any has one), and the distinct values of reference with place, the order in which they first occur."""
    both, _ = merge_append(existing, addition, keys)
    for k in keys:
        n = both.where(F.col(k).isNotNull()).groupBy(F.col(k).alias("_k")).agg((F.count(F.lit(1)) > 1).alias(f"_{k}"))
        both = both.join(n, F.col(k) == F.col("_k"), "left").drop("_k")
    out = both.withColumn("collides", F.array_compact(F.array(*[F.when(F.col(f"_{k}"), F.lit(k)) for k in keys]))).drop(*[f"_{k}" for k in keys])
    first = existing.withColumn("_side", F.lit(0)).unionByName(addition.withColumn("_side", F.lit(1))).groupBy(reference).agg(F.min(F.struct("_side", *order)).alias("place"))
    return out, first


def stem_pairs(images: DataFrame, labels: DataFrame, image_root: str, label_root: str) -> DataFrame:
    """split, stem, image and label of files (path) of two trees root/split/...: equal splits and relative paths without suffix.

    Files without a counterpart aren't there; of several images of a stem the first by path counts.
    """
    def keyed(files: DataFrame, root: str, name: str) -> DataFrame:
        parts = rf"^{root}/([^/]+)/(.+)\.[^./]+$"
        rows = files.select(F.regexp_extract("path", parts, 1).alias("split"), F.regexp_extract("path", parts, 2).alias("stem"), "path").where("stem <> ''")
        return rows.groupBy("split", "stem").agg(F.min("path").alias(name))

    return keyed(images, image_root, "image").join(keyed(labels, label_root, "label"), ["split", "stem"])


def lineage_overlap(parent_train: DataFrame, evaluation: DataFrame, group: str) -> DataFrame:
    """Groups trained on before that are evaluated now: a model is eligible if there is none."""
    return parent_train.select(group).intersect(evaluation.select(group))


def protected_equal(old: DataFrame, new: DataFrame, key: str, content: str) -> DataFrame:
    """status of protected rows by key: equal, changed or gone."""
    b = new.select(key, F.col(content).alias("_new"), F.lit(True).alias("_there"))
    status = F.when(F.col("_there").isNull(), "gone").when(F.col(content).eqNullSafe(F.col("_new")), "equal").otherwise("changed")
    return old.join(b, key, "left").select(key, status.alias("status"))


def rebind_reviews(reviews: DataFrame, old_labels: DataFrame, new_labels: DataFrame, label: str, sha: str) -> DataFrame:
    """Reviews with the label that has, in the rebuilt set, the image their old label had."""
    old = old_labels.select(label, sha)
    new = new_labels.select(F.col(sha), F.col(label).alias("new_label"))
    return reviews.join(old, label).join(new, sha)


def first_by_priority(rows: DataFrame, key: str, candidates: list[Column], listing: DataFrame, path: str) -> DataFrame:
    """Of each row's candidate paths the first that is in the listing."""
    listed = rows.select(key, F.posexplode(F.array(*candidates)).alias("priority", path)).join(listing.select(path).distinct(), path, "left_semi")
    return listed.groupBy(key).agg(F.min_by(path, "priority").alias(path))
