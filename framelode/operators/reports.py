"""Aggregates of evaluation reports: presence, confusion, localisation, centrelines, thresholds, audits and gates."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..scratch import settle


def ratio(a: Column, b: Column) -> Column:
    """a / b, 0 where b is 0."""
    return F.when(b > 0, a / b).otherwise(0.0)


def prf(tp: Column, fp: Column, fn: Column) -> tuple[Column, Column, Column]:
    p, r = ratio(tp, tp + fp), ratio(tp, tp + fn)
    return p, r, ratio(2 * p * r, p + r)


def presence(df: DataFrame, target: Column, prediction: Column, *by: str) -> DataFrame:
    """tp, fp, fn, tn, precision, recall and f1 to six decimals; rows with an unknown target play no part."""
    known, said = df.where(target.isNotNull()), F.coalesce(prediction, F.lit(False))
    counts = known.groupBy(*by).agg(F.count_if(target & said).alias("tp"), F.count_if(~target & said).alias("fp"), F.count_if(target & ~said).alias("fn"), F.count_if(~target & ~said).alias("tn"))
    p, r, f = prf(F.col("tp"), F.col("fp"), F.col("fn"))
    return counts.select("*", F.bround(p, 6).alias("precision"), F.bround(r, 6).alias("recall"), F.bround(f, 6).alias("f1"))


def confusion(df: DataFrame, target: str, prediction: str) -> DataFrame:
    """target, predicted and n of each pair that occurs; an unknown prediction is 'unknown'."""
    return df.where(F.col(target).isNotNull()).groupBy(F.col(target).alias("target"), F.coalesce(F.col(prediction), F.lit("unknown")).alias("predicted")).agg(F.count(F.lit(1)).alias("n"))


def recalls(pairs: DataFrame) -> DataFrame:
    """support and recall of each target of a confusion table."""
    hit = F.sum(F.when(F.col("target") == F.col("predicted"), F.col("n")).otherwise(0))
    return pairs.groupBy("target").agg(F.sum("n").alias("support"), F.bround(hit / F.sum("n"), 6).alias("recall"))


def localisation(df: DataFrame, overlap: Column, error: Column) -> DataFrame:
    """Mean and median overlap, share of 0.5 and more, mean and 95th percentile of centre errors, over matched rows; null if
    there are none, but the share 0."""
    return df.agg(
        F.avg(overlap).alias("mean_iou"), F.percentile(overlap, 0.5).alias("median_iou"), F.coalesce(F.avg((overlap >= 0.5).cast("double")), F.lit(0.0)).alias("rate_50"),
        F.avg(error).alias("mean_error"), F.percentile(error, 0.95).alias("p95_error"),
    )


def centerline_pool(df: DataFrame, tolerances: str = "tolerances", *by: str) -> DataFrame:
    """Per tolerance precision, recall and f1 of summed hits and samples (micro)."""
    flat = df.select(*by, "target_samples", "prediction_samples", F.explode(tolerances).alias("t")).select(*by, "target_samples", "prediction_samples", "t.*")
    sums = flat.groupBy(*by, "tolerance").agg(F.sum("target_hits").alias("th"), F.sum("prediction_hits").alias("ph"), F.sum("target_samples").alias("ts"), F.sum("prediction_samples").alias("ps"))
    p, r = ratio(F.col("ph"), F.col("ps")), ratio(F.col("th"), F.col("ts"))
    return sums.select(*by, "tolerance", F.bround(p, 6).alias("precision"), F.bround(r, 6).alias("recall"), F.bround(ratio(2 * p * r, p + r), 6).alias("f1"))


def centerline_macro(df: DataFrame, *by: str) -> DataFrame:
    """Mean chamfer and 95th percentile over frames that have them, to four decimals, and how many have."""
    return df.groupBy(*by).agg(F.bround(F.avg("chamfer"), 4).alias("chamfer"), F.bround(F.avg("hd95"), 4).alias("hd95"), F.count("chamfer").alias("frames"))


def conditional_counts(df: DataFrame, sets: list[list[str]], counts: dict[str, Column], sums: dict[str, Column]) -> DataFrame:
    """Rows, conditional counts and sums over several groupings in one pass; columns that a grouping leaves out are null."""
    keys = list(dict.fromkeys(k for s in sets for k in s))
    return df.groupingSets(sets, *keys).agg(F.count(F.lit(1)).alias("n"), *[F.count_if(c).alias(k) for k, c in counts.items()], *[F.sum(c).alias(k) for k, c in sums.items()])


def source_inventory(roots: DataFrame, labels: DataFrame, root: str, label: str, included: str) -> DataFrame:
    """root, labels discovered below it, and of those for which it is the first root by name the ones included and excluded.

    A label is met with the roots that are folders above it: one row for each of its folders, joined by equality.
    """
    parts = F.split(label, "/")
    above = F.transform(F.sequence(F.lit(2), F.greatest(F.lit(2), F.size(parts) - 1)), lambda i: F.array_join(F.slice(parts, 1, i), "/"))
    met = labels.select(label, included, F.explode(above).alias(root)).join(roots.select(root), root)
    first = met.groupBy(label, included).agg(F.min(root).alias(root)).groupBy(root).agg(F.count_if(included).alias("included"), F.count_if(~F.col(included)).alias("excluded"))
    found = met.groupBy(root).agg(F.count(F.lit(1)).alias("discovered"))
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    return roots.select(root).join(found, root, "left").join(first, root, "left").select(root, zero("discovered"), zero("included"), zero("excluded"))


def limits_reached(value: Column, limits: list[float]) -> Column:
    """How many of the limits a value reaches, as one sum that is compiled; null reaches none."""
    return reduce(lambda a, b: a + b, (F.when(value >= t, 1).otherwise(0) for t in limits), F.lit(0))


def threshold_table(df: DataFrame, score: Column, target: Column, thresholds: list[float]) -> DataFrame:
    """tp, fp, fn and f1 at each threshold, in one pass: rows are counted by the number of thresholds they reach, then summed up."""
    limits = F.array(*[F.lit(t) for t in thresholds])
    reached = limits_reached(score, thresholds)
    counts = df.where(target.isNotNull()).groupBy(reached.alias("reached")).agg(F.count_if(target).alias("pos"), F.count_if(~target).alias("neg"))
    table = df.sparkSession.range(1).select(F.posexplode(limits).alias("i", "threshold"))
    # at most as many rows as there are thresholds on either side
    both = table.join(F.broadcast(counts))
    over = F.col("reached") > F.col("i")
    sums = both.groupBy("i", "threshold").agg(F.sum(F.when(over, F.col("pos")).otherwise(0)).alias("tp"), F.sum(F.when(over, F.col("neg")).otherwise(0)).alias("fp"), F.sum(F.when(~over, F.col("pos")).otherwise(0)).alias("fn"))
    return sums.withColumn("f1", prf(F.col("tp"), F.col("fp"), F.col("fn"))[2])


def best_threshold(table: DataFrame) -> DataFrame:
    """The threshold with the best f1, of equal ones the fewest false positives, then nearest 0.5, then the first."""
    return table.agg(F.max_by("threshold", F.struct("f1", -F.col("fp"), -F.abs(F.col("threshold") - 0.5), -F.col("i"))).alias("threshold"), F.max("f1").alias("f1"))


def threshold_report(pixels: DataFrame, image: str, score: Column, target: Column, near_score: Column, near_target: Column, thresholds: list[float]) -> DataFrame:
    """Pixel, tolerant and image-level metrics at each threshold, rounded as in reports: one row a threshold.

    pixels: a row a pixel; near_score is the largest score within the tolerance, near_target whether a target lies within it.
    All counts are of values that reach a threshold, so rows are counted by image and how many thresholds they reach, in one
    pass that is written, and these counts, by then as few as thresholds, are summed up.
    """
    limits = F.array(*[F.lit(t) for t in thresholds])
    reach = lambda v: limits_reached(v, thresholds)
    rows = pixels.select(F.col(image).alias("image"), reach(score).alias("own"), reach(near_score).alias("near"), target.alias("target"), near_target.alias("beside"))
    # pixels are read once: from here on a row stands for all pixels of an image that are alike
    cells = settle(rows.groupBy("image", "own", "near", "target", "beside").agg(F.count(F.lit(1)).alias("n")), "cells")
    pixels_if = lambda c: F.coalesce(F.sum(F.when(c, F.col("n"))), F.lit(0))
    images = cells.groupBy("image").agg(F.max("own").alias("own"), F.bool_or("target").alias("target"), pixels_if(F.col("target")).alias("pixels"))
    names = ("tp", "fp", "tolerant_p", "tolerant_t", "image_tp", "image_fp", "negative")
    zero = {n: F.lit(0).cast("long") for n in names}
    counted = lambda df, key, **found: df.groupBy(F.col(key).alias("reached")).agg(*[found.get(n, F.max(zero[n])).alias(n) for n in names])
    parts = [
        counted(cells, "own", tp=pixels_if(F.col("target")), fp=pixels_if(~F.col("target")), tolerant_p=pixels_if(F.col("beside"))),
        counted(cells.where("target"), "near", tolerant_t=F.sum("n")),
        counted(images, "own", image_tp=F.count_if("target"), image_fp=F.count_if(~F.col("target"))),
        counted(cells.join(images.where("not target").select("image"), "image", "left_semi"), "own", negative=F.sum("n")),
    ]
    sums = reduce(DataFrame.unionByName, parts)
    totals = images.agg(F.sum("pixels").alias("targets"), F.count_if("target").alias("positive"), F.count_if(~F.col("target")).alias("empty"))
    table = pixels.sparkSession.range(1).select(F.posexplode(limits).alias("i", "threshold"))
    # either side has as many rows as there are thresholds, or one
    over = F.col("reached") > F.col("i")
    found = table.join(F.broadcast(sums)).groupBy("i", "threshold").agg(*[F.sum(F.when(over, F.col(n)).otherwise(0)).alias(n) for n in names]).join(F.broadcast(totals))
    c = {n: F.col(n) for n in (*names, "targets", "positive", "empty")}
    p, r, _ = prf(c["tp"], c["fp"], c["targets"] - c["tp"])
    tp_, tr_ = ratio(c["tolerant_p"], c["tp"] + c["fp"]), ratio(c["tolerant_t"], c["targets"])
    ip, ir, if_ = prf(c["image_tp"], c["image_fp"], c["positive"] - c["image_tp"])
    six = {"precision": p, "recall": r, "iou": ratio(c["tp"], c["targets"] + c["fp"]), "dice": ratio(2 * c["tp"], c["targets"] + c["tp"] + c["fp"]), "tolerant_precision": tp_, "tolerant_recall": tr_, "tolerant_f1": ratio(2 * tp_ * tr_, tp_ + tr_), "image_precision": ip, "image_recall": ir, "image_f1": if_}
    return found.select("i", F.bround("threshold", 4).alias("threshold"), *[F.bround(v, 6).alias(k) for k, v in six.items()], F.bround(ratio(c["negative"], c["empty"]), 3).alias("negative_pixels"))


def select_threshold(report: DataFrame) -> DataFrame:
    """The row of a threshold_report with the best balanced F1 of tolerant and image-level F1, then image-level F1, fewest pixels
    on negative images, tolerant F1, Dice, nearness to 0.5; of equal ones the first."""
    balanced = ratio(2 * F.col("tolerant_f1") * F.col("image_f1"), F.col("tolerant_f1") + F.col("image_f1"))
    key = F.struct(balanced.alias("a"), "image_f1", -F.col("negative_pixels"), "tolerant_f1", "dice", -F.abs(F.col("threshold") - 0.5), -F.col("i"))
    return report.agg(F.max_by(F.struct(*report.columns), key).alias("best")).select("best.*")


def label_summary(df: DataFrame, label: str, raw: str, confidence: str, order: str, *by: str) -> DataFrame:
    """Of each group: the commonest label (of equally common ones that seen first), rows, switches of the label and of the raw
    one between neighbours, and the mean confidence of the rows of the commonest label, to six decimals."""
    w = W.partitionBy(*by).orderBy(order)
    moved = lambda c: (F.lag(c).over(w) != F.col(c)).cast("long")
    rows = df.withColumn("_moved", moved(label)).withColumn("_raw", moved(raw))
    parts = rows.groupBy(*by, label).agg(F.count(F.lit(1)).alias("n"), F.min(order).alias("first"), F.sum(confidence).alias("sure"), F.sum("_moved").alias("switches"), F.sum("_raw").alias("raw_switches"))
    best = F.max_by(F.struct(F.col(label).alias("label"), "n", "sure"), F.struct("n", -F.col("first"))).alias("best")
    out = parts.groupBy(*by).agg(best, F.sum("n").alias("rows"), F.coalesce(F.sum("switches"), F.lit(0)).alias("switches"), F.coalesce(F.sum("raw_switches"), F.lit(0)).alias("raw_switches"))
    return out.select(*by, F.col("best.label").alias("mode"), "rows", "switches", "raw_switches", F.bround(F.col("best.sure") / F.col("best.n"), 6).alias("mean_confidence"))


def sequence_scores(df: DataFrame, target: str, prediction: str, group: str, order: str) -> tuple[DataFrame, DataFrame]:
    """(accuracy, macro recall, switches) over all groups, and accuracy by group."""
    hit = (F.col(target) == F.col(prediction)).cast("long")
    moved = (F.lag(prediction).over(W.partitionBy(group).orderBy(order)) != F.col(prediction)).cast("long")
    rows = df.select(group, target, hit.alias("hit"), moved.alias("moved"))
    parts = rows.groupBy(group, target).agg(F.sum("hit").alias("hit"), F.count(F.lit(1)).alias("n"), F.coalesce(F.sum("moved"), F.lit(0)).alias("moved"))
    recall = parts.groupBy(target).agg((F.sum("hit") / F.sum("n")).alias("recall")).agg(F.avg("recall").alias("macro_recall"))
    whole = parts.agg((F.sum("hit") / F.sum("n")).alias("accuracy"), F.sum("moved").alias("switches"))
    # one row on either side
    return whole.join(F.broadcast(recall)), parts.groupBy(group).agg((F.sum("hit") / F.sum("n")).alias("accuracy"))


def promotion(baseline: tuple[DataFrame, DataFrame], candidate: tuple[DataFrame, DataFrame], group: str) -> DataFrame:
    """Whether a candidate may replace a baseline: accuracy and macro recall not less, no more switches, no group less accurate."""
    named = lambda df, mark: df.withColumnsRenamed({c: f"{c}_{mark}" for c in df.columns if c != group})
    both = named(baseline[0], "b").join(F.broadcast(named(candidate[0], "c")))
    groups = named(baseline[1], "b").join(named(candidate[1], "c"), group, "left")
    every = groups.agg(F.coalesce(F.bool_and(F.coalesce(F.col("accuracy_c") >= F.col("accuracy_b"), F.lit(False))), F.lit(True)).alias("every_group"))
    parts = both.select((F.col("accuracy_c") >= F.col("accuracy_b")).alias("accuracy"), (F.col("macro_recall_c") >= F.col("macro_recall_b")).alias("macro_recall"), (F.col("switches_c") <= F.col("switches_b")).alias("switches")).join(F.broadcast(every))
    return parts.withColumn("passed", F.col("accuracy") & F.col("macro_recall") & F.col("switches") & F.col("every_group"))


def registry(runs: DataFrame, files: DataFrame, weights: DataFrame, priority: tuple[str, ...], defaults: dict[str, str]) -> DataFrame:
    """model_id, task, weights, metrics_file, roles, warnings and complete of each run, and of weights without one.

    runs: model_id, task, weights (null: the run's own path), dataset. files: path of what exists. weights: model_id, path.
    The metrics file is the first of `priority` that exists; roles are the names whose default is the run's weights.
    """
    there = files.select("path").distinct()
    named = runs.withColumn("weights", F.coalesce("weights", F.concat("model_id", F.lit("/weights/best.pt"))))
    exists = lambda df, of, mark: df.join(there.select(F.col("path").alias(of), F.lit(True).alias(mark)), of, "left")
    candidates = named.select("model_id", F.posexplode(F.array(*[F.concat("model_id", F.lit(f"/{n}")) for n in priority])).alias("rank", "path")).join(there, "path", "left_semi")
    metrics = candidates.groupBy("model_id").agg(F.min_by("path", "rank").alias("metrics_file"))
    rows = exists(exists(named, "weights", "_w"), "dataset", "_d").join(metrics, "model_id", "left")
    warnings = F.array_compact(F.array(F.when(F.col("_w").isNull(), "best_weights_missing"), F.when(F.col("_d").isNull(), "dataset_manifest_missing"), F.when(F.col("metrics_file").isNull(), "independent_test_metrics_missing")))
    found = rows.select("model_id", "task", "weights", F.coalesce("metrics_file", F.lit("")).alias("metrics_file"), warnings.alias("warnings"))
    orphans = weights.join(named.select(F.col("weights").alias("path")), "path", "left_anti").select("model_id", F.lit("unknown").alias("task"), F.col("path").alias("weights"), F.lit("").alias("metrics_file"), F.array(F.lit("run_manifest_missing")).alias("warnings"))
    roles = F.array_compact(F.array(*[F.when(F.col("weights") == path, name) for name, path in defaults.items()]))
    return found.unionByName(orphans).withColumn("roles", roles).withColumn("complete", F.size("warnings") == 0)


def review_rows(df: DataFrame, group: str, frame: str, signature: list[str], flags: str, priority: tuple[str, ...], worst: str, ratio_of: Column, always: Column, most: int) -> DataFrame:
    """Rows of each group for a review sheet of at most `most`: all of a small group; else the first, the last, the first with
    each priority flag and the one with the worst ratio among rows flagged `worst`; then rows where the signature changes or
    `always` holds, spread evenly if they are too many; then rows spread evenly over the group until the sheet is full.
    """
    w = W.partitionBy(group).orderBy(frame)
    rows = df.withColumn("_i", F.row_number().over(w) - 1).withColumn("_sig", F.struct(*signature)).withColumn("_n", F.count(F.lit(1)).over(W.partitionBy(group)))
    has = lambda f: F.array_contains(flags, f)
    first_of = [F.coalesce(F.min(F.when(has(f), F.col("_i"))).over(W.partitionBy(group)) == F.col("_i"), F.lit(False)) for f in priority]
    most_ratio = F.max(F.when(has(worst), F.struct(ratio_of.alias("r"), (-F.col("_i")).alias("i")))).over(W.partitionBy(group))
    is_worst = F.coalesce(F.lit(0) - most_ratio["i"] == F.col("_i"), F.lit(False))
    prior = (F.col("_i") == 0) | (F.col("_i") == F.col("_n") - 1) | is_worst | reduce(lambda a, b: a | b, first_of)
    changed = ~F.coalesce(F.lag("_sig").over(w).eqNullSafe(F.col("_sig")), F.lit(False)) | F.coalesce(always, F.lit(False))
    rows = rows.withColumn("_prior", prior).withColumn("_event", changed & ~prior)
    any_flag = reduce(lambda a, b: a | b, [has(f) for f in priority])
    order = F.when(has(worst), 0).when(any_flag, 1).otherwise(2)
    # priority rows, if even they are too many, by kind and place
    rows = rows.withColumn("_rank", F.when(F.col("_prior"), F.row_number().over(W.partitionBy(group, "_prior").orderBy(order, "_i")))).withColumn("_kept", F.coalesce(F.col("_rank") <= most, F.lit(False)))
    left = F.greatest(F.lit(0), F.lit(most) - F.count_if(F.col("_kept")).over(W.partitionBy(group)))
    rows = rows.withColumn("_left", left).withColumn("_events", F.count_if("_event").over(W.partitionBy(group))).withColumn("_e", F.when(F.col("_event"), F.row_number().over(W.partitionBy(group, "_event").orderBy("_i")) - 1))
    spread = lambda at, total, n: F.when(n == 1, at == 0).otherwise(F.floor(F.ceil(at * (n - 1) / (total - 1)) * (total - 1) / (n - 1)) == at)
    taken = F.col("_event") & (F.col("_left") > 0) & ((F.col("_events") <= F.col("_left")) | spread(F.col("_e"), F.col("_events"), F.col("_left")))
    rows = rows.withColumn("_kept", F.col("_kept") | F.coalesce(taken, F.lit(False)))
    even = ~F.col("_kept") & spread(F.col("_i"), F.col("_n"), F.lit(most))
    room = F.lit(most) - F.count_if(F.col("_kept")).over(W.partitionBy(group))
    rows = rows.withColumn("_even", even).withColumn("_room", room).withColumn("_u", F.row_number().over(W.partitionBy(group, "_even").orderBy("_i")))
    chosen = (F.col("_n") <= most) | F.col("_kept") | F.col("_even") & (F.col("_u") <= F.col("_room"))
    return rows.where(chosen).select(*df.columns)


def mode_label(df: DataFrame, label: str, order: str, *by: str) -> DataFrame:
    """The commonest label of a group, of equally common ones that seen first, with its count and the number of labels."""
    counts = df.groupBy(*by, label).agg(F.count(F.lit(1)).alias("n"), F.min(order).alias("first"))
    return counts.groupBy(*by).agg(F.max_by(label, F.struct("n", -F.col("first"))).alias("mode"), F.max("n").alias("n"), F.count(F.lit(1)).alias("labels"))


def collection_conflicts(df: DataFrame, sha: str, group: str, video: str) -> DataFrame:
    """kind and value of what lies where it mustn't: an image or a video in several groups, several videos in a group."""
    def over(key: str, other: str, kind: str) -> DataFrame:
        rows = df.where((F.coalesce(F.col(key), F.lit("")) != "") & (F.coalesce(F.col(other), F.lit("")) != ""))
        return rows.groupBy(F.col(key).alias("value")).agg(F.count_distinct(other).alias("n")).where("n > 1").select(F.lit(kind).alias("kind"), "value", "n")

    return over(sha, group, "image in groups").unionByName(over(group, video, "videos in group")).unionByName(over(video, group, "video in groups"))


def reference_inventory(labels: DataFrame, images: DataFrame) -> DataFrame:
    """kind, value and frame of what reference sets have, each once: provenance (digest of the video, frame), digests of images
    that labels name or files have, and the files' difference hashes.

    labels: name, video_sha256, frame_index, image_sha256; images: name, sha256, bits. A label without its provenance or an
    image without bits stops the query and is named.
    """
    def sound(ok: Column, said: str) -> Column:
        return F.when(F.coalesce(ok, F.lit(False)), F.lit(True)).otherwise(F.raise_error(F.concat(F.lit(said), F.col("name").cast("string"))).cast("boolean"))

    whole = (F.length("video_sha256") == 64) & F.col("frame_index").isNotNull() & (F.length("image_sha256") == 64)
    one = lambda kind, value, frame=None: F.struct(F.lit(kind).alias("kind"), value.alias("value"), F.lit(frame).cast("long").alias("frame"))
    seen = F.struct(F.lit("provenance").alias("kind"), F.lower("video_sha256").alias("value"), F.col("frame_index").cast("long").alias("frame"))
    given = labels.where(sound(whole, "no provenance: ")).select(F.inline(F.array(seen, one("image", F.lower("image_sha256")))))
    files = images.where(sound(F.col("bits").isNotNull(), "unreadable: ")).select(F.inline(F.array(one("image", F.lower("sha256")), one("difference", F.col("bits").cast("string")))))
    return given.unionByName(files).distinct()


def flag_counts(df: DataFrame, flags: str) -> DataFrame:
    return df.select(F.explode(flags).alias("flag")).groupBy("flag").agg(F.count(F.lit(1)).alias("n"))


def promotion_gate(both: DataFrame, group: str) -> DataFrame:
    """One row: whether a candidate is as good overall and in every group, and the groups in which it is worse."""
    return both.agg(F.bool_and(F.col("candidate") >= F.col("baseline")).alias("every_group"), (F.sum("candidate_hits") >= F.sum("baseline_hits")).alias("overall"), F.count_if(F.col("candidate") < F.col("baseline")).alias("worse_groups"))


def ordered_digest(df: DataFrame, content: Column, order: list[str]) -> DataFrame:
    """SHA-256 over rows' digests in order, and its first 12 digits as an id.

    The digests of all rows, 64 digits each, are gathered in one task: for the few thousand files of a snapshot.
    """
    rows = df.select(F.sha2(content, 256).alias("d"), F.struct(*order).alias("o"))
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("o", "d"))), lambda s: s["d"]), "")
    return rows.agg(F.sha2(joined, 256).alias("digest")).withColumn("id", F.substring("digest", 1, 12))


def top_rows(df: DataFrame, by: list[str], order: list[Column], n: int) -> DataFrame:
    """The first n rows of each group in a total order."""
    return df.withColumn("rank", F.row_number().over(W.partitionBy(*by).orderBy(*order))).where(F.col("rank") <= n)


def hard_negative_loss(df: DataFrame, group: str, loss: str, key: str, least: int = 64, share: float = 0.001) -> DataFrame:
    """group and the mean of its largest losses: max(least, share) of its rows, all if there are fewer.

    Groups are counted by partial aggregation; ranks are those of one group's window, of which the count cuts the tail off.
    """
    sizes = df.groupBy(group).agg(F.greatest(F.lit(least), F.floor(F.lit(share) * F.count(F.lit(1)))).alias("_most"))
    ranked = df.withColumn("_rank", F.row_number().over(W.partitionBy(group).orderBy(F.col(loss).desc(), key)))
    return ranked.join(sizes, group).where(F.col("_rank") <= F.col("_most")).groupBy(group).agg(F.avg(loss).alias("loss"))


def linspace_rows(total: Column, n: int) -> Column:
    """n row numbers spread evenly over 0 .. total - 1, cut to whole numbers."""
    return F.array_distinct(F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: F.floor(i * (total - 1) / max(1, n - 1)).cast("long")))


def progressive_rounds(df: DataFrame, frame: str, strata: int, group: str) -> DataFrame:
    """round of each frame: its rank in its stratum by the distance from the stratum's centre."""
    first, last = F.min(frame).over(W.partitionBy(group)), F.max(frame).over(W.partitionBy(group))
    width = (last - first + 1) / strata
    df = df.withColumn("stratum", F.least(F.floor((F.col(frame) - first) / width), F.lit(strata - 1)).cast("long")).withColumn("_far", F.abs(F.col(frame) - (first + (F.col("stratum") + 0.5) * width)))
    return df.withColumn("round", F.row_number().over(W.partitionBy(group, "stratum").orderBy("_far", frame))).drop("_far")
