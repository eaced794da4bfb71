"""Row gates and validations: ordered rules of which the first that fails is the reason, and rules that are all collected."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.geometry import point_box_distance
from .matching import hamming_pairs, hamming_semi, range_window


def gate_cascade(df: DataFrame, rules: list[tuple[str, Column]], reason: str = "reason") -> DataFrame:
    """df with the name of the first rule that fails, null for kept rows. A rule whose value is null fails."""
    out = F.lit(None).cast("string")
    for name, holds in reversed(rules):
        out = F.when(~F.coalesce(holds, F.lit(False)), name).otherwise(out)
    return df.withColumn(reason, out)


def split_gated(df: DataFrame, reason: str = "reason") -> tuple[DataFrame, DataFrame]:
    return df.where(F.col(reason).isNull()).drop(reason), df.where(F.col(reason).isNotNull())


def collect_failures(df: DataFrame, rules: list[tuple[str, Column]], name: str = "errors") -> DataFrame:
    """df with the names of all rules that fail, sorted and distinct."""
    found = F.array_compact(F.array(*[F.when(~F.coalesce(holds, F.lit(False)), F.lit(rule)) for rule, holds in rules]))
    return df.withColumn(name, F.array_sort(F.array_distinct(found)))


def digest_mismatch(declared: Column, content: Column) -> Column:
    """True where a digest is declared and isn't the content's."""
    return (F.coalesce(declared, F.lit("")) != "") & (F.lower(declared) != F.sha2(content, 256))


def approved_scopes(reviews: Column) -> Column:
    """Union of review_scope over reviews (structs decision, review_scope) that approve."""
    kept = F.filter(reviews, lambda r: F.lower(r["decision"]) == "approve")
    return F.array_sort(F.array_distinct(F.flatten(F.transform(kept, lambda r: F.coalesce(r["review_scope"], F.array().cast("array<string>"))))))


def has_scopes(scopes: Column, need: tuple[str, ...] = ("visible_geometry", "yoyo_bbox")) -> Column:
    return F.size(F.array_except(F.array(*[F.lit(n) for n in need]), scopes)) == 0


def current_approvals(reviews: Column, digest: Column) -> Column:
    """Reviews (structs reviewer, role, decision, content_digest, in order) that approve, after keeping the latest of each
    reviewer and role of those made on the present content: a later refusal cancels an approval."""
    present = F.filter(reviews, lambda r: r["content_digest"] == digest)
    latest = F.filter(present, lambda r: ~F.exists(F.slice(present, F.array_position(present, r).cast("int") + 1, F.size(present)), lambda s: (s["reviewer"] == r["reviewer"]) & (s["role"] == r["role"])))
    return F.filter(latest, lambda r: F.lower(r["decision"]) == "approve")


def frame_range(df: DataFrame, frame: Column, lower: int | None, upper: int | None) -> DataFrame:
    """Rows with frame within inclusive bounds; bounds the wrong way round, and an empty result, are errors."""
    if lower is not None and upper is not None and lower > upper:
        raise ValueError(f"start {lower} is after end {upper}")
    out = df
    if lower is not None:
        out = out.where(frame >= lower)
    if upper is not None:
        out = out.where(frame <= upper)
    if out.isEmpty():
        raise ValueError("no frame lies in the range")
    return out


def revision_valid(confirmed: Column, size: Column, mtime: Column, now_size: Column, now_mtime: Column) -> Column:
    """A review counts if it is confirmed and the file's size and time are those it was made on."""
    return F.coalesce(confirmed & (size == now_size) & (mtime == now_mtime), F.lit(False))


def sample_key_valid(key: Column) -> Column:
    """A relative .json path without .. and drive or backslash tricks."""
    return F.coalesce(key.rlike(r"(?i)\.json$") & ~key.rlike(r"^([/\\]|[A-Za-z]:)") & ~key.rlike(r"(^|[/\\])\.\.([/\\]|$)"), F.lit(False))


def handoff(quick: Column, hard: Column, clear: Column) -> tuple[Column, Column]:
    """Queue and rank of a review hand-off; a clear case ranks 1 even where its queue is standard."""
    queue = F.when(quick, "quick_verify").when(hard, "hard").when(clear & ~hard, "clear").otherwise("standard")
    rank = F.when(quick, 0).when(clear, 1).when(hard, 3).otherwise(2)
    return queue, rank


def safe_promotion(value: Column, confidence: Column, least: float, agrees: Column) -> Column:
    """A field's value where its confidence is enough and the other evidence agrees."""
    return F.when(F.coalesce((confidence >= least) & agrees, F.lit(False)), value)


def consecutive_groups(df: DataFrame, group: str, sample: str, frame: str, position: str) -> DataFrame:
    """One row a group: dense (frames are a gap-free range), in_order (as stored), unique (no sample twice in the group)."""
    ordered = F.array_sort(F.collect_list(F.struct(position, frame)))
    frames = F.transform(ordered, lambda s: s[frame])
    n = F.count(F.lit(1))
    return df.groupBy(group).agg((F.max(frame) - F.min(frame) + 1 == n).alias("dense"), (frames == F.array_sort(frames)).alias("in_order"), (F.count_distinct(sample) == n).alias("unique"), n.alias("frames"))


def manifest_problems(assignment: DataFrame, records: DataFrame, group: str, split: str, sha: str, leakage: dict[str, int], splits: tuple[str, ...] = ("train", "val", "test")) -> DataFrame:
    """problem, value and n of every rule that a manifest breaks; an empty table is a sound manifest.

    assignment: group, split (a row for each place in which a group is listed). A group has one split, a record has a known
    group and split that agree, a digest is 64 lower-case digits and occurs once, and declared leakage is 0.
    """
    n = F.count(F.lit(1)).alias("n")
    found = lambda rows, problem, value: rows.groupBy(F.col(value).cast("string").alias("value")).agg(n).select(F.lit(problem).alias("problem"), "value", "n")
    known = assignment.select(F.col(group).alias("_g"), F.col(split).alias("_s")).distinct()
    twice = known.groupBy("_g").agg(F.count(F.lit(1)).alias("_n")).where("_n > 1")
    of_group = F.col(group) == F.col("_g")
    valid = records.where(F.col(split).isin(*splits))
    declared = records.sparkSession.createDataFrame([("declared leakage", k, v) for k, v in sorted(leakage.items()) if v], "problem string, value string, n long")
    parts = [
        found(twice, "group in two splits", "_g"),
        found(records.join(known.select("_g").distinct(), of_group, "left_anti"), "unassigned group", group),
        found(records.where(~F.col(split).isin(*splits)), "unknown split", split),
        found(valid.join(known.select("_g").distinct(), of_group, "left_semi").join(known, of_group & (F.col(split) == F.col("_s")), "left_anti"), "split disagrees", group),
        found(records.where(~F.col(sha).rlike("^[0-9a-f]{64}$")), "not a digest", sha),
        found(records, "digest twice", sha).where("n > 1"),
    ]
    return reduce(DataFrame.unionByName, parts, declared)


def staged_problems(staged: DataFrame, images: DataFrame, reference: DataFrame, key: str, video: str, frame: str, sha: str, bits: str, window: int, radius: int, across_videos: bool = True) -> DataFrame:
    """problem and n: how many staged samples break each rule, 0 where none does.

    Each label has an image whose digest is the declared one; no sample lies within `window` frames of a reference frame of
    its video, has a provenance or an image that another or the reference has, or lies within `radius` bits of a
    reference image or of another staged one (across_videos: of another video). Near images are found by bands.
    """
    of = images.select(F.col(key).alias("_k"), F.col(sha).alias("_sha"))
    paired = staged.join(of, F.col(key) == F.col("_k"), "left")
    near = hamming_pairs(staged.select(key, video, bits), staged.select(key, video, bits), bits, radius)
    other = near.where((F.col(f"a.{key}") != F.col(f"b.{key}")) & ((F.col(f"a.{video}") != F.col(f"b.{video}")) if across_videos else F.lit(True)))
    repeated = lambda *c: staged.groupBy(*c).agg(F.count(F.lit(1)).alias("_n")).where("_n > 1").select(F.sum("_n").alias("n"))
    counted = lambda rows: rows.agg(F.count(F.lit(1)).alias("n"))
    parts = {
        "image missing": counted(paired.where("_k is null")),
        "hash mismatch": counted(paired.where(F.col(sha) != F.col("_sha"))),
        "provenance overlap": counted(range_window(staged, reference, video, frame, window)),
        "provenance twice": repeated(video, frame),
        "image overlap": counted(staged.join(reference.select(sha).distinct(), sha, "left_semi")),
        "image twice": repeated(sha),
        "near reference": counted(hamming_semi(staged, reference, bits, radius)),
        "near another": other.select(F.col(f"a.{key}")).distinct().agg(F.count(F.lit(1)).alias("n")),
    }
    rows = [c.select(F.lit(k).alias("problem"), F.coalesce("n", F.lit(0)).cast("long").alias("n")) for k, c in parts.items()]
    return reduce(DataFrame.unionByName, rows)


#: Values that label documents may have, and roles whose approval a label needs: fixed values.
ROLES, SCENES = ("anchor", "temporal_context"), ("trick", "non_trick", "unknown")
STRING_VISIBILITY, ORIENTATIONS = ("visible", "partial", "not_visible", "uncertain"), ("normal", "horizontal", "other", "not_applicable", "unknown")
PATH_ANCHORS, EVIDENCE, ACCEPTED = ("yoyo", "unknown"), ("observed", "temporal", "inferred"), ("approved", "reviewed")
CRITICS = ("geometry-critic", "semantic-critic")


def label_rules(version: str) -> list[tuple[str, Column]]:
    """(name, whether it holds) of every rule of a label document, for collect_failures.

    Columns: schema_version, source_video, source_group, video_id, sequence_id, source_video_sha256, sampling_manifest_sha256,
    image_sha256, frame_index, timestamp_s, sampling_role, anchor_frame_index, image_size, string_visibility, scene_label,
    trick_orientation, box, strokes, masks, paths (points, start_anchor, end_anchor, edges of from, to, evidence, confidence),
    string_review_status, approvals (current ones: reviewer, role) and min_approvals. A rule about what is null fails.
    """
    c, none = F.col, F.lit(False)
    held = lambda x: F.coalesce(x, none)
    digest = lambda n: held(c(n).rlike("^[0-9a-f]{64}$"))
    text = lambda n: held(F.trim(c(n)) != "")
    every = lambda a, f: F.coalesce(F.forall(a, lambda x: F.coalesce(f(x), none)), F.lit(True))
    size = lambda a: F.coalesce(F.size(a), F.lit(0))
    near = F.greatest(F.lit(8.0), 0.08 * F.sqrt(c("image_size")[0] * c("image_size")[0] + c("image_size")[1] * c("image_size")[1]))
    geometry = (size("strokes") > 0) | (size("masks") > 0)
    shown = held(c("string_visibility").isin("visible", "partial"))
    edges = F.flatten(F.transform("paths", lambda p: p["edges"]))
    observed = F.coalesce(F.exists(edges, lambda e: e["evidence"] == "observed"), none)
    accepted = held(c("string_review_status").isin(*ACCEPTED))
    anchored = lambda name, p: (name != "yoyo") | p.isNull() | (c("box").isNotNull() & (point_box_distance(p, c("box")) <= near))
    points = lambda lines, least: every(lines, lambda s: (F.size(s) >= least) & F.forall(s, lambda p: (p[0] >= 0) & (p[1] >= 0) & (p[0] <= c("image_size")[0]) & (p[1] <= c("image_size")[1])))
    return [
        ("schema", held(c("schema_version") == version)),
        ("names", text("source_video") & text("source_group") & text("video_id") & text("sequence_id")),
        ("video_id", held(c("video_id") == c("source_group"))),
        ("digests", digest("source_video_sha256") & digest("sampling_manifest_sha256") & digest("image_sha256")),
        ("frame_index", held(c("frame_index") >= 0)),
        ("timestamp", held((c("timestamp_s") >= 0) & (c("timestamp_s") < float("inf")))),
        ("role", held(c("sampling_role").isin(*ROLES))),
        ("anchor_frame", held(c("anchor_frame_index") >= 0) & held((c("sampling_role") != "anchor") | (c("frame_index") == c("anchor_frame_index")))),
        ("image_size", held((F.size("image_size") == 2) & (c("image_size")[0] > 0) & (c("image_size")[1] > 0))),
        ("values", held(c("string_visibility").isin(*STRING_VISIBILITY)) & held(c("scene_label").isin(*SCENES)) & held(c("trick_orientation").isin(*ORIENTATIONS))),
        ("strokes", points("strokes", 2)),
        ("masks", points("masks", 3)),
        ("geometry_missing", ~shown | geometry),
        ("geometry_kept", ~held(c("string_visibility") == "not_visible") | ~geometry),
        ("anchors", every("paths", lambda p: p["start_anchor"].isin(*PATH_ANCHORS) & p["end_anchor"].isin(*PATH_ANCHORS))),
        ("anchor_far", every("paths", lambda p: anchored(p["start_anchor"], F.get(p["points"], F.lit(0))) & anchored(p["end_anchor"], F.try_element_at(p["points"], F.lit(-1))))),
        ("edges", every("paths", lambda p: (F.size(p["edges"]) == F.greatest(F.lit(0), F.size(p["points"]) - 1)) & F.forall(F.transform(p["edges"], lambda e, i: (e["from"] == i) & (e["to"] == i + 1)), lambda ok: F.coalesce(ok, none)))),
        ("evidence", every(edges, lambda e: e["evidence"].isin(*EVIDENCE) & (e["confidence"] >= 0) & (e["confidence"] <= 1))),
        ("observed_without_geometry", ~observed | geometry),
        ("path_missing", ~shown | (size("paths") > 0)),
        ("nothing_observed", ~shown | observed),
        ("approved_uncertain", ~accepted | ~held(c("string_visibility") == "uncertain")),
        ("approvals", ~accepted | (size("approvals") >= F.greatest(F.lit(1), F.coalesce("min_approvals", F.lit(2))))),
        ("critics", ~accepted | (F.greatest(F.lit(1), F.coalesce("min_approvals", F.lit(2))) < 2) | (F.size(F.array_intersect(F.coalesce(F.transform("approvals", lambda a: a["role"]), F.array().cast("array<string>")), F.array(*map(F.lit, CRITICS)))) == len(CRITICS))),
    ]


def export_reasons(labels: DataFrame, errors: Column, required: Column) -> DataFrame:
    """labels with reasons: the errors of the rules, a status that isn't accepted, and too few current approvals. None: exported."""
    status = F.when(~F.coalesce(F.col("string_review_status").isin(*ACCEPTED), F.lit(False)), F.concat(F.lit("status="), F.coalesce("string_review_status", F.lit("none"))))
    n = F.coalesce(F.size("approvals"), F.lit(0))
    few = F.when(n < required, F.concat(F.lit("approvals="), n.cast("string"), F.lit(" requires="), required.cast("string")))
    return labels.withColumn("reasons", F.array_sort(F.array_distinct(F.concat(errors, F.array_compact(F.array(status, few))))))


def sampling_errors(records: DataFrame) -> DataFrame:
    """Sampling records with error, the first rule that is broken: digests of video and image, names that aren't blank, a known
    role, and numbers of frames and a time from 0 on, where an anchor is its own anchor."""
    text = lambda c: F.trim(F.coalesce(c, F.lit(""))) != ""
    hexed = lambda c: F.col(c).rlike("^[0-9a-f]{64}$")
    time = F.col("timestamp_s")
    numbers = (F.col("frame_index") >= 0) & (F.col("anchor_frame_index") >= 0) & (time >= 0) & ~F.isnan(time) & (time < float("inf"))
    rules = [("source_video_sha256", hexed("source_video_sha256")), ("output_image_sha256", hexed("output_image_sha256")), *[(c, text(c)) for c in ("source_video", "source_group", "sequence_id", "output_image")]]
    rules += [("role", F.col("role").isin("anchor", "temporal_context")), ("provenance", numbers & ((F.col("role") != "anchor") | (F.col("frame_index") == F.col("anchor_frame_index"))))]
    return gate_cascade(records, rules, "error")


def export_decisions(labels: DataFrame, collection: str, reasons: Column, conflicts: DataFrame) -> DataFrame:
    """labels with reasons and exported. A collection with conflicts (collection, kind) exports nothing: each of its labels has
    the first of them as a further reason."""
    first = conflicts.groupBy(collection).agg(F.min("kind").alias("_kind"))
    both = labels.withColumn("reasons", reasons).join(first, collection, "left")
    listed = F.when(F.col("_kind").isNotNull(), F.array_append("reasons", F.concat(F.lit("collection: "), "_kind"))).otherwise(F.col("reasons"))
    return both.withColumn("reasons", listed).withColumn("exported", F.size("reasons") == 0).drop("_kind")


def without_conflicts(labels: DataFrame, conflicts: DataFrame) -> DataFrame:
    """labels, unless the collection has conflicts (a table of kind and value): then the first of them stops the query.

    One row says whether there are any, so the labels aren't shuffled for it.
    """
    first = conflicts.agg(F.min(F.concat_ws(" ", "kind", F.col("value").cast("string"))).alias("_conflict"))
    checked = labels.join(F.broadcast(first))
    ok = F.when(F.col("_conflict").isNotNull(), F.raise_error(F.concat(F.lit("leakage in the collection: "), F.col("_conflict"))).cast("boolean")).otherwise(F.lit(True))
    return checked.where(ok).drop("_conflict")
