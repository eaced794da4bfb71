"""Documents with history: revisions, review states, imports, exports, caches and protected sets, as tables of rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions import jsondoc as J
from ..functions.geometry import point_box_distance
from .dedup import latest_reasons


def init_labels(records: DataFrame, existing: DataFrame, key: str, blank: dict[str, Column]) -> DataFrame:
    """Blank labels of the records that have none yet."""
    return records.join(existing.select(key), key, "left_anti").select(key, *[c.alias(n) for n, c in blank.items()], F.lit(1).alias("revision"), F.lit("blank").alias("status"))


def apply_revisions(history: DataFrame, changes: DataFrame, key: str, content: str) -> DataFrame:
    """history (key, revision, content) with one more row for each change that differs from the current content; changes
    (key, content, seq) apply in the order of seq, and the last row of a key is its current state."""
    w = W.partitionBy(key).orderBy(F.col("revision").desc())
    current = history.withColumn("_n", F.row_number().over(w)).where("_n = 1").select(key, F.col("revision").alias("_rev"), F.col(content).alias("_was"))
    order = W.partitionBy(key).orderBy("seq")
    steps = changes.join(current, key, "left").withColumn("_before", F.coalesce(F.lag(content).over(order), F.col("_was")))
    steps = steps.where(~F.col(content).eqNullSafe(F.col("_before")))
    number = F.coalesce("_rev", F.lit(0)) + F.row_number().over(order)
    return history.select(key, "revision", content).unionByName(steps.select(key, number.cast("long").alias("revision"), content))


def review_state(df: DataFrame, decision: Column, valid: Column, approvals: Column, critics: Column, needed: int) -> DataFrame:
    """status after a decision: approve needs a valid label, enough approvals and, for two or more, both critics."""
    enough = (approvals >= needed) & (F.lit(needed < 2) | (critics >= 2))
    status = (
        F.when((decision == "approve") & valid & enough, "approved").when((decision == "approve") & valid, "needs-approval").when(decision == "approve", "invalid")
        .when(decision == "reject", "rejected").when(decision == "unresolved", "unresolved").otherwise("needs-review")
    )
    return df.withColumn("status", status)


def upsert_reviews(reviews: DataFrame, events: DataFrame, key: str, order: str) -> DataFrame:
    """Reviews after events (key, confirmed, order and the rest of the columns): the last wins, one that unconfirms removes."""
    both = reviews.unionByName(events)
    w = W.partitionBy(key).orderBy(F.col(order).desc())
    return both.withColumn("_n", F.row_number().over(w)).where("_n = 1 and confirmed").drop("_n")


def temporal_chunks(points: DataFrame, key: str, order: str, lost: Column, least: int = 2) -> DataFrame:
    """Chunks between lost points of a transported line: key, chunk, first and last, points; short ones are left out."""
    w = W.partitionBy(key).orderBy(order)
    numbered = points.withColumn("_lost", F.coalesce(lost, F.lit(True))).withColumn("chunk", F.sum(F.col("_lost").cast("int")).over(w.rowsBetween(W.unboundedPreceding, 0))).where("not _lost")
    out = numbered.groupBy(key, "chunk").agg(F.min(order).alias("first"), F.max(order).alias("last"), F.count(F.lit(1)).alias("points"))
    return out.where(F.col("points") >= least)


def rescored_edge(evidence: Column, confidence: Column, end_lost: Column) -> Column:
    """Evidence and confidence of an edge after transport: observed becomes temporal at most .85 and 0.9 of it; with a lost end
    inferred, at most .25 and half of it."""
    lost = F.struct(F.lit("inferred").alias("evidence"), F.least(F.lit(0.25), 0.5 * confidence).alias("confidence"))
    kept = F.struct(F.when(evidence == "observed", "temporal").otherwise(evidence).alias("evidence"), F.least(F.lit(0.85), 0.9 * confidence).alias("confidence"))
    return F.when(end_lost, lost).otherwise(kept)


def export_gate(df: DataFrame, reasons: list[tuple[str, Column]]) -> tuple[DataFrame, DataFrame]:
    """Exported rows, and excluded ones with all their reasons."""
    found = F.array_compact(F.array(*[F.when(F.coalesce(c, F.lit(False)), F.lit(n)) for n, c in reasons]))
    marked = df.withColumn("reasons", found)
    return marked.where("size(reasons) = 0").drop("reasons"), marked.where("size(reasons) > 0")


def scanned_labels(labels: DataFrame, version: str, orientations: tuple[str, ...], visibilities: tuple[str, ...]) -> DataFrame:
    """path and reason of each label, null where it is kept: the first gate that it fails, or what became of it as a duplicate.

    labels: path, schema_version, has_pose, managed, source_group, trick_orientation, string_review_status, string_visibility,
    scopes, image_digest (null without an image), image_sha256 (declared), updated_at. Of labels of one image the latest by
    (updated_at, path) is kept; as they come by path, one behind the leader is superseded by it, one that led is replaced.
    """
    text = lambda c: F.trim(F.coalesce(c, F.lit("")))
    shown = lambda name, c: F.concat(F.lit(f"{name}="), F.coalesce(c, F.lit("None")))
    declared = text("image_sha256")
    gates = [
        (F.coalesce(F.col("schema_version") == version, F.lit(False)), shown("unsupported_schema_version", F.col("schema_version"))),
        (~F.col("has_pose"), F.lit("unsupported_pose_annotation_fields")), (~F.col("managed"), F.lit("unsupported_dataset_management_field")), (text("source_group") != "", F.lit("missing_source_group")),
        (text("trick_orientation").isin(*orientations), shown("invalid_trick_orientation", text("trick_orientation"))), (F.lower(F.coalesce("string_review_status", F.lit(""))).isin("approved", "reviewed"), shown("string_review_status", F.col("string_review_status"))),
        (text("string_visibility").isin(*visibilities), shown("invalid_string_visibility", text("string_visibility"))), (F.size(F.array_intersect("scopes", F.array(F.lit("visible_geometry"), F.lit("yoyo_bbox")))) == 2, F.lit("missing_geometry_or_yoyo_quality_approval")),
        (F.col("image_digest").isNotNull(), F.lit("source_image_missing")), ((declared == "") | (declared == F.col("image_digest")), F.lit("image_sha256_mismatch")),
    ]
    reason = F.lit(None).cast("string")
    for holds, said in reversed(gates):
        reason = F.when(~F.coalesce(holds, F.lit(False)), said).otherwise(reason)
    # labels that fail have an image of their own, so that they meet no other
    judged = labels.withColumn("reason", reason).withColumn("_image", F.when(F.col("reason").isNull(), F.col("image_digest")).otherwise(F.col("path")))
    told = latest_reasons(judged.withColumn("_updated", F.coalesce("updated_at", F.lit(""))), "_image", ["_updated"], "path")
    fate = F.when(F.col("fate") == "superseded", F.concat(F.lit("duplicate_image_superseded_by="), "by")).when(F.col("fate") == "replaced", F.concat(F.lit("duplicate_image_replaced_by="), "by"))
    return told.select("path", F.coalesce("reason", fate).alias("reason"))


def applied_once(labels: DataFrame, results: DataFrame, key: str, message: Column) -> DataFrame:
    """Labels (key, revision, messages, fields: a map) with the results (key, promotions: a map) applied, and apply_status.

    A result whose message is in the label's history has been applied before and changes nothing (already_applied); one without
    promotions doesn't either (nothing_to_apply); else its fields are set, the revision goes up by one and the message is put
    down. So a result that comes again, after a run that broke off or from a cache, counts once.
    """
    both = labels.join(results.select(key, "promotions", message.alias("_message")), key, "left")
    status = F.when(F.col("_message").isNull(), "no_result").when(F.array_contains("messages", F.col("_message")), "already_applied").when(F.size("promotions") < 1, "nothing_to_apply").otherwise("applied")
    both = both.withColumn("apply_status", status)
    done = F.col("apply_status") == "applied"
    kept = F.map_filter("fields", lambda k, _: ~F.array_contains(F.map_keys("promotions"), k))
    return both.select(key, F.when(done, F.map_concat(kept, "promotions")).otherwise(F.col("fields")).alias("fields"), (F.col("revision") + done.cast("long")).alias("revision"), F.when(done, F.array_append("messages", F.col("_message"))).otherwise(F.col("messages")).alias("messages"), "apply_status")


def rebase_sources(labels: DataFrame, listing: DataFrame, key: str, path: str) -> DataFrame:
    """action for each label: rebased (hash and size of the expected file agree), mismatch or missing; path is the new one where rebased."""
    new = listing.select(F.col(key), F.col(path).alias("_path"), F.col("sha").alias("_sha"), F.col("size").alias("_size"))
    both = labels.join(new, key, "left")
    action = F.when(F.col("_path").isNull(), "missing").when((F.col("sha") == F.col("_sha")) & (F.col("size") == F.col("_size")), "rebased").otherwise("mismatch")
    return both.withColumn("action", action).withColumn(path, F.when(F.col("action") == "rebased", F.col("_path")).otherwise(F.col(path))).drop("_path", "_sha", "_size")


def with_cache(requests: DataFrame, cache: DataFrame, keys: list[str], value: str, compute: Column) -> DataFrame:
    """requests with value: the cached one where all keys agree, else computed; cached says which."""
    known = cache.groupBy(*keys).agg(F.max(value).alias("_value"))
    both = requests.join(known, keys, "left")
    return both.withColumn("cached", F.col("_value").isNotNull()).withColumn(value, F.coalesce("_value", compute)).drop("_value")


def cleanup_candidates(listing: DataFrame, path: str, keep: list[str], protected: list[str], suffixes: list[str]) -> DataFrame:
    """Files that may go: with a listed suffix, not kept and under no protected folder; deepest first by depth."""
    p = F.col(path)
    guarded = F.lit(False)
    for folder in protected:
        guarded = guarded | p.startswith(folder.rstrip("/") + "/")
    match = F.lower(F.regexp_extract(path, r"(\.[^./]+)$", 1)).isin(*suffixes)
    return listing.where(match & ~guarded & ~p.isin(*keep)).withColumn("depth", F.size(F.split(path, "/")))


def protected_state(records: DataFrame, listing: DataFrame, reviews: DataFrame, key: str, sha: str) -> DataFrame:
    """problem of each key whose manifest, file and review disagree: missing file, untracked file, hash, review without record."""
    r = records.select(key, F.col(sha).alias("_want"), F.lit(True).alias("_r"))
    f = listing.select(key, F.col(sha).alias("_have"), F.lit(True).alias("_f"))
    v = reviews.select(key, F.lit(True).alias("_v"))
    both = r.join(f, key, "full").join(v, key, "full")
    problem = F.when(F.col("_r").isNull() & F.col("_f").isNull(), "review without record").when(F.col("_r").isNull(), "untracked file").when(F.col("_f").isNull(), "missing file").when(F.col("_want") != F.col("_have"), "hash")
    return both.withColumn("problem", problem).where("problem is not null").select(key, "problem")


def snapshots_equal(before: DataFrame, after: DataFrame) -> DataFrame:
    """Rows that one of two snapshots has and the other hasn't, with the side they are missing on; none if unchanged."""
    return before.exceptAll(after).withColumn("missing_in", F.lit("after")).unionByName(after.exceptAll(before).withColumn("missing_in", F.lit("before")))


def root_schema(listing: DataFrame, root: str, path: str, schema: str) -> DataFrame:
    """The schema of each root's first label in path order, which decides for the root."""
    return listing.groupBy(root).agg(F.min_by(schema, path).alias(schema), F.count(F.lit(1)).alias("labels"))


def recovered_groups(expected: DataFrame, listing: DataFrame, group: str, key: str) -> DataFrame:
    """group, recovered (its listing is exactly what is expected, repeats included) and the number expected."""
    left, right = expected.select(group, key), listing.select(group, key)
    differ = left.exceptAll(right).select(group).unionByName(right.exceptAll(left).select(group)).distinct().withColumn("_differs", F.lit(True))
    sizes = expected.groupBy(group).agg(F.count(F.lit(1)).alias("expected"))
    return sizes.join(differ, group, "left").select(group, F.col("_differs").isNull().alias("recovered"), "expected")


def stripped(docs: DataFrame, doc: str, keys: tuple[str, ...], anchors: tuple[str, ...], unknown: tuple[str, ...], migrated: dict[str, str]) -> DataFrame:
    """docs with doc (without the keys, its references to cleaned documents migrated), removed and remapped counts, and
    other_change: whether anything but the keys, the anchors and these references differs, which must not be."""
    clean = J.without_keys(F.col(doc), keys, anchors, unknown)
    out = docs.select("*", clean.alias("_clean"), J.removed_keys(F.col(doc), keys).alias("removed"))
    out = out.withColumn("doc", J.remap_digests(F.col("_clean"), migrated)).withColumn("remapped", J.matching_values(F.col("_clean"), tuple(migrated)))
    # the same cleaning of the result, and of the source with the migration undone, must agree
    again = J.without_keys(J.remap_digests(F.col("doc"), {v: k for k, v in migrated.items()}), keys, anchors, unknown)
    return out.withColumn("other_change", ~again.eqNullSafe(F.col("_clean"))).drop("_clean")


#: Values that label documents may have: fixed values.
ANCHORS = ("yoyo", "finger", "free", "image_edge", "unknown")
EVIDENCE = ("observed", "temporal", "inferred")
VISIBILITY = ("visible", "partial", "not_visible", "uncertain")
ORIENTATIONS = ("normal", "horizontal", "other", "not_applicable", "unknown")


def _to_2d(p: Column, size: Column) -> Column:
    """A point in pixels as 0..999 of the image, to three decimals."""
    return F.array(F.bround(p[0] / size[0] * 999.0, 3), F.bround(p[1] / size[1] * 999.0, 3))


def _box_2d(b: Column, size: Column) -> Column:
    return F.when(b.isNotNull(), F.concat(_to_2d(F.slice(b, 1, 2), size), _to_2d(F.slice(b, 3, 2), size)))


def upgraded(docs: DataFrame, version: str, known: tuple[str, ...]) -> DataFrame:
    """Label documents of the schema before in the present one. Documents of other versions stop the query.

    docs: schema_version, image_size, visibility, box, strokes, string_path (topology, paths of points_pixel, anchors and edges).
    What isn't visible becomes uncertain; normalised copies are made anew; an anchor at the toy is kept only near its
    box, unknown anchors and kinds of evidence get their default, and renamed evidence its new name. No other column is added.
    """
    size = F.col("image_size")
    near = F.greatest(F.lit(8.0), 0.08 * F.sqrt(size[0] * size[0] + size[1] * size[1]))
    uncertain = lambda c: F.when(c == "not_visible", "uncertain").otherwise(c)

    def anchor(name: Column, p: Column) -> Column:
        far = F.col("box").isNull() | p.isNull() | (point_box_distance(p, F.col("box")) > near)
        return F.when(~F.coalesce(name, F.lit("unknown")).isin(*ANCHORS) | ((name == "yoyo") & far), "unknown").otherwise(F.coalesce(name, F.lit("unknown")))

    def evidence(e: Column) -> Column:
        low = F.lower(F.coalesce(e, F.lit("")))
        return F.when(low == "reviewed", "observed").when(low == "propagated", "temporal").when(low.isin(*EVIDENCE), low).otherwise("inferred")

    path = lambda p: F.struct(p["points_pixel"].alias("points_pixel"), F.transform(p["points_pixel"], lambda q: _to_2d(q, size)).alias("points_2d"), anchor(p["start_anchor"], F.get(p["points_pixel"], F.lit(0))).alias("start_anchor"), anchor(p["end_anchor"], F.try_element_at(p["points_pixel"], F.lit(-1))).alias("end_anchor"), F.transform(p["edges"], lambda e: F.struct(evidence(e["evidence"]).alias("evidence"), e["confidence"].alias("confidence"))).alias("edges"))
    checked = F.when(F.col("schema_version").isin(*known), F.lit(version)).otherwise(F.raise_error(F.concat(F.lit("unsupported schema "), F.coalesce("schema_version", F.lit("none")))))
    out = docs.withColumns({"schema_version": checked, "visibility": uncertain(F.col("visibility")), "box_2d": _box_2d(F.col("box"), size), "strokes_2d": F.transform("strokes", lambda s: F.transform(s, lambda p: _to_2d(p, size)))})
    return out.withColumn("string_path", F.struct(uncertain(F.col("string_path.topology")).alias("topology"), F.transform("string_path.paths", path).alias("paths")))


def normalized_candidates(candidates: DataFrame) -> DataFrame:
    """Candidates as documents may have them: values out of the lists become the default, boxes and strokes are in pixels to
    three decimals with normalised copies, a scene without a trick has no orientation, and an invisible string no strokes.

    candidates: string_visibility, scene, orientation, box (pixels) or box_2d (0..999), strokes, bad_case, image_size.
    """
    size = F.col("image_size")
    listed = lambda c, values, default: F.when(F.lower(c).isin(*values), F.lower(c)).otherwise(default)
    visibility = listed(F.col("string_visibility"), VISIBILITY, "uncertain")
    orientation = F.when(F.lower("scene") == "non_trick", "not_applicable").otherwise(listed(F.col("orientation"), ORIENTATIONS, "unknown"))
    three = lambda a: F.transform(a, lambda v: F.bround(v, 3))
    from_2d = F.transform("box_2d", lambda v, i: F.bround(v / 999.0 * size[(i % 2).cast("int")], 3))
    box = F.coalesce(three(F.col("box")), from_2d)
    strokes = F.filter(F.transform("strokes", lambda s: F.transform(s, three)), lambda s: F.size(s) >= 2)
    hidden = visibility == "not_visible"
    said = F.array_sort(F.array_distinct(F.filter(F.transform("bad_case", lambda b: F.trim(b)), lambda b: b != "")))
    out = candidates.withColumns({"_v": visibility, "_o": orientation, "_b": box, "_s": F.when(~hidden & (F.size(strokes) > 0), strokes), "_c": F.when(hidden, F.array_union(said, F.array(F.lit("string_not_visible")))).otherwise(said)})
    out = out.withColumns({"string_visibility": F.col("_v"), "orientation": F.col("_o"), "box": F.col("_b"), "box_2d": _box_2d(F.col("_b"), size), "strokes": F.col("_s"), "strokes_2d": F.transform("_s", lambda s: F.transform(s, lambda p: _to_2d(p, size))), "bad_case": F.col("_c")})
    return out.drop("_v", "_o", "_b", "_s", "_c")


def imported(docs: DataFrame, dataset: str, sample: str, reviewer: Column, at: Column) -> DataFrame:
    """docs with a person's approval appended to reviews, review statuses set (an approved string stays so), and review_import:
    where the approval comes from and what the status was."""
    one = F.struct(reviewer.alias("reviewer"), F.lit("human-workbench").alias("model"), F.lit("approve").alias("decision"), at.alias("at"))
    was = F.coalesce("string_review_status", F.lit(""))
    source = F.struct(F.col(dataset).alias("dataset"), F.col(sample).alias("sample"), F.lit(True).alias("confirmed"), at.alias("confirmed_at"), reviewer.alias("reviewer"), was.alias("original_string_status"))
    none = F.filter(F.array(one), lambda _: F.lit(False))
    return docs.withColumns({"review_import": source, "reviews": F.array_append(F.coalesce("reviews", none), one), "review_status": F.lit("reviewed"), "string_review_status": F.when(F.lower(was).isin("approved", "reviewed"), was).otherwise("reviewed")})
