"""What a workbench saves: corrected labels with their log, and score documents with a versioned store."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.geometry import point_box_distance
from ..sources import files
from .dedup import latest_wins
from .documents import _box_2d, _to_2d

#: Values that an edit may hold: fixed values.
YOYO_VISIBILITY = ("visible", "partially_visible", "occluded", "out_of_frame", "absent", "uncertain")
TRICK_ORIENTATIONS = ("normal", "horizontal", "not_applicable")
STRING_VISIBILITY = ("visible", "partial", "not_visible", "uncertain")
REVIEW_STATUS = ("approved", "reviewed", "unresolved", "needs_review")
EDITED_FIELDS = ("visibility", "trick_orientation", "yoyo_bbox_pixel", "string_visibility", "string_polylines_pixel", "string_review_status", "bbox_review_status", "notes")
#: Columns of an edit, and of a label that an edit rewrites.
EDIT = "yoyo_visibility string, trick_orientation string, string_visibility string, string_review_status string, yoyo_bbox_pixel array<double>, string_polylines_pixel array<array<array<double>>>, bbox_review_status string, notes string, reviewer string"


def _first(rules: list[tuple[str, Column]]) -> Column:
    """The name of the first rule that is broken, null if none is. A rule whose value is null is broken."""
    return reduce(lambda out, r: F.when(~F.coalesce(r[1], F.lit(False)), F.lit(r[0])).otherwise(out), reversed(rules), F.lit(None).cast("string"))


def _or(value: Column, default: str) -> Column:
    """value, or the default where it is null or empty."""
    return F.coalesce(F.nullif(value, F.lit("")), F.lit(default))


def edit_changes(labels: DataFrame, edits: DataFrame, reviews: DataFrame, key: str, at: Column) -> DataFrame:
    """One row for each edit: key, error, label, log, drops_review. An edit without a label has the error `no label`.

    labels: key, image_size, paths (array of path_id, start_anchor, end_anchor), topology, reconstruction_status and anything
    else; edits: key and EDIT; reviews: key. Enumerations, the size, the box (corners in any order, inside of the image, null
    for a yoyo that isn't there) and all points are checked; the first rule that is broken is the error, and then label and
    log are null. label is the label's corrected state: geometry rounded to three decimals, its 0..999 mirrors, the first
    line's own columns, and paths rebuilt line by line over the old ones, whose ends stay tied to the yoyo if they are near
    it. Lines of one point are left out. log says who changed what from which content; a review of the label is void.
    One join on the key finds all of it, so label, log row and dropped review can't come apart. Keys are unique on each side.
    """
    e = edits.select(key, F.struct(*[c.split()[0] for c in EDIT.split(", ")]).alias("_e"))
    content = F.sha2(F.to_json(F.struct(*[c for c in sorted(labels.columns)])), 256)
    old = labels.select(key, "image_size", "paths", "topology", "reconstruction_status", content.alias("_before"), F.lit(True).alias("_there"))
    both = e.join(old, key, "left").join(reviews.select(key, F.lit(True).alias("_reviewed")).distinct(), key, "left")
    size = F.col("image_size")
    width, height = size[0].cast("double"), size[1].cast("double")
    given = F.col("_e.yoyo_bbox_pixel")
    box = F.array(F.least(given[0], given[2]), F.least(given[1], given[3]), F.greatest(given[0], given[2]), F.greatest(given[1], given[3]))
    box = F.when(given.isNotNull(), F.transform(box, lambda v: F.bround(v, 3)))
    raw = F.coalesce("_e.string_polylines_pixel", F.array().cast("array<array<array<double>>>"))
    inside = lambda p: (F.size(p) == 2) & p[0].between(0, width) & p[1].between(0, height)
    lines = F.filter(F.transform(raw, lambda line: F.transform(line, lambda p: F.transform(p, lambda v: F.bround(v, 3)))), lambda line: F.size(line) >= 2)
    yoyo, trick, string, status = _or(F.col("_e.yoyo_visibility"), "uncertain"), F.coalesce("_e.trick_orientation", F.lit("")), _or(F.col("_e.string_visibility"), "uncertain"), _or(F.col("_e.string_review_status"), "unresolved")
    both = both.withColumns({"_box": box, "_lines": lines, "_yoyo": yoyo, "_string": string})
    fits = lambda c, most: (F.least(given[c], given[c + 2]) >= 0) & (F.least(given[c], given[c + 2]) < F.greatest(given[c], given[c + 2])) & (F.greatest(given[c], given[c + 2]) <= most)
    rules = [
        ("no label", F.col("_there")),
        ("image size", (F.size(size) == 2) & (width > 0) & (height > 0)),
        ("yoyo visibility", F.col("_yoyo").isin(*YOYO_VISIBILITY)),
        ("trick orientation", trick.isin(*TRICK_ORIENTATIONS)),
        ("string visibility", F.col("_string").isin(*STRING_VISIBILITY)),
        ("string review status", status.isin(*REVIEW_STATUS)),
        ("yoyo box", given.isNull() | ((F.size(given) == 4) & fits(0, width) & fits(1, height))),
        ("string points", F.forall(raw, lambda line: F.forall(line, inside))),
        ("visible yoyo without box", (F.col("_yoyo") != "visible") | given.isNotNull()),
        ("visible string without line", ~F.col("_string").isin("visible", "partial") | (F.size("_lines") > 0)),
    ]
    both = both.withColumn("error", _first(rules)).withColumn("_box", F.when(~F.col("_yoyo").isin("absent", "out_of_frame"), F.col("_box")))
    both = both.withColumn("_lines", F.when(F.col("_string") == "not_visible", F.slice("_lines", 1, 0)).otherwise(F.col("_lines")))
    near = F.greatest(F.lit(8.0), F.sqrt(width * width + height * height) * 0.08)
    anchor = lambda was, end: F.when((was == "yoyo") & F.col("_box").isNotNull() & (point_box_distance(end, F.col("_box")) <= near), "yoyo").otherwise("unknown")
    flat = lambda line: F.transform(line, lambda p: _to_2d(p, size))

    def path(line: Column, i: Column) -> Column:
        was = F.get("paths", i)
        steps = F.transform(F.sequence(F.lit(0), F.size(line) - 2), lambda k: F.struct(k.alias("from"), (k + 1).alias("to"), F.lit("observed").alias("evidence"), F.lit(1.0).alias("confidence")))
        name = _or(was["path_id"], "").alias("path_id")
        name = F.when(name == "", F.concat(F.lit("workbench-line-"), (i + 1).cast("string"))).otherwise(name)
        return F.struct(name.alias("path_id"), anchor(was["start_anchor"], line[0]).alias("start_anchor"), anchor(was["end_anchor"], F.element_at(line, -1)).alias("end_anchor"), line.alias("points_pixel"), flat(line).alias("points_2d"), steps.alias("edges"))

    none = F.size("_lines") == 0
    mirrors = F.transform("_lines", flat)
    label = F.struct(
        F.col("_yoyo").alias("visibility"), trick.alias("trick_orientation"), F.col("_box").alias("yoyo_bbox_pixel"), _box_2d(F.col("_box"), size).alias("yoyo_bbox_2d"), F.col("_string").alias("string_visibility"),
        F.col("_lines").alias("string_polylines_pixel"), mirrors.alias("string_polylines_2d"), F.get("_lines", F.lit(0)).alias("string_polyline_pixel"), F.get(mirrors, F.lit(0)).alias("string_polyline_2d"),
        status.alias("string_review_status"), _or(F.col("_e.bbox_review_status"), "reviewed").alias("bbox_review_status"), F.trim(F.coalesce("_e.notes", F.lit(""))).alias("notes"), at.alias("updated_at"),
        F.when(F.col("paths").isNotNull(), F.transform("_lines", path)).alias("paths"), F.when(none & F.col("paths").isNotNull(), "uncertain").otherwise(F.col("topology")).alias("topology"),
        F.when(none & F.col("paths").isNotNull(), "not_applicable").otherwise(F.col("reconstruction_status")).alias("reconstruction_status"),
    )
    log = F.struct(at.alias("created_at"), _or(F.trim("_e.reviewer"), "workbench-reviewer").alias("actor"), F.col("_before").alias("before_sha256"), F.array(*[F.lit(f) for f in EDITED_FIELDS]).alias("fields"))
    fine = F.col("error").isNull()
    return both.select(key, "error", F.when(fine, label).alias("label"), F.when(fine, log).alias("log"), (fine & F.coalesce("_reviewed", F.lit(False))).alias("drops_review"))


#: What score documents may hold: fixed values.
DIVISIONS = ("1A", "2A", "3A", "4A", "5A")
MAJOR_PENALTIES = {"restart": -1, "discard": -3, "disassembly": -5}
ANCHOR_SOURCES = ("evidence_end_default", "manual")
EXCLUSION_REASONS = ("defocus", "occlusion", "corrupted_frames", "other")
SCENE_TYPES = ("irrelevant_scene", "player_entry_exit")
#: Columns of a score document.
SCORE = (
    "schema_version string, division string, judge string, source_path string, file_name string, browser_identity string, updated_at string, "
    "events array<struct<family:string,score_delta:int,penalty_type:string,start:double,anchor:double,end:double,anchor_source:string>>, "
    "excluded_intervals array<struct<start:double,end:double,reason:string,training_eligible:boolean>>, scene_intervals array<struct<start:double,end:double,scene_type:string>>, "
    "serve_receive_events array<struct<track:string,type:string,start:double,anchor:double,end:double,anchor_frame:int,start_frame:int,end_frame:int>>"
)


def _each(name: str, column: Column, rules) -> Column:
    """name[i].rule of each element that breaks a rule, by its first."""
    return F.array_compact(F.transform(F.coalesce(column, F.slice(column, 1, 0), F.array()), lambda e, i: F.concat(F.lit(f"{name}["), i.cast("string"), F.lit("]."), _first(rules(e)))))


def score_errors(docs: DataFrame, version: str, videos: str = "videos") -> DataFrame:
    """docs (SCORE) with errors: every rule of a score document that is broken, in the order of the rules.

    The document's own: schema_version, division, judge, source_path (relative, without .., inside of the videos' folder).
    Of events: the family's score (positive 0 to 10, negative -10 to -1, a major penalty's own), family, timing (known, from
    0 on, start <= anchor <= end) and anchor_source; of excluded intervals: timing, reason and that they are no training
    data; of scenes, which must be listed: timing and type; of serve and receive: marker, timing and frame numbers.
    """
    known = lambda *c: reduce(lambda a, b: a & b, (x.isNotNull() for x in c))
    span = lambda e: [("timing", known(e["start"], e["end"])), ("order", (e["start"] >= 0) & (e["start"] < e["end"]))]
    timed = lambda e: [("timing", known(e["start"], e["anchor"], e["end"])), ("order", (e["start"] >= 0) & (e["start"] <= e["anchor"]) & (e["anchor"] <= e["end"]))]
    penalties = F.create_map(*[F.lit(x) for item in MAJOR_PENALTIES.items() for x in item])

    def event(e: Column) -> list[tuple[str, Column]]:
        family, delta = e["family"], e["score_delta"]
        return [
            ("positive", ~F.coalesce(family == "positive", F.lit(False)) | delta.between(0, 10)), ("negative", ~F.coalesce(family == "negative", F.lit(False)) | delta.between(-10, -1)),
            ("penalty", ~F.coalesce(family == "major_penalty", F.lit(False)) | (F.try_element_at(penalties, F.coalesce(e["penalty_type"], F.lit(""))) == delta)), ("family", family.isin("positive", "negative", "major_penalty")),
            *timed(e), ("anchor_source", e["anchor_source"].isin(*ANCHOR_SOURCES)),
        ]

    path = F.trim(F.coalesce("source_path", F.lit("")))
    parts = F.filter(F.split(path, "/"), lambda p: ~p.isin("", "."))
    own = [
        ("schema_version", F.col("schema_version") == version), ("division", F.col("division").isin(*DIVISIONS)), ("judge", F.trim("judge") != ""),
        ("source_path", (path != "") & ~path.startswith("/") & ~F.array_contains(parts, "..") & F.coalesce(F.get(parts, F.lit(0)) == videos, F.lit(False))),
    ]
    found = F.concat(
        F.array_compact(F.array(*[F.when(~F.coalesce(holds, F.lit(False)), F.lit(rule)) for rule, holds in own])), _each("events", F.col("events"), event),
        _each("excluded_intervals", F.col("excluded_intervals"), lambda e: [*span(e), ("reason", e["reason"].isin(*EXCLUSION_REASONS)), ("training_eligible", ~e["training_eligible"])]),
        F.when(F.col("scene_intervals").isNull(), F.array(F.lit("scene_intervals"))).otherwise(_each("scene_intervals", F.col("scene_intervals"), lambda e: [*span(e), ("scene_type", e["scene_type"].isin(*SCENE_TYPES))])),
        _each("serve_receive_events", F.col("serve_receive_events"), lambda e: [("marker", (e["track"] == "serve_receive") & e["type"].isin("begin", "end")), *timed(e), ("frames", known(e["anchor_frame"], e["start_frame"], e["end_frame"]))]),
    )
    return docs.withColumn("errors", found)


def score_key(file_name: Column, identity: Column) -> Column:
    """Name of a score document: the cleaned stem of the video's name, at most 80 characters, and 16 digits of the identity's hash."""
    stem = F.regexp_replace(F.regexp_extract(_or(file_name, "video"), r"([^/]*)$", 1), r"(?<=.)\.[^.]*$", "")
    clean = F.regexp_replace(F.regexp_replace(stem, "[^A-Za-z0-9._-]+", "_"), "^[._-]+|[._-]+$", "")
    return F.concat(F.substring(_or(clean, "video"), 1, 80), F.lit("_"), identity_digits(identity), F.lit(".json"))


def identity_digits(identity: Column) -> Column:
    return F.substring(F.sha2(F.trim(identity), 256), 1, 16)


STORE = f"storage_key string, identity string, version long, deleted boolean, document struct<{', '.join(c.replace(' ', ':', 1) for c in SCORE.split(', '))}>"


def save_scores(docs: DataFrame, base: str, version: int, schema_version: str) -> DataFrame:
    """Append the sound documents of docs (SCORE) to the store under base as one version; the others, with their errors, are given back."""
    judged = score_errors(docs, schema_version)
    errors = F.when(F.trim(F.coalesce("browser_identity", F.lit(""))) == "", F.array_append("errors", F.lit("browser_identity"))).otherwise(F.col("errors"))
    judged = judged.withColumn("errors", errors)
    document = F.struct(*[c.split()[0] for c in SCORE.split(", ")]).alias("document")
    rows = judged.where(F.size("errors") == 0).select(score_key(F.col("file_name"), F.col("browser_identity")).alias("storage_key"), identity_digits(F.col("browser_identity")).alias("identity"), F.lit(version).cast("long").alias("version"), F.lit(False).alias("deleted"), document)
    rows.write.mode("append").parquet(f"{base}/log")
    return judged.where(F.size("errors") > 0)


def delete_scores(keys: DataFrame, base: str, version: int) -> None:
    """Mark the documents of keys (storage_key) as deleted from this version on. Keys that are no names of documents stop the query."""
    sound = F.col("storage_key").endswith(".json") & ~F.col("storage_key").contains("/")
    key = F.when(sound, F.col("storage_key")).otherwise(F.raise_error(F.concat(F.lit("no storage key: "), F.coalesce("storage_key", F.lit("null")))).cast("string"))
    gone = keys.select(key.alias("storage_key"), F.lit(None).cast("string").alias("identity"), F.lit(version).cast("long").alias("version"), F.lit(True).alias("deleted"), F.lit(None).cast(STORE.split("document ")[1]).alias("document"))
    gone.write.mode("append").parquet(f"{base}/log")


def live_scores(spark: SparkSession, base: str, compacted: bool = False) -> DataFrame:
    """storage_key, identity, version and document of what isn't deleted: of each key the row of the greatest version.

    compacted: begin with the last compaction, and of the log read only what is newer.
    """
    log = spark.read.schema(STORE).parquet(f"{base}/log")
    if compacted:
        before = files.published(spark, f"{base}/compact")
        upto = before.agg(F.max("upto")).first()[0]  # null where nothing was live: then the log has all there is
        log = before.drop("upto").unionByName(log.where(F.col("version") > upto)) if upto is not None else log
    return latest_wins(log, "storage_key", ["version", "deleted"]).where("not deleted").drop("deleted")


def compact_scores(spark: SparkSession, base: str) -> str:
    """Publish what is live as one table, so that readers needn't read the whole log; the log stays."""
    upto = spark.read.schema(STORE).parquet(f"{base}/log").agg(F.max("version")).first()[0]
    live = live_scores(spark, base).withColumns({"deleted": F.lit(False), "upto": F.lit(upto).cast("long")})
    return files.publish(spark, live, f"{base}/compact", [])


def load_scores(live: DataFrame, identities: DataFrame) -> DataFrame:
    """browser_identity, storage_key and document of each of identities (browser_identity): the last by key of the identity's
    documents; null where there is none. An empty identity has none."""
    wanted = identities.select("browser_identity", F.when(F.trim("browser_identity") != "", identity_digits(F.col("browser_identity"))).alias("identity"))
    last = live.groupBy("identity").agg(F.max_by(F.struct("storage_key", "version", "document"), "storage_key").alias("found"))
    return wanted.join(last, "identity", "left").select("browser_identity", "found.storage_key", "found.version", "found.document")
