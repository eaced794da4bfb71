"""Queries of sources, sinks, documents and streams."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W

from ..functions import geometry as G
from ..functions import jsondoc as J
from ..functions import scalars as S
from ..operators import documents as D
from ..operators import dedup, gates, patches, reports
from ..scratch import scratch_dir
from ..sources import files
from ..streaming import sinks, stateful, windows
from . import sequences
from .tables import BOXES, FRAMES, SAMPLES, SPLIT, boxes, frames, read, samples, split_of

Q: dict = {}


def query(name: str, sql: str | None = None):
    def add(f):
        Q[name] = (f, sql)
        return f

    return add


def fresh(spark, label: str) -> str:
    return f"{scratch_dir(spark)}/{label}-{uuid.uuid4().hex}"


# sources and sinks


@query("src_collect_files", "SELECT count(*) >= 1 AS found FROM region")
def src_collect_files(spark, sf_dir):
    return files.collect_files(spark, f"{sf_dir}/region.parquet", [".parquet"]).agg((F.count(F.lit(1)) >= 1).alias("found"))


@query("src_json_object", "SELECT user_id, CASE WHEN user_id % 4 = 0 THEN 'not an object' END AS reason, CASE WHEN user_id % 4 <> 0 THEN user_id END AS k FROM (SELECT DISTINCT user_id FROM events)")
def src_json_object(spark, sf_dir):
    """Documents are written one a file, then scanned; those that aren't one object carry a reason."""
    base = fresh(spark, "objects")
    users = read(spark, sf_dir, "events").select("user_id").distinct()
    text = F.when(F.col("user_id") % 4 == 0, F.concat(F.lit("["), "user_id", F.lit("]"))).otherwise(F.concat(F.lit('{"k": '), "user_id", F.lit("}")))
    users.select(text.alias("value"), F.concat(F.lit("u"), "user_id").alias("name")).repartition("name").write.partitionBy("name").text(base)
    found = files.json_objects(spark, base, T.StructType.fromDDL("k long"), "*.txt")
    return found.select(F.regexp_extract("path", r"name=u(\d+)/", 1).cast("long").alias("user_id"), "reason", F.col("doc.k").alias("k"))


@query("src_jsonl_strict", "SELECT event_id, user_id FROM events")
def src_jsonl_strict(spark, sf_dir):
    base = fresh(spark, "lines")
    rows = read(spark, sf_dir, "events").select("event_id", "user_id")
    rows.select(F.explode(F.array(F.to_json(F.struct("event_id", "user_id")), F.lit("  "))).alias("value")).write.text(base)
    return files.json_lines_strict(spark, base, T.StructType.fromDDL("event_id long, user_id long"))


@query("src_label_scan_gated", f"""WITH {SAMPLES}, l AS (SELECT *, 'labels/' || lpad(doc_id::VARCHAR, 9, '0') || '.json' AS path, (n_chars % 5)::VARCHAR AS updated FROM samples),
g AS (SELECT *, CASE WHEN doc_id % 11 = 0 THEN 'unsupported_schema_version=v4' WHEN doc_id % 13 = 0 THEN 'unsupported_pose_annotation_fields' WHEN doc_id % 17 = 0 THEN 'unsupported_dataset_management_field' WHEN doc_id % 19 = 0 THEN 'missing_source_group' WHEN doc_id % 23 = 0 THEN 'invalid_trick_orientation=diagonal'
  WHEN toxic IS NOT NULL AND quality = 0 THEN 'string_review_status=draft' WHEN doc_id % 29 = 0 THEN 'invalid_string_visibility=bad' WHEN doc_id % 31 = 0 THEN 'missing_geometry_or_yoyo_quality_approval' WHEN doc_id % 37 = 0 THEN 'source_image_missing' WHEN doc_id % 41 = 0 THEN 'image_sha256_mismatch' END AS gate FROM l),
b AS (SELECT *, max(updated || path) OVER (PARTITION BY CASE WHEN gate IS NULL THEN sha ELSE path END ORDER BY path ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM g), d AS (SELECT *, before IS NULL OR updated || path > before AS leads FROM b),
n AS (SELECT *, min(CASE WHEN leads THEN path END) OVER (PARTITION BY CASE WHEN gate IS NULL THEN sha ELSE path END ORDER BY path ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS nxt FROM d)
SELECT path, coalesce(gate, CASE WHEN NOT leads THEN 'duplicate_image_superseded_by=' || substr(before, 2) WHEN nxt IS NOT NULL THEN 'duplicate_image_replaced_by=' || nxt END) AS reason FROM n""")
def src_label_scan_gated(spark, sf_dir):
    """Every label with the first gate that it fails, or the label of the same image that took its place."""
    d = F.col("doc_id")
    labels = samples(spark, sf_dir).select(
        F.concat(F.lit("labels/"), F.lpad(d.cast("string"), 9, "0"), F.lit(".json")).alias("path"), F.when(d % 11 == 0, "v4").otherwise("v5").alias("schema_version"), (d % 13 == 0).alias("has_pose"), (d % 17 == 0).alias("managed"), F.when(d % 19 == 0, " ").otherwise(F.col("source")).alias("source_group"),
        F.when(d % 23 == 0, "diagonal").otherwise(" normal").alias("trick_orientation"), F.when(F.col("toxic").isNotNull() & (F.col("quality") == 0), "draft").otherwise("Approved").alias("string_review_status"), F.when(d % 29 == 0, "bad").otherwise("partial").alias("string_visibility"),
        F.when(d % 31 == 0, F.array(F.lit("yoyo_bbox"))).otherwise(F.array(F.lit("yoyo_bbox"), F.lit("visible_geometry"), F.lit("x"))).alias("scopes"), F.when(d % 37 != 0, F.col("sha")).alias("image_digest"), F.when(d % 41 == 0, "0").when(d % 2 == 0, F.col("sha")).alias("image_sha256"), (F.col("n_chars") % 5).cast("string").alias("updated_at"),
    )
    return D.scanned_labels(labels, "v5", ("normal", "horizontal", "not_applicable"), ("visible", "partial", "not_visible", "uncertain"))


@query("src_discover_roots")
def src_discover_roots(spark, sf_dir):
    """Roots of a small local tree, listed on the driver."""
    import os
    import tempfile

    with tempfile.TemporaryDirectory() as base:
        for name in ("b/labels", "a/labels", "score_annotations/labels", "c/images"):
            os.makedirs(os.path.join(base, name))
        found = [os.path.basename(p) for p in files.discover_roots(base)]
    return spark.createDataFrame([(n,) for n in found], "root string")


@query("src_video_list", "SELECT source AS path, min(doc_id) AS line FROM documents WHERE doc_id % 3 <> 0 GROUP BY source")
def src_video_list(spark, sf_dir):
    lines = read(spark, sf_dir, "documents").select(F.col("doc_id").alias("line"), F.when(F.col("doc_id") % 3 == 0, F.concat(F.lit("# "), "source")).otherwise(F.concat(F.lit(" "), "source", F.lit(" # note"))).alias("value"))
    return files.video_list(spark, lines)


@query("src_group_frames", f"WITH {FRAMES} SELECT CAST(grp AS VARCHAR) AS group_id, CAST(frame AS INTEGER) AS position, frame AS frame_index, event_type FROM frames")
def src_group_frames(spark, sf_dir):
    e = frames(spark, sf_dir)
    key = F.concat_ws("/", "grp", "frame")
    groups = e.groupBy(F.col("grp").cast("string").alias("group_id")).agg(F.transform(F.array_sort(F.collect_list(F.struct("frame", key.alias("k")))), lambda s: F.struct(s["k"].alias("sample_key"), s["frame"].alias("frame_index"))).alias("frames"))
    found = files.group_frames(groups, e.select(key.alias("sample_key"), "event_type"), "sample_key")
    return found.select("group_id", "position", "frame_index", "event_type")


@query("src_snapshot_frames", f"WITH {FRAMES} SELECT grp AS group_id, frame AS frame_index, CASE WHEN frame % 2 = 0 THEN event_type ELSE 'unknown' END AS label FROM frames")
def src_snapshot_frames(spark, sf_dir):
    e = frames(spark, sf_dir).select(F.col("grp").alias("group_id"), F.col("frame").alias("frame_index"), F.lit("unknown").alias("label"), F.struct(F.when(F.col("frame") % 2 == 0, F.col("event_type")).alias("label")).alias("annotation"))
    return files.snapshot_frames(e, ["label"])


@query("src_snapshot_export", f"WITH {SAMPLES} SELECT doc_id, source, quality FROM samples WHERE quality IS NOT NULL")
def src_snapshot_export(spark, sf_dir):
    base = fresh(spark, "snapshot")
    samples(spark, sf_dir).where("quality is not null").select("doc_id", "source", "quality").write.json(base)
    return spark.read.schema("doc_id long, source string, quality int").json(base)


@query("src_config")
def src_config(spark, sf_dir):
    tree = {"tracking": {"confidence": "0.25", "classes": ["a", "b"], "tta": "yes"}}
    rows = [("confidence", str(files.typed_setting(tree, {"CONF": "0.5"}, "CONF", "tracking.confidence", 0.1))), ("classes", str(files.typed_setting(tree, {}, "X", "tracking.classes", ("x",)))), ("tta", str(files.typed_setting(tree, {}, "X", "tracking.tta", False))), ("absent", str(files.typed_setting(tree, {}, "X", "tracking.none", 7)))]
    return spark.createDataFrame(rows, "name string, value string")


@query("sink_jsonl_append", "SELECT event_id FROM events")
def sink_jsonl_append(spark, sf_dir):
    base = fresh(spark, "log")
    e = read(spark, sf_dir, "events").select("event_id")
    files.append_json_lines(e.where("event_id % 3 = 0"), base)
    files.append_json_lines(e.where("event_id % 3 <> 0"), base)
    return spark.read.schema("event_id long").json(base)


@query("sink_atomic_text")
def sink_atomic_text(spark, sf_dir):
    import os
    import tempfile

    with tempfile.TemporaryDirectory() as base:
        files.write_text_atomic(os.path.join(base, "doc.json"), '{"a": 1}')
        left = sorted(os.listdir(base))
    return spark.createDataFrame([(n,) for n in left], "name string")


@query("sink_dataset_views", "SELECT 'detection' AS view, count(*) AS n FROM documents UNION ALL SELECT 'text', count(*) FROM documents")
def sink_dataset_views(spark, sf_dir):
    base = fresh(spark, "views")
    d = read(spark, sf_dir, "documents").withColumn("split", split_of(F.col("source")))
    files.write_views(d, base, {"detection": ["doc_id", "source"], "text": ["doc_id", "lang"]})
    count = lambda v: spark.read.parquet(f"{base}/{v}").agg(F.lit(v).alias("view"), F.count(F.lit(1)).alias("n"))
    return count("detection").unionByName(count("text"))


@query("sink_staged_publish", "SELECT doc_id FROM documents WHERE doc_id % 2 = 0")
def sink_staged_publish(spark, sf_dir):
    base = fresh(spark, "published")
    d = read(spark, sf_dir, "documents").select("doc_id")
    files.publish(spark, d.where("doc_id % 2 = 0"), base, [("negative ids", d.where("doc_id < 0"))])
    return files.published(spark, base)


# documents


@query("fn_canonical_json", "SELECT event_id, '{\"k\":' || json_extract_string(props, '$.k') || '}' AS doc FROM events")
def fn_canonical_json(spark, sf_dir):
    return read(spark, sf_dir, "events").select("event_id", J.canonical_json(F.col("props")).alias("doc"))


@query("fn_content_digest", "SELECT event_id, sha256('{\"absent\":null,\"k\":' || json_extract_string(props, '$.k') || '}') AS digest FROM events")
def fn_content_digest(spark, sf_dir):
    return read(spark, sf_dir, "events").select("event_id", J.content_digest(F.col("props"), ("k", "absent")).alias("digest"))




def nested(props="props"):
    return F.concat(F.lit('{"a": {"pose": 1, "k": '), F.get_json_object(props, "$.k"), F.lit('}, "b": [{"hand_pose": 2, "anchor": "left_hand"}], "pose": null}'))


@query("prj_clean_nested", """SELECT event_id, '{"a":{"k":' || json_extract_string(props, '$.k') || '},"b":[{"anchor":"unknown","hand_pose":2}]}' AS doc, 2 AS removed FROM events""")
def prj_clean_nested(spark, sf_dir):
    return read(spark, sf_dir, "events").select("event_id", J.without_keys(nested(), ("pose",), ("anchor",), ("left_hand", "right_hand")).alias("doc"), J.removed_keys(nested(), ("pose",)).alias("removed"))


@query("doc_strip_pose", """SELECT event_id, '{"a":{"k":' || json_extract_string(props, '$.k') || '},"b":[{"anchor":"unknown","hand_pose":2}],"was":"seen"}' AS doc, 2 AS removed, 1 AS remapped, false AS other_change FROM events""")
def doc_strip_pose(spark, sf_dir):
    """Pose fields go, digests of what was cleaned are migrated, and nothing else may change."""
    docs = read(spark, sf_dir, "events").select("event_id", F.concat(F.substring(nested(), 1, F.length(nested()) - 1), F.lit(', "was": "view"}')).alias("before"))
    return D.stripped(docs, "before", ("pose",), ("anchor",), ("left_hand", "right_hand"), {"view": "seen"}).select("event_id", "doc", "removed", "remapped", "other_change")


@query("prj_prohibited_keys", "SELECT event_id, 'a.pose,b[0].hand_pose,pose' AS keys FROM events")
def prj_prohibited_keys(spark, sf_dir):
    return read(spark, sf_dir, "events").select("event_id", F.array_join(J.prohibited_keys(nested(), ("pose",)), ",").alias("keys"))


@query("fn_digest_remap", """SELECT event_id, '{"d":"' || CASE WHEN event_type = 'view' THEN 'seen' ELSE event_type END || '"}' AS doc FROM events""")
def fn_digest_remap(spark, sf_dir):
    doc = F.to_json(F.struct(F.col("event_type").alias("d")))
    return read(spark, sf_dir, "events").select("event_id", J.remap_digests(doc, {"view": "seen"}).alias("doc"))


@query("fn_extract_json", "SELECT event_type, CAST(sum(CAST(json_extract_string(props, '$.k') AS BIGINT)) AS BIGINT) AS k FROM events GROUP BY event_type")
def fn_extract_json(spark, sf_dir):
    said = F.concat(F.lit("Sure {: ```json\n"), "props", F.lit("\n``` done"))
    found = read(spark, sf_dir, "events").select("event_type", F.get_json_object(J.extract_json(said), "$.k").cast("long").alias("k"))
    return found.groupBy("event_type").agg(F.sum("k").alias("k"))


#: The value (10, 20) of a patch in the image's pixels, by the frame of the box.
MOVED = "CASE frame % 6 WHEN 1 THEN round_even(10 * (199 / 999.0), 3) WHEN 2 THEN 15 WHEN 3 THEN 25 WHEN 4 THEN 20 ELSE 10 END AS vx, CASE frame % 6 WHEN 1 THEN round_even(20 * (99 / 999.0), 3) WHEN 2 THEN 27 WHEN 3 THEN 47 WHEN 4 THEN 40 ELSE 20 END AS vy"


@query("prj_patch_ops", f"""WITH {BOXES}, v AS (SELECT *, {MOVED} FROM boxes),
s AS (SELECT *, [[[x1, y1], [x2, y2]], [[x2, y1], [x1, y2], [x1, y1]]] AS old, CASE WHEN frame % 6 = 5 THEN 'coordinate frame' WHEN det % 9 = 8 THEN 'ops[1]: stroke' WHEN det % 9 = 7 THEN 'ops[0]: points' END AS error FROM v),
n AS (SELECT *, CASE det % 9 WHEN 0 THEN [[[vx, vy], [vx, vy]], old[1], old[2]] WHEN 1 THEN [old[1]] WHEN 2 THEN [[[vx, vy], [vx, vy], [vx, vy]], old[2]] WHEN 3 THEN [old[1], [[x2, y1], [x1, y2], [vx, vy]]] WHEN 4 THEN [[[x1, y1], [vx, vy], [x2, y2]], old[2]] WHEN 5 THEN [old[2]] WHEN 6 THEN [old[1]] END AS new FROM s)
SELECT frame, det, error, CASE WHEN error IS NULL THEN len(new) END AS strokes, CASE WHEN error IS NULL THEN len(flatten(new)) END AS points, CASE WHEN error IS NULL THEN round_even(list_sum([p[1] for p in flatten(new)]), 3) END AS x, CASE WHEN error IS NULL THEN round_even(list_sum([p[2] for p in flatten(new)]), 3) END AS y,
  CASE WHEN error IS NULL THEN round_even(new[1][1][1] / 200 * 999, 3) END AS x_2d, CASE WHEN error IS NULL THEN CASE WHEN det % 9 IN (1, 5, 6) THEN 'open' ELSE 'multiple' END END AS topology,
  CASE WHEN error IS NULL THEN CASE WHEN frame % 2 = 0 AND sqrt(pow(greatest(greatest(x1 - new[1][1][1], 0), new[1][1][1] - x2), 2) + pow(greatest(greatest(y1 - new[1][1][2], 0), new[1][1][2] - y2), 2)) <= greatest(8, 0.06 * sqrt(200 * 200 + 100 * 100)) THEN 'yoyo' ELSE 'unknown' END END AS start_anchor FROM n""")
def prj_patch_ops(spark, sf_dir):
    """A patch for each box's two strokes: all operations in all frames of coordinates, and the path rebuilt from what they leave."""
    corner = lambda x, y: F.array(F.col(x), F.col(y))
    b = boxes(spark, sf_dir)
    strokes = F.array(F.array(corner("x1", "y1"), corner("x2", "y2")), F.array(corner("x2", "y1"), corner("x1", "y2"), corner("x1", "y1")))
    key = F.concat_ws("-", "frame", "det")
    docs = b.select(key.alias("key"), "frame", "det", F.array(F.lit(200), F.lit(100)).alias("image_size"), F.when(F.col("frame") % 2 == 0, F.array("x1", "y1", "x2", "y2")).alias("yoyo_bbox_pixel"), strokes.alias("string_polylines_pixel"), F.lit("as it was").alias("notes"))
    value = "array(10D, 20D)"

    def op(name, stroke="null", index="null", point="null", points="null", value="null"):
        return F.expr(f"named_struct('op', '{name}', 'stroke', {stroke}, 'index', {index}, 'point', {point}, 'points', {points}, 'value', {value})").cast(patches.OPS[6:-1])

    kinds = [
        [op("add_stroke", index="-3", points=f"array({value}, {value})")], [op("delete_stroke", stroke="1")], [op("replace_stroke", stroke="0", points=f"array({value}, {value}, {value})")], [op("move_point", stroke="1", point="2", value=value)],
        [op("insert_point", stroke="0", point="1", value=value)], [op("delete_point", stroke="0", point="0")], [op("delete_point", stroke="1", point="1"), op("delete_point", stroke="1", point="0")], [op("add_stroke", points=f"array({value})")],
        [op("Insert_Point ", stroke="1", value=value), op("delete_stroke", stroke="5")],
    ]
    ops = F.lit(None).cast(patches.OPS)
    for k, some in enumerate(kinds):
        ops = F.when(F.col("det") % 9 == k, F.array(*some)).otherwise(ops)
    frame = F.element_at(F.array(*map(F.lit, ("", "normalized", "crop", "crop_resized", "rendered", "other"))), (F.col("frame") % 6 + 1).cast("int"))
    size = F.when(frame == "rendered", F.array(F.lit(100.0), F.lit(50.0))).otherwise(F.array(F.lit(50.0), F.lit(25.0)))
    said = b.select(key.alias("key"), frame.alias("frame"), F.array(*map(F.lit, (5.0, 7.0, 105.0, 57.0))).alias("crop"), size.alias("rendered"), F.lit(None).cast(f"struct<yoyo_bbox_pixel:array<double>,string_polylines_pixel:{patches.STROKES}>").alias("set"), ops.alias("ops"), F.lit(None).cast("string").alias("notes"), F.lit(None).cast("boolean").alias("rebuild"))
    out = patches.patched(docs, said, "key").join(docs.select("key", "frame", "det"), "key")
    total = lambda k: F.bround(F.aggregate(F.flatten("string_polylines_pixel"), F.lit(0.0), lambda s, p: s + p[k]), 3)
    return out.select(
        "frame", "det", "error", F.when(F.col("error").isNull(), F.size("string_polylines_pixel")).alias("strokes"), F.when(F.col("error").isNull(), F.size(F.flatten("string_polylines_pixel"))).alias("points"), total(0).alias("x"), total(1).alias("y"),
        F.col("string_polylines_2d")[0][0][0].alias("x_2d"), F.col("string_path.topology").alias("topology"), F.col("string_path.paths")[0]["start_anchor"].alias("start_anchor"),
    )


#: Boxes as label documents of the old schema: a box, a stroke, a path with anchors and edges.
def _old_labels(spark, sf_dir):
    corner = lambda x, y: F.array(F.col(x), F.col(y))
    edge = lambda e: F.struct(e.alias("evidence"), F.col("conf").alias("confidence"))
    points = F.array(corner("x1", "y1"), corner("x2", "y2"))
    path = F.struct(points.alias("points_pixel"), F.when(F.col("det") % 3 == 0, "left_hand").otherwise("yoyo").alias("start_anchor"), F.when(F.col("cls") == 1, "yoyo").otherwise("free").alias("end_anchor"), F.array(edge(F.when(F.col("det") % 2 == 0, "Reviewed").otherwise("propagated")), edge(F.when(F.col("cls") == 1, "temporal").otherwise("guess"))).alias("edges"))
    b = boxes(spark, sf_dir)
    box = F.when(F.col("conf") > 0.2, F.array("x1", "y1", "x2", "y2"))
    return b.select("frame", "det", F.lit("v4").alias("schema_version"), F.array(F.lit(640), F.lit(360)).alias("image_size"), F.when(F.col("det") % 4 == 0, "not_visible").otherwise("visible").alias("visibility"), box.alias("box"), F.array(points).alias("strokes"), F.struct(F.when(F.col("det") % 5 == 0, "not_visible").otherwise("open").alias("topology"), F.array(path).alias("paths")).alias("string_path"))


@query("prj_upgrade_document", f"""WITH {BOXES}, a AS (SELECT *, CASE WHEN conf > 0.2 THEN sqrt(pow(greatest(x1 - x2, 0, 0), 2)) END AS inside, greatest(8.0, 0.08 * sqrt(640.0 * 640 + 360.0 * 360)) AS near FROM boxes)
SELECT frame, det, 'v5' AS schema_version, CASE WHEN det % 4 = 0 THEN 'uncertain' ELSE 'visible' END AS visibility, CASE WHEN conf > 0.2 THEN round_even(x1 / 640 * 999, 3) END AS nx, CASE WHEN conf > 0.2 THEN round_even(y2 / 360 * 999, 3) END AS ny, round_even(x2 / 640 * 999, 3) AS sx, CASE WHEN det % 5 = 0 THEN 'uncertain' ELSE 'open' END AS topology,
  CASE WHEN det % 3 = 0 OR conf <= 0.2 THEN 'unknown' ELSE 'yoyo' END AS start_anchor, CASE WHEN cls = 1 AND conf <= 0.2 THEN 'unknown' WHEN cls = 1 THEN 'yoyo' ELSE 'free' END AS end_anchor, CASE WHEN det % 2 = 0 THEN 'observed' ELSE 'temporal' END || ',' || CASE WHEN cls = 1 THEN 'temporal' ELSE 'inferred' END AS evidence FROM a""")
def prj_upgrade_document(spark, sf_dir):
    new = D.upgraded(_old_labels(spark, sf_dir), "v5", ("v4", "v5"))
    p = F.col("string_path.paths")[0]
    return new.select("frame", "det", "schema_version", "visibility", F.col("box_2d")[0].alias("nx"), F.col("box_2d")[3].alias("ny"), F.col("strokes_2d")[0][1][0].alias("sx"), F.col("string_path.topology").alias("topology"), p["start_anchor"].alias("start_anchor"), p["end_anchor"].alias("end_anchor"), F.array_join(F.transform(p["edges"], lambda e: e["evidence"]), ",").alias("evidence"))


@query("prj_normalize_document", f"""WITH {BOXES} SELECT frame, det, CASE WHEN det % 3 = 0 THEN 'not_visible' WHEN det % 3 = 1 THEN 'visible' ELSE 'uncertain' END AS string_visibility, CASE WHEN cls = 0 THEN 'not_applicable' WHEN det % 2 = 0 THEN 'horizontal' ELSE 'unknown' END AS orientation, CASE WHEN conf > 0.5 THEN round_even(x1, 3) ELSE round_even(x1 / 999 * 640, 3) END AS px, CASE WHEN conf > 0.5 THEN round_even(round_even(x1, 3) / 640 * 999, 3) ELSE round_even(round_even(x1 / 999 * 640, 3) / 640 * 999, 3) END AS nx,
  CASE WHEN det % 3 <> 0 THEN 1 END AS strokes, CASE WHEN det % 3 = 0 THEN 'blurred,string_not_visible' ELSE 'blurred' END AS bad_case FROM boxes""")
def prj_normalize_document(spark, sf_dir):
    """Candidates with values out of the lists, boxes in pixels or normalised, and strokes that an invisible string can't have."""
    said = F.when(F.col("det") % 3 == 0, "NOT_VISIBLE").when(F.col("det") % 3 == 1, "Visible").otherwise("perhaps")
    corners = F.array("x1", "y1", "x2", "y2")
    c = boxes(spark, sf_dir).select("frame", "det", said.alias("string_visibility"), F.when(F.col("cls") == 0, "non_trick").otherwise("trick").alias("scene"), F.when(F.col("det") % 2 == 0, "Horizontal").otherwise("upside").alias("orientation"), F.when(F.col("conf") > 0.5, corners).alias("box"), F.when(F.col("conf") <= 0.5, corners).alias("box_2d"), F.array(F.array(F.array("x1", "y1"), F.array("x2", "y2"))).alias("strokes"), F.array(F.lit(" blurred "), F.lit("blurred"), F.lit("")).alias("bad_case"), F.array(F.lit(640), F.lit(360)).alias("image_size"))
    n = D.normalized_candidates(c)
    return n.select("frame", "det", "string_visibility", "orientation", F.col("box")[0].alias("px"), F.col("box_2d")[0].alias("nx"), F.when(F.col("strokes").isNotNull(), F.size("strokes")).alias("strokes"), F.array_join("bad_case", ",").alias("bad_case"))


@query("prj_upgrade_v5", "SELECT event_id, CASE WHEN event_type = 'click' THEN 'observed' WHEN event_type = 'view' THEN 'temporal' ELSE 'inferred' END AS evidence, 'v5' AS schema_version FROM events")
def prj_upgrade_v5(spark, sf_dir):
    old = F.array(F.struct(F.when(F.col("event_type") == "click", "reviewed").when(F.col("event_type") == "view", "propagated").otherwise(F.col("event_type")).alias("evidence")))
    new = F.transform(old, lambda e: F.struct(F.when(e["evidence"] == "reviewed", "observed").when(e["evidence"] == "propagated", "temporal").otherwise("inferred").alias("evidence")))
    return read(spark, sf_dir, "events").select("event_id", new[0]["evidence"].alias("evidence"), F.lit("v5").alias("schema_version"))


@query("prj_normalize_candidate", f"WITH {BOXES} SELECT frame, det, CASE WHEN conf > 0.7 THEN 'visible' ELSE 'unknown' END AS visibility, CASE WHEN cls = 0 THEN 'not_applicable' ELSE 'normal' END AS orientation, CASE WHEN conf > 0.7 THEN round_even(x1 / 640 * 999, 3) END AS nx FROM boxes")
def prj_normalize_candidate(spark, sf_dir):
    said = F.when(F.col("conf") > 0.7, "visible").otherwise("nonsense")
    visibility = F.when(said.isin("visible", "partial", "not_visible"), said).otherwise("unknown")
    return boxes(spark, sf_dir).select("frame", "det", visibility.alias("visibility"), F.when(F.col("cls") == 0, "not_applicable").otherwise("normal").alias("orientation"), F.when(visibility == "visible", F.bround(F.col("x1") / 640 * 999, 3)).alias("nx"))


@query("val_groups_consecutive", f"WITH {FRAMES}, k AS (SELECT * FROM frames WHERE value > 0.5) SELECT grp, max(frame) - min(frame) + 1 = count(*) AS dense, true AS in_order, true AS unique, count(*) AS frames FROM k GROUP BY grp")
def val_groups_consecutive(spark, sf_dir):
    k = frames(spark, sf_dir).where("value > 0.5")
    found = gates.consecutive_groups(k, "grp", "event_id", "frame", "ts")
    return found.select("grp", "dense", "in_order", F.col("unique").alias("unique"), "frames")


@query("val_manifest", f"""WITH {SAMPLES}, a AS (SELECT DISTINCT source, {SPLIT} AS split FROM documents WHERE source <> 'src3' UNION SELECT 'src4', 'test'),
r AS (SELECT doc_id, source, CASE WHEN doc_id % 50 = 1 THEN 'holdout' WHEN doc_id % 40 = 2 THEN 'val' ELSE {SPLIT} END AS split, CASE WHEN doc_id % 60 = 3 THEN upper(sha) ELSE sha END AS sha FROM samples),
t AS (SELECT source FROM a GROUP BY source HAVING count(*) > 1), h AS (SELECT sha FROM r GROUP BY sha HAVING count(*) > 1)
SELECT 'group in two splits' AS problem, source AS value, count(*) AS n FROM t GROUP BY ALL
UNION ALL SELECT 'unassigned group', source, count(*) FROM r WHERE NOT EXISTS (SELECT 1 FROM a WHERE a.source = r.source) GROUP BY ALL
UNION ALL SELECT 'unknown split', split, count(*) FROM r WHERE split NOT IN ('train', 'val', 'test') GROUP BY ALL
UNION ALL SELECT 'split disagrees', source, count(*) FROM r WHERE split IN ('train', 'val', 'test') AND EXISTS (SELECT 1 FROM a WHERE a.source = r.source) AND NOT EXISTS (SELECT 1 FROM a WHERE a.source = r.source AND a.split = r.split) GROUP BY ALL
UNION ALL SELECT 'not a digest', sha, count(*) FROM r WHERE NOT regexp_full_match(sha, '[0-9a-f]{{64}}') GROUP BY ALL
UNION ALL SELECT 'digest twice', sha, count(*) FROM r JOIN h USING (sha) GROUP BY ALL
UNION ALL SELECT 'declared leakage', 'source_group_overlap_count', 2""")
def val_manifest(spark, sf_dir):
    """A manifest with faults of each kind: which rule each breaks, and how often."""
    s = samples(spark, sf_dir)
    assignment = s.where("source <> 'src3'").select("source", split_of(F.col("source")).alias("split")).distinct()
    assignment = assignment.unionByName(assignment.limit(0).unionByName(spark.range(1).select(F.lit("src4").alias("source"), F.lit("test").alias("split")))).distinct()
    split = F.when(F.col("doc_id") % 50 == 1, "holdout").when(F.col("doc_id") % 40 == 2, "val").otherwise(split_of(F.col("source")))
    records = s.select("doc_id", "source", split.alias("split"), F.when(F.col("doc_id") % 60 == 3, F.upper("sha")).otherwise(F.col("sha")).alias("sha"))
    return gates.manifest_problems(assignment, records, "source", "split", "sha", {"source_group_overlap_count": 2, "image_sha256_overlap_count": 0})


@query("doc_init_label", "SELECT doc_id, source AS source_group, 1 AS revision, 'blank' AS status FROM documents d WHERE NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id)")
def doc_init_label(spark, sf_dir):
    return D.init_labels(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"), "doc_id", {"source_group": F.col("source")})


@query("doc_apply_revision", f"WITH {FRAMES}, c AS (SELECT *, lag(event_type) OVER (PARTITION BY grp ORDER BY frame) AS was FROM frames) SELECT grp, row_number() OVER (PARTITION BY grp ORDER BY frame) AS revision, event_type FROM c WHERE was IS NULL OR was <> event_type")
def doc_apply_revision(spark, sf_dir):
    e = frames(spark, sf_dir)
    history = e.where("frame = 0").select("grp", F.lit(1).cast("long").alias("revision"), "event_type")
    changes = e.where("frame > 0").select("grp", "event_type", F.col("frame").alias("seq"))
    return D.apply_revisions(history, changes, "grp", "event_type")


@query("doc_review_fsm", f"WITH {SAMPLES} SELECT doc_id, CASE WHEN quality IS NULL THEN 'needs-review' WHEN toxic = 1 THEN 'rejected' WHEN quality = 0 THEN 'unresolved' WHEN n_chars < 300 THEN 'invalid' WHEN doc_id % 3 >= 2 THEN 'approved' ELSE 'needs-approval' END AS status FROM samples")
def doc_review_fsm(spark, sf_dir):
    decision = F.when(F.col("quality").isNull(), "none").when(F.col("toxic") == 1, "reject").when(F.col("quality") == 0, "unresolved").otherwise("approve")
    n = F.col("doc_id") % 3
    return D.review_state(samples(spark, sf_dir), decision, F.col("n_chars") >= 300, n, n, 2).select("doc_id", "status")


@query("doc_review_upsert", "SELECT doc_id FROM labels WHERE doc_id % 5 <> 0 UNION SELECT doc_id FROM documents WHERE doc_id % 7 = 0")
def doc_review_upsert(spark, sf_dir):
    old = read(spark, sf_dir, "labels").select("doc_id", F.lit(True).alias("confirmed"), F.lit(0).alias("at"))
    gone = old.where("doc_id % 5 = 0").select("doc_id", F.lit(False).alias("confirmed"), F.lit(1).alias("at"))
    new = read(spark, sf_dir, "documents").where("doc_id % 7 = 0").select("doc_id", F.lit(True).alias("confirmed"), F.lit(2).alias("at"))
    return D.upsert_reviews(old, gone.unionByName(new), "doc_id", "at").select("doc_id")


@query("doc_import_provenance", f"""WITH {SAMPLES} SELECT doc_id, 'reviewed' AS review_status, CASE WHEN toxic = 1 THEN 'approved' ELSE 'reviewed' END AS string_review_status, CASE WHEN quality = 1 THEN 2 ELSE 1 END AS reviews, 'human-workbench' AS model, source || '/' || doc_id AS imported_from, CASE WHEN toxic = 1 THEN 'approved' ELSE 'draft' END AS was FROM samples WHERE quality IS NOT NULL""")
def doc_import_provenance(spark, sf_dir):
    """A confirmed sample's document gets one more approval, its statuses, and where all that comes from."""
    s = samples(spark, sf_dir).where("quality is not null")
    one = F.struct(F.lit("critic").alias("reviewer"), F.lit("vlm").alias("model"), F.lit("approve").alias("decision"), F.lit("2024").alias("at"))
    docs = s.select("doc_id", F.when(F.col("toxic") == 1, "approved").otherwise("draft").alias("string_review_status"), F.when(F.col("quality") == 1, F.array(one)).alias("reviews"), F.col("source").alias("dataset"), F.col("doc_id").cast("string").alias("sample"))
    out = D.imported(docs, "dataset", "sample", F.lit("anna"), F.lit("2025-01-01"))
    return out.select("doc_id", "review_status", "string_review_status", F.size("reviews").alias("reviews"), F.element_at("reviews", -1)["model"].alias("model"), F.concat_ws("/", "review_import.dataset", "review_import.sample").alias("imported_from"), F.col("review_import.original_string_status").alias("was"))


@query("doc_import_stamp", "SELECT doc_id, 'approved' AS status, CASE WHEN quality = 1 THEN 2 ELSE 1 END AS reviews FROM labels")
def doc_import_stamp(spark, sf_dir):
    one = lambda who: F.struct(F.lit(who).alias("reviewer"), F.lit("approve").alias("decision"))
    old = F.when(F.col("quality") == 1, F.array(one("critic"))).otherwise(F.array_remove(F.array(one("x")), one("x")))
    return read(spark, sf_dir, "labels").select("doc_id", F.lit("approved").alias("status"), F.size(F.array_append(old, one("import"))).alias("reviews"))


@query("doc_temporal_seed", f"""WITH {FRAMES}, l AS (SELECT grp, frame, event_type = 'error' AS lost FROM frames), c AS (SELECT *, sum(CASE WHEN lost THEN 1 ELSE 0 END) OVER (PARTITION BY grp ORDER BY frame) AS chunk FROM l)
SELECT grp, CAST(chunk AS BIGINT) AS chunk, min(frame) AS first, max(frame) AS last, count(*) AS points FROM c WHERE NOT lost GROUP BY grp, chunk HAVING count(*) >= 2""")
def doc_temporal_seed(spark, sf_dir):
    return D.temporal_chunks(frames(spark, sf_dir), "grp", "frame", F.col("event_type") == "error")


@query("doc_edge_rescore", f"WITH {BOXES} SELECT frame, det, CASE WHEN cls = 0 THEN 'inferred' WHEN det % 2 = 0 THEN 'temporal' ELSE 'inferred' END AS evidence, round_even(CASE WHEN cls = 0 THEN least(0.25, 0.5 * conf) ELSE least(0.85, 0.9 * conf) END, 6) AS confidence FROM boxes")
def doc_edge_rescore(spark, sf_dir):
    s = D.rescored_edge(F.when(F.col("det") % 2 == 0, "observed").otherwise("inferred"), F.col("conf"), F.col("cls") == 0)
    return boxes(spark, sf_dir).select("frame", "det", s["evidence"].alias("evidence"), F.bround(s["confidence"], 6).alias("confidence"))


@query("doc_export_gate", f"""WITH {SAMPLES}, c AS (SELECT DISTINCT lang FROM (SELECT lang FROM samples GROUP BY lang, sha HAVING count(DISTINCT source) > 1) WHERE lang <> 'en')
SELECT doc_id, concat_ws(',', CASE WHEN n_chars < 300 THEN 'short' END, CASE WHEN coalesce(quality, 0) = 0 THEN 'status' END, CASE WHEN toxic = 1 THEN 'audit' END, CASE WHEN lang IN (SELECT lang FROM c) THEN 'collection: image in groups' END) AS reasons,
  NOT (n_chars < 300 OR coalesce(quality, 0) = 0 OR coalesce(toxic, 0) = 1 OR lang IN (SELECT lang FROM c)) AS exported FROM samples""")
def doc_export_gate(spark, sf_dir):
    """A language is a collection: one whose images lie in several sources exports nothing; English ones are told apart by source."""
    s = samples(spark, sf_dir)
    image = F.when(F.col("lang") == "en", F.concat("sha", "source")).otherwise(F.concat("lang", "sha"))
    found = reports.collection_conflicts(s.select(image.alias("image"), "source", F.lit("").alias("video")), "image", "source", "video")
    conflicts = s.select("lang", image.alias("value")).join(found, "value", "left_semi").select("lang", F.lit("image in groups").alias("kind")).distinct()
    reasons = F.array_compact(F.array(F.when(F.col("n_chars") < 300, "short"), F.when(F.coalesce("quality", F.lit(0)) == 0, "status"), F.when(F.col("toxic") == 1, "audit")))
    out = gates.export_decisions(s, "lang", reasons, conflicts)
    return out.select("doc_id", F.array_join("reasons", ",").alias("reasons"), "exported")

@query("doc_rebase_sources", f"WITH {SAMPLES} SELECT doc_id, CASE WHEN doc_id % 7 = 0 THEN 'missing' WHEN doc_id % 5 = 0 THEN 'mismatch' ELSE 'rebased' END AS action, CASE WHEN doc_id % 7 = 0 OR doc_id % 5 = 0 THEN 'old/' ELSE 'new/' END || doc_id AS path FROM samples")
def doc_rebase_sources(spark, sf_dir):
    s = samples(spark, sf_dir)
    labels = s.select("doc_id", F.concat(F.lit("old/"), "doc_id").alias("path"), "sha", F.col("n_chars").alias("size"))
    listing = s.where("doc_id % 7 <> 0").select("doc_id", F.concat(F.lit("new/"), "doc_id").alias("path"), F.when(F.col("doc_id") % 5 == 0, "other").otherwise(F.col("sha")).alias("sha"), F.col("n_chars").alias("size"))
    return D.rebase_sources(labels, listing, "doc_id", "path").select("doc_id", "action", "path")


@query("doc_triage_cache", f"""WITH {SAMPLES} SELECT doc_id, doc_id % 2 = 0 AS cached, CASE WHEN doc_id % 7 = 0 THEN 'no_result' WHEN doc_id % 5 = 0 THEN 'already_applied' WHEN doc_id % 3 = 0 THEN 'nothing_to_apply' ELSE 'applied' END AS status,
  CASE WHEN doc_id % 7 > 0 AND doc_id % 5 > 0 AND doc_id % 3 > 0 THEN 2 ELSE 1 END AS revision, CASE WHEN doc_id % 7 > 0 AND doc_id % 5 > 0 AND doc_id % 3 > 0 THEN CASE WHEN doc_id % 2 = 0 THEN 'old' ELSE 'computed' END ELSE 'none' END AS scene, CASE WHEN doc_id % 7 > 0 THEN 'already' END AS again FROM samples""")
def doc_triage_cache(spark, sf_dir):
    """Answers from the cache or computed, applied to their labels, and applied a second time: nothing changes then."""
    s = samples(spark, sf_dir).select("doc_id", F.lit("v1").alias("prompt"))
    cache = s.where("doc_id % 2 = 0").withColumn("answer", F.lit("old")).unionByName(s.where("doc_id % 2 = 1").withColumn("prompt", F.lit("v0")).withColumn("answer", F.lit("stale")))
    answers = D.with_cache(s, cache, ["doc_id", "prompt"], "answer", F.lit("computed"))
    message = F.concat(F.lit("triage "), F.sha2(F.concat_ws("|", "doc_id", "answer"), 256))
    none = F.expr("map_filter(map('scene_label', ''), (k, v) -> false)")
    results = answers.where("doc_id % 7 <> 0").select("doc_id", F.when(F.col("doc_id") % 3 == 0, none).otherwise(F.create_map(F.lit("scene_label"), F.col("answer"))).alias("promotions"), message.alias("message"))
    said = answers.select("doc_id", "cached", message.alias("message"))
    labels = said.select("doc_id", F.lit(1).cast("long").alias("revision"), F.when(F.col("doc_id") % 5 == 0, F.array("message")).otherwise(F.array(F.lit("first"))).alias("messages"), F.create_map(F.lit("scene_label"), F.lit("none")).alias("fields"))
    once = D.applied_once(labels, results, "doc_id", F.col("message"))
    twice = D.applied_once(once.drop("apply_status"), results.withColumn("promotions", F.create_map(F.lit("scene_label"), F.lit("other"))).join(once.where("apply_status <> 'nothing_to_apply'").select("doc_id"), "doc_id", "left_semi"), "doc_id", F.col("message"))
    again = twice.select("doc_id", F.when(F.col("apply_status") == "already_applied", "already").alias("again"), F.col("fields")["scene_label"].alias("scene"), F.col("revision").cast("int").alias("revision"))
    out = once.select("doc_id", F.col("apply_status").alias("status")).join(again, "doc_id").join(said.select("doc_id", "cached"), "doc_id")
    return out.select("doc_id", "cached", "status", "revision", "scene", F.when((F.col("status") == "nothing_to_apply"), "already").otherwise(F.col("again")).alias("again"))


@query("doc_cleanup_candidates", "SELECT doc_id, 3 AS depth FROM documents WHERE doc_id % 3 = 0 AND source <> 'src1' AND doc_id <> 9")
def doc_cleanup_candidates(spark, sf_dir):
    listing = read(spark, sf_dir, "documents").select("doc_id", F.concat(F.lit("/"), "source", F.lit("/"), "doc_id", F.when(F.col("doc_id") % 3 == 0, ".TMP").otherwise(".json")).alias("path"))
    keep = [r["path"] for r in listing.where("doc_id = 9").collect()]
    return D.cleanup_candidates(listing, "path", keep, ["/src1"], [".tmp"]).select("doc_id", "depth")


@query("src_dataset_list", "SELECT source, arg_min(lang, doc_id) AS lang, count(*) AS labels FROM documents GROUP BY source")
def src_dataset_list(spark, sf_dir):
    return D.root_schema(read(spark, sf_dir, "documents"), "source", "doc_id", "lang")


@query("val_protected_state", f"WITH {SAMPLES} SELECT doc_id, CASE WHEN doc_id % 13 = 0 THEN 'untracked file' WHEN doc_id % 11 = 0 THEN 'missing file' ELSE 'hash' END AS problem FROM samples WHERE doc_id % 13 = 0 OR doc_id % 11 = 0 OR doc_id % 9 = 0")
def val_protected_state(spark, sf_dir):
    s = samples(spark, sf_dir).select("doc_id", "sha")
    listing = s.where("doc_id % 11 <> 0 or doc_id % 13 = 0").withColumn("sha", F.when(F.col("doc_id") % 9 == 0, "x").otherwise(F.col("sha")))
    return D.protected_state(s.where("doc_id % 13 <> 0"), listing, read(spark, sf_dir, "labels"), "doc_id", "sha")


@query("val_recover_source", f"""WITH {FRAMES}, e AS (SELECT grp, frame FROM frames WHERE frame % 2 = 0), l AS (SELECT grp, frame FROM frames WHERE frame % 2 = 0 AND NOT (grp % 5 = 1 AND frame = 4) UNION ALL SELECT grp, 1000000 FROM frames WHERE grp % 7 = 2 AND frame = 0),
d AS (SELECT grp FROM (SELECT * FROM e EXCEPT ALL SELECT * FROM l) UNION SELECT grp FROM (SELECT * FROM l EXCEPT ALL SELECT * FROM e)) SELECT grp, grp NOT IN (SELECT grp FROM d) AS recovered, count(*) AS expected FROM e GROUP BY grp""")
def val_recover_source(spark, sf_dir):
    """Provenance is rebuilt for the groups whose listing is exactly what is expected, no frame missing and none besides."""
    e = frames(spark, sf_dir).select("grp", "frame")
    expected = e.where("frame % 2 = 0")
    listing = expected.where("not (grp % 5 = 1 and frame = 4)").unionByName(e.where("grp % 7 = 2 and frame = 0").select("grp", F.lit(1000000).cast("long").alias("frame")))
    return D.recovered_groups(expected, listing, "grp", "frame")


@query("val_unchanged", "SELECT doc_id, lang, side AS missing_in FROM (SELECT doc_id, lang, unnest(['after', 'before']) AS side FROM documents WHERE doc_id % 100 = 0) WHERE side = 'after' UNION ALL SELECT doc_id, 'xx', 'before' FROM documents WHERE doc_id % 100 = 0")
def val_unchanged(spark, sf_dir):
    d = read(spark, sf_dir, "documents").select("doc_id", "lang")
    after = d.withColumn("lang", F.when(F.col("doc_id") % 100 == 0, "xx").otherwise(F.col("lang")))
    return D.snapshots_equal(d, after)


STAGED = """s AS (SELECT event_id, grp AS video, frame, xor(CAST('0x' || left(sha256(CAST(event_id // 3 AS VARCHAR)), 15) AS BIGINT), (1 << CAST(event_id % 3 AS INTEGER)) - 1) AS bits, sha256(CAST(event_id // 2 AS VARCHAR)) AS sha FROM frames),
r AS (SELECT * FROM s WHERE event_id % 7 = 0), n AS (SELECT * FROM s WHERE event_id % 7 <> 0), i AS (SELECT event_id, CASE WHEN event_id % 11 = 0 THEN 'x' ELSE sha END AS sha FROM n WHERE event_id % 13 <> 0)"""


@query("val_staged", f"""WITH {FRAMES}, {STAGED}
SELECT 'image missing' AS problem, count(*) AS n FROM n WHERE NOT EXISTS (SELECT 1 FROM i WHERE i.event_id = n.event_id)
UNION ALL SELECT 'hash mismatch', count(*) FROM n JOIN i USING (event_id) WHERE n.sha <> i.sha
UNION ALL SELECT 'provenance overlap', count(*) FROM n WHERE EXISTS (SELECT 1 FROM r WHERE r.video = n.video AND abs(r.frame - n.frame) <= 1)
UNION ALL SELECT 'provenance twice', 0
UNION ALL SELECT 'image overlap', count(*) FROM n WHERE EXISTS (SELECT 1 FROM r WHERE r.sha = n.sha)
UNION ALL SELECT 'image twice', count(*) FROM n WHERE sha IN (SELECT sha FROM n GROUP BY sha HAVING count(*) > 1)
UNION ALL SELECT 'near reference', count(*) FROM n WHERE EXISTS (SELECT 1 FROM r WHERE bit_count(xor(r.bits, n.bits)) <= 1)
UNION ALL SELECT 'near another', count(*) FROM n WHERE EXISTS (SELECT 1 FROM n o WHERE o.event_id <> n.event_id AND o.video <> n.video AND bit_count(xor(o.bits, n.bits)) <= 1)""")
def val_staged(spark, sf_dir):
    """How many staged samples break each rule: pairing, hash, provenance within a window, equal and near images."""
    base = F.conv(F.substring(F.sha2(F.floor(F.col("event_id") / 3).cast("string"), 256), 1, 15), 16, 10).cast("long")
    bits = base.bitwiseXOR((F.pow(F.lit(2.0), F.col("event_id") % 3) - 1).cast("long"))
    s = frames(spark, sf_dir).select("event_id", F.col("grp").alias("video"), "frame", bits.alias("bits"), F.sha2(F.floor(F.col("event_id") / 2).cast("string"), 256).alias("sha"))
    staged, reference = s.where("event_id % 7 <> 0"), s.where("event_id % 7 = 0")
    images = staged.where("event_id % 13 <> 0").select("event_id", F.when(F.col("event_id") % 11 == 0, "x").otherwise(F.col("sha")).alias("sha"))
    return gates.staged_problems(staged, images, reference, "event_id", "video", "frame", "sha", "bits", 1, 1)


@query("win_cross_source_reselect", f"""WITH RECURSIVE c AS (SELECT source, sha256(CAST(doc_id % 97 AS VARCHAR)) AS sha, min(doc_id) AS pos FROM documents GROUP BY ALL), l AS (SELECT source, list(sha ORDER BY pos, sha) AS shas, row_number() OVER (ORDER BY source) AS k FROM c GROUP BY source),
r AS (SELECT k, source, shas[1:3] AS mine, shas[1:3] AS taken FROM l WHERE k = 1 UNION ALL SELECT l.k, l.source, list_filter(shas, lambda x: NOT list_contains(taken, x))[1:3], list_concat(taken, list_filter(shas, lambda x: NOT list_contains(taken, x))[1:3]) FROM r JOIN l ON l.k = r.k + 1)
SELECT source, unnest(mine) AS sha FROM r""")
def win_cross_source_reselect(spark, sf_dir):
    """Three contents a source; what an earlier source has taken is lost to a later one, which chooses again."""
    c = read(spark, sf_dir, "documents").select("source", F.sha2((F.col("doc_id") % 97).cast("string"), 256).alias("sha"), F.col("doc_id").alias("at"))
    return dedup.accept_in_order(c, "source", "sha", "at", 3).select("source", "sha")


@query("win_cross_source_conflict", """WITH RECURSIVE o AS (SELECT doc_id, source, xor(CAST('0x' || left(sha256(CAST(doc_id % 97 AS VARCHAR)), 15) AS BIGINT), (1 << CAST(doc_id % 4 AS INTEGER)) - 1) AS v, row_number() OVER (ORDER BY source, doc_id) AS k FROM documents WHERE doc_id % 10 > 0),
f AS (SELECT xor(CAST('0x' || left(sha256(CAST(doc_id % 97 AS VARCHAR)), 15) AS BIGINT), 8) AS v FROM documents WHERE doc_id % 10 = 0 AND doc_id % 3 = 0),
c AS (SELECT doc_id, source, v, row_number() OVER (ORDER BY k) AS k FROM o WHERE NOT EXISTS (SELECT 1 FROM f WHERE bit_count(xor(f.v, o.v)) <= 1)),
r AS (SELECT 0::BIGINT AS k, NULL::VARCHAR AS source, 0 AS n, []::BIGINT[] AS taken, NULL::BIGINT AS doc_id, false AS ok
  UNION ALL SELECT k, source, n + ok::INTEGER, CASE WHEN ok THEN list_append(taken, v) ELSE taken END, doc_id, ok FROM (
    SELECT c.*, CASE WHEN r.source = c.source THEN r.n ELSE 0 END AS n, taken, (r.source IS DISTINCT FROM c.source OR r.n < 7) AND len(list_filter(taken, lambda t: bit_count(xor(t, c.v)) <= 1)) = 0 AS ok FROM r JOIN c ON c.k = r.k + 1))
SELECT doc_id, source FROM r WHERE ok""")
def win_cross_source_conflict(spark, sf_dir):
    """Seven images a source, none near one that the source, one before it or the reference has: 60-bit patterns in which
    neighbours differ by a bit, so that near isn't transitive."""
    base = F.conv(F.substring(F.sha2((F.col("doc_id") % 97).cast("string"), 256), 1, 15), 16, 10).cast("long")
    d = read(spark, sf_dir, "documents").select("doc_id", "source", base.alias("base"))
    own = d.where("doc_id % 10 > 0").withColumn("bits", F.col("base").bitwiseXOR(F.expr("shiftleft(1, int(doc_id % 4)) - 1").cast("long")))
    known = d.where("doc_id % 10 = 0 and doc_id % 3 = 0").select(F.col("base").bitwiseXOR(F.lit(8).cast("long")).alias("bits"))
    return dedup.accept_near_in_order(own, "source", "doc_id", "bits", 7, 1, known).select("doc_id", "source")


@query("flt_color_passes", f"WITH {BOXES}, m AS (SELECT frame, det, conf >= 0.6 AND cls = 1 AS f, det % 4 <> 0 AND conf >= 0.3 AND y1 / 40 >= 0.25 AS s FROM boxes) SELECT frame, list(det ORDER BY det) AS items, count(*) FILTER (WHERE NOT f) AS added FROM m WHERE f OR s GROUP BY frame")
def flt_color_passes(spark, sf_dir):
    b = boxes(spark, sf_dir)
    return dedup.second_pass_union(b, "frame", "det", (F.col("conf") >= 0.6) & (F.col("cls") == 1), F.col("conf"), F.col("y1") / 40, F.col("det") % 4 == 0, 0.3, 0.25)


@query("flt_color_union", f"""WITH {BOXES}, r AS (SELECT frame, det, row_number() OVER (PARTITION BY frame ORDER BY det) AS pass FROM boxes WHERE conf >= 0.4 AND cls = 1) SELECT frame, det FROM r WHERE pass = 1""")
def flt_color_union(spark, sf_dir):
    passed = boxes(spark, sf_dir).where("conf >= 0.4 and cls = 1").withColumn("_n", F.row_number().over(W.partitionBy("frame").orderBy("det")))
    return passed.where("_n = 1").select("frame", "det")


@query("prj_polyline_round_trip", f"WITH {BOXES} SELECT frame, det, round_even(x1, 3) AS x FROM boxes")
def prj_polyline_round_trip(spark, sf_dir):
    lit = lambda *v: F.array(*[F.lit(float(x)) for x in v])
    p = G.coordinate_transform(F.array(F.array("x1", "y1")), F.lit("original"), F.lit(640), F.lit(360), lit(0, 0, 1, 1), lit(1, 1))
    return boxes(spark, sf_dir).select("frame", "det", p[0][0].alias("x"))


# streams


@query("st_tumbling", "SELECT time_bucket(INTERVAL 1 DAY, ts) AS start, event_type, count(*) AS n, round_even(sum(value), 4) AS total FROM events GROUP BY ALL")
def st_tumbling(spark, sf_dir):
    out = windows.tumbling(windows.event_time(read(spark, sf_dir, "events")), "1 day", "event_type")
    return out.select(F.col("start").cast("timestamp_ntz").alias("start"), "event_type", "n", F.bround("total", 4).alias("total"))


@query("st_sliding", "SELECT start, count(*) AS n FROM (SELECT unnest([time_bucket(INTERVAL 1 HOUR, ts) - INTERVAL 1 HOUR, time_bucket(INTERVAL 1 HOUR, ts)]) AS start FROM events) GROUP BY start")
def st_sliding(spark, sf_dir):
    out = windows.sliding(windows.event_time(read(spark, sf_dir, "events")), "2 hours", "1 hour")
    return out.select(F.col("start").cast("timestamp_ntz").alias("start"), "n")


@query("st_session", """WITH g AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) <= INTERVAL 2 HOUR THEN 0 ELSE 1 END AS new FROM events), s AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts) AS k FROM g)
SELECT min(ts) AS start, user_id, count(*) AS n FROM s GROUP BY user_id, k""")
def st_session(spark, sf_dir):
    out = windows.sessions(windows.event_time(read(spark, sf_dir, "events")), "2 hours", "user_id")
    return out.select(F.col("start").cast("timestamp_ntz").alias("start"), "user_id", "n")


def streamed(spark, sf_dir, prepare, label, files_a_batch=None):
    """Frames, prepared, as a file stream of the shared folder."""
    base = fresh(spark, label)
    prepare(spark, sf_dir).write.parquet(base)
    reader = spark.readStream.schema(spark.read.parquet(base).schema)
    return (reader.option("maxFilesPerTrigger", files_a_batch) if files_a_batch else reader).parquet(base)


@query("st_watermark", "SELECT time_bucket(INTERVAL 1 DAY, ts) AS start, count(*) AS n FROM events WHERE ts < (SELECT time_bucket(INTERVAL 1 DAY, max(ts) - INTERVAL 1 DAY) FROM events) GROUP BY 1")
def st_watermark(spark, sf_dir):
    """A stream closes the windows that its watermark has passed, and keeps the rest in state."""
    events = streamed(spark, sf_dir, lambda s, d: read(s, d, "events").select("ts", "value"), "events")
    out = stateful.drain(windows.tumbling(windows.event_time(events), "1 day"), "tumbling")
    return out.select(F.col("start").cast("timestamp_ntz").alias("start"), "n")


@query("st_orientation", sequences.SMOOTHED)
def st_orientation(spark, sf_dir):
    from .sequences import probabilities

    return stateful.drain(stateful.smoothed(streamed(spark, sf_dir, probabilities, "probabilities")), "smoothed")


@query("st_cadence", sequences.CADENCE)
def st_cadence(spark, sf_dir):
    from .sequences import probabilities

    return stateful.drain(stateful.cadence(streamed(spark, sf_dir, probabilities, "probabilities"), 10, 2), "cadence")


@query("st_gate_latch", sequences.Q["win_rolling_gate"][1])
def st_gate_latch(spark, sf_dir):
    rows = lambda s, d: frames(s, d).select("grp", "frame", ((F.col("event_type") == "click") & (F.col("value") > 100)).alias("accepted"), (F.col("value") / 500).alias("confidence"), (F.col("value") / 1000).alias("ratio"))
    return stateful.drain(stateful.gate_latch(streamed(spark, sf_dir, rows, "gate"), confidence_below=0.1), "gate")


@query("st_track_identity", sequences.FOLLOWED)
def st_track_identity(spark, sf_dir):
    b = boxes(spark, sf_dir).groupBy("frame").agg(F.array_sort(F.collect_list(F.struct("det", "x1", "y1", "x2", "y2", "conf", "cls"))).alias("found"))
    rows = b.join(sequences.places(spark, sf_dir), "frame", "left").select((F.col("frame") % 50).alias("grp"), "frame", "found", F.coalesce("place", F.lit(0)).alias("place"))
    return stateful.drain_in_steps(rows, F.floor(F.col("place") / stateful.STEP), stateful.track_identity, "tracks")


@query("st_frame_loop")
def st_frame_loop(spark, sf_dir):
    """The whole state of a video's loop: track, gaps, label at an adaptive cadence, the gate and the line; late frames are marked."""
    return stateful.drain_in_steps(sequences.observations(spark, sf_dir), F.floor(F.col("frame") / stateful.STEP), stateful.frame_loop, "loop")


@query("st_append_reviews", f"""WITH {FRAMES}, r AS (SELECT grp, frame, CASE WHEN frame % 7 = 0 THEN 'maybe' WHEN frame % 2 = 0 THEN 'correct' ELSE 'unresolved' END AS decision, CASE WHEN frame % 5 = 0 THEN '' ELSE 'r' || grp END AS reviewer, frame % 3 = 0 AS stale, event_type FROM frames)
SELECT grp AS run_id, frame AS frame_index, decision, reviewer, CASE WHEN decision = 'maybe' THEN 'unsupported decision' WHEN reviewer = '' THEN 'reviewer missing' WHEN stale THEN 'stale binding' ELSE '' END AS reason, 1 AS lines FROM r""")
def st_append_reviews(spark, sf_dir):
    """A stream of reviews against the galleries as they are, appended to a log by their reasons, and then replayed from a lost
    checkpoint: no line is added."""
    gallery = lambda s, d: frames(s, d).select(F.col("grp").alias("run_id"), F.sha2(F.col("grp").cast("string"), 256).alias("run_manifest_sha256"), F.col("frame").alias("frame_index"), F.sha2("event_type", 256).alias("frame_record_sha256"), F.col("frame").alias("gallery_index"), F.lit("raw").alias("view"), F.concat("frame", F.lit(".png")).alias("selected_image"))

    def said(s, d):
        digest = F.when(F.col("frame_index") % 3 == 0, F.lit("stale")).otherwise(F.col("frame_record_sha256"))
        decision = F.when(F.col("frame_index") % 7 == 0, "maybe").when(F.col("frame_index") % 2 == 0, "correct").otherwise("unresolved")
        reviewer = F.when(F.col("frame_index") % 5 == 0, "  ").otherwise(F.concat(F.lit(" r"), "run_id"))
        return gallery(s, d).withColumn("frame_record_sha256", digest).withColumns({"decision": decision, "reviewer": reviewer, "notes": F.lit(None).cast("string")})

    stream = sinks.judged_reviews(streamed(spark, sf_dir, said, "reviews", 4), gallery(spark, sf_dir)).withColumn("reason", F.coalesce("reason", F.lit("")))
    log = fresh(spark, "review-log")
    for _ in range(2):
        sinks.append_once(stream, log, fresh(spark, "review-checkpoint"), by="reason")
    found = spark.read.schema("review_id string, run_id long, frame_index long, decision string, reviewer string, reason string").json(log)
    rows = found.withColumn("reason", F.coalesce(F.nullif("reason", F.lit("__HIVE_DEFAULT_PARTITION__")), F.lit("")))
    return rows.groupBy("review_id", "run_id", "frame_index", "decision", "reviewer", "reason").agg(F.count(F.lit(1)).cast("int").alias("lines")).drop("review_id")
