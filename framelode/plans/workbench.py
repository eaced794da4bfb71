"""Queries of what a workbench saves: corrected labels and score documents."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..operators import workbench as WB
from .documents import fresh
from .tables import BOXES, boxes, read

Q: dict = {}


def query(name: str, sql: str | None = None):
    def add(f):
        Q[name] = (f, sql)
        return f

    return add


def pick(index: F.Column, *values) -> F.Column:
    """The value at an index modulo their number."""
    return F.element_at(F.array(*[F.lit(v) for v in values]), (index % len(values) + 1).cast("int"))


#: Every second box is edited; edits are wrong in all ways that there are.
EDITS = f"""{BOXES}, k AS (SELECT *, frame * 100 + det AS key, CASE WHEN frame % 7 = 6 THEN 'gone' WHEN frame % 7 = 5 THEN '' WHEN frame % 7 = 4 THEN 'absent' ELSE 'visible' END AS given,
  ['normal', 'horizontal', 'not_applicable', '', 'normal', 'normal', 'normal', 'normal'][frame % 8 + 1] AS trick, ['visible', 'partial', 'not_visible', 'uncertain', 'bad'][frame % 5 + 1] AS string, CASE WHEN frame % 9 = 0 THEN 'done' WHEN frame % 9 = 1 THEN '' ELSE 'approved' END AS status FROM boxes WHERE det % 2 = 0),
e AS (SELECT *, CASE WHEN given = '' THEN 'uncertain' ELSE given END AS yoyo, conf >= 0.2 AS boxed, det % 4 = 0 AS lined FROM k),
w AS (SELECT *, CASE WHEN key % 97 = 0 THEN 'no label' WHEN frame % 61 = 0 THEN 'image size' WHEN yoyo = 'gone' THEN 'yoyo visibility' WHEN trick = '' THEN 'trick orientation' WHEN string = 'bad' THEN 'string visibility' WHEN status = 'done' THEN 'string review status'
  WHEN boxed AND x2 > 100 THEN 'yoyo box' WHEN lined AND x2 > 100 THEN 'string points' WHEN yoyo = 'visible' AND NOT boxed THEN 'visible yoyo without box' WHEN string IN ('visible', 'partial') AND NOT lined THEN 'visible string without line' END AS error FROM e)"""
TIED = "sqrt(pow(greatest(greatest(x1 - {x}, 0), {x} - x2), 2) + pow(greatest(greatest(y1 - {y}, 0), {y} - y2), 2)) <= greatest(8, sqrt(100 * 100 + 200 * 200) * 0.08)"


@query("doc_workbench_edit", f"""WITH {EDITS}, o AS (SELECT *, boxed AND yoyo <> 'absent' AS kept, lined AND string <> 'not_visible' AS drawn FROM w)
SELECT key, error, CASE WHEN error IS NULL THEN yoyo END AS visibility, CASE WHEN error IS NULL THEN CASE WHEN status = '' THEN 'unresolved' ELSE status END END AS review_status, CASE WHEN error IS NULL AND kept THEN round_even(x2 / 100 * 999, 3) END AS right_2d,
  CASE WHEN error IS NULL THEN drawn::INTEGER END AS lines, CASE WHEN error IS NULL AND drawn THEN round_even(y2 / 200 * 999, 3) END AS end_2d, CASE WHEN error IS NULL AND drawn THEN CASE WHEN key % 3 = 0 THEN 'old' ELSE 'workbench-line-1' END END AS path_id,
  CASE WHEN error IS NULL AND drawn THEN CASE WHEN key % 3 = 0 AND kept AND {TIED.format(x="(x1 / 2)", y="y1")} THEN 'yoyo' ELSE 'unknown' END END AS start_anchor, CASE WHEN error IS NULL AND drawn THEN 'unknown' END AS end_anchor,
  CASE WHEN error IS NULL THEN CASE WHEN drawn THEN 'open' ELSE 'uncertain' END END AS topology, CASE WHEN error IS NULL THEN CASE WHEN det % 3 = 0 THEN 'anna' ELSE 'workbench-reviewer' END END AS actor, error IS NULL AS logged, error IS NULL AND frame % 2 = 0 AS drops_review FROM o""")
def doc_workbench_edit(spark, sf_dir):
    """Corrections of every second box's label: what is wrong with them, or label, log and void review together."""
    b = boxes(spark, sf_dir).withColumn("key", F.col("frame") * 100 + F.col("det"))
    f = F.col("frame")
    one = F.struct(F.lit("old").alias("path_id"), F.lit("yoyo").alias("start_anchor"), F.lit("left").alias("end_anchor"))
    labels = b.where("key % 97 <> 0").select("key", F.when(f % 61 == 0, F.array(F.lit(0), F.lit(200))).otherwise(F.array(F.lit(100), F.lit(200))).alias("image_size"), F.when(F.col("key") % 3 == 0, F.array(one)).otherwise(F.slice(F.array(one), 1, 0)).alias("paths"), F.lit("open").alias("topology"), F.lit("partial").alias("reconstruction_status"), "conf")
    line = F.array(F.array(F.col("x1") / 2, F.col("y1")), F.array("x2", "y2"))
    lined = F.col("det") % 4 == 0
    edits = b.where("det % 2 = 0").select(
        "key", F.when(f % 7 == 6, "gone").when(f % 7 == 5, "").when(f % 7 == 4, "absent").otherwise("visible").alias("yoyo_visibility"), pick(f, "normal", "horizontal", "not_applicable", "", "normal", "normal", "normal", "normal").alias("trick_orientation"),
        pick(f, "visible", "partial", "not_visible", "uncertain", "bad").alias("string_visibility"), F.when(f % 9 == 0, "done").when(f % 9 == 1, "").otherwise("approved").alias("string_review_status"), F.when(F.col("conf") >= 0.2, F.array("x2", "y1", "x1", "y2")).alias("yoyo_bbox_pixel"),
        F.when(lined, F.array(line, F.slice(line, 1, 1))).alias("string_polylines_pixel"), F.lit(None).cast("string").alias("bbox_review_status"), F.lit(" moved ").alias("notes"), F.when(F.col("det") % 3 == 0, "anna ").otherwise("  ").alias("reviewer"),
    )
    c = WB.edit_changes(labels, edits, labels.where("key div 100 % 2 = 0").select("key"), "key", F.lit("2025-01-01"))
    path = F.get("label.paths", F.lit(0))
    return c.select(
        "key", "error", "label.visibility", F.col("label.string_review_status").alias("review_status"), F.col("label.yoyo_bbox_2d")[2].alias("right_2d"), F.when(F.col("error").isNull(), F.size("label.string_polylines_pixel")).alias("lines"), F.get("label.string_polyline_2d", F.lit(1))[1].alias("end_2d"),
        path["path_id"].alias("path_id"), path["start_anchor"].alias("start_anchor"), path["end_anchor"].alias("end_anchor"), "label.topology", "log.actor", (F.length("log.before_sha256") == 64).alias("_l"), "drops_review",
    ).withColumn("logged", F.coalesce("_l", F.lit(False))).drop("_l")


VERSION = "score_v2"
#: Orders as score documents, their lines as events, excluded intervals, scenes and serves, each with faults of its own.
LINES = "li AS (SELECT l_orderkey AS k, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS n, CAST(l_quantity AS INTEGER) AS q, l_partkey AS p, l_suppkey AS s FROM lineitem)"
ERRORS = f"""{LINES}, t AS (SELECT *, n - CASE WHEN s % 11 = 0 THEN 1.5 ELSE 0.5 END AS a, CASE WHEN p % 29 <> 0 THEN n - CASE WHEN s % 11 = 0 THEN 1.5 ELSE 0.5 END + (s % 7 - 1) * 0.25 END AS m FROM li),
found AS (
  SELECT k, 1 AS part, 0 AS i, unnest(list_filter([CASE WHEN k % 31 = 0 THEN 'schema_version' END, CASE WHEN k % 6 = 5 THEN 'division' END, CASE WHEN k % 37 = 0 THEN 'judge' END, CASE WHEN k % 41 = 0 OR k % 43 = 0 OR k % 47 = 0 THEN 'source_path' END], lambda x: x IS NOT NULL)) AS rule FROM (SELECT o_orderkey AS k FROM orders)
  UNION ALL SELECT k, 2, n, 'events[' || (n - 1) || '].' || CASE WHEN n % 4 = 0 AND q % 13 - 2 < 0 THEN 'positive' WHEN n % 4 = 1 AND q % 12 NOT BETWEEN 1 AND 10 THEN 'negative' WHEN n % 4 = 2 AND p % 4 > 1 THEN 'penalty' WHEN n % 4 = 3 THEN 'family' WHEN m IS NULL THEN 'timing' WHEN a < 0 OR m < a OR m > a + 1 THEN 'order' WHEN s % 17 = 0 THEN 'anchor_source' END FROM t
  UNION ALL SELECT k, 3, n, 'excluded_intervals[' || (n // 3 - 1) || '].' || CASE WHEN q % 3 = 0 THEN 'order' WHEN p % 5 = 4 THEN 'reason' WHEN s % 13 = 0 THEN 'training_eligible' END FROM li WHERE n % 3 = 0
  UNION ALL SELECT k, 4, 0, 'scene_intervals' FROM (SELECT o_orderkey AS k FROM orders) WHERE k % 53 = 0
  UNION ALL SELECT k, 4, n, 'scene_intervals[' || ((n - 1) // 3) || '].' || CASE WHEN q % 19 = 0 THEN 'timing' WHEN s % 3 = 0 THEN 'scene_type' END FROM li WHERE n % 3 = 1 AND k % 53 <> 0
  UNION ALL SELECT k, 5, n, 'serve_receive_events[' || (n // 3) || '].' || CASE WHEN p % 7 = 0 OR s % 5 = 0 THEN 'marker' WHEN m IS NULL THEN 'timing' WHEN a < 0 OR m < a OR m > a + 1 THEN 'order' WHEN p % 11 = 0 THEN 'frames' END FROM t WHERE n % 3 = 2)"""


def score_documents(spark, sf_dir):
    order = W.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice")
    li = read(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("k"), F.row_number().over(order).alias("n"), F.col("l_quantity").cast("int").alias("q"), F.col("l_partkey").alias("p"), F.col("l_suppkey").alias("s"))
    n, q, p, s = (F.col(c) for c in "nqps")
    start = (n - F.when(s % 11 == 0, 1.5).otherwise(0.5)).alias("start")
    anchor = F.when(p % 29 != 0, start + (s % 7 - 1) * 0.25).alias("anchor")
    end = (start + 1).alias("end")
    delta = F.when(n % 4 == 0, q % 13 - 2).when(n % 4 == 1, -(q % 12)).otherwise(pick(p, -1, -3, -4, -1)).cast("int")
    kind = F.when(n % 4 == 2, pick(p, "restart", "discard", "disassembly", "none"))
    event = F.struct(pick(n, "positive", "negative", "major_penalty", "odd").alias("family"), delta.alias("score_delta"), kind.alias("penalty_type"), start, anchor, end, F.when(s % 17 == 0, "auto").otherwise("manual").alias("anchor_source"))
    excluded = F.struct(n.cast("double").alias("start"), (n + q % 3).cast("double").alias("end"), pick(p, *WB.EXCLUSION_REASONS, "weather").alias("reason"), (s % 13 == 0).alias("training_eligible"))
    scene = F.struct((n - 1).cast("double").alias("start"), F.when(q % 19 != 0, n.cast("double")).alias("end"), pick(s, "x", *WB.SCENE_TYPES).alias("scene_type"))
    frame = F.when(p % 11 != 0, n).cast("int")
    serve = F.struct(F.when(p % 7 == 0, "other").otherwise("serve_receive").alias("track"), F.when(s % 5 == 0, "mid").when(q % 2 == 0, "begin").otherwise("end").alias("type"), start, anchor, end, frame.alias("anchor_frame"), n.alias("start_frame"), n.alias("end_frame"))
    listed = lambda of, name, where=None: F.transform(F.array_sort(F.collect_list(F.struct("n", (F.when(where, of) if where is not None else of).alias("e")))), lambda x: x["e"]).alias(name)
    parts = li.groupBy("k").agg(listed(event, "events"), *[F.array_compact(listed(of, name, n % 3 == k)).alias(name) for of, name, k in ((excluded, "excluded_intervals", 0), (scene, "scene_intervals", 1), (serve, "serve_receive_events", 2))])
    k = F.col("o_orderkey")
    docs = read(spark, sf_dir, "orders").select("o_orderkey", "o_custkey").join(parts, k == F.col("k"), "left")
    path = F.when(k % 41 == 0, "videos/../x.mp4").when(k % 43 == 0, "/videos/a.mp4").when(k % 47 == 0, "other/a.mp4").otherwise("videos/a.mp4")
    empty = lambda c: F.coalesce(c, F.array())
    return docs.select(
        "o_orderkey", F.when(k % 31 == 0, "score_v1").otherwise(VERSION).alias("schema_version"), pick(k, "1A", "2A", "3A", "4A", "5A", "6A").alias("division"), F.when(k % 37 == 0, " ").otherwise("anna").alias("judge"), path.alias("source_path"),
        F.concat(F.lit("dir/Final: "), k.cast("string"), F.lit(".v2.mp4")).alias("file_name"), F.concat(F.lit("c"), "o_custkey").alias("browser_identity"), F.lit("2025").alias("updated_at"),
        *[empty(F.col(c)).alias(c) for c in ("events", "excluded_intervals")], F.when(k % 53 != 0, empty(F.col("scene_intervals"))).alias("scene_intervals"), empty(F.col("serve_receive_events")).alias("serve_receive_events"),
    )


@query("val_score_annotation", f"WITH {ERRORS} SELECT o_orderkey, coalesce(string_agg(rule, ',' ORDER BY part, i, rule_order), '') AS errors FROM orders LEFT JOIN (SELECT *, CASE rule WHEN 'schema_version' THEN 1 WHEN 'division' THEN 2 WHEN 'judge' THEN 3 ELSE 4 END AS rule_order FROM found WHERE rule IS NOT NULL) ON k = o_orderkey GROUP BY o_orderkey")
def val_score_annotation(spark, sf_dir):
    return WB.score_errors(score_documents(spark, sf_dir), VERSION).select("o_orderkey", F.array_join("errors", ",").alias("errors"))


@query("doc_score_crud", f"""WITH {ERRORS}, sound AS (SELECT o_orderkey AS k, o_custkey AS c, 'Final_' || o_orderkey || '.v2_' || left(sha256('c' || o_custkey), 16) || '.json' AS storage_key FROM orders WHERE o_orderkey NOT IN (SELECT k FROM found WHERE rule IS NOT NULL)),
live AS (SELECT c, storage_key, CASE WHEN k % 10 = 0 THEN 3 ELSE 1 END AS version FROM sound WHERE k % 5 <> 1)
SELECT 'c' || c_custkey AS browser_identity, max(storage_key) AS storage_key, CAST(arg_max(version, storage_key) AS BIGINT) AS version FROM customer LEFT JOIN live ON c = c_custkey GROUP BY c_custkey""")
def doc_score_crud(spark, sf_dir):
    """Save, delete, compact, save some again, and load by the customer's identity."""
    docs, base = score_documents(spark, sf_dir), fresh(spark, "scores")
    WB.save_scores(docs, base, 1, VERSION)
    gone = docs.where("o_orderkey % 5 = 1").select(WB.score_key(F.col("file_name"), F.col("browser_identity")).alias("storage_key"))
    WB.delete_scores(gone, base, 2)
    WB.compact_scores(spark, base)
    WB.save_scores(docs.where("o_orderkey % 10 = 0").withColumn("updated_at", F.lit("2026")), base, 3, VERSION)
    wanted = read(spark, sf_dir, "customer").select(F.concat(F.lit("c"), "c_custkey").alias("browser_identity"))
    return WB.load_scores(WB.live_scores(spark, base, compacted=True), wanted).select("browser_identity", "storage_key", "version")
