"""Queries of row-level operators and functions."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions import geometry as G
from ..functions import raster as R
from ..functions import scalars as S
from ..functions import tables as TF
from ..operators import gates, reports
from .tables import BOXES, SAMPLES, box, boxes, read, samples

Q: dict = {}


def query(name: str, sql: str | None = None):
    def add(f):
        Q[name] = (f, sql)
        return f

    return add


def pairs(spark, sf_dir):
    """Boxes of a frame with the next one: columns a and b."""
    b = boxes(spark, sf_dir).withColumn("a", box())
    return b.withColumn("b", F.lead("a").over(W.partitionBy("frame").orderBy("det"))).where("b is not null")


PAIRS = f"{BOXES}, pairs AS (SELECT p.*, q.x1 AS u1, q.y1 AS v1, q.x2 AS u2, q.y2 AS v2 FROM boxes p JOIN boxes q ON p.frame = q.frame AND q.det = p.det + 1)"
IOU = "greatest(0, least(x2, u2) - greatest(x1, u1)) * greatest(0, least(y2, v2) - greatest(y1, v1))"
IOU = f"({IOU}) / ((x2 - x1) * (y2 - y1) + (u2 - u1) * (v2 - v1) - ({IOU}))"


@query("fn_bbox_iou", f"WITH {PAIRS} SELECT frame, det, round_even({IOU}, 6) AS iou FROM pairs")
def fn_bbox_iou(spark, sf_dir):
    return pairs(spark, sf_dir).select("frame", "det", F.bround(G.bbox_iou(F.col("a"), F.col("b")), 6).alias("iou"))


@query("fn_bbox_center", f"WITH {BOXES} SELECT frame, det, (x1 + x2) / 2 AS cx, (y1 + y2) / 2 AS cy FROM boxes")
def fn_bbox_center(spark, sf_dir):
    c = G.bbox_center(box())
    return boxes(spark, sf_dir).select("frame", "det", c[0].alias("cx"), c[1].alias("cy"))


@query("fn_point_box_distance", f"WITH {PAIRS} SELECT frame, det, round_even(sqrt(pow(greatest(x1 - (u1 + u2) / 2, 0, (u1 + u2) / 2 - x2), 2) + pow(greatest(y1 - (v1 + v2) / 2, 0, (v1 + v2) / 2 - y2), 2)), 6) AS far FROM pairs")
def fn_point_box_distance(spark, sf_dir):
    return pairs(spark, sf_dir).select("frame", "det", F.bround(G.point_box_distance(G.bbox_center(F.col("b")), F.col("a")), 6).alias("far"))


@query("fn_path_anchor", f"WITH {PAIRS}, d AS (SELECT frame, det, sqrt(pow(greatest(x1 - u1, 0, u1 - x2), 2) + pow(greatest(y1 - v1, 0, v1 - y2), 2)) AS far, greatest(8.0, 0.06 * sqrt((x2 - x1) * (x2 - x1) + (y2 - y1) * (y2 - y1))) AS near FROM pairs) SELECT frame, det, CASE WHEN far <= near THEN 'yoyo' ELSE 'unknown' END AS anchor FROM d")
def fn_path_anchor(spark, sf_dir):
    b = F.col("b")
    return pairs(spark, sf_dir).select("frame", "det", G.path_anchor(F.array(b[0], b[1]), F.col("a")).alias("anchor"))


@query("fn_point_segment", f"""WITH {PAIRS}, s AS (SELECT frame, det, (u1 + u2) / 2 AS px, v1 AS py, x1, y1, x2 - x1 AS dx, y2 - y1 AS dy FROM pairs),
t AS (SELECT *, greatest(0.0, least(1.0, ((px - x1) * dx + (py - y1) * dy) / (dx * dx + dy * dy))) AS t FROM s)
SELECT frame, det, round_even(sqrt(pow(px - (x1 + t * dx), 2) + pow(py - (y1 + t * dy), 2)), 6) AS far FROM t""")
def fn_point_segment(spark, sf_dir):
    a, b = F.col("a"), F.col("b")
    far = G.point_segment_distance(F.array((b[0] + b[2]) / 2, b[1]), F.array(a[0], a[1]), F.array(a[2], a[3]))
    return pairs(spark, sf_dir).select("frame", "det", F.bround(far, 6).alias("far"))


@query("prj_bbox_yolo_line", f"""WITH {BOXES}, c AS (SELECT frame, det, greatest(0, least(x1, 64)) AS a1, greatest(0, least(y1, 64)) AS b1, greatest(0, least(x2, 64)) AS a2, greatest(0, least(y2, 64)) AS b2 FROM boxes)
SELECT frame, det, CASE WHEN a2 > a1 AND b2 > b1 THEN printf('0 %.6f %.6f %.6f %.6f', (a1 + a2) / 2 / 64, (b1 + b2) / 2 / 64, (a2 - a1) / 64, (b2 - b1) / 64) ELSE '' END AS line FROM c""")
def prj_bbox_yolo_line(spark, sf_dir):
    return boxes(spark, sf_dir).select("frame", "det", G.bbox_yolo_line(box(), F.lit(64.0), F.lit(64.0)).alias("line"))


@query("prj_crop_box", f"""WITH {BOXES}, s AS (SELECT *, least(360.0, greatest(3 * greatest(x2 - x1, y2 - y1), 0.12 * 360.0)) AS side FROM boxes),
p AS (SELECT frame, det, side, greatest(0.0, least((x1 + x2) / 2 - side / 2, 640.0 - side)) AS x, greatest(0.0, least((y1 + y2) / 2 - side / 2, 360.0 - side)) AS y FROM s)
SELECT frame, det, CAST(round_even(x, 0) AS INTEGER) AS cx1, CAST(round_even(y, 0) AS INTEGER) AS cy1, CAST(round_even(x + side, 0) AS INTEGER) AS cx2, CAST(round_even(y + side, 0) AS INTEGER) AS cy2 FROM p""")
def prj_crop_box(spark, sf_dir):
    c = boxes(spark, sf_dir).withColumn("c", G.crop_box(box(), F.lit(640.0), F.lit(360.0)))
    return c.select("frame", "det", *[F.col("c")[i].alias(n) for i, n in enumerate(("cx1", "cy1", "cx2", "cy2"))])


def polylines(spark, sf_dir):
    """One polyline a frame through the corners of its boxes in order."""
    p = F.transform(F.array_sort(F.collect_list(F.struct("det", "x1", "y1"))), lambda s: F.array(s["x1"], s["y1"]))
    return boxes(spark, sf_dir).groupBy("frame").agg(p.alias("line"))


@query("fn_polyline_length", f"WITH {PAIRS} SELECT b.frame, round_even(coalesce(sum(sqrt(pow(u1 - b.x1, 2) + pow(v1 - b.y1, 2))), 0.0), 6) AS length FROM (SELECT DISTINCT frame FROM boxes) f JOIN boxes b USING (frame) LEFT JOIN (SELECT frame, det, u1, v1 FROM pairs) p ON p.frame = b.frame AND p.det = b.det GROUP BY b.frame")
def fn_polyline_length(spark, sf_dir):
    return polylines(spark, sf_dir).select("frame", F.bround(G.polyline_length(F.col("line")), 6).alias("length"))


@query("fn_polygon_area", f"""WITH {BOXES}, n AS (SELECT frame, x1, y1, coalesce(lead(x1) OVER w, first_value(x1) OVER w) AS u, coalesce(lead(y1) OVER w, first_value(y1) OVER w) AS v FROM boxes WINDOW w AS (PARTITION BY frame ORDER BY det))
SELECT frame, abs(sum(x1 * v - u * y1)) / 2 AS area FROM n GROUP BY frame""")
def fn_polygon_area(spark, sf_dir):
    return polylines(spark, sf_dir).select("frame", G.polygon_area(F.col("line")).alias("area"))


@query("prj_polygon_axis", f"""WITH {BOXES}, m AS (SELECT frame, avg(x1) AS mx, avg(y1) AS my FROM boxes GROUP BY frame),
a AS (SELECT frame, mx, my, 0.5 * atan2(2 * sum((x1 - mx) * (y1 - my)), sum((x1 - mx) * (x1 - mx)) - sum((y1 - my) * (y1 - my))) AS t FROM boxes JOIN m USING (frame) GROUP BY frame, mx, my)
SELECT frame, round_even(max((x1 - mx) * cos(t) + (y1 - my) * sin(t)) - min((x1 - mx) * cos(t) + (y1 - my) * sin(t)), 6) AS extent FROM boxes JOIN a USING (frame) GROUP BY frame""")
def prj_polygon_axis(spark, sf_dir):
    axis = polylines(spark, sf_dir).withColumn("axis", G.polygon_axis(F.col("line")))
    return axis.select("frame", F.bround(G.distance(F.col("axis")[0], F.col("axis")[1]), 6).alias("extent"))


@query("fn_nearest", f"WITH {BOXES} SELECT a.frame, a.det, round_even(min(sqrt(pow(a.x1 - b.x2, 2) + pow(a.y1 - b.y2, 2))), 6) AS nearest FROM boxes a JOIN boxes b ON a.frame = b.frame GROUP BY a.frame, a.det")
def fn_nearest(spark, sf_dir):
    b = boxes(spark, sf_dir)
    w = W.partitionBy("frame")
    ends = b.withColumn("ends", F.collect_list(F.array("x2", "y2")).over(w))
    return ends.select("frame", "det", F.bround(G.nearest_distances(F.array(F.array("x1", "y1")), F.col("ends"))[0], 6).alias("nearest"))


@query("prj_coordinate_transform", f"""WITH {BOXES}, f AS (SELECT *, det % 3 AS kind FROM boxes)
SELECT frame, det, CASE kind WHEN 0 THEN round_even(x1 * (1919.0 / 999.0), 3) WHEN 1 THEN round_even(x1 + 100, 3) ELSE round_even(x1 * (400.0 / 200.0) + 100, 3) END AS x,
  CASE kind WHEN 0 THEN round_even(y1 * (1079.0 / 999.0), 3) WHEN 1 THEN round_even(y1 + 50, 3) ELSE round_even(y1 * (300.0 / 100.0) + 50, 3) END AS y FROM f""")
def prj_coordinate_transform(spark, sf_dir):
    kind = F.element_at(F.array(F.lit("normalized"), F.lit("crop"), F.lit("crop_resized")), (F.col("det") % 3 + 1).cast("int"))
    lit = lambda *v: F.array(*[F.lit(float(x)) for x in v])
    p = G.coordinate_transform(F.array(F.array("x1", "y1")), kind, F.lit(1920), F.lit(1080), lit(100, 50, 500, 350), lit(200, 100))
    return boxes(spark, sf_dir).withColumn("p", p).select("frame", "det", F.col("p")[0][0].alias("x"), F.col("p")[0][1].alias("y"))


@query("fn_polyline_sample")
def fn_polyline_sample(spark, sf_dir):
    lines = polylines(spark, sf_dir).withColumn("s", G.sample_polylines(F.array("line"), 4.0))
    return lines.select("frame", F.size("s").alias("samples"), F.bround(G.polyline_length(F.col("s")), 3).alias("length"))


@query("fn_polyline_points", f"""WITH {BOXES}, l AS (SELECT frame, det, x1, y1, sqrt(pow(x1 - lag(x1) OVER w, 2) + pow(y1 - lag(y1) OVER w, 2)) AS step FROM boxes WINDOW w AS (PARTITION BY frame ORDER BY det)),
t AS (SELECT frame, coalesce(sum(step), 0) AS total, arg_min(x1, det) AS x_first, arg_min(y1, det) AS y_first, arg_max(x1, det) AS x_last, arg_max(y1, det) AS y_last FROM l GROUP BY frame)
SELECT frame, CASE WHEN total > 1e-6 THEN greatest(2, CAST(ceil(total / 4.0) AS BIGINT) + 1) ELSE 1 END AS samples, x_first, y_first, CASE WHEN total > 1e-6 THEN x_last ELSE x_first END AS x_last, CASE WHEN total > 1e-6 THEN y_last ELSE y_first END AS y_last, true AS even FROM t""")
def fn_polyline_points(spark, sf_dir):
    """The samples of fn_polyline_sample one row each, by a table function and in double precision; here how many a line has, its
    ends, and that no two that follow each other are further apart than the spacing."""
    lines = polylines(spark, sf_dir).select(F.col("frame").alias("id"), F.array("line").alias("lines"), F.lit(4.0).alias("spacing"))
    w = W.partitionBy("id").orderBy("place")
    points = TF.polyline_samples(lines, double=True).withColumn("_far", F.hypot(F.col("x") - F.lag("x").over(w), F.col("y") - F.lag("y").over(w)))
    first, last = (lambda c: F.min_by(c, "place").alias(f"{c}_first")), (lambda c: F.max_by(c, "place").alias(f"{c}_last"))
    found = points.groupBy(F.col("id").alias("frame")).agg(F.count(F.lit(1)).alias("samples"), first("x"), first("y"), last("x"), last("y"), F.coalesce(F.max("_far") <= 4.001, F.lit(True)).alias("even"))
    return found.select("frame", "samples", "x_first", "y_first", "x_last", "y_last", "even")


@query("fn_centerline_metrics")
def fn_centerline_metrics(spark, sf_dir):
    moved = F.transform("line", lambda p: F.array(p[0] + 3, p[1]))
    m = polylines(spark, sf_dir).select("frame", G.centerline_metrics(F.array("line"), F.array(moved)).alias("m"))
    return m.select("frame", "m.target_samples", "m.prediction_samples", "m.chamfer", "m.hd95", F.col("m.tolerances")[1]["f1"].alias("f1_at_4"))


@query("fn_cosine_distance", """WITH u AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS e FROM embeddings), z AS (SELECT a.vec_id, a.e, b.e AS f FROM u a JOIN u b ON b.vec_id = a.vec_id + 1)
SELECT vec_id, round_even(1 - greatest(-1.0, least(1.0, list_dot_product(e, f))), 5) AS far FROM z""")
def fn_cosine_distance(spark, sf_dir):
    e = read(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    n = e.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("other"))
    return e.join(n, "vec_id").select("vec_id", F.bround(S.cosine_distance(F.col("embedding"), F.col("other")), 5).alias("far"))


@query("fn_hamming", "SELECT event_id, CAST(bit_count(xor(event_id * 2654435761, user_id * 40503)) AS BIGINT) AS bits FROM events")
def fn_hamming(spark, sf_dir):
    e = read(spark, sf_dir, "events")
    return e.select("event_id", S.hamming(F.col("event_id") * 2654435761, F.col("user_id") * 40503).cast("long").alias("bits"))


@query("fn_dhash", """WITH g AS (SELECT vec_id, list_concat(embedding, embedding[1:8]) AS e FROM embeddings WHERE len(embedding) = 64)
SELECT vec_id, CAST(list_sum(list_transform(range(64), lambda i: CASE WHEN e[i // 8 * 9 + i % 8 + 2] > e[i // 8 * 9 + i % 8 + 1] THEN 1 ELSE 0 END)) AS BIGINT) AS set_bits FROM g""")
def fn_dhash(spark, sf_dir):
    gray = F.concat(F.col("embedding"), F.slice("embedding", 1, 8))
    return read(spark, sf_dir, "embeddings").where("size(embedding) = 64").select("vec_id", F.bit_count(S.difference_hash(gray)).cast("long").alias("set_bits"))


LOGIT = "ln(greatest(1e-5, least(1 - 1e-5, {0})) / (1 - greatest(1e-5, least(1 - 1e-5, {0}))))"


@query("fn_logit_fuse", f"SELECT event_id, round_even(1 / (1 + exp(-(0.7 * ({LOGIT.format('value / 500')} - ln(0.3985 / 0.6015)) + 0.3 * ({LOGIT.format('(event_id % 100) / 100.0')} - 0)))), 6) AS p FROM events")
def fn_logit_fuse(spark, sf_dir):
    p = S.logit_fuse(F.col("value") / 500, (F.col("event_id") % 100) / 100.0, 0.3, 0.3985, 0.5)
    return read(spark, sf_dir, "events").select("event_id", F.bround(p, 6).alias("p"))


@query("fn_scalar_confidence", "SELECT event_id, CASE WHEN event_id % 5 = 0 THEN 0.0 ELSE round_even(greatest(0.0, least(1.0, value / 100)), 4) END AS c FROM events")
def fn_scalar_confidence(spark, sf_dir):
    said = F.when(F.col("event_id") % 5 == 0, "none").otherwise((F.col("value") / 100).cast("string"))
    return read(spark, sf_dir, "events").select("event_id", S.scalar_confidence(said).alias("c"))


@query("fn_parse_time", "SELECT event_id, CASE WHEN event_id % 3 = 0 THEN CAST(event_id % 90 AS DOUBLE) WHEN (event_id % 70) < 60 THEN CAST(user_id * 60 + event_id % 70 AS DOUBLE) END AS seconds FROM events")
def fn_parse_time(spark, sf_dir):
    said = F.when(F.col("event_id") % 3 == 0, (F.col("event_id") % 90).cast("string")).otherwise(F.concat(F.col("user_id").cast("string"), F.lit(":"), (F.col("event_id") % 70).cast("string")))
    return read(spark, sf_dir, "events").select("event_id", S.parse_time(said).alias("seconds"))


@query("fn_parse_offsets", "SELECT user_id, list_aggregate(list_sort(list_distinct(list_filter([CAST(user_id % 4 AS INTEGER), CAST(-(user_id % 3) AS INTEGER), 0, 5], lambda x: x <> 0))), 'string_agg', ',') AS offsets FROM (SELECT DISTINCT user_id FROM events)")
def fn_parse_offsets(spark, sf_dir):
    users = read(spark, sf_dir, "events").select("user_id").distinct()
    said = F.concat_ws(" , ", (F.col("user_id") % 4).cast("string"), (-(F.col("user_id") % 3)).cast("string"), F.lit("0"), F.lit("x"), F.lit("5"))
    return users.select("user_id", F.array_join(S.parse_offsets(said), ",").alias("offsets"))


@query("fn_frame_index", "SELECT doc_id, CAST(regexp_extract(source, '(\\d+)$', 1) AS BIGINT) AS frame FROM documents")
def fn_frame_index(spark, sf_dir):
    return read(spark, sf_dir, "documents").select("doc_id", S.frame_index(F.col("source")).alias("frame"))


@query("fn_is_sha256", f"WITH {SAMPLES} SELECT doc_id, doc_id % 2 = 0 AS ok FROM samples")
def fn_is_sha256(spark, sf_dir):
    return samples(spark, sf_dir).select("doc_id", S.is_sha256(F.when(F.col("doc_id") % 2 == 0, F.col("sha")).otherwise(F.substring("sha", 1, 63))).alias("ok"))


@query("prj_safe_name", "SELECT doc_id, coalesce(nullif(regexp_replace(regexp_replace(text, '[^\\p{L}\\p{N}_.-]+', '-', 'g'), '^[-.]+|[-.]+$', '', 'g'), ''), 'unknown') AS name FROM documents")
def prj_safe_name(spark, sf_dir):
    return read(spark, sf_dir, "documents").select("doc_id", S.safe_name(F.col("text")).alias("name"))


@query("prj_clean_id", "SELECT event_id, 'user' || CAST(user_id AS VARCHAR) || '-' || event_type AS name FROM events")
def prj_clean_id(spark, sf_dir):
    raw = F.concat(F.lit("-user"), F.col("user_id").cast("string"), F.lit(" / "), F.col("event_type"), F.lit("._"))
    return read(spark, sf_dir, "events").select("event_id", S.safe_name(raw, "video", "-._").alias("name"))


@query("prj_relative_stem", f"WITH {SAMPLES} SELECT doc_id, source || '-' || left(sha, 8) AS stem FROM samples")
def prj_relative_stem(spark, sf_dir):
    tail = F.concat(F.lit("-"), F.substring("sha", 1, 8))
    stem = F.when(F.col("doc_id") % 3 == 0, F.col("source")).when(F.col("doc_id") % 3 == 1, F.concat("source", tail)).otherwise(F.concat("source", tail, tail))
    return samples(spark, sf_dir).select("doc_id", S.relative_stem(stem, F.col("sha")).alias("stem"))


@query("fn_support_stats", """WITH s AS (SELECT user_id, list_sort(list(value / 500)) AS v FROM events GROUP BY user_id)
SELECT user_id, round_even(list_avg(v), 5) AS mean, round_even(quantile_cont(x, 0.5), 5) AS p50, round_even(quantile_cont(x, 0.9), 5) AS p90, round_even(count(*) FILTER (WHERE x >= 0.1) / count(*), 5) AS share_10 FROM (SELECT user_id, v, unnest(v) AS x FROM s) GROUP BY user_id, v""")
def fn_support_stats(spark, sf_dir):
    v = read(spark, sf_dir, "events").groupBy("user_id").agg(F.collect_list(F.col("value") / 500).alias("v"))
    s = v.select("user_id", S.support_stats(F.col("v")).alias("s"))
    return s.select("user_id", *[F.bround(F.col(f"s.{c}"), 5).alias(c) for c in ("mean", "p50", "p90", "share_10")])


@query("fn_linear_blend", "WITH z AS (SELECT a.vec_id, a.embedding AS e, b.embedding AS f FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1) SELECT vec_id, round_even(0.75 * CAST(e[1] AS DOUBLE) + 0.25 * CAST(f[1] AS DOUBLE), 6) AS first FROM z")
def fn_linear_blend(spark, sf_dir):
    e = read(spark, sf_dir, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("e"))
    n = e.select((F.col("vec_id") - 1).alias("vec_id"), F.col("e").alias("f"))
    return e.join(n, "vec_id").select("vec_id", F.bround(S.linear_blend(F.col("e"), F.col("f"), 0.25)[0], 6).alias("first"))


@query("fn_caption", "SELECT event_id, event_type || ' | ' || printf('%.2f', value) || CASE WHEN value > 100 THEN ' | large' ELSE '' END AS caption FROM events")
def fn_caption(spark, sf_dir):
    flags = F.array_compact(F.array(F.when(F.col("value") > 100, "large")))
    return read(spark, sf_dir, "events").select("event_id", S.caption(F.col("event_type"), F.col("value"), flags).alias("caption"))


@query("fn_round", "SELECT l_linenumber, l_orderkey, l_partkey, round_even(l_quantity / 2, 0) AS half FROM lineitem")
def fn_round(spark, sf_dir):
    return read(spark, sf_dir, "lineitem").select("l_linenumber", "l_orderkey", "l_partkey", G.half_even(F.col("l_quantity") / 2, 0).alias("half"))


@query("fn_now", "SELECT doc_id, '2024-01-01T00:00:00+00:00' AS reviewed_at FROM documents")
def fn_now(spark, sf_dir):
    return read(spark, sf_dir, "documents").select("doc_id", F.lit("2024-01-01T00:00:00+00:00").alias("reviewed_at"))


# gates and validations


@query("flt_gate_cascade", f"""WITH {SAMPLES} SELECT doc_id, CASE WHEN n_chars < 200 THEN 'short' WHEN lang NOT IN ('en', 'de', 'fr') THEN 'language' WHEN source IN ('src3', 'src7') THEN 'source' WHEN quality IS NULL THEN 'unreviewed' WHEN toxic = 1 THEN 'toxic' END AS reason FROM samples""")
def flt_gate_cascade(spark, sf_dir):
    rules = [("short", F.col("n_chars") >= 200), ("language", F.col("lang").isin("en", "de", "fr")), ("source", ~F.col("source").isin("src3", "src7")), ("unreviewed", F.col("quality").isNotNull()), ("toxic", F.col("toxic") == 0)]
    return gates.gate_cascade(samples(spark, sf_dir), rules).select("doc_id", "reason")


@query("flt_digest_mismatch", "SELECT doc_id, doc_id % 3 = 1 AS mismatch FROM documents")
def flt_digest_mismatch(spark, sf_dir):
    declared = F.when(F.col("doc_id") % 3 == 0, "").when(F.col("doc_id") % 3 == 1, F.sha2(F.concat("text", F.lit("x")), 256)).otherwise(F.upper(F.sha2("text", 256)))
    return read(spark, sf_dir, "documents").select("doc_id", gates.digest_mismatch(declared, F.col("text")).alias("mismatch"))


@query("prj_approved_scopes", "SELECT doc_id, CASE WHEN quality = 1 AND toxic = 0 THEN 'visible_geometry,yoyo_bbox' WHEN quality = 1 THEN 'visible_geometry' WHEN toxic = 0 THEN 'yoyo_bbox' ELSE '' END AS scopes, quality = 1 AND toxic = 0 AS complete FROM labels")
def prj_approved_scopes(spark, sf_dir):
    review = lambda ok, scope: F.struct(F.when(ok, "Approve").otherwise("reject").alias("decision"), F.array(F.lit(scope)).alias("review_scope"))
    reviews = F.array(review(F.col("quality") == 1, "visible_geometry"), review(F.col("toxic") == 0, "yoyo_bbox"))
    s = read(spark, sf_dir, "labels").withColumn("s", gates.approved_scopes(reviews))
    return s.select("doc_id", F.array_join("s", ",").alias("scopes"), gates.has_scopes(F.col("s")).alias("complete"))


@query("prj_sample_flags", f"WITH {BOXES} SELECT frame, det, x2 > x1 AND y2 > y1 AND cls = 1 AS has_box, conf > 0.5 AS has_string FROM boxes")
def prj_sample_flags(spark, sf_dir):
    b = F.when(F.col("cls") == 1, box())
    return boxes(spark, sf_dir).select("frame", "det", G.bbox_valid(b).alias("has_box"), F.coalesce(F.when(F.col("conf") > 0.5, "visible").isin("visible", "partial"), F.lit(False)).alias("has_string"))


def _labels(spark, sf_dir):
    """Boxes as label documents, each with some faults."""
    d, f, c = F.col("det"), F.col("frame"), F.col("conf")
    corner = lambda x, y: F.array(F.col(x), F.col(y))
    line = F.array(corner("x1", "y1"), corner("x2", "y2"))
    edge = F.struct(F.lit(0).alias("from"), F.when(f % 13 == 0, 2).otherwise(1).alias("to"), F.when(F.col("cls") == 1, "observed").when(d % 4 == 0, "guess").otherwise("temporal").alias("evidence"), (c * 1.2).alias("confidence"))
    path = F.struct(line.alias("points"), F.when(d == 3, "finger").otherwise("yoyo").alias("start_anchor"), F.lit("unknown").alias("end_anchor"), F.array(edge).alias("edges"))
    one = lambda role: F.struct(F.lit("r").alias("reviewer"), F.lit(role).alias("role"))
    sha = F.sha2(f.cast("string"), 256)
    visibility = F.when(d == 1, "visible").when(d == 2, "not_visible").when(d == 3, "uncertain").when(d == 4, "partial").otherwise("gone")
    return boxes(spark, sf_dir).select(
        "frame", "det", F.when(f % 11 == 0, "v4").otherwise("v5").alias("schema_version"), F.lit("a.mp4").alias("source_video"), F.concat(F.lit("g"), (f % 9).cast("string")).alias("source_group"), F.concat(F.lit("g"), (F.when(f % 17 == 0, 0).otherwise(f) % 9).cast("string")).alias("video_id"), F.when(f % 19 == 0, " ").otherwise("s1").alias("sequence_id"),
        sha.alias("source_video_sha256"), F.when(f % 23 == 0, F.upper(sha)).otherwise(sha).alias("sampling_manifest_sha256"), sha.alias("image_sha256"), (d - 2).alias("frame_index"), F.when(f % 29 == 0, F.lit(None)).otherwise(c).alias("timestamp_s"), F.when(d % 2 == 0, "anchor").otherwise("temporal_context").alias("sampling_role"), F.lit(0).cast("long").alias("anchor_frame_index"), F.array(F.lit(80), F.lit(360)).alias("image_size"),
        visibility.alias("string_visibility"), F.lit("trick").alias("scene_label"), F.lit("normal").alias("trick_orientation"), F.when(c > 0.2, F.array("x1", "y1", "x2", "y2")).alias("box"), F.when(d != 4, F.array(line)).alias("strokes"), F.when(d == 5, F.array(line)).alias("masks"), F.when(d < 6, F.array(path)).alias("paths"),
        F.when(f % 2 == 0, "approved").otherwise("draft").alias("string_review_status"), F.when(f % 3 == 0, F.array(one("geometry-critic"), one("semantic-critic"))).when(f % 3 == 1, F.array(one("geometry-critic"))).alias("approvals"), F.when(f % 5 == 0, 1).otherwise(2).alias("min_approvals"),
    )


#: The faults of these documents by rule.
FAULTS = """array_to_string(list_filter([CASE WHEN frame % 11 = 0 THEN 'schema' END, CASE WHEN frame % 19 = 0 THEN 'names' END, CASE WHEN frame % 17 = 0 AND frame % 9 <> 0 THEN 'video_id' END, CASE WHEN frame % 23 = 0 THEN 'digests' END, CASE WHEN det < 2 THEN 'frame_index' END, CASE WHEN frame % 29 = 0 THEN 'timestamp' END,
  CASE WHEN det % 2 = 0 AND det <> 2 THEN 'anchor_frame' END, CASE WHEN det > 4 THEN 'values' END, CASE WHEN det <> 4 AND x2 > 80 THEN 'strokes' END, CASE WHEN det = 5 THEN 'masks' END, CASE WHEN det = 4 THEN 'geometry_missing' END, CASE WHEN det = 2 THEN 'geometry_kept' END, CASE WHEN det = 3 THEN 'anchors' END,
  CASE WHEN det < 6 AND det <> 3 AND conf <= 0.2 THEN 'anchor_far' END, CASE WHEN det < 6 AND frame % 13 = 0 THEN 'edges' END, CASE WHEN det < 6 AND (cls <> 1 AND det % 4 = 0 OR conf * 1.2 > 1) THEN 'evidence' END, CASE WHEN det = 4 AND cls = 1 THEN 'observed_without_geometry' END, CASE WHEN det IN (1, 4) AND cls <> 1 THEN 'nothing_observed' END,
  CASE WHEN frame % 2 = 0 AND det = 3 THEN 'approved_uncertain' END, CASE WHEN frame % 2 = 0 AND (frame % 3 = 2 OR frame % 3 = 1 AND frame % 5 <> 0) THEN 'approvals' END, CASE WHEN frame % 2 = 0 AND frame % 5 <> 0 AND frame % 3 <> 0 THEN 'critics' END{}], lambda x: x IS NOT NULL), ',')"""


@query("val_label_document", f"WITH {BOXES} SELECT frame, det, array_to_string(list_sort(string_split({FAULTS.format('')}, ',')), ',') AS errors FROM boxes")
def val_label_document(spark, sf_dir):
    found = gates.collect_failures(_labels(spark, sf_dir), gates.label_rules("v5"))
    return found.select("frame", "det", F.array_join("errors", ",").alias("errors"))


@query("doc_export_labels", f"""WITH {BOXES}, e AS (SELECT frame, det, {FAULTS.format(", CASE WHEN frame % 2 = 1 THEN 'status=draft' END, CASE WHEN frame % 3 = 1 AND frame % 5 <> 0 THEN 'approvals=1 requires=2' WHEN frame % 3 = 2 AND frame % 5 = 0 THEN 'approvals=0 requires=1' WHEN frame % 3 = 2 THEN 'approvals=0 requires=2' END")} AS r FROM boxes)
SELECT frame, det, r = '' AS exported, array_to_string(list_sort(list_distinct(string_split(r, ','))), ',') AS reasons FROM e""")
def doc_export_labels(spark, sf_dir):
    """What is exported and why the rest isn't; a conflict in the collection would stop it all."""
    labels = gates.collect_failures(_labels(spark, sf_dir), gates.label_rules("v5"))
    none = reports.collection_conflicts(labels.select(F.lit("").alias("sha"), "source_group", "source_video").limit(0), "sha", "source_group", "source_video")
    out = gates.without_conflicts(gates.export_reasons(labels, F.col("errors"), F.col("min_approvals")), none)
    return out.select("frame", "det", (F.size("reasons") == 0).alias("exported"), F.array_join("reasons", ",").alias("reasons"))


@query("val_label", f"WITH {BOXES} SELECT frame, det, array_to_string(list_filter([CASE WHEN conf > 0.8 THEN 'confidence' END, CASE WHEN x1 > 50 THEN 'outside' END, CASE WHEN (x2 - x1) < 25 THEN 'small' END], lambda x: x IS NOT NULL), ',') AS errors FROM boxes")
def val_label(spark, sf_dir):
    rules = [("small", F.col("x2") - F.col("x1") >= 25), ("confidence", F.col("conf") <= 0.8), ("outside", F.col("x1") <= 50)]
    return gates.collect_failures(boxes(spark, sf_dir), rules).select("frame", "det", F.array_join("errors", ",").alias("errors"))


@query("val_sampling_record", f"""WITH {SAMPLES} SELECT doc_id, CASE WHEN doc_id % 13 = 0 THEN 'source_video_sha256' WHEN doc_id % 17 = 0 THEN 'output_image_sha256' WHEN doc_id % 19 = 0 THEN 'sequence_id' WHEN doc_id % 5 = 4 THEN 'role'
  WHEN n_chars % 23 = 0 OR doc_id % 29 = 0 OR doc_id % 5 < 2 AND doc_id % 3 <> 0 THEN 'provenance' END AS error FROM samples""")
def val_sampling_record(spark, sf_dir):
    d = F.col("doc_id")
    records = samples(spark, sf_dir).select(
        "doc_id", F.lit("a.mp4").alias("source_video"), F.when(d % 13 == 0, F.upper("sha")).otherwise(F.col("sha")).alias("source_video_sha256"), F.col("source").alias("source_group"), F.when(d % 19 == 0, " ").otherwise("s1").alias("sequence_id"), F.lit("a.png").alias("output_image"),
        F.when(d % 17 == 0, F.lit(None)).otherwise(F.col("sha")).alias("output_image_sha256"), F.when(d % 5 < 2, "anchor").when(d % 5 < 4, "temporal_context").otherwise("other").alias("role"), (d % 3).alias("frame_index"), F.when(d % 29 == 0, -1).otherwise(0).alias("anchor_frame_index"),
        F.when(F.col("n_chars") % 23 == 0, F.lit(float("nan"))).otherwise(1.5).alias("timestamp_s"),
    )
    return gates.sampling_errors(records).select("doc_id", "error")

@query("val_sample_key", "SELECT doc_id, doc_id % 4 = 0 AS ok FROM documents")
def val_sample_key(spark, sf_dir):
    k = F.col("doc_id").cast("string")
    key = F.when(F.col("doc_id") % 4 == 0, F.concat(F.lit("a/"), k, F.lit(".JSON"))).when(F.col("doc_id") % 4 == 1, F.concat(F.lit("../"), k, F.lit(".json"))).when(F.col("doc_id") % 4 == 2, F.concat(F.lit("/"), k, F.lit(".json"))).otherwise(F.concat(k, F.lit(".png")))
    return read(spark, sf_dir, "documents").select("doc_id", gates.sample_key_valid(key).alias("ok"))


@query("flt_frame_range", "SELECT event_id, user_id FROM events WHERE event_id BETWEEN 100 AND 400")
def flt_frame_range(spark, sf_dir):
    return gates.frame_range(read(spark, sf_dir, "events"), F.col("event_id"), 100, 400).select("event_id", "user_id")


@query("flt_revision_valid", f"WITH {SAMPLES} SELECT doc_id, coalesce(quality = 1 AND n_chars % 2 = 0, false) AS valid FROM samples")
def flt_revision_valid(spark, sf_dir):
    even = F.col("n_chars") - F.col("n_chars") % 2
    return samples(spark, sf_dir).select("doc_id", gates.revision_valid(F.col("quality") == 1, even, F.col("doc_id"), F.col("n_chars"), F.col("doc_id")).alias("valid"))


@query("prj_safe_promotions", f"WITH {BOXES} SELECT frame, det, CASE WHEN conf >= 0.6 AND cls = 1 THEN 'visible' END AS visibility FROM boxes")
def prj_safe_promotions(spark, sf_dir):
    return boxes(spark, sf_dir).select("frame", "det", gates.safe_promotion(F.lit("visible"), F.col("conf"), 0.6, F.col("cls") == 1).alias("visibility"))


@query("prj_handoff_queue", f"WITH {BOXES} SELECT frame, det, CASE WHEN conf > 0.8 THEN 'quick_verify' WHEN conf < 0.2 THEN 'hard' WHEN cls = 1 THEN 'clear' ELSE 'standard' END AS queue, CASE WHEN conf > 0.8 THEN 0 WHEN cls = 1 THEN 1 WHEN conf < 0.2 THEN 3 ELSE 2 END AS rank FROM boxes")
def prj_handoff_queue(spark, sf_dir):
    queue, rank = gates.handoff(F.col("conf") > 0.8, F.col("conf") < 0.2, F.col("cls") == 1)
    return boxes(spark, sf_dir).select("frame", "det", queue.alias("queue"), rank.alias("rank"))


@query("prj_metric_names", "SELECT c_custkey, json_object('box_precision', 0.5, 'map50', CAST(c_nationkey AS DOUBLE)) AS summary FROM customer WHERE c_acctbal <= 0 UNION ALL SELECT c_custkey, json_object('box_precision', 0.5, 'macro_recall', 0.25, 'map50', CAST(c_nationkey AS DOUBLE)) FROM customer WHERE c_acctbal > 0")
def prj_metric_names(spark, sf_dir):
    """Whatever metrics a file has, under one set of names; null values are left out."""
    m = F.map_from_arrays(F.array(F.lit("metrics/precision(B)"), F.lit("metrics/mAP50(B)"), F.lit("metrics/recall(B)"), F.lit("macro_recall"), F.lit("other")), F.array(F.lit(0.5), F.col("c_nationkey").cast("double"), F.lit(None).cast("double"), F.when(F.col("c_acctbal") > 0, 0.25), F.lit(9.0)))
    return read(spark, sf_dir, "customer").select("c_custkey", F.to_json(S.metric_summary(m)).alias("summary"))


@query("prj_metric_summary", "SELECT c_custkey, CASE WHEN c_acctbal > 0 THEN c_acctbal END AS \"mAP50\", c_nationkey * 1.0::DOUBLE AS recall FROM customer")
def prj_metric_summary(spark, sf_dir):
    m = F.map_from_arrays(F.array(F.lit("metrics/mAP50(B)"), F.lit("metrics/recall(B)")), F.array(F.when(F.col("c_acctbal") > 0, F.col("c_acctbal")), F.col("c_nationkey").cast("double")))
    kept = F.map_filter(m, lambda _, v: v.isNotNull())
    return read(spark, sf_dir, "customer").select("c_custkey", F.try_element_at(kept, F.lit("metrics/mAP50(B)")).alias("mAP50"), F.try_element_at(kept, F.lit("metrics/recall(B)")).alias("recall"))


@query("prj_hand_anchor", f"WITH {BOXES} SELECT frame, det, 'not_applicable' AS anchor, false AS mismatch, greatest(48.0, 0.025 * sqrt(640.0 * 640.0 + 360.0 * 360.0)) AS threshold FROM boxes")
def prj_hand_anchor(spark, sf_dir):
    diagonal = F.sqrt(F.lit(640.0 * 640.0 + 360.0 * 360.0))
    return boxes(spark, sf_dir).select("frame", "det", F.lit("not_applicable").alias("anchor"), F.lit(False).alias("mismatch"), F.greatest(F.lit(48.0), 0.025 * diagonal).alias("threshold"))


@query("prj_string_lines", f"WITH {BOXES} SELECT frame, det, CASE WHEN conf < 0.3 THEN '' ELSE '0 ' || printf('%.6f', x1 / 512) || ' ' || printf('%.6f', y1 / 256) || ' ' || printf('%.6f', x2 / 512) || ' ' || printf('%.6f', y2 / 256) END AS line FROM boxes")
def prj_string_lines(spark, sf_dir):
    points = F.array(F.array(F.col("x1") / 512, F.col("y1") / 256), F.array(F.col("x2") / 512, F.col("y2") / 256))
    line = F.concat(F.lit("0 "), F.array_join(F.transform(F.flatten(points), lambda v: F.format_string("%.6f", G.half_even(v, 6))), " "))
    return boxes(spark, sf_dir).select("frame", "det", F.when(F.col("conf") < 0.3, "").otherwise(line).alias("line"))


@query("val_manifest_match", "SELECT source, source <> 'src5' AS matches, CASE WHEN source = 'src5' THEN '-other-' || left(sha256(source), 8) ELSE '' END AS suffix FROM (SELECT DISTINCT source FROM documents)")
def val_manifest_match(spark, sf_dir):
    s = read(spark, sf_dir, "documents").select("source").distinct()
    same = F.when(F.col("source") == "src5", "x").otherwise(F.sha2("source", 256)) == F.sha2("source", 256)
    return s.select("source", same.alias("matches"), F.when(same, "").otherwise(F.concat(F.lit("-other-"), F.substring(F.sha2("source", 256), 1, 8))).alias("suffix"))


def masks(spark, sf_dir):
    """8 x 8 masks of the signs of vectors."""
    bit = F.transform("embedding", lambda v: (v > 0).cast("int"))
    rows = F.array(*[F.slice(bit, 8 * i + 1, 8) for i in range(8)])
    return read(spark, sf_dir, "embeddings").where("size(embedding) = 64").select("vec_id", "embedding", rows.alias("mask"))


@query("flt_small_components", """WITH RECURSIVE px AS (SELECT vec_id, i FROM (SELECT vec_id, embedding, unnest(range(64)) AS i FROM embeddings WHERE len(embedding) = 64) WHERE embedding[i + 1] > 0),
reach AS (SELECT vec_id, i, i AS j FROM px UNION SELECT r.vec_id, r.i, p.i FROM reach r JOIN px p ON p.vec_id = r.vec_id AND abs(p.i // 8 - r.j // 8) <= 1 AND abs(p.i % 8 - r.j % 8) <= 1),
sizes AS (SELECT vec_id, i, count(*) AS n FROM reach GROUP BY ALL)
SELECT vec_id, CAST(count(*) FILTER (WHERE n >= 4) AS INTEGER) AS pixels FROM (SELECT DISTINCT vec_id FROM embeddings WHERE len(embedding) = 64) LEFT JOIN sizes USING (vec_id) GROUP BY vec_id""")
def flt_small_components(spark, sf_dir):
    kept = masks(spark, sf_dir).select("vec_id", R.small_components_removed(F.col("mask"), 4).alias("m"))
    return kept.select("vec_id", F.aggregate(F.flatten("m"), F.lit(0), lambda s, v: s + v).alias("pixels"))


@query("fn_skeleton_path")
def fn_skeleton_path(spark, sf_dir):
    p = masks(spark, sf_dir).select("vec_id", R.skeleton_path(F.col("mask")).alias("p"))
    return p.select("vec_id", F.size("p").alias("points"), F.bround(G.polyline_length(F.col("p")), 4).alias("length"))


@query("fn_mask_support")
def fn_mask_support(spark, sf_dir):
    a, b = F.col("a"), F.col("b")
    corners = F.array(F.array(a[0], a[1]), F.array(a[2], a[1]), F.array(a[2], a[3]), F.array(a[0], a[3]))
    line = F.array(F.array(b[0], b[1]), F.array(b[2], b[3]))
    return pairs(spark, sf_dir).select("frame", "det", F.bround(R.mask_support(line, F.array(corners)), 6).alias("share"))


@query("fn_descriptor", "WITH n AS (SELECT vec_id, list_transform(embedding, lambda v: CAST(v AS DOUBLE)) AS e FROM embeddings), l AS (SELECT *, sqrt(list_sum(list_transform(e, lambda v: v * v))) AS size FROM n) SELECT vec_id, i AS place, round_even(CASE WHEN size > 0 THEN e[i] / size ELSE 0 END, 6) AS value FROM (SELECT *, unnest(range(1, len(e) + 1)) AS i FROM l)")
def fn_descriptor(spark, sf_dir):
    d = read(spark, sf_dir, "embeddings").select("vec_id", R.descriptor(F.col("embedding").cast("array<double>")).alias("d"))
    flat = d.select("vec_id", F.posexplode("d").alias("place", "value"))
    return flat.select("vec_id", (F.col("place") + 1).cast("long").alias("place"), F.bround("value", 6).alias("value"))
