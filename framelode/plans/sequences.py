"""Queries of ordered operators, folds and ranked rows."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..operators import folds, reports
from ..operators import sequences as S
from .tables import BOXES, FRAMES, boxes, frames, read

Q: dict = {}


def query(name: str, sql: str | None = None):
    def add(f):
        Q[name] = (f, sql)
        return f

    return add




def known(spark, sf_dir):
    """Frames with a target (not signup) and a prediction (not error)."""
    return frames(spark, sf_dir).withColumn("t", F.col("event_type") != "signup").withColumn("p", F.col("event_type") != "error")


def predicted(spark, sf_dir):
    """Frames with the label of the frame before as the prediction."""
    e = frames(spark, sf_dir)
    return e.withColumn("label", F.col("event_type")).withColumn("pred", F.coalesce(F.lag("event_type").over(S.ordered()), F.lit("unknown")))


PREDICTED = f"{FRAMES}, predicted AS (SELECT *, event_type AS label, coalesce(lag(event_type) OVER (PARTITION BY grp ORDER BY frame), 'unknown') AS pred FROM frames)"


@query("win_missing_streak", f"""WITH {FRAMES}, o AS (SELECT *, row_number() OVER (ORDER BY grp, frame) AS n, event_type = 'error' AS miss FROM frames),
r AS (SELECT *, n - row_number() OVER (PARTITION BY miss ORDER BY n) AS island FROM o), s AS (SELECT island, count(*) AS n FROM r WHERE miss GROUP BY island)
SELECT max(n) AS longest, count(*) AS episodes FROM s""")
def win_missing_streak(spark, sf_dir):
    e = known(spark, sf_dir)
    return S.missing_streak(e, F.col("t"), F.col("p"))


@query("win_missing_streak_per_group", f"""WITH {FRAMES}, o AS (SELECT *, event_type = 'error' AS miss FROM frames),
r AS (SELECT *, frame - row_number() OVER (PARTITION BY grp, miss ORDER BY frame) AS island FROM o), s AS (SELECT grp, island, count(*) AS n FROM r WHERE miss GROUP BY grp, island)
SELECT max(n) AS longest, count(*) AS episodes FROM s""")
def win_missing_streak_per_group(spark, sf_dir):
    e = known(spark, sf_dir)
    return S.missing_streak(e, F.col("t"), F.col("p"), per_group=True)


@query("win_recovery", f"""WITH {FRAMES}, o AS (SELECT *, event_type = 'error' AS miss FROM frames),
r AS (SELECT *, frame - row_number() OVER (PARTITION BY grp, miss ORDER BY frame) AS island, lead(event_type) OVER (PARTITION BY grp ORDER BY frame) AS nxt FROM o),
s AS (SELECT grp, island, count(*) AS n, arg_max(CASE WHEN nxt IS NULL THEN false ELSE nxt NOT IN ('signup', 'error') END, frame) AS back FROM r WHERE miss GROUP BY grp, island)
SELECT count(*) FILTER (WHERE back) AS recovered, count(*) FILTER (WHERE NOT back) AS unrecovered, CAST(sum(n) FILTER (WHERE back) AS BIGINT) AS latency_sum FROM s""")
def win_recovery(spark, sf_dir):
    e = known(spark, sf_dir)
    return S.recovery(e, F.col("t"), F.col("p"))


@query("win_track_switch", "WITH k AS (SELECT *, lag(role) OVER (PARTITION BY conv_id ORDER BY turn) AS was FROM conversations WHERE role <> 'system') SELECT count(*) FILTER (WHERE was <> role) AS switches, count(DISTINCT (conv_id, role)) AS tracks FROM k")
def win_track_switch(spark, sf_dir):
    c = read(spark, sf_dir, "conversations").withColumn("track", F.when(F.col("role") != "system", F.col("role")))
    return S.track_switches(c, "track", "conv_id", "turn")


@query("win_switch_count", f"WITH {FRAMES}, k AS (SELECT *, lag(event_type) OVER (PARTITION BY grp ORDER BY frame) AS was FROM frames) SELECT grp, count(*) FILTER (WHERE was <> event_type) AS switches FROM k GROUP BY grp")
def win_switch_count(spark, sf_dir):
    return S.switch_count(frames(spark, sf_dir), "event_type")


@query("win_isolated_flip", f"""WITH {FRAMES}, k AS (SELECT *, value > 20 AS t, event_type IN ('click', 'view') AS p FROM frames),
n AS (SELECT *, lag(t) OVER w AS t0, lead(t) OVER w AS t2, lag(p) OVER w AS p0, lead(p) OVER w AS p2 FROM k WINDOW w AS (PARTITION BY grp ORDER BY frame))
SELECT grp, count(*) FILTER (WHERE p0 = p2 AND p0 <> p AND t0 = t AND t2 = t) AS flips FROM n GROUP BY grp""")
def win_isolated_flip(spark, sf_dir):
    e = frames(spark, sf_dir).withColumn("t", F.col("value") > 20).withColumn("p", F.col("event_type").isin("click", "view"))
    return S.isolated_flips(e, "t", "p")


@query("win_transition_latency", f"""WITH {PREDICTED}, c AS (SELECT *, CASE WHEN lag(label) OVER (PARTITION BY grp ORDER BY frame) <> label THEN 1 ELSE 0 END AS ch FROM predicted),
s AS (SELECT *, sum(ch) OVER (PARTITION BY grp ORDER BY frame) AS segment FROM c)
SELECT grp, CAST(segment AS BIGINT) AS segment, min(frame) FILTER (WHERE pred = label) - min(frame) AS latency FROM s WHERE segment > 0 GROUP BY grp, segment""")
def win_transition_latency(spark, sf_dir):
    return S.transition_latency(predicted(spark, sf_dir), "label", "pred")


XY = "xy AS (SELECT *, value AS x, CAST(event_id % 97 AS DOUBLE) AS y, CASE WHEN event_type <> 'error' THEN value + user_id % 5 END AS px, CAST(event_id % 89 AS DOUBLE) AS py FROM (SELECT *, grp AS user_id FROM frames))"


def points(spark, sf_dir):
    e = frames(spark, sf_dir)
    return e.select("*", F.col("value").alias("x"), (F.col("event_id") % 97).cast("double").alias("y"), F.when(F.col("event_type") != "error", F.col("value") + F.col("grp") % 5).alias("px"), (F.col("event_id") % 89).cast("double").alias("py"))


@query("win_motion", f"""WITH {FRAMES}, {XY}, d AS (SELECT grp, frame, CASE WHEN px IS NOT NULL THEN px - x END AS dx, CASE WHEN px IS NOT NULL THEN py - y END AS dy FROM xy),
l AS (SELECT *, lag(dx) OVER w AS dx1, lag(dy) OVER w AS dy1, lag(dx, 2) OVER w AS dx2, lag(dy, 2) OVER w AS dy2 FROM d WINDOW w AS (ORDER BY grp, frame))
SELECT grp, frame, round_even(sqrt(pow(dx - dx1, 2) + pow(dy - dy1, 2)), 5) AS velocity_error, round_even(sqrt(pow(dx - 2 * dx1 + dx2, 2) + pow(dy - 2 * dy1 + dy2, 2)), 5) AS acceleration_error FROM l""")
def win_motion(spark, sf_dir):
    """Motion goes on from one group to the next, as rows follow in the order of (group, frame)."""
    m = S.motion_errors(points(spark, sf_dir), "x", "y", "px", "py", resets=False)
    return m.select("grp", "frame", F.bround("velocity_error", 5).alias("velocity_error"), F.bround("acceleration_error", 5).alias("acceleration_error"))


@query("win_motion_per_group", f"""WITH {FRAMES}, {XY}, d AS (SELECT grp, frame, CASE WHEN px IS NOT NULL THEN px - x END AS dx, CASE WHEN px IS NOT NULL THEN py - y END AS dy FROM xy),
l AS (SELECT *, lag(dx) OVER w AS dx1, lag(dy) OVER w AS dy1, lag(dx, 2) OVER w AS dx2, lag(dy, 2) OVER w AS dy2 FROM d WINDOW w AS (PARTITION BY grp ORDER BY frame))
SELECT grp, frame, round_even(sqrt(pow(dx - dx1, 2) + pow(dy - dy1, 2)), 5) AS velocity_error, round_even(sqrt(pow(dx - 2 * dx1 + dx2, 2) + pow(dy - 2 * dy1 + dy2, 2)), 5) AS acceleration_error FROM l""")
def win_motion_per_group(spark, sf_dir):
    m = S.motion_errors(points(spark, sf_dir), "x", "y", "px", "py")
    return m.select("grp", "frame", F.bround("velocity_error", 5).alias("velocity_error"), F.bround("acceleration_error", 5).alias("acceleration_error"))


@query("win_string_motion", f"""WITH {FRAMES}, {XY}, k AS (SELECT * FROM xy WHERE event_type <> 'view'), l AS (SELECT *, frame - lag(frame) OVER w AS gap, (px - lag(px) OVER w) - (x - lag(x) OVER w) AS ex, (py - lag(py) OVER w) - (y - lag(y) OVER w) AS ey FROM k WINDOW w AS (PARTITION BY grp ORDER BY frame))
SELECT grp, frame, CASE WHEN gap = 1 THEN round_even(sqrt(ex * ex + ey * ey), 5) END AS velocity_error, CASE WHEN gap = 1 THEN round_even(abs(ex), 5) END AS length_error FROM l""")
def win_string_motion(spark, sf_dir):
    m = S.string_motion(points(spark, sf_dir).where("event_type <> 'view'"), "x", "y", "x", "px", "py", "px")
    return m.select("grp", "frame", F.bround("velocity_error", 5).alias("velocity_error"), F.bround("length_error", 5).alias("length_error"))


@query("win_speed", f"WITH {FRAMES}, {XY} SELECT grp, frame, round_even(coalesce(sqrt(pow(x - lag(x) OVER w, 2) + pow(y - lag(y) OVER w, 2)) * 30, 0.0), 5) AS speed FROM xy WINDOW w AS (PARTITION BY grp ORDER BY frame)")
def win_speed(spark, sf_dir):
    return S.speed(points(spark, sf_dir), "x", "y", 30.0).select("grp", "frame", F.bround("speed", 5).alias("speed"))


@query("win_carry_forward", f"""WITH {FRAMES}, c AS (SELECT grp, frame, last_value(CASE WHEN event_type = 'purchase' THEN value END IGNORE NULLS) OVER w AS carried, frame - last_value(CASE WHEN event_type = 'purchase' THEN frame END IGNORE NULLS) OVER w AS carried_age FROM frames WINDOW w AS (PARTITION BY grp ORDER BY frame ROWS UNBOUNDED PRECEDING)) SELECT * FROM c""")
def win_carry_forward(spark, sf_dir):
    return S.carry_forward(frames(spark, sf_dir), F.when(F.col("event_type") == "purchase", F.col("value")), "carried").select("grp", "frame", "carried", "carried_age")


@query("win_last_seen", f"""WITH {FRAMES}, s AS (SELECT *, last_value(CASE WHEN event_type <> 'error' THEN frame END IGNORE NULLS) OVER w AS last_seen_frame, last_value(CASE WHEN event_type <> 'error' THEN value > 30 END IGNORE NULLS) OVER w AS edge FROM frames WINDOW w AS (PARTITION BY grp ORDER BY frame ROWS UNBOUNDED PRECEDING))
SELECT grp, frame, last_seen_frame, frame - coalesce(last_seen_frame, -1) AS missing_streak, frame - coalesce(last_seen_frame, -1) > 0 AND coalesce(edge, false) AS likely_out FROM s""")
def win_last_seen(spark, sf_dir):
    e = S.last_seen(frames(spark, sf_dir), F.col("event_type") != "error", F.col("value") > 30)
    return e.select("grp", "frame", "last_seen_frame", "missing_streak", "likely_out")


@query("win_grace_gate", f"WITH {FRAMES} SELECT grp, frame, coalesce(frame - last_value(CASE WHEN event_type = 'view' THEN frame END IGNORE NULLS) OVER (PARTITION BY grp ORDER BY frame ROWS UNBOUNDED PRECEDING) <= 2, false) AS allowed FROM frames")
def win_grace_gate(spark, sf_dir):
    return S.grace_gate(frames(spark, sf_dir), F.col("event_type") == "view", 8.0).select("grp", "frame", "allowed")


@query("win_propagation_age", f"WITH {FRAMES}, a AS (SELECT grp, frame, frame - last_value(CASE WHEN event_type = 'view' THEN frame END IGNORE NULLS) OVER (PARTITION BY grp ORDER BY frame ROWS UNBOUNDED PRECEDING) AS age FROM frames) SELECT grp, frame, CASE WHEN age <= 12 THEN age END AS age FROM a")
def win_propagation_age(spark, sf_dir):
    return S.propagation_age(frames(spark, sf_dir), F.col("event_type") == "view").select("grp", "frame", "age")


@query("win_rolling_gate", f"""WITH {FRAMES}, g AS (SELECT *, count(*) OVER w = 12 AND sum(CASE WHEN event_type = 'click' AND value > 100 THEN 1 ELSE 0 END) OVER w <= 0 AND avg(value / 500) OVER w < 0.1 AND avg(value / 1000) OVER w > 0.018 AS fires FROM frames WINDOW w AS (PARTITION BY grp ORDER BY frame ROWS 11 PRECEDING))
SELECT grp, frame, fires, coalesce(frame > min(CASE WHEN fires THEN frame END) OVER (PARTITION BY grp), false) AS latched FROM g""")
def win_rolling_gate(spark, sf_dir):
    e = S.rolling_gate(frames(spark, sf_dir), (F.col("event_type") == "click") & (F.col("value") > 100), F.col("value") / 500, F.col("value") / 1000, confidence_below=0.1)
    return e.select("grp", "frame", "fires", "latched")


@query("prj_adaptive_route", f"""WITH {FRAMES}, g AS (SELECT *, avg(value / 500) OVER w AS m, count(*) OVER w = 12 AND sum(CASE WHEN event_type = 'click' AND value > 100 THEN 1 ELSE 0 END) OVER w <= 0 AND avg(value / 500) OVER w < 0.1 AND avg(value / 1000) OVER w > 0.018 AS fires FROM frames WINDOW w AS (PARTITION BY grp ORDER BY frame ROWS 11 PRECEDING)),
f AS (SELECT *, coalesce(frame > min(CASE WHEN fires THEN frame END) OVER (PARTITION BY grp), false) AS latched, min_by(m, CASE WHEN fires THEN frame END) OVER (PARTITION BY grp) AS mean FROM g)
SELECT grp, frame, round_even(mean, 6) AS mean, CASE WHEN NOT latched THEN 'ensemble' WHEN mean < 0.085 THEN 'single' ELSE 'adaptive_ensemble' END AS route, CASE WHEN latched AND mean < 0.095 THEN 0.35 ELSE 0.5 END::DOUBLE AS threshold FROM f""")
def prj_adaptive_route(spark, sf_dir):
    """The route and threshold of each frame of a video: those that the gate's first window decides, from the frame after it on."""
    gated = [(F.col("event_type") == "click") & (F.col("value") > 100), F.col("value") / 500, F.col("value") / 1000]
    e = S.adaptive_route(frames(spark, sf_dir), gated, native=0.5, adapted=0.35, adapted_below=0.095, single_below=0.085, confidence_below=0.1)
    return e.select("grp", "frame", F.bround("mean", 6).alias("mean"), "route", "threshold")


@query("win_interval_frames", f"""WITH {FRAMES}, s AS (SELECT grp, epoch_us(ts) / 1e6 - lag(epoch_us(ts) / 1e6) OVER (PARTITION BY grp ORDER BY frame) AS step FROM frames)
SELECT grp, greatest(1, CAST(round_even(coalesce(1 / median(CASE WHEN step > 0 THEN step END), 0.00001) / 0.00001, 0) AS BIGINT)) AS interval FROM s GROUP BY grp""")
def win_interval_frames(spark, sf_dir):
    seconds = F.unix_micros(F.col("ts").cast("timestamp")) / 1e6
    return S.interval_frames(frames(spark, sf_dir), seconds, 0.00001)


@query("win_dense_run", f"""WITH {FRAMES}, f AS (SELECT *, count(*) OVER w = 5 AND sum(CASE WHEN event_type = 'error' THEN 1 ELSE 0 END) OVER w = 0 AS free FROM frames WINDOW w AS (PARTITION BY grp ORDER BY frame ROWS BETWEEN CURRENT ROW AND 4 FOLLOWING)) SELECT grp, min(frame) AS start FROM f WHERE free GROUP BY grp""")
def win_dense_run(spark, sf_dir):
    return S.dense_run(frames(spark, sf_dir), F.col("event_type") == "error", 5)


@query("win_group_build", f"WITH {FRAMES}, k AS (SELECT * FROM frames WHERE value > 1) SELECT grp, min(frame) AS first_frame, max(frame) AS last_frame, count(*) AS frames, max(frame) - min(frame) + 1 = count(*) AS consecutive FROM k GROUP BY grp")
def win_group_build(spark, sf_dir):
    return S.group_build(frames(spark, sf_dir).where("value > 1"))


@query("win_propagate_edit", f"WITH {FRAMES}, e AS (SELECT *, CASE WHEN frame = 10 THEN 'edited' END AS edit FROM frames) SELECT grp, frame, coalesce(last_value(edit IGNORE NULLS) OVER (PARTITION BY grp ORDER BY frame ROWS UNBOUNDED PRECEDING), event_type) AS event_type FROM e")
def win_propagate_edit(spark, sf_dir):
    e = frames(spark, sf_dir)
    edits = e.where("frame = 10").select("grp", "frame", F.lit("edited").alias("value"))
    return S.propagate_edit(e.select("grp", "frame", "event_type"), edits, "event_type")


@query("win_event_sampling", f"""WITH {FRAMES}, k AS (SELECT grp, frame, event_type, value, frame AS i, count(*) OVER (PARTITION BY grp) AS n, event_type = 'error' AS bad, value > 150 AS far, event_id % 17 = 0 AS again, lag(event_type IN ('click', 'view')) OVER w IS NOT DISTINCT FROM (event_type IN ('click', 'view')) AND lag(event_type = 'error') OVER w IS NOT DISTINCT FROM (event_type = 'error') AS same FROM frames WINDOW w AS (PARTITION BY grp ORDER BY frame)),
p AS (SELECT *, i = 0 OR i = n - 1 OR coalesce(i = min(CASE WHEN bad THEN i END) OVER (PARTITION BY grp), false) OR coalesce(i = min(CASE WHEN far THEN i END) OVER (PARTITION BY grp), false) OR coalesce(i = arg_max(i, CASE WHEN far THEN (value, -i) END) OVER (PARTITION BY grp), false) AS prior FROM k),
e AS (SELECT *, NOT prior AND (NOT same OR again) AS event FROM p), c AS (SELECT *, 24 - count(*) FILTER (WHERE prior) OVER (PARTITION BY grp) AS room, count(*) FILTER (WHERE event) OVER (PARTITION BY grp) AS events, CASE WHEN event THEN row_number() OVER (PARTITION BY grp, event ORDER BY i) - 1 END AS pos FROM e),
t AS (SELECT *, prior OR event AND (events <= room OR list_contains([CAST(floor(j * (events - 1) / (room - 1)) AS BIGINT) for j in range(room)], pos)) AS kept FROM c), u AS (SELECT *, NOT kept AND list_contains([CAST(floor(j * (n - 1) / 23) AS BIGINT) for j in range(24)], i) AS evenly, 24 - count(*) FILTER (WHERE kept) OVER (PARTITION BY grp) AS spare FROM t),
v AS (SELECT *, row_number() OVER (PARTITION BY grp, evenly ORDER BY i) AS place FROM u) SELECT grp, frame FROM v WHERE n <= 24 OR kept OR evenly AND place <= spare""")
def win_event_sampling(spark, sf_dir):
    """At most 24 rows a group: priority rows, then changes, then an even spread."""
    e = frames(spark, sf_dir).withColumn("flags", F.array_compact(F.array(F.when(F.col("event_type") == "error", "bad"), F.when(F.col("value") > 150, "far")))).withColumn("seen", F.col("event_type").isin("click", "view")).withColumn("bad", F.col("event_type") == "error")
    return reports.review_rows(e, "grp", "frame", ["seen", "bad"], "flags", ("bad", "far"), "far", F.col("value"), F.col("event_id") % 17 == 0, 24).select("grp", "frame")


@query("win_signature_events", f"""WITH {FRAMES}, k AS (SELECT *, value > 20 AS big FROM frames), c AS (SELECT *, lag(big) OVER w AS b0, lag(event_type = 'error') OVER w AS e0, row_number() OVER w AS n, lead(1) OVER w AS nx FROM k WINDOW w AS (PARTITION BY grp ORDER BY frame))
SELECT grp, frame FROM c WHERE n = 1 OR nx IS NULL OR big <> b0 OR (event_type = 'error') <> e0""")
def win_signature_events(spark, sf_dir):
    e = frames(spark, sf_dir).withColumn("big", F.col("value") > 20).withColumn("bad", F.col("event_type") == "error")
    return S.signature_events(e, ["big", "bad"]).select("grp", "frame")


@query("win_context_frames", f"""WITH {FRAMES}, m AS (SELECT grp, max(frame) AS last_frame FROM frames GROUP BY grp), a AS (SELECT grp, frame FROM frames WHERE event_type = 'purchase'),
o AS (SELECT a.grp, a.frame + o AS context, a.frame AS anchor FROM a, (VALUES (-2), (-1), (1), (2)) v(o)) SELECT o.grp, o.context, min(anchor) AS anchor FROM o JOIN m USING (grp) WHERE context BETWEEN 0 AND last_frame AND NOT EXISTS (SELECT 1 FROM a WHERE a.grp = o.grp AND a.frame = o.context) GROUP BY o.grp, o.context""")
def win_context_frames(spark, sf_dir):
    e = frames(spark, sf_dir)
    last = e.groupBy("grp").agg(F.max("frame").alias("last_frame"))
    return S.context_frames(e.where("event_type = 'purchase'").select("grp", "frame"), [-2, -1, 1, 2], last)


def probabilities(spark, sf_dir):
    e = frames(spark, sf_dir)
    a, b = F.col("value") / 100 + 0.2, F.when(F.col("event_type") == "error", 1.5).otherwise(0.3)
    return e.select("grp", "frame", F.array(a, b, F.lit(0.1)).alias("probs"))


#: Each frame's probabilities as shares, with the label of the largest.
SHARES = f"""{FRAMES}, shares AS (SELECT grp, frame, [a / (a + b + c), b / (a + b + c), c / (a + b + c)] AS p, CASE WHEN a >= b AND a >= c THEN 1 WHEN b >= c THEN 2 ELSE 3 END AS raw
  FROM (SELECT grp, frame, value / 100 + 0.2 AS a, CAST(CASE WHEN event_type = 'error' THEN 1.5 ELSE 0.3 END AS DOUBLE) AS b, CAST(0.1 AS DOUBLE) AS c FROM frames))"""
#: One observation of the smoothed label: what follows from the state (m, label, cand, n) and the shares p.
OBSERVED = """SELECT *, CASE WHEN sure THEN 'strong_switched' WHEN moved THEN 'confirmed_switched' WHEN leader <> label THEN 'pending' ELSE 'stable' END AS said FROM (
  SELECT *, leader <> label AND (sure OR c >= 3 AND e[leader] - e[label] >= 0.05) AS moved FROM (
    SELECT *, CASE WHEN leader = cand THEN n + 1 ELSE 1 END AS c, leader <> label AND raw = leader AND p[leader] >= 0.9 AND p[leader] - p[label] >= 0.2 AS sure FROM (
      SELECT *, CASE WHEN e[1] >= e[2] AND e[1] >= e[3] THEN 1 WHEN e[2] >= e[3] THEN 2 ELSE 3 END AS leader FROM ({})))) """
SMOOTHED = f"""WITH RECURSIVE {SHARES}, s AS (SELECT grp, frame, p AS m, raw AS label, -1 AS cand, 0 AS n, 'initialized' AS status, raw FROM shares WHERE frame = 0
  UNION ALL SELECT grp, frame, e, CASE WHEN moved THEN leader ELSE label END, CASE WHEN moved OR leader = label THEN -1 ELSE leader END, CASE WHEN moved OR leader = label THEN 0 ELSE c END, said, raw
  FROM ({OBSERVED.format("SELECT x.grp, x.frame, x.p, x.raw, [0.6 * m[i] + 0.4 * p[i] for i in [1, 2, 3]] AS e, label, cand, n FROM s JOIN shares x ON x.grp = s.grp AND x.frame = s.frame + 1")}))
SELECT grp, frame, ['normal', 'horizontal', 'other'][label] AS label, round_even(m[label], 6) AS confidence, ['normal', 'horizontal', 'other'][raw] AS raw_label, status FROM s"""
#: The same where only some frames are observed: nxt is the next of them, k the settled ones in a row.
CADENCE = f"""WITH RECURSIVE {SHARES}, s AS (SELECT grp, frame, p AS m, raw AS label, -1 AS cand, 0 AS n, frame + 2 AS nxt, 0 AS k, true AS observed, true AS burst FROM shares WHERE frame = 0
  UNION ALL SELECT grp, frame, CASE WHEN o THEN e ELSE m END, CASE WHEN o AND moved THEN leader ELSE label END, CASE WHEN NOT o THEN cand WHEN moved OR leader = label THEN -1 ELSE leader END, CASE WHEN NOT o THEN n WHEN moved OR leader = label THEN 0 ELSE c END,
    CASE WHEN NOT o THEN nxt WHEN q < 4 THEN frame + 2 ELSE frame + 10 END, q, o, o AND q < 4
  FROM (SELECT *, CASE WHEN NOT o THEN k WHEN raw <> (CASE WHEN moved THEN leader ELSE label END) OR round_even(p[raw], 6) < 0.6 OR said <> 'stable' THEN 0 ELSE k + 1 END AS q
    FROM ({OBSERVED.format("SELECT x.grp, x.frame, x.p, x.raw, [0.6 * m[i] + 0.4 * p[i] for i in [1, 2, 3]] AS e, m, label, cand, n, nxt, k, x.frame >= nxt AS o FROM s JOIN shares x ON x.grp = s.grp AND x.frame = s.frame + 1")})))
SELECT grp, frame, ['normal', 'horizontal', 'other'][label] AS label, observed, burst FROM s"""


@query("win_ema_hysteresis", SMOOTHED)
def win_ema_hysteresis(spark, sf_dir):
    return folds.smoothed(probabilities(spark, sf_dir))


@query("win_ema", f"""WITH RECURSIVE {FRAMES}, r AS (SELECT grp, frame, value AS ema FROM frames WHERE frame = 0 UNION ALL SELECT f.grp, f.frame, 0.6 * r.ema + 0.4 * f.value FROM r JOIN frames f ON f.grp = r.grp AND f.frame = r.frame + 1) SELECT grp, frame, round_even(ema, 5) AS ema FROM r""")
def win_ema(spark, sf_dir):
    def step(state, row):
        state = row["value"] if state is None else 0.6 * state + 0.4 * row["value"]
        return state, {"grp": row["grp"], "frame": row["frame"], "ema": state}

    e = folds.fold(frames(spark, sf_dir).select("grp", "frame", "value"), "grp", "frame", lambda: None, step, "grp long, frame long, ema double")
    return e.select("grp", "frame", F.bround("ema", 5).alias("ema"))


@query("win_adaptive_cadence", CADENCE)
def win_adaptive_cadence(spark, sf_dir):
    return folds.cadence(probabilities(spark, sf_dir), interval=10, burst=2)


#: Overlap of q and b; boxes of a frame by falling confidence, each kept unless one kept before overlaps it; and the kept ones as a list.
OVERLAP = "greatest(0, least(q.x2, b.x2) - greatest(q.x1, b.x1)) * greatest(0, least(q.y2, b.y2) - greatest(q.y1, b.y1))"
OVERLAP = f"({OVERLAP}) / ((q.x2 - q.x1) * (q.y2 - q.y1) + (b.x2 - b.x1) * (b.y2 - b.y1) - {OVERLAP})"
KEPT = f"""{BOXES}, ranked AS (SELECT frame, {{'det': det, 'x1': x1, 'y1': y1, 'x2': x2, 'y2': y2, 'conf': conf, 'track': cls}} AS b, row_number() OVER (PARTITION BY frame ORDER BY conf DESC, det) AS k FROM boxes),
steps AS (SELECT frame, k, [b] AS kept FROM ranked WHERE k = 1 UNION ALL SELECT r.frame, r.k, CASE WHEN len(list_filter(kept, lambda q: {OVERLAP} >= 0.35)) > 0 THEN kept ELSE list_append(kept, b) END FROM steps s JOIN ranked r ON r.frame = s.frame AND r.k = s.k + 1),
kept AS (SELECT frame, arg_max(kept, k) AS kept FROM steps GROUP BY frame)"""
#: The track that is followed from frame to frame of a group: state is track, box and whether the box can be trusted.
FAR = "sqrt(pow((d.x1 + d.x2) / 2 - (box.x1 + box.x2) / 2, 2) + pow((d.y1 + d.y2) / 2 - (box.y1 + box.y2) / 2, 2)) / greatest(1.0, sqrt(pow(box.x2 - box.x1, 2) + pow(box.y2 - box.y1, 2)), sqrt(pow(d.x2 - d.x1, 2) + pow(d.y2 - d.y1, 2)))"
FOLLOWED = f"""WITH RECURSIVE {KEPT}, o AS (SELECT frame, frame % 50 AS grp, kept, row_number() OVER (PARTITION BY frame % 50 ORDER BY frame) AS n FROM kept),
t AS (SELECT grp, frame, n, kept[1] AS box, kept[1].track AS track, len(kept) = 1 AS trusted, 'confidence' AS source, false AS carried FROM o WHERE n = 1
  UNION ALL SELECT grp, frame, n, d, CASE WHEN carry THEN track ELSE d.track END, one OR source <> 'confidence', source, carry FROM (
    SELECT *, one AND d.track <> track AND {FAR} <= 2 AS carry FROM (
      SELECT grp, frame, n, box, track, len(kept) = 1 AS one, CASE WHEN same > 0 THEN 'preferred_track' WHEN best > 0 THEN 'temporal_motion' ELSE 'confidence' END AS source, kept[CASE WHEN same > 0 THEN same WHEN best > 0 THEN best ELSE 1 END] AS d FROM (
        SELECT o.grp, o.frame, o.n, o.kept, t.box, t.track, coalesce(list_position([d.track for d in o.kept], t.track), 0) AS same,
          CASE WHEN len(o.kept) > 1 AND trusted THEN coalesce(-(list_sort([{{'s': ln(greatest(d.conf, 1e-6)) - 1.5 * ({FAR}), 'i': -d.i}} for d in list_transform(o.kept, lambda x, i: {{'x1': x.x1, 'y1': x.y1, 'x2': x.x2, 'y2': x.y2, 'conf': x.conf, 'i': i}}) if {FAR} <= 2], 'DESC')[1].i), 0) ELSE 0 END AS best
        FROM t JOIN o ON o.grp = t.grp AND o.n = t.n + 1))))
SELECT grp, frame, track, source, carried FROM t"""


@query("win_track_carry", FOLLOWED)
def win_track_carry(spark, sf_dir):
    def step(state, row):
        found = [{"box": [d["x1"], d["y1"], d["x2"], d["y2"]], "conf": d["conf"], "track": d["cls"]} for d in row["found"]]
        state, out = folds.pick(state, found)
        return state, {"grp": row["grp"], "frame": row["frame"], "track": None if out["chosen"] is None else out["chosen"]["track"], "source": out["source"], "carried": out["carried"]}

    b = boxes(spark, sf_dir).groupBy("frame").agg(F.array_sort(F.collect_list(F.struct("det", "x1", "y1", "x2", "y2", "conf", "cls"))).alias("found"))
    stream = b.select((F.col("frame") % 50).alias("grp"), F.col("frame"), "found")
    return folds.fold(stream, "grp", "frame", lambda: None, step, "grp long, frame long, track long, source string, carried boolean")


#: Frames of 50 videos as what the model of lines would say: the surest box's corners, and how far the picture moved.
LINE_FRAMES = f"""{BOXES}, shown AS (SELECT frame % 50 AS grp, row_number() OVER (PARTITION BY frame % 50 ORDER BY frame) - 1 AS n, bool_or(cls = 0) AND frame % 4 > 0 AS anchored,
  CASE WHEN max(conf) > 0.6 THEN arg_max([x1, y1, x2, y2], (conf, -det)) END AS points, count(*) >= 6 AS ambiguous, frame % 11 = 0 AS mismatch, CASE WHEN frame % 5 > 0 THEN CAST(frame % 7 AS DOUBLE) - 3 END AS dx FROM boxes GROUP BY frame)"""
LINES = f"""WITH RECURSIVE {LINE_FRAMES}, s AS (
  SELECT grp, -1::BIGINT AS n, -1::BIGINT AS last_, -1::BIGINT AS age, []::DOUBLE[] AS at, false AS asked, false AS again, '' AS source, NULL::BIGINT AS out_age, false AS seeds, false AS lost, []::DOUBLE[] AS shown_at FROM shown WHERE n = 0
  UNION ALL SELECT grp, n, CASE WHEN anchored THEN n ELSE last_ END, CASE WHEN seeds THEN now ELSE -1 END, CASE WHEN seeds THEN found ELSE [] END, asked, again, source, CASE WHEN source <> 'none' THEN now END, seeds, age >= 0 AND source = 'none', found
  FROM (SELECT *, CASE source WHEN 'observed' THEN 0 WHEN 'propagated' THEN age + 1 ELSE -1 END AS now, CASE source WHEN 'observed' THEN points WHEN 'propagated' THEN moved ELSE []::DOUBLE[] END AS found, source = 'propagated' OR source = 'observed' AND NOT ambiguous AND NOT mismatch AS seeds
  FROM (SELECT *, CASE WHEN (asked OR again) AND points IS NOT NULL AND usable THEN 'observed' WHEN (NOT (asked OR again) OR points IS NULL) AND goes THEN 'propagated' ELSE 'none' END AS source
  FROM (SELECT *, NOT asked AND anchored AND NOT goes AS again
  FROM (SELECT f.*, s.last_, s.age, anchored OR s.age >= 0 OR s.last_ >= 0 AND f.n - s.last_ <= 8 AS usable, f.n % 3 = 0 AND usable AS asked, s.age >= 0 AND s.age < 12 AND dx IS NOT NULL AS goes, [s.at[1] + dx, s.at[2] + dx / 2, s.at[3] + dx, s.at[4] + dx / 2] AS moved FROM s JOIN shown f ON f.grp = s.grp AND f.n = s.n + 1)))))
"""


def said():
    """What the model of lines has of a frame's boxes, as aggregates; and from these the columns seen and shift."""
    surest = F.max_by(F.array("x1", "y1", "x2", "y2"), F.struct("conf", -F.col("det")))
    dx = (F.col("frame") % 7).cast("double") - 3
    seen = F.when(F.col("points").isNotNull(), F.struct("points", (F.col("_n") >= 6).alias("ambiguous"), (F.col("frame") % 11 == 0).alias("mismatch")))
    return [F.when(F.max("conf") > 0.6, surest).alias("points"), F.count(F.lit(1)).alias("_n")], [seen.alias("seen"), F.when(F.col("frame") % 5 > 0, F.array(dx, dx / 2)).alias("shift")]


def line_frames(spark, sf_dir):
    of_boxes, columns = said()
    f = boxes(spark, sf_dir).groupBy("frame").agg(F.bool_or(F.col("cls") == 0).alias("_any"), *of_boxes)
    place = F.row_number().over(W.partitionBy(F.col("frame") % 50).orderBy("frame")) - 1
    return f.select((F.col("frame") % 50).alias("grp"), place.cast("long").alias("frame"), (F.col("_any") & (F.col("frame") % 4 > 0)).alias("anchored"), *columns)


@query("win_line_carry", LINES + "SELECT grp, n AS frame, asked, again, source, out_age AS age, seeds, lost, round_even(shown_at[1], 6) AS x, round_even(shown_at[2], 6) AS y FROM s WHERE n >= 0")
def win_line_carry(spark, sf_dir):
    """The line of a video from frame to frame: when the model is asked, what is carried on and for how long."""
    return folds.carried_lines(line_frames(spark, sf_dir)).withColumn("x", F.bround("x", 6)).withColumn("y", F.bround("y", 6))


@query("flt_reacquire", LINES + "SELECT grp, n AS frame, again AS rerun, asked OR again AS consulted FROM s WHERE n >= 0")
def flt_reacquire(spark, sf_dir):
    """Frames on which the model is asked again, as an anchored one would be left without a line."""
    return folds.carried_lines(line_frames(spark, sf_dir)).select("grp", "frame", F.col("again").alias("rerun"), (F.col("asked") | F.col("again")).alias("consulted"))


@query("flt_seed", LINES + "SELECT grp, n AS frame, source <> 'none' AS found, seeds FROM s WHERE n >= 0")
def flt_seed(spark, sf_dir):
    """Lines that the next frame goes on from: neither ambiguous nor off the hand."""
    return folds.carried_lines(line_frames(spark, sf_dir)).select("grp", "frame", (F.col("source") != "none").alias("found"), "seeds")


def places(spark, sf_dir):
    """Frames with their places in their videos (50, by the frame's number), from 0. Only keys go through the order of a video, which
    one task has."""
    keys = read(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("frame")).distinct()
    return keys.select("frame", (F.row_number().over(W.partitionBy(F.col("frame") % 50).orderBy("frame")) - 1).cast("long").alias("place"))


def observations(spark, sf_dir):
    """Frames of 50 videos with what was detected, probabilities of labels, a share of foreground, and lines; every 13th comes twice."""
    found = F.array_sort(F.collect_list(F.struct("det", "x1", "y1", "x2", "y2", "conf", "cls")))
    of_boxes, columns = said()
    b = boxes(spark, sf_dir).groupBy("frame").agg(found.alias("found"), F.avg("conf").alias("conf"), *of_boxes).join(places(spark, sf_dir), "frame")
    rows = b.select((F.col("frame") % 50).alias("grp"), F.col("place").alias("frame"), F.filter("found", lambda d: (d["cls"] == 0) | (F.col("frame") % 9 > 2)).alias("found"), F.array(F.col("conf") + 0.2, F.when(F.col("frame") % 7 == 0, 1.5).otherwise(0.3), F.lit(0.1)).alias("probs"), (F.col("conf") / 10).alias("ratio"), *columns)
    return rows.select("*", F.explode(F.when(F.col("frame") % 13 == 0, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))).alias("_copy")).drop("_copy")


@query("topk_temporal_pick", f"""WITH {BOXES}, t AS (SELECT frame, frame % 50 AS grp, arg_max({{'x1': x1, 'y1': y1, 'x2': x2, 'y2': y2}}, (conf, -det)) AS top FROM boxes GROUP BY frame), p AS (SELECT frame, lag(top) OVER (PARTITION BY grp ORDER BY frame) AS was FROM t),
d AS (SELECT frame, det, conf, cls, sqrt(pow((x1 + x2) / 2 - (was.x1 + was.x2) / 2, 2) + pow((y1 + y2) / 2 - (was.y1 + was.y2) / 2, 2)) / greatest(1.0, sqrt(pow(was.x2 - was.x1, 2) + pow(was.y2 - was.y1, 2)), sqrt(pow(x2 - x1, 2) + pow(y2 - y1, 2))) AS far, count(*) OVER (PARTITION BY frame) AS n FROM boxes JOIN p USING (frame)),
s AS (SELECT *, CASE WHEN n > 1 AND far <= 2 THEN round_even(ln(greatest(conf, 1e-6)) - 1.5 * far, 9) END AS score FROM d)
SELECT frame, arg_max(det, (frame % 4 = 0 AND cls = 1, CASE WHEN frame % 4 = 0 AND cls = 1 THEN conf END IS NOT NULL, CASE WHEN frame % 4 = 0 AND cls = 1 THEN NULL ELSE score END IS NOT NULL, coalesce(CASE WHEN frame % 4 = 0 AND cls = 1 THEN NULL ELSE score END, conf), conf, -det)) AS det FROM s GROUP BY frame""")
def topk_temporal_pick(spark, sf_dir):
    """The preferred track, where a frame has one; else the best by confidence and nearness to the frame before; else the surest."""
    b = boxes(spark, sf_dir)
    top = b.groupBy("frame").agg(F.max_by(F.array("x1", "y1", "x2", "y2"), F.struct("conf", -F.col("det"))).alias("top"))
    was = F.lag("top").over(W.partitionBy(F.col("frame") % 50).orderBy("frame"))
    rows = b.join(top.select("frame", was.alias("was")), "frame").withColumn("preferred", (F.col("frame") % 4 == 0) & (F.col("cls") == 1))
    return S.temporal_pick(rows, "frame", "det", F.array("x1", "y1", "x2", "y2"), "conf", F.col("was"), F.col("preferred"))


@query("topk_nms", f"WITH RECURSIVE {KEPT} SELECT frame, d.det AS det FROM (SELECT frame, unnest(kept) AS d FROM kept)")
def topk_nms(spark, sf_dir):
    """Detections that stay: boxes of a frame by falling confidence, folded over an array of at most a frame's boxes."""
    from ..functions.geometry import bbox_iou

    one = F.struct((-F.col("conf")).alias("order"), "det", F.array("x1", "y1", "x2", "y2").alias("box"))
    b = boxes(spark, sf_dir).groupBy("frame").agg(F.array_sort(F.collect_list(one)).alias("found"))
    none = F.slice("found", 1, 0)
    kept = F.aggregate("found", none, lambda acc, d: F.when(F.exists(acc, lambda k: bbox_iou(k["box"], d["box"]) >= 0.35), acc).otherwise(F.concat(acc, F.array(d))))
    return b.select("frame", F.explode(kept).alias("d")).select("frame", F.col("d.det").alias("det"))


@query("join_iou_greedy", f"""WITH RECURSIVE {BOXES}, p AS (SELECT q.frame, q.det AS i, b.det AS j, {OVERLAP} AS iou FROM boxes q JOIN boxes b ON b.frame = q.frame AND b.cls = q.cls AND q.det % 2 = 1 AND b.det % 2 = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY frame ORDER BY iou DESC, i DESC, j DESC) AS k FROM p WHERE iou >= 0.1),
s AS (SELECT frame, k, i, j, iou, true AS taken, [i] AS left_, [j] AS right_ FROM r WHERE k = 1 UNION ALL SELECT r.frame, r.k, r.i, r.j, r.iou, free, CASE WHEN free THEN list_append(left_, r.i) ELSE left_ END, CASE WHEN free THEN list_append(right_, r.j) ELSE right_ END
  FROM (SELECT r.*, left_, right_, NOT list_contains(left_, r.i) AND NOT list_contains(right_, r.j) AS free FROM s JOIN r ON r.frame = s.frame AND r.k = s.k + 1) r)
SELECT frame, i AS det, j AS track, round_even(iou, 6) AS iou FROM s WHERE taken""")
def join_iou_greedy(spark, sf_dir):
    """Odd and even detections of a frame as detections and tracks, matched one to one."""
    import pandas as pd

    def run(batches):
        for batch in batches:
            rows = []
            for frame, found in zip(batch.frame, batch.found, strict=True):
                d, t = [x for x in found if x["det"] % 2], [x for x in found if not x["det"] % 2]
                four = lambda x: [x["x1"], x["y1"], x["x2"], x["y2"]]
                for i, j, overlap in folds.match([four(x) for x in d], [four(x) for x in t], lambda i, j: d[i]["cls"] == t[j]["cls"]):  # noqa: B023
                    rows.append((frame, d[i]["det"], t[j]["det"], overlap))
            yield pd.DataFrame(rows, columns=["frame", "det", "track", "iou"])

    b = boxes(spark, sf_dir).groupBy("frame").agg(F.array_sort(F.collect_list(F.struct("det", "x1", "y1", "x2", "y2", "cls"))).alias("found"))
    return b.mapInPandas(run, "frame long, det long, track long, iou double").withColumn("iou", F.bround("iou", 6))


@query("win_greedy_stratum")
def win_greedy_stratum(spark, sf_dir):
    """Eight vectors a label, far from each other: applyInPandas per label, whose rows are one video's candidates."""
    import numpy as np

    def choose(rows):
        rows = rows.assign(vector=[v / np.linalg.norm(v) for v in rows.embedding], bits=rows.frame * 2654435761 % (1 << 31))
        return folds.farthest_first(rows, 8, 3, 2)[["label", "frame"]]

    e = read(spark, sf_dir, "embeddings").select("label", F.col("vec_id").alias("frame"), "embedding")
    return e.groupBy("label").applyInPandas(choose, "label int, frame long")


@query("topk_components", "WITH r AS (SELECT lang, doc_id, row_number() OVER (PARTITION BY lang ORDER BY n_chars DESC, doc_id) AS rank FROM documents) SELECT * FROM r WHERE rank <= 8")
def topk_components(spark, sf_dir):
    d = read(spark, sf_dir, "documents")
    return reports.top_rows(d, ["lang"], [F.col("n_chars").desc(), F.col("doc_id")], 8).select("lang", "doc_id", "rank")


@query("topk_person_temporal", f"""WITH {BOXES}, t AS (SELECT frame, arg_max({{'x1': x1, 'y1': y1, 'x2': x2, 'y2': y2}}, (conf, -det)) AS top FROM boxes GROUP BY frame), p AS (SELECT frame, CASE WHEN frame % 3 <> 0 THEN lag(top) OVER (PARTITION BY frame % 50 ORDER BY frame) END AS q FROM t),
d AS (SELECT b.*, q, (x2 - x1) * (y2 - y1) AS area, y2 - y1 AS high, sqrt(pow((x1 + x2) / 2 - (q.x1 + q.x2) / 2, 2) + pow((y1 + y2) / 2 - (q.y1 + q.y2) / 2, 2)) AS apart, {OVERLAP} AS iou FROM boxes b JOIN p USING (frame)),
s AS (SELECT *, round_even(0.45 * area / greatest(1.0, max(area) OVER w) + 0.25 * least(1.0, conf) + 0.20 * high / greatest(1.0, max(high) OVER w) + 0.10 * greatest(0.0, 1 - (40 + 10 * det) / sqrt(640.0 * 640 + 360.0 * 360)), 9) AS cold, coalesce(iou >= 0.05 OR apart / sqrt(640.0 * 640 + 360.0 * 360) <= 0.12, false) AS near FROM d WINDOW w AS (PARTITION BY frame))
SELECT frame, arg_max(det, (near, CASE WHEN near THEN round_even(iou, 9) ELSE cold END, CASE WHEN near THEN -round_even(apart, 9) ELSE 0 END, cold, -det)) AS det, bool_or(near) AS temporal FROM s GROUP BY frame""")
def topk_person_temporal(spark, sf_dir):
    """The person who was followed, by overlap, then nearness, then the score of a cold start; without one near, by that score."""
    b = boxes(spark, sf_dir)
    top = b.groupBy("frame").agg(F.max_by(F.array("x1", "y1", "x2", "y2"), F.struct("conf", -F.col("det"))).alias("top"))
    was = F.when(F.col("frame") % 3 != 0, F.lag("top").over(W.partitionBy(F.col("frame") % 50).orderBy("frame")))
    rows = b.join(top.select("frame", was.alias("was")), "frame").withColumn("wrist", (F.lit(40) + 10 * F.col("det")).cast("double"))
    return S.person_pick(rows, "frame", "det", F.array("x1", "y1", "x2", "y2"), F.col("conf"), F.col("wrist"), F.col("was"), 640, 360)


@query("topk_person", f"WITH {BOXES} SELECT frame, arg_max(det, (round_even(0.45 * conf + 0.25 * (x1 / 60) + 0.20 * (y1 / 40) + 0.10 * cls, 9), -det)) AS det FROM boxes GROUP BY frame")
def topk_person(spark, sf_dir):
    score = F.bround(0.45 * F.col("conf") + 0.25 * (F.col("x1") / 60) + 0.20 * (F.col("y1") / 40) + 0.10 * F.col("cls"), 9)
    return boxes(spark, sf_dir).groupBy("frame").agg(F.max_by("det", F.struct(score, -F.col("det"))).alias("det"))


@query("topk_hard_negative", "WITH r AS (SELECT user_id, value, row_number() OVER (PARTITION BY user_id ORDER BY value DESC, event_id) AS n, count(*) OVER (PARTITION BY user_id) AS m FROM events) SELECT user_id, round_even(avg(value), 6) AS loss FROM r WHERE n <= greatest(64, floor(0.001 * m)) GROUP BY user_id")
def topk_hard_negative(spark, sf_dir):
    return reports.hard_negative_loss(read(spark, sf_dir, "events"), "user_id", "value", "event_id").select("user_id", F.bround("loss", 6).alias("loss"))


@query("lim_linspace", f"""WITH {FRAMES}, m AS (SELECT grp, count(*) AS n FROM frames GROUP BY grp) SELECT DISTINCT grp, unnest(list_transform(range(8), lambda i: CAST(floor(i * (n - 1) / 7) AS BIGINT))) AS frame FROM m""")
def lim_linspace(spark, sf_dir):
    n = frames(spark, sf_dir).groupBy("grp").agg(F.count(F.lit(1)).alias("n"))
    return n.select("grp", F.explode(reports.linspace_rows(F.col("n"), 8)).alias("frame"))


@query("lim_progressive", f"""WITH {FRAMES}, m AS (SELECT *, min(frame) OVER (PARTITION BY grp) AS lo, (max(frame) OVER (PARTITION BY grp) - min(frame) OVER (PARTITION BY grp) + 1) / 4 AS w FROM frames), s AS (SELECT grp, frame, lo, w, least(CAST(floor((frame - lo) / w) AS BIGINT), 3) AS stratum FROM m)
SELECT grp, frame, stratum, row_number() OVER (PARTITION BY grp, stratum ORDER BY abs(frame - (lo + (stratum + 0.5) * w)), frame) AS round FROM s""")
def lim_progressive(spark, sf_dir):
    return reports.progressive_rounds(frames(spark, sf_dir), "frame", 4, "grp").select("grp", "frame", "stratum", "round")


@query("lim_max_records", "SELECT event_id FROM events ORDER BY ts, event_id LIMIT 20")
def lim_max_records(spark, sf_dir):
    return read(spark, sf_dir, "events").orderBy("ts", "event_id").limit(20).select("event_id")


@query("ord_samples", "SELECT doc_id, row_number() OVER (PARTITION BY lang ORDER BY source, doc_id) AS place FROM documents")
def ord_samples(spark, sf_dir):
    return read(spark, sf_dir, "documents").select("doc_id", F.row_number().over(W.partitionBy("lang").orderBy("source", "doc_id")).alias("place"))


@query("ord_frames", f"WITH {FRAMES} SELECT grp, frame, event_id FROM frames ORDER BY grp, frame")
def ord_frames(spark, sf_dir):
    return frames(spark, sf_dir).select("grp", "frame", "event_id").orderBy("grp", "frame")


@query("ord_handoff", f"WITH {BOXES} SELECT frame, det, CASE WHEN conf > 0.8 THEN 0 WHEN cls = 1 THEN 1 ELSE 2 END AS rank FROM boxes ORDER BY rank, frame, det")
def ord_handoff(spark, sf_dir):
    rank = F.when(F.col("conf") > 0.8, 0).when(F.col("cls") == 1, 1).otherwise(2)
    return boxes(spark, sf_dir).select("frame", "det", rank.alias("rank")).orderBy("rank", "frame", "det")


@query("ord_sessions", "SELECT o_orderkey, o_orderdate FROM orders WHERE o_orderstatus <> 'P' ORDER BY o_orderdate DESC, o_orderkey")
def ord_sessions(spark, sf_dir):
    return read(spark, sf_dir, "orders").where("o_orderstatus <> 'P'").select("o_orderkey", "o_orderdate").orderBy(F.col("o_orderdate").desc(), "o_orderkey")
