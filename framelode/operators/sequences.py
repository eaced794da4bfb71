"""Ordered operators per group: runs, streaks, recoveries, switches, motion, carry-forward and rolling gates.

All are windows over (group, frame), so their partitions are groups. The operators that let a run cross a group's edge
work on groups first and join the edges of neighbouring groups in a second pass over one row a group.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions.geometry import bbox_center, bbox_diagonal, bbox_iou, distance
from ..scratch import settle


def ordered(group: str = "grp", frame: str = "frame", backward: bool = False):
    return W.partitionBy(group).orderBy(F.desc(frame) if backward else frame)


def islands(df: DataFrame, condition: Column, group: str = "grp", frame: str = "frame") -> DataFrame:
    """df with hit (the condition, null as false) and island: a number shared by the rows of a run of equal hit in a group."""
    w = ordered(group, frame)
    df = df.withColumn("hit", F.coalesce(condition, F.lit(False)))
    change = F.when(F.col("hit") != F.coalesce(F.lag("hit").over(w), ~F.col("hit")), 1).otherwise(0)
    return df.withColumn("_change", change).withColumn("island", F.sum("_change").over(w.rowsBetween(W.unboundedPreceding, 0))).drop("_change")


def in_ranges(rows: DataFrame, key: str) -> DataFrame:
    """rows with _range: numbers of ranges of the key, in its order; written, so that every reader sees the same ranges."""
    return settle(rows.repartitionByRange(key).withColumn("_range", F.spark_partition_id()), "ranges")


def scanned(ranges: DataFrame, columns: list[str], start: Column, step: Callable[[Column, Column], Column]) -> DataFrame:
    """_range and _in: for each range what step (state, row) has made of start over the ranges before it.

    ranges has one row a range, so at most one for each task of a shuffle: they are folded as one array.
    """
    listed = ranges.agg(F.array_sort(F.collect_list(F.struct("_range", *columns))).alias("_all"))
    out = F.filter(F.array(F.struct(F.lit(0).alias("_range"), start.alias("_in"))), lambda r: F.lit(False))
    first = F.struct(start.alias("state"), out.alias("out"))
    fold = F.aggregate("_all", first, lambda acc, r: F.struct(step(acc["state"], r).alias("state"), F.concat(acc["out"], F.array(F.struct(r["_range"].alias("_range"), acc["state"].alias("_in")))).alias("out")))
    return listed.select(F.inline(fold["out"]))


def missing_streak(df: DataFrame, target: Column, prediction: Column, group: str = "grp", frame: str = "frame", per_group: bool = False) -> DataFrame:
    """longest and episodes of runs in which the target is there and the prediction isn't; rows with an unknown target are removed first.

    A run goes on from the end of a group to the start of the next in the order of groups, unless per_group. Each group is
    reduced to the lengths of its first, last, longest and whole run; these rows are scanned in ranges of groups, each by
    itself, then from range to range, so no task sees them all.
    """
    known = df.where(target.isNotNull()).withColumn("_missing", target & ~F.coalesce(prediction, F.lit(False)))
    runs = islands(known, F.col("_missing"), group, frame).groupBy(group, "island").agg(F.count(F.lit(1)).alias("n"), F.first("hit").alias("hit"))
    size = F.sum("n")
    groups = runs.groupBy(group).agg(
        size.alias("rows"), F.coalesce(F.max(F.when(F.col("hit"), F.col("n"))), F.lit(0)).alias("longest"), F.coalesce(F.sum(F.col("hit").cast("long")), F.lit(0)).alias("episodes"),
        F.coalesce(F.max(F.when(F.col("hit") & (F.col("island") == 1), F.col("n"))), F.lit(0)).alias("head"), F.max_by(F.when(F.col("hit"), F.col("n")).otherwise(0), "island").alias("tail"),
    )
    if per_group:
        return groups.agg(F.coalesce(F.max("longest"), F.lit(0)).alias("longest"), F.coalesce(F.sum("episodes"), F.lit(0)).alias("episodes"))
    # a chain of groups that are missing throughout carries the tail of the group before, within a range and into the next
    groups = in_ranges(groups.withColumn("_whole", F.col("rows") == F.col("tail")), group)
    w = W.partitionBy("_range").orderBy(group)
    part = F.coalesce(F.sum(F.when(F.col("_whole"), 0).otherwise(1)).over(w.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    groups = groups.withColumn("_part", part).withColumn("_before", F.coalesce(F.lag(F.when(F.col("_whole"), F.lit(0)).otherwise(F.col("tail"))).over(w), F.lit(0)))
    own = W.partitionBy("_range", "_part").orderBy(group)
    carried = F.coalesce(F.sum("tail").over(own.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    groups = groups.withColumn("_carry", carried + F.first("_before").over(own.rowsBetween(W.unboundedPreceding, 0)))
    ends = groups.groupBy("_range").agg(F.min("_whole").alias("whole"), F.max_by(F.col("tail") + F.when(F.col("_whole"), F.col("_carry")).otherwise(0), group).alias("end"))
    into = scanned(ends, ["whole", "end"], F.lit(0).cast("long"), lambda state, r: r["end"] + F.when(r["whole"], state).otherwise(0))
    groups = groups.join(into, "_range").withColumn("_carry", F.col("_carry") + F.when(F.col("_part") == 0, F.col("_in")).otherwise(0))
    joined = F.when((F.col("head") > 0) & (F.col("_carry") > 0), 1).otherwise(0)
    return groups.agg(
        F.coalesce(F.greatest(F.max("longest"), F.max(F.when(F.col("head") > 0, F.col("head") + F.col("_carry")).otherwise(0))), F.lit(0)).alias("longest"),
        F.coalesce(F.sum(F.col("episodes") - joined), F.lit(0)).alias("episodes"),
    )


def recovery(df: DataFrame, target: Column, prediction: Column, group: str = "grp", frame: str = "frame") -> DataFrame:
    """recovered, unrecovered and latency_sum of missing runs per group: a run is recovered if the row after it has target and
    prediction, and then took as many rows as it has; one that ends with the target or the group is not."""
    known = df.where(target.isNotNull()).withColumn("_t", target).withColumn("_p", F.coalesce(prediction, F.lit(False)))
    runs = islands(known, F.col("_t") & ~F.col("_p"), group, frame)
    after = F.lead(F.col("_t") & F.col("_p")).over(ordered(group, frame))
    ends = runs.withColumn("_after", after).groupBy(group, "island").agg(F.first("hit").alias("hit"), F.count(F.lit(1)).alias("n"), F.max_by("_after", frame).alias("back")).where("hit")
    back = F.coalesce(F.col("back"), F.lit(False))
    return ends.agg(F.count_if(back).alias("recovered"), F.count_if(~back).alias("unrecovered"), F.coalesce(F.sum(F.when(back, F.col("n"))), F.lit(0)).alias("latency_sum"))


def track_switches(df: DataFrame, track: str, group: str = "grp", frame: str = "frame") -> DataFrame:
    """switches between successive known ids of a group, and distinct (group, id)."""
    known = df.where(F.col(track).isNotNull())
    changed = known.withColumn("_was", F.lag(track).over(ordered(group, frame)))
    return changed.agg(F.count_if(F.col("_was") != F.col(track)).alias("switches"), F.count_distinct(group, track).alias("tracks"))


def switch_count(df: DataFrame, label: str, group: str = "grp", frame: str = "frame") -> DataFrame:
    """Per group, unequal neighbours of a label."""
    changed = df.withColumn("_was", F.lag(label).over(ordered(group, frame)))
    return changed.groupBy(group).agg(F.count_if(F.col("_was") != F.col(label)).alias("switches"))


def isolated_flips(df: DataFrame, target: str, prediction: str, group: str = "grp", frame: str = "frame") -> DataFrame:
    """Per group, predictions unlike both neighbours, which agree, while the target holds over all three."""
    w = ordered(group, frame)
    t, p = F.col(target), F.col(prediction)
    flip = (F.lag(p).over(w) == F.lead(p).over(w)) & (F.lag(p).over(w) != p) & (F.lag(t).over(w) == t) & (F.lead(t).over(w) == t)
    return df.withColumn("_flip", flip).groupBy(group).agg(F.count_if("_flip").alias("flips"))


def transition_latency(df: DataFrame, target: str, prediction: str, group: str = "grp", frame: str = "frame") -> DataFrame:
    """One row for each change of the target: latency in frames until the prediction first has the new label, before the next
    change; null if it never has."""
    w = ordered(group, frame)
    change = F.when(F.lag(target).over(w) != F.col(target), 1).otherwise(0)
    numbered = df.withColumn("_c", change).withColumn("segment", F.sum("_c").over(w.rowsBetween(W.unboundedPreceding, 0))).where("segment > 0")
    hit = F.min(F.when(F.col(prediction) == F.col(target), F.col(frame)))
    return numbered.groupBy(group, "segment").agg((hit - F.min(frame)).alias("latency"))


def motion_errors(df: DataFrame, tx: str, ty: str, px: str, py: str, group: str = "grp", frame: str = "frame", resets: bool = True) -> DataFrame:
    """df with velocity and acceleration errors: distances between target's and prediction's first and second differences.

    A row without one of the two resets both. With resets a group is on its own; without, the rows before in the order of
    (group, frame) count whatever their group: the last two rows of each group are scanned in ranges of groups and from range
    to range, and what precedes a group joins its first two rows.
    """
    w = ordered(group, frame)
    valid = F.col(tx).isNotNull() & F.col(ty).isNotNull() & F.col(px).isNotNull() & F.col(py).isNotNull()
    df = df.withColumn("_dx", F.when(valid, F.col(px) - F.col(tx))).withColumn("_dy", F.when(valid, F.col(py) - F.col(ty)))
    if resets:
        one = lambda c: F.lag(c, 1).over(w)
        two = lambda c: F.lag(c, 2).over(w)
    else:
        numbered = df.withColumn("_n", F.row_number().over(w)).withColumn("_back", F.row_number().over(ordered(group, frame, True)))
        ends = numbered.where("_back <= 2").groupBy(F.col(group).alias("_of")).agg(*[F.max(F.when(F.col("_back") == k, F.struct("_dx", "_dy"))).alias(f"_e{k}") for k in (1, 2)])
        ends = in_ranges(ends, "_of")
        order = W.partitionBy("_range").orderBy("_of")
        ends = ends.withColumn("_two", F.coalesce("_e2", F.lag("_e1").over(order))).withColumn("_k", F.row_number().over(order))
        last = ends.groupBy("_range").agg(F.max_by(F.struct("_e1", "_two"), "_of").alias("last")).select("_range", "last.*")
        none = F.lit(None).cast("struct<_dx:double,_dy:double>")
        start = F.struct(none.alias("p1"), none.alias("p2"))
        into = scanned(last, ["_e1", "_two"], start, lambda state, r: F.struct(r["_e1"].alias("p1"), F.coalesce(r["_two"], state["p1"]).alias("p2")))
        ends = ends.join(into, "_range").withColumns({"_p1": F.lag("_e1").over(order), "_p2": F.coalesce(F.lag("_e2").over(order), F.lag("_e1", 2).over(order))})
        before = ends.select("_of", F.when(F.col("_k") == 1, F.col("_in.p1")).otherwise(F.col("_p1")).alias("_p1"), F.when(F.col("_k") == 1, F.col("_in.p2")).when(F.col("_k") == 2, F.coalesce("_p2", "_in.p1")).otherwise(F.col("_p2")).alias("_p2"))
        df = numbered.join(before, F.col(group) == F.col("_of"))
        one = lambda c: F.when(F.col("_n") == 1, F.col(f"_p1.{c}")).otherwise(F.lag(c, 1).over(w))
        two = lambda c: F.when(F.col("_n") == 1, F.col(f"_p2.{c}")).when(F.col("_n") == 2, F.col(f"_p1.{c}")).otherwise(F.lag(c, 2).over(w))
    # differences of the errors are errors of the differences
    vx, vy = F.col("_dx") - one("_dx"), F.col("_dy") - one("_dy")
    ax, ay = F.col("_dx") - 2 * one("_dx") + two("_dx"), F.col("_dy") - 2 * one("_dy") + two("_dy")
    return df.withColumn("velocity_error", F.sqrt(vx * vx + vy * vy)).withColumn("acceleration_error", F.sqrt(ax * ax + ay * ay)).drop("_dx", "_dy")


def string_motion(df: DataFrame, x: str, y: str, length: str, px: str, py: str, plength: str, group: str = "grp", frame: str = "frame") -> DataFrame:
    """Errors of centroid velocity and of change of length between rows of a group whose frames follow each other."""
    w = ordered(group, frame)
    next_frame = F.col(frame) - F.lag(frame).over(w) == 1
    step = lambda c: F.col(c) - F.lag(c).over(w)
    ex, ey = step(px) - step(x), step(py) - step(y)
    return df.withColumn("velocity_error", F.when(next_frame, F.sqrt(ex * ex + ey * ey))).withColumn("length_error", F.when(next_frame, F.abs(step(plength) - step(length))))


def speed(df: DataFrame, x: str, y: str, fps: float, group: str = "grp", frame: str = "frame") -> DataFrame:
    """Displacement from the row before times fps; 0 without one."""
    w = ordered(group, frame)
    dx, dy = F.col(x) - F.lag(x).over(w), F.col(y) - F.lag(y).over(w)
    return df.withColumn("speed", F.coalesce(F.sqrt(dx * dx + dy * dy) * fps, F.lit(0.0)))


def carry_forward(df: DataFrame, value: Column, name: str, group: str = "grp", frame: str = "frame") -> DataFrame:
    """The last value that isn't null, and its age in frames."""
    w = ordered(group, frame).rowsBetween(W.unboundedPreceding, 0)
    seen = F.last(F.when(value.isNotNull(), F.col(frame)), ignorenulls=True).over(w)
    return df.withColumn(name, F.last(value, ignorenulls=True).over(w)).withColumn(f"{name}_age", F.col(frame) - seen)


def last_seen(df: DataFrame, visible: Column, clipped: Column, group: str = "grp", frame: str = "frame") -> DataFrame:
    """last_seen_frame, missing_streak (rows since, all rows if never seen) and likely_out (missing, and clipped when last seen)."""
    w = ordered(group, frame).rowsBetween(W.unboundedPreceding, 0)
    shown = F.coalesce(visible, F.lit(False))
    df = df.withColumn("last_seen_frame", F.last(F.when(shown, F.col(frame)), ignorenulls=True).over(w))
    number = F.row_number().over(ordered(group, frame))
    df = df.withColumn("_n", number).withColumn("_at", F.last(F.when(shown, F.col("_n")), ignorenulls=True).over(w))
    df = df.withColumn("missing_streak", (F.col("_n") - F.coalesce("_at", F.lit(0))).cast("long"))
    edge = F.last(F.when(shown, clipped), ignorenulls=True).over(w)
    return df.withColumn("likely_out", (F.col("missing_streak") > 0) & F.coalesce(edge, F.lit(False))).drop("_n", "_at")


def grace_gate(df: DataFrame, visible: Column, fps: float, group: str = "grp", frame: str = "frame") -> DataFrame:
    """allowed: the last frame seen is at most max(2, round(fps / 4)) frames ago."""
    w = ordered(group, frame).rowsBetween(W.unboundedPreceding, 0)
    seen = F.last(F.when(visible, F.col(frame)), ignorenulls=True).over(w)
    return df.withColumn("allowed", F.coalesce(F.col(frame) - seen <= max(2, round(0.25 * fps)), F.lit(False)))


def propagation_age(df: DataFrame, fresh: Column, most: int = 12, group: str = "grp", frame: str = "frame") -> DataFrame:
    """Rows since the last fresh one; null before the first and beyond `most`."""
    w = ordered(group, frame)
    df = df.withColumn("_n", F.row_number().over(w))
    at = F.last(F.when(fresh, F.col("_n")), ignorenulls=True).over(w.rowsBetween(W.unboundedPreceding, 0))
    age = (F.col("_n") - at).cast("long")
    return df.withColumn("age", F.when(age <= most, age)).drop("_n")


def rolling_gate(df: DataFrame, accepted: Column, confidence: Column, ratio: Column, window: int = 12, most_accepts: int = 0, confidence_below: float = 0.82, ratio_above: float = 0.018, group: str = "grp", frame: str = "frame") -> DataFrame:
    """fires where the last `window` rows are all there, accept at most so often, are less sure than the limit on average and
    farther than the limit; latched on all rows of the group after the first that fires."""
    w = ordered(group, frame).rowsBetween(1 - window, 0)
    fires = (F.count(F.lit(1)).over(w) == window) & (F.sum(accepted.cast("int")).over(w) <= most_accepts) & (F.avg(confidence).over(w) < confidence_below) & (F.avg(ratio).over(w) > ratio_above)
    df = df.withColumn("fires", fires)
    first = F.min(F.when(F.col("fires"), F.col(frame))).over(W.partitionBy(group))
    return df.withColumn("latched", F.coalesce(F.col(frame) > first, F.lit(False)))


def adaptive_route(df: DataFrame, gated: list[Column], native: float, adapted: float, adapted_below: float, single_below: float, window: int = 12, group: str = "grp", frame: str = "frame", **limits: float) -> DataFrame:
    """df with fires, latched (see rolling_gate; gated: accepted, confidence, ratio), mean, route and threshold.

    mean is that of the confidence over the window that fires first. Up to the latch the route is `ensemble` with the native
    threshold; after it the threshold is the adapted one if mean is below adapted_below, and the route is `single` if
    mean is below single_below, which has to be over 0, else `adaptive_ensemble`.
    """
    out = rolling_gate(df, *gated, window=window, group=group, frame=frame, **limits)
    out = out.withColumn("_mean", F.avg(gated[1]).over(ordered(group, frame).rowsBetween(1 - window, 0)))
    first = F.min_by("_mean", F.when(F.col("fires"), F.col(frame))).over(W.partitionBy(group))
    out = out.withColumn("mean", first).drop("_mean")
    single = F.lit(single_below > 0) & (F.col("mean") < single_below)
    route = F.when(~F.col("latched"), "ensemble").when(single, "single").otherwise("adaptive_ensemble")
    return out.withColumn("route", route).withColumn("threshold", F.when(F.col("latched") & (F.col("mean") < adapted_below), adapted).otherwise(native))


def interval_frames(df: DataFrame, time: Column, fps: float, group: str = "grp", frame: str = "frame") -> DataFrame:
    """Per group, rows between observations at fps: the source's rate is 1 / median positive step of time; 1 at least."""
    step = time - F.lag(time).over(ordered(group, frame))
    steps = df.withColumn("_step", step)
    source = F.coalesce(1 / F.percentile(F.when(F.col("_step") > 0, F.col("_step")), 0.5), F.lit(fps))
    return steps.groupBy(group).agg(F.greatest(F.lit(1), F.bround(source / fps, 0).cast("long")).alias("interval")) if fps > 0 else df.groupBy(group).agg(F.lit(1).cast("long").alias("interval"))


def dense_run(df: DataFrame, blocked: Column, size: int, group: str = "grp", frame: str = "frame", position: str = "front") -> DataFrame:
    """Per group, the start of the first run of `size` successive frames without a blocked one: from the front, the back or
    the middle out."""
    w = ordered(group, frame).rowsBetween(0, size - 1)
    free = (F.count(F.lit(1)).over(w) == size) & (F.sum(F.coalesce(blocked, F.lit(False)).cast("int")).over(w) == 0) & (F.max(frame).over(w) - F.min(frame).over(w) == size - 1)
    starts = df.withColumn("_free", free).withColumn("_centre", (F.min(frame).over(W.partitionBy(group)) + F.max(frame).over(W.partitionBy(group)) - size + 1) / 2).where("_free")
    order = {"front": F.col(frame).cast("double"), "back": -F.col(frame).cast("double"), "middle": F.abs(F.col(frame) - F.col("_centre"))}[position]
    return starts.groupBy(group).agg(F.min_by(F.col(frame), F.struct(order, F.col(frame))).alias("start"))


def group_build(df: DataFrame, group: str = "grp", frame: str = "frame") -> DataFrame:
    """One row a group: first and last frame, number of frames, and whether they follow each other without a gap or repeat."""
    a, b, n = F.min(frame), F.max(frame), F.count(F.lit(1))
    return df.groupBy(group).agg(a.alias("first_frame"), b.alias("last_frame"), n.alias("frames"), ((b - a + 1 == n) & (F.count_distinct(frame) == n)).alias("consecutive"))


def propagate_edit(df: DataFrame, edits: DataFrame, column: str, group: str = "grp", frame: str = "frame") -> DataFrame:
    """column as the last edit at or before each frame says (edits: group, frame, value), else as it was."""
    both = df.join(edits.select(group, frame, F.col("value").alias("_edit")), [group, frame], "left")
    last = F.last("_edit", ignorenulls=True).over(ordered(group, frame).rowsBetween(W.unboundedPreceding, 0))
    return both.withColumn(column, F.coalesce(last, F.col(column))).drop("_edit")


def signature_events(df: DataFrame, signature: list[str], group: str = "grp", frame: str = "frame") -> DataFrame:
    """Rows whose signature differs from the row before's, and the first and last row of a group."""
    w = ordered(group, frame)
    changed = ~F.struct(*signature).eqNullSafe(F.lag(F.struct(*signature)).over(w))
    edge = F.row_number().over(w) == 1
    last = F.lead(F.lit(1)).over(w).isNull()
    return df.withColumn("_event", changed | edge | last).where("_event").drop("_event")


def context_frames(anchors: DataFrame, offsets: list[int], last: DataFrame, group: str = "grp", frame: str = "frame") -> DataFrame:
    """Frames at offsets around anchors, inside 0..last_frame, that aren't anchors; of several anchors the first in order owns one."""
    around = anchors.withColumn("_o", F.explode(F.array(*[F.lit(o) for o in offsets]))).withColumn("context", F.col(frame) + F.col("_o"))
    inside = around.join(last, group).where((F.col("context") >= 0) & (F.col("context") <= F.col("last_frame")))
    other = inside.join(anchors.select(group, F.col(frame).alias("context")), [group, "context"], "left_anti")
    return other.groupBy(group, "context").agg(F.min(frame).alias("anchor"))


def temporal_pick(df: DataFrame, frame: str, det: str, box: Column, confidence: str, before: Column, preferred: Column) -> DataFrame:
    """frame and the detection that is followed: a preferred one, the surest if there are several; else, with a box before, that
    with the best log confidence less 1.5 times its distance in diagonals, of those not over two diagonals away; else the surest."""
    far = distance(bbox_center(box), bbox_center(before)) / F.greatest(F.lit(1.0), bbox_diagonal(before), bbox_diagonal(box))
    several = F.count(F.lit(1)).over(W.partitionBy(frame)) > 1
    rows = df.withColumn("_far", far).withColumn("_several", several).withColumn("_mine", preferred)
    near = F.when(~F.col("_mine") & F.col("_several") & (F.col("_far") <= 2), F.bround(F.log(F.greatest(F.col(confidence), F.lit(1e-6))) - 1.5 * F.col("_far"), 9))
    rank = F.struct(F.col("_mine"), near.isNotNull(), F.coalesce(near, F.col(confidence)), F.col(confidence), -F.col(det))
    return rows.groupBy(frame).agg(F.max_by(det, rank).alias(det))


def person_pick(df: DataFrame, frame: str, person: str, box: Column, confidence: Column, wrist: Column, before: Column, width: int, height: int) -> DataFrame:
    """frame, the person chosen and whether by continuity.

    Among persons that overlap the box before (0.05) or whose centre is within 0.12 diagonals of it, the best by overlap, then
    nearness, then cold-start score; if there are none, the best by this score: 0.45 of the area and 0.20 of the height,
    relative to the frame's largest, 0.25 of the pose's confidence, 0.10 of the nearness of a wrist to the toy.
    """
    diag = float((width * width + height * height) ** 0.5)
    rows = df.withColumn("_b", box).withColumn("_w", F.greatest(F.lit(0.0), F.col("_b")[2] - F.col("_b")[0])).withColumn("_h", F.greatest(F.lit(0.0), F.col("_b")[3] - F.col("_b")[1]))
    most = lambda c: F.greatest(F.lit(1.0), F.max(c).over(W.partitionBy(frame)))
    area = F.col("_w") * F.col("_h")
    near_toy = F.greatest(F.lit(0.0), 1 - F.coalesce(wrist, F.lit(diag)) / diag)
    rows = rows.withColumn("_cold", F.bround(0.45 * area / most(area) + 0.25 * F.least(F.lit(1.0), confidence) + 0.20 * F.col("_h") / most("_h") + 0.10 * near_toy, 9))
    rows = rows.withColumn("_iou", bbox_iou(F.col("_b"), before)).withColumn("_far", distance(bbox_center(F.col("_b")), bbox_center(before)))
    near = F.coalesce((F.col("_iou") >= 0.05) | (F.col("_far") / diag <= 0.12), F.lit(False)) & before.isNotNull()
    rows = rows.withColumn("_near", near)
    rank = F.struct("_near", F.when(F.col("_near"), F.bround("_iou", 9)).otherwise(F.col("_cold")).alias("a"), F.when(F.col("_near"), -F.bround("_far", 9)).otherwise(0.0).alias("b"), "_cold", -F.col(person))
    return rows.groupBy(frame).agg(F.max_by(person, rank).alias(person), F.bool_or("_near").alias("temporal"))
