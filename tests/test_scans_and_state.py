"""Ranges, batch folds, streams, masks, tables and workbench rules against plain code."""

import collections
import random
from collections import deque

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from framelode.functions import raster, tables
from framelode.functions import geometry as G
from framelode.operators import dedup, folds, sequences, workbench
from framelode.streaming import sinks, stateful

RNG = random.Random(4)


@pytest.fixture
def many_ranges(spark):
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    yield
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


@pytest.mark.parametrize("share", [0.3, 0.8, 0.97])
def test_order_across_groups_in_many_ranges(spark, many_ranges, share):
    rows = [(g, k, RNG.random() < 0.9 or None, RNG.random() > share, RNG.choice([None, 1.0, 2.0, 3.5]), RNG.random()) for g in range(40) for k in range(RNG.randint(1, 3))]
    df = spark.createDataFrame(rows, "grp long, frame long, t boolean, p boolean, px double, x double")
    longest = episodes = now = 0
    for _, _, t, p, _, _ in rows:
        if t is not None:
            now = now + 1 if not p else 0
            episodes += now == 1
            longest = max(longest, now)
    assert tuple(sequences.missing_streak(df, F.col("t"), F.col("p")).first()) == (longest, episodes)
    plan = sequences.missing_streak(df, F.col("t"), F.col("p"))._jdf.queryExecution().toString()
    assert "Window" in plan and not [line for line in plan.splitlines() if line.strip(" :+-").startswith("Window [") and "[" not in line.split("], [", 1)[-1]]
    error = [None if px is None else px - x for *_, px, x in rows]
    found = {(r.grp, r.frame): (r.velocity_error, r.acceleration_error) for r in sequences.motion_errors(df.withColumn("y", F.lit(0.0)).withColumn("py", F.lit(0.0)), "x", "y", "px", "py", resets=False).collect()}
    for i, (g, k, *_) in enumerate(rows):
        last = [error[j] if j >= 0 else None for j in (i, i - 1, i - 2)]
        v = None if None in last[:2] else abs(last[0] - last[1])
        a = None if None in last else abs(last[0] - 2 * last[1] + last[2])
        assert found[g, k] == (pytest.approx(v), pytest.approx(a))


def test_folds_of_whole_batches_are_those_row_by_row(spark):
    rows = [(g if g else None, k, [RNG.random() ** 3 + 1e-3 for _ in range(3)]) for g in range(12) for k in range(RNG.choice([1, 5, 60]))]
    df = spark.createDataFrame(rows, "grp long, frame long, probs array<double>")
    size = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    try:
        for batch in ("7", size):
            spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", batch)
            smooth = {(r.grp, r.frame): (r.label, r.confidence, r.raw_label, r.status) for r in folds.smoothed(df).collect()}
            paced = {(r.grp, r.frame): (r.label, r.observed, r.burst) for r in folds.cadence(df, 10, 2).collect()}
            states = collections.defaultdict(lambda: (None, None))
            for g, k, p in rows:
                one, two = states[g]
                one, out = folds.smooth(one, p)
                two, seen = folds.observe(two, p, 10, 2, 4, 0.6)
                states[g] = one, two
                assert smooth[g, k] == (out["label"], pytest.approx(out["confidence"], abs=2e-6), out["raw_label"], out["status"])
                assert paced[g, k] == (seen["label"], seen["observed"], seen["burst"])
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", size)
    assert folds.smoothed(df.limit(0)).count() == 0
    with pytest.raises(Exception, match="not all zero"):
        folds.smoothed(spark.createDataFrame([(1, 1, [0.0, 0.0, 0.0])], df.schema)).collect()


LOOP_ROWS = "grp long, frame long, found array<struct<x1:double,y1:double,x2:double,y2:double,conf:double,cls:long>>, probs array<double>, ratio double, seen struct<points:array<double>,ambiguous:boolean,mismatch:boolean>, shift array<double>"


def loop_rows(n):
    box = lambda: (RNG.random() * 50, RNG.random() * 50, 60 + RNG.random() * 9, 60 + RNG.random() * 9, RNG.random(), RNG.randint(0, 2))
    return [(g, k, [box() for _ in range(RNG.randint(0, 3))], [RNG.random() + 0.01 for _ in range(3)], RNG.random(), ([1.0, 2.0, 3.0, 4.0], RNG.random() < 0.2, RNG.random() < 0.2) if RNG.random() < 0.5 else None, [0.5, 1.0] if RNG.random() < 0.8 else None) for g in range(3) for k in range(n)]


def test_the_loop_carries_its_states_from_batch_to_batch(spark, tmp_path):
    rows = loop_rows(24)
    how = stateful.LoopPolicy(confidence_below=0.95, ratio_above=0.0, window=4)
    replay = collections.Counter(map(tuple, stateful.frame_loop_replay(spark.createDataFrame(rows, LOOP_ROWS), how).collect()))
    for part in range(3):  # the last batch brings some frames of the first again
        some = [r for r in rows if r[1] // 8 == part] + ([r for r in rows if r[1] in (2, 5)] if part == 2 else [])
        spark.createDataFrame(some, LOOP_ROWS).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(LOOP_ROWS).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    query = stateful.frame_loop(stream, how).writeStream.format("parquet").option("checkpointLocation", f"{tmp_path}/c").trigger(availableNow=True).start(f"{tmp_path}/out")
    query.awaitTermination()
    found = spark.read.schema(stateful.LOOP).parquet(f"{tmp_path}/out")
    assert collections.Counter(map(tuple, found.where("not late").collect())) == replay
    assert sorted((r.grp, r.frame) for r in found.where("late").collect()) == [(g, k) for g in range(3) for k in (2, 5)]


def test_a_line_is_asked_for_carried_and_lost():
    seen = {"points": [1.0, 1.0], "ambiguous": False, "mismatch": False}
    how = folds.StringPolicy(interval=3, grace=2, longest=2)
    state, out = folds.carry_line(None, 0, False, seen, [0.0, 0.0], how)
    assert not out["asked"] and out["source"] == "none"  # nothing to tie an answer to
    state, out = folds.carry_line(state, 1, True, None, [1.0, 2.0], how)
    assert out["again"] and out["source"] == "none"
    state, out = folds.carry_line(state, 2, True, seen, [1.0, 2.0], how)
    assert out["again"] and out["source"] == "observed"
    state, out = folds.carry_line((4, *state[1:]), 3, True, None, [1.0, 2.0], how)
    assert (out["source"], out["age"], out["x"], out["y"]) == ("propagated", 1, 2.0, 3.0)
    state, out = folds.carry_line(state, 4, False, None, None, how)
    assert out["lost"] and state[2] == -1
    state, out = folds.carry_line((3, *state[1:]), 9, False, seen, None, how)
    assert not out["asked"]  # beyond the grace
    state, out = folds.carry_line((3, 8, -1, []), 9, False, seen | {"ambiguous": True}, None, how)
    assert out["source"] == "observed" and not out["seeds"] and state[2] == -1


def test_reviews_are_appended_once_and_judged(spark, tmp_path):
    names = ", ".join(f"{c} {'long' if c in ('frame_index', 'gallery_index') else 'string'}" for c in sinks.BOUND)
    gallery = spark.createDataFrame([("r", "m", k, f"d{k}", k, "raw", f"{k}.png") for k in range(5)], names)
    said = [("r", "m", k, "old" if k == 3 else f"d{k}", k, "raw", f"{k}.png", d, who, None) for k, d, who in ((0, "correct", " a "), (1, "maybe", "a"), (2, "correct", " "), (3, "correct", "a"), (4, None, "a"), (9, "correct", "a"))]
    for row in said:
        spark.createDataFrame([row], names + ", decision string, reviewer string, notes string").coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    kinds = spark.read.parquet(f"{tmp_path}/in").schema
    stream = sinks.judged_reviews(spark.readStream.schema(kinds).option("maxFilesPerTrigger", 2).parquet(f"{tmp_path}/in"), gallery)
    for run in ("a", "b", "a"):  # a replay with a lost checkpoint, then a run with nothing new
        sinks.append_once(stream, f"{tmp_path}/log", f"{tmp_path}/c-{run}")
    lines = spark.read.schema("frame_index long, reviewer string, reason string, review_id string").json(f"{tmp_path}/log").collect()
    assert sorted((r.frame_index, r.reason) for r in lines) == [(0, None), (1, "unsupported decision"), (2, "reviewer missing"), (3, "stale binding"), (4, "unsupported decision"), (9, "stale binding")]
    assert len({r.review_id for r in lines}) == 6 and [r.reviewer for r in lines if r.frame_index == 0] == ["a"]


def plain_path(mask):
    """Searches with a queue, pixel by pixel."""
    on = {tuple(map(int, p)) for p in np.argwhere(mask)}
    todo, found = set(on), []
    while todo:
        queue, own = deque([min(todo)]), []
        todo.remove(queue[0])
        while queue:
            y, x = queue.popleft()
            own.append((y, x))
            for dy, dx in raster.NEIGHBOURS:
                if (y + dy, x + dx) in todo:
                    todo.remove((y + dy, x + dx))
                    queue.append((y + dy, x + dx))
        found.append(own)
    if not found:
        return [], []

    def far(start, own):
        came, queue, last = {start: None}, deque([start]), start
        while queue:
            last = y, x = queue.popleft()
            for dy, dx in raster.NEIGHBOURS:
                if (p := (y + dy, x + dx)) in own and p not in came:
                    came[p] = (y, x)
                    queue.append(p)
        return last, came

    own = set(max(found, key=len))
    end, came = far(far(min(own), own)[0], own)
    path = []
    while end is not None:
        path.append([float(end[1]), float(end[0])])
        end = came[end]
    return found, path


def test_masks_of_a_batch_are_searched_as_one_by_one():
    masks = [(np.random.default_rng(k).random((RNG.randint(0, 9), RNG.randint(1, 9))) < RNG.choice([0.2, 0.5, 0.9])).astype(int) for k in range(150)]
    batch = pa.array([m.tolist() for m in masks], type=pa.list_(pa.list_(pa.int32())))
    pixels = raster.Pixels(batch)
    label = pixels.labels()
    paths = raster.longest_paths(batch)
    for k, mask in enumerate(masks):
        found, path = plain_path(mask)
        own = label[pixels.mask == k]
        assert sorted(np.bincount(own[own >= 0])[np.unique(own[own >= 0])].tolist()) == sorted(len(c) for c in found)
        assert paths[k] == path
    assert raster.longest_paths(pa.array([None, []], type=pa.list_(pa.list_(pa.int32())))) == [[], []]


def test_samples_by_a_table_function_are_those_of_the_column(spark):
    lines = [(k, [[[RNG.random() * 50, RNG.random() * 50] for _ in range(RNG.randint(1, 4))] for _ in range(RNG.randint(0, 3))], RNG.choice([2.0, 4.0])) for k in range(60)] + [(60, None, 2.0), (61, [], 2.0), (62, [[[1.0, 1.0]]], None)]
    df = spark.createDataFrame(lines, "id long, lines array<array<array<double>>>, spacing double")
    found = collections.defaultdict(list)
    for r in tables.polyline_samples(df).collect():
        found[r.id].append((r.place, [r.x, r.y]))
    for spacing in (2.0, 4.0):
        for r in df.where(F.coalesce("spacing", F.lit(2.0)) == spacing).select("id", G.sample_polylines(F.col("lines"), spacing).alias("s")).collect():
            assert sorted(found[r.id]) == list(enumerate(r.s or []))
    tables.register_tables(spark)
    df.createOrReplaceTempView("lines_of_the_test")
    assert spark.sql("SELECT count(*) AS n FROM polyline_samples(TABLE(lines_of_the_test))").first().n == sum(map(len, found.values()))


def test_images_near_one_that_is_taken_go(spark):
    for _ in range(3):
        images = [(f"s{RNG.randint(0, 4)}", k, RNG.randint(0, 63)) for k in range(80)]
        wanted, radius = RNG.randint(1, 6), RNG.randint(0, 2)
        taken, expected = [5], set()
        for source in sorted({s for s, _, _ in images}):
            own = 0
            for k, bits in sorted((k, b) for s, k, b in images if s == source):
                if own < wanted and all((bits ^ t).bit_count() > radius for t in taken):
                    taken.append(bits)
                    expected.add((source, k))
                    own += 1
        df = spark.createDataFrame(images, "source string, at long, bits long")
        known = spark.createDataFrame([(5,)], "bits long")
        found = dedup.accept_near_in_order(df, "source", "at", "bits", wanted, radius, known)
        assert {(r.source, r.at) for r in found.collect()} == expected
    assert dedup.accept_near_in_order(df.limit(0), "source", "at", "bits", 2, 1).count() == 0


def test_a_store_of_scores_forgets_what_is_deleted(spark, tmp_path):
    base = str(tmp_path)
    make = lambda name, who, at, division="1A": ("v2", division, "j", "videos/a.mp4", name, who, at, [], [], [], [])
    save = lambda rows, version: workbench.save_scores(spark.createDataFrame(rows, workbench.SCORE), base, version, "v2").select("file_name", "errors").collect()
    bad = save([make("a.mp4", "x", "1"), make("b.mp4", "x", "1"), make("c.mp4", "y", "1"), make("d.mp4", "z", "1", "9A"), make("e.mp4", " ", "1")], 1)
    assert {r.file_name: r.errors for r in bad} == {"d.mp4": ["division"], "e.mp4": ["browser_identity"]}
    live = workbench.live_scores(spark, base)
    who = spark.createDataFrame([("x",), ("y",), ("z",), ("",), (None,)], "browser_identity string")
    load = lambda compacted: {r.browser_identity: r.document and (r.document.file_name, r.document.updated_at) for r in workbench.load_scores(workbench.live_scores(spark, base, compacted), who).collect()}
    assert load(False) == {"x": ("b.mp4", "1"), "y": ("c.mp4", "1"), "z": None, "": None, None: None}
    key = [r.storage_key for r in live.collect() if r.storage_key.startswith("b_")]
    workbench.delete_scores(spark.createDataFrame([(k,) for k in key], "storage_key string"), base, 2)
    workbench.compact_scores(spark, base)
    assert load(True) == load(False) and load(True)["x"] == ("a.mp4", "1")
    save([make("b.mp4", "x", "2"), make("c.mp4", "y", "3")], 3)
    assert load(True) == load(False) == {"x": ("b.mp4", "2"), "y": ("c.mp4", "3"), "z": None, "": None, None: None}
    with pytest.raises(Exception, match="no storage key"):
        workbench.delete_scores(spark.createDataFrame([("../x.json",)], "storage_key string"), base, 4)
    names = spark.createDataFrame([("a b/c: d.x.mp4",), ("...",), (None,), ("x" * 200,)], "n string").select(workbench.score_key(F.col("n"), F.lit("i")).alias("k")).collect()
    assert [r.k.rsplit("_", 1)[0] for r in names] == ["c_d.x", "video", "video", "x" * 80]


def test_support_of_a_batch_is_that_of_each_line(spark):
    point = lambda: [RNG.uniform(0, 30), RNG.uniform(0, 30)]
    rows = [(k, [point() for _ in range(RNG.randint(0, 4))], [[point() for _ in range(RNG.choice([0, 3, 4, 7]))] for _ in range(RNG.randint(0, 3))]) for k in range(80)] + [(80, None, [[point()]]), (81, [point(), point()], None), (82, None, None)]
    df = spark.createDataFrame(rows, "k long, line array<array<double>>, polygons array<array<array<double>>>")
    for r in df.select("k", raster.mask_support(F.col("line"), F.col("polygons")).alias("share")).collect():
        _, line, polygons = rows[r.k]
        samples = G.resample(np.array(line), 2.0) if line else np.empty((0, 2))
        hit = np.zeros(len(samples), dtype=bool)
        for p in polygons or []:
            if p:
                hit |= raster.inside(samples, np.array(p))
        assert r.share == pytest.approx(hit.mean() if len(samples) else 0.0, abs=1e-12)
    cut = pa.array([[[0.0, 0.0], [9.0, 9.0]]] * 5, type=pa.list_(pa.list_(pa.float64())))
    square = pa.array([[[[0.0, 0.0], [5.0, 0.0], [5.0, 5.0], [0.0, 5.0]]]] * 5, type=pa.list_(pa.list_(pa.list_(pa.float64()))))
    assert len(set(raster._shares(cut, square, 2.0, most_pairs=3).tolist())) == 1
