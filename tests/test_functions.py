"""Literal expectations of single operators."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from framelode.functions import geometry as G
from framelode.functions import jsondoc as J
from framelode.functions import scalars as S
from framelode.operators import folds, matching, reports, sequences, splits
from framelode.sources import files


def one(spark, **columns):
    return spark.range(1).select(*[c.alias(n) for n, c in columns.items()]).first()


def lit(*v):
    return F.array(*[F.lit(float(x)) for x in v])


def line(*points):
    return F.array(*[lit(*p) for p in points])


def test_centerlines(spark):
    m = lambda a, b, tol: one(spark, m=G.centerline_metrics(a, b, tol, 1.0)).m
    far = m(F.array(line((10, 20), (30, 20))), F.array(line((10, 23), (30, 23))), (2.0, 4.0))
    assert [t.f1 for t in far.tolerances] == [0.0, 1.0] and far.chamfer == 3.0
    two = m(F.array(line((0, 0), (10, 0)), line((0, 10), (10, 10))), F.array(line((0, 0), (10, 0))), (2.0,))
    assert (two.target_samples, two.prediction_samples, two.tolerances[0].precision, two.tolerances[0].recall, two.tolerances[0].f1, two.chamfer) == (22, 11, 1.0, 0.5, 0.666667, 3.3333)
    none = m(F.array(line((0, 0), (1, 0))), F.array().cast("array<array<array<double>>>"), (2.0,))
    assert none.chamfer is None and none.tolerances[0].recall == 0.0


def test_boxes(spark):
    r = one(spark, a=G.crop_box(lit(450, 250, 550, 350), F.lit(1000), F.lit(600)), b=G.crop_box(F.lit(None).cast("array<double>"), F.lit(640), F.lit(360)), iou=G.bbox_iou(lit(0, 0, 0, 0), lit(0, 0, 0, 0)), line=G.bbox_yolo_line(lit(5, 5, 5, 9), F.lit(10.0), F.lit(10.0)))
    assert (r.a, r.b, r.iou, r.line) == ([350, 150, 650, 450], [270, 130, 370, 230], 0.0, "")


def test_scalars(spark):
    r = one(spark, fuse=S.logit_fuse(F.lit(0.3985), F.lit(0.5), 0.3, 0.3985, 0.5), high=S.logit_fuse(F.lit(0.8), F.lit(0.8), 0.3, 0.3985, 0.5), t=S.parse_time(F.lit("1:02:03.5")), bad=S.parse_time(F.lit("1:75")), c=S.scalar_confidence(F.lit("x")), n=S.safe_name(F.lit("  ")), s=S.relative_stem(F.lit("a-12345678-12345678"), F.lit("1234567890")))
    assert abs(r.fuse - 0.5) < 1e-9 and r.high > 0.8 and (r.t, r.bad, r.c, r.n, r.s) == (3723.5, None, 0.0, "unknown", "a-12345678")


def test_smoothing():
    p = {"normal": [0.9, 0.05, 0.05], "horizontal": [0.1, 0.8, 0.1]}
    state, seen = None, []
    for label in ("normal", "horizontal", "normal"):
        state, out = folds.smooth(state, p[label])
        seen.append(out)
    assert [o["label"] for o in seen] == ["normal"] * 3 and folds.unstable(seen[1], 0.5) and not folds.unstable(seen[2], 0.5)
    how, state, seen = folds.Smoothing(strong_confidence=1.0, strong_margin=1.0), None, []
    for v in ([0.6, 0.35, 0.05], *[[0.15, 0.8, 0.05]] * 4):
        state, out = folds.smooth(state, v, how)
        seen.append(out)
    assert [o["label"] for o in seen] == ["normal"] * 3 + ["horizontal"] * 2 and seen[3]["status"] == "confirmed_switched"
    with pytest.raises(ValueError):
        folds.smooth(None, [0, 0, 0])


def test_cadence():
    state, n, bursts = None, 0, 0
    for _ in range(10):
        state, out = folds.observe(state, [0.95, 0.03, 0.02], interval=10, burst=2, stable_needed=4, least_confidence=0.5)
        n, bursts = n + out["observed"], bursts + out["burst"]
    assert (n, bursts) == (5, 4)


def test_selection():
    box = lambda x, conf, track=None, w=10: {"box": [x, 0, x + w, 10], "conf": conf, "track": track}
    assert len(folds.distinct_boxes([box(0, 0.95), box(1, 0.4)])) == 1
    assert folds.pick(None, [box(0, 0.5), box(100, 0.6)])[1]["multiple"]
    start = {"track": 7, "box": [0, 0, 10, 10], "gap": 0, "trusted": False}
    assert folds.pick(start, [box(0, 0.65, 7), box(100, 0.98, 9)])[1]["chosen"]["track"] == 7
    near = {"track": None, "box": [0, 0, 10, 10], "gap": 0, "trusted": True}
    assert folds.pick(near, [box(2, 0.55), box(300, 0.95)])[1]["source"] == "temporal_motion"
    assert folds.pick(near | {"trusted": False}, [box(2, 0.55), box(300, 0.95)])[1]["chosen"]["conf"] == 0.95
    assert folds.pick(start, [box(3, 0.5, 8)])[1]["carried"] and not folds.pick(start, [box(300, 0.5, 8)])[1]["carried"]
    assert folds.match([[0, 0, 10, 10], [50, 0, 60, 10]], [[51, 0, 61, 10], [1, 0, 11, 10]], lambda i, j: True) == [(1, 0, pytest.approx(90 / 110)), (0, 1, pytest.approx(90 / 110))]


def test_streaks_and_recovery(spark):
    rows = [(0, 0, True, True), (0, 1, True, False), (1, 0, True, False), (1, 1, True, False), (1, 2, None, False), (2, 0, True, False), (2, 1, True, True), (3, 0, False, False), (4, 0, True, False)]
    e = spark.createDataFrame(rows, "grp long, frame long, t boolean, p boolean")
    assert tuple(sequences.missing_streak(e, F.col("t"), F.col("p")).first()) == (4, 2)
    assert tuple(sequences.missing_streak(e, F.col("t"), F.col("p"), per_group=True).first()) == (2, 4)
    assert tuple(sequences.recovery(e, F.col("t"), F.col("p")).first()) == (1, 3, 1)
    empty = e.limit(0)
    assert tuple(sequences.missing_streak(empty, F.col("t"), F.col("p")).first()) == (0, 0)


def test_track_switches(spark):
    e = spark.createDataFrame([(0, 0, 7), (0, 1, None), (0, 2, 9), (0, 3, 7)], "grp long, frame long, id long")
    assert tuple(sequences.track_switches(e, "id").first()) == (2, 2)


def test_rolling_gate(spark):
    rows = [(0, i, 0.75, 100 / 4406) for i in range(13)] + [(1, i, 0.9, 100 / 4406) for i in range(13)]
    e = spark.createDataFrame(rows, "grp long, frame long, c double, r double")
    out = sequences.rolling_gate(e, F.lit(False), F.col("c"), F.col("r")).collect()
    assert [r.frame for r in out if r.fires] == [11, 12] and [r.frame for r in out if r.latched] == [12]


def test_splits(spark):
    f = spark.createDataFrame([(f"g{i}", "samples", 3) for i in range(6)] + [(f"g{i}", "a", i % 2) for i in range(6)], "source string, feature string, n long")
    ratios = {"train": 0.5, "val": 0.25, "test": 0.25}
    a, b = (sorted(map(tuple, splits.random_search(f, "source", ratios, seed=7, attempts=200).collect())) for _ in range(2))
    assert a == b and {s for _, s in a} == set(splits.SPLITS) and len(a) == 6
    one = lambda rows, kinds: spark.createDataFrame(rows, kinds)
    plan = {r.g: r.split for r in splits.incremental_plan(one([("a", "train", 1), ("b", "val", 1), ("c", "test", 1)], "g string, split string, n long"), one([("x", 1), ("y", 1), ("z", 1)], "g string, n long"), "g", dict.fromkeys(splits.SPLITS, 1 / 3)).collect()}
    assert sorted(plan.values()) == ["test", "train", "val"]
    before = spark.createDataFrame([("g0", "train"), ("zz", "val"), ("g1", "odd")], "source string, split string")
    assert {r.error for r in splits.frozen_errors(f.select("source").distinct(), before, "source").collect()} == {"missing", "unknown split"}


def test_hamming_bands_are_exact(spark):
    rng = np.random.default_rng(1)
    a = rng.integers(-(1 << 63), (1 << 63) - 1, 50)
    b = [int(x) ^ (1 << int(k)) ^ (1 << int(j)) for x, k, j in zip(a[:25], rng.integers(0, 62, 25), rng.integers(0, 62, 25), strict=True)]
    left, right = spark.createDataFrame([(int(x),) for x in a], "v long"), spark.createDataFrame([(x,) for x in b], "v long")
    for radius in (0, 1, 2, 3):
        expected = {int(x) for x in a if any(((int(x) ^ y) & (1 << 64) - 1).bit_count() <= radius for y in b)}
        assert {r.v for r in matching.hamming_semi(left, right, "v", radius).collect()} == expected


def test_thresholds_prefer_fewer_false_positives(spark):
    e = spark.createDataFrame([(0.9, True), (0.2, True), (0.5, False)], "s double, t boolean")
    table = reports.threshold_table(e, F.col("s"), F.col("t"), [0.1, 0.6])
    assert [(r.tp, r.fp, r.fn) for r in table.orderBy("i").collect()] == [(2, 1, 0), (1, 0, 1)]


def test_documents(spark):
    assert J.first_object("x {: ```json {\"a\": {\"b\": 1}} ``` {}") == '{"a":{"b":1}}' and J.first_object("none") is None
    assert J.merge({"a": {"b": 1, "c": 2}}, {"a": {"b": None}, "d": [1]}) == {"a": {"b": None, "c": 2}, "d": [1]}


def test_settings():
    tree = {"a": {"flag": "yes", "names": "x, y"}}
    get = lambda env, path, default: files.typed_setting(tree, env, "E", path, default)
    assert get({}, "a.flag", False) is True and get({"E": "0"}, "a.flag", True) is False and get({}, "a.names", ("q",)) == ("x", "y") and get({}, "a.none", 3) == 3


def test_publish_keeps_the_old_version_on_failure(spark, tmp_path):
    base = f"file://{tmp_path}/p"
    files.publish(spark, spark.range(3), base, [])
    with pytest.raises(ValueError):
        files.publish(spark, spark.range(5), base, [("any", spark.range(1))])
    assert files.published(spark, base).count() == 3


def test_strict_lines(spark, tmp_path):
    from pyspark.sql import types as T

    (tmp_path / "a.jsonl").write_text('{"a": 1}\n\n{"a": 2}\n')
    schema = T.StructType.fromDDL("a long")
    assert [r.a for r in files.json_lines_strict(spark, str(tmp_path / "a.jsonl"), schema).collect()] == [1, 2]
    (tmp_path / "b.jsonl").write_text('{"a": 1}\nnot json\n')
    with pytest.raises(Exception, match="not a JSON object"):
        files.json_lines_strict(spark, str(tmp_path / "b.jsonl"), schema).collect()


def test_masks():
    from framelode.functions import raster

    mask = np.zeros((6, 8), dtype=np.uint8)
    mask[1, 1:7] = 1
    mask[2, 6] = mask[3, 7] = 1
    mask[5, 0] = 1
    assert [len(c) for c in raster.components(mask)] == [8, 1]
    assert raster.without_small(mask, 2).sum() == 8
    path = raster.longest_path(mask)
    assert {tuple(path[0]), tuple(path[-1])} == {(1.0, 1.0), (7.0, 3.0)} and len(path) == 7
    assert raster.inside(np.array([[1, 1], [5, 5]]), np.array([[0, 0], [2, 0], [2, 2], [0, 2]])).tolist() == [True, False]


def test_conflicts_stop_an_export(spark):
    from pyspark.errors import PySparkException

    from framelode.operators import gates

    labels = spark.range(3)
    none = spark.createDataFrame([], "kind string, value string")
    assert gates.without_conflicts(labels, none).count() == 3
    with pytest.raises(PySparkException, match="leakage"):
        gates.without_conflicts(labels, spark.createDataFrame([("image in groups", "x")], "kind string, value string")).collect()
