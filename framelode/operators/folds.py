"""Order-dependent folds: pure step functions, run per group over sorted rows here and over streams in streaming.stateful.

A group is read in order, batch by batch: the state that is carried is a few numbers, so a long group needs no more memory
than a short one.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from math import hypot, log

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

#: Labels in the order in which ties are broken: fixed values.
LABELS = ("normal", "horizontal", "other")


@dataclass(frozen=True)
class Smoothing:
    """How probabilities are averaged and when a label switches."""

    alpha: float = 0.4
    margin: float = 0.05
    confirmations: int = 3
    strong_confidence: float = 0.9
    strong_margin: float = 0.2

    def __post_init__(self) -> None:
        if not 0 < self.alpha <= 1 or not 0 <= self.margin <= 1 or self.confirmations < 1:
            raise ValueError("smoothing out of range")


def smooth(state: tuple | None, probabilities: list[float], how: Smoothing = Smoothing()) -> tuple[tuple, dict]:
    """One observation: (averages, label, candidate, count) and what it gives: label, confidence, raw label and status.

    The label switches to the one with the largest average after enough observations in a row that lead by the margin, or
    at once where the observation itself is sure and clear; any observation that agrees with the label resets the count.
    """
    total = sum(probabilities)
    if not total > 0 or min(probabilities) < 0 or total == float("inf"):
        raise ValueError("probabilities must be finite, non-negative and not all zero")
    p = [x / total for x in probabilities]
    top = lambda v: max(range(len(v)), key=lambda i: (v[i], -i))
    raw = top(p)
    if state is None:
        state, status = (tuple(p), raw, -1, 0), "initialized"
    else:
        mean, label, candidate, count = state
        mean = tuple((1 - how.alpha) * m + how.alpha * x for m, x in zip(mean, p, strict=True))
        leader, status = top(mean), "stable"
        if leader == label:
            candidate, count = -1, 0
        else:
            candidate, count = leader, count + 1 if leader == candidate else 1
            sure = raw == leader and p[leader] >= how.strong_confidence and p[leader] - p[label] >= how.strong_margin
            if sure or count >= how.confirmations and mean[leader] - mean[label] >= how.margin:
                label, candidate, count, status = leader, -1, 0, "strong_switched" if sure else "confirmed_switched"
            else:
                status = "pending"
        state = (mean, label, candidate, count)
    mean, label, candidate, count = state
    return state, {"label": LABELS[label], "confidence": round(mean[label], 6), "raw_label": LABELS[raw], "raw_confidence": round(p[raw], 6), "status": status, "pending_count": count}


def unstable(seen: dict | None, least_confidence: float) -> bool:
    """Whether the next observation should come soon: none yet, a raw label unlike the label, unsure, or not settled."""
    return seen is None or seen["raw_label"] != seen["label"] or seen["raw_confidence"] < least_confidence or seen["status"] != "stable"


def observe(state: dict | None, probabilities: list[float], interval: int, burst: int, stable_needed: int, least_confidence: float, how: Smoothing = Smoothing()) -> tuple[dict, dict]:
    """One row of a replay in which only some rows are observed: after `stable_needed` settled observations in a row every
    interval-th, else every burst-th; rows between carry the label."""
    state = dict(state or {"index": 0, "next": 0, "stable": 0, "filter": None, "label": None})
    out = {"observed": state["index"] >= state["next"], "burst": False}
    if out["observed"]:
        state["filter"], seen = smooth(state["filter"], probabilities, how)
        state["label"] = seen["label"]
        state["stable"] = 0 if unstable(seen, least_confidence) else state["stable"] + 1
        out["burst"] = state["stable"] < stable_needed
        state["next"] = state["index"] + (burst if out["burst"] else interval)
    state["index"] += 1
    return state, out | {"label": state["label"] or "unknown"}


def mean(values: list[float]) -> float:
    """The average of values added one after the other, as windows in SQL add them; sum() carries what rounding loses and may
    end on the other side of a limit."""
    total = 0.0
    for v in values:
        total += v
    return total / len(values)


def gate_fires(rows: list, window: int, confidence_below: float, ratio_above: float, most_accepts: int = 0) -> bool:
    """Whether the last rows (accepted, confidence, ratio) fire the rolling gate: the window is full, accepts at most so often,
    and is less sure than the limit and farther than the limit on average."""
    return len(rows) == window and sum(r[0] for r in rows) <= most_accepts and mean([r[1] for r in rows]) < confidence_below and mean([r[2] for r in rows]) > ratio_above


def iou(a: list[float], b: list[float]) -> float:
    w, h = min(a[2], b[2]) - max(a[0], b[0]), min(a[3], b[3]) - max(a[1], b[1])
    both = max(0.0, w) * max(0.0, h)
    union = max(0.0, a[2] - a[0]) * max(0.0, a[3] - a[1]) + max(0.0, b[2] - b[0]) * max(0.0, b[3] - b[1]) - both
    return both / union if union > 0 else 0.0


def distinct_boxes(found: list[dict], limit: float = 0.35) -> list[dict]:
    """Detections by falling confidence without those that overlap one before by the limit or more."""
    kept: list[dict] = []
    for d in sorted(found, key=lambda d: -d["conf"]):
        if all(iou(d["box"], k["box"]) < limit for k in kept):
            kept.append(d)
    return kept


def _centre(b: list[float]) -> tuple[float, float]:
    return (b[0] + b[2]) / 2, (b[1] + b[3]) / 2


def _apart(a: list[float], b: list[float]) -> float:
    (x, y), (u, v) = _centre(a), _centre(b)
    return hypot(x - u, y - v)


def _diagonal(b: list[float]) -> float:
    return hypot(b[2] - b[0], b[3] - b[1])


def pick(state: dict | None, found: list[dict], longest_gap: int = 3) -> tuple[dict, dict]:
    """One frame's detection (box, conf, track): the preferred track, else the nearest that is sure enough if the last box
    can be trusted, else the surest; the preferred track is carried over a short gap to a near box.

    state: track, box, gap since the box, trusted. Gives chosen (or None), source and carried.
    """
    state = dict(state or {"track": None, "box": None, "gap": 0, "trusted": False})
    kept = distinct_boxes(found)
    state["gap"] += 1
    if not kept:
        return state, {"chosen": None, "source": "none", "carried": False, "multiple": False}
    multiple, chosen, source = len(kept) > 1, None, "confidence"
    same = [d for d in kept if state["track"] is not None and d.get("track") == state["track"]]
    if same:
        chosen, source = same[0], "preferred_track"
    elif multiple and state["box"] is not None and state["trusted"]:
        scored = []
        for i, d in enumerate(kept):
            far = _apart(d["box"], state["box"]) / max(1.0, _diagonal(state["box"]), _diagonal(d["box"]))
            if far <= 2.0:
                scored.append((log(max(d["conf"], 1e-6)) - 1.5 * far, -i))
        if scored:
            chosen, source = kept[-max(scored)[1]], "temporal_motion"
    chosen = dict(chosen or kept[0])
    carried = False
    if state["track"] is not None and state["box"] is not None and not multiple and 1 <= state["gap"] <= longest_gap and chosen.get("track") != state["track"]:
        if _apart(chosen["box"], state["box"]) <= 2.0 * max(1.0, _diagonal(state["box"]), _diagonal(chosen["box"])):
            chosen["track"], carried = state["track"], True
    state |= {"track": chosen.get("track") if chosen.get("track") is not None else state["track"], "box": chosen["box"], "gap": 0, "trusted": not multiple or source != "confidence"}
    return state, {"chosen": chosen, "source": source, "carried": carried, "multiple": multiple}


@dataclass(frozen=True)
class StringPolicy:
    """When the model of lines is asked, and how long a line is carried without an answer."""

    interval: int = 3
    grace: int = 8
    longest: int = 12


def carry_line(state: tuple | None, frame: int, anchored: bool, seen: dict | None, shift: list[float] | None, how: StringPolicy = StringPolicy()) -> tuple[tuple, dict]:
    """One frame of the line that is followed: state is (rows read, frame last anchored or -1, age or -1 without a line, points).

    seen is what the model says of the frame if it is asked (points, ambiguous, mismatch); shift is how far the picture moved
    since the frame before, None where that isn't known. The model is asked every interval-th row if there is an anchor, a
    line or an anchor within the grace, and once more where an anchored frame would be left without a line. An answer
    without an anchor, a line or a recent anchor counts for nothing. Without an answer the line before moves along, up to
    `longest` rows in a row. A line that is ambiguous or doesn't meet the hand isn't carried on.
    """
    index, last, age, points = state or (0, -1, -1, [])
    recent = last >= 0 and frame - last <= how.grace
    asked = index % how.interval == 0 and (anchored or age >= 0 or recent)

    def line(answer: dict | None) -> tuple[str, int, list[float], bool]:
        if answer is not None and (anchored or age >= 0 or recent):
            return "observed", 0, list(answer["points"]), not (answer["ambiguous"] or answer["mismatch"])
        if answer is None and 0 <= age < how.longest and shift is not None:
            return "propagated", age + 1, [v + shift[i % 2] for i, v in enumerate(points)], True
        return "none", -1, [], False

    found = line(seen if asked else None)
    again = not asked and anchored and found[0] == "none"
    if again:
        found = line(seen)
    source, now, at, seeds = found
    lost = age >= 0 and source == "none"
    state = (index + 1, frame if anchored else last, now if seeds else -1, at if seeds else [])
    return state, {"asked": asked, "again": again, "source": source, "age": now if source != "none" else None, "seeds": seeds, "lost": lost, "x": at[0] if at else None, "y": at[1] if at else None}


def match(found: list[list[float]], tracks: list[list[float]], same: Callable[[int, int], bool], limit: float = 0.1) -> list[tuple[int, int, float]]:
    """One-to-one pairs of detections and tracks, greedily by falling (overlap, detection, track)."""
    pairs = sorted(((iou(a, b), i, j) for i, a in enumerate(found) for j, b in enumerate(tracks) if same(i, j)), reverse=True)
    out: list[tuple[int, int, float]] = []
    left, right = set(), set()
    for overlap, i, j in pairs:
        if overlap >= limit and i not in left and j not in right:
            out.append((i, j, overlap))
            left.add(i)
            right.add(j)
    return out


def farthest_first(rows: pd.DataFrame, desired: int, least_gap: int, least_bits: int) -> pd.DataFrame:
    """Frames chosen stratum by stratum, then to fill up: each the one farthest (cosine) from those chosen, near the stratum's
    centre, early; not within the gap or the bits of one that is chosen. rows: frame, vector (of length 1), bits; one group."""
    rows = rows.sort_values("frame").reset_index(drop=True)
    if rows.empty or desired < 1:
        return rows.iloc[:0]
    first, width = rows.frame.iloc[0], (rows.frame.iloc[-1] - rows.frame.iloc[0] + 1) / desired
    chosen: list[int] = []

    def free(i: int) -> bool:
        return all(abs(rows.frame[i] - rows.frame[c]) >= least_gap and (int(rows.bits[i]) ^ int(rows.bits[c])).bit_count() > least_bits for c in chosen)

    def rank(i: int, centre: float) -> tuple:
        near = min((1 - float(sum(a * b for a, b in zip(rows.vector[i], rows.vector[c], strict=True))) for c in chosen), default=2.0)
        return near, -abs(rows.frame[i] - centre), -rows.frame[i]

    for k in range(desired):
        lo, hi = first + k * width, first + (k + 1) * width
        pool = [i for i in rows.index[(rows.frame >= lo) & (rows.frame < hi)] if free(i)]
        if pool:
            chosen.append(max(pool, key=lambda i: rank(i, (lo + hi) / 2)))
    while len(chosen) < desired and (pool := [i for i in rows.index if i not in chosen and free(i)]):
        chosen.append(max(pool, key=lambda i: rank(i, first + width * desired / 2)))
    return rows.loc[sorted(chosen)]


def fold(df: DataFrame, group: str, order: str, start: Callable[[], object], step: Callable[[object, dict], tuple[object, dict]], schema: str) -> DataFrame:
    """step over each group's rows in order; state starts anew with each group. The rows that step gives make the result.

    Rows are dealt by group and sorted, and read batch by batch, so that state is all that is held of a group.
    """
    kinds = to_arrow_schema(StructType.fromDDL(schema))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, state = object(), None
        for batch in batches:
            rows = []
            for row in batch.to_pylist():
                if row[group] != now:
                    now, state = row[group], start()
                state, out = step(state, row)
                rows.append(out)
            yield pa.RecordBatch.from_pylist(rows, schema=kinds)

    return df.repartition(group).sortWithinPartitions(group, order).mapInArrow(run, schema)


def fold_many(df: DataFrame, group: str, order: str, inputs: list[str], start: Callable[[int], dict[str, np.ndarray]], step: Callable[[dict[str, np.ndarray], np.ndarray, dict], dict[str, np.ndarray]], read: Callable[[pa.RecordBatch], dict], schema: str, names: dict[str, tuple[str, ...]]) -> DataFrame:
    """As fold(), for recurrences that step many groups at once: the k-th rows of all groups of a batch go together.

    start (n) makes the states of n groups, arrays by name; step (states, groups, rows) brings those of some groups up to
    date and returns the results' columns; read makes arrays of a batch's inputs. Columns in names are numbers of names. Of
    a group that goes on in the next batch its state is carried.
    """
    kinds = to_arrow_schema(StructType.fromDDL(schema))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, carried = None, None
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            keys, values = batch.column(group), read(batch)
            own = pc.fill_null(keys.cast(pa.int64()), -1).to_numpy(zero_copy_only=False)
            none = keys.is_null().to_numpy(zero_copy_only=False)
            new = np.concatenate([[True], (own[1:] != own[:-1]) | (none[1:] != none[:-1])])
            of, first = np.cumsum(new) - 1, np.flatnonzero(new)
            states = start(len(first))
            if carried is not None and keys[0].as_py() == last:
                for c, value in carried.items():
                    states[c][0] = value
            place = np.arange(n) - first[of]
            rows = np.argsort(place, kind="stable")
            edges = np.concatenate([[0], np.cumsum(np.bincount(place))])
            out: dict[str, np.ndarray] = {}
            for a, b in zip(edges[:-1], edges[1:], strict=True):
                at = rows[a:b]
                for c, value in step(states, of[at], {k: v[at] for k, v in values.items()}).items():
                    out.setdefault(c, np.empty(n, dtype=value.dtype))[at] = value
            last, carried = keys[n - 1].as_py(), {c: v[-1].copy() for c, v in states.items()}
            arrays = []
            for field in kinds:
                if field.name in out:
                    arrays.append(pa.array(names[field.name]).take(pa.array(out[field.name])) if field.name in names else pa.array(out[field.name]).cast(field.type))
                else:
                    arrays.append(batch.column({"grp": group, "frame": order}[field.name]).cast(field.type))
            yield pa.RecordBatch.from_arrays(arrays, schema=kinds)

    return df.repartition(group).sortWithinPartitions(group, order).select(group, order, *inputs).mapInArrow(run, schema)


STATUSES = ("initialized", "stable", "pending", "confirmed_switched", "strong_switched")


def _shares(batch: pa.RecordBatch) -> dict:
    """Probabilities of a batch, each row scaled to 1."""
    lists = batch.column("probs")
    p = pc.list_flatten(lists).to_numpy(zero_copy_only=False).astype(np.float64)
    if lists.null_count or len(p) != len(LABELS) * batch.num_rows or not np.all(pc.list_value_length(lists).to_numpy() == len(LABELS)):
        raise ValueError("every row needs a probability for each label")
    p = p.reshape(-1, len(LABELS))
    total = p[:, 0]
    for k in range(1, len(LABELS)):
        total = total + p[:, k]
    if not np.all((total > 0) & np.isfinite(total)) or (p < 0).any():
        raise ValueError("probabilities must be finite, non-negative and not all zero")
    return {"p": p / total[:, None]}


def _fresh(n: int) -> dict[str, np.ndarray]:
    return {"mean": np.zeros((n, len(LABELS))), "label": np.full(n, -1), "candidate": np.full(n, -1), "count": np.zeros(n, dtype=np.int64)}


def smooth_many(states: dict[str, np.ndarray], g: np.ndarray, p: np.ndarray, how: Smoothing) -> dict[str, np.ndarray]:
    """smooth() for one observation p of each of the groups g."""
    at = np.arange(len(g))
    was, raw = states["label"][g], p.argmax(axis=1)
    fresh = was < 0
    mean = np.where(fresh[:, None], p, (1 - how.alpha) * states["mean"][g] + how.alpha * p)
    label, leader = np.where(fresh, raw, was), mean.argmax(axis=1)
    agrees = fresh | (leader == label)
    count = np.where(agrees, 0, np.where(leader == states["candidate"][g], states["count"][g] + 1, 1))
    sure = ~agrees & (raw == leader) & (p[at, leader] >= how.strong_confidence) & (p[at, leader] - p[at, label] >= how.strong_margin)
    moved = sure | (~agrees & (count >= how.confirmations) & (mean[at, leader] - mean[at, label] >= how.margin))
    label = np.where(moved, leader, label)
    settled = agrees | moved
    states["mean"][g], states["label"][g] = mean, label
    states["candidate"][g], states["count"][g] = np.where(settled, -1, leader), np.where(settled, 0, count)
    status = np.select([fresh, agrees, sure, moved], [0, 1, 4, 3], 2)
    return {"label": label, "confidence": np.round(mean[at, label], 6), "raw_label": raw, "raw_confidence": np.round(p[at, raw], 6), "status": status}


def smoothed(df: DataFrame, group: str = "grp", frame: str = "frame", how: Smoothing = Smoothing()) -> DataFrame:
    """grp, frame, label, confidence, raw_label, status of each row of df (group, frame, probs: array in the order of LABELS)."""

    def step(states: dict, g: np.ndarray, rows: dict) -> dict:
        out = smooth_many(states, g, rows["p"], how)
        return {c: out[c] for c in ("label", "confidence", "raw_label", "status")}

    names = {"label": LABELS, "raw_label": LABELS, "status": STATUSES}
    return fold_many(df, group, frame, ["probs"], _fresh, step, _shares, "grp long, frame long, label string, confidence double, raw_label string, status string", names)


def cadence(df: DataFrame, interval: int, burst: int, stable_needed: int = 4, least_confidence: float = 0.6, group: str = "grp", frame: str = "frame", how: Smoothing = Smoothing()) -> DataFrame:
    """grp, frame, label, observed and burst of each row of a replay with adaptive cadence; see observe()."""

    def start(n: int) -> dict[str, np.ndarray]:
        return _fresh(n) | {c: np.zeros(n, dtype=np.int64) for c in ("index", "next", "stable")}

    def step(states: dict, g: np.ndarray, rows: dict) -> dict:
        observed = states["index"][g] >= states["next"][g]
        soon = np.zeros(len(g), dtype=bool)
        if observed.any():
            some = g[observed]
            seen = smooth_many(states, some, rows["p"][observed], how)
            unsettled = (seen["raw_label"] != seen["label"]) | (seen["raw_confidence"] < least_confidence) | (seen["status"] != 1)
            states["stable"][some] = np.where(unsettled, 0, states["stable"][some] + 1)
            soon[observed] = states["stable"][some] < stable_needed
            states["next"][some] = states["index"][some] + np.where(soon[observed], burst, interval)
        states["index"][g] += 1
        return {"label": np.where(states["label"][g] < 0, len(LABELS), states["label"][g]), "observed": observed, "burst": soon}

    return fold_many(df, group, frame, ["probs"], start, step, _shares, "grp long, frame long, label string, observed boolean, burst boolean", {"label": (*LABELS, "unknown")})


LINES = "grp long, frame long, asked boolean, again boolean, source string, age long, seeds boolean, lost boolean, x double, y double"


def carried_lines(df: DataFrame, how: StringPolicy = StringPolicy(), group: str = "grp", frame: str = "frame") -> DataFrame:
    """LINES of each row of df (group, frame, anchored, seen, shift) in the order of frames; see carry_line."""

    def step(state, row):
        state, out = carry_line(state, row[frame], row["anchored"], row["seen"], row["shift"], how)
        return state, {"grp": row[group], "frame": row[frame], **out}

    return fold(df, group, frame, lambda: None, step, LINES)
