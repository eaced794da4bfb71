"""Patches of label documents: operations on strokes in a declared frame of coordinates, and the path that strokes give.

Every operation is a splice: some strokes at a place give way to others, where an operation on a point first splices the
points of its stroke. The operations of a patch are folded in order over arrays, so a patch never leaves the row it is in.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.geometry import coordinate_transform, point_box_distance
from .documents import _to_2d

#: Operations that a patch may hold: fixed values. On strokes, and on points of one.
ON_STROKES = ("add_stroke", "delete_stroke", "replace_stroke")
ON_POINTS = ("move_point", "replace_point", "insert_point", "delete_point")
OPS = "array<struct<op:string,stroke:int,index:int,point:int,points:array<array<double>>,value:array<double>>>"
STROKES = "array<array<array<double>>>"


def spliced(items: Column, at: Column, gone: Column, new: Column) -> Column:
    """items with `gone` of them from place `at` (from 0) on replaced by new."""
    return F.concat(F.slice(items, F.lit(1), at), new, F.slice(items, at + gone + 1, F.greatest(F.size(items) - at - gone, F.lit(0))))


def edited_strokes(strokes: Column, ops: Column, to_pixels) -> Column:
    """Struct of strokes and error after ops (OPS), whose points to_pixels (array of points) takes to the image's.

    The first operation that can't be done ends the patch: error is `ops[i]: operation | stroke | points | point | value`,
    and strokes are those before it. A place beyond the end of what is inserted into counts as its end; a stroke that loses
    its last but one point goes.
    """
    numbered = F.transform(ops, lambda op, i: F.struct(op.alias("op"), i.alias("i")))

    def step(acc: Column, item: Column) -> Column:
        op, now = item["op"], acc["strokes"]
        kind = F.lower(F.trim(F.coalesce(op["op"], F.lit(""))))
        n = F.size(now)
        at = F.when(kind == "add_stroke", F.greatest(F.lit(0), F.least(F.coalesce(op["index"], n), n))).otherwise(F.coalesce(op["stroke"], n))
        line = F.coalesce(F.get(now, at), F.array().cast("array<array<double>>"))
        size = F.size(line)
        place = F.when(kind == "insert_point", F.greatest(F.lit(0), F.least(F.coalesce(op["point"], op["index"], size), size))).otherwise(op["point"])
        points = F.coalesce(to_pixels(op["points"]), F.array().cast("array<array<double>>"))
        value = to_pixels(F.when(F.size(op["value"]) == 2, F.array(op["value"])))
        on_point = kind.isin(*ON_POINTS)
        fault = (
            F.when(~kind.isin(*ON_STROKES, *ON_POINTS), "operation")
            .when((kind != "add_stroke") & ~at.between(0, n - 1), "stroke")
            .when(kind.isin("add_stroke", "replace_stroke") & (F.size(points) < 2), "points")
            .when(on_point & ~F.coalesce(place.between(0, F.when(kind == "insert_point", size).otherwise(size - 1)), F.lit(False)), "point")
            .when(on_point & (kind != "delete_point") & value.isNull(), "value")
        )
        moved = spliced(line, place, F.when(kind == "insert_point", 0).otherwise(1), F.when(kind == "delete_point", F.array().cast("array<array<double>>")).otherwise(value))
        new = F.when(kind == "delete_stroke", F.array().cast(STROKES)).when(~on_point, F.array(points)).when(F.size(moved) >= 2, F.array(moved)).otherwise(F.array().cast(STROKES))
        done = spliced(now, at, F.when(kind == "add_stroke", 0).otherwise(1), new)
        return F.when(acc["error"].isNotNull(), acc).when(fault.isNotNull(), F.struct(now.alias("strokes"), F.concat(F.lit("ops["), item["i"].cast("string"), F.lit("]: "), fault).alias("error"))).otherwise(F.struct(done.alias("strokes"), F.lit(None).cast("string").alias("error")))

    start = F.struct(F.coalesce(strokes, F.array()).cast(STROKES).alias("strokes"), F.lit(None).cast("string").alias("error"))
    return F.when(F.size(ops) > 0, F.aggregate(numbered, start, step)).otherwise(start)


def observed_path(strokes: Column, box: Column, size: Column) -> Column:
    """The path that strokes give as they are: one piece each, whose ends are tied to the yoyo where they lie near its box
    (within 8 pixels or 0.06 of the image's diagonal), with an observed edge between points that follow each other."""
    near = F.greatest(F.lit(8.0), 0.06 * F.sqrt(size[0] * size[0] + size[1] * size[1]))
    end = lambda p: F.when(box.isNotNull() & (point_box_distance(p, box) <= near), "yoyo").otherwise("unknown")

    def piece(line: Column, i: Column) -> Column:
        edges = F.transform(F.sequence(F.lit(0), F.size(line) - 2), lambda k: F.struct(k.alias("from"), (k + 1).alias("to"), F.lit("observed").alias("evidence"), F.lit(0.9).alias("confidence")))
        return F.struct(F.concat(F.lit("observed-stroke-"), (i + 1).cast("string")).alias("path_id"), end(line[0]).alias("start_anchor"), end(F.element_at(line, -1)).alias("end_anchor"), line.alias("points_pixel"), edges.alias("edges"))

    pieces = F.transform(strokes, piece)
    loose = F.array_compact(F.transform(pieces, lambda p, i: F.when((p["start_anchor"] == "unknown") | (p["end_anchor"] == "unknown"), F.concat(F.lit("stroke "), (i + 1).cast("string"), F.lit(" has an unanchored endpoint")))))
    n = F.size(strokes)
    return F.struct(F.when(n == 1, "open").when(n > 1, "multiple").otherwise("uncertain").alias("topology"), F.when(n > 0, "partial").otherwise("uncertain").alias("reconstruction_status"), pieces.alias("paths"), loose.alias("unresolved_gaps"))


def patched(docs: DataFrame, patches: DataFrame, key: str) -> DataFrame:
    """One row for each of docs that has a patch: key, error, and what the patch makes of it.

    docs: key, image_size, yoyo_bbox_pixel, string_polylines_pixel, notes; patches, at most one a key: key, frame, crop,
    rendered (see coordinate_transform), set (struct of yoyo_bbox_pixel and string_polylines_pixel in the frame; null
    leaves what is there), ops, notes, rebuild. With an error (`coordinate frame`, or that of an operation) the document
    is left as it is and the other columns are null. Strokes that changed get their 0..999 mirrors, the first stroke's own
    column, and, unless rebuild is false, the path they give; notes are cut to 2,000 characters.
    """
    p = patches.select(key, *(F.col(c).alias(f"_{c}") for c in ("frame", "crop", "rendered", "set", "ops", "notes", "rebuild")))
    both = docs.join(p, key)
    size = F.col("image_size")
    frame = F.coalesce(F.nullif("_frame", F.lit("")), F.lit("original"))
    to_pixels = lambda points: F.when(points.isNotNull(), coordinate_transform(points, frame, size[0], size[1], F.col("_crop"), F.col("_rendered")))
    corners = F.col("_set.yoyo_bbox_pixel")
    box = F.flatten(to_pixels(F.when(corners.isNotNull(), F.array(F.slice(corners, 1, 2), F.slice(corners, 3, 2)))))
    known = to_pixels(F.array(F.array(F.lit(0.0), F.lit(0.0))))
    both = both.withColumns({"_box": F.coalesce(box, "yoyo_bbox_pixel"), "_old": F.coalesce(F.transform("_set.string_polylines_pixel", to_pixels), "string_polylines_pixel"), "_known": known.isNotNull() & known[0][0].isNotNull()})
    both = both.withColumn("_new", edited_strokes(F.col("_old"), F.coalesce("_ops", F.array().cast(OPS)), to_pixels))
    both = both.withColumn("error", F.when(~F.col("_known"), "coordinate frame").otherwise(F.col("_new.error")))
    strokes = F.col("_new.strokes")
    flat = F.transform(strokes, lambda line: F.transform(line, lambda q: _to_2d(q, size)))
    changed = F.coalesce(F.size("_ops") > 0, F.lit(False))
    path = F.when(changed & F.coalesce("_rebuild", F.lit(True)), observed_path(strokes, F.col("_box"), size))
    fine = lambda c: F.when(F.col("error").isNull(), c)
    return both.select(
        key, "error", fine(F.col("_box")).alias("yoyo_bbox_pixel"), fine(strokes).alias("string_polylines_pixel"), fine(F.when(changed, flat)).alias("string_polylines_2d"), fine(F.get(strokes, F.lit(0))).alias("string_polyline_pixel"),
        fine(path).alias("string_path"), fine(F.substring(F.coalesce("_notes", "notes", F.lit("")), 1, 2000)).alias("notes"),
    )
