"""Scans and sinks: listings, whole JSON objects, strict JSON lines, gated labels, groups, snapshots, views, publishing."""

from __future__ import annotations

import json
import os
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def collect_files(spark: SparkSession, root: str, suffixes: list[str], recursive: bool = True) -> DataFrame:
    """path, length and time of files by lower-cased suffix; content isn't read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", str(recursive).lower()).load(root).select("path", "length", "modificationTime")
    return files.where(F.lower(F.regexp_extract("path", r"(\.[^./]+)$", 1)).isin(*[s.lower() for s in suffixes]))


def json_objects(spark: SparkSession, root: str, schema: T.StructType, names: str = "*.json") -> DataFrame:
    """One row a file: path, doc (null if the file isn't one object) and reason."""
    text = spark.read.option("wholetext", "true").option("recursiveFileLookup", "true").option("pathGlobFilter", names).text(root).select(F.col("_metadata.file_path").alias("path"), "value")
    doc = F.from_json("value", schema, {"mode": "PERMISSIVE"})
    is_object = F.trim("value").startswith("{") & F.get_json_object("value", "$").isNotNull()
    return text.select("path", F.when(is_object, doc).alias("doc"), F.when(~F.coalesce(is_object, F.lit(False)), "not an object").alias("reason"))


def json_lines_strict(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """Records of JSON lines; blank lines are skipped, a bad one stops the query and names itself."""
    lines = spark.read.text(path).where(F.trim("value") != "")
    bad = F.raise_error(F.concat(F.lit("not a JSON object: "), F.substring("value", 1, 80))).cast(schema)
    return lines.select(F.when(F.get_json_object("value", "$").isNotNull(), F.from_json("value", schema)).otherwise(bad).alias("r")).select("r.*")


def discover_roots(annotations: str) -> list[str]:
    """Folders below a local one that hold labels, but for score annotations, by name."""
    found = sorted(os.scandir(annotations), key=lambda e: e.name)
    return [e.path for e in found if e.is_dir() and e.name != "score_annotations" and os.path.isdir(os.path.join(e.path, "labels"))]


def video_list(spark: SparkSession, lines: DataFrame) -> DataFrame:
    """Paths of a list (line, value) without comments and blanks, each once, at its first place."""
    clean = lines.withColumn("path", F.trim(F.regexp_replace("value", "#.*$", ""))).where("path <> ''")
    return clean.groupBy("path").agg(F.min("line").alias("line"))


def group_frames(groups: DataFrame, labels: DataFrame, key: str, group: str | None = None) -> DataFrame:
    """Frames of nested groups (group_id, frames: array of struct sample_key, frame_index) with their labels; a frame without one
    stops the query."""
    flat = groups.select("group_id", F.posexplode("frames").alias("position", "f")).select("group_id", "position", F.col("f.sample_key").alias(key), F.col("f.frame_index").alias("frame_index"))
    flat = flat if group is None else flat.where(F.col("group_id") == group)
    both = flat.join(labels.withColumn("_there", F.lit(True)), key, "left")
    there = F.when(F.col("_there").isNull(), F.raise_error(F.concat(F.lit("no label for "), F.col(key))).cast("boolean")).otherwise(F.lit(True))
    return both.withColumn("_there", there).where("_there").drop("_there")


def snapshot_frames(frames: DataFrame, fields: list[str]) -> DataFrame:
    """Fields of frozen truth: the annotation's value wins over the wrapper's."""
    return frames.select("group_id", "frame_index", *[F.coalesce(F.col(f"annotation.{c}"), F.col(c)).alias(c) for c in fields])


def typed_setting(settings: dict, environment: dict, name: str, path: str, default):
    """A setting: of the environment, else of a nested document by dotted path, else the default; cast to the default's type."""
    value = environment.get(name)
    if value is None:
        value = settings
        for part in path.split("."):
            value = value.get(part) if isinstance(value, dict) else None
    if value is None:
        return default
    if isinstance(default, bool):
        return value if isinstance(value, bool) else str(value).strip().lower() in ("1", "true", "yes", "on")
    if isinstance(default, tuple):
        items = value.split(",") if isinstance(value, str) else value
        return tuple(type(default[0])(x.strip() if isinstance(x, str) else x) for x in items) if default else tuple(items)
    return type(default)(value) if default is not None else value


def write_text_atomic(path: str, payload: str) -> None:
    """A small local document, whole or not at all: written beside its place, synced, renamed."""
    beside = f"{path}.{uuid.uuid4().hex}.tmp"
    with open(beside, "w", encoding="utf-8") as f:
        f.write(payload)
        f.flush()
        os.fsync(f.fileno())
    os.replace(beside, path)


def append_json_lines(rows: DataFrame, path: str) -> None:
    rows.write.mode("append").json(path)


def write_views(samples: DataFrame, path: str, views: dict[str, list[str]]) -> None:
    """One table a view, of its columns, in folders by split; rows are brought together by split and source first, so each
    split gets few files."""
    for name, columns in views.items():
        samples.select("split", *columns).repartition("split", *[c for c in ("source",) if c in columns]).write.mode("errorifexists").partitionBy("split").parquet(f"{path}/{name}")


def publish(spark: SparkSession, staged: DataFrame, base: str, checks: list[tuple[str, DataFrame]]) -> str:
    """Write a version beside the others, check it, then point `current` at it; a failed check leaves `current` as it was.

    checks are tables of problems, which must be empty. The pointer is one small file. Versions are never overwritten, so a
    reader has one whole version; while the pointer is exchanged there may be none for a moment, and published() fails.
    """
    version = f"version-{uuid.uuid4().hex[:12]}"
    staged.write.mode("errorifexists").parquet(f"{base}/{version}")
    broken = [name for name, problems in checks if not problems.isEmpty()]
    jvm = spark.sparkContext._jvm
    path = lambda name: jvm.org.apache.hadoop.fs.Path(f"{base}/{name}")
    fs = path("x").getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if broken:
        fs.delete(path(version), True)
        raise ValueError(f"not published: {', '.join(broken)}")
    out = fs.create(path(f"{version}.pointer"), True)
    out.write(bytearray(json.dumps({"version": version}).encode()))
    out.close()
    if fs.exists(path("current")):
        fs.delete(path("current"), False)
    fs.rename(path(f"{version}.pointer"), path("current"))
    return version


def published(spark: SparkSession, base: str) -> DataFrame:
    version = json.loads(spark.read.text(f"{base}/current").first()[0])["version"]
    return spark.read.parquet(f"{base}/{version}")
