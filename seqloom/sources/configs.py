"""Small text inputs: set manifests, verdicts, judgments, lists; and reports as JSON."""

from __future__ import annotations

import tomllib
from collections.abc import Mapping
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from seqloom.functions.scalars import parse_timecode

REPORT = """schema_version int, query struct<path: string, size: long, modified: string, seconds: double>,
 search struct<matcher: string, profile: string, playback: string>,
 plays array<struct<asset_id: long, start: double, end: double, level: string, hits: long, windows: long, segments: array<struct<start: double, end: double, hits: long>>>>,
 gaps array<struct<start: double, end: double>>"""
SCHEMA_VERSION = 3


#: Tracks have at most 17 minutes unless said otherwise.
DEFAULTS = {"playback": "both", "min_track": 0.0, "max_track": 17 * 60.0, "peaks_dir": "work/peaks", "library": None}


def settings(given: Mapping[str, object], environment: Mapping[str, object] | None = None, file: str | None = None, defaults: Mapping[str, object] = DEFAULTS) -> dict[str, object]:
    """Each setting as it is given, else by the environment, else by the TOML ``file``, else by default; a null says nothing.

    An unknown name in the file, and a shortest track that is not below the longest, are errors.
    """
    said = tomllib.loads(Path(file).read_text(encoding="utf-8")) if file else {}
    if strange := sorted(set(said) - set(defaults)):
        raise ValueError(f"{file} has unknown settings: {', '.join(strange)}")
    layers = (given, environment or {}, said, defaults)
    out = {name: next((layer[name] for layer in layers if layer.get(name) is not None), None) for name in defaults}
    if "min_track" in out and "max_track" in out and not out["min_track"] < out["max_track"]:
        raise ValueError(f"no file can be a track: the shortest, {out['min_track']} s, is not below the longest, {out['max_track']} s")
    return out


def read_manifests(spark: SparkSession, paths: list[str]) -> DataFrame:
    """``(set_id, title, audio, position, artist, name, start_s, references)`` of TOML manifests; one small file each."""
    rows = []
    for n, path in enumerate(paths):
        said = tomllib.loads(Path(path).read_text(encoding="utf-8"))
        for t in said.get("track", []):
            ref = t.get("reference", [])
            rows.append((n, said.get("title"), said.get("audio"), int(t["position"]), t.get("artist"), t.get("title"), t.get("start"), [ref] if isinstance(ref, str) else list(ref)))
    df = spark.createDataFrame(rows, "set_id long, title string, audio string, position int, artist string, name string, start string, references array<string>")
    return df.withColumn("start_s", parse_timecode(F.col("start"))).drop("start")


def read_judgments(spark: SparkSession, path: str) -> DataFrame:
    """``(verdict, a, b)`` of tab-separated lines; blank lines and those that begin with # are passed over."""
    lines = spark.read.text(path).where(~F.trim("value").startswith("#") & (F.trim("value") != ""))
    parts = F.split("value", "\t")
    return lines.select(F.trim(F.get(parts, F.lit(0))).alias("verdict"), F.trim(F.get(parts, F.lit(1))).alias("a"), F.trim(F.get(parts, F.lit(2))).alias("b"))


def read_list(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path).select(F.trim("value").alias("path")).where("path <> '' and not startswith(path, '#')")


def read_reports(spark: SparkSession, path: str) -> DataFrame:
    """Reports as JSON, absent fields null."""
    return spark.read.schema(REPORT).json(path)


def write_reports(reports: DataFrame, path: str) -> None:
    reports.withColumn("schema_version", F.lit(SCHEMA_VERSION)).write.json(path)


def validity(reports: DataFrame) -> DataFrame:
    """``(path, fault)``: reports of another version, or whose plays end before they start or have no hits."""
    bad_play = F.exists("plays", lambda p: (p["end"] < p["start"]) | (p["hits"] <= 0))
    fault = F.when(~F.col("schema_version").eqNullSafe(F.lit(SCHEMA_VERSION)), "version").when(F.col("query").isNull(), "no query").when(F.coalesce(bad_play, F.lit(False)), "play")
    return reports.select(F.col("query.path").alias("path"), fault.alias("fault")).where("fault is not null")


def unknown_references(manifests: DataFrame, known: DataFrame) -> DataFrame:
    """References of manifests that are no asset's path."""
    return manifests.select("set_id", "position", F.explode("references").alias("path")).join(known.select("path"), "path", "left_anti")
