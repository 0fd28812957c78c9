"""A library of files as tables: listing, ignore patterns, comparison with what is stored."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from seqloom.functions.scalars import extension_in

#: File extensions of audio.
EXTENSIONS = ["mp3", "flac", "wav", "m4a", "aac", "ogg", "opus"]


def listing(spark: SparkSession, root: str) -> DataFrame:
    """``(path, size, modified)`` of every file below ``root``; paths are relative, contents are not read, files that vanish are passed over."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("ignoreMissingFiles", "true").load(root)
    base = root.rstrip("/") + "/"
    path = F.regexp_replace("path", "^.*?" + re.escape(base.split(":", 1)[-1]), "")
    return files.select(path.alias("path"), F.col("length").alias("size"), F.col("modificationTime").alias("modified"))


def pattern_regex(line: str) -> str | None:
    """An expression for one ignore pattern whose first group is the least part of a path, in whole names, that it matches; None for blank lines and comments.

    ``*`` is any run of characters of a name, and so is ``**`` within one; a whole
    name ``**`` stands for any number of names, at the end for one at least. ``?``
    is one character. A pattern with a slash is bound to the root, another matches
    a name at any depth; one that ends in a slash matches folders only. Brackets
    are literal.
    """
    line = line.strip()
    if not line or line.startswith("#"):
        return None
    names = line.strip("/").split("/")
    bound = "/" in line.rstrip("/")
    out = "" if bound else "(?:[^/]+/)*?"
    for i, name in enumerate(names):
        last = i + 1 == len(names)
        if name == "**" and bound:
            out += "[^/]+" if last else "(?:[^/]+/)*?"
        else:
            out += "".join({"*": "[^/]*", "?": "[^/]"}.get(c, re.escape(c)) for c in name) + ("" if last else "/")
    return f"^({out})" + ("/" if line.endswith("/") else "(?:/|$)")


def ignored_by(path: Column, lines: list[str]) -> Column:
    """Number (from 1) of the ignore line that leaves out a file; null if none does.

    That is the first one that matches the outermost folder which any matches, or
    else the first that matches the file.
    """
    found = []
    for n, line in enumerate(lines):
        if r := pattern_regex(line):
            part = F.regexp_extract(path, r, 1)
            depth = F.length(part) - F.length(F.replace(part, F.lit("/"), F.lit("")))
            found.append(F.when(part != "", F.struct(depth.alias("depth"), F.lit(n + 1).alias("line"))))
    return F.array_min(F.array_compact(F.array(*found)))["line"] if found else F.lit(None).cast("int")


def scan(files: DataFrame, ignore: list[str] = (), extensions: list[str] = EXTENSIONS) -> DataFrame:
    """The listing with ``reason``: null for an asset, else ``hidden``, ``ignored`` or ``extension``."""
    hidden = F.col("path").rlike(r"(^|/)\.")
    reason = F.when(hidden, "hidden").when(ignored_by(F.col("path"), list(ignore)).isNotNull(), "ignored").when(~extension_in(F.col("path"), list(extensions)), "extension")
    return files.withColumn("reason", reason)


def assets(scanned: DataFrame) -> DataFrame:
    return scanned.where("reason is null").drop("reason").orderBy("path")


def skipped(scanned: DataFrame) -> DataFrame:
    return scanned.where("reason is not null").groupBy("reason").count()


def survey(files: DataFrame, stored: DataFrame) -> DataFrame:
    """Every path of the listing or the store with its ``state``: current, stale, unindexed, ignored or orphan."""
    f = files.select("path", F.col("size").alias("f_size"), F.col("modified").alias("f_modified"), "reason")
    s = stored.select("path", F.col("size").alias("s_size"), F.col("modified").alias("s_modified"))
    state = (
        F.when(F.col("f_size").isNull(), "orphan")
        .when(F.col("s_size").isNull() & F.col("reason").isNotNull(), "skipped")
        .when(F.col("reason").isNotNull(), "ignored")
        .when(F.col("s_size").isNull(), "unindexed")
        .when((F.col("f_size") == F.col("s_size")) & (F.col("f_modified") == F.col("s_modified")), "current")
        .otherwise("stale")
    )
    return f.join(s, "path", "full_outer").select("path", state.alias("state"))


def vanished(files: DataFrame, read: DataFrame) -> DataFrame:
    """Files of the listing ``(path, reason)`` that were to be read and are not among those ``read (path)``."""
    return files.where("reason is null").join(read.select("path"), "path", "left_anti")


def to_index(files: DataFrame, stored: DataFrame, rejected: DataFrame, least: float | None, most: float | None) -> DataFrame:
    """Assets to read: not stored as they are, nor rejected under limits that still reject them.

    ``rejected (path, size, modified, seconds)`` remembers lengths, so wider limits let a file in again.
    """
    same = ["path", "size", "modified"]
    again = F.lit(False)
    if least is not None:
        again = again | (F.col("seconds") < least)
    if most is not None:
        again = again | (F.col("seconds") > most)
    return files.join(stored.select(*same), same, "left_anti").join(rejected.where(again).select(*same), same, "left_anti")


def pruned(stored: DataFrame, files: DataFrame, dry_run: bool = True) -> DataFrame:
    """Stored rows whose file is gone or ignored, or with ``dry_run`` off the rows that stay."""
    live = files.where("reason is null").select("path")
    return stored.join(live, "path", "left_anti" if dry_run else "left_semi")


def library_map(a: DataFrame, b: DataFrame) -> DataFrame:
    """``(a_path, b_path)``: files of two libraries with equal length and content digest, each used once, those of one size first."""
    from pyspark.sql.window import Window

    key = ["seconds", "digest"]
    rank = lambda name: F.row_number().over(Window.partitionBy(*key, "size").orderBy("path")).alias(name)
    x = a.select(*key, "size", F.col("path").alias("a_path"), rank("n"))
    y = b.select(*key, "size", F.col("path").alias("b_path"), rank("n"))
    first = x.join(y, [*key, "size", "n"]).select("a_path", "b_path", *key)
    loose = lambda df, name, side: df.select(*key, F.col("path").alias(side)).join(first.select(side), side, "left_anti").select(*key, side, F.row_number().over(Window.partitionBy(*key).orderBy(side)).alias(name))
    second = loose(a, "n", "a_path").join(loose(b, "n", "b_path"), [*key, "n"]).select("a_path", "b_path", *key)
    return first.unionByName(second).select("a_path", "b_path")


def without_reported(recordings: DataFrame, reports: DataFrame, settings: str) -> DataFrame:
    """Recordings that no report of equal settings covers."""
    same = ["path", "size", "modified"]
    return recordings.join(reports.where(F.col("settings") == settings).select(*same), same, "left_anti")
