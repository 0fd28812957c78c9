"""Checks of detections against stored points: found peaks, lost pairs, residual search, parts of files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Shifts in seconds at which finding a peak is chance.
CHANCE_SHIFTS = (-6.2, -5.0, 5.0, 6.2)


def expected_peaks(detections: DataFrame, reference: DataFrame) -> DataFrame:
    """Where a detection puts each reference peak in the query: ``det, seq, frame64, bin64`` (integers, 1/64).

    ``detections (det, query_id, asset_id, start, end, speed, offset)`` in frames,
    reference = speed * query + offset; ``reference (asset_id, seq, frame64, bin64)``.
    """
    met = detections.join(reference, "asset_id")
    at = F.round((F.col("frame64") - F.col("offset") * 64) / F.col("speed")).cast("long")
    out = met.withColumn("__at", at).where(F.col("__at").between(F.col("start") * 64, F.col("end") * 64))
    return out.select("det", "query_id", "seq", F.col("__at").alias("frame64"), F.round(F.col("bin64") / F.col("speed")).cast("int").alias("bin64"))


def found_share(expected: DataFrame, query: DataFrame, frames: int = 1, bins: int = 1, second: int = 62) -> DataFrame:
    """``det, reference, found, share, support, chance``: expected peaks with a query peak within a frame and a bin.

    ``support`` counts the seconds that have a find, ``chance`` is the mean share
    at shifts where nothing is to be found. Places are cut into cells of the
    tolerance; a peak looks into its own and the neighbouring ones.
    """
    fw, bw = 64 * frames, 64 * bins
    q = query.select("query_id", F.col("frame64").alias("qf"), F.col("bin64").alias("qb")).withColumns({"cf": F.floor(F.col("qf") / fw).cast("long"), "cb": F.floor(F.col("qb") / bw).cast("long")})
    shifts = F.array(F.lit(0), *(F.lit(round(s * 62.5) * 64) for s in CHANCE_SHIFTS))
    e = expected.withColumn("shift", F.explode(shifts)).withColumn("ef", F.col("frame64") + F.col("shift"))
    cells = e.withColumn("df", F.explode(F.array(*map(F.lit, (-1, 0, 1))))).withColumn("db", F.explode(F.array(*map(F.lit, (-1, 0, 1)))))
    cells = cells.withColumns({"cf": F.floor(F.col("ef") / fw).cast("long") + F.col("df"), "cb": F.floor(F.col("bin64") / bw).cast("long") + F.col("db")})
    near = (F.abs(F.col("ef") - F.col("qf")) <= fw) & (F.abs(F.col("bin64") - F.col("qb")) <= bw)
    hit = cells.join(q, ["query_id", "cf", "cb"]).where(near).select("det", "shift", "seq", F.floor(F.col("frame64") / (64 * second)).alias("s")).distinct()
    counts = hit.groupBy("det").agg(F.count_if(F.col("shift") == 0).alias("found"), F.count_distinct(F.when(F.col("shift") == 0, F.col("s"))).alias("support"), F.count_if(F.col("shift") != 0).alias("__chance"))
    size = expected.groupBy("det").agg(F.count("*").alias("reference"))
    out = size.join(counts, "det", "left").fillna(0, ["found", "support", "__chance"])
    return out.select("det", "reference", "found", (F.col("found") / F.col("reference")).alias("share"), "support", (F.col("__chance") / F.col("reference") / len(CHANCE_SHIFTS)).alias("chance"))


def residual_peaks(query: DataFrame, expected: DataFrame, frames: int = 1, bins: int = 1) -> DataFrame:
    """Query peaks that no expected peak of a confident track explains: what a search under it looks at."""
    fw, bw = 64 * frames, 64 * bins
    three = F.array(*map(F.lit, (-1, 0, 1)))
    cells = expected.select("query_id", F.col("frame64").alias("ef"), F.col("bin64").alias("eb")).withColumn("df", F.explode(three)).withColumn("db", F.explode(three))
    cells = cells.withColumns({"cf": F.floor(F.col("ef") / fw).cast("long") + F.col("df"), "cb": F.floor(F.col("eb") / bw).cast("long") + F.col("db")})
    q = query.withColumns({"cf": F.floor(F.col("frame64") / fw).cast("long"), "cb": F.floor(F.col("bin64") / bw).cast("long")})
    near = (F.abs(F.col("frame64") - F.col("ef")) <= fw) & (F.abs(F.col("bin64") - F.col("eb")) <= bw)
    same = [q[c] == cells[c] for c in ("query_id", "cf", "cb")]
    return q.join(cells, same[0] & same[1] & same[2] & near, "left_anti").drop("cf", "cb")


def under(found: DataFrame, over: DataFrame, shared_audio: DataFrame, named: DataFrame) -> DataFrame:
    """Detections under a confident track: not its own asset, nor one that shares its audio, nor one already named; each asset once.

    ``found (over_asset, query_id, asset_id, hits, ..)``; the strongest of an asset stays.
    """
    left = found.where(F.col("over_asset") != F.col("asset_id"))
    left = left.join(shared_audio.select(F.col("a").alias("over_asset"), F.col("b").alias("asset_id")), ["over_asset", "asset_id"], "left_anti")
    left = left.join(named.select("query_id", "asset_id"), ["query_id", "asset_id"], "left_anti")
    left = left.join(over.select("query_id", F.col("asset_id").alias("over_asset")).distinct(), ["query_id", "over_asset"], "left_semi")
    rank = F.row_number().over(Window.partitionBy("query_id", "asset_id").orderBy(F.desc("hits"), "over_asset", "start"))
    return left.withColumn("__rank", rank).where("__rank = 1").drop("__rank")


def supported_seconds(hits: DataFrame) -> DataFrame:
    """``(a, b, hits, seconds)``: evidence of a pair of files: hits, and different seconds that have one."""
    return hits.groupBy("a", "b").agg(F.count("*").alias("hits"), F.count_distinct(F.floor(F.col("qframe") / 62.5)).alias("seconds"))


def edge_parts(found: DataFrame) -> DataFrame:
    """Files that hold a second recording: ``(file, worth_hearing)`` by the rules on parts at an edge.

    ``found (file, length_s, start_s, end_s, hits, other, other_length_s, other_start_s,
    other_end_s)`` are detections of other files in a file. A part counts with 20 s
    and 60 hits, under four fifths of the file, 30 s of it left, within 15 s of an
    end, and 30 s of the other beyond it.
    """
    span = F.col("end_s") - F.col("start_s")
    at_start, at_end = F.col("start_s") <= 15, F.col("end_s") >= F.col("length_s") - 15
    beyond = F.greatest(F.when(at_start, F.col("other_start_s")).otherwise(0), F.when(at_end, F.col("other_length_s") - F.col("other_end_s")).otherwise(0))
    part = (span >= 20) & (F.col("hits") >= 60) & (span < 0.8 * F.col("length_s")) & (F.col("length_s") - span >= 30) & (at_start | at_end) & (beyond >= 30)
    parts = found.where(part)
    reach = parts.groupBy("file").agg(F.count_distinct("other").alias("others"), F.max("hits").alias("best"), F.min("start_s").alias("a"), F.max("end_s").alias("b"), F.max(span).alias("longest"))
    second = (F.col("others") >= 2) & (F.col("b") - F.col("a") >= F.col("longest") + 20)
    return reach.select("file", "others", F.col("best").alias("hits"), (second | (F.col("best") >= 100)).alias("worth_hearing"))


def stronger_record(found: DataFrame, keys: tuple[str, ...] = ("query_id", "file")) -> DataFrame:
    """Of the detections of a file's two records that overlap only the stronger: ``found (.., record, start, end, hits)``."""
    other = found.select(*keys, F.col("record").alias("__r"), F.col("start").alias("__s"), F.col("end").alias("__e"), F.col("hits").alias("__h"))
    on = [found[k] == other[k] for k in keys]
    beaten = (F.col("record") != F.col("__r")) & (F.col("start") < F.col("__e")) & (F.col("__s") < F.col("end")) & ((F.col("__h") > F.col("hits")) | ((F.col("__h") == F.col("hits")) & (F.col("__r") < F.col("record"))))
    condition = on[0]
    for c in on[1:]:
        condition = condition & c
    return found.join(other, condition & beaten, "left_anti")


def channel_repair(kind: Column) -> Column:
    """What to read of a file's channels, by class."""
    return F.when(kind == "inverted", "left").when(kind == "one-channel", "louder").when(kind == "delayed", "left").otherwise("both")
