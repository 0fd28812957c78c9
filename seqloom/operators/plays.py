"""Plays, tracklist entries, shared material and gaps of a report."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from seqloom.functions.scalars import format_timecode, level
from seqloom.operators.intervals import islands, merged, overlap_join, same_passage, same_recording, uncovered


def plays(detections: DataFrame, gap: float = 90.0) -> DataFrame:
    """Detections of one query and asset, possible or better, joined over gaps of up to ``gap`` seconds.

    ``detections (query_id, asset_id, start, end, track_start, speed, playback,
    hits, windows, rank)``, times in seconds. Level is the best of a segment's,
    speed and playback those of the first strongest.
    """
    ok = islands(detections.where("rank >= 1"), ["query_id", "asset_id"], gap, name="play_no")
    strongest = F.max(F.struct("hits", (-F.col("start")).alias("s"), "speed", "playback", "track_start", F.col("start").alias("at")))
    out = ok.groupBy("query_id", "asset_id", "play_no").agg(
        F.min("start").alias("start"),
        F.max("end").alias("end"),
        F.max("rank").alias("rank"),
        F.sum("hits").alias("hits"),
        F.sum("windows").alias("windows"),
        strongest.alias("b"),
        F.array_sort(F.collect_list(F.struct("start", "end", "hits"))).alias("segments"),
    )
    out = out.withColumns({"level": level(F.col("rank")), "speed": F.col("b.speed"), "playback": F.col("b.playback"), "zero": F.col("b.at") - F.col("b.track_start") / F.col("b.speed")})
    return out.drop("b")


def same_audio(plays_: DataFrame) -> DataFrame:
    """Plays of one query with equal segments, as one with the assets it may be."""
    by = plays_.groupBy("query_id", "segments").agg(F.min("asset_id").alias("asset_id"), F.array_sort(F.collect_set("asset_id")).alias("all"), F.max("rank").alias("rank"), F.max("hits").alias("hits"), F.min("start").alias("start"), F.max("end").alias("end"))
    return by.withColumn("also", F.array_remove("all", F.col("asset_id"))).drop("all")


def shared_material(plays_: DataFrame, width: float = 600.0) -> DataFrame:
    """Possible plays inside a passage (gaps of up to 10 s) of a confident play of another asset: ``query_id, play, inside``.

    ``plays_`` has ``play`` (id), ``track`` (normalised artist and title, may be
    null). A play is not marked if its track has a confident play.
    """
    sure = plays_.where("rank = 2")
    passage = merged(sure.select("query_id", "asset_id", F.explode("segments").alias("s")).select("query_id", "asset_id", F.col("s.start").alias("start"), F.col("s.end").alias("end")), ["query_id", "asset_id"], 10.0)
    outer = passage.select("query_id", F.col("asset_id").alias("inside"), F.col("start").alias("b_start"), F.col("end").alias("b_end"))
    inner = plays_.where("rank = 1").select("query_id", "play", "asset_id", "track", F.col("start").alias("a_start"), F.col("end").alias("a_end"))
    held = (F.col("b_start") <= F.col("a_start")) & (F.col("a_end") <= F.col("b_end")) & (F.col("asset_id") != F.col("inside"))
    met = overlap_join(inner, outer, ["query_id"], width, strict=False, condition=held)
    first = met.groupBy("query_id", "play", "track").agg(F.min(F.struct("b_start", "inside")).alias("b")).select("query_id", "play", "track", F.col("b.inside").alias("inside"))
    known = sure.select("query_id", "track").where("track is not null").distinct()
    return first.join(known, ["query_id", "track"], "left_anti").select("query_id", "play", "inside")


def other_titles(plays_: DataFrame, width: float = 600.0) -> DataFrame:
    """For each play the other titles of confident plays of the same recording: ``query_id, play, titles``."""
    a = plays_.select("query_id", "play", "track", F.col("zero").alias("a_zero"), F.col("start").alias("a_start"), F.col("end").alias("a_end"))
    b = plays_.where("rank = 2").select("query_id", F.col("play").alias("other"), F.col("track").alias("other_track"), F.col("zero").alias("b_zero"), F.col("start").alias("b_start"), F.col("end").alias("b_end"))
    same = same_passage(F.col("a_start"), F.col("a_end"), F.col("b_start"), F.col("b_end")) & same_recording(F.col("a_zero"), F.col("b_zero")) & (F.col("play") != F.col("other")) & (F.col("track") != F.col("other_track"))
    return overlap_join(a, b, ["query_id"], width, condition=same).groupBy("query_id", "play").agg(F.array_sort(F.collect_set("other_track")).alias("titles"))


def entries(plays_: DataFrame) -> DataFrame:
    """Tracklist entries: plays of one track, transitively, with the number of their entry by first start.

    Two plays join if they overlap by half of the shorter and are of one recording
    or have the same track name. Only plays of one island of overlaps can, so an
    island is what is held together.
    """
    fields = plays_.select("query_id", "play", "start", "end", "zero", "track")
    types = {f.name: f.dataType.simpleString() for f in fields.schema.fields}

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        rows = list(pdf.sort_values(["start", "play"], kind="stable").itertuples())
        group, near = list(range(len(rows))), []

        def root(i):
            while group[i] != i:
                group[i] = group[group[i]]
                i = group[i]
            return i

        for i, a in enumerate(rows):
            near = [j for j in near if rows[j].end >= a.start]
            for j in near:
                b = rows[j]
                common = min(a.end, b.end) - max(a.start, b.start)
                named = a.track is not None and a.track == b.track
                if common >= 0.5 * min(a.end - a.start, b.end - b.start) and (abs(a.zero - b.zero) <= 5.0 or named):
                    x, y = sorted((root(i), root(j)))
                    group[y] = x
            near.append(i)
        first = [rows[root(i)] for i in range(len(rows))]
        return pd.DataFrame({"query_id": [r.query_id for r in rows], "play": [r.play for r in rows], "first_start": [r.start for r in first], "first_play": [r.play for r in first]})

    joined = islands(fields, ["query_id"]).groupBy("query_id", "island").applyInPandas(run, f"query_id {types['query_id']}, play {types['play']}, first_start {types['start']}, first_play {types['play']}")
    number = F.dense_rank().over(Window.partitionBy("query_id").orderBy("first_start", "first_play"))
    return joined.select("query_id", "play", number.alias("entry"))


def gaps(plays_: DataFrame, low: float, high: float, least: float = 45.0) -> DataFrame:
    """Stretches of a query without a confident play."""
    sure = plays_.where("rank = 2").select("query_id", F.explode("segments").alias("s")).select("query_id", F.col("s.start").alias("start"), F.col("s.end").alias("end"))
    return uncovered(sure, ["query_id"], low, high, least)


def records_in_gaps(gaps_: DataFrame, repeats: DataFrame, width: float = 600.0, key: str = "query_id") -> DataFrame:
    """``gaps_`` with ``records``: repeated stretches whose middle lies in each gap ``(query_id, start, end)``.

    Repeats ``(key, start, end)`` are those of the gaps with the same ``key``, which many queries may share.
    Middles before a gap's end less those before its start are counted, in bins of ``width`` and by a running sum over
    the bins, so neither is repeated: not a gap for each bin it spans, nor a repeat for each query or gap.
    """
    ids = list(dict.fromkeys(["query_id", key, "start", "end"]))
    bound = lambda at, sign: F.struct(F.col(at).cast("double").alias("at"), F.lit(sign).alias("sign"), F.lit(0).cast("long").alias("n"))
    bounds = gaps_.select(*ids).distinct().select(F.col(key).alias("__key"), F.struct(*ids).alias("gap"), F.inline(F.array(bound("start", -1), bound("end", 1))))
    points = repeats.where(F.col(key).isNotNull()).groupBy(F.col(key).alias("__key"), ((F.col("start") + F.col("end")) / 2).cast("double").alias("at")).agg(F.count("*").alias("n"))
    points = points.where("at is not null").select("__key", F.lit(None).cast(bounds.schema["gap"].dataType).alias("gap"), "at", F.lit(0).alias("sign"), "n")
    both = bounds.where("__key is not null").unionByName(points).withColumn("__bin", F.floor(F.col("at") / width).cast("long"))
    so_far = Window.partitionBy("__key").orderBy("__bin").rowsBetween(Window.unboundedPreceding, -1)
    bins = both.groupBy("__key", "__bin").agg(F.sum("n").alias("n")).select("__key", "__bin", F.coalesce(F.sum("n").over(so_far), F.lit(0)).alias("before"))
    # at a bound's own time the bounds come first: a middle there is not before it
    within = F.sum("n").over(Window.partitionBy("__key", "__bin").orderBy("at", F.col("gap").isNull()).rowsBetween(Window.unboundedPreceding, 0))
    place = both.withColumn("within", within).where("gap is not null").join(bins, ["__key", "__bin"])
    n = place.groupBy("gap").agg(F.sum(F.col("sign") * (F.col("before") + F.col("within"))).alias("records")).select("gap.*", "records")
    return gaps_.join(n, ids, "left").withColumn("records", F.coalesce("records", F.lit(0)))


def entry_starts(df: DataFrame, key: str, share: float = 0.5) -> DataFrame:
    """Starts of entries in order: an interval joins the last entry if it overlaps by ``share`` of the shorter; the end grows.

    Keys stream through their task one after the other in order of start; nothing but the last entry is held.
    """
    fields = df.select(key, "start", "end")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, types = None, None
        table = lambda rows: pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(list(zip(*rows)) or [()] * 3, types)], [key, "start", "end"])
        for batch in batches:
            types, out = [c.type for c in batch.columns], []
            for k, a, b in zip(*(c.to_pylist() for c in batch.columns)):
                if last and k == last[0] and None not in (a, b, *last[1:]) and min(last[2], b) - max(last[1], a) >= share * min(last[2] - last[1], b - a):
                    last[2] = max(last[2], b)
                else:
                    if last:
                        out.append(last)
                    last = [k, a, b]
            yield table(out)
        if last:
            yield table([last])

    return fields.repartition(key).sortWithinPartitions(key, "start", "end").mapInArrow(run, fields.schema)


def tracklist(entries_: DataFrame, gaps_: DataFrame) -> DataFrame:
    """Lines of text: numbered entries ``(query_id, entry, start, name)``, and ``ID`` for gaps, by time."""
    both = entries_.select("query_id", "start", F.concat(F.lpad(F.col("entry").cast("string"), 2, "0"), F.lit(". "), format_timecode(F.col("start")), F.lit(" "), F.col("name")).alias("line"))
    ids = gaps_.select("query_id", "start", F.concat(F.lit("    "), format_timecode(F.col("start")), F.lit(" ID")).alias("line"))
    return both.unionByName(ids)


def cue_times(entries_: DataFrame) -> DataFrame:
    """Cue frames (75 a second) of entries ``(query_id, entry, start)``, strictly increasing: a tie moves on by one frame."""
    by = Window.partitionBy("query_id").orderBy("start", "entry")
    frame = F.round(F.col("start") * 75).cast("long")
    n = F.row_number().over(by)
    return entries_.withColumn("__n", n).withColumn("__f", frame - F.col("__n")).withColumn("frame", F.max("__f").over(by.rowsBetween(Window.unboundedPreceding, 0)) + F.col("__n")).drop("__n", "__f")
