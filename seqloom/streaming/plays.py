"""Streams: plays from detections as they arrive, and tables that grow by new files."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

PLAY = "query_id long, asset_id long, start timestamp, end timestamp, hits long"


def streamed_plays(detections: DataFrame, gap_s: int = 90, late_s: int = 600) -> DataFrame:
    """Plays of ``detections (query_id, asset_id, start, end, hits)``, timestamps as event time.

    Detections of one query and asset join while they start within ``gap_s`` of
    the play's end; a play is given once the watermark has passed its end by that.
    Detections later than ``late_s`` are not waited for.
    """

    def run(key, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        open_ = [list(x) for x in state.get[0]] if state.exists else []
        for pdf in frames:
            open_ += [[int(a.value // 1000), int(b.value // 1000), int(h)] for a, b, h in zip(pdf.start, pdf.end, pdf.hits)]
        merged: list[list[int]] = []
        for a, b, h in sorted(open_):
            if merged and a - merged[-1][1] <= gap_s * 1_000_000:
                merged[-1] = [merged[-1][0], max(merged[-1][1], b), merged[-1][2] + h]
            else:
                merged.append([a, b, h])
        now = state.getCurrentWatermarkMs() * 1000
        done = [m for m in merged if m[1] + gap_s * 1_000_000 < now]
        left = [m for m in merged if m[1] + gap_s * 1_000_000 >= now]
        if left:
            state.update((left,))
            state.setTimeoutTimestamp(max(min(m[1] for m in left) // 1000 + gap_s * 1000 + 1, state.getCurrentWatermarkMs() + 1))
        elif state.exists:
            state.remove()
        stamp = lambda us: pd.Timestamp(us, unit="us")
        yield pd.DataFrame([(key[0], key[1], stamp(a), stamp(b), h) for a, b, h in done], columns=["query_id", "asset_id", "start", "end", "hits"])

    timed = detections.withWatermark("start", f"{late_s} seconds")
    return timed.groupBy("query_id", "asset_id").applyInPandasWithState(run, PLAY, "open array<array<long>>", "append", GroupStateTimeout.EventTimeTimeout)


def windowed_hits(detections: DataFrame, window: str = "10 minutes", late: str = "10 minutes") -> DataFrame:
    """Hits and detections of each asset in tumbling windows of event time."""
    by = detections.withWatermark("start", late).groupBy(F.window("start", window), "asset_id")
    return by.agg(F.sum("hits").alias("hits"), F.count("*").alias("detections")).select(F.col("window.start").alias("from"), "asset_id", "hits", "detections")


def upsert(batch: DataFrame, table: str, key: str, order: str) -> None:
    """Adds a batch to a Parquet table of versions: the latest of each key counts, see :func:`current`."""
    batch.write.mode("append").parquet(table)


def current(spark: SparkSession, table: str, key: str, order: str) -> DataFrame:
    """The latest row of each key."""
    df = spark.read.parquet(table)
    rest = [c for c in df.columns if c not in (key, order)]
    return df.groupBy(key).agg(F.max(F.struct(order, *rest)).alias("x")).select(key, "x.*")


def growing(source: DataFrame, table: str, checkpoint: str, key: str, order: str) -> StreamingQuery:
    """Runs once over what is new in a file stream, into :func:`upsert`."""
    return source.writeStream.option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(lambda batch, _: upsert(batch, table, key, order)).start()
