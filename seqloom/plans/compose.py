"""Whole jobs out of the operators: ingest, identify, clusters, passages."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from seqloom.functions.scalars import FRAMES_PER_SECOND, level_rank
from seqloom.operators import align, graph, index, intervals, plays, repeats
from seqloom.session import materialise
from seqloom.sources import audio


def ingest(spark: SparkSession, root: str, known: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """Assets ``(asset_id, path, seconds)`` and their peaks; files already ``known (path)`` are not read again."""
    files = audio.wav_files(spark, root)
    if known is not None:
        files = files.join(known.select("path"), "path", "left_anti")
    heads = audio.heads(files).where("error is null").select("path", "seconds", F.xxhash64("path").alias("asset_id"))
    return heads, audio.peaks(files).withColumn("asset_id", F.xxhash64("path")).drop("path")


def build_index(peaks: DataFrame, fan_out: int = 2) -> DataFrame:
    """Postings of stored peaks."""
    return index.asset_hashes(peaks, fan_out)


def query_hashes(peaks: DataFrame, ladder: DataFrame, fan_out: int = 2) -> DataFrame:
    """Hashes of a query's peaks ``(query_id, seq, frame64, bin64)`` as heard at each rung; frames are the query's own."""
    return index.ladder_hashes(peaks, ladder, fan_out)


def synthetic_library(spark: SparkSession, assets: int, seconds: int = 400, rate: int = 37) -> DataFrame:
    """Peaks of made-up assets, the same on every run: places and bins are hashes of the asset and the number."""
    n = seconds * rate
    df = spark.range(assets * n).select(F.expr(f"id div {n}").alias("asset_id"), (F.col("id") % n).cast("int").alias("seq"))
    step = 4000 // rate
    noise = lambda salt, most: F.pmod(F.xxhash64("asset_id", "seq", F.lit(salt)), F.lit(most))
    return df.select("asset_id", "seq", (F.col("seq") * step + noise(1, step)).cast("long").alias("frame64"), (320 + noise(2, 31_000)).cast("int").alias("bin64"))


def synthetic_mix(library: DataFrame, plan: DataFrame) -> DataFrame:
    """Peaks of queries that play stretches of the library: ``plan (query_id, asset_id, from_s, length_s, speed, at_s)``, on a turntable."""
    from pyspark.sql.window import Window

    met = library.join(F.broadcast(plan), "asset_id").where((F.col("frame64") >= F.col("from_s") * 4000) & (F.col("frame64") < (F.col("from_s") + F.col("length_s")) * 4000))
    out = met.select("query_id", F.round((F.col("frame64") - F.col("from_s") * 4000) / F.col("speed") + F.col("at_s") * 4000).cast("long").alias("frame64"), F.round(F.col("bin64") * F.col("speed")).cast("int").alias("bin64"))
    seq = F.row_number().over(Window.partitionBy("query_id").orderBy("frame64", "bin64")) - 1
    return out.withColumn("seq", seq)


def identify(query_peaks: DataFrame, postings: DataFrame, ladder: DataFrame, share: float = 0.01, options: align.Options = align.Options()) -> DataFrame:
    """Plays of every query: the fullest lists set aside for the first pass, all lists for the second.

    The first pass searches the index shard by shard. The second hashes the query
    only as the rungs hear it that won a detection; first-pass detections are tens
    a query and cut the plan. ``postings`` are gone through several times, so they
    should be a table, such as a saved index.
    """
    stats = materialise(index.hash_stats(postings), "list-lengths")
    kept = index.without_fullest(postings, stats, index.fullest_threshold(stats, share))
    shards = max(postings.sparkSession.sparkContext.defaultParallelism, -(-postings.count() // align.SHARD_POSTINGS))
    found = materialise(align.from_lines(align.shard_lines(query_peaks, kept, ladder, options, shards), options), "detections", compact=True)
    rungs = [r.rung_no for r in found.select("rung_no").distinct().collect()]
    hashes = query_hashes(query_peaks, ladder.where(F.col("rung_no").isin(rungs or [-1])))
    found = align.suppress(align.refine(found, hashes, postings, options), options.speed_gap)
    seconds = lambda c: F.col(c) / FRAMES_PER_SECOND
    timed = found.withColumns({c: seconds(c) for c in ("start", "end", "track_start", "track_end")})
    return plays.plays(timed.withColumn("rank", level_rank(F.col("hits"), F.col("windows"), F.col("pass"))))


def duplicate_clusters(pair_table: DataFrame, id_col: str, same: float = 0.8, share: float = 0.01) -> tuple[DataFrame, DataFrame]:
    """Pairs of unequal items (see :func:`repeats.self_matches`), and the components of equal items and of those that share ``same`` of the shorter's hashes on one offset."""
    pairs, members = repeats.self_matches(pair_table, id_col, share)
    pairs = materialise(pairs, "self-matches", compact=True)
    equal = members.where(F.col(id_col) != F.col("representative")).select(F.col("representative").alias("a"), F.col(id_col).alias("b"))
    return pairs, graph.connected_components(pairs.where(F.col("share") >= same).select("a", "b").unionByName(equal), "a", "b")


def second_chance(plays_: DataFrame, hashes: DataFrame, postings: DataFrame, low: float, high: float, options: align.Options = align.Options()) -> DataFrame:
    """Detections of a further search, with other rungs, of what no confident play covers."""
    gaps = plays.gaps(plays_, low, high)
    b = gaps.select("query_id", F.col("start").alias("g0"), F.col("end").alias("g1"))
    at = F.col("qframe") / FRAMES_PER_SECOND
    inside = hashes.join(b, "query_id").where((at >= F.col("g0")) & (at < F.col("g1"))).drop("g0", "g1")
    return align.search(inside, postings, options)


def document_pairs(docs: DataFrame, id_col: str, fan_out: int = 2) -> DataFrame:
    return index.token_pairs(index.tokens(docs, id_col), [id_col], fan_out)


def passages(docs: DataFrame, items: DataFrame, doc_id: str = "doc_id", item_id: str = "item_id") -> DataFrame:
    """Which documents hold which items, where, and how much of each."""
    return align.passage_search(document_pairs(items, item_id), document_pairs(docs, doc_id), item_id, doc_id)


def union_all(tables: Iterable[DataFrame]) -> DataFrame:
    out = None
    for t in tables:
        out = t if out is None else out.unionByName(t, allowMissingColumns=True)
    return out


def coverage(plays_: DataFrame) -> DataFrame:
    """Seconds of each query that confident plays cover."""
    sure = plays_.where("rank = 2").select("query_id", F.explode("segments").alias("s")).select("query_id", F.col("s.start").alias("start"), F.col("s.end").alias("end"))
    return intervals.merged(sure, ["query_id"]).groupBy("query_id").agg(F.sum(F.col("end") - F.col("start")).alias("covered"))
