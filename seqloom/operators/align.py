"""Alignment: which assets a query holds, where and how fast.

Query hashes meet the postings in an equi-join. Groups of hits that can't form a
line are removed by a histogram before anything is sorted. What is left of a
query and an asset is handled together: densest runs of offsets become lines,
lines become chains, chains detections, and weaker overlapping ones go. These
steps pick greedily or look back, so they run on arrays of one query and asset.
Evidence is then measured again around each detection, against all lists.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from seqloom.functions.scalars import WINDOW_FRAMES, level, level_rank
from seqloom.operators import index


@dataclass(frozen=True)
class Options:
    """Fixed values of the matcher, in frames where not said otherwise."""

    within: float = 2.0  # offsets of a line
    least: int = 3  # hits of a line
    lines: int = 3  # of an asset in a window and rung
    apart: float = 4.0  # predictions of distinct lines
    look_back: int = 3  # windows
    speed_gap: float = 0.006
    bridge: int = 10  # hits of lines across an empty window
    drift: float = 0.004  # of predictions, for each frame between
    fit_lines: int = 3
    fit_frames: float = 1000.0
    weak_end: float = 0.25  # of the median hits
    near: float = 24.0  # of a measured hit to its alignment
    remeasure: int = 10  # hits from which a detection is measured again
    margin_frames: float = 625.0  # around a detection
    window_frames: int = WINDOW_FRAMES


def lookup(query_hashes: DataFrame, postings: DataFrame) -> DataFrame:
    """Hits: every posting of every query hash; ``query_hashes (query_id, rung_no, speed, playback, hash, qframe)``."""
    return query_hashes.join(postings, "hash")


def possible_lines(hits: DataFrame, keys: Sequence[str], offset: Column, bucket: float = 4.0, least: int = 3) -> DataFrame:
    """Hits of groups in which some two neighbouring offset buckets hold ``least`` hits together; no line is lost.

    Groups and pairs of buckets travel as 64-bit hashes: two that share one may
    let a group through, and never hold one back.
    """
    at = F.floor(offset / bucket).cast("long")
    marked = hits.withColumn("__group", F.xxhash64(*keys))
    pair = F.explode(F.array(F.xxhash64("__group", at), F.xxhash64("__group", at + 1)))
    counted = marked.select("__group", pair.alias("__pair")).groupBy("__pair").agg(F.count("*").alias("__n"), F.any_value("__group").alias("__group"))
    some = counted.where(F.col("__n") >= least).select("__group").distinct()
    return marked.join(some, "__group", "left_semi").drop("__group")


# -- one query and asset -----------------------------------------------------------


def densest(values: np.ndarray, within: float, least: int, most: int) -> list[tuple[int, int]]:
    """Up to ``most`` runs of sorted values, none overlapping, longest first, then the earliest."""
    ends = np.searchsorted(values, values + within, "right")
    size = ends - np.arange(len(values))
    taken = np.zeros(len(values), bool)
    out = []
    for i in np.lexsort((np.arange(len(values)), -size)):
        if size[i] < least or len(out) == most:
            break
        if not taken[i : ends[i]].any():
            taken[i : ends[i]] = True
            out.append((int(i), int(ends[i])))
    return out


def lines_of(hits: pd.DataFrame, o: Options) -> pd.DataFrame:
    """Lines of one query and asset: ``window, rung_no, speed, playback, offset, hits, first, last``."""
    offset = hits.frame.to_numpy(float) - hits.point.to_numpy(float)
    window, rung, q = hits.window.to_numpy(), hits.rung_no.to_numpy(), hits.qframe.to_numpy(float)
    by = np.lexsort((q, offset, rung, window))
    out = sorted_lines(window[by], rung[by], q[by], offset[by], hits.speed.to_numpy()[by], hits.playback.to_numpy()[by], o)
    return distinct(pd.DataFrame(out, columns=LINE_FIELDS), o)


LINE_FIELDS = ["window", "rung_no", "speed", "playback", "offset", "hits", "first", "last"]


def sorted_lines(window, rung, q, offset, speed, playback, o: Options) -> list[tuple]:
    """Lines before any is left out for another, of hits of one query and asset in order of window, rung, offset and place."""
    edge = np.flatnonzero(np.r_[True, (window[1:] != window[:-1]) | (rung[1:] != rung[:-1]), True])
    out = []
    for lo, hi in zip(edge[:-1], edge[1:]):
        if hi - lo >= o.least:
            for a, b in densest(offset[lo:hi], o.within, o.least, o.lines):
                part = slice(lo + a, lo + b)
                out.append((window[lo], rung[lo], speed[lo], playback[lo], offset[part].mean(), b - a, q[part].min(), q[part].max()))
    return out


def whole_groups(batches: Iterator[pa.RecordBatch], keys: Sequence[str]) -> Iterator[pa.Table]:
    """Tables of whole groups, from batches in which the rows of a group follow one another."""
    held = []
    for batch in batches:
        if not len(batch):
            continue
        columns = [batch.column(k).to_numpy() for k in keys]
        new = np.flatnonzero(np.logical_or.reduce([c[1:] != c[:-1] for c in columns])) + 1
        starts = not held or any(held[-1].column(k)[-1] != batch.column(k)[0] for k in keys)
        if held and (starts or len(new)):
            yield pa.Table.from_batches(held if starts else [*held, batch.slice(0, new[0])])
            held, batch, new = [], batch if starts else batch.slice(new[0]), new if starts else new[1:] - new[0]
        if not held and len(new):
            yield pa.Table.from_batches([batch.slice(0, new[-1])])
            batch = batch.slice(new[-1])
        held.append(batch)
    if held:
        yield pa.Table.from_batches(held)


def predicted(line, query_frame: float) -> float:
    return line.speed * query_frame + line.offset


def distinct(lines: pd.DataFrame, o: Options) -> pd.DataFrame:
    """Of lines in one window that say about the same, the strongest; ties in the order of rungs."""
    lines = lines.sort_values(["window", "rung_no", "offset"], kind="stable").reset_index(drop=True)
    keep, window, kept = [], None, []
    for row in lines.sort_values(["window", "hits", "rung_no"], ascending=[True, False, True], kind="stable").itertuples():
        if row.window != window:
            window, kept = row.window, []
        centre = (row.first + row.last) / 2
        if all(abs(predicted(k, centre) - predicted(row, centre)) > o.apart for k in kept):
            kept.append(row)
            keep.append(row.Index)
    return lines.loc[keep].reset_index(drop=True)


def distinct_here(lines: list[tuple], o: Options) -> list[tuple]:
    """:func:`distinct` of lines of one window, strongest first."""
    kept = []
    for row in sorted(lines, key=lambda r: (-r[5], r[1], r[4])):
        centre = (row[6] + row[7]) / 2
        if all(abs((k[2] * centre + k[4]) - (row[2] * centre + row[4])) > o.apart for k in kept):
            kept.append(row)
    return kept


def linked(a, b, o: Options) -> bool:
    """Whether line ``b`` may follow line ``a``."""
    steps = b.window - a.window
    if not 1 <= steps <= o.look_back or abs(b.speed - a.speed) > o.speed_gap:
        return False
    if steps > 1 and min(a.hits, b.hits) < o.bridge:
        return False
    ca, cb = (a.first + a.last) / 2, (b.first + b.last) / 2
    return abs(predicted(a, cb) - predicted(b, cb)) <= o.apart + o.drift * (cb - ca)


def chains_of(lines: pd.DataFrame, o: Options) -> list[list[int]]:
    """Line numbers of each chain, best first: the best-scoring path, walked back to a line already taken."""
    rows = list(lines.itertuples())
    score, before = [r.hits for r in rows], [-1] * len(rows)
    for j, b in enumerate(rows):
        best = 0
        for i in range(j - 1, -1, -1):
            if b.window - rows[i].window > o.look_back:
                break
            if score[i] > best and linked(rows[i], b, o):  # of equals the latest stays
                best, before[j] = score[i], i
        score[j] += best
    taken, out = [False] * len(rows), []
    for j in sorted(range(len(rows)), key=lambda k: -score[k]):
        chain = []
        while j >= 0 and not taken[j]:
            chain.append(j)
            j = before[j]
        if len(chain) >= 2:
            for k in chain:
                taken[k] = True
            out.append(chain[::-1])
    return out


def chain_speed(rows: list, o: Options) -> float:
    """Slope of reference against query at the lines' centres, weighted by hits; short chains take the mean rung."""
    h = np.array([r.hits for r in rows], float)
    q = np.array([(r.first + r.last) / 2 for r in rows])
    if len(rows) >= o.fit_lines and q.max() - q.min() >= o.fit_frames:
        ref = np.array([predicted(r, c) for r, c in zip(rows, q)])
        qm, rm = np.average(q, weights=h), np.average(ref, weights=h)
        return float((h * (q - qm) * (ref - rm)).sum() / (h * (q - qm) ** 2).sum())
    return float(np.average([r.speed for r in rows], weights=h))


def trimmed(rows: list, o: Options) -> list:
    """The chain less weak lines at its ends, two lines at least."""
    bar = o.weak_end * float(np.median([r.hits for r in rows]))
    while len(rows) > 2 and rows[0].hits < bar:
        rows = rows[1:]
    while len(rows) > 2 and rows[-1].hits < bar:
        rows = rows[:-1]
    return rows


def strongest_first(found: pd.DataFrame, speed_share: float | None = None) -> pd.DataFrame:
    """Without detections that overlap a stronger kept one of the same asset (and, if asked, of about its speed)."""
    kept = []
    for row in found.sort_values(["hits", "ord"], ascending=[False, True], kind="stable").itertuples():
        if not any(row.asset_id == k.asset_id and row.start < k.end and k.start < row.end and (speed_share is None or abs(row.speed / k.speed - 1) <= speed_share) for k in kept):
            kept.append(row)
    return found.loc[[k.Index for k in kept]]


DETECTION = "query_id long, asset_id long, start double, end double, track_start double, track_end double, speed double, playback string, windows int, hits int, offset double, rung_no int, ord int"
LINE = "query_id long, asset_id long, line_no int, window long, rung_no int, speed double, playback string, offset double, hits int, first double, last double, chain int"
_ARROW = {"long": pa.int64(), "int": pa.int32(), "double": pa.float64(), "string": pa.string()}
DETECTION_KIND, LINE_KIND = ([(c.split()[0], _ARROW[c.split()[1]]) for c in x.split(", ")] for x in (DETECTION, LINE))


def detections_of(lines: pd.DataFrame, o: Options) -> tuple[pd.DataFrame, pd.DataFrame]:
    """Detections and lines (with the number of their chain) of one query and asset, from its distinct lines."""
    lines = lines.sort_values(["window", "hits", "rung_no"], ascending=[True, False, True], kind="stable").reset_index(drop=True)
    rows, out = list(lines.itertuples()), []
    lines["chain"] = -1
    for n, chain in enumerate(chains_of(lines, o)):
        lines.loc[chain, "chain"] = n
        own = trimmed([rows[k] for k in chain], o)
        speed = chain_speed(own, o)
        locked = sum(r.hits for r in own if r.playback == "key-locked") > sum(r.hits for r in own if r.playback != "key-locked")
        best = max(own, key=lambda r: (r.hits, -r.Index))
        centre = (best.first + best.last) / 2
        offset = predicted(best, centre) - speed * centre
        a, b = own[0].first, own[-1].last
        out.append((a, b, speed * a + offset, speed * b + offset, speed, "key-locked" if locked else "turntable", len({r.window for r in own}), sum(r.hits for r in own), offset, best.rung_no, n))
    found = pd.DataFrame(out, columns=["start", "end", "track_start", "track_end", "speed", "playback", "windows", "hits", "offset", "rung_no", "ord"])
    return found, lines


def align(query_hashes: DataFrame, postings: DataFrame, options: Options = Options(), trace: bool = False) -> DataFrame:
    """Detections of every query in every asset; with ``trace`` the lines and their chains instead.

    ``query_hashes (query_id, rung_no, speed, playback, hash, qframe)``, where
    ``qframe`` is the query's own frame; a rung hears it at ``qframe * speed``.
    ``postings (hash, asset_id, frame)``.
    """
    hits = lookup(query_hashes, postings).withColumn("point", F.col("qframe") * F.col("speed")).withColumn("window", F.floor(F.col("qframe") / options.window_frames).cast("long"))
    hits = possible_lines(hits, ["query_id", "asset_id", "rung_no", "window"], F.col("frame") - F.col("point"), 2 * options.within, options.least)

    names = [c.split()[0] for c in (LINE if trace else DETECTION).split(", ")]
    columns = ["query_id", "asset_id", "rung_no", "speed", "playback", "window", "qframe", "frame", "point"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        o, n, kinds = options, options.least - 1, pa.schema(LINE_KIND if trace else DETECTION_KIND)
        for table in whole_groups(batches, ["query_id", "asset_id"]):
            query, asset, window, rung, speed = (table.column(c).to_numpy() for c in ("query_id", "asset_id", "window", "rung_no", "speed"))
            q = table.column("qframe").to_numpy().astype(float)
            offset = table.column("frame").to_numpy().astype(float) - table.column("point").to_numpy().astype(float)
            by = np.lexsort((q, offset, rung, window, asset, query))
            query, asset, window, rung, speed, q, offset = (x[by] for x in (query, asset, window, rung, speed, q, offset))
            # only groups in which some hits are near enough have lines
            last = max(0, len(offset) - n)
            dense = offset[n:] <= offset[:last] + o.within
            for x in (query, asset, window, rung):
                dense &= x[n:] == x[:last]
            edge = np.flatnonzero(np.r_[True, (query[1:] != query[:-1]) | (asset[1:] != asset[:-1]), True])
            single, several = [], []
            for g in np.unique(np.searchsorted(edge, np.flatnonzero(dense), "right") - 1):
                part = slice(edge[g], edge[g + 1])
                playback = table.column("playback").take(pa.array(by[part])).to_pylist()
                out = sorted_lines(window[part], rung[part], q[part], offset[part], speed[part], playback, o)
                ids = {"query_id": int(query[edge[g]]), "asset_id": int(asset[edge[g]])}
                if out[0][0] == out[-1][0]:  # one window makes no chain, so no detection
                    single += [{**ids, "line_no": i, "chain": -1, **dict(zip(LINE_FIELDS, line))} for i, line in enumerate(distinct_here(out, o))] if trace else []
                    continue
                found, lines = detections_of(distinct(pd.DataFrame(out, columns=LINE_FIELDS), o), o)
                several.append(lines.assign(**ids, line_no=range(len(lines))) if trace else strongest_first(found.assign(**ids)))
            if trace and single:
                several.append(pd.DataFrame(single))
            several = [x[names] for x in several if len(x)]
            if several:
                yield from pa.Table.from_pandas(pd.concat(several), schema=kinds, preserve_index=False).to_batches()

    return hits.select(*columns).repartition("query_id", "asset_id").sortWithinPartitions("query_id", "asset_id").mapInArrow(run, LINE if trace else DETECTION)


def strongest_traces(lines: DataFrame, limit: int = 12) -> DataFrame:
    """Of traced lines those of the ``limit`` assets of a query with most hits on a line; ties to the lesser asset."""
    assets = lines.groupBy("query_id", "asset_id").agg(F.max("hits").alias("__most"))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("__most"), "asset_id"))
    few = assets.withColumn("__rank", rank).where(F.col("__rank") <= limit).select("query_id", "asset_id")
    return lines.join(few, ["query_id", "asset_id"], "left_semi")


#: Postings that one shard of the index holds.
SHARD_POSTINGS = 2_000_000


def shard_lines(query_peaks: DataFrame, postings: DataFrame, ladder: DataFrame, o: Options = Options(), shards: int | None = None, fan_out: int = 2, batch_peaks: int = 2_000_000) -> DataFrame:
    """Lines of every query and asset, ``query_id, asset_id, window, rung_no, speed, playback, offset, hits, first, last``, without moving a hit.

    The index is dealt out by asset; every shard gets the peaks of the query, which
    are few, hashes them under every rung, and looks them up in its own lists. Hits
    exist only as arrays of one rung and block of windows at a time; what leaves a
    task are lines. A shard should have about ``SHARD_POSTINGS`` postings; it meets at most
    about ``batch_peaks`` query peaks at a time.
    """
    spark = query_peaks.sparkSession
    rungs = [(r.rung_no, float(r.speed), r.playback) for r in ladder.collect()]
    shards = shards or max(spark.sparkContext.defaultParallelism, -(-postings.count() // SHARD_POSTINGS))
    blocks = index.query_blocks(query_peaks)
    batches = max(1, -(-query_peaks.count() // batch_peaks))
    left = postings.select("hash", "asset_id", "frame", F.pmod(F.xxhash64("asset_id"), F.lit(shards)).alias("shard"), F.explode(F.sequence(F.lit(0), F.lit(batches - 1))).alias("batch"))
    right = blocks.withColumn("batch", F.pmod(F.xxhash64("query_id", "block"), F.lit(batches)).cast("int")).withColumn("shard", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(shards - 1).cast("long"))))

    def run(key, lists: pa.Table, peaks: pa.Table) -> pa.Table:
        out = []
        if len(lists) and len(peaks):
            h = lists.column("hash").to_numpy()
            by = np.argsort(h, kind="stable")
            first = np.r_[0, np.cumsum(np.bincount(h, minlength=1 << 21))]
            assets, asset = np.unique(lists.column("asset_id").to_numpy()[by], return_inverse=True)
            frame = lists.column("frame").to_numpy()[by].astype(np.float64)
            for query, points in index.block_hashes(peaks, rungs, fan_out):
                for rung, speed, playback, hashes, qframe in points:
                    count = first[hashes + 1] - first[hashes]
                    at = np.repeat(first[hashes] - np.cumsum(count) + count, count) + np.arange(count.sum())
                    q = np.repeat(qframe, count)
                    offset = frame[at] - q * speed
                    window = np.floor(q / o.window_frames).astype(np.int64)
                    group = window * len(assets) + asset[at]
                    order = np.lexsort((q, offset, group))
                    group, offset, q = group[order], offset[order], q[order]
                    n = o.least - 1
                    dense = (group[n:] == group[:-n]) & (offset[n:] - offset[:-n] <= o.within)
                    for g in np.unique(group[: len(dense)][dense]):
                        lo, hi = np.searchsorted(group, [g, g + 1])
                        for a, b in densest(offset[lo:hi], o.within, o.least, o.lines):
                            part = slice(lo + a, lo + b)
                            out.append((query, int(assets[g % len(assets)]), int(g // len(assets)), rung, speed, playback, float(offset[part].mean()), b - a, float(q[part].min()), float(q[part].max())))
        columns = list(zip(*out)) or [()] * 10
        return pa.table({f.name: pa.array(c, f.type) for f, c in zip(_LINE_ARROW, columns)})

    return left.groupBy("shard", "batch").cogroup(right.groupBy("shard", "batch")).applyInArrow(run, FOUND_LINE)


FOUND_LINE = "query_id long, asset_id long, window long, rung_no int, speed double, playback string, offset double, hits int, first double, last double"
_LINE_ARROW = pa.schema([("query_id", pa.int64()), ("asset_id", pa.int64()), ("window", pa.int64()), ("rung_no", pa.int32()), ("speed", pa.float64()), ("playback", pa.string()), ("offset", pa.float64()), ("hits", pa.int32()), ("first", pa.float64()), ("last", pa.float64())])


def from_lines(lines: DataFrame, options: Options = Options()) -> DataFrame:
    """Detections of found lines: distinct ones, chains, and the strongest of what overlaps."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        ids = {"query_id": int(pdf.query_id.iloc[0]), "asset_id": int(pdf.asset_id.iloc[0])}
        found, _ = detections_of(distinct(pdf.drop(columns=list(ids)), options), options)
        return strongest_first(found.assign(**ids))[[c.split()[0] for c in DETECTION.split(", ")]]

    return lines.groupBy("query_id", "asset_id").applyInPandas(run, DETECTION)


def refine(detections: DataFrame, query_hashes: DataFrame, postings: DataFrame, o: Options = Options()) -> DataFrame:
    """Evidence measured again: hits near the alignment against all lists, the densest run of each window.

    The query is taken as its strongest line's rung hears it.

    Detections of fewer than ``o.remeasure`` hits pass unchanged, with pass
    ``ladder``; others get windows and hits of the pass ``fitted``, and go if no
    window has a run.
    """
    key = ["query_id", "asset_id", "ord"]
    strong = detections.where(F.col("hits") >= o.remeasure)
    heard = query_hashes.select("query_id", "rung_no", "hash", "qframe")
    near = strong.select(*key, "rung_no", "start", "end", "speed", "offset").join(heard, ["query_id", "rung_no"]).where(F.col("qframe").between(F.col("start") - o.margin_frames, F.col("end") + o.margin_frames))
    met = near.join(postings, ["hash", "asset_id"]).withColumn("dev64", F.round((F.col("frame") - (F.col("speed") * F.col("qframe") + F.col("offset"))) * 64).cast("long"))
    met = met.where(F.abs("dev64") <= o.near * 64).withColumn("window", F.floor(F.col("qframe") / o.window_frames).cast("long"))
    run = F.count("*").over(Window.partitionBy(*key, "window").orderBy("dev64").rangeBetween(0, int(o.within * 64)))
    best = met.withColumn("run", run).groupBy(*key, "window").agg(F.max("run").alias("run")).where(F.col("run") >= o.least)
    evidence = best.groupBy(*key).agg(F.count("*").cast("int").alias("windows"), F.sum("run").cast("int").alias("hits"))
    fitted = strong.drop("windows", "hits").join(evidence, key).withColumn("pass", F.lit("fitted"))
    return fitted.unionByName(detections.where(F.col("hits") < o.remeasure).withColumn("pass", F.lit("ladder")))


def suppress(detections: DataFrame, speed_share: float | None = 0.006) -> DataFrame:
    """Weaker overlapping detections of one query and asset go."""
    columns = detections.columns
    return detections.groupBy("query_id", "asset_id").applyInPandas(lambda pdf: strongest_first(pdf, speed_share)[columns], detections.schema)


def search(query_hashes: DataFrame, postings: DataFrame, options: Options = Options()) -> DataFrame:
    """Both passes, and the level of each detection."""
    first = align(query_hashes, postings, options)
    out = suppress(refine(first, query_hashes, postings, options), options.speed_gap)
    return out.withColumn("level", level(level_rank(F.col("hits"), F.col("windows"), F.col("pass"))))


# -- passages of symbols ---------------------------------------------------------


def passage_search(needles: DataFrame, hay: DataFrame, needle_id: str, hay_id: str, confident: float = 0.8, possible: float = 0.2) -> DataFrame:
    """Which items of ``hay`` hold which passage: best offset, aligned hits, share of the passage's pairs, tier.

    Both are pair tables ``(id, hash, pos)``. Each hash pair votes for its offset;
    of a passage and item the offset with most votes stays, then the least.
    """
    n = needles.select(F.col(needle_id), "hash", F.col("pos").alias("__n"))
    size = needles.groupBy(needle_id).agg(F.count("*").alias("pairs"))
    votes = n.join(hay.select(F.col(hay_id), "hash", F.col("pos").alias("__h")), "hash")
    votes = votes.groupBy(needle_id, hay_id, (F.col("__h") - F.col("__n")).alias("offset")).agg(F.count("*").alias("hits"))
    best = votes.groupBy(needle_id, hay_id).agg(F.max(F.struct("hits", (-F.col("offset")).alias("o"))).alias("b"))
    out = best.select(needle_id, hay_id, F.col("b.hits").alias("hits"), (-F.col("b.o")).cast("long").alias("offset")).join(size, needle_id)
    tier = F.when(F.col("hits") >= confident * F.col("pairs"), "confident").when(F.col("hits") >= possible * F.col("pairs"), "possible").otherwise("weak")
    return out.withColumn("tier", tier)


def near_hits(query: DataFrame, reference: DataFrame, within: float = 2.0) -> DataFrame:
    """Survival: query hashes ``(hash, frame)`` that meet the same reference hash within so many frames."""
    r = reference.select("hash", F.col("frame").alias("__frame"))
    return query.join(r, (query["hash"] == r["hash"]) & (F.abs(F.col("frame") - F.col("__frame")) <= within), "left_semi")


def nearest(left: DataFrame, right: DataFrame, keys: Sequence[str], tolerance: int) -> DataFrame:
    """For each ``left (keys, id, at)`` the nearest ``right (keys, ref)`` within ``tolerance``; ties to the earlier.

    Integer places are cut into bins of ``tolerance``; a row looks into its own and
    both neighbouring ones.
    """
    width = max(1, tolerance)
    l = left.withColumn("__bin", F.explode(F.sequence(F.floor(F.col("at") / width).cast("long") - 1, F.floor(F.col("at") / width).cast("long") + 1)))  # noqa: E741
    r = right.withColumn("__bin", F.floor(F.col("ref") / width).cast("long"))
    met = l.join(r, [*keys, "__bin"]).where(F.abs(F.col("at") - F.col("ref")) <= tolerance)
    return met.groupBy(*keys, "id", "at").agg(F.min(F.struct(F.abs(F.col("at") - F.col("ref")).alias("d"), "ref")).alias("b")).select(*keys, "id", "at", F.col("b.ref").alias("ref"), F.col("b.d").alias("distance"))
