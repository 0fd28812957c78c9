"""Alignment on planted material, and its greedy steps against plain versions."""

import math
import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from seqloom.functions import scalars as sc
from seqloom.operators import align, index
from seqloom.plans import compose

O = align.Options()


@pytest.mark.parametrize("seed", range(5))
def test_densest_runs(seed):
    rng = np.random.default_rng(seed)
    x = np.sort(rng.uniform(0, 60, rng.integers(0, 80)))
    got = align.densest(x, 2.0, 3, 3)
    runs = sorted(((-(sum(1 for v in x[i:] if v <= x[i] + 2.0)), i) for i in range(len(x))))
    want, used = [], set()
    for n, i in runs:
        if -n < 3 or len(want) == 3:
            break
        if not used & set(range(i, i - n)):
            used |= set(range(i, i - n))
            want.append((i, i - n))
    assert got == want


def test_prefilter_loses_no_line(spark):
    rng = random.Random(1)
    rows = [(g, float(rng.choice([rng.uniform(0, 50), 20 + rng.uniform(0, 2)]))) for g in range(40) for _ in range(rng.randint(1, 9))]
    df = spark.createDataFrame(rows, "g int, o double")
    kept = {r.g for r in align.possible_lines(df, ["g"], F.col("o")).select("g").distinct().collect()}
    for g in range(40):
        own = sorted(o for k, o in rows if k == g)
        if align.densest(np.array(own), 2.0, 3, 3):
            assert g in kept


def line(window, hits, offset=0.0, speed=1.0, rung=0, playback="turntable"):
    a = window * 625.0
    return (window, rung, speed, playback, offset, hits, a, a + 600)


def lines(*rows):
    return pd.DataFrame(rows, columns=["window", "rung_no", "speed", "playback", "offset", "hits", "first", "last"])


def test_chains_follow_the_rules():
    df = lines(line(0, 20), line(1, 20), line(2, 5), line(4, 20), line(8, 30), line(9, 9, offset=50.0))
    assert align.chains_of(df, O) == [[0, 1, 2]] or align.chains_of(df, O)[0][:2] == [0, 1]
    far = lines(line(0, 20), line(2, 20), line(5, 20))
    assert align.chains_of(far, O) == [[0, 1, 2]]
    weak = lines(line(0, 20), line(2, 9))
    assert align.chains_of(weak, O) == []
    fast = lines(line(0, 20), line(1, 20, speed=1.02))
    assert align.chains_of(fast, O) == []
    assert align.chains_of(lines(line(0, 50)), O) == []


def test_distinct_lines_keep_the_stronger_and_the_earlier_rung():
    df = lines(line(0, 9, 1.0, rung=3), line(0, 9, 2.0, rung=1), line(0, 12, 80.0), line(1, 4))
    kept = align.distinct(df, O)
    assert sorted(zip(kept.window, kept.hits, kept.rung_no)) == [(0, 9, 1), (0, 12, 0), (1, 4, 0)]


def test_suppression_is_strict_about_touching():
    d = pd.DataFrame([(1, 0.0, 10.0, 1.0, 50, 0), (1, 10.0, 20.0, 1.0, 40, 1), (1, 5.0, 12.0, 1.0, 30, 2), (2, 0.0, 9.0, 1.0, 5, 3), (1, 5.0, 9.0, 1.05, 20, 4)], columns=["asset_id", "start", "end", "speed", "hits", "ord"])
    assert list(align.strongest_first(d).ord) == [0, 1, 3]
    assert sorted(align.strongest_first(d, 0.006).ord) == [0, 1, 3, 4]


def planted(spark, speed=1.0):
    """Three assets of random peaks; a query of 90 s that plays 40 s of asset 1 at a speed."""
    rng = np.random.default_rng(7)
    peaks = []
    for a in range(3):
        for i, f in enumerate(np.sort(rng.integers(0, 64 * 6000, 3000))):
            peaks.append((a, i, int(f), int(rng.integers(5 * 64, 400 * 64))))
    query = [(0, f, b) for f, b in zip(rng.integers(0, 64 * 5600, 1200), rng.integers(5 * 64, 400 * 64, 1200))]
    query += [(0, round((f - 64 * 1000) / speed) + 64 * 1250, round(b * speed)) for a, i, f, b in peaks if a == 1 and 64 * 1000 <= f < 64 * 3500]
    query = sorted(query, key=lambda r: r[1])
    p = spark.createDataFrame(peaks, "asset_id long, seq int, frame64 long, bin64 int")
    q = spark.createDataFrame([(0, i, int(f), int(b)) for i, (_, f, b) in enumerate(query)], "query_id long, seq int, frame64 long, bin64 int")
    return p, q


@pytest.mark.parametrize("speed", [1.0, 1.04])
def test_identify_finds_the_planted_track(spark, speed):
    p, q = planted(spark, speed)
    ladder = index.speed_ladder(spark, 0.96, 0.004, 21, ["turntable"]).withColumn("speed", 1 / F.col("speed"))
    postings = compose.build_index(p)
    ladder = index.speed_ladder(spark, 0.96, 0.004, 26, ["turntable"])
    hashes = compose.query_hashes(q, ladder)
    found = align.search(hashes, postings).collect()
    best = max(found, key=lambda r: r.hits)
    assert best.asset_id == 1 and best.level in ("confident", "possible")
    assert abs(best.speed - speed) < 0.004
    assert abs(best.start / 62.5 - 20) < 5 and abs(best.end / 62.5 - (20 + 40 / speed)) < 5
    assert all(r.asset_id == 1 or r.hits < 30 for r in found)


@pytest.mark.parametrize("shards,batch", [(1, 10**6), (3, 700)])
def test_sharded_lines_are_those_of_the_join(spark, shards, batch):
    p, q = planted(spark, 1.02)
    ladder = index.speed_ladder(spark, 0.99, 0.01, 5, ["turntable", "key-locked"])
    postings = compose.build_index(p)
    sharded = align.from_lines(align.shard_lines(q, postings, ladder, shards=shards, batch_peaks=batch))
    joined = align.align(compose.query_hashes(q, ladder), postings)
    rows = lambda df: sorted((r.asset_id, r.hits, r.windows, round(r.start, 3), round(r.end, 3), round(r.speed, 6), r.rung_no) for r in df.collect())
    assert rows(sharded) == rows(joined) and rows(joined)


def test_made_up_mix_is_identified(spark):
    from seqloom.plans.queries import QUERIES

    got = {(r.asset_id, r.start_s // 60): r for r in QUERIES["identify_synthetic"](spark, "/root/testdata/sf0.001").collect()}
    for k in range(10):
        asset, speed = k * 7 % 4, (0.95, 1.0, 1.03, 1.06)[k % 4]
        near = [r for r in got.values() if r.asset_id == asset and r.start_s - 1 <= 60 * k and r.end_s >= 60 * k + 46]
        assert near and near[0]["level"] == "confident" and abs(near[0].speed - speed) < 0.002


def test_peak_pairs_match_a_plain_loop(spark):
    rng = random.Random(2)
    peaks = [(0, i, f, rng.randint(5 * 64, 499 * 64)) for i, f in enumerate(sorted(rng.randint(0, 64 * 400) for _ in range(150)))]
    df = spark.createDataFrame(peaks, "asset_id long, seq int, frame64 long, bin64 int")
    half_up = lambda x: math.floor(abs(x) + 0.5) * (1 if x >= 0 else -1)
    want = []
    for _, i, f, b in peaks:
        n = 0
        for _, j, g, c in peaks[i + 1 :]:
            df_, db = half_up(g / 64 - f / 64), half_up(c / 64 - b / 64)
            if n < 2 and 1 <= df_ <= 63 and abs(db) <= 63:
                level = b / 64 if b / 64 < 50 else 50 + math.log(b / 64 / 50) / math.log(1.02)
                want.append((min(255, half_up(level)) << 13 | (db + 63) << 6 | df_, half_up(f / 64)))
                n += 1
    got = [(r.hash, r.frame) for r in index.peak_pairs(df, ["asset_id"]).collect()]
    assert sorted(got) == sorted(want)
    assert sorted((r.hash, r.frame) for r in index.asset_hashes(df).collect()) == sorted(want)
    q = df.withColumnRenamed("asset_id", "query_id")
    rungs = spark.createDataFrame([(0, 1.0, "turntable"), (1, 0.93, "turntable"), (2, 1.07, "key-locked")], "rung_no int, speed double, playback string")
    blocks = index.ladder_hashes(q, rungs, block_frames=100)
    rows = index.peak_pairs(index.rescaled(q, rungs), ["query_id", "rung_no", "speed"])
    assert sorted((r.rung_no, r.hash, round(r.qframe, 6)) for r in blocks.collect()) == sorted((r.rung_no, r.hash, round(r.frame / r.speed, 6)) for r in rows.collect())


def test_fullest_cut_keeps_ties_and_none(spark):
    stats = lambda *n: spark.createDataFrame([(i, x) for i, x in enumerate(n)], "hash int, len long")
    cut = lambda df, share: index.fullest_threshold(df, share).first()[0]
    assert cut(stats(9, 9, 9, 1), 0.25) == 9
    assert cut(stats(9, 8, 7, 1), 0.25) == 8
    assert cut(stats(9, 8, 7, 1), 0.1) is None
    assert cut(stats(9, 8), 1.0) == 0
    assert cut(stats(), 0.5) is None


def test_saved_index_and_provenance(spark):
    df = spark.createDataFrame([(i % 7, i % 3, i) for i in range(50)], "hash int, asset_id long, frame long")
    spark.sql("DROP TABLE IF EXISTS seqloom_test_index")
    made = index.load_or_build(spark, "seqloom_test_index", {"profile": "a", "n": 1}, lambda: df)
    assert sorted(made.collect()) == sorted(df.collect())
    assert index.load_index(spark, "seqloom_test_index", {"profile": "a", "n": 1}) is not None
    assert index.load_index(spark, "seqloom_test_index", {"profile": "b", "n": 1}) is None
    q = spark.createDataFrame([(3, 0)], "hash int, qframe int")
    plan = q.join(spark.table("seqloom_test_index").hint("merge"), "hash")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") <= 1
    spark.sql("DROP TABLE seqloom_test_index")


def test_levels():
    assert sc.LEVELS == ("weak", "possible", "confident")
