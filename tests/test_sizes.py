"""Queries and operators where inputs are larger or odder than the tables: results against SQL or plain loops."""

import random
from bisect import bisect_left
from collections import Counter

import duckdb
import numpy as np
import pandas as pd
import pyarrow as pa
import pytest

from seqloom.operators import align, harness, index, plays, scoring
from seqloom.plans.queries import ORACLES, QUERIES


def test_second_records_round_halves_to_even(spark, tmp_path):
    """A price of 10.5 is 10 hits, fewer than 11 of the other record, which in turn a third row beats; 11.5 is as many as 12."""
    rows = [(0, 0, 1, 2, 20.0, 10.5), (5, 0, 1, 1, 20.0, 11.0), (22, 0, 1, 2, 20.0, 50.0), (0, 1, 1, 2, 20.0, 11.5), (5, 1, 1, 1, 20.0, 12.0), (22, 1, 1, 2, 20.0, 50.0)]
    li = spark.createDataFrame(rows, "l_orderkey long, l_suppkey long, l_partkey long, l_linenumber int, l_quantity double, l_extendedprice double")
    li.write.parquet(f"{tmp_path}/lineitem.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW lineitem AS SELECT * FROM '{tmp_path}/lineitem.parquet/*.parquet'")
    want = con.execute(ORACLES["second_records"]).fetchall()[0][0]
    assert (QUERIES["second_records"](spark, str(tmp_path)).first().kept, want) == (3, 3)


def test_statistics_of_more_lists_than_buckets(spark):
    lens = [1] * 70 + [2] * 50 + [3] * 9 + [40]
    r = index.index_stats(spark.createDataFrame(list(enumerate(lens)), "hash int, len long"), 100).first()
    lens.sort()
    assert (r.used, r.postings, r.mean_len, r.p99_len, r.max_len, r.top_postings) == (130, 237, 2.37, lens[99], 40, sum(lens[99:]))


def test_entry_starts_of_many_keys_and_long_ones(spark):
    """40,000 users of two islands, and one of 20,000 intervals in one island, that span batches; a group of Python's for each island takes minutes."""
    many = spark.range(40_000).selectExpr("id AS k", "inline(arrays_zip(array(0L, 4L, 100L), array(10L, 30L, 110L))) AS (start, end)")
    long = spark.range(20_000).selectExpr("-1L AS k", "id * 3 AS start", "id * 3 + 2 + id * 7919 % 11 AS end")
    found = plays.entry_starts(many.unionByName(long), "k")
    assert "FlatMapGroups" not in found._jdf.queryExecution().executedPlan().toString()
    got = found.collect()
    want, last = [], None
    for a, b in ((i * 3, i * 3 + 2 + i * 7919 % 11) for i in range(20_000)):
        if last and min(last[1], b) - max(last[0], a) >= 0.5 * min(last[1] - last[0], b - a):
            last[1] = max(last[1], b)
        else:
            want.append(last := [a, b])
    assert sorted([r.start, r.end] for r in got if r.k == -1) == want
    assert {(r.k, r.start, r.end) for r in got if r.k >= 0} == {(k, a, b) for k in range(40_000) for a, b in ((0, 30), (100, 110))}


@pytest.mark.parametrize("width", [1.0, 7.0, 1000.0])
def test_records_in_gaps_of_lists_that_queries_share(spark, width):
    """Gaps of 300 queries over 3 lists, bounds and middles at the same places, lists and gaps without the other, no list."""
    rng = random.Random(5)
    rep = [(rng.choice([0, 1, 2, 7, None]), a, a + rng.randint(0, 9)) for a in (rng.randint(-50, 300) for _ in range(900))]
    gaps = sorted({(q, q % 4 if q % 50 else None, a, a + rng.randint(1, 60)) for q in range(300) for a in rng.sample(range(-60, 300), 3)}, key=str)
    got = plays.records_in_gaps(spark.createDataFrame(gaps, "query_id long, list long, start long, end long"), spark.createDataFrame(rep, "list long, start long, end long"), width, "list")
    middles = {k: sorted((a + b) / 2 for x, a, b in rep if x == k) for k in range(4)}
    want = {g: 0 if g[1] is None else bisect_left(middles[g[1]], g[3]) - bisect_left(middles[g[1]], g[2]) for g in gaps}
    assert {(r.query_id, r.list, r.start, r.end): r.records for r in got.collect()} == want
    own = plays.records_in_gaps(got.select("query_id", "start", "end"), spark.createDataFrame([(1, 0, 300), (2, 40, 41)], "query_id long, start long, end long"), width)
    assert {(r.query_id, r.start, r.end): r.records for r in own.collect()} == {(q, a, b): int(q == 1 and a <= 150 < b) + int(q == 2 and a <= 40.5 < b) for q, _, a, b in gaps}


@pytest.mark.parametrize("block", [7, 1 << 20])
def test_bootstrap_in_blocks_of_units(spark, block):
    units = [(i, i * 31 % 9, 9 + i % 5) for i in range(40)]
    b = scoring.bootstrap(spark.createDataFrame(units, "unit_no long, k int, n long"), 300, block).first()
    k, n = (np.array([u[c] for u in units]) for c in (1, 2))
    rates = sorted(k[x].sum() / n[x].sum() for x in (scoring.draw_weight(d, None, 40, np.arange(40)) for d in range(300)))
    assert (b.low, b.high, b.draws) == (pytest.approx(rates[7]), pytest.approx(rates[292]), 300)


def test_bootstrap_of_many_units_broadcasts_no_draws(spark):
    """What the draws take is units times draws; the planner took it for small and broadcast it."""
    found = scoring.bootstrap(spark.range(30_000).selectExpr("id AS unit_no", "id % 7 AS k", "7L AS n"), 400)
    assert "inline" not in (plan := found._jdf.queryExecution().executedPlan().toString()) and "SortMergeJoin" not in plan and "BroadcastHashJoin" not in plan
    x = np.arange(30_000)
    rates = sorted((t % 7).sum() / (7 * len(x)) for t in (scoring.draw_weight(d, None, len(x), x) for d in range(400)))
    assert (r := found.first()) and (r.low, r.high) == (pytest.approx(rates[9]), pytest.approx(rates[389]))


@pytest.mark.parametrize("size", [1, 2, 5, 100])
def test_groups_are_whole_however_batches_cut_them(size):
    rows = [(0, 1), (0, 1), (0, 2), (1, 2), (1, 2), (1, 2), (1, 2), (1, 2), (1, 2), (2, 2), (3, 0), (3, 0)]
    batches = [pa.RecordBatch.from_pylist([{"a": a, "b": b} for a, b in rows[i : i + size]]) for i in range(0, len(rows), size)]
    got = [[(r["a"], r["b"]) for r in t.to_pylist()] for t in align.whole_groups(iter(batches), ["a", "b"])]
    assert sum(got, []) == rows and all(x[-1] != y[0] for x, y in zip(got, got[1:]))


@pytest.mark.parametrize("trace", [True, False])
def test_alignment_streams_and_says_what_each_group_says(spark, trace):
    """Many queries and assets, of one window and of several, against the rules on each group by itself; no Python group for each."""
    rng = random.Random(3)
    q = [(i, r, s, "turntable", rng.randint(0, 30), float(f)) for i in range(12) for r, s in ((0, 1.0), (1, 1.02)) for f in sorted(rng.sample(range(600 if i % 2 else 2500), 60))]
    p = [(rng.randint(0, 30), a, rng.randint(0, 2600)) for a in range(9) for _ in range(250)] + [(h, 9, round(f * s) + 40) for i, _, s, _, h, f in q if i == 4]
    hashes = spark.createDataFrame(q, "query_id long, rung_no int, speed double, playback string, hash int, qframe double")
    found = align.align(hashes, spark.createDataFrame(p, "hash int, asset_id long, frame long"), trace=trace)
    assert "FlatMapGroups" not in found._jdf.queryExecution().executedPlan().toString()
    o, want = align.Options(), []
    hits = pd.DataFrame(q, columns=["query_id", "rung_no", "speed", "playback", "hash", "qframe"]).merge(pd.DataFrame(p, columns=["hash", "asset_id", "frame"]), on="hash")
    hits = hits.assign(point=hits.qframe * hits.speed, window=(hits.qframe // o.window_frames).astype(int))
    for (i, a), group in hits.groupby(["query_id", "asset_id"]):
        detections, lines = align.detections_of(align.lines_of(group, o), o)
        lines = lines.assign(query_id=i, asset_id=a, line_no=range(len(lines)))
        want.append(lines if trace else align.strongest_first(detections.assign(query_id=i, asset_id=a)))
    want = pd.concat([w for w in want if len(w)])[found.columns]
    assert len(want) >= (500 if trace else 1) and (not trace or want.chain.max() >= 0)
    assert sorted(map(tuple, found.collect())) == sorted(map(tuple, want.to_numpy(object)))


def test_candidates_are_measured_by_arrays_of_a_pair(spark):
    """Hits by all hashes, the fullest lists among them, against a plain count; a pair is one row that travels, not one for each hash."""
    rng = random.Random(11)
    rows = [(f"d{i:02}", rng.choice(["the", "of"]) if rng.random() < 0.6 else f"h{rng.randint(0, 300)}", p) for i in range(40) for p in range(rng.choice([3, 30, 70]))]
    found = harness.candidates(spark.createDataFrame(rows, "id string, hash string, pos long"), "id", 20, 5)
    assert "FlatMapCoGroups" in found._jdf.queryExecution().executedPlan().toString()
    lists = Counter(h for _, h, _ in rows)
    full = {h for h, n in lists.items() if n > sorted(lists.values())[-1 - round(len(lists) * 0.01)]}
    ends = {i: (min(p for x, _, p in rows if x == i) + max(p for x, _, p in rows if x == i)) / 2 for i in {x for x, _, _ in rows}}
    q = [r for r in rows if ends[r[0]] - 10 <= r[2] < ends[r[0]] + 10]
    every, kept = Counter(), Counter()
    for a, h, pa_ in q:
        for b, g, pb in rows:
            if h == g and a != b:
                every[a, b, pb - pa_] += 1
                kept[a, b, pb - pa_] += h not in full
    most = lambda votes: {(a, b): max(n for (x, y, _), n in votes.items() if (x, y) == (a, b)) for a, b in {v[:2] for v, n in votes.items() if n}}
    searched, measured = most(kept), most(every)
    want = {(a, b, measured[a, b]) for a in ends for b in sorted((b for x, b in searched if x == a), key=lambda b: (-searched[a, b], b))[:5]}
    assert full and any(measured[x] > searched[x] for x in searched) and {tuple(r) for r in found.collect()} == want


def candidates_of(rows, length, k):
    """What :func:`harness.candidates` is to say, by plain counts."""
    lists = Counter(h for _, h, _ in rows)
    full = {h for h, n in lists.items() if n > sorted(lists.values())[-1 - round(len(lists) * 0.01)]}
    ends = {i: (min(p for x, _, p in rows if x == i) + max(p for x, _, p in rows if x == i)) / 2 for i in {x for x, _, _ in rows}}
    of = {}
    for b, h, p in rows:
        of.setdefault(h, []).append((b, p))
    every, kept = Counter(), Counter()
    for a, h, pa_ in rows:
        if ends[a] - length / 2 <= pa_ < ends[a] + length / 2:
            for b, pb in of[h]:
                if a != b:
                    every[a, b, pb - pa_] += 1
                    kept[a, b, pb - pa_] += h not in full
    searched, measured = Counter(), Counter()
    for (a, b, _), n in kept.items():
        searched[a, b] = max(searched[a, b], n)
    for (a, b, _), n in every.items():
        measured[a, b] = max(measured[a, b], n)
    best = {}
    for (a, b), n in searched.items():
        if n:
            best.setdefault(a, []).append((-n, b))
    return {(a, b, measured[a, b]) for a, found in best.items() for _, b in sorted(found)[:k]}


@pytest.mark.parametrize("small", [False, True])
def test_candidates_write_few_bytes_for_a_place(spark, tmp_path, monkeypatch, small):
    """Tables of 13,000 places in many lists of one and some of several: postings written as rows take more
    than 8 bytes each. Also in several passes, ranges, blocks and parts of a block."""
    if small:
        for name, value in (("POSTINGS", 3000), ("PAIRS", 90), ("BROADCAST", 10), ("MARKS", 1000), ("BLOCK", 16)):
            monkeypatch.setattr(harness, name, value)
    rng = random.Random(4)
    rows = [(i, rng.choice([rng.randint(0, 9), rng.randint(10, 900), rng.getrandbits(60)]), p) for i in range(100) for p in range(rng.choice([5, 100, 300]))]
    monkeypatch.setattr("seqloom.session.shared_dir", lambda _: str(tmp_path))
    found = {tuple(r) for r in harness.candidates(spark.createDataFrame(rows, "id long, hash long, pos long"), "id", 100, 20).collect()}
    assert found == candidates_of(rows, 100, 20) and len(found) > 500
    written = sum(p.stat().st_size for p in tmp_path.rglob("*.parquet"))
    assert small or written < 8 * len(rows)
