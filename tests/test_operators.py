"""Intervals, graphs, plays, repeats, scores, fits and scalars against plain versions."""

import math
import random
import statistics

import numpy as np
import pytest
from pyspark.sql import functions as F

from seqloom.functions import scalars as sc
from seqloom.operators import fits, graph, index, intervals, plays, repeats, scoring
from seqloom.sources import library, sinks


def iv(spark, rows):
    return spark.createDataFrame(rows, "k string, start long, end long")


def random_intervals(seed, n=60):
    rng = random.Random(seed)
    return [(rng.choice("ab"), a, a + rng.randint(0, 40)) for a in (rng.randint(0, 400) for _ in range(n))]


# -- intervals -------------------------------------------------------------------


@pytest.mark.parametrize("gap,touching,seed", [(0, True, 1), (5, True, 2), (0, False, 3)])
def test_islands(spark, gap, touching, seed):
    rows = random_intervals(seed)
    want = []
    for k in "ab":
        reach = None
        for _, a, b in sorted(r for r in rows if r[0] == k):
            if reach is None or (a - reach > gap if touching else a - reach >= gap):
                want.append([k, a, b])
            else:
                want[-1][2] = max(want[-1][2], b)
            reach = max(b, reach) if reach is not None else b
    got = sorted([r.k, r.start, r.end] for r in intervals.merged(iv(spark, rows), ["k"], gap, touching=touching).collect())
    assert got == sorted(want)
    edge = [("a", 0, 10), ("a", 100, 110)]
    assert intervals.merged(iv(spark, edge), ["k"], 90).count() == 1 and intervals.merged(iv(spark, edge), ["k"], 89).count() == 2


def test_uncovered(spark):
    rows = [("a", 10, 20), ("a", 12, 60), ("a", 100, 120), ("b", -5, 3), ("b", 190, 260)]
    got = sorted(tuple(r) for r in intervals.uncovered(iv(spark, rows), ["k"], 0, 200, 10).collect())
    assert got == [("a", 0, 10), ("a", 60, 100), ("a", 120, 200), ("b", 3, 190)]
    assert intervals.uncovered(iv(spark, []), ["k"], 0, 200).count() == 0


@pytest.mark.parametrize("width", [3, 50, 1000])
def test_overlap_joins(spark, width):
    a, b = random_intervals(4), random_intervals(5)
    left = spark.createDataFrame([(k, i, s, e) for i, (k, s, e) in enumerate(a)], "k string, i int, a_start long, a_end long")
    right = spark.createDataFrame([(k, j, s, e) for j, (k, s, e) in enumerate(b)], "k string, j int, b_start long, b_end long")
    want = {(i, j) for i, (k, s, e) in enumerate(a) for j, (q, x, y) in enumerate(b) if k == q and s < y and x < e}
    got = [(r.i, r.j) for r in intervals.overlap_join(left, right, ["k"], width).collect()]
    assert len(got) == len(set(got)) and set(got) == want
    hit = {i for i, _ in want}
    assert sorted(r.i for r in intervals.overlap_join(left, right, ["k"], width, how="left_semi").collect()) == sorted(hit)
    assert sorted(r.i for r in intervals.overlap_join(left, right, ["k"], width, how="left_anti").collect()) == sorted(set(range(len(a))) - hit)


@pytest.mark.parametrize("n", [1, 2, 3, 7, 20])
def test_quartiles_are_exclusive(spark, n):
    rng = random.Random(n)
    v = [rng.randint(0, 99) for _ in range(n)]
    r = intervals.quartiles(spark.createDataFrame([("a", x) for x in v], "k string, v int"), ["k"], "v").first()
    if n >= 2:
        q = statistics.quantiles(v, n=4)
        assert [r.q1, r.median, r.q3] == pytest.approx(q)
    else:
        assert r.q1 == r.q3 == v[0]


def test_same_passage_at_the_threshold(spark):
    df = spark.createDataFrame([(0, 10, 5, 15), (0, 10, 6, 16), (0, 4, 2, 100), (0, 1, 1, 2)], "a int, b int, c int, d int")
    assert [r[0] for r in df.select(intervals.same_passage(F.col("a"), F.col("b"), F.col("c"), F.col("d"))).collect()] == [True, False, True, False]


def test_entry_starts_grow(spark):
    rows = [("a", 0, 10), ("a", 5, 30), ("a", 17, 40), ("a", 100, 110)]
    got = sorted(tuple(r) for r in plays.entry_starts(iv(spark, rows), "k").collect())
    assert got == [("a", 0, 40), ("a", 100, 110)]


# -- graph -----------------------------------------------------------------------


def plain_components(links):
    label = {x: x for p in links for x in p}
    for _ in label:
        for a, b in links:
            label[a] = label[b] = min(label[a], label[b])
    return label


@pytest.mark.parametrize("seed", range(3))
def test_components(spark, seed):
    rng = random.Random(seed)
    links = [(rng.randint(0, 60), rng.randint(0, 60)) for _ in range(45)] + [(100 + i, 101 + i) for i in range(40)] + [(7, 7), (300, 301), (301, 300)]
    df = spark.createDataFrame([*links, (None, 3)], "u long, v long")
    got = {r.node: r.component for r in graph.connected_components(df).collect()}
    assert got == plain_components([(a, b) for a, b in links if a != b])
    assert graph.connected_components(df.where("u < 0")).count() == 0


def test_verdicts_and_separation(spark):
    pairs = spark.createDataFrame([("b", "a", True), ("a", "c", False), ("c", "d", True)], "a string, b string, same boolean")
    verdicts = spark.createDataFrame([("a", "b", False)], "a string, b string, same boolean")
    assert {(r.a, r.b): r.same for r in graph.with_verdicts(pairs, verdicts).collect()} == {("b", "a"): False, ("a", "c"): False, ("c", "d"): True}
    links = spark.createDataFrame([("a", "b", 5), ("b", "c", 2), ("c", "d", 9), ("x", "y", 1)], "a string, b string, density int")
    parts, cuts = graph.separated(links, spark.createDataFrame([("a", "d"), ("q", "r")], "a string, b string"))
    assert {r.node: r.component for r in parts.collect()} == {"a": "a", "b": "a", "c": "c", "d": "c", "x": "x", "y": "x"}
    assert [(r.a, r.b) for r in cuts.collect()] == [("b", "c")]


def test_families_nest(spark):
    link = lambda *p: spark.createDataFrame(list(p), "a long, b long")
    got = {(r.tier, r.node): r.family for r in graph.families(link((1, 2)), link((2, 3)), link((9, 3))).collect()}
    assert got == {("recording", 1): 1, ("recording", 2): 1, ("title", 1): 1, ("title", 2): 1, ("title", 3): 1, ("relation", 1): 1, ("relation", 2): 1, ("relation", 3): 1, ("relation", 9): 1}


def test_frontier(spark):
    links = spark.createDataFrame([(1, 2), (3, 2), (3, 4), (8, 9)], "a long, b long")
    got = {r.node: r.round for r in graph.frontier(spark.createDataFrame([(1,)], "node long"), links).collect()}
    assert got == {1: 0, 2: 1, 3: 2, 4: 3}


# -- plays -----------------------------------------------------------------------


def detections(spark, rows):
    full = [(1, a, float(s), float(e), float(t), 1.0, "turntable", h, w, r) for a, s, e, t, h, w, r in rows]
    return spark.createDataFrame(full, "query_id long, asset_id long, start double, end double, track_start double, speed double, playback string, hits int, windows int, rank int")


def test_plays_marks_and_entries(spark):
    d = detections(spark, [(1, 0, 50, 0, 300, 5, 2), (1, 140, 200, 90, 100, 2, 1), (1, 290.1, 300, 0, 70, 1, 1), (2, 10, 40, 5, 80, 2, 1), (3, 500, 520, 0, 20, 1, 0), (4, 12, 45, 7, 90, 2, 1)])
    p = plays.plays(d).orderBy("asset_id", "start")
    got = [(r.asset_id, r.start, r.end, r["level"], r.hits, r.windows) for r in p.collect()]
    assert got == [(1, 0.0, 200.0, "confident", 400, 7), (1, 290.1, 300.0, "possible", 70, 1), (2, 10.0, 40.0, "possible", 80, 2), (4, 12.0, 45.0, "possible", 90, 2)]
    p = p.withColumn("play", F.monotonically_increasing_id()).withColumn("track", F.when(F.col("asset_id") == 4, "t one").when(F.col("asset_id") == 1, "t one"))
    marks = {r.inside for r in plays.shared_material(p).collect()}
    assert marks == {1} and plays.shared_material(p).count() == 1  # asset 4 has the track of a confident play
    e = plays.entries(p).join(p.select("play", "asset_id", "start"), "play").orderBy("start").collect()
    by = {(r.asset_id, r.start): r.entry for r in e}
    assert by[1, 0.0] == by[4, 12.0] == 1 and by[2, 10.0] == by[4, 12.0]
    g = sorted((r.start, r.end) for r in plays.gaps(p, 0.0, 400.0).collect())
    assert g == [(50.0, 140.0), (200.0, 400.0)]


def test_same_audio(spark):
    d = detections(spark, [(5, 0, 50, 0, 300, 5, 2), (6, 0, 50, 0, 300, 5, 2), (7, 0, 51, 0, 300, 5, 2)])
    got = {r.asset_id: list(r.also) for r in plays.same_audio(plays.plays(d)).collect()}
    assert got == {5: [6], 7: []}


def test_cue_times_increase(spark):
    rows = [(1, i, t) for i, t in enumerate([0.0, 1.0, 1.0, 1.001, 2.0, 2.0])]
    got = [r.frame for r in plays.cue_times(spark.createDataFrame(rows, "query_id long, entry int, start double")).orderBy("entry").collect()]
    want, last = [], -1
    for _, _, t in rows:
        last = max(round(t * 75), last + 1)
        want.append(last)
    assert got == want


# -- repeats and scores ------------------------------------------------------------


def test_repeats(spark):
    rng = random.Random(3)
    once = [f"h{rng.randint(0, 10**6)}" for _ in range(400)]
    seq = once[:300] + once[50:150] + once[300:]
    df = spark.createDataFrame([(1, h, i) for i, h in enumerate(seq)], "q long, hash string, at int")
    hits = repeats.repeat_hits(df, ["q"], 20, 40, 25, 2)
    strong = {(r.cell, r.lag): r.hits for r in hits.collect()}
    assert strong == {(c, 250): 25 for c in range(2, 6)}
    groups = repeats.repeat_groups(hits, ["q"], 10, 25)
    assert {r.group for r in groups.where("cell = 3").collect()} == {r.group for r in groups.where("cell = 13").collect()}
    blocks = sorted((r.start, r.end) for r in repeats.repeat_blocks(groups, ["q"], 25, 25).collect())
    assert (50, 75) in blocks or any(a <= 50 and b >= 75 for a, b in blocks)


def test_correspondences_take_the_first(spark):
    rows = [(1, 2, 0, 0, 10, 0, 10), (1, 2, 1, 50, 60, 50, 60), (1, 2, 2, 8, 55, 9, 52), (1, 2, 3, 58, 70, 58, 70), (1, 2, 4, 100, 101, 0, 5)]
    df = spark.createDataFrame(rows, "a long, b long, link int, a_start int, a_end int, b_start int, b_end int")
    assert {r.link: r.no for r in repeats.correspondences(df).collect()} == {0: 0, 1: 1, 2: 0, 3: 1, 4: 2}


def test_pieces_cover_spans(spark):
    df = spark.createDataFrame([("a", 0, 25), ("b", 0, 4)], "k string, start int, end int")
    got = sorted(tuple(r) for r in repeats.pieces(df, ["k"], 10, 7).collect())
    assert got == [("a", 0, 10), ("a", 7, 17), ("a", 14, 24), ("a", 15, 25), ("b", 0, 4)]


def test_scan_diff_is_greedy(spark):
    s = "set_id long, asset_id long, no long, start int, end int"
    old = spark.createDataFrame([(1, 1, 0, 0, 10), (1, 1, 1, 5, 20), (1, 2, 2, 0, 5)], s)
    new = spark.createDataFrame([(1, 1, 7, 4, 18), (1, 1, 8, 0, 5), (1, 3, 9, 0, 1)], s)
    got = {(r.old_no, r.new_no) for r in scoring.scan_diff(old, new).collect()}
    assert got == {(0, 7), (1, None), (2, None), (None, 8), (None, 9)}
    assert scoring.identical(old, old) and not scoring.identical(old, new)


def test_bootstrap_against_plain(spark):
    units = [(i, i % 5, 10 + i % 3) for i in range(13)]
    b = scoring.bootstrap(spark.createDataFrame(units, "unit_no long, k long, n long"), 200).first()
    rates = []
    for d in range(200):
        k = n = 0
        for s in range(13):
            x = (d * 7919 + s * 104729 + 12345) % 2147483647
            x = (x * 48271) % 2147483647
            u = units[(x * 48271 % 2147483647) % 13]
            k, n = k + u[1], n + u[2]
        rates.append(k / n)
    rates.sort()
    assert (b.low, b.high) == pytest.approx((rates[4], rates[194]))


def test_minimiser():
    fails = lambda steps: any(n == "bad" and v >= 0.3 for n, v in steps)
    assert scoring.minimised([("x", 1.0), ("bad", 1.0), ("y", 2.0)], fails) == [("bad", 0.5)]


def test_answers(spark):
    rows = [("q1", 1, "a", None), ("q1", 2, "b", None), ("q1", 3, None, 2), ("q2", 4, "c", None)]
    got = {r.question: r.answer for r in scoring.latest_answers(spark.createDataFrame(rows, "question string, seq int, answer string, undoes int")).collect()}
    assert got == {"q1": "a", "q2": "c"}


# -- fits ------------------------------------------------------------------------


def test_slopes(spark):
    rng = np.random.default_rng(0)
    x, w = rng.normal(size=30), rng.uniform(1, 5, 30)
    y = 2.5 * x + rng.normal(size=30) * 0.1
    df = spark.createDataFrame([("a", float(p), float(q), float(r)) for p, q, r in zip(x, y, w)], "k string, x double, y double, w double")
    slope = df.groupBy("k").agg(fits.weighted_slope(F.col("x"), F.col("y"), F.col("w")).alias("s")).first().s
    assert slope == pytest.approx(np.polyfit(x, y, 1, w=np.sqrt(w))[0])
    ts = fits.theil_sen(df, ["k"], "x", "y").first().slope
    assert ts == pytest.approx(np.median([(y[j] - y[i]) / (x[j] - x[i]) for i in range(30) for j in range(i)]))
    with pytest.raises(Exception, match="points"):
        fits.theil_sen(df, ["k"], "x", "y", most=10).collect()


def test_local_peaks_match_numpy(spark):
    rng = np.random.default_rng(1)
    p = rng.integers(0, 12, (25, 18)).astype(float)
    cells = spark.createDataFrame([("a", i, j, float(p[i, j])) for i in range(25) for j in range(18)], "k string, frame int, bin int, power double")
    got = {(r.frame, r.bin) for r in fits.local_peaks(cells, ["k"], 2, 3, 5.0).collect()}
    want = set()
    for i in range(25):
        for j in range(18):
            around = p[max(0, i - 2) : i + 3, max(0, j - 3) : j + 4]
            if p[i, j] >= 5 and p[i, j] == around.max() and (around == p[i, j]).sum() == 1:
                want.add((i, j))
    assert got == want and want
    for reach in (1, 2, 5):
        assert np.array_equal(fits.sliding_max(p, reach, 0), np.array([p[max(0, i - reach) : i + reach + 1].max(0) for i in range(25)]))


def test_tempo_and_drop():
    rate, bpm = 100.0, 140.0
    env = np.zeros(6000)
    env[(np.arange(0, 60, 60 / bpm) * rate).astype(int)] = 1.0
    assert 60 / fits.beat_period(env, rate) == pytest.approx(bpm, abs=1.0)
    env = np.concatenate([np.full(2000, 0.1), np.full(2000, 1.0)])
    assert fits.drop_time(env, rate) == 2000


def test_harmonic_percussive():
    p = np.full((60, 60), 1e-6)
    p[:, 20] = 1.0
    p[30, :] = 1.0
    h, q = fits.harmonic_percussive(p)
    assert h[10, 20] > 0.9 and q[30, 45] > 0.9


# -- scalars and sinks -----------------------------------------------------------


def test_timecodes(spark):
    rows = [("59", 59.0), ("1:05", 65.0), ("61:05", 3665.0), ("1:01:05.5", 3665.5), ("1:5", 65.0), ("1:2:3", 3723.0), ("0:00", 0.0), ("49:54", 2994.0), ("95.5", 95.5), ("1:05.5", 65.5), (" 2:00 ", 120.0)]
    rows += [(x, None) for x in ("", None, "1:60", "1:75:00", "a:00", "1:-5", "-3", "1::2", "1:2:3:4", "1:+5", "inf", "1.", ".5", "1:2.5:3", "18446744073709551616", "18446744073709551615:00", "18446744073709551615:59:59", "307445734561825860:59", "9" * 400)]
    df = spark.createDataFrame(rows, "t string, s double").select("t", "s", sc.parse_timecode(F.col("t")).alias("got"))
    assert [(r.t, r.got) for r in df.collect() if r.s != r.got] == []
    f = spark.createDataFrame([(0.0,), (65.9,), (3600.0,), (3661.0,)], "s double").select(sc.format_timecode(F.col("s")))
    assert [r[0] for r in f.collect()] == ["0:00", "1:05", "1:00:00", "1:01:01"]


def test_varint_and_bands(spark):
    v = [0, 127, 128, 16383, 16384, (1 << 62)]
    got = [r[0] for r in spark.createDataFrame([(x,) for x in v], "v long").select(sc.varint_length(F.col("v"))).collect()]
    assert got == [max(1, math.ceil(x.bit_length() / 7)) for x in v]


def test_near_hashes(spark):
    got = spark.createDataFrame([(0, -63, 1), (100, 0, 30)], "a int, b int, c int").select(sc.near_hashes(sc.pair_hash(F.col("a"), F.col("b"), F.col("c"))).alias("n")).collect()
    assert len(got[0].n) == 8 and len(set(got[1].n)) == 27


@pytest.mark.parametrize("line,yes,no", [("*.tmp", ["a.tmp", "x/b.tmp"], ["a.tmpx"]), ("/live", ["live/a.mp3"], ["x/live2"]), ("old/", ["old/a", "x/old/b"], ["old"]), ("a/**/c", ["a/c", "a/b/d/c"], ["x/a/c"]), ("t[1].wav", ["t[1].wav"], ["t1.wav"]), ("?.wav", ["a.wav"], ["ab.wav"])])
def test_ignore_patterns(line, yes, no):
    import re

    r = re.compile(library.pattern_regex(line))
    assert all(r.match(p) for p in yes) and not any(r.match(p) for p in no)
    assert library.pattern_regex("# note") is None and library.pattern_regex("  ") is None


def test_csv_lines(spark):
    df = spark.createDataFrame([(1, 2.0, 'a "b", c'), (2, None, "x\ny")], "a int, b double, c string")
    assert [r.line for r in sinks.csv_lines(df, {"b": 3}).collect()] == ['1,2.000,"a ""b"", c"', '2,,"x\ny"']


def test_statistics_count_empty_lists(spark):
    stats = spark.createDataFrame([(i, n) for i, n in enumerate([1, 1, 2, 5, 9])], "hash int, len long")
    r = index.index_stats(stats, 100).first()
    full = sorted([0] * 95 + [1, 1, 2, 5, 9])
    assert (r.used, r.postings, r.mean_len, r.p99_len, r.max_len, r.top_postings) == (5, 18, 0.18, full[99], 9, 9)


@pytest.mark.parametrize("copies", [41, 5000])
def test_large_groups_of_copies_are_one_cluster(spark, copies):
    """Neither equal items nor a large group of almost equal ones fall out for being many."""
    from seqloom.plans import compose

    words = [f"w{i}" for i in range(60)]
    rows = [(i, " ".join(words)) for i in range(copies)]
    near = [f"n{i}" for i in range(80)]
    rows += [(10_000 + i, " ".join([*near[: i % 70 + 2], f"own{i}", *near[i % 70 + 2 :]])) for i in range(60)]
    rows += [(20_000 + i, " ".join(f"x{i}y{j}" for j in range(30))) for i in range(5)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    pairs, clusters = compose.duplicate_clusters(compose.document_pairs(docs, "doc_id"), "doc_id", same=0.4)
    got = {}
    for r in clusters.collect():
        got.setdefault(r.component, set()).add(r.node)
    assert got == {0: set(range(copies)), 10_000: {10_000 + i for i in range(60)}}
    assert pairs.where(f"a < {copies}").count() == 0


def test_what_lacks_and_widths(spark):
    rows = [(200, 3, "ladder", ""), (199, 3, "ladder", "confident: 1 more hits"), (240, 2, "fitted", "confident: 1 more window"), (210, 1, "fitted", "confident: 30 more hits, 2 more windows"), (300, 0, "ladder", "confident: 3 more windows"), (59, 9, "ladder", "possible: 1 more hits")]
    df = spark.createDataFrame(rows, "h int, w int, p string, want string")
    assert all(r.want == r.got for r in df.select("want", sc.shortfall(F.col("h"), F.col("w"), F.col("p")).alias("got")).collect())
    widths = spark.createDataFrame([(-41.0,), (-40.0,), (-39.9,), (-20.0,), (-10.0,), (-9.9,)], "db double")
    assert [r[0] for r in widths.select(sc.width_class(F.col("db"))).collect()] == ["mono", "mono", "nearly-mono", "nearly-mono", "narrow", "wide"]


def test_ignore_lines_by_outermost_folder(spark):
    cases = [("foo**bar", "foo/x/bar", None), ("foo**bar", "a/fooxbar/c", 1), ("a/**/b", "a/b", 1), ("a/**/b", "a/x/y/b/c", 1), ("a/**", "a", None), ("a/**", "a/x", 1), ("**/x", "p/q/x", 1), ("x/", "x", None), ("x/", "p/x/q", 1), ("/x", "p/x", None), ("?.wav", "d/a.wav", 1), ("[a].wav", "a.wav", None)]
    for line, path, want in cases:
        got = spark.createDataFrame([(path,)], "path string").select(library.ignored_by(F.col("path"), [line])).first()[0]
        assert got == want, (line, path)
    lines = ["# note", "deep", "a", "a/deep/*"]
    paths = spark.createDataFrame([("a/deep/x",), ("b/deep/a",), ("c",)], "path string")
    assert [r[0] for r in paths.select(library.ignored_by(F.col("path"), lines)).collect()] == [3, 2, None]
