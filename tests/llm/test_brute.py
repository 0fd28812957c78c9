"""The text operators against plain models on small tables."""

import hashlib
import math
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from seqloom.llm import lm_score, simhash, topk

DOCS = "doc_id long, text string"
TEXTS = ["the cat sat on the mat", "The cat sat on the hat", None, "", "a", "ünïcode tëxt and more tëxt", "the cat sat on the mat", " \t\n", "one two three four five six seven eight nine ten " * 30]


def docs_of(spark, texts=TEXTS, ids=None):
    ids = ids or list(range(len(texts)))
    return spark.createDataFrame(list(zip(ids, texts)), DOCS)


def ppm(train, text, order):
    """Method C with symbol exclusion, by the book."""
    seen = defaultdict(Counter)

    def symbols(t):
        return [lm_score.PAD] * order + list(t) + [lm_score.END]

    for t in train:
        s = symbols(t)
        for i in range(order, len(s)):
            for k in range(order + 1):
                seen[tuple(s[i - k : i])][s[i]] += 1
    total, s = 0.0, symbols(text)
    for i in range(order, len(s)):
        out = set()
        for k in range(order, -1, -1):
            here = {a: n for a, n in seen[tuple(s[i - k : i])].items() if a not in out}
            n, d = sum(here.values()), len(here)
            if s[i] in here:
                total += math.log10(here[s[i]] / (n + d))
                break
            if d:
                total += math.log10(d / (n + d))
            out |= set(here)
        else:
            total -= math.log10(256 - len(out))
    return total


@pytest.mark.parametrize("order", [1, 3, 5])
def test_lm_score(spark, order):
    held = F.col("doc_id") % 3 == 1
    got = {r.doc_id: r for r in lm_score.score_documents(docs_of(spark), held, order=order, head_words=3).collect()}
    plain = [(t or "").encode() for t in TEXTS]
    train = [t for i, t in enumerate(plain) if i % 3 != 1]
    counts = Counter(w for t in train for w in t.lower().split())
    n, v, end = sum(counts.values()) + len(train), len(counts) + 1, len(train)
    for i, t in enumerate(plain):
        words = t.lower().split()
        base = sum(math.log10((c + 1) / (n + v + 1)) for c in [*(counts[w] for w in words), end])
        assert got[i].n_tokens == len(words) + 1 and got[i].n_known == sum(w in counts for w in words) + 1
        assert got[i].train_tokens == n and got[i].held_out == (i % 3 == 1)
        assert got[i].base_score == pytest.approx(base, abs=1e-9)
        assert got[i].score == pytest.approx(ppm(train, t, order), abs=1e-4)


def test_lm_score_bounds(spark):
    few = lm_score.score_documents(docs_of(spark), F.col("doc_id") < 0, order=2, max_nodes=20)
    assert all(r.score < 0 for r in few.collect())
    none = sorted(lm_score.score_documents(docs_of(spark), F.lit(True), order=2).collect())
    assert none[4].base_score == 0 and none[4].score == pytest.approx(-2 * math.log10(256))
    assert lm_score.score_documents(docs_of(spark, [], []), F.lit(False)).count() == 0


@pytest.mark.parametrize("low", [lm_score.LOW, 1])
def test_lm_score_keeps_rare_grams(spark, monkeypatch, low):
    """Grams that are not in the head count as those that are, whatever its size and the parts."""
    monkeypatch.setattr(lm_score, "LOW", low)
    monkeypatch.setattr(lm_score, "PART", 40)
    plain = [(t or "").encode() for t in TEXTS]
    train = [t for i, t in enumerate(plain) if i % 3 != 1]
    for size in (0, 15):
        got = {r.doc_id: r.score for r in lm_score.score_documents(docs_of(spark), F.col("doc_id") % 3 == 1, max_nodes=size).collect()}
        assert all(got[i] == pytest.approx(ppm(train, t, 5), abs=1e-4) for i, t in enumerate(plain))


def reach(fps, ids, radius):
    label = list(range(len(fps)))
    changed = True
    while changed:
        changed = False
        for i in range(len(fps)):
            for j in range(len(fps)):
                if label[j] < label[i] and bin(fps[i] ^ fps[j]).count("1") <= radius:
                    label[i], changed = label[j], True
    groups = defaultdict(list)
    for i, x in enumerate(label):
        groups[x].append(ids[i])
    return [min(groups[x]) for x in label]


def plain_fingerprint(text):
    words = (text or "").encode().lower().split()
    grams = [b" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))] if words else []
    hashes = [xxhash.xxh64_intdigest(g, 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def test_simhash(spark):
    got = sorted(simhash.near_duplicates(docs_of(spark)).collect())
    fps = [plain_fingerprint(t) for t in TEXTS]
    assert [r.fingerprint for r in got] == [f"{f:016x}" for f in fps]
    assert [r.component_id for r in got] == reach(fps, list(range(len(fps))), 4)
    assert simhash.near_duplicates(docs_of(spark, [], [])).count() == 0
    assert got[0].fingerprint == "%016x" % plain_fingerprint(TEXTS[0])


@pytest.mark.parametrize("radius", [0, 1, 3, 4])
def test_bit_sliced_links(radius):
    rng = np.random.default_rng(radius)
    centres = rng.integers(0, 1 << 63, 12, dtype=np.uint64)
    fps, bucket = [], []
    for b, n in enumerate([1, 2, 63, 64, 65, 200]):
        for _ in range(n):
            x = int(rng.choice(centres))
            for p in rng.integers(0, 64, rng.integers(0, 5)):
                x ^= 1 << int(p)
            fps.append(x)
            bucket.append(b)
    u, v = simhash.bucket_links(np.array(fps, np.uint64), np.array(bucket, np.int64), radius)
    links = {(int(a), int(b)) for a, b in zip(u, v)}
    values = sorted(set(fps))
    want = set()
    for b in range(6):
        own = [f for f, x in zip(fps, bucket) if x == b]
        want |= {(min(x, y), max(x, y)) for x in own for y in own if x != y and bin(x ^ y).count("1") <= radius}

    def comps(pairs):
        label = {f: f for f in values}
        for _ in values:
            moved = False
            for a, b in pairs:
                m = min(label[a], label[b])
                moved |= label[a] != m or label[b] != m
                label[a] = label[b] = m
            if not moved:
                break
        return label

    assert comps(links) == comps(want)


def test_near_links_finds_all(spark, monkeypatch):
    monkeypatch.setattr(simhash, "TILE", 16)
    rng = np.random.default_rng(5)
    centre = [int(x) for x in rng.integers(0, 1 << 63, 5, dtype=np.uint64)]
    fps = set()
    for _ in range(300):
        x = centre[rng.integers(0, 5)]
        for p in rng.integers(0, 64, rng.integers(0, 9)):
            x ^= 1 << int(p)
        fps.add(x)
    fps = sorted(fps)
    df = spark.createDataFrame([(f - (1 << 64) if f >> 63 else f,) for f in fps], "fp long")
    from seqloom.operators.graph import connected_components

    got = {r.node % (1 << 64): r.component for r in connected_components(simhash.near_links(df)).collect()}
    want = reach(fps, fps, 4)
    groups = defaultdict(set)
    for f, w in zip(fps, want):
        groups[w].add(f)
    mine = defaultdict(set)
    for f in fps:
        mine[got.get(f, ("alone", f))].add(f)
    assert sorted(map(sorted, groups.values())) == sorted(map(sorted, mine.values()))


def test_top_k(spark):
    rng = np.random.default_rng(1)
    rows = [(i, [float(x) for x in rng.normal(size=8)]) for i in range(300)]
    rows[7] = (7, None)
    rows[9] = (9, [1.0, None] + [0.0] * 6)
    rows[11] = (11, [float("nan")] * 8)
    rows[13] = (13, [float("inf")] * 8)
    rows[20] = (20, rows[21][1])
    rows[22] = (22, rows[21][1])
    rows.append((None, rows[1][1]))
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("v", F.lit(1))
    got = sorted(topk.exact_top_k(df, F.col("vec_id") % 50 == 0, block_rows=64, query_rows=2).collect())
    ok = {i: [math.floor(256 * x) for x in v] for i, v in rows if i is not None and v and all(x is not None and math.isfinite(x) for x in v)}
    want = []
    for q in sorted(i for i in ok if i % 50 == 0):
        best = sorted((-sum(a * b for a, b in zip(ok[q], ok[c])), c) for c in ok if c != q)[:5]
        want += [(q, r + 1, c, -s) for r, (s, c) in enumerate(best)]
    assert [tuple(r) for r in got] == want
    assert topk.exact_top_k(df.where("vec_id < 0"), F.col("vec_id") % 50 == 0).count() == 0


def corpus_vectors():
    import pyarrow.parquet as pq

    t = pq.read_table("/root/testdata/sf0.1/embeddings.parquet")
    return t.column("vec_id").to_numpy(), np.floor(256 * np.array(t.column("embedding").to_pylist(), float)).astype(np.int64)


def test_top_k_stops_on_proof():
    """The search ends before the last segment and scores few rows, with brute force's result."""
    ids, x = corpus_vectors()
    index = topk.ImpactIndex(ids, x)
    for q in np.flatnonzero(ids % 50 == 0):
        scores = x @ x[q]
        want = sorted(((-int(s), int(i)) for s, i in zip(scores, ids) if i != ids[q]))[:5]
        assert [(-s, i) for s, i in index.top(x[q], int(ids[q]), 5)] == want
        bar = -want[2][0]
        assert [(-s, i) for s, i in index.top(x[q], int(ids[q]), 5, bar)][:3] == want[:3]
    assert index.done < 0.75 * index.postings and index.scored < 0.2 * index.held


@pytest.mark.parametrize("scale,width", [(1, 3), (3, 1), (1 << 22, 9)])
def test_top_k_ties_and_large_values(scale, width):
    rng = np.random.default_rng(width)
    x = rng.integers(-3, 4, (500, width)) * scale
    x[100:200] = x[0]
    ids = rng.permutation(500)
    index = topk.ImpactIndex(ids, x, levels=4)
    for q in range(0, 300, 7):
        scores = x @ x[q]
        want = sorted(((-int(s), int(i)) for s, i in zip(scores, ids) if i != ids[q]))[:5]
        assert [(-s, i) for s, i in index.top(x[q], int(ids[q]), 5)] == want
