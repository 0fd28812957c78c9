"""Seeds and alignment against the full dynamic program on every document and item."""

import random

import numpy as np
import pytest

from seqloom.llm import decontaminate as dc


def plain_score(a, b):
    h = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    best = 0
    for i, x in enumerate(a, 1):
        for j, y in enumerate(b, 1):
            h[i][j] = max(0, h[i - 1][j - 1] + (2 if x == y else -1), h[i - 1][j] - 1, h[i][j - 1] - 1)
            best = max(best, h[i][j])
    return best


@pytest.mark.parametrize("seed", range(6))
def test_align(seed):
    rng = np.random.default_rng(seed)
    for _ in range(40):
        a, b = rng.integers(0, 5, rng.integers(1, 12)), rng.integers(0, 5, rng.integers(1, 25))
        score, lo, hi, same = dc.align(a, b)
        assert score == plain_score(a.tolist(), b.tolist())
        assert score == 0 or plain_score(a.tolist(), b[lo:hi].tolist()) == score and same <= hi - lo


def edited(words, rng, share):
    out = []
    for w in words:
        x = rng.random()
        if x < share / 2:
            out.append(f"edit{rng.randint(0, 999)}")
        elif x < share * 0.75:
            continue
        elif x < share:
            out += [w, f"more{rng.randint(0, 999)}"]
        else:
            out.append(w)
    return out


def test_against_every_pair(spark):
    rng = random.Random(4)
    words = [f"w{i}" for i in range(400)] + ["the", "of", "and"] * 40
    prose = lambda n: [rng.choice(words) for _ in range(n)]
    items = [prose(rng.randint(12, 30)) for _ in range(12)]
    docs = []
    for i in range(80):
        own = prose(rng.randint(0, 120))
        if i % 3 == 0:
            k = rng.randrange(12)
            at = rng.randint(0, len(own))
            own[at:at] = edited(items[k], rng, rng.choice([0, 0.1, 0.25, 0.33, 0.4]))
        docs.append((i, " ".join(own).capitalize() + "!", "x"))
    docs += [(None, " ".join(items[0]), "x"), (900, None, "x"), (901, "", "x"), (902, " ".join(items[1] * 3), "x"), (902, " ".join(items[1] * 3), "x")]
    bench = [(k, ", ".join(t).upper(), 0.5) for k, t in enumerate(items)] + [(100, None, 0.0), (101, "", 0.0), (102, "the of", 0.0)]
    d = spark.createDataFrame(docs, "doc_id long, text string, item_id string")
    b = spark.createDataFrame(bench, "item_id long, text string, similarity double")
    got = dc.contaminated(d, b).collect()
    want = []
    for i, t, _ in docs:
        for k, x in [*enumerate(items), (102, ["the", "of"])]:
            if k == 102 and " the of " not in " " + " ".join(x.decode() for x in dc.words_of(t)) + " ":
                continue
            s = plain_score([w.encode() for w in x], dc.words_of(t)) / (2 * len(x))
            if s >= 0.5:
                want.append((i, k, round(s, 9)))
    order = lambda x: (x[0] is None, x[0] or 0, x[1])
    assert sorted(((r.doc_id, r.item_id, round(r.similarity, 9)) for r in got), key=order) == sorted(want, key=order)
    assert len(want) > 20
    assert dc.contaminated(d.where("doc_id < 0"), b).count() == 0 and dc.contaminated(d, b.where("item_id < 0")).count() == 0


PATTERNS = {
    "every third word replaced": lambda w, i: [f"x{i}"] if i % 3 == 2 else [w],
    "every third word dropped": lambda w, i: [] if i % 3 == 2 else [w],
    "a word behind every other": lambda w, i: [w, f"x{i}"] if i % 2 else [w],
    "a word behind each": lambda w, i: [w, f"x{i}"],
    "every other pair swapped for others": lambda w, i: [f"x{i}"] if i % 6 in (4, 5) else [w],
    "the first half only": lambda w, i: [w] if i < 16 else [],
    "as it is": lambda w, i: [w],
}


@pytest.mark.parametrize("name", PATTERNS)
@pytest.mark.parametrize("common", [False, True])
def test_edits_are_found_to_the_bound(name, common):
    """Whatever the edits and however common the words, an item at the least similarity is found."""
    rng = random.Random(name)
    pool = [f"w{i}" for i in range(40 if common else 5000)]
    items = [[rng.choice(pool) for _ in range(rng.choice([3, 5, 17, 30]))] for _ in range(60)]
    block = dc.Block.of(list(range(60)), [" ".join(x) for x in items])
    block = block.rare(np.random.default_rng(1).integers(0, 9, len(block.grams)), 0.5)
    want = 0
    for k, item in enumerate(items):
        text = [rng.choice(pool) for _ in range(20)] + [x for i, w in enumerate(item) for x in PATTERNS[name](w, i)] + [rng.choice(pool) for _ in range(20)]
        words = np.array([block.vocabulary.get(w.encode(), -1) for w in text])
        got = {r[0]: r for r in dc.matches(block, words, *block.hits(words), 0.5)}
        for n, other in enumerate(items if common else [item]):
            n = n if common else k
            similarity = plain_score(other, text) / (2 * len(other))
            assert (n in got) == (similarity >= 0.5)
            if n in got:
                assert got[n][1] == similarity
                want += 1
    assert want > 0 or name in ("the first half only", "a word behind each")


def test_random_edits_are_found(spark):
    rng = random.Random(11)
    pool = [f"w{i}" for i in range(800)]
    items = [[rng.choice(pool) for _ in range(30)] for _ in range(40)]
    docs, want = [], {}
    for i in range(400):
        k, share = i % 40, (0.0, 0.1, 0.25, 0.33, 0.4)[i // 80]
        text = [rng.choice(pool) for _ in range(15)] + edited(items[k], rng, share) + [rng.choice(pool) for _ in range(15)]
        docs.append((i, " ".join(text)))
        if plain_score(items[k], text) >= 30:
            want.setdefault(share, set()).add((i, k))
    d, b = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(list(enumerate(map(" ".join, items))), "item_id long, text string")
    got = {(r.doc_id, r.item_id) for r in dc.contaminated(d, b).collect()}
    assert all(len(some) > 20 and some <= got for some in want.values()) and len(want) == 5


def test_short_items_are_found_whole(spark):
    docs = spark.createDataFrame([(1, "a zebra here"), (2, "quite Okapi, gnu!"), (3, "gnu okapi"), (4, "okapi x gnu"), (5, None), (6, "zebra")], "doc_id long, text string")
    items = spark.createDataFrame([(1, "Zebra."), (2, "okapi gnu"), (3, "")], "item_id long, text string")
    got = {(r.doc_id, r.item_id): (r.similarity, r.word_start, r.word_end, r.equal_words) for r in dc.contaminated(docs, items).collect()}
    assert got == {(1, 1): (1.0, 1, 2, 1), (6, 1): (1.0, 0, 1, 1), (2, 2): (1.0, 1, 3, 2)}


def test_long_items_need_little_memory():
    """Two rows of the program are held, whatever the lengths."""
    import tracemalloc

    rng = np.random.default_rng(3)
    item = rng.integers(0, 5000, 2000)
    window = np.r_[rng.integers(0, 5000, 9000), item, rng.integers(0, 5000, 9000)]
    tracemalloc.start()
    assert dc.align(item, window) == (4000, 9000, 11000, 2000)
    assert tracemalloc.get_traced_memory()[1] < 20 << 20
    tracemalloc.stop()


def test_blocks_find_the_same(spark, monkeypatch):
    sf = "/root/testdata/sf0.01"
    d, b = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "benchmark"))
    one = sorted(dc.contaminated(d, b).select("doc_id", "item_id").collect())
    monkeypatch.setattr(dc, "BLOCK_BYTES", 4000)
    assert sorted(dc.contaminated(d, b).select("doc_id", "item_id").collect()) == one and one
