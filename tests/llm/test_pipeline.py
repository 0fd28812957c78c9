"""Each stage of the pipeline against a plain version, on the rows that the stage before it kept."""

import hashlib
import random

import numpy as np
import public_tokenizers
from pyspark.sql import functions as F

import corpus_pipeline
from seqloom.llm import bpe, quality, simhash
from seqloom.llm import decontaminate as dc
from seqloom.session import materialise
from tests.llm.test_decontaminate import plain_score
from tests.llm.test_line_dedup import plain as plain_lines

SF = "/root/testdata/sf0.001"


def test_stages(spark):
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert [n.split()[0] for n in names] == ["quality", "line", "simhash", "benchmark", "bpe"]
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    tables, columns = [docs], docs.columns
    for _, stage in corpus_pipeline.STAGES:
        tables.append(materialise(stage(spark, tables[-1], SF), "stage"))
    assert all(t.columns == columns for t in tables[:-1])
    rows = [[tuple(r) for r in t.select("doc_id", "text").collect()] for t in tables[:5]]
    scored = quality.classify(docs, spark.read.parquet(f"{SF}/labels.parquet")).where("score >= 0.5")
    assert sorted(rows[1]) == sorted((r.doc_id, r.text) for r in scored.collect()) and len(rows[1]) < len(rows[0])
    assert sorted(rows[2], key=str) == sorted(((i, t) for i, t, _ in plain_lines(rows[1])), key=str)
    ids = [i for i, _ in rows[2]]
    group = plain_groups([t for _, t in rows[2]], ids)
    assert sorted(i for i, _ in rows[3]) == sorted(i for i, g in zip(ids, group) if i == g) and len(rows[3]) < len(rows[2])
    bench = [dc.words_of(r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    bad = {i for i, t in rows[3] for b in bench if plain_bound(dc.words_of(t), b) and plain_score(b, dc.words_of(t)) >= len(b)}
    assert sorted(i for i, _ in rows[4]) == sorted({i for i, _ in rows[3]} - bad)
    coder = bpe.Coder(open(public_tokenizers.path("byte_bpe_50k.json"), encoding="utf-8").read())
    want = {i: hashlib.sha256(np.array(coder.tokenizer.encode(t, add_special_tokens=False).ids, "<u4").tobytes()).hexdigest() for i, t in rows[4]}
    assert {r.doc_id: r.ids_sha256 for r in tables[5].collect()} == want
    assert {tuple(r) for r in corpus_pipeline.run(spark, SF).collect()} == {tuple(r) for r in tables[5].collect()}


def plain_sets(texts):
    out = []
    for t in texts:
        words = (t or "").encode().lower().split()
        out.append({tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set())
    return out


def plain_groups(texts, ids, similarity=0.8):
    """The least id of all that similarities of shingle sets join, by comparing every two."""
    sets = plain_sets(texts)
    label = list(range(len(texts)))
    for i in range(len(sets)):
        for j in range(i):
            a, b = sets[i], sets[j]
            if label[i] != label[j] and (a == b or len(a & b) >= similarity * len(a | b) > 0):
                label = [label[i] if x == label[j] else x for x in label]
    return [min(ids[j] for j in range(len(ids)) if label[j] == label[i]) for i in range(len(ids))]


def varied(rng, words, share):
    return [f"v{rng.randint(0, 9999)}" if rng.random() < share else w for w in words]


def test_near_duplicates_at_the_similarity(spark, monkeypatch):
    """Groups are those of every-pair comparison, in tiles as well; a chain of copies is one group."""
    rng = random.Random(6)
    texts = []
    for _ in range(40):
        base = [f"w{rng.randint(0, 3000)}" for _ in range(rng.choice([6, 12, 40, 150, 600]))]
        texts += [" ".join(varied(rng, base, rng.choice([0, 0.005, 0.01, 0.02, 0.05]))) for _ in range(rng.choice([1, 2, 6]))]
        if rng.random() < 0.3:  # each differs a little from the one before
            for _ in range(8):
                base = varied(rng, base, 0.01)
                texts.append(" ".join(base))
    texts += [None, "", " \n", "a b", "A  b", texts[0]]
    rng.shuffle(texts)
    ids = rng.sample(range(10_000), len(texts))
    df = spark.createDataFrame(list(zip(ids, texts)), "doc_id long, text string")
    want = {i for i, g in zip(ids, plain_groups(texts, ids)) if i == g}
    assert {r.doc_id for r in simhash.one_of_each(df).collect()} == want and len(want) < len(ids) - 20
    monkeypatch.setattr(simhash, "TILE_SHINGLES", 300)
    monkeypatch.setattr(simhash, "BROADCAST_IDS", 0)
    assert {r.doc_id for r in simhash.one_of_each(df).collect()} == want


def test_keys_and_bits_find_what_is_similar():
    """How often two sets of 0.8 share no key, or differ in more bits than are looked at."""
    rng = np.random.default_rng(2)
    missed = far = 0
    for _ in range(400):
        n = int(rng.integers(20, 400))
        same = rng.integers(0, 1 << 63, n, dtype=np.uint64)
        more = rng.integers(0, 1 << 63, max(2, n // 4), dtype=np.uint64)
        a, b = np.unique(np.r_[same, more[: len(more) // 2]]), np.unique(np.r_[same, more[len(more) // 2 :]])
        missed += not set(simhash.band_keys(a)) & set(simhash.band_keys(b))
        far += bin(simhash.majority(a) ^ simhash.majority(b)).count("1") > simhash.FAR
    assert missed <= 4 and far == 0


def plain_bound(words, item):
    """Only equal words add to a score; enough to leave most pairs out of the slow program."""
    return 2 * sum(w in set(words) for w in item) >= len(item)


def test_one_of_each_with_repeated_and_null_ids(spark):
    a, b = "one two three four five six seven", "quite another text with other words in it"
    rows = [(5, a, 1), (5, a, 1), (3, a, 2), (None, a, 3), (None, b, 4), (None, b, 4), (7, None, 5), (8, "", 6), (9, b + " and a long tail of words that differ", 7), (9, a + " " + b, 8)]
    df = spark.createDataFrame(rows, "doc_id long, text string, component_id int")
    got = sorted((tuple(r) for r in simhash.one_of_each(df).collect()), key=str)
    assert (3, a, 2) in got and (5, a, 1) not in got and (None, a, 3) not in got
    assert got.count((None, b, 4)) == 1 and (7, None, 5) in got and (8, "", 6) not in got
    assert len(got) == 5 and simhash.one_of_each(df.where("doc_id < 0")).count() == 0


def test_clean_keeps_columns(spark):
    item = " ".join(f"w{i}" for i in range(20))
    df = spark.createDataFrame([(1, f"x {item} y", [1]), (None, item, None), (2, None, [2]), (3, "clean", [3])], "doc_id long, text string, item_id array<int>")
    got = dc.clean(df, spark.createDataFrame([(1, item)], "item_id long, text string"))
    assert sorted(r.doc_id for r in got.collect()) == [2, 3] and got.columns == df.columns


def test_stages_on_odd_tables(spark):
    """Nulls in any column, empty and long texts, repeated rows, clashing names; and no rows at all."""
    long = "many words of one long text " * 4000
    rows = [(1, "a fine text with words", "en", "s", 20), (1, "a fine text with words", "en", "s", 20), (None, "a text without an id here", "en", None, None), (2, None, None, None, None), (3, "", "", "", 0), (4, long, "en", "s", len(long)), (5, "x" * 100_000, "de", "t", -7), (6, "line one of six words here\nline two of six words here\n\n", "en", "s", 50), (7, "line one of six words here\nline two of six words here\nmore", "en", "s", 50)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    odd = docs.withColumns({n: F.lit(n) for n in ("keep", "score", "good", "label_id", "lines_removed", "doc", "key", "gone", "fp", "component", "fingerprint", "row_id", "at", "item_id")})
    for table in (docs, odd, odd.where("doc_id < 0")):
        for _, stage in corpus_pipeline.STAGES:
            out = materialise(stage(spark, table, SF), "odd")
            if stage is not corpus_pipeline.encode:
                assert out.dtypes == table.dtypes
                if "keep" in table.columns:
                    assert out.where("keep <> 'keep' or lines_removed <> 'lines_removed' or fp <> 'fp'").count() == 0
            else:
                assert out.count() == table.count()
    texts = {r.doc_id: r.text for r in corpus_pipeline.dedup_lines(spark, odd, SF).collect()}
    assert texts[7] == "more" and texts[6].startswith("line one") and texts[2] is None and texts[3] == ""
    kept = [r.doc_id for r in corpus_pipeline.near_dedup(spark, odd, SF).collect()]
    assert kept.count(1) == 1 and (2 in kept) != (3 in kept)
