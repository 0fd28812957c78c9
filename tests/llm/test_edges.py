"""All ten operators on tables with nulls, empty and long texts, repeated rows, clashing names, and no rows."""

import pytest
from pyspark.sql import functions as F

from seqloom.llm import bpe, decontaminate, langid, license_scan, line_dedup, lm_score, quality, secrets, simhash, topk
from seqloom.llm.queries import tokenizer_path

LONG = "some words of a long text " * 3000
ROWS = [
    (1, "The license of this file: Apache License, Version 2.0.", "en", "s", 10),
    (1, "The license of this file: Apache License, Version 2.0.", "en", "s", 10),
    (2, None, None, None, None),
    (None, "text without an id", "de", "t", 1),
    (3, "", "", "", 0),
    (4, LONG, "en", "s", len(LONG)),
    (5, "x" * 60_000, "fr", "s", -1),
    (6, " \t\n\r\x0b\x0c ", "en", "s", 7),
    (7, "token = 'Zx81Qw99abTT' \U0001f642 日本", "en", "s", 7),
]
NAMES = "row_id held_out n_tokens n_known base_score score spans doc key gone fp fingerprint component component_id hash word n gram start keep good order label_id at leaf tokens item_id similarity paragraph line family v rank query_id b qb lang_pred template of size tail".split()


@pytest.fixture(scope="module")
def docs(spark):
    plain = spark.createDataFrame(ROWS, "doc_id long, text string, lang string, source string, n_chars long")
    return plain, plain.withColumns({n: F.lit(n) for n in NAMES})


def operators(spark):
    labels = spark.createDataFrame([(1, 1), (4, 1), (5, 0), (6, 0), (None, 1), (2, None)], "doc_id long, quality int")
    bench = spark.createDataFrame([(1, "some words of a long text some words"), (2, None), (None, "")], "item_id long, text string")
    held = F.coalesce(F.col("doc_id"), F.lit(0)) % 2 == 0
    return {
        "langid": lambda d: langid.identify(d, held, per_lang=5),
        "lm": lambda d: lm_score.score_documents(d, held, order=3, head_words=4),
        "secrets": secrets.scan,
        "quality": lambda d: quality.digest(quality.classify(d, labels)),
        "simhash": simhash.near_duplicates,
        "bpe": lambda d: bpe.encode_decode(d, tokenizer_path(), leaf_chars=5000),
        "lines": line_dedup.dedup_lines,
        "license": license_scan.scan,
        "leaks": lambda d: decontaminate.contaminated(d, bench),
    }


@pytest.mark.parametrize("name", ["langid", "lm", "secrets", "quality", "simhash", "bpe", "lines"])
def test_one_row_for_each_row(spark, docs, name):
    f = operators(spark)[name]
    plain, odd = docs
    columns = [c for c in f(plain).columns if c != "lines_removed"]
    key = lambda df: sorted((tuple(round(v, 6) if isinstance(v, float) else v for v in r) for r in df.select(*columns).collect()), key=str)
    got = key(f(plain))
    assert len(got) == len(ROWS) and key(f(odd)) == got
    assert f(odd.where("doc_id < 0")).count() == 0


@pytest.mark.parametrize("name", ["license", "leaks"])
def test_findings(spark, docs, name):
    f = operators(spark)[name]
    plain, odd = docs
    key = lambda df: sorted(map(tuple, df.collect()), key=str)
    got = key(f(plain))
    assert {r[0] for r in got} == ({1} if name == "license" else {4})
    assert key(f(odd)) == got and f(odd.where("doc_id < 0")).count() == 0


def test_null_texts_are_empty_ones(spark, docs):
    ops, (plain, _) = operators(spark), docs
    for name in ("lm", "secrets", "simhash", "bpe"):
        rows = {r.doc_id: r for r in ops[name](plain).collect()}
        same = [c for c in rows[2].asDict() if c not in ("doc_id", "held_out")]
        assert [rows[2][c] for c in same] == [rows[3][c] for c in same], name


def test_top_k_with_clashing_names(spark):
    rows = [(0, [1.0, 0.5]), (50, [0.5, -1.0]), (50, [0.5, -1.0]), (51, [1.0]), (52, []), (53, None), (None, [1.0, 1.0]), (54, [1.0, 0.5]), (55, [1.0, 0.5])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    odd = df.withColumns({n: F.lit(n) for n in NAMES})
    got = sorted(map(tuple, topk.exact_top_k(df, F.col("vec_id") % 50 == 0, k=3).collect()))
    assert sorted(map(tuple, topk.exact_top_k(odd, F.col("vec_id") % 50 == 0, k=3).collect())) == got
    assert [r[2] for r in got if r[0] == 0] == [54, 55, 51]
    assert all(r[2] != 50 for r in got if r[0] == 50) and len([r for r in got if r[0] == 50]) == 3
