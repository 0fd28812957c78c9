"""Trained operators: accuracy on rows they did not learn from, and the edges of their inputs."""

import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from seqloom.llm import langid, linear, quality

SF = "/root/testdata/sf0.01"


def test_split_is_crc32(spark):
    df = spark.createDataFrame([(1,), (77,), (None,)], "doc_id long").select("doc_id", langid.held_out_remainder(F.col("doc_id")).alias("h"))
    assert {r.doc_id: r.h for r in df.collect()} == {i: zlib.crc32(b"" if i is None else str(i).encode()) % 5 == 0 for i in (1, 77, None)}


def test_language_id(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    got = langid.identify(docs, langid.held_out_remainder(F.col("doc_id")), per_lang=80)
    right = got.join(docs, "doc_id").where("held_out").agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("int"))).first()[0]
    assert right > 0.97
    assert got.where("score < 0 or score > 1").count() == 0 and got.count() == docs.count()


def plain_language(model, text):
    """The family by most wins over the others, then the language within it; n-grams counted one by one."""
    folded = bytearray(b" " + text + b" ")
    for i in range(1, len(folded) - 1):
        b = text[i - 1]
        folded[i] = b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32
        if i > 1 and text[i - 2] == 0xC3 and 0x80 <= b <= 0x9E:
            folded[i] += 32
    count = {}
    for i in range(len(text) + 1):
        padded = bytes(folded) + b" "
        for n in (1, 2, 3):
            g = int.from_bytes(padded[i : i + n], "big")
            h = ((g * 2654435761 + n * 0x9E3779B9) % (1 << 32) * 0x85EBCA6B) % (1 << 32) >> 19
            count[h] = count.get(h, 0) + 1
    total = sum(count.values())
    margin = {p: sum(n / total * model.weights[h, k] for h, n in count.items()) for k, p in enumerate(model.pairs)}

    def winner(classes):
        wins = {c: [m if p[0] == c else -m for p, m in margin.items() if c in p and set(p) <= set(classes)] for c in classes}
        best = max(classes, key=lambda c: sum(m > 0 for m in wins[c]) + 0.5 * linear.sigmoid(np.array(sum(wins[c]))))
        return best, min(wins[best], default=np.inf)

    family, sure = winner([f"family:{f}" for f in model.families])
    lang, inner = winner([g for g in model.langs if f"family:{langid.family_of(g)}" == family])
    return lang, float(min(linear.sigmoid(np.array([sure, inner]))))


def test_language_id_against_a_plain_version(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    held = langid.held_out_remainder(F.col("doc_id"))
    model = langid.fit(docs.withColumn("h", held).where("not h"), per_lang=60)
    got = {r.doc_id: r for r in langid.identify(docs, held, per_lang=60).collect()}
    some = [r for r in docs.orderBy("doc_id").limit(80).collect() if r.text and len(r.text) < 3000]
    for r in some:
        lang, score = plain_language(model, r.text.encode())
        assert (got[r.doc_id].lang_pred, got[r.doc_id].score) == (lang, pytest.approx(score, abs=1e-3))
    assert len(some) > 50
    few = langid.fit(docs, per_lang=20, most_langs=2)
    assert len(few.langs) == 2


def test_language_id_edges(spark):
    rows = [(i, t, g, 1.0) for i, (t, g) in enumerate([("the cat and the dog", "en"), ("der hund und die katze", "de"), ("le chat et le chien", "fr"), ("zzz", "xx"), (None, "en"), ("123 !!", "en"), ("", None), ("the dog", None)])]
    rows += [rows[0], (None, "the cat", "en", 2.0)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, score double")
    got = langid.identify(df, F.lit(False), per_lang=10).collect()
    assert len(got) == len(rows)
    by = {r.doc_id: r for r in got}
    assert [by[i].lang_pred for i in range(4)] == ["en", "de", "fr", "xx"]
    assert [by[i].lang_pred for i in (4, 5, 6)] == ["und"] * 3 and by[4].score == 0
    assert {r.lang_pred for r in langid.identify(df, F.lit(True)).collect()} == {"und"}
    one = langid.identify(df.where("lang = 'en'"), F.lit(False)).collect()
    assert {r.lang_pred for r in one} == {"en", "und"}
    assert langid.identify(df.where("doc_id < 0"), F.lit(False)).count() == 0


def test_language_scores_do_not_depend_on_neighbours(spark):
    df = spark.read.parquet(f"{SF}/documents.parquet").limit(60)
    a = langid.identify(df.repartition(1), F.lit(False), per_lang=20)
    b = langid.identify(df.repartition(7), F.lit(False), per_lang=20)
    x, y = ({r.doc_id: r.score for r in z.collect()} for z in (a, b))
    assert x.keys() == y.keys() and all(abs(x[k] - y[k]) < 1e-5 for k in x)


def test_machines_separate():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(300, 5))
    w = np.array([1.0, -2, 0, 0.5, 0])
    y = np.sign(x @ w)
    assert (np.sign(x @ linear.svm(x, y, c=10)) == y).mean() > 0.98
    fit = linear.logistic(x, (y > 0).astype(float), ridge=0.1)
    assert ((linear.logit_of(x, fit) > 0) == (y > 0)).mean() > 0.98


def test_quality(spark):
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    train, rest = labels.where("doc_id % 3 <> 0"), labels.where("doc_id % 3 = 0")
    got = quality.classify(docs, train, most=1000)
    assert got.count() == docs.count()
    right = got.join(rest, "doc_id").agg(F.avg((F.col("keep") == (F.col("quality") == 1)).cast("int"))).first()[0]
    assert right > 0.93


def test_exchange_draws_from_all_rows(spark, monkeypatch):
    """Every unlabelled row is scored in each round, and what is handed on comes from all sources and parts of the table."""
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    seen = []
    plain = quality.even_rates
    monkeypatch.setattr(quality, "even_rates", lambda counts, n: seen.append((counts.copy(), n, plain(counts, n))) or seen[-1][2])
    quality.fit(docs.repartition(5), labels, most=100, rounds=1)
    table = docs.select("doc_id", "text", "source", "lang", "n_chars").toPandas()
    import pyarrow as pa

    batch = pa.RecordBatch.from_pandas(table)
    assert quality._views(batch)[0].shape[0] == len(table)
    assert sum(c.sum() for c, _, _ in seen[:2]) > len(table) // 4  # the text view is sure of many of all the rows
    for counts, n, rates in seen:
        assert (rates <= 1).all() and (rates[counts == 0] == 0).all()
        assert (counts * rates).sum() == pytest.approx(min(n, counts.sum()))


def test_packed_views_are_the_views():
    import pyarrow as pa

    batch = pa.RecordBatch.from_pydict({"place": [1, 2, 3], "good": pa.array([None, 1, 0], pa.int32()), "text": ["Some text, of words!", None, "x"], "source": ["a", None, "b"], "lang": ["en", "de", None], "n_chars": [20, None, -4]})
    (packed,) = quality._pack([batch])
    t, m = quality._unpacked(packed.column("views"))[1]
    wt, wm = quality._views(batch)
    assert np.allclose(t, wt, atol=1e-6) and (m == wm).all() and (m.sum(1) == 3).all()


def plain_logistic_accuracy(docs, labels):
    """One regression on both views side by side, by a plain loop, on the same split."""
    import pyarrow as pa

    batch = pa.RecordBatch.from_pandas(docs.reset_index(drop=True))
    x = np.hstack(quality._views(batch)).astype(float)
    y = np.array([labels.get(i, -1) for i in docs.doc_id])
    x = (x - x.mean(0)) / np.maximum(x.std(0), 0.02)
    train, rest = (y >= 0) & (docs.doc_id % 3 != 0), (y >= 0) & (docs.doc_id % 3 == 0)
    w = np.zeros(x.shape[1] + 1)
    xt = np.hstack([x, np.ones((len(x), 1))])
    for _ in range(300):
        p = 1 / (1 + np.exp(-xt[train] @ w))
        w -= 0.05 * (xt[train].T @ (p - y[train]) / train.sum() + 1e-3 * w)
    return ((xt[rest] @ w > 0) == (y[rest] == 1)).mean()


def test_quality_is_no_worse_than_one_plain_model(spark):
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    got = quality.classify(docs, labels.where("doc_id % 3 <> 0"), most=1000).join(labels.where("doc_id % 3 = 0"), "doc_id")
    right = got.agg(F.avg((F.col("keep") == (F.col("quality") == 1)).cast("int"))).first()[0]
    assert right > plain_logistic_accuracy(docs.toPandas(), {r.doc_id: r.quality for r in labels.collect()}) - 0.01


def test_quality_edges(spark):
    rows = [(1, "good text here and more", "s", "en", 20), (1, "good text here and more", "s", "en", 20), (None, None, None, None, None), (3, "", "s", "en", -1), (4, "BAD!! BAD!! BAD!!", "t", "en", 3), (5, "BAD!! WORSE!!", "t", "en", 3), (6, "fine words in a row", None, "fr", 1 << 40)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, lang string, n_chars long").withColumn("keep", F.lit(7))
    labels = spark.createDataFrame([(1, 1, 0), (1, 1, 0), (6, 1, 0), (4, 0, 0), (5, 0, 0), (3, 1, 0), (3, 0, 0), (None, 1, 0), (2, None, 0)], "doc_id long, quality int, toxic int")
    got = quality.classify(docs, labels)
    assert got.count() == len(rows) and got.where("score between 0 and 1").count() == len(rows)
    assert {r.keep for r in got.where("doc_id in (4, 5)").collect()} == {False}
    assert {r.keep for r in quality.classify(docs, labels.where("quality = 1")).collect()} == {True}
    assert quality.classify(docs.where("doc_id < 0"), labels).count() == 0


@pytest.mark.parametrize("text", [b"", b"a", b"ab", b"a b", "é".encode()])
def test_text_view_of_small_texts(text):
    import pyarrow as pa

    got = quality.text_view(pa.array([text.decode(), None]))
    assert got.shape == (2, quality.TEXT_WIDTH) and np.isfinite(got).all()
