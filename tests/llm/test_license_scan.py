"""The license scan against its model in plain Python, and on alterations it was not trained on."""

import random
import re
import textwrap
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from seqloom.llm import license_scan as ls


def plain(text):
    families, grams, w, b, t = ls.trained()
    index = {g: i for i, g in enumerate(grams)}
    own = ls.grams_of(ls.words_of(text))
    z = (sum((w[index[g]].astype(float) for g in own if g in index), np.zeros(len(families))) + b) / t
    p = np.exp(z - z.max()) / np.exp(z - z.max()).sum()
    family = families[int(p.argmax())] if p.max() >= ls.LIKELY else ls.UNKNOWN
    like = max((len(own & (g := ls.grams_of(ls.words_of(x)))) / len(g) for x in ls.NOTICES.get(family, [])), default=0.0)
    return family, float(p.max()), like, like >= ls.CONFIRMED


def plain_scan(text):
    """Rows of a text: its blocks and their lines, each scored, and the rule that leaves one of a block and its lines."""
    lines, blocks, here = text.split("\n"), [], []
    for i, line in enumerate([*lines, ""]):
        if re.search(r"[^\W_]", line):
            here.append(i)
        elif here:
            blocks.append(here)
            here = []
    out = []
    for own in blocks:
        whole = plain("\n".join(lines[i] for i in own))
        each = {i: plain(lines[i]) for i in own}
        each = {i: p for i, p in each.items() if p[0] != ls.UNKNOWN}
        alike = [i for i, p in each.items() if p[0] == whole[0]]
        if len(own) > 1 and whole[0] != ls.UNKNOWN and (not any(each[i][3] for i in alike) if whole[3] else not alike):
            out.append((own[0], len(own), *whole))
            alike = [i for i in alike if whole[3]]
            each = {i: p for i, p in each.items() if i not in alike}
        out += [(i, 1, *p) for i, p in each.items()]
    return out


def test_against_plain_model(spark):
    rng = random.Random(3)
    lines = [x for texts in ls.NOTICES.values() for x in texts] + ls.OTHER
    docs = []
    for i in range(60):
        some = []
        for _ in range(rng.randint(0, 6)):
            words = rng.choice(lines).split()
            some.append(" ".join(w for w in words if rng.random() > 0.1) if rng.random() < 0.5 else f"plain words, {rng.random()} only")
            some[-1] = rng.choice(["", "# ", "  * "]) + (textwrap.fill(some[-1], 50) if rng.random() < 0.3 else some[-1])
            some += rng.choice([[], [""], ["#", ""], ["   "]])
        docs.append((i, "\n".join(some), "x"))
    docs += [(None, lines[0], "x"), (70, None, "x"), (71, "", "x"), (72, lines[0], "x"), (72, lines[0], "x"), (73, "Mit dem Zug", "x"), (74, "\n\n" + lines[0] + "\n", "x"), (75, "#\n" + lines[0] + "\n#\n\n" + lines[9], "x")]
    df = spark.createDataFrame(docs, "doc_id long, text string, family string")
    got = sorted(((r.doc_id, r.paragraph, r.lines, r.family, r.confirmed, r.probability, r.similarity) for r in ls.scan(df).collect()), key=lambda r: str(r[:5]))
    want = sorted(((i, p[0], p[1], p[2], p[5], p[3], p[4]) for i, text, _ in docs for p in plain_scan(text or "")), key=lambda r: str(r[:5]))
    assert [a[:5] for a in got] == [b[:5] for b in want] and any(a[2] > 1 for a in got)
    assert np.allclose([a[5:] for a in got], [b[5:] for b in want], atol=1e-4)
    assert ls.scan(df.where("doc_id < 0")).count() == 0


def test_long_lines_take_linear_time(spark):
    """A line's words are cut once, not for each of its n-grams."""
    long = "license " + " ".join(f"w{i % 977}" for i in range(20_000)) + " " + ls.NOTICES["mit"][0]
    df = spark.createDataFrame([(1, long), (2, "no notice")], "doc_id long, text string").cache()
    ls.scan(df.where("doc_id = 2")).collect()
    began = time.time()
    known = [r[0] for r in ls._model_rows()[0]] + [f"w1 w{i}" for i in range(977)] + ["w1"]
    grams = df.where("doc_id = 1").select(ls.grams_column(ls.words_column(F.col("text")), known).alias("g")).first().g
    assert sorted(grams) == sorted(ls.grams_of(ls.words_of(long)) & set(known))
    assert {r.doc_id for r in ls.scan(df).collect()} <= {1} and time.time() - began < 8


def test_what_is_left_out_is_unknown():
    """Whatever n-grams a paragraph has, what they add at most is no less than what they add to any family."""
    families, grams, w, b, _ = ls.trained()
    by, lead = ls.bounds()
    most = {g: m for m, own in by.items() for g in own}
    assert set(most) == set(grams)
    rng = random.Random(1)
    for _ in range(300):
        own = rng.sample(range(len(grams)), rng.randint(0, 40))
        z = sum((w[i].astype(float) for i in own), np.zeros(len(families))) + b
        if z[:-1].max() >= z[-1]:
            assert sum(most[grams[i]] for i in own) >= lead - 1e-3


def test_held_out_alterations():
    rng = random.Random(99)
    right, n = 0, 0
    for family, texts in ls.NOTICES.items():
        for text in texts:
            for words in ls.alterations(text, rng, 5):
                if len(words) >= 4:
                    p = plain(" ".join(words))
                    n += 1
                    right += p[0] == family
    assert right / n > 0.9  # of the rest most lost the very words that name the family
    wrong = [x for x in ls.OTHER if plain(x)[0] != ls.UNKNOWN]
    fresh = ["Our new license plates arrived with the permission of the council.", "The general public distributed leaflets in the commons.", "Copyright is discussed in chapter nine."]
    assert len(wrong) <= 1 and not [x for x in fresh if plain(x)[0] != ls.UNKNOWN]


@pytest.mark.parametrize("family", list(ls.NOTICES))
def test_notices_are_found(family):
    for text in ls.NOTICES[family]:
        p = plain(text)
        assert p[0] in (family, ls.UNKNOWN)
    assert any(plain(t)[0] == family and plain(t)[3] for t in ls.NOTICES[family])


def test_corpus_notices(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    want = {}
    says = {"Licensed under CC BY-NC 4.0.": "cc-by-nc", "Released under the MIT License.": "mit", "All rights reserved.": "proprietary", "Licensed under the Apache License, Version 2.0.": "apache-2.0", "This work is licensed under the GNU General Public License, version 3.": "gpl"}
    for r in docs.collect():
        for n, line in enumerate(r.text.split("\n")):
            if line in says:
                want[r.doc_id, n] = says[line]
    got = {(r.doc_id, r.paragraph): r.family for r in ls.scan(docs).where("confirmed").collect()}
    assert {k: got.get(k) for k in want} == want and set(got) - set(want) == set()


def test_wrapped_notices(spark):
    """Notices wrapped as in source headers and licence files, and a version that is part of the name."""
    mit, gpl = ls.NOTICES["mit"][3], ls.NOTICES["gpl"][3]
    docs = [
        (1, "intro\n\n" + textwrap.fill(mit, 72) + "\n\n" + "Mit dem Zug\nnach Hause\n"),
        (2, "x = 1\n#\n" + "\n".join("# " + x for x in textwrap.wrap(gpl, 70)) + "\n#\n# more\n"),
        (3, "Released under GPLv3"),
        (4, "The MIT License (MIT)\nand a line"),
        (5, textwrap.fill(mit, 30)),
    ]
    rows = ls.scan(spark.createDataFrame(docs, "doc_id long, text string")).collect()
    assert {(r.doc_id, r.paragraph, r.family) for r in rows if r.confirmed} >= {(1, 2, "mit"), (2, 2, "gpl"), (4, 0, "mit"), (5, 0, "mit")}
    assert [(r.paragraph, r.lines, r.family) for r in rows if r.doc_id == 4] == [(0, 1, "mit")]
    assert [(r.paragraph, r.family) for r in rows if r.doc_id == 3] == [(0, "gpl")]


def test_scan_is_native(spark):
    plan = ls.scan(spark.read.parquet("/root/testdata/sf0.001/documents.parquet"))._jdf.queryExecution().toString()
    assert not any(x in plan for x in ("Python", "Pandas", "Arrow", "ExistingRDD"))
