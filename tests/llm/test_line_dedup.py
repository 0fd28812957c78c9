"""Line dedup against a plain model, and the SQL on the same rows."""

import random

import pytest
from pyspark.sql import functions as F

from seqloom.llm import line_dedup as ld


def plain(rows, **options):
    """Rows in the order of ids, null last; a chunk's first place by (id, start)."""
    order = sorted(range(len(rows)), key=lambda i: (rows[i][0] is None, rows[i][0] or 0))
    first = {}
    for i in order:
        doc = ld.LAST if rows[i][0] is None else rows[i][0]
        if rows[i][1] is not None:
            for start, n, chunk in ld.chunks(rows[i][1].encode(), **options):
                first[chunk] = min(first.get(chunk, (doc, start)), (doc, start))
    out = []
    for doc, text in rows:
        if text is None:
            out.append((doc, None, 0))
            continue
        doc_key, gone, seen = ld.LAST if doc is None else doc, set(), set()
        for start, n, chunk in ld.chunks(text.encode(), **options):
            if chunk in seen or first[chunk][0] < doc_key:
                gone |= set(range(start, start + n))
            seen.add(chunk)
        lines = text.split("\n")
        out.append((doc, "\n".join(x for i, x in enumerate(lines) if i not in gone), len(gone)))
    return sorted(out, key=str)


def tables(seed):
    rng = random.Random(seed)
    pool = [" ".join(f"w{rng.randint(0, 99)}" for _ in range(rng.choice([0, 1, 4, 8, 60]))) for _ in range(14)]
    rows = [(i, "\n".join(rng.choice(pool) if rng.random() < 0.6 else f"only {rng.random()} here and a few more words {i}" for _ in range(rng.randint(0, 12)))) for i in range(60)]
    return rows + [(60, None), (61, ""), (None, rows[3][1]), rows[4], rows[4], (4, "other\n" + rows[5][1]), (62, rows[0][1]), (63, "\n\n\n")]


@pytest.mark.parametrize("seed,bits,limit", [(0, 64, 2_000_000), (1, 64, -1), (2, 5, 2_000_000), (3, 5, -1)])
def test_against_plain_model(spark, monkeypatch, seed, bits, limit):
    monkeypatch.setattr(ld, "BROADCAST_HASHES", limit)
    monkeypatch.setattr(ld, "BROADCAST_DOCS", limit)
    rows = tables(seed)
    df = spark.createDataFrame([(*r, 1, "s") for r in rows], "doc_id long, text string, key int, gone string")
    got = ld.dedup_lines(df, hash_bits=bits)
    assert got.columns == ["doc_id", "text", "key", "gone", "lines_removed"]
    assert sorted(((r.doc_id, r.text, r.lines_removed) for r in got.collect()), key=str) == plain(rows)


def test_every_line_stays_somewhere(spark):
    rows = tables(9)
    df = spark.createDataFrame(rows, "doc_id long, text string")
    left = {x for r in ld.dedup_lines(df).collect() if r.text is not None for x in r.text.split("\n")}
    assert {x for _, t in rows if t for x in t.split("\n")} <= left
    assert ld.dedup_lines(df.where("doc_id < 0")).count() == 0


def test_boundaries_resist_shifts():
    lines = [b"line %d with some words in it" % i for i in range(200)]
    a = {c for _, n, c in ld.chunks(b"\n".join(lines)) if n > 2}
    b = {c for _, n, c in ld.chunks(b"\n".join([b"new first line", *lines[:90], b"new middle", *lines[90:]])) if n > 2}
    assert len(a & b) >= len(a) - 3


def test_chunks_do_not_depend_on_what_is_around():
    """The lines of a passage of 50 words between other lines are in chunks that both copies have, whatever their length, edges included."""
    rng = random.Random(8)
    lost = lines = 0
    for most in (1, 2, 4, 12, 40, 45):
        for _ in range(200):
            passage = []
            while sum(len(x.split()) for x in passage) < 50:
                passage.append(b" ".join(b"p%d" % rng.randint(0, 99999) for _ in range(rng.randint(1, most))))
            texts = [[b"own %d line" % rng.randint(0, 1 << 40) for _ in range(rng.randint(0, 5))] for _ in range(4)]
            found = [{c for _, _, c in ld.chunks(b"\n".join([*x, *passage, *y]))} for x, y in (texts[:2], texts[2:])]
            covered = {line for c in found[0] & found[1] for line in c.split(b"\n")}
            lines += len(passage)
            lost += len(set(passage) - covered)
    assert lost < lines / 500


def test_stretches_without_ends():
    """Equal lines have one rolling hash; the chunks stay short and cover all of them."""
    for line in (b"x", b"ab cd", b"one line of words", b""):
        for n in (1, 2, 40, 5000):
            got = list(ld.chunks(b"\n".join([line] * n + [b"last"])))
            assert all(k <= ld.MOST_LINES for _, k, _ in got) and len(got) <= 2 * n + 2
            if line and n > 30:
                assert {i for a, k, _ in got for i in range(a, a + k)} >= set(range(n))


def test_blank_lines_within_a_chunk(spark):
    text = "first line of five words\n\n   \nsecond line of five words\n\nthird line, five words too"
    rows = [(1, text), (2, "other\n\n" + text + "\n"), (3, "\n\n")]
    got = {r.doc_id: (r.text, r.lines_removed) for r in ld.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {1: (text, 0), 2: ("other\n\n", 6), 3: ("\n\n", 0)}


def test_sql_says_the_same(spark):
    import duckdb

    from seqloom.llm.queries import ORACLES, QUERIES

    sf = "/root/testdata/sf0.01"
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{sf}/documents.parquet'")
    want = con.execute(ORACLES["op9_line_dedup"]).fetchall()
    names = [d[0] for d in con.description]
    got = [tuple(r) for r in QUERIES["op9_line_dedup"](spark, sf).select(*names).collect()]
    assert sorted(got) == sorted(want)
    assert sum(r[names.index("lines_removed")] > 0 for r in want) > 50
    assert F is not None
