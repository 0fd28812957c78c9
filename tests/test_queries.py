"""Every registered query of the reference's operators against its SQL."""

import math

import duckdb
import pytest

from seqloom.plans.queries import ORACLES, QUERIES

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def plain(v):
    if isinstance(v, bool) or v is None or isinstance(v, str):
        return v
    if isinstance(v, (int, float)) or type(v).__name__ == "Decimal":
        return "nan" if math.isnan(v) else round(float(v), 6)
    return v


@pytest.mark.parametrize("name", list(ORACLES))
def test_query_says_what_its_sql_says(spark, db, name):
    df = QUERIES[name](spark, SF)
    result = db.execute(ORACLES[name])
    names = [d[0] for d in result.description]
    assert sorted(names) == sorted(df.columns)
    want = [tuple(map(plain, r)) for r in result.fetchall()]
    got = [tuple(map(plain, r)) for r in df.select(*(f"`{c}`" for c in names)).collect()]
    assert sorted(got, key=str) == sorted(want, key=str)


@pytest.mark.parametrize("name", [n for n in QUERIES if n not in ORACLES])
def test_queries_without_sql_run(spark, name):
    assert QUERIES[name](spark, SF).count() > 0
