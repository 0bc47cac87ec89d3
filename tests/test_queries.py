"""Every registered query against its DuckDB oracle at sf0.001 (the driver does sf0.01)."""

import math
from collections import Counter

import duckdb
import pytest

import __spark_entry__ as entry
from scoreplane.plans.queries import REGISTRY

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages "
          "benchmark labels conversations").split()


def _norm(v):
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 6)
    return v


def _bag(cols, rows):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    return Counter(tuple(_norm(r[i]) for i in order) for r in rows)


@pytest.fixture(scope="module")
def duck(sf_small):
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_small}/{t}.parquet')")
    return con


def test_entry_smoke(spark):
    df = entry.entry(spark)
    assert df.count() > 0
    assert "f1_score_weighted" in df.columns


def test_every_query_has_an_oracle():
    missing = set(REGISTRY) - set(entry.oracle_sql())
    assert missing == set()


@pytest.mark.parametrize("name", sorted(REGISTRY))
def test_query_matches_oracle(spark, duck, sf_small, name):
    sdf = entry.queries()[name](spark, sf_small)
    srows = [tuple(r) for r in sdf.collect()]
    cur = duck.execute(entry.oracle_sql()[name])
    dcols = [d[0] for d in cur.description]
    drows = cur.fetchall()
    assert sorted(sdf.columns) == sorted(dcols)
    assert _bag(sdf.columns, srows) == _bag(dcols, drows)
