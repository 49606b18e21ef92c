"""Every query with SQL gives the rows that DuckDB gives on the same tables."""

import math
import os

import duckdb
import pytest

from corpuslens.plans.registry import flagship, oracle_sql, queries

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
ORACLES = oracle_sql()


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        path = f"{SF}/{t}.parquet"
        c.execute(f"create view {t} as select * from '{path + '/*.parquet' if os.path.isdir(path) else path}'")
    return c


def _plain(rows):
    clean = [tuple(None if isinstance(x, float) and math.isnan(x) else x for x in r) for r in rows]
    return sorted(clean, key=lambda r: [(x is None, str(type(x)), str(x)) for x in r])


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_same_rows(spark, con, name):
    df = queries()[name](spark, SF)
    columns = sorted(df.columns)
    mine = [tuple(r) for r in df.select(*(f"`{c}`" for c in columns)).collect()]
    got = con.execute(ORACLES[name])
    names = [d[0] for d in got.description]
    assert sorted(names) == columns
    at = [names.index(c) for c in columns]
    assert _plain(mine) == _plain([tuple(r[i] for i in at) for r in got.fetchall()])


@pytest.mark.parametrize("name", sorted(set(queries()) - set(ORACLES)))
def test_runs(spark, name):
    assert queries()[name](spark, SF).count() >= 0


def test_flagship(spark):
    assert flagship(spark, SF).count() > 0
