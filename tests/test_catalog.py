"""Every query with SQL against DuckDB over the same tables."""

import math

import duckdb
import pytest

from refloom.plans import catalog
from tests import cases

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def _value(x):
    if isinstance(x, float):
        return "nan" if math.isnan(x) else round(x, 6)
    if isinstance(x, list | tuple):
        return tuple(map(_value, x))
    return x if x is None or isinstance(x, int | str | bool) else str(x)


def _rows(names, rows):
    order = sorted(range(len(names)), key=names.__getitem__)
    return sorted((tuple(_value(r[i]) for i in order) for r in rows), key=repr)


FOLDERS = {"small": "/root/testdata/sf0.001", "middle": "/root/testdata/sf0.01"}


@pytest.fixture(scope="module")
def duck():
    out = {}
    for name, folder in FOLDERS.items():
        out[name] = duckdb.connect()
        for t in TABLES:
            out[name].sql(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet'")
    return out


def _check(spark, con, name, queries, oracles, folder):
    df = queries[name](spark, folder)
    want = con.sql(oracles[name])
    assert sorted(df.columns) == sorted(want.columns)
    assert _rows(df.columns, df.collect()) == _rows(want.columns, want.fetchall())


@pytest.mark.parametrize("where", sorted(FOLDERS))
@pytest.mark.parametrize("name", sorted(catalog.ORACLES))
def test_query_matches_sql(spark, duck, name, where):
    _check(spark, duck[where], name, catalog.QUERIES, catalog.ORACLES, FOLDERS[where])


@pytest.mark.parametrize("name", sorted(cases.ORACLES))
def test_case_gives_its_answers(spark, duck, name):
    _check(spark, duck["small"], name, cases.QUERIES, cases.ORACLES, FOLDERS["small"])


def test_every_query_has_sql():
    assert set(catalog.QUERIES) == set(catalog.ORACLES)
