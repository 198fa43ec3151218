"""Queries against their DuckDB SQL over whole tables, odd rows and empty tables."""

import duckdb
import pytest
from pyspark.sql import functions as F

from refloom.llm import decontaminate, queries
from tests.llm.test_brute import edge, edge_dir, empty_dir  # noqa: F401
from tests.test_catalog import _rows

TABLES = "documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def middle():
    return "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def odd_dir(spark, edge_dir, tmp_path_factory):  # noqa: F811
    """Nulls, ties, repeated rows and columns with clashing names in all tables, and a very long text."""
    d = str(tmp_path_factory.mktemp("odd"))
    s = lambda rows, schema: spark.createDataFrame(rows, schema).selectExpr("*", "1 AS n", "2 AS host", "3 AS rank", "4 AS pair_id", "5 AS _key", "6 AS hash")
    docs = spark.read.parquet(f"{edge_dir}/documents.parquet").select("doc_id", "text", "lang", "source")
    long = spark.createDataFrame([(90, "lorem ipsum " * 30_000 + "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi", "en", "a")], docs.schema)
    docs.union(long).withColumn("n_chars", F.char_length("text").cast("long")).selectExpr("*", "1 AS size", "2 AS target", "3 AS taken", "4 AS w").write.parquet(f"{d}/documents.parquet")
    bench = [(1, "Alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron"), (2, "One"), (3, None), (4, ""), (5, "..."), (None, "two words"), (2, "One")]
    s(bench, "item_id long, text string").write.parquet(f"{d}/benchmark.parquet")
    vectors = [(0, [1.0, 0.0]), (0, [1.0, 0.0]), (0, [0.0, 1.0]), (100, None), (200, [None, 1.0]), (300, [float("nan"), 1.0]), (None, [1.0, 1.0])] + [(i, [float(i % 5), float(-i)]) for i in range(1, 30)]
    s(vectors, "vec_id long, embedding array<float>").write.parquet(f"{d}/embeddings.parquet")
    urls = [None, "", "no scheme", "http://A.Example.com/en/7x?q", "http://example.net:80/de/8/5", "x://h.org/es/2", "https://b.co/a/3", "https://b.co/a/3", "https://b.co/b-4.html#f", "a://b://c/6"]
    s([(i if i else None, u, None) for i, u in enumerate(urls)], "page_id long, url string, html string").write.parquet(f"{d}/pages.parquet")
    s([(3, 0, 0), (3, 1, 1), (4, None, None), (2, 1, 0), (None, 0, 1)], "doc_id long, quality int, toxic int").write.parquet(f"{d}/labels.parquet")
    turns = [(0, 0, "user", "hi"), (0, 1, "assistant", "yes"), (1, 0, "user", "hi"), (1, 1, "assistant", "né"), (1, 1, "assistant", "né"), (2, 0, None, None), (2, None, "user", "x"), (4, 0, "user", "a"), (5, 0, "user", "a"), (None, 0, "user", "z"), (-1, 0, "user", "q"), (-2, 0, "user", "q"), (-2, 1, "assistant", "")]
    s(turns, "conv_id long, turn long, role string, text string").write.parquet(f"{d}/conversations.parquet")
    return d


@pytest.mark.parametrize("where", ["middle", "odd_dir", "empty_dir"])
@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_query_matches_sql(spark, request, name, where):
    folder = request.getfixturevalue(where)
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{folder}/{t}.parquet" + ("')" if where == "middle" else "/*.parquet')"))
    df, want = queries.QUERIES[name](spark, folder), con.sql(queries.ORACLES[name])
    assert sorted(df.columns) == sorted(want.columns)
    assert _rows(df.columns, df.collect()) == _rows(want.columns, want.fetchall())


def test_shuffled_benchmark_windows_give_the_same(spark, odd_dir, monkeypatch):
    docs, bench = (spark.read.parquet(f"{odd_dir}/{t}.parquet") for t in ("documents", "benchmark"))
    run = lambda: decontaminate.decontaminate(docs.withColumn("_row", F.monotonically_increasing_id()), bench, "_row")
    plan = lambda: run()._jdf.queryExecution().toString()
    want = _rows(run().columns, run().collect())
    assert "BroadcastHashJoin" in plan() and "SortMergeJoin" not in plan()
    monkeypatch.setattr(decontaminate, "BROADCAST_ROWS", 0)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        assert "SortMergeJoin" in plan()
        assert _rows(run().columns, run().collect()) == want
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
