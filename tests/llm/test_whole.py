"""Queries over empty tables and rows with nulls; the pipeline; the quality classifier on documents held out."""

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from refloom.llm import html_extract, quality, queries
from tests.llm.test_brute import EDGE, brute_decontaminate, edge, edge_dir, empty_dir  # noqa: F401


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_empty_tables(spark, empty_dir, name):  # noqa: F811
    assert queries.QUERIES[name](spark, empty_dir).collect() == []


@pytest.mark.parametrize("name", ["op2_mix_sources", "op3_token_counts", "op4_suffix_dedup", "op5_simhash", "op6_decontaminate", "op9_quality"])
def test_one_row_per_document(spark, edge_dir, name):  # noqa: F811
    assert queries.QUERIES[name](spark, edge_dir).count() == len(EDGE)


def test_stages_on_edge_rows(spark, edge_dir):  # noqa: F811
    docs = spark.read.parquet(f"{edge_dir}/documents.parquet").withColumn("n_chars", F.char_length("text").cast("long"))
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, edge_dir)
        assert out.columns[:5] == corpus_pipeline.COLUMNS, name
        assert 0 < out.count() <= len(EDGE)


def test_pipeline_stages_take_effect(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    bench = [tuple(r) for r in spark.read.parquet(f"{small}/benchmark.parquet").select("item_id", "text").collect()]
    rows = [tuple(r) for r in docs.select("doc_id", "text").collect()]
    clean = {r[0] for r in brute_decontaminate(rows, bench) if not r[-1]}
    assert {r[0] for r in corpus_pipeline.benchmark_decontamination(spark, docs, small).select("doc_id").collect()} == clean


@pytest.mark.parametrize("sf", ["/root/testdata/sf0.01", "/root/testdata/sf0.1"])
def test_quality_on_held_out_documents(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text", "source", "lang")
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    held = F.pmod(F.xxhash64("doc_id"), F.lit(4)) == 0
    out = quality.classify(docs, labels.filter(~held)).select("doc_id", "_keep").join(quality.document_labels(labels.filter(held)), "doc_id")
    clean = (F.col("toxic") == 0) & (F.col("low") == 0)
    r = out.agg(
        F.count_if((F.col("toxic") == 1) & ~F.col("_keep")).alias("caught"), F.sum("toxic").alias("toxic"), F.count_if((F.col("low") == 1) & ~F.col("_keep")).alias("rejected"), F.sum("low").alias("low"),
        F.count_if(clean & F.col("_keep")).alias("kept"), F.count_if(clean).alias("clean"),
    ).first()
    assert r["kept"] >= 0.9 * r["clean"]
    assert r["caught"] >= 0.7 * r["toxic"]
    assert r["rejected"] >= 0.7 * r["low"]


def test_html_extraction_keeps_the_article(spark):
    page = "<html><head><title>t</title><style>x{}</style></head><body><nav><a href='/'>Home</a></nav><article><h1>Head &amp; line</h1><p>First  para\n one.</p><p>Second.</p></article><footer>Imprint</footer><script>var a=1</script></body></html>"
    pages = spark.createDataFrame([(1, "http://a.org/1", page), (2, "http://a.org/2", None), (3, None, "")], "page_id long, url string, html string")
    import tempfile

    folder = tempfile.mkdtemp(prefix="refloom-test-")
    pages.write.parquet(f"{folder}/pages.parquet")
    got = {r["page_id"]: (r["text"], r["n_chars"]) for r in html_extract.op1_html_extract(spark, folder).collect()}
    want = "Head & line\nFirst para one.\nSecond."
    assert got == {1: (want, len(want)), 2: ("", 0), 3: ("", 0)}
