"""Text and identifier functions on literal rows."""

from pyspark.sql import functions as F

from refloom.functions import identifiers as I
from refloom.functions import text as X


def _map(spark, f, values):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v string")
    return [r[0] for r in df.orderBy("i").select(f(F.col("v"))).collect()]


def test_doi_forms(spark):
    assert _map(spark, I.clean_doi, ["https://doi.org/10.1234/Test", "10.1234/test", None]) == ["10.1234/test", "10.1234/test", None]
    assert _map(spark, I.doi, ["see 10.1234/abc.", "nothing", None]) == ["10.1234/abc", None, None]


def test_identifier_types(spark):
    assert _map(spark, I.identifier_type, ["10.1234/x", "PMC123", "12345", "https://a.org/x", "word"]) == ["doi", "pmcid", "pmid", "url", "unknown"]


def test_case_rules(spark):
    assert _map(spark, X.sentence_case, ["THE QUICK BROWN FOX JUMPED", "A study of DNA replication"])[1] == "A study of DNA replication"
    assert _map(spark, X.title_case, ["the art of war"]) == ["The Art of War"]


def test_normalize(spark):
    assert _map(spark, X.normalize, ["  A  Study: of X! ", "", None]) == ["a study of x", "", None]
