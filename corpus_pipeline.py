"""Cleaning a corpus in five stages, each an operator of refloom.llm over all that the stage before kept."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from refloom.llm.common import ensure_checkpoint_dir, numbered, table
from refloom.llm.decontaminate import decontaminate
from refloom.llm.mixing import mix
from refloom.llm.quality import classify
from refloom.llm.simhash import near_duplicates
from refloom.llm.suffix_dedup import cut_repeats

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that are probably neither toxic nor of low quality stay.  Null and empty texts have no fault to see and stay."""
    out = classify(docs.select(*COLUMNS), table(spark, sf_dir, "labels"))
    return out.filter("_keep").select(*COLUMNS)


def near_duplicate_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of copies and of groups linked by a shingle similarity of 0.8 or more the smallest doc_id stays (null last).  All null and
    wordless texts are one group; of repeated rows, which are copies with one doc_id, one stays."""
    rows = numbered(docs, "id")  # the same in every scan
    groups = near_duplicates(rows.select("id", "text"))
    order = F.struct(F.col("doc_id").isNull(), "doc_id", "id")
    firsts = groups.join(rows.select("id", "doc_id"), "id").groupBy("group").agg(F.min(order).alias("m")).select(F.col("m.id").alias("id"))
    return rows.join(firsts, "id", "left_semi").select(*COLUMNS)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Strings of 100 bytes that started before go; a document of which nothing is left goes, one that was empty stays.

    Null and empty texts stay as they are; rows of one doc_id are ordered by text, so of repeated long texts the first stays;
    null ids come last.  n_chars of a cut text is counted anew."""
    out = cut_repeats(docs.select(F.col("doc_id").cast("long").alias("doc_id"), *COLUMNS[1:]), as_text=True)
    left = out.filter((F.size("_starts") == 0) | (F.trim("_kept") != ""))
    cut = F.size("_starts") > 0
    return left.select("doc_id", F.when(cut, F.col("_kept")).otherwise(F.col("text")).alias("text"), "lang", "source", F.when(cut, F.char_length("_kept").cast("long")).otherwise(F.col("n_chars")).alias("n_chars"))


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Contaminated documents go; others stay as they are.  Null texts have no words and stay; repeated rows are judged alike, each on
    its own; an empty benchmark removes nothing."""
    rows = numbered(docs, "_row")
    hit = decontaminate(rows, table(spark, sf_dir, "benchmark"), "_row").filter("contaminated").select("_row")
    return rows.join(hit, "_row", "left_anti").select(*COLUMNS)


def source_mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the mixture takes, with their words taken (repetitions counted).  Null and wordless texts have no words to take and
    go; a null source is a source, last in order; repeated rows are taken one by one, ties in the order being alike."""
    return mix(docs.select(*COLUMNS)).filter("taken > 0")


STAGES = [
    ("quality", quality),
    ("near_duplicates", near_duplicate_documents),
    ("repeated_passages", repeated_passages),
    ("decontamination", benchmark_decontamination),
    ("mixture", source_mixture),
]

#: The stages run numpy in tasks, which SQL can't express; tests/llm holds them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; every stage is written to the shared checkpoint folder and read again."""
    ensure_checkpoint_dir(spark)
    docs, folder = table(spark, sf_dir, "documents"), f"{spark.sparkContext.getCheckpointDir()}/pipeline-{uuid.uuid4()}"
    for name, stage in STAGES[:-1]:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
