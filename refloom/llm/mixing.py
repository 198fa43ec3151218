"""Mixing sources to target weights: capped water-filling and seeded repetition.

Built from DataFrame functions.  Nothing is collected; the only window without a key runs over one row per source.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import WORD, table

#: Weights of the sources in code-point order, repeating; null counts as the last source.
WEIGHTS = (5, 2, 1)
MAX_EPOCHS = 3
SEED = 20
#: A source's documents are dealt by so many hexadecimal digits of their hash to slices; only slice totals are summed up in order.
SLICE_DIGITS = 4


def n_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def targets(sizes: DataFrame, weights=WEIGHTS, max_epochs: int = MAX_EPOCHS) -> DataFrame:
    """sizes: source, source_size.  Adds weight and target.

    Water-filling: every source gets level * weight, but max_epochs * source_size at most, and the level is such that all
    targets together are the total size.  Sources reach their cap in the order of cap / weight, so that the clamped
    ones are a prefix in that order; the level that holds for the rest after clamping the first k is
    (total - caps of the first k) / (weights of the others).  This is where clamping and resharing by weight ends.

    The windows without a key run over one row per source in one task: 100 bytes for each, so sources are bounded by what a
    task can sort (tens of millions), not by documents.
    """
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    w = F.element_at(F.array(*map(F.lit, weights)), (F.pmod(F.row_number().over(by_name) - 1, F.lit(len(weights))) + 1).cast("int"))
    s = sizes.withColumn("weight", w.cast("double")).withColumn("cap", F.col("source_size") * float(max_epochs))
    order = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last())
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    every = order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    s = s.withColumn("level", (F.sum("source_size").over(every) - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / (F.sum("weight").over(every) - F.coalesce(F.sum("weight").over(before), F.lit(0.0))))
    s = s.withColumn("open", F.col("level") * F.col("weight") <= F.col("cap"))
    s = s.withColumn("level", F.min(F.when(F.col("open"), F.struct((F.col("cap") / F.col("weight")).alias("at"), "source", "level"))).over(every)["level"])
    return s.select("source", "source_size", "weight", F.least(F.col("cap"), F.coalesce(F.col("level") * F.col("weight"), F.col("cap"))).alias("target"))


def mix(docs: DataFrame, weights=WEIGHTS, max_epochs: int = MAX_EPOCHS, seed: int = SEED) -> DataFrame:
    """Adds size, source_size, target and taken to docs (doc_id, text, source and any other columns).

    Every document of a source is taken floor(target / source_size) times.  The words still wanted are taken by one more
    repetition of the documents that come first in a seeded hash order, up to the document whose middle passes what is
    wanted: a source misses its target by half a document at most.  A hot source is spread over 2**16 hash slices.

    Nulls: a null text has size 0; a null source is a source of its own, last in order.  Repeated rows count one by
    one.  An empty table gives an empty result.  Columns of docs with the names of added ones are replaced.
    """
    added = ["size", "source_size", "target", "taken"]
    keep = [c for c in docs.columns if c.lower() not in added]
    h = F.md5(F.concat(F.lit(f"{seed}|"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit("|"), F.coalesce("text", F.lit(""))))
    d = docs.select(F.struct(*[F.col(f"`{c}`") for c in keep]).alias("_row"), F.col("source").alias("_s"), n_words(F.col("text")).alias("size"), h.alias("_h"))
    d = d.withColumn("_slice", F.substring("_h", 1, SLICE_DIGITS))
    slices = d.groupBy("_s", "_slice").agg(F.sum("size").alias("n"))
    t = targets(slices.groupBy(F.col("_s").alias("source")).agg(F.sum("n").alias("source_size")), weights, max_epochs)
    whole = F.when(F.col("source_size") > 0, F.least(F.floor(F.col("target") / F.col("source_size")), F.lit(max_epochs))).otherwise(F.lit(0)).cast("long")
    t = t.withColumn("_whole", whole).withColumn("_rest", F.col("target") - F.col("_whole") * F.col("source_size"))
    ahead = F.coalesce(F.sum("n").over(Window.partitionBy("_s").orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    slices = slices.withColumn("_ahead", ahead).join(t, F.col("_s").eqNullSafe(F.col("source"))).select(F.col("_s").alias("_s2"), F.col("_slice").alias("_slice2"), "_ahead", "source_size", "target", "_whole", "_rest")
    d = d.join(slices, F.col("_s").eqNullSafe(F.col("_s2")) & (F.col("_slice") == F.col("_slice2")))
    run = Window.partitionBy("_s", "_slice").orderBy("_h", "size").rowsBetween(Window.unboundedPreceding, -1)
    middle = F.col("_ahead") + F.coalesce(F.sum("size").over(run), F.lit(0)) + F.col("size") / 2
    extra = F.when((F.col("_whole") < max_epochs) & (middle < F.col("_rest")), 1).otherwise(0)
    return d.withColumn("taken", F.col("size") * (F.col("_whole") + extra)).select("_row.*", *added)


def op2_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    return mix(docs).select("doc_id", "size", "source_size", "target", "taken")
