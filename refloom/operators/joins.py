"""Joins without an equal key, by keys that no pair can miss: overlapping ranges and texts that contain others."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..checkpoints import written

#: Width of the finest bins; a level's bins are four times as wide as those of the level before.
WIDTH = 256
LEVELS = 14
GRAM = 4


def _binned(rows: DataFrame, name: str) -> DataFrame:
    """Each range in its bins of the level that is as wide as it is long, and of all coarser ones: two a level at most, however long it is."""
    start, last = F.col(f"{name}_start"), F.greatest(F.col(f"{name}_start"), F.col(f"{name}_end") - 1)
    width = lambda level: (F.lit(WIDTH).cast("long") * F.pow(F.lit(4), level)).cast("long")
    own = F.array_min(F.filter(F.sequence(F.lit(0), F.lit(LEVELS)), lambda k: (last - start < width(k)) | (k == LEVELS)))
    at = F.flatten(F.transform(F.sequence(own, F.lit(LEVELS)), lambda k: F.transform(F.sequence(F.floor(start / width(k)), F.floor(last / width(k))), lambda b: F.struct(k.alias("level"), b.alias("bin"), (b == F.floor(start / width(k))).alias("first")))))
    return rows.withColumn(f"{name}_level", own).withColumn("_x", F.explode(at)).select(*rows.columns, f"{name}_level", "_x.level", "_x.bin", F.col("_x.first").alias(f"{name}_first"))


def overlapping(spans: DataFrame, ranges: DataFrame, key: str) -> DataFrame:
    """All pairs of a span and a range of one key where the range ends after the span's start and starts before its end, each once.

    spans: key, span_start, span_end; ranges: key, range_start, range_end; any further columns of other names stay.  Pairs meet at the coarser of their
    levels, in the first bin that both have.  A span that is empty or turned has no pairs, an empty range inside a span has one.  Nulls
    overlap nothing.
    """
    s = _binned(spans.filter("span_end > span_start"), "span")
    r = _binned(ranges.filter("range_end >= range_start"), "range")
    meet = (F.col("level") == F.greatest("span_level", "range_level")) & (F.col("span_first") | F.col("range_first"))
    out = s.join(r, [key, "level", "bin"]).filter(meet & (F.col("range_end") > F.col("span_start")) & (F.col("range_start") < F.col("span_end")))
    return out.drop("level", "bin", "span_level", "range_level", "span_first", "range_first")


def page_hints(spans: DataFrame, pages: DataFrame, key: str, span: str) -> DataFrame:
    """key, span, hint ("p. 3", "pp. 3-5") of the spans that lie on pages.  pages: key, page, range_start, range_end."""
    p = overlapping(spans, pages, key).groupBy(key, span).agg(F.min("page").alias("a"), F.max("page").alias("b"))
    return p.select(key, span, F.when(F.col("a") == F.col("b"), F.concat(F.lit("p. "), "a")).otherwise(F.concat(F.lit("pp. "), "a", F.lit("-"), "b")).alias("hint"))


def _substrings(c: Column, n: int) -> Column:
    return F.when(F.char_length(c) >= n, F.array_distinct(F.transform(F.sequence(F.lit(1), F.greatest(F.char_length(c) - n + 1, F.lit(1))), lambda i: F.substring(c, i, n)))).otherwise(F.array().cast("array<string>"))


def containing(outer: DataFrame, inner: DataFrame) -> DataFrame:
    """a, b of all pairs of texts where x contains y.  outer: a, x; inner: b, y (not blank).

    A text contains another only if it has every one of its GRAM-grams: it is met by the one that is rarest among the containing texts.  Texts
    shorter than that are met whole.  Equal texts of a side are joined once.
    """
    x, y = written(outer.select("x").filter("x != ''").distinct(), "outer"), written(inner.select("y").filter("y != ''").distinct(), "inner")
    short = [n for n in range(1, GRAM) if not y.filter(F.char_length("y") == n).isEmpty()]
    has = x.select("x", F.explode(F.concat(_substrings(F.col("x"), GRAM), *[_substrings(F.col("x"), n) for n in short])).alias("key"))
    df = has.groupBy("key").agg(F.count("*").alias("df"))
    each = y.select("y", F.explode(F.when(F.char_length("y") < GRAM, F.array("y")).otherwise(_substrings(F.col("y"), GRAM))).alias("key"))
    # a key that no containing text has settles it: the text is contained in none
    rank = F.row_number().over(Window.partitionBy("y").orderBy(F.coalesce("df", F.lit(0)), "key"))
    rarest = each.join(df, "key", "left").withColumn("_n", rank).filter("_n = 1 AND df IS NOT NULL").select("y", "key")
    met = has.join(rarest, "key").filter(F.col("x").contains(F.col("y"))).select("x", "y")
    return outer.join(met, "x").join(inner, "y").select("a", "b")
