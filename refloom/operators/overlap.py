"""Best matches by shared tokens, without joining every token.

Tokens of an item are put in order from the rarest on.  A pair that is to share `need` or more of an item's tokens must share one of those
after which less than `need` would be left, so only these are joined.  A first join on a demanding bound gives candidates and with them
every row's floor, the score that it has for sure; a second one looks only for what could reach that floor.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..checkpoints import written
from .listings import small

#: The share that the first join looks for.
FIRST = 0.45


def frequencies(docs: DataFrame) -> DataFrame:
    """docs: ts, distinct tokens.  t, df: the number of rows that have a token; combined in the tasks before the shuffle."""
    return docs.select(F.explode("ts").alias("t")).groupBy("t").agg(F.count("*").alias("df"))


def ranked(items: DataFrame, df: DataFrame) -> DataFrame:
    """items: item, ts (repeats count).  item, n, t, w, left: a token's weight in the item, and the weight of it and all tokens that are
    no rarer.  Any order would give right results; the rarest first gives the fewest rows."""
    t = items.select("item", F.explode("ts").alias("t")).groupBy("item", "t").agg(F.count("*").alias("w"))
    t = t.join(df, "t", "left").withColumn("df", F.coalesce("df", F.lit(0)))
    back = Window.partitionBy("item").orderBy(F.col("df").desc(), F.col("t").desc()).rowsBetween(Window.unboundedPreceding, 0)
    return t.select("item", F.sum("w").over(Window.partitionBy("item")).alias("n"), "t", "w", F.sum("w").over(back).alias("left"))


def _need(score: Column, n: Column, size: Column, dice: bool) -> Column:
    """The least weight a pair must share to reach a score: a share of the item's n tokens, or of the mean of both sizes.  It is rounded
    up but for what may be a rounding error, so that no tie is missed."""
    return F.greatest(F.lit(1).cast("long"), F.ceil(score * _of(n, size, dice) - 1e-6))


def _of(n: Column, size: Column, dice: bool) -> Column:
    return (n + size) / F.lit(2.0) if dice else n.cast("double")


def candidates(docs: DataFrame, tokens: DataFrame, dice: bool = False, after: float | None = None, others: bool = False) -> DataFrame:
    """id, item of the pairs that may reach their row's floor.  docs: id, ts, size, floor; tokens: see ranked().  after: leave out what a join
    on that score has joined already; others: leave out pairs of a row with itself."""
    n, size = F.col("n"), F.col("size")
    at = F.col("left") >= _need(F.col("floor"), n, size, dice)
    if after is not None:
        at = at & (F.col("left") < _need(F.lit(after), n, size, dice))
    if others:
        at = at & (F.col("id") != F.col("item"))
    d = docs.select("id", "size", "floor", F.explode("ts").alias("t"))
    return d.join(small(tokens), (d["t"] == tokens["t"]) & at).select("id", "item").distinct()


def shared(pairs: DataFrame, docs: DataFrame, items: DataFrame) -> DataFrame:
    """id, item, hits, n, size: the weight of the item's tokens that the row has.  items: item, ts.  A row's pairs come to it as a list of items, so that
    its tokens are shuffled once and not for every pair, and those of the items not at all; a list of items too large to be broadcast
    is joined to the pairs first."""
    its = items.select("item", F.col("ts").alias("its"), (F.size(F.array_distinct("ts")) == F.size("ts")).alias("once"))
    # what both have is found once; of an item without repeats it is the weight
    kept = F.transform(F.array(F.array_intersect("ts", "its")), lambda both: F.when(F.col("once"), F.size(both)).otherwise(F.size(F.filter("its", lambda t: F.array_contains(both, t)))).cast("long"))[0]
    near = small(its)
    if near is not its:
        lists = pairs.groupBy("id").agg(F.collect_list("item").alias("of"))
        each = lists.join(docs.select("id", "ts", "size"), "id").select("id", "ts", "size", F.explode("of").alias("item")).join(near, "item")
    else:
        lists = pairs.join(its, "item").groupBy("id").agg(F.collect_list(F.struct("item", "its", "once")).alias("of"))
        each = lists.join(docs.select("id", "ts", "size"), "id").select("id", "ts", "size", F.explode("of").alias("o")).select("id", "ts", "size", "o.*")
    return each.select("id", "item", kept.alias("hits"), F.size("its").cast("long").alias("n"), F.col("size").cast("long").alias("size"))


def _numbered(items: DataFrame) -> tuple[DataFrame, DataFrame]:
    """t, k: a number for every token that items have; and the items with numbers for tokens, repeats included."""
    words = written(items.select(F.explode("ts").alias("t")).distinct().withColumn("k", F.monotonically_increasing_id()), "overlap-words")
    each = items.select("item", F.explode("ts").alias("t")).join(small(words), "t")
    return words, written(each.groupBy("item").agg(F.collect_list("k").alias("ts")), "overlap-items")


def scored(docs: DataFrame, items: DataFrame, first: float = FIRST, dice: bool = False, others: bool = False) -> DataFrame:
    """id, item, hits, n, size, score: all pairs that score `first` or more, and of every row its best pairs, ties included, with whatever else had to
    be looked at.

    docs: id, ts (distinct tokens); items: item, ts.  The score is hits / n, or with dice twice the hits by both sizes together.  Rows
    and items without tokens, null ones included, are in no pair.  others: a row is not paired with the item of its own id.
    """
    # of a row only tokens that some item has can count; the others go before anything is joined, and numbers stand for those that stay
    words, items = _numbered(items)
    each = docs.filter(F.size("ts") > 0).select("id", F.size("ts").alias("size"), F.explode("ts").alias("t")).join(small(words), "t")
    d = written(each.groupBy("id", "size").agg(F.collect_list("k").alias("ts")), "overlap-rows")
    tokens = written(ranked(items, frequencies(d)), "overlap-tokens")
    score = F.col("hits") / _of(F.col("n"), F.col("size"), dice)
    sure = written(shared(candidates(d.withColumn("floor", F.lit(first)), tokens, dice, others=others), d, items).withColumn("score", score), "overlap-first")
    floor = sure.groupBy("id").agg(F.max("score").alias("floor"))
    rest = d.join(floor, "id", "left").withColumn("floor", F.least(F.coalesce("floor", F.lit(0.0)), F.lit(first)))
    more = candidates(rest, tokens, dice, first, others).join(sure.select("id", "item"), ["id", "item"], "left_anti")
    return sure.unionByName(shared(more, d, items).withColumn("score", score))
