"""Similarity, greedy duplicate groups and merging of items."""

from __future__ import annotations

from functools import partial, reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..checkpoints import ensure_checkpoint_dir, written
from ..functions import text as X
from ..schema import is_blank, year_of
from . import edits
from .display import placed

THRESHOLD = 0.8
#: Rows that are alike of which one row holds the numbers.
SLICE = 256


def features(items: DataFrame, compat: bool = False) -> DataFrame:
    """ord, id, doi, title, authors, year: what is compared; null where it isn't."""
    name = lambda a: F.coalesce(a["literal"], F.trim(F.concat_ws(" ", a["family"], a["given"])))
    authors = X.normalize(F.array_join(F.transform("author", name), " "))
    keep = (lambda c: c) if compat else (lambda c: F.when(c != "", c))
    return items.select(
        "ord",
        "id",
        F.when(~is_blank(F.col("DOI")), F.lower("DOI")).alias("doi"),
        F.when(~is_blank(F.col("title")), keep(X.normalize(F.col("title")))).alias("title"),
        F.when(F.size("author") > 0, keep(authors)).alias("authors"),
        year_of(F.col("issued")).alias("year"),
    )


def similarity(a: str, b: str, compat: bool = False) -> Column:
    """Weighted mean over what both have: DOI 5, title 3, authors 2, year 1.  Rows that share a year only don't compare, unless compat."""
    x, y = (lambda c: F.col(f"{a}.{c}")), (lambda c: F.col(f"{b}.{c}"))
    parts = [("doi", 5, (x("doi") == y("doi")).cast("double")), ("title", 3, X.levenshtein_ratio(x("title"), y("title"))), ("authors", 2, X.levenshtein_ratio(x("authors"), y("authors"))), ("year", 1, (x("year") == y("year")).cast("double"))]
    both = {n: x(n).isNotNull() & y(n).isNotNull() for n, _, _ in parts}
    total = sum(F.when(both[n], F.lit(w) * s).otherwise(0.0) for n, w, s in parts)
    weight = sum(F.when(both[n], F.lit(w)).otherwise(0) for n, w, _ in parts)
    some = weight > 0 if compat else both["doi"] | both["title"] | both["authors"]
    return F.when(some, total / weight).otherwise(0.0)


def _partitions(d: DataFrame) -> int:
    """For few rows with much work behind each, which are dealt by number and not by their size."""
    return int(d.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def _shuffled(d: DataFrame) -> DataFrame:
    """d as a side that is not sent through the driver: what Parquet files weigh tells nothing of the rows made of them."""
    return d.hint("merge")


def similar_texts(rows: DataFrame, text: str, ratio: float, within: str | None = None, among: Column | None = None) -> DataFrame:
    """lo, hi: by ord, the pairs of rows (ord, text) with 1 - distance / longer length of at least ratio, and of one value of `within`.  No
    pair is missed, but for pairs of different texts that have no row of `among`, where that is given.

    Equal texts are one row until the end.  Different ones are dealt into blocks by length, and every two blocks whose lengths allow it are
    held against each other in a task (see edits): time grows with the square of the texts, rows shuffled with texts times blocks, and
    only pairs that are close leave a task.  Nothing is broadcast.
    """
    d = rows.filter(F.col(text).isNotNull()).select("ord", F.col(text).alias("t"), (F.col(within) if within else F.lit(0)).alias("w"), (F.lit(True) if among is None else among).alias("open")).filter("w IS NOT NULL")
    each = d.groupBy("t", "w").agg(F.min("ord").cast("long").alias("id"), F.bool_or("open").alias("open"))
    each = written(each.select("id", "t", "w", "open", F.char_length("t").alias("n"), F.pmod(F.xxhash64("id"), F.lit(1 << 31)).alias("h")), "texts")
    blocks, table = edits.dealt([tuple(r) for r in each.groupBy("w", "open", "n").count().collect()], ratio)
    met = each.mapInArrow(partial(edits.placed, table=table), "id long, t string, block long, others array<long>").select("id", "t", "block", F.explode("others").alias("other"))
    met = met.select((F.least("block", "other") * blocks + F.greatest("block", "other")).alias("p"), (F.col("block") > F.col("other")).alias("second"), "id", "t")
    near = written(met.repartition(_partitions(rows), "p").groupBy("p").applyInArrow(lambda x: edits.pairs(x, ratio), "a long, b long, sure boolean"), "close")
    side = lambda id, n: _shuffled(each.select(F.col("id").alias(id), F.col("t").alias(n)))
    rest = near.filter("NOT sure").join(side("a", "x"), "a").join(side("b", "y"), "b")
    most = F.floor((1 - ratio) * F.greatest(F.char_length("x"), F.char_length("y")) + 1e-6)
    alike = near.filter("sure").select("a", "b").union(rest.filter(F.levenshtein("x", "y") <= most).select("a", "b"))
    alike = alike.union(each.select(F.col("id").alias("a"), F.col("id").alias("b")))
    ids = d.join(_shuffled(each.select("id", "t", "w")), ["t", "w"]).select("ord", "id")
    both = alike.join(_shuffled(ids.select(F.col("id").alias("a"), F.col("ord").alias("p"))), "a").join(_shuffled(ids.select(F.col("id").alias("b"), F.col("ord").alias("q"))), "b").filter("p != q")
    return both.select(F.least("p", "q").alias("lo"), F.greatest("p", "q").alias("hi")).distinct()


def edges(items: DataFrame, threshold: float = THRESHOLD, compat: bool = False) -> DataFrame:
    """lo, hi, score of the pairs that reach the threshold (over 6/11), by ord.

    No pair is missed, since one of these must hold: the DOIs are equal; or the titles' ratio t is at least the threshold; or the years are equal and t is what
    the year's weight leaves to be reached; or the authors' ratio is, alone or with equal years.  Rows whose DOIs differ can't reach
    it, nor can rows whose years differ by a title or authors alone if the year's weight is too much for them; where years are equal,
    the second case has the first.  Each case is a join of similar texts (see similar_texts()), and only pairs that one of them finds are scored.

    Rows that are alike in all that is compared are one row with a number of its own until all is scored, so that copies are paired in the
    result only, and rows of one ord, which make no pair, are told apart.
    """
    what = ["doi", "title", "authors", "year"]
    some = features(items, compat).filter("doi IS NOT NULL OR title IS NOT NULL OR authors IS NOT NULL")
    f = written(some.groupBy(*what).agg(F.collect_list("ord").alias("rows")).withColumn("ord", F.monotonically_increasing_id()), "features")
    year = lambda r: max(0.1, (r * threshold - 1) / (r - 1))  # noqa: E731  what is left to reach where the year counts 1 of r
    alone = lambda other, r: F.lit((r - 1) / r >= threshold) | F.col("year").isNull() | F.col(other).isNotNull()  # noqa: E731  what another year doesn't rule out
    dated = f.filter("year IS NOT NULL")
    doi = f.filter("doi IS NOT NULL").select("ord", "doi")
    found = [doi.alias("a").join(_shuffled(doi).alias("b"), (F.col("a.doi") == F.col("b.doi")) & (F.col("a.ord") < F.col("b.ord"))).select(F.col("a.ord").alias("lo"), F.col("b.ord").alias("hi"))]
    found.append(f.filter(F.size("rows") > 1).select(F.col("ord").alias("lo"), F.col("ord").alias("hi")))
    if not f.filter("title IS NOT NULL").isEmpty():
        found.append(similar_texts(f, "title", threshold, among=alone("authors", 4)))
        if not dated.isEmpty():
            found.append(similar_texts(dated, "title", year(4), "year"))
    if not f.filter("authors IS NOT NULL").isEmpty():
        found.append(similar_texts(f, "authors", threshold, among=alone("title", 3)))
        if not dated.isEmpty():
            found.append(similar_texts(dated, "authors", year(3), "year"))
    pairs = reduce(DataFrame.union, found).distinct()
    side = lambda n: _shuffled(f.select(F.col("ord").alias(f"{n}_ord"), F.struct("ord", *what, F.size("rows").alias("rows")).alias(n)))
    both = pairs.join(side("a"), F.col("lo") == F.col("a_ord")).join(side("b"), F.col("hi") == F.col("b_ord"))
    apart = F.coalesce(F.col("a.doi") != F.col("b.doi"), F.lit(False))
    fine = both.filter(~apart).select("lo", "hi", F.col("a.rows").alias("m"), F.col("b.rows").alias("n"), similarity("a", "b", compat).alias("score")).filter(F.col("score") >= threshold)
    return _paired(fine, f.select("ord", "rows"))


def _paired(fine: DataFrame, f: DataFrame) -> DataFrame:
    """lo, hi, score of the rows behind pairs (lo, hi, score) of ord, m and n being the numbers of their rows.

    A slice of the rows of one meets a slice of the other's, so that a text with many copies is not one task's.  The side with more rows
    comes last, as what comes first is sent on for every slice of it.
    """
    less = F.col("m") < F.col("n")
    last = lambda n: F.floor((n - 1) / SLICE)
    x = fine.select("score", F.when(less, F.col("lo")).otherwise(F.col("hi")).alias("x"), F.when(less, F.col("hi")).otherwise(F.col("lo")).alias("y"), last(F.least("m", "n")).alias("m"), last(F.greatest("m", "n")).alias("n"))
    x = x.select("score", "x", "y", "n", F.explode(F.sequence(F.lit(0).cast("long"), "m")).alias("i"))
    x = x.select("score", "x", "y", "i", F.explode(F.sequence(F.when(F.col("x") == F.col("y"), F.col("i")).otherwise(0), "n")).alias("j"))
    cut = F.transform(F.sequence(F.lit(0).cast("long"), last(F.size("rows"))), lambda i: F.slice("rows", (i * SLICE + 1).cast("int"), F.lit(SLICE)))
    each = lambda k, i, n: f.select(F.col("ord").alias(k), F.posexplode(cut).alias(i, n)).withColumn(i, F.col(i).cast("long"))
    x = x.join(_shuffled(each("x", "i", "ps")), ["x", "i"]).repartition(_partitions(f), "y", "j")
    x = x.join(_shuffled(each("y", "j", "qs").repartition(_partitions(f), "y", "j")), ["y", "j"])
    one = (F.col("x") == F.col("y")) & (F.col("i") == F.col("j"))
    x = x.select("score", one.alias("one"), "ps", F.explode("qs").alias("q")).select("score", "one", F.explode("ps").alias("p"), "q").filter("p < q OR p > q AND NOT one")
    return x.select(F.least("p", "q").alias("lo"), F.greatest("p", "q").alias("hi"), "score")


def greedy_groups(items: DataFrame, pairs: DataFrame) -> DataFrame:
    """ord, seed: the first row is a seed and takes all later rows similar to it, then the next row that is left, and so on.

    A row is taken once a lower neighbour is a seed and is a seed once all its lower neighbours are taken; rounds go on until
    all are decided, then every taken row goes to its smallest seed.  Only rows with a similar row take part in rounds.
    """
    ensure_checkpoint_dir(items.sparkSession)
    pairs = pairs.select("lo", "hi").checkpoint()
    state = pairs.select(F.col("lo").alias("ord")).union(pairs.select("hi")).distinct().withColumn("s", F.lit(None).cast("string")).checkpoint()
    while True:
        lower = pairs.join(state.select(F.col("ord").alias("lo"), F.col("s").alias("ls")), "lo").groupBy("hi").agg(F.bool_or(F.coalesce(F.col("ls") == "seed", F.lit(False))).alias("taken"), F.bool_and(F.coalesce(F.col("ls") == "taken", F.lit(False))).alias("free"))
        new = state.join(lower, state["ord"] == lower["hi"], "left")
        state = new.select("ord", F.coalesce("s", F.when(F.coalesce("taken", F.lit(False)), "taken").when(F.coalesce("free", F.lit(True)), "seed")).alias("s")).checkpoint()
        if state.filter("s IS NULL").isEmpty():
            break
    seeds = state.filter("s = 'seed'").select(F.col("ord").alias("lo"))
    owner = pairs.join(seeds, "lo").groupBy("hi").agg(F.min("lo").alias("seed"))
    taken = state.filter("s = 'taken'").join(owner, F.col("ord") == F.col("hi")).select("ord", "seed")
    return taken.union(taken.select(F.col("seed").alias("ord"), "seed").distinct())


def describe_groups(groups: DataFrame, pairs: DataFrame) -> DataFrame:
    """seed, members (in order), similarity of the first two, auto_mergeable (two members)."""
    g = groups.groupBy("seed").agg(F.array_sort(F.collect_list("ord")).alias("members"))
    p = pairs.withColumnRenamed("score", "similarity")
    return g.join(p, (g["seed"] == p["lo"]) & (F.get("members", 1) == p["hi"]), "left").select("seed", "members", "similarity", (F.size("members") == 2).alias("auto_mergeable"))


def merge(rows: DataFrame, group: str, order: str, fields: list[str]) -> DataFrame:
    """One row per group: the first non-null value of each field in order."""
    first = lambda c: F.min(F.when(F.col(c).isNotNull(), F.struct(F.col(order).alias("o"), F.col(c).alias("v"))))["v"]
    return rows.groupBy(group).agg(F.min(order).alias(order), *[first(c).alias(c) for c in fields])


def keep_one(rows: DataFrame, keeper: Column, group: str, order: str, fields: list[str]) -> DataFrame:
    """Each group becomes its keeper's row with blanks filled from the others in order; the keeper keeps its place."""
    w = Window.partitionBy(group).orderBy((~keeper).cast("int"), order).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    return rows.withColumns({c: F.first(F.when(~is_blank(F.col(c)), F.col(c)), ignorenulls=True).over(w) for c in fields}).filter(keeper)


def keep_first(rows: DataFrame, keys: list, order: list) -> DataFrame:
    """The first row of each key in order."""
    return rows.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).filter("_n = 1").drop("_n")


def markers(groups: DataFrame, colours: int = 8) -> DataFrame:
    """ord, seed, colour, siblings for every member of a group; groups are coloured in turn, in the order of their seeds."""
    seeds = placed(groups.select("seed").distinct(), ["seed"], "_place").select("seed", F.pmod(F.col("_place") - 1, F.lit(colours)).cast("int").alias("colour"))
    w = Window.partitionBy("seed")
    siblings = F.array_sort(F.array_except(F.collect_list("ord").over(w), F.array("ord")))
    return groups.select("ord", "seed", siblings.alias("siblings")).join(seeds, "seed").select("ord", "seed", "colour", "siblings")
