"""Flags from lists of doubtful journals and publishers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..checkpoints import written
from ..functions import identifiers as I
from ..functions import text as X
from .joins import containing

FUZZY = 0.92
STRENGTH = {"issn": 104, "name": 103, "publisher": 2, "fuzzy-name": 1}
#: A list of up to so many rows is broadcast (about 20 MB of names).
BROADCAST_ROWS = 200_000


def small(d: DataFrame) -> DataFrame:
    """Broadcast a list if it is as small as lists are; a larger one is joined by shuffling."""
    return F.broadcast(d) if d.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS else d


def names(journals: DataFrame) -> DataFrame:
    """ord, name, reason, n: every normalised name and alias of a list."""
    every = F.array_compact(F.concat(F.array("name"), F.coalesce("aliases", F.array().cast("array<string>"))))
    return journals.select("ord", "name", "reason", F.explode(F.transform(every, X.normalize_phrase)).alias("n")).filter("n != ''")


def validate_list(journals: DataFrame, least: int = 100) -> DataFrame:
    """One row: ok, journals, bad_issn.  A list is replaced only by one that passes."""
    bad = F.exists("issn", lambda x: (F.char_length(x) > 32) | (F.char_length(F.regexp_replace(x, r"[\s-]", "")) != 8))
    return journals.agg(F.count("*").alias("journals"), F.count_if(F.coalesce(bad, F.lit(False))).alias("bad_issn")).withColumn("ok", (F.col("journals") >= least) & (F.col("bad_issn") == 0))


def flags(items: DataFrame, journals: DataFrame, publishers: DataFrame, fuzzy: float = FUZZY) -> DataFrame:
    """items: id, container_title, publisher, ISSN.  citation_id, tier, matched_on, matched_value, name, reason: the strongest
    flag of each item; equally strong ones: the earlier in the list.

    ISSN (the last record of an ISSN counts), exact name and publisher are equi-joins with the normalised lists.  Fuzzy names join by
    band of length, and the distance is cut off where the ratio can't be reached.
    """
    c = F.col
    it = items.select(c("id").alias("citation_id"), F.trim("container_title").alias("container"), F.trim("publisher").alias("publisher"), "ISSN").withColumn("n", X.normalize_phrase(c("container"))).withColumn("p", X.normalize_phrase(c("publisher")))
    by_issn = journals.select("ord", "name", "reason", F.explode("issn").alias("i")).select("ord", "name", "reason", F.regexp_replace(F.upper("i"), r"[\s-]", "").alias("i")).groupBy("i").agg(F.max_by(F.struct("ord", "name", "reason"), "ord").alias("r")).select("i", "r.*")
    listed = names(journals)
    exact = listed.groupBy("n").agg(F.min_by(F.struct("ord", "name", "reason"), "ord").alias("r")).select("n", "r.*")
    pubs = names(publishers).groupBy("n").agg(F.min_by(F.struct("ord", "name", "reason"), "ord").alias("r")).select(c("n").alias("p"), "r.*")

    def found(d: DataFrame, kind: str, value: Column) -> DataFrame:
        tier = "predatory" if STRENGTH[kind] > 100 else "suspicious"
        return d.select("citation_id", F.lit(tier).alias("tier"), F.lit(kind).alias("matched_on"), value.alias("matched_value"), "name", "reason", F.lit(STRENGTH[kind]).alias("strength"), (c("score") if "score" in d.columns else F.lit(1.0)).alias("score"), "ord")

    issn = found(it.withColumn("i", F.explode(I.issn(c("ISSN")))).join(small(by_issn), "i"), "issn", c("ISSN"))
    name = found(it.filter("n != ''").join(small(exact), "n"), "name", c("container"))
    pub = found(it.filter("p != ''").join(small(pubs), "p"), "publisher", c("publisher"))
    step = F.lit(1 / fuzzy)
    at = lambda x: F.floor(F.ln(F.greatest(F.char_length(x), F.lit(1)).cast("double")) / F.ln(step)).cast("int")
    left = it.filter("n != ''").withColumn("band", F.explode(F.sequence(at(c("n")) - 1, at(c("n")) + 1)))
    right = listed.select(c("n").alias("m"), "ord", "name", "reason", at(c("n")).alias("band"))
    longer = F.greatest(F.char_length("n"), F.char_length("m"))
    most = F.floor(longer * (1 - fuzzy) + 1e-9)
    near = left.join(small(right), ["band"]).filter((c("n") != c("m")) & (F.abs(F.char_length("n") - F.char_length("m")) <= most)).withColumn("score", X.levenshtein_ratio(c("n"), c("m"))).filter(c("score") >= fuzzy)
    every = issn.union(name).union(pub).union(found(near, "fuzzy-name", c("container")))
    rank = F.row_number().over(Window.partitionBy("citation_id").orderBy(c("strength").desc(), c("score").desc(), "ord"))
    return every.withColumn("_n", rank).filter("_n = 1").drop("_n", "strength", "score", "ord")


def abbreviation(items: DataFrame, journals: DataFrame) -> DataFrame:
    """items: id, container_title, ISSN; journals: ord, name, abbr, issn.  id, abbr: by ISSN, else by name or abbreviation, else by the longest listed
    name of which one contains the other, found by their rarest parts."""
    c = F.col
    it = items.select("id", X.normalize(c("container_title")).alias("n"), F.get(I.issn(c("ISSN")), 0).alias("i"))
    j = journals.select("ord", "abbr", X.normalize(c("name")).alias("jn"), X.normalize(c("abbr")).alias("ja"), F.transform("issn", lambda x: F.regexp_replace(F.upper(x), "[^0-9X]", "")).alias("issns"))
    one = lambda d, k: d.groupBy(k).agg(F.min_by("abbr", "ord").alias("abbr"))
    a = it.join(small(one(j.withColumn("i", F.explode("issns")), "i").withColumnRenamed("abbr", "a1")), "i", "left")
    a = a.join(small(one(j.select("ord", "abbr", F.explode(F.array("jn", "ja")).alias("n")), "n").withColumnRenamed("abbr", "a2")), "n", "left")
    rest = written(a.filter("a1 IS NULL AND a2 IS NULL AND n != ''").select("id", "n"), "unlisted")
    listed = written(j.select("ord", "abbr", "jn").filter("jn != ''"), "listed")
    item, name = rest.select(c("id").alias("a"), c("n").alias("x")), listed.select(c("ord").alias("b"), c("jn").alias("y"))
    inside = containing(item, name).select(c("a").alias("id"), c("b").alias("ord"))
    around = containing(name.select(c("b").alias("a"), c("y").alias("x")), item.select(c("a").alias("b"), c("x").alias("y"))).select(c("b").alias("id"), c("a").alias("ord"))
    best = inside.union(around).join(small(listed), "ord").groupBy("id").agg(F.min_by("abbr", F.struct(-F.char_length("jn"), "ord")).alias("a3"))
    return a.join(best, "id", "left").select("id", F.coalesce("a1", "a2", "a3").alias("abbr"))


#: Rows of a search's report.
JOURNALS_SHOWN, STYLES_SHOWN = 20, 25


def search_journals(journals: DataFrame, query: str) -> DataFrame:
    """The first journals whose name or abbreviation holds the query, case aside; a query of under two characters finds none."""
    q = query.lower().strip()
    hit = F.lower("name").contains(q) | F.coalesce(F.lower("abbr").contains(q), F.lit(False))
    return journals.filter(hit if len(q) >= 2 else F.lit(False)).orderBy("ord").limit(JOURNALS_SHOWN)


def search_styles(style_list: DataFrame, query: str) -> DataFrame:
    """The first styles whose id or name holds the query; a blank one finds all."""
    q = query.lower().strip()
    return style_list.filter(F.lower("id").contains(q) | F.lower("name").contains(q) if q else F.lit(True)).orderBy("ord").limit(STYLES_SHOWN)


def style_for_journal(journals: DataFrame, name: str) -> DataFrame:
    """style_id (one row or none) of the journal of that name, else of the first whose name or abbreviation holds it."""
    q = name.lower().strip()
    exact = F.lower("name") == q
    found = journals.filter(exact | F.lower("name").contains(q) | F.coalesce(F.lower("abbr").contains(q), F.lit(False)))
    return found.groupBy().agg(F.min_by("style_id", F.struct(~exact, F.col("ord"))).alias("style_id")).filter("style_id IS NOT NULL")
