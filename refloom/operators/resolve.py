"""Ranking of registry candidates and entity resolution."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import identifiers as I
from ..functions import text as X
from ..schema import first_author, is_blank, year_of

TOP, LEAST = 12, 0.42


def _alike(a: Column, b: Column) -> Column:
    return X.dice(X.long_words(X.fold(a)), X.long_words(X.fold(b)))


def rank(pairs: DataFrame, q: str = "q", c: str = "c") -> DataFrame:
    """pairs: query_id, ord, exact, and item structs q and c.  Adds confidence, matched_fields, mismatch_reasons."""
    f = lambda s, n: F.col(f"{s}.{n}")
    have = lambda n: ~is_blank(f(q, n)) & ~is_blank(f(c, n))
    title = F.coalesce(_alike(f(q, "title"), f(c, "title")), F.lit(0.0))
    dois = have("DOI") & (I.clean_doi(f(q, "DOI")) != "") & (I.clean_doi(f(c, "DOI")) != "")
    same_doi = I.clean_doi(f(q, "DOI")) == I.clean_doi(f(c, "DOI"))
    digits = lambda x: F.regexp_replace(x, r"\D", "")
    same_pmid = digits(f(q, "PMID")) == digits(f(c, "PMID"))
    yq, yc = year_of(f(q, "issued")), year_of(f(c, "issued"))
    years = F.coalesce((yq != 0) & (yc != 0), F.lit(False))
    aq, ac = first_author(f(q, "author")), first_author(f(c, "author"))
    author = F.coalesce(_alike(aq, ac), F.lit(0.0))
    same_type = F.coalesce(f(q, "type") == f(c, "type"), F.lit(False))
    p = pairs.withColumns({"_t": title, "_a": author})
    t, a = F.col("_t"), F.col("_a")
    score = F.when(F.col("exact"), 0.82).otherwise(0.62 * t)
    score = score + F.when(dois & same_doi, 0.2).otherwise(0.0) + F.when(have("PMID") & same_pmid, 0.2).otherwise(0.0)
    score = score + F.when(years, F.when(yq == yc, 0.1).when(F.abs(yq - yc) > 1, -0.08).otherwise(-0.03)).otherwise(0.0)
    score = score + F.when(a >= 0.8, 0.08).otherwise(0.0) + F.when(same_type, 0.04).otherwise(0.0)
    other_kind = ~same_type & (f(q, "type") == "legislation") & f(c, "type").isin("article", "article-journal")
    score = F.when(F.coalesce(other_kind, F.lit(False)), F.least(score, F.lit(0.35))).otherwise(score)
    checks = [("title", t >= 0.75, have("title")), ("DOI", dois & same_doi, dois), ("PMID", have("PMID") & same_pmid, have("PMID")), ("year", years & (yq == yc), years), ("author", a >= 0.8, ~is_blank(aq) & ~is_blank(ac)), ("type", same_type, have("type"))]
    listed = lambda which: F.array_compact(F.array(*[F.when(F.coalesce(which(ok, can), F.lit(False)), n) for n, ok, can in checks]))
    return p.withColumns({"confidence": F.round(F.greatest(F.lit(0.0), F.least(F.lit(1.0), score)), 3), "matched_fields": listed(lambda ok, can: ok), "mismatch_reasons": listed(lambda ok, can: can & ~F.coalesce(ok, F.lit(False)))}).drop("_t", "_a")


def candidates(pairs: DataFrame, top: int = TOP, least: float = LEAST) -> DataFrame:
    """Ranked candidates of each query: first of each DOI, PMID, URL or title and year (none of these: dropped), those of at least
    `least`, best first, `top` at most."""
    r = rank(pairs)
    year = F.coalesce(year_of(F.col("c.issued")).cast("string"), F.lit(""))
    named = F.when(~is_blank(F.col("c.title")), F.concat(F.lower("c.title"), F.lit(":"), year))
    key = F.coalesce(F.when(~is_blank(F.col("c.DOI")), F.lower("c.DOI")), F.when(~is_blank(F.col("c.PMID")), F.col("c.PMID")), F.when(~is_blank(F.col("c.URL")), F.col("c.URL")), named)
    r = r.withColumn("_k", key).filter("_k IS NOT NULL").withColumn("_d", F.row_number().over(Window.partitionBy("query_id", "_k").orderBy("ord"))).filter(f"_d = 1 AND confidence >= {least}")
    return r.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.col("confidence").desc(), "ord"))).filter(F.col("rank") <= top).drop("_k", "_d")


def best_match(pairs: DataFrame) -> DataFrame:
    """The candidate of highest title ratio among those that reach their own threshold: 0.6 if a family name fits or the year is
    within 1, else 0.85.  A better one that misses its threshold doesn't stand in the way."""
    ratio = X.levenshtein_ratio(X.normalize(F.col("q.title")), X.normalize(F.col("c.title")))
    fq, fc = F.lower(first_author(F.col("q.author"))), F.lower(first_author(F.col("c.author")))
    close = F.coalesce(fq.contains(fc) | fc.contains(fq), F.lit(False)) | F.coalesce(F.abs(year_of(F.col("q.issued")) - year_of(F.col("c.issued"))) <= 1, F.lit(False))
    r = pairs.withColumn("score", ratio).filter(F.col("score") >= F.when(close, 0.6).otherwise(0.85))
    return r.withColumn("_n", F.row_number().over(Window.partitionBy("query_id").orderBy(F.col("score").desc(), "ord"))).filter("_n = 1").drop("_n")


def top_then_gate(pairs: DataFrame, ratio: float = 0.92, sure: float = 0.97) -> DataFrame:
    """The first candidate by title ratio, and only if it passes: ratio, year within 1, author unless the title is sure."""
    r = pairs.withColumn("score", X.levenshtein_ratio(X.normalize(F.col("q.title")), X.normalize(F.col("c.title"))))
    r = r.withColumn("_n", F.row_number().over(Window.partitionBy("query_id").orderBy(F.col("score").desc(), "ord"))).filter("_n = 1").drop("_n")
    yq, yc = year_of(F.col("q.issued")), year_of(F.col("c.issued"))
    author = X.fold(first_author(F.col("q.author"))) == X.fold(first_author(F.col("c.author")))
    return r.filter((F.col("score") >= ratio) & (yq.isNull() | yc.isNull() | (F.abs(yq - yc) <= 1)) & ((F.col("score") >= sure) | F.coalesce(author, F.lit(True))))


def cascade(items: DataFrame, stages: list[tuple[str, DataFrame, list[str]]]) -> DataFrame:
    """items joined by each stage's keys (one row per key in a stage's table, column match) in order; the first that matches counts.
    Rows of a stage are those that no stage before resolved."""
    left, done = items, None
    for name, d, keys in stages:
        hit = left.join(d.select(*keys, "match"), keys).select(*items.columns, F.lit(name).alias("stage"), "match")
        left = left.join(d.select(*keys), keys, "left_anti").select(*items.columns)
        done = hit if done is None else done.unionByName(hit)
    return done.unionByName(left.withColumn("stage", F.lit("unresolved")), allowMissingColumns=True)


# Titles that stand for none, and words that show that a title was read as an author.
PLACEHOLDERS = ["()", "(?)", "\u2014", "-"]
STUDY_WORDS = r"\b(study|injury|review|analysis|cohort|disease|factors|mechanisms|identification|prognostic)\b"
FAMILY_WORDS = r"\b(incidence|mechanisms|factors|injury)\b"


def implausible_title(title: Column) -> Column:
    """Missing, a placeholder, shorter than 8 characters, or initials only."""
    t = F.trim(F.coalesce(title, F.lit("")))
    return (t == "") | t.isin(PLACEHOLDERS) | (F.char_length(t) < 8) | t.rlike(r"(?i)^(?:[A-Z]\.?\s*){1,4},?\s*(?:et\s+al\.?)?$") | t.rlike(r"(?i)^[A-Z]\.,?\s*et\s+al\.?$")


def implausible_authors(author: Column, title: Column) -> Column:
    """A given name of more than 35 characters or with study words, or a family name with such words that the title has as well."""

    def odd(a: Column) -> Column:
        given, family = F.lower(F.coalesce(a["given"], F.lit(""))), F.lower(F.coalesce(a["family"], F.lit("")))
        return (F.char_length(given) > 35) | given.rlike(STUDY_WORDS) | ((family != "") & F.lower(F.coalesce(title, F.lit(""))).contains(family) & family.rlike(FAMILY_WORDS))

    return F.coalesce(F.exists(author, odd), F.lit(False))


def identity_compatible(q: str = "q", c: str = "c") -> Column:
    """Whether a registry record may fill an item: one has no title, the item's is implausible (or short and its authors are), or the titles'
    words have a Dice of at least 0.45."""
    a, b = F.col(f"{q}.title"), F.col(f"{c}.title")
    blank = lambda t: F.trim(F.coalesce(t, F.lit(""))) == ""
    few = F.size(F.split(F.trim(a), r"\s+")) <= 4
    alike = X.dice(X.long_words(X.normalize(a)), X.long_words(X.normalize(b))) >= 0.45
    return blank(a) | blank(b) | implausible_title(a) | (implausible_authors(F.col(f"{q}.author"), a) & few) | alike


def doi_by_title(pairs: DataFrame) -> DataFrame:
    """The first candidate with the highest Dice of title words, 0.8 at least, among those with DOI and title and a year within 1."""
    yq, yc = year_of(F.col("q.issued")), year_of(F.col("c.issued"))
    p = pairs.filter(~is_blank(F.col("c.DOI")) & ~is_blank(F.col("c.title")) & ~is_blank(F.col("q.title")))
    p = p.filter(~F.coalesce((yq != 0) & (yc != 0) & (F.abs(yq - yc) > 1), F.lit(False)))
    p = p.withColumn("score", X.dice(X.long_words(X.normalize(F.col("q.title"))), X.long_words(X.normalize(F.col("c.title"))))).filter("score >= 0.8")
    return p.withColumn("_n", F.row_number().over(Window.partitionBy("query_id").orderBy(F.col("score").desc(), "ord"))).filter("_n = 1").drop("_n")


def same_family(a: Column, b: Column) -> Column:
    """Whether two family names are one: as they are, without spaces and hyphens, or by their first words."""
    norm = lambda c: X.normalize(F.trim(F.regexp_replace(c, r"\s+[A-Z]{1,4}$", "")))
    bare = lambda c: F.regexp_replace(c, r"[\s-]+", "")
    x, y = norm(a), norm(b)
    return (x != "") & (y != "") & ((x == y) | (bare(x) == bare(y)) | (bare(F.split(x, r"\s+")[0]) == bare(F.split(y, r"\s+")[0])))


def raw_line_match(pairs: DataFrame, years: int = 1) -> DataFrame:
    """The candidate whose title's words the item's raw line holds most of, if it passes: 0.7 of them, or half and the author's family
    name; years within `years`; no other author."""
    raw = F.concat(F.lit(" "), X.normalize(F.col("q.original")), F.lit(" "))
    t = X.long_words(X.normalize(F.col("c.title")))
    share = F.when(F.size(t) > 0, F.size(F.filter(t, lambda w: raw.contains(F.concat(F.lit(" "), w, F.lit(" "))))) / F.size(t)).otherwise(0.0)
    fq, fc = F.get(F.col("q.author"), 0)["family"], F.get(F.col("c.author"), 0)["family"]
    yq, yc = year_of(F.col("q.issued")), year_of(F.col("c.issued"))
    p = pairs.filter(F.trim(F.coalesce(F.col("q.original"), F.lit(""))) != "").withColumn("score", F.coalesce(share, F.lit(0.0)))
    p = p.withColumn("_n", F.row_number().over(Window.partitionBy("query_id").orderBy(F.col("score").desc(), "ord"))).filter("_n = 1").drop("_n")
    named = F.coalesce((F.char_length(fc) >= 3) & X.normalize(F.col("q.original")).contains(X.normalize(fc)), F.lit(False))
    right_year = F.coalesce((yq == 0) | (yc == 0) | (F.abs(yq - yc) <= years), F.lit(True))
    right_author = is_blank(fq) | is_blank(fc) | F.coalesce(same_family(fq, fc), F.lit(False))
    return p.filter(((F.col("score") >= 0.7) | ((F.col("score") >= 0.5) & named)) & right_year & right_author)
