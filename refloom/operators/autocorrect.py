"""Offline corrections of items and the log of what changed."""

from __future__ import annotations

from datetime import date

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as X
from ..schema import is_blank
from .rules import PAGES

#: Corrected fields in the order of their log rows.
LOGGED = ("DOI", "page", "URL", "genre", "accessed", "publisher", "title", "container_title_short")


def correct(items: DataFrame, style: str | None, as_of: date, abbreviations: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """Corrected items, and citation_id, field, old_value, new_value, rule for each change.

    abbreviations: name, abbr of journals, for IEEE; matched by normalised name in a join that Spark broadcasts if it is small.
    """
    c, kind = F.col, F.col("type")
    day = as_of
    out = items.select("*", *[F.col(f).alias(f"_old_{f}") for f in LOGGED])
    out = out.withColumn("DOI", F.regexp_replace(F.regexp_replace(c("DOI"), r"(?i)^https?://doi\.org/", ""), r"[\s.]+$", ""))
    out = out.withColumn("page", X.page_range(c("page")))
    out = out.withColumn("URL", F.when(~is_blank(c("URL")) & ~c("URL").rlike(r"(?i)^https?://"), F.concat(F.lit("https://"), c("URL"))).otherwise(c("URL")))
    trimmed = lambda a: a.withField("family", F.trim(a["family"])).withField("given", F.trim(a["given"])).withField("literal", F.trim(a["literal"]))
    out = out.withColumn("author", F.transform("author", trimmed))
    source = F.lower(F.coalesce("original", "title", F.lit("")))
    thesis = F.when(source.rlike(r"\b(?:ph\.?\s*d|doctoral)\b"), "Doctoral dissertation").when(source.rlike(r"\b(?:master|m\.?\s*(?:sc|a)\.?)\b"), "Master's thesis")
    made = F.when(kind == "thesis", thesis).when(kind == "dataset", "Data set").when(kind == "software", "Computer software").when(kind == "manuscript", "Unpublished manuscript")
    out = out.withColumn("genre", F.when(is_blank(c("genre")), F.coalesce(made, c("genre"))).otherwise(c("genre")))
    dated = kind.isin("report", "thesis", "dataset", "software", "standard", *PAGES) & c("accessed").isNull() & ~is_blank(c("URL"))
    today = F.struct(F.array(F.array(*[F.lit(x) for x in (day.year, day.month, day.day)])).alias("date_parts"), *[F.lit(None).cast(t).alias(n) for n, t in (("season", "string"), ("circa", "boolean"), ("literal", "string"), ("raw", "string"))])
    out = out.withColumn("accessed", F.when(dated, today).otherwise(c("accessed")))
    body = F.get(F.filter("author", lambda a: ~is_blank(a["literal"])), 0)["literal"]
    out = out.withColumn("publisher", F.when((kind == "report") & is_blank(c("publisher")), F.coalesce(body, c("publisher"))).otherwise(c("publisher")))
    if style in ("apa-7th", "apa-6th"):
        cased = kind.isin("article-journal", "report", "thesis", "dataset", "software")
        out = out.withColumn("title", F.when(cased, X.sentence_case(c("title"))).otherwise(c("title")))
    if style == "ieee" and abbreviations is not None:
        known = abbreviations.select(X.normalize(c("name")).alias("_name"), c("abbr").alias("_abbr")).groupBy("_name").agg(F.min("_abbr").alias("_abbr"))
        out = out.join(known, X.normalize(c("container_title")) == c("_name"), "left")
        out = out.withColumn("container_title_short", F.when(is_blank(c("container_title_short")), c("_abbr")).otherwise(c("container_title_short"))).drop("_name", "_abbr")
    log = out.select(c("id").alias("citation_id"), F.explode(F.array_compact(F.array(*[_change(f) for f in LOGGED]))).alias("x")).select("citation_id", "x.*")
    return out.drop(*[f"_old_{f}" for f in LOGGED]), log


def _change(field: str) -> Column:
    old, new, kind = F.col(f"_old_{field}"), F.col(field), F.col("type")
    rule = {
        "DOI": F.lit("normalize-doi"),
        "page": F.lit("normalize-page-range"),
        "URL": F.lit("fix-url-protocol"),
        "genre": F.when(kind == "thesis", "infer-thesis-type").otherwise(F.concat(F.lit("set-"), kind, F.lit("-genre"))),
        "accessed": F.lit("set-access-date"),
        "publisher": F.lit("infer-publisher-from-org-author"),
        "title": F.when(kind == "article-journal", "apa-sentence-case").otherwise("apa-sentence-case-gray-lit"),
        "container_title_short": F.lit("ieee-journal-abbreviation"),
    }[field]
    value = (lambda c: F.to_json(c)) if field == "accessed" else (lambda c: c)
    return F.when(~old.eqNullSafe(new), F.struct(F.lit(field).alias("field"), value(old).alias("old_value"), value(new).alias("new_value"), rule.alias("rule")))


def needs_enhancement(kind: Column) -> Column:
    """Whether an online look-up could fill something in."""
    c = F.col
    journal = is_blank(c("DOI")) | is_blank(c("volume")) | is_blank(c("page")) | is_blank(c("container_title"))
    book = is_blank(c("publisher")) | c("issued").isNull()
    page = is_blank(c("title")) | is_blank(c("container_title")) | c("issued").isNull() | (F.coalesce(F.size("author"), F.lit(0)) <= 0)
    return F.when(kind == "article-journal", journal).when(kind.isin("book", "chapter"), book).when(kind.isin(*PAGES), page & ~is_blank(c("URL"))).otherwise(is_blank(c("DOI")) & is_blank(c("URL")))


def fill_missing(items: DataFrame, candidates: list[tuple[str, DataFrame]], fields: list[str]) -> tuple[DataFrame, DataFrame]:
    """Fills blank fields from candidate tables (id and fields, one row per id) in order of preference; the log names the rule of
    the table that a value came from.  One left join per table."""
    out = items
    for rule, d in candidates:
        out = out.join(d.select(F.col("id"), *[F.col(f).alias(f"_{rule}_{f}") for f in fields]), "id", "left")
    found = {f: F.coalesce(*[F.when(~is_blank(F.col(f"_{r}_{f}")), F.struct(F.col(f"_{r}_{f}").alias("v"), F.lit(r).alias("rule"))) for r, _ in candidates]) for f in fields}
    out = out.withColumns({f"_fill_{f}": F.when(is_blank(F.col(f)), x) for f, x in found.items()})
    log = out.select(F.col("id").alias("citation_id"), F.explode(F.array_compact(F.array(*[F.when(F.col(f"_fill_{f}").isNotNull(), F.struct(F.lit(f).alias("field"), F.col(f).alias("old_value"), F.col(f"_fill_{f}.v").alias("new_value"), F.col(f"_fill_{f}.rule").alias("rule"))) for f in fields]))).alias("x")).select("citation_id", "x.*")
    return out.withColumns({f: F.coalesce(F.col(f"_fill_{f}.v"), F.col(f)) for f in fields}).select(*items.columns), log
