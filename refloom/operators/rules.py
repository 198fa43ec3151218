"""Validation rules as data, all evaluated in one pass without a join."""

from __future__ import annotations

from dataclasses import dataclass
from datetime import date

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..schema import is_blank, year_of

ANY: tuple[str, ...] = ()
APA = ("apa-7th", "apa-6th")
PAGES = ("webpage", "post", "post-weblog")
GREY = ("report", "thesis", "dataset", "software", "standard", "manuscript", "speech", "broadcast", "motion_picture", "map", "personal_communication")


@dataclass(frozen=True)
class Rule:
    """broken: when the rule is broken.  No styles or no types: it holds for all."""

    id: str
    types: tuple[str, ...]
    severity: str
    field: str
    broken: Column
    message: str
    styles: tuple[str, ...] = ANY
    fixable: bool = False


def _none(*names: str) -> Column:
    out = is_blank(F.col(names[0]))
    for n in names[1:]:
        out = out & is_blank(F.col(n))
    return out


def is_preprint() -> Column:
    where = F.concat_ws(" ", "container_title", "publisher", "URL")
    return F.coalesce(F.col("genre").rlike(r"(?i)\bpre-?print\b"), F.lit(False)) | where.rlike(r"(?i)arxiv|biorxiv|medrxiv|research\s+square")


def all_rules(as_of: date) -> list[Rule]:
    year = year_of(F.col("issued"))
    organisation = F.coalesce(F.exists("author", lambda a: ~is_blank(a["literal"])), F.lit(False))
    broken_if = lambda name, pattern: ~is_blank(F.col(name)) & ~F.col(name).rlike(pattern)
    need = lambda kind, *names: f"A {kind} should have {' or '.join(names)}"
    # Ids, types, severities and conditions of the rules.
    return [
        Rule("required-title", ANY, "error", "title", _none("title"), "Title is missing"),
        Rule("required-author", ANY, "warning", "author", F.coalesce(F.size("author"), F.lit(0)) <= 0, "Author is missing"),
        Rule("required-date", ("article-journal", "book", "chapter", "paper-conference", "report", "thesis"), "warning", "issued", F.col("issued").isNull(), "Date is missing"),
        Rule("journal-requires-container", ("article-journal",), "error", "container-title", _none("container_title"), need("journal article", "a journal")),
        Rule("book-requires-publisher", ("book", "chapter"), "warning", "publisher", _none("publisher"), need("book", "a publisher")),
        Rule("chapter-requires-container", ("chapter",), "warning", "container-title", _none("container_title"), need("chapter", "a book title")),
        Rule("report-requires-publisher", ("report",), "warning", "publisher", _none("publisher") & ~organisation, need("report", "a publisher", "an organisation as author")),
        Rule("report-url-recommended", ("report",), "info", "URL", _none("URL", "DOI"), need("report", "a URL", "a DOI"), fixable=True),
        Rule("thesis-requires-publisher", ("thesis",), "warning", "publisher", _none("publisher"), need("thesis", "a university")),
        Rule("thesis-requires-genre", ("thesis",), "info", "genre", _none("genre"), need("thesis", "its kind")),
        Rule("thesis-url-recommended", ("thesis",), "info", "URL", _none("URL", "DOI"), need("thesis", "a URL", "a DOI"), fixable=True),
        Rule("webpage-requires-url", PAGES, "error", "URL", _none("URL"), need("web page", "a URL")),
        Rule("webpage-requires-accessed", PAGES, "warning", "accessed", F.col("accessed").isNull(), need("web page", "an access date")),
        Rule("webpage-container-or-publisher", PAGES, "info", "container-title", _none("container_title", "publisher"), need("web page", "a site name", "a publisher")),
        Rule("conference-requires-event-or-container", ("paper-conference",), "warning", "event-title", _none("event_title", "container_title"), need("conference paper", "an event", "proceedings")),
        Rule("patent-requires-number", ("patent",), "warning", "number", _none("citation_number", "number"), need("patent", "a number")),
        Rule("patent-requires-authority", ("patent",), "info", "authority", _none("authority"), need("patent", "an authority")),
        Rule("legislation-requires-number", ("legislation", "bill", "regulation"), "warning", "number", _none("citation_number", "number"), need("statute", "a number")),
        Rule("legal-case-requires-authority", ("legal_case",), "info", "authority", _none("authority"), need("case", "a court")),
        Rule("dataset-requires-url-or-doi", ("dataset",), "error", "URL", _none("URL", "DOI"), need("data set", "a URL", "a DOI"), fixable=True),
        Rule("dataset-requires-publisher", ("dataset",), "info", "publisher", _none("publisher"), need("data set", "a publisher")),
        Rule("software-requires-version", ("software",), "info", "version", _none("version"), need("program", "a version")),
        Rule("software-requires-url-or-doi", ("software",), "warning", "URL", _none("URL", "DOI"), need("program", "a URL", "a DOI"), fixable=True),
        Rule("standard-requires-number", ("standard",), "warning", "number", _none("citation_number", "number"), need("standard", "a number")),
        Rule("broadcast-requires-publisher", ("broadcast", "motion_picture"), "info", "publisher", _none("publisher"), need("broadcast", "a producer")),
        Rule("manuscript-requires-genre", ("manuscript",), "info", "genre", _none("genre"), need("manuscript", "its kind")),
        Rule("doi-format", ANY, "error", "DOI", broken_if("DOI", r"^10\.\d{4,}/"), "DOI is malformed", fixable=True),
        Rule("url-format", ANY, "warning", "URL", broken_if("URL", r"(?i)^https?://"), "URL has no protocol", fixable=True),
        Rule("year-range", ANY, "warning", "issued", (year < 1450) | (year > as_of.year + 2), "Year is out of range"),
        Rule("page-format", ANY, "info", "page", F.col("page").rlike("[–—]"), "Pages have a dash instead of a hyphen", fixable=True),
        Rule("apa-doi-recommended", ("article-journal",), "info", "DOI", ~is_preprint() & _none("DOI"), "APA: a DOI is recommended", APA, True),
        Rule("apa-volume-required", ("article-journal",), "warning", "volume", ~is_preprint() & _none("volume"), "APA: a volume is required", APA, True),
        Rule("apa-report-number", ("report",), "info", "number", _none("citation_number", "number"), "APA: a report number is recommended", APA),
        Rule("apa-thesis-university", ("thesis",), "warning", "publisher", _none("publisher"), "APA: the university is required", APA),
        Rule("apa-thesis-type", ("thesis",), "warning", "genre", _none("genre"), "APA: the kind of thesis is required", APA),
        Rule("apa-webpage-retrieval", PAGES, "error", "URL", _none("URL"), "APA: a URL is required", ("apa-7th",)),
        Rule("apa-dataset-brackets", ("dataset",), "info", "genre", _none("genre"), "APA: the kind goes in brackets", APA),
        Rule("apa-software-brackets", ("software",), "info", "genre", _none("genre"), "APA: the kind goes in brackets", APA),
        Rule("ieee-abbreviated-journal", ("article-journal",), "info", "container-title", _none("container_title_short") & (F.char_length("container_title") > 30), "IEEE: the journal is abbreviated", ("ieee",), True),
        Rule("gray-lit-url-recommended", GREY, "info", "URL", _none("URL", "DOI"), "A URL or DOI is recommended", fixable=True),
    ]


def applicable(rules: list[Rule], style: str | None) -> list[Rule]:
    """Without a style only rules that hold for all styles."""
    return [r for r in rules if not r.styles or style in r.styles]


def validate(items: DataFrame, style: str | None, as_of: date, rules: list[Rule] | None = None) -> DataFrame:
    """A row for each broken rule of each item: citation_id, rule_id, severity, field, message, auto_fixable."""
    found = []
    for r in applicable(rules or all_rules(as_of), style):
        on = F.col("type").isin(list(r.types)) & r.broken if r.types else r.broken
        found.append(F.when(on, F.struct(F.lit(r.id).alias("rule_id"), F.lit(r.severity).alias("severity"), F.lit(r.field).alias("field"), F.lit(r.message).alias("message"), F.lit(r.fixable).alias("auto_fixable"))))
    return items.select(F.col("id").alias("citation_id"), F.explode(F.array_compact(F.array(*found))).alias("i")).select("citation_id", "i.*")


def issue_summary(issues: DataFrame) -> DataFrame:
    """One row: errors, warnings, infos; an unknown severity counts as info."""
    s = F.col("severity")
    return issues.agg(F.count_if(s == "error").alias("errors"), F.count_if(s == "warning").alias("warnings"), F.count_if(~F.coalesce(s.isin("error", "warning"), F.lit(False))).alias("infos"))


def statuses(items: DataFrame, before: DataFrame, after: DataFrame | None = None) -> DataFrame:
    """citation_id, n_before, n_after, status.  Without after: pending or has-issues; with it: what a correction left."""
    n = lambda d, c: d.groupBy("citation_id").agg(F.count("*").alias(c))
    out = items.select(F.col("id").alias("citation_id")).join(n(before, "n_before"), "citation_id", "left").fillna(0, ["n_before"])
    if after is None:
        return out.withColumn("n_after", F.col("n_before")).withColumn("status", F.when(F.col("n_before") > 0, "has-issues").otherwise("pending"))
    out = out.join(n(after, "n_after"), "citation_id", "left").fillna(0, ["n_after"])
    status = F.when((F.col("n_before") > 0) & (F.col("n_after") == 0), "fixed").when(F.col("n_after") == 0, "pending").when(F.col("n_after") < F.col("n_before"), "partially-fixed").otherwise("has-issues")
    return out.withColumn("status", status)
