"""What a user sees of a library: order, filters and search."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..checkpoints import ensure_checkpoint_dir
from ..schema import is_blank, year_of

# Types of items that need no DOI.
NO_DOI_TYPES = "report thesis webpage post post-weblog dataset software patent legislation legal_case bill regulation standard manuscript speech broadcast motion_picture map personal_communication paper-conference document".split()
# What a missing author and a missing year are sorted as.
NO_AUTHOR, NO_YEAR = "zzz", 9999


def author_key(author: Column) -> Column:
    """Sort key of the first author: a literal name, or particle and family, lower-cased."""
    a = F.get(author, 0)
    literal, particle = F.nullif(a["literal"], F.lit("")), F.nullif(a["non_dropping_particle"], F.lit(""))
    return F.when(a.isNull(), NO_AUTHOR).otherwise(F.lower(F.coalesce(literal, F.concat(F.coalesce(F.concat(particle, F.lit(" ")), F.lit("")), F.coalesce(a["family"], F.lit(""))))))


def placed(rows: DataFrame, order: list, name: str = "place") -> DataFrame:
    """rows with their place (1, 2, ...) in a total order.

    Spark's sort deals ranges of the order to tasks; a row's place is its place in its task's range plus the rows of the ranges before,
    of which there is one number per task.  The sorted rows are kept in the checkpoint folder, so that places and sums are of one sort.
    """
    ensure_checkpoint_dir(rows.sparkSession)
    d = rows.orderBy(*order).withColumn("_id", F.monotonically_increasing_id()).checkpoint()
    part = F.shiftright("_id", 33)
    sizes = d.groupBy(part.alias("_part")).agg(F.count("*").alias("_n"))
    before = F.coalesce(F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = F.broadcast(sizes.select("_part", before.alias("_start")))  # a row per task of the sort
    out = d.withColumn("_part", part).join(starts, "_part").withColumn(name, F.col("_start") + F.col("_id") - F.shiftleft("_part", 33) + 1)
    return out.select(*rows.columns, name)


def sort_order(mode: str) -> list:
    """Sort keys of items (with ord, their order of appearance): author-date, author, date, title, appearance or custom."""
    author, year, title = author_key(F.col("author")), F.coalesce(year_of(F.col("issued")), F.lit(NO_YEAR)), F.lower(F.coalesce("title", F.lit("")))
    keys = {"author-date": [author, year], "author": [author], "date": [year], "title": [title], "appearance": [], "custom": []}
    return [*keys[mode], F.col("ord")]


def sort_items(items: DataFrame, mode: str = "author-date") -> DataFrame:
    """Items with their place; rows that a mode doesn't tell apart keep their order."""
    return placed(items, sort_order(mode))


def matches(query: str) -> Column:
    """Whether an item's title, first five authors, DOI, URL, container or id hold the query, case aside; a blank query matches all."""
    q = query.strip().lower()
    name = lambda a: F.coalesce(a["literal"], F.trim(F.concat(F.coalesce(a["family"], F.lit("")), F.lit(" "), F.coalesce(a["given"], F.lit("")))))
    authors = F.array_join(F.transform(F.slice(F.coalesce("author", F.array().cast("array<struct<family:string,given:string,dropping_particle:string,non_dropping_particle:string,suffix:string,literal:string>>")), 1, 5), name), " ")
    parts = [F.nullif(c, F.lit("")) for c in (F.col("title"), authors, F.col("DOI"), F.col("URL"), F.col("container_title"), F.col("id"))]
    return F.lower(F.concat_ws(" ", *parts)).contains(q) if q else F.lit(True)


def display(items: DataFrame, which: str, issues: DataFrame | None = None, statuses: DataFrame | None = None, flags: DataFrame | None = None, groups: DataFrame | None = None, query: str = "") -> DataFrame:
    """Items that a list filter (all, issues, predatory, duplicates, no-doi) and a search leave.

    issues, statuses (with status) and flags are known by citation_id, groups by ord.
    """
    d = items.filter(matches(query))
    ids = lambda t: t.select(F.col("citation_id").alias("id"))
    if which == "issues":
        return d.join(ids(issues).union(ids(statuses.filter("status = 'has-issues'"))), "id", "left_semi")
    if which == "predatory":
        return d.join(ids(flags), "id", "left_semi")
    if which == "duplicates":
        return d.join(groups.select("ord"), "ord", "left_semi")
    if which == "no-doi":
        return d.filter(is_blank(F.col("DOI")) & ~F.coalesce(F.col("type").isin(NO_DOI_TYPES), F.lit(False)))
    return d


# Containers of preprints.
PREPRINT_HINTS = ["arxiv", "medrxiv", "biorxiv", "chemrxiv", "research square", "ssrn"]


def grey_tags() -> Column:
    """Tags of an item's kind of grey literature; a manuscript or document without any is other."""
    t, container = F.col("type"), F.lower(F.coalesce("container_title", F.lit("")))
    hint = F.lit(False)
    for h in PREPRINT_HINTS:
        hint = hint | container.contains(h)
    own = F.when(t.isin("thesis", "report", "webpage"), t).when(t.isin("post", "post-weblog"), "post")
    tags = F.array_compact(F.array(own, F.when(hint, "preprint")))
    return F.when((F.size(tags) == 0) & t.isin("manuscript", "document"), F.array(F.lit("other"))).otherwise(tags)


#: Earlier runs that are kept; the list is a report.
MOST_RUNS = 100


def merge_runs(session: DataFrame, persisted: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Earlier audit runs (ord, generated_at, app_version, ...): those of the session first, each once, MOST_RUNS at most for each key in by."""
    by = by or []
    rows = session.withColumn("_src", F.lit(0)).unionByName(persisted.withColumn("_src", F.lit(1)))
    first = F.row_number().over(Window.partitionBy(*by, "generated_at", "app_version").orderBy("_src", "ord"))
    rows = rows.withColumn("_n", first).filter("_n = 1").drop("_n")
    if not by:
        return rows.orderBy("_src", "ord").limit(MOST_RUNS).drop("_src")
    place = F.row_number().over(Window.partitionBy(*by).orderBy("_src", "ord"))
    return rows.withColumn("_n", place).filter(F.col("_n") <= MOST_RUNS).drop("_n", "_src")
