"""Comparing items with registry records, and patches."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..checkpoints import written
from ..functions import text as X
from ..schema import is_blank

TITLE = 0.9
CONFLICT = 0.35
LIMIT = 200


def mismatches(pairs: DataFrame, source: str = "crossref") -> DataFrame:
    """pairs: citation_id and user_, canonical_ columns for title, year, volume, page, container_title.  A row for each difference;
    a volume or page that the user lacks reads (missing).  A PubMed record is compared by exact title and without pages."""
    u, c = (lambda n: F.col(f"user_{n}")), (lambda n: F.col(f"canonical_{n}"))
    have = lambda n: ~is_blank(c(n))
    exact = source == "pubmed"
    a, b = X.normalize(u("title")), X.normalize(c("title"))
    differ = [("title", have("title") & ~is_blank(u("title")) & ((a != b) if exact else (X.levenshtein_ratio(a, b) < TITLE)), u("title"))]
    if exact:
        x, y = X.normalize(u("container_title")), X.normalize(c("container_title"))
        differ.append(("container-title", have("container_title") & ~is_blank(u("container_title")) & ~x.contains(y) & ~y.contains(x), u("container_title")))
    else:
        differ.append(("year", have("year") & ~is_blank(u("year")) & (u("year") != c("year")), u("year")))
    for n in ("volume",) if exact else ("volume", "page"):
        norm = X.page_range if n == "page" else (lambda v: v)
        differ.append((n, have(n) & (is_blank(u(n)) | (norm(u(n)) != norm(c(n)))), F.when(is_blank(u(n)), "(missing)").otherwise(u(n))))
    rows = [F.when(on, F.struct(F.lit(f).alias("field"), user.alias("user_value"), c(f.replace("-", "_")).alias("canonical_value"), F.lit(source).alias("source"))) for f, on, user in differ]
    return pairs.select("citation_id", F.explode(F.array_compact(F.array(*rows))).alias("m")).select("citation_id", "m.*")


def verdict(items: DataFrame, found: DataFrame) -> DataFrame:
    """citation_id, verdict: fail for another title, warn for other differences, else pass."""
    worst = found.groupBy("citation_id").agg(F.max(F.when(F.col("field") == "title", 2).otherwise(1)).alias("w"))
    out = items.select(F.col("id").alias("citation_id")).join(worst, "citation_id", "left")
    return out.select("citation_id", F.when(F.col("w") == 2, "fail").when(F.col("w") == 1, "warn").otherwise("pass").alias("verdict"))


def conflicting(anchor: Column, canonical: Column) -> Column:
    """Whether a title is of another work: too few of its words stand in the row."""
    return ~is_blank(F.trim(anchor)) & ~is_blank(F.trim(canonical)) & (X.containment(canonical, anchor) < CONFLICT)


def held(found: DataFrame) -> DataFrame:
    """Adds held: all mismatches of a citation that one title conflict is among.  found has anchor, the row's own text."""
    conflict = (F.col("field") == "title") & conflicting(F.coalesce("anchor", "user_value"), F.col("canonical_value"))
    return found.withColumn("held", F.bool_or(F.coalesce(conflict, F.lit(False))).over(Window.partitionBy("citation_id")))


def apply_patches(items: DataFrame, patches: DataFrame, fields: list[str]) -> DataFrame:
    """patches: ord, id, field, value.  The last usable value of a field counts; blank ones and (missing) are passed over."""
    usable = patches.filter((F.trim("value") != "") & (F.trim("value") != "(missing)") & F.col("field").isin(fields))
    last = usable.groupBy("id").pivot("field", fields).agg(F.max_by("value", "ord"))
    last = last.select("id", *[F.col(f"`{f}`").alias(f"_p_{f}") for f in fields])
    return items.join(last, "id", "left").withColumns({f: F.coalesce(F.col(f"_p_{f}"), F.col(f)) for f in fields}).drop(*[f"_p_{f}" for f in fields])


def priority(items: DataFrame, odd_year: Column, limit: int = LIMIT) -> DataFrame:
    """Rows to verify first: with an identifier and an odd year, then others with one, then the rest."""
    known = ~is_blank(F.col("DOI")) | ~is_blank(F.col("PMID")) | ~is_blank(F.col("PMCID"))
    step = F.when(known & F.coalesce(odd_year, F.lit(False)), 0).when(known, 1).otherwise(2)
    return items.withColumn("bucket", step).orderBy("bucket", "ord").limit(limit)


def integrity_risk(status: Column) -> Column:
    return F.when(status == "fail", "high").when(status.isin("warn", "insufficient"), "medium").when(status == "pass", "low").otherwise("unknown")


def unified(items: DataFrame, check, fields: list[str], odd_year: Column, limit: int | None = LIMIT) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Checks items, patches what may be patched and checks again.  Returns the patched items, the differences that remain, and citation_id, verdict of
    all that were checked, as the later check has it.

    check: from items to mismatches with anchor, see mismatches() and held(); it should keep the ids and read its records once.  Only the first `limit` rows by
    priority are checked each time, all if it is None.  All differences of a row whose title is of another work are held and never patched; they
    remain as the first check found them.  Each check is written once, so that it is one scan of items and records.
    """
    chosen = lambda d: priority(d, odd_year, limit) if limit is not None else d
    once = chosen(items)
    first = written(held(check(once)), "first-check")
    loose = first.filter("NOT held")
    patches = loose.select(F.monotonically_increasing_id().alias("ord"), F.col("citation_id").alias("id"), F.regexp_replace("field", "-", "_").alias("field"), F.col("canonical_value").alias("value"))
    patched = apply_patches(items, patches, fields)
    again = chosen(patched)
    second = written(check(again), "second-check")
    kept = first.filter("held").drop("held")
    conflicts = kept.select("citation_id").distinct()
    remaining = kept.unionByName(second.join(conflicts, "citation_id", "left_anti"))
    late, early = verdict(again.select("id"), second), verdict(once.select("id"), first)
    layers = early.join(late.withColumnRenamed("verdict", "late"), "citation_id", "full").select("citation_id", F.coalesce("late", "verdict").alias("verdict"))
    return patched, remaining, layers
