"""Summaries, gates and manifests of an audit."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

PASSAGE = ["pass", "warn", "fail", "insufficient", "skip"]
CHECKS = {
    "ethics": r"(?i)ethic(?:s|al) (?:approval|committee|review)|institutional review board",
    "consent": r"(?i)informed consent|consent to (?:participate|publish)",
    "conflict_of_interest": r"(?i)conflicts? of interest|competing interests?",
}
MANUAL = ["data_availability", "funding", "author_contributions", "reporting_guideline"]


def checklist(texts: DataFrame, key: str, text: str) -> DataFrame:
    """key, item, status: found or not for what patterns tell, manual for the rest."""
    t = F.col(text)
    rows = [F.struct(F.lit(k).alias("item"), F.when(t.rlike(p), "found").otherwise("not-found").alias("status")) for k, p in CHECKS.items()] + [F.struct(F.lit(m).alias("item"), F.lit("manual").alias("status")) for m in MANUAL]
    return texts.select(key, F.explode(F.array(*rows)).alias("x")).select(key, "x.*")


def buckets(findings: DataFrame, by: list[str], field: str = "status", values: list[str] = PASSAGE) -> DataFrame:
    """Counts by fixed category, zero where there is none."""
    return findings.groupBy(*by).pivot(field, values).count().na.fill(0)


def claim_counts(sites: DataFrame, by: list[str], claims: str = "claims") -> DataFrame:
    c = F.col(claims)
    count = lambda test: F.size(F.filter(c, test))
    verdicts = ["supported", "weak", "contradicted", "not_in_source", "insufficient"]
    return sites.groupBy(*by).agg(*[F.coalesce(F.sum(count(_is(v))), F.lit(0)).alias(v) for v in verdicts], F.coalesce(F.sum(count(lambda x: x["quotes"] == "invalid")), F.lit(0)).alias("invalid_quotes"))


def _is(verdict: str):
    return lambda x: x["verdict"] == verdict


def preflight(mapped: DataFrame, by: list[str] | None = None) -> DataFrame:
    """mapped: matched, fails.  total, matched, ratio (null without citations), gate: blocker below 0.5 or with failures, warning below 0.85."""
    g = mapped.groupBy(*(by or [])).agg(F.count("*").alias("total"), F.count_if("matched").alias("matched"), F.coalesce(F.sum("fails"), F.lit(0)).alias("failures"))
    g = g.withColumn("ratio", F.try_divide("matched", "total"))
    return g.withColumn("gate", F.when((F.col("ratio") < 0.5) | (F.col("failures") > 0), "blocker").when(F.col("ratio") < 0.85, "warning").otherwise("ok"))


def manifest(files: DataFrame, name: str = "name", content: str = "content") -> DataFrame:
    """name, line: "sha256  name"."""
    return files.select(name, F.concat(F.sha2(F.col(content).cast("binary"), 256), F.lit("  "), F.col(name)).alias("line"))


def event_id(kind: Column, identity: Column) -> Column:
    return F.left(F.sha2(F.concat_ws("|", kind, identity), 256), F.lit(24))


def redact(text: Column, keep: int = 2400) -> Column:
    """struct(head, sha256, chars) in place of a long text."""
    return F.struct(F.left(text, F.lit(keep)).alias("head"), F.sha2(text, 256).alias("sha256"), F.char_length(text).alias("chars"))


def next_actions(summary: DataFrame) -> DataFrame:
    """Adds actions, in order of urgency, to a row with failures, warnings, unmatched and invalid_quotes."""
    c = F.col
    todo = [F.when(c("failures") > 0, "Resolve contradicted citations"), F.when(c("unmatched") > 0, "Map unmatched citations"), F.when(c("invalid_quotes") > 0, "Check quotes that are not in the source"), F.when(c("warnings") > 0, "Review warnings")]
    return summary.withColumn("actions", F.array_compact(F.array(*todo)))


def markdown(findings: DataFrame, key: str = "bib_key") -> DataFrame:
    """One Markdown section for each finding with status and reasons."""
    body = F.array_join(F.transform("reasons", lambda r: F.concat(F.lit("- "), r)), "\n")
    return findings.select(key, F.concat(F.lit("## "), F.col(key), F.lit("\n\nStatus: "), F.col("status"), F.lit("\n"), body).alias("markdown"))


def cache_status(artifacts: DataFrame, cache: DataFrame) -> DataFrame:
    """artifacts: id, content, sha256 (as recorded).  ready, changed or missing against a cache keyed by content hash."""
    now = artifacts.withColumn("now", F.when(F.col("content").isNotNull(), F.sha2("content", 256)))
    c = cache.select(F.col("sha256").alias("now"), F.lit(True).alias("cached"))
    return now.join(c, "now", "left").select("id", F.when(F.col("now").isNull(), "missing").when(F.col("now") != F.col("sha256"), "changed").when(F.col("cached"), "ready").otherwise("missing").alias("status"))


def cache_info(files: DataFrame) -> DataFrame:
    """files: name, length.  entries and bytes of cached artifacts, which are named by a SHA-256."""
    own = files.filter(F.col("name").rlike(r"^[a-f0-9]{64}\.json$"))
    return own.agg(F.count("*").alias("entries"), F.coalesce(F.sum("length"), F.lit(0)).alias("bytes"))
