"""Guarding and rolling up what a model said about passages, and scanning sources for injected instructions."""

from __future__ import annotations

import json
import re

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from ..functions import places as P
from ..functions import text as X

# Rule, category, severity, pattern (case is ignored).
INJECTION = [
    ("p1_ignore_instructions", "prompt_injection", "high", r"ignore (?:all |any )?(?:the )?(?:previous|prior|earlier|above) instructions?"),
    ("p1_disregard_instructions", "prompt_injection", "high", r"disregard (?:all |any )?(?:the )?(?:previous|prior|above|system|initial) instructions?"),
    ("p1_override_instructions", "prompt_injection", "high", r"(?:override|forget) (?:all |your |the )?(?:system )?(?:instructions|guidelines|rules)"),
    ("p2_hidden_comment", "prompt_injection", "high", r"<!--[\s\S]*?(?:ignore|instructions?|must|obey)[\s\S]*?-->"),
    ("p2_secret_directive", "prompt_injection", "high", r"(?:do not|never) (?:tell|reveal|mention) (?:anyone|the user|this instruction)"),
    ("p3_exfil_transmit", "exfiltration", "high", r"(?:send|post|transmit|exfiltrate|leak|upload) (?:the |this |our |entire |full )?(?:conversation|context|chat|prompt|content|data|text) (?:to|via)"),
    ("p5_harmful_instruction", "prompt_injection", "critical", r"(?:your|the) (?:goal|mission|task|purpose) is to .{0,60}(?:harm|kill|injure|poison|attack|destroy)"),
    ("p5_cause_harm", "prompt_injection", "critical", r"(?:cause|inflict) (?:physical|serious|bodily) harm"),
    ("ar1_never_refuse", "anti_refusal", "high", r"(?:never|do not|don'?t) refuse"),
    ("ar1_always_comply", "anti_refusal", "high", r"always (?:comply|answer|obey|follow|agree)"),
    ("ar2_no_disclaimers", "anti_refusal", "high", r"(?:no|without) disclaimers?"),
    ("ar2_no_warnings", "anti_refusal", "high", r"(?:do not|never) (?:add|include|mention|use) (?:warnings?|ethical (?:comments?|considerations?)|moraliz)"),
    ("ar3_no_restrictions", "anti_refusal", "high", r"you have no restrictions"),
    ("ar3_ignore_safety", "anti_refusal", "high", r"(?:ignore|disregard) (?:all |your )?(?:safety|ethics?|guidelines|guardrails?|policies?)"),
    ("ar3_do_anything", "anti_refusal", "high", r"(?:you (?:can|are allowed to|may)) do anything"),
    ("ar3_no_rules", "anti_refusal", "high", r"no rules apply"),
    ("e2_harvest_credentials", "exfiltration", "high", r"(?:collect|harvest|extract|steal|grab) (?:all |the )?(?:api[_-]?keys?|secrets?|credentials?|passwords?|tokens?)"),
    ("e2_env_secrets", "exfiltration", "high", r"(?:api[_-]?key|secret|password|token)s? (?:from|in) (?:the )?(?:env|environment|config|settings)"),
    ("e3_enumeration", "exfiltration", "medium", r"(?:scan|list|enumerate) (?:the |all |your )?(?:director|folders?|file system|home director)"),
    ("e4_context_leak", "exfiltration", "high", r"(?:send|share|transmit|upload|forward) (?:this |the |our |entire |full )?(?:conversation|context|chat|session|prompt|log)"),
    ("u1_zero_width", "unicode", "medium", r"[\u200B-\u200D\u2060\uFEFF]"),
    ("u2_bidi_override", "unicode", "medium", r"[\u202A-\u202E\u2066-\u2069]"),
]
PER_RULE, IN_ALL = 10, 100


#: Characters of context on each side of a hit.
CONTEXT = 28


def injection_scan(texts: DataFrame, key: str, text: str) -> DataFrame:
    """key, rule, category, severity, match, nr, index, context: at most PER_RULE hits of a rule and IN_ALL of a text, which are features
    of the report.  index is the code point where the match stands, context what is around it."""
    hits = F.concat(*[F.transform(F.slice(P.places(F.col(text), f"(?i){p}"), 1, PER_RULE), _hit(r, c, s)) for r, c, s, p in INJECTION])
    found = texts.select(key, F.col(text).alias("_text"), F.posexplode(F.slice(hits, 1, IN_ALL)).alias("nr", "h")).select(key, "_text", "h.*", "nr")
    at = F.col("at")
    start = F.greatest(at - CONTEXT, F.lit(0))
    around = F.substring(F.col("_text"), start + 1, at + CONTEXT + 1 - start)
    return found.withColumn("index", at).withColumn("context", F.regexp_replace(around, r"\s+", " ")).drop("_text", "at")


def injection_guard(verdict: Column, reasons: Column, findings: Column, most: int = 4) -> Column:
    """struct(verdict, reasons) of a source with findings (array of struct(rule, severity)): a pass becomes a warning, warnings and failures gain
    a reason; without findings all stays."""
    named = F.array_join(F.transform(F.slice(findings, 1, most), lambda f: F.concat(f["rule"], F.lit(" ("), f["severity"], F.lit(")"))), ", ")
    rest = F.when(F.size(findings) > most, F.concat(F.lit(" and "), (F.size(findings) - most).cast("string"), F.lit(" more"))).otherwise("")
    told = F.array(F.concat(F.lit("Potential adversarial content in source text: "), named, rest))
    some = F.coalesce(F.size(findings) > 0, F.lit(False))
    had = F.coalesce(reasons, F.array().cast("array<string>"))
    return F.struct(
        F.when(some & (verdict == "pass"), "warn").otherwise(verdict).alias("verdict"), F.when(some & (verdict == "pass"), told).when(some & verdict.isin("warn", "fail"), F.concat(had, told)).otherwise(had).alias("reasons")
    )


def claim_breakdown(sites: DataFrame, key: str, order: str = "ord", most: int = 3) -> DataFrame:
    """sites: key, order, claims (guarded).  A row for each finding with claims: counts by verdict and the first distinct lines of rationale."""
    c = sites.select(key, order, F.posexplode("claims").alias("_i", "_c"))
    is_ = lambda v: F.count_if(F.col("_c.verdict") == v).alias(v)
    lines = F.transform(F.array_sort(F.collect_list(F.struct(order, "_i", F.coalesce("_c.rationale", F.array().cast("array<string>")).alias("r")))), lambda x: x["r"])
    top = F.slice(F.array_distinct(F.filter(F.transform(F.flatten(lines), lambda t: F.trim(t)), lambda t: t != "")), 1, most)
    verdicts = [is_(v) for v in ("supported", "weak", "contradicted", "not_in_source", "insufficient")]
    return c.groupBy(key).agg(*verdicts, F.count_if(F.col("_c.quotes") == "invalid").alias("invalid_quotes"), F.count("*").alias("audited"), top.alias("top_rationale"))


def _hit(rule: str, category: str, severity: str):
    return lambda m: F.struct(F.lit(rule).alias("rule"), F.lit(category).alias("category"), F.lit(severity).alias("severity"), m["raw"].alias("match"), m["start"].alias("at"))


def repair_json(raw: str | None) -> str | None:
    """The first object in a model's answer, as valid JSON, or null: without thinking, fences, optional-key marks and trailing commas."""
    if raw is None:
        return None
    t = re.sub(r"(?is)<think(?:ing)?>.*?</think(?:ing)?>", "", raw)
    t = re.sub(r"```(?:json)?", "", t)
    start = t.find("{")
    if start < 0:
        return None
    depth, inside, skip, end = 0, False, False, len(t)
    for i in range(start, len(t)):
        ch = t[i]
        if skip:
            skip = False
        elif inside:
            skip, inside = ch == "\\", ch != '"'
        elif ch == '"':
            inside = True
        elif ch in "{}":
            depth += 1 if ch == "{" else -1
            if not depth:
                end = i + 1
                break
    t = re.sub(r'("\w+")\s*\?\s*:', r"\1:", t[start:end])
    while (u := re.sub(r",(\s*[}\]])", r"\1", t)) != t:
        t = u
    try:
        return json.dumps(json.loads(t), ensure_ascii=False)
    except ValueError:
        return None


@F.pandas_udf(StringType())
def repaired(raw: pd.Series) -> pd.Series:
    return raw.map(repair_json)


CLAIMS = "struct<claims:array<struct<claim:string,verdict:string,hasNumericClaim:boolean,sourceQuotes:array<string>,rationale:array<string>>>,overallVerdict:string,overallRationale:array<string>>"


def parse_claims(raw: Column) -> Column:
    """The claims of a model's answer; what parses as it is goes past the repair."""
    return F.when(F.try_parse_json(raw).isNotNull(), F.from_json(raw, CLAIMS)).otherwise(F.from_json(repaired(F.when(F.try_parse_json(raw).isNull(), raw)), CLAIMS))


def _close(a: Column, b: Column) -> Column:
    return F.abs(a - b) <= 0.05 * F.greatest(F.abs(a), F.abs(b))


def numbers(text: Column) -> Column:
    return F.transform(F.regexp_extract_all(text, F.lit(r"(-?\d+(?:\.\d+)?)"), 1), lambda x: x.cast("double"))


def guard(claims: Column, source: Column) -> Column:
    """Claims with checked verdicts: a supported claim with a number that no quote comes near is contradicted, and one whose quotes aren't
    all in the source is weak."""

    def one(c: Column) -> Column:
        q = F.coalesce(c["sourceQuotes"], F.array().cast("array<string>"))
        there = F.forall(q, lambda x: X.quotes(source, x)) & (F.size(q) > 0)
        said, read = numbers(c["claim"]), numbers(F.array_join(q, " "))
        off = F.coalesce(c["hasNumericClaim"], F.lit(False)) & (F.size(read) > 0) & F.exists(said, lambda n: ~F.exists(read, lambda m: _close(n, m)))
        v = F.when((c["verdict"] == "supported") & off, "contradicted").when((c["verdict"] == "supported") & ~there, "weak").otherwise(c["verdict"])
        return F.struct(c["claim"].alias("claim"), v.alias("verdict"), F.when(F.size(q) == 0, "none").when(there, "valid").otherwise("invalid").alias("quotes"), c["rationale"].alias("rationale"))

    return F.transform(claims, one)


def passage_verdict(claims: Column, overlap_bucket: Column) -> Column:
    """Of guarded claims: fail if one is contradicted, then not in the source, insufficient, weak or misquoted, low overlap, else pass."""
    has = lambda v: F.exists(claims, lambda c: c["verdict"] == v)
    bad = F.exists(claims, lambda c: c["quotes"] == "invalid")
    return (
        F.when(claims.isNull() | (F.size(claims) == 0), "insufficient")
        .when(has("contradicted"), "fail")
        .when(has("not_in_source"), "warn")
        .when(F.forall(claims, lambda c: c["verdict"] == "insufficient"), "insufficient")
        .when(has("weak") | bad | (overlap_bucket == "low"), "warn")
        .otherwise("pass")
    )


def rollup(sites: DataFrame, key: list[str], order: str = "ord") -> DataFrame:
    """Verdict of a finding from its sites (status, reasons): fail over warn over insufficient; skips beside passes warn; all skipped:
    skip; all passed: pass.  Reasons in order; those of insufficient sites once each."""
    s = F.col("status")
    some = lambda v: F.bool_or(s == v)
    ordered = F.transform(F.array_sort(F.collect_list(F.struct(order, "status", "reasons"))), lambda x: F.struct(x["status"].alias("status"), x["reasons"].alias("reasons")))
    g = sites.groupBy(*key).agg(some("fail").alias("f"), some("warn").alias("w"), some("insufficient").alias("i"), some("skip").alias("s"), some("pass").alias("p"), ordered.alias("x"))
    v = F.when(F.col("f"), "fail").when(F.col("w"), "warn").when(F.col("i"), "insufficient").when(F.col("s") & F.col("p"), "warn").when(F.col("s"), "skip").otherwise("pass")
    g = g.withColumn("verdict", v)
    told = F.when(F.col("verdict").isin("fail", "warn", "insufficient"), F.flatten(F.transform(F.filter("x", lambda r: (r["status"] == F.col("verdict")) & r["reasons"].isNotNull()), lambda r: r["reasons"]))).otherwise(F.array().cast("array<string>"))
    return g.select(*key, "verdict", F.when(F.col("verdict") == "insufficient", F.array_distinct(told)).otherwise(told).alias("reasons"))


def worst_bucket(bucket: Column) -> Column:
    """An aggregate: low before medium before high; null without any."""
    return F.element_at(F.create_map(*[F.lit(x) for x in (0, "low", 1, "medium", 2, "high")]), F.min(F.when(bucket == "low", 0).when(bucket == "medium", 1).when(bucket == "high", 2)))


def choose_source(sources: DataFrame, key: str) -> DataFrame:
    """The first usable text of each key: attached PDF, PMC, open-access pdf, url, landing page, abstract.  An abstract caps its bucket."""
    ranks = F.create_map(*[F.lit(x) for i, k in enumerate(["attached", "pmc", "oa_pdf", "oa_url", "oa_landing", "abstract"]) for x in (k, i)])
    usable = sources.filter(F.trim(F.coalesce("text", F.lit(""))) != "").withColumn("_r", F.coalesce(F.element_at(ranks, F.col("kind")), F.lit(9)))
    n = F.row_number().over(Window.partitionBy(key).orderBy("_r", "ord"))
    return usable.withColumn("_n", n).filter("_n = 1").withColumn("capped", F.col("kind") == "abstract").drop("_n", "_r")
