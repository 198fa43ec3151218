"""Identifiers, URLs and hosts as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

DOI = r"10\.\d{4,}/[^\s\"<>]+"
PRIVATE_HOST = r"^(localhost|.*\.local|127\..*|10\..*|192\.168\..*|169\.254\..*|172\.(1[6-9]|2[0-9]|3[01])\..*|0\..*|\[.*\])$"


def doi(c: Column) -> Column:
    """The first DOI in a text without closing signs, or null."""
    found = F.regexp_replace(F.regexp_extract(c, DOI, 0), r"[.,;)\]}]+$", "")
    return F.when(found != "", found)


def clean_doi(c: Column) -> Column:
    return F.lower(F.trim(F.regexp_replace(c, r"(?i)^https?://(dx\.)?doi\.org/", "")))


def arxiv_id(c: Column) -> Column:
    found = F.regexp_extract(c, r"(?i)arxiv(?:\.org/(?:abs|pdf)/|:\s*)(\d{4}\.\d{4,5}(?:v\d+)?)", 1)
    return F.when(found != "", found)


def pmid(c: Column) -> Column:
    found = F.regexp_extract(c, r"(?i)(?:pmid:?\s*|pubmed\.ncbi\.nlm\.nih\.gov/)(\d{1,9})", 1)
    return F.when(found != "", found)


def pmcid(c: Column) -> Column:
    found = F.upper(F.regexp_extract(c, r"(?i)\bPMC\d+", 0))
    return F.when(found != "", found)


def first_year(c: Column) -> Column:
    return F.regexp_extract(c, r"\d{4}", 0).try_cast("int")


def identifier_type(c: Column) -> Column:
    """doi, pmcid, pmid (its page, or up to 9 digits), isbn (10 or 13), url or unknown; the first that fits."""
    t = F.trim(c)
    bare = F.regexp_replace(t, r"[\s-]", "")
    return (
        F.when(t.rlike(r"^(https?://(dx\.)?doi\.org/|[dD][oO][iI]:\s*)?10\.\d{4,}/"), "doi")
        .when(t.rlike(r"^[pP][mM][cC]\d+$"), "pmcid")
        .when(t.rlike(r"pubmed\.ncbi\.nlm\.nih\.gov/\d+") | t.rlike(r"^\d{1,9}$"), "pmid")
        .when(bare.rlike(r"^(\d{9}[\dxX]|\d{13})$"), "isbn")
        .when(t.rlike(r"^[hH][tT][tT][pP][sS]?://"), "url")
        .otherwise("unknown")
    )


def clean_identifier(c: Column) -> Column:
    kind, t = identifier_type(c), F.trim(c)
    return (
        F.when(kind == "doi", F.regexp_replace(t, r"(?i)^(https?://(dx\.)?doi\.org/|doi:\s*)", ""))
        .when(kind == "pmcid", F.upper(t))
        .when(kind == "pmid", F.regexp_extract(t, r"(\d+)\D*$", 1))
        .when(kind == "isbn", F.regexp_replace(t, r"[\s-]", ""))
        .otherwise(t)
    )


def lookup_kind(c: Column) -> Column:
    """As identifier_type for a search key: PMIDs have 6 to 9 digits and all else is a title; keys are cut at 500 characters."""
    t = F.trim(F.left(c, F.lit(500)))
    return F.when(t.rlike(r"10\.\d{4,}/"), "doi").when(t.rlike(r"^[pP][mM][cC]\d+$"), "pmcid").when(t.rlike(r"^\d{6,9}$"), "pmid").when(t.rlike(r"^[hH][tT][tT][pP][sS]?://"), "url").otherwise("title")


def host(url: Column) -> Column:
    return F.lower(F.regexp_extract(url, r"^[a-zA-Z][a-zA-Z0-9+.-]*://([^/?#]*)", 1))


def site_name(url: Column) -> Column:
    """The label before the suffix with a capital, for hosts that no name is known of."""
    h = F.regexp_replace(host(url), r"^www\.", "")
    label = F.get(F.split(h, r"\."), F.greatest(F.size(F.split(h, r"\.")) - 2, F.lit(0)))
    return F.concat(F.upper(F.substring(label, 1, 1)), F.substring(label, 2, 1 << 20))


def host_class(url: Column) -> Column:
    h = host(url)
    return (
        F.when(h.rlike(r"(^|\.)(doi\.org|arxiv\.org|pubmed\.ncbi\.nlm\.nih\.gov)$"), "registry")
        .when(h.rlike(r"\.gov(\.[a-z]{2})?$") | h.rlike(r"(^|\.)europa\.eu$"), "government")
        .when(h.rlike(r"\.(edu|ac\.[a-z]{2})$"), "academic")
        .when(h.rlike(r"\.org$"), "organisation")
        .otherwise("other")
    )


def may_fetch(url: Column) -> Column:
    """https without credentials, to a named public host."""
    rest = F.regexp_extract(url, r"^https://([^/?#]*)", 1)
    name = F.regexp_replace(F.lower(rest), r":\d+$", "")
    return F.coalesce((rest != "") & ~rest.contains("@") & name.contains(".") & ~name.rlike(PRIVATE_HOST), F.lit(False))


def issn(c: Column) -> Column:
    """Keys of all ISSNs in a field: eight signs, upper case, without hyphen."""
    return F.array_distinct(F.transform(F.regexp_extract_all(F.upper(c), F.lit(r"\b(\d{4}-?\d{3}[\dX])\b"), 1), lambda x: F.replace(x, F.lit("-"), F.lit(""))))
