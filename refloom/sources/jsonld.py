"""Metadata from the JSON-LD blocks of pages: parsed as variants, flattened, ranked by type and merged field by field."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions import text as X
from ..functions.places import let

BLOCK = r"(?is)<script[^>]*type=[\"']application/ld\+json[\"'][^>]*>(.*?)</script>"
# The types that count and their ranks.
RANKS = {"scholarlyarticle": 5, "newsarticle": 5, "article": 4, "blogposting": 3, "webpage": 2, "medicalwebpage": 2, "report": 1}
DOI = r"(?i)\b(10\.\d{4,}/[^\s,;)}\]\"]+)"
#: How deep lists and graphs may stand in each other.
DEPTH = 6


def _kind(v: Column) -> Column:
    return F.schema_of_variant(v)


def _at(v: Column, field: str) -> Column:
    return F.try_variant_get(v, f"$['{field}']", "variant")


def _text(v: Column) -> Column:
    """A variant's string, trimmed; null for any other kind, and for a blank one."""
    return F.when(_kind(v) == "STRING", F.nullif(F.trim(F.try_variant_get(v, "$", "string")), F.lit("")))


def _list(v: Column) -> Column:
    """A variant's elements; one that is no list is its only element."""
    return F.when(_kind(v).startswith("ARRAY"), F.try_variant_get(v, "$", "array<variant>")).when(v.isNotNull() & (_kind(v) != "VOID"), F.array(v)).otherwise(F.array().cast("array<variant>"))


def things(html: Column) -> Column:
    """array<variant> of the objects in a page's blocks, in order; lists and graphs are opened, malformed blocks passed over."""
    parsed = F.filter(F.transform(F.regexp_extract_all(html, F.lit(BLOCK), 1), lambda b: F.try_parse_json(F.trim(b))), lambda v: v.isNotNull())

    def open_up(v: Column) -> Column:
        graph = _at(v, "@graph")
        return F.when(_kind(v).startswith("ARRAY"), _list(v)).when(_kind(graph).startswith("ARRAY"), _list(graph)).otherwise(F.array(v))

    for _ in range(DEPTH):
        parsed = let(parsed, lambda vs: F.flatten(F.transform(vs, open_up)))
    return F.filter(parsed, lambda v: _kind(v).startswith("OBJECT"))


def _rank(v: Column) -> Column:
    names = F.transform(_list(_at(v, "@type")), lambda t: F.regexp_replace(F.lower(_text(t)), "^https?://schema\\.org/", ""))
    ranks = F.create_map(*[F.lit(x) for pair in RANKS.items() for x in pair])
    return F.coalesce(F.array_max(F.transform(names, lambda n: F.coalesce(F.try_element_at(ranks, F.coalesce(n, F.lit(""))), F.lit(0)))), F.lit(0))


def _people(v: Column) -> Column:
    """Names of persons: strings, or objects with a name or a family name; organisations are left out."""

    def name(p: Column) -> Column:
        family = _text(_at(p, "familyName"))
        full = F.when(family.isNotNull(), F.concat_ws(" ", _text(_at(p, "givenName")), family))
        organisation = F.coalesce(F.lower(_text(_at(p, "@type"))).contains("organization"), F.lit(False))
        return F.when(_kind(p) == "STRING", _text(p)).when(~organisation, F.coalesce(_text(_at(p, "name")), full))

    return F.filter(F.transform(_list(v), name), lambda n: n.isNotNull())


def _year(raw: Column) -> Column:
    first, any_ = F.regexp_extract(raw, r"^(\d{4})", 1), F.regexp_extract(raw, r"\b((?:19|20)\d{2})\b", 1)
    return F.coalesce(F.nullif(first, F.lit("")), F.nullif(any_, F.lit(""))).cast("int")


def _site(v: Column) -> Column:
    return F.coalesce(_text(v), _text(_at(v, "name")))


def metadata(html: Column) -> Column:
    """struct(title, authors, year, doi, container_title, publisher), what is missing null; null for a page without things.

    Things are gone through by falling rank of their types, then in order, and each fills what is missing still; the second site's name
    is the publisher.  It ends with the thing that completes title and authors.
    """

    def about(v: Column, i: Column) -> Column:
        author = _people(_at(v, "author"))
        doi = F.filter(F.transform(_list(_at(v, "identifier")), lambda d: F.nullif(F.regexp_extract(F.coalesce(_text(d), F.lit("")), DOI, 1), F.lit(""))), lambda d: d.isNotNull())
        title = F.coalesce(_text(_at(v, "headline")), _text(_at(v, "name")))
        fields = {
            "down": -_rank(v),
            "i": i,
            "title": F.nullif(X.html_to_text(title), F.lit("")),
            "authors": F.when(F.size(author) > 0, author).otherwise(_people(_at(v, "creator"))),
            "year": _year(F.coalesce(*[_text(_at(v, n)) for n in ("datePublished", "dateCreated", "dateModified")])),
            "doi": F.get(doi, 0),
            "site": F.coalesce(_site(_at(v, "publisher")), _site(_at(v, "sourceOrganization"))),
        }
        return F.struct(*[c.alias(n) for n, c in fields.items()])

    state = {"title": "string", "authors": "array<string>", "year": "int", "doi": "string", "container_title": "string", "publisher": "string", "done": "boolean"}
    zero = F.struct(*[(F.lit(False) if n == "done" else F.lit(None).cast(t)).alias(n) for n, t in state.items()])

    def fill(s: Column, n: Column) -> Column:
        title, authors = F.coalesce(s["title"], n["title"]), F.coalesce(s["authors"], F.when(F.size(n["authors"]) > 0, n["authors"]))
        new = {"title": title, "authors": authors, "year": F.coalesce(s["year"], n["year"]), "doi": F.coalesce(s["doi"], n["doi"])}
        new["container_title"] = F.coalesce(s["container_title"], n["site"])
        new["publisher"] = F.coalesce(s["publisher"], F.when(s["container_title"].isNotNull(), n["site"]))
        new["done"] = title.isNotNull() & authors.isNotNull()
        return F.when(s["done"], s).otherwise(F.struct(*[c.alias(k) for k, c in new.items()]))

    merged = lambda vs: F.when(F.size(vs) > 0, F.aggregate(F.array_sort(F.transform(vs, about)), zero, fill).dropFields("done"))
    return let(things(html), merged)
