"""Items to reference formats, one text per item."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..functions import identifiers as I
from ..schema import DATE, NAME, is_blank, year_of
from .readers import BIB_TYPES, RIS_TYPES

_RIS = {v: k for k, v in reversed(RIS_TYPES.items())}
_BIB = {"article-journal": "article", "book": "book", "chapter": "incollection", "paper-conference": "inproceedings", "report": "techreport", "thesis": "phdthesis", "webpage": "online", "patent": "patent", "dataset": "dataset", "software": "software", "manuscript": "unpublished"}
assert set(_BIB.values()) <= set(BIB_TYPES)


def _tag(name: str, value: Column) -> Column:
    return F.when(~is_blank(value), F.concat(F.lit(f"{name}  - "), value))


def _map(kinds: dict[str, str], other: str) -> Column:
    return F.coalesce(F.element_at(F.create_map(*[F.lit(x) for kv in kinds.items() for x in kv]), F.col("type")), F.lit(other))


def full_name(a: Column) -> Column:
    return F.coalesce(a["literal"], F.concat_ws(", ", a["family"], a["given"]))


def ris(items: DataFrame) -> DataFrame:
    """id, ris."""
    c = F.col
    authors = F.coalesce(F.transform("author", lambda a: F.concat(F.lit("AU  - "), full_name(a))), F.array().cast("array<string>"))
    first, last = F.split_part(c("page"), F.lit("-"), F.lit(1)), F.when(c("page").contains("-"), F.split_part(c("page"), F.lit("-"), F.lit(-1)))
    head = F.array(F.concat(F.lit("TY  - "), _map(_RIS, "GEN")), _tag("ID", c("id")), _tag("TI", c("title")))
    tail = F.array(_tag("PY", year_of(c("issued")).cast("string")), _tag("JO", c("container_title")), _tag("JA", c("container_title_short")), _tag("PB", c("publisher")), _tag("VL", c("volume")), _tag("IS", c("issue")), _tag("SP", first), _tag("EP", last), _tag("DO", I.clean_doi(c("DOI"))), _tag("UR", c("URL")), _tag("SN", c("ISSN")), _tag("AB", c("abstract")), F.lit("ER  - "))
    return items.select("id", F.array_join(F.array_compact(F.concat(head, authors, tail)), "\n").alias("ris"))


def escape_tex(c: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(c, r"[{}]", ""), r"([&%#$_])", r"\\$1")


def bibtex(items: DataFrame) -> DataFrame:
    """id, bibtex; keys keep letters, digits and : . _ - only."""
    c = F.col
    field = lambda n, v: F.when(~is_blank(v), F.concat(F.lit(f"  {n} = {{"), v, F.lit("}")))
    key = F.regexp_replace("id", r"[^\w:.-]", "")
    authors = F.array_join(F.transform("author", full_name), " and ")
    fields = F.array_compact(F.array(field("title", escape_tex(c("title"))), field("author", escape_tex(authors)), field("year", year_of(c("issued")).cast("string")), field("journal", escape_tex(c("container_title"))), field("publisher", escape_tex(c("publisher"))), field("volume", c("volume")), field("number", c("issue")), field("pages", F.regexp_replace(c("page"), "-+", "--")), field("doi", I.clean_doi(c("DOI"))), field("url", c("URL"))))
    return items.select("id", F.concat(F.lit("@"), _map(_BIB, "misc"), F.lit("{"), key, F.lit(",\n"), F.array_join(fields, ",\n"), F.lit("\n}")).alias("bibtex"))


def csl_json(items: DataFrame) -> DataFrame:
    """id, json, with the hyphenated names of the format."""
    hyphens = lambda n: n.replace("_", "-")
    renamed = lambda c, fields: F.struct(*[c[n].alias(hyphens(n)) for n in fields])
    person, date = (StructType.fromDDL(f"x {t}")["x"].dataType.names for t in (NAME, DATE))

    def column(n: str) -> Column:
        if n == "author":
            return F.transform("author", lambda a: renamed(a, person)).alias(n)
        if n in ("issued", "accessed"):
            return F.when(F.col(n).isNotNull(), renamed(F.col(n), date)).alias(n)
        return F.col(n).alias(hyphens(n))

    left_out = ("ord", "extra", "original", "source_format", "parse_confidence")
    return items.select("id", F.to_json(F.struct(*[column(c) for c in items.columns if c not in left_out])).alias("json"))


def formatted(items: DataFrame, style: str = "apa-7th") -> DataFrame:
    """id, entry in a plain author-date or numeric form.  A DOI link ends an entry that lacks one."""
    c = F.col
    names = F.array_join(F.transform("author", full_name), "; ")
    year = F.coalesce(year_of(c("issued")).cast("string"), F.lit("n.d."))
    where = F.concat_ws(", ", "container_title", "volume", "page")
    if style == "ieee":
        entry = F.concat(F.coalesce(names, F.lit("")), F.lit(', "'), F.coalesce("title", F.lit("")), F.lit('," '), where, F.lit(", "), year, F.lit("."))
    else:
        entry = F.concat(F.coalesce(names, F.lit("")), F.lit(" ("), year, F.lit("). "), F.coalesce("title", F.lit("")), F.lit(". "), where, F.lit("."))
    link = F.concat(F.lit(" https://doi.org/"), I.clean_doi(c("DOI")))
    return items.select("id", F.when(~is_blank(c("DOI")) & ~F.lower(entry).contains(F.lower(c("DOI"))), F.concat(entry, link)).otherwise(entry).alias("entry"))


def write_lines(d: DataFrame, column: str, path: str) -> None:
    d.select(column).write.mode("overwrite").text(path)


def write_trail(records: DataFrame, path: str, order: str = "ord", most: int = 10_000) -> None:
    """The first `most` records as NDJSON; the cap is the trail's own."""
    records.orderBy(order).limit(most).write.mode("overwrite").json(path)
