"""Cases over literal rows: formats, registry records and judgements that the driver tables don't hold.

Their SQL is the table of right answers, worked out by hand from the cases of FIXTURES.md and the operators' definitions.
"""

from __future__ import annotations

import json
import zipfile
from datetime import date
from io import BytesIO

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from refloom.functions import identifiers as I
from refloom.functions import text as X
from refloom.operators import display, grounding, listings, manuscript, report, resolve, rules, styles, verify
from refloom.schema import ITEM_DDL, as_items, year_of
from refloom.sources import pages, readers, registries

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def _sql(v) -> str:
    if v is None:
        return "NULL"
    if isinstance(v, bool):
        return "true" if v else "false"
    if isinstance(v, str):
        return "'" + v.replace("'", "''") + "'"
    return f"{v}::DOUBLE" if isinstance(v, float) else f"{v}::BIGINT"


def case(columns: str, *answers: tuple):
    """Registers a case and its answers."""
    rows = ", ".join("(" + ", ".join(map(_sql, a)) + ")" for a in answers)

    def add(f):
        QUERIES[f.__name__] = lambda spark, sf_dir: f(spark)
        ORACLES[f.__name__] = f"SELECT * FROM (VALUES {rows}) AS t({', '.join(columns.split())})"
        return f

    return add


def _rows(spark: SparkSession, schema: str, *rows: tuple) -> DataFrame:
    return spark.createDataFrame(list(rows), schema)


def _items(spark: SparkSession, *items: dict) -> DataFrame:
    d = spark.createDataFrame([(n, json.dumps(i)) for n, i in enumerate(items)], "n long, j string")
    i = d.select("n", F.from_json("j", StructType.fromDDL(ITEM_DDL)).alias("i"))
    return as_items(i.select(F.coalesce("i.ord", "n").alias("ord"), *[F.col(f"i.`{f.name}`") for f in StructType.fromDDL(ITEM_DDL) if f.name != "ord"]))


def _pairs(spark: SparkSession, *pairs: tuple[str, dict, dict]) -> DataFrame:
    """query_id, ord, exact, q, c."""
    ddl = StructType.fromDDL(ITEM_DDL)
    d = spark.createDataFrame([(q, n, bool(c.get("exact")), json.dumps(a), json.dumps(c)) for n, (q, a, c) in enumerate(pairs)], "query_id string, ord long, exact boolean, a string, b string")
    return d.select("query_id", "ord", "exact", F.from_json("a", ddl).alias("q"), F.from_json("b", ddl).alias("c"))


def _date(year: int) -> dict:
    return {"date_parts": [[year]]}


def _fields(items: DataFrame) -> DataFrame:
    a = F.get("author", 0)
    return items.select("id", "type", "title", "container_title", "volume", "page", "DOI", year_of(F.col("issued")).cast("long").alias("year"), F.coalesce(a["family"], a["literal"]).alias("first_author"), F.coalesce(F.size("author"), F.lit(0)).cast("long").alias("authors"))


_FIELDS = "id type title container_title volume page DOI year first_author authors"

# Formats

_BIB = "@article{smith2020,\n  title = {A {Study} of Things},\n  author = {Smith, John and Mary Jones},\n  journal = {J. Things}, year = 2020, volume = {12}, pages = {100--110}, doi = {https://doi.org/10.1234/abc}\n}\n@book{b2, title=\"Whole Book\", author={{World Health Organization}}, year={1999}}"
_RIS = "TY  - JOUR\nID  - r1\nTI  - On Sorting\nAU  - Knuth, Donald\nAU  - Doe, Jane\nJO  - Sorting Letters\nPY  - 1973/05/01\nVL  - 3\nSP  - 1\nEP  - 9\nDO  - 10.5555/sort\nER  - \nTY  - BOOK\nT1  - A Book\nA1  - World Bank\nY1  - 2001\nER  - \n"
_CSL = '[{"id": "c1", "type": "article-journal", "title": "CSL Title", "author": [{"family": "Roe", "given": "R."}], "issued": {"date-parts": [[2018, 3]]}, "container-title": "Journal C", "volume": "7", "page": "1-2", "DOI": "10.1/c"}, {"id": "c2", "type": "book", "title": "CSL Book"}]'
_LINES = '[1] J. Smith, "A study of AI," IEEE Trans. Comput., vol. 45, no. 2, pp. 123-130, 2020.\nRoe, R. (2018). Learning of machines. Journal C, 7(1), 1-2. https://doi.org/10.1234/xyz'
_ENDNOTE = "<xml><records><record><rec-number>5</rec-number><ref-type name=\"Journal Article\">17</ref-type><contributors><authors><author><style>Poe, Edgar</style></author></authors></contributors><titles><title><style>The Raven Study</style></title><secondary-title>Bird Letters</secondary-title></titles><dates><year>1845</year></dates><volume>2</volume><pages>3-4</pages><electronic-resource-num>10.7/raven</electronic-resource-num></record></records></xml>"


@case("n format", (0, "bibtex"), (1, "ris"), (2, "csl-json"), (3, "plain-text"), (4, "plain-text"), (5, "csl-json"), (6, "bibtex"), (7, "ris"), (8, "plain-text"), (9, "plain-text"))
def format_sniff(spark: SparkSession) -> DataFrame:
    raw = [_BIB, _RIS, _CSL, _LINES, '{"title": "no type"}', '{"type": "book"}', "\ufeff  @misc {k, title={x}}", "\n\nTY  - JOUR\nER  - ", "see @article{k} there", ""]
    return _rows(spark, "n long, raw string", *enumerate(raw)).select("n", readers.sniff(F.col("raw")).alias("format"))


@case(_FIELDS, ("smith2020", "article-journal", "A Study of Things", "J. Things", "12", "100-110", "10.1234/abc", 2020, "Smith", 2), ("b2", "book", "Whole Book", None, None, None, None, 1999, "World Health Organization", 1))
def read_bibtex(spark: SparkSession) -> DataFrame:
    return _fields(readers.read_bibtex(_rows(spark, "src string, raw string", ("s", _BIB)))[0])


@case(_FIELDS, ("s-r1", "article-journal", "On Sorting", "Sorting Letters", "3", "1-9", "10.5555/sort", 1973, "Knuth", 2), ("s-1", "book", "A Book", None, None, None, None, 2001, "World Bank", 1))
def read_ris(spark: SparkSession) -> DataFrame:
    return _fields(readers.read_ris(_rows(spark, "src string, raw string", ("s", _RIS)))[0])


@case("src line", ("s", "XX  - no type"))
def read_ris_errors(spark: SparkSession) -> DataFrame:
    return readers.read_ris(_rows(spark, "src string, raw string", ("s", _RIS + "XX  - no type\nER  - \n")))[1]


@case(_FIELDS, ("c1", "article-journal", "CSL Title", "Journal C", "7", "1-2", "10.1/c", 2018, "Roe", 1), ("c2", "book", "CSL Book", None, None, None, None, None, None, 0))
def read_csl_json(spark: SparkSession) -> DataFrame:
    return _fields(readers.read_csl_json(_rows(spark, "src string, raw string", ("s", _CSL)))[0]).withColumn("authors", F.greatest("authors", F.lit(0)))


@case("title type volume page DOI year first_author", ("A study of AI", "article-journal", "45", "123-130", None, 2020, "Smith"), ("Learning of machines", "article-journal", None, None, "10.1234/xyz", 2018, "Roe"))
def read_lines(spark: SparkSession) -> DataFrame:
    return _fields(readers.read_lines(_rows(spark, "src string, raw string", ("s", _LINES)))[0]).select("title", "type", "volume", "page", "DOI", "year", "first_author")


@case(_FIELDS, ("s-5", "article-journal", "The Raven Study", "Bird Letters", "2", "3-4", "10.7/raven", 1845, "Poe", 1))
def read_endnote(spark: SparkSession) -> DataFrame:
    return _fields(readers.read_endnote_xml(_rows(spark, "src string, raw string", ("s", _ENDNOTE))))


@case("title source_format", ("A Study of Things", "bibtex"), ("Whole Book", "bibtex"), ("On Sorting", "ris"), ("A Book", "ris"), ("CSL Title", "csl-json"), ("CSL Book", "csl-json"), ("A study of AI", "text"), ("Learning of machines", "text"))
def format_dispatch(spark: SparkSession) -> DataFrame:
    """Every source goes to its own reader; a hint doesn't overrule what a source looks like."""
    raw = _rows(spark, "src string, raw string, hint string", ("a", _BIB, None), ("b", _RIS, "ris"), ("c", _CSL, "ris"), ("d", _LINES, None))
    return readers.read_any(raw, hint="hint")[0].select("title", "source_format")


_WORK = '{"DOI": "10.9/x", "title": ["Registry Title"], "type": "posted-content", "container-title": ["Letters"], "volume": "4", "page": "5-6", "author": [{"family": "Doe", "given": "J"}, {"name": "Group"}], "issued": {"date-parts": [[2021, 2, 3]]}, "ISSN": ["1234-5678"], "abstract": "<p>Short <b>text</b></p>"}'


@case("id type title container_title volume page DOI year first_author authors abstract", ("s", "article", "Registry Title", "Letters", "4", "5-6", "10.9/x", 2021, "Doe", 2, "Short text"))
def from_crossref(spark: SparkSession) -> DataFrame:
    i = readers.from_crossref(_rows(spark, "src string, body string", ("s", _WORK), ("t", '{"title": ["no DOI"]}')))
    return _fields(i).join(i.select("id", "abstract"), "id")


@case("n abstract", (0, "Deep nets learn deep things"), (1, None))
def inverted_abstract(spark: SparkSession) -> DataFrame:
    d = _rows(spark, "n long, index map<string,array<int>>", (0, {"deep": [3], "Deep": [0], "nets": [1], "learn": [2], "things": [4]}), (1, None))
    return d.select("n", readers.inverted_abstract(F.col("index")).alias("abstract"))


_TYPED = [
    ("https://arxiv.org/abs/2101.00001", "article", "Preprint"),
    ("In: Springer. https://link.springer.com/chapter/10.1007/1", "chapter", None),
    ("See https://www.nature.com/articles/s41586", "article-journal", None),
    ("Smith J. Title. Lancet. 2020;395:497", "article-journal", None),
    ("Conference title 12(3):45", "article-journal", None),
    ("Smith, J. PhD thesis, Oxford 2010", "thesis", "thesis"),
    ("A dissertation on birds", "thesis", "dissertation"),
    ("World Bank working paper 12", "report", "technical report"),
    ("Policy brief on water", "report", "policy brief"),
    ("Occasional paper three", "report", "discussion paper"),
    ("Report no. 7 of the office", "report", None),
    ("US patent no. 123", "patent", None),
    ("ISO 9001 Quality", "standard", None),
    ("Proceedings of the birds", "paper-conference", None),
    ("Presented at the fair", "paper-conference", None),
    ("Public law of 1990", "legislation", None),
    ("Roe v. Wade", "legal_case", None),
    ("A dataset of birds", "dataset", None),
    ("R package birds", "software", None),
    ("A preprint on birds", "article", None),
    ("Birds. Retrieved from birds", "webpage", None),
    ("Birds https://birds.example/x", "webpage", None),
    ("Birds. Available at 10.1234/abc", "article-journal", None),
    ("Press release of the zoo", "post", None),
    ("Zoo newspaper", "article-newspaper", None),
    ("WHO, Birds", "report", None),
    ("Interview with a bird", "personal_communication", None),
    ("A film on birds", "motion_picture", None),
    ("Bird podcast", "broadcast", None),
    ("Keynote on birds", "speech", None),
    ("Atlas of birds", "map", None),
    ("Manuscript on birds", "manuscript", None),
    ("Bird chapter, in: Birds", "chapter", None),
    ("Birds. Oxford University Press", "book", None),
    ("Birds and bees", "article-journal", None),
]


@case("n type genre", *[(n, t, g) for n, (_, t, g) in enumerate(_TYPED)])
def item_types(spark: SparkSession) -> DataFrame:
    k = readers.item_kind(F.col("line"))
    return _rows(spark, "n long, line string", *[(n, x[0]) for n, x in enumerate(_TYPED)]).select("n", k["type"].alias("type"), k["genre"].alias("genre"))


# Rules

_BROKEN = {
    "article-journal": "required-date journal-requires-container",
    "book": "required-date book-requires-publisher",
    "chapter": "required-date book-requires-publisher chapter-requires-container",
    "paper-conference": "required-date conference-requires-event-or-container",
    "report": "required-date report-requires-publisher report-url-recommended gray-lit-url-recommended",
    "thesis": "required-date thesis-requires-publisher thesis-requires-genre thesis-url-recommended gray-lit-url-recommended",
    "webpage": "webpage-requires-url webpage-requires-accessed webpage-container-or-publisher",
    "patent": "patent-requires-number patent-requires-authority",
    "legislation": "legislation-requires-number",
    "legal_case": "legal-case-requires-authority",
    "dataset": "dataset-requires-url-or-doi dataset-requires-publisher gray-lit-url-recommended",
    "software": "software-requires-version software-requires-url-or-doi gray-lit-url-recommended",
    "standard": "standard-requires-number gray-lit-url-recommended",
    "broadcast": "broadcast-requires-publisher gray-lit-url-recommended",
    "manuscript": "manuscript-requires-genre gray-lit-url-recommended",
    "document": "",
}
_APA = {"article-journal": "apa-doi-recommended apa-volume-required", "report": "apa-report-number", "thesis": "apa-thesis-university apa-thesis-type", "webpage": "apa-webpage-retrieval", "dataset": "apa-dataset-brackets", "software": "apa-software-brackets"}


@case(
    "citation_id style rule_id",
    *[(t, s, r) for s, more in (("none", {}), ("apa-7th", _APA)) for t, rs in _BROKEN.items() for r in ["required-title", "required-author", *rs.split(), *more.get(t, "").split()]],
    *[("forms", "ieee", r) for r in "doi-format url-format year-range page-format ieee-abbreviated-journal".split()],
)
def all_rules(spark: SparkSession) -> DataFrame:
    """Every one of the rules is broken by some item."""
    as_of = date(2026, 1, 1)
    items = _items(spark, *[{"id": t, "type": t} for t in _BROKEN])
    forms = _items(spark, {"id": "forms", "type": "article-journal", "title": "T", "author": [{"family": "A"}], "issued": _date(1200), "DOI": "doi:x", "URL": "www.x.org", "page": "1–2", "container_title": "A Journal with a Very Long Name Indeed", "volume": "1"})
    out = None
    for d, style in ((items, None), (items, "apa-7th"), (forms, "ieee")):
        r = rules.validate(d, style, as_of).select("citation_id", F.lit(style or "none").alias("style"), "rule_id")
        out = r if out is None else out.union(r)
    return out


# Text and identifiers


@case("n kind cleaned", (0, "doi", "10.1234/AbC"), (1, "doi", "10.1234/abc"), (2, "pmid", "31978945"), (3, "pmcid", "PMC123"), (4, "url", "https://a.org/x"), (5, "unknown", "some words"))
def identifier_cleaning(spark: SparkSession) -> DataFrame:
    d = _rows(spark, "n long, c string", (0, "10.1234/AbC"), (1, "10.1234/abc"), (2, "31978945"), (3, "PMC123"), (4, "https://a.org/x"), (5, "some words"))
    return d.select("n", I.identifier_type(F.col("c")).alias("kind"), I.clean_identifier(F.col("c")).alias("cleaned"))


@case("n page quoted collapsed", (0, "12-15", True, "a b"), (1, "7", False, "c"), (2, None, None, None))
def text_forms(spark: SparkSession) -> DataFrame:
    d = _rows(spark, "n long, page string, source string, quote string, loose string", (0, "12–15", "the cat  sat down", "cat sat", " a  b "), (1, "7", "the cat", "dog", "c"), (2, None, None, None, None))
    return d.select("n", X.page_range(F.col("page")).alias("page"), X.quotes(F.col("source"), F.col("quote")).alias("quoted"), X.collapse(F.col("loose")).alias("collapsed"))


# Manuscripts

_MS = "Intro text [1].\n\nReferences\n[1] Smith J. First. 2020.\n[2] Roe R. Second. 2021."


@case("body entries first_entry", ("Intro text [1].\n", 2, "[1] Smith J. First. 2020."))
def split_references(spark: SparkSession) -> DataFrame:
    d = _rows(spark, "t string", (_MS,)).select(manuscript.split_references(F.col("t")).alias("s"))
    e = manuscript.entries(F.col("s.references"))
    return d.select("s.body", F.size(e).cast("long").alias("entries"), F.get(e, 0).alias("first_entry"))


@case("line", ("Regulation (EU) 2024/1689 on artificial intelligence",), ("Another line",))
def statute_lines(spark: SparkSession) -> DataFrame:
    d = _rows(spark, "src string, n long, line string", ("a", 1, "Regulation (EU) 2024"), ("a", 2, "/1689 on artificial intelligence"), ("a", 3, "Another line"))
    return manuscript.merge_statute_lines(d, "src", "n", "line").select("line")


@case("page start_at end_at", (1, 0, 3), (2, 4, 9), (3, 10, 10))
def page_offsets(spark: SparkSession) -> DataFrame:
    d = _rows(spark, "ms string, page long, text string", ("m", 1, "abc"), ("m", 2, "defgh"), ("m", 3, ""))
    return manuscript.page_offsets(d, "ms", "page", "text").select("page", F.col("start").alias("start_at"), F.col("end").alias("end_at"))


@case("page text source", (1, "sure text", "ocr"), (2, "embedded", "embedded"), (3, "12 34", "ocr"), (4, "only embedded", "embedded"))
def ocr_merge(spark: SparkSession) -> DataFrame:
    ocr = _rows(spark, "page long, ocr_text string, ocr_conf double", (1, "sure text", 90.0), (2, "unsure", 50.0), (3, "12 34", 99.0))
    emb = _rows(spark, "page long, embedded_text string", (1, "other"), (2, "embedded"), (3, " "), (4, "only embedded"))
    return manuscript.merge_pages(ocr, emb, ["page"])


@case("missing inversions", ("discussion", ""), ("", "methods before introduction"))
def structure_check(spark: SparkSession) -> DataFrame:
    d = _rows(spark, "t string", ("Introduction\nx\nMethods\ny\nResults\nz",), ("Methods\nIntroduction\nResults\nDiscussion",))
    s = manuscript.structure(F.col("t"))
    return d.select(F.array_join(s["missing"], ",").alias("missing"), F.array_join(s["inversions"], ",").alias("inversions"))


@case("kind raw numbers families year suffix", ("numeric", "[1-3, 7]", "1,2,3,7", "", None, None), ("author-year", "(Smith, 2020a, p. 12)", "", "smith", 2020, "a"))
def citation_forms(spark: SparkSession) -> DataFrame:
    d = _rows(spark, "ms string, t string", ("a", "Foo [1-3, 7] bar."), ("b", "So (Smith, 2020a, p. 12)."))
    s = manuscript.in_text(d, "ms", "t")
    return s.select("kind", "raw", F.array_join(F.transform("numbers", lambda n: n.cast("string")), ",").alias("numbers"), F.array_join("families", ",").alias("families"), F.col("year").cast("long").alias("year"), "suffix")


# Resolution

_Q = {"type": "article-journal", "title": "Deep learning for birds", "author": [{"family": "Smith", "given": "J"}], "issued": _date(2020), "DOI": "10.1/a", "original": "Smith J. Deep learning for birds. J Birds. 2020"}


@case("query_id ord confidence rank", ("q", 1, 1.0, 1), ("q", 0, 0.84, 2), ("q", 3, 0.62, 3))
def candidate_rank_top12(spark: SparkSession) -> DataFrame:
    """Title 0.62, same DOI 0.2, same year 0.1, author 0.08, type 0.04; copies and candidates below 0.42 go."""
    found = resolve.candidates(
        _pairs(
            spark,
            ("q", _Q, {**_Q, "DOI": "10.1/b"}),
            ("q", _Q, dict(_Q)),
            ("q", _Q, {**_Q, "DOI": "10.1/B"}),
            ("q", _Q, {"title": "Deep learning for birds", "URL": "u"}),
            ("q", _Q, {"title": "Cats", "URL": "v"}),
        )
    )
    return found.select("query_id", "ord", F.col("confidence").cast("double").alias("confidence"), F.col("rank").cast("long").alias("rank"))


@case("query_id ord", ("near", 1), ("far", 4))
def best_registry_match(spark: SparkSession) -> DataFrame:
    """0.6 is enough with a near year or a family name, 0.85 without."""
    q = {"title": "a study of birds", "issued": _date(2020), "author": [{"family": "Smith"}]}
    p = _pairs(spark, ("near", q, {"title": "cats"}), ("near", q, {"title": "a study of bards", "issued": _date(2021)}), ("near", q, {"title": "a study on bards", "issued": _date(2020)}), ("far", q, {"title": "a study of", "issued": _date(1990)}), ("far", q, {"title": "a study of birds", "issued": _date(1990)}))
    return resolve.best_match(p).select("query_id", "ord")


@case("query_id ord", ("ok", 0))
def first_then_gate(spark: SparkSession) -> DataFrame:
    """The best title is in the wrong year for the second query, and the next isn't tried."""
    q = {"title": "a study of birds", "issued": _date(2020), "author": [{"family": "Smith"}]}
    p = _pairs(spark, ("ok", q, {"title": "A study of birds.", "issued": _date(2021)}), ("no", q, {"title": "a study of birds", "issued": _date(2000)}), ("no", q, {"title": "a study of bards", "issued": _date(2020)}))
    return resolve.top_then_gate(p).select("query_id", "ord")


@case("id stage match", ("a", "doi", "m1"), ("b", "title", "m2"), ("c", "unresolved", None))
def resolution_cascade(spark: SparkSession) -> DataFrame:
    items = _rows(spark, "id string, DOI string, title string", ("a", "d1", "t1"), ("b", "d2", "t2"), ("c", "d3", "t3"))
    by_doi, by_title = _rows(spark, "DOI string, match string", ("d1", "m1")), _rows(spark, "title string, match string", ("t1", "m9"), ("t2", "m2"))
    return resolve.cascade(items, [("doi", by_doi, ["DOI"]), ("title", by_title, ["title"])]).select("id", "stage", "match")


@case("n title_bad authors_bad", (0, False, False), (1, True, False), (2, True, False), (3, True, False), (4, False, True), (5, False, True), (6, True, False))
def implausible_metadata(spark: SparkSession) -> DataFrame:
    rows = [("A study of birds", []), ("()", []), ("Short", []), ("A. B. et al.", []), ("A study of birds", [{"given": "Cohort analysis"}]), ("Mechanisms of injury", [{"family": "Injury"}]), (None, [{"family": "Smith", "given": "J"}])]
    i = _items(spark, *[{"id": str(n), "title": t, "author": a} for n, (t, a) in enumerate(rows)])
    return i.select(F.col("ord").alias("n"), resolve.implausible_title(F.col("title")).alias("title_bad"), resolve.implausible_authors(F.col("author"), F.col("title")).alias("authors_bad"))


@case("query_id fits", ("same", True), ("other", False), ("blank", True), ("placeholder", True), ("short", True))
def identity_gate(spark: SparkSession) -> DataFrame:
    p = _pairs(
        spark,
        ("same", {"title": "Deep learning for birds"}, {"title": "Deep learning for all birds"}),
        ("other", {"title": "Deep learning for birds"}, {"title": "Cooking with cats at home"}),
        ("blank", {"title": " "}, {"title": "Cooking with cats"}),
        ("placeholder", {"title": "(?)"}, {"title": "Cooking with cats"}),
        ("short", {"title": "Bird review paper", "author": [{"given": "review of birds"}]}, {"title": "Cooking with cats"}),
    )
    return p.select("query_id", resolve.identity_compatible().alias("fits"))


@case("query_id ord score", ("q", 2, 1.0))
def doi_by_title(spark: SparkSession) -> DataFrame:
    q = {"title": "Deep learning for birds", "issued": _date(2020)}
    p = _pairs(spark, ("q", q, {"title": "Deep learning for birds"}), ("q", q, {"title": "Deep learning for birds", "DOI": "10.1/x", "issued": _date(2010)}), ("q", q, {"title": "Deep Learning for Birds.", "DOI": "10.1/y", "issued": _date(2021)}), ("q", q, {"title": "Deep learning for birds", "DOI": "10.1/z"}), ("none", q, {"title": "Cats", "DOI": "10.1/w"}))
    return resolve.doi_by_title(p).select("query_id", "ord", "score")


@case("query_id ord", ("strong", 0), ("named", 2))
def raw_line_match(spark: SparkSession) -> DataFrame:
    """All title words; half of them and the author; the right words in the wrong year; another author."""
    line = {"original": "Smith J. Deep learning for birds. J Birds. 2020", "issued": _date(2020), "author": [{"family": "Smith"}]}
    p = _pairs(
        spark,
        ("strong", line, {"title": "Deep learning for birds", "issued": _date(2021), "author": [{"family": "Smith"}]}),
        ("strong", line, {"title": "Cats"}),
        ("named", line, {"title": "Deep learning with cats", "author": [{"family": "Smith"}]}),
        ("unnamed", line, {"title": "Deep learning with cats"}),
        ("year", line, {"title": "Deep learning for birds", "issued": _date(1990)}),
        ("author", line, {"title": "Deep learning for birds", "author": [{"family": "Jones"}]}),
    )
    return resolve.raw_line_match(p).select("query_id", "ord")


@case("n same", (0, True), (1, True), (2, True), (3, False), (4, False))
def same_family(spark: SparkSession) -> DataFrame:
    d = _rows(spark, "n long, a string, b string", (0, "Smith JA", "smith"), (1, "Al Serouri", "Al-Serouri"), (2, "Berg van", "Berg"), (3, "Smith", "Jones"), (4, "", "Jones"))
    return d.select("n", resolve.same_family(F.col("a"), F.col("b")).alias("same"))


# Grounding and reports

_ANSWER = '{"claims": [{"claim": "Birds fly at 20 km", "verdict": "supported", "hasNumericClaim": true, "sourceQuotes": ["birds fly at 20 km"], "rationale": ["seen"]}, {"claim": "Cats swim 5 m", "verdict": "supported", "hasNumericClaim": true, "sourceQuotes": ["cats swim 9 m"], "rationale": [" seen ", "read"]}, {"claim": "Dogs bark", "verdict": "supported", "sourceQuotes": ["dogs sing"], "rationale": []}]}'
_SOURCE = "We saw that birds fly at 20 km and cats swim 9 m."


def _guarded(spark: SparkSession) -> DataFrame:
    raw = [_ANSWER, "```json\n" + _ANSWER[:-1] + ",}\n```", "no answer"]
    d = _rows(spark, "bib string, ord long, raw string", *[(f"b{n}", n, r) for n, r in enumerate(raw)])
    return d.select("bib", "ord", grounding.guard(grounding.parse_claims(F.col("raw"))["claims"], F.lit(_SOURCE)).alias("claims"))


@case("bib verdicts passage", ("b0", "supported,contradicted,weak", "fail"), ("b1", "supported,contradicted,weak", "fail"), ("b2", None, "insufficient"))
def claim_guards(spark: SparkSession) -> DataFrame:
    return _guarded(spark).select("bib", F.array_join(F.transform("claims", lambda c: c["verdict"]), ",").alias("verdicts"), grounding.passage_verdict(F.col("claims"), F.lit("high")).alias("passage"))


@case("bib supported weak contradicted invalid_quotes audited top_rationale", ("b0", 1, 1, 1, 1, 3, "seen|read"), ("b1", 1, 1, 1, 1, 3, "seen|read"))
def claim_breakdown(spark: SparkSession) -> DataFrame:
    b = grounding.claim_breakdown(_guarded(spark), "bib")
    return b.select("bib", "supported", "weak", "contradicted", "invalid_quotes", "audited", F.array_join("top_rationale", "|").alias("top_rationale"))


_FOUND = [("r1", "high"), ("r2", "medium"), ("r3", "high"), ("r4", "high"), ("r5", "high")]


@case(
    "n verdict reasons",
    (0, "pass", ""),
    (1, "warn", "Potential adversarial content in source text: r1 (high)"),
    (2, "fail", "old|Potential adversarial content in source text: r1 (high), r2 (medium), r3 (high), r4 (high) and 1 more"),
    (3, "insufficient", "old"),
)
def injection_guard(spark: SparkSession) -> DataFrame:
    d = _rows(spark, "n long, v string, r array<string>, f array<struct<rule:string,severity:string>>", (0, "pass", [], []), (1, "pass", [], _FOUND[:1]), (2, "fail", ["old"], _FOUND), (3, "insufficient", ["old"], _FOUND))
    g = grounding.injection_guard(F.col("v"), F.col("r"), F.col("f"))
    return d.select("n", g["verdict"].alias("verdict"), F.array_join(g["reasons"], "|").alias("reasons"))


@case("k kind capped", ("a", "pmc", False), ("b", "abstract", True))
def source_choice(spark: SparkSession) -> DataFrame:
    d = _rows(spark, "k string, ord long, kind string, text string", ("a", 1, "oa_pdf", "x"), ("a", 2, "pmc", "y"), ("a", 3, "attached", " "), ("b", 1, "abstract", "z"), ("c", 1, "pmc", None))
    return grounding.choose_source(d, "k").select("k", "kind", "capped")


@case("id status", ("a", "ready"), ("b", "changed"), ("c", "missing"), ("d", "missing"))
def artifact_cache(spark: SparkSession) -> DataFrame:
    d = _rows(spark, "id string, content string", ("a", "x"), ("b", "y"), ("c", None), ("d", "z"))
    sha = F.when(F.col("id") == "b", "old").otherwise(F.sha2("content", 256))
    d = d.withColumn("sha256", sha)
    return report.cache_status(d, d.filter("id IN ('a', 'b')").select(F.sha2("content", 256).alias("sha256")))


@case("id chars actions", ("a", 5, "Resolve contradicted citations|Check quotes that are not in the source"), ("b", 3, ""))
def report_actions(spark: SparkSession) -> DataFrame:
    d = _rows(spark, "id string, text string, failures long, unmatched long, invalid_quotes long, warnings long", ("a", "hello", 2, 0, 1, 0), ("b", "abc", 0, 0, 0, 0))
    return report.next_actions(d).select("id", report.redact(F.col("text"))["chars"].cast("long").alias("chars"), F.array_join("actions", "|").alias("actions"))


@case("n id", (1, "s1"), (1, "s2"), (1, "p1"))
def run_history(spark: SparkSession) -> DataFrame:
    """Runs of the session first; one that was persisted as well counts once."""
    s = _rows(spark, "ord long, id string, generated_at string, app_version string", (1, "s1", "2026-01-02", "1"), (2, "s2", "2026-01-01", "1"), (3, "s3", "2026-01-02", "1"))
    p = _rows(spark, "ord long, id string, generated_at string, app_version string", (1, "p0", "2026-01-01", "1"), (2, "p1", "2026-01-01", "2"))
    return display.merge_runs(s, p).select(F.lit(1).cast("long").alias("n"), "id")


@case("n tags", (0, "thesis"), (1, "report,preprint"), (2, "post"), (3, "other"), (4, "preprint"), (5, ""))
def grey_tag_kinds(spark: SparkSession) -> DataFrame:
    rows = [("thesis", None), ("report", "arXiv e-prints"), ("post-weblog", ""), ("document", None), ("document", "Research Square"), ("book", "Letters")]
    i = _items(spark, *[{"id": str(n), "type": t, "container_title": c} for n, (t, c) in enumerate(rows)])
    return i.select(F.col("ord").alias("n"), F.array_join(display.grey_tags(), ",").alias("tags"))


@case("q id", ("smith", "a"), ("10.1/b", "b"), ("letters", "b"), ("sixth", "x"), ("all", "a"), ("all", "b"))
def search_fields(spark: SparkSession) -> DataFrame:
    """The sixth author isn't searched."""
    i = _items(spark, {"id": "a", "title": "Birds", "author": [{"family": "Smith", "given": "J"}, *[{"literal": f"A{n}"} for n in range(4)], {"family": "Sixth"}]}, {"id": "b", "DOI": "10.1/B", "container_title": "LETTERS"})
    out = _rows(spark, "q string, id string", ("sixth", "x"))
    for q, name in (("SMITH j", "smith"), (" 10.1/b", "10.1/b"), ("letters", "letters"), ("sixth", "sixth"), ("", "all")):
        out = out.union(display.display(i, "all", query=q).select(F.lit(name).alias("q"), "id"))
    return out


@case("id abbreviation_style", ("1", "apa-7th"), ("2", "ieee"))
def style_of_lines(spark: SparkSession) -> DataFrame:
    d = _rows(spark, "id string, line string", ("1", "Smith, J. (2020). A study of AI. Journal of Things, 12(3), 45-67. https://doi.org/10.1234/x"), ("2", '[1] J. Smith, "A study of AI," IEEE Trans. Comput., vol. 45, no. 2, pp. 123-130, 2020.'))
    s = styles.detect(d).filter("style IN ('apa-7th', 'ieee')")
    return s.select("id", F.col("style").alias("abbreviation_style"))


@case("status risk", ("fail", "high"), ("warn", "medium"), ("pass", "low"))
def integrity_levels(spark: SparkSession) -> DataFrame:
    return _rows(spark, "status string", ("fail",), ("warn",), ("pass",)).select("status", verify.integrity_risk(F.col("status")).alias("risk"))


@case("n valid", (0, False))
def list_validation(spark: SparkSession) -> DataFrame:
    d = _rows(spark, "ord long, name string, aliases array<string>, issn array<string>, reason string", (0, "One", [], [], "r"))
    return listings.validate_list(d).select(F.lit(0).cast("long").alias("n"), F.col("ok").alias("valid"))


# Registries, paged files and searches

_DATACITE = [
    {"doi": "10.5281/z.1", "url": "u", "titles": [{"title": "Bird Data"}], "creators": [{"name": "Doe, Jane", "familyName": "Doe", "givenName": "Jane"}, {"name": "Bird Lab", "nameType": "Organizational"}], "publisher": {"name": "Archive"}, "publicationYear": 2022, "types": {"resourceTypeGeneral": "Dataset"}, "container": {"title": "Series", "volume": "", "firstPage": "3", "lastPage": "9"}},
    {"doi": "10.5281/z.2", "titles": [{"title": "Draft"}], "creators": [{"name": "Lab"}], "publisher": "Plain", "types": {"resourceTypeGeneral": "Text", "resourceType": "Pre-print"}, "container": {"firstPage": "7"}},
    {"doi": "10.5281/z.3", "types": {"resourceTypeGeneral": "Unheard"}},
]


@case(
    _FIELDS + " publisher genre",
    ("datacite-10-5281-z-1", "dataset", "Bird Data", "Series", None, "3-9", "10.5281/z.1", 2022, "Doe", 2, "Archive", None),
    ("datacite-10-5281-z-2", "article", "Draft", None, None, "7", "10.5281/z.2", None, "Lab", 1, "Plain", "Pre-print"),
    ("datacite-10-5281-z-3", "document", None, None, None, None, "10.5281/z.3", None, None, 0, None, None),
)
def from_datacite(spark: SparkSession) -> DataFrame:
    bodies = [json.dumps({"data": {"attributes": a}}) for a in _DATACITE]
    i = registries.from_datacite(_rows(spark, "body string", *[(b,) for b in [*bodies, "no JSON", '{"data": null}']]))
    return _fields(i).join(i.select("id", "publisher", "genre"), "id").withColumn("authors", F.greatest("authors", F.lit(0).cast("long")))


_PUBMED = {"title": "Birds at night", "authors": [{"name": "Van Berg JA"}, {"name": "Roe"}], "sortpubdate": "2019/05/01 00:00", "pubdate": "2018", "fulljournalname": "", "source": "J Birds", "volume": "", "pages": "4-6", "elocationid": "doi: 10.1234/night.", "articleids": [{"idtype": "pmc", "value": "PMC77"}]}


@case(_FIELDS + " PMID PMCID given", ("pmid-55", "article-journal", "Birds at night", "J Birds", None, "4-6", "10.1234/night", 2019, "Van", 2, "55", "PMC77", "Berg JA"))
def from_pubmed(spark: SparkSession) -> DataFrame:
    body = json.dumps({"result": {"uids": ["55"], "55": _PUBMED, "56": {"error": "none"}}})
    i = registries.from_pubmed(_rows(spark, "pmid string, body string", ("PMID: 55", body), ("56", body), ("57", body), ("58", None)))
    return _fields(i).join(i.select("id", "PMID", "PMCID", F.get("author", 0)["given"].alias("given")), "id")


_OPENALEX = [
    {"id": "https://openalex.org/W1", "doi": "https://doi.org/10.9/W", "type": "posted-content", "title": None, "display_name": "Shown", "authorships": [{"author": {"display_name": "Jane Q Doe"}}, {"author": {"display_name": "Group"}}], "publication_year": 2020, "abstract_inverted_index": {"fly": [1], "Birds": [0]}, "primary_location": {"landing_page_url": None, "source": {"display_name": "Letters", "issn_l": "1-2", "host_organization_name": "Host"}}, "open_access": {"oa_url": "oa"}, "biblio": {"volume": "4", "first_page": "1", "last_page": None}, "ids": {"pmid": "https://pubmed.ncbi.nlm.nih.gov/99"}},
    {"id": "https://openalex.org/W2", "title": "Bare"},
]


@case(
    _FIELDS + " URL publisher abstract PMID",
    ("openalex-W1", "article", "Shown", "Letters", "4", "1", "10.9/W", 2020, "Doe", 2, "oa", "Host", "Birds fly", "99"),
    ("openalex-W2", "article-journal", "Bare", None, None, None, None, None, None, 0, None, None, None, None),
)
def from_openalex(spark: SparkSession) -> DataFrame:
    i = registries.from_openalex(_rows(spark, "body string", *[(json.dumps(w),) for w in _OPENALEX], ("{",)))
    return _fields(i).join(i.select("id", "URL", "publisher", "abstract", "PMID"), "id").withColumn("authors", F.greatest("authors", F.lit(0).cast("long")))


@case("id title first_author given year publisher", ("isbn-97", "The Bird Book", "Poe", "Edgar Allan", 1999, "House"))
def from_openlibrary(spark: SparkSession) -> DataFrame:
    book = {"title": "The Bird Book", "authors": [{"name": "Edgar Allan Poe"}], "publish_date": "May 1999", "publishers": [{"name": "House"}]}
    i = registries.from_openlibrary(_rows(spark, "isbn string, body string", ("97", json.dumps({"ISBN:97": book})), ("98", "{}")))
    a = F.get("author", 0)
    return i.select("id", "title", a["family"].alias("first_author"), a["given"].alias("given"), year_of(F.col("issued")).cast("long").alias("year"), "publisher")


@case("k page start_at end_at content", ("a", 1, 3, 6, "one"), ("a", 2, 6, 9, "two"), ("b", 1, 0, 5, "plain"), ("d", 4, 0, 0, ""))
def page_markers(spark: SparkSession) -> DataFrame:
    d = _rows(spark, "k string, t string", ("a", "pre<!-- Page 1 -->one<!--page 2-->two"), ("b", " plain\n"), ("c", None), ("d", "<!-- Page 4 -->"))
    p = pages.page_spans(d, "k", "t")
    return p.select("k", F.col("page").cast("long").alias("page"), F.col("start").alias("start_at"), F.col("end").alias("end_at"), "content")


@case(
    "n mode tier text",
    *[(0, m, "embedded", "good") for m in ("auto", "embedded_only", "ocr_preferred")],
    *[(1, m, t, x) for m, t, x in (("auto", "ocr", "seen"), ("embedded_only", "embedded", "thin"), ("ocr_preferred", "ocr", "seen"))],
    *[(2, m, t, "arabic") for m, t in (("auto", "deferred"), ("embedded_only", "embedded"), ("ocr_preferred", "deferred"))],
    *[(3, m, t, x) for m, t, x in (("auto", "embedded", "thin"), ("embedded_only", "embedded", "thin"), ("ocr_preferred", None, None))],
    *[(4, m, t, x) for m, t, x in (("auto", "ocr", "seen"), ("embedded_only", None, None), ("ocr_preferred", "ocr", "seen"))],
)
def pdf_tiers(spark: SparkSession) -> DataFrame:
    """Good, thin with recognised text, Arabic, thin without, and unreadable but recognised."""
    d = _rows(spark, "n long, embedded_text string, needs_review boolean, arabic boolean, ocr_text string", (0, "good", False, False, "seen"), (1, "thin", True, False, "seen"), (2, "arabic", True, True, "seen"), (3, "thin", True, False, None), (4, None, None, None, "seen"))
    out = None
    for mode in ("auto", "embedded_only", "ocr_preferred"):
        t = pages.pdf_text(mode)
        r = d.select("n", F.lit(mode).alias("mode"), t["tier"].alias("tier"), t["text"].alias("text"))
        out = r if out is None else out.union(r)
    return out


def _docx(*paragraphs: tuple[str, str | None]) -> bytes:
    w = "http://schemas.openxmlformats.org/wordprocessingml/2006/main"
    body = "".join(f"<w:p>{f'<w:pPr><w:pStyle w:val={chr(34)}{s}{chr(34)}/></w:pPr>' if s else ''}<w:r><w:t>{t}</w:t></w:r></w:p>" for t, s in paragraphs)
    out = BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("word/document.xml", f'<w:document xmlns:w="{w}"><w:body>{body}</w:body></w:document>')
    return out.getvalue()


@case("n text headings needs_review", (0, "Birds\n\nThey fly.\n\nNight", "1:Birds:0:5|2:Night:18:23", False), (1, None, None, True), (2, "", "", True))
def structured_docx(spark: SparkSession) -> DataFrame:
    d = _rows(spark, "n long, content binary", (0, _docx(("Birds", "Heading1"), ("They fly.", None), (" ", None), ("Night", "heading 2"))), (1, b"no DOCX"), (2, _docx()))
    show = F.transform("headings", lambda h: F.concat_ws(":", h["level"].cast("string"), h["title"], h["start"].cast("string"), h["end"].cast("string")))
    return pages.with_blocks(d).select("n", "text", F.when(F.col("headings").isNotNull(), F.array_join(show, "|")).alias("headings"), "needs_review")


_JOURNALS = [(0, "Journal of Birds", "J Birds", "s0"), (1, "Birds", None, "s1"), (2, "Letters", "Bird Lett", "s2")]


@case("q found", ("journal bird", 3), ("journal b", 0), ("style", 2), ("style all", 30 - 5), ("exact", 1), ("partial", 0), ("abbr", 2))
def list_searches(spark: SparkSession) -> DataFrame:
    """Counts of rows that searches find, and the number of the style that a journal's name leads to."""
    j = _rows(spark, "ord long, name string, abbr string, style_id string", *_JOURNALS)
    s = _rows(spark, "ord long, id string, name string", *[(n, f"id{n}", "APA 7" if n < 2 else "Other") for n in range(30)])
    out = None
    for q, d in (("journal bird", listings.search_journals(j, " BIRD")), ("journal b", listings.search_journals(j, "b")), ("style", listings.search_styles(s, "apa")), ("style all", listings.search_styles(s, " "))):
        r = d.groupBy().agg(F.count("*").alias("found")).select(F.lit(q).alias("q"), "found")
        out = r if out is None else out.union(r)
    for q, name in (("exact", "BIRDS"), ("partial", "of birds"), ("abbr", "bird lett"), ("none", "cats")):
        out = out.union(listings.style_for_journal(j, name).select(F.lit(q).alias("q"), F.substring("style_id", 2, 9).cast("long").alias("found")))
    return out


@case("entries bytes", (2, 30))
def cache_contents(spark: SparkSession) -> DataFrame:
    return report.cache_info(_rows(spark, "name string, length long", ("a" * 64 + ".json", 10), ("0" * 64 + ".json", 20), ("a" * 63 + ".json", 40), ("A" * 64 + ".json", 80)))


_TAGGED = """<html><head><title> Plain
title</title><meta name="citation_title" content="First"><META content="Tagged Title" name="citation_title"/><meta name="citation_author" content="Doe, Jane">
<meta name="author" content="doe, jane"><meta name="author" content="John Q Roe"><meta property="og:site_name" content="Site"><meta name="citation_journal_title" content="J Birds">
<meta name="citation_doi" content="https://doi.org/10.1234/tag"><meta name="citation_firstpage" content="3"><meta name="citation_lastpage" content="8"><meta name="date" content="May 2017"></head></html>"""


@case(_FIELDS, ("u1", "article-journal", "Tagged Title", "J Birds", None, "3-8", "10.1234/tag", 2017, "Doe", 2), ("u2", "webpage", "Only a title", None, None, None, None, None, None, 0), ("u4", "webpage", None, None, None, None, None, None, None, 0))
def page_metadata(spark: SparkSession) -> DataFrame:
    i = registries.from_pages(_rows(spark, "url string, html string", ("u1", _TAGGED), ("u2", "<title>Only a title</title>"), ("u3", None), ("u4", "")))
    return _fields(i).withColumn("authors", F.greatest("authors", F.lit(0).cast("long")))
