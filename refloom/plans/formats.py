"""Queries of readers and writers over the driver tables: documents go out in a format and are read back, pages give their tags."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.places import let
from ..operators import manuscript
from ..schema import as_items, year_of
from ..sources import layout, readers, registries, writers

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(sql: str):
    def add(f):
        QUERIES[f.__name__] = f
        ORACLES[f.__name__] = sql
        return f

    return add


def _t(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as items of two types, with two authors, a year, a volume and for two of three a DOI; titles are their words of letters."""
    d, i = _t(spark, sf_dir, "documents").filter("doc_id IS NOT NULL"), F.col("doc_id")
    name = "named_struct('family', {0}, 'given', {1}, 'dropping_particle', CAST(NULL AS string), 'non_dropping_particle', CAST(NULL AS string), 'suffix', CAST(NULL AS string), 'literal', CAST(NULL AS string))"
    date = "named_struct('date_parts', array(array({0})), 'season', CAST(NULL AS string), 'circa', CAST(NULL AS boolean), 'literal', CAST(NULL AS string), 'raw', CAST(NULL AS string))"
    title = F.trim(F.regexp_replace(F.left("text", F.lit(200)), r"[^A-Za-z]+", " "))
    kind = F.when(F.pmod(i, F.lit(2)) == 0, "article-journal").otherwise("book")
    doi = F.when(F.pmod(i, F.lit(3)) > 0, F.concat(F.lit("10.1234/"), i.cast("string")))
    authors = F.expr(f"array({name.format(chr(39) + 'Smith' + chr(39), chr(39) + 'Ann' + chr(39))}, {name.format('concat(chr(65 + CAST(doc_id % 26 AS int)), ' + chr(39) + 'oe' + chr(39) + ')', chr(39) + 'Jo' + chr(39))})")
    return as_items(
        d.select(
            i.alias("ord"), F.concat(F.lit("d"), i.cast("string")).alias("id"), kind.alias("type"), F.concat(F.lit("On "), title).alias("title"), authors.alias("author"),
            F.expr(date.format("CAST(1950 + doc_id % 70 AS int)")).alias("issued"), F.when(F.pmod(i, F.lit(2)) == 0, F.concat(F.lit("Letters of "), "source")).alias("container_title"), (i % 90 + 1).cast("string").alias("volume"), doi.alias("DOI"),
        )
    )


_BACK = """SELECT 'd' || doc_id AS id, CASE WHEN doc_id % 2 = 0 THEN 'article-journal' ELSE 'book' END AS type, trim('On ' || trim(regexp_replace(left(text, 200), '[^A-Za-z]+', ' ', 'g'))) AS title, CASE WHEN doc_id % 2 = 0 THEN 'Letters of ' || source END AS container_title,
(doc_id % 90 + 1)::VARCHAR AS volume, CASE WHEN doc_id % 3 > 0 THEN '10.1234/' || doc_id END AS doi, (1950 + doc_id % 70)::INT AS year, 'Smith|' || chr((65 + doc_id % 26)::INT) || 'oe' AS families FROM documents WHERE doc_id IS NOT NULL"""


def _read_back(items: DataFrame, prefix: str = "") -> DataFrame:
    i = F.col("id") if not prefix else F.regexp_replace("id", prefix, "")
    return items.select(i.alias("id"), "type", F.trim("title").alias("title"), "container_title", "volume", F.col("DOI").alias("doi"), year_of(F.col("issued")).alias("year"), F.array_join(F.transform("author", lambda a: F.coalesce(a["family"], a["literal"])), "|").alias("families"))


@query(_BACK)
def ris_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = writers.ris(_items(spark, sf_dir)).select(F.lit("").alias("src"), F.concat("ris", F.lit("\nER  - \n")).alias("raw"))
    return _read_back(readers.read_ris(out)[0], "^-")


@query(_BACK)
def bibtex_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = writers.bibtex(_items(spark, sf_dir)).select(F.col("id").alias("src"), F.col("bibtex").alias("raw"))
    return _read_back(readers.read_bibtex(out)[0])


@query(_BACK)
def csl_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = writers.csl_json(_items(spark, sf_dir)).select(F.col("id").alias("src"), F.col("json").alias("raw"))
    return _read_back(readers.read_csl_json(out)[0])


@query("SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN 'bibtex' WHEN 1 THEN 'ris' WHEN 2 THEN 'csl-json' ELSE 'plain-text' END AS format FROM documents WHERE doc_id IS NOT NULL AND NOT regexp_matches(text, '^\\s*[@{[]|(^|\\n)TY  ?-')")
def sniffed_formats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What documents written in four forms look like; those whose own text begins like a format are left to the case tests."""
    i = _items(spark, sf_dir)
    texts = _t(spark, sf_dir, "documents").filter(F.col("doc_id").isNotNull() & ~F.col("text").rlike(r"^\s*[@{\[]|(^|\n)TY  ?-")).select("doc_id", F.concat(F.lit("d"), F.col("doc_id").cast("string")).alias("id"), "text")
    each = texts.join(writers.bibtex(i), "id").join(writers.ris(i), "id").join(writers.csl_json(i), "id")
    k = F.pmod("doc_id", F.lit(4))
    return each.select("doc_id", readers.sniff(F.when(k == 0, F.col("bibtex")).when(k == 1, F.col("ris")).when(k == 2, F.col("json")).otherwise(F.col("text"))).alias("format"))


_META = """(?i)<meta\\s+(?:name|property)=["''][^"'']+["'']\\s+content=["''][^"'']*["'']"""
_META_TURNED = """(?i)<meta\\s+content=["''][^"'']*["'']\\s+(?:name|property)=["''][^"'']+["'']"""


@query(
    f"""WITH h AS (SELECT page_id, html || '<meta name="citation_title" content="T ' || page_id || '"><META content="Site" property=''og:site_name''>' || CASE page_id % 3 WHEN 0 THEN '<meta name=''author'' content=''A, B''><meta name=broken content=x>' ELSE '' END AS html FROM pages),
m AS (SELECT page_id, unnest(list_concat(regexp_extract_all(html, '{_META}'), regexp_extract_all(html, '{_META_TURNED}'))) AS tag FROM h)
SELECT page_id, lower(regexp_extract(tag, '(?i)(?:name|property)=["'']([^"'']+)', 1)) AS name, regexp_extract(tag, '(?i)\\scontent=["'']([^"'']*)', 1) AS content FROM m"""
)
def page_meta_tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The meta tags of pages, with some planted."""
    more = F.when(F.pmod("page_id", F.lit(3)) == 0, "<meta name='author' content='A, B'><meta name=broken content=x>").otherwise("")
    title = F.concat(F.lit('<meta name="citation_title" content="T '), F.col("page_id").cast("string"), F.lit('">'))
    html = F.concat("html", title, F.lit("<META content=\"Site\" property='og:site_name'>"), more)
    return _t(spark, sf_dir, "pages").select("page_id", F.explode(registries.meta_tags(html)).alias("m")).select("page_id", "m.*")


@query(
    """WITH p AS (SELECT doc_id, unnest(range(0, len(string_split(text, chr(10))))) + 1 AS page, unnest(string_split(text, chr(10))) AS t FROM documents WHERE doc_id IS NOT NULL)
SELECT doc_id, page, (sum(length(t) + 2) OVER w - 2 - length(t))::BIGINT AS start, (sum(length(t) + 2) OVER w - 2)::BIGINT AS "end" FROM p WINDOW w AS (PARTITION BY doc_id ORDER BY page)"""
)
def line_offsets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines as pages, joined by two characters."""
    d = _t(spark, sf_dir, "documents").filter("doc_id IS NOT NULL").select("doc_id", F.posexplode(F.split("text", "\n")).alias("page", "t"))
    return manuscript.page_offsets(d.withColumn("page", (F.col("page") + 1).cast("long")), "doc_id", "page", "t", 2).select("doc_id", "page", "start", "end")


_SECTIONS = ["Introduction", "Methods", "Results", "Discussion"]


@query(
    """WITH d AS (SELECT doc_id, text, [(doc_id + i) % 4 FOR i IN range(0, 4) IF (doc_id // 4 + i) % 5 > 0] AS k FROM documents WHERE doc_id IS NOT NULL AND NOT regexp_matches(text, '(?i)(^|\\n)(introduction|background|method|materials and|results|findings|discussion|conclusion)')),
n AS (SELECT doc_id, list_transform(range(0, 4), lambda s: coalesce(list_position(k, s), 0)) AS pos FROM d)
SELECT doc_id, array_to_string([['introduction', 'methods', 'results', 'discussion'][s + 1] FOR s IN range(0, 4) IF pos[s + 1] = 0], ',') AS missing,
(SELECT count(*) FROM (SELECT unnest(range(0, 16)) AS x) WHERE x // 4 < x % 4 AND pos[x // 4 + 1] > pos[x % 4 + 1] AND pos[x % 4 + 1] > 0) AS inversions FROM n"""
)
def section_structure(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with sections planted in turned order and some left out: what is missing, and how many pairs are inverted."""
    own = r"(?i)(^|\n)(introduction|background|method|materials and|results|findings|discussion|conclusion)"
    d, i = _t(spark, sf_dir, "documents").filter(F.col("doc_id").isNotNull() & ~F.col("text").rlike(own)), F.col("doc_id")
    heads = [F.when(F.pmod(F.floor(i / 4) + n, F.lit(5)) > 0, F.get(F.array(*map(F.lit, _SECTIONS)), F.pmod(i + n, F.lit(4)).cast("int"))) for n in range(4)]
    begin = F.regexp_replace(F.left("text", F.lit(300)), "\n", " ")
    t = let(begin, lambda b: F.array_join(F.transform(F.array_compact(F.array(*heads)), lambda h: F.concat(h, F.lit("\n"), b)), "\n"))
    return d.select("doc_id", manuscript.structure(t).alias("s")).select("doc_id", F.array_join("s.missing", ",").alias("missing"), F.size("s.inversions").cast("long").alias("inversions"))


def _glyphs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, page and runs of glyphs: 120 words a page, in two columns for every second document, rows a little uneven, each 13th word small."""
    d = _t(spark, sf_dir, "documents").filter("doc_id IS NOT NULL").select("doc_id", F.posexplode(F.split("text", r"\s+")).alias("p", "text"))
    d = d.withColumn("page", F.floor(F.col("p") / 120)).withColumn("j", F.pmod("p", F.lit(120)))
    two, half = F.pmod("doc_id", F.lit(2)) == 0, F.pmod("j", F.lit(60))
    row, col = F.when(two, F.floor(half / 3)).otherwise(F.floor(F.col("j") / 6)), F.when(two, F.floor(F.col("j") / 60)).otherwise(0)
    x = F.when(two, F.pmod(half, F.lit(3)) * 80 + col * 300).otherwise(F.pmod("j", F.lit(6)) * 90)
    small = F.pmod("p", F.lit(13)) == 12
    y = 700 - row * 12 + (F.pmod("j", F.lit(3)) - 1) * 0.75 - F.when(two & (col == 1), 5).otherwise(0)
    return d.select("doc_id", "page", (row * 12 + col * 6 + F.pmod("j", F.lit(6))).cast("long").alias("ord"), (x + 20.0).alias("x"), y.cast("double").alias("y"), F.when(small, 4.5).otherwise(10.0).alias("size"), F.when(small, F.concat("p", F.lit(","))).otherwise(F.col("text")).alias("text"))


def page_layout(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The lines of pages laid out from documents' words.  Lines grow by what was placed before: held against plain Python in the tests."""
    return layout.page_lines(_glyphs(spark, sf_dir), ["doc_id", "page"]).select("doc_id", "page", F.array_join("lines", "\n").alias("text"))


QUERIES["page_layout"] = page_layout
