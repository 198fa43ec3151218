"""Queries of text structure over documents, pages and conversations, with lists and citations planted into their texts by rule.

Their SQL works on rows of lines, sentences and matches, where the operators work on arrays inside a row.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import places as P
from ..operators import joins, listings, manuscript, segments
from ..sources import jsonld

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


_TITLE = "trim(regexp_replace(left(text, 30), '[^A-Za-z0-9]+', ' ', 'g'))"
_LIST = f"""array_to_string(list_transform(range(1, 4 + doc_id % 3), lambda i: (CASE doc_id % 4 WHEN 2 THEN '[' || i || '] ' ELSE i || '. ' END) || 'Miller, A. ' || {_TITLE} || '. ' || (1990 + i)
  || CASE WHEN i = 2 THEN chr(10) || '2025. More text, ' || {_TITLE} ELSE '' END), chr(10))"""
_PLANTED = f"""x AS (SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN text || chr(10) || 'References' || chr(10) || {_LIST} WHEN 1 THEN 'References' || chr(9) || '12' || chr(10) || text || chr(10) || {_LIST}
  WHEN 2 THEN text || chr(10) || '9. Bibliography:' || chr(10) || {_LIST} ELSE text END AS t FROM documents WHERE doc_id IS NOT NULL)"""


def _with_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, t: three of four documents with a list of references, under a heading, a numbered heading or none."""
    d, k = _t(spark, sf_dir, "documents").filter("doc_id IS NOT NULL"), F.pmod("doc_id", F.lit(4))
    title = F.trim(F.regexp_replace(F.left("text", F.lit(30)), "[^A-Za-z0-9]+", " "))
    mark = lambda i: F.when(k == 2, F.concat(F.lit("["), i, F.lit("] "))).otherwise(F.concat(i, F.lit(". ")))
    wrapped = lambda i: F.when(i == 2, F.concat(F.lit("\n2025. More text, "), title)).otherwise("")
    entry = lambda i: F.concat(mark(i.cast("string")), F.lit("Miller, A. "), title, F.lit(". "), (1990 + i).cast("string"), wrapped(i))
    entries = F.array_join(F.transform(F.sequence(F.lit(1), (3 + F.pmod("doc_id", F.lit(3))).cast("int")), entry), "\n")
    t = F.when(k == 0, F.concat("text", F.lit("\nReferences\n"), entries)).when(k == 1, F.concat(F.lit("References\t12\n"), "text", F.lit("\n"), entries))
    return d.select("doc_id", t.when(k == 2, F.concat("text", F.lit("\n9. Bibliography:\n"), entries)).otherwise(F.col("text")).alias("t"))


_MARKED = "(regexp_matches({0}, '\\b(?:19|20)\\d{{2}}\\b') OR regexp_matches({0}, '(?i)doi\\.org|10\\.\\d{{4,}}/') OR regexp_matches({0}, ';\\s*\\d+\\(\\d+') OR regexp_matches({0}, '\\.\\s+[A-Z][\\p{{L}}&]+.*\\d{{4}}'))"
_SECTION = r"(?i)^(?:introduction|abstract|methods?|materials?|results?|discussion|conclusion|background|references?|bibliography|literature\s+review|acknowledgements?|appendix)(?:\s|$)"
_SEGMENTS = f"""{_PLANTED}, u AS (SELECT doc_id, replace(replace(t, chr(13) || chr(10), chr(10)), chr(13), chr(10)) AS t FROM x),
l0 AS (SELECT doc_id, t, unnest(string_split(t, chr(10))) AS line, unnest(range(0, len(string_split(t, chr(10))))) AS i FROM u),
l1 AS (SELECT *, trim(line, ' ' || chr(9) || chr(11) || chr(12)) AS s, sum(length(line) + 1) OVER (PARTITION BY doc_id ORDER BY i) - length(line) - 1 AS off FROM l0),
l2 AS (SELECT *, {_MARKED.format("s")} AS marked, regexp_extract(s, '^\\d{{1,2}}\\.\\s+(.+)$', 1) AS title,
  regexp_matches(s, '(?i)^(?:\\d{{1,2}}\\.\\s*)?(?:references?|bibliography|works?\\s+cited|literature\\s+cited|cited\\s+references?|reference\\s+list)\\s*[:.]?\\s*$') AND length(s) <= 120
  AND NOT regexp_matches(line, '\\t\\d{{1,4}}\\s*$') AND NOT regexp_matches(s, '\\s{{2,}}\\d{{1,4}}\\s*$') AS head FROM l1),
l3 AS (SELECT *, regexp_matches(line, '^\\s*\\[\\d{{1,4}}\\]\\s*\\S') OR (regexp_matches(line, '^\\s*\\d{{1,4}}\\.\\s+\\S')
  AND NOT (title <> '' AND length(title) <= 55 AND NOT marked AND (regexp_matches(title, '{_SECTION}') OR (length(title) < 45 AND NOT regexp_matches(title, '[;,]') AND NOT regexp_matches(title, '\\b(?:19|20)\\d{{2}}\\b'))))
  AND (marked OR (length(s) >= 50 AND regexp_matches(s, '[,;]')) OR length(s) >= 70)) AS num FROM l2),
l4 AS (SELECT *, length(s) >= 12 AND NOT num AND NOT regexp_matches(s, '(?i)^(?:introduction|abstract|methods|results|discussion|conclusion|background|references?|bibliography)(?:[^a-z0-9_]|$)')
  AND (marked OR regexp_matches(s, '^[a-z(]') OR regexp_matches(s, '[;,.)]\\s*$')) AS wrap FROM l3),
e AS (SELECT doc_id, max(i) FILTER (num AND s <> '') AS fin, max(i) FILTER (head) AS hi, count(*) FILTER (s <> '') AS filled FROM l4 GROUP BY 1),
b AS (SELECT l4.*, e.fin, e.hi, e.filled, coalesce(max(CASE WHEN s <> '' AND NOT num AND NOT wrap AND i < e.fin THEN i END) OVER (PARTITION BY doc_id), -1) AS stop FROM l4 JOIN e USING (doc_id)),
g AS (SELECT doc_id, any_value(t) AS t, any_value(hi) AS hi, any_value(fin) AS fin, any_value(filled) AS filled, min(off) FILTER (s <> '' AND i > stop AND i <= fin) AS start, count(*) FILTER (num AND s <> '' AND i > stop AND i <= fin) AS n,
  count(*) FILTER (num AND marked AND s <> '' AND i > stop AND i <= fin) AS m, max(CASE WHEN i = hi THEN off END) AS head_at, max(CASE WHEN i = hi THEN off + length(line) + 1 END) AS head_to FROM b GROUP BY 1),
seg AS (SELECT doc_id, t, CASE WHEN hi IS NOT NULL THEN 'header' WHEN n >= 3 AND m >= 2 AND (start = 0 OR NOT (start < length(t) * CASE WHEN length(t) < 10000 THEN 0.05 ELSE 0.12 END AND (fin + 1) / filled < 0.45)) THEN 'numbered' END AS kind,
  head_at, head_to, start FROM g)"""
_TRIM = r"regexp_replace(regexp_replace({0}, '^\s+', ''), '\s+$', '')"


@query(
    f"WITH {_SEGMENTS} SELECT doc_id, kind, (CASE kind WHEN 'header' THEN head_at WHEN 'numbered' THEN start END)::INT AS start, "
    f"md5(CASE WHEN kind IS NULL THEN t ELSE {_TRIM.format('left(t, (CASE kind WHEN $$header$$ THEN head_at ELSE start END)::INT)')} END) AS body, "
    f"md5(nullif({_TRIM.format('substring(t, (CASE kind WHEN $$header$$ THEN head_to WHEN $$numbered$$ THEN start END)::INT + 1)')}, '')) AS list FROM seg"
)
def reference_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where each document's list of references begins, with digests of the body and of the list."""
    d = _with_lists(spark, sf_dir)
    s = d.select("doc_id", segments.parts(F.col("t")).alias("s"))
    return s.select("doc_id", "s.kind", "s.start", F.md5("s.body").alias("body"), F.md5("s.references").alias("list"))


@query(
    f"""WITH RECURSIVE {_SEGMENTS}, r AS (SELECT doc_id, {_TRIM.format("substring(t, (CASE kind WHEN 'header' THEN head_to ELSE start END)::INT + 1)")} AS refs FROM seg WHERE kind IS NOT NULL),
n0 AS (SELECT doc_id, {_TRIM.format("unnest(string_split(refs, chr(10)))")} AS line, unnest(range(0, len(string_split(refs, chr(10))))) AS i FROM r),
n1 AS (SELECT doc_id, line, i, coalesce(try_cast(nullif(regexp_extract(line, '^\\s*\\[(\\d+)\\]\\s*\\S', 1), '') AS BIGINT), try_cast(nullif(regexp_extract(line, '^\\s*(\\d+)[.)]\\s+\\S', 1), '') AS BIGINT)) AS n FROM n0 WHERE line <> ''),
acc(doc_id, i, n) AS (SELECT doc_id, min(i), arg_min(n, i) FROM n1 WHERE n IS NOT NULL GROUP BY 1 UNION ALL SELECT a.doc_id, min(n1.i), any_value(n1.n) FROM acc a JOIN n1 ON n1.doc_id = a.doc_id AND n1.i > a.i AND n1.n = a.n + 1 GROUP BY a.doc_id),
q AS (SELECT n1.doc_id, n1.i, n1.line, (SELECT count(*) FROM acc a WHERE a.doc_id = n1.doc_id AND a.i <= n1.i) AS k FROM n1),
y AS (SELECT doc_id, k, string_agg(line, ' ' ORDER BY i) AS entry FROM q GROUP BY ALL)
SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY k) - 1 AS pos, entry FROM y WHERE length(entry) >= 12 AND (k > 0 OR regexp_matches(entry, '\\b(?:19|20)\\d{{2}}\\b|(?i:doi\\.org|10\\.\\d{{4,}}/)') OR regexp_matches(entry, '^(?:(?:\\p{{Lu}}\\.)+\\s*\\p{{L}}|\\p{{Lu}}[\\p{{L}}''’-]*[\\s,])'))"""
)
def reference_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The entries of the documents' lists; a wrapped line that begins with a year is none."""
    d = _with_lists(spark, sf_dir).select("doc_id", segments.body_and_references(F.col("t")).alias("s"))
    e = d.select("doc_id", F.posexplode(segments.split_entries(F.col("s.references"))).alias("pos", "entry"))
    return e.withColumn("pos", F.col("pos").cast("long"))


_CITED = """c AS (SELECT doc_id, left(text, 60) || ' seen [' || (doc_id % 9 + 1) || ', 12-14, p. 3] and (' || (doc_id % 7) || ') by Müller (2020a) as said (Smith & Ångström-Lee, ' || (1990 + doc_id % 20) || ', p. ' || doc_id || ')<sup>7,8</sup> [9-4] (see Roe et al., 2001b). ' || substring(text, 61) AS t FROM documents WHERE doc_id IS NOT NULL)"""


def _with_citations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, t: documents with citations of all forms after their first 60 characters."""
    d, i = _t(spark, sf_dir, "documents").filter("doc_id IS NOT NULL"), F.col("doc_id")
    mod = lambda n, add: (F.pmod(i, F.lit(n)) + add).cast("string")
    begin = [F.left("text", F.lit(60)), " seen [", mod(9, 1), ", 12-14, p. 3] and (", mod(7, 0), ") by Müller (2020a) as said (Smith & Ångström-Lee, ", mod(20, 1990), ", p. ", i.cast("string")]
    parts = [*begin, ")<sup>7,8</sup> [9-4] (see Roe et al., 2001b). ", F.substring("text", 61, 1 << 30)]
    return d.select("doc_id", F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts]).alias("t"))


_LISTED = r"\s*\d+(?:\s*[-–]\s*\d+)?(?:\s*,\s*\d+(?:\s*[-–]\s*\d+)?)*"
_FORMS = {
    0: rf"\[({_LISTED})\s*(?:,\s*([^\]]{{1,30}}))?\]",
    1: rf"\(({_LISTED})\s*\)",
    2: rf"<sup>({_LISTED})</sup>",
    3: r"(?i)\(([^()]{2,80}?)\s*,\s*(\d{4})([a-z])?(?:\s*,\s*([^)]{1,30}))?\)",
    4: r"(?i)([A-Z][\p{L}''’-]+)\s*\((\d{4})([a-z])?\)",
}


def _form_sql(k: int) -> str:
    """Matches of a form with offsets: the lengths of what the text splits into and of the matches before."""
    p, name = _FORMS[k], r"regexp_replace(strip_accents(lower({0})), '[^a-z0-9''’-]+', '', 'g')"
    inner = f"regexp_extract(raw, '{p}', 1)"
    ends = f"list_transform(string_split({inner}, ','), lambda x: list_transform(string_split_regex(x, '[-–]'), lambda y: trim(y)::INT))"
    numbers = f"list_sort(list_distinct(flatten(list_transform({ends}, lambda e: range(e[1], e[-1] + 1)))))"
    joined = rf"regexp_replace(regexp_replace({inner}, '(?i)et\s+al\.?', '', 'g'), '[&;]', ' and ', 'g')"
    authors = rf"list_filter(list_transform(string_split_regex({joined}, '(?i)\band\b'), lambda a: string_split(trim(string_split(trim(a), ',')[1]), ' ')[1]), lambda a: a <> '')"
    families = {3: f"list_transform({authors}, lambda a: {name.format('a')})", 4: f"[{name.format(inner)}]"}.get(k, "[]::VARCHAR[]")
    year, suffix = (f"regexp_extract(raw, '{p}', 2)::INT", f"nullif(regexp_extract(raw, '{p}', 3), '')") if k > 2 else ("NULL::INT", "NULL::VARCHAR")
    locator = f"nullif(trim(regexp_extract(raw, '{p}', {2 if k == 0 else 4})), '')" if k in (0, 3) else "NULL::VARCHAR"
    return f"""SELECT doc_id, {k} AS form, raw, start, {numbers if k < 3 else "[]"}::INT[] AS numbers, {families} AS families, {year} AS year, {suffix} AS suffix, {locator} AS locator FROM (
SELECT doc_id, m[j] AS raw, (list_sum(list_transform(s[1:j], lambda x: length(x))) + coalesce(list_sum(list_transform(m[1:j - 1], lambda x: length(x))), 0))::INT AS start FROM (
SELECT doc_id, m, s, unnest(range(1, len(m) + 1)) AS j FROM (SELECT doc_id, regexp_extract_all(t, '{p}') AS m, string_split_regex(t, '{p}') AS s FROM c)))"""


@query(
    f"WITH {_CITED}, f AS ("
    + " UNION ALL ".join(map(_form_sql, _FORMS))
    + """) SELECT doc_id, CASE WHEN form < 3 THEN 'numeric' ELSE 'author-year' END AS kind, start, (start + length(raw))::INT AS "end", raw,
array_to_string(numbers, ',') AS numbers, array_to_string(families, ',') AS families, year, suffix, locator, CASE WHEN form < 2 THEN 'high' ELSE 'medium' END AS confidence FROM f
WHERE form < 3 AND len(numbers) > 0 OR form > 2 AND len(families) > 0"""
)
def in_text_citations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All citations of the documents, with places that are exact slices of the text."""
    s = manuscript.in_text(_with_citations(spark, sf_dir), "doc_id", "t")
    joined = lambda c: F.array_join(F.col(c).cast("array<string>"), ",").alias(c)
    return s.select("doc_id", "kind", "start", "end", "raw", joined("numbers"), joined("families"), "year", "suffix", "locator", "confidence")


def citation_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The passage of 300 characters at most about every citation.  Sentences and words cut by rule: held against plain Python in the tests."""
    d = _with_citations(spark, sf_dir)
    each = d.select("doc_id", "t", F.explode(manuscript.citations(F.col("t"))).alias("c"))
    return each.select("doc_id", F.col("c.start").alias("at"), P.passage(F.col("t"), F.col("c.start"), F.col("c.end"), 300).alias("w")).select("doc_id", "at", "w.*")


QUERIES["citation_windows"] = citation_windows


@query(
    """WITH d AS (SELECT doc_id, length(text) AS n FROM documents WHERE doc_id IS NOT NULL), p AS (SELECT doc_id, unnest(range(0, n, 400)) AS a, n FROM d), g AS (SELECT doc_id, a // 400 + 1 AS page, a, least(a + CASE WHEN a // 400 % 7 = 3 THEN 0 ELSE 400 END, n) AS b FROM p),
s AS (SELECT doc_id, unnest([0, 1, 2, 3]) AS span, unnest([doc_id * 37 % (n + 1), 0, 5, 1200]) AS a, unnest([doc_id * 37 % (n + 1) + doc_id % 900, n, 5, 1201]) AS b FROM d),
h AS (SELECT s.doc_id, span, min(page) AS lo, max(page) AS hi FROM s JOIN g ON s.doc_id = g.doc_id AND g.b > s.a AND g.a < s.b AND s.b > s.a GROUP BY ALL)
SELECT doc_id, span, CASE WHEN lo = hi THEN 'p. ' || lo ELSE 'pp. ' || lo || '-' || hi END AS hint FROM h"""
)
def span_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pages of four spans of each document: a short one, the whole text, an empty one and one character.  Pages hold 400 characters; some are blank."""
    d = _t(spark, sf_dir, "documents").filter("doc_id IS NOT NULL").select("doc_id", F.char_length("text").cast("long").alias("n"))
    a = F.explode(F.when(F.col("n") > 0, F.sequence(F.lit(0).cast("long"), F.greatest(F.col("n") - 1, F.lit(0)), F.lit(400).cast("long"))).otherwise(F.array().cast("array<long>")))
    page = F.floor(F.col("range_start") / 400)
    pages = d.select("doc_id", "n", a.alias("range_start")).select("doc_id", (page + 1).alias("page"), "range_start", F.least(F.col("range_start") + F.when(page % 7 == 3, 0).otherwise(400), F.col("n")).alias("range_end"))
    first = F.pmod(F.col("doc_id") * 37, F.col("n") + 1)
    four = [(0, first, first + F.pmod("doc_id", F.lit(900))), (1, F.lit(0), F.col("n")), (2, F.lit(5), F.lit(5)), (3, F.lit(1200), F.lit(1201))]
    spans = d.select("doc_id", F.explode(F.array(*[F.struct(F.lit(i).alias("span"), x.cast("long").alias("span_start"), y.cast("long").alias("span_end")) for i, x, y in four])).alias("s")).select("doc_id", "s.*")
    return joins.page_hints(spans, pages, "doc_id", "span")


_CONTAINER = "CASE doc_id % 4 WHEN 0 THEN 'Journal of ' || p_name || ' ' || lang WHEN 1 THEN left(p_name, 5 + (doc_id % 3)::INT) WHEN 2 THEN 'x' || substring(p_name, 2) || ', ' || p_name || 's' ELSE left(text, 30) END"


@query(
    rf"""WITH j AS (SELECT min(p_partkey) AS ord, p_name AS name, 'abbr. ' || min(p_partkey) AS abbr FROM part GROUP BY p_name),
p AS (SELECT p_partkey, p_name FROM part), i AS (SELECT doc_id, trim(regexp_replace(regexp_replace(lower({_CONTAINER}), '[^a-z0-9\s]', '', 'g'), '\s+', ' ', 'g')) AS n FROM documents JOIN p ON p_partkey = doc_id % 40),
x AS (SELECT doc_id, abbr, CASE WHEN n = name THEN 0 ELSE 1 END AS step, name, ord FROM i JOIN j ON n <> '' AND (contains(n, name) OR contains(name, n)))
SELECT doc_id AS id, b.abbr FROM i LEFT JOIN (SELECT doc_id, arg_min(abbr, (step, -length(name), ord)) AS abbr FROM x GROUP BY 1) b USING (doc_id)"""
)
def abbreviation_ladder(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Abbreviations of the containers of documents, which hold a part's name, are a piece of one, or neither."""
    p, k = _t(spark, sf_dir, "part"), F.pmod("doc_id", F.lit(4))
    j = p.groupBy(F.col("p_name").alias("name")).agg(F.min("p_partkey").alias("ord")).select("ord", "name", F.concat(F.lit("abbr. "), F.col("ord").cast("string")).alias("abbr"), F.array().cast("array<string>").alias("issn"))
    d = _t(spark, sf_dir, "documents").join(p.select("p_partkey", "p_name"), F.pmod("doc_id", F.lit(40)) == F.col("p_partkey"))
    name = F.col("p_name")
    c = F.when(k == 0, F.concat(F.lit("Journal of "), name, F.lit(" "), "lang")).when(k == 1, F.left(name, (5 + F.pmod("doc_id", F.lit(3))).cast("int")))
    c = c.when(k == 2, F.concat(F.lit("x"), F.substring(name, 2, 1000), F.lit(", "), name, F.lit("s"))).otherwise(F.left("text", F.lit(30)))
    return listings.abbreviation(d.select(F.col("doc_id").alias("id"), c.alias("container_title"), F.lit(None).cast("string").alias("ISSN")), j)


_LD = {
    0: """<script type="application/ld+json">{"@type":"WebPage","name":"Site page","publisher":{"name":" Pub "}}</script><SCRIPT id=x type='application/ld+json'>[{"@graph":[{"@type":"NewsArticle","headline":"Head <b>of</b> it","author":[{"@type":"Person","name":"Ann Bo"},{"@type":"Organization","name":"Org"}],"datePublished":"2019-05-01","identifier":["x","doi:10.1234/p.1"]}]}]</SCRIPT>""",
    1: """<script type="application/ld+json">{"@type": </script><script type="application/ld+json">{"@type":"http://schema.org/Article","name":"Tee","creator":"Cy Do","dateModified":"updated in 2011","publisher":"Name"}</script>""",
    2: """<script type="application/ld+json">{broken}</script><script type="application/ld+json"> </script>""",
    4: """<script type="application/ld+json">[[{"@type":"Report","headline":"R","sourceOrganization":{"name":"Second"}},{"@type":["Thing","ScholarlyArticle"],"headline":" ","name":"N","publisher":"First"}],7,{"@type":"BlogPosting","author":[{"givenName":"A","familyName":"B"},{"familyName":"C"}],"dateCreated":"2001"}]</script>""",
}
_LD_SQL = "CASE page_id % 5 " + " ".join(f"WHEN {k} THEN $ld${v}$ld$" for k, v in _LD.items()) + " ELSE '' END"


def _ld_text(path: str) -> str:
    return f"CASE WHEN json_type(v, '{path}') = 'VARCHAR' THEN nullif(trim(json_extract_string(v, '{path}')), '') END"


_LD_NAMES = """list_filter(list_transform(CASE json_type(v, '$.{0}') WHEN 'ARRAY' THEN json_extract(v, '$.{0}[*]') ELSE [json_extract(v, '$.{0}')] END, lambda p: CASE WHEN json_type(p) = 'VARCHAR' THEN nullif(trim(json_extract_string(p, '$')), '')
  WHEN json_type(p) = 'OBJECT' AND NOT contains(lower(coalesce(json_extract_string(p, '$."@type"'), '')), 'organization') THEN coalesce(nullif(trim(json_extract_string(p, '$.name')), ''), nullif(concat_ws(' ', nullif(trim(json_extract_string(p, '$.givenName')), ''), nullif(trim(json_extract_string(p, '$.familyName')), '')), '')) END), lambda n: n IS NOT NULL)"""


@query(
    rf"""WITH RECURSIVE b AS (SELECT page_id, unnest(regexp_extract_all(html || {_LD_SQL}, '(?is)<script[^>]*type=["'']application/ld\+json["''][^>]*>(.*?)</script>', 1)) AS raw, unnest(range(0, len(regexp_extract_all(html || {_LD_SQL}, '(?is)<script[^>]*type=["'']application/ld\+json["''][^>]*>(.*?)</script>', 1)))) AS k FROM pages WHERE page_id IS NOT NULL),
r AS (SELECT page_id, [k] AS path, trim(raw)::JSON AS v FROM b WHERE trim(raw) <> '' AND json_valid(trim(raw))),
o(page_id, path, v, fin) AS (SELECT page_id, path, v, false FROM r UNION ALL SELECT page_id, list_append(path, i), w, false FROM (SELECT page_id, path, unnest(CASE WHEN json_type(v) = 'ARRAY' THEN json_extract(v, '$[*]') ELSE json_extract(v, '$."@graph"[*]') END) AS w,
  unnest(range(0, len(CASE WHEN json_type(v) = 'ARRAY' THEN json_extract(v, '$[*]') ELSE json_extract(v, '$."@graph"[*]') END))) AS i FROM o WHERE json_type(v) = 'ARRAY' OR json_type(v, '$."@graph"') = 'ARRAY')),
n AS (SELECT page_id, path, v FROM o WHERE json_type(v) = 'OBJECT' AND json_type(v, '$."@graph"') IS DISTINCT FROM 'ARRAY'),
t AS (SELECT *, list_max(list_transform(CASE WHEN json_type(v, '$."@type"') = 'ARRAY' THEN json_extract_string(v, '$."@type"[*]') ELSE [json_extract_string(v, '$."@type"')] END, lambda x: CASE regexp_replace(lower(coalesce(x, '')), '^https?://schema\.org/', '') WHEN 'scholarlyarticle' THEN 5 WHEN 'newsarticle' THEN 5 WHEN 'article' THEN 4 WHEN 'blogposting' THEN 3 WHEN 'webpage' THEN 2 WHEN 'medicalwebpage' THEN 2 WHEN 'report' THEN 1 ELSE 0 END)) AS rank,
  nullif(trim(regexp_replace(regexp_replace(coalesce({_ld_text('$.headline')}, {_ld_text('$.name')}), '<[^>]+>', ' ', 'g'), '\s+', ' ', 'g')), '') AS title,
  CASE WHEN len({_LD_NAMES.format('author')}) > 0 THEN {_LD_NAMES.format('author')} ELSE {_LD_NAMES.format('creator')} END AS authors,
  coalesce({_ld_text('$.datePublished')}, {_ld_text('$.dateCreated')}, {_ld_text('$.dateModified')}) AS d,
  nullif(regexp_extract(array_to_string(CASE WHEN json_type(v, '$.identifier') = 'ARRAY' THEN json_extract_string(v, '$.identifier[*]') ELSE [json_extract_string(v, '$.identifier')] END, ' '), '(?i)\b(10\.\d{{4,}}/[^\s,;)}}\]"]+)', 1), '') AS doi,
  coalesce({_ld_text('$.publisher')}, {_ld_text('$.publisher.name')}, {_ld_text('$.sourceOrganization')}, {_ld_text('$.sourceOrganization.name')}) AS site FROM n),
k AS (SELECT *, row_number() OVER (PARTITION BY page_id ORDER BY rank DESC, path) AS i, coalesce(nullif(regexp_extract(d, '^(\d{{4}})', 1), ''), nullif(regexp_extract(d, '\b((?:19|20)\d{{2}})\b', 1), ''))::INT AS year FROM t),
e AS (SELECT page_id, greatest(min(i) FILTER (title IS NOT NULL), min(i) FILTER (len(authors) > 0)) AS stop, count(*) FILTER (title IS NOT NULL) * count(*) FILTER (len(authors) > 0) AS whole FROM k GROUP BY 1),
u AS (SELECT k.* FROM k JOIN e USING (page_id) WHERE whole = 0 OR i <= stop)
SELECT page_id, arg_min(title, i) FILTER (title IS NOT NULL) AS title, array_to_string(arg_min(authors, i) FILTER (len(authors) > 0), '; ') AS authors, arg_min(year, i) FILTER (year IS NOT NULL) AS year, arg_min(doi, i) FILTER (doi IS NOT NULL) AS doi,
(list(site ORDER BY i) FILTER (site IS NOT NULL))[1] AS container_title, (list(site ORDER BY i) FILTER (site IS NOT NULL))[2] AS publisher FROM u GROUP BY page_id"""
)
def page_json_ld(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Metadata of pages with JSON-LD blocks planted, some of them malformed."""
    p, k = _t(spark, sf_dir, "pages").filter("page_id IS NOT NULL"), F.pmod("page_id", F.lit(5))
    block = F.lit("")
    for i, v in _LD.items():
        block = F.when(k == i, F.lit(v)).otherwise(block)
    m = p.select("page_id", jsonld.metadata(F.concat("html", block)).alias("m")).filter("m IS NOT NULL")
    return m.select("page_id", "m.title", F.array_join("m.authors", "; ").alias("authors"), "m.year", "m.doi", "m.container_title", "m.publisher")
