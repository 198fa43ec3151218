"""Manuscripts: sentences, windows, chunks, in-text citations and their bibliography entries."""

from __future__ import annotations

import re
import unicodedata

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import places as P
from ..functions import text as X

RANGE = 10_000
_NUMBER_LIST = r"\s*\d+(?:\s*[-–]\s*\d+)?(?:\s*,\s*\d+(?:\s*[-–]\s*\d+)?)*"
# The forms of citations in a text, in their order of precedence.
NUMERIC = (
    ("high", rf"\[({_NUMBER_LIST})\s*(?:,\s*([^\]]{{1,30}}))?\]"),
    ("high", rf"\(({_NUMBER_LIST})\s*\)"),
    ("medium", rf"<sup>({_NUMBER_LIST})</sup>"),
)
PARENTHETICAL = r"(?i)\(([^()]{2,80}?)\s*,\s*(\d{4})([a-z])?(?:\s*,\s*([^)]{1,30}))?\)"
NARRATIVE = r"(?iu)(?<![\p{L}\p{N}_])([A-Z][\p{L}'’-]+)\s*\((\d{4})([a-z])?\)"
CITATION = "array<struct<start:int,end:int,place:int,kind:string,raw:string,numbers:array<int>,families:array<string>,year:int,suffix:string,locator:string,confidence:string>>"


def _plain(c: int) -> str:
    return re.sub("[^a-z0-9'’-]", "", unicodedata.normalize("NFKD", chr(c).lower()))


#: Letters that decompose to one Latin letter and marks, and those.
_MARKED = [(chr(c), _plain(c)) for c in range(0x80, 0x10000) if not 0xD800 <= c < 0xE000 and len(_plain(c)) == 1 and _plain(c) != chr(c)]


def family_name(c: Column) -> Column:
    """Lower case, marks off letters, nothing but a-z, digits, apostrophes and hyphens.  Signs that stand for several letters go."""
    plain = F.translate(c, "".join(a for a, _ in _MARKED), "".join(b for _, b in _MARKED))
    return F.regexp_replace(F.lower(F.when(F.octet_length(c) == F.char_length(c), c).otherwise(plain)), "[^a-z0-9'’-]+", "")


def _numbers(inner: Column) -> Column:
    """The numbers of a list like 1, 3-5 in order, each once; a range of more than RANGE is cut there, a turned one left out."""

    def part(p: Column) -> Column:
        ends = F.transform(F.split(p, "[-–]"), lambda e: F.trim(e).try_cast("int"))
        lo, hi = F.get(ends, 0), F.coalesce(F.get(ends, 1), F.get(ends, 0))
        fine = lo.isNotNull() & (hi >= lo) & ((F.size(ends) == 1) | F.get(ends, 1).isNotNull())
        return F.when(fine, F.sequence(lo, F.least(F.greatest(hi, lo), lo + RANGE))).otherwise(F.array().cast("array<int>"))

    return F.array_sort(F.array_distinct(F.flatten(F.transform(F.split(inner, ","), part))))


def _families(authors: Column) -> Column:
    joined = F.regexp_replace(F.regexp_replace(F.regexp_replace(authors, r"(?i)et\s+al\.?", ""), "[&;]", " and "), r"\s+", " ")
    each = F.filter(F.transform(F.split(F.trim(joined), r"(?i)\band\b"), F.trim), lambda p: p != "")
    first = F.transform(each, lambda p: F.get(F.split(F.trim(F.get(F.split(p, ","), 0)), " "), 0))
    return F.array_distinct(F.transform(F.filter(first, lambda f: f != ""), family_name))


def citations(text: Column) -> Column:
    """array of in-text citations by start and end: numbers in brackets, parentheses or superscripts, (authors, year) and Author (year), with
    offsets in code points; of equal spans of a kind the first form counts."""
    none, nothing = F.lit(None).cast("string"), F.array().cast("array<string>")
    group = lambda m, p, k: F.nullif(F.trim(F.regexp_extract(m["raw"], p, k)), F.lit(""))

    def form(place: int, p: str, kind: str, confidence: str, numbers, families, year, suffix, locator) -> Column:
        def one(m: Column) -> Column:
            end = m["start"] + F.char_length(m["raw"])
            about = {"start": m["start"], "end": end, "place": F.lit(place), "kind": F.lit(kind), "raw": m["raw"], "numbers": numbers(m), "families": families(m)}
            return F.struct(*[c.alias(n) for n, c in (about | {"year": year(m).try_cast("int"), "suffix": suffix(m), "locator": locator(m), "confidence": F.lit(confidence)}).items()])

        return F.transform(P.places(text, p), one).cast(CITATION)

    def numeric(place: int, confidence: str, p: str) -> Column:
        found = form(place, p, "numeric", confidence, lambda m: _numbers(F.regexp_extract(m["raw"], p, 1)), lambda m: nothing, lambda m: none, lambda m: none, lambda m: group(m, p, 2) if place == 0 else none)
        return F.filter(found, lambda c: F.size(c["numbers"]) > 0)

    def dated(place: int, p: str, families, locator: int | None) -> Column:
        found = form(place, p, "author-year", "medium", lambda m: F.array().cast("array<int>"), families, lambda m: F.regexp_extract(m["raw"], p, 2), lambda m: group(m, p, 3), lambda m: group(m, p, locator) if locator else none)
        return F.filter(found, lambda c: F.size(c["families"]) > 0)

    forms = [numeric(i, c, p) for i, (c, p) in enumerate(NUMERIC)]
    forms.append(dated(3, PARENTHETICAL, lambda m: _families(F.regexp_extract(m["raw"], PARENTHETICAL, 1)), 4))
    forms.append(dated(4, NARRATIVE, lambda m: F.array(family_name(F.regexp_extract(m["raw"], NARRATIVE, 1))), None))

    def first_only(every: Column) -> Column:
        same = lambda a, b: (a["kind"] == b["kind"]) & (a["start"] == b["start"]) & (a["end"] == b["end"])
        return F.filter(every, lambda c, i: F.when(i == 0, True).otherwise(~same(F.get(every, F.greatest(i - 1, F.lit(0))), c)))

    return P.let(F.array_sort(F.concat(*forms)), first_only)


def in_text(manuscripts: DataFrame, key: str, text: str) -> DataFrame:
    """key and one row per citation in the text; see citations()."""
    return manuscripts.select(key, F.explode(citations(F.col(text))).alias("s")).select(key, "s.kind", "s.start", "s.end", "s.raw", "s.numbers", "s.families", "s.year", "s.suffix", "s.locator", "s.confidence")


def paren_numbers(text: Column) -> Column:
    """The numbers of (n) spans in order, by built-in functions alone."""
    return F.transform(F.regexp_extract_all(text, F.lit(r"\((\d{1,9})\)"), 1), lambda x: x.cast("int"))


def map_numbers(spans: DataFrame, entries: DataFrame, doc: str) -> DataFrame:
    """spans: doc, start, numbers; entries: doc, ord, key, raw.  Adds keys (in citation order) and missing (numbers without entry).  Of
    entries with one number the last counts."""
    number = F.regexp_replace("key", r"\D", "").try_cast("int")
    last = entries.withColumn("n", number).groupBy(doc, "n").agg(F.max_by("key", "ord").alias("key"))
    each = spans.select(doc, "start", F.posexplode("numbers").alias("p", "n"))
    got = each.join(last, [doc, "n"], "left").groupBy(doc, "start").agg(F.array_sort(F.collect_list(F.struct("p", "n", "key"))).alias("x"))
    keys = F.array_distinct(F.transform(F.filter("x", lambda s: s["key"].isNotNull()), lambda s: s["key"]))
    missing = F.transform(F.filter("x", lambda s: s["key"].isNull()), lambda s: s["n"])
    return got.select(doc, "start", keys.alias("keys"), missing.alias("missing"))


def map_author_year(spans: DataFrame, entries: DataFrame, doc: str) -> DataFrame:
    """spans: doc, start, families, year.  Entries of the document whose folded text has the year and the first family.  One is a
    match, more are candidates.  Entries are met by the years in their text; a family that folds to nothing matches none."""
    family = X.fold(F.get("families", 0))
    s = spans.select(doc, "start", F.col("year").cast("string").alias("y"), family.alias("f")).filter("f != ''")
    raw = X.fold(F.col("raw"))
    e = entries.select(doc, "ord", "key", raw.alias("raw"), F.explode(F.array_distinct(F.regexp_extract_all(raw, F.lit(r"(\d{4})"), 1))).alias("y"))
    hit = s.join(e, [doc, "y"]).filter(F.col("raw").contains(F.col("f"))).groupBy(doc, "start").agg(F.array_sort(F.collect_set(F.struct("ord", "key"))).alias("x"))
    keys = F.transform("x", lambda v: v["key"])
    return spans.select(doc, "start").join(hit, [doc, "start"], "left").select(doc, "start", F.when(F.size("x") == 1, keys).otherwise(F.array().cast("array<string>")).alias("keys"), F.when(F.size("x") > 1, keys).alias("candidates"))


def mapping_summary(mapped: DataFrame) -> DataFrame:
    """matched, ambiguous, unmatched; an ambiguous one isn't matched."""
    many, some = F.coalesce(F.size("candidates"), F.lit(0)) > 1, F.size("keys") > 0
    return mapped.agg(F.count_if(some & ~many).alias("matched"), F.count_if(many).alias("ambiguous"), F.count_if(~some & ~many).alias("unmatched"))


def sentences(text: Column) -> Column:
    """Sentences in order, cut after ., ! or ? before white space."""
    return F.filter(F.split(F.trim(text), r"(?<=[.!?])\s+"), lambda s: s != "")


def chunk_budget(chunks: DataFrame, key: str, order: list, size: Column, budget: int, separator: int = 1) -> DataFrame:
    """The chunks in order up to the first that would pass the budget, which ends the choice."""
    w = Window.partitionBy(key).orderBy(*order)
    used = F.sum(size + separator).over(w.rowsBetween(Window.unboundedPreceding, 0)) - separator
    fit = chunks.withColumn("used", used)
    return fit.withColumn("over", F.max((F.col("used") > budget).cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0))).filter("over = 0").drop("over")


def select_chunks(sources: DataFrame, key: str, text: str, passage: str, budget: int, least: int = 20) -> DataFrame:
    """Sentences of over `least` characters, those with most words of the passage first, within the budget; a source that fits as a
    whole is one chunk."""
    whole = X.collapse(F.col(text))
    fits = sources.filter(F.char_length(whole) <= budget).select(key, F.lit(0).alias("pos"), whole.alias("chunk"))
    rest = sources.filter(F.char_length(whole) > budget).select(key, passage, F.posexplode(sentences(whole)).alias("pos", "chunk")).filter(F.char_length("chunk") > least)
    score = F.size(F.array_intersect(F.array_distinct(X.tokens(F.col(passage))), F.array_distinct(X.tokens(F.col("chunk")))))
    rest = chunk_budget(rest.withColumn("score", score), key, [F.col("score").desc(), "pos"], F.char_length("chunk"), budget)
    return fits.unionByName(rest.select(key, "pos", "chunk"))


def window(sentence_list: Column, at: Column, cap: int) -> Column:
    """The sentence at an index with its neighbours; a longer window is cut to cap characters at a space."""
    joined = F.array_join(F.filter(F.slice(sentence_list, F.greatest(at, F.lit(1)), F.when(at == 0, 2).otherwise(3)), lambda s: s.isNotNull()), " ")
    return F.when(F.char_length(joined) <= cap, joined).otherwise(F.regexp_replace(F.left(joined, F.lit(cap)), r"\s+\S*\z", ""))


HEADING = r"(?im)^\s*(?:\d+\.?\s+)?(references|bibliography|works cited|literature cited|reference list)\s*:?\s*$"


def split_references(text: Column) -> Column:
    """struct(body, references): at the last line that is a heading of references; no heading: all is body."""
    head = F.regexp_extract(text, r"(?is)^(.*)(?:^|\n)[ \t]*(?:\d+\.?[ \t]+)?(?:references|bibliography|works cited|literature cited|reference list)[ \t]*:?[ \t]*(?:\n|$)", 1)
    has = text.rlike(HEADING)
    tail = F.regexp_replace(F.substring(text, F.char_length(head) + 1, 1 << 30), r"(?i)^\n?[ \t]*(?:\d+\.?[ \t]+)?[a-z ]+:?[ \t]*(?:\n|$)", "")
    return F.struct(F.when(has, head).otherwise(text).alias("body"), F.when(has, tail).otherwise("").alias("references"))


def entries(references: Column) -> Column:
    """Entries of a reference list: by [n] or n. at line starts if there are any, else by blank lines, else by lines."""
    t = F.trim(references)
    numbered = t.rlike(r"(?m)^\s*(?:\[\d+\]|\d+\.)\s")
    parts = F.when(numbered, F.split(t, r"\n(?=\s*(?:\[\d+\]|\d+\.)\s)")).when(t.rlike(r"\n\s*\n"), F.split(t, r"\n\s*\n")).otherwise(F.split(t, r"\n"))
    return F.filter(F.transform(parts, X.collapse), lambda x: x != "")


def merge_statute_lines(lines: DataFrame, key: str, order: str, line: str) -> DataFrame:
    """A line that ends in a year and the next that begins with /digits are one."""
    w = Window.partitionBy(key).orderBy(order)
    nxt, prev = F.lead(line).over(w), F.lag(line).over(w)
    begins, ends = (lambda c: F.coalesce(c.rlike(r"^/\d+"), F.lit(False))), (lambda c: F.coalesce(c.rlike(r"\b\d{4}$"), F.lit(False)))
    out = lines.withColumn("_tail", begins(F.col(line)) & ends(prev)).withColumn("_new", F.when(ends(F.col(line)) & begins(nxt), F.concat(line, nxt)).otherwise(F.col(line)))
    return out.filter("NOT _tail").withColumn(line, F.col("_new")).drop("_tail", "_new")


def page_offsets(pages: DataFrame, key: str, page: str, text: str, separator: int = 1) -> DataFrame:
    """Start and end of every page in the joined text."""
    w = Window.partitionBy(key).orderBy(page).rowsBetween(Window.unboundedPreceding, 0)
    end = F.sum(F.char_length(text) + separator).over(w) - separator
    return pages.withColumn("end", end).withColumn("start", F.col("end") - F.char_length(text))


def page_hint(boundaries: Column, start: Column, end: Column) -> Column:
    """Pages whose boundaries overlap a span."""
    return F.transform(F.filter(boundaries, lambda b: (b["end"] > start) & (b["start"] < end)), lambda b: b["page"])


def merge_pages(ocr: DataFrame, embedded: DataFrame, keys: list[str], confidence: float = 78, digits: float = 0.08) -> DataFrame:
    """ocr: keys, ocr_text, ocr_conf; embedded: keys, embedded_text.  Sure OCR text with few digits, else embedded text, else OCR."""
    both = ocr.join(embedded, keys, "full")
    share = F.char_length(F.regexp_replace("ocr_text", r"\D", "")) / F.greatest(F.char_length("ocr_text"), F.lit(1))
    sure = F.coalesce((F.col("ocr_conf") >= confidence) & (share <= digits), F.lit(False))
    blank = F.trim(F.coalesce("embedded_text", F.lit(""))) == ""
    return both.select(*keys, F.when(sure | blank, F.coalesce("ocr_text", F.lit(""))).otherwise(F.col("embedded_text")).alias("text"), F.when(sure | blank, "ocr").otherwise("embedded").alias("source"))


TEMPLATE = {"introduction": ["introduction", "background"], "methods": ["methods", "methodology", "materials and methods"], "results": ["results", "findings"], "discussion": ["discussion", "conclusion", "conclusions"]}


def structure(text: Column, template: dict[str, list[str]] = TEMPLATE) -> Column:
    """struct(found, missing, inversions): headings by their first synonym at a line's start, in the template's order."""
    names = list(template)

    def places(low: Column) -> Column:
        return F.struct(*[F.array_min(F.filter(F.array(*[F.locate("\n" + s, low) for s in syn]), lambda p: p > 0)).alias(f"p{i}") for i, syn in enumerate(template.values())])

    def summary(at: Column) -> Column:
        found = F.array_compact(F.array(*[F.when(at[f"p{i}"].isNotNull(), h) for i, h in enumerate(names)]))
        turned = [F.when(at[f"p{i}"] > at[f"p{j}"], F.concat(F.lit(f"{names[j]} before {names[i]}"))) for i in range(len(names)) for j in range(i + 1, len(names))]
        return F.struct(found.alias("found"), F.array_except(F.array(*map(F.lit, names)), found).alias("missing"), F.array_compact(F.array(*turned)).alias("inversions"))

    # the text is lowered once, and each heading is looked for once
    return P.let(P.let(F.concat(F.lit("\n"), F.lower(text)), places), summary)
