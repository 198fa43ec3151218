"""Where a manuscript's reference list begins, and the entries of the list.

All is done inside a row by array functions: lines are classified once, blocks and breaks are found by their places, and only the numbers of
numbered lines pass a fold.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.places import let

# Headings of reference lists, and headings that are not.
HEADINGS = r"references?|bibliography|works?\s+cited|literature\s+cited|cited\s+references?|reference\s+list"
HEADING_LINES = (
    rf"(?i)^(?:\d{{1,2}}\.\s*)?(?:{HEADINGS})\s*[:.]?\s*$",
    r"(?i)academic\s*bibliography",
    r"قائمة\s+ال?\S{0,4}مراجع",
    r"ال?\S{0,4}مراجع\s+وال?\S{0,4}مصادر",
    r"^(?:أولا|ثانيا|ثالثا)[ًا]?\s*[:：.]?\s*ال?\S{0,4}مراجع(?:[^\p{L}\p{N}_]|$)",
    r"^ال?\S{0,4}مراجع\s*[:.،]?\s*$",
    r"^ال?\S{0,4}مصادر\s*[:.،]?\s*$",
)
GLOSSARY = r"المصطلحات|الاختصارات|اختصارات"
HEADING_CHARS = 120
SECTIONS = r"(?i)^(?:introduction|abstract|methods?|materials?|results?|discussion|conclusion|background|references?|bibliography|literature\s+review|acknowledgements?|appendix)(?:\s|$)"
WRAP_STOPS = r"(?i)^(?:introduction|abstract|methods|results|discussion|conclusion|background|references?|bibliography)(?:[^a-z0-9_]|$)"
# Marks of a line of a reference list.
YEAR = r"\b(?:19|20)\d{2}\b"
# The last is a capitalised word after a full stop with four digits somewhere behind it: of a line only its first such word is tried, as digits behind
# a later one are behind the first as well.  So a long line without digits is read once and not once for every sentence.
MARKS = (YEAR, r"(?i)doi\.org|10\.\d{4,}/", r";\s*\d+\(\d+", r"(?:^|[\x{85}\x{2028}\x{2029}\r\n])(?>.*?\.\s+[A-Z][\p{L}&]).*\d{4}")
BRACKET = r"^\s*\[(\d+)\]\s*\S"
DOTTED = r"^\s*(\d+)[.)]\s+\S"
AUTHOR = r"^(?:(?:\p{Lu}\.)+\s*\p{L}|\p{Lu}[\p{L}'’-]*[\s,])"
SUBSECTIONS = (
    r"(?i)^(?:أولاً|ثانيا|ثالثا|رابعا|خامسا)[ًا]?\s*[:：.]?\s*(?:ال?\S{0,4}مراجع|references?|bibliography|sources?)",
    r"(?i)\((?:Arabic|English|French)\s+References?\)",
    r"(?i)^(?:Arabic|English|French)\s+References?\s*[:.]?\s*$",
)
RESUME = (
    r"(?i)السيرة\s*الذاتية|السيرة\s*العلمية|ملخص\s*(?:ال)?(?:بحث|دراسة|منشورات|السيرة)|curriculum\s*vitae|\bcv\b|resume|professional\s+summary|"
    r"research\s+summary|abstract\s+of\s+(?:the\s+)?(?:thesis|dissertation)"
)


def _any(c: Column, patterns) -> Column:
    return reduce(lambda a, b: a | b, [c.rlike(p) for p in patterns])


def unix_lines(text: Column) -> Column:
    return F.regexp_replace(text, "\r\n?", "\n")


def is_heading(line: Column) -> Column:
    """A heading of references that is no line of a table of contents, which ends in a page number after a tab or a wide gap."""

    def short(t: Column) -> Column:
        plain = t.rlike(HEADING_LINES[0])
        other = ~t.rlike(GLOSSARY) & _any(t, HEADING_LINES[1:])
        toc = line.rlike(r"\t\d{1,4}\s*$") | t.rlike(r"\s{2,}\d{1,4}\s*$")
        return F.when((t != "") & (F.char_length(t) <= HEADING_CHARS), (plain | other) & ~toc).otherwise(False)

    return let(F.trim(F.regexp_replace(line, r"^[\s\uFEFF]+|[\s\uFEFF]+$", "")), short)


def is_marked(line: Column) -> Column:
    """Whether a line has a year, a DOI, an issue or the like."""
    return _any(line, MARKS)


def _is_numbered(line: Column, t: Column, marked: Column) -> Column:
    """A numbered line of a reference list, and not a numbered heading of a section; t: the line without blanks at its ends, marked: see is_marked()."""

    def listed(title: Column) -> Column:
        short = (F.char_length(title) < 45) & ~title.rlike("[;,]") & ~title.rlike(YEAR)
        section = (title != "") & (F.char_length(title) <= 55) & ~marked & (title.rlike(SECTIONS) | short)
        long = ((F.char_length(t) >= 50) & t.rlike("[,;]")) | (F.char_length(t) >= 70)
        return ~section & (marked | long)

    return F.when(line.rlike(r"^\s*\[\d{1,4}\]\s*\S"), True).when(line.rlike(r"^\s*\d{1,4}\.\s+\S"), let(F.regexp_extract(t, r"^\d{1,2}\.\s+(.+)$", 1), listed)).otherwise(False)


def _is_wrapped(t: Column, numbered: Column, marked: Column) -> Column:
    """A line that goes on with a reference."""
    return ~numbered & (F.char_length(t) >= 12) & ~t.rlike(WRAP_STOPS) & (marked | t.rlike(r"^[a-z(]") | t.rlike(r"[;,.)]\s*$"))


def segment(text: Column) -> Column:
    """struct(kind, start, after): where the references begin and where their text does, in code points; null if nowhere.

    kind is header for the last heading of references; else numbered for the last block of numbered lines with the lines that go on with
    them, if it has three or more of which two or more are marked, and doesn't stand at the very beginning of a longer text.
    Seen from the end, the block ends with the last numbered line and goes back to the first line that is neither blank nor part of it.
    """

    def found(lines: Column) -> Column:
        def one(line: Column, i: Column) -> Column:
            def marked(x: Column) -> Column:
                return let(F.struct(x["t"].alias("t"), x["m"].alias("m"), _is_numbered(line, x["t"], x["m"]).alias("num")), about)

            def about(x: Column) -> Column:
                return F.struct(i.alias("i"), (x["t"] == "").alias("blank"), is_heading(line).alias("head"), x["num"].alias("num"), x["m"].alias("marked"), _is_wrapped(x["t"], x["num"], x["m"]).alias("wrap"), F.char_length(line).alias("n"))

            return let(F.trim(line), lambda t: let(F.struct(t.alias("t"), is_marked(t).alias("m")), marked))

        return F.transform(lines, one)

    def place(lines: Column, i: Column) -> Column:
        return F.when(i == 0, 0).otherwise(F.char_length(F.array_join(F.slice(lines, 1, F.greatest(i, F.lit(1))), "\n")) + 1)

    def last(c: Column, keep) -> Column:
        return F.array_max(F.transform(F.filter(c, keep), lambda x: x["i"]))

    def by_head(x: Column, head: Column) -> Column:
        def at(start: Column) -> Column:
            after = F.least(start + F.get(x["c"], head)["n"] + 1, F.char_length(x["t"]))
            return F.struct(F.lit("header").alias("kind"), start.cast("int").alias("start"), after.cast("int").alias("after"))

        return let(place(x["lines"], head), at)

    # each place is named before the lines are read for the next: inside a filter it would be found anew for every line
    def by_block(x: Column, end: Column) -> Column:
        c, full = x["c"], F.char_length(x["t"])

        def whole(b: Column) -> Column:
            least = F.when(full < 10_000, 0.05).otherwise(0.12)

            def judged(start: Column) -> Column:
                early = (start < full * least) & ((end + 1) / F.greatest(b["filled"], F.lit(1)) < 0.45) & (start > 0)
                return F.when(~early, F.struct(F.lit("numbered").alias("kind"), start.cast("int").alias("start"), start.cast("int").alias("after")))

            return F.when((b["numbered"] >= 3) & (b["marked"] >= 2), let(place(x["lines"], b["first"]), judged))

        def counted(block: Column) -> Column:
            of = lambda keep: F.size(F.filter(block, keep))
            first = F.array_min(F.transform(block, lambda k: k["i"]))
            filled = F.size(F.filter(c, lambda k: ~k["blank"]))
            return let(F.struct(first.alias("first"), filled.alias("filled"), of(lambda k: k["num"]).alias("numbered"), of(lambda k: k["num"] & k["marked"]).alias("marked")), whole)

        stop = F.coalesce(last(c, lambda k: ~k["blank"] & ~k["num"] & ~k["wrap"] & (k["i"] < end)), F.lit(-1))
        return let(stop, lambda s: let(F.filter(c, lambda k: ~k["blank"] & (k["i"] > s) & (k["i"] <= end)), counted))

    def where(x: Column) -> Column:
        ends = F.struct(last(x["c"], lambda k: k["head"]).alias("head"), last(x["c"], lambda k: k["num"] & ~k["blank"]).alias("end"))
        return let(ends, lambda e: F.when(e["head"].isNotNull(), by_head(x, e["head"])).when(e["end"].isNotNull(), by_block(x, e["end"])))

    return let(unix_lines(text), lambda u: let(F.split(u, "\n"), lambda lines: let(F.struct(u.alias("t"), lines.alias("lines"), found(lines).alias("c")), where)))


def parts(text: Column) -> Column:
    """struct(kind, start, body, references): see segment(); trimmed; without a list all is body and the others null."""

    def cut(x: Column) -> Column:
        at, t = x["at"], x["t"]
        body = F.when(at.isNull(), t).otherwise(trim(F.substring(t, F.lit(1), at["start"])))
        tail = F.nullif(trim(F.substring(t, at["after"] + 1, F.lit(1 << 30))), F.lit(""))
        return F.struct(at["kind"].alias("kind"), at["start"].alias("start"), body.alias("body"), tail.alias("references"))

    return let(unix_lines(text), lambda u: let(F.struct(u.alias("t"), segment(u).alias("at")), cut))


def body_and_references(text: Column) -> Column:
    """struct(kind, body, references) of parts()."""
    return let(parts(text), lambda p: F.struct(p["kind"].alias("kind"), p["body"].alias("body"), p["references"].alias("references")))


def trim(c: Column) -> Column:
    return F.regexp_replace(c, r"^\s+|\s+$", "")


def entry_number(line: Column) -> Column:
    """The number of an entry; a bare year or a DOI at a line's start is none unless a blank follows its full stop."""
    number = F.coalesce(F.nullif(F.regexp_extract(line, BRACKET, 1), F.lit("")), F.nullif(F.regexp_extract(line, DOTTED, 1), F.lit("")))
    return number.try_cast("long")


def is_entry(entry: Column) -> Column:
    """Whether a text can be a reference: numbered, dated, with a DOI, or beginning with an author."""

    def fine(t: Column) -> Column:
        heading = ((F.char_length(t) <= 140) & _any(t, SUBSECTIONS)) | t.rlike(RESUME)
        number = F.coalesce(entry_number(t), F.lit(0)) > 0
        return (F.char_length(t) >= 12) & ~heading & (number | t.rlike(YEAR) | t.rlike(MARKS[1]) | t.rlike(AUTHOR))

    return let(trim(entry), fine)


def split_entries(references: Column) -> Column:
    """The entries of a reference list in order.

    Paragraphs, if there are two or more and none is numbered.  Else, with two or more numbered lines, an entry begins where the
    number is one more than that of the entry before, so that a line "2025. More text" goes on with its entry; otherwise it
    begins where a line begins with an author.  What can't be a reference is left out.
    """
    squeeze = lambda c: trim(F.regexp_replace(c, r"\s+", " "))
    parts = F.filter(F.transform(F.split(references, r"\n\s*\n+"), squeeze), lambda p: p != "")
    lines = F.filter(F.transform(F.split(references, "\n"), trim), lambda line: line != "")

    def by_lines(x: Column) -> Column:
        line, number = x["lines"], x["numbers"]
        marks = F.filter(F.transform(number, lambda n, i: F.struct(n.alias("n"), i.alias("i"))), lambda m: m["n"].isNotNull())
        zero = F.struct(F.lit(None).cast("long").alias("prev"), F.array().cast("array<int>").alias("at"))
        step = lambda s, m: F.when(s["prev"].isNull() | (m["n"] == s["prev"] + 1), F.struct(m["n"].alias("prev"), F.array_append(s["at"], m["i"]).alias("at"))).otherwise(s)
        taken = F.aggregate(marks, zero, step)["at"]
        authors = F.transform(F.filter(F.transform(line, lambda c, i: F.struct(c.alias("c"), i.alias("i"))), lambda c: c["c"].rlike(AUTHOR)), lambda c: c["i"])
        starts = F.array_distinct(F.concat(F.array(F.lit(0)), F.when(F.size(marks) >= 2, taken).otherwise(authors)))
        ends = lambda s: F.transform(s, lambda a, k: F.struct(a.alias("a"), F.coalesce(F.get(s, k + 1), F.size(line)).alias("b")))
        return let(starts, lambda s: F.transform(ends(s), lambda e: F.array_join(F.slice(line, e["a"] + 1, e["b"] - e["a"]), " ")))

    numbered = lambda ps: F.exists(ps, lambda p: entry_number(p).isNotNull())
    listed = let(lines, lambda ls: let(F.struct(ls.alias("lines"), F.transform(ls, entry_number).alias("numbers")), by_lines))
    return F.filter(let(parts, lambda ps: F.when((F.size(ps) >= 2) & ~numbered(ps), ps).otherwise(listed)), is_entry)


def trim_preamble(references: Column) -> Column:
    """A reference list without what may follow its heading first: a resume up to the next entry, and short blocks that can't be references."""
    squeeze = lambda c: trim(F.regexp_replace(c, r"\s+", " "))
    blocks = F.filter(F.transform(F.split(references, r"\n\s*\n+"), squeeze), lambda b: b != "")
    label = lambda b: (F.char_length(b) <= 140) & _any(b, SUBSECTIONS)

    def cut(bs: Column) -> Column:
        # skip: 0 before the list, 1 inside a resume, 2 in the list
        step = lambda s, b: F.when(s["skip"] == 2, s).when(label(b) | is_entry(b), _at(2, s["n"])).when(b.rlike(RESUME), _at(1, s["n"] + 1)).when((s["skip"] == 1) | ((F.char_length(b) < 220) & ~b.rlike(YEAR)), _at(s["skip"], s["n"] + 1)).otherwise(_at(2, s["n"]))
        n = F.aggregate(bs, _at(0, F.lit(0)), step)["n"]
        return F.when(F.size(bs) == 0, references).otherwise(F.array_join(F.slice(bs, n + 1, F.greatest(F.size(bs), F.lit(1))), "\n\n"))

    return let(blocks, cut)


def _at(skip, n: Column) -> Column:
    return F.struct((skip if isinstance(skip, Column) else F.lit(skip)).cast("int").alias("skip"), n.cast("int").alias("n"))
