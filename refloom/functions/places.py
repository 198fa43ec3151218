"""Places of matches and of sentences in a text, in code points, by built-in functions alone."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The end of a sentence, an empty line, and a character of a word.
SENTENCE_END = r"[.!?…]+(?:[\"'’”)\]]+)?(?=\s|$)"
EMPTY_LINE = r"\r?\n[^\S\r\n]*\r?\n"
WORD = r"[\p{L}\p{N}\p{M}]"
#: Characters within which a letter or digit is looked for where a text is cut about a span; without one it is not cut.
EDGE = 64


def let(value: Column, use) -> Column:
    """use(value) with value found once: the lambda of a transform over an array of one names it."""
    return F.transform(F.array(value), use)[0]


def places(text: Column, pattern: str) -> Column:
    """array<struct<start, raw>> of a pattern's matches in order.  What stands between matches is what the text splits into at them, so a fold
    over lengths gives the offsets that matches alone don't have.  Patterns match one character or more."""
    zero = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,raw:string>>").alias("found"))

    def step(s: Column, x: Column) -> Column:
        start = s["at"] + F.char_length(x["piece"])
        return F.struct((start + F.char_length(x["raw"])).alias("at"), F.array_append(s["found"], F.struct(start.alias("start"), x["raw"].alias("raw"))).alias("found"))

    def fold(raw: Column) -> Column:
        both = F.zip_with(F.slice(F.split(text, pattern, -1), 1, F.size(raw)), raw, lambda p, r: F.struct(p.alias("piece"), r.alias("raw")))
        return F.when(F.size(raw) > 0, F.aggregate(both, zero, step)["found"]).otherwise(zero["found"])

    return let(F.regexp_extract_all(text, F.lit(pattern), 0), fold)


def cut(text: Column, start: Column, end: Column) -> Column:
    return F.substring(text, start + 1, F.greatest(end - start, F.lit(0)))


def trimmed(text: Column, start: Column, end: Column) -> Column:
    """struct(start, end) without white space at the ends; a blank range is empty at its end."""
    part = cut(text, start, end)
    left = F.char_length(part) - F.char_length(F.regexp_replace(part, r"^\s+", ""))
    right = F.char_length(part) - F.char_length(F.regexp_replace(part, r"\s+$", ""))
    return F.struct(F.least(start + left, end).cast("int").alias("start"), F.greatest(end - right, F.least(start + left, end)).cast("int").alias("end"))


def _sentences(part: Column, zero: Column, step) -> Column:
    """Folds step(state, start, end) over a text's sentences, from pieces and their ends, so that the text is read once.  The state has `at`, where the
    next piece begins.  What follows the last full stop is a sentence too; blank ones are passed over."""

    def fold(x: Column) -> Column:
        ends = F.array_append(x["raw"], F.lit(""))
        pieces = F.zip_with(x["pieces"], ends, lambda p, r: F.struct(p.alias("p"), r.alias("r")))

        def each(s: Column, x: Column) -> Column:
            whole = F.concat(x["p"], x["r"])
            n = F.char_length(whole)
            first = s["at"] + n - F.char_length(F.regexp_replace(whole, r"^\s+", ""))
            last = s["at"] + F.char_length(F.regexp_replace(whole, r"\s+$", ""))
            moved = lambda c: c.withField("at", s["at"] + n)
            return let(F.struct(first.alias("a"), last.alias("b")), lambda r: F.when(r["b"] > r["a"], moved(step(s, r["a"], r["b"]))).otherwise(moved(s)))

        return F.aggregate(pieces, zero, each)

    return let(F.struct(F.split(part, SENTENCE_END, -1).alias("pieces"), F.regexp_extract_all(part, F.lit(SENTENCE_END), 0).alias("raw")), fold)


def sentence_ranges(text: Column) -> Column:
    """array<struct<start, end>> of a text's sentences."""
    zero = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,end:int>>").alias("found"))
    return _sentences(text, zero, lambda s, a, b: F.struct(s["at"].alias("at"), F.array_append(s["found"], F.struct(a.alias("start"), b.alias("end"))).alias("found")))["found"]


def overlaps(a: Column, b: Column, start: Column, end: Column) -> Column:
    """Whether a span overlaps a range, or a point lies in it or at its ends."""
    return F.when(start == end, (start >= a) & (start <= b)).otherwise((start < b) & (end > a))


def sentence_at(sentences: Column, start: Column, end: Column) -> Column:
    """The number, from 0, of the first sentence that a span overlaps; null if none."""
    numbered = F.transform(sentences, lambda s, i: F.struct(s.alias("s"), i.alias("i")))
    return F.array_min(F.transform(F.filter(numbered, lambda x: overlaps(x["s"]["start"], x["s"]["end"], start, end)), lambda x: x["i"]))


def _around(part: Column, start: Column, end: Column) -> Column:
    """struct(first, last): from the sentence before the first one that a span overlaps to the sentence after it; nulls if there is none."""
    names = ("at", "before", "first", "last", "after")
    zero = F.struct(F.lit(0).alias("at"), *[F.lit(None).cast("int").alias(n) for n in names[1:]])

    def step(s: Column, a: Column, b: Column) -> Column:
        found = s["last"].isNotNull()
        hit = ~found & overlaps(a, b, start, end)
        new = (s["at"], F.when(found, s["before"]).otherwise(a), F.when(hit, F.coalesce(s["before"], a)).otherwise(s["first"]), F.when(hit, b).otherwise(s["last"]), F.when(found, F.coalesce(s["after"], b)))
        return F.struct(*[c.cast("int").alias(n) for n, c in zip(names, new, strict=True)])

    return let(_sentences(part, zero, step), lambda s: F.struct(s["first"].alias("first"), F.coalesce(s["after"], s["last"]).alias("last")))


def paragraph(text: Column, start: Column, end: Column) -> Column:
    """struct(start, end) of the paragraph about a span: between the last empty line before it and the first after it."""
    a = let(places(F.left(text, start), EMPTY_LINE), lambda b: F.when(F.size(b) > 0, F.element_at(b, -1)["start"] + F.char_length(F.element_at(b, -1)["raw"])).otherwise(0))
    b = let(F.regexp_instr(F.substring(text, end + 1, F.lit(1 << 30)), F.lit(EMPTY_LINE)), lambda at: F.when(at > 0, end + at - 1).otherwise(F.char_length(text)))
    return let(F.struct(a.alias("a"), b.alias("b")), lambda x: trimmed(text, x["a"], x["b"]))


def fitted(text: Column, a: Column, b: Column, start: Column, end: Column, most: int) -> Column:
    """struct(start, end): the range a to b, or the `most` characters of it about the middle of the span, without words cut at its ends but
    for the span's own."""
    first = F.greatest(a, F.least(F.floor((start + end) / 2 - most / 2).cast("int"), b - most))
    last = first + most
    run = lambda c, p: F.char_length(F.regexp_extract(c, p, 0))
    inside = lambda at: F.substring(text, at, F.lit(2)).rlike(f"^{WORD}{{2}}$")  # noqa: E731  the characters before and at a place

    def crop(x: Column) -> Column:
        s, e = x["s"], x["e"]
        s2 = F.when((s > a) & inside(s), s + run(cut(text, s, F.least(start, e)), f"^{WORD}*")).otherwise(s)

        def tail(y: Column) -> Column:
            e2 = F.when((e < b) & inside(e), e - run(cut(text, F.greatest(end, y), e), f"{WORD}*$")).otherwise(e)
            return let(e2, lambda z: trimmed(text, y, z))

        return let(s2, tail)

    return F.when(b - a <= most, F.struct(a.cast("int").alias("start"), b.cast("int").alias("end"))).otherwise(let(F.struct(first.cast("int").alias("s"), last.cast("int").alias("e")), crop))


def _near(text: Column, start: Column, end: Column, reach: int) -> Column:
    """struct(a, b): a range of the text about a span with `reach` characters or more on each side.  Where it ends inside the text it begins and ends
    with a letter or digit, so that no sentence end, empty line or white space is cut in two."""
    n = F.char_length(text)
    first, last = F.greatest(start - reach, F.lit(0)), F.least(end + reach, n)
    back = let(cut(text, F.greatest(first - EDGE, F.lit(0)), first), lambda c: let(F.char_length(F.regexp_extract(c, r"(?s)^.*[\p{L}\p{N}]", 0)), lambda k: F.when(k > 0, first - F.char_length(c) + k - 1).otherwise(0)))
    on = let(F.char_length(F.regexp_extract(cut(text, last, last + EDGE), r"^[^\p{L}\p{N}]*[\p{L}\p{N}]", 0)), lambda k: F.when(k > 0, last + k).otherwise(n))
    # in a long blank stretch what is near may be the other end of it
    left = (start <= EDGE) | cut(text, F.greatest(start - EDGE, F.lit(0)), end).rlike(r"\S")
    right = (end + EDGE >= n) | cut(text, start, end + EDGE).rlike(r"\S")
    return F.when(left & right, F.struct(back.cast("int").alias("a"), on.cast("int").alias("b"))).otherwise(F.struct(F.lit(0).alias("a"), n.cast("int").alias("b")))


def passage(text: Column, start: Column, end: Column, most: int = 1500) -> Column:
    """struct(text, start, end): the sentence of a span with one on each side, within its paragraph, cut to `most` characters about the span.

    Offsets outside the text are drawn to its ends, and turned ones are turned back.  An empty text gives an empty passage, a null one null.

    What is cut depends on no more than the `most` characters before and after the span, so sentences are looked for only there: one
    that goes on beyond is cut anyway.
    """
    n = F.char_length(text)
    clamp = lambda c: F.greatest(F.lit(0), F.least(c, n)).cast("int")

    def window(x: Column) -> Column:
        t, a, b = x["t"], x["a"], x["b"]

        def within(p: Column) -> Column:
            first, last = (lambda y: F.coalesce(p["start"] + y["first"], p["start"])), (lambda y: F.coalesce(p["start"] + y["last"], p["end"]))
            return let(_around(cut(t, p["start"], p["end"]), a - p["start"], b - p["start"]), lambda y: fitted(t, first(y), last(y), a, b, most))

        return let(let(paragraph(t, a, b), within), lambda r: F.struct(cut(t, r["start"], r["end"]).alias("text"), (x["from"] + r["start"]).alias("start"), (x["from"] + r["end"]).alias("end")))

    def near(x: Column) -> Column:
        part = lambda w: F.struct(cut(x["t"], w["a"], w["b"]).alias("t"), (x["a"] - w["a"]).alias("a"), (x["b"] - w["a"]).alias("b"), w["a"].alias("from"))
        return let(let(_near(x["t"], x["a"], x["b"], most + 2 * EDGE), part), window)

    return F.when(text.isNotNull(), let(F.struct(text.alias("t"), clamp(F.least(start, end)).alias("a"), clamp(F.greatest(start, end)).alias("b")), near))
