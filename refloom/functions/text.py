"""Text functions as Column expressions; only the diacritic fold needs an Arrow UDF, and that for non-ASCII rows alone."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

# Words that title case and sentence case treat apart.
MINOR_WORDS = "a an the and but or nor for yet so at by in of on to up as if is it".split()
COMMON_WORDS = (
    "the and for are but not you all can had her was one our out has have been this that with they from were many some them than its over such into only other new after "
    "also made did most between during through about using based among within across study analysis effects impact role review results evidence"
).split()
ZERO_WIDTH_AND_BIDI = r"[\u200B-\u200D\u2060\uFEFF\u202A-\u202E\u2066-\u2069]"


def normalize(c: Column) -> Column:
    """Lower case, only a-z, 0-9 and single spaces."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.lower(c), r"[^a-z0-9\s]", ""), r"\s+", " "))


def normalize_phrase(c: Column) -> Column:
    """normalize() without a leading "the"."""
    return normalize(F.regexp_replace(c, r"^\s*[tT][hH][eE]\s+", ""))


@F.pandas_udf(StringType())
def _nfkd(s: pd.Series) -> pd.Series:
    return s.map(lambda t: t if t is None else "".join(c for c in unicodedata.normalize("NFKD", t) if not "̀" <= c <= "ͯ"))


def fold(c: Column) -> Column:
    """Lower case without diacritics; other signs become single spaces."""
    low = F.lower(c)
    plain = F.when(F.octet_length(c) == F.char_length(c), low).otherwise(_nfkd(low))
    return F.trim(F.regexp_replace(plain, "[^a-z0-9]+", " "))


def levenshtein_ratio(a: Column, b: Column) -> Column:
    """1 - distance / longer length; 1 for equal texts, two empty ones included."""
    longer = F.greatest(F.char_length(a), F.char_length(b))
    return F.when(a == b, F.lit(1.0)).otherwise(1 - F.levenshtein(a, b) / longer)


def _capital(w: Column) -> Column:
    return F.concat(F.upper(F.substring(w, 1, 1)), F.lower(F.substring(w, 2, 1 << 20)))


def title_case(c: Column) -> Column:
    return F.array_join(F.transform(F.split(c, " "), lambda w, i: F.when((i == 0) | ~F.lower(w).isin(MINOR_WORDS), _capital(w)).otherwise(F.lower(w))), " ")


def sentence_case(c: Column) -> Column:
    """Lower case but for the first word; unless all is upper case, acronyms of up to five letters and capitalised words that
    are not common stay."""
    mixed = c != F.upper(c)

    def word(w: Column, i: Column) -> Column:
        acronym = mixed & (F.char_length(w) <= 5) & w.rlike("^[A-Z]{2,}$")
        name = mixed & w.rlike("^[A-Z][a-z]") & ~F.lower(w).isin(COMMON_WORDS)
        return F.when(i == 0, _capital(w)).when(acronym | name, w).otherwise(F.lower(w))

    return F.array_join(F.transform(F.split(c, " "), word), " ")


def page_range(c: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(c, "[–—]", "-"), r"\s*-\s*", "-")


def sanitize(c: Column) -> Column:
    """Without zero-width and bidirectional control characters."""
    return F.regexp_replace(c, ZERO_WIDTH_AND_BIDI, "")


def clean_extracted(c: Column) -> Column:
    """Text of a page: ligatures spelled out, words joined that a line end had cut, at most one blank line in a row."""
    out = F.regexp_replace(c, "\r\n?", "\n")
    for sign, letters in (("ﬀ", "ff"), ("ﬁ", "fi"), ("ﬂ", "fl"), ("ﬃ", "ffi"), ("ﬄ", "ffl")):
        out = F.replace(out, F.lit(sign), F.lit(letters))
    out = F.regexp_replace(out, "([A-Za-z])-\n([a-z])", "$1$2")
    return F.trim(F.regexp_replace(F.regexp_replace(out, "[ \t]+\n", "\n"), "\n{3,}", "\n\n"))


def html_to_text(c: Column) -> Column:
    """A plain reading of markup: scripts and styles out, tags to spaces, white space collapsed."""
    out = F.regexp_replace(c, r"(?is)<script[^>]*>.*?</script>", " ")
    out = F.regexp_replace(F.regexp_replace(out, r"(?is)<style[^>]*>.*?</style>", " "), "<[^>]+>", " ")
    return F.trim(F.regexp_replace(out, r"\s+", " "))


def escape_markup(c: Column) -> Column:
    for sign, name in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        c = F.replace(c, F.lit(sign), F.lit(name))
    return c


def truncate(c: Column, n: int) -> Column:
    return F.when(F.char_length(c) > n, F.concat(F.left(c, F.lit(n - 1)), F.lit("…"))).otherwise(c)


def collapse(c: Column) -> Column:
    return F.trim(F.regexp_replace(c, r"\s+", " "))


def quotes(source: Column, quote: Column) -> Column:
    """Whether quote stands in source word for word, as it is or with white space collapsed.  A blank one doesn't."""
    return (F.trim(quote) != "") & (source.contains(quote) | collapse(source).contains(collapse(quote)))


def tokens(c: Column, least: int = 3) -> Column:
    """Lower-cased words of letters and digits with at least so many characters, repeats included."""
    parts = F.split(F.regexp_replace(F.lower(c), r"[^\p{L}\p{N}\s]+", " "), r"\s+")
    return F.filter(parts, lambda t: F.char_length(t) >= least)


def dice(a: Column, b: Column) -> Column:
    """2 * common / all of two token sets; 0 if one is empty."""
    x, y = F.array_distinct(a), F.array_distinct(b)
    n = F.size(x) + F.size(y)
    return F.when((F.size(x) == 0) | (F.size(y) == 0), F.lit(0.0)).otherwise(2 * F.size(F.array_intersect(x, y)) / n)


def long_words(normal: Column, least: int = 3) -> Column:
    return F.filter(F.split(normal, " "), lambda w: F.char_length(w) >= least)


def containment(part: Column, whole: Column) -> Column:
    """Share of part's tokens, repeats included, that whole has; 0 without tokens."""
    p = tokens(part)
    return F.when(F.size(p) == 0, F.lit(0.0)).otherwise(F.size(F.filter(p, lambda t: F.array_contains(tokens(whole), t))) / F.size(p))


def overlap(passage: Column, source: Column) -> Column:
    """struct(score, bucket, terms): share of the passage's distinct tokens that the source has, and the first 30 of them."""
    p, s = F.array_distinct(tokens(passage)), F.array_distinct(tokens(source))
    both = F.array_intersect(p, s)
    score = F.size(both) / F.greatest(F.lit(1), F.size(p))
    return F.struct(score.alias("score"), bucket(score).alias("bucket"), F.slice(both, 1, 30).alias("terms"))


def bucket(score: Column) -> Column:
    return F.when(score < 0.25, "low").when(score < 0.5, "medium").otherwise("high")


def rolling_hash(c: Column) -> Column:
    """h = h * 31 + code of each character, kept to 32 bits."""
    codes = F.transform(F.split(c, ""), lambda ch: F.ascii(ch).cast("long"))
    return F.aggregate(F.filter(codes, lambda x: x > 0), F.lit(0).cast("long"), lambda h, x: F.pmod(h * 31 + x, F.lit(4294967296)))
