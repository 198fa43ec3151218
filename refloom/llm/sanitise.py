"""Personal data: patterns, and terms of the corpus that give protected entities away.

Patterns find the protected entities (addresses, numbers).  Then the corpus itself says which other terms reveal them: with X a random word of
the corpus, p(c) is the probability that X stands within WINDOW words of entity c, and p(c|t) the same given that X begins term t, a word or a pair of
adjacent words.  The pointwise mutual information log2 p(c|t)/p(c) is what t tells about c, and -log2 p(c) is all there is to tell.  A term
that tells DISCLOSURE of it or more, and does so in MIN_CONTEXTS independent contexts, is generalised wherever it occurs; one that
tells all of it is removed.
"""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from collections import Counter
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import numbered, table, tidy, values, written

KINDS = ("email", "ip", "card", "phone")
TERM = "term"
#: Words on either side of an entity that count as its neighbourhood.
WINDOW = 12
#: Share of an entity's information from which a term discloses it.
DISCLOSURE = 0.9
#: Contexts that must be independent of each other: copies, near copies and shared passages are one.
MIN_CONTEXTS = 3
#: Of all different contexts at least this share must be independent, as near copies with two edits look so.
INDEPENDENT = 0.25
#: Bits of the filters that go to the tasks, whatever the corpus holds: a megabyte.
FILTER_BITS = 1 << 23
#: Disclosing terms go to the tasks up to this number and so many characters in all; more are joined by a shuffle.
BROADCAST_TERMS = 200_000
BROADCAST_CHARS = 16_000_000

_LOCAL = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-"
_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
# in each, a start inside a run of digits that failed at its beginning is not tried again
_IP = re.compile(r"[0-9](?<![0-9][0-9])[0-9]*+(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_DIGIT = re.compile(r"[0-9]")
_WORD = re.compile(r"[^\x20\x09-\x0D]+")
_LEFT = re.compile(r"^[\W_]+")
_RIGHT = re.compile(r"(?<![\W_])[\W_]+$|^[\W_]+$")


def emails(text: str) -> list[tuple[int, int]]:
    """Places of [A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\\.[A-Za-z0-9-]+)+, found from the @ signs, each character being looked at a few times only."""
    out, done, at = [], 0, text.find("@")
    while at >= 0:
        before = text[done:at]
        start = done + len(before.rstrip(_LOCAL))
        done = at + 1
        if start < at and (m := _DOMAIN.match(text, at + 1)):
            out.append((start, m.end()))
            done = m.end()
        at = text.find("@", done)
    return out


def luhn(digits: str) -> bool:
    double = (0, 2, 4, 6, 8, 1, 3, 5, 7, 9)
    return sum(double[ord(c) - 48] if i % 2 else ord(c) - 48 for i, c in enumerate(reversed(digits))) % 10 == 0


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind's number, end) of all pattern matches that hold, in order."""
    out = [(a, 0, b) for a, b in emails(text)] if "@" in text else []
    if _DIGIT.search(text):
        out += [(m.start(), 1, m.end()) for m in _IP.finditer(text) if all(len(p.lstrip("0")) <= 3 and int(p[-3:]) <= 255 for p in m[0].split("."))]
        for m in _CARD.finditer(text):
            if m.end() - m.start() >= 12 and 12 <= len(d := m[0].replace(" ", "").replace("-", "")) <= 19 and luhn(d):
                out.append((m.start(), 2, m.end()))
        if "+" in text:
            out += [(m.start(), 3, m.end()) for m in _PHONE.finditer(text) if 9 <= sum(map(str.isdigit, m[0])) <= 15]
    return sorted(out)


def entity(kind: int, value: str) -> str:
    """What two mentions of one entity share."""
    return f"{KINDS[kind]}:{value.lower() if kind < 2 else ''.join(_DIGIT.findall(value))}"


def normal(word: str) -> str:
    """A word as part of a term: lower case without punctuation at its ends; empty if fewer than three characters are left."""
    w = word if word.isalnum() else _RIGHT.sub("", _LEFT.sub("", word))
    return w.lower() if len(w) >= 3 else ""


def _hash(s: str) -> int:
    """Spark's xxhash64 of a string."""
    return xxhash.xxh64_intdigest(s.encode(), 42)


def _terms(words: list[str], i: int) -> Iterator[str]:
    """The terms that begin at word i: it, and it with the next word; words are normal, an empty one is in no term."""
    if words[i]:
        yield words[i]
        if i + 1 < len(words) and words[i + 1]:
            yield f"{words[i]} {words[i + 1]}"


def sketch(words: list[str]) -> list[int]:
    """Four minima of hashes of three-word shingles: texts of similarity s agree in each with that probability."""
    number: dict[str, int] = {}
    for w in words:
        if w not in number:
            number[w] = _hash(w)
    h = np.array([number[w] for w in words], np.uint64)
    with np.errstate(over="ignore"):
        grams = h[:-2] * np.uint64(0x9E3779B97F4A7C15) + h[1:-1] * np.uint64(0xC2B2AE3D27D4EB4F) + h[2:] if len(h) > 2 else h[:1]
        grams ^= grams >> np.uint64(29)
        return [int((grams * np.uint64(m)).min()) for m in (0x165667B19E3779F9, 0x27D4EB2F165667C5, 0x9FB21C651E98DF25, 0xD6E8FEB86659FD93)]


def contexts(text: str, window: int = WINDOW) -> Iterator[tuple]:
    """For every mention of an entity: the entity, hashes of the two words beyond the neighbourhood on the left and on the right, the text's sketch, and the
    terms that begin in the neighbourhood and that no earlier mention of this entity in the text has listed.

    Words that overlap a pattern's match are in no term.  Where a text ends inside the neighbourhood, its own hash stands for the words
    beyond.
    """
    spans = base_spans(text)
    if not spans:
        return
    found = list(_WORD.finditer(text))
    raw, starts, ends = [m[0] for m in found], [m.start() for m in found], [m.end() for m in found]
    words, own, whole, at = [normal(w) for w in raw], _hash(text), sketch(raw), []
    for a, kind, b in spans:
        first, last = bisect_right(ends, a), bisect_left(starts, b)
        at.append((entity(kind, text[a:b]), first, last))
        words[first:last] = [""] * (last - first)
    seen: dict[str, set[int]] = {}
    for c, first, last in at:
        lo, hi = first - window, last + window
        left = _hash("<" + " ".join(raw[lo - 2 : lo])) if lo >= 2 else own
        right = _hash(">" + " ".join(raw[hi : hi + 2])) if hi + 2 <= len(raw) else own
        old = seen.setdefault(c, set())
        new = [i for i in (*range(max(0, lo), first), *range(last, min(hi, len(raw)))) if i not in old]
        old.update(new)
        yield c, left, right, *whole, [t for i in new for t in _terms(words, i)]


#: Pairs of marks that copies share at least one of: the words beyond the neighbourhood, and two pairs of a text's minima.
MARKS = (("l", "r"), ("m0", "m1"), ("m2", "m3"))


def _independent(min_contexts: int) -> tuple[Column, Column]:
    """Aggregates: the least number of independent contexts, and whether it will do."""
    apart = [F.count_distinct(a) + F.count_distinct(b) - F.count_distinct(a, b) for a, b in MARKS]
    fine = [(k >= min_contexts) & (k >= INDEPENDENT * F.count_distinct(a, b)) for k, (a, b) in zip(apart, MARKS, strict=True)]
    return F.least(*apart), fine[0] & fine[1] & fine[2]


class Filter:
    """Which terms may be of interest, as a bitmap of their hashes and of those of the first words of pairs."""

    def __init__(self, bits: np.ndarray):
        self.bits, self.any, self.known = bits, bool(bits.any()), {}

    def _has(self, s: str) -> bool:
        h = _hash(s) % FILTER_BITS
        return bool(self.bits[h >> 3] >> (h & 7) & 1)

    def _look(self, raw: str) -> tuple[str, bool, bool] | None:
        """The normal word, whether it may be a term and whether it may begin a pair; None if neither."""
        w = normal(raw)
        alone, pair = bool(w) and self._has(w), bool(w) and self._has(w + " ")
        got = (w, alone, pair) if alone or pair else None
        if len(raw) <= 64:
            if len(self.known) >= 200_000:
                self.known.clear()
            self.known[raw] = got
        return got

    def terms(self, words: list[str]) -> Iterator[tuple[str, int, int]]:
        """Terms that pass, with the numbers of their first and last words."""
        known, look = self.known, self._look
        if not self.any:
            return
        for i, raw in enumerate(words):
            got = known[raw] if raw in known else look(raw)
            if got is None:
                continue
            w, alone, pair = got
            if alone:
                yield w, i, i
            if pair and i + 1 < len(words) and (v := normal(words[i + 1])) and self._has(f"{w} {v}"):
                yield f"{w} {v}", i, i + 1


def _filter(terms: DataFrame) -> Filter:
    """A bitmap built by Spark; what comes to the driver is FILTER_BITS at most."""
    first = F.when(F.instr("term", " ") > 0, F.concat(F.substring_index("term", " ", 1), F.lit(" ")))
    each = terms.select(F.explode(F.array_compact(F.array(F.col("term"), first))).alias("t"))
    # the hash is unsigned in tasks, which is the same modulo a power of two
    got = each.select(F.pmod(F.xxhash64("t"), F.lit(FILTER_BITS)).alias("b")).groupBy(F.floor(F.col("b") / 32768).alias("k")).agg(F.bitmap_construct_agg(F.pmod("b", F.lit(32768))).alias("m")).collect()
    bits = np.zeros(FILTER_BITS // 8, np.uint8)
    for r in got:
        bits[r["k"] * 4096 : (r["k"] + 1) * 4096] = np.frombuffer(r["m"], np.uint8)
    return Filter(bits)


def disclosing_terms(docs: DataFrame, text: str = "text", disclosure: float = DISCLOSURE, min_contexts: int = MIN_CONTEXTS, window: int = WINDOW) -> DataFrame:
    """term, entity, share (of the entity's information), contexts, n_term, n_both: for every disclosing term the entity it reveals most of.

    All documents are counted, copies too, since they change p(c|t) in numerator and denominator alike; only evidence is counted in
    independent contexts.  With the marks of a pair (see MARKS) as nodes and every context as an edge, independent ones are components, of which
    there are at least nodes - edges; near copies of a text, and copies of a passage, stay in one component of one pair at least.
    Everything is aggregated by term and entity before it is shuffled; nothing grows with the documents on the driver.
    """
    column = docs.select(F.col(f"`{text}`").alias("text"))

    @tidy
    def near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [r for t in values(batch["text"]) if t for r in contexts(t, window)]
            c, *marks, terms = zip(*rows, strict=True) if rows else ((),) * 8
            signed = [pa.array(np.array(m, np.uint64).view(np.int64)) for m in marks]
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.string()), *signed, pa.array(terms, pa.list_(pa.string()))], ["c", *names, "terms"])

    names = [m for pair in MARKS for m in pair]
    seen = written(column.mapInArrow(near, f"c string, {', '.join(f'{m} long' for m in names)}, terms array<string>"), "contexts")
    k, fine = _independent(min_contexts)
    entities = seen.groupBy("c").agg(F.sum(F.size("terms")).alias("n_c"), fine.alias("fine")).filter("fine").select("c", "n_c")
    near_terms = seen.join(entities, "c").select("c", "n_c", *names, F.explode("terms").alias("term"))
    pairs = near_terms.groupBy("term", "c").agg(F.max("n_c").alias("n_c"), F.count("*").alias("n_both"), k.alias("k"), fine.alias("fine")).filter("fine").drop("fine")
    pairs = written(pairs, "disclosing-pairs")
    wanted = pairs.select("term").distinct()
    maybe = _filter(wanted)

    @tidy
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = Counter()
        for batch in batches:
            for t in values(batch["text"]):
                words = _WORD.findall(t or "")
                n[""] += len(words)
                n.update(x[0] for x in maybe.terms(words))
            if len(n) > 500_000:
                yield pa.RecordBatch.from_arrays([pa.array(list(n)), pa.array(list(n.values()), pa.int64())], ["term", "n"])
                n.clear()
        yield pa.RecordBatch.from_arrays([pa.array(list(n), pa.string()), pa.array(list(n.values()), pa.int64())], ["term", "n"])

    counts = written(column.mapInArrow(count, "term string, n long").groupBy("term").agg(F.sum("n").alias("n_term")), "term-counts")
    words = counts.filter("term = ''").select(F.col("n_term").alias("n")).first()
    total = float(words["n"] if words else 0)
    p = F.least(F.lit(1.0), F.col("n_both") / F.col("n_term"))
    share = 1 - F.log2(p) / F.log2(F.col("n_c") / total)
    shares = pairs.join(counts, "term").filter(F.col("n_c") < total).withColumn("share", share).filter(F.col("share") >= disclosure)
    best = shares.groupBy("term").agg(F.max_by(F.struct("c", "share", "k", "n_term", "n_both"), F.struct("share", "k", "c")).alias("b"))
    return best.select("term", F.col("b.c").alias("entity"), F.col("b.share").alias("share"), F.col("b.k").alias("contexts"), F.col("b.n_term").alias("n_term"), F.col("b.n_both").alias("n_both"))


def term_spans(text: str, words: list[str], terms: Iterable[tuple[str, int, int]], base: list[tuple[int, int, int]]) -> list[tuple[str, int, int]]:
    """(term, start, end) of the terms' occurrences that overlap no pattern's match; punctuation at a term's ends is left out."""
    terms = list(terms)
    if not terms:
        return []
    found = [m.span() for m in _WORD.finditer(text)]
    starts, ends = [a for a, _, _ in base], []
    for _, _, b in base:  # the furthest end of all that start no later
        ends.append(max(b, ends[-1]) if ends else b)
    out = []
    for term, i, j in terms:
        a, b = found[i][0] + len(words[i]) - len(_LEFT.sub("", words[i])), found[j][1] - len(words[j]) + len(_RIGHT.sub("", words[j]))
        k = bisect_left(starts, b)
        if k == 0 or ends[k - 1] <= a:
            out.append((term, a, b))
    return out


SPAN = "struct<kind:string,start:long,end:long,remove:boolean>"
_ARROW = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("remove", pa.bool_())]))


def _spans(base: list[tuple[int, int, int]], terms: Iterable[tuple[int, int, bool]] = ()) -> list[dict]:
    """All spans by start, then kind as listed, then end."""
    every = sorted([(a, k, b, False) for a, k, b in base] + [(a, len(KINDS), b, remove) for a, b, remove in terms])
    return [{"kind": (*KINDS, TERM)[k], "start": a, "end": b, "remove": r} for a, k, b, r in every]


def find(docs: DataFrame, text: str = "text", keep: list[str] | None = None, **options) -> DataFrame:
    """docs with _spans, an array of (kind, start, end, remove) in code points, end exclusive, by start, then kind as listed, then end.

    keep: the columns to return, all by default.  Entities and terms are those of docs' own texts.  A term's occurrence that overlaps a pattern's match is
    left to it.  Texts are read whole, three times.  Few disclosing terms go to the tasks; beyond BROADCAST_TERMS their occurrences are
    joined to them by a shuffle without texts, and to the rows by their number in the scan, with the same result.  A null or empty text has no
    spans.  Repeated rows, null ids and ties are nothing special; an empty table gives an empty result; a column of docs named _spans is replaced.
    options: see disclosing_terms().
    """
    terms = written(disclosing_terms(docs, text, **options).select("term", (F.col("share") > 1 - 1e-9).alias("remove")), "terms")
    n, chars = terms.agg(F.count("*"), F.coalesce(F.sum(F.char_length("term")), F.lit(0))).first()
    small = n <= BROADCAST_TERMS and chars <= BROADCAST_CHARS
    held = {r["term"]: r["remove"] for r in terms.collect()} if small else {}
    maybe = _filter(terms)
    names = [c for c in keep or docs.columns if c.lower() != "_spans"]
    rest = [c for c in names if c.lower() != text.lower()]
    if not small:
        docs = numbered(docs, "_found")
    wide = docs.select(F.struct(F.lit(0).alias("_"), *[F.col(f"`{c}`") for c in rest + ([] if small else ["_found"])]).alias("row"), F.col(f"`{text}`").alias("text"))
    back = len(rest) < len(names)  # whether the text is returned

    @tidy
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for k in range(0, whole.num_rows, 1024):
                batch, out = whole.slice(k, 1024), []
                for t in values(batch["text"]):
                    t = t or ""
                    base, words = base_spans(t), _WORD.findall(t) if held else []
                    out.append(_spans(base, ((a, b, held[x]) for x, a, b in term_spans(t, words, (w for w in maybe.terms(words) if w[0] in held), base))))
                yield pa.RecordBatch.from_arrays([batch["row"], batch["text"] if back else pa.nulls(batch.num_rows, pa.string()), pa.array(out, _ARROW)], ["row", "text", "_spans"])

    out = wide.mapInArrow(scan, f"row {wide.schema['row'].dataType.simpleString()}, text string, _spans array<{SPAN}>")
    columns = [F.col("text").alias(c) if c.lower() == text.lower() else F.col(f"row.`{c}`") for c in names]
    if small:
        return out.select(*columns, "_spans")

    @tidy
    def occurrences(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = []
            for i, t in zip(batch["id"].to_pylist(), values(batch["text"]), strict=True):
                words = _WORD.findall(t or "")
                found += [(i, *x) for x in term_spans(t or "", words, maybe.terms(words), base_spans(t or ""))]
            i, term, a, b = zip(*found, strict=True) if found else ((), (), (), ())
            yield pa.RecordBatch.from_arrays([pa.array(i, pa.int64()), pa.array(term, pa.string()), pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["id", "term", "start", "end"])

    at = docs.select(F.col("_found").alias("id"), F.col(f"`{text}`").alias("text")).mapInArrow(occurrences, "id long, term string, start long, end long")
    told = F.struct(F.lit(TERM).alias("kind"), "start", "end", "remove").cast(SPAN)
    hits = at.join(terms, "term").groupBy("id").agg(F.collect_list(told).alias("told"))
    every = F.concat("_spans", F.coalesce("told", F.array().cast(f"array<{SPAN}>")))
    number = lambda s: F.array_position(F.array(*map(F.lit, (*KINDS, TERM))), s["kind"])
    ordered = F.transform(F.array_sort(F.transform(every, lambda s: F.struct(s["start"].alias("a"), number(s).alias("k"), s["end"].alias("b"), s.alias("s")))), lambda x: x["s"])
    return out.join(hits, F.col("row._found") == F.col("id"), "left").select(*columns, ordered.alias("_spans"))


def shape(s: str) -> str:
    """What a term is generalised to."""
    return "[number]" if all(c.isdigit() or not c.isalnum() for c in s) else "[name]" if s[:1].isupper() else "[word]"


def rewritten(text: str, spans: list[tuple[int, int, str, bool]]) -> str:
    """text with each span (start, end, kind, whether to remove it) replaced; of overlapping spans the first to start, and then the longest, counts."""
    out, at = [], 0
    for a, b, kind, remove in sorted(spans, key=lambda s: (s[0], -s[1])):
        if a >= at:
            out += [text[at:a], "" if remove else shape(text[a:b]) if kind == TERM else f"[{kind}]"]
            at = b
    return "".join(out) + text[at:]


def sanitise(docs: DataFrame, text: str = "text", **options) -> DataFrame:
    """docs with spans found (see find()) and each text rewritten: entities become their kind in brackets, disclosing terms a class ([name], [number],
    [word]) or, where they tell all there is to tell, nothing.  A null text stays null."""

    @F.pandas_udf("string")
    def rewrite(texts: pd.Series, spans: pd.Series) -> pd.Series:
        return pd.Series([None if t is None else rewritten(t, [(x["start"], x["end"], x["kind"], x["remove"]) for x in s]) for t, s in zip(texts, spans, strict=True)])

    return find(docs, text, **options).withColumn(text, rewrite(F.col(f"`{text}`"), F.col("_spans")))


def op13_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find(table(spark, sf_dir, "documents"), keep=["doc_id"])
    joined = lambda c: F.array_join(F.transform(c, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
    base = F.filter("_spans", lambda s: s["kind"] != TERM)
    count = lambda kind: F.size(F.filter("_spans", lambda s: s["kind"] == kind)).cast("long")
    counts = [count(k).alias(f"n_{k}") for k in (*KINDS, TERM)]
    return found.select("doc_id", *counts, F.sha2(joined(base).cast("binary"), 256).alias("base_sha256"), joined(F.col("_spans")).alias("spans"))
