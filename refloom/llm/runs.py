"""Periodic runs of words: Lyndon arrays over an ordered alphabet, without suffix structures and hashes.

A run is a stretch with smallest period p that no neighbouring word extends.  Of every run one Lyndon root is, in the order of words or in the
reversed one, the longest Lyndon word at its place, so its right neighbour is the next smaller suffix at distance p.  One pass from right to
left finds for every place the next smaller suffix and how far both suffixes agree: of three suffixes the agreement of two follows from the
other two wherever those differ, and where it doesn't, words are compared only up to what was matched before at the same distance.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table, tidy

MIN_LENGTH = 6
MIN_EXPONENT = 4


def next_smaller(s: list[int]) -> tuple[list[int], list[int]]:
    """For every place of s the place of the next smaller suffix (len(s) if none) and how many symbols both suffixes share.

    matched[d] is the leftmost stretch known to agree with what stands d further: its first place and its end.  Symbols inside it are not
    compared again, so every symbol is compared once for a distance at most.
    """
    n = len(s)
    nss, ext = [n] * n, [0] * n
    matched: dict[int, tuple[int, int]] = {}
    s = [*s, -1]  # the end is smaller than every symbol
    for i in range(n - 2, -1, -1):
        j, same = i + 1, 0
        while True:
            d = j - i
            at = i + same
            first, end = matched.get(d, (n, n))
            while at < first and s[at] == s[at + d]:
                at += 1
            if at >= first:
                at = max(at, end)
            if at > i:
                matched[d] = (i, at)
            same = at - i
            if s[at] > s[at + d]:
                break
            # the suffix at i is smaller: on to the next smaller one of j, as long as its place in the order is known without comparing
            while j < n and ext[j] > same:
                j = nss[j]
            if j == n:
                break
            if ext[j] < same:
                j, same = nss[j], ext[j]
                break
            j = nss[j]
            if j == n:
                same = 0
                break
        nss[i], ext[i] = j, same if j < n else 0
    return nss, ext


def runs_of(s: list[int], min_length: int = MIN_LENGTH, min_exponent: int = MIN_EXPONENT) -> list[tuple[int, int, int]]:
    """(start, length, period) of all runs of at least min_length symbols and min_exponent >= 3 periods, in order.

    Such runs have a root whose agreement with the next smaller suffix is a period or more; the leftmost one is at most a period right of the
    run's start, so that left extensions cost no more than the runs are long.
    """
    found = set()
    top = max(s, default=0)
    for symbols in (s, [top - x for x in s]):
        nss, ext = next_smaller(symbols)
        leftmost = {}
        for i in range(len(s) - 1, -1, -1):
            p = nss[i] - i
            if ext[i] >= p:
                leftmost[p, nss[i] + ext[i]] = i
        for (p, end), i in leftmost.items():
            while i > 0 and s[i - 1] == s[i - 1 + p]:
                i -= 1
            if end - i >= max(min_length, min_exponent * p):
                found.add((i, end - i, p))
    return sorted(found, key=lambda r: (r[0], r[2]))


def _stretches(ids: np.ndarray, times: int, min_length: int) -> list[tuple[int, int]]:
    """Stretches of min_length or more words of which each occurs in its stretch often enough to stand in all periods of a run.  A word that
    doesn't is in no run and borders on none that it could extend, so every run lies inside one stretch."""
    parts, fine = [(0, len(ids))], []
    while parts:
        a, b = parts.pop()
        at = ids if b - a == len(ids) else np.unique(ids[a:b], return_inverse=True)[1]
        rare = np.flatnonzero(np.bincount(at)[at] < times)
        if not len(rare):
            fine.append((a, b))
            continue
        cuts = np.concatenate(([-1], rare, [b - a]))
        for k in np.flatnonzero(np.diff(cuts) > min_length):
            parts.append((a + int(cuts[k]) + 1, a + int(cuts[k + 1])))
    return fine


def word_runs(words: list[bytes], min_length: int = MIN_LENGTH, min_exponent: int = MIN_EXPONENT) -> list[tuple[int, int, int]]:
    """runs_of() of a text's words."""
    if len(words) < min_length:
        return []
    number: dict[bytes, int] = {}
    ids = np.fromiter([number.setdefault(w, len(number)) for w in words], np.int64, len(words))
    found = []
    for a, b in _stretches(ids, min_exponent, min_length):
        found += [(a + i, length, p) for i, length, p in runs_of(ids[a:b].tolist(), min_length, min_exponent)]
    return sorted(found, key=lambda r: (r[0], r[2]))


def collapsed(words: list[bytes], runs: Iterable[tuple[int, int, int]]) -> bytes:
    """The words joined by one space, without those that a run contains after its first period."""
    gone = np.zeros(len(words), bool)
    for start, length, period in runs:
        gone[start + period : start + length] = True
    return b" ".join([words[i] for i in np.flatnonzero(~gone)] if gone.any() else words)


def collapse_runs(docs: DataFrame, text: str = "text", min_length: int = MIN_LENGTH, min_exponent: int = MIN_EXPONENT) -> DataFrame:
    """docs with each text reduced to the words that no run holds after its first period, joined by one space, and with _runs, an array of
    (start, length, period) in words of the text from 0, in order.

    Words are [^\\x20\\x09-\\x0D]+.  Texts are worked on one by one in the tasks that read them, whole and without a shuffle; the time is in
    proportion to the words, also of periodic texts, and memory about 100 bytes for each word of the longest text.  An empty text, or
    one of white space, has no runs and becomes empty; a null text stays null, with no runs.  Rows don't depend on each other, so null ids, ties, repeated
    rows and empty tables are nothing special; a column of docs named _runs is replaced.
    """
    if min_exponent < 3 or min_length < 1:
        raise ValueError("runs are found from three periods and one word on")
    keep = [c for c in docs.columns if c.lower() != "_runs"]
    place = next(i for i, c in enumerate(keep) if c.lower() == text.lower())
    run = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))

    @tidy
    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for k in range(0, whole.num_rows, 512):
                batch = whole.slice(k, 512)
                runs, texts = [], []
                for t in batch[0].field(place).cast(pa.binary()).to_pylist():
                    words = (t or b"").split()
                    found = word_runs(words, min_length, min_exponent)
                    runs.append([{"start": a, "length": b, "period": c} for a, b, c in found])
                    texts.append(None if t is None else collapsed(words, found).decode())
                fields = [batch[0].field(i) for i in range(len(keep))]
                fields[place] = pa.array(texts, pa.string())
                row = pa.StructArray.from_arrays(fields, fields=[f.with_type(a.type) for f, a in zip(batch[0].type, fields, strict=True)])
                yield pa.RecordBatch.from_arrays([row, pa.array(runs, run)], ["row", "_runs"])

    wide = docs.select(F.struct(*[F.col(f"`{c}`") for c in keep]).alias("row"))
    return wide.mapInArrow(search, f"row {wide.schema['row'].dataType.simpleString()}, _runs array<struct<start:long,length:long,period:long>>").select("row.*", "_runs")


def repeated_tail(text: Column, doc_id: Column) -> Column:
    """The text with the periodic part that the query's contract plants in about a tenth of the documents: h is the CRC-32 of the decimal
    doc_id and g = floor(h / 10); where h % 10 = 0, words from a = g % n on repeat the first p = 1 + floor((n - a) / (3 + g % 8)) of them.
    Other texts, null and wordless ones and those without doc_id stay as they are."""
    h = F.crc32(doc_id.cast("string").cast("binary"))
    g = F.floor(h / 10)

    def planted(x: Column) -> Column:
        w, n, a, p = x["w"], x["n"], x["a"], x["p"]
        place = lambda i: F.when(i < a, i).otherwise(a + F.pmod(i - a, p))
        return F.when(n > 0, F.array_join(F.transform(F.sequence(F.lit(0), F.greatest(n, F.lit(1)) - 1), lambda i: F.get(w, place(i))), " "))

    # every transform over an array of one names what the next one uses, so that nothing is worked out again for each word
    words = F.filter(F.split(text, r"[\x20\x09-\x0D]+"), lambda w: w != "")
    sized = F.transform(F.array(words), lambda w: F.struct(w.alias("w"), F.size(w).alias("n"), F.pmod(g, F.greatest(F.size(w), F.lit(1))).cast("int").alias("a"), (3 + F.pmod(g, F.lit(8))).alias("k")))
    dealt = F.transform(sized, lambda x: F.struct(x["w"].alias("w"), x["n"].alias("n"), x["a"].alias("a"), (1 + F.floor((x["n"] - x["a"]) / x["k"])).cast("int").alias("p")))
    return F.coalesce(F.when(F.pmod(h, F.lit(10)) == 0, F.transform(dealt, planted)[0]), text)


def op12_word_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", repeated_tail(F.col("text"), F.col("doc_id")).alias("text"))
    longest = F.array_min(F.transform("_runs", lambda r: F.struct((-r["length"]).alias("l"), r["start"].alias("start"), r["period"].alias("period"))))
    lines = F.array_join(F.transform("_runs", lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n"))), "")
    digest = lambda c: F.sha2(c.cast("binary"), 256)
    found = collapse_runs(docs).select("*", longest.alias("m"))
    return found.select(
        "doc_id",
        F.size("_runs").cast("long").alias("n_runs"),
        F.col("m.start").alias("start"),
        (-F.col("m.l")).alias("length"),
        F.col("m.period").alias("period"),
        F.floor(-1000 * F.col("m.l") / F.col("m.period")).alias("exponent_milli"),
        digest(lines).alias("runs_sha256"),
        digest(F.coalesce("text", F.lit(""))).alias("collapsed_sha256"),
    )
