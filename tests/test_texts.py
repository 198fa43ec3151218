"""Structure of texts against plain Python, and queries against their SQL."""

import random
import re
import time

import pytest
from pyspark.sql import functions as F

from refloom.functions import places as P
from refloom.operators import manuscript, segments
from refloom.plans import texts
from tests.test_catalog import FOLDERS, _check, duck  # noqa: F401


@pytest.mark.parametrize("where", sorted(FOLDERS))
@pytest.mark.parametrize("name", sorted(texts.ORACLES))
def test_query_matches_sql(spark, duck, name, where):  # noqa: F811
    _check(spark, duck[where], name, texts.QUERIES, texts.ORACLES, FOLDERS[where])


WORD = re.compile(r"[^\W_]|[̀-ͯ]")


def _trim(t, a, b):
    while a < b and t[a] in " \t\n\r\x0b\x0c":
        a += 1
    while b > a and t[b - 1] in " \t\n\r\x0b\x0c":
        b -= 1
    return a, b


def plain_passage(t, start, end, most):
    """The passage by reading on from sentence to sentence."""
    a, b = sorted(max(0, min(x, len(t))) for x in (start, end))
    breaks = list(re.finditer(r"\r?\n[^\S\r\n]*\r?\n", t[:a]))
    after = re.search(r"\r?\n[^\S\r\n]*\r?\n", t[b:])
    pa, pb = _trim(t, breaks[-1].end() if breaks else 0, b + after.start() if after else len(t))
    sentences, at = [], pa
    for m in re.finditer(r"[.!?…]+(?:[\"'’”)\]]+)?(?=\s|$)", t[pa:pb]):
        sentences.append(_trim(t, at, pa + m.end()))
        at = pa + m.end()
    sentences.append(_trim(t, at, pb))
    sentences = [s for s in sentences if s[1] > s[0]]
    hit = next((i for i, (x, y) in enumerate(sentences) if (x <= a <= y if a == b else a < y and b > x)), None)
    x, y = (pa, pb) if hit is None else (sentences[max(0, hit - 1)][0], sentences[min(len(sentences) - 1, hit + 1)][1])
    if y - x <= most:
        return t[x:y], x, y
    word = lambda i: bool(WORD.match(t[i]))
    s = max(x, min(int((a + b) / 2 - most / 2 // 1) if (a + b) / 2 >= most / 2 else x, y - most))
    e = s + most
    if s > x and word(s - 1) and word(s):
        while s < min(a, e) and word(s):
            s += 1
    if e < y and word(e - 1) and word(e):
        while e > max(b, s) and word(e - 1):
            e -= 1
    s, e = _trim(t, s, e)
    return t[s:e], s, e


def test_passages(spark):
    rng = random.Random(6)
    bits = ["alpha", "Beta", "é", ". ", "! ", "?", "…) ", ' said." ', "\n", "\n\n", "\n \n", "  ", "12", ",", "3.5 "]
    rows = []
    for _ in range(400):
        t = "".join(rng.choice(bits) for _ in range(rng.randrange(40)))
        a = rng.randrange(-2, len(t) + 3)
        rows.append((t, a, max(-2, a + rng.randrange(-2, 12)), ))
    rows += [("", 0, 0), ("one", 1, 1)]
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i int, t string, a int, b int")
    for most in (24, 200):
        got = df.select("i", P.passage(F.col("t"), F.col("a"), F.col("b"), most).alias("w")).orderBy("i").collect()
        for r, (t, a, b) in zip(got, rows, strict=True):
            assert tuple(r["w"]) == plain_passage(t, a, b, most), (t, a, b, most)


def test_passages_of_the_query(spark, small):
    docs = {r["doc_id"]: r["t"] for r in texts._with_citations(spark, small).collect()}
    got = texts.citation_windows(spark, small).collect()
    ends = {(r["doc_id"], r["start"]): r["end"] for r in texts.in_text_citations(spark, small).collect()}
    assert len(got) >= 6 * len(docs)
    for r in got:
        t = docs[r["doc_id"]]
        assert (r["text"], r["start"], r["end"]) == plain_passage(t, r["at"], ends[r["doc_id"], r["at"]], 300) and t[r["start"] : r["end"]] == r["text"]


def test_places_are_exact_slices(spark):
    t = ["a1bb22", "", "333", None, "é1é2"]
    got = spark.createDataFrame([(x,) for x in t], "t string").select("t", P.places(F.col("t"), r"\d+").alias("p")).collect()
    for r in got:
        assert [tuple(x) for x in r["p"] or []] == [(m.start(), m[0]) for m in re.finditer(r"\d+", r["t"] or "")]


def test_sentences(spark):
    t = 'One. Two? "Three!" Four\n\nfive...  '
    got = spark.createDataFrame([(t,)], "t string").select(P.sentence_ranges(F.col("t")).alias("s"), P.sentence_at(P.sentence_ranges(F.col("t")), F.lit(6), F.lit(7)).alias("i")).first()
    assert [t[a:b] for a, b in got["s"]] == ["One.", "Two?", '"Three!"', "Four\n\nfive..."] and got["i"] == 1


def _entries(spark, text):
    return spark.createDataFrame([(text,)], "t string").select(segments.split_entries(F.col("t")).alias("e")).first()["e"]


def test_entries(spark):
    assert _entries(spark, "1. Smith, J. A work. 2020.\n2025. More text of it\n2. Doe, A. Other. 2021.") == ["1. Smith, J. A work. 2020. 2025. More text of it", "2. Doe, A. Other. 2021."]
    assert _entries(spark, "Smith, J. One thing. 2020.\n\nDoe, A. Two things. 2021.\n\nnote") == ["Smith, J. One thing. 2020.", "Doe, A. Two things. 2021."]
    assert _entries(spark, "Smith, J. (2020). One thing\nwrapped on here\nDoe, A. (2021). Two") == ["Smith, J. (2020). One thing wrapped on here", "Doe, A. (2021). Two"]
    assert _entries(spark, "") == [] and _entries(spark, None) in (None, [])


def test_segments(spark):
    def seg(t):
        return spark.createDataFrame([(t,)], "t string").select(segments.body_and_references(F.col("t")).alias("s")).first()["s"]

    assert tuple(seg("Body.\nReferences\t12\nmore\nReferences:\r\n1. A")) == ("header", "Body.\nReferences\t12\nmore", "1. A")
    block = "[1] Smith, J. A work. 2020.\ncontinues; here,\n[2] Doe, A. Other. 2021.\n[3] Roe, B. Third. 2019."
    assert tuple(seg("Text that is long enough\n1. Introduction\nwords\n" + block)) == ("numbered", "Text that is long enough\n1. Introduction\nwords", block)
    assert tuple(seg("Text\n[1] Smith 2020\n[2] Doe 2021")) == (None, "Text\n[1] Smith 2020\n[2] Doe 2021", None)
    assert seg("المقدمة\nقائمة المراجع\nSmith, J. 2020")["kind"] == "header" and seg("قائمة المراجع والمصطلحات\nx")["kind"] is None
    assert tuple(seg("")) == (None, "", None) and tuple(seg(None)) == (None, None, None)


def test_citation_forms(spark):
    t = "So [1-3, 7, p. 9] (Smith, 2020a, p. 12) and Müller (1999) [1) (12, 14) <sup>3</sup> [5-2] (O'Neil & de la Cruz; Ek et al., 2001)."
    got = spark.createDataFrame([("a", t), ("b", None), ("c", "")], "k string, t string").transform(lambda d: manuscript.in_text(d, "k", "t")).collect()
    want = [("[1-3, 7, p. 9]", [1, 2, 3, 7], [], "p. 9"), ("(Smith, 2020a, p. 12)", [], ["smith"], "p. 12"), ("Müller (1999)", [], ["muller"], None), ("(1999)", [1999], [], None), ("(12, 14)", [12, 14], [], None), ("<sup>3</sup>", [3], [], None)]
    want.append(("(O'Neil & de la Cruz; Ek et al., 2001)", [], ["o'neil", "de", "ek"], None))
    assert [(r["raw"], r["numbers"], r["families"], r["locator"]) for r in got] == want and all(t[r["start"] : r["end"]] == r["raw"] for r in got)


def test_passages_depend_on_their_surroundings_only(spark):
    """Long texts of few word characters, or of sentences without end, give what reading all of them gives; far text costs nothing."""
    rng = random.Random(7)
    fill = ["))))" * 60, " " * 300, "word " * 200, "One. Two! ", "\n\n", '." ', "...", "a" * 400, "\n" + " " * 200 + "\n", "é, "]
    rows = []
    for _ in range(150):
        t = "".join(rng.choice(fill) for _ in range(rng.randrange(1, 12)))
        a = rng.randrange(len(t) + 1)
        rows.append((t, a, min(len(t), a + rng.choice([0, 1, 9, 90]))))
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i int, t string, a int, b int")
    for most in (24, 300):
        for r, (t, a, b) in zip(df.select("i", P.passage(F.col("t"), F.col("a"), F.col("b"), most).alias("w")).orderBy("i").collect(), rows, strict=True):
            assert tuple(r["w"]) == plain_passage(t, a, b, most), (t, a, b, most)
    long = "A sentence of some words. " * 40_000
    began = time.time()
    at = spark.range(400).select((F.col("id") * 2000).cast("int").alias("a")).select(P.passage(F.lit(long), F.col("a"), F.col("a") + 5, 300).alias("w"))
    assert at.filter(F.char_length("w.text") > 20).count() == 400 and time.time() - began < 60


def test_segments_of_many_lines_and_of_long_ones(spark):
    """Time grows with the text, not with the square of its lines or of a line's sentences."""
    block = "\n".join(f"{i}. Miller, A. A work of some length, {1900 + i % 100}." for i in range(1, 1500))
    long = "He said so. They Went " * 20_000
    began = time.time()
    got = [tuple(r["s"]) for r in spark.createDataFrame([(0, "Words first\n" + block), (1, long)], "i int, t string").orderBy("i").select(segments.body_and_references(F.col("t")).alias("s")).collect()]
    assert got == [("numbered", "Words first", block), (None, long.strip(), None)] or got == [("numbered", "Words first", block), (None, long, None)]
    assert time.time() - began < 60


def test_marks_of_lines(spark):
    old = r"\.\s+[A-Z][\p{L}&]+.*\d{4}"
    rng = random.Random(8)
    rows = [("".join(rng.choice([". ", "Ab", "A", "b&", "1234", "99", " ", "\u2028", "x.", "É"]) for _ in range(rng.randrange(12))),) for _ in range(3000)]
    got = spark.createDataFrame(rows, "t string").select(F.col("t").rlike(old).alias("a"), F.col("t").rlike(segments.MARKS[3]).alias("b")).groupBy("a", "b").count().collect()
    assert {(r["a"], r["b"]) for r in got} == {(True, True), (False, False)}


def test_structure_lowers_a_text_once(spark):
    df = spark.createDataFrame([("Methods\nx\nIntroduction\ny",)], "t string").select(manuscript.structure(F.col("t")).alias("s"))
    assert df._jdf.queryExecution().optimizedPlan().toString().count("lower(") == 1
    assert tuple(df.first()["s"]) == (["introduction", "methods"], ["results", "discussion"], ["methods before introduction"])
