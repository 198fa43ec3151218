"""Runs of words against every period tried in turn."""

import hashlib
import random
import time
import zlib

import pytest

from refloom.llm import runs
from tests.llm.test_brute import EDGE, _key, edge, edge_dir, words  # noqa: F401


def brute_runs(s, min_length=6, min_exponent=4):
    found = []
    for p in range(1, len(s) // min_exponent + 1):
        i = 0
        while i + p < len(s):
            j = i
            while j + p < len(s) and s[j] == s[j + p]:
                j += 1
            w = s[i : j + p]
            if j > i and len(w) >= max(min_length, min_exponent * p) and not any(w[q:] == w[:-q] for q in range(1, p)):
                found.append((i, len(w), p))
            i = j + 1
    return sorted(found, key=lambda r: (r[0], r[2]))


def brute_row(doc_id, text):
    w = words(text)
    n, h = len(w), zlib.crc32(str(doc_id).encode())
    g = h // 10
    if doc_id is not None and h % 10 == 0 and n:
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
    found = brute_runs(w)
    gone = {i for a, length, p in found for i in range(a + p, a + length)}
    best = min(found, key=lambda r: (-r[1], r[0], r[2])) if found else (None, None, None)
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    lines = "".join(f"{a},{b},{c}\n" for a, b, c in found)
    return (doc_id, len(found), *best, 1000 * best[1] // best[2] if found else None, sha(lines), sha(" ".join(x for i, x in enumerate(w) if i not in gone)))


def _query(spark, folder):
    names = ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]
    return _key(map(tuple, runs.op12_word_runs(spark, folder).select(*names).collect()))


def test_runs_of_random_words():
    rng = random.Random(3)
    for _ in range(4000):
        n, k = rng.randrange(48), rng.choice((1, 2, 2, 3, 5))
        s = [rng.randrange(k) for _ in range(n)]
        if n and rng.random() < 0.6:
            a, p = rng.randrange(n), rng.randrange(1, 9)
            s = [s[i] if i < a else s[a + (i - a) % p] for i in range(n)] + s[: rng.randrange(4)]
        for length, exponent in ((6, 4), (1, 3)):
            want = brute_runs(s, length, exponent)
            assert runs.runs_of(s, length, exponent) == want
            assert runs.word_runs([b"%d" % x for x in s], length, exponent) == want


def test_runs_inside_runs_and_separators():
    s = "a b a b a b a b c " * 5 + "x y z " + "q " * 6 + "end"
    assert runs.word_runs(s.encode().split()) == brute_runs(s.split()) and len(brute_runs(s.split())) == 7


@pytest.mark.parametrize("kind", ["one", "two", "nested", "fibonacci", "steps"])
def test_time_in_proportion(kind):
    def text(n):
        if kind == "fibonacci":
            a, b = [0], [0, 1]
            while len(b) < n:
                a, b = b, b + a
            return b[:n]
        if kind == "steps":
            return [x for k in range(1, int((2 * n) ** 0.5)) for x in [0] * k + [1]]
        unit = {"one": [0], "two": [0, 1], "nested": [0] * 99 + [1]}[kind]
        return unit * (n // len(unit))

    took = []
    for n in (40_000, 320_000):
        s, began = text(n), time.process_time()
        runs.runs_of(s)
        took.append((time.process_time() - began) / len(s))
    assert took[1] < 3 * took[0] + 1e-6 and took[1] < 4e-5


def test_query(spark, small):
    docs = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{small}/documents.parquet").collect() if len(words(r["text"])) < 3000]
    known = {d for d, _ in docs}
    assert [r for r in _query(spark, small) if r[0] in known] == _key(brute_row(*d) for d in docs)


def test_query_on_edge_rows(spark, edge_dir):  # noqa: F811
    assert _query(spark, edge_dir) == _key(brute_row(d, t) for d, t, *_ in EDGE)


def test_all_columns_stay_and_texts_collapse(spark):
    rows = [(1, "go go go go go go now", 7, "x"), (None, None, None, None), (2, " \n ", 1, "y"), (2, "no  runs\nhere", 1, "y")]
    df = spark.createDataFrame(rows, "row long, text string, _runs int, words string")
    got = runs.collapse_runs(df).orderBy("text").collect()
    assert got[0].asDict() == {"row": None, "text": None, "words": None, "_runs": []}
    assert [(r["row"], r["text"], [tuple(x) for x in r["_runs"]]) for r in got[1:]] == [(2, "", []), (1, "go now", [(0, 6, 1)]), (2, "no runs here", [])]


def test_very_long_text(spark):
    df = spark.createDataFrame([(1, "lorem ipsum " * 200_000 + "end"), (2, "word " * 300_000)], "doc_id long, text string")
    got = {r["doc_id"]: ([tuple(x) for x in r["_runs"]], r["text"]) for r in runs.collapse_runs(df).collect()}
    assert got == {1: ([(0, 400_000, 2)], "lorem ipsum end"), 2: ([(0, 300_000, 1)], "word")}
