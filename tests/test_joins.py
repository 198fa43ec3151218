"""Joins without equal keys against all pairs; best matches by tokens and similar texts against plain Python."""

import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from refloom.operators import dedup, edits, joins, overlap
from refloom.schema import as_items


def _plan(df):
    return df._jdf.queryExecution().toString()


def test_overlapping_ranges(spark):
    rng = random.Random(1)
    spans = [(k, i, a, a + rng.choice([0, 1, 3, 255, 256, 257, 5000, 90_000, -4])) for k in range(3) for i, a in enumerate(rng.choices(range(100_000), k=60))]
    pages = [(k, i, a, a + rng.choice([0, 1, 256, 700, 70_000])) for k in range(3) for i, a in enumerate(rng.choices(range(100_000), k=60))]
    spans += [(0, 99, 0, 10**12), (None, 1, 0, 5), (0, 98, None, 5)]
    pages += [(0, 99, 0, 10**12), (1, 98, 5, None)]
    s, p = spark.createDataFrame(spans, "k int, s int, span_start long, span_end long"), spark.createDataFrame(pages, "k int, p int, range_start long, range_end long")
    out = joins.overlapping(s, p, "k")
    got = sorted((r["k"], r["s"], r["p"]) for r in out.collect())
    fine = lambda *x: None not in x
    want = sorted((k, i, j) for k, i, a, b in spans for m, j, c, d in pages if fine(k, a, b, c, d) and k == m and b > a and d > a and c < b)
    assert got == want and "NestedLoop" not in _plan(out) and "Cartesian" not in _plan(out)
    assert joins._binned(s, "span").groupBy("k", "s").count().agg(F.max("count")).first()[0] <= 2 * (joins.LEVELS + 1)


def test_containing_texts(spark):
    rng = random.Random(2)
    word = lambda n: "".join(rng.choice("abc ") for _ in range(rng.randrange(n)))
    outer, inner = [(i, word(20)) for i in range(120)] + [(500, "aé😀b")], [(i, word(8)) for i in range(80)] + [(900, "é😀"), (901, "zzzz")]
    out = joins.containing(spark.createDataFrame(outer, "a int, x string"), spark.createDataFrame(inner, "b int, y string"))
    assert sorted(map(tuple, out.collect())) == sorted((i, j) for i, x in outer for j, y in inner if y and x and y in x)
    assert "NestedLoop" not in _plan(out) and "Cartesian" not in _plan(out)


def _distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


@pytest.mark.parametrize("ratio", [0.6, 0.75, 0.9])
def test_similar_texts(spark, ratio):
    rng = random.Random(3)
    base = ["".join(rng.choice("abcde ") for _ in range(rng.randrange(1, 26))) for _ in range(12)]
    rows = []
    for i in range(110):
        t = list(rng.choice(base))
        for _ in range(rng.randrange(7)):
            at = rng.randrange(len(t) + 1)
            t[at : at + rng.randrange(2)] = rng.choice(["", "x", "b"])
        rows.append((i, "".join(t)))
    rows += [(200, None), (201, rows[0][1]), (202, "é"), (203, "é")]
    got = {tuple(r) for r in dedup.similar_texts(spark.createDataFrame(rows, "ord long, t string"), "t", ratio).collect()}
    alike = lambda a, b: a == b or 1 - _distance(a, b) / max(len(a), len(b)) >= ratio - 1e-9
    assert got == {(i, j) for i, a in rows for j, b in rows if i < j and a is not None and b is not None and alike(a, b)}


def test_edges_of_items(spark):
    """Scores of all pairs, with titles, authors, years and DOIs missing here and there."""
    rng = random.Random(4)
    titles, names = ["on the width of things", "on the widths of things", "another matter", "a third one", None], ["Smith Jo", "Smyth Jo", "Doe Anna", None]
    rows = []
    for i in range(60):
        author = rng.choice(names)
        year = rng.choice([1999, 2000, None])
        rows.append((i, str(i), rng.choice(titles), [(author,)] if author else None, ([[year]],) if year else None, rng.choice(["10.1/a", "10.1/A", "10.1/b", None, None, None])))
    df = spark.createDataFrame(rows, "ord long, id string, title string, author array<struct<literal:string>>, issued struct<date_parts:array<array<int>>>, DOI string")
    name, date = "struct(CAST(NULL AS string) AS family, CAST(NULL AS string) AS given, CAST(NULL AS string) AS dropping_particle, CAST(NULL AS string) AS non_dropping_particle, CAST(NULL AS string) AS suffix, a.literal AS literal)", "named_struct('date_parts', issued.date_parts, 'season', CAST(NULL AS string), 'circa', CAST(NULL AS boolean), 'literal', CAST(NULL AS string), 'raw', CAST(NULL AS string))"
    items = as_items(df.selectExpr("ord", "id", "'book' AS type", "title", f"transform(author, a -> {name}) AS author", f"CASE WHEN issued IS NOT NULL THEN {date} END AS issued", "DOI"))
    ratio = lambda a, b: 1 - _distance(a, b) / max(len(a), len(b))

    def score(a, b):
        parts = [(5, float(a[5].lower() == b[5].lower())) if a[5] and b[5] else None, (3, ratio(a[2], b[2])) if a[2] and b[2] else None, (2, ratio(a[3][0][0].lower(), b[3][0][0].lower())) if a[3] and b[3] else None, (1, float(a[4] == b[4])) if a[4] and b[4] else None]
        if not any(parts[:3]):
            return 0
        return sum(w * s for w, s in filter(None, parts)) / sum(w for w, _ in filter(None, parts))

    want = {(a[0], b[0]): score(a, b) for a in rows for b in rows if a[0] < b[0]}
    for threshold in (0.8, 0.6):
        got = {(r["lo"], r["hi"]): r["score"] for r in dedup.edges(items, threshold).collect()}
        assert got == pytest.approx({k: v for k, v in want.items() if v >= threshold})


@pytest.mark.parametrize("dice", [False, True])
def test_best_overlap(spark, dice):
    rng = random.Random(5)
    vocabulary = [f"w{i}" for i in range(40)]
    docs = [(i, list(dict.fromkeys(rng.choices(vocabulary, [1 / (k + 1) for k in range(40)], k=rng.randrange(12))))) for i in range(50)] + [(90, None), (91, [])]
    items = [(i, rng.choices(vocabulary, k=rng.randrange(1, 9))) for i in range(30)] + [(90, None), (91, [])]
    if dice:
        items = [(i, list(dict.fromkeys(t)) if t else t) for i, t in items]
    out = overlap.scored(spark.createDataFrame(docs, "id int, ts array<string>"), spark.createDataFrame(items, "item int, ts array<string>"), dice=dice, others=dice).collect()
    score = {}
    for i, a in docs:
        for j, b in items:
            hits = sum(t in (a or []) for t in b or [])
            if hits and not (dice and i == j):
                score[i, j] = 2 * hits / (len(a) + len(b)) if dice else hits / len(b)
    best = {i: max(s for (k, _), s in score.items() if k == i) for i in {k for k, _ in score}}
    got = {(r["id"], r["item"]): r["score"] for r in out}
    assert len(got) == len(out) and all(score[k] == pytest.approx(s) for k, s in got.items())
    assert {k for k, s in score.items() if s >= min(best[k[0]], overlap.FIRST)} - {k for k, s in score.items() if s < best[k[0]] and s < overlap.FIRST} <= set(got)


def test_similar_texts_send_nothing_through_the_driver(spark):
    """Rows of keys are many times what the files of their texts weigh: none is broadcast, and copies are one row until they are scored."""
    rows = [(i, str(i), f"a title of some length, number {i % 40}", [[2000 + i % 2]] if i % 3 else None) for i in range(400)]
    date = "CASE WHEN y IS NOT NULL THEN named_struct('date_parts', y, 'season', CAST(NULL AS string), 'circa', CAST(NULL AS boolean), 'literal', CAST(NULL AS string), 'raw', CAST(NULL AS string)) END AS issued"
    items = as_items(spark.createDataFrame(rows, "ord long, id string, title string, y array<array<int>>").selectExpr("ord", "id", "'book' AS type", "title", date))
    out = dedup.edges(items)
    assert "Broadcast" not in out._jdf.queryExecution().executedPlan().toString()
    year = lambda r: r[3] and r[3][0][0]
    ratio = lambda a, b: 1 - _distance(a, b) / max(len(a), len(b))
    clean = lambda t: t.replace(",", "")
    known = {(a, b): ratio(clean(a), clean(b)) for a in {r[2] for r in rows} for b in {r[2] for r in rows}}
    score = lambda a, b: (3 * known[a[2], b[2]] + (year(a) == year(b))) / 4 if year(a) and year(b) else known[a[2], b[2]]
    want = {(a[0], b[0]): s for a in rows for b in rows if a[0] < b[0] and (s := score(a, b)) >= 0.8}
    got = out.collect()
    assert len(got) == len(want) and {(r["lo"], r["hi"]): r["score"] for r in got} == pytest.approx(want)


@pytest.mark.parametrize("broadcast", [True, False])
def test_items_are_not_shuffled_for_every_pair(spark, monkeypatch, broadcast):
    """Where items are few no shuffle carries their tokens; either way gives the plain counts."""
    monkeypatch.setattr(overlap, "small", F.broadcast if broadcast else (lambda d: d))
    docs = spark.createDataFrame([(i, [1, 2, 3 + i], 3) for i in range(20)], "id int, ts array<long>, size int")
    items = spark.createDataFrame([(0, [1, 1, 4]), (1, [2, 9]), (2, [3])], "item int, ts array<long>")
    pairs = docs.select("id").crossJoin(items.select("item"))
    out = overlap.shared(pairs, docs, items)
    got = {(r["id"], r["item"]): (r["hits"], r["n"], r["size"]) for r in out.collect()}
    rows = {i: {1, 2, 3 + i} for i in range(20)}
    assert got == {(i, j): (sum(t in rows[i] for t in ts), len(ts), 3) for i in rows for j, ts in enumerate([[1, 1, 4], [2, 9], [3]])}
    if broadcast:
        assert not any("its" in line for line in _plan(out).split("== Physical Plan ==")[-1].splitlines() if "collect_list" in line or "ObjectHashAggregate" in line)


@pytest.mark.parametrize("long", [2048, 30])
def test_close_texts_of_blocks(long, monkeypatch):
    """Blocks of texts with many pieces in common: no pair is missed, and hardly any is named that is not close; before, most shared a key."""
    monkeypatch.setattr(edits, "LONG", long)
    rng = random.Random(6)
    words = ["the ", "and ", "in", "er", "th", "re", "an ", "on", "é", "漢 "]
    base = ["".join(rng.choice(words) for _ in range(rng.choice([1, 14, 14, 14, 40]))) for _ in range(120)]
    texts = list(dict.fromkeys(["", "a", *base, *[t[:at] + rng.choice(["", "x", "th"]) + t[at + rng.randrange(3) :] for t in base[:80] for at in [rng.randrange(len(t) + 1)]]]))
    rng.shuffle(texts)
    known = {(i, j): _distance(texts[i], texts[j]) for i in range(len(texts)) for j in range(i + 1, len(texts))}
    half = len(texts) // 2
    block = lambda at: edits.Texts(np.arange(at.start, at.stop), pa.array(texts[at]))
    a, b = block(slice(0, half)), block(slice(half, len(texts)))
    for ratio in (0.6, 0.75, 0.8):
        want = {p for p, d in known.items() if d <= int((1 - ratio) * max(len(texts[p[0]]), len(texts[p[1]])) + 1e-6)}
        got, sure = [], []
        for x, y in ((a, a), (a, b), (b, b)):
            for i, j, s in edits.close(x, y, ratio):
                pairs = list(zip(*np.sort([x.id[i], y.id[j]], axis=0).tolist(), strict=True))
                got += pairs
                sure += [p for p, fine in zip(pairs, s, strict=True) if fine]
        assert len(got) == len(set(got)) and want <= set(got) and set(sure) <= want
        short = lambda ps: {p for p in ps if min(len(texts[i]) for i in p) <= edits.WORD}  # noqa: E731  others are left to Spark's levenshtein
        assert len(short(got)) <= 1.2 * len(short(want)) + 10 and len(want) > 40


@pytest.mark.parametrize("ratio", [0.5, 0.8])
def test_blocks_meet_their_partners(ratio, monkeypatch):
    """Every two lengths that can hold a close pair share a pair of blocks, whatever blocks they are dealt into; other values share none."""
    monkeypatch.setattr(edits, "LEAST", 200)
    rng = random.Random(7)
    counts = [(w, free, n, rng.choice([1, 3, 60])) for w in (None, 1999, 2000) for free in (True, False) for n in [0, 1, 2, *range(5, 60, 3), 300]]
    blocks, table = edits.dealt(rng.sample(counts, len(counts)), ratio)
    assert set(table) == {c[:3] for c in counts}
    reach = {k: (range(at, at + parts), set(others)) for k, (at, parts, others) in table.items()}
    for (v, free, n), (mine, met) in reach.items():
        for (w, other, m), (others, back) in reach.items():
            meet = {x in back for x in mine} | {y in met for y in others}
            if v == w and (free or other) and abs(n - m) <= edits.allowed(max(n, m), ratio):
                assert meet == {True}
            assert len(meet) == 1 and (meet == {False} or v == w and (free or other))
    rows = {c[:3]: c[3] for c in counts}
    assert all(x[1] <= rows[k] for k, x in table.items())
    assert max(x[1] for x in table.values()) > 1 and blocks == 1 + max(max(r[0]) for r in reach.values())


def test_copies_are_paired_in_many_tasks(spark):
    """The pairs of a text that many rows have come from many tasks; before, they came from one."""
    rows = [(i, str(i), "the same title" if i % 50 else f"the same titles {i % 7}") for i in range(3000)]
    out = dedup.edges(as_items(spark.createDataFrame(rows, "ord long, id string, title string").withColumn("type", F.lit("book")))).withColumn("task", F.spark_partition_id())
    by_task = [r["n"] for r in out.groupBy("task").agg(F.count("*").alias("n"), F.countDistinct("lo", "hi").alias("d")).collect()]
    ratio = lambda a, b: 1 - _distance(a, b) / max(len(a), len(b))
    size = {t: sum(r[2] == t for r in rows) for t in {r[2] for r in rows}}
    want = sum(m * (m - 1) // 2 if s == t else m * n for s, m in size.items() for t, n in size.items() if s <= t and ratio(s, t) >= 0.8)
    assert sum(by_task) == want == out.select("lo", "hi").distinct().count() and max(by_task) < want / 2


def test_rows_of_one_number(spark):
    """Rows that share an ord are scored by their own titles, and make no pair with each other."""
    rows = [(1, "a title of things"), (1, "something else"), (1, "something else"), (2, "a title of thing"), (3, "something elses"), (3, "a title of things"), (4, "far away")]
    out = dedup.edges(as_items(spark.createDataFrame(rows, "ord long, title string").selectExpr("ord", "CAST(ord AS string) AS id", "'book' AS type", "title")))
    ratio = lambda a, b: 1 - _distance(a, b) / max(len(a), len(b))
    want = sorted((a, b, round(r, 6)) for a, s in rows for b, t in rows if a < b and (r := ratio(s, t)) >= 0.8)
    assert sorted((r["lo"], r["hi"], round(r["score"], 6)) for r in out.collect()) == want
