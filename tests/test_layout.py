"""Page layout against a sequential reading; queries of formats against their SQL."""

import random
import re

import pytest

from refloom.plans import formats
from refloom.sources import layout
from tests.test_catalog import FOLDERS, _check, duck  # noqa: F401


@pytest.mark.parametrize("where", sorted(FOLDERS))
@pytest.mark.parametrize("name", sorted(formats.ORACLES))
def test_query_matches_sql(spark, duck, name, where):  # noqa: F811
    _check(spark, duck[where], name, formats.QUERIES, formats.ORACLES, FOLDERS[where])


def _cite(t):
    c = "".join(t.split())
    return 0 < len(t.strip()) <= 24 and any(x.isdigit() for x in c) and len(re.findall(r"[\d,.;:\-–—·()\[\]]", c)) >= 0.55 * len(c)


def plain_page(runs, width=612.0):
    """runs: (x, y, size, text) in order."""
    sizes = sorted(s for *_, s, _ in runs if s > 0)
    median = sizes[len(sizes) // 2] if sizes else 0

    def up(size, text):
        if median <= 0 or size <= 0:
            return False
        n, ratio = len(text.strip()), size / median
        return (n <= 8 and (_cite(text) or n <= 3)) if ratio < 0.46 else ratio < 0.68 and _cite(text)

    xs = [r[0] for r in runs]
    lo, span = min(xs), max(xs) - min(xs)
    if len(runs) >= 20 and span >= width * 0.4 and span > 0:
        bins = [0] * 16
        for x in xs:
            bins[min(15, max(0, int((x - lo) / span * 16)))] += 1
        left, right, valley = max(bins[:6]), max(bins[10:]), min(bins[6:10])
        if left >= len(runs) * 0.15 and right >= len(runs) * 0.15 and valley < min(left, right) * 0.4:
            runs = sorted((r for r in runs if r[0] < lo + span / 2), key=lambda r: -r[1]) + sorted((r for r in runs if r[0] >= lo + span / 2), key=lambda r: -r[1])
    lines = []
    for r in runs:
        line = next((k for k in lines if abs(k[0] - r[1]) <= 2.5), None)
        if line is None:
            lines.append(line := (r[1], []))
        line[1].append(r)
    out = []
    for _, items in lines:
        text, end, high = "", None, False
        for x, _, size, t in sorted(items, key=lambda r: r[0]):
            text += " " if end is not None and x - end > 1.5 else ""
            text += "^" if up(size, t) and not high else ""
            high, text, end = up(size, t), text + t, x + len(t) * size * 0.5
        out.append(text.strip(" "))
    return [t for t in out if t]


def _pages(rows):
    pages = {}
    for r in sorted(rows, key=lambda r: (r[0], r[1])):
        pages.setdefault(r[0], []).append(r[2:])
    return pages


def test_random_pages(spark):
    rng = random.Random(9)
    rows = []
    for page in range(60):
        columns = rng.choice([1, 2])
        for i in range(rng.choice([1, 5, 25, 60])):
            x = rng.choice([20.0, 30.5, 60.0]) + (rng.randrange(columns) * 330) if columns == 2 else rng.random() * 500
            rows.append((page, i, x, 700 - rng.randrange(12) * 12 + rng.random() * 3, rng.choice([10.0, 10.0, 10.0, 6.0, 4.0, 0.0, -10.0]), rng.choice(["word", "12", "3,4", "a", "(b)", "–", " "])))
    df = spark.createDataFrame([*rows, (99, 1, 1.0, 1.0, 1.0, ""), (99, 2, None, 1.0, 1.0, "x")], "page int, ord int, x double, y double, size double, text string")
    got = {r["page"]: r["lines"] for r in layout.page_lines(df, ["page"]).collect()}
    assert got == {p: plain_page([(x, y, abs(s), t) for x, y, s, t in rs]) for p, rs in _pages(rows).items()}


def test_pages_of_the_query(spark, small):
    rows = [((r["doc_id"], r["page"]), r["ord"], r["x"], r["y"], r["size"], r["text"]) for r in formats._glyphs(spark, small).filter("text != ''").collect()]
    got = {(r["doc_id"], r["page"]): r["text"] for r in formats.page_layout(spark, small).collect()}
    want = {p: "\n".join(plain_page(rs)) for p, rs in _pages(rows).items()}
    assert got == want and len(want) > 200 and any("^" in t for t in want.values())


def test_pages_over_several_batches(spark):
    """Pages that end inside a batch, with it, or go on through many; keys may be null."""
    rng = random.Random(11)
    rows = []
    for page, n in enumerate([3, 40, 7, 7, 90, 1, 25, 30]):
        for i in range(n):
            rows.append((None if page == 5 else page, i, rng.choice([20.0, 350.0]) + rng.random(), 700 - rng.randrange(10) * 12 + rng.random() * 3, rng.choice([10.0, 4.0]), rng.choice(["word", "12", "é😀", " "])))
    df = spark.createDataFrame(rows, "page int, ord int, x double, y double, size double, text string")
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, "7")
    try:
        out = layout.page_lines(df, ["page"])
        got = {r["page"]: r["lines"] for r in out.collect()}
    finally:
        spark.conf.set(name, before)
    pages = {}
    for r in rows:
        pages.setdefault(r[0], []).append(r[2:])
    assert got == {p: plain_page(rs) for p, rs in pages.items()}
    assert "MapInArrow" in out._jdf.queryExecution().toString()  # not a fold over structs for every run
