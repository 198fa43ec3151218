"""The grouped empirical-Bayes sums against plain Python."""

import math
from collections import defaultdict

import numpy as np
import pytest

from refloom.llm import quality, suffix_dedup, url_filter


def strength(level):
    """Share and prior strength by moments of [(n, b)]."""
    level = [(n, b) for n, b in level if n > 0]
    if not level:
        return 0.0, 1.0
    n, b = sum(x for x, _ in level), sum(y for _, y in level)
    p = b / n
    spread = sum(y * y / x for x, y in level) - n * p * p
    free = n - sum(x * x for x, _ in level) / n
    between = (spread - (len(level) - 1) * p * (1 - p)) / free if free > 0 else 0
    m = p * (1 - p) / between - 1 if between > 0 else 10_000.0
    return p, min(max(m, 1.0), 10_000.0)


def summed(rows, key):
    out = defaultdict(lambda: [0, 0])
    for r in rows:
        if r[-1] is not None:
            out[key(r)][0] += 1
            out[key(r)][1] += r[-1]
        else:
            out[key(r)]
    return out


def test_url_reputations(spark):
    rng = np.random.default_rng(4)
    rows = []
    for d in range(12):
        for h in range(3):
            bad = rng.random()
            rows += [(f"h{h}.d{d}.{'com' if d % 2 else 'org'}", None if rng.random() < 0.2 else int(rng.random() < bad)) for _ in range(int(rng.integers(1, 40)))]
    rows += [("new.d1.com", None), ("", 1), ("", 0)]
    rows += rows[:50]
    domain, suffix = (lambda h: ".".join(h.split(".")[-2:])), (lambda h: h.split(".")[-1])
    hosts, domains, suffixes = (summed(rows, lambda r, f=f: f(r[0])) for f in (lambda h: h, domain, suffix))
    (p0, ms), (_, md), (_, mh) = strength(suffixes.values()), strength(domains.values()), strength(hosts.values())
    want = {}
    for h, (n, b) in hosts.items():
        (sn, sb), (dn, db) = suffixes[suffix(h)], domains[domain(h)]
        ps = (sb + ms * p0) / (sn + ms)
        pd = (db + md * ps) / (dn + md)
        share = (b + mh * pd) / (n + mh)
        want[h] = (n, b, share, share - 1.645 * math.sqrt(share * (1 - share) / (n + mh + 1)))
    got = {r["host"]: (r["n"], r["b"], r["share"], r["bound"]) for r in url_filter.reputations(spark.createDataFrame(rows, "host string, bad int")).collect()}
    assert got.keys() == want.keys()
    for h in want:
        np.testing.assert_allclose(got[h], want[h], rtol=1e-9)


def test_site_posteriors(spark):
    rng = np.random.default_rng(5)
    docs = [(i, f"s{rng.integers(4)}" if rng.random() < 0.9 else None, f"l{rng.integers(3)}") for i in range(400)] + [(None, "s1", None)]
    labels = [(i, int(rng.random() < 0.2 + 0.1 * (i % 4)), int(rng.random() < 0.3)) for i in range(0, 400, 2)]
    d = spark.createDataFrame(docs, "doc_id long, source string, lang string")
    got, overall = quality.site_posteriors(d, spark.createDataFrame(labels, "doc_id long, toxic int, low int"), "source", "lang")
    got = {(r["_host"], r["_path"]): (r["site_toxic"], r["site_low"]) for r in got.collect()}
    marks = {i: (t, q) for i, t, q in labels}
    want = defaultdict(list)
    for at, f in enumerate(("toxic", "low")):
        rows = [(*x, marks.get(x[0], (None, None))[at]) for x in docs]
        hosts, paths = summed(rows, lambda r: r[1]), summed(rows, lambda r: (r[1], r[2]))
        (p0, mh), (_, mp) = strength(hosts.values()), strength(paths.values())
        assert abs(overall[f] - p0) < 1e-12
        for (h, p), (n, b) in paths.items():
            up = (hosts[h][1] + mh * p0) / (hosts[h][0] + mh)
            share = (b + mp * up) / (n + mp)
            want[h, p].append(math.log(share / (1 - share)))
    assert got.keys() == want.keys()
    for k in want:
        np.testing.assert_allclose(got[k], want[k], rtol=1e-9)


def test_ratios_and_calibration():
    n, b = np.array([9, 0, 4, 100]), np.array([9, 0, 4, 50])
    p = (b + 5 * 0.2) / (n + 5)
    want = np.log(p / (1 - p)) - math.log(0.25)
    np.testing.assert_allclose(quality.shrunken_ratios(n, b, 0.2)[1:], want[1:], rtol=1e-6)
    assert quality.shrunken_ratios(n, b, 0.2)[0] == 0  # no feature
    rng = np.random.default_rng(0)
    x = rng.normal(size=(5000, 3))
    y = (rng.random(5000) < 1 / (1 + np.exp(-(-1 + 2 * x[:, 0])))).astype(float)
    np.testing.assert_allclose(quality.calibrate(x, y, y.mean()), [-1, 2, 0, 0], atol=0.2)
    np.testing.assert_allclose(quality.calibrate(np.zeros((0, 3)), np.zeros(0), 0.5), 0)
    np.testing.assert_allclose(quality.calibrate(np.full((4, 3), 1e6), np.array([0.0, 0, 0, 1]), 0.25)[1:], 0, atol=1e-3)


def test_reader_starts_anew_when_full(monkeypatch):
    monkeypatch.setattr(quality, "CACHE", 4)
    r, fresh = quality.Reader(), quality.Reader()
    for text in ["a b c", "d e f g h i j", "Trash! trash | x", "", None, "a " * 1000]:
        words, form = r.read(text)
        other, form2 = quality.Reader().read(text)
        assert sorted(map(tuple, words)) == sorted(map(tuple, other)) and list(form) == list(form2)
    assert len(fresh.read("Trash! trash trash")[0]) == 1


def test_columns_with_names_that_the_operators_use(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet").limit(60)
    labels = spark.read.parquet(f"{small}/labels.parquet")
    names = ["_host", "_path", "site_toxic", "_evidence", "_row", "_block", "_kept", "_starts", "half", "m1"]
    wide = docs.selectExpr("*", *[f"{i} AS {n}" for i, n in enumerate(names)])
    got = quality.classify(wide, labels)
    assert got.columns == [*wide.columns, "_toxic", "_low", "_keep"] and got.count() == 60
    plain = {r["doc_id"]: r["_toxic"] for r in quality.classify(docs, labels).collect()}
    assert {r["doc_id"]: r["_toxic"] for r in got.collect()} == pytest.approx(plain)
    cut = suffix_dedup.cut_repeats(wide)
    assert cut.count() == 60 and set(docs.columns) <= set(cut.columns)


def test_sample_of_one_repeated_id(spark):
    docs = spark.range(5000).selectExpr("1L AS doc_id", "concat('text ', id % 7) AS text")
    labels = spark.createDataFrame([(1, 1, 0)], "doc_id long, toxic int, low int")
    assert [r["text"] for r in quality._sample(docs, labels, "text", quality.TRAIN_ROWS).collect()] == ["text 0"]
