"""Routes for crowded groups and very long texts, against brute force."""

import resource
import tracemalloc

import numpy as np
import pytest

from refloom.llm import simhash, suffix_dedup
from tests.llm.test_brute import _key, brute_simhash, brute_suffix, docs  # noqa: F401


def _removed(spark, rows, **options):
    df = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string")
    out = suffix_dedup.cut_repeats(df, **options).collect()
    return _key((r["doc_id"], r["_n_bytes"], sum(b - a for a, b in zip(r["_starts"], r["_ends"], strict=True)), len(r["_starts"])) for r in out)


@pytest.mark.parametrize("crowded", [0, 1024])
def test_hot_strings_and_small_blocks(spark, docs, monkeypatch, crowded):  # noqa: F811
    monkeypatch.setattr(suffix_dedup, "CROWDED", crowded)
    rows = [r for r in docs if r[0] is not None][:120]
    rng = np.random.default_rng(2)
    passage = "a passage that very many of the texts share, of a hundred bytes and some more, so that windows fit in it. "
    rows += [(10_000 + i, " ".join(map(str, rng.integers(0, 99, 20))) + " " + passage + " ".join(map(str, rng.integers(0, 99, 20)))) for i in range(80)]
    assert _removed(spark, rows, hot=5, block_bytes=2048) == _key(r[:4] for r in brute_suffix(rows))


def test_periodic_texts(spark, monkeypatch):
    rows = [(i, "-" * (150 + i % 40) + ("x" if i % 3 else "")) for i in range(300)] + [(400, "ab" * 3000), (401, "x" + "ab" * 3000 + "-" * 500), (402, None), (403, "")]
    want = _key(r[:4] for r in brute_suffix(rows))
    assert _removed(spark, rows) == want
    monkeypatch.setattr(suffix_dedup, "CROWDED", 10)
    assert _removed(spark, rows) == want


def test_memory_of_long_runs_of_one_character():
    """4 MB of one character: what a block's step keeps stays below 1.2 GB."""
    import pyarrow as pa

    b = suffix_dedup.Block(pa.table({"doc_id": [1, 2], "text": ["-" * (4 << 20), "=" * 5000]}), "doc_id", "text")
    doc, pos, val = b.anchors(100)
    order = np.lexsort((pos, val))
    doc, pos, val = doc[order], pos[order], val[order]
    _, group = np.unique(val, return_inverse=True)
    again = b.again(doc, pos, group, 100)
    assert (~again).sum() < 500
    assert resource.getrusage(resource.RUSAGE_SELF).ru_maxrss < 1_200_000


def test_contexts_take_little_memory():
    """Beside the block and the contexts themselves no matrix of places: 8 bytes for each of theirs stopped the pipeline at 0.5 GB."""
    import pyarrow as pa

    rng = np.random.default_rng(3)
    texts = ["".join(map(chr, rng.integers(97, 123, n))) for n in (1_000_000, 30, 99, 100, 101, 160)]
    b = suffix_dedup.Block(pa.table({"doc_id": list(range(6)), "text": texts}), "doc_id", "text")
    b.data  # noqa: B018
    pos = np.concatenate([np.arange(0, 999_951, 25), b.begin[3:], b.begin[3:] + b.size[3:] - 50])
    doc = np.searchsorted(b.begin, pos, "right") - 1
    tracemalloc.start()
    left, right, have_l, have_r = b.contexts(doc, pos, 100)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 8 * 50 * len(pos)
    for i in [0, 1, 2, 3, *range(len(pos) - 8, len(pos))]:
        x, at = texts[doc[i]].encode(), pos[i] - b.begin[doc[i]]
        before, after = x[max(0, at - 50) : at][::-1], x[at + 50 : at + 100]
        assert (left[i].tobytes(), have_l[i]) == (before.ljust(50, b"\0"), len(before))
        assert (right[i].tobytes(), have_r[i]) == (after.ljust(50, b"\0"), len(after))


def test_slices_of_contexts(spark, docs, monkeypatch):  # noqa: F811
    monkeypatch.setattr(suffix_dedup, "SLICE", 3)
    rows = [r for r in docs if r[0] is not None][:120]
    assert _removed(spark, rows, block_bytes=2048) == _key(r[:4] for r in brute_suffix(rows))


def test_long_runs_on_spark(spark):
    rows = [(1, "-" * (4 << 20)), (2, "-" * (4 << 20)), (3, "word " * 200_000)]
    got = _removed(spark, rows)
    assert got == _key([(1, 4 << 20, (4 << 20) - 1, 1), (2, 4 << 20, 4 << 20, 1), (3, 1_000_000, 1_000_000 - 5, 1)])


def test_midpoints_of_crowded_shards(spark, small, docs, monkeypatch):  # noqa: F811
    monkeypatch.setattr(simhash, "TREE", 1)
    got = simhash.op5_simhash(spark, small).select("doc_id", "fingerprint", "component_id").collect()
    assert _key(map(tuple, got)) == _key(brute_simhash(docs))


def test_shingles_are_counted_in_all_texts(spark):
    """However many texts there are; a text's repeats count once."""
    n = 20_000
    texts = spark.range(n).selectExpr("id", "concat('one two three four five ', id) AS text")
    got = simhash._counts(texts, "text", 5)
    common = simhash.shingle_set(simhash._words_of("one two three four five"), 5, simhash._Words())
    assert got.sum() == 2 * n and got[int(common[0] % np.uint64(simhash.COUNTS))] >= n


def _groups(texts):
    """The smallest index that pairs of a similarity of 0.8 or more lead to, all pairs tried."""
    shingles = [{tuple(w[j : j + 5]) for j in range(len(w) - 4)} for w in texts]
    group = list(range(len(texts)))

    def find(x):
        while group[x] != x:
            group[x] = x = group[group[x]]
        return x

    for i, s in enumerate(shingles):
        for j in range(i):
            both = len(s & shingles[j])
            if both >= 0.8 * (len(s) + len(shingles[j]) - both):
                a, b = sorted((find(i), find(j)))
                group[b] = a
    return {i: find(i) for i in range(len(texts))}


def _near(spark, texts):
    df = spark.createDataFrame([(i, " ".join(w)) for i, w in enumerate(texts)], "id long, text string")
    return {r["id"]: r["group"] for r in simhash.near_duplicates(df).collect()}


def test_texts_that_share_a_passage_are_not_paired(spark, monkeypatch):
    """300 texts share most of their words but are not similar, as many more are just similar to each other: pairs that are verified grow with the
    texts, not with their square (44,850 of the first 300 alone)."""
    verified, count = [], simhash._least_distances

    def counted(pairs, p):
        verified.append(pairs.count())
        return count(pairs, p)

    monkeypatch.setattr(simhash, "_least_distances", counted)
    passage = [f"p{i}" for i in range(90)]
    texts = [[f"u{i}x{j}" for j in range(14)] + passage for i in range(300)]
    texts += [[f"v{i}x{j}" for j in range(8 + i % 3)] + passage for i in range(300)]
    assert _near(spark, texts) == {i: i if i < 300 else 300 for i in range(600)}
    assert sum(verified) <= 6 * len(texts)


def test_near_duplicates_at_the_bound(spark):
    """Parts of texts, some edited, of many sizes and with similarities about the least one."""
    rng = np.random.default_rng(7)
    bases = [[f"w{rng.integers(300)}" for _ in range(100)] for _ in range(4)]
    texts = []
    for i in range(700):
        w = list(bases[i % 4])
        a, b = rng.integers(0, 16, 2)
        w = w[int(a) : len(w) - int(b)]
        for _ in range(int(rng.integers(0, 4))):
            w[int(rng.integers(len(w)))] = f"w{rng.integers(300)}" if rng.random() < 0.5 else f"e{rng.integers(40)}"
        texts.append(w if i % 7 else [f"x{i % 50}", *w, f"y{i % 30}"])
    # each pair alone, with no third text that could join it
    for i in range(150):
        w = [f"a{i}x{j}" for j in range(int(rng.integers(30, 90)))]
        texts += [w, w[: max(6, round(0.8 * (len(w) - 4)) + 4 + int(rng.integers(-1, 2)))]]
    assert _near(spark, texts) == _groups(texts)
