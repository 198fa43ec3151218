"""Operators against brute force on the smallest tables and on rows with nulls, ties, repetitions and clashing columns."""

import hashlib
import re
from collections import defaultdict

import numpy as np
import pytest
import xxhash

from refloom.llm import decontaminate, mixing, preferences, simhash, suffix_dedup, tokens, topk, url_filter

LONG = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon phi chi psi omega"
EDGE = [(1, LONG, "a", 1), (2, LONG, "a", 1), (2, LONG, "a", 1), (3, None, None, 2), (4, "", "b", 3), (5, "one", "b", 4), (None, "two words", "c", 5), (6, LONG.upper() + " " + LONG, "c", 6), (7, "é ü " * 60, None, 7)]


@pytest.fixture(scope="module")
def docs(spark, small):
    return [tuple(r) for r in spark.read.parquet(f"{small}/documents.parquet").select("doc_id", "text", "source").collect()]


@pytest.fixture(scope="module")
def edge(spark):
    """Extra columns clash with names that operators use or add."""
    return spark.createDataFrame(EDGE, "doc_id long, text string, source string, size long").selectExpr("*", "1 AS n", "2 AS hash", "3 AS fp", "4 AS w", "5 AS _row", "6 AS target", "'x' AS lang")


@pytest.fixture(scope="module")
def edge_dir(spark, edge, small, tmp_path_factory):
    d = tmp_path_factory.mktemp("edge")
    edge.write.parquet(f"{d}/documents.parquet")
    for t in ("embeddings", "pages", "benchmark", "labels", "conversations"):
        spark.read.parquet(f"{small}/{t}.parquet").write.parquet(f"{d}/{t}.parquet")
    return str(d)


@pytest.fixture(scope="module")
def empty_dir(spark, small, tmp_path_factory):
    d = tmp_path_factory.mktemp("empty")
    for t in ("documents", "embeddings", "pages", "benchmark", "labels", "conversations"):
        spark.read.parquet(f"{small}/{t}.parquet").limit(0).write.parquet(f"{d}/{t}.parquet")
    return str(d)


def _key(rows):
    return sorted(rows, key=repr)


def words(text):
    return [w.decode() for w in re.findall(rb"[^\x20\x09-\x0D]+", (text or "").encode())]


def lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


# removal of repeated strings


def brute_suffix(rows, t=100):
    rows = sorted(rows, key=lambda r: (r[0] is None, r[0] or 0, (r[1] or "").encode()))
    seen, out = set(), []
    for doc_id, text, *_ in rows:
        b = (text or "").encode()
        gone = bytearray(len(b))
        for i in range(len(b) - t + 1):
            w = hash(b[i : i + t])
            if w in seen:
                gone[i : i + t] = b"\x01" * t
            seen.add(w)
        kept = bytes(c for c, g in zip(b, gone, strict=True) if not g)
        out.append((doc_id, len(b), sum(gone), len(re.findall(rb"\x01+", bytes(gone))), hashlib.sha256(kept).hexdigest()))
    return out


def test_suffix_dedup(spark, small, docs):
    got = suffix_dedup.op4_suffix_dedup(spark, small).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256").collect()
    assert _key(map(tuple, got)) == _key(brute_suffix(docs))


def test_suffix_dedup_edge_rows(spark, edge_dir):
    got = suffix_dedup.op4_suffix_dedup(spark, edge_dir).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256").collect()
    assert _key(map(tuple, got)) == _key(brute_suffix(EDGE))


# SimHash


def brute_simhash(rows):
    fps = []
    for doc_id, text, *_ in rows:
        w = lower(" ".join(words(text))).split(" ") if words(text) else []
        sh = [" ".join(w[i : i + 3]) for i in range(len(w) - 2)] if len(w) >= 3 else [" ".join(w)] if w else []
        h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in sh]
        fps.append((doc_id, sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))))
    uniq = sorted({f for _, f in fps})
    group = {f: f for f in uniq}

    def find(x):
        while group[x] != x:
            x = group[x]
        return x

    for i, a in enumerate(uniq):
        for b in uniq[i + 1 :]:
            if (a ^ b).bit_count() <= 2:
                group[find(a)] = find(b)
    least = {}
    for doc_id, f in fps:
        if doc_id is not None:
            least[find(f)] = min(least.get(find(f), doc_id), doc_id)
    return [(doc_id, f"{f:016x}", least.get(find(f))) for doc_id, f in fps]


def test_simhash(spark, small, docs):
    got = simhash.op5_simhash(spark, small).select("doc_id", "fingerprint", "component_id").collect()
    assert _key(map(tuple, got)) == _key(brute_simhash(docs))


def test_simhash_edge_rows(spark, edge_dir):
    got = simhash.op5_simhash(spark, edge_dir).select("doc_id", "fingerprint", "component_id").collect()
    assert _key(map(tuple, got)) == _key(brute_simhash(EDGE))


def test_bk_tree_finds_all_within_radius():
    rng = np.random.default_rng(1)
    values = [int(x) & 0xFFFF for x in rng.integers(0, 1 << 16, 400)]
    tree = simhash.BKTree()
    for v in values:
        tree.add(v)
    for q in values[:50]:
        assert sorted(v for _, v in tree.within(q, 3)) == sorted({v for v in values if (v ^ q).bit_count() <= 3})


def test_near_duplicates_link_what_is_similar(spark, docs):
    shingles = {}
    for i, (_, text, _) in enumerate(docs):
        w = lower(" ".join(words(text))).split(" ") if words(text) else []
        shingles[i] = {tuple(w[j : j + 5]) for j in range(len(w) - 4)} or {tuple(w)}
    group = {i: i for i in shingles}

    def find(x):
        while group[x] != x:
            x = group[x]
        return x

    for i in shingles:
        for j in range(i):
            both = len(shingles[i] & shingles[j])
            if both >= 0.8 * (len(shingles[i]) + len(shingles[j]) - both):
                a, b = sorted((find(i), find(j)))
                group[b] = a
    df = spark.createDataFrame([(i, r[1]) for i, r in enumerate(docs)], "id long, text string")
    got = {r["id"]: r["group"] for r in simhash.near_duplicates(df).collect()}
    assert got == {i: find(i) for i in shingles}


def test_near_duplicates_of_copies_of_copies(spark):
    """Thousands of edited copies of edited copies: every link between members of a crowded shard counts."""
    rng = np.random.default_rng(5)
    bases = [[f"w{rng.integers(500)}" for _ in range(60)] for _ in range(3)]
    common = [f"c{i}" for i in range(12)]
    texts = [b + common for b in bases]
    while len(texts) < 2000:
        w = list(texts[int(rng.integers(len(texts)))])
        for _ in range(int(rng.integers(1, 4))):
            w[int(rng.integers(len(w)))] = f"w{rng.integers(500)}"
        texts.append(w)
    # 150 pairs of similar sets whose fingerprints are far apart by repeats, among texts that are not quite similar
    model = [f"m{i}" for i in range(200)]
    for _ in range(150):
        w = list(model)
        for at in rng.choice(np.arange(4, 196), 3, replace=False):
            w[int(at)] = f"v{rng.integers(10**6)}"
        texts += [w + model[20:30] * 60, w + model[100:110] * 60]
    shingles = [{tuple(w[j : j + 5]) for j in range(len(w) - 4)} for w in texts]
    group, held = list(range(len(texts))), defaultdict(list)

    def find(x):
        while group[x] != x:
            group[x] = x = group[group[x]]
        return x

    for i, s in enumerate(shingles):
        shared = defaultdict(int)
        for g in s:
            for j in held[g]:
                shared[j] += 1
            held[g].append(i)
        for j, both in shared.items():
            if both >= 0.8 * (len(s) + len(shingles[j]) - both):
                a, b = sorted((find(i), find(j)))
                group[b] = a
    df = spark.createDataFrame([(i, " ".join(w)) for i, w in enumerate(texts)], "id long, text string")
    got = {r["id"]: r["group"] for r in simhash.near_duplicates(df).collect()}
    assert got == {i: find(i) for i in range(len(texts))}


# decontamination


def brute_decontaminate(rows, items):
    grams = defaultdict(set)
    norm = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower(t))
    for item_id, text in items:
        w = norm(text)
        n = min(13, len(w))
        for i in range(len(w) - n + 1 if n else 0):
            grams[tuple(w[i : i + n])].add(str(item_id))
    widths, out = {len(g) for g in grams}, []
    for doc_id, text, *_ in rows:
        w = norm(text)
        hit, found = set(), set()
        for n in widths:
            for i in range(len(w) - n + 1):
                if (g := tuple(w[i : i + n])) in grams:
                    hit |= set(range(i, i + n))
                    found |= grams[g]
        sha = hashlib.sha256(",".join(sorted(found)).encode()).hexdigest()
        out.append((doc_id, len(w), len(hit), len(found), sha, bool(hit) and 20 * len(hit) >= len(w)))
    return out


def test_decontamination(spark, small, docs):
    items = [tuple(r) for r in spark.read.parquet(f"{small}/benchmark.parquet").select("item_id", "text").collect()]
    got = decontaminate.op6_decontaminate(spark, small).select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated").collect()
    want = brute_decontaminate(docs, items)
    assert any(r[-1] for r in want)
    assert _key(map(tuple, got)) == _key(want)


def test_decontamination_edge_rows(spark, edge):
    items = [(1, LONG), (2, "One"), (3, None), (4, ""), (5, "..."), (1, LONG)]
    bench = spark.createDataFrame(items, "item_id long, text string")
    d = edge.selectExpr("monotonically_increasing_id() AS key", "doc_id", "text", "hash", "w")
    ids = dict(d.select("key", "doc_id").collect())
    got = [(ids[r["key"]], r["n_words"], r["n_hit"], r["contaminated"]) for r in decontaminate.decontaminate(d, bench, "key").collect()]
    assert _key(got) == _key((a, b, c, f) for a, b, c, _, _, f in brute_decontaminate(EDGE, items))


# mixing


def brute_targets(sizes):
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode("utf-32-be")))
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}
    total, capped = float(sum(sizes.values())), {}
    while True:
        free = [s for s in order if s not in capped]
        rest = total - sum(capped.values())
        out = {s: rest * weight[s] / sum(weight[x] for x in free) for s in free}
        over = [s for s in free if out[s] > 3 * sizes[s]]
        if not over:
            return out | capped
        capped |= {s: 3.0 * sizes[s] for s in over}


@pytest.mark.parametrize("where", ["small", "edge_dir"])
def test_mixing(spark, request, docs, where):
    rows = docs if where == "small" else EDGE
    d = request.getfixturevalue(where)
    got = mixing.op2_mix_sources(spark, d).collect()
    assert _key(got) == _key(mixing.op2_mix_sources(spark, d).collect())
    sizes, largest = defaultdict(int), defaultdict(int)
    for _, text, source, *_ in rows:
        sizes[source] += len(words(text))
        largest[source] = max(largest[source], len(words(text)))
    want = brute_targets(sizes)
    assert _key((r["doc_id"], r["size"]) for r in got) == _key((r[0], len(words(r[1]))) for r in rows)
    by_target = defaultdict(int)
    for r in got:
        assert r["taken"] <= 3 * r["size"]
        by_target[round(r["target"], 3), r["source_size"]] += r["taken"]
    for s, n in sizes.items():
        assert abs(by_target[round(want[s], 3), n] - want[s]) <= largest[s]


# token counts


@pytest.mark.parametrize("where", ["small", "edge_dir"])
def test_token_counts(spark, request, docs, where):
    public = pytest.importorskip("public_tokenizers")
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(public.path("byte_bpe_50k.json"))
    rows = docs if where == "small" else EDGE
    got = tokens.op3_token_counts(spark, request.getfixturevalue(where)).select("doc_id", "n_bytes", "n_tokens", "over_limit").collect()
    n = [len(t.encode(r[1] or "", add_special_tokens=False).ids) for r in rows]
    assert _key(map(tuple, got)) == _key((r[0], len((r[1] or "").encode()), k, k > 512) for r, k in zip(rows, n, strict=True))


# top-k


def test_top_k(spark, small):
    rows = spark.read.parquet(f"{small}/embeddings.parquet").select("vec_id", "embedding").collect()
    ids = np.array([r[0] for r in rows])
    m = np.floor(1024 * np.array([r[1] for r in rows], np.float64)).astype(np.int64)
    want = []
    for q in np.flatnonzero(ids % 100 == 0):
        s = m @ m[q]
        best = [i for i in np.lexsort((ids, -s)) if ids[i] != ids[q]][:10]
        want += [(int(ids[q]), k + 1, int(ids[i]), int(s[i])) for k, i in enumerate(best)]
    got = topk.op7_top_k(spark, small).select("query_id", "rank", "vec_id", "score").collect()
    assert _key(map(tuple, got)) == _key(want)


def test_top_k_edge_rows(spark):
    nan = float("nan")
    v = [(0, [1.0, 0.0]), (1, [1.0, 0.0]), (2, [1.0, 0.0]), (3, None), (4, [nan, 1.0]), (5, [None, 1.0]), (6, [float("inf"), 0.0]), (7, [-0.0001, 2.0])]
    df = spark.createDataFrame(v, "vec_id long, embedding array<float>")
    got = topk.top_k(df, df.filter("vec_id = 0")).orderBy("rank").collect()
    assert [tuple(r) for r in got] == [(0, 1, 1, 1024 * 1024), (0, 2, 2, 1024 * 1024), (0, 3, 7, -1024)]


def test_top_k_repeated_query_rows(spark):
    v = [(0, [1.0, 0.0])] * 12 + [(0, [0.0, 1.0])] + [(i, [float(i), float(-i)]) for i in range(1, 21)]
    df = spark.createDataFrame(v, "vec_id long, embedding array<double>")
    got = topk.top_k(df, df.filter("vec_id = 0")).collect()
    want = [(0, r, 21 - r, 1024 * 1024 * (21 - r)) for r in range(1, 11)] + [(0, r, r, -1024 * 1024 * r) for r in range(1, 11)]
    assert _key(map(tuple, got)) == _key(want)


def test_top_k_large_components(spark):
    v = [(0, [3.0e4, 1.0]), (1, [7.0e4, 0.0]), (2, [7.0e4, 1.0]), (3, [-2.0e8, 5.0])]
    df = spark.createDataFrame(v, "vec_id long, embedding array<double>")
    score = lambda y: sum(int(a * 1024) * int(b * 1024) for a, b in zip(v[0][1], y, strict=True))
    got = topk.top_k(df, df.filter("vec_id = 0")).orderBy("rank").collect()
    assert [tuple(r) for r in got] == [(0, 1, 2, score(v[2][1])), (0, 2, 1, score(v[1][1])), (0, 3, 3, score(v[3][1]))]


# url filter


def test_url_rules_and_parts(spark):
    urls = ["http://A.Example.com/en/7x?q", "https://example.com/en/8#f", "ftp://x.net/de/1", "http://example.net/de/8", "http://o.org/es/", "http://notcom/en/", None, "no scheme", "x://Host", "a://b.com/en/://c"]
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    none = spark.createDataFrame([], "host string, bad int")
    got = {r["page_id"]: tuple(r)[1:5] for r in url_filter.filter_urls(pages, none).collect()}
    assert got == {
        0: ("a.example.com", "/en/7x", "example.com/en/7", "allow"),
        1: ("example.com", "/en/8", "com/en/", "block"),
        2: ("x.net", "/de/1", "net/de/", "allow"),
        3: ("example.net", "/de/8", "example.net/de/8", "block"),
        4: ("o.org", "/es/", "org/es/", "block"),
        5: ("notcom", "/en/", None, "allow"),
        6: ("", "", None, "allow"),
        7: ("", "", None, "allow"),
        8: ("host", "", None, "allow"),
        9: ("b.com", "/en/://c", "com/en/", "block"),
    }


def test_url_reputation_blocks_bad_hosts_only(spark):
    outcomes = [(f"bad{i}.example", 1) for i in range(3) for _ in range(40)] + [(f"good{i}.sample", 0) for i in range(30) for _ in range(40)] + [("new.sample", None)]
    o = spark.createDataFrame(outcomes, "host string, bad int")
    pages = spark.createDataFrame([(0, "http://bad1.example/x"), (1, "http://good1.sample/x"), (2, "http://new.sample/")], "page_id long, url string")
    assert {r["page_id"]: r["verdict"] for r in url_filter.filter_urls(pages, o).collect()} == {0: "block", 1: "allow", 2: "allow"}


# preferences


def test_preferences(spark):
    turns = [(0, 0, "user", "hi"), (0, 1, "assistant", "yes"), (1, 0, "user", "hi"), (1, 1, "assistant", "né"), (1, 1, "assistant", "né"), (2, 0, None, None), (4, 0, "user", "a"), (5, 0, "user", "a"), (None, 0, "user", "z")]
    t = spark.createDataFrame(turns, "conv_id long, turn long, role string, text string")
    got = {r["pair_id"]: r for r in preferences.format_preferences(preferences.neighbour_pairs(preferences.conversations(t))).collect()}
    assert sorted(got) == [0, 1, 2]
    r = got[0]
    assert (r["n_prompt_turns"], r["prompt"], r["chosen"], r["rejected"], r["usable"]) == (1, "<|user|>\nhi\n", "<|assistant|>\nyes\n", "<|assistant|>\nné\n", True)
    assert [r["rejected"][s["start"] : s["end"]] for s in r["rejected_loss"]] == ["né"]
    assert (got[1]["rejected"], got[1]["usable"]) == ("", False)
    assert (got[2]["n_prompt_turns"], got[2]["usable"]) == (1, False)
