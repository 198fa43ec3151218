"""SimHash near-dedup with BK-trees.

A BK-tree holds fingerprints; the children of a node are keyed by their integer Hamming distance to it, and a search within radius
r follows only the edges d - r to d + r.  Over random fingerprints such a search visits a large part of the tree, so one
tree over everything would be quadratic.  The trees here are those of shards: two fingerprints that differ in at most r
bits agree in at least two of r + 2 blocks of bits, and every pair of blocks is the key of a shard.  Shards go to the
tasks by hash instead of being broadcast, since their number grows with the data.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import ensure_checkpoint_dir, partitions, small_batches, table, tidy, values
from .components import connected_components

SEED = 42
SHINGLE = 3
RADIUS = 2
#: Fingerprints of a shard that are put into one tree.  Larger shards are linked through midpoints instead, which is exact too.
TREE = 2048

NEAR_SHINGLE = 5
SIMILARITY = 0.8
#: Fingerprints of similar sets differ in more bits than this with probability below 1 %.  What lies beyond is found by the last step.
NEAR_RADIUS = 18
#: Nearest texts in a shard's tree that are tried before the last step.
NEAREST = 2
#: Hashes of words that a task keeps; when full, the cache starts anew.
CACHE = 50_000
#: Shingles are ordered by their counts in all texts, which are kept for so many residues of their hashes: a table whose size the texts don't
#: change.  No pair depends on the order, so shingles may share a count.
COUNTS = 1 << 20
#: Rows of a batch: sets of shingles are wide.
BATCH = 1000
#: Members of a key that are paired in one part.
CROWD = 512
#: Shingles of a text are counted in so many bins, which bound what two sets can share.
BINS = 512


class BKTree:
    def __init__(self) -> None:
        self.root: list | None = None

    def add(self, value: int) -> None:
        """Values that are in the tree already are not added again."""
        node = self.root
        if node is None:
            self.root = [value, {}]
            return
        while d := (node[0] ^ value).bit_count():
            child = node[1].get(d)
            if child is None:
                node[1][d] = [value, {}]
                return
            node = child

    def within(self, value: int, radius: int) -> list[tuple[int, int]]:
        """(distance, value) of all within the radius."""
        found, todo = [], [self.root] if self.root else []
        while todo:
            node = todo.pop()
            d = (node[0] ^ value).bit_count()
            if d <= radius:
                found.append((d, node[0]))
            low, high = d - radius, d + radius
            todo.extend([c for k, c in node[1].items() if low <= k <= high])
        return found


def shingle_hashes(text: str | None, k: int) -> np.ndarray:
    """XXH64 (seed 42) of every k words joined by single spaces, repeats included; fewer words: of them all; none: empty."""
    words = (text or "").encode("utf-8").lower().split()  # bytes: A-Z only, and just the white space of the contract
    if not words:
        return np.zeros(0, np.uint64)
    joined = b" ".join(words)
    if len(words) <= k:
        return np.array([xxhash.xxh64_intdigest(joined, SEED)], np.uint64)
    size = np.fromiter(map(len, words), np.int64, len(words))
    end = np.cumsum(size + 1) - 1
    digest = xxhash.xxh64_intdigest
    return np.array([digest(joined[a:b], SEED) for a, b in zip((end - size).tolist(), end[k - 1 :].tolist(), strict=False)], np.uint64)


def fingerprint(hashes: np.ndarray) -> int:
    """A bit is 1 if more than half the hashes have it."""
    total = np.zeros(64, np.int64)
    for i in range(0, len(hashes), 4096):
        total += np.unpackbits(hashes[i : i + 4096].astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits((2 * total > len(hashes)).astype(np.uint8), bitorder="little").view("<u8")[0]) if len(hashes) else 0


def fingerprints(docs: DataFrame, key: str, text: str, k: int = SHINGLE) -> DataFrame:
    """key, fp (the fingerprint's 64 bits as a signed long) for every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fp = [fingerprint(shingle_hashes(t, k)) for t in values(b[1])]
            yield pa.record_batch({key: b[0], "fp": pa.array(np.array(fp, np.uint64).view(np.int64))})

    return docs.select(key, text).mapInArrow(tidy(run), f"`{key}` {dict(docs.dtypes)[key]}, fp long")


def _block_keys(fp: Column, radius: int) -> Column:
    """array<struct<b,k>>: the pairs of blocks."""
    n = radius + 2
    cuts = [64 * i // n for i in range(n + 1)]
    block = [F.shiftrightunsigned(fp, lo).bitwiseAND(F.lit((1 << (hi - lo)) - 1)) if lo else fp.bitwiseAND(F.lit((1 << hi) - 1)) for lo, hi in zip(cuts, cuts[1:], strict=False)]
    return F.array(*[F.struct(F.lit(i).alias("b"), block[x].alias("k1"), block[y].alias("k2")) for i, (x, y) in enumerate(combinations(range(n), 2))])


def _shard_runs(t: pa.Table, by: list[str]) -> Iterator[np.ndarray]:
    """Row numbers of each shard of a group of shards."""
    if not len(t):
        return
    cols = [t[c].to_numpy() for c in by]
    order = np.lexsort(cols[::-1])
    new = np.zeros(len(order), bool)
    for c in cols:
        new[1:] |= c[order][1:] != c[order][:-1]
    yield from np.split(order, np.flatnonzero(new))


def links(fps: DataFrame, radius: int = RADIUS) -> DataFrame:
    """fps: fp, distinct.  a, b: enough links between fingerprints that differ in at most radius bits to connect all that such
    links connect.  A shard gives a tree of links, not all its pairs."""
    by = ["b", "k1", "k2"]
    keys = fps.select("fp", F.explode(_block_keys(F.col("fp"), radius)).alias("x")).select("fp", "x.*")
    sizes = keys.groupBy(*by).agg(F.count("*").alias("n")).filter("n > 1")
    keys = keys.join(sizes, by)

    def tree_links(t: pa.Table) -> pa.Table:
        fp, out = t["fp"].to_numpy().view(np.uint64), []
        for rows in _shard_runs(t, by):
            tree, parent = BKTree(), {}

            def find(x: int, parent: dict = parent) -> int:
                while parent[x] != x:
                    parent[x] = x = parent[parent[x]]
                return x

            for x in sorted(fp[rows].tolist()):
                parent[x] = x
                for _, y in tree.within(x, radius):
                    parent[find(y)] = find(x)
                tree.add(x)
            out += [(x, r) for x in parent if (r := find(x)) != x]
        a, b = np.array(out, np.uint64).reshape(-1, 2).T
        return pa.table({"a": np.ascontiguousarray(a).view(np.int64), "b": np.ascontiguousarray(b).view(np.int64)})

    slots = 8 * partitions(fps.sparkSession)
    small = keys.filter(F.col("n") <= TREE).withColumn("slot", F.pmod(F.xxhash64(*by), F.lit(slots)))
    linked = small.groupBy("slot").applyInArrow(tree_links, "a long, b long")
    return linked.union(_midpoint_links(keys.filter(F.col("n") > TREE).select("fp").distinct(), radius))


def _midpoint_links(fps: DataFrame, radius: int) -> DataFrame:
    """Links of crowded shards: two fingerprints are within 2 bits just if they meet in one that is within 1 bit of both.  At
    most 65 meet anywhere, however many near copies a text has."""
    if radius != 2:
        raise ValueError("crowded shards are linked for a radius of 2")
    mids = F.concat(F.array("fp"), F.transform(F.sequence(F.lit(0), F.lit(63)), lambda i: F.col("fp").bitwiseXOR(F.call_function("shiftleft", F.lit(1).cast("long"), i))))
    m = fps.select("fp", F.explode(mids).alias("mid"))
    low = m.groupBy("mid").agg(F.min("fp").alias("a"), F.count("*").alias("n")).filter("n > 1")
    return m.join(low, "mid").filter("fp != a").select("a", F.col("fp").alias("b")).distinct()


def simhash_components(docs: DataFrame, k: int = SHINGLE, radius: int = RADIUS) -> DataFrame:
    """docs (doc_id, text): doc_id, fingerprint (16 hex digits), component_id for every row.

    Exact: all pairs of fingerprints within radius are linked.  A null or wordless text has fingerprint zero, linked like
    any other; repeated rows and copies share a fingerprint and are linked once, by it.  A null doc_id is never the
    smallest; a component of null ids only has a null id.  Empty in, empty out; other columns are left out.
    """
    ensure_checkpoint_dir(docs.sparkSession)
    fps = fingerprints(docs, "doc_id", "text", k).checkpoint()
    uniq = fps.groupBy("fp").agg(F.min("doc_id").alias("first"))
    roots = connected_components(links(uniq.select("fp"), radius))
    linked = uniq.join(roots, F.col("fp") == F.col("node"))
    ids = linked.groupBy("root").agg(F.min("first").alias("component_id"))
    linked = linked.join(ids, "root").select("fp", "component_id")
    named = uniq.join(linked, "fp", "left").select("fp", F.coalesce("component_id", "first").alias("component_id"))
    return fps.join(named, "fp").select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def op5_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_components(table(spark, sf_dir, "documents"))


# Near duplicates by similarity of word shingles


class _Words(dict):
    """Hashes of words."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= CACHE:
            self.clear()
        h = self[word] = xxhash.xxh3_64_intdigest(word, SEED)
        return h


def shingle_set(words: list[bytes], k: int, known: _Words) -> np.ndarray:
    """Distinct 64-bit hashes of every k words, ascending; fewer words: of them all; none: empty."""
    if not words:
        return np.zeros(0, np.uint64)
    w = np.fromiter(map(known.__getitem__, words), np.uint64, len(words))
    n = max(1, len(w) - k + 1)
    acc = np.full(n, min(k, len(w)), np.uint64)
    for j in range(min(k, len(w))):
        acc = (acc ^ w[j : j + n]) * np.uint64(0x9E3779B97F4A7C15)
        acc ^= acc >> np.uint64(29)
    return np.unique(acc)


def _words_of(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8").lower().split()


def _counts(docs: DataFrame, text: str, k: int) -> np.ndarray:
    """How many shingles of all texts have each residue by COUNTS, a text's repeats once: for the order of shingles only.  A task adds its texts up
    before anything is shuffled."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, total = _Words(), np.zeros(COUNTS, np.int64)
        for b in batches:
            for t in values(b[0]):
                np.add.at(total, (shingle_set(_words_of(t), k, known) % np.uint64(COUNTS)).astype(np.int64), 1)
        some = np.flatnonzero(total)
        for i in range(0, len(some), 1 << 16):
            yield pa.record_batch({"r": pa.array(some[i : i + (1 << 16)]), "n": pa.array(total[some[i : i + (1 << 16)]])})

    t = docs.select(text).mapInArrow(tidy(run), "r long, n long").groupBy("r").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(COUNTS, np.int64)
    out[t["r"].to_numpy()] = t["n"].to_numpy()
    return out


def sketches(docs: DataFrame, text: str, k: int, least: float) -> DataFrame:
    """docs.id, same (a 128-bit hash of the words, equal for copies), fp (SimHash of the set of shingles), size (of the set), bins
    and over (its counts by bin, up to 255, and what is above), keys: the rarest shingles, so many that two sets of similarity
    least share one.

    That holds in any order of shingles that is the same for all sets; rare ones first, by counts over all texts, keeps keys apart.
    """
    times = _counts(docs, text, k)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = _Words()
        for b in batches:
            same, fps, size, keys, bins, over = [], [], [], [], [], []
            for t in values(b[1]):
                words = _words_of(t)
                same.append(xxhash.xxh3_128_digest(b" ".join(words)))
                h = shingle_set(words, k, known)
                fps.append(fingerprint(h))
                size.append(len(h))
                n = np.bincount((h % np.uint64(BINS)).astype(np.int64), minlength=BINS)
                bins.append(np.minimum(n, 255).astype(np.uint8).tobytes())
                over.append(int(np.maximum(n - 255, 0).sum()))
                m = len(h) - math.ceil(least * len(h) - 1e-9) + 1
                h = h[np.argsort(times[(h % np.uint64(COUNTS)).astype(np.int64)], kind="stable")]
                keys.append(h[:m].view(np.int64))
            yield pa.record_batch(
                {"id": b[0], "same": pa.array(same, pa.binary()), "fp": pa.array(np.array(fps, np.uint64).view(np.int64)), "size": pa.array(size, pa.int64()),
                 "bins": pa.array(bins, pa.binary()), "over": pa.array(over, pa.int64()), "keys": pa.array(keys, pa.list_(pa.int64()))}
            )

    return docs.select("id", text).mapInArrow(tidy(run), "id long, same binary, fp long, size long, bins binary, over long, keys array<long>")


def tree_pairs(rows: DataFrame) -> DataFrame:
    """rows: key, n (members of the key), id, fp.  a < b: in every shard, each text with its nearest in a BK-tree of those before it."""

    def near(t: pa.Table) -> pa.Table:
        ids, fp, out = t["id"].to_numpy(), t["fp"].to_numpy().view(np.uint64), set()
        for rows in _shard_runs(t, ["key", "part"]):
            first: dict[int, int] = {}
            tree = BKTree()
            for i in rows[np.argsort(ids[rows])].tolist():
                x, me = int(fp[i]), int(ids[i])
                if x in first:
                    out.add((first[x], me))
                    continue
                out.update((first[y], me) for _, y in sorted(tree.within(x, NEAR_RADIUS))[:NEAREST])
                first[x] = me
                tree.add(x)
        a, b = np.array(sorted(out), np.int64).reshape(-1, 2).T
        return pa.table({"a": a, "b": b})

    slots = 8 * partitions(rows.sparkSession)
    part = F.pmod(F.xxhash64("id"), F.greatest(F.lit(1), F.ceil(F.col("n") / TREE)))  # of a crowded shard
    dealt = rows.withColumn("part", part).withColumn("slot", F.pmod(F.xxhash64("key", "part"), F.lit(slots))).select("slot", "key", "part", "id", "fp")
    return dealt.groupBy("slot").applyInArrow(near, "a long, b long").distinct()


def overlaps(docs: DataFrame, pairs: DataFrame, text: str, k: int) -> DataFrame:
    """a, b of pairs of docs.id, and of their sets of k-word shingles the sizes of the intersection (both) and the union (either)."""

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = _Words()
        for b in batches:
            yield pa.record_batch({"id": b[0], "s": pa.array([shingle_set(_words_of(t), k, known).tobytes() for t in values(b[1])], pa.binary())})

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            both, either = [], []
            for x, y in zip(batch["sa"], batch["sb"], strict=True):
                x, y = (np.frombuffer(v.as_buffer(), np.uint64) for v in (x, y))
                both.append(len(np.intersect1d(x, y, assume_unique=True)))
                either.append(len(x) + len(y) - both[-1])
            yield pa.record_batch({"a": batch["a"], "b": batch["b"], "both": pa.array(both, pa.int64()), "either": pa.array(either, pa.int64())})

    wanted = pairs.select(F.explode(F.array("a", "b")).alias("id")).distinct()
    s = docs.join(wanted, "id", "left_semi").select("id", text).mapInArrow(tidy(sets), "id long, s binary")
    both = pairs.join(s.select(F.col("id").alias("a"), F.col("s").alias("sa")), "a").join(s.select(F.col("id").alias("b"), F.col("s").alias("sb")), "b")
    return both.select("a", "b", "sa", "sb").mapInArrow(tidy(count), "a long, b long, both long, either long")


def _least_distances(pairs: DataFrame, p: DataFrame) -> DataFrame:
    """a, b, low: 1 - similarity of the pair is not below low, as sets share no more than the lesser count of each bin."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x, y = (np.frombuffer(b"".join(b[c].to_pylist()), np.uint8).reshape(-1, BINS) for c in ("bins_a", "bins_b"))
            both = np.minimum(x, y).sum(axis=1, dtype=np.int64) + np.minimum(b["over_a"].to_numpy(), b["over_b"].to_numpy())
            either = b["size_a"].to_numpy() + b["size_b"].to_numpy() - both
            yield pa.record_batch({"a": b["a"], "b": b["b"], "low": pa.array(1 - both / np.maximum(either, 1), pa.float64())})

    for c in ("a", "b"):
        pairs = pairs.join(p.select(F.col("id").alias(c), *[F.col(x).alias(f"{x}_{c}") for x in ("size", "bins", "over")]), c)
    return pairs.mapInArrow(tidy(run), "a long, b long, low double")


def _merged(groups: DataFrame, links: DataFrame) -> DataFrame:
    """groups (id, g) with the groups joined that links a, b lead between."""
    of = lambda c, g: groups.select(F.col("id").alias(c), F.col("g").alias(g))
    roots = connected_components(links.join(of("a", "ga"), "a").join(of("b", "gb"), "b").select(F.col("ga").alias("a"), F.col("gb").alias("b")))
    return groups.join(roots, F.col("g") == F.col("node"), "left").select("id", F.coalesce("root", "g").alias("g"))


def _shared(rows: DataFrame) -> DataFrame:
    """Of rows (key, id, g, pos, ...) those of keys that more than one group has, with n, the members; of keys with the same members the
    first in the order of shingles, which comes first in every member."""
    of = rows.groupBy("key").agg(F.min("g").alias("lo"), F.max("g").alias("hi"), F.count("*").alias("n"), F.sum("pos").alias("at"), F.bit_xor(F.xxhash64("id")).alias("x"), F.bit_xor(F.xxhash64(F.lit(SEED), "id")).alias("y"))
    one = of.filter("lo < hi").groupBy("n", "x", "y").agg(F.min_by("key", "at").alias("key"))
    return rows.join(one.select("key", "n"), "key")


def _reach(size: Column, pos: Column, least: float) -> Column:
    """At a key, the pos-th of a set in the order of shingles, what least times the size of a similar set must not exceed.

    Two sets whose first common shingle stands at i in x and at j in y share at most min(|x| - i, |y| - j); similar ones share
    least / (1 + least) of |x| + |y|.  So |x| - (1 + least) * i >= least * |y|, and the same with x and y exchanged.  At a later common
    shingle both left sides are less, so a pair that is told apart at its first one is told apart at all.
    """
    return size - F.lit(1 + least) * pos + F.lit(1e-6)


def _in_reach(rows: DataFrame, least: float) -> DataFrame:
    """Of rows (key, id, size, pos) those whose key has another member, and members that the row and that the row's set may be similar to."""
    reach = _reach(F.col("size"), F.col("pos"), least)
    of = rows.groupBy("key").agg(F.count("*").alias("m"), F.min("size").alias("s"), F.max(reach).alias("r")).filter("m > 1")
    return rows.join(of, "key").filter((reach >= F.lit(least) * F.col("s")) & (F.col("r") >= F.lit(least) * F.col("size"))).drop("m", "s", "r")


def _with_others(rows: DataFrame, least: float) -> DataFrame:
    """Of rows (key, id, g, size, reach, ...) those that a set of another group at the key, and that it, may be similar to."""
    of = rows.groupBy("key", "g").agg(F.min("size").alias("s"), F.max("reach").alias("r"))
    top = of.groupBy("key").agg(F.min(F.struct("s", "g")).alias("s1"), F.max(F.struct("r", "g")).alias("r1"))
    s2, r2 = F.min(F.when(F.col("g") != F.col("s1.g"), F.col("s"))).alias("s2"), F.max(F.when(F.col("g") != F.col("r1.g"), F.col("r"))).alias("r2")
    top = of.join(top, "key").groupBy("key", "s1", "r1").agg(s2, r2).filter("s2 IS NOT NULL")
    s = F.when(F.col("g") != F.col("s1.g"), F.col("s1.s")).otherwise(F.col("s2"))
    r = F.when(F.col("g") != F.col("r1.g"), F.col("r1.r")).otherwise(F.col("r2"))
    return rows.join(top, "key").filter((F.col("reach") >= F.lit(least) * s) & (r >= F.lit(least) * F.col("size"))).drop("s1", "r1", "s2", "r2")


def _similar(seen: DataFrame, least: float) -> DataFrame:
    return seen.filter(F.col("both") >= F.lit(least) * F.col("either")).select("a", "b")


def near_duplicates(docs: DataFrame, k: int = NEAR_SHINGLE, least: float = SIMILARITY) -> DataFrame:
    """docs (id: unique long, text): id, group for every row; group is the smallest id that similar pairs lead to.

    Exact: two texts whose sets of k-word shingles have a Jaccard similarity of least or more are in one group, however many
    texts share a shingle.  Copies are joined by a 128-bit hash of their words.  Similar texts share one of their rarest
    shingles, and the texts with a rare shingle are a shard, but for those in which it comes too late for any similar set of the
    sizes that are there (_reach).  First each is verified against the shard's hub, the member that
    shares most shards with most others, and against its nearest in the BK-tree of the shard's SimHash fingerprints; for copies
    edited one by one this joins nearly all.  Then all pairs of a shard that are still in different groups are
    verified but for those that cannot be similar: by their sizes, by where the shard's shingle stands in both, by their bins, or
    since 1 - similarity is a metric and their distances to the hub differ too much.  Members of a crowded shard are dealt to parts for that, and each part meets all of them.

    Every link is verified by the similarity of the whole texts.  Null and wordless texts are copies of each other; texts of fewer
    than k words have one shingle; repeated rows are copies; empty in, empty out; other columns are left out.
    """
    ensure_checkpoint_dir(docs.sparkSession)
    with small_batches(docs.sparkSession, BATCH):  # all that runs Python runs here
        return _grouped(docs.select("id", "text"), k, least)


def _grouped(d: DataFrame, k: int, least: float) -> DataFrame:
    p = sketches(d, "text", k, least).checkpoint()
    copies = p.groupBy("same").agg(F.min("id").alias("first"))
    groups = copies.select(F.col("first").alias("id"), F.col("first").alias("g")).checkpoint()
    rows = p.select("id", "size", "keys").join(groups.select("id"), "id", "left_semi").select("id", F.col("size").cast("int").alias("size"), F.posexplode("keys").alias("pos", "key"))
    rows = _shared(_in_reach(rows, least).withColumn("g", F.col("id"))).join(p.select("id", "fp"), "id").checkpoint()
    groups = _linked(d, p, rows, groups, "text", k, least)
    named = groups.join(p.select("id", "same"), "id").select("same", F.col("g").alias("group"))
    return p.select("id", "same").join(named, "same").select("id", "group")


def _linked(docs: DataFrame, p: DataFrame, rows: DataFrame, groups: DataFrame, text: str, k: int, least: float) -> DataFrame:
    """groups (id, g; each id its own), which similar pairs of rows (key, id, n, fp, size, pos) join."""
    if rows.isEmpty():
        return groups
    apart = 1 - least + 1e-9
    ranked = rows.join(rows.groupBy("id").agg(F.sum("n").alias("degree")), "id")
    hubs = ranked.groupBy("key").agg(F.max(F.struct("degree", (-F.col("id")).alias("id"))).alias("h")).select("key", (-F.col("h.id")).alias("hub")).checkpoint()
    pair = [F.least("id", "hub").alias("a"), F.greatest("id", "hub").alias("b")]
    first = rows.join(hubs, "key").filter("id != hub").select(*pair).union(tree_pairs(rows)).distinct()
    low = _least_distances(first, p).checkpoint()
    seen = overlaps(docs, low.filter(F.col("low") <= apart).select("a", "b"), text, k).checkpoint()
    # every text is a group of its own so far, so links lead between groups as they are
    roots = connected_components(_similar(seen, least))
    groups = groups.join(roots, F.col("id") == F.col("node"), "left").select("id", F.coalesce("root", "g").alias("g")).checkpoint()
    # what is known of the distance to the hub
    exact = seen.select("a", "b", (1 - F.col("both") / F.col("either")).alias("far"))
    far = low.join(exact, ["a", "b"], "left").select("a", "b", F.coalesce("far", "low").alias("low"), F.coalesce("far", F.lit(1.0)).alias("high"))
    rows = rows.drop("g", "n").join(groups, "id").withColumn("reach", _reach(F.col("size"), F.col("pos"), least))
    rows = _shared(_with_others(rows, least)).join(hubs, "key").filter("id != hub").select("*", *pair).join(far, ["a", "b"])
    rows = rows.select("key", "id", "size", "reach", "g", "low", "high", "n").checkpoint()
    parts = F.greatest(F.lit(1), F.ceil(F.col("n") / CROWD)).cast("int")
    x = rows.withColumn("part", F.pmod(F.xxhash64("id"), parts).cast("int")).alias("x")
    y = rows.withColumn("part", F.explode(F.sequence(F.lit(0), parts - 1))).alias("y")
    may = (F.col("x.g") < F.col("y.g")) & (F.col("x.low") - F.col("y.high") <= apart) & (F.col("y.low") - F.col("x.high") <= apart)
    may &= (F.col("x.reach") >= F.lit(least) * F.col("y.size")) & (F.col("y.reach") >= F.lit(least) * F.col("x.size"))
    left = x.join(y, (F.col("x.key") == F.col("y.key")) & (F.col("x.part") == F.col("y.part")) & may)
    left = left.select(F.least("x.id", "y.id").alias("a"), F.greatest("x.id", "y.id").alias("b")).distinct()
    left = _least_distances(left, p).filter(F.col("low") <= apart).select("a", "b").checkpoint()
    return groups if left.isEmpty() else _merged(groups, _similar(overlaps(docs, left, text, k), least))
