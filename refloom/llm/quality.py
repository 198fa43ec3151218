"""Quality classifier: document evidence over hierarchical empirical-Bayes site priors.

For each of two faults, toxic and low quality, a document's posterior log-odds are those of its site plus the evidence of its text.
Sites are shrunk in two steps by grouped sums: a path (language within a source) towards its host (the source), a host
towards all documents.  The evidence comes from labelled documents: each feature's share of the fault is shrunk to the
overall share, so that rare features say little, and three sums of the log-likelihood ratios in a text are calibrated by a
logistic regression whose sums were taken with the ratios of the other half of the documents.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import ensure_checkpoint_dir, give_back, table, tidy, values
from .simhash import NEAR_SHINGLE, _Words, _words_of, shingle_set
from .url_filter import _strength

#: The evidence is fitted on about so many labelled documents at most, chosen by hash.
TRAIN_ROWS = 16_384
#: Features are hashed to so many numbers: no feature is left out, and the table has a fixed size (4 MB).
BUCKETS = 1 << 19
#: Pseudo documents by which a feature's share is shrunk to the overall share.
SHRINK = 5.0
#: Words with the largest ratios of a document that make up the first sum.
STRONGEST = 3
SEED = 9
FAULTS = ("toxic", "low")
PUNCTUATION = ".,;:!?\"'()[]{}<>|%*#$&-_/\\+=~^`@…«»“”‘’„–—"
#: Words that a task knows; when full, it starts anew.
CACHE = 50_000
#: A site table of up to so many rows is broadcast (a few MB); a larger one is joined by shuffling.
BROADCAST_SITES = 50_000


def _bucket(name: str) -> int:
    return xxhash.xxh3_64_intdigest(name, SEED) % (BUCKETS - 1) + 1  # 0: no feature


class Reader(dict):
    """Features of texts: the numbers of distinct lower-cased words without outer punctuation, of their first five and first four
    letters, and of four shares that tell a text's form."""

    def __init__(self) -> None:
        super().__init__()
        self._room(CACHE)

    def _room(self, n: int) -> None:
        self.clear()
        self.known: dict[str, int] = {"": 0}
        self.starts: dict[str, int] = {}
        self.word, self.all, self.bare = (np.zeros(n, np.int32) for _ in range(3))
        self.upper = np.zeros(n, bool)
        self.ids = np.zeros((n + 1, 3), np.int32)
        self.new: list[tuple] = []
        self.new_ids: list[tuple] = []

    def _start(self, name: str) -> int:
        out = self.starts.get(name)
        if out is None:
            out = self.starts[name] = _bucket(name)
        return out

    def __missing__(self, token: str) -> int:
        at = self[token] = len(self)
        bare = token if token.isalnum() else token.strip(PUNCTUATION)
        w = bare.lower()
        place = self.known.get(w)
        if place is None:
            place = self.known[w] = len(self.known)
            n = len(w)
            self.new_ids.append((_bucket("w " + w), self._start("5 " + w[:5]) if n > 5 else 0, self._start("4 " + w[:4]) if n > 4 else 0))
        self.new.append((place, len(token), len(bare), token.isupper()))
        return at

    def _settle(self) -> None:
        """Write what __missing__ found into the arrays."""
        if self.new:
            at = slice(len(self) - len(self.new), len(self))
            self.word[at], self.all[at], self.bare[at], self.upper[at] = zip(*self.new, strict=True)
            self.new = []
        if self.new_ids:
            self.ids[len(self.known) - len(self.new_ids) : len(self.known)] = self.new_ids
            self.new_ids = []

    def read(self, text: str | None) -> tuple[np.ndarray, np.ndarray]:
        """Numbers of words (rows of three) and of form."""
        tokens = (text or "").split()
        if not tokens:
            return self.ids[:0], np.array([_bucket("s empty")])
        if len(self) + len(tokens) > len(self.word):
            self._room(max(CACHE, len(tokens) + 1))
        t = np.fromiter(map(self.__getitem__, tokens), np.int64, len(tokens))
        self._settle()
        words = np.unique(self.word[t])
        bare, size, n = self.bare[t], self.all[t], len(t)
        signs, total = int(size[bare == 0].sum()), int(size.sum())
        tenth = lambda x: int(10 * x + 0.5)
        form = [
            f"s upper {tenth(self.upper[t].sum() / n)}",
            f"s symbols {tenth((total - signs - bare.sum()) / total)}",
            f"s bars {tenth((bare == 0).sum() / n)}",
            f"s again {tenth((t[1:] == t[:-1]).sum() / n)}",
        ]
        return self.ids[words[words > 0]], np.array([_bucket(f) for f in form])


def sums(words: np.ndarray, form: np.ndarray, ratios: np.ndarray) -> tuple[float, float, float]:
    """The strongest words' ratios together, the mean ratio of words, and the ratios of form together."""
    shape = float(ratios[form].sum())
    if not len(words):
        return 0.0, 0.0, shape
    r = ratios[words]
    best = r.max(axis=1)
    top = np.partition(best, -STRONGEST)[-STRONGEST:] if len(best) > STRONGEST else best
    return float(top[top > 0].sum()), float(r[:, 0].mean()), shape


def shrunken_ratios(n: np.ndarray, b: np.ndarray, overall: float) -> np.ndarray:
    """Log-likelihood ratio of each feature, seen in n documents, b with the fault."""
    p = (b + SHRINK * overall) / (n + SHRINK)
    out = np.log(p / (1 - p)) - math.log(overall / (1 - overall))
    out[0] = 0
    return out.astype(np.float32)


def calibrate(x: np.ndarray, y: np.ndarray, overall: float) -> np.ndarray:
    """Intercept and weights of a logistic regression, weights drawn to 0 by a unit normal prior on the standardised sums."""
    start = np.array([math.log(overall / (1 - overall)), 0.0, 0.0, 0.0])
    if not len(y):
        return start
    middle, scale = x.mean(axis=0), x.std(axis=0)
    scale = np.where(scale > 1e-9, scale, np.inf)  # a sum that is the same everywhere says nothing
    x = np.c_[np.ones(len(x)), (x - middle) / scale]
    w, prior = start.copy(), np.array([0.01, 1.0, 1.0, 1.0])
    loss = lambda w: float(np.logaddexp(0, x @ w).sum() - y @ (x @ w) + 0.5 * prior @ (w - start) ** 2)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + np.diag(prior), x.T @ (p - y) + prior * (w - start))
        size, before = 1.0, loss(w)
        while size > 1e-4 and loss(w - size * step) > before:
            size /= 2
        w = w - size * step
        if np.abs(size * step).max() < 1e-6:
            break
    w[1:] /= scale
    w[0] -= w[1:] @ middle
    return w


@dataclass
class Evidence:
    """Ratios of features and weights of the sums, by fault; score() gives each fault's log-likelihood ratio."""

    ratios: dict[str, np.ndarray]
    weights: dict[str, np.ndarray]
    overall: dict[str, float]
    reader: Reader = field(default_factory=Reader)

    def __reduce__(self):
        return Evidence, (self.ratios, self.weights, self.overall)

    def score(self, text: str | None) -> list[float]:
        words, form = self.reader.read(text)
        out = []
        for f in FAULTS:
            w = self.weights[f]
            out.append(float(w[0] + w[1:] @ np.array(sums(words, form, self.ratios[f]))) - math.log(self.overall[f] / (1 - self.overall[f])))
        return out


def document_labels(labels: DataFrame) -> DataFrame:
    """doc_id, toxic, low (0, 1 or null), one row per document; contradicting rows: the fault counts."""
    fault = lambda c: F.max(F.when(c.isNotNull(), c.cast("int")))
    return labels.filter(F.col("doc_id").isNotNull()).groupBy("doc_id").agg(fault(F.col("toxic") == 1).alias("toxic"), fault(F.col("quality") == 0).alias("low"))


def site_posteriors(docs: DataFrame, labels: DataFrame, host: str, path: str) -> tuple[DataFrame, dict[str, float]]:
    """host, path and the logit of each fault's posterior share there, for every site of docs; and the overall shares."""
    seen = docs.select("doc_id", F.col(host).alias("_host"), F.col(path).alias("_path")).join(labels, "doc_id", "left")
    sums = [F.count(f).alias(f"n_{f}") for f in FAULTS] + [F.coalesce(F.sum(f), F.lit(0)).alias(f"b_{f}") for f in FAULTS]
    paths = seen.groupBy("_host", "_path").agg(*sums).checkpoint()
    hosts = paths.groupBy("_host").agg(*[F.sum(c).alias(c) for c in paths.columns[2:]])
    overall = {}
    for f in FAULTS:
        level = lambda d: d.select(F.col(f"n_{f}").alias("n"), F.col(f"b_{f}").alias("b"))  # noqa: B023, E731
        (p0, mh), (_, mp) = _strength(level(hosts)), _strength(level(paths))
        overall[f] = p0 = min(max(p0, 1e-3), 1 - 1e-3)
        hosts = hosts.withColumn(f"h_{f}", (F.col(f"b_{f}") + mh * p0) / (F.col(f"n_{f}") + mh))
        paths = paths.withColumn(f"m_{f}", F.lit(mp))
    up = hosts.select(F.col("_host").alias("_up"), *[f"h_{f}" for f in FAULTS])
    paths = paths.join(up, F.col("_host").eqNullSafe(F.col("_up")))
    share = lambda f: (F.col(f"b_{f}") + F.col(f"m_{f}") * F.col(f"h_{f}")) / (F.col(f"n_{f}") + F.col(f"m_{f}"))
    return paths.select("_host", "_path", *[F.ln(share(f) / (1 - share(f))).alias(f"site_{f}") for f in FAULTS]), overall


def _sample(docs: DataFrame, labels: DataFrame, text: str, rows: int) -> DataFrame:
    """text, half (0 or 1), toxic, low of about rows labelled documents at most; copies and near copies, found by two minimal hashes
    of word shingles, count once, so that a copied document's words don't become evidence.  Of several rows of one doc_id the smallest text counts."""
    n = labels.count()
    part = labels if n <= rows else labels.filter(F.pmod(F.xxhash64(F.lit(SEED), "doc_id"), F.lit(1_000_000)) < int(1_000_000 * rows / n))
    once_each = lambda p: docs.select("doc_id", F.col(text).alias("text")).join(F.broadcast(p.select("doc_id")), "doc_id", "left_semi").groupBy("doc_id").agg(F.min("text").alias("text"))
    d = once_each(part)  # at most about rows rows are broadcast

    def lows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = _Words()
        least = lambda h, m: int((h * np.uint64(m) >> np.uint64(1)).min()) if len(h) else 0
        for b in batches:
            h = [shingle_set(_words_of(t), NEAR_SHINGLE, known) for t in values(b["text"])]
            yield pa.record_batch({"doc_id": b["doc_id"], "m1": pa.array([least(x, 1) for x in h], pa.int64()), "m2": pa.array([least(x, 0x9E3779B97F4A7C15) for x in h], pa.int64())})

    kind = dict(docs.dtypes)["doc_id"]
    m = d.select("doc_id", "text").mapInArrow(tidy(lows), f"doc_id {kind}, m1 long, m2 long")
    first = lambda c: F.min("doc_id").over(Window.partitionBy(c)) == F.col("doc_id")  # noqa: E731  of the sample's rows
    once = m.withColumn("f1", first("m1")).withColumn("f2", first("m2")).filter("f1 and f2").select("doc_id").distinct()
    part = part.join(once, "doc_id").checkpoint()
    d = once_each(part).join(F.broadcast(part), "doc_id")
    half = F.pmod(F.xxhash64(F.lit(SEED + 1), "doc_id"), F.lit(2)).cast("int")
    return d.select("text", half.alias("half"), *FAULTS).checkpoint()


def fit(docs: DataFrame, labels: DataFrame, text: str = "text", rows: int = TRAIN_ROWS) -> Evidence:
    """labels: doc_id, toxic, low.  Learns from about rows labelled documents at most.

    Counts of features are summed by number, so what reaches the driver is a table of at most BUCKETS rows and three sums for every
    document of the sample.
    """
    d = _sample(docs, labels, text, rows)
    names = [f"{p}_{f}_{h}" for f in FAULTS for h in (0, 1) for p in "nb"]

    def counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader, total = Reader(), np.zeros((BUCKETS, len(names)), np.int32)
        for b in batches:
            for t, h, *marks in zip(*(values(b[c]) for c in ("text", "half", *FAULTS)), strict=True):
                words, form = reader.read(t)
                seen = np.unique(np.concatenate([words.ravel(), form, [0]]))  # 0 counts documents
                for i, mark in enumerate(marks):
                    if mark is not None:
                        at = 4 * i + 2 * h
                        total[seen, at] += 1
                        total[seen, at + 1] += mark
        at = np.flatnonzero(total.any(axis=1))
        yield pa.record_batch({"bucket": pa.array(at, pa.int32()), **{c: pa.array(total[at, i]) for i, c in enumerate(names)}})

    c = d.mapInArrow(tidy(counts), "bucket int, " + ", ".join(f"{x} int" for x in names)).groupBy("bucket").agg(*[F.sum(x).cast("int").alias(x) for x in names]).toArrow()
    table_ = {x: np.zeros(BUCKETS, np.int32) for x in names}
    for x in names:
        table_[x][c["bucket"].to_numpy()] = c[x].to_numpy()
    overall, halves, whole = {}, {}, {}
    for f in FAULTS:
        n, b = ([table_[f"{p}_{f}_{h}"] for h in (0, 1)] for p in "nb")
        overall[f] = p0 = (b[0][0] + b[1][0] + 1) / (n[0][0] + n[1][0] + 2)
        halves[f] = [shrunken_ratios(n[1 - h], b[1 - h], p0) for h in (0, 1)]  # of the other half
        whole[f] = shrunken_ratios(n[0] + n[1], b[0] + b[1], p0)

    def sum_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = Reader()
        for b in batches:
            got = []
            for t, h in zip(values(b["text"]), values(b["half"]), strict=True):
                words, form = reader.read(t)
                got.append([v for f in FAULTS for v in sums(words, form, halves[f][h])])
            got = np.array(got, float).reshape(-1, 6)
            yield pa.record_batch({**{f: b[f] for f in FAULTS}, **{f"x{i}": pa.array(got[:, i]) for i in range(6)}})

    x = d.mapInArrow(tidy(sum_up), ", ".join(f"{f} int" for f in FAULTS) + ", " + ", ".join(f"x{i} double" for i in range(6))).toArrow()
    x = x.take(np.lexsort([x[c].fill_null(-1).to_numpy() for c in x.column_names]))  # sums in one order, whatever the tasks' order was
    weights = {}
    for i, f in enumerate(FAULTS):
        part = x.filter(x[f].is_valid())
        weights[f] = calibrate(np.c_[tuple(part[f"x{j}"].to_numpy() for j in range(3 * i, 3 * i + 3))], part[f].to_numpy().astype(float), overall[f])
    return Evidence(whole, weights, overall)


def classify(docs: DataFrame, labels: DataFrame, host: str = "source", path: str = "lang", rows: int = TRAIN_ROWS) -> DataFrame:
    """docs (doc_id, text, host and path columns and any others), labels (doc_id, quality, toxic).

    Adds _toxic and _low, the posterior probabilities of the faults, and _keep: neither reaches one half.  Every row of docs
    is judged on its whole text.  Without labels nothing is rejected but for priors (all shares 1/1000).  A null or
    wordless text has shape evidence only; a null host or path is a site of its own; repeated rows are judged alike; empty
    in, empty out.  Other columns of docs may have any name; those named like added ones are replaced.
    """
    ensure_checkpoint_dir(docs.sparkSession)
    marks = document_labels(labels)
    sites, overall = site_posteriors(docs.select(*{c: None for c in ("doc_id", host, path)}), marks, host, path)
    found = fit(docs.select("doc_id", "text"), marks, rows=rows)
    kept = [c for c in docs.columns if c.lower() not in ("_toxic", "_low", "_keep")]

    @F.arrow_udf("struct<toxic:double,low:double>")
    def evidence(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in batches:
            scores = np.array([found.score(t) for t in values(texts)], float).reshape(-1, 2)
            yield pa.StructArray.from_arrays([pa.array(scores[:, 0]), pa.array(scores[:, 1])], ["toxic", "low"])
        give_back()

    sites = F.broadcast(sites) if sites.count() <= BROADCAST_SITES else sites
    d = docs.select(F.struct(*[F.col(f"`{c}`") for c in kept]).alias("_row")).withColumn("_evidence", evidence(F.col("_row.text")))
    d = d.join(sites, F.col(f"_row.`{host}`").eqNullSafe(F.col("_host")) & F.col(f"_row.`{path}`").eqNullSafe(F.col("_path")), "left")
    chance = lambda f: 1 / (1 + F.exp(-(F.col(f"_evidence.{f}") + F.coalesce(f"site_{f}", F.lit(math.log(overall[f] / (1 - overall[f])))))))
    d = d.withColumn("_toxic", chance("toxic")).withColumn("_low", chance("low"))
    return d.withColumn("_keep", (F.col("_toxic") < 0.5) & (F.col("_low") < 0.5)).select("_row.*", "_toxic", "_low", "_keep")


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "source", "lang")
    out = classify(docs, table(spark, sf_dir, "labels"))
    return out.select("doc_id", F.round("_toxic", 6).alias("p_toxic"), F.round("_low", 6).alias("p_low"), F.col("_keep").alias("keep"))
