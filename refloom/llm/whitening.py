"""Whitening of embeddings: blockwise TSQR and one-sided Jacobi rotations.

Centred rows are compressed block by block to an upper triangle R, and the triangles of the partitions in a tree to one, which has the
singular values and right singular vectors of the whole matrix, without its covariance ever being formed.  Plane rotations then make R's columns
orthogonal: their lengths are the standard deviations times sqrt(n), and the accumulated rotations the components.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table, tidy, written

SCALE = 256
COMPONENTS = 4
BLOCK = 2048
#: Triangles are joined in a tree: first those of partitions alike modulo the first number, then modulo the next.
TREE = (1024, 32, 1)
#: Entries beyond this can't be multiplied by SCALE and kept exactly.
LARGEST = 2.0**53
#: A component counts if its standard deviation is more than this share of the largest.
LEAST = 1e-10
MAX_SWEEPS = 60


def jacobi(r: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Singular values, falling, and right singular vectors (columns) of r by one-sided Jacobi rotations.

    A sweep meets every pair of columns once, in rounds of disjoint pairs; it ends when all are orthogonal to rounding.  Signs are
    such that the entry of greatest size is positive.
    """
    width = r.shape[1]
    g, v = r.astype(np.float64).copy(), np.eye(width)
    seats = np.arange(width + width % 2)  # with an odd number one column sits out each round
    for _ in range(MAX_SWEEPS):
        turned = False
        for _ in range(max(0, len(seats) - 1)):
            p, q = seats[: len(seats) // 2], seats[len(seats) // 2 :][::-1]
            p, q = p[(here := (p < width) & (q < width))], q[here]
            a, b, c = (g[:, p] ** 2).sum(0), (g[:, q] ** 2).sum(0), (g[:, p] * g[:, q]).sum(0)
            with np.errstate(divide="ignore", invalid="ignore", over="ignore"):
                turn = np.abs(c) > 1e-15 * np.sqrt(a * b)
                p, q, a, b, c = p[turn], q[turn], a[turn], b[turn], c[turn]
                zeta = (b - a) / (2 * c)
                t = np.where(zeta >= 0, 1.0, -1.0) / (np.abs(zeta) + np.hypot(1, zeta))
            if len(p):
                turned = True
                cos = 1 / np.hypot(1, t)
                sin = cos * t
                for m in (g, v):
                    m[:, p], m[:, q] = cos * m[:, p] - sin * m[:, q], sin * m[:, p] + cos * m[:, q]
            seats = np.concatenate((seats[:1], seats[-1:], seats[1:-1]))
        if not turned:
            break
    length = np.sqrt((g**2).sum(0))
    order = np.argsort(-length, kind="stable")
    length, v = length[order], v[:, order]
    largest = v[np.abs(v).argmax(0), np.arange(width)] if width else np.ones(0)
    return length, v * np.where(largest < 0, -1.0, 1.0)


@dataclass
class Whitening:
    """What was fitted: n vectors with sums per dimension; components by falling eigenvalue as rows, their eigenvalues and the trace of the covariance;
    identity_error is the largest entry of the whitened fit list's covariance minus the identity."""

    n: int
    sums: list[int]
    vectors: np.ndarray
    eigenvalues: np.ndarray
    trace: float
    identity_error: float = 0.0

    def centred(self, x: np.ndarray) -> np.ndarray:
        """x - S/n to the last bit: whole parts are subtracted as integers."""
        whole, rest = [s // self.n for s in self.sums], [s % self.n for s in self.sums]
        return (x - np.array(whole, np.int64)).astype(np.float64) - np.array(rest, np.float64) / self.n

    def whitened(self, x: np.ndarray) -> np.ndarray:
        return self.centred(x) @ (self.vectors / np.sqrt(self.eigenvalues)[:, None]).T

    def deviation(self, x: np.ndarray) -> list[int]:
        """Sum over dimensions of (n*x - S)^2, exact: in longs where they surely suffice, else in Python's integers."""
        far = self.n * int(np.abs(x).max(initial=0)) + max(map(abs, self.sums), default=0)
        if far * far * max(1, x.shape[1]) < 2**63:
            return ((self.n * x - np.array(self.sums, np.int64)) ** 2).sum(1).tolist()
        return [sum((self.n * v - s) ** 2 for v, s in zip(row, self.sums, strict=True)) for row in x.tolist()]


def _blocks(batches: Iterable[pa.RecordBatch], name: str, width: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    """BLOCK rows at a time with their vectors as a matrix of longs."""
    for whole in batches:
        for k in range(0, whole.num_rows, BLOCK):
            batch = whole.slice(k, BLOCK)
            yield batch, batch.column(name).flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(batch.num_rows, width)


def _triangle(blocks: Iterable[np.ndarray], width: int) -> np.ndarray:
    r = np.zeros((0, width))
    for b in blocks:
        r = np.linalg.qr(np.vstack((r, b)), mode="r")
    return r


def integers(vectors: DataFrame, column: str = "embedding") -> DataFrame:
    """vectors without the rows whose vector is null or holds null or non-finite entries, and with x: floor(256 * entry) as longs,
    shorter vectors ending in zeros."""
    v = F.col(f"`{column}`").cast("array<double>")
    fine = F.col(f"`{column}`").isNotNull() & F.forall(v, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    rows = vectors.filter(fine)
    width = rows.agg(F.max(F.size(v))).first()[0] or 0
    whole = F.transform(v, lambda c: F.when(F.abs(c * SCALE) < LARGEST, F.floor(c * SCALE)).otherwise(F.raise_error(F.lit("an entry is too large to be kept exactly")).cast("long")))
    keep = [F.col(f"`{c}`") for c in vectors.columns if c.lower() != "x"]
    return rows.select(*keep, F.concat(whole, F.array_repeat(F.lit(0).cast("long"), F.lit(width) - F.size(v))).alias("x"))


def fit(x: DataFrame, components: int = COMPONENTS) -> Whitening | None:
    """x: rows with an array x of longs, all of one length.  Fits on each distinct x once; None if there are none.

    Equal vectors meet by a hash of all their entries after partial aggregation, so a very common vector is no hot key.  What reaches the
    driver are sums and components, in proportion to the vectors' length; a triangle holds length^2 doubles and must fit in a task.
    """
    each = written(x.select("x").distinct(), "whitening")
    first = each.select(F.size("x").alias("n")).first()
    if first is None:
        return None
    width = first["n"]

    @tidy
    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, sums = 0, [0] * width
        for _, m in _blocks(batches, "x", width):
            for k in range(0, len(m), 512):  # 512 entries of up to 2^53 fit in a long
                n, sums = n + len(m[k : k + 512]), [a + b for a, b in zip(sums, m[k : k + 512].sum(0).tolist(), strict=True)]
        at = [-1, *range(width)]
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(list(map(Decimal, [n, *sums])), pa.decimal128(38, 0))], ["at", "s"])

    total = {r["at"]: int(r["s"]) for r in each.mapInArrow(add, "at int, s decimal(38,0)").groupBy("at").agg(F.sum("s").cast("decimal(38,0)").alias("s")).collect()}
    model = Whitening(total[-1], [total[i] for i in range(width)], np.zeros((0, width)), np.zeros(0), 0.0)

    def flat(m: np.ndarray) -> pa.Array:
        return pa.array([m.ravel().tolist()], pa.list_(pa.float64()))

    @tidy
    def compress(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        r = _triangle((model.centred(m) for _, m in _blocks(batches, "x", width)), width)
        yield pa.RecordBatch.from_arrays([flat(r)], ["r"])

    def triangles(t: pa.Table) -> Iterator[np.ndarray]:
        return (np.array(r.as_py(), np.float64).reshape(-1, width) if width else np.zeros((0, 0)) for r in t["r"])

    def join(t: pa.Table) -> pa.Table:
        return pa.table({"r": flat(_triangle(triangles(t), width)), "part": t["part"][:1]})

    def rotate(t: pa.Table) -> pa.Table:
        length, v = jacobi(_triangle(triangles(t), width))
        k = min(components, int((length > LEAST * length[0]).sum())) if len(length) and length[0] > 0 else 0
        return pa.table({"trace": [float((length**2).sum())], "lengths": flat(length[:k]), "vectors": flat(v[:, :k].T)})

    parts = each.mapInArrow(compress, "r array<double>").withColumn("part", F.spark_partition_id())
    for n in TREE[:-1]:
        parts = parts.withColumn("part", F.pmod("part", F.lit(n))).groupBy("part").applyInArrow(join, "r array<double>, part int")
    got = parts.withColumn("part", F.lit(0)).groupBy("part").applyInArrow(rotate, "trace double, lengths array<double>, vectors array<double>").first()
    model.trace = got["trace"] / model.n
    model.eigenvalues = np.array(got["lengths"]) ** 2 / model.n
    model.vectors = np.array(got["vectors"]).reshape(len(model.eigenvalues), width)
    k = len(model.eigenvalues)
    if k:

        @tidy
        def moments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            s = np.zeros((k + 1, k + 1))
            for _, m in _blocks(batches, "x", width):
                w = np.hstack((model.whitened(m), np.ones((len(m), 1))))
                s += w.T @ w
            yield pa.RecordBatch.from_arrays([pa.array(np.arange((k + 1) ** 2, dtype=np.int32)), pa.array(s.ravel())], ["at", "s"])

        sums = {r["at"]: r["s"] for r in each.mapInArrow(moments, "at int, s double").groupBy("at").agg(F.sum("s").alias("s")).collect()}
        s = np.array([sums[i] for i in range((k + 1) ** 2)]).reshape(k + 1, k + 1) / model.n
        model.identity_error = float(np.abs(s[:k, :k] - np.outer(s[k, :k], s[k, :k]) - np.eye(k)).max())
    return model


def whiten(vectors: DataFrame, column: str = "embedding", components: int = COMPONENTS) -> tuple[DataFrame, Whitening | None]:
    """vectors with _whitened, the values of up to that many components, and _deviation, n squared times the squared distance from the mean, beside the fitted
    model (None if no row can take part, and then no rows).

    Rows whose vector is null or holds a null or non-finite entry go.  Repeated vectors count once in the fit and are all returned; shorter vectors
    count as ending in zeros.  Components without variance can't be whitened and are left out, so that of equal vectors only, _whitened is empty.
    Null ids and ties are nothing special; columns of vectors named x, _whitened or _deviation are replaced.  Where entries or a deviation leave
    the range of longs the query fails rather than be wrong.
    """
    keep = [c for c in vectors.columns if c.lower() not in ("x", "_whitened", "_deviation")]
    rows = integers(vectors.select(*[F.col(f"`{c}`") for c in keep]), column)
    model = fit(rows, components)
    wide = rows.select(F.struct(*[F.col(f"`{c}`") for c in keep]).alias("row"), "x")
    schema = f"row {wide.schema['row'].dataType.simpleString()}, _whitened array<double>, _deviation long"
    if model is None:
        return wide.limit(0).selectExpr("row.*", "CAST(NULL AS array<double>) AS _whitened", "CAST(NULL AS long) AS _deviation"), None

    @tidy
    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, m in _blocks(batches, "x", len(model.sums)):
            w = model.whitened(m)
            lists = pa.ListArray.from_arrays(np.arange(len(w) + 1, dtype=np.int32) * w.shape[1], pa.array(w.ravel()))
            yield pa.RecordBatch.from_arrays([batch.column("row"), lists, pa.array(model.deviation(m), pa.int64())], ["row", "_whitened", "_deviation"])

    return wide.mapInArrow(project, schema).select("row.*", "_whitened", "_deviation"), model


def op11_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, model = whiten(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"))
    share = (model.eigenvalues / model.trace).tolist() if model and model.trace else []
    explained = F.element_at(F.array(*map(F.lit, share)), F.col("component")) if share else F.lit(None).cast("double")
    out = rows.select("vec_id", "_deviation", F.posexplode("_whitened").alias("component", "whitened")).withColumn("component", F.col("component") + 1)
    return out.select("vec_id", "component", F.lit(model.n if model else 0).cast("long").alias("n"), F.col("_deviation").alias("deviation"), "whitened", explained.alias("explained"), F.lit(model.identity_error if model else 0.0).alias("identity_error"))
