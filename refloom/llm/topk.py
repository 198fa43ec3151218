"""Exact top-k by inner product: columnar branch and bound.

A block of candidates is kept in vertical layout, one row of numbers per dimension.  For a query, inner products grow block of
dimensions by block; after each, a candidate whose score so far plus the most that the remaining dimensions can add
(the product of the two remaining norms) is below what k others reach at least is dropped and the columns are
compacted.  Scores are integers, so ties are exact.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import table

K = 10
SCALE = 1024
QUERY_BLOCK = 1024
CANDIDATE_BLOCK = 4096
DIMENSIONS = 8


def _matrix(column: pa.ChunkedArray, width: int) -> np.ndarray:
    """Integer components by row; missing dimensions count as 0."""
    flat = column.combine_chunks()
    if isinstance(flat, pa.ChunkedArray):
        flat = pa.concat_arrays(flat.chunks)
    n = np.diff(flat.offsets.to_numpy())
    out = np.zeros((len(n), width), np.float64)
    out[np.arange(width) < n[:, None]] = np.floor(SCALE * flat.flatten().to_numpy().astype(np.float64))
    return out


def _exact_block(queries: np.ndarray, qid: np.ndarray, cands: np.ndarray, cid: np.ndarray, k: int, most: float):
    """search_block() without bounds, in 64-bit integers or, where sums could leave them, in Python's."""
    if most < 2**62:
        queries, cands = queries.astype(np.int64), cands.astype(np.int64)
    else:
        queries, cands = (np.array([[int(v) for v in row] for row in m.tolist()], object).reshape(m.shape) for m in (queries, cands))
    for q in range(len(queries)):
        alive = np.flatnonzero(cid != qid[q])
        score = cands[alive] @ queries[q]
        best = np.lexsort((cid[alive], -score))[:k] if score.dtype != object else np.array(sorted(range(len(alive)), key=lambda i: (-score[i], cid[alive[i]]))[:k], int)
        yield q, alive[best], np.array([int(v) for v in score[best]], np.int64)


def search_block(queries: np.ndarray, qid: np.ndarray, cands: np.ndarray, cid: np.ndarray, k: int = K):
    """Query index, candidate index and score of the k best of the block for each query, its own id left out."""
    n, width = cands.shape
    most = float(np.abs(queries).max(initial=0)) * float(np.abs(cands).max(initial=0)) * width
    if most >= 2**40:  # doubles would not hold scores and bounds finely enough
        yield from _exact_block(queries, qid, cands, cid, k, most)
        return
    vertical = np.ascontiguousarray(cands.T)
    cuts = [*range(0, width, DIMENSIONS), width]
    mass = lambda m: np.sqrt(np.cumsum((m * m)[:, ::-1], axis=1)[:, ::-1])  # noqa: E731  norm of dimensions j and after
    c_mass, q_mass = mass(cands), mass(queries)
    for q in range(len(queries)):
        alive = np.flatnonzero(cid != qid[q])
        score = np.zeros(len(alive))
        for lo, hi in zip(cuts, cuts[1:], strict=False):
            score += queries[q, lo:hi] @ vertical[lo:hi, alive]
            if hi < width and len(alive) > k:
                rest = q_mass[q, hi] * c_mass[alive, hi] * (1 + 1e-9) + 1e-3
                floor = np.partition(score - rest, len(alive) - k)[len(alive) - k]
                stay = score + rest >= floor
                if stay.mean() < 0.9:
                    alive, score = alive[stay], score[stay]
        best = np.lexsort((cid[alive], -score))[:k]
        yield q, alive[best], score[best].astype(np.int64)


def top_k(vectors: DataFrame, queries: DataFrame, k: int = K) -> DataFrame:
    """vectors, queries: vec_id, embedding.  query_id, rank, vec_id, score: the k best of all vectors but the query's own id,
    ties to the smaller id.

    Vectors that are null or hold a null or non-finite component, and rows without id, take no part.  Vectors of unlike length
    are compared as if the shorter ended in zeros.  Repeated rows compete one by one as candidates; as queries, equal ones count
    once, and an id with several vectors gets k rows for each of them.  Scores are longs; where one leaves their range the query fails rather than be wrong.  Queries are dealt to blocks of about
    QUERY_BLOCK and every block meets every candidate block once; a block yields k rows per query at most, which a
    ranking per query reduces.  Nothing is broadcast.
    """
    x = F.col("embedding")
    fine = F.col("vec_id").isNotNull() & x.isNotNull() & F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    pick = [F.col("vec_id").cast("long").alias("vec_id"), x.cast("array<double>").alias("embedding")]
    c, q = vectors.filter(fine).select(*pick), queries.filter(fine).select(*pick).distinct()
    n_q, n_c = max(1, -(-q.count() // QUERY_BLOCK)), max(1, -(-c.count() // CANDIDATE_BLOCK))
    block = lambda n: F.pmod(F.xxhash64("vec_id", "embedding"), F.lit(n))
    every = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long")))
    c = c.withColumn("qb", every(n_q)).withColumn("cb", block(n_c))
    q = q.withColumn("embedding_hash", F.xxhash64("embedding")).withColumn("qb", block(n_q)).withColumn("cb", every(n_c))

    def search(left: pa.Table, right: pa.Table) -> pa.Table:
        width = max((max((len(v) for v in t["embedding"]), default=0) for t in (left, right)), default=0)
        if not len(left) or not len(right):
            return pa.table({"query_id": pa.array([], pa.int64()), "vector": pa.array([], pa.int64()), "vec_id": pa.array([], pa.int64()), "score": pa.array([], pa.int64())})
        qid, cid = left["vec_id"].to_numpy(), right["vec_id"].to_numpy()
        vector = left["embedding_hash"].to_numpy()
        found = list(search_block(_matrix(left["embedding"], width), qid, _matrix(right["embedding"], width), cid, k))
        at = np.repeat([f[0] for f in found], [len(f[1]) for f in found]).astype(int)
        return pa.table({"query_id": qid[at], "vector": vector[at], "vec_id": cid[np.concatenate([f[1] for f in found]).astype(int)], "score": np.concatenate([f[2] for f in found])})

    found = q.groupBy("qb", "cb").cogroup(c.groupBy("qb", "cb")).applyInArrow(search, "query_id long, vector long, vec_id long, score long")
    rank = F.row_number().over(Window.partitionBy("query_id", "vector").orderBy(F.col("score").desc(), "vec_id"))
    return found.withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op7_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = table(spark, sf_dir, "embeddings")
    return top_k(v, v.filter(F.col("vec_id") % 100 == 0))
