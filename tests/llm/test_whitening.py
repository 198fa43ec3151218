"""Whitening against numpy's eigenvectors and exact integers."""

from fractions import Fraction

import numpy as np
import pytest

from refloom.llm import whitening
from tests.llm.test_brute import empty_dir  # noqa: F401


def brute(rows, width):
    """Rows that take part with their vectors, and the model, from the covariance."""
    fine = [(i, v) for i, v in rows if v is not None and all(x is not None and np.isfinite(x) for x in v)]
    x = [tuple(int(np.floor(256 * float(c))) for c in v) + (0,) * (width - len(v)) for _, v in fine]
    unique = sorted(set(x))
    n, sums = len(unique), [sum(c) for c in zip(*unique, strict=True)]
    mean = np.array([float(Fraction(s, n)) for s in sums])
    c = np.array(unique, float) - mean
    values, vectors = np.linalg.eigh(c.T @ c / n)
    return [i for i, _ in fine], x, n, sums, mean, values[::-1], vectors[:, ::-1]


def check(spark, folder, width=64):
    got = whitening.op11_whitening(spark, folder).toPandas()
    rows = [tuple(r) for r in spark.read.parquet(f"{folder}/embeddings.parquet").select("vec_id", "embedding").collect()]
    ids, x, n, sums, mean, values, vectors = brute(rows, width)
    assert (got.n == n).all() and got.identity_error.max() <= 1e-6 and got.identity_error.nunique() == 1
    deviation = sorted(zip([-1 if i is None else i for i in ids], [sum((n * a - s) ** 2 for a, s in zip(v, sums, strict=True)) for v in x], strict=True))
    for k in range(min(4, width)):
        part = got[got.component == k + 1].fillna({"vec_id": -1})
        assert sorted(zip(part.vec_id.astype(int), part.deviation, strict=True)) == deviation
        assert np.allclose(part.explained, values[k] / values.sum(), rtol=1e-9)
        want = (np.array(x) - mean) @ vectors[:, k] / np.sqrt(values[k])
        a, b = np.sort(part.whitened), np.sort(want)
        assert min(np.abs(a - b).max(), np.abs(a + b[::-1]).max()) < 1e-6
        assert len(part) == len(ids)


def test_query(spark, small):
    check(spark, small)


def test_odd_rows(spark, tmp_path):
    rng = np.random.default_rng(5)
    rows = [(i, [float(v) for v in rng.normal(size=5) * [3, 2, 1, 0.5, 0.1]], "x") for i in range(40)]
    rows += [(None, rows[0][1], None), (3, rows[0][1], "again"), (3, rows[0][1], "again"), (50, None, ""), (51, [1.0, None, 0.0, 0.0, 0.0], ""), (52, [float("nan")] * 5, ""), (53, [float("inf")] * 5, "")]
    rows += [(54, [], "empty counts as zeros"), (55, [1.5, -0.0], "short")]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>, x string").write.parquet(f"{tmp_path}/embeddings.parquet")
    check(spark, str(tmp_path), 5)
    df, model = whitening.whiten(spark.read.parquet(f"{tmp_path}/embeddings.parquet").selectExpr("*", "1 AS part", "2 AS r", "3 AS row"))
    assert df.columns == ["vec_id", "embedding", "part", "r", "row", "_whitened", "_deviation"] and df.count() == 45 and model.n == 42


@pytest.mark.parametrize("rows", [[], [(1, None)], [(1, [1.0, 2.0]), (2, [1.0, 2.0])], [(1, [])]])
def test_nothing_to_whiten(spark, tmp_path, rows):
    spark.createDataFrame(rows, "vec_id long, embedding array<float>").write.parquet(f"{tmp_path}/embeddings.parquet")
    out = whitening.op11_whitening(spark, str(tmp_path))
    assert out.collect() == [] and out.columns == ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]


def test_fewer_components_than_asked(spark):
    rows = [(i, [float(i), 2.0 * i, 0.0]) for i in range(9)]
    df, model = whitening.whiten(spark.createDataFrame(rows, "vec_id long, embedding array<double>"))
    assert len(model.eigenvalues) == 1 and {len(r["_whitened"]) for r in df.collect()} == {1} and model.identity_error < 1e-12


def test_large_entries(spark):
    make = lambda *v: spark.createDataFrame([(i, [x, 1.0]) for i, x in enumerate(v)], "vec_id long, embedding array<double>")
    df, model = whitening.whiten(make(1e6, -1e6, 3e6))
    x = [256_000_000, -256_000_000, 768_000_000]
    assert [r["_deviation"] for r in df.orderBy("vec_id").collect()] == [(3 * a - sum(x)) ** 2 for a in x] and model.sums == [sum(x), 768]
    with pytest.raises(Exception, match="too large"):
        whitening.whiten(make(1e300, 1.0))


@pytest.mark.parametrize("shape", [(1, 1), (3, 7), (40, 12), (200, 33)])
def test_rotations(shape):
    rng = np.random.default_rng(0)
    a = rng.normal(size=shape) * 10.0 ** rng.integers(-3, 3, shape[1])
    length, v = whitening.jacobi(a)
    want = np.linalg.svd(a, compute_uv=False)
    assert np.allclose(length[: len(want)], want, rtol=1e-8) and np.allclose(v.T @ v, np.eye(shape[1]), atol=1e-12)
    assert np.allclose(np.linalg.norm(a @ v, axis=0), length, atol=1e-9 * length[0])


def test_tree_of_triangles(spark):
    """Many partitions give the same as one."""
    rng = np.random.default_rng(1)
    rows = [(i, [float(v) for v in rng.normal(size=6)]) for i in range(500)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    a, b = (whitening.fit(whitening.integers(d)) for d in (df.repartition(60), df.coalesce(1)))
    assert np.allclose(a.vectors, b.vectors, atol=1e-9) and np.allclose(a.eigenvalues, b.eigenvalues, rtol=1e-12) and a.sums == b.sums
