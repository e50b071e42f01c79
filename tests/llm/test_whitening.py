"""Whitening against exact covariances and eigenvectors of known matrices."""

from __future__ import annotations

import math
from fractions import Fraction

import numpy as np
import pytest

from dialtone.llm import queries, whitening


def rotated(values, seed):
    """A symmetric matrix of extended precision with these eigenvalues, and its eigenvectors."""
    rng = np.random.default_rng(seed)
    vectors = np.eye(len(values), dtype=np.longdouble)
    for _ in range(6):
        v = rng.normal(size=len(values)).astype(np.longdouble)
        vectors -= 2 * np.outer(vectors @ v, v) / (v @ v)
    m = vectors @ np.diag(np.array(values, np.longdouble)) @ vectors.T
    return (m + m.T) / 2, vectors


@pytest.mark.parametrize("values", [
    [5, 4, 3, 2, 1], [1e6, 3.0, 2.0, 1e-3], [1, 1 + 1e-7, 1 + 2e-7, 2, 3], [1, 1 + 1e-11, 1 + 2e-11, 5, 5 + 1e-10, 9],
    [2, 2, 2, 1, 1], [1, 1, 1], [4, 1, 0, 0], [7.0], list(np.linspace(1, 2, 60)), [1 + i * 1e-9 for i in range(20)] + [3, 4],
])
def test_refined_vectors(values):
    matrix, _ = rotated(values, len(values))
    found, vectors = whitening.eigenvectors(matrix)
    exact = np.sort(np.array(values, np.longdouble))[::-1]
    scale = float(exact[0])
    assert np.abs(found - exact).max() < 1e-17 * scale * 10
    assert np.abs(vectors.T @ vectors - np.eye(len(values))).max() < 1e-17
    assert np.abs(matrix @ vectors - vectors * found).max() < 1e-17 * scale * 10
    # single precision alone is far from that
    if len(values) > 3 and len(set(values)) == len(values):
        rough = np.linalg.eigh(matrix.astype(np.float32))[1].astype(np.longdouble)
        assert np.abs(rough.T @ rough - np.eye(len(values))).max() > 1e-9


@pytest.mark.parametrize("values", [[1, 1 + 1e-11, 1 + 2e-11, 5, 5 + 1e-10, 9], [1 + i * 1e-9 for i in range(20)] + [3, 4]])
def test_clusters_need_their_own_solves(values, monkeypatch):
    matrix, _ = rotated(values, 3)
    off = lambda: np.abs((lambda v: v.T @ matrix @ v - np.diag(np.diag(v.T @ matrix @ v)))(whitening.eigenvectors(matrix)[1])).max()
    good = off()
    monkeypatch.setattr(whitening, "_turned", lambda matrix, vectors, values, group: vectors[:, group])
    monkeypatch.setattr(whitening, "ROUNDS", 8)
    assert good < 1e-17 < 1e-13 < off()


def test_products_are_exact():
    rng = np.random.default_rng(2)
    for most in (3, 10**6, 2**40, 2**52):
        rows = rng.integers(-most, most, (50, 4))
        want = [[sum(int(r[i]) * int(r[j]) for r in rows) for j in range(4)] for i in range(4)]
        assert whitening.exact_products(rows).tolist() == want
    assert whitening.exact_products(np.zeros((0, 2), np.int64)).tolist() == [[0, 0], [0, 0]]


def usable(vector):
    return vector is not None and all(c is not None and math.isfinite(c) for c in vector)


def check(rows, got, tolerance=1e-9):
    """`rows` of (id, vector); every row of the result against exact sums and numpy's double-precision solver."""
    fit = [(i, [math.floor(64 * float(c)) + 1_000_000 for c in v]) for i, v in rows if usable(v)]
    n, d = len(fit), len(fit[0][1])
    sums = [sum(x[k] for _, x in fit) for k in range(d)]
    apart = [[n * a - s for a, s in zip(x, sums)] for _, x in fit]
    cov = np.array([[float(Fraction(sum(r[i] * r[j] for r in apart), n**3)) for j in range(d)] for i in range(d)])
    values, vectors = np.linalg.eigh(cov)
    values, vectors = values[::-1], vectors[:, ::-1]
    k = min(d, 32)
    assert len(got) == n * k
    by = {}
    for r in got:
        by.setdefault(r.vec_id, []).append(r)
    ids = [i for i, _ in fit]
    table = np.full((n, k), np.nan)
    for at, (i, own) in enumerate(zip(ids, apart)):
        mine = {r.component: r for r in by[i] if int(r.deviation) == sum(a * a for a in own)}  # equal rows have equal results
        mine = [mine[c] for c in sorted(mine)]
        assert [r.component for r in mine] == list(range(1, k + 1)) and all(r.n == n for r in mine)
        table[at] = [np.nan if r.whitened is None else r.whitened for r in mine]
        for r in mine:
            assert r.explained == pytest.approx(max(values[r.component - 1], 0) / values.sum(), rel=1e-6, abs=1e-12)
    live = values[:k] > 1e-12 * values.sum()
    assert np.isnan(table[:, ~live]).all()
    want = np.array(apart, np.float64) / n @ vectors[:, :k][:, live] / np.sqrt(values[:k][live])
    sign = np.sign((want * table[:, live]).sum(axis=0))
    assert np.abs(want * sign - table[:, live]).max(initial=0) < tolerance
    error, = {r.identity_error for r in got}
    w = table[:, live] - table[:, live].mean(axis=0)
    assert error < 1e-9 and abs(error - np.abs(w.T @ w / n - np.eye(live.sum())).max(initial=0)) < 1e-11


def frame(spark, rows):
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    from pyspark.sql import functions as F

    return df.withColumns({"v": F.lit("v"), "n": F.lit(1), "component": F.lit(9), "whitened": F.lit(0.0), "cell": F.lit(2), "label": F.lit(None).cast("int")})


AWKWARD = [(900, None), (901, [1.0, None, 2.0]), (902, [float("nan"), 0.0, 1.0]), (903, [1.0, float("inf"), 0.0])]


@pytest.mark.parametrize("many", [40, 2])
def test_awkward_vectors(spark, many, monkeypatch):
    monkeypatch.setattr(whitening, "CHUNK", 7)
    rng = np.random.default_rng(8)
    rows = [(i, [float(x) for x in rng.normal(size=3).astype(np.float32)]) for i in range(many)] + AWKWARD
    rows += [(0, rows[0][1]), (None, [0.5, 0.25, -3.0])]
    check(rows, whitening.whitened(frame(spark, rows).repartition(3)).collect())


def test_constant_dimension_and_equal_variances(spark):
    # dimension 2 never changes; the others have one variance
    rows = [(i, [float(s if i // 2 == d else 0) for d in range(2)] + [1.5]) for i, s in enumerate([1, -1, 1, -1])]
    got = whitening.whitened(frame(spark, rows)).collect()
    assert {r.whitened is None for r in got if r.component == 3} == {True} and {r.explained for r in got if r.component == 3} == {0.0}
    table = np.array([[next(r.whitened for r in got if (r.vec_id, r.component) == (i, c)) for c in (1, 2)] for i in range(4)])
    assert np.abs(table.T @ table / 4 - np.eye(2)).max() < 1e-12 and max(r.identity_error for r in got) < 1e-12


def test_few_and_odd_tables(spark):
    assert whitening.whitened(frame(spark, [])).collect() == []
    assert whitening.whitened(frame(spark, AWKWARD)).collect() == []
    assert whitening.whitened(frame(spark, [(1, []), (2, [])])).collect() == []
    one = whitening.whitened(frame(spark, [(1, [1.0, 2.0])])).collect()
    assert [(r.component, r.n, int(r.deviation), r.whitened, r.explained, r.identity_error) for r in one] == [(1, 1, 0, None, None, 0.0), (2, 1, 0, None, None, 0.0)]
    short = whitening.whitened(frame(spark, [(1, [1.0]), (2, [0.0, 2.0]), (3, []), (4, [0.5, 0.5])]))
    check([(1, [1.0, 0.0]), (2, [0.0, 2.0]), (3, [0.0, 0.0]), (4, [0.5, 0.5])], short.collect())
    with pytest.raises(Exception, match="2\\^46"):
        whitening.whitened(frame(spark, [(1, [1e20])])).collect()


def test_far_from_the_origin(spark):
    rng = np.random.default_rng(6)
    rows = [(i, [float(np.float32(x)) for x in 1e4 + rng.normal(size=4)]) for i in range(30)]
    check(rows, whitening.whitened(frame(spark, rows)).collect())


def test_query(spark, sf_dir):
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{sf_dir}/embeddings.parquet").collect()]
    check(rows, queries.op13_embedding_whitening(spark, sf_dir).collect(), 1e-8)
