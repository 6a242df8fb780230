"""Whitening against plain arithmetic."""

from __future__ import annotations

import random
from collections import Counter, defaultdict
from fractions import Fraction

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tests.llm.helpers import frame
from tests.oracle import SF
from tremolite.llm.queries import op11_whitening, table
from tremolite.llm.whitening import fit_whitening, identity_error, jacobi, whiten

SCHEMA = "vec_id long, embedding array<double>"


@settings(max_examples=60, deadline=None)
@given(st.integers(1, 12), st.integers(0, 10**6))
def test_jacobi(n, seed):
    rng = np.random.default_rng(seed)
    a = rng.normal(size=(n, int(rng.integers(1, 2 * n + 1))))
    a = a @ a.T
    e, v = jacobi(a)
    want = np.linalg.eigvalsh(a)[::-1]
    assert np.allclose(e, want, rtol=1e-9, atol=1e-9 * want.max())
    assert np.allclose(v.T @ v, np.eye(n), atol=1e-12)
    assert np.allclose(v * e @ v.T, a, atol=1e-10 * want.max())


def test_jacobi_keeps_small_eigenvalues():
    scale = np.array([1.0, 1e-4, 1e-8])
    core = np.array([[1, 0.3, 0.2], [0.3, 1, 0.1], [0.2, 0.1, 1]])
    e, _ = jacobi(core * scale[:, None] * scale)
    # the determinant by exact fractions gives the smallest one from the other two
    exact = [[Fraction(float(core[i, j] * scale[i] * scale[j])) for j in range(3)] for i in range(3)]
    (a, b, c), (d, f, g), (h, i, j) = exact
    det = float(a * (f * j - g * i) - b * (d * j - g * h) + c * (d * i - f * h))
    assert np.prod(e) == pytest.approx(det, rel=1e-12)


def plain(vectors):
    """Grid numbers, mean and covariance in exact fractions, and eigenpairs of that."""
    x = [[int(np.floor(1024 * c)) + 100000 for c in v] for v in vectors]
    n, d = len(x), len(x[0])
    s = [sum(r[i] for r in x) for i in range(d)]
    z = [[Fraction(n * r[i] - s[i], n) for i in range(d)] for r in x]
    v = np.array([[float(sum(r[i] * r[j] for r in z) / n) for j in range(d)] for i in range(d)])
    return x, s, np.array([[float(c) for c in r] for r in z]), v


def check(rows, got, k=8):
    vectors = {i: v for i, v in rows}
    x, s, z, v = plain(list(vectors.values()))
    e, u = np.linalg.eigh(v)
    e, u = e[::-1], u[:, ::-1]
    n = len(x)
    found = defaultdict(dict)
    for r in got:
        found[r.component][r.vec_id] = r
    assert sorted(found) == list(range(1, min(k, len(v)) + 1))
    for c, by_id in found.items():
        assert set(by_id) == set(vectors)
        want = z @ u[:, c - 1] / np.sqrt(e[c - 1])
        have = np.array([by_id[i].whitened for i in vectors])
        assert min(np.abs(have - want).max(), np.abs(have + want).max()) < 1e-7
        for r, row in zip(x, by_id.values(), strict=False):
            assert row.n == n and row.explained == pytest.approx(e[c - 1] / e.sum(), rel=1e-9) and row.identity_error < 1e-9
        assert [by_id[i].deviation for i in vectors] == [sum((n * r[i] - s[i]) ** 2 for i in range(len(s))) for r in x]


def test_query(spark):
    rows = [(r.vec_id, r.embedding) for r in table(spark, SF, "embeddings").collect()]
    check(rows, op11_whitening(spark, SF).collect())


@pytest.mark.parametrize("width", [1, 3, 8, 11])
def test_small_tables(spark, width, tmp_path):
    rng = random.Random(width)
    rows = [(i, [rng.gauss(5, 1) * (j + 1) for j in range(width)]) for i in range(40)]
    bad = [(100, None), (101, []), (102, [None] * width), (103, [float("nan")] * width), (104, [float("inf")] * width), (105, [1.0] * (width + 1))]
    frame(spark, rows + bad, SCHEMA).withColumns({"n": F.lit(1), "whitened": F.lit("x"), "id": F.lit(2)}).write.parquet(f"{tmp_path}/embeddings.parquet")
    check(rows, op11_whitening(spark, str(tmp_path)).collect())


def test_awkward(spark, tmp_path):
    assert fit_whitening(frame(spark, [], SCHEMA)) is None
    frame(spark, [(1, None)], SCHEMA).write.parquet(f"{tmp_path}/embeddings.parquet")
    assert op11_whitening(spark, str(tmp_path)).collect() == []
    # repeated rows and null ids count each; a component without variance is 0
    rows = frame(spark, [(1, [1.0, 2.0]), (1, [1.0, 2.0]), (None, [3.0, 2.0])], SCHEMA)
    model = fit_whitening(rows)
    made = whiten(rows, model)
    assert Counter(r.vec_id for r in made.collect()) == Counter([1, 1, None])
    assert all(r.whitened[1] == 0 for r in made.collect()) and identity_error(made, model) < 1e-12
    # entries beyond the grid are held at its end, and sums stay exact
    rows = frame(spark, [(1, [1e300, 0.0]), (2, [-1e300, 1.0]), (3, [0.0, 2.0])], SCHEMA)
    model = fit_whitening(rows)
    assert model.n == 3 and model.sums[0] == 300000
    got = {r.vec_id: r.deviation for r in whiten(rows, model).collect()}
    assert got[1] == (3 * (2**40 + 100000) - 300000) ** 2 + (3 * 100000 - model.sums[1]) ** 2


def test_same_for_any_partitions(spark):
    rows = table(spark, SF, "embeddings")
    one, many = fit_whitening(rows.coalesce(1)), fit_whitening(rows.repartition(13))
    assert one.sums == many.sums and (one.values == many.values).all() and (one.vectors == many.vectors).all()
