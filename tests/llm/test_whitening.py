"""Whitening against exact fractions and numpy: polynomials, roots, ill conditions, odd rows."""

from __future__ import annotations

import decimal as dc
from fractions import Fraction

import numpy as np
import pytest

from marketloom.llm import whitening as wh

SCHEMA = "vec_id long, embedding array<float>, component int, n string"


def make(spark, vectors, kind="float"):
    rows = [(k, None if v is None else [None if x is None else float(x) for x in v], 7, "clash") for k, v in enumerate(vectors)]
    return spark.createDataFrame(rows, SCHEMA.replace("array<float>", f"array<{kind}>")).repartition(3)


def plain_polynomial(a):
    """det(t - A) by Faddeev and LeVerrier in fractions, lowest first."""
    d = len(a)
    m, c, out = [[Fraction(0)] * d for _ in range(d)], Fraction(1), [Fraction(1)]
    for k in range(1, d + 1):
        m = [[sum(a[i][x] * m[x][j] for x in range(d)) + (c if i == j else 0) for j in range(d)] for i in range(d)]
        c = -sum(a[i][x] * m[x][i] for i in range(d) for x in range(d)) / k
        out.append(c)
    return [int(x) for x in reversed(out)]


@pytest.mark.parametrize("d,rank", [(1, 1), (2, 2), (6, 6), (7, 3)])
def test_polynomial_and_roots(d, rank, spark):
    r = np.random.default_rng(d)
    x = r.integers(-50, 50, (rank, d)).astype(object)
    a = x.T @ x
    poly = wh.characteristic_polynomial(spark, a)
    assert poly == plain_polynomial(a.tolist())
    roots = wh.positive_roots(poly, d)
    assert sum(c for *_, c in roots) == min(rank, d)
    want = sorted(np.linalg.eigvalsh(a.astype(float)))[::-1]
    assert [m / (1 << s) for m, s, c in roots for _ in range(c)] == pytest.approx(want[: min(rank, d)], rel=1e-9)


def test_hessenberg_modulo_small_primes():
    """Zero pivots and zero columns are met where numbers are few."""
    r = np.random.default_rng(1)
    for _ in range(40):
        a = r.integers(-3, 4, (6, 6)).astype(object)
        for p in (2, 3, 5, 2147483647):
            assert wh.charpoly_mod(a, p).tolist() == [c % p for c in plain_polynomial(a.tolist())]


def test_roots_that_are_equal_close_or_tiny():
    def expand(roots):
        out = [1]
        for x in roots:
            out = [(out[k - 1] if k else 0) - x * (out[k] if k < len(out) else 0) for k in range(len(out) + 1)]
        return out

    big = 10**30
    got = wh.positive_roots(expand([big, big, big - 1, 7, 7, 7, 1, 0, 0]), 9)
    assert [(round(Fraction(m, 1 << s)), c) for m, s, c in got] == [(big, 2), (big - 1, 1), (7, 3), (1, 1)]
    assert [c for *_, c in wh.positive_roots(expand([big, big, 5]), 1)] == [2]
    assert wh.positive_roots([0, 0, 1], 3) == []


def test_equals_numpy_and_exact_deviation(spark):
    r = np.random.default_rng(3)
    v = r.normal(0, 0.2, (400, 9)).astype(np.float32)
    v[:130] = v[0]  # a third are copies
    df = make(spark, v.tolist())
    out = wh.whiten(df, 5).toPandas()
    x = np.floor(64 * v.astype(float)) + 1e6
    c = x - x.mean(axis=0)
    values, vectors = np.linalg.eigh(c.T @ c / len(x))
    assert out.columns.tolist() == ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]
    got = out.pivot(index="vec_id", columns="component", values="whitened").to_numpy()
    assert np.abs(np.abs(got) - np.abs(c @ vectors[:, ::-1][:, :5] / np.sqrt(values[::-1][:5]))).max() < 1e-9
    assert out.explained[:5].tolist() == pytest.approx((values[::-1] / values.sum())[:5].tolist(), rel=1e-9)
    assert out.identity_error.max() < 1e-9 and set(out.n) == {400}
    whole = x.astype(np.int64).astype(object)
    assert out.drop_duplicates("vec_id").sort_values("vec_id").deviation.tolist() == ((400 * whole - whole.sum(axis=0)) ** 2).sum(axis=1).tolist()


def test_ill_conditioned_dimensions(spark):
    """One dimension of 2**38 beside ones of a sixty-fourth: doubles alone would lose the latter."""
    r = np.random.default_rng(5)
    v = np.stack([r.integers(-(2**38), 2**38, 60).astype(float), r.integers(0, 3, 60) / 64, r.integers(0, 2, 60) / 64 + r.integers(-(2**20), 2**20, 60)], axis=1)
    out = wh.whiten(make(spark, v.tolist(), "double")).toPandas()
    assert out.identity_error.max() < 1e-6 and set(out.component) == {1, 2, 3}
    x = np.floor(64 * v).astype(np.int64).astype(object)
    a = x.T @ x * 60 - np.outer(x.sum(axis=0), x.sum(axis=0))
    with dc.localcontext() as ctx:
        ctx.prec = 80
        low = [dc.Decimal(m) / (1 << s) for m, s, _ in wh.positive_roots(plain_polynomial(a.tolist()), 3)]
        assert [float(e / sum(dc.Decimal(int(a[k, k])) for k in range(3))) for e in low] == pytest.approx(out.explained[:3].tolist(), rel=1e-12)


def test_rows_that_go_and_components_without_variance(spark):
    nan, inf = float("nan"), float("inf")
    vectors = [[0.5, 1, 0], [0.25, 2, 0], None, [None, 1, 1], [nan, 1, 1], [1, inf, 1], [1, 2], [], [0.5, 1, 0], [2.0**41, 0, 0]]
    out = wh.whiten(make(spark, vectors, "double")).toPandas()
    assert sorted(set(out.vec_id)) == [0, 1, 8] and set(out.n) == {3} and set(out.component) == {1, 2, 3}
    first = out[out.component == 1]
    assert first.whitened.notna().all() and (first.explained == 1).all() and out[out.component > 1].whitened.isna().all() and (out[out.component > 1].explained == 0).all()
    assert out.identity_error.max() < 1e-12
    one = wh.whiten(make(spark, [[1, 2]])).toPandas()
    assert one.whitened.isna().all() and one.identity_error.isna().all() and set(one.deviation) == {0} and len(one) == 2


@pytest.mark.parametrize("vectors", [[], [None], [[], []]])
def test_nothing_to_fit(vectors, spark):
    out = wh.whiten(make(spark, vectors))
    assert out.count() == 0 and "whitened" in out.columns


def test_repeated_ids_null_ids_and_ties(spark):
    df = spark.createDataFrame([(1, [1.0, 0.0]), (1, [0.0, 1.0]), (None, [-1.0, 0.0]), (2, [0.0, -1.0])], "k string, v array<double>")
    out = wh.whiten(df, id_col="k", vector_col="v").toPandas()
    assert len(out) == 8 and out.k.isna().sum() == 2 and (out.explained == 0.5).all()  # two equal roots
    assert out.identity_error.max() < 1e-12


def test_a_deviation_beyond_a_long_is_null(spark):
    out = wh.whiten(make(spark, [[2.0**39], [-(2.0**39)], [0.0]], "double")).toPandas()
    assert out.deviation.isna().sum() == 2 and out.identity_error.max() < 1e-12
