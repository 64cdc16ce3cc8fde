"""Whitening against a plain eigendecomposition and exact integers."""

from __future__ import annotations

import math

import numpy as np
import pytest

from marketloom.llm import queries, whitening

SF = "/root/testdata/sf0.001"
KIND = "vec_id long, embedding array<float>, id string, x int, n string, whitened int"


def plain(rows, k=8):
    """``{(vec_id, component): (n, deviation, whitened, explained)}`` and the component count, of whole rows of one length."""
    x = np.array([[math.floor(1024 * float(c)) + 100_000 for c in v] for _, v in rows], np.int64)
    n, s = len(x), x.sum(0)
    y = x - s / n
    cov = y.T @ y / n
    e, u = np.linalg.eigh(cov)
    e, u = e[::-1][:k], u[:, ::-1][:, :k]
    deviation = [sum((n * int(a) - int(b)) ** 2 for a, b in zip(row, s)) for row in x]
    return n, deviation, y @ u / np.sqrt(e), e / np.trace(cov)


def check(found, rows, k=8):
    n, deviation, white, explained = plain(rows, k)
    table = {}
    for r in found:
        table.setdefault(r.component, {})[r.vec_id] = r
    assert set(table) == set(range(1, white.shape[1] + 1))
    for c, by_id in table.items():
        got = np.array([by_id[i].whitened for i, _ in rows])
        want = white[:, c - 1]
        assert min(np.abs(got - want).max(), np.abs(got + want).max()) < 1e-6
        assert all(by_id[i].deviation == d and by_id[i].n == n for (i, _), d in zip(rows, deviation))
        assert all(abs(by_id[i].explained / explained[c - 1] - 1) < 1e-9 and by_id[i].identity_error < 1e-9 for i, _ in rows)


def test_query_is_the_plain_one(spark):
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{SF}/embeddings.parquet").collect()]
    check(queries.op13_whitening(spark, SF).collect(), rows)


def test_odd_tables(spark):
    rng = np.random.default_rng(2)
    good = [(i, rng.standard_normal(12).astype(np.float32).tolist()) for i in range(80)]
    bad = [(100, None), (101, []), (102, [1.0] * 11 + [None]), (103, [1.0] * 11 + [float("nan")]), (104, [1.0] * 11 + [float("inf")]), (105, [1.0] * 5), (106, [3e38] * 12)]
    frame = lambda rows: spark.createDataFrame([(*r, "clash", 1, "clash", 1) for r in rows], KIND)
    check(whitening.whiten(frame(good + bad)).collect(), good)
    twice = whitening.whiten(frame(good + good)).collect()
    assert len(twice) == 2 * 80 * 8 and {r.n for r in twice} == {160}
    for rows in ([], bad[:5], good[:1], [(i, good[0][1]) for i in range(9)]):  # nothing to whiten
        assert whitening.whiten(frame(rows)).count() == 0
    line = [(i, [float(i), 2.0 * i, 0.0]) for i in range(7)] + [(None, [9.0, 18.0, 0.0])]  # one component only
    found = whitening.whiten(frame(line)).collect()
    assert {r.component for r in found} == {1} and len(found) == 8 and any(r.vec_id is None for r in found)


def test_sums_are_exact_and_wide_deviations_null(spark):
    y = np.array([[1 << 38, -5], [-(1 << 38) + 1, 7], [3, (1 << 39) - 1]], np.int64)
    assert whitening.exact_gram(y).tolist() == [[sum(int(a[i]) * int(a[j]) for a in y) for j in range(2)] for i in range(2)]
    rows = whitening.whiten(spark.createDataFrame([(i, [float((i * 7919 % 100) << 23), float(i)]) for i in range(200)], "vec_id long, embedding array<double>")).collect()
    assert len(rows) == 400 and all(r.deviation is None or r.deviation >= 0 for r in rows) and any(r.deviation is None for r in rows)


@pytest.mark.parametrize("case", range(6))
def test_feast_misses_none(case):
    rng = np.random.default_rng(case)
    q = np.linalg.qr(rng.standard_normal((20, 20)))[0]
    e = [np.arange(20.0, 0, -1), np.array([5.0] * 12 + [1.0] * 8), np.array([1e9] + [1.0] * 19), 2.0 ** -np.arange(20), np.array([3.0, 2.0] + [0.0] * 18), np.r_[4.0, 4 - 1e-9, 4 - 2e-9, np.ones(17)]][case]
    v = (q * e) @ q.T
    v = (v + v.T) / 2
    values, vectors = whitening.feast(v, 8)
    want = [x for x in np.sort(np.linalg.eigvalsh(v))[::-1][:8] if x > 1e-12 * np.trace(v)]
    assert len(values) == len(want) and np.allclose(values, want, rtol=1e-9, atol=1e-12 * np.trace(v))
    assert np.abs(vectors.T @ vectors - np.eye(len(values))).max() < 1e-8 and np.abs(v @ vectors - vectors * values).max() < 1e-9 * np.trace(v)


@pytest.mark.parametrize("spread", [0.1, 0.01, 1e-4, 1e-7])
def test_feast_where_eigenvalues_are_close(spread):
    """Many vectors of no direction have nearly equal variances, beside those of large groups of copies."""
    for seed in range(3):
        rng = np.random.default_rng(seed)
        q = np.linalg.qr(rng.standard_normal((64, 64)))[0]
        e = np.sort(np.r_[1.3, 1.15, 1 + spread * rng.random(62)][seed % 2 :])[::-1] if seed else np.r_[2.0, 1 + spread * np.linspace(1, 0, 63)]
        q = q[:, : len(e)]
        v = (q * e) @ q.T
        values, vectors = whitening.feast((v + v.T) / 2, 8)
        assert np.allclose(values, e[:8], rtol=1e-12) and np.abs(vectors.T @ vectors - np.eye(8)).max() < 1e-6
        assert np.abs(v @ vectors - vectors * values).max() < 1e-12


def test_inertia_counts():
    rng = np.random.default_rng(9)
    for d in (1, 2, 5, 17):
        a = rng.standard_normal((d, d))
        a = a + a.T
        for shift in rng.standard_normal(5) * 3:
            assert whitening.count_above(a, shift) == (np.linalg.eigvalsh(a) > shift).sum()
    assert whitening.count_above(np.array([[0.0, 1.0], [1.0, 0.0]]), 0.0) == 1
