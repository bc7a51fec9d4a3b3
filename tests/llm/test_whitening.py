import numpy as np
import pytest

from lattika.llm import whitening
from lattika.llm.whitening import lobpcg, whiten

SCHEMA = "vec_id long, embedding array<double>, component string, n string"


def table_of(spark, rows):
    return spark.createDataFrame([(i, v, "c", "n") for i, v in rows], SCHEMA)


def brute(rows, k=8):
    """vec_id -> scores up to sign, eigenvalues, deviations, trace, of rows with good vectors."""
    good = [(i, v) for i, v in rows if v and all(x is not None and np.isfinite(x) for x in v)]
    x = np.array([[int(np.floor(1024 * c)) + 100000 for c in v] for _, v in good], dtype=object)
    n, sums = len(x), x.sum(axis=0)
    apart = n * x - sums
    c = apart.astype(float) / n
    e, b = np.linalg.eigh(c.T @ c / n)
    e, b = e[::-1][:k], b[:, ::-1][:, :k]
    return [i for i, _ in good], (apart**2).sum(axis=1).tolist(), c @ b / np.sqrt(e), e / (c**2).sum() * n


def test_against_a_dense_solver(spark, monkeypatch):
    monkeypatch.setattr(whitening, "ENTRIES", 300)
    rng = np.random.default_rng(4)
    rows = [(i * 3, (rng.normal(size=40) * np.linspace(3, 0.2, 40) + 0.3).tolist()) for i in range(600)]
    ids, deviation, scores, explained = brute(rows)
    found = whiten(table_of(spark, rows).repartition(5)).collect()
    assert len(found) == 8 * len(rows)
    by = {(r.vec_id, r.component): r for r in found}
    got = np.array([[by[i, c].whitened for c in range(1, 9)] for i in ids])
    got *= np.sign((got * scores).sum(axis=0))
    assert np.allclose(got, scores, rtol=0, atol=1e-9)
    assert [by[i, 1].deviation for i in ids] == deviation and {r.n for r in found} == {600}
    assert np.allclose([by[ids[0], c].explained for c in range(1, 9)], explained, rtol=1e-10)
    assert len({r.identity_error for r in found}) == 1 and found[0].identity_error < 1e-10
    assert max(r.residual for r in found) < 1e-11


@pytest.mark.parametrize("shape", ["clustered", "close", "wide"])
def test_rounds_reach_certified_residuals(shape):
    """Many more dimensions than the basis has columns; clustered, close and far apart eigenvalues."""
    rng = np.random.default_rng(1)
    dim = 300
    q = np.linalg.qr(rng.normal(size=(dim, dim)))[0]
    e = {"clustered": np.r_[np.full(4, 9.0), np.full(4, 5.0), np.linspace(3, 1, dim - 8)], "close": np.linspace(2, 1, dim), "wide": 0.9 ** np.arange(dim)}[shape]
    a = (q * e) @ q.T
    rounds = []
    values, vectors, residuals = lobpcg(lambda b: (rounds.append(b.shape[1]), a @ b)[1], dim, 8)
    assert np.allclose(values, e[:8], rtol=1e-10) and residuals.max() < 1e-11 and np.allclose(vectors.T @ vectors, np.eye(8), atol=1e-12)
    assert np.allclose(np.linalg.norm(a @ vectors - vectors * values, axis=0), residuals, atol=1e-12)
    assert max(rounds) <= 72 and len(rounds) < 200


def test_nulls_odd_entries_repeated_rows_and_lengths(spark):
    rng = np.random.default_rng(2)
    good = [(i % 9 if i % 4 else None, rng.normal(size=5).tolist()) for i in range(40)] * 2
    odd = [(100, None), (101, []), (102, [1.0, None, 0.0, 0.0, 0.0]), (103, [float("nan")] * 5), (104, [float("inf")] + [0.0] * 4)]
    found = whiten(table_of(spark, good + odd + [(105, [1.0, 2.0])])).collect()
    assert len(found) == 5 * len(good) and {r.vec_id for r in found} == {i for i, _ in good} and {r.n for r in found} == {80}
    _, deviation, _, explained = brute(good)
    assert sorted(r.deviation for r in found if r.component == 1) == sorted(deviation)
    assert np.allclose(sorted({round(r.explained, 12) for r in found}, reverse=True), explained, rtol=1e-8)


def test_fewer_directions_than_components(spark):
    """Rows on a line have one component; rows of equal value, one row and no rows have none."""
    line = whiten(table_of(spark, [(i, [float(i), 2.0 * i, 1.0]) for i in range(20)])).collect()
    assert len(line) == 20 and {r.component for r in line} == {1} and abs(line[0].explained - 1) < 1e-12 and line[0].identity_error < 1e-10
    assert np.isclose(sum(r.whitened**2 for r in line) / 20, 1)
    for rows in ([(i, [1.0, 2.0]) for i in range(5)], [(1, [3.0, 4.0])], [], [(1, None)]):
        out = whiten(table_of(spark, rows))
        assert out.count() == 0 and out.columns[:7] == ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]


def test_deviation_is_exact_or_null():
    whitener = whitening.Whitener(7, np.array([3, 5]), 1.0, np.ones(1), np.ones((2, 1)), np.zeros(1))
    assert whitener.deviations(np.array([[400_000_000, 1], [2, 1]])).to_pylist() == [(7 * 400_000_000 - 3) ** 2 + 4, 125]
    assert whitener.deviations(np.array([[500_000_000, 1]])).to_pylist() == [None]
