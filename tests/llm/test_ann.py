import numpy as np
import pytest
from pyspark.sql import functions as F

from lattika.llm import ann
from lattika.llm.ann import search

SCHEMA = "vec_id long, embedding array<float>, list int, score double"


def brute(rows, k=10):
    good = {}
    for i, v in rows:
        if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v) and any(v):
            good.setdefault(i, []).append(np.array(v, np.float32).astype(float))
    out = {}
    for q in (i for i in good if i % 10 == 0):
        near = sorted((min(float(np.sqrt(((a - b) ** 2).sum())) for a in good[q] for b in good[i]), i) for i in good if i != q)
        out[q] = near[:k]
    return out


def run(spark, rows):
    df = spark.createDataFrame([(i, v, 1, 2.0) for i, v in rows], SCHEMA)
    found = {}
    for r in search(df, F.col("vec_id") % 10 == 0).orderBy("query_id", "rank").collect():
        found.setdefault(r.query_id, []).append((r.score, r.vec_id))
        assert r["rank"] == len(found[r.query_id])
    return found


def test_recall_and_exact_scores(spark):
    rng = np.random.default_rng(2)
    centers = rng.normal(size=(30, 24))
    rows = [(i, (centers[i % 30] + rng.normal(scale=0.5, size=24)).tolist()) for i in range(3000)]
    found, truth = run(spark, rows), brute(rows)
    assert found.keys() == truth.keys()
    hits = sum(len({i for _, i in found[q]} & {i for _, i in truth[q]}) for q in truth)
    assert hits >= 0.9 * sum(map(len, truth.values()))
    exact = {q: dict((i, d) for d, i in near) for q, near in brute(rows, 3000).items()}
    assert all(d == pytest.approx(exact[q][i], rel=1e-12) and near == sorted(near) for q, near in found.items() for d, i in near)


def test_recall_of_queries_that_lie_elsewhere(spark):
    rng = np.random.default_rng(4)
    centers = rng.normal(size=(60, 32))
    rows = [(i, (rng.normal(scale=1.5, size=32) if i % 10 == 0 else centers[i % 60] + rng.normal(scale=0.3, size=32)).tolist()) for i in range(4000)]
    found, truth = run(spark, rows), brute(rows)
    assert sum(len({i for _, i in found[q]} & {i for _, i in truth[q]}) for q in truth) >= 0.9 * sum(map(len, truth.values()))


def test_codes_choose_the_candidates(spark, monkeypatch):
    rng = np.random.default_rng(3)
    rows = [(i, rng.normal(size=16).tolist()) for i in range(2500)]
    truth = brute(rows)
    recall = lambda found: sum(len({i for _, i in found[q]} & {i for _, i in truth[q]}) for q in truth) / sum(map(len, truth.values()))

    class Blind(ann.Quantizer):
        """All codewords of a part are one."""

        def __init__(self, sample, lists):
            super().__init__(sample, lists)
            self.books = [np.zeros_like(w) for w in self.books]

    seeing = recall(run(spark, rows))
    monkeypatch.setattr(ann, "Quantizer", Blind)
    assert recall(run(spark, rows)) < 0.8 < 0.9 < seeing


def test_large_lists_are_several_blocks(monkeypatch):
    monkeypatch.setattr(ann, "BLOCK", 8192)
    held = np.array([20_000, 10, 8192, 8000, 100, 0])
    first, parts = ann.blocks(held, np.arange(12.0).reshape(6, 2))
    assert parts.tolist() == [3, 1, 1, 1, 1, 1]
    own = {b for i in (0,) for b in range(first[i], first[i] + parts[i])}
    assert not own & set(first[1:]) and all(held[1:][first[1:] == b].sum() <= ann.BLOCK for b in set(first[1:]))


def test_ties_go_to_the_smaller_id(spark):
    rows = [(i, [1.0, 2.0, 3.0]) for i in range(900)] + [(1000 + i, [float(i), 1.0, 0.5]) for i in range(40)]
    found, truth = run(spark, rows), brute(rows)
    assert {q: [i for _, i in near] for q, near in found.items() if q < 900} == {q: [i for _, i in near] for q, near in truth.items() if q < 900}


def test_few_candidates_and_odd_vectors(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(10, [1.0, 0.0]), (3, [0.0, 1.0]), (4, [2.0, 2.0]), (5, None), (6, [0.0, 0.0]), (7, [nan, 1.0]), (8, [inf, 1.0]), (None, [1.0, 1.0]), (20, [1.0, None]), (3, [0.0, 1.0]), (10, [1.0, 0.0]), (9, [1.0, 1.0, 1.0]), (11, [])]
    found, truth = run(spark, rows), brute([r for r in rows if r[0] not in (9, 11)])
    assert {q: [i for _, i in near] for q, near in found.items()} == {q: [i for _, i in near] for q, near in truth.items()} == {10: [3, 4]}


def test_empty_tables(spark):
    assert run(spark, []) == {}
    assert run(spark, [(1, [1.0, 2.0]), (2, [3.0, 4.0])]) == {}
