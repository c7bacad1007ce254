"""Multi-probe hashing against all distances: recall, exact scores, and the cases in which everything must be found."""

from __future__ import annotations

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from ovenplan.llm import neighbours

SCHEMA = "vec_id long, embedding array<float>, score int, rank int, block string"


def table(spark, rows):
    return spark.createDataFrame([(i, v, 1, 2, "x") for i, v in rows], SCHEMA)


def usable(rows):
    fine = [(i, [float(np.float32(x)) for x in v]) for i, v in rows if i is not None and v and all(x is not None and math.isfinite(x) for x in v)]
    return [(i, v) for i, v in fine if any(v)]


def brute(rows, every, k):
    out = []
    for q, a in {(i, tuple(v)) for i, v in usable(rows) if i % every == 0}:
        found = sorted((math.dist(a, b), i) for i, b in usable(rows) if i != q and len(b) == len(a))
        out += [(q, r + 1, i, s) for r, (s, i) in enumerate(found[:k])]
    return sorted(out)


def search(spark, rows, every=5, k=4):
    found = neighbours.nearest(table(spark, rows), F.col("vec_id") % every == 0, k=k)
    return sorted(tuple(r) for r in found.select("query_id", "rank", "vec_id", "score").collect())


def assert_same(found, wanted):
    assert [r[:3] for r in found] == [r[:3] for r in wanted]
    assert [r[3] for r in found] == pytest.approx([r[3] for r in wanted], rel=1e-12, abs=1e-300)


def recall(found, wanted):
    near = {(q, v) for q, _, v, _ in wanted}
    return len(near & {(q, v) for q, _, v, _ in found}) / len(near)


@pytest.mark.parametrize("clusters", [1, 40])
def test_recall_and_scores(spark, clusters):
    rng = np.random.default_rng(clusters)
    centres = rng.normal(size=(clusters, 32)) * (3 if clusters > 1 else 0)
    rows = [(i, (centres[i % clusters] + rng.normal(size=32)).tolist()) for i in range(3000)]
    found, wanted = search(spark, rows, 30, 10), brute(rows, 30, 10)
    assert len(found) == len(wanted) and recall(found, wanted) >= 0.9
    vectors = dict(usable(rows))
    for q, _, v, score in found:
        assert score == pytest.approx(math.dist(vectors[q], vectors[v]), rel=1e-12)


def test_sample_of_a_fraction(spark, monkeypatch):
    for name, value in (("SAMPLE", 300), ("BLOCK", 64), ("QUERY_BLOCK", 7), ("MOST_GROUPS", 2)):
        monkeypatch.setattr(neighbours, name, value)
    rng = np.random.default_rng(9)
    rows = [(i, rng.normal(size=16).tolist()) for i in range(1500)]
    assert recall(search(spark, rows, 25, 10), brute(rows, 25, 10)) >= 0.9


def test_clusters_visit_a_small_part():
    rng = np.random.default_rng(2)
    rows = (rng.normal(size=(100, 1, 32)) * 4 + rng.normal(size=(100, 60, 32)) * 0.3).reshape(-1, 32)
    ids = np.arange(len(rows))
    hashing = neighbours.fitted(ids[::3], rows[::3], 10)
    tables = neighbours.Tables(ids, rows, hashing)
    visits = [hashing.visits(rows[:200], t) for t in range(neighbours.TABLES)]
    seen = [tables.candidates([v[i] for v in visits]) for i in range(200)]
    true = [np.argsort(((rows - rows[i]) ** 2).sum(axis=1), kind="stable")[1:11] for i in range(200)]
    assert np.mean([np.isin(t, s).mean() for t, s in zip(true, seen, strict=True)]) >= 0.9
    assert np.mean([len(s) for s in seen]) < 0.1 * len(rows)


def test_sets_come_in_order_and_cross_one_wall_of_a_function():
    sets = neighbours.step_sets(4, 10_000)
    assert len(sets) == 3**4 and not sets[0].any()
    assert not (sets & sets[:, ::-1] if sets.dtype == bool else sets * sets[:, ::-1]).any()
    assert len(np.unique(sets, axis=0)) == len(sets)


def test_ties_nulls_lengths_and_repeats(spark):
    same = [0.5, -0.25]
    rows = [(i, same) for i in range(12)] + [(3, same), (20, None), (25, [1.0, None]), (30, [float("nan"), 0.0]), (35, [float("inf"), 1.0])]
    rows += [(None, same), (40, [1.0, 2.0, 3.0]), (41, [3.0, 2.0, 1.0]), (45, []), (46, []), (50, [0.0, 0.0]), (0, same), (55, [9.0]), (60, [1e6, 1e6])]
    assert_same(search(spark, rows), brute(rows, 5, 4))
    assert search(spark, []) == []
    assert search(spark, [(0, [1.0])]) == []


def test_few_in_the_buckets_means_a_full_search(spark):
    rng = np.random.default_rng(4)
    rows = [(i, (rng.normal(size=8) * 0.01).tolist()) for i in range(1, 120)] + [(0, [50.0] * 8), (200, [-80.0] * 8)]
    assert_same([r for r in search(spark, rows, 100, 10) if r[0] != 100], [r for r in brute(rows, 100, 10) if r[0] != 100])
