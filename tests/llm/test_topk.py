"""Top-k search against all products."""

from __future__ import annotations

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from ovenplan.llm import topk

SCHEMA = "vec_id long, embedding array<float>, score int, rank int, block string"


def table(spark, rows):
    return spark.createDataFrame([(i, v, 1, 2, "x") for i, v in rows], SCHEMA)


def brute(rows, every, k, scale=1024):
    usable = [(i, [math.floor(scale * float(np.float32(x))) for x in v]) for i, v in rows if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for q, a in {(i, tuple(v)) for i, v in usable if i % every == 0}:
        found = sorted((-sum(x * y for x, y in zip(a, b, strict=True)), i) for i, b in usable if i != q and len(b) == len(a))
        out += [(q, r + 1, i, -s) for r, (s, i) in enumerate(found[:k])]
    return sorted(out)


def search(spark, rows, every=5, k=4):
    found = topk.top_k(table(spark, rows), F.col("vec_id") % every == 0, k=k)
    return sorted(tuple(r) for r in found.select("query_id", "rank", "vec_id", "score").collect())


@pytest.mark.parametrize("dims", [1, 3, 17, 64])
def test_equals_brute_force(spark, dims):
    rng = np.random.default_rng(dims)
    rows = [(i, rng.normal(size=dims).astype(np.float32).tolist()) for i in range(150)]
    assert search(spark, rows) == brute(rows, 5, 4)


def test_ties_nulls_lengths_and_repeats(spark):
    same = [0.5, -0.25]
    rows = [(i, same) for i in range(12)] + [(3, same), (20, None), (25, [1.0, None]), (30, [float("nan"), 0.0]), (35, [float("inf"), 1.0])]
    rows += [(None, same), (40, [1.0, 2.0, 3.0]), (41, [3.0, 2.0, 1.0]), (45, []), (46, []), (0, same)]
    assert search(spark, rows) == brute(rows, 5, 4)
    assert search(spark, []) == []


def test_small_blocks_and_seeds_change_nothing(spark, monkeypatch):
    rng = np.random.default_rng(3)
    rows = [(i, (rng.normal(size=8) + (i % 4)).astype(np.float32).tolist()) for i in range(200)]
    for name, value in (("BLOCK", 7), ("QUERY_BLOCK", 3), ("SEEDS", 11)):
        monkeypatch.setattr(topk, name, value)
    assert search(spark, rows) == brute(rows, 5, 4)


def test_copied_queries_are_not_broadcast(spark):
    """The size that Spark guesses for the queries copied to every group lacks the copies, so they were sent whole to the driver."""
    found = topk.top_k(table(spark, [(i, [float(i), 1.0]) for i in range(20)]), F.col("vec_id") % 5 == 0, k=4)
    plan = found._jdf.queryExecution().sparkPlan().toString()
    assert "Generate explode" in plan and "SortMergeJoin" in plan and "Broadcast" not in plan


def test_bounds_hold():
    rng = np.random.default_rng(1)
    rows, query = rng.normal(size=(500, 37)) * 100, rng.normal(size=37) * 100
    exact = rows @ query
    for segments in (1, 4, 16, 64):
        bound = topk.segment_features(rows, segments) @ topk.segment_features(query[None, :], segments)[0]
        assert (bound >= exact - 1e-6 * abs(exact)).all()


def test_large_components_are_exact():
    rows = np.array([[2.0**40, 1.0], [2.0**40, 2.0]])
    assert topk.products(rows, np.array([2.0**20, 1.0])).tolist() == [2**60 + 1, 2**60 + 2]
    assert topk.products(rows, np.array([2.0**40, 1.0])).tolist() == [2**63 - 1] * 2
