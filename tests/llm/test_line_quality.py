"""The field against enumeration of all labellings, and on texts with known labels."""

from __future__ import annotations

import itertools
import random

import numpy as np
import pytest
from helpers import awkward, documents, nothing

from ovenplan.llm import line_quality as lq


def random_field(rng):
    size = 3 * lq.SHAPES + 2
    return lq.Field(np.zeros(lq.SHAPES), np.ones(lq.SHAPES), rng.normal(size=size) * 0.3, 0.1, rng.normal(size=(2, 2)))


@pytest.mark.parametrize("lines", [1, 2, 5])
def test_marginals_equal_enumeration(lines):
    rng = np.random.default_rng(lines)
    field, shapes = random_field(rng), rng.normal(size=(lines, lq.SHAPES))
    unary, total, good = field.line_scores(shapes), 0.0, np.zeros(lines)
    pairs = np.zeros((2, 2))
    for labels in itertools.product((0, 1), repeat=lines):
        score = sum(unary[t] for t in range(lines) if labels[t]) + sum(field.pairs[a, b] for a, b in itertools.pairwise(labels))
        weight = np.exp(score)
        total += weight
        good += weight * np.array(labels)
        for a, b in itertools.pairwise(labels):
            pairs[a, b] += weight
    assert np.allclose(field.marginals(shapes), good / total)
    marginal, joint = lq._expectations(unary[None, :], field.pairs, np.array([lines]))
    assert np.allclose(marginal[0], good / total) and np.allclose(joint[0], pairs / total)


def texts(seed, count):
    rng = random.Random(seed)
    out = []
    for i in range(count):
        lines = [" ".join(f"{rng.choice('abcde')}{rng.randrange(500)}x" for _ in range(rng.randrange(8, 20))) + "." for _ in range(rng.randrange(1, 6))]
        good = i % 2
        if not good:
            lines = [lines[0]] + [" ".join(w.upper() + rng.choice(["!!", "###"]) for w in line.split()) for line in lines]
        out.append((i, "\n".join(lines), good))
    return out


def test_held_out_accuracy(spark):
    taught, held = texts(1, 300), texts(2, 200)
    labels = spark.createDataFrame([(i, y, 0) for i, _, y in taught], "doc_id long, quality int, toxic int")
    field = lq.train(documents(spark, [(i, t, "en", "a") for i, t, _ in taught]), labels)
    scored = lq.score(documents(spark, [(i, t, "en", "a") for i, t, _ in held]), field).collect()
    truth = {i: y for i, _, y in held}
    assert np.mean([r["predicted"] == truth[r["doc_id"]] for r in scored]) > 0.97
    assert all(0 <= r["score"] <= 1 for r in scored)


def test_no_labels_and_awkward_rows(spark):
    empty = spark.createDataFrame([], "doc_id long, quality int")
    field = lq.train(awkward(spark), empty)
    scored = lq.score(awkward(spark), field)
    assert scored.count() == 9 and {r["score"] for r in scored.collect()} == {0.5}
    assert set(awkward(spark).columns) <= set(scored.columns)
    assert lq.score(nothing(spark), field).count() == 0


def test_unclear_labels_teach_nothing(spark):
    rows = [(1, 0), (1, 1), (2, None), (None, 1), (4, 1)]
    field = lq.train(awkward(spark), spark.createDataFrame(rows, "doc_id long, quality int"))
    assert lq.score(awkward(spark), field).first()["score"] > 0.5


def test_the_sample_is_bounded_and_repeats(spark):
    taught = texts(1, 80)
    docs = documents(spark, [(i, t, "en", "a") for i, t, _ in taught])
    labels = spark.createDataFrame([(i, y) for i, _, y in taught], "doc_id long, quality int")
    one, two = (lq.train(docs.repartition(n), labels, sample=30) for n in (1, 3))
    assert np.array_equal(one.weights, two.weights)
