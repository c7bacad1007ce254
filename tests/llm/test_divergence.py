"""Divergence audit against plain dictionaries, and the shared trees against flat arrays."""

from __future__ import annotations

import re
from collections import Counter, defaultdict

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from ovenplan.llm import divergence
from tests.llm.helpers import awkward, documents, nothing

TERM = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute(rows, min_docs, top):
    docs = [((lang or ""), (source or ""), TERM.findall((text or "").translate(LOWER))) for _, text, lang, source in rows]
    found, out = defaultdict(Counter), []
    for lang, _, words in docs:
        found[lang].update(set(words))
    kept = {lang: sorted(t for t, n in c.items() if n >= min_docs) for lang, c in found.items()}
    counts = {(lang, source): Counter() for lang, source, _ in docs}
    for lang, source, words in docs:
        counts[lang, source].update(w for w in words if w in set(kept[lang]))
    shares = {}
    for lang in {lang for lang, _ in counts}:
        whole = sum((c for (x, _), c in counts.items() if x == lang), Counter())
        for name, c in [*((k, c) for k, c in counts.items() if k[0] == lang), ((lang, None), whole)]:
            total = sum(c.values())
            shares[name] = {t: 1 + 10**9 * (c[t] + 5) // (total + 5 * len(kept[lang])) for t in kept[lang]}
    for lang, source in counts:
        p, q = shares[lang, source], shares[lang, None]
        pairs = [(-sum(abs(p[t] - shares[lang, o][t]) for t in p), o) for x, o in counts if x == lang and o != source]
        terms = [(q[t] - p[t], t) for t in p if counts[lang, source][t] and p[t] > q[t]]
        for part, items in (("pair", sorted(pairs)), ("term", sorted(terms)[:top])):
            out += [(lang, source, part, item, -value, k + 1) for k, (value, item) in enumerate(items)]
    return sorted(out)


def audited(spark, rows, min_docs=2, top=3, **options):
    found = divergence.audit(documents(spark, rows), min_docs=min_docs, top_terms=top, **options)
    return sorted(tuple(r) for r in found.select("lang", "source", "part", "item", "value", "rank").collect())


def corpus(seed, n=120, sources=5):
    rng = np.random.default_rng(seed)
    words = ["Über", "the", "THE", "x1y", "naïve", "été", *(f"w{chr(97 + k)}{chr(97 + k % 7)}" for k in range(26))]
    rows = []
    for k in range(n):
        text = " ".join(rng.choice(words, rng.integers(0, 30)))
        rows.append((k, text, ["en", "fr", None][k % 3], [f"s{rng.integers(0, sources)}", None][int(rng.integers(0, 9) == 0)]))
    return rows


def test_equals_plain_counting(spark):
    rows = corpus(1)
    assert audited(spark, rows) == brute(rows, 2, 3)


def test_many_stretches_and_blocks(spark, monkeypatch):
    rows = corpus(2, 150, 7)
    monkeypatch.setattr(divergence, "HELD", 20)
    assert audited(spark, rows, chunk=4, block=2) == brute(rows, 2, 3)


def test_awkward_rows(spark):
    rows = [(r.doc_id, r.text, r.lang, r.source) for r in awkward(spark).collect()]
    found = divergence.audit(awkward(spark), min_docs=2, top_terms=50)
    assert sorted(tuple(r) for r in found.select("lang", "source", "part", "item", "value", "rank").collect()) == brute(rows, 2, 50)
    # No term is in ten documents: all distances are 0 and ties go by name.
    assert audited(spark, rows, min_docs=10) == brute(rows, 10, 3)
    assert audited(spark, [(1, "a", "en", "x")], min_docs=1) == []
    assert divergence.audit(nothing(spark)).collect() == []


@settings(max_examples=40, deadline=None)
@given(st.integers(0, 6), st.integers(1, 9), st.integers(0, 10**6))
def test_walks_price_as_flat_arrays(depth, groups, seed):
    rng = np.random.default_rng(seed)
    leaves = rng.integers(0, 3, (groups, 1 << depth)) * rng.integers(0, 2, (groups, 1)) * 10 ** rng.integers(0, 12)
    real = leaves.shape[1] - int(rng.integers(0, leaves.shape[1]))
    leaves[:, real:] = -1
    totals = np.where(leaves > 0, leaves, 0).sum(axis=1)
    a, b = np.triu_indices(groups, 1)
    p = [[1 + 10**9 * (int(c) + 5) // (int(t) + 5 * real) for c in row[:real]] for row, t in zip(leaves, totals, strict=True)]
    wanted = [sum(abs(x - y) for x, y in zip(p[i], p[j], strict=True)) for i, j in zip(a, b, strict=True)]
    assert divergence.distances(leaves, totals, real, a, b).tolist() == wanted


def test_terms_of_a_long_text_in_stretches(monkeypatch):
    text = "aB c1é-Dd " * 50 + "x" * 90
    whole = TERM.findall(text.translate(LOWER))
    monkeypatch.setattr(divergence, "STRETCH", 7)
    monkeypatch.setattr(divergence, "FRONT", 8)
    assert [t.decode() for some in divergence.terms(text.encode()) for t in some] == whole


def test_equal_subtrees_are_one_node():
    leaves = np.zeros((50, 1024), np.int64)
    leaves[7, 3] = 1
    forest = divergence.Forest(leaves)
    assert max(len(left) for left, _ in forest.levels) == 2
    walk, x, y, times = forest.walk(np.array([0, 0]), np.array([1, 7]))
    assert times.tolist() == [1024, 1023, 1] and walk.tolist() == [0, 1, 1]
