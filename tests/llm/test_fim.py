"""Fill-in-middle against regular expressions and slices, and the rank index against the offsets it was fitted to."""

from __future__ import annotations

import hashlib
import re

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from ovenplan.llm import fim
from tests.llm.helpers import awkward, documents, nothing

UNIT = re.compile(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+")
TEXT = st.text(alphabet="ab<P>SM \n\t é😀", max_size=80)


def brute(doc_id, text, seed=42, rate=50, first=80):
    text = text or ""
    units = UNIT.findall(text)
    digest = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(digest[8 * k : 8 * k + 8], 16) for k in range(4)]
    low, high = sorted(x % (len(units) + 1) for x in h[:2])
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h[2] % 100 >= rate:
        return doc_id, len(units), "plain", None, None, text
    a, b, c = "".join(units[:low]), "".join(units[low:high]), "".join(units[high:])
    if h[3] % 100 < first:
        return doc_id, len(units), "spm", len(a), len(b), f"<S>{c}<P>{a}<M>{b}"
    return doc_id, len(units), "psm", len(a), len(b), f"<P>{a}<S>{c}<M>{b}"


def made(docs, **options):
    found = fim.fill_in_middle(docs, **options).withColumn("back", fim.restored(F.col("output"), F.col("form")))
    return sorted((tuple(r) for r in found.select("doc_id", "n", "form", "prefix_chars", "middle_chars", "output", "back").collect()), key=repr)


def test_equals_slices(spark):
    rng = np.random.default_rng(5)
    pieces = ["word", " ", "\n\n", "\t", "é", "😀", "<", "P>", "<S>", " ", "."]
    rows = [(k, "".join(rng.choice(pieces, rng.integers(0, 60))), "en", "a") for k in range(400)]
    for options in ({}, {"seed": 3, "rate": 100, "suffix_first": 50}):
        wanted = [brute(i, t, options.get("seed", 42), options.get("rate", 50), options.get("suffix_first", 80)) for i, t, _, _ in rows]
        assert made(documents(spark, rows), **options) == sorted(((*w, t) for w, (_, t, _, _) in zip(wanted, rows, strict=True)), key=repr)


def test_awkward_rows(spark):
    rows = [(r.doc_id, r.text) for r in awkward(spark).collect()]
    wanted = sorted(((*brute(i, t, rate=100), t or "") for i, t in rows), key=repr)
    assert made(awkward(spark), rate=100) == wanted
    assert made(nothing(spark)) == []


def test_stored_index_gives_every_offset(spark):
    text = "ab " * 3000 + "x" * 9000 + " y" * 3000
    [row] = fim.fill_in_middle(documents(spark, [(1, text, "en", "a")])).collect()
    index = fim.RankIndex(*(np.array([s[k] for s in row.segments]) for k in range(3)), np.frombuffer(row.residuals, np.int8))
    assert index.offset(np.arange(row.n + 1)).tolist() == fim.boundaries(text).tolist()
    assert 1 < len(row.segments) < 6


@settings(max_examples=150, deadline=None)
@given(TEXT)
def test_boundaries(text):
    assert fim.boundaries(text).tolist() == [0, *np.cumsum([len(u) for u in UNIT.findall(text)]).tolist()]


@settings(max_examples=150, deadline=None)
@given(st.lists(st.integers(1, 400), max_size=3000), st.integers(1, 127))
def test_index_is_exact_and_bounded(lengths, error):
    offsets = np.concatenate([[0], np.cumsum(lengths)]).astype(np.int64)
    index = fim.fit(offsets, error)
    assert index.offset(np.arange(len(offsets))).tolist() == offsets.tolist()
    assert np.abs(index.residuals.astype(int)).max() <= error


@settings(max_examples=200, deadline=None)
@given(TEXT, st.integers(0, 1000))
def test_each_form_is_undone(text, doc_id):
    form, output, _, _ = fim.cut(text, doc_id, 1, 100, 50)
    parts = re.split("<[PSM]>", output)
    assert {"plain": lambda: output, "psm": lambda: parts[1] + parts[3] + parts[2], "spm": lambda: parts[2] + parts[3] + parts[1]}[form]() == text
