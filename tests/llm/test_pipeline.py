"""The pipeline against its stages done in plain Python, and its promises on awkward rows."""

from __future__ import annotations

from collections import Counter

import corpus_pipeline
import public_tokenizers
import sentencepiece
from helpers import as_tuples, awkward, documents, nothing
from test_near_dups import brute_classes
from test_text_rules import dedup

from ovenplan.llm import mixing, quality_rules


def test_stages_one_by_one(spark):
    lines = [" ".join(f"{chr(97 + i % 26)}{(i + 1) * j % 997}" for j in range(1, 30)) for i in range(60)]
    rows = [(i, "\n".join([lines[i], "the shared footer line", lines[(i * 7 + 1) % 60]]), "en", f"s{i % 3}") for i in range(60)]
    rows += [(100, rows[3][1], "en", "s0"), (101, rows[4][1] + " more", "en", "s1"), (102, "too short", "en", "s1"), (103, "x y " * 60, "en", "s2")]
    docs = documents(spark, rows)
    stages = dict(corpus_pipeline.STAGES)

    kept = stages["quality rules"](spark, docs, "")
    assert as_tuples(kept, "doc_id") == as_tuples(quality_rules.judge(docs).filter("kept"), "doc_id")
    ids = {r["doc_id"] for r in kept.collect()}
    assert 102 not in ids and 103 not in ids and set(range(60)) <= ids

    cut = stages["line dedup"](spark, kept, "")
    assert as_tuples(cut, "doc_id", "text") == sorted(dedup([(r["doc_id"], r["text"]) for r in kept.collect()], 10), key=repr)
    assert all(r["n_chars"] == len(r["text"]) for r in cut.collect())

    single = stages["near dedup"](spark, cut, "")
    before = sorted((r["doc_id"], r["text"]) for r in cut.collect())
    labels = brute_classes([t for _, t in before])
    assert as_tuples(single, "doc_id") == sorted({(before[c][0],) for c in labels}, key=repr)

    mixed = stages["source mix"](spark, single, "")
    wanted = Counter({r["doc_id"]: r["copies"] for r in mixing.plan_mix(single).collect() if r["copies"]})
    assert Counter(r["doc_id"] for r in mixed.collect()) == wanted

    library = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    text = {r["doc_id"]: r["text"] for r in mixed.collect()}
    encoded = stages["encoding"](spark, mixed, "").collect()
    assert len(encoded) == sum(wanted.values())
    assert all(r["ids"] == library.encode(text[r["doc_id"]]) and r["round_trip"] and r["n_tokens"] == len(r["ids"]) for r in encoded)
    for stage in (kept, cut, single, mixed):
        assert stage.columns == docs.columns


def test_awkward_and_empty_tables(spark):
    for docs in (awkward(spark), nothing(spark)):
        for name, stage in corpus_pipeline.STAGES:
            found = stage(spark, docs, "")
            found.count()
            assert name == "encoding" or found.columns == docs.columns


def test_run_reads_and_writes(spark, tmp_path):
    rows = [(i, " ".join(f"w{(i + 1) * j % 991}" for j in range(1, 80)), "en", "s") for i in range(20)]
    documents(spark, rows).write.parquet(str(tmp_path / "documents.parquet"))
    found = corpus_pipeline.run(spark, str(tmp_path))
    assert found.count() == 20 and found.filter("round_trip and agrees").count() == 20
