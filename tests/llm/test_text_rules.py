"""Quality rules and line dedup against plain Python."""

from __future__ import annotations

import hashlib
import re
import time

import duckdb
import pytest
from helpers import as_tuples, awkward, documents, nothing
from pyspark.sql import functions as F

from ovenplan.llm import line_dedup, quality_rules

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def counted(text):
    words = WORD.findall(text or "")
    windows = {}
    for i in range(len(words) - 2):
        windows.setdefault(tuple(words[i : i + 3]), []).append(i)
    covered = {p for places in windows.values() if len(places) > 1 for i in places for p in (i, i + 1, i + 2)}
    lines = [x for x in (text or "").split("\n") if WORD.search(x)]
    return (
        len(words),
        sum(map(len, words)),
        len(re.findall(r"[#*$%&|<>]", text or "")),
        len(lines) - len(set(lines)),
        len(covered),
    )


def test_signals_match_plain_counts(spark):
    texts = ["a b c a b c a", "x y x y x y", "# one\n# one\n two", "one\ntwo\none\n\n", None, "", "\x0b \x1c a b", "a a a a"]
    docs = documents(spark, [(i, t, "en", "a") for i, t in enumerate(texts)])
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
    found = {r["doc_id"]: tuple(r[n] for n in names) for r in quality_rules.count_signals(docs).collect()}
    assert found == {i: counted(t) for i, t in enumerate(texts)}


def test_judge_on_awkward_rows(spark):
    judged = quality_rules.judge(awkward(spark))
    assert judged.count() == 9
    by_id = {r["doc_id"]: r for r in judged.collect()}
    assert by_id[2]["base_failed"] and by_id[3]["base_failed"] and not by_id[2]["kept"]
    assert by_id[4]["n_words"] == counted(by_id[4]["text"])[0]
    assert set(awkward(spark).columns) <= set(judged.columns)
    assert quality_rules.judge(nothing(spark)).count() == 0


def test_fences_follow_the_group(spark):
    prose = " ".join(f"w{k}" for k in range(100))
    marked = " ".join(f"w{k}#" if k % 5 else f"w{k}" for k in range(100))
    rows = [(i, prose + f" n{i}", "en", "plain") for i in range(300)] + [(900, marked, "en", "plain")]
    rows += [(1000 + i, marked + f" n{i}", "en", "code") for i in range(300)]
    kept = {r["doc_id"]: r["kept"] for r in quality_rules.judge(documents(spark, rows)).collect()}
    assert all(kept[i] for i in range(300)) and not kept[900]
    assert all(kept[1000 + i] for i in range(300))  # what is odd in one source is usual in another


def test_a_source_of_mostly_junk_cannot_lift_its_fence(spark):
    prose = " ".join(f"w{k}" for k in range(100))
    junk = " ".join(f"w{k}#" if k % 4 else f"w{k}" for k in range(100))
    rows = [(i, prose + f" n{i}", "en", f"s{i % 4}") for i in range(2400)]
    rows += [(5000 + i, prose + f" n{i}", "en", "bad") for i in range(120)] + [(6000 + i, junk + f" n{i}", "en", "bad") for i in range(180)]
    kept = {r["doc_id"]: r["kept"] for r in quality_rules.judge(documents(spark, rows)).collect()}
    assert all(kept[i] for i in (*range(2400), *range(5000, 5120))) and not any(kept[6000 + i] for i in range(180))


def test_fences_differ_between_groups(spark):
    """Texts of one source repeat more than those of the others: its fence is higher, but at most half above its language's."""
    calm = [("en", f"s{i % 3}", "repeats", i % 40) for i in range(3000)]
    lively = [("en", "verse", "repeats", 45 + i % 60) for i in range(250)]
    wild = [("en", "chant", "repeats", 300 + i % 200) for i in range(250)]
    values = spark.createDataFrame(calm + lively + wild, "lang string, source string, signal string, value long")
    fence = {r["source"]: r["repeats_fence"] for r in quality_rules.group_fences(values).collect()}
    assert fence["s0"] == fence["s1"] and fence["s0"] < fence["verse"] < fence["chant"]
    lang = quality_rules.fences(quality_rules.sketch(values, ["lang"]), ["lang"]).first()["fence"]
    assert fence["chant"] == lang * 3 // 2


def test_sketches_merge(spark):
    values = spark.createDataFrame([(f"l{i % 3}", f"s{i % 5}", "symbols", i * i % 997) for i in range(1000)], "lang string, source string, signal string, value long")
    whole = quality_rules.sketch(values, ["lang"])
    merged = quality_rules.merge_sketches(quality_rules.sketch(values, ["lang", "source"]), ["lang"])
    assert as_tuples(whole, "lang", "bucket", "n") == as_tuples(merged, "lang", "bucket", "n")
    assert whole.agg(F.sum("n")).first()[0] == 1000


def test_rules_match_their_sql(spark):
    rows = [(i, "\n".join(f"t{i * j % 13} u{j % 7} ## v" for j in range(i % 40 + 5)), f"l{i % 2}", f"s{i % 3}") for i in range(500)]
    docs = documents(spark, [*rows, (900, None, None, "s1"), (901, "", "l1", None)])
    con = duckdb.connect()
    con.register("documents", docs.toPandas())
    columns = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"]
    theirs = con.sql(f"SELECT {', '.join(columns)} FROM ({quality_rules.ORACLE})").fetchall()
    assert as_tuples(quality_rules.judge(docs), *columns) == sorted(theirs, key=repr)


def dedup(rows, min_docs):
    key = lambda line: line.strip(" \t\n\v\f\r").translate(str.maketrans(line_dedup.UPPER, line_dedup.UPPER.lower()))
    docs = {}
    for i, text in rows:
        for line in (text or "").split("\n"):
            docs.setdefault(key(line), set()).add(i)
    gone = {k for k, ids in docs.items() if k and len(ids) >= min_docs}
    return [(i, "\n".join(x for x in (t or "").split("\n") if key(x) not in gone)) for i, t in rows]


@pytest.mark.parametrize("min_docs", [1, 2, 3, 10])
def test_line_dedup_matches_plain_python(spark, min_docs):
    docs = awkward(spark).unionByName(
        documents(spark, [(20 + i, f"Shared LINE\n\tshared line \nown {i}\n\nÄhnlich\nähnlich", "en", "a") for i in range(12)])
    )
    kept = line_dedup.drop_shared_lines(docs, min_docs)
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    assert as_tuples(kept, "doc_id", "text") == sorted(dedup(rows, min_docs), key=repr)
    for r in kept.collect():
        before = next(t or "" for i, t in rows if i == r["doc_id"])
        assert r["n_lines"] - r["n_dropped"] == (0 if r["n_lines"] == r["n_dropped"] else r["text"].count("\n") + 1)
        assert r["n_lines"] == before.count("\n") + 1


def test_line_dedup_keeps_columns_and_takes_nothing(spark):
    docs = awkward(spark)
    assert set(docs.columns) <= set(line_dedup.drop_shared_lines(docs).columns)
    assert line_dedup.drop_shared_lines(nothing(spark)).count() == 0
    empty = line_dedup.drop_shared_lines(documents(spark, [(1, "", "en", "a")]), 1).first()
    assert (empty["n_lines"], empty["n_dropped"], empty["text"]) == (1, 0, "")
    assert hashlib.sha256(b"").hexdigest()


def test_a_document_of_many_lines_takes_time_in_proportion(spark):
    n = 100_000
    shared = "\n".join(f"common {k}" if k % 2 else f"own {k} %d" for k in range(n))
    docs = documents(spark, [(i, shared.replace("%d", str(i)), "en", "a") for i in range(4)])
    began = time.monotonic()
    kept = line_dedup.drop_shared_lines(docs, 4).select("doc_id", "n_lines", "n_dropped", "text").collect()
    assert time.monotonic() - began < 60
    assert [(r["doc_id"], r["n_lines"], r["n_dropped"]) for r in sorted(kept)] == [(i, n, n // 2) for i in range(4)]
    assert all(r["text"].split("\n") == [f"own {k} {r['doc_id']}" for k in range(0, n, 2)] for r in kept)
