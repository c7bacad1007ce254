"""The mix and the shards: laws that must hold, SQL and plain Python."""

from __future__ import annotations

import zlib
from collections import Counter

import duckdb
import pytest
from helpers import as_tuples, awkward, documents, nothing
from pyspark.sql import functions as F

from ovenplan.llm import mixing, sharding
from ovenplan.llm.common import running_total


def corpus(spark):
    return documents(
        spark, [(i, " ".join(["w"] * (i * 37 % 50 + 1)) + f" {i}", "en", f"s{min(i % 11, 6)}" if i % 13 else None) for i in range(900)]
    )


def test_running_total(spark):
    rows = spark.createDataFrame([(i % 3, i, i % 7) for i in range(500)], "g int, i int, v long")
    got = {r["i"]: r["t"] for r in running_total(rows, ["g", "i"], "v", "t").collect()}
    total = 0
    for _, i, v in sorted((i % 3, i, i % 7) for i in range(500)):
        assert got[i] == total
        total += v


def test_mix_matches_its_sql(spark):
    docs = corpus(spark)
    con = duckdb.connect()
    con.register("documents", docs.toPandas())
    plan = mixing.plan_mix(docs).withColumn("first_ppm", F.floor(F.get("positions", F.lit(0)) * 1_000_000))
    columns = ["doc_id", "size", "source_size", "target", "taken", "first_ppm"]
    assert as_tuples(plan, *columns) == sorted(con.sql(f"SELECT {', '.join(columns)} FROM ({mixing.ORACLE})").fetchall(), key=repr)


def test_mix_laws(spark):
    rows = mixing.plan_mix(corpus(spark)).collect()
    total = sum(r["size"] for r in rows)
    targets = {r["source"]: (r["target"], r["source_size"]) for r in rows}
    assert abs(sum(t for t, _ in targets.values()) - total) < 1e-6 * total
    for source, (target, size) in targets.items():
        taken = sum(r["taken"] for r in rows if r["source"] == source)
        assert target <= 3 * size + 1e-9 and abs(taken - target) <= 51
    assert all(r["taken"] <= 3 * r["size"] and len(r["positions"]) == r["copies"] for r in rows)
    names = sorted(s for s in targets if s) + [None]
    level = [targets[s][0] / (5, 2, 1)[k % 3] for k, s in enumerate(names) if targets[s][0] < 3 * targets[s][1] - 1e-9]
    assert max(level) - min(level) < 1e-6  # sources that are not full share one level
    again = mixing.plan_mix(corpus(spark).repartition(7)).collect()
    assert sorted(map(repr, rows)) == sorted(map(repr, again))


def test_schedules_shape_the_order(spark):
    plan = mixing.plan_mix(corpus(spark))
    ordered = mixing.training_order(plan).collect()
    places = [r["position"] for r in ordered]
    assert places == sorted(places) and 0 <= places[0] and places[-1] <= 1
    early = {s: sum(r["size"] for r in ordered if r["source"] == s and r["position"] < 0.5) / sum(r["size"] for r in ordered if r["source"] == s) for s in ("s0", "s1", "s2")}
    assert abs(early["s0"] - 0.625) < 0.08 and abs(early["s1"] - 0.5) < 0.08 and abs(early["s2"] - 0.375) < 0.08


def test_mixed_rows_repeat_as_planned(spark):
    docs = corpus(spark).unionByName(awkward(spark))
    mixed = Counter((r["doc_id"], r["source"]) for r in mixing.mixed_documents(docs).collect())
    planned = Counter()
    for r in mixing.plan_mix(docs).collect():
        planned[(r["doc_id"], r["source"])] += r["copies"]
    assert mixed == +planned
    assert mixing.mixed_documents(docs).columns == docs.columns
    assert mixing.plan_mix(nothing(spark)).count() == mixing.mixed_documents(nothing(spark)).count() == 0


def test_mix_on_awkward_rows(spark):
    rows = mixing.plan_mix(awkward(spark)).collect()
    assert len(rows) == 9 and all(r["size"] == 0 for r in rows if r["doc_id"] in (2, 3))


@pytest.mark.parametrize("hot", [0, 300])
def test_shard_laws(spark, hot):
    texts = [f"text {i % 450} " + "x" * (i * 7 % 300) if i % 3 else f"copy {i % 40}" * 10 for i in range(900)]
    texts += ["the hot text " * 12] * hot + [None, "", "", "é" * 400]
    docs = documents(spark, [(i, t, "en", "a") for i, t in enumerate(texts)])
    rows = sharding.assign_shards(docs, shards=10).collect()
    assert sorted(r["doc_id"] for r in rows) == list(range(len(texts)))
    load = Counter()
    for r in rows:
        text = (texts[r["doc_id"]] or "").encode()
        assert (r["size"], r["text_crc32"]) == (len(text) + 16, zlib.crc32(text))
        load[r["shard"]] += r["size"]
    mean = sum(load.values()) / 10
    assert len(load) == 10 and max(load.values()) < 1.05 * mean + 850 and min(load.values()) > 0.95 * mean - 850
    for shard in range(10):
        assert sorted(r["slot"] for r in rows if r["shard"] == shard) == list(range(sum(r["shard"] == shard for r in rows)))
    where = {}
    for r in rows:
        where.setdefault(texts[r["doc_id"]] or "", set()).add(r["shard"])
    repeated = [where[t] for t, n in Counter(t or "" for t in texts).items() if n > 1 and not (t or "").startswith("the hot")]
    assert sum(len(s) > 1 for s in repeated) <= 0.1 * len(repeated)
    again = sharding.assign_shards(docs.repartition(5), shards=10).collect()
    assert {(r["doc_id"], r["shard"]) for r in rows} == {(r["doc_id"], r["shard"]) for r in again}


def test_shards_of_awkward_rows(spark):
    rows = sharding.assign_shards(awkward(spark), shards=40).collect()
    assert len(rows) == 9 and all(0 <= r["shard"] < 40 for r in rows)
    assert sharding.assign_shards(nothing(spark), shards=40).count() == 0


@pytest.mark.parametrize("part", [0.15, 0.5, 0.9])
def test_groups_that_fit_a_shard_stay_whole(spark, part):
    share, size = 6000, 84 + 16
    groups = 6
    n = int(part * share / size)
    texts = [f"group {g} ".ljust(84, "x") for g in range(groups) for _ in range(n)]
    texts += [f"single {i} ".ljust(84, "y") for i in range(10 * share // size - len(texts))]
    rows = sharding.assign_shards(documents(spark, [(i, t, "en", "a") for i, t in enumerate(texts)]), shards=10).collect()
    where = [{r["shard"] for r in rows if r["doc_id"] // n == g} for g in range(groups)]
    assert [len(s) for s in where] == [1] * groups
    load = Counter(r["shard"] for r in rows)
    assert max(load.values()) <= 1.05 * share / size and min(load.values()) >= 0.95 * share / size


def test_quotas_over_ranges_admit_the_same_blocks(spark, monkeypatch):
    """Twenty groups of a tenth of a shard and many pairs: with quotas by running total every document goes where the windows put it."""
    filler = " ".join(f"w{k}" for k in range(30))
    texts = [f"group {k % 20} {filler}" for k in range(400)] + [f"pair {k % 100} {k % 7}" for k in range(200)] + [f"alone {k} {filler}" for k in range(600)]
    docs = documents(spark, [(i, t, "en", "a") for i, t in enumerate(texts)])
    narrow = as_tuples(sharding.assign_shards(docs, shards=10), "doc_id", "shard", "slot")
    monkeypatch.setattr(sharding, "BLOCKS_PER_QUOTA", 1)
    assert as_tuples(sharding.assign_shards(docs, shards=10), "doc_id", "shard", "slot") == narrow
    where = [{shard for i, shard, _ in narrow if i < 400 and i % 20 == g} for g in range(20)]
    assert sum(map(len, where)) <= 22
