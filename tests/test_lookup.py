from __future__ import annotations

import random
import re

from ovenplan.operators import lookup
from ovenplan.operators.lookup import complete, find_id, lookup_id, resolve_keys
from tests.conftest import rows

NAMES = ["Cao Cao truffles", "cao loaf", "pita loaf", "50% rye", "a_b", "a\\b", "", "x", "ab", "LOAF", "loaf", "Ünder"]


def like(name, pattern):
    """LIKE by plain recursion on lowered text; backslash escapes."""
    name, pattern = name.lower(), pattern.lower()

    def match(i, j):
        if j == len(pattern):
            return i == len(name)
        c = pattern[j]
        if c == "%":
            return any(match(k, j + 1) for k in range(i, len(name) + 1))
        if i == len(name):
            return False
        if c == "\\":
            return name[i] == pattern[j + 1] and match(i + 1, j + 2)
        return (c == "_" or name[i] == c) and match(i + 1, j + 1)

    return match(0, 0)


def test_lookup_matches_brute_force(spark):
    rng = random.Random(3)
    names = NAMES + ["".join(rng.choice("abc") for _ in range(rng.randint(0, 6))) for _ in range(60)]
    patterns = [
        "cao%", "loaf", "%loaf%", "%", "_", "___", "_%_", "50\\% rye", "50\\%%", "a\\_b", "a\\\\b", "%\\_%", "nothing%", "",
        "%a", "b%", "%ü%", "__%", "%ab%c%", "c%a_b",
    ]
    patterns += ["".join(rng.choice("abc%_") for _ in range(rng.randint(1, 6))) for _ in range(60)]
    dim = spark.createDataFrame([(n, i) for i, n in enumerate(names)], "name string, id int")
    wanted = spark.createDataFrame([(p,) for p in patterns * 2] + [(None,)], "p string")
    found = {r["pattern"]: (r["id"], r["hits"]) for r in lookup_id(dim, "name", "id", wanted, "p").collect()}
    assert found.pop(None) == (None, 0)
    assert set(found) == set(patterns)
    for pattern in set(patterns):
        ids = [i for i, n in enumerate(names) if like(n, pattern)]
        assert found[pattern] == (min(ids, default=None), len(ids)), pattern


def test_lookup_within_a_kind(spark):
    dim = spark.createDataFrame([("a", "rye", 1), ("b", "rye", 2)], "kind string, name string, id int")
    wanted = spark.createDataFrame([("a", "RYE"), ("b", "r%"), ("c", "%")], "kind string, p string")
    assert rows(lookup_id(dim, "name", "id", wanted, "p", ["kind"])) == [
        ("a", "RYE", 1, 1),
        ("b", "r%", 2, 1),
        ("c", "%", None, 0),
    ]


def test_find_id(spark):
    dim = spark.createDataFrame([("cao cao truffles", 4), ("cao loaf", 2)], "name string, id int")
    assert rows(find_id(dim, "name", "id", "CAO%")) == [(2, 2)]
    assert rows(find_id(dim, "name", "id", "none%")) == [(None, 0)]


def test_resolve_keys_and_rejects(spark):
    parties = spark.createDataFrame([("Lark", "p1"), ("Bar", "p2")], "party_name string, party_id string")
    products = spark.createDataFrame([("kamut sourdough", "k")], "product_name string, product_id string")
    batch = spark.createDataFrame(
        [("lark", "kam%", 1), ("BAR", "kam%", 2), ("nobody", "kam%", 3), (None, "rye", 4)],
        "customer string, product string, amt int",
    )
    resolved = resolve_keys(
        batch,
        {
            "customer>customer_id": (parties, "party_name", "party_id"),
            "product": (products, "product_name", "product_id"),
        },
    )
    assert rows(resolved.select("customer_id", "product_id", "amt", complete(["customer_id", "product_id"]))) == [
        ("p1", "k", 1, True),
        ("p2", "k", 2, True),
        (None, "k", 3, False),
        (None, None, 4, False),
    ]


def test_matches_are_all_pairs_that_like_gives(spark):
    names = ["Alpha", "alpha", "beta%", "be_ta", "", "ab", "a", "Zürich", None]
    patterns = ["alpha", "%a%", "%", "_", "__%", "", "be\\_ta", "%\\%", "zü%", "x%", "%_", "a%a", None]
    dim = spark.createDataFrame([(n,) for n in names], "name string")
    asked = spark.createDataFrame([(p,) for p in patterns], "p string")
    found = {tuple(r) for r in lookup.matches(dim, "name", asked, "p").collect()}
    lower = dim.selectExpr("lower(name) AS name").distinct()
    pairs = asked.distinct().crossJoin(lower).filter("name LIKE lower(p)").select("p", "name")
    assert found == {tuple(r) for r in pairs.collect()}


def named_batch(spark):
    parties = spark.createDataFrame([("Lark", 1), ("Bar", 2), ("bar", 0)], "party_name string, party_id int")
    shapes = spark.createDataFrame([("shape 1", 1), ("shape 2", 2)], "shape_name string, shape_id int")
    batch = spark.createDataFrame(
        [("lark", "SHAPE%1", 1), ("BAR", "shape 2", 2), ("BAR", None, 2), ("nobody", "shape%", 3), (None, "x", 4)],
        "customer string, shape string, amt int",
    )
    return batch, {"customer>customer_id": (parties, "party_name", "party_id"), "shape": (shapes, "shape_name", "shape_id")}


def test_few_patterns_go_to_the_rows_and_many_meet_them_in_a_shuffle(spark, monkeypatch):
    """All rows were shuffled once per name column, with the texts of all columns that were not resolved yet."""
    batch, lookups = named_batch(spark)
    wanted = sorted([(1, 1, 1), (2, 0, 2), (2, 0, None), (3, None, 1), (4, None, None)], key=repr)
    for few, shuffled in ((lookup.FEW_PATTERNS, set()), (4, {"shape"}), (0, {"customer", "shape"})):
        monkeypatch.setattr(lookup, "FEW_PATTERNS", few)
        resolved = resolve_keys(batch, lookups)
        assert resolved.columns == ["amt", "customer_id", "shape_id"] and rows(resolved) == wanted
        plan = resolved._jdf.queryExecution().executedPlan().toString()
        assert set(re.findall(r"SortMergeJoin \[(\w+)#\d+, _piece#\w+\], .*LeftOuter", plan)) == shuffled


def test_customers_are_resolved_per_order_not_per_line(spark, monkeypatch, tmp_path):
    from ovenplan.plans.catalog import CATALOG
    from ovenplan.sources.binding import SOURCES

    monkeypatch.setattr(lookup, "FEW_PATTERNS", 0)
    made = {
        "customer": "SELECT 7L AS c_custkey, 'Customer 7' AS c_name",
        "supplier": "SELECT 7L AS s_suppkey, 'Supplier 7' AS s_name, 0 AS s_nationkey",
        "part": "SELECT * FROM VALUES (1L, 'rye', 'PROMO'), (2L, 'oat', 'ECONOMY') AS t(p_partkey, p_name, p_type)",
        "orders": "SELECT * FROM VALUES (10L, 7L), (11L, 8L), (10L, 7L), (12L, NULL) AS t(o_orderkey, o_custkey)",
        "lineitem": "SELECT o AS l_orderkey, p AS l_partkey, CAST(p AS INT) AS l_linenumber, 3D AS l_quantity, TIMESTAMP_NTZ'1998-01-05 00:00:00' AS l_shipdate "
        "FROM VALUES (10L, 1L), (10L, 2L), (11L, 1L), (12L, 1L), (13L, 1L), (NULL, 1L), (10L, NULL) AS t(o, p)",
    }
    for name in SOURCES:
        frame = spark.sql(made[name]) if name in made else spark.createDataFrame([], SOURCES[name])
        frame.write.parquet(f"{tmp_path}/{name}.parquet")
    found = CATALOG["snk_resolve_append"](spark, str(tmp_path))
    day = "1998-01-05"
    assert rows(found.select("delivery_date", "customer_id", "product_id", "shape_id", "amt", "outcome")) == sorted(
        [(day, 7, 1, 1, 3, "accepted"), (day, 7, None, 2, 3, "rejected")] * 2, key=repr
    )
    plan = found._jdf.queryExecution().executedPlan().toString()
    [spread] = re.findall(r"xxhash64\(([^)]*)\), CASE WHEN isnull\(customer#", plan)
    assert "o_orderkey" in spread and "delivery_date" not in spread
