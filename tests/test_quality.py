from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from ovenplan.operators import quality
from ovenplan.plans import catalog
from ovenplan.schemas import TABLES, Reference, Table
from ovenplan.sources import binding
from tests.conftest import MONDAY, make, recipe_row, rows


def test_rules_and_null_passes(spark):
    products = make(
        spark,
        "products",
        [dict(product_id=str(n), product_name="x", lead_time_days=n) for n in (-1, 0, 7, 8)]
        + [dict(product_id="unknown", product_name="x")],
    )
    assert rows(quality.check_rules(products, TABLES["products"].rules, ["product_id"], MONDAY)) == [
        ("lead_time_less_than_8", "8", "8"),
        ("lead_time_not_negative", "-1", "-1"),
    ]


def test_date_windows(spark):
    def order(day):
        return dict(delivery_date=day, customer_id="c", io="i", product_id="p", shape_id="s", amt=1)

    day = dt.date(2019, 12, 31)
    orders = make(
        spark,
        "special_orders",
        [order(d) for d in (day, day - dt.timedelta(days=1), dt.date(2020, 6, 29), dt.date(2020, 6, 30))],
    )
    assert rows(quality.check_rules(orders, TABLES["special_orders"].rules, ["delivery_date"], day)) == [
        ("delivery_date_in_next_6_mons", "2020-06-30", "2020-06-30"),
        ("delivery_date_present_or_future", "2019-12-30", "2019-12-30"),
    ]


def test_several_rules_of_one_row(spark):
    recipe = make(spark, "product_ingredients", [recipe_row("k", "rye", 0, 101, -1, 0), recipe_row("k", "oil", 1)])
    found = quality.check_rules(recipe, TABLES["product_ingredients"].rules, ["product_id", "ingredient_id"], MONDAY)
    assert sorted(r["rule"] for r in found.collect()) == [
        "bp_positive",
        "percent_in_poolish_positive",
        "percent_in_sour_max_100",
    ]


def test_not_null_and_unique(spark):
    df = spark.createDataFrame([("a", 1), ("a", 1), ("b", None), ("b", None)], "k string, n int")
    assert rows(quality.check_not_null(df, ["k", "n"], ["k"])) == [("n_not_null", "b", None)] * 2
    assert rows(quality.check_unique(df, ["k", "n"], "u")) == [("u", "a|1", 2)]
    assert rows(quality.check_unique(df, ["k"], "u")) == [("u", "a", 2), ("u", "b", 2)]


def test_foreign_key_passes_on_null(spark):
    child = spark.createDataFrame([("a", "i"), ("a", "o"), ("a", "o"), (None, "o"), ("z", None)], "c string, io string")
    parent = spark.createDataFrame([("a", "i")], "party_id string, party_type string")
    reference = Reference(("c", "io"), "parties", ("party_id", "party_type"))
    assert rows(quality.check_fk(child, parent, reference, "fk")) == [("fk", "a|o", 2)]


def test_sample_tables_are_clean(spark, bakery):
    days = make(spark, "days_of_week", [dict(dow_id=n, dow_names=d) for n, d in enumerate(("Sun", "Mon", "Tue", "Wed", "Thu", "Fri", "Sat"))])
    tables = {**bakery, "days_of_week": days}
    stamps = ("created", "modified")
    for name in tables:
        report = quality.check_table(name, TABLES[name], tables, MONDAY, ignore=stamps)
        assert rows(report) == [], name


def test_table_report_finds_each_kind(spark, bakery):
    shapes = make(
        spark,
        "product_shapes",
        [
            dict(product_id="kamut", shape_id="boule", grams=3000),
            dict(product_id="kamut", shape_id="boule", grams=None),
            dict(product_id="none", shape_id="boule", grams=5),
        ],
    )
    report = quality.check_table("product_shapes", TABLES["product_shapes"], {**bakery, "product_shapes": shapes}, MONDAY)
    assert rows(report.select("rule", "key", "n_rows")) == [
        ("grams_less_than_3000", "kamut|boule", 1),
        ("grams_not_null", "kamut|boule", 1),
        ("product_id_in_products", "none", 1),
        ("product_id_shape_id_unique", "kamut|boule", 2),
    ]


def flaws(spark, bakery):
    return {
        **bakery,
        "days_of_week": make(spark, "days_of_week", [dict(dow_id=1, dow_names="Mon"), dict(dow_id=2, dow_names="Mon")]),
        "product_shapes": make(
            spark,
            "product_shapes",
            [dict(product_id="kamut", shape_id="boule", grams=n) for n in (5, None)] + [dict(product_id="none", shape_id=s, grams=5) for s in ("boule", None, "x|y")],
        ),
    }


def test_all_keys_in_one_shuffle_equal_the_checks_of_each_table(spark, bakery):
    tables = flaws(spark, bakery)
    declared = {name: TABLES[name] for name in tables}
    found = quality.check_keys(tables, declared)
    reports = [quality.check_table(name, table, tables, MONDAY, ignore=("created", "modified")) for name, table in declared.items()]
    wanted = {tuple(r[c] for c in ("table_name", "rule", "key", "n_rows")) for report in reports for r in report.collect() if r["rule"].endswith("_unique") or "_in_" in r["rule"]}
    assert {tuple(r[c] for c in ("table_name", "rule", "key", "n_rows")) for r in found.collect()} == wanted
    assert ("product_shapes", "product_id_in_products", "none", 3) in wanted and ("days_of_week", "dow_names_unique", "Mon", 2) in wanted


def test_missing_values_of_all_tables(spark, bakery):
    tables = flaws(spark, bakery)
    found = quality.check_missing({"product_shapes": tables["product_shapes"]}, {"product_shapes": TABLES["product_shapes"]})
    assert {(r["rule"], r["key"]) for r in found.collect()} == {("grams_not_null", "kamut|boule"), ("shape_id_not_null", "none")}


def test_the_keys_of_all_tables_share_one_exchange(spark, bakery):
    tables = flaws(spark, bakery)
    plan = quality.check_keys(tables, {name: TABLES[name] for name in tables})._jdf.queryExecution().executedPlan().toString()
    # One for the counts, one for the keys that look wrong, one to count those exactly: none per constraint or table.
    assert 2 <= plan.count("Exchange hashpartitioning(number") <= 3


def test_tables_are_worked_out_once_for_all_their_keys(spark, bakery):
    """The keys that look wrong were looked up again: a join that a key of very many rows brought to one task."""
    tables = flaws(spark, bakery)
    plan = quality.check_keys(tables, {name: TABLES[name] for name in tables})._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and plan.count("Exchange hashpartitioning(number") == 2


def test_wide_keys_are_not_combined_before_the_shuffle(spark):
    """Keys that hardly repeat filled the memory of the tasks that combined them, and the counts of all keys went to disk."""
    declared = {
        "parent": Table("a int, b int, c int", key=("a", "b", "c")),
        "child": Table("a int, b int, c int", references=(Reference(("a", "b", "c"), "parent", ("a", "b", "c")), Reference(("a",), "other", ("k",)))),
        "other": Table("k int", key=("k",)),
    }
    tables = {
        "parent": spark.createDataFrame([(1, 2, 3), (1, 2, 3), (4, 5, 6)], "a int, b int, c int"),
        "child": spark.createDataFrame([(1, 2, 3), (1, 2, 4), (1, 2, 4), (4, None, 7)], "a int, b int, c int"),
        "other": spark.createDataFrame([(1,)], "k int"),
    }
    found = quality.check_keys(tables, declared, ["reference"])
    assert rows(found) == [("reference", "child", "a_b_c_in_parent", "1|2|4", 2), ("reference", "child", "a_in_other", "4", 1)]
    lines = found._jdf.queryExecution().executedPlan().toString().splitlines()
    below = [lines[k + 1] for k, line in enumerate(lines) if "Exchange hashpartitioning(key" in line]
    assert below and not any("Aggregate" in line for line in below)


def test_keys_of_like_text_are_told_apart(spark):
    declared = {
        "parent": Table("a string, b string", key=("a", "b")),
        "child": Table("c string, d string", references=(Reference(("c", "d"), "parent", ("a", "b")),)),
    }
    tables = {
        "parent": spark.createDataFrame([("x|y", "z"), ("x", "y|z"), ("p", "q"), ("p", "q"), ("m|n", "o")], "a string, b string"),
        "child": spark.createDataFrame([("x", "y|z"), ("m", "n|o"), ("m", "n|o"), ("p", None)], "c string, d string"),
    }
    assert rows(quality.check_keys(tables, declared)) == [
        ("reference", "child", "c_d_in_parent", "m|n|o", 2),
        ("unique", "parent", "a_b_unique", "p|q", 2),
    ]


def test_keys_that_a_table_is_dealt_by_are_not_shuffled_again(spark):
    lines = spark.range(60).select((F.col("id") % 20).alias("k"), F.lit("x|y").alias("a"), F.col("id").alias("v"))
    table = lines.groupBy("k", "a").agg(F.sum("v").alias("v"))
    declared = {"t": Table("k bigint, v bigint", key=("k",))}
    by_key = lines.groupBy("k").agg(F.sum("v").alias("v"))
    plan = quality.check_keys({"t": by_key}, declared, ["unique"])._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1
    twice = table.unionByName(table.filter("k = 3"))
    found = quality.check_keys({"t": twice}, {"t": Table("k bigint, a string, v bigint", key=("k", "a"), unique=(("v",),))}, ["unique"])
    assert rows(found.select("rule", "key", "n_rows")) == [("k_a_unique", "3|x|y", 2), ("v_unique", "69", 2)]


def test_repeated_keys_of_equal_text_are_one(spark):
    table = spark.createDataFrame([("a|b", "c"), ("a|b", "c"), ("a", "b|c"), ("a", "b|c"), ("a", "b|c"), (None, "z"), (None, "z"), ("a|b", "d")], "k string, l string")
    found = quality.check_keys({"t": table}, {"t": Table("k string, l string", key=("k", "l"))}, ["unique"])
    assert [tuple(r) for r in found.collect()] == [("unique", "t", "k_l_unique", "a|b|c", 5)]


def sources(spark, **lacking):
    """Two parts of two suppliers, four orders of two customers; ``lacking`` takes a table's value of one column out of its second row."""
    day = dt.datetime(1998, 1, 4)
    told = {
        "region": [(0, "AFRICA")],
        "nation": [(1, "KENYA", 0), (2, "EGYPT", 0)],
        "customer": [(n, f"c{n}", 1, 10.0 * n, "AUTO") for n in (1, 2)],
        "supplier": [(n, f"s{n}", n, -1.0) for n in (1, 2)],
        "part": [(n, f"p{n}", "b", "PROMO", 3, 1.0) for n in (11, 22)],
        "orders": [(n, 1 + n % 2, "OFP"[n % 3], 9.0, day + dt.timedelta(days=n), "1-URGENT") for n in range(1, 5)],
        "lineitem": [(n, p, s, k, 46.0 + k, 9.0, 0.05, 0.01 * k, "R", "F", day + dt.timedelta(days=9)) for n in range(1, 5) for k, (p, s) in enumerate(((11, 1), (22, 2)), 1)],
    }
    out = {}
    for name, values in told.items():
        df = spark.createDataFrame(values, binding.SOURCES[name])
        gone = {lacking[name]: F.when(F.monotonically_increasing_id() != 1, F.col(lacking[name]))} if name in lacking else {}
        out[name] = df.coalesce(1).withColumns(gone)
    return out


HEAVY = ["special_orders", "standing_orders", "standing_change_log", "product_ingredients", "product_ingredients_changes", "product_shapes", "tmp_chng"]


def missing_of(tables):
    t = catalog.flawed(binding.Bakery(tables))
    return quality.check_missing({name: t[name] for name in HEAVY}, {name: TABLES[name] for name in HEAVY})


def test_columns_without_a_null_are_marked(spark):
    plain = sources(spark, orders="o_custkey", lineitem="l_quantity")
    marked = binding.mark_whole(plain)
    for name, df in marked.items():
        assert df.dtypes == plain[name].dtypes and rows(df) == rows(plain[name])
        assert [f.name for f in df.schema if f.nullable] == {"orders": ["o_custkey"], "lineitem": ["l_quantity"]}.get(name, [])
    assert binding.mark_whole({"part": plain["part"].filter("false")})["part"].count() == 0


def test_tests_that_cannot_fail_need_no_join_of_orders_and_lines(spark):
    """Orders met all their lines, and these were grouped, for every table made of them, to look for a NULL that no table has."""
    found, plain = missing_of(binding.mark_whole(sources(spark))), missing_of(sources(spark))
    plan, before = (df._jdf.queryExecution().optimizedPlan().toString() for df in (found, plain))
    # What is left are the changes of every eleventh product, whose percent is a fault put in.
    assert plan.count("Join") == plan.count("Aggregate") == 1 and before.count("Join") > 4 and before.count("Aggregate") > 4
    assert rows(found) == rows(plain) and {r["rule"] for r in found.collect()} == {"percent_multiplier_not_null"}


def test_marked_tables_give_the_missing_values_of_plain_ones(spark):
    for lacking in (dict(orders="o_custkey", lineitem="l_quantity"), dict(orders="o_orderdate", lineitem="l_partkey"), dict(lineitem="l_tax", part="p_size")):
        plain = sources(spark, **lacking)
        found = rows(missing_of(binding.mark_whole(plain)))
        assert found == rows(missing_of(plain)) and len({r[1] for r in found}) > 1


def test_without_ansi_mode_nothing_made_is_marked(spark):
    marked = binding.mark_whole(sources(spark))
    spark.conf.set("spark.sql.ansi.enabled", "false")
    try:
        assert binding.product_ingredients(marked).schema["bakers_percent"].nullable
    finally:
        spark.conf.set("spark.sql.ansi.enabled", "true")
    assert not binding.product_ingredients(marked).schema["bakers_percent"].nullable
