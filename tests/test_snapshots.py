from __future__ import annotations

import datetime as dt
import uuid

import pytest
from pyspark.sql import functions as F

from ovenplan.operators import snapshots
from ovenplan.schemas import TABLES, TABLES_V1
from ovenplan.sources.tables import adopt_v1, load_tables, write_table
from tests.conftest import MONDAY, make, rows

NOW = dt.datetime(2019, 12, 9, 12)


def test_defaults(spark):
    incoming = spark.createDataFrame([("a", None), ("b", "w")], "party_id string, phone_type string")
    filled = snapshots.fill_defaults(incoming, "phones", NOW)
    assert rows(filled) == [("a", "m", NOW, NOW), ("b", "w", NOW, NOW)]
    parties = snapshots.fill_defaults(
        spark.createDataFrame([("o", "x"), ("o", "y")], "party_type string, party_name string"), "parties", NOW
    )
    assert parties.select("party_id").distinct().count() == 2


def test_ids_continue_without_gaps(spark):
    new = spark.range(5000).select(F.concat(F.lit("n"), "id").alias("name"))
    numbered = snapshots.assign_ids(new, "id", ["name"], last_id=41)
    assert sorted(r["id"] for r in numbered.collect()) == list(range(42, 5042))
    assert rows(numbered.filter("name = 'n7'")) == rows(
        snapshots.assign_ids(new.repartition(3), "id", ["name"], last_id=41).filter("name = 'n7'")
    )


def test_append_fills_missing_columns(spark):
    old = spark.createDataFrame([("k", 1, "x")], "id string, n int, note string")
    new = spark.createDataFrame([(2, "l")], "n int, id string")
    assert rows(snapshots.append_rows(old, new)) == [("k", 1, "x"), ("l", 2, None)]
    with pytest.raises(ValueError, match="extra"):
        snapshots.append_rows(old, new.withColumn("extra", F.lit(9)))


def test_defaults_have_the_declared_types(spark):
    filled = snapshots.fill_defaults(spark.range(1), "product_ingredients", NOW)
    kinds = dict(filled.dtypes)
    assert kinds["percent_in_sour"] == "decimal(18,6)" and kinds["percent_in_poolish"] == "decimal(5,2)"


def test_update_touches_every_matched_row(spark):
    parties = make(
        spark,
        "parties",
        [dict(party_id=n, party_type="o", party_name=n) for n in ("Dept of Revenue", "Dept", "Eden")]
        + [dict(party_id="nameless", party_type="o")],
    )
    renamed = snapshots.apply_update(
        parties, F.col("party_name").like("Dept%"), {"party_name": F.lit("Dept")}, NOW, "parties"
    ).select("party_id", "party_name", "modified")
    assert rows(renamed) == [
        ("Dept of Revenue", "Dept", NOW),
        ("Dept", "Dept", NOW),
        ("Eden", "Eden", None),
        ("nameless", None, None),
    ]


def test_upsert_ignores_unknown_keys_and_nulls(spark):
    old = spark.createDataFrame(
        [("a", 1, "x", None), ("b", 2, "y", None)], "id string, n int, s string, modified timestamp"
    )
    new = spark.createDataFrame([("b", 5, None), ("c", 7, "z")], "id string, n int, s string")
    assert rows(snapshots.apply_updates(old, new, ["id"], NOW, "phones")) == [("a", 1, "x", None), ("b", 5, "y", NOW)]
    assert rows(snapshots.apply_updates(old, new, ["id"], NOW, "emails")) == [("a", 1, "x", None), ("b", 5, "y", None)]
    cleared = snapshots.apply_updates(old, new, ["id"], nulls=["s"])
    assert rows(cleared) == [("a", 1, "x", None), ("b", 5, None, None)]


def test_repeated_updates_add_no_rows(spark):
    old = spark.createDataFrame([("a", 1), ("b", 2)], "id string, n int")
    new = spark.createDataFrame([("a", 7, 1), ("a", 5, 2), ("a", 6, 2)], "id string, n int, at int")
    assert rows(snapshots.apply_updates(old, new, ["id"], order=["at"])) == [("a", 6), ("b", 2)]


def test_only_touched_tables_get_a_new_time(spark):
    emails = spark.createDataFrame([("a", "w", None)], "party_id string, email_type string, modified timestamp")
    everyone = F.lit(True)
    assert rows(snapshots.apply_update(emails, everyone, {"email_type": F.lit("b")}, NOW, "emails")) == [("a", "b", None)]
    assert rows(snapshots.apply_update(emails, everyone, {"email_type": F.lit("b")}, NOW, "phones")) == [("a", "b", NOW)]


def test_tables_round_trip_and_prune(spark, bakery, tmp_path):
    folder = str(tmp_path)
    for name in ("products", "special_orders"):
        write_table(bakery[name], folder, name)
    read = load_tables(spark, folder, ["products", "special_orders"])
    assert rows(read["products"]) == rows(bakery["products"])
    columns = TABLES["special_orders"].names
    assert rows(read["special_orders"].select(columns)) == rows(bakery["special_orders"].select(columns))
    day = MONDAY + dt.timedelta(days=1)
    one = read["special_orders"].filter(F.col("delivery_date") == day)
    assert one.count() == 1 and len(one.inputFiles()) >= 1
    plan = one._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(delivery_date" in plan


def test_declared_columns_match_ddl(spark):
    for tables, key in ((TABLES, "string"), (TABLES_V1, "int")):
        for table in tables.values():
            df = spark.createDataFrame([], table.ddl(key))
            assert df.columns == table.names
            assert set(table.key) <= set(df.columns)
            assert set(table.defaults) <= set(df.columns)
            for reference in table.references:
                assert set(reference.parent_columns) <= set(tables[reference.parent].names)


def test_first_generation_names_are_adopted(spark):
    doughs = make(spark, "doughs", [dict(dough_id=1, dough_name="rye", lead_time_days=1)], 1)
    shapes = make(spark, "dough_shapes", [dict(dough_id=1, shape_id=2, ds_grams=100)], 1)
    adopted = adopt_v1({"doughs": doughs, "dough_shapes": shapes})
    assert adopted["products"].columns == ["product_id", "product_name", "lead_time_days"]
    assert adopted["product_shapes"].columns == ["product_id", "shape_id", "grams"]


def test_uuids_from_natural_keys_repeat(spark):
    new = spark.createDataFrame([("o", "x"), ("o", "y"), ("o", "y"), (None, "oy"), ("oy", None)], "party_type string, party_name string")
    natural = ["party_type", "party_name"]
    first = rows(snapshots.fill_defaults(new, "parties", NOW, natural).select("party_name", "party_type", "party_id"))
    again = rows(snapshots.fill_defaults(new.repartition(3), "parties", NOW, natural).select("party_name", "party_type", "party_id"))
    assert first == again and len({r[2] for r in first}) == 4
    assert all(uuid.UUID(r[2]).version == 8 and uuid.UUID(r[2]).variant == uuid.RFC_4122 for r in first)
    kept = new.limit(1).withColumn("party_id", F.lit("own"))
    assert snapshots.fill_defaults(kept, "parties", NOW, natural).first()["party_id"] == "own"


def test_numbers_go_on_from_the_table(spark):
    old = spark.createDataFrame([("a", 7), ("b", 12), ("c", None)], "name string, id bigint")
    new = spark.range(300).select(F.concat(F.lit("n"), "id").alias("name"))
    assert sorted(r["id"] for r in snapshots.continue_ids(old, new, "id", ["name"]).collect()) == list(range(13, 313))
    assert sorted(r["id"] for r in snapshots.continue_ids(old.limit(0), new, "id", ["name"]).collect()) == list(range(1, 301))
