"""Updates that write only the folders they touch."""

from __future__ import annotations

import datetime as dt
from pathlib import Path

from pyspark.sql import functions as F

from ovenplan.operators import folders, snapshots
from ovenplan.sources.tables import load_tables, write_table
from tests.conftest import make, rows

NOW = dt.datetime(2019, 12, 9, 12)


def weekly(spark):
    return make(
        spark,
        "standing_orders",
        [
            {"day_of_week": d, "customer_id": f"c{n}", "io": "o", "product_id": "p", "shape_id": "s", "amt": 10 * n + d}
            for d in range(7)
            for n in range(1, 4)
        ],
    )


def files(folder):
    return {str(p.relative_to(folder)) for p in Path(folder).rglob("*.parquet") if p.is_file()}


def test_other_folders_keep_their_files(spark, tmp_path):
    orders = weekly(spark)
    write_table(orders, str(tmp_path), "standing_orders")
    before = files(tmp_path)
    where, changes = F.expr("day_of_week = 2 AND amt > 20"), {"day_of_week": F.lit(4).cast("smallint"), "amt": (F.col("amt") + 1).cast("smallint")}
    assert folders.update_where(spark, str(tmp_path), "standing_orders", where, changes, NOW) == {2, 4}
    after = load_tables(spark, str(tmp_path), ["standing_orders"])["standing_orders"]
    assert rows(after.select(*orders.columns)) == rows(snapshots.apply_update(orders, where, changes, NOW, "standing_orders"))
    same = {f for f in before if "day_of_week=2" not in f and "day_of_week=4" not in f}
    assert same and same <= files(tmp_path)
    assert not (before - same) & files(tmp_path)


def test_a_folder_that_all_rows_leave_goes(spark, tmp_path):
    write_table(weekly(spark), str(tmp_path), "standing_orders")
    moved = {"day_of_week": F.lit(6).cast("smallint")}
    assert folders.update_where(spark, str(tmp_path), "standing_orders", F.col("day_of_week") == 0, moved) == {0, 6}
    assert not (tmp_path / "standing_orders.parquet" / "day_of_week=0").exists()
    after = load_tables(spark, str(tmp_path), ["standing_orders"])["standing_orders"]
    assert after.count() == 21 and after.filter("day_of_week = 6").count() == 6


def test_updates_by_key(spark, tmp_path):
    orders = weekly(spark)
    write_table(orders, str(tmp_path), "standing_orders")
    before = files(tmp_path)
    keys = ["day_of_week", "customer_id", "product_id", "shape_id"]
    updates = spark.createDataFrame(
        [(3, "c1", "p", "s", 99, 1), (3, "c1", "p", "s", 98, 2), (3, "nobody", "p", "s", 5, 1)],
        "day_of_week smallint, customer_id string, product_id string, shape_id string, amt smallint, seq int",
    )
    assert folders.update_by_key(spark, str(tmp_path), "standing_orders", updates, keys, order=["seq"]) == {3}
    after = load_tables(spark, str(tmp_path), ["standing_orders"])["standing_orders"].select(*orders.columns)
    assert rows(after) == rows(snapshots.apply_updates(orders, updates, keys, order=["seq"]))
    assert {f for f in before if "day_of_week=3" not in f} <= files(tmp_path)
    nothing = updates.filter("customer_id = 'nobody'")
    assert folders.update_by_key(spark, str(tmp_path), "standing_orders", nothing, keys, order=["seq"]) == set()
