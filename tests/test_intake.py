"""Checked appends: each kind of fault is rejected with its reason, sound rows are taken, and few stored rows are compared."""

from __future__ import annotations

import datetime as dt

from ovenplan.operators import intake
from tests.conftest import MONDAY, make, rows

STAMP = dt.datetime(2019, 12, 9, 12)


def order(customer, product="kamut", shape="boule", amt=1, io="i", day=MONDAY, created=STAMP):
    return dict(delivery_date=day, customer_id=customer, io=io, product_id=product, shape_id=shape, amt=amt, created=created)


def stored(spark, orders):
    return {
        "special_orders": make(spark, "special_orders", orders),
        "products": make(spark, "products", [dict(product_id="kamut", product_name="kamut"), dict(product_id="rye", product_name="rye")]),
        "shapes": make(spark, "shapes", [dict(shape_id="boule", shape_name="12 boule")]),
        "parties": make(spark, "parties", [dict(party_id=f"c{k}", party_type="i", party_name=f"name {k}") for k in range(300)]),
    }


def split(spark, batch, known=()):
    incoming = make(spark, "special_orders", [row for row, _ in batch])
    numbered = spark.createDataFrame([(*r, n) for r, (_, n) in zip(incoming.collect(), batch, strict=True)], incoming.schema.add("seq", "integer"))
    return intake.checked_append(stored(spark, list(known)), "special_orders", numbered, MONDAY, ["seq"])


KEY = "delivery_date_customer_id_product_id_shape_id_created_unique"


def test_each_fault_has_its_reason(spark):
    batch = [
        order("c1"), order("c2", amt=0), order("c3", product="none"), order("c4", shape=None), order("x", io="x", amt=-1), order("c5", day=MONDAY - dt.timedelta(1)),
        order("c6"), order("c7"), order("c7", amt=2), order("c8", amt=0), order("c8", amt=3),
    ]
    found = split(spark, [(row, n) for n, row in enumerate(batch)], [order("c6")])
    assert rows(found.accepted.select("customer_id", "amt")) == [("c1", 1), ("c7", 1), ("c8", 3)]
    assert {(r["customer_id"], r["amt"]): r["reasons"] for r in found.rejected.collect()} == {
        ("c2", 0): ["amt_greater_than_0"],
        ("c3", 1): ["product_id_in_products"],
        ("c4", 1): ["shape_id_not_null"],
        ("x", -1): ["amt_greater_than_0", "customer_id_io_in_parties", "io_i_or_o"],
        ("c5", 1): ["delivery_date_present_or_future"],
        ("c6", 1): [KEY],
        ("c7", 2): [KEY],
        ("c8", 0): ["amt_greater_than_0"],
    }
    table = stored(spark, [order("c6")])["special_orders"]
    assert found.next_snapshot(table).count() == 4 and found.next_snapshot(table).columns == table.columns


def test_equal_rows_and_empty_sides(spark):
    found = split(spark, [(order("c1"), 0)] * 5)
    assert found.accepted.count() == 1 and [r["reasons"] for r in found.rejected.collect()] == [[KEY]] * 4
    none = split(spark, [(order("c1"), 0)])
    assert none.rejected.count() == 0 and none.accepted.columns == make(spark, "special_orders", []).columns
    empty = intake.checked_append(stored(spark, []), "special_orders", make(spark, "special_orders", []), MONDAY, ["amt"])
    assert empty.accepted.count() == empty.rejected.count() == 0


def test_several_keys(spark):
    shapes = {"shapes": make(spark, "shapes", [dict(shape_id="a", shape_name="one")])}
    batch = make(spark, "shapes", [dict(shape_id="b", shape_name="two"), dict(shape_id="c", shape_name="two"), dict(shape_id="a", shape_name="x"), dict(shape_id="d", shape_name="one")])
    found = intake.checked_append(shapes, "shapes", batch, MONDAY, ["shape_id"], now=STAMP)
    assert rows(found.accepted.select("shape_id")) == [("b",)]
    assert {r["shape_id"]: r["reasons"] for r in found.rejected.collect()} == {"c": ["shape_name_unique"], "a": ["shape_id_unique"], "d": ["shape_name_unique"]}


def test_the_bitmap_loses_nothing_and_lets_few_through(spark):
    table = spark.range(200_000).selectExpr("CAST(id AS INT) AS k", "CONCAT('n', id % 7) AS n")
    wanted = spark.createDataFrame([(k, f"n{k % 7}") for k in range(0, 200_000, 1000)], "k long, n string")
    bitmap = intake.key_bitmap(wanted, ["k", "n"])
    assert bitmap.count() <= (1 << intake.BITS) // intake.PIECE_BITS
    near = intake.possibly_among(table, ["k", "n"], bitmap)
    assert near.columns == table.columns and 200 <= near.count() < 230
    assert near.join(wanted, ["k", "n"], "left_semi").count() == 200
    assert rows(intake.keys_found(wanted.limit(3), ["k", "n"], table, ["k", "n"])) == rows(wanted.limit(3))
