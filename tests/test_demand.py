from __future__ import annotations

import datetime as dt
import random
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from ovenplan.operators import demand
from tests.conftest import MONDAY, bakery_on, make, rows

# Grams of kamut sourdough to start on each weekday, Sunday first.
KAMUT_WEIGHTS = [3200, 4800, 4800, 3200, 4800, 3200, 3200]


@pytest.mark.parametrize("weekday", range(7))
def test_batch_weight_by_weekday(spark, weekday):
    day = dt.date(2019, 12, 8) + dt.timedelta(days=weekday)
    found = {r["product_id"]: r["batch_weight"] for r in demand.batch_weight(bakery_on(spark, day), day).collect()}
    assert found == {"kamut": KAMUT_WEIGHTS[weekday], "pizza": 2400, "five": 1600}


def test_batch_weight_equals_sum_over_rows(bakery):
    combined = demand.todays_combined(bakery, MONDAY)
    sums = combined.groupBy("prid").agg(F.sum(F.col("amt") * F.col("grams")))
    assert dict(sums.collect()) == {
        r["product_id"]: r["batch_weight"] for r in demand.batch_weight(bakery, MONDAY).collect()
    }


def test_batch_weight_of_a_pattern(bakery):
    assert rows(demand.batch_weight(bakery, MONDAY, "KAM%")) == [("kamut", "Kamut sourdough", 4800)]
    assert rows(demand.batch_weight(bakery, dt.date(2019, 1, 1), "five%")) == [("five", "five day", 0)]


def test_todays_orders(bakery):
    assert rows(demand.todays_orders(bakery, MONDAY).select("product_id", "customer", "lead_time", "amt", "grams")) == [
        ("five", "Lark", 5, 1, 1600),
        ("kamut", "Lark", 2, 1, 1600),
        ("pizza", "Lark", 1, 6, 400),
    ]
    assert rows(demand.todays_order_summary(demand.todays_orders(bakery, MONDAY))) == [
        ("five", "five day", 1600),
        ("kamut", "Kamut sourdough", 1600),
        ("pizza", "pizza dough", 2400),
    ]


def _change(start, resume, percent):
    return {
        "day_of_week": 3,
        "customer_id": "blow",
        "product_id": "kamut",
        "shape_id": "boule",
        "start_date": MONDAY + dt.timedelta(days=start),
        "resume_date": None if resume is None else MONDAY + dt.timedelta(days=resume),
        "percent_multiplier": Decimal(percent),
    }


def test_changes_overlap_and_open_end(spark, bakery):
    changes = make(spark, "tmp_chng", [_change(1, 9, 150), _change(0, 5, 250), _change(-5, None, 900), _change(3, 9, 800)])
    due = demand.todays_adjusted_so({**bakery, "tmp_chng": changes}, MONDAY)
    assert rows(due.select("dow", "amt")) == [(3, 2), (3, 3)]  # 1.5 and 2.5, rounded half up
    none = demand.todays_adjusted_so({**bakery, "tmp_chng": changes.filter("percent_multiplier >= 800")}, MONDAY)
    assert rows(none.select("dow", "amt")) == [(3, 1)]


def test_every_weekly_order_is_due_once_a_week(spark, bakery):
    random.seed(4)
    products = make(
        spark,
        "products",
        [{"product_id": f"p{n}", "product_name": f"p {n}", "lead_time_days": n, "is_dough": True} for n in range(8)],
    )
    orders = [
        {"day_of_week": d, "customer_id": "c", "io": "i", "product_id": f"p{n}", "shape_id": "s", "amt": 1}
        for d in range(7)
        for n in range(8)
    ]
    standing = make(spark, "standing_orders", orders)
    week = [demand.standing_due(standing, products, MONDAY + dt.timedelta(days=d)) for d in range(7)]
    seen = [tuple(r) for df in week for r in df.select("product_id", "day_of_week").collect()]
    assert len(seen) == len(set(seen)) == 56


# First generation: weekdays 1 to 7, Sunday last.


def v1_tables(spark, bakery, day):
    def after(days):
        return day + dt.timedelta(days=days)

    amounts = {1: 2, 2: 2, 3: 1, 4: 1, 5: 1, 6: 1, 7: 2}
    percents = {1: 50, 2: 50, 3: 100, 4: 100, 5: 100, 6: 100, 7: 50}
    key = "day_of_week smallint, customer_id string, product_id string, shape_id string"
    standing = spark.createDataFrame(
        [(d, "blow", "kamut", "boule", "i", a) for d, a in amounts.items()], f"{key}, io string, amt int"
    )
    holds = spark.createDataFrame(
        [(d, "blow", "kamut", "boule", after(2), after(7), p) for d, p in percents.items()],
        f"{key}, start_date date, resume_date date, decrease_percent int",
    )
    days = spark.createDataFrame([(d, "Sun") for d in range(1, 8)], "dow_id smallint, dow_names string")
    orders = bakery_on(spark, day)["special_orders"]
    return {**bakery, "standing_orders": standing, "holds": holds, "days_of_week": days, "special_orders": orders}


@pytest.mark.parametrize("weekday", range(7))
def test_first_generation_weight_by_weekday(spark, bakery, weekday):
    day = dt.date(2019, 12, 8) + dt.timedelta(days=weekday)
    tables = v1_tables(spark, bakery, day)
    found = {r["dough_id"]: r["batch_weight"] for r in demand.batch_weight_v1(tables, day).collect()}
    assert found["kamut"] == [3200, 1600, 1600, 1600, 1600, 3200, 1600][weekday]
    assert found["pizza"] == 2400


def test_held_grams_equal_the_rows(spark, bakery):
    """Many customers and holds of one product, shape and day."""
    rng = random.Random(7)
    tables = v1_tables(spark, bakery, MONDAY)
    key = "day_of_week smallint, customer_id string, product_id string, shape_id string"
    people = [f"c{n}" for n in range(40)]
    parties = spark.createDataFrame(
        [(p, "i", p.upper()) for p in people], "party_id string, party_type string, party_name string"
    )
    standing = spark.createDataFrame(
        [(3, p, "kamut", "boule", "i", rng.randint(1, 9)) for p in people], f"{key}, io string, amt int"
    )
    holds = spark.createDataFrame(
        [(3, p, "kamut", "boule", MONDAY, MONDAY + dt.timedelta(days=9), rng.choice([0, 33, 50, 100])) for p in people],
        f"{key}, start_date date, resume_date date, decrease_percent int",
    )
    tables |= {"parties": parties, "standing_orders": standing, "holds": holds}
    listed = demand.standing_minus_holds(tables, MONDAY)
    wanted = listed.groupBy("dough_id").agg(F.sum(F.col("amt") * F.col("grams")))
    assert rows(demand.held_grams(tables, MONDAY)) == rows(wanted)
    assert listed.count() > 500
