"""A session, and a small bakery whose expected values were worked out by hand."""

from __future__ import annotations

import datetime as dt
import os
import sys
from decimal import Decimal

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from ovenplan.schemas import TABLES, TABLES_V1  # noqa: E402
from ovenplan.session import build_session  # noqa: E402

MONDAY = dt.date(2019, 12, 9)
ZERO = Decimal(0)


@pytest.fixture(scope="session")
def spark():
    session = build_session("local[4]", 4, "ovenplan-tests")
    yield session
    session.stop()


def make(spark, name, rows, generation=2, key_type=None):
    """A declared table from rows given as dicts; missing columns are NULL."""
    declared = TABLES if generation == 2 else TABLES_V1
    table = declared[name]
    ddl = table.ddl(key_type or ("string" if generation == 2 else "int"))
    return spark.createDataFrame([tuple(row.get(c) for c in table.names) for row in rows], ddl)


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def recipe_row(product, ingredient, percent, sour=0, poolish=0, soaker=0, **more):
    return {
        "product_id": product,
        "ingredient_id": ingredient,
        "bakers_percent": Decimal(str(percent)),
        "percent_in_sour": Decimal(str(sour)),
        "percent_in_poolish": Decimal(str(poolish)),
        "percent_in_soaker": Decimal(str(soaker)),
        **more,
    }


# Two doughs of the sample data with their recipes, costs and orders.
INGREDIENTS = {
    "kamut flour": (True, "6.00", 907),
    "high extraction flour": (True, "5.20", 907),
    "sprouted kamut berries": (True, "29.15", 4536),
    "water": (False, "0.55", 3785),
    "sea salt": (False, "1.25", 450),
    "strong flour": (True, "2.20", 907),
    "saf-instant yeast": (False, "2.50", 450),
    "dried cranberries": (False, "7.50", 450),
}
KAMUT = [
    ("kamut flour", 60, 0, 0, 20),
    ("high extraction flour", 40, 33, 0, 20),
    ("sprouted kamut berries", 25, 0, 0, 0),
    ("water", 80, 20, 0, 18),
    ("sea salt", 2.2, 0, 0, 0),
]
PIZZA = [
    ("strong flour", 30, 0, 25, 0),
    ("kamut flour", 40, 0, 0, 0),
    ("high extraction flour", 30, 0, 0, 0),
    ("water", 68, 0, 20, 0),
    ("sea salt", 1.9, 0, 0, 0),
    ("saf-instant yeast", 0.05, 0, 100, 0),
]
CRANBERRY = [("dried cranberries", 20, 0, 0, 0), ("water", 75, 20, 0, 18), ("sea salt", 2.0, 0, 0, 0)]
WEEKLY_AMOUNTS = {0: 2, 1: 2, 2: 2, 3: 1, 4: 1, 5: 1, 6: 1}
CHANGES = {1: (2, 7, 50), 2: (2, 7, 50), 3: (2, 7, 200), 4: (2, 7, 150), 5: (8, 14, 300), 6: (2, 7, 200), 0: (2, 7, 50)}


def bakery_on(spark, day):
    """The current-schema tables with orders and changes relative to ``day``."""

    def after(days):
        return day + dt.timedelta(days=days)

    return {
        "products": make(
            spark,
            "products",
            [
                {"product_id": "kamut", "product_name": "Kamut sourdough", "lead_time_days": 2, "is_dough": True},
                {"product_id": "pizza", "product_name": "pizza dough", "lead_time_days": 1, "is_dough": True},
                {"product_id": "five", "product_name": "five day", "lead_time_days": 5, "is_dough": True},
            ],
        ),
        "ingredients": make(
            spark,
            "ingredients",
            [{"ingredient_id": n, "ingredient_name": n, "is_flour": v[0]} for n, v in INGREDIENTS.items()],
        ),
        "ingredient_costs": make(
            spark,
            "ingredient_costs",
            [
                {
                    "ingredient_id": n,
                    "maker_id": "mill",
                    "mio": "o",
                    "seller_id": "mill",
                    "sio": "o",
                    "cost": Decimal(v[1]),
                    "grams": Decimal(v[2]),
                }
                for n, v in INGREDIENTS.items()
            ],
        ),
        "product_ingredients": make(
            spark,
            "product_ingredients",
            [recipe_row("kamut", *r) for r in KAMUT] + [recipe_row("pizza", *r) for r in PIZZA],
        ),
        "dough_mods": make(spark, "dough_mods", [recipe_row("kamut", *r, mod_name="cranberry") for r in CRANBERRY]),
        "shapes": make(
            spark,
            "shapes",
            [{"shape_id": "boule", "shape_name": '12" boule'}, {"shape_id": "round", "shape_name": '16" pizza'}],
        ),
        "product_shapes": make(
            spark,
            "product_shapes",
            [
                {"product_id": "kamut", "shape_id": "boule", "grams": 1600},
                {"product_id": "five", "shape_id": "boule", "grams": 1600},
                {"product_id": "pizza", "shape_id": "round", "grams": 400},
            ],
        ),
        "parties": make(
            spark,
            "parties",
            [
                {"party_id": "blow", "party_type": "i", "party_name": "Lark"},
                {"party_id": "mill", "party_type": "o", "party_name": "Cobble Works"},
            ],
        ),
        "special_orders": make(
            spark,
            "special_orders",
            [
                {
                    "delivery_date": after(days),
                    "customer_id": "blow",
                    "io": "i",
                    "product_id": product,
                    "shape_id": shape,
                    "amt": amt,
                    "created": dt.datetime(2019, 12, 1),
                }
                for product, shape, days, amt in (
                    ("kamut", "boule", 2, 1),
                    ("pizza", "round", 1, 6),
                    ("five", "boule", 5, 1),
                    ("pizza", "round", 2, 50),
                )
            ],
        ),
        "standing_orders": make(
            spark,
            "standing_orders",
            [
                {
                    "day_of_week": dow,
                    "customer_id": "blow",
                    "io": "i",
                    "product_id": "kamut",
                    "shape_id": "boule",
                    "amt": amt,
                }
                for dow, amt in WEEKLY_AMOUNTS.items()
            ],
        ),
        "tmp_chng": make(
            spark,
            "tmp_chng",
            [
                {
                    "day_of_week": dow,
                    "customer_id": "blow",
                    "product_id": "kamut",
                    "shape_id": "boule",
                    "start_date": after(start),
                    "resume_date": after(resume),
                    "percent_multiplier": Decimal(percent),
                }
                for dow, (start, resume, percent) in CHANGES.items()
            ],
        ),
    }


@pytest.fixture(scope="session")
def bakery(spark):
    return bakery_on(spark, MONDAY)
