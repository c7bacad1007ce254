from __future__ import annotations

from decimal import Decimal

from pyspark.sql import functions as F

from ovenplan.operators import cost, recipe
from tests.conftest import MONDAY, make, recipe_row, rows

D = Decimal

# Worked out by hand from the sample rows: %, ingredient, overall, sour, poolish, soaker, final, cost.
KAMUT = [
    ("60", "kamut flour", 1390, 0, "0.0", 278, 1112, "9.20180"),
    ("40", "high extraction flour", 927, 306, "0.0", 185, 436, "5.31171"),
    ("25", "sprouted kamut berries", 579, 0, "0.0", 0, 579, "3.72297"),
    ("80", "water", 1853, 371, "0.0", 334, 1149, "0.27795"),
    ("2.2", "sea salt", 51, 0, "0.0", 0, 51, "0.14178"),
]
PIZZA = [
    ("40", "kamut flour", 565, 0, "0.0", 0, 565, "3.74030"),
    ("30", "strong flour", 424, 0, "105.9", 0, 318, "1.03032"),
    ("30", "high extraction flour", 424, 0, "0.0", 0, 424, "2.42952"),
    ("68", "water", 960, 0, "192.1", 0, 768, "0.14400"),
    ("1.9", "sea salt", 27, 0, "0.0", 0, 27, "0.07506"),
    ("0.05", "saf-instant yeast", 1, 0, "0.7", 0, 0, "0.00556"),
]
CRANBERRY = [
    ("60", "kamut flour", 1297, 0, "0.0", 259, 1038),
    ("40", "high extraction flour", 865, 285, "0.0", 173, 406),
    ("25", "sprouted kamut berries", 541, 0, "0.0", 0, 541),
    ("75", "water", 1622, 324, "0.0", 292, 1005),
    ("20", "dried cranberries", 432, 0, "0.0", 0, 432),
    ("2.0", "sea salt", 43, 0, "0.0", 0, 43),
]


def expected(product, lines):
    return sorted(
        ((product, D(p), name, o, s, D(po), so, f, *[D(c) for c in cost]) for p, name, o, s, po, so, f, *cost in lines),
        key=lambda r: r[2],
    )


def found(df):
    return sorted((tuple(r) for r in df.collect()), key=lambda r: r[2])


def test_formula(bakery):
    assert found(recipe.formula(bakery, MONDAY, "kam%")) == expected("Kamut sourdough", KAMUT)
    assert found(recipe.formula(bakery, MONDAY, "PIZZA dough")) == expected("pizza dough", PIZZA)


def test_formula_of_all_products_is_the_formula_of_each(bakery):
    each = rows(recipe.formula(bakery, MONDAY, "kam%")) + rows(recipe.formula(bakery, MONDAY, "pizza%"))
    assert rows(recipe.formula(bakery, MONDAY)) == sorted(each, key=repr)


def test_formula_costs(bakery):
    formula = recipe.formula(bakery, MONDAY)
    assert rows(recipe.formula_cost(formula)) == [
        ("Kamut sourdough", D("18.65621")),
        ("pizza dough", D("7.42476")),
    ]
    assert rows(recipe.formula_cost_per_gram(formula)) == [
        ("Kamut sourdough", 4800, D("18.65621"), D("0.0039")),
        ("pizza dough", 2401, D("7.42476"), D("0.0031")),
    ]


def test_product_without_orders_has_zeros(bakery):
    idle = {**bakery, "special_orders": bakery["special_orders"].filter("product_id <> 'pizza'")}
    lines = recipe.formula(idle, MONDAY, "pizza%").collect()
    assert len(lines) == 6 and {(r["overall"], r["poolish"], r["cost"]) for r in lines} == {(0, D("0.0"), D("0.00000"))}
    [total] = recipe.formula_cost_per_gram(recipe.formula(idle, MONDAY, "pizza%")).collect()
    assert total["grams"] == 0 and total["cost_per_gram"] is None


def test_cost_rows_fan_out_and_drop_ingredients(spark, bakery):
    costs = bakery["ingredient_costs"]
    second = costs.filter("ingredient_id = 'water'").withColumn("seller_id", F.lit("shop"))
    tables = {**bakery, "ingredient_costs": costs.filter("ingredient_id <> 'sea salt'").unionByName(second)}
    names = [r["ingredient"] for r in recipe.formula(tables, MONDAY, "kam%").collect()]
    assert sorted(names) == ["high extraction flour", "kamut flour", "sprouted kamut berries", "water", "water"]
    assert recipe.formula(tables, MONDAY, "kam%", with_cost=False).count() == 5


def test_negative_final_part(spark, bakery):
    """Preferment percents may add up to more than 100."""
    heavy = make(spark, "product_ingredients", [recipe_row("kamut", "water", 100, 60, 60, 0)])
    [row] = recipe.formula({**bakery, "product_ingredients": heavy}, MONDAY, "kam%").collect()
    assert (row["overall"], row["sour"], row["poolish"], row["final"]) == (4800, 2880, D("2880.0"), -960)


def test_totals(bakery):
    info = recipe.product_info(bakery)
    assert rows(recipe.total_bp(info)) == [("Kamut sourdough", D("207.20")), ("pizza dough", D("169.95"))]
    assert rows(recipe.bak_per(info)) == [("kamut", D("207.20")), ("pizza", D("169.95"))]


def test_recipe_order(bakery):
    info = recipe.sort_recipe(recipe.product_info(bakery)).filter("product_id = 'kamut'")
    assert [r["ingredient"] for r in info.collect()] == [
        "kamut flour",
        "high extraction flour",
        "sprouted kamut berries",
        "water",
        "sea salt",
    ]


def test_modded_formula(bakery):
    assert rows(recipe.mod_total(bakery, "kam%", "cran%")) == [("kamut", D("222.00"))]
    for scope in ("table", "mod"):
        assert found(recipe.modded_formula(bakery, MONDAY, "kam%", "cran%", scope)) == expected(
            "Kamut sourdough", CRANBERRY
        )


def test_modifications_of_other_products(spark, bakery):
    """By table, every modification counts; by mod, only the named one of the product."""
    more = make(
        spark,
        "dough_mods",
        [
            recipe_row("pizza", "kamut flour", 10, mod_name="white"),
            recipe_row("kamut", "walnuts", 5, mod_name="nut"),
        ],
    )
    tables = {**bakery, "dough_mods": bakery["dough_mods"].unionByName(more)}
    assert rows(recipe.mod_total(tables, "kam%", "cran%")) == [("kamut", D("227.00"))]
    assert rows(recipe.mod_total(tables, "kam%", "cran%", "mod")) == [("kamut", D("222.00"))]
    by_table = recipe.modded_formula(tables, MONDAY, "kam%", "cran%")
    assert "kamut flour" not in {r["ingredient"] for r in by_table.collect()}
    by_mod = recipe.modded_formula(tables, MONDAY, "kam%", "cran%", "mod")
    assert found(by_mod) == expected("Kamut sourdough", CRANBERRY)


def test_product_without_modifications_has_no_grams(bakery):
    lines = recipe.modded_formula(bakery, MONDAY, "pizza%", "cran%").collect()
    assert len(lines) == 4 and {r["overall"] for r in lines} == {None}


def test_costs_of_a_formula(bakery):
    costs = cost.cost_list(bakery["ingredient_costs"], bakery["ingredients"])
    listed = cost.cost_list_for(costs, recipe.formula(bakery, MONDAY, "kam%"))
    assert [(r["ingredient"], r["cost_per_g"]) for r in listed.collect()] == [
        ("kamut flour", D("0.00662")),
        ("sprouted kamut berries", D("0.00643")),
        ("high extraction flour", D("0.00573")),
        ("sea salt", D("0.00278")),
        ("water", D("0.00015")),
    ]
    assert [r["ingredient_name"] for r in cost.sort_unit_cost(costs).limit(1).collect()] == ["dried cranberries"]


def test_instructions_in_order(spark, bakery):
    steps = make(
        spark,
        "product_instructions",
        [{"product_id": "kamut", "sequence": n, "directions": f"step {n}"} for n in (10, 2, 0, 1)]
        + [{"product_id": "pizza", "sequence": 0, "directions": "bake"}],
    )
    listed = recipe.instructions_for(steps, bakery["products"], "kamut%")
    assert [r["sequence"] for r in listed.collect()] == [0, 1, 2, 10]
