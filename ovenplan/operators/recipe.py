"""Recipes in baker's percentages: totals, formulas in grams, and named modifications.

A formula is worked out for all products in one plan: the batch weight and the percent total are aggregated once per product,
not once per row. A name pattern only selects products. With a pattern that hits several products each keeps its
own weight and total.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ovenplan.functions.numbers import gram_share, round_div, whole
from ovenplan.functions.predicates import like_ci
from ovenplan.operators.cost import cost_list
from ovenplan.operators.demand import batch_weight
from ovenplan.operators.lookup import matches

Tables = Mapping[str, DataFrame]
PARTS = ["percent_in_sour", "percent_in_poolish", "percent_in_soaker"]


def product_info(tables: Tables) -> DataFrame:
    """Recipe rows with product and ingredient names."""
    named = tables["ingredients"].select("ingredient_id", F.col("ingredient_name").alias("ingredient"), "is_flour")
    return (
        tables["product_ingredients"]
        .join(named, "ingredient_id")
        .join(tables["products"].select("product_id", "product_name"), "product_id")
        .select("product_id", "product_name", "bakers_percent", "ingredient", "is_flour", *PARTS)
    )


def sort_recipe(info: DataFrame) -> DataFrame:
    """By product, flour first, then by falling percent."""
    return info.orderBy("product_id", F.desc("is_flour"), F.desc("bakers_percent"), "ingredient")


def total_bp(info: DataFrame) -> DataFrame:
    """Percent total per product name. The sum over a name's rows, once per name, is a plain aggregate."""
    return info.groupBy("product_name").agg(F.sum("bakers_percent").alias("total_bp"))


def bak_per(recipe: DataFrame) -> DataFrame:
    """Percent total per product id, of ``product_info`` or of the plain recipe rows."""
    return recipe.groupBy("product_id").agg(F.sum("bakers_percent").alias("total_percent"))


def _grams_columns(weight: Column, total: Column) -> list[Column]:
    """Overall grams and the grams in each preferment and in the final mix, each rounded on its own."""
    percent = F.col("bakers_percent")
    sour, poolish, soaker = (F.col(part) for part in PARTS)
    rest = F.lit(100).cast("decimal(18,6)") - sour - poolish - soaker
    return [
        gram_share(weight, percent, total).alias("overall"),
        gram_share(weight, percent, total, sour).alias("sour"),
        gram_share(weight, percent, total, poolish, places=1).alias("poolish"),
        gram_share(weight, percent, total, soaker).alias("soaker"),
        gram_share(weight, percent, total, rest).alias("final"),
    ]


def formula(
    tables: Tables,
    as_of: dt.date,
    pattern: str | None = None,
    with_cost: bool = True,
    weights: DataFrame | None = None,
    carry: Sequence[str] = (),
) -> DataFrame:
    """Grams and cost of every recipe row for the batch to start on ``as_of``.

    A product without orders gives zeros. With costs, ingredients without a cost row drop out and one with several cost rows
    appears once for each, as costs are found by ingredient name. ``weights`` (``product_id, batch_weight``) replaces today's; they
    may have several rows per product, told apart by the columns ``carry``, which the result keeps.

    Everything known per product is joined together before it meets the recipe rows, and so is everything known per
    ingredient: the rows are moved once for either key. A product has one row per ingredient, so only an ingredient can be hot;
    the rows meet ingredients first, straight from a shuffle on both sides, where adaptive execution splits it.
    """
    products = tables["products"].select("product_id", "product_name")
    if pattern is not None:
        products = products.filter(like_ci(F.col("product_name"), pattern))
    if weights is None:
        weights = batch_weight(tables, as_of, pattern)
    per_product = products.join(bak_per(tables["product_ingredients"]), "product_id").join(
        weights.select(*carry, "product_id", "batch_weight"), "product_id", "left"
    )
    named = tables["ingredients"].select("ingredient_id", F.col("ingredient_name").alias("ingredient"))
    if with_cost:
        costs = cost_list(tables["ingredient_costs"], tables["ingredients"])
        named = named.join(costs.select(F.col("ingredient_name").alias("ingredient"), "cost_per_g"), "ingredient")
    weight = F.coalesce("batch_weight", F.lit(0).cast("bigint"))
    recipe = tables["product_ingredients"].join(named, "ingredient_id")
    rows = (
        recipe.join(per_product, "product_id")
        .select(
            *carry,
            F.col("product_name").alias("product"),
            F.col("bakers_percent").alias("%"),
            "ingredient",
            *_grams_columns(weight, F.col("total_percent")),
            *(["cost_per_g"] if with_cost else []),
        )
    )
    if not with_cost:
        return rows
    cost = (F.col("overall").cast("decimal(18,0)") * F.col("cost_per_g")).cast("decimal(28,5)")
    return rows.withColumn("cost", cost).drop("cost_per_g")


def formula_cost(rows: DataFrame) -> DataFrame:
    return rows.groupBy("product").agg(F.sum("cost").cast("decimal(28,5)").alias("cost"))


def formula_cost_per_gram(rows: DataFrame) -> DataFrame:
    """Grams, cost and cost of one gram per product; NULL for a product without grams."""
    sums = rows.groupBy("product").agg(
        F.sum("overall").alias("grams"), F.sum("cost").cast("decimal(28,5)").alias("cost")
    )
    grams = F.nullif(F.col("grams"), F.lit(0)).cast("decimal(18,0)") * F.lit(10**5)
    return sums.withColumn("cost_per_gram", round_div(whole(F.col("cost"), 5, 28), grams, 4))


def instructions_for(instructions: DataFrame, products: DataFrame, pattern: str) -> DataFrame:
    """Directions of the matching products in working order."""
    chosen = products.filter(like_ci(F.col("product_name"), pattern)).select("product_id", "product_name")
    return (
        instructions.join(chosen, "product_id")
        .select("product_id", "product_name", "sequence", "directions")
        .orderBy("product_id", "sequence", "directions")
    )


def _chosen(tables: Tables, product: str, mod: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Matching products, all their modifications, and those of the named modification."""
    products = tables["products"].filter(like_ci(F.col("product_name"), product)).select("product_id", "product_name")
    mods = tables["dough_mods"].join(products, "product_id")
    return products, mods, mods.filter(like_ci(F.col("mod_name"), mod))


def mod_total(tables: Tables, product: str = "%", mod: str = "%", scope: str = "table") -> DataFrame:
    """Percent total of a modified product: modified rows plus the recipe rows not replaced.

    ``scope="table"`` counts the rows of every modification of the product, as the current schema does; ``scope="mod"`` only
    those of the named one. A product that lacks either kind of row has no total.
    """
    products, mods, named = _chosen(tables, product, mod)
    counted = mods if scope == "table" else named
    changed = counted.groupBy("product_id").agg(F.sum("bakers_percent").alias("changed"))
    kept = (
        tables["product_ingredients"]
        .join(products, "product_id", "left_semi")
        .join(named, ["product_id", "ingredient_id"], "left_anti")
        .groupBy("product_id")
        .agg(F.sum("bakers_percent").alias("kept"))
    )
    return changed.join(kept, "product_id").select(
        "product_id", (F.col("changed") + F.col("kept")).cast("decimal(15,2)").alias("total_percent")
    )


def modded_recipe(tables: Tables, product: str = "%", mod: str = "%", scope: str = "table") -> DataFrame:
    """Rows of the named modification, and the recipe rows it leaves alone.

    With ``scope="table"`` an ingredient modified in any product is left out of every recipe, as the current schema does;
    ``scope="mod"`` leaves out only what this modification replaces in this product.
    """
    products, _, named = _chosen(tables, product, mod)
    recipe = tables["product_ingredients"].join(products, "product_id")
    if scope == "table":
        replaced = tables["dough_mods"].select("ingredient_id")
        kept = recipe.join(replaced, "ingredient_id", "left_anti")
    else:
        kept = recipe.join(named, ["product_id", "ingredient_id"], "left_anti")
    columns = ["product_id", "product_name", "ingredient_id", "bakers_percent", *PARTS]
    rows = named.select(*columns).unionByName(kept.select(*columns))
    names = tables["ingredients"].select("ingredient_id", F.col("ingredient_name").alias("ingredient"), "is_flour")
    return rows.join(names, "ingredient_id")


def modded_formula(
    tables: Tables, as_of: dt.date, product: str = "%", mod: str = "%", scope: str = "table"
) -> DataFrame:
    """Grams of every row of the modified recipe; NULL grams where the product has no total."""
    per_product = batch_weight(tables, as_of, product).drop("product_name").join(
        mod_total(tables, product, mod, scope), "product_id", "left"
    )
    recipe = modded_recipe(tables, product, mod, scope)
    return (
        recipe.join(per_product, "product_id")
        .select(
            F.col("product_name").alias("dough"),
            F.col("bakers_percent").alias("%"),
            "ingredient",
            *_grams_columns(F.col("batch_weight"), F.col("total_percent")),
        )
    )


def modded_formulas(tables: Tables, as_of: dt.date, requests: DataFrame) -> DataFrame:
    """``modded_formula`` for a table of requests (columns ``dough`` and ``mod``, LIKE patterns), all in one plan.

    Rows carry their request as ``get_dough`` and ``get_mod``; requests that say the same count once, and one that matches nothing or
    holds a NULL has no rows. Weights and sums that no pattern changes are made once per product, whatever the number of requests.
    """
    asked = requests.select(F.col("dough").alias("get_dough"), F.col("mod").alias("get_mod")).distinct().dropna()
    request = ["get_dough", "get_mod"]
    products = tables["products"].select("product_id", "product_name", F.lower("product_name").alias("_name"))
    doughs = matches(tables["products"], "product_name", asked, "get_dough").select(F.col("pattern").alias("get_dough"), F.col("name").alias("_name"))
    mods = matches(tables["dough_mods"], "mod_name", asked, "get_mod").select(F.col("pattern").alias("get_mod"), F.col("name").alias("_mod"))
    chosen = asked.join(doughs, "get_dough").join(products, "_name").drop("_name")
    named = tables["dough_mods"].withColumn("_mod", F.lower("mod_name")).join(mods, "_mod").join(chosen, ["get_mod", "product_id"])
    recipe = tables["product_ingredients"].join(chosen, "product_id")
    kept = recipe.join(named, [*request, "product_id", "ingredient_id"], "left_anti").groupBy(*request, "product_id").agg(
        F.sum("bakers_percent").alias("kept")
    )
    changed = tables["dough_mods"].groupBy("product_id").agg(F.sum("bakers_percent").alias("changed"))
    total = (F.col("changed") + F.col("kept")).cast("decimal(15,2)").alias("total_percent")
    totals = kept.join(changed, "product_id").select(*request, "product_id", total)
    columns = [*request, "product_id", "product_name", "ingredient_id", "bakers_percent", *PARTS]
    unmodded = recipe.join(tables["dough_mods"].select("ingredient_id"), "ingredient_id", "left_anti")
    rows = named.select(*columns).unionByName(unmodded.select(*columns))
    return (
        rows.join(tables["ingredients"].select("ingredient_id", F.col("ingredient_name").alias("ingredient")), "ingredient_id")
        .join(batch_weight(tables, as_of).drop("product_name"), "product_id")
        .join(totals, [*request, "product_id"], "left")
        .select(
            *request,
            F.col("product_name").alias("dough"),
            F.col("bakers_percent").alias("%"),
            "ingredient",
            *_grams_columns(F.col("batch_weight"), F.col("total_percent")),
        )
    )


def modified_lines(tables: Tables, as_of: dt.date) -> DataFrame:
    """The rows from which ``modded_formula`` takes its own, with the weight ``w`` of their product: those of all modifications, and
    with a NULL ``mod_name`` the recipe rows whose ingredient no modification names."""
    products = batch_weight(tables, as_of).select("product_id", "product_name", F.col("batch_weight").alias("w"))
    free = tables["product_ingredients"].join(tables["dough_mods"].select("ingredient_id"), "ingredient_id", "left_anti")
    columns = ["product_id", "ingredient_id", "bakers_percent", *PARTS]
    rows = tables["dough_mods"].select("mod_name", *columns).unionByName(free.select(*columns), allowMissingColumns=True)
    names = tables["ingredients"].select("ingredient_id", F.col("ingredient_name").alias("ingredient"))
    return rows.join(names, "ingredient_id").join(products, "product_id")


def modified_counts(tables: Tables) -> DataFrame:
    """Every recipe row with each modification of it, and ``changed``, the percent of all modifications of its product."""
    changed = tables["dough_mods"].groupBy("product_id").agg(F.sum("bakers_percent").alias("changed"))
    mods = tables["dough_mods"].select("product_id", "ingredient_id", "mod_name")
    recipe = tables["product_ingredients"].select("product_id", "ingredient_id", "bakers_percent")
    rows = recipe.join(mods, ["product_id", "ingredient_id"], "left")
    products = tables["products"].select("product_id", "product_name").join(changed, "product_id", "left")
    return products.join(rows, "product_id", "left")
