"""Ingredient costs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ovenplan.functions.numbers import per_gram


def cost_list(ingredient_costs: DataFrame, ingredients: DataFrame) -> DataFrame:
    return ingredient_costs.join(ingredients.select("ingredient_id", "ingredient_name"), "ingredient_id").select(
        "ingredient_id",
        "ingredient_name",
        F.round("cost", 2).alias("cost"),
        "grams",
        per_gram(F.col("cost"), F.col("grams")).alias("cost_per_g"),
    )


def sort_unit_cost(costs: DataFrame) -> DataFrame:
    """Dearest per gram first."""
    return costs.orderBy(F.desc("cost_per_g"), "ingredient_name")


def cost_list_for(costs: DataFrame, formula_rows: DataFrame) -> DataFrame:
    """Costs of the ingredients that occur in the formula, dearest per gram first."""
    used = formula_rows.select(F.col("ingredient").alias("ingredient_name")).distinct()
    return sort_unit_cost(costs.join(used, "ingredient_name", "left_semi")).select(
        F.col("ingredient_name").alias("ingredient"), "cost", "grams", "cost_per_g"
    )


def cost_change_list(log: DataFrame, ingredients: DataFrame, parties: DataFrame) -> DataFrame:
    """Logged cost changes with names; the maker is found by id alone."""
    makers = parties.select(F.col("party_id").alias("maker_id"), F.col("party_name").alias("maker"))
    return (
        log.join(ingredients.select("ingredient_id", F.col("ingredient_name").alias("item")), "ingredient_id")
        .join(makers, "maker_id")
        .select(
            "maker",
            "item",
            F.round("old_cost", 2).alias("old_cost"),
            F.round("new_cost", 2).alias("new_cost"),
            per_gram(F.col("old_cost"), F.col("old_grams")).alias("old_cost_per_g"),
            per_gram(F.col("new_cost"), F.col("new_grams")).alias("new_cost_per_g"),
            "new_grams",
            "change_time",
        )
    )
