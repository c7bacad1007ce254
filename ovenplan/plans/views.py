"""All derived views of the current schema in one place."""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable, Mapping

from pyspark.sql import DataFrame, SparkSession

from ovenplan.operators import cost, demand, directory, history, recipe
from ovenplan.sources.tables import register

Tables = Mapping[str, DataFrame]


def _book(t: Tables) -> DataFrame:
    return directory.phone_book(t["phones"], t["parties"], t["people_st"])


VIEWS: dict[str, Callable[[Tables, dt.date], DataFrame]] = {
    "phone_book": lambda t, day: _book(t),
    "staff_phones": lambda t, day: directory.staff_phones(t["staff_st"], t["people_st"], _book(t)),
    "email_list": lambda t, day: directory.email_list(t["emails"], t["parties"], t["people_st"]),
    "staff_list": lambda t, day: directory.staff_list(
        t["staff_st"], t["people_st"], t["parties"], _book(t), t["zip_codes"]
    ),
    "people_list": lambda t, day: directory.people_list(t["people_st"], t["parties"]),
    "shape_list": lambda t, day: directory.shape_list(t["product_shapes"], t["products"], t["shapes"]),
    "ein_list": lambda t, day: directory.ein_list(t["ein_numbs"], t["parties"]),
    "todays_orders": demand.todays_orders,
    "todays_adjusted_so": demand.todays_adjusted_so,
    "todays_combined_spec_standing": demand.todays_combined,
    "product_info": lambda t, day: recipe.product_info(t),
    "total_bp": lambda t, day: recipe.total_bp(recipe.product_info(t)),
    "cost_list": lambda t, day: cost.cost_list(t["ingredient_costs"], t["ingredients"]),
    "cost_change_list": lambda t, day: cost.cost_change_list(t["cost_change_log"], t["ingredients"], t["parties"]),
    "standing_change_history": lambda t, day: history.standing_change_history(
        t["standing_change_log"], t["parties"], t["products"], t["shapes"], t["days_of_week"]
    ),
}


def register_views(spark: SparkSession, tables: Tables, as_of: dt.date) -> list[str]:
    """Register tables and views for SQL; returns the names of the views."""
    register(tables)
    return register({name: view(tables, as_of) for name, view in VIEWS.items()})
