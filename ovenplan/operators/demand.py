"""Which orders must be started on a day, and how much of each product they ask for.

Orders are joined to products on product *and* due day, so the due test is part of the join key: a product's other orders are
never matched, and a much-ordered product is spread over its delivery days.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ovenplan.functions.numbers import round_div, whole
from ovenplan.functions.predicates import active_on, delivery_of_start, due_weekday, like_ci, weekday_of
from ovenplan.operators.directory import join_party

Tables = Mapping[str, DataFrame]


def _grams() -> Column:
    return F.col("amt").cast("bigint") * F.col("grams")


def special_due(special_orders: DataFrame, products: DataFrame, as_of: dt.date) -> DataFrame:
    """Special orders to start on ``as_of``, with ``product_name`` and ``lead_time_days``.

    The delivery date is part of the join key. The least and greatest lead time of the products bound it as well, as subqueries of
    the scan's filter, so only the date folders of the orders between them are read; no bound is assumed.
    """
    first, last = (
        delivery_of_start(products.agg(bound("lead_time_days")).scalar(), as_of) for bound in (F.min, F.max)
    )
    dated = products.select(
        "product_id",
        "product_name",
        "lead_time_days",
        delivery_of_start(F.col("lead_time_days"), as_of).alias("delivery_date"),
    )
    return special_orders.filter(F.col("delivery_date").between(first, last)).join(
        dated, ["product_id", "delivery_date"]
    )


def todays_orders(tables: Tables, as_of: dt.date) -> DataFrame:
    """Special orders to start on ``as_of`` with customer, shape and weight."""
    due = (
        special_due(tables["special_orders"], tables["products"], as_of)
        .join(tables["product_shapes"], ["product_id", "shape_id"])
        .join(tables["shapes"], "shape_id")
    )
    return join_party(due, tables["parties"], "customer_id", "io").select(
        "product_id",
        F.col("party_name").alias("customer"),
        "delivery_date",
        F.col("lead_time_days").alias("lead_time"),
        "amt",
        "product_name",
        "shape_name",
        "grams",
    )


def todays_order_summary(orders: DataFrame) -> DataFrame:
    """Grams per dough of ``todays_orders``, under the first-generation names."""
    return orders.groupBy(F.col("product_id").alias("dough_id"), F.col("product_name").alias("dough_name")).agg(
        F.sum(_grams()).alias("total_grams")
    )


def active_changes(changes: DataFrame, products: DataFrame, as_of: dt.date) -> DataFrame:
    """Temporary changes that cover the delivery of what starts on ``as_of``."""
    leads = products.select("product_id", "lead_time_days")
    return changes.join(leads, "product_id").filter(
        active_on(F.col("start_date"), F.col("resume_date"), F.col("lead_time_days"), as_of)
    )


def standing_due(standing_orders: DataFrame, products: DataFrame, as_of: dt.date, wrap: bool = True) -> DataFrame:
    """Weekly orders to start on ``as_of``, with ``product_name`` and ``lead_time_days``."""
    weekdays = products.select(
        "product_id",
        "product_name",
        "lead_time_days",
        due_weekday(F.col("lead_time_days"), as_of, wrap).cast("smallint").alias("day_of_week"),
    )
    return standing_orders.join(weekdays, ["product_id", "day_of_week"])


def adjusted_due(tables: Tables, products: DataFrame, as_of: dt.date) -> DataFrame:
    """Weekly orders to start on ``as_of``, scaled by the active changes. Two overlapping changes give two rows."""
    keys = ["day_of_week", "customer_id", "product_id", "shape_id"]
    changes = active_changes(tables["tmp_chng"], products, as_of).select(*keys, "percent_multiplier")
    due = standing_due(tables["standing_orders"], products, as_of)
    scaled = round_div(
        F.col("amt").cast("decimal(10,0)") * whole(F.col("percent_multiplier"), 1, 5),
        F.lit(1000).cast("decimal(4,0)"),
    )
    return due.join(changes, keys, "left").withColumn("amt", F.coalesce(scaled, F.col("amt").cast("bigint")))


def _combined_columns(due: DataFrame, product_shapes: DataFrame, weekday: Column) -> DataFrame:
    return due.join(product_shapes, ["product_id", "shape_id"]).select(
        weekday.cast("int").alias("dow"),
        F.col("customer_id").alias("cid"),
        F.col("product_id").alias("prid"),
        "product_name",
        F.col("shape_id").alias("sid"),
        F.col("amt").cast("bigint").alias("amt"),
        "grams",
    )


def todays_adjusted_so(tables: Tables, as_of: dt.date) -> DataFrame:
    """Weekly orders to start on ``as_of`` with their changed amounts and weights."""
    due = adjusted_due(tables, tables["products"], as_of)
    return _combined_columns(due, tables["product_shapes"], F.col("day_of_week"))


def special_part(tables: Tables, as_of: dt.date) -> DataFrame:
    """Special orders to start on ``as_of`` in the form of ``todays_adjusted_so``."""
    due = special_due(tables["special_orders"], tables["products"], as_of)
    return _combined_columns(due, tables["product_shapes"], weekday_of(F.col("delivery_date")))


def union_orders(adjusted_standing: DataFrame, special: DataFrame) -> DataFrame:
    return adjusted_standing.unionByName(special)


def todays_combined(tables: Tables, as_of: dt.date) -> DataFrame:
    """All orders to start on ``as_of``."""
    return union_orders(todays_adjusted_so(tables, as_of), special_part(tables, as_of))


def batch_weight(tables: Tables, as_of: dt.date, pattern: str | None = None) -> DataFrame:
    """``product_id, product_name, batch_weight`` of every product, 0 for one without orders.

    Same weights as the sum over ``todays_combined``, but amounts are added up per product and shape before weights are joined,
    so the rows of a much-ordered product are merged where they are read.
    """
    products = tables["products"]
    if pattern is not None:
        products = products.filter(like_ci(F.col("product_name"), pattern))
    amounts = (
        adjusted_due(tables, products, as_of)
        .select("product_id", "shape_id", "amt")
        .unionByName(
            special_due(tables["special_orders"], products, as_of).select(
                "product_id", "shape_id", F.col("amt").cast("bigint").alias("amt")
            )
        )
        .groupBy("product_id", "shape_id")
        .agg(F.sum("amt").alias("amt"))
    )
    sums = (
        amounts.join(tables["product_shapes"], ["product_id", "shape_id"])
        .groupBy("product_id")
        .agg(F.sum(_grams()).alias("weight"))
    )
    return products.join(sums, "product_id", "left").select(
        "product_id", "product_name", F.coalesce("weight", F.lit(0).cast("bigint")).alias("batch_weight")
    )


def standing_minus_holds(tables: Tables, as_of: dt.date) -> DataFrame:
    """First-generation weekly orders reduced by holds.

    Weekdays run from 1 to 7 and do not wrap. Holds match on product, shape and day, not on the customer; an order without an
    active partial hold does not appear. Both sides are cut to today's rows before they meet.
    """
    match = ["product_id", "shape_id", "day_of_week"]
    partial = tables["holds"].filter(F.col("decrease_percent") < 100)
    holds = active_changes(partial, tables["products"], as_of).select(*match, "decrease_percent")
    days = tables["days_of_week"].select(F.col("dow_id").alias("day_of_week"))
    due = (
        standing_due(tables["standing_orders"], tables["products"], as_of, wrap=False)
        .join(holds, match)
        .join(days, "day_of_week")
        .join(tables["shapes"], "shape_id")
        .join(tables["product_shapes"], ["product_id", "shape_id"])
    )
    left = F.lit(100) - F.col("decrease_percent")
    return join_party(due, tables["parties"], "customer_id", "io").select(
        F.col("product_id").alias("dough_id"),
        F.col("party_name").alias("customer"),
        delivery_of_start(F.col("lead_time_days"), as_of).alias("delivery_date"),
        F.col("lead_time_days").alias("lead_time"),
        round_div(F.col("amt").cast("bigint") * left, F.lit(100)).alias("amt"),
        F.col("product_name").alias("dough_name"),
        "shape_name",
        "grams",
    )


def held_grams(tables: Tables, as_of: dt.date) -> DataFrame:
    """Grams per product over the rows of ``standing_minus_holds``, without making those rows.

    The number of rows is orders times holds of a product, shape and day. Orders are counted per amount and holds per percent
    first, so at most one row per amount and percent meets, however many customers order the product.
    """
    match = ["product_id", "shape_id", "day_of_week"]
    partial = tables["holds"].filter(F.col("decrease_percent") < 100)
    holds = (
        active_changes(partial, tables["products"], as_of)
        .groupBy(*match, "decrease_percent")
        .agg(F.count(F.lit(1)).alias("holds"))
    )
    customers = tables["parties"].select(F.col("party_id").alias("customer_id"), F.col("party_type").alias("io"))
    days = tables["days_of_week"].select(F.col("dow_id").alias("day_of_week"))
    orders = (
        standing_due(tables["standing_orders"], tables["products"], as_of, wrap=False)
        .join(customers, ["customer_id", "io"], "left_semi")
        .join(days, "day_of_week", "left_semi")
        .join(tables["shapes"], "shape_id", "left_semi")
        .groupBy(*match, "amt")
        .agg(F.count(F.lit(1)).alias("orders"))
    )
    amount = round_div(F.col("amt").cast("bigint") * (F.lit(100) - F.col("decrease_percent")), F.lit(100))
    return (
        orders.join(holds, match)
        .join(tables["product_shapes"], ["product_id", "shape_id"])
        .groupBy("product_id")
        .agg(F.sum(amount * F.col("grams") * F.col("orders") * F.col("holds")).alias("grams"))
    )


def batch_weight_v1(tables: Tables, as_of: dt.date) -> DataFrame:
    """First-generation batch weight: today's special orders plus held weekly orders; 0 for a dough without orders."""
    special = todays_orders(tables, as_of).groupBy("product_id").agg(F.sum(_grams()).alias("grams"))
    sums = special.unionByName(held_grams(tables, as_of)).groupBy("product_id").agg(F.sum("grams").alias("grams"))
    return (
        tables["products"]
        .join(sums, "product_id", "left")
        .select(
            F.col("product_id").alias("dough_id"),
            F.col("product_name").alias("dough_name"),
            F.coalesce("grams", F.lit(0).cast("bigint")).alias("batch_weight"),
        )
    )
