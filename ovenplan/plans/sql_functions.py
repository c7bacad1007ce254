"""The functions of the schema as temporary SQL functions, for queries written in SQL.

They read the registered tables and views, so they see the planning date those were registered for. Call ``register_views``
first. Patterns are LIKE patterns and ignore case.

``modded_formula(dough, mod)`` and ``bak_per2(dough, mod)`` take two patterns given as text. For a table of requests, pass it to
``register_functions``: all of them are then worked out in one plan, and ``requested_formula(dough, mod)`` gives the rows of one, by
equality, so a lateral join on the requests is an ordinary join::

    SELECT r.*, f.* FROM requests r, LATERAL requested_formula(r.dough, r.mod) f
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession

from ovenplan.operators import demand, recipe
from ovenplan.sources.tables import register

# Function name -> table, name column and key column.
KEY_LOOKUPS = {
    "pid": ("parties", "party_name", "party_id"),
    "prid": ("products", "product_name", "product_id"),
    "iid": ("ingredients", "ingredient_name", "ingredient_id"),
    "sid": ("shapes", "shape_name", "shape_id"),
}
FORMULA_COLUMNS = (
    "product STRING, `%` DECIMAL(5,2), ingredient STRING, overall BIGINT, sour BIGINT, poolish DECIMAL(18,1), "
    "soaker BIGINT, final BIGINT"
)


MODDED_COLUMNS = (
    "dough STRING, `%` DECIMAL(5,2), ingredient STRING, overall BIGINT, sour BIGINT, poolish DECIMAL(18,1), soaker BIGINT, final BIGINT"
)


def _grams(part: str | None = None, places: int = 0) -> str:
    """Grams of a row for the weight ``w`` and the percent total ``t``, rounded once, half away from zero."""
    top = "CAST(w AS DECIMAL(18,0)) * CAST(bakers_percent * 100 AS DECIMAL(7,0))"
    bottom = "CAST(t * 100 AS DECIMAL(17,0))"
    if part is not None:
        top, bottom = f"{top} * CAST(({part}) * 1000000 AS DECIMAL(10,0))", f"{bottom} * 100000000"
    units = f"CAST(sign({top}) AS INT) * ((abs({top}) * {2 * 10**places} + {bottom}) DIV (2 * {bottom}))"
    return units if places == 0 else f"CAST(CAST({units} AS DECIMAL(18,0)) * CAST(1e-{places} AS DECIMAL({places + 1},{places})) AS DECIMAL(18,{places}))"


def _modded_bodies() -> dict[str, tuple[str, str, str]]:
    """The functions of two patterns: a product and a modification of it."""

    def totals(name: str) -> str:
        return f"""SELECT product_id, CAST(max(changed) + sum(CASE WHEN hit = 0 THEN percent END) AS DECIMAL(15,2)) AS t FROM (
            SELECT product_id, ingredient_id, max(bakers_percent) AS percent, max(changed) AS changed, max(hit) AS hit FROM (
                SELECT *, CASE WHEN {_like('mod_name', f'{name}.mod')} THEN 1 ELSE 0 END AS hit FROM modified_counts
                WHERE {_like('product_name', f'{name}.dough')}
            ) GROUP BY product_id, ingredient_id
        ) GROUP BY product_id"""

    rest = "CAST(100 AS DECIMAL(18,6)) - percent_in_sour - percent_in_poolish - percent_in_soaker"
    return {
        "bak_per2": ("(dough STRING, mod STRING)", "DECIMAL(15,2)", f"(SELECT min(t) FROM ({totals('bak_per2')}))"),
        "modded_formula": (
            "(dough STRING, mod STRING)",
            f"TABLE ({MODDED_COLUMNS})",
            f"""SELECT product_name, bakers_percent, ingredient, {_grams()}, {_grams('percent_in_sour')},
                {_grams('percent_in_poolish', 1)}, {_grams('percent_in_soaker')}, {_grams(rest)}
            FROM (
                SELECT * FROM modified_lines WHERE {_like('product_name', 'modded_formula.dough')}
                AND (mod_name IS NULL OR {_like('mod_name', 'modded_formula.mod')})
            ) JOIN ({totals('modded_formula')}) USING (product_id)""",
        ),
    }


def _like(column: str, argument: str) -> str:
    return f"lower({column}) LIKE lower({argument})"


def register_functions(
    spark: SparkSession, tables: Mapping[str, DataFrame], as_of: dt.date, requests: DataFrame | None = None
) -> list[str]:
    """Create the functions in the session; returns their names. ``requests`` (dough, mod) adds ``requested_formula``."""
    register(
        {
            "all_formulas": recipe.formula(tables, as_of),
            "all_batch_weights": demand.batch_weight(tables, as_of),
            "modified_lines": recipe.modified_lines(tables, as_of),
            "modified_counts": recipe.modified_counts(tables),
        }
    )
    bodies = {
        "formula": (
            "(pattern STRING)",
            f"TABLE ({FORMULA_COLUMNS}, cost DECIMAL(28,5))",
            f"SELECT * FROM all_formulas WHERE {_like('product', 'formula.pattern')}",
        ),
        "phone_search": (
            "(pattern STRING)",
            "TABLE (name STRING, phone_type STRING, phone_no STRING)",
            f"SELECT name, type, phone_no FROM phone_book WHERE {_like('name', 'phone_search.pattern')}",
        ),
        "get_batch_weight": (
            "(pattern STRING)",
            "BIGINT",
            f"(SELECT coalesce(sum(batch_weight), 0) FROM all_batch_weights WHERE "
            f"{_like('product_name', 'get_batch_weight.pattern')})",
        ),
        "bak_per": (
            "(pattern STRING)",
            "DECIMAL(15,2)",
            f"(SELECT min(t) FROM (SELECT sum(bakers_percent) AS t FROM product_info WHERE "
            f"{_like('product_name', 'bak_per.pattern')} GROUP BY product_id))",
        ),
        "percent_change": (
            "(new_value DECIMAL(18,6), old_value DECIMAL(18,6), places INT DEFAULT 1)",
            "DECIMAL(18,6)",
            "CAST(sign(new_value - old_value) * sign(old_value) * (("
            "2 * abs(CAST((new_value - old_value) * 1000000 AS DECIMAL(18,0))) * 100 * CAST(power(10, places) AS DECIMAL(7,0)) "
            "+ abs(CAST(old_value * 1000000 AS DECIMAL(18,0)))) DIV (2 * abs(CAST(old_value * 1000000 AS DECIMAL(18,0))))) "
            "* CAST(power(10, -places) AS DECIMAL(7,6)) AS DECIMAL(18,6))",
        ),
    }
    bodies |= _modded_bodies()
    if requests is not None:
        register({"requested_formulas": recipe.modded_formulas(tables, as_of, requests)})
        bodies["requested_formula"] = (
            "(dough STRING, mod STRING)",
            f"TABLE ({MODDED_COLUMNS})",
            "SELECT dough, `%`, ingredient, overall, sour, poolish, soaker, final FROM requested_formulas "
            "WHERE get_dough = requested_formula.dough AND get_mod = requested_formula.mod",
        )
    for name, (table, name_column, key) in KEY_LOOKUPS.items():
        kind = tables[table].schema[key].dataType.simpleString()
        bodies[name] = (
            "(pattern STRING)",
            kind,
            f"(SELECT min({key}) FROM {table} WHERE {_like(name_column, f'{name}.pattern')})",
        )
    for name, (arguments, result, body) in bodies.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}{arguments} RETURNS {result} RETURN {body}")
    return list(bodies)
