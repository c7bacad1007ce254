"""The same queries as SQL for a single-node check.

Base tables are common table expressions over the driver tables. Quotients are rounded half away from zero on integers, since
decimal division there gives a double.
"""

from __future__ import annotations

import re

from ovenplan.schemas import TABLES, TABLES_V1, Table
from ovenplan.sources.binding import AS_OF

DAY = f"DATE '{AS_OF.isoformat()}'"
DOW = AS_OF.isoweekday() % 7
NOON = f"TIMESTAMP '{AS_OF.isoformat()} 12:00:00'"
PARTS = "percent_in_sour, percent_in_poolish, percent_in_soaker"


def half_up(num: str, den: str, places: int = 0) -> str:
    """``num / den`` of integers >= 0, as an integer counting units of ``10^-places``."""
    scale = 10**places
    return f"((2 * {scale} * ({num}) + ({den})) // (2 * ({den})))"


def half_away(num: str, den: str, places: int = 0) -> str:
    """As ``half_up`` for a numerator of any sign."""
    return f"(CASE WHEN ({num}) < 0 THEN -1 ELSE 1 END * {half_up(f'abs({num})', den, places)})"


def whole(expr: str, places: int) -> str:
    return f"CAST({expr} * {10**places} AS HUGEINT)"


def share(w: str, part: str | None = None, places: int = 0) -> str:
    """Grams of a recipe row for weight ``w`` and percent total ``t``."""
    num, den = f"CAST({w} AS HUGEINT) * {whole('bakers_percent', 2)}", whole("t", 2)
    if part is None:
        return half_up(num, den)
    return half_away(f"{num} * {whole(f'({part})', 6)}", f"{den} * 100000000", places)


def grams_columns(w: str) -> str:
    rest = "CAST(100 AS DECIMAL(18,6)) - percent_in_sour - percent_in_poolish - percent_in_soaker"
    return f"""CAST({share(w)} AS BIGINT) AS overall,
      CAST({share(w, 'percent_in_sour')} AS BIGINT) AS sour,
      CAST({share(w, 'percent_in_poolish', 1)} AS BIGINT) / 10.0::DOUBLE AS poolish,
      CAST({share(w, 'percent_in_soaker')} AS BIGINT) AS soaker,
      CAST({share(w, rest)} AS BIGINT) AS final"""


def unit_cost(cost: str, grams: str) -> str:
    """Cost of a gram in units of 0.00001."""
    return half_up(whole(cost, 6), whole(grams, 6), 5)


RECIPE = """
    CAST(max(CAST(l_quantity AS DECIMAL(5,2)) + CAST(l_tax AS DECIMAL(5,2))) AS DECIMAL(5,2)) AS bakers_percent,
    CAST(round(max(l_discount) * 100) AS DECIMAL(18,6)) AS percent_in_sour,
    CAST(round(max(l_tax) * 100) AS DECIMAL(5,2)) AS percent_in_poolish,
    CAST(max(l_linenumber) * 2 AS DECIMAL(18,6)) AS percent_in_soaker"""

WEEKLY = "dayofweek(o_orderdate) AS day_of_week, o_custkey AS customer_id, l_partkey AS product_id, CAST(l_linenumber AS BIGINT) AS shape_id"

CHANGED = f"'{AS_OF.isoformat()} 12:00:00'"

# Codes and what they stand for.
PHONE_KIND = "MAP {'b': 'business', 'e': 'emergency', 'f': 'fax', 'h': 'home', 'm': 'mobile', 'w': 'work'}[phone_type]"
EMAIL_KIND = "MAP {'b': 'business', 'p': 'personal', 'w': 'work'}[email_type]"


def _orders_of(due: str) -> str:
    return f"""SELECT product_id, party_name AS customer, strftime(delivery_date, '%Y-%m-%d') AS delivery_date,
        lead_time_days AS lead_time, amt, product_name, shape_name, grams
        FROM (SELECT *, customer_id AS party_id, io AS party_type FROM {due}) JOIN parties USING (party_id, party_type)
        JOIN shapes USING (shape_id) JOIN product_shapes USING (product_id, shape_id)"""


CTES = {
    "parties": """SELECT c_custkey AS party_id, 'i' AS party_type, c_name AS party_name FROM customer
        UNION ALL SELECT s_suppkey, 'o', s_name FROM supplier""",
    "people_st": "SELECT c_custkey AS party_id, 'i' AS party_type, c_mktsegment AS first_name FROM customer",
    "zip_codes": """SELECT CAST(10000 + n_nationkey AS VARCHAR) AS zip, n_name AS city,
        upper(substr(r_name, 1, 2)) AS state FROM nation JOIN region ON n_regionkey = r_regionkey""",
    "staff_st": """SELECT c_custkey AS party_id, 'i' AS party_type, 'S' || c_custkey AS ssn,
        CAST(min(o_orderdate) AS DATE) AS hire_date, c_acctbal > 5000 AS is_active,
        CAST(c_custkey AS VARCHAR) AS street_no, c_mktsegment AS street, CAST(10000 + c_nationkey AS VARCHAR) AS zip
        FROM customer JOIN orders ON c_custkey = o_custkey WHERE c_acctbal > 0 GROUP BY ALL""",
    "organization_st": """SELECT s_suppkey AS party_id, 'o' AS party_type,
        CASE s_nationkey % 4 WHEN 0 THEN 'b' WHEN 1 THEN 'c' WHEN 2 THEN 'n' ELSE 'g' END AS org_type FROM supplier""",
    "ein_numbs": "SELECT 'E' || s_suppkey AS ein, s_suppkey AS party_id, 'o' AS party_type FROM supplier",
    "phones": """SELECT o_custkey AS party_id, CASE substr(o_orderpriority, 1, 1) WHEN '1' THEN 'm' WHEN '2' THEN 'w'
          WHEN '3' THEN 'h' WHEN '4' THEN 'f' WHEN '5' THEN 'e' END AS phone_type,
        CAST(min(o_orderkey) AS VARCHAR) AS phone_no, min(o_orderdate) AS created, max(o_orderdate) AS modified
        FROM orders GROUP BY 1, 2
        UNION ALL SELECT s_suppkey, 'b', 'S' || s_suppkey, NULL, NULL FROM supplier""",
    "emails": """SELECT o_custkey AS party_id, CASE o_orderstatus WHEN 'F' THEN 'w' WHEN 'O' THEN 'b' WHEN 'P' THEN 'p'
          END AS email_type, 'u' || min(o_orderkey) || '@example.org' AS email FROM orders GROUP BY 1, 2""",
    "ingredients": """SELECT s_suppkey AS ingredient_id, s_name AS ingredient_name, s_nationkey % 2 = 0 AS is_flour,
        s_suppkey AS manufacturer_id, 'o' AS manufacturer_type FROM supplier""",
    "ingredient_costs": """SELECT s_suppkey AS ingredient_id, s_suppkey AS maker_id, 'o' AS mio, s_suppkey AS seller_id,
        'o' AS sio, CAST(s_acctbal AS DECIMAL(10,5)) AS cost, CAST(100 + 10 * s_nationkey AS DECIMAL(18,6)) AS grams
        FROM supplier WHERE s_acctbal > 0""",
    "products": """SELECT p_partkey AS product_id, p_name || ' ' || p_partkey AS product_name,
        CAST(p_size % 8 AS BIGINT) AS lead_time_days, p_type <> 'ECONOMY' AS is_dough FROM part""",
    "products_v1": "SELECT * REPLACE (CASE WHEN product_id % 5 = 0 THEN lead_time_days + 8 ELSE lead_time_days END AS lead_time_days) FROM products",
    "product_lines": """SELECT DISTINCT l_partkey, l_linenumber, p_brand, p_size
        FROM lineitem JOIN part ON l_partkey = p_partkey""",
    "product_instructions": """SELECT l_partkey AS product_id, CAST(l_linenumber AS BIGINT) AS sequence,
        p_brand || ' step ' || l_linenumber AS directions FROM product_lines""",
    "shapes": "SELECT DISTINCT CAST(l_linenumber AS BIGINT) AS shape_id, 'shape ' || l_linenumber AS shape_name FROM lineitem",
    "product_shapes": """SELECT l_partkey AS product_id, CAST(l_linenumber AS BIGINT) AS shape_id,
        CAST(100 + p_size + 10 * l_linenumber AS BIGINT) AS grams FROM product_lines""",
    "product_ingredients": f"""SELECT l_partkey AS product_id, l_suppkey AS ingredient_id, {RECIPE}
        FROM lineitem GROUP BY 1, 2""",
    "dough_mods": f"""SELECT mod_name, product_id, ingredient_id, CAST(bakers_percent + 1 AS DECIMAL(5,2)) AS bakers_percent,
        {PARTS} FROM (SELECT 'mod ' || l_linestatus AS mod_name, l_partkey AS product_id, l_suppkey AS ingredient_id, {RECIPE}
        FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN part ON l_partkey = p_partkey
        WHERE l_returnflag = 'R' AND s_acctbal < 0 AND p_type = 'PROMO' GROUP BY 1, 2, 3)""",
    "special_orders": """SELECT CAST(l_shipdate AS DATE) AS delivery_date, o_custkey AS customer_id, 'i' AS io,
        l_partkey AS product_id, CAST(l_linenumber AS BIGINT) AS shape_id, CAST(l_quantity AS BIGINT) AS amt, o_orderdate AS created
        FROM lineitem JOIN orders ON l_orderkey = o_orderkey""",
    "days_of_week": """SELECT * FROM (VALUES (0, 'Sun'), (1, 'Mon'), (2, 'Tue'), (3, 'Wed'), (4, 'Thu'), (5, 'Fri'),
        (6, 'Sat')) AS d(dow_id, dow_names)""",
    "standing_orders": f"""SELECT {WEEKLY}, CAST(sum(l_quantity) AS BIGINT) AS amt, min(o_orderdate) AS created, 'i' AS io
        FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY 1, 2, 3, 4""",
    "change_groups": f"""SELECT {WEEKLY}, CAST(max(o_orderdate) AS DATE) AS start_date,
        CASE WHEN min(l_tax) > 0 THEN CAST(max(o_orderdate) AS DATE) + 30 END AS resume_date
        FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE l_returnflag = 'R' GROUP BY 1, 2, 3, 4""",
    "tmp_chng": """SELECT *, CASE product_id % 3 WHEN 0 THEN 50 WHEN 1 THEN 150 ELSE 200 END AS percent_multiplier
        FROM change_groups""",
    "holds": """SELECT * REPLACE (CASE day_of_week WHEN 0 THEN 7 ELSE day_of_week END AS day_of_week),
        CASE product_id % 3 WHEN 0 THEN 0 WHEN 1 THEN 50 ELSE 100 END AS decrease_percent FROM change_groups""",
    "standing_v1": """SELECT * REPLACE (CASE day_of_week WHEN 0 THEN 7 ELSE day_of_week END AS day_of_week)
        FROM standing_orders""",
    # Whoever shares an id shares its labels: an organization's row shows the first name of the person with the same id.
    "doughs_v1": "SELECT product_id AS dough_id, product_name AS dough_name, lead_time_days FROM products_v1",
    "dough_shapes_v1": "SELECT product_id AS dough_id, shape_id, grams AS ds_grams FROM product_shapes",
    "dough_ingredients_v1": "SELECT * RENAME (product_id AS dough_id) FROM product_ingredients",
    "special_v1": """SELECT l_orderkey * 10 + l_linenumber AS special_order_id, o_custkey AS customer_id, 'i' AS customer_type,
        l_partkey AS dough_id, l_linenumber AS shape_id FROM lineitem JOIN orders ON l_orderkey = o_orderkey""",
    "days_v1": "SELECT CASE dow_id WHEN 0 THEN 7 ELSE dow_id END AS dow_id, dow_names FROM days_of_week",
    "orders_v1": "SELECT day_of_week, customer_id, io AS customer_type, product_id AS dough_id, shape_id FROM standing_v1",
    "holds_v1": """SELECT day_of_week || '-' || customer_id || '-' || product_id || '-' || shape_id AS hold_id, day_of_week, customer_id,
        product_id AS dough_id, shape_id, decrease_percent FROM holds""",
    "bad_products": """SELECT * REPLACE (CASE WHEN product_id % 50 = 0 THEN 'nameless' ELSE product_name END AS product_name,
        CASE WHEN product_id % 17 <> 0 THEN lead_time_days END AS lead_time_days) FROM products WHERE is_dough""",
    "bad_parties": "SELECT * FROM parties WHERE party_type = 'i' OR party_id % 7 <> 0",
    "bad_phones": "SELECT * REPLACE (CASE phone_type WHEN 'm' THEN CAST(party_id % 100 AS VARCHAR) ELSE phone_no END AS phone_no) FROM phones",
    "bad_shapes": "SELECT * REPLACE (CASE shape_id WHEN 6 THEN 'shape 5' ELSE shape_name END AS shape_name) FROM shapes WHERE shape_id <> 7",
    "bad_standing": "SELECT * FROM standing_orders WHERE amt >= 10",
    "bad_ingredients": "SELECT * FROM ingredients WHERE ingredient_id % 9 <> 0",
    "bad_zips": "SELECT * FROM zip_codes WHERE zip <> '10003'",
    "bad_special": "SELECT * FROM special_orders UNION ALL SELECT * FROM special_orders WHERE amt = 50",
    "bad_staff": "SELECT * REPLACE (CASE WHEN party_id % 13 <> 0 THEN hire_date END AS hire_date) FROM staff_st",
    "bad_changes": "SELECT * REPLACE (CASE WHEN product_id % 11 <> 0 THEN percent_multiplier END AS percent_multiplier) FROM tmp_chng",
    "bad_doughs": "SELECT product_id AS dough_id, product_name AS dough_name, lead_time_days FROM bad_products",
    "bad_orders": """SELECT CASE day_of_week WHEN 0 THEN 7 ELSE day_of_week END AS day_of_week, customer_id, io AS customer_type,
        product_id AS dough_id, shape_id FROM bad_standing""",
    "arrived": f"""SELECT * REPLACE (CASE WHEN customer_id % 11 = 0 THEN 'x' ELSE io END AS io,
          CASE WHEN product_id % 13 = 1 THEN 0 WHEN product_id % 13 <> 0 THEN amt END AS amt,
          CASE WHEN shape_id = 7 AND customer_id % 3 = 0 THEN 99 ELSE shape_id END AS shape_id), 0 AS seq FROM special_orders WHERE created >= {NOON}
        UNION ALL SELECT *, 1 FROM special_orders WHERE created >= {NOON} AND amt = 50
        UNION ALL SELECT *, 2 FROM special_orders WHERE created < {NOON} AND amt = 49""",
    "judged": f"""SELECT *, concat_ws(' ', CASE WHEN amt <= 0 THEN 'amt_greater_than_0' END, CASE WHEN amt IS NULL THEN 'amt_not_null' END,
          CASE WHEN io = 'x' THEN 'customer_id_io_in_parties' END, CASE WHEN created < {NOON} THEN 'delivery_date_customer_id_product_id_shape_id_created_unique' END,
          CASE WHEN delivery_date >= {DAY} + INTERVAL 6 MONTH THEN 'delivery_date_in_next_6_mons' END,
          CASE WHEN delivery_date < {DAY} THEN 'delivery_date_present_or_future' END,
          CASE WHEN io = 'x' THEN 'io_i_or_o' END, CASE WHEN shape_id = 99 THEN 'shape_id_in_shapes' END) AS reasons FROM arrived""",
    "arranged": """SELECT *, row_number() OVER (PARTITION BY reasons = '', delivery_date, customer_id, product_id, shape_id, created
        ORDER BY seq, amt, io) AS turn FROM judged""",
    "called": """SELECT holder AS party_id, CASE WHEN given IS NULL THEN family ELSE given || ' ' || family END AS name
        FROM (SELECT party_id AS holder, party_name AS family FROM parties)
        FULL JOIN (SELECT party_id AS person, first_name AS given FROM people_st) ON holder = person""",
    "phone_book": f"""SELECT party_id, name, party_type, {PHONE_KIND} AS type, phone_no
        FROM called JOIN phones USING (party_id) JOIN (SELECT party_id, party_type FROM parties) USING (party_id)""",
    "email_list": f"""SELECT party_id, name, {EMAIL_KIND} AS type, email
        FROM called JOIN emails USING (party_id) JOIN (SELECT party_id FROM parties) USING (party_id)""",
    "staff_people": "SELECT * FROM people_st JOIN staff_st USING (party_id, party_type)",
    "mobiles": "SELECT party_id, name AS caller, phone_no AS mobile FROM phone_book WHERE type = 'mobile'",
    "staff_phones": """SELECT CASE WHEN caller IS NULL THEN first_name ELSE caller END AS name,
        strftime(hire_date, '%Y-%m-%d') AS hire_date, is_active, CASE WHEN mobile IS NULL THEN 'none' ELSE mobile END AS mobile
        FROM staff_people LEFT JOIN mobiles USING (party_id)""",
    "staff_addresses": """SELECT party_id, first_name, party_name AS last_name, ssn, is_active,
        strftime(hire_date, '%Y-%m-%d') AS hire_date, street_no, street, city, state, zip
        FROM zip_codes JOIN staff_people USING (zip) JOIN parties USING (party_id, party_type)""",
    "staff_list": """SELECT staff_addresses.*, number AS mobile FROM staff_addresses
        LEFT JOIN (SELECT DISTINCT party_id AS owner, phone_no AS number FROM phone_book) ON owner = party_id""",
    "people_list": "SELECT party_id, first_name, party_name AS last_name FROM parties JOIN people_st USING (party_id)",
    "shape_list": """SELECT product_name AS product, shape_name AS shape, grams
        FROM products JOIN product_shapes USING (product_id) JOIN shapes USING (shape_id)""",
    "ein_list": "SELECT party_name AS name, ein FROM parties JOIN ein_numbs USING (party_id, party_type)",
    # What starts on the planning date leaves on ``leaves``; an order belongs to today if it names that date.
    "starts": f"SELECT *, {DAY} + CAST(lead_time_days AS INTEGER) AS leaves FROM products",
    "starts_v1": f"SELECT *, {DAY} + CAST(lead_time_days AS INTEGER) AS leaves FROM products_v1",
    "special_today": """SELECT special_orders.*, product_name, lead_time_days FROM starts JOIN special_orders
        ON (special_orders.product_id, delivery_date) = (starts.product_id, leaves)""",
    "special_today_v1": """SELECT special_orders.*, product_name, lead_time_days FROM starts_v1 JOIN special_orders
        ON (special_orders.product_id, delivery_date) = (starts_v1.product_id, leaves)""",
    "todays_orders": _orders_of("special_today"),
    "todays_orders_v1": _orders_of("special_today_v1"),
    "active_changes": """SELECT tmp_chng.*, lead_time_days FROM tmp_chng JOIN starts USING (product_id)
        WHERE leaves BETWEEN start_date AND resume_date - 1""",
    "standing_due": f"""SELECT standing_orders.*, product_name, lead_time_days FROM starts JOIN standing_orders USING (product_id)
        WHERE lead_time_days + {DOW} - day_of_week IN (0, 7)""",
    "changed_amounts": f"""SELECT day_of_week, customer_id, product_id, shape_id, product_name,
        CASE WHEN percent_multiplier IS NULL THEN amt ELSE {half_up('amt * percent_multiplier', '100')} END AS amt
        FROM standing_due LEFT JOIN (SELECT day_of_week, customer_id, product_id, shape_id, percent_multiplier FROM active_changes)
        USING (day_of_week, customer_id, product_id, shape_id)""",
    "todays_adjusted_so": """SELECT day_of_week AS dow, customer_id AS cid, product_id AS prid, product_name, shape_id AS sid,
        CAST(amt AS BIGINT) AS amt, grams FROM product_shapes JOIN changed_amounts USING (product_id, shape_id)""",
    "todays_combined": """SELECT dayofweek(delivery_date) AS dow, customer_id AS cid, product_id AS prid, product_name, shape_id AS sid,
        amt, grams FROM product_shapes JOIN special_today USING (product_id, shape_id)
        UNION ALL BY NAME SELECT * FROM todays_adjusted_so""",
    "weights": """SELECT product_id, product_name, CAST(coalesce(g, 0) AS BIGINT) AS batch_weight FROM products
        LEFT JOIN (SELECT prid, sum(amt * grams) AS g FROM todays_combined GROUP BY prid) ON prid = product_id""",
    "holds_today": """SELECT product_id, shape_id, day_of_week, 100 - decrease_percent AS percent_left, product_name, lead_time_days,
        leaves FROM holds JOIN starts_v1 USING (product_id)
        WHERE decrease_percent < 100 AND start_date <= leaves AND resume_date > leaves""",
    "standing_minus_holds": f"""SELECT product_id AS dough_id, party_name AS customer, strftime(leaves, '%Y-%m-%d') AS delivery_date,
        lead_time_days AS lead_time, CAST({half_up('amt * percent_left', '100')} AS BIGINT) AS amt,
        product_name AS dough_name, shape_name, grams
        FROM (SELECT * FROM holds_today WHERE day_of_week = {DOW} + lead_time_days AND day_of_week BETWEEN 1 AND 7)
        JOIN standing_v1 USING (product_id, shape_id, day_of_week)
        JOIN product_shapes USING (product_id, shape_id) JOIN shapes USING (shape_id)
        JOIN (SELECT party_id AS customer_id, party_type AS io, party_name FROM parties) USING (customer_id, io)""",
    "weights_v1": """SELECT product_id, product_name, CAST(coalesce(total, 0) AS BIGINT) AS batch_weight FROM products_v1 LEFT JOIN (
        SELECT product_id, sum(grams) AS total FROM (
          SELECT product_id, amt * grams AS grams FROM todays_orders_v1
          UNION ALL SELECT dough_id, amt * grams FROM standing_minus_holds) GROUP BY product_id) USING (product_id)""",
    "product_info": f"""SELECT product_id, product_name, bakers_percent, ingredient_name AS ingredient, is_flour, {PARTS}
        FROM ingredients JOIN product_ingredients USING (ingredient_id) JOIN products USING (product_id)""",
    "totals": "SELECT product_id, sum(bakers_percent) AS t FROM product_info GROUP BY product_id",
    "unit_costs": f"""SELECT i.ingredient_id, i.ingredient_name, ic.cost, ic.grams,
        CAST({unit_cost('ic.cost', 'ic.grams')} AS BIGINT) AS units
        FROM ingredient_costs ic JOIN ingredients i ON ic.ingredient_id = i.ingredient_id""",
    "cost_list": """SELECT ingredient_id, ingredient_name, CAST(round(cost, 2) AS DOUBLE) AS cost,
        CAST(grams AS DOUBLE) AS grams, units / 100000.0::DOUBLE AS cost_per_g FROM unit_costs""",
    "plain_formula": f"""SELECT product_name AS product, CAST(bakers_percent AS DOUBLE) AS "%", ingredient, {grams_columns('batch_weight')}
        FROM product_info JOIN totals USING (product_id) JOIN weights USING (product_id, product_name)""",
    "cost_units": """SELECT f.*, CAST(f.overall AS HUGEINT) * c.units AS u FROM plain_formula f
        JOIN unit_costs c ON f.ingredient = c.ingredient_name""",
    "formula": """SELECT product, "%", ingredient, overall, sour, poolish, soaker, final,
        CAST(CAST(u AS BIGINT) AS DOUBLE) / 100000 AS cost FROM cost_units""",
    "named_mods": "SELECT * FROM dough_mods WHERE lower(mod_name) LIKE 'mod o%'",
    "mod_totals": """SELECT m.product_id, CAST(m.t + k.t AS DOUBLE) AS total_percent, m.t + k.t AS t
        FROM (SELECT product_id, sum(bakers_percent) AS t FROM dough_mods GROUP BY 1) m
        JOIN (SELECT product_id, sum(bakers_percent) AS t FROM product_ingredients di WHERE NOT EXISTS (
          SELECT 1 FROM named_mods n WHERE n.product_id = di.product_id AND n.ingredient_id = di.ingredient_id)
          GROUP BY 1) k ON m.product_id = k.product_id""",
    "modded_recipe": f"""SELECT r.ingredient_id, product_id, product_name, bakers_percent, {PARTS},
        i.ingredient_name AS ingredient, i.is_flour FROM (
          SELECT product_id, ingredient_id, bakers_percent, {PARTS} FROM named_mods
          UNION ALL SELECT product_id, ingredient_id, bakers_percent, {PARTS} FROM product_ingredients
          WHERE ingredient_id NOT IN (SELECT ingredient_id FROM dough_mods)) r
        JOIN products USING (product_id) JOIN ingredients i ON r.ingredient_id = i.ingredient_id""",
    "requests": """SELECT '% ' || n_nationkey || '_' AS get_dough, CASE WHEN n_nationkey % 2 = 0 THEN 'mod o%' ELSE 'MOD _' END AS get_mod
        FROM nation""",
    "asked": """SELECT get_dough, get_mod, product_id, product_name FROM requests JOIN products ON lower(product_name) LIKE lower(get_dough)""",
    "asked_mods": """SELECT a.get_dough, a.get_mod, a.product_name, m.* FROM asked a JOIN dough_mods m USING (product_id)
        WHERE lower(m.mod_name) LIKE lower(a.get_mod)""",
    "asked_totals": """SELECT get_dough, get_mod, product_id, sum(bakers_percent) + (SELECT sum(m.bakers_percent) FROM dough_mods m
          WHERE m.product_id = a.product_id) AS t
        FROM asked a JOIN product_ingredients i USING (product_id) WHERE NOT EXISTS (SELECT 1 FROM asked_mods n
          WHERE n.get_dough = a.get_dough AND n.get_mod = a.get_mod AND n.product_id = i.product_id AND n.ingredient_id = i.ingredient_id)
        GROUP BY get_dough, get_mod, product_id""",
    "asked_lines": f"""SELECT get_dough, get_mod, product_id, product_name, ingredient_id, bakers_percent, {PARTS} FROM asked_mods
        UNION ALL SELECT get_dough, get_mod, product_id, product_name, ingredient_id, bakers_percent, {PARTS}
        FROM asked JOIN product_ingredients USING (product_id) WHERE ingredient_id NOT IN (SELECT ingredient_id FROM dough_mods)""",
    "costs_after": """SELECT * REPLACE (CASE WHEN cost < 500 THEN grams * 2 ELSE grams END AS grams) FROM (
        SELECT * REPLACE (CAST(CASE WHEN grams >= 200 THEN cost + 0.80 ELSE cost END AS DECIMAL(10,5)) AS cost)
        FROM ingredient_costs)""",
    "cost_log": f"""SELECT o.ingredient_id, o.maker_id, o.mio, o.seller_id, o.sio, o.cost AS old_cost, n.cost AS new_cost,
        o.grams AS old_grams, n.grams AS new_grams, {CHANGED} AS change_time FROM ingredient_costs o JOIN costs_after n
        ON o.ingredient_id = n.ingredient_id AND o.maker_id = n.maker_id AND o.seller_id = n.seller_id
        WHERE o.cost <> n.cost OR o.grams <> n.grams""",
    "recipe_log": f"""SELECT * FROM (SELECT product_id, CAST(percent_in_sour AS DOUBLE) AS percent_in_sour,
        CAST(percent_in_poolish AS DOUBLE) AS percent_in_poolish, CAST(percent_in_soaker AS DOUBLE) AS percent_in_soaker,
        ingredient_id AS old_ingredient_id,
        CASE WHEN percent_in_soaker = 2 THEN ingredient_id + 1 ELSE ingredient_id END AS new_ingredient_id,
        CAST(bakers_percent AS DOUBLE) AS old_bakers_percent,
        CAST(CASE WHEN bakers_percent > 45 THEN bakers_percent - 1 ELSE bakers_percent END AS DOUBLE) AS new_bakers_percent,
        '{AS_OF.isoformat()} 12:00:00' AS created, '{AS_OF.isoformat()} 12:00:00' AS modified FROM product_ingredients)
        WHERE old_ingredient_id <> new_ingredient_id OR old_bakers_percent <> new_bakers_percent""",
    "cost_history": f"""SELECT party_name AS maker, ingredient_name AS item, CAST(round(old_cost, 2) AS DOUBLE) AS old_cost,
        CAST(round(new_cost, 2) AS DOUBLE) AS new_cost,
        CAST({unit_cost('old_cost', 'old_grams')} AS BIGINT) / 100000.0::DOUBLE AS old_cost_per_g,
        CAST({unit_cost('new_cost', 'new_grams')} AS BIGINT) / 100000.0::DOUBLE AS new_cost_per_g,
        CAST(new_grams AS DOUBLE) AS new_grams, '{AS_OF.isoformat()} 12:00:00' AS change_time
        FROM ingredients JOIN cost_log USING (ingredient_id) JOIN (SELECT party_id AS maker_id, party_name FROM parties) USING (maker_id)""",
    "standing_log": f"""SELECT * FROM (SELECT customer_id, io, product_id, shape_id, amt AS old_amt,
        CASE WHEN amt > 45 THEN amt * 2 ELSE amt END AS new_amt, day_of_week AS old_day_of_week,
        CASE WHEN day_of_week = 0 THEN 6 ELSE day_of_week END AS new_day_of_week, '{AS_OF.isoformat()} 12:00:00' AS change_time
        FROM standing_orders) WHERE old_amt <> new_amt OR old_day_of_week <> new_day_of_week""",
    "standing_history": """SELECT party_name, product_name, shape_name, dow_names AS day_of_week, old_amt, new_amt, change_time
        FROM (SELECT *, old_day_of_week AS dow_id, customer_id AS party_id, io AS party_type FROM standing_log)
        JOIN days_of_week USING (dow_id) JOIN shapes USING (shape_id) JOIN products USING (product_id)
        JOIN parties USING (party_id, party_type)""",
}

RECIPE_OUT = ", ".join(f"CAST({c} AS DOUBLE) AS {c}" for c in ["bakers_percent", *PARTS.split(", ")])
SNAPSHOT_COLUMNS = "ingredient_id, maker_id, mio, seller_id, sio"


def _union_counts(names: dict[str, str]) -> str:
    return " UNION ALL ".join(f"SELECT '{name}' AS name, count(*) AS n_rows FROM {table}" for name, table in names.items())


_SOURCES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events"]
_BOUND = [
    "parties", "people_st", "zip_codes", "staff_st", "organization_st", "ein_numbs", "phones", "emails", "ingredients",
    "ingredient_costs", "products", "product_instructions", "shapes", "product_shapes", "product_ingredients", "dough_mods",
    "special_orders", "days_of_week", "standing_orders", "tmp_chng", "holds",
]
_VIEWS = [
    "phone_book", "staff_phones", "email_list", "staff_list", "people_list", "shape_list", "ein_list", "todays_orders",
    "todays_adjusted_so", "product_info", "cost_list",
]


def _checks() -> str:
    """One branch per table and rule."""
    last = f"({DAY} + INTERVAL 6 MONTH)"
    dow = "day_of_week IN (0, 1, 2, 3, 4, 5, 6)"
    standing_key = "day_of_week || '|' || customer_id || '|' || product_id || '|' || shape_id"
    special_key = "delivery_date || '|' || customer_id || '|' || product_id || '|' || shape_id || '|' || created"
    change_key = standing_key + " || '|' || start_date"
    part_rules = [
        (f"percent_in_{p}_{kind}", f"percent_in_{p} {test}", f"percent_in_{p}")
        for p in ("sour", "poolish", "soaker")
        for kind, test in (("positive", ">= 0"), ("max_100", "<= 100"))
    ]
    recipe = [("bp_positive", "bakers_percent > 0", "bakers_percent"), *part_rules]
    person, organization = ("party_type_is_i", "party_type IN ('i')", "party_type"), ("party_type_is_o", "party_type IN ('o')", "party_type")
    io = ("io_i_or_o", "io IN ('i', 'o')", "io")
    amt = ("amt_greater_than_0", "amt > 0", "amt")
    tables = {
        "parties": ("party_id || '|' || party_type", [("party_type_i_or_o", "party_type IN ('i', 'o')", "party_type")]),
        "people_st": ("party_id", [person]),
        "zip_codes": ("zip", [("zip_length_5", "length(zip) = 5", "zip"), ("st_length_2", "length(state) = 2", "state")]),
        "staff_st": ("party_id", [
            ("hire_date_after_1970", "hire_date > DATE '1970-01-01'", "hire_date"),
            ("hire_date_within_next_mon", f"hire_date < {DAY} + INTERVAL 1 MONTH", "hire_date"),
            ("ssn_length_11", "length(ssn) <= 11", "ssn"), ("zip_length_5", "length(zip) = 5", "zip"), person]),
        "organization_st": ("party_id", [organization, ("check_org_in_list", "org_type IN ('b', 'c', 'n', 'g')", "org_type")]),
        "ein_numbs": ("ein", [organization]),
        "phones": ("party_id || '|' || phone_type",
                   [("phone_type_from_list", "phone_type IN ('w', 'h', 'f', 'b', 'm', 'e')", "phone_type")]),
        "emails": ("party_id || '|' || email_type", [("email_type_from_list", "email_type IN ('w', 'b', 'p')", "email_type")]),
        "ingredient_costs": ("ingredient_id || '|' || maker_id || '|' || seller_id",
                             [("mio_i_or_o", "mio IN ('i', 'o')", "mio"), ("sio_i_or_o", "sio IN ('i', 'o')", "sio")]),
        "products": ("product_id", [("lead_time_not_negative", "lead_time_days >= 0", "lead_time_days"),
                                    ("lead_time_less_than_8", "lead_time_days < 8", "lead_time_days")]),
        "product_instructions": ("product_id || '|' || sequence || '|' || directions",
                                 [("sequence_positive", "sequence >= 0", "sequence")]),
        "product_shapes": ("product_id || '|' || shape_id", [("grams_greater_than_0", "grams > 0", "grams"),
                                                             ("grams_less_than_3000", "grams < 3000", "grams")]),
        "product_ingredients": ("product_id || '|' || ingredient_id", recipe),
        "dough_mods": ("mod_name || '|' || product_id || '|' || ingredient_id", recipe),
        "special_orders": (special_key, [
            io, ("delivery_date_present_or_future", f"delivery_date >= {DAY}", "delivery_date"),
            ("delivery_date_in_next_6_mons", f"delivery_date < {last}", "delivery_date"), amt]),
        "days_of_week": ("dow_id", [
            ("dow_id_between_0_and_6", "dow_id >= 0 AND dow_id <= 6", "dow_id"),
            ("dow_names_3_letter_abr", "dow_names IN ('Mon', 'Tue', 'Wed', 'Thu', 'Fri', 'Sat', 'Sun')", "dow_names")]),
        "standing_orders": (standing_key, [("dow_in_0_thru_6", dow, "day_of_week"), io, amt]),
        "tmp_chng": (change_key, [
            ("dow_in_0_thru_6", dow, "day_of_week"),
            ("start_date_in_next_6_mos", f"start_date >= {DAY} AND start_date < {last}", "start_date"),
            ("resume_in_next_6_mos", f"resume_date >= {DAY} AND resume_date < {last}", "resume_date"),
            ("resume_after_start", "resume_date > start_date", "resume_date"),
            ("multiplier_not_negative", "percent_multiplier >= 0", "percent_multiplier")]),
    }
    logs = {
        "cost_change_log": ("cost_log", "ingredient_id || '|' || maker_id || '|' || seller_id || '|' || change_time", tables["ingredient_costs"][1]),
        "standing_change_log": (
            "standing_log",
            "new_day_of_week || '|' || customer_id || '|' || product_id || '|' || shape_id || '|' || change_time",
            [("dow_in_0_thru_6", "new_day_of_week IN (0, 1, 2, 3, 4, 5, 6)", "new_day_of_week"), io]),
        "product_ingredients_changes": ("recipe_log", "product_id || '|' || new_ingredient_id || '|' || created", 
                                        [("bp_positive", "new_bakers_percent > 0", "new_bakers_percent"), *part_rules]),
    }
    return " UNION ALL ".join(
        f"SELECT {generation} AS generation, '{name}' AS table_name, '{rule}' AS rule, CAST({key} AS VARCHAR) AS key, "
        f"CAST({value} AS VARCHAR) AS value FROM {source} WHERE NOT ({condition})"
        for generation, name, (source, key, rules) in [
            *((2, name, checks) for name, checks in ({name: (name, *rest) for name, rest in tables.items()} | logs).items()),
            *((1, name, (_FIRST[name], _joined(declared.key), [(r.name, r.condition, r.value) for r in declared.rules]))
              for name, declared in TABLES_V1.items()),
        ]
        for rule, condition, value in rules
    )


def _joined(columns: tuple[str, ...]) -> str:
    return " || '|' || ".join(f"CAST({c} AS VARCHAR)" for c in columns)


# Expressions that stand for a declared table: in the current generation, in the first, and with faults put in.
_CURRENT = {name: name for name in TABLES} | {
    "cost_change_log": "cost_log", "standing_change_log": "standing_log", "product_ingredients_changes": "recipe_log",
}
_FIRST = {name: name for name in TABLES_V1} | {
    "doughs": "doughs_v1", "dough_shapes": "dough_shapes_v1", "dough_ingredients": "dough_ingredients_v1", "special_orders": "special_v1",
    "days_of_week": "days_v1", "standing_orders": "orders_v1", "holds": "holds_v1",
}
_FLAWED = {
    "products": "bad_products", "parties": "bad_parties", "phones": "bad_phones", "shapes": "bad_shapes", "standing_orders": "bad_standing",
    "ingredients": "bad_ingredients", "zip_codes": "bad_zips", "special_orders": "bad_special", "staff_st": "bad_staff", "tmp_chng": "bad_changes",
    "doughs_v1": "bad_doughs", "orders_v1": "bad_orders",
}
# Columns that the bound tables lack.
_ABSENT = {"created", "modified", "change_time"}


def _declared() -> list[tuple[int, str, Table, dict[str, str]]]:
    def faulty(names: dict[str, str]) -> dict[str, str]:
        return {name: _FLAWED.get(source, source) for name, source in names.items()}

    return [(2, name, table, faulty(_CURRENT)) for name, table in TABLES.items()] + [
        (1, name, table, faulty(_FIRST)) for name, table in TABLES_V1.items()
    ]


def _missing() -> str:
    return " UNION ALL ".join(
        f"SELECT {generation} AS generation, '{name}' AS table_name, '{column}_not_null' AS rule, {_joined(table.key)} AS key "
        f"FROM {of[name]} WHERE {column} IS NULL"
        for generation, name, table, of in _declared()
        for column in ("hire_date", "lead_time_days", "percent_multiplier", *table.key)
        if column in table.not_null and column not in _ABSENT
    )


def _repeated() -> str:
    return " UNION ALL ".join(
        f"SELECT {generation} AS generation, '{name}' AS table_name, '{'_'.join(columns)}_unique' AS rule, {_joined(columns)} AS key, "
        f"count(*) AS n_rows FROM {of[name]} WHERE {' AND '.join(f'{c} IS NOT NULL' for c in columns)} GROUP BY {', '.join(columns)} HAVING count(*) > 1"
        for generation, name, table, of in _declared()
        for columns in [table.key, *table.unique]
        if columns
    )


def _unreferred() -> str:
    return " UNION ALL ".join(
        f"SELECT {generation} AS generation, '{name}' AS table_name, '{'_'.join(r.columns)}_in_{r.parent}' AS rule, {_joined(r.columns)} AS key, "
        f"count(*) AS n_rows FROM {of[name]} c WHERE {' AND '.join(f'{x} IS NOT NULL' for x in r.columns)} AND NOT EXISTS (SELECT 1 FROM {of[r.parent]} p "
        f"WHERE {' AND '.join(f'p.{y} = c.{x}' for x, y in zip(r.columns, r.parent_columns, strict=True))}) GROUP BY {', '.join(r.columns)}"
        for generation, name, table, of in _declared()
        for r in table.references
    )


def _lookups() -> str:
    patterns = {
        "pid": ("SELECT '%' || lpad(CAST(n_nationkey AS VARCHAR), 3, '0') AS pattern FROM nation",
                "SELECT party_id AS id, party_name AS name FROM parties"),
        "prid": ("SELECT upper(p_name) || ' 1%' AS pattern FROM part", "SELECT product_id AS id, product_name AS name FROM products"),
        "iid": ("SELECT 'Supplier#%' || n_nationkey AS pattern FROM nation",
                "SELECT ingredient_id AS id, ingredient_name AS name FROM ingredients"),
        "sid": ("SELECT repeat('_', r_regionkey + 5) || '%' AS pattern FROM region UNION ALL SELECT upper(shape_name) FROM shapes",
                "SELECT shape_id AS id, shape_name AS name FROM shapes"),
    }
    return " UNION ALL ".join(
        f"SELECT '{kind}' AS kind, pattern, CAST(min(id) AS BIGINT) AS id, count(id) AS hits FROM (SELECT DISTINCT pattern "
        f"FROM ({wanted})) LEFT JOIN ({dim}) ON lower(name) LIKE lower(pattern) GROUP BY pattern"
        for kind, (wanted, dim) in patterns.items()
    )


ORACLE = {
    "src_tables": _union_counts(
        {n: n for n in [*_SOURCES, *_BOUND]} | {"standing_orders_v1": "standing_v1", "days_of_week_v1": "days_of_week", "products_v1": "products_v1"}
    ),
    "src_views": _union_counts(
        {n: n for n in _VIEWS}
        | {"todays_combined_spec_standing": "todays_combined", "total_bp": "totals"}
        | {"cost_change_list": "cost_history", "standing_change_history": "standing_history"}
    ),
    "snk_append": f"""SELECT CAST(delivery_date AS VARCHAR) AS delivery_date, customer_id, io, product_id, shape_id, amt,
        CASE WHEN created < {NOON} THEN CAST(created AS VARCHAR) ELSE '{AS_OF.isoformat()} 12:00:00' END AS created,
        CASE WHEN created >= {NOON} THEN '{AS_OF.isoformat()} 12:00:00' END AS modified FROM special_orders""",
    "snk_checked_append": """SELECT CAST(delivery_date AS VARCHAR) AS delivery_date, customer_id, io, product_id, shape_id, CAST(amt AS BIGINT) AS amt,
        CAST(created AS VARCHAR) AS created, CASE WHEN reasons = '' AND turn > 1
          THEN 'delivery_date_customer_id_product_id_shape_id_created_unique' ELSE reasons END AS reasons FROM arranged""",
    "snk_defaults": f"""SELECT product_id, ingredient_id, CAST(bakers_percent AS VARCHAR) AS bakers_percent,
        CAST(percent_in_sour AS VARCHAR) AS percent_in_sour, CAST(percent_in_poolish AS VARCHAR) AS percent_in_poolish,
        CAST(CAST(0 AS DECIMAL(18,6)) AS VARCHAR) AS percent_in_soaker, '{AS_OF.isoformat()} 12:00:00' AS created,
        '{AS_OF.isoformat()} 12:00:00' AS modified FROM product_ingredients""",
    "snk_resolve_append": """SELECT CAST(delivery_date AS VARCHAR) AS delivery_date, customer_id,
        CASE WHEN is_dough THEN product_id END AS product_id, shape_id, amt,
        CASE WHEN is_dough THEN 'accepted' ELSE 'rejected' END AS outcome FROM special_orders JOIN products USING (product_id)""",
    "snk_update": f"""SELECT party_id, phone_type, CASE WHEN phone_type = 'm' THEN '+1 ' || phone_no ELSE phone_no END AS phone_no,
        CAST(created AS VARCHAR) AS created,
        CAST(CASE WHEN phone_type = 'm' THEN {NOON} ELSE modified END AS VARCHAR) AS modified FROM phones""",
    "touch_modified": f"""SELECT 'phones' AS table_name, party_id, phone_no AS value,
        CAST(CASE WHEN phone_type = 'w' THEN {NOON} ELSE modified END AS VARCHAR) AS modified FROM phones
        UNION ALL SELECT 'emails', party_id, CASE WHEN email_type = 'w' THEN upper(email) ELSE email END, NULL FROM emails""",
    "snk_upsert": f"""SELECT {SNAPSHOT_COLUMNS}, CAST(coalesce(u.c, s.cost) AS DOUBLE) AS cost, CAST(grams AS DOUBLE) AS grams,
        CASE WHEN u.c IS NOT NULL THEN '{AS_OF.isoformat()} 12:00:00' END AS modified FROM ingredient_costs s LEFT JOIN (
        SELECT l_suppkey, CAST(arg_max(l_extendedprice / 10, (l_orderkey, l_linenumber)) AS DECIMAL(10,5)) AS c
        FROM lineitem WHERE l_quantity = 50 GROUP BY 1) u ON s.ingredient_id = u.l_suppkey""",
    "proj_code_label": f"SELECT party_id, {PHONE_KIND} AS type FROM phones UNION ALL SELECT party_id, {EMAIL_KIND} FROM emails",
    "proj_full_name": "SELECT * FROM called",
    "proj_alias": 'SELECT product_id, ingredient_id, CAST(bakers_percent AS DOUBLE) AS "%" FROM product_ingredients',
    "proj_saved_lists": "SELECT * FROM staff_list",
    "flt_equal": "SELECT * FROM phone_book WHERE type = 'mobile'",
    "flt_in_list": "SELECT * FROM organization_st WHERE org_type IN ('b', 'n', 'g')",
    "flt_like_ci": "SELECT * FROM products WHERE lower(product_name) LIKE lower('RED%')",
    "flt_due_today": """SELECT product_id, strftime(delivery_date, '%Y-%m-%d') AS delivery_date, lead_time_days, customer_id, shape_id,
        amt FROM special_today""",
    "flt_active_range": """SELECT * REPLACE (CAST(start_date AS VARCHAR) AS start_date, CAST(resume_date AS VARCHAR) AS resume_date,
        CAST(percent_multiplier AS DOUBLE) AS percent_multiplier) FROM active_changes""",
    "flt_weekday_wrap": "SELECT day_of_week, lead_time_days, customer_id, product_id, shape_id, amt FROM standing_due",
    "flt_weekday_nowrap": f"""SELECT day_of_week, lead_time_days, customer_id, product_id, shape_id, amt
        FROM products_v1 JOIN standing_v1 USING (product_id) WHERE day_of_week - lead_time_days = {DOW}""",
    "flt_recent": f"""SELECT party_id, phone_type, CAST(modified AS VARCHAR) AS modified FROM phones
        WHERE {NOON} - modified < INTERVAL 90 DAY""",
    "join_inner_single": "SELECT * FROM people_list",
    "join_inner_composite": """SELECT CAST(delivery_date AS VARCHAR) AS delivery_date, party_name, product_id, shape_id, amt
        FROM special_orders JOIN parties ON customer_id = party_id AND io = party_type""",
    "join_full_outer": """SELECT party_id, name FROM called UNION ALL SELECT NULL, NULL""",
    "join_full_reduced": "SELECT party_id, city, mobile FROM staff_list",
    "join_left": "SELECT * FROM staff_phones",
    "join_left_nullrejected": "SELECT dough_id, customer, amt FROM standing_minus_holds",
    "join_name": """SELECT product_name, ingredient, cost_per_g FROM product_info
        JOIN cost_list ON ingredient = ingredient_name""",
    "join_anti_scoped": """SELECT product_id, ingredient_id FROM product_ingredients WHERE (product_id, ingredient_id) NOT IN (
        SELECT (product_id, ingredient_id) FROM dough_mods WHERE lower(mod_name) LIKE 'mod o')""",
    "join_anti_global": """SELECT product_id, ingredient_id FROM product_ingredients
        WHERE ingredient_id NOT IN (SELECT ingredient_id FROM dough_mods)""",
    "join_semi": """SELECT ingredient_name AS ingredient, cost, grams, cost_per_g FROM cost_list
        WHERE ingredient_name IN (SELECT ingredient FROM formula)""",
    "join_self_pk": f"SELECT party_id, {EMAIL_KIND} AS type, email FROM emails",
    "agg_order_summary": """SELECT product_id AS dough_id, product_name AS dough_name,
        CAST(sum(amt * grams) AS BIGINT) AS total_grams FROM todays_orders_v1 GROUP BY 1, 2""",
    "agg_batch_weight": "SELECT * FROM weights",
    "agg_batch_weight_two_part": "SELECT product_id AS dough_id, product_name AS dough_name, batch_weight FROM weights_v1",
    "agg_mod_total": "SELECT product_id, total_percent FROM mod_totals",
    "agg_formula_cost": "SELECT product, CAST(CAST(sum(u) AS BIGINT) AS DOUBLE) / 100000 AS cost FROM cost_units GROUP BY product",
    "agg_cost_per_gram": f"""SELECT product, g AS grams, CAST(c AS DOUBLE) / 100000 AS cost,
        CASE WHEN g > 0 THEN CAST({half_up('c', 'g * 100000', 4)} AS BIGINT) / 10000.0::DOUBLE END AS cost_per_gram FROM (
        SELECT product, CAST(sum(overall) AS BIGINT) AS g, CAST(sum(u) AS BIGINT) AS c FROM cost_units GROUP BY product)""",
    "agg_distinct": "SELECT DISTINCT street, zip, is_active FROM staff_st",
    "win_total_bp": """SELECT DISTINCT product_name, CAST(sum(bakers_percent) OVER (PARTITION BY product_name) AS DOUBLE) AS total_bp
        FROM product_info""",
    "win_bak_per": """SELECT DISTINCT product_id, CAST(sum(bakers_percent) OVER (PARTITION BY product_id) AS DOUBLE)
        AS total_percent FROM product_info""",
    "sort_phone_book": "SELECT * FROM phone_book ORDER BY party_id, type",
    "sort_recipe": f"""SELECT product_id, product_name, ingredient, is_flour, {RECIPE_OUT} FROM product_info
        ORDER BY product_id, is_flour DESC, bakers_percent DESC""",
    "sort_unit_cost": "SELECT * FROM cost_list ORDER BY cost_per_g DESC",
    "sort_summary": """SELECT product_id AS dough_id, product_name AS dough_name,
        CAST(sum(amt * grams) AS BIGINT) AS total_grams FROM todays_orders_v1 GROUP BY 1, 2 ORDER BY 1""",
    "sort_instructions": """SELECT product_id, product_name, sequence, directions FROM product_instructions
        JOIN products USING (product_id) WHERE lower(product_name) LIKE '%widget%' ORDER BY product_id, sequence""",
    "union_orders": "SELECT dow, prid, amt FROM todays_combined",
    "union_modded_recipe": f"""SELECT product_id, product_name, ingredient_id, ingredient, is_flour, {RECIPE_OUT}
        FROM modded_recipe""",
    "fn_percent_change": f"""SELECT o.ingredient_id, CAST({half_up(f'({whole("n.cost", 5)} - {whole("o.cost", 5)}) * 100',
        whole("o.cost", 5), 3)} AS BIGINT) / 1000.0::DOUBLE AS percent
        FROM ingredient_costs o JOIN costs_after n ON o.ingredient_id = n.ingredient_id""",
    "fn_scalars": f"""SELECT s.party_id, length(s.ssn) AS ssn_length, s.street_no || ' ' || s.street AS address,
        coalesce(p.phone_no, 'none') AS mobile, lower(s.street) AS lowered, dayofweek(s.hire_date) AS dow,
        CAST(s.hire_date + 2 AS VARCHAR) AS two_days_on, CAST(s.hire_date - 2 AS VARCHAR) AS two_days_back,
        CAST(CAST(s.hire_date + INTERVAL 6 MONTH AS DATE) AS VARCHAR) AS six_months_on,
        CAST(round(c.cost, 1) AS DOUBLE) AS rounded,
        CAST({unit_cost('c.cost', 'c.grams')} AS BIGINT) / 100000.0::DOUBLE AS per_gram
        FROM staff_st s LEFT JOIN (SELECT * FROM phones WHERE phone_type = 'm') p ON s.party_id = p.party_id
        LEFT JOIN ingredient_costs c ON s.party_id = c.seller_id""",
    "phone_book": "SELECT * FROM phone_book",
    "staff_phones": "SELECT * FROM staff_phones",
    "email_list": "SELECT * FROM email_list",
    "staff_list": "SELECT * FROM staff_list",
    "people_list": "SELECT * FROM people_list",
    "shape_list": "SELECT * FROM shape_list",
    "ein_list": "SELECT * FROM ein_list",
    "todays_orders": "SELECT * FROM todays_orders",
    "todays_adjusted_so": "SELECT * FROM todays_adjusted_so",
    "todays_combined_spec_standing": "SELECT * FROM todays_combined",
    "product_info": f"SELECT product_id, product_name, ingredient, is_flour, {RECIPE_OUT} FROM product_info",
    "cost_list": "SELECT * FROM cost_list",
    "cost_change_list": "SELECT * FROM cost_history",
    "standing_change_history": "SELECT * FROM standing_history",
    "sql_scalar_functions": """SELECT
        (SELECT CAST(coalesce(sum(batch_weight), 0) AS BIGINT) FROM weights WHERE lower(product_name) LIKE 'red%') AS weight,
        (SELECT CAST(min(t) AS DOUBLE) FROM totals JOIN products USING (product_id) WHERE lower(product_name) LIKE 'red%') AS percent,
        (SELECT min(party_id) FROM parties WHERE party_name LIKE '%#%7') AS party,
        (SELECT min(product_id) FROM products WHERE product_name LIKE '% 1_') AS product,
        (SELECT min(ingredient_id) FROM ingredients WHERE ingredient_name LIKE 'Supplier%') AS ingredient,
        (SELECT min(shape_id) FROM shapes WHERE shape_name LIKE 'shape _') AS shape,
        (SELECT min(total_percent) FROM mod_totals JOIN products USING (product_id) WHERE lower(product_name) LIKE 'red%') AS modded,
        CAST(NULL AS BIGINT) AS nobody, 15.4::DOUBLE AS up, -20.962::DOUBLE AS down""",
    "sql_table_functions": f"""SELECT product AS name, ingredient AS detail, CAST(overall AS VARCHAR) AS value FROM formula
        WHERE lower(product) LIKE 'red%' UNION ALL
        SELECT product_name, ingredient, CAST(CAST({share('batch_weight')} AS BIGINT) AS VARCHAR) FROM modded_recipe
        LEFT JOIN mod_totals USING (product_id) JOIN weights USING (product_id, product_name) WHERE lower(product_name) LIKE 'red%' UNION ALL
        SELECT name, type, phone_no FROM phone_book WHERE lower(name) LIKE '%supplier#%7'""",
    "sql_requests": f"""SELECT get_dough, get_mod, product_name AS dough, CAST(bakers_percent AS DOUBLE) AS "%", ingredient_name AS ingredient,
        {grams_columns('batch_weight')} FROM asked_lines LEFT JOIN asked_totals USING (get_dough, get_mod, product_id)
        JOIN weights USING (product_id, product_name) JOIN ingredients USING (ingredient_id)""",
    "phone_search": """SELECT name, type AS phone_type, phone_no FROM phone_book
        WHERE lower(name) LIKE lower('%SUPPLIER#%7')""",
    "staff_list_v1": "SELECT staff_addresses.*, mobile FROM mobiles JOIN staff_addresses USING (party_id)",
    "ingredient_list": """SELECT ingredient_id, ingredient_name AS ingredient, party_name AS manufacturer FROM ingredients
        JOIN (SELECT party_id AS manufacturer_id, party_type AS manufacturer_type, party_name FROM parties)
        USING (manufacturer_id, manufacturer_type)""",
    "standing_minus_holds": "SELECT * FROM standing_minus_holds",
    "formula": "SELECT * FROM formula",
    "formula_v1": f"""SELECT product_name AS dough, CAST(bakers_percent AS DOUBLE) AS "%", ingredient, {grams_columns('batch_weight')}
        FROM product_info JOIN totals USING (product_id) JOIN weights_v1 USING (product_id, product_name)""",
    "modded_formula": f"""SELECT product_name AS dough, CAST(bakers_percent AS DOUBLE) AS "%", ingredient,
        {grams_columns('batch_weight')} FROM modded_recipe LEFT JOIN mod_totals USING (product_id)
        JOIN weights USING (product_id, product_name)""",
    "lookup_id": _lookups(),
    "cdc_cost": f"""SELECT {SNAPSHOT_COLUMNS}, CAST(old_cost AS DOUBLE) AS old_cost, CAST(new_cost AS DOUBLE) AS new_cost,
        CAST(old_grams AS DOUBLE) AS old_grams, CAST(new_grams AS DOUBLE) AS new_grams,
        '{AS_OF.isoformat()} 12:00:00' AS change_time FROM cost_log""",
    "cdc_recipe": "SELECT * FROM recipe_log",
    "cdc_standing": "SELECT * FROM standing_log",
    "cdc_feed": """SELECT user_id, event_type, CAST(ts AS VARCHAR) AS ts, event_id, old_value, new_value FROM (
        SELECT *, lag(value) OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) AS old_value, value AS new_value
        FROM events) WHERE old_value <> new_value""",
    "dq_check": _checks(),
    "dq_not_null": _missing(),
    "dq_unique": _repeated(),
    "dq_foreign_key": _unreferred(),
}
HORIZON_ROWS = f"""WITH d AS (SELECT {DAY} + CAST(n AS INTEGER) AS day FROM range(14) r(n)),
    started AS (
      SELECT delivery_date - CAST(lead_time_days AS INTEGER) AS day, product_id, shape_id, amt FROM special_orders JOIN products USING (product_id)
      UNION ALL SELECT d.day, so.product_id, so.shape_id, CASE WHEN percent_multiplier IS NULL THEN so.amt
        ELSE {half_up('so.amt * percent_multiplier', '100')} END
      FROM standing_orders so JOIN products p ON so.product_id = p.product_id
      JOIN d ON p.lead_time_days + dayofweek(d.day) - so.day_of_week IN (0, 7)
      LEFT JOIN tmp_chng c ON (c.day_of_week, c.customer_id, c.product_id, c.shape_id)
          = (so.day_of_week, so.customer_id, so.product_id, so.shape_id)
        AND d.day + CAST(p.lead_time_days AS INTEGER) >= c.start_date AND d.day + CAST(p.lead_time_days AS INTEGER) < c.resume_date),
    grams AS (SELECT day, product_id, sum(amt * grams) AS g FROM started JOIN product_shapes USING (product_id, shape_id) GROUP BY ALL)
    SELECT d.day, p.product_id, CAST(coalesce(g, 0) AS BIGINT) AS batch_weight
    FROM products p CROSS JOIN d LEFT JOIN grams ON grams.day = d.day AND grams.product_id = p.product_id"""
ORACLE["horizon_weights"] = f"SELECT CAST(day AS VARCHAR) AS planning_day, product_id, batch_weight FROM ({HORIZON_ROWS})"
ORACLE["horizon_formula"] = f"""SELECT CAST(day AS VARCHAR) AS planning_day, product_name AS product, CAST(bakers_percent AS DOUBLE) AS "%",
    ingredient, {grams_columns('batch_weight')} FROM product_info JOIN totals USING (product_id)
    JOIN ({HORIZON_ROWS}) AS planned USING (product_id)"""
ORACLE["snk_uuid"] = """SELECT party_type, party_name, substr(h, 1, 8) || '-' || substr(h, 9, 4) || '-8' || substr(h, 14, 3) || '-'
    || translate(substr(h, 17, 1), '0123456789abcdef', '89ab89ab89ab89ab') || substr(h, 18, 3) || '-' || substr(h, 21, 12) AS party_id
    FROM (SELECT *, sha256('parties/1:' || party_type || length(party_name) || ':' || party_name) AS h FROM parties)"""
ORACLE["snk_identity"] = f"""SELECT batch, n AS n_rows, n AS n_ids, before + 1 AS least, before + n AS greatest FROM (
    SELECT CASE WHEN created < {NOON} THEN 'known' ELSE 'added' END AS batch, count(*) AS n,
      CASE WHEN min(created) < {NOON} THEN 0 ELSE (SELECT count(*) FROM special_orders WHERE created < {NOON}) END AS before
    FROM special_orders GROUP BY 1)"""
ORACLE["snk_folder_update"] = """SELECT CASE WHEN day_of_week = 0 AND amt > 25 THEN 6 ELSE day_of_week END AS day_of_week, customer_id,
    product_id, shape_id, CASE WHEN day_of_week = 0 AND amt > 25 THEN amt // 2 ELSE amt END AS amt FROM standing_orders"""
ORACLE["cdc_stream"] = ORACLE["cdc_feed"]


def _needed(sql: str) -> list[str]:
    """Names of the expressions a statement uses, in the order of definition."""
    found: set[str] = set()
    todo = [sql]
    while todo:
        for name in set(re.findall(r"(?:FROM|JOIN)\s+(\w+)", todo.pop())) & CTES.keys() - found:
            found.add(name)
            todo.append(CTES[name])
    order: list[str] = []

    def place(name: str) -> None:
        for used in re.findall(r"(?:FROM|JOIN)\s+(\w+)", CTES[name]):
            if used in CTES and used not in order:
                place(used)
        if name not in order:
            order.append(name)

    for name in CTES:
        if name in found:
            place(name)
    return order


def statement(name: str) -> str:
    """The complete statement of a query."""
    body = ORACLE[name]
    needed = _needed(body)
    if not needed:
        return body
    return "WITH " + ",\n".join(f"{n} AS ({CTES[n]})" for n in needed) + "\n" + body
