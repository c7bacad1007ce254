from __future__ import annotations

import datetime as dt
from decimal import Decimal

import pytest

from ovenplan.operators import recipe
from ovenplan.plans.sql_functions import register_functions
from ovenplan.plans.views import VIEWS, register_views
from tests.conftest import MONDAY, make, rows

EMPTY = [
    "people_st",
    "staff_st",
    "zip_codes",
    "emails",
    "ein_numbs",
    "days_of_week",
    "cost_change_log",
    "standing_change_log",
]


REQUESTS = [("KAM%", "cran%"), ("%", "%"), ("kam%", "no%"), ("%", "_%_"), ("pizza dough", "%"), ("none%", "%"), (None, "%"), ("KAM%", "cran%"), ("___%", "%RAN%")]


@pytest.fixture(scope="module")
def sql(spark, bakery):
    phones = make(spark, "phones", [dict(party_id="mill", phone_type="b", phone_no="608-555-0147")])
    tables = {**bakery, "phones": phones, **{name: make(spark, name, []) for name in EMPTY}}
    assert set(register_views(spark, tables, MONDAY)) == set(VIEWS)
    requests = spark.createDataFrame(REQUESTS, "dough string, mod string")
    requests.createOrReplaceTempView("requests")
    register_functions(spark, tables, MONDAY, requests)
    return spark.sql


def test_views_answer_sql(sql):
    for name in VIEWS:
        assert sql(f"SELECT count(*) FROM {name}").first()[0] >= 0
    assert rows(sql("SELECT name, type FROM phone_book")) == [("Cobble Works", "business")]
    assert sql("SELECT total_bp FROM total_bp WHERE product_name = 'pizza dough'").first()[0] == Decimal("169.95")


def test_table_functions(sql):
    lines = sql("""SELECT "%", ingredient, overall FROM formula('KAM%')""")
    assert lines.count() == 5
    [total] = sql("SELECT sum(overall) AS grams, sum(cost) AS cost FROM formula('kam%')").collect()
    assert tuple(total) == (4800, Decimal("18.65621"))
    assert rows(sql("SELECT * FROM phone_search('cobb%')")) == [("Cobble Works", "business", "608-555-0147")]
    used = "SELECT ingredient FROM formula('kam%')"
    listed = sql(f"SELECT ingredient_name FROM cost_list WHERE ingredient_name IN ({used}) ORDER BY cost_per_g DESC")
    assert listed.first()[0] == "kamut flour" and listed.count() == 5


def test_scalar_functions(sql):
    [row] = sql(
        "SELECT get_batch_weight('kam%') AS w, bak_per('kam%') AS b, pid('lark') AS p, prid('PIZ%') AS d, "
        "iid('%salt') AS i, sid('12%') AS s, pid('nobody') AS n, percent_change(6.00, 5.20) AS c, "
        "percent_change(6.00, NULL) AS z"
    ).collect()
    assert tuple(row) == (4800, Decimal("207.20"), "blow", "pizza", "sea salt", "boule", None, Decimal("15.4"), None)


def test_two_patterns_equal_the_python_function(sql, spark, bakery):
    """Each request by the literal function, by the lateral join and by the function of one request."""
    lateral = rows(sql("SELECT r.dough AS a, r.mod AS b, f.* FROM (SELECT DISTINCT * FROM requests) r, LATERAL requested_formula(r.dough, r.mod) f"))
    assert {r[:2] for r in lateral} >= {("KAM%", "cran%"), ("%", "%")} and all(None not in r[:2] for r in lateral)
    for dough, mod in {r for r in REQUESTS if None not in r}:
        wanted = rows(recipe.modded_formula(bakery, MONDAY, dough, mod))
        assert [r[2:] for r in lateral if r[:2] == (dough, mod)] == wanted
        assert rows(sql(f"SELECT * FROM modded_formula('{dough}', '{mod}')")) == wanted
        totals = [r["total_percent"] for r in recipe.mod_total(bakery, dough, mod).collect()]
        assert sql(f"SELECT bak_per2('{dough}', '{mod}')").first()[0] == min(totals, default=None)


def test_lateral_requests_join_by_equality(sql):
    found = sql("SELECT r.*, f.* FROM requests r, LATERAL requested_formula(r.dough, r.mod) f")
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan
