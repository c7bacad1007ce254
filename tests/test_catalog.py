"""Every query against its SQL on the smallest driver tables, and the shape of its plan."""

from __future__ import annotations

import os
import re

import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as contract
from check import rows_of
from ovenplan.plans.catalog import CATALOG
from ovenplan.plans.oracle import ORACLE, statement

FOLDER = "/root/testdata/sf0.001"
TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events"]
QUERIES, SQL = CATALOG, {name: statement(name) for name in ORACLE}
#: Scalar functions meet the one row of their call in a nested loop; both sides have one row.
ONE_ROW = {"sql_scalar_functions"}

pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="driver tables are not here")


@pytest.fixture(scope="module")
def con():
    connection = duckdb.connect()
    for table in TABLES:
        connection.execute(f"CREATE VIEW {table} AS SELECT * FROM '{FOLDER}/{table}.parquet'")
    return connection


def test_every_query_has_sql():
    assert set(QUERIES) == set(SQL)
    assert set(QUERIES) <= set(contract.queries()) and set(SQL) <= set(contract.oracle_sql())


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, con, name):
    df = QUERIES[name](spark, FOLDER)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert not re.search("CartesianProduct|Python", plan)
    assert name in ONE_ROW or "BroadcastNestedLoopJoin" not in plan
    result = con.execute(SQL[name])
    columns = [d[0] for d in result.description]
    assert sorted(columns) == sorted(df.columns)
    assert rows_of(df.collect(), df.columns) == rows_of(result.fetchall(), columns)


def test_entry(spark):
    assert contract.entry(spark).count() > 0


def scans(plan):
    """All file scans of an executed plan, those inside the stages of adaptive execution and its subqueries included."""
    if plan.getClass().getSimpleName().startswith("FileSourceScan"):
        yield plan
    inner = {"AdaptiveSparkPlanExec": "executedPlan", "ShuffleQueryStageExec": "plan", "BroadcastQueryStageExec": "plan", "ResultQueryStageExec": "plan"}
    kind = plan.getClass().getSimpleName()
    below = [getattr(plan, inner[kind])()] if kind in inner else [plan.children().apply(k) for k in range(plan.children().size())]
    for child in below:
        yield from scans(child)


def test_due_orders_read_a_date_window(spark, bakery, tmp_path):
    """The window of delivery dates prunes the folders that the scan reads, though lead times are known only when the plan runs."""
    from ovenplan.operators import demand
    from ovenplan.sources.tables import load_tables, write_table
    from tests.conftest import MONDAY

    days = bakery["special_orders"].select(F.explode(F.sequence(F.lit(-40), F.lit(40))).alias("_day"), "*")
    orders = days.withColumn("delivery_date", F.date_add("delivery_date", "_day")).drop("_day")
    write_table(orders, str(tmp_path), "special_orders")
    stored = load_tables(spark, str(tmp_path), ["special_orders"])["special_orders"]
    due = demand.special_due(stored, bakery["products"], MONDAY)
    execution = due._jdf.queryExecution()
    execution.toRdd().count()
    [scan] = list(scans(execution.executedPlan()))
    read = scan.metrics().apply("numPartitions").value()
    assert 0 < read <= 8 < len(list(tmp_path.glob("special_orders*/delivery_date=*")))


def test_recipe_scan_reads_what_it_needs(spark):
    plan = QUERIES["win_bak_per"](spark, FOLDER)._jdf.queryExecution().executedPlan().toString()
    [lines] = [s for s in re.findall(r"ReadSchema: struct<([^>]*)>", plan) if "l_partkey" in s]
    assert "l_extendedprice" not in lines and "l_shipdate" not in lines
