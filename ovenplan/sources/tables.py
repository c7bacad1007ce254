"""Reading, writing and naming the tables."""

from __future__ import annotations

from collections.abc import Iterable, Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ovenplan.schemas import TABLES, TABLES_V1, V1_COLUMN_NAMES, V1_TABLE_NAMES

# Folder layout of the large facts: each scan of a day or weekday reads its own folders only.
PARTITION_COLUMNS = {
    "special_orders": ["delivery_date"],
    "standing_orders": ["day_of_week"],
    "tmp_chng": ["day_of_week"],
}


def load_tables(
    spark: SparkSession,
    folder: str,
    names: Iterable[str] | None = None,
    generation: int = 2,
    key_type: str | None = None,
) -> dict[str, DataFrame]:
    """The tables below ``folder``, each ``<name>.parquet``, read with its declared schema: no inference job runs."""
    declared = TABLES if generation == 2 else TABLES_V1
    key = key_type or ("string" if generation == 2 else "int")
    return {
        name: spark.read.schema(declared[name].ddl(key)).parquet(f"{folder}/{name}.parquet")
        for name in (names or declared)
    }


def adopt_v1(tables: Mapping[str, DataFrame]) -> dict[str, DataFrame]:
    """First-generation tables under the current table and column names."""
    return {
        V1_TABLE_NAMES.get(name, name): df.withColumnsRenamed(V1_COLUMN_NAMES) for name, df in tables.items()
    }


def write_table(df: DataFrame, folder: str, name: str, mode: str = "append") -> None:
    """Write rows to ``<folder>/<name>.parquet``.

    Partitioned tables are rebalanced on their folder column first: small folders become one file each, and a folder that
    holds a large part of all rows is split over several tasks.
    """
    columns = PARTITION_COLUMNS.get(name, [])
    if columns:
        df = df.hint("rebalance", *[F.col(c) for c in columns])
    df.write.mode(mode).partitionBy(*columns).parquet(f"{folder}/{name}.parquet")


def register(views: Mapping[str, DataFrame]) -> list[str]:
    """Name DataFrames for SQL."""
    for name, df in views.items():
        df.createOrReplaceTempView(name)
    return list(views)
