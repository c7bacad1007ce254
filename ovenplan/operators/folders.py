"""Updates of a stored table that write only the folders they touch.

The tables that are laid out by day or weekday are too large to be written anew for a few rows. An update finds the rows it changes,
reads the folders these are in and the folders they move to, and replaces those; files of other folders are neither read whole nor
written.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ovenplan.operators.snapshots import apply_update, apply_updates
from ovenplan.session import shared_folder
from ovenplan.sources.tables import PARTITION_COLUMNS, load_tables, write_table

Change = Callable[[DataFrame], DataFrame]


def _folders(rows: DataFrame, column: str) -> set:
    """The values of a folder column; at most one per folder of the table reaches the driver."""
    return {row[0] for row in rows.select(column).distinct().collect()}


def _within(column: str, values: set) -> Column:
    known = F.col(column).isin([v for v in values if v is not None])
    return known | F.col(column).isNull() if None in values else known


def _rewrite(spark: SparkSession, folder: str, name: str, key_type: str | None, hit: Change, change: Change) -> set:
    (column,) = PARTITION_COLUMNS[name]
    stored = load_tables(spark, folder, [name], key_type=key_type)[name]
    found = hit(stored)
    touched = _folders(found, column) | _folders(change(found), column)
    if not touched:
        return touched
    stage = shared_folder(spark, "folders")
    write_table(change(stored.filter(_within(column, touched))), stage, name)
    staged = load_tables(spark, stage, [name], key_type=key_type)[name]
    left = _folders(staged, column)
    replaced = staged.hint("rebalance", F.col(column)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
    replaced.partitionBy(column).parquet(f"{folder}/{name}.parquet")
    for value in touched - left:
        _remove(spark, f"{folder}/{name}.parquet/{column}={'__HIVE_DEFAULT_PARTITION__' if value is None else value}")
    return touched


def _remove(spark: SparkSession, path: str) -> None:
    """Remove a folder that all rows have left; overwriting leaves folders alone that get no row."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


def update_where(
    spark: SparkSession,
    folder: str,
    name: str,
    predicate: Column,
    changes: Mapping[str, Column],
    now: dt.datetime | Column | None = None,
    key_type: str | None = None,
) -> set:
    """``apply_update`` on the stored table ``name`` below ``folder``; returns the values of the folders that were replaced.

    The folder column may be among ``changes``: rows move to their new folder. The new rows are written to the shared folder first,
    so a lost executor costs no data. Replacing is not one step for readers: a job that dies while folders are being replaced is ended by
    writing the same staged rows again, not by another update.
    """
    return _rewrite(
        spark, folder, name, key_type, lambda df: df.filter(predicate), lambda df: apply_update(df, predicate, changes, now, name)
    )


def update_by_key(
    spark: SparkSession,
    folder: str,
    name: str,
    updates: DataFrame,
    keys: Sequence[str],
    now: dt.datetime | Column | None = None,
    order: Sequence[str] = (),
    nulls: Sequence[str] = (),
    key_type: str | None = None,
) -> set:
    """``apply_updates`` on the stored table, likewise. Keys that the table lacks touch nothing."""
    asked = updates.select(*keys).distinct()
    return _rewrite(
        spark, folder, name, key_type,
        lambda df: df.join(asked, list(keys), "left_semi"),
        lambda df: apply_updates(df, updates, keys, now, name, order, nulls),
    )
