"""Small helpers shared by the operators: reading tables, cutting lineage, totals that run over a distributed order."""

from __future__ import annotations

import os
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ovenplan.session import shared_folder

# White space of the text contracts: blank, tab, line feed, vertical tab, form feed, carriage return.
BLANKS = r"[\x20\x09-\x0D]"
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def settled(rows: DataFrame, purpose: str) -> DataFrame:
    """Write rows to the cluster's shared folder and read them back: plans above it start from files, not from lineage.

    Unlike a checkpoint the files are columnar and compressed. A reader that loses an executor reads them again.
    """
    folder = shared_folder(rows.sparkSession, purpose)
    rows.write.parquet(folder)
    return rows.sparkSession.read.schema(rows.schema).parquet(folder)


def importable(spark: SparkSession) -> None:
    """Let Python workers import this package from where the driver has it.

    Clusters whose machines don't share that folder get the package with ``--py-files``, as usual.
    """
    root, environment = str(Path(__file__).resolve().parents[2]), spark.sparkContext.environment
    paths = [p for p in environment.get("PYTHONPATH", "").split(os.pathsep) if p]
    if root not in paths:
        environment["PYTHONPATH"] = os.pathsep.join([*paths, root])


def shuffle_width(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def running_total(rows: DataFrame, order: list[str], value: str, out: str) -> DataFrame:
    """Add ``out``: the sum of ``value`` over all rows that come earlier by ``order``. No task holds more than one range.

    Rows are range-partitioned and written; the totals of the ranges (one row per partition) give each range its start, and a
    window inside each range does the rest. A hot leading column is split by the later ones, so ``order`` should end in a key
    that tells rows apart; rows that tie in all of it share a range and come in any order among themselves.
    """
    spark = rows.sparkSession
    ranged = settled(
        rows.repartitionByRange(shuffle_width(spark), *order).withColumn("_range", F.spark_partition_id()), "ranges"
    )
    starts = (
        ranged.groupBy("_range")
        .agg(F.sum(value).alias("_sum"))
        .select(
            "_range",
            F.coalesce(F.sum("_sum").over(Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias(
                "_start"
            ),
        )
    )
    inside = Window.partitionBy("_range").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    # One row per range, so the size of this broadcast is bounded by the number of partitions.
    return (
        ranged.withColumn("_inside", F.coalesce(F.sum(value).over(inside), F.lit(0)))
        .join(F.broadcast(starts), "_range")
        .withColumn(out, F.col("_start") + F.col("_inside"))
        .drop("_range", "_start", "_inside")
    )


def word_count(text: Column) -> Column:
    """Number of words of a text; 0 for null. Counts the ends of words, so no array of words is built."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")
