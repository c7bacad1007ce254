"""Appends and updates that produce the next snapshot of a table. Nothing is changed in place."""

from __future__ import annotations

import datetime as dt
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from ovenplan.schemas import NOW, TABLES, UUID, Table

ID_BUCKETS = 65536


def _declared(table: str | Table) -> Table:
    return TABLES[table] if isinstance(table, str) else table


def _moment(now: dt.datetime | Column) -> Column:
    return now if isinstance(now, Column) else F.lit(now)


def named_uuid(space: str, *names: str) -> Column:
    """A uuid (version 8) made from a table's name and the values of its natural key, so equal rows get equal uuids in every run.

    Values are hashed with their lengths, and a NULL unlike any text; the first 122 free bits of the SHA-256 are kept.
    """
    parts = [F.coalesce(F.concat(F.length(c).cast("string"), F.lit(":"), c), F.lit("-")) for c in (F.col(n).cast("string") for n in names)]
    digest = F.sha2(F.concat(F.lit(f"{space}/"), *parts), 256)
    variant = F.translate(F.substring(digest, 17, 1), "0123456789abcdef", "89ab" * 4)
    groups = [F.substring(digest, 1, 8), F.substring(digest, 9, 4), F.concat(F.lit("8"), F.substring(digest, 14, 3))]
    return F.concat_ws("-", *groups, F.concat(variant, F.substring(digest, 18, 3)), F.substring(digest, 21, 12))


def _default(value: object, kind: str, now: dt.datetime | Column, uuid: Column) -> Column:
    if value == NOW:
        return _moment(now)
    if value == UUID:
        return uuid
    return F.lit(value) if kind == "KEY" else F.lit(value).cast(kind)


def fill_defaults(df: DataFrame, table: str | Table, now: dt.datetime | Column, natural: Sequence[str] = ()) -> DataFrame:
    """Put the declared default, in the declared type, where a column is missing or NULL.

    With a ``natural`` key, uuids are made from it, and a task that runs again gives the same. Without one they are random and made anew
    when the plan runs again: write the rows before other tables refer to them.
    """
    declared = _declared(table)
    if natural and not isinstance(table, str):
        raise ValueError("uuids made from a natural key need the name of the table")
    uuid = named_uuid(table, *natural) if natural else F.uuid()
    filled = {}
    for column, value in declared.defaults.items():
        default = _default(value, declared.types[column], now, uuid)
        filled[column] = F.coalesce(F.col(column), default) if column in df.columns else default
    return df.withColumns(filled)


def assign_ids(df: DataFrame, id_col: str, order: Sequence[str], last_id: int | Column = 0) -> DataFrame:
    """Number new rows ``last_id + 1, last_id + 2, ...`` without gaps.

    Rows are numbered within hash buckets of ``order``, which must identify a row; the small table of bucket sizes gives each
    bucket its offset. The result depends on the data alone, so a recomputed task gives the same numbers.
    """
    hashed = df.withColumn("_bucket", F.pmod(F.xxhash64(*order), F.lit(ID_BUCKETS)))
    sizes = hashed.groupBy("_bucket").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select("_bucket", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_offset"))
    number = F.row_number().over(Window.partitionBy("_bucket").orderBy(*order))
    return (
        hashed.withColumn("_number", number)
        .join(offsets, "_bucket")
        .withColumn(id_col, F.lit(last_id) + F.col("_offset") + F.col("_number"))
        .drop("_bucket", "_number", "_offset")
    )


def continue_ids(existing: DataFrame, incoming: DataFrame, id_col: str, order: Sequence[str]) -> DataFrame:
    """Number a batch from the greatest number of the table on, or from 1 for a table without any. The greatest number is read in the
    same plan, as a subquery of one row."""
    last = existing.agg(F.coalesce(F.max(id_col), F.lit(0)).cast("bigint")).scalar()
    return assign_ids(incoming, id_col, order, last)


def append_rows(existing: DataFrame, incoming: DataFrame) -> DataFrame:
    """The table with a batch added; columns the batch lacks are NULL. A column that the table lacks is an error."""
    unknown = [c for c in incoming.columns if c not in existing.columns]
    if unknown:
        raise ValueError(f"the table has no column {', '.join(unknown)}")
    return existing.unionByName(incoming, allowMissingColumns=True)


def _touches(df: DataFrame, table: str | Table | None) -> bool:
    return table is not None and _declared(table).touched and "modified" in df.columns


def apply_update(
    df: DataFrame,
    predicate: Column,
    changes: Mapping[str, Column],
    now: dt.datetime | Column | None = None,
    table: str | Table | None = None,
) -> DataFrame:
    """Set columns where the predicate holds.

    If ``table`` is declared as touched, ``modified`` becomes ``now`` on every such row, changed or not; in other tables it stays.
    """
    hit = F.coalesce(predicate, F.lit(False))
    columns = {name: F.when(hit, value).otherwise(F.col(name)) for name, value in changes.items()}
    if now is not None and _touches(df, table):
        columns["modified"] = F.when(hit, _moment(now)).otherwise(F.col("modified"))
    return df.withColumns(columns)


def apply_updates(
    snapshot: DataFrame,
    updates: DataFrame,
    keys: Sequence[str],
    now: dt.datetime | Column | None = None,
    table: str | Table | None = None,
    order: Sequence[str] = (),
    nulls: Sequence[str] = (),
) -> DataFrame:
    """Update a snapshot by key; it never gains a row, and a key that it lacks is ignored.

    Of several updates for a key the last by ``order`` counts, and the greatest among equals. A NULL leaves a column as it is,
    except for the columns named in ``nulls``, which it clears. Columns named in ``order`` alone are not written.
    """
    changed = [c for c in updates.columns if c not in keys and (c in snapshot.columns or c not in order)]
    last = F.max_by(F.struct(*changed), F.struct(*order, *[c for c in changed if c not in order]))
    found = updates.groupBy(*keys).agg(last.alias("_new"))
    hit = F.col("_new").isNotNull()
    columns = {
        c: F.when(hit, F.col("_new")[c]).otherwise(F.col(c)) if c in nulls else F.coalesce(F.col("_new")[c], F.col(c))
        for c in changed
    }
    if now is not None and _touches(snapshot, table):
        columns["modified"] = F.when(hit, _moment(now)).otherwise(F.col("modified"))
    return snapshot.join(found, list(keys), "left").withColumns(columns).select(*snapshot.columns)
