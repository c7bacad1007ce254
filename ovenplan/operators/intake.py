"""Appends that are checked: a batch is split into the rows that a table can take and those that it can't, with the reasons.

Rows are judged by what they hold (missing values, broken rules), by what the stored tables hold (keys that are taken, parents that
are absent), and then by each other: of sound rows with the same key the first by the given order is taken. A row with any reason
doesn't stand in the way of a later one.

Stored tables are far larger than a batch, so their keys are first tested against a bitmap of the batch's keys: one hash of
``BITS`` bits, in pieces of 4 KB, at most ``2**BITS / 8`` bytes whatever the batch holds. That bound is what allows it to be sent to
every reader of the table; only rows that it lets through are shuffled and compared by their keys.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Mapping, Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ovenplan.operators.snapshots import append_rows, fill_defaults
from ovenplan.schemas import TABLES, Table
from ovenplan.session import shared_folder

BITS = 24
#: Bits of a piece, as Spark's bitmap aggregate makes them.
PIECE_BITS = 32768


def _place(columns: Sequence[str]) -> Column:
    """A place in the bitmap, from 1 as the bitmap functions count. Values are hashed as text, so number types may differ."""
    text = [F.col(c).cast("string") for c in columns]
    return F.pmod(F.xxhash64(*text), F.lit(1 << BITS)) + 1


def key_bitmap(keys: DataFrame, columns: Sequence[str]) -> DataFrame:
    """``piece, bits`` of the keys: at most 2**BITS / PIECE_BITS rows of 4 KB."""
    placed = keys.select(_place(columns).alias("_place"))
    return placed.groupBy(F.call_function("bitmap_bucket_number", "_place").alias("piece")).agg(
        F.call_function("bitmap_construct_agg", F.call_function("bitmap_bit_position", "_place")).alias("bits")
    )


def possibly_among(rows: DataFrame, columns: Sequence[str], bitmap: DataFrame) -> DataFrame:
    """Rows whose key may be among those of the bitmap: all that are, and of the others as many as share a place."""
    at = F.call_function("bitmap_bit_position", _place(columns))
    byte = F.conv(F.hex(F.substring("bits", (F.expr("_at div 8") + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
    hit = F.expr("shiftright(_byte, CAST(_at % 8 AS INT)) & 1") == 1
    numbered = rows.withColumns({"piece": F.call_function("bitmap_bucket_number", _place(columns)), "_at": at})
    # The size of this broadcast is bounded: see the module's head.
    return numbered.join(F.broadcast(bitmap), "piece").withColumn("_byte", byte).filter(hit).drop("piece", "_at", "bits", "_byte")


def keys_found(batch: DataFrame, columns: Sequence[str], stored: DataFrame, stored_columns: Sequence[str]) -> DataFrame:
    """The batch's distinct keys that the stored table holds, under the batch's names. Keys with a NULL are left out."""
    wanted = batch.select(*columns).dropna().distinct()
    renamed = stored.select(*[F.col(s).alias(c) for c, s in zip(columns, stored_columns, strict=True)]).dropna()
    near = possibly_among(renamed, columns, key_bitmap(wanted, columns))
    return wanted.join(near, list(columns), "left_semi")


@dataclass(frozen=True)
class Intake:
    """``accepted`` has the table's columns; ``rejected`` has the batch's and ``reasons``, an array of rule names."""

    accepted: DataFrame
    rejected: DataFrame

    def next_snapshot(self, existing: DataFrame) -> DataFrame:
        return append_rows(existing, self.accepted)


def _flagged(batch: DataFrame, columns: Sequence[str], found: DataFrame, flag: str) -> DataFrame:
    """Add whether the row's key is among ``found``. A key with a NULL is not."""
    return batch.join(found.withColumn(flag, F.lit(True)), list(columns), "left").withColumn(flag, F.coalesce(flag, F.lit(False)))


def checked_append(
    stored: Mapping[str, DataFrame],
    name: str,
    incoming: DataFrame,
    as_of: dt.date,
    order: Sequence[str],
    now: dt.datetime | Column | None = None,
    declared: Table | None = None,
    may_lack: Sequence[str] = (),
) -> Intake:
    """Split ``incoming`` by the declared constraints of table ``name``.

    ``stored`` holds the table and its parents. Columns in ``order`` that the table lacks only say which of equal keys comes first.
    With ``now`` declared defaults are filled in first. ``may_lack`` names declared columns that this table doesn't keep. The judged
    batch is written to the shared folder, so the stored tables are read once however often both results are used.
    """
    declared = declared or TABLES[name]
    batch = incoming if now is None else fill_defaults(incoming, declared, now)
    day = f"DATE'{as_of.isoformat()}'"
    reasons = [F.when(F.col(c).isNull(), F.lit(f"{c}_not_null")) for c in declared.not_null if c not in may_lack and c in batch.columns]
    reasons += [F.lit(f"{c}_not_null") for c in declared.not_null if c not in may_lack and c not in batch.columns]
    reasons += [F.when(F.expr(f"NOT ({rule.condition.replace(':as_of', day)})"), F.lit(rule.name)) for rule in declared.rules]
    keys = [columns for columns in [declared.key, *declared.unique] if columns]
    flags: list[str] = []
    whole_batch = batch  # keys are looked up for the batch as it came, not for the result of earlier lookups
    for number, columns in enumerate(keys):
        flags.append(f"_taken{number}")
        batch = _flagged(batch, columns, keys_found(whole_batch, columns, stored[name], columns), flags[-1])
        reasons.append(F.when(F.col(flags[-1]), F.lit(f"{'_'.join(columns)}_unique")))
    for number, reference in enumerate(declared.references):
        flags.append(f"_parent{number}")
        found = keys_found(whole_batch, reference.columns, stored[reference.parent], reference.parent_columns)
        batch = _flagged(batch, reference.columns, found, flags[-1])
        whole = reduce(Column.__and__, [F.col(c).isNotNull() for c in reference.columns])
        reasons.append(F.when(whole & ~F.col(flags[-1]), F.lit(f"{'_'.join(reference.columns)}_in_{reference.parent}")))
    judged = batch.withColumn("reasons", F.array_sort(F.filter(F.array(*reasons), lambda r: r.isNotNull()))).drop(*flags)
    folder = shared_folder(judged.sparkSession, "intake")
    judged.write.parquet(folder)
    judged = judged.sparkSession.read.schema(judged.schema).parquet(folder)
    rejected = judged.filter(F.size("reasons") > 0)
    sound = judged.filter(F.size("reasons") == 0).drop("reasons")
    for columns in keys:
        # The first of each key is kept by a limit that each task applies before the shuffle; the others are what is left, row by row.
        first = Window.partitionBy(*columns).orderBy(*order)
        numbered = sound.withColumn("_number", F.row_number().over(first)).filter("_number = 1").drop("_number")
        whole = reduce(Column.__and__, [F.col(c).isNotNull() for c in columns])
        kept = numbered.filter(whole).unionByName(sound.filter(~whole))
        repeated = sound.exceptAll(kept).withColumn("reasons", F.array(F.lit(f"{'_'.join(columns)}_unique")))
        rejected, sound = rejected.unionByName(repeated), kept
    names = [c for c in stored[name].columns if c in sound.columns]
    return Intake(sound.select(*names), rejected)
