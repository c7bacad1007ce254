"""Constraint checks as reports: the rows or keys that break a rule."""

from __future__ import annotations

import datetime as dt
from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ovenplan.schemas import Reference, Rule, Table

#: Columns of a reference from which on its keys are taken to differ from row to row.
WIDE = 3


def _text(columns: Sequence[str]) -> Column:
    return F.concat_ws("|", *[F.col(c).cast("string") for c in columns])


def _failures(df: DataFrame, tests: Sequence[tuple[str, str, str]], keys: Sequence[str]) -> DataFrame:
    """One pass over the rows: sound rows are dropped first, then one row is made per failed test.

    A test is a rule name, the condition for a bad row and the value to show, as SQL expressions.
    """
    suspects = df.filter(" OR ".join(f"({broken})" for _, broken, _ in tests))
    failed = ", ".join(
        f"CASE WHEN {broken} THEN named_struct('rule', '{name}', 'value', CAST({value} AS STRING)) END"
        for name, broken, value in tests
    )
    found = suspects.select(_text(keys).alias("key"), F.expr(f"explode(array({failed}))").alias("f"))
    return found.filter("f IS NOT NULL").select("f.rule", "key", "f.value")


def check_rules(df: DataFrame, rules: Sequence[Rule], keys: Sequence[str], as_of: dt.date) -> DataFrame:
    """``rule, key, value`` of every broken domain rule. A condition that is NULL passes."""
    day = f"DATE'{as_of.isoformat()}'"
    tests = [(rule.name, f"NOT ({rule.condition.replace(':as_of', day)})", rule.value) for rule in rules]
    return _failures(df, tests, keys)


def check_not_null(df: DataFrame, columns: Sequence[str], keys: Sequence[str]) -> DataFrame:
    """``rule, key, value`` of every missing value."""
    return _failures(df, [(f"{c}_not_null", f"{c} IS NULL", "NULL") for c in columns], keys)


def check_unique(df: DataFrame, columns: Sequence[str], name: str, nulls_differ: bool = True) -> DataFrame:
    """``rule, key, n_rows`` of every key that occurs more than once. A UNIQUE key with a NULL never repeats."""
    if nulls_differ:
        df = df.dropna(subset=list(columns))
    counted = df.groupBy(*columns).agg(F.count(F.lit(1)).alias("n_rows")).filter("n_rows > 1")
    return counted.select(F.lit(name).alias("rule"), _text(columns).alias("key"), "n_rows")


def check_fk(child: DataFrame, parent: DataFrame, reference: Reference, name: str) -> DataFrame:
    """``rule, key, n_rows`` of every referenced key without a parent.

    Child keys are counted before the join, so a key that many rows share is looked up once. A row with a NULL key passes.
    """
    wanted = child.dropna(subset=list(reference.columns)).groupBy(*reference.columns).agg(
        F.count(F.lit(1)).alias("n_rows")
    )
    parents = parent.select(*[F.col(p).alias(c) for c, p in zip(reference.columns, reference.parent_columns)])
    missing = wanted.join(parents, list(reference.columns), "left_anti")
    return missing.select(F.lit(name).alias("rule"), _text(reference.columns).alias("key"), "n_rows")


def check_keys(
    tables: Mapping[str, DataFrame], declared: Mapping[str, Table], kinds: Sequence[str] = ("unique", "reference")
) -> DataFrame:
    """``kind, table_name, rule, key, n_rows``: every repeated key (kind ``unique``) and every reference without a parent (kind
    ``reference``) of all declared tables. A key or reference with a NULL passes."""
    reports = [report for kind, report in (("unique", _repeated_keys), ("reference", _lost_references)) if kind in kinds]
    return reduce(DataFrame.unionByName, [report(tables, declared) for report in reports])


def _ambiguous(table: DataFrame, columns: tuple[str, ...]) -> bool:
    """Whether the text of a key of several columns might also be that of another."""
    kinds_of = dict(table.dtypes)
    return len(columns) > 1 and any(kinds_of[c] == "string" for c in columns)


def _repeated_keys(tables: Mapping[str, DataFrame], declared: Mapping[str, Table]) -> DataFrame:
    """Keys are counted as the values they are, so a table that is dealt out by its key already isn't shuffled again, and only keys
    that repeat become text. Keys of equal text are one."""
    found: dict[bool, list[DataFrame]] = {True: [], False: []}
    for name, table in declared.items():
        for columns in [c for c in [table.key, *table.unique] if c]:
            whole = reduce(Column.__and__, [F.col(c).isNotNull() for c in columns])
            # NULLs are left out together with the count: alone, that filter would move below the table's own shuffles, which then
            # serve no other reader.
            counted = tables[name].groupBy(*columns).agg(F.count(F.lit(1)).alias("n_rows")).filter(F.when(whole, F.col("n_rows")) > 1)
            labels = [F.lit(x).alias(n) for n, x in (("kind", "unique"), ("table_name", name), ("rule", f"{'_'.join(columns)}_unique"))]
            found[_ambiguous(tables[name], columns)].append(counted.select(*labels, _text(columns).alias("key"), "n_rows"))
    reports = found[False]
    if found[True]:
        told = reduce(DataFrame.unionByName, found[True]).groupBy("kind", "table_name", "rule", "key").agg(F.sum("n_rows").alias("n_rows"))
        reports = [*reports, told]
    return reduce(DataFrame.unionByName, reports)


def _lost_references(tables: Mapping[str, DataFrame], declared: Mapping[str, Table]) -> DataFrame:
    """Each table is read once and gives a small row (constraint, text of the key, side) for each key that it refers to or is referred
    to by. All of them are counted in one shuffle, combined before it, so a key that many rows share is one row and no table is
    worked out a second time for the keys that look wrong. Values are compared as text, as a key and its reference may have
    different number types; where the text of a key of several columns might also be that of another, a hash of the values goes with it.

    Keys of ``WIDE`` columns or more hardly repeat. Combined before the shuffle like the others they only fill the memory of its tasks, so that
    the counts of all keys go to disk; their rows are dealt out by the key as they are and counted there.
    """
    constraints: list[tuple[str, str, str]] = []
    entries: dict[tuple[str, bool], list[tuple[int, str, tuple[str, ...], bool]]] = {(name, wide): [] for name in declared for wide in (False, True)}
    for name, table in declared.items():
        for reference in table.references:
            hashed = _ambiguous(tables[name], reference.columns) or _ambiguous(tables[reference.parent], reference.parent_columns)
            wide = len(reference.columns) >= WIDE
            entries[name, wide].append((len(constraints), "own", reference.columns, hashed))
            entries[reference.parent, wide].append((len(constraints), "parent", reference.parent_columns, hashed))
            constraints.append(("reference", name, f"{'_'.join(reference.columns)}_in_{reference.parent}"))

    def stacked(name: str, wide: bool) -> DataFrame:
        def entry(number: int, side: str, columns: tuple[str, ...], hashed: bool) -> Column:
            whole = reduce(Column.__and__, [F.col(c).isNotNull() for c in columns])
            told = F.xxhash64(*[F.col(c).cast("string") for c in columns]) if hashed else F.lit(0).cast("bigint")
            row = F.struct(F.lit(number).alias("number"), told.alias("told"), _text(columns).alias("key"), F.lit(side == "own").alias("own"))
            return F.when(whole, row)

        wanted = F.array(*[entry(*e) for e in entries[name, wide]])
        return tables[name].select(F.explode(wanted).alias("e")).filter("e IS NOT NULL").select("e.*")

    def counted(wide: bool) -> list[DataFrame]:
        stacks = [stacked(name, wide) for name in declared if entries[name, wide]]
        if not stacks:
            return []
        rows = reduce(DataFrame.unionByName, stacks)
        if wide:
            # By number of partitions, so that these are not joined to ones whose keys fill a task's memory again.
            rows = rows.repartition(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), "key")
        counts = rows.groupBy("number", "told", "key").agg(F.count_if("own").alias("owned"), F.count_if(~F.col("own")).alias("parents"))
        return [counts.filter("owned > 0 AND parents = 0")]

    lost = reduce(DataFrame.unionByName, [*counted(False), *counted(True)])
    exact = lost.groupBy("number", "key").agg(F.sum("owned").alias("n_rows"))
    names = F.array(*[F.struct(*[F.lit(x).alias(n) for n, x in zip(("kind", "table_name", "rule"), c, strict=True)]) for c in constraints])
    return exact.withColumn("c", F.get(names, F.col("number"))).select("c.*", "key", "n_rows")


def check_missing(tables: Mapping[str, DataFrame], declared: Mapping[str, Table]) -> DataFrame:
    """``table_name, rule, key`` of every missing value in the declared columns that a table has; one pass over each table."""
    reports = []
    for name, table in declared.items():
        present = [c for c in table.not_null if c in tables[name].columns]
        keys = list(table.key) or [c for c in table.names if c in tables[name].columns]
        if present:
            reports.append(check_not_null(tables[name], present, keys).select(F.lit(name).alias("table_name"), "rule", "key"))
    return reduce(DataFrame.unionByName, reports)


def check_table(
    name: str, declared: Table, tables: Mapping[str, DataFrame], as_of: dt.date, ignore: Sequence[str] = ()
) -> DataFrame:
    """All declared checks of one table: ``table_name, rule, key, value, n_rows``."""
    df = tables[name]
    keys = list(declared.key) or [c for c in declared.names if c in df.columns]
    present = [c for c in declared.not_null if c in df.columns and c not in ignore]
    reports = [
        check_not_null(df, present, keys).withColumn("n_rows", F.lit(1).cast("bigint")),
        *[
            check_unique(df, columns, f"{'_'.join(columns)}_unique").withColumn("value", F.lit(None).cast("string"))
            for columns in ([declared.key] if declared.key else []) + list(declared.unique)
        ],
        *[
            check_fk(df, tables[r.parent], r, f"{'_'.join(r.columns)}_in_{r.parent}").withColumn(
                "value", F.lit(None).cast("string")
            )
            for r in declared.references
        ],
    ]
    if declared.rules:
        reports.insert(
            0, check_rules(df, declared.rules, keys, as_of).withColumn("n_rows", F.lit(1).cast("bigint"))
        )
    return reduce(DataFrame.unionByName, reports).select(F.lit(name).alias("table_name"), "rule", "key", "value", "n_rows")
