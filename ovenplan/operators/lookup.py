"""Finding keys by name patterns.

The patterns of a batch are matched against all names of a dimension by joins on text pieces: whole names for patterns without
wildcards, and otherwise the pattern's rarest three-letter piece. LIKE is then tested on the rows that share the piece.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ovenplan.functions.predicates import like_ci
from ovenplan.operators.skew import skew_join
from ovenplan.session import shared_folder

PIECE = 3
# So many patterns with their keys are sent to every task rather than the rows to them: some megabytes at most.
FEW_PATTERNS = 50_000


def _pieces(text: DataFrame, column: str, sizes: Column) -> DataFrame:
    """Each distinct substring of ``column`` with a length among ``sizes``, as ``piece``.

    A piece is kept where it first occurs in the text, so no row repeats.
    """
    cut = F.substring(F.col(column), F.col("_at"), F.col("_size"))
    return (
        text.withColumn("_at", F.explode(F.sequence(F.lit(1), F.length(column))))
        .withColumn("_size", F.explode(sizes))
        .filter(F.col("_at") + F.col("_size") <= F.length(column) + 1)
        .withColumn("piece", cut)
        .filter(F.call_function("instr", F.col(column), F.col("piece")) == F.col("_at"))
        .drop("_at", "_size")
    )


def _literal_runs(needle: Column) -> Column:
    """The runs of plain characters in a LIKE pattern, with escaped characters taken as plain ones."""
    marked = F.regexp_replace(needle, r"\\\\", "\u0003")
    marked = F.regexp_replace(marked, r"\\%", "\u0001")
    marked = F.regexp_replace(marked, r"\\_", "\u0002")
    runs = F.filter(F.split(marked, "[%_]"), lambda run: run != "")
    return F.transform(runs, lambda run: F.translate(run, "\u0001\u0002\u0003", "%_\\"))


def lookup_id(
    dim: DataFrame,
    name_col: str,
    id_col: str,
    patterns: DataFrame,
    pattern_col: str,
    within: Sequence[str] = (),
) -> DataFrame:
    """``pattern, id, hits`` for each distinct pattern: the smallest matching id and the number of matching rows.

    Case is ignored. A pattern that is NULL or has no match gets a NULL id and 0 hits. ``within`` names columns that both
    sides have and that must be equal too, such as the kind of name where several dimensions are searched at once.
    """
    names = (
        dim.select(*within, F.lower(name_col).alias("name"), F.col(id_col).alias("id"))
        .groupBy(*within, "name")
        .agg(F.min("id").alias("id"), F.count(F.lit(1)).alias("hits"))
    )
    wanted = patterns.select(*within, F.col(pattern_col).alias("pattern")).distinct()
    needle = F.lower("pattern")
    needles = wanted.select(*within, "pattern", needle.alias("needle"), _literal_runs(needle).alias("runs"))
    has_wildcard = F.col("needle").rlike(r"[%_\\]")
    plain = needles.filter(~has_wildcard).join(names.withColumnRenamed("name", "needle"), [*within, "needle"])
    wild = needles.filter(has_wildcard)
    nothing = wanted.select(
        *within, "pattern", F.lit(None).cast(dim.schema[id_col].dataType).alias("id"), F.lit(0).alias("hits")
    )
    return (
        nothing.unionByName(plain.select(*within, "pattern", "id", "hits"))
        .unionByName(_by_piece(wild.filter(F.size("runs") > 0), names, within))
        .unionByName(_by_length(wild.filter(F.size("runs") == 0), names, within))
        .groupBy(*within, "pattern")
        .agg(F.min("id").alias("id"), F.sum("hits").alias("hits"))
    )


def matches(dim: DataFrame, name_col: str, patterns: DataFrame, pattern_col: str) -> DataFrame:
    """``pattern, name`` for each distinct pattern and each distinct lower-cased name that it matches.

    As in ``lookup_id``, a pattern meets only names that hold its rarest piece, or the name that it is. One of wildcards alone meets
    the names of every length that it allows. NULL patterns and names match nothing.
    """
    names = dim.select(F.lower(name_col).alias("name")).distinct().dropna()
    needle = F.lower("pattern")
    wanted = patterns.select(F.col(pattern_col).alias("pattern")).distinct().dropna()
    needles = wanted.select("pattern", needle.alias("needle"), _literal_runs(needle).alias("runs"))
    has_wildcard = F.col("needle").rlike(r"[%_\\]")
    plain = needles.filter(~has_wildcard).join(names.withColumnRenamed("name", "needle"), "needle").select("pattern", F.col("needle").alias("name"))
    wild = needles.filter(has_wildcard)
    counted = names.withColumns({"id": F.col("name"), "hits": F.lit(1)})
    by_piece = _by_piece(wild.filter(F.size("runs") > 0), counted, []).select("pattern", F.col("id").alias("name"))
    longest = names.agg(F.max(F.length("name"))).first()[0] or 0
    least = F.length(F.regexp_replace("needle", "%", ""))
    most = F.when(F.contains("needle", F.lit("%")), F.greatest(least, F.lit(longest))).otherwise(least)
    by_length = wild.filter(F.size("runs") == 0).select("pattern", F.explode(F.sequence(least, most)).alias("_length"))
    by_length = by_length.join(names.withColumn("_length", F.length("name")), "_length").select("pattern", "name")
    return plain.unionByName(by_piece).unionByName(by_length).distinct()


def find_id(dim: DataFrame, name_col: str, id_col: str, pattern: str) -> DataFrame:
    """``id, hits`` for one pattern given as text: a filter and an aggregate, always one row."""
    return dim.filter(like_ci(F.col(name_col), pattern)).agg(
        F.min(id_col).alias("id"), F.count(F.lit(1)).alias("hits")
    )


def _by_piece(needles: DataFrame, names: DataFrame, within: Sequence[str]) -> DataFrame:
    """Match by the pattern's rarest piece; how often each piece occurs is counted where the names are read."""
    longest = F.array_max(F.transform("runs", F.length))
    runs = needles.select(
        *within, "pattern", "needle", F.least(longest, F.lit(PIECE)).alias("size"), F.explode("runs").alias("run")
    ).filter(F.length("run") >= F.col("size"))
    place = [*within, "piece"]
    pieces = _pieces(runs, "run", F.array("size")).select(*place, "pattern", "needle")
    holders = _pieces(names.filter("name <> ''"), "name", F.array(*[F.lit(n) for n in range(1, PIECE + 1)]))
    counts = holders.groupBy(*place).agg(F.count(F.lit(1)).alias("n"))
    rarest = (
        pieces.join(counts, place)
        .groupBy(*within, "pattern", "needle")
        .agg(F.min_by("piece", F.struct("n", "piece")).alias("piece"))
    )
    found = skew_join(holders, rarest, place, counts).filter(F.like("name", F.col("needle")))
    return found.select(*within, "pattern", "id", "hits")


def _by_length(needles: DataFrame, names: DataFrame, within: Sequence[str]) -> DataFrame:
    """Patterns of wildcards only match by length alone, so names are first counted per length."""
    merged = [F.min("id").alias("id"), F.sum("hits").alias("hits")]
    lengths = names.groupBy(*within, F.length("name").alias("length")).agg(*merged)
    at_least = (
        lengths.select(*within, F.explode(F.sequence(F.lit(0), "length")).alias("length"), "id", "hits")
        .groupBy(*within, "length")
        .agg(*merged)
    )
    either = lengths.withColumn("open", F.lit(False)).unionByName(at_least.withColumn("open", F.lit(True)))
    sized = needles.select(
        *within,
        "pattern",
        F.length(F.regexp_replace("needle", "%", "")).alias("length"),
        F.contains("needle", F.lit("%")).alias("open"),
    )
    return sized.join(either, [*within, "length", "open"]).select(*within, "pattern", "id", "hits")


def resolve_keys(df: DataFrame, lookups: Mapping[str, tuple[DataFrame, str, str]]) -> DataFrame:
    """Replace columns that hold names or patterns by keys.

    ``lookups`` maps a column to ``(dim, name_col, id_col)``. The key takes the name ``id_col`` unless the mapping key is
    written ``column>key``. A name that is not found gives a NULL key.
    """
    columns = {target: target.partition(">") for target in lookups}
    # All name columns are counted in one pass over the rows. The counts are the patterns to look up and tell which are hot.
    each = F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).alias("pattern")) for c, _, _ in columns.values()]))
    folder = shared_folder(df.sparkSession, "patterns")
    counted = df.select(each.alias("e")).groupBy("e.column", "e.pattern").agg(F.count(F.lit(1)).alias("n"))
    counted.write.parquet(folder)
    counted = df.sparkSession.read.schema(counted.schema).parquet(folder)
    sizes = {column: size for column, size in counted.groupBy("column").count().collect()}
    resolved = df
    # Columns of few patterns first: their rows stay where they are, and the later shuffles carry keys instead of these texts.
    for target in sorted(lookups, key=lambda t: sizes.get(columns[t][0], 0)):
        dim, name_col, id_col = lookups[target]
        column, _, key = columns[target]
        counts = counted.filter(F.col("column") == column).select(F.col("pattern").alias(column), "n")
        found = lookup_id(dim, name_col, id_col, counts, column).select(
            F.col("pattern").alias(column), F.col("id").alias(key or id_col)
        )
        if sizes.get(column, 0) <= FEW_PATTERNS:
            resolved = resolved.join(F.broadcast(found), column, "left").drop(column)
        else:
            resolved = skew_join(resolved, found, [column], counts, "left").drop(column)
    kept = [c for c in df.columns if c not in {column for column, _, _ in columns.values()}]
    return resolved.select(*kept, *[key or lookups[target][2] for target, (_, _, key) in columns.items()])


def complete(required: Sequence[str]) -> Column:
    """True for a row that has all required keys; the others are rejects."""
    return reduce(and_, [F.col(column).isNotNull() for column in required])
