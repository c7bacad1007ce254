"""A join that splits hot keys.

Adaptive execution splits a hot key where both sides of a join come straight from a shuffle. It does not where the other side
is itself an aggregate or a join on the same key; this join serves those cases.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import or_

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

ROWS_PER_PIECE = 5_000_000
NO_KEY_PIECES = 1000


def hot_keys(counts: DataFrame, keys: Sequence[str], rows_per_piece: int = ROWS_PER_PIECE) -> DataFrame:
    """Keys with more rows than one task should get, and the number of pieces to split each into.

    ``counts`` has one row per key and its number of rows ``n``. Of a table of N rows at most N / ``rows_per_piece`` keys are
    hot: 200,000 of a trillion rows, a few megabytes.
    """
    return counts.filter(F.col("n") > rows_per_piece).select(
        *keys, F.ceil(F.col("n") / F.lit(rows_per_piece)).alias("_pieces")
    )


def skew_join(
    rows: DataFrame,
    other: DataFrame,
    keys: Sequence[str],
    counts: DataFrame,
    how: str = "inner",
    rows_per_piece: int = ROWS_PER_PIECE,
) -> DataFrame:
    """``rows.join(other, keys, how)`` with the rows of hot keys spread over pieces and their partners repeated per piece.

    ``counts`` may be an estimate: it decides where rows go, not what the result is. ``how`` is inner or left.
    """
    hot = F.broadcast(hot_keys(counts, keys, rows_per_piece))
    rest = [c for c in rows.columns if c not in keys] or list(keys)
    no_key = reduce(or_, [F.col(k).isNull() for k in keys])  # finds no partner, so it may go anywhere
    pieces = F.when(no_key, F.lit(NO_KEY_PIECES)).otherwise(F.coalesce("_pieces", F.lit(1)))
    piece = F.pmod(F.xxhash64(*[F.col(f"`{c}`") for c in rest]), pieces)
    spread = rows.join(hot, list(keys), "left").select(*[F.col(f"`{c}`") for c in rows.columns], piece.alias("_piece"))
    numbers = F.sequence(F.lit(0).cast("bigint"), F.coalesce("_pieces", F.lit(1)) - 1)
    repeated = other.join(hot, list(keys), "left").select(
        *[F.col(f"`{c}`") for c in other.columns], F.explode(numbers).alias("_piece")
    )
    return spread.join(repeated, [*keys, "_piece"], how).drop("_piece")
