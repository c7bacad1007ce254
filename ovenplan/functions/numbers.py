"""Exact decimal rounding.

Quotients are rounded once, half away from zero, from integers. A decimal division first cuts the quotient at some scale, and
rounding the cut value again can move a tie; these helpers have no such second step.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def whole(col: Column, places: int, precision: int) -> Column:
    """``col * 10^places`` as an integer-valued decimal; ``col`` must have at most ``places`` decimals."""
    return (col * F.lit(10**places)).cast(f"decimal({precision},0)")


def round_div(num: Column, den: Column, places: int = 0, signed: bool = False) -> Column:
    """``num / den`` rounded half away from zero to ``places`` decimals.

    Both arguments are integer-valued. The result is a bigint for ``places == 0``, else ``decimal(18, places)``. Set
    ``signed`` where a value below zero can occur.
    """
    top, bottom = (F.abs(num), F.abs(den)) if signed else (num, den)
    top = top * F.lit(2 * 10**places) + bottom
    quotient = F.call_function("div", top, bottom * F.lit(2))
    if signed:
        quotient = F.when((num < 0) != (den < 0), -quotient).otherwise(quotient)
    if places == 0:
        return quotient
    return (quotient.cast("decimal(18,0)") * F.lit(f"1e-{places}").cast(f"decimal({places + 1},{places})")).cast(
        f"decimal(18,{places})"
    )


def gram_share(weight: Column, percent: Column, total: Column, part: Column | None = None, places: int = 0) -> Column:
    """Grams of one ingredient in a batch: ``weight * percent / total``, times ``part / 100`` if a part is asked for.

    ``weight`` is in whole grams, ``percent`` and ``total`` have two decimals, ``part`` has up to six.
    """
    num = weight.cast("decimal(18,0)") * whole(percent, 2, 7)
    den = whole(total, 2, 17)
    if part is None:
        return round_div(num, den, places)
    return round_div(num * whole(part, 6, 10), den * F.lit(10**8), places, signed=True)


def per_gram(cost: Column, grams: Column) -> Column:
    """Cost of one gram to five decimals; ``cost`` has up to five decimals and ``grams`` up to six."""
    return round_div(whole(cost, 6, 16), whole(grams, 6, 20), 5)


def percent_change(new: Column, old: Column, places: int = 1) -> Column:
    """Change from ``old`` to ``new`` in percent of ``old``; NULL if a value is NULL."""
    fixed_new, fixed_old = (whole(c.cast("decimal(18,6)"), 6, 18) for c in (new, old))
    return round_div((fixed_new - fixed_old) * F.lit(100), fixed_old, places, signed=True)
