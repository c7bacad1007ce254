from __future__ import annotations

import datetime as dt
from decimal import ROUND_HALF_UP, Decimal

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from ovenplan.functions.labels import EMAIL_TYPES, PHONE_TYPES, decode
from ovenplan.functions.numbers import gram_share, per_gram, percent_change, round_div
from ovenplan.functions.predicates import (
    active_on,
    due_on,
    like_ci,
    recent,
    weekday_due,
    weekday_number,
    weekday_of,
)


def column(spark, values, kind, expr):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}")
    return [r[0] for r in df.orderBy("i").select(expr).collect()]


def test_decode_has_no_default(spark):
    assert column(spark, ["m", "w", "x", None], "string", decode(F.col("v"), PHONE_TYPES)) == [
        "mobile",
        "work",
        None,
        None,
    ]
    assert column(spark, ["p", "b"], "string", decode(F.col("v"), EMAIL_TYPES)) == ["personal", "business"]


def test_weekday_is_sunday_based(spark):
    days = [dt.date(2019, 12, 8) + dt.timedelta(days=d) for d in range(7)]
    assert [weekday_number(d) for d in days] == list(range(7))
    assert column(spark, days, "date", weekday_of(F.col("v"))) == list(range(7))


def test_rounding_is_half_away_from_zero(spark):
    values = [25, -25, 24, -26, 0, 35]
    rounded = round_div(F.col("v"), F.lit(10), signed=True)
    assert column(spark, values, "bigint", rounded) == [3, -3, 2, -3, 0, 4]


@settings(max_examples=8, deadline=None)
@given(
    st.lists(
        st.tuples(
            st.integers(0, 10**9),
            st.decimals("0.01", "999.99", places=2),
            st.decimals("0.01", "99999.99", places=2),
            st.decimals("-200", "100", places=6),
        ),
        min_size=1,
        max_size=30,
    )
)
def test_shares_match_exact_arithmetic(spark, cases):
    df = spark.createDataFrame(
        [(i, *c) for i, c in enumerate(cases)],
        "i int, w bigint, b decimal(5,2), t decimal(15,2), p decimal(18,6)",
    )
    w, b, t, p = (F.col(c) for c in "wbtp")
    found = df.orderBy("i").select(gram_share(w, b, t), gram_share(w, b, t, p, 1)).collect()
    for (weight, percent, total, part), (overall, share) in zip(cases, found):
        assert overall == _exact(weight * percent, total, 0)
        assert share == _exact(weight * percent * part, total * 100, 1)


def _exact(num, den, places):
    """Half away from zero on fractions."""
    from fractions import Fraction

    scaled = Fraction(num) / Fraction(den) * 10**places
    whole = (abs(scaled) * 2 + 1) // 2
    return Decimal(int(whole) * (1 if scaled >= 0 else -1)).scaleb(-places)


def test_a_tie_that_truncated_division_would_move(spark):
    # 0.4999999999... cut to few digits and rounded again would give 1.
    df = spark.createDataFrame(
        [(1, Decimal("33.33"), Decimal("66.67"))], "w bigint, b decimal(5,2), t decimal(15,2)"
    )
    assert df.select(gram_share(F.col("w"), F.col("b"), F.col("t"))).first()[0] == 0


def test_percent_change(spark):
    df = spark.createDataFrame(
        [(Decimal("6.00"), Decimal("5.20")), (None, Decimal("5.20")), (Decimal("5.00"), None), (Decimal("1"), Decimal("2"))],
        "n decimal(10,5), o decimal(10,5)",
    )
    found = [r[0] for r in df.select(percent_change(F.col("n"), F.col("o"))).collect()]
    assert found == [Decimal("15.4"), None, None, Decimal("-50.0")]


def test_unit_cost(spark):
    df = spark.createDataFrame([(Decimal("6.00"), Decimal(907))], "c decimal(10,5), g decimal(18,6)")
    assert df.select(per_gram(F.col("c"), F.col("g"))).first()[0] == (Decimal(6) / 907).quantize(
        Decimal("0.00001"), ROUND_HALF_UP
    )


def test_like_ignores_case(spark):
    names = ["Kamut sourdough", "pizza", None]
    assert column(spark, names, "string", like_ci(F.col("v"), "KAM%")) == [True, False, None]
    assert column(spark, names, "string", like_ci(F.col("v"), F.lit("P_ZZA"))) == [False, True, None]


def test_date_windows(spark):
    day = dt.date(2019, 12, 9)
    dates = [day + dt.timedelta(days=d) for d in (1, 2, 3)]
    assert column(spark, dates, "date", due_on(F.col("v"), F.lit(2), day)) == [False, True, False]
    starts = column(spark, dates, "date", active_on(F.col("v"), F.lit(dates[2]), F.lit(2), day))
    assert starts == [True, True, False]
    ends = column(spark, [*dates, None], "date", active_on(F.lit(day), F.col("v"), F.lit(2), day))
    assert [bool(e) for e in ends] == [False, False, True, False]


def test_weekday_due_wraps_once_a_week(spark):
    df = spark.range(7).select("id", F.explode(F.sequence(F.lit(0), F.lit(7))).alias("lead"))
    total = None
    for d in range(7):
        as_of = dt.date(2019, 12, 8) + dt.timedelta(days=d)
        hit = weekday_due(F.col("id"), F.col("lead"), as_of).cast("int")
        total = hit if total is None else total + hit
    assert {r[0] for r in df.select(total).collect()} == {1}


def test_weekday_without_wrap(spark):
    saturday = dt.date(2019, 12, 14)
    assert column(spark, [1, 6, 7], "int", weekday_due(F.col("v"), F.lit(2), saturday, wrap=False)) == [False] * 3
    assert column(spark, [1, 6, 7], "int", weekday_due(F.col("v"), F.lit(1), saturday, wrap=False)) == [
        False,
        False,
        True,
    ]


def test_recent(spark):
    now = dt.datetime(2019, 12, 9, 12)
    times = [now - dt.timedelta(seconds=s) for s in (9, 10, -5)]
    assert column(spark, times, "timestamp", recent(F.col("v"), now, 10)) == [True, False, True]
