from __future__ import annotations

from pyspark.sql import functions as F

from ovenplan.operators.skew import hot_keys, skew_join
from tests.conftest import rows


def skewed(spark):
    """A third of the rows on one key."""
    key = F.when(F.col("id") % 3 == 0, 0).when(F.col("id") % 1000 != 1, F.col("id"))
    return spark.range(30000).select(key.alias("k"), F.col("id").alias("v"))


def test_hot_key_is_split(spark):
    counts = skewed(spark).groupBy("k").agg(F.count(F.lit(1)).alias("n"))
    assert [tuple(r) for r in hot_keys(counts, ["k"], 30).collect()] == [(0, 334)]
    assert hot_keys(counts, ["k"]).count() == 0


def test_join_equals_plain_join(spark):
    data = skewed(spark)
    counts = data.groupBy("k").agg(F.count(F.lit(1)).alias("n"))
    other = spark.range(0, 30000, 2).select(F.col("id").alias("k"), (F.col("id") * 7).alias("x"))
    other = other.unionByName(other.filter("k < 10"))
    for how in ("inner", "left"):
        assert rows(skew_join(data, other, ["k"], counts, how, 30)) == rows(data.join(other, ["k"], how))
    stale = counts.limit(0)
    assert skew_join(data, other, ["k"], stale).count() == data.join(other, ["k"]).count()
