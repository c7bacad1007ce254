from __future__ import annotations

import datetime as dt
import random
from decimal import Decimal

from pyspark.sql import functions as F

from ovenplan.operators import cost, history
from ovenplan.streaming.changes import read_late, read_log, stream_changes
from tests.conftest import make, recipe_row, rows

NOW = dt.datetime(2019, 12, 9, 12)
D = Decimal


def cost_rows(spark, values):
    return make(
        spark,
        "ingredient_costs",
        [
            dict(ingredient_id=i, maker_id="mill", mio="o", seller_id="mill", sio="o", cost=D(c), grams=D(g))
            for i, c, g in values
        ],
    )


def test_cost_changes_and_their_list(spark):
    before = cost_rows(spark, [("kamut flour", "5.20", 907), ("water", "1", 10), ("salt", "2", 20), ("gone", "3", 30)])
    after = cost_rows(spark, [("kamut flour", "6.00", 907), ("water", "1", 10), ("salt", "2", 40), ("new", "4", 1)])
    log = history.cost_changes(before, after, NOW)
    assert rows(log.select("ingredient_id", "old_cost", "new_cost", "old_grams", "new_grams", "change_time")) == [
        ("kamut flour", D("5.20000"), D("6.00000"), D("907.000000"), D("907.000000"), NOW),
        ("salt", D("2.00000"), D("2.00000"), D("20.000000"), D("40.000000"), NOW),
    ]
    ingredients = make(
        spark,
        "ingredients",
        [dict(ingredient_id="kamut flour", ingredient_name="kamut flour"), dict(ingredient_id="salt", ingredient_name="salt")],
    )
    parties = make(spark, "parties", [dict(party_id="mill", party_type="o", party_name="Cobble Works")])
    listed = cost.cost_change_list(log.filter("ingredient_id = 'kamut flour'"), ingredients, parties)
    assert rows(listed) == [
        ("Cobble Works", "kamut flour", D("5.20"), D("6.00"), D("0.00573"), D("0.00662"), D("907.000000"), NOW)
    ]


def test_identical_snapshots_log_nothing(spark):
    before = cost_rows(spark, [("a", "1", 1), ("b", "2", 2)])
    assert history.cost_changes(before, before, NOW).count() == 0


def test_recipe_changes(spark):
    """A replaced ingredient is logged, a change of a preferment percent alone is not; percents logged are the old ones."""
    def table(lines):
        df = make(spark, "product_ingredients", [recipe_row("k", *line) for line in lines])
        return df.withColumn("row_id", F.col("percent_in_soaker").cast("int"))

    before = table([("rye", 10, 5, 0, 1), ("water", 20, 5, 0, 2), ("salt", 30, 5, 0, 3)])
    after = table([("spelt", 10, 6, 0, 1), ("water", 25, 5, 0, 2), ("salt", 30, 9, 9, 3)])
    log = history.recipe_changes(before, after, "row_id", NOW)
    assert rows(
        log.select("old_ingredient_id", "new_ingredient_id", "old_bakers_percent", "new_bakers_percent", "percent_in_sour")
    ) == [
        ("rye", "spelt", D("10.00"), D("10.00"), D("5.000000")),
        ("water", "water", D("20.00"), D("25.00"), D("5.000000")),
    ]


def test_standing_changes_and_their_history(spark, bakery):
    key = dict(customer_id="blow", io="i", product_id="kamut", shape_id="boule")
    before = make(spark, "standing_orders", [dict(day_of_week=d, amt=a, **key) for d, a in ((0, 4), (1, 2), (2, 7))])
    after = make(spark, "standing_orders", [dict(day_of_week=d, amt=a, **key) for d, a in ((0, 2), (5, 2), (2, 7))])
    numbered = [df.withColumn("row_id", n) for df, n in (
        (before, F.col("day_of_week").cast("int")),
        (after, F.when(F.col("day_of_week") == 5, 1).otherwise(F.col("day_of_week").cast("int"))),
    )]
    log = history.standing_changes(*numbered, "row_id", NOW)
    days = spark.createDataFrame([(0, "Sun"), (1, "Mon"), (5, "Fri")], "dow_id smallint, dow_names string")
    listed = history.standing_change_history(log, bakery["parties"], bakery["products"], bakery["shapes"], days)
    assert rows(listed) == [
        ("Lark", "Kamut sourdough", '12" boule', "Mon", 2, 2, NOW),
        ("Lark", "Kamut sourdough", '12" boule', "Sun", 4, 2, NOW),
    ]


def feed_rows(n, seed):
    """Versions in time order; one key holds a third of them, and times repeat."""
    rng = random.Random(seed)
    start = dt.datetime(2024, 1, 1)
    made = []
    for i in range(n):
        key = "hot" if rng.random() < 0.34 else f"k{rng.randint(0, 30)}"
        minute = i if i % 3 else i - i % 2
        made.append((key, start + dt.timedelta(minutes=minute), i, rng.randint(0, 2), rng.randint(0, 1)))
    return made


def brute_force(versions):
    last, log = {}, []
    for key, ts, i, a, b in sorted(versions, key=lambda r: (r[1], r[2])):
        if key in last and last[key] != (a, b):
            log.append((key, ts, i, last[key][0], a, last[key][1], b))
        last[key] = (a, b)
    return sorted(log, key=repr)


SCHEMA = "key string, ts timestamp, i int, a int, b int"


def test_feed_matches_brute_force_for_every_chunk(spark):
    versions = feed_rows(900, 1)
    feed = spark.createDataFrame(versions, SCHEMA).repartition(5)
    for chunk in ("minute", "hour", "day", "year"):
        assert rows(history.changes_from_feed(feed, ["key"], ["ts", "i"], ["a", "b"], chunk)) == brute_force(versions)


def test_stream_in_several_batches_agrees_with_the_feed(spark, tmp_path):
    versions = feed_rows(600, 2)
    source, out = tmp_path / "in", str(tmp_path / "out")
    source.mkdir()

    def run():
        stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(str(source))
        writer = stream_changes(stream, ["key"], ["ts", "i"], ["a", "b"], out)
        writer.trigger(availableNow=True).start().awaitTermination()

    for part in range(4):
        piece = spark.createDataFrame(versions[part * 150 : part * 150 + 150], SCHEMA).coalesce(1)
        piece.write.mode("append").parquet(str(source))
        if part in (1, 3):
            run()  # the second run continues from the first one's offsets and state
    stream_log = read_log(out, spark.createDataFrame([], SCHEMA))
    assert rows(stream_log) == brute_force(versions)
    run()
    assert stream_log.count() == len(brute_force(versions))


def test_late_versions_go_apart_and_change_nothing(spark, tmp_path):
    out = str(tmp_path / "out")
    source = tmp_path / "in"

    def arrive(*found):
        moment = dt.datetime(2024, 1, 1)
        batch = [("k", moment + dt.timedelta(hours=h), i, a, 0) for h, i, a in found]
        spark.createDataFrame(batch, SCHEMA).coalesce(1).write.mode("append").parquet(str(source))
        stream = spark.readStream.schema(SCHEMA).parquet(str(source))
        stream_changes(stream, ["key"], ["ts", "i"], ["a", "b"], out).trigger(availableNow=True).start().awaitTermination()

    arrive((1, 1, 10), (5, 2, 20))
    arrive((3, 3, 15), (6, 4, 30))
    arrive((5, 2, 20), (7, 5, 30), (8, 6, 40))
    like = spark.createDataFrame([], SCHEMA)
    assert [(r["old_a"], r["new_a"]) for r in read_log(out, like).orderBy("ts").collect()] == [(10, 20), (20, 30), (30, 40)]
    assert sorted((r["i"], r["a"]) for r in read_late(out, like).collect()) == [(2, 20), (3, 15)]


def test_update_in_place_logs_what_snapshots_log(spark):
    """Keys with a NULL are told apart by their text only, so two rows may be taken for one, in both ways."""
    before = spark.createDataFrame(
        [(1, 2, 10, "a"), (1, 3, 50, "b"), (2, 2, None, "c"), (5, None, 50, "d"), (None, 5, 10, "e"), (None, None, 60, "f"), (7, None, 1, "g")],
        "k long, l long, v int, c string",
    )

    def update(rows):
        dearer = rows.withColumn("v", F.when(F.col("v") > 40, F.col("v") + 1).otherwise(F.col("v")))
        return dearer.withColumn("l", F.when(F.col("v") == 10, F.col("l") + 5).otherwise(F.col("l")))

    noon = F.lit("2024-05-06 12:00:00").cast("timestamp_ntz")
    log = history.changes_in_place(before, update, ["k", "l"], ["v", "l"], ["k", "c"], noon)
    named = before.withColumn("row_id", F.concat_ws("-", F.col("k").cast("string"), F.col("l").cast("string")))
    wanted = history.capture_changes(named, update(named), ["row_id"], ["v", "l"], ["k", "c"], noon)
    assert log.columns == wanted.columns and rows(log) == rows(wanted) and len(rows(log)) > 4


def test_update_in_place_shuffles_no_sound_rows(spark):
    before = spark.range(100).select(F.col("id").alias("k"), F.col("id").alias("l"), F.col("id").cast("int").alias("v"), F.lit("x").alias("c"))
    log = history.changes_in_place(before, lambda df: df.withColumn("v", F.col("v") + 1), ["k", "l"], ["v"], ["k", "c"], F.lit(None).cast("timestamp_ntz"))
    assert log.count() == 100
    assert "Exchange" not in log._jdf.queryExecution().executedPlan().toString()
