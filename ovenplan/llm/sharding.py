"""Sharding by balanced label propagation.

Documents with equal texts are linked. Linked documents start spread evenly over the shards; in each round every block of linked
documents of a group that share a shard asks to move to the open shard that holds more of its group than its own does, the one
with most of it first (ties by hash, so that two parts don't swap); quotas admit movers as long as the shard has room. Rounds end
when nothing moves, or when ``max_rounds`` rounds in a row leave no fewer groups cut. Documents without links are then poured into
the room that is left, so sizes come out near equal while few links are cut.

Rounds work on one row per block (group and shard), made before any shuffle of rows, so a group with a third of all documents is
a few rows. A group that can't fit in one shard is split by a hash into pieces of at most an eighth of a shard, which are drawn to
the shards of their siblings. A group of an eighth of a shard or more also asks for shards that have room for all of it. There are
at most eight such groups per shard; they settle first, largest first.

Law ``bytes``: sizes near equal (UTF-8 bytes of the text plus ``overhead``). Defined results: a null text counts as empty; rows
with the same id and text are separate documents of one group; with fewer documents than shards some shards stay empty; an empty
table gives an empty result. Only the id and text columns are read. Ties go by hash, then shard; reruns agree.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ovenplan.llm.common import running_total, settled

# With more blocks per shard than this, quotas are given out by a running total over ranges instead of one window per shard. Both
# admit the same blocks; the window is quicker where it holds few.
BLOCKS_PER_QUOTA = 20_000


def _deal(rows: DataFrame, order: list[str], total: int, shards: int) -> DataFrame:
    """Cut the running bytes of ``rows`` into ``shards`` equal lengths."""
    placed = running_total(rows, order, "size", "_before")
    middle = (F.col("_before") + F.col("size") / 2.0) * shards / float(max(total, 1))
    return placed.withColumn("shard", F.least(F.floor(middle), F.lit(shards - 1)).cast("int")).drop("_before")


def _one_round(blocks: DataFrame, shards: DataFrame, capacity: float, wide: bool, big_from: float, big: bool) -> DataFrame:
    """(grp, piece, origin, shard, mass) -> the same with ``moves``. Only ``big`` groups, or only the others, move.

    A shard's room goes to those that ask for it in order, largest first, as far as their running total goes. With ``wide`` that total
    runs over a range-sorted table, so that no task holds all blocks that ask for a shard.
    """
    load = blocks.groupBy("shard").agg(F.sum("mass").alias("load"))
    room = shards.join(load, "shard", "left").select("shard", (F.lit(capacity) - F.coalesce("load", F.lit(0))).alias("room"))
    kin = blocks.groupBy("grp", "shard").agg(F.sum("mass").alias("kin"))
    sizes = kin.groupBy("grp").agg(F.sum("kin").alias("all"), F.count(F.lit(1)).alias("_parts"))
    torn = sizes.filter("_parts > 1").filter((F.col("all") >= big_from) if big else (F.col("all") < big_from)).select("grp", "all")
    # Where a group could be: the shards that hold a part of it; a big one anywhere.
    places = torn.crossJoin(F.broadcast(room)) if big else torn.join(kin.select("grp", "shard"), "grp").join(F.broadcast(room), "shard")
    placed = places.join(kin, ["grp", "shard"], "left").withColumn("kin", F.coalesce("kin", F.lit(0)))
    rank = F.struct(
        ((F.col("room") + F.col("kin")) >= F.col("all")).alias("fits"), "kin", F.xxhash64("grp", "shard").alias("tie"), "shard", "room"
    )
    options = placed.groupBy("grp", "all").agg(F.collect_list(rank).alias("_options"))  # one entry per shard at most
    asked = blocks.join(options, "grp", "left")
    here = F.element_at(F.filter("_options", lambda x: x["shard"] == F.col("shard")), 1)
    better = F.filter(
        "_options",
        lambda x: (x["room"] >= F.col("mass")) & (F.struct(x["fits"], x["kin"], x["tie"]) > F.struct(F.col("_here.fits"), F.col("_here.kin"), F.col("_here.tie"))),
    )
    asked = asked.withColumn("_here", F.when(F.size("_options") > 0, here)).withColumn("_to", F.array_max(F.transform(better, lambda x: x)))
    turn = {
        "_turn": -F.col("all") if big else -F.col("mass"),
        "_group": F.xxhash64("grp"),
        "_less": -F.col("mass"),
        "_tie": F.xxhash64("grp", "piece", "origin"),
    }
    asking = asked.filter("_to is not null").withColumns({"_wish": F.col("_to.shard"), "_room": F.col("_to.room"), **turn})
    asking = asking.select("grp", "piece", "origin", "mass", "_wish", "_room", *turn)
    order = [*turn, "origin"]
    if wide:
        placed = running_total(asking, ["_wish", *order], "mass", "_before")
        starts = placed.groupBy("_wish").agg(F.min("_before").alias("_start"))  # one row per shard
        summed = placed.join(F.broadcast(starts), "_wish").withColumn("_sum", F.col("_before") - F.col("_start") + F.col("mass"))
    else:
        queue = Window.partitionBy("_wish").orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
        summed = asking.withColumn("_sum", F.sum("mass").over(queue))
    moving = summed.filter(F.col("_sum") <= F.col("_room")).select("grp", "piece", "origin", "_wish")
    return blocks.select("grp", "piece", "origin", "shard", "mass").join(moving, ["grp", "piece", "origin"], "left").select(
        "grp", "piece", "origin", F.coalesce("_wish", "shard").alias("shard"), "mass", F.isnotnull("_wish").alias("moves")
    )


def assign_shards(
    docs: DataFrame,
    shards: int = 40,
    slack: float = 0.01,
    max_rounds: int = 6,
    overhead: int = 16,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """doc_id, size, text_crc32, grp (hash of the text), shard, slot (gapless from 0 in each shard)."""
    spark = docs.sparkSession
    text = F.coalesce(F.col(text_col), F.lit(""))
    base = docs.select(
        F.col(id_col).alias("doc_id"),
        (F.octet_length(text) + overhead).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
        F.md5(text).alias("grp"),
        F.md5(F.coalesce(F.col(id_col).cast("string"), F.lit(""))).alias("spread"),
    )
    base = settled(base, "shard-input")
    total = base.agg(F.sum("size")).first()[0] or 0
    share = total / shards
    groups = settled(base.groupBy("grp").agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("all")).filter("n > 1"), "shard-groups")
    # Only a group that no shard can hold is split; a piece holds at most about an eighth of a shard. Its key follows the document,
    # so the split needs no order.
    pieces = F.when(F.col("all") <= share, 1).otherwise(F.ceil(F.col("all") / F.lit(max(share / 8, 1.0))))
    linked = base.join(groups.select("grp", pieces.alias("_pieces")), "grp").select(
        base["*"], F.pmod(F.xxhash64("spread"), F.col("_pieces")).cast("int").alias("piece")
    )
    single = base.join(groups, "grp", "left_anti")
    linked_bytes = groups.agg(F.sum("all")).first()[0] or 0
    order = ["spread", "grp", "doc_id"]
    start = settled(_deal(linked, order, linked_bytes, shards), "shard-start")

    all_shards = spark.range(shards).select(F.col("id").cast("int").alias("shard"))
    blocks = settled(start.groupBy("grp", "piece", F.col("shard").alias("origin")).agg(F.sum("size").alias("mass")).withColumn("shard", F.col("origin")), "blocks")
    wide = blocks.count() > shards * BLOCKS_PER_QUOTA
    # Linked documents alone may fill a shard up to its share and a little over; the others fill up what is left.
    for big in (True, False):
        least, idle = None, 0
        while idle < max_rounds:
            blocks = settled(_one_round(blocks, all_shards, share * (1 + slack), wide and not big, share / 8, big), "blocks")
            if blocks.filter("moves").isEmpty():
                break
            cut = blocks.select("grp", "shard").distinct().count()
            least, idle = (cut, 0) if least is None or cut < least else (least, idle + 1)
    homes = blocks.select("grp", "piece", F.col("origin").alias("shard"), F.col("shard").alias("home"))
    settled_linked = start.join(homes, ["grp", "piece", "shard"]).select("doc_id", "size", "text_crc32", "grp", "spread", F.col("home").alias("shard"))

    # Pour the rest: shard s takes the stretch of their running bytes that its room covers.
    load = blocks.groupBy("shard").agg(F.sum("mass").alias("load"))
    room = all_shards.join(load, "shard", "left").select("shard", F.greatest(F.lit(0.0), F.lit(share) - F.coalesce("load", F.lit(0))).alias("room"))
    rooms = {r["shard"]: r["room"] for r in room.collect()}  # one number per shard
    ends, reached, whole = [], 0.0, sum(rooms.values()) or 1.0
    for s in range(shards):
        reached += rooms[s]
        ends.append(reached * (total - linked_bytes) / whole)
    placed = running_total(single, order, "size", "_before")
    middle = F.col("_before") + F.col("size") / 2.0
    # The first shard whose stretch ends beyond the document's middle.
    found = F.least(F.size(F.filter(F.array(*map(F.lit, ends)), lambda end: end <= middle)), F.lit(shards - 1))
    poured = placed.select("doc_id", "size", "text_crc32", "grp", "spread", found.cast("int").alias("shard"))

    located = settled_linked.unionByName(poured).withColumn("_one", F.lit(1).cast("long"))
    numbered = settled(running_total(located, ["shard", "spread", "grp", "doc_id"], "_one", "_row"), "shard-slots")
    counts = numbered.groupBy("shard").agg(F.min("_row").alias("_first"))
    return numbered.join(F.broadcast(counts), "shard").select(  # one row per shard
        "doc_id", "size", "text_crc32", "grp", "shard", (F.col("_row") - F.col("_first")).cast("long").alias("slot")
    )
