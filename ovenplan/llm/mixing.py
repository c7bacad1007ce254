"""Mixing sources to target weights along a curriculum.

Each source has a target number of words and a schedule: its relative weight at points of training time. The integral of the
schedule is the source's cumulative demand; inverting it turns the place of a document's words in its source's stream into a
training position, and documents are range-sorted by it.

Shares: sources by code point (null last) weigh 5, 2, 1, repeating. The total of all words is shared by weight; a target stops at
``max_repeats`` times its source's words and the excess is shared anew by weight until none is above (one level for all sources
that are not full). A source's documents, in the order of a hash of their id, are all taken floor(target / size) times, and those
that begin the order once more until the target is met, so the words taken miss the target by at most half a document.

Defined results: a null text has size 0; a source without any word takes every document once (0 words). Rows are mixed one by
one, so repeated rows count each; ties of the hash are ordered by id, then size. An empty table gives an empty result. Only the
id, text and source are read. Nothing is random: reruns agree.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ovenplan.llm.common import running_total, settled, shuffle_width, word_count

# Weights by the place of a source in the order, and for each weight the schedule: (training time, relative weight).
WEIGHTS = (5, 2, 1)
SCHEDULES = (
    ((0.0, 1.5), (0.5, 1.0), (1.0, 0.5)),
    ((0.0, 1.0), (1.0, 1.0)),
    ((0.0, 0.5), (0.5, 1.0), (1.0, 1.5)),
)


def _demand_time(schedule: tuple[tuple[float, float], ...], share: Column) -> Column:
    """The training time at which the integral of ``schedule`` reaches ``share`` of its whole."""
    pieces, reached = [], 0.0
    for (t0, w0), (t1, w1) in zip(schedule, schedule[1:], strict=False):
        area = (w0 + w1) / 2 * (t1 - t0)
        pieces.append((t0, t1, w0, w1, reached, reached + area))
        reached += area
    time = F.lit(schedule[-1][0])
    for t0, t1, w0, w1, begins, ends in reversed(pieces):
        rest = share * reached - begins
        slope = (w1 - w0) / (t1 - t0)
        # w0 * x + slope / 2 * x * x = rest, in a form that also holds for a slope of 0
        x = 2 * rest / (w0 + F.sqrt(F.greatest(F.lit(w0 * w0) + 2 * slope * rest, F.lit(0.0))))
        time = F.when(share * reached <= ends, t0 + x).otherwise(time)
    return time


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, max_repeats: int = 3) -> DataFrame:
    """(source, source_size) -> also rank, weight, target. One row per source; the windows run over sources, not documents."""
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    rank = F.row_number().over(by_name) - 1
    ranked = sizes.withColumn("source_rank", rank).withColumn(
        "weight", F.element_at(F.array(*map(F.lit, weights)), (F.col("source_rank") % len(weights) + 1).cast("int"))
    )
    fill = [(F.lit(float(max_repeats)) * F.col("source_size")) / F.col("weight"), F.col("source_rank")]
    before = Window.orderBy(*fill).rowsBetween(Window.unboundedPreceding, -1)
    onward = Window.orderBy(*fill).rowsBetween(Window.currentRow, Window.unboundedFollowing)
    whole = Window.partitionBy()
    level = (
        F.sum("source_size").over(whole) - F.coalesce(F.sum(F.col("source_size") * max_repeats).over(before), F.lit(0))
    ).cast("double") / F.sum("weight").over(onward)
    leveled = ranked.withColumns({"_fill": fill[0], "_level": level})
    # The sources fill up in the order of _fill; the level is final at the first source that it doesn't fill.
    final = F.min_by(F.when(F.col("_level") <= F.col("_fill"), F.col("_level")), F.struct(F.col("_level") > F.col("_fill"), "_fill", "source_rank"))
    return (
        leveled.withColumn("_final", final.over(whole))
        .withColumn("target", F.least(F.col("_final") * F.col("weight"), F.lit(float(max_repeats)) * F.col("source_size")))
        .select("source", "source_size", "source_rank", "weight", F.coalesce("target", F.lit(0.0)).alias("target"))
    )


def plan_mix(
    docs: DataFrame,
    weights: tuple[int, ...] = WEIGHTS,
    schedules: tuple = SCHEDULES,
    max_repeats: int = 3,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    keep: tuple[str, ...] = (),
) -> DataFrame:
    """One row per document: doc_id, source, size, source_size, target, copies, taken and ``positions`` (one per copy).

    ``keep`` names further columns of ``docs`` to carry along.
    """
    sized = docs.select(
        F.col(id_col).alias("doc_id"),
        F.col(source_col).alias("source"),
        word_count(F.col(text_col)).alias("size"),
        *[F.col(c).alias(f"_keep_{c}") for c in keep],
    )
    totals = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    targets = settled(source_targets(totals, weights, max_repeats), "mix-targets")
    shuffled = sized.alias("d").join(targets.alias("t"), F.col("d.source").eqNullSafe(F.col("t.source"))).select(
        "d.*", "source_rank", "source_size", "target", F.md5(F.coalesce(F.col("d.doc_id").cast("string"), F.lit(""))).alias("_shuffle")
    )
    placed = running_total(shuffled, ["source_rank", "_shuffle", "doc_id", "size"], "size", "_before")
    earlier = Window.orderBy("source_rank").rowsBetween(Window.unboundedPreceding, -1)
    starts = targets.select("source_rank", F.coalesce(F.sum("source_size").over(earlier), F.lit(0)).alias("_begin"))
    times = F.col("target") / F.col("source_size")
    extra = F.col("_before") + F.col("size") / 2.0 < (times - F.floor(times)) * F.col("source_size")
    copies = F.when(F.col("source_size") == 0, F.lit(1)).otherwise(
        F.least(F.lit(max_repeats).cast("long"), F.floor(times) + F.when(extra, 1).otherwise(0))
    )
    planned = placed.join(starts, "source_rank").withColumn("_before", F.col("_before") - F.col("_begin")).withColumn("copies", copies.cast("long"))

    def position(copy: Column) -> Column:
        place = copy * F.col("source_size") + F.col("_before") + F.col("size") / 2.0
        share = F.when(F.col("target") > 0, F.least(place / F.col("target"), F.lit(1.0))).otherwise(F.lit(0.0))
        kind = F.col("source_rank") % len(weights)
        time = _demand_time(schedules[-1], share)
        for k in range(len(weights) - 1):
            time = F.when(kind == k, _demand_time(schedules[k], share)).otherwise(time)
        return time

    passes = F.array(*[F.when(F.col("copies") > c, position(F.lit(c).cast("long"))) for c in range(max_repeats)])
    return planned.select(
        "doc_id",
        "source",
        "size",
        "source_size",
        "target",
        "copies",
        (F.col("copies") * F.col("size")).alias("taken"),
        F.slice(passes, F.lit(1), F.col("copies").cast("int")).alias("positions"),
        *[f"_keep_{c}" for c in keep],
    )


def range_sorted(rows: DataFrame, *order: str) -> DataFrame:
    """A total order over partitions: earlier partitions hold the earlier rows, each sorted."""
    return rows.repartitionByRange(shuffle_width(rows.sparkSession), *order).sortWithinPartitions(*order)


def training_order(plan: DataFrame) -> DataFrame:
    """One row per copy that the mix takes, with its ``position``, range-sorted by it."""
    return range_sorted(plan.withColumn("position", F.explode("positions")).drop("positions"), "position", "doc_id")


def mixed_documents(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: tuple[int, ...] = WEIGHTS, max_repeats: int = 3
) -> DataFrame:
    """``docs`` as the mix takes them: each row as often as it is taken, no row that isn't, all columns, in training order.

    The plan is made without the texts and joined back by id, source and a hash of the text. Rows that agree in all of these are
    interchangeable; if there are any, both sides number them.
    """
    marked = docs.withColumn("__hash", F.xxhash64(text_col))
    keys = ["doc_id", "source", "_keep___hash"]
    plan = settled(plan_mix(marked, weights, max_repeats=max_repeats, id_col=id_col, text_col=text_col, source_col=source_col, keep=("__hash",)), "mix-plan")
    repeated = not plan.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).filter("n > 1").isEmpty()
    number = lambda *by: F.row_number().over(Window.partitionBy(*by).orderBy(by[0])) if repeated else F.lit(1)
    copies = plan.withColumn("__number", number(*keys)).select(
        F.col("doc_id").alias("_id"), F.col("source").alias("_source"), F.col("_keep___hash").alias("_plan_hash"), F.col("__number").alias("_plan_number"),
        F.explode("positions").alias("_position"),
    )
    rows = marked.withColumn("__number", number(id_col, source_col, "__hash"))
    joined = rows.join(
        copies,
        rows[id_col].eqNullSafe(F.col("_id"))
        & rows[source_col].eqNullSafe(F.col("_source"))
        & (F.col("__hash") == F.col("_plan_hash"))
        & (F.col("__number") == F.col("_plan_number")),
    )
    return range_sorted(joined, "_position", "__hash").select(*[docs[c] for c in docs.columns])


ORACLE = r"""
WITH sized AS (
    SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS size FROM documents
), totals AS (
    SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM sized GROUP BY source
), ranked AS (
    SELECT *, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS place FROM totals
), weighed AS (
    SELECT *, CASE place % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS weight FROM ranked
), filled AS (
    SELECT *, 3.0::DOUBLE * source_size / weight AS full_at FROM weighed
), leveled AS (
    SELECT *,
        CAST(sum(source_size) OVER () - coalesce(sum(3 * source_size) OVER (
            ORDER BY full_at, place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS DOUBLE)
        / CAST(sum(weight) OVER (ORDER BY full_at, place ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS DOUBLE) AS level
    FROM filled
), final AS (
    SELECT level FROM leveled WHERE level <= full_at ORDER BY full_at, place LIMIT 1
), targets AS (
    SELECT l.source, l.place, l.source_size, least(f.level * l.weight, 3.0::DOUBLE * l.source_size) AS target FROM leveled l, final f
), placed AS (
    SELECT s.doc_id, s.size, t.place, t.source_size, t.target,
        coalesce(sum(s.size) OVER (PARTITION BY s.source ORDER BY md5(CAST(s.doc_id AS VARCHAR)), s.doc_id, s.size
            ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
    FROM sized s JOIN targets t ON s.source IS NOT DISTINCT FROM t.source
), counted AS (
    SELECT *, CASE WHEN source_size = 0 THEN 1 ELSE least(3, floor(target / source_size)
        + CASE WHEN CAST(before AS DOUBLE) + size / 2.0::DOUBLE < (target / source_size - floor(target / source_size)) * source_size
          THEN 1 ELSE 0 END) END AS copies
    FROM placed
)
SELECT doc_id, CAST(size AS BIGINT) AS size, source_size, target, CAST(copies * size AS BIGINT) AS taken,
    CAST(floor(CASE
        WHEN copies = 0 THEN NULL
        WHEN target <= 0 THEN 0
        WHEN place % 3 = 0 AND share <= 0.625 THEN 2 * share / (1.5 + sqrt(2.25 - 2 * share))
        WHEN place % 3 = 0 THEN 0.5 + 2 * (share - 0.625) / (1 + sqrt(1 - 2 * (share - 0.625)))
        WHEN place % 3 = 1 THEN share
        WHEN share <= 0.375 THEN 2 * share / (0.5 + sqrt(0.25 + 2 * share))
        ELSE 0.5 + 2 * (share - 0.375) / (1 + sqrt(1 + 2 * (share - 0.375)))
        END * 1000000) AS BIGINT) AS first_ppm
FROM (SELECT *, least((before + size / 2.0::DOUBLE) / target, 1.0::DOUBLE) AS share FROM counted)
"""
