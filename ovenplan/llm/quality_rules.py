"""Quality rules whose thresholds come from the corpus: one fence per language and source instead of one fixed cutoff.

Signals of every text are counted with array and string functions. Each signal is turned into a whole number of thousandths and
summarised per language and source by a quantile sketch: counts of values rounded down to ``PRECISION`` leading bits. Such
sketches merge by adding counts, so they are built by partial aggregation, and the sketch of a language (or of everything) is
the sum of those below it. A fence is the median plus ``REACH`` times the distance from the median to the ninth decile, so it
follows how far the upper tail of a group's ordinary texts goes. Groups with few rows take the fence of their language, small
languages that of the corpus. A language's fence is at most half above the corpus's and a group's at most half above its
language's, so a source of mostly junk can't lift its own. The fences are joined back and decide.

Defined results: a null text has no words and fails the base rules; null languages and sources are groups of their own; repeated
rows count each; an empty table gives an empty result. Nothing is sampled, and rounding works on whole numbers, so results
don't depend on the order in which sketches are merged. All columns of the input are kept; those named like a result are replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ovenplan.llm.common import WORD, settled

SYMBOLS = r"[#*$%&|<>]"
PRECISION = 6
MIN_WORDS = 50

# Signal -> least spread, in thousandths. Where the ninth decile is nearer to the median than this, this counts, so that a group in
# which nearly all texts agree doesn't reject the slightest difference.
LEAST_SPREAD = {"symbols": 5, "dup_lines": 50, "repeats": 40}
REACH = 8
MIN_GROUP = 40


def count_signals(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """Add n_words, word_chars, n_symbols, n_lines_worded, n_dup_lines and n_repeat_words (all long) to ``docs``."""
    added = ["n_words", "word_chars", "n_symbols", "n_lines_worded", "n_dup_lines", "n_repeat_words"]
    rows = docs.drop(*added) if text_col not in added else docs
    text = F.coalesce(F.col(text_col), F.lit(""))
    lines = F.filter(F.split(text, "\n", -1), lambda line: line.rlike(WORD))
    split = rows.withColumns({"__words": F.regexp_extract_all(text, F.lit(WORD), F.lit(0)), "__lines": lines})
    # A window's hash and place, sorted by hash: windows found twice stand side by side, and no count needs a shuffle.
    windows = F.when(
        F.size("__words") >= 3,
        F.sort_array(
            F.transform(
                F.sequence(F.lit(0), F.size("__words") - 3),
                lambda i: F.struct(
                    F.xxhash64(F.get("__words", i), F.get("__words", i + 1), F.get("__words", i + 2)).alias("h"), i.alias("i")
                ),
            )
        ),
    )
    sorted_rows = split.withColumn("__windows", windows)
    twice = F.filter(
        "__windows",
        lambda w, k: (w["h"] == F.get("__windows", k - 1)["h"]) | (w["h"] == F.get("__windows", k + 1)["h"]),
    )
    covered = F.size(F.array_distinct(F.flatten(F.transform(twice, lambda w: F.array(w["i"], w["i"] + 1, w["i"] + 2)))))
    return sorted_rows.withColumns(
        {
            "n_words": F.size("__words").cast("long"),
            "word_chars": F.length(F.array_join("__words", "")).cast("long"),
            "n_symbols": F.regexp_count(text, F.lit(SYMBOLS)).cast("long"),
            "n_lines_worded": F.size("__lines").cast("long"),
            "n_dup_lines": (F.size("__lines") - F.size(F.array_distinct("__lines"))).cast("long"),
            "n_repeat_words": F.when(F.size("__words") >= 3, covered).otherwise(0).cast("long"),
        }
    ).drop("__words", "__lines", "__windows")


def _thousandths(part: str, whole: str) -> Column:
    return F.expr(f"{part} * 1000 div greatest({whole}, 1)")


def signal_values() -> dict[str, Column]:
    return {
        "symbols": _thousandths("n_symbols", "word_chars"),
        "dup_lines": _thousandths("n_dup_lines", "n_lines_worded"),
        "repeats": _thousandths("n_repeat_words", "n_words"),
    }


def sketch(values: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, signal, value) -> (keys, signal, bucket, n). A bucket keeps the ``PRECISION`` leading bits of the values in it."""
    extra = F.greatest(F.length(F.bin("value")) - PRECISION, F.lit(0))
    bucket = F.expr("shiftleft(shiftright(value, _extra), _extra)")
    return (
        values.withColumn("_extra", extra)
        .withColumn("bucket", bucket)
        .groupBy(*keys, "signal", "bucket")
        .agg(F.count(F.lit(1)).alias("n"))
    )


def merge_sketches(sketches: DataFrame, keys: list[str]) -> DataFrame:
    return sketches.groupBy(*keys, "signal", "bucket").agg(F.sum("n").alias("n"))


def fences(sketches: DataFrame, keys: list[str], reach: int = REACH, least_spread: dict[str, int] | None = None) -> DataFrame:
    """(keys, signal, rows, fence) from the median and the ninth decile of each sketch."""
    least = F.create_map(*[F.lit(x) for pair in (least_spread or LEAST_SPREAD).items() for x in pair])
    one = Window.partitionBy(*keys, "signal")
    upto = one.orderBy("bucket").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return (
        sketches.withColumns({"_rows": F.sum("n").over(one), "_upto": F.sum("n").over(upto)})
        .groupBy(*keys, "signal")
        .agg(
            F.max("_rows").alias("rows"),
            F.min(F.when(F.col("_upto") * 2 >= F.col("_rows"), F.col("bucket"))).alias("mid"),
            F.min(F.when(F.col("_upto") * 10 >= F.col("_rows") * 9, F.col("bucket"))).alias("high"),
        )
        .select(*keys, "signal", "rows", (F.col("mid") + reach * F.greatest(F.col("high") - F.col("mid"), least[F.col("signal")])).alias("fence"))
    )


def _bounded(fence: Column, above: Column) -> Column:
    """At most half above the fence of the next wider circle."""
    return F.least(fence, F.call_function("div", above * 3, F.lit(2)))


def group_fences(values: DataFrame, min_group: int = MIN_GROUP) -> DataFrame:
    """(lang, source) -> one fence per signal, from the smallest of group, language and corpus that has ``min_group`` rows."""
    groups = settled(sketch(values, ["lang", "source"]), "quality-sketch")
    by_lang = merge_sketches(groups, ["lang"])
    per_group, per_lang, overall = fences(groups, ["lang", "source"]), fences(by_lang, ["lang"]), fences(merge_sketches(by_lang, []), [])
    of_corpus = F.col("o.fence")
    of_lang = F.when(F.col("l.rows") >= min_group, _bounded(F.col("l.fence"), of_corpus)).otherwise(of_corpus)
    chosen = (
        per_group.alias("g")
        .join(per_lang.alias("l"), F.col("g.lang").eqNullSafe(F.col("l.lang")) & (F.col("g.signal") == F.col("l.signal")))
        .join(F.broadcast(overall).alias("o"), F.col("g.signal") == F.col("o.signal"))  # one row per signal
        .select("g.lang", "g.source", "g.signal", F.col("g.rows").alias("rows"), F.col("g.fence").alias("own"), of_lang.alias("above"))
        .withColumn("fence", F.when(F.col("rows") >= min_group, _bounded(F.col("own"), F.col("above"))).otherwise(F.col("above")))
    )
    return chosen.groupBy("lang", "source").agg(
        *[F.max(F.when(F.col("signal") == s, F.col("fence"))).alias(f"{s}_fence") for s in LEAST_SPREAD]
    )


def judge(
    docs: DataFrame,
    lang_col: str = "lang",
    source_col: str = "source",
    text_col: str = "text",
    keep_text: bool = True,
    min_group: int = MIN_GROUP,
) -> DataFrame:
    """``docs`` with its signals, ``base_failed`` and ``kept``.

    The counts are written with the rows, without the text. Without ``keep_text`` the result is made from these; with it the texts are
    read and counted again, which is cheaper than to write and keep a second copy of the corpus.
    """
    counted = count_signals(docs.drop("base_failed", "kept"), text_col)
    counted = counted.withColumn(
        "base_failed", (F.col("n_words") < MIN_WORDS) | (F.col("n_repeat_words") * 100 > F.col("n_words") * 50)
    )
    written = settled(counted.drop(text_col), "quality-signals")
    values = (
        written.filter(~F.col("base_failed"))
        .select(
            F.col(lang_col).alias("lang"),
            F.col(source_col).alias("source"),
            F.explode(F.array(*[F.struct(F.lit(s).alias("signal"), v.alias("value")) for s, v in signal_values().items()])).alias("v"),
        )
        .select("lang", "source", "v.signal", "v.value")
    )
    fence = settled(group_fences(values, min_group), "quality-fences")
    # A number that the verdict reads keeps Spark from pulling the verdict's filter under the counts, which it would then make twice.
    counted = (counted if keep_text else written).withColumn("__row", F.monotonically_increasing_id())
    within = F.col("__row") >= 0
    for s, value in signal_values().items():
        within = within & (value <= F.coalesce(F.col(f"{s}_fence"), value))
    flags = fence.select(F.col("lang").alias("__lang"), F.col("source").alias("__source"), *[f"{s}_fence" for s in LEAST_SPREAD])
    joined = counted.join(
        flags, F.col(lang_col).eqNullSafe(F.col("__lang")) & F.col(source_col).eqNullSafe(F.col("__source")), "left"
    )
    return joined.withColumn("kept", ~F.col("base_failed") & within).drop("__row", "__lang", "__source", *[f"{s}_fence" for s in LEAST_SPREAD])


ORACLE = r"""
WITH split AS (
    SELECT doc_id, lang, source, coalesce(text, '') AS text,
        regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words,
        list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines
    FROM documents
), places AS (
    SELECT doc_id, words, unnest(range(1, len(words) - 1)) AS i FROM split WHERE len(words) >= 3
), windows AS (
    SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, words[i], words[i + 1], words[i + 2]) AS found FROM places
), repeats AS (
    SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest([i, i + 1, i + 2]) AS p FROM windows WHERE found > 1) GROUP BY doc_id
), counted AS (
    SELECT s.doc_id, lang, source, CAST(len(words) AS BIGINT) AS n_words,
        CAST(length(array_to_string(words, '')) AS BIGINT) AS word_chars,
        CAST(len(regexp_extract_all(text, '[#*$%&|<>]')) AS BIGINT) AS n_symbols,
        CAST(len(lines) AS BIGINT) AS n_lines, CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines,
        CAST(coalesce(r.n, 0) AS BIGINT) AS n_repeat_words
    FROM split s LEFT JOIN repeats r USING (doc_id)
), based AS (
    SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
        1000 * n_symbols // greatest(word_chars, 1) AS symbols, 1000 * n_dup_lines // greatest(n_lines, 1) AS dup_lines,
        1000 * n_repeat_words // greatest(n_words, 1) AS repeats
    FROM counted
), vals AS (
    SELECT lang, source, signal, v, greatest(length(bin(v)) - 6, 0) AS e
    FROM (SELECT lang, source, unnest(['symbols', 'dup_lines', 'repeats']) AS signal, unnest([symbols, dup_lines, repeats]) AS v
          FROM based WHERE NOT base_failed)
), sketches AS (
    SELECT level, CASE WHEN level < 2 THEN coalesce('=' || lang, '') END AS lang_key,
        CASE WHEN level < 1 THEN coalesce('=' || source, '') END AS source_key, signal, (v >> e) << e AS bucket, count(*) AS n
    FROM vals, (SELECT unnest([0, 1, 2]) AS level) GROUP BY ALL
), runs AS (
    SELECT *, sum(n) OVER (PARTITION BY level, lang_key, source_key, signal) AS rows,
        sum(n) OVER (PARTITION BY level, lang_key, source_key, signal ORDER BY bucket) AS upto
    FROM sketches
), marks AS (
    SELECT level, lang_key, source_key, signal, max(rows) AS rows,
        min(bucket) FILTER (WHERE upto * 2 >= rows) AS mid, min(bucket) FILTER (WHERE upto * 10 >= rows * 9) AS high
    FROM runs GROUP BY ALL
), fences AS (
    SELECT level, lang_key, source_key, signal, rows,
        mid + 8 * greatest(high - mid, CASE signal WHEN 'symbols' THEN 5 WHEN 'dup_lines' THEN 50 ELSE 40 END) AS fence
    FROM marks
), chosen AS (
    SELECT g.lang_key, g.source_key, g.signal,
        CASE WHEN g.rows >= 40 THEN least(g.fence, w.fence * 3 // 2) ELSE w.fence END AS fence
    FROM fences g
    JOIN (
        SELECT l.lang_key, l.signal, CASE WHEN l.rows >= 40 THEN least(l.fence, o.fence * 3 // 2) ELSE o.fence END AS fence
        FROM fences l JOIN fences o ON o.level = 2 AND o.signal = l.signal WHERE l.level = 1
    ) w ON w.lang_key = g.lang_key AND w.signal = g.signal
    WHERE g.level = 0
)
SELECT b.doc_id, b.n_words, b.word_chars, b.n_symbols, b.n_dup_lines, b.n_repeat_words, b.base_failed,
    NOT b.base_failed AND b.symbols <= coalesce(s.fence, b.symbols) AND b.dup_lines <= coalesce(d.fence, b.dup_lines)
        AND b.repeats <= coalesce(r.fence, b.repeats) AS kept
FROM based b
LEFT JOIN chosen s ON s.signal = 'symbols' AND s.lang_key = coalesce('=' || b.lang, '') AND s.source_key = coalesce('=' || b.source, '')
LEFT JOIN chosen d ON d.signal = 'dup_lines' AND d.lang_key = coalesce('=' || b.lang, '') AND d.source_key = coalesce('=' || b.source, '')
LEFT JOIN chosen r ON r.signal = 'repeats' AND r.lang_key = coalesce('=' || b.lang, '') AND r.source_key = coalesce('=' || b.source, '')
"""
