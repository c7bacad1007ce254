"""Line dedup: drop the lines that many documents share.

Lines are exploded with the hash of their key, documents are counted per hash, and lines over the threshold are dropped where
they stand. The lines' text never leaves its document: only hashes and positions are shuffled, and each document gets back the
positions that it loses. Its lines are split once and a mark per line says which go, so a document costs time in proportion to its
lines, however many there are and go.

Defined results: a null or empty text is one empty line. A line's key has blanks stripped at both ends and A-Z lower-cased;
a key shorter than ``min_chars`` never goes. Rows with the same id count as one document, but each row is edited by itself, so
repeated rows get the same answer. Null ids count as one document. An empty table gives an empty result. Other columns of the
input are kept or ignored whatever their names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ovenplan.llm.common import settled

BLANK_CHARS = " \t\n\x0b\f\r"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def _lines(text: F.Column) -> F.Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def stripped(line: F.Column) -> F.Column:
    return F.btrim(line, F.lit(BLANK_CHARS))


def line_key(line: F.Column) -> F.Column:
    return F.translate(stripped(line), UPPER, UPPER.lower())


def _numbered_keys(docs: DataFrame, id_col: str, text_col: str, min_chars: int) -> DataFrame:
    """id, hash of the text, position and 128-bit hash of the key of every line long enough to be dropped."""
    lines = docs.select(
        F.col(id_col).alias("__id"),
        F.xxhash64(text_col).alias("__text"),
        F.posexplode(_lines(F.col(text_col))).alias("_pos", "_line"),
    )
    key = line_key(F.col("_line"))
    return lines.filter(F.length(stripped(F.col("_line"))) >= min_chars).select(
        "__id", "__text", "_pos", F.xxhash64(key).alias("_h1"), F.xxhash64(F.lit(1), key).alias("_h2")
    )


def shared_lines(docs: DataFrame, min_docs: int, min_chars: int = 1, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Hashes of the line keys found in at least ``min_docs`` documents, with the count. Combined before each shuffle."""
    keys = _numbered_keys(docs, id_col, text_col, min_chars)
    return (
        keys.groupBy("_h1", "_h2", "__id")
        .agg(F.lit(1).alias("_one"))
        .groupBy("_h1", "_h2")
        .agg(F.count(F.lit(1)).alias("_docs"))
        .filter(F.col("_docs") >= min_docs)
    )


def drop_shared_lines(
    docs: DataFrame, min_docs: int = 10, min_chars: int = 1, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """All columns of ``docs`` with the text cut to the lines that stay, then ``n_lines`` and ``n_dropped``.

    The list of shared lines is written before it is joined: both sides of that join are then plain shuffles, so adaptive
    execution can split a line that a third of all documents hold. ``n_lines`` and ``n_dropped`` replace columns of that name.
    """
    shared = settled(shared_lines(docs, min_docs, min_chars, id_col, text_col).select("_h1", "_h2"), "shared-lines")
    dropped = (
        _numbered_keys(docs, id_col, text_col, min_chars)
        .join(shared, ["_h1", "_h2"], "left_semi")
        .groupBy("__id", "__text")
        .agg(F.collect_set("_pos").alias("__gone"))
    )
    rows = docs.withColumns({"__id": F.col(id_col), "__text": F.xxhash64(text_col)})
    joined = rows.alias("d").join(
        dropped.alias("x"),
        F.col("d.__id").eqNullSafe(F.col("x.__id")) & (F.col("d.__text") == F.col("x.__text")),
        "left",
    )
    kept = [c for c in docs.columns if c not in (text_col, "n_lines", "n_dropped")]
    # What is used several times in the step after is computed once per row: the arrays here, then a byte per line up to the last lost one.
    split = joined.select(
        *[F.col(f"d.{c}") for c in kept],
        F.col(f"d.{text_col}").alias("__text"),
        _lines(F.col(f"d.{text_col}")).alias("__lines"),
        F.array_sort("__gone").alias("__gone"),
    )
    lines, gone, marks = F.col("__lines"), F.col("__gone"), F.col("__marks")
    stretch = lambda at, k: F.concat(F.repeat(F.lit("0"), at - F.coalesce(F.get(gone, k - 1), F.lit(-1)) - 1), F.lit("1"))
    split = split.withColumn("__marks", F.array_join(F.transform(gone, stretch), "").cast("binary"))
    stay = F.filter(lines, lambda line, k: F.substring(marks, k + 1, F.lit(1)) != F.lit(b"1"))
    text = F.when(marks.isNull(), F.coalesce("__text", F.lit(""))).otherwise(F.array_join(stay, "\n"))
    return split.select(
        *kept,
        text.alias(text_col),
        F.size(lines).cast("long").alias("n_lines"),
        F.coalesce(F.size(gone), F.lit(0)).cast("long").alias("n_dropped"),
    )


ORACLE = r"""
WITH lines AS (
    SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
           generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos
    FROM documents
), keyed AS (
    SELECT doc_id, pos, line,
           translate(regexp_replace(line, '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g'),
                     'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k
    FROM lines
), shared AS (
    SELECT k FROM keyed WHERE length(k) >= 1 GROUP BY k HAVING count(DISTINCT doc_id) >= 10
)
SELECT doc_id, count(*) AS n_lines,
       count(*) FILTER (WHERE k IN (SELECT k FROM shared)) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE k NOT IN (SELECT k FROM shared)), '')) AS kept_sha256
FROM keyed
GROUP BY doc_id
"""
