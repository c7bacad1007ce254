"""Source divergence audit: how far the word use of the sources of a language is apart, term by term and source by source.

Terms are runs of ASCII letters (lower-cased) and characters beyond ASCII. A language keeps the terms found in at least
``min_docs`` of its documents; each (language, source) group gives every kept term a smoothed share in whole billionths. The
distance of two groups is the sum of the differences of their shares.

Kept terms of a language are numbered, frequent ones first. A group's counts over the numbers form a segment tree whose subtrees
of ``chunk`` terms are work items of their own: all groups of a language meet in a task for one stretch of numbers and never for
more (languages with over ``block`` sources are compared block by block). There nodes are hash-consed: subtrees with the same
counts are one node for all groups, so the long runs of rare terms that sources lack cost one node per level. Two trees are
walked from their roots at the same time; a pair of nodes met again in a walk is not walked again but counted, so each is priced once.
Partial sums of the stretches are added in Spark. Shares are exact: long division by thousands in 64 bits.

Defined results: null texts, languages and sources are ''; a row is a document, so repeated rows count each; a group without terms
has count 0 for each kept term; a language without kept terms has distance 0 between all of its sources; ties are ranked by the
item's UTF-8 bytes; an empty table gives an empty result. Counts of a group may add up to 9 * 10**15. Other columns are ignored.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ovenplan.llm.common import importable, running_total, settled

MIN_DOCS = 30
TOP_TERMS = 50
SMOOTH = 5
CHUNK = 4096
GROUPS = 64
#: Entries that a task counts before it hands them on.
HELD = 250_000
#: Longest stretch of a text that is split into words at once, in bytes.
STRETCH = 1 << 20
#: Rows of a walk's front that are held at once.
FRONT = 1 << 21

# Bytes that belong to no term become blanks; A-Z become a-z. All bytes of characters beyond ASCII are above 127.
LETTERS = bytes(
    c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or c > 127 else 32 for c in range(256)
)


def terms(text: bytes) -> Iterator[list[bytes]]:
    """The terms of a text, a bounded stretch at a time."""
    begin = 0
    while begin < len(text):
        end = begin + STRETCH
        if end < len(text):
            # A stretch ends before a byte of no term; a term longer than the stretch is kept whole.
            while end < len(text) and LETTERS[text[end]] != 32:
                end += 1
        yield text[begin:end].translate(LETTERS).split()
        begin = end


def term_counts(docs: DataFrame) -> DataFrame:
    """(lang, source, text) -> (lang, source, term, n, docs), added up within each task."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[tuple[str, str], tuple[Counter, Counter]] = {}
        held = 0

        def handed_on() -> Iterator[pa.RecordBatch]:
            for (lang, source), (times, found) in counts.items():
                names = list(times)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([lang] * len(names), pa.string()),
                        pa.array([source] * len(names), pa.string()),
                        pa.array(names, pa.binary()).cast(pa.string()),
                        pa.array([times[x] for x in names], pa.int64()),
                        pa.array([found[x] for x in names], pa.int64()),
                    ],
                    names=["lang", "source", "term", "n", "docs"],
                )

        for batch in batches:
            langs, sources = batch.column("lang").to_pylist(), batch.column("source").to_pylist()
            texts = batch.column("text").cast(pa.binary())
            for row in range(batch.num_rows):
                times, found = counts.setdefault((langs[row], sources[row]), (Counter(), Counter()))
                before, seen = len(times), set()
                for some in terms(texts[row].as_py()):
                    times.update(some)
                    seen.update(some)
                found.update(seen)
                held += len(times) - before
                if held > HELD:
                    yield from handed_on()
                    counts, held = {}, 0
        yield from handed_on()

    return docs.mapInArrow(work, "lang string, source string, term string, n long, docs long")


def share(count: Column, total: Column, vocabulary: Column) -> Column:
    """1 + floor(10**9 * (count + SMOOTH) / (total + SMOOTH * vocabulary)), exact while the divisor is below 9 * 10**15."""
    rest, whole = count + SMOOTH, total + SMOOTH * vocabulary
    over = lambda a, b: F.call_function("div", a, b)
    out = over(rest, whole)
    for _ in range(3):
        rest = F.pmod(rest, whole) * 1000
        out = out * 1000 + over(rest, whole)
    return out + 1


def shares(counts: np.ndarray, totals: np.ndarray, vocabulary: int) -> np.ndarray:
    rest, whole = counts + SMOOTH, totals + SMOOTH * vocabulary
    out = rest // whole
    for _ in range(3):
        rest = rest % whole * 1000
        out = out * 1000 + rest // whole
    return out + 1


class Forest:
    """Segment trees over equally many leaves, one per row of ``leaves``; equal subtrees are one node.

    ``levels`` holds, from the leaves' parents to the roots, the left and right child of each node of the level.
    """

    def __init__(self, leaves: np.ndarray):
        self.values, nodes = np.unique(leaves, return_inverse=True)
        nodes = nodes.reshape(leaves.shape)
        self.levels: list[tuple[np.ndarray, np.ndarray]] = []
        while nodes.shape[1] > 1:
            base = int(nodes.max()) + 1
            pairs, found = np.unique(nodes[:, 0::2] * base + nodes[:, 1::2], return_inverse=True)
            self.levels.append((pairs // base, pairs % base))
            nodes = found.reshape(len(leaves), -1)
        self.roots = nodes[:, 0]

    def walk(self, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(walk, leaf value, other leaf value, times) of the node pairs that the walks of trees a[k] and b[k] come to.

        A pair of nodes that a walk meets on several ways stands once in its front, with how often it was met.
        """
        walk, x, y, times = np.arange(len(a)), self.roots[a], self.roots[b], np.ones(len(a), np.int64)
        for left, right in reversed(self.levels):
            base = int(max(left.max(), right.max())) + 1
            key = (np.tile(walk, 2) * base + np.concatenate([left[x], right[x]])) * base + np.concatenate([left[y], right[y]])
            order = np.argsort(key, kind="stable")
            key = key[order]
            first = np.flatnonzero(np.diff(key, prepend=-1))
            times = np.add.reduceat(np.tile(times, 2)[order], first)
            walk, rest = np.divmod(key[first], base * base)
            x, y = np.divmod(rest, base)
        return walk, self.values[x], self.values[y], times


def distances(leaves: np.ndarray, totals: np.ndarray, vocabulary: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Sum of the differences of shares of rows a[k] and b[k]. Leaves of -1 only fill the tree up and cost nothing."""
    forest, out = Forest(leaves), np.zeros(len(a), np.int64)
    step = max(1, FRONT // leaves.shape[1])
    for begin in range(0, len(a), step):
        p, q = a[begin : begin + step], b[begin : begin + step]
        walk, x, y, times = forest.walk(p, q)
        real = x >= 0
        walk, x, y, times = walk[real], x[real], y[real], times[real]
        price = np.abs(shares(x, totals[p][walk], vocabulary) - shares(y, totals[q][walk], vocabulary)) * times
        np.add.at(out, begin + walk, price)
    return out


def _stretch_distances(table: pa.Table, chunk_size: int) -> pa.Table:
    """All pairs of groups that meet in one stretch of numbers: (lang, source, other, value), both ways."""
    rows = table.to_pylist()
    lang, low, high, chunk, vocabulary = (rows[0][c] for c in ("lang", "low", "high", "chunk", "vocabulary"))
    size = min(chunk_size, vocabulary - chunk * chunk_size)
    leaves = np.full((len(rows), 1 << max(0, size - 1).bit_length()), -1, np.int64)
    leaves[:, : max(size, 0)] = 0
    for k, row in enumerate(rows):
        if row["places"]:
            leaves[k, row["places"]] = row["counts"]
    blocks = np.array([row["block"] for row in rows])
    if low == high:
        a, b = np.triu_indices(len(rows), 1)
    else:
        first, second = np.flatnonzero(blocks == low), np.flatnonzero(blocks == high)
        a, b = np.repeat(first, len(second)), np.tile(second, len(first))
    totals = np.array([row["total"] for row in rows], np.int64)
    value = distances(leaves, totals, vocabulary, a, b) if size > 0 else np.zeros(len(a), np.int64)
    names = np.array([row["source"] for row in rows], object)
    one, two = np.concatenate([a, b]), np.concatenate([b, a])
    return pa.table(
        {
            "lang": pa.array([lang] * len(one), pa.string()),
            "source": pa.array(names[one], pa.string()),
            "item": pa.array(names[two], pa.string()),
            "value": pa.array(np.tile(value, 2), pa.int64()),
        }
    )


def audit(
    docs: DataFrame,
    min_docs: int = MIN_DOCS,
    top_terms: int = TOP_TERMS,
    lang_col: str = "lang",
    source_col: str = "source",
    text_col: str = "text",
    chunk: int = CHUNK,
    block: int = GROUPS,
) -> DataFrame:
    """lang, source, part, item, value, rank. Part ``pair``: the distance to each other source of the language, largest first;
    part ``term``: the ``top_terms`` terms that the group uses most beyond the share they have in the language."""
    spark = docs.sparkSession
    importable(spark)
    rows = docs.select(*[F.coalesce(F.col(c), F.lit("")).alias(n) for c, n in ((lang_col, "lang"), (source_col, "source"), (text_col, "text"))])
    # One shuffle by language and term serves the counts per group and the documents per term.
    counted = term_counts(rows).repartition("lang", "term").groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))
    one_term = Window.partitionBy("lang", "term")
    kept = settled(
        counted.withColumns({"lang_docs": F.sum("docs").over(one_term), "lang_n": F.sum("n").over(one_term)})
        .filter(F.col("lang_docs") >= min_docs)
        .select("lang", "source", "term", "n", "lang_n"),
        "audit-counts",
    )
    vocabulary = kept.groupBy("lang", "term").agg(F.max("lang_n").alias("lang_n"))
    numbered = settled(
        running_total(vocabulary.withColumns({"_rare": -F.col("lang_n"), "_one": F.lit(1)}), ["lang", "_rare", "term"], "_one", "place"), "audit-terms"
    )
    langs = numbered.groupBy("lang").agg(F.min("place").alias("begins"), F.count(F.lit(1)).alias("vocabulary"), F.sum("lang_n").alias("lang_total"))
    totals = kept.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    number = F.row_number().over(Window.partitionBy("lang").orderBy("source")) - 1  # one row per source
    groups = settled(
        rows.select("lang", "source").distinct().join(totals, ["lang", "source"], "left").join(langs, "lang", "left")
        .select("lang", "source", *[F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("total", "vocabulary", "lang_total", "begins")])
        .withColumn("block", F.floor(number / block).cast("int")),
        "audit-groups",
    )

    placed = (
        kept.join(numbered.select("lang", "term", "place"), ["lang", "term"])
        .join(langs.select("lang", "begins"), "lang")
        .withColumn("_number", F.col("place") - F.col("begins"))
        .select("lang", "source", F.expr(f"_number div {chunk}").alias("chunk"), (F.col("_number") % chunk).cast("int").alias("at"), "n")
    )
    lists = placed.groupBy("lang", "source", "chunk").agg(F.collect_list(F.struct("at", "n")).alias("_list"))
    blocks = F.max("block").over(Window.partitionBy("lang"))
    spread = (
        groups.withColumn("_last", blocks)
        .withColumn("chunk", F.explode(F.expr(f"sequence(0L, greatest(vocabulary - 1, 0L) div {chunk})")))
        .join(lists, ["lang", "source", "chunk"], "left")
        .withColumn("_other", F.explode(F.sequence(F.lit(0), F.col("_last"))))
        .select(
            "lang", "source", "chunk", "block", "total", "vocabulary", F.least("block", "_other").alias("low"), F.greatest("block", "_other").alias("high"),
            F.col("_list.at").alias("places"), F.col("_list.n").alias("counts"),
        )
    )
    parts = spread.groupBy("lang", "chunk", "low", "high").applyInArrow(
        lambda found: _stretch_distances(found, chunk), "lang string, source string, item string, value long"
    )
    apart = parts.groupBy("lang", "source", "item").agg(F.sum("value").alias("value")).withColumn("part", F.lit("pair"))

    ours, theirs = share(F.col("n"), F.col("total"), F.col("vocabulary")), share(F.col("lang_n"), F.col("lang_total"), F.col("vocabulary"))
    above = (
        kept.join(groups, ["lang", "source"])
        .select("lang", "source", F.col("term").alias("item"), (ours - theirs).alias("value"), F.lit("term").alias("part"))
        .filter("value > 0")
    )
    order = Window.partitionBy("lang", "source", "part").orderBy(F.col("value").desc(), "item")
    ranked = lambda found: found.withColumn("rank", F.row_number().over(order))
    columns = ["lang", "source", "part", "item", "value", "rank"]
    return ranked(apart).select(*columns).unionByName(ranked(above).filter(F.col("rank") <= top_terms).select(*columns))


ORACLE = r"""
WITH docs AS (
    SELECT row_number() OVER () AS d, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
        regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
            '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS terms
    FROM documents
), used AS (
    SELECT d, lang, source, unnest(terms) AS term FROM docs
), kept AS (
    SELECT lang, term, count(*) AS n FROM used GROUP BY lang, term HAVING count(DISTINCT d) >= 30
), counts AS (
    SELECT lang, source, term, count(*) AS n FROM used SEMI JOIN kept USING (lang, term) GROUP BY ALL
), langs AS (
    SELECT lang, count(*) AS v, sum(n) AS total FROM kept GROUP BY lang
), groups AS (
    SELECT g.lang, g.source, coalesce(sum(c.n), 0) AS total
    FROM (SELECT DISTINCT lang, source FROM docs) g LEFT JOIN counts c ON c.lang = g.lang AND c.source = g.source GROUP BY ALL
), shares AS (
    SELECT g.lang, g.source, k.term, coalesce(c.n, 0) AS n,
        1 + CAST(1000000000 AS HUGEINT) * (coalesce(c.n, 0) + 5) // (g.total + 5 * l.v) AS p,
        1 + CAST(1000000000 AS HUGEINT) * (k.n + 5) // (l.total + 5 * l.v) AS q
    FROM groups g JOIN kept k ON k.lang = g.lang JOIN langs l ON l.lang = g.lang
    LEFT JOIN counts c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term
), apart AS (
    SELECT x.lang, x.source, y.source AS item, sum(abs(x.p - y.p)) AS value
    FROM shares x JOIN shares y ON x.lang = y.lang AND x.term = y.term AND x.source <> y.source GROUP BY ALL
), found AS (
    SELECT x.lang, x.source, 'pair' AS part, y.source AS item, coalesce(a.value, 0) AS value
    FROM groups x JOIN groups y ON x.lang = y.lang AND x.source <> y.source
    LEFT JOIN apart a ON a.lang = x.lang AND a.source = x.source AND a.item = y.source
    UNION ALL
    SELECT lang, source, 'term', term, p - q FROM shares WHERE n > 0 AND p > q
), ranked AS (
    SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS rank FROM found
)
SELECT lang, source, part, item, CAST(value AS BIGINT) AS value, CAST(rank AS INTEGER) AS rank FROM ranked WHERE part = 'pair' OR rank <= 50
"""
