"""Fill-in-middle: cut a text at two token boundaries and move the middle to the end.

A text is cut into tokens (blanks with the word after them; blanks at the end alone). Its boundaries are the code point offsets at
which tokens end, 0 first. A cut is named by its rank among them, and the offset of a rank comes from a learned index: straight
segments, each begun where the one before can no longer stay within ``ERROR`` of every boundary, are fitted to all boundaries of
the text. The segment of a rank predicts its offset, and the stored residual (one byte, as the error is bounded) makes it exact.

Cuts, whether a text is changed and in which order follow from a hash of the seed and the id alone, so reruns agree and nothing is
shuffled: every text is handled where it is read, whole.

Defined results: a null text is empty; empty texts and texts that hold a marker stay as they are (form ``plain``); a null id is
hashed as an empty string; repeated rows get the same answer; an empty table gives an empty result. Other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ovenplan.llm.common import importable

MARKS = ("<P>", "<S>", "<M>")
ERROR = 127
RESULT = (
    "doc_id {id}, n long, form string, prefix_chars long, middle_chars long, output string, "
    "segments array<struct<rank:long,offset:long,slope:double>>, residuals binary"
)


def boundaries(text: str) -> np.ndarray:
    """Offsets, in code points, of all token ends, after a 0."""
    points = np.frombuffer(text.encode("utf-32-le"), "<u4")
    inside = (points != 32) & ((points < 9) | (points > 13))
    ends = np.flatnonzero(inside & ~np.append(inside[1:], False)) + 1
    if len(points) and not inside[-1]:
        ends = np.append(ends, len(points))
    return np.concatenate([[0], ends]).astype(np.int64)


@dataclass(frozen=True)
class RankIndex:
    """Offset of every rank: first rank, first offset and slope of each segment, and a residual per rank."""

    ranks: np.ndarray
    offsets: np.ndarray
    slopes: np.ndarray
    residuals: np.ndarray

    def predict(self, rank: np.ndarray) -> np.ndarray:
        at = np.searchsorted(self.ranks, rank, "right") - 1
        return self.offsets[at] + np.rint(self.slopes[at] * (rank - self.ranks[at])).astype(np.int64)

    def offset(self, rank: np.ndarray) -> np.ndarray:
        return self.predict(rank) + self.residuals[rank]


def fit(offsets: np.ndarray, error: int = ERROR) -> RankIndex:
    """Greedy segments through their first point: the slopes that keep all points so far within ``error`` form a cone, and a
    segment ends before the point that empties it. The window that is tried doubles while the cone stays open."""
    starts, slopes, begin, n = [], [], 0, len(offsets)
    margin = error - 0.5  # predictions are rounded
    while begin < n:
        width, low, high, end = 1024, -np.inf, np.inf, begin + 1
        while end < n:
            stop = min(n, end + width)
            run = np.arange(end - begin, stop - begin, dtype=np.float64)
            rise = (offsets[end:stop] - offsets[begin]).astype(np.float64)
            lows = np.maximum(np.maximum.accumulate((rise - margin) / run), low)
            highs = np.minimum(np.minimum.accumulate((rise + margin) / run), high)
            shut = np.flatnonzero(lows > highs)
            inside = int(shut[0]) if shut.size else stop - end
            if inside:
                low, high = lows[inside - 1], highs[inside - 1]
            end += inside
            if shut.size:
                break
            width *= 2
        starts.append(begin)
        slopes.append((low + high) / 2 if end > begin + 1 else 0.0)
        begin = end
    first = np.array(starts, np.int64)
    index = RankIndex(first, offsets[first], np.array(slopes), np.zeros(n, np.int8))
    residuals = offsets - index.predict(np.arange(n))
    if np.abs(residuals).max() > error:
        raise ArithmeticError("a segment leaves its error bound")
    return RankIndex(index.ranks, index.offsets, index.slopes, residuals.astype(np.int8))


def draws(doc_id: int | None, seed: int) -> tuple[int, int, int, int]:
    """Four unsigned 32-bit numbers that the seed and the id give."""
    digest = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).digest()
    return tuple(int.from_bytes(digest[4 * k : 4 * k + 4], "big") for k in range(4))


def cut(text: str, doc_id: int | None, seed: int, rate: int, suffix_first: int) -> tuple[str, str, tuple[int, int] | None, RankIndex]:
    """(form, output, code points of prefix and middle, index) of one text."""
    index = fit(boundaries(text))
    h1, h2, h3, h4 = draws(doc_id, seed)
    if not text or h3 % 100 >= rate or any(mark in text for mark in MARKS):
        return "plain", text, None, index
    units = len(index.residuals)
    one, two = index.offset(np.sort([h1 % units, h2 % units])).tolist()
    prefix, middle, suffix = text[:one], text[one:two], text[two:]
    if h4 % 100 < suffix_first:
        return "spm", f"<S>{suffix}<P>{prefix}<M>{middle}", (one, two - one), index
    return "psm", f"<P>{prefix}<S>{suffix}<M>{middle}", (one, two - one), index


def fill_in_middle(
    docs: DataFrame, seed: int = 42, rate: int = 50, suffix_first: int = 80, keep_index: bool = True, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """doc_id, n (tokens), form, prefix_chars, middle_chars, output, and the index (segments, residuals) of every row.

    ``rate`` per cent of the texts are rearranged, ``suffix_first`` per cent of these with the suffix in front. Ids are whole
    numbers or strings. Without ``keep_index`` the index is used and dropped.
    """
    importable(docs.sparkSession)
    kind = docs.schema[id_col].dataType.simpleString()

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for begin in range(0, batch.num_rows, 256):
                rows = batch.slice(begin, 256)
                ns, forms, prefixes, middles, outputs, segments, residuals = ([] for _ in range(7))
                for doc_id, text in zip(rows.column("doc_id").to_pylist(), rows.column("text").to_pylist(), strict=True):
                    form, output, parts, index = cut(text or "", doc_id, seed, rate, suffix_first)
                    ns.append(len(index.residuals) - 1)
                    forms.append(form)
                    outputs.append(output)
                    prefixes.append(parts and parts[0])
                    middles.append(parts and parts[1])
                    lines = zip(index.ranks.tolist(), index.offsets.tolist(), index.slopes.tolist(), strict=True)
                    segments.append([{"rank": r, "offset": o, "slope": s} for r, o, s in lines] if keep_index else None)
                    residuals.append(index.residuals.tobytes() if keep_index else None)
                line = pa.struct([("rank", pa.int64()), ("offset", pa.int64()), ("slope", pa.float64())])
                columns = [
                    rows.column("doc_id"), pa.array(ns, pa.int64()), pa.array(forms, pa.string()), pa.array(prefixes, pa.int64()),
                    pa.array(middles, pa.int64()), pa.array(outputs, pa.string()), pa.array(segments, pa.list_(line)), pa.array(residuals, pa.binary()),
                ]
                names = ["doc_id", "n", "form", "prefix_chars", "middle_chars", "output", "segments", "residuals"]
                yield pa.RecordBatch.from_arrays(columns, names=names)

    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(work, RESULT.format(id=kind))


def restored(output: Column, form: Column) -> Column:
    """The text that an output of this form was made from. Texts with markers are never rearranged, so the markers part it."""
    parts = F.split(output, "<[PSM]>", -1)
    return (
        F.when(form == "psm", F.concat(F.get(parts, F.lit(1)), F.get(parts, F.lit(3)), F.get(parts, F.lit(2))))
        .when(form == "spm", F.concat(F.get(parts, F.lit(2)), F.get(parts, F.lit(3)), F.get(parts, F.lit(1))))
        .otherwise(output)
    )


ORACLE = r"""
WITH units AS (
    SELECT doc_id, coalesce(text, '') AS text,
        regexp_extract_all(coalesce(text, ''), '[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+') AS u,
        sha256('42:' || CAST(doc_id AS VARCHAR)) AS h
    FROM documents
), drawn AS (
    SELECT *, CAST('0x' || h[1:8] AS BIGINT) % (len(u) + 1) AS one, CAST('0x' || h[9:16] AS BIGINT) % (len(u) + 1) AS two,
        CAST('0x' || h[17:24] AS BIGINT) AS h3, CAST('0x' || h[25:32] AS BIGINT) AS h4
    FROM units
), formed AS (
    SELECT *,
        CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR h3 % 100 >= 50 THEN 'plain'
             WHEN h4 % 100 < 80 THEN 'spm' ELSE 'psm' END AS form,
        array_to_string(u[1:least(one, two)], '') AS prefix,
        array_to_string(u[least(one, two) + 1:greatest(one, two)], '') AS middle,
        array_to_string(u[greatest(one, two) + 1:], '') AS suffix
    FROM drawn
)
SELECT doc_id, CAST(len(u) AS BIGINT) AS n, form,
    CASE WHEN form <> 'plain' THEN CAST(length(prefix) AS BIGINT) END AS prefix_chars,
    CASE WHEN form <> 'plain' THEN CAST(length(middle) AS BIGINT) END AS middle_chars,
    sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle
           ELSE '<S>' || suffix || '<P>' || prefix || '<M>' || middle END) AS output_sha256,
    sha256(text) AS restored_sha256
FROM formed
"""
