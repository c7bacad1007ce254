"""Document quality from a linear-chain conditional random field over lines.

Every line is good or bad. Its score depends on what the line and the lines beside it look like, and on the labels of the lines
beside it; forward-backward gives each line the probability of being good given the whole text, and a document's quality is the
mean of these, weighted by length. The field is fitted on labelled documents, whose lines all carry the document's label, by
gradient ascent on the conditional likelihood. Features are shapes and shares of characters and words: no vocabulary, no
language, source or id.

The fit sees at most ``sample`` labelled documents (those with the smallest hash of their id), so what reaches the driver is
bounded by that parameter; scoring is one pass over all documents without a shuffle.

Defined results: a null or empty text is one empty line and gets a score like any other; documents with no label, a null label or
two different labels teach nothing; without any usable label all scores are 0.5; repeated rows get equal scores; an empty table
gives an empty result. Other columns of the input are kept; ``score`` and ``predicted`` replace columns of those names.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from math import log1p

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, IntegerType, StructField, StructType

from ovenplan.llm.common import importable

SAMPLE = 4000
#: Lines of a chain while fitting; longer documents are cut into several chains there, never when scoring.
CHAIN = 32
SHAPES = 14
STEPS, RATE, RIDGE = 200, 0.1, 1e-3
THRESHOLD = 0.3

UPPER = b"ABCDEFGHIJKLMNOPQRSTUVWXYZ"
DIGITS = b"0123456789"
SYMBOLS = b"#*$%&|<>@^~_=+\\/[]{}"
SHOUTS = b"!?"
STOPS = b".,;:"
HIGH = bytes(range(128, 256))


def line_shapes(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """(lines x SHAPES) numbers and the weight (length) of each line."""
    lines = (text or "").split("\n")
    rows, seen = [], set()
    for line in lines:
        data = line.encode()
        size = len(data)
        words = line.split()
        n = len(words)
        share = lambda chars: (size - len(data.translate(None, chars))) / size if size else 0.0  # noqa: B023, E731
        rows.append(
            (
                log1p(size),
                log1p(n),
                size / n if n else 0.0,
                len(set(words)) / n if n else 1.0,
                sum(map(str.__eq__, words, words[1:])) / n if n else 0.0,
                share(SYMBOLS),
                share(UPPER),
                share(DIGITS),
                share(SHOUTS),
                share(STOPS),
                data.count(b"|") / n if n else 0.0,
                share(HIGH),
                0.0 if n else 1.0,
                1.0 if n and line in seen else 0.0,
            )
        )
        seen.add(line)
    return np.array(rows), np.array([len(line) + 1.0 for line in lines])


def with_neighbours(shapes: np.ndarray) -> np.ndarray:
    """Each line's shapes, those of the lines before and after it (zeros at the ends), and whether it is first or last."""
    n = len(shapes)
    out = np.zeros((n, 3 * SHAPES + 2))
    out[:, :SHAPES] = shapes
    out[1:, SHAPES : 2 * SHAPES] = shapes[:-1]
    out[:-1, 2 * SHAPES : 3 * SHAPES] = shapes[1:]
    out[0, -2] = out[-1, -1] = 1.0
    return out


@dataclass
class Field:
    """Weights of the field: ``score`` of good against bad per line, and of each pair of neighbouring labels."""

    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    bias: float
    pairs: np.ndarray

    def line_scores(self, shapes: np.ndarray) -> np.ndarray:
        return with_neighbours((shapes - self.mean) / self.scale) @ self.weights + self.bias

    def marginals(self, shapes: np.ndarray) -> np.ndarray:
        """Probability of each line being good given all lines: forward-backward with every step scaled to one."""
        local = 1.0 / (1.0 + np.exp(-np.clip(self.line_scores(shapes), -60, 60)))
        good = local.tolist()
        (bb, bg), (gb, gg) = np.exp(self.pairs - self.pairs.max()).tolist()
        n = len(good)
        ahead = [0.0] * n
        p = ahead[0] = good[0]
        for t in range(1, n):
            g = ((1 - p) * bg + p * gg) * good[t]
            b = ((1 - p) * bb + p * gb) * (1 - good[t])
            p = ahead[t] = g / (g + b) if g + b > 0 else 0.5
        out = [0.0] * n
        rg = rb = 1.0
        for t in range(n - 1, -1, -1):
            g, b = ahead[t] * rg, (1 - ahead[t]) * rb
            out[t] = g / (g + b) if g + b > 0 else 0.5
            g, b = good[t] * rg, (1 - good[t]) * rb
            rg, rb = gb * b + gg * g, bb * b + bg * g
            most = max(rg, rb) or 1.0
            rg, rb = rg / most, rb / most
        return np.array(out)

    def quality(self, text: str | None) -> float:
        shapes, sizes = line_shapes(text)
        return float(np.clip((self.marginals(shapes) * sizes).sum() / sizes.sum(), 0.0, 1.0))


def fit(chains: list[tuple[np.ndarray, int]]) -> Field:
    """Maximum conditional likelihood with a ridge, all chains padded to one array; classes weigh the same in sum."""
    mean, scale = np.zeros(SHAPES), np.ones(SHAPES)
    size = 3 * SHAPES + 2
    if not chains:
        return Field(mean, scale, np.zeros(size), 0.0, np.zeros((2, 2)))
    every = np.concatenate([s for s, _ in chains])
    mean, scale = every.mean(0), every.std(0)
    scale[scale < 1e-9] = 1.0
    pieces = []
    for shapes, label in chains:
        x = with_neighbours((shapes - mean) / scale)
        pieces += [(x[i : i + CHAIN], label) for i in range(0, len(x), CHAIN)]
    many = len(pieces)
    length = np.array([len(x) for x, _ in pieces])
    label = np.array([y for _, y in pieces])
    x = np.zeros((many, length.max(), size))
    for k, (rows, _) in enumerate(pieces):
        x[k, : len(rows)] = rows
    real = np.arange(x.shape[1])[None, :] < length[:, None]
    share = np.where(label == 1, 0.5 / max(1, (label == 1).sum()), 0.5 / max(1, (label == 0).sum()))
    weights, bias, pairs = np.zeros(size), 0.0, np.zeros((2, 2))
    state = [np.zeros(size + 5), np.zeros(size + 5)]
    for step in range(1, STEPS + 1):
        unary = x @ weights + bias
        marginal, joint = _expectations(unary, pairs, length)
        residual = (label[:, None] - marginal) * real * (share / length)[:, None]
        between = share / np.maximum(length - 1, 1)
        seen = np.zeros((many, 2, 2))
        seen[np.arange(many), label, label] = length - 1
        grad = np.concatenate(
            [
                np.einsum("kt,ktf->f", residual, x) - RIDGE * weights,
                [residual.sum()],
                ((seen - joint) * between[:, None, None]).sum(0).ravel() - 10 * RIDGE * pairs.ravel(),
            ]
        )
        state[0] = 0.9 * state[0] + 0.1 * grad
        state[1] = 0.99 * state[1] + 0.01 * grad * grad
        move = RATE * (state[0] / (1 - 0.9**step)) / (np.sqrt(state[1] / (1 - 0.99**step)) + 1e-8)
        weights, bias, pairs = weights + move[:size], bias + move[size], pairs + move[size + 1 :].reshape(2, 2)
    return Field(mean, scale, weights, float(bias), pairs)


def _expectations(unary: np.ndarray, pairs: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Marginals of good per line, and expected counts of label pairs per chain, in logarithms over all chains at once."""
    many, steps = unary.shape
    ahead = np.zeros((steps, many, 2))
    ahead[0, :, 1] = unary[:, 0]
    for t in range(1, steps):
        reach = np.logaddexp(ahead[t - 1, :, 0, None] + pairs[0], ahead[t - 1, :, 1, None] + pairs[1])
        reach[:, 1] += unary[:, t]
        ahead[t] = np.where((t < length)[:, None], reach, ahead[t - 1])
    whole = np.logaddexp(ahead[-1, :, 0], ahead[-1, :, 1])
    back = np.zeros((many, 2))
    marginal, joint = np.zeros((many, steps)), np.zeros((many, 2, 2))
    for t in range(steps - 1, -1, -1):
        live = t < length
        marginal[:, t] = np.where(live, np.exp(np.minimum(ahead[t, :, 1] + back[:, 1] - whole, 0)), 0)
        if t:
            here = back.copy()
            here[:, 1] += unary[:, t]
            both = ahead[t - 1, :, :, None] + pairs + here[:, None, :] - whole[:, None, None]
            joint += np.where(live[:, None, None], np.exp(np.minimum(both, 0)), 0)
            into = np.logaddexp(pairs[:, 0] + here[:, 0, None], pairs[:, 1] + here[:, 1, None])
            back = np.where(live[:, None], into, back)
    return marginal, joint


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> Field:
    """Fit on ``sample`` labelled documents at most; ``labels`` holds the ids that may teach."""
    importable(docs.sparkSession)
    known = (
        labels.filter(F.col(label_col).isNotNull() & F.col(id_col).isNotNull())
        .groupBy(F.col(id_col).alias("_id"))
        .agg(F.min(label_col).cast("int").alias("_label"), F.max(label_col).cast("int").alias("_other"))
        .filter((F.col("_label") == F.col("_other")) & F.col("_label").isin(0, 1))
        .orderBy(F.md5(F.col("_id").cast("string")), "_id")
        .limit(sample)
        .select("_id", "_label")
    )
    # At most ``sample`` rows of two numbers are broadcast.
    taught = docs.join(F.broadcast(known), docs[id_col] == F.col("_id")).select("_id", "_label", F.col(text_col).alias("_text"))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            shapes = [line_shapes(t)[0].astype(np.float32).tobytes() for t in batch.column("_text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("_id"), batch.column("_label"), pa.array(shapes, pa.binary())], names=["_id", "_label", "_shapes"])

    kind = dict(docs.dtypes)[id_col]
    rows = taught.mapInArrow(work, f"_id {kind}, _label int, _shapes binary").collect()
    rows.sort(key=lambda r: (str(r["_id"]), bytes(r["_shapes"])))
    return fit([(np.frombuffer(r["_shapes"], np.float32).reshape(-1, SHAPES).astype(float), r["_label"]) for r in rows])


def score(docs: DataFrame, field: Field, threshold: float = THRESHOLD, text_col: str = "text", keep_text: bool = True) -> DataFrame:
    """``docs`` with ``score`` and ``predicted``; one pass, no shuffle."""
    importable(docs.sparkSession)
    kept = [c for c in docs.columns if c not in ("score", "predicted") and (keep_text or c != text_col)]
    schema = StructType([docs.schema[c] for c in kept] + [StructField("score", DoubleType()), StructField("predicted", IntegerType())])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [field.quality(t) for t in batch.column(text_col).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in kept), pa.array(found, pa.float64()), pa.array([int(s >= threshold) for s in found], pa.int32())],
                names=schema.fieldNames(),
            )

    return docs.mapInArrow(work, schema)
