"""Exact top-k search by inner product with multi-resolution segment statistics.

Vectors are cut into segments, few at the coarse level and more at the finer ones. From the mean and deviation of each segment of a
query q and a vector x follows a lower bound on their squared distance: the sum over segments of
length * ((mean q - mean x)**2 + (dev q - dev x)**2). As q.x = (|q|**2 + |x|**2 - distance**2) / 2, it is an upper bound on the
product. Level by level, vectors whose bound can't reach the query's k-th best score so far are dropped; products are computed for
those that survive all levels. Ties at the k-th score survive, so the result is exact.

The k-th best score of each query over a sample of at most ``SEEDS`` vectors is where pruning starts; it is a true lower bound, so
the sample changes speed only. Vectors are packed into blocks and dealt into groups; the queries, also in blocks, are copied to
every group; each task meets one pair of blocks at a time and gives at most k rows per query. Both sides are shuffled: Spark guesses
the size of the copied queries without the copies and would send them all through the driver.

Components are turned into whole numbers floor(scale * x), and products of whole numbers are exact in double precision below 2**53
(beyond that they are computed with integers of any size, and scores outside 64 bits stop at the limits).

Defined results: rows with a null id, a null vector or null or non-finite components take no part; vectors meet only vectors of
their own length; empty vectors have score 0; a repeated row is a candidate each time, but asks once; an id with several vectors
asks once for each; a query's candidates exclude all rows of its id; empty tables give an empty result. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ovenplan.llm.common import importable, settled, shuffle_width

SEEDS = 2048
LEVELS = (4, 16)
BLOCK = 2048
QUERY_BLOCK = 256
EXACT = float(1 << 53)


def whole_vectors(ids: pa.Array, vectors: pa.Array, scale: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(ids, matrix of whole numbers as doubles) for each length that occurs among the usable rows."""
    lengths = np.array([-1 if x is None else x for x in pc.list_value_length(vectors).to_pylist()])
    usable = (lengths >= 0) & ~np.asarray(pc.is_null(ids).to_numpy(zero_copy_only=False))
    flat = pc.list_flatten(vectors)
    values = np.floor(scale * flat.to_numpy(zero_copy_only=False).astype(np.float64))
    ends = np.cumsum(np.maximum(lengths, 0))
    names = ids.to_pylist()
    for length in np.unique(lengths[usable]):
        rows = np.flatnonzero(usable & (lengths == length))
        places = (ends[rows] - length)[:, None] + np.arange(length)[None, :]
        matrix = values[places] if length else np.zeros((len(rows), 0))
        fine = np.isfinite(matrix).all(axis=1)
        if fine.any():
            yield np.array([names[r] for r in rows[fine]], np.int64), matrix[fine]


def segment_features(matrix: np.ndarray, segments: int) -> np.ndarray:
    """Means and deviations of the segments times the root of their length: products of these bound products of the vectors."""
    parts = np.array_split(matrix, min(segments, max(1, matrix.shape[1])), axis=1)
    out = []
    for part in parts:
        root = np.sqrt(part.shape[1])
        out += [part.mean(axis=1) * root, part.std(axis=1) * root] if part.shape[1] else []
    return np.stack(out, axis=1) if out else np.zeros((len(matrix), 0))


def products(rows: np.ndarray, query: np.ndarray) -> np.ndarray:
    """Exact products as 64-bit integers."""
    if not rows.size:
        return np.zeros(len(rows), np.int64)
    if np.abs(rows).max() * np.abs(query).max() * rows.shape[1] < EXACT:
        return (rows @ query).astype(np.int64)
    least, most = -(1 << 63), (1 << 63) - 1
    q = [int(x) for x in query]
    return np.array([min(most, max(least, sum(int(x) * y for x, y in zip(row, q, strict=True)))) for row in rows], np.int64)


class Block:
    """Vectors of one length with their segment features, coarse to fine."""

    def __init__(self, ids: bytes, data: bytes):
        self.ids = np.frombuffer(ids, np.int64)
        self.rows = np.frombuffer(data, np.float64).reshape(len(self.ids), -1)
        self.levels = [segment_features(self.rows, s) for s in LEVELS]
        self.norms = np.sqrt((self.rows * self.rows).sum(axis=1))

    def best(self, query_id: int, query: np.ndarray, features: list[np.ndarray], floor: int | None, k: int) -> tuple[np.ndarray, np.ndarray]:
        """(ids, scores) of the k best rows that reach ``floor``, ties to the smaller id."""
        alive = np.flatnonzero(self.ids != query_id)
        bound = self.levels[0][alive] @ features[0]
        # Rounding of the bounds is far below this part of the largest product there can be.
        slack = 1 + 1e-9 * np.sqrt(query @ query) * (self.norms.max() if len(self.norms) else 0)
        if len(alive) > k:
            likely = alive[np.argpartition(-bound, k - 1)[:k]]
            here = int(products(self.rows[likely], query).min())
            floor = here if floor is None else max(floor, here)
        for level in range(len(LEVELS)):
            if level:
                bound = self.levels[level][alive] @ features[level]
            if floor is not None:
                alive = alive[bound >= floor - slack]
        scores = products(self.rows[alive], query)
        if floor is not None:
            alive, scores = alive[scores >= floor], scores[scores >= floor]
        order = np.lexsort((self.ids[alive], ~scores))[:k]  # ~score falls as score rises and can't overflow
        return self.ids[alive][order], scores[order]


def _packed(vectors: DataFrame, id_col: str, vector_col: str, scale: int, size: int) -> DataFrame:
    """Blocks of at most ``size`` vectors: block (hash of its content), dims, ids and rows as bytes."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for ids, matrix in whole_vectors(batch.column("_id"), batch.column("_vector"), scale):
                for begin in range(0, len(ids), size):
                    names, rows = ids[begin : begin + size].tobytes(), matrix[begin : begin + size].tobytes()
                    out.append((xxhash.xxh64_intdigest(names + rows) >> 1, matrix.shape[1], names, rows))
            columns = list(zip(*out, strict=True)) or [[]] * 4
            kinds = [pa.int64(), pa.int32(), pa.binary(), pa.binary()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=["block", "dims", "ids", "rows"])

    chosen = vectors.select(F.col(id_col).cast("long").alias("_id"), F.col(vector_col).cast("array<double>").alias("_vector"))
    return chosen.mapInArrow(work, "block long, dims int, ids binary, rows binary")


def _searched(pairs: DataFrame, k: int) -> DataFrame:
    """Block pairs (rows, ids, q_rows, q_ids, q_floors) -> (query_id, query_key, vec_id, score)."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen, block = None, None
        for batch in batches:
            out: list[list] = [[], [], [], []]
            for row in range(batch.num_rows):
                names, data, number, q_names, q_data, q_floors = (batch.column(c)[row].as_py() for c in ("ids", "rows", "block", "q_ids", "q_rows", "q_floors"))
                if number != seen:
                    seen, block = number, Block(names, data)
                asked = Block(q_names, q_data)
                floors = np.frombuffer(q_floors, np.int64) if q_floors else None
                for i, query in enumerate(asked.rows):
                    floor = None if floors is None or floors[i] == np.iinfo(np.int64).min else int(floors[i])
                    ids, scores = block.best(int(asked.ids[i]), query, [f[i] for f in asked.levels], floor, k)
                    key = xxhash.xxh64_intdigest(query.tobytes()) - (1 << 63)
                    for column, value in zip(out, ([int(asked.ids[i])] * len(ids), [key] * len(ids), ids.tolist(), scores.tolist()), strict=True):
                        column += value
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in out], names=["query_id", "query_key", "vec_id", "score"])

    return pairs.select("ids", "rows", "block", "q_ids", "q_rows", "q_floors").mapInArrow(
        work, "query_id long, query_key long, vec_id long, score long"
    )


def _with_floors(asked: DataFrame, seeds: DataFrame, k: int) -> DataFrame:
    """Add to each query block the k-th best score of its queries over the seed vectors."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            floors = []
            for row in range(batch.num_rows):
                q_names, q_data, names, data = (batch.column(c)[row].as_py() for c in ("q_ids", "q_rows", "ids", "rows"))
                queries = Block(q_names, q_data)
                block = Block(names, data) if names is not None else None
                found = np.full(len(queries.ids), np.iinfo(np.int64).min)
                for i, query in enumerate(queries.rows if block else ()):
                    scores = block.best(int(queries.ids[i]), query, [f[i] for f in queries.levels], None, k)[1]
                    if len(scores) == k:
                        found[i] = scores[-1]
                floors.append(found.tobytes())
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in ("q_block", "dims", "q_ids", "q_rows")), pa.array(floors, pa.binary())],
                names=["q_block", "dims", "q_ids", "q_rows", "q_floors"],
            )

    joined = asked.join(seeds.groupBy("dims").agg(F.min_by(F.struct("ids", "rows"), "block").alias("s")), "dims", "left")
    return joined.select("q_block", "dims", "q_ids", "q_rows", "s.ids", "s.rows").mapInArrow(
        work, "q_block long, dims int, q_ids binary, q_rows binary, q_floors binary"
    )


def top_k(
    vectors: DataFrame, queries: Column, k: int = 10, scale: int = 1024, id_col: str = "vec_id", vector_col: str = "embedding"
) -> DataFrame:
    """query_id, rank, vec_id, score: for every row of ``vectors`` that ``queries`` selects, its k best other vectors."""
    spark = vectors.sparkSession
    importable(spark)
    blocks = settled(_packed(vectors, id_col, vector_col, scale, BLOCK), "vector-blocks")
    # No more groups than blocks: a copy of the queries for a group without a block would meet nothing.
    groups = max(1, min(shuffle_width(spark), blocks.count()))
    asking = vectors.filter(queries).select(id_col, vector_col).dropDuplicates([id_col, vector_col])
    spread = max(1, asking.count() // QUERY_BLOCK)
    packed = _packed(asking.repartition(spread), id_col, vector_col, scale, QUERY_BLOCK)
    asked = packed.select(F.col("block").alias("q_block"), "dims", F.col("ids").alias("q_ids"), F.col("rows").alias("q_rows"))
    sample = vectors.select(id_col, vector_col).orderBy(F.xxhash64(id_col), id_col).limit(SEEDS).repartition(1)
    seeds = _packed(sample, id_col, vector_col, scale, SEEDS)
    floored = settled(_with_floors(asked, seeds, k), "query-blocks")
    # The queries go to every group of blocks; the blocks stay one copy. The guessed size of ``everywhere`` is that of one copy.
    dealt = blocks.withColumn("grp", F.pmod("block", F.lit(groups)).cast("int"))
    everywhere = floored.withColumn("grp", F.explode(F.sequence(F.lit(0), F.lit(groups - 1))))
    found = _searched(dealt.join(everywhere.hint("merge"), ["grp", "dims"]), k)
    best = Window.partitionBy("query_id", "query_key").orderBy(F.col("score").desc(), "vec_id")
    return (
        found.withColumn("rank", F.row_number().over(best))
        .filter(F.col("rank") <= k)
        .select("query_id", F.col("rank").cast("int"), "vec_id", "score")
    )


ORACLE = """
WITH usable AS (
    SELECT vec_id, list_transform(embedding, lambda x: floor(1024 * CAST(x AS DOUBLE))) AS v FROM embeddings
    WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), scored AS (
    SELECT q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(q.v, c.v) AS BIGINT) AS score
    FROM usable q JOIN usable c ON q.vec_id <> c.vec_id AND len(q.v) = len(c.v) WHERE q.vec_id % 100 = 0
), ranked AS (
    SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM scored
)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM ranked WHERE rank <= 10
"""
