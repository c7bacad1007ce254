"""Approximate nearest neighbours by multi-probe p-stable hashing.

Each of ``TABLES`` tables hashes a vector with ``FUNCTIONS`` functions floor((a.x + b) / width), a drawn from the normal (2-stable)
distribution, so near vectors tend to share a bucket or sit in one next to it. A query visits its own bucket and ``probes``
perturbed ones: sets of steps of +1 or -1 in single functions, in the order of the estimated chance that a neighbour is there,
which falls with the sum of squared distances from the query to the bucket walls that the set crosses. Sets are generated once by
the expected distances (a heap over ranked walls) and put in order for each query by its own. The candidates of all tables are
merged, and exact distances on the original vectors decide.

The index is fitted on at most ``SAMPLE`` vectors, those whose ids hash lowest: the width follows from the typical distance of the
k-th neighbour in the sample, and the number of probes is the least tried that finds ``RECALL`` of the true neighbours in it.
Neighbours among all vectors are nearer than in a sample, so this errs towards more probes. Every vector is indexed.

Vectors lie in blocks, each with its own tables over its rows. Blocks and blocks of queries meet in a grid of tasks, each block
and query block copied along one side of it; every task gives at most k rows per query and block, and no pair outlives it. A
bucket that holds a third of all vectors is spread over the blocks like any other.

Defined results: rows with a null id, and vectors that are null, empty, zero or hold null or non-finite components take no part;
vectors meet only vectors of their own length; lengths that the sample lacks are compared in full. A query excludes all rows of
its id; a repeated row is a candidate each time but asks once, and an id with several vectors asks once for each. If the buckets give a query fewer
than k neighbours, it is compared with all vectors. Ties go to the smaller id. An empty table gives an empty result. Other columns are ignored.
"""

from __future__ import annotations

import heapq
from collections import OrderedDict
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ovenplan.llm.common import importable, settled, shuffle_width

TABLES = 16
FUNCTIONS = 12
SAMPLE = 2048
ASKED = 128
RECALL = 0.95
WIDTH = 2.2
#: Buckets that a query visits in a table at most; where more would be needed, buckets get wider.
MOST_PROBES = 8192
BLOCK = 4096
QUERY_BLOCK = 256
#: Groups of blocks; more tasks come from copying blocks to several splits of the queries.
MOST_GROUPS = 96


def usable_vectors(ids: pa.Array, vectors: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(ids, matrix of doubles) for each length among the rows that take part."""
    lengths = np.asarray(pc.fill_null(pc.list_value_length(vectors), 0).to_numpy(zero_copy_only=False)).astype(np.int64)
    named = ~np.asarray(pc.is_null(ids).to_numpy(zero_copy_only=False))
    values = pc.list_flatten(vectors).to_numpy(zero_copy_only=False).astype(np.float64)
    begins = np.cumsum(lengths) - lengths
    names = np.asarray(pc.fill_null(ids, 0).to_numpy(zero_copy_only=False)).astype(np.int64)
    for length in np.unique(lengths[named & (lengths > 0)]):
        rows = np.flatnonzero(named & (lengths == length))
        matrix = values[begins[rows][:, None] + np.arange(length)]
        fine = np.isfinite(matrix).all(axis=1) & (matrix != 0).any(axis=1)
        if fine.any():
            yield names[rows[fine]], matrix[fine]


def step_sets(functions: int, most: int) -> np.ndarray:
    """Sets of walls to cross, as rows of 0 and 1 over the 2 * ``functions`` walls ranked by distance; by expected score.

    The two walls of a function are a width apart, so the wall of rank j and that of rank 2 * functions - 1 - j belong together;
    no set crosses both.
    """
    walls = 2 * functions
    near = np.arange(1, functions + 1)
    expected = near * (near + 1) / (4 * (functions + 1) * (functions + 2))
    expected = np.concatenate([expected, (1 - near / (functions + 1) + near * (near + 1) / (4 * (functions + 1) * (functions + 2)))[::-1]])
    out, waiting = [()], [(expected[0], (0,))]
    while waiting and len(out) < most:
        score, chosen = heapq.heappop(waiting)
        if all(walls - 1 - j not in chosen for j in chosen):
            out.append(chosen)
        last = chosen[-1]
        if last + 1 < walls:
            heapq.heappush(waiting, (score + expected[last + 1] - expected[last], (*chosen[:-1], last + 1)))
            heapq.heappush(waiting, (score + expected[last + 1], (*chosen, last + 1)))
    sets = np.zeros((len(out), walls))
    for row, chosen in zip(sets, out, strict=True):
        row[list(chosen)] = 1
    return sets


@dataclass
class Hashing:
    """The functions of all tables for vectors of one length, and how many buckets a query visits in each."""

    directions: np.ndarray  # tables x functions x length
    shifts: np.ndarray  # tables x functions, in widths
    salts: np.ndarray  # tables x functions
    width: float
    probes: int
    sets: np.ndarray

    @classmethod
    def drawn(cls, length: int, width: float, seed: int = 7, tables: int = TABLES, functions: int = FUNCTIONS) -> Hashing:
        rng = np.random.default_rng([seed, length])
        directions = rng.standard_normal((tables, functions, length))
        salts = rng.integers(1, 1 << 62, (tables, functions)) | 1
        return cls(directions, rng.random((tables, functions)), salts, width, 1, step_sets(functions, 1))

    def places(self, rows: np.ndarray, table: int) -> np.ndarray:
        return rows @ self.directions[table].T / self.width + self.shifts[table]

    def keys(self, rows: np.ndarray, table: int) -> np.ndarray:
        with np.errstate(over="ignore", invalid="ignore"):
            return (np.floor(self.places(rows, table)).astype(np.int64) * self.salts[table]).sum(axis=1)

    def visits(self, queries: np.ndarray, table: int) -> np.ndarray:
        """Keys of the buckets that each query visits, the likeliest first."""
        places = self.places(queries, table)
        cells = np.floor(places)
        within = places - cells
        walls = np.concatenate([within, 1 - within], axis=1)  # to the bucket below and to that above, for each function
        order = np.argsort(walls, axis=1)
        squares = np.take_along_axis(walls, order, axis=1) ** 2
        salts = self.salts[table]
        moves = np.take_along_axis(np.tile(np.concatenate([-salts, salts]), (len(queries), 1)), order, axis=1)
        out = np.empty((len(queries), min(self.probes, len(self.sets))), np.int64)
        chosen = self.sets.astype(np.int64)
        with np.errstate(over="ignore", invalid="ignore"):
            own = (cells.astype(np.int64) * salts).sum(axis=1)
            for k in range(len(queries)):
                best = np.argsort(self.sets @ squares[k], kind="stable")[: out.shape[1]]
                out[k] = own[k] + (chosen[best] * moves[k]).sum(axis=1)
        return out


class Tables:
    """Vectors with, for each table, their bucket keys in order."""

    def __init__(self, ids: np.ndarray, rows: np.ndarray, hashing: Hashing | None):
        self.ids, self.rows, self.sorted = ids, rows, []
        for table in range(len(hashing.salts) if hashing else 0):
            keys = hashing.keys(rows, table)
            order = np.argsort(keys, kind="stable")
            self.sorted.append((keys[order], order))

    def candidates(self, visits: list[np.ndarray]) -> np.ndarray:
        """Rows in any of the buckets: visits[table] are keys."""
        found = np.zeros(len(self.ids), bool)
        for (keys, order), wanted in zip(self.sorted, visits, strict=True):
            begin = np.searchsorted(keys, wanted, "left")
            size = np.searchsorted(keys, wanted, "right") - begin
            begin, size = begin[size > 0], size[size > 0]
            if size.size:
                found[order[np.arange(size.sum()) + np.repeat(begin - np.cumsum(size) + size, size)]] = True
        return np.flatnonzero(found)

    def nearest(self, query_id: int, query: np.ndarray, rows: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """(ids, distances) of the k nearest of ``rows``."""
        rows = rows[self.ids[rows] != query_id]
        apart = np.sqrt(((self.rows[rows] - query) ** 2).sum(axis=1))
        if len(rows) > k:
            near = apart <= np.partition(apart, k - 1)[k - 1]
            rows, apart = rows[near], apart[near]
        order = np.lexsort((self.ids[rows], apart))[:k]
        return self.ids[rows][order], apart[order]


def fitted(ids: np.ndarray, rows: np.ndarray, k: int, recall: float = RECALL) -> Hashing | None:
    """Functions with a width and a number of probes that suit the sample; None if it has too few vectors to tell."""
    if len(rows) < 2:
        return None
    asked = np.arange(min(ASKED, len(rows)))
    truth, reach = [], []
    for q in asked:
        apart = np.sqrt(((rows - rows[q]) ** 2).sum(axis=1))
        apart[q] = np.inf
        near = np.argsort(apart, kind="stable")[: min(k, len(rows) - 1)]
        truth.append(near)
        reach.append(apart[near[-1]])
    reach = [x for x in reach if x > 0]
    if not reach:
        return None
    hashing = Hashing.drawn(rows.shape[1], WIDTH * float(np.median(reach)))
    while True:
        tables = Tables(ids, rows, hashing)
        hashing.probes = 1

        def found(visits: list[np.ndarray], probes: int) -> float:
            hits = [np.isin(near, tables.candidates([v[i, :probes] for v in visits])).mean() for i, near in enumerate(truth)]
            return float(np.mean(hits))

        while hashing.probes <= MOST_PROBES:
            hashing.sets = step_sets(FUNCTIONS, 2 * hashing.probes)
            visits = [hashing.visits(rows[asked], t) for t in range(TABLES)]
            if found(visits, hashing.probes) >= recall:
                steps = [hashing.probes * eighth // 16 for eighth in range(9, 16)]
                hashing.probes = next((p for p in steps if p and found(visits, p) >= recall), hashing.probes)
                return hashing
            hashing.probes *= 2
        hashing.width *= 1.5


def _packed(vectors: DataFrame, id_col: str, vector_col: str, size: int) -> DataFrame:
    """Blocks of at most ``size`` vectors: block (hash of its content), dims, ids and rows as bytes."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple] = []
            for ids, matrix in usable_vectors(batch.column("_id"), batch.column("_vector")):
                for begin in range(0, len(ids), size):
                    names, rows = ids[begin : begin + size].tobytes(), matrix[begin : begin + size].tobytes()
                    out.append((xxhash.xxh64_intdigest(names + rows) >> 1, matrix.shape[1], names, rows))
            columns = list(zip(*out, strict=True)) or [[]] * 4
            kinds = [pa.int64(), pa.int32(), pa.binary(), pa.binary()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names=["block", "dims", "ids", "rows"])

    chosen = vectors.select(F.col(id_col).cast("long").alias("_id"), F.col(vector_col).cast("array<double>").alias("_vector"))
    return chosen.mapInArrow(work, "block long, dims int, ids binary, rows binary")


def _searched(pairs: DataFrame, index: dict[int, Hashing], k: int, in_full: bool) -> DataFrame:
    """Block pairs (ids, rows, block, q_ids, q_rows, q_block, dims) -> (query_id, query_key, vec_id, score)."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen, tables = None, None
        asked: OrderedDict[int, tuple] = OrderedDict()
        for batch in batches:
            for row in range(batch.num_rows):
                at = {c: batch.column(c)[row].as_py() for c in batch.schema.names}
                hashing = None if in_full else index.get(at["dims"])
                if at["block"] != seen:
                    seen = at["block"]
                    tables = Tables(np.frombuffer(at["ids"], np.int64), np.frombuffer(at["rows"]).reshape(-1, at["dims"]), hashing)
                if at["q_block"] not in asked:
                    queries = np.frombuffer(at["q_rows"]).reshape(-1, at["dims"])
                    keys = [xxhash.xxh64_intdigest(q.tobytes()) - (1 << 63) for q in queries]
                    visits = [hashing.visits(queries, t) for t in range(len(hashing.salts))] if hashing else None
                    asked[at["q_block"]] = np.frombuffer(at["q_ids"], np.int64), queries, keys, visits
                    while len(asked) > 4:
                        asked.popitem(last=False)
                names, queries, keys, visits = asked[at["q_block"]]
                out: list[list] = [[], [], [], []]
                for i, query in enumerate(queries):
                    rows = tables.candidates([v[i] for v in visits]) if visits else np.arange(len(tables.ids))
                    ids, scores = tables.nearest(int(names[i]), query, rows, k)
                    for column, value in zip(out, ([int(names[i])] * len(ids), [keys[i]] * len(ids), ids.tolist(), scores.tolist()), strict=True):
                        column += value
                kinds = [pa.int64(), pa.int64(), pa.int64(), pa.float64()]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, t) for c, t in zip(out, kinds, strict=True)], names=["query_id", "query_key", "vec_id", "score"]
                )

    return pairs.select("ids", "rows", "block", "q_ids", "q_rows", "q_block", "dims").mapInArrow(
        work, "query_id long, query_key long, vec_id long, score double"
    )


def _met(blocks: DataFrame, asked: DataFrame, width: int) -> DataFrame:
    """Every block with every query block of its length, dealt to ``width`` cells: blocks in rows of the grid, queries in columns."""
    groups = min(width, MOST_GROUPS)
    splits = -(-width // groups)
    across = lambda n: F.explode(F.expr(f"sequence(0L, {n - 1}L)"))
    data = blocks.withColumn("grp", F.pmod("block", F.lit(groups))).withColumn("split", across(splits))
    queries = asked.select(F.col("block").alias("q_block"), "dims", F.col("ids").alias("q_ids"), F.col("rows").alias("q_rows"))
    queries = queries.withColumn("split", F.pmod("q_block", F.lit(splits))).withColumn("grp", across(groups))
    return data.join(queries, ["grp", "split", "dims"])


def _ranked(found: DataFrame, k: int) -> DataFrame:
    best = Window.partitionBy("query_id", "query_key").orderBy("score", "vec_id")
    return found.withColumn("rank", F.row_number().over(best).cast("int")).filter(F.col("rank") <= k)


def nearest(
    vectors: DataFrame, queries: Column, k: int = 10, recall: float = RECALL, id_col: str = "vec_id", vector_col: str = "embedding"
) -> DataFrame:
    """query_id, rank, vec_id, score (Euclidean distance): for every row that ``queries`` selects, its k nearest other vectors found."""
    spark = vectors.sparkSession
    importable(spark)
    width = shuffle_width(spark)
    blocks = settled(_packed(vectors, id_col, vector_col, BLOCK), "neighbour-blocks")
    asking = vectors.filter(queries).select(id_col, vector_col).dropDuplicates([id_col, vector_col])
    asked = settled(_packed(asking, id_col, vector_col, QUERY_BLOCK), "neighbour-queries")
    sample = vectors.select(id_col, vector_col).filter(F.col(id_col).isNotNull()).orderBy(F.xxhash64(id_col), id_col).limit(SAMPLE)
    parts: dict[int, list[tuple[np.ndarray, np.ndarray]]] = {}
    for row in _packed(sample, id_col, vector_col, SAMPLE).collect():  # at most SAMPLE vectors
        part = np.frombuffer(row["ids"], np.int64), np.frombuffer(row["rows"]).reshape(-1, row["dims"])
        parts.setdefault(row["dims"], []).append(part)
    index = {}
    for dims, some in parts.items():
        ids, rows = (np.concatenate(x) for x in zip(*some, strict=True))
        index[dims] = fitted(ids, rows, k, recall)

    first = settled(_ranked(_searched(_met(blocks, asked, width), index, k, False), k), "neighbours-found")
    enough = first.groupBy("query_id", "query_key").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= k).select("query_id", "query_key")
    # Queries whose buckets gave too few: their vectors again, against everything.
    names = _named(asked).join(enough, ["query_id", "query_key"], "left_anti")
    if names.isEmpty():
        return first.select("query_id", "rank", "vec_id", "score")
    rest = _packed(names.select(F.col("query_id").alias(id_col), F.col("_vector").alias(vector_col)), id_col, vector_col, QUERY_BLOCK)
    full = _ranked(_searched(_met(blocks, settled(rest, "neighbour-queries-left"), width), index, k, True), k)
    return first.join(enough, ["query_id", "query_key"], "left_semi").unionByName(full).select("query_id", "rank", "vec_id", "score")


def _named(asked: DataFrame) -> DataFrame:
    """(query_id, query_key, _vector) of the vectors in query blocks."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for names, data, dims in zip(*(batch.column(c).to_pylist() for c in ("ids", "rows", "dims")), strict=True):
                rows = np.frombuffer(data).reshape(-1, dims)
                keys = [xxhash.xxh64_intdigest(q.tobytes()) - (1 << 63) for q in rows]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.frombuffer(names, np.int64)), pa.array(keys, pa.int64()), pa.array(rows.tolist(), pa.list_(pa.float64()))],
                    names=["query_id", "query_key", "_vector"],
                )

    return asked.select("ids", "rows", "dims").mapInArrow(work, "query_id long, query_key long, _vector array<double>")
