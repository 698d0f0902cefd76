"""Exact top-k search by tiled matrix products.

Vectors become integers, floor(256 x), and are packed as matrices: short integers
where all fit, else doubles.  Queries are dealt by a hash of their ids into groups
of about ``GROUP`` bytes, candidates in turn into regions.  A cell is a group and
a region, and one task: it holds the group in blocks of ``BLOCK`` queries, and the
region's shards of ``SHARD`` rows go by one after the other, so a tile is one matrix
product and a task's memory does not grow with the table.  Of a tile only what can
be among the k best of its query so far is looked at.  The cells' lists are merged
as a tree: by query and part of the candidates first, then by query.

There are so many regions that copies of the queries move about as many bytes as
copies of the candidates, ``CELLS`` cells for each core at least, but no more than shards.

Products run in single precision where all sums are certain to be exact (under
2^24), in double precision under 2^53, else in Python integers; a score beyond a
long raises.

Cases: vectors that are null or hold null or non-finite components take no
part, and neither do rows with a null id.  Vectors of different lengths don't
meet.  Of rows that share an id and are queries one asks (the greatest vector);
as candidates all of them count.  Rows of a query's own id are no candidates.
Ties go to the smaller id.  Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, FloatType

from wayfold.llm.common import table

SCALE = 256
EVERY = 50
K = 5
BLOCK = 512
SHARD = 4096
PARTS = 16
CELLS = 8
#: Bytes of a group of queries with their lists, of one packed matrix (as doubles), and components or scores handled at once.
GROUP = 96 << 20
PACK = 4 << 20
ONCE = 1 << 20


def _floored(x: Column) -> Column:
    """floor(256 x) as a double; doubles of 2^53 and more are integers already."""
    y = F.lit(float(SCALE)) * x
    return F.when(F.abs(y) < float(2**53), F.floor(y).cast("double")).otherwise(y)


def _given(vectors: DataFrame, key: str, vector: str) -> DataFrame:
    """id and x (floats or doubles) of the rows that have both."""
    kind = vectors.schema[vector].dataType
    x = vectors[vector]
    if not (isinstance(kind, ArrayType) and isinstance(kind.elementType, FloatType | DoubleType)):
        x = x.cast("array<double>")
    return vectors.select(vectors[key].cast("long").alias("id"), x.alias("x")).where(F.col("id").isNotNull() & F.col("x").isNotNull())


def quantised(given: DataFrame) -> DataFrame:
    """id and v (integers as doubles) of the rows that take part."""
    fine = F.forall("x", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return given.where(fine).select("id", F.transform(F.col("x").cast("array<double>"), _floored).alias("v"))


def _rows(dim: int, most: int) -> int:
    return max(1, min(most, PACK // (8 * dim or 1)))


def _matrices(batch: pa.RecordBatch) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Length, row numbers and vectors of a batch's (id, list) rows without null or non-finite components, by length."""
    lengths = pc.list_value_length(batch.column(1)).to_numpy(zero_copy_only=False).astype(np.int64)
    ends = np.cumsum(lengths)
    start = 0
    while start < len(lengths):
        stop = max(start + 1, int(np.searchsorted(ends, (ends[start - 1] if start else 0) + ONCE, "right")))
        values = batch.column(1).slice(start, stop - start).flatten().to_numpy(zero_copy_only=False).astype(np.float64)  # null: NaN
        own = lengths[start:stop]
        starts = np.cumsum(own) - own
        dims = np.unique(own).tolist()
        for dim in dims:
            at = np.flatnonzero(own == dim)
            matrix = values.reshape(len(own), dim) if len(dims) == 1 else values[starts[at][:, None] + np.arange(dim)]
            fine = np.isfinite(matrix).all(axis=1)
            yield dim, start + at[fine], matrix[fine]
        start = stop


def _packed(rows: DataFrame, most: int, regions: int = 0) -> DataFrame:
    """Up to ``most`` rows of one length as one row: at, dim, ids (ascending), matrix and whether it is of short integers.

    With ``regions``, rows are (id, x), x becomes integers, and at goes in turn through the regions;
    else rows are (id, v, at), and only those of one at are packed together.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple[int, int], tuple[list, list]] = {}
        turn, size = TaskContext.get().partitionId(), 0

        def out(key: tuple[int, int], least: int = 1) -> Iterator[pa.RecordBatch]:
            nonlocal turn, size
            at, dim = key
            parts = held.pop(key)
            ids, matrix = np.concatenate(parts[0]), np.concatenate(parts[1])
            size -= matrix.size + len(ids)
            for n in range(0, len(ids), _rows(dim, most)):
                if len(ids) - n < least:
                    held[key] = ([ids[n:]], [matrix[n:]])
                    size += matrix[n:].size + len(ids) - n
                    return
                order = n + np.argsort(ids[n : n + _rows(dim, most)], kind="stable")
                own = matrix[order]
                short = not own.size or float(np.abs(own).max()) < 2**15
                place = turn % regions if regions else at
                turn += 1
                yield pa.record_batch(
                    [pa.array([place], pa.int32()), pa.array([dim], pa.int32()), pa.array([ids[order].astype("<i8").tobytes()], pa.binary()), pa.array([own.astype("<i2" if short else "<f8").tobytes()], pa.binary()), pa.array([short])],
                    names=["at", "dim", "ids", "matrix", "short"],
                )

        for batch in batches:
            ids = batch.column(0).to_numpy(zero_copy_only=False).astype(np.int64)
            groups = np.zeros(len(ids), np.int64) if regions else batch.column(2).to_numpy(zero_copy_only=False)
            for dim, lines, matrix in _matrices(batch):
                if regions:
                    with np.errstate(over="ignore"):
                        matrix = np.floor(SCALE * matrix)
                for at in np.unique(groups[lines]).tolist():
                    mine = groups[lines] == at
                    key = (at, dim)
                    into = held.setdefault(key, ([], []))
                    into[0].append(ids[lines[mine]])
                    into[1].append(matrix[mine])
                    size += into[1][-1].size + len(into[0][-1])
                    if sum(map(len, into[0])) >= _rows(dim, most):
                        yield from out(key, _rows(dim, most))
                if size > 4 * ONCE:
                    for key in list(held):
                        yield from out(key)
        for key in list(held):
            yield from out(key)

    return rows.mapInArrow(run, "at int, dim int, ids binary, matrix binary, short boolean")


class _Shard:
    """Candidates of one length, ids ascending."""

    def __init__(self, ids: np.ndarray, matrix: np.ndarray) -> None:
        self.ids, self.matrix = ids, matrix
        self.most = float(np.abs(matrix.astype(np.float64)).max()) if matrix.size else 0.0
        self.cast: dict[type, np.ndarray] = {}

    def turned(self, kind: type) -> np.ndarray:
        if kind not in self.cast:
            self.cast[kind] = self.matrix.astype(kind).T
        return self.cast[kind]


class _Block:
    """Queries of one length and the k best candidates so far of each, best first."""

    def __init__(self, ids: np.ndarray, matrix: np.ndarray, k: int) -> None:
        self.ids, self.matrix, self.k = ids, matrix, k
        self.most = float(np.abs(matrix.astype(np.float64)).max()) if matrix.size else 0.0
        self.order = np.argsort(ids)
        self.n = np.zeros(len(ids), np.int64)
        self.top_ids = np.full((len(ids), k), np.iinfo(np.int64).max)
        self.top = np.full((len(ids), k), np.iinfo(np.int64).min)

    def meet(self, shard: _Shard) -> None:
        bound = self.most * shard.most * self.matrix.shape[1]
        if not bound < 2**53:
            self._meet_large(shard)
            return
        kind = np.float32 if bound < 2**24 else np.float64
        scores = self.matrix.astype(kind) @ shard.turned(kind)
        found = np.searchsorted(self.ids, shard.ids, sorter=self.order)
        found = self.order[np.minimum(found, len(self.ids) - 1)]
        own = np.flatnonzero(self.ids[found] == shard.ids)
        scores[found[own], own] = -np.inf
        # rounding to ``kind`` keeps the order, and these scores are exact in it
        least = np.where(self.n == self.k, self.top[:, -1], -np.inf).astype(kind)
        best = scores.max(axis=1)
        rows = np.flatnonzero((best > least) | ((best == least) & (best > -np.inf) & (shard.ids[0] < self.top_ids[:, -1])))
        step = max(1, ONCE // len(shard.ids))
        for n in range(0, len(rows), step):
            self._look(rows[n : n + step], scores, shard.ids, least)

    def _look(self, rows: np.ndarray, scores: np.ndarray, ids: np.ndarray, least: np.ndarray) -> None:
        own, low, k = scores[rows], least[rows], self.k
        if len(ids) > k:
            bare = np.flatnonzero(low == -np.inf)
            low[bare] = np.partition(own[bare], len(ids) - k, axis=1)[:, len(ids) - k]
        r, c = np.divmod(np.flatnonzero(own >= low[:, None]), len(ids))
        score = own[r, c]
        kept = (score > low[r]) | ((score > -np.inf) & ((self.n[rows[r]] < k) | (ids[c] < self.top_ids[rows[r], -1])))
        r, c, score = r[kept], c[kept], score[kept]
        # of those level with the lowest the first k are enough: ids ascend
        level = score == low[r]
        count = np.concatenate([[0], np.cumsum(level)])
        kept = ~level | (count[1:] - count[np.searchsorted(r, r)] <= k)
        self._add(rows, r[kept], ids[c[kept]], score[kept].astype(np.int64))

    def _add(self, rows: np.ndarray, r: np.ndarray, ids: np.ndarray, scores: np.ndarray) -> None:
        """Merges candidates into the lists of ``rows``; r: which of these each is for."""
        old_r, old_c = np.nonzero(np.arange(self.k) < self.n[rows, None])
        r = np.concatenate([old_r, r])
        ids, scores = np.concatenate([self.top_ids[rows[old_r], old_c], ids]), np.concatenate([self.top[rows[old_r], old_c], scores])
        order = np.lexsort((ids, ~scores, r))  # ~ turns the order of longs, the least of them too
        r, ids, scores = r[order], ids[order], scores[order]
        place = np.arange(len(r)) - np.searchsorted(r, r)
        kept = place < self.k
        r, place = r[kept], place[kept]
        self.top_ids[rows[r], place], self.top[rows[r], place] = ids[kept], scores[kept]
        self.n[rows] = np.bincount(r, minlength=len(rows))

    def _meet_large(self, shard: _Shard) -> None:
        whole = np.vectorize(int, otypes=[object])
        turned = whole(shard.matrix).T
        for n, line in enumerate(self.matrix):
            others = np.flatnonzero(shard.ids != self.ids[n])
            own = whole(line).dot(turned)[others].astype(np.int64)  # a query's own row is gone: its square may be beyond a long
            self._add(np.array([n]), np.zeros(len(own), np.int64), shard.ids[others], own)

    def rows(self) -> pa.RecordBatch:
        r, c = np.nonzero(np.arange(self.k) < self.n[:, None])
        return pa.record_batch([pa.array(self.ids[r], pa.int64()), pa.array(self.top_ids[r, c], pa.int64()), pa.array(self.top[r, c], pa.int64())], names=["query_id", "vec_id", "score"])


def _tiles(cells: DataFrame, k: int, block: int) -> DataFrame:
    """query_id, vec_id, score: the k best of each query of a cell; a cell's rows come together, its queries first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, waiting, blocks = None, {}, {}

        def close(key: tuple[int, bool]) -> None:
            parts = waiting.pop(key)
            blocks.setdefault(key[0], []).append(_Block(np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts]), k))

        for batch in batches:
            cell, asks, dims, short = (batch.column(n).to_pylist() for n in ("cell", "candidate", "dim", "short"))
            for n, dim in enumerate(dims):
                if cell[n] != at:
                    yield from (b.rows() for own in blocks.values() for b in own)
                    at, waiting, blocks = cell[n], {}, {}
                ids = np.frombuffer(batch.column("ids")[n].as_buffer(), "<i8")
                matrix = np.frombuffer(batch.column("matrix")[n].as_buffer(), "<i2" if short[n] else "<f8").reshape(len(ids), dim)
                if not asks[n]:
                    key = (dim, short[n])
                    if key in waiting and sum(len(p[0]) for p in waiting[key]) + len(ids) > _rows(dim, block):
                        close(key)
                    waiting.setdefault(key, []).append((ids.copy(), matrix.copy()))
                    continue
                for key in list(waiting):
                    close(key)
                if dim in blocks:
                    shard = _Shard(ids, matrix)
                    for b in blocks[dim]:
                        b.meet(shard)
        yield from (b.rows() for own in blocks.values() for b in own)

    return cells.mapInArrow(run, "query_id long, vec_id long, score long")


def _merged(rows: DataFrame, by: list[str], k: int) -> DataFrame:
    order = Window.partitionBy(*by).orderBy(F.col("score").desc(), F.col("vec_id"))
    return rows.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def _shape(given: DataFrame, asks: Column, k: int, shard: int, group: int) -> tuple[int, int]:
    """Number of groups of queries and of regions of candidates."""
    short = F.forall("x", lambda x: F.abs(x) < float(2**15 // SCALE - 1))
    held = F.size("x") * F.when(short, 2).otherwise(8) + 24 * k + 32
    n, asked, size = given.agg(F.count("*"), F.count(F.when(asks, 1)), F.coalesce(F.sum(F.when(asks, held)), F.lit(0))).first()
    groups = max(1, -(-size // group))
    least = -(-CELLS * given.sparkSession.sparkContext.defaultParallelism // groups)
    return groups, max(1, min(-(-n // shard), max(least, n * groups // (2 * max(1, asked)))))


def top_k(vectors: DataFrame, asks: Column, *, key: str = "vec_id", vector: str = "embedding", k: int = K, block: int = BLOCK, shard: int = SHARD, group: int = GROUP) -> DataFrame:
    """query_id, rank, vec_id, score: the k best candidates of each row for which ``asks`` (over ``id``) holds."""
    given = _given(vectors, key, vector)
    groups, regions = _shape(given, asks, k, shard, group)
    queries = quantised(given.where(asks)).groupBy("id").agg(F.max("v").alias("v"))
    asked = _packed(queries.withColumn("at", F.pmod(F.xxhash64("id"), F.lit(groups)).cast("int")), block)
    spread = asked.withColumn("cell", F.explode(F.sequence(F.col("at"), F.lit(groups * regions - 1), F.lit(groups))))
    shards = _packed(given, shard, regions)
    placed = shards.withColumn("cell", F.explode(F.sequence(F.col("at") * groups, F.col("at") * groups + (groups - 1))))
    both = spread.withColumn("candidate", F.lit(False)).unionByName(placed.withColumn("candidate", F.lit(True)))
    cells = both.drop("at").repartitionById(groups * regions, F.col("cell")).sortWithinPartitions("cell", "candidate")
    found = _tiles(cells, k, block).withColumn("part", F.pmod(F.xxhash64("vec_id"), F.lit(PARTS)))
    near = _merged(found, ["query_id", "part"], k).drop("rank", "part")
    return _merged(near, ["query_id"], k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_k(table(spark, sf_dir, "embeddings"), F.col("id") % EVERY == 0)


SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS x
  FROM embeddings
  WHERE embedding IS NOT NULL AND NOT list_contains(list_transform(embedding, lambda x: x IS NULL OR NOT isfinite(x)), true)),
s AS (
  SELECT q.vec_id AS query_id, c.vec_id AS vec_id,
         CAST(list_sum(list_transform(list_zip(q.x, c.x), lambda p: p[1] * p[2])) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 50 = 0),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
"""
