"""Exact top-k inner products by norm order, rotated partial sums and residual bounds.

Vectors are scaled to integers. A rotation that gathers their mass in the first
coordinates (singular vectors of the table, from its Gram matrix summed on Spark)
is applied to all. Each task keeps its vectors in descending length and meets one
block of queries at a time: as long as |q||v| can still reach a query's k-th best
score it takes the partial inner product of the first coordinates and adds the
Cauchy-Schwarz bound |q_rest||v_rest|; pairs that cannot reach the k-th best are
pruned, the others are scored exactly on the integers. The k-th best scores start
from the longest vectors (``HEAD`` of them) and rise as the task goes on.

Queries go to the tasks in blocks of at most ``QUERY_BLOCK`` rows (the only thing
broadcast); a block gives each task's best k per query, merged by a window.

Edge cases: vectors that are null or hold a null or non-finite component take no
part; shorter vectors count as padded with zeros; equal scores go to the smaller
vec_id; a query's own row (rows with its vec_id) is no candidate; rows that share
a vec_id are candidates each, and as queries give one list; with fewer candidates than k all are returned; an empty
table gives no rows. Scores are 64-bit, so |score| must stay below 2**63.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import arrow_map, new_folder, stored

SCALE = 64
QUERY_BLOCK = 4096       # query rows sent to the tasks at once
HEAD = 2048              # longest vectors that set the first k-th best scores
STEP = 1024              # candidates met at a time
QUERIES = 1024           # and queries
LEAD = 0.9               # share of the mass in the partial sums
EXACT = 1 << 52          # inner products below it are exact in double precision


def integer_vectors(vectors: DataFrame, scale: int = SCALE) -> DataFrame:
    """vec_id, vec (array<bigint>), norm2 of the rows that take part."""
    x = F.col("embedding").cast("array<double>")
    fine = lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))
    rows = vectors.where(F.col("embedding").isNotNull() & F.forall(x, fine))
    vec = F.transform(x, lambda c: F.floor(c * scale).cast("bigint"))
    rows = rows.select(F.col("vec_id").cast("long").alias("vec_id"), vec.alias("vec"))
    square = F.aggregate("vec", F.lit(0.0), lambda s, c: s + c.cast("double") * c.cast("double"))
    return rows.withColumn("norm2", square)


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    """List column as rows of ``dim`` integers, shorter ones padded with zeros."""
    offsets = column.offsets.to_numpy()
    flat = column.values.to_numpy(zero_copy_only=False)
    out = np.zeros((len(column), dim), np.int64)
    for row, (lo, hi) in enumerate(zip(offsets, offsets[1:])):
        out[row, :hi - lo] = flat[lo:hi]
    return out


def rotation(ints: DataFrame, dim: int) -> tuple[np.ndarray, int]:
    """Right singular vectors of the table, strongest first (dim x dim), and how many of them
    hold LEAD of its mass."""
    def gram(batches):
        total = np.zeros((dim, dim))
        for batch in batches:
            m = _matrix(batch.column(0), dim).astype(float)
            total += m.T @ m
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(dim)), pa.array(list(total), pa.list_(pa.float64()))],
                                         ["i", "row"])

    parts = arrow_map(ints.select("vec"), gram, "i long, row array<double>")
    sums = parts.groupBy("i").agg(F.array(*(F.sum(F.col("row")[k]) for k in range(dim))).alias("row")).collect()
    m = np.zeros((dim, dim))
    for r in sums:                                            # dim rows of dim numbers
        m[r["i"]] = r["row"]
    values, turn = np.linalg.eigh(m)
    mass = np.cumsum(np.maximum(values[::-1], 0))
    return turn[:, ::-1].copy(), int(np.searchsorted(mass, LEAD * mass[-1])) + 1


class QueryBlock:
    """Integer queries, their rotated forms and their k-th best scores so far."""

    def __init__(self, ids: np.ndarray, ints: np.ndarray, turn: np.ndarray, first: int):
        self.ids, self.ints, self.turn, self.first = ids, ints, turn, first
        rotated = ints @ turn
        self.lead = rotated[:, :first]                       # the partial sum's coordinates
        self.rest = np.linalg.norm(rotated[:, first:], axis=1)
        self.norm = np.linalg.norm(rotated, axis=1)
        self.largest = int(np.abs(ints).max(initial=0))
        self.floor = np.full(len(ids), -np.inf)

    def products(self, rows: np.ndarray, ints: np.ndarray) -> np.ndarray:
        """Exact scores of these queries with all of ``ints``."""
        if self.largest * int(np.abs(ints).max(initial=0)) * ints.shape[1] < EXACT:
            return self.ints[rows].astype(float) @ ints.T.astype(float)
        return self.ints[rows] @ ints.T

    def start(self, ids: np.ndarray, ints: np.ndarray, k: int) -> None:
        """Sets the k-th best scores that these candidates alone give."""
        for lo in range(0, len(self.ids) if len(ids) > k else 0, QUERIES):
            rows = np.arange(lo, min(lo + QUERIES, len(self.ids)))
            scores = self.products(rows, ints).astype(float)
            scores[self.ids[rows, None] == ids] = -np.inf
            self.floor[rows] = np.nextafter(np.partition(scores, -k, axis=1)[:, -k], -np.inf)

    def meet(self, best: "Best", ids: np.ndarray, ints: np.ndarray, norms: np.ndarray) -> bool:
        """Scores the candidates (descending length) that can count; False if none of
        these, and so none shorter, can."""
        slack = 1e-9 * self.norm * norms[0] + 0.25           # of the doubles; scores are whole
        live = np.flatnonzero(self.norm * norms[0] + slack >= self.floor)
        if not len(live):
            return False
        rotated = ints @ self.turn
        rest = np.linalg.norm(rotated[:, self.first:], axis=1)
        for lo in range(0, len(live), QUERIES):
            rows = live[lo:lo + QUERIES]
            bound = self.lead[rows] @ rotated[:, :self.first].T
            bound += np.outer(self.rest[rows], rest)
            able = bound >= (self.floor - slack)[rows, None]
            rows, cols = rows[able.any(axis=1)], np.flatnonzero(able.any(axis=0))
            if not len(rows):
                continue
            scores = self.products(rows, ints[cols])
            r, c = np.nonzero((scores >= self.floor[rows, None]) & (self.ids[rows, None] != ids[cols]))
            best.add(rows[r], ids[cols[c]], scores[r, c].astype(np.int64))
        self.floor = np.maximum(self.floor, best.kth(len(self.ids)))
        return True


class Best:
    """The k best (score, smaller id first) of each query; newcomers wait until there are many."""

    def __init__(self, k: int):
        self.k = k
        self.found = [tuple(np.zeros(0, np.int64) for _ in range(3))]
        self.waiting = 0

    def add(self, rows, ids, scores) -> None:
        self.found.append((rows, ids, scores))
        self.waiting += len(rows)
        if self.waiting > len(self.found[0][0]) + (1 << 16):
            self.settle()

    def settle(self):
        rows, ids, scores = (np.concatenate(x) for x in zip(*self.found))
        order = np.lexsort((ids, -scores, rows))
        rows, ids, scores = rows[order], ids[order], scores[order]
        keep = np.arange(len(rows)) - np.searchsorted(rows, rows) < self.k
        self.found, self.waiting = [(rows[keep], ids[keep], scores[keep])], 0
        return self.found[0]

    def kth(self, queries: int) -> np.ndarray:
        """The k-th best of those settled; lower than the true one or -inf is fine."""
        rows, _, scores = self.found[0]
        out = np.full(queries, -np.inf)
        ends = np.searchsorted(rows, np.arange(queries), side="right")
        full = ends - np.searchsorted(rows, np.arange(queries)) == self.k
        out[full] = scores[ends[full] - 1]
        return out


def _search(block: QueryBlock, dim: int, k: int):
    def run(batches):
        best = Best(k)
        for batch in batches:
            norms = np.sqrt(batch.column(2).to_numpy())
            down = np.argsort(-norms, kind="stable")         # in descending length, also where two files meet
            norms = norms[down]
            ids = batch.column(0).to_numpy()[down]
            ints = _matrix(batch.column(1), dim)[down]
            for lo in range(0, len(ids), STEP):
                part = slice(lo, lo + STEP)
                if not block.meet(best, ids[part], ints[part], norms[part]):
                    break
        rows, ids, scores = best.settle()
        yield pa.RecordBatch.from_arrays([pa.array(block.ids[rows]), pa.array(ids), pa.array(scores)],
                                         ["query_id", "vec_id", "score"])
    return run


def top_inner_products(vectors: DataFrame, is_query: Column, k: int = 20, scale: int = SCALE) -> DataFrame:
    """query_id, rank (from 1), vec_id, score for every row of ``vectors`` where ``is_query``
    holds, against all rows."""
    spark = vectors.sparkSession
    rows = integer_vectors(vectors, scale).where(F.col("vec_id").isNotNull())
    ints = stored(rows.sortWithinPartitions(F.desc("norm2"), "vec_id"), "topk-vectors")
    dim = ints.agg(F.max(F.size("vec"))).first()[0] or 1
    turn, lead = rotation(ints, dim)
    queries = stored(ints.where(is_query).select("vec_id", "vec").distinct()
                     .withColumn("block", F.pmod(F.xxhash64("vec_id"), F.lit(1 << 20))), "topk-queries")
    n = queries.count()
    head = ints.orderBy(F.desc("norm2"), "vec_id").limit(HEAD).collect()           # HEAD rows
    head_ids, heads = np.array([r["vec_id"] for r in head], np.int64), _padded([r["vec"] for r in head], dim)
    blocks = -(-n * 5 // (4 * QUERY_BLOCK))                  # a fifth of room above the mean block
    path, schema = new_folder(spark, "topk-found"), "query_id long, vec_id long, score long"
    for b in range(blocks):                                  # a table, so the plan stays small however many blocks
        part = queries.where(F.floor(F.col("block") * blocks / (1 << 20)) == b).orderBy("vec_id").collect()
        if not part:
            continue
        block = QueryBlock(np.array([r["vec_id"] for r in part]), _padded([r["vec"] for r in part], dim), turn, lead)
        block.start(head_ids, heads, k)
        arrow_map(ints, _search(block, dim, k), schema).write.mode("append").parquet(path)
    if not n:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    found = spark.read.schema(schema).parquet(path)
    return (found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
            .select("query_id", "rank", "vec_id", "score"))


def _padded(vectors: list[list[int]], dim: int) -> np.ndarray:
    out = np.zeros((len(vectors), dim), np.int64)
    for row, v in enumerate(vectors):
        out[row, :len(v)] = v
    return out
