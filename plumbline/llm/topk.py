"""Exact top-k search by inner product: sparse query rows scatter weighted postings into dense score arrays.

Vectors stay where they lie; blocks of queries of bounded size are sent to all tasks. A task holds the postings by
dimension of a block of its vectors, and for each query one dense array of scores, to which every non-zero term of the
query adds its weighted posting. A partition step selects each query's best of the block, a task merges its blocks'
selections, and the tasks' selections are merged by rank.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plumbline.llm.common import use_workers, written

#: Vectors in a block; queries, and bytes of their components, that are sent to the tasks at once.
VECTORS, QUERIES, QUERY_BYTES = 8192, 1 << 16, 32 << 20
#: Vectors that are worth a task of their own.
LEAST_VECTORS = 1024


def flat(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """All components of a list column, and where each row's begin."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    off = np.asarray(column.offsets).astype(np.int64)
    return np.asarray(column.values)[off[0] : off[-1]], off - off[0]


def postings(values: np.ndarray, starts: np.ndarray) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """By dimension: the rows with a non-zero component there, and those components."""
    sizes = np.diff(starts)
    row = np.repeat(np.arange(len(sizes)), sizes)
    dim = np.arange(len(values)) - np.repeat(starts[:-1], sizes)
    order = np.argsort(dim, kind="stable")
    order = order[values[order] != 0]
    ds, first = np.unique(dim[order], return_index=True)
    return {int(d): (row[order[a:b]], values[order[a:b]]) for d, a, b in zip(ds, first, np.append(first[1:], len(order)))}


class Queries:
    """A block of queries, as every task gets it."""

    def __init__(self, table: pa.Table):
        self.rows, self.ids = table.column("row").to_numpy(), table.column("id").to_numpy()
        self.values, self.starts = flat(table.column("vec")) if table.num_rows else (np.zeros(0), np.zeros(1, np.int64))

    def __iter__(self) -> Iterator[tuple[int, int, np.ndarray]]:
        for i, (row, name) in enumerate(zip(self.rows.tolist(), self.ids.tolist())):
            yield row, name, self.values[self.starts[i] : self.starts[i + 1]]


def scores_of(x: np.ndarray, own: dict[int, tuple[np.ndarray, np.ndarray]], n: int, largest: float) -> np.ndarray:
    """The inner products of one query with n vectors, term by term; exact also beyond what doubles hold."""
    if np.abs(x).sum() * largest < 2**53:  # sums of whole numbers below 2**53 are exact in doubles
        score = np.zeros(n)
        for d in np.flatnonzero(x).tolist():
            if (p := own.get(d)) is not None:
                if len(p[0]) == n:
                    score += x[d] * p[1]
                else:
                    score[p[0]] += x[d] * p[1]
        return score
    exact = [0] * n
    for d in np.flatnonzero(x).tolist():
        for i, w in zip(*own.get(d, ((), ()))):
            exact[i] += int(x[d]) * int(w)
    return np.array(exact, dtype=object)


def selected(score: np.ndarray, ids: np.ndarray, rows: np.ndarray, k: int) -> list[tuple[int, int, int]]:
    """(-score, id, row) of the k best, equal scores to the smaller id."""
    if len(score) > k:
        edge = np.partition(score, len(score) - k)[len(score) - k] if score.dtype != object else sorted(score)[-k]
        near = np.flatnonzero(score >= edge)
        score, ids, rows = score[near], ids[near], rows[near]
    return sorted((-int(s), i, r) for s, i, r in zip(score.tolist(), ids.tolist(), rows.tolist()))[:k]


def sortable(score: int) -> bytes:
    """A whole number of any size as bytes in the numbers' order."""
    size = abs(score).bit_length() // 8 + 1
    if score >= 0:
        return b"\x01" + size.to_bytes(4, "big") + score.to_bytes(size, "big")
    return b"\x00" + (2**32 - 1 - size).to_bytes(4, "big") + ((1 << 8 * size) - 1 + score).to_bytes(size, "big")


def search(queries, k: int):
    """From (row, id, vec): each query's k best among one task's vectors."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        asked = list(queries.value)
        best: list[list[tuple[int, int, int]]] = [[] for _ in asked]
        held: list[pa.RecordBatch] = []

        def block() -> None:
            t = pa.Table.from_batches(held)
            rows, ids = t.column("row").to_numpy(), t.column("id").to_numpy()
            own = postings(*flat(t.column("vec")))
            largest = max((np.abs(w).max() for _, w in own.values()), default=0.0)
            for q, (row, _, x) in enumerate(asked):
                usable = rows != row
                score = scores_of(x, own, len(rows), largest)
                if not usable.all():
                    found = selected(score[usable], ids[usable], rows[usable], k)
                else:
                    found = selected(score, ids, rows, k)
                best[q] = sorted(best[q] + found)[:k]

        for b in batches:
            if b.num_rows:
                held.append(b)
            if sum(x.num_rows for x in held) >= VECTORS:
                block()
                held = []
        if held:
            block()
        out = [(row, name, max(-(2**63), min(2**63 - 1, -s)), i, r, sortable(-s)) for (row, name, _), own in zip(asked, best) for s, i, r in own]
        if out:
            *numbers, order = zip(*out)
            yield pa.RecordBatch.from_arrays([*(pa.array(c, pa.int64()) for c in numbers), pa.array(order, pa.binary())], names=["query_row", "query_id", "score", "vec_id", "vec_row", "exact"])

    return run


def top_k(vectors: DataFrame, is_query: Column, key: str = "vec_id", vector: str = "embedding", scale: float = 256.0, k: int = 5) -> DataFrame:
    """(query_id, rank, vec_id, score): for each row that is_query picks, the k other rows of highest integer inner product.

    Components x become floor(scale * x). Rows whose vector is null or holds a null or non-finite component take no part,
    nor do rows without a key; an empty vector scores 0 with everything. Vectors of different lengths are compared as if
    the shorter ended in zeros. Repeated rows are rows of their own: each is a query and a candidate, only never its own.
    Ties go to the smaller id. With fewer than k other rows all are given. Scores are exact at any size; those beyond 64 bits
    rank by their whole value and are shown cut to its ends.
    Other columns are ignored. Queries go to the tasks in blocks of about QUERIES rows or QUERY_BYTES: the vectors
    are read once a block and never shuffled, but for a small table, which is first dealt to all cores.
    """
    use_workers(vectors.sparkSession)
    spark = vectors.sparkSession
    x = F.col(vector).cast("array<double>")
    sound = F.col(vector).isNotNull() & F.col(key).isNotNull() & ~F.coalesce(F.exists(x, lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf"))), F.lit(True))
    most = 2.0**1023
    times = lambda v: F.greatest(F.least(v * F.lit(float(scale)), F.lit(most)), F.lit(-most))
    # from 2**52 on doubles are whole numbers, which a long would not hold
    scaled = F.transform(x, lambda v: F.when(F.abs(times(v)) < 2.0**52, F.floor(times(v)).cast("double")).otherwise(times(v)))
    rows = written(vectors.where(sound).select(F.col(key).cast("long").alias("id"), scaled.alias("vec"), F.coalesce(is_query, F.lit(False)).alias("asks")).withColumn("row", F.monotonically_increasing_id()), "vectors")
    size = rows.agg(F.count("*").alias("n"), F.count_if("asks").alias("q"), F.coalesce(F.max(F.size("vec")), F.lit(0)).alias("d")).first()
    most = max(1, min(QUERIES, QUERY_BYTES // (8 * max(1, size["d"]))))
    blocks = max(1, -(-size["q"] // most))
    offered = rows.select("row", "id", "vec")
    tasks = min(2 * spark.sparkContext.defaultParallelism, -(-size["n"] // LEAST_VECTORS))
    if size["n"] < tasks * VECTORS:
        offered = offered.repartition(max(1, tasks), "row")
    place = F.row_number().over(Window.partitionBy("query_row").orderBy(F.desc("exact"), "vec_id", "vec_row"))
    done = None
    for i in range(blocks):
        own = rows.where(F.col("asks") & (F.pmod(F.xxhash64("row"), F.lit(blocks)) == i)).select("row", "id", "vec").toArrow()  # one block of queries
        shared = spark.sparkContext.broadcast(Queries(own))
        found = offered.mapInArrow(search(shared, k), "query_row long, query_id long, score long, vec_id long, vec_row long, exact binary")
        found = found.withColumn("rank", place).where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
        if blocks > 1:
            found = written(found, "found")
            shared.unpersist()
        done = found if done is None else done.unionByName(found)
    return done
