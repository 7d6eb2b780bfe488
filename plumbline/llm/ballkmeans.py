"""Exact k-means whose clusters are balls: most vectors are placed by their distance to their own centroid alone.

A cluster is a ball around its centroid with its farthest member's distance as radius. Centroids at twice the radius or
more away can be nearest to no member, so each ball has a list of neighbours by distance. A member nearer than half the
way to the nearest neighbour is in the stable core and stays; others lie in annuli, and a member of the i-th annulus is
compared with the first i neighbours only. All numbers are whole, so every comparison is exact.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass
from math import isqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.llm.common import use_workers, written
from plumbline.llm.vectors import blocks, integers, matrix, part, reduced, row_limit, sound, whole
from plumbline.tables import new_path, removed

#: Vectors that are worth a task of their own.
LEAST_VECTORS = 4096
LONG = 2**63 - 1
STATE = "vec_id {kind}, x binary, cluster int, distance string, part int, sums array<string>, far string"


@dataclass
class Balls:
    """Centroids as every task gets them, and of each ball the neighbours by distance: k * (d + k) numbers."""

    centroids: list[list[int]]
    near: list[list[int]]
    gaps: list[list[int]]


def squared(a: list[int], b: list[int]) -> int:
    return sum((x - y) ** 2 for x, y in zip(a, b))


def balls(centroids: list[list[int]], radii: list[int] | None) -> Balls:
    """radii: whole numbers no member is farther away than, for neighbours; without them every centroid is a neighbour."""
    near, gaps = [], []
    for i, c in enumerate(centroids):
        all_gaps = sorted((squared(c, o), j) for j, o in enumerate(centroids) if j != i)
        some = all_gaps if radii is None else [(g, j) for g, j in all_gaps if g <= 4 * radii[i] ** 2]
        near.append([j for _, j in some])
        gaps.append([g for g, _ in some])
    return Balls(centroids, near, gaps)


def distances(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    return ((x - c) ** 2).sum(axis=1)


def placed(x: np.ndarray, own: np.ndarray | None, b: Balls) -> tuple[np.ndarray, np.ndarray, int]:
    """Cluster and squared distance of each row of x, and the number of distances worked out. own: clusters so far."""
    k = len(b.centroids)
    most = max((abs(v) for c in b.centroids for v in c), default=0) + (np.abs(x).max() if x.size else 0)
    small = x.shape[1] * most**2 < 2**51  # four times a distance is then a whole number that doubles hold
    x = x if small else integers(x)
    centroids = [np.array(c, np.float64 if small else object) for c in b.centroids]
    kind = np.float64 if small else object
    cluster, best, compared = np.zeros(len(x), np.int64), np.zeros(len(x), kind), 0
    if own is None:
        best = distances(x, centroids[0])
        for j in range(1, k):
            d = distances(x, centroids[j])
            closer = (d < best).astype(bool)
            cluster[closer], best[closer] = j, d[closer]
        return cluster, best, len(x) * k
    order = np.argsort(own, kind="stable")
    for rows in np.split(order, np.flatnonzero(np.diff(own[order])) + 1):
        i = int(own[rows[0]])
        members = x[rows]
        mine = distances(members, centroids[i])
        compared += len(rows)
        c, d = np.full(len(rows), i), mine.copy()
        gaps = np.array(b.gaps[i], kind)
        annulus = np.searchsorted(gaps, 4 * mine, side="right")  # equal gaps count: such a centroid may tie
        outside = np.argsort(-annulus, kind="stable")
        reach = np.searchsorted(-annulus[outside], -np.arange(len(gaps)), side="left")  # how many lie beyond annulus j
        for j in range(int(annulus.max())):
            some = outside[: reach[j]]
            o, away = b.near[i][j], distances(members[some], centroids[b.near[i][j]])
            compared += len(some)
            closer = ((away < d[some]) | ((away == d[some]) & (o < c[some]))).astype(bool)
            c[some[closer]], d[some[closer]] = o, away[closer]
        cluster[rows], best[rows] = c, d
    return cluster, best, compared


def assignment(shared, dim: int):
    """From (vec_id, x, cluster): the same with new clusters and distances, and a row of sums for each cluster of the task.

    sums holds the number of members, their distances, the distances worked out and the members' sum; far is the largest
    distance.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        b = shared.value
        total: dict[int, list[int]] = {}
        far: dict[int, int] = {}
        kind = None
        for t in blocks(batches, row_limit(dim)):
            x = matrix(t.column("x").to_pylist(), dim)
            own = None if t.column("cluster").null_count else t.column("cluster").to_numpy()
            cluster, distance, compared = placed(x, own, b)
            away = [int(v) for v in distance.tolist()]
            exact = x if x.size == 0 or np.abs(x).max() * len(x) < 2**53 else integers(x)
            for c in np.unique(cluster).tolist():
                at = np.flatnonzero(cluster == c)
                mine = [away[i] for i in at.tolist()]
                new = [len(at), sum(mine), compared, *map(int, exact[at].sum(axis=0))]
                compared = 0
                total[c] = [p + q for p, q in zip(total[c], new)] if c in total else new
                far[c] = max(far.get(c, 0), *mine)
            kind = t.schema.field("vec_id").type
            n = t.num_rows
            columns = [t.column("vec_id").combine_chunks(), t.column("x").combine_chunks(), pa.array(cluster, pa.int32()), pa.array(list(map(str, away)), pa.string()), pa.nulls(n, pa.int32()), pa.nulls(n, pa.list_(pa.string())), pa.nulls(n, pa.string())]
            yield pa.RecordBatch.from_arrays(columns, names=["vec_id", "x", "cluster", "distance", "part", "sums", "far"])
        if kind is not None:
            cs = sorted(total)
            n = len(cs)
            columns = [pa.nulls(n, kind), pa.nulls(n, pa.binary()), pa.array(cs, pa.int32()), pa.nulls(n, pa.string()), pa.array([part()] * n, pa.int32()), pa.array([list(map(str, total[c])) for c in cs], pa.list_(pa.string())), pa.array([str(far[c]) for c in cs], pa.string())]
            yield pa.RecordBatch.from_arrays(columns, names=["vec_id", "x", "cluster", "distance", "part", "sums", "far"])

    return run


def cluster_sums(state: DataFrame) -> dict[int, tuple[list[int], int]]:
    """Of each cluster the sums that its tasks left, and the largest squared distance: k rows of d numbers."""

    def add(t: pa.Table) -> pa.Table:
        total = [sum(map(int, v)) for v in zip(*t.column("sums").to_pylist())]
        far = max(map(int, t.column("far").to_pylist()))
        return pa.table({"cluster": t.column("cluster").slice(0, 1), "sums": pa.array([list(map(str, total))], pa.list_(pa.string())), "far": [str(far)]})

    left = state.where("sums is not null").select("cluster", "part", "sums", "far")
    return {r["cluster"]: (list(map(int, r["sums"])), int(r["far"])) for r in reduced(left, ["cluster"], "cluster int, sums array<string>, far string", add).collect()}


def ball_kmeans(vectors: DataFrame, key: str = "vec_id", vector: str = "embedding", k: int = 40, rounds: int = 5, dim: int = 64, scale: float = 256.0, seed: int = 2) -> DataFrame:
    """(key, cluster, distance, cluster_inertia, inertia, centroid_sha256) of every vector with dim components.

    Components x become floor(scale * x). Vectors that are null, of another length or with null or non-finite components
    take no part. The first centroids are the k vectors whose keys have the smallest SHA-256 of "seed:key", in that order;
    equal hashes (repeated keys) go by the vectors' bytes, and vectors with a null key are members but never first
    centroids. With fewer vectors there are fewer centroids; without any that has a key the result is empty. In each round every vector
    goes to the nearest centroid, ties to the smaller number, and centroids with members become the floor of their mean;
    others stay. Repeated rows count each and are each given. Distances that 64 bits do not hold are exact while clusters
    are formed and shown as the largest long. Other columns are ignored.

    Each round reads the vectors once and writes them with their clusters; the table before is deleted. The driver sees k
    centroids, radii and counts a round.
    """
    spark = vectors.sparkSession
    use_workers(spark)
    kind = dict(vectors.dtypes)[key]
    kept = vectors.where(sound(vector) & (F.size(vector) == dim)).select(F.col(key).alias("vec_id"), F.col(vector).cast("array<double>").alias("v"))

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column("vec_id"), pa.array(whole(b, "v", scale), pa.binary()), pa.nulls(b.num_rows, pa.int32())], names=["vec_id", "x", "cluster"])

    path = new_path(spark, "vectors")
    state = written(kept.mapInArrow(pack, f"vec_id {kind}, x binary, cluster int"), "vectors", path)
    n = state.count()
    hashed = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")), 256)
    first = state.where("vec_id is not null").select(hashed.alias("h"), "x").orderBy("h", "x").limit(k).collect()  # k rows
    centroids = [list(map(int, r)) for r in matrix([r["x"] for r in first], dim).tolist()]
    if not centroids:
        return state.limit(0).select(F.col("vec_id").alias(key), "cluster", *(F.lit(0).cast("long").alias(c) for c in ("distance", "cluster_inertia", "inertia")), F.lit("").alias("centroid_sha256"))
    tasks = 2 * spark.sparkContext.defaultParallelism
    if n < tasks * LEAST_VECTORS:
        state = state.repartition(max(1, -(-n // LEAST_VECTORS)))
    radii = None
    for turn in range(rounds + 1):
        shared = spark.sparkContext.broadcast(balls(centroids, radii))
        new = new_path(spark, "vectors")
        out = written(state.mapInArrow(assignment(shared, dim), STATE.format(kind=kind)), "vectors", new)
        shared.unpersist()
        removed(spark, path)
        path, state = new, out.where("sums is null").select("vec_id", "x", "cluster")
        told = cluster_sums(out)
        if turn == rounds:
            break
        moved = [[s // told[c][0][0] for s in told[c][0][3:]] if c in told else own for c, own in enumerate(centroids)]
        # no member is farther from the new centroid than from the old one and the way between them
        radii = [isqrt(told[c][1]) + isqrt(squared(own, moved[c])) + 2 if c in told else 0 for c, own in enumerate(centroids)]
        centroids = moved
    cut = lambda v: min(v, LONG)
    inertia = cut(sum(s[1] for s, _ in told.values()))
    sha = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids]
    ends = spark.createDataFrame([(c, cut(s[1]), inertia, sha[c]) for c, (s, _) in told.items()], "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    most = F.lit(LONG).cast("decimal(38,0)")
    distance = F.least(F.coalesce(F.expr("try_cast(distance as decimal(38,0))"), most), most)
    rows = out.where("sums is null").select(F.col("vec_id").alias(key), "cluster", distance.cast("long").alias("distance"))
    return rows.join(F.broadcast(ends), "cluster").select(key, "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")  # k rows
