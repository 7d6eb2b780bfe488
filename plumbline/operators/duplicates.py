"""Exact and near duplicates: hashes, correlated vectors, clusters, and leakage between splits.

Standardised vectors are points on a sphere, and their correlation is the cosine of the angle between them. Each is put
into a cell by its nearest pivot and its angle to it. Cells whose angles to some pivot lie further apart than the wanted
pairs do cannot hold such a pair (triangle inequality) and are never multiplied: that is exact whatever the pivots are.

Blocks that do meet are rotated so that the first dimensions say most. Rows are put in tiles by their leading components,
and tiles whose boxes lie too far apart are skipped. Elsewhere the leading components are multiplied alone: with the norms
of what they leave out (Cauchy-Schwarz) they bound the whole product, and only pairs whose bound is high are finished. That
prunes vectors spread evenly over the sphere too, which no cell can tell apart.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.functions.scalar import ratio
from plumbline.operators.graph import cluster_ids, forest
from plumbline.tables import written

#: Vectors in a block at most, in a block of small tables at least, and in a tile of a block.
BLOCK, LEAST_BLOCK, TILE = 8192, 512, 256
#: Vectors that the rotation and the number of leading dimensions are taken from, the longest that are rotated, and pairs
#: that are finished one by one if they are under this share of a tile. None of this changes a result.
FITTED, LONGEST, FEW = 1024, 2048, 0.1
#: Vectors that serve as pivots, and steps of the angle to the nearest one: at most PIVOTS * STEPS cells.
PIVOTS, STEPS = 32, 90
THRESHOLDS = (0.90, 0.95, 0.97, 0.99)


def exact_duplicate_groups(samples: DataFrame, content: str, key: str = "idx") -> DataFrame:
    """(digest, n, first_key): contents that several rows share; empty contents count, null ones do not."""
    hashed = samples.where(F.col(content).isNotNull()).select(F.col(key).alias("key"), F.md5(F.col(content).cast("binary")).alias("digest"))
    return hashed.groupBy("digest").agg(F.count("*").alias("n"), F.min("key").alias("first_key")).where("n > 1")


def duplicate_members(samples: DataFrame, content: str, key: str = "idx") -> DataFrame:
    """(digest, key) of every row in a group of exact duplicates."""
    hashed = samples.where(F.col(content).isNotNull()).select(F.md5(F.col(content).cast("binary")).alias("digest"), F.col(key).alias("key"))
    return hashed.join(exact_duplicate_groups(samples, content, key).select("digest"), "digest", "left_semi")


def standardised(vectors: DataFrame, key: str, vector: str) -> DataFrame:
    """(idx, z): vectors less their mean over their population deviation; constant and missing ones are all 0."""
    v = F.col(vector).cast("array<double>")
    base = vectors.select(F.col(key).alias("idx"), F.coalesce(v, F.array().cast("array<double>")).alias("v"))
    total = lambda c: F.aggregate(c, F.lit(0.0), lambda a, x: a + x)
    base = base.withColumn("m", F.try_divide(total(F.col("v")), F.size("v")))
    base = base.withColumn("s", F.sqrt(F.try_divide(total(F.transform("v", lambda x: (x - F.col("m")) * (x - F.col("m")))), F.size("v"))))
    return base.select("idx", F.transform("v", lambda x: F.when(F.col("s") > 1e-8, (x - F.col("m")) / F.col("s")).otherwise(0.0)).alias("z"))


def matrix(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    """Rows of a list column as a matrix, shorter ones filled with zeros."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    off = np.asarray(column.offsets)
    flat, sizes = np.asarray(column.values), np.diff(off)
    width = int(sizes.max(initial=0))
    if (sizes == width).all():
        return flat[off[0] : off[-1]].reshape(len(sizes), width)
    out = np.zeros((len(sizes), width))
    out[np.arange(width) < sizes[:, None]] = flat[off[0] : off[-1]]
    return out


def units(m: np.ndarray) -> np.ndarray:
    """Rows over their length; zero rows stay."""
    size = np.sqrt((m * m).sum(axis=1, keepdims=True))
    return np.divide(m, size, out=np.zeros_like(m), where=size > 0)


def block_size(n: int) -> int:
    return min(BLOCK, max(LEAST_BLOCK, -(-n // 6)))


def cells(z: DataFrame, pivots: np.ndarray) -> tuple[DataFrame, np.ndarray, np.ndarray, np.ndarray]:
    """z with cell; and by cell: rows, least and greatest angle to each pivot. Cells follow pivots and steps of the angle."""
    known = z.sparkSession.sparkContext.broadcast(pivots)
    names = [f"{side}{i}" for side in ("lo", "hi") for i in range(len(pivots))]

    def angles(b: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
        own = matrix(b.column("z"))
        p = known.value
        width = max(own.shape[1], p.shape[1])
        wide = lambda m: np.pad(m, ((0, 0), (0, width - m.shape[1])))
        a = np.arccos(np.clip(units(wide(own)) @ wide(p).T, -1, 1))
        near = a.argmin(axis=1)
        step = np.minimum((a[np.arange(len(a)), near] * (STEPS / np.pi)).astype(np.int64), STEPS - 1)
        return a, near * STEPS + step

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                yield pa.RecordBatch.from_arrays([*b.columns, pa.array(angles(b)[1], pa.int64())], names=[*b.schema.names, "cell"])

    def bounds(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            a, cell = angles(b)
            order = np.argsort(cell, kind="stable")
            a, cell = a[order], cell[order]
            first = np.flatnonzero(np.concatenate(([True], cell[1:] != cell[:-1])))
            lo, hi = np.minimum.reduceat(a, first), np.maximum.reduceat(a, first)
            columns = [cell[first], np.diff(np.append(first, len(cell))), *lo.T, *hi.T]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["cell", "n", *names])

    found = z.mapInArrow(bounds, f"cell long, n long, {', '.join(f'{c} double' for c in names)}").groupBy("cell").agg(F.sum("n").alias("n"), *(F.min(c).alias(c) if c[0] == "l" else F.max(c).alias(c) for c in names)).orderBy("cell").toArrow()  # at most PIVOTS * STEPS rows
    columns = [found.column(c).to_numpy() for c in ("cell", "n", *names)]
    table = np.stack(columns[2:]) if found.num_rows else np.zeros((len(names), 0))
    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in z.schema.fields)
    return z.mapInArrow(place, f"{kinds}, cell long"), np.stack(columns[:2]), table[: len(pivots)], table[len(pivots) :]


class Lead:
    """How blocks are rotated (None: not at all) and how many leading dimensions bound a product first."""

    def __init__(self, rotation: np.ndarray | None, k: int):
        self.rotation, self.k = rotation, k

    @staticmethod
    def fit(sample: np.ndarray, least: float) -> Lead:
        """Principal directions of a sample, and the k that makes the sample's own products cheapest."""
        n, d = sample.shape
        if n < 2 or not 8 <= d <= LONGEST or least <= 0:
            return Lead(None, 0)
        u = units(sample)
        values, turn = np.linalg.eigh(u.T @ u)
        turned = u @ turn[:, ::-1]
        best = (1.0, 0)
        for k in sorted({*range(4, min(33, d), 4), *(d // x for x in (8, 6, 5, 4, 3) if d // x)}):
            head = turned[:, :k]
            tail = np.sqrt(np.maximum(0, 1 - (head * head).sum(axis=1)))
            open_pairs = float((head @ head.T + np.outer(tail, tail) > least).sum() - n) / (n * (n - 1))
            best = min(best, (k / d + 10 * open_pairs, k))
        return Lead(turn[:, ::-1][:, : best[1]].copy(), best[1])

    def heads(self, m: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Leading components of each row's direction, and the norm of the rest."""
        u = units(m)
        turn = self.rotation if m.shape[1] <= len(self.rotation) else np.pad(self.rotation, ((0, m.shape[1] - len(self.rotation)), (0, 0)))
        head = u @ turn[: m.shape[1]]
        return head.astype(np.float32), np.sqrt(np.maximum(0, (u * u).sum(axis=1) - (head * head).sum(axis=1))).astype(np.float32)


def tiled(points: np.ndarray) -> list[np.ndarray]:
    """Rows in tiles of at most TILE, halved at the median of one dimension after the other."""
    parts, level = [np.arange(len(points))], 0
    while max(map(len, parts), default=0) > TILE:
        dim = level % points.shape[1]
        halves = []
        for p in parts:
            if len(p) > TILE:
                p = p[np.argpartition(points[p, dim], len(p) // 2)]
                halves += [p[: len(p) // 2], p[len(p) // 2 :]]
            else:
                halves.append(p)
        parts, level = halves, level + 1
    return [p for p in parts if len(p)]


def near(m: np.ndarray, left: np.ndarray, right: np.ndarray | None, least: float, lead: Lead, work: list[float] | None = None) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Rows of left, rows of right (None: of left too, each pair once) and their correlation, where it is above least.

    work, if given, counts multiplications done and those of the whole product.
    """
    width = max(1, m.shape[1])
    same = right is None
    spend = lambda done: work is not None and work.__setitem__(0, work[0] + done)
    if work is not None:
        work[1] += width * (len(left) * (len(left) - 1) / 2 if same else len(left) * len(right))
    if not lead.k:  # no bound helps
        for at in range(0, len(left), TILE):
            rows = left[at : at + TILE]
            columns = left[at:] if same else right
            c = m[rows] @ m[columns].T / width
            spend(c.size * width)
            if same:
                c[np.arange(len(rows))[:, None] >= np.arange(len(columns))] = -np.inf
            i, j = np.nonzero(c > least)
            yield rows[i], columns[j], c[i, j]
        return
    head, tail = lead.heads(m)
    points = np.column_stack((head, tail))
    rows_of = [left[t] for t in tiled(points[left])]
    columns_of = rows_of if same else [right[t] for t in tiled(points[right])]
    boxes = lambda parts: (np.array([points[p].min(axis=0) for p in parts]), np.array([points[p].max(axis=0) for p in parts]))
    (low, high), (low2, high2) = boxes(rows_of), boxes(columns_of)
    far = 2 * (1 - least) + 1e-4  # the square of the distance of directions this correlated
    for a, rows in enumerate(rows_of):
        gap = np.maximum(0, np.maximum(low[a] - high2, low2 - high[a]))
        meets = (gap * gap).sum(axis=1) <= far
        if same:
            meets[:a] = False
        if not meets.any():
            continue
        columns = np.concatenate([columns_of[b] for b in np.flatnonzero(meets)])
        bound = head[rows] @ head[columns].T + np.outer(tail[rows], tail[columns])
        spend(bound.size * (lead.k + 1))
        hot = bound > least - 1e-5
        if same:  # the first tile among the columns is the rows' own
            own = len(rows) if meets[a] else 0
            hot[:, :own] &= np.arange(len(rows))[:, None] < np.arange(own)
        if hot.mean() < FEW:
            i, j = np.nonzero(hot)
            for at in range(0, len(i), 1 << 16):
                x, y = rows[i[at : at + (1 << 16)]], columns[j[at : at + (1 << 16)]]
                c = np.einsum("ij,ij->i", m[x], m[y]) / width
                spend(len(x) * width)
                some = c > least
                yield x[some], y[some], c[some]
        else:
            c = m[rows] @ m[columns].T / width
            spend(c.size * width)
            i, j = np.nonzero(hot & (c > least))
            yield rows[i], columns[j], c[i, j]


def grouped(counts: np.ndarray, n: np.ndarray, lo: np.ndarray, hi: np.ndarray, size: int) -> tuple[np.ndarray, list[tuple[int, np.ndarray, np.ndarray]]]:
    """The group of each cell, and each group's rows and bounds: neighbouring small cells share a group of at most size."""
    of, groups = np.zeros(len(counts), int), []
    for c, m in enumerate(n.tolist()):
        if groups and groups[-1][0] + m <= size:
            groups[-1] = (groups[-1][0] + m, np.minimum(groups[-1][1], lo[:, c]), np.maximum(groups[-1][2], hi[:, c]))
        else:
            groups.append((m, lo[:, c], hi[:, c]))
        of[c] = len(groups) - 1
    return of, groups


def block_pairs(z: DataFrame, least: float, sides: bool = False) -> tuple[DataFrame, Lead, int, int]:
    """(lo, hi, b, idx, z, ...): each row of z(idx, z, ...) once for each pair of blocks that may hold a correlation above
    least; how to multiply them; and how many such pairs there are, of how many in all.

    With sides, rows are on a left or a right side (boolean is_left), and only a left and a right block make a pair: lo is
    the left one, and no row goes where its side has no partner.
    """
    spark = z.sparkSession
    n = z.count()
    first = z.orderBy(F.xxhash64("idx"), "idx").limit(FITTED).select("z").toArrow().column("z")
    width = max((len(x) for x in first), default=0)
    sample = np.array([x.as_py() + [0.0] * (width - len(x)) for x in first], float).reshape(len(first), width)
    lead = Lead.fit(sample, least)
    with_cell, counts, lo, hi = cells(z, units(sample[:PIVOTS]) if n else np.zeros((1, 1)))
    size = block_size(n)
    side = lambda left: with_cell.where(F.col("is_left") if left else ~F.col("is_left")) if sides else with_cell
    own_counts = []
    for left in (True, False):
        if sides:
            known = {r["cell"]: r["count"] for r in side(left).groupBy("cell").count().collect()}  # at most PIVOTS * STEPS rows
            own_counts.append(np.array([known.get(int(c), 0) for c in counts[0]], int))
        else:
            own_counts.append(counts[1])
    plans = [grouped(counts[0], c, lo, hi, size) for c in own_counts]
    chunks = [[-(-g[0] // size) for g in groups] for _, groups in plans]
    far = np.arccos(np.clip(least, -1, 1)) + 1e-6
    partners: list[list[list[int]]] = [[[] for _ in groups] for _, groups in plans]
    kept = 0
    low, high = (np.stack([g[i] for g in plans[1][1]]) if plans[1][1] else np.zeros((0, len(lo))) for i in (1, 2))
    for i, g in enumerate(plans[0][1]):
        apart = np.maximum(low - g[2], g[1] - high).max(axis=1, initial=0)
        for j in np.flatnonzero(apart <= far).tolist():
            partners[0][i].append(j)
            if sides:
                partners[1][j].append(i)
            pairs = chunks[0][i] * chunks[1][j]
            kept += pairs if sides or j > i else chunks[0][i] * (chunks[0][i] + 1) // 2 if i == j else 0
    total = (sum(chunks[0]), sum(chunks[1]))
    name = lambda unit, c: F.shiftleft(unit.cast("long"), 32) + c
    out = None
    for at in (0, 1) if sides else (0,):
        place = spark.createDataFrame([(int(c), int(g)) for c, g in zip(counts[0], plans[at][0])], "cell long, unit int")
        rows = [(i, chunks[at][i], [(j, chunks[1 - at][j]) for j in partners[at][i] if chunks[1 - at][j]]) for i in range(len(partners[at])) if chunks[at][i]]
        meets = spark.createDataFrame(rows, "unit int, chunks int, partners array<struct<unit: int, chunks: int>>")
        others = F.flatten(F.transform("partners", lambda p: F.transform(F.sequence(F.lit(0), p["chunks"] - 1), lambda c: name(p["unit"], c))))
        own = side(at == 0).join(F.broadcast(place), "cell").join(F.broadcast(meets), "unit")  # both have a row a cell at most
        own = own.withColumn("b", name(F.col("unit"), F.pmod(F.xxhash64("idx"), F.col("chunks")))).withColumn("other", F.explode(others))
        ends = (("b", "other"), ("other", "b"))[at] if sides else None
        pair = (F.col(ends[0]), F.col(ends[1])) if sides else (F.least("b", "other"), F.greatest("b", "other"))
        some = own.select(pair[0].alias("lo"), pair[1].alias("hi"), "b", *z.columns)
        out = some if out is None else out.unionByName(some)
    return out, lead, kept, total[0] * total[1] if sides else total[0] * (total[0] + 1) // 2


def block_near(t: pa.Table, least: float, lead: Lead) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Names and correlations, above least, of the rows of a pair of blocks; a left side's names come first."""
    lo, hi = t.column("lo")[0].as_py(), t.column("hi")[0].as_py()
    idx, m = t.column("idx").to_numpy(), matrix(t.column("z"))
    if "is_left" in t.column_names:
        is_left = t.column("is_left").to_numpy(zero_copy_only=False)
        left, right = np.flatnonzero(is_left), np.flatnonzero(~is_left)
    else:
        b = t.column("b").to_numpy()
        left, right = np.flatnonzero(b == lo), np.flatnonzero(b == hi) if lo != hi else None
    for i, j, c in near(m, left, right, least, lead):
        yield idx[i], idx[j], c


def correlated_pairs(vectors: DataFrame, threshold: float = 0.95, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(i, j, corr): pairs i < j whose Pearson correlation is above the threshold, exactly, from blocks of a matrix product.

    Each pair of blocks is one task's work of bounded size, and only blocks that may hold such a pair meet. Only pairs above
    the threshold leave a task. Keys are unique.
    """
    z = written(standardised(vectors, key, vector), "vectors")

    blocks, lead, *_ = block_pairs(z, threshold)

    def product(t: pa.Table) -> pa.Table:
        found = [(np.minimum(u, v), np.maximum(u, v), c) for u, v, c in block_near(t, threshold, lead)]
        return pa.table(dict(zip(("i", "j", "corr"), (np.concatenate(x) for x in zip(*found))))) if found else pa.table({"i": pa.array([], pa.int64()), "j": pa.array([], pa.int64()), "corr": pa.array([], pa.float64())})

    return blocks.groupBy("lo", "hi").applyInArrow(product, "i long, j long, corr double")


def links_and_best(vectors: DataFrame, threshold: float, least: float, key: str, vector: str) -> DataFrame:
    """(u, v) links with the components of all pairs above threshold, and (u, null, best) rows: the best correlation of a
    row within a pair of blocks, where it is above least. Copies need no pair of each with each: a block gives a forest."""
    z = written(standardised(vectors, key, vector), "vectors")

    floor = min(least, threshold)
    blocks, lead, *_ = block_pairs(z, floor)

    def product(t: pa.Table) -> pa.Table:
        names = np.unique(t.column("idx").to_numpy())
        best, edges = np.full(len(names), -np.inf), []
        for u, v, c in block_near(t, floor, lead):
            some = c > threshold
            edges.append(forest(u[some], v[some]))
            for x in (u, v):
                np.maximum.at(best, np.searchsorted(names, x), c)
        a, b = forest(*(np.concatenate(x) for x in zip(*edges))) if edges else (np.zeros(0, np.int64),) * 2
        known = best > least
        u, v = pa.array(np.concatenate((a, names[known])), pa.int64()), pa.concat_arrays([pa.array(b, pa.int64()), pa.nulls(int(known.sum()), pa.int64())])
        return pa.table({"u": u, "v": v, "best": pa.concat_arrays([pa.nulls(len(a), pa.float64()), pa.array(best[known])])})

    return blocks.groupBy("lo", "hi").applyInArrow(product, "u long, v long, best double")


def near_duplicate_clusters(vectors: DataFrame, threshold: float = 0.95, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(idx, cluster_id): transitive clusters of correlated vectors, numbered by first appearance."""
    links = links_and_best(vectors, threshold, np.inf, key, vector).select("u", "v")
    return cluster_ids(vectors.select(F.col(key).alias("idx")), links)


def integrity_audit(vectors: DataFrame, contents: DataFrame, threshold: float = 0.95, key: str = "vec_id", vector: str = "embedding", thresholds: tuple[float, ...] = THRESHOLDS) -> DataFrame:
    """One row: duplicate groups and files of contents(key, content), clusters of vectors, rates of near duplicates."""
    found = written(links_and_best(vectors, threshold, min(thresholds), key, vector), "links")
    nodes = vectors.select(F.col(key).alias("idx"))
    clusters = cluster_ids(nodes, found.where("best is null").select("u", "v"))
    sizes = clusters.groupBy("cluster_id").agg(F.count("*").alias("size"))
    shape = sizes.agg(F.coalesce(F.sum("size"), F.lit(0)).alias("n_samples"), F.count("*").alias("n_clusters"), F.count_if(F.col("size") > 1).alias("multi_member_clusters"), F.coalesce(F.max("size"), F.lit(0)).alias("largest_cluster"))
    groups = exact_duplicate_groups(contents, "content", "key").agg(F.count("*").alias("exact_groups"), F.coalesce(F.sum("n"), F.lit(0)).alias("exact_files"))
    ends = found.where("best is not null").groupBy(F.col("u").alias("idx")).agg(F.max("best").alias("best"))
    near = ends.agg(*(F.count_if(F.col("best") > t).alias(f"near_{round(100 * t)}") for t in thresholds))
    one = lambda df: df.withColumn("one", F.lit(1))
    row = one(shape).join(one(groups), "one").join(one(near), "one").drop("one")
    shares = [ratio(F.col(f"near_{round(100 * t)}"), F.col("n_samples")).alias(f"near_rate_{round(100 * t)}") for t in thresholds]
    factor = F.when(F.col("n_clusters") > 0, F.col("n_samples") / F.col("n_clusters")).otherwise(1.0)
    return row.select("n_samples", "exact_groups", "exact_files", "n_clusters", "multi_member_clusters", "largest_cluster", *shares, factor.alias("reduction_factor"))


def best_above(left: DataFrame, right: DataFrame, least: float, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(idx, best): the left rows whose highest correlation with a right row other than itself is above least, and that
    correlation; only left blocks meet right ones, and only where they may hold such a pair."""
    side = lambda rows, is_left: standardised(rows, key, vector).withColumn("is_left", F.lit(is_left))
    z = written(side(left, True).unionByName(side(right, False)), "sides")

    blocks, lead, *_ = block_pairs(z, least, sides=True)

    def product(t: pa.Table) -> pa.Table:
        names = np.unique(t.column("idx").to_numpy())
        best = np.full(len(names), -np.inf)
        for u, v, c in block_near(t, least, lead):
            np.maximum.at(best, np.searchsorted(names, u[u != v]), c[u != v])
        known = best > least
        return pa.table({"idx": pa.array(names[known], pa.int64()), "best": pa.array(best[known])})

    found = blocks.groupBy("lo", "hi").applyInArrow(product, "idx long, best double")
    return found.groupBy("idx").agg(F.max("best").alias("best"))


def split_leakage(test: DataFrame, train: DataFrame, thresholds: tuple[float, ...] = THRESHOLDS, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(threshold, leakage): the share of test rows whose best correlation with a training row is above; 0 if a side is empty.

    Test rows that no training row other than themselves stands beside do not count.
    """
    best = best_above(test, train, min(thresholds), key, vector)
    above = best.agg(*(F.count_if(F.col("best") > t).alias(f"t{i}") for i, t in enumerate(thresholds)), F.lit(1).alias("one"))
    others = train.agg(F.count_distinct(key).alias("others"), F.min(key).alias("only"), F.lit(1).alias("one"))
    beside = test.select(F.col(key).alias("idx"), F.lit(1).alias("one")).join(others, "one").where((F.col("others") > 1) | (F.col("others") == 1) & (F.col("idx") != F.col("only")))
    n = beside.agg(F.count("*").alias("n"), F.lit(1).alias("one")).join(above, "one")
    return n.select(F.explode(F.array(*(F.struct(F.lit(t).alias("threshold"), ratio(F.col(f"t{i}"), F.col("n")).alias("leakage")) for i, t in enumerate(thresholds)))).alias("r")).select("r.*")
