"""Near duplicates by MinHash with tensored banding, verified on full sets.

Two collections of BANDS small hashes each (ROWS minhashes in one) stand for a set. A table is kept for every pair of one
hash of either collection, so BANDS * BANDS tables of 2 * ROWS minhashes cost only 2 * BANDS * ROWS minhashes. Sets that
meet in a table gather in clusters; a pair of similarity s fails to meet with a chance of about 2 * (1 - s^ROWS)^BANDS
(4 in 10^8 at 0.85). Within clusters, links are confirmed on full sets of shingles: first against a few pivots, which
joins most of a large group in one pass over it, and then between the parts that are not joined yet.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.llm import jaccard
from plumbline.llm.common import slices, use_workers, written
from plumbline.llm.components import connected, forest
from plumbline.llm.words import mix, shingle_sets, stream

#: Minhashes in one small hash, and small hashes in each of the two collections.
ROWS, BANDS = 4, 24
#: Shingles whose minhashes are worked out at once.
SHINGLES = 1 << 18
#: One of so many hashes of either collection makes up the tables that are looked at first.
FEW_TABLES = 3
#: Links that a task holds at once.
LINKS = 1 << 20
#: Sets of a large cluster that all its others are compared with first, for each of its bands of size.
PIVOTS = 8
_factor = (stream(2 * BANDS * ROWS, 31) >> np.uint64(32)).astype(np.uint32) | np.uint32(1)
_shift = (stream(2 * BANDS * ROWS, 32) >> np.uint64(32)).astype(np.uint32)
_place = stream(2 * BANDS * ROWS, 33) | np.uint64(1)


def small_hashes(sets: list[np.ndarray]) -> np.ndarray:
    """A row of 2 * BANDS small hashes, of jaccard.TOKEN bits, for each non-empty set of 64-bit shingles: even ones of the
    first collection, odd ones of the second."""
    starts = np.concatenate(([0], np.cumsum([len(s) for s in sets[:-1]]))).astype(np.int64)
    flat = np.concatenate(sets)
    flat = (flat ^ (flat >> np.uint64(32))).astype(np.uint32)  # truncates to the low half
    least = np.empty((len(sets), 2 * BANDS * ROWS), np.uint64)
    for j in range(2 * BANDS * ROWS):
        least[:, j] = np.minimum.reduceat((flat ^ _shift[j]) * _factor[j], starts)
    own = jaccard.tokens_of(mix((least * _place).reshape(len(sets), 2 * BANDS, ROWS).sum(axis=2, dtype=np.uint64)))
    side = np.repeat(np.array([0, 1], np.uint64), BANDS)
    return (own & ~np.uint64(1)) | side


def groups(sets: list[np.ndarray]) -> Iterator[list[np.ndarray]]:
    """The sets in lists of about SHINGLES shingles."""
    held, n = [], 0
    for s in sets:
        held.append(s)
        n += len(s)
        if n >= SHINGLES:
            yield held
            held, n = [], 0
    if held:
        yield held


def sketched(base: DataFrame, k: int) -> DataFrame:
    """From (key, text): key, set size n, set name sk, and for the first row of a set in a task its small hashes."""

    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for whole in batches:
            for b in slices(whole, "text"):
                sizes, names, new, at = [], [], [], []
                for i, own in enumerate(shingle_sets(b.column("text"), k)):
                    sizes.append(len(own))
                    names.append(name := jaccard.set_key(own) if len(own) else None)
                    if name is not None and name not in seen:
                        if len(seen) < 1 << 20:
                            seen.add(name)
                        new.append(own)
                        at.append(i)
                found: list[list[int] | None] = [None] * b.num_rows
                i = 0
                for part in groups(new):
                    for row in small_hashes(part).view(np.int64).tolist():
                        found[at[i]] = row
                        i += 1
                columns = [b.column("key"), pa.array(sizes, pa.int64()), pa.array(names, pa.int64()), pa.array(found, pa.list_(pa.int64()))]
                yield pa.RecordBatch.from_arrays(columns, names=["key", "n", "sk", "small"])

    return base.mapInArrow(sketch, f"key {dict(base.dtypes)['key']}, n long, sk long, small array<long>")


def posted_hashes(ranges: int):
    """From (sk, small): postings (range, blob) of distinct small hashes, with a set that has each and a mark if several sets
    of the task do; and rows (sk, hash) where they do. So no range gets more postings of a hash than there are tasks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, hashes, n = [], [], 0

        def out() -> Iterator[pa.RecordBatch]:
            sk = np.concatenate(names).repeat(2 * BANDS)
            own = np.concatenate(hashes).view(np.uint64)
            order = np.argsort(own, kind="stable")
            own, sk = own[order], sk[order]
            first = np.flatnonzero(np.concatenate(([True], own[1:] != own[:-1])))
            count = np.diff(np.append(first, len(own)))
            for b in jaccard.postings([(own[first], sk[first], (count > 1).astype(np.int64))], ranges):
                yield pa.RecordBatch.from_arrays([*b.columns, pa.nulls(len(b), pa.int64()), pa.nulls(len(b), pa.int64())], names=["range", "blob", "sk", "hash"])
            many = np.repeat(count > 1, count)
            n = int(many.sum())
            yield pa.RecordBatch.from_arrays([pa.nulls(n, pa.int32()), pa.nulls(n, pa.binary()), pa.array(sk[many]), pa.array(own[many].view(np.int64))], names=["range", "blob", "sk", "hash"])

        for b in batches:
            if b.num_rows:
                names.append(b.column("sk").to_numpy())
                hashes.append(np.asarray(b.column("small").flatten()))
                n += len(hashes[-1])
            if n >= LINKS:
                yield from out()
                names, hashes, n = [], [], 0
        if n:
            yield from out()

    return run


def met_hashes(table: pa.Table) -> pa.Table:
    """(sk, hash) of the postings of a range whose hash another posting's set has too, without those that know it."""
    own, sk, marked = jaccard.unpacked(table)
    order = np.argsort(own, kind="stable")
    own, sk, marked = own[order], sk[order], marked[order]
    first = np.flatnonzero(np.concatenate(([True], own[1:] != own[:-1])))
    count = np.diff(np.append(first, len(own)))
    several = (np.minimum.reduceat(sk, first) != np.maximum.reduceat(sk, first)) | (np.maximum.reduceat(marked, first) > 0)
    told = np.repeat(several, count) & (marked == 0)
    return pa.table({"sk": sk[told], "hash": own[told].view(np.int64)})


def stars(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links of the same components from sets (even) u to tables' keys (odd) v: of each component its smallest set with
    every other set and every key."""
    nodes = np.unique(np.concatenate((u, v)))
    other, low = forest(u, v)
    root = nodes.copy()
    root[np.searchsorted(nodes, other)] = low
    sets = np.flatnonzero(nodes % 2 == 0)
    roots, first = np.unique(root[sets], return_index=True)  # nodes are sorted, so the first is the smallest
    head = nodes[sets[first]][np.searchsorted(roots, root)]
    some = head != nodes
    return head[some], nodes[some]


def posted_keys(ranges: int, some: int):
    """From (sk, small): links (u, v) of sets that share a table's key within the task, and postings (range, blob) of keys
    with the smallest set of theirs. Of every some hashes of either collection one is taken, by its value."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        u, v, n = [], [], 0

        def out() -> Iterator[pa.RecordBatch]:
            head, node = stars(np.concatenate(u), np.concatenate(v))
            key = node % 2 != 0
            links = int((~key).sum())
            yield pa.RecordBatch.from_arrays([pa.nulls(links, pa.int32()), pa.nulls(links, pa.binary()), pa.array(head[~key]), pa.array(node[~key])], names=["range", "blob", "u", "v"])
            order = np.argsort(node[key], kind="stable")
            keys = node[key][order].view(np.uint64)
            for b in jaccard.postings([(keys, head[key][order], np.zeros(len(keys), np.int64))], ranges):
                yield pa.RecordBatch.from_arrays([*b.columns, pa.nulls(len(b), pa.int64()), pa.nulls(len(b), pa.int64())], names=["range", "blob", "u", "v"])

        for b in batches:
            for name, small in zip(b.column("sk").to_pylist(), b.column("small").to_pylist()):
                own = np.array(small, np.uint64)
                own = own[(own >> np.uint64(1)) % np.uint64(some) == 0]
                odd = (own & np.uint64(1)).astype(bool)
                keys = jaccard.tokens_of(mix(own[~odd][:, None] * np.uint64(3) + mix(own[odd])[None, :]).ravel()) | np.uint64(1)
                v.append(keys.view(np.int64))
                u.append(np.full(len(keys), name, np.int64))
                n += len(keys)
                if n >= LINKS:
                    yield from out()
                    u, v, n = [], [], 0
        if n:
            yield from out()

    return run


def met_keys(table: pa.Table) -> pa.Table:
    """Links (u, v) of the sets that stand for a key in different tasks."""
    own, sk, _ = jaccard.unpacked(table)
    order = np.lexsort((sk, own))
    own, sk = own[order], sk[order]
    first = np.concatenate(([True], own[1:] != own[:-1]))
    head = sk[np.flatnonzero(first)][np.cumsum(first) - 1]
    return pa.table({"u": head[head != sk], "v": sk[head != sk]})


def candidate_clusters(rows: DataFrame, ranges: int) -> DataFrame:
    """(sk, cluster): sets that meet in a table, directly or by way of others.

    Only small hashes that two sets or more share can be part of a key that they share, so the tables' keys are formed from
    those alone. Hashes and keys go to ranges packed, a few bytes each and once a task.
    """
    posted = written(rows.where("small is not null").select("sk", "small").mapInArrow(posted_hashes(ranges), "range int, blob binary, sk long, hash long"), "hashes")
    told = posted.where("blob is not null").groupBy("range").applyInArrow(met_hashes, "sk long, hash long")
    shared = posted.where("blob is null").select("sk", "hash").unionByName(told)
    left = written(shared.groupBy("sk").agg(F.collect_set("hash").alias("small")), "shared")  # at most 2 * BANDS a set

    def links(of: DataFrame, some: int) -> DataFrame:
        keys = written(of.mapInArrow(posted_keys(ranges, some), "range int, blob binary, u long, v long"), "keys")
        met = keys.where("blob is not null").groupBy("range").applyInArrow(met_keys, "u long, v long")
        return keys.where("blob is null").select("u", "v").unionByName(met)

    # a few tables join most of a large group; its sets then post their keys under one name
    first = connected(links(left, FEW_TABLES))
    named = left.join(first.hint("merge"), F.col("sk") == F.col("node"), "left").select(F.coalesce("root", "sk").alias("sk"), "small")
    found = connected(links(named, 1).unionByName(first.select(F.col("node").alias("u"), F.col("root").alias("v"))))
    return found.select(F.col("node").alias("sk"), F.col("root").alias("cluster"))


def dealt(members: DataFrame, by: list[str]) -> DataFrame:
    """members with chunk: the columns in by and a number, so that a chunk has about BLOCK sets and BLOCK_TOKENS shingles."""
    parts = F.greatest(F.ceil(F.count("*") / jaccard.BLOCK), F.ceil(F.sum("n") / jaccard.BLOCK_TOKENS)).cast("long")
    counts = written(members.groupBy(*by).agg(parts.alias("parts")), "parts")
    chunk = F.xxhash64(*by, F.pmod(F.xxhash64("sk"), F.col("parts")))
    return written(members.join(counts, by).withColumn("chunk", chunk).drop("parts"), "dealt")


def links_of(blocks: DataFrame, percent: int) -> DataFrame:
    """The exact links (u, v) as forests within the blocks (cluster, lo, hi) of sets (sk, chunk, tokens)."""
    rows = blocks.select("cluster", "lo", "hi", "chunk", "sk", "tokens", F.lit(1).cast("long").alias("copies"))
    return rows.repartition("cluster", "lo", "hi").sortWithinPartitions("cluster", "lo", "hi").mapInArrow(jaccard.block_links(percent), jaccard.FOREST)


def verified(base: DataFrame, rows: DataFrame, clusters: DataFrame, k: int, percent: int) -> DataFrame:
    """The links (u, v) that hold on full sets between sets of one cluster, as forests with the same components.

    A cluster that fits in a block is one. Full sets move twice: to their cluster, and to the blocks they are compared in.
    """
    spark = base.sparkSession
    sizes = rows.where("sk is not null").groupBy("sk").agg(F.first("n").alias("n"))
    known = written(clusters.join(sizes, "sk"), "members")
    parts = F.greatest(F.ceil(F.count("*") / jaccard.BLOCK), F.ceil(F.sum("n") / jaccard.BLOCK_TOKENS))
    several = written(known.groupBy("cluster").agg(F.count("*").alias("members"), parts.alias("parts")).where("members > 1"), "clusters")
    # sets whose bands are no neighbours differ too much in size to link
    width = max(math.log(100 / percent), 0.01) * (1 + 1e-9)
    none = F.lit(None).cast("long")
    members = written(known.join(several, "cluster").select("sk", "cluster", "n", F.floor(F.log("n") / width).cast("long").alias("band"), (F.col("parts") > 1).alias("large")), "members")
    large = dealt(members.where("large"), ["cluster", "band"])
    placed = members.where("not large").select("sk", "cluster", "n", none.alias("band"), none.alias("chunk")).unionByName(large.select("sk", "cluster", "n", "band", "chunk"))
    wanted = spark.sparkContext.broadcast(jaccard.filter_of(members, members.count()))  # at most 16 MB
    sets = written(jaccard.full_sets(base, "text", k, wanted).drop("n").join(placed.hint("merge"), "sk"), "sets")

    # large clusters: every chunk of a band and of those beside it meets the band's pivots
    pick = large.groupBy("cluster", F.col("band").alias("near"), F.pmod(F.hash("sk"), F.lit(PIVOTS)).alias("nth")).agg(F.min_by("sk", F.xxhash64("sk")).alias("sk"))
    chunks = written(large.select("cluster", "band", "chunk").distinct(), "chunks")
    beside = chunks.select("cluster", F.col("chunk").alias("hi"), F.explode(F.array(F.col("band") - 1, F.col("band"), F.col("band") + 1)).alias("near"))
    pivots = written(sets.where("chunk is not null").join(pick.select("cluster", "near", "sk"), ["cluster", "sk"]).select("cluster", "near", "sk", "tokens"), "pivots")
    met = beside.join(pivots, ["cluster", "near"]).select("cluster", none.alias("lo"), "hi", none.alias("chunk"), "sk", "tokens")
    own = sets.where("chunk is not null").select("cluster", none.alias("lo"), F.col("chunk").alias("hi"), "chunk", "sk", "tokens")
    star = written(links_of(own.unionByName(met), percent), "star")

    # then chunks of parts that are joined already skip each other
    joined = large.drop("chunk").join(connected(star).withColumnRenamed("node", "sk"), "sk", "left")
    many = joined.where("root is not null").groupBy("root").agg(F.count("*").alias("of")).where(F.col("of") >= jaccard.BLOCK // 4)
    parted = joined.join(many.select("root", F.lit(True).alias("whole")), "root", "left").withColumn("root", F.when(F.col("whole"), F.col("root")))
    again = dealt(parted.select("sk", "cluster", "n", "band", F.coalesce("root", F.lit(1)).alias("root")), ["cluster", "band", "root"])  # roots are even
    each = again.select("cluster", "band", "root", "chunk").distinct()
    other = each.select("cluster", F.col("band").alias("band2"), F.col("root").alias("root2"), F.col("chunk").alias("chunk2"))
    apart = (F.abs(F.col("band") - F.col("band2")) <= 1) & (F.col("chunk") <= F.col("chunk2")) & ((F.col("root") != F.col("root2")) | (F.col("root") == 1))
    pairs = each.join(other, "cluster").where(apart).select("cluster", F.col("chunk").alias("lo"), F.col("chunk2").alias("hi"))
    ends = pairs.select("cluster", "lo", "hi", F.explode(F.array_distinct(F.array("lo", "hi"))).alias("chunk"))
    meets = written(again.select("sk", "cluster", "chunk").join(ends, ["cluster", "chunk"]).select("sk", "lo", "hi", "chunk"), "meets")
    blocks = sets.where("chunk is not null").drop("chunk").join(meets, "sk").select("cluster", "lo", "hi", "chunk", "sk", "tokens")
    zero = F.lit(0).cast("long")
    alone = sets.where("chunk is null").select("cluster", zero.alias("lo"), zero.alias("hi"), zero.alias("chunk"), "sk", "tokens")
    return star.unionByName(links_of(blocks.unionByName(alone), percent))


def near_groups(docs: DataFrame, key: str = "doc_id", text: str = "text", k: int = 3, percent: int = 85) -> DataFrame:
    """(key, n_shingles, component_id, kept) of every row: set size, smallest key reachable by links, whether that is its own.

    Words are runs of characters other than space and \\t to \\r, with A-Z in lower case. A text with fewer than k words
    is one shingle; a null text or one without words has the empty set, links with nothing and is kept. Two rows link when
    100 * overlap >= percent * union on their full sets, so rows of equal sets link. Repeated rows each give a row, and
    where a key repeats all rows of the smallest one are kept. Null keys are never the smallest unless all are null. The
    key may be of any type that has an order; other columns are ignored. An empty table gives none.
    """
    use_workers(docs.sparkSession)
    base = docs.select(F.col(key).alias("key"), F.col(text).cast("string").alias("text"))
    rows = written(sketched(base, k), "sketches")
    clusters = written(candidate_clusters(rows, jaccard.range_count(base)), "candidates")
    groups = connected(verified(base, rows, clusters, k, percent)).withColumnRenamed("node", "sk")
    smallest = rows.where("sk is not null").groupBy("sk").agg(F.min("key").alias("low"))
    lows = written(smallest.join(groups, "sk", "left"), "lows")
    lowest = written(lows.where("root is not null").groupBy("root").agg(F.min("low").alias("lowest")), "lowest")
    answer = lows.join(lowest, "root", "left").select("sk", F.coalesce("lowest", "low").alias("lowest"))
    # written like lowest, so that joins read plain rows on both sides and adaptive execution may split large groups
    answer = written(answer, "answer")
    found = rows.select("key", "n", "sk").join(answer, "sk", "left").withColumn("lowest", F.coalesce("lowest", "key"))
    return found.select(F.col("key").alias(key), F.col("n").alias("n_shingles"), F.col("lowest").alias("component_id"), F.col("key").eqNullSafe(F.col("lowest")).alias("kept"))
