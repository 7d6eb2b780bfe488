"""Exact set-similarity join on word shingles, as a blocked sparse product of documents and n-grams.

Two sets with Jaccard similarity t or more share a shingle among the first |x| - ceil(t |x|) + 1 of each, in any
order that all documents agree on. The order here puts shingles that few documents have first, so common passages
stand at the end. What the prefixes share is accumulated over ranges of shingles; a pair whose count stays below the
bound that both sizes imply goes. Surviving pairs and shared common shingles gather documents in clusters, and within
each cluster blocks of the document by n-gram matrix are multiplied with full sets. Only links that hold exactly on
the full sets are kept: as a forest for components, and where asked for as link counts or one by one.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from plumbline.llm.common import slices, use_workers, written
from plumbline.llm.components import connected, forest
from plumbline.llm.words import shingle_sets

#: A shingle that so many sets have counts as common; a list of at most so many common shingles is broadcast, and a longer
#: one is joined with the shingles of all sets.
COMMON, MOST_COMMON = 16, 1 << 21
#: Bits of a token, which names a shingle while candidates are sought: 10^13 shingles would still leave most apart.
TOKEN = 48
#: Shingles that one task holds before it passes their counts on; sets, and about their shingles, in one side of a block of
#: the product.
FLUSH, BLOCK, BLOCK_TOKENS = 1 << 21, 1024, 1 << 18
#: Bytes of input for each range of tokens, and ranges at most.
RANGE_BYTES, MOST_RANGES = 4 << 20, 1 << 20
#: Bits of the largest filter of documents that have a candidate.
MOST_FILTER_BITS = 1 << 27


def pack(*parts: tuple[np.ndarray, int]) -> bytes:
    """Arrays of whole numbers of so many bytes each, byte plane by byte plane, so that compression finds the zeros."""
    return b"".join(np.ascontiguousarray(x.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :w].T).tobytes() for x, w in parts)


def unpack(blob: bytes, *widths: int) -> list[np.ndarray]:
    n, at, out = len(blob) // sum(widths), 0, []
    for w in widths:
        wide = np.zeros((n, 8), np.uint8)
        wide[:, :w] = np.frombuffer(blob, np.uint8, w * n, at).reshape(w, n).T
        out.append(wide.view("<u8").ravel())
        at += w * n
    return out


#: Bytes of a token, a set's name and a set's size in a blob.
WIDTHS = (TOKEN // 8, 8, 4)


def tokens_of(own: np.ndarray) -> np.ndarray:
    """The tokens of sorted 64-bit shingles, in order."""
    return own >> np.uint64(64 - TOKEN)


def by_range(sorted_tokens: np.ndarray, ranges: int) -> np.ndarray:
    """Where each of so many equal ranges of tokens (a power of two) begins, and the end."""
    edges = np.arange(1, ranges, dtype=np.uint64) << np.uint64(TOKEN - (ranges.bit_length() - 1))
    return np.concatenate(([0], np.searchsorted(sorted_tokens, edges), [len(sorted_tokens)]))


def range_count(docs: DataFrame) -> int:
    """Ranges to deal tokens into, a power of two: as the input's size asks for, so that none outgrows a task."""
    size = int(str(docs._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    known = size if size < 1 << 60 else 0  # tables without files tell no size
    wanted = max(4 * int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), known // RANGE_BYTES, 1)
    return min(MOST_RANGES, 1 << (wanted - 1).bit_length())


def ranged(tokens: np.ndarray, ranges: int, *others: tuple[np.ndarray, int]) -> pa.RecordBatch:
    """(range, blob) of sorted tokens, as differences within their range, and of what goes with them."""
    cut = by_range(tokens, ranges)
    some = np.flatnonzero(cut[1:] > cut[:-1])
    blobs = [pack((np.diff(tokens[a:b], prepend=np.uint64(0)), WIDTHS[0]), *((x[a:b], w) for x, w in others)) for a, b in zip(cut[some].tolist(), cut[some + 1].tolist())]
    return pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array(blobs, pa.binary())], names=["range", "blob"])


def set_key(own: np.ndarray) -> int:
    """An even 64-bit name of a set; odd numbers name tokens.

    Equal sets are told by their names, and shingles by 64-bit hashes. The chance that any two of n different sets share a
    name is about n * n / 2**64: 0.05 for 10**9 sets.
    """
    return int.from_bytes(hashlib.blake2b(own.tobytes(), digest_size=8).digest(), "little", signed=True) & ~1


def need(n: np.ndarray, percent: int) -> np.ndarray:
    """The least overlap of a set of n with any set of this similarity."""
    return -(-n * percent // 100)


def shingle_counts(docs: DataFrame, text: str, k: int, ranges: int) -> DataFrame:
    """(token, df): tokens that COMMON documents or more have, and in how many they are."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        n = 0

        def out():
            tokens, counts = np.unique(np.concatenate(held), return_counts=True)
            return ranged(tokens, ranges, (counts, 4))

        for whole in batches:
            for b in slices(whole, text):
                for own in shingle_sets(b.column(text), k):
                    held.append(tokens_of(own))
                    n += len(own)
                if n >= FLUSH:
                    yield out()
                    held, n = [], 0
        if n:
            yield out()

    def add(table: pa.Table) -> pa.Table:
        parts = [unpack(x, WIDTHS[0], 4) for x in table.column("blob").to_pylist()]
        tokens = np.concatenate([np.cumsum(t, dtype=np.uint64) for t, _ in parts])
        counts = np.concatenate([c for _, c in parts])
        order = np.argsort(tokens, kind="stable")
        tokens, counts = tokens[order], counts[order]
        first = np.flatnonzero(np.concatenate(([True], tokens[1:] != tokens[:-1])))
        df = np.add.reduceat(counts.astype(np.int64), first)
        keep = df >= COMMON
        return pa.table({"token": tokens[first][keep].astype(np.int64), "df": df[keep]})

    return docs.select(text).mapInArrow(count, "range int, blob binary").groupBy("range").applyInArrow(add, "token long, df long")


def described(docs: DataFrame, key: str, text: str, k: int, percent: int, common, prefixes: bool) -> DataFrame:
    """Each row's key, set size n, set name sk, and if asked for the first row of a set in a task its prefix: rare and common tokens."""

    def describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, df = common.value
        seen: set[int] = set()
        for whole in batches:
            for b in slices(whole, text):
                sizes, names, rare, often = [], [], [], []
                for own in shingle_sets(b.column(text), k):
                    n = len(own)
                    sizes.append(n)
                    name = set_key(own) if n else None
                    names.append(name)
                    if not n or not prefixes or name in seen:
                        rare.append(None), often.append(None)
                        continue
                    if len(seen) < 1 << 20:
                        seen.add(name)
                    tokens, p = tokens_of(own), n - -(-n * percent // 100) + 1
                    if not len(known):
                        rare.append(pack((tokens[:p], WIDTHS[0]))), often.append(None)
                        continue
                    at = np.minimum(np.searchsorted(known, tokens), len(known) - 1)
                    is_common = known[at] == tokens
                    light = tokens[~is_common][:p]
                    rare.append(pack((light, WIDTHS[0])))
                    if len(light) < p:
                        heavy, count = tokens[is_common], df[at[is_common]]
                        often.append(pack((heavy[np.argsort(count, kind="stable")][: p - len(light)], WIDTHS[0])))
                    else:
                        often.append(None)
                yield pa.RecordBatch.from_arrays([b.column(key), pa.array(sizes, pa.int64()), pa.array(names, pa.int64()), pa.array(rare, pa.binary()), pa.array(often, pa.binary())], names=["key", "n", "sk", "rare", "often"])

    kind = dict(docs.dtypes)[key]
    return docs.select(key, text).mapInArrow(describe, f"key {kind}, n long, sk long, rare binary, often binary")


def postings(found: Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]], ranges: int) -> Iterator[pa.RecordBatch]:
    """(range, blob) of (tokens, names of their sets, the sets' sizes), some at a time."""
    held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    n = 0

    def out() -> pa.RecordBatch:
        tokens, names, sizes = (np.concatenate(x) for x in zip(*held))
        order = np.argsort(tokens, kind="stable")
        return ranged(tokens[order], ranges, (names[order].view(np.uint64), WIDTHS[1]), (sizes[order], WIDTHS[2]))

    for one in found:
        held.append(one)
        n += len(one[0])
        if n >= FLUSH // 2:
            yield out()
            held, n = [], 0
    if n:
        yield out()


def unpacked(table: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Tokens, names and sizes of a range's postings."""
    parts = [unpack(x, *WIDTHS) for x in table.column("blob").to_pylist()]
    tokens = np.concatenate([np.cumsum(x[0], dtype=np.uint64) for x in parts])
    names, sizes = (np.concatenate([x[i] for x in parts]) for i in (1, 2))
    return tokens, names.view(np.int64), sizes.astype(np.int64)


def joined_prefixes(docs: DataFrame, text: str, k: int, percent: int, counts: DataFrame, ranges: int) -> DataFrame:
    """(sk, n, token, df) of each set's prefix, df 0 for rare tokens, where the common ones are too many to be broadcast.

    Every token of every set meets its range of the counts, and each set's tokens are then ranked by count. A set may stand
    in several tasks; its tokens then come several times, which the dense rank does not mind.
    """

    def every(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def found():
            seen: set[int] = set()
            for whole in batches:
                for b in slices(whole, text):
                    for own in shingle_sets(b.column(text), k):
                        if not len(own) or (name := set_key(own)) in seen:
                            continue
                        if len(seen) < 1 << 20:
                            seen.add(name)
                        yield tokens_of(own), np.full(len(own), name, np.int64), np.full(len(own), len(own), np.int64)

        return postings(found(), ranges)

    def look_up(key: tuple, sets: pa.Table, known: pa.Table) -> pa.Table:
        if not sets.num_rows:
            return pa.table({c: pa.array([], pa.int64()) for c in ("sk", "n", "token", "df")})
        tokens, names, sizes = unpacked(sets)
        token, df = known.column("token").to_numpy().astype(np.uint64), known.column("df").to_numpy()
        count = np.zeros(len(tokens), np.int64)
        if len(token):
            order = np.argsort(token)
            at = np.minimum(np.searchsorted(token, tokens, sorter=order), len(token) - 1)
            hit = token[order[at]] == tokens
            count[hit] = df[order[at[hit]]]
        return pa.table({"sk": names, "n": sizes, "token": tokens.astype(np.int64), "df": count})

    shift = TOKEN - (ranges.bit_length() - 1)
    dealt = counts.select("token", "df", F.shiftright("token", shift).cast("int").alias("range"))
    met = docs.select(text).mapInArrow(every, "range int, blob binary").groupBy("range").cogroup(dealt.groupBy("range")).applyInArrow(look_up, "sk long, n long, token long, df long")
    place = F.dense_rank().over(Window.partitionBy("sk").orderBy("df", "token"))
    return met.withColumn("place", place).where(F.expr(f"place <= n - cast(-floor(-({percent}D * n) / 100) as long) + 1")).drop("place")


def candidate_pairs(parts: DataFrame, percent: int) -> DataFrame:
    """(u, v): pairs of sets whose shared rare prefix tokens, from (range, blob), reach the bound that their sizes imply.

    A rare token is in fewer than COMMON sets, so the pairs of one token are few.
    """

    def pair(table: pa.Table) -> pa.Table:
        tokens, names, sizes = unpacked(table)
        order = np.lexsort((names, sizes, tokens))
        tokens, names, sizes = tokens[order], names[order], sizes[order]
        new = np.concatenate(([True], (tokens[1:] != tokens[:-1]) | (names[1:] != names[:-1])))
        tokens, names, sizes = tokens[new], names[new], sizes[new]
        found = []
        i, d = np.arange(len(tokens)), 1
        while len(i):
            i = i[i + d < len(tokens)]
            i = i[(tokens[i] == tokens[i + d]) & (100 * sizes[i] >= percent * sizes[i + d])]
            if len(i):
                u, v = names[i], names[i + d]
                swap = u > v
                found.append(np.stack((np.where(swap, v, u), np.where(swap, u, v), np.where(swap, sizes[i + d], sizes[i]), np.where(swap, sizes[i], sizes[i + d]))))
            d += 1
        if not found:
            return pa.table({c: pa.array([], pa.int64()) for c in ("u", "v", "nu", "nv", "shared")})
        u, v, nu, nv = np.concatenate(found, axis=1)
        order = np.lexsort((v, u))
        u, v, nu, nv = u[order], v[order], nu[order], nv[order]
        first = np.flatnonzero(np.concatenate(([True], (u[1:] != u[:-1]) | (v[1:] != v[:-1]))))
        return pa.table({"u": u[first], "v": v[first], "nu": nu[first], "nv": nv[first], "shared": np.diff(np.append(first, len(u)))})

    total = parts.groupBy("range").applyInArrow(pair, "u long, v long, nu long, nv long, shared long").groupBy("u", "v", "nu", "nv").agg(F.sum("shared").alias("shared"))
    least = F.expr(f"cast(-floor(-({percent}D * (nu + nv)) / (100 + {percent})) as long)")
    beyond = F.greatest(*(F.expr(f"cast(-floor(-({percent}D * {n}) / 100) as long) - 1") for n in ("nu", "nv")))
    return total.where(F.col("shared") >= F.greatest(F.lit(1), least - beyond)).select("u", "v")


def filter_of(names: DataFrame, n: int) -> tuple[np.ndarray, int]:
    """A bit set of bounded size that holds all names (long column sk): packed bits, and their number."""
    bits = 1 << 16
    while bits < 16 * n and bits < MOST_FILTER_BITS:
        bits <<= 1
    part = 1 << 16

    def set_bits(table: pa.Table) -> pa.Table:
        own = np.zeros(part, bool)
        own[table.column("at").to_numpy()] = True
        return pa.table({"part": table.column("part").slice(0, 1), "bits": [np.packbits(own).tobytes()]}, schema=pa.schema([("part", pa.int64()), ("bits", pa.binary())]))

    at = F.pmod(F.shiftright("sk", 1), F.lit(bits))
    marks = names.select(F.floor(at / part).cast("long").alias("part"), F.pmod(at, F.lit(part)).cast("int").alias("at")).distinct()
    out = np.zeros(bits // 8, np.uint8)
    for r in marks.groupBy("part").applyInArrow(set_bits, "part long, bits binary").toLocalIterator():
        out[r["part"] * part // 8 : (r["part"] + 1) * part // 8] = np.frombuffer(r["bits"], np.uint8)
    return out, bits


def linked(a: list[np.ndarray], b: list[np.ndarray], percent: int) -> tuple[np.ndarray, np.ndarray]:
    """Which sets of a link with which of b: the overlap counts of a sparse product against the sizes' bound; and the counts."""
    na, nb = np.array([len(x) for x in a]), np.array([len(x) for x in b])
    both = np.concatenate([*a, *b])
    row = np.repeat(np.arange(len(a) + len(b)), np.concatenate((na, nb)))
    order = np.argsort(both, kind="stable")
    both, row = both[order], row[order]
    first = np.flatnonzero(np.concatenate(([True], both[1:] != both[:-1])))
    count = np.diff(np.append(first, len(both)))
    column = np.repeat(np.arange(len(first)), count)
    often = count >= 24
    overlap = np.zeros((len(a), len(b)), np.float32)
    many = np.flatnonzero(often)
    for t in range(0, len(many), 2048):
        tile = np.full(len(first), -1)
        tile[many[t : t + 2048]] = np.arange(len(many[t : t + 2048]))
        c = tile[column]
        m = np.zeros((len(a) + len(b), len(many[t : t + 2048])), np.float32)
        m[row[c >= 0], c[c >= 0]] = 1
        overlap += m[: len(a)] @ m[len(a) :].T
    rare = (~often & (count > 1))[column]
    r, c = row[rare], column[rare]
    for d in range(1, 24):
        i = np.flatnonzero(c[:-d] == c[d:]) if len(c) > d else np.zeros(0, int)
        if not len(i):
            break
        x, y = np.minimum(r[i], r[i + d]), np.maximum(r[i], r[i + d]) - len(a)
        ok = (x < len(a)) & (y >= 0)
        overlap += np.bincount(x[ok] * len(b) + y[ok], minlength=len(a) * len(b)).reshape(len(a), len(b))
    shared = overlap.astype(np.int64)
    return 100 * shared >= percent * (na[:, None] + nb[None, :] - shared), shared


#: What block_links gives: edges of a forest; the same with rows (u, null, n) of link counts; or the links themselves.
FOREST, COUNTED, PAIRS = "u long, v long", "u long, v long, n long", "u long, v long, nu long, nv long, shared long"
#: Links that go out of a task at once.
MOST_PAIRS = 1 << 18


def block_links(percent: int, what: str = FOREST):
    """From rows sorted by block: the exact links between the block's two chunks as a forest, with counts, or one by one."""
    names = [c.split()[0] for c in what.split(", ")]

    def links(chunks: tuple[int, int], rows: dict[tuple[int | None, int], tuple[bytes, int]]) -> list[np.ndarray | None] | None:
        lo = [(s, np.frombuffer(x, np.uint64), w) for (c, s), (x, w) in rows.items() if c == chunks[0]]
        hi = lo if chunks[0] == chunks[1] else [(s, np.frombuffer(x, np.uint64), w) for (c, s), (x, w) in rows.items() if c == chunks[1]]
        if not lo or not hi or (lo is hi and len(lo) < 2):
            return None
        found, shared = linked([x for _, x, _ in lo], [x for _, x, _ in hi], percent)
        i, j = np.nonzero(found)
        lows, highs = np.array([s for s, _, _ in lo]), np.array([s for s, _, _ in hi])
        other = lows[i] != highs[j]
        i, j = i[other], j[other]
        u, v = lows[i], highs[j]
        if what == PAIRS:
            once = u < v if lo is hi else np.ones(len(u), bool)
            i, j, u, v = i[once], j[once], u[once], v[once]
            swap = u > v
            nu, nv = np.array([len(x) for _, x, _ in lo])[i], np.array([len(x) for _, x, _ in hi])[j]
            return [np.where(swap, v, u), np.where(swap, u, v), np.where(swap, nv, nu), np.where(swap, nu, nv), shared[i, j]]
        forests = [*forest(u, v)]
        if what == FOREST:
            return forests
        low_copies, high_copies = np.array([w for _, _, w in lo], np.int64), np.array([w for _, _, w in hi], np.int64)
        own = np.zeros(len(lo), np.int64)
        np.add.at(own, i, high_copies[j])
        names_of, counts = [lows], [own]
        if lo is not hi:
            theirs = np.zeros(len(hi), np.int64)
            np.add.at(theirs, j, low_copies[i])
            names_of.append(highs), counts.append(theirs)
        counted = np.concatenate(counts)
        some = counted > 0
        return [*forests, np.concatenate(names_of)[some], counted[some]]

    def batches_of(got: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        for at in range(0, len(got[0]), MOST_PAIRS):
            part = [pa.array(x[at : at + MOST_PAIRS], pa.int64()) for x in got[: 2 if what == COUNTED else len(names)]]
            if what == COUNTED:
                part.append(pa.nulls(len(part[0]), pa.int64()))
            yield pa.RecordBatch.from_arrays(part, names=names)
        if what == COUNTED and len(got[2]):
            yield pa.RecordBatch.from_arrays([pa.array(got[2], pa.int64()), pa.nulls(len(got[2]), pa.int64()), pa.array(got[3], pa.int64())], names=names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, rows = None, {}
        held: list[list[np.ndarray]] = []
        for b in batches:
            cols = [b.column(c).to_pylist() for c in ("cluster", "lo", "hi", "chunk", "sk", "tokens", "copies")]
            for cluster, lo, hi, chunk, sk, tokens, copies in zip(*cols):
                if (cluster, lo, hi) != at:
                    if at and (got := links(at[1:], rows)) is not None:
                        held.append(got)
                        if sum(len(x[0]) for x in held) >= MOST_PAIRS:
                            yield from batches_of([np.concatenate(x) for x in zip(*held)])
                            held = []
                    at, rows = (cluster, lo, hi), {}
                rows[chunk, sk] = (tokens, copies)
            if held:
                yield from batches_of([np.concatenate(x) for x in zip(*held)])
                held = []
        if at and (got := links(at[1:], rows)) is not None:
            yield from batches_of(got)

    return run


def full_sets(docs: DataFrame, text: str, k: int, wanted) -> DataFrame:
    """(sk, n, tokens) of the sets that the filter lets through, once a task."""

    def pick(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits, size = wanted.value
        seen: set[int] = set()
        for whole in batches:
            for b in slices(whole, text):
                names, sizes, sets = [], [], []
                for own in shingle_sets(b.column(text), k):
                    if not len(own):
                        continue
                    name = set_key(own)
                    at = (name >> 1) % size
                    if bits[at >> 3] >> (7 - (at & 7)) & 1 and name not in seen:
                        if len(seen) < 1 << 20:
                            seen.add(name)
                        names.append(name), sizes.append(len(own)), sets.append(own.tobytes())
                yield pa.RecordBatch.from_arrays([pa.array(names, pa.int64()), pa.array(sizes, pa.int64()), pa.array(sets, pa.binary())], names=["sk", "n", "tokens"])

    return docs.select(text).mapInArrow(pick, "sk long, n long, tokens binary")


def bands(clusters: DataFrame, rows: DataFrame, percent: int, weighted: bool) -> DataFrame:
    """(sk, cluster, copies, band, chunks, above, below) of clusters of two sets or more.

    A cluster that is too large for one block is dealt into bands of size: sets whose bands are no neighbours differ too
    much in size to link. chunks is the number of parts of the set's band, above and below those of the bands beside it;
    they are as many as BLOCK and BLOCK_TOKENS ask for.
    """
    sets = rows.where("sk is not null").groupBy("sk").agg(F.first("n").alias("n"), F.count("*").alias("copies"))
    # the tables here are written, so that their joins have plain rows on both sides and adaptive execution may split a
    # cluster of many sets
    known = written(clusters.join(sets, "sk").select("sk", "cluster", "n", F.col("copies") if weighted else F.lit(1).cast("long").alias("copies")), "members")
    parts = F.greatest(F.ceil(F.count("*") / BLOCK), F.ceil(F.sum("n") / BLOCK_TOKENS)).cast("long")
    sizes = written(known.groupBy("cluster").agg(F.count("*").alias("members"), parts.alias("parts")).where("members > 1"), "clusters")
    width = max(math.log(100 / percent), 0.01) * (1 + 1e-9)
    band = F.when(F.col("parts") > 1, F.floor(F.log("n") / width)).otherwise(0).cast("long")
    placed = known.join(sizes, "cluster").select("sk", "cluster", "n", "copies", band.alias("band"))
    counts = placed.groupBy("cluster", "band").agg(parts.alias("chunks"))
    order = Window.partitionBy("cluster").orderBy("band")
    beside = lambda f, by: F.when(f("band").over(order) == F.col("band") + by, f("chunks").over(order)).otherwise(0)
    around = written(counts.select("cluster", "band", "chunks", beside(F.lead, 1).alias("above"), beside(F.lag, -1).alias("below")), "bands")
    return placed.drop("n").join(around, ["cluster", "band"])


def compared(base: DataFrame, k: int, percent: int, weighted: bool) -> tuple[DataFrame, DataFrame]:
    """From (key, text): each row's key, set size n and set name sk; and blocks of full sets for block_links.

    A block's copies is the number of rows of the set if weighted, else 1.
    """
    spark = base.sparkSession
    ranges = range_count(base)
    counts = written(shingle_counts(base, "text", k, ranges), "common")
    few = counts.count() <= MOST_COMMON
    if few:
        got = counts.toArrow()
        token, df = got.column("token").to_numpy().astype(np.uint64), got.column("df").to_numpy()
        order = np.argsort(token)
        known = token[order], np.minimum(df[order], 2**31 - 1).astype(np.int32)
    else:
        known = np.zeros(0, np.uint64), np.zeros(0, np.int32)
    rows = written(described(base, "key", "text", k, percent, spark.sparkContext.broadcast(known), few), "sets")

    def rare_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def found():
            for b in batches:
                for name, n, blob in zip(b.column("sk").to_pylist(), b.column("n").to_pylist(), b.column("rare").to_pylist()):
                    if blob:
                        tokens = unpack(blob, WIDTHS[0])[0]
                        yield tokens, np.full(len(tokens), name, np.int64), np.full(len(tokens), n, np.int64)

        return postings(found(), ranges)

    def often_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            u, v = [], []
            for name, blob in zip(b.column("sk").to_pylist(), b.column("often").to_pylist()):
                if blob:
                    t = unpack(blob, WIDTHS[0])[0].astype(np.int64) * 2 + 1
                    v.append(t), u.append(np.full(len(t), name, np.int64))
            if u:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(u)), pa.array(np.concatenate(v))], names=["u", "v"])

    def rare_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return postings(((b.column("token").to_numpy().astype(np.uint64), b.column("sk").to_numpy(), b.column("n").to_numpy()) for b in batches if b.num_rows), ranges)

    if few:
        rare = rows.select("sk", "n", "rare").where("rare is not null").mapInArrow(rare_of, "range int, blob binary")
        heavy = rows.select("sk", "often").where("often is not null").mapInArrow(often_of, "u long, v long")
    else:
        prefixes = written(joined_prefixes(base, "text", k, percent, counts, ranges), "prefixes")
        rare = prefixes.where("df = 0").select("sk", "n", "token").mapInArrow(rare_rows, "range int, blob binary")
        heavy = prefixes.where("df > 0").select(F.col("sk").alias("u"), (F.col("token") * 2 + 1).alias("v"))
    light = candidate_pairs(rare, percent)
    clusters = connected(light.unionByName(heavy)).where(F.pmod("node", F.lit(2)) == 0).select(F.col("node").alias("sk"), F.col("root").alias("cluster"))
    placed = written(bands(clusters, rows, percent, weighted), "clusters")
    wanted = spark.sparkContext.broadcast(filter_of(placed, placed.count()))
    name = lambda band, c: F.shiftleft(band, 32) + c
    each = lambda n, band: F.transform(F.filter(F.sequence(F.lit(0).cast("long"), F.greatest(F.col(n), F.lit(1)) - 1), lambda c: c < F.col(n)), lambda c: name(band, c))
    own = F.pmod(F.xxhash64("sk"), F.col("chunks"))
    others = F.concat(each("chunks", F.col("band")), each("above", F.col("band") + 1), each("below", F.col("band") - 1))
    dealt = full_sets(base, "text", k, wanted).join(placed, "sk").withColumn("chunk", name(F.col("band"), own)).withColumn("other", F.explode(others))
    blocks = dealt.select("cluster", F.least("chunk", "other").alias("lo"), F.greatest("chunk", "other").alias("hi"), "chunk", "sk", "tokens", "copies")
    return rows, blocks.repartition("cluster", "lo", "hi").sortWithinPartitions("cluster", "lo", "hi")


def similar_groups(docs: DataFrame, key: str = "doc_id", text: str = "text", k: int = 4, percent: int = 85, links: bool = False) -> DataFrame:
    """(key, n_shingles, component_id) of every row: the size of its shingle set, and the smallest key reachable by links.

    Words are runs of characters other than space and \\t to \\r, with A-Z in lower case. A text with fewer than k words
    is one shingle; a null text or one without words has the empty set and links with nothing. Two rows link when
    100 * overlap >= percent * union, so rows of equal sets link. Repeated rows each give a row. Where keys repeat, the
    smallest key of the component counts; null keys are never the smallest unless all are null. The key may be of
    any type that has an order; other columns are ignored. An empty table gives none. With links set there is also
    n_links: how many other rows the row links with.
    """
    use_workers(docs.sparkSession)
    base = docs.select(F.col(key).alias("key"), F.col(text).cast("string").alias("text"))
    rows, blocks = compared(base, k, percent, links)
    smallest = rows.where("sk is not null").groupBy("sk").agg(F.min("key").alias("low"), *([F.count("*").alias("copies")] if links else []))
    if links:
        found = written(blocks.mapInArrow(block_links(percent, COUNTED), COUNTED), "links")
        edges = found.where("v is not null").select("u", "v")
    else:
        edges = blocks.mapInArrow(block_links(percent), FOREST)
    groups = connected(edges)
    lows = smallest.select("sk", "low").join(groups.withColumnRenamed("node", "sk"), "sk")
    lowest = lows.groupBy("root").agg(F.min("low").alias("lowest"))
    answer = lows.join(lowest, "root").select("sk", "lowest")
    answer = smallest.join(answer, "sk", "left").withColumn("lowest", F.coalesce("lowest", "low"))
    if links:
        counts = found.where("n is not null").groupBy(F.col("u").alias("sk")).agg(F.sum("n").alias("n_links"))
        answer = answer.join(counts, "sk", "left").withColumn("n_links", F.coalesce("n_links", F.lit(0)) + F.col("copies") - 1)
    more = ["n_links"] if links else []
    # written, so that the last join reads plain rows on both sides and adaptive execution may split a set with many copies
    answer = written(answer.select("sk", "lowest", *more), "answer")
    return rows.select("key", "n", "sk").join(answer, "sk", "left").select(F.col("key").alias(key), F.col("n").alias("n_shingles"), F.coalesce("lowest", "key").alias("component_id"), *(F.coalesce(c, F.lit(0)).alias(c) for c in more))


def similar_pairs(docs: DataFrame, key: str = "doc_id", text: str = "text", k: int = 4, percent: int = 85) -> tuple[DataFrame, DataFrame]:
    """The links themselves: (u, v, nu, nv, shared, similarity) between distinct sets u < v, and the members (key, sk).

    u and v are names of sets, as sk is; nu and nv their sizes. Every row is a member, with a null sk if its set is empty;
    rows of one set link with each other and stand in no pair. Words, shingles and links are those of similar_groups.
    """
    use_workers(docs.sparkSession)
    base = docs.select(F.col(key).alias("key"), F.col(text).cast("string").alias("text"))
    rows, blocks = compared(base, k, percent, False)
    pairs = blocks.mapInArrow(block_links(percent, PAIRS), PAIRS)
    return pairs.withColumn("similarity", F.col("shared") / (F.col("nu") + F.col("nv") - F.col("shared"))), rows.select(F.col("key").alias(key), "sk")
