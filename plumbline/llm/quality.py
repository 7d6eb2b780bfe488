"""Quality classifier without labels: heuristic labellers, their accuracies by expectation-maximisation, a hashed scorer.

Each labeller votes good, bad or nothing on a document. How often each of the 3**labellers vote patterns occurs is
counted over all documents; expectation-maximisation fits each labeller's votes given the unknown class and so yields
every pattern's posterior. Posterior labels of a bounded sample train a linear scorer over hashed words, word shapes and
binned statistics, which then scores every document.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import BooleanType, DoubleType, StructField, StructType

from plumbline.llm.common import laid_out, offsets, slices, use_workers, written
from plumbline.llm.words import FOLDED, SPACE, mix, pieces, places, stream, word_spans, word_sums

#: Distinct texts that the scorer is trained on at most, their bytes, its weights, and passes over the sample.
SAMPLE, SAMPLE_BYTES, WEIGHTS, EPOCHS = 6000, 32 << 20, 1 << 16, 4
#: Documents whose score is at least this are kept.
LEAST_SCORE = 0.5
U = np.uint64

#: Byte classes of word shapes: x lower-case letters and all beyond ASCII, X capitals, 9 digits, others themselves.
CLASS = np.arange(256, dtype=np.uint8)
CLASS[97:123] = 120
CLASS[128:] = 120
CLASS[65:91] = 88
CLASS[48:58] = 57
LETTER, UPPER = np.isin(CLASS, (120, 88)), CLASS == 88
SYMBOL = ~LETTER & ~SPACE & (CLASS != 57) & ~np.isin(np.arange(256), [ord(c) for c in ".,;:'\"-()?!"])
STOP = np.isin(np.arange(256), [ord(c) for c in ".?!"])
#: Statistics of a document, in the order of their columns.
STATISTICS = ("words", "letters", "upper", "symbols", "again", "variety", "bangs", "bars", "ends", "word_bytes")


def described(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Statistics of each row [rows, STATISTICS], hashed words and word shapes (places of their weights), words per row.

    A long text is taken piece by piece; what crosses pieces (repeats, distinct words) is carried over.
    """
    rows = len(column)
    sums, per_row = np.zeros((rows, 8)), np.zeros(rows, np.int64)
    words, shapes = [np.zeros(0, np.uint16)], [np.zeros(0, np.uint16)]
    variety = np.zeros(rows)
    held: list[np.ndarray] = []  # distinct words of a row that has several pieces
    before = -1, None  # the last row and word of the piece before
    for first, n, part in pieces(column):
        raw, starts, lengths, counts = word_spans(part)
        if len(starts):
            row = np.repeat(np.arange(n), counts)
            word, shape, own = piece_sums(raw, starts, lengths, row, n)
            same = np.zeros(len(word), bool)
            same[1:] = (word[1:] == word[:-1]) & (row[1:] == row[:-1])
            same[0] = before[0] == first + row[0] and before[1] == word[0]
            own[:, 4] = np.bincount(row, same, n)
            sums[first : first + n] += own
            per_row[first : first + n] += counts
            words.append((word % U(WEIGHTS)).astype(np.uint16)), shapes.append((shape % U(WEIGHTS)).astype(np.uint16))
            if held and before[0] != first:
                variety[before[0]] = len(np.unique(np.concatenate(held)))
                held = []
            order = np.lexsort((word, row))
            fresh = np.ones(len(word), bool)
            fresh[1:] = (word[order][1:] != word[order][:-1]) | (row[order][1:] != row[order][:-1])
            if n == 1:
                held.append(word[order][fresh])
            else:
                variety[first : first + n] = np.bincount(row[order][fresh], minlength=n)
            before = first + int(row[-1]), word[-1]
    if held:
        variety[before[0]] = len(np.unique(np.concatenate(held)))
    size, total = np.maximum(per_row, 1), np.maximum(sums[:, 0], 1)
    s = np.stack((per_row, sums[:, 1] / total, sums[:, 2] / np.maximum(sums[:, 1], 1), sums[:, 3] / total, sums[:, 4] / size, variety / np.minimum(size, 400), sums[:, 5] / size, sums[:, 6] / size, sums[:, 7] / size, total / size * (per_row > 0)), axis=1)
    return s, np.concatenate(words), np.concatenate(shapes), per_row


def piece_sums(raw: np.ndarray, starts: np.ndarray, lengths: np.ndarray, row: np.ndarray, rows: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of words and of word shapes; per row the bytes, letters, capitals, symbols, (0), repeated stops, bars, ends."""
    begin = np.concatenate(([0], np.cumsum(lengths)))
    at = np.arange(begin[-1]) - np.repeat(begin[:-1], lengths)
    picked = raw[np.repeat(starts, lengths) + at]
    word = word_sums(raw, starts, lengths, FOLDED)
    kind = CLASS[picked]
    new = at == 0
    new[1:] |= kind[1:] != kind[:-1]
    index = np.flatnonzero(new)
    first = np.flatnonzero(at[index] == 0)
    inside = np.arange(len(index)) - np.repeat(first, np.diff(np.append(first, len(index))))
    shape = mix(np.add.reduceat(stream(256, 21)[kind[index]] * places(int(inside.max()) + 1)[inside], first))
    add = lambda x: np.bincount(row, x, rows)
    of_bytes = lambda mask: add(np.add.reduceat(mask[picked].astype(np.int64), begin[:-1]))
    tail = raw[starts + lengths - 1]
    twice = (lengths > 1) & STOP[tail] & (raw[starts + np.maximum(lengths - 2, 0)] == tail)
    bars = (lengths == 1) & np.isin(raw[starts], [ord(c) for c in "|>•*#=~" if ord(c) < 256])
    return word, shape, np.stack((add(lengths), of_bytes(LETTER), of_bytes(UPPER), of_bytes(SYMBOL), np.zeros(rows), add(twice), add(bars), add(STOP[tail] & ~twice)), axis=1)


def votes(s: np.ndarray) -> np.ndarray:
    """1 good, -1 bad or 0 from each labeller on each row of statistics."""
    words, letters, upper, symbols, again, variety, bangs, bars, ends, length = s.T
    enough = words >= 8

    def vote(good, bad):
        return np.where(bad, -1, np.where(good, 1, 0)) * (words > 0)

    return np.stack(
        (
            vote(symbols < 0.015, symbols > 0.08),
            vote(letters > 0.88, letters < 0.75),
            vote(upper < 0.12, enough & (upper > 0.4)),
            vote(again < 0.03, enough & (again > 0.2)),
            vote(enough & (variety > 0.35), (words >= 30) & (variety < 0.2)),
            vote(bangs < 0.02, bangs > 0.15),
            vote(bars < 0.02, bars > 0.12),
            vote((ends > 0.01) & (ends < 0.4), (words >= 40) & (ends < 0.003)),
        ),
        axis=1,
    )


LABELLERS = 8
POWERS = 3 ** np.arange(LABELLERS)


def pattern_of(v: np.ndarray) -> np.ndarray:
    return ((v + 1) * POWERS).sum(axis=1)


def fit(patterns: np.ndarray, counts: np.ndarray, rounds: int = 200) -> tuple[np.ndarray, np.ndarray, float]:
    """Posterior of good for each pattern, each labeller's accuracy where it votes, and the share of good documents."""
    v = patterns[:, None] // POWERS % 3
    good = np.where((v == 0).any(axis=1), 0.1, 0.9)  # to begin with: one bad vote counts against a document
    prior = 0.5
    for _ in range(rounds):
        table = np.zeros((2, LABELLERS, 3))
        for c, weight in enumerate((counts * (1 - good), counts * good)):
            for x in (0, 2):
                table[c, :, x] = ((v == x) * weight[:, None]).sum(axis=0) + 0.5
        table /= table.sum(axis=2, keepdims=True)
        table[:, :, 1] = 1  # not to vote says nothing
        prior = (counts @ good + 1) / (counts.sum() + 2)
        score = np.log(prior / (1 - prior)) + sum(np.log(table[1, j, v[:, j]] / table[0, j, v[:, j]]) for j in range(LABELLERS))
        fresh = 1 / (1 + np.exp(-np.clip(score, -60, 60)))
        if np.abs(fresh - good).max() < 1e-9:
            break
        good = fresh
    right = prior * table[1, :, 2] + (1 - prior) * table[0, :, 0]
    wrong = prior * table[1, :, 0] + (1 - prior) * table[0, :, 2]
    return good, right / (right + wrong), float(prior)


def bins_of(s: np.ndarray) -> np.ndarray:
    """A hashed feature for each statistic of each row: which of some steps it has reached."""
    steps = np.floor(np.log2(np.maximum(s, 1e-3) * 1024)).astype(np.int64)
    return (mix((steps * 64 + np.arange(s.shape[1])).astype(U) + U(0x5EED)) % U(WEIGHTS)).astype(np.int64)


def margins(s, word, shape, per_row, weights: np.ndarray, bias: float) -> np.ndarray:
    row = np.repeat(np.arange(len(per_row)), per_row)
    w = weights[word] + weights[shape]
    mean = np.bincount(row, w, len(per_row)) / np.maximum(per_row, 1)
    return bias + 4 * mean + weights[bins_of(s)].sum(axis=1)


def train(texts: Iterator[pa.Array], posterior: dict[int, float], seed: int = 4) -> tuple[np.ndarray, float]:
    """Weights and bias of the logistic scorer from texts and the posteriors of their vote patterns; zeros from no text."""
    got = [described(x) for x in texts]
    if not got:
        return np.zeros(WEIGHTS, np.float32), 0.0
    s, word, shape, per_row = (np.concatenate(x) for x in zip(*got))
    label = np.array([posterior.get(int(p), 0.5) for p in pattern_of(votes(s))])
    bins, cut = bins_of(s), np.concatenate(([0], np.cumsum(per_row)))
    weights, squares, bias, bias_square = np.zeros(WEIGHTS), np.full(WEIGHTS, 1e-6), 0.0, 1e-6
    order = np.random.default_rng(seed)
    for _ in range(EPOCHS):
        for i in order.permutation(len(label)):
            a, b = cut[i], cut[i + 1]
            own = np.concatenate((word[a:b], shape[a:b], bins[i]))
            x = np.concatenate((np.full(2 * (b - a), 4 / max(b - a, 1)), np.ones(bins.shape[1])))
            d = 1 / (1 + np.exp(-np.clip(bias + weights[own] @ x, -30, 30))) - label[i]
            at, back = np.unique(own, return_inverse=True)
            g = d * np.bincount(back, x) + 1e-5 * weights[at]
            squares[at] += g * g
            weights[at] -= 0.3 * g / np.sqrt(squares[at])
            bias_square += d * d
            bias -= 0.3 * d / np.sqrt(bias_square)
    return weights.astype(np.float32), float(bias)


def vote_table(rows: DataFrame, sample: int) -> DataFrame:
    """From (place, text): (pattern, n) of the vote patterns, and (place, bytes) of each task's texts of least place.

    A task gives at most sample places, one for each distinct text, so the least of all tasks' are the least of all texts.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(3**LABELLERS, np.int64)
        least, size = np.zeros(0, np.int64), np.zeros(0, np.int64)
        for whole in batches:
            for b in slices(whole, "text"):
                column = b.column("text")
                s = described(column)[0]
                total += np.bincount(pattern_of(votes(s)), minlength=3**LABELLERS)
                some = s[:, 0] > 0
                least, first = np.unique(np.concatenate((least, b.column("place").to_numpy()[some])), return_index=True)
                size = np.concatenate((size, np.diff(offsets(column))[some]))[first]
                least, size = least[:sample], size[:sample]
        at = np.flatnonzero(total)
        for a, b, names in ((at, total[at], ("pattern", "n")), (least, size, ("place", "bytes"))):
            for i in range(0, len(a), 1 << 16):
                own = {names[0]: pa.array(a[i : i + (1 << 16)]), names[1]: pa.array(b[i : i + (1 << 16)])}
                none = pa.nulls(len(own[names[0]]), pa.int64())
                yield pa.RecordBatch.from_arrays([own.get(c, none) for c in ("pattern", "n", "place", "bytes")], names=["pattern", "n", "place", "bytes"])

    return rows.mapInArrow(run, "pattern long, n long, place long, bytes long")


def sampled(rows: DataFrame, places_of: DataFrame, sample: int, most_bytes: int) -> DataFrame:
    """(place, text): the distinct texts of least place, at most sample of them and, but for the first, most_bytes in all."""
    chosen = places_of.where("place is not null").groupBy("place").agg(F.max("bytes").alias("bytes")).orderBy("place").limit(sample).collect()  # at most sample rows
    last, total = -(2**63), 0
    for i, r in enumerate(chosen):
        total += r["bytes"]
        if i and total > most_bytes:
            break
        last = r["place"]

    def once(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for b in batches:
            at = []
            for i, p in enumerate(b.column("place").to_pylist()):
                if p not in seen:
                    seen.add(p), at.append(i)
            yield b.take(pa.array(at, pa.int64()))

    kept = rows.where((F.col("place") <= last) & F.col("text").rlike(r"[^\x20\x09-\x0D]")) if chosen else rows.limit(0)
    return kept.mapInArrow(once, "place long, text string").groupBy("place").agg(F.first("text").alias("text"))


def learn(docs: DataFrame, text: str = "text", sample: int = SAMPLE, seed: int = 4, most_bytes: int = SAMPLE_BYTES) -> dict:
    """The label model over all rows, and the scorer, trained on a bounded sample of distinct texts.

    Votes, their patterns' counts and the labellers' accuracies cover every row, repeated ones as often as they stand. The
    sample takes the sample distinct texts of least seeded hash, and of those as many as most_bytes hold, one at least; a
    text counts once in it however often it is repeated, and no text is cut. Null texts and those without words vote
    nothing and are not sampled; from an empty table, or one without words, comes a model of zeros.
    """
    use_workers(docs.sparkSession)
    rows = docs.select(F.col(text).cast("string").alias("text"))
    rows = rows.select(F.xxhash64(F.lit(seed), "text").alias("place"), "text")
    table = written(vote_table(rows, sample), "votes")
    counted = table.where("pattern is not null").groupBy("pattern").agg(F.sum("n").alias("n")).orderBy("pattern").collect()  # at most 3**LABELLERS rows
    if not counted:
        return {"weights": np.zeros(WEIGHTS, np.float32), "bias": 0.0, "posterior": {}, "accuracy": [0.5] * LABELLERS, "prior": 0.5}
    kinds, counts = np.array([r["pattern"] for r in counted]), np.array([r["n"] for r in counted], float)
    good, accuracy, prior = fit(kinds, counts)
    posterior = dict(zip(kinds.tolist(), good.tolist()))

    def fit_scorer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights, bias = train((x.column("text") for b in batches for x in slices(b, "text", 1 << 18)), posterior, seed)
        yield pa.RecordBatch.from_arrays([pa.array([weights.tobytes()], pa.binary()), pa.array([bias])], names=["weights", "bias"])

    few = sampled(rows, table, sample, most_bytes)
    got = few.repartition(1).sortWithinPartitions("place").select("text").mapInArrow(fit_scorer, "weights binary, bias double").first()
    weights = np.frombuffer(got["weights"], np.float32) if got else np.zeros(WEIGHTS, np.float32)
    return {"weights": weights, "bias": got["bias"] if got else 0.0, "posterior": posterior, "accuracy": accuracy.tolist(), "prior": prior}


def score(docs: DataFrame, model: dict, keep: list[str], text: str = "text", least: float = LEAST_SCORE, names: tuple[str, str, str] = ("posterior", "score", "is_good")) -> DataFrame:
    """The columns in keep with posterior, score and is_good of every row.

    posterior is the label model's probability that the row is good, score the hashed scorer's; is_good says whether the
    score is at least least. A null text or one without words has posterior and score 0 and is not good. Equal texts get
    equal scores; an empty table gives no rows. Columns not in keep are dropped, so only a
    kept column could clash with the results' names; that is refused, and names is the way round it.
    """
    spark = docs.sparkSession
    use_workers(spark)
    if set(names) & set(keep):
        raise ValueError(f"names of kept columns: {names}")
    shared = spark.sparkContext.broadcast((model["weights"], model["bias"], model["posterior"]))
    base, place = laid_out(docs, keep, text)
    out = StructType([*base.schema.fields[: len(keep)], StructField("posterior", DoubleType()), StructField("score", DoubleType()), StructField("is_good", BooleanType())])
    arrow = to_arrow_schema(out)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights, bias, posterior = shared.value
        for whole in batches:
            for b in slices(whole, place):
                s, word, shape, per_row = described(b.column(place))
                some = per_row > 0
                p = np.array([posterior.get(int(x), 0.5) for x in pattern_of(votes(s))]) * some
                z = 1 / (1 + np.exp(-np.clip(margins(s, word, shape, per_row, weights, bias), -30, 30))) * some
                yield pa.RecordBatch.from_arrays([*b.columns[: len(keep)], pa.array(p, pa.float64()), pa.array(z, pa.float64()), pa.array(some & (z >= least))], schema=arrow)

    return base.mapInArrow(run, out).select(*(F.col(f"k{i}").alias(c) for i, c in enumerate(keep)), *(F.col(c).alias(n) for c, n in zip(("posterior", "score", "is_good"), names)))
