"""Language identification by rank-order profiles: a document's most frequent letter n-grams against each language's.

Texts are lower-cased; everything but letters separates words. Of the 1-, 2- and 3-grams of letters and word edges, the
PROFILE most frequent are ranked; a gram's distance is how far its rank is out of place, or PROFILE if the language's
profile lacks it.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import DoubleType, StringType, StructField, StructType

from plumbline.llm.common import laid_out, slices, use_workers

#: Ranks in a profile; languages that may be told apart (fewer than 8,000 are known); grams that a task holds before it
#: counts them; characters of a text that are taken at once.
PROFILE, MOST_LANGUAGES, FLUSH, PIECE = 400, 1 << 14, 1 << 21, 1 << 20
UNKNOWN = "und"
#: What stands for a word's edge in a gram: a code point that is no letter. Grams are three code points of 21 bits each,
#: shorter ones with zeros in front, so every gram has a number of its own.
EDGE, BITS = 1, np.uint64(21)

_table: list[np.ndarray] = []


def letter_table() -> np.ndarray:
    """For each code point whether it is a letter."""
    if not _table:
        _table.append(np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000))
    return _table[0]


def counted(grams: np.ndarray, counts: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Distinct grams in order, and how often each stands."""
    if counts is None:
        return np.unique(grams, return_counts=True)
    order = np.argsort(grams, kind="stable")
    grams, counts = grams[order], counts[order]
    first = np.flatnonzero(np.concatenate(([True], grams[1:] != grams[:-1]))) if len(grams) else np.zeros(0, int)
    return grams[first], np.add.reduceat(counts, first) if len(grams) else counts


def gram_counts(text: str) -> tuple[np.ndarray, np.ndarray]:
    """All n-grams of the whole text and how often each stands, none if it has no letter; taken piece by piece."""
    text = text.lower()
    letter = letter_table()
    found: list[tuple[np.ndarray, np.ndarray]] = []
    carry = np.array([EDGE], np.uint64)  # the last two codes before the piece
    for at in range(0, len(text), PIECE):
        point = np.frombuffer(text[at : at + PIECE].encode("utf-32-le", "surrogatepass"), np.uint32)
        code = np.where(letter[point], point, EDGE).astype(np.uint64)
        if at + PIECE >= len(text):
            code = np.append(code, np.uint64(EDGE))
        keep = code != EDGE
        keep[1:] |= code[:-1] != EDGE  # one edge behind each word
        keep[0] |= carry[-1] != EDGE
        c = np.concatenate((carry, code[keep]))
        if len(c) > len(carry):
            new = len(carry)
            one = c[new:][c[new:] != EDGE]
            two = c[new - 1 : -1] << BITS | c[new:]
            third = np.arange(max(new, 2), len(c))
            third = third[c[third - 1] != EDGE]
            three = c[third - 2] << (2 * BITS) | c[third - 1] << BITS | c[third]
            found.append(counted(np.concatenate((one, two, three))))
            carry = c[-2:]
    if not found:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    if len(found) == 1:
        return found[0]
    return counted(*(np.concatenate(x) for x in zip(*found)))


def grams(text: str) -> np.ndarray:
    """All n-grams of the whole text in order of their codes, each as often as it stands."""
    return np.repeat(*gram_counts(text))


def ranked(text: str, most: int) -> np.ndarray:
    """The text's most frequent grams, ties to the smaller code."""
    g, n = gram_counts(text)
    if len(g) > most:
        often = n >= np.partition(n, len(n) - most)[len(n) - most]
        g, n = g[often], n[often]
    return g[np.lexsort((g, -n))][:most]


def profiles(docs: DataFrame, text: str = "text", lang: str = "lang", size: int = PROFILE) -> dict[str, list[int]]:
    """Each language's most frequent grams over all its rows, by falling frequency, ties to the smaller code.

    Rows without text or language teach nothing, nor do texts without a letter; repeated rows count as often as they stand;
    an empty table has no languages. Other columns are ignored.
    """
    use_workers(docs.sparkSession)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, list[tuple[np.ndarray, np.ndarray]]] = {}
        n = 0

        def out(all_held):
            for name, parts in all_held.items():
                codes, counts = counted(*(np.concatenate(x) for x in zip(*parts)))
                yield pa.RecordBatch.from_arrays([pa.array([name] * len(codes), pa.string()), pa.array(codes.astype(np.int64)), pa.array(counts)], names=["lang", "gram", "n"])

        for whole in batches:
            for b in slices(whole, "text"):
                for name, value in zip(b.column("lang").to_pylist(), b.column("text").to_pylist()):
                    g = gram_counts(value)
                    n += len(g[0])
                    held.setdefault(name, []).append(g)
                if n >= FLUSH:
                    yield from out(held)
                    held, n = {}, 0
        yield from out(held)

    rows = docs.select(F.col(text).cast("string").alias("text"), F.col(lang).alias("lang")).where("text is not null and lang is not null")
    totals = rows.mapInArrow(count, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    place = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), "gram"))
    found: dict[str, list[int]] = {}
    for r in totals.withColumn("place", place).where(F.col("place") <= size).limit(size * MOST_LANGUAGES + 1).toLocalIterator():
        found.setdefault(r["lang"], []).append((r["place"], r["gram"]))
    if len(found) > MOST_LANGUAGES:
        raise ValueError(f"more than {MOST_LANGUAGES} languages")
    return {k: [g for _, g in sorted(v)] for k, v in sorted(found.items())}


def postings(known: list[list[int]]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """All profiles' grams in order, where each gram's postings begin, and the postings' languages and ranks."""
    grams = np.concatenate([np.array(p, np.uint64) for p in known]) if known else np.zeros(0, np.uint64)
    spoken = np.repeat(np.arange(len(known), dtype=np.int32), [len(p) for p in known])
    rank = np.concatenate([np.arange(len(p), dtype=np.int32) for p in known]) if known else np.zeros(0, np.int32)
    order = np.argsort(grams, kind="stable")
    union, first = np.unique(grams[order], return_index=True)
    return union, np.append(first, len(grams)), spoken[order], rank[order]


def identify(docs: DataFrame, known: dict[str, list[int]], keep: list[str], text: str = "text", size: int = PROFILE, names: tuple[str, str] = ("lang_pred", "score")) -> DataFrame:
    """The columns in keep with lang_pred and score (or as names says) of every row.

    lang_pred is the language whose profile is nearest, ties to the smaller name; und with score 0 if the text is null or
    has no letter, or if no language is known. score is 1 less the share of the largest possible distance. Repeated rows
    and repeated texts get equal answers. Columns not in keep are dropped, so only a kept column of
    such a name could clash; that is refused, and names is the way round it.
    """
    spark = docs.sparkSession
    use_workers(spark)
    if set(names) & set(keep):
        raise ValueError(f"names of kept columns: {names}")
    languages = sorted(known)
    shared = spark.sparkContext.broadcast((languages, *postings([known[n] for n in languages])))  # a profile's grams a language
    base, place = laid_out(docs, keep, text)
    out = StructType([*base.schema.fields[: len(keep)], StructField("lang_pred", StringType()), StructField("score", DoubleType())])
    arrow = to_arrow_schema(out)

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        languages, union, starts, spoken, rank = shared.value
        for b in (x for whole in batches for x in slices(whole, place)):
            lang, score = [], []
            for value in b.column(place).to_pylist():
                own = ranked(value, size) if value and len(languages) else ()
                if not len(own):
                    lang.append(UNKNOWN), score.append(0.0)
                    continue
                at = np.minimum(np.searchsorted(union, own), len(union) - 1)
                place_of = np.flatnonzero(union[at] == own)
                first = starts[at[place_of]]
                count = starts[at[place_of] + 1] - first
                each = np.arange(count.sum()) + np.repeat(first - np.concatenate(([0], np.cumsum(count)[:-1])), count)
                # grams that a language lacks are size apart; those that it has take off what they are less
                less = size - np.abs(rank[each] - np.repeat(place_of, count))
                apart = len(own) * size - np.bincount(spoken[each], less, len(languages))
                best = int(np.argmin(apart))
                lang.append(languages[best]), score.append(1 - float(apart[best]) / (len(own) * size))
            yield pa.RecordBatch.from_arrays([*b.columns[: len(keep)], pa.array(lang, pa.string()), pa.array(score, pa.float64())], schema=arrow)

    done = base.mapInArrow(predict, out)
    return done.select(*(F.col(f"k{i}").alias(c) for i, c in enumerate(keep)), F.col("lang_pred").alias(names[0]), F.col("score").alias(names[1]))


def held_out(key: str):
    """Whether crc32 of the key as text leaves remainder 2 by 4; null keys are not held out."""
    return F.coalesce(F.pmod(F.crc32(F.col(key).cast("string")), F.lit(4)) == 2, F.lit(False))
