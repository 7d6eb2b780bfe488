"""Hashes of words and word shingles of whole texts, a batch at a time in NumPy."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

from plumbline.llm.common import data, offsets

U = np.uint64


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words that spreads every bit (the finaliser of splitmix64)."""
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


def stream(n: int, seed: int) -> np.ndarray:
    return mix(np.arange(1, n + 1, dtype=U) * U(0x9E3779B97F4A7C15) + U(seed))


SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
VALUE = stream(256, 11)
FOLDED = VALUE.copy()
FOLDED[65:91] = VALUE[97:123]
_place = [stream(64, 12) | U(1)]
#: Bytes that are hashed at once: the work arrays take some fifty times their room.
PIECE = 1 << 20


def place_range(start: int, end: int) -> np.ndarray:
    """The odd multipliers of byte positions from start up to end."""
    return mix(np.arange(start + 1, end + 1, dtype=U) * U(0x9E3779B97F4A7C15) + U(12)) | U(1)


def places(n: int) -> np.ndarray:
    """Odd multipliers of the first n byte positions of a word."""
    if len(_place[0]) < n:
        _place[0] = stream(max(n, 2 * len(_place[0])), 12) | U(1)
    return _place[0]


def word_spans(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Bytes, start and length of every word (a run of bytes other than space and \\t to \\r), and words per row."""
    off = offsets(column)
    lo, hi = int(off[0]), int(off[-1])
    raw = data(column)[lo:hi]
    off = off - lo
    if not len(raw):
        return raw, np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(off) - 1, np.int64)
    word = ~SPACE[raw]
    first = np.zeros(len(raw) + 1, bool)
    first[off[:-1]] = True
    first = first[: len(raw)]
    begins = word.copy()
    begins[1:] &= ~word[:-1] | first[1:]
    ends = word.copy()
    ends[:-1] &= ~word[1:] | first[1:]
    starts = np.flatnonzero(begins)
    lengths = np.flatnonzero(ends) + 1 - starts
    return raw, starts, lengths, np.diff(np.searchsorted(starts, off))


def pieces(column: pa.Array, most: int = 0) -> Iterator[tuple[int, int, pa.Array]]:
    """(first row, rows, texts): the column in pieces of at most so many bytes (PIECE); a longer row is cut between words.

    Only a single word can make a piece longer.
    """
    most = most or PIECE
    off, raw = offsets(column), data(column)
    i, n = 0, len(column)
    while i < n:
        j = max(i + 1, int(np.searchsorted(off, off[i] + most, side="right")) - 1)
        if j > i + 1 or off[j] - off[i] <= most:
            yield i, j - i, column.slice(i, j - i)
        else:
            at, end = int(off[i]), int(off[j])
            while at < end:
                stop = min(at + most, end)
                while stop < end and not (gaps := SPACE[raw[stop : min(stop + most, end)]]).any():
                    stop = min(stop + most, end)
                if stop < end:
                    stop += int(np.argmax(gaps))
                yield i, 1, pa.array([raw[at:stop].tobytes()], pa.large_binary())
                at = stop
        i = j


def word_sums(raw: np.ndarray, starts: np.ndarray, lengths: np.ndarray, value: np.ndarray) -> np.ndarray:
    """The hash of each word from the value of each byte and its place in the word."""
    if lengths.max() > 4 * PIECE:  # a word of many pieces: add it up piece by piece
        out = np.zeros(len(starts), U)
        for i, (a, n) in enumerate(zip(starts.tolist(), lengths.tolist())):
            for b in range(0, n, PIECE):
                own = value[raw[a + b : a + min(n, b + PIECE)]]
                out[i : i + 1] += (own * place_range(b, b + len(own))).sum(dtype=U, keepdims=True)
        return mix(out + lengths.astype(U))
    begin = np.concatenate(([0], np.cumsum(lengths)))
    at = np.arange(begin[-1]) - np.repeat(begin[:-1], lengths)
    picked = raw[np.repeat(starts, lengths) + at]
    return mix(np.add.reduceat(value[picked] * places(int(lengths.max()))[at], begin[:-1]) + lengths.astype(U))


def word_hashes(column: pa.Array, fold: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """A 64-bit hash of each word, A-Z as a-z if fold is set, and the number of words of each row."""
    found, per_row = [np.zeros(0, U)], np.zeros(len(column), np.int64)
    for first, rows, part in pieces(column):
        raw, starts, lengths, counts = word_spans(part)
        per_row[first : first + rows] += counts
        if len(starts):
            found.append(word_sums(raw, starts, lengths, FOLDED if fold else VALUE))
    return np.concatenate(found), per_row


def shingle_sets(column: pa.Array, k: int) -> Iterator[np.ndarray]:
    """Each row's set of k-word shingles as sorted 64-bit hashes; a shorter text is one shingle, one without words none."""
    words, per_row = word_hashes(column)
    key = stream(k, 13) | U(1)
    n = max(0, len(words) - k + 1)
    total = np.zeros(n, U)
    for j in range(k):
        total += words[j : j + n] * key[j]
    total = mix(total)
    at = 0
    for m in per_row.tolist():
        if m >= k:
            own = np.sort(total[at : at + m - k + 1])
            if len(own) > 1:
                own = own[np.concatenate(([True], own[1:] != own[:-1]))]
        elif m:
            own = mix((words[at : at + m] * key[:m]).sum(dtype=U, keepdims=True) + U(0x1000 * m))
        else:
            own = total[:0]
        at += m
        yield own
