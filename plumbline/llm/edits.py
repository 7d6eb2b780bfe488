"""Edit-aware token counts: a segment tree over each document's pre-tokens, and re-encoding only where edits reach.

Leaves hold runs of pre-tokens with their characters and tokens; inner nodes hold sums. An edit finds its leaves by
descending on characters. Pre-tokens that end LOOK characters before the edit stay; from the next one on the text is cut
anew until a new boundary falls on an old one behind the edit, from where both cuts agree. Only the pre-tokens between
are encoded again, and only the paths above their leaves are summed again.
"""

from __future__ import annotations

from array import array
from collections.abc import Iterable, Iterator
from itertools import chain, islice

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import LongType, StructField, StructType

from plumbline.llm.common import slices, use_workers
from plumbline.llm.tokens import LOOK, Coder, coder

#: Pre-tokens in a leaf; a leaf that grows beyond FULL times that has the tree built anew.
LEAF, FULL = 64, 8


#: Characters from which a text's pre-tokens are taken one by one, never all at once.
LONG = 1 << 20


def packed(pieces: list[str]) -> tuple[str, array]:
    """A leaf: its pre-tokens as one string, and their lengths; many small strings would take twenty times the room."""
    return "".join(pieces), array("I", map(len, pieces))


def unpacked(leaf: tuple[str, array]) -> list[str]:
    text, lengths = leaf
    out, at = [], 0
    for n in lengths:
        out.append(text[at : at + n])
        at += n
    return out


class TokenTree:
    """Token counts of one document under edits."""

    def __init__(self, text: str, code: Coder):
        self.code = code
        self.encoded = self.rebuilt = 0
        self._build(code.pattern.findall(text) if len(text) < LONG else (m.group() for m in code.pattern.finditer(text)))

    def _build(self, pieces: Iterable[str]) -> None:
        rest, leaves, tokens = iter(pieces), [], []
        while own := list(islice(rest, LEAF)):
            leaves.append(packed(own))
            tokens.append(self._tokens(own))
        self.leaves = leaves or [packed([])]
        self.width = 1
        while self.width < len(self.leaves):
            self.width *= 2
        self.chars, self.tokens = [0] * (2 * self.width), [0] * (2 * self.width)
        self.chars[self.width : self.width + len(leaves)] = [len(x[0]) for x in leaves]
        self.tokens[self.width : self.width + len(leaves)] = tokens
        for i in range(self.width - 1, 0, -1):
            self._sum(i)

    def _tokens(self, pieces: list[str]) -> int:
        return sum(map(len, map(self.code.pieces.__getitem__, pieces))) // 4

    def _set(self, i: int, pieces: list[str]) -> None:
        self.leaves[i] = packed(pieces)
        self.chars[self.width + i], self.tokens[self.width + i] = len(self.leaves[i][0]), self._tokens(pieces)

    def _sum(self, i: int) -> None:
        self.chars[i], self.tokens[i] = self.chars[2 * i] + self.chars[2 * i + 1], self.tokens[2 * i] + self.tokens[2 * i + 1]

    @property
    def n_chars(self) -> int:
        return self.chars[1]

    @property
    def n_tokens(self) -> int:
        return self.tokens[1]

    def text(self) -> str:
        return "".join(leaf[0] for leaf in self.leaves)

    def find(self, at: int) -> tuple[int, int]:
        """The leaf that holds the character, and its first character's place."""
        i, start = 1, 0
        at = min(at, max(0, self.n_chars - 1))
        while i < self.width:
            i *= 2
            if at - start >= self.chars[i]:
                start += self.chars[i]
                i += 1
        return min(i - self.width, len(self.leaves) - 1), start

    def edit(self, start: int, end: int, new: str) -> None:
        """Replace the characters from start up to end."""
        start = max(0, min(start, self.n_chars))
        end = max(start, min(end, self.n_chars))
        first, first_at = self.find(max(0, start - LOOK))
        while first and first_at > max(0, start - LOOK):
            first -= 1
            first_at -= self.chars[self.width + first]
        pieces, keep, at = unpacked(self.leaves[first]), 0, first_at
        while keep < len(pieces) and at + len(pieces[keep]) <= start - LOOK:
            at += len(pieces[keep])
            keep += 1
        begin, begin_at = keep, at
        # old pre-tokens from here on, taken leaf by leaf until the new cut meets them
        last, old, ends = first, pieces[begin:], []
        place = begin_at
        for p in old:
            place += len(p)
            ends.append(place)
        shift = len(new) - (end - start)
        while True:
            while last + 1 < len(self.leaves) and (not ends or ends[-1] < end + 1):
                last += 1
                for p in unpacked(self.leaves[last]):
                    place += len(p)
                    old.append(p)
                    ends.append(place)
            whole = last + 1 == len(self.leaves)
            region = "".join(old)
            region = region[: start - begin_at] + new + region[end - begin_at :]
            fresh, cut = [], begin_at
            old_ends = {e + shift: k for k, e in enumerate(ends) if e >= end}
            met = None
            for m in self.code.pattern.finditer(region):
                p = m.group()
                if not whole and m.end() > len(region) - LOOK:
                    break
                fresh.append(p)
                cut += len(p)
                if cut in old_ends and cut >= start + len(new):
                    met = old_ends[cut]
                    break
            if met is not None or whole:
                break
            last += 1
            for p in unpacked(self.leaves[last]):
                place += len(p)
                old.append(p)
                ends.append(place)
        rest = old[met + 1 :] if met is not None else []
        self.encoded += len(fresh)
        merged = pieces[:begin] + fresh + rest
        slots = last - first + 1
        share = -(-len(merged) // slots) if merged else 0
        if share > LEAF * FULL:
            self.rebuilt += 1
            before, after = self.leaves[:first], self.leaves[last + 1 :]
            self._build(chain((p for leaf in before for p in unpacked(leaf)), merged, (p for leaf in after for p in unpacked(leaf))))
            return
        for i in range(slots):
            self._set(first + i, merged[i * share : (i + 1) * share])
        low, high = (self.width + first) // 2, (self.width + last) // 2
        while low:
            for i in range(low, high + 1):
                self._sum(i)
            low, high = low // 2, high // 2


def count_under_edits(docs: DataFrame, edits: Column, ranks_path: str, pattern: str, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """Token counts of every whole text before and after its edits, made one after the other.

    edits is a column of array<struct<at: long, upto: long, new: string>>, places in characters of the text as it then is,
    cut to its ends; a null array, edit or replacement changes nothing or inserts nothing. A null text is empty. The
    result has the columns in keep, n_edits, n_chars, n_tokens, n_chars_after, n_tokens_after and n_encoded (pre-tokens
    that edits had encoded again). Repeated rows each give a row; those names may not be among keep, and columns not in
    keep are dropped; an empty table gives none. A document's tree is one task's work and holds its text about three times.
    """
    use_workers(docs.sparkSession)
    keep = list(keep or [])
    names = ["n_edits", "n_chars", "n_tokens", "n_chars_after", "n_tokens_after", "n_encoded"]
    if set(names) & set(keep):
        raise ValueError(f"reserved column names: {names}")
    base = docs.select(*(F.col(c).alias(f"k{i}") for i, c in enumerate(keep)), F.col(text).cast("string").alias("text"), edits.alias("edits"))
    out = StructType([*base.schema.fields[:-2], *(StructField(n, LongType()) for n in names)])
    arrow = to_arrow_schema(out)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code = coder(ranks_path, pattern)
        for whole in batches:
            for b in slices(whole, "text"):
                rows = []
                for value, todo in zip(b.column("text").to_pylist(), b.column("edits").to_pylist()):
                    tree = TokenTree(value or "", code)
                    before = tree.n_chars, tree.n_tokens
                    made = [e for e in todo or () if e is not None and e["at"] is not None]
                    for e in made:
                        tree.edit(e["at"], e["upto"] if e["upto"] is not None else e["at"], e["new"] or "")
                    rows.append((len(made), *before, tree.n_chars, tree.n_tokens, tree.encoded))
                columns = list(zip(*rows)) if rows else [[]] * len(names)
                yield pa.RecordBatch.from_arrays([*b.columns[:-2], *(pa.array(c, pa.int64()) for c in columns)], schema=arrow)

    return base.mapInArrow(run, out).select(*(F.col(f"k{i}").alias(c) for i, c in enumerate(keep)), *names)
