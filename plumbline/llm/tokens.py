"""Byte-level BPE over whole texts by overlapping chunks, and decoding.

A chunk is pre-tokenised from its own first character, so its first tokens may be cut wrongly. The pre-token
pattern looks back at nothing: once two chunks share a boundary, all later boundaries agree. So each chunk takes
over from its predecessor at the first boundary that both have in their overlap. A token counts only if the match
ended LOOK characters before the chunk's end, since what lies beyond could have changed it.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import pyarrow as pa
import regex
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import ArrayType, BinaryType, IntegerType, LongType, StringType, StructField, StructType

from plumbline.llm.common import slices, use_workers

#: Characters that a match of the pre-token pattern may look at beyond its end. It holds for public_tokenizers.PATTERN and
#: patterns like it, which look one character ahead; another pattern must not look further.
LOOK = 4
#: Pre-tokens whose ids a worker remembers; it starts afresh beyond that.
MOST_PIECES = 100_000

_coders: dict[tuple[str, str], "Coder"] = {}


class Pieces(dict):
    """Ids of pre-tokens as little-endian bytes, encoded when first asked for."""

    def __init__(self, whole):
        self.whole = whole

    def __missing__(self, piece: str) -> bytes:
        ids = self.whole.encode_ordinary(piece)
        out = b"".join(i.to_bytes(4, "little") for i in ids)
        if len(piece) <= 64:
            if len(self) >= MOST_PIECES:
                self.clear()
            self[piece] = out
        return out


class Coder:
    """Encodes pre-tokens by merge ranks; decodes ids to bytes."""

    def __init__(self, ranks_path: str, pattern: str):
        import tiktoken

        ranks = {}
        with open(ranks_path, "rb") as lines:
            for line in lines:
                if line.strip():
                    token, rank = line.split()
                    ranks[base64.b64decode(token)] = int(rank)
        self.pattern = regex.compile(pattern)
        # the library is given whole pre-tokens: its own pattern takes any string as one
        self.pieces = Pieces(tiktoken.Encoding("ranks", pat_str=r"[\s\S]+", mergeable_ranks=ranks, special_tokens={}))
        self.raw = [b""] * (max(ranks.values(), default=-1) + 1)
        for t, i in ranks.items():
            self.raw[i] = t

    def encode(self, text: str, chunk: int, overlap: int) -> bytes:
        """All ids of the text, four bytes each."""
        return b"".join(map(self.pieces.__getitem__, pre_tokens(text, self.pattern, chunk, overlap)))

    def decode(self, ids: bytes) -> bytes:
        return b"".join(map(self.raw.__getitem__, memoryview(ids).cast("I")))


def coder(ranks_path: str, pattern: str) -> Coder:
    if (key := (ranks_path, pattern)) not in _coders:
        _coders[key] = Coder(*key)
    return _coders[key]


def boundaries(text: str, pattern, last: bool) -> tuple[list[str], list[int]]:
    """Pre-tokens of one chunk and the offset at which each ends; without the last chunk's licence, only settled ones."""
    found, ends, at = pattern.findall(text), [], 0
    for piece in found:
        at += len(piece)
        ends.append(at)
    if at != len(text):  # the pattern leaves characters out: offsets must come from the matches
        spans = [(m.group(), m.end()) for m in pattern.finditer(text)]
        found, ends = [s[0] for s in spans], [s[1] for s in spans]
    if not last:
        while ends and ends[-1] > len(text) - LOOK:
            ends.pop(), found.pop()
    return found, ends


def stitch(left_ends: list[int], right_ends: list[int]) -> tuple[int, int] | None:
    """Indices just behind the first offset that both lists of boundaries hold."""
    i = j = 0
    while i < len(left_ends) and j < len(right_ends):
        if left_ends[i] == right_ends[j]:
            return i + 1, j + 1
        if left_ends[i] < right_ends[j]:
            i += 1
        else:
            j += 1
    return None


def pre_tokens(text: str, pattern, chunk: int, overlap: int) -> list[str]:
    """Pre-tokens of the whole text, from overlapping chunks. Where two chunks never meet, the rest is cut anew."""
    if len(text) <= chunk + overlap:
        return pattern.findall(text)
    out: list[str] = []
    pieces, ends = boundaries(text[: chunk + overlap], pattern, False)
    start, sure = chunk, 0  # sure: the last boundary taken over
    while True:
        last = start + chunk + overlap >= len(text)
        more, more_ends = boundaries(text[start : start + chunk + overlap], pattern, last)
        shifted = [start + e for e in more_ends]
        met = stitch(ends, shifted)
        if met is None:
            return out + pieces + pattern.findall(text, ends[-1] if ends else sure)
        out += pieces[: met[0]]
        sure = ends[met[0] - 1]
        pieces, ends = more[met[1] :], shifted[met[1] :]
        if last:
            return out + pieces
        start += chunk


def digests(batches: Iterator[pa.RecordBatch], text: str, make: tuple, schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    ranks_path, pattern, chunk, overlap, ids_wanted = make
    code = coder(ranks_path, pattern)
    for whole in batches:
        for b in slices(whole, text):
            rows = []
            for value in b.column(text).to_pylist():
                ids = code.encode(value or "", chunk, overlap)
                rows.append((len(ids) // 4, hashlib.sha256(ids).hexdigest(), hashlib.sha256(code.decode(ids)).hexdigest(), ids if ids_wanted else None))
            columns = list(zip(*rows)) if rows else [[]] * 4
            kept = [b.column(n) for n in b.schema.names if n != text]
            yield pa.RecordBatch.from_arrays([*kept, *(pa.array(c, t.type) for c, t in zip(columns, list(schema)[len(kept) :]))], schema=schema)


def encode_texts(df: DataFrame, ranks_path: str, pattern: str, text: str = "text", keep: list[str] | None = None, chunk: int = 1 << 15, overlap: int = 512, long_chars: int = 1 << 20, with_ids: bool = True) -> DataFrame:
    """Each text's ids (little-endian unsigned 32-bit), their number and hash, and the hash of the decoded bytes.

    A null text counts as an empty one: no ids. Repeated rows each give a row; an empty table gives none. Columns of
    df that are not named in keep are dropped, so clashing names cannot arise (n_tokens, ids_sha256, decoded_sha256
    and ids are reserved: a kept column of such a name is an error). Texts of at most long_chars characters are
    encoded where they are read, chunk by chunk; one that fits in a chunk and its overlap is one chunk. Longer ones are dealt out chunk by chunk over the cluster.
    The pattern must look no more than LOOK characters beyond a match. Ids above 2**32 do not exist; the rank file must be readable by every executor.
    """
    spark = df.sparkSession
    use_workers(spark)
    keep = list(df.columns if keep is None else keep)
    keep = [c for c in keep if c != text]
    taken = {"n_tokens", "ids_sha256", "decoded_sha256", "ids", "chunk_row", "chunk_no"} & set(keep)
    if taken:
        raise ValueError(f"reserved column names: {sorted(taken)}")

    base = df.select(*keep, text)
    out = StructType([*(base.schema[c] for c in keep), StructField("n_tokens", LongType()), StructField("ids_sha256", StringType()), StructField("decoded_sha256", StringType()), StructField("ids", BinaryType())])
    arrow = to_arrow_schema(out)
    make = (ranks_path, pattern, chunk, overlap, with_ids)
    is_long = F.length(F.col(text)) > long_chars
    short = base.where(~F.coalesce(is_long, F.lit(False))).mapInArrow(lambda it: digests(it, text, make, arrow), out)
    long_ones = _long_texts(base.where(is_long), text, keep, make, out, arrow)
    done = short.unionByName(long_ones)
    return done if with_ids else done.drop("ids")


def _long_texts(base: DataFrame, text: str, keep: list[str], make: tuple, out, arrow: pa.Schema) -> DataFrame:
    """Chunks of long texts as rows of their own, encoded all over the cluster and stitched per text."""

    ranks_path, pattern, chunk, overlap, with_ids = make
    cut = StructType([*(base.schema[c] for c in keep), StructField("chunk_row", LongType()), StructField("chunk_no", IntegerType()), StructField("chunk_last", IntegerType()), StructField("chunk_text", StringType())])
    cut_arrow = to_arrow_schema(cut)

    def chunks(batches):
        row = TaskContext.get().partitionId() << 33
        for b in batches:
            for i, value in enumerate(b.column(text).to_pylist()):
                row += 1
                one = [b.column(c).slice(i, 1) for c in keep]
                starts = range(0, max(1, len(value) - overlap), chunk)
                for no, s in enumerate(starts):
                    yield pa.RecordBatch.from_arrays([*one, pa.array([row]), pa.array([no], pa.int32()), pa.array([int(no == len(starts) - 1)], pa.int32()), pa.array([value[s : s + chunk + overlap]])], schema=cut_arrow)

    coded = StructType([*cut.fields, StructField("ends", ArrayType(IntegerType())), StructField("counts", ArrayType(IntegerType())), StructField("ids", BinaryType())])
    coded_arrow = to_arrow_schema(coded)

    def encode(batches):
        code = coder(ranks_path, pattern)
        for b in batches:
            ends, counts, ids = [], [], []
            for value, last in zip(b.column("chunk_text").to_pylist(), b.column("chunk_last").to_pylist()):
                found, at = boundaries(value, code.pattern, bool(last))
                parts = [code.pieces[p] for p in found]
                ends.append(at), counts.append([len(p) for p in parts]), ids.append(b"".join(parts))
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(ends, pa.list_(pa.int32())), pa.array(counts, pa.list_(pa.int32())), pa.array(ids, pa.binary())], schema=coded_arrow)

    def join(table: pa.Table) -> pa.Table:
        rows = sorted(table.select(["chunk_no", "ends", "counts", "ids", "chunk_text"]).to_pylist(), key=lambda r: r["chunk_no"])
        code = coder(ranks_path, pattern)
        done: list[bytes] = []
        ends, counts, ids = rows[0]["ends"], rows[0]["counts"], rows[0]["ids"]
        sure = 0
        for r in rows[1:]:
            start = r["chunk_no"] * chunk
            met = stitch(ends, [start + e for e in r["ends"]])
            if met is None:
                text_again = "".join(x["chunk_text"][:chunk] if x is not rows[-1] else x["chunk_text"] for x in rows)
                done.append(ids)
                done.append(b"".join(map(code.pieces.__getitem__, code.pattern.findall(text_again, ends[-1] if ends else sure))))
                ids = b""
                break
            done.append(ids[: sum(counts[: met[0]])])
            sure = ends[met[0] - 1]
            ends, counts, ids = [start + e for e in r["ends"][met[1] :]], r["counts"][met[1] :], r["ids"][sum(r["counts"][: met[1]]) :]
        done.append(ids)
        all_ids = b"".join(done)
        first = [table.column(c).slice(0, 1).combine_chunks() for c in keep]
        new = [[len(all_ids) // 4], [hashlib.sha256(all_ids).hexdigest()], [hashlib.sha256(code.decode(all_ids)).hexdigest()], [all_ids if with_ids else None]]
        return pa.table([*first, *(pa.array(v, t.type) for v, t in zip(new, list(arrow)[len(keep) :]))], schema=arrow)

    return base.mapInArrow(chunks, cut).repartition("chunk_row", "chunk_no").mapInArrow(encode, coded).groupBy("chunk_row").applyInArrow(join, out)
