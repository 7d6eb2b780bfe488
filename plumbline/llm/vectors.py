"""What the operators on vectors share: whole-number vectors as bytes, exact sums over many tasks, matrices in blocks."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Bytes of doubles in one block of vectors.
BLOCK_BYTES = 16 << 20
#: Parts in which partial results of many tasks are first added up.
PARTS = 64
KINDS = {1: np.int8, 2: np.int16, 4: np.int32, 8: np.float64}


def sound(vector: str) -> Column:
    """Whether the vector is neither null nor holds null or non-finite components."""
    bad = F.exists(vector, lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))
    return F.col(vector).isNotNull() & ~F.coalesce(bad, F.lit(True))


def packed(row: np.ndarray) -> bytes:
    """Whole numbers (as doubles) in the narrowest kind that holds them; zeros at the end go, so that equal vectors, the
    shorter filled up with zeros, have equal bytes."""
    some = np.flatnonzero(row)
    row = row[: some[-1] + 1] if len(some) else row[:0]
    most = np.abs(row).max() if len(row) else 0
    width = 1 if most < 128 else 2 if most < 1 << 15 else 4 if most < 1 << 31 else 8
    return bytes([width]) + (row + 0.0).astype(KINDS[width]).tobytes()


def whole(batch: pa.RecordBatch, column: str, scale: float) -> list[bytes]:
    """floor(scale * c) of every component of a list column, packed; scaled as doubles, which hold such a floor exactly."""
    lists = batch.column(column)
    off = np.asarray(lists.offsets).astype(np.int64)
    with np.errstate(over="ignore"):
        values = np.floor(np.asarray(lists.values.cast(pa.float64()))[off[0] : off[-1]] * scale)
    values = np.clip(values, -np.finfo(np.float64).max, np.finfo(np.float64).max)
    return [packed(values[a:b]) for a, b in zip((off[:-1] - off[0]).tolist(), (off[1:] - off[0]).tolist())]


def matrix(blobs: list[bytes], d: int) -> np.ndarray:
    """Packed vectors as rows of doubles, filled up with zeros to d columns."""
    out = np.zeros((len(blobs), d))
    full = np.array([len(b) == 1 + d * b[0] for b in blobs], bool)
    for width in KINDS:
        at = np.flatnonzero(full & np.array([b[0] == width for b in blobs], bool))
        if len(at):
            raw = np.frombuffer(b"".join(blobs[i][1:] for i in at.tolist()), KINDS[width])
            out[at] = raw.reshape(len(at), d)
    for i in np.flatnonzero(~full).tolist():
        row = np.frombuffer(blobs[i], KINDS[blobs[i][0]], offset=1)
        out[i, : len(row)] = row
    return out


def integers(m: np.ndarray) -> np.ndarray:
    """Doubles that are whole numbers as Python's own, exact at any size."""
    return np.array([[int(v) for v in row] for row in m.tolist()], dtype=object).reshape(m.shape)


def row_limit(d: int) -> int:
    return max(1, BLOCK_BYTES // (8 * max(1, d)))


def blocks(batches: Iterator[pa.RecordBatch], rows: int) -> Iterator[pa.Table]:
    """A task's rows in tables of about so many."""
    held, n = [], 0
    for b in batches:
        for at in range(0, b.num_rows, rows):
            held.append(b.slice(at, rows))
            n += held[-1].num_rows
            if n >= rows:
                yield pa.Table.from_batches(held)
                held, n = [], 0
    if n:
        yield pa.Table.from_batches(held)


def part() -> int:
    """The part that this task's result is added up in first."""
    context = TaskContext.get()
    return context.partitionId() % PARTS if context else 0


def reduced(partial: DataFrame, by: list[str], schema: str, add: Callable[[pa.Table], pa.Table]) -> DataFrame:
    """The partial results added up by the columns in by: first within PARTS parts of the tasks (column part), then over them."""
    names = [c.split()[0] for c in schema.split(", ")]
    first = partial.groupBy(*by, "part").applyInArrow(lambda t: add(t).append_column("part", pa.array([t.column("part")[0].as_py()], pa.int32())).select([*names, "part"]), schema + ", part int")
    return first.groupBy(*by).applyInArrow(lambda t: add(t).select(names), schema)


def added_floats(partial: DataFrame) -> np.ndarray | None:
    """The sum of arrays of doubles, as (part int, blob binary) of many tasks; None if there are none."""

    def add(t: pa.Table) -> pa.Table:
        total = np.sum([np.frombuffer(x, np.float64) for x in t.column("blob").to_pylist()], axis=0)
        return pa.table({"one": pa.array([1], pa.int32()), "blob": pa.array([total.tobytes()], pa.binary())})

    got = reduced(partial.withColumn("one", F.lit(1)), ["one"], "one int, blob binary", add).collect()  # one row
    return np.frombuffer(got[0]["blob"], np.float64) if got else None
