"""What the corpus operators share: worker imports, tables cut loose from their lineage, Arrow batch access."""

from __future__ import annotations

import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.tables import written

__all__ = ["as_bytes", "data", "laid_out", "offsets", "slices", "use_workers", "written"]

ROOT = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


#: Rows that go to a Python worker at once: whole texts are long.
ROWS = 1000
#: Settings of workers' memory: arrays of a megabyte and more go back to the system when they are freed, so that a worker
#: that waits for its next task holds little.
WORKER_MEMORY = {"MALLOC_MMAP_THRESHOLD_": "1048576", "MALLOC_TRIM_THRESHOLD_": "1048576", "MALLOC_ARENA_MAX": "2", "ARROW_DEFAULT_MEMORY_POOL": "system"}


def use_workers(spark: SparkSession) -> None:
    """Let Python workers import this package where it is not installed but lies at the same path, and keep them small.

    This changes the session: the number of rows in an Arrow batch is lowered to ROWS if it is at its default, and workers'
    PYTHONPATH and WORKER_MEMORY are set, the latter where the user has not.
    """
    if spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch") == "10000":
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(ROWS))
    env = spark.sparkContext.environment
    for name, value in WORKER_MEMORY.items():
        env.setdefault(name, value)
    paths = [p for p in env.get("PYTHONPATH", "").split(os.pathsep) if p]
    if ROOT not in paths:
        env["PYTHONPATH"] = os.pathsep.join([*paths, ROOT])


def laid_out(df: DataFrame, keep: list[str], text: str) -> tuple[DataFrame, int]:
    """df with the columns in keep as k0, k1, ... and the text as a string, once if keep has it; and the text's place."""
    columns = [F.col(c).alias(f"k{i}") for i, c in enumerate(keep)]
    if text in keep and dict(df.dtypes)[text] == "string":
        return df.select(*columns), keep.index(text)
    return df.select(*columns, F.col(text).cast("string").alias("text")), len(keep)


def slices(batch: pa.RecordBatch, column: str | int, most: int = 1 << 20) -> Iterator[pa.RecordBatch]:
    """The batch in pieces whose column holds at most so many bytes, or one row."""
    size = np.diff(offsets(batch.column(column)))
    start = total = 0
    for i, n in enumerate(size.tolist()):
        if i > start and total + n > most:
            yield batch.slice(start, i - start)
            start, total = i, 0
        total += n
    if start < batch.num_rows:
        yield batch.slice(start)


def offsets(column: pa.Array) -> np.ndarray:
    """Offsets into the data buffer of a string or binary column."""
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    buf = column.buffers()[1]
    if buf is None or not len(column):
        return np.zeros(len(column) + 1, np.int64)
    raw = np.frombuffer(buf, np.int64 if wide else np.int32)
    return raw[column.offset : column.offset + len(column) + 1].astype(np.int64)


def data(column: pa.Array) -> np.ndarray:
    """The bytes of a string or binary column, as offsets() counts them."""
    buf = column.buffers()[2]
    return np.frombuffer(buf, np.uint8) if buf is not None else np.zeros(0, np.uint8)


def as_bytes(column: pa.Array) -> list[bytes | None]:
    """The values of a string column as UTF-8."""
    kind = pa.large_binary() if pa.types.is_large_string(column.type) else pa.binary()
    return column.cast(kind).to_pylist()
