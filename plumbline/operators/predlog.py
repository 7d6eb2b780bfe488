"""The prediction log: pages, retention, summaries; stored in segments that are only ever added or dropped whole.

A segment's folder is named by its first and last id and the batch it came from, and holds files of ROWS_A_FILE ids each,
named by their place. So where an id or the newest rows lie is told by names alone: an append reads and rewrites nothing
old, a look-up reads one file, and retention deletes folders. A batch that was appended before is not appended again.
"""

from __future__ import annotations

import hashlib
import re
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from plumbline.tables import in_order, removed

#: Ids in one file of a segment.
ROWS_A_FILE = 1 << 18
MOST_ROWS, PAGE, MOST_PAGE = 500, 50, 200
SCHEMA = "id long, created_utc timestamp, model_name string, model_legacy boolean, predicted_label string, probability_positive double, confidence double, confidence_band string, threshold double, original_filename string, image_width int, image_height int, inference_ms double, had_explanation boolean, thumbnail_jpeg binary, extra_json string"
PAGE_COLUMNS = [c.split()[0] for c in SCHEMA.split(", ") if c.split()[0] not in ("thumbnail_jpeg", "extra_json")]


def page(log: DataFrame, limit: int = PAGE, offset: int = 0, order: str = "id") -> DataFrame:
    """The newest rows, at most MOST_PAGE; only the columns of a page are read. A negative limit counts as 0."""
    columns = [c for c in PAGE_COLUMNS if c in log.columns] or log.columns
    return log.select(columns).orderBy(F.desc(order)).offset(max(0, offset)).limit(max(0, min(limit, MOST_PAGE)))


def thumbnail(log: DataFrame, row_id: int) -> DataFrame:
    return log.where(F.col("id") == row_id).select("thumbnail_jpeg")


def retained(log: DataFrame, most_rows: int = MOST_ROWS, order: str = "id") -> DataFrame:
    """The newest most_rows rows. Ids are ranked after a top-k, so no window spans the log."""
    newest = log.select(order).orderBy(F.desc(order)).limit(most_rows).agg(F.min(order).alias("least"), F.lit(1).alias("one"))
    return log.withColumn("one", F.lit(1)).join(F.broadcast(newest), "one").where(F.col(order) >= F.col("least")).drop("one", "least")  # newest is one row


def appended(log: DataFrame, rows: DataFrame, most_rows: int = MOST_ROWS) -> DataFrame:
    """The log with rows (without id) added in created_utc order under rising ids, then cut to the newest."""
    last = log.agg(F.coalesce(F.max("id"), F.lit(0)).alias("last"), F.lit(1).alias("one"))
    newest = rows.orderBy(F.desc("created_utc")).limit(most_rows)  # more could not stay
    place = F.row_number().over(Window.orderBy("created_utc"))
    skipped = F.lit(rows.count() - newest.count())
    fresh = newest.withColumn("place", place).withColumn("one", F.lit(1)).join(F.broadcast(last), "one").withColumn("id", F.col("last") + skipped + F.col("place")).drop("one", "last", "place")
    return retained(log.unionByName(fresh.select(log.columns)), most_rows)


@dataclass(frozen=True)
class Segment:
    """Ids from first to last in one folder, from one batch."""

    path: str
    first: int
    last: int
    batch: str

    def file(self, row_id: int) -> str:
        """The folder of the one file that may hold the id."""
        return f"{self.path}/place={(row_id - self.first) // ROWS_A_FILE}"


class Log:
    """A log below a folder, with at most most_rows rows. One writer at a time; any number may read."""

    def __init__(self, spark: SparkSession, path: str, most_rows: int = MOST_ROWS):
        self.spark, self.path, self.most_rows = spark, path.rstrip("/"), most_rows
        self.place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
        self.files = self.place(self.path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def segments(self) -> list[Segment]:
        """All segments, the oldest first, from one listing; unfinished ones have other names."""
        if not self.files.exists(self.place(self.path)):
            return []
        found = []
        for status in self.files.listStatus(self.place(self.path)):
            if m := re.fullmatch(r"segment=(\d+)-(\d+)-([0-9a-f]+)", status.getPath().getName()):
                found.append(Segment(f"{self.path}/{m[0]}", int(m[1]), int(m[2]), m[3]))
        return sorted(found, key=lambda s: s.first)

    def _read(self, paths: list[str]) -> DataFrame:
        if not paths:
            return self.spark.createDataFrame([], SCHEMA)
        rows = self.spark.read.schema(f"{SCHEMA}, segment string, place int").option("basePath", self.path).parquet(*paths)
        return rows.drop("segment", "place")

    def append(self, rows: DataFrame, batch: str) -> int:
        """Add rows (the log's columns without id) under rising ids in created_utc order, ties in any fixed order; drop what
        retention no longer keeps. Returns how many were added: 0 if the batch was there, or nothing is in it.

        The rows are sorted over the cluster and written beside the log; renaming their folder adds them, so a failed append
        leaves the log as it was and can be repeated. A batch that retention has dropped would be added again.
        """
        name = hashlib.sha256(batch.encode()).hexdigest()[:32]
        held = self.segments()
        if any(s.batch == name for s in held):
            return 0
        start = max((s.last for s in held), default=0) + 1
        columns = [c.split()[0] for c in SCHEMA.split(", ")]
        whole = rows.select(*(F.col(c).cast(t).alias(c) if c in rows.columns else F.lit(None).cast(t).alias(c) for c, t in (x.split() for x in SCHEMA.split(", ") if not x.startswith("id "))))
        # rows that nothing tells apart may take any order among themselves
        placed = in_order(whole, ["created_utc", *(c for c in PAGE_COLUMNS if c not in ("id", "created_utc"))], "at").withColumn("id", F.col("at") + start)
        made = f"{self.path}/_unfinished-{name}"
        dealt = placed.withColumn("place", F.floor(F.col("at") / ROWS_A_FILE)).repartition("place").sortWithinPartitions("id")
        dealt.select(*columns, "place").write.partitionBy("place").mode("overwrite").parquet(made)
        n = self.spark.read.parquet(made).count() if any("place=" in s.getPath().getName() for s in self.files.listStatus(self.place(made))) else 0
        if n:
            self.files.rename(self.place(made), self.place(f"{self.path}/segment={start:019d}-{start + n - 1:019d}-{name}"))
            self.retain()
        else:
            removed(self.spark, made)
        return n

    def retain(self) -> int:
        """Delete segments without any of the newest most_rows ids; how many they were."""
        held = self.segments()
        old = [s for s in held if s.last <= held[-1].last - self.most_rows]
        for s in old:
            removed(self.spark, s.path)
        return len(old)

    def rows(self) -> DataFrame:
        """The newest most_rows rows; older ones of a segment that is kept for its newer ones are filtered out by id."""
        held = self.segments()
        least = held[-1].last - self.most_rows + 1 if held else 0
        return self._read([s.path for s in held if s.last >= least]).where(F.col("id") >= least)

    def page(self, limit: int = PAGE, offset: int = 0) -> DataFrame:
        """page() of the log, read from the newest segments that hold it. A negative offset counts as 0."""
        limit, offset = max(0, min(limit, MOST_PAGE)), max(0, offset)
        held = self.segments()
        upto = held[-1].last - offset if held else 0
        least = max(upto - limit, held[-1].last - self.most_rows if held else 0) + 1
        some = [s for s in held if s.first <= upto and s.last >= least]
        return self._read([s.path for s in some]).where(F.col("id").between(least, upto)).select(PAGE_COLUMNS).orderBy(F.desc("id"))

    def row(self, row_id: int) -> DataFrame:
        """The row of that id, or none, from the one file that may hold it."""
        held = self.segments()
        least = held[-1].last - self.most_rows + 1 if held else 0
        at = [s.file(row_id) for s in held if max(s.first, least) <= row_id <= s.last]
        return self._read(at).where(F.col("id") == row_id)

    def clear(self) -> int:
        """Drop everything and say how many rows the log had. Ids start again from 1."""
        held = self.segments()
        for s in held:
            removed(self.spark, s.path)
        return min(self.most_rows, sum(s.last - s.first + 1 for s in held))


def summary(log: DataFrame, label: str = "predicted_label", band: str = "confidence_band", ms: str = "inference_ms") -> DataFrame:
    """(kind, value, n, mean_ms): the total with its mean latency, and counts by label and by band, in one pass."""
    sets = log.groupingSets([[], [label], [band]], label, band).agg(F.count("*").alias("n"), F.round(F.avg(ms), 2).alias("mean_ms"), F.grouping_id().alias("g"))
    kind = F.when(F.col("g") == 3, "total").when(F.col("g") == 1, "label").otherwise("band")
    value = F.when(F.col("g") == 1, F.col(label)).when(F.col("g") == 2, F.col(band))
    return sets.select(kind.alias("kind"), value.alias("value"), "n", F.when(F.col("g") == 3, F.col("mean_ms")).alias("mean_ms"))


def latency(log: DataFrame, ms: str = "inference_ms") -> DataFrame:
    """(n, mean_ms): rounded to 2 digits; null if it is 0 or nothing was measured."""
    mean = F.round(F.avg(ms), 2)
    return log.agg(F.count("*").alias("n"), F.when(mean != 0, mean).alias("mean_ms"))
