"""Sessions and tables: settings the plans rely on, and tables cut loose from their lineage."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def session(app: str = "plumbline", **conf: str) -> SparkSession:
    """A session with UTC times, ANSI arithmetic and adaptive execution; conf adds or overrides."""
    settings = {"spark.sql.session.timeZone": "UTC", "spark.sql.ansi.enabled": "true", "spark.sql.adaptive.enabled": "true", "spark.sql.adaptive.skewJoin.enabled": "true"} | conf
    return SparkSession.builder.appName(app).config(map=settings).getOrCreate()


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share (spark.checkpoint.dir); a temporary one only where none is set and Spark
    runs in one process. On a cluster it must be set, as executors would write to their own disks."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        own = spark.sparkContext._jsc.sc().getCheckpointDir()
        if not own.isDefined():
            if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
                raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
            spark.sparkContext.setCheckpointDir("file://" + tempfile.mkdtemp(prefix="plumbline-"))
            own = spark.sparkContext._jsc.sc().getCheckpointDir()
        folder = own.get()
    return folder.rstrip("/")


#: Places of the tables that this process has begun, in order.
_begun: list[str] = []


def new_path(spark: SparkSession, name: str) -> str:
    """Where a new table in the shared folder may lie."""
    _begun.append(f"{shared_folder(spark)}/plumbline/{name}-{uuid.uuid4().hex}")
    return _begun[-1]


def begun() -> int:
    """How many tables this process has begun, to be told to removed_since()."""
    return len(_begun)


def removed_since(spark: SparkSession, mark: int, keep: str) -> None:
    """Delete the tables begun since then but for one, once nothing lazy reads them any more."""
    for path in _begun[mark:]:
        if path != keep:
            removed(spark, path)
    _begun[mark:] = [keep]


def written(df: DataFrame, name: str, path: str | None = None) -> DataFrame:
    """df as a Parquet table in the shared folder: computed once, and still there if executors are lost."""
    path = path or new_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def removed(spark: SparkSession, path: str) -> None:
    """Delete a table that nothing will read again."""
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(place, True)


def in_order(df: DataFrame, by: list[str], name: str = "idx") -> DataFrame:
    """df with name: each row's place, from 0, in the order of the columns in by.

    Rows are sorted by range over the cluster and written; places follow from how many rows each part holds, so no window
    spans all rows.
    """
    sorted_rows = written(df.orderBy(*by).withColumn("__id", F.monotonically_increasing_id()), "ordered")
    part = F.shiftright("__id", 33)
    counts = sorted_rows.groupBy(part.alias("__part")).agg(F.count("*").alias("n"))
    before = F.coalesce(F.sum("n").over(Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = counts.select("__part", before.alias("__start"))  # a row a part
    placed = sorted_rows.withColumn("__part", part).join(F.broadcast(starts), "__part")
    return placed.withColumn(name, F.col("__start") + F.col("__id") - F.shiftleft("__part", 33)).drop("__id", "__part", "__start")


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
