"""The prediction log as a stream: windowed counts with late data, and a bounded newest-rows table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from plumbline.operators.predlog import Log, retained


def windowed_summary(events: DataFrame, ts: str = "ts", label: str = "event_type", value: str = "value", every: str = "1 day", late: str = "1 day") -> DataFrame:
    """(window_start, label, n, mean_value) per window; rows later than the watermark are dropped by the stream."""
    w = events.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, late).groupBy(F.window(ts, every).alias("w"), F.col(label).alias("label"))
    return w.agg(F.count("*").alias("n"), F.avg(value).alias("mean_value")).select(F.col("w.start").alias("window_start"), "label", "n", "mean_value")


def keep_newest(events: DataFrame, path: str, checkpoint: str, most_rows: int = 500, order: str = "event_id") -> StreamingQuery:
    """Write each batch's newest rows and keep the newest of all, in two alternating folders so a failed batch can rerun."""

    def step(batch: DataFrame, no: int) -> None:
        spark = batch.sparkSession
        held = batch
        if no:
            held = spark.read.schema(batch.schema).parquet(f"{path}/{(no - 1) % 2}").unionByName(batch)
        retained(held, most_rows, order).write.mode("overwrite").parquet(f"{path}/{no % 2}")

    return events.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def append_stream(rows: DataFrame, log: Log, checkpoint: str) -> StreamingQuery:
    """Append each batch of a stream of log rows; a batch that runs again after a failure is not added twice."""
    return rows.writeStream.foreachBatch(lambda batch, no: log.append(batch, f"{checkpoint}:{no}")).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
