"""Structured Streaming over events and changes: beyond parity, for continuous use of the same operators."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from weftline.runtime import shared_dir


def windowed_counts(events: DataFrame, time: str, key: str, width: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """(start, key, n, total) of tumbling windows of a stream or a table; rows later than `late` behind the newest are dropped by a stream."""
    w = events.withWatermark(time, late).groupBy(F.window(time, width), key)
    return w.agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(F.col("window.start").alias("start"), key, "n", "total")


def deduplicated(changes: DataFrame, keys: list[str], time: str, late: str = "1 day") -> DataFrame:
    """Changes of a stream once each within the watermark: incremental load without loading twice."""
    return changes.withWatermark(time, late).dropDuplicatesWithinWatermark(keys)


def file_stream(spark: SparkSession, folder: str, schema, files_per_batch: int = 16) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(folder)


def run_to_table(df: DataFrame, name: str, mode: str = "append") -> str:
    """Runs a stream over what is there now into Parquet in the shared folder, with its checkpoint beside it; the folder written."""
    base = f"{shared_dir(df.sparkSession).rstrip('/')}/weftline-streams/{name}-{uuid.uuid4().hex[:10]}"
    q: StreamingQuery = df.writeStream.outputMode(mode).format("parquet").option("path", f"{base}/out").option("checkpointLocation", f"{base}/state").trigger(availableNow=True).start()
    q.awaitTermination()
    return f"{base}/out"


def run_complete(df: DataFrame, name: str) -> str:
    """Runs an aggregated stream over what is there now; every batch replaces the result's table, so a repeated batch does no harm."""
    base = f"{shared_dir(df.sparkSession).rstrip('/')}/weftline-streams/{name}-{uuid.uuid4().hex[:10]}"

    def write(batch: DataFrame, _: int) -> None:
        batch.write.mode("overwrite").parquet(f"{base}/out")

    q = df.writeStream.outputMode("complete").foreachBatch(write).option("checkpointLocation", f"{base}/state").trigger(availableNow=True).start()
    q.awaitTermination()
    return f"{base}/out"


def merge_counts(spark: SparkSession, totals: str, batch: DataFrame, keys: list[str], count: str) -> DataFrame:
    """A14's additive upsert without doubling on a repeated run: a batch's counts are written under its own number and totals are
    the sum over batches, so writing a batch again replaces it."""
    return spark.read.parquet(totals).unionByName(batch).groupBy(*keys).agg(F.sum(count).alias(count))
