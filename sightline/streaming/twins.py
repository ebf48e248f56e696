"""Streaming forms of batch operators: the same rows once the stream has passed the watermark."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def stream_of(spark: SparkSession, folder: str, schema, files_per_trigger: int = 1) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(folder)


def session_runs(stream: DataFrame, key: str, ts: str, gap: str, late: str, least: int = 2) -> DataFrame:
    """Runs of events per key that no gap of that length interrupts; ts may have no time zone."""
    timed = stream.withColumn("_ts", F.col(ts).cast("timestamp")).withWatermark("_ts", late)
    runs = timed.groupBy(key, F.session_window("_ts", gap).alias("s")).agg(F.min("_ts").alias("first"), F.max("_ts").alias("last"), F.count("*").alias("hits"))
    return runs.filter(F.col("hits") >= least).select(key, "first", "last", "hits")


def deduplicated(stream: DataFrame, key: list[str], ts: str, late: str) -> DataFrame:
    """The first event of each key within the watermark."""
    return stream.withColumn("_ts", F.col(ts).cast("timestamp")).withWatermark("_ts", late).dropDuplicatesWithinWatermark(key)


def drained(stream: DataFrame, name: str, checkpoint: str, mode: str = "append") -> DataFrame:
    """Runs a stream over what is there now and gives what it wrote; for tests and back-fills."""
    q = stream.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    q.awaitTermination()
    return stream.sparkSession.table(name)
