"""Structured Streaming forms: weekly counts by event time, and exactly-once upserts by key."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from castweave.runtime import ensure_checkpoint_dir
from castweave.sources.feeds import latest_by_key


def weekly_counts(events: DataFrame, time: str, key: str, watermark: str = "14 days") -> DataFrame:
    """Events per Monday-based week and ``key`` of a stream; later ones than the watermark are dropped."""
    stamped = events.withColumn("_t", F.col(time).cast("timestamp")).withWatermark("_t", watermark)
    return stamped.groupBy(F.window("_t", "7 days", startTime="4 days").alias("w"), key).agg(F.count(F.lit(1)).alias("events"))


def first_by_key(events: DataFrame, time: str, keys: list[str], watermark: str = "14 days") -> DataFrame:
    """Each key once per watermark span: redelivered events are ignored."""
    return events.withColumn("_t", F.col(time).cast("timestamp")).withWatermark("_t", watermark).dropDuplicatesWithinWatermark(keys)


def run_once(spark: SparkSession, folder: str, file_glob: str, build, keys: list[str], files_per_batch: int | None = None) -> DataFrame:
    """Read all files of ``folder`` as a stream, apply ``build`` and return what the sink holds at the end.

    The sink is upserted by ``keys``: every batch writes its updates under its number, once however often it is
    retried, and of each key the row of the last batch counts. State and output lie in the shared checkpoint folder.
    """
    ensure_checkpoint_dir(spark)
    base = f"{spark.sparkContext._jsc.sc().getCheckpointDir().get()}/stream-{uuid.uuid4().hex}"
    schema = spark.read.parquet(f"{folder}/{file_glob}").schema
    reader = spark.readStream.schema(schema).option("pathGlobFilter", file_glob)
    stream = (reader.option("maxFilesPerTrigger", files_per_batch) if files_per_batch else reader).parquet(folder)
    out: DataFrame = build(stream)

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{base}/out/batch={number}")

    query = (
        out.writeStream.outputMode("update").foreachBatch(write).option("checkpointLocation", f"{base}/state")
        .trigger(availableNow=True).start()
    )
    query.awaitTermination()
    updates = spark.read.parquet(f"{base}/out")
    return latest_by_key(updates, keys, [F.col("batch")]).drop("batch")
