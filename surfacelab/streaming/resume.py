"""Resumable scoring as a stream: new record files are scored once, in batches, and appended.

The checkpoint remembers which files are done, so a stopped run goes on where it was and a second
run does nothing. Rows that fail carry a status and an error instead of stopping the batch.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def score_stream(spark: SparkSession, source: str, schema, sink: str, checkpoint: str, score: Callable[[DataFrame], DataFrame], key: str, files_per_batch: int = 25) -> StreamingQuery:
    """Scores Parquet files of source that aren't scored yet and appends them to sink.

    Within a batch a key is scored once. A batch that is repeated after a failure overwrites its own
    folder, so a row is never appended twice.
    """
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(source)

    def append(batch: DataFrame, number: int) -> None:
        score(batch.dropDuplicates([key])).write.mode("overwrite").parquet(f"{sink}/batch={number}")

    return stream.writeStream.foreachBatch(append).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def with_status(rows: DataFrame, value: Column, name: str, rejected: Column) -> DataFrame:
    """rows with the value, status (scored, rejected_masked or failed) and error of each."""
    ok = value.isNotNull() & ~F.isnan(value)
    status = F.when(rejected, "rejected_masked").when(ok, "scored").otherwise("failed")
    return rows.withColumns({name: F.when(rejected, -1.0).otherwise(value), "status": status, "error": F.when(~rejected & ~F.coalesce(ok, F.lit(False)), F.lit("no finite value"))})


def windowed_counts(events: DataFrame, late: str = "1 hour", size: str = "1 hour") -> DataFrame:
    """Event counts and mean value in windows of event time; rows later than the watermark are left out."""
    timed = events.withColumn("at", F.col("ts").cast("timestamp")).withWatermark("at", late)
    return timed.groupBy(F.window("at", size).alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n"), F.avg("value").alias("mean")).select(F.col("w.start").alias("start"), "event_type", "n", "mean")
