"""Watching traced runs, and the incremental record sink."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter, StreamingQuery
from pyspark.sql.types import LongType, StructField, StructType

from dialoscope.operators.browse import since_filter
from dialoscope.streaming.frames import use_rocksdb

POLL_SECONDS = 300  # fixed value: default time between polls


def watch_runs(runs: DataFrame, since: str | None = None, delay: str = "7 days", key: str = "run_id") -> DataFrame:
    """Each run id once, in whatever order runs arrive.

    Ids are remembered for ``delay`` after their arrival, which bounds the state:
    the watermark follows the time of arrival, never the start time of a run, so
    no run is late.  A run that comes again after ``delay`` is passed on again;
    ``watch`` remembers all ids.
    """
    rows = runs if since is None else since_filter(runs, since)
    timed = rows.withColumn("start_time", F.col("start_time").cast("timestamp")).withColumn("__arrived", F.current_timestamp())
    return timed.withWatermark("__arrived", delay).dropDuplicatesWithinWatermark([key]).drop("__arrived")


def watch(runs: DataFrame, checkpoint: str, on_poll: Callable[[DataFrame, int], None], since: str | None = None,
          seconds: int | None = POLL_SECONDS, key: str = "run_id") -> StreamingQuery:
    """Start polling: ``on_poll(new_runs, poll_number)`` for every batch.

    ``seconds=None`` takes what is there and stops.  The ids passed on are kept in the
    state store for good, dealt by the key's hash: a poll looks its own ids up there,
    each behind the store's Bloom filters, and uploads its own changes only, so its work
    follows the batch and not the history.  Every run comes once, however late, and
    a restarted watch goes on where it stopped.  A poll that fails is repeated as a whole.
    """
    use_rocksdb(runs.sparkSession)
    rows = runs if since is None else since_filter(runs, since)

    def poll(batch: DataFrame, number: int) -> None:
        new = batch.persist()
        try:
            on_poll(new, number)
        finally:
            new.unpersist()

    writer = rows.dropDuplicates([key]).writeStream.option("checkpointLocation", checkpoint).foreachBatch(poll)
    return _started(writer, seconds)


def _started(writer: DataStreamWriter, seconds: int | None) -> StreamingQuery:
    writer = writer.trigger(availableNow=True) if seconds is None else writer.trigger(processingTime=f"{seconds} seconds")
    return writer.start()


def poll_summary(batch: DataFrame, poll: int) -> DataFrame:
    """New runs of a poll per run type."""
    return batch.groupBy("run_type").agg(F.count("*").alias("new_runs")).withColumn("poll", F.lit(poll))


def stream_records(records: DataFrame, path: str, checkpoint: str, seconds: int | None = None,
                   partitions: tuple[str, ...] = ()) -> StreamingQuery:
    """Append a record stream as Parquet; readable while it runs, resumed from the checkpoint, no row twice."""
    writer = (records.writeStream.format("parquet").outputMode("append").option("path", path)
              .option("checkpointLocation", checkpoint))
    if partitions:
        writer = writer.partitionBy(*partitions)
    return _started(writer, seconds)


def stream_batches(records: DataFrame, path: str, checkpoint: str, seconds: int | None = None,
                   written: Callable[[DataFrame, int], None] | None = None) -> StreamingQuery:
    """Write a record stream as Parquet, one folder ``batch=<number>`` a micro-batch; read it with ``read_batches``.

    ``written`` sees what a batch has written before the batch is committed, be it to
    publish counts or to check them.  A job that ends between write and commit repeats
    the batch, whose folder is replaced as a whole: rows come neither twice nor never,
    and what the failed attempt left is gone.
    """

    def write(batch: DataFrame, number: int) -> None:
        folder = f"{path.rstrip('/')}/batch={number}"
        batch.write.mode("overwrite").parquet(folder)
        if written is not None:
            written(batch.sparkSession.read.schema(batch.schema).parquet(folder), number)

    return _started(records.writeStream.option("checkpointLocation", checkpoint).foreachBatch(write), seconds)


def read_batches(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    """The rows that ``stream_batches`` has written so far, with the number of their batch."""
    return spark.read.schema(StructType([*schema.fields, StructField("batch", LongType())])).parquet(path)
