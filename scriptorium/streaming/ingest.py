"""Streams: uploads as they arrive, and a worker's rounds per micro-batch."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from scriptorium.operators import jobs as J
from scriptorium.operators import tables
from scriptorium.sources.store import Store


def arrivals(spark: SparkSession, folder: str, schema: str | StructType, per_batch: int = 100) -> DataFrame:
    """New files of a folder as a stream of rows; the schema is given, nothing is inferred."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", per_batch).parquet(folder)


def counts_by_window(events: DataFrame, time: str, kind: str, width: str = "1 day", late: str = "2 days") -> DataFrame:
    """Counts per window and kind; rows later than the watermark are dropped, which bounds the state."""
    windows = events.withWatermark(time, late).groupBy(F.window(time, width).alias("w"), kind)
    return windows.agg(F.count(F.lit(1)).alias("n")).select(F.col("w.start").alias("start"), kind, "n")


def enqueue_batch(store: Store, mark: str, worker: str, now: Callable[[], object], key: str = "job_id") -> Callable[[DataFrame, int], None]:
    """What happens to a batch: its jobs are added once, then the worker makes a round; only new and changed rows are written.

    The number of the batch is part of the commit: a batch that is delivered again neither adds jobs nor leases any.
    """

    def batch(new: DataFrame, number: int) -> None:
        last = store.mark(mark)
        if last is not None and number <= last:
            return
        jobs = store.read("jobs") if store.version("jobs") else new.limit(0)
        after = J.tick(tables.insert_or_ignore(jobs, new, [key]), worker, now())
        store.append("jobs", after.subtract(jobs.select(*after.columns)), key, {mark: number})

    return batch


def enqueue(stream: DataFrame, store: Store, checkpoint: str, worker: str, now: Callable[[], object], key: str = "job_id") -> StreamingQuery:
    """Jobs that arrive are added to the queue, batch by batch; batches are numbered per checkpoint folder."""
    batch = enqueue_batch(store, f"enqueue:{checkpoint}", worker, now, key)
    return stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
