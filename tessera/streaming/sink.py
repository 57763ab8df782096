"""A foreachBatch sink: each micro-batch is one commit, named by the query and the batch's number,
so that a micro-batch that runs again after a failure commits nothing twice."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..heap import Heap
from ..sources.staging import shared_dir


def heap_sink(heap: Heap, name: str):
    """For writeStream.foreachBatch: rows (object_id, payload[, seq])."""

    def write(batch: DataFrame, number: int) -> None:
        heap.write_batch(batch, txn=(name, number))

    return write


def ingest_events(spark: SparkSession, sf_dir: str) -> Heap:
    """All of the events table, as a stream of files, into a new heap in the shared folder."""
    root = f"{shared_dir(spark)}/heap-{uuid.uuid4().hex}"
    heap = Heap.open(spark, f"{root}/heap")
    path = f"{sf_dir}/events.parquet"
    schema = spark.read.parquet(path).schema
    events = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(sf_dir)
    rows = events.select(F.col("user_id").alias("object_id"), F.when(F.col("event_type") != "error", F.col("props")).cast("binary").alias("payload"), F.col("event_id").alias("seq"))
    q = rows.writeStream.foreachBatch(heap_sink(heap, "events")).option("checkpointLocation", f"{root}/checkpoint").trigger(availableNow=True).start()
    q.awaitTermination()
    return heap
