"""A deterministic operation log from the events table, one batch for each hundred events, and heaps that store it."""

from __future__ import annotations

import uuid
from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import HeapConfig
from ..heap import Heap
from ..operators import files, versions
from ..sources.staging import shared_dir


def op_log(events: DataFrame) -> DataFrame:
    gone = F.col("event_type") == "error"
    return events.select(
        F.floor(F.col("event_id") / 100).cast("long").alias("batch_no"), F.col("user_id").alias("object_id"), F.col("event_id").alias("seq"), gone.alias("is_delete"),
        F.when(~gone, F.col("props")).alias("payload"), F.when(gone, F.lit(0)).otherwise(F.octet_length("props")).cast("long").alias("size"),
    )


#: Heaps by application, tables and whether they are compacted; each is loaded once.
_HEAPS: dict[tuple[str, str, bool], Heap] = {}


def stored(spark: SparkSession, sf_dir: str, compacted: bool = False) -> Heap:
    """The log in a heap in the shared folder: the first batch, those up to the last, and the last are a version each.

    A compacted one has been through maintenance that counts every file as one of too many.
    """
    key = (spark.sparkContext.applicationId, sf_dir, compacted)
    if key not in _HEAPS:
        config = HeapConfig(path=f"{shared_dir(spark)}/heap-{uuid.uuid4().hex}", small_file_cleanup_threshold=1 if compacted else HeapConfig.small_file_cleanup_threshold)
        heap, log = config.open(spark), op_log(spark.read.parquet(f"{sf_dir}/events.parquet"))
        last = log.agg(F.max("batch_no")).first()[0] or 0
        for low, high in ((0, 0), (1, last - 1), (max(last, 1), last)):
            heap.write_log(log.where(F.col("batch_no").between(low, high)))
        if compacted:
            heap.maintenance()
        _HEAPS[key] = heap
    return _HEAPS[key]


def batch_of(file_id: str = "file_id") -> Column:
    """The batch that a stored file is."""
    return F.regexp_extract(file_id, r"batch_no=(\d+)", 1).cast("long")


@dataclass
class Workload:
    spark: SparkSession
    sf_dir: str

    @property
    def heap(self) -> Heap:
        return stored(self.spark, self.sf_dir)

    @property
    def compacted(self) -> Heap:
        return stored(self.spark, self.sf_dir, compacted=True)

    @cached_property
    def log(self) -> DataFrame:
        return op_log(self.spark.read.parquet(f"{self.sf_dir}/events.parquet"))

    @cached_property
    def entries(self) -> DataFrame:
        return versions.batch_dedup(self.log)

    @cached_property
    def current(self) -> DataFrame:
        return versions.current(self.entries)

    @cached_property
    def files(self) -> DataFrame:
        return files.catalog(self.entries)

    def documents(self) -> DataFrame:
        d = self.spark.read.parquet(f"{self.sf_dir}/documents.parquet")
        return d.select(F.col("doc_id").alias("object_id"), F.octet_length("text").cast("long").alias("size"), F.lit(False).alias("is_delete"))
