"""Latest versions, batches and previous values."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.ids import order_key
from .ordered import last_up_to


def batch_dedup(op_log: DataFrame) -> DataFrame:
    """Of a batch's operations on an object the last (by seq) counts. Partial aggregation precedes the shuffle."""
    rest = [c for c in op_log.columns if c not in ("batch_no", "object_id")]
    newest = op_log.groupBy("batch_no", "object_id").agg(F.max_by(F.struct(*rest), "seq").alias("v"))
    return newest.select("batch_no", "object_id", *[F.col(f"v.{c}").alias(c) for c in rest])


def current(entries: DataFrame, version: str = "batch_no") -> DataFrame:
    """The newest version of each object, tombstones included."""
    rest = [c for c in entries.columns if c not in ("object_id", version)]
    newest = entries.groupBy("object_id").agg(F.max_by(F.struct(version, *rest), version).alias("v"))
    return newest.select("object_id", F.col(f"v.{version}").alias(version), *[F.col(f"v.{c}").alias(c) for c in rest])


def read_all(latest: DataFrame) -> DataFrame:
    """Readable objects: what isn't deleted."""
    return latest.where(~F.col("is_delete"))


def read_many(latest: DataFrame, ids: DataFrame) -> DataFrame:
    """ids with their payloads; null for unknown and for deleted objects alike."""
    return ids.join(read_all(latest).select("object_id", "payload"), "object_id", "left")


def previous_values(entries: DataFrame, version: str = "batch_no") -> DataFrame:
    """Each write with the object's payload before it, null for absent and deleted alike."""
    w = Window.partitionBy("object_id").orderBy(version)
    return entries.select("object_id", version, "payload", F.lag("payload").over(w).alias("previous"))


def free_ranges(latest: DataFrame) -> DataFrame:
    """(first, last), both included, of the unsigned ids from 0 to the largest that no version has.

    Gaps are found between neighbours in the unsigned order. An empty heap has the gap 0 to 0.
    """
    ids = latest.select(order_key(F.col("object_id")).alias("at")).distinct()
    if ids.isEmpty():
        return latest.sparkSession.range(1).select(F.lit(0).cast("long").alias("first"), F.lit(0).cast("long").alias("last"))
    # Sums are of order keys, where the last id has no successor, so that none overflows.
    zero = order_key(F.lit(0).cast("long"))
    first = F.when(F.col("before").isNull(), zero).otherwise(F.col("before") + 1)
    gaps = last_up_to(ids, ["at"], "at", "before", before=True).where(F.col("at") > first)
    return gaps.select(order_key(first).alias("first"), order_key(F.col("at") - 1).alias("last"))


def free_ids(latest: DataFrame) -> DataFrame:
    """The ids of free_ranges(), one by one, made of sixteen bits at a time. Blocks of 65,536 are dealt
    to all tasks before their ids are made. Where ids are far apart, free_ranges() says the same in few rows."""
    digit = lambda c, shift: F.shiftrightunsigned(c, shift).bitwiseAND(F.lit(0xFFFF))
    out = free_ranges(latest).select("first", "last", F.lit(0).cast("long").alias("object_id"), F.lit(True).alias("at_first"), F.lit(True).alias("at_last"))
    for shift in (48, 32, 16, 0):
        low = F.when(F.col("at_first"), digit("first", shift)).otherwise(F.lit(0))
        high = F.when(F.col("at_last"), digit("last", shift)).otherwise(F.lit(0xFFFF))
        out = (out if shift else out.repartition("object_id")).select("*", F.explode(F.sequence(low, high)).alias("d"))
        out = out.select(
            "first", "last", F.col("object_id").bitwiseOR(F.shiftleft("d", shift)).alias("object_id"),
            (F.col("at_first") & (F.col("d") == digit("first", shift))).alias("at_first"), (F.col("at_last") & (F.col("d") == digit("last", shift))).alias("at_last"),
        )
    return out.select("object_id")


def next_object_id(latest: DataFrame) -> DataFrame:
    """The id after the largest in the unsigned order, as bits; 1 for an empty heap, null if the largest id is taken."""
    largest = F.max(order_key(F.col("object_id")))
    return latest.agg(F.when(F.count("*") == 0, F.lit(1).cast("long")).otherwise(order_key(F.nullif(largest, F.lit((1 << 63) - 1)) + 1)).alias("next_object_id"))
