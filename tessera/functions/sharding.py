"""Shards of objects by size, as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Sizes in bytes below which an object belongs to shard 0, 1 and 2.
SHARD_BOUNDS = (2048, 16385, 4 * 1024 * 1024 + 1)


def default_shard(object_id: Column, size: Column) -> Column:
    return F.when(size < SHARD_BOUNDS[0], 0).when(size < SHARD_BOUNDS[1], 1).when(size < SHARD_BOUNDS[2], 2).otherwise(3).cast("smallint")


def pow2_shard(object_id: Column, size: Column) -> Column:
    """Power-of-two size class: the exponent of the least power of two that isn't smaller; no logarithm, so no rounding."""
    return F.when(size <= 1, 0).otherwise(F.length(F.bin(size - 1))).cast("smallint")


def shard_of(object_id: Column, size: Column, is_delete: Column, partition_function=default_shard) -> Column:
    """Tombstones go to shard 0."""
    return F.when(is_delete, F.lit(0)).otherwise(partition_function(object_id, size)).cast("smallint")
