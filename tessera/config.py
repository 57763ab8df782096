"""Settings of a heap."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column

from .functions.sharding import default_shard

#: The JVM holds one binary value in an array, which bounds an object's size.
LARGEST_OBJECT = 2**31 - 1 - 64


@dataclass(frozen=True)
class HeapConfig:
    """target_file_size bounds rewritten files; files under file_compaction_percent live, or small
    ones once small_file_cleanup_threshold files exist, are rewritten, min_compaction_files at least
    at a time; partition_function(object id, size) gives a rewritten object's shard."""

    path: str = ""
    target_file_size: int = 1 << 28
    file_compaction_percent: int = 66
    max_object_size: int = 16 << 30
    small_file_cleanup_threshold: int = 64
    min_compaction_files: int = 2
    partition_function: Callable[[Column, Column], Column] = field(default=default_shard)
    fsync_each_batch: bool = False
    zstd_compression_level: int | None = None

    def __post_init__(self) -> None:
        if self.target_file_size <= 0:
            raise ValueError("target_file_size must be positive")
        if not 0 <= self.file_compaction_percent <= 99:
            raise ValueError("file_compaction_percent must be from 0 to 99")

    @property
    def object_limit(self) -> int:
        return min(self.max_object_size, LARGEST_OBJECT)

    def open(self, spark):
        from .heap import Heap

        return Heap(spark, self)
