"""Files: catalogue, liveness, statistics, compaction candidates, floor lookup."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import HeapConfig
from ..functions.records import ENTRY, TRAILER, record_bytes
from .ordered import last_up_to, sum_before


def located(entries: DataFrame) -> DataFrame:
    """Entries with rel_offset: objects lie in the order of their ids; tombstones take no room."""
    w = Window.partitionBy("batch_no").orderBy("object_id").rowsBetween(Window.unboundedPreceding, -1)
    room = record_bytes(F.col("size"), F.col("is_delete"))
    return entries.select("*", F.when(F.col("is_delete"), F.lit(0)).otherwise(F.coalesce(F.sum(room).over(w), F.lit(0))).cast("long").alias("rel_offset"))


def catalog(entries: DataFrame) -> DataFrame:
    """One row for each batch's file; base_lsn is a running sum over these rows."""
    f = entries.groupBy("batch_no").agg(F.sum(record_bytes(F.col("size"), F.col("is_delete"))).alias("trailer_offset"), F.count("*").alias("present_objects"))
    f = f.select("*", (F.col("trailer_offset") + TRAILER + ENTRY * F.col("present_objects")).alias("file_size"), (F.col("trailer_offset") + 1).alias("room"))
    return sum_before(f, ["batch_no"], "room", "before").select("batch_no", "trailer_offset", "present_objects", "file_size", (F.col("before") + 1).alias("base_lsn"))


def with_lsn(entries: DataFrame) -> DataFrame:
    return located(entries).join(catalog(entries).select("batch_no", "base_lsn"), "batch_no").withColumn("lsn", F.col("base_lsn") + F.col("rel_offset"))


def live_percent() -> Column:
    """Truncating integer percentage."""
    return F.floor(F.col("live_objects") * 100 / F.greatest("present_objects", F.lit(1))).cast("long")


def liveness(files: DataFrame, latest: DataFrame, key: str = "batch_no") -> DataFrame:
    """Files with live_objects (tombstones count) and live_percent."""
    live = latest.groupBy(key).agg(F.count("*").alias("live_objects"))
    return files.join(live, key, "left").fillna(0, ["live_objects"]).withColumn("live_percent", live_percent())


def stats(files: DataFrame) -> DataFrame:
    """Totals of files with liveness; undefined ratios are null."""
    t = files.agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(a) for c, a in (("live_objects", "live_objects"), ("present_objects", "stored_objects"), ("file_size", "total_file_size"))], F.count("*").alias("files"))
    ratio = (F.col("live_objects").cast("float") / F.greatest("stored_objects", F.lit(1)).cast("float")).cast("float")
    size = F.col("total_file_size").cast("float")
    t = t.select("*", (F.col("stored_objects") - F.col("live_objects")).alias("dead_objects"), ratio.alias("live_ratio"))
    return t.select("*", F.try_divide(size, (F.col("live_ratio") * size).cast("float")).cast("float").alias("space_amplification"))


def candidates(files: DataFrame, config: HeapConfig, in_map: int | Column | None = None) -> DataFrame:
    """Files worth rewriting, with target_generation. in_map: files that exist, empty ones included."""
    n = files.groupBy().agg(F.count("*").alias("__n")) if in_map is None else files.sparkSession.range(1).select(F.lit(in_map).cast("long").alias("__n"))
    small = (F.col("file_size") * config.min_compaction_files < config.target_file_size) & (F.col("__n") >= config.small_file_cleanup_threshold)
    generation = F.col("generation") if "generation" in files.columns else F.lit(0)
    found = files.crossJoin(F.broadcast(n)).where((F.col("live_objects") > 0) & ((F.col("live_percent") < config.file_compaction_percent) | small))
    return found.drop("__n").withColumn("target_generation", F.least(generation + 1, F.lit(3)).cast("int"))


def generation_groups(found: DataFrame, config: HeapConfig) -> DataFrame:
    """Target generations with enough candidates."""
    return found.groupBy("target_generation").agg(F.count("*").alias("files"), F.sum("live_objects").alias("live_objects")).where(F.col("files") >= config.min_compaction_files)


def empty_files(files: DataFrame, latest: DataFrame, key: str = "batch_no") -> DataFrame:
    return files.join(latest.select(key), key, "left_anti")


def floor_lookup(probes: DataFrame, bases: DataFrame, probe: str = "lsn", base: str = "base_lsn") -> DataFrame:
    """Each probe with the greatest base that isn't above it; both sides in one order of the key."""
    b = bases.select(F.col(base).alias("__k"), F.lit(0).alias("__is_probe"), F.col(base).alias("__b"), *[F.lit(None).cast(probes.schema[c].dataType).alias(c) for c in probes.columns])
    p = probes.select(F.col(probe).alias("__k"), F.lit(1).alias("__is_probe"), F.lit(None).cast(bases.schema[base].dataType).alias("__b"), *probes.columns)
    return last_up_to(b.union(p), ["__k", "__is_probe"], "__b", base).where("__is_probe = 1").select(*probes.columns, base)


def assign_files(objects: DataFrame, target: int, keep: list[str]) -> DataFrame:
    """Greedy split: in the order of object_id within a shard, a file is closed once it exceeds target.

    The rule is sequential in a shard. Rows of keys and sizes only pass through the tasks, in
    sorted order, with a running size and number as all their state.
    """
    import pyarrow as pa

    cols = ["shard", *keep, "size", "is_delete"]

    def run(batches):
        shard, number, size = None, 0, 0
        for b in batches:
            numbers = []
            for s, n, gone in zip(b.column("shard").to_pylist(), b.column("size").to_pylist(), b.column("is_delete").to_pylist(), strict=True):
                if s != shard:
                    shard, number, size = s, 0, 0
                elif size > target:
                    number, size = number + 1, 0
                size += 0 if gone else n + 20
                numbers.append(number)
            yield pa.RecordBatch.from_arrays([*[b.column(c) for c in cols], pa.array(numbers, pa.int32())], [*cols, "file_no"])

    sorted_rows = objects.select(*cols).repartition("shard").sortWithinPartitions("shard", keep[0])
    schema = ", ".join(f"{c} {objects.schema[c].dataType.simpleString()}" for c in cols) + ", file_no int"
    return sorted_rows.mapInArrow(run, schema)
