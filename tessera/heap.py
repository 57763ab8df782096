"""The heap: atomic batches of upserts and deletes, snapshots, compaction, statistics."""

from __future__ import annotations

import uuid
from collections.abc import Iterable
from dataclasses import dataclass, field
from functools import cached_property

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from .config import HeapConfig
from .functions.ids import order_key, to_bits, to_unsigned
from .functions.records import ENTRY, TRAILER, record_bytes, record_checksum
from .functions.sharding import shard_of
from .operators import files as file_ops
from .operators import versions
from .sources.manifest import CommitConflict, DataFile, Manifest, State

#: Files of which the table of commit numbers is broadcast; more are joined.
BROADCAST = 100_000
SCHEMA = "object_id bigint, is_delete boolean, payload binary, size bigint, crc bigint, commit_seq bigint"


@dataclass
class Counters:
    bytes_read: int = 0
    bytes_written: int = 0
    high_level_user_bytes_written: int = 0


class CorruptObject(Exception):
    """Stored checksums and payloads disagree."""


@dataclass
class Snapshot:
    """One version of the heap; later commits don't change it."""

    spark: SparkSession
    root: str
    state: State
    counters: Counters = field(default_factory=Counters)

    @cached_property
    def files(self) -> DataFrame:
        rows = [(f.file_id, f.commit_seq, f.generation, f.shard, f.present_objects, f.file_size) for f in self.state.files.values()]
        return self.spark.createDataFrame(rows, "file_id string, file_seq bigint, generation int, shard int, present_objects bigint, file_size bigint")

    def _scan(self, names: Iterable[str]) -> DataFrame:
        """All stored rows of some files, with file_id and commit_seq. Batches of one log share their Parquet files."""
        names = list(names)
        some = self.files if len(names) == len(self.state.files) else self.files.join(self.spark.createDataFrame([(n,) for n in names], "file_id string"), "file_id", "left_semi")
        paths = sorted({f"{self.root}/data/{n.split('/')[0] if n.startswith('log-') else n}" for n in names})
        raw = self.spark.read.schema(f"{SCHEMA}, batch_no bigint").parquet(*paths) if paths else self.spark.createDataFrame([], f"{SCHEMA}, batch_no bigint")
        name = F.regexp_extract(F.input_file_name(), r"/data/(batch-[^/]+|log-[^/]+|rewrite-[^/]+/shard=[^/]+/file_no=[^/]+)/", 1) if paths else F.lit("")
        tagged = raw.withColumn("file_id", F.coalesce(F.concat(name, F.lit("/batch_no="), F.col("batch_no").cast("string")), name)).drop("batch_no")
        # One row for each file, as many as the manifest lists.
        seq = some.select("file_id", "file_seq")
        return tagged.join(F.broadcast(seq) if len(names) <= BROADCAST else seq, "file_id").withColumn("commit_seq", F.coalesce("commit_seq", "file_seq")).drop("file_seq")

    @cached_property
    def entries(self) -> DataFrame:
        return self._scan(self.state.files)

    def current(self, *columns: str) -> DataFrame:
        """Newest version of each object: keys and ``columns``; payloads are read only if named."""
        return versions.current(self.entries.select("object_id", "commit_seq", "is_delete", *columns), "commit_seq")

    def lookup(self, object_ids: Iterable[int]) -> DataFrame:
        """(object_id, payload) of a few objects that exist; the ids reach the Parquet scan."""
        some = self.entries.where(F.col("object_id").isin([to_bits(i) for i in object_ids])).select("object_id", "commit_seq", "is_delete", "payload")
        return versions.read_all(versions.current(some, "commit_seq")).select("object_id", "payload")

    def read_all(self) -> DataFrame:
        return versions.read_all(self.current("payload")).select("object_id", "payload")

    def read_many(self, ids: DataFrame) -> DataFrame:
        return versions.read_many(self.current("payload"), ids)

    def read(self, object_id: int) -> bytes | None:
        """One object; the id filter reaches the Parquet scan. None for unknown and deleted ids alike."""
        row = self.lookup([object_id]).first()
        if row is None:
            return None
        self.counters.bytes_read += len(row["payload"])
        return bytes(row["payload"])

    def liveness(self) -> DataFrame:
        return file_ops.liveness(self.files, self.current("file_id").select("file_id"), "file_id")

    def candidates(self, config: HeapConfig) -> DataFrame:
        """Files that are worth rewriting."""
        return file_ops.candidates(self.liveness(), config, in_map=len(self.state.files))

    def live_entries(self, names: Iterable[str]) -> DataFrame:
        """Stored rows of some files that are the newest version of their object."""
        key = ["object_id", "commit_seq"]
        return self._scan(names).join(self.current().select(*key), key, "left_semi")

    def allocated_object_ids(self) -> DataFrame:
        """Ids that have a version, tombstones included."""
        return self.entries.select("object_id").distinct()

    def deleted_object_ids(self) -> DataFrame:
        return self.current().where("is_delete").select("object_id")

    def next_object_id(self) -> int:
        if self.state.max_object_id == (1 << 64) - 1:
            raise OverflowError("the largest id is taken")
        return self.state.max_object_id + 1

    def free_object_ids(self) -> tuple[int, DataFrame]:
        """The next id, and ids up to the largest that no version has (0 in an empty heap)."""
        return self.next_object_id(), versions.free_ids(self.allocated_object_ids())

    def broken_invariants(self) -> dict[str, int]:
        """Counts of what must not be: versions of an object stored twice, live objects in files that the
        manifest doesn't list, files whose number of objects isn't what it says, and objects whose checksum differs."""
        e = self.entries
        twice = e.groupBy("object_id", "commit_seq").count().where("count > 1").count()
        lost = self.current("file_id").join(self.files, "file_id", "left_anti").count()
        held = e.groupBy("file_id").agg(F.count("*").alias("n"))
        differ = self.files.join(held, "file_id", "left").where(F.col("present_objects") != F.coalesce("n", F.lit(0))).count()
        bad = e.where(~F.col("is_delete") & (F.col("crc") != record_checksum(F.col("object_id"), F.col("payload")))).count()
        return {"stored_twice": twice, "without_file": lost, "wrong_counts": differ, "corrupt": bad}

    def verify(self) -> None:
        bad = self.entries.where(~F.col("is_delete") & (F.col("crc") != record_checksum(F.col("object_id"), F.col("payload")))).count()
        if bad:
            raise CorruptObject(f"{bad} objects")


class Heap:
    """A handle; handles on one path, in any number of processes, see each other's commits."""

    def __init__(self, spark: SparkSession, config: HeapConfig):
        self.spark, self.config, self.root = spark, config, config.path.rstrip("/")
        self.manifest, self.counters = Manifest(spark, config.path, config.fsync_each_batch), Counters()
        self.manifest.state()

    @classmethod
    def open(cls, spark: SparkSession, path: str) -> Heap:
        return cls(spark, HeapConfig(path=path))

    def __repr__(self) -> str:
        return f"Heap({self.root!r}, version={self.manifest.state().version})"

    def snapshot(self, version: int | None = None) -> Snapshot:
        return Snapshot(self.spark, self.root, self.manifest.state(version), self.counters)

    def read(self, object_id: int) -> bytes | None:
        return self.snapshot().read(object_id)

    def read_many(self, ids: DataFrame) -> DataFrame:
        return self.snapshot().read_many(ids)

    def _write(self, df: DataFrame, name: str, **by) -> None:
        w = df.write
        if self.config.zstd_compression_level is not None:
            w = w.option("compression", "zstd").option("parquet.compression.codec.zstd.level", self.config.zstd_compression_level)
        if by:
            w = w.partitionBy(*by["columns"])
        w.parquet(f"{self.root}/data/{name}")

    def _stored(self, rows: DataFrame, seen: Observation, *by: str) -> DataFrame:
        """The newest row of each object (of each batch, by) as it is stored; seen counts what came."""
        size, gone = F.octet_length("payload"), F.col("payload").isNull()
        rows = rows.observe(seen, F.coalesce(F.sum(size.cast("long")), F.lit(0)).alias("user"), F.coalesce(F.max(size), F.lit(0)).alias("largest"))
        newest = rows.groupBy(*by, "object_id").agg(F.max_by(F.struct("payload"), "seq").alias("v")).select(*by, "object_id", F.col("v.payload").alias("payload"))
        return newest.select(*by, "object_id", gone.alias("is_delete"), "payload", F.coalesce(size, F.lit(0)).cast("bigint").alias("size"), F.when(~gone, record_checksum(F.col("object_id"), F.col("payload"))).alias("crc"), F.lit(None).cast("bigint").alias("commit_seq"))

    def _committed(self, name: str, made: list, file_ids: list[str], seen: Observation, txn: str | tuple[str, int] | None) -> int | None:
        """Commit the described files of one write, or delete them if they hold nothing or too much."""
        if not any(m["n"] for m in made):
            self.manifest.delete([f"data/{name}"])
            return None
        got = seen.get
        if got["largest"] > self.config.object_limit:
            self.manifest.delete([f"data/{name}"])
            raise ValueError(f"an object has {got['largest']} bytes; the limit is {self.config.object_limit}")
        files = [DataFile(f, None, 0, 0, m["n"], m["room"] + TRAILER + ENTRY * m["n"], False) for f, m in zip(file_ids, made, strict=True)]
        v = self.manifest.commit(files, max_object_id=max(to_unsigned(m["largest"]) for m in made), txn=txn)
        if v is not None:
            self.counters.bytes_written += sum(m["room"] for m in made)
            self.counters.high_level_user_bytes_written += got["user"]
        return v

    def _done(self, txn: str | tuple[str, int] | None) -> bool:
        name, number = (txn, 0) if isinstance(txn, str) else txn or ("", -1)
        return number >= 0 and number <= self.manifest.state().txns.get(name, -1)

    def write_batch(self, batch: DataFrame | Iterable[tuple[int, bytes | None]], txn: str | tuple[str, int] | None = None) -> int | None:
        """Commit a batch: rows (object_id, payload[, seq]), or pairs of id and payload; a null payload deletes.

        Of several rows of an object the one with the largest seq counts (pairs: the last). The
        version, or None if the batch is empty or txn, a writer's name and number, was committed before.
        """
        if not isinstance(batch, DataFrame):
            rows = [(to_bits(i), None if p is None else bytearray(p), n) for n, (i, p) in enumerate(batch)]
            if not rows:
                return None
            batch = self.spark.createDataFrame(rows, "object_id bigint, payload binary, seq bigint")
        if self._done(txn):
            return None
        seq = F.col("seq") if "seq" in batch.columns else F.lit(0)
        seen, name = Observation(), f"batch-{uuid.uuid4().hex}"
        self._write(self._stored(batch.select(F.col("object_id").cast("bigint"), F.col("payload").cast("binary"), seq.cast("bigint").alias("seq")), seen), name)
        made = self._describe(self.spark.read.schema(SCHEMA).parquet(f"{self.root}/data/{name}")).collect()  # one row, or none
        return self._committed(name, made, [name], seen, txn)

    def write_log(self, log: DataFrame, txn: str | tuple[str, int] | None = None) -> int | None:
        """Commit many batches at once: rows (batch_no, object_id, payload, seq). Each batch is a file of the
        heap, and later ones, by batch_no, hide earlier ones. Readers see all of them or none. Small
        batches share Parquet files, in the order of batches and ids."""
        if self._done(txn):
            return None
        seen, name = Observation(), f"log-{uuid.uuid4().hex}"
        rows = log.select(F.col("batch_no").cast("bigint"), F.col("object_id").cast("bigint"), F.col("payload").cast("binary"), F.col("seq").cast("bigint"))
        stored = self._stored(rows, seen, "batch_no").repartitionByRange("batch_no", "object_id").sortWithinPartitions("batch_no", "object_id")
        self._write(stored.select(*[c.split()[0] for c in SCHEMA.split(", ")], "batch_no"), name)
        made = self._describe(self.spark.read.schema(f"{SCHEMA}, batch_no bigint").parquet(f"{self.root}/data/{name}"), "batch_no").orderBy("batch_no").collect()  # one row for each file
        return self._committed(name, made, [f"{name}/batch_no={m['batch_no']}" for m in made], seen, txn)

    @staticmethod
    def _describe(df: DataFrame, *by: str) -> DataFrame:
        return df.groupBy(*by).agg(F.count("*").alias("n"), F.sum(record_bytes(F.col("size"), F.col("is_delete"))).alias("room"), F.max_by("object_id", order_key(F.col("object_id"))).alias("largest"))

    def maintenance(self) -> int:
        """Rewrite what is worth it, drop files without live objects; the number of objects rewritten.

        Rewritten rows keep their commit_seq, so a batch committed meanwhile still wins. If another
        rewrite took a file first, this one's work is dropped.
        """
        snap = self.snapshot()
        found = snap.candidates(self.config).select("file_id", "target_generation").collect()  # of files, not of objects
        moved = 0
        for target in sorted({r["target_generation"] for r in found}):
            names = [r["file_id"] for r in found if r["target_generation"] == target]
            if len(names) >= self.config.min_compaction_files:
                moved += self._rewrite(snap, names, target)
        self._prune()
        return moved

    def _rewrite(self, snap: Snapshot, names: list[str], generation: int) -> int:
        key = ["object_id", "commit_seq"]
        live = snap.live_entries(names)
        shard = shard_of(F.col("object_id"), F.col("size"), F.col("is_delete"), self.config.partition_function)
        # Keys and sizes decide the files; payloads join them afterwards.
        placed = file_ops.assign_files(live.select(*key, "size", "is_delete", shard.alias("shard")), self.config.target_file_size, key).select(*key, "shard", "file_no")
        out = live.drop("file_id").join(placed, key)
        job = f"rewrite-{uuid.uuid4().hex}"
        parts = ["shard", "file_no"]
        self._write(out.repartition(*parts), job, columns=parts)
        got = self._describe(self.spark.read.parquet(f"{self.root}/data/{job}"), *parts).collect()  # one row for each file
        add = [DataFile(f"{job}/shard={r['shard']}/file_no={r['file_no']}", None, generation, r["shard"], r["n"], r["room"] + TRAILER + ENTRY * r["n"], True) for r in got]
        try:
            self.manifest.commit(add, names)
        except CommitConflict:
            self.manifest.delete([f"data/{job}"])
            return 0
        self.counters.bytes_written += sum(r["room"] for r in got)
        return sum(r["n"] for r in got)

    def _prune(self) -> None:
        snap = self.snapshot()
        dead = [r["file_id"] for r in snap.liveness().where("live_objects = 0").select("file_id").collect()]
        if dead:
            try:
                self.manifest.commit([], dead)
            except CommitConflict:
                pass  # another handle has pruned them

    def vacuum(self, keep_versions: int = 0) -> int:
        """Delete data that neither the newest version nor the keep_versions before it can read.
        Batches that are being written look the same as abandoned ones: call it while none is."""
        state = self.manifest.state()
        used = {f.split("/")[0] for f in state.files} | {f.split("/")[0] for f, v in state.removed.items() if v > state.version - keep_versions}
        gone = [n for n in self.manifest.data_names() if n not in used]
        self.manifest.delete([f"data/{n}" for n in gone])
        return len(gone)

    def stats(self) -> DataFrame:
        """One row; bytes are this handle's. Undefined ratios are null."""
        c = self.counters
        s = file_ops.stats(self.snapshot().liveness())
        ratio = F.try_divide(F.lit(c.bytes_written).cast("float"), F.lit(c.high_level_user_bytes_written).cast("float")).cast("float")
        return s.select("*", F.lit(c.bytes_read).cast("long").alias("bytes_read"), F.lit(c.bytes_written).cast("long").alias("bytes_written"), F.lit(c.high_level_user_bytes_written).cast("long").alias("high_level_user_bytes_written"), ratio.alias("write_amplification"))

    def sync_all(self) -> None:
        """Commits are durable once made; nothing is left to do."""
