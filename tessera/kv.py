"""An ordered key-value layer: keys are rows, and pages are ranges of keys."""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .heap import Heap
from .operators.files import floor_lookup


def floor_pages(keys: DataFrame, pages: DataFrame) -> DataFrame:
    """(key, lo): each key with the greatest page bound that isn't above it."""
    return floor_lookup(keys.select("key"), pages.select("lo"), "key", "lo")


def stored_key(payload: Column) -> Column:
    """The key in a stored value: its length in four bytes, least significant first, and then the key."""
    length = F.conv(F.hex(F.concat(*[F.substring(payload, i, 1) for i in (4, 3, 2, 1)])), 16, 10).cast("int")
    return F.substring(payload, F.lit(5), length)


class KeyValue:
    """Bytes to bytes. A key's object id is kept in an index object range: ids are hashes of keys,
    and the stored value holds its key, so that a clash is found and not taken for a hit."""

    def __init__(self, heap: Heap):
        self.heap, self._counted = heap, 1

    @staticmethod
    def _id(key: bytes) -> int:
        return int.from_bytes(hashlib.sha256(key).digest()[:8])

    @staticmethod
    def _id_of(key: Column) -> Column:
        return F.conv(F.substring(F.sha2(key, 256), 1, 16), 16, -10).cast("long")

    def put_log(self, log: DataFrame) -> int | None:
        """Many batches of (batch_no, key, value, seq) at once; a null value removes its key."""
        key, value = F.col("key").cast("binary"), F.col("value").cast("binary")
        length = F.unhex(F.lpad(F.hex(F.octet_length(key)), 8, "0"))
        record = F.concat(*[F.substring(length, i, 1) for i in (4, 3, 2, 1)], key, value)
        return self.heap.write_log(log.select("batch_no", self._id_of(key).alias("object_id"), record.alias("payload"), "seq"))

    def get_many(self, keys: DataFrame) -> DataFrame:
        """(key, value) of each row of keys; null for unknown and removed keys alike."""
        ids = keys.select(F.col("key").cast("binary").alias("key")).withColumn("object_id", self._id_of(F.col("key")))
        found = ids.join(self.heap.snapshot().read_all(), "object_id", "left")
        same = stored_key(F.col("payload")) == F.col("key")
        return found.select("key", F.when(same, F.expr("substring(payload, 5 + octet_length(key))")).alias("value"))

    def get(self, key: bytes) -> bytes | None:
        raw = self.heap.read(self._id(key))
        if raw is None:
            return None
        n = int.from_bytes(raw[:4], "little")
        if raw[4 : 4 + n] != key:
            raise KeyError(f"another key has the id of {key!r}")
        return raw[4 + n :]

    def items(self, low: bytes | None = None, high: bytes | None = None) -> DataFrame:
        """(key, value) of the keys from low up to, not including, high, in the order of their bytes."""
        live = self.heap.snapshot().read_all().select(stored_key(F.col("payload")).alias("key"), "payload")
        for bound, at in ((low, lambda k, b: k >= b), (high, lambda k, b: k < b)):
            if bound is not None:
                live = live.where(at(F.col("key"), F.lit(bytearray(bound))))
        return live.select("key", F.expr("substring(payload, 5 + octet_length(key))").alias("value")).orderBy("key")

    def floor(self, key: bytes) -> tuple[bytes, bytes] | None:
        """The greatest key that isn't above key, and its value."""
        row = self.items().where(F.col("key") <= F.lit(bytearray(key))).orderBy(F.desc("key")).first()
        return (bytes(row["key"]), bytes(row["value"])) if row else None

    def set(self, key: bytes, value: bytes) -> bytes | None:
        """The value before."""
        before = self.get(key)
        self.heap.write_batch([(self._id(key), len(key).to_bytes(4, "little") + key + value)])
        self._tidy()
        return before

    def remove(self, key: bytes) -> bytes | None:
        before = self.get(key)
        self.heap.write_batch([(self._id(key), None)])
        self._tidy()
        return before

    def _tidy(self) -> None:
        """Liveness is counted once files have doubled since it was last; a rewrite follows if most objects are dead."""
        files = len(self.heap.manifest.state().files)
        if files < 2 * self._counted:
            return
        s = self.heap.stats().first()
        if s["dead_objects"] > s["live_objects"]:
            self.heap.maintenance()
        self._counted = max(len(self.heap.manifest.state().files), 1)
