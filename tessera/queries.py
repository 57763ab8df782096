"""Queries over the operation log and documents, each with SQL over the same tables."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .config import HeapConfig
from .functions import records, sharding
from .heap import Heap
from .kv import KeyValue, floor_pages
from .operators import files, versions
from .operators.ordered import sum_before
from .plans.workload import Workload, batch_of
from .sources.staging import shared_dir

TARGET, TEXT = 65536, "cast(payload AS string) AS payload"

_SQL = """
op_log AS (SELECT event_id // 100 AS batch_no, user_id AS object_id, event_id AS seq, event_type = 'error' AS is_delete,
  CASE WHEN event_type <> 'error' THEN props END AS payload, CASE WHEN event_type = 'error' THEN 0 ELSE strlen(props) END AS size FROM events),
entries AS (SELECT * FROM op_log QUALIFY row_number() OVER (PARTITION BY batch_no, object_id ORDER BY seq DESC) = 1),
latest AS (SELECT * FROM entries QUALIFY row_number() OVER (PARTITION BY object_id ORDER BY batch_no DESC) = 1),
room AS (SELECT *, CASE WHEN is_delete THEN 0 ELSE size + 20 END AS room FROM entries),
sums AS (SELECT batch_no, sum(room)::BIGINT AS trailer_offset, count(*) AS present_objects FROM room GROUP BY batch_no),
files AS (SELECT *, trailer_offset + 12 + 16 * present_objects AS file_size,
  (1 + coalesce(sum(trailer_offset + 1) OVER (ORDER BY batch_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::BIGINT AS base_lsn FROM sums),
located AS (SELECT r.*, base_lsn + CASE WHEN is_delete THEN 0 ELSE coalesce(sum(room) OVER (PARTITION BY batch_no ORDER BY object_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) END::BIGINT AS lsn
  FROM room r JOIN files USING (batch_no)),
live AS (SELECT f.*, coalesce(n, 0) AS live_objects, coalesce(n, 0) * 100 // greatest(present_objects, 1) AS live_percent
  FROM files f LEFT JOIN (SELECT batch_no, count(*) AS n FROM latest GROUP BY batch_no) USING (batch_no)),
candidates AS (SELECT *, 1 AS target_generation FROM live WHERE live_objects > 0 AND (live_percent < 66 OR ((SELECT count(*) FROM files) >= 64 AND file_size * 2 < 268435456)))
"""
_DOCS = """docs AS (SELECT doc_id AS object_id, strlen(text) AS size,
  (CASE WHEN strlen(text) < 2048 THEN 0 WHEN strlen(text) <= 16384 THEN 1 WHEN strlen(text) <= 4194304 THEN 2 ELSE 3 END)::SMALLINT AS shard FROM documents)"""


QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None, prefix: str = _SQL):
    def register(f):
        QUERIES[f.__name__] = lambda spark, sf_dir: f(Workload(spark, sf_dir))
        QUERIES[f.__name__].__doc__ = f.__doc__
        if sql:
            ORACLE_SQL[f.__name__] = f"WITH RECURSIVE {prefix} {sql}" if prefix else sql
        return f

    return register


@query("SELECT batch_no, object_id, seq, is_delete, payload, size FROM entries")
def batch_dedup(w: Workload) -> DataFrame:
    return w.entries.select("batch_no", "object_id", "seq", "is_delete", "payload", "size")


@query("SELECT object_id, batch_no, is_delete, size, lsn FROM located SEMI JOIN latest USING (object_id, batch_no)")
def current_locations(w: Workload) -> DataFrame:
    return versions.current(files.with_lsn(w.entries)).select("object_id", "batch_no", "is_delete", "size", "lsn")


@query("SELECT object_id, max_by(lsn, batch_no) AS lsn FROM located GROUP BY object_id")
def recovery_replay(w: Workload) -> DataFrame:
    """The last of all files in their order that has an object holds it."""
    return files.with_lsn(w.entries).groupBy("object_id").agg(F.max_by("lsn", "batch_no").alias("lsn"))


@query("SELECT object_id, payload, size FROM latest WHERE NOT is_delete")
def read_all_live(w: Workload) -> DataFrame:
    return w.heap.snapshot().read_all().selectExpr("object_id", TEXT, "cast(octet_length(payload) AS bigint) AS size")


@query("SELECT object_id, payload FROM latest WHERE NOT is_delete AND object_id = 7")
def read_point(w: Workload) -> DataFrame:
    """The id filter reaches the scan of the heap's files."""
    return w.heap.snapshot().lookup([7]).selectExpr("object_id", TEXT)


@query("SELECT c_custkey AS object_id, payload FROM customer LEFT JOIN (SELECT object_id, payload FROM latest WHERE NOT is_delete) ON object_id = c_custkey")
def read_many(w: Workload) -> DataFrame:
    ids = w.spark.read.parquet(f"{w.sf_dir}/customer.parquet").select(F.col("c_custkey").alias("object_id"))
    return w.heap.read_many(ids).selectExpr("object_id", TEXT)


@query("SELECT batch_no, base_lsn, trailer_offset, present_objects, file_size FROM files")
def file_catalog(w: Workload) -> DataFrame:
    return w.files.select("batch_no", "base_lsn", "trailer_offset", "present_objects", "file_size")


@query("SELECT batch_no, present_objects, file_size, live_objects, live_percent FROM live")
def file_liveness(w: Workload) -> DataFrame:
    return w.heap.snapshot().liveness().select(batch_of().alias("batch_no"), "present_objects", "file_size", "live_objects", "live_percent")


_STATS = """t AS (SELECT sum(live_objects)::BIGINT AS live_objects, sum(present_objects)::BIGINT AS stored_objects, sum(file_size)::BIGINT AS total_file_size, count(*) AS files FROM live),
r AS (SELECT *, (live_objects::FLOAT / greatest(stored_objects, 1)::FLOAT)::FLOAT AS live_ratio FROM t)"""


@query(f"SELECT *, stored_objects - live_objects AS dead_objects, (total_file_size::FLOAT / (live_ratio * total_file_size::FLOAT)::FLOAT)::FLOAT AS space_amplification FROM r", _SQL + "," + _STATS)
def heap_stats(w: Workload) -> DataFrame:
    return files.stats(w.heap.snapshot().liveness())


@query("SELECT sum(room)::BIGINT AS bytes_written, (SELECT sum(size)::BIGINT FROM op_log) AS high_level_user_bytes_written, (sum(room)::FLOAT / (SELECT sum(size)::FLOAT FROM op_log))::FLOAT AS write_amplification FROM room")
def amplification(w: Workload) -> DataFrame:
    """User bytes are counted before a batch's operations are merged."""
    return w.heap.stats().select("bytes_written", "high_level_user_bytes_written", "write_amplification")


@query("SELECT batch_no, live_objects, live_percent, file_size, target_generation FROM candidates")
def defrag_candidates(w: Workload) -> DataFrame:
    return w.heap.snapshot().candidates(HeapConfig()).select(batch_of().alias("batch_no"), "live_objects", "live_percent", "file_size", "target_generation")


@query("SELECT target_generation, count(*) AS files, sum(live_objects)::BIGINT AS live_objects FROM candidates GROUP BY 1 HAVING count(*) >= 2")
def defrag_generation_groups(w: Workload) -> DataFrame:
    return files.generation_groups(w.heap.snapshot().candidates(HeapConfig()), HeapConfig())


@query("SELECT e.object_id, e.batch_no, e.is_delete, e.size FROM entries e SEMI JOIN latest USING (object_id, batch_no) SEMI JOIN candidates USING (batch_no)")
def gc_live_entries(w: Workload) -> DataFrame:
    """What a rewrite of the candidates moves."""
    snapshot = w.heap.snapshot()
    names = [r["file_id"] for r in snapshot.candidates(HeapConfig()).select("file_id").collect()]  # of files, not of objects
    return snapshot.live_entries(names).select("object_id", batch_of().alias("batch_no"), "is_delete", "size")


@query("""SELECT r.object_id, r.batch_no AS read_batch, c.batch_no AS current_batch, r.batch_no = c.batch_no AS ok
  FROM (SELECT * FROM entries WHERE batch_no < (SELECT max(batch_no) FROM entries) QUALIFY row_number() OVER (PARTITION BY object_id ORDER BY batch_no DESC) = 1) r JOIN latest c USING (object_id)""")
def gc_cas_conflicts(w: Workload) -> DataFrame:
    """What a rewrite read in the version before the last batch, against what is current after it."""
    now = w.heap.snapshot()
    version = lambda s, name: s.current("file_id").select("object_id", batch_of().alias(name))
    read = version(w.heap.snapshot(now.state.version - 1), "read_batch")
    return read.join(version(now, "current_batch"), "object_id").withColumn("ok", F.col("read_batch") == F.col("current_batch"))


@query("SELECT batch_no, file_size FROM live WHERE live_objects = 0")
def empty_files(w: Workload) -> DataFrame:
    return w.heap.snapshot().liveness().where("live_objects = 0").select(batch_of().alias("batch_no"), "file_size")


@query("SELECT r.range AS object_id FROM range(0, (SELECT max(object_id) + 1 FROM entries)) r ANTI JOIN entries e ON e.object_id = r.range")
def free_ids(w: Workload) -> DataFrame:
    return w.heap.snapshot().free_object_ids()[1]


@query("SELECT DISTINCT object_id FROM entries WHERE batch_no = 0")
def allocated_ids(w: Workload) -> DataFrame:
    """In the heap's first version, the first batch."""
    return w.heap.snapshot(0).allocated_object_ids()


@query("SELECT DISTINCT object_id FROM entries")
def allocated_ids_whole_log(w: Workload) -> DataFrame:
    """allocated_ids is the case of the first batch."""
    return w.heap.snapshot().allocated_object_ids()


@query("SELECT r.range AS object_id FROM range(0, (SELECT max(object_id) + 1 FROM entries WHERE batch_no = 0)) r ANTI JOIN (FROM entries WHERE batch_no = 0) e ON e.object_id = r.range")
def free_ids_first_batch(w: Workload) -> DataFrame:
    return w.heap.snapshot(0).free_object_ids()[1]


@query("SELECT max(object_id) + 1 AS next_object_id FROM entries")
def next_object_id(w: Workload) -> DataFrame:
    return versions.next_object_id(w.heap.snapshot().allocated_object_ids())


@query("SELECT l.object_id, l.lsn, f.base_lsn FROM (SELECT * FROM located WHERE NOT is_delete) l ASOF JOIN files f ON l.lsn >= f.base_lsn")
def floor_file_lookup(w: Workload) -> DataFrame:
    probes = files.with_lsn(w.entries).where(~F.col("is_delete")).select("object_id", "lsn")
    return files.floor_lookup(probes, w.files.select("base_lsn"))


@query("SELECT object_id, batch_no, (lsn * 2 + is_delete::INT)::BIGINT AS packed, lsn, is_delete FROM located")
def location_pack_unpack(w: Workload) -> DataFrame:
    p = files.with_lsn(w.entries).select("object_id", "batch_no", records.pack_location(F.col("lsn"), F.col("is_delete")).alias("packed"))
    return p.select("*", records.unpack_lsn(F.col("packed")).alias("lsn"), records.unpack_is_delete(F.col("packed")).alias("is_delete"))


@query("SELECT shard, count(*) AS objects, sum(size)::BIGINT AS bytes FROM docs GROUP BY shard", _DOCS)
def shard_default(w: Workload) -> DataFrame:
    d = w.documents()
    return d.groupBy(sharding.default_shard(F.col("object_id"), F.col("size")).alias("shard")).agg(F.count("*").alias("objects"), F.sum("size").alias("bytes"))


@query("SELECT (CASE WHEN size <= 1 THEN 0 ELSE length(bin(size - 1)) END)::SMALLINT AS shard, count(*) AS objects FROM docs GROUP BY 1", _DOCS)
def shard_pow2(w: Workload) -> DataFrame:
    return w.documents().groupBy(sharding.pow2_shard(F.col("object_id"), F.col("size")).alias("shard")).agg(F.count("*").alias("objects"))


@query("""SELECT shard, file_no, count(*) AS objects, sum(size)::BIGINT AS bytes FROM r GROUP BY shard, file_no""", _DOCS + f""",
  d AS (SELECT *, row_number() OVER (PARTITION BY shard ORDER BY object_id) AS rn FROM docs),
  r AS (SELECT shard, rn, size, 0 AS file_no, size + 20 AS running FROM d WHERE rn = 1 UNION ALL
    SELECT d.shard, d.rn, d.size, r.file_no + (r.running > {TARGET})::INT, CASE WHEN r.running > {TARGET} THEN 0 ELSE r.running END + d.size + 20 FROM r JOIN d ON d.shard = r.shard AND d.rn = r.rn + 1)""")
def shard_split(w: Workload) -> DataFrame:
    d = w.documents().withColumn("shard", sharding.default_shard(F.col("object_id"), F.col("size")))
    return files.assign_files(d, TARGET, ["object_id"]).groupBy("shard", "file_no").agg(F.count("*").alias("objects"), F.sum("size").alias("bytes"))


@query()
def record_checksum(w: Workload) -> DataFrame:
    """As stored beside the payloads."""
    return w.heap.snapshot().entries.where(~F.col("is_delete")).select("object_id", batch_of().alias("batch_no"), "crc")


@query("SELECT c_name AS key, lo FROM customer ASOF JOIN (SELECT c_name AS lo FROM customer WHERE c_custkey % 100 = 0 UNION ALL SELECT '') p ON c_name >= lo", "")
def kv_page_lookup(w: Workload) -> DataFrame:
    """Each key's page: the greatest lower bound that isn't above it."""
    c = w.spark.read.parquet(f"{w.sf_dir}/customer.parquet")
    pages = c.where(F.col("c_custkey") % 100 == 0).select(F.col("c_name").alias("lo")).union(w.spark.range(1).select(F.lit("")))
    return floor_pages(c.select(F.col("c_name").alias("key")), pages)


@query("SELECT object_id AS key, payload AS value FROM latest WHERE object_id IN (1, 2, 3)")
def kv_get(w: Workload) -> DataFrame:
    """The log under keys of text in the key-value layer, and three keys of it."""
    kv = KeyValue(Heap.open(w.spark, f"{shared_dir(w.spark)}/kv-{uuid.uuid4().hex}"))
    kv.put_log(w.log.select("batch_no", F.col("object_id").cast("string").alias("key"), F.col("payload").alias("value"), "seq"))
    some = kv.get_many(w.spark.createDataFrame([("1",), ("2",), ("3",)], "key string"))
    return some.select(F.col("key").cast("string").cast("long").alias("key"), F.col("value").cast("string").alias("value"))


@query("SELECT object_id, batch_no, payload, lag(payload) OVER (PARTITION BY object_id ORDER BY batch_no) AS previous FROM entries")
def kv_mutate_previous(w: Workload) -> DataFrame:
    return versions.previous_values(w.entries)


@query("""SELECT (SELECT count(*) FROM (SELECT 1 FROM entries GROUP BY object_id, batch_no HAVING count(*) > 1)) AS added_twice,
  (SELECT count(*) FROM latest ANTI JOIN entries USING (object_id, batch_no)) AS never_added, (SELECT count(*) FROM latest ANTI JOIN files USING (batch_no)) AS without_file""")
def history_invariants(w: Workload) -> DataFrame:
    """Counts of broken invariants in the compacted heap: versions stored twice, versions that the log never had, objects without a file."""
    snapshot = w.compacted.snapshot()
    broken = snapshot.broken_invariants()
    # A version is a batch's number in order; the log's entries say which there are.
    order = sum_before(w.entries.select("batch_no", F.lit(1).cast("long").alias("one")).distinct(), ["batch_no"], "one", "commit_seq")
    never = snapshot.current().join(w.entries.join(order, "batch_no"), ["object_id", "commit_seq"], "left_anti").agg(F.count("*").alias("never_added"))
    return never.select(F.lit(broken["stored_twice"]).cast("long").alias("added_twice"), "never_added", F.lit(broken["without_file"]).cast("long").alias("without_file"))


@query("SELECT count(*) AS objects_in_empty_files FROM latest SEMI JOIN (FROM live WHERE live_objects = 0) USING (batch_no)")
def uninhabited_files(w: Workload) -> DataFrame:
    """Objects of the compacted heap whose newest version lies in a file that counts as empty."""
    snapshot = w.compacted.snapshot()
    return snapshot.current("file_id").join(snapshot.liveness().where("live_objects = 0"), "file_id", "left_semi").agg(F.count("*").alias("objects_in_empty_files"))


@query("""SELECT 1 AS files, count(*) AS live_objects, count(*) AS stored_objects, (sum(CASE WHEN is_delete THEN 0 ELSE size + 20 END) + 12 + 16 * count(*))::BIGINT AS total_file_size
  FROM latest""")
def post_compaction_stats(w: Workload) -> DataFrame:
    """All live objects are under the target size and in one file after maintenance with a threshold of one file."""
    return w.compacted.stats().select(F.col("files").cast("int").alias("files"), "live_objects", "stored_objects", "total_file_size")


@query("SELECT object_id, payload FROM latest WHERE NOT is_delete")
def post_compaction_reads(w: Workload) -> DataFrame:
    """Reads of the heap after maintenance, which keeps the original versions of what it rewrites."""
    return w.compacted.snapshot().read_all().selectExpr("object_id", TEXT)


@query("SELECT object_id, CAST(payload AS VARCHAR) AS payload FROM latest WHERE NOT is_delete")
def stream_ingest(w: Workload) -> DataFrame:
    """The events, streamed into a heap in micro-batches, then read."""
    from .streaming.sink import ingest_events

    return ingest_events(w.spark, w.sf_dir).snapshot().read_all().select("object_id", F.col("payload").cast("string").alias("payload"))


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Heap statistics beside each file's liveness."""
    w = Workload(spark, sf_dir)
    return file_liveness(w).crossJoin(heap_stats(w).select(F.col("files").alias("heap_files"), "live_objects", "stored_objects", "live_ratio", "space_amplification").withColumnsRenamed({"live_objects": "heap_live", "stored_objects": "heap_stored"}))
