"""Exact deduplication by a Golomb-coded fingerprint exchange.

Partitions send the sorted, compressed hashes of their texts to the owners of the hashes
and get bitmaps of those that occur again. Only such suspects' texts are shuffled, and
compared byte by byte.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import golomb
from .common import SPACE, rows_with_id, small_enough, written

#: Rows of a sender and fingerprints of an owner, times the square root of all rows: a parcel from one to
#: the other then holds about PER_SENDER * PER_OWNER fingerprints at every size, so that coding pays.
#: With 10^10 rows a sender has 1.6 and an owner 4 million. Senders are dealt blocks of 2^BLOCK_BITS row ids.
PER_SENDER, PER_OWNER, BLOCK_BITS = 16, 40, 10
#: Suspects up to which their ids are broadcast (8 bytes each).
BROADCAST = 1_000_000


def normalised(text: Column) -> Column:
    """Null as empty, and each run of white space as one space."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), SPACE, " ")


def suspects(prints: DataFrame, rows: int) -> DataFrame:
    """(rid) of the rows of prints (rid, fp) whose fingerprint stands in another row too."""
    root = math.isqrt(rows)
    senders, owners = max(1, root // PER_SENDER), max(1, root // PER_OWNER)
    sender = F.pmod(F.xxhash64(F.shiftright("rid", BLOCK_BITS)), F.lit(senders).cast("long"))

    def send(key, group):
        got = golomb.parcels(group.column("fp").to_numpy(), owners)
        return pa.table({"sender": pa.array([key[0].as_py()] * len(got), pa.int64()), "owner": pa.array([g[0] for g in got], pa.int32()), "coded": pa.array([g[1] for g in got], pa.binary()), "several": pa.array([g[2] for g in got], pa.binary())})

    prints = prints.select("rid", "fp", sender.alias("sender"))
    sent = prints.groupBy("sender").applyInArrow(send, "sender long, owner int, coded binary, several binary")
    replies = golomb.answers(sent, owners)

    def pick(key, group, replies):
        bitmaps = dict(zip(replies.column("owner").to_pylist(), replies.column("bitmap").to_pylist(), strict=True))
        hit = golomb.flags(group.column("fp").to_numpy(), owners, bitmaps) if group.num_rows else np.empty(0, bool)
        return pa.table({"rid": group.column("rid").filter(pa.array(hit))})

    return prints.groupBy("sender").cogroup(replies.groupBy("sender")).applyInArrow(pick, "rid long")


def decide(docs: DataFrame, text: str = "text", id_col: str = "doc_id") -> tuple[DataFrame, DataFrame]:
    """The rows with ids, as rows_with_id() gives them, and (rid, keep_id, group_size, kept, sha) of each.

    Texts are equal if identical once normalised; null equals empty. Of equal texts the row with
    the smallest id stays: null ids come last, and rows with the same id go by their row ids, so
    that exactly one stays. A group may hold any share of the rows: only ids and sizes are
    aggregated, in part before the shuffle.
    """
    rows = rows_with_id(docs)
    norm = normalised(F.col(f"row.{text}"))
    order = F.struct(F.col("id").isNull().alias("none"), F.col("id").alias("id"), F.col("rid").alias("rid"))
    prints = written(rows.select("rid", F.col(f"row.{id_col}").alias("id"), F.sha2(norm, 256).alias("sha"), F.shiftrightunsigned(F.xxhash64(norm), 64 - golomb.BITS).alias("fp")), "prints")
    again = written(suspects(prints, prints.count()), "suspects")
    chosen = F.broadcast(again) if small_enough(again, BROADCAST) else again
    # Byte verification: texts are grouped as they are, not by a hash of them.
    texts = rows.join(chosen, "rid", "left_semi").select("rid", F.col(f"row.{id_col}").alias("id"), norm.alias("t"))
    groups = texts.groupBy("t").agg(F.min(order).alias("keep"), F.count("*").alias("group_size")).where("group_size > 1")
    # Each group is named by the digest of its bytes from here on, equal texts having been compared.
    groups = groups.select(F.sha2("t", 256).alias("sha"), F.col("keep.id").alias("keep_id"), F.col("keep.rid").alias("keep_rid"), "group_size")
    d = prints.join(groups, "sha", "left")
    one = F.col("keep_rid").isNull()
    return rows, d.select("rid", "id", F.when(one, F.col("id")).otherwise(F.col("keep_id")).alias("keep_id"), F.coalesce("group_size", F.lit(1)).cast("long").alias("group_size"), (one | (F.col("rid") == F.col("keep_rid"))).alias("kept"), "sha")


def deduplicate(docs: DataFrame, text: str = "text", id_col: str = "doc_id") -> DataFrame:
    """docs without the rows that a row with an equal text replaces; all columns unchanged."""
    rows, d = decide(docs, text, id_col)
    dropped = written(d.where(~F.col("kept")).select("rid"), "dropped")
    return rows.join(F.broadcast(dropped) if small_enough(dropped, BROADCAST) else dropped, "rid", "left_anti").select("row.*")
