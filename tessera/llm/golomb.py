"""Golomb-coded exchange of fingerprints between the tasks that hold them and their owners.

A sender is a group of rows. It sends each owner, a slice of the fingerprints' range, its
distinct fingerprints there: sorted, as differences, Golomb-Rice coded. The owner merges
what all senders sent and returns each of them one bit for each fingerprint: set if it
stands in another sender's list too, or several times in the sender's own rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Bits of a fingerprint that are sent.
BITS = 48


def encode(values: np.ndarray, low: int = 0) -> bytes:
    """Sorted distinct integers from low up, as Golomb-Rice coded differences.

    Header: count (4 bytes), k (1). Then the differences' high parts in unary (n ones, each
    behind as many zeros as its high part), and their k low bits, each stream padded to bytes.
    """
    n = len(values)
    if not n:
        return b""
    gaps = np.diff(values.astype(np.int64), prepend=np.int64(low))
    k = max(0, int(np.log2(max(gaps.mean() * 0.69, 1))))
    high = gaps >> k
    unary = np.zeros(int(high.sum()) + n, np.uint8)
    unary[np.cumsum(high + 1) - 1] = 1
    bits = (gaps[:, None] >> np.arange(k - 1, -1, -1)) & 1
    return n.to_bytes(4, "little") + k.to_bytes(1, "little") + len(unary).to_bytes(4, "little") + np.packbits(unary).tobytes() + np.packbits(bits.astype(np.uint8).ravel()).tobytes()


def decode(blob: bytes, low: int = 0) -> np.ndarray:
    if not blob:
        return np.empty(0, np.int64)
    n, k, size = int.from_bytes(blob[:4], "little"), blob[4], int.from_bytes(blob[5:9], "little")
    unary = np.unpackbits(np.frombuffer(blob, np.uint8, (size + 7) // 8, 9))[:size]
    high = np.diff(np.flatnonzero(unary), prepend=-1) - 1
    gaps = high.astype(np.int64) << k
    if k:
        bits = np.unpackbits(np.frombuffer(blob, np.uint8, offset=9 + (size + 7) // 8))[: n * k].reshape(n, k)
        gaps += bits.astype(np.int64) @ (1 << np.arange(k - 1, -1, -1, dtype=np.int64))
    return np.cumsum(gaps) + low


def parcels(fingerprints: np.ndarray, owners: int) -> list[tuple[int, bytes, bytes]]:
    """What a sender sends: (owner, coded distinct fingerprints, bits of those it has several times)."""
    values, n = np.unique(fingerprints, return_counts=True)
    width = -(-(1 << BITS) // owners)
    owner = values // width
    out = []
    for o in np.unique(owner):
        at = owner == o
        out.append((int(o), encode(values[at], int(o) * width), np.packbits(n[at] > 1).tobytes()))
    return out


def answers(sent: DataFrame, owners: int) -> DataFrame:
    """(sender, owner, coded, several) to (sender, owner, bitmap). An owner's rows are one group:
    its slice of the range, which the number of owners keeps to a size that a task can hold."""
    width = -(-(1 << BITS) // owners)

    def merge(key, group):
        o = key[0].as_py()
        lists = [decode(b, o * width) for b in group.column("coded").to_pylist()]
        several = [np.unpackbits(np.frombuffer(s, np.uint8))[: len(x)] for s, x in zip(group.column("several").to_pylist(), lists, strict=True)]
        values, back, n = np.unique(np.concatenate(lists), return_inverse=True, return_counts=True)
        twice = (n > 1) | (np.bincount(back, np.concatenate(several), len(values)) > 0)
        flags, start, bitmaps = twice[back], 0, []
        for x in lists:
            bitmaps.append(np.packbits(flags[start : start + len(x)]).tobytes())
            start += len(x)
        return pa.table({"sender": group.column("sender"), "owner": group.column("owner"), "bitmap": pa.array(bitmaps, pa.binary())})

    return sent.groupBy("owner").applyInArrow(merge, "sender long, owner int, bitmap binary")


def flags(fingerprints: np.ndarray, owners: int, bitmaps: dict[int, bytes]) -> np.ndarray:
    """For each of the sender's fingerprints, whether the owners say that it occurs again."""
    values, back = np.unique(fingerprints, return_inverse=True)
    width = -(-(1 << BITS) // owners)
    owner = values // width
    bit = np.zeros(len(values), bool)
    for o in np.unique(owner):
        at = np.flatnonzero(owner == o)
        bit[at] = np.unpackbits(np.frombuffer(bitmaps[int(o)], np.uint8))[: len(at)].astype(bool)
    return bit[back]
