"""Record checksums and packed locations."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Bytes of a record's header, of a trailer's header and of an entry in it.
HEADER, TRAILER, ENTRY = 20, 12, 16


def little_endian(x: Column) -> Column:
    """The eight bytes of a BIGINT, least significant first."""
    raw = F.unhex(F.lpad(F.hex(x), 16, "0"))
    return F.concat(*[F.substring(raw, i, 1) for i in range(8, 0, -1)])


def record_checksum(object_id: Column, payload: Column) -> Column:
    """CRC-32 over length, id and payload."""
    payload = payload.cast("binary")
    return F.crc32(F.concat(little_endian(F.octet_length(payload).cast("long")), little_endian(object_id), payload))


def record_bytes(size: Column, is_delete: Column) -> Column:
    """What an object takes before the trailer: nothing for a tombstone."""
    return F.when(is_delete, F.lit(0)).otherwise(size + HEADER).cast("long")


def pack_location(lsn: Column, is_delete: Column) -> Column:
    return F.shiftleft(lsn, 1).bitwiseOR(is_delete.cast("long"))


def unpack_lsn(packed: Column) -> Column:
    return F.shiftrightunsigned(packed, 1)


def unpack_is_delete(packed: Column) -> Column:
    return packed.bitwiseAND(F.lit(1)) == 1
