"""64-bit unsigned object ids in a BIGINT: equality is as is, order is by the flipped sign bit."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SIGN = -(1 << 63)


def to_bits(unsigned: int) -> int:
    return unsigned - (1 << 64) if unsigned >= 1 << 63 else unsigned


def to_unsigned(bits: int) -> int:
    return bits + (1 << 64) if bits < 0 else bits


def order_key(object_id: Column) -> Column:
    """A BIGINT that sorts as the unsigned ids do."""
    return object_id.bitwiseXOR(F.lit(SIGN))


def as_decimal(object_id: Column) -> Column:
    """The unsigned value, for display."""
    d = object_id.cast("decimal(20,0)")
    return F.when(object_id < 0, d + F.lit(1 << 64).cast("decimal(20,0)")).otherwise(d).cast("decimal(20,0)")
