"""Bit arithmetic on bigint columns that stands for unsigned 64-bit arithmetic."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def zigzag(x: Column) -> Column:
    """Signed to unsigned (as wrapped bigint): 0, -1, 1, -2 to 0, 1, 2, 3."""
    return F.shiftleft(x, 1).bitwiseXOR(F.shiftright(x, 63))


def unzigzag(z: Column) -> Column:
    return F.shiftrightunsigned(z, 1).bitwiseXOR(-z.bitwiseAND(F.lit(1)))


def required_bits(x: Column) -> Column:
    """Bits of x read as unsigned; 0 for 0."""
    return F.when(x == 0, F.lit(0)).otherwise(F.length(F.bin(x)))


def packed_length(n: Column, width: Column) -> Column:
    """Bytes of n values of ``width`` bits packed without gaps."""
    return F.floor((n.cast("long") * width + 7) / 8).cast("long")


def difference(a: Column | str, b: Column | str) -> Column:
    """a - b, null where it leaves 64 bits.

    That is seen from halves, whose difference always fits: an overflow that is caught
    costs a stack trace a row, and a guard that may overflow itself can be hoisted out
    of its condition.
    """
    a, b = (F.col(x) if isinstance(x, str) else x for x in (a, b))
    half, rest = F.shiftright(a, 1) - F.shiftright(b, 1), a.bitwiseAND(F.lit(1)) - b.bitwiseAND(F.lit(1))
    over = (half > 2**62) | (half == 2**62) & (rest >= 0) | (half < -(2**62)) | (half == -(2**62)) & (rest < 0)
    return F.when(over, F.lit(None).cast("long")).otherwise(a - b)
