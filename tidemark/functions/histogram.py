"""Log-linear latency buckets as column expressions: 32 buckets for each power of two, one per value below 64."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Buckets per power of two, and the number of decades in a profile.
SUB_BUCKETS, DECADES = 32, 8


def bucket_of(value: Column) -> Column:
    """Bucket number of a non-negative integer."""
    guess = F.floor(F.log2(F.greatest(value, F.lit(1)))).cast("int")
    # log2 in floating point may be one off next to a power of two
    top = F.when(_shift_right(value, guess) >= 2, guess + 1).when(_shift_right(value, guess) < 1, guess - 1).otherwise(guess)
    return F.when(value < 64, value).otherwise((top - 4) * SUB_BUCKETS + _shift_right(value, top - 5) - SUB_BUCKETS).cast("long")


def _shift_right(value: Column, bits: Column) -> Column:
    return F.call_function("shiftright", value, bits)


def _shift_left(value: Column, bits: Column) -> Column:
    return F.call_function("shiftleft", value, bits)


def lower_of(bucket: Column) -> Column:
    """Smallest value of a bucket."""
    power = F.floor(bucket / SUB_BUCKETS).cast("int") - 1
    return F.when(bucket < 64, bucket).otherwise(_shift_left(SUB_BUCKETS + bucket % SUB_BUCKETS, power)).cast("long")


def width_of(bucket: Column) -> Column:
    """Number of values in a bucket."""
    power = F.floor(bucket / SUB_BUCKETS).cast("int") - 1
    return F.when(bucket < 64, F.lit(1).cast("long")).otherwise(_shift_left(F.lit(1).cast("long"), power))


def decade_of(bucket: Column) -> Column:
    """Power of ten of the bucket's smallest value, 7 at most."""
    return F.least(F.length(lower_of(bucket).cast("string")) - 1, F.lit(DECADES - 1))
