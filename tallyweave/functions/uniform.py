"""Seeded uniform numbers that depend on seed, mode and id alone, never on how rows are partitioned."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Bits of a hash, so that hash / 2^BITS is an exact double.
BITS = 52


def hash_bits(seed: int, mode: str, key: Column) -> Column:
    """The first 13 hexadecimal digits of md5(seed|mode|key) as BIGINT, so 0 to 2^52 - 1."""
    text = F.concat_ws("|", F.lit(str(seed)), F.lit(mode), key.cast("string"))
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, 13), 16, 10).cast("long")


def uniform(seed: int, mode: str, key: Column) -> Column:
    """In [0, 1)."""
    return hash_bits(seed, mode, key) / F.lit(float(1 << BITS))
