"""Uniforms made from keys: the same number for the same key in any engine and on any number of partitions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def digest(*keys: Column) -> Column:
    return F.md5(F.concat_ws(":", *[k.cast("string") for k in keys]))


def integer(*keys: Column) -> Column:
    """48-bit integer from the first 12 hex digits of the keys' md5."""
    return F.conv(F.substring(digest(*keys), 1, 12), 16, 10).cast("long")


def uniform(*keys: Column) -> Column:
    """In (0, 1): half a step above the 48-bit integer."""
    return (integer(*keys) + F.lit(0.5)) / F.lit(float(1 << 48))


def bytes_of(hexed: Column) -> Column:
    """array<int> of the 16 bytes of an md5 in hex."""
    return F.array(*[F.conv(F.substring(hexed, 2 * k + 1, 2), 16, 10).cast("int") for k in range(16)])
