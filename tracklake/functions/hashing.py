"""Repeatable pseudo-random numbers that do not depend on partitioning."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def unit_hash(*parts) -> Column:
    """SHA-256 of the parts joined by '|'; its first 8 bytes as a number in [0, 1)."""
    cols = [p if isinstance(p, Column) else F.lit(str(p)) for p in parts]
    digest = F.sha2(F.concat_ws("|", *[c.cast("string") for c in cols]), 256)
    number = F.conv(F.substring(digest, 1, 16), 16, 10).cast("decimal(20,0)").cast("double")
    return number / F.lit(float(2**64))


def fast_unit_hash(*parts) -> Column:
    """Cheaper 63-bit hash in (0, 1) for per-point draws."""
    cols = [p if isinstance(p, Column) else F.lit(p) for p in parts]
    return (F.xxhash64(*cols).bitwiseAND(F.lit((1 << 53) - 1)) + F.lit(0.5)) / F.lit(float(2**53))
