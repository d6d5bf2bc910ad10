"""Budgets and evenly spaced positions as join-free column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(v) -> Column:
    return v if isinstance(v, Column) else (F.col(v) if isinstance(v, str) else F.lit(v))


def budget(n="n_points", ratio: float | Column = 0.1) -> Column:
    """How many points of a track may be kept: at least 2, never more than there are."""
    n = _c(n)
    return F.least(n, F.greatest(F.lit(2), F.ceil(_c(ratio) * n))).cast("bigint")


def lattice(i: Column, n: Column, k: Column) -> Column:
    """Position of the i-th of k evenly spaced points (half to even)."""
    return F.rint(i * (n - 1) / F.greatest(k - 1, F.lit(1))).cast("bigint")


def is_evenly_spaced(pos="pos", n="n_points", k: Column | int = 2) -> Column:
    """Is ``pos`` one of k evenly spaced positions?  Only two places i can produce it."""
    pos, n, k = _c(pos), _c(n), _c(k)
    i = F.floor(pos * (k - 1) / F.greatest(n - 1, F.lit(1)))
    on = (lattice(i, n, k) == pos) | ((i + 1 <= k - 1) & (lattice(i + 1, n, k) == pos))
    return F.when(k <= 0, False).when(k >= n, True).when(k == 1, pos == 0).otherwise(on)


def distance_to_spaced(pos="pos", n="n_points", k: Column | int = 2) -> Column:
    """Positions to the nearest of k evenly spaced points; NULL if there are none."""
    pos, n, k = _c(pos), _c(n), _c(k)
    i = F.floor(pos * (k - 1) / F.greatest(n - 1, F.lit(1)))
    near = [F.abs(lattice(F.greatest(F.least(i + d, k - 1), F.lit(0)), n, k) - pos) for d in (-1, 0, 1, 2)]
    return F.when(k <= 0, None).when(k >= n, F.lit(0)).when(k == 1, pos).otherwise(F.least(*near)).cast("bigint")


def base_size(k: Column, fraction: float) -> Column:
    """Share of a budget spent on evenly spaced points."""
    fraction = min(1.0, max(0.0, fraction))
    if fraction == 0.0:
        return F.lit(0).cast("bigint")
    return F.least(k, F.greatest(F.lit(2), F.ceil(k * F.lit(fraction)))).cast("bigint")
