"""Exact quantiles with linear interpolation, without holding all values in one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .ordered import hot_limit, is_hot, order_index, rank_within


def _interpolate(rank0: Column, n: Column, value: Column, q: float) -> Column:
    """Aggregate that reads quantile ``q`` off rows with 0-based ranks in a group of ``n``."""
    place = F.lit(float(q)) * (n - 1)
    low = F.floor(place)
    below = F.max(F.when(rank0 == low, value))
    above = F.max(F.when(rank0 == F.least(low + 1, n - 1), value))
    share = F.max(place - low)
    return below + (above - below) * share


def quantiles(df: DataFrame, value: str, probs: dict[str, float], ties: list[str]) -> DataFrame:
    """One row with exact quantiles of ``value`` over the whole table (NULL if empty)."""
    data = df.filter(F.col(value).isNotNull()).select(value, *[t for t in ties if t != value])
    total = data.count()
    if total <= hot_limit(df.sparkSession):
        return data.agg(*[F.percentile(value, F.lit(float(q))).alias(name) for name, q in probs.items()])
    ranked = order_index(data, [F.col(value), *[F.col(t) for t in ties]], out="_rank")
    n = F.lit(total)
    picks = sorted({p for q in probs.values() for p in (int(q * (total - 1)), min(int(q * (total - 1)) + 1, total - 1))})
    return ranked.filter(F.col("_rank").isin(picks)).agg(
        *[_interpolate(F.col("_rank"), n, F.col(value), q).alias(name) for name, q in probs.items()]
    )


def quantiles_within(
    df: DataFrame, keys: list[str], value: str, probs: dict[str, float], ties: list[str], bound_key: str
) -> DataFrame:
    """Exact quantiles of ``value`` per key."""
    data = df.filter(F.col(value).isNotNull())
    if not is_hot(df, bound_key):
        return data.groupBy(*keys).agg(*[F.percentile(value, F.lit(float(q))).alias(n) for n, q in probs.items()])
    data = data.select(*keys, value, *[t for t in ties if t not in keys and t != value])
    ranked = rank_within(data, keys, [F.col(value), *[F.col(t) for t in ties]], "_rank", bound_key)
    sizes = data.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    ranked = ranked.join(sizes, keys).withColumn("_rank", F.col("_rank") - 1)
    return ranked.groupBy(*keys).agg(
        *[_interpolate(F.col("_rank"), F.col("_n"), F.col(value), q).alias(name) for name, q in probs.items()]
    )
