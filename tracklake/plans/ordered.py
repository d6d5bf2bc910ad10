"""Ordered work per key that stays balanced when one key holds much of the data.

A window over ``partitionBy(key)`` puts each key into one task.  That is the best
plan while every key is small, and a dead end when one vessel or track holds a
third of all rows.  Each helper below therefore has two plans with equal results:

* *plain*: one window per key, used when the largest key is known to fit a task;
* *split*: the key is cut into pieces (runs of positions, or ranges of a global
  sort) so that no task ever sees more than a bounded number of rows.

The largest key is known from column metadata (``max_rows``), written once by
``with_bound`` and carried along by Spark; without it one map-side-combined count
is run.  The metadata is an upper bound, so it stays valid after filters.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .materialize import materialize

#: Rows of one partition of a global sort; far below the 2^33 that its positions can hold.
MOST_PARTITION_ROWS = 50_000_000
HOT_ROWS_CONF = "spark.tracklake.hotRows"
PIECE_ROWS_CONF = "spark.tracklake.pieceRows"


def hot_limit(spark: SparkSession) -> int:
    """Largest number of rows of one key that a single task may sort."""
    return int(spark.conf.get(HOT_ROWS_CONF, "5000000"))


def piece_rows(spark: SparkSession) -> int:
    """Number of consecutive positions in one piece of a hot key."""
    return int(spark.conf.get(PIECE_ROWS_CONF, "1000000"))


def max_rows(df: DataFrame, key: str) -> int:
    """Upper bound of the number of rows that share one value of ``key``."""
    known = df.schema[key].metadata.get("max_rows")
    if known is not None:
        return int(known)
    top = df.groupBy(key).count().agg(F.max("count")).first()[0]
    return int(top or 0)


def with_bound(df: DataFrame, key: str, bound: int | None = None) -> DataFrame:
    """Record the size of the largest key in the metadata of ``key``."""
    bound = max_rows(df, key) if bound is None else int(bound)
    return df.withMetadata(key, {**df.schema[key].metadata, "max_rows": bound})


def is_hot(df: DataFrame, key: str) -> bool:
    return max_rows(df, key) > hot_limit(df.sparkSession)


def order_index(df: DataFrame, order: list[Column | str], out: str = "idx") -> DataFrame:
    """Dense 0-based position of every row in a total order over the whole table.

    A range shuffle sorts the table; ``monotonically_increasing_id`` then holds the
    partition number and the row number inside it.  The sorted rows are written
    once, so that counting the partitions and using the counts see the same cut.
    Only one count per partition reaches the driver.
    """
    part = F.shiftright("_place", 33)

    def sorted_by(*number: int) -> tuple[DataFrame, dict[int, int]]:
        placed = df.repartitionByRange(*number, *order).sortWithinPartitions(*order)
        placed = materialize(placed.withColumn("_place", F.monotonically_increasing_id()))
        return placed, {r["p"]: r["count"] for r in placed.groupBy(part.alias("p")).count().collect()}

    ranked, sizes = sorted_by()
    if max(sizes.values(), default=0) > MOST_PARTITION_ROWS:  # the session's number of partitions is too small for this table
        ranked, sizes = sorted_by(-(-2 * sum(sizes.values()) // MOST_PARTITION_ROWS))
    offsets, total = [], 0
    for p in range(max(sizes, default=0) + 1):
        offsets.append(total)
        total += sizes.get(p, 0)
    start = F.element_at(F.lit(offsets).cast("array<bigint>"), (part + 1).cast("int"))
    return ranked.withColumn(out, start + F.col("_place").bitwiseAND(F.lit((1 << 33) - 1))).drop("_place")


def rank_within(df: DataFrame, keys: list[str], order: list[Column], out: str, bound_key: str | None) -> DataFrame:
    """1-based rank of each row inside its ``keys`` group; ``order`` must be total.

    ``bound_key`` is the key column whose ``max_rows`` bounds the group size;
    ``None`` means that nothing is known and the global sort is used.
    """
    if bound_key is not None and not is_hot(df, bound_key):
        w = Window.partitionBy(*keys).orderBy(*order)
        return df.withColumn(out, F.row_number().over(w).cast("bigint"))
    ranked = order_index(df, [*(F.col(k) for k in keys), *order], out="_rank_at")
    first = ranked.groupBy(*keys).agg(F.min("_rank_at").alias("_rank_from"))
    place = F.col("_rank_at") - F.col("_rank_from") + 1
    return ranked.join(first, keys).withColumn(out, place).drop("_rank_at", "_rank_from")


def neighbors(
    df: DataFrame,
    keys: list[str],
    order: str,
    wanted: dict[str, tuple[str | Column, int]],
    bound_key: str,
) -> DataFrame:
    """Values of earlier (negative offset) or later rows of the same key.

    For a hot key ``order`` must be a dense position.  Each piece then also gets
    the few rows next to its edges, so the pieces need no join afterwards.
    """

    def add(d: DataFrame, cols: list[str]) -> DataFrame:
        w = Window.partitionBy(*cols).orderBy(order)
        out = {}
        for name, (value, offset) in wanted.items():
            out[name] = F.lag(value, -offset).over(w) if offset < 0 else F.lead(value, offset).over(w)
        return d.withColumns(out)

    if not is_hot(df, bound_key):
        return add(df, keys)
    size = max(piece_rows(df.sparkSession), 8)
    halo = max(abs(o) for _, o in wanted.values())
    home = F.floor(F.col(order) / size)
    offset = F.col(order) - home * size
    pieces = F.array_compact(
        F.array(home, F.when((offset < halo) & (home > 0), home - 1), F.when(offset >= size - halo, home + 1))
    )
    spread = df.withColumn("_piece", F.explode(pieces))
    return add(spread, [*keys, "_piece"]).filter(F.col("_piece") == home).drop("_piece")


def scan(
    df: DataFrame, keys: list[str], order: str, wanted: dict[str, tuple[str, str | Column]], bound_key: str
) -> DataFrame:
    """Running values along ``order`` inside each key.

    ``wanted`` maps a column name to (kind, value):
    ``sum`` running total including this row; ``last`` / ``next`` the nearest
    non-NULL value at or before / at or after this row; ``last_before`` /
    ``next_after`` the same without this row.
    """

    def add(d: DataFrame, cols: list[str], by: str, outer: bool = False) -> DataFrame:
        up = Window.partitionBy(*cols).orderBy(F.col(by).asc())
        down = Window.partitionBy(*cols).orderBy(F.col(by).desc())
        upto, before = (Window.unboundedPreceding, 0), (Window.unboundedPreceding, -1)
        out = {}
        for name, (kind, value) in wanted.items():
            value = F.col(f"_v_{name}") if outer else (F.col(value) if isinstance(value, str) else value)
            frame = before if outer or kind in ("last_before", "next_after") else upto
            w = (down if kind.startswith("next") else up).rowsBetween(*frame)
            agg = F.sum(value) if kind == "sum" else F.last(value, ignorenulls=True)
            out[f"_c_{name}" if outer else name] = agg.over(w)
        return d.withColumns(out)

    if not is_hot(df, bound_key):
        return add(df, keys, order)
    piece = F.floor(F.col(order) / piece_rows(df.sparkSession))
    parts = df.withColumn("_piece", piece)
    cols = [*keys, "_piece"]
    local = add(parts, cols, order)
    edge_aggs = []
    for name, (kind, value) in wanted.items():
        value = F.col(value) if isinstance(value, str) else value
        if kind == "sum":
            agg = F.sum(value)
        else:
            pick = F.max_by if kind.startswith("last") else F.min_by
            agg = pick(value, F.when(value.isNotNull(), F.col(order)))
        edge_aggs.append(agg.alias(f"_v_{name}"))
    edges = parts.groupBy(*cols).agg(*edge_aggs)
    carried = add(edges, keys, "_piece", outer=True).drop(*[f"_v_{n}" for n in wanted])
    out = local.join(carried, cols, "left")
    done = {}
    for name, (kind, _) in wanted.items():
        carry = F.col(f"_c_{name}")
        if kind == "sum":
            done[name] = F.when(
                F.col(name).isNull() & carry.isNull(), F.lit(None)
            ).otherwise(F.coalesce(name, F.lit(0)) + F.coalesce(carry, F.lit(0)))
        else:
            done[name] = F.coalesce(F.col(name), carry)
    return out.withColumns(done).drop("_piece", *[f"_c_{n}" for n in wanted])


def attach(df: DataFrame, keys: list[str], aggs: dict[str, Column], bound_key: str) -> DataFrame:
    """Add aggregates of the whole key to each of its rows."""
    if not is_hot(df, bound_key):
        w = Window.partitionBy(*keys)
        return df.withColumns({name: agg.over(w) for name, agg in aggs.items()})
    totals = df.groupBy(*keys).agg(*[agg.alias(name) for name, agg in aggs.items()])
    return df.join(totals, keys)


def first_overall(df: DataFrame, order: list[Column], count: int) -> DataFrame:
    """The first ``count`` rows of the whole table in a total order, unsorted."""
    if count <= 0:
        return df.limit(0)
    return order_index(df, order, out="_idx").filter(F.col("_idx") < count).drop("_idx")
