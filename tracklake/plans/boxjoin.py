"""Join of boxes in (t, lat, lon) with points or segments.

Space and time are cut into cells at eight levels of size each.  A box uses the finest
level at which it touches few cells, so wide boxes do not explode into thousands
of keys and narrow boxes do not match half the data.  The join is an equi-join on
(levels, cell); a pair that shares several cells is kept in exactly one of them, so
no distinct step is needed afterwards.

A few boxes are compared with every item directly: that takes less than giving each item
its keys.
"""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Finest cell sizes and the growth per level.
CELL_SECONDS = 3600.0
CELL_DEGREES = 0.05
GROWTH = 4
LEVELS = 8  # level 8 is one cell for everything
BOX_CELLS_PER_AXIS = 4
ITEM_CELLS_PER_AXIS = 2
BROADCAST_KEYS = 500_000
#: So many boxes are compared with every item; more are joined by cell.
FEW_BOXES = 32

AXES = ("t", "lat", "lon")
BOX_SPANS = {"t": ("t_start", "t_end"), "lat": ("lat_min", "lat_max"), "lon": ("lon_min", "lon_max")}
POINT_SPANS = {axis: (axis, axis) for axis in AXES}


def _finest(axis: str) -> float:
    return CELL_SECONDS if axis == "t" else CELL_DEGREES


def _cell(value: str, axis: str) -> Column:
    """Cell number at the level of the row; the last level is one cell."""
    sizes = [_finest(axis) * GROWTH**level for level in range(LEVELS)] + [float("inf")]
    level = F.col("_lt" if axis == "t" else "_ls")
    return F.floor(F.col(value) / F.element_at(F.lit(sizes), level + 1)).cast("bigint")


def _level(spans: dict, axes: tuple[str, ...], per_axis: int) -> Column:
    """Finest level at which the row touches at most ``per_axis`` cells on these axes."""
    steps = [(F.col(spans[a][1]) - F.col(spans[a][0])) / F.lit(_finest(a) * (per_axis - 1)) for a in axes]
    level = F.ceil(F.log(F.greatest(*steps, F.lit(1.0), F.lit(1.0))) / F.log(F.lit(float(GROWTH))))
    return F.when(level >= LEVELS, LEVELS).otherwise(level).cast("int")


def _meeting_levels(own: str, others: list[tuple[int, int]]) -> Column:
    """Levels (time, space) at which the row can meet the other side."""
    pairs = F.array(*[F.struct(F.lit(a).alias("t"), F.lit(b).alias("s")) for a, b in others])
    coarser = F.transform(
        pairs, lambda o: F.struct(F.greatest(F.col(f"{own}t"), o["t"]).alias("t"), F.greatest(F.col(f"{own}s"), o["s"]).alias("s"))
    )
    return F.array_distinct(coarser)


def _with_keys(df: DataFrame, spans: dict, levels: Column, prefix: str) -> DataFrame:
    """One row per (levels, touched cell), with the first touched cell of every axis."""
    out = df.withColumn("_lv", F.explode(levels)).withColumns({"_lt": F.col("_lv.t"), "_ls": F.col("_lv.s")}).drop("_lv")
    out = out.withColumns({f"{prefix}{a}": _cell(lo, a) for a, (lo, _) in spans.items()})
    for axis, (lo, hi) in spans.items():
        first = F.col(f"{prefix}{axis}")
        key = first if lo == hi else F.explode(F.sequence(first, F.greatest(first, _cell(hi, axis))))
        out = out.withColumn(f"_k{axis}", key)
    return out


def _levels_of(df: DataFrame, own: str, spans: dict) -> tuple[list[tuple[int, int]], dict, int]:
    """Levels in use (at most 81 rows reach the driver), the extent per axis and the number of rows."""
    aggs = [f(spans[a][k]).alias(f"{a}{k}") for a in AXES for k, f in ((0, F.min), (1, F.max))]
    aggs.append(F.count(F.lit(1)).alias("n"))
    rows = df.groupBy(F.col(f"{own}t").alias("_t"), F.col(f"{own}s").alias("_s")).agg(*aggs).collect()
    levels = sorted((r["_t"], r["_s"]) for r in rows) or [(LEVELS, LEVELS)]
    extent = {a: (min(r[f"{a}0"] for r in rows), max(r[f"{a}1"] for r in rows)) for a in AXES} if rows else {}
    return levels, extent, sum(r["n"] for r in rows)


def box_join(items: DataFrame, boxes: DataFrame, spans: dict = POINT_SPANS) -> DataFrame:
    """All (item, box) pairs whose bounding boxes overlap, with the columns of both sides.

    ``spans`` names the low and high column of the item per axis.  Column names of
    the two sides must differ.  ``boxes`` should be a written or otherwise cheap table:
    its levels are looked at once to size the plan.

    Time and space have levels of their own, so a box that is long and narrow is
    pruned on both.  The extent of all boxes goes to the scan of the items.  A pair meets at the coarser levels of its two sides.  Up to
    ``FEW_BOXES`` boxes are broadcast and compared with every item.  The keys of
    the boxes are broadcast only if their counted number is small; otherwise Spark
    shuffles both sides by cell and splits cells that are hot.
    """
    space = ("lat", "lon")
    boxes = boxes.withColumns(
        {"_q_lt": _level(BOX_SPANS, ("t",), BOX_CELLS_PER_AXIS), "_q_ls": _level(BOX_SPANS, space, BOX_CELLS_PER_AXIS)}
    )
    box_levels, extent, n_boxes = _levels_of(boxes, "_q_l", BOX_SPANS)
    for axis, (low, high) in extent.items():
        # plain comparisons on the item columns, so that a Parquet scan of items can skip row groups
        items = items.filter((F.col(spans[axis][0]) <= F.lit(high)) & (F.col(spans[axis][1]) >= F.lit(low)))
    if n_boxes <= FEW_BOXES:
        meets = [(F.col(lo) <= F.col(BOX_SPANS[a][1])) & (F.col(hi) >= F.col(BOX_SPANS[a][0])) for a, (lo, hi) in spans.items()]
        return items.join(F.broadcast(boxes.drop("_q_lt", "_q_ls")), reduce(and_, meets))
    is_point = all(lo == hi for lo, hi in spans.values())
    if is_point:
        items = items.withColumns({"_i_lt": F.lit(0), "_i_ls": F.lit(0)})
        item_levels = [(0, 0)]
    else:
        # one level for time and space: the possible levels are known without reading the items
        both = _level(spans, AXES, ITEM_CELLS_PER_AXIS)
        items = items.withColumns({"_i_lt": both, "_i_ls": both})
        item_levels = [(level, level) for level in range(LEVELS + 1)]
    left = _with_keys(items, spans, _meeting_levels("_i_l", box_levels), "_i_")
    right = _with_keys(boxes, BOX_SPANS, _meeting_levels("_q_l", item_levels), "_q_")
    keys = ["_lt", "_ls", *[f"_k{a}" for a in AXES]]
    if right.count() <= BROADCAST_KEYS:
        right = F.broadcast(right)
    pairs = left.join(right, keys)
    if not is_point:
        pairs = pairs.filter((F.col("_lt") == F.greatest("_i_lt", "_q_lt")) & (F.col("_ls") == F.greatest("_i_ls", "_q_ls")))
    for axis, (lo, hi) in spans.items():
        q_lo, q_hi = BOX_SPANS[axis]
        pairs = pairs.filter((F.col(lo) <= F.col(q_hi)) & (F.col(hi) >= F.col(q_lo)))
        if not is_point:
            pairs = pairs.filter(F.col(f"_k{axis}") == F.greatest(f"_i_{axis}", f"_q_{axis}"))
    return pairs.drop(*keys, *[f"{p}{a}" for p in ("_i_", "_q_") for a in (*AXES, "lt", "ls")])
