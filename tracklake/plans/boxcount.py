"""Counting the points in boxes, and finding first duplicates of boxes, without listing the pairs.

Each axis has two grids of cells, one shifted by half a cell against the other, with cells
of more than twice a box's span: a box lies wholly in a cell of one of them.  So every box
goes to one cell, every point to its eight cells per level of box sizes, and the rows
moved grow with points and boxes, not with the pairs.  All points that a box can hold
are in its cell, so tracks are counted there too.  Full cells are cut by track.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .boxjoin import AXES, BOX_SPANS
from .materialize import materialize

# Cell size per span, smallest cells, growth and number of levels.
CELL_PER_SPAN = 2.125
SMALLEST = {"t": 1.0, "lat": 1e-6, "lon": 1e-6}
GROWTH = 4.0
LEVELS = 8
EVERYTHING = -1  # level of boxes without finite span: one cell
CELL_POINTS = 100_000
BROADCAST_CELLS = 200_000
CELL_BOXES = 20_000
PAIRS_AT_ONCE = 500_000

KEYS = ["_lt", "_ls", *[f"_c{a}" for a in AXES]]


def _sizes(boxes: DataFrame) -> dict[str, float]:
    """Largest cell per axis: it holds the largest finite box."""
    span = {a: F.col(hi) - F.col(lo) for a, (lo, hi) in BOX_SPANS.items()}
    row = boxes.agg(*[F.max(F.when(span[a] < float("inf"), span[a])).alias(a) for a in AXES]).first()
    return {a: max((row[a] or 0.0) * CELL_PER_SPAN, SMALLEST[a]) for a in AXES}


def _level(axes: tuple[str, ...], sizes: dict[str, float]) -> Column:
    """Finest level whose cells hold the box on these axes."""
    spans = [(F.col(BOX_SPANS[a][1]) - F.col(BOX_SPANS[a][0])) * CELL_PER_SPAN / sizes[a] for a in axes]
    widest = F.greatest(*spans, F.lit(GROWTH**-LEVELS))
    level = F.floor(-F.log(widest) / F.log(F.lit(GROWTH)) + 1e-9)
    return F.when(~(widest < float("inf")), EVERYTHING).otherwise(F.greatest(level, F.lit(0))).cast("int")


def _cell(value: Column, axis: str, shift: Column, sizes: dict[str, float]) -> Column:
    """Twice the cell's number, plus one in the shifted grid."""
    level = F.col("_lt" if axis == "t" else "_ls")
    place = value / (F.lit(sizes[axis]) / F.pow(F.lit(GROWTH), level)) + shift * 0.5
    finite = (level != EVERYTHING) & (F.abs(place) < 4e18)
    return F.when(value.isNotNull(), F.when(finite, F.floor(place) * 2 + shift).otherwise(0)).cast("bigint")


def _boxes_in_cells(boxes: DataFrame, sizes: dict[str, float]) -> DataFrame:
    placed = boxes.withColumns({"_lt": _level(("t",), sizes), "_ls": _level(("lat", "lon"), sizes)})
    whole = F.lit(True)
    cells = {}
    for a, (lo, hi) in BOX_SPANS.items():
        plain = [_cell(F.col(c), a, F.lit(0), sizes) for c in (lo, hi)]
        shifted = [_cell(F.col(c), a, F.lit(1), sizes) for c in (lo, hi)]
        cells[f"_c{a}"] = F.when(plain[0] == plain[1], plain[0]).otherwise(shifted[0])
        whole = whole & ((plain[0] == plain[1]) | (shifted[0] == shifted[1]) | (F.col(lo) > F.col(hi)))
    return placed.withColumns(cells).withColumn("_whole", F.when(whole, True).otherwise(F.raise_error(F.lit("a box lies in no cell"))))


def _points_in_cells(points: DataFrame, levels: list[tuple[int, int]], sizes: dict[str, float]) -> DataFrame:
    pairs = F.array(*[F.struct(F.lit(t).alias("t"), F.lit(s).alias("s")) for t, s in levels])
    out = points.withColumn("_lv", F.explode(pairs)).withColumns({"_lt": F.col("_lv.t"), "_ls": F.col("_lv.s")}).drop("_lv")
    for a in AXES:
        grids = F.array(*[_cell(F.col(a), a, F.lit(s), sizes) for s in (0, 1)])
        out = out.withColumn(f"_c{a}", F.explode(F.array_distinct(grids)))
    return out


def _in_cells(points: DataFrame, boxes: DataFrame, work: Callable, schema: str) -> DataFrame:
    """``work(points, boxes)`` on the NumPy columns of every cell."""
    boxes = boxes.select("query_id", *[c for pair in BOX_SPANS.values() for c in pair]).dropna()
    sizes = _sizes(boxes)
    placed = materialize(_boxes_in_cells(boxes, sizes)).drop("_whole")
    levels = [tuple(r) for r in placed.select("_lt", "_ls").distinct().collect()]  # at most 100
    if not levels:
        return points.sparkSession.createDataFrame([], schema)
    used = placed.select(*KEYS).distinct()
    if used.count() <= BROADCAST_CELLS:
        used = F.broadcast(used)
    points = points.select("traj_id", "pos", *AXES)
    spread = materialize(_points_in_cells(points, levels, sizes).join(used, KEYS, "left_semi"))
    full = spread.groupBy(*KEYS).count().filter(F.col("count") > CELL_POINTS)
    full = full.select(*KEYS, F.ceil(F.col("count") / CELL_POINTS).cast("int").alias("_parts"))
    parts = F.coalesce("_parts", F.lit(1))
    spread = spread.join(F.broadcast(full), KEYS, "left").withColumn("_part", F.pmod(F.xxhash64("traj_id"), parts)).drop("_parts")
    every = placed.join(F.broadcast(full), KEYS, "left").withColumn("_part", F.explode(F.sequence(F.lit(0).cast("bigint"), (parts - 1).cast("bigint")))).drop("_parts")
    keys = [*KEYS, "_part"]

    def one(left: pa.Table, right: pa.Table) -> pa.Table:
        plain = [{c: table[c].to_numpy() for c in table.column_names if c not in keys} for table in (left, right)]
        return work(*plain)

    return spread.groupBy(*keys).cogroup(every.groupBy(*keys)).applyInArrow(one, schema)


def _by_time(points: dict) -> dict:
    order = np.argsort(points["t"], kind="stable")
    return {c: v[order] for c, v in points.items()}


def _inside(points: dict, boxes: dict) -> Iterator[tuple[int, int, int, np.ndarray]]:
    """Per box its number, the range of points (in the order of time) at its times, and which of those lie in it."""
    first, last = (np.searchsorted(points["t"], boxes[c], side) for c, side in (("t_start", "left"), ("t_end", "right")))
    lat_min, lat_max, lon_min, lon_max = (boxes[c] for c in ("lat_min", "lat_max", "lon_min", "lon_max"))
    for b, (i, j) in enumerate(zip(first, last)):
        if i < j:
            lat, lon = points["lat"][i:j], points["lon"][i:j]
            yield b, i, j, (lat >= lat_min[b]) & (lat <= lat_max[b]) & (lon >= lon_min[b]) & (lon <= lon_max[b])


def _count(points: dict, boxes: dict) -> pa.Table:
    points = _by_time(points)
    tracks, place = np.unique(points["traj_id"], return_inverse=True)
    seen = np.zeros(len(tracks), np.bool_)
    hits, ships = (np.zeros(len(boxes["query_id"]), np.int64) for _ in range(2))
    for b, i, j, mask in _inside(points, boxes):
        inside = place[i:j][mask]
        hits[b] = len(inside)
        seen[inside] = True
        ships[b] = np.count_nonzero(seen)
        seen[inside] = False
    return pa.table({"query_id": boxes["query_id"], "point_hits": hits, "track_hits": ships})


def _cover(points: dict, boxes: dict) -> pa.Table:
    points = _by_time(points)
    covered = np.zeros(len(points["t"]), np.bool_)
    for _, i, j, mask in _inside(points, boxes):
        covered[i:j] |= mask
    return pa.table({c: points[c][covered] for c in ("traj_id", "pos")})


def count_in_boxes(points: DataFrame, boxes: DataFrame) -> DataFrame:
    """Points and tracks (query_id, point_hits, track_hits) inside each box; boxes without points may be missing."""
    schema = f"query_id {dict(boxes.dtypes)['query_id']}, point_hits bigint, track_hits bigint"
    parts = _in_cells(points, boxes, _count, schema)
    return parts.groupBy("query_id").agg(F.sum("point_hits").alias("point_hits"), F.sum("track_hits").alias("track_hits"))


def covered_points(points: DataFrame, boxes: DataFrame) -> DataFrame:
    """(traj_id, pos) of the points that at least one box holds, once each."""
    types = dict(points.dtypes)
    return _in_cells(points, boxes, _cover, f"traj_id {types['traj_id']}, pos {types['pos']}").distinct()


def _first_of(later: dict, earlier: dict, limit: float) -> pa.Table:
    order = np.argsort(earlier["query_id"], kind="stable")
    earlier = {c: v[order] for c, v in earlier.items()}
    n, m = len(later["query_id"]), len(earlier["query_id"])
    first, iou, top = np.zeros(n, earlier["query_id"].dtype), np.zeros(n), np.zeros(n)
    step = max(1, PAIRS_AT_ONCE // max(m, 1))
    sides = [BOX_SPANS[a] for a in ("lat", "lon", "t")]

    def volume(boxes: dict) -> np.ndarray:
        out = np.ones(len(boxes["query_id"]))
        for lo, hi in sides:
            out = out * np.maximum(boxes[hi] - boxes[lo], 0.0)
        return out

    volumes, others = volume(later)[:, None], volume(earlier)[None, :]
    for a in range(0, n if m else 0, step):
        rows = slice(a, a + step)
        shared = np.ones((1, 1))
        for lo, hi in sides:
            shared = shared * np.maximum(np.minimum(later[hi][rows, None], earlier[hi]) - np.maximum(later[lo][rows, None], earlier[lo]), 0.0)
        union = volumes[rows] + others - shared
        valid = (earlier["query_id"] < later["query_id"][rows, None]) & ((volumes[rows] > 1e-12) | (others > 1e-12)) & (union > 1e-12)
        values = np.divide(shared, union, out=np.zeros_like(union), where=valid)
        at = np.argmax((values >= limit) & (values > 0), axis=1)
        first[rows], top[rows] = earlier["query_id"][at], values.max(axis=1)
        iou[rows] = values[np.arange(len(at)), at]
    met = (iou >= limit) & (iou > 0)
    some = top > 0
    return pa.table({"query_id": later["query_id"][some], "earlier_id": pa.array(first[some], mask=~met[some]), "iou": pa.array(iou[some], mask=~met[some]), "top": top[some]})


def first_duplicates(later: DataFrame, earlier: DataFrame, limit: float) -> DataFrame:
    """(query_id, earlier_id, iou, top): the first box of ``earlier`` with a smaller id whose IoU reaches ``limit``, and the largest IoU.

    Both sides lie in all cells, as large as the largest box, that they touch; a box may have several rows.
    """
    columns = ["query_id", *[c for pair in BOX_SPANS.values() for c in pair]]
    later, earlier = (boxes.select(*[F.col(c).alias(c) for c in columns]) for boxes in (later, earlier))  # both may come from one table
    largest = later.unionByName(earlier).agg(*[F.max(F.col(hi) - F.col(lo)).alias(a) for a, (lo, hi) in BOX_SPANS.items()]).first()
    keys = [f"_c{a}" for a in AXES]

    def in_grid(boxes: DataFrame) -> DataFrame:
        for a, (lo, hi) in BOX_SPANS.items():
            size = F.lit(max(largest[a] or 0.0, SMALLEST[a]))
            boxes = boxes.withColumn(f"_c{a}", F.explode(F.sequence(F.floor(F.col(lo) / size), F.floor(F.greatest(lo, hi) / size))))
        return boxes

    sides = [in_grid(later), in_grid(earlier)]
    for i, name in enumerate(("_a", "_b")):
        full = sides[i].groupBy(*keys).count().filter(F.col("count") > CELL_BOXES).select(*keys, F.ceil(F.col("count") / CELL_BOXES).cast("bigint").alias("_parts"))
        parts = F.coalesce("_parts", F.lit(1).cast("bigint"))
        cut = [F.pmod(F.xxhash64("query_id"), parts), F.explode(F.sequence(F.lit(0).cast("bigint"), parts - 1))]
        sides = [side.join(F.broadcast(full), keys, "left").withColumn(name, cut[k != i]).drop("_parts") for k, side in enumerate(sides)]
    keys = [*keys, "_a", "_b"]

    def one(left: pa.Table, right: pa.Table) -> pa.Table:
        plain = [{c: table[c].to_numpy() for c in table.column_names if c not in keys} for table in (left, right)]
        return _first_of(*plain, limit)

    kind = dict(earlier.dtypes)["query_id"]
    schema = f"query_id {kind}, earlier_id {kind}, iou double, top double"
    return sides[0].groupBy(*keys).cogroup(sides[1].groupBy(*keys)).applyInArrow(one, schema)
