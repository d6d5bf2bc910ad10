"""Exact nearest rows without comparing every query with every row.

Rows are dealt to the closest of a bounded number of pivots, sorted by their distance to
it, and cut into blocks of a bounded number of rows: a block is a ring around a pivot.
Distances to the pivots bound those to the rows of a block from both sides, so a query
knows, from the table of blocks alone, how far its k-th nearest row can be at most, and
which blocks can hold a closer one.  It first visits the one block that should hold the
nearest rows, then only those that can still improve its k-th distance.

Queries in one place have the same nearest rows but for their own row, so every place is
searched once, for one row more if a query skips its own, and each query takes its list
from there: the work grows with the places, not with the queries that stand on them.

Of rows in the same place only the ``k`` with the smallest values can be among the nearest
(one more if a query skips its own row), so no place is ever larger than that, whatever
share of the table stands on it.  Blocks that many queries visit are copied to as many
groups of queries as they need.  What reaches the driver are the pivots and one row per
block, both bounded.

Rows with a null or not finite coordinate, or without a value, take no part; queries with
such a coordinate get no rows.  Ties in the distance go to the smaller value.
"""

from __future__ import annotations

import math
from functools import reduce
from operator import and_

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .materialize import materialize
from .ordered import order_index

BLOCK_ROWS = 4096
#: Full blocks of a table at most; beyond that blocks have more rows.
MOST_BLOCKS = 65_536
MOST_PIVOTS = 1024
#: Places of one group that meet a block in a task.
VISIT_ROWS = 16_384
#: Numbers of a distance table that is held at a time.
TABLE = 2_000_000
#: Share by which bounds are widened against rounding.
SLACK = 1e-9


def finite(names: list[str]) -> Column:
    return reduce(and_, [F.col(c).isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")) for c in names])


def squared(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Squared distances of all rows of ``x`` to all rows of ``y``."""
    total = np.zeros((len(x), len(y)))
    for j in range(x.shape[1]):
        total += (x[:, j, None] - y[None, :, j]) ** 2
    return total


def _chunks(rows: int, width: int):
    step = max(1, TABLE // max(1, width))
    return ((low, min(rows, low + step)) for low in range(0, rows, step))


class _Best:
    """The nearest rows of one block for a batch of places."""

    def __init__(self, names: list[str], k: int):
        self.names, self.k = names, k

    def found(self, places: pd.DataFrame, block: pd.DataFrame):
        """Positions of places, squared distances, values and rows: the k nearest and their ties, within the limit of the place."""
        base, value, number = block[self.names].to_numpy(float), block["value"].to_numpy(float), block["_row"].to_numpy(np.int64)
        limit = places["_limit"].to_numpy(float) if "_limit" in places else np.full(len(places), np.inf)
        parts = [(np.zeros(0, np.int64), np.zeros(0), np.zeros(0), np.zeros(0, np.int64))]
        for low, high in _chunks(len(places), len(base)) if len(base) else ():
            d2 = squared(places.iloc[low:high][self.names].to_numpy(float), base)
            take = min(self.k, len(base))
            last = np.minimum(np.partition(d2, take - 1, axis=1)[:, take - 1], limit[low:high])
            at, row = np.nonzero((d2 <= last[:, None]) & np.isfinite(d2))
            parts.append((at + low, d2[at, row], value[row], number[row]))
        return tuple(np.concatenate(p) for p in zip(*parts))

    def rows(self, places: pd.DataFrame, block: pd.DataFrame) -> pd.DataFrame:
        at, d2, value, number = self.found(places, block)
        return pd.DataFrame({"_place": places["_place"].to_numpy()[at], "d2": d2, "value": value, "_row": number})

    def lists(self, places: pd.DataFrame, block: pd.DataFrame) -> pd.DataFrame:
        """One row per place: its coordinates, what was found, and the k-th squared distance as its limit."""
        at, d2, value, number = self.found(places, block)
        order = np.lexsort((value, d2, at))
        at, d2, value, number = at[order], d2[order], value[order], number[order]
        ends = np.searchsorted(at, np.arange(len(places)), side="right")
        starts = np.concatenate(([0], ends[:-1])).astype(np.int64)
        reached = ends - starts >= self.k
        kth = np.full(len(places), np.inf)
        kth[reached] = d2[starts[reached] + self.k - 1]
        out = places[["_place", *self.names, "_block"]].copy()
        out["_limit"] = np.minimum(places["_limit"].to_numpy(float), kth)
        for name, found in (("d2", d2), ("value", value), ("_row", number)):
            out[name] = [found[a:b] for a, b in zip(starts, ends)]
        return out


class PivotIndex:
    """Blocks of ``rows`` (ids, ``value``, coordinates) for searches of the ``k`` nearest.

    ``ids`` name a row and a query; with ``skip_own`` a query does not see the row of its own ids.
    """

    def __init__(self, rows: DataFrame, ids: list[str], names: list[str], k: int, skip_own: bool = False, block_rows: int = BLOCK_ROWS):
        self.ids, self.names, self.k, self.skip_own = ids, names, k, skip_own
        self.need = k + int(skip_own)
        same_place = Window.partitionBy(*names).orderBy("value", *ids)
        rows = rows.select(*ids, F.col("value").cast("double").alias("value"), *[F.col(c).cast("double").alias(c) for c in names])
        rows = rows.filter(finite([*names, "value"])).withColumn("_n", F.row_number().over(same_place)).filter(F.col("_n") <= self.need)
        self.kept = materialize(rows.withColumn("_row", F.monotonically_increasing_id()))
        self.total = self.kept.count()
        self.visits: list[DataFrame] = []
        self.small = self.total <= block_rows
        if not self.small:
            self._deal(max(block_rows, -(-self.total // MOST_BLOCKS)))

    def _deal(self, block_rows: int) -> None:
        names = self.names
        wanted = min(MOST_PIVOTS, max(1, math.isqrt(self.total)))
        first = self.kept.filter("_n = 1").select(*names).orderBy(F.xxhash64(*names), *names).limit(wanted)
        pivots = self.pivots = np.array([tuple(r) for r in first.collect()], float).reshape(-1, len(names))

        def place(batches):
            for pdf in batches:
                x, cell, far = pdf[names].to_numpy(float), np.zeros(len(pdf), np.int64), np.zeros(len(pdf))
                for low, high in _chunks(len(x), len(pivots)):
                    d2 = squared(x[low:high], pivots)
                    cell[low:high] = d2.argmin(axis=1)
                    far[low:high] = np.sqrt(d2.min(axis=1))
                yield pdf.assign(_cell=cell, _far=far)

        coordinates = ", ".join(["_row bigint, value double", *[f"{c} double" for c in names]])
        dealt = self.kept.select("_row", "value", *names).mapInPandas(place, f"{coordinates}, _cell bigint, _far double")
        dealt = order_index(dealt, ["_cell", "_far", "_row"], "_i")
        sizes = {r["_cell"]: r["count"] for r in dealt.groupBy("_cell").count().collect()}  # one row per pivot
        row, block, starts = 0, 0, []
        for c in range(len(pivots)):
            starts.append((row, block))
            row += sizes.get(c, 0)
            block += -(-sizes.get(c, 0) // block_rows)

        def of_cell(numbers: list[int]) -> Column:
            return F.element_at(F.lit(numbers).cast("array<bigint>"), (F.col("_cell") + 1).cast("int"))

        number = of_cell([b for _, b in starts]) + F.floor((F.col("_i") - of_cell([r for r, _ in starts])) / block_rows)
        self.blocked = materialize(dealt.withColumn("_block", number.cast("bigint")).drop("_i"))
        ring = self.blocked.groupBy("_block").agg(F.first("_cell").alias("cell"), F.min("_far").alias("lo"), F.max("_far").alias("hi"), F.count(F.lit(1)).alias("n"))
        self.table = ring.toPandas().sort_values("_block", ignore_index=True)  # one row per block

    def _bounds(self):
        """For coordinates: least and greatest possible distance to the rows of each block, and how far the k-th row is at most."""
        cell, lo, hi, n = (self.table[c].to_numpy() for c in ("cell", "lo", "hi", "n"))
        pivots, need = self.pivots, self.need

        def bounds(x: np.ndarray):
            to_pivot = np.sqrt(squared(x, pivots))
            to_block = to_pivot[:, cell]
            least = np.maximum.reduce([to_block - hi, lo - to_block, (to_block - to_pivot.min(axis=1)[:, None]) / 2, np.zeros_like(to_block)])
            most = to_block + hi
            if (n >= need).any():
                kth = most[:, n >= need].min(axis=1)
            else:
                order = most.argsort(axis=1)
                enough = n[order].cumsum(axis=1) >= need
                kth = np.where(enough.any(axis=1), np.take_along_axis(most, order, 1)[np.arange(len(x)), enough.argmax(axis=1)], np.inf)
            return least, most, kth

        return bounds

    def _meet(self, visits: DataFrame, best, schema: str) -> DataFrame:
        """Runs ``best`` on every block with the places that visit it, in groups of bounded size."""
        self.visits.append(visits)
        groups = visits.groupBy("_block").agg(F.ceil(F.count(F.lit(1)) / VISIT_ROWS).alias("_groups"))  # one row per block
        groups = F.broadcast(materialize(groups))
        left = visits.join(groups, "_block").withColumn("_g", F.pmod(F.xxhash64("_place"), "_groups")).drop("_groups")
        right = self.blocked.join(groups, "_block").withColumn("_g", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_groups") - 1))).drop("_groups")
        keys = ["_block", "_g"]
        return left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInPandas(lambda q, b: best(q, b), schema)

    def nearest(self, queries: DataFrame) -> DataFrame:
        """The k nearest rows of each query: ids, ``d2`` (squared distance) and ``value``."""
        return self.lists(queries).select(*self.ids, F.inline("near")).drop("_row")

    def lists(self, queries: DataFrame) -> DataFrame:
        """One row per query that has any: ids and ``near``, the k nearest rows as an array of (``d2``, ``value``, ``_row``), nearest first."""
        ids, names, near = self.ids, self.names, F.col("near")
        asked = queries.select(*ids, *[F.col(c).cast("double").alias(c) for c in names]).filter(finite(names))
        places = materialize(asked.select(*names).distinct().withColumn("_place", F.monotonically_increasing_id()))
        found = self._places(places).groupBy("_place").agg(F.array_sort(F.collect_list(F.struct("d2", "value", "_row"))).alias("near"))
        out = asked.join(places.join(found, "_place").drop("_place"), names)
        if self.skip_own:
            own = self.kept.select(*ids, F.col("_row").alias("_own"))
            out = out.join(own, ids, "left").withColumn("near", F.filter("near", lambda r: ~r["_row"].eqNullSafe(F.col("_own"))))
        return out.select(*ids, F.slice(near, 1, self.k).alias("near")).filter(F.size("near") > 0)

    def _places(self, places: DataFrame) -> DataFrame:
        """The nearest rows of each place: ``_place``, ``d2``, ``value`` and ``_row``."""
        names, flat = self.names, "_place bigint, d2 double, value double, _row bigint"
        asked, best = places.select("_place", *names), _Best(names, self.need)
        if self.small:
            base = places.sparkSession.sparkContext.broadcast(self.kept.toPandas())  # at most block_rows rows
            return self._first(asked.mapInPandas(lambda batches: (best.rows(pdf, base.value) for pdf in batches), flat))
        bounds, blocks = self._bounds(), self.table["_block"].to_numpy(np.int64)
        own = ", ".join(["_place bigint", *[f"{c} double" for c in names], "_block bigint, _limit double"])

        def home(batches):
            for pdf in batches:
                for low, high in _chunks(len(pdf), len(blocks)):
                    part = pdf.iloc[low:high]
                    least, most, kth = bounds(part[names].to_numpy(float))
                    at = np.where(least <= least.min(axis=1)[:, None], most, np.inf).argmin(axis=1)
                    yield part.assign(_block=blocks[at], _limit=kth * kth * (1 + SLACK))

        def others(batches):
            for pdf in batches:
                for low, high in _chunks(len(pdf), len(blocks)):
                    part = pdf.iloc[low:high]
                    least, most, _ = bounds(part[names].to_numpy(float))
                    open_ = least - SLACK * most <= np.sqrt(part["_limit"].to_numpy(float))[:, None]
                    open_ &= blocks[None, :] != part["_block"].to_numpy(np.int64)[:, None]
                    at, number = np.nonzero(open_)
                    yield part.iloc[at].assign(_block=blocks[number])

        listed = f"{own}, d2 array<double>, value array<double>, _row array<bigint>"
        met = materialize(self._meet(materialize(asked.mapInPandas(home, own)), best.lists, listed))
        rest = self._meet(materialize(met.drop("d2", "value", "_row").mapInPandas(others, own)), best.rows, flat)
        seen = met.select("_place", F.inline(F.arrays_zip("d2", "value", "_row")))
        return self._first(seen.unionByName(rest))

    def _first(self, found: DataFrame) -> DataFrame:
        w = Window.partitionBy("_place").orderBy("d2", "value")
        return found.withColumn("_n", F.row_number().over(w)).filter(F.col("_n") <= self.need).drop("_n")

    def visited_pairs(self) -> int:
        """Pairs of a place and a row whose distance the searches so far have computed (0 where all rows fit one block)."""
        if not self.visits:
            return 0
        visits = reduce(DataFrame.unionByName, [v.select("_block") for v in self.visits])
        rows = self.blocked.groupBy("_block").count()
        return visits.join(F.broadcast(rows), "_block").agg(F.sum("count")).first()[0] or 0
