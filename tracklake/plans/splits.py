"""Best-first splitting of tracks, as one order that serves every budget.

A budgeted splitter keeps two ends, then again and again takes the best point of
any open interval and cuts the interval there.  Its first m picks are exactly the
m points with the largest *strength*, where the strength of a point is the
smallest priority on the way from the whole track down to its own cut.  So the
whole tree is computed once and any budget is a rank cut afterwards.

Tracks that fit a task are split inside one.  Longer ones are cut first by
distributed rounds (one aggregate per open interval) until every interval fits.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .groups import map_groups
from .materialize import materialize
from .ordered import hot_limit, is_hot, neighbors, rank_within, scan

_TOP = float("inf")


@dataclass(frozen=True)
class Measure:
    """Priority of an interior point, as a column and for arrays inside a task.

    ``columns`` are the point columns it reads; interval ends carry the same columns
    with the suffixes ``_l`` and ``_r``.
    """

    columns: tuple[str, ...]
    column: Callable[[], Column]
    array: Callable[[dict, dict, dict], np.ndarray]


def _line_column() -> Column:
    vy, vx = F.col("lat_r") - F.col("lat_l"), F.col("lon_r") - F.col("lon_l")
    y, x = F.col("lat") - F.col("lat_l"), F.col("lon") - F.col("lon_l")
    norm = vy * vy + vx * vx
    share = (y * vy + x * vx) / norm
    dy, dx = y - share * vy, x - share * vx
    return F.when(norm < 1e-12, F.sqrt(y * y + x * x)).otherwise(F.sqrt(dy * dy + dx * dx))


def _line_array(p: dict, left: dict, right: dict) -> np.ndarray:
    vy, vx = right["lat"] - left["lat"], right["lon"] - left["lon"]
    y, x = p["lat"] - left["lat"], p["lon"] - left["lon"]
    norm = vy * vy + vx * vx
    if norm < 1e-12:
        return np.sqrt(y * y + x * x)
    share = (y * vy + x * vx) / norm
    dy, dx = y - share * vy, x - share * vx
    return np.sqrt(dy * dy + dx * dx)


LINE_DISTANCE = Measure(("pos", "lat", "lon"), _line_column, _line_array)


def spread_score(bonus: float) -> Measure:
    """Score plus ``bonus`` times the distance to the nearer interval end, as a share of the track."""

    def column() -> Column:
        near = F.least(F.col("pos") - F.col("pos_l"), F.col("pos_r") - F.col("pos"))
        return F.col("score") + F.lit(bonus) * near / F.greatest(F.col("n_points") - 1, F.lit(1))

    def array(p: dict, left: dict, right: dict) -> np.ndarray:
        near = np.minimum(p["pos"] - left["pos"], right["pos"] - p["pos"])
        return p["score"] + bonus * near / np.maximum(p["n_points"] - 1, 1)

    return Measure(("pos", "score", "n_points"), column, array)


def _split_in_task(data: dict, anchors: np.ndarray, ceiling: float, measure: Measure) -> np.ndarray:
    """Strength of every row; ``anchors`` are row numbers of points that are kept anyway."""
    strength = np.full(len(data["pos"]), _TOP)
    open_intervals = [(a, b, ceiling) for a, b in zip(anchors[:-1], anchors[1:])]
    while open_intervals:
        a, b, top = open_intervals.pop()
        if b - a < 2:
            continue
        inner = {c: data[c][a + 1 : b] for c in measure.columns}
        ends = [{c: data[c][i] for c in measure.columns} for i in (a, b)]
        priority = measure.array(inner, *ends)
        best = int(np.argmax(priority))
        own = min(top, float(priority[best]))
        cut = a + 1 + best
        strength[cut] = own
        open_intervals += [(a, cut, own), (cut, b, own)]
    return strength


def _finish(points: DataFrame, keys: list[str], measure: Measure) -> DataFrame:
    """Split groups that fit a task; rows flagged ``_anchor`` are interval ends."""
    need = [*dict.fromkeys(["traj_id", *keys, *measure.columns, "_anchor", "_ceiling"])]

    def split(data: dict) -> dict:
        anchor = data["_anchor"].astype(bool)
        strength = _split_in_task(data, np.flatnonzero(anchor), float(data["_ceiling"][0]), measure)
        return {"traj_id": data["traj_id"][~anchor], "pos": data["pos"][~anchor], "strength": strength[~anchor]}

    return map_groups(points.select(*need), keys, "pos", split, "traj_id bigint, pos bigint, strength double")


def split_strength(points: DataFrame, measure: Measure, anchor: Column) -> DataFrame:
    """Strength of every point that is not an anchor: (traj_id, pos, strength).

    ``anchor`` must hold for the first and last point of every track.
    """
    cols = [*dict.fromkeys(["traj_id", "n_points", *measure.columns])]
    marked = points.select(*cols, anchor.alias("_anchor")).withColumn("_ceiling", F.lit(_TOP))
    if not is_hot(points, "traj_id"):
        return _finish(marked, ["traj_id"], measure)
    limit = hot_limit(points.sparkSession)
    done = _finish(marked.filter(F.col("n_points") <= limit), ["traj_id"], measure)
    rest = _split_long(marked.filter(F.col("n_points") > limit), measure, limit)
    return done.unionByName(rest)


def _split_long(points: DataFrame, measure: Measure, limit: int) -> DataFrame:
    """Rounds of one cut per wide interval until all intervals fit a task.

    Every point carries the start of its interval (``_lo``), so each round is an
    equi-join of points with one row per interval and one aggregate per interval.
    """
    whole = F.struct(*measure.columns)
    anchors = points.filter("_anchor").select("traj_id", whole.alias("lo"))
    anchors = rank_within(anchors, ["traj_id"], [F.col("lo.pos")], "_n", "traj_id")
    pairs = neighbors(anchors, ["traj_id"], "_n", {"hi": ("lo", 1)}, "traj_id").filter(F.col("hi").isNotNull())
    intervals = materialize(
        pairs.select("traj_id", F.col("lo.pos").alias("_lo"), "lo", "hi", F.lit(_TOP).alias("ceiling"))
    )
    placed = scan(points, ["traj_id"], "pos", {"_lo": ("last", F.when(F.col("_anchor"), F.col("pos")))}, "traj_id")
    inner = materialize(placed.filter(~F.col("_anchor")).select("traj_id", "_lo", *measure.columns))
    width = F.col("hi.pos") - F.col("lo.pos") - 1
    cuts = []
    while True:
        wide = intervals.filter(width > limit)
        if wide.isEmpty():
            break
        ends = [F.col(f"{side}.{c}").alias(f"{c}_{tag}") for side, tag in (("lo", "l"), ("hi", "r")) for c in measure.columns]
        scored = inner.join(wide.select("traj_id", "_lo", "lo", "hi", "ceiling", *ends), ["traj_id", "_lo"])
        scored = scored.withColumn("_p", measure.column())
        best = scored.groupBy("traj_id", "_lo").agg(
            F.max_by(
                F.struct(whole.alias("at"), "lo", "hi", F.least("ceiling", "_p").alias("own")),
                F.struct("_p", -F.col("pos")),
            ).alias("b")
        )
        cut = materialize(best.select("traj_id", "_lo", "b.*"))
        cuts.append(cut.select("traj_id", F.col("at.pos").alias("pos"), F.col("own").alias("strength")))
        place = F.col("_cut")
        inner = materialize(
            inner.join(cut.select("traj_id", "_lo", F.col("at.pos").alias("_cut")), ["traj_id", "_lo"], "left")
            .filter(place.isNull() | (F.col("pos") != place))
            .withColumn("_lo", F.when(F.col("pos") > place, place).otherwise(F.col("_lo")))
            .drop("_cut")
        )
        left = cut.select("traj_id", "_lo", "lo", F.col("at").alias("hi"), F.col("own").alias("ceiling"))
        right = cut.select("traj_id", F.col("at.pos").alias("_lo"), F.col("at").alias("lo"), "hi", F.col("own").alias("ceiling"))
        intervals = materialize(intervals.filter(width <= limit).unionByName(left).unionByName(right))
    open_now = intervals.filter(width > 0)
    rows = inner.join(open_now.select("traj_id", "_lo", F.col("ceiling").alias("_ceiling")), ["traj_id", "_lo"])
    rows = rows.withColumn("_anchor", F.lit(False))
    for side in ("lo", "hi"):
        end = open_now.select("traj_id", "_lo", f"{side}.*", F.col("ceiling").alias("_ceiling"), F.lit(True).alias("_anchor"))
        rows = rows.unionByName(end)
    out = _finish(rows, ["traj_id", "_lo"], measure)
    for part in cuts:
        out = out.unionByName(part)
    return out
