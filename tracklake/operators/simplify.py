"""Choosing the kept points of every track under a budget.

Every selector takes POINTS (with a ``score`` column where it needs one) and
returns the kept rows as (traj_id, pos).  Ties go to the earlier position.
"""

from __future__ import annotations

import heapq
from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.hashing import fast_unit_hash
from ..functions.spacing import base_size, budget, distance_to_spaced, is_evenly_spaced
from ..plans.groups import map_groups
from ..plans.materialize import materialize
from ..plans.ordered import attach, first_overall, hot_limit, is_hot, max_rows, piece_rows, rank_within
from ..plans.splits import LINE_DISTANCE, split_strength, spread_score

TRACK = ["traj_id"]
BLOCK_SIZE = 32
# Largest skeleton share per ratio, score modes, gain weight of block picks.
SKELETON_SHARES = ((0.01, 0.50), (0.02, 0.40), (0.05, 0.25), (0.10, 0.20))
SKELETON_SHARE_ABOVE = 0.15
SCORE_MODES = ("rank", "rank_tie", "raw", "sigmoid", "temperature_sigmoid", "zscore_sigmoid", "rank_confidence")
GEOMETRY_WEIGHT = 0.12
BLOCK_BLEND = 0.05
WEIGHT_FLOOR = 0.5
KM_PER_DEGREE = 111.32
LEAST_COSINE = 0.10


def _kept(df: DataFrame) -> DataFrame:
    return df.select("traj_id", "pos")


def _ends() -> Column:
    return (F.col("pos") == 0) | (F.col("pos") == F.col("n_points") - 1)


def _ranked(points: DataFrame, order: list[Column], out: str, keys: list[str] = TRACK) -> DataFrame:
    return rank_within(points, keys, [*order, F.col("pos")], out, "traj_id")


def _by_score() -> Column:
    return F.col("score").desc()


# ---- single-track budgets -------------------------------------------------------------


def evenly_spaced(points: DataFrame, k: int) -> DataFrame:
    return _kept(points.filter(is_evenly_spaced(k=k)))


def simplify_uniform(points: DataFrame, ratio: float) -> DataFrame:
    """Evenly spaced positions at the budget; a filter, without shuffle."""
    return _kept(points.filter(is_evenly_spaced(k=budget(ratio=ratio))))


def topk(points: DataFrame, k: Column | int) -> DataFrame:
    """The k best scores of every track."""
    k = k if isinstance(k, Column) else F.lit(k)
    return _kept(_ranked(points, [_by_score()], "_r").filter(F.col("_r") <= k))


def simplify_by_score(points: DataFrame, ratio: float) -> DataFrame:
    """Top scores at the budget, plus both ends (which may exceed the budget)."""
    ranked = _ranked(points, [_by_score()], "_r")
    return _kept(ranked.filter((F.col("_r") <= budget(ratio=ratio)) | _ends()))


def simplify_oracle(points: DataFrame, ratio: float, label: str = "label") -> DataFrame:
    """Additive greedy on labels; not an exact optimum."""
    return simplify_by_score(points.withColumn("score", F.coalesce(F.col(label), F.lit(0.0))), ratio)


# ---- budgets shared by all tracks -------------------------------------------------------


def _total_budget(points: DataFrame, ratio: float, base: Column) -> tuple[int, int]:
    """(summed budget, summed base size), from one row per track."""
    heads = points.filter(F.col("pos") == 0).select("n_points")
    row = heads.agg(F.sum(budget(ratio=ratio)).alias("b"), F.sum(base).alias("s")).first()
    total, skeleton = int(row["b"] or 0), int(row["s"] or 0)
    return max(total, skeleton), skeleton


def _fill_anywhere(points: DataFrame, base: Column, missing: int) -> DataFrame:
    """Base points plus the ``missing`` best-scored other points of the whole table."""
    chosen = points.filter(base)
    rest = points.filter(~base & F.col("score").isNotNull()).select("traj_id", "pos", "score")
    best = first_overall(rest, [_by_score(), F.col("traj_id"), F.col("pos")], missing)
    return _kept(chosen).unionByName(_kept(best))


def simplify_global_budget(points: DataFrame, ratio: float, min_points: int = 2) -> DataFrame:
    """A small skeleton per track, the rest of the summed budget to the best points anywhere."""
    size = F.least(F.col("n_points"), F.lit(max(0, min_points)))
    total, skeleton = _total_budget(points, ratio, size)
    return _fill_anywhere(points, is_evenly_spaced(k=size), total - skeleton)


def simplify_global_fill(
    points: DataFrame, ratio: float, temporal_fraction: float = 0.5, bonus: float = 0.0
) -> DataFrame:
    """An evenly spaced base per track, residual budget to the best points anywhere."""
    k = base_size(budget(ratio=ratio), temporal_fraction)
    total, base = _total_budget(points, ratio, k)
    if bonus > 0 and temporal_fraction > 0:
        share = distance_to_spaced(k=k) / F.greatest(F.col("n_points") - 1, F.lit(1))
        points = points.withColumn("score", F.col("score") + F.lit(bonus) * share)
    return _fill_anywhere(points, is_evenly_spaced(k=k), total - base)


# ---- base plus score, per track ---------------------------------------------------------


def _fill_priority(points: DataFrame, base: Column, bonus: float) -> DataFrame:
    """Add ``_prio``, the order in which non-base points are added."""
    if bonus <= 0:
        return points.withColumn("_prio", F.col("score"))
    strength = split_strength(points, spread_score(bonus), base)
    both = points.join(strength, ["traj_id", "pos"], "left")
    return both.withColumn("_prio", F.col("strength")).drop("strength")


def simplify_hybrid(
    points: DataFrame,
    ratio: float,
    temporal_fraction: float = 0.5,
    bonus: float = 0.0,
    mode: str = "fill",
    center_weight: float = 0.0,
    min_swaps: int = 0,
) -> DataFrame:
    """Evenly spaced base combined with scores; see the mode functions below."""
    if mode == "global_fill":
        return simplify_global_fill(points, ratio, temporal_fraction, bonus)
    if mode == "global_budget":
        return simplify_global_budget(points, ratio)
    if mode == "fill":
        return _hybrid_fill(points, ratio, temporal_fraction, bonus)
    if mode == "swap":
        return _hybrid_swap(points, ratio, temporal_fraction, bonus, min_swaps)
    if mode in ("local_swap", "local_delta_swap"):
        return _hybrid_matched(points, ratio, temporal_fraction, bonus, min_swaps, mode)
    if mode == "stratified":
        return _hybrid_stratified(points, ratio, center_weight)
    raise ValueError(f"unknown mode: {mode!r}")


def _hybrid_fill(points: DataFrame, ratio: float, fraction: float, bonus: float) -> DataFrame:
    """Base first, the remaining slots by score (plus bonus for distance to kept points)."""
    k = budget(ratio=ratio)
    size = base_size(k, fraction)
    base = is_evenly_spaced(k=size)
    if bonus > 0 and fraction <= 0:
        # nothing is kept yet: the first pick is the best score, and opens the intervals
        return _fill_from_nothing(points, ratio, bonus)
    prio = _fill_priority(points, base, bonus).withColumn("_base", base)
    ranked = _ranked(prio, [F.col("_base").desc(), F.col("_prio").desc()], "_r")
    return _kept(ranked.filter(F.col("_r") <= k))


def _fill_from_nothing(points: DataFrame, ratio: float, bonus: float) -> DataFrame:
    """First pick by score alone, later picks by score plus distance to the picks."""
    first = _ranked(points, [_by_score()], "_r").withColumn("_first", F.col("_r") == 1).drop("_r")
    # Two far-away ends make the open sides of the first pick one-sided intervals.
    far = F.col("n_points") * 4
    ends = first.filter("_first").select("traj_id", "n_points", F.explode(F.array(-far, far)).alias("pos"))
    ends = ends.withColumns({"score": F.lit(None).cast("double"), "_first": F.lit(True)})
    framed = first.select("traj_id", "n_points", "pos", "score", "_first").unionByName(ends)
    strength = split_strength(framed, spread_score(bonus), F.col("_first"))
    both = first.join(strength, ["traj_id", "pos"], "left")
    ranked = _ranked(both, [F.col("_first").desc(), F.col("strength").desc()], "_r")
    return _kept(ranked.filter(F.col("_r") <= budget(ratio=ratio)))


def swap_count(k: Column, n: Column, fraction: float, min_swaps: int) -> Column:
    """How many base points may be exchanged; ends are never removable."""
    protected = F.least(k, F.greatest(F.lit(2), F.ceil(k * F.lit(min(1.0, max(0.0, fraction))))))
    swaps = F.least(k - protected, n - k)
    if min_swaps > 0:
        swaps = F.greatest(swaps, F.lit(min_swaps))
    return F.greatest(F.least(swaps, k - 2, n - k), F.lit(0)).cast("bigint")


def _hybrid_swap(points: DataFrame, ratio: float, fraction: float, bonus: float, min_swaps: int) -> DataFrame:
    """Replace the lowest-scored removable base points by the best other points."""
    k = budget(ratio=ratio)
    base = is_evenly_spaced(k=k)
    swaps = swap_count(k, F.col("n_points"), fraction, min_swaps)
    both = _fill_priority(points, base, bonus).withColumns({"_base": base, "_removable": base & ~_ends()})
    both = _ranked(both, [F.col("_removable").desc(), F.col("score").asc()], "_out")
    both = _ranked(both, [F.col("_base").asc(), F.col("_prio").desc()], "_in")
    removed = F.col("_removable") & (F.col("_out") <= swaps)
    added = ~F.col("_base") & (F.col("_in") <= swaps)
    return _kept(both.filter((F.col("_base") & ~removed) | added))


def _hybrid_stratified(points: DataFrame, ratio: float, center_weight: float) -> DataFrame:
    """Both ends, and the best score in each of k-2 equal strata."""
    k, n, pos = budget(ratio=ratio), F.col("n_points"), F.col("pos")
    m, c = k - 2, n - 2
    safe_m, safe_c = F.greatest(m, F.lit(1)), F.greatest(c, F.lit(1))
    stratum = F.floor((pos * m - 1) / safe_c)
    left, right = 1 + F.floor(stratum * c / safe_m), 1 + F.floor((stratum + 1) * c / safe_m)
    off = F.abs(pos - (left + right - 1) * 0.5) / F.greatest(F.lit(1.0), (right - left) * 0.5)
    inner = ~_ends() & (m > 0)
    judged = points.withColumns(
        {
            "_stratum": F.when(inner, stratum).otherwise(F.lit(-1)),
            "_adjusted": F.col("score") - F.lit(max(0.0, center_weight)) * off,
        }
    )
    ranked = _ranked(judged, [F.col("_adjusted").desc()], "_r", ["traj_id", "_stratum"])
    return _kept(ranked.filter((k >= n) | _ends() | (inner & (F.col("_r") == 1))))


class _Free:
    """Positions that can be taken once each; the nearest free one is found without a scan.

    ``up[i]`` and ``down[i]`` lead to the next free slot on either side; paths are halved
    on the way, as in a union-find forest.
    """

    def __init__(self, places: np.ndarray):
        self.places = places
        self.up, self.down = list(range(len(places) + 1)), list(range(len(places) + 1))

    @staticmethod
    def _root(links: list[int], i: int) -> int:
        while links[i] != i:
            links[i] = links[links[i]]
            i = links[i]
        return i

    def nearest(self, place: int) -> int:
        """Slot of the nearest free position, the left one of two equally near; -1 if none is free."""
        i = int(np.searchsorted(self.places, place))
        right = self._root(self.up, i)
        left = self._root(self.down, i) - 1  # ``down`` is shifted by one, so that 0 means none
        if right == len(self.places):
            return left
        return left if left >= 0 and place - self.places[left] <= self.places[right] - place else right

    def take(self, slot: int) -> None:
        self.up[slot] = slot + 1
        self.down[slot + 1] = slot


def _local_swap(score: np.ndarray, base: np.ndarray, adds: np.ndarray) -> tuple[list[int], list[int]]:
    """Each addition, best first, evicts the nearest base point still removable."""
    free, added, gone = _Free(base), [], []
    for a in adds[np.lexsort((adds, -score[adds]))].tolist():
        slot = free.nearest(a)
        if slot < 0:
            break
        free.take(slot)
        added.append(a)
        gone.append(int(base[slot]))
    return added, gone


def _local_delta_swap(score: np.ndarray, base: np.ndarray, others: np.ndarray, count: int) -> tuple[list[int], list[int]]:
    """Again and again the best positive gain of a candidate over its nearest base point.

    Candidates wait in a heap by their gain.  A candidate whose base point was taken is
    judged again against its next one when it comes up; it may only have gained by that, so
    those that wait for a base point are judged as soon as it is taken.
    """
    free, added, gone = _Free(base), [], []
    waiting: dict[int, list[int]] = {}
    heap: list[tuple[float, int, int]] = []

    def judge(c: int) -> None:
        slot = free.nearest(c)
        if slot >= 0:
            heapq.heappush(heap, (-(score[c] - score[base[slot]]), c, slot))
            waiting.setdefault(slot, []).append(c)

    for c in others.tolist():
        judge(c)
    used: set[int] = set()
    while heap and len(added) < count:
        loss, c, slot = heapq.heappop(heap)
        if c in used or free.up[slot] != slot:
            continue
        if loss >= 0:
            break
        free.take(slot)
        used.add(c)
        added.append(c)
        gone.append(int(base[slot]))
        for other in waiting.pop(slot, ()):
            if other not in used:
                judge(other)
    return added, gone


def _require_bounded(points: DataFrame, what: str) -> None:
    if max_rows(points, "traj_id") > hot_limit(points.sparkSession):
        raise ValueError(f"{what} works on one track per task; a track exceeds spark.tracklake.hotRows, cut it first")


def _hybrid_matched(
    points: DataFrame, ratio: float, fraction: float, bonus: float, min_swaps: int, mode: str
) -> DataFrame:
    """Swaps in which every addition evicts a base point close to it."""
    _require_bounded(points, mode)
    k = budget(ratio=ratio)
    base = is_evenly_spaced(k=k)
    swaps = swap_count(k, F.col("n_points"), fraction, min_swaps)
    ready = _fill_priority(points, base, bonus if mode == "local_swap" else 0.0).select(
        "traj_id", "pos", "n_points", "score", "_prio", base.alias("_base"), swaps.alias("_swaps")
    )

    def choose(data: dict) -> dict:
        score, prio, keep = data["score"], data["_prio"], data["_base"].astype(bool)
        count, last = int(data["_swaps"][0]), len(score) - 1
        removable = np.setdiff1d(np.flatnonzero(keep), [0, last])
        others = np.flatnonzero(~keep)
        if count > 0:
            if mode == "local_swap":
                added, gone = _local_swap(score, removable, others[np.lexsort((others, -prio[others]))][:count])
            else:
                added, gone = _local_delta_swap(score, removable, others, count)
            keep[gone], keep[added] = False, True
        return {"traj_id": data["traj_id"][keep], "pos": data["pos"][keep]}

    return map_groups(ready, TRACK, "pos", choose, "traj_id bigint, pos bigint")


# ---- geometry ---------------------------------------------------------------------------


def line_split_strength(points: DataFrame) -> DataFrame:
    """Order of the budgeted line splitter, valid for every ratio: (traj_id, pos, strength)."""
    return split_strength(points, LINE_DISTANCE, _ends())


def simplify_douglas_peucker(points: DataFrame, ratio: float, strength: DataFrame | None = None) -> DataFrame:
    """Both ends, then the points that lie farthest from the line of their interval."""
    strength = line_split_strength(points) if strength is None else strength
    both = points.select("traj_id", "pos", "n_points").join(strength, ["traj_id", "pos"], "left")
    both = both.withColumn("_end", _ends())
    ranked = _ranked(both, [F.col("_end").desc(), F.col("strength").desc()], "_r")
    return _kept(ranked.filter(F.col("_r") <= budget(ratio=ratio)))


# ---- block budgets ----------------------------------------------------------------------


def block_scores(points: DataFrame, score: str = "score", size: int = BLOCK_SIZE) -> DataFrame:
    """Mean of the best fifth of each block of consecutive points."""
    w = Window.partitionBy("traj_id", "block").orderBy(F.col(score).desc(), "pos")  # at most ``size`` rows
    top = F.greatest(F.lit(1), F.ceil(F.col("block_length") * F.lit(0.20)))
    cut = points.withColumn("block", F.floor(F.col("pos") / size))
    cut = cut.withColumn("block_length", F.least(F.lit(size), F.col("n_points") - F.col("block") * size))
    ranked = cut.withColumn("_r", F.row_number().over(w))
    return ranked.groupBy("traj_id", "block", "n_points", "block_length").agg(
        F.avg(F.when(F.col("_r") <= top, F.col(score))).alias("block_score")
    )


def allocate_slots(
    blocks: DataFrame, remaining: int, total: int, share: float = 0.20, fairness: bool = True, size: int = BLOCK_SIZE
) -> DataFrame:
    """Free slots per block: the k-th slot of a block is worth ln(weight) - ln(k).

    Each block is unfolded into its possible slots; the best slots per track up to
    the track's cap, then the best overall, give what one-by-one picking gives.
    Both ends of every track are already kept.
    """
    stats = blocks.agg(
        F.min("block_score").alias("lo"), F.max("block_score").alias("hi"), F.countDistinct("traj_id").alias("n")
    ).first()
    if remaining <= 0 or not stats["n"]:
        return blocks.limit(0).select("traj_id", "block", F.lit(0).cast("bigint").alias("slots"))
    cap = max(1, int(np.ceil(total * max(0.01, min(1.0, share)))), int(np.ceil(total / max(1, stats["n"]))))
    span = stats["hi"] - stats["lo"]
    weight = F.lit(1.0) if span <= 1e-12 else F.lit(WEIGHT_FLOOR) + (F.col("block_score") - stats["lo"]) / F.lit(span)
    last = F.floor((F.col("n_points") - 1) / size)
    ends_here = (F.col("block") == 0).cast("bigint") + ((F.col("block") == last) & (F.col("n_points") > 1)).cast("bigint")
    ready = blocks.withColumns(
        {"_w": F.log(F.greatest(weight, F.lit(1e-6))), "_room": F.col("block_length") - ends_here, "_pre": F.lit(0)}
    )
    kept_ends = F.least(F.lit(2), F.col("n_points"))
    if fairness and remaining >= max(1, stats["n"]):
        ready = rank_within(ready, TRACK, [F.col("block_score").desc(), F.col("block")], "_best", "traj_id")
        ready = ready.withColumn("_pre", F.when((F.col("_best") == 1) & (F.col("_room") > 0) & (kept_ends < cap), 1).otherwise(0))
    # rows for slots 1.._room; the fairness slot of a block is its first one
    slots = ready.filter(F.col("_room") > 0).withColumn("_j", F.explode(F.sequence(F.lit(1), F.col("_room").cast("int"))))
    slots = slots.withColumn("_given", F.col("_j") <= F.col("_pre"))
    slots = slots.withColumn("_value", F.col("_w") - F.log(F.col("_j").cast("double")))
    order = [F.col("_given").desc(), F.col("_value").desc(), F.col("_j"), F.col("block_score").desc(), F.col("block")]
    slots = rank_within(slots, TRACK, order, "_nth", "traj_id").filter(F.col("_nth") <= F.lit(cap) - kept_ends)
    slots = slots.select("traj_id", "block", "block_score", "_given", "_value", "_j")
    best = first_overall(
        slots,
        [F.col("_given").desc(), F.col("_value").desc(), F.col("_j"), F.col("block_score").desc(), F.col("traj_id"), F.col("block")],
        remaining,
    )
    return best.groupBy("traj_id", "block").agg(F.count(F.lit(1)).alias("slots"))


def _step_km(lat: np.ndarray, lon: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Kilometres between the rows ``a`` and ``b`` on a plane; a degree and the least cosine are fixed values."""
    shrink = np.maximum(np.abs(np.cos(np.radians((lat[a] + lat[b]) / 2))), LEAST_COSINE)
    return KM_PER_DEGREE * np.hypot(lat[b] - lat[a], (lon[b] - lon[a]) * shrink)


def _unit(v: np.ndarray) -> np.ndarray:
    """``v`` stretched to 0..1; all 0 where it is flat."""
    span = np.ptp(v)
    return (v - v.min()) / span if span > 1e-12 else np.zeros(len(v))


def _nearest_earlier(turn: np.ndarray) -> list[int]:
    """For each block the nearest one on its left that has its turn before it, -1 if there is none.

    Blocks that wait in the stack have ever later turns, so each is pushed and dropped once.
    """
    stack, out = [], []
    for i, t in enumerate(turn.tolist()):
        while stack and turn[stack[-1]] > t:
            stack.pop()
        out.append(stack[-1] if stack else -1)
        stack.append(i)
    return out


def _pick_in_block(
    lat: np.ndarray, lon: np.ndarray, rows: np.ndarray, before: int, after: int, value: np.ndarray,
    aux: np.ndarray | None, count: int, spacing: int, gain_weight: float, blend: float,
) -> list[int]:
    """Up to ``count`` of ``rows``, one by one, in positional order.

    ``before`` and ``after`` are the nearest kept rows around the block.  Each row knows its
    kept neighbours, a pick moves those of the rows beside it, and the detour by way of a row
    follows from these alone.  Rows within ``spacing`` of a pick are out.
    """
    left, right = np.full(len(rows), before), np.full(len(rows), after)
    live = np.flatnonzero((rows != before) & (rows != after))
    picks: list[int] = []
    while len(picks) < count and len(live):
        worth = value[live]
        if aux is not None and blend > 0:
            worth = (1 - blend) * _unit(worth) + blend * _unit(aux[live])
        at, a, b = rows[live], left[live], right[live]
        detour = _step_km(lat, lon, a, at) + _step_km(lat, lon, at, b) - _step_km(lat, lon, a, b)
        best = int(live[np.argmax((1 - gain_weight) * _unit(worth) + gain_weight * _unit(np.maximum(detour, 0.0)))])
        row = int(rows[best])
        picks.append(row)
        left[best + 1 :] = np.maximum(left[best + 1 :], row)
        right[:best] = np.minimum(right[:best], row)
        live = live[np.abs(live - best) > spacing]
    return sorted(picks)


def _picks_by_piece(ready: DataFrame, plan: DataFrame, choose, size: int) -> DataFrame:
    """The picks of ``choose`` for tracks of any length, which are cut into pieces of whole blocks.

    A block looks at the nearest blocks with earlier turns.  Both lie in its own piece unless
    no block of the piece on that side has an earlier turn.  Such open blocks look only at
    open blocks, of their own piece or of others: what lies nearest with an earlier turn
    is itself first from that side.  So the open blocks of a track are picked from
    first, and then every piece by itself, with their picks in place.  A piece of m blocks
    has about 2 ln m open ones; only scores that rise or fall along a whole piece make all of it open.
    """
    width = max(1, piece_rows(ready.sparkSession) // size)
    inside = Window.partitionBy("traj_id", "_piece").orderBy("block")
    left = F.max("block_score").over(inside.rowsBetween(Window.unboundedPreceding, -1))
    right = F.max("block_score").over(inside.rowsBetween(1, Window.unboundedFollowing))
    first = left.isNull() | right.isNull() | (F.col("block_score") > left) | (F.col("block_score") >= right)
    turns = plan.withColumn("_piece", F.floor(F.col("block") / width)).withColumn("_open", first).select("traj_id", "block", "_piece", "_open")
    ready = materialize(ready.join(turns, ["traj_id", "block"], "left"))
    schema = "traj_id bigint, pos bigint"
    opened = materialize(map_groups(ready.filter(F.col("_open") | _ends()), TRACK, "pos", choose, schema))
    picked = ready.join(opened, [*TRACK, "pos"], "left_semi").withColumn("_kept", F.lit(True))
    rest = ready.filter(~F.col("_open")).unionByName(picked)
    return opened.unionByName(map_groups(rest, ["traj_id", "_piece"], "pos", choose, schema))


def simplify_segment_budget(
    points: DataFrame,
    ratio: float,
    segment_score: str | None = None,
    size: int = BLOCK_SIZE,
    spacing_fraction: float = 0.10,
    share: float = 0.20,
    gain_weight: float = GEOMETRY_WEIGHT,
    blend: float = BLOCK_BLEND,
    fairness: bool = True,
) -> DataFrame:
    """Ends, then block slots by diminishing value, spaced picks, and a global fallback.

    Returns (traj_id, pos, reason) with reason skeleton, learned or fallback.  A track of
    any length is picked from piece by piece (``_picks_by_piece``).
    """
    total, skeleton = _total_budget(points, ratio, F.least(F.lit(2), F.col("n_points")))
    blocks = materialize(block_scores(points, segment_score or "score", size))
    slots = allocate_slots(blocks, total - skeleton, total, share, fairness, size)
    plan = blocks.join(slots, ["traj_id", "block"]).select("traj_id", "block", "block_score", "slots")
    long = is_hot(points, "traj_id")
    if long:
        plan = materialize(plan)
    cols = ["traj_id", "pos", "n_points", "lat", "lon", "score"] + ([segment_score] if segment_score else [])
    ready = points.select(*cols, F.floor(F.col("pos") / size).alias("block")).join(plan, ["traj_id", "block"], "left")
    # only blocks with slots and the ends of the track travel to the picks
    ready = ready.withColumn("slots", F.col("slots").cast("double")).filter(F.col("slots").isNotNull() | _ends()).withColumn("_kept", F.lit(False))

    def choose(data: dict) -> dict | None:
        """Blocks have their turns by score; what surrounds a block was kept by the nearest blocks with earlier turns.

        Of blocks that had their turn elsewhere only the picks are here, marked as kept.
        """
        with_slots = np.flatnonzero(~np.isnan(data["slots"]))
        if len(with_slots) == 0:
            return None
        blocks = np.split(with_slots, np.flatnonzero(np.diff(data["block"][with_slots])) + 1)
        firsts = np.array([rows[0] for rows in blocks])
        turn = np.empty(len(blocks), dtype=np.int64)
        turn[np.lexsort((firsts, -data["block_score"][firsts]))] = np.arange(len(blocks))
        lefts = _nearest_earlier(turn)
        rights = [len(blocks) - 1 - i if i >= 0 else -1 for i in _nearest_earlier(turn[::-1])][::-1]
        done = data["_kept"][firsts]
        picks: list[list[int]] = [rows.tolist() if d else [] for rows, d in zip(blocks, done)]
        for i in np.argsort(turn).tolist():
            if done[i]:
                continue
            rows = blocks[i]
            before = picks[lefts[i]][-1] if lefts[i] >= 0 else 0
            after = picks[rights[i]][0] if rights[i] >= 0 else len(data["pos"]) - 1
            picks[i] = _pick_in_block(
                data["lat"], data["lon"], rows, before, after, data["score"][rows],
                data[segment_score][rows] if segment_score else None, int(data["slots"][rows[0]]),
                int(len(rows) * spacing_fraction), gain_weight, blend,
            )
        kept = np.array([row for p, d in zip(picks, done) if not d for row in p], dtype=np.int64)
        return {"traj_id": data["traj_id"][kept], "pos": data["pos"][kept]}

    if long:
        learned = _picks_by_piece(ready, plan, choose, size)
    else:
        learned = map_groups(ready, TRACK, "pos", choose, "traj_id bigint, pos bigint")
    ends = points.filter(_ends()).select("traj_id", "pos", F.lit("skeleton").alias("reason"))
    chosen = materialize(ends.unionByName(learned.withColumn("reason", F.lit("learned"))))
    return fallback_fill(points, chosen, total)


def fallback_fill(points: DataFrame, chosen: DataFrame, total: int) -> DataFrame:
    """Spend what is left of a budget on the best remaining points anywhere."""
    missing = total - chosen.count()
    rest = points.select("traj_id", "pos", "score").join(chosen.select("traj_id", "pos"), ["traj_id", "pos"], "left_anti")
    best = first_overall(rest, [_by_score(), F.col("traj_id"), F.col("pos")], missing)
    return chosen.unionByName(best.select("traj_id", "pos", F.lit("fallback").alias("reason")))


def selector_trace(chosen: DataFrame, slots: DataFrame | None = None) -> DataFrame:
    """Kept points per reason in total, and how many tracks got a learned point."""
    per_track = chosen.groupBy("traj_id").pivot("reason", ["skeleton", "learned", "fallback"]).count().na.fill(0)
    return per_track.agg(
        F.sum(F.col("skeleton") + F.col("learned") + F.col("fallback")).alias("retained"),
        *[F.sum(r).alias(r) for r in ("skeleton", "learned", "fallback")],
        F.count_if(F.col("learned") > 0).alias("tracks_with_learned"),
        F.count_if(F.col("learned") == 0).alias("tracks_without_learned"),
    )


def slot_entropy(slots: DataFrame) -> DataFrame:
    """Shannon entropy of the slots per block, raw and as a share of its maximum."""
    total = slots.select(F.sum("slots")).scalar()
    p = F.col("slots") / total
    out = slots.filter(F.col("slots") > 0).agg(
        F.coalesce(-F.sum(p * F.log(p)), F.lit(0.0)).alias("entropy"), F.count(F.lit(1)).alias("blocks")
    )
    share = F.when(F.col("blocks") > 1, F.col("entropy") / F.log(F.col("blocks").cast("double"))).otherwise(F.lit(0.0))
    return out.withColumn("entropy_normalized", share)


def block_score_stats(blocks: DataFrame) -> DataFrame:
    return blocks.agg(
        F.count(F.lit(1)).alias("blocks"),
        F.min("block_score").alias("score_min"),
        F.max("block_score").alias("score_max"),
        F.avg("block_score").alias("score_mean"),
        F.stddev_pop("block_score").alias("score_std"),
        (F.max("block_score") - F.min("block_score")).alias("score_span"),
    )


# ---- accounting, scores, plug-ins -------------------------------------------------------


def skeleton_share(ratio: float) -> float:
    """Largest share of a budget the skeleton should take."""
    return next((share for limit, share in SKELETON_SHARES if ratio <= limit), SKELETON_SHARE_ABOVE)


def selector_budgets(
    points: DataFrame, ratios: list[float], temporal_fraction: float = 0.5, mode: str = "fill", min_swaps: int = 0
) -> DataFrame:
    """Per ratio: how many slots the base takes and how many scores can decide."""
    sizes = points.filter(F.col("pos") == 0).select("n_points")
    sizes = sizes.withColumn("ratio", F.explode(F.array(*[F.lit(float(x)) for x in ratios])))
    n = F.col("n_points")
    k = budget(ratio=F.col("ratio"))
    if mode == "stratified":
        free = F.greatest(k - 2, F.lit(0))
    elif mode in ("swap", "local_swap", "local_delta_swap"):
        free = swap_count(k, n, temporal_fraction, min_swaps)
    elif mode == "global_budget":
        free = F.greatest(k - F.least(n, F.lit(2)), F.lit(0))
    else:
        free = k - base_size(k, temporal_fraction)
    ready = sizes.select("ratio", "n_points", k.alias("_k"), free.alias("_free"))
    out = ready.groupBy("ratio").agg(
        F.count(F.lit(1)).alias("tracks"),
        F.sum("n_points").alias("points"),
        F.sum("_k").alias("budget"),
        F.sum(F.col("_k") - F.col("_free")).alias("base_slots"),
        F.sum("_free").alias("free_slots"),
        F.count_if(F.col("_free") <= 0).alias("tracks_without_free"),
        F.count_if(F.col("_k") <= F.least(F.col("n_points"), F.lit(2))).alias("tracks_ends_only"),
    )
    return out.withColumn("free_share", F.col("free_slots") / F.greatest("budget", F.lit(1)))


def _sigmoid(c: Column) -> Column:
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-c))


def tie_average_rank(df: DataFrame, keys: list[str], value: str, out: str, bound_key: str | None) -> DataFrame:
    """0-based ascending rank in which equal values share their average rank."""
    ranked = rank_within(df, keys, [F.col(value), F.col("pos")], "_r", bound_key)
    shared = [*keys, value]
    if bound_key is None:
        means = ranked.groupBy(*shared).agg(F.avg("_r").alias(out))
        return ranked.join(means, shared).withColumn(out, F.col(out) - 1).drop("_r")
    return attach(ranked, shared, {"_m": F.avg("_r")}, bound_key).withColumn(out, F.col("_m") - 1).drop("_r", "_m")


def convert_scores(
    points: DataFrame, raw: str = "score", mode: str = "rank", temperature: float = 1.0, confidence: float = 0.15
) -> DataFrame:
    """Turn raw scores into selection scores ``converted``, per track."""
    if mode not in SCORE_MODES:
        raise ValueError(f"unknown score mode: {mode!r}")
    value, temperature = F.col(raw), max(temperature, 1e-6)
    if mode == "raw":
        return points.withColumn("converted", value)
    if mode in ("sigmoid", "temperature_sigmoid"):
        scaled = value if mode == "sigmoid" else value / F.lit(temperature)
        return points.withColumn("converted", _sigmoid(scaled))
    spread = F.greatest(F.col("n_points") - 1, F.lit(1))
    if mode == "rank_tie":
        ranked = tie_average_rank(points, TRACK, raw, "_a", "traj_id")
        return ranked.withColumn("converted", F.col("_a") / spread).drop("_a")
    out = points
    if mode in ("rank", "rank_confidence"):
        out = rank_within(out, TRACK, [value.asc(), F.col("pos")], "_r", "traj_id")
        out = out.withColumn("_rank", (F.col("_r") - 1) / spread).drop("_r")
        if mode == "rank":
            return out.withColumn("converted", F.col("_rank")).drop("_rank")
    out = attach(out, TRACK, {"_mean": F.avg(raw), "_sd": F.stddev_pop(raw)}, "traj_id")
    z = F.when(F.col("_sd") > 1e-6, (value - F.col("_mean")) / F.col("_sd")).otherwise(F.lit(0.0))
    sure = _sigmoid(z / F.lit(temperature))
    if mode == "rank_confidence":
        sure = F.lit(1.0 - confidence) * F.col("_rank") + F.lit(confidence) * sure
    return out.withColumn("converted", sure).drop("_mean", "_sd", *(["_rank"] if mode == "rank_confidence" else []))


def blend_scores(points: DataFrame, score: str, geometry: str, weight: float) -> DataFrame:
    """(1-w) * score + w * rank of the geometry score in its track."""
    weight = min(1.0, max(0.0, weight))
    ranked = convert_scores(points, geometry, "rank")
    blended = F.lit(1.0 - weight) * F.col(score) + F.lit(weight) * F.col("converted")
    return ranked.withColumn("blended", blended).drop("converted")


def random_scores(points: DataFrame, seed: int) -> DataFrame:
    """A repeatable random score per point."""
    return points.withColumn("score", fast_unit_hash(seed, F.col("traj_id"), F.col("pos")))


@dataclass(frozen=True)
class Method:
    """A plug-in selector: a name and ``simplify(points, ratio) -> kept rows``."""

    name: str
    simplify: Callable[[DataFrame, float], DataFrame]


def control_methods(seed: int = 0, label: str | None = None) -> list[Method]:
    """Baselines that bound what scores can do: random and, with labels, oracle fills."""
    out = [
        Method("uniform", simplify_uniform),
        Method("douglas_peucker", simplify_douglas_peucker),
        Method("random_fill", lambda p, ratio: simplify_hybrid(random_scores(p, seed), ratio)),
        Method("random_global_budget", lambda p, ratio: simplify_global_budget(random_scores(p, seed), ratio)),
    ]
    if label is not None:
        def labelled(p: DataFrame) -> DataFrame:
            return p.withColumn("score", F.coalesce(F.col(label), F.lit(0.0)))

        out += [
            Method("oracle_fill", lambda p, ratio: simplify_hybrid(labelled(p), ratio)),
            Method("oracle_global_budget", lambda p, ratio: simplify_global_budget(labelled(p), ratio)),
            Method("oracle", lambda p, ratio: simplify_oracle(p, ratio, label)),
        ]
    return out


def retain(points: DataFrame, methods: list[Method], ratios: list[float]) -> DataFrame:
    """Kept sets of several methods and ratios as one long table (method, ratio, traj_id, pos)."""
    out = None
    for method in methods:
        for ratio in ratios:
            kept = _kept(method.simplify(points, ratio))
            kept = kept.select(F.lit(method.name).alias("method"), F.lit(float(ratio)).alias("ratio"), "traj_id", "pos")
            out = kept if out is None else out.unionByName(kept)
    return out


def freeze(retained: DataFrame, expected_rows: int | None = None) -> DataFrame:
    """Fix kept sets by writing them before any evaluation query is read."""
    frozen = materialize(retained)
    if expected_rows is not None and frozen.count() != expected_rows:
        raise ValueError("frozen kept set differs from the expected number of rows")
    return frozen
