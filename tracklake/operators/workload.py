"""Generating box-query workloads from the data.

Weights and boxes are columns over POINTS and anchors; only the accept/reject
decision runs on the driver, over one row per overlap pattern of a small batch.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window, WindowSpec

from ..functions.geo import KM_PER_DEGREE
from ..functions.hashing import fast_unit_hash, unit_hash
from ..plans.materialize import materialize
from ..plans.ordered import neighbors, order_index
from ..plans.quantiles import quantiles
from .diagnostics import diagnostics_summary, hit_counts, query_diagnostics
from .ranges import query_hits, union_coverage
from .tracks import extent, one_row

GRID_BINS = 64
DAY = 86400.0
EPOCH_LIKE = 366 * DAY
# Anchor modes and families, footprints, and acceptance limits of the named profile.
ANCHOR_MODES = ("mixed_density", "dense", "uniform", "sparse")
MIXED_DENSITY_SHARE = 0.70
FAMILIES = {
    "density_route": "density",
    "boundary_entry_exit": "endpoint",
    "crossing_turn_change": "turn",
    "port_or_approach_zone": "port",
    "sparse_background_control": "sparse",
}
ANCHOR_WEIGHTS = {
    "density_route": 0.40,
    "boundary_entry_exit": 0.20,
    "crossing_turn_change": 0.15,
    "port_or_approach_zone": 0.15,
    "sparse_background_control": 0.10,
}
FOOTPRINT_WEIGHTS = {
    "small_local": 0.25,
    "medium_operational": 0.45,
    "large_context": 0.20,
    "route_corridor_like": 0.10,
}
FOOTPRINTS = {
    "small_local": (1.0, 1.0, False),
    "medium_operational": (2.2, 5.0, False),
    "large_context": (4.5, 10.0, False),
    "route_corridor_like": (3.0, 6.0, True),
}
POINT_SHARE_LIMITS = ((0.05, 0.020), (0.10, 0.025), (0.15, 0.030))
POINT_SHARE_LIMIT_ABOVE = 0.050
MAX_BROADCAST_SLOTS = 100_000
CORRIDOR_LONG, CORRIDOR_SHORT = 2.50, 0.45


@dataclass(frozen=True)
class Limits:
    """Acceptance limits of a candidate box; None switches a rule off."""

    min_points: int | None = None
    min_tracks: int | None = None
    max_point_share: float | None = None
    max_track_share: float | None = None
    max_volume_share: float | None = None
    duplicate_iou: float | None = None

    def active(self) -> bool:
        return any(v is not None for v in vars(self).values())


@dataclass(frozen=True)
class Profile:
    """Named recipe for a workload."""

    profile_id: str = "free"
    version: int = 0
    anchor_weights: dict[str, float] = field(default_factory=dict)
    footprint_weights: dict[str, float] = field(default_factory=dict)
    time_domain: str = "dataset"
    limits: Limits = Limits()
    attempts_per_query: int = 50


def workload_profile(profile_id: str, target_coverage: float | None = None) -> Profile:
    """The two versioned profiles."""
    if profile_id == "free":
        return Profile()
    if profile_id != "profile_v1":
        raise ValueError(f"unknown workload profile: {profile_id!r}")
    limits = Limits(3, 1, max_point_share(target_coverage), None, None, 0.65)
    return Profile("profile_v1", 1, ANCHOR_WEIGHTS, FOOTPRINT_WEIGHTS, "anchor_day", limits, 20)


def as_share(value: float | None) -> float | None:
    """Targets and tolerances above 1 are percents."""
    if value is None:
        return None
    return value / 100.0 if value > 1.0 else float(value)


def max_point_share(target_coverage: float | None) -> float:
    """Largest share of points one box may hit for a coverage target."""
    target = as_share(target_coverage)
    if target is None:
        return POINT_SHARE_LIMIT_ABOVE
    return next((limit for top, limit in POINT_SHARE_LIMITS if target <= top), POINT_SHARE_LIMIT_ABOVE)


def profile_table(spark: SparkSession) -> DataFrame:
    """Footprint families of the named profile as a table."""
    rows = [(f, FOOTPRINT_WEIGHTS[f], *FOOTPRINTS[f]) for f in FOOTPRINTS]
    schema = "footprint_family string, weight double, spatial_radius_km double, time_half_window_hours double, elongation_allowed boolean"
    return spark.createDataFrame(rows, schema)


# ---- anchor weights -----------------------------------------------------------------------


def _with_cell(points: DataFrame, bins: int) -> DataFrame:
    e = extent(points).first()

    def at(axis: str) -> Column:
        low, span = e[f"{axis}_min"], max(e[f"{axis}_max"] - e[f"{axis}_min"], 1e-6)
        cell = F.floor((F.col(axis) - F.lit(low)) / F.lit(span) * (bins - 1))
        return F.least(F.greatest(cell, F.lit(0)), F.lit(bins - 1))

    return points.withColumn("_cell", at("lat") * bins + at("lon"))


def _cell_sizes(points: DataFrame, bins: int) -> DataFrame:
    """Add the population of the point's cell; there are at most bins * bins cells."""
    cut = _with_cell(points, bins)
    sizes = cut.groupBy("_cell").agg(F.count(F.lit(1)).alias("_pop"))
    if bins * bins <= 1_000_000:
        sizes = F.broadcast(sizes)
    return cut.join(sizes, "_cell").drop("_cell")


def normalized(df: DataFrame, raw: str, out: str) -> DataFrame:
    """Divide by the total; equal shares if the total is zero."""
    clean = F.greatest(F.coalesce(F.nanvl(F.col(raw), F.lit(0.0)), F.lit(0.0)), F.lit(0.0))
    total = df.agg(F.sum(clean).alias("s"), F.count(F.lit(1)).alias("n")).first()
    if (total["s"] or 0.0) > 1e-12:
        return df.withColumn(out, clean / F.lit(total["s"]))
    return df.withColumn(out, F.lit(1.0 / max(1, total["n"])))


def density_weights(points: DataFrame, bins: int = GRID_BINS) -> DataFrame:
    sized = _cell_sizes(points, bins).withColumn("_raw", F.col("_pop").cast("double"))
    return normalized(sized, "_raw", "density").drop("_raw", "_pop")


def sparse_weights(points: DataFrame, bins: int = GRID_BINS) -> DataFrame:
    sized = _cell_sizes(points, bins).withColumn("_raw", 1.0 / F.col("_pop"))
    return normalized(sized, "_raw", "sparse").drop("_raw", "_pop")


def endpoint_weights(points: DataFrame) -> DataFrame:
    end = F.when(F.col("is_start") | F.col("is_end"), 8.0).otherwise(F.lit(0.0))
    raw = 1.0 + end + 3.0 * F.greatest("turn_score", F.lit(0.0))
    return normalized(points.withColumn("_raw", raw), "_raw", "endpoint").drop("_raw")


def turn_weights(points: DataFrame) -> DataFrame:
    """Turn score plus heading and speed change to the previous point of the track."""
    near = neighbors(points, ["traj_id"], "pos", {"_h": ("heading", -1), "_s": ("speed", -1)}, "traj_id")
    angle = F.abs(F.col("heading") - F.col("_h"))
    angle = F.coalesce(F.greatest(F.least(angle, 360.0 - angle), F.lit(0.0)) / 180.0, F.lit(0.0))
    near = near.withColumns({"_angle": angle, "_dv": F.coalesce(F.abs(F.col("speed") - F.col("_s")), F.lit(0.0))})
    top = near.agg(F.max("_dv")).first()[0] or 0.0
    change = F.col("_dv") / F.lit(top) if top > 1e-6 else F.col("_dv")
    raw = 1.0 + 8.0 * F.greatest("turn_score", F.lit(0.0)) + 4.0 * F.col("_angle") + 2.0 * change
    done = normalized(near.withColumn("_raw", raw), "_raw", "turn")
    return done.drop("_raw", "_h", "_s", "_angle", "_dv")


def port_weights(points: DataFrame, bins: int = GRID_BINS) -> DataFrame:
    """Dense, track ends, and slow: 0.35 / 0.35 / 0.30, each normalised."""
    both = endpoint_weights(density_weights(points, bins))
    both = both.withColumn("_speed", F.greatest("speed", F.lit(0.0)))
    limit = quantiles(both.select("traj_id", "pos", "_speed"), "_speed", {"p": 0.30}, ["traj_id", "pos"]).first()["p"]
    both = both.withColumn("_slow", F.when(F.col("_speed") <= F.lit(limit), 1.0).otherwise(F.lit(0.0)))
    both = normalized(both, "_slow", "_slow_share")
    raw = 0.35 * F.col("density") + 0.35 * F.col("endpoint") + 0.30 * F.col("_slow_share")
    done = normalized(both.withColumn("_raw", raw), "_raw", "port")
    return done.drop("_raw", "_speed", "_slow", "_slow_share", "density", "endpoint")


def anchor_weights(points: DataFrame, kind: str) -> DataFrame:
    """Weight column ``weight`` for a mode or a family."""
    maker = {"density": density_weights, "sparse": sparse_weights, "endpoint": endpoint_weights, "turn": turn_weights, "port": port_weights}
    name = FAMILIES.get(kind) or {"mixed_density": "density", "dense": "density", "sparse": "sparse", "uniform": "uniform"}.get(kind)
    if name is None:
        raise ValueError(f"unknown anchor mode or family: {kind!r}")
    if name == "uniform":
        return normalized(points.withColumn("_one", F.lit(1.0)), "_one", "weight").drop("_one")
    return maker[name](points).withColumnRenamed(name, "weight")


def all_weights(points: DataFrame) -> DataFrame:
    """Every weight side by side, written once for the whole generation."""
    wide = turn_weights(endpoint_weights(sparse_weights(density_weights(points))))
    limit = quantiles(points.select("traj_id", "pos", F.greatest("speed", F.lit(0.0)).alias("v")), "v", {"p": 0.30}, ["traj_id", "pos"]).first()["p"]
    slow = F.when(F.greatest("speed", F.lit(0.0)) <= F.lit(limit), 1.0).otherwise(F.lit(0.0))
    wide = normalized(wide.withColumn("_slow", slow), "_slow", "_slow_share")
    port = 0.35 * F.col("density") + 0.35 * F.col("endpoint") + 0.30 * F.col("_slow_share")
    wide = wide.withColumns({"port": port, "uniform": F.lit(1.0)})
    cols = ["traj_id", "pos", "t", "lat", "lon", "heading", "uniform", "density", "sparse", "endpoint", "turn", "port"]
    return materialize(wide.select(*cols))


# ---- weighted draws -----------------------------------------------------------------------


def sample_anchors(weighted: DataFrame, slots: DataFrame, rows_per_part: int = 1_000_000) -> DataFrame:
    """Draw one point per slot with probability proportional to a weight column.

    ``slots`` has (slot, kind, u): the weight column to use and a number in [0, 1).
    Points are spread over parts; the weight of each part is one small aggregate, so
    a draw first picks a part and then looks only inside it.  No slot is ever paired
    with all points.
    """
    kinds, n_slots = [], 0
    for r in slots.groupBy("kind").count().collect():
        kinds.append(r["kind"])
        n_slots += r["count"]
    small = F.broadcast if n_slots <= MAX_BROADCAST_SLOTS else (lambda df: df)
    total = weighted.count()
    parts = max(1, math.ceil(total / rows_per_part))
    part = F.pmod(F.col("traj_id") * 7919 + F.col("pos"), F.lit(parts))
    placed = weighted.withColumn("_part", part)
    long = placed.groupBy("_part").agg(*[F.sum(k).alias(k) for k in kinds]).unpivot("_part", kinds, "kind", "_w")
    w = Window.partitionBy("kind").orderBy("_part")  # one row per part
    long = _intervals(long, w, Window.partitionBy("kind"), F.col("_part"))
    picked = slots.join(long, "kind").withColumn("_want", F.col("u") * F.col("_all"))
    picked = picked.filter(_holds(F.col("_want")))
    picked = picked.select("slot", "kind", "_part", (F.col("_want") - F.col("_from")).alias("_rest"))
    wanted = picked.select("_part", "kind").distinct()
    base = [c for c in ("traj_id", "pos", "t", "lat", "lon", "heading") if c in weighted.columns]
    inside = placed.select(*base, "_part", *kinds).unpivot([*base, "_part"], kinds, "kind", "_w").join(small(wanted), ["_part", "kind"])
    run = Window.partitionBy("_part", "kind").orderBy("traj_id", "pos")  # at most about rows_per_part rows
    inside = _intervals(inside, run, Window.partitionBy("_part", "kind"), F.struct("traj_id", "pos"))
    drawn = inside.join(small(picked), ["_part", "kind"]).filter(_holds(F.col("_rest")))
    return drawn.select("slot", *base)


def _intervals(df: DataFrame, ordered: WindowSpec, group: WindowSpec, place: Column) -> DataFrame:
    """Running sums of ``_w`` as intervals [_from, _to) without gaps, their total, and the last row that has any weight.

    Every number from 0 up falls into exactly one interval, whatever the rounding of the
    sums, as the last interval is open to the right.
    """
    df = df.withColumn("_to", F.sum("_w").over(ordered))
    df = df.withColumn("_from", F.coalesce(F.lag("_to").over(ordered), F.lit(0.0)))
    last = F.max(F.when(F.col("_w") > 0, place)).over(group)
    return df.withColumns({"_all": F.max("_to").over(group), "_last": F.coalesce(last == place, F.lit(False))})


def _holds(value: Column) -> Column:
    return (value >= F.col("_from")) & ((value < F.col("_to")) | F.col("_last")) & (F.col("_w") > 0)


# ---- quotas -------------------------------------------------------------------------------


def family_quotas(weights: DataFrame, n: int) -> DataFrame:
    """Largest-remainder quotas; ``weights`` has (family, weight, place) with few rows."""
    total = weights.select(F.sum("weight")).scalar()
    exact = F.lit(float(n)) * F.col("weight") / F.col("_total")
    ready = weights.withColumn("_total", total).withColumn("_exact", exact).withColumn("_floor", F.floor("_exact"))
    left = ready.select(F.lit(n) - F.sum("_floor")).scalar()
    # families are a handful of literal names, so one task ranks them
    order = Window.partitionBy(F.lit(0)).orderBy((F.col("_exact") - F.col("_floor")).desc(), F.col("weight").desc(), "place")
    ranked = ready.withColumn("_left", left).withColumn("_r", F.row_number().over(order))
    extra = F.when(F.col("_r") <= F.col("_left"), 1).otherwise(0)
    return ranked.select("family", "place", (F.col("_floor") + extra).cast("bigint").alias("quota"))


def quota_sequence(weights: DataFrame, n: int, seed: int, namespace: str) -> DataFrame:
    """The quotas as a shuffled sequence (slot, family); slots are 0..n-1."""
    quotas = family_quotas(weights, n).filter("quota > 0")
    each = quotas.withColumn("_k", F.explode(F.sequence(F.lit(1), F.col("quota").cast("int"))))
    listed = order_index(each, [F.col("place"), F.col("_k")], out="item")
    keyed = listed.withColumn("_u", unit_hash(namespace, seed, F.col("item")))
    return order_index(keyed, [F.col("_u"), F.col("item")], out="slot").select("slot", "family")


def query_plan(spark: SparkSession, profile: Profile, n: int, seed: int) -> DataFrame:
    """Anchor and footprint family of every planned slot."""

    def table(weights: dict[str, float]) -> DataFrame:
        rows = [(f, float(w), i) for i, (f, w) in enumerate(weights.items())]
        return spark.createDataFrame(rows, "family string, weight double, place int")

    out = []
    for kind, weights in (("anchor_family", profile.anchor_weights), ("footprint_family", profile.footprint_weights)):
        sequence = quota_sequence(table(weights), n, seed, f"{profile.profile_id}:{kind}")
        out.append(sequence.withColumnRenamed("family", kind))
    return out[0].join(out[1], "slot")


def choose_family(weights: dict[str, float], u: Column) -> Column:
    """Inverse cumulative choice for slots past the plan."""
    total, upto = sum(weights.values()), 0.0
    steps = []
    for family, weight in weights.items():
        upto += weight
        steps.append((family, upto / total))
    choice = F.lit(steps[-1][0])
    for family, edge in reversed(steps[:-1]):
        choice = F.when(u <= edge, family).otherwise(choice)
    return choice


# ---- boxes --------------------------------------------------------------------------------


def anchor_day_bounds(t: Column, t_min: Column, t_max: Column) -> tuple[Column, Column]:
    """The day of the anchor, cut to the data: UTC days for epoch times, else days from the start."""
    epoch_day = F.floor(t / DAY) * DAY
    own_day = t_min + F.floor(F.greatest(t - t_min, F.lit(0.0)) / DAY) * DAY
    start = F.when(t_min >= EPOCH_LIKE, epoch_day).otherwise(own_day)
    flat = t_max <= t_min
    low = F.when(flat, t_min).otherwise(F.greatest(t_min, start))
    high = F.when(flat, t_max).otherwise(F.least(t_max, start + DAY))
    return low, high


def _jitter(amount: float, seed: int, axis: str) -> Column:
    if amount < 0:
        raise ValueError("jitter must not be negative")
    if amount == 0:
        return F.lit(1.0)
    u = unit_hash("jitter", axis, seed, F.col("slot"))
    return F.greatest(F.lit(1.0) + F.lit(amount) * (2.0 * u - 1.0), F.lit(1e-6))


def make_boxes(
    anchors: DataFrame,
    bounds: DataFrame,
    seed: int = 0,
    jitter: float = 0.0,
    time_domain: str = "dataset",
    spatial_fraction: float = 0.08,
    time_fraction: float = 0.15,
) -> DataFrame:
    """Boxes around anchors (slot, t, lat, lon, heading).

    ``spatial_radius_km`` and ``time_half_window_hours`` give half-widths if present
    and not NULL, else fractions of the extent; a corridor is stretched along the
    heading; everything is cut to the extent and the time domain.
    """
    if time_domain not in ("dataset", "anchor_day"):
        raise ValueError(f"unknown time domain: {time_domain!r}")
    for name, kind in (("spatial_radius_km", "double"), ("time_half_window_hours", "double"), ("elongation_allowed", "boolean")):
        if name not in anchors.columns:
            anchors = anchors.withColumn(name, F.lit(None).cast(kind))
    wide = anchors.withColumn("_b", bounds.select(F.struct(*bounds.columns)).scalar())
    b = {c: F.col(f"_b.{c}") for c in ("t_min", "t_max", "lat_min", "lat_max", "lon_min", "lon_max")}
    km, hours = F.col("spatial_radius_km"), F.col("time_half_window_hours")
    cos = F.greatest(F.lit(0.10), F.abs(F.cos(F.radians("lat"))))
    lat_w = F.coalesce(km / KM_PER_DEGREE, F.lit(spatial_fraction) * (b["lat_max"] - b["lat_min"])) * _jitter(jitter, seed, "lat")
    lon_w = F.coalesce(km / (KM_PER_DEGREE * cos), F.lit(spatial_fraction) * (b["lon_max"] - b["lon_min"])) * _jitter(jitter, seed, "lon")
    t_w = F.coalesce(hours * 3600.0, F.lit(time_fraction) * (b["t_max"] - b["t_min"])) * _jitter(jitter, seed, "time")
    course = F.radians(F.pmod(F.col("heading"), F.lit(180.0)))
    east_west = F.abs(F.sin(course)) >= F.abs(F.cos(course))
    corridor = F.coalesce(F.col("elongation_allowed"), F.lit(False))
    lat_w = lat_w * F.when(~corridor, 1.0).when(east_west, CORRIDOR_SHORT).otherwise(CORRIDOR_LONG)
    lon_w = lon_w * F.when(~corridor, 1.0).when(east_west, CORRIDOR_LONG).otherwise(CORRIDOR_SHORT)
    t_low, t_high = (b["t_min"], b["t_max"]) if time_domain == "dataset" else anchor_day_bounds(F.col("t"), b["t_min"], b["t_max"])
    axis = F.when(~corridor, "none").when(east_west, "east_west").otherwise("north_south")
    extra = [c for c in anchors.columns if c not in ("t", "lat", "lon", "heading", "traj_id", "pos")]
    return wide.select(
        *extra,
        F.greatest(b["lat_min"], F.col("lat") - lat_w).alias("lat_min"),
        F.least(b["lat_max"], F.col("lat") + lat_w).alias("lat_max"),
        F.greatest(b["lon_min"], F.col("lon") - lon_w).alias("lon_min"),
        F.least(b["lon_max"], F.col("lon") + lon_w).alias("lon_max"),
        F.greatest(t_low, F.col("t") - t_w).alias("t_start"),
        F.least(t_high, F.col("t") + t_w).alias("t_end"),
        axis.alias("corridor_axis"),
    )


# ---- acceptance ---------------------------------------------------------------------------


def overlap_patterns(hits: DataFrame) -> DataFrame:
    """How many points lie in exactly which set of boxes: (pattern, points)."""
    per_point = hits.groupBy("traj_id", "pos").agg(F.sort_array(F.collect_set("query_id")).alias("pattern"))
    return per_point.groupBy("pattern").agg(F.count(F.lit(1)).alias("points"))


@dataclass
class Decision:
    """State of the accept loop between batches."""

    accepted: list[int] = field(default_factory=list)
    log: list[tuple[int, str]] = field(default_factory=list)
    covered: float = 0.0


def data_totals(points: DataFrame) -> dict[str, float]:
    """Number of points and tracks, and the extent, as one collected row."""
    counts = points.agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("pos") == 0).alias("tracks"))
    return one_row(extent(points), counts).first().asDict()


_AXES = (("lat_min", "lat_max", "lat"), ("lon_min", "lon_max", "lon"), ("t_start", "t_end", "t"))


def _iou(a: dict, b: dict) -> float:
    """Box IoU of two collected query rows; the same rule as ``box_iou``."""
    shared = va = vb = 1.0
    for lo, hi, _ in _AXES:
        shared *= max(0.0, min(a[hi], b[hi]) - max(a[lo], b[lo]))
        va *= max(0.0, a[hi] - a[lo])
        vb *= max(0.0, b[hi] - b[lo])
    if va + vb - shared <= 1e-12:
        return 1.0 if va <= 1e-12 and vb <= 1e-12 else 0.0
    return shared / (va + vb - shared)


def _volume_share(box: dict, totals: dict) -> float:
    out = 1.0
    for lo, hi, axis in _AXES:
        full = max(totals[f"{axis}_max"] - totals[f"{axis}_min"], 1e-9)
        out *= min(1.0, max(0.0, box[hi] - box[lo]) / full)
    return out


def accept_queries(
    points: DataFrame,
    candidates: DataFrame,
    limits: Limits,
    max_coverage: float | None = None,
    state: Decision | None = None,
    group: dict[int, int] | None = None,
    stop=None,
    totals: dict[str, float] | None = None,
) -> Decision:
    """Decide candidates in id order; first failing rule wins, then the coverage guard.

    The points are joined with the boxes of a batch once; what reaches the driver is
    one row per box and one per overlap pattern, and the greedy replay over them is
    exact.  ``group`` maps a candidate to its slot: once a slot is filled its other
    candidates are skipped, and a slot that is not yet open waits for the next batch.
    """
    state, totals = state or Decision(), totals or data_totals(points)
    known = set(state.accepted) | {q for q, _ in state.log}
    hits = query_hits(points.select("traj_id", "pos", "t", "lat", "lon"), candidates)
    hits = materialize(hits.select("query_id", "traj_id", "pos"))
    boxes = {r["query_id"]: r.asDict() for r in hit_counts(hits, candidates).collect()}
    patterns = [(set(r["pattern"]), r["points"]) for r in overlap_patterns(hits).collect()]
    n, tracks = max(1, totals["n"]), max(1, totals["tracks"])

    def coverage(ids: set[int]) -> float:
        return sum(count for pattern, count in patterns if pattern & ids) / n

    def judge(q: int) -> str | None:
        box = boxes[q]
        if limits.min_points is not None and box["point_hits"] < limits.min_points:
            return "too_few_point_hits"
        if limits.min_tracks is not None and box["track_hits"] < limits.min_tracks:
            return "too_few_trajectory_hits"
        measured = (
            (limits.max_point_share, box["point_hits"] / n),
            (limits.max_track_share, box["track_hits"] / tracks),
            (limits.max_volume_share, _volume_share(box, totals)),
        )
        if any(limit is not None and value > limit for limit, value in measured):
            return "too_broad"
        if limits.duplicate_iou is not None and any(_iou(box, boxes[a]) >= limits.duplicate_iou for a in state.accepted):
            return "near_duplicate"
        if max_coverage is not None and coverage(set(state.accepted) | {q}) > max_coverage:
            return "coverage_overshoot"
        return None

    for q in sorted(boxes):
        if q in known:
            continue
        if stop is not None and stop(state):
            break
        if group is not None and group[q] < len(state.accepted):
            continue
        if group is not None and group[q] > len(state.accepted):
            break
        reason = judge(q)
        if reason is None:
            state.accepted.append(q)
            state.covered = coverage(set(state.accepted))
        state.log.append((q, reason or "accepted"))
    return state


def rejection_counts(candidates: DataFrame, log: list[tuple[int, str]], families: list[str]) -> DataFrame:
    """Decisions in total and by family: grouping sets over (reason) and (reason, family)."""
    decided = candidates.sparkSession.createDataFrame(log, "query_id int, reason string").filter("reason <> 'accepted'")
    both = candidates.join(decided, "query_id")
    sets = [[F.col("reason")], *[[F.col("reason"), F.col(f)] for f in families]]
    return both.groupingSets(sets, "reason", *families).agg(F.count(F.lit(1)).alias("rejected"))


# ---- generation ---------------------------------------------------------------------------


@dataclass(frozen=True)
class Workload:
    """Accepted boxes, one row of statistics, and the decision of every attempt."""

    queries: DataFrame
    stats: DataFrame
    log: DataFrame


def generate_workload(
    points: DataFrame,
    n: int,
    seed: int = 0,
    profile_id: str = "profile_v1",
    target_coverage: float | None = None,
    coverage_tolerance: float | None = None,
    max_queries: int | None = None,
    anchor_mode: str = "mixed_density",
    jitter: float = 0.0,
    limits: Limits | None = None,
    max_attempts: int | None = None,
    spatial_km: float | None = None,
    time_hours: float | None = None,
    chase_uncovered: bool = False,
    batch: int = 64,
    weights: DataFrame | None = None,
) -> Workload:
    """Draw, box and accept queries until the count or the coverage target is met.

    ``chase_uncovered`` draws anchors among points no accepted box covers yet.
    """
    if anchor_mode not in ANCHOR_MODES:
        raise ValueError(f"unknown anchor mode: {anchor_mode!r}")
    spark = points.sparkSession
    target, tolerance = as_share(target_coverage), as_share(coverage_tolerance)
    profile = workload_profile(profile_id, target)
    limits = profile.limits if limits is None else limits
    guard = None if target is None or tolerance is None else min(1.0, target + tolerance)
    slots_wanted = n if target is None else max(n, max_queries or n)
    if max_attempts is not None and max_attempts <= 0:
        raise ValueError("max_attempts must be positive")
    attempts = max_attempts or (profile.attempts_per_query * max(1, n) if limits.active() or guard is not None else None)
    named = bool(profile.anchor_weights)
    weighted = all_weights(points) if weights is None else weights
    totals = data_totals(points)
    bounds = spark.createDataFrame([{k: float(v) for k, v in totals.items() if k not in ("n", "tracks")}])
    plan = {r["slot"]: r for r in query_plan(spark, profile, n, seed).collect()} if named else {}
    state, boxes, tried = Decision(), None, {}

    def done(s: Decision) -> bool:
        if len(s.accepted) >= slots_wanted:
            return True
        if attempts is not None and len(s.log) >= attempts:
            return True
        return target is not None and len(s.accepted) >= n and s.covered >= target

    tries = 4 if limits.active() or guard is not None else 1
    next_id, slot_of = 0, {}
    while not done(state):
        first = len(state.accepted)
        count = min(slots_wanted - first, max(1, batch // tries))
        if chase_uncovered and (target is None or state.covered < target):
            count = 1
        rows = []
        for slot in range(first, first + count):
            for _ in range(tries):
                trial = tried.get(slot, 0)
                tried[slot] = trial + 1
                rows.append((next_id, slot, trial))
                slot_of[next_id] = slot
                next_id += 1
        slots = spark.createDataFrame(rows, "slot int, plan_slot int, trial int")
        slots = _slot_settings(slots, profile, plan, seed, anchor_mode, spatial_km, time_hours)
        pool = weighted
        if chase_uncovered and boxes is not None and (target is None or state.covered < target):
            seen = query_hits(points.select("traj_id", "pos", "t", "lat", "lon"), boxes.filter(F.col("query_id").isin(state.accepted)))
            pool = weighted.join(seen.select("traj_id", "pos").distinct(), ["traj_id", "pos"], "left_anti")
        anchors = sample_anchors(pool, slots.select("slot", "kind", "u")).join(slots.drop("u", "kind"), "slot")
        fresh = make_boxes(anchors, bounds, seed, jitter, profile.time_domain).withColumnRenamed("slot", "query_id")
        fresh = materialize(fresh)
        old = None if boxes is None else boxes.filter(F.col("query_id").isin(state.accepted))
        boxes = fresh if old is None else materialize(old.unionByName(fresh))
        before = len(state.log)
        state = accept_queries(points, boxes, limits, guard, state, slot_of, done, totals)
        if len(state.log) == before:
            break
        # slots that were not reached start over, so the result does not depend on the batch size
        tried = {slot: used for slot, used in tried.items() if slot <= len(state.accepted)}
    full = attempts is not None and len(state.log) >= attempts
    if target is None:
        stop = "fixed_count_completed" if len(state.accepted) >= n else "range_acceptance_exhausted"
    elif len(state.accepted) >= n and state.covered >= target:
        stop = "target_coverage_reached"
    elif full:
        last = state.log[-1][1] if state.log else ""
        stop = "range_coverage_guard_exhausted" if last == "coverage_overshoot" else "range_acceptance_exhausted"
    else:
        stop = "max_queries_reached"
    final = boxes.filter(F.col("query_id").isin(state.accepted)) if boxes is not None else None
    final = shuffle_queries(final, seed).withColumn("profile_id", F.lit(profile.profile_id))
    stats = spark.createDataFrame(
        [(profile.profile_id, len(state.accepted), len(state.log), float(state.covered), target, guard, stop)],
        "profile_id string, queries int, attempts int, coverage double, target double, guard double, stop_reason string",
    )
    return Workload(final, stats, spark.createDataFrame(state.log, "query_id int, reason string"))


def _slot_settings(slots, profile, plan, seed, anchor_mode, spatial_km, time_hours) -> DataFrame:
    """Weight column, draw and footprint of every attempt."""
    spark = slots.sparkSession
    draw = unit_hash("draw", seed, F.col("plan_slot"), F.col("trial"))
    slots = slots.withColumn("u", draw)
    if not profile.anchor_weights:
        mixed = fast_unit_hash(seed, F.col("plan_slot"), F.col("trial")) < MIXED_DENSITY_SHARE
        kind = {"uniform": F.lit("uniform"), "dense": F.lit("density"), "sparse": F.lit("sparse")}.get(
            anchor_mode, F.when(mixed, "density").otherwise("uniform")
        )
        return slots.withColumns(
            {
                "kind": kind,
                "spatial_radius_km": F.lit(spatial_km).cast("double"),
                "time_half_window_hours": F.lit(time_hours).cast("double"),
                "elongation_allowed": F.lit(False),
            }
        )
    rows = [(s, r["anchor_family"], r["footprint_family"]) for s, r in plan.items()]
    planned = spark.createDataFrame(rows, "plan_slot int, _anchor string, _footprint string")
    joined = slots.join(planned, "plan_slot", "left")
    later = {k: unit_hash(profile.profile_id, k, seed, F.col("plan_slot")) for k in ("anchor", "footprint")}
    joined = joined.withColumns(
        {
            "anchor_family": F.coalesce("_anchor", choose_family(profile.anchor_weights, later["anchor"])),
            "footprint_family": F.coalesce("_footprint", choose_family(profile.footprint_weights, later["footprint"])),
        }
    ).drop("_anchor", "_footprint")
    kinds = F.create_map(*[F.lit(x) for pair in FAMILIES.items() for x in pair])
    sizes = profile_table(spark).drop("weight")
    return joined.withColumn("kind", kinds[F.col("anchor_family")]).join(F.broadcast(sizes), "footprint_family")


def shuffle_queries(queries: DataFrame, seed: int) -> DataFrame:
    """Final random order: ``query_id`` becomes the shuffled place, ``draw_id`` keeps the old id."""
    keyed = queries.withColumn("_u", unit_hash("order", seed, F.col("query_id"))).withColumnRenamed("query_id", "draw_id")
    placed = order_index(keyed, [F.col("_u"), F.col("draw_id")], out="query_id")
    return placed.withColumn("query_id", F.col("query_id").cast("int")).drop("_u")


def estimate_coverage(points: DataFrame, counts: list[int], seeds: list[int], stride: int = 1, **options) -> DataFrame:
    """Coverage for each number of queries and seed, on every stride-th track."""
    sample = points.filter(F.col("traj_id") % stride == 0)
    weights = all_weights(sample)
    out = None
    for count in counts:
        for seed in seeds:
            row = generate_workload(sample, count, seed, weights=weights, **options).stats
            row = row.select(F.lit(count).alias("n_queries"), F.lit(seed).alias("seed"), "coverage", "queries")
            out = row if out is None else out.unionByName(row)
    return out


def best_query_count(estimates: DataFrame, target: float) -> DataFrame:
    """The number of queries whose mean coverage is nearest the target."""
    means = estimates.groupBy("n_queries").agg(F.avg("coverage").alias("coverage"))
    gap = F.struct(F.abs(F.col("coverage") - F.lit(as_share(target))), F.col("n_queries"))
    return means.agg(F.min_by("n_queries", gap).alias("n_queries"), F.min_by("coverage", gap).alias("coverage"))


def replicated_workloads(
    points: DataFrame, replicates: int, n: int, seed: int = 0, modes: list[str] | None = None, footprints: list[str] | None = None, **options
) -> tuple[DataFrame, DataFrame]:
    """Seeded workloads cycling over anchor modes and ``km:hours`` footprints: (queries, stats)."""
    weights = all_weights(points)
    queries = stats = None
    for i in range(replicates):
        extra = dict(options)
        if modes:
            extra["anchor_mode"] = modes[i % len(modes)]
        if footprints:
            km, hours = footprints[i % len(footprints)].split(":")
            extra.update(spatial_km=float(km), time_hours=float(hours))
        work = generate_workload(points, n, seed + 1009 * i, weights=weights, **extra)
        tag = F.lit(f"replicate_{i}").alias("workload_id")
        q, s = work.queries.select(tag, "*"), work.stats.select(tag, "*")
        queries = q if queries is None else queries.unionByName(q)
        stats = s if stats is None else stats.unionByName(s)
    return queries, stats


def coverage_warnings(stats: DataFrame, target: float, tolerance: float) -> DataFrame:
    """Workloads whose coverage misses the target band."""
    return stats.filter(F.abs(F.col("coverage") - F.lit(as_share(target))) > F.lit(as_share(tolerance)))


def workload_signature(points: DataFrame, queries: DataFrame, limits: Limits = Limits(duplicate_iou=0.65)) -> DataFrame:
    """One row per workload: coverage, counts per family, hit quantiles, spans and rates."""
    diag = query_diagnostics(points, queries, limits)
    summary = diagnostics_summary(diag)
    coverage = union_coverage(points, queries).select("coverage")
    hours = (F.col("t_end") - F.col("t_start")) / 3600.0
    spans = queries.agg(
        *[F.percentile(hours, F.lit(q)).alias(f"hours_p{int(q * 100)}") for q in (0.10, 0.50, 0.90)],
        *(
            [F.percentile("spatial_radius_km", F.lit(q)).alias(f"radius_km_p{int(q * 100)}") for q in (0.10, 0.50, 0.90)]
            if "spatial_radius_km" in queries.columns
            else []
        ),
    )
    return one_row(summary, coverage, spans)


def family_counts(queries: DataFrame, key: str) -> DataFrame:
    """Queries per family; a missing family counts as unspecified."""
    name = F.coalesce(F.col(key), F.lit("unspecified")) if key in queries.columns else F.lit("unspecified")
    return queries.groupBy(name.alias("family")).agg(F.count(F.lit(1)).alias("queries"))


