"""How well kept points still describe the tracks and answer box queries.

Kept sets are compared many at a time: RETAINED is a long table whose first
columns name the set (by default ``method`` and ``ratio``), and every result has
one row per set.  What does not depend on the kept set is one support table per
workload, built once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.geo import KM_PER_DEGREE, clamp, degree_distance, haversine_km
from ..plans.materialize import materialize
from ..plans.ordered import attach, scan
from .ranges import crossing_brackets, hits_with_boundary, with_steps

SETS = ("method", "ratio")

# Weights of the usefulness score.
USEFULNESS_WEIGHTS = {
    "point_f1": 0.22,
    "ship_f1": 0.13,
    "ship_coverage": 0.13,
    "entry_exit_f1": 0.10,
    "crossing_f1": 0.10,
    "temporal_coverage": 0.10,
    "gap_coverage": 0.09,
    "turn_coverage": 0.07,
    "shape_score": 0.06,
}
WEIGHT_GROUPS = {
    "point_statistical_coverage": ("point_f1",),
    "ship_representation": ("ship_f1", "ship_coverage"),
    "boundary_context": ("entry_exit_f1", "crossing_f1"),
    "temporal_continuity": ("temporal_coverage", "gap_coverage"),
    "route_fidelity": ("turn_coverage", "shape_score"),
}
# Weights of the query-useful score; they sum to 1.
QUERY_USEFUL_WEIGHTS = {
    "ship_balanced_query_point_recall": 0.18,
    "query_balanced_point_recall": 0.10,
    "query_point_mass_ratio": 0.07,
    "query_point_distribution_stability": 0.05,
    "query_local_interpolation_fidelity": 0.10,
    "query_local_turn_change_coverage": 0.07,
    "query_local_speed_heading_coverage": 0.06,
    "query_local_shape_score": 0.05,
    "query_local_gap_continuity": 0.02,
    "ship_f1": 0.08,
    "ship_coverage": 0.05,
    "multi_point_ship_evidence": 0.02,
    "entry_exit_f1": 0.04,
    "crossing_f1": 0.03,
    "query_boundary_evidence": 0.03,
    "endpoint_or_skeleton_sanity": 0.02,
    "global_shape_guardrail_score": 0.02,
    "length_preservation_guardrail": 0.01,
}
TRACK_SCORES = (
    "ship_coverage",
    "temporal_coverage",
    "gap_coverage",
    "gap_time_coverage",
    "gap_distance_coverage",
    "turn_coverage",
    "shape_score",
    "interpolation_fidelity",
)
QUERY_SCORES = ("point_f1", "ship_f1", "entry_exit_f1", "crossing_f1", *TRACK_SCORES)


def subset_f1(kept: Column, full: Column) -> Column:
    """F1 of a kept subset: empty full set counts as 1, nothing kept as 0."""
    recall = kept / F.when(full > 0, full)
    return F.when(full <= 0, 1.0).when(kept <= 0, 0.0).otherwise(2.0 * recall / (1.0 + recall))


def set_f1(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """F1 of two id sets; both empty 1, one empty 0."""
    a = left.select(key).distinct().withColumn("_a", F.lit(1))
    b = right.select(key).distinct().withColumn("_b", F.lit(1))
    both = a.join(b, key, "full").agg(
        F.count("_a").alias("a"), F.count("_b").alias("b"), F.count_if(F.col("_a").isNotNull() & F.col("_b").isNotNull()).alias("both")
    )
    total = F.col("a") + F.col("b")
    return both.select("a", "b", "both", F.when(total == 0, 1.0).otherwise(2.0 * F.col("both") / total).alias("f1"))


def _set_list(retained: DataFrame, sets: tuple[str, ...]) -> Column:
    """The sets as a literal array; there are as many as methods times ratios."""
    rows = retained.select(*sets).distinct().collect()
    return F.array(*[F.struct(*[F.lit(r[c]).alias(c) for c in sets]) for r in rows])


def flag_kept(df: DataFrame, retained: DataFrame, sets: tuple[str, ...] = SETS) -> DataFrame:
    """Repeat ``df`` once per set and add ``kept``."""
    spread = df.withColumn("_set", F.explode(_set_list(retained, sets))).select("_set.*", *df.columns)
    keys = [*sets, "traj_id", "pos"]
    marked = spread.join(retained.select(*keys, F.lit(True).alias("kept")), keys, "left")
    return marked.withColumn("kept", F.coalesce("kept", F.lit(False)))


def _sed_ped(left: str, right: str) -> tuple[Column, Column]:
    """Time-synchronous and perpendicular error in km of a point between two kept points."""
    lt, la, lo = (F.col(f"{left}.{c}") for c in ("t", "lat", "lon"))
    rt, ra, ro = (F.col(f"{right}.{c}") for c in ("t", "lat", "lon"))
    t, lat, lon = F.col("t"), F.col("lat"), F.col("lon")
    share = clamp((t - lt) / F.greatest(rt - lt, F.lit(1e-9)))
    dy = (lat - (la + share * (ra - la))) * KM_PER_DEGREE
    dx = (lon - (lo + share * (ro - lo))) * F.cos(F.radians(lat)) * KM_PER_DEGREE
    flat = F.cos(F.radians(la)) * KM_PER_DEGREE
    by, bx = (ra - la) * KM_PER_DEGREE, (ro - lo) * flat
    py, px = (lat - la) * KM_PER_DEGREE, (lon - lo) * flat
    chord = F.greatest(F.sqrt(bx * bx + by * by), F.lit(1e-9))
    return F.sqrt(dx * dx + dy * dy), F.abs(bx * py - by * px) / chord


def _bracketed(df: DataFrame, keys: list[str], extra: tuple[str, ...] = ()) -> DataFrame:
    """Nearest kept row before and after each row, as structs ``_l`` and ``_r``."""
    here = F.when(F.col("kept"), F.struct("t", "lat", "lon", *extra))
    return scan(df, keys, "pos", {"_l": ("last_before", here), "_r": ("next_after", here)}, "traj_id")


def sed_ped(points: DataFrame, retained: DataFrame, sets: tuple[str, ...] = SETS) -> DataFrame:
    """Errors of every dropped point that lies between two kept points of its track."""
    flagged = flag_kept(points.select("traj_id", "pos", "t", "lat", "lon", "n_points"), retained, sets)
    near = _bracketed(flagged, [*sets, "traj_id"])
    sed, ped = _sed_ped("_l", "_r")
    between = ~F.col("kept") & F.col("_l").isNotNull() & F.col("_r").isNotNull()
    return near.withColumns({"sed_km": F.when(between, sed), "ped_km": F.when(between, ped)}).drop("_l", "_r")


def geometric_distortion(errors: DataFrame, sets: tuple[str, ...] = SETS) -> DataFrame:
    """Point-weighted mean and maximum errors per set, from ``sed_ped``."""
    zero = F.lit(0.0)
    return errors.groupBy(*sets).agg(
        *[F.coalesce(f(f"{e}_km"), zero).alias(f"{n}_{e}_km") for e in ("sed", "ped") for n, f in (("avg", F.avg), ("max", F.max))],
        F.count("sed_km").alias("removed_points"),
    )


def _kept_length(points: DataFrame, retained: DataFrame, sets: tuple[str, ...]) -> DataFrame:
    """Path length over kept points per set and track, with the number of kept points."""
    kept = points.select("traj_id", "pos", "lat", "lon").join(retained.select(*sets, "traj_id", "pos"), ["traj_id", "pos"])
    before = scan(kept, [*sets, "traj_id"], "pos", {"_p": ("last_before", F.struct("lat", "lon"))}, "traj_id")
    step = haversine_km("_p.lat", "_p.lon", "lat", "lon", floor=1e-9)
    return before.groupBy(*sets, "traj_id").agg(
        F.coalesce(F.sum(step), F.lit(0.0)).alias("kept_km"), F.count(F.lit(1)).alias("kept_points")
    )


def track_lengths(points: DataFrame, retained: DataFrame, sets: tuple[str, ...] = SETS) -> DataFrame:
    """Original and kept path length of every track in every set."""
    original = with_steps(points).groupBy("traj_id", "mmsi", "n_points").agg(F.sum("step_km").alias("length_km"))
    spread = original.withColumn("_set", F.explode(_set_list(retained, sets))).select("_set.*", *original.columns)
    both = spread.join(_kept_length(points, retained, sets), [*sets, "traj_id"], "left")
    return both.na.fill({"kept_km": 0.0, "kept_points": 0})


def length_preservation(lengths: DataFrame, sets: tuple[str, ...] = SETS) -> DataFrame:
    """Kept over original length in total, in [0, 1]."""
    eligible = (F.col("n_points") >= 2) & (F.col("length_km") > 1e-9)
    sums = lengths.groupBy(*sets).agg(
        F.sum(F.when(eligible, F.col("length_km"))).alias("_all"), F.sum(F.when(eligible, F.col("kept_km"))).alias("_kept")
    )
    share = F.when(F.col("_all") > 1e-9, clamp(F.col("_kept") / F.col("_all"))).otherwise(F.lit(1.0))
    return sums.select(*sets, share.alias("length_preservation"))


def length_loss(lengths: DataFrame, min_km: float = 1.0) -> DataFrame:
    """Per track: loss in km and percent, kept and removed points; only tracks of some length."""
    loss = F.col("length_km") - F.col("kept_km")
    return lengths.filter(F.col("length_km") >= min_km).withColumns(
        {
            "removed_points": F.col("n_points") - F.col("kept_points"),
            "loss_km": loss,
            "loss_pct": loss / F.col("length_km") * 100.0,
        }
    )


def most_distorted(loss: DataFrame, top_k: int = 25, least: bool = False) -> DataFrame:
    order = F.col("loss_pct").asc() if least else F.col("loss_pct").desc()
    return loss.orderBy(order, "traj_id").limit(top_k)


def retained_gap_stats(points: DataFrame, retained: DataFrame, sets: tuple[str, ...] = SETS) -> DataFrame:
    """Mean, track-relative mean and maximum distance in positions between kept neighbours."""
    kept = points.select("traj_id", "pos", "n_points").join(retained.select(*sets, "traj_id", "pos"), ["traj_id", "pos"])
    before = scan(kept, [*sets, "traj_id"], "pos", {"_p": ("last_before", "pos")}, "traj_id")
    gap = F.col("pos") - F.col("_p")
    zero = F.lit(0.0)
    return before.groupBy(*sets).agg(
        F.coalesce(F.avg(gap), zero).alias("avg_gap"),
        F.coalesce(F.avg(gap / F.greatest(F.col("n_points") - 1, F.lit(1))), zero).alias("avg_gap_norm"),
        F.coalesce(F.max(gap).cast("double"), zero).alias("max_gap"),
    )


def endpoint_sanity(points: DataFrame, retained: DataFrame, sets: tuple[str, ...] = SETS) -> DataFrame:
    """Share of tracks with at least two kept points that keep both ends."""
    ends = F.col("is_start").cast("int") + F.col("is_end").cast("int")
    kept = points.filter("n_points > 1").withColumn("_ends", ends).select("traj_id", "pos", "_ends")
    kept = kept.join(retained.select(*sets, "traj_id", "pos"), ["traj_id", "pos"])
    per_track = kept.groupBy(*sets, "traj_id").agg(F.count(F.lit(1)).alias("k"), F.sum("_ends").alias("e")).filter("k >= 2")
    return per_track.groupBy(*sets).agg(F.avg((F.col("e") == 2).cast("double")).alias("endpoint_sanity"))


# ---- box query audit ----------------------------------------------------------------------


def audit_support(points: DataFrame, queries: DataFrame) -> DataFrame:
    """Everything about (query, point) hits that no kept set changes.

    Adds the order ``i`` and number ``n_in`` of in-box points of the track, path
    length ``cum_km`` along them and the turn weight ``turn_w``.
    """
    hits = hits_with_boundary(points, queries).select(
        "query_id", "traj_id", "pos", "t", "lat", "lon", "turn_score", "n_points", "is_boundary"
    )
    group = ["query_id", "traj_id"]
    here = F.struct("lat", "lon")
    wide = scan(
        hits,
        group,
        "pos",
        {"_p": ("last_before", here), "_n": ("next_after", here), "i": ("sum", F.lit(1).cast("bigint"))},
        "traj_id",
    )
    step = F.coalesce(haversine_km("_p.lat", "_p.lon", "lat", "lon", floor=1e-9), F.lit(0.0))
    bend = (
        degree_distance("_p.lat", "_p.lon", "lat", "lon")
        + degree_distance("lat", "lon", "_n.lat", "_n.lon")
        - degree_distance("_p.lat", "_p.lon", "_n.lat", "_n.lon")
    )
    inner = F.col("_p").isNotNull() & F.col("_n").isNotNull()
    curve = F.when(inner, F.greatest(bend, F.lit(0.0))).otherwise(F.lit(0.0))
    wide = wide.withColumns({"_step": step, "curvature": curve, "i": F.col("i") - 1})
    wide = wide.withColumn("turn_w", F.greatest("curvature", F.greatest("turn_score", F.lit(0.0))))
    wide = scan(wide, group, "pos", {"cum_km": ("sum", "_step")}, "traj_id")
    return attach(wide, group, {"n_in": F.count(F.lit(1))}, "traj_id").drop("_p", "_n", "_step")


def flagged_support(
    points: DataFrame, retained: DataFrame, support: DataFrame, sets: tuple[str, ...] = SETS, errors: DataFrame | None = None
) -> DataFrame:
    """Support rows per set with the kept flag and the whole-track error of dropped points."""
    errors = sed_ped(points, retained, sets) if errors is None else errors
    counts = attach(errors, [*sets, "traj_id"], {"kept_in_track": F.count_if("kept")}, "traj_id")
    slim = counts.select(*sets, "traj_id", "pos", "kept", "kept_in_track", "sed_km", "ped_km")
    return support.join(slim, ["traj_id", "pos"])


def mean_step(km: Column, n: Column) -> Column:
    """Mean distance between the in-box points of a visit."""
    return F.greatest(km / F.greatest(n - 1, F.lit(1)), F.lit(1e-6))


def coverage_scores(
    n: Column, r: Column, span: Column, kept_span: Column, worst: Column, km: Column, w: Column, kw: Column, err: Column, err_n: Column
) -> dict[str, Column]:
    """The five scores of a visit that the usefulness score weighs, from its state.

    ``n`` points of which ``r`` are kept, over ``span`` seconds (``kept_span``) and ``km``;
    ``worst``: most missing points in a row; ``w`` and ``kw``: turn weights; ``err`` and
    ``err_n``: summed error and number of dropped points between kept ones.
    """
    none, mass = r <= 0, kw / w
    temporal = F.when(none, 0.0).when(span <= 1e-9, 1.0).when(r < 2, 0.0).otherwise(clamp(kept_span / span))
    close = F.when(err_n <= 0, 1.0).otherwise(1.0 / (1.0 + err / (2.0 * err_n) / mean_step(km, n)))
    return {
        "ship_coverage": subset_f1(r, n),
        "temporal_coverage": temporal,
        "gap_coverage": F.when(none, 0.0).when(n == 1, 1.0).otherwise(clamp(1.0 - worst / F.greatest(n - 2, F.lit(1)))),
        "turn_coverage": F.when(none, 0.0).when(w <= 1e-12, 1.0).when(kw <= 0, 0.0).otherwise(2.0 * mass / (1.0 + mass)),
        "shape_score": F.when(none, 0.0).when(km <= 1e-9, 1.0).when(r < 2, 0.0).otherwise(clamp(temporal * close)),
    }


def track_scores(flagged: DataFrame, sets: tuple[str, ...] = SETS) -> DataFrame:
    """The eight per-track scores of every (set, query, track)."""
    keys = [*sets, "query_id", "traj_id"]
    near = _bracketed(flagged, keys, ("i", "cum_km"))
    sed, ped = _sed_ped("_l", "_r")
    kept = F.col("kept")
    between = ~kept & F.col("_l").isNotNull() & F.col("_r").isNotNull()
    follows = kept & F.col("_l").isNotNull()
    missing = F.when(follows, F.col("i") - F.col("_l.i") - 1)
    gap = F.when(missing > 0, F.lit(True))
    near = near.withColumns(
        {
            "_err": F.when(between, sed + ped),
            "_missing": missing,
            "_gap_t": F.when(gap, F.col("t") - F.col("_l.t")),
            "_gap_km": F.when(gap, F.col("cum_km") - F.col("_l.cum_km")),
        }
    )
    def over_kept(f, c):
        return f(F.when(kept, F.col(c)))

    g = near.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"),
        F.count_if("kept").alias("r"),
        F.min("t").alias("t0"),
        F.max("t").alias("t1"),
        F.max("cum_km").alias("km"),
        over_kept(F.min, "t").alias("kt0"),
        over_kept(F.max, "t").alias("kt1"),
        over_kept(F.min, "i").alias("ki0"),
        over_kept(F.max, "i").alias("ki1"),
        over_kept(F.min, "cum_km").alias("kk0"),
        over_kept(F.max, "cum_km").alias("kk1"),
        F.max("_missing").alias("inner_missing"),
        F.max("_gap_t").alias("inner_t"),
        F.max("_gap_km").alias("inner_km"),
        F.sum("turn_w").alias("w"),
        F.sum(F.when(kept, F.col("turn_w"))).alias("kw"),
        F.sum("_err").alias("err"),
        F.count("_err").alias("err_n"),
        F.avg((F.col("sed_km") + F.col("ped_km")) * 0.5).alias("track_err"),
        F.max("kept_in_track").alias("kept_in_track"),
    )
    c = F.col
    n, r, span = c("n"), c("r"), c("t1") - c("t0")
    none = r <= 0
    worst = F.greatest(c("ki0"), n - 1 - c("ki1"), c("inner_missing"))
    scores = coverage_scores(n, r, span, c("kt1") - c("kt0"), worst, c("km"), c("w"), c("kw"), c("err"), c("err_n"))

    def gap_span(first: Column, last: Column, inner: str, whole: Column) -> Column:
        worst = F.greatest(first, last, c(inner), F.lit(0.0))
        return F.when(none, 0.0).when(n == 1, 1.0).when(whole <= 1e-9, 1.0).otherwise(clamp(1.0 - worst / whole))

    step = mean_step(c("km"), n)
    evidence = F.least(F.lit(1.0), r / F.lit(2.0))
    fidelity = (
        F.when(c("kept_in_track") < 2, 0.0)
        .when(r >= n, 1.0)
        .when(c("track_err").isNull(), 0.0)
        .otherwise(clamp(evidence / (1.0 + c("track_err") / step)))
    )
    return g.select(
        *keys,
        n.alias("full_points"),
        r.alias("kept_points"),
        *[v.alias(k) for k, v in scores.items()],
        gap_span(c("kt0") - c("t0"), c("t1") - c("kt1"), "inner_t", span).alias("gap_time_coverage"),
        gap_span(c("kk0"), c("km") - c("kk1"), "inner_km", c("km")).alias("gap_distance_coverage"),
        fidelity.alias("interpolation_fidelity"),
    )


def _over_all(
    points: DataFrame, retained: DataFrame, queries: DataFrame, sets: tuple[str, ...]
) -> DataFrame:
    every = queries.select("query_id").withColumn("_set", F.explode(_set_list(retained, sets)))
    return every.select("_set.*", "query_id")


def support_f1(support: DataFrame, retained: DataFrame, sets: tuple[str, ...], name: str) -> DataFrame:
    """Per (set, query): F1 of kept points in a support of (query_id, traj_id, pos)."""
    flagged = flag_kept(support.select("query_id", "traj_id", "pos"), retained, sets)
    g = flagged.groupBy(*sets, "query_id").agg(F.count(F.lit(1)).alias("_n"), F.count_if("kept").alias("_r"))
    return g.select(*sets, "query_id", subset_f1(F.col("_r"), F.col("_n")).alias(name))


def query_scores(
    points: DataFrame,
    retained: DataFrame,
    queries: DataFrame,
    sets: tuple[str, ...] = SETS,
    support: DataFrame | None = None,
    crossings: DataFrame | None = None,
    errors: DataFrame | None = None,
) -> DataFrame:
    """All components for every (set, query); queries without hits get 1."""
    support = materialize(audit_support(points, queries)) if support is None else support
    crossings = crossing_brackets(points, queries) if crossings is None else crossings
    flagged = flagged_support(points, retained, support, sets, errors)
    per_track = track_scores(flagged, sets)
    keys = [*sets, "query_id"]
    q = per_track.groupBy(*keys).agg(
        F.sum("full_points").alias("_n"),
        F.sum("kept_points").alias("_r"),
        F.count(F.lit(1)).alias("_ships"),
        F.count_if(F.col("kept_points") > 0).alias("_kept_ships"),
        *[F.avg(s).alias(s) for s in TRACK_SCORES],
    )
    q = q.select(
        *keys,
        subset_f1(F.col("_r"), F.col("_n")).alias("point_f1"),
        subset_f1(F.col("_kept_ships"), F.col("_ships")).alias("ship_f1"),
        *TRACK_SCORES,
    )
    edges = support_f1(support.filter("is_boundary"), retained, sets, "entry_exit_f1")
    cross = support_f1(crossings, retained, sets, "crossing_f1")
    out = _over_all(points, retained, queries, sets)
    for part in (q, edges, cross):
        out = out.join(part, keys, "left")
    return out.select(*keys, *[F.coalesce(s, F.lit(1.0)).alias(s) for s in QUERY_SCORES])


def range_audit(scores: DataFrame, sets: tuple[str, ...] = SETS) -> DataFrame:
    """Components averaged over queries, with the weighted scores."""
    mean = scores.groupBy(*sets).agg(*[F.avg(s).alias(s) for s in QUERY_SCORES])
    return range_usefulness(mean)


def _weighted(weights: dict[str, float], swap: dict[str, str] | None = None) -> Column:
    total = F.lit(0.0)
    for name, weight in weights.items():
        total = total + F.lit(weight) * F.col((swap or {}).get(name, name))
    return total


def range_usefulness(components: DataFrame) -> DataFrame:
    """Weighted usefulness and its variants with another gap component."""
    out = components.withColumn("gap_min_coverage", F.least("gap_time_coverage", "gap_distance_coverage"))
    scores = {"range_usefulness": _weighted(USEFULNESS_WEIGHTS)}
    for kind in ("time", "distance", "min"):
        scores[f"usefulness_gap_{kind}"] = _weighted(USEFULNESS_WEIGHTS, {"gap_coverage": f"gap_{kind}_coverage"})
    return out.withColumns(scores)


def weight_summary(df: DataFrame) -> DataFrame:
    """Weight of each component group, next to any one-row table's session."""
    rows = [(g, float(sum(USEFULNESS_WEIGHTS[c] for c in cs))) for g, cs in WEIGHT_GROUPS.items()]
    return df.sparkSession.createDataFrame(rows, "component_group string, weight double")


def query_useful(components: DataFrame) -> DataFrame:
    """The 18-component score; needs the audit columns and three global numbers."""

    def unit(c: Column, default: float = 0.0) -> Column:
        return clamp(F.when(c.isNull() | F.isnan(c), F.lit(default)).otherwise(c))

    a = {s: unit(F.col(s)) for s in QUERY_SCORES}
    gap_min = F.least(a["gap_time_coverage"], a["gap_distance_coverage"])
    derived = {
        "ship_balanced_query_point_recall": 0.5 * a["point_f1"] + 0.5 * a["ship_coverage"],
        "query_balanced_point_recall": a["point_f1"],
        "query_point_mass_ratio": a["point_f1"],
        "query_point_distribution_stability": F.least(a["point_f1"], gap_min),
        "query_local_interpolation_fidelity": a["interpolation_fidelity"],
        "query_local_turn_change_coverage": a["turn_coverage"],
        "query_local_speed_heading_coverage": 0.5 * a["turn_coverage"] + 0.5 * a["temporal_coverage"],
        "query_local_shape_score": a["shape_score"],
        "query_local_gap_continuity": gap_min,
        "ship_f1": a["ship_f1"],
        "ship_coverage": a["ship_coverage"],
        "multi_point_ship_evidence": a["ship_coverage"],
        "entry_exit_f1": a["entry_exit_f1"],
        "crossing_f1": a["crossing_f1"],
        "query_boundary_evidence": 0.5 * a["entry_exit_f1"] + 0.5 * a["crossing_f1"],
        "endpoint_or_skeleton_sanity": unit(F.col("endpoint_sanity"), 1.0),
        "global_shape_guardrail_score": 1.0 / (1.0 + F.greatest(F.coalesce(F.col("avg_sed_km"), F.lit(0.0)), F.lit(0.0))),
        "length_preservation_guardrail": unit(F.col("length_preservation"), 1.0),
    }
    score = F.lit(0.0)
    for name, weight in QUERY_USEFUL_WEIGHTS.items():
        score = score + F.lit(weight) * unit(derived[name])
    return components.withColumns({"query_useful": score, "query_useful_components": F.struct(*[v.alias(k) for k, v in derived.items()])})


def evaluate(
    points: DataFrame, retained: DataFrame, queries: DataFrame, sets: tuple[str, ...] = SETS
) -> DataFrame:
    """The whole metric row of every kept set."""
    errors = materialize(sed_ped(points, retained, sets))
    audit = range_audit(query_scores(points, retained, queries, sets, errors=errors), sets)
    size = points.select(F.count(F.lit(1))).scalar()
    kept = retained.groupBy(*sets).agg(F.count(F.lit(1)).alias("kept_points"))
    kept = kept.withColumn("kept_share", F.col("kept_points") / size)
    parts = [
        geometric_distortion(errors, sets),
        length_preservation(track_lengths(points, retained, sets), sets),
        retained_gap_stats(points, retained, sets),
        endpoint_sanity(points, retained, sets),
        kept,
    ]
    for part in parts:
        audit = audit.join(part, list(sets), "left")
    return query_useful(audit)


# ---- tables over results ---------------------------------------------------------------


def comparison_table(results: DataFrame, metrics: list[str], baseline: str) -> DataFrame:
    """Each metric of each method next to a baseline at the same ratio: difference and percent."""
    long = results.unpivot(["method", "ratio"], metrics, "metric", "value")
    base = long.filter(F.col("method") == baseline).select("ratio", "metric", F.col("value").alias("baseline"))
    both = long.join(base, ["ratio", "metric"], "left")
    diff = F.col("value") - F.col("baseline")
    return both.withColumns({"diff": diff, "diff_pct": F.when(F.col("baseline") != 0, diff / F.abs("baseline") * 100.0)})


def wide_table(results: DataFrame, metric: str, methods: list[str]) -> DataFrame:
    """Methods side by side, one row per ratio."""
    return results.groupBy("ratio").pivot("method", methods).agg(F.first(metric))


def shift_table(results: DataFrame, score: str, eval_names: list[str]) -> DataFrame:
    """Score by training workload (rows) and evaluation workload (columns)."""
    return results.groupBy("train_workload").pivot("eval_workload", eval_names).agg(F.first(score))


def fill_summary(results: DataFrame, score: str, methods: list[str], controls: list[str]) -> DataFrame:
    """Difference of each method to each control at the same ratio."""
    a = results.filter(F.col("method").isin(methods)).select("ratio", "method", F.col(score).alias("value"))
    b = results.filter(F.col("method").isin(controls)).select("ratio", F.col("method").alias("control"), F.col(score).alias("control_value"))
    return a.join(b, "ratio").withColumn("delta", F.col("value") - F.col("control_value"))
