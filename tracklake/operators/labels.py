"""Per-point usefulness labels and training targets.

Labels are sparse tables (traj_id, pos, label): a point without a row has label 0.
"""

from __future__ import annotations

import heapq
import math
from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.geo import clamp, degree_distance, heading_change
from ..functions.spacing import base_size, budget, is_evenly_spaced
from ..plans.groups import map_groups
from ..plans.materialize import materialize
from ..plans.ordered import attach, first_overall, neighbors, rank_within, scan
from ..plans.quantiles import quantiles, quantiles_within
from .metrics import USEFULNESS_WEIGHTS, audit_support
from .ranges import crossing_brackets, hits_with_boundary, query_hits
from .simplify import _require_bounded, convert_scores

POINT = ["traj_id", "pos"]
VISIT = ["query_id", "traj_id"]
COMPONENTS = tuple(USEFULNESS_WEIGHTS)
# Weights of the continuity target and of the structural score.
CONTINUITY_WEIGHTS = {
    "entry_exit_f1": 0.22,
    "crossing_f1": 0.16,
    "temporal_coverage": 0.22,
    "gap_coverage": 0.22,
    "turn_coverage": 0.08,
    "shape_score": 0.10,
}
STRUCTURAL_WEIGHTS = {"uniqueness": 0.40, "turn": 0.20, "gap": 0.15, "globality": 0.15, "endpoint": 0.10}
TARGETS = ("hit_probability", "behavior", "boundary", "replacement", "block_budget")
LABEL_MODES = ("point_f1", "usefulness", "usefulness_balanced", "usefulness_ship_balanced")


def _gain(n: Column) -> Column:
    """F1 of keeping one of n points."""
    return F.lit(2.0) / (n + 1.0)


def _boost(weight: float, boundary: Column, n: Column, n_boundary: Column) -> Column:
    """Extra weight on boundary points that leaves the mass of the group unchanged."""
    if weight <= 0:
        return F.lit(1.0)
    raw = 1.0 + weight * boundary.cast("double")
    return raw / ((n + weight * n_boundary) / n)


def point_f1_labels(points: DataFrame, queries: DataFrame, boundary_prior: float = 0.0) -> DataFrame:
    """Every in-box point gets the F1 of keeping it alone, averaged over queries."""
    total = queries.count()
    slim = points.select("traj_id", "pos", "t", "lat", "lon", "n_points")
    hits = hits_with_boundary(slim, queries).select("query_id", *POINT, "is_boundary")
    sizes = hits.groupBy("query_id").agg(F.count(F.lit(1)).alias("_n"), F.count_if("is_boundary").alias("_b"))
    both = hits.join(sizes, "query_id")
    value = _gain(F.col("_n")) * _boost(boundary_prior, F.col("is_boundary"), F.col("_n"), F.col("_b"))
    summed = both.groupBy(*POINT).agg(F.sum(value).alias("_s"))
    return summed.select(*POINT, clamp(F.col("_s") / F.lit(float(max(1, total)))).alias("label"))


def usefulness_components(
    points: DataFrame,
    queries: DataFrame,
    ship_balanced: bool = False,
    boundary_prior: float = 0.0,
    support: DataFrame | None = None,
    crossings: DataFrame | None = None,
) -> DataFrame:
    """Nine component labels per point and their clamped sum, averaged over queries."""
    total = float(max(1, queries.count()))
    support = audit_support(points, queries) if support is None else support
    crossings = crossing_brackets(points, queries) if crossings is None else crossings
    w, c = USEFULNESS_WEIGHTS, F.col
    n, i = c("n_in"), c("i")
    where = i / F.greatest(n - 1, F.lit(1))
    middle = F.floor((n - 1) / 2) / F.greatest(n - 1, F.lit(1))
    gap_w = F.when(n >= 3, 1.0 + F.least(where, 1.0 - where) / middle).otherwise(F.lit(1.0))
    visits = attach(
        support.withColumn("_gap_w", gap_w),
        VISIT,
        {
            "_turn_all": F.sum("turn_w"),
            "_gap_all": F.sum("_gap_w"),
            "_curve_all": F.sum("curvature"),
            "_turns_all": F.sum("turn_score"),
            "_b_visit": F.count_if("is_boundary"),
        },
        "traj_id",
    )
    per_visit = visits.filter(i == 0).select("query_id", "n_in", "_b_visit")
    sizes = per_visit.groupBy("query_id").agg(
        F.sum("n_in").alias("_h"),
        F.count(F.lit(1)).alias("_v"),
        F.sum("_b_visit").alias("_b"),
        F.count_if(c("_b_visit") > 0).alias("_vb"),
    )
    wide = visits.join(sizes, "query_id")
    mean_curve = c("_curve_all") / F.greatest(n - 2, F.lit(1))
    bent = (n >= 3) & (mean_curve > 1e-12)
    inner = (i > 0) & (i < n - 1)
    shape_w = 1.0 + F.when(bent & inner, c("curvature") / mean_curve).otherwise(F.lit(0.0)) + c("turn_score")
    shape_all = n + F.when(bent, (n - 2).cast("double")).otherwise(F.lit(0.0)) + c("_turns_all")
    ship = _gain(c("_v"))
    end = (i == 0).cast("double") + (i == n - 1).cast("double")
    if ship_balanced:
        boost = _boost(boundary_prior, c("is_boundary"), n, c("_b_visit"))
        point = w["point_f1"] / c("_v") * _gain(n) * boost
        edge = F.when(c("is_boundary"), w["entry_exit_f1"] / c("_vb") * _gain(c("_b_visit")))
    else:
        boost = _boost(boundary_prior, c("is_boundary"), c("_h"), c("_b"))
        point = w["point_f1"] * _gain(c("_h")) * boost
        edge = F.when(c("is_boundary"), w["entry_exit_f1"] * _gain(c("_b")))
    values = {
        "point_f1": point,
        "ship_f1": w["ship_f1"] * ship / n,
        "ship_coverage": w["ship_coverage"] / c("_v") * _gain(n),
        "entry_exit_f1": F.coalesce(edge, F.lit(0.0)),
        "crossing_f1": F.lit(0.0),
        "temporal_coverage": w["temporal_coverage"] / c("_v") * end * 0.5,
        "gap_coverage": w["gap_coverage"] / c("_v") * c("_gap_w") / c("_gap_all"),
        "turn_coverage": F.when(c("_turn_all") > 1e-12, w["turn_coverage"] / c("_v") * c("turn_w") / c("_turn_all")).otherwise(F.lit(0.0)),
        "shape_score": w["shape_score"] * ship * shape_w / shape_all,
    }
    inside = wide.select(*POINT, *[v.alias(k) for k, v in values.items()])
    if ship_balanced:
        per_track = crossings.groupBy(*VISIT).agg(F.count(F.lit(1)).alias("_c"))
        per_query = per_track.groupBy("query_id").agg(F.count(F.lit(1)).alias("_vc"))
        cross = crossings.join(per_track, VISIT).join(per_query, "query_id")
        value = w["crossing_f1"] / c("_vc") * _gain(c("_c"))
    else:
        per_query = crossings.groupBy("query_id").agg(F.count(F.lit(1)).alias("_c"))
        cross = crossings.join(per_query, "query_id")
        value = w["crossing_f1"] * _gain(c("_c"))
    zeros = [F.lit(0.0).alias(k) for k in COMPONENTS if k != "crossing_f1"]
    outside = cross.select(*POINT, value.alias("crossing_f1"), *zeros)
    summed = inside.unionByName(outside).groupBy(*POINT).agg(*[(F.sum(k) / total).alias(k) for k in COMPONENTS])
    return summed.withColumn("label", clamp(reduce(lambda a, b: a + b, [c(k) for k in COMPONENTS])))


def balance_component_mass(components: DataFrame) -> DataFrame:
    """Rescale the components so that their masses stand in the ratio of their weights."""
    row = components.agg(*[F.sum(k).alias(k) for k in COMPONENTS]).first()
    masses = {k: float(row[k] or 0.0) for k in COMPONENTS}
    live = {k: m for k, m in masses.items() if m > 1e-12}
    total, available = sum(live.values()), sum(USEFULNESS_WEIGHTS[k] for k in live)
    if not live:
        return components
    scale = {k: total * USEFULNESS_WEIGHTS[k] / available / live[k] if k in live else 0.0 for k in COMPONENTS}
    scaled = components.withColumns({k: F.col(k) * F.lit(scale[k]) for k in COMPONENTS})
    return scaled.withColumn("label", clamp(reduce(lambda a, b: a + b, [F.col(k) for k in COMPONENTS])))


def labels(points: DataFrame, queries: DataFrame, mode: str = "point_f1", boundary_prior: float = 0.0) -> DataFrame:
    """Labels by mode."""
    if mode not in LABEL_MODES:
        raise ValueError(f"unknown label mode: {mode!r}")
    if mode == "point_f1":
        return point_f1_labels(points, queries, boundary_prior)
    parts = usefulness_components(points, queries, mode == "usefulness_ship_balanced", boundary_prior)
    if mode == "usefulness_balanced":
        parts = balance_component_mass(parts)
    return parts.select(*POINT, "label")


# ---- factorised targets ------------------------------------------------------------------


def behavior_change(points: DataFrame) -> DataFrame:
    """Turn, heading and speed change to both neighbours, above the track's 70th percentile."""
    wanted = {"_hp": ("heading", -1), "_hn": ("heading", 1), "_sp": ("speed", -1), "_sn": ("speed", 1)}
    near = neighbors(points, ["traj_id"], "pos", wanted, "traj_id")
    zero = F.lit(0.0)
    angles = [F.coalesce(F.greatest(heading_change(o, "heading"), zero) / 180.0, zero) for o in ("_hp", "_hn")]
    speeds = [F.coalesce(F.abs(F.col("speed") - F.col(o)), zero) for o in ("_sp", "_sn")]
    near = near.withColumns({"_angle": F.greatest(*angles), "_dv": F.greatest(*speeds)})
    top = near.agg(F.max("_dv")).first()[0] or 0.0
    pace = F.col("_dv") / F.lit(top) if top > 1e-12 else zero
    near = near.withColumn("_w", clamp(F.greatest(F.greatest("turn_score", zero), F.col("_angle"), pace)))
    near = attach(near, ["traj_id"], {"_lo": F.min("_w"), "_hi": F.max("_w")}, "traj_id")
    cut = quantiles_within(near.select(*POINT, "_w"), ["traj_id"], "_w", {"_q": 0.70}, ["pos"], "traj_id")
    both = near.join(cut, "traj_id")
    high = clamp((F.col("_w") - F.col("_q")) / F.greatest(F.col("_hi") - F.col("_q"), F.lit(1e-6)))
    value = F.when(F.col("_hi") - F.col("_lo") > 1e-6, high).otherwise(zero)
    return both.withColumn("behavior", value).select(*points.columns, "behavior")


def replacement_support(values: DataFrame, keep_fraction: float = 0.5) -> DataFrame:
    """In every run of consecutive positions of a visit keep the top share of values.

    ``values`` has (query_id, traj_id, pos, value) with positive values only.
    """
    runs = scan(values, VISIT, "pos", {"_k": ("sum", F.lit(1).cast("bigint"))}, "traj_id")
    runs = runs.withColumn("_run", F.col("pos") - F.col("_k")).drop("_k")
    keys = [*VISIT, "_run"]
    ranked = rank_within(runs, keys, [F.col("value").desc(), F.col("pos")], "_r", "traj_id")
    sized = attach(ranked, keys, {"_len": F.count(F.lit(1))}, "traj_id")
    keep = F.greatest(F.lit(1), F.ceil(F.lit(keep_fraction) * F.col("_len")))
    return sized.filter(F.col("_r") <= keep).drop("_run", "_r", "_len")


def query_useful_targets(points: DataFrame, queries: DataFrame, crossings: DataFrame | None = None) -> DataFrame:
    """Four point targets and the score built from them; ``block_budget_target`` gives the fifth."""
    total = float(max(1, queries.count()))
    moving = behavior_change(points)
    hits = materialize(hits_with_boundary(moving, queries).select("query_id", *POINT, "is_boundary", "behavior"))
    crossings = crossing_brackets(points, queries) if crossings is None else crossings
    live = hits.select("query_id").distinct()
    cross = crossings.join(live, "query_id", "left_semi").withColumn("_cross", F.lit(True))
    both = hits.withColumn("_hit", F.lit(True)).join(cross, ["query_id", *POINT], "full")
    flag = {k: F.coalesce(F.col(k), F.lit(False)).cast("double") for k in ("_hit", "_cross", "is_boundary")}
    value = flag["_hit"] * (0.50 + 0.35 * F.coalesce("behavior", F.lit(0.0))) + 0.40 * flag["is_boundary"] + 0.30 * flag["_cross"]
    valued = both.withColumns({"value": value, "_edge": flag["is_boundary"] + flag["_cross"], "_in": flag["_hit"]})
    valued = materialize(valued.select("query_id", *POINT, "value", "_edge", "_in", "behavior"))
    kept = replacement_support(valued.select("query_id", *POINT, "value"))
    best = kept.groupBy(*POINT).agg(F.sum("value").alias("_rep"))
    per_point = valued.groupBy(*POINT).agg(
        F.sum("_in").alias("_hits"), F.sum("_edge").alias("_edges"), F.sum(F.col("_in") * F.coalesce("behavior", F.lit(0.0))).alias("_beh")
    )
    out = per_point.join(best, POINT, "left")
    out = out.select(
        *POINT,
        clamp(F.col("_hits") / total).alias("hit_probability"),
        F.when(F.col("_hits") > 0, clamp(F.col("_beh") / F.col("_hits"))).otherwise(F.lit(0.0)).alias("behavior"),
        F.pow(clamp(F.col("_edges") / total), F.lit(2.0)).alias("boundary"),
        clamp(F.coalesce("_rep", F.lit(0.0)) / total).alias("replacement"),
    )
    score = F.col("hit_probability") * F.col("replacement") * (0.5 + F.col("behavior")) + 0.25 * F.col("boundary")
    return out.withColumn("label", clamp(score))


def block_budget_target(targets: DataFrame, points: DataFrame, size: int = 32) -> DataFrame:
    """Share of the heaviest block's label mass, for every point of every block."""
    block = F.floor(F.col("pos") / size)
    masses = targets.groupBy("traj_id", block.alias("block")).agg(F.sum("label").alias("_mass"))
    top = masses.agg(F.max("_mass")).first()[0] or 0.0
    share = clamp(F.coalesce("_mass", F.lit(0.0)) / F.lit(max(top, 1e-6)))
    placed = points.select(*POINT, block.alias("block")).join(masses, ["traj_id", "block"], "left")
    return placed.select(*POINT, share.alias("block_budget"))


def dense_targets(points: DataFrame, queries: DataFrame, size: int = 32) -> DataFrame:
    """All five targets and the score for every point."""
    sparse = materialize(query_useful_targets(points, queries))
    budgets = block_budget_target(sparse, points, size)
    filled = budgets.join(sparse, POINT, "left")
    return filled.na.fill(0.0, ["hit_probability", "behavior", "boundary", "replacement", "label"])


def target_diagnostics(targets: DataFrame, points: DataFrame, names: tuple[str, ...] = TARGETS) -> DataFrame:
    """Per target: positive share, mass, support, binary entropy, and mass by part of the track."""
    where = F.col("pos") / F.greatest(F.col("n_points") - 1, F.lit(1))
    wide = targets.select(*POINT, *names).join(points.select(*POINT, "n_points"), POINT)
    long = wide.withColumn("_at", where).unpivot([*POINT, "_at"], list(names), "target", "value")
    v, p = clamp(F.col("value")), clamp(F.col("value"), 1e-6, 1.0 - 1e-6)
    entropy = -(p * F.log2(p) + (1.0 - p) * F.log2(1.0 - p))
    g = long.groupBy("target").agg(
        F.count(F.lit(1)).alias("points"),
        F.count_if(F.col("value") > 0).alias("positive"),
        F.sum(v).alias("mass"),
        F.avg(entropy).alias("entropy"),
        *[F.avg((F.col("value") > t).cast("double")).alias(f"support_{int(t * 100):02d}") for t in (0.0, 0.01, 0.05, 0.10)],
        F.sum(F.when(F.col("_at") <= 0.20, v)).alias("_s"),
        F.sum(F.when((F.col("_at") > 0.20) & (F.col("_at") < 0.80), v)).alias("_m"),
        F.sum(F.when(F.col("_at") >= 0.80, v)).alias("_e"),
    )
    parts = {f"mass_{n}": F.when(F.col("mass") > 1e-12, F.coalesce(F.col(c), F.lit(0.0)) / F.col("mass")).otherwise(F.lit(0.0)) for n, c in (("start", "_s"), ("middle", "_m"), ("end", "_e"))}
    return g.withColumns(parts).drop("_s", "_m", "_e")


def topk_mass(targets: DataFrame, name: str, ratios: tuple[float, ...] = (0.01, 0.02, 0.05, 0.10)) -> DataFrame:
    """Share of a target's mass that its best points hold."""
    row = targets.agg(F.count(F.lit(1)).alias("n"), F.sum(name).alias("m")).first()
    n, mass = row["n"], row["m"] or 0.0
    out = None
    for ratio in ratios:
        keep = min(n, max(1, int(np.ceil(ratio * n))))
        best = first_overall(targets.select(*POINT, name), [F.col(name).desc(), *map(F.col, POINT)], keep)
        share = F.when(F.lit(mass) > 1e-12, F.sum(name) / F.lit(mass)).otherwise(F.lit(0.0))
        part = best.agg(share.alias("share")).select(F.lit(ratio).alias("ratio"), "share")
        out = part if out is None else out.unionByName(part)
    return out


# ---- combining and reshaping labels ------------------------------------------------------


def aggregate_label_sets(sets: DataFrame, how: str = "mean", replicates: int | None = None) -> DataFrame:
    """Combine (workload_id, traj_id, pos, label) over workloads; missing labels are 0."""
    if how not in ("mean", "max"):
        raise ValueError(f"unknown aggregation: {how!r}")
    count = sets.select("workload_id").distinct().count() if replicates is None else replicates
    value = F.max("label") if how == "max" else F.sum("label") / F.lit(float(max(1, count)))
    return sets.groupBy(*POINT).agg(value.alias("label"))


def trajectory_unit_mass(sparse: DataFrame) -> DataFrame:
    """Divide positive labels by their sum over the track."""
    positive = sparse.filter(F.col("label") > 0)
    summed = attach(positive, ["traj_id"], {"_m": F.sum("label")}, "traj_id")
    value = F.when(F.col("_m") > 1e-12, clamp(F.col("label") / F.col("_m"))).otherwise(F.col("label"))
    return summed.withColumn("label", value).drop("_m")


def budget_weights(ratios: list[float], power: float = 0.0) -> list[float]:
    """Weights of budgets, proportional to ratio ** -power."""
    raw = [max(r, 1e-9) ** -max(0.0, power) for r in ratios]
    return [x / sum(raw) for x in raw]


def _dense(points: DataFrame, sparse: DataFrame, columns: list[str]) -> DataFrame:
    base = points.select(*POINT, "n_points")
    return base.join(sparse.select(*POINT, *columns), POINT, "left").na.fill(0.0, columns)


def retained_frequency(
    points: DataFrame, scores: DataFrame, ratios: list[float], weights: list[float] | None = None, temporal_fraction: float = 0.5
) -> DataFrame:
    """Weighted share of budgets at which base-plus-score selection keeps a positive point.

    All budgets are ranked in one pass over the same partitioning.
    """
    weights = weights or budget_weights(ratios)
    dense = _dense(points, scores, ["label"])
    share = F.lit(0.0)
    for j, (ratio, weight) in enumerate(zip(ratios, weights)):
        k = budget(ratio=ratio)
        base = is_evenly_spaced(k=base_size(k, temporal_fraction))
        dense = rank_within(dense.withColumn("_base", base), ["traj_id"], [F.col("_base").desc(), F.col("label").desc(), F.col("pos")], f"_r{j}", "traj_id")
        share = share + F.when(F.col(f"_r{j}") <= k, F.lit(weight / sum(weights))).otherwise(F.lit(0.0))
        dense = dense.drop("_base")
    kept = dense.filter(F.col("label") > 0).select(*POINT, share.alias("label"))
    return kept


def global_retained_frequency(points: DataFrame, scores: DataFrame, ratios: list[float], weights: list[float] | None = None) -> DataFrame:
    """The same with one budget shared by all tracks."""
    from .simplify import simplify_global_budget

    weights = weights or budget_weights(ratios)
    dense = _dense(points, scores, ["label"]).withColumnRenamed("label", "score")
    parts = None
    for ratio, weight in zip(ratios, weights):
        kept = simplify_global_budget(dense, ratio).withColumn("_w", F.lit(weight))
        parts = kept if parts is None else parts.unionByName(kept)
    total = float(sum(weights))
    summed = parts.groupBy(*POINT).agg((F.sum("_w") / total).alias("_f"))
    positive = scores.filter(F.col("label") > 0).select(*POINT)
    return positive.join(summed, POINT, "left").select(*POINT, F.coalesce("_f", F.lit(0.0)).alias("label"))


def temporal_frequency(points: DataFrame, ratios: list[float], weights: list[float] | None = None) -> DataFrame:
    """Weighted share of budgets at which even spacing keeps a point; no shuffle."""
    weights = weights or budget_weights(ratios)
    share = F.lit(0.0)
    for ratio, weight in zip(ratios, weights):
        share = share + F.when(is_evenly_spaced(k=budget(ratio=ratio)), F.lit(weight / sum(weights))).otherwise(F.lit(0.0))
    return points.select(*POINT, share.alias("label"))


def temporal_blend(points: DataFrame, target: DataFrame, blend: float, ratios: list[float], weights: list[float] | None = None) -> DataFrame:
    """Mix the even-spacing frequency into a target."""
    even = temporal_frequency(points, ratios, weights).withColumnRenamed("label", "_t")
    both = even.join(target.select(*POINT, "label"), POINT, "left")
    mixed = F.lit(1.0 - blend) * F.coalesce("label", F.lit(0.0)) + F.lit(blend) * F.col("_t")
    return both.select(*POINT, clamp(mixed).alias("label"))


def structural_scores(points: DataFrame) -> DataFrame:
    """Query-free importance from the shape and rhythm of the track itself."""
    c = F.col
    spans = attach(points, ["traj_id"], {f"_{f}_{a}": g(a) for a in ("lat", "lon") for f, g in (("lo", F.min), ("hi", F.max))}, "traj_id")
    unit = {f"_{a}": (c(a) - c(f"_lo_{a}")) / F.greatest(c(f"_hi_{a}") - c(f"_lo_{a}"), F.lit(1e-6)) for a in ("lat", "lon")}
    spans = spans.withColumns(unit)
    wanted = {"_yp": ("_lat", -1), "_yn": ("_lat", 1), "_xp": ("_lon", -1), "_xn": ("_lon", 1), "_tp": ("t", -1), "_tn": ("t", 1)}
    near = neighbors(spans, ["traj_id"], "pos", wanted, "traj_id")
    off = degree_distance((c("_yp") + c("_yn")) * 0.5, (c("_xp") + c("_xn")) * 0.5, "_lat", "_lon")
    pause = F.greatest(F.coalesce(F.abs(c("t") - c("_tp")), F.lit(0.0)), F.coalesce(F.abs(c("_tn") - c("t")), F.lit(0.0)))
    near = near.withColumns({"_off": off, "_gap": pause, "_turn": F.greatest("turn_score", F.lit(0.0))})
    near = attach(near, ["traj_id"], {"_off_max": F.max("_off"), "_yc": F.avg("_lat"), "_xc": F.avg("_lon")}, "traj_id")
    edge = F.when(c("_off_max") > 0, c("_off_max")).otherwise(F.lit(1.0))
    near = near.withColumns({"_uniq": F.coalesce(c("_off"), edge), "_dist": degree_distance("_yc", "_xc", "_lat", "_lon")})
    parts = ("_uniq", "_turn", "_gap", "_dist")
    near = attach(near, ["traj_id"], {f"{p}_{f}": g(p) for p in parts for f, g in (("lo", F.min), ("hi", F.max))}, "traj_id")

    def scaled(p: str) -> Column:
        span = c(f"{p}_hi") - c(f"{p}_lo")
        return F.when(span > 1e-12, (c(p) - c(f"{p}_lo")) / span).otherwise(F.lit(0.0))

    w = STRUCTURAL_WEIGHTS
    end = ((c("pos") == 0) | (c("pos") == c("n_points") - 1)).cast("double")
    score = w["uniqueness"] * scaled("_uniq") + w["turn"] * scaled("_turn") + w["gap"] * scaled("_gap")
    score = score + w["globality"] * (1.0 - scaled("_dist")) + w["endpoint"] * end
    return near.select(*POINT, F.when(c("n_points") == 1, 1.0).otherwise(clamp(score)).alias("label"))


def structural_frequency(
    points: DataFrame, sparse: DataFrame, ratios: list[float], blend: float = 0.25, mode: str = "blend", temporal_fraction: float = 0.5
) -> DataFrame:
    """Retained frequency of labels blended with, or boosted by, structural scores."""
    if mode not in ("blend", "boost"):
        raise ValueError(f"unknown mode: {mode!r}")
    both = structural_scores(points).withColumnRenamed("label", "_s").join(sparse.select(*POINT, "label"), POINT, "left")
    label = clamp(F.coalesce("label", F.lit(0.0)))
    mixed = label * (1.0 + F.lit(blend) * F.col("_s")) if mode == "boost" else clamp(F.lit(1.0 - blend) * label + F.lit(blend) * F.col("_s"))
    return retained_frequency(points, both.select(*POINT, mixed.alias("label")), ratios, None, temporal_fraction)


def component_frequency(
    points: DataFrame, components: DataFrame, ratios: list[float], weights: dict[str, float] | None = None, temporal_fraction: float = 0.5
) -> DataFrame:
    """Retained frequency of every component label, weighted over components that have mass."""
    weights = weights or USEFULNESS_WEIGHTS
    names = list(weights)
    masses = components.agg(*[F.sum(F.greatest(k, F.lit(0.0))).alias(k) for k in names]).first()
    used = {k: weights[k] for k in names if (masses[k] or 0.0) > 1e-12}
    if not used:
        raise ValueError("no component has label mass")
    total = sum(used.values())
    dense = _dense(points, components, list(used))
    long = dense.unpivot([*POINT, "n_points"], list(used), "component", "label")
    share = F.lit(0.0)
    for j, ratio in enumerate(ratios):
        k = budget(ratio=ratio)
        base = is_evenly_spaced(k=base_size(k, temporal_fraction))
        order = [F.col("_base").desc(), F.col("label").desc(), F.col("pos")]
        long = rank_within(long.withColumn("_base", base), ["component", "traj_id"], order, f"_r{j}", "traj_id").drop("_base")
        share = share + F.when(F.col(f"_r{j}") <= k, F.lit(1.0 / len(ratios))).otherwise(F.lit(0.0))
    weight = F.create_map(*[x for k, v in used.items() for x in (F.lit(k), F.lit(v / total))])[F.col("component")]
    kept = long.filter(F.col("label") > 0).withColumn("_f", share * weight)
    return kept.groupBy(*POINT).agg(clamp(F.sum("_f")).alias("label"))


def continuity_frequency(points: DataFrame, components: DataFrame, ratios: list[float], temporal_fraction: float = 0.5) -> DataFrame:
    return component_frequency(points, components, ratios, CONTINUITY_WEIGHTS, temporal_fraction)


def _covering_picks(mass: np.ndarray, kept: np.ndarray, radius: int, want: int) -> np.ndarray:
    """``kept`` and ``want`` further positions, each with the most mass left around it; a pick uses up the mass in its radius.

    Mass only goes away, so a value in the heap is an upper bound: the top is summed anew
    and either still leads or goes back.  When no mass is left to win, the widest gaps are halved.
    """
    n, kept, left = len(mass), kept.copy(), np.maximum(mass, 0.0)

    def use_up(at: int) -> None:
        left[max(0, at - radius) : at + radius + 1] = 0.0

    def around(at: int) -> float:
        return math.fsum(left[max(0, at - radius) : at + radius + 1])

    for at in np.flatnonzero(kept):
        use_up(at)
    heap = [(-(around(i) + 1e-3 * mass[i]), i) for i in np.flatnonzero(~kept).tolist()]
    heapq.heapify(heap)
    while want and heap:
        bound, at = heapq.heappop(heap)
        mine = around(at)
        value = -(mine + 1e-3 * mass[at])
        if value > bound:  # it has lost mass since
            heapq.heappush(heap, (value, at))
            continue
        if mine <= 1e-12 and not _reachable(left, kept, radius):
            break
        kept[at] = True
        use_up(at)
        want -= 1
    return _halve_gaps(mass, kept, want) if want else kept


def _halve_gaps(mass: np.ndarray, kept: np.ndarray, want: int) -> np.ndarray:
    """``kept`` and ``want`` further positions, each as far as possible from the kept ones; a gap is split where it was hit."""
    n, kept, heap = len(mass), kept.copy(), []

    def offer(low: int, high: int) -> None:
        """The best position of the gap [low, high), which kept positions or the ends of the track bound."""
        if low >= high:
            return
        at = np.arange(low, high)
        far = np.minimum(at - low + 1 if low else np.full(len(at), n), high - at if high < n else np.full(len(at), n)) if low or high < n else np.ones(len(at))
        value = far + 1e-3 * mass[low:high]
        best = int(np.argmax(value))
        heapq.heappush(heap, (-value[best], low + best, low, high))

    edges = [-1, *np.flatnonzero(kept).tolist(), n]
    for before, after in zip(edges[:-1], edges[1:]):
        offer(before + 1, after)
    while want and heap:
        _, at, low, high = heapq.heappop(heap)
        kept[at] = True
        offer(low, at)
        offer(at + 1, high)
        want -= 1
    return kept


def _reachable(left: np.ndarray, kept: np.ndarray, radius: int) -> bool:
    """Whether a position that is not kept still has mass in its radius."""
    total = np.concatenate([[0.0], np.cumsum(left)])
    at = np.flatnonzero(~kept)
    return bool((total[np.minimum(at + radius + 1, len(left))] - total[np.maximum(at - radius, 0)] > 1e-12).any())


def marginal_coverage(
    points: DataFrame, sparse: DataFrame, ratio: float, temporal_fraction: float = 0.5, radius_scale: float = 0.5
) -> DataFrame:
    """Greedy picks in which every pick uses up the label mass around it."""
    _require_bounded(points, "marginal_coverage")
    dense = _dense(points, sparse, ["label"])
    k = budget(ratio=ratio)
    ready = dense.select(*POINT, "label", k.alias("_k"), is_evenly_spaced(k=base_size(k, temporal_fraction)).alias("_base"))

    def choose(data: dict) -> dict:
        base, want = data["_base"].astype(bool), int(data["_k"][0])
        radius = max(0, math.ceil(radius_scale * len(base) / max(1, want)))
        kept = _covering_picks(data["label"], base, radius, max(0, want - int(base.sum())))
        return {c: data[c][kept] for c in POINT}

    return map_groups(ready, ["traj_id"], "pos", choose, "traj_id bigint, pos bigint")


def marginal_coverage_label(
    points: DataFrame, sparse: DataFrame, ratios: list[float], weights: list[float] | None = None, temporal_fraction: float = 0.5, radius_scale: float = 0.5
) -> DataFrame:
    """Label of a point: the weighted share of budgets at which covering picks it (equal weights by default)."""
    if not ratios or weights is not None and (len(weights) != len(ratios) or min(weights) < 0 or not sum(weights)):
        raise ValueError("give ratios, and as many weights, none negative and not all zero")
    weights = weights or [1.0] * len(ratios)
    picks = [marginal_coverage(points, sparse, r, temporal_fraction, radius_scale).withColumn("_w", F.lit(w / sum(weights))) for r, w in zip(ratios, weights)]
    return reduce(DataFrame.union, picks).groupBy(*POINT).agg(clamp(F.sum("_w")).alias("label"))


def query_spine(points: DataFrame, queries: DataFrame, fraction: float = 0.10, mass: str = "hit_group", turn_fraction: float = 0.25) -> DataFrame:
    """Evenly spaced in-box anchors and sharp turns of every visit share unit mass."""
    if mass not in ("hit_group", "query"):
        raise ValueError(f"unknown mass mode: {mass!r}")
    total = float(max(1, queries.count()))
    hits = query_hits(points.select(*POINT, "t", "lat", "lon", "turn_score"), queries)
    hits = scan(hits, VISIT, "pos", {"_i": ("sum", F.lit(1).cast("bigint"))}, "traj_id")
    hits = attach(hits, VISIT, {"_n": F.count(F.lit(1)), "_turns": F.max("turn_score")}, "traj_id")
    n = F.col("_n")
    spine = F.least(n, F.greatest(F.lit(1), F.ceil(F.lit(fraction) * n)))
    spine = F.when(n >= 2, F.greatest(spine, F.lit(2))).otherwise(spine)
    turns = F.least(n, F.greatest(F.lit(1), F.ceil(F.lit(turn_fraction) * spine)))
    ranked = rank_within(hits, VISIT, [F.col("turn_score").desc(), F.col("pos")], "_tr", "traj_id")
    on_spine = is_evenly_spaced(F.col("_i") - 1, n, spine)
    sharp = (n >= 3) & (F.col("_turns") > 0) & (F.col("_tr") <= turns)
    chosen = ranked.filter(on_spine | sharp).select("query_id", *POINT)
    chosen = attach(chosen, VISIT, {"_m": F.count(F.lit(1))}, "traj_id")
    value = 1.0 / F.col("_m")
    if mass == "query":
        visits = hits.filter(F.col("_i") == 1).groupBy("query_id").agg(F.count(F.lit(1)).alias("_v"))
        chosen = chosen.join(visits, "query_id")
        value = value / F.col("_v")
    return chosen.groupBy(*POINT).agg((F.sum(value) / total).alias("label"))


def mask_temporal_base(sparse: DataFrame, points: DataFrame, ratio: float, temporal_fraction: float) -> DataFrame:
    """Drop labels of points the evenly spaced base keeps anyway."""
    base = is_evenly_spaced(k=base_size(budget(ratio=ratio), temporal_fraction))
    return sparse.join(points.filter(base).select(*POINT), POINT, "left_anti")


def scale_q95(sparse: DataFrame) -> DataFrame:
    """Divide by the 95th percentile of the positive labels, cut at 1."""
    positive = sparse.filter(F.col("label") > 0)
    top = quantiles(positive, "label", {"q": 0.95}, POINT).first()["q"]
    return positive.withColumn("label", clamp(F.col("label") / F.lit(max(top or 0.0, 1e-6))))


def rank_labels(points: DataFrame, score: str) -> DataFrame:
    """Tie-aware percentile rank of any score in its track."""
    return convert_scores(points, score, "rank_tie").select(*POINT, F.col("converted").alias("label"))


def frequency_labels(points: DataFrame, score: str, ratios: list[float], temporal_fraction: float = 0.5) -> DataFrame:
    """Retained frequency of any score."""
    return retained_frequency(points, points.select(*POINT, F.col(score).alias("label")), ratios, None, temporal_fraction)


def residual_target_rows(points: DataFrame, sparse: DataFrame, ratios: list[float], temporal_fraction: float = 0.5) -> DataFrame:
    """Per budget: points and label mass of the base, and what is left for scores."""
    dense = _dense(points, sparse, ["label"])
    spread = dense.withColumn("ratio", F.explode(F.array(*[F.lit(float(r)) for r in ratios])))
    k = base_size(budget(ratio=F.col("ratio")), temporal_fraction)
    marked = spread.withColumn("_base", is_evenly_spaced(k=k))
    base, positive = F.col("_base"), F.col("label") > 0
    zero = F.lit(0.0)
    return marked.groupBy("ratio").agg(
        F.count_if(base).alias("base_points"),
        F.count_if(~base).alias("candidate_points"),
        F.count_if(base & positive).alias("base_positive"),
        F.count_if(~base & positive).alias("residual_positive"),
        F.coalesce(F.sum(F.when(base, F.col("label"))), zero).alias("base_mass"),
        F.coalesce(F.sum(F.when(~base, F.col("label"))), zero).alias("residual_mass"),
    )


def query_residual(
    points: DataFrame,
    queries: DataFrame,
    ratios: list[float],
    weights: list[float] | None = None,
    temporal_fraction: float = 0.5,
    multiplier: float = 1.0,
    mass: str = "query",
) -> DataFrame:
    """What the evenly spaced base misses inside each visit, by order of need.

    First the two ends of the visit, then the middles of the largest gaps between base
    points, then sharp turns, evenly spaced points and the rest; as many as the visit
    lacks at the budget.  All budgets are handled side by side.
    """
    if mass not in ("query", "point"):
        raise ValueError(f"unknown mass mode: {mass!r}")
    weights = weights or budget_weights(ratios)
    total = float(max(1, queries.count()))
    c = F.col
    hits = query_hits(points.select(*POINT, "t", "lat", "lon", "turn_score", "n_points"), queries)
    budgets = F.array(*[F.struct(F.lit(float(r)).alias("ratio"), F.lit(float(w)).alias("_w")) for r, w in zip(ratios, weights)])
    spread = hits.select("query_id", *POINT, "turn_score", "n_points", F.explode(budgets).alias("_budget"))
    spread = spread.select("query_id", *POINT, "turn_score", "n_points", "_budget.*")
    base = is_evenly_spaced(k=base_size(budget(ratio=c("ratio")), temporal_fraction))
    visit = ["ratio", *VISIT]
    rows = spread.withColumn("_base", base)
    rows = scan(rows, visit, "pos", {"_i": ("sum", F.lit(1).cast("bigint"))}, "traj_id").withColumn("_i", c("_i") - 1)
    here = F.when(c("_base"), c("_i"))
    rows = scan(rows, visit, "pos", {"_lo": ("last_before", here), "_hi": ("next_after", here)}, "traj_id")
    rows = attach(rows, visit, {"_n": F.count(F.lit(1)), "_kept": F.count_if("_base"), "_turns": F.max("turn_score")}, "traj_id")
    rows = rank_within(rows, visit, [c("turn_score").desc(), c("pos")], "_tr", "traj_id")
    i, n = c("_i"), c("_n")
    keep = F.least(n, F.greatest(F.lit(1), F.ceil(F.lit(multiplier) * c("ratio") * n)))
    keep = F.when(n >= 2, F.greatest(keep, F.lit(2))).otherwise(keep)
    low, high = F.coalesce("_lo", F.lit(-1)), F.coalesce("_hi", n)
    middle = F.when(c("_kept") > 0, F.floor((low + high) / 2)).otherwise(F.floor(n / 2))
    sharp = (n >= 3) & (c("_turns") > 0) & (c("_tr") <= F.least(n, F.greatest(F.lit(1), F.ceil(0.25 * keep))))

    def place(tier: int, first: Column, second: Column) -> Column:
        return F.struct(F.lit(tier).alias("tier"), first.cast("bigint").alias("a"), second.cast("bigint").alias("b"))

    need = (
        F.when((i == 0) | (i == n - 1), place(1, i, F.lit(0)))
        .when(i == middle, place(2, -(high - low - 1), low))
        .when(sharp, place(3, i, F.lit(0)))
        .when(is_evenly_spaced(i, n, keep), place(4, i, F.lit(0)))
        .otherwise(place(5, i, F.lit(0)))
    )
    missing = F.greatest(keep - c("_kept"), F.lit(0))
    open_rows = rows.withColumns({"_need": need, "_missing": missing}).filter(~c("_base") & (c("_missing") > 0))
    chosen = rank_within(open_rows, visit, [c("_need"), c("pos")], "_r", "traj_id").filter(c("_r") <= c("_missing"))
    value = c("_w")
    if mass == "query":
        sizes = chosen.groupBy("ratio", "query_id").agg(F.count(F.lit(1)).alias("_m"))
        chosen = chosen.join(sizes, ["ratio", "query_id"])
        value = value / c("_m")
    scale = total * float(sum(weights))
    return chosen.groupBy(*POINT).agg((F.sum(value) / F.lit(scale)).alias("label"))
