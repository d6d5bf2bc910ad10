"""Per-point features for scoring, and nearest-neighbour scoring on them."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.geo import clamp, degree_distance
from ..plans.materialize import materialize
from ..plans.nearest import BLOCK_ROWS, PivotIndex
from ..plans.ordered import attach, neighbors, order_index, scan
from .priors import FIELDS, Prior, sample_prior
from .tracks import extent
from .workload import GRID_BINS, _with_cell

POINT = ["traj_id", "pos"]
DAY = 86400.0
BASE = ("time_scaled", "lat", "lon", "speed", "heading", "start_flag", "end_flag", "turn_score")
CONTEXT = (
    "place", "place_left", "log_length", "log_dt_prev", "log_dt_next", "step_prev", "step_next", "heading_prev",
    "log_speed_prev", "path_share", "path_left", "log_dt_both", "curvature", "heading_next", "log_speed_next", "log_max_step",
)
CLOCK = ("clock_sin", "clock_cos")
DENSITY = ("density", "sparsity")
IDENTITY = ("id_sin_1", "id_sin_2", "id_cos_1", "id_cos_2")
ABSOLUTE = ("abs_t", "abs_lat", "abs_lon", "abs_sin", "abs_cos")
RELATION = ("inside_share", "inverse_volume_mean", "inverse_volume_max", "nearness", "centrality", "edge_any", "edge_time", "edge_space")
# Which of the 24 columns the nearest-neighbour scorer uses.
HISTORY_COLUMNS = tuple((BASE + CONTEXT)[i] for i in (0, 1, 2, 3, 4, 7, 8, 9, 11, 12, 13, 14, 15, 17, 18, 20, 21, 22, 23))
FEATURE_SETS = {
    "base": BASE[:7],
    "points": BASE,
    "blind": BASE + CONTEXT[:9],
    "context": BASE + CONTEXT,
    "context_clock_density": BASE + CONTEXT + CLOCK + DENSITY,
    "history": HISTORY_COLUMNS + CLOCK + DENSITY,
    "history_identity": HISTORY_COLUMNS + IDENTITY + CLOCK + DENSITY,
    "range_aware": BASE + RELATION,
    "context_absolute_prior": BASE + CONTEXT + ABSOLUTE + FIELDS,
}
MAX_LITERAL_BOXES = 1000


def context_features(points: DataFrame) -> DataFrame:
    """8 base and 16 query-free columns about the point's place and motion in its track."""
    c = F.col
    wanted = {f"_{a}{s}": (a, o) for a in ("t", "lat", "lon", "speed", "heading") for s, o in (("p", -1), ("n", 1))}
    near = neighbors(points, ["traj_id"], "pos", wanted, "traj_id")
    zero = F.lit(0.0)

    def or_zero(x: Column) -> Column:
        return F.coalesce(x, zero)

    def turned(other: str) -> Column:
        d = F.abs(c("heading") - c(other))
        return or_zero(F.least(d, 360.0 - d) / 180.0)

    dt_p, dt_n = F.greatest(c("t") - c("_tp"), zero), F.greatest(c("_tn") - c("t"), zero)
    both = c("_tp").isNotNull() & c("_tn").isNotNull()
    step_p, step_n = degree_distance("_latp", "_lonp", "lat", "lon"), degree_distance("lat", "lon", "_latn", "_lonn")
    dt_p, dt_n = F.when(c("_tp").isNotNull(), dt_p), F.when(c("_tn").isNotNull(), dt_n)
    chord = degree_distance("_latp", "_lonp", "_latn", "_lonn")
    spread = F.greatest(c("n_points") - 1, F.lit(1))
    near = near.withColumns({"step_prev": or_zero(step_p), "step_next": or_zero(step_n)})
    near = near.withColumns(
        {
            "start_flag": c("is_start").cast("double"),
            "end_flag": c("is_end").cast("double"),
            "place": c("pos") / spread,
            "place_left": 1.0 - c("pos") / spread,
            "log_length": F.log1p(c("n_points").cast("double")),
            "log_dt_prev": or_zero(F.log1p(dt_p)),
            "log_dt_next": or_zero(F.log1p(dt_n)),
            "heading_prev": turned("_headingp"),
            "heading_next": turned("_headingn"),
            "log_speed_prev": or_zero(F.log1p(F.abs(c("speed") - c("_speedp")))),
            "log_speed_next": or_zero(F.log1p(F.abs(c("_speedn") - c("speed")))),
            "log_dt_both": F.when(both, F.log1p(dt_p + dt_n)).otherwise(zero),
            "curvature": F.when(both, F.greatest(step_p + step_n - chord, zero)).otherwise(zero),
            "log_max_step": F.log1p(F.greatest("step_prev", "step_next")),
        }
    ).drop(*wanted)
    near = scan(near, ["traj_id"], "pos", {"_path": ("sum", "step_prev")}, "traj_id")
    near = attach(near, ["traj_id"], {"_all": F.sum("step_prev"), "_t0": F.min("t"), "_t1": F.max("t")}, "traj_id")
    share = c("_path") / F.greatest(c("_all"), F.lit(1e-6))
    near = near.withColumns({"path_share": share, "path_left": 1.0 - share, "time_scaled": (c("t") - c("_t0")) / F.greatest(c("_t1") - c("_t0"), F.lit(1e-6))})
    return near.drop("_path", "_all", "_t0", "_t1")


def density_features(points: DataFrame, bins: int = GRID_BINS) -> DataFrame:
    """Log density and relative sparsity of the point's grid cell (at most bins * bins cells)."""
    cut = _with_cell(points, bins)
    cells = materialize(cut.groupBy("_cell").agg(F.count(F.lit(1)).alias("_pop")))
    total = cells.agg(F.sum("_pop").alias("n"), F.min("_pop").alias("m")).first()
    rarest = 1.0 / math.sqrt(max(1, total["m"] or 1))
    wide = cut.join(F.broadcast(cells) if bins * bins <= 1_000_000 else cells, "_cell")
    density = F.log1p(F.col("_pop").cast("double")) / F.lit(math.log1p(float(max(1, total["n"] or 1))))
    sparsity = (1.0 / F.sqrt(F.col("_pop").cast("double"))) / F.lit(max(rarest, 1e-6))
    return wide.withColumns({"density": density, "sparsity": sparsity}).drop("_cell", "_pop")


def clock_features(points: DataFrame) -> DataFrame:
    angle = F.pmod(F.col("t"), F.lit(DAY)) / DAY * (2.0 * math.pi)
    return points.withColumns({"clock_sin": F.sin(angle), "clock_cos": F.cos(angle)})


def mmsi_hash_features(points: DataFrame) -> DataFrame:
    """Four numbers that stand for the vessel's identity; zeros if it is unknown."""
    m = F.col("mmsi").cast("double")
    out = {}
    for i, (freq, offset) in enumerate(((12.9898, 37.719), (78.233, 19.19)), 1):
        x = F.sin(m * freq + offset) * 43758.5453123
        angle = (x - F.when(x >= 0, F.floor(x)).otherwise(F.ceil(x))) * (2.0 * math.pi)
        known = F.coalesce(F.col("mmsi") > 0, F.lit(False))
        out[f"id_sin_{i}"] = F.when(known, F.sin(angle)).otherwise(F.lit(0.0))
        out[f"id_cos_{i}"] = F.when(known, F.cos(angle)).otherwise(F.lit(0.0))
    return points.withColumns(out)


def range_relation_features(points: DataFrame, queries: DataFrame) -> DataFrame:
    """Eight columns relating a point to all boxes.

    Every point looks at every box, so the boxes travel as array literals of limited
    size inside the expression: nothing is joined and no pair of rows is built.  More
    boxes mean more arrays, one after the other.
    """
    cols = ("t_start", "t_end", "lat_min", "lat_max", "lon_min", "lon_max")
    boxes = [tuple(float(r[c]) for c in cols) for r in queries.select(*cols).collect()]
    total = max(1, len(boxes))
    names = ("n", "vs", "vm", "near", "mid", "ea", "et", "es")
    zero = F.struct(*[F.lit(0.0).alias(k) for k in names])
    done = points.withColumn("_acc", zero)
    t, lat, lon = F.col("t"), F.col("lat"), F.col("lon")

    def fold(acc: Column, q: Column) -> Column:
        rel = []
        for value, lo, hi in ((t, 0, 1), (lat, 2, 3), (lon, 4, 5)):
            rel.append((value - q[lo]) / F.greatest(q[hi] - q[lo], F.lit(1e-6)))
        inside = (rel[0].between(0.0, 1.0) & rel[1].between(0.0, 1.0) & rel[2].between(0.0, 1.0)).cast("double")
        volume = F.greatest(q[1] - q[0], F.lit(1e-6)) * F.greatest(q[3] - q[2], F.lit(1e-6)) * F.greatest(q[5] - q[4], F.lit(1e-6))
        inverse = inside / F.sqrt(F.greatest(volume, F.lit(1e-12)))
        out = [F.greatest(-x, x - 1.0, F.lit(0.0)) for x in rel]
        away = F.sqrt(out[0] * out[0] + out[1] * out[1] + out[2] * out[2])
        mids = [(x - 0.5) * 2.0 for x in rel]
        off = F.sqrt(mids[0] * mids[0] + mids[1] * mids[1] + mids[2] * mids[2])
        faces = [F.least(x, 1.0 - x) for x in rel]
        space = F.least(faces[1], faces[2])

        def edge(face: Column) -> Column:
            return clamp(1.0 - 2.0 * face) * inside

        return F.struct(
            (acc["n"] + inside).alias("n"),
            (acc["vs"] + inverse).alias("vs"),
            F.greatest(acc["vm"], inverse).alias("vm"),
            F.greatest(acc["near"], F.exp(-4.0 * away)).alias("near"),
            F.greatest(acc["mid"], clamp(1.0 - off / math.sqrt(3.0)) * inside).alias("mid"),
            F.greatest(acc["ea"], edge(F.least(faces[0], space))).alias("ea"),
            F.greatest(acc["et"], edge(faces[0])).alias("et"),
            F.greatest(acc["es"], edge(space)).alias("es"),
        )

    for start in range(0, len(boxes), MAX_LITERAL_BOXES):
        part = F.array(*[F.array(*[F.lit(v) for v in b]) for b in boxes[start : start + MAX_LITERAL_BOXES]])
        done = done.withColumn("_acc", F.aggregate(part, F.col("_acc"), fold))
    out = {r: F.col(f"_acc.{k}") for r, k in zip(RELATION, names)}
    out["inside_share"] = out["inside_share"] / total
    out["inverse_volume_mean"] = out["inverse_volume_mean"] / total
    return done.withColumns(out).drop("_acc")


def absolute_features(points: DataFrame, within: dict | None = None) -> DataFrame:
    """Time and place relative to an extent (as of a prior), and the time of day.

    Without one the extent is that of the points and time is the share of the day.
    """
    phase = F.pmod("t", F.lit(DAY)) / DAY
    edges = within or extent(points).first().asDict()

    def inside(axis: str) -> Column:
        low, span = edges[f"{axis}_min"] or 0.0, max(1e-9, (edges[f"{axis}_max"] or 0.0) - (edges[f"{axis}_min"] or 0.0))
        return clamp((F.col(axis) - F.lit(low)) / F.lit(span))

    angle = phase * (2.0 * math.pi)
    values = (inside("t") if within else phase, inside("lat"), inside("lon"), F.sin(angle), F.cos(angle))
    return points.withColumns(dict(zip(ABSOLUTE, values)))


def feature_set(points: DataFrame, kind: str, queries: DataFrame | None = None, prior: Prior | None = None) -> DataFrame:
    """(traj_id, pos) and the columns of a named feature set; without a prior its columns are 0."""
    if kind not in FEATURE_SETS:
        raise ValueError(f"unknown feature set: {kind!r}")
    cols = FEATURE_SETS[kind]
    wide = context_features(points)
    if set(DENSITY) & set(cols):
        wide = density_features(wide)
    if set(CLOCK) & set(cols):
        wide = clock_features(wide)
    if set(IDENTITY) & set(cols):
        wide = mmsi_hash_features(wide)
    if set(RELATION) & set(cols):
        if queries is None:
            raise ValueError("this feature set needs queries")
        wide = range_relation_features(wide, queries)
    if set(ABSOLUTE) & set(cols):
        wide = absolute_features(wide, prior.extent if prior else None)
    if set(FIELDS) & set(cols):
        wide = wide.join(sample_prior(points, prior), POINT) if prior else wide.withColumns({f: F.lit(0.0) for f in FIELDS})
    return wide.select(*POINT, *cols)


def fit_minmax(features: DataFrame, cols: list[str]) -> DataFrame:
    """Minimum and span of each column; refuses values that are not finite."""
    bad = [F.count_if(F.col(c).isNull() | F.isnan(c) | (F.abs(c) == float("inf"))).alias(c) for c in cols]
    row = features.agg(*bad).first()
    broken = [c for c in cols if row[c]]
    if broken:
        raise ValueError(f"not finite: {broken}")
    long = features.select(*cols).unpivot([], cols, "feature", "value")
    span = F.greatest(F.max("value") - F.min("value"), F.lit(1e-6))
    return long.groupBy("feature").agg(F.min("value").alias("low"), span.alias("span"))


def apply_minmax(features: DataFrame, scaler: DataFrame, cols: list[str]) -> DataFrame:
    """Scale columns; the scaler has one row per column."""
    fit = {r["feature"]: (r["low"], r["span"]) for r in scaler.collect()}
    return features.withColumns({c: (F.col(c) - F.lit(fit[c][0])) / F.lit(fit[c][1]) for c in cols})


# ---- nearest neighbours -------------------------------------------------------------------


def knn_prior_score(
    points: DataFrame,
    history: DataFrame,
    cols: list[str],
    k: int = 32,
    weights: list[float] | None = None,
    leave_one_out: bool = False,
    block_rows: int = BLOCK_ROWS,
) -> DataFrame:
    """Mean target of the k nearest history rows, weighted by 1 / (distance^2 + 1e-4).

    ``history`` has (traj_id, pos, target) and the feature columns; ``leave_one_out``
    skips the row of the point itself.  A history of at most ``block_rows`` rows is
    broadcast; a longer one is searched block by block, each point in the blocks that can
    hold one of its nearest rows (``plans/nearest.py``).  History rows without a target
    or with a feature that is null or not finite take no part, and points with such a
    feature get no score.
    """
    return _weighted(prior_index(history, cols, k, weights, leave_one_out, block_rows), points, cols, weights)


def _scaled(cols: list[str], weights: list[float] | None) -> list[Column]:
    return [(F.col(c) * F.lit(math.sqrt(w))).alias(f"_f{i}") for i, (c, w) in enumerate(zip(cols, weights or [1.0] * len(cols)))]


def prior_index(history: DataFrame, cols: list[str], k: int, weights: list[float] | None, leave_one_out: bool, block_rows: int) -> PivotIndex:
    rows = history.select(*POINT, F.col("target").alias("value"), *_scaled(cols, weights))
    return PivotIndex(rows, POINT, [f"_f{i}" for i in range(len(cols))], k, leave_one_out, block_rows)


def _weighted(index: PivotIndex, points: DataFrame, cols: list[str], weights: list[float] | None) -> DataFrame:
    def summed(term) -> Column:
        return F.aggregate("near", F.lit(0.0), lambda total, r: total + term(r) / (r["d2"] + 1e-4))

    near = index.lists(points.select(*POINT, *_scaled(cols, weights)))
    return near.select(*POINT, (summed(lambda r: r["value"]) / summed(lambda r: F.lit(1.0))).alias("score"))


def combine_sources(scores: DataFrame, how: str = "mean") -> DataFrame:
    """Mean, minimum or median (the lower one of two) over the scores of several history sources."""
    pick = {"mean": F.avg("score"), "min": F.min("score"), "median": F.expr("percentile_disc(0.5) WITHIN GROUP (ORDER BY score)")}
    if how not in pick:
        raise ValueError(f"unknown combination: {how!r}")
    return scores.groupBy(*POINT).agg(pick[how].alias("score"))


def history_support(history: DataFrame, top_share: float = 1.0, min_target: float = 0.0) -> DataFrame:
    """History rows worth keeping: target above a floor, and the best share of them."""
    kept = history.filter(F.col("target") >= min_target)
    if top_share >= 1.0:
        return kept
    count = max(1, math.ceil(kept.count() * top_share))
    ranked = order_index(kept, [F.col("target").desc(), *[F.col(p) for p in POINT]], "_i")
    return ranked.filter(F.col("_i") < count).drop("_i")


def knn_frequency_labels(points: DataFrame, history: DataFrame, cols: list[str], ratios: list[float], k: int = 32) -> DataFrame:
    """Retained frequency of leave-one-out neighbour scores."""
    from .labels import retained_frequency

    score = materialize(knn_prior_score(points, history, cols, k, leave_one_out=True))
    return retained_frequency(points, score.withColumnRenamed("score", "label"), ratios)
