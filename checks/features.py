"""Priors, features, audits, gates and the learned scorer."""

from __future__ import annotations

from pyspark.sql import functions as F

from tracklake.operators import audits, diagnostics, features, priors, scorer

from .fixtures import HITS_SQL, POINTS_SQL, boxes, points, shared
from .labels import TARGET_SQL, _freq_sql, dense_targets, targets
from .metrics import EVAL_SQL, _rounded, _rounded_sql, crossings, evaluated
from .registry import check
from .simplify import k_sql, spaced_sql
from .tracks import r
from .workload import hash_sql

BINS = 16
_EXT_SQL = """ex AS (SELECT least((SELECT min(lat) FROM points), (SELECT min(lat_min) FROM boxes)) AS a0, greatest((SELECT max(lat) FROM points), (SELECT max(lat_max) FROM boxes)) AS a1,
   least((SELECT min(lon) FROM points), (SELECT min(lon_min) FROM boxes)) AS o0, greatest((SELECT max(lon) FROM points), (SELECT max(lon_max) FROM boxes)) AS o1,
   least((SELECT min(t) FROM points), (SELECT min(t_start) FROM boxes)) AS t0, greatest((SELECT max(t) FROM points), (SELECT max(t_end) FROM boxes)) AS t1)"""


def prior(spark, sf) -> priors.Prior:
    key = (spark.sparkContext.applicationId, sf)
    if key not in _priors:
        behavior = targets(spark, sf).select("traj_id", "pos", "behavior")
        _priors[key] = priors.build_prior_fields(points(spark, sf), boxes(spark), behavior, BINS, 6, 2, crossings=crossings(spark, sf))
    return _priors[key]


_priors: dict[tuple, priors.Prior] = {}


@check("k1_prior_extent", f"WITH {HITS_SQL}, {_EXT_SQL} SELECT round(a0, 9) AS lat_min, round(a1, 9) AS lat_max, round(o0, 9) AS lon_min, round(o1, 9) AS lon_max, t0 AS t_min, t1 AS t_max FROM ex")
def _(spark, sf):
    e = priors.prior_extent(points(spark, sf), boxes(spark))
    return e.select("t_min", "t_max", *_rounded(("lat_min", "lat_max", "lon_min", "lon_max"), 9))


_CELL = f"CAST(least({BINS - 1}, greatest(0, floor((lat - a0) / (a1 - a0) * {BINS}))) AS INT) AS lat_bin, CAST(least({BINS - 1}, greatest(0, floor((lon - o0) / (o1 - o0) * {BINS}))) AS INT) AS lon_bin"


@check("k1_cell_of", f"WITH {HITS_SQL}, {_EXT_SQL} SELECT traj_id, pos, {_CELL}, CAST(floor((t % 86400) / 14400) AS INT) AS clock_bin FROM points, ex")
def _(spark, sf):
    e = priors.prior_extent(points(spark, sf), boxes(spark)).first().asDict()
    return priors.cell_of(points(spark, sf), e, BINS).select("traj_id", "pos", "lat_bin", "lon_bin", priors.clock_bin("t", 6).alias("clock_bin"))


_TOUR_SQL = """tour AS (SELECT traj_id, min(t) AS t_start, max(t) AS t_end, min(lat) AS lat_min, max(lat) AS lat_max, min(lon) AS lon_min, max(lon) AS lon_max FROM points GROUP BY traj_id)"""


def _tours(spark, sf):
    """The bounding box of every track as a query."""
    return points(spark, sf).groupBy("traj_id").agg(
        F.min("t").alias("t_start"), F.max("t").alias("t_end"), F.min("lat").alias("lat_min"), F.max("lat").alias("lat_max"),
        F.min("lon").alias("lon_min"), F.max("lon").alias("lon_max"))


@check("k2_clock_bins_of", f"""WITH {POINTS_SQL}, {_TOUR_SQL}, s AS (SELECT *, t_start % 86400 AS a, t_end % 86400 AS b FROM tour)
   SELECT traj_id, CAST(j AS INT) AS clock_bin FROM s, range(24) AS g(j) WHERE t_end - t_start >= 86400 OR (a <= b AND j * 3600 <= b AND (j + 1) * 3600 >= a) OR (a > b AND (((j + 1) * 3600 >= a) OR j * 3600 <= b))""")
def _(spark, sf):
    return _tours(spark, sf).select("traj_id", F.explode(priors.clock_bins_of(24)).alias("clock_bin"))


_RASTER_SQL = f"""step AS (SELECT min(lat) AS a0, (max(lat) - min(lat)) / {BINS} AS da, min(lon) AS o0, (max(lon) - min(lon)) / {BINS} AS dq FROM points),
raster AS (SELECT CAST(i AS INT) AS lat_bin, CAST(j AS INT) AS lon_bin, count(*) / (SELECT count(*) FROM tour)::DOUBLE AS value FROM tour, step, range({BINS}) AS g(i), range({BINS}) AS h(j)
  WHERE i <= (lat_max - a0) / da AND i + 1 >= (lat_min - a0) / da AND j <= (lon_max - o0) / dq AND j + 1 >= (lon_min - o0) / dq GROUP BY i, j)"""


def _raster(spark, sf):
    from tracklake.operators.tracks import extent

    e = extent(points(spark, sf)).first().asDict()
    return priors.rasterize_queries(_tours(spark, sf), e, BINS, 6)[0]


@check("k3_rasterize_queries", f"WITH {POINTS_SQL}, {_TOUR_SQL}, {_RASTER_SQL} SELECT lat_bin, lon_bin, round(value, 9) AS value FROM raster")
def _(spark, sf):
    return _raster(spark, sf).select("lat_bin", "lon_bin", r("value").alias("value"))


def smooth_sql(src, out, keys=""):
    k = f"{keys}, " if keys else ""
    on = "".join(f" AND s.{c.strip()} = c.{c.strip()}" for c in keys.split(",") if c.strip())
    cells = f"(SELECT DISTINCT {keys} FROM {src}) k, " if keys else ""
    return f"""{out}_c AS (SELECT {k}CAST(i AS INT) AS lat_bin, CAST(j AS INT) AS lon_bin FROM {cells}range({BINS}) AS g(i), range({BINS}) AS h(j)),
    {out} AS (SELECT {', '.join('c.' + x.strip() for x in keys.split(',') if x.strip()) + ', ' if keys else ''}c.lat_bin, c.lon_bin, sum(s.value * w / 16e0) AS value FROM {out}_c c,
      (VALUES (-1,-1,1),(-1,0,2),(-1,1,1),(0,-1,2),(0,0,4),(0,1,2),(1,-1,1),(1,0,2),(1,1,1)) AS d(dy, dx, w)
      JOIN {src} s ON s.lat_bin = least({BINS - 1}, greatest(0, c.lat_bin + dy)) AND s.lon_bin = least({BINS - 1}, greatest(0, c.lon_bin + dx)){on} GROUP BY ALL)"""


@check("k4_smooth_grid", f"WITH {POINTS_SQL}, {_TOUR_SQL}, {_RASTER_SQL}, {smooth_sql('raster', 's1')}, {smooth_sql('s1', 's2')} SELECT lat_bin, lon_bin, round(value, 9) AS value FROM s2")
def _(spark, sf):
    return priors.smooth_grid(_raster(spark, sf), [], BINS, 2).select("lat_bin", "lon_bin", r("value").alias("value"))


PRIOR_SQL = f"""{TARGET_SQL}, {_EXT_SQL},
pc AS (SELECT p.traj_id, p.pos, p.t, p.lat, p.lon, {_CELL}, CAST(floor((p.t % 86400) / 14400) AS INT) AS clock_bin FROM points p, ex),
pv AS (SELECT pc.*, (SELECT count(*) FROM edge e WHERE e.is_boundary AND e.traj_id = pc.traj_id AND e.pos = pc.pos) / 6e0 AS ee, (SELECT count(*) FROM brackets b WHERE b.traj_id = pc.traj_id AND b.pos = pc.pos) / 6e0 AS cr, coalesce(t.behavior, 0) AS bv
  FROM pc LEFT JOIN targets t ON t.traj_id = pc.traj_id AND t.pos = pc.pos),
cc AS (SELECT lat_bin, lon_bin, avg(least(1, ee)) AS entry_exit, avg(least(1, cr)) AS crossing, avg(bv) AS behavior, ln(1 + count(*)) / (SELECT ln(1 + max(n)) FROM (SELECT count(*) AS n FROM pv GROUP BY lat_bin, lon_bin)) AS route_density FROM pv GROUP BY lat_bin, lon_bin),
bq AS (SELECT b.*, CAST(i AS INT) AS lat_bin, CAST(j AS INT) AS lon_bin FROM boxes b, ex, range({BINS}) AS g(i), range({BINS}) AS h(j)
  WHERE i <= (lat_max - a0) / ((a1 - a0) / {BINS}) AND i + 1 >= (lat_min - a0) / ((a1 - a0) / {BINS}) AND j <= (lon_max - o0) / ((o1 - o0) / {BINS}) AND j + 1 >= (lon_min - o0) / ((o1 - o0) / {BINS})),
cf_raw AS (SELECT 'query_hit' AS field, lat_bin, lon_bin, count(*) / 6e0 AS value FROM bq GROUP BY lat_bin, lon_bin UNION ALL SELECT 'entry_exit', lat_bin, lon_bin, entry_exit FROM cc UNION ALL SELECT 'crossing', lat_bin, lon_bin, crossing FROM cc
  UNION ALL SELECT 'behavior', lat_bin, lon_bin, behavior FROM cc UNION ALL SELECT 'route_density', lat_bin, lon_bin, route_density FROM cc),
{smooth_sql('cf_raw', 'f1', 'field')}, {smooth_sql('f1', 'f2', 'field')},
cl_raw AS (SELECT clock_bin, lat_bin, lon_bin, count(*) / 6e0 AS value FROM (SELECT * FROM bq, (SELECT unnest(range(6))::INT AS clock_bin)) GROUP BY clock_bin, lat_bin, lon_bin),
{smooth_sql('cl_raw', 'l1', 'clock_bin')}, {smooth_sql('l1', 'l2', 'clock_bin')},
sampled AS (SELECT pc.traj_id, pc.pos, {', '.join(f"coalesce(max(f2.value) FILTER (field = '{c}'), 0) AS {c}" for c in priors.CELL_FIELDS)}, coalesce(any_value(l2.value), 0) AS query_hit_clock
  FROM pc LEFT JOIN f2 ON f2.lat_bin = pc.lat_bin AND f2.lon_bin = pc.lon_bin LEFT JOIN l2 ON l2.clock_bin = pc.clock_bin AND l2.lat_bin = pc.lat_bin AND l2.lon_bin = pc.lon_bin GROUP BY pc.traj_id, pc.pos)"""


def sampled(spark, sf):
    return shared(spark, sf, "sampled", lambda: priors.sample_prior(points(spark, sf), prior(spark, sf)))


@check("k5_k6_sample_prior", f"WITH {PRIOR_SQL} SELECT traj_id, pos, {_rounded_sql(priors.FIELDS, 10)} FROM sampled")
def _(spark, sf):
    return priors.sample_prior(points(spark, sf), prior(spark, sf)).select("traj_id", "pos", *_rounded(priors.FIELDS, 10))


@check("k7_zero_and_shuffled_prior", f"""WITH {PRIOR_SQL} SELECT (SELECT round(sum(value), 5) FROM f2 WHERE field = 'query_hit') AS mass_shuffled, 0e0 AS mass_zero""")
def _(spark, sf):
    p = prior(spark, sf)
    zero = priors.sample_prior(points(spark, sf), priors.zero_prior(p)).agg(F.sum("query_hit").alias("z"))
    mixed = priors.shuffle_prior(p, 1).cells.agg(F.sum("query_hit").alias("s"))
    return mixed.select(r("s", 5).alias("mass_shuffled"), zero.scalar().alias("mass_zero"))


@check("k7_prior_metadata", f"""WITH {PRIOR_SQL} SELECT 'free' AS profile_id, {BINS}::INT AS grid_bins, 6::INT AS clock_bins, 2::INT AS passes, 'zero' AS outside, NULL::VARCHAR AS ablation,
   (SELECT count(*) FROM (SELECT DISTINCT lat_bin, lon_bin FROM f2)) AS cells, (SELECT count(*) FROM (SELECT DISTINCT clock_bin, lat_bin, lon_bin FROM l2)) AS clock_cells""")
def _(spark, sf):
    return priors.prior_metadata(prior(spark, sf))


_D = "sqrt(power({b}lat - {a}lat, 2) + power({b}lon - {a}lon, 2))"
CONTEXT_SQL = f"""{POINTS_SQL},
c0 AS (SELECT *, lag(t) OVER w AS p_t, lead(t) OVER w AS n_t, lag(lat) OVER w AS p_lat, lead(lat) OVER w AS n_lat, lag(lon) OVER w AS p_lon, lead(lon) OVER w AS n_lon,
   lag(speed) OVER w AS p_s, lead(speed) OVER w AS n_s, lag(heading) OVER w AS p_h, lead(heading) OVER w AS n_h FROM points WINDOW w AS (PARTITION BY traj_id ORDER BY pos)),
c1 AS (SELECT *, coalesce({_D.format(a='p_', b='')}, 0) AS step_prev, coalesce({_D.format(a='', b='n_')}, 0) AS step_next FROM c0),
ctx AS (SELECT traj_id, pos, (t - min(t) OVER v) / greatest(1e-6, max(t) OVER v - min(t) OVER v) AS time_scaled, lat, lon, speed, heading, is_start::INT::DOUBLE AS start_flag, is_end::INT::DOUBLE AS end_flag, turn_score,
   pos / (n_points - 1)::DOUBLE AS place, 1 - pos / (n_points - 1)::DOUBLE AS place_left, ln(1 + n_points) AS log_length, coalesce(ln(1 + t - p_t), 0) AS log_dt_prev, coalesce(ln(1 + n_t - t), 0) AS log_dt_next, step_prev, step_next,
   coalesce(least(abs(heading - p_h), 360 - abs(heading - p_h)) / 180, 0) AS heading_prev, coalesce(ln(1 + abs(speed - p_s)), 0) AS log_speed_prev,
   sum(step_prev) OVER (PARTITION BY traj_id ORDER BY pos) / greatest(1e-6, sum(step_prev) OVER v) AS path_share, 1 - sum(step_prev) OVER (PARTITION BY traj_id ORDER BY pos) / greatest(1e-6, sum(step_prev) OVER v) AS path_left,
   coalesce(ln(1 + n_t - p_t), 0) AS log_dt_both, coalesce(greatest(0, {_D.format(a='p_', b='')} + {_D.format(a='', b='n_')} - {_D.format(a='p_', b='n_')}), 0) AS curvature,
   coalesce(least(abs(heading - n_h), 360 - abs(heading - n_h)) / 180, 0) AS heading_next, coalesce(ln(1 + abs(speed - n_s)), 0) AS log_speed_next, ln(1 + greatest(step_prev, step_next)) AS log_max_step
   FROM c1 WINDOW v AS (PARTITION BY traj_id))"""
_CTX = features.BASE + features.CONTEXT


@check("k8_context_features", f"WITH {CONTEXT_SQL} SELECT traj_id, pos, {_rounded_sql(_CTX, 7)} FROM ctx")
def _(spark, sf):
    return features.context_features(points(spark, sf)).select("traj_id", "pos", *_rounded(_CTX, 7))


@check("k9_density_clock_identity", f"""WITH {POINTS_SQL}, e AS (SELECT min(lat) AS a, max(lat) AS b, min(lon) AS c, max(lon) AS d FROM points),
   cl AS (SELECT p.*, floor((lat - a) / (b - a) * 63) * 64 + floor((lon - c) / (d - c) * 63) AS cell FROM points p, e), n AS (SELECT *, count(*) OVER (PARTITION BY cell) AS k FROM cl),
   h AS (SELECT *, sin(mmsi * 12.9898e0 + 37.719e0) * 43758.5453123e0 AS z FROM n)
   SELECT traj_id, pos, round(ln(1 + k) / ln(1 + count(*) OVER ()), 8) AS density, round((1 / sqrt(k)) / (1 / sqrt(min(k) OVER ())), 8) AS sparsity,
   round(sin((t % 86400) / 86400 * 2 * pi()), 6) AS clock_sin, round(cos((t % 86400) / 86400 * 2 * pi()), 6) AS clock_cos, round(sin((z - trunc(z)) * 2 * pi()), 5) AS id_sin_1 FROM h""")
def _(spark, sf):
    f = features.mmsi_hash_features(features.clock_features(features.density_features(points(spark, sf))))
    return f.select("traj_id", "pos", *_rounded(("density", "sparsity"), 8), *_rounded(("clock_sin", "clock_cos"), 6), r("id_sin_1", 5).alias("id_sin_1"))


@check("k9_absolute_features", f"""WITH {HITS_SQL}, {_EXT_SQL} SELECT traj_id, pos, round((t - t0) / (t1 - t0), 8) AS abs_t, round((lat - a0) / (a1 - a0), 8) AS abs_lat, round((lon - o0) / (o1 - o0), 8) AS abs_lon FROM points, ex""")
def _(spark, sf):
    e = priors.prior_extent(points(spark, sf), boxes(spark)).first().asDict()
    return features.absolute_features(points(spark, sf), e).select("traj_id", "pos", *_rounded(("abs_t", "abs_lat", "abs_lon"), 8))


@check("k10_range_relation_features", f"""WITH {HITS_SQL}, x AS (SELECT p.traj_id, p.pos, (t - t_start) / (t_end - t_start) AS a, (lat - lat_min) / (lat_max - lat_min) AS b, (lon - lon_min) / (lon_max - lon_min) AS c,
     1 / sqrt(greatest(1e-12, (t_end - t_start) * (lat_max - lat_min) * (lon_max - lon_min))) AS iv FROM points p, boxes),
   y AS (SELECT *, (a BETWEEN 0 AND 1 AND b BETWEEN 0 AND 1 AND c BETWEEN 0 AND 1)::INT AS i, sqrt(power(greatest(-a, a - 1, 0), 2) + power(greatest(-b, b - 1, 0), 2) + power(greatest(-c, c - 1, 0), 2)) AS away,
     sqrt(power((a - 0.5) * 2, 2) + power((b - 0.5) * 2, 2) + power((c - 0.5) * 2, 2)) AS off, least(a, 1 - a) AS ft, least(b, 1 - b, c, 1 - c) AS fs FROM x)
   SELECT traj_id, pos, round(sum(i) / 6e0, 8) AS inside_share, round(sum(i * iv) / 6, 8) AS inverse_volume_mean, round(max(i * iv), 8) AS inverse_volume_max, round(max(exp(-4 * away)), 8) AS nearness,
   round(greatest(0, max(i * least(1, greatest(0, 1 - off / sqrt(3))))), 8) AS centrality, round(max(i * least(1, greatest(0, 1 - 2 * least(ft, fs)))), 8) AS edge_any, round(max(i * least(1, greatest(0, 1 - 2 * ft))), 8) AS edge_time,
   round(max(i * least(1, greatest(0, 1 - 2 * fs))), 8) AS edge_space FROM y GROUP BY traj_id, pos""")
def _(spark, sf):
    return features.range_relation_features(points(spark, sf), boxes(spark)).select("traj_id", "pos", *_rounded(features.RELATION, 8))


@check("k11_feature_set", f"WITH {CONTEXT_SQL} SELECT traj_id, pos, {_rounded_sql(_CTX[:17], 7)} FROM ctx")
def _(spark, sf):
    return features.feature_set(points(spark, sf), "blind").select("traj_id", "pos", *_rounded(_CTX[:17], 7))


@check("k11_absolute_and_prior_columns", f"""WITH {PRIOR_SQL}, e2 AS (SELECT least(min(t), (SELECT min(t_start) FROM boxes)) AS s0, greatest(max(t), (SELECT max(t_end) FROM boxes)) AS s1 FROM points)
  SELECT traj_id, pos, round((t - s0) / (s1 - s0), 8) AS abs_t, round((p.lat - a0) / (a1 - a0), 8) AS abs_lat, round((p.lon - o0) / (o1 - o0), 8) AS abs_lon, round(sin(2 * pi() * (t % 86400) / 86400e0), 7) AS abs_sin, round(cos(2 * pi() * (t % 86400) / 86400e0), 7) AS abs_cos,
  {_rounded_sql(priors.FIELDS, 9)} FROM points p JOIN sampled s USING (traj_id, pos), ex, e2""")
def _(spark, sf):
    f = features.feature_set(points(spark, sf), "context_absolute_prior", prior=prior(spark, sf))
    assert len(f.columns) == 2 + 35
    return f.select("traj_id", "pos", *_rounded(features.ABSOLUTE[:3], 8), *_rounded(features.ABSOLUTE[3:], 7), *_rounded(priors.FIELDS, 9))


@check("k12_minmax", f"""WITH {POINTS_SQL} SELECT traj_id, pos, round((speed - min(speed) OVER ()) / (max(speed) OVER () - min(speed) OVER ()), 9) AS speed, round((turn_score - min(turn_score) OVER ()) / (max(turn_score) OVER () - min(turn_score) OVER ()), 9) AS turn_score FROM points""")
def _(spark, sf):
    p, cols = points(spark, sf), ["speed", "turn_score"]
    return features.apply_minmax(p, features.fit_minmax(p, cols), cols).select("traj_id", "pos", *_rounded(cols, 9))


def _history(spark, sf):
    return points(spark, sf).select("traj_id", "pos", F.col("turn_score").alias("target"), "speed", (F.col("heading") / 360.0).alias("course"))


_HISTORY_SQL = POINTS_SQL + ", h AS (SELECT traj_id, pos, turn_score AS target, speed, heading / 360e0 AS course, traj_id % 4 AS part FROM points)"


def _knn_sql(k: int, history: str = "true", weights=(1.0, 1.0), points: str = "true", own: str = "x.traj_id <> y.traj_id OR x.pos <> y.pos", groups: str = "") -> str:
    """Every point against every history row; the k smallest pairs of distance and target."""
    d2 = f"{weights[0]}e0 * (x.speed - y.speed) * (x.speed - y.speed) + {weights[1]}e0 * (x.course - y.course) * (x.course - y.course)"
    part = f", {groups}" if groups else ""
    kept = f", {groups.split('.')[-1]}" if groups else ""
    return f"""near AS (SELECT x.traj_id, x.pos{part}, min({{'d2': {d2}, 'target': y.target}}, {k}) AS best FROM (SELECT * FROM h WHERE {points}) x, (SELECT * FROM h WHERE {history}) y WHERE {own} GROUP BY x.traj_id, x.pos{part}),
     knn AS (SELECT traj_id, pos{kept}, sum(b.target / (b.d2 + 1e-4)) / sum(1 / (b.d2 + 1e-4)) AS score FROM (SELECT *, unnest(best) AS b FROM near) GROUP BY traj_id, pos{kept})"""


@check("k13_knn_prior_score", f"WITH {_HISTORY_SQL}, {_knn_sql(5)} SELECT traj_id, pos, round(score, 7) AS score FROM knn")
def _(spark, sf):
    h = _history(spark, sf)
    return features.knn_prior_score(h, h, ["speed", "course"], k=5, leave_one_out=True).select("traj_id", "pos", r("score", 7).alias("score"))


@check("k13_knn_other_history", f"""WITH {_HISTORY_SQL}, {_knn_sql(32, 'traj_id % 3 <> 0', (0.25, 4.0), 'traj_id % 3 = 0', 'true')} SELECT traj_id, pos, round(score, 7) AS score FROM knn""")
def _(spark, sf):
    h = _history(spark, sf)
    new = h.filter("traj_id % 3 = 0").drop("target")
    score = features.knn_prior_score(new, h.filter("traj_id % 3 <> 0"), ["speed", "course"], weights=[0.25, 4.0])
    return score.select("traj_id", "pos", r("score", 7).alias("score"))


_HOWS = ("mean", "min", "median")


@check("k13_combined_sources", f"""WITH {_HISTORY_SQL}, {_knn_sql(5, 'traj_id % 5 <> 0', points='traj_id % 5 = 0', own='true', groups='y.part')}
   SELECT traj_id, pos, round(avg(score), 7) AS mean, round(min(score), 7) AS min, round(quantile_disc(score, 0.5), 7) AS median FROM knn GROUP BY traj_id, pos""")
def _(spark, sf):
    from functools import reduce

    h = _history(spark, sf)
    new, old = h.filter("traj_id % 5 = 0").drop("target"), h.filter("traj_id % 5 <> 0")
    parts = [features.knn_prior_score(new, old.filter(f"traj_id % 4 = {i}"), ["speed", "course"], k=5) for i in range(4)]
    scores = shared(spark, sf, "knn_sources", lambda: reduce(lambda a, b: a.unionByName(b), parts))
    combined = [features.combine_sources(scores, how).withColumnRenamed("score", how) for how in _HOWS]
    return reduce(lambda a, b: a.join(b, ["traj_id", "pos"]), combined).select("traj_id", "pos", *_rounded(_HOWS, 7))


@check("k13_history_support", f"""WITH {_HISTORY_SQL}, o AS (SELECT *, row_number() OVER (ORDER BY target DESC, traj_id, pos) AS n, count(*) OVER () AS total FROM h WHERE target >= 0.05)
   SELECT traj_id, pos, target FROM o WHERE n <= greatest(1, ceil(0.3 * total))""")
def _(spark, sf):
    return features.history_support(_history(spark, sf), 0.3, 0.05).select("traj_id", "pos", "target")


@check("k14_knn_frequency_labels", f"""WITH {_HISTORY_SQL}, {_knn_sql(5)}, scored AS (SELECT p.*, k.score FROM points p JOIN knn k ON k.traj_id = p.traj_id AND k.pos = p.pos),
   {_freq_sql(ratios=[0.2, 0.4])} SELECT traj_id, pos, round(label, 9) AS label FROM freq""")
def _(spark, sf):
    p = points(spark, sf).withColumn("course", F.col("heading") / 360.0)
    return features.knn_frequency_labels(p, _history(spark, sf), ["speed", "course"], [0.2, 0.4], k=5).select("traj_id", "pos", r("label").alias("label"))


# ---- audits -------------------------------------------------------------------------------

_L = f"{POINTS_SQL}, st AS (SELECT traj_id, pos, speed AS score, turn_score AS target, turn_score > 0.3 AS positive FROM points)"


def _st(spark, sf):
    return points(spark, sf).select("traj_id", "pos", F.col("speed").alias("score"), F.col("turn_score").alias("target"), (F.col("turn_score") > 0.3).alias("positive"))


@check("l1_ordinal_rank", f"WITH {_L} SELECT traj_id, pos, row_number() OVER (ORDER BY score, traj_id, pos) - 1 AS rank FROM st")
def _(spark, sf):
    return audits.ordinal_rank(_st(spark, sf), "score").select("traj_id", "pos", "rank")


_RK = "rk AS (SELECT *, row_number() OVER (ORDER BY score, traj_id, pos) - 1 AS rs, row_number() OVER (ORDER BY target, traj_id, pos) - 1 AS rt, row_number() OVER (ORDER BY score DESC, traj_id, pos) AS ds, row_number() OVER (ORDER BY target DESC, traj_id, pos) AS dt FROM st)"


@check("l2_pearson_spearman", f"WITH {_L}, {_RK} SELECT round(corr(score, target), 8) AS pearson, round(corr(rs, rt), 8) AS spearman FROM rk")
def _(spark, sf):
    from tracklake.operators.tracks import one_row

    d = _st(spark, sf)
    return one_row(audits.pearson(d, "score", "target"), audits.spearman(d, "score", "target")).select(*_rounded(("pearson", "spearman"), 8))


@check("l3_kendall_sampled", f"""WITH {_L}, ix AS (SELECT *, row_number() OVER (ORDER BY traj_id, pos) - 1 AS i, count(*) OVER () AS n FROM st),
   dr AS (SELECT CAST(floor({hash_sql("'pair|1|1706011|' || j")} * (SELECT any_value(n) FROM ix)) AS BIGINT) AS i1, CAST(floor({hash_sql("'pair|2|1706011|' || j")} * (SELECT any_value(n) FROM ix)) AS BIGINT) AS i2 FROM range(20000) AS g(j))
   SELECT round(2 * avg(CASE WHEN abs(a.score - b.score) > 1e-8 AND abs(a.target - b.target) > 1e-8 THEN ((a.score - b.score) * (a.target - b.target) > 0)::INT END) - 1, 9) AS kendall
   FROM dr JOIN ix a ON a.i = i1 JOIN ix b ON b.i = i2 WHERE i1 <> i2""")
def _(spark, sf):
    return audits.kendall(_st(spark, sf), "score", "target", 20_000).select(r("kendall").alias("kendall"))


@check("l4_auc_and_ap", f"""WITH {_L}, {_RK}, c AS (SELECT *, sum(positive::INT) OVER (ORDER BY ds) AS hits FROM rk), n AS (SELECT count(*) FILTER (positive) AS p, count(*) FILTER (NOT positive) AS q FROM st)
   SELECT round(((SELECT sum(rs + 1) FROM rk WHERE positive) - p * (p + 1) / 2e0) / (p * q), 9) AS auc, round((SELECT avg(hits / ds::DOUBLE) FROM c WHERE positive), 8) AS pr_auc FROM n""")
def _(spark, sf):
    from tracklake.operators.tracks import one_row

    d = _st(spark, sf)
    row = one_row(audits.roc_auc(d, "score", "positive"), audits.average_precision(d, "score", "positive"))
    return row.select(r("auc").alias("auc"), r("pr_auc", 8).alias("pr_auc"))


@check("l5_ndcg_and_lift", f"""WITH {_L}, {_RK}, k AS (SELECT greatest(1, ceil(0.05e0 * count(*))) AS k5, greatest(1, ceil(0.1e0 * count(*))) AS k10, avg(target) AS m FROM st)
   SELECT round((SELECT sum(target / log2(ds + 1)) FROM rk WHERE ds <= k5) / (SELECT sum(target / log2(dt + 1)) FROM rk WHERE dt <= k5), 8) AS ndcg_at_5, round((SELECT avg(target) FROM rk WHERE ds <= k5) / m, 8) AS lift_at_5,
          round((SELECT sum(target / log2(ds + 1)) FROM rk WHERE ds <= k10) / (SELECT sum(target / log2(dt + 1)) FROM rk WHERE dt <= k10), 8) AS ndcg_at_10, round((SELECT avg(target) FROM rk WHERE ds <= k10) / m, 8) AS lift_at_10 FROM k""")
def _(spark, sf):
    return audits.ndcg_and_lift(_st(spark, sf), "score", "target", (0.05, 0.10)).select(*_rounded(("ndcg_at_5", "lift_at_5", "ndcg_at_10", "lift_at_10"), 8))


@check("l6_score_target_metrics", f"""WITH {_L}, {_RK} SELECT count(*) AS valid, count(*) FILTER (target > 0) AS positive, round(avg(target), 9) AS target_mean, round(corr(rs, rt), 8) AS spearman FROM rk""")
def _(spark, sf):
    m = audits.score_target_metrics(_st(spark, sf), "score", "target")
    return m.select("valid", "positive", r("target_mean").alias("target_mean"), r("spearman", 8).alias("spearman"))


_PS = f"""{PRIOR_SQL}, ps0 AS (SELECT *, 0.7e0 * query_hit + 0.3e0 * query_hit_clock AS query_mass, greatest(entry_exit, crossing) AS boundary_max FROM sampled),
ps AS (SELECT *, least(1e0, query_mass * (0.5e0 + behavior) + 0.25e0 * boundary_max * boundary_max) AS replacement_score, least(1e0, query_mass * (0.5e0 + least(1e0, 0.5e0 * behavior + 0.5e0 * entry_exit)) + 0.25e0 * entry_exit * entry_exit) AS combined FROM ps0)"""


@check("l7_prior_scores", f"WITH {_PS} SELECT traj_id, pos, {_rounded_sql(('query_mass', 'boundary_max', 'replacement_score', 'combined'), 10)}, round(least(1e0, 0.7e0 * replacement_score + 0.3e0 * route_density), 10) AS block_score FROM ps")
def _(spark, sf):
    return priors.prior_scores(sampled(spark, sf)).select("traj_id", "pos", *_rounded(("query_mass", "boundary_max", "replacement_score", "combined", "block_score"), 10))


@check("l8_predictability_audit")
def _(spark, sf):
    a = audits.predictability_audit(priors.prior_scores(sampled(spark, sf)), dense_targets(spark, sf))
    return a.withColumn("failed_checks", F.array_join("failed_checks", ","))


@check("l8_alignment_gate")
def _(spark, sf):
    heads = audits.per_head_audit(priors.prior_scores(sampled(spark, sf)), dense_targets(spark, sf))
    return audits.alignment_gate(heads).withColumn("failed_checks", F.array_join("failed_checks", ","))


@check("l9_score_sensitivity", f"""WITH {POINTS_SQL}, d AS (SELECT traj_id, pos, abs(speed / 6 - turn_score) AS d, row_number() OVER (ORDER BY speed / 6 DESC, traj_id, pos) AS ra, row_number() OVER (ORDER BY turn_score DESC, traj_id, pos) AS rb,
     ceil(0.05e0 * count(*) OVER ()) AS k, pos % 3 = 0 AS ka, pos % 2 = 0 AS kb FROM points)
   SELECT round(avg(d), 8) AS mean_abs_delta, round(max(d), 8) AS max_abs_delta, count(*) FILTER (d > 1e-9) AS changed, round(count(*) FILTER (ka AND kb) / count(*) FILTER (ka OR kb)::DOUBLE, 9) AS kept_jaccard,
   round(count(*) FILTER (ka <> kb) / count(*)::DOUBLE, 9) AS kept_hamming, round(count(*) FILTER (ra <= k AND rb <= k) / count(*) FILTER (ra <= k OR rb <= k)::DOUBLE, 9) AS top_jaccard FROM d""")
def _(spark, sf):
    p = points(spark, sf)
    a, b = p.withColumn("score", F.col("speed") / 6), p.withColumn("score", F.col("turn_score"))
    s = audits.score_sensitivity(a, b, p.filter("pos % 3 = 0"), p.filter("pos % 2 = 0"))
    return s.select("changed", *_rounded(("mean_abs_delta", "max_abs_delta"), 8), *_rounded(("kept_jaccard", "kept_hamming", "top_jaccard"), 9))


@check("l3_kendall", f"""WITH {_L}, g AS (SELECT row_number() OVER () AS id, CAST(round(score / 1e-8) AS BIGINT) AS a, CAST(round(target / 1e-8) AS BIGINT) AS b FROM st),
   p AS (SELECT sum(sign(x.a - y.a) * sign(x.b - y.b)) AS d, count(*) FILTER (x.a <> y.a AND x.b <> y.b) AS n FROM g x JOIN g y ON x.id < y.id) SELECT round(d / n, 9) AS kendall FROM p""")
def _(spark, sf):
    return audits.kendall(_st(spark, sf), "score", "target").select(r("kendall").alias("kendall"))


def _prior_stats(field: str) -> str:
    v = field
    return f"""count(*) AS "values", round(avg({v}), 9) AS mean_abs_delta, round(max({v}), 9) AS max_abs_delta, round(avg({v}), 9) AS mean_delta, round(avg(({v} > 1e-9)::INT), 9) AS changed_share,
       round(avg({v}), 9) AS mean_a, round(stddev_pop({v}), 7) AS std_a, round(avg(({v} > 1e-12)::INT), 9) AS nonzero_a, 0e0 AS mean_b, 0e0 AS std_b, 0e0 AS nonzero_b, max({v}) <= 1e-9 AS is_flat"""


@check("l9b_prior_sensitivity", f"""WITH {PRIOR_SQL}, l AS (SELECT 'query_hit' AS field, query_hit AS v FROM sampled UNION ALL SELECT 'behavior', behavior FROM sampled)
   SELECT field, {_prior_stats('v')} FROM l GROUP BY field UNION ALL SELECT 'all', {_prior_stats('v')} FROM l""")
def _(spark, sf):
    s = sampled(spark, sf)
    zero = s.select("traj_id", "pos", F.lit(0.0).alias("query_hit"), F.lit(0.0).alias("behavior"))
    d = audits.prior_sensitivity(s, zero, ("query_hit", "behavior"))
    rounded = _rounded(("mean_abs_delta", "max_abs_delta", "mean_delta", "changed_share", "mean_a", "nonzero_a", "mean_b", "nonzero_b"), 9)
    return d.select(F.coalesce("field", F.lit("all")).alias("field"), "values", "is_flat", *rounded, *_rounded(("std_a", "std_b"), 7))


@check("l9b_prior_sample_gate", f"""WITH {PRIOR_SQL}, x AS (SELECT quantile_disc(lat, 0.6) AS cut FROM points), o AS (SELECT avg((lat > cut)::INT) AS share FROM points, x)
   SELECT concat_ws(',', CASE WHEN (SELECT avg((query_hit > 1e-12)::INT) FROM sampled) <= 1e-6 THEN 'prior_not_zero' END, 'shuffle_changes_values', CASE WHEN share > 0.5 THEN 'points_inside_extent' END) AS failed_checks, false AS gate_pass FROM o""")
def _(spark, sf):
    s = sampled(spark, sf).select("traj_id", "pos", "query_hit")
    p = points(spark, sf)
    cut = p.agg(F.expr("percentile_disc(0.6) WITHIN GROUP (ORDER BY lat)")).first()[0]
    extent = {"lat_min": -90.0, "lat_max": cut, "lon_min": -180.0, "lon_max": 180.0}
    gate = audits.prior_sample_gate(audits.prior_sensitivity(s, s, ("query_hit",)), audits.outside_share(p, extent))
    return gate.withColumn("failed_checks", F.array_join("failed_checks", ","))


_RES_SQL = """res AS (SELECT (n_points % 4) AS cv, (traj_id % 7) AS rv, avg(speed) AS score, avg(turn_score) * 3 AS uniform, avg(heading) / 100 AS douglas_peucker, count(*) FILTER (speed > 5.9) AS gate_failures FROM points GROUP BY ALL),
runs AS (SELECT [0.05e0, 0.1e0, 0.15e0, 0.3e0][cv + 1] AS coverage, [0.01e0, 0.02e0, 0.05e0, 0.1e0, 0.15e0, 0.2e0, 0.3e0][rv + 1] AS ratio, score, uniform, douglas_peucker, gate_failures FROM res)"""


def _runs(spark, sf):
    """Grid results made of track statistics, one row per coverage and ratio."""
    res = points(spark, sf).groupBy((F.col("n_points") % 4).alias("cv"), (F.col("traj_id") % 7).alias("rv")).agg(
        F.avg("speed").alias("score"), (F.avg("turn_score") * 3).alias("uniform"), (F.avg("heading") / 100).alias("douglas_peucker"),
        F.count_if(F.col("speed") > 5.9).alias("gate_failures"))
    pick = [F.element_at(F.array(*[F.lit(x) for x in xs]), (F.col(c) + 1).cast("int")) for xs, c in ((audits.GRID_COVERAGES, "cv"), (audits.GRID_RATIOS, "rv"))]
    return res.select(pick[0].alias("coverage"), pick[1].alias("ratio"), "score", "uniform", "douglas_peucker", "gate_failures")


@check("l10_causality_gate", f"""WITH {POINTS_SQL}, m AS (SELECT source_id AS method, avg(speed) AS score FROM points GROUP BY source_id), gap AS (SELECT (SELECT score FROM m WHERE method = 's0') AS a, (SELECT score FROM m WHERE method = 's1') AS u)
   SELECT method, round(a - score, 9) AS delta, round(greatest(0.005e0, 0.6e0 * greatest(0, a - u)), 9) AS needed, a - score >= greatest(0.005e0, 0.6e0 * greatest(0, a - u)) AS passed FROM m, gap WHERE method = 's2'""")
def _(spark, sf):
    m = points(spark, sf).groupBy(F.col("source_id").alias("method")).agg(F.avg("speed").alias("score"))
    return audits.causality_gate(m, "s0", "s1", ["s2"]).withColumns({"delta": r("delta"), "needed": r("needed")})


@check("l11_sanity_gate", f"""WITH {EVAL_SQL}, x AS (SELECT a.*, a.avg_sed_km / b.avg_sed_km AS sr FROM metric_row a, metric_row b WHERE a.method = 'thirds' AND b.method = 'uniform')
   SELECT method, round(sr, 5) AS sed_ratio, concat_ws(',', CASE WHEN NOT length_preservation BETWEEN 0.8 AND 1.2 THEN 'length' END, CASE WHEN endpoint_sanity < 1 THEN 'endpoints' END, CASE WHEN sr > 1.5 THEN 'sed' END) AS failed_checks FROM x""")
def _(spark, sf):
    g = audits.sanity_gate(evaluated(spark, sf).withColumn("ratio", F.lit(0.2)))
    return g.select("method", r("sed_ratio", 5).alias("sed_ratio"), F.array_join("failed_checks", ",").alias("failed_checks"))


_SPREAD_SQL = f"""WITH {POINTS_SQL}, d AS (SELECT traj_id, pos, greatest(0, speed / 6 - 0.5e0) AS label, CASE WHEN pos % 3 = 0 THEN 0.04e0 ELSE 0.5e0 * (pos % 2) END AS boundary, least(1, speed / 6) AS behavior,
       CASE WHEN pos % 10 = 0 THEN 1e0 ELSE 0e0 END AS replacement, speed / 6 AS hit_probability FROM points),
   l AS (UNPIVOT d ON label, boundary, behavior, replacement, hit_probability INTO NAME head VALUE v),
   o AS (SELECT *, row_number() OVER (PARTITION BY head ORDER BY v DESC) AS rn, count(*) OVER (PARTITION BY head) AS n FROM l),
   h AS (SELECT head, avg((v > CASE WHEN head IN ('boundary', 'replacement') THEN 0.05e0 ELSE 0.01e0 END)::INT) AS support,
       CASE WHEN head <> 'label' THEN sum(v) FILTER (rn <= ceil(0.05e0 * n)) / sum(v) END AS top5_mass FROM o GROUP BY head),
   f AS (SELECT *, head NOT IN ('hit_probability') AS blocking, concat_ws(',', CASE WHEN support > 0.5 THEN 'support' END, CASE WHEN top5_mass < 0.1 THEN 'top5_mass' END) AS failed_checks FROM h)"""


def _spread(spark, sf):
    d = points(spark, sf).select(
        "traj_id", "pos", F.greatest(F.lit(0.0), F.col("speed") / 6 - 0.5).alias("label"), F.when(F.col("pos") % 3 == 0, 0.04).otherwise(0.5 * (F.col("pos") % 2)).alias("boundary"),
        F.least(F.lit(1.0), F.col("speed") / 6).alias("behavior"), F.when(F.col("pos") % 10 == 0, 1.0).otherwise(0.0).alias("replacement"), (F.col("speed") / 6).alias("hit_probability"))
    return audits.diffusion_rows(d, "label", ["boundary", "behavior", "replacement", "hit_probability"])


@check("l11_diffusion_rows", f"""{_SPREAD_SQL} SELECT head, round(support, 9) AS support, round(top5_mass, 7) AS top5_mass, blocking, failed_checks FROM f""")
def _(spark, sf):
    return _spread(spark, sf).select("head", r("support").alias("support"), r("top5_mass", 7).alias("top5_mass"), "blocking", F.array_join("failed_checks", ",").alias("failed_checks"))


@check("l11_diffusion_gate", f"""{_SPREAD_SQL}, x AS (SELECT head, unnest(string_split(failed_checks, ',')) AS c FROM f WHERE blocking AND failed_checks <> '')
   SELECT coalesce(string_agg(head || ':' || c, ',' ORDER BY head || ':' || c), '') AS failed_checks, count(*) = 0 AS gate_pass FROM x""")
def _(spark, sf):
    return audits.diffusion_gate(_spread(spark, sf)).withColumn("failed_checks", F.array_join("failed_checks", ","))


@check("l11_selection_scores", f"""WITH {POINTS_SQL}, m AS (SELECT mmsi AS run_id, avg(speed) / 6 AS score, avg(turn_score) AS uniform, CASE WHEN mmsi % 3 = 0 THEN 0e0 ELSE 1e0 END AS spread, CASE WHEN mmsi % 2 = 0 THEN avg(heading) / 360 END AS loss FROM points GROUP BY mmsi)
   SELECT run_id, round(coalesce(0.001e0 * score - loss, score) - (spread < 0.001)::INT, 9) AS selection, round(score + 0.5e0 * (score - uniform) - greatest(0, uniform - score) - (spread < 0.001)::INT, 9) AS gap_selection FROM m""")
def _(spark, sf):
    m = points(spark, sf).groupBy(F.col("mmsi").alias("run_id")).agg(
        (F.avg("speed") / 6).alias("score"), F.avg("turn_score").alias("uniform"), F.when(F.col("mmsi") % 3 == 0, 0.0).otherwise(1.0).alias("spread"),
        F.when(F.col("mmsi") % 2 == 0, F.avg("heading") / 360).alias("loss"))
    gap = audits.uniform_gap_score(F.col("score"), F.col("uniform"), F.col("spread"), {"range": (F.col("score"), F.col("uniform"))}, {"range": 2.0})
    return m.select("run_id", F.round(audits.selection_score(F.col("score"), F.col("spread"), F.col("loss")), 9).alias("selection"), F.round(gap, 9).alias("gap_selection"))


@check("l12_grid_acceptance", f"""WITH {POINTS_SQL}, {_RES_SQL} SELECT 28 - count(*) AS missing_cells, 0::BIGINT AS duplicate_cells, count(*) FILTER (score > uniform) AS wins_uniform, count(*) FILTER (score > douglas_peucker) AS wins_douglas_peucker,
   count(*) FILTER (score > uniform AND ratio <= 0.05) AS low_budget_wins, count(*) FILTER (score > uniform AND ratio = 0.05) AS five_percent_wins, count(*) FILTER (gate_failures > 0) AS cells_with_failed_gates FROM runs""")
def _(spark, sf):
    return audits.grid_acceptance(_runs(spark, sf)).drop("failed_checks", "accepted")


@check("l13_audit_summary", f"""WITH {POINTS_SQL}, m AS (SELECT source_id AS method, [0.02e0, 0.05e0, 0.1e0, 0.2e0][n_points % 4 + 1] AS ratio, avg(speed) AS score FROM points GROUP BY ALL)
   SELECT b.method AS baseline, count(*) AS budgets, count(*) FILTER (a.score > b.score) AS wins, round(avg(a.score - b.score), 9) AS mean_delta, count(*) FILTER (a.ratio <= 0.05) AS low_budgets,
   count(*) FILTER (a.ratio <= 0.05 AND a.score > b.score) AS low_wins, round(avg(a.score - b.score) FILTER (a.ratio <= 0.05), 9) AS low_mean_delta FROM m a JOIN m b USING (ratio) WHERE a.method = 's0' AND b.method <> 's0' GROUP BY b.method""")
def _(spark, sf):
    ratio = F.element_at(F.array(*[F.lit(x) for x in (0.02, 0.05, 0.1, 0.2)]), (F.col("n_points") % 4 + 1).cast("int"))
    m = points(spark, sf).groupBy(F.col("source_id").alias("method"), ratio.alias("ratio")).agg(F.avg("speed").alias("score"))
    return audits.audit_summary(m, "s0", ["s1", "s2"]).withColumns({c: r(c) for c in ("mean_delta", "low_mean_delta")})


_RUN_SQL = f"""WITH {POINTS_SQL}, m AS (SELECT mmsi AS run_id, CASE WHEN mmsi % 5 = 0 THEN NULL ELSE round(avg(speed), 0) END AS score, round(avg(turn_score), 1) AS fallback, round(avg(heading) / 60, 0) AS uniform, round(avg(lat), 0) % 6 AS douglas_peucker,
   (mmsi % 11 = 0)::INT AS exit_code, mmsi % 13 = 0 AS upper_bound, mmsi % 7 <> 0 AS blind, mmsi % 9 <> 0 AS frozen, CASE WHEN mmsi % 4 > 0 THEN (mmsi % 4) * 0.125e0 END AS free_share FROM points GROUP BY mmsi),
   c AS (SELECT *, CASE WHEN NOT blind THEN 'not_workload_blind' WHEN free_share IS NULL THEN 'missing_selector_evidence' WHEN free_share < 0.25 THEN 'selector_scaffold_dominated' ELSE 'model_has_material_budget' END AS claim FROM m)"""


def _judged_runs(spark, sf):
    m = points(spark, sf).groupBy(F.col("mmsi").alias("run_id")).agg(
        F.when(F.col("mmsi") % 5 != 0, F.round(F.avg("speed"), 0)).alias("score"), F.round(F.avg("turn_score"), 1).alias("fallback"),
        F.round(F.avg("heading") / 60, 0).alias("uniform"), (F.round(F.avg("lat"), 0) % 6).alias("douglas_peucker"))
    i = F.col("run_id")
    m = m.withColumns({"exit_code": (i % 11 == 0).cast("int"), "upper_bound": i % 13 == 0, "blind": i % 7 != 0, "frozen": i % 9 != 0, "free_share": F.when(i % 4 > 0, (i % 4) * 0.125)})
    return audits.claim_evidence(m)


@check("l14_best_run_and_status", f"""{_RUN_SQL} SELECT run_id, CASE WHEN exit_code <> 0 THEN 'child_failed' WHEN score IS NULL THEN 'missing_range_usefulness' WHEN upper_bound THEN 'diagnostic_upper_bound' WHEN NOT blind THEN 'non_blind_model'
       WHEN NOT frozen THEN 'protocol_fail' WHEN score > uniform AND score > douglas_peucker THEN CASE WHEN claim IN ('missing_selector_evidence', 'selector_scaffold_dominated') THEN claim ELSE 'beats_uniform_and_douglas_peucker' END
       WHEN score > douglas_peucker THEN 'fails_uniform' WHEN score > uniform THEN 'fails_douglas_peucker' ELSE 'fails_uniform_and_douglas_peucker' END AS status,
       run_id = (SELECT run_id FROM c ORDER BY coalesce(score, fallback) DESC, run_id LIMIT 1) AS is_best FROM c""")
def _(spark, sf):
    m = _judged_runs(spark, sf)
    best = audits.best_run(m, ["score", "fallback"]).select("run_id").scalar()
    return audits.run_status(m).withColumn("_b", best).select("run_id", "status", (F.col("run_id") == F.col("_b")).alias("is_best"))


@check("l14_worst_component", f"""WITH {EVAL_SQL}, l AS (UNPIVOT (SELECT method, point_f1, ship_f1, turn_coverage FROM metric_row) ON point_f1, ship_f1, turn_coverage INTO NAME component VALUE value),
   w AS (SELECT a.method, a.component, a.value - b.value AS delta, row_number() OVER (PARTITION BY a.method ORDER BY a.value - b.value, a.component) AS n FROM l a JOIN l b USING (component) WHERE (a.method, b.method) IN (('uniform', 'thirds'), ('thirds', 'thirds')))
   SELECT method, CASE WHEN delta < 0 THEN component ELSE 'none' END AS component, CASE WHEN delta < 0 THEN round(delta, 6) ELSE 0 END AS delta FROM w WHERE n = 1""")
def _(spark, sf):
    e = evaluated(spark, sf).withColumn("ratio", F.lit(0.2))
    rows = [audits.worst_component(e, m, "thirds", ["point_f1", "ship_f1", "turn_coverage"]).withColumn("method", F.lit(m)) for m in ("uniform", "thirds")]
    return rows[0].unionByName(rows[1]).select("method", "component", r("delta", 6).alias("delta"))


@check("l14_claim_evidence", f"""{_RUN_SQL} SELECT run_id, claim, CASE WHEN blind THEN free_share >= 0.25 END AS enough_evidence FROM c""")
def _(spark, sf):
    return _judged_runs(spark, sf).select("run_id", "claim", "enough_evidence")


def _fit_sql(x: float) -> str:
    return f"""SELECT {x}e0 AS ratio, sum(label) FILTER (rs <= k OR e) / (SELECT sum(label) FROM d) AS score_mass_share, sum(label) FILTER (u.pos IS NOT NULL) / (SELECT sum(label) FROM d) AS uniform_mass_share,
       sum(label) FILTER (rl <= k OR e) / (SELECT sum(label) FROM d) AS ideal_mass_share, count(*) FILTER ((rs <= k OR e) AND (rl <= k OR e)) AS overlap
       FROM (SELECT *, {k_sql(x)} AS k FROM d) a LEFT JOIN u{int(x * 100)} u ON u.traj_id = a.traj_id AND u.pos = a.pos"""


@check("j24_target_fit", f"""WITH {POINTS_SQL}, {spaced_sql('points', 'u10', k_sql(0.1))}, {spaced_sql('points', 'u30', k_sql(0.3))},
   d AS (SELECT traj_id, pos, n_points, turn_score AS score, speed AS label, is_start OR is_end AS e, row_number() OVER (PARTITION BY traj_id ORDER BY turn_score DESC, pos) AS rs, row_number() OVER (PARTITION BY traj_id ORDER BY speed DESC, pos) AS rl FROM points),
   g AS (SELECT row_number() OVER () AS id, CAST(round(score / 1e-8) AS BIGINT) AS a, CAST(round(label / 1e-8) AS BIGINT) AS b FROM d),
   tau AS (SELECT sum(sign(x.a - y.a) * sign(x.b - y.b)) / count(*) FILTER (x.a <> y.a AND x.b <> y.b) AS kendall FROM g x JOIN g y ON x.id < y.id), f AS ({_fit_sql(0.1)} UNION ALL {_fit_sql(0.3)})
   SELECT ratio, round(score_mass_share, 9) AS score_mass_share, round(uniform_mass_share, 9) AS uniform_mass_share, round(ideal_mass_share, 9) AS ideal_mass_share, overlap, round(kendall, 9) AS kendall FROM f, tau""")
def _(spark, sf):
    p = points(spark, sf)
    s = p.select("traj_id", "pos", F.col("turn_score").alias("score"))
    fit = audits.target_fit(p, s, p.select("traj_id", "pos", F.col("speed").alias("label")), [0.1, 0.3])
    return fit.select("ratio", "overlap", *_rounded(("score_mass_share", "uniform_mass_share", "ideal_mass_share", "kendall"), 9))


@check("g11_support_overlap_gate")
def _(spark, sf):
    p = points(spark, sf)
    train, ev = p.filter("source_id <> 's2'"), p.filter("source_id = 's2'")
    pr = priors.build_prior_fields(train, boxes(spark), None, BINS, 6, 2)
    ext = spark.createDataFrame([pr.extent])
    g = diagnostics.support_overlap_gate(train, ev, priors.sample_prior(ev, pr), ext)
    return g.withColumn("failed_checks", F.array_join("failed_checks", ","))


@check("m1_m2_fit_and_score")
def _(spark, sf):
    feats = features.feature_set(points(spark, sf), "context")
    model = scorer.fit_scorer(feats, dense_targets(spark, sf), ("hit_probability", "replacement"), trees=3, depth=3)
    return scorer.compose_score(scorer.predict_heads(feats, model)).select("traj_id", "pos", "score")


@check("m2_compose_score", f"""WITH {TARGET_SQL} SELECT traj_id, pos, round(least(1e0, hit_probability * 0.5e0 * (0.5e0 + behavior) + 0.25e0 * boundary), 8) AS score FROM targets""")
def _(spark, sf):
    return scorer.compose_score(targets(spark, sf), ("replacement",)).select("traj_id", "pos", r("score", 8).alias("score"))


@check("m3_score_and_simplify")
def _(spark, sf):
    p = points(spark, sf)
    feats = features.feature_set(p, "points")
    model = scorer.fit_scorer(feats, dense_targets(spark, sf), ("hit_probability", "block_budget"), trees=2, depth=2)
    return scorer.score_and_simplify(p, feats, model, 0.2)


@check("m4_block_fit")
def _(spark, sf):
    p = points(spark, sf)
    return scorer.block_fit(p.select("traj_id", "pos", F.col("turn_score").alias("score")), dense_targets(spark, sf), 8)
