"""Evaluation of kept sets."""

from __future__ import annotations

from pyspark.sql import functions as F

from tracklake.operators import metrics, ranges, simplify

from .fixtures import POINTS_SQL, boxes, points, shared
from .registry import check
from .simplify import k_sql, spaced_sql
from .tracks import SUPPORT_SQL, hav, r

SETS_SQL = f"""{spaced_sql('points', 'uniform', k_sql(0.2))},
retained AS (SELECT 'thirds' AS method, 0.33e0 AS ratio, traj_id, pos FROM points WHERE pos % 3 = 0 OR is_end
             UNION ALL SELECT 'uniform', 0.2e0, traj_id, pos FROM uniform),
sets AS (SELECT DISTINCT method, ratio FROM retained)"""


def retained(spark, sf):
    def make():
        p = points(spark, sf)
        thirds = p.filter("pos % 3 = 0 OR is_end").select("traj_id", "pos")
        both = [("thirds", 0.33, thirds), ("uniform", 0.2, simplify.simplify_uniform(p, 0.2))]
        a, b = (k.select(F.lit(m).alias("method"), F.lit(x).alias("ratio"), "traj_id", "pos") for m, x, k in both)
        return a.unionByName(b)

    return shared(spark, sf, "retained", make)


def support(spark, sf):
    return shared(spark, sf, "support", lambda: metrics.audit_support(points(spark, sf), boxes(spark)))


def crossings(spark, sf):
    return shared(spark, sf, "crossings", lambda: ranges.crossing_brackets(points(spark, sf), boxes(spark)))


def scores(spark, sf):
    return metrics.query_scores(
        points(spark, sf), retained(spark, sf), boxes(spark), support=support(spark, sf), crossings=crossings(spark, sf)
    )


def err_sql(l, r_):
    """SED and PED of (t, lat, lon) between the struct-like prefixes l and r_."""
    a = f"least(1e0, greatest(0e0, (t - {l}t) / greatest(1e-9, {r_}t - {l}t)))"
    dy = f"(lat - ({l}lat + {a} * ({r_}lat - {l}lat))) * 111.32e0"
    dx = f"(lon - ({l}lon + {a} * ({r_}lon - {l}lon))) * cos(radians(lat)) * 111.32e0"
    bx, by = f"(({r_}lon - {l}lon) * cos(radians({l}lat)) * 111.32e0)", f"(({r_}lat - {l}lat) * 111.32e0)"
    px, py = f"((lon - {l}lon) * cos(radians({l}lat)) * 111.32e0)", f"((lat - {l}lat) * 111.32e0)"
    return (
        f"sqrt(({dx}) * ({dx}) + ({dy}) * ({dy}))",
        f"abs({bx} * {py} - {by} * {px}) / greatest(1e-9, sqrt({bx} * {bx} + {by} * {by}))",
    )


def bracket_sql(src, out, keys, extra=()):
    cols = ("t", "lat", "lon", *extra)
    parts = []
    for tag, fn, frame in (("l_", "last_value", "ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING"), ("r_", "first_value", "ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING")):
        parts += [f"{fn}(CASE WHEN kept THEN {c} END IGNORE NULLS) OVER (PARTITION BY {keys} ORDER BY pos {frame}) AS {tag}{c}" for c in cols]
    return f"{out} AS (SELECT *, {', '.join(parts)} FROM {src})"


_SED, _PED = err_sql("l_", "r_")
FLAG_SQL = f"""{SETS_SQL},
flagged AS (SELECT s.method, s.ratio, p.traj_id, p.pos, p.t, p.lat, p.lon, p.n_points, k.pos IS NOT NULL AS kept
            FROM points p CROSS JOIN sets s LEFT JOIN retained k ON k.method = s.method AND k.traj_id = p.traj_id AND k.pos = p.pos),
{bracket_sql('flagged', 'near', 'method, traj_id')},
errors AS (SELECT method, ratio, traj_id, pos, kept, CASE WHEN NOT kept AND l_t IS NOT NULL AND r_t IS NOT NULL THEN {_SED} END AS sed_km,
   CASE WHEN NOT kept AND l_t IS NOT NULL AND r_t IS NOT NULL THEN {_PED} END AS ped_km,
   count(*) FILTER (kept) OVER (PARTITION BY method, traj_id) AS kept_in_track FROM near)"""

_DEG = "sqrt((({b}lat) - ({a}lat)) ** 2 + (({b}lon) - ({a}lon)) ** 2)"
AUDIT_SQL = f"""{SUPPORT_SQL}, {FLAG_SQL},
sup0 AS (SELECT h.query_id, h.traj_id, h.pos, h.t, h.lat, h.lon, h.turn_score, e.is_boundary,
   lag(h.lat) OVER w AS p_lat, lag(h.lon) OVER w AS p_lon, lead(h.lat) OVER w AS n_lat, lead(h.lon) OVER w AS n_lon,
   row_number() OVER w - 1 AS i, count(*) OVER (PARTITION BY h.query_id, h.traj_id) AS n_in
   FROM hits h JOIN edge e USING (query_id, traj_id, pos) WINDOW w AS (PARTITION BY h.query_id, h.traj_id ORDER BY h.pos)),
sup1 AS (SELECT *, coalesce({hav('p_lat', 'p_lon', 'lat', 'lon')}, 0e0) AS step,
   CASE WHEN p_lat IS NOT NULL AND n_lat IS NOT NULL THEN greatest(0e0, {_DEG.format(a='p_', b='')} + {_DEG.format(a='', b='n_')} - {_DEG.format(a='p_', b='n_')}) ELSE 0e0 END AS curvature FROM sup0),
support AS (SELECT *, greatest(curvature, greatest(turn_score, 0)) AS turn_w, sum(step) OVER (PARTITION BY query_id, traj_id ORDER BY pos) AS cum_km FROM sup1),
fs AS (SELECT s.*, e.method, e.ratio, e.kept, e.kept_in_track, e.sed_km, e.ped_km FROM support s JOIN errors e USING (traj_id, pos)),
{bracket_sql('fs', 'fsn', 'method, query_id, traj_id', ('i', 'cum_km'))},
g AS (SELECT method, ratio, query_id, traj_id, count(*) AS n, count(*) FILTER (kept) AS r, max(t) - min(t) AS span, min(t) AS t0, max(t) AS t1, max(cum_km) AS km,
   min(t) FILTER (kept) AS kt0, max(t) FILTER (kept) AS kt1, min(i) FILTER (kept) AS ki0, max(i) FILTER (kept) AS ki1,
   min(cum_km) FILTER (kept) AS kk0, max(cum_km) FILTER (kept) AS kk1,
   max(i - l_i - 1) FILTER (kept) AS im, max(t - l_t) FILTER (kept AND i - l_i > 1) AS it, max(cum_km - l_cum_km) FILTER (kept AND i - l_i > 1) AS ik,
   sum(turn_w) AS w, sum(turn_w) FILTER (kept) AS kw,
   sum({_SED} + {_PED}) FILTER (NOT kept AND l_t IS NOT NULL AND r_t IS NOT NULL) AS err,
   count(*) FILTER (NOT kept AND l_t IS NOT NULL AND r_t IS NOT NULL) AS en,
   avg((sed_km + ped_km) * 0.5e0) AS te, max(kept_in_track) AS kit FROM fsn GROUP BY method, ratio, query_id, traj_id),
ts0 AS (SELECT *, CASE WHEN r = 0 THEN 0e0 WHEN span <= 1e-9 THEN 1e0 WHEN r < 2 THEN 0e0 ELSE greatest(0e0, least(1e0, (kt1 - kt0) / span)) END AS temporal_coverage,
   greatest(1e-6, km / greatest(1, n - 1)) AS stp FROM g),
ts AS (SELECT method, ratio, query_id, traj_id, n, r, CASE WHEN r = 0 THEN 0e0 ELSE 2 * (r / n::DOUBLE) / (1 + r / n::DOUBLE) END AS ship_coverage, temporal_coverage,
   CASE WHEN r = 0 THEN 0e0 WHEN n = 1 THEN 1e0 ELSE greatest(0e0, 1 - greatest(ki0, n - 1 - ki1, coalesce(im, 0)) / greatest(1, n - 2)::DOUBLE) END AS gap_coverage,
   CASE WHEN r = 0 THEN 0e0 WHEN n = 1 OR span <= 1e-9 THEN 1e0 ELSE greatest(0e0, 1 - greatest(kt0 - t0, t1 - kt1, coalesce(it, 0)) / span) END AS gap_time_coverage,
   CASE WHEN r = 0 THEN 0e0 WHEN n = 1 OR km <= 1e-9 THEN 1e0 ELSE greatest(0e0, 1 - greatest(kk0, km - kk1, coalesce(ik, 0)) / km) END AS gap_distance_coverage,
   CASE WHEN r = 0 THEN 0e0 WHEN w <= 1e-12 THEN 1e0 WHEN kw <= 0 THEN 0e0 ELSE 2 * (kw / w) / (1 + kw / w) END AS turn_coverage,
   CASE WHEN r = 0 THEN 0e0 WHEN km <= 1e-9 THEN 1e0 WHEN r < 2 THEN 0e0 ELSE temporal_coverage * CASE WHEN en = 0 THEN 1e0 ELSE 1 / (1 + err / (2 * en) / stp) END END AS shape_score,
   CASE WHEN kit < 2 THEN 0e0 WHEN r >= n THEN 1e0 WHEN te IS NULL THEN 0e0 ELSE least(1e0, r / 2e0) / (1 + te / stp) END AS interpolation_fidelity FROM ts0),
qs AS (SELECT method, ratio, query_id, sum(n) AS n, sum(r) AS r, count(*) AS ships, count(*) FILTER (r > 0) AS kept_ships,
   {', '.join(f'avg({c}) AS {c}' for c in metrics.TRACK_SCORES)} FROM ts GROUP BY method, ratio, query_id),
ef AS (SELECT method, query_id, count(*) AS n, count(*) FILTER (kept) AS r FROM fs WHERE is_boundary GROUP BY method, query_id),
cf AS (SELECT f.method, b.query_id, count(*) AS n, count(*) FILTER (f.kept) AS r FROM brackets b JOIN flagged f USING (traj_id, pos) GROUP BY f.method, b.query_id),
query_scores AS (SELECT s.method, s.ratio, q.query_id,
   coalesce(2 * (qs.r / qs.n::DOUBLE) / (1 + qs.r / qs.n::DOUBLE), 1e0) AS point_f1,
   coalesce(2 * (kept_ships / ships::DOUBLE) / (1 + kept_ships / ships::DOUBLE), 1e0) AS ship_f1,
   coalesce(2 * (ef.r / ef.n::DOUBLE) / (1 + ef.r / ef.n::DOUBLE), 1e0) AS entry_exit_f1,
   coalesce(2 * (cf.r / cf.n::DOUBLE) / (1 + cf.r / cf.n::DOUBLE), 1e0) AS crossing_f1,
   {', '.join(f'coalesce(qs.{c}, 1e0) AS {c}' for c in metrics.TRACK_SCORES)}
   FROM boxes q CROSS JOIN sets s LEFT JOIN qs ON qs.method = s.method AND qs.query_id = q.query_id
   LEFT JOIN ef ON ef.method = s.method AND ef.query_id = q.query_id LEFT JOIN cf ON cf.method = s.method AND cf.query_id = q.query_id),
audit AS (SELECT method, ratio, {', '.join(f'avg({c}) AS {c}' for c in metrics.QUERY_SCORES)} FROM query_scores GROUP BY method, ratio)"""


def _rounded_sql(names, digits=6):
    return ", ".join(f"round({c}, {digits}) AS {c}" for c in names)


def _rounded(names, digits=6):
    return [r(c, digits).alias(c) for c in names]


@check("i1_set_f1", f"""WITH {SUPPORT_SQL}, ha AS (SELECT DISTINCT traj_id FROM hits WHERE query_id = 1), hb AS (SELECT DISTINCT traj_id FROM hits WHERE query_id = 2)
   SELECT (SELECT count(*) FROM ha) AS a, (SELECT count(*) FROM hb) AS b, (SELECT count(*) FROM ha SEMI JOIN hb USING (traj_id)) AS "both",
   round(2e0 * (SELECT count(*) FROM ha SEMI JOIN hb USING (traj_id)) / ((SELECT count(*) FROM ha) + (SELECT count(*) FROM hb)), 9) AS f1""")
def _(spark, sf):
    h = ranges.query_hits(points(spark, sf), boxes(spark))
    f = metrics.set_f1(h.filter("query_id = 1"), h.filter("query_id = 2"), "traj_id")
    return f.withColumn("f1", r("f1"))


@check("i1_i3_i4_query_f1", f"WITH {AUDIT_SQL} SELECT method, ratio, query_id, {_rounded_sql(('point_f1', 'ship_f1', 'entry_exit_f1', 'crossing_f1'), 9)} FROM query_scores")
def _(spark, sf):
    return scores(spark, sf).select("method", "ratio", "query_id", *_rounded(("point_f1", "ship_f1", "entry_exit_f1", "crossing_f1"), 9))


@check("i2_i5_i10_track_scores", f"WITH {AUDIT_SQL} SELECT method, ratio, query_id, traj_id, n AS full_points, r AS kept_points, {_rounded_sql(metrics.TRACK_SCORES, 8)} FROM ts")
def _(spark, sf):
    flagged = metrics.flagged_support(points(spark, sf), retained(spark, sf), support(spark, sf))
    t = metrics.track_scores(flagged)
    return t.select("method", "ratio", "query_id", "traj_id", "full_points", "kept_points", *_rounded(metrics.TRACK_SCORES, 8))


@check("i11_range_audit", f"WITH {AUDIT_SQL} SELECT method, ratio, {_rounded_sql(metrics.QUERY_SCORES)} FROM audit")
def _(spark, sf):
    return metrics.range_audit(scores(spark, sf)).select("method", "ratio", *_rounded(metrics.QUERY_SCORES))


def _weighted_sql(gap="gap_coverage"):
    return " + ".join(f"{w}e0 * {gap if c == 'gap_coverage' else c}" for c, w in metrics.USEFULNESS_WEIGHTS.items())


@check("i12_range_usefulness", f"""WITH {AUDIT_SQL} SELECT method, ratio, round({_weighted_sql()}, 6) AS range_usefulness,
   round({_weighted_sql('gap_time_coverage')}, 6) AS usefulness_gap_time, round({_weighted_sql('gap_distance_coverage')}, 6) AS usefulness_gap_distance,
   round({_weighted_sql('least(gap_time_coverage, gap_distance_coverage)')}, 6) AS usefulness_gap_min FROM audit""")
def _(spark, sf):
    names = ("range_usefulness", "usefulness_gap_time", "usefulness_gap_distance", "usefulness_gap_min")
    return metrics.range_audit(scores(spark, sf)).select("method", "ratio", *_rounded(names))


_LEN_SQL = f"""orig AS (SELECT traj_id, any_value(mmsi) AS mmsi, any_value(n_points) AS n_points, sum(coalesce({hav('pa', 'po', 'lat', 'lon')}, 0e0)) AS length_km FROM (
   SELECT *, lag(lat) OVER w AS pa, lag(lon) OVER w AS po FROM points WINDOW w AS (PARTITION BY traj_id ORDER BY pos)) GROUP BY traj_id),
klen AS (SELECT method, ratio, traj_id, sum(coalesce({hav('pa', 'po', 'lat', 'lon')}, 0e0)) AS kept_km, count(*) AS kept_points FROM (
   SELECT k.method, k.ratio, p.*, lag(p.lat) OVER w AS pa, lag(p.lon) OVER w AS po FROM retained k JOIN points p USING (traj_id, pos) WINDOW w AS (PARTITION BY k.method, p.traj_id ORDER BY p.pos)) GROUP BY ALL),
lens AS (SELECT s.method, s.ratio, o.*, coalesce(k.kept_km, 0e0) AS kept_km, coalesce(k.kept_points, 0) AS kept_points FROM orig o CROSS JOIN sets s LEFT JOIN klen k ON k.method = s.method AND k.traj_id = o.traj_id)"""

GLOBAL_SQL = f"""{_LEN_SQL},
dist AS (SELECT method, ratio, coalesce(avg(sed_km), 0) AS avg_sed_km, coalesce(max(sed_km), 0) AS max_sed_km, coalesce(avg(ped_km), 0) AS avg_ped_km,
         coalesce(max(ped_km), 0) AS max_ped_km, count(sed_km) AS removed_points FROM errors GROUP BY method, ratio),
lp AS (SELECT method, ratio, greatest(0e0, least(1e0, sum(kept_km) / sum(length_km))) AS length_preservation FROM lens WHERE length_km > 1e-9 GROUP BY method, ratio),
kg AS (SELECT k.method, k.ratio, p.n_points, p.pos - lag(p.pos) OVER (PARTITION BY k.method, p.traj_id ORDER BY p.pos) AS gap FROM retained k JOIN points p USING (traj_id, pos)),
gs AS (SELECT method, ratio, avg(gap) AS avg_gap, avg(gap / greatest(1, n_points - 1)::DOUBLE) AS avg_gap_norm, max(gap)::DOUBLE AS max_gap FROM kg GROUP BY method, ratio),
es AS (SELECT method, ratio, avg((e = 2)::INT) AS endpoint_sanity FROM (SELECT k.method, k.ratio, traj_id, count(*) AS c, sum(is_start::INT + is_end::INT) AS e
       FROM retained k JOIN points p USING (traj_id, pos) GROUP BY ALL) WHERE c >= 2 GROUP BY method, ratio)"""


@check("i13_sed_ped", f"WITH {POINTS_SQL}, {FLAG_SQL} SELECT method, ratio, traj_id, pos, round(sed_km, 4) AS sed_km, round(ped_km, 4) AS ped_km FROM errors WHERE sed_km IS NOT NULL")
def _(spark, sf):
    e = metrics.sed_ped(points(spark, sf), retained(spark, sf)).filter("sed_km IS NOT NULL")
    return e.select("method", "ratio", "traj_id", "pos", r("sed_km", 4).alias("sed_km"), r("ped_km", 4).alias("ped_km"))


@check("i14_geometric_distortion", f"WITH {POINTS_SQL}, {FLAG_SQL}, {GLOBAL_SQL} SELECT method, ratio, removed_points, {_rounded_sql(('avg_sed_km', 'max_sed_km', 'avg_ped_km', 'max_ped_km'), 5)} FROM dist")
def _(spark, sf):
    d = metrics.geometric_distortion(metrics.sed_ped(points(spark, sf), retained(spark, sf)))
    return d.select("method", "ratio", "removed_points", *_rounded(("avg_sed_km", "max_sed_km", "avg_ped_km", "max_ped_km"), 5))


@check("i15_length_preservation", f"WITH {POINTS_SQL}, {FLAG_SQL}, {GLOBAL_SQL} SELECT method, ratio, round(length_preservation, 6) AS length_preservation FROM lp")
def _(spark, sf):
    lengths = metrics.track_lengths(points(spark, sf), retained(spark, sf))
    return metrics.length_preservation(lengths).select("method", "ratio", *_rounded(("length_preservation",)))


@check("i16_retained_gap_stats", f"WITH {POINTS_SQL}, {FLAG_SQL}, {GLOBAL_SQL} SELECT method, ratio, {_rounded_sql(('avg_gap', 'avg_gap_norm', 'max_gap'), 9)} FROM gs")
def _(spark, sf):
    return metrics.retained_gap_stats(points(spark, sf), retained(spark, sf)).select("method", "ratio", *_rounded(("avg_gap", "avg_gap_norm", "max_gap"), 9))


@check("i17_endpoint_sanity", f"WITH {POINTS_SQL}, {FLAG_SQL}, {GLOBAL_SQL} SELECT method, ratio, round(endpoint_sanity, 9) AS endpoint_sanity FROM es")
def _(spark, sf):
    return metrics.endpoint_sanity(points(spark, sf), retained(spark, sf)).select("method", "ratio", *_rounded(("endpoint_sanity",), 9))


def _unit(c):
    return f"greatest(0e0, least(1e0, {c}))"


_QU = {
    "ship_balanced_query_point_recall": "0.5e0 * point_f1 + 0.5e0 * ship_coverage", "query_balanced_point_recall": "point_f1", "query_point_mass_ratio": "point_f1",
    "query_point_distribution_stability": "least(point_f1, gap_time_coverage, gap_distance_coverage)", "query_local_interpolation_fidelity": "interpolation_fidelity",
    "query_local_turn_change_coverage": "turn_coverage", "query_local_speed_heading_coverage": "0.5e0 * turn_coverage + 0.5e0 * temporal_coverage",
    "query_local_shape_score": "shape_score", "query_local_gap_continuity": "least(gap_time_coverage, gap_distance_coverage)", "ship_f1": "ship_f1", "ship_coverage": "ship_coverage",
    "multi_point_ship_evidence": "ship_coverage", "entry_exit_f1": "entry_exit_f1", "crossing_f1": "crossing_f1", "query_boundary_evidence": "0.5e0 * entry_exit_f1 + 0.5e0 * crossing_f1",
    "endpoint_or_skeleton_sanity": "endpoint_sanity", "global_shape_guardrail_score": "1 / (1 + avg_sed_km)", "length_preservation_guardrail": "length_preservation",
}
_QU_SQL = " + ".join(f"{w}e0 * {_unit('(' + _QU[c] + ')')}" for c, w in metrics.QUERY_USEFUL_WEIGHTS.items())
EVAL_SQL = f"""{AUDIT_SQL}, {GLOBAL_SQL}, kp AS (SELECT method, ratio, count(*) AS kept_points, count(*) / (SELECT count(*) FROM points)::DOUBLE AS kept_share FROM retained GROUP BY method, ratio),
metric_row AS (SELECT *, {_weighted_sql()} AS range_usefulness, {_QU_SQL} AS query_useful FROM audit JOIN dist USING (method, ratio) JOIN lp USING (method, ratio)
  JOIN gs USING (method, ratio) JOIN es USING (method, ratio) JOIN kp USING (method, ratio))"""
_EVAL_COLS = ("range_usefulness", "query_useful", "avg_sed_km", "length_preservation", "avg_gap", "endpoint_sanity", "kept_share")


def evaluated(spark, sf):
    return shared(spark, sf, "evaluated", lambda: metrics.evaluate(points(spark, sf), retained(spark, sf), boxes(spark)))


@check("i12b_i18_i22_evaluate", f"WITH {EVAL_SQL} SELECT method, ratio, kept_points, removed_points, {_rounded_sql(_EVAL_COLS, 5)} FROM metric_row")
def _(spark, sf):
    e = metrics.evaluate(points(spark, sf), retained(spark, sf), boxes(spark))
    return e.select("method", "ratio", "kept_points", "removed_points", *_rounded(_EVAL_COLS, 5))


@check("i19_comparison_table", f"""WITH {EVAL_SQL}, long AS (UNPIVOT (SELECT method, 0.2e0 AS ratio, range_usefulness, point_f1, avg_sed_km FROM metric_row) ON range_usefulness, point_f1, avg_sed_km INTO NAME metric VALUE value)
   SELECT a.method, a.metric, round(a.value, 5) AS value, round(a.value - b.value, 5) AS diff, round((a.value - b.value) / abs(b.value) * 100, 3) AS diff_pct
   FROM long a JOIN long b ON b.metric = a.metric AND b.method = 'uniform'""")
def _(spark, sf):
    e = evaluated(spark, sf).withColumn("ratio", F.lit(0.2))
    t = metrics.comparison_table(e, ["range_usefulness", "point_f1", "avg_sed_km"], "uniform")
    return t.select("method", "metric", r("value", 5).alias("value"), r("diff", 5).alias("diff"), r("diff_pct", 3).alias("diff_pct"))


@check("i19_wide_table", f"""WITH {EVAL_SQL} SELECT ratio, coalesce(round(any_value(range_usefulness) FILTER (method = 'uniform'), 5), -1) AS uniform,
   coalesce(round(any_value(range_usefulness) FILTER (method = 'thirds'), 5), -1) AS thirds FROM metric_row GROUP BY ratio""")
def _(spark, sf):
    w = metrics.wide_table(evaluated(spark, sf), "range_usefulness", ["uniform", "thirds"])
    return w.select("ratio", *[F.coalesce(r(c, 5), F.lit(-1.0)).alias(c) for c in ("uniform", "thirds")])


@check("i20_shift_table", f"""WITH {AUDIT_SQL} SELECT method AS train_workload, {', '.join(f"round(any_value(point_f1) FILTER (query_id = {q}), 9) AS q{q}" for q in range(3))} FROM query_scores GROUP BY method""")
def _(spark, sf):
    s = scores(spark, sf).select(F.col("method").alias("train_workload"), F.concat(F.lit("q"), F.col("query_id").cast("string")).alias("eval_workload"), "point_f1")
    return metrics.shift_table(s, "point_f1", ["q0", "q1", "q2"]).select("train_workload", *_rounded(("q0", "q1", "q2"), 9))


@check("i21_length_loss", f"""WITH {POINTS_SQL}, {FLAG_SQL}, {GLOBAL_SQL} SELECT method, traj_id, mmsi, n_points, kept_points, n_points - kept_points AS removed_points, round(length_km, 4) AS length_km,
   round(kept_km, 4) AS kept_km, round(length_km - kept_km, 4) AS loss_km, round((length_km - kept_km) / length_km * 100, 4) AS loss_pct FROM lens WHERE length_km >= 1""")
def _(spark, sf):
    loss = metrics.length_loss(metrics.track_lengths(points(spark, sf), retained(spark, sf)))
    return loss.select("method", "traj_id", "mmsi", "n_points", "kept_points", "removed_points", *_rounded(("length_km", "kept_km", "loss_km", "loss_pct"), 4))


@check("i21_most_distorted", f"""WITH {POINTS_SQL}, {FLAG_SQL}, {GLOBAL_SQL} SELECT traj_id, round((length_km - kept_km) / length_km * 100, 4) AS loss_pct FROM lens WHERE length_km >= 1 AND method = 'uniform'
   ORDER BY (length_km - kept_km) / length_km DESC, traj_id LIMIT 25""")
def _(spark, sf):
    loss = metrics.length_loss(metrics.track_lengths(points(spark, sf), retained(spark, sf).filter("method = 'uniform'")))
    return metrics.most_distorted(loss).select("traj_id", r("loss_pct", 4).alias("loss_pct"))


@check("i23_fill_summary", f"""WITH {EVAL_SQL} SELECT a.method, b.method AS control, round(a.range_usefulness - b.range_usefulness, 5) AS delta FROM metric_row a JOIN metric_row b ON a.method = 'thirds' AND b.method = 'uniform'""")
def _(spark, sf):
    s = metrics.fill_summary(evaluated(spark, sf).withColumn("ratio", F.lit(0.2)), "range_usefulness", ["thirds"], ["uniform"])
    return s.select("method", "control", r("delta", 5).alias("delta"))
