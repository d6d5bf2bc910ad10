"""Labels and training targets."""

from __future__ import annotations

from pyspark.sql import functions as F

from tracklake.operators import diagnostics, labels, metrics, ranges

from .fixtures import HITS_SQL, POINTS_SQL, boxes, points, shared
from .metrics import _rounded, _rounded_sql, crossings, support
from .registry import check
from .simplify import base_sql, global_sql, k_sql, spaced_sql
from .tracks import SUPPORT_SQL, r

COMP = list(labels.COMPONENTS)
RATIOS = [0.1, 0.3, 0.5]

_POINT_SQL = """pl AS (SELECT traj_id, pos, least(1e0, sum(2e0 / (n + 1)) / 6) AS label FROM (SELECT *, count(*) OVER (PARTITION BY query_id) AS n FROM hits) GROUP BY traj_id, pos)"""


@check("j1_point_f1_labels", f"WITH {HITS_SQL}, {_POINT_SQL} SELECT traj_id, pos, round(label, 10) AS label FROM pl")
def _(spark, sf):
    return labels.point_f1_labels(points(spark, sf), boxes(spark)).select("traj_id", "pos", r("label", 10).alias("label"))


@check("j1_boundary_prior", f"""WITH {SUPPORT_SQL}, n AS (SELECT *, count(*) OVER (PARTITION BY query_id) AS n, count(*) FILTER (is_boundary) OVER (PARTITION BY query_id) AS b FROM edge)
   SELECT traj_id, pos, round(least(1e0, sum(2e0 / (n + 1) * (1 + 2e0 * is_boundary::INT) / ((n + 2e0 * b) / n)) / 6), 10) AS label FROM n GROUP BY traj_id, pos""")
def _(spark, sf):
    return labels.point_f1_labels(points(spark, sf), boxes(spark), 2.0).select("traj_id", "pos", r("label", 10).alias("label"))


_DEG = "sqrt(({b}lat - {a}lat) * ({b}lat - {a}lat) + ({b}lon - {a}lon) * ({b}lon - {a}lon))"
_W = metrics.USEFULNESS_WEIGHTS


def _comp_sql(balanced: bool):
    if balanced:
        point = f"{_W['point_f1']}e0 / v * 2e0 / (n + 1)"
        edge = f"CASE WHEN is_boundary THEN {_W['entry_exit_f1']}e0 / vb * 2e0 / (bv + 1) ELSE 0 END"
        cross = f"{_W['crossing_f1']}e0 / (SELECT count(DISTINCT traj_id) FROM brackets b2 WHERE b2.query_id = b.query_id) * 2e0 / (count(*) OVER (PARTITION BY query_id, traj_id) + 1)"
    else:
        point = f"{_W['point_f1']}e0 * 2e0 / (h + 1)"
        edge = f"CASE WHEN is_boundary THEN {_W['entry_exit_f1']}e0 * 2e0 / (b + 1) ELSE 0 END"
        cross = f"{_W['crossing_f1']}e0 * 2e0 / (count(*) OVER (PARTITION BY query_id) + 1)"
    return f"""{SUPPORT_SQL},
s0 AS (SELECT h.query_id, h.traj_id, h.pos, h.lat, h.lon, h.turn_score, e.is_boundary, lag(h.lat) OVER w AS p_lat, lag(h.lon) OVER w AS p_lon, lead(h.lat) OVER w AS n_lat, lead(h.lon) OVER w AS n_lon,
   row_number() OVER w - 1 AS i, count(*) OVER (PARTITION BY h.query_id, h.traj_id) AS n FROM hits h JOIN edge e USING (query_id, traj_id, pos) WINDOW w AS (PARTITION BY h.query_id, h.traj_id ORDER BY h.pos)),
s1 AS (SELECT *, CASE WHEN p_lat IS NOT NULL AND n_lat IS NOT NULL THEN greatest(0e0, {_DEG.format(a='p_', b='')} + {_DEG.format(a='', b='n_')} - {_DEG.format(a='p_', b='n_')}) ELSE 0e0 END AS curve,
   CASE WHEN n >= 3 THEN 1 + least(i / (n - 1)::DOUBLE, 1 - i / (n - 1)::DOUBLE) / (((n - 1) // 2) / (n - 1)::DOUBLE) ELSE 1e0 END AS gw FROM s0),
s2 AS (SELECT *, greatest(curve, turn_score) AS tw, sum(gw) OVER v AS gall, sum(curve) OVER v / greatest(n - 2, 1) AS mc, sum(turn_score) OVER v AS tsall,
   count(*) FILTER (is_boundary) OVER v AS bv FROM s1 WINDOW v AS (PARTITION BY query_id, traj_id)),
s3 AS (SELECT *, sum(tw) OVER (PARTITION BY query_id, traj_id) AS tall, 1 + CASE WHEN n >= 3 AND mc > 1e-12 AND i > 0 AND i < n - 1 THEN curve / mc ELSE 0 END + turn_score AS sw,
   n + CASE WHEN n >= 3 AND mc > 1e-12 THEN n - 2 ELSE 0 END + tsall AS sall, count(*) OVER q AS h, count(*) FILTER (is_boundary) OVER q AS b FROM s2 WINDOW q AS (PARTITION BY query_id)),
s4 AS (SELECT *, (SELECT count(DISTINCT traj_id) FROM hits x WHERE x.query_id = s3.query_id) AS v, (SELECT count(DISTINCT traj_id) FROM edge x WHERE x.query_id = s3.query_id AND x.is_boundary) AS vb FROM s3),
parts AS (SELECT traj_id, pos, {point} AS point_f1, {_W['ship_f1']}e0 * 2e0 / (v + 1) / n AS ship_f1, {_W['ship_coverage']}e0 / v * 2e0 / (n + 1) AS ship_coverage, {edge} AS entry_exit_f1, 0e0 AS crossing_f1,
   {_W['temporal_coverage']}e0 / v * 0.5e0 * ((i = 0)::INT + (i = n - 1)::INT) AS temporal_coverage, {_W['gap_coverage']}e0 / v * gw / gall AS gap_coverage,
   CASE WHEN tall > 1e-12 THEN {_W['turn_coverage']}e0 / v * tw / tall ELSE 0 END AS turn_coverage, {_W['shape_score']}e0 * 2e0 / (v + 1) * sw / sall AS shape_score FROM s4
   UNION ALL SELECT traj_id, pos, 0, 0, 0, 0, {cross}, 0, 0, 0, 0 FROM brackets b),
comp AS (SELECT traj_id, pos, {', '.join(f'sum({k}) / 6 AS {k}' for k in COMP)} FROM parts GROUP BY traj_id, pos)"""


def components(spark, sf):
    return shared(spark, sf, "components", lambda: labels.usefulness_components(
        points(spark, sf), boxes(spark), support=support(spark, sf), crossings=crossings(spark, sf)))


_SUM = " + ".join(COMP)


@check("j2_usefulness_components", f"WITH {_comp_sql(False)} SELECT traj_id, pos, {_rounded_sql(COMP, 9)}, round(least(1e0, {_SUM}), 9) AS label FROM comp")
def _(spark, sf):
    return components(spark, sf).select("traj_id", "pos", *_rounded([*COMP, "label"], 9))


@check("j3_usefulness_ship_balanced", f"WITH {_comp_sql(True)} SELECT traj_id, pos, {_rounded_sql(['point_f1', 'entry_exit_f1', 'crossing_f1'], 9)}, round(least(1e0, {_SUM}), 9) AS label FROM comp")
def _(spark, sf):
    parts = labels.usefulness_components(points(spark, sf), boxes(spark), True, support=support(spark, sf), crossings=crossings(spark, sf))
    return parts.select("traj_id", "pos", *_rounded(["point_f1", "entry_exit_f1", "crossing_f1", "label"], 9))


@check("j4_balance_component_mass", f"""WITH {_comp_sql(False)}, m AS (SELECT {', '.join(f'sum({k}) AS {k}' for k in COMP)} FROM comp)
   SELECT traj_id, pos, round(least(1e0, {' + '.join(f'c.{k} * (({" + ".join("m." + x for x in COMP)}) * {w}e0 / {sum(_W.values())}e0 / m.{k})' for k, w in _W.items())}), 9) AS label FROM comp c, m""")
def _(spark, sf):
    return labels.balance_component_mass(components(spark, sf)).select("traj_id", "pos", r("label").alias("label"))


@check("j5_labels_by_mode", f"WITH {_comp_sql(False)} SELECT traj_id, pos, round(least(1e0, {_SUM}), 9) AS label FROM comp")
def _(spark, sf):
    return labels.labels(points(spark, sf), boxes(spark), "usefulness").select("traj_id", "pos", r("label").alias("label"))


_BEH_SQL = """b0 AS (SELECT *, greatest(coalesce(least(abs(heading - lag(heading) OVER w), 360e0 - abs(heading - lag(heading) OVER w)) / 180e0, 0), coalesce(least(abs(heading - lead(heading) OVER w), 360e0 - abs(heading - lead(heading) OVER w)) / 180e0, 0)) AS ang,
   greatest(coalesce(abs(speed - lag(speed) OVER w), 0), coalesce(abs(speed - lead(speed) OVER w), 0)) AS dv FROM points WINDOW w AS (PARTITION BY traj_id ORDER BY pos)),
b1 AS (SELECT *, least(1e0, greatest(turn_score, ang, dv / max(dv) OVER ())) AS w FROM b0),
b2 AS (SELECT *, max(w) OVER (PARTITION BY traj_id) AS hi, min(w) OVER (PARTITION BY traj_id) AS lo, quantile_cont(w, 0.7) OVER (PARTITION BY traj_id) AS q FROM b1),
beh AS (SELECT *, CASE WHEN hi - lo > 1e-6 THEN least(1e0, greatest(0e0, (w - q) / greatest(hi - q, 1e-6))) ELSE 0e0 END AS behavior FROM b2)"""


@check("j6b_behavior_change", f"WITH {POINTS_SQL}, {_BEH_SQL} SELECT traj_id, pos, round(behavior, 8) AS behavior FROM beh")
def _(spark, sf):
    return labels.behavior_change(points(spark, sf)).select("traj_id", "pos", r("behavior", 8).alias("behavior"))


TARGET_SQL = f"""{SUPPORT_SQL}, {_BEH_SQL},
hv AS (SELECT h.query_id, h.traj_id, h.pos, e.is_boundary, b.behavior FROM hits h JOIN edge e USING (query_id, traj_id, pos) JOIN beh b ON b.traj_id = h.traj_id AND b.pos = h.pos),
val AS (SELECT coalesce(h.query_id, c.query_id) AS query_id, coalesce(h.traj_id, c.traj_id) AS traj_id, coalesce(h.pos, c.pos) AS pos, h.query_id IS NOT NULL AS inside, coalesce(h.is_boundary, false) AS edge, c.query_id IS NOT NULL AS crossed, coalesce(h.behavior, 0) AS behavior
  FROM hv h FULL JOIN (SELECT * FROM brackets WHERE query_id IN (SELECT query_id FROM hits)) c ON c.query_id = h.query_id AND c.traj_id = h.traj_id AND c.pos = h.pos),
vv AS (SELECT *, inside::INT * (0.5e0 + 0.35e0 * behavior) + 0.4e0 * edge::INT + 0.3e0 * crossed::INT AS value, pos - row_number() OVER (PARTITION BY query_id, traj_id ORDER BY pos) AS run FROM val),
rr AS (SELECT *, row_number() OVER (PARTITION BY query_id, traj_id, run ORDER BY round(value, 12) DESC, pos) AS rn, count(*) OVER (PARTITION BY query_id, traj_id, run) AS len FROM vv),
tg AS (SELECT traj_id, pos, least(1e0, count(*) FILTER (inside) / 6e0) AS hit_probability, coalesce(sum(behavior) FILTER (inside) / nullif(count(*) FILTER (inside), 0), 0e0) AS behavior,
   power(least(1e0, sum(edge::INT + crossed::INT) / 6e0), 2) AS boundary, least(1e0, coalesce(sum(value) FILTER (rn <= greatest(1, ceil(0.5e0 * len))), 0) / 6e0) AS replacement FROM rr GROUP BY traj_id, pos),
targets AS (SELECT *, least(1e0, hit_probability * replacement * (0.5e0 + behavior) + 0.25e0 * boundary) AS label FROM tg)"""

_T4 = ["hit_probability", "behavior", "boundary", "replacement", "label"]


def targets(spark, sf):
    return shared(spark, sf, "targets", lambda: labels.query_useful_targets(points(spark, sf), boxes(spark), crossings(spark, sf)))


def dense_targets(spark, sf):
    def make():
        sparse = targets(spark, sf)
        filled = labels.block_budget_target(sparse, points(spark, sf), 8).join(sparse, ["traj_id", "pos"], "left")
        return filled.na.fill(0.0, _T4)

    return shared(spark, sf, "dense_targets", make)


@check("j6_query_useful_targets", f"WITH {TARGET_SQL} SELECT traj_id, pos, {_rounded_sql(_T4, 7)} FROM targets")
def _(spark, sf):
    return labels.query_useful_targets(points(spark, sf), boxes(spark)).select("traj_id", "pos", *_rounded(_T4, 7))


@check("j6_block_budget_target", f"""WITH {TARGET_SQL}, m AS (SELECT traj_id, pos // 8 AS block, sum(label) AS mass FROM targets GROUP BY ALL)
   SELECT p.traj_id, p.pos, round(coalesce(mass, 0) / (SELECT max(mass) FROM m), 7) AS block_budget FROM points p LEFT JOIN m ON m.traj_id = p.traj_id AND m.block = p.pos // 8""")
def _(spark, sf):
    return labels.block_budget_target(targets(spark, sf), points(spark, sf), 8).select("traj_id", "pos", r("block_budget", 7).alias("block_budget"))


@check("j6c_replacement_support", f"WITH {TARGET_SQL} SELECT query_id, traj_id, pos FROM rr WHERE inside AND rn <= greatest(1, ceil(0.5e0 * len)) AND NOT crossed AND query_id < 0 UNION ALL SELECT query_id, traj_id, pos FROM (SELECT query_id, traj_id, pos, row_number() OVER (PARTITION BY query_id, traj_id, run ORDER BY sp DESC, pos) AS k, count(*) OVER (PARTITION BY query_id, traj_id, run) AS len FROM (SELECT query_id, traj_id, pos, speed AS sp, pos - row_number() OVER (PARTITION BY query_id, traj_id ORDER BY pos) AS run FROM hits WHERE speed > 0)) WHERE k <= greatest(1, ceil(0.5e0 * len))")
def _(spark, sf):
    v = ranges.query_hits(points(spark, sf), boxes(spark)).filter("speed > 0").select("query_id", "traj_id", "pos", F.col("speed").alias("value"))
    return labels.replacement_support(v).select("query_id", "traj_id", "pos")


@check("j7_target_diagnostics", f"""WITH {TARGET_SQL}, d AS (SELECT p.traj_id, p.pos, p.pos / (n_points - 1)::DOUBLE AS place, coalesce(hit_probability, 0e0) AS hit_probability, coalesce(boundary, 0e0) AS boundary FROM points p LEFT JOIN targets t ON t.traj_id = p.traj_id AND t.pos = p.pos),
   l AS (UNPIVOT d ON hit_probability, boundary INTO NAME target VALUE value), e AS (SELECT *, least(1 - 1e-6, greatest(1e-6, value)) AS q FROM l)
   SELECT target, count(*) AS points, count(*) FILTER (value > 0) AS positive, round(sum(value), 6) AS mass, round(avg(-(q * log2(q) + (1 - q) * log2(1 - q))), 6) AS entropy, round(avg((value > 0.05)::INT), 9) AS support_05,
   round(sum(value) FILTER (place <= 0.2) / sum(value), 6) AS mass_start, round(sum(value) FILTER (place > 0.2 AND place < 0.8) / sum(value), 6) AS mass_middle, round(sum(value) FILTER (place >= 0.8) / sum(value), 6) AS mass_end FROM e GROUP BY target""")
def _(spark, sf):
    d = labels.target_diagnostics(dense_targets(spark, sf), points(spark, sf), ("hit_probability", "boundary"))
    return d.select("target", "points", "positive", r("support_05").alias("support_05"), *_rounded(["mass", "entropy", "mass_start", "mass_middle", "mass_end"], 6))


@check("j7_topk_mass", f"""WITH {HITS_SQL}, {_POINT_SQL}, d AS (SELECT p.traj_id, p.pos, coalesce(round(label, 10), 0) AS label FROM points p LEFT JOIN pl ON pl.traj_id = p.traj_id AND pl.pos = p.pos),
   o AS (SELECT label, row_number() OVER (ORDER BY label DESC, traj_id, pos) AS rn, count(*) OVER () AS n, sum(label) OVER () AS m FROM d)
   SELECT ratio, round(sum(label) FILTER (rn <= greatest(1, ceil(ratio * n))) / any_value(m), 8) AS share FROM o, (VALUES (0.01e0), (0.05e0)) AS x(ratio) GROUP BY ratio""")
def _(spark, sf):
    pl = labels.point_f1_labels(points(spark, sf), boxes(spark)).withColumn("label", r("label", 10))
    dense = points(spark, sf).select("traj_id", "pos").join(pl, ["traj_id", "pos"], "left").na.fill(0.0, ["label"])
    return labels.topk_mass(dense, "label", (0.01, 0.05)).withColumn("share", r("share", 8))


def _sets(spark, sf):
    pl = labels.point_f1_labels(points(spark, sf), boxes(spark))
    beh = labels.behavior_change(points(spark, sf)).select("traj_id", "pos", F.col("behavior").alias("label"))
    return pl.withColumn("workload_id", F.lit("a")).unionByName(beh.withColumn("workload_id", F.lit("b")))


for _how, _agg in (("mean", "(coalesce(pl.label, 0) + b.behavior) / 2"), ("max", "greatest(coalesce(pl.label, 0), b.behavior)")):

    @check(f"j8_aggregate_label_sets_{_how}", f"WITH {HITS_SQL}, {_POINT_SQL}, {_BEH_SQL} SELECT b.traj_id, b.pos, round({_agg}, 8) AS label FROM beh b LEFT JOIN pl ON pl.traj_id = b.traj_id AND pl.pos = b.pos")
    def _(spark, sf, how=_how):
        return labels.aggregate_label_sets(_sets(spark, sf), how).select("traj_id", "pos", r("label", 8).alias("label"))


@check("j9_trajectory_unit_mass", f"WITH {HITS_SQL}, {_POINT_SQL} SELECT traj_id, pos, round(label / sum(label) OVER (PARTITION BY traj_id), 8) AS label FROM pl")
def _(spark, sf):
    return labels.trajectory_unit_mass(labels.point_f1_labels(points(spark, sf), boxes(spark))).select("traj_id", "pos", r("label", 8).alias("label"))


def _speed(spark, sf):
    return points(spark, sf).select("traj_id", "pos", F.col("speed").alias("label"))


_SPEED_SQL = POINTS_SQL + ", scored AS (SELECT *, speed AS score FROM points)"


def _freq_sql(fraction=0.5, ratios=RATIOS, src="scored"):
    parts = []
    for j, x in enumerate(ratios):
        k, b = k_sql(x), base_sql(x, fraction) if fraction else "0"
        parts.append(spaced_sql(src, f"base{j}", b))
        parts.append(f"""r{j} AS (SELECT s.traj_id, s.pos, s.score, row_number() OVER (PARTITION BY s.traj_id ORDER BY (b.pos IS NOT NULL) DESC, score DESC, s.pos) <= {k} AS kept
          FROM {src} s LEFT JOIN base{j} b ON b.traj_id = s.traj_id AND b.pos = s.pos)""")
    total = " + ".join(f"r{j}.kept::INT / {len(ratios)}e0" for j in range(len(ratios)))
    joins = "".join(f" JOIN r{j} USING (traj_id, pos)" for j in range(1, len(ratios)))
    parts.append(f"freq AS (SELECT traj_id, pos, {total} AS label FROM r0{joins} WHERE r0.score > 0)")
    return ", ".join(parts)


@check("j10_retained_frequency", f"WITH {_SPEED_SQL}, {_freq_sql()} SELECT traj_id, pos, round(label, 9) AS label FROM freq")
def _(spark, sf):
    return labels.retained_frequency(points(spark, sf), _speed(spark, sf), RATIOS).select("traj_id", "pos", r("label").alias("label"))


@check("j11_global_retained_frequency", f"""WITH {_SPEED_SQL}, g1 AS (WITH {global_sql('least(2, n_points)', 0.1)}), g2 AS (WITH {global_sql('least(2, n_points)', 0.3)}), g3 AS (WITH {global_sql('least(2, n_points)', 0.5)})
   SELECT s.traj_id, s.pos, round(((g1.pos IS NOT NULL)::INT + (g2.pos IS NOT NULL)::INT + (g3.pos IS NOT NULL)::INT) / 3e0, 9) AS label FROM scored s LEFT JOIN g1 ON g1.traj_id = s.traj_id AND g1.pos = s.pos
   LEFT JOIN g2 ON g2.traj_id = s.traj_id AND g2.pos = s.pos LEFT JOIN g3 ON g3.traj_id = s.traj_id AND g3.pos = s.pos WHERE score > 0""")
def _(spark, sf):
    return labels.global_retained_frequency(points(spark, sf), _speed(spark, sf), RATIOS).select("traj_id", "pos", r("label").alias("label"))


_EVEN_SQL = ", ".join(spaced_sql("points", f"e{j}", k_sql(x)) for j, x in enumerate(RATIOS)) + """,
even AS (SELECT p.traj_id, p.pos, ((e0.pos IS NOT NULL)::INT + (e1.pos IS NOT NULL)::INT + (e2.pos IS NOT NULL)::INT) / 3e0 AS label FROM points p LEFT JOIN e0 ON e0.traj_id = p.traj_id AND e0.pos = p.pos
 LEFT JOIN e1 ON e1.traj_id = p.traj_id AND e1.pos = p.pos LEFT JOIN e2 ON e2.traj_id = p.traj_id AND e2.pos = p.pos)"""


@check("j12_temporal_frequency", f"WITH {POINTS_SQL}, {_EVEN_SQL} SELECT traj_id, pos, round(label, 9) AS label FROM even")
def _(spark, sf):
    return labels.temporal_frequency(points(spark, sf), RATIOS).select("traj_id", "pos", r("label").alias("label"))


@check("j12_temporal_blend", f"WITH {HITS_SQL}, {_POINT_SQL}, {_EVEN_SQL} SELECT e.traj_id, e.pos, round(0.75e0 * coalesce(pl.label, 0) + 0.25e0 * e.label, 9) AS label FROM even e LEFT JOIN pl ON pl.traj_id = e.traj_id AND pl.pos = e.pos")
def _(spark, sf):
    pl = labels.point_f1_labels(points(spark, sf), boxes(spark))
    return labels.temporal_blend(points(spark, sf), pl, 0.25, RATIOS).select("traj_id", "pos", r("label").alias("label"))


_STRUCT_SQL = """u0 AS (SELECT *, (lat - min(lat) OVER v) / greatest(1e-6, max(lat) OVER v - min(lat) OVER v) AS y, (lon - min(lon) OVER v) / greatest(1e-6, max(lon) OVER v - min(lon) OVER v) AS x FROM points WINDOW v AS (PARTITION BY traj_id)),
u1 AS (SELECT *, sqrt(power(y - (lag(y) OVER w + lead(y) OVER w) * 0.5e0, 2) + power(x - (lag(x) OVER w + lead(x) OVER w) * 0.5e0, 2)) AS off, greatest(coalesce(t - lag(t) OVER w, 0), coalesce(lead(t) OVER w - t, 0)) AS gap FROM u0 WINDOW w AS (PARTITION BY traj_id ORDER BY pos)),
u2 AS (SELECT *, coalesce(off, CASE WHEN max(off) OVER v > 0 THEN max(off) OVER v ELSE 1 END) AS uq, sqrt(power(y - avg(y) OVER v, 2) + power(x - avg(x) OVER v, 2)) AS dist FROM u1 WINDOW v AS (PARTITION BY traj_id)),
u3 AS (SELECT *, min(uq) OVER v AS ua, max(uq) OVER v AS ub, min(turn_score) OVER v AS ta, max(turn_score) OVER v AS tb, min(gap) OVER v AS ga, max(gap) OVER v AS gb, min(dist) OVER v AS da, max(dist) OVER v AS db FROM u2 WINDOW v AS (PARTITION BY traj_id)),
structural AS (SELECT traj_id, pos, least(1e0, 0.4e0 * CASE WHEN ub - ua > 1e-12 THEN (uq - ua) / (ub - ua) ELSE 0 END + 0.2e0 * CASE WHEN tb - ta > 1e-12 THEN (turn_score - ta) / (tb - ta) ELSE 0 END + 0.15e0 * CASE WHEN gb - ga > 1e-12 THEN (gap - ga) / (gb - ga) ELSE 0 END
  + 0.15e0 * (1 - CASE WHEN db - da > 1e-12 THEN (dist - da) / (db - da) ELSE 0 END) + 0.1e0 * (is_start OR is_end)::INT) AS label FROM u3)"""


@check("j13_structural_scores", f"WITH {POINTS_SQL}, {_STRUCT_SQL} SELECT traj_id, pos, round(label, 6) AS label FROM structural")
def _(spark, sf):
    return labels.structural_scores(points(spark, sf)).select("traj_id", "pos", r("label", 6).alias("label"))


@check("j13_structural_frequency")
def _(spark, sf):
    pl = labels.point_f1_labels(points(spark, sf), boxes(spark))
    return labels.structural_frequency(points(spark, sf), pl, RATIOS)


@check("j14_marginal_coverage")
def _(spark, sf):
    return labels.marginal_coverage(points(spark, sf), _speed(spark, sf), 0.3)


_CW = {"temporal_coverage": 0.22, "turn_coverage": 0.08}


@check("j15_component_frequency", f"""WITH {POINTS_SQL}, comp AS (SELECT traj_id, pos, n_points, speed AS ca, turn_score AS cb FROM points),
   sa AS (SELECT *, ca AS score FROM comp), sb AS (SELECT *, cb AS score FROM comp), fa AS (WITH {_freq_sql(ratios=RATIOS, src='sa')} SELECT * FROM freq), fb AS (WITH {_freq_sql(ratios=RATIOS, src='sb')} SELECT * FROM freq)
   SELECT coalesce(fa.traj_id, fb.traj_id) AS traj_id, coalesce(fa.pos, fb.pos) AS pos, round(coalesce(fa.label, 0) * 0.6e0 + coalesce(fb.label, 0) * 0.4e0, 9) AS label FROM fa FULL JOIN fb ON fa.traj_id = fb.traj_id AND fa.pos = fb.pos""")
def _(spark, sf):
    comp = points(spark, sf).select("traj_id", "pos", F.col("speed").alias("ca"), F.col("turn_score").alias("cb"))
    return labels.component_frequency(points(spark, sf), comp, RATIOS, {"ca": 0.3, "cb": 0.2}).select("traj_id", "pos", r("label").alias("label"))


_CONT = labels.CONTINUITY_WEIGHTS
_CONT_PARTS = ", ".join(
    f"""s_{c} AS (SELECT p.traj_id, p.pos, p.n_points, coalesce(round(c.{c}, 9), 0) AS score FROM points p LEFT JOIN comp c ON c.traj_id = p.traj_id AND c.pos = p.pos),
    f_{c} AS (WITH {_freq_sql(ratios=RATIOS, src=f's_{c}')} SELECT traj_id, pos, label * {w}e0 / {sum(_CONT.values())}e0 AS label FROM freq)"""
    for c, w in _CONT.items()
)


@check("j15_continuity_frequency", f"""WITH {_comp_sql(False)}, {_CONT_PARTS}, every AS ({' UNION ALL '.join(f'SELECT * FROM f_{c}' for c in _CONT)})
   SELECT traj_id, pos, round(least(1e0, sum(label)), 9) AS label FROM every GROUP BY traj_id, pos""")
def _(spark, sf):
    rounded = components(spark, sf).withColumns({c: r(c) for c in _CONT})  # equal values stay equal on both sides
    return labels.continuity_frequency(points(spark, sf), rounded, RATIOS).select("traj_id", "pos", r("label").alias("label"))


@check("j16_query_spine", f"""WITH {HITS_SQL}, g AS (SELECT *, row_number() OVER w - 1 AS i, count(*) OVER v AS n, max(turn_score) OVER v AS mt, row_number() OVER (PARTITION BY query_id, traj_id ORDER BY turn_score DESC, pos) AS tr
     FROM hits WINDOW w AS (PARTITION BY query_id, traj_id ORDER BY pos), v AS (PARTITION BY query_id, traj_id)),
   k AS (SELECT *, CASE WHEN n >= 2 THEN greatest(2, least(n, CAST(ceil(0.3e0 * n) AS BIGINT))) ELSE 1 END AS k FROM g),
   grid AS (SELECT DISTINCT query_id, traj_id, CAST(CASE WHEN k = 1 THEN 0 ELSE round_even(j * (n - 1) / (k - 1)::DOUBLE, 0) END AS BIGINT) AS i FROM k, range(200) AS x(j) WHERE j < k),
   chosen AS (SELECT k.query_id, k.traj_id, k.pos FROM k LEFT JOIN grid ON grid.query_id = k.query_id AND grid.traj_id = k.traj_id AND grid.i = k.i
     WHERE grid.i IS NOT NULL OR (n >= 3 AND mt > 0 AND tr <= least(n, greatest(1, ceil(0.25e0 * k))))),
   m AS (SELECT *, 1e0 / count(*) OVER (PARTITION BY query_id, traj_id) AS v FROM chosen)
   SELECT traj_id, pos, round(sum(v) / 6, 9) AS label FROM m GROUP BY traj_id, pos""")
def _(spark, sf):
    return labels.query_spine(points(spark, sf), boxes(spark), 0.3).select("traj_id", "pos", r("label").alias("label"))


def _residual_sql(ratio):
    tag = str(ratio).replace(".", "")
    keep = f"CASE WHEN n >= 2 THEN greatest(2, least(n, CAST(ceil({ratio}e0 * n) AS BIGINT))) ELSE 1 END"
    return f"""{spaced_sql('points', f'rb{tag}', base_sql(ratio, 0.5))},
   ra{tag} AS (SELECT h.query_id, h.traj_id, h.pos, h.turn_score, b.pos IS NOT NULL AS base, row_number() OVER w - 1 AS i, count(*) OVER v AS n, count(b.pos) OVER v AS kept, max(turn_score) OVER v AS mt,
      row_number() OVER (PARTITION BY h.query_id, h.traj_id ORDER BY turn_score DESC, h.pos) AS tr FROM hits h LEFT JOIN rb{tag} b ON b.traj_id = h.traj_id AND b.pos = h.pos
      WINDOW w AS (PARTITION BY h.query_id, h.traj_id ORDER BY h.pos), v AS (PARTITION BY h.query_id, h.traj_id)),
   rc{tag} AS (SELECT *, {keep} AS k, coalesce(max(CASE WHEN base THEN i END) OVER (PARTITION BY query_id, traj_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), -1) AS lo,
      coalesce(min(CASE WHEN base THEN i END) OVER (PARTITION BY query_id, traj_id ORDER BY pos ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), n) AS hi FROM ra{tag}),
   rg{tag} AS (SELECT DISTINCT query_id, traj_id, CAST(CASE WHEN k = 1 THEN 0 ELSE round_even(j * (n - 1) / (k - 1)::DOUBLE, 0) END AS BIGINT) AS i FROM rc{tag}, range(200) AS x(j) WHERE j < k),
   rd{tag} AS (SELECT c.*, CASE WHEN c.i = 0 OR c.i = n - 1 THEN 1 WHEN c.i = CASE WHEN kept > 0 THEN (lo + hi) // 2 ELSE n // 2 END THEN 2
      WHEN n >= 3 AND mt > 0 AND tr <= least(n, greatest(1, ceil(0.25e0 * k))) THEN 3 WHEN g.i IS NOT NULL THEN 4 ELSE 5 END AS tier FROM rc{tag} c LEFT JOIN rg{tag} g ON g.query_id = c.query_id AND g.traj_id = c.traj_id AND g.i = c.i),
   re{tag} AS (SELECT *, row_number() OVER (PARTITION BY query_id, traj_id ORDER BY tier, CASE WHEN tier = 2 THEN -(hi - lo - 1) ELSE i END, lo, pos) AS rn FROM rd{tag} WHERE NOT base),
   rf{tag} AS (SELECT traj_id, pos, 1e0 / count(*) OVER (PARTITION BY query_id) AS v FROM re{tag} WHERE rn <= k - kept)"""


@check("j17_query_residual", f"""WITH {HITS_SQL}, {_residual_sql(0.3)}, {_residual_sql(0.5)}
   SELECT traj_id, pos, round(sum(v) / 12, 10) AS label FROM (SELECT * FROM rf03 UNION ALL SELECT * FROM rf05) GROUP BY traj_id, pos""")
def _(spark, sf):
    return labels.query_residual(points(spark, sf), boxes(spark), [0.3, 0.5]).select("traj_id", "pos", r("label", 10).alias("label"))


@check("j21_mask_temporal_base", f"WITH {HITS_SQL}, {_POINT_SQL}, {spaced_sql('points', 'base', base_sql(0.3, 0.5))} SELECT traj_id, pos, round(label, 9) AS label FROM pl ANTI JOIN base USING (traj_id, pos)")
def _(spark, sf):
    pl = labels.point_f1_labels(points(spark, sf), boxes(spark))
    return labels.mask_temporal_base(pl, points(spark, sf), 0.3, 0.5).select("traj_id", "pos", r("label").alias("label"))


@check("j22_scale_q95", f"WITH {HITS_SQL}, {_POINT_SQL} SELECT traj_id, pos, round(least(1e0, label / (SELECT quantile_cont(label, 0.95) FROM pl)), 8) AS label FROM pl")
def _(spark, sf):
    return labels.scale_q95(labels.point_f1_labels(points(spark, sf), boxes(spark))).select("traj_id", "pos", r("label", 8).alias("label"))


@check("j23_rank_labels", f"""WITH {POINTS_SQL} SELECT traj_id, pos, round((rank() OVER (PARTITION BY traj_id ORDER BY speed) - 1 + (count(*) OVER (PARTITION BY traj_id, speed) - 1) / 2e0) / greatest(1, n_points - 1)::DOUBLE, 9) AS label FROM points""")
def _(spark, sf):
    return labels.rank_labels(points(spark, sf), "speed").select("traj_id", "pos", r("label").alias("label"))


@check("j23_frequency_labels", f"WITH {_SPEED_SQL}, {_freq_sql(0.0)} SELECT traj_id, pos, round(label, 9) AS label FROM freq")
def _(spark, sf):
    return labels.frequency_labels(points(spark, sf), "speed", RATIOS, 0.0).select("traj_id", "pos", r("label").alias("label"))


@check("j25_residual_target_rows", f"""WITH {_SPEED_SQL}, {', '.join(spaced_sql('points', f'b{j}', base_sql(x, 0.5)) for j, x in enumerate(RATIOS))},
   u AS ({' UNION ALL '.join(f"SELECT {x}e0 AS ratio, s.speed, b.pos IS NOT NULL AS base FROM scored s LEFT JOIN b{j} b ON b.traj_id = s.traj_id AND b.pos = s.pos" for j, x in enumerate(RATIOS))})
   SELECT ratio, count(*) FILTER (base) AS base_points, count(*) FILTER (NOT base) AS candidate_points, count(*) FILTER (base AND speed > 0) AS base_positive, count(*) FILTER (NOT base AND speed > 0) AS residual_positive,
   round(sum(speed) FILTER (base), 6) AS base_mass, round(sum(speed) FILTER (NOT base), 6) AS residual_mass FROM u GROUP BY ratio""")
def _(spark, sf):
    rows = labels.residual_target_rows(points(spark, sf), _speed(spark, sf), RATIOS)
    return rows.withColumns({c: r(c, 6) for c in ("base_mass", "residual_mass")})


@check("g4_label_diagnostics", f"""WITH {_comp_sql(False)}, l AS (SELECT *, least(1e0, {_SUM}) AS label FROM comp)
   SELECT count(label) AS labelled, count(*) FILTER (label > 0) AS positive, round(sum(label), 7) AS mass, round(max(label), 8) AS max, round(quantile_cont(label, 0.5), 8) AS p50, round(quantile_cont(label, 0.95), 8) AS p95,
   round(sum(point_f1), 7) AS mass_point_f1, round(sum(point_f1) / sum({_SUM}), 8) AS share_point_f1 FROM l""")
def _(spark, sf):
    d = diagnostics.label_diagnostics(components(spark, sf), "label", COMP)
    return d.select("labelled", "positive", *_rounded(["mass", "mass_point_f1"], 7), *_rounded(["max", "p50", "p95", "share_point_f1"], 8))


@check("g12_signal_diagnostics")
def _(spark, sf):
    pl = labels.point_f1_labels(points(spark, sf), boxes(spark))
    return diagnostics.signal_diagnostics(points(spark, sf), boxes(spark), pl, 0.2)
