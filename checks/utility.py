"""Set and swap utilities: every change scored anew from the whole visit, in SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from tracklake.operators import utility

from .fixtures import boxes, points, shared
from .metrics import _DEG, _PED, _SED, bracket_sql
from .registry import check
from .simplify import k_sql, spaced_sql
from .tracks import SUPPORT_SQL, hav, r

RATIOS = [0.3, 0.5]
FRACTION = 0.5
_K = [k_sql(x) for x in RATIOS]
_PART = [f"least({k}, greatest(2, ceil(({k}) * 0.5e0)))" for k in _K]
_W = {k: f"{v!r}e0" for k, v in utility.USEFULNESS_WEIGHTS.items()}


def _f1(kept, full):
    return f"CASE WHEN {full} = 0 THEN 1e0 WHEN {kept} <= 0 THEN 0e0 ELSE 2 * (({kept}) / ({full})::DOUBLE) / (1 + ({kept}) / ({full})::DOUBLE) END"


def utility_sql(ks, scenarios: str) -> str:
    """Scores of the changes in the CTE ``scen`` (ratio, query_id, traj_id, add, drop) over the base of ``ks`` points."""
    return f"""{SUPPORT_SQL}, {", ".join(spaced_sql("points", f"b{i}", k) for i, k in enumerate(ks))},
base AS ({" UNION ALL ".join(f"SELECT {x}e0 AS ratio, traj_id, pos FROM b{i}" for i, x in enumerate(RATIOS))}),
sup0 AS (SELECT h.query_id, h.traj_id, h.pos, h.t, h.lat, h.lon, h.turn_score, h.n_points, e.is_boundary,
   lag(h.lat) OVER w AS p_lat, lag(h.lon) OVER w AS p_lon, lead(h.lat) OVER w AS n_lat, lead(h.lon) OVER w AS n_lon,
   row_number() OVER w - 1 AS i FROM hits h JOIN edge e USING (query_id, traj_id, pos) WINDOW w AS (PARTITION BY h.query_id, h.traj_id ORDER BY h.pos)),
sup1 AS (SELECT *, coalesce({hav('p_lat', 'p_lon', 'lat', 'lon')}, 0e0) AS step,
   CASE WHEN p_lat IS NOT NULL AND n_lat IS NOT NULL THEN greatest(0e0, {_DEG.format(a='p_', b='')} + {_DEG.format(a='', b='n_')} - {_DEG.format(a='p_', b='n_')}) ELSE 0e0 END AS curvature FROM sup0),
support AS (SELECT *, greatest(curvature, greatest(turn_score, 0)) AS turn_w, sum(step) OVER (PARTITION BY query_id, traj_id ORDER BY pos) AS cum_km FROM sup1),
hitq AS (SELECT query_id, count(*) AS hits, count(DISTINCT traj_id) AS ships FROM support GROUP BY query_id),
cand AS (SELECT c.ratio, c.query_id, c.traj_id, c.pos, s.n_points FROM (SELECT DISTINCT ratio, query_id, traj_id, pos FROM (SELECT query_id, traj_id, pos FROM support UNION SELECT query_id, traj_id, pos FROM brackets SEMI JOIN hitq USING (query_id)), (SELECT DISTINCT ratio FROM base)) c
   ANTI JOIN base USING (ratio, traj_id, pos) JOIN points s USING (traj_id, pos)),
{scenarios},
fs AS (SELECT s.ratio, s.add, s.drop, v.*, coalesce(b.pos <> s.drop, v.pos = s.add) AS kept
   FROM (SELECT * FROM scen UNION ALL SELECT DISTINCT ratio, query_id, traj_id, -1, -1 FROM support, (SELECT DISTINCT ratio FROM base)) s JOIN support v USING (query_id, traj_id) LEFT JOIN base b ON b.ratio = s.ratio AND b.traj_id = v.traj_id AND b.pos = v.pos),
{bracket_sql('fs', 'fsn', 'ratio, query_id, traj_id, add, drop', ('i',))},
g AS (SELECT ratio, query_id, traj_id, add, drop, count(*) AS n, count(*) FILTER (kept) AS r, max(t) - min(t) AS span, max(cum_km) AS km, max(t) FILTER (kept) - min(t) FILTER (kept) AS kspan,
   min(i) FILTER (kept) AS ki0, max(i) FILTER (kept) AS ki1, max(i - l_i - 1) FILTER (kept) AS im, sum(turn_w) AS w, coalesce(sum(turn_w) FILTER (kept), 0) AS kw,
   sum({_SED} + {_PED}) FILTER (NOT kept AND l_t IS NOT NULL AND r_t IS NOT NULL) AS err, count(*) FILTER (NOT kept AND l_t IS NOT NULL AND r_t IS NOT NULL) AS en,
   count(*) FILTER (kept AND is_boundary) AS eb FROM fsn GROUP BY ALL),
t0 AS (SELECT *, CASE WHEN r = 0 THEN 0e0 WHEN span <= 1e-9 THEN 1e0 WHEN r < 2 THEN 0e0 ELSE kspan / span END AS tc FROM g),
ts AS (SELECT ratio, query_id, traj_id, add, drop, r, eb, {_W['ship_coverage']} * ({_f1('r', 'n')}) + {_W['temporal_coverage']} * tc
   + {_W['gap_coverage']} * CASE WHEN r = 0 THEN 0e0 WHEN n = 1 THEN 1e0 ELSE greatest(0e0, 1 - greatest(ki0, n - 1 - ki1, coalesce(im, 0)) / greatest(1, n - 2)::DOUBLE) END
   + {_W['turn_coverage']} * CASE WHEN r = 0 THEN 0e0 WHEN w <= 1e-12 THEN 1e0 WHEN kw <= 0 THEN 0e0 ELSE 2 * (kw / w) / (1 + kw / w) END
   + {_W['shape_score']} * CASE WHEN r = 0 THEN 0e0 WHEN km <= 1e-9 THEN 1e0 WHEN r < 2 THEN 0e0 ELSE tc * CASE WHEN en = 0 THEN 1e0 ELSE 1 / (1 + err / (2 * en) / greatest(1e-6, km / greatest(1, n - 1))) END END AS v FROM t0),
q0 AS (SELECT ratio, query_id, sum(v) AS v, sum(r) AS r, count(*) FILTER (r > 0) AS s, sum(eb) AS eb FROM ts WHERE add = -1 AND drop = -1 GROUP BY ratio, query_id),
eq AS (SELECT query_id, count(*) FILTER (is_boundary) AS en FROM support GROUP BY query_id),
cq AS (SELECT x.ratio, k.query_id, count(*) AS cn, count(b.pos) AS cr FROM brackets k CROSS JOIN (SELECT DISTINCT ratio FROM base) x LEFT JOIN base b ON b.ratio = x.ratio AND b.traj_id = k.traj_id AND b.pos = k.pos GROUP BY x.ratio, k.query_id),
full0 AS (SELECT s.*, h.hits, h.ships, q0.v AS v0, q0.r AS r0, q0.s AS s0, q0.eb AS e0, eq.en, coalesce(cq.cn, 0) AS cn, coalesce(cq.cr, 0) AS c0,
   coalesce(n.v - o.v, 0) AS dv, coalesce(n.r - o.r, 0) AS dr, coalesce((n.r > 0)::INT - (o.r > 0)::INT, 0) AS ds, coalesce(n.eb - o.eb, 0) AS de,
   (ka.pos IS NOT NULL)::INT - (kd.pos IS NOT NULL)::INT AS dc
   FROM scen s JOIN hitq h USING (query_id) JOIN q0 USING (ratio, query_id) JOIN eq USING (query_id) LEFT JOIN cq USING (ratio, query_id)
   LEFT JOIN ts n ON n.ratio = s.ratio AND n.query_id = s.query_id AND n.traj_id = s.traj_id AND n.add = s.add AND n.drop = s.drop
   LEFT JOIN ts o ON o.ratio = s.ratio AND o.query_id = s.query_id AND o.traj_id = s.traj_id AND o.add = -1 AND o.drop = -1
   LEFT JOIN brackets ka ON ka.query_id = s.query_id AND ka.traj_id = s.traj_id AND ka.pos = s.add
   LEFT JOIN brackets kd ON kd.query_id = s.query_id AND kd.traj_id = s.traj_id AND kd.pos = s.drop),
changed AS (SELECT ratio, query_id, traj_id, add, drop, hits, r0, (dv / ships)
   + {_W['point_f1']} * (({_f1('r0 + dr', 'hits')}) - ({_f1('r0', 'hits')})) + {_W['ship_f1']} * (({_f1('s0 + ds', 'ships')}) - ({_f1('s0', 'ships')}))
   + {_W['entry_exit_f1']} * (({_f1('e0 + de', 'en')}) - ({_f1('e0', 'en')})) + {_W['crossing_f1']} * (({_f1('c0 + dc', 'cn')}) - ({_f1('c0', 'cn')})) AS delta FROM full0)"""


SET_SQL = utility_sql(_PART, "scen AS (SELECT ratio, query_id, traj_id, pos AS add, -1 AS drop FROM cand)") + """,
gains AS (SELECT ratio, query_id, traj_id, add AS pos, hits, r0, greatest(0e0, delta) AS gain FROM changed)"""

_SWAP_COUNT = "CASE ratio " + " ".join(f"WHEN {x}e0 THEN greatest(0, least(({k}) - ({p}), n_points - ({k}), ({k}) - 2))" for x, k, p in zip(RATIOS, _K, _PART)) + " END"
SWAP_SQL = utility_sql(
    _K,
    f"""able AS (SELECT * FROM cand WHERE {_SWAP_COUNT} > 0),
inner0 AS (SELECT b.ratio, b.traj_id, b.pos FROM base b JOIN points p USING (traj_id, pos) WHERE NOT is_start AND NOT is_end),
pairs AS (SELECT a.ratio, a.query_id, a.traj_id, a.pos AS add, arg_min(b.pos, abs(b.pos - a.pos) * 10000000 + b.pos) AS drop FROM able a JOIN inner0 b ON b.ratio = a.ratio AND b.traj_id = a.traj_id GROUP BY a.ratio, a.query_id, a.traj_id, a.pos),
scen AS (SELECT * FROM pairs UNION ALL SELECT DISTINCT ratio, query_id, traj_id, -1, drop FROM pairs)""",
) + f""",
swaps AS (SELECT a.ratio, a.query_id, a.traj_id, a.add AS pos, a.drop, a.hits, a.delta AS net, greatest(0e0, a.delta - b.delta) AS worth, greatest(0e0, -b.delta) AS cost
   FROM changed a JOIN changed b ON b.ratio = a.ratio AND b.query_id = a.query_id AND b.traj_id = a.traj_id AND b.drop = a.drop AND b.add = -1 WHERE a.add <> -1),
capacity AS (SELECT ratio, sum({_SWAP_COUNT}) AS most FROM points, (SELECT DISTINCT ratio FROM base) WHERE is_start GROUP BY ratio)"""

# labels: mean over six boxes, both ratios with equal weight
_LABEL = "round(least(1e0, sum(x) / 12e0), 9) AS label"


def _set_sql(value):
    return f"""WITH {SET_SQL}, need AS (SELECT *, least(hits, greatest(CASE WHEN hits >= 2 THEN 2 ELSE 1 END, ceil(ratio * hits))) - r0 AS missing FROM gains),
   best AS (SELECT *, row_number() OVER (PARTITION BY ratio, query_id ORDER BY round(gain, 12) DESC, traj_id, pos) AS k FROM need WHERE gain > 1e-12 AND missing > 0),
   chosen AS (SELECT *, count(*) OVER (PARTITION BY ratio, query_id) AS m FROM best WHERE k <= missing)
   SELECT traj_id, pos, {_LABEL.replace('sum(x)', f'sum({value})')} FROM chosen GROUP BY traj_id, pos"""


@check("j18_set_gains", f"WITH {SET_SQL} SELECT ratio, query_id, traj_id, pos, round(gain, 9) AS gain FROM gains")
def _(spark, sf):
    gains = utility.set_gains(points(spark, sf), boxes(spark), RATIOS, FRACTION, limit=0)
    return gains.select("ratio", "query_id", "traj_id", "pos", r("gain", 9).alias("gain"))


def _label(df):
    return df.select("traj_id", "pos", r("label", 9).alias("label"))


@check("j18_set_utility", _set_sql("gain"))
def _(spark, sf):
    return _label(utility.set_utility(points(spark, sf), boxes(spark), RATIOS, None, FRACTION, limit=0))


@check("j18_set_utility_by_query", _set_sql("1e0 / m"))
def _(spark, sf):
    return _label(utility.set_utility(points(spark, sf), boxes(spark), RATIOS, None, FRACTION, mass="query", limit=0))


@check("j18_candidates", f"""WITH {SET_SQL}, pl AS (SELECT traj_id, pos, min(turn_score) AS label FROM points GROUP BY traj_id, pos),
   n AS (SELECT *, count(*) OVER (PARTITION BY ratio, query_id) AS n, row_number() OVER (PARTITION BY ratio, query_id ORDER BY traj_id, pos) - 1 AS place,
     row_number() OVER (PARTITION BY ratio, query_id ORDER BY label DESC, traj_id, pos) AS top FROM gains JOIN pl USING (traj_id, pos)),
   spaced AS (SELECT DISTINCT ratio, query_id, round_even(k * (n - 1) / 4e0, 0)::BIGINT AS place FROM n, (SELECT unnest(range(5)) AS k) WHERE n > 10)
   SELECT ratio, query_id, traj_id, pos FROM n WHERE n <= 10 OR top <= 5 OR (ratio, query_id, place) IN (SELECT (ratio, query_id, place) FROM spaced)""")
def _(spark, sf):
    p = points(spark, sf)
    base = utility.audit(p, boxes(spark), RATIOS, lambda x: utility.base_size(utility.budget(ratio=x), FRACTION))
    return utility.candidates(base, p.select("traj_id", "pos", F.col("turn_score").alias("label")), 10)


def swaps(spark, sf):
    return shared(spark, sf, "swaps", lambda: utility.swap_gains(points(spark, sf), boxes(spark), RATIOS, FRACTION, limit=0))


@check("j19_j20_swap_gains", f"WITH {SWAP_SQL} SELECT ratio, query_id, traj_id, pos, drop, round(net, 9) AS net, round(worth, 9) AS value, round(cost, 9) AS cost FROM swaps")
def _(spark, sf):
    return swaps(spark, sf).select("ratio", "query_id", "traj_id", "pos", "drop", *[r(c, 9).alias(c) for c in ("net", "value", "cost")])


@check("j19_local_swap_utility", f"""WITH {SWAP_SQL}, best AS (SELECT *, row_number() OVER (PARTITION BY ratio, query_id ORDER BY round(net, 12) DESC, traj_id, pos) AS k FROM swaps JOIN capacity USING (ratio) WHERE net > 1e-12)
   SELECT traj_id, pos, {_LABEL.replace('sum(x)', 'sum(net)')} FROM best WHERE k <= least(most, greatest(1, ceil(ratio * hits))) GROUP BY traj_id, pos""")
def _(spark, sf):
    return _label(utility.local_swap_utility(points(spark, sf), boxes(spark), RATIOS, None, FRACTION, limit=0))


@check("j20_local_swap_gain_cost", f"""WITH {SWAP_SQL}, one AS (SELECT *, row_number() OVER (PARTITION BY ratio, query_id, traj_id, drop ORDER BY round(net, 12) DESC, pos) AS j FROM swaps WHERE net > 1e-12),
   best AS (SELECT *, row_number() OVER (PARTITION BY ratio, query_id ORDER BY round(net, 12) DESC, traj_id, pos) AS k FROM one JOIN capacity USING (ratio) WHERE j = 1),
   chosen AS (SELECT * FROM best WHERE k <= least(most, greatest(1, ceil(ratio * hits)))),
   parts AS (SELECT traj_id, pos, worth AS x FROM chosen UNION ALL SELECT traj_id, drop, cost FROM chosen WHERE cost > 0)
   SELECT traj_id, pos, {_LABEL} FROM parts GROUP BY traj_id, pos""")
def _(spark, sf):
    return _label(utility.local_swap_gain_cost(points(spark, sf), boxes(spark), RATIOS, None, FRACTION, limit=0))
