"""Selectors."""

from __future__ import annotations

from pyspark.sql import functions as F

from tracklake.functions.spacing import budget
from tracklake.operators import simplify
from tracklake.operators.ranges import query_hits

from .fixtures import HITS_SQL, POINTS_SQL, boxes, points
from .registry import check
from .tracks import r



def scored(spark, sf):
    return points(spark, sf).withColumn("score", (F.col("report_id") * 7919 % 1000) / 1000.0)


def k_sql(ratio, n="n_points"):
    return f"least({n}, greatest(2, CAST(ceil({ratio}e0 * {n}) AS BIGINT)))"


def spaced_sql(src, out, k):
    """Positions kept by even spacing, by generating them."""
    return f"""{out} AS (SELECT DISTINCT traj_id, CAST(CASE WHEN {k} >= n_points THEN i WHEN {k} = 1 THEN 0
      ELSE round_even(i * (n_points - 1) / CAST({k} - 1 AS DOUBLE), 0) END AS BIGINT) AS pos
      FROM (SELECT traj_id, n_points FROM {src} WHERE pos = 0), range(1000) AS g(i) WHERE i < {k})"""


SCORED_SQL = POINTS_SQL + """, scored AS (SELECT *, (report_id * 7919 % 1000) / 1000e0 AS score FROM points)"""


@check("h1_budget", f"WITH {POINTS_SQL} SELECT traj_id, {k_sql(0.2)} AS k20, {k_sql(0.05)} AS k05, {k_sql(0.9)} AS k90 FROM points WHERE pos = 0")
def _(spark, sf):
    p = points(spark, sf).filter("pos = 0")
    return p.select("traj_id", *[budget(ratio=x).alias(n) for x, n in ((0.2, "k20"), (0.05, "k05"), (0.9, "k90"))])


@check("h2_evenly_spaced", f"WITH {POINTS_SQL}, {spaced_sql('points', 'kept', 'least(7, n_points)')} SELECT * FROM kept")
def _(spark, sf):
    return simplify.evenly_spaced(points(spark, sf), 7)


@check("h3_simplify_uniform", f"WITH {POINTS_SQL}, {spaced_sql('points', 'kept', k_sql(0.2))} SELECT * FROM kept")
def _(spark, sf):
    return simplify.simplify_uniform(points(spark, sf), 0.2)


_RANKED_SQL = f"{SCORED_SQL}, ranked AS (SELECT *, row_number() OVER (PARTITION BY traj_id ORDER BY score DESC, pos) AS rn FROM scored)"


@check("h4_topk", f"WITH {_RANKED_SQL} SELECT traj_id, pos FROM ranked WHERE rn <= 3")
def _(spark, sf):
    return simplify.topk(scored(spark, sf), 3)


@check("h5_simplify_by_score", f"WITH {_RANKED_SQL} SELECT traj_id, pos FROM ranked WHERE rn <= {k_sql(0.2)} OR is_start OR is_end")
def _(spark, sf):
    return simplify.simplify_by_score(scored(spark, sf), 0.2)


def global_sql(base_k, ratio, score="score"):
    return f"""{spaced_sql('scored', 'base', base_k)},
    total AS (SELECT greatest(sum({k_sql(ratio)}), (SELECT count(*) FROM base)) AS b FROM scored WHERE pos = 0),
    rest AS (SELECT s.traj_id, s.pos, row_number() OVER (ORDER BY {score} DESC, s.traj_id, s.pos) AS rn
             FROM scored s ANTI JOIN base b ON b.traj_id = s.traj_id AND b.pos = s.pos)
    SELECT traj_id, pos FROM base UNION ALL SELECT traj_id, pos FROM rest WHERE rn <= (SELECT b FROM total) - (SELECT count(*) FROM base)"""


@check("h6_simplify_global_budget", f"WITH {SCORED_SQL}, {global_sql('least(2, n_points)', 0.3)}")
def _(spark, sf):
    return simplify.simplify_global_budget(scored(spark, sf), 0.3)


def base_sql(ratio, fraction):
    return f"least({k_sql(ratio)}, greatest(2, CAST(ceil({k_sql(ratio)} * {fraction}e0) AS BIGINT)))"


@check("h7_simplify_global_fill", f"WITH {SCORED_SQL}, {global_sql(base_sql(0.3, 0.5), 0.3)}")
def _(spark, sf):
    return simplify.simplify_global_fill(scored(spark, sf), 0.3)


@check("h7_simplify_global_fill_bonus", f"""WITH {SCORED_SQL}, {global_sql(base_sql(0.3, 0.5), 0.3,
       'score + 0.5e0 * (SELECT min(abs(b2.pos - s.pos)) FROM base b2 WHERE b2.traj_id = s.traj_id) / CAST(greatest(1, n_points - 1) AS DOUBLE)')}""")
def _(spark, sf):
    return simplify.simplify_global_fill(scored(spark, sf), 0.3, 0.5, 0.5)


def fill_sql(ratio, fraction, src="scored", tail="SELECT traj_id, pos FROM base UNION ALL SELECT traj_id, pos FROM rest WHERE rn <= room"):
    return f"""{spaced_sql(src, 'base', base_sql(ratio, fraction))},
    rest AS (SELECT s.traj_id, s.pos, {k_sql(ratio)} - {base_sql(ratio, fraction)} AS room,
             row_number() OVER (PARTITION BY s.traj_id ORDER BY score DESC, s.pos) AS rn
             FROM {src} s ANTI JOIN base b ON b.traj_id = s.traj_id AND b.pos = s.pos) {tail}"""


@check("h8_hybrid_fill", f"WITH {SCORED_SQL}, {fill_sql(0.4, 0.5)}")
def _(spark, sf):
    return simplify.simplify_hybrid(scored(spark, sf), 0.4, 0.5)


def split_sql(start, distance, keep_first):
    """Best-first splitting by recursion; the strength of a cut is the least priority above it."""
    return f"""iv AS ({start}
      UNION ALL
      SELECT traj_id, unnest([l, cut]) AS l, unnest([cut, r]) AS r, own AS top, cut FROM (
        SELECT i.traj_id, i.l, i.r, arg_max(p.pos, struct_pack(d := {distance}, q := -p.pos)) AS cut, least(i.top, max({distance})) AS own
        FROM iv i JOIN pts p ON p.traj_id = i.traj_id AND p.pos > i.l AND p.pos < i.r
        JOIN pts a ON a.traj_id = i.traj_id AND a.pos = i.l JOIN pts b ON b.traj_id = i.traj_id AND b.pos = i.r
        GROUP BY i.traj_id, i.l, i.r, i.top)),
    strength AS (SELECT DISTINCT traj_id, cut AS pos, top AS strength FROM iv WHERE cut IS NOT NULL),
    ordered AS (SELECT p.*, row_number() OVER (PARTITION BY p.traj_id ORDER BY ({keep_first}) DESC, s.strength DESC NULLS LAST, p.pos) AS rn
                FROM pts p LEFT JOIN strength s ON s.traj_id = p.traj_id AND s.pos = p.pos)"""


_SPREAD = "p.score + 0.8e0 * least(p.pos - i.l, i.r - p.pos) / greatest(1, p.n_points - 1)::DOUBLE"


@check("h9_hybrid_fill_bonus", f"""WITH RECURSIVE {SCORED_SQL}, {spaced_sql('scored', 'base', base_sql(0.4, 0.5))},
   pts AS (SELECT s.*, b.pos IS NOT NULL AS in_base FROM scored s LEFT JOIN base b ON b.traj_id = s.traj_id AND b.pos = s.pos),
   {split_sql("SELECT traj_id, pos AS l, nxt AS r, 1e300 AS top, NULL::BIGINT AS cut FROM (SELECT traj_id, pos, lead(pos) OVER (PARTITION BY traj_id ORDER BY pos) AS nxt FROM base) WHERE nxt IS NOT NULL", _SPREAD, "in_base")}
   SELECT traj_id, pos FROM ordered WHERE rn <= {k_sql(0.4)}""")
def _(spark, sf):
    return simplify.simplify_hybrid(scored(spark, sf), 0.4, 0.5, bonus=0.8)


def _swap_k(ratio, fraction):
    k = k_sql(ratio)
    return f"greatest(0, least({k} - least({k}, greatest(2, CAST(ceil({k} * {fraction}e0) AS BIGINT))), n_points - {k}, {k} - 2))"


@check("h10_hybrid_swap", f"""WITH {SCORED_SQL}, {spaced_sql('scored', 'base', k_sql(0.4))},
   tagged AS (SELECT s.*, b.pos IS NOT NULL AS in_base, b.pos IS NOT NULL AND NOT is_start AND NOT is_end AS removable, {_swap_k(0.4, 0.5)} AS m
              FROM scored s LEFT JOIN base b ON b.traj_id = s.traj_id AND b.pos = s.pos),
   o AS (SELECT *, row_number() OVER (PARTITION BY traj_id, removable ORDER BY score, pos) AS out_rn,
                row_number() OVER (PARTITION BY traj_id, in_base ORDER BY score DESC, pos) AS in_rn FROM tagged)
   SELECT traj_id, pos FROM o WHERE (in_base AND NOT (removable AND out_rn <= m)) OR (NOT in_base AND in_rn <= m)""")
def _(spark, sf):
    return simplify.simplify_hybrid(scored(spark, sf), 0.4, 0.5, mode="swap")


@check("h11_hybrid_local_swap")
def _(spark, sf):
    return simplify.simplify_hybrid(scored(spark, sf), 0.4, 0.5, mode="local_swap")


@check("h12_hybrid_local_delta_swap")
def _(spark, sf):
    return simplify.simplify_hybrid(scored(spark, sf), 0.4, 0.5, mode="local_delta_swap")


@check("h13_hybrid_stratified", f"""WITH {SCORED_SQL}, kk AS (SELECT *, {k_sql(0.4)} AS k FROM scored),
   strata AS (SELECT traj_id, n_points, k, s, 1 + (s * (n_points - 2)) // (k - 2) AS lo, 1 + ((s + 1) * (n_points - 2)) // (k - 2) AS hi
              FROM (SELECT DISTINCT traj_id, n_points, k FROM kk WHERE k > 2 AND k < n_points), range(200) AS g(s) WHERE s < k - 2),
   pick AS (SELECT p.traj_id, p.pos, row_number() OVER (PARTITION BY p.traj_id, s ORDER BY
              score - 0.2e0 * (abs(p.pos - (lo + hi - 1) * 0.5e0) / greatest(1e0, (hi - lo) * 0.5e0)) DESC, p.pos) AS rn
            FROM kk p JOIN strata t ON t.traj_id = p.traj_id AND p.pos >= lo AND p.pos < hi)
   SELECT traj_id, pos FROM kk WHERE is_start OR is_end OR k >= n_points
   UNION SELECT traj_id, pos FROM pick WHERE rn = 1""")
def _(spark, sf):
    return simplify.simplify_hybrid(scored(spark, sf), 0.4, mode="stratified", center_weight=0.2)


_VY, _VX, _Y, _X = "(b.lat - a.lat)", "(b.lon - a.lon)", "(p.lat - a.lat)", "(p.lon - a.lon)"
_NORM = f"({_VY} * {_VY} + {_VX} * {_VX})"
_SHARE = f"(({_Y} * {_VY} + {_X} * {_VX}) / {_NORM})"
_OFF_Y, _OFF_X = f"({_Y} - {_SHARE} * {_VY})", f"({_X} - {_SHARE} * {_VX})"
_LINE = f"CASE WHEN {_NORM} < 1e-12 THEN sqrt({_Y} * {_Y} + {_X} * {_X}) ELSE sqrt({_OFF_Y} * {_OFF_Y} + {_OFF_X} * {_OFF_X}) END"


@check("h14_douglas_peucker", f"""WITH RECURSIVE {POINTS_SQL}, pts AS (SELECT * FROM points),
   {split_sql("SELECT traj_id, 0::BIGINT AS l, n_points - 1 AS r, 1e300 AS top, NULL::BIGINT AS cut FROM points WHERE pos = 0", _LINE, "is_start OR is_end")}
   SELECT traj_id, pos FROM ordered WHERE rn <= {k_sql(0.2)}""")
def _(spark, sf):
    return simplify.simplify_douglas_peucker(points(spark, sf), 0.2)


@check("h15_segment_budget")
def _(spark, sf):
    return simplify.simplify_segment_budget(scored(spark, sf), 0.3)


_BLOCKS_SQL = """blocks AS (SELECT traj_id, block, any_value(n_points) AS n_points, least(8, any_value(n_points) - block * 8) AS block_length,
   avg(score) FILTER (rn <= greatest(1, ceil(0.2e0 * least(8, n_points - block * 8)))) AS block_score FROM (
   SELECT *, CAST(pos // 8 AS BIGINT) AS block, row_number() OVER (PARTITION BY traj_id, pos // 8 ORDER BY score DESC, pos) AS rn FROM scored) GROUP BY traj_id, block)"""


@check("h15a_block_scores", f"WITH {SCORED_SQL}, {_BLOCKS_SQL} SELECT traj_id, block, CAST(block_length AS BIGINT) AS block_length, round(block_score, 9) AS block_score FROM blocks")
def _(spark, sf):
    b = simplify.block_scores(scored(spark, sf), size=8)
    return b.select("traj_id", "block", "block_length", r("block_score").alias("block_score"))


@check("h15b_allocate_slots", f"""WITH {SCORED_SQL}, {_BLOCKS_SQL},
   st AS (SELECT min(block_score) AS lo, max(block_score) AS hi, count(DISTINCT traj_id) AS n FROM blocks),
   ready AS (SELECT b.*, ln(greatest(1e-6, 0.5e0 + (block_score - lo) / (hi - lo))) AS w, n,
        block_length - (block = 0)::INT - (block = (n_points - 1) // 8)::INT AS room,
        row_number() OVER (PARTITION BY traj_id ORDER BY block_score DESC, block) AS best FROM blocks b, st),
   pre AS (SELECT *, CASE WHEN best = 1 AND room > 0 AND 1500 >= n THEN 1 ELSE 0 END AS given FROM ready),
   slots AS (SELECT traj_id, block, block_score, j <= given AS fixed, w - ln(j::DOUBLE) AS v, j FROM pre, range(1, 9) AS g(j) WHERE j <= room),
   nth AS (SELECT *, row_number() OVER (PARTITION BY traj_id ORDER BY fixed DESC, v DESC, j, block_score DESC, block) AS k FROM slots),
   chosen AS (SELECT * FROM nth WHERE k <= greatest(1, ceil(3000 * 0.2e0), ceil(3000e0 / (SELECT n FROM st))) - 2
              ORDER BY fixed DESC, v DESC, j, block_score DESC, traj_id, block LIMIT 1500)
   SELECT traj_id, block, count(*) AS slots FROM chosen GROUP BY traj_id, block""")
def _(spark, sf):
    b = simplify.block_scores(scored(spark, sf), size=8)
    return simplify.allocate_slots(b, 1500, 3000, size=8)


@check("h15d_fallback_fill", f"""WITH {SCORED_SQL}, chosen AS (SELECT traj_id, pos FROM scored WHERE is_start OR is_end),
   rest AS (SELECT traj_id, pos, row_number() OVER (ORDER BY score DESC, traj_id, pos) AS rn FROM scored WHERE NOT is_start AND NOT is_end)
   SELECT traj_id, pos, 'skeleton' AS reason FROM chosen UNION ALL
   SELECT traj_id, pos, 'fallback' FROM rest WHERE rn <= 3000 - (SELECT count(*) FROM chosen)""")
def _(spark, sf):
    p = scored(spark, sf)
    chosen = p.filter("is_start OR is_end").select("traj_id", "pos", F.lit("skeleton").alias("reason"))
    return simplify.fallback_fill(p, chosen, 3000)


@check("h15e_selector_trace", f"""WITH {SCORED_SQL}, why AS (SELECT traj_id, CASE WHEN is_start OR is_end THEN 'skeleton' WHEN score > 0.7 THEN 'learned'
   WHEN score > 0.6 THEN 'fallback' END AS reason FROM scored),
   t AS (SELECT traj_id, count(*) FILTER (reason = 'learned') AS l FROM why WHERE reason IS NOT NULL GROUP BY traj_id)
   SELECT count(reason) AS retained, count(*) FILTER (reason = 'skeleton') AS skeleton, count(*) FILTER (reason = 'learned') AS learned,
   count(*) FILTER (reason = 'fallback') AS fallback, (SELECT count(*) FROM t WHERE l > 0) AS tracks_with_learned,
   (SELECT count(*) FROM t WHERE l = 0) AS tracks_without_learned FROM why""")
def _(spark, sf):
    reason = F.when(F.expr("is_start OR is_end"), "skeleton").when(F.col("score") > 0.7, "learned").when(F.col("score") > 0.6, "fallback")
    chosen = scored(spark, sf).select("traj_id", "pos", reason.alias("reason")).filter("reason IS NOT NULL")
    return simplify.selector_trace(chosen)


@check("h15e_slot_entropy", f"""WITH {SCORED_SQL}, s AS (SELECT traj_id, pos // 8 AS block, count(*) FILTER (score > 0.5) AS slots FROM scored GROUP BY ALL),
   p AS (SELECT slots / (SELECT sum(slots) FROM s)::DOUBLE AS p FROM s WHERE slots > 0)
   SELECT count(*) AS blocks, round(-sum(p * ln(p)), 6) AS entropy, round(-sum(p * ln(p)) / ln(count(*)), 6) AS entropy_normalized FROM p""")
def _(spark, sf):
    s = scored(spark, sf).groupBy("traj_id", F.floor(F.col("pos") / 8).alias("block")).agg(F.count_if(F.col("score") > 0.5).alias("slots"))
    e = simplify.slot_entropy(s)
    return e.select("blocks", r("entropy", 6).alias("entropy"), r("entropy_normalized", 6).alias("entropy_normalized"))


@check("h15e_block_score_stats", f"""WITH {SCORED_SQL}, {_BLOCKS_SQL} SELECT count(*) AS blocks, round(min(block_score), 9) AS score_min, round(max(block_score), 9) AS score_max,
   round(avg(block_score), 9) AS score_mean, round(stddev_pop(block_score), 9) AS score_std, round(max(block_score) - min(block_score), 9) AS score_span FROM blocks""")
def _(spark, sf):
    st = simplify.block_score_stats(simplify.block_scores(scored(spark, sf), size=8))
    return st.select("blocks", *[r(c).alias(c) for c in st.columns if c != "blocks"])


_LABEL_SQL = f"""{HITS_SQL}, label AS (SELECT traj_id, pos, sum(1e0 / query_hits) AS label FROM
   (SELECT *, count(*) OVER (PARTITION BY query_id) AS query_hits FROM hits) GROUP BY traj_id, pos)"""


@check("h16_simplify_oracle", f"""WITH {_LABEL_SQL}, ranked AS (SELECT p.*, row_number() OVER (PARTITION BY p.traj_id ORDER BY round(coalesce(label, 0), 9) DESC, p.pos) AS rn
   FROM points p LEFT JOIN label l ON l.traj_id = p.traj_id AND l.pos = p.pos)
   SELECT traj_id, pos FROM ranked WHERE rn <= {k_sql(0.3)} OR is_start OR is_end""")
def _(spark, sf):
    hits = query_hits(points(spark, sf), boxes(spark)).select("query_id", "traj_id", "pos")
    sizes = hits.groupBy("query_id").agg(F.count(F.lit(1)).alias("n"))
    label = hits.join(sizes, "query_id").groupBy("traj_id", "pos").agg(r(F.sum(1.0 / F.col("n"))).alias("label"))
    return simplify.simplify_oracle(points(spark, sf).join(label, ["traj_id", "pos"], "left"), 0.3)


@check("h17_freeze", f"WITH {POINTS_SQL}, {spaced_sql('points', 'kept', k_sql(0.1))} SELECT * FROM kept")
def _(spark, sf):
    return simplify.freeze(simplify.simplify_uniform(points(spark, sf), 0.1))


def _budgets_sql(free):
    return f"""WITH {POINTS_SQL}, s AS (SELECT n_points, CAST(ratio AS DOUBLE) AS ratio, least(n_points, greatest(2, CAST(ceil(ratio * n_points) AS BIGINT))) AS k
      FROM points, (VALUES (0.05e0), (0.2e0), (0.5e0)) AS x(ratio) WHERE pos = 0), f AS (SELECT *, {free} AS free FROM s)
      SELECT ratio, count(*) AS tracks, CAST(sum(n_points) AS BIGINT) AS points, CAST(sum(k) AS BIGINT) AS budget, CAST(sum(k - free) AS BIGINT) AS base_slots,
      CAST(sum(free) AS BIGINT) AS free_slots, count(*) FILTER (free <= 0) AS tracks_without_free, count(*) FILTER (k <= least(2, n_points)) AS tracks_ends_only,
      round(sum(free) / sum(k)::DOUBLE, 9) AS free_share FROM f GROUP BY ratio"""


@check("h18_selector_budgets_fill", _budgets_sql("k - least(k, greatest(2, CAST(ceil(k * 0.5e0) AS BIGINT)))"))
def _(spark, sf):
    return simplify.selector_budgets(points(spark, sf), [0.05, 0.2, 0.5]).withColumn("free_share", r("free_share"))


@check("h18_selector_budgets_swap", _budgets_sql("greatest(0, least(k - least(k, greatest(2, CAST(ceil(k * 0.5e0) AS BIGINT))), n_points - k, k - 2))"))
def _(spark, sf):
    return simplify.selector_budgets(points(spark, sf), [0.05, 0.2, 0.5], mode="swap").withColumn("free_share", r("free_share"))


_CONV = {
    "rank": "(row_number() OVER (PARTITION BY traj_id ORDER BY score, pos) - 1) / greatest(1, n_points - 1)::DOUBLE",
    "rank_tie": "(rank() OVER (PARTITION BY traj_id ORDER BY score) - 1 + (count(*) OVER (PARTITION BY traj_id, score) - 1) / 2e0) / greatest(1, n_points - 1)::DOUBLE",
    "raw": "score",
    "sigmoid": "1 / (1 + exp(-score))",
    "temperature_sigmoid": "1 / (1 + exp(-score / 2e0))",
    "zscore_sigmoid": "1 / (1 + exp(-CASE WHEN sd > 1e-6 THEN (score - mu) / sd ELSE 0 END / 2e0))",
}
_CONV["rank_confidence"] = f"0.85e0 * ({_CONV['rank']}) + 0.15e0 * ({_CONV['zscore_sigmoid']})"

for _mode, _expr in _CONV.items():

    @check(f"h19_convert_{_mode}", f"""WITH {SCORED_SQL}, m AS (SELECT *, avg(score) OVER (PARTITION BY traj_id) AS mu, stddev_pop(score) OVER (PARTITION BY traj_id) AS sd FROM scored)
       SELECT traj_id, pos, round({_expr}, 9) AS converted FROM m""")
    def _(spark, sf, mode=_mode):
        done = simplify.convert_scores(scored(spark, sf), mode=mode, temperature=2.0)
        return done.select("traj_id", "pos", r("converted").alias("converted"))


@check("h20_blend_scores", f"""WITH {SCORED_SQL} SELECT traj_id, pos, round(0.7e0 * score + 0.3e0 * (row_number() OVER (PARTITION BY traj_id ORDER BY turn_score, pos) - 1)
   / greatest(1, n_points - 1)::DOUBLE, 9) AS blended FROM scored""")
def _(spark, sf):
    return simplify.blend_scores(scored(spark, sf), "score", "turn_score", 0.3).select("traj_id", "pos", r("blended").alias("blended"))


@check("h21_control_methods", f"""WITH {POINTS_SQL}, n AS (SELECT sum({k_sql(0.2)})::BIGINT AS kept FROM points WHERE pos = 0)
   SELECT unnest(['uniform', 'douglas_peucker', 'random_fill', 'random_global_budget']) AS method, 0.2e0 AS ratio, kept FROM n""")
def _(spark, sf):
    kept = simplify.retain(points(spark, sf), simplify.control_methods(seed=11), [0.2])
    return kept.groupBy("method", "ratio").agg(F.count(F.lit(1)).alias("kept"))
