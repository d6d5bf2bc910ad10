"""Cleaning and quality checks."""

from __future__ import annotations

from pyspark.sql import functions as F

from tracklake.operators import cleaning, quality
from tracklake.sources import reports as source

from .fixtures import REPORTS_SQL, reports, reports_raw, RAW_SQL, shared
from .registry import check
from .tracks import hav, r

_TYPED_SQL = RAW_SQL + """,
typed AS (
  SELECT *, CASE WHEN reason_ts THEN 'missing_ts' WHEN mmsi IS NULL OR lat IS NULL OR lon IS NULL THEN 'missing_core'
                 WHEN NOT (lat BETWEEN -90 AND 90 AND lon BETWEEN -180 AND 180) THEN 'bad_coords' END AS reason
  FROM (SELECT *, t IS NULL AS reason_ts FROM (
    SELECT report_id,
      epoch_us(coalesce(try_strptime(nullif(trim(timestamp_raw), ''), '%d/%m/%Y %H:%M:%S'), TRY_CAST(nullif(trim(timestamp_raw), '') AS TIMESTAMP))) / 1e6 AS t,
      TRY_CAST(nullif(trim(mmsi_raw), '') AS BIGINT) AS mmsi, nullif(trim(mobile_raw), '') AS mobile_type,
      TRY_CAST(nullif(trim(lat_raw), '') AS DOUBLE) AS lat, TRY_CAST(nullif(trim(lon_raw), '') AS DOUBLE) AS lon,
      TRY_CAST(nullif(trim(sog_raw), '') AS DOUBLE) AS sog, TRY_CAST(nullif(trim(cog_raw), '') AS DOUBLE) AS cog,
      nullif(trim(ship_raw), '') AS ship_type
    FROM raw)))"""


@check("a2_a5_type_reports", f"WITH {_TYPED_SQL} SELECT report_id, t, mmsi, mobile_type, lat, lon, sog, cog, ship_type FROM typed")
def _(spark, sf):
    return source.type_reports(reports_raw(spark, sf)).drop("ts")


@check("a6_validate_reports", f"WITH {_TYPED_SQL} SELECT report_id, coalesce(reason, 'good') AS reason FROM typed")
def _(spark, sf):
    good, bad = source.validate_reports(reports_raw(spark, sf))
    return good.select("report_id", F.lit("good").alias("reason")).unionByName(bad.select("report_id", "reason"))


@check("a6b_reject_counts", f"""WITH {_TYPED_SQL} SELECT count(*) AS rows_read, count(*) FILTER (reason IS NULL) AS rows_inserted,
       count(reason) AS rows_skipped, count(*) FILTER (reason = 'missing_ts') AS skip_missing_ts,
       count(*) FILTER (reason = 'missing_core') AS skip_missing_core, count(*) FILTER (reason = 'bad_coords') AS skip_bad_coords FROM typed""")
def _(spark, sf):
    return source.reject_counts(reports_raw(spark, sf))


@check("a18_filter_ids", f"WITH {REPORTS_SQL} SELECT report_id, mmsi FROM reports WHERE mmsi IN (SELECT 200000000 + c_custkey FROM customer WHERE c_custkey % 5 = 1)")
def _(spark, sf):
    ids = spark.read.parquet(f"{sf}/customer.parquet").filter("c_custkey % 5 = 1").select((F.col("c_custkey") + 200000000).alias("mmsi"))
    return source.filter_ids(reports(spark, sf), ids).select("report_id", "mmsi")


@check("a18_kept_and_total", f"""WITH {REPORTS_SQL} SELECT count(*) FILTER (mmsi IN (SELECT 200000000 + c_custkey FROM customer WHERE c_custkey % 5 = 1)) AS kept,
       count(*) AS total FROM reports""")
def _(spark, sf):
    ids = spark.read.parquet(f"{sf}/customer.parquet").filter("c_custkey % 5 = 1").select((F.col("c_custkey") + 200000000).alias("mmsi"))
    return source.kept_and_total(reports(spark, sf), ids)


@check("b1_b2_class_a_deduped", f"""WITH {RAW_SQL} SELECT DISTINCT timestamp_raw, mobile_raw, mmsi_raw, lat_raw, lon_raw, sog_raw, cog_raw, ship_raw
       FROM raw WHERE mobile_raw = 'Class A'""")
def _(spark, sf):
    return cleaning.dedupe_exact(cleaning.keep_class_a(reports_raw(spark, sf)))


@check("b3_type_and_require", f"WITH {_TYPED_SQL} SELECT report_id, t, lat, lon, sog FROM typed WHERE t IS NOT NULL AND lat IS NOT NULL AND lon IS NOT NULL AND sog IS NOT NULL")
def _(spark, sf):
    return cleaning.type_and_require(reports_raw(spark, sf)).select("report_id", "t", "lat", "lon", "sog")


def _trim_sql(seconds, src="reports"):
    return f"""trimmed AS (SELECT * EXCLUDE (rn) FROM (SELECT *, row_number() OVER (
      PARTITION BY mmsi, floor(t / {seconds}), sog = 0 ORDER BY t, report_id) AS rn FROM {src}) WHERE sog <> 0 OR rn = 1)"""


@check("b4_trim_stationary_hour", f"WITH {REPORTS_SQL}, {_trim_sql(3600)} SELECT report_id, sog FROM trimmed")
def _(spark, sf):
    return cleaning.trim_stationary(reports(spark, sf)).select("report_id", "sog")


@check("b4_trim_stationary_day", f"WITH {REPORTS_SQL}, {_trim_sql(86400)} SELECT report_id, sog FROM trimmed")
def _(spark, sf):
    return cleaning.trim_stationary(reports(spark, sf), 86400).select("report_id", "sog")


def _fill_sql(src):
    return f"""filled AS (SELECT * REPLACE (coalesce(nullif(ship_type, 'Undefined'),
      min_by(nullif(ship_type, 'Undefined'), struct_pack(t := t, r := report_id)) FILTER (ship_type <> 'Undefined') OVER (PARTITION BY mmsi)) AS ship_type)
      FROM {src})"""


@check("b5_fill_ship_type", f"WITH {REPORTS_SQL}, {_fill_sql('reports')} SELECT report_id, coalesce(ship_type, '-') AS ship_type FROM filled")
def _(spark, sf):
    filled = cleaning.fill_ship_type(reports(spark, sf))
    return filled.select("report_id", F.coalesce("ship_type", F.lit("-")).alias("ship_type"))


@check("b6_drop_undefined_type", f"WITH {REPORTS_SQL} SELECT report_id, ship_type FROM reports WHERE ship_type <> 'Undefined'")
def _(spark, sf):
    return cleaning.drop_undefined_type(reports(spark, sf)).select("report_id", "ship_type")


_BLACK_SQL = """(SELECT mmsi FROM {src} WHERE ship_type IN ('Undefined', '') GROUP BY mmsi HAVING count(*) FILTER (sog > 4) >= 5)"""


@check("b7_drop_ship_types", f"""WITH {REPORTS_SQL} SELECT report_id, mmsi, ship_type FROM reports
       WHERE ship_type <> 'SAR' AND mmsi NOT IN {_BLACK_SQL.format(src='reports')}""")
def _(spark, sf):
    return cleaning.drop_ship_types(reports(spark, sf), 4, 5).select("report_id", "mmsi", "ship_type")


def _near(n):
    tag, fn, k = {-2: ("p2", "lag", 2), -1: ("p1", "lag", 1), 1: ("n1", "lead", 1), 2: ("n2", "lead", 2)}[n]
    cols = ", ".join(f"{fn}({c}, {k}) OVER w AS {c}_{tag}" for c in ("t", "lat", "lon", "sog"))
    km = hav(f"lat_{tag}", f"lon_{tag}", "lat", "lon")
    hours = f"(abs(floor(t) - floor(t_{tag})) / 3600e0)"
    allowed = f"greatest(greatest(sog, sog_{tag}) * 1.852e0 * {hours} * 1.2e0 * (1 + 0.3e0 * {hours}), 0.05e0)"
    return cols, f"{km} <= {allowed}", tag


_NEAR = {n: _near(n) for n in (-2, -1, 1, 2)}


def reach_sql(src, out):
    cols = ", ".join(_NEAR[n][0] for n in _NEAR)
    flags = ", ".join(f"t_{tag} IS NOT NULL AS has_{tag}, {cond} AS reach_{tag}" for _, cond, tag in _NEAR.values())
    return f"""{out} AS (SELECT *, {flags} FROM (SELECT *, row_number() OVER w AS rank, {cols} FROM {src}
      WINDOW w AS (PARTITION BY mmsi ORDER BY t, report_id)))"""


_RULES = {
    "head": """NOT ((rank = 1 AND NOT coalesce(reach_n1, false) AND NOT coalesce(reach_n2, false) AND has_n2)
       OR (rank IN (2, 3) AND NOT coalesce(reach_p1, false) AND NOT coalesce(reach_n1, false) AND has_n1))""",
    "both": "NOT has_p1 OR NOT has_n1 OR coalesce(reach_p1, true) OR coalesce(reach_n1, true)",
    "skip": """NOT ((has_p2 AND has_n2 AND NOT coalesce(reach_p2, true) AND NOT coalesce(reach_n2, true))
       OR (NOT has_p2 AND has_n1 AND has_n2 AND NOT coalesce(reach_n1, true) AND NOT coalesce(reach_n2, true))
       OR (has_p1 AND has_p2 AND NOT has_n2 AND NOT coalesce(reach_p1, true) AND NOT coalesce(reach_p2, true)))""",
}
_BASE = "report_id, mmsi, t, lat, lon, sog, cog, ship_type"


def pass_sql(src, out, rule):
    return f"{reach_sql(src, out + '_r')}, {out} AS MATERIALIZED (SELECT {_BASE} FROM {out}_r WHERE {_RULES[rule]})"


_OUTLIER_SQL = ", ".join([
    pass_sql("{src}", "o_head", "head"), pass_sql("o_head", "o_both", "both"), pass_sql("o_both", "o_s1", "skip"),
    pass_sql("o_s1", "o_s2", "skip"), pass_sql("o_s2", "o_s3", "skip")])


@check("b8_b9_b10_reachability", f"""WITH {REPORTS_SQL}, {reach_sql('reports', 'x')} SELECT report_id, rank, has_p2, has_p1, has_n1, has_n2,
       coalesce(reach_p2, true) AS reach_p2, coalesce(reach_p1, true) AS reach_p1, coalesce(reach_n1, true) AS reach_n1, coalesce(reach_n2, true) AS reach_n2 FROM x""")
def _(spark, sf):
    flags = [f"{k}_{o}" for k in ("has", "reach") for o in ("p2", "p1", "n1", "n2")]
    return cleaning.reachability(reports(spark, sf)).select("report_id", "rank", *flags)


@check("b11_clean_head", f"WITH {REPORTS_SQL}, {pass_sql('reports', 'o', 'head')} SELECT report_id FROM o")
def _(spark, sf):
    return cleaning.clean_head(reports(spark, sf)).select("report_id")


@check("b12_bidirectional_pass", f"WITH {REPORTS_SQL}, {pass_sql('reports', 'o', 'both')} SELECT report_id FROM o")
def _(spark, sf):
    return cleaning.bidirectional_pass(reports(spark, sf)).select("report_id")


@check("b13_skip_neighbor_pass", f"WITH {REPORTS_SQL}, {pass_sql('reports', 'o', 'skip')} SELECT report_id FROM o")
def _(spark, sf):
    return cleaning.skip_neighbor_pass(reports(spark, sf)).select("report_id")


def detected(spark, sf):
    return shared(spark, sf, "detected", lambda: cleaning.outlier_detector(reports(spark, sf))[0])


DETECTED_SQL = f"{REPORTS_SQL}, {_OUTLIER_SQL.format(src='reports')}"


@check("b14_b15_outlier_detector", f"WITH {DETECTED_SQL} SELECT report_id, mmsi FROM o_s3")
def _(spark, sf):
    return cleaning.outlier_detector(reports(spark, sf))[0].select("report_id", "mmsi")


@check("b15_removed_per_phase", f"""WITH {DETECTED_SQL}, n AS (SELECT (SELECT count(*) FROM reports) AS a, (SELECT count(*) FROM o_head) AS b,
       (SELECT count(*) FROM o_both) AS c, (SELECT count(*) FROM o_s1) AS d, (SELECT count(*) FROM o_s2) AS e, (SELECT count(*) FROM o_s3) AS f)
       SELECT 0 AS step, 'head' AS phase, a - b AS removed FROM n UNION ALL SELECT 1, 'bidirectional', b - c FROM n
       UNION ALL SELECT 2, 'skip_neighbor_1', c - d FROM n UNION ALL SELECT 3, 'skip_neighbor_2', d - e FROM n WHERE c > d
       UNION ALL SELECT 4, 'skip_neighbor_3', e - f FROM n WHERE c > d AND d > e""")
def _(spark, sf):
    return cleaning.outlier_detector(reports(spark, sf))[1]


@check("b16_clean_reports", f"""WITH {RAW_SQL},
  ded AS (SELECT mmsi_raw, timestamp_raw, mobile_raw, lat_raw, lon_raw, sog_raw, cog_raw, ship_raw, min(report_id) AS report_id FROM raw WHERE mobile_raw = 'Class A' GROUP BY ALL),
  req AS (SELECT report_id, TRY_CAST(mmsi_raw AS BIGINT) AS mmsi,
      epoch_us(coalesce(try_strptime(nullif(timestamp_raw, ''), '%d/%m/%Y %H:%M:%S'), TRY_CAST(nullif(timestamp_raw, '') AS TIMESTAMP))) / 1e6 AS t,
      TRY_CAST(lat_raw AS DOUBLE) AS lat, TRY_CAST(lon_raw AS DOUBLE) AS lon, TRY_CAST(nullif(sog_raw, '') AS DOUBLE) AS sog,
      TRY_CAST(cog_raw AS DOUBLE) AS cog, nullif(ship_raw, '') AS ship_type FROM ded),
  usable AS (SELECT * FROM req WHERE t IS NOT NULL AND lat IS NOT NULL AND lon IS NOT NULL AND sog IS NOT NULL),
  {_trim_sql(3600, 'usable')}, {_fill_sql('trimmed')},
  typed_ok AS (SELECT * FROM filled WHERE ship_type <> 'Undefined' AND ship_type <> 'SAR'),
  {_OUTLIER_SQL.format(src='typed_ok')}
  SELECT mmsi, t, lat, lon, sog, cog, ship_type FROM o_s3""")
def _(spark, sf):
    return cleaning.clean_reports(reports_raw(spark, sf)).select("mmsi", "t", "lat", "lon", "sog", "cog", "ship_type")


_GAPS_SQL = f"""{REPORTS_SQL},
near AS (SELECT *, lag(t) OVER w AS pt, lag(lat) OVER w AS pa, lag(lon) OVER w AS po, lag(sog) OVER w AS ps,
         lead(t) OVER w AS nt, lead(lat) OVER w AS na, lead(lon) OVER w AS no_
         FROM reports WINDOW w AS (PARTITION BY mmsi ORDER BY t, report_id)),
gap0 AS (SELECT *, {hav('pa', 'po', 'lat', 'lon')} AS dist_km, CAST(floor(t) - floor(pt) AS BIGINT) AS time_s, greatest(ps, sog) AS max_sog,
         {hav('lat', 'lon', 'na', 'no_')} AS dist_next_km, CAST(floor(nt) - floor(t) AS BIGINT) AS time_next_s,
         {hav('pa', 'po', 'na', 'no_')} AS skip_dist_km, (floor(nt) - floor(pt)) / 3600e0 AS skip_h FROM near WHERE pt IS NOT NULL),
gap1 AS (SELECT *, CASE WHEN time_s > 0 THEN dist_km / (time_s / 3600e0 * 1.852e0) END AS needed_kn,
         CASE WHEN skip_h > 0 THEN skip_dist_km / (skip_h * 1.852e0) END AS skip_needed_kn FROM gap0),
gap2 AS (SELECT *, CASE WHEN max_sog > 0 THEN needed_kn / max_sog END AS speed_ratio FROM gap1),
gaps AS (SELECT *, CASE WHEN time_s = 0 THEN 'DUPLICATE_TS' WHEN speed_ratio <= 1.5e0 THEN 'OK_SPEED_MATCHES'
         WHEN skip_needed_kn < max_sog * 1.5e0 AND speed_ratio > 2 THEN 'SUSPICIOUS_SKIP_FIXES' WHEN speed_ratio > 3 THEN 'SUSPICIOUS_VERY_FAST'
         WHEN speed_ratio > 1.5e0 THEN 'BORDERLINE' ELSE 'OK' END AS verdict FROM gap2)"""


@check("c1_consecutive_gaps", f"""WITH {_GAPS_SQL} SELECT report_id, round(dist_km, 4) AS dist_km, time_s, max_sog,
       round(coalesce(dist_next_km, -1), 4) AS dist_next_km, coalesce(time_next_s, -1) AS time_next_s, round(coalesce(needed_kn, -1), 4) AS needed_kn,
       round(coalesce(skip_needed_kn, -1), 4) AS skip_needed_kn, round(coalesce(speed_ratio, -1), 4) AS speed_ratio FROM gaps""")
def _(spark, sf):
    g = quality.consecutive_gaps(reports(spark, sf))
    opt = ["dist_next_km", "needed_kn", "skip_needed_kn", "speed_ratio"]
    return g.select("report_id", r("dist_km", 4).alias("dist_km"), "time_s", "max_sog",
                    F.coalesce("time_next_s", F.lit(-1)).alias("time_next_s"),
                    *[r(F.coalesce(c, F.lit(-1.0)), 4).alias(c) for c in opt])


@check("c2_gap_verdict", f"WITH {_GAPS_SQL} SELECT report_id, verdict FROM gaps")
def _(spark, sf):
    return quality.gap_verdict(quality.consecutive_gaps(reports(spark, sf))).select("report_id", "verdict")


@check("c3_top_gaps", f"WITH {_GAPS_SQL} SELECT report_id, mmsi, round(dist_km, 4) AS dist_km, verdict FROM gaps ORDER BY gaps.dist_km DESC, report_id LIMIT 25")
def _(spark, sf):
    g = quality.gap_verdict(quality.consecutive_gaps(reports(spark, sf)))
    return quality.top_gaps(g, 25).select("report_id", "mmsi", r("dist_km", 4).alias("dist_km"), "verdict")


@check("c4_verdict_summary", f"WITH {_GAPS_SQL} SELECT verdict, count(*) AS gaps, verdict LIKE 'SUSPICIOUS%' AS suspicious FROM gaps GROUP BY verdict")
def _(spark, sf):
    return quality.verdict_summary(quality.gap_verdict(quality.consecutive_gaps(reports(spark, sf))))


def _max_gap_sql(src, out):
    return f"""{out} AS (SELECT mmsi, max({hav('pa', 'po', 'lat', 'lon')}) AS g FROM (SELECT *, lag(lat) OVER w AS pa, lag(lon) OVER w AS po
      FROM {src} WINDOW w AS (PARTITION BY mmsi ORDER BY t, report_id)) GROUP BY mmsi)"""


@check("c5_max_consecutive_gap", f"WITH {REPORTS_SQL}, {_max_gap_sql('reports', 'g')} SELECT mmsi, round(coalesce(g, 0), 4) AS max_gap_km FROM g")
def _(spark, sf):
    m = quality.max_consecutive_gap(reports(spark, sf))
    return m.select("mmsi", r(F.coalesce("max_gap_km", F.lit(0.0)), 4).alias("max_gap_km"))


_CMP_SQL = f"""{DETECTED_SQL}, cmp AS (SELECT mmsi, before_rows, coalesce(after_rows, 0) AS after_rows, before_rows - coalesce(after_rows, 0) AS deleted_rows
  FROM (SELECT mmsi, count(*) AS before_rows FROM reports GROUP BY mmsi) LEFT JOIN (SELECT mmsi, count(*) AS after_rows FROM o_s3 GROUP BY mmsi) USING (mmsi))"""


@check("c6_compare_counts", f"WITH {_CMP_SQL} SELECT mmsi, before_rows, after_rows, deleted_rows, round(deleted_rows / before_rows::DOUBLE * 100, 1) AS pct_deleted FROM cmp")
def _(spark, sf):
    return quality.compare_counts(reports(spark, sf), detected(spark, sf))


@check("c7_gap_reduction", f"""WITH {_CMP_SQL}, {_max_gap_sql('reports', 'gb')}, {_max_gap_sql('o_s3', 'ga')},
  j AS (SELECT mmsi, deleted_rows, coalesce(gb.g, 0) AS b, coalesce(ga.g, 0) AS a FROM cmp LEFT JOIN gb USING (mmsi) LEFT JOIN ga USING (mmsi))
  SELECT mmsi, deleted_rows, round(b, 4) AS gap_before_km, round(a, 4) AS gap_after_km, round(b - a, 4) AS gap_reduction_km,
         CASE WHEN b > 0 THEN round((b - a) / b * 100, 1) ELSE 0 END AS gap_reduction_pct FROM j WHERE b - a > 0.001""")
def _(spark, sf):
    g = quality.gap_reduction(reports(spark, sf), detected(spark, sf))
    return g.select("mmsi", "deleted_rows", "gap_reduction_pct", *[r(c, 4).alias(c) for c in ("gap_before_km", "gap_after_km", "gap_reduction_km")])


_TAG_SQL = f"""{DETECTED_SQL}, tag0 AS (SELECT *, lag(t) OVER w AS pt, lag(lat) OVER w AS pa, lag(lon) OVER w AS po, lag(sog) OVER w AS prev_sog,
   report_id IN (SELECT report_id FROM o_s3) AS kept FROM reports WINDOW w AS (PARTITION BY mmsi ORDER BY t, report_id)),
tag AS (SELECT *, round({hav('pa', 'po', 'lat', 'lon')}, 4) AS dist_prev_km,
   round(prev_sog * 1.852e0 * h * (1.2e0 * (1 + 0.3e0 * h)), 4) AS allowed_km,
   CASE WHEN h > 0 THEN round({hav('pa', 'po', 'lat', 'lon')} / (h * 1.852e0), 2) END AS implied_speed_knots,
   {hav('pa', 'po', 'lat', 'lon')} AS exact_km, prev_sog * 1.852e0 * h * (1.2e0 * (1 + 0.3e0 * h)) AS exact_reach,
   CASE WHEN h > 0 THEN {hav('pa', 'po', 'lat', 'lon')} / (h * 1.852e0) END AS exact_kn
   FROM (SELECT *, (floor(t) - floor(pt)) / 3600e0 AS h FROM tag0))"""


@check("c8_tag_deleted", f"""WITH {_TAG_SQL} SELECT report_id, kept, coalesce(prev_sog, -1) AS prev_sog, coalesce(dist_prev_km, -1) AS step_km,
       coalesce(allowed_km, -1) AS reach_km, coalesce(implied_speed_knots, -1) AS needed_kn FROM tag""")
def _(spark, sf):
    t = quality.tag_deleted(reports(spark, sf), detected(spark, sf))
    shown = {"prev_sog": F.col("prev_sog"), "step_km": F.round("step_km", 4), "reach_km": F.round("reach_km", 4), "needed_kn": F.round("needed_kn", 2)}
    return t.select("report_id", "kept", *[F.coalesce(c, F.lit(-1.0)).alias(n) for n, c in shown.items()])


@check("c9_deleted_causes", f"""WITH {_TAG_SQL}, gone AS (SELECT * FROM tag WHERE NOT kept AND prev_sog IS NOT NULL) SELECT 'any' AS cause, count(*) AS reports FROM gone
       UNION ALL SELECT 'slow_before', count(*) FILTER (prev_sog < 1) FROM gone UNION ALL SELECT 'stopped_before', count(*) FILTER (prev_sog < 0.5) FROM gone
       UNION ALL SELECT 'impossible_step', count(*) FILTER (exact_kn > 50) FROM gone""")
def _(spark, sf):
    return quality.deleted_causes(quality.tag_deleted(reports(spark, sf), detected(spark, sf)))


@check("c9_deleted_profile", f"""WITH {_TAG_SQL} SELECT ship_type, count(*) AS deleted, round(avg(prev_sog), 6) AS mean_prev_sog, round(avg(exact_km), 6) AS mean_step_km, round(avg(exact_reach), 6) AS mean_reach_km,
       round(quantile_disc(prev_sog, 0.5), 6) AS median_prev_sog, round(quantile_disc(exact_km, 0.5), 6) AS median_step_km
       FROM tag WHERE NOT kept GROUP BY ship_type""")
def _(spark, sf):
    t = quality.deleted_profile(quality.tag_deleted(reports(spark, sf), detected(spark, sf)), ["ship_type"])
    shown = ("mean_prev_sog", "mean_step_km", "mean_reach_km", "median_prev_sog", "median_step_km")
    return t.select("ship_type", "deleted", *[F.round(c, 6).alias(c) for c in shown])


@check("c10_deleted_samples", f"""WITH {_TAG_SQL}, gone AS (SELECT * FROM tag WHERE NOT kept),
  top AS (SELECT mmsi, count(*) AS deleted, round(avg(exact_km), 6) AS mean_step_km FROM gone GROUP BY mmsi ORDER BY deleted DESC, mmsi LIMIT 5)
  SELECT * FROM (SELECT report_id, mmsi, deleted, mean_step_km, row_number() OVER (PARTITION BY mmsi ORDER BY t, report_id) AS row FROM gone JOIN top USING (mmsi)) WHERE row <= 3""")
def _(spark, sf):
    t = quality.tag_deleted(reports(spark, sf), detected(spark, sf))
    return quality.deleted_samples(t, 5, 3).select("report_id", "mmsi", "deleted", F.round("mean_step_km", 6).alias("mean_step_km"), "row")


@check("c11_fully_removed", f"""WITH {REPORTS_SQL}, kept AS (SELECT * FROM reports WHERE ship_type <> 'SAR' AND mmsi NOT IN {_BLACK_SQL.format(src='reports')})
       SELECT mmsi, count(*) AS before_rows FROM reports WHERE mmsi NOT IN (SELECT mmsi FROM kept) GROUP BY mmsi""")
def _(spark, sf):
    before = reports(spark, sf)
    cmp = quality.compare_counts(before, cleaning.drop_ship_types(before, 4, 5))
    return quality.fully_removed(cmp).select("mmsi", "before_rows")
