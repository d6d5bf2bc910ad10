"""Workload generation and diagnostics."""

from __future__ import annotations

from pyspark.sql import functions as F

from tracklake.functions.hashing import unit_hash
from tracklake.operators import diagnostics, ranges, workload
from tracklake.plans.materialize import materialize

from .fixtures import HITS_SQL, POINTS_SQL, REPORTS_SQL, boxes, points, reports, shared
from .metrics import _rounded, _rounded_sql
from .registry import check
from .tracks import r

_CELL_SQL = """e AS (SELECT min(lat) AS a, max(lat) AS b, min(lon) AS c, max(lon) AS d FROM points),
cells AS (SELECT p.*, CAST(floor((lat - a) / greatest(b - a, 1e-6) * 63) * 64 + floor((lon - c) / greatest(d - c, 1e-6) * 63) AS BIGINT) AS cell FROM points p, e),
pop AS (SELECT *, count(*) OVER (PARTITION BY cell) AS n FROM cells),
ends AS (SELECT *, 1 + CASE WHEN is_start OR is_end THEN 8 ELSE 0 END + 3 * turn_score AS ew FROM pop),
wts AS (SELECT *, n / (sum(n) OVER ())::DOUBLE AS density, (1e0 / n) / sum(1e0 / n) OVER () AS sparse, ew / sum(ew) OVER () AS endpoint FROM ends),
chg AS (SELECT *, coalesce(abs(speed - lag(speed) OVER w), 0e0) AS dv,
   coalesce(least(abs(heading - lag(heading) OVER w), 360e0 - abs(heading - lag(heading) OVER w)) / 180e0, 0e0) AS dh FROM wts WINDOW w AS (PARTITION BY traj_id ORDER BY pos)),
tw AS (SELECT *, 1 + 8 * turn_score + 4 * dh + 2 * dv / max(dv) OVER () AS rawt, CASE WHEN speed <= quantile_cont(speed, 0.3) OVER () THEN 1e0 ELSE 0e0 END AS slow FROM chg),
pw AS (SELECT *, rawt / sum(rawt) OVER () AS turn, 0.35e0 * density + 0.35e0 * endpoint + 0.30e0 * slow / sum(slow) OVER () AS rawp FROM tw),
weights AS (SELECT *, rawp / sum(rawp) OVER () AS port, 1e0 / count(*) OVER () AS uniform FROM pw)"""

for _id, _kind, _col in (
    ("f1_density_weights", "density_route", "density"),
    ("f2_sparse_weights", "sparse_background_control", "sparse"),
    ("f3_endpoint_weights", "boundary_entry_exit", "endpoint"),
    ("f4_turn_weights", "crossing_turn_change", "turn"),
    ("f5_port_weights", "port_or_approach_zone", "port"),
    ("f6_uniform_mode", "uniform", "uniform"),
):

    @check(_id, f"WITH {POINTS_SQL}, {_CELL_SQL} SELECT traj_id, pos, round({_col}, 12) AS weight FROM weights")
    def _(spark, sf, kind=_kind):
        return workload.anchor_weights(points(spark, sf), kind).select("traj_id", "pos", r("weight", 12).alias("weight"))


def hash_sql(payload):
    return f"CAST(('0x' || substr(sha256({payload}), 1, 16)) AS UBIGINT)::DOUBLE / 18446744073709551616e0"


@check("f7_sample_anchors", f"""WITH {POINTS_SQL}, slots AS (SELECT CAST(traj_id AS INT) AS slot, {hash_sql("'draw|' || traj_id")} AS u FROM points WHERE pos = 0),
   placed AS (SELECT traj_id, pos, 1 + 8 * turn_score AS w, (traj_id * 7919 + pos) % CAST(ceil(count(*) OVER () / 500e0) AS BIGINT) AS part FROM points),
   ordered AS (SELECT *, sum(w) OVER (ORDER BY part, traj_id, pos) AS upto, sum(w) OVER () AS total FROM placed)
   SELECT slot, o.traj_id, o.pos FROM slots s JOIN ordered o ON s.u * total < upto AND s.u * total >= upto - w""")
def _(spark, sf):
    p = points(spark, sf)
    slots = p.filter("pos = 0").select(F.col("traj_id").cast("int").alias("slot"), F.lit("w").alias("kind"), unit_hash("draw", F.col("traj_id")).alias("u"))
    weighted = p.select("traj_id", "pos", (1 + 8 * F.col("turn_score")).alias("w"))
    return workload.sample_anchors(weighted, slots, rows_per_part=500).select("slot", "traj_id", "pos")


@check("f8_unit_hash", f"WITH {POINTS_SQL} SELECT traj_id, pos, {hash_sql("'ns|7|' || traj_id || '|' || pos")} AS u FROM points")
def _(spark, sf):
    return points(spark, sf).select("traj_id", "pos", unit_hash("ns", 7, F.col("traj_id"), F.col("pos")).alias("u"))


_QUOTA_SQL = f"""{REPORTS_SQL}, fam AS (SELECT ship_type AS family, count(*)::DOUBLE AS weight FROM reports GROUP BY ship_type),
   ex AS (SELECT family, weight, row_number() OVER (ORDER BY family) - 1 AS place, 250e0 * weight / sum(weight) OVER () AS e FROM fam),
   quota AS (SELECT family, place, CAST(floor(e) AS BIGINT) + CASE WHEN row_number() OVER (ORDER BY e - floor(e) DESC, weight DESC, place) <= 250 - sum(floor(e)) OVER () THEN 1 ELSE 0 END AS quota FROM ex)"""


def _families(spark, sf):
    counts = reports(spark, sf).groupBy(F.col("ship_type").alias("family")).agg(F.count(F.lit(1)).cast("double").alias("weight"))
    names = sorted(x[0] for x in counts.select("family").collect())
    places = spark.createDataFrame(list(enumerate(names)), "place int, family string")
    return counts.join(F.broadcast(places), "family")


@check("f9_family_quotas", f"WITH {_QUOTA_SQL} SELECT family, quota FROM quota")
def _(spark, sf):
    return workload.family_quotas(_families(spark, sf), 250).select("family", "quota")


@check("f9_quota_sequence", f"""WITH {_QUOTA_SQL}, items AS (SELECT family, row_number() OVER (ORDER BY place, k) - 1 AS item FROM quota, range(1, 300) AS g(k) WHERE k <= quota)
   SELECT family, row_number() OVER (ORDER BY {hash_sql("'ns|5|' || item")}, item) - 1 AS slot FROM items""")
def _(spark, sf):
    return workload.quota_sequence(_families(spark, sf), 250, 5, "ns")


@check("f10_f12_profile_boxes", f"""WITH {POINTS_SQL}, fp AS (SELECT * FROM (VALUES (0, 'small_local', 1e0, 1e0, false), (1, 'medium_operational', 2.2e0, 5e0, false),
     (2, 'large_context', 4.5e0, 10e0, false), (3, 'route_corridor_like', 3e0, 6e0, true)) AS v(i, family, km, hours, stretched)),
   e AS (SELECT min(t) AS t0, max(t) AS t1, min(lat) AS a0, max(lat) AS a1, min(lon) AS o0, max(lon) AS o1 FROM points),
   w AS (SELECT p.*, e.*, fp.family, stretched, abs(sin(radians(heading % 180))) >= abs(cos(radians(heading % 180))) AS ew,
        km / 111.32e0 AS dy, km / (111.32e0 * greatest(0.1e0, abs(cos(radians(lat))))) AS dx, hours * 3600 AS dt FROM points p JOIN fp ON fp.i = p.n_points % 4, e WHERE pos = 0),
   s AS (SELECT *, dy * CASE WHEN NOT stretched THEN 1 WHEN ew THEN 0.45e0 ELSE 2.5e0 END AS h, dx * CASE WHEN NOT stretched THEN 1 WHEN ew THEN 2.5e0 ELSE 0.45e0 END AS v FROM w)
   SELECT traj_id AS slot, family AS footprint_family, round(greatest(a0, lat - h), 8) AS lat_min, round(least(a1, lat + h), 8) AS lat_max,
     round(greatest(o0, lon - v), 8) AS lon_min, round(least(o1, lon + v), 8) AS lon_max,
     greatest(t0, floor(t / 86400) * 86400, t - dt) AS t_start, least(t1, floor(t / 86400) * 86400 + 86400, t + dt) AS t_end,
     CASE WHEN NOT stretched THEN 'none' WHEN ew THEN 'east_west' ELSE 'north_south' END AS corridor_axis FROM s""")
def _(spark, sf):
    p = points(spark, sf)
    names = F.array(*[F.lit(f) for f in workload.FOOTPRINTS])
    family = F.element_at(names, (F.col("n_points") % 4 + 1).cast("int"))
    anchors = p.filter("pos = 0").select(F.col("traj_id").alias("slot"), "t", "lat", "lon", "heading", family.alias("footprint_family"))
    anchors = anchors.join(F.broadcast(workload.profile_table(spark).drop("weight")), "footprint_family")
    from tracklake.operators.tracks import extent

    b = workload.make_boxes(anchors, extent(p), time_domain="anchor_day")
    return b.select("slot", "footprint_family", "t_start", "t_end", "corridor_axis", *_rounded(("lat_min", "lat_max", "lon_min", "lon_max"), 8))


START_SQL = f"""{POINTS_SQL},
e AS (SELECT min(t) AS t0, max(t) AS t1, min(lat) AS a0, max(lat) AS a1, min(lon) AS o0, max(lon) AS o1 FROM points),
starts AS (SELECT CAST(traj_id AS INT) AS query_id, traj_id, greatest(a0, lat - 0.02e0 * (a1 - a0) * jl) AS lat_min, least(a1, lat + 0.02e0 * (a1 - a0) * jl) AS lat_max,
   greatest(o0, lon - 0.02e0 * (o1 - o0) * jo) AS lon_min, least(o1, lon + 0.02e0 * (o1 - o0) * jo) AS lon_max,
   greatest(t0, t - 0.1e0 * (t1 - t0) * jt) AS t_start, least(t1, t + 0.1e0 * (t1 - t0) * jt) AS t_end FROM (
   SELECT *, 1 + 0.25e0 * (2 * {hash_sql("'jitter|lat|9|' || traj_id")} - 1) AS jl, 1 + 0.25e0 * (2 * {hash_sql("'jitter|lon|9|' || traj_id")} - 1) AS jo,
          1 + 0.25e0 * (2 * {hash_sql("'jitter|time|9|' || traj_id")} - 1) AS jt FROM points WHERE pos = 0), e)"""


def starts(spark, sf):
    """A jittered box around the start of every track."""
    from tracklake.operators.tracks import extent

    def make():
        p = points(spark, sf)
        anchors = p.filter("pos = 0").select(F.col("traj_id").cast("int").alias("slot"), "t", "lat", "lon", "heading")
        b = workload.make_boxes(anchors, materialize(extent(p)), seed=9, jitter=0.25, spatial_fraction=0.02, time_fraction=0.1)
        return b.select(F.col("slot").alias("query_id"), *ranges.BOX_COLUMNS)

    return shared(spark, sf, "starts", make)


@check("f11_make_boxes", f"WITH {START_SQL} SELECT query_id, {_rounded_sql(('lat_min', 'lat_max', 'lon_min', 'lon_max'), 8)}, {_rounded_sql(('t_start', 't_end'), 4)} FROM starts")
def _(spark, sf):
    return starts(spark, sf).select("query_id", *_rounded(("lat_min", "lat_max", "lon_min", "lon_max"), 8), *_rounded(("t_start", "t_end"), 4))


@check("f13_overlap_patterns", f"""WITH {HITS_SQL}, p AS (SELECT traj_id, pos, string_agg(CAST(query_id AS VARCHAR), ',' ORDER BY query_id) AS pattern FROM hits GROUP BY ALL)
   SELECT pattern, count(*) AS points FROM p GROUP BY pattern""")
def _(spark, sf):
    pat = workload.overlap_patterns(ranges.query_hits(points(spark, sf), boxes(spark)))
    return pat.select(F.array_join(F.transform("pattern", lambda x: x.cast("string")), ",").alias("pattern"), "points")


@check("f13_accept_queries", f"""WITH RECURSIVE {HITS_SQL}, n AS (SELECT q.query_id, count(h.pos) AS hits, count(DISTINCT h.traj_id) AS tr, count(h.pos) / (SELECT count(*) FROM points)::DOUBLE AS share
   FROM boxes q LEFT JOIN hits h USING (query_id) GROUP BY q.query_id),
   judged AS (SELECT query_id, CASE WHEN hits < 3 THEN 'too_few_point_hits' WHEN tr < 1 THEN 'too_few_trajectory_hits' WHEN share > 0.5e0 THEN 'too_broad' END AS why FROM n)
   SELECT query_id, coalesce(why, CASE WHEN query_id = 3 THEN 'near_duplicate' ELSE 'accepted' END) AS reason FROM judged""")
def _(spark, sf):
    done = workload.accept_queries(points(spark, sf), boxes(spark), workload.Limits(3, 1, 0.5, None, None, 0.65), max_coverage=1.0)
    return spark.createDataFrame(done.log, "query_id int, reason string")


@check("f14_generate_workload")
def _(spark, sf):
    w = workload.generate_workload(points(spark, sf), 8, seed=3, profile_id="free", target_coverage=0.10, coverage_tolerance=0.05, max_queries=24,
                                   spatial_km=30.0, time_hours=72.0, limits=workload.Limits(3, 1, 0.2, None, None, 0.65))
    return w.queries.select("query_id", "draw_id", *ranges.BOX_COLUMNS)


@check("f14_profile_workload")
def _(spark, sf):
    w = workload.generate_workload(points(spark, sf), 4, seed=3, max_attempts=60, limits=workload.Limits(1, 1, 0.05, None, None, 0.65))
    return w.stats


@check("f15_shuffle_queries", f"""WITH {START_SQL} SELECT query_id AS draw_id, CAST(row_number() OVER (ORDER BY {hash_sql("'order|4|' || query_id")}, query_id) - 1 AS INT) AS query_id FROM starts""")
def _(spark, sf):
    return workload.shuffle_queries(starts(spark, sf), 4).select("draw_id", "query_id")


_IOU_SQL = """iou AS (SELECT q.query_id, e.query_id AS earlier_id, i / (vq + ve - i) AS iou FROM (SELECT *, (lat_max - lat_min) * (lon_max - lon_min) * (t_end - t_start) AS vq FROM {src}) q
   JOIN (SELECT *, (lat_max - lat_min) * (lon_max - lon_min) * (t_end - t_start) AS ve FROM {src}) e ON e.query_id < q.query_id,
   LATERAL (SELECT greatest(0, least(q.lat_max, e.lat_max) - greatest(q.lat_min, e.lat_min)) * greatest(0, least(q.lon_max, e.lon_max) - greatest(q.lon_min, e.lon_min))
     * greatest(0, least(q.t_end, e.t_end) - greatest(q.t_start, e.t_start)) AS i) WHERE i > 0)"""

DIAG_SQL = START_SQL + ", " + _IOU_SQL.format(src="starts") + """,
dhits AS (SELECT q.query_id, p.traj_id, p.pos FROM points p JOIN starts q ON p.t BETWEEN t_start AND t_end AND p.lat BETWEEN lat_min AND lat_max AND p.lon BETWEEN lon_min AND lon_max),
dn AS (SELECT s.*, count(h.pos) AS point_hits, count(DISTINCT h.traj_id) AS track_hits FROM (SELECT * EXCLUDE (traj_id) FROM starts) s LEFT JOIN dhits h USING (query_id) GROUP BY ALL),
fd AS (SELECT query_id, min(earlier_id) AS near_duplicate_of FROM iou WHERE iou >= 0.3 GROUP BY query_id),
bd AS (SELECT i.query_id, max(i.iou) AS near_duplicate_iou FROM iou i LEFT JOIN fd ON fd.query_id = i.query_id WHERE fd.near_duplicate_of IS NULL OR i.earlier_id <= fd.near_duplicate_of GROUP BY i.query_id),
diag AS (SELECT dn.query_id, point_hits, track_hits, point_hits / (SELECT count(*) FROM points)::DOUBLE AS point_share, track_hits / (SELECT count(DISTINCT traj_id) FROM points)::DOUBLE AS track_share,
  least(1, (lat_max - lat_min) / (a1 - a0)) * least(1, (lon_max - lon_min) / (o1 - o0)) * least(1, (t_end - t_start) / (t1 - t0)) AS volume_share,
  point_hits = 0 AS is_empty, point_hits / (SELECT count(*) FROM points)::DOUBLE > 0.01 AS is_too_broad, fd.near_duplicate_of, coalesce(bd.near_duplicate_iou, 0) AS near_duplicate_iou, t_end - t_start AS secs
  FROM dn LEFT JOIN fd USING (query_id) LEFT JOIN bd USING (query_id), e)"""

@check("f13_rejection_counts", f"""WITH RECURSIVE {HITS_SQL}, {_IOU_SQL.format(src='boxes')}, n AS (SELECT q.query_id, count(h.pos) AS hits, count(DISTINCT h.traj_id) AS tr, count(h.pos) / (SELECT count(*) FROM points)::DOUBLE AS share
   FROM boxes q LEFT JOIN hits h USING (query_id) GROUP BY q.query_id),
   judged AS (SELECT query_id, CASE WHEN hits < 3 THEN 'too_few_point_hits' WHEN tr < 1 THEN 'too_few_trajectory_hits' WHEN share > 0.5e0 THEN 'too_broad' END AS why,
     (SELECT list(earlier_id) FROM iou i WHERE i.query_id = n.query_id AND i.iou >= 0.65e0) AS alike FROM n),
   replay AS (SELECT -1 AS query_id, []::INT[] AS accepted, 'accepted' AS reason UNION ALL
     SELECT query_id, CASE WHEN reason = 'accepted' THEN list_append(accepted, query_id) ELSE accepted END, reason FROM (
       SELECT j.query_id, s.accepted, coalesce(j.why, CASE WHEN list_has_any(s.accepted, coalesce(j.alike, [])) THEN 'near_duplicate' ELSE 'accepted' END) AS reason
       FROM replay s JOIN judged j ON j.query_id = s.query_id + 1))
   SELECT reason, family, count(*) AS rejected FROM (SELECT reason, CASE WHEN query_id % 2 = 0 THEN 'even' ELSE 'odd' END AS family FROM replay WHERE reason <> 'accepted') GROUP BY GROUPING SETS ((reason), (reason, family))""")
def _(spark, sf):
    candidates = boxes(spark).withColumn("family", F.when(F.col("query_id") % 2 == 0, "even").otherwise("odd"))
    done = workload.accept_queries(points(spark, sf), candidates, workload.Limits(3, 1, 0.5, None, None, 0.65), max_coverage=1.0)
    return workload.rejection_counts(candidates, done.log, ["family"])


LIMITS = workload.Limits(max_point_share=0.01, duplicate_iou=0.3)


def diag(spark, sf):
    return shared(spark, sf, "diag", lambda: diagnostics.query_diagnostics(points(spark, sf), starts(spark, sf), LIMITS))


@check("g1_box_iou", f"WITH {START_SQL}, {_IOU_SQL.format(src='starts')} SELECT query_id, earlier_id, round(iou, 8) AS iou FROM iou WHERE iou > 1e-6")
def _(spark, sf):
    # rounded as the SQL does it, half up on the binary number; F.round goes by way of decimals, which takes longer than the rest
    v = F.col("iou") * 1e8
    rounded = (F.floor(v) + F.when(v - F.floor(v) >= 0.5, 1).otherwise(0)) / 1e8
    return diagnostics.box_iou(starts(spark, sf)).filter("iou > 1e-6").select("query_id", "earlier_id", rounded.alias("iou"))


@check("g2_query_diagnostics", f"""WITH {DIAG_SQL} SELECT query_id, point_hits, track_hits, round(point_share, 9) AS point_share, round(track_share, 9) AS track_share, round(volume_share, 9) AS volume_share,
   is_empty, is_too_broad, coalesce(near_duplicate_of, -1) AS near_duplicate_of, round(near_duplicate_iou, 8) AS near_duplicate_iou FROM diag""")
def _(spark, sf):
    d = diagnostics.query_diagnostics(points(spark, sf), starts(spark, sf), LIMITS)
    return d.select("query_id", "point_hits", "track_hits", "is_empty", "is_too_broad", F.coalesce("near_duplicate_of", F.lit(-1)).alias("near_duplicate_of"),
                    *_rounded(("point_share", "track_share", "volume_share"), 9), r("near_duplicate_iou", 8).alias("near_duplicate_iou"))


_Q = [f"{c}_p{q}" for c in ("point_hits", "track_hits", "point_share", "track_share", "volume_share") for q in (10, 50, 90)]
_SUMMARY_SQL = "count(*) AS query_count, avg(is_empty::INT) AS empty_query_rate, avg(is_too_broad::INT) AS too_broad_query_rate, avg((near_duplicate_of IS NOT NULL)::INT) AS near_duplicate_query_rate, " + ", ".join(
    f"quantile_cont({c}, {q / 100}) AS {c}_p{q}" for c in ("point_hits", "track_hits", "point_share", "track_share", "volume_share") for q in (10, 50, 90))
_RATES = ["empty_query_rate", "too_broad_query_rate", "near_duplicate_query_rate"]


@check("g3_diagnostics_summary", f"WITH {DIAG_SQL}, s AS (SELECT {_SUMMARY_SQL} FROM diag) SELECT query_count, {_rounded_sql(_RATES + _Q, 8)} FROM s")
def _(spark, sf):
    return diagnostics.diagnostics_summary(diag(spark, sf)).select("query_count", *_rounded(_RATES + _Q, 8))


@check("f16_workload_signature", f"""WITH {DIAG_SQL}, s AS (SELECT {_SUMMARY_SQL}, quantile_cont(secs / 3600, 0.1) AS hours_p10, quantile_cont(secs / 3600, 0.5) AS hours_p50, quantile_cont(secs / 3600, 0.9) AS hours_p90 FROM diag),
   c AS (SELECT count(*) AS n FROM (SELECT DISTINCT traj_id, pos FROM dhits)) SELECT query_count, round(n / (SELECT count(*) FROM points)::DOUBLE, 9) AS coverage, {_rounded_sql(_RATES + ['point_hits_p50', 'hours_p10', 'hours_p50', 'hours_p90'], 6)} FROM s, c""")
def _(spark, sf):
    s = workload.workload_signature(points(spark, sf), starts(spark, sf), LIMITS)
    return s.select("query_count", r("coverage").alias("coverage"), *_rounded(_RATES + ["point_hits_p50", "hours_p10", "hours_p50", "hours_p90"], 6))


@check("f17_estimate_coverage")
def _(spark, sf):
    return workload.estimate_coverage(points(spark, sf), [4, 8], [1], profile_id="free", spatial_km=30.0, time_hours=48.0, limits=workload.Limits())


@check("f18_replicated_workloads")
def _(spark, sf):
    q, _ = workload.replicated_workloads(points(spark, sf), 2, 3, modes=["dense", "sparse"], footprints=["20:24", "40:48"], profile_id="free", limits=workload.Limits())
    return q.select("workload_id", "query_id", *ranges.BOX_COLUMNS)


@check("f19_coverage_warnings", f"""WITH {POINTS_SQL}, c AS (SELECT source_id AS workload_id, count(*) / (SELECT count(*) FROM points)::DOUBLE AS coverage FROM points GROUP BY source_id)
   SELECT workload_id, round(coverage, 9) AS coverage FROM c WHERE abs(coverage - 0.33e0) > 0.01e0""")
def _(spark, sf):
    p = points(spark, sf)
    total = p.select(F.count(F.lit(1))).scalar()
    c = p.groupBy(F.col("source_id").alias("workload_id")).agg((F.count(F.lit(1)) / F.first(total)).alias("coverage"))
    return workload.coverage_warnings(c, 33.0, 0.01).withColumn("coverage", r("coverage"))


@check("f19_coverage_by_group", f"""WITH {POINTS_SQL}, c AS (SELECT CAST(traj_id % 7 AS INT) AS workload_id, count(*) / (SELECT count(*) FROM points)::DOUBLE AS coverage FROM points GROUP BY 1)
   SELECT workload_id, round(coverage, 9) AS coverage FROM c WHERE abs(coverage - 0.143e0) > 0.002e0""")
def _(spark, sf):
    p = points(spark, sf)
    total = p.select(F.count(F.lit(1))).scalar()
    c = p.groupBy((F.col("traj_id") % 7).cast("int").alias("workload_id")).agg((F.count(F.lit(1)) / F.first(total)).alias("coverage"))
    return workload.coverage_warnings(c, 14.3, 0.002).withColumn("coverage", r("coverage"))


_SIDES = "a AS (SELECT * FROM diag WHERE query_id < (SELECT max(query_id) / 2 FROM diag)), b AS (SELECT * FROM diag WHERE query_id >= (SELECT max(query_id) / 2 FROM diag))"


def _sides(spark, sf):
    d = diag(spark, sf)
    half = d.select(F.max("query_id") / 2).first()[0]
    return d.filter(F.col("query_id") < half), d.filter(F.col("query_id") >= half)


@check("g5_l1_distance", f"""WITH {REPORTS_SQL}, a AS (SELECT ship_type AS f, count(*) / (SELECT count(*) FROM reports WHERE source_id = 's0')::DOUBLE AS x FROM reports WHERE source_id = 's0' GROUP BY 1),
   c AS (SELECT ship_type AS f, count(*) / (SELECT count(*) FROM reports WHERE source_id = 's1')::DOUBLE AS x FROM reports WHERE source_id = 's1' GROUP BY 1)
   SELECT round(sum(abs(coalesce(a.x, 0) - coalesce(c.x, 0))), 9) AS l1 FROM a FULL JOIN c USING (f)""")
def _(spark, sf):
    rep = reports(spark, sf).withColumnRenamed("ship_type", "kind")
    sides = [workload.family_counts(rep.filter(F.col("source_id") == s), "kind") for s in ("s0", "s1")]
    return diagnostics.l1_distance(*sides).select(r("l1").alias("l1"))


@check("g6_quantile_linf", f"""WITH {DIAG_SQL}, {_SIDES}, q AS (SELECT (SELECT quantile_cont(point_hits, 0.1) FROM a) AS a1, (SELECT quantile_cont(point_hits, 0.5) FROM a) AS a5, (SELECT quantile_cont(point_hits, 0.9) FROM a) AS a9,
   (SELECT quantile_cont(point_hits, 0.1) FROM b) AS b1, (SELECT quantile_cont(point_hits, 0.5) FROM b) AS b5, (SELECT quantile_cont(point_hits, 0.9) FROM b) AS b9)
   SELECT round(greatest(abs(a1 - b1) / greatest(a1, b1, 1), abs(a5 - b5) / greatest(a5, b5, 1), abs(a9 - b9) / greatest(a9, b9, 1)), 9) AS linf FROM q""".replace("b AS (SELECT * FROM diag", "b_ AS (SELECT * FROM diag").replace("FROM b)", "FROM b_)"))
def _(spark, sf):
    from tracklake.operators.tracks import one_row

    rows = [diagnostics.diagnostics_summary(s).select(*[F.col(f"point_hits_p{q}").alias(f"{t}{q}") for q in (10, 50, 90)]) for t, s in zip("ab", _sides(spark, sf))]
    pairs = [(F.col(f"a{q}"), F.col(f"b{q}")) for q in (10, 50, 90)]
    return one_row(*rows).select(r(diagnostics.quantile_linf(pairs)).alias("linf"))


@check("g7_ks_distance", f"""WITH {DIAG_SQL}, {_SIDES}, v AS (SELECT DISTINCT point_hits AS x FROM diag)
   SELECT round(max(abs((SELECT count(*) FROM a WHERE point_hits <= x) / (SELECT count(*) FROM a)::DOUBLE - (SELECT count(*) FROM b WHERE point_hits <= x) / (SELECT count(*) FROM b)::DOUBLE)), 9) AS ks FROM v""".replace("b AS (SELECT * FROM diag", "b_ AS (SELECT * FROM diag").replace("FROM b WHERE", "FROM b_ WHERE").replace("FROM b)", "FROM b_)"))
def _(spark, sf):
    a, b = _sides(spark, sf)
    return diagnostics.ks_distance(a, b, "point_hits").select(r("ks").alias("ks"))


def _ks_sql(column: str) -> str:
    return f"""(SELECT max(abs((SELECT count(*) FROM a WHERE {column} <= x) / (SELECT count(*) FROM a)::DOUBLE - (SELECT count(*) FROM b_ WHERE {column} <= x) / (SELECT count(*) FROM b_)::DOUBLE))
     FROM (SELECT DISTINCT {column} AS x FROM diag))"""


_GATE_SQL = f"""gate AS (SELECT (SELECT sum(abs(coalesce(x.s, 0) - coalesce(y.s, 0))) FROM (SELECT query_id % 5 AS f, count(*) / (SELECT count(*) FROM a)::DOUBLE AS s FROM a GROUP BY 1) x
     FULL JOIN (SELECT query_id % 5 AS f, count(*) / (SELECT count(*) FROM b_)::DOUBLE AS s FROM b_ GROUP BY 1) y USING (f)) AS l1,
   {_ks_sql('point_hits')} AS points_ks, {_ks_sql('track_hits')} AS ships_ks, (SELECT count(*) FROM a) AS na, (SELECT count(*) FROM b_) AS nb,
   greatest((SELECT avg((near_duplicate_of IS NOT NULL)::INT) FROM a), (SELECT avg((near_duplicate_of IS NOT NULL)::INT) FROM b_)) AS dup,
   greatest((SELECT avg(is_too_broad::INT) FROM a), (SELECT avg(is_too_broad::INT) FROM b_)) AS broad),
   failed AS (SELECT *, concat_ws(',', CASE WHEN l1 > 0.12e0 THEN 'anchor_family_l1_distance' END, CASE WHEN points_ks > 0.2e0 THEN 'point_hit_distribution_ks' END,
     CASE WHEN ships_ks > 0.2e0 THEN 'ship_hit_distribution_ks' END, CASE WHEN dup > 0.05e0 THEN 'near_duplicate_rate' END, CASE WHEN broad > 0.05e0 THEN 'broad_query_rate' END,
     CASE WHEN na < 8 THEN 'train_query_count' END, CASE WHEN nb < 8 THEN 'eval_query_count' END) AS failed_checks FROM gate)"""


@check("g8_signature_gate", f"""WITH {DIAG_SQL}, {_SIDES.replace('b AS (SELECT', 'b_ AS (SELECT')}, {_GATE_SQL}
   SELECT failed_checks = '' AS gate_pass, failed_checks, round(points_ks, 9) AS point_hit_distribution_ks, round(ships_ks, 9) AS ship_hit_distribution_ks, round(l1, 9) AS anchor_family_l1_distance,
     round(dup, 9) AS near_duplicate_rate, round(broad, 9) AS broad_query_rate, na AS train_query_count, nb AS eval_query_count FROM failed""")
def _(spark, sf):
    a, b = _sides(spark, sf)
    q = starts(spark, sf).withColumn("anchor_family", (F.col("query_id") % 5).cast("string"))
    sums = [diagnostics.diagnostics_summary(d) for d in (a, b)]
    halves = [q.join(d.select("query_id"), "query_id", "left_semi") for d in (a, b)]
    gate = diagnostics.signature_gate(*sums, a, b, *halves)
    measured = ("point_hit_distribution_ks", "ship_hit_distribution_ks", "anchor_family_l1_distance", "near_duplicate_rate", "broad_query_rate")
    return gate.select("gate_pass", F.array_join("failed_checks", ",").alias("failed_checks"), *_rounded(measured, 9), "train_query_count", "eval_query_count")


@check("g9_compare_distributions", f"""WITH {DIAG_SQL}, {_SIDES.replace('b AS', 'b_ AS')}, sa AS (SELECT {_SUMMARY_SQL} FROM a), sb AS (SELECT {_SUMMARY_SQL} FROM b_),
   la AS (UNPIVOT (SELECT query_count::DOUBLE AS query_count, empty_query_rate, point_hits_p50::DOUBLE AS point_hits_p50, volume_share_p90 FROM sa) ON COLUMNS(*) INTO NAME field VALUE value),
   lb AS (UNPIVOT (SELECT query_count::DOUBLE AS query_count, empty_query_rate, point_hits_p50::DOUBLE AS point_hits_p50, volume_share_p90 FROM sb) ON COLUMNS(*) INTO NAME field VALUE value)
   SELECT 'train' AS label, field, round(la.value, 8) AS value, round(la.value - lb.value, 8) AS delta FROM la JOIN lb USING (field)""")
def _(spark, sf):
    a, b = (diagnostics.diagnostics_summary(d).withColumn("label", F.lit(n)) for d, n in zip(_sides(spark, sf), ("train", "eval")))
    c = diagnostics.compare_distributions(a.unionByName(b), ("query_count", "empty_query_rate", "point_hits_p50", "volume_share_p90"))
    return c.select("label", "field", r("value", 8).alias("value"), r("delta", 8).alias("delta"))


@check("g10_stability_gate", f"""WITH {POINTS_SQL}, st AS (SELECT source_id AS workload_id, 'profile_v1' AS profile_id, count(*) FILTER (pos = 0) AS queries, count(*) AS attempts,
     count(*) / (SELECT count(*) FROM points)::DOUBLE AS coverage FROM points GROUP BY source_id)
   SELECT workload_id, round(1 - queries / attempts::DOUBLE, 9) AS rejection_rate, round(coverage - 0.33e0, 9) AS overshoot,
     concat_ws(',', CASE WHEN coverage < 0.33e0 THEN 'coverage' END, CASE WHEN 1 - queries / attempts::DOUBLE > 0.85e0 THEN 'rejection_rate' END, CASE WHEN coverage - 0.33e0 > 0.02e0 + 1e-12 THEN 'overshoot' END) AS failed_checks FROM st""")
def _(spark, sf):
    p = points(spark, sf)
    total = p.select(F.count(F.lit(1))).scalar()
    st = p.groupBy(F.col("source_id").alias("workload_id")).agg(
        F.lit("profile_v1").alias("profile_id"), F.count_if(F.col("pos") == 0).alias("queries"), F.count(F.lit(1)).alias("attempts"),
        (F.count(F.lit(1)) / F.first(total)).alias("coverage"), F.lit(0.35).alias("guard"))
    g = diagnostics.stability_gate(st, "profile_v1", 0.33)
    return g.select("workload_id", r("rejection_rate").alias("rejection_rate"), r("overshoot").alias("overshoot"), F.array_join("failed_checks", ",").alias("failed_checks"))
