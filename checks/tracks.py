"""Track model and range queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from tracklake.operators import ranges, tracks

from .fixtures import HITS_SQL, MAX_GAP_S, POINTS_SQL, REPORTS_SQL, boxes, points, reports
from .registry import check


def r(c, digits=9):
    return F.round(c, digits)


@check(
    "d1_segment",
    f"""WITH {POINTS_SQL} SELECT report_id, rank, segment FROM segmented""",
)
def _(spark, sf):
    valid = tracks.loader_validity(reports(spark, sf))
    return tracks.segment(valid, MAX_GAP_S).select("report_id", "rank", "segment")


@check(
    "d1_segment_no_limit",
    f"""WITH {POINTS_SQL} SELECT mmsi, count(*) AS n FROM valid GROUP BY mmsi""",
)
def _(spark, sf):
    valid = tracks.loader_validity(reports(spark, sf))
    return tracks.segment(valid, None).groupBy("mmsi", "segment").count().select("mmsi", F.col("count").alias("n"))


@check(
    "d2_drop_short",
    f"""WITH {POINTS_SQL} SELECT report_id, n_points, pos FROM sized WHERE n_points >= 10""",
)
def _(spark, sf):
    valid = tracks.loader_validity(reports(spark, sf))
    sized = tracks.segment_sizes(tracks.segment(valid, MAX_GAP_S))
    return tracks.drop_short(sized, 10).select("report_id", "n_points", "pos")


@check(
    "d3_downsample",
    f"""WITH {POINTS_SQL},
    kept AS (SELECT traj_id, i, CAST(floor(i * (n_points - 1) / 5) AS BIGINT) AS old_pos
             FROM (SELECT DISTINCT traj_id, n_points FROM points WHERE n_points > 6), range(6) AS g(i))
    SELECT p.report_id, CAST(coalesce(k.i, p.pos) AS BIGINT) AS pos,
           CASE WHEN p.n_points > 6 THEN CAST(6 AS BIGINT) ELSE p.n_points END AS n_points
    FROM points p LEFT JOIN kept k ON k.traj_id = p.traj_id AND k.old_pos = p.pos
    WHERE p.n_points <= 6 OR k.i IS NOT NULL""",
)
def _(spark, sf):
    return tracks.downsample(points(spark, sf), 6).select("report_id", "pos", "n_points")


@check(
    "d4_d5_flags_and_turns",
    f"""WITH {POINTS_SQL} SELECT traj_id, pos, is_start, is_end, round(turn_score, 9) AS turn_score FROM points""",
)
def _(spark, sf):
    bare = points(spark, sf).drop("is_start", "is_end", "turn_score")
    done = tracks.turn_score(tracks.start_end_flags(bare))
    return done.select("traj_id", "pos", "is_start", "is_end", r("turn_score").alias("turn_score"))


@check(
    "d6_points",
    f"""WITH {POINTS_SQL} SELECT traj_id, pos, mmsi, report_id, n_points, t, round(lat, 9) AS lat,
    round(lon, 9) AS lon, speed, heading, CAST(to_timestamp(t) AT TIME ZONE 'UTC' AS DATE)::VARCHAR AS day FROM points""",
)
def _(spark, sf):
    valid = tracks.loader_validity(reports(spark, sf))
    p = tracks.build_points(valid, MAX_GAP_S, 4)
    day = F.date_add(F.lit("1970-01-01").cast("date"), F.floor(F.col("t") / 86400).cast("int")).cast("string")
    return p.select("traj_id", "pos", "mmsi", "report_id", "n_points", "t", r("lat").alias("lat"),
                    r("lon").alias("lon"), "speed", "heading", day.alias("day"))


@check(
    "d7_load_audit",
    f"""WITH {POINTS_SQL},
    seg AS (SELECT mmsi, segment, count(*) AS n FROM segmented GROUP BY ALL),
    dup AS (SELECT count(*) AS c FROM reports GROUP BY mmsi, t HAVING count(*) > 1)
    SELECT (SELECT count(*) FROM reports) AS rows_loaded,
           (SELECT count(DISTINCT mmsi) FROM reports) AS vessels,
           (SELECT count(*) FROM reports WHERE t IS NULL) AS rows_bad_time,
           (SELECT count(*) FROM reports WHERE lat NOT BETWEEN -90 AND 90) AS rows_bad_lat,
           (SELECT count(*) FROM reports WHERE lon NOT BETWEEN -180 AND 180) AS rows_bad_lon,
           (SELECT count(*) FROM reports WHERE sog NOT BETWEEN 0 AND 102.2) AS rows_bad_speed,
           (SELECT count(*) FROM reports WHERE NOT (cog >= 0 AND cog < 360)) AS rows_bad_heading,
           (SELECT count(*) FROM reports) - (SELECT count(*) FROM valid) AS rows_invalid,
           (SELECT count(*) FROM valid) AS rows_valid,
           (SELECT CAST(coalesce(sum(c), 0) AS BIGINT) FROM dup) AS duplicate_time_rows,
           (SELECT count(*) FROM seg) AS segments,
           (SELECT count(*) FROM stepped WHERE gap > 86400) AS gap_splits,
           (SELECT count(*) FROM seg WHERE n < 4) AS short_segments,
           (SELECT CAST(sum(n) AS BIGINT) FROM seg WHERE n < 4) AS short_segment_rows,
           (SELECT count(*) FROM seg WHERE n >= 4) AS segments_kept,
           (SELECT count(*) FROM seg WHERE n > 20) AS segments_downsampled,
           (SELECT CAST(sum(n) AS BIGINT) FROM seg WHERE n >= 4) AS points_before_downsampling,
           (SELECT CAST(sum(least(n, 20)) AS BIGINT) FROM seg WHERE n >= 4) AS points_kept""",
)
def _(spark, sf):
    return tracks.load_audit(reports(spark, sf), MAX_GAP_S, 4, 20)


@check(
    "d8_summary_stats",
    f"""WITH {POINTS_SQL} SELECT count(speed) AS count, min(speed) AS min, max(speed) AS max, round(avg(speed), 9) AS mean,
    round(quantile_cont(speed, 0.5), 9) AS p50, round(quantile_cont(speed, 0.75), 9) AS p75,
    round(quantile_cont(speed, 0.95), 9) AS p95, round(quantile_cont(speed, 0.99), 9) AS p99 FROM points""",
)
def _(spark, sf):
    s = tracks.summary_stats(points(spark, sf), "speed", ["traj_id", "pos"])
    return s.select("count", "min", "max", *[r(c).alias(c) for c in ("mean", "p50", "p75", "p95", "p99")])


_HASH = "CAST(('0x' || substr(sha256('{seed}|' || CAST(traj_id AS VARCHAR)), 1, 16)) AS UBIGINT)"


@check(
    "d9_split_trajectories",
    f"""WITH {POINTS_SQL},
    tr AS (SELECT traj_id, mmsi, n_points, source_id,
             row_number() OVER (ORDER BY CAST({_HASH.format(seed=7)} AS DOUBLE), traj_id) - 1 AS i,
             count(*) OVER () AS n FROM points WHERE pos = 0)
    SELECT traj_id, mmsi, n_points, source_id,
      CASE WHEN i < floor(n * 0.7e0) THEN 'train' WHEN i < floor(n * 0.7e0) + floor(n * 0.15e0) THEN 'validation' ELSE 'test' END AS split
    FROM tr""",
)
def _(spark, sf):
    return tracks.split_trajectories(points(spark, sf), 0.70, 0.15, seed=7)


@check(
    "d10_source_stratified_holdout",
    f"""WITH {POINTS_SQL},
    tr AS (SELECT traj_id, mmsi, n_points, source_id,
             row_number() OVER (PARTITION BY source_id ORDER BY CAST({_HASH.format(seed=3)} AS DOUBLE), traj_id) AS i,
             count(*) OVER (PARTITION BY source_id) AS n FROM points WHERE pos = 0)
    SELECT traj_id, mmsi, n_points, source_id, i <= least(greatest(floor(n * 0.2e0), 1), n - 1) AS holdout FROM tr""",
)
def _(spark, sf):
    return tracks.source_stratified_holdout(points(spark, sf), 0.2, seed=3)


@check(
    "d10b_random_holdout",
    f"""WITH {POINTS_SQL},
    tr AS (SELECT traj_id, mmsi, n_points, source_id,
             row_number() OVER (ORDER BY CAST({_HASH.format(seed=5)} AS DOUBLE), traj_id) - 1 AS i,
             count(*) OVER () AS n FROM points WHERE pos = 0)
    SELECT traj_id, mmsi, n_points, source_id, i < floor(n * 0.15e0) AS holdout FROM tr""",
)
def _(spark, sf):
    return tracks.random_holdout(points(spark, sf), 0.15, seed=5)


@check(
    "d10b_source_counts",
    f"""WITH {POINTS_SQL} SELECT source_id, count(*) AS tracks FROM points WHERE pos = 0 GROUP BY source_id""",
)
def _(spark, sf):
    return tracks.source_counts(points(spark, sf))


@check(
    "d11_chunk_windows",
    f"""WITH {POINTS_SQL},
    starts AS (SELECT traj_id, CAST(c AS BIGINT) AS chunk
               FROM (SELECT DISTINCT traj_id, n_points FROM points), range(100) AS g(c)
               WHERE c = 0 OR (c - 1) * 5 + 8 < n_points)
    SELECT p.traj_id, p.pos, s.chunk, s.chunk * 5 AS chunk_start, p.pos - s.chunk * 5 AS chunk_pos
    FROM points p JOIN starts s ON s.traj_id = p.traj_id AND p.pos >= s.chunk * 5 AND p.pos < s.chunk * 5 + 8""",
)
def _(spark, sf):
    out = tracks.chunk_windows(points(spark, sf), 8, 5)
    return out.select("traj_id", "pos", "chunk", "chunk_start", "chunk_pos")


@check(
    "d12_segment_blocks",
    f"""WITH {POINTS_SQL} SELECT traj_id, CAST(pos // 8 AS BIGINT) AS block, count(*) AS n, min(pos) AS first_pos
    FROM points GROUP BY ALL""",
)
def _(spark, sf):
    b = tracks.segment_blocks(points(spark, sf), 8)
    return b.groupBy("traj_id", "block").agg(F.count(F.lit(1)).alias("n"), F.min("pos").alias("first_pos"))


@check(
    "d13_extent",
    f"""WITH {POINTS_SQL} SELECT min(t) AS t_min, max(t) AS t_max, round(min(lat), 9) AS lat_min, round(max(lat), 9) AS lat_max,
    round(min(lon), 9) AS lon_min, round(max(lon), 9) AS lon_max FROM points""",
)
def _(spark, sf):
    e = tracks.extent(points(spark, sf))
    return e.select("t_min", "t_max", *[r(c).alias(c) for c in ("lat_min", "lat_max", "lon_min", "lon_max")])


@check(
    "a4b_relative_seconds",
    f"""WITH {REPORTS_SQL} SELECT report_id, t - (SELECT min(t) FROM reports) AS t_rel FROM reports""",
)
def _(spark, sf):
    return tracks.relative_seconds(reports(spark, sf)).select("report_id", "t_rel")


@check(
    "a7_loader_validity",
    f"""WITH {POINTS_SQL} SELECT report_id, cog FROM valid""",
)
def _(spark, sf):
    return tracks.loader_validity(reports(spark, sf)).select("report_id", "cog")


@check(
    "a17_sample_by_stride",
    f"""WITH {POINTS_SQL} SELECT traj_id, count(*) AS n FROM points WHERE traj_id % 7 = 0 GROUP BY traj_id""",
)
def _(spark, sf):
    return tracks.sample_by_stride(points(spark, sf), 7).groupBy("traj_id").agg(F.count(F.lit(1)).alias("n"))


@check(
    "a19_cap_trajectories",
    f"""WITH {POINTS_SQL} SELECT traj_id, count(*) AS n FROM points WHERE traj_id < 40 GROUP BY traj_id""",
)
def _(spark, sf):
    return tracks.cap_trajectories(points(spark, sf), 40).groupBy("traj_id").agg(F.count(F.lit(1)).alias("n"))


@check(
    "e1_e3_query_hits",
    f"""WITH {HITS_SQL} SELECT query_id, traj_id, pos, report_id FROM hits""",
)
def _(spark, sf):
    return ranges.query_hits(points(spark, sf), boxes(spark)).select("query_id", "traj_id", "pos", "report_id")


@check(
    "e2_range_query",
    f"""WITH {HITS_SQL} SELECT DISTINCT traj_id FROM hits WHERE query_id = 1""",
)
def _(spark, sf):
    box = boxes(spark).filter("query_id = 1").first().asDict()
    return ranges.range_query(points(spark, sf), box)


_SEG_SQL = f"""{HITS_SQL},
seg AS (
  SELECT * FROM (SELECT traj_id, pos, t, lat, lon, lead(t) OVER w AS t2, lead(lat) OVER w AS lat2, lead(lon) OVER w AS lon2
                 FROM points WINDOW w AS (PARTITION BY traj_id ORDER BY pos)) WHERE t2 IS NOT NULL
),
slab AS (
  SELECT q.query_id, s.traj_id, s.pos,
    greatest(0e0, CASE WHEN abs(t2-t) <= 1e-12 THEN 0e0 ELSE least((t_start-t)/(t2-t), (t_end-t)/(t2-t)) END,
      CASE WHEN abs(lat2-lat) <= 1e-12 THEN 0e0 ELSE least((lat_min-lat)/(lat2-lat), (lat_max-lat)/(lat2-lat)) END,
      CASE WHEN abs(lon2-lon) <= 1e-12 THEN 0e0 ELSE least((lon_min-lon)/(lon2-lon), (lon_max-lon)/(lon2-lon)) END) AS u_in,
    least(1e0, CASE WHEN abs(t2-t) <= 1e-12 THEN 1e0 ELSE greatest((t_start-t)/(t2-t), (t_end-t)/(t2-t)) END,
      CASE WHEN abs(lat2-lat) <= 1e-12 THEN 1e0 ELSE greatest((lat_min-lat)/(lat2-lat), (lat_max-lat)/(lat2-lat)) END,
      CASE WHEN abs(lon2-lon) <= 1e-12 THEN 1e0 ELSE greatest((lon_min-lon)/(lon2-lon), (lon_max-lon)/(lon2-lon)) END) AS u_out,
    (abs(t2-t) > 1e-12 OR t BETWEEN t_start AND t_end) AND (abs(lat2-lat) > 1e-12 OR lat BETWEEN lat_min AND lat_max)
      AND (abs(lon2-lon) > 1e-12 OR lon BETWEEN lon_min AND lon_max) AS possible,
    (t BETWEEN t_start AND t_end AND lat BETWEEN lat_min AND lat_max AND lon BETWEEN lon_min AND lon_max)
      AND (t2 BETWEEN t_start AND t_end AND lat2 BETWEEN lat_min AND lat_max AND lon2 BETWEEN lon_min AND lon_max) AS inside
  FROM seg s, boxes q
),
crossings AS (SELECT query_id, traj_id, pos FROM slab WHERE possible AND u_out >= u_in AND NOT inside),
brackets AS (SELECT query_id, traj_id, pos FROM crossings UNION SELECT query_id, traj_id, pos + 1 FROM crossings)"""

_BOUNDARY_SQL = """,
edge AS (
  SELECT query_id, traj_id, pos, lag(pos) OVER w IS DISTINCT FROM pos - 1 OR lead(pos) OVER w IS DISTINCT FROM pos + 1 AS is_boundary
  FROM hits WINDOW w AS (PARTITION BY query_id, traj_id ORDER BY pos)
)"""

SUPPORT_SQL = _SEG_SQL + _BOUNDARY_SQL


@check("e4_segment_crossings", f"WITH {_SEG_SQL} SELECT query_id, traj_id, pos FROM crossings")
def _(spark, sf):
    return ranges.segment_crossings(points(spark, sf), boxes(spark))


@check("e5_crossing_brackets", f"WITH {_SEG_SQL} SELECT query_id, traj_id, pos FROM brackets")
def _(spark, sf):
    return ranges.crossing_brackets(points(spark, sf), boxes(spark))


@check("e6_entry_exit_points", f"WITH {SUPPORT_SQL} SELECT query_id, traj_id, pos FROM edge WHERE is_boundary")
def _(spark, sf):
    h = ranges.hits_with_boundary(points(spark, sf), boxes(spark))
    return h.filter("is_boundary").select("query_id", "traj_id", "pos")


HAVERSINE_SQL = (
    "(2 * 6371e0 * atan2(sqrt(pow(sin(radians({b1} - {a1}) / 2), 2) + cos(radians({a1})) * cos(radians({b1}))"
    " * pow(sin(radians({b2} - {a2}) / 2), 2)), sqrt(1 - (pow(sin(radians({b1} - {a1}) / 2), 2)"
    " + cos(radians({a1})) * cos(radians({b1})) * pow(sin(radians({b2} - {a2}) / 2), 2)))))"
)


def hav(a1, a2, b1, b2):
    return HAVERSINE_SQL.format(a1=a1, a2=a2, b1=b1, b2=b2)


_STEP_SQL = f"""{POINTS_SQL},
steps AS (
  SELECT *, coalesce({hav('pa', 'po', 'lat', 'lon')}, 0e0) AS step_km FROM (
    SELECT *, lag(lat) OVER w AS pa, lag(lon) OVER w AS po FROM points WINDOW w AS (PARTITION BY traj_id ORDER BY pos))
)"""


@check("e7_distance_to_anchor",
       f"WITH {POINTS_SQL} SELECT traj_id, pos, round({hav('lat', 'lon', '55.2e0', '10.4e0')}, 4) AS anchor_km FROM points")
def _(spark, sf):
    return ranges.distance_to_anchor(points(spark, sf), 55.2, 10.4).select("traj_id", "pos", r("anchor_km", 4).alias("anchor_km"))


@check("e8_path_length", f"WITH {_STEP_SQL} SELECT traj_id, round(sum(step_km), 4) AS length_km FROM steps GROUP BY traj_id")
def _(spark, sf):
    return ranges.path_length(points(spark, sf)).select("traj_id", r("length_km", 4).alias("length_km"))


@check("e9_cumulative_length",
       f"WITH {_STEP_SQL} SELECT traj_id, pos, round(sum(step_km) OVER (PARTITION BY traj_id ORDER BY pos), 4) AS cum_km FROM steps")
def _(spark, sf):
    return ranges.cumulative_length(points(spark, sf)).select("traj_id", "pos", r("cum_km", 4).alias("cum_km"))


@check("e10_union_coverage",
       f"""WITH {HITS_SQL}, c AS (SELECT DISTINCT traj_id, pos FROM hits WHERE query_id > 0)
       SELECT (SELECT count(*) FROM c) AS covered_points, (SELECT count(*) FROM points) AS total_points,
              round((SELECT count(*) FROM c) / (SELECT count(*) FROM points)::DOUBLE, 9) AS coverage""")
def _(spark, sf):
    c = ranges.union_coverage(points(spark, sf), boxes(spark).filter("query_id > 0"))
    return c.select("covered_points", "total_points", r("coverage").alias("coverage"))


@check("e11_query_features",
       f"""WITH {HITS_SQL} SELECT q.query_id, u.i - 1 AS slot, u.v AS value, coalesce(h.n, 0) AS hits FROM boxes q
       LEFT JOIN (SELECT query_id, count(*) AS n FROM hits GROUP BY query_id) h ON h.query_id = q.query_id,
       (SELECT query_id, unnest([lat_min, lat_max, lon_min, lon_max, t_start, t_end, 0e0, 0e0, 0e0, 0e0, 0e0, 0e0]) AS v,
               unnest(range(1, 13)) AS i FROM boxes) u WHERE u.query_id = q.query_id""")
def _(spark, sf):
    counts = ranges.query_hits(points(spark, sf), boxes(spark)).groupBy("query_id").agg(F.count(F.lit(1)).alias("hits"))
    feats = ranges.query_features(boxes(spark)).join(counts, "query_id", "left")
    return feats.select("query_id", F.coalesce("hits", F.lit(0)).alias("hits"), F.posexplode("features").alias("slot", "value")).withColumn(
        "slot", F.col("slot").cast("bigint"))


@check("flagship_box_traffic",
       f"""WITH {HITS_SQL} SELECT query_id, traj_id, count(*) AS points_inside, min(t) AS t_first, max(t) AS t_last,
       round(avg(speed), 9) AS mean_speed FROM hits GROUP BY query_id, traj_id""")
def box_traffic(spark, sf):
    """Which tracks pass through each box, when, and with how many points."""
    return ranges.query_hits(points(spark, sf), boxes(spark)).groupBy("query_id", "traj_id").agg(
        F.count(F.lit(1)).alias("points_inside"),
        F.min("t").alias("t_first"),
        F.max("t").alias("t_last"),
        r(F.avg("speed")).alias("mean_speed"),
    )
