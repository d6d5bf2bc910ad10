"""Vessel reports, tracks and boxes derived from the driver's ``events`` table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracklake.functions.parsing import epoch_seconds_ntz
from tracklake.operators.tracks import build_points, loader_validity
from tracklake.plans.materialize import materialize
from tracklake.plans.ordered import rank_within, with_bound

MAX_GAP_S = 86400.0
MONTH = (1704067200.0, 1706745600.0)

# lat_min, lat_max, lon_min, lon_max, t_start, t_end of the six test boxes.
BOXES = [
    (54.0, 57.0, 9.0, 13.0, 1704067200.0, 1706745600.0),
    (54.5, 55.0, 9.5, 10.5, 1704067200.0, 1705276800.0),
    (55.0, 55.4, 10.0, 11.0, 1704672000.0, 1705276800.0),
    (55.0, 55.4, 10.0, 11.05, 1704672000.0, 1705276800.0),
    (0.0, 1.0, 0.0, 1.0, 1704067200.0, 1706745600.0),
    (58.0, 61.5, 14.0, 18.5, 1704067200.0, 1706745600.0),
]

_shared: dict[tuple, DataFrame] = {}


def shared(spark: SparkSession, sf_dir: str, name: str, make) -> DataFrame:
    """Derive a table once per session and folder, and write it for all later queries."""
    key = (spark.sparkContext.applicationId, sf_dir, name)
    if key not in _shared:
        _shared[key] = materialize(make())
    return _shared[key]


def reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Typed reports; the arithmetic plants jumps, stationary rows and bad headings."""

    def make() -> DataFrame:
        events = with_bound(spark.read.parquet(f"{sf_dir}/events.parquet"), "user_id")
        ranked = rank_within(events, ["user_id"], [F.col("ts"), F.col("event_id")], "k", "user_id")
        e, u, k = F.col("event_id"), F.col("user_id"), F.col("k") - 1
        jump = e % 41 == 7
        lat = F.lit(54.0) + F.lit(5e-2) * (u % 40) + F.lit(2e-2) * k + F.lit(3e-3) * ((k * 7) % 5)
        lon = F.lit(9.0) + F.lit(8e-2) * (u % 25) + F.lit(3e-2) * k + F.lit(4e-3) * ((k * 11) % 7)
        ship = (
            F.when((u % 17 == 0) | (e % 3 == 0), "Undefined")
            .when(u % 13 == 0, "SAR")
            .when(u % 3 == 0, "Cargo")
            .when(u % 3 == 1, "Tanker")
            .otherwise("Passenger")
        )
        return ranked.select(
            e.alias("report_id"),
            (F.lit(200000000) + u).cast("bigint").alias("mmsi"),
            "ts",
            epoch_seconds_ntz("ts").alias("t"),
            F.when(e % 29 == 3, "Base Station").otherwise("Class A").alias("mobile_type"),
            (lat + F.when(jump, 4.0).otherwise(0.0)).alias("lat"),
            (lon + F.when(jump, 5.0).otherwise(0.0)).alias("lon"),
            F.when(F.col("event_type") == "error", 0.0).otherwise(F.least("value", F.lit(60.0)) / 10.0).alias("sog"),
            ((e * 37) % 400).cast("double").alias("cog"),
            ship.alias("ship_type"),
            F.concat(F.lit("s"), (u % 3).cast("string")).alias("source_id"),
        )

    return shared(spark, sf_dir, "reports", make)


def reports_raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same reports as text, with broken, missing and repeated rows."""

    def make() -> DataFrame:
        e = F.col("report_id")
        fmt = F.when(e % 2 == 0, F.date_format("ts", "dd/MM/yyyy HH:mm:ss")).otherwise(
            F.date_format("ts", "yyyy-MM-dd HH:mm:ss")
        )
        text = reports(spark, sf_dir).select(
            "report_id",
            F.when(e % 103 == 5, "").otherwise(fmt).alias("timestamp_raw"),
            F.col("mobile_type").alias("mobile_raw"),
            F.col("mmsi").cast("string").alias("mmsi_raw"),
            F.when(e % 101 == 3, "n/a").when(e % 107 == 9, "95.0").otherwise(F.format_string("%.6f", "lat")).alias("lat_raw"),
            F.format_string("%.6f", "lon").alias("lon_raw"),
            F.when(e % 97 == 4, "").otherwise(F.format_string("%.3f", "sog")).alias("sog_raw"),
            F.format_string("%.1f", "cog").alias("cog_raw"),
            F.col("ship_type").alias("ship_raw"),
        )
        return text.unionByName(text.filter(e % 50 == 0))

    return shared(spark, sf_dir, "reports_raw", make)


def points(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shared(
        spark,
        sf_dir,
        "points",
        lambda: build_points(loader_validity(reports(spark, sf_dir)), max_gap_s=MAX_GAP_S, min_points=4),
    )


def boxes(spark: SparkSession) -> DataFrame:
    rows = [(i, *b) for i, b in enumerate(BOXES)]
    schema = "query_id int, lat_min double, lat_max double, lon_min double, lon_max double, t_start double, t_end double"
    return spark.createDataFrame(rows, schema)


REPORTS_SQL = """
b AS (
  SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS k FROM events
),
reports AS (
  SELECT event_id AS report_id, CAST(200000000 + user_id AS BIGINT) AS mmsi, ts, epoch_us(ts) / 1e6 AS t,
         CASE WHEN event_id % 29 = 3 THEN 'Base Station' ELSE 'Class A' END AS mobile_type,
         54e0 + 5e-2 * (user_id % 40) + 2e-2 * k + 3e-3 * ((k * 7) % 5)
              + CASE WHEN event_id % 41 = 7 THEN 4e0 ELSE 0e0 END AS lat,
         9e0 + 8e-2 * (user_id % 25) + 3e-2 * k + 4e-3 * ((k * 11) % 7)
             + CASE WHEN event_id % 41 = 7 THEN 5e0 ELSE 0e0 END AS lon,
         CASE WHEN event_type = 'error' THEN 0e0 ELSE least(value, 60e0) / 1e1 END AS sog,
         CAST((event_id * 37) % 400 AS DOUBLE) AS cog,
         CASE WHEN user_id % 17 = 0 OR event_id % 3 = 0 THEN 'Undefined'
              WHEN user_id % 13 = 0 THEN 'SAR'
              WHEN user_id % 3 = 0 THEN 'Cargo'
              WHEN user_id % 3 = 1 THEN 'Tanker'
              ELSE 'Passenger' END AS ship_type,
         's' || CAST(user_id % 3 AS VARCHAR) AS source_id
  FROM b
)"""

RAW_SQL = REPORTS_SQL + """,
raw0 AS (
  SELECT report_id, CASE WHEN report_id % 103 = 5 THEN '' WHEN report_id % 2 = 0 THEN strftime(ts, '%d/%m/%Y %H:%M:%S')
              ELSE strftime(ts, '%Y-%m-%d %H:%M:%S') END AS timestamp_raw,
         mobile_type AS mobile_raw, CAST(mmsi AS VARCHAR) AS mmsi_raw,
         CASE WHEN report_id % 101 = 3 THEN 'n/a' WHEN report_id % 107 = 9 THEN '95.0' ELSE printf('%.6f', lat) END AS lat_raw,
         printf('%.6f', lon) AS lon_raw, CASE WHEN report_id % 97 = 4 THEN '' ELSE printf('%.3f', sog) END AS sog_raw,
         printf('%.1f', cog) AS cog_raw, ship_type AS ship_raw
  FROM reports
),
raw AS (SELECT * FROM raw0 UNION ALL SELECT * FROM raw0 WHERE report_id % 50 = 0)"""

POINTS_SQL = REPORTS_SQL + """,
valid AS (
  SELECT * FROM reports WHERE lat BETWEEN -90 AND 90 AND lon BETWEEN -180 AND 180
     AND sog BETWEEN 0 AND 102.2 AND cog >= 0 AND cog < 360
),
stepped AS (
  SELECT *, row_number() OVER v AS rank, t - lag(t) OVER v AS gap FROM valid
  WINDOW v AS (PARTITION BY mmsi ORDER BY t, report_id)
),
segmented AS (
  SELECT *, CAST(sum(CASE WHEN gap > 86400 THEN 1 ELSE 0 END) OVER (PARTITION BY mmsi ORDER BY rank) AS BIGINT) AS segment
  FROM stepped
),
sized AS (
  SELECT *, count(*) OVER (PARTITION BY mmsi, segment) AS n_points,
         row_number() OVER (PARTITION BY mmsi, segment ORDER BY rank) - 1 AS pos
  FROM segmented
),
numbered AS (
  SELECT *, dense_rank() OVER (ORDER BY mmsi, segment) - 1 AS traj_id FROM sized WHERE n_points >= 4
),
points AS (
  SELECT traj_id, pos, mmsi, report_id, t, lat, lon, sog AS speed, cog AS heading, n_points, source_id,
         pos = 0 AS is_start, pos = n_points - 1 AS is_end,
         CASE WHEN pos = 0 OR n_points <= 2 THEN 0e0
              ELSE least(abs(cog - lag(cog) OVER w), 360e0 - abs(cog - lag(cog) OVER w)) / 180e0 END AS turn_score
  FROM numbered WINDOW w AS (PARTITION BY traj_id ORDER BY pos)
)"""

BOXES_SQL = (
    "boxes AS (SELECT * FROM (VALUES "
    + ", ".join(f"({i}, {', '.join(f'{v!r}e0' for v in b)})" for i, b in enumerate(BOXES))
    + ") AS q(query_id, lat_min, lat_max, lon_min, lon_max, t_start, t_end))"
)

HITS_SQL = POINTS_SQL + ",\n" + BOXES_SQL + """,
hits AS (
  SELECT q.query_id, p.* FROM points p JOIN boxes q
    ON p.t BETWEEN q.t_start AND q.t_end AND p.lat BETWEEN q.lat_min AND q.lat_max
   AND p.lon BETWEEN q.lon_min AND q.lon_max
)"""
