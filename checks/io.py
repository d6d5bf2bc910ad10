"""Reading, loading and writing: round trips over the derived reports and tracks."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from tracklake.operators import simplify
from tracklake.plans.materialize import shared_folder
from tracklake.sources import ledger, sinks
from tracklake.sources import reports as source
from tracklake.streaming.ingest import ingest_incremental, read_committed
from tracklake.streaming.live import stream_ingest

from .cleaning import _TYPED_SQL
from .fixtures import HITS_SQL, POINTS_SQL, RAW_SQL, REPORTS_SQL, boxes, points, reports, reports_raw
from .registry import check
from .simplify import k_sql, spaced_sql
from .tracks import r


def fresh(spark) -> str:
    return f"{shared_folder(spark)}/io-{uuid.uuid4().hex}"


def raw_files(spark, sf) -> str:
    """The raw reports as header CSV files of three layouts: file order, turned round with other columns and ';', and marks around the names."""
    path = fresh(spark)
    raw = reports_raw(spark, sf).withColumn("part", F.pmod(F.xxhash64(*source.RAW_COLUMNS), F.lit(3)))
    named = [F.col(c).alias(h) for h, c in source.RAW_HEADERS.items()]
    other = [F.lit("x").alias("Callsign"), *reversed(named), F.lit(1).alias("IMO")]
    marked = [F.col(c).alias(f" {h.lstrip('# ').upper()} ") for h, c in source.RAW_HEADERS.items()]
    raw.filter("part = 0").select(*named).coalesce(1).write.csv(f"{path}/a", header=True, emptyValue="")
    raw.filter("part = 1").select(*other).coalesce(1).write.csv(f"{path}/b", header=True, emptyValue="", sep=";")
    raw.filter("part = 2").select(*marked[3:], *marked[:3]).coalesce(1).write.csv(f"{path}/c", header=True, emptyValue="", sep="\t")
    return path


_COUNT_SQL = f"""WITH {RAW_SQL} SELECT mobile_raw, ship_raw, count(*) AS n, count(DISTINCT mmsi_raw) AS vessels FROM raw GROUP BY mobile_raw, ship_raw"""


@check("a1_a3_read_reports_csv", _COUNT_SQL)
def _(spark, sf):
    raw = source.read_reports_csv(spark, raw_files(spark, sf), sep=None)
    return raw.groupBy("mobile_raw", "ship_raw").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("mmsi_raw").alias("vessels"))


@check("a8_ingest_incremental", f"WITH {_TYPED_SQL} SELECT coalesce(reason, 'good') AS reason, count(*) AS n FROM typed GROUP BY ALL")
def _(spark, sf):
    src, out = raw_files(spark, sf), fresh(spark)
    ingest_incremental(spark, src, out, files_per_batch=2)
    ingest_incremental(spark, src, out, files_per_batch=2)  # nothing new: no second copy
    good = spark.read.parquet(f"{out}/good").select(F.lit("good").alias("reason"))
    bad = spark.read.parquet(f"{out}/rejects").select("reason")
    return good.unionByName(bad).groupBy("reason").agg(F.count(F.lit(1)).alias("n"))


@check("a8_stream_ingest", f"WITH {_TYPED_SQL} SELECT coalesce(reason, 'good') AS reason, count(*) AS n FROM typed GROUP BY ALL")
def _(spark, sf):
    src, out = raw_files(spark, sf), fresh(spark)
    for _ in range(2):  # a new checkpoint sees all files again; the ledger knows them
        stream_ingest(spark, src, out, fresh(spark), files_per_batch=2).awaitTermination()
    good = read_committed(spark, out).select(F.lit("good").alias("reason"))
    return good.unionByName(read_committed(spark, out, "rejects").select("reason")).groupBy("reason").agg(F.count(F.lit(1)).alias("n"))


@check("a9_ledger", f"""WITH {_TYPED_SQL} SELECT CAST(0 AS BIGINT) AS left_to_load, CAST(3 AS BIGINT) AS files, count(*) AS rows_read, count(*) FILTER (reason IS NULL) AS rows_inserted,
   count(*) FILTER (reason IS NOT NULL) AS rows_skipped, count(*) FILTER (reason = 'missing_ts') AS skip_missing_ts, count(*) FILTER (reason = 'missing_core') AS skip_missing_core,
   count(*) FILTER (reason = 'bad_coords') AS skip_bad_coords FROM typed""")
def _(spark, sf):
    src, out = raw_files(spark, sf), fresh(spark)
    ingest_incremental(spark, src, out)
    known = ledger.read_ledger(spark, f"{out}/ledger")
    left = ledger.ledger_filter(ledger.list_files(spark, [src]), known).agg(F.count(F.lit(1)).alias("left_to_load"))
    counts = [c for c in known.columns if c.startswith(("rows_", "skip_"))]
    return known.agg(F.count(F.lit(1)).alias("files"), *[F.sum(c).alias(c) for c in counts]).withColumn("left_to_load", left.scalar())


@check("a10_combine_days", f"""WITH {REPORTS_SQL}, d AS (SELECT CASE WHEN source_id = 's0' THEN 'a' ELSE 'b' END AS file, mmsi FROM reports)
   SELECT file, count(*) AS rows, count(DISTINCT mmsi) AS vessels FROM d GROUP BY file UNION ALL SELECT 'all', count(*), count(DISTINCT mmsi) FROM d""")
def _(spark, sf):
    root = fresh(spark)
    rep = reports(spark, sf).select(F.col("mmsi").alias("MMSI"), "lat", "lon", "source_id")
    rep.filter("source_id = 's0'").drop("source_id").write.csv(f"{root}/a", header=True)
    rep.filter("source_id <> 's0'").drop("source_id").write.csv(f"{root}/b", header=True)
    _, counts = source.combine_days(spark, [f"{root}/a", f"{root}/b"])
    name = F.coalesce(F.element_at(F.split("source_file", "/"), -1), F.lit("all"))
    return counts.select(name.alias("file"), "rows", "vessels")


@check("a11_materialize_points", f"WITH {POINTS_SQL} SELECT traj_id, count(*) AS n, round(sum(lat), 6) AS lat_sum FROM points GROUP BY traj_id")
def _(spark, sf):
    root, config = fresh(spark), {"max_gap_s": 86400.0, "min_points": 4}
    sinks.materialize_points(lambda: points(spark, sf), spark, root, [f"{sf}/events.parquet"], config)

    def never():
        raise AssertionError("the written table must be used")

    again = sinks.materialize_points(never, spark, root, [f"{sf}/events.parquet"], config)
    return again.groupBy("traj_id").agg(F.count(F.lit(1)).alias("n"), r(F.sum("lat"), 6).alias("lat_sum"))


@check("a12_write_clean_csv", f"WITH {REPORTS_SQL} SELECT mmsi::VARCHAR AS mmsi, count(*) AS n FROM reports GROUP BY mmsi")
def _(spark, sf):
    path = fresh(spark)
    sinks.write_clean_csv(reports(spark, sf), path, 2)
    back = spark.read.csv(path, header=True)
    return back.groupBy(F.col("MMSI").alias("mmsi")).agg(F.count(F.lit(1)).alias("n"))


@check("a13_write_report_table", f"""WITH {REPORTS_SQL} SELECT report_id, printf('%.4f', lon) AS lon_text, CAST(floor((lat + 90) / 0.25e0) * 1440 + floor((lon + 180) / 0.25e0) AS BIGINT) AS cell,
   CAST(floor(t / 86400) AS BIGINT) AS day_no, true AS well_formed FROM reports""")
def _(spark, sf):
    path = fresh(spark)
    sinks.write_report_table(reports(spark, sf), path)
    back = spark.read.parquet(path)
    day = F.datediff(F.col("day").cast("date"), F.lit("1970-01-01").cast("date")).cast("bigint")
    good = F.col("geom") == F.concat(F.lit("SRID=4326;POINT("), F.col("lon").cast("string"), F.lit(" "), F.col("lat").cast("string"), F.lit(")"))
    return back.select("report_id", F.format_string("%.4f", "lon").alias("lon_text"), "cell", day.alias("day_no"), good.alias("well_formed"))


@check("a14_write_simplified_csv", f"""WITH {POINTS_SQL}, {spaced_sql('points', 'kept', k_sql(0.2))} SELECT p.mmsi::VARCHAR AS mmsi, printf('%.3f', t) AS stamp, printf('%.6f', lat) AS lat, printf('%.6f', lon) AS lon, printf('%.2f', heading) AS cog
   FROM points p JOIN kept k ON k.traj_id = p.traj_id AND k.pos = p.pos""")
def _(spark, sf):
    path = fresh(spark)
    p = points(spark, sf)
    sinks.write_simplified_csv(p, simplify.simplify_uniform(p, 0.2), path)
    back = spark.read.csv(path, header=True)
    return back.select(F.col("MMSI").alias("mmsi"), F.col("`# Timestamp`").alias("stamp"), F.col("Latitude").alias("lat"), F.col("Longitude").alias("lon"), F.col("COG").alias("cog"))


@check("a15_write_queries_geojson", f"""WITH {HITS_SQL} SELECT lat_min, lon_max, strftime(to_timestamp(t_start) AT TIME ZONE 'UTC', '%H:%M') AS t_start_hm, 5::BIGINT AS corners, 'Polygon' AS shape FROM boxes WHERE query_id IN (SELECT query_id FROM hits)""")
def _(spark, sf):
    from tracklake.operators.ranges import query_hits

    path = fresh(spark)
    live = query_hits(points(spark, sf), boxes(spark)).select("query_id").distinct()
    sinks.write_queries_geojson(boxes(spark).join(live, "query_id", "left_semi"), path)
    f = spark.read.text(path).select(F.col("value").alias("j"))
    get = lambda p: F.get_json_object("j", p)
    ring = F.from_json(get("$.geometry.coordinates"), "array<array<array<double>>>")
    return f.select(get("$.properties.lat_min").cast("double").alias("lat_min"), get("$.properties.lon_max").cast("double").alias("lon_max"),
                    get("$.properties.t_start_hm").alias("t_start_hm"), F.size(ring[0]).cast("bigint").alias("corners"), get("$.geometry.type").alias("shape"))


@check("a16_upsert_results", f"""WITH {POINTS_SQL}, m AS (SELECT mmsi AS run_id, avg(speed) AS score FROM points GROUP BY mmsi), u AS (SELECT run_id, score * 2 AS score FROM m WHERE run_id % 3 = 0)
   SELECT run_id, round(coalesce(u.score, m.score), 9) AS score FROM m LEFT JOIN u USING (run_id)""")
def _(spark, sf):
    m = points(spark, sf).groupBy(F.col("mmsi").alias("run_id")).agg(F.avg("speed").alias("score"))
    newer = m.filter("run_id % 3 = 0").withColumn("score", F.col("score") * 2)
    return sinks.upsert_results(m, newer).withColumn("score", r("score"))
