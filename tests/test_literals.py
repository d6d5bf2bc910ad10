"""Small hand-computed cases."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tracklake.functions.geo import haversine_km
from tracklake.functions.parsing import epoch_seconds, parse_ts
from tracklake.operators import metrics, ranges, tracks
from tracklake.plans.ordered import order_index
from tracklake.sources import ledger
from tracklake.sources import reports as source


def reports(spark, rows):
    """rows of (mmsi, t[, lat, cog])"""
    full = [(i, m, float(t), float(a[0]) if a else 55.0, 10.0, 5.0, float(a[1]) if len(a) > 1 else 90.0) for i, (m, t, *a) in enumerate(rows)]
    return spark.createDataFrame(full, "report_id bigint, mmsi bigint, t double, lat double, lon double, sog double, cog double")


def points(spark, rows):
    """rows of (traj_id, t, lat, lon)"""
    out, seen = [], {}
    total = {}
    for r in rows:
        total[r[0]] = total.get(r[0], 0) + 1
    for tr, t, la, lo in rows:
        p = seen.get(tr, 0)
        seen[tr] = p + 1
        out.append((tr, p, tr, float(t), float(la), float(lo), 1.0, 0.0, p == 0, p == total[tr] - 1, 0.0, total[tr]))
    schema = "traj_id bigint, pos bigint, mmsi bigint, t double, lat double, lon double, speed double, heading double, is_start boolean, is_end boolean, turn_score double, n_points bigint"
    return spark.createDataFrame(out, schema)


def box(spark, lat, lon, t):
    return spark.createDataFrame([(0, *map(float, (*lat, *lon, *t)))], "query_id int, lat_min double, lat_max double, lon_min double, lon_max double, t_start double, t_end double")


VESSELS = [(100, t) for t in (0, 60, 120, 5000, 5060, 5120)] + [(200, 0), (200, 60)]


def test_gap_split(spark):
    p = tracks.build_points(reports(spark, VESSELS), 3600.0, 3)
    assert sorted((r["traj_id"], r["mmsi"], r["count"]) for r in p.groupBy("traj_id", "mmsi").count().collect()) == [(0, 100, 3), (1, 100, 3)]
    audit = tracks.load_audit(reports(spark, VESSELS), 3600.0, 3).first()
    assert (audit["gap_splits"], audit["short_segments"]) == (1, 1)


def test_no_gap_limit(spark):
    p = tracks.build_points(reports(spark, VESSELS), None, 3)
    assert [(r["traj_id"], r["count"]) for r in p.groupBy("traj_id").count().collect()] == [(0, 6)]


def test_load_audit(spark):
    rows = [(1, 0), (1, 0), (1, 60, 55, 511), (1, 120, 91), (1, 180), (1, 240), (1, 300)]
    a = tracks.load_audit(reports(spark, rows), 3600.0, 2, 3).first()
    got = [a[c] for c in ("rows_valid", "rows_bad_heading", "rows_bad_lat", "duplicate_time_rows", "segments_downsampled", "points_kept")]
    assert got == [5, 1, 1, 2, 1, 3]


def crossing(spark, rows, t):
    p = points(spark, rows)
    q = box(spark, (-1, 1), (-1, 1), t)
    return (
        sorted((r["traj_id"], r["pos"]) for r in ranges.segment_crossings(p, q).collect()),
        sorted((r["traj_id"], r["pos"]) for r in ranges.crossing_brackets(p, q).collect()),
    )


def test_crossing_pass_through(spark):
    assert crossing(spark, [(0, 1, 0, -2), (0, 2, 0, 2)], (0, 10)) == ([(0, 0)], [(0, 0), (0, 1)])


def test_crossing_from_inside(spark):
    rows = [(0, 1, 0, 0), (0, 2, 0.5, 0.5), (0, 3, 0, 2)]
    assert crossing(spark, rows, (0, 10)) == ([(0, 1)], [(0, 1), (0, 2)])


def test_crossing_other_time(spark):
    assert crossing(spark, [(0, 1, 0, -2), (0, 2, 0, 2)], (20, 21)) == ([], [])


def test_crossing_stops_at_track_edge(spark):
    rows = [(0, 1, 0, -3), (0, 2, 0, -2), (1, 3, 0, 2), (1, 4, 0, 3)]
    assert crossing(spark, rows, (0, 10))[0] == []
    one = [(0, *r[1:]) for r in rows]
    assert crossing(spark, one, (0, 10)) == ([(0, 1)], [(0, 1), (0, 2)])


def test_haversine(spark):
    km = spark.range(1).select(haversine_km(0.0, 0.0, 0.0, 1.0)).first()[0]
    assert abs(km - 111.19) < 0.05


def test_range_query(spark):
    p = points(spark, [(0, 0, 0, 0), (0, 1, 2, 2), (1, 0, 3, 3), (1, 1, 4, 4)])
    b = {"lat_min": -0.5, "lat_max": 0.5, "lon_min": -0.5, "lon_max": 0.5, "t_start": 0, "t_end": 1.5}
    assert [r[0] for r in ranges.range_query(p, b).collect()] == [0]
    with pytest.raises(ValueError):
        ranges.range_query(p, b, "knn")


def point_f1(spark, rows, kept):
    p = points(spark, rows)
    hits = ranges.query_hits(p, box(spark, (-1, 1), (-1, 1), (0, 10)))
    ret = spark.createDataFrame([("m", 0.1, *k) for k in kept], "method string, ratio double, traj_id bigint, pos bigint")
    return metrics.support_f1(hits, ret, metrics.SETS, "f1").first()["f1"]


def test_point_f1(spark):
    assert point_f1(spark, [(0, t, 0, 0) for t in range(4)], [(0, 0)]) == pytest.approx(0.4)
    assert point_f1(spark, [(0, 1, 0, 0), (0, 1, 0, 0)], [(0, 0)]) == pytest.approx(2 / 3)


def test_set_f1(spark):
    def ids(*v):
        return spark.createDataFrame([(x,) for x in v], "id int")

    def f1(a, b):
        return metrics.set_f1(a, b, "id").first()["f1"]

    assert f1(ids(1, 2, 3, 4), ids(2, 3, 5)) == pytest.approx(4 / 7)
    assert f1(ids(), ids()) == 1.0
    assert f1(ids(1), ids()) == 0.0


def test_parse_ts(spark):
    text = ["31/01/2024 12:00:00", "2024-01-31T12:00:00+02:00", "2024-01-31 12:00:00", "nonsense", " ", None]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(text)], "i int, s string")
    got = [r[0] for r in df.orderBy("i").select(epoch_seconds(parse_ts("s"))).collect()]
    noon = 1706702400.0
    assert got == [noon, noon - 7200, noon, None, None, None]


def test_headers_and_aliases(spark):
    df = spark.createDataFrame([("1", "2", "3", "4", "5", "6")], "vessel_id string, Latitude string, lon string, SOG string, cog string, datetime string")
    assert source.resolve_aliases(df).columns == ["mmsi", "lat", "lon", "speed", "heading", "timestamp"]
    with pytest.raises(ValueError, match="heading"):
        source.resolve_aliases(df.drop("cog"))
    with pytest.raises(ValueError, match="Ship type"):
        source.normalize_headers(df)


def test_distinct_sources():
    source.assert_distinct_sources({"train": ["a"], "eval": ["b"]})
    with pytest.raises(ValueError):
        source.assert_distinct_sources({"train": ["a"], "eval": ["a"]})


def test_ledger_refuses_changed_files(spark):
    files = spark.createDataFrame([("f", 10)], "path string, size bigint").withColumn("modified", F.lit("2024-01-01").cast("timestamp"))
    known = ledger.ledger_upsert(ledger.empty_ledger(spark), files)
    assert ledger.ledger_filter(files, known).count() == 0
    with pytest.raises(ValueError, match="changed"):
        ledger.ledger_filter(files.withColumn("size", F.lit(11).cast("bigint")), known)
    assert ledger.ledger_filter(files, ledger.ledger_reset(known, "f")).count() == 1


def test_order_index_is_dense_and_sorted(spark):
    df = spark.range(1000).select((F.col("id") * 7919 % 1000).alias("v"))
    rows = order_index(df, [F.col("v")]).collect()
    assert sorted((r["idx"], r["v"]) for r in rows) == [(i, i) for i in range(1000)]


def test_turn_wraps(spark):
    rows = [(1, 60 * i, 55, h) for i, h in enumerate((350, 10, 190, 190))]
    p = tracks.build_points(reports(spark, rows), 3600.0, 4).orderBy("pos").collect()
    assert np.allclose([r["turn_score"] for r in p], [0, 20 / 180, 1.0, 0.0])
    assert not math.isnan(p[0]["turn_score"])
