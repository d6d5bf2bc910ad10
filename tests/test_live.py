"""Streams give what the batch forms give, also after a kill between their writes."""

import pytest
from pyspark.sql import functions as F

from checks import fixtures
from tests.conftest import SF
from tracklake.operators import tracks
from tracklake.streaming import ingest, live

HEAD = "# Timestamp,Type of mobile,MMSI,Latitude,Longitude,SOG,COG,Ship type\n"


def write_days(folder, days):
    folder.mkdir(exist_ok=True)
    for d in days:
        lines = [f"{d:02d}/01/2024 00:{m:02d}:00,Class A,{219000000 + d},55.{m:02d},12.0,5.0,90.0,Cargo" for m in range(5)]
        (folder / f"day{d}.csv").write_text(HEAD + "\n".join(lines) + "\n" + f"bad,Class A,{219000000 + d},55.0,12.0,5.0,90.0,Cargo\n")


def counts(spark, out):
    return [ingest.read_committed(spark, str(out), what).count() for what in ("good", "rejects")]


def run(spark, src, out, tmp_path):
    live.stream_ingest(spark, str(src), str(out), str(tmp_path / "point"), files_per_batch=2).awaitTermination()


def test_stream_goes_on_and_survives_a_kill(spark, tmp_path, monkeypatch):
    src, out = tmp_path / "src", tmp_path / "out"
    write_days(src, [1, 2, 3])
    real = ingest._counts
    failed = []

    def killed(tagged, files):
        if not failed:
            failed.append(1)
            raise RuntimeError("killed before the ledger")
        return real(tagged, files)

    monkeypatch.setattr(ingest, "_counts", killed)
    with pytest.raises(Exception, match="killed"):
        run(spark, src, out, tmp_path)
    assert counts(spark, out) == [0, 0]  # rows are written, but no reader sees them
    run(spark, src, out, tmp_path)
    assert counts(spark, out) == [15, 3]
    write_days(src, [4])
    run(spark, src, out, tmp_path)
    assert counts(spark, out) == [20, 4]
    assert ingest.ingest_incremental(spark, str(src), str(out)) == 0  # stream and batch share the ledger


def test_segments_of_a_stream(spark, tmp_path):
    reports = tracks.loader_validity(fixtures.reports(spark, SF)).select("report_id", "mmsi", "ts", "t")
    batch = tracks.segment(reports, 86400.0).groupBy("mmsi", "segment").agg(F.min("ts").alias("a"), F.max("ts").alias("b"), F.count(F.lit(1)).alias("n"))
    want = sorted((r.mmsi, r.a, r.b, r.n) for r in batch.collect())
    # a report far in the future lets the watermark pass every segment
    last = reports.agg(F.max("ts").alias("m")).first()["m"]
    sentinel = spark.createDataFrame([(0, last)], "mmsi long, ts timestamp").withColumn("ts", F.col("ts") + F.expr("INTERVAL 400 DAYS"))
    rows = reports.select("mmsi", F.col("ts").cast("timestamp").alias("ts"))
    rows.union(sentinel).coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("mmsi long, ts timestamp").parquet(str(tmp_path / "in"))
    closed = live.closed_segments(stream, 86400.0, "0 seconds")
    query = closed.writeStream.format("parquet").option("path", str(tmp_path / "closed")).option("checkpointLocation", str(tmp_path / "point")).trigger(availableNow=True).start()
    query.awaitTermination()
    got = sorted((r.mmsi, r.first_ts, r.last_ts, r.n_points) for r in spark.read.parquet(str(tmp_path / "closed")).collect() if r.mmsi)
    assert got == want
