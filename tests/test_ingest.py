"""Loading files by name, and the ledger."""

import pytest
from pyspark.sql import functions as F

from tracklake.sources.ledger import read_ledger
from tracklake.sources.reports import first_line, first_lines, layout_of, read_reports_csv
from tracklake.streaming.ingest import ingest_incremental, reset_file

ROW = {"# Timestamp": "01/02/2024 03:04:05", "Type of mobile": "Class A", "MMSI": "219000001", "Latitude": "55.5", "Longitude": "10.25", "SOG": "7.5", "COG": "90", "Ship type": "Cargo"}


def put(path, header, sep=",", rows=1, **changes):
    row = ROW | {"Callsign": "OX"} | changes
    names = {h: next(k for k in row if k.strip("# ").lower() == h.strip("\ufeff# ").lower()) for h in header}
    lines = [sep.join(header)] + [sep.join(row[names[h]] for h in header)] * rows
    path.write_text("\n".join(lines) + "\n", encoding="utf-8")


def test_columns_are_found_by_name_in_every_file(spark, tmp_path):
    names = list(ROW)
    put(tmp_path / "a.csv", names)
    put(tmp_path / "b.csv", ["Callsign", *reversed(names)], ";")
    put(tmp_path / "c.csv", ["MMSI", " longitude", "LATITUDE ", "\ufeffTimestamp", "SOG", "COG", "Ship type", "Type of mobile"], "\t")
    got = read_reports_csv(spark, str(tmp_path), sep=None)
    assert got.count() == 3 and got.distinct().count() == 1
    assert got.first().asDict() == {"timestamp_raw": ROW["# Timestamp"], "mobile_raw": "Class A", "mmsi_raw": "219000001", "lat_raw": "55.5", "lon_raw": "10.25", "sog_raw": "7.5", "cog_raw": "90", "ship_raw": "Cargo"}
    again = read_reports_csv(spark, [str(tmp_path / "a.csv")])
    assert again.count() == 1


def test_separator_comes_from_the_header_names():
    assert layout_of("a;b|MMSI,x", required={"MMSI": "m"})[0] == ","
    assert layout_of(";".join(ROW))[0] == ";" and layout_of("|".join(f'"{h}"' for h in ROW))[0] == "|"


def test_missing_columns_are_listed(spark, tmp_path):
    put(tmp_path / "a.csv", list(ROW))
    put(tmp_path / "b.csv", [h for h in ROW if h not in ("SOG", "MMSI")])
    with pytest.raises(ValueError, match=r"b\.csv: MMSI, SOG"):
        read_reports_csv(spark, str(tmp_path), sep=None)
    with pytest.raises(ValueError, match=r"b\.csv: MMSI, SOG"):
        ingest_incremental(spark, str(tmp_path), str(tmp_path / "out"))


def test_load_is_incremental_and_refuses_changed_files(spark, tmp_path):
    src, out = tmp_path / "in", str(tmp_path / "out")
    src.mkdir()
    put(src / "a.csv", list(ROW), rows=3)
    put(src / "b b.csv", ["Callsign", *reversed(list(ROW))], ";", rows=2, Latitude="95")
    put(src / "c.csv", list(ROW), rows=0)
    assert ingest_incremental(spark, str(src), out, files_per_batch=2) == 3
    assert ingest_incremental(spark, str(src), out) == 0
    put(src / "d.csv", list(ROW), rows=4)
    assert ingest_incremental(spark, str(src), out) == 1
    assert spark.read.parquet(f"{out}/good").count() == 7 and spark.read.parquet(f"{out}/rejects").count() == 2
    known = {r["path"].split("/")[-1]: r for r in read_ledger(spark, f"{out}/ledger").collect()}
    assert {k: (r["rows_read"], r["rows_inserted"], r["skip_bad_coords"]) for k, r in known.items()} == {"a.csv": (3, 3, 0), "b b.csv": (2, 0, 2), "c.csv": (0, 0, 0), "d.csv": (4, 4, 0)}
    put(src / "a.csv", list(ROW), rows=9)
    with pytest.raises(ValueError, match="changed after they were loaded"):
        ingest_incremental(spark, str(src), out)
    reset_file(spark, out, known["a.csv"]["path"])
    assert ingest_incremental(spark, str(src), out) == 1
    assert spark.read.parquet(f"{out}/good").agg(F.count("*")).first()[0] == 16


def test_the_header_is_the_line_at_the_start_of_a_file_of_many_splits(spark, tmp_path):
    put(tmp_path / "a.csv", list(ROW), rows=400)
    put(tmp_path / "b.csv", [*reversed(list(ROW))], ";", rows=400)
    spark.conf.set("spark.sql.files.maxPartitionBytes", "512")
    try:
        assert spark.read.text(str(tmp_path / "a.csv")).rdd.getNumPartitions() > 20
        head = first_line(spark, str(tmp_path / "a.csv"))
        # a limit that meets rows of several tasks takes them in the order of their arrival
        assert head.rdd.getNumPartitions() == 1 and "Exchange" not in head._jdf.queryExecution().executedPlan().toString()
        lines = first_lines(spark, [str(tmp_path / n) for n in ("a.csv", "b.csv")])
        assert sorted(lines.values()) == sorted([",".join(ROW), ";".join(reversed(list(ROW)))])
        assert read_reports_csv(spark, str(tmp_path), sep=None).count() == 800
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
