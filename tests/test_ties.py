"""Rounding and order where values are equal or half way."""

import math
import random

from tracklake.functions.formatting import fixed
from tracklake.operators.cleaning import clean_reports
from tracklake.sources.reports import RAW_COLUMNS


def test_numbers_are_rounded_by_their_exact_value(spark):
    draw = random.Random(5)
    values = [1705867206.3915, 1706264926.7745, 0.125, 0.375, 2.5, -0.0625, -1.0005, 0.0, -0.0, -1e-9, 1e-7, 0.9999999, 99.9996, 1e15 + 0.125, 4503599627370495.5, 2.0**60, 1e-300]
    values += [1.7e9 + draw.randrange(10**7) / 1e4 for _ in range(500)] + [draw.randrange(10**9) / 1e7 - 40 for _ in range(500)]
    frame = spark.createDataFrame([(v,) for v in values] + [(None,)], "v double")
    for digits in (1, 2, 3, 6):
        got = [r["x"] for r in frame.select(fixed("v", digits).alias("x")).collect()]
        assert got == [f"{v:.{digits}f}" for v in values] + [None]
    assert not math.isfinite(float(spark.createDataFrame([(float("nan"),)], "v double").select(fixed("v", 2)).first()[0]))


def test_reports_at_equal_times_keep_the_order_of_their_ids(spark):
    row = {"timestamp_raw": "2024-01-02 03:04:05", "mobile_raw": "Class A", "mmsi_raw": "219000001", "lon_raw": "10.0", "sog_raw": "0.0", "cog_raw": "90.0", "ship_raw": "Cargo"}
    schema = ", ".join(["report_id bigint", *[f"{c} string" for c in RAW_COLUMNS]])

    def kept(ids):
        rows = [row | {"report_id": i, "lat_raw": lat} for i, lat in ids]
        got = clean_reports(spark.createDataFrame([tuple(x[c.split()[0]] for c in schema.split(", ")) for x in rows], schema)).collect()
        return [(r["report_id"], r["lat"]) for r in got]

    # of two stationary reports in one second the earlier one stays, however their contents hash
    assert kept([(1, "55.1"), (2, "55.2")]) == [(1, 55.1)]
    assert kept([(2, "55.1"), (1, "55.2"), (3, "55.2")]) == [(1, 55.2)]
