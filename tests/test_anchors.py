"""Weighted draws lose no slot, whatever the rounding of sums."""

import math

from pyspark.sql import functions as F

from tracklake.operators.workload import sample_anchors


def test_every_slot_gets_a_point(spark):
    points = spark.range(4000).select((F.col("id") % 80).alias("traj_id"), F.floor(F.col("id") / 80).alias("pos"), (F.lit(0.1) + (F.col("id") % 7) * 0.1).alias("w"))
    points = points.withColumn("w", F.when(F.col("pos") >= 45, 0.0).otherwise(F.col("w")))
    total = sum(0.1 + (i % 7) * 0.1 for i in range(4000) if i // 80 < 45)
    edges, upto = [], 0.0
    for i in range(40):  # draws just below and at borders of parts and points, and the largest number below 1
        upto += total / 40
        edges += [math.nextafter(upto / total, 0), min(upto / total, math.nextafter(1, 0))]
    draws = [(k, "w", u) for k, u in enumerate([0.0, math.nextafter(1, 0), *edges])]
    got = sample_anchors(points, spark.createDataFrame(draws, "slot long, kind string, u double"), rows_per_part=100).collect()
    assert sorted(r["slot"] for r in got) == list(range(len(draws)))
    assert all(r["pos"] < 45 for r in got)
