"""The plain and the split plan of every ordered helper must agree."""

import math

import pytest
from pyspark.sql import functions as F

from checks import fixtures
from tracklake.operators import cleaning, metrics, quality, ranges, simplify, tracks
from tracklake.plans.quantiles import quantiles_within

from .conftest import SF


def rows(df):
    cols = sorted(df.columns)
    out = []
    for r in df.select(*cols).collect():
        out.append(tuple(round(v, 7) if isinstance(v, float) and not math.isnan(v) else v for v in r))
    return sorted(out, key=repr)


def points(spark):
    return fixtures.points(spark, SF).withColumn("score", (F.col("report_id") * 7919 % 1000) / 1000.0)


def kept(spark):
    p = points(spark)
    k = p.filter("pos % 3 = 0 OR is_end").select("traj_id", "pos")
    return k.select(F.lit("thirds").alias("method"), F.lit(0.3).alias("ratio"), "traj_id", "pos")


CASES = {
    "segment": lambda s: tracks.segment(tracks.loader_validity(fixtures.reports(s, SF)), 86400.0).select("report_id", "rank", "segment"),
    "build_points": lambda s: tracks.build_points(tracks.loader_validity(fixtures.reports(s, SF)), 86400.0),
    "turn_score": lambda s: tracks.turn_score(points(s)).select("traj_id", "pos", "turn_score"),
    "cumulative_length": lambda s: ranges.cumulative_length(points(s)).select("traj_id", "pos", "cum_km"),
    "crossings": lambda s: ranges.segment_crossings(points(s), fixtures.boxes(s)),
    "boundary": lambda s: ranges.hits_with_boundary(points(s), fixtures.boxes(s)).select("query_id", "traj_id", "pos", "is_boundary"),
    "trim": lambda s: cleaning.trim_stationary(fixtures.reports(s, SF)).select("report_id"),
    "fill_type": lambda s: cleaning.fill_ship_type(fixtures.reports(s, SF)).select("report_id", "ship_type"),
    "skip_neighbor": lambda s: cleaning.skip_neighbor_pass(fixtures.reports(s, SF)).select("report_id"),
    "outliers": lambda s: cleaning.outlier_detector(fixtures.reports(s, SF))[0].select("report_id"),
    "gaps": lambda s: quality.gap_verdict(quality.consecutive_gaps(fixtures.reports(s, SF))).select("report_id", "verdict"),
    "by_score": lambda s: simplify.simplify_by_score(points(s), 0.3),
    "fill": lambda s: simplify.simplify_hybrid(points(s), 0.4),
    "fill_bonus": lambda s: simplify.simplify_hybrid(points(s), 0.4, 0.5, bonus=0.8),
    "fill_bonus_from_nothing": lambda s: simplify.simplify_hybrid(points(s), 0.4, 0.0, bonus=0.8),
    "swap": lambda s: simplify.simplify_hybrid(points(s), 0.4, mode="swap"),
    "stratified": lambda s: simplify.simplify_hybrid(points(s), 0.4, mode="stratified"),
    "block_picks": lambda s: simplify.simplify_segment_budget(points(s), 0.4, size=2),
    "line_splits": lambda s: simplify.simplify_douglas_peucker(points(s), 0.3),
    "rank_tie": lambda s: simplify.convert_scores(points(s), mode="rank_tie").select("traj_id", "pos", "converted"),
    "zscore": lambda s: simplify.convert_scores(points(s), mode="rank_confidence").select("traj_id", "pos", "converted"),
    "sed_ped": lambda s: metrics.sed_ped(points(s), kept(s)).select("traj_id", "pos", "sed_km", "ped_km"),
    "gap_stats": lambda s: metrics.retained_gap_stats(points(s), kept(s)),
    "audit": lambda s: metrics.range_audit(metrics.query_scores(points(s), kept(s), fixtures.boxes(s))).select("method", *metrics.QUERY_SCORES),
    "quantiles_within": lambda s: quantiles_within(points(s), ["traj_id"], "score", {"p": 0.7, "q": 0.25}, ["pos"], "traj_id"),
}


@pytest.mark.parametrize("name", list(CASES))
def test_split_plan_gives_the_same_rows(spark, request, name):
    plain = rows(CASES[name](spark))
    request.getfixturevalue("hot")
    assert rows(CASES[name](spark)) == plain
    assert plain


@pytest.mark.parametrize("second, scores", [(None, "hash(pos) % 1000 / 1000.0"), ("other", "pmod(hash(pos), 10) / 10.0"), (None, "pos / 700.0")])
def test_block_picks_of_a_long_track(spark, second, scores):
    """Pieces of 20 blocks against the whole track: random scores, ties, and scores that only rise."""
    rows = spark.range(700).select(F.lit(1).cast("bigint").alias("traj_id"), F.col("id").alias("pos"), F.lit(700).cast("bigint").alias("n_points"))
    track = rows.withColumns({
        "t": F.col("pos") * 60.0, "lat": 55 + F.sin(F.col("pos") / 9.0) / 10, "lon": 10 + F.col("pos") / 900.0,
        "score": F.expr(scores).cast("double"), "other": F.expr("pmod(hash(pos, 7), 101) / 101d"),
    })
    plain = rows_of_picks(track, second)
    for conf, value in (("hotRows", "50"), ("pieceRows", "80")):
        spark.conf.set(f"spark.tracklake.{conf}", value)
    try:
        assert rows_of_picks(track, second) == plain
    finally:
        for conf in ("hotRows", "pieceRows"):
            spark.conf.unset(f"spark.tracklake.{conf}")


def rows_of_picks(track, second):
    return rows(simplify.simplify_segment_budget(track, 0.3, second, size=4, share=1.0))
