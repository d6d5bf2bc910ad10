"""Cutting vessel reports into tracks and describing them.

POINTS is the long table all later operators use: one row per kept position,
keyed by a dense ``traj_id`` and a dense 0-based ``pos`` inside the track.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.geo import heading_change
from ..functions.hashing import unit_hash
from ..functions.parsing import epoch_day
from ..plans.materialize import materialize
from ..plans.ordered import attach, neighbors, order_index, rank_within, scan, with_bound
from ..plans.quantiles import quantiles

# Accepted ranges of the loader.
MAX_SPEED = 102.2
INVALID_FLAGS = ("bad_time", "bad_lat", "bad_lon", "bad_speed", "bad_heading")


def loader_flags(df: DataFrame) -> DataFrame:
    """Five independent flags for values the track loader refuses."""
    return df.withColumns(
        {
            "bad_time": F.col("t").isNull(),
            "bad_lat": ~F.coalesce(F.col("lat").between(-90.0, 90.0), F.lit(False)),
            "bad_lon": ~F.coalesce(F.col("lon").between(-180.0, 180.0), F.lit(False)),
            "bad_speed": ~F.coalesce(F.col("sog").between(0.0, MAX_SPEED), F.lit(False)),
            "bad_heading": ~F.coalesce((F.col("cog") >= 0.0) & (F.col("cog") < 360.0), F.lit(False)),
        }
    )


def loader_validity(df: DataFrame) -> DataFrame:
    """Reports with none of the five flags."""
    flagged = loader_flags(df)
    for flag in INVALID_FLAGS:
        flagged = flagged.filter(~F.col(flag))
    return flagged.drop(*INVALID_FLAGS)


def segment(df: DataFrame, max_gap_s: float | None = 3600.0) -> DataFrame:
    """Number the segments of each vessel; a gap longer than ``max_gap_s`` starts a new one.

    Adds ``rank`` (1-based order in the vessel) and ``segment`` (0-based).
    """
    df = with_bound(df, "mmsi")
    ranked = rank_within(df, ["mmsi"], [F.col("t"), F.col("report_id")], "rank", "mmsi")
    if max_gap_s is None:
        return ranked.withColumn("segment", F.lit(0).cast("bigint"))
    stepped = neighbors(ranked, ["mmsi"], "rank", {"_t_prev": ("t", -1)}, "mmsi")
    starts = F.when(F.col("t") - F.col("_t_prev") > max_gap_s, 1).otherwise(0).cast("bigint")
    return scan(stepped, ["mmsi"], "rank", {"segment": ("sum", starts)}, "mmsi").drop("_t_prev")


def segment_sizes(segmented: DataFrame) -> DataFrame:
    """Add ``n_points`` and the dense ``pos`` of every report inside its segment."""
    sized = attach(
        segmented,
        ["mmsi", "segment"],
        {"n_points": F.count(F.lit(1)), "_first": F.min("rank")},
        "mmsi",
    )
    return sized.withColumn("pos", F.col("rank") - F.col("_first")).drop("_first", "rank")


def drop_short(sized: DataFrame, min_points: int = 4) -> DataFrame:
    return sized.filter(F.col("n_points") >= min_points)


def downsample(sized: DataFrame, max_points: int | None) -> DataFrame:
    """Thin longer segments to ``max_points`` evenly spaced positions, renumbered.

    Position p is kept if it equals floor(i * (n-1) / (m-1)) for a whole i; the only
    candidate is the smallest i that reaches p, so no join is needed.
    """
    if max_points is None:
        return sized
    m, n, pos = F.lit(int(max_points)).cast("bigint"), F.col("n_points"), F.col("pos")
    if max_points == 1:
        thin, kept = F.lit(0).cast("bigint"), pos == 0
    else:
        thin = F.floor((pos * (m - 1) + (n - 2)) / F.greatest(n - 1, F.lit(1)))
        kept = F.floor(thin * (n - 1) / (m - 1)) == pos
    longer = n > m
    return sized.filter(~longer | kept).select(
        *[c for c in sized.columns if c not in ("pos", "n_points")],
        F.when(longer, thin).otherwise(pos).cast("bigint").alias("pos"),
        F.when(longer, m).otherwise(n).alias("n_points"),
    )


def assign_traj_ids(sized: DataFrame) -> DataFrame:
    """Dense ids 0..N-1 in (vessel, segment) order.

    Only the table of segments is numbered; its size per row is one track.
    """
    kept = materialize(sized)
    heads = kept.filter(F.col("pos") == 0).select("mmsi", "segment")
    ids = order_index(heads, [F.col("mmsi"), F.col("segment")], out="traj_id")
    longest = kept.agg(F.max("n_points")).first()[0] or 0
    return with_bound(kept.join(ids, ["mmsi", "segment"]), "traj_id", longest)


def turn_score(points: DataFrame) -> DataFrame:
    """Heading change to the previous point as a share of 180 degrees."""
    stepped = neighbors(points, ["traj_id"], "pos", {"_h": ("heading", -1)}, "traj_id")
    turn = heading_change("_h", "heading") / 180.0
    value = F.when((F.col("n_points") > 2) & (F.col("pos") > 0), turn).otherwise(F.lit(0.0))
    return stepped.withColumn("turn_score", value).drop("_h")


def start_end_flags(points: DataFrame) -> DataFrame:
    return points.withColumns(
        {"is_start": F.col("pos") == 0, "is_end": F.col("pos") == F.col("n_points") - 1}
    )


def build_points(
    reports: DataFrame,
    max_gap_s: float | None = 3600.0,
    min_points: int = 4,
    max_points: int | None = None,
) -> DataFrame:
    """POINTS from valid reports: segment, drop short, thin, number, flag, score turns."""
    cut = downsample(drop_short(segment_sizes(segment(reports, max_gap_s)), min_points), max_points)
    points = assign_traj_ids(cut).withColumnsRenamed({"sog": "speed", "cog": "heading"})
    points = turn_score(start_end_flags(points))
    keep = ["traj_id", "pos", "mmsi", "report_id", "t", "lat", "lon", "speed", "heading"]
    keep += ["is_start", "is_end", "turn_score", "n_points"]
    keep += ["source_id"] if "source_id" in points.columns else []
    return points.select(*keep, epoch_day().alias("day"))


def load_audit(
    reports: DataFrame,
    max_gap_s: float | None = 3600.0,
    min_points: int = 4,
    max_points: int | None = None,
) -> DataFrame:
    """One row of load counters: rows, refusals, duplicates, gaps, segments, points."""
    flagged = loader_flags(reports)
    bad = F.lit(False)
    for flag in INVALID_FLAGS:
        bad = bad | F.col(flag)
    repeats = (
        reports.groupBy("mmsi", "t").count().filter((F.col("count") > 1) & F.col("t").isNotNull())
    )
    rows = flagged.agg(
        F.count(F.lit(1)).alias("rows_loaded"),
        F.countDistinct("mmsi").alias("vessels"),
        *[F.count_if(flag).alias(f"rows_{flag}") for flag in INVALID_FLAGS],
        F.count_if(bad).alias("rows_invalid"),
        F.count_if(~bad).alias("rows_valid"),
    )
    again = repeats.agg(F.coalesce(F.sum("count"), F.lit(0)).alias("duplicate_time_rows"))
    segmented = segment(loader_validity(reports), max_gap_s)
    per_segment = segmented.groupBy("mmsi", "segment").agg(F.count(F.lit(1)).alias("n"))
    enough = F.col("n") >= min_points
    kept_points = F.col("n") if max_points is None else F.least(F.col("n"), F.lit(max_points))
    longer = F.lit(False) if max_points is None else F.col("n") > max_points
    shape = per_segment.agg(
        F.count(F.lit(1)).alias("segments"),
        F.count_if(F.col("segment") > 0).alias("gap_splits"),
        F.count_if(~enough).alias("short_segments"),
        F.coalesce(F.sum(F.when(~enough, F.col("n"))), F.lit(0)).alias("short_segment_rows"),
        F.count_if(enough).alias("segments_kept"),
        F.count_if(enough & longer).alias("segments_downsampled"),
        F.coalesce(F.sum(F.when(enough, F.col("n"))), F.lit(0)).alias("points_before_downsampling"),
        F.coalesce(F.sum(F.when(enough, kept_points)), F.lit(0)).alias("points_kept"),
    )
    return one_row(rows, again, shape)


def one_row(*tables: DataFrame) -> DataFrame:
    """Put one-row aggregates side by side, by scalar subqueries instead of joins."""
    first, *rest = tables
    out = first
    for table in rest:
        whole = table.select(F.struct(*table.columns)).scalar()
        out = out.withColumn("_row", whole).select(*out.columns, "_row.*")
    return out


def summary_stats(df: DataFrame, value: str, ties: list[str]) -> DataFrame:
    """count, min, p50, p75, p95, p99, max and mean of one column; zeros if empty."""
    base = df.agg(
        F.count(value).alias("count"),
        *[F.coalesce(f(value), F.lit(0.0)).alias(n) for n, f in (("min", F.min), ("max", F.max), ("mean", F.mean))],
    )
    probs = {"p50": 0.50, "p75": 0.75, "p95": 0.95, "p99": 0.99}
    tails = quantiles(df, value, probs, ties)
    return one_row(base, tails.select(*[F.coalesce(p, F.lit(0.0)).alias(p) for p in probs]))


def extent(points: DataFrame) -> DataFrame:
    """Smallest and largest time, latitude and longitude; zeros if there are no points."""
    aggs = []
    for axis in ("t", "lat", "lon"):
        aggs.append(F.coalesce(F.min(axis), F.lit(0.0)).alias(f"{axis}_min"))
        aggs.append(F.coalesce(F.max(axis), F.lit(0.0)).alias(f"{axis}_max"))
    return points.agg(*aggs)


def relative_seconds(df: DataFrame) -> DataFrame:
    """Seconds since the earliest report of the data set."""
    start = df.select(F.min("t")).scalar()
    return df.withColumn("t_rel", F.col("t") - start)


def trajectories(points: DataFrame) -> DataFrame:
    """One row per track."""
    cols = ["traj_id", "mmsi", "n_points"] + (["source_id"] if "source_id" in points.columns else [])
    return points.filter(F.col("pos") == 0).select(*cols)


def segment_blocks(points: DataFrame, size: int = 32) -> DataFrame:
    """Number fixed-size runs of points inside each track."""
    return points.withColumn("block", F.floor(F.col("pos") / size))


def chunk_windows(points: DataFrame, length: int, stride: int) -> DataFrame:
    """Overlapping chunks ``[start, start+length)`` of each track; every point in every chunk it belongs to.

    Starts step by ``stride`` until a chunk reaches the end of the track.
    """
    pos, n = F.col("pos"), F.col("n_points")
    first = F.greatest(F.ceil((pos - (length - 1)) / stride), F.lit(0))
    last_needed = F.greatest(F.ceil((n - length) / stride), F.lit(0))
    last = F.least(F.floor(pos / stride), last_needed)
    return (
        points.withColumn("chunk", F.explode(F.when(first <= last, F.sequence(first, last))))
        .withColumn("chunk_start", F.col("chunk") * stride)
        .withColumn("chunk_pos", pos - F.col("chunk") * stride)
    )


def _split_cut(df: DataFrame, seed: int) -> DataFrame:
    """Tracks in seeded random order."""
    keyed = df.withColumn("_u", unit_hash(seed, F.col("traj_id")))
    return order_index(keyed, [F.col("_u"), F.col("traj_id")], out="_i").drop("_u")


def split_trajectories(points: DataFrame, train: float = 0.70, validation: float = 0.15, seed: int = 0) -> DataFrame:
    """Whole tracks into train, validation and test with exact counts.

    train takes at least one track; validation at least one if more than one is
    left; an empty test set falls back to validation, then to train (both are then
    listed under both names).
    """
    shuffled = _split_cut(trajectories(points), seed)
    total = shuffled.count()
    n_train = min(total, max(1, int(train * total)))
    n_val = max(1, int(validation * total)) if total - n_train > 1 else 0
    n_val = min(n_val, total - n_train)
    i = F.col("_i")
    named = shuffled.withColumn(
        "split",
        F.when(i < n_train, "train").when(i < n_train + n_val, "validation").otherwise("test"),
    ).drop("_i")
    if total - n_train - n_val == 0:
        source = "validation" if n_val else "train"
        named = named.unionByName(named.filter(F.col("split") == source).withColumn("split", F.lit("test")))
    return named


def random_holdout(points: DataFrame, fraction: float, seed: int = 0) -> DataFrame:
    """Mark a seeded share of tracks as held out, leaving at least one on each side."""
    shuffled = _split_cut(trajectories(points), seed)
    total = shuffled.count()
    count = 0 if total <= 1 else min(total - 1, max(1, int(fraction * total)))
    return shuffled.withColumn("holdout", F.col("_i") < count).drop("_i")


def source_stratified_holdout(points: DataFrame, fraction: float, seed: int = 0) -> DataFrame:
    """Hold tracks out per source so that no source loses all its tracks."""
    tracks = trajectories(points).withColumn("_u", unit_hash(seed, F.col("traj_id")))
    sizes = tracks.groupBy("source_id").agg(F.count(F.lit(1)).alias("_n"))
    ranked = rank_within(tracks, ["source_id"], [F.col("_u"), F.col("traj_id")], "_r", None)
    wanted = F.least(F.greatest(F.floor(F.col("_n") * fraction), F.lit(1)), F.col("_n") - 1)
    joined = ranked.join(sizes, "source_id").withColumn("holdout", F.col("_r") <= wanted)
    return joined.drop("_u", "_n", "_r")


def source_counts(points: DataFrame) -> DataFrame:
    return trajectories(points).groupBy("source_id").agg(F.count(F.lit(1)).alias("tracks"))


def sample_by_stride(points: DataFrame, n: int) -> DataFrame:
    """Every n-th track, whole."""
    return points.filter(F.col("traj_id") % n == 0)


def cap_trajectories(points: DataFrame, n: int) -> DataFrame:
    """The first n tracks in load order."""
    return points.filter(F.col("traj_id") < n)

