"""Space-time box queries over POINTS and the geometry they need."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.geo import crosses_box, haversine_km, in_box
from ..plans.boxcount import covered_points
from ..plans.boxjoin import box_join
from ..plans.ordered import neighbors, scan

BOX_COLUMNS = ["lat_min", "lat_max", "lon_min", "lon_max", "t_start", "t_end"]
QUERY_TYPE_RANGE = "range"
FEATURE_WIDTH = 12


def _boxes(queries: DataFrame) -> DataFrame:
    return queries.select("query_id", *BOX_COLUMNS)


def range_query(points: DataFrame, box: dict[str, float], query_type: str = QUERY_TYPE_RANGE) -> DataFrame:
    """Ids of the tracks with at least one point in the box."""
    if query_type != QUERY_TYPE_RANGE:
        raise ValueError(f"unsupported query type: {query_type!r}")
    hit = (
        F.col("t").between(box["t_start"], box["t_end"])
        & F.col("lat").between(box["lat_min"], box["lat_max"])
        & F.col("lon").between(box["lon_min"], box["lon_max"])
    )
    return points.filter(hit).select("traj_id").distinct()


def query_hits(points: DataFrame, queries: DataFrame) -> DataFrame:
    """All (query, point) pairs with the point inside the box; keeps the point columns."""
    return box_join(points, _boxes(queries)).drop(*BOX_COLUMNS)


def track_segments(points: DataFrame) -> DataFrame:
    """Pairs of consecutive points of a track with their bounding box."""
    steps = neighbors(
        points.select("traj_id", "pos", "t", "lat", "lon"),
        ["traj_id"],
        "pos",
        {"t2": ("t", 1), "lat2": ("lat", 1), "lon2": ("lon", 1)},
        "traj_id",
    ).filter(F.col("t2").isNotNull())
    for axis in ("t", "lat", "lon"):
        steps = steps.withColumn(f"{axis}_lo", F.least(axis, f"{axis}2"))
        steps = steps.withColumn(f"{axis}_hi", F.greatest(axis, f"{axis}2"))
    return steps


def segment_crossings(points: DataFrame, queries: DataFrame) -> DataFrame:
    """Segments (traj_id, pos -> pos+1) that cross the boundary of a box."""
    spans = {axis: (f"{axis}_lo", f"{axis}_hi") for axis in ("t", "lat", "lon")}
    pairs = box_join(track_segments(points), _boxes(queries), spans)
    crossing = crosses_box(("t", "lat", "lon"), ("t2", "lat2", "lon2"))
    return pairs.filter(crossing).select("query_id", "traj_id", "pos")


def crossing_brackets(points: DataFrame, queries: DataFrame) -> DataFrame:
    """Both end points of every crossing segment, once per query."""
    ends = segment_crossings(points, queries).withColumn(
        "pos", F.explode(F.array(F.col("pos"), F.col("pos") + 1))
    )
    return ends.distinct()


def entry_exit_points(points: DataFrame, queries: DataFrame) -> DataFrame:
    """Points inside a box whose previous or next track point is outside or missing."""
    return hits_with_boundary(points, queries).filter("is_boundary").select("query_id", "traj_id", "pos")


def with_context(points: DataFrame) -> DataFrame:
    """Attach the positions before and after, so that box tests need no window over hits."""
    wanted = {f"{axis}_{name}": (axis, o) for axis in ("t", "lat", "lon") for name, o in (("prev", -1), ("next", 1))}
    return neighbors(points, ["traj_id"], "pos", wanted, "traj_id")


def boundary_flag() -> Column:
    """Is a hit (joined with its box) the first or last of a visit to the box?"""
    outside = [
        ~F.coalesce(in_box(f"t_{side}", f"lat_{side}", f"lon_{side}"), F.lit(False)) for side in ("prev", "next")
    ]
    return outside[0] | outside[1]


def hits_with_boundary(points: DataFrame, queries: DataFrame) -> DataFrame:
    """Hits with a flag ``is_boundary`` for entry and exit points."""
    pairs = box_join(with_context(points), _boxes(queries)).withColumn("is_boundary", boundary_flag())
    extra = [f"{a}_{s}" for a in ("t", "lat", "lon") for s in ("prev", "next")]
    return pairs.drop(*BOX_COLUMNS, *extra)


def distance_to_anchor(points: DataFrame, lat: float, lon: float) -> DataFrame:
    return points.withColumn("anchor_km", haversine_km("lat", "lon", lat, lon, floor=1e-9))


def with_steps(points: DataFrame) -> DataFrame:
    """Add ``step_km``, the distance from the previous point (0 at the start)."""
    near = neighbors(points, ["traj_id"], "pos", {"_la": ("lat", -1), "_lo": ("lon", -1)}, "traj_id")
    step = F.coalesce(haversine_km("_la", "_lo", "lat", "lon", floor=1e-9), F.lit(0.0))
    return near.withColumn("step_km", step).drop("_la", "_lo")


def path_length(points: DataFrame) -> DataFrame:
    return with_steps(points).groupBy("traj_id").agg(F.sum("step_km").alias("length_km"))


def cumulative_length(points: DataFrame) -> DataFrame:
    return scan(with_steps(points), ["traj_id"], "pos", {"cum_km": ("sum", "step_km")}, "traj_id")


def union_coverage(points: DataFrame, queries: DataFrame) -> DataFrame:
    """How many points at least one box covers."""
    covered = covered_points(points, queries)
    total = points.select(F.count(F.lit(1))).scalar()
    return covered.agg(F.count(F.lit(1)).alias("covered_points")).select(
        "covered_points",
        total.alias("total_points"),
        F.when(total > 0, F.col("covered_points") / total).otherwise(F.lit(0.0)).alias("coverage"),
    )


def query_features(queries: DataFrame, query_type: str = QUERY_TYPE_RANGE) -> DataFrame:
    """Numeric vector of each query, padded with zeros, and its type id."""
    if query_type != QUERY_TYPE_RANGE:
        raise ValueError(f"unsupported query type: {query_type!r}")
    used = [F.col(c).cast("double") for c in BOX_COLUMNS]
    padding = [F.lit(0.0)] * (FEATURE_WIDTH - len(used))
    return queries.select("query_id", F.array(*used, *padding).alias("features"), F.lit(0).alias("type_id"))
