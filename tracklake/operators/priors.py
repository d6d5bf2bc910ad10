"""Gridded priors learned from training points and queries, and sampling them.

Grids are sparse tables: ``cells`` has one row per spatial cell, ``clock`` one per
(time-of-day bin, cell), ``extent`` one row.  A missing cell has value 0.
"""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.geo import clamp
from ..functions.hashing import unit_hash
from ..plans.materialize import materialize
from ..plans.ordered import order_index
from .ranges import crossing_brackets, hits_with_boundary
from .tracks import extent, one_row

GRID_BINS, CLOCK_BINS, PASSES = 64, 24, 2
DAY = 86400.0
FIELDS = ("query_hit", "query_hit_clock", "entry_exit", "crossing", "behavior", "route_density")
CELL_FIELDS = tuple(f for f in FIELDS if f != "query_hit_clock")
MAX_BROADCAST_CELLS = 1_000_000


@dataclass(frozen=True)
class Prior:
    cells: DataFrame
    clock: DataFrame
    extent: dict
    bins: int = GRID_BINS
    clock_bins: int = CLOCK_BINS
    passes: int = PASSES
    outside: str = "zero"
    profile_id: str = "free"
    ablation: str | None = None


def prior_extent(points: DataFrame, queries: DataFrame) -> DataFrame:
    """Union extent of points and boxes."""
    q = queries.agg(
        F.min("t_start").alias("q_t_min"), F.max("t_end").alias("q_t_max"),
        *[f(f"{a}_{s}").alias(f"q_{a}_{s}") for a in ("lat", "lon") for s, f in (("min", F.min), ("max", F.max))],
    )
    both = one_row(extent(points), q)
    cols = [f"{a}_{s}" for a in ("t", "lat", "lon") for s in ("min", "max")]
    return both.select(*[(F.least if c.endswith("min") else F.greatest)(c, f"q_{c}").alias(c) for c in cols])


def _bin(axis: str, e: dict, bins: int, value: Column | None = None) -> Column:
    low, span = e[f"{axis}_min"], max(1e-9, e[f"{axis}_max"] - e[f"{axis}_min"])
    raw = F.floor(((F.col(axis) if value is None else value) - F.lit(low)) / F.lit(span) * bins)
    return F.least(F.greatest(raw, F.lit(0)), F.lit(bins - 1)).cast("int")


def cell_of(points: DataFrame, e: dict, bins: int = GRID_BINS) -> DataFrame:
    """Add ``lat_bin`` and ``lon_bin`` under a fixed extent."""
    return points.withColumns({"lat_bin": _bin("lat", e, bins), "lon_bin": _bin("lon", e, bins)})


def clock_bin(t: Column | str = "t", bins: int = CLOCK_BINS) -> Column:
    """Time-of-day bin."""
    t = F.col(t) if isinstance(t, str) else t
    phase = F.pmod(t, F.lit(DAY)) / DAY
    return F.least(F.floor(phase * bins), F.lit(bins - 1)).cast("int")


def _touched(lo: Column, hi: Column, low: float, step: float, bins: int) -> Column:
    """Bins whose closed interval meets [lo, hi]; empty array if none."""
    first = F.greatest(F.ceil((lo - F.lit(low)) / F.lit(step)) - 1, F.lit(0)).cast("int")
    last = F.least(F.floor((hi - F.lit(low)) / F.lit(step)), F.lit(bins - 1)).cast("int")
    return F.when(first <= last, F.sequence(first, last)).otherwise(F.array().cast("array<int>"))


def clock_bins_of(bins: int = CLOCK_BINS) -> Column:
    """Time-of-day bins a box overlaps, wrapping midnight; all if it lasts a day or more."""
    start, end = F.pmod(F.col("t_start"), F.lit(DAY)), F.pmod(F.col("t_end"), F.lit(DAY))
    step = DAY / bins
    plain = _touched(start, end, 0.0, step, bins)
    wrapped = F.array_distinct(F.concat(_touched(start, F.lit(DAY), 0.0, step, bins), _touched(F.lit(0.0), end, 0.0, step, bins)))
    whole = F.sequence(F.lit(0), F.lit(bins - 1))
    return F.when(F.col("t_end") - F.col("t_start") >= DAY, whole).when(start <= end, plain).otherwise(wrapped)


def rasterize_queries(queries: DataFrame, e: dict, bins: int = GRID_BINS, clock_bins: int = CLOCK_BINS) -> tuple[DataFrame, DataFrame]:
    """Share of queries that touch each cell, and each (clock bin, cell)."""
    total = float(max(1, queries.count()))
    lat_step, lon_step = ((e[f"{a}_max"] - e[f"{a}_min"]) / bins for a in ("lat", "lon"))
    rows = queries.withColumn("clock_bins", clock_bins_of(clock_bins))
    rows = rows.withColumn("lat_bin", F.explode(_touched(F.col("lat_min"), F.col("lat_max"), e["lat_min"], max(lat_step, 1e-12), bins)))
    rows = rows.withColumn("lon_bin", F.explode(_touched(F.col("lon_min"), F.col("lon_max"), e["lon_min"], max(lon_step, 1e-12), bins)))
    share = clamp(F.count(F.lit(1)) / F.lit(total)).alias("value")
    flat = rows.groupBy("lat_bin", "lon_bin").agg(share)
    clock = rows.withColumn("clock_bin", F.explode("clock_bins")).groupBy("clock_bin", "lat_bin", "lon_bin").agg(share)
    return flat, clock


def smooth_grid(grid: DataFrame, keys: list[str] = (), bins: int = GRID_BINS, passes: int = PASSES) -> DataFrame:
    """3x3 binomial smoothing with replicated edges, on a sparse (lat_bin, lon_bin, value) table.

    The kernel is separable: a cell gives weight 2 to itself and 1 to each side; at
    the border the side that falls outside comes back to the cell itself.
    """
    if bins <= 1:
        return grid

    def spread(axis: str) -> Column:
        b = F.col(axis)
        own = F.lit(2) + (b == 0).cast("int") + (b == bins - 1).cast("int")
        sides = [F.when(b > 0, F.struct((b - 1).alias("b"), F.lit(1).alias("w"))), F.when(b < bins - 1, F.struct((b + 1).alias("b"), F.lit(1).alias("w")))]
        return F.array_compact(F.array(F.struct(b.alias("b"), own.alias("w")), *sides))

    for _ in range(passes):
        wide = grid.withColumn("_y", F.explode(spread("lat_bin"))).withColumn("_x", F.explode(spread("lon_bin")))
        grid = wide.groupBy(*keys, F.col("_y.b").alias("lat_bin"), F.col("_x.b").alias("lon_bin")).agg(
            F.sum(F.col("value") * F.col("_y.w") * F.col("_x.w") / 16.0).alias("value")
        )
    return grid.withColumn("value", clamp(F.col("value")))


def build_prior_fields(
    points: DataFrame,
    queries: DataFrame,
    behavior: DataFrame | None = None,
    bins: int = GRID_BINS,
    clock_bins: int = CLOCK_BINS,
    passes: int = PASSES,
    outside: str = "zero",
    profile_id: str = "free",
    crossings: DataFrame | None = None,
) -> Prior:
    """Six fields from training points and queries only.

    ``behavior`` is (traj_id, pos, behavior); without it the hit probability is used.
    """
    if outside not in ("zero", "nearest"):
        raise ValueError(f"unknown outside mode: {outside!r}")
    e = prior_extent(points, queries).first().asDict()
    total = float(max(1, queries.count()))
    slim = cell_of(points.select("traj_id", "pos", "t", "lat", "lon", "n_points"), e, bins)
    hits = hits_with_boundary(slim.drop("lat_bin", "lon_bin"), queries)
    crossings = crossing_brackets(points, queries) if crossings is None else crossings
    per_point = hits.select("traj_id", "pos", F.lit(1).alias("h"), F.col("is_boundary").cast("int").alias("b"), F.lit(0).alias("c"))
    per_point = per_point.unionByName(crossings.select("traj_id", "pos", F.lit(0).alias("h"), F.lit(0).alias("b"), F.lit(1).alias("c")))
    per_point = per_point.groupBy("traj_id", "pos").agg(*[F.sum(k).alias(k) for k in "hbc"])
    wide = slim.join(per_point, ["traj_id", "pos"], "left").na.fill(0, ["h", "b", "c"])
    moving = clamp(F.col("h") / total)
    if behavior is not None:
        wide = wide.join(behavior.select("traj_id", "pos", "behavior"), ["traj_id", "pos"], "left")
        moving = clamp(F.coalesce("behavior", F.lit(0.0)))
    raw = materialize(
        wide.groupBy("lat_bin", "lon_bin").agg(
            F.avg(clamp(F.col("b") / total)).alias("entry_exit"),
            F.avg(clamp(F.col("c") / total)).alias("crossing"),
            F.avg(moving).alias("behavior"),
            F.count(F.lit(1)).alias("n"),
        )
    )
    busiest = raw.agg(F.max("n")).first()[0] or 1
    raw = raw.withColumn("route_density", F.log1p("n") / F.log1p(F.lit(float(busiest))))
    flat, clock = rasterize_queries(queries, e, bins, clock_bins)
    long = raw.unpivot(["lat_bin", "lon_bin"], ["entry_exit", "crossing", "behavior", "route_density"], "field", "value")
    long = long.filter("value > 0").unionByName(flat.withColumn("field", F.lit("query_hit")))
    smooth = smooth_grid(long, ["field"], bins, passes)
    cells = smooth.groupBy("lat_bin", "lon_bin").pivot("field", list(CELL_FIELDS)).agg(F.first("value")).na.fill(0.0)
    clock = smooth_grid(clock, ["clock_bin"], bins, passes).withColumnRenamed("value", "query_hit_clock")
    return Prior(materialize(cells), materialize(clock), e, bins, clock_bins, passes, outside, profile_id)


def sample_prior(points: DataFrame, prior: Prior) -> DataFrame:
    """Six prior values per point."""
    e = prior.extent
    lat, lon = F.col("lat"), F.col("lon")
    inside = lat.between(e["lat_min"], e["lat_max"]) & lon.between(e["lon_min"], e["lon_max"])
    placed = points.select(
        "traj_id", "pos", "lat", "lon", clock_bin("t", prior.clock_bins).alias("clock_bin"),
        _bin("lat", e, prior.bins).alias("lat_bin"), _bin("lon", e, prior.bins).alias("lon_bin"),
        (F.lit(True) if prior.outside == "nearest" else inside).alias("_in"),
    )
    cells, clock = prior.cells, prior.clock
    if prior.bins * prior.bins * prior.clock_bins <= MAX_BROADCAST_CELLS:  # grids cannot be larger than this
        cells, clock = F.broadcast(cells), F.broadcast(clock)
    both = placed.join(cells, ["lat_bin", "lon_bin"], "left").join(clock, ["clock_bin", "lat_bin", "lon_bin"], "left")
    return both.select("traj_id", "pos", *[F.when(F.col("_in"), clamp(F.coalesce(f, F.lit(0.0)))).otherwise(F.lit(0.0)).alias(f) for f in FIELDS])


def zero_prior(prior: Prior) -> Prior:
    """The same grids with nothing in them."""
    return replace(prior, cells=prior.cells.limit(0), clock=prior.clock.limit(0), ablation="zero")


def _shuffled(grid: DataFrame, keys: list[str], seed: int) -> DataFrame:
    values = [c for c in grid.columns if c not in keys]
    places = order_index(grid.select(*keys), [F.col(k) for k in keys], out="_i")
    keyed = grid.withColumn("_u", unit_hash("shuffle", seed, *[F.col(k) for k in keys]))
    mixed = order_index(keyed, [F.col("_u"), *[F.col(k) for k in keys]], out="_i").select("_i", *values)
    return places.join(mixed, "_i").drop("_i")


def shuffle_prior(prior: Prior, seed: int = 0) -> Prior:
    """The same values on other cells."""
    cells = _shuffled(prior.cells, ["lat_bin", "lon_bin"], seed)
    clock = _shuffled(prior.clock, ["clock_bin", "lat_bin", "lon_bin"], seed)
    return replace(prior, cells=cells, clock=clock, ablation="shuffle")


def prior_metadata(prior: Prior) -> DataFrame:
    """Provenance of a prior as one row."""
    spark = prior.cells.sparkSession
    row = (prior.profile_id, prior.bins, prior.clock_bins, prior.passes, prior.outside, prior.ablation, prior.cells.count(), prior.clock.count())
    schema = "profile_id string, grid_bins int, clock_bins int, passes int, outside string, ablation string, cells bigint, clock_cells bigint"
    return spark.createDataFrame([row], schema)


def prior_scores(sampled: DataFrame) -> DataFrame:
    """Scores that read each target straight off the prior."""
    c = F.col
    wide = sampled.withColumns(
        {
            "query_mass": clamp(0.70 * c("query_hit") + 0.30 * c("query_hit_clock")),
            "boundary_max": F.greatest("entry_exit", "crossing"),
        }
    )
    swap = c("query_mass") * (0.50 + c("behavior")) + 0.25 * c("boundary_max") * c("boundary_max")
    wide = wide.withColumn("replacement_score", clamp(swap))
    wide = wide.withColumn("block_score", clamp(0.70 * c("replacement_score") + 0.30 * c("route_density")))
    moving = clamp(0.50 * c("behavior") + 0.50 * c("entry_exit"))
    combined = c("query_mass") * (0.50 + moving) + 0.25 * c("entry_exit") * c("entry_exit")
    return wide.withColumn("combined", clamp(combined))
