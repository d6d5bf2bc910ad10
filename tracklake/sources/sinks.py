"""Writing reports, tracks, queries and results."""

from __future__ import annotations

import json

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.formatting import fixed
from ..functions.parsing import epoch_day
from ..plans.ordered import with_bound

# Column names and numbers of decimals of simplified track files.
SIMPLIFIED_FORMATS = {"Latitude": ("lat", 6), "Longitude": ("lon", 6), "SOG": ("speed", 2), "COG": ("heading", 2)}
UNKNOWN_MMSI_BASE = 100_000_000
CELL_DEGREES = 0.25
CLEAN_HEADERS = {
    "ts": "# Timestamp", "mobile_type": "Type of mobile", "mmsi": "MMSI", "lat": "Latitude",
    "lon": "Longitude", "sog": "SOG", "cog": "COG", "ship_type": "Ship type",
}


def write_clean_csv(df: DataFrame, path: str, partitions: int | None = None) -> None:
    """Cleaned reports as header CSV; ``partitions`` limits the number of files."""
    out = df.select(*[F.col(c).alias(h) for c, h in CLEAN_HEADERS.items()])
    out = out.coalesce(partitions) if partitions else out
    out.write.mode("overwrite").csv(path, header=True)


def ewkt(lon: str = "lon", lat: str = "lat") -> Column:
    return F.format_string("SRID=4326;POINT(%s %s)", F.col(lon).cast("string"), F.col(lat).cast("string"))


def grid_cell(lat: str = "lat", lon: str = "lon", degrees: float = CELL_DEGREES) -> Column:
    """Number of the point's cell in a fixed world grid."""
    columns = int(360 / degrees)
    row = F.floor((F.col(lat) + 90.0) / degrees)
    return (row * columns + F.floor((F.col(lon) + 180.0) / degrees)).cast("bigint")


def report_table(df: DataFrame) -> DataFrame:
    """Reports with point text, day and grid cell."""
    return df.withColumns({"geom": ewkt(), "day": epoch_day(), "cell": grid_cell()})


def write_report_table(df: DataFrame, path: str) -> None:
    """Durable table laid out for time and box queries.

    Day folders prune by time; rows are ranged by cell and sorted by vessel and time,
    so that the minimum and maximum kept per row group do the work of indexes.
    """
    table = report_table(df)
    table = table.repartitionByRange("day", "cell", "mmsi", "t").sortWithinPartitions("day", "cell", "mmsi", "t")
    table.write.mode("overwrite").partitionBy("day").parquet(path)


def write_report_jdbc(df: DataFrame, url: str, table: str, properties: dict[str, str]) -> None:
    report_table(df).write.mode("append").jdbc(url, table, properties=properties)


def simplified_rows(points: DataFrame, retained: DataFrame) -> DataFrame:
    """Kept points in the text form of simplified track files."""
    kept = points.join(retained.select("traj_id", "pos"), ["traj_id", "pos"], "left_semi")
    mmsi = F.coalesce(F.nullif(F.col("mmsi"), F.lit(0)), F.lit(UNKNOWN_MMSI_BASE) + F.col("traj_id"))
    stamp = fixed("t", 3)
    numbers = [fixed(c, digits).alias(h) for h, (c, digits) in SIMPLIFIED_FORMATS.items()]
    return kept.select("traj_id", "pos", mmsi.alias("MMSI"), stamp.alias("# Timestamp"), *numbers)


def write_simplified_csv(points: DataFrame, retained: DataFrame, path: str) -> None:
    rows = simplified_rows(points, retained).repartitionByRange("traj_id", "pos").sortWithinPartitions("traj_id", "pos")
    rows.drop("traj_id", "pos").write.mode("overwrite").csv(path, header=True)


def query_geojson(queries: DataFrame) -> DataFrame:
    """One GeoJSON polygon Feature per box: (query_id, feature)."""
    corners = [("lon_min", "lat_min"), ("lon_max", "lat_min"), ("lon_max", "lat_max"), ("lon_min", "lat_max"), ("lon_min", "lat_min")]
    ring = F.array(*[F.array(F.col(x), F.col(y)) for x, y in corners])

    def clock(c: str) -> Column:
        s = F.pmod(F.rint(c).cast("bigint"), F.lit(86400))
        return F.format_string("%02d:%02d", F.floor(s / 3600), F.floor(F.pmod(s, F.lit(3600)) / 60))

    names = ("lat_min", "lat_max", "lon_min", "lon_max", "t_start", "t_end")
    properties = F.struct(
        F.lit("range").alias("query_type"), *names, clock("t_start").alias("t_start_hm"), clock("t_end").alias("t_end_hm")
    )
    geometry = F.struct(F.lit("Polygon").alias("type"), F.array(ring).alias("coordinates"))
    feature = F.to_json(F.struct(F.lit("Feature").alias("type"), geometry.alias("geometry"), properties.alias("properties")))
    return queries.select("query_id", feature.alias("feature"))


def write_queries_geojson(queries: DataFrame, path: str) -> None:
    """One Feature per line."""
    query_geojson(queries).orderBy("query_id").select("feature").write.mode("overwrite").text(path)


def upsert_results(registry: DataFrame, rows: DataFrame) -> DataFrame:
    """Replace rows with the same run_id and keep the others."""
    return registry.join(rows.select("run_id").distinct(), "run_id", "left_anti").unionByName(rows, allowMissingColumns=True)


def append_event(rows: DataFrame, path: str, kind: str) -> None:
    """Add one event line per row to a JSON log."""
    event = rows.select("run_id", F.lit(kind).alias("kind"), F.to_json(F.struct(*rows.columns)).alias("payload"))
    event.write.mode("append").json(path)


# ---- materialised tracks ------------------------------------------------------------------


def cache_key(spark: SparkSession, sources: list[str], config: dict) -> str:
    """Hash of source identity (path, size, time of change) and configuration."""
    from .ledger import list_files

    files = list_files(spark, sources).orderBy("path").agg(
        F.to_json(F.array_sort(F.collect_list(F.struct("path", "size", F.col("modified").cast("string"))))).alias("f")
    )
    return files.select(F.sha2(F.concat_ws("|", "f", F.lit(json.dumps(config, sort_keys=True))), 256)).first()[0]


def materialize_points(make, spark: SparkSession, root: str, sources: list[str], config: dict) -> DataFrame:
    """Tracks for (sources, config): read them if they were written before, else make and write them.

    The manifest row is written last, so a table without it is made again.
    """
    key = cache_key(spark, sources, config)
    path = f"{root}/{key}"
    try:
        known = spark.read.json(f"{path}/manifest").first() is not None
    except AnalysisException as error:  # any other failure is not taken for a missing table
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        known = False
    if not known:
        make().write.mode("overwrite").partitionBy("day").parquet(f"{path}/points")
        points = spark.read.parquet(f"{path}/points")
        stats = points.agg(F.count(F.lit(1)).alias("points"), F.coalesce(F.max("n_points"), F.lit(0)).alias("longest"))
        row = stats.select(F.lit(key).alias("key"), F.lit(json.dumps(config, sort_keys=True)).alias("config"), "points", "longest")
        row.coalesce(1).write.mode("overwrite").json(f"{path}/manifest")
    return load_points(spark, path)


def load_points(spark: SparkSession, path: str) -> DataFrame:
    manifest = spark.read.json(f"{path}/manifest").first()
    return with_bound(spark.read.parquet(f"{path}/points"), "traj_id", manifest["longest"])
