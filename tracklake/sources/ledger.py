"""A ledger of loaded files: each is known by path, size and time of change."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

FILE_COLUMNS = ["path", "size", "modified"]
FILE_SCHEMA = "path string, size bigint, modified timestamp, uri string"
LEDGER_SCHEMA = (
    "path string, size bigint, modified timestamp, rows_read bigint, rows_inserted bigint, rows_skipped bigint, "
    "skip_missing_ts bigint, skip_missing_core bigint, skip_bad_coords bigint, status string"
)


def list_files(spark: SparkSession, paths: list[str]) -> DataFrame:
    """Path, size and time of change of files, and ``uri``, the address that reads report; their content is not read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(paths)
    return files.select("path", F.col("length").alias("size"), F.col("modificationTime").alias("modified"), F.col("_metadata.file_path").alias("uri"))


def empty_ledger(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([], LEDGER_SCHEMA)


def changed_files(files: DataFrame, ledger: DataFrame) -> DataFrame:
    """Files whose size or time changed since they were loaded."""
    old = ledger.select("path", F.col("size").alias("_size"), F.col("modified").alias("_modified"))
    both = files.join(old, "path")
    return both.filter((F.col("size") != F.col("_size")) | (F.col("modified") != F.col("_modified"))).select(*FILE_COLUMNS)


def ledger_filter(files: DataFrame, ledger: DataFrame) -> DataFrame:
    """Files still to load; a known path with other metadata is an error."""
    changed = [r["path"] for r in changed_files(files, ledger).limit(5).collect()]
    if changed:
        raise ValueError(f"files changed after they were loaded: {changed}; reset them to load them again")
    return files.join(ledger.select(*FILE_COLUMNS), FILE_COLUMNS, "left_anti")


def ledger_upsert(ledger: DataFrame, rows: DataFrame) -> DataFrame:
    """The ledger with the given rows replaced or added."""
    return ledger.join(rows.select("path"), "path", "left_anti").unionByName(rows, allowMissingColumns=True)


def ledger_reset(ledger: DataFrame, path: str) -> DataFrame:
    return ledger.filter(F.col("path") != path)


def read_ledger(spark: SparkSession, folder: str) -> DataFrame:
    """The ledger that a load keeps in ``folder``: the last row of each path, without the paths that were reset."""
    rows = spark.read.schema(f"{LEDGER_SCHEMA}, batch int").parquet(folder)
    last = rows.groupBy("path").agg(F.max_by(F.struct(*[c for c in rows.columns if c != "path"]), "batch").alias("r"))
    return last.select("path", "r.*").filter(F.col("status") != "reset")
