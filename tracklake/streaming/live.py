"""Structured Streaming forms of the load and of the cut into segments.

The load is a file stream: Spark's checkpoint keeps which files it has seen, the ledger of
the batch load is the commit.  A run that is killed anywhere is repeated by the stream;
files that reached the ledger are left out, a batch that did not replaces itself.

Segments are session windows per vessel, so the state holds one row per open segment and
no reports; a segment is given out once the watermark has passed its end.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..sources.ledger import ledger_filter, read_ledger
from .ingest import load_files, start_ledger

#: What the file source reports of a file; its content is not read.
_FILE_FIELDS = "path string, modificationTime timestamp, length bigint, content binary"


def stream_ingest(
    spark: SparkSession, src_dir: str, out: str, checkpoint: str, sep: str | None = None, files_per_batch: int = 100, every: str | None = None
) -> StreamingQuery:
    """Load the files that appear below ``src_dir`` as ``ingest_incremental`` does.

    Without ``every`` the stream loads all files there are and ends; with it (a time like
    "1 minute") it goes on.
    """
    start_ledger(spark, f"{out}/ledger")
    found = spark.readStream.format("binaryFile").schema(_FILE_FIELDS).option("recursiveFileLookup", "true").option("maxFilesPerTrigger", files_per_batch).load(src_dir)
    files = found.select("path", F.col("length").alias("size"), F.col("modificationTime").alias("modified"), F.col("_metadata.file_path").alias("uri"))

    def load(batch: DataFrame, _: int) -> None:
        session = batch.sparkSession
        # at most ``files_per_batch`` rows
        new = ledger_filter(batch, read_ledger(session, f"{out}/ledger")).orderBy("path").collect()
        if new:
            load_files(session, new, out, sep)

    writer = files.writeStream.foreachBatch(load).option("checkpointLocation", checkpoint)
    return (writer.trigger(processingTime=every) if every else writer.trigger(availableNow=True)).start()


def closed_segments(reports: DataFrame, max_gap_s: float = 3600.0, late: str = "1 hour") -> DataFrame:
    """One row per segment of a stream of reports (mmsi, ts): first and last time and number of reports.

    Reports that come later than ``late`` behind the newest one are left out.  A gap of
    exactly ``max_gap_s`` stays inside a segment, as in the batch form.
    """
    gap = f"{int(round(max_gap_s * 1e6)) + 1} microseconds"
    session = reports.withWatermark("ts", late).groupBy("mmsi", F.session_window("ts", gap))
    return session.agg(F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"), F.count(F.lit(1)).alias("n_points")).drop("session_window")
