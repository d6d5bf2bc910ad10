"""Incremental load: continue where the last run stopped, each file exactly once.

The ledger decides what is new.  A batch of new files is read by the header of each file,
judged, and written to folders named by the batch number; its ledger rows come last.  A
batch that fails before that is done again under the same number and replaces itself, and
``read_committed`` shows only what the ledger has.  One loader may run on a folder at a time.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.ledger import FILE_SCHEMA, LEDGER_SCHEMA, ledger_filter, list_files, read_ledger
from ..sources.reports import REJECT_REASONS, judge_reports, read_layouts


def _counts(tagged: DataFrame, files: DataFrame) -> DataFrame:
    """One ledger row per file, also for files without rows."""
    reason = F.col("reason")
    per_file = tagged.groupBy("source_file").agg(
        F.count(F.lit(1)).alias("rows_read"),
        F.count_if(reason.isNull()).alias("rows_inserted"),
        F.count_if(reason.isNotNull()).alias("rows_skipped"),
        *[F.count_if(F.coalesce(reason == r, F.lit(False))).alias(f"skip_{r}") for r in REJECT_REASONS],
    )
    joined = files.join(per_file, files["uri"] == per_file["source_file"], "left").fillna(0).withColumn("status", F.lit("done"))
    return joined.select(*[x.split()[0] for x in LEDGER_SCHEMA.split(", ")])


def start_ledger(spark: SparkSession, folder: str) -> None:
    """An empty batch 0, so that the ledger can be read before anything is loaded; an existing ledger is kept."""
    spark.createDataFrame([], LEDGER_SCHEMA).write.mode("ignore").parquet(f"{folder}/batch=0")


def reset_file(spark: SparkSession, out: str, path: str) -> None:
    """Forget that a file was loaded; the next load takes it again.  Rows it has brought stay."""
    batch = _next_batch(spark, out)
    row = read_ledger(spark, f"{out}/ledger").filter(F.col("path") == path).drop("batch").withColumn("status", F.lit("reset"))
    row.write.mode("overwrite").parquet(f"{out}/ledger/batch={batch}")


def _next_batch(spark: SparkSession, out: str) -> int:
    return 1 + (spark.read.schema(f"{LEDGER_SCHEMA}, batch int").parquet(f"{out}/ledger").agg(F.max("batch")).first()[0] or 0)


def ingest_incremental(spark: SparkSession, src_dir: str, out: str, sep: str | None = None, files_per_batch: int = 100) -> int:
    """Load all files below ``src_dir`` that the ledger does not know, and return how many there were.

    Writes ``out/good``, ``out/rejects`` and ``out/ledger``.  A file whose size or time
    changed since it was loaded is an error, and so is a file without a required column.
    """
    start_ledger(spark, f"{out}/ledger")
    files = list_files(spark, [src_dir])
    new = ledger_filter(files, read_ledger(spark, f"{out}/ledger")).orderBy("path").collect()
    for start in range(0, len(new), files_per_batch):
        load_files(spark, new[start : start + files_per_batch], out, sep)
    return len(new)


def load_files(spark: SparkSession, part: list, out: str, sep: str | None = None) -> None:
    """Read, judge and write the files ``part`` (rows of ``list_files``) as the next batch; its ledger rows come last."""
    batch = _next_batch(spark, out)
    tagged = judge_reports(read_layouts(spark, [r["path"] for r in part], sep, keep_file=True), ("source_file",)).persist()
    good = tagged.filter(F.col("reason").isNull()).drop("reason", "source_file")
    good.write.mode("overwrite").parquet(f"{out}/good/batch={batch}")
    tagged.filter(F.col("reason").isNotNull()).write.mode("overwrite").parquet(f"{out}/rejects/batch={batch}")
    listed = spark.createDataFrame(part, FILE_SCHEMA)
    _counts(tagged, listed).write.mode("overwrite").parquet(f"{out}/ledger/batch={batch}")
    tagged.unpersist()


def read_committed(spark: SparkSession, out: str, what: str = "good") -> DataFrame:
    """Rows of ``good`` or ``rejects`` whose batch has its ledger rows; what a load has not finished is not seen."""
    done = spark.read.schema(f"{LEDGER_SCHEMA}, batch int").parquet(f"{out}/ledger").select("batch").distinct()
    return spark.read.parquet(f"{out}/{what}").join(F.broadcast(done), "batch", "left_semi").drop("batch")
