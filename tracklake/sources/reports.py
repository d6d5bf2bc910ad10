"""Reading raw position reports from text files, and checking them row by row."""

from __future__ import annotations

import csv
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .ledger import list_files
from ..functions.parsing import epoch_seconds, parse_ts, to_double, to_long, to_text

# Raw file headers and the names used here, in file order.
RAW_HEADERS = {
    "# Timestamp": "timestamp_raw",
    "Type of mobile": "mobile_raw",
    "MMSI": "mmsi_raw",
    "Latitude": "lat_raw",
    "Longitude": "lon_raw",
    "SOG": "sog_raw",
    "COG": "cog_raw",
    "Ship type": "ship_raw",
}
RAW_COLUMNS = tuple(RAW_HEADERS.values())

# Accepted spellings of the loader columns (lower case).
ALIASES = {
    "mmsi": ("mmsi", "ship_id", "vessel_id"),
    "lat": ("lat", "latitude"),
    "lon": ("lon", "longitude"),
    "speed": ("speed", "sog"),
    "heading": ("heading", "cog"),
    "timestamp": ("timestamp", "time", "datetime"),
}
DELIMITERS = (",", ";", "\t", "|")
REJECT_REASONS = ("missing_ts", "missing_core", "bad_coords")


def clean_header(name: str) -> str:
    """Header text without byte-order mark, '#' and blanks, in lower case."""
    return name.replace("﻿", "").strip().lstrip("#").strip().lower()


def normalize_headers(df: DataFrame, required: dict[str, str] | None = None) -> DataFrame:
    """Rename the eight required raw columns, whatever marks surround their names."""
    required = RAW_HEADERS if required is None else required
    found = {clean_header(c): c for c in df.columns}
    missing = [h for h in required if clean_header(h) not in found]
    if missing:
        raise ValueError(f"missing columns {missing}; found {df.columns}")
    return df.select(*[F.col(f"`{found[clean_header(h)]}`").alias(name) for h, name in required.items()])


def resolve_aliases(df: DataFrame) -> DataFrame:
    """Rename columns from any accepted spelling to the loader's names."""
    found = {clean_header(c): c for c in df.columns}
    picked, missing = {}, []
    for name, spellings in ALIASES.items():
        match = next((found[s] for s in spellings if s in found), None)
        if match is None:
            missing.append(name)
        picked[name] = match
    if missing:
        raise ValueError(f"missing columns {missing}; found {df.columns}")
    return df.select(*[F.col(f"`{col}`").alias(name) for name, col in picked.items()])


def header_columns(line: str, sep: str) -> list[str]:
    """Column names of a header line; a column without a name gets one from its place."""
    names = next(csv.reader([line.replace("\ufeff", "")], delimiter=sep), [])
    return [name if name.strip() else f"_c{i}" for i, name in enumerate(names)]


def layout_of(line: str, sep: str | None = None, required: dict[str, str] | None = None) -> tuple[str, tuple[str, ...]]:
    """(separator, columns) of a file with this header line: the separator under which all required names are found."""
    wanted = [clean_header(h) for h in (RAW_HEADERS if required is None else required)]
    options = [(mark, tuple(header_columns(line, mark))) for mark in (DELIMITERS if sep is None else (sep,))]
    return max(options, key=lambda o: (len(set(wanted) & {clean_header(c) for c in o[1]}), len(o[1])))


def first_line(spark: SparkSession, path: str) -> DataFrame:
    """The line at the start of a file, in one task.

    A large file is cut into several splits, and a limit over them takes the line of whichever
    arrives first; only the split that begins the file has the header.
    """
    begin = spark.read.text(path).filter(F.col("_metadata.file_block_start") == 0)
    return begin.coalesce(1).limit(1).select(F.lit(path).alias("path"), "value")


def first_lines(spark: SparkSession, paths: list[str], together: int = 64) -> dict[str, str]:
    """First line of each file; reads only the beginning of every file, many files per job."""
    found: dict[str, str] = {}
    for start in range(0, len(paths), together):
        heads = [first_line(spark, p) for p in paths[start : start + together]]
        found |= {r["path"]: r["value"] for r in reduce(DataFrame.union, heads).collect()}
    return found


def sniff_delimiter(spark: SparkSession, path: str) -> str:
    """The separator under which the header of a file holds the required columns."""
    return layout_of(first_lines(spark, [path]).get(path, ""))[0]


def read_layouts(spark: SparkSession, paths: list[str], sep: str | None = None, keep_file: bool = False) -> DataFrame:
    """Raw report columns of header files, each read by its own header; one scan per distinct layout.

    A file that lacks a required column is an error that lists file and columns.
    ``keep_file`` adds ``source_file``, the file's address as Spark reports it.
    """
    layouts: dict[tuple, list[str]] = {}
    missing = {}
    for path, line in first_lines(spark, paths).items():
        layout = layout_of(line, sep)
        absent = [h for h in RAW_HEADERS if clean_header(h) not in {clean_header(c) for c in layout[1]}]
        if absent:
            missing[path] = absent
        layouts.setdefault(layout, []).append(path)
    if missing:
        raise ValueError("missing columns: " + "; ".join(f"{p}: {', '.join(m)}" for p, m in sorted(missing.items())[:20]))
    if not layouts:
        fields = [*RAW_COLUMNS, *(["source_file"] if keep_file else [])]
        return spark.createDataFrame([], ", ".join(f"{c} string" for c in fields))
    parts = []
    for (mark, columns), files in layouts.items():
        place = {clean_header(c): i for i, c in reversed(list(enumerate(columns)))}
        schema = T.StructType([T.StructField(f"c{i}", T.StringType()) for i in range(len(columns))])
        raw = spark.read.csv(files, header=True, sep=mark, schema=schema, enforceSchema=True)
        wanted = [F.col(f"c{place[clean_header(h)]}").alias(name) for h, name in RAW_HEADERS.items()]
        parts.append(raw.select(*wanted, *([F.col("_metadata.file_path").alias("source_file")] if keep_file else [])))
    return reduce(DataFrame.unionByName, parts)


def read_reports_csv(spark: SparkSession, path: str | list[str], sep: str | None = ",") -> DataFrame:
    """Header CSV files with every column as text, found by name in each file; ``sep=None`` finds the separator per file."""
    paths = [r["path"] for r in list_files(spark, [path] if isinstance(path, str) else path).select("path").collect()]
    return read_layouts(spark, sorted(paths), sep)


def report_id() -> Column:
    """A repeatable id from the content of the row, used only to order equal times."""
    return F.xxhash64(*RAW_COLUMNS)


def type_reports(raw: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """REPORTS from raw text, with the columns in ``keep``; unreadable values become NULL."""
    ident = F.col("report_id") if "report_id" in raw.columns else report_id()
    ts = parse_ts("timestamp_raw")
    return raw.select(
        ident.alias("report_id"),
        to_long("mmsi_raw").alias("mmsi"),
        ts.alias("ts"),
        epoch_seconds(ts).alias("t"),
        to_text("mobile_raw").alias("mobile_type"),
        to_double("lat_raw").alias("lat"),
        to_double("lon_raw").alias("lon"),
        to_double("sog_raw").alias("sog"),
        to_double("cog_raw").alias("cog"),
        to_text("ship_raw").alias("ship_type"),
        *keep,
    )


def reject_reason() -> Column:
    """First failing rule of a typed report, NULL if it is good."""
    bad = ~(F.col("lat").between(-90.0, 90.0) & F.col("lon").between(-180.0, 180.0))
    return (
        F.when(F.col("ts").isNull(), "missing_ts")
        .when(F.col("mmsi").isNull() | F.col("lat").isNull() | F.col("lon").isNull(), "missing_core")
        .when(bad, "bad_coords")
    )


def judge_reports(raw: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """Typed rows with their reject reason."""
    return type_reports(raw, keep).withColumn("reason", reject_reason())


def validate_reports(raw: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(good rows, rejected rows with their reason)."""
    judged = judge_reports(raw)
    return judged.filter(F.col("reason").isNull()).drop("reason"), judged.filter(F.col("reason").isNotNull())


def reject_counts(raw: DataFrame) -> DataFrame:
    """Rows read, inserted and skipped, and skips per reason, in one pass."""
    reason = F.col("reason")
    return judge_reports(raw).agg(
        F.count(F.lit(1)).alias("rows_read"),
        F.count_if(reason.isNull()).alias("rows_inserted"),
        F.count_if(reason.isNotNull()).alias("rows_skipped"),
        *[F.count_if(F.coalesce(reason == r, F.lit(False))).alias(f"skip_{r}") for r in REJECT_REASONS],
    )


def combine_days(spark: SparkSession, paths: list[str]) -> tuple[DataFrame, DataFrame]:
    """Day files as one table, and rows and distinct vessels per file and in total.

    All files must spell the vessel column alike.  Files with equal headers are one scan.
    """
    if not paths:
        raise ValueError("at least one input file is needed")
    files: dict[str, str] = {}
    for path in paths:
        for r in list_files(spark, [path]).select("path").collect():
            files[r["path"]] = path
    layouts: dict[tuple[str, ...], list[str]] = {}
    spellings: dict[str, str] = {}
    for file, line in first_lines(spark, sorted(files)).items():
        columns = tuple(header_columns(line, ","))
        spelling = next((c for c in ("MMSI", "mmsi") if c in columns), None)
        if spelling is None:
            raise ValueError(f"no MMSI column in {file}; found {list(columns)}")
        spellings.setdefault(spelling, file)
        layouts.setdefault(columns, []).append(file)
    if len(spellings) > 1:
        raise ValueError(f"files spell the vessel column in different ways: {spellings}")
    given = F.create_map(*[F.lit(x) for r in list_files(spark, sorted(files)).collect() for x in (r["uri"], files[r["path"]])])
    frames = [spark.read.csv(group, header=True, inferSchema=False).withColumn("source_file", given[F.col("_metadata.file_path")]) for group in layouts.values()]
    combined = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)
    counts = combined.groupingSets([["source_file"], []], "source_file").agg(
        F.count(F.lit(1)).alias("rows"), F.countDistinct(next(iter(spellings))).alias("vessels")
    )
    return combined, counts


def filter_ids(df: DataFrame, ids: DataFrame, col: str = "mmsi", max_broadcast: int = 1_000_000) -> DataFrame:
    """Rows whose id is listed in ``ids`` (one column ``col``)."""
    listed = ids.select(col).distinct()
    if listed.count() <= max_broadcast:
        listed = F.broadcast(listed)
    return df.join(listed, col, "left_semi")


def kept_and_total(df: DataFrame, ids: DataFrame, col: str = "mmsi") -> DataFrame:
    """How many rows an id list keeps."""
    kept = filter_ids(df, ids, col).select(F.count(F.lit(1))).scalar()
    return df.agg(F.count(F.lit(1)).alias("total")).select(kept.alias("kept"), "total")


def read_ids(spark: SparkSession, path: str, col: str = "mmsi") -> DataFrame:
    """Ids from a text file, one per line, blanks skipped."""
    lines = spark.read.text(path).select(to_text("value").alias(col))
    return lines.filter(F.col(col).isNotNull()).distinct()


def assert_distinct_sources(named_paths: dict[str, list[str]]) -> None:
    """The same file may not serve two splits."""
    seen: dict[str, str] = {}
    for name, paths in named_paths.items():
        for path in paths:
            if path in seen and seen[path] != name:
                raise ValueError(f"{path} is used for both {seen[path]} and {name}")
            seen[path] = name
