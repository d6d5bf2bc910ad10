"""Cleaning of vessel reports: class filter, dedupe, trimming, types, impossible positions.

All operators work on the REPORTS schema (report_id, mmsi, t, lat, lon, sog, ...).
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.geo import allowed_km, haversine_km
from ..plans.materialize import materialize
from ..plans.ordered import attach, neighbors, rank_within, with_bound
from ..sources.reports import RAW_COLUMNS, type_reports

CLASS_A = "Class A"
UNDEFINED = "Undefined"
SEARCH_AND_RESCUE = "SAR"


def keep_class_a(raw: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """Only the eight raw columns, and those in ``keep``, of Class A transponders."""
    return raw.select(*RAW_COLUMNS, *keep).filter(F.col("mobile_raw") == CLASS_A)


def dedupe_exact(raw: DataFrame) -> DataFrame:
    """One of each group of equal reports; where reports have ids, with the smallest."""
    if "report_id" in raw.columns:
        return raw.groupBy(*RAW_COLUMNS).agg(F.min("report_id").alias("report_id"))
    return raw.dropDuplicates(list(RAW_COLUMNS))


def type_and_require(raw: DataFrame) -> DataFrame:
    """Typed reports that have a time, a position and a speed."""
    typed = type_reports(raw)
    for needed in ("ts", "lat", "lon", "sog"):
        typed = typed.filter(F.col(needed).isNotNull())
    return typed


def trim_stationary(df: DataFrame, bucket_s: int = 3600) -> DataFrame:
    """Of the reports with speed 0 keep the earliest per vessel and time bucket."""
    df = with_bound(df, "mmsi")
    when = F.struct("t", "report_id")
    tagged = attach(
        df.withColumn("_bucket", F.floor(F.col("t") / bucket_s)),
        ["mmsi", "_bucket"],
        {"_first": F.min(F.when(F.col("sog") == 0, when))},
        "mmsi",
    )
    return tagged.filter((F.col("sog") != 0) | (when == F.col("_first"))).drop("_bucket", "_first")


def fill_ship_type(df: DataFrame) -> DataFrame:
    """"Undefined" becomes NULL, then the earliest known type of the vessel."""
    df = with_bound(df, "mmsi")
    known = F.when(F.col("ship_type") != UNDEFINED, F.col("ship_type"))
    order = F.when(known.isNotNull(), F.struct("t", "report_id"))
    filled = attach(df, ["mmsi"], {"_type": F.min_by(known, order)}, "mmsi")
    return filled.withColumn("ship_type", F.coalesce(known, F.col("_type"))).drop("_type")


def drop_undefined_type(df: DataFrame) -> DataFrame:
    return df.filter(F.col("ship_type").isNotNull() & (F.col("ship_type") != UNDEFINED))


def drop_ship_types(df: DataFrame, sog_threshold: float = 50.0, min_datapoints: int = 25) -> DataFrame:
    """Drop rescue craft, and vessels without type that often report very high speed."""
    kept = df.filter(F.col("ship_type") != SEARCH_AND_RESCUE)
    suspects = (
        kept.filter(F.col("ship_type").isin(UNDEFINED, ""))
        .groupBy("mmsi")
        .agg(F.count_if(F.col("sog") > sog_threshold).alias("_fast"))
        .filter(F.col("_fast") >= min_datapoints)
        .select("mmsi")
    )
    return kept.join(suspects, "mmsi", "left_anti")


def in_order(df: DataFrame) -> DataFrame:
    """Add ``rank``, the 1-based order of each report in its vessel."""
    return rank_within(with_bound(df, "mmsi"), ["mmsi"], [F.col("t"), F.col("report_id")], "rank", "mmsi")


def reachable(offset: int, null_means: bool, margin: float = 1.2, scale: float = 0.3) -> tuple[Column, Column]:
    """Has the neighbour at ``offset``, and could the vessel have moved there?

    Reads the columns added by ``with_neighbors``.
    """
    tag = f"{'p' if offset < 0 else 'n'}{abs(offset)}"
    t, lat, lon, sog = (f"_{c}_{tag}" for c in ("t", "lat", "lon", "sog"))
    hours = F.abs(F.floor(F.col("t")) - F.floor(F.col(t))) / 3600.0
    if offset < 0:
        km = haversine_km(lat, lon, "lat", "lon")
    else:
        km = haversine_km("lat", "lon", lat, lon)
    close = F.coalesce(km <= allowed_km("sog", sog, hours, margin, scale), F.lit(null_means))
    return F.col(t).isNotNull(), close


def with_neighbors(df: DataFrame, offsets: tuple[int, ...]) -> DataFrame:
    wanted = {}
    for o in offsets:
        tag = f"{'p' if o < 0 else 'n'}{abs(o)}"
        wanted.update({f"_{c}_{tag}": (c, o) for c in ("t", "lat", "lon", "sog")})
    return neighbors(in_order(df), ["mmsi"], "rank", wanted, "mmsi")


def reachability(df: DataFrame, null_means: bool = True, margin: float = 1.2, scale: float = 0.3) -> DataFrame:
    """Flags ``has_*`` and ``reach_*`` for the neighbours one and two places away."""
    wide = with_neighbors(df, (-2, -1, 1, 2))
    flags = {}
    for o in (-2, -1, 1, 2):
        tag = f"{'p' if o < 0 else 'n'}{abs(o)}"
        flags[f"has_{tag}"], flags[f"reach_{tag}"] = reachable(o, null_means, margin, scale)
    return wide.withColumns(flags).select(*df.columns, "rank", *flags)


def clean_head(df: DataFrame, margin: float = 1.2, scale: float = 0.3) -> DataFrame:
    """Drop impossible points among each vessel's first three, judged on the unmodified track."""
    wide = with_neighbors(df, (-1, 1, 2))
    (_, prev), (has_next, nxt), (has_next2, next2) = (reachable(o, False, margin, scale) for o in (-1, 1, 2))
    first = (F.col("rank") == 1) & ~nxt & ~next2 & has_next2
    second_third = F.col("rank").isin(2, 3) & ~prev & ~nxt & has_next
    return wide.filter(~(first | second_third)).select(*df.columns)


def bidirectional_pass(df: DataFrame, margin: float = 1.2, scale: float = 0.3) -> DataFrame:
    """Drop points that neither direct neighbour can explain."""
    wide = with_neighbors(df, (-1, 1))
    (has_prev, prev), (has_next, nxt) = (reachable(o, True, margin, scale) for o in (-1, 1))
    return wide.filter(~has_prev | ~has_next | prev | nxt).select(*df.columns)


def skip_neighbor_pass(df: DataFrame, margin: float = 1.2, scale: float = 0.3) -> DataFrame:
    """Drop points isolated from their second neighbours."""
    wide = with_neighbors(df, (-2, -1, 1, 2))
    (has_p2, p2), (has_p1, p1), (has_n1, n1), (has_n2, n2) = (
        reachable(o, True, margin, scale) for o in (-2, -1, 1, 2)
    )
    interior = has_p2 & has_n2 & ~p2 & ~n2
    at_start = ~has_p2 & has_n1 & has_n2 & ~n1 & ~n2
    at_end = has_p1 & has_p2 & ~has_n2 & ~p1 & ~p2
    return wide.filter(~(interior | at_start | at_end)).select(*df.columns)


def until_stable(
    df: DataFrame, one_pass: Callable[[DataFrame], DataFrame], max_iter: int = 3, phase: str = "pass"
) -> tuple[DataFrame, list[tuple[str, int]]]:
    """Repeat a pass until it removes nothing; each round is written, which also cuts the lineage."""
    before, log = df.count(), []
    for i in range(max_iter):
        df = materialize(one_pass(df))
        after = df.count()
        log.append((f"{phase}_{i + 1}", before - after))
        if after == before:
            break
        before = after
    return df, log


def outlier_detector(
    df: DataFrame, margin: float = 1.2, scale: float = 0.3, max_passes: int = 3
) -> tuple[DataFrame, DataFrame]:
    """Head check, one two-sided pass, then skip-neighbour passes; and rows removed per phase."""
    start = with_bound(materialize(df), "mmsi")
    head = materialize(clean_head(start, margin, scale))
    both = materialize(bidirectional_pass(head, margin, scale))
    sizes = [start.count(), head.count(), both.count()]
    done, log = until_stable(both, lambda d: skip_neighbor_pass(d, margin, scale), max_passes, "skip_neighbor")
    phases = [("head", sizes[0] - sizes[1]), ("bidirectional", sizes[1] - sizes[2]), *log]
    rows = [(i, name, removed) for i, (name, removed) in enumerate(phases)]
    removed = df.sparkSession.createDataFrame(rows, "step int, phase string, removed bigint")
    return done, removed


def clean_typed(df: DataFrame, skip_trim: bool = False, bucket_s: int = 3600, **limits) -> DataFrame:
    """The cleaning job from typed reports on."""
    df = with_bound(df, "mmsi")
    kept = df if skip_trim else trim_stationary(df, bucket_s)
    kept = drop_ship_types(drop_undefined_type(fill_ship_type(kept)), **limits)
    return outlier_detector(kept)[0]


def clean_reports(raw: DataFrame, skip_trim: bool = False, **limits) -> DataFrame:
    """The whole job: class filter, dedupe, typing, trimming, ship types, outliers.

    Reports of a vessel at equal times are in the order of their ``report_id`` where the
    raw table has it, else of a hash of their content.
    """
    ids = tuple(c for c in raw.columns if c == "report_id")
    typed = type_and_require(dedupe_exact(keep_class_a(raw, ids)))
    return clean_typed(materialize(typed), skip_trim, **limits)
