"""Describing workloads and comparing them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..plans.boxcount import count_in_boxes, first_duplicates
from ..plans.boxpairs import overlaps
from ..plans.materialize import materialize
from ..plans.ordered import order_index, scan, with_bound
from .ranges import BOX_COLUMNS, query_hits
from .tracks import extent, one_row

# Limits of the signature gate and of the support-overlap gate.
SIGNATURE_LIMITS = {
    "anchor_family_l1_distance": 0.12,
    "footprint_family_l1_distance": 0.12,
    "point_hit_distribution_ks": 0.20,
    "ship_hit_distribution_ks": 0.20,
    "near_duplicate_rate": 0.05,
    "broad_query_rate": 0.05,
}
MIN_SIGNATURE_QUERIES = 8
SUPPORT_LIMITS = {
    "outside_extent": ("max", 0.10),
    "any_prior_share": ("min", 0.50),
    "primary_prior_share": ("min", 0.30),
    "route_density_share": ("min", 0.25),
    "query_prior_share": ("min", 0.25),
}
OVERSHOOT_LIMITS = ((0.05, 0.0050), (0.10, 0.0075), (0.15, 0.0100))
OVERSHOOT_LIMIT_ABOVE = 0.0200
MAX_REJECTION_RATE = 0.85
COMPARED_FIELDS = (
    "query_count",
    "coverage",
    "empty_query_rate",
    "too_broad_query_rate",
    "near_duplicate_query_rate",
    "point_hits_p50",
    "track_hits_p50",
    "point_share_p50",
    "track_share_p50",
    "volume_share_p50",
    "oracle_gap",
)


def _span(lo: str, hi: str) -> Column:
    return F.greatest(F.col(hi) - F.col(lo), F.lit(0.0))


def _volume(prefix: str = "") -> Column:
    return _span(f"{prefix}lat_min", f"{prefix}lat_max") * _span(f"{prefix}lon_min", f"{prefix}lon_max") * _span(f"{prefix}t_start", f"{prefix}t_end")


def _flat_pairs(queries: DataFrame) -> DataFrame:
    """Boxes without volume with the first of them."""
    flat = queries.filter(_volume() <= 1e-12).select("query_id")
    first = flat.agg(F.min("query_id")).first()[0]
    same = flat.filter(F.col("query_id") > F.lit(first)).withColumn("earlier_id", F.lit(first).cast("int"))
    return same.select("query_id", "earlier_id", F.lit(1.0).alias("iou"))


def box_iou(queries: DataFrame) -> DataFrame:
    """Intersection over union of overlapping boxes, for ordered pairs (earlier_id < query_id).

    Pairs that are not listed have IoU 0, as have boxes with missing bounds.  Boxes without
    volume count as equal; each is paired with the first of them only, which is the pair a
    duplicate search stops at.
    """
    return overlaps(queries).unionByName(_flat_pairs(queries))


def near_duplicates(queries: DataFrame, limit: float, first_block: int = 4096) -> DataFrame:
    """Per box with overlaps: the first earlier box whose IoU reaches ``limit``, and the largest IoU up to that one.

    Boxes are compared with blocks of earlier boxes, in their order, each twice as large as
    the one before; a box that has met its first duplicate needs no later block.  So boxes
    that lie close together cost little; only those without duplicate meet all earlier ones.
    Boxes with missing or infinite bounds have no IoU.
    """
    boxes = order_index(queries.select("query_id", *BOX_COLUMNS), [F.col("query_id")], out="_at")
    boxes = materialize(boxes.filter(F.least(*[F.abs(F.col(c)) < float("inf") for c in BOX_COLUMNS])))
    total = (boxes.agg(F.max("_at")).first()[0] or 0) + 1
    flat = _flat_pairs(queries)
    found = flat.select("query_id", *[F.when(F.lit(1.0 >= limit), F.col(c)).alias(c) for c in ("earlier_id", "iou")], F.col("iou").alias("top"))
    waiting, begin, size = boxes, 0, first_block
    while begin < total:
        block = boxes.filter((F.col("_at") >= begin) & (F.col("_at") < begin + size))
        step = materialize(first_duplicates(waiting.filter(F.col("_at") > begin), block, limit))
        found = found.unionByName(step)
        begin, size = begin + size, size * 2
        if begin < total:
            settled = step.filter(F.col("earlier_id").isNotNull()).select("query_id").distinct()
            # those inside the block have met all their earlier boxes
            waiting = materialize(waiting.filter(F.col("_at") > begin).join(settled, "query_id", "left_anti"))
            if waiting.isEmpty():
                break
    first = F.min(F.when(F.col("earlier_id").isNotNull(), F.struct("earlier_id", "iou")))
    best = found.groupBy("query_id").agg(first.alias("_first"), F.max("top").alias("_top"))
    return best.select("query_id", F.col("_first.earlier_id").alias("near_duplicate_of"), F.coalesce("_first.iou", "_top").alias("near_duplicate_iou"))


def hit_counts(hits: DataFrame, queries: DataFrame) -> DataFrame:
    """Points and tracks inside each box, zeros included."""
    per_track = hits.groupBy("query_id", "traj_id").agg(F.count(F.lit(1)).alias("_n"))
    return with_counts(queries, per_track.groupBy("query_id").agg(F.sum("_n").alias("point_hits"), F.count(F.lit(1)).alias("track_hits")))


def with_counts(queries: DataFrame, counts: DataFrame) -> DataFrame:
    return queries.select("query_id", *BOX_COLUMNS).join(counts, "query_id", "left").na.fill(0, ["point_hits", "track_hits"])


def span_fractions(points: DataFrame, counted: DataFrame) -> DataFrame:
    """Hit shares and box spans relative to the whole data set."""
    whole = one_row(
        extent(points),
        points.agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("pos") == 0).alias("tracks")),
    )
    wide = counted.withColumn("_w", whole.select(F.struct(*whole.columns)).scalar())

    def share(lo: str, hi: str, axis: str) -> Column:
        full = F.greatest(F.col(f"_w.{axis}_max") - F.col(f"_w.{axis}_min"), F.lit(1e-9))
        return F.least(_span(lo, hi) / full, F.lit(1.0))

    lat, lon, t = share("lat_min", "lat_max", "lat"), share("lon_min", "lon_max", "lon"), share("t_start", "t_end", "t")
    n, tracks = F.col("_w.n"), F.col("_w.tracks")
    return wide.withColumns(
        {
            "point_share": F.when(n > 0, F.col("point_hits") / n).otherwise(F.lit(0.0)),
            "track_share": F.when(tracks > 0, F.col("track_hits") / tracks).otherwise(F.lit(0.0)),
            "lat_span": lat,
            "lon_span": lon,
            "time_span": t,
            "volume_share": lat * lon * t,
        }
    ).drop("_w")


def query_diagnostics(points: DataFrame, queries: DataFrame, limits) -> DataFrame:
    """Per box: hits, shares, spans, empty / too broad / near-duplicate flags."""
    wide = span_fractions(points, with_counts(queries, count_in_boxes(points, queries)))
    broad = F.lit(False)
    for name, limit in (("point_share", limits.max_point_share), ("track_share", limits.max_track_share), ("volume_share", limits.max_volume_share)):
        if limit is not None:
            broad = broad | (F.col(name) > limit)
    wide = wide.withColumns({"is_empty": F.col("point_hits") == 0, "is_too_broad": broad})
    if limits.duplicate_iou is None:
        return wide.withColumns({"near_duplicate_of": F.lit(None).cast("int"), "near_duplicate_iou": F.lit(0.0)})
    best = near_duplicates(queries, limits.duplicate_iou)
    return wide.join(best, "query_id", "left").na.fill(0.0, ["near_duplicate_iou"])


def diagnostics_summary(diag: DataFrame) -> DataFrame:
    """One row: count, rates, and p10/p50/p90 of hits, shares and volumes."""
    aggs = [
        F.count(F.lit(1)).alias("query_count"),
        *[
            F.coalesce(F.avg(c.cast("double")), F.lit(0.0)).alias(n)
            for n, c in (
                ("empty_query_rate", F.col("is_empty")),
                ("too_broad_query_rate", F.col("is_too_broad")),
                ("near_duplicate_query_rate", F.col("near_duplicate_of").isNotNull()),
            )
        ],
    ]
    for c in ("point_hits", "track_hits", "point_share", "track_share", "volume_share"):
        for q in (0.10, 0.50, 0.90):
            aggs.append(F.coalesce(F.percentile(c, F.lit(q)), F.lit(0.0)).alias(f"{c}_p{int(q * 100)}"))
    return diag.agg(*aggs)


def label_diagnostics(labels: DataFrame, label: str, components: list[str] = ()) -> DataFrame:
    """Labelled and positive counts, mass and quantiles of a label; mass and share per component."""
    from ..plans.quantiles import quantiles

    value = F.col(label)
    base = labels.agg(
        F.count(label).alias("labelled"),
        F.count_if(value > 0).alias("positive"),
        F.coalesce(F.sum(label), F.lit(0.0)).alias("mass"),
        F.coalesce(F.max(label), F.lit(0.0)).alias("max"),
        *[F.coalesce(F.sum(c), F.lit(0.0)).alias(f"mass_{c}") for c in components],
    )
    probs = {"p50": 0.50, "p90": 0.90, "p95": 0.95}
    positive = quantiles(labels.filter(value > 0), label, probs, ["traj_id", "pos"])
    out = one_row(base, positive.select(*[F.coalesce(p, F.lit(0.0)).alias(p) for p in probs]))
    out = out.withColumn("positive_share", F.when(F.col("labelled") > 0, F.col("positive") / F.col("labelled")).otherwise(F.lit(0.0)))
    if components:
        total = sum((F.col(f"mass_{c}") for c in components), F.lit(0.0))
        out = out.withColumns({f"share_{c}": F.when(total > 0, F.col(f"mass_{c}") / total).otherwise(F.lit(0.0)) for c in components})
    return out


# ---- comparing workloads -----------------------------------------------------------------


def l1_distance(left: DataFrame, right: DataFrame) -> DataFrame:
    """L1 distance of two count tables (family, queries) after normalising each."""

    def share(df: DataFrame, out: str) -> DataFrame:
        total = df.select(F.sum("queries")).scalar()
        return df.select("family", F.when(total > 0, F.col("queries") / total).otherwise(F.lit(0.0)).alias(out))

    both = share(left, "_a").join(share(right, "_b"), "family", "full")
    gap = F.abs(F.coalesce("_a", F.lit(0.0)) - F.coalesce("_b", F.lit(0.0)))
    return both.agg(F.sum(gap).alias("l1"))


def quantile_linf(pairs: list[tuple[Column, Column]]) -> Column:
    """Worst relative difference of paired quantiles."""
    gaps = [F.abs(a - b) / F.greatest(F.abs(a), F.abs(b), F.lit(1.0)) for a, b in pairs]
    return F.greatest(*gaps) if len(gaps) > 1 else gaps[0]


def ks_distance(left: DataFrame, right: DataFrame, value: str) -> DataFrame:
    """Two-sample Kolmogorov-Smirnov distance; NULL if a side is empty."""
    a = left.filter(F.col(value).isNotNull()).select(value, F.lit(1).alias("_a"), F.lit(0).alias("_b"))
    b = right.filter(F.col(value).isNotNull()).select(value, F.lit(0).alias("_a"), F.lit(1).alias("_b"))
    per_value = a.unionByName(b).groupBy(value).agg(F.sum("_a").alias("_a"), F.sum("_b").alias("_b"))
    placed = order_index(per_value, [F.col(value)], out="_i").withColumn("_all", F.lit(0))
    placed = with_bound(placed, "_all")
    run = scan(placed, ["_all"], "_i", {"_ca": ("sum", "_a"), "_cb": ("sum", "_b")}, "_all")
    sizes = one_row(placed.agg(F.sum("_a").alias("na"), F.sum("_b").alias("nb")))
    run = run.withColumn("_n", sizes.select(F.struct("na", "nb")).scalar())
    gap = F.abs(F.col("_ca") / F.nullif(F.col("_n.na"), F.lit(0)) - F.col("_cb") / F.nullif(F.col("_n.nb"), F.lit(0)))
    return run.agg(F.max(gap).alias("ks"))


def failed_checks(checks: dict[str, Column]) -> Column:
    """Names of the checks whose condition is not true, as an array."""
    return F.array_compact(F.array(*[F.when(~F.coalesce(ok, F.lit(False)), F.lit(name)) for name, ok in checks.items()]))


def signature_gate(train: DataFrame, evaluation: DataFrame, train_diag: DataFrame, eval_diag: DataFrame, train_queries: DataFrame, eval_queries: DataFrame) -> DataFrame:
    """Do two workloads look alike?  Distances, rates, and the list of failed checks."""
    from .workload import family_counts

    parts = [
        l1_distance(family_counts(train_queries, k), family_counts(eval_queries, k)).withColumnRenamed("l1", f"{k}_l1_distance")
        for k in ("anchor_family", "footprint_family")
    ]
    for c, name in (("point_hits", "point_hit_distribution_ks"), ("track_hits", "ship_hit_distribution_ks")):
        parts.append(ks_distance(train_diag, eval_diag, c).withColumnRenamed("ks", name))
    sides = []
    for tag, s, q in (("train", train, train_queries), ("eval", evaluation, eval_queries)):
        profile = q.agg(F.first("profile_id") if "profile_id" in q.columns else F.lit("free")).toDF(f"{tag}_profile")
        sides.append(s.select(*[F.col(c).alias(f"{tag}_{c}") for c in ("query_count", "near_duplicate_query_rate", "too_broad_query_rate")]))
        sides.append(profile)
    row = one_row(*parts, *sides)
    row = row.withColumns(
        {
            "near_duplicate_rate": F.greatest("train_near_duplicate_query_rate", "eval_near_duplicate_query_rate"),
            "broad_query_rate": F.greatest("train_too_broad_query_rate", "eval_too_broad_query_rate"),
        }
    )
    checks = {name: F.col(name) <= limit for name, limit in SIGNATURE_LIMITS.items()}
    checks["train_query_count"] = F.col("train_query_count") >= MIN_SIGNATURE_QUERIES
    checks["eval_query_count"] = F.col("eval_query_count") >= MIN_SIGNATURE_QUERIES
    checks["profile_id"] = F.col("train_profile") == F.col("eval_profile")
    row = row.withColumn("failed_checks", failed_checks(checks))
    return row.withColumn("gate_pass", F.size("failed_checks") == 0)


def compare_distributions(signatures: DataFrame, fields: tuple[str, ...] = COMPARED_FIELDS) -> DataFrame:
    """Each workload (column ``label``) minus the ``eval`` workload, per field; NULL for a field that is not known.

    ``oracle_gap`` is how far the oracle is above the best baseline, where it was measured.
    """
    known = [F.col(f).cast("double") if f in signatures.columns else F.lit(None).cast("double") for f in fields]
    doubles = signatures.select("label", *[c.alias(f) for c, f in zip(known, fields)])
    long = doubles.unpivot("label", list(fields), "field", "value")
    base = long.filter("label = 'eval'").select("field", F.col("value").alias("eval_value"))
    both = long.filter("label <> 'eval'").join(base, "field")
    return both.withColumn("delta", F.col("value") - F.col("eval_value"))


def signature_gates(workloads: dict[str, tuple[DataFrame, DataFrame, DataFrame]], against: str = "eval") -> DataFrame:
    """The signature gate of each workload against one of them: a row per pair, and whether all pass.

    ``workloads`` has (summary, diagnostics, queries) per label.
    """
    other = workloads[against]
    rows = None
    for label, own in workloads.items():
        if label == against:
            continue
        gate = signature_gate(own[0], other[0], own[1], other[1], own[2], other[2]).withColumn("label", F.lit(label))
        rows = gate if rows is None else rows.unionByName(gate)
    if rows is None:
        raise ValueError("at least two workloads are needed")
    return rows.withColumn("all_pass", F.min("gate_pass").over(Window.partitionBy()))  # one row per pair


def overshoot_limit(target: Column) -> Column:
    choice = F.lit(OVERSHOOT_LIMIT_ABOVE)
    for top, limit in reversed(OVERSHOOT_LIMITS):
        choice = F.when(target <= top, limit).otherwise(choice)
    return choice


def stability_gate(stats: DataFrame, profile_id: str, target: float) -> DataFrame:
    """Per workload: right profile, coverage reached, no large overshoot, few rejections."""
    rejected = 1.0 - F.col("queries") / F.greatest("attempts", F.lit(1))
    over = F.col("coverage") - F.lit(target)
    checks = {
        "profile": F.col("profile_id") == profile_id,
        "coverage": F.col("coverage") >= target,
        "guard": F.col("guard").isNotNull(),
        "rejection_rate": rejected <= MAX_REJECTION_RATE,
        "overshoot": over <= overshoot_limit(F.lit(target)) + 1e-12,
    }
    out = stats.withColumns({"rejection_rate": rejected, "overshoot": over, "failed_checks": failed_checks(checks)})
    return out.withColumn("gate_pass", F.size("failed_checks") == 0)


def support_overlap_gate(train_points: DataFrame, eval_points: DataFrame, sampled: DataFrame, prior_extent: DataFrame) -> DataFrame:
    """Do the evaluation points lie where the training prior knows something?

    ``sampled`` holds the six prior values of the evaluation points.
    """
    e = prior_extent.select(F.struct(*prior_extent.columns)).scalar()
    inside = eval_points.withColumn("_e", e)
    outside = ~(F.col("lat").between(F.col("_e.lat_min"), F.col("_e.lat_max")) & F.col("lon").between(F.col("_e.lon_min"), F.col("_e.lon_max")))
    names = [c for c in sampled.columns if c not in ("traj_id", "pos")]

    def live(*cols: str) -> Column:
        flag = F.lit(False)
        for c in cols:
            flag = flag | (F.abs(F.col(c)) > 1e-12)
        return F.avg(flag.cast("double"))

    row = one_row(
        inside.agg(F.avg(outside.cast("double")).alias("outside_extent")),
        sampled.agg(
            live(*names).alias("any_prior_share"),
            live("query_hit").alias("primary_prior_share"),
            live("route_density").alias("route_density_share"),
            live("query_hit", "query_hit_clock").alias("query_prior_share"),
        ),
        extent(train_points).select(*[F.col(c).alias(f"tr_{c}") for c in ("lat_min", "lat_max", "lon_min", "lon_max")]),
        extent(eval_points).select(*[F.col(c).alias(f"ev_{c}") for c in ("lat_min", "lat_max", "lon_min", "lon_max")]),
    )
    shared, full = F.lit(1.0), F.lit(1.0)
    for axis in ("lat", "lon"):
        lo, hi = F.greatest(f"tr_{axis}_min", f"ev_{axis}_min"), F.least(f"tr_{axis}_max", f"ev_{axis}_max")
        shared = shared * F.greatest(hi - lo, F.lit(0.0))
        full = full * (F.col(f"ev_{axis}_max") - F.col(f"ev_{axis}_min"))
    row = row.withColumn("extent_intersection", F.least(shared / F.greatest(full, F.lit(1e-12)), F.lit(1.0)))
    checks = {
        name: (F.col(name) <= limit + 1e-12) if kind == "max" else (F.col(name) >= limit - 1e-12)
        for name, (kind, limit) in SUPPORT_LIMITS.items()
    }
    row = row.withColumn("failed_checks", failed_checks(checks)).withColumn("gate_pass", F.size("failed_checks") == 0)
    return row.drop(*[c for c in row.columns if c.startswith(("tr_", "ev_"))])


def signal_diagnostics(points: DataFrame, queries: DataFrame, labels: DataFrame, ratio: float) -> DataFrame:
    """Point F1 of uniform, line splitter and label oracle, and the oracle's gap over the best baseline."""
    from .metrics import SETS, support_f1
    from .simplify import Method, retain, simplify_douglas_peucker, simplify_oracle, simplify_uniform

    labelled = points.join(labels.select("traj_id", "pos", "label"), ["traj_id", "pos"], "left")
    methods = [
        Method("uniform", simplify_uniform),
        Method("douglas_peucker", simplify_douglas_peucker),
        Method("oracle", lambda p, r: simplify_oracle(labelled, r)),
    ]
    kept = retain(points, methods, [ratio])
    hits = query_hits(points.select("traj_id", "pos", "t", "lat", "lon"), queries).select("query_id", "traj_id", "pos")
    per_query = support_f1(hits, kept, SETS, "f1")
    n = queries.select(F.count(F.lit(1))).scalar()
    mean = per_query.groupBy("method").agg(F.sum("f1").alias("_s"), F.count(F.lit(1)).alias("_c"))
    mean = mean.select("method", ((F.col("_s") + (n - F.col("_c"))) / n).alias("f1"))  # empty boxes count as 1
    row = mean.groupBy().pivot("method", ["uniform", "douglas_peucker", "oracle"]).agg(F.first("f1"))
    best = F.greatest("uniform", "douglas_peucker")
    return row.withColumns({"best_baseline": best, "oracle_gap": F.col("oracle") - best})
