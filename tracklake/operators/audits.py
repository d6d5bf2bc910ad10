"""How well scores predict targets, and the gates and reports built on results."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.hashing import unit_hash
from ..plans.materialize import materialize
from ..plans.ordered import order_index
from .diagnostics import failed_checks
from .tracks import one_row

POINT = ["traj_id", "pos"]
RATIOS = (0.01, 0.02, 0.05, 0.10)
# Thresholds of the predictability and alignment gates.
PREDICTABILITY_LIMITS = {"lift_at_1": 1.10, "lift_at_2": 1.15, "lift_at_5": 1.20, "spearman": 0.15, "pr_auc_lift": 1.25}
ALIGNMENT_LIMITS = {"query_hit_spearman": 0.10, "query_hit_lift_at_5": 1.10, "block_budget_lift_at_5": 1.05}
MIN_POSITIVE_HEADS = 2
HEAD_SCORES = {
    "hit_probability": "query_mass",
    "behavior": "behavior",
    "boundary": "boundary_max",
    "replacement": "replacement_score",
    "block_budget": "block_score",
}
# Result gates and the acceptance grid.
LENGTH_RANGE = (0.80, 1.20)
SED_RATIO_LIMITS = {0.01: 2.0, 0.02: 1.75, 0.05: 1.5}
GRID_COVERAGES = (0.05, 0.10, 0.15, 0.30)
GRID_RATIOS = (0.01, 0.02, 0.05, 0.10, 0.15, 0.20, 0.30)
GRID_WINS = {"wins_uniform": 19, "wins_douglas_peucker": 24, "low_budget_wins": 7, "five_percent_wins": 3}
LOW_BUDGET = 0.05
MIN_ABLATION_DELTA, ABLATION_SHARE = 0.005, 0.6


def ordinal_rank(df: DataFrame, col: str, out: str = "rank", descending: bool = False) -> DataFrame:
    """0-based rank over the whole table; ties in (traj_id, pos) order."""
    first = F.col(col).desc() if descending else F.col(col).asc()
    return order_index(df, [first, *[F.col(p) for p in POINT]], out)


def pearson(df: DataFrame, a: str, b: str) -> DataFrame:
    """Correlation; 0 for flat or too few values."""
    r = F.corr(a, b)
    return df.agg(F.when(r.isNull() | F.isnan(r), 0.0).otherwise(r).alias("pearson"))


def spearman(df: DataFrame, a: str, b: str) -> DataFrame:
    ranked = ordinal_rank(ordinal_rank(df.select(*POINT, a, b), a, "_ra"), b, "_rb")
    return pearson(ranked, "_ra", "_rb").withColumnRenamed("pearson", "spearman")


def _tau(pairs: DataFrame) -> DataFrame:
    ds, dt = F.col("s1") - F.col("s2"), F.col("t1") - F.col("t2")
    valid = (F.abs(ds) > 1e-8) & (F.abs(dt) > 1e-8)
    same = F.avg(F.when(valid, (ds * dt > 0).cast("double")))
    return pairs.agg(F.coalesce(2.0 * same - 1.0, F.lit(0.0)).alias("kendall"))


TIE = 1e-8


def kendall(df: DataFrame, score: str, target: str, pairs: int | None = None, seed: int = 1706011) -> DataFrame:
    """Kendall tau: exact over all pairs, or over ``pairs`` seeded draws where the caller asks for a sample.

    Pairs whose scores or targets differ by at most ``TIE`` do not count.
    """
    data = df.select(*POINT, F.col(score).cast("double").alias("s"), F.col(target).cast("double").alias("t"))
    return _kendall_exact(data) if pairs is None else _kendall_drawn(data, pairs, seed)


def _kendall_drawn(data: DataFrame, pairs: int, seed: int) -> DataFrame:
    numbered = order_index(data, [F.col(p) for p in POINT], "_i")
    n = numbered.count()
    sides = [numbered.select(F.col("_i").alias(f"i{k}"), F.col("s").alias(f"s{k}"), F.col("t").alias(f"t{k}")) for k in (1, 2)]
    draws = data.sparkSession.range(pairs).select(*[F.floor(unit_hash("pair", k, seed, F.col("id")) * n).alias(f"i{k}") for k in (1, 2)])
    return _tau(draws.filter("i1 <> i2").join(sides[0], "i1").join(sides[1], "i2"))


#: The exact count cuts both orders into at most so many blocks of at least so many rows; its table of block pairs is bounded by the square.
PAIR_BLOCKS = 1024
PAIR_ROWS = 4096


def inversions(x: np.ndarray) -> int:
    """Pairs i < k with x[i] > x[k]."""
    if len(x) <= 256:
        return int(np.triu(x[:, None] > x[None, :]).sum())
    left, right = x[: len(x) // 2], x[len(x) // 2 :]
    across = len(left) * len(right) - int(np.searchsorted(np.sort(left), right, side="right").sum())
    return inversions(left) + inversions(right) + across


def _kendall_exact(data: DataFrame) -> DataFrame:
    """Discordant pairs are the inversions of the target's order in that of the score.

    Both orders are cut into blocks.  Pairs in different blocks of both follow from the
    table of block counts, pairs in one block of the score from that block, and the rest
    from the blocks of the target; a block is one group of about ``n / PAIR_BLOCKS`` rows.
    Values are compared in multiples of ``TIE``.
    """
    spark = data.sparkSession
    grid = data.select(*POINT, *[F.round(F.col(c) / TIE).cast("decimal(38,0)").alias(c) for c in ("s", "t")])
    by_s = order_index(grid, [F.col("s"), F.col("t"), *map(F.col, POINT)], "i")
    rows = order_index(by_s.select("s", "t", "i"), [F.col("t"), F.col("i")], "j")
    n = rows.count()
    size = max(PAIR_ROWS, -(-n // PAIR_BLOCKS))
    rows = rows.withColumns({"a": F.floor(F.col("i") / size), "b": F.floor(F.col("j") / size)})

    def inside(pdf: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"n": [inversions(pdf.sort_values("i")["j"].to_numpy())]})

    def across(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("i")
        own = sum(inversions(g["j"].to_numpy()) for _, g in pdf.groupby("a"))  # already counted in their block of the score
        return pd.DataFrame({"n": [inversions(pdf["j"].to_numpy()) - own]})

    counted = [rows.groupBy("a").applyInPandas(inside, "n bigint"), rows.groupBy("b").applyInPandas(across, "n bigint")]
    discordant = counted[0].union(counted[1]).agg(F.sum("n")).first()[0] or 0
    cells = rows.groupBy("a", "b").count().toArrow()  # at most PAIR_BLOCKS squared
    table = np.zeros((PAIR_BLOCKS, PAIR_BLOCKS), dtype=object)
    table[cells["a"].to_numpy(), cells["b"].to_numpy()] = cells["count"].to_pylist()
    earlier = np.cumsum(table, axis=0) - table  # of earlier blocks of the score, per block of the target
    later = np.cumsum(earlier[:, ::-1], axis=1)[:, ::-1] - earlier  # and of later blocks of the target
    discordant += int((table * later).sum())
    tied = 0
    for keys, sign in ((["s"], 1), (["t"], 1), (["s", "t"], -1)):
        per = grid.groupBy(*keys).count().select((F.col("count") * (F.col("count") - 1) / 2).cast("decimal(38,0)").alias("p"))
        tied += sign * int(per.agg(F.sum("p")).first()[0] or 0)
    valid = n * (n - 1) // 2 - tied
    return spark.createDataFrame([((valid - 2 * discordant) / valid if valid else 0.0,)], "kendall double")


def roc_auc(df: DataFrame, score: str, positive: str) -> DataFrame:
    """Rank-sum AUC; NULL if one class is missing."""
    ranked = ordinal_rank(df.select(*POINT, score, positive), score, "_r")
    p, q = F.count_if(positive), F.count_if(~F.col(positive))
    total = F.sum(F.when(F.col(positive), F.col("_r") + 1))
    value = (total - p * (p + 1) / 2.0) / F.nullif(p * q, F.lit(0))
    return ranked.agg(value.alias("auc"))


def average_precision(df: DataFrame, score: str, positive: str) -> DataFrame:
    """Mean precision at the positives, best scores first; NULL without positives."""
    ranked = ordinal_rank(df.select(*POINT, score, positive), score, "_r", True)
    # positives up to and including a positive: its own place among them, so no window runs over the whole table
    hits = order_index(ranked.filter(F.col(positive)).select("_r"), ["_r"], "_hits")
    return hits.agg(F.avg((F.col("_hits") + 1) / (F.col("_r") + 1)).alias("pr_auc"))


def _keep(n: int, ratio: float) -> int:
    return min(n, max(1, math.ceil(ratio * n)))


def ndcg_and_lift(df: DataFrame, score: str, target: str, ratios: tuple[float, ...] = RATIOS) -> DataFrame:
    """NDCG and lift of the best-scored share, one row with a column per share."""
    clean = df.select(*POINT, score, F.greatest(target, F.lit(0.0)).alias("_t"))
    by_score = ordinal_rank(clean, score, "_r", True)
    ideal = ordinal_rank(clean, "_t", "_r", True)
    n = by_score.count()
    gain = F.col("_t") / F.log2(F.col("_r") + 2.0)
    parts = []
    for table, tag in ((by_score, "dcg"), (ideal, "ideal")):
        aggs = [F.sum(F.when(F.col("_r") < _keep(n, x), gain)).alias(f"{tag}_{int(x * 100)}") for x in ratios]
        if tag == "dcg":
            aggs += [F.avg(F.when(F.col("_r") < _keep(n, x), F.col("_t"))).alias(f"top_{int(x * 100)}") for x in ratios]
            aggs.append(F.avg("_t").alias("base"))
        parts.append(table.agg(*aggs))
    row = one_row(*parts)
    out = []
    for x in ratios:
        p, zero = int(x * 100), F.lit(0.0)
        out.append(F.when(F.col(f"ideal_{p}") > 1e-12, F.col(f"dcg_{p}") / F.col(f"ideal_{p}")).otherwise(zero).alias(f"ndcg_at_{p}"))
        out.append(F.when(F.col("base") > 1e-12, F.col(f"top_{p}") / F.col("base")).otherwise(zero).alias(f"lift_at_{p}"))
    return row.select(*out)


def score_target_metrics(df: DataFrame, score: str, target: str) -> DataFrame:
    """All rank and top-share metrics of one score against one target."""
    data = materialize(
        df.select(*POINT, F.col(score).alias("_score"), F.greatest(target, F.lit(0.0)).alias("_target"))
        .filter(F.col("_score").isNotNull() & F.col("_target").isNotNull())
        .withColumn("_positive", F.col("_target") > 0)
    )
    base = data.agg(
        F.count(F.lit(1)).alias("valid"),
        F.count_if("_positive").alias("positive"),
        F.avg("_target").alias("target_mean"),
        F.avg("_score").alias("score_mean"),
    )
    row = one_row(
        base,
        spearman(data, "_score", "_target"),
        kendall(data, "_score", "_target"),
        roc_auc(data, "_score", "_positive"),
        average_precision(data, "_score", "_positive"),
        ndcg_and_lift(data, "_score", "_target"),
    )
    rate = F.greatest(F.col("positive") / F.greatest("valid", F.lit(1)), F.lit(1e-12))
    return row.withColumn("pr_auc_lift", F.col("pr_auc") / rate)


def predictability_audit(scores: DataFrame, targets: DataFrame) -> DataFrame:
    """Does the combined prior score predict the final score?  Metrics and gate."""
    both = scores.join(targets.select(*POINT, "label"), POINT)
    row = score_target_metrics(both, "combined", "label")
    checks = {name: F.col(name) >= limit for name, limit in PREDICTABILITY_LIMITS.items()}
    return row.withColumn("failed_checks", failed_checks(checks)).withColumn("gate_pass", F.size("failed_checks") == 0)


def per_head_audit(scores: DataFrame, targets: DataFrame) -> DataFrame:
    """The same metrics for every target and the prior score that stands for it."""
    goal = targets.select(*POINT, *[F.col(h).alias(f"_t_{h}") for h in HEAD_SCORES])
    both = materialize(scores.join(goal, POINT))
    out = None
    for head, score in HEAD_SCORES.items():
        row = score_target_metrics(both, score, f"_t_{head}").select(F.lit(head).alias("head"), F.lit(score).alias("source"), "*")
        out = row if out is None else out.unionByName(row)
    return out


def alignment_gate(heads: DataFrame) -> DataFrame:
    """Do the prior's hit and block scores point the right way?"""
    def of(head: str, col: str) -> Column:
        return F.max(F.when(F.col("head") == head, F.col(col)))

    row = heads.agg(
        of("hit_probability", "spearman").alias("query_hit_spearman"),
        of("hit_probability", "lift_at_5").alias("query_hit_lift_at_5"),
        of("block_budget", "lift_at_5").alias("block_budget_lift_at_5"),
        F.count_if(F.col("spearman") > 0).alias("positive_heads"),
    )
    checks = {name: F.col(name) >= limit for name, limit in ALIGNMENT_LIMITS.items()}
    checks["positive_heads"] = F.col("positive_heads") >= MIN_POSITIVE_HEADS
    return row.withColumn("failed_checks", failed_checks(checks)).withColumn("gate_pass", F.size("failed_checks") == 0)


# ---- sensitivity --------------------------------------------------------------------------


def score_sensitivity(a: DataFrame, b: DataFrame, kept_a: DataFrame, kept_b: DataFrame, ratio: float = 0.05) -> DataFrame:
    """How much two scores and their kept sets differ."""
    both = materialize(a.select(*POINT, F.col("score").alias("a")).join(b.select(*POINT, F.col("score").alias("b")), POINT))
    d = F.abs(F.col("a") - F.col("b"))
    n = both.count()
    deltas = both.agg(F.avg(d).alias("mean_abs_delta"), F.max(d).alias("max_abs_delta"), F.count_if(d > 1e-9).alias("changed"))
    flags = kept_a.select(*POINT).distinct().withColumn("_a", F.lit(1)).join(kept_b.select(*POINT).distinct().withColumn("_b", F.lit(1)), POINT, "full")
    sets = flags.agg(F.count_if(F.col("_a").isNotNull() & F.col("_b").isNotNull()).alias("_and"), F.count(F.lit(1)).alias("_or"))
    ranked = ordinal_rank(ordinal_rank(both, "a", "_ra", True), "b", "_rb", True)
    keep = _keep(n, ratio)
    top = ranked.agg(
        F.count_if((F.col("_ra") < keep) & (F.col("_rb") < keep)).alias("_tand"),
        F.count_if((F.col("_ra") < keep) | (F.col("_rb") < keep)).alias("_tor"),
    )
    row = one_row(deltas, sets, top)
    one = F.lit(1.0)
    return row.select(
        "mean_abs_delta",
        "max_abs_delta",
        "changed",
        F.when(F.col("_or") > 0, F.col("_and") / F.col("_or")).otherwise(one).alias("kept_jaccard"),
        ((F.col("_or") - F.col("_and")) / F.lit(float(max(1, n)))).alias("kept_hamming"),
        F.when(F.col("_tor") > 0, F.col("_tand") / F.col("_tor")).otherwise(one).alias("top_jaccard"),
    )


def prior_sensitivity(a: DataFrame, b: DataFrame, fields: tuple[str, ...]) -> DataFrame:
    """How much sampled values differ between two priors: one row per field, and one over all (field NULL).

    Values that are not finite on either side are left out of both.
    """
    long = [d.select(*POINT, *fields).unpivot(POINT, list(fields), "field", v) for d, v in ((a, "a"), (b, "b"))]
    both = long[0].join(long[1], [*POINT, "field"])
    finite = [~F.isnan(v) & (F.abs(v) < float("inf")) for v in ("a", "b")]
    both = both.filter(finite[0] & finite[1])
    d = F.col("a") - F.col("b")
    sides = {}
    for v in ("a", "b"):
        sides |= {f"mean_{v}": F.avg(v), f"std_{v}": F.stddev_pop(v), f"nonzero_{v}": F.avg((F.abs(v) > 1e-12).cast("double"))}
    out = both.groupingSets([["field"], []], "field").agg(
        F.count(F.lit(1)).alias("values"),
        F.avg(F.abs(d)).alias("mean_abs_delta"),
        F.max(F.abs(d)).alias("max_abs_delta"),
        F.avg(d).alias("mean_delta"),
        F.avg((F.abs(d) > 1e-9).cast("double")).alias("changed_share"),
        *[x.alias(n) for n, x in sides.items()],
    )
    return out.withColumn("is_flat", F.col("max_abs_delta") <= 1e-9)


def outside_share(points: DataFrame, extent: dict[str, float]) -> DataFrame:
    """Share of points outside the extent of a prior."""
    inside = F.col("lat").between(extent["lat_min"], extent["lat_max"]) & F.col("lon").between(extent["lon_min"], extent["lon_max"])
    return points.agg(F.avg((~inside).cast("double")).alias("outside_share"))


def prior_sample_gate(sensitivity: DataFrame, outside: DataFrame) -> DataFrame:
    """Was the prior used at all?  ``sensitivity`` compares it (a) with a shuffled one (b); one row with the failures."""
    row = one_row(sensitivity.filter(F.col("field").isNull()), outside)
    # fixed values: limits of the gate
    checks = {
        "prior_not_zero": F.col("nonzero_a") > 1e-6,
        "shuffle_changes_values": ~F.col("is_flat"),
        "points_inside_extent": F.coalesce(F.col("outside_share") <= 0.50, F.lit(True)),
    }
    return row.select(failed_checks(checks).alias("failed_checks")).withColumn("gate_pass", F.size("failed_checks") == 0)


# ---- gates on results ------------------------------------------------------------------------


def causality_gate(results: DataFrame, method: str, baseline: str, ablations: list[str], score: str = "score") -> DataFrame:
    """Each ablation must cost at least max(0.005, 0.6 * gain over the baseline)."""
    base = results.filter(F.col("method").isin(method, baseline)).agg(
        F.max(F.when(F.col("method") == method, F.col(score))).alias("_m"),
        F.max(F.when(F.col("method") == baseline, F.col(score))).alias("_u"),
    ).first()
    gap = max(0.0, base["_m"] - base["_u"])
    needed = max(MIN_ABLATION_DELTA, ABLATION_SHARE * gap)
    rows = results.filter(F.col("method").isin(ablations)).withColumn("delta", F.lit(base["_m"]) - F.col(score))
    return rows.select("method", "delta", F.lit(needed).alias("needed"), (F.col("delta") >= needed).alias("passed"))


def sed_ratio_limit(ratio: Column) -> Column:
    choice = F.lit(SED_RATIO_LIMITS[0.05])
    for top in (0.02, 0.01):
        choice = F.when(ratio <= top, SED_RATIO_LIMITS[top]).otherwise(choice)
    return choice


def sanity_gate(results: DataFrame, baseline: str = "uniform") -> DataFrame:
    """Length preserved, ends kept, and SED not far above the baseline's."""
    base = results.filter(F.col("method") == baseline).select("ratio", F.col("avg_sed_km").alias("_base"))
    rows = results.filter(F.col("method") != baseline).join(base, "ratio", "left")
    rows = rows.withColumn("sed_ratio", F.col("avg_sed_km") / F.greatest("_base", F.lit(1e-9))).drop("_base")
    checks = {
        "length": F.col("length_preservation").between(*LENGTH_RANGE),
        "endpoints": F.col("endpoint_sanity") >= 1.0,
        "sed": F.col("sed_ratio") <= sed_ratio_limit(F.col("ratio")),
    }
    return rows.withColumn("failed_checks", failed_checks(checks)).withColumn("gate_pass", F.size("failed_checks") == 0)


# Fixed values of the diffusion gate: value above which a target counts as supported, and the heads that block.
SUPPORT_ABOVE = {"boundary": 0.05, "replacement": 0.05}
SUPPORT_ABOVE_DEFAULT = 0.01
BLOCKING_HEADS = ("boundary", "behavior", "replacement")
MAX_SUPPORT, MIN_TOP5_MASS = 0.50, 0.10


def diffusion_rows(targets: DataFrame, final: str, heads: list[str]) -> DataFrame:
    """How widely the final target and each head are spread: support and mass of the top 5 %, with failed checks.

    ``blocking`` marks the rows whose failures count in the gate; the final target is judged by support alone.
    """
    from .labels import topk_mass

    above = {h: SUPPORT_ABOVE.get(h, SUPPORT_ABOVE_DEFAULT) for h in (final, *heads)}
    wide = targets.agg(*[F.avg((F.col(h) > t).cast("double")).alias(h) for h, t in above.items()])
    support = wide.unpivot([], list(above), "head", "support")
    mass = None
    for h in heads:
        part = topk_mass(targets, h, (0.05,)).select(F.lit(h).alias("head"), F.col("share").alias("top5_mass"))
        mass = part if mass is None else mass.unionByName(part)
    rows = support if mass is None else support.join(mass, "head", "left")
    if mass is None:
        rows = rows.withColumn("top5_mass", F.lit(None).cast("double"))
    is_final = F.col("head") == final
    checks = {
        "support": F.coalesce(F.col("support") <= MAX_SUPPORT + 1e-12, F.lit(False)),
        "top5_mass": is_final | F.coalesce(F.col("top5_mass") >= MIN_TOP5_MASS - 1e-12, F.lit(False)),
    }
    return rows.withColumns({"blocking": is_final | F.col("head").isin(*BLOCKING_HEADS), "failed_checks": failed_checks(checks)})


def diffusion_gate(rows: DataFrame) -> DataFrame:
    """One row over ``diffusion_rows``: failures of the blocking targets as ``target:check``; no head at all is a failure too."""
    named = F.explode(F.transform("failed_checks", lambda c: F.concat(F.col("head"), F.lit(":"), c))).alias("f")
    failed = rows.filter("blocking").select(named).agg(F.array_sort(F.collect_list("f")).alias("failed_checks"))  # two per target
    heads = rows.agg((F.count(F.lit(1)) > 1).alias("has_heads"))
    out = one_row(failed, heads)
    out = out.withColumn("failed_checks", F.when(F.col("has_heads"), F.col("failed_checks")).otherwise(F.array_append("failed_checks", F.lit("heads_missing"))))
    return out.select("failed_checks", (F.size("failed_checks") == 0).alias("gate_pass"))


def collapse_penalty(spread: Column) -> Column:
    """1 where predictions have (almost) no spread, else 0."""
    return F.when(spread < 1e-3, 1.0).otherwise(0.0)


def selection_score(quality: Column, spread: Column, loss: Column | None = None) -> Column:
    """Rank of a checkpoint: by loss with ``quality`` as a tie-break, or by ``quality`` where no loss is given; never a collapsed one."""
    by_quality = quality if loss is None else F.coalesce(1e-3 * quality - loss, quality)
    return by_quality - collapse_penalty(spread)


def uniform_gap_score(
    score: Column, uniform: Column, spread: Column, kinds: dict[str, tuple[Column, Column]], weights: dict[str, float], gap_weight: float = 0.5, deficit_weight: float = 1.0
) -> Column:
    """Score plus its lead over even spacing, minus what each query kind loses to it; ``kinds`` has (own, uniform) per kind."""
    total = sum(weights.values())
    lost = [F.lit(weights[k] / total) * F.greatest(F.lit(0.0), F.coalesce(u, F.lit(0.0)) - F.coalesce(own, F.lit(0.0))) for k, (own, u) in kinds.items() if weights.get(k)]
    deficit = sum(lost, F.lit(0.0))
    return score + gap_weight * (score - uniform) - deficit_weight * deficit - collapse_penalty(spread)


def grid_cells(results: DataFrame) -> DataFrame:
    """The 28 cells with their result counts; missing cells have none."""
    spark = results.sparkSession
    axes = spark.createDataFrame([(float(c), float(x)) for c in GRID_COVERAGES for x in GRID_RATIOS], "coverage double, ratio double")
    per_cell = results.groupBy("coverage", "ratio").agg(
        F.count(F.lit(1)).alias("runs"),
        F.max("score").alias("score"),
        F.max("uniform").alias("uniform"),
        F.max("douglas_peucker").alias("douglas_peucker"),
        F.max("gate_failures").alias("gate_failures"),
    )
    return axes.join(per_cell, ["coverage", "ratio"], "left").na.fill(0, ["runs", "gate_failures"])


def grid_acceptance(results: DataFrame) -> DataFrame:
    """Wins against both baselines over the coverage x ratio grid, against fixed minima."""
    cells = grid_cells(results)
    win_u, win_d = F.col("score") > F.col("uniform"), F.col("score") > F.col("douglas_peucker")
    low, five = F.col("ratio") <= LOW_BUDGET + 1e-9, F.abs(F.col("ratio") - LOW_BUDGET) < 1e-9
    row = cells.agg(
        F.count_if(F.col("runs") == 0).alias("missing_cells"),
        F.count_if(F.col("runs") > 1).alias("duplicate_cells"),
        F.count_if(win_u).alias("wins_uniform"),
        F.count_if(win_d).alias("wins_douglas_peucker"),
        F.count_if(win_u & low).alias("low_budget_wins"),
        F.count_if(win_u & five).alias("five_percent_wins"),
        F.count_if(F.col("gate_failures") > 0).alias("cells_with_failed_gates"),
    )
    checks = {name: F.col(name) >= need for name, need in GRID_WINS.items()}
    checks.update({c: F.col(c) == 0 for c in ("missing_cells", "duplicate_cells", "cells_with_failed_gates")})
    return row.withColumn("failed_checks", failed_checks(checks)).withColumn("accepted", F.size("failed_checks") == 0)


def audit_summary(results: DataFrame, method: str, baselines: list[str], score: str = "score") -> DataFrame:
    """Wins and mean differences of a method over all budgets and over the low ones."""
    own = results.filter(F.col("method") == method).select("ratio", F.col(score).alias("_own"))
    other = results.filter(F.col("method").isin(baselines)).select("ratio", F.col("method").alias("baseline"), F.col(score).alias("_base"))
    delta = F.col("_own") - F.col("_base")
    low = F.col("ratio") <= LOW_BUDGET + 1e-9
    return own.join(other, "ratio").groupBy("baseline").agg(
        F.count(F.lit(1)).alias("budgets"),
        F.count_if(delta > 0).alias("wins"),
        F.avg(delta).alias("mean_delta"),
        F.count_if(low).alias("low_budgets"),
        F.count_if(low & (delta > 0)).alias("low_wins"),
        F.avg(F.when(low, delta)).alias("low_mean_delta"),
    )


def best_run(results: DataFrame, scores: list[str]) -> DataFrame:
    """The run with the best first available score; of equal ones the smallest run_id."""
    value = F.coalesce(*[F.col(s) for s in scores])
    best = results.agg(F.max(value).alias("score"))
    first = results.select("run_id", value.alias("_v")).join(F.broadcast(best), F.col("_v") == F.col("score"), "right")
    return first.groupBy("score").agg(F.min("run_id").alias("run_id")).select("run_id", "score")


# Names of the claim states, least share of free slots for a claim, and names of the run classes.
MIN_FREE_SHARE = 0.25
NO_EVIDENCE, DOMINATED, MATERIAL, NOT_BLIND = "missing_selector_evidence", "selector_scaffold_dominated", "model_has_material_budget", "not_workload_blind"
RUN_CLASSES = {(True, True): "beats_uniform_and_douglas_peucker", (False, True): "fails_uniform", (True, False): "fails_douglas_peucker", (False, False): "fails_uniform_and_douglas_peucker"}


def claim_evidence(budgets: DataFrame, min_share: float = MIN_FREE_SHARE) -> DataFrame:
    """Can scores decide enough slots for a claim about them?  Adds ``claim`` and ``enough_evidence`` (NULL if unknown).

    Reads ``free_share`` and, where there, ``blind`` (whether the method saw no query).
    """
    blind = F.coalesce(F.col("blind"), F.lit(False)) if "blind" in budgets.columns else F.lit(True)
    enough = F.col("free_share") >= min_share
    claim = F.when(~blind, NOT_BLIND).when(enough, MATERIAL).when(~enough, DOMINATED).otherwise(NO_EVIDENCE)
    return budgets.withColumns({"claim": claim, "enough_evidence": F.when(blind, enough)})


def run_status(results: DataFrame) -> DataFrame:
    """Adds ``status``, the class of a run, from exit_code, score, uniform, douglas_peucker, upper_bound, blind, frozen and claim.

    Each obstacle stands for the first class that explains why the run proves nothing;
    only runs without one are classed by their wins.
    """
    obstacles = {
        "child_failed": F.coalesce(F.col("exit_code"), F.lit(1)) != 0,
        "missing_range_usefulness": F.col("score").isNull() | F.col("uniform").isNull() | F.col("douglas_peucker").isNull(),
        "diagnostic_upper_bound": F.coalesce("upper_bound", F.lit(False)),
        "non_blind_model": ~F.coalesce("blind", F.lit(False)),
        "protocol_fail": ~F.coalesce("frozen", F.lit(False)),
    }
    wins = [F.col("score") > F.col("uniform"), F.col("score") > F.col("douglas_peucker")]
    obstacles |= {name: wins[0] & wins[1] & (F.col("claim") == name) for name in (NO_EVIDENCE, DOMINATED)}
    first = F.coalesce(*[F.when(rule, F.lit(name)) for name, rule in obstacles.items()])
    classes = F.create_map(*[x for (u, d), name in RUN_CLASSES.items() for x in (F.lit(f"{u} {d}".lower()), F.lit(name))])
    return results.withColumn("status", F.coalesce(first, classes[F.concat_ws(" ", wins[0].cast("string"), wins[1].cast("string"))]))


def worst_component(results: DataFrame, method: str, baseline: str, components: list[str]) -> DataFrame:
    """Per ratio the component in which a method lags most behind a baseline; ``none`` and 0 where it lags in none."""
    long = results.select("method", "ratio", *components).unpivot(["method", "ratio"], components, "component", "value")
    own = long.filter(F.col("method") == method).select("ratio", "component", "value")
    base = long.filter(F.col("method") == baseline).select("ratio", "component", F.col("value").alias("_base"))
    both = own.join(base, ["ratio", "component"]).withColumn("delta", F.col("value") - F.col("_base")).filter(F.col("delta").isNotNull())
    place = F.create_map(*[x for i, c in enumerate(components) for x in (F.lit(c), F.lit(i))])[F.col("component")]
    worst = both.groupBy("ratio").agg(F.min(F.struct("delta", place.alias("place"), "component")).alias("w"))
    lags = F.col("w.delta") < 0
    return worst.select("ratio", F.when(lags, F.col("w.component")).otherwise("none").alias("component"), F.when(lags, F.col("w.delta")).otherwise(0.0).alias("delta"))


def target_fit(points: DataFrame, scores: DataFrame, labels: DataFrame, ratios: list[float]) -> DataFrame:
    """Target mass a score's kept set holds, against even spacing and the ideal top scores."""
    from .simplify import Method, retain, simplify_by_score, simplify_uniform

    both = points.join(scores.select(*POINT, "score"), POINT, "left").join(labels.select(*POINT, "label"), POINT, "left")
    both = materialize(both.na.fill(0.0, ["score", "label"]))
    ideal = both.drop("score").withColumn("score", F.col("label"))
    methods = [Method("score", simplify_by_score), Method("uniform", simplify_uniform), Method("ideal", lambda p, r: simplify_by_score(ideal, r))]
    kept = materialize(retain(both, methods, ratios))
    total = both.agg(F.sum("label")).first()[0] or 0.0
    mass = kept.join(both.select(*POINT, "label"), POINT).groupBy("ratio").pivot("method", ["score", "uniform", "ideal"]).agg(F.sum("label"))
    wide = {f"{m}_mass_share": F.coalesce(F.col(m), F.lit(0.0)) / F.lit(max(total, 1e-12)) for m in ("score", "uniform", "ideal")}
    pairs = kept.filter("method = 'score'").join(kept.filter("method = 'ideal'").select("ratio", *POINT), ["ratio", *POINT], "left_semi")
    overlap = pairs.groupBy("ratio").agg(F.count(F.lit(1)).alias("overlap"))
    tau = kendall(both, "score", "label").first()[0]
    out = mass.withColumns(wide).drop("score", "uniform", "ideal").join(overlap, "ratio", "left").na.fill(0, ["overlap"])
    return out.withColumn("kendall", F.lit(tau))
