"""What a single change of a kept set is worth to the box queries it meets.

A change adds a point to an evenly spaced base, drops one, or swaps two neighbours of
one track.  Its worth is the exact difference of the usefulness score of one query, in
closed form: the base is audited once into a state per visit (counts, first and last kept
point, largest gaps, turn weights, errors) and per query (counts behind the F1 scores).  A
change touches one visit, and in it only the stretch between the kept points around it,
so only the errors of the points on that stretch are computed anew.  No kept set is
written out and nothing is audited again per candidate.

Ties go to the earlier point; gains are compared after rounding to 12 digits.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.geo import clamp
from ..functions.spacing import base_size, budget, is_evenly_spaced, lattice
from ..plans.materialize import materialize
from ..plans.ordered import rank_within, scan
from .labels import POINT, VISIT, budget_weights
from .metrics import USEFULNESS_WEIGHTS, _sed_ped, audit_support, coverage_scores, subset_f1
from .ranges import crossing_brackets

QUERY = ["ratio", "query_id"]
SCOPE = ["ratio", *VISIT]
CHANGE = [*SCOPE, "add", "drop"]
#: Stands for "no point" in ``add`` and ``drop``.
NO_POINT = -1
#: A change touches at most two gaps between kept points, so the largest of the others is among so many.
LARGEST_GAPS = 3
MASS_MODES = ("gain", "point", "query")


@dataclass(slots=True)
class Audit:
    """The base at every ratio, audited once."""

    rows: DataFrame  # in-box points with the two kept points on each side
    visits: DataFrame
    queries: DataFrame
    crossings: DataFrame  # end points of crossing segments, with ``kept``


def _spread(df: DataFrame, ratios: list[float], base) -> DataFrame:
    """Every row once per ratio, and whether the base keeps it."""
    each = df.withColumn("ratio", F.explode(F.array(*[F.lit(float(r)) for r in ratios])))
    return each.withColumn("kept", is_evenly_spaced(k=base(F.col("ratio"))))


def audit(points: DataFrame, queries: DataFrame, ratios: list[float], base) -> Audit:
    """Audit the base that keeps ``base(ratio)`` evenly spaced points of every track."""
    c = F.col
    rows = _spread(audit_support(points, queries), ratios, base)
    here = F.when(c("kept"), F.struct("i", "t", "lat", "lon"))
    rows = scan(rows, SCOPE, "pos", {"l": ("last_before", here), "r": ("next_after", here)}, "traj_id")
    rows = scan(rows, SCOPE, "pos", {"ll": ("last_before", F.when(c("kept"), c("l"))), "rr": ("next_after", F.when(c("kept"), c("r")))}, "traj_id")
    error = F.when(~c("kept") & c("l").isNotNull() & c("r").isNotNull(), sum(_sed_ped("l", "r")))
    rows = materialize(rows.withColumn("err", error))

    def kept(f, name: str) -> Column:
        return f(F.when(c("kept"), c(name)))

    state = rows.groupBy(*SCOPE).agg(
        F.count(F.lit(1)).alias("n"),
        F.count_if("kept").alias("kept_n"),
        (F.max("t") - F.min("t")).alias("span"),
        F.max("cum_km").alias("km"),
        *[kept(f, name).alias(f"{side}_{name}") for side, f in (("first", F.min), ("last", F.max)) for name in ("t", "i")],
        F.sum("turn_w").alias("w"),
        F.coalesce(kept(F.sum, "turn_w"), F.lit(0.0)).alias("kept_w"),
        F.coalesce(F.sum("err"), F.lit(0.0)).alias("err"),
        F.count("err").alias("err_n"),
    )
    gaps = rows.filter(c("kept") & (c("i") - c("l.i") > 1)).select(*SCOPE, (c("i") - c("l.i") - 1).alias("missing"), c("l.i").alias("left"))
    largest = rank_within(gaps, SCOPE, [c("missing").desc(), c("left")], "_rank", "traj_id").filter(c("_rank") <= LARGEST_GAPS)
    largest = largest.groupBy(*SCOPE).agg(F.collect_list(F.struct("missing", "left")).alias("gaps"))
    state = state.join(largest, SCOPE, "left")
    worst = F.greatest(c("first_i"), c("n") - 1 - c("last_i"), F.array_max(c("gaps.missing")))
    scores = coverage_scores(c("n"), c("kept_n"), c("span"), c("last_t") - c("first_t"), worst, c("km"), c("w"), c("kept_w"), c("err"), c("err_n"))
    visits = materialize(state.withColumn("value", _weighted(scores)))

    sizes = points.select(*POINT, "n_points")
    crossings = materialize(_spread(crossing_brackets(points, queries).join(sizes, POINT), ratios, base).select(*SCOPE, "pos", "kept"))
    crossed = crossings.groupBy(*QUERY).agg(F.count(F.lit(1)).alias("cross_n"), F.count_if("kept").alias("cross_kept"))
    edges = rows.groupBy(*QUERY).agg(F.count_if("is_boundary").alias("edge_n"), F.count_if(c("is_boundary") & c("kept")).alias("edge_kept"))
    totals = visits.groupBy(*QUERY).agg(
        F.sum("n").alias("hits"), F.sum("kept_n").alias("hits_kept"), F.count(F.lit(1)).alias("ships"), F.count_if(c("kept_n") > 0).alias("ships_kept")
    )
    per_query = totals.join(edges, QUERY).join(crossed, QUERY, "left").na.fill(0, ["cross_n", "cross_kept"])
    return Audit(rows, visits, materialize(per_query), crossings)


def _weighted(scores: dict[str, Column]) -> Column:
    total = F.lit(0.0)
    for name, score in scores.items():
        total = total + F.lit(USEFULNESS_WEIGHTS[name]) * score
    return total


def score_changes(state: Audit, changes: DataFrame) -> DataFrame:
    """``changes`` (ratio, query_id, traj_id, add, drop; each once) with ``delta``, the change of the query's score.

    ``add`` is no point of the base; ``drop`` is one, and no other stands between the two.
    """
    c, visits = F.col, state.visits
    known = F.struct("i", "t", "lat", "lon", "turn_w", "is_boundary", "l", "ll", "r", "rr")
    rows = changes.select(*CHANGE)
    for name in ("add", "drop"):
        point = F.col("pos").alias(name)
        rows = rows.join(state.rows.select(*SCOPE, point, known.alias(f"{name}_row")), [*SCOPE, name], "left")
        rows = rows.join(state.crossings.select(*SCOPE, point, F.lit(1).alias(f"{name}_cross")), [*SCOPE, name], "left")
    has_new, has_old = c("add_row").isNotNull(), c("drop_row").isNotNull()

    def outer(near: str, far: str) -> Column:
        """The kept point that bounds the stretch on one side."""
        beside = has_old & c(f"add_row.{near}.i").eqNullSafe(c("drop_row.i"))
        return F.when(beside, c(f"add_row.{far}")).when(has_new, c(f"add_row.{near}")).otherwise(c(f"drop_row.{near}"))

    place = F.struct(*[c(f"add_row.{f}").alias(f) for f in ("i", "t", "lat", "lon")])
    rows = rows.withColumns({"x": outer("l", "ll"), "y": outer("r", "rr"), "new": F.when(has_new, place)})
    rows = materialize(rows)

    # errors on the stretch, before and after
    gaps = F.array_compact(F.array(F.coalesce(c("x.i"), F.lit(-1)), c("drop_row.i")))
    stretch = rows.filter(has_new | has_old).select(*CHANGE, "x", "y", "new", F.explode(F.array_distinct(gaps)).alias("gap"))
    members = state.rows.select(*SCOPE, F.coalesce(c("l.i"), F.lit(-1)).alias("gap"), "i", "t", "lat", "lon", "err")
    on = stretch.join(members, [*SCOPE, "gap"]).filter(c("y").isNull() | (c("i") < c("y.i")))
    before = c("new").isNotNull() & (c("i") < c("new.i"))
    after = c("new").isNotNull() & (c("i") > c("new.i"))
    on = on.withColumns({"_l": F.when(after, c("new")).otherwise(c("x")), "_r": F.when(before, c("new")).otherwise(c("y"))})
    dropped = c("_l").isNotNull() & c("_r").isNotNull() & ~c("i").eqNullSafe(c("new.i"))
    on = on.withColumn("_err", F.when(dropped, sum(_sed_ped("_l", "_r"))))
    zero = F.lit(0.0)
    errors = on.groupBy(*CHANGE).agg(
        (F.coalesce(F.sum("_err"), zero) - F.coalesce(F.sum("err"), zero)).alias("more_err"), (F.count("_err") - F.count("err")).alias("more_n")
    )

    rows = rows.join(visits, SCOPE, "left").join(errors, CHANGE, "left").join(state.queries, QUERY)
    plus, minus = has_new.cast("bigint"), has_old.cast("bigint")
    kept_n = c("kept_n") + plus - minus
    first = F.coalesce(c("new"), c("y"))
    last = F.coalesce(c("new"), c("x"))
    first_t, first_i = (F.when(c("x").isNull(), first[f]).otherwise(c(f"first_{f}")) for f in ("t", "i"))
    last_t, last_i = (F.when(c("y").isNull(), last[f]).otherwise(c(f"last_{f}")) for f in ("t", "i"))
    others = F.filter("gaps", lambda g: ~g["left"].eqNullSafe(c("x.i")) & ~g["left"].eqNullSafe(c("drop_row.i")))
    inner = [F.array_max(F.transform(others, lambda g: g["missing"]))]
    inner += [F.when(has_new, b - a - 1) for a, b in ((c("x.i"), c("new.i")), (c("new.i"), c("y.i")))]
    inner += [F.when(~has_new, c("y.i") - c("x.i") - 1)]
    worst = F.greatest(first_i, c("n") - 1 - last_i, *inner)
    turned = c("kept_w") + F.coalesce(c("add_row.turn_w"), zero) - F.coalesce(c("drop_row.turn_w"), zero)
    # what is left after taking the only error away is rounding
    err_n = c("err_n") + F.coalesce("more_n", F.lit(0))
    err = F.greatest(c("err") + F.coalesce("more_err", zero), zero)
    scores = coverage_scores(c("n"), kept_n, c("span"), last_t - first_t, worst, c("km"), c("w"), turned, err, err_n)
    visit = F.when(has_new | has_old, (_weighted(scores) - c("value")) / c("ships")).otherwise(zero)

    def f1_change(name: str, full: str, kept: str, more: Column) -> Column:
        return F.lit(USEFULNESS_WEIGHTS[name]) * (subset_f1(c(kept) + more, c(full)) - subset_f1(c(kept), c(full)))

    def one(flag: Column) -> Column:
        return F.coalesce(flag, F.lit(False)).cast("bigint")

    delta = (
        visit
        + f1_change("point_f1", "hits", "hits_kept", plus - minus)
        + f1_change("ship_f1", "ships", "ships_kept", one(kept_n > 0) - one(c("kept_n") > 0))
        + f1_change("entry_exit_f1", "edge_n", "edge_kept", one(c("add_row.is_boundary")) - one(c("drop_row.is_boundary")))
        + f1_change("crossing_f1", "cross_n", "cross_kept", one(c("add_cross") == 1) - one(c("drop_cross") == 1))
    )
    return rows.select(*CHANGE, "hits", "hits_kept", delta.alias("delta"))


def candidates(state: Audit, sparse: DataFrame | None = None, limit: int = 128) -> DataFrame:
    """Points of each query (in the box or at its crossings) that the base lacks.

    Above ``limit`` (0: none) a query keeps half of that number by label and fills up with
    evenly spaced ones, in the order of tracks and positions.
    """
    c = F.col
    inside = state.rows.filter(~c("kept")).select(*SCOPE, "pos")
    crossing = state.crossings.filter(~c("kept")).select(*SCOPE, "pos").join(state.queries.select(*QUERY), QUERY, "left_semi")
    found = inside.union(crossing).distinct()
    if limit <= 0:
        return found
    found = materialize(found)
    sizes = materialize(found.groupBy(*QUERY).agg(F.count(F.lit(1)).alias("_n")))
    many = found.join(sizes.filter(c("_n") > limit), QUERY)
    labels = sparse.select(*POINT, "label") if sparse is not None else found.select(*POINT, F.lit(0.0).alias("label")).limit(0)
    many = many.join(labels, POINT, "left").withColumn("label", F.greatest(F.coalesce("label", F.lit(0.0)), F.lit(0.0)))
    top = max(1, limit // 2)
    many = rank_within(many, QUERY, [c("traj_id"), c("pos")], "_at", None)
    many = rank_within(many, QUERY, [c("label").desc(), c("traj_id"), c("pos")], "_top", None)
    spaced = is_evenly_spaced(c("_at") - 1, c("_n"), F.lit(limit - top))
    chosen = many.filter((c("_top") <= top) | spaced).select(*SCOPE, "pos")
    few = found.join(sizes.filter(c("_n") <= limit), QUERY, "left_semi").select(*SCOPE, "pos")
    return few.union(chosen)


def set_gains(
    points: DataFrame, queries: DataFrame, ratios: list[float], temporal_fraction: float = 0.5, sparse: DataFrame | None = None, limit: int = 128
) -> DataFrame:
    """ratio, query_id, traj_id, pos, gain: what each candidate alone adds to the base."""
    state = audit(points, queries, ratios, lambda r: base_size(budget(ratio=r), temporal_fraction))
    changes = candidates(state, sparse, limit).select(*SCOPE, F.col("pos").alias("add"), F.lit(NO_POINT).cast("bigint").alias("drop"))
    scored = score_changes(state, changes)
    return scored.select(*SCOPE, F.col("add").alias("pos"), "hits", "hits_kept", F.greatest("delta", F.lit(0.0)).alias("gain"))


def _wanted(multiplier: float) -> Column:
    return F.greatest(F.lit(1), F.ceil(F.lit(float(multiplier)) * F.col("ratio") * F.col("hits")))


def _best(positive: DataFrame, value: str, most: Column) -> DataFrame:
    """The rows of each query with the largest values, at most ``most``.

    They are written before the global order, which reads its input twice: once for its cuts, once to sort.
    """
    positive = materialize(positive)
    order = [F.round(value, 12).desc(), F.col("traj_id"), F.col("pos")]
    return rank_within(positive, QUERY, order, "_r", None).filter(F.col("_r") <= most)


def _summed(parts: DataFrame, queries: DataFrame, ratios: list[float], weights: list[float]) -> DataFrame:
    """Labels from ``value`` per (ratio, query, point): mean over queries, weighted over ratios."""
    total = float(max(1, queries.count()))
    each = F.create_map(*[x for r, w in zip(ratios, weights) for x in (F.lit(float(r)), F.lit(float(w) / sum(weights)))])
    return parts.groupBy(*POINT).agg(clamp(F.sum(F.col("value") * each[F.col("ratio")]) / total).alias("label"))


def _checked(ratios: list[float], weights: list[float] | None, multiplier: float, mass: str) -> tuple[list[float], list[float]]:
    if mass not in MASS_MODES:
        raise ValueError(f"unknown mass mode: {mass!r}")
    if multiplier <= 0:
        raise ValueError("the multiplier must be positive")
    weights = weights or budget_weights(ratios)
    used = [(min(1.0, float(r)), w) for r, w in zip(ratios, weights) if r > 0]
    return [r for r, _ in used], [w for _, w in used]


def _mass(chosen: DataFrame, mass: str, gain: str) -> DataFrame:
    """Adds ``value``: the gain, one, or an equal share of the query's unit mass."""
    if mass == "gain":
        return chosen.withColumn("value", F.col(gain))
    if mass == "point":
        return chosen.withColumn("value", F.lit(1.0))
    sizes = chosen.groupBy(*QUERY).agg(F.count(F.lit(1)).alias("_m"))
    return chosen.join(sizes, QUERY).withColumn("value", 1.0 / F.col("_m"))


def set_utility(
    points: DataFrame,
    queries: DataFrame,
    ratios: list[float],
    weights: list[float] | None = None,
    temporal_fraction: float = 0.5,
    multiplier: float = 1.0,
    mass: str = "gain",
    sparse: DataFrame | None = None,
    limit: int = 128,
) -> DataFrame:
    """Label of the points that a query would gain most from, as many as it lacks at each budget."""
    ratios, weights = _checked(ratios, weights, multiplier, mass)
    gains = set_gains(points, queries, ratios, temporal_fraction, sparse, limit)
    wanted = F.when(F.col("hits") >= 2, F.greatest(_wanted(multiplier), F.lit(2))).otherwise(_wanted(multiplier))
    missing = F.least(F.col("hits"), wanted) - F.col("hits_kept")
    chosen = _best(gains.filter((F.col("gain") > 1e-12) & (missing > 0)), "gain", missing)
    return _summed(_mass(chosen, mass, "gain"), queries, ratios, weights)


def _swaps(ratio: Column, fraction: float) -> Column:
    """Points of a track that may be swapped: what the base keeps beyond its protected part."""
    k, n = budget(ratio=ratio), F.col("n_points")
    safe = F.least(k, F.greatest(F.lit(2), F.ceil(k * F.lit(min(1.0, max(0.0, fraction))))))
    return F.greatest(F.least(k - safe, n - k, k - 2), F.lit(0)).cast("bigint")


def nearest_inner(pos: Column, n: Column, k: Column) -> Column:
    """Nearest of k evenly spaced positions (k < n) that is no end of the track; the earlier of two; by arithmetic alone."""
    i = F.floor(pos * (k - 1) / F.greatest(n - 1, F.lit(1)))
    near = [lattice(F.least(F.greatest(i + d, F.lit(1)), k - 2), n, k) for d in (-1, 0, 1, 2)]
    return F.array_min(F.array(*[F.struct(F.abs(p - pos).alias("away"), p.alias("at")) for p in near]))["at"]


def swap_gains(
    points: DataFrame, queries: DataFrame, ratios: list[float], temporal_fraction: float = 0.5, sparse: DataFrame | None = None, limit: int = 128
) -> DataFrame:
    """Every candidate with the base point it would replace (``drop``).

    ``net`` is the change of the query's score by the swap, ``value`` what the candidate
    adds once ``drop`` is gone, ``cost`` what dropping alone takes away.
    """
    c = F.col
    state = audit(points, queries, ratios, lambda r: budget(ratio=r))
    sizes = points.filter("pos = 0").select("traj_id", "n_points")
    found = candidates(state, sparse, limit).join(sizes, "traj_id").filter(_swaps(c("ratio"), temporal_fraction) > 0)
    drop = nearest_inner(c("pos"), c("n_points"), budget(ratio=c("ratio"))).alias("drop")
    swaps = materialize(found.select(*SCOPE, c("pos").alias("add"), drop))
    alone = swaps.select(*SCOPE, F.lit(NO_POINT).cast("bigint").alias("add"), "drop").distinct()
    scored = materialize(score_changes(state, swaps.union(alone)))
    dropped = scored.filter(c("add") == NO_POINT).select(*SCOPE, "drop", c("delta").alias("_without"))
    both = scored.filter(c("add") != NO_POINT).join(dropped, [*SCOPE, "drop"])
    value, cost = (F.greatest(x, F.lit(0.0)) for x in (c("delta") - c("_without"), -c("_without")))
    return both.select(*SCOPE, c("add").alias("pos"), "drop", "hits", c("delta").alias("net"), value.alias("value"), cost.alias("cost"))


def _capacity(points: DataFrame, ratios: list[float], fraction: float) -> dict[float, int]:
    """Swaps that all tracks together allow at each ratio; one row from the driver's view."""
    sums = [F.sum(_swaps(F.lit(r), fraction)) for r in ratios]
    return dict(zip(ratios, points.filter("pos = 0").agg(*sums).first()))


def _open(points: DataFrame, ratios: list[float], weights: list[float], fraction: float) -> tuple[list[float], list[float], Column]:
    """Ratios that allow a swap, their weights, and the number of swaps as a column of the ratio."""
    capacity = _capacity(points, ratios, fraction)
    used = [(r, w) for r, w in zip(ratios, weights) if capacity[r]]
    if not used:
        return [], [], F.lit(0)
    allowed = F.create_map(*[F.lit(x) for r, _ in used for x in (r, int(capacity[r]))])
    return [r for r, _ in used], [w for _, w in used], allowed[F.col("ratio")]


def _no_labels(points: DataFrame) -> DataFrame:
    return points.select(*POINT, F.lit(0.0).alias("label")).limit(0)


def local_swap_utility(
    points: DataFrame,
    queries: DataFrame,
    ratios: list[float],
    weights: list[float] | None = None,
    temporal_fraction: float = 0.5,
    multiplier: float = 1.0,
    mass: str = "gain",
    sparse: DataFrame | None = None,
    limit: int = 128,
) -> DataFrame:
    """Label of the points that improve a query most when they take the place of the nearest base point."""
    ratios, weights = _checked(ratios, weights, multiplier, mass)
    ratios, weights, allowed = _open(points, ratios, weights, temporal_fraction)
    if not ratios:
        return _no_labels(points)
    gains = swap_gains(points, queries, ratios, temporal_fraction, sparse, limit).drop("value")
    most = F.least(_wanted(multiplier), allowed)
    return _summed(_mass(_best(gains.filter("net > 1e-12"), "net", most), mass, "net"), queries, ratios, weights)


def local_swap_gain_cost(
    points: DataFrame,
    queries: DataFrame,
    ratios: list[float],
    weights: list[float] | None = None,
    temporal_fraction: float = 0.5,
    multiplier: float = 1.0,
    mass: str = "gain",
    sparse: DataFrame | None = None,
    limit: int = 128,
) -> DataFrame:
    """Labels of both sides of the best swaps: what the new point adds, and what the base point it replaces was worth.

    A base point is replaced once per query, by the candidate with the largest net gain.
    """
    ratios, weights = _checked(ratios, weights, multiplier, mass)
    ratios, weights, allowed = _open(points, ratios, weights, temporal_fraction)
    if not ratios:
        return _no_labels(points)
    c = F.col
    gains = swap_gains(points, queries, ratios, temporal_fraction, sparse, limit).withColumnRenamed("value", "worth")
    # of the candidates for one base point the best one: a minimum that is combined before the shuffle
    better = F.struct((-F.round("net", 12)).alias("a"), c("pos").alias("b"))
    single = gains.filter("net > 1e-12").groupBy(*SCOPE, "drop").agg(F.min_by(F.struct("pos", "hits", "net", "worth", "cost"), better).alias("s"))
    chosen = materialize(_best(single.select(*SCOPE, "drop", "s.*"), "net", F.least(_wanted(multiplier), allowed)))
    added = _mass(chosen, mass, "worth").select(*QUERY, *POINT, "value")
    taken = _mass(chosen, mass, "cost").filter("cost > 0").select(*QUERY, "traj_id", c("drop").alias("pos"), "value")
    return _summed(added.union(taken), queries, ratios, weights)
