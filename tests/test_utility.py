"""Set and swap utilities against whole audits of every changed kept set."""

import pytest
from pyspark.sql import functions as F

from checks.fixtures import boxes, points
from tests.conftest import SF
from tracklake.functions.spacing import base_size, budget, is_evenly_spaced
from tracklake.operators import metrics, utility

TOY = "traj_id long, pos long, t double, lat double, lon double, turn_score double, n_points long, is_start boolean, is_end boolean"
BOX = "query_id int, lat_min double, lat_max double, lon_min double, lon_max double, t_start double, t_end double"


@pytest.fixture(scope="module")
def toy(spark):
    rows = [(0, i, float(i), 55.0 + 0.01 * i, 12.0 + 0.01 * i, 0.0, 8, i == 0, i == 7) for i in range(8)]
    box = (0, 55.025, 55.055, 12.025, 12.055, 2.5, 5.5)
    return spark.createDataFrame(rows, TOY), spark.createDataFrame([box], BOX)


def labels(df):
    return {r.pos: r.label for r in df.collect()}


def test_toy_labels(toy):
    p, q = toy
    gain = labels(utility.set_utility(p, q, [0.5], limit=0))
    assert gain and set(gain) < set(range(8)) and max(gain.values()) <= 1.0
    assert set(labels(utility.set_utility(p, q, [0.5], mass="point", limit=0)).values()) == {1.0}
    swap = labels(utility.local_swap_utility(p, q, [0.5], mass="point", limit=0))
    assert swap and set(swap) <= {1, 3, 4, 6}
    both = labels(utility.local_swap_gain_cost(p, q, [0.5], limit=0))
    assert both[2] > 0 and max(both.get(3, 0), both.get(4, 0)) > both[2] and max(both.values()) <= 1.0


def test_nothing_to_change(toy, spark):
    p, q = toy
    assert utility.set_utility(p, q.limit(0), [0.5]).count() == 0
    assert utility.local_swap_utility(p, q, [1.0]).count() == 0  # everything is kept, so no swap is open
    assert utility.local_swap_gain_cost(p, q, [0.5], temporal_fraction=1.0).count() == 0
    with pytest.raises(ValueError):
        utility.set_utility(p, q, [0.5], mass="mass")
    with pytest.raises(ValueError):
        utility.local_swap_utility(p, q, [0.5], multiplier=0.0)


def audited(points, queries, kept):
    """Usefulness per (scenario, query) by the whole audit."""
    scores = metrics.query_scores(points, kept, queries, ("scenario",))
    weighted = sum(F.lit(w) * F.col(c) for c, w in metrics.USEFULNESS_WEIGHTS.items())
    return {(r.scenario, r.query_id): r.score for r in scores.select("scenario", "query_id", weighted.alias("score")).collect()}


def test_changes_against_whole_audits(spark):
    p, q = points(spark, SF), boxes(spark)
    ratio = 0.4
    swaps = utility.swap_gains(p, q, [ratio], limit=0).filter("pmod(xxhash64(query_id, traj_id, pos), 40) = 0").collect()
    gains = utility.set_gains(p, q, [ratio], limit=0).filter("pmod(xxhash64(query_id, traj_id, pos), 40) = 1").collect()
    assert len(swaps) > 5 and len(gains) > 5
    full = p.filter(is_evenly_spaced(k=budget(ratio=ratio))).select("traj_id", "pos")
    half = p.filter(is_evenly_spaced(k=base_size(budget(ratio=ratio), 0.5))).select("traj_id", "pos")
    sets = [full.select(F.lit("full").alias("scenario"), "*"), half.select(F.lit("half").alias("scenario"), "*")]

    def changed(name, base, traj, add, drop):
        kept = base.filter(~((F.col("traj_id") == traj) & (F.col("pos") == drop)))
        if add is not None:
            kept = kept.union(spark.createDataFrame([(traj, add)], "traj_id long, pos long"))
        sets.append(kept.select(F.lit(name).alias("scenario"), "*"))

    for i, r in enumerate(swaps[:6]):
        changed(f"swap{i}", full, r.traj_id, r.pos, r.drop)
        changed(f"drop{i}", full, r.traj_id, None, r.drop)
    for i, r in enumerate(gains[:6]):
        changed(f"add{i}", half, r.traj_id, r.pos, -1)
    kept = sets[0]
    for s in sets[1:]:
        kept = kept.unionByName(s)
    score = audited(p, q, utility.materialize(kept))
    for i, r in enumerate(swaps[:6]):
        whole, swap, drop = (score[name, r.query_id] for name in ("full", f"swap{i}", f"drop{i}"))
        assert r.net == pytest.approx(swap - whole, abs=1e-9)
        assert r.value == pytest.approx(max(0.0, swap - drop), abs=1e-9) and r.cost == pytest.approx(max(0.0, whole - drop), abs=1e-9)
    for i, r in enumerate(gains[:6]):
        assert r.gain == pytest.approx(max(0.0, score[f"add{i}", r.query_id] - score["half", r.query_id]), abs=1e-9)


def test_long_tracks_give_the_same(hot):
    p, q = points(hot, SF), boxes(hot)
    got = {tuple(r) for r in utility.set_gains(p, q, [0.3], limit=0).select("query_id", "traj_id", "pos", F.round("gain", 9)).collect()}
    hot.conf.unset("spark.tracklake.hotRows")
    want = {tuple(r) for r in utility.set_gains(p, q, [0.3], limit=0).select("query_id", "traj_id", "pos", F.round("gain", 9)).collect()}
    hot.conf.set("spark.tracklake.hotRows", "6")
    assert got == want and got


def test_best_reads_its_input_once(spark):
    """The rows behind a global order are written once, not computed for its cuts and again for the sort."""
    seen = spark.sparkContext.accumulator(0)

    def counted(batches):
        for pdf in batches:
            seen.add(len(pdf))
            yield pdf

    rows = spark.range(60).selectExpr("0.5D AS ratio", "id % 2 AS query_id", "id AS traj_id", "0L AS pos", "double(id) AS gain")
    best = utility._best(rows.mapInPandas(counted, rows.schema), "gain", F.lit(3)).select("traj_id").collect()
    assert sorted(r[0] for r in best) == [54, 55, 56, 57, 58, 59] and seen.value == 60
