"""The pivot index against plain loops."""

import numpy as np
import pandas as pd
import pytest

from tracklake.operators import features
from tracklake.plans import nearest
from tracklake.plans.nearest import PivotIndex


def _frame(spark, x, value, start=0):
    pdf = pd.DataFrame(x, columns=[f"c{j}" for j in range(x.shape[1])])
    pdf.insert(0, "id", np.arange(start, start + len(x)))
    pdf["value"] = value
    return spark.createDataFrame(pdf), pdf


def _plain(queries, rows, k, skip_own):
    names = [c for c in rows if c.startswith("c")]
    x, y, value = queries[names].to_numpy(), rows[names].to_numpy(), rows["value"].to_numpy()
    out = {}
    for i, one in zip(queries["id"], x):
        d2 = ((y - one) ** 2).sum(axis=1)
        if skip_own:
            d2[rows["id"].to_numpy() == i] = np.inf
        best = np.lexsort((value, d2))[:k]
        out[i] = [(d2[b], value[b]) for b in best if np.isfinite(d2[b])]
    return out


def _compare(found, want):
    got = {i: [] for i in want}
    for r in found.collect():
        got[r["id"]].append((r["d2"], r["value"]))
    for i, rows in want.items():
        assert sorted(got[i]) == [pytest.approx(w, rel=1e-9, abs=1e-12) for w in rows], i


@pytest.mark.parametrize("skip_own", [False, True])
def test_clusters_are_searched_in_few_blocks(spark, skip_own):
    rng = np.random.default_rng(5)
    centres = rng.uniform(-100, 100, (40, 3))
    x = centres[rng.integers(0, 40, 4000)] + rng.normal(0, 0.5, (4000, 3))
    rows, pdf = _frame(spark, x, rng.uniform(0, 1, 4000))
    index = PivotIndex(rows, ["id"], ["c0", "c1", "c2"], 6, skip_own, block_rows=64)
    asked = rows.drop("value").filter("id % 7 = 0")
    _compare(index.nearest(asked), _plain(pdf[pdf["id"] % 7 == 0], pdf, 6, skip_own))
    assert index.visited_pairs() < 0.15 * asked.count() * len(pdf)


def test_one_place_with_a_third_of_all_rows(spark, monkeypatch):
    """Equal places, values and grid ties; the queries of the hot place are dealt to several groups."""
    monkeypatch.setattr(nearest, "VISIT_ROWS", 50)
    rng = np.random.default_rng(6)
    x = rng.integers(0, 12, (900, 2)).astype(float)
    x[::3] = 4.0
    rows, pdf = _frame(spark, x, rng.integers(0, 9, 900) / 8)
    index = PivotIndex(rows, ["id"], ["c0", "c1"], 5, True, block_rows=16)
    assert index.kept.filter("c0 = 4 AND c1 = 4").count() == 6
    _compare(index.nearest(rows.drop("value")), _plain(pdf, pdf, 5, True))


def test_fewer_rows_than_asked_for(spark):
    rows, pdf = _frame(spark, np.arange(30.0)[:, None], np.arange(30.0) / 30)
    index = PivotIndex(rows, ["id"], ["c0"], 50, True, block_rows=4)
    _compare(index.nearest(rows.drop("value")), _plain(pdf, pdf, 50, True))


@pytest.mark.parametrize("block_rows", [4, 4096])
def test_rows_without_numbers_take_no_part(spark, block_rows):
    nan, inf = float("nan"), float("inf")
    data = [(1, i, float(i), 0.1 * i) for i in range(12)] + [(2, 0, None, 1.0), (2, 1, nan, 1.0), (2, 2, inf, 1.0), (2, 3, 3.0, None), (2, 4, 3.0, nan)]
    h = spark.createDataFrame(data, "traj_id bigint, pos bigint, v double, target double")
    got = {(r["traj_id"], r["pos"]): r["score"] for r in features.knn_prior_score(h, h, ["v"], k=1, block_rows=block_rows).collect()}
    assert got == {**{(1, i): pytest.approx(0.1 * i) for i in range(12)}, (2, 3): pytest.approx(0.3), (2, 4): pytest.approx(0.3)}
    assert features.knn_prior_score(h, h.limit(0), ["v"], k=3, block_rows=block_rows).count() == 0
    assert features.knn_prior_score(h.limit(0), h, ["v"], k=3, block_rows=block_rows).count() == 0


def test_median_of_an_even_number_is_the_lower_one(spark):
    s = spark.createDataFrame([(1, 0, v) for v in (0.1, 0.4, 0.2, 0.9)], "traj_id bigint, pos bigint, score double")
    assert features.combine_sources(s, "median").first()["score"] == 0.2


@pytest.mark.parametrize("block_rows", [16, 4096])
def test_queries_in_one_place_are_searched_once(spark, block_rows):
    """Ten times the queries on the same places visit the same pairs, and each still skips its own row."""
    rng = np.random.default_rng(8)
    x = rng.integers(0, 9, (1200, 2)).astype(float)
    rows, pdf = _frame(spark, x, rng.integers(0, 40, 1200) / 8)
    index = PivotIndex(rows, ["id"], ["c0", "c1"], 5, True, block_rows=block_rows)
    _compare(index.nearest(rows.drop("value")), _plain(pdf, pdf, 5, True))
    assert index.visited_pairs() <= 81 * index.total
