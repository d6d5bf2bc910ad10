"""Exact pair counts and the literal cases of the gates."""

import itertools

import numpy as np
import pytest
from pyspark.sql import functions as F

from tracklake.operators import audits


def test_inversions():
    rng = np.random.default_rng(0)
    for n in (0, 1, 2, 300, 1500):
        x = rng.integers(0, max(1, n // 2), n)
        assert audits.inversions(x) == sum(int((x[i + 1 :] < v).sum()) for i, v in enumerate(x))


@pytest.mark.parametrize("rows", [4096, 7])
def test_exact_kendall(spark, monkeypatch, rows):
    monkeypatch.setattr(audits, "PAIR_ROWS", rows)
    monkeypatch.setattr(audits, "PAIR_BLOCKS", 1024 if rows > 7 else 30)
    rng = np.random.default_rng(1)
    for spread in (4, 1000):
        s, t = (rng.integers(0, spread, 150) / 7.0 for _ in range(2))
        df = spark.createDataFrame([(0, i, float(a), float(b)) for i, (a, b) in enumerate(zip(s, t))], "traj_id long, pos long, score double, target double").repartition(3)
        same = [np.sign(s[i] - s[k]) * np.sign(t[i] - t[k]) for i, k in itertools.combinations(range(150), 2)]
        same = [v for v in same if v]
        assert audits.kendall(df, "score", "target").first()[0] == pytest.approx(sum(same) / len(same))
    assert audits.kendall(df.limit(0), "score", "target").first()[0] == 0.0


def test_selection_scores(spark):
    def value(c):
        return spark.range(1).select(c).first()[0]

    one = F.lit(1.0)
    assert value(audits.selection_score(F.lit(0.5), one)) == 0.5
    assert value(audits.selection_score(F.lit(0.5), F.lit(0.0))) == -0.5
    assert value(audits.selection_score(F.lit(0.5), one, F.lit(2.0))) == pytest.approx(-2.0 + 0.0005)
    gap = audits.uniform_gap_score(F.lit(0.6), F.lit(0.4), one, {"range": (F.lit(0.3), F.lit(0.5))}, {"range": 1.0})
    assert value(gap) == pytest.approx(0.6 + 0.1 - 0.2)


def test_worst_component_without_a_loss(spark):
    df = spark.createDataFrame([("a", 0.1, 0.5, 0.7), ("b", 0.1, 0.5, 0.6)], "method string, ratio double, x double, y double")
    assert audits.worst_component(df, "a", "b", ["x", "y"]).first()[1:] == ("none", 0.0)
    assert audits.worst_component(df, "b", "a", ["x", "y"]).first()["component"] == "y"


def test_diffusion_gate_needs_heads(spark):
    df = spark.createDataFrame([(0, i, float(i == 0)) for i in range(50)], "traj_id long, pos long, label double")
    assert audits.diffusion_gate(audits.diffusion_rows(df, "label", [])).first() == (["heads_missing"], False)


def test_average_precision_uses_no_window_over_the_whole_table(spark):
    rows = [(1, i, float((i * 7) % 10), i % 3 == 0) for i in range(40)]
    df = spark.createDataFrame(rows, "traj_id bigint, pos bigint, score double, positive boolean")
    best = sorted(rows, key=lambda x: (-x[2], x[0], x[1]))
    at = [i for i, x in enumerate(best) if x[3]]
    got = audits.average_precision(df, "score", "positive")
    assert got.first()[0] == pytest.approx(sum((h + 1) / (i + 1) for h, i in enumerate(at)) / len(at))
    assert "Window" not in got._jdf.queryExecution().optimizedPlan().toString()
    assert audits.average_precision(df.withColumn("positive", df.score < 0), "score", "positive").first()[0] is None
