"""A learned point scorer on pyspark.ml: one regressor per target."""

from __future__ import annotations

from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import GBTRegressor
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.geo import clamp
from .audits import kendall, ndcg_and_lift
from .labels import TARGETS
from .simplify import simplify_segment_budget

POINT = ["traj_id", "pos"]


def fit_scorer(features: DataFrame, targets: DataFrame, heads: tuple[str, ...] = TARGETS, trees: int = 20, depth: int = 5, seed: int = 7) -> dict:
    """Fit one boosted-tree regressor per target from all feature columns."""
    cols = [c for c in features.columns if c not in POINT]
    goal = targets.select(*POINT, *[F.col(h).alias(f"target_{h}") for h in heads])
    data = VectorAssembler(inputCols=cols, outputCol="features").transform(features.join(goal, POINT)).persist()
    models = {}
    for head in heads:
        gbt = GBTRegressor(featuresCol="features", labelCol=f"target_{head}", predictionCol=f"head_{head}", maxIter=trees, maxDepth=depth, seed=seed)
        models[head] = gbt.fit(data)
    data.unpersist()
    return {"columns": cols, "models": models}


def predict_heads(features: DataFrame, scorer: dict) -> DataFrame:
    """Predicted targets per point, clamped to [0, 1]."""
    out = VectorAssembler(inputCols=scorer["columns"], outputCol="features").transform(features)
    for model in scorer["models"].values():
        out = model.transform(out)
    return out.select(*POINT, *[clamp(F.col(f"head_{h}")).alias(h) for h in scorer["models"]])


def compose_score(heads: DataFrame, disabled: tuple[str, ...] = ()) -> DataFrame:
    """One score from the heads; a disabled head becomes neutral."""
    def head(name: str, neutral: float) -> Column:
        return F.lit(neutral) if name in disabled or name not in heads.columns else F.col(name)

    score = head("hit_probability", 0.5) * head("replacement", 0.5) * (0.5 + head("behavior", 0.5)) + 0.25 * head("boundary", 0.0)
    return heads.withColumn("score", clamp(score))


def score_and_simplify(points: DataFrame, features: DataFrame, scorer: dict, ratio: float) -> DataFrame:
    """Score unseen tracks and choose their kept set; no queries are read."""
    scored = compose_score(predict_heads(features, scorer)).select(*POINT, "score", "block_budget")
    return simplify_segment_budget(points.join(scored, POINT), ratio, segment_score="block_budget")


def block_fit(scores: DataFrame, targets: DataFrame, size: int = 32, ratio: float = 0.05) -> DataFrame:
    """Rank agreement and top-share lift of block means."""
    both = scores.select(*POINT, "score").join(targets.select(*POINT, "label"), POINT)
    blocks = both.groupBy("traj_id", F.floor(F.col("pos") / size).alias("pos")).agg(F.avg("score").alias("score"), F.avg("label").alias("label"))
    from .tracks import one_row

    return one_row(kendall(blocks, "score", "label"), ndcg_and_lift(blocks, "score", "label", (ratio,)))
