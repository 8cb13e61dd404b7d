"""Grading of questions by their nearest labelled examples."""

from pyspark.sql import Column, DataFrame, functions as F

from costlens import constants as K
from costlens.operators.similarity import nearest


def _tier_score(neighbours: Column, tier: str, k: int) -> Column:
    mine = F.filter(F.slice(neighbours, 1, k), lambda n: n["tier"] == tier)
    return F.aggregate(mine, F.lit(0.0), lambda s, n: s + n["similarity"])


def best_tier(neighbours: Column, k: int) -> Column:
    """``struct(score, tier)`` of the tier with the largest sum over the k nearest; ties A to Z."""
    scores = [F.struct((-F.round(_tier_score(neighbours, t, k), 9)).alias("neg"), F.lit(t).alias("tier")) for t in K.TIERS]
    return F.array_min(F.array(*scores))


def graded(found: DataFrame, k: int = K.ROUTE_TOP_K, threshold: float = K.ROUTE_THRESHOLD) -> DataFrame:
    """Add ``predicted, confidence, score`` to rows with ``neighbours``; no shuffle is needed."""
    score = -F.col("_best.neg")
    routed = score >= threshold
    clamped = F.least(F.lit(1.0), F.greatest(F.lit(0.0), score / K.ROUTE_CONFIDENCE_SCALE))
    return (
        found.withColumn("_best", best_tier(F.coalesce("neighbours", F.array().cast(found.schema["neighbours"].dataType)), k))
        .withColumn("predicted", F.when(routed, F.col("_best.tier")).otherwise(F.lit(K.DEFAULT_TIER)))
        .withColumn("confidence", F.when(routed, F.round(clamped, 4)).otherwise(F.lit(K.NO_ROUTE_CONFIDENCE)))
        .withColumn("score", score)
        .drop("_best")
    )


def grade(queries: DataFrame, exemplars: DataFrame, k: int = K.ROUTE_TOP_K, threshold: float = K.ROUTE_THRESHOLD) -> DataFrame:
    return graded(nearest(queries, exemplars, k), k, threshold).drop("neighbours")


def top_k_sweep(labelled: DataFrame, exemplars: DataFrame, ks: list[int]) -> DataFrame:
    """Accuracy for several k from one search with the largest."""
    found = nearest(labelled, exemplars, max(ks))
    right = [
        F.count_if(F.col("label") == F.when(-best_tier(F.col("neighbours"), k)["neg"] >= K.ROUTE_THRESHOLD,
                                            best_tier(F.col("neighbours"), k)["tier"]).otherwise(F.lit(K.DEFAULT_TIER)))
        for k in ks
    ]
    counts = F.array(*[F.struct(F.lit(k).cast("long").alias("top_k"), c.alias("correct")) for k, c in zip(ks, right)])
    return found.agg(F.count("*").alias("total"), counts.alias("c")).select("total", F.explode("c").alias("c")).select(
        "c.top_k", "c.correct", "total", F.round(F.coalesce(F.try_divide(F.col("c.correct"), F.col("total")), F.lit(0.0)), 6).alias("accuracy"))
