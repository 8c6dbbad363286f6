"""Functions of scores and heights."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def threshold(scores: DataFrame, limit: float | None, log: bool = False) -> DataFrame:
    """Scores of `limit` or more, or, where they will be logarithms of p-values, of `limit` or less; None keeps all."""
    if limit is None:
        return scores
    return scores.where(F.col("score") <= limit if log else F.col("score") >= limit)


def minus_log10(score: Column) -> Column:
    """-log10(score), 0 for 1; raises for a score that is not above zero."""
    bad = F.raise_error(F.lit("logarithm of a score that is not above zero"))
    return F.when(score <= 0, bad).when(score == 1, F.lit(0.0)).otherwise(-F.log10(score))


def transform(scores: DataFrame, limit: float | None = None, log: bool = False) -> DataFrame:
    """The threshold, then the logarithm."""
    kept = threshold(scores, limit, log)
    return kept.withColumn("score", minus_log10(F.col("score"))) if log else kept


def unit_scores(nodes: DataFrame) -> DataFrame:
    return nodes.select("gene", F.lit(1.0).alias("score"))


def unit_weights(edges: DataFrame) -> DataFrame:
    return edges.withColumn("weight", F.lit(1.0))


def inverse_height(height: Column, least: float = 1e-15) -> Column:
    """1 / height for plots, heights being clipped from below."""
    return 1 / F.greatest(height, F.lit(least))
