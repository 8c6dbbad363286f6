"""Statistics of size curves (run, height, size): summaries over permuted runs, best cuts and p-values. Run 0 is the observed one."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def on_grid(curves: DataFrame, grid: DataFrame) -> DataFrame:
    """(run, height, size): each curve on each height of the grid, as at its last height that is not lower.

    One window a run over its own heights and the grid's, so nothing is compared pair by pair. What is broadcast is a number
    for each permutation asked for; the grid grows with the networks and is not.
    """
    runs = curves.select("run").distinct()
    asked = grid.select("height").distinct().join(F.broadcast(runs)).select("run", "height", F.lit(None).cast("int").alias("size"), F.lit(1).alias("asked"))
    both = curves.groupBy("run", "height").agg(F.max("size").alias("size")).select("run", "height", "size", F.lit(0).alias("asked")).unionByName(asked)
    order = Window.partitionBy("run").orderBy(F.desc("height"), "asked").rowsBetween(Window.unboundedPreceding, 0)
    return both.withColumn("size", F.last("size", ignorenulls=True).over(order)).where("asked = 1").select("run", "height", "size")


def summarize(curves: DataFrame) -> DataFrame:
    """(height, min_size, expected_size, max_size) over the permuted runs, at each of their heights."""
    permuted = curves.where("run > 0")
    at = on_grid(permuted, permuted)
    return at.groupBy("height").agg(F.min("size").alias("min_size"), (F.sum("size") / F.count("*")).alias("expected_size"), F.max("size").alias("max_size"))


def ratios(curves: DataFrame, summary: DataFrame, least: float = 1, most: float = math.inf) -> DataFrame:
    """(run, height, size, ratio): observed over expected size, 0 for sizes out of bounds."""
    grid = summary.select(F.lit(None).cast("int").alias("size"), "height", "expected_size", F.lit(0).alias("own"))
    runs = curves.select("run").distinct()
    both = grid.join(F.broadcast(runs)).select("run", "height", "size", "expected_size", "own").unionByName(curves.select("run", "height", "size", F.lit(None).cast("double").alias("expected_size"), F.lit(1).alias("own")))
    order = Window.partitionBy("run").orderBy(F.desc("height"), "own").rowsBetween(Window.unboundedPreceding, 0)
    at = both.withColumn("expected_size", F.last("expected_size", ignorenulls=True).over(order)).where("own = 1")
    good = (F.col("size") >= least) & (F.col("size") <= most)
    return at.select("run", "height", "size", F.when(good, F.col("size") / F.col("expected_size")).otherwise(F.lit(0.0)).alias("ratio"))


def best_cuts(scored: DataFrame) -> DataFrame:
    """(run, height, size, ratio): the greatest ratio, of equal ones the greatest height; infinity where no size is within bounds."""
    top = scored.groupBy("run").agg(F.max(F.struct("ratio", "height", "size")).alias("top")).select("run", "top.*")
    none = F.col("ratio") <= 0
    return top.select("run", F.when(none, F.lit(math.inf)).otherwise(F.col("height")).alias("height"), F.when(none, F.lit(1)).otherwise(F.col("size")).alias("size"), "ratio")


def significance(cuts: DataFrame) -> DataFrame:
    """One row: the observed cut, the mean permuted ratio, and the share of permuted ratios that are not lower (NULL without runs)."""
    observed = cuts.where("run = 0").select(F.col("height").alias("cut_height"), F.col("size").alias("cut_size"), F.col("ratio").alias("cut_ratio"))
    rest = cuts.where("run > 0").select("ratio")
    both = rest.join(F.broadcast(observed))
    stats = both.agg((F.sum("ratio") / F.count("*")).alias("expected_ratio"), (F.sum((F.col("ratio") >= F.col("cut_ratio")).cast("int")) / F.count("*")).alias("p_value"))
    return observed.join(F.broadcast(stats)).withColumn("expected_cut_size", F.when(F.col("cut_ratio") != 0, F.col("cut_size") / F.col("cut_ratio")))


def process(curves: DataFrame, least: float = 1, most: float = math.inf) -> DataFrame:
    """From curves of all runs to the one row of significance()."""
    return significance(best_cuts(ratios(curves, summarize(curves), least, most)))
