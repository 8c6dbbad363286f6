"""Runs that arrive over time: a folder of permuted scores is read as a stream, and curves are added to a store."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from strata.operators import hierarchy
from strata.sources.store import ParquetStore


def score_runs(spark: SparkSession, folder: str, node: str = "string") -> DataFrame:
    """A stream of rows run, node, score from Parquet files that come into a folder; a run's rows may come at several times."""
    return spark.readStream.schema(f"run int, node {node}, score double").parquet(folder)


def add_curves(spark: SparkSession, runs: DataFrame, names: list, matrix: np.ndarray, store: ParquetStore, checkpoint: str) -> StreamingQuery:
    """For each batch, the curves of the hierarchies of its runs, from all rows of them that have come so far.

    Rows are kept by batch beside the checkpoint, so a batch that is repeated after a failure replaces what it has left.
    """
    rows = f"{checkpoint.rstrip('/')}-rows"

    def add(batch: DataFrame, number: int) -> None:
        if batch.isEmpty():
            return
        batch.withColumn("batch", F.lit(number)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch").parquet(rows)
        there = batch.sparkSession.read.parquet(rows)
        own = there.where(F.col("batch") == number).select("run").distinct()
        whole = there.where(F.col("batch") <= number).join(own, "run", "left_semi").select("run", "node", "score")
        store.put(hierarchy.hierarchies(spark, whole, names, matrix))

    return runs.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
