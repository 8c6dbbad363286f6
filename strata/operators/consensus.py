"""Consensus over several results: network edges within a cluster vote, and edges with enough votes form groups."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strata.operators.graph import canonical_edges, connected_components


def votes(edges: DataFrame, clusters: DataFrame) -> DataFrame:
    """(u, v, votes): in how many inputs an edge lies within a cluster; edges: input, u, v; clusters: input, cluster, node.

    Joined from the edges, so pairs of a cluster that are no edge are never made. Clusters that overlap vote each.
    """
    one = edges.select("input", F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).where("u <> v").distinct()
    a = clusters.select("input", F.col("cluster").alias("cu"), F.col("node").alias("u"))
    b = clusters.select("input", F.col("cluster").alias("cv"), F.col("node").alias("v"))
    return one.join(a, ["input", "u"]).join(b, ["input", "v"]).where("cu = cv").groupBy("u", "v").agg(F.count("*").alias("votes"))


def consensus_edges(counted: DataFrame, least: int) -> DataFrame:
    return counted.where(F.col("votes") >= least)


def consensus_nodes(spark: SparkSession, kept: DataFrame) -> DataFrame:
    """(group_id, node): connected groups of the kept edges, named by their least node."""
    return connected_components(spark, canonical_edges(kept, "u", "v")).select(F.col("component").alias("group_id"), "node")


def largest_cluster(clusters: DataFrame) -> DataFrame:
    """(input, cluster, node) of each input's largest cluster; of equal ones, the first by its sorted members."""
    sizes = clusters.groupBy("input", "cluster").agg(F.count("*").alias("n"), F.min("node").alias("least"))
    top = sizes.groupBy("input").agg(F.min_by("cluster", F.struct(-F.col("n"), "least")).alias("cluster"))
    return clusters.join(F.broadcast(top), ["input", "cluster"], "left_semi")
