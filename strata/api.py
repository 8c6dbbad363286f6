"""The analysis step by step under the names that users of such libraries know, on DataFrames.

edges: src, dst and maybe weight; nodes: idx, gene; scores: gene, score; a similarity: i, j, p by idx; bins: gene, bin_id.
"""

from __future__ import annotations

import math
from collections.abc import Iterable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strata.functions.scores import transform, unit_scores
from strata.operators import consensus, diffusion, hierarchy, null_model, statistics
from strata.tables import settle


@dataclass(frozen=True)
class ConsensusInput:
    """Clusters (cluster, node) of one result, and the network (u, v) they are of."""

    edges: DataFrame
    clusters: DataFrame


@dataclass(frozen=True)
class ConsensusResult:
    """Groups (group_id, node), and the edges (u, v, votes) that they are connected by."""

    nodes: DataFrame
    edges: DataFrame


@dataclass(frozen=True)
class ProcessHierarchiesResult:
    """Clusters (node, cluster) at the observed cut, its figures, the curves of all runs, and the summary of the permuted ones."""

    observed_clusters: DataFrame
    observed_cut_height: float
    observed_cut_ratio: float
    expected_cut_ratio: float | None
    p_value: float | None
    observed_cut_size: int
    expected_cut_size: float | None
    curves: DataFrame = field(repr=False)
    summary: DataFrame = field(repr=False)


def compute_similarity_matrix(spark: SparkSession, edges: DataFrame, *, directed: bool = False, beta: float | None = None, threshold: float = 1.0, num_digits: int = 2, use_edge_weights: bool = False) -> tuple[DataFrame, float]:
    """(i, j, p) and the restart probability."""
    names, matrix, beta = diffusion.similarity(spark, edges, directed, beta, threshold, num_digits, use_edge_weights)
    return diffusion.long_form(spark, names, matrix), beta


def compute_permutation_bins(spark: SparkSession, edges: DataFrame, scores: DataFrame, *, min_size: float = math.inf) -> DataFrame:
    """(gene, degree, bin_id); edges by name: u, v."""
    return null_model.permutation_bins(spark, edges, scores.withColumnRenamed("gene", "node"), min_size).withColumnRenamed("node", "gene")


def permute_scores_many(spark: SparkSession, scores: DataFrame, bins: DataFrame | None = None, *, seeds: Iterable[int], by_hash: bool = False) -> DataFrame:
    """(run, gene, score), a run for each seed."""
    own, of = scores.withColumnRenamed("gene", "node"), bins.withColumnRenamed("gene", "node") if bins is not None else None
    runs = spark.createDataFrame([(int(s),) for s in seeds], "run int")
    made = null_model.permute_by_hash(own, of, runs) if by_hash else null_model.permute_by_seed(spark, own, of, runs)
    return made.withColumnRenamed("node", "gene")


def permute_scores(spark: SparkSession, scores: DataFrame, bins: DataFrame | None = None, *, seed: int) -> DataFrame:
    """(gene, score)."""
    return permute_scores_many(spark, scores, bins, seeds=[seed]).select("gene", "score")


def permute_network_many(spark: SparkSession, edges: DataFrame, *, seeds: Iterable[int], preserve_connectivity: bool = False, Q: float = 100.0) -> DataFrame:
    """(run, src, dst), a run for each seed, with Q swaps an edge."""
    runs = spark.createDataFrame([(int(s),) for s in seeds], "run int")
    pairs = edges.select(F.col("src").alias("u"), F.col("dst").alias("v"))
    return null_model.permute_network(spark, pairs, runs, preserve_connectivity, Q).select("run", F.col("u").alias("src"), F.col("v").alias("dst"))


def permute_network(spark: SparkSession, edges: DataFrame, *, seed: int, preserve_connectivity: bool = False, Q: float = 100.0) -> DataFrame:
    """(src, dst)."""
    return permute_network_many(spark, edges, seeds=[seed], preserve_connectivity=preserve_connectivity, Q=Q).select("src", "dst")


def scored_in_network(similarity: DataFrame, nodes: DataFrame, scores: DataFrame) -> DataFrame:
    """(node, score) of the genes that are in the network and have a score.

    Raises ValueError if rows and columns of the similarity differ, if they are not the nodes, or if no gene is left.
    """
    rows, columns, known = similarity.select(F.col("i").alias("idx")).distinct(), similarity.select(F.col("j").alias("idx")).distinct(), nodes.select("idx").distinct()
    if rows.exceptAll(columns).limit(1).count() or columns.exceptAll(rows).limit(1).count():
        raise ValueError("the similarity is not square: rows and columns differ")
    if rows.exceptAll(known).limit(1).count() or known.exceptAll(rows).limit(1).count():
        raise ValueError("the similarity and the nodes differ in size or in numbers")
    common = nodes.join(scores, "gene").select(F.col("gene").alias("node"), "score")
    if common.isEmpty():
        raise ValueError("no gene of the network has a score")
    return common


def kernel_of(kernel: str, nodes: int) -> str:
    """`numpy` or `sql`; `auto` is numpy as far as a dense matrix fits."""
    if kernel not in ("auto", "numpy", "sql"):
        raise ValueError(f"no kernel {kernel!r}: auto, numpy or sql")
    return kernel if kernel != "auto" else "numpy" if nodes <= diffusion.MOST_DENSE else "sql"


def construct_hierarchies(spark: SparkSession, similarity: DataFrame, nodes: DataFrame, scores: DataFrame | None = None, *, log_transform: bool = False, score_threshold: float | None = None, kernel: str = "auto") -> DataFrame:
    """(run, u, v, h) for all runs at once; scores: run, gene, score, or None for unit scores as run 0.

    kernel: `numpy` has a run in a task and broadcasts the matrix; `sql` makes closures in tables, for networks of any size
    whose connected pairs are not too many.
    """
    scores = unit_scores(nodes).withColumn("run", F.lit(0)) if scores is None else scores
    used = transform(scores, score_threshold, log_transform)
    scored_in_network(similarity, nodes, used.select("gene", F.lit(1.0).alias("score")).distinct())
    runs = used.select("run", F.col("gene").alias("node"), F.col("score").cast("double").alias("score"))
    if kernel_of(kernel, nodes.count()) == "sql":
        return hierarchies_in_tables(spark, similarity, nodes, runs)
    numbers, matrix = diffusion.dense(similarity.select("i", "j", F.col("p").alias("w")))
    gene = {r["idx"]: r["gene"] for r in nodes.collect()}  # as many as the dense matrix has rows
    return hierarchy.hierarchies(spark, runs, [gene[k] for k in numbers], matrix, "merge", single=True)


def hierarchies_in_tables(spark: SparkSession, similarity: DataFrame, nodes: DataFrame, runs: DataFrame) -> DataFrame:
    """(run, u, v, h) by joins alone: weights in single precision, their closure, and of each run the largest component."""
    a, b = nodes.select(F.col("idx").alias("i"), F.col("gene").alias("u")), nodes.select(F.col("idx").alias("j"), F.col("gene").alias("v"))
    named = similarity.join(a, "i").join(b, "j").select(F.col("u").alias("i"), F.col("v").alias("j"), "p")
    scored = runs.join(nodes.select(F.col("gene").alias("node")), "node", "left_semi")
    cells = named.join(scored.select("run", F.col("node").alias("j"), "score"), "j").join(scored.select("run", F.col("node").alias("i")), ["run", "i"])
    closed = hierarchy.closure(spark, cells.select("run", "i", "j", (F.col("p") * F.col("score")).cast("float").alias("w")), ["run"])
    merged = settle(spark, hierarchy.merge(closed, ["run"]), "merge")
    top = hierarchy.largest_strong(merged, scored.select("run", "node"), ["run"])
    return merged.join(top.withColumnRenamed("node", "u"), ["run", "u"], "left_semi").select("run", "u", "v", F.col("h").cast("double").alias("h"))


def construct_hierarchy(spark: SparkSession, similarity: DataFrame, nodes: DataFrame, scores: DataFrame | None = None, *, log_transform: bool = False, score_threshold: float | None = None, kernel: str = "auto") -> tuple[DataFrame, DataFrame]:
    """The tree (child, parent, height) and its leaves (idx, gene); scores: gene, score."""
    runs = None if scores is None else scores.withColumn("run", F.lit(0))
    merged = settle(spark, construct_hierarchies(spark, similarity, nodes, runs, log_transform=log_transform, score_threshold=score_threshold, kernel=kernel).drop("run"), "merge")
    return hierarchy.tree(spark, merged, merged.select(F.col("u").alias("node")).distinct())


def process_hierarchies(spark: SparkSession, merged: DataFrame, *, lower_size_bound: float = 10.0, upper_size_bound: float = math.inf) -> ProcessHierarchiesResult:
    """merged: run, u, v, h as construct_hierarchies() gives them; run 0 is the observed one, the others are permuted."""
    merged = settle(spark, merged, "merge")
    curves = settle(spark, hierarchy.size_curves(merged), "curves")
    found = statistics.process(curves, lower_size_bound, upper_size_bound).first()
    if found is None:
        raise ValueError("there is no observed hierarchy: run 0 is missing")
    observed = merged.where("run = 0").drop("run")
    clusters = hierarchy.cut_clusters(observed, observed.select(F.col("u").alias("node")).distinct(), found["cut_height"])
    return ProcessHierarchiesResult(clusters, found["cut_height"], found["cut_ratio"], found["expected_ratio"], found["p_value"], found["cut_size"], found["expected_cut_size"], curves, statistics.summarize(curves))


def perform_consensus(spark: SparkSession, inputs: Iterable[ConsensusInput], threshold: int) -> ConsensusResult:
    """Edges that lie within a cluster in so many inputs, and their connected groups."""
    edges = clusters = None
    for k, one in enumerate(inputs):
        pairs, members = one.edges.select(F.lit(k).alias("input"), "u", "v"), one.clusters.select(F.lit(k).alias("input"), "cluster", "node")
        edges, clusters = (pairs, members) if edges is None else (edges.unionByName(pairs), clusters.unionByName(members))
    if edges is None:
        raise ValueError("a consensus needs an input")
    kept = settle(spark, consensus.consensus_edges(consensus.votes(edges, clusters), threshold), "consensus")
    return ConsensusResult(consensus.consensus_nodes(spark, kept), kept)
