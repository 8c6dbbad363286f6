"""The whole analysis of one network and several score sets: similarity, permutations, hierarchies, statistics, consensus."""

from __future__ import annotations

import json
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strata.functions.scores import transform
from strata.operators import consensus, diffusion, graph, hierarchy, null_model, statistics
from strata.plans.config import PipelineConfig
from strata.plans.steps import step, verbose
from strata.sources import store as stores
from strata.sources import text
from strata.tables import settle


@dataclass(frozen=True)
class LabelResult:
    """Statistics of a score set, its clusters (node, cluster), and its curves."""

    statistics: dict
    clusters: DataFrame
    curves: DataFrame
    summary: DataFrame


@dataclass(frozen=True)
class PipelineResult:
    beta: float
    labels: dict[str, LabelResult]
    consensus_nodes: DataFrame | None
    consensus_edges: DataFrame | None


def _mark(df: DataFrame) -> str:
    r = df.agg(F.count("*").alias("n"), F.sum(F.xxhash64(*df.columns).cast("decimal(38,0)")).alias("h")).first()
    return f"{r['n']}:{r['h']}"


def run_pipeline(spark: SparkSession, edges: DataFrame, nodes: DataFrame, scores: DataFrame, config: PipelineConfig | None = None) -> PipelineResult:
    """edges: src, dst and, if used, weight; nodes: idx, gene; scores: label, gene, score."""
    config = config or PipelineConfig()
    if config.runtime.verbose:
        verbose()
    if config.reuse and not config.workdir:
        raise ValueError("reuse needs a working folder")
    if "weight" not in edges.columns:
        edges = edges.withColumn("weight", F.lit(1.0))
    edges, nodes = graph.drop_isolated_nodes(settle(spark, edges, "edges"), settle(spark, nodes, "nodes"))
    sim = config.similarity
    with step("similarity"):
        numbers, matrix, beta = diffusion.similarity(spark, edges, sim.directed, sim.beta, sim.threshold, sim.num_digits, sim.use_edge_weights)
    gene_of = {r["idx"]: r["gene"] for r in nodes.collect()}  # as many as the dense matrix has rows
    genes = [gene_of[k] for k in numbers]
    pairs = settle(spark, graph.gene_edges(edges, nodes), "pairs")
    folder = _folder(spark, config, f"{_mark(edges.select('src', 'dst', 'weight'))}|{_mark(nodes.select('idx', 'gene'))}|{_mark(scores.select('label', 'gene', 'score'))}")

    runs = [0, *range(config.permutation.seed_offset + 1, config.permutation.seed_offset + config.permutation.num_permutations + 1)]
    heights = {"single": config.hierarchy.single_precision, "legacy": config.hierarchy.legacy_heights}
    results, largest = {}, []
    for label in [r["label"] for r in scores.select("label").distinct().orderBy("label").collect()]:
        own = scores.where(F.col("label") == label).select(F.col("gene").alias("node"), "score")
        done = stores.ParquetStore(spark, f"{folder}/{label}/curves") if folder else stores.MemoryStore()
        wanted = stores.missing(spark, done, runs)
        if wanted:
            with step(f"permutations and hierarchies of {label}"):
                permuted = _permuted(spark, pairs, own, wanted, config)
                used = transform(permuted, config.hierarchy.score_threshold, config.hierarchy.log_transform)
                if config.runtime.n_jobs > 0:
                    used = used.repartition(config.runtime.n_jobs, "run")
                made = hierarchy.hierarchies(spark, used, genes, matrix, "curve", **heights)
                done.put(settle(spark, made, "curves"))
        curves = done.table().where(F.col("run").isin(runs)).select(F.when(F.col("run") == 0, 0).otherwise(F.col("run") - config.permutation.seed_offset).cast("int").alias("run"), "height", "size")
        curves = settle(spark, curves, "curves")
        found = statistics.process(curves, config.statistics.lower_size_bound, config.statistics.upper_size_bound).first().asDict()
        observed = transform(own.withColumn("run", F.lit(0)), config.hierarchy.score_threshold, config.hierarchy.log_transform)
        merged = settle(spark, hierarchy.hierarchies(spark, observed, genes, matrix, "merge", **heights).drop("run"), "merge")
        members = merged.select(F.col("u").alias("node")).distinct()
        clusters = settle(spark, hierarchy.cut_clusters(merged, members, found["cut_height"]), "clusters")
        results[label] = LabelResult(found, clusters, curves.where("run = 0").drop("run"), statistics.summarize(curves))
        largest.append(clusters.select(F.lit(label).alias("input"), "cluster", "node"))

    agreed_nodes = agreed_edges = None
    if config.consensus.threshold is not None and largest:
        clusters = largest[0]
        for more in largest[1:]:
            clusters = clusters.unionByName(more)
        labels = clusters.select("input").distinct()
        counted = consensus.votes(F.broadcast(labels).join(pairs), consensus.largest_cluster(clusters))
        agreed_edges = settle(spark, consensus.consensus_edges(counted, config.consensus.threshold), "consensus")
        agreed_nodes = consensus.consensus_nodes(spark, agreed_edges)
    return PipelineResult(beta, results, agreed_nodes, agreed_edges)


def _permuted(spark: SparkSession, pairs: DataFrame, scores: DataFrame, runs: list[int], config: PipelineConfig) -> DataFrame:
    table = spark.createDataFrame([(r,) for r in runs], "run int")
    bins = settle(spark, null_model.permutation_bins(spark, pairs, scores, config.permutation.min_bin_size), "bins")
    made = null_model.permute_by_hash(scores, bins, table) if config.permutation.by_hash else null_model.permute_by_seed(spark, scores, bins, table)
    return settle(spark, made, "permuted")


def _folder(spark: SparkSession, config: PipelineConfig, inputs: str) -> str | None:
    """The working folder of runs with the same options and inputs; one that others have left is not mixed with."""
    if not config.workdir:
        return None
    mark = config.fingerprint(inputs)
    folder = f"{config.workdir.rstrip('/')}/{mark[:16]}"
    if not config.reuse:
        where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
        where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)
    return folder


def save_result(result: PipelineResult, folder: str) -> None:
    """Clusters, curves and consensus as small text files."""
    for label, r in result.labels.items():
        text.save_clusters(f"{folder}/clusters_{label}.tsv", r.statistics, r.clusters)
        text.save_curve(f"{folder}/observed_sizes_{label}.tsv", r.curves)
        text.save_curve(f"{folder}/permuted_sizes_{label}.tsv", r.summary)
    text._write(f"{folder}/beta.txt", [json.dumps(result.beta)])
    if result.consensus_nodes is not None:
        text.save_consensus(f"{folder}/consensus_nodes.tsv", f"{folder}/consensus_edges.tsv", result.consensus_nodes, result.consensus_edges)
