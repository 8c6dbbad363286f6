"""Command line: strata SUBCOMMAND ..., one subcommand a step, with text files and Parquet tables between the steps."""

from __future__ import annotations

import argparse
import math
import sys

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strata import api
from strata.operators import diffusion, graph, hierarchy, null_model
from strata.plans.steps import step, verbose
from strata.sources import store, text, toy
from strata.tables import settle


def session() -> SparkSession:
    return SparkSession.builder.appName("strata").getOrCreate()


def construct_similarity_matrix(spark: SparkSession, o: argparse.Namespace) -> None:
    names, matrix, beta = diffusion.similarity(spark, text.load_edge_list(spark, o.edge_list), o.directed, o.beta, o.threshold, o.num_digits, o.use_edge_weights)
    store.save_matrix(diffusion.long_form(spark, names, matrix), o.output, o.name)
    if o.beta_output:
        text._write(o.beta_output, [f"{beta:.{o.num_digits}f}"])


def construct_hierarchy(spark: SparkSession, o: argparse.Namespace) -> None:
    nodes, _ = text.load_index_gene(spark, o.index_gene)
    similarity = store.load_matrix(spark, o.similarity, o.similarity_name)
    scores = text.load_gene_score(spark, o.gene_score) if o.gene_score else None
    tree, leaves = api.construct_hierarchy(spark, similarity, nodes, scores, log_transform=o.log_transform, score_threshold=None if math.isnan(o.score_threshold) else o.score_threshold)
    text.save_edge_list(o.hierarchy_edge_list, tree.select(F.col("child").alias("src"), F.col("parent").alias("dst"), F.col("height").alias("weight")))
    text.save_index_gene(o.hierarchy_index_gene, leaves)


def find_permutation_bins(spark: SparkSession, o: argparse.Namespace) -> None:
    nodes, _ = text.load_index_gene(spark, o.index_gene)
    pairs = settle(spark, graph.gene_edges(text.load_edge_list(spark, o.edge_list), nodes), "pairs")
    bins = null_model.permutation_bins(spark, pairs, text.load_gene_score(spark, o.gene_score).withColumnRenamed("gene", "node"), o.min_size)
    text.save_bins(o.output, bins.withColumnRenamed("node", "gene"))


def permute_scores(spark: SparkSession, o: argparse.Namespace) -> None:
    scores = text.load_gene_score(spark, o.input).withColumnRenamed("gene", "node")
    bins = text.load_bins(spark, o.bins).withColumnRenamed("gene", "node") if o.bins else None
    made = null_model.permute_by_seed(spark, scores, bins, spark.createDataFrame([(o.seed,)], "run int"))
    text.save_gene_score(o.output, made.select(F.col("node").alias("gene"), "score"))


def permute_network(spark: SparkSession, o: argparse.Namespace) -> None:
    edges = text.load_edge_list(spark, o.input).select(F.col("src").alias("u"), F.col("dst").alias("v"))
    made = null_model.permute_network(spark, edges, spark.createDataFrame([(o.seed,)], "run int"), o.connected, o.swaps)
    text.save_edge_list(o.output, made.select(F.col("u").alias("src"), F.col("v").alias("dst")))


def _merges(spark: SparkSession, edges: list[str], names: list[str]) -> DataFrame:
    """(run, u, v, h) of files of trees and leaves, as many of the one as of the other."""
    if len(edges) != len(names):
        raise ValueError("as many files of trees as of leaf names are needed")
    out = None
    for run, (tree, index) in enumerate(zip(edges, names)):
        cells = text.load_edge_list(spark, tree).select(F.col("src").alias("child"), F.col("dst").alias("parent"), F.col("weight").alias("height"))
        one = hierarchy.merges_of_tree(spark, cells, text.load_index_gene(spark, index)[0]).withColumn("run", F.lit(run))
        out = one if out is None else out.unionByName(one)
    return out


def process_hierarchies(spark: SparkSession, o: argparse.Namespace) -> None:
    merged = _merges(spark, [o.observed_edge_list, *o.permuted_edge_list], [o.observed_index_gene, *o.permuted_index_gene])
    merged = merged.repartition(o.num_cores, "run") if o.num_cores > 1 else merged
    found = api.process_hierarchies(spark, merged, lower_size_bound=o.lower_size_bound, upper_size_bound=o.upper_size_bound)
    if o.clusters:
        figures = {"cut_height": found.observed_cut_height, "cut_size": found.observed_cut_size, "expected_cut_size": found.expected_cut_size, "cut_ratio": found.observed_cut_ratio, "expected_ratio": found.expected_cut_ratio, "p_value": found.p_value}
        text.save_clusters(o.clusters, figures, found.observed_clusters)
    observed = found.curves.where("run = 0").drop("run")
    if o.observed_sizes:
        text.save_curve(o.observed_sizes, observed)
    for path, column in ((o.expected_sizes, "expected_size"), (o.min_sizes, "min_size"), (o.max_sizes, "max_size")):
        if path:
            text.save_curve(path, found.summary.select("height", column))
    if o.plot:
        text.save_points(o.plot, " ".join(o.plot_label), observed, found.summary, found.observed_cut_height)


def perform_consensus(spark: SparkSession, o: argparse.Namespace) -> None:
    """Names of networks and scores (-n, -s) only have to be as many as the other files."""
    lists = [o.components, o.index_gene, o.edge_list, *[x for x in (o.networks, o.scores) if x]]
    if len({*map(len, lists)}) != 1:
        raise ValueError("as many files of components, names and edges, and names of networks and scores, are needed")
    inputs = []
    for components, index, edge_list in zip(o.components, o.index_gene, o.edge_list):
        pairs = graph.gene_edges(text.load_edge_list(spark, edge_list), text.load_index_gene(spark, index)[0])
        inputs.append(api.ConsensusInput(pairs, text.load_components(spark, components).select(F.lit(0).alias("cluster"), F.col("gene").alias("node"))))
    found = api.perform_consensus(spark, inputs, o.threshold)
    text.save_consensus(o.nodes_output, o.edges_output, found.nodes, found.edges)


def generate_example_graph(spark: SparkSession, o: argparse.Namespace) -> None:
    edges, nodes, scores = toy.example_graph(spark)
    text.save_index_gene(o.index_gene, nodes)
    text.save_edge_list(o.edge_list, edges)
    for path, label in ((o.scores_a, "scores_1"), (o.scores_b, "scores_2")):
        text.save_gene_score(path, scores.where(F.col("label") == label).drop("label"))
    if o.network:
        text.save_edge_list(o.network, text.name_edges(edges, nodes).select("u", "v"))
    if o.plot:
        text._write(o.plot, [f"{name}\t{x:.6f}\t{y:.6f}" for name, (x, y) in toy.positions().items()])


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="strata", description=__doc__)
    of = top.add_subparsers(dest="command", required=True)

    def command(function, *options: tuple) -> None:
        sub = of.add_parser(function.__name__.replace("_", "-"))
        sub.set_defaults(function=function)
        for short, name, kind, default in options:
            if kind is bool:
                sub.add_argument(short, f"--{name}", action="store_true")
            elif kind is list:
                sub.add_argument(short, f"--{name}", nargs="*", default=[])
            else:
                sub.add_argument(short, f"--{name}", type=kind, default=None if default is ... else default, required=default is ...)

    command(construct_similarity_matrix, ("-i", "edge-list", str, ...), ("-d", "directed", bool, 0), ("-b", "beta", float, None), ("-nd", "num-digits", int, 2), ("-t", "threshold", float, 1.0), ("-uew", "use-edge-weights", bool, 0), ("-n", "name", str, "PPR"), ("-o", "output", str, ...), ("-bof", "beta-output", str, None))
    command(construct_hierarchy, ("-smf", "similarity", str, ...), ("-smn", "similarity-name", str, "PPR"), ("-igf", "index-gene", str, ...), ("-gsf", "gene-score", str, None), ("-lt", "log-transform", bool, 0), ("-st", "score-threshold", float, math.nan), ("-helf", "hierarchy-edge-list", str, ...), ("-higf", "hierarchy-index-gene", str, ...), ("-v", "verbose", bool, 0))
    command(find_permutation_bins, ("-igf", "index-gene", str, ...), ("-elf", "edge-list", str, ...), ("-gsf", "gene-score", str, ...), ("-ms", "min-size", float, math.inf), ("-o", "output", str, ...))
    command(permute_scores, ("-i", "input", str, ...), ("-bf", "bins", str, None), ("-s", "seed", int, 1), ("-o", "output", str, ...))
    command(permute_network, ("-i", "input", str, ...), ("-c", "connected", bool, 0), ("-s", "seed", int, 1), ("-q", "swaps", float, 100.0), ("-o", "output", str, ...))
    command(process_hierarchies, ("-oelf", "observed-edge-list", str, ...), ("-oigf", "observed-index-gene", str, ...), ("-pelf", "permuted-edge-list", list, 0), ("-pigf", "permuted-index-gene", list, 0), ("-lsb", "lower-size-bound", float, 10.0), ("-usb", "upper-size-bound", float, math.inf), ("-nc", "num-cores", int, 1), ("-cf", "clusters", str, None), ("-pf", "plot", str, None), ("-pl", "plot-label", list, 0), ("-osf", "observed-sizes", str, None), ("-esf", "expected-sizes", str, None), ("-minsf", "min-sizes", str, None), ("-maxsf", "max-sizes", str, None), ("-v", "verbose", bool, 0))
    command(perform_consensus, ("-cf", "components", list, 0), ("-igf", "index-gene", list, 0), ("-elf", "edge-list", list, 0), ("-n", "networks", list, 0), ("-s", "scores", list, 0), ("-t", "threshold", int, 2), ("-cnf", "nodes-output", str, ...), ("-cef", "edges-output", str, ...), ("-v", "verbose", bool, 0))
    command(generate_example_graph, ("-nf", "network", str, None), ("-igf", "index-gene", str, ...), ("-elf", "edge-list", str, ...), ("-gsfa", "scores-a", str, ...), ("-gsfb", "scores-b", str, ...), ("-pf", "plot", str, None))
    return top


def main(args: list[str] | None = None) -> int:
    """0 after a run or --help, 2 without a known subcommand."""
    try:
        options = parser().parse_args(args)
    except SystemExit as e:
        return int(e.code or 0)
    if getattr(options, "verbose", False):
        verbose()
    with step(options.command):
        options.function(session(), options)
    return 0


if __name__ == "__main__":
    sys.exit(main())
