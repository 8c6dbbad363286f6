"""strata: multiscale clusters in vertex-weighted networks, computed with Spark DataFrames."""

from strata.api import (
    ConsensusInput,
    ConsensusResult,
    ProcessHierarchiesResult,
    compute_permutation_bins,
    compute_similarity_matrix,
    construct_hierarchies,
    construct_hierarchy,
    perform_consensus,
    permute_network,
    permute_network_many,
    permute_scores,
    permute_scores_many,
    process_hierarchies,
)
from strata.operators.consensus import consensus_edges, consensus_nodes, votes
from strata.operators.diffusion import balanced_beta, heat_matrix, restart_matrix, restart_similarity_iterative, similarity
from strata.operators.graph import adjacency, connected_components, drop_isolated_nodes, gene_edges, largest_component, strong_components
from strata.operators.hierarchy import closure, cut_clusters, height_to_clusters, hierarchies, merge, size_curve, tree
from strata.operators.null_model import permutation_bins, permute_by_hash, permute_by_seed
from strata.operators.statistics import best_cuts, process, summarize
from strata.plans.config import ConsensusConfig, HierarchyConfig, PermutationConfig, PipelineConfig, RuntimeConfig, ScoringConfig, SimilarityConfig, StatisticsConfig
from strata.plans.pipeline import LabelResult, PipelineResult, run_pipeline, save_result
from strata.sources.store import DiskStore, HierarchyCodec, MemoryStore, ParquetStore, ScoreMapCodec, load_matrix, save_matrix
from strata.sources.text import load_bins, load_components, load_edge_list, load_gene_score, load_index_gene, save_bins, save_clusters, save_edge_list, save_gene_score, save_index_gene
from strata.sources.toy import example_graph, from_pairs

__version__ = "0.1.0"

__all__ = [name for name in dir() if not name.startswith("_") and name not in ("operators", "plans", "sources", "functions", "tables")] + ["__version__"]
