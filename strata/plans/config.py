"""Options of a run of the whole analysis."""

from __future__ import annotations

import hashlib
import json
import math
from dataclasses import asdict, dataclass, field, replace


@dataclass(frozen=True)
class SimilarityConfig:
    directed: bool = False
    beta: float | None = None
    threshold: float = 1.0
    num_digits: int = 2
    use_edge_weights: bool = False


@dataclass(frozen=True)
class PermutationConfig:
    num_permutations: int = 100
    min_bin_size: float = 1000
    seed_offset: int = 0
    by_hash: bool = False


@dataclass(frozen=True)
class ScoringConfig:
    """What is done to a score set before its hierarchy is made."""

    log_transform: bool = False
    score_threshold: float | None = None


@dataclass(frozen=True)
class RuntimeConfig:
    """n_jobs: partitions of what runs side by side, -1 for as many as the session has cores; verbose: steps are logged."""

    n_jobs: int = -1
    verbose: bool = False


@dataclass(frozen=True)
class HierarchyConfig:
    score_threshold: float | None = None
    log_transform: bool = False
    single_precision: bool = True
    legacy_heights: bool = False


@dataclass(frozen=True)
class StatisticsConfig:
    lower_size_bound: float = 10
    upper_size_bound: float = math.inf


@dataclass(frozen=True)
class ConsensusConfig:
    threshold: int | None = 2


@dataclass(frozen=True)
class PipelineConfig:
    """reuse: take what an earlier run with the same options and inputs has left in the working folder."""

    similarity: SimilarityConfig = field(default_factory=SimilarityConfig)
    permutation: PermutationConfig = field(default_factory=PermutationConfig)
    hierarchy: HierarchyConfig = field(default_factory=HierarchyConfig)
    statistics: StatisticsConfig = field(default_factory=StatisticsConfig)
    consensus: ConsensusConfig = field(default_factory=ConsensusConfig)
    workdir: str | None = None
    reuse: bool = False
    runtime: RuntimeConfig = field(default_factory=RuntimeConfig)

    def with_scoring(self, scoring: ScoringConfig) -> PipelineConfig:
        """The same with other preprocessing of scores."""
        return replace(self, hierarchy=replace(self.hierarchy, score_threshold=scoring.score_threshold, log_transform=scoring.log_transform))

    def fingerprint(self, inputs: str) -> str:
        """Of what the permuted scores and hierarchies depend on."""
        parts = [asdict(self.similarity), {k: v for k, v in asdict(self.permutation).items() if k != "num_permutations"}, asdict(self.hierarchy), inputs]
        return hashlib.sha256(json.dumps(parts, sort_keys=True).encode()).hexdigest()
