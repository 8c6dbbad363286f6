"""Null models: scores permuted within degree bins, and networks rewired."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strata.operators.graph import canonical_edges, connected_components, induced, largest_component
from strata.operators.ranking import ranked_within
from strata.tables import settle, workers_see_package

#: Scores or edges that every task of a seed holds: about 200 MB.
MOST_IN_TASK = 1_000_000


def scored_degrees(spark: SparkSession, edges: DataFrame, scores: DataFrame) -> DataFrame:
    """(node, degree) within the largest component of the scored part of the network; edges: u, v; scores: node."""
    inner = induced(canonical_edges(edges, "u", "v"), scores)
    inner = induced(inner, largest_component(connected_components(spark, inner)))
    return inner.select(F.explode(F.array("u", "v")).alias("node")).groupBy("node").agg(F.count("*").alias("degree"))


def greedy_bins(counts: list[tuple[int, int]], least: float) -> dict[int, int]:
    """Bin of each degree; counts: (degree, nodes). Degrees downwards fill a bin up to `least`; what is left joins the last bin."""
    out, bin_, held = {}, 0, 0
    for degree, n in sorted(counts, reverse=True):
        out[degree] = bin_
        held += n
        if held >= least:
            bin_, held = bin_ + 1, 0
    last = bin_ - 1 if bin_ else 0
    return {d: min(b, last) for d, b in out.items()}


def permutation_bins(spark: SparkSession, edges: DataFrame, scores: DataFrame, least: float = math.inf) -> DataFrame:
    """(node, degree, bin_id). Only the histogram of degrees reaches the driver."""
    degrees = scored_degrees(spark, edges, scores)
    counts = [(r["degree"], r["count"]) for r in degrees.groupBy("degree").count().collect()]
    table = spark.createDataFrame([*greedy_bins(counts, least).items()], "degree bigint, bin_id int")
    return degrees.join(F.broadcast(table), "degree").select("node", "degree", "bin_id")


def permute_by_hash(scores: DataFrame, bins: DataFrame | None, runs: DataFrame) -> DataFrame:
    """(run, node, score): within each bin the nodes, ordered by a hash with the run, take the scores of the nodes in their own order.

    Run 0 is as observed. Nodes in no bin keep their score. scores: node, score; bins: node, bin_id; runs: run, a number for
    each permutation asked for. A bin may hold all nodes (without bins it does): ranks are found range by range.
    """
    placed = scores.join(bins.select("node", "bin_id"), "node", "left") if bins is not None else scores.withColumn("bin_id", F.lit(0))
    spark = scores.sparkSession
    here = settle(spark, ranked_within(spark, placed.where("bin_id is not null"), ["bin_id"], ["node"], "k"), "bins")
    each = here.select("node", "bin_id").join(F.broadcast(runs.where("run > 0"))).withColumn("mix", F.md5(F.concat_ws(":", "run", "node")))
    mixed = ranked_within(spark, each, ["run", "bin_id"], ["mix", "node"], "k")
    moved = mixed.join(here.select("bin_id", "k", "score"), ["bin_id", "k"]).select("run", "node", "score")
    still = placed.where("bin_id is null").select("node", "score").join(F.broadcast(runs.where("run > 0"))).select("run", "node", "score")
    return moved.unionByName(still).unionByName(scores.join(F.broadcast(runs.where("run = 0"))).select("run", "node", "score"))


def shuffled(genes: list[str], scores: dict[str, float], bins: list[list[str]] | None, seed: int) -> dict[str, float]:
    """One permutation by NumPy's legacy generator: bins in order, values in the order of names, genes of no bin as they are."""
    out, random = dict(scores), np.random.RandomState(seed)
    for members in bins if bins is not None else [genes]:
        own = sorted(g for g in members if g in scores)
        values = np.array([scores[g] for g in own])
        random.shuffle(values)
        out.update(zip(own, values.tolist()))
    return out


def permute_by_seed(spark: SparkSession, scores: DataFrame, bins: DataFrame | None, seeds: DataFrame) -> DataFrame:
    """(run, node, score) by NumPy's legacy generator, a task for each seed; seeds: run.

    The generator walks all nodes in one order, so the scores, one value a node, are broadcast; refused beyond MOST_IN_TASK
    nodes, before anything is collected. permute_by_hash() has no such limit.
    """
    workers_see_package(spark)
    _check(scores, "scores", "permute_by_hash")
    values = {r["node"]: r["score"] for r in scores.select("node", "score").toLocalIterator()}
    of = None
    if bins is not None:
        table = bins.select("bin_id", "node").toPandas()
        of = [group["node"].tolist() for _, group in table.groupby("bin_id", sort=True)]
    shared = spark.sparkContext.broadcast((values, of))
    kind = dict(scores.dtypes)["node"]

    def work(batches):
        known, groups = shared.value
        for batch in batches:
            for run in batch["run"]:
                made = known if run == 0 else shuffled([*known], known, groups, int(run))
                yield pd.DataFrame({"run": run, "node": [*made.keys()], "score": [float(x) for x in made.values()]})

    return seeds.select(F.col("run").cast("int")).repartition(max(1, spark.sparkContext.defaultParallelism), "run").mapInPandas(work, f"run int, node {kind}, score double")


def _check(rows: DataFrame, what: str, other: str) -> None:
    n = rows.count()
    if n > MOST_IN_TASK:
        raise MemoryError(f"{n} {what} are too many for a task of a seed (at most {MOST_IN_TASK}); {other}")


def swap_edges(edges: list[tuple], random: np.random.RandomState, swaps: int, most_tries: int, connected: bool = False) -> tuple[list[tuple], int]:
    """Edges after so many double-edge swaps: (a, b), (c, d) become (a, d), (c, b) if both are new and no loops."""
    edges = [tuple(e) for e in edges]
    known = {frozenset(e) for e in edges}
    near: dict = {}
    for u, v in edges if connected else ():
        near.setdefault(u, set()).add(v)
        near.setdefault(v, set()).add(u)

    def change(x: int, y: int, one: tuple, two: tuple) -> None:
        for u, v in (edges[x], edges[y]) if connected else ():
            near[u].discard(v)
            near[v].discard(u)
        known.difference_update((frozenset(edges[x]), frozenset(edges[y])))
        edges[x], edges[y] = one, two
        known.update((frozenset(one), frozenset(two)))
        for u, v in (one, two) if connected else ():
            near[u].add(v)
            near[v].add(u)

    done = tries = 0
    while done < swaps and tries < most_tries and len(edges) > 1:
        tries += 1
        x, y = random.randint(len(edges)), random.randint(len(edges))
        (a, b), (c, d) = edges[x], edges[y]
        if random.randint(2):
            c, d = d, c
        one, two = frozenset((a, d)), frozenset((c, b))
        if x == y or len(one) < 2 or len(two) < 2 or one in known or two in known or one == two:
            continue
        before = edges[x], edges[y]
        change(x, y, (a, d), (c, b))
        if connected and not (_reaches(near, a, b) and _reaches(near, c, d)):
            change(x, y, *before)
            continue
        done += 1
    return edges, done


def _reaches(near: dict, a, b) -> bool:
    """Whether a path leads from a to b, searched from both ends by turns, the smaller front first."""
    fronts, seen = [{a}, {b}], [{a}, {b}]
    while fronts[0] and fronts[1]:
        k = 0 if len(fronts[0]) <= len(fronts[1]) else 1
        fronts[k] = {x for u in fronts[k] for x in near.get(u, ()) if x not in seen[k]}
        if fronts[k] & seen[1 - k]:
            return True
        seen[k] |= fronts[k]
    return False


def permute_network(spark: SparkSession, edges: DataFrame, seeds: DataFrame, connected: bool = False, per_edge: float = 100.0) -> DataFrame:
    """(run, u, v): one rewired network for each seed, with the degrees of the first. A chain of swaps is sequential, so a seed is a task,
    and networks of more than MOST_IN_TASK edges are refused before anything is collected.

    connected: only the largest component is rewired, and stays connected.
    """
    workers_see_package(spark)
    pairs = canonical_edges(edges, "u", "v")
    if connected:
        pairs = induced(pairs, largest_component(connected_components(spark, pairs)))
    pairs = settle(spark, pairs, "pairs")
    _check(pairs, "edges", "permute scores instead")
    kind = dict(pairs.dtypes)["u"]
    start = sorted(tuple(r) for r in pairs.collect())  # every task walks from the whole network
    shared = spark.sparkContext.broadcast(start)

    def work(batches):
        for batch in batches:
            for run in batch["run"]:
                own = shared.value
                out, _ = swap_edges(own, np.random.RandomState(int(run)), math.ceil(per_edge * len(own)), 1 << 30 if not connected else 100 * math.ceil(per_edge * len(own)), connected)
                yield pd.DataFrame({"run": int(run), "u": [min(e) for e in out], "v": [max(e) for e in out]})

    return seeds.select(F.col("run").cast("int")).repartition(max(1, spark.sparkContext.defaultParallelism), "run").mapInPandas(work, f"run int, u {kind}, v {kind}")
