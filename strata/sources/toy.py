"""The example network: a clique of eight, a ring of eight with chords, a ring of eight, and a node that joins them."""

from __future__ import annotations

import math
import string

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strata.operators.ranking import numbered

NAMES = string.ascii_lowercase[:25]

# The second score set of the example.
SCORES_2 = {**dict.fromkeys("abcdefgh", 0.1), **dict.fromkeys("ilmn", 0.6), **dict.fromkeys("jp", 0.4), **dict.fromkeys("ko", 0.5), **dict.fromkeys("qsuw", 0.1), **dict.fromkeys("rtvx", 0.2), "y": 1.0}


def example_pairs() -> list[tuple[str, str]]:
    clique, chords, ring, hub = NAMES[:8], NAMES[8:16], NAMES[16:24], NAMES[24]
    pairs = [(u, v) for k, u in enumerate(clique) for v in clique[k + 1 :]]
    pairs += [(chords[k], chords[(k + step) % 8]) for step in (1, 2) for k in range(8)]
    pairs += [(ring[k], ring[(k + 1) % 8]) for k in range(8)]
    return pairs + [(hub, group[0 if group != ring else 2]) if group != chords else (hub, chords[4]) for group in (clique, chords, ring)]


def positions() -> dict[str, tuple[float, float]]:
    """Where to draw each node: three circles around the node that joins them."""
    around = {group: centre for group, centre in ((NAMES[:8], (-2, 0)), (NAMES[8:16], (2, 0)), (NAMES[16:24], (0, -2)))}
    out = {name: (math.cos(math.pi * k / 4) + x, math.sin(math.pi * k / 4) + y) for group, (x, y) in around.items() for k, name in enumerate(group)}
    return out | {NAMES[24]: (0.0, 0.0)}


def example_graph(spark: SparkSession) -> tuple[DataFrame, DataFrame, DataFrame]:
    """edges(src, dst), nodes(idx, gene) and scores(label, gene, score), as in the example's data files (a generator of them may give `i` another second score, 0.7)."""
    index = {g: k + 1 for k, g in enumerate(NAMES)}
    edges = spark.createDataFrame([(index[u], index[v]) for u, v in example_pairs()], "src int, dst int")
    nodes = spark.createDataFrame([(k, g) for g, k in index.items()], "idx int, gene string")
    first = {**dict.fromkeys(NAMES[:8], 5.0), **dict.fromkeys(NAMES[8:16], 10.0), **dict.fromkeys(NAMES[16:24], 3.0), NAMES[24]: 5.0}
    scores = spark.createDataFrame([(label, g, s) for label, of in (("scores_1", first), ("scores_2", SCORES_2)) for g, s in of.items()], "label string, gene string, score double")
    return edges, nodes, scores


def from_pairs(pairs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """edges(src, dst, weight) and nodes(idx, gene) of a table u, v and, if there, weight: names are numbered from 1 in their order."""
    names = pairs.select(F.explode(F.array("u", "v")).alias("gene")).distinct()
    nodes = numbered(pairs.sparkSession, names, "gene", "idx").select("idx", "gene")
    weight = F.coalesce(F.col("weight").cast("double"), F.lit(1.0)) if "weight" in pairs.columns else F.lit(1.0)
    a, b = nodes.select(F.col("gene").alias("u"), F.col("idx").alias("src")), nodes.select(F.col("gene").alias("v"), F.col("idx").alias("dst"))
    return pairs.join(a, "u").join(b, "v").select("src", "dst", weight.alias("weight")), nodes
