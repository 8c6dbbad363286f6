"""Hierarchies of strongly connected components as (max, min) closures.

Let k(u, v) be the greatest, over directed paths from u to v, of the least weight on the path. Then u and v are in one
component of the cells of weight h or more exactly if m(u, v) = min(k(u, v), k(v, u)) >= h. So the table merge(u, v, h)
is the whole hierarchy: its values are the heights, and {v: m(u, v) >= h} is u's cluster at h.

Tables may have a column `run`; without one there is one hierarchy.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from strata.operators.ranking import dealt, numbered, running_max
from strata.tables import release, settle_marked, settle, workers_see_package


def closure(spark: SparkSession, cells: DataFrame, run: list[str] | None = None) -> DataFrame:
    """(run, i, j, w): weights of widest paths, by doubling their length; cells: run, i, j, w > 0.

    Every round joins the closure with itself, so its cost is that of the pairs connected; the kernel below is for dense ones.
    """
    run = run or []
    columns = [*run, "i", "j", "w"]
    k, mark = settle_marked(spark, cells.where("i <> j and w > 0").groupBy(*run, "i", "j").agg(F.max("w").alias("w")), "closure", *columns)
    while True:
        a, b = k.select(*run, "i", F.col("j").alias("m"), "w"), k.select(*run, F.col("i").alias("m"), "j", F.col("w").alias("x"))
        longer = a.join(b, [*run, "m"]).where("i <> j").select(*run, "i", "j", F.least("w", "x").alias("w"))
        before, known = k, mark
        k, mark = settle_marked(spark, k.unionByName(longer).groupBy(*run, "i", "j").agg(F.max("w").alias("w")), "closure", *columns)
        release(before)
        if mark == known:
            return k


def merge(closed: DataFrame, run: list[str] | None = None) -> DataFrame:
    """(run, u, v, h) both ways for every two nodes in one component at some height."""
    run = run or []
    back = closed.select(*run, F.col("j").alias("i"), F.col("i").alias("j"), F.col("w").alias("x"))
    return closed.join(back, [*run, "i", "j"]).select(*run, F.col("i").alias("u"), F.col("j").alias("v"), F.least("w", "x").alias("h"))


def widest_paths(s: np.ndarray) -> np.ndarray:
    """The closure of a dense matrix, node by node."""
    k = s.copy()
    for m in range(len(k)):
        np.maximum(k, np.minimum(k[:, m, None], k[None, m, :]), out=k)
    return k


def merge_matrix(s: np.ndarray, single: bool = False, legacy: bool = False) -> np.ndarray:
    """m of a dense matrix.

    single: weights are rounded to single precision, so that those that differ by errors of arithmetic only are equal.
    legacy: they are reflected there too, which joins some more near ties.
    """
    s = np.array(s, np.float32 if single or legacy else np.asarray(s).dtype)
    np.fill_diagonal(s, 0)
    if legacy and s.size:
        top = np.float32(2) * s.max()
        s = np.where(s > 0, top - (top - s), 0).astype(np.float32)
    k = widest_paths(s)
    np.fill_diagonal(k, 0)
    return np.minimum(k, k.T)


def largest_block(m: np.ndarray) -> np.ndarray:
    """Places of the largest component of m > 0; of equal ones, that of the first place."""
    if not len(m):
        return np.zeros(0, int)
    first = np.where((m > 0).any(1), np.argmax(m > 0, 1), np.arange(len(m)))
    label = np.minimum(first, np.arange(len(m)))
    sizes = np.bincount(label, minlength=len(m))
    return np.flatnonzero(label == int(np.argmax(sizes)))


def size_steps(m: np.ndarray) -> list[tuple[float, int]]:
    """(height, size of the largest cluster): infinity with 1, each height downwards, and 0 with all."""
    heights = np.unique(m[m > 0])[::-1]
    out = [(math.inf, 1)] + [(float(h), int((m >= h).sum(1).max()) + 1) for h in heights]
    return [*out, (0.0, len(m))]


CURVE = "height double, size int"
MERGE = "u {0}, v {0}, h double"


def hierarchies(spark: SparkSession, scores: DataFrame, names: list, matrix: np.ndarray, what: str = "curve", run: tuple[str, ...] = ("run",), single: bool = False, legacy: bool = False) -> DataFrame:
    """Curves (run, height, size) or merges (run, u, v, h) of S = matrix * score of the column, for every run at once.

    scores: run, node, score. One group is one run's scores, at most as many as the matrix has rows; the matrix is
    broadcast, and its size was checked where it was made. Only the largest component of each run counts.
    """
    workers_see_package(spark)
    shared = spark.sparkContext.broadcast((names, np.asarray(matrix)))
    kinds = {f.name: f.dataType.simpleString() for f in scores.schema}
    head = ", ".join(f"{c} {kinds[c]}" for c in run)
    tail = CURVE if what == "curve" else MERGE.format(kinds["node"])

    def work(key: tuple, group: pd.DataFrame) -> pd.DataFrame:
        all_names, p = shared.value
        place = {x: k for k, x in enumerate(all_names)}
        own = group[group["node"].isin(place)].sort_values("node")
        at = own["node"].map(place).to_numpy(int)
        m = merge_matrix(p[np.ix_(at, at)] * own["score"].to_numpy(float)[None, :], single, legacy)
        block = largest_block(m)
        m, nodes = m[np.ix_(block, block)], own["node"].to_numpy()[block]
        if what == "curve":
            out = pd.DataFrame(size_steps(m), columns=["height", "size"])
        else:
            u, v = np.nonzero(m)
            out = pd.DataFrame({"u": nodes[u], "v": nodes[v], "h": m[u, v].astype(float)})
        for c, x in zip(run[::-1], key[::-1]):
            out.insert(0, c, x)
        return out

    return scores.groupBy(*run).applyInPandas(work, f"{head}, {tail}")


def largest_strong(merged: DataFrame, nodes: DataFrame, run: list[str] | None = None) -> DataFrame:
    """(run, node) of the largest component, of equal ones that of the least node; nodes: run, node."""
    run = run or []
    low = merged.groupBy(*run, F.col("u").alias("node")).agg(F.min("v").alias("v"))
    members = nodes.join(low, [*run, "node"], "left").select(*run, "node", F.least(F.coalesce("v", "node"), "node").alias("component"))
    sizes = members.groupBy(*run, "component").agg(F.count("*").alias("n"))
    top = sizes.groupBy(*run).agg(F.min_by("component", F.struct(-F.col("n"), "component")).alias("component"))
    return members.join(top, [*run, "component"], "left_semi").select(*run, "node") if run else members.join(F.broadcast(top), "component", "left_semi").select("node")


def steps(merged: DataFrame) -> DataFrame:
    """(node, height, cluster, n): at each height at which a node's cluster grows, its least node and its size. One window over a node's own merges."""
    down = Window.partitionBy("u").orderBy(F.desc("h"))
    grown = merged.groupBy("u", "h").agg(F.min("v").alias("v"), F.count("*").alias("n"))
    return grown.select(F.col("u").alias("node"), F.col("h").alias("height"), F.least(F.min("v").over(down), "u").alias("cluster"), (F.sum("n").over(down) + 1).alias("n"))


def height_to_clusters(merged: DataFrame, nodes: DataFrame) -> DataFrame:
    """(height, node, cluster) at every height, at infinity and at zero; the cluster is its least node.

    A hierarchy of n nodes has fewer than n heights. Each node's steps are looked up at all of them in one window, so merges are not compared with heights.
    """
    heights = merged.select(F.col("h").alias("height")).distinct()
    asked = nodes.select("node").crossJoin(heights).select("node", "height", F.lit(None).cast(dict(nodes.dtypes)["node"]).alias("cluster"), F.lit(1).alias("asked"))
    both = steps(merged).select("node", "height", "cluster", F.lit(0).alias("asked")).unionByName(asked)
    down = Window.partitionBy("node").orderBy(F.desc("height"), "asked").rowsBetween(Window.unboundedPreceding, 0)
    inner = both.withColumn("cluster", F.coalesce(F.last("cluster", ignorenulls=True).over(down), "node")).where("asked = 1").select("height", "node", "cluster")
    ends = nodes.select(F.lit(math.inf).alias("height"), "node", F.col("node").alias("cluster"))
    low = nodes.agg(F.min("node").alias("cluster"))
    root = nodes.select(F.lit(0.0).alias("height"), "node").join(F.broadcast(low)).select("height", "node", "cluster")
    return inner.unionByName(ends).unionByName(root)


def leaves(spark: SparkSession, nodes: DataFrame) -> DataFrame:
    """(idx, gene): nodes numbered from 1 in their order."""
    return numbered(spark, nodes.select(F.col("node").alias("gene")).distinct(), "gene", "idx").select("idx", "gene")


def tree(spark: SparkSession, merged: DataFrame, nodes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(child, parent, height) and leaves (idx, gene).

    A cluster of two nodes or more is a node of the tree, at the height at which it forms. Leaves are 1 to n by name; the
    others follow, from the greatest height downwards, of one height by their least leaf. So children have smaller numbers than their parents.
    """
    named = leaves(spark, nodes)
    grown = settle(spark, steps(merged), "steps")
    inner = grown.select("height", "cluster").distinct()
    n = named.count()
    order = inner.withColumn("key", F.struct((-F.col("height")).alias("h"), "cluster"))
    number = settle(spark, numbered(spark, order, "key", "k").select("height", "cluster", (F.col("k") + n).cast("int").alias("id")), "tree")
    own = grown.join(number, ["height", "cluster"])
    down = Window.partitionBy("node").orderBy(F.desc("height"))
    above = own.select("node", F.lag("id").over(down).alias("before"), F.col("id").alias("parent"), "height")
    edges = above.join(named.withColumnRenamed("gene", "node"), "node").select(F.coalesce("before", "idx").alias("child"), "parent", F.col("height").cast("double").alias("height"))
    return edges.distinct(), named


def height_to_sizes(clusters: DataFrame) -> DataFrame:
    """(height, cluster, size)."""
    return clusters.groupBy("height", "cluster").agg(F.count("*").cast("int").alias("size"))


def cut_clusters(merged: DataFrame, nodes: DataFrame, height: float) -> DataFrame:
    """(node, cluster) of cells of weight `height` or more; the cluster is its least node."""
    low = merged.where(F.col("h") >= height).groupBy(F.col("u").alias("node")).agg(F.min("v").alias("v"))
    return nodes.select("node").join(low, "node", "left").select("node", F.least(F.coalesce("v", "node"), "node").alias("cluster"))


def merges_of_tree(spark: SparkSession, edges: DataFrame, named: DataFrame) -> DataFrame:
    """(u, v, h) of a tree (child, parent, height) and its leaves (idx, gene): the greatest height of a node above both.

    Ways upwards are doubled in length each round, so there are as many rounds as the depth has binary digits.
    """
    up, mark = settle_marked(spark, edges.select(F.col("child").alias("low"), F.col("parent").alias("high"), "height"), "up", "low", "high")
    while True:
        longer = up.alias("a").join(up.alias("b"), F.col("a.high") == F.col("b.low")).select(F.col("a.low").alias("low"), F.col("b.high").alias("high"), F.col("b.height").alias("height"))
        before, known = up, mark
        up, mark = settle_marked(spark, up.unionByName(longer).distinct(), "up", "low", "high")
        release(before)
        if mark == known:
            break
    above = up.join(named, up.low == named.idx).select("gene", "high", "height")
    a, b = above.withColumnRenamed("gene", "u"), above.drop("height").withColumnRenamed("gene", "v")
    return a.join(b, "high").where("u <> v").groupBy("u", "v").agg(F.max("height").alias("h"))


def size_curve(merged: DataFrame, nodes: DataFrame) -> DataFrame:
    """(height, size of the largest cluster), with infinity and zero."""
    largest = steps(merged).groupBy("height").agg(F.max("n").alias("size"))
    # the greatest size at or above a height: no node may have grown to it exactly there
    inner = running_max(merged.sparkSession, largest, "height", "size")
    ends = nodes.agg(F.count("*").cast("int").alias("size"))
    top = ends.select(F.lit(math.inf).alias("height"), F.lit(1).alias("size"))
    root = ends.select(F.lit(0.0).alias("height"), "size")
    return inner.select(F.col("height").cast("double").alias("height"), F.col("size").cast("int").alias("size")).unionByName(top).unionByName(root)


def snapped(heights: DataFrame, weights: DataFrame) -> DataFrame:
    """(height, weight): the nearest weight of each height, of two equally near the greater; heights: height; weights: w.

    Two as-of lookups over ranges of both columns together: the last weight below, the first one not below.
    """
    spark = heights.sparkSession
    both = heights.select(F.col("height").cast("double").alias("x"), F.lit(None).cast("double").alias("w")).distinct()
    both = both.unionByName(weights.select(F.col("w").cast("double").alias("x"), F.col("w").cast("double").alias("w")).distinct())
    ranges = dealt(spark, both, "x")
    ends = sorted(tuple(r) for r in ranges.where("w is not null").groupBy("_range").agg(F.min("w"), F.max("w")).collect())  # two numbers a range
    low = spark.createDataFrame([(k, max((m for j, _, m in ends if j < k), default=None), min((m for j, m, _ in ends if j > k), default=None)) for k in {r["_range"] for r in ranges.select("_range").distinct().collect()}], "_range int, below double, above double")
    up = Window.partitionBy("_range").orderBy("x")
    near = ranges.join(F.broadcast(low), "_range").select("x", "w", F.coalesce(F.last("w", ignorenulls=True).over(up.rangeBetween(Window.unboundedPreceding, 0)), "below").alias("a"), F.coalesce(F.first("w", ignorenulls=True).over(up.rangeBetween(0, Window.unboundedFollowing)), "above").alias("b"))
    pick = F.when(F.col("a").isNull(), F.col("b")).when(F.col("b").isNull(), F.col("a")).when(F.col("x") - F.col("a") < F.col("b") - F.col("x"), F.col("a")).otherwise(F.col("b"))
    return near.where("w is null").select(F.col("x").alias("height"), pick.alias("weight"))


def size_curves(merged: DataFrame) -> DataFrame:
    """(run, height, size) of every run, with infinity and zero; merged: run, u, v, h. A run has fewer heights than nodes, and is a group of its own."""
    down = Window.partitionBy("run", "u").orderBy(F.desc("h"))
    grown = merged.groupBy("run", "u", "h").agg(F.count("*").alias("n")).withColumn("n", F.sum("n").over(down) + 1)
    largest = grown.groupBy("run", "h").agg(F.max("n").alias("n"))
    inner = largest.select("run", F.col("h").cast("double").alias("height"), F.max("n").over(Window.partitionBy("run").orderBy(F.desc("h"))).cast("int").alias("size"))
    ends = merged.groupBy("run").agg(F.count_distinct("u").cast("int").alias("n"))
    return inner.unionByName(ends.select("run", F.lit(math.inf).alias("height"), F.lit(1).alias("size"))).unionByName(ends.select("run", F.lit(0.0).alias("height"), F.col("n").alias("size")))


def zipped(merged: DataFrame, nodes: DataFrame) -> DataFrame:
    """(run, idx, gene) of the leaves of runs that have merges; raises ValueError if one table has runs that the other has not."""
    one, two = merged.select("run").distinct(), nodes.select("run").distinct()
    if one.exceptAll(two).limit(1).count() or two.exceptAll(one).limit(1).count():
        raise ValueError("hierarchies and leaf names are not of the same runs")
    return nodes.join(one, "run", "left_semi").select("run", "idx", "gene")
