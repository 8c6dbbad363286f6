"""Graph operators over edge tables: edges(src, dst, weight), adjacency adj(i, j, w), nodes(idx, gene)."""

from __future__ import annotations

import warnings
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strata.operators.ranking import numbered
from strata.tables import release, settle, settle_marked, workers_see_package

#: Edges, counted before, up to which one task finds components: some megabytes.
IN_TASK = 20_000


def canonical_edges(edges: DataFrame, u: str = "src", v: str = "dst") -> DataFrame:
    """Distinct unordered pairs u < v; loops are left out."""
    return edges.select(F.least(u, v).alias("u"), F.greatest(u, v).alias("v")).where("u <> v").distinct()


def gene_edges(edges: DataFrame, nodes: DataFrame, strict: bool = False) -> DataFrame:
    """Distinct unordered pairs of names; an endpoint without a name is dropped, or raises if strict."""
    a, b = nodes.select(F.col("idx").alias("src"), F.col("gene").alias("a")), nodes.select(F.col("idx").alias("dst"), F.col("gene").alias("b"))
    if strict and edges.select(F.explode(F.array("src", "dst")).alias("idx")).join(nodes, "idx", "left_anti").limit(1).count():
        raise KeyError("an edge has an endpoint without a name")
    return canonical_edges(edges.join(a, "src").join(b, "dst"), "a", "b")


def adjacency(edges: DataFrame, directed: bool = False) -> DataFrame:
    """Cells (i, j, w): edge src -> dst stands at i = dst, j = src. Of repeated edges the last by `seq` counts.

    Undirected edges fill both cells, so that a later edge in either direction overwrites both.
    """
    if "seq" not in edges.columns:
        edges = edges.withColumn("seq", F.lit(0))
    if directed:
        return edges.groupBy(F.col("dst").alias("i"), F.col("src").alias("j")).agg(F.max_by("weight", "seq").alias("w"))
    one = edges.groupBy(F.least("src", "dst").alias("i"), F.greatest("src", "dst").alias("j")).agg(F.max_by("weight", "seq").alias("w"))
    return one.unionByName(one.where("i <> j").select(F.col("j").alias("i"), F.col("i").alias("j"), "w"))


def degree_sequence(adj: DataFrame) -> DataFrame:
    """Column sums (j, d)."""
    return adj.groupBy("j").agg(F.sum("w").alias("d"))


def laplacian(adj: DataFrame) -> DataFrame:
    """Degrees on the diagonal less the weights."""
    both = adj.select("i", "j", (-F.col("w")).alias("w")).unionByName(degree_sequence(adj).select(F.col("j").alias("i"), "j", F.col("d").alias("w")))
    return both.groupBy("i", "j").agg(F.sum("w").alias("w"))


def walk_matrix(adj: DataFrame) -> DataFrame:
    """Columns that sum to one; a column without weight stays as it is."""
    return adj.join(degree_sequence(adj), "j").select("i", "j", (F.col("w") / F.when(F.col("d") > 0, F.col("d")).otherwise(F.lit(1.0))).alias("w"))


def isolated_nodes(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Nodes that are on no edge."""
    return nodes.join(_endpoints(edges), "idx", "left_anti")


def drop_isolated_nodes(edges: DataFrame, nodes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Edges and nodes without isolated nodes, numbered 1, 2 ... in the order of their old numbers, with a warning that names up to ten."""
    lost = isolated_nodes(nodes, edges)
    n = lost.count()
    if not n:
        return edges, nodes
    names = [r["gene"] for r in lost.orderBy("gene").limit(10).collect()]
    warnings.warn(f"{n} nodes without edges are dropped: {', '.join(names)}", UserWarning, stacklevel=2)
    kept = numbered(nodes.sparkSession, nodes.join(_endpoints(edges), "idx", "left_semi"), "idx", "new")
    number = kept.select(F.col("idx").alias("old"), "new")
    for end in ("src", "dst"):
        edges = edges.join(number.withColumnRenamed("old", end), end).drop(end).withColumnRenamed("new", end)
    rest = [c for c in edges.columns if c not in ("src", "dst")]
    return edges.select("src", "dst", *rest), kept.select(F.col("new").alias("idx"), "gene")


def _endpoints(edges: DataFrame) -> DataFrame:
    return edges.select(F.explode(F.array("src", "dst")).alias("idx")).distinct()


def induced(edges: DataFrame, members: DataFrame, node: str = "node") -> DataFrame:
    """Pairs u, v whose ends are both members."""
    return edges.join(members.select(F.col(node).alias("u")), "u", "left_semi").join(members.select(F.col(node).alias("v")), "v", "left_semi").select("u", "v")


def components(spark: SparkSession, edges: DataFrame, in_task: int = IN_TASK) -> DataFrame:
    """node and root, its component's least node, for nodes of the edges (u, v); loops are left out.

    Large and small stars by turns (Kiveris and others, 2014): each round joins every edge with the least neighbour of
    its node and writes the edges to the shared folder, so no task holds all neighbours of a node. A round is one job,
    and the files of the round before go. Once no more than `in_task` edges are left, one task joins them.
    """
    edges, mark = settle_marked(spark, edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u <> v").distinct(), "links", "u", "v")
    while True:
        if mark[0] <= in_task:
            return _in_one_task(spark, edges, "root", _joined)
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(least, "u").where("v > u and v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        before, known = edges, mark
        edges, mark = settle_marked(spark, small.unionByName(low.select("u", F.col("m").alias("v"))).distinct(), "links", "u", "v")
        release(before)
        if mark == known:
            return edges.groupBy("u").agg(F.min("v").alias("root")).withColumnRenamed("u", "node")


def _in_one_task(spark: SparkSession, edges: DataFrame, name: str, work: Callable[[list, list], dict]) -> DataFrame:
    """(node, <name>) by a kernel over few edges, counted before."""
    workers_see_package(spark)
    kind = dict(edges.dtypes)["u"]

    def whole(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        u, v = [], []
        for batch in batches:
            u += batch["u"].tolist()
            v += batch["v"].tolist()
        if found := work(u, v):
            yield pd.DataFrame({"node": [*found.keys()], name: [*found.values()]})

    return edges.select("u", "v").coalesce(1).mapInPandas(whole, f"node {kind}, {name} {kind}")


def _joined(u: list, v: list) -> dict:
    """Nodes that are not least in their component, and the least ones, by joining sets."""
    up: dict = {}

    def top(x):
        while up.setdefault(x, x) != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    for a, b in zip(u, v):
        low, high = sorted((top(a), top(b)))
        up[high] = low
    return {x: r for x in list(up) if (r := top(x)) != x}


def connected_components(spark: SparkSession, edges: DataFrame) -> DataFrame:
    """(node, component) for every node of the edges, the component's least node too."""
    found = components(spark, edges).withColumnRenamed("root", "component")
    nodes = edges.select(F.explode(F.array("u", "v")).alias("node")).distinct()
    return nodes.join(found, "node", "left").select("node", F.coalesce("component", "node").alias("component"))


def largest_component(members: DataFrame) -> DataFrame:
    """Nodes of the largest component; of equal ones, that of the least node."""
    top = members.groupBy("component").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "component").limit(1)
    return members.join(F.broadcast(top), "component", "left_semi").select("node")


def strong_components(spark: SparkSession, edges: DataFrame, in_task: int = IN_TASK) -> DataFrame:
    """(node, component): the least node of the strongly connected component, for every node of the edges (u, v).

    Colouring: labels flow along the edges until each node has the least label that reaches it; the nodes of a colour
    from which its label's own node is reached backwards are a component, and leave. Nodes without an edge in or out are
    components by themselves and leave before each round. Each step is a join on nodes; at least one component leaves in
    each round, so there is no limit on rounds. Once no more than `in_task` edges are left, one task finds the rest.
    """
    edges, mark = settle_marked(spark, edges.select("u", "v").where("u <> v").distinct(), "arcs", "u", "v")
    every = settle(spark, edges.select(F.explode(F.array("u", "v")).alias("node")).distinct(), "nodes")
    done: list[DataFrame] = []
    while mark[0] > in_task:
        on_path = edges.select("u").distinct().join(edges.select(F.col("v").alias("u")).distinct(), "u", "left_semi").select(F.col("u").alias("node"))
        inner = settle(spark, on_path, "inner")
        before, known = edges, mark
        edges, mark = settle_marked(spark, induced(edges, inner), "arcs", "u", "v")
        release(before)
        if mark[0] < known[0]:
            release(inner)
            continue
        colour = _spread(spark, inner.withColumn("c", F.col("node")), edges)
        own = edges.join(colour.select(F.col("node").alias("u"), F.col("c").alias("cu")), "u").join(colour.select(F.col("node").alias("v"), F.col("c").alias("cv")), "v").where("cu = cv").select(F.col("v").alias("u"), F.col("u").alias("v"))
        back = settle(spark, own, "back")
        found = more = settle(spark, colour.where("node = c").select("node", F.col("c").alias("component")), "found")
        while not more.isEmpty():
            next_ = more.select(F.col("node").alias("u"), "component").join(back, "u").select(F.col("v").alias("node"), "component").distinct()
            more = settle(spark, next_.join(found.select("node"), "node", "left_anti"), "found")
            found = found.unionByName(more)
        found = settle(spark, found, "found")
        done.append(found)
        rest = settle(spark, colour.select("node").join(found, "node", "left_anti"), "rest")
        before = edges
        edges, mark = settle_marked(spark, induced(edges, rest), "arcs", "u", "v")
        release(before, back, colour, inner, rest)
    named = _in_one_task(spark, edges, "component", _strong)
    for more in done:
        named = named.unionByName(more)
    return every.join(named, "node", "left").select("node", F.coalesce("component", "node").alias("component"))


def _spread(spark: SparkSession, colour: DataFrame, edges: DataFrame) -> DataFrame:
    """The least label that reaches each node."""
    colour, mark = settle_marked(spark, colour, "colours", "node", "c")
    while True:
        came = edges.join(colour.select(F.col("node").alias("u"), "c"), "u").select(F.col("v").alias("node"), "c")
        before, known = colour, mark
        colour, mark = settle_marked(spark, colour.unionByName(came).groupBy("node").agg(F.min("c").alias("c")), "colours", "node", "c")
        release(before)
        if mark == known:
            return colour


def _strong(u: list, v: list) -> dict:
    """The least node of each node's component, by two searches: nodes by the time they are left, then backwards from the last."""
    out_of: dict = {}
    into: dict = {}
    for a, b in zip(u, v):
        out_of.setdefault(a, []).append(b)
        into.setdefault(b, []).append(a)
    seen: set = set()
    left = []
    for start in {**out_of, **into}:
        if start in seen:
            continue
        seen.add(start)
        path = [(start, iter(out_of.get(start, ())))]
        while path:
            node, rest = path[-1]
            after = next((x for x in rest if x not in seen), None)
            if after is None:
                left.append(node)
                path.pop()
            else:
                seen.add(after)
                path.append((after, iter(out_of.get(after, ()))))
    named: dict = {}
    for start in reversed(left):
        if start in named:
            continue
        members, todo = {start}, [start]
        while todo:
            for x in into.get(todo.pop(), ()):
                if x not in named and x not in members:
                    members.add(x)
                    todo.append(x)
        named |= dict.fromkeys(members, min(members))
    return named


def index_vertices(nodes: DataFrame, positions: DataFrame) -> DataFrame:
    """(position, node) of the nodes at the positions, counted from 1 in the order of nodes."""
    return numbered(nodes.sparkSession, nodes.select("node").distinct(), "node", "position").join(positions, "position", "left_semi").select("position", "node")


def threshold_edges(cells: DataFrame, limit: float, w: str = "w") -> DataFrame:
    """Cells of weight `limit` at most."""
    return cells.where(F.col(w) <= limit)


def distinct_weights(cells: DataFrame, w: str = "w") -> DataFrame:
    return cells.select(w).distinct()


def subproblem_index(cells: DataFrame, limit: float, w: str = "w") -> DataFrame:
    """n: distinct weights other than zero, up to the limit."""
    return cells.where((F.col(w) <= limit) & (F.col(w) != 0)).agg(F.count_distinct(w).alias("n"))


def condense(cells: DataFrame, labels: DataFrame) -> DataFrame:
    """(c1, c2, w): least weight other than zero between each ordered pair of components; labels: node, component."""
    a, b = labels.select(F.col("node").alias("i"), F.col("component").alias("c1")), labels.select(F.col("node").alias("j"), F.col("component").alias("c2"))
    return cells.where("w > 0").join(a, "i").join(b, "j").where("c1 <> c2").groupBy("c1", "c2").agg(F.min("w").alias("w"))


def submatrix(cells: DataFrame, nodes: DataFrame, node: str = "node") -> DataFrame:
    """Cells whose row and column are among the nodes."""
    return cells.join(nodes.select(F.col(node).alias("i")), "i", "left_semi").join(nodes.select(F.col(node).alias("j")), "j", "left_semi").select("i", "j", "w")
