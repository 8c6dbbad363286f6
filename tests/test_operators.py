"""Operators against plain versions, on small random inputs."""

import math
import os
import warnings

import numpy as np
import pytest

from strata import tables
from strata.operators import consensus, diffusion, graph, hierarchy, null_model, ranking, statistics
from strata.sources import text, toy

# The seven-node digraph of Tarjan (1983).
SEVEN = [
    ("a", "b", 10), ("b", "a", 12), ("b", "c", 30), ("d", "c", 6), ("d", "e", 16), ("e", "d", 13), ("e", "f", 8), ("f", "a", 26),
    ("a", "g", 15), ("g", "b", 35), ("c", "g", 45), ("g", "c", 22), ("d", "g", 14), ("g", "e", 50), ("f", "g", 20),
]


def strong(weights, limit):
    """Partition by a walk from every node, over cells of the limit or more."""
    n = len(weights)
    reach = []
    for start in range(n):
        seen, todo = {start}, [start]
        while todo:
            u = todo.pop()
            for v in range(n):
                if v not in seen and weights[u, v] >= limit > 0:
                    seen.add(v)
                    todo.append(v)
        reach.append(seen)
    return {frozenset(v for v in range(n) if v in reach[u] and u in reach[v]) for u in range(n)}


def blocks(m, limit):
    return {frozenset(np.flatnonzero((m[u] >= limit) | (np.arange(len(m)) == u)).tolist()) for u in range(len(m))}


@pytest.mark.parametrize("n", [3, 5, 8, 13])
@pytest.mark.parametrize("seed", [1, 2, 3])
def test_merge_matrix_is_the_hierarchy(n, seed):
    w = np.random.RandomState(seed).uniform(size=(n, n))
    np.fill_diagonal(w, 0)
    m = hierarchy.merge_matrix(w)
    for limit in np.unique(w[w > 0]):
        assert blocks(m, limit) == strong(w, limit)


def test_closure_in_tables_equals_the_kernel(spark):
    rows = SEVEN
    merged = hierarchy.merge(hierarchy.closure(spark, spark.createDataFrame(rows, "i string, j string, w int")))
    names = "abcdefg"
    w = np.zeros((7, 7))
    for u, v, x in rows:
        w[names.index(u), names.index(v)] = x
    m = hierarchy.merge_matrix(w)
    assert {(r["u"], r["v"]): r["h"] for r in merged.collect()} == {(names[u], names[v]): m[u, v] for u, v in zip(*np.nonzero(m))}
    nodes = spark.createDataFrame([(c,) for c in names], "node string")
    curve = [tuple(r) for r in hierarchy.size_curve(merged, nodes).orderBy("height", ascending=False).collect()]
    assert curve == hierarchy.size_steps(m)


@pytest.mark.parametrize("in_task", [0, 1000])
def test_strong_components(spark, in_task):
    random = np.random.RandomState(4)
    edges = {(int(u), int(v)) for u, v in random.randint(0, 25, (45, 2)) if u != v}
    w = np.zeros((25, 25))
    for u, v in edges:
        w[u, v] = 1
    found = graph.strong_components(spark, spark.createDataFrame(sorted(edges), "u int, v int"), in_task).collect()
    groups = {}
    for r in found:
        groups.setdefault(r["component"], set()).add(r["node"])
    on_edges = {x for e in edges for x in e}
    assert {frozenset(g) for g in groups.values()} == {g for g in strong(w, 1) if g & on_edges}
    assert all(min(g) == c for c, g in groups.items())


def test_strong_components_of_a_path_and_of_a_chain_of_cycles(spark):
    """Long ways: 5000 nodes in a row, and 3 triangles, each with an edge to the next, also by joins."""
    found = graph.strong_components(spark, spark.createDataFrame([(k, k + 1) for k in range(4999)], "u int, v int")).collect()
    assert len(found) == 5000 and all(r["node"] == r["component"] for r in found)
    edges = [(3 * c + a, 3 * c + b) for c in range(3) for a, b in ((0, 1), (1, 2), (2, 0))] + [(3 * c + 2, 3 * c + 3) for c in range(2)] + [(18, 0), (8, 19)]
    for in_task in (7, 1000):
        found = {r["node"]: r["component"] for r in graph.strong_components(spark, spark.createDataFrame(edges, "u int, v int"), in_task).collect()}
        assert found == {**{k: k // 3 * 3 for k in range(9)}, 18: 18, 19: 19}


@pytest.mark.parametrize("in_task", [0, 1000])
def test_components_of_a_long_path_and_a_star(spark, in_task):
    edges = [(k, k + 1) for k in range(40)] + [(100, k) for k in range(101, 140)]
    found = {r["node"]: r["root"] for r in graph.components(spark, spark.createDataFrame(edges, "u int, v int"), in_task).collect()}
    assert found == {**dict.fromkeys(range(1, 41), 0), **dict.fromkeys(range(101, 140), 100)}


def test_tables_between_steps(spark):
    """A cluster must name the folder; tables go when released, or with their owner."""
    for master in ("yarn", "spark://host:7077", "local-cluster[2,1,1024]"):
        with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
            tables.own_folder(master)
    assert tables.own_folder("local[4]").startswith("file:")
    one, (n, _) = tables.settle_marked(spark, spark.range(5), "t", "id")
    with tables.owned("test"):
        two = tables.settle(spark, spark.range(3), "t")
    three = tables.settle(spark, spark.range(2), "t")
    assert n == one.count() == 5
    there = lambda t: os.path.exists(t.settled_at.removeprefix("file://"))
    tables.release(one, None, spark.range(1))
    tables.forget("test")
    assert [there(t) for t in (one, two, three)] == [False, False, True]


def test_empty_tables(spark):
    none = spark.createDataFrame([], "u int, v int")
    assert graph.connected_components(spark, none).count() == 0
    assert graph.strong_components(spark, none).count() == 0
    assert null_model.permutation_bins(spark, none, spark.createDataFrame([], "node int")).count() == 0


def test_greedy_bins():
    assert null_model.greedy_bins([(5, 1), (4, 2), (3, 3), (1, 1)], 3) == {5: 0, 4: 0, 3: 1, 1: 1}
    assert null_model.greedy_bins([(2, 4)], math.inf) == {2: 0}
    assert null_model.greedy_bins([], 3) == {}


def test_permutations_keep_each_bin(spark):
    scores = spark.createDataFrame([(f"n{k:02}", float(k)) for k in range(20)], "node string, score double")
    bins = spark.createDataFrame([(f"n{k:02}", k // 9) for k in range(18)], "node string, bin_id int")
    runs = spark.createDataFrame([(r,) for r in range(4)], "run int")
    for made in (null_model.permute_by_hash(scores, bins, runs), null_model.permute_by_seed(spark, scores, bins, runs)):
        table = made.toPandas()
        for run, group in table.groupby("run"):
            values = group.set_index("node").score
            assert len(values) == 20
            for lo, hi in ((0, 9), (9, 18), (18, 19), (19, 20)):
                assert sorted(values[[f"n{k:02}" for k in range(lo, hi)]]) == [*map(float, range(lo, hi))]
            assert (run == 0) == (values.sort_index().tolist() == [*map(float, range(20))])


def test_swaps_keep_degrees():
    edges = sorted(tuple(sorted(p)) for p in toy.example_pairs())
    for connected in (False, True):
        out, done = null_model.swap_edges(edges, np.random.RandomState(3), 60, 10_000, connected)
        degrees = lambda es: sorted((x, sum(x in e for e in es)) for x in toy.NAMES)
        assert done == 60 and degrees(out) == degrees(edges)
        assert len({frozenset(e) for e in out}) == len(edges) and all(len(set(e)) == 2 for e in out)
        if connected:
            near = {x: {y for e in out if x in e for y in e if y != x} for x in toy.NAMES}
            assert all(null_model._reaches(near, "a", x) for x in toy.NAMES[1:])


def test_ridder_and_fallback():
    assert diffusion.ridder(lambda x: x**3 - 2, 0, 2, 1e-9) == pytest.approx(2 ** (1 / 3))
    with pytest.warns(UserWarning, match="0.5"):
        assert diffusion.balanced_beta(np.ones((3, 3)) - np.eye(3), limit=0) == 0.5


def test_example_beta_and_columns():
    index = {g: k for k, g in enumerate(toy.NAMES)}
    a = np.zeros((25, 25))
    for u, v in toy.example_pairs():
        a[index[u], index[v]] = a[index[v], index[u]] = 1
    assert diffusion.balanced_beta(a) == pytest.approx(0.050715762239440715, abs=1e-14)
    assert diffusion.restart_matrix(a, 0.3).sum(0) == pytest.approx(np.ones(25))
    assert diffusion.heat_matrix(a, 0.1).sum(0) == pytest.approx(np.ones(25))


def test_iterated_walks_come_to_the_exact_ones(spark):
    edges = spark.createDataFrame([(1, 2, 1.0), (2, 3, 2.0), (3, 1, 1.0), (3, 4, 5.0)], "src int, dst int, weight double")
    adj = graph.adjacency(edges)
    names, a = diffusion.dense(adj)
    exact = diffusion.restart_matrix(a, 0.5)
    for r in diffusion.restart_similarity_iterative(spark, adj, 0.5, 14).collect():
        assert r["p"] == pytest.approx(exact[names.index(r["i"]), names.index(r["j"])], abs=1e-3)


def test_beta_out_of_range(spark):
    with pytest.raises(ValueError):
        diffusion.similarity(spark, spark.createDataFrame([(1, 2, 1.0)], "src int, dst int, weight double"), beta=1.0)


def test_isolated_nodes_are_dropped_and_numbered_anew(spark):
    nodes = spark.createDataFrame([(k, f"g{k}") for k in range(1, 6)], "idx int, gene string")
    edges = spark.createDataFrame([(1, 3, 2.0), (3, 5, 1.0)], "src int, dst int, weight double")
    with pytest.warns(UserWarning, match="2 nodes.*g2, g4"):
        new_edges, new_nodes = graph.drop_isolated_nodes(edges, nodes)
    assert sorted(map(tuple, new_edges.collect())) == [(1, 2, 2.0), (2, 3, 1.0)]
    assert sorted(map(tuple, new_nodes.collect())) == [(1, "g1"), (2, "g3"), (3, "g5")]
    with warnings.catch_warnings():
        warnings.simplefilter("error")
        assert graph.drop_isolated_nodes(new_edges, new_nodes)[0] is new_edges


def test_cut_without_sizes_in_bounds(spark):
    curves = spark.createDataFrame([(r, h, s) for r in range(3) for h, s in ((math.inf, 1), (1.0 + r, 2), (0.0, 3))], "run int, height double, size int")
    r = statistics.process(curves, 10).first()
    assert (r["cut_height"], r["cut_ratio"], r["p_value"], r["expected_cut_size"]) == (math.inf, 0.0, 1.0, None)
    alone = statistics.process(curves.where("run = 0")).first()
    assert alone is None or alone["p_value"] is None


def test_consensus(spark):
    edges = spark.createDataFrame([(k, u, v) for k in (0, 1) for u, v in ("ab", "bc", "cd", "ba")], "input int, u string, v string")
    clusters = spark.createDataFrame([(0, 0, x) for x in "abc"] + [(1, 0, x) for x in "bcd"], "input int, cluster int, node string")
    counted = consensus.votes(edges, clusters)
    assert sorted(map(tuple, counted.collect())) == [("a", "b", 1), ("b", "c", 2), ("c", "d", 1)]
    assert sorted(map(tuple, consensus.consensus_nodes(spark, consensus.consensus_edges(counted, 2)).collect())) == [("b", "b"), ("b", "c")]


def test_text_files(spark, tmp_path):
    (tmp_path / "index").write_text("# c\n1 a\n2\tb\nx y\n3 c extra\n2 bb\n")
    (tmp_path / "edges").write_text("1 2\n1 2 0.5\n2 1 inf\n1 2 3 4\n")
    (tmp_path / "scores").write_text("a 1.5\nb -0.3\nc nan\na 2.5\n")
    (tmp_path / "bins").write_text("# c\na\tb\n\nc\n")
    with pytest.warns(UserWarning):
        by_index, by_name = text.load_index_gene(spark, str(tmp_path / "index"))
        edges = text.load_edge_list(spark, str(tmp_path / "edges"))
        scores = text.load_gene_score(spark, str(tmp_path / "scores"))
    assert sorted(map(tuple, by_index.collect())) == [(1, "a"), (2, "bb")]
    assert sorted(map(tuple, by_name.collect())) == [("a", 1), ("b", 2), ("bb", 2)]
    assert sorted((r["src"], r["dst"], r["weight"]) for r in edges.collect()) == [(1, 2, 0.5), (1, 2, 1.0)]
    assert [tuple(r) for r in scores.collect()] == [("a", 2.5)]
    assert sorted(map(tuple, text.load_bins(spark, str(tmp_path / "bins")).collect())) == [(0, "a"), (0, "b"), (1, "c")]
    text.save_gene_score(str(tmp_path / "out"), scores)
    assert (tmp_path / "out").read_text() == "a\t2.5"
    (tmp_path / "bad").write_text("1 z\n")
    with pytest.raises(Exception, match="no integer"):
        text.load_edge_list(spark, str(tmp_path / "bad")).collect()


def test_numbers_of_a_table_in_many_ranges(spark):
    from strata.operators.ranking import numbered

    table = spark.range(0, 1000, 7).repartition(9)
    assert [r["n"] for r in numbered(spark, table, "id", "n").orderBy("id").collect()] == [*range(1, 144)]
    assert numbered(spark, table.limit(0), "id", "n").count() == 0


def test_names_are_numbered_in_their_order(spark):
    edges, nodes = toy.from_pairs(spark.createDataFrame([("c", "a"), ("b", "c")], "u string, v string"))
    assert sorted(map(tuple, nodes.collect())) == [(1, "a"), (2, "b"), (3, "c")]
    assert sorted(map(tuple, edges.collect())) == [(2, 3, 1.0), (3, 1, 1.0)]


def test_steps_name_what_fails(caplog):
    from strata.plans.steps import step, verbose

    verbose()
    with pytest.raises(ZeroDivisionError) as e, step("dividing"):
        1 / 0
    assert e.value.__notes__ == ["in dividing"]
    verbose(False)


def test_ranks_within_large_groups(spark):
    """One group with nearly all rows, and ranges that cut it."""
    rows = [("a", k * 7919 % 5003) for k in range(5003)] + [("b", k) for k in range(3)]
    table = spark.createDataFrame(rows, "g string, x int")
    found = {(r["g"], r["x"]): r["k"] for r in ranking.ranked_within(spark, table, ["g"], ["x"], "k").collect()}
    assert found == {(g, x): x + 1 for g, x in rows}
    values = spark.createDataFrame([(float(k), (k * 31) % 97) for k in range(400)], "h double, n int")
    most, expected = 0, {}
    for k in range(399, -1, -1):
        most = max(most, (k * 31) % 97)
        expected[float(k)] = most
    assert {r["h"]: r["n"] for r in ranking.running_max(spark, values, "h", "n").collect()} == expected


def test_heights_snap_to_the_nearest_weight(spark):
    """Below all, above all, on one, nearer to either side, and between two equally near."""
    heights = spark.createDataFrame([(h,) for h in (-1.0, 1.0, 1.4, 1.5, 1.9, 7.0, 30.0, 3.0)], "height double")
    weights = spark.createDataFrame([(w,) for w in (1.0, 2.0, 4.0, 20.0, 2.0)], "w double")
    assert {r["height"]: r["weight"] for r in hierarchy.snapped(heights, weights).collect()} == {-1.0: 1.0, 1.0: 1.0, 1.4: 1.0, 1.5: 2.0, 1.9: 2.0, 3.0: 4.0, 7.0: 4.0, 30.0: 20.0}


def test_trees_are_the_merges(spark):
    rng = np.random.RandomState(6)
    w = rng.randint(1, 9, (12, 12)).astype(float) * (rng.uniform(size=(12, 12)) < 0.4)
    np.fill_diagonal(w, 0)
    m = hierarchy.merge_matrix(w)
    merged = spark.createDataFrame([(f"n{u:02}", f"n{v:02}", float(m[u, v])) for u, v in zip(*np.nonzero(m))], "u string, v string, h double")
    nodes = spark.createDataFrame([(f"n{k:02}",) for k in range(12)], "node string")
    edges, leaves = hierarchy.tree(spark, merged, nodes)
    rows = edges.collect()
    assert [r["gene"] for r in leaves.orderBy("idx").collect()] == [f"n{k:02}" for k in range(12)]
    assert len({r["child"] for r in rows}) == len(rows) and all(r["child"] < r["parent"] for r in rows)
    assert sorted(map(tuple, hierarchy.merges_of_tree(spark, edges, leaves).collect())) == sorted(map(tuple, merged.collect()))
    for one, two in ((merged.selectExpr("1 run"), leaves.selectExpr("2 run", "idx", "gene")), (merged.selectExpr("1 run").limit(0), leaves.selectExpr("2 run", "idx", "gene"))):
        with pytest.raises(ValueError):
            hierarchy.zipped(one, two)


def test_what_does_not_fit_a_task_is_refused(spark, monkeypatch):
    monkeypatch.setattr(null_model, "MOST_IN_TASK", 2)
    scores = spark.createDataFrame([("a", 1.0), ("b", 2.0), ("c", 3.0)], "node string, score double")
    with pytest.raises(MemoryError, match="permute_by_hash"):
        null_model.permute_by_seed(spark, scores, None, spark.createDataFrame([(1,)], "run int"))
    with pytest.raises(MemoryError):
        null_model.permute_network(spark, spark.createDataFrame([(1, 2), (2, 3), (3, 1)], "u int, v int"), spark.createDataFrame([(1,)], "run int"))


def test_swaps_keep_a_network_connected():
    edges = [(k, k + 1) for k in range(30)] + [(0, 15), (7, 22), (3, 28)]
    out, done = null_model.swap_edges(edges, np.random.RandomState(3), 60, 5000, connected=True)
    seen, todo = {0}, [0]
    while todo:
        x = todo.pop()
        for u, v in out:
            for a, b in ((u, v), (v, u)):
                if a == x and b not in seen:
                    seen.add(b)
                    todo.append(b)
    assert done == 60 and len(seen) == 31 and len({frozenset(e) for e in out}) == len(edges)
