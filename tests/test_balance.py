"""The restart probability in balance, from tables and from matrices."""

import numpy as np
import pytest

from strata.operators import diffusion, graph


def network(spark, pairs):
    edges = spark.createDataFrame([(u, v, 1.0) for u, v in pairs], "src int, dst int, weight double")
    return graph.adjacency(edges)


def test_ridder_where_the_interval_turns_round():
    """The ends change places, and the next step still goes to the root; the wrong way it took 80 evaluations."""
    seen = []
    f = lambda x: seen.append(x) or (x - 0.4) * (1 - x)
    assert diffusion.ridder(f, 0.01, 0.99, 0.001) == pytest.approx(0.4, abs=0.001)
    assert len(seen) <= 14


@pytest.mark.parametrize("gathered", [diffusion.GATHERED, 3000])
def test_tables_give_what_matrices_give(spark, gathered, monkeypatch):
    """Several components, some of two nodes or of a node with a loop, over several blocks."""
    monkeypatch.setattr(diffusion, "GATHERED", gathered)
    rng = np.random.default_rng(1)
    pairs = [(u, int(v)) for u in range(150) for v in rng.integers(0, 150, 3)] + [(k, k + 1) for k in range(200, 260)] + [(300, 301), (400, 400)]
    pairs = sorted({(min(p), max(p)) for p in pairs})
    adj = network(spark, pairs)
    _, a = diffusion.dense(adj)
    assert diffusion.balanced_beta_of(spark, adj) == pytest.approx(diffusion.balanced_beta(a), abs=1e-10)


def test_more_nodes_than_a_matrix_may_have(spark):
    """Separate copies of a network are in balance where one is."""
    path = [(k, k + 1) for k in range(4)]
    copies = network(spark, [(8 * c + u, 8 * c + v) for c in range(1500) for u, v in path])
    _, a = diffusion.dense(network(spark, path))
    with pytest.raises(MemoryError):
        diffusion.dense(copies)
    assert 0.01 < diffusion.balanced_beta(a) < 0.5
    assert diffusion.balanced_beta_of(spark, copies) == pytest.approx(diffusion.balanced_beta(a), abs=1e-9)


def hubs(n, links=3):
    """A connected network whose nodes choose the lowest of some nodes, so that a few have many neighbours."""
    rng = np.random.default_rng(2)
    return sorted({(min(u, v), max(u, v)) for u in range(n) for v in map(int, np.sort(rng.choice(n, 27, replace=False))[:links]) if u != v})


def test_one_large_component_takes_few_steps(spark):
    """Sums over nodes need 14 steps where each node by itself took 29, and give the same balance; rows wider than WIDE are among them."""
    adj = network(spark, hubs(1500) + [(0, v) for v in range(1, 1500, 7)] + [(5, 5)])
    _, a = diffusion.dense(adj)
    assert a.sum(0).max() > diffusion.WIDE
    start, near, names = diffusion._listed(adj)
    root = diffusion._components(len(names), np.repeat(np.arange(len(names)), np.diff(start)), near)
    (bound,) = np.unique(diffusion.bounds(start, near, root))
    scale = 1 / np.sqrt(a.sum(0))
    values = np.linalg.eigvalsh(scale[:, None] * a * scale)
    assert max(-values[0], values[-2]) <= bound < 1
    assert diffusion.steps(bound, 0.01) <= 14
    found = diffusion.moments(spark, start, near, root, np.full(len(names), bound), 0.01).orderBy("k").toPandas()
    assert found["one"].to_numpy() == pytest.approx(np.polynomial.chebyshev.chebvander(values / bound, len(found) - 1).sum(0), rel=1e-9, abs=1e-7)
    assert diffusion.balanced_beta_of(spark, adj) == pytest.approx(diffusion.balanced_beta(a), abs=1e-10)


def test_other_networks_are_refused_or_have_no_balance(spark):
    with pytest.raises(ValueError, match="weight 1"):
        diffusion.balanced_beta_of(spark, spark.createDataFrame([(1, 2, 2.0), (2, 1, 2.0)], "i int, j int, w double"))
    with pytest.raises(ValueError, match="undirected"):
        diffusion.balanced_beta_of(spark, spark.createDataFrame([(1, 2, 1.0)], "i int, j int, w double"))
    with pytest.warns(UserWarning, match="0.5"):
        assert diffusion.balanced_beta_of(spark, network(spark, [(1, 2)])) == 0.5
    assert diffusion.balanced_beta_of(spark, network(spark, [])) == diffusion.balanced_beta(np.zeros((0, 0)))
