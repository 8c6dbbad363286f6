"""The supplier network, made in arrays, against pairs counted one by one."""

from collections import Counter
from itertools import permutations

import numpy as np
import pyarrow as pa
import pytest

from strata import queries
from strata.sources import networks


def plain(rows, partners=3):
    orders = {}
    for o, s in rows:
        if o is not None and s is not None:
            orders.setdefault(o, set()).add(s)
    shared = Counter(p for own in orders.values() for p in permutations(own, 2))
    best = {}
    for (u, v), n in sorted(shared.items(), key=lambda x: (x[0][0], -x[1], x[0][1])):
        best.setdefault(u, []).append(v)
    return {(min(u, v), max(u, v)) for u, of in best.items() for v in of[:partners]}


def rows_of(seed, orders=300, suppliers=40):
    rng = np.random.default_rng(seed)
    return [(int(o), int(s) ** 2 - 700) for o in rng.integers(0, orders, 4 * orders) for s in [rng.integers(0, suppliers)]]


@pytest.mark.parametrize("at_once", [400_000, 37, 1])
@pytest.mark.parametrize("far", [1, 2**31, 2**57])
def test_pieces_and_far_numbers(at_once, far, monkeypatch):
    """An order and a supplier go whole, however small the pieces; numbers may lie far apart."""
    monkeypatch.setattr(networks, "AT_ONCE", at_once)
    rows = sorted((o, s if s % 2 else s // 4 * far // 100) for o, s in rows_of(3))
    batches = [pa.RecordBatch.from_pydict({"o": [o for o, _ in rows[k : k + 10]], "s": [s for _, s in rows[k : k + 10]]}) for k in range(0, len(rows), 10)]
    lists = pa.Table.from_batches(networks.co_suppliers(iter(batches))).sort_by("u")
    found = pa.Table.from_batches(networks.most_shared(iter(lists.to_batches(max_chunksize=7)), 3)).to_pydict()
    assert {(min(p), max(p)) for p in zip(found["u"], found["v"])} == plain(rows)


@pytest.mark.parametrize("rows", [[], [(1, 5), (1, 5), (2, 6)], [(None, 1), (None, 2), (1, None), (1, 3)], rows_of(1), rows_of(2, 5000, 12) + [(9, None), (None, 3)] + [(7, s) for s in range(100, 200)]])
def test_same_as_counted_pairs(spark, tmp_path, rows):
    """Nulls, repeated lines, orders of one supplier, ties, none at all; pairs are not joined row by row."""
    spark.createDataFrame(rows, "l_orderkey bigint, l_suppkey bigint").write.parquet(f"{tmp_path}/lineitem.parquet")
    out = networks.supplier_network(spark, str(tmp_path))
    assert out.dtypes == [("u", "bigint"), ("v", "bigint")]
    assert sorted(map(tuple, out.collect())) == sorted(plain(rows))
    assert "Join" not in out._jdf.queryExecution().executedPlan().toString()


def test_balance_makes_the_network_once(spark, sf):
    """Cells in both directions come from pairs that are written, not made twice."""
    plan = queries._unit_trade(spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert "MapInArrow" not in plan and "Scan parquet" in plan
