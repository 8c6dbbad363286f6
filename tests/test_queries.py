"""Every registered query gives the rows of its SQL."""

import math

import duckdb
import pytest

from strata.queries import oracle_sql, queries

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem")


@pytest.fixture(scope="module")
def duck(sf):
    connection = duckdb.connect()
    for name in TABLES:
        connection.execute(f"create view {name} as select * from '{sf}/{name}.parquet'")
    return connection


def plain(rows, columns):
    def value(x):
        if hasattr(x, "item"):
            x = x.item()
        return None if isinstance(x, float) and math.isnan(x) else x

    return sorted(repr(tuple(value(r[c]) for c in sorted(columns))) for r in rows)


@pytest.mark.parametrize("name", sorted(oracle_sql()))
def test_same_as_sql(spark, sf, duck, name):
    found = queries()[name](spark, sf)
    expected = duck.execute(oracle_sql()[name])
    columns = [c[0] for c in expected.description]
    assert sorted(found.columns) == sorted(columns)
    assert plain((r.asDict() for r in found.collect()), columns) == plain((dict(zip(columns, r)) for r in expected.fetchall()), columns)


@pytest.mark.parametrize("name", sorted(set(queries()) - set(oracle_sql())))
def test_gives_rows(spark, sf, name):
    assert queries()[name](spark, sf).count() > 0
