"""Networks and scores made from the star-schema tables."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strata.tables import workers_see_package

#: Rows or pairs that are worked on at once, besides those of one order or supplier.
AT_ONCE = 400_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def co_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(u, v, n): orders that two suppliers share, both ways. An order has a few lines, which bounds its pairs."""
    own = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("o"), F.col("l_suppkey").alias("s")).distinct()
    return own.alias("a").join(own.alias("b"), "o").where("a.s <> b.s").groupBy(F.col("a.s").alias("u"), F.col("b.s").alias("v")).agg(F.count("*").alias("n"))


def supplier_network(spark: SparkSession, sf_dir: str, partners: int = 3) -> DataFrame:
    """(u, v): each supplier and the partners with which it shares most orders (of those, the lowest), as distinct unordered pairs.

    Pairs of one order's suppliers are by far the most rows here: they are made, counted and ranked in arrays, and travel as a list a supplier.
    An order has a few lines, which bounds its pairs.
    """
    workers_see_package(spark)
    lines = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("o"), F.col("l_suppkey").alias("s")).dropna()
    kind = lines.schema["s"].dataType
    pairs = lines.select("o", F.col("s").cast("bigint").alias("s")).repartition("o").sortWithinPartitions("o").mapInArrow(co_suppliers, "u bigint, v array<bigint>")
    most = pairs.repartition("u").sortWithinPartitions("u").mapInArrow(lambda batches: most_shared(batches, partners), "u bigint, v bigint")
    return most.select(F.least("u", "v").cast(kind).alias("u"), F.greatest("u", "v").cast(kind).alias("v")).distinct()


def _gathered(batches: Iterator[pa.RecordBatch], weight) -> Iterator[pa.Table]:
    """Tables of AT_ONCE or a little more by weight, or of one value of the first column, which is in order; they are cut where it changes."""
    held, size, enough = [], 0, AT_ONCE
    for batch in batches:
        held.append(batch)
        size += weight(batch)
        if size >= enough:
            whole = pa.Table.from_batches(held)
            key = whole.column(0).to_numpy()
            cut = int(np.searchsorted(key, key[-1]))
            if cut:
                yield whole.slice(0, cut)
            held = whole.slice(cut).combine_chunks().to_batches()
            size = sum(map(weight, held))
            enough = max(AT_ONCE, 2 * size)
    if size:
        yield pa.Table.from_batches(held)


def co_suppliers(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(o, s) in order of o -> (u, v): suppliers and lists of those on the same orders, once an order."""
    for lines in _gathered(batches, len):
        o, s = lines.column("o").to_numpy(), lines.column("s").to_numpy()
        order = np.lexsort((s, o))
        o, s = o[order], s[order]
        once = np.r_[True, (o[1:] != o[:-1]) | (s[1:] != s[:-1])]
        o, s = o[once], s[once]
        first = np.flatnonzero(np.r_[True, o[1:] != o[:-1]])
        size = np.diff(np.r_[first, len(o)])
        own, first, others = np.arange(len(o)) - np.repeat(first, size), np.repeat(first, size), np.repeat(size - 1, size)
        by = np.argsort(s, kind="stable")
        ends = np.cumsum(others[by])
        for part in np.split(by, np.searchsorted(ends, np.arange(AT_ONCE * 4, ends[-1], AT_ONCE * 4))):
            n = others[part]
            if not n.sum():
                continue
            nth = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            v = s[np.repeat(first[part], n) + nth + (nth >= np.repeat(own[part], n))]
            u = s[part]
            heads = np.flatnonzero(np.r_[True, u[1:] != u[:-1]])
            cuts = np.r_[0, np.cumsum(n)][np.r_[heads, len(u)]]
            yield pa.RecordBatch.from_arrays([pa.array(u[heads]), pa.ListArray.from_arrays(pa.array(cuts, pa.int32()), pa.array(v))], ["u", "v"])


def most_shared(batches: Iterator[pa.RecordBatch], partners: int) -> Iterator[pa.RecordBatch]:
    """(u, v) with lists v, in order of u -> (u, v): the partners found most often, of those the lowest."""
    for pairs in _gathered(batches, lambda b: len(b) + len(b.column(1).flatten())):
        lists = pairs.column("v").combine_chunks()
        lists = pa.concat_arrays(lists.chunks) if isinstance(lists, pa.ChunkedArray) else lists
        names, u = np.unique(np.repeat(pairs.column("u").to_numpy(), lists.value_lengths().to_numpy()), return_inverse=True)
        v = lists.flatten().to_numpy()
        if not len(v):
            continue
        others = None
        if int(v.max()) - int(v.min()) >= 2**31:
            others, v = np.unique(v, return_inverse=True)
        low = 0 if others is not None else v.min()
        width = int(v.max() - low) + 1
        key = np.sort(u * width + (v - low))
        first = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
        n = np.diff(np.r_[first, len(key)])
        u, v = np.divmod(key[first], width)
        most = int(n.max())
        if len(names) * (most + 1) * width < 2**63:
            u, v = np.divmod(np.sort((u * (most + 1) + most - n) * width + v), width)
            u //= most + 1
        else:
            order = np.lexsort((v, -n, u))
            u, v = u[order], v[order]
        best = np.arange(len(u)) - np.searchsorted(u, u) < partners
        v = v[best] + low if others is None else others[v[best]]
        yield pa.RecordBatch.from_arrays([pa.array(names[u[best]]), pa.array(v)], ["u", "v"])


def nation_trade(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(u, v, w): order lines from suppliers of nation u for customers of nation v."""
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_suppkey")
    supplier = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("l_suppkey"), F.col("s_nationkey").alias("u"))
    customer = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("o_custkey"), F.col("c_nationkey").alias("v"))
    orders = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("l_orderkey"), "o_custkey").join(customer, "o_custkey")
    return lines.join(supplier, "l_suppkey").join(orders, "l_orderkey").where("u <> v").groupBy("u", "v").agg(F.count("*").alias("w"))


def _cents():
    return F.sum(F.round(F.col("l_extendedprice") * (1 - F.col("l_discount")) * 100).cast("bigint")).alias("score")


def supplier_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(label, node, score): revenue of each supplier in cents, by return flag."""
    return table(spark, sf_dir, "lineitem").groupBy(F.col("l_returnflag").alias("label"), F.col("l_suppkey").alias("node")).agg(_cents())


def nation_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(node, score): revenue of each nation's suppliers in cents."""
    supplier = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("l_suppkey"), F.col("s_nationkey").alias("node"))
    return table(spark, sf_dir, "lineitem").join(supplier, "l_suppkey").groupBy("node").agg(_cents())
