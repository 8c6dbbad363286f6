"""Sharding by a consistent-hash ring with virtual nodes and bounded loads.

Every shard stands at `replicas` points of a ring of 64-bit hashes; a row belongs to the point that its key's hash comes
to clockwise. A shard takes at most its capacity; rows that find it full go on clockwise to the next point whose shard is
not. Capacities add up to the rows, so every shard ends exactly full: counts differ by one at most.

Rows that agree in id, size and CRC are one group with a count, as any of them may take another's place. Groups are ranked
within their arc (the stretch of ring before a point) by a hash of all three, and arcs are dealt into parts by that hash, so
neither a frequent id nor a frequent row meets in one task: sums of parts give where a part's ranks begin. The arcs' counts, a
number for each point, are all that placing needs: it gives for each arc a few intervals of ranks, each with a shard and
a first slot. Groups then look up the intervals of their ranks; large ones are cut into runs first, which are dealt out.

Defined results: a null text has no bytes; a null key is a key like any other; an empty table gives an empty result; with
fewer rows than shards some shards stay empty. A text counts by size and CRC only, however long it is. The result does not depend on how the table is split.
Columns other than those named are neither read nor returned.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from strata.llm.common import documents, per_batch, ranges, release, settle

REPLICAS = 256
#: Parts of an arc, and rows of a run.
PARTS, RUN = 256, 512


def ring(shards: int, replicas: int = REPLICAS) -> tuple[np.ndarray, np.ndarray]:
    """Places of the points, ascending, and their shards. A shard's points do not depend on how many shards there are."""
    at = sorted((int.from_bytes(hashlib.md5(f"{s}:{r}".encode()).digest()[:8], "big"), s) for s in range(shards) for r in range(replicas))
    return np.array([a for a, _ in at], np.uint64), np.array([s for _, s in at], np.int64)


def capacities(rows: int, shards: int) -> list[int]:
    """The first rows % shards shards take one row more."""
    return [rows // shards + (s < rows % shards) for s in range(shards)]


def place(counts: dict[int, int], owners: np.ndarray, capacity: list[int]) -> list[tuple[int, int, int, int, int]]:
    """(arc, first rank, end rank, shard, first slot) such that no shard gets more than its capacity.

    All arcs first fill their own shard, in turn; what is left goes on, each arc's rest one point further in each round.
    """
    n = len(owners)
    load, out = [0] * len(capacity), []
    rest = {arc: (0, count) for arc, count in sorted(counts.items()) if count}
    for step in range(n + 1):
        after = {}
        for arc, (rank, end) in rest.items():
            shard = int(owners[(arc + step) % n])
            take = min(end - rank, capacity[shard] - load[shard])
            if take:
                out.append((arc, rank, rank + take, shard, load[shard]))
                load[shard] += take
            if rank + take < end:
                after[arc] = (rank + take, end)
        rest = after
        if not rest:
            return out
    raise ValueError("the capacities do not hold the rows")


def ranked(spark: SparkSession, rows: DataFrame, points: np.ndarray) -> DataFrame:
    """doc_id, size, crc, n, and arc and first rank of each group, written to the shared folder; rows: doc_id, size, crc."""
    at = spark.sparkContext.broadcast(points)
    groups = rows.groupBy("doc_id", "size", "crc").agg(F.count("*").alias("n")).withColumns({"hash": F.xxhash64("doc_id"), "order": F.xxhash64("doc_id", "size", "crc")})

    def work(batch: pa.RecordBatch) -> dict:
        place = batch.column("hash").to_numpy().view(np.uint64)
        return {c: batch.column(c) for c in ("doc_id", "size", "crc", "n", "order")} | {"arc": (np.searchsorted(at.value, place, side="left") % len(at.value)).astype(np.int32)}

    arcs = per_batch(spark, groups, "doc_id long, size long, crc long, n long, order long, arc int", work).withColumn("part", F.pmod(F.shiftrightunsigned("order", 32), F.lit(PARTS)).cast("int"))
    before = Window.partitionBy("arc", "part").orderBy("order", "doc_id", "size", "crc").rowsBetween(Window.unboundedPreceding, -1)
    inner = settle(spark, arcs.withColumn("inner", F.coalesce(F.sum("n").over(before), F.lit(0))).drop("order"), "parts")
    # a row for each part of an arc, however many rows there are
    sums = inner.groupBy("arc", "part").agg(F.sum("n").alias("total"))
    begin = sums.select("arc", "part", F.coalesce(F.sum("total").over(Window.partitionBy("arc").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("begin"))
    out = settle(spark, inner.join(begin, ["arc", "part"]).select("doc_id", "size", "crc", "n", "arc", (F.col("begin") + F.col("inner")).alias("rank")), "arcs")
    release(inner)
    return out


def sharding(spark: SparkSession, df: DataFrame, shards: int = 24, replicas: int = REPLICAS, overhead: int = 8, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row a document: its size, its shard and its slot there, gapless from 0; the law that holds is `rows`."""
    text = F.encode("text", "UTF-8")
    rows = documents(df, id_col, text_col).select(
        "doc_id",
        (F.coalesce(F.octet_length("text"), F.lit(0)) + overhead).cast("long").alias("size"),
        F.coalesce(F.crc32(text), F.lit(0)).cast("long").alias("crc"),
    )
    points, owners = ring(shards, replicas)
    arcs = ranked(spark, rows, points)
    # one number for each point of the ring, however many rows there are
    counts = dict(tuple(r) for r in arcs.groupBy("arc").agg(F.sum("n")).collect())
    parts = place(counts, owners, capacities(sum(counts.values()), shards))
    by_arc: dict[int, list] = {}
    for arc, *part in sorted(parts):
        by_arc.setdefault(arc, []).append(part)
    table = spark.sparkContext.broadcast({arc: np.array(x) for arc, x in by_arc.items()})

    run = F.explode(F.sequence(F.lit(0), F.floor((F.col("n") - 1) / RUN)))
    runs = arcs.withColumn("run", run).select("doc_id", "size", "crc", "arc", (F.col("rank") + F.col("run") * RUN).alias("rank"), F.least(F.lit(RUN), F.col("n") - F.col("run") * RUN).alias("n"))

    def work(batch: pa.RecordBatch) -> dict:
        n = batch.column("n").to_numpy()
        each = np.repeat(np.arange(len(n)), n)
        arc, rank = batch.column("arc").to_numpy()[each], ranges(batch.column("rank").to_numpy(), n)
        shard, slot = np.zeros(len(arc), np.int32), np.zeros(len(arc), np.int64)
        order = np.argsort(arc, kind="stable")
        limits = np.flatnonzero(np.diff(arc[order], prepend=-1))
        for rows in np.split(order, limits[1:]):
            part = table.value[int(arc[rows[0]])]
            which = np.searchsorted(part[:, 0], rank[rows], side="right") - 1
            shard[rows], slot[rows] = part[which, 2], part[which, 3] + rank[rows] - part[which, 0]
        place = pa.array(each)
        return {"doc_id": batch.column("doc_id").take(place), "size": batch.column("size").take(place), "text_crc32": batch.column("crc").take(place), "law": ["rows"] * len(arc), "shard": shard, "slot": slot, "grown_shard": [None] * len(arc)}

    return per_batch(spark, runs.repartition(F.xxhash64("arc", "rank")), "doc_id long, size long, text_crc32 long, law string, shard int, slot long, grown_shard int", work)
