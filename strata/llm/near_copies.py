"""Near copies at a word-shingle similarity of 0.8: majority bits first, minima for what they cannot see.

The near-dedup of simhash_dedup.py comes first, on shingles of five words: 64 majority bits, blocks, their join and the
Hamming distance, at two bits. Majority bits alone cannot give that similarity its results: at 0.8 they
differ in about 10 of 64 places, and blocks that let so much pass join everything with everything. So a second fingerprint
is made of minima: of BANDS * ROWS hash functions the least values over a text's set of shingles. A
block is ROWS minima; a pair at 0.8 shares none with a probability of (1 - 0.8^ROWS)^BANDS, 3e-6. The distance counts
minima whose two lowest bits differ; a pair at 0.8 has more than FAR of them with 1e-5. All pairs of either kind are verified
on their whole sets, so no link is wrong; linked texts are one group, copies of copies included.

Equal sets are one class before any join. In a block's bucket every class is compared with a few leaders, the classes with
the least hashes (all, if the bucket is small). Buckets that are not one group then are put together by their main group, and only classes
outside it are compared on: with GROWTH times as many leaders in each turn, until all have led, the sets being compared
where they meet. So each pair that shares a block is compared or already linked by others, whatever the bucket's size; rows are
linear in the classes, and a crowd costs comparisons in proportion to its size times its classes outside the main group.

Defined results: null and empty texts, and texts without a word, have equal sets; fewer words than a shingle has are one
shingle. Of a group the row with the smallest doc_id stays (null after all others, ties by place in the table); rows of
one doc_id are judged by their texts like any others. An empty table gives an empty result. Long texts are hashed in
windows. Columns other than those named are carried and not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from strata.llm.common import as_bytes, extend, place_of, release, runs, settle
from strata.llm.shingles import shingle_hashes
from strata.llm.simhash_dedup import BITS, links
from strata.operators.graph import components

BANDS, ROWS = 24, 4
#: Of BANDS * ROWS = 96 pairs of bits, a pair at 0.8 differs in 14.4 on average, with a standard deviation of 3.5.
FAR = 31
FIRST, GROWTH = 4, 4
#: Classes of a lot, and lots that a crowd is dealt into at most; beyond that Spark splits skewed partitions.
LOT, LOTS = 256, 16
MIX = np.random.default_rng(42).integers(0, 1 << 63, BANDS * ROWS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
CHAIN = np.uint64(0x9E3779B97F4A7C15)
WORDS = BANDS * ROWS // 32
MARKS = [f"s{k}" for k in range(WORDS)]
SKETCH = "fp long, n long, majority long, bands array<long>, " + ", ".join(f"{m} long" for m in MARKS)


def sets_of(texts: list[bytes], width: int) -> list[np.ndarray]:
    """Sorted distinct hashes of each text's shingles."""
    return distinct(*shingle_hashes(texts, width))


def distinct(hashes: np.ndarray, counts: np.ndarray) -> list[np.ndarray]:
    ends = np.cumsum(counts)
    return [np.unique(hashes[a:b]) for a, b in zip(ends - counts, ends)]


def majority(hashes: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """simhash_dedup.fingerprint_of(), a bit at a time, which holds less of a long text at once; counts are above zero."""
    starts = np.cumsum(counts) - counts
    out = np.zeros(len(counts), np.uint64)
    for k in range(BITS):
        ones = np.add.reduceat(hashes >> np.uint64(k) & np.uint64(1), starts).astype(np.int64)
        out |= (2 * ones > counts).astype(np.uint64) << np.uint64(k)
    return out


def sketches(column: pa.Array, width: int) -> dict:
    """Hash of each text's set, its size, its majority bits, its blocks, and two bits of each minimum."""
    texts = as_bytes(column)
    parts: dict[str, list[np.ndarray]] = {"fp": [], "n": [], "majority": [], "bands": [], **{m: [] for m in MARKS}}
    for run in runs(texts, 1 << 20):
        hashes, counts = shingle_hashes(texts[run], width)
        sets = distinct(hashes, counts)
        parts["majority"].append(majority(hashes, counts))
        n = np.array([len(s) for s in sets], np.int64)
        whole, starts = np.concatenate(sets), np.cumsum(n) - n
        band = np.repeat(np.arange(BANDS, dtype=np.uint64)[None, :], len(sets), 0)
        mark = np.zeros((len(sets), WORDS), np.uint64)
        for k, mix in enumerate(MIX):
            least = np.minimum.reduceat(whole * mix, starts)
            band[:, k // ROWS] = (band[:, k // ROWS] + least) * CHAIN
            mark[:, k // 32] |= (least >> np.uint64(20) & np.uint64(3)) << np.uint64(2 * (k % 32))
        parts["fp"].append(np.array([xxhash.xxh64_intdigest(s.tobytes()) for s in sets], np.uint64))
        parts["n"].append(n)
        parts["bands"].append((band ^ (band >> np.uint64(29))).ravel())
        for k, m in enumerate(MARKS):
            parts[m].append(mark[:, k])
    made = {name: np.concatenate(x).view(np.int64) if x else np.zeros(0, np.int64) for name, x in parts.items()}
    rows = len(made["n"])
    made["bands"] = pa.ListArray.from_arrays(pa.array(np.arange(rows + 1, dtype=np.int32) * BANDS), pa.array(made["bands"]))
    return made


def distance(a: str, b: str) -> Column:
    """Of two aliases' marks, how many pairs of bits differ."""
    apart = [F.col(f"{a}.{m}").bitwiseXOR(F.col(f"{b}.{m}")) for m in MARKS]
    each = [F.bit_count(x.bitwiseOR(F.shiftrightunsigned(x, 1)).bitwiseAND(F.lit(0x5555555555555555))) for x in apart]
    return sum(each[1:], each[0])


def bucketed(spark: SparkSession, classes: DataFrame) -> DataFrame:
    """key, size and the classes of every block that more than one class has; h: a class's hash, by which it leads."""
    keyed = classes.select("fp", F.explode("bands").alias("key"))
    shared = keyed.groupBy("key").agg(F.count("*").alias("size")).where("size > 1")
    known = keyed.join(shared, "key").join(classes.select("fp", "n", *MARKS), "fp")
    return settle(spark, known.withColumn("h", F.shiftrightunsigned(F.xxhash64("fp"), 1).cast("double") / F.lit(2.0**63)), "buckets")


def may_link(least: int) -> Column:
    """Of aliases x and y: their sizes allow the similarity, and their fingerprints are near."""
    return (F.least("x.n", "y.n") * 100 >= F.greatest("x.n", "y.n") * least) & (distance("x", "y") <= FAR)


def candidates(spark: SparkSession, buckets: DataFrame, first: int, least: int) -> DataFrame:
    """Distinct pairs fp_a < fp_b of a class and a leader of its bucket that may be similar."""
    x, y = buckets.alias("x"), buckets.where(F.col("h") < first / F.col("size")).alias("y")
    after = (F.col("y.h") < F.col("x.h")) | (F.col("y.h") == F.col("x.h")) & (F.col("y.fp") < F.col("x.fp"))
    met = x.join(y, (F.col("x.key") == F.col("y.key")) & after & may_link(least))
    return settle(spark, met.select(F.least("x.fp", "y.fp").alias("fp_a"), F.greatest("x.fp", "y.fp").alias("fp_b")).distinct(), "pairs")


def close(spark: SparkSession, classes: DataFrame) -> DataFrame:
    """Pairs fp_a < fp_b of classes that the near-dedup operator links: majority bits that differ in two places at most."""
    return links(spark, classes.select(F.col("fp").alias("rep"), F.col("majority").alias("fp"))).select(F.col("v").alias("fp_a"), F.col("u").alias("fp_b"))


def fetch(spark: SparkSession, docs: DataFrame, text: str, classes: DataFrame, wanted: DataFrame, width: int) -> DataFrame:
    """fp and set of classes, each from its first row's text; wanted: fp. Texts are shuffled at every size alike, so that disk grows as the input does."""
    ids = classes.select("fp", F.col("first.uid").alias("uid")).join(wanted, "fp", "left_semi").select("uid")
    texts = docs.select("uid", "fp", text).join(ids.hint("merge"), "uid", "left_semi").select("fp", text)
    made = extend(spark, texts, "words array<long>", lambda column: {"words": pa.array([s.view(np.int64) for s in hashed(column, width)], pa.list_(pa.int64()))}, text)
    return settle(spark, made.select(F.col("_0").alias("fp"), "words"), "sets")


def hashed(column: pa.Array, width: int) -> list[np.ndarray]:
    texts = as_bytes(column)
    return [s for run in runs(texts, 1 << 20) for s in sets_of(texts[run], width)]


def similar(least: int, a: str, b: str) -> Column:
    """Of the columns of two sets: their Jaccard similarity is `least` percent or more."""
    return (100 + least) * F.size(F.array_intersect(a, b)) >= least * (F.size(a) + F.size(b))


def verified(spark: SparkSession, pairs: DataFrame, sets: DataFrame, least: int) -> DataFrame:
    """u and v of the pairs that are similar."""
    both = pairs.join(sets.select(F.col("fp").alias("fp_a"), F.col("words").alias("a")), "fp_a").join(sets.select(F.col("fp").alias("fp_b"), F.col("words").alias("b")), "fp_b")
    return settle(spark, both.where(similar(least, "a", "b")).select(F.col("fp_a").alias("u"), F.col("fp_b").alias("v")), "near")


def rooted(rows: DataFrame, roots: DataFrame) -> DataFrame:
    return rows.join(roots.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))


def with_main(rows: DataFrame) -> DataFrame:
    """Rows of the keys that hold more than one group, with `main`, the group that most rows of the key are in."""
    counts = rows.groupBy("key", "root").agg(F.count("*").alias("c"))
    main = counts.groupBy("key").agg(F.max_by("root", F.struct("c", "root")).alias("main"), F.count("*").alias("groups")).where("groups > 1").drop("groups")
    return rows.join(main, "key")


def crowds(spark: SparkSession, buckets: DataFrame, roots: DataFrame, first: int) -> DataFrame:
    """What is left to compare: buckets that are larger than `first` and not one group, those of one main group put together."""
    left = with_main(rooted(buckets.where(F.col("size") > first).select("key", "fp"), roots)).select(F.col("main").alias("key"), "fp").distinct()
    sizes = left.groupBy("key").agg(F.count("*").alias("size"))
    return settle(spark, left.join(sizes, "key").join(buckets.select("fp", "n", "h", *MARKS).distinct(), "fp"), "crowds")


def turn(spark: SparkSession, crowd: DataFrame, roots: DataFrame, before: int, until: int, least: int) -> DataFrame:
    """u and v, similar: a leader of this turn and a class outside the main group, of different groups; crowd: key, fp, size, n, h, marks, words."""
    now = settle(spark, with_main(rooted(crowd, roots)), "turn")
    lots = F.least(F.lit(LOTS), F.ceil(F.col("size") / LOT)).cast("int")  # a crowd is dealt into lots, each of which meets all leaders
    x = now.where("root <> main").withColumn("lot", F.floor(F.col("h") * lots).cast("int")).alias("x")
    y = now.where((F.col("h") >= before / F.col("size")) & (F.col("h") < until / F.col("size"))).withColumn("lot", F.explode(F.sequence(F.lit(0), lots - 1))).alias("y")
    found = x.join(y, (F.col("x.key") == F.col("y.key")) & (F.col("x.lot") == F.col("y.lot")) & (F.col("x.root") != F.col("y.root")) & may_link(least) & similar(least, "x.words", "y.words"))
    out = settle(spark, found.select(F.col("x.fp").alias("u"), F.col("y.fp").alias("v")).distinct(), "near")
    release(now)
    return out


def grouped(spark: SparkSession, docs: DataFrame, text: str, width: int, least: int, first: int = FIRST, growth: int = GROWTH) -> DataFrame:
    """fp, first and root of each class of equal sets; docs: uid, key, fp, n, majority, bands, marks and the text."""
    order = F.struct(F.isnull("key").alias("without"), "key", "uid")
    same = [F.any_value(c).alias(c) for c in ("n", "bands", *MARKS)]
    same.append(F.min("majority").alias("majority"))  # equal sets may repeat shingles in other numbers
    classes = settle(spark, docs.groupBy("fp").agg(F.min(order).alias("first"), *same), "classes")
    buckets = bucketed(spark, classes)
    met = candidates(spark, buckets, first, least)
    pairs = settle(spark, met.unionByName(close(spark, classes)).distinct(), "pairs")
    release(met)
    # what pairs need now and crowds may need later: texts are fetched once
    wanted = pairs.select(F.explode(F.array("fp_a", "fp_b")).alias("fp")).unionByName(buckets.where(F.col("size") > first).select("fp")).distinct()
    sets = fetch(spark, docs, text, classes, wanted, width)
    linked = [verified(spark, pairs, sets, least)]
    roots = settle(spark, components(spark, linked[0]), "roots")

    left = crowds(spark, buckets, roots, first)
    release(buckets, pairs)
    most = left.agg(F.max("size")).first()[0] or 0
    if most:
        with_sets = settle(spark, left.join(sets, "fp"), "crowds")
        release(left)
        left = with_sets
    release(sets)
    before, until = 0, first * growth
    while before < most:
        linked.append(turn(spark, left, roots, before, until, least))
        near = linked[0]
        for more in linked[1:]:
            near = near.unionByName(more)
        old, roots = roots, settle(spark, components(spark, near), "roots")
        release(old)
        before, until = until, until * growth
    release(left, *linked)
    return classes.join(roots, classes.fp == roots.node, "left").select("fp", "first", F.coalesce("root", "fp").alias("root"))


def keep_one_of_similar(spark: SparkSession, df: DataFrame, least: int = 80, width: int = 5, id_col: str = "doc_id", text_col: str = "text", first: int = FIRST, growth: int = GROWTH) -> DataFrame:
    """The rows of df that are the first of their group. All columns stay."""
    key, text = f"_{place_of(df, id_col)}", f"_{place_of(df, text_col)}"
    made = extend(spark, df, SKETCH, lambda texts: sketches(texts, width), text_col)
    docs = settle(spark, made.withColumns({"key": F.col(key).cast("long"), "uid": F.monotonically_increasing_id()}), "sketches")
    named = grouped(spark, docs, text, width, least, first, growth)
    kept = named.groupBy("root").agg(F.min("first").alias("first")).select(F.col("first.uid").alias("uid"))
    return docs.join(kept.hint("merge"), "uid", "left_semi").select(*[f"_{i}" for i in range(len(df.columns))]).toDF(*df.columns)
