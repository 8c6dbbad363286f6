"""SimHash near-duplicates by pigeonhole blocks.

Fingerprints of 64 bits are cut into blocks. Two that differ in at most `distance` bits agree on all but that many
blocks, so they share the key of some choice of the rest; keys are joined and the Hamming distance is verified.
Equal fingerprints are one class before any join. A key that more than `most` classes share is not joined with itself:
there each class goes under every value that it has after at most distance/2 flips of a bit outside the key, and two
classes link exactly if they meet at a value. All that meet there are linked through one of them, so the rows grow with
the classes and not with their pairs, and no link is lost.

Defined results: null and empty texts, and texts without a word, have fingerprint zero, and link like any other; fewer
words than a shingle has are one shingle; ties in the bits (as many ones as zeros) give 0. Rows of one
doc_id are rows of one document, and so in one component; null doc_ids never name a component, which is null where all are. An
empty table gives an empty result. A long text is worked on by itself, whole.
Columns other than those named are neither read nor returned.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from strata.llm.common import as_bytes, documents, extend, runs, settle, sums
from strata.operators.graph import components

BITS = 64


def shingles(text: bytes, width: int) -> list[bytes]:
    """Runs of `width` words of the text in lower case (A-Z), joined by spaces."""
    words = text.lower().split()  # of bytes: ASCII letters, and white space \x20 and \x09-\x0d
    if len(words) <= width:
        return [b" ".join(words)] if words else []
    return list(map(b" ".join, zip(*(words[k:] for k in range(width)))))


def fingerprint_of(hashes: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """For each text, with so many of the hashes, the bits set in over half of them."""
    ones = np.empty((len(counts), BITS), np.int64)
    bits = np.unpackbits(hashes.astype(">u8").view(np.uint8).reshape(-1, 8), axis=1)  # from the highest bit
    for k in range(BITS):
        ones[:, k] = sums(bits[:, k].astype(np.int64), counts)
    return np.packbits(2 * ones > counts[:, None], axis=1).view(">u8").ravel().astype(np.int64)


def fingerprints(column: pa.Array, width: int = 3, seed: int = 42) -> np.ndarray:
    """The fingerprint's bits of each text, as a signed integer."""
    texts = as_bytes(column)
    parts = [np.zeros(0, np.int64)]
    for run in runs(texts, 1 << 20):
        lists = [shingles(t, width) for t in texts[run]]
        counts = np.fromiter(map(len, lists), np.int64, len(lists))
        hashes = np.fromiter((xxhash.xxh64_intdigest(s, seed) for x in lists for s in x), np.uint64, int(counts.sum()))
        parts.append(fingerprint_of(hashes, counts))
    return np.concatenate(parts)


def masks(blocks: int, distance: int) -> list[int]:
    """For each choice of blocks - distance of the blocks, a mask of their bits."""
    limits = [BITS * k // blocks for k in range(blocks + 1)]
    return [sum(((1 << (limits[b + 1] - limits[b])) - 1) << limits[b] for b in chosen) for chosen in combinations(range(blocks), blocks - distance)]


def signed(x: int) -> int:
    return x - (1 << BITS) if x >= 1 << (BITS - 1) else x


def links(spark: SparkSession, classes: DataFrame, distance: int = 2, blocks: int = 4, most: int = 64) -> DataFrame:
    """Pairs u > v of class representatives such that classes at most `distance` bits apart are connected; classes: rep, fp.

    Every pair returned is within twice the flips of a common value, so within the distance.
    """
    if distance != 2 * (distance // 2):
        raise ValueError("the exact way for frequent keys needs an even distance")
    chosen = masks(blocks, distance)
    keyed = classes.select("rep", "fp", F.explode(F.array([F.struct(F.lit(i).alias("m"), F.col("fp").bitwiseAND(F.lit(signed(m))).alias("key")) for i, m in enumerate(chosen)])).alias("k")).select("rep", "fp", "k.m", "k.key")
    shared = keyed.groupBy("m", "key").agg(F.count("*").alias("n")).where("n > 1")
    known = settle(spark, keyed.join(shared, ["m", "key"]), "keys")
    few = known.where(F.col("n") <= most)
    a, b = few.select("m", "key", F.col("rep").alias("u"), F.col("fp").alias("x")), few.select("m", "key", F.col("rep").alias("v"), F.col("fp").alias("y"))
    near = a.join(b, (a.m == b.m) & (a.key == b.key) & (a.u > b.v) & (F.bit_count(a.x.bitwiseXOR(b.y)) <= distance)).select("u", "v")

    flips = _flips(distance // 2)
    inside = [F.lit(m) for m in map(signed, chosen)]
    many = known.where(F.col("n") > most)
    spread = many.select("rep", "m", F.explode(F.filter(F.array([F.struct(F.lit(f).alias("f"), F.col("fp").bitwiseXOR(F.lit(f)).alias("value")) for f in flips]), lambda s: F.get(F.array(inside), F.col("m")).bitwiseAND(s["f"]) == 0)).alias("s")).select("rep", "m", "s.value")
    met = spread.groupBy("m", "value").agg(F.min("rep").alias("v"), F.count("*").alias("n")).where("n > 1").drop("n")
    through = spread.join(met, ["m", "value"]).where("rep > v").select(F.col("rep").alias("u"), "v")
    return near.unionByName(through).distinct()


def _flips(most: int) -> list[int]:
    return [signed(sum(1 << b for b in bits)) for k in range(most + 1) for bits in combinations(range(BITS), k)]


def hex_of(fp: Column) -> Column:
    return F.lower(F.lpad(F.hex(fp), 16, "0"))


def grouped(spark: SparkSession, docs: DataFrame, distance: int, blocks: int, most: int) -> DataFrame:
    """fp and component_id, the smallest doc_id of all classes that links and shared ids reach; docs: doc_id, fp."""
    classes = settle(spark, docs.groupBy("fp").agg(F.min("doc_id").alias("least")), "classes")
    repeated = docs.where("doc_id is not null").groupBy("doc_id").agg(F.min("fp").alias("v"), F.max("fp").alias("high")).where("v < high").drop("high")
    same_id = docs.join(repeated, "doc_id").where("fp > v").select(F.col("fp").alias("u"), "v").distinct()
    near = links(spark, classes.select(F.col("fp").alias("rep"), "fp"), distance, blocks, most)
    roots = components(spark, near.unionByName(same_id))
    named = settle(spark, classes.join(roots, classes.fp == roots.node, "left").select("fp", "least", F.coalesce("root", "fp").alias("root")), "roots")
    return named.join(named.groupBy("root").agg(F.min("least").alias("component_id")), "root").select("fp", "component_id")


def simhash_dedup(spark: SparkSession, df: DataFrame, distance: int = 2, width: int = 3, blocks: int = 4, most: int = 64, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, fingerprint and component_id, the smallest doc_id that links reach."""
    made = extend(spark, documents(df, id_col, text_col), "fp long", lambda texts: {"fp": fingerprints(texts, width)}, "text")
    docs = settle(spark, made.select(F.col("_0").alias("doc_id"), "fp"), "fingerprints")
    return docs.join(grouped(spark, docs, distance, blocks, most), "fp").select("doc_id", hex_of(F.col("fp")).alias("fingerprint"), "component_id")
