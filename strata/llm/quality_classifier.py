"""Quality classifier: histogram gradient-boosted trees over document statistics.

Statistics of a bounded sample of labelled documents are cut into bins by quantiles; trees of fixed depth are grown level by
level on sums of gradients over bins, for the logistic loss with second-order gains. All trees are flattened into arrays, in
which a node's children stand at 2i + 1 and 2i + 2, so a batch goes down every tree by indexing alone.

Defined results: null and empty texts have the statistics of an empty text and a score like any other; a document whose
labels differ is learned from with the lesser; without labelled rows, or with one label only, every score is the share
of label 1 held within 0.01 and 0.99 (0.5 without rows); of cuts of equal gain the first by feature and limit is taken; of labelled
rows of one id one is learned from. A long text is measured by itself, whole; an empty table gives an empty result. Repeated rows give repeated results. Columns other than those
named are neither read nor returned: labels, language, source and id are no inputs of a score.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from strata.llm.common import as_bytes, documents, narrow, per_batch, runs, sums
from strata.llm.quality_rules import CLASSES, byte_counts, class_counts, duplicate_lines, repeated_words


@dataclass(frozen=True)
class Settings:
    """sample: about so many labelled rows at most are learned from."""

    sample: int = 20_000
    trees: int = 80
    depth: int = 4
    bins: int = 64
    rate: float = 0.15
    ridge: float = 1.0
    least_weight: float = 2.0
    threshold: float = 0.3


NAMES = (
    [f"share_{c}" for c in CLASSES]
    + [f"share_{chr(c)}" for c in b"#*$%&|<>!_=@/\\{}"]
    + ["log_bytes", "log_words", "word_length", "longest_word", "distinct_words", "repeated_words", "same_as_before", "duplicate_lines", "words_per_line", "most_frequent_word", "shouted_words", "marked_words", "lone_marks"]
)


def statistics(texts: list[bytes]) -> np.ndarray:
    """A row of NAMES for each text."""
    counts = byte_counts(texts)
    sizes = np.maximum(counts.sum(1), 1)[:, None]
    lists = [t.split() for t in texts]
    n = np.fromiter(map(len, lists), np.int64, len(lists))
    words = [w for x in lists for w in x]
    codes, distinct = pd.factorize(np.array(words, object)) if words else (np.zeros(0, np.int64), np.zeros(0, object))
    codes = codes.astype(np.int64)
    row = np.repeat(np.arange(len(texts)), n)
    some = np.maximum(n, 1)
    lengths = np.array([len(w) for w in distinct], np.int64)[codes]
    keys, times = np.unique(row * max(len(distinct), 1) + codes, return_counts=True)
    of = keys // max(len(distinct), 1)
    top = np.zeros(len(texts), np.int64)
    np.maximum.at(top, of, times)
    longest = np.zeros(len(texts), np.int64)
    np.maximum.at(longest, row, lengths)
    again = np.zeros(len(codes), np.int64)
    if len(codes) > 1:
        again[1:] = (codes[1:] == codes[:-1]) & (row[1:] == row[:-1])
    kind = lambda test: sums(np.array([test(w) for w in distinct], np.int64)[codes], n) / some
    lines = counts[:, 10] + 1
    more = [
        np.log1p(counts.sum(1)),
        np.log1p(n),
        sums(lengths, n) / some,
        longest,
        np.bincount(of, minlength=len(texts)) / some,
        repeated_words(codes, n) / some,
        sums(again, n) / some,
        np.array([duplicate_lines(t) for t in texts], float) / lines,
        n / lines,
        top / some,
        kind(lambda w: w.isupper() and len(w) > 1),
        kind(lambda w: w[-3:].strip(b"#*$%&!|<>") == b"" and len(w) > 3),
        kind(lambda w: w.strip(b"#*$%&!|<>-=_+") == b""),
    ]
    return np.concatenate([class_counts(counts) / sizes, counts[:, list(b"#*$%&|<>!_=@/\\{}")] / sizes, np.stack(more, 1)], 1)


@dataclass(frozen=True)
class Trees:
    """feature, limit and value of every node of every tree; a node sends a row right if its feature is above the limit."""

    feature: np.ndarray  # trees x inner nodes
    limit: np.ndarray
    value: np.ndarray  # trees x leaves
    start: float

    def score(self, x: np.ndarray) -> np.ndarray:
        """Probability of label 1 for each row."""
        total = np.full(len(x), self.start)
        rows = np.arange(len(x))
        inner = self.feature.shape[1]
        for feature, limit, value in zip(self.feature, self.limit, self.value):
            node = np.zeros(len(x), np.int64)
            while inner and node[:1].size and node[0] < inner:  # all rows are at the same level
                node = 2 * node + 1 + (x[rows, feature[node]] > limit[node])
            total += value[node - inner]
        return 1 / (1 + np.exp(-total))


def fit(x: np.ndarray, y: np.ndarray, s: Settings) -> Trees:
    share = float(np.clip(y.mean() if len(y) else 0.5, 0.01, 0.99))
    start, inner = float(np.log(share / (1 - share))), (1 << s.depth) - 1
    if not len(y) or y.min() == y.max():
        return Trees(np.zeros((0, inner), np.int64), np.zeros((0, inner)), np.zeros((0, inner + 1)), start)
    cuts = [np.unique(np.quantile(column, np.linspace(0, 1, s.bins + 1)[1:-1], method="lower")) for column in x.T]
    binned = np.stack([np.searchsorted(c, column, side="left") for c, column in zip(cuts, x.T)], 1)  # bin b: above cuts[b - 1], up to cuts[b]
    total = np.full(len(y), start)
    trees = []
    for _ in range(s.trees):
        p = 1 / (1 + np.exp(-total))
        gradient, weight = p - y, np.maximum(p * (1 - p), 1e-6)
        node = np.zeros(len(y), np.int64)
        feature, limit = np.zeros(inner, np.int64), np.full(inner, np.inf)
        for level in range(s.depth):
            first, wide = (1 << level) - 1, 1 << level
            best = np.zeros(wide)
            for f in range(x.shape[1]):
                at = (node - first) * s.bins + binned[:, f]
                g, h = (np.cumsum(np.bincount(at, w, wide * s.bins).reshape(wide, s.bins), 1) for w in (gradient, weight))
                gain = g[:, :-1] ** 2 / (h[:, :-1] + s.ridge) + (g[:, -1:] - g[:, :-1]) ** 2 / (h[:, -1:] - h[:, :-1] + s.ridge) - g[:, -1:] ** 2 / (h[:, -1:] + s.ridge)
                gain[(h[:, :-1] < s.least_weight) | (h[:, -1:] - h[:, :-1] < s.least_weight)] = 0
                gain[:, len(cuts[f]) :] = 0
                bin_, most = gain.argmax(1), gain.max(1)
                for k in np.flatnonzero(most > best + 1e-9):
                    best[k], feature[first + k], limit[first + k] = most[k], f, cuts[f][bin_[k]]
            node = 2 * node + 1 + (x[np.arange(len(y)), feature[node]] > limit[node])
        g, h = np.bincount(node - inner, gradient, inner + 1), np.bincount(node - inner, weight, inner + 1)
        value = -s.rate * g / (h + s.ridge)
        total += value[node - inner]
        trees.append((feature, limit, value))
    return Trees(*(np.array([t[k] for t in trees]) for k in range(3)), start)


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def train(spark: SparkSession, docs: DataFrame, labels: DataFrame, learn: Column, s: Settings) -> Trees:
    """docs: doc_id, text; labels: doc_id, label; learn: which ids may be learned from.

    Labelled ids are drawn by a hash so that at most about `sample` remain, which bounds what is joined by broadcast; of rows
    of one id one text counts (by its hash), which bounds what reaches the driver.
    """
    known = labels.where(learn & F.col("label").isNotNull() & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.min("label").alias("label"))
    n = known.count()
    if n > s.sample:
        known = known.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) < (1 << 30) * s.sample // n)
    drawn = docs.join(F.broadcast(known), "doc_id").groupBy("doc_id", "label").agg(F.min_by("text", F.xxhash64("text")).alias("text"))

    def work(batch: pa.RecordBatch) -> dict:
        texts = as_bytes(batch.column("text"))
        x = np.concatenate([statistics(texts[run]) for run in runs(texts)])
        return {"doc_id": batch.column("doc_id"), "label": batch.column("label"), "x": pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1, dtype=np.int32) * x.shape[1]), pa.array(x.ravel()))}

    got = per_batch(spark, drawn.select("doc_id", "text", "label"), "doc_id long, label int, x array<double>", work).toArrow()
    x = np.array([v.values.to_numpy() for v in got["x"]]).reshape(got.num_rows, len(NAMES))
    y, ids = got["label"].to_numpy().astype(float), got["doc_id"].to_numpy()
    order = np.lexsort([*x.T[::-1], ids])  # whatever the order in which rows came
    return fit(x[order], y[order], s)


SCORED = "doc_id long, held_out boolean, score double, predicted int"


def quality_classifier(spark: SparkSession, df: DataFrame, labels: DataFrame, settings: Settings | None = None, id_col: str = "doc_id", text_col: str = "text", label_id_col: str = "doc_id", label_col: str = "quality") -> DataFrame:
    """A score for each document: the probability of label 1."""
    s = settings or Settings()
    docs = documents(df, id_col, text_col)
    of = narrow(labels, doc_id=label_id_col, label=label_col).select(F.col("doc_id").cast("long").alias("doc_id"), F.col("label").cast("int").alias("label"))
    model = spark.sparkContext.broadcast(train(spark, docs, of, ~held_out(F.col("doc_id")), s))

    def work(batch: pa.RecordBatch) -> dict:
        texts = as_bytes(batch.column("text"))
        score = np.concatenate([model.value.score(statistics(texts[run])) for run in runs(texts)])
        return {"doc_id": batch.column("doc_id"), "held_out": batch.column("held_out"), "score": score, "predicted": (score >= s.threshold).astype(np.int32)}

    return per_batch(spark, docs.withColumn("held_out", held_out(F.col("doc_id"))), SCORED, work)
