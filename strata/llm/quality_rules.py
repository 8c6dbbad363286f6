"""Quality rules by distribution divergence.

A document's histogram of character classes and its histogram of common words are compared with those of each
reference language by Jensen-Shannon distance (base 2, 0 to 1). The closest language counts, so neither the declared
nor a predicted language is needed. Every language that enough rows are labelled with is a reference: its common words
are those in most of all its documents; its histograms are
means over all its documents that pass the base rule and are not far from its medians, each document weighing the same.

The limit of word distances falls with the length of a text, as a sample of few words is far from any reference by chance,
and documents with fewer words than `min_words` are never rejected for divergence.

Defined results: null text is empty text, which has no words and fails the base rule if that asks for any; a document
without any common word is at word distance 1; of equally close languages the first by name counts; words in equally
many documents are taken by name; documents labelled with a language that has no reference are judged by the base rule alone, and so is
every document where no language has one (an empty table, no labels). Texts are measured whole, a long one by itself. Repeated
rows give repeated results. Columns other than those named are neither read nor returned.
"""

from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from strata.llm.common import CACHE_ENTRIES, as_bytes, documents, extend, give_back, keep_rows, per_batch, prepare, runs, settle, sums, to_arrow

#: Classes of characters by the first byte of their UTF-8.
CLASSES = ("vowel", "consonant", "upper", "digit", "space", "newline", "stop", "quote", "symbol", "other", "two", "three", "four")


def _class_of_byte() -> np.ndarray:
    table = np.full(256, CLASSES.index("other"))
    for name, members in (("vowel", "aeiou"), ("consonant", "bcdfghjklmnpqrstvwxyz"), ("upper", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"), ("digit", "0123456789"), ("space", " \t"), ("newline", "\n\v\f\r"), ("stop", ".,;:!?"), ("quote", "'\"()-"), ("symbol", "#*$%&|<>")):
        table[list(members.encode())] = CLASSES.index(name)
    table[0x80:0xC0] = -1  # no character starts here
    table[0xC0:0xE0], table[0xE0:0xF0], table[0xF0:] = (CLASSES.index(x) for x in ("two", "three", "four"))
    return table


CLASS_OF_BYTE = _class_of_byte()
SYMBOLS = np.array(list(b"#*$%&|<>"))
WHITE = np.array(list(b" \t\n\v\f\r"))
#: Counts of words that a task hands over at once.
COUNTS_A_BATCH = 50_000
EDGES = "\"'()[]{}.,;:!?*#$%&|<>-_+=/\\~`^@"


@dataclass(frozen=True)
class Rules:
    """Limits of the verdict, and how references are learned.

    The limit of word distances is word_noise / sqrt(words), between least_word_limit and 1. least_documents: with fewer rows labelled so
    a language is no reference. learn_from is read by the SQL of the query only, which draws about twice so many documents of a language
    at most for its common words; the operator counts all.
    """

    least_words: int = 50
    most_repeated_percent: int = 50
    min_words: int = 60
    min_common: int = 12
    max_class_distance: float = 0.18
    word_noise: float = 7.0
    least_word_limit: float = 0.35
    common_words: int = 30
    learn_from: int = 2000
    least_documents: int = 20


def byte_counts(texts: list[bytes]) -> np.ndarray:
    """For each text, how often each byte value occurs."""
    return np.array([np.bincount(np.frombuffer(t, np.uint8), minlength=256) for t in texts], np.int64).reshape(len(texts), 256)


def class_counts(counts: np.ndarray) -> np.ndarray:
    return np.stack([counts[:, k == CLASS_OF_BYTE].sum(1) for k in range(len(CLASSES))], 1)


def repeated_words(codes: np.ndarray, n_words: np.ndarray) -> np.ndarray:
    """For each text, its words that lie in a window of three words found twice or more in it."""
    n = len(codes)
    if n < 3:
        return np.zeros(len(n_words), np.int64)
    text = np.repeat(np.arange(len(n_words)), n_words)
    whole = text[:-2] == text[2:]
    two, _ = pd.factorize(codes[:-1] * (codes.max() + 1) + codes[1:])
    window, _ = pd.factorize(two[:-1].astype(np.int64) * (codes.max() + 1) + codes[2:])
    at = np.flatnonzero(whole)
    twice = pd.Series(window[at].astype(np.int64) * len(n_words) + text[:-2][at]).duplicated(keep=False).to_numpy()
    inside = np.zeros(n, np.int64)
    for k in range(3):
        inside[at[twice] + k] = 1
    return sums(inside, n_words)


def duplicate_lines(text: bytes) -> int:
    """Lines with a word that equal an earlier line."""
    lines = [x for x in text.split(b"\n") if x.strip()]
    return len(lines) - len(set(lines))


def plain_word(word: bytes) -> str:
    return word.decode("utf-8", "replace").lower().strip(EDGES)


def measure(texts: list[bytes], words_of: dict[str, list[str]]) -> dict[str, np.ndarray]:
    """Base figures and histograms of some texts."""
    lists = [t.split() for t in texts]  # bytes: at \x20 and \x09-\x0d, and nowhere else
    n_words = np.fromiter(map(len, lists), np.int64, len(lists))
    codes, distinct = pd.factorize(np.array([w for ws in lists for w in ws], object)) if n_words.sum() else (np.zeros(0, np.int64), [])
    counts = byte_counts(texts)
    starts = counts.sum(1) - counts[:, 0x80:0xC0].sum(1)
    plain = [plain_word(w) for w in distinct]
    row = np.repeat(np.arange(len(texts)), n_words)
    common = []
    for words in words_of.values():
        index = {w: i for i, w in enumerate(words)}
        which = np.array([index.get(w, -1) for w in plain], np.int64)[codes] if len(codes) else np.zeros(0, np.int64)
        known = which >= 0
        common.append(np.bincount(row[known] * len(words) + which[known], minlength=len(texts) * len(words)).reshape(len(texts), len(words)))
    return {
        "n_words": n_words,
        "word_chars": starts - counts[:, WHITE].sum(1),
        "n_symbols": counts[:, SYMBOLS].sum(1),
        "n_dup_lines": np.array([duplicate_lines(t) for t in texts], np.int64),
        "n_repeat_words": repeated_words(codes.astype(np.int64), n_words),
        "classes": class_counts(counts),
        "common": np.concatenate(common, 1) if common else np.zeros((len(texts), 0), np.int64),
    }


FIGURES = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, classes array<int>, common array<int>"


def figures(column: pa.Array, rules: Rules, common: dict[str, list[str]]) -> dict:
    """Base figures and histograms of each text."""
    texts = as_bytes(column)
    parts = [measure(texts[s], common) for s in runs(texts)]
    out = {k: np.concatenate([p[k] for p in parts]) for k in parts[0]}
    out["base_failed"] = (out["n_words"] < rules.least_words) | (100 * out["n_repeat_words"] > rules.most_repeated_percent * out["n_words"])
    for k in ("classes", "common"):
        rows, cells = out[k].shape
        out[k] = pa.ListArray.from_arrays(pa.array(np.arange(rows + 1, dtype=np.int32) * cells), pa.array(out[k].ravel().astype(np.int32)))
    return out


class Plain(dict):
    """Plain forms of words, found once each."""

    def __missing__(self, word: bytes) -> str:
        if len(self) >= CACHE_ENTRIES:
            self.clear()
        self[word] = found = plain_word(word)
        return found


def document_counts(spark: SparkSession, labelled: DataFrame) -> DataFrame:
    """lang, word and n, documents with the word in some of a task's rows; labelled: lang, text. Every word of every text is counted."""
    prepare(spark)
    schema = "lang string, word string, n long"
    arrow = to_arrow(spark, schema)

    def rows(counts: dict[str, Counter]) -> Iterator[pa.RecordBatch]:
        for lang, of in counts.items():
            of.pop("", None)
            words, n = list(of), list(of.values())
            for s in range(0, len(words), COUNTS_A_BATCH):
                part = words[s : s + COUNTS_A_BATCH]
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(part)), pa.array(part, pa.string()), pa.array(n[s : s + COUNTS_A_BATCH], pa.int64())], schema=arrow)
        counts.clear()

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        plain, counts, held = Plain(), defaultdict(Counter), 0
        for batch in batches:
            for lang, text in zip(batch.column("lang").to_pylist(), as_bytes(batch.column("text"))):
                own = counts[lang]
                held -= len(own)
                own.update(set(map(plain.__getitem__, set(text.split()))))
                held += len(own)
                if held > CACHE_ENTRIES:  # what is held is handed over; its sums are made afterwards
                    yield from rows(counts)
                    held = 0
        yield from rows(counts)
        plain.clear()
        give_back()

    return labelled.select("lang", "text").mapInArrow(each, schema)


def learn_words(spark: SparkSession, docs: DataFrame, rules: Rules) -> dict[str, list[str]]:
    """Each language's common words, of most of all its documents first; docs: doc_id, text, lang. What reaches the driver: a count and the words of a language."""
    labelled = docs.where("lang is not null")
    langs = sorted(r["lang"] for r in labelled.groupBy("lang").agg(F.count("*").alias("n")).where(F.col("n") >= rules.least_documents).collect())
    if not langs:
        return {}
    order = Window.partitionBy("lang").orderBy(F.desc("n"), "word")
    totals = document_counts(spark, labelled.where(F.col("lang").isin(langs))).groupBy("lang", "word").agg(F.sum("n").alias("n"))
    top = totals.withColumn("nth", F.row_number().over(order)).where(F.col("nth") <= rules.common_words)
    out: dict[str, list[str]] = {lang: [] for lang in langs}
    for r in sorted(top.collect(), key=lambda r: r["nth"]):
        out[r["lang"]].append(r["word"])
    return out


def references(spark: SparkSession, table: DataFrame, rules: Rules, common: dict[str, list[str]]) -> dict[str, tuple[np.ndarray, np.ndarray]]:
    """For each known language, the mean shares of classes and of its common words over its documents that pass.

    Documents whose classes are far from every language's medians are left out, so that junk does not shape what it is
    compared with. Each batch gives a few sums a language; the languages and words bound what reaches the driver.
    """
    return _means(spark, table, rules, common, _medians(table, common))


def _medians(table: DataFrame, common: dict[str, list[str]]) -> dict:
    """Median share of each class, made to add up to one; no common words."""
    passing = table.where(~F.col("base_failed") & F.col("lang").isin([*common]))
    whole = F.greatest(F.aggregate("classes", F.lit(0), lambda a, x: a + x), F.lit(1))
    rows = passing.groupBy("lang").agg(*[F.percentile_approx(F.col("classes")[i] / whole, 0.5).alias(f"c{i}") for i in range(len(CLASSES))]).collect()
    out = {}
    for r in rows:
        middle = np.array([r[f"c{i}"] for i in range(len(CLASSES))], float)
        out[r["lang"]] = (middle / max(middle.sum(), 1e-9), np.zeros(len(common[r["lang"]])))
    return out


def _means(spark: SparkSession, table: DataFrame, rules: Rules, common: dict[str, list[str]], before: dict) -> dict:
    names = [*common]

    def work(batch: pa.RecordBatch) -> dict:
        classes, found = wide(batch, "classes"), wide(batch, "common")
        lang = np.array([names.index(x) if x in common else -1 for x in batch.column("lang").to_pylist()])
        good = ~batch.column("base_failed").to_numpy(zero_copy_only=False) & (lang >= 0)
        good &= ~odd(batch.column("n_words").to_numpy(), *divergence(classes, found, before, common)[1:], rules)
        cells: list[tuple[str, int, float]] = []
        offset = 0
        for k, (name, words) in enumerate(common.items()):
            own, of = found[good & (lang == k), offset : offset + len(words)], shares(classes[good & (lang == k)])
            offset += len(words)
            enough = own.sum(1) >= rules.min_common
            both = [float(len(of)), float(enough.sum()), *of.sum(0), *shares(own[enough]).sum(0)]
            cells += [(name, i, x) for i, x in enumerate(both) if len(of)]
        return {"lang": [c[0] for c in cells], "cell": [c[1] for c in cells], "x": [c[2] for c in cells]}

    rows = per_batch(spark, table, "lang string, cell int, x double", work).groupBy("lang", "cell").agg(F.sum("x").alias("x")).collect()
    out = {}
    for name in names:
        x = dict((r["cell"], r["x"]) for r in rows if r["lang"] == name)
        if x:
            at = np.array([x[i] for i in range(len(x))])
            out[name] = (at[2 : 2 + len(CLASSES)] / at[0], at[2 + len(CLASSES) :] / max(at[1], 1.0))
    return out


def wide(batch: pa.RecordBatch, column: str) -> np.ndarray:
    return batch.column(column).flatten().to_numpy().reshape(batch.num_rows, -1).astype(float)


def shares(counts: np.ndarray) -> np.ndarray:
    return counts / np.maximum(counts.sum(1, keepdims=True), 1)


def odd(n_words: np.ndarray, by_class: np.ndarray, by_word: np.ndarray, rules: Rules) -> np.ndarray:
    limit = np.clip(rules.word_noise / np.sqrt(np.maximum(n_words, 1)), rules.least_word_limit, 0.999)
    return (n_words >= rules.min_words) & ((by_class > rules.max_class_distance) | (by_word > limit))


def distance(shares: np.ndarray, reference: np.ndarray) -> np.ndarray:
    """Jensen-Shannon distance, base 2, of each row from the reference."""
    middle = (shares + reference) / 2
    with np.errstate(divide="ignore", invalid="ignore"):
        left = np.where(shares > 0, shares * np.log2(shares / middle), 0.0).sum(-1)
        right = np.where(reference > 0, reference * np.log2(reference / middle), 0.0).sum(-1)
    return np.sqrt(np.clip((left + right) / 2, 0.0, 1.0))


def divergence(classes: np.ndarray, found: np.ndarray, refs: dict, common: dict[str, list[str]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of the closest language: its place among refs, the distance of classes, and that of its common words (0 if the reference has none)."""
    n = len(classes)
    if not refs or not n:
        return np.full(n, -1), np.zeros(n), np.zeros(n)
    by_class, by_word, offset = [], [], 0
    for lang, words in common.items():
        own = found[:, offset : offset + len(words)]
        offset += len(words)
        if lang in refs:
            by_class.append(distance(shares(classes), refs[lang][0]))
            apart = np.where(own.sum(1) > 0, distance(shares(own), refs[lang][1]), 1.0)
            by_word.append(apart if refs[lang][1].sum() > 0 else np.zeros(n))
    by_class, by_word = np.stack(by_class, 1), np.stack(by_word, 1)
    best = np.argmin(by_class + by_word, 1)
    return best, by_class[np.arange(n), best], by_word[np.arange(n), best]


def judged(labels: list, refs: dict) -> np.ndarray:
    """Whether references may reject a document with the label."""
    return np.array([x is None or str(x) in refs for x in labels], bool)


#: For the pipeline: a document is not rejected for being short, and short ones are not judged by histograms. On sf0.1 the largest word distances of the
#: documents that the other rules keep are 0.77 at 60 to 80 words, 0.64 at 80 to 120, 0.56 at 120 to 200, 0.42 at 200 to 400 and 0.31 beyond.
KEEP_SHORT = Rules(least_words=1)

VERDICT = "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, closest string, class_distance double, word_distance double"


def quality_rules(spark: SparkSession, df: DataFrame, rules: Rules | None = None, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """One row a document: its base figures, its distances from the closest language, and whether it is kept.

    Texts are measured once; what is measured of them is written to the shared folder, and both the references and the
    verdicts come from there.
    """
    rules = rules or Rules()
    docs = documents(df, id_col, text_col, lang=lang_col).withColumn("lang", F.col("lang").cast("string"))
    common = learn_words(spark, docs, rules)
    measured = extend(spark, docs, FIGURES, lambda texts: figures(texts, rules, common), "text")
    table = settle(spark, measured.drop("_1").withColumnsRenamed({"_0": "doc_id", "_2": "lang"}), "figures")
    refs = references(spark, table, rules, common)
    langs = [*refs]

    def work(batch: pa.RecordBatch) -> dict:
        best, by_class, by_word = divergence(wide(batch, "classes"), wide(batch, "common"), refs, common)
        failed = batch.column("base_failed").to_numpy(zero_copy_only=False)
        strange = odd(batch.column("n_words").to_numpy(), by_class, by_word, rules) & judged(batch.column("lang").to_pylist(), refs)
        return {c: batch.column(c) for c in ("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")} | {"kept": ~failed & ~strange, "closest": [langs[b] if b >= 0 else None for b in best], "class_distance": by_class, "word_distance": by_word}

    return per_batch(spark, table, VERDICT, work)


def keep_by_rules(spark: SparkSession, df: DataFrame, rules: Rules | None = None, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """The rows of df that the rules keep; all columns stay.

    Texts are measured twice, for the references and for the verdicts: what is measured goes to the shared folder, texts do not, which
    saves writing (or shuffling) them once more.
    """
    rules = rules or Rules()
    docs = documents(df, id_col, text_col, lang=lang_col).withColumn("lang", F.col("lang").cast("string"))
    common = learn_words(spark, docs, rules)
    measured = extend(spark, docs.select("lang", "text"), FIGURES, lambda texts: figures(texts, rules, common), "text")
    table = settle(spark, measured.select(F.col("_0").alias("lang"), "n_words", "base_failed", "classes", "common"), "figures")
    refs = references(spark, table, rules, common)

    def good(column: pa.Array, labels: pa.Array) -> np.ndarray:
        own = figures(column, rules, common)
        rows = pa.RecordBatch.from_arrays([own["classes"], own["common"]], ["classes", "common"])
        _, by_class, by_word = divergence(wide(rows, "classes"), wide(rows, "common"), refs, common)
        return ~own["base_failed"] & ~(judged(labels.to_pylist(), refs) & odd(own["n_words"], by_class, by_word, rules))

    return keep_rows(spark, df, good, text_col, lang_col)
