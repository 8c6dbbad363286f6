"""Language identification by string kernels.

The kernel of two texts counts the character n-grams of 1 to `longest` that both have (presence, a blended spectrum),
over n-grams hashed to `cells`, divided by the root of both texts' own counts. A bounded sample of labelled texts trains
it: some of them are landmarks, whose kernel matrix whitens all others' kernels with them (Nystroem), and kernel ridge
regression is solved one language against the rest. A batch is scored by matrix products: presence with the landmarks'
presence, whitened, with the weights; the last two are multiplied once, as nothing stands between.

Texts are read whole, in lower case, with everything but letters as one space.

Defined results: null texts and texts without a letter are `und` with score 0; so is every text if no row is labelled
(an empty table, which gives an empty result). A long text is read whole, by itself. Ties go to the first language by name. Repeated rows give repeated results; labels that are null are
not learned. Columns other than those named are neither read nor returned; language, source and id play no part in a score.
"""

from __future__ import annotations

import functools
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from strata.functions.blas import one_thread
from strata.llm.common import as_texts, documents, keep_rows, per_batch, runs

UNKNOWN = "und"


@dataclass(frozen=True)
class Settings:
    """per_language and texts: at most so many texts of each language are learned from, and of all together; every language is learned."""

    longest: int = 3
    cells: int = 1 << 15
    per_language: int = 400
    texts: int = 12_800
    landmarks_per_language: int = 48
    landmarks: int = 1536
    ridge: float = 1.0
    sharpness: float = 6.0


@functools.cache
def letters() -> np.ndarray:
    """For each code point, itself if it is a letter, else 0."""
    return np.array([i if chr(i).isalpha() else 0 for i in range(0x110000)], np.uint32)


def presence(texts: list[str], s: Settings) -> np.ndarray:
    """For each text, 1 in the cells of its n-grams. A text without a letter has none."""
    out = np.zeros((len(texts), s.cells), np.uint8)
    if not texts:
        return out
    lower = [t.lower() for t in texts]
    sizes = np.fromiter(map(len, lower), np.int64, len(lower)) + 1
    points = letters()[np.frombuffer("\0".join([*lower, ""]).encode("utf-32-le", "surrogatepass"), np.uint32)]
    row = np.repeat(np.arange(len(texts)), sizes)
    # one space after each word
    keep = points > 0
    keep[1:] |= points[:-1] > 0
    points, row = points[keep].astype(np.uint64), row[keep]
    shift = np.uint64(64 - (s.cells - 1).bit_length())
    code = np.zeros(len(points), np.uint64)
    flat = out.ravel()
    for n in range(1, s.longest + 1):
        code = (code[: len(points) - n + 1] if n == 1 else code[:-1]) * np.uint64(0x9E3779B97F4A7C15) + points[n - 1 :] + np.uint64(n)
        cell = ((code * np.uint64(0xD6E8FEB86659FD93)) >> shift).astype(np.int64)
        ok = row[: len(cell)] == row[n - 1 :] if n > 1 else points > 0
        flat[(row[: len(cell)] * s.cells + cell)[ok]] = 1
    out[np.bincount(row, points, len(texts)) == 0] = 0
    return out


@dataclass(frozen=True)
class Model:
    languages: list[str]
    weights: np.ndarray  # cells x languages
    offsets: np.ndarray
    settings: Settings

    def score(self, texts: list[str]) -> tuple[list[str], np.ndarray]:
        """The likeliest language of each text, and a softmax of the regressions for it."""
        if not self.languages:
            return [UNKNOWN] * len(texts), np.zeros(len(texts))
        x = presence(texts, self.settings)
        own = x.sum(1, dtype=np.int64)
        found = np.concatenate([x[a : a + 64].astype(np.float32) @ self.weights for a in range(0, len(x), 64)]) / np.sqrt(np.maximum(own, 1))[:, None] + self.offsets
        high = np.exp(self.settings.sharpness * (found - found.max(1, keepdims=True)))
        best = np.argmax(found, 1)
        return [self.languages[b] if n else UNKNOWN for b, n in zip(best, own)], np.where(own > 0, 1 / high.sum(1), 0.0)


def fit(cells: list[np.ndarray], names: list[str], s: Settings) -> Model:
    """cells: the cells present in each text; names: their languages; both in an order that does not matter to texts."""
    languages = sorted(set(names))
    if not languages:
        return Model([], np.zeros((s.cells, 0), np.float32), np.zeros(0), s)
    own = max(1, min(s.landmarks_per_language, s.landmarks // len(languages)))
    chosen = [i for lang in languages for i in [k for k, x in enumerate(names) if x == lang][:own]]

    def dense(rows: list[int]) -> np.ndarray:
        out = np.zeros((len(rows), s.cells), np.float32)
        for i, k in enumerate(rows):
            out[i, cells[k]] = 1
        return out

    norm = np.sqrt(np.array([len(c) for c in cells], float))
    marks = dense(chosen) / norm[chosen][:, None].astype(np.float32)
    kernel = np.concatenate([dense([*range(a, min(a + 128, len(cells)))]) @ marks.T for a in range(0, len(cells), 128)]) / norm[:, None]
    with one_thread():
        values, vectors = np.linalg.eigh(kernel[chosen])
    good = values > 1e-6 * values.max()
    whiten = vectors[:, good] / np.sqrt(values[good])
    mapped = kernel @ whiten
    target = np.where(np.array(names)[:, None] == np.array(languages), 1.0, -1.0)
    middle = mapped.mean(0)
    share = np.array([names.count(lang) for lang in languages]) / len(names)
    weight = (1 / (len(languages) * share))[[languages.index(x) for x in names]]  # every language counts the same
    around = mapped - middle
    with one_thread():
        solved = np.linalg.solve(around.T @ (around * weight[:, None]) + s.ridge * np.eye(mapped.shape[1]), around.T @ ((target - target.mean(0)) * weight[:, None]))
    return Model(languages, (marks.T @ (whiten @ solved)).astype(np.float32), target.mean(0) - middle @ solved, s)


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def train(spark: SparkSession, docs: DataFrame, learn: Column, s: Settings | None = None) -> Model:
    """docs: doc_id, text, lang; learn: which rows may be learned from.

    Rows are drawn by a hash of their id and text, about twice as many of each language as needed, so what reaches the
    driver is bounded by the settings: the languages' counts, then the cells present in each text drawn.
    """
    s = s or Settings()
    rows = docs.where(learn & F.col("lang").isNotNull())
    counts = rows.groupBy("lang").agg(F.count("*").alias("n")).collect()
    if not counts:
        return fit([], [], s)
    most = max(1, min(s.per_language, s.texts // len(counts)))
    draw = F.pmod(F.xxhash64("doc_id", F.length("text")), F.lit(1 << 30))
    below = F.create_map(*[x for r in counts for x in (F.lit(r["lang"]), F.lit(min(1 << 30, (1 << 30) * 2 * most // r["n"])))])
    drawn = rows.where(draw < F.coalesce(below[F.col("lang")], F.lit(0))).select("text", "lang", draw.alias("draw"))

    def work(batch: pa.RecordBatch) -> dict:
        texts = as_texts(batch.column("text"))
        cells = [np.flatnonzero(x).astype(np.int32) for run in runs(texts, 1 << 20) for part in few(texts[run]) for x in presence(part, s)]
        return {"lang": batch.column("lang"), "draw": batch.column("draw"), "cells": cells}

    got = per_batch(spark, drawn, "lang string, draw long, cells array<int>", work).toArrow()
    cells = [x.values.to_numpy() for x in got["cells"]]
    found: dict[str, list] = {}
    for lang, _, i in sorted((lang, (draw, cells[i].tobytes()), i) for i, (lang, draw) in enumerate(zip(got["lang"].to_pylist(), got["draw"].to_pylist()))):
        of = found.setdefault(lang, [])
        if len(cells[i]) and len(of) < most:
            of.append(cells[i])
    return fit([c for x in found.values() for c in x], [lang for lang, x in found.items() for _ in x], s)


def few(texts: list[str], most: int = 256) -> list[list[str]]:
    return [texts[i : i + most] for i in range(0, len(texts), most)]


IDENTIFIED = "doc_id long, held_out boolean, lang_pred string, score double"


def identify(spark: SparkSession, docs: DataFrame, model: Model) -> DataFrame:
    """docs: doc_id, text, held_out."""
    shared = spark.sparkContext.broadcast(model)

    def work(batch: pa.RecordBatch) -> dict:
        texts = as_texts(batch.column("text"))
        parts = [shared.value.score(part) for run in runs(texts, 1 << 20) for part in few(texts[run])]
        return {"doc_id": batch.column("doc_id"), "held_out": batch.column("held_out"), "lang_pred": [x for p, _ in parts for x in p], "score": np.concatenate([q for _, q in parts])}

    return per_batch(spark, docs, IDENTIFIED, work)


def language_id(spark: SparkSession, df: DataFrame, settings: Settings | None = None, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """Learn from the rows that are not held out, and predict the language of all."""
    docs = documents(df, id_col, text_col, lang=lang_col)
    model = train(spark, docs, ~held_out(F.col("doc_id")), settings)
    return identify(spark, docs.select("doc_id", "text", held_out(F.col("doc_id")).alias("held_out")), model)


def keep_identified(spark: SparkSession, df: DataFrame, least: float = 0.4, settings: Settings | None = None, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """The rows of df whose language is found with a score of `least` or more; all columns stay. The model learns from df's labels.

    Where no row is labelled there is no model to reject by, and only rows without a letter go.
    """
    model = train(spark, documents(df, id_col, text_col, lang=lang_col), F.lit(True), settings)
    shared = spark.sparkContext.broadcast(model)

    def good(column: pa.Array) -> np.ndarray:
        texts = as_texts(column)
        if not shared.value.languages:
            return np.array([any(map(str.isalpha, t)) for t in texts])
        parts = [shared.value.score(part) for run in runs(texts, 1 << 20) for part in few(texts[run])]
        return np.array([name != UNKNOWN for p, _ in parts for name in p]) & (np.concatenate([q for _, q in parts]) >= least)

    return keep_rows(spark, df, good, text_col)
