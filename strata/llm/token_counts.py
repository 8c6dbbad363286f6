"""Token counts by a linear longest-match automaton.

Greedy word-piece tokenization takes, again and again, the longest vocabulary piece that a word goes on with. Here a trie of
the vocabulary has a failure link at every node, as in Aho-Corasick matching, and beside it how many pieces are popped
on the way there (Song and others, 2021). A word's count is the sum over the links taken: every character is read once
and no piece is built. Distinct chunks of a batch go through the automaton side by side, one character of each a step.

Texts are cut at white space, and chunks into words (runs of letters, digits and underscores) and single other
characters. A word that the vocabulary cannot spell is one unknown token.

Defined results: null and empty texts have no words and no tokens; words of any length are read whole; pieces never
tie, as the longest is taken; an empty table gives an empty result; repeated rows give repeated results. Columns other than those named are neither read nor returned.
"""

from __future__ import annotations

import functools
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from strata.llm.common import CACHE_ENTRIES, as_texts, documents, per_batch, runs, sums

WORD = re.compile(r"\w+|[^\w\s]")
NONE = -1
ROOT, INNER = 0, 1


def piece_vocabulary(path: str) -> tuple[list[str], list[str]]:
    """Pieces that begin a word, and pieces that go on with one, of a SentencePiece model that marks beginnings."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    first, inner = [], []
    for i in range(model.vocab_size()):
        piece = model.id_to_piece(i)
        if model.is_byte(i) or model.is_control(i) or model.is_unknown(i):
            continue
        word = piece.removeprefix("▁")
        if word and "▁" not in word:
            (first if word != piece else inner).append(word)
    return first, inner


class LongestMatch:
    """Trie nodes 0 (a word's start) and 1 (within a word) and below; per node: failure link and pieces popped on the way."""

    def __init__(self, first: list[str], inner: list[str]):
        letters = {c: i for i, c in enumerate(sorted({c for w in first + inner for c in w}))}
        children: list[dict[int, int]] = [{}, {}]
        ends = {}
        parent, by = [NONE, NONE], [0, 0]
        for root, words in ((ROOT, first), (INNER, inner)):
            for word in words:
                at = root
                for c in map(letters.__getitem__, word):
                    if c not in children[at]:
                        children[at][c] = len(children)
                        children.append({})
                        parent.append(at)
                        by.append(c)
                    at = children[at][c]
                ends[at] = True
        link, popped = [NONE] * len(children), [0] * len(children)
        todo = [*children[ROOT].values(), *children[INNER].values()]
        for node in todo:  # by depth: a link leads to a node of less depth
            if node in ends:
                link[node], popped[node] = INNER, 1
            else:
                at, count = link[parent[node]], popped[parent[node]]
                while at != NONE and by[node] not in children[at]:
                    count += popped[at]
                    at = link[at]
                if at != NONE:
                    link[node], popped[node] = children[at][by[node]], count
            todo.extend(children[node].values())
        self.width = len(letters) + 1
        self.kind = np.zeros(0x110000, np.int32)  # 0: in no piece
        for c, i in letters.items():
            self.kind[ord(c)] = i + 1
        edges = sorted((node * self.width + c + 1, child) for node, of in enumerate(children) for c, child in of.items())
        self.keys, self.targets = (np.array(x, np.int64) for x in zip(*edges))
        self.link, self.popped = np.array(link), np.array(popped)

    def counts(self, words: list[str]) -> np.ndarray:
        """Tokens of each word, -1 for a word that cannot be spelt; words are not empty."""
        lengths = np.fromiter(map(len, words), np.int64, len(words))
        kinds = self.kind[np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), np.uint32)].astype(np.int64)
        order = np.argsort(-lengths, kind="stable")
        starts, sizes = (np.cumsum(lengths) - lengths)[order], lengths[order]
        node, total = np.zeros(len(words), np.int64), np.zeros(len(words), np.int64)
        active = np.searchsorted(-sizes, -np.arange(1, (sizes[0] if len(sizes) else 0) + 1), side="right")
        for p, n in enumerate(active):
            todo = np.flatnonzero(node[:n] != NONE)
            while len(todo):
                key = node[todo] * self.width + kinds[starts[todo] + p]
                at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
                there = self.keys[at] == key
                node[todo[there]] = self.targets[at[there]]
                todo = todo[~there]
                total[todo] += self.popped[node[todo]]
                node[todo] = self.link[node[todo]]
                todo = todo[node[todo] != NONE]
        todo = np.flatnonzero((node != NONE) & (node != INNER))
        while len(todo):
            total[todo] += self.popped[node[todo]]
            node[todo] = self.link[node[todo]]
            todo = todo[(node[todo] != NONE) & (node[todo] != INNER)]
        out = np.empty(len(words), np.int64)
        out[order] = np.where(node == NONE, -1, total)
        return out


class Counter:
    """Words, tokens and unknown words of texts; remembers those of distinct chunks."""

    def __init__(self, path: str):
        self.automaton = LongestMatch(*piece_vocabulary(path))
        self.clear()

    def clear(self) -> None:
        self.code: dict[str, int] = {}
        self.figures = np.zeros((0, 3), np.int64)

    def learn(self, chunks: set[str]) -> None:
        new = [c for c in chunks if c not in self.code]
        if not new:
            return
        lists = list(map(WORD.findall, new))
        n = np.fromiter(map(len, lists), np.int64, len(lists))
        counts = self.automaton.counts([w for x in lists for w in x])
        self.code.update(zip(new, range(len(self.code), len(self.code) + len(new))))
        self.figures = np.concatenate([self.figures, np.stack([n, sums(np.abs(counts), n), sums((counts < 0).astype(np.int64), n)], 1)])

    def count(self, texts: list[str]) -> np.ndarray:
        if len(self.code) > CACHE_ENTRIES:
            self.clear()
        lists = [t.split() for t in texts]
        chunks = [c for x in lists for c in x]
        self.learn(set(chunks))
        codes = np.fromiter(map(self.code.__getitem__, chunks), np.int64, len(chunks))
        n = np.fromiter(map(len, lists), np.int64, len(lists))
        return np.stack([sums(self.figures[codes, k], n) for k in range(3)], 1)


@functools.cache
def counter(path: str) -> Counter:
    """One for each worker."""
    return Counter(path)


def vocabulary_path(name: str = "piece_bpe_32k.model") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def token_counts(spark: SparkSession, df: DataFrame, path: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_words, n_tokens (an unknown word is one) and n_unknown of each document."""
    path = path or vocabulary_path()

    def work(batch: pa.RecordBatch) -> dict:
        texts = as_texts(batch.column("text"))
        found = np.concatenate([counter(path).count(texts[run]) for run in runs(texts)])
        return {"doc_id": batch.column("doc_id"), "n_words": found[:, 0], "n_tokens": found[:, 1], "n_unknown": found[:, 2]}

    return per_batch(spark, documents(df, id_col, text_col), "doc_id long, n_words long, n_tokens long, n_unknown long", work)
