"""Packing by concatenation and cutting.

Documents' token ids, each document's followed by an end id, are one long row of ids, in the order in which the table is
read: partition after partition. A first pass writes each document's ids and their place in its partition to the shared
folder; the partitions' totals (a number each) give every partition's place in the row by a prefix sum; a second pass
cuts each document where windows of a fixed length end. Only the last sequence can be short.

Defined results: null and empty texts are the end id alone; a document longer than a window is cut into as many pieces
as it needs; repeated rows are packed as often as they come; an empty table has no pieces. The string of a special token in
a text is that token, as `tokenizers` has it. Long texts are encoded in windows. The order follows the table's files and how Spark splits them, so it is the same on every
run and retry with the same settings. Columns other than those named are neither read nor returned.
"""

from __future__ import annotations

import base64
import functools
import json
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strata.llm.common import documents, give_back, per_batch, prepare, ranges, runs_of, settle, sums, to_arrow

# White space of Unicode, as ranges of a regular expression.
SPACES = r"\x{09}-\x{0d}\x{1c}-\x{20}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
#: A space that neither begins its run of white space nor comes before a word. Here more counts as white space than where texts are split.
INNER_SPACE = rf"[{SPACES}] (?:[{SPACES}]|\z)"
#: Words that may stand in one text with others without changing their ids have no white space at their ends.
ENDS_IN_SPACE = rf"^[{SPACES}]|[{SPACES}]\z|^\z"
#: Bytes of texts whose distinct words are encoded together.
TOGETHER = 8 << 20
LENGTH = 2048
END_ID = 1


def vocabulary_path(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


class Encoder:
    """Ids of texts by byte-level merges; each distinct word of a run of texts is encoded once.

    The split that precedes the merges keeps white space together but for a last space before a word, which goes with
    the word. So a text can be cut before a space that begins or ends its run of white space and is not the text's end
    after others, and its ids are those of the chunks put together. Texts with other spaces, and those with the string of
    a special token, are encoded whole. The distinct chunks are encoded as one text, for the same reason; the lengths of
    tokens in bytes tell which ids are whose.
    """

    def __init__(self, path: str):
        import public_tokenizers
        import tiktoken

        with open(path, encoding="utf-8") as file:
            self.special = {t["content"]: t["id"] for t in json.load(file)["added_tokens"]}
        with open(path.removesuffix(".json") + ".tiktoken", "rb") as file:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, file)}
        ranks = {k: v for k, v in ranks.items() if v not in self.special.values()}
        self.bytes = np.zeros(max(ranks.values()) + 1, np.int64)
        self.bytes[[*ranks.values()]] = [*map(len, ranks)]
        self.encoding = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens=self.special)

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids, and how many each text has."""
        texts = pc.fill_null(texts, "")
        alone = pc.match_substring_regex(texts, INNER_SPACE)
        for special in self.special:
            alone = pc.or_(alone, pc.match_substring(texts, special))
        whole = np.flatnonzero(alone.to_numpy(zero_copy_only=False)).tolist()
        if not whole:
            return self._windows(texts[0].as_py()) if len(texts) == 1 and len(texts[0].as_buffer()) > 2 * TOGETHER else self._chunked(texts)
        flat, counts = self._chunked(pc.if_else(alone, "", texts))
        ids = {i: np.array(self.encoding.encode(texts[i].as_py(), allowed_special="all"), np.int32) for i in whole}
        ends = np.cumsum(counts).tolist()
        parts = [ids.get(i, flat[b - n : b]) for i, (b, n) in enumerate(zip(ends, counts.tolist()))]
        return np.concatenate(parts), np.fromiter(map(len, parts), np.int64, len(parts))

    def _chunked(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        split = pc.split_pattern(texts, " ")
        pieces = np.diff(split.offsets.to_numpy())
        words = split.flatten().dictionary_encode()
        at = words.indices.to_numpy()
        first = np.zeros(len(at), bool)
        first[np.cumsum(pieces) - pieces] = True  # the first piece of a text has no space before it
        ids, used = [np.zeros(0, np.int32)], 0
        starts, lengths = np.zeros(len(at), np.int64), np.zeros(len(at), np.int64)
        for which, work in ((first, self._one_by_one), (~first, self._after_spaces)):
            there = np.zeros(len(words.dictionary), bool)
            there[at[which]] = True
            own, counts = work(words.dictionary.filter(pa.array(there)))
            place = (np.cumsum(there) - 1)[at[which]]
            starts[which], lengths[which] = used + (np.cumsum(counts) - counts)[place], counts[place]
            ids.append(own)
            used += len(own)
        return np.concatenate(ids)[ranges(starts, lengths)], sums(lengths, pieces)

    def _one_by_one(self, words: pa.Array, prefix: str = "") -> tuple[np.ndarray, np.ndarray]:
        lists = [self.encoding.encode_ordinary(prefix + w) for w in words.to_numpy(zero_copy_only=False)]
        counts = np.fromiter(map(len, lists), np.int64, len(lists))
        return np.fromiter((i for x in lists for i in x), np.int32, int(counts.sum())), counts

    def _after_spaces(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of words with a space before each."""
        odd = pc.match_substring_regex(words, ENDS_IN_SPACE).to_numpy(zero_copy_only=False)
        plain = words.filter(pa.array(~odd))
        joined = pc.binary_join(pa.array([plain], pa.list_(plain.type)), " ")[0].as_py()
        ids = self.encoding.encode_to_numpy(" " + joined, disallowed_special=()).astype(np.int32) if len(plain) else np.zeros(0, np.int32)
        ends = np.cumsum(pc.binary_length(plain).to_numpy().astype(np.int64) + 1)
        tokens = np.searchsorted(np.cumsum(self.bytes[ids]), ends) + 1
        counts = np.zeros(len(words), np.int64)
        counts[~odd] = np.diff(tokens, prepend=0)
        if not odd.any():
            return ids, counts
        others, n = self._one_by_one(words.filter(pa.array(odd)), " ")
        counts[odd] = n
        out, mine = np.zeros(int(counts.sum()), np.int32), np.repeat(odd, counts)
        out[mine], out[~mine] = others, ids
        return out, counts

    def _windows(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        """A long text, cut before spaces."""
        parts, at = [], 0
        while at < len(text):
            end = text.find(" ", at + TOGETHER)
            end = len(text) if end < 0 else end
            parts.append(self._chunked(pa.array([text[at:end]]))[0])
            at = end
        return np.concatenate(parts), np.array([sum(map(len, parts))])


@functools.cache
def encoder(path: str) -> Encoder:
    """One for each worker."""
    return Encoder(path)


STORED = "doc_id long, part int, start long, n long, ids binary"
PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def store_ids(spark: SparkSession, docs: DataFrame, path: str, end_id: int) -> DataFrame:
    """Each document's ids, as unsigned 16- or 32-bit integers, and its start among those of its partition."""
    prepare(spark)
    arrow = to_arrow(spark, STORED)

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, at, encode = TaskContext.get().partitionId(), 0, encoder(path).encode
        for batch in batches:
            texts = batch.column("text")
            done = 0
            for run in runs_of(pc.fill_null(pc.binary_length(texts), 0).to_pylist(), TOGETHER):
                flat, counts = encode(texts[run])
                ends = np.cumsum(counts + 1)
                starts = ends - counts - 1
                whole = np.full(int(ends[-1]), end_id, np.uint32)
                whole[ranges(starts, counts)] = flat
                wide = np.uint32 if len(whole) and whole.max() > 0xFFFF else np.uint16
                data = whole.astype(wide)
                limits = np.concatenate([[0], ends]) * data.itemsize
                ids = pa.Array.from_buffers(pa.large_binary(), len(counts), [None, pa.py_buffer(limits.astype(np.int64)), pa.py_buffer(data)]).cast(pa.binary())
                n = counts + 1
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(done, len(n)), pa.array(np.full(len(n), part, np.int32)), pa.array(at + starts), pa.array(n), ids], schema=arrow)
                at += int(ends[-1])
                done += len(n)
        give_back()

    return settle(spark, docs.mapInArrow(each, STORED), "ids")


def cut(start: int, n: int, length: int) -> list[tuple[int, int]]:
    """Begin and end, from the document's start, of the pieces of a document whose ids take up [start, start + n) of the row."""
    limits = [0, *range(length - start % length, n, length), n]
    return list(zip(limits, limits[1:]))


def packing(spark: SparkSession, df: DataFrame, length: int = LENGTH, path: str | None = None, end_id: int = END_ID, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row a piece: where it stands in its document and in which sequence."""
    stored = store_ids(spark, documents(df, id_col, text_col), path or vocabulary_path(), end_id)
    # a number for each partition of the table: what the method itself keeps, and far less than Spark keeps of a task
    totals = sorted(tuple(r) for r in stored.groupBy("part").agg(F.sum("n")).collect())
    before = dict(zip([p for p, _ in totals], np.concatenate([[0], np.cumsum([n for _, n in totals])]).tolist()))
    bases = spark.sparkContext.broadcast(before)

    def work(batch: pa.RecordBatch) -> dict:
        out: dict[str, list] = {name: [] for name in ("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")}
        for doc, part, local, n, ids in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "part", "start", "n", "ids"))):
            data = np.frombuffer(ids, np.uint16 if len(ids) == 2 * n else np.uint32).astype("<u4").tobytes()
            start = bases.value[part] + local
            for a, b in cut(start, n, length):
                for name, x in zip(out, (doc, a, b - a, zlib.crc32(memoryview(data)[4 * a : 4 * b]), n, (start + a) // length, (start + a) % length)):
                    out[name].append(x)
        return out

    return per_batch(spark, stored, PIECES, work)
