"""SentencePiece encoding and decoding by suffix-array matching.

The distinct chunks of a batch of texts that its worker has not met before (a space mark and what follows up to the next space) are put together into one
text. Its suffixes are sorted to the depth of the longest piece by prefix doubling. Every piece's occurrences are a
range of that order, found for all pieces at once by binary search, doubling by doubling. The occurrences, sorted by
position, are the edges of every chunk's lattice, and are relaxed from left to right for all chunks together.

Merging by rank gives each prefix of a chunk one last piece: a piece may follow another if their two merge trees would
not have merged across the border. So relaxing sets, for each position, the one piece whose edge comes from a reached
position and may follow the piece that ends there; the last pieces, read backwards, are the pieces that merging gives.
Runs of more spaces, whose pieces all have one score, are merged from the left.

Defined results: null and empty texts have no ids. Characters that are no piece become pieces of their UTF-8 bytes.
The space mark itself is read as a space, as the library does, so texts with one do not come back; others do. Of pieces
that may end at one place, the ranks leave one, so there are no ties. Repeated rows
give repeated results, texts and chunks may be of any length, and an empty table gives an empty result. Columns other than those named are neither read nor returned.
"""

from __future__ import annotations

import functools
import hashlib
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from strata.llm.common import as_texts, documents, per_batch, ranges, runs, sums

MARK = "▁"
NONE = -1
#: Characters that are indexed together.
INDEXED = 1 << 20
#: Chunks are dearer to encode here than elsewhere, so more of them are remembered.
REMEMBERED = 800_000


class Pieces:
    """Pieces of a model with byte fallback, their ranks and merge trees, and the keys by which they are searched.

    A piece's number here is its id in the model.
    """

    def __init__(self, path: str):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        self.size = model.vocab_size()
        self.texts = [model.id_to_piece(i) for i in range(self.size)]
        ordinary = [i for i in range(self.size) if not (model.is_byte(i) or model.is_control(i) or model.is_unknown(i) or model.is_unused(i))]
        self.byte_ids = np.full(256, model.unk_id(), np.int64)
        for i in range(self.size):
            if model.is_byte(i):
                self.byte_ids[int(self.texts[i][3:5], 16)] = i
        self.mark = model.piece_to_id(MARK)
        self.spaces = {len(self.texts[i]): i for i in ordinary if set(self.texts[i]) == {MARK}}
        usable = [i for i in ordinary if MARK not in self.texts[i][1:] and (self.texts[i] != MARK or i == self.mark)]
        self.id_of = {self.texts[i]: i for i in usable}
        self.score = {i: model.get_score(i) for i in usable}
        # ranks: first merged, least; single characters come before all merges
        merged = sorted((i for i in usable if len(self.texts[i]) > 1), key=lambda i: -self.score[i])
        self.rank = np.full(self.size + 1, NONE, np.int64)
        self.rank[merged] = np.arange(len(merged))
        self.left, self.right = np.arange(self.size + 1), np.arange(self.size + 1)
        reached = [i for i in usable if len(self.texts[i]) == 1 or self._tree(i)]
        pairs = sorted((self.id_of[t[:k]] * self.size + self.id_of[t[k:]], i) for i in usable if len(t := self.texts[i]) > 1 for k in range(1, len(t)) if t[:k] in self.id_of and t[k:] in self.id_of)
        self.pair_keys, self.pair_ids = (np.array(x, np.int64) for x in zip(*pairs))

        letters = sorted({c for i in reached for c in self.texts[i]})
        self.kind = np.zeros(0x110000, np.int64)  # 0: no piece has the character, and none reaches across it
        self.kind[[ord(c) for c in letters]] = np.arange(1, len(letters) + 1)
        self.numbers = np.array(reached, np.int64)
        self.lengths = np.array([len(self.texts[i]) for i in reached], np.int64)
        self.depth = 1 << int(self.lengths.max() - 1).bit_length()
        self.kinds = np.zeros((len(reached), self.depth), np.int64)
        for row, i in enumerate(reached):
            self.kinds[row, : self.lengths[row]] = self.kind[[ord(c) for c in self.texts[i]]]

        raw = [b" " * len(t) if set(t) == {MARK} else t.replace(MARK, " ").encode() for t in self.texts]
        for b, i in enumerate(self.byte_ids):
            raw[i] = bytes([b])
        for i in range(self.size):
            if model.is_control(i):
                raw[i] = b""
        self.raw = np.frombuffer(b"".join(raw), np.uint8)
        self.raw_lengths = np.array([len(r) for r in raw], np.int64)
        self.raw_starts = np.cumsum(self.raw_lengths) - self.raw_lengths
        self.may: dict[int, bool] = {}

    def _tree(self, piece: int) -> bool:
        """Set the two halves that the piece's last merge joins; False if merging its characters ends elsewhere."""
        parts = [self.id_of.get(c) for c in self.texts[piece]]
        if None in parts:
            return False
        while len(parts) > 1:
            found = [(self.rank[m], k, m) for k in range(len(parts) - 1) if (m := self.id_of.get(self.texts[parts[k]] + self.texts[parts[k + 1]])) is not None]
            if not found:
                return False
            _, k, m = min(found)
            if m == piece:
                self.left[piece], self.right[piece] = parts[k], parts[k + 1]
            parts[k : k + 2] = [m]
        return parts[0] == piece

    def space_run(self, n: int) -> list[int]:
        """Pieces of n spaces: scores are equal, so the leftmost two that make a piece are merged first."""
        parts, k = [1] * n, 0
        while k < len(parts) - 1:
            if parts[k] + parts[k + 1] in self.spaces:
                parts[k : k + 2] = [parts[k] + parts[k + 1]]
                k = max(k - 1, 0)
            else:
                k += 1
        return [self.spaces[p] for p in parts]

    def merged(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Rank of the piece that a and b make together; -1: none."""
        key = a * self.size + b
        at = np.minimum(np.searchsorted(self.pair_keys, key), len(self.pair_keys) - 1)
        return np.where(self.pair_keys[at] == key, self.rank[self.pair_ids[at]], NONE)

    def follow(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Whether merging the characters of a and b together leaves a and b.

        Their trees are undone along the border, the later merge first. Two nodes that stand side by side stay apart if
        they make no piece, or one that comes after one of them is merged inwards; of equal ranks the left comes first.
        """
        out = np.ones(len(a), bool)
        at = np.arange(len(a))
        a, b = a.copy(), b.copy()
        last = np.iinfo(np.int64).max
        a_until, b_until = np.full(len(a), last), np.full(len(a), last)
        while len(at):
            m = self.merged(a, b)
            bad = (m != NONE) & (m < a_until) & (m <= b_until)
            out[at[bad]] = False
            ra, rb = self.rank[a], self.rank[b]
            go = ~bad & ((ra != NONE) | (rb != NONE))
            at, a, b, a_until, b_until, ra, rb = (x[go] for x in (at, a, b, a_until, b_until, ra, rb))
            undo_b = rb >= ra
            a_until, b_until = np.where(undo_b, a_until, ra), np.where(undo_b, rb, b_until)
            a, b = np.where(undo_b, a, self.right[a]), np.where(undo_b, self.left[b], b)
        return out

    def may_follow(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """follow(), remembered for distinct pairs."""
        keys, back = np.unique(a * self.size + b, return_inverse=True)
        known = [self.may.get(k) for k in keys.tolist()]
        new = [i for i, x in enumerate(known) if x is None]
        if new:
            if len(self.may) > 2 * REMEMBERED:
                self.may = {}
            for i, x in zip(new, self.follow(keys[new] // self.size, keys[new] % self.size).tolist()):
                known[i] = self.may[int(keys[i])] = x
        return np.array(known, bool)[back] if len(keys) else np.zeros(0, bool)


def suffixes(kinds: np.ndarray, depth: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """For depths 1, 2, 4 ... depth: the rank of the suffix at each position by so many characters, ranks being dense."""
    n = len(kinds)
    values, rank = np.unique(kinds, return_inverse=True)
    out = [(values, rank)]
    size = 1
    while size < depth:
        next_rank = np.zeros(n, np.int64)
        next_rank[: max(n - size, 0)] = rank[size:] + 1
        values, after = np.unique(rank * (n + 1) + next_rank, return_inverse=True)
        out.append((values, after))
        rank, size = after, 2 * size
    return out


def occurrences(kinds: np.ndarray, pieces: Pieces) -> tuple[np.ndarray, np.ndarray]:
    """Position and piece's row of every occurrence of every piece."""
    n, rows = len(kinds), len(pieces.numbers)
    levels = suffixes(kinds, pieces.depth)
    # for each piece and each aligned stretch of it at a level: the ranks [low, high) of suffixes that begin with what it has there
    values, rank = levels[0]
    low = np.searchsorted(values, pieces.kinds)
    high = np.searchsorted(values, pieces.kinds, side="right")
    size = 1
    inside = np.arange(pieces.depth) < pieces.lengths[:, None]
    low, high = np.where(inside, low, 0), np.where(inside, high, len(values))
    for values, after in levels[1:]:
        left = np.arange(0, pieces.depth, 2 * size) // size
        begin, end, begin2, end2 = low[:, left], high[:, left], low[:, left + 1], high[:, left + 1]
        starts = np.arange(0, pieces.depth, 2 * size)
        full = starts + size < pieces.lengths[:, None]  # something of the piece stands in the second half
        first = np.where(full, begin * (n + 1) + begin2 + 1, begin * (n + 1))
        beyond = np.where(full, begin * (n + 1) + end2 + 1, end * (n + 1))
        none = (begin >= end) | full & (begin2 >= end2)
        low, high = np.searchsorted(values, first), np.searchsorted(values, beyond)
        none |= starts >= pieces.lengths[:, None]
        high = np.where(none, np.where(starts >= pieces.lengths[:, None], len(values), low), high)
        low = np.where(starts >= pieces.lengths[:, None], 0, low)
        rank, size = after, 2 * size
    order = np.argsort(rank)
    first = np.searchsorted(rank[order], np.arange(len(levels[-1][0]) + 1))
    starts, ends = first[low[:, 0]], first[np.maximum(high[:, 0], low[:, 0])]
    counts = ends - starts
    return order[ranges(starts, counts)], np.repeat(np.arange(rows), counts)


class Encoder:
    def __init__(self, path: str):
        self.pieces = Pieces(path)
        self.runs: dict[int, list[int]] = {}
        self.clear()

    def clear(self) -> None:
        self.code: dict[str, int] = {}
        self.ids = np.zeros(0, np.int32)
        self.starts = self.lengths = np.zeros(0, np.int64)

    def learn(self, fields: set[str]) -> None:
        """Ids of a space mark and each field, remembered."""
        new = [f for f in fields if f not in self.code]
        for run in runs(new, INDEXED):
            flat, counts = encode_chunks([MARK + f for f in new[run]], self.pieces)
            self.code.update(zip(new[run], range(len(self.code), len(self.code) + len(counts))))
            self.starts = np.concatenate([self.starts, len(self.ids) + np.cumsum(counts) - counts])
            self.lengths = np.concatenate([self.lengths, counts])
            self.ids = np.concatenate([self.ids, flat.astype(np.int32)])

    def space_run(self, n: int) -> list[int]:
        if n not in self.runs:
            self.runs[n] = self.pieces.space_run(n)
        return self.runs[n]

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """All ids, and how many each text has."""
        if len(self.code) > REMEMBERED:
            self.clear()
        lists = [t.replace(MARK, " ").split(" ") if t else [] for t in texts]
        self.learn({f for x in lists for f in x if f})
        parts, counts = [], np.zeros(len(texts), np.int64)
        codes: list[int] = []  # of consecutive texts without empty fields
        n: list[int] = []
        for i, fields in enumerate(lists):
            if "" in fields:
                parts.append(self._plain(codes))
                counts[i - len(n) : i] = self._counts(codes, n)
                codes, n = [], []
                parts.append(np.array(self._spaced(fields), np.int32))
                counts[i] = len(parts[-1])
            else:
                codes += map(self.code.__getitem__, fields)
                n.append(len(fields))
        parts.append(self._plain(codes))
        counts[len(lists) - len(n) :] = self._counts(codes, n)
        return np.concatenate(parts), counts

    def _counts(self, codes: list[int], n: list[int]) -> np.ndarray:
        return sums(self.lengths[np.array(codes, np.int64)], np.array(n, np.int64))

    def _plain(self, codes: list[int]) -> np.ndarray:
        at = np.array(codes, np.int64)
        return self.ids[ranges(self.starts[at], self.lengths[at])]

    def _spaced(self, fields: list[str]) -> list[int]:
        out: list[int] = []
        spaces = 0
        for f in fields:
            spaces += 1
            if f:
                code = self.code[f]
                ids = self.ids[self.starts[code] : self.starts[code] + self.lengths[code]].tolist()
                if ids[0] == self.pieces.mark:  # the mark stayed alone, so it merges with the spaces before it
                    ids = ids[1:]
                else:
                    spaces -= 1
                out += self.space_run(spaces) + ids
                spaces = 0
        return out + self.space_run(spaces)

    def decode(self, ids: np.ndarray, counts: np.ndarray) -> list[bytes]:
        """UTF-8 of each text; the first space mark is dropped."""
        p = self.pieces
        raw = p.raw[ranges(p.raw_starts[ids], p.raw_lengths[ids])].tobytes()
        ends = np.cumsum(sums(p.raw_lengths[ids], counts)).tolist()
        return [raw[a:b].removeprefix(b" ") if raw[a : a + 1] == b" " and a < b else raw[a:b] for a, b in zip([0, *ends], ends)]


def encode_chunks(chunks: list[str], pieces: Pieces) -> tuple[np.ndarray, np.ndarray]:
    """Ids of all chunks, one after another, and how many each has. A chunk begins with a space mark and has no other."""
    lengths = np.fromiter(map(len, chunks), np.int64, len(chunks))
    points = np.frombuffer("\0".join([*chunks, ""]).encode("utf-32-le", "surrogatepass"), np.uint32)
    kinds = pieces.kind[points]
    starts = np.cumsum(lengths + 1) - lengths - 1
    kinds[starts + lengths] = 0
    place, row = occurrences(kinds, pieces)
    chunk = np.repeat(np.arange(len(chunks)), lengths + 1)
    alone = np.flatnonzero(kinds == 0)
    alone = alone[alone != (starts + lengths)[chunk[alone]]]  # characters that are no piece: edges of their own
    place = np.concatenate([place, alone])
    piece = np.concatenate([pieces.numbers[row], np.full(len(alone), pieces.size)])
    length = np.concatenate([pieces.lengths[row], np.ones(len(alone), np.int64)])
    step = place - starts[chunk[place]]
    longest = int(lengths.max(initial=0))
    order = np.argsort(step.astype(np.uint16) if longest < 1 << 16 else step, kind="stable")  # narrow integers are sorted by radix
    place, piece, length, step = place[order], piece[order], length[order], step[order]
    limits = np.searchsorted(step, np.arange(longest + 1))

    last = np.full(len(points) + 1, NONE, np.int64)  # the piece that ends before each position
    for p, (a, b) in enumerate(zip(limits, limits[1:])):
        at, new, size = place[a:b], piece[a:b], length[a:b]
        if p:
            before = last[at]
            ok = before != NONE
            test = ok & (before != pieces.size) & (new != pieces.size)
            ok[test] = pieces.may_follow(before[test], new[test])
            at, new, size = at[ok], new[ok], size[ok]
        last[at + size] = new

    sizes = np.array([len(t) for t in pieces.texts] + [1], np.int64)
    at = starts + lengths
    back, where, begin = [], [], []
    todo = np.arange(len(chunks))
    while len(todo):
        got = last[at[todo]]
        at[todo] -= sizes[got]
        back.append(got)
        where.append(todo)
        begin.append(at[todo].copy())
        todo = todo[at[todo] > starts[todo]]
    if not back:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    got, where, begin = np.concatenate(back), np.concatenate(where), np.concatenate(begin)
    order = np.argsort(begin)
    got, where, begin = got[order], where[order], begin[order]
    counts = np.bincount(where, minlength=len(chunks))
    unknown = np.flatnonzero(got == pieces.size)
    if len(unknown):
        raw = [chr(points[b]).encode("utf-8", "replace") for b in begin[unknown]]
        n = np.ones(len(got), np.int64)
        n[unknown] = [len(r) for r in raw]
        flat = np.repeat(got, n)
        flat[ranges((np.cumsum(n) - n)[unknown], n[unknown])] = pieces.byte_ids[np.frombuffer(b"".join(raw), np.uint8)]
        return flat, sums(n, counts)
    return got, counts


@functools.cache
def encoder(path: str) -> Encoder:
    """One for each worker."""
    return Encoder(path)


def model_path(name: str = "piece_bpe_32k.model") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def encode(spark: SparkSession, df: DataFrame, path: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and ids of each document."""
    path = path or model_path()

    def work(batch: pa.RecordBatch) -> dict:
        texts = as_texts(batch.column("text"))
        found = [encoder(path).encode(texts[run]) for run in runs(texts)]
        counts = np.concatenate([c for _, c in found])
        limits = pa.array(np.concatenate([[0], np.cumsum(counts)]).astype(np.int32))
        return {"doc_id": batch.column("doc_id"), "ids": pa.ListArray.from_arrays(limits, pa.array(np.concatenate([f for f, _ in found]).astype(np.int32)))}

    return per_batch(spark, documents(df, id_col, text_col), "doc_id long, ids array<int>", work)


def decode(spark: SparkSession, encoded: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id and text of rows of doc_id and ids; null ids: empty."""
    path = path or model_path()

    def work(batch: pa.RecordBatch) -> dict:
        lists = [np.array(x or [], np.int64) for x in batch.column("ids").to_pylist()]
        texts = encoder(path).decode(np.concatenate(lists), np.array([len(x) for x in lists]))
        return {"doc_id": batch.column("doc_id"), "text": [t.decode("utf-8", "replace") for t in texts]}

    return per_batch(spark, encoded, "doc_id long, text string", work)


DIGEST = "doc_id long, n_bytes long, n_tokens long, n_byte_tokens long, ids_crc32 long, decoded_sha256 string, round_trip boolean"


def round_trip(spark: SparkSession, df: DataFrame, path: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Encode, decode, and say of each document how many ids it has, their CRC (as unsigned 32-bit integers) and what they decode to."""
    path = path or model_path()

    def work(batch: pa.RecordBatch) -> dict:
        out: dict[str, list] = {name: [] for name in ("n_bytes", "n_tokens", "n_byte_tokens", "ids_crc32", "decoded_sha256", "round_trip")}
        texts = as_texts(batch.column("text"))
        e = encoder(path)
        fallback = np.isin(np.arange(e.pieces.size), e.pieces.byte_ids)
        for run in runs(texts):
            ids, counts = e.encode(texts[run])
            n_bytes = sums(fallback[ids].astype(np.int64), counts)
            ends = np.cumsum(counts)
            data = memoryview(ids.astype("<u4").tobytes())
            for text, back, end, n, b in zip(texts[run], e.decode(ids, counts), ends.tolist(), counts.tolist(), n_bytes.tolist()):
                raw = text.encode()
                for name, x in zip(out, (len(raw), n, b, zlib.crc32(data[4 * (end - n) : 4 * end]), hashlib.sha256(back).hexdigest(), back == raw)):
                    out[name].append(x)
        return out | {"doc_id": batch.column("doc_id")}

    return per_batch(spark, documents(df, id_col, text_col), DIGEST, work)
