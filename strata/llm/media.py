"""Media columns: signature sniffing, validation, carving, and lossless storage of bytes as samples.

An Aho-Corasick automaton finds the magic bytes of all formats in one pass over a value. At each place that it finds, the
format's validator walks the structure (chunks, blocks, pages, headers) and tells the length, or that it is none. Valid
media that do not lie in earlier ones are carved; one that is the whole value gives its type, whatever was declared.

Defined results: a null or empty value holds no media and has no type; a value of which nothing is valid keeps no
type either, for a declared type alone is no evidence; media of any length are walked, not searched for their end,
where the format tells lengths; of two formats at one place the one listed first counts; an empty table gives an empty
result. Time is linear in a value. Repeated rows give repeated results. Columns other than those named are neither read nor returned.
"""

from __future__ import annotations

import bisect
import functools
import hashlib
import math
import re
import struct
import zlib
from collections.abc import Callable

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strata.llm.common import as_bytes, documents, narrow, per_batch

#: Samples of a row of a stored image: 64 pixels of three.
ROW = 192


def png_length(data: bytes, at: int) -> int | None:
    """Chunks with right CRCs from IHDR to IEND."""
    i, first = at + 8, True
    while i + 12 <= len(data):
        size, kind = struct.unpack_from(">I4s", data, i)
        if first != (kind == b"IHDR") or i + 12 + size > len(data):
            return None
        if zlib.crc32(memoryview(data)[i + 4 : i + 8 + size]) != struct.unpack_from(">I", data, i + 8 + size)[0]:
            return None
        i, first = i + 12 + size, False
        if kind == b"IEND":
            return i - at
    return None


def gif_length(data: bytes, at: int) -> int | None:
    """Colour tables, extensions and images up to the trailer."""
    if at + 13 > len(data):
        return None
    table = lambda flags: 3 << (flags & 7) + 1 if flags & 0x80 else 0
    i = at + 13 + table(data[at + 10])
    while i < len(data):
        kind = data[i]
        if kind == 0x3B:
            return i + 1 - at
        if kind == 0x21:
            i += 2
        elif kind == 0x2C and i + 10 < len(data):
            i += 11 + table(data[i + 9])
        else:
            return None
        while i < len(data) and data[i]:
            i += data[i] + 1
        i += 1
    return None


def jpeg_length(data: bytes, at: int) -> int | None:
    """Marker segments to a scan, and from there to the end marker."""
    i = at + 2
    while i + 4 <= len(data):
        if data[i] != 0xFF or data[i + 1] < 0xC0 or data[i + 1] in (0xD8, 0xD9):
            return None
        size = struct.unpack_from(">H", data, i + 2)[0]
        if size < 2:
            return None
        scan, i = data[i + 1] == 0xDA, i + 2 + size
        while scan:
            i = data.find(b"\xff", i)
            if i < 0 or i + 1 >= len(data):
                return None
            if data[i + 1] == 0xD9:
                return i + 2 - at
            if data[i + 1] and not 0xD0 <= data[i + 1] <= 0xD7 and data[i + 1] != 0xFF:
                break
            i += 1 if data[i + 1] == 0xFF else 2
    return None


def bmp_length(data: bytes, at: int) -> int | None:
    """A header whose size of file, place of pixels and image size agree."""
    if at + 54 > len(data):
        return None
    size, spare, pixels, header, width, height, planes, bits, packed = struct.unpack_from("<IIIIiiHHI", data, at + 2)
    if spare or header not in (40, 52, 56, 108, 124) or planes != 1 or bits not in (1, 4, 8, 16, 24, 32) or width <= 0 or not height:
        return None
    if not 14 + header <= pixels <= size <= len(data) - at:
        return None
    return size if packed or pixels + (width * bits + 31) // 32 * 4 * abs(height) == size else None


def riff_length(data: bytes, at: int) -> int | None:
    """Chunks that fill the list exactly; a WAVE has its format before its samples."""
    if at + 12 > len(data):
        return None
    size, form = struct.unpack_from("<I4s", data, at + 4)
    end, i, seen = at + 8 + size, at + 12, []
    if end > len(data) or form not in (b"WAVE", b"WEBP", b"AVI "):
        return None
    while i + 8 <= end:
        kind, length = struct.unpack_from("<4sI", data, i)
        seen.append(kind)
        i += 8 + length + length % 2
    if i not in (end, end + 1) or form == b"WAVE" and (b"fmt " not in seen or b"data" not in seen or seen.index(b"fmt ") > seen.index(b"data")):
        return None
    return end - at


def ogg_length(data: bytes, at: int) -> int | None:
    """Pages of one stream, from its first to its last."""
    i = at
    while i + 27 <= len(data) and data.startswith(b"OggS\0", i):
        flags, n = data[i + 5], data[i + 26]
        if (i == at) != bool(flags & 2) or i + 27 + n > len(data):
            return None
        i += 27 + n + sum(data[i + 27 : i + 27 + n])
        if i > len(data):
            return None
        if flags & 4:
            return i - at
    return None


def gzip_length(data: bytes, at: int) -> int | None:
    """One member that unpacks and whose check sum is right; unpacked piece by piece."""
    unpack, i = zlib.decompressobj(31), at
    try:
        todo = b""
        while not unpack.eof:
            todo = unpack.unconsumed_tail or data[i : i + 65536]
            if not todo:
                return None
            i += 0 if unpack.unconsumed_tail else len(todo)
            unpack.decompress(todo, 1 << 20)
    except zlib.error:
        return None
    return i - at - len(unpack.unused_data)


def pdf_length(data: bytes, at: int) -> int | None:
    """From the header to the end mark after the place of the cross-reference table."""
    tables, ends = _pdf_marks(data)
    k = bisect.bisect_left(tables, at)
    j = bisect.bisect_left(ends, tables[k]) if k < len(tables) else len(ends)
    return ends[j] + 5 - at if j < len(ends) else None


@functools.lru_cache(maxsize=1)
def _pdf_marks(data: bytes) -> tuple[list[int], list[int]]:
    """Places of both marks, found once a value, however many headers it has."""
    return [m.start() for m in re.finditer(b"startxref", data)], [m.start() for m in re.finditer(b"%%EOF", data)]


Validator = Callable[[bytes, int], "int | None"]

# Magic bytes of each media type.
FORMATS: dict[str, tuple[tuple[bytes, ...], Validator]] = {
    "image/png": ((b"\x89PNG\r\n\x1a\n",), png_length),
    "image/gif": ((b"GIF87a", b"GIF89a"), gif_length),
    "image/jpeg": ((b"\xff\xd8\xff",), jpeg_length),
    "image/bmp": ((b"BM",), bmp_length),
    "riff": ((b"RIFF",), riff_length),
    "audio/ogg": ((b"OggS",), ogg_length),
    "application/gzip": ((b"\x1f\x8b\x08",), gzip_length),
    "application/pdf": ((b"%PDF-",), pdf_length),
}
RIFF_TYPES = {b"WAVE": "audio/wav", b"WEBP": "image/webp", b"AVI ": "video/avi"}


@functools.cache
def signatures() -> ahocorasick.Automaton:
    found = ahocorasick.Automaton()
    for kind, (magics, _) in FORMATS.items():
        for magic in magics:
            found.add_word(magic.decode("latin-1"), (len(magic), kind))
    found.make_automaton()
    return found


def carve(data: bytes) -> list[tuple[str, int, int]]:
    """(type, offset, length) of the valid media in data that lie in no earlier one."""
    out: list[tuple[str, int, int]] = []
    end = 0
    for last, (size, kind) in signatures().iter(data.decode("latin-1")):
        at = last - size + 1
        if at >= end and (length := FORMATS[kind][1](data, at)):
            out.append((RIFF_TYPES[data[at + 8 : at + 12]] if kind == "riff" else kind, at, length))
            end = at + length
    return out


SNIFFED = "doc_id long, declared string, media_type string, corrected boolean, carved array<struct<kind:string,offset:long,length:long>>"


def media_type(data: bytes, carved: list[tuple[str, int, int]]) -> str | None:
    """The type of a value that is one medium."""
    return carved[0][0] if carved and carved[0][1:] == (0, len(data)) else None


def sniff(spark: SparkSession, df: DataFrame, id_col: str = "doc_id", media_col: str = "media", declared_col: str = "declared") -> DataFrame:
    """One row a value: its type by its bytes, whether that corrects what was declared, and the media in it."""
    rows = narrow(df, doc_id=id_col, media=media_col, declared=declared_col).withColumn("doc_id", F.col("doc_id").cast("long"))

    def work(batch: pa.RecordBatch) -> dict:
        values = [x or b"" for x in batch.column("media").to_pylist()]
        found = [carve(v) for v in values]
        types = [media_type(v, c) for v, c in zip(values, found)]
        return {"doc_id": batch.column("doc_id"), "declared": batch.column("declared"), "media_type": types, "corrected": [t is not None and t != d for t, d in zip(types, batch.column("declared").to_pylist())], "carved": [[{"kind": k, "offset": a, "length": n} for k, a, n in c] for c in found]}

    return per_batch(spark, rows, SNIFFED, work)


def payload_of(text: bytes) -> bytes:
    """The text, and spaces up to a positive multiple of a row."""
    return text + b" " * (-len(text) % ROW if text else ROW)


def write_png(samples: bytes) -> bytes:
    chunk = lambda kind, data: struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))
    rows = np.zeros((len(samples) // ROW, ROW + 1), np.uint8)
    rows[:, 1:] = np.frombuffer(samples, np.uint8).reshape(-1, ROW)
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", ROW // 3, len(rows), 8, 2, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(rows.tobytes(), 1)) + chunk(b"IEND", b"")


def read_png(data: bytes) -> bytes:
    i, parts, width = 8, [], 0
    while i < len(data):
        size, kind = struct.unpack_from(">I4s", data, i)
        if kind == b"IHDR":
            width, _, bits, colour, _, _, laced = struct.unpack_from(">IIBBBBB", data, i + 8)
            if bits != 8 or colour not in (0, 2) or laced:
                raise ValueError("only plain images of 8-bit samples are read back")
            width *= 3 if colour == 2 else 1
        elif kind == b"IDAT":
            parts.append(data[i + 8 : i + 8 + size])
        i += 12 + size
    rows = np.frombuffer(zlib.decompress(b"".join(parts)), np.uint8).reshape(-1, width + 1)
    if rows[:, 0].any():
        raise ValueError("only unfiltered rows are read back")
    return rows[:, 1:].tobytes()


def write_bmp(samples: bytes) -> bytes:
    rows = np.frombuffer(samples, np.uint8).reshape(-1, ROW)
    return b"BM" + struct.pack("<IIIIiiHHIIiiII", 54 + len(samples), 0, 54, 40, ROW // 3, len(rows), 1, 24, 0, len(samples), 2835, 2835, 0, 0) + rows[::-1].tobytes()


def read_bmp(data: bytes) -> bytes:
    pixels, _, width, height, _, bits = struct.unpack_from("<IIiiHH", data, 10)
    if bits != 24 or height < 0:
        raise ValueError("only 24-bit images from the bottom up are read back")
    rows = np.frombuffer(data, np.uint8, offset=pixels).reshape(height, -1)
    return rows[::-1, : 3 * width].tobytes()


def write_wav(samples: bytes, rate: int = 8000) -> bytes:
    odd = b"\0" * (len(samples) % 2)
    return b"RIFF" + struct.pack("<I4s", 36 + len(samples) + len(odd), b"WAVE") + struct.pack("<4sIHHIIHH", b"fmt ", 16, 1, 1, rate, rate, 1, 8) + struct.pack("<4sI", b"data", len(samples)) + samples + odd


def read_wav(data: bytes) -> bytes:
    i = 12
    while i + 8 <= len(data):
        kind, size = struct.unpack_from("<4sI", data, i)
        if kind == b"data":
            return data[i + 8 : i + 8 + size]
        i += 8 + size + size % 2
    raise ValueError("no samples")


STORES = {"image/png": (write_png, read_png), "image/bmp": (write_bmp, read_bmp), "audio/wav": (write_wav, read_wav)}


def stored_form(payload: bytes) -> tuple[bytes, str]:
    """A value that holds the payload, and a type declared for it. Equal payloads are stored alike.

    The payload's CRC picks the format, a declared type that may be another, and whether the medium stands alone or in a carrier.
    """
    mark, kinds = zlib.crc32(payload), [*STORES]
    value = STORES[kinds[mark % 3]][0](payload)
    if mark >> 16 & 3 == 0:
        value = b"carrier %08x\n" % mark + value + b"\nend"
    return value, kinds[(mark >> 8) % 3]


def store(spark: SparkSession, df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A media column for each document: doc_id, media, declared, n_bytes of the text."""

    def work(batch: pa.RecordBatch) -> dict:
        texts = as_bytes(batch.column("text"))
        forms = [stored_form(payload_of(t)) for t in texts]
        return {"doc_id": batch.column("doc_id"), "media": [m for m, _ in forms], "declared": [d for _, d in forms], "n_bytes": [len(t) for t in texts]}

    return per_batch(spark, documents(df, id_col, text_col), "doc_id long, media binary, declared string, n_bytes long", work)


def of_samples(payload: bytes) -> str:
    """Mean, spread, and of 256 values those that occur; then the shares (in 1000) of four ranges of values, and of samples unlike the one before."""
    x, v = np.frombuffer(payload, np.uint8), np.arange(256)
    counts = np.bincount(x, minlength=256)
    mean, square = int(counts @ v), int(counts @ (v * v))
    ranges = (1000 * counts.reshape(4, 64).sum(1) // len(x)).tolist()
    spread = math.isqrt((len(x) * square - mean * mean) // (len(x) * len(x)))
    return f"mean={mean // len(x)};spread={spread};values={int((counts > 0).sum())};ranges={'/'.join(map(str, ranges))};changes={1000 * int((x[1:] != x[:-1]).sum()) // len(x)}"


DIGEST = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, declared string, media_type string"


def read_back(spark: SparkSession, stored: DataFrame) -> DataFrame:
    """For each stored value: what it holds, found by its bytes alone, and digests of both."""

    def work(batch: pa.RecordBatch) -> dict:
        out: dict[str, list] = {name: [] for name in ("payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "media_type")}
        for value, declared in zip(batch.column("media").to_pylist(), batch.column("declared").to_pylist()):
            carved = carve(value)
            kind, at, length = next(c for c in carved if c[0] in STORES)
            payload = STORES[kind][1](value[at : at + length])
            said = f"{declared}>{kind};" + ",".join(f"{k}@{a}+{n}" for k, a, n in carved) + ";" + of_samples(payload)
            for name, x in zip(out, (len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:]), len(value), hashlib.sha256(value).hexdigest(), said, media_type(value, carved))):
                out[name].append(x)
        return out | {c: batch.column(c) for c in ("doc_id", "n_bytes", "declared")}

    return per_batch(spark, stored, DIGEST, work)
