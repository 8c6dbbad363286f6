"""Hashes of words and of word shingles, whole batches of texts at a time.

A word is a run of bytes other than \\x20 and \\x09-\\x0d, with A-Z in lower case. Its hash is a polynomial in random
values of its bytes, taken from running sums, so no word becomes an object; words of more than LONG bytes go through
XXH64 one by one. Texts are worked on in windows that end between words.
"""

from __future__ import annotations

import functools
import re

import numpy as np
import xxhash

WINDOW = 1 << 20
LONG = 4096
SPACE = re.compile(rb"[\x20\x09-\x0d]")
WHITE = np.isin(np.arange(256), [32, *range(9, 14)])
BASE = 0x9E3779B97F4A7C15
MIX = np.uint64(0xD6E8FEB86659FD93)


def _values() -> np.ndarray:
    """A random odd value for each byte, the same for both cases of A-Z."""
    out = np.random.default_rng(7).integers(0, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    out[65:91] = out[97:123]
    return out


VALUES = _values()


@functools.cache
def powers() -> tuple[np.ndarray, np.ndarray]:
    """BASE ** i and BASE ** -i, modulo 2^64."""
    up = np.full(WINDOW + 1, BASE, np.uint64)
    down = np.full(WINDOW + 1, pow(BASE, -1, 1 << 64), np.uint64)
    up[0] = down[0] = 1
    return np.multiply.accumulate(up), np.multiply.accumulate(down)


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * MIX
    x = (x ^ (x >> np.uint64(29))) * MIX
    return x ^ (x >> np.uint64(32))


def of_word(word: bytes) -> int:
    return xxhash.xxh64_intdigest(word.lower())


def word_hashes(text: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Hash of each word, and where it starts."""
    hashes, starts = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]
    at = 0
    while at < len(text):
        end = min(at + WINDOW, len(text))
        if end < len(text):
            last = max(text.rfind(c, at, end) for c in (b" ", b"\t", b"\n", b"\v", b"\f", b"\r"))
            if last < 0:  # one word fills the window
                found = SPACE.search(text, end)
                end = found.start() if found else len(text)
                hashes.append(np.array([of_word(text[at:end])], np.uint64))
                starts.append(np.array([at]))
                at = end
                continue
            end = last + 1
        data = np.frombuffer(text, np.uint8, end - at, at)
        solid = np.concatenate([[False], ~WHITE[data], [False]])
        limits = np.flatnonzero(solid[1:] != solid[:-1])
        a, b = limits[::2], limits[1::2]
        up, down = powers()
        total = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(VALUES[data] * up[: len(data)], out=total[1:])
        found = mixed((total[b] - total[a]) * down[a] + (b - a).astype(np.uint64))
        for k in np.flatnonzero(b - a > LONG):
            found[k] = of_word(text[at + a[k] : at + b[k]])
        hashes.append(found)
        starts.append(a + at)
        at = end
    return np.concatenate(hashes), np.concatenate(starts)


def shingle_hashes(texts: list[bytes], width: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of each text's shingles, repeats included, and how many each text has: one of the whole for fewer words, one (the same for all) without any."""
    words, starts = word_hashes(b"\n".join(texts))
    sizes = np.array([len(t) + 1 for t in texts], np.int64)
    ends = np.searchsorted(starts, np.cumsum(sizes))
    n = np.diff(ends, prepend=0)
    counts = np.maximum(n - width + 1, 1)
    firsts = np.cumsum(counts) - counts
    # place of each shingle's first word
    at = np.arange(int(counts.sum())) + np.repeat(ends - n - firsts, counts)
    padded = np.concatenate([words, np.zeros(width, np.uint64)])
    out = np.zeros(len(at), np.uint64)
    for k in range(width):
        out = out * np.uint64(BASE) + padded[at + k]
    for i in np.flatnonzero(n < width):
        code = 0
        for w in words[ends[i] - n[i] : ends[i]].tolist():
            code = (code * BASE + w) % (1 << 64)
        out[firsts[i]] = (code + int(n[i])) % (1 << 64)
    return mixed(out), counts
