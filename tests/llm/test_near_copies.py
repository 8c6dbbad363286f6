"""The near-dedup stage against brute force over all pairs of texts."""

import random

import pytest

import corpus_pipeline
from strata.llm import near_copies
from strata.llm.shingles import shingle_hashes
from strata.llm.simhash_dedup import shingles


def brute_kept(texts):
    """texts: {id: text}; ids that no similar text of a smaller id reaches."""
    sets = {k: set(shingles((t or "").encode(), 5)) for k, t in texts.items()}
    root = {k: k for k in texts}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in sets:
        for b in sets:
            if a < b and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                lo, hi = sorted((find(a), find(b)))
                root[hi] = lo
    return sorted(k for k in root if root[k] == k)


def test_stage_finds_what_brute_force_finds(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    kept = sorted(r["doc_id"] for r in corpus_pipeline.drop_near_duplicates(spark, docs, sf).collect())
    assert kept == brute_kept({r["doc_id"]: r["text"] for r in docs.collect()})


@pytest.mark.parametrize("first, growth", [(1, 3), (4, 4)])
def test_crowds_of_near_copies(spark, first, growth, monkeypatch):
    """Copies of three texts with some of 100 words changed, so that many are similar to few others only."""
    monkeypatch.setattr(near_copies, "LOT", 16)
    rng = random.Random(5)
    texts = {}
    for c in range(3):
        words = [f"w{c}x{rng.randrange(10**6)}" for _ in range(100)]
        for _ in range(30):
            own = list(words)
            for k in rng.sample(range(100), rng.choice([1, 1, 2, 2, 3, 4])):
                own[k] = f"n{rng.randrange(10**6)}"
            texts[len(texts)] = " ".join(own)
    expected = brute_kept(texts)
    assert len(expected) < len(texts)
    table = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    assert sorted(r["doc_id"] for r in near_copies.keep_one_of_similar(spark, table, first=first, growth=growth).collect()) == expected


def test_odd_texts(spark):
    """Rows of one doc_id are judged by their texts; a row without one stays if no other of its group has one."""
    rows = [(1, None, "a"), (2, "", "b"), (3, " \n", "c"), (4, "one two", "d"), (5, "One  two", "e"), (None, "one two", "f"), (4, "one two", "g"), (4, "other words", "h"), (None, "alone", "i"), (1 << 63 - 1, "far", "j")]
    table = spark.createDataFrame(rows, "doc_id long, text string, n string").selectExpr("*", "named_struct('a b', 1) fp", "n Uid")
    kept = near_copies.keep_one_of_similar(spark, table)
    assert kept.dtypes == table.dtypes
    found = [(r["doc_id"], r["text"]) for r in kept.collect()]
    assert sorted(found, key=str) == sorted([(1, None), (4, "one two"), (4, "other words"), (None, "alone"), (1 << 63 - 1, "far")], key=str)
    assert near_copies.keep_one_of_similar(spark, table.limit(0)).count() == 0


def test_shingles_are_equal_where_their_words_are():
    """Hashes against tuples of words, over windows, long words and all kinds of white space."""
    rng = random.Random(3)
    vocabulary = [b"a", b"B", "é".encode(), b"word", b"x" * 5000, b"w" * 70]
    texts = [b"", b" \n"] + [b"".join(rng.choice(vocabulary).swapcase() + rng.choice([b" ", b"\t", b"\n ", b"\x0b", b"\r\n"]) for _ in range(rng.randrange(40))) for _ in range(60)]
    texts += [b" ".join(vocabulary[rng.randrange(4)] for _ in range(400_000)), b"y" * (3 << 20), b" " + b"y" * (3 << 20) + b" y"]
    hashes, counts = shingle_hashes(texts, 3)
    at, seen, back = 0, {}, {}
    for t, n in zip(texts, counts):
        words = tuple(t.lower().split())
        plain = [words[k : k + 3] for k in range(max(1, len(words) - 2))]
        assert len(plain) == n
        for p, h in zip(plain, hashes[at : at + n].tolist()):
            assert seen.setdefault(p, h) == h and back.setdefault(h, p) == p
        at += n
    assert at == len(hashes)
