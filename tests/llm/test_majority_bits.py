"""The near-dedup stage links by majority bits, as the operator it is named after, and not by minima only."""

import random

import numpy as np

import corpus_pipeline
from strata.llm import near_copies
from strata.llm.simhash_dedup import fingerprint_of


def test_majority_bits_are_those_of_the_operator():
    rng = np.random.default_rng(4)
    counts = rng.integers(1, 90, 200)
    hashes = rng.integers(0, 1 << 63, counts.sum(), dtype=np.uint64) * np.uint64(2) + rng.integers(0, 2, counts.sum(), dtype=np.uint64)
    assert (near_copies.majority(hashes, counts).view(np.int64) == fingerprint_of(hashes, counts)).all()


def test_close_texts_are_linked_without_minima(spark, monkeypatch):
    """Long texts with their last word changed, while minima name no pair; what is close in bits and not similar stays."""
    monkeypatch.setattr(near_copies, "candidates", lambda spark, *_: spark.createDataFrame([], "fp_a long, fp_b long"))
    rng = random.Random(9)
    texts = [" ".join(f"w{rng.randrange(10**6)}" for _ in range(600)) for _ in range(20)]
    rows = [(k, t) for k, t in enumerate(texts)] + [(100 + k, t.rsplit(" ", 1)[0] + " other") for k, t in enumerate(texts)]
    once, often = "a b c d e " * 40 + "f g h i j k", "a b c d e " * 40 + "l m n o p q r s"
    rows += [(200, once), (201, often)]
    kept = {r["doc_id"] for r in corpus_pipeline.drop_near_duplicates(spark, spark.createDataFrame(rows, "doc_id long, text string"), "").collect()}
    assert kept >= {*range(20), 200, 201}
    assert len(kept) <= 22 + 4  # a changed word moves more than two bits now and then
