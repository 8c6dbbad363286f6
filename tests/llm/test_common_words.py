"""Common words of a language are those of all its documents."""

import random
from collections import Counter

import pytest

from strata.llm import quality_rules


@pytest.mark.parametrize("held", [quality_rules.CACHE_ENTRIES, 50])
def test_no_document_is_left_out(spark, held, monkeypatch):
    """More documents than were drawn once, of words that are nearly equally common; forms of a word count once a document."""
    monkeypatch.setattr(quality_rules, "CACHE_ENTRIES", held)
    rng = random.Random(11)
    rows = [(k, " ".join(rng.choice(["{}", "{},", '"{}"']).format(f"W{rng.randrange(90)}") for _ in range(12)) + " --", "en") for k in range(6000)]
    rows += [(7000 + k, f"uno dos {k}", "es") for k in range(20)] + [(8000, None, "es"), (8001, "w1", None)] + [(9000 + k, "w1", "xx") for k in range(19)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    counts = {"en": Counter(), "es": Counter()}
    for _, text, lang in rows:
        if lang in counts:
            counts[lang].update({w.lower().strip(quality_rules.EDGES) for w in (text or "").split()} - {""})
    rules = quality_rules.Rules()
    assert quality_rules.learn_words(spark, docs, rules) == {lang: sorted(c, key=lambda w: (-c[w], w))[: rules.common_words] for lang, c in counts.items()}
