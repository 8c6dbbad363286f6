"""The pipeline's quality stage on long texts whose classes are right and whose words are not."""

import random

import pytest

import corpus_pipeline


@pytest.fixture(scope="module")
def tables(spark, sf):
    """Long documents that the stage keeps, and the same with random letters for letters."""
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    kept = corpus_pipeline.apply_quality_rules(spark, docs, sf)
    rng = random.Random(1)

    def scrambled(text):
        pick = {c: same for same in ("aeiou", "bcdfghjklmnpqrstvwxyz", "AEIOU", "BCDFGHJKLMNPQRSTVWXYZ") for c in same}
        return "".join(rng.choice(pick[c]) if c in pick else c for c in text)

    long = [r for r in kept.select(*docs.columns).collect() if len(r["text"].split()) >= 200 and r["lang"] == "en"][:40]  # other languages have too few here to outweigh so much noise
    odd = [(10**6 + r["doc_id"], scrambled(r["text"]), *r[2:]) for r in long]
    return docs, {r["doc_id"] for r in long}, spark.createDataFrame(odd, docs.schema)


def test_long_texts_without_the_words_of_a_language_go(spark, sf, tables):
    docs, long, odd = tables
    kept = {r["doc_id"] for r in corpus_pipeline.apply_quality_rules(spark, docs.unionByName(odd), sf).collect()}
    assert len(long) > 20 and long <= kept
    assert not [k for k in kept if k >= 10**6]


def test_documents_labelled_good_stay(spark, sf, tables):
    """All that the stage drops of them, a limit without word distances drops too."""
    from strata.llm import quality_rules

    docs = tables[0].join(spark.read.parquet(f"{sf}/labels.parquet").where("quality = 1").select("doc_id"), "doc_id", "left_semi")
    without = quality_rules.keep_by_rules(spark, docs, quality_rules.Rules(least_words=1, word_noise=1e9))
    assert corpus_pipeline.apply_quality_rules(spark, docs, sf).count() == without.count() > 0


def test_other_languages_stay(spark, sf):
    """Prose of a language without a reference, labelled so, beside documents of the four."""
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    rng = random.Random(2)
    words = ["".join(rng.choice("абвгдежзиклмнопрстуя") for _ in range(rng.randint(2, 9))) for _ in range(400)]
    latin = ["".join(rng.choice("aeioulnrstcdm") for _ in range(rng.randint(2, 9))) for _ in range(400)]
    texts = [(lang, ". ".join(" ".join(rng.choice(own) for _ in range(12)) for _ in range(15))) for lang, own in (("ru", words), ("it", latin)) for _ in range(5)]
    more = spark.createDataFrame([(10**6 + k, t, lang, "s", len(t)) for k, (lang, t) in enumerate(texts)], docs.schema)
    kept = {r["doc_id"] for r in corpus_pipeline.apply_quality_rules(spark, docs.unionByName(more), sf).collect()}
    assert {k for k in kept if k >= 10**6} == {10**6 + k for k in range(10)}
