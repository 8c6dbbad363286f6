"""The pipeline's rows against plain versions of its stages, one after another."""

import zlib

import numpy as np
from pyspark.sql import functions as F

import corpus_pipeline
from strata.llm import language_id, quality_rules, secret_scan
from strata.llm.common import documents
from tests.llm.test_near_copies import brute_kept
from tests.llm.test_operators import plain_spans


def plain_redaction(text):
    out, end = [], 0
    for a, k, b in plain_spans(text):
        if a >= end:
            out += [text[end:a], f"[{secret_scan.RULES[k].kind}]"]
        end = max(end, b)
    return "".join([*out, text[end:]])


def test_stages_and_run(spark, sf):
    import public_tokenizers
    from tokenizers import Tokenizer

    docs = spark.read.parquet(f"{sf}/documents.parquet")
    names = docs.columns
    rows = {r["doc_id"]: r.asDict() for r in docs.collect()}

    model = language_id.train(spark, documents(docs, lang="lang"), F.lit(True))
    found, score = model.score([r["text"] or "" for r in rows.values()])
    rows = {k: r for (k, r), lang, s in zip(rows.items(), found, score) if lang != "und" and s >= 0.4}

    left = spark.createDataFrame([tuple(r.values()) for r in rows.values()], docs.schema)
    kept = {r["doc_id"] for r in quality_rules.quality_rules(spark, left, quality_rules.KEEP_SHORT).where("kept").collect()}
    rows = {k: r for k, r in rows.items() if k in kept}
    assert 0 < len(rows) < docs.count()

    rows = {k: rows[k] for k in brute_kept({k: r["text"] for k, r in rows.items()})}

    for r in rows.values():
        text = plain_redaction(r["text"])
        r |= {"n_chars": len(text) if text != r["text"] else r["n_chars"], "text": text}

    got = docs
    for _, stage in corpus_pipeline.STAGES[:-1]:
        got = stage(spark, got, sf)
        assert got.columns == names and got.dtypes == docs.dtypes
    assert {r["doc_id"]: r.asDict() for r in got.collect()} == rows

    plain = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    pieces = sorted(corpus_pipeline.run(spark, sf).collect(), key=lambda r: (r["sequence_id"], r["offset"]))
    assert {r["doc_id"] for r in pieces} == set(rows)
    at = 0
    for r in pieces:
        assert r["sequence_id"] * 2048 + r["offset"] == at
        at += r["length"]
        ids = plain.encode(rows[r["doc_id"]]["text"], add_special_tokens=False).ids + [1]
        assert r["doc_tokens"] == len(ids) and r["ids_crc32"] == zlib.crc32(np.array(ids[r["start"] : r["start"] + r["length"]], "<u4").tobytes())
    assert at == sum({r["doc_id"]: r["doc_tokens"] for r in pieces}.values())


def test_stages_of_odd_tables(spark):
    """Empty tables, nulls, repeated rows and clashing columns come through every stage."""
    schema = "doc_id long, text string, lang string, source string, n_chars long, fp long, TEXT string"
    prose = "The council of the town met in the old hall and spoke of the road to the river with all who came that day. "
    rows = [(1, None, None, "s", 0, 1, "x"), (2, "", "en", None, 0, 1, "x"), (3, prose * 2 + "a b c", "en", "s", 5, 1, None)] + [(4, prose + "one two three four " * 2 + "some more words at the end of this one text, all of them other than before, by and by", "en", "s", 5, 1, "x")] * 2 + [(None, prose + " ".join(f"w{k}" for k in range(60)), None, "s", 5, 1, "x")]
    for table in (spark.createDataFrame([], schema), spark.createDataFrame(rows, schema)):
        docs = table
        for name, stage in corpus_pipeline.STAGES:
            docs = stage(spark, docs, "")
            if name != "packing":
                assert docs.columns == table.columns
        assert docs.count() >= 0
