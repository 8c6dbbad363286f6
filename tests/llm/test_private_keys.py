"""A private key goes whole: its header, body and END line, also where the END line is missing."""

import base64
import random

import duckdb
import pytest

from strata.llm import secret_scan
from strata.llm.queries import oracle_sql

BODY = base64.b64encode(random.Random(7).randbytes(1200)).decode()
LINES = "\n".join(BODY[i : i + 64] for i in range(0, len(BODY), 64))
HEAD, TAIL = "-----BEGIN RSA PRIVATE KEY-----", "-----END RSA PRIVATE KEY-----"
TEXTS = {
    1: (f"é before\n{HEAD}\n{LINES}\n{TAIL}\nafter, as it was.", "é before\n[pem]\nafter, as it was."),
    2: (f"{HEAD}\r\nProc-Type: 4,ENCRYPTED\r\nDEK-Info: AES-128-CBC,00FF\r\n\r\n{LINES}\r\n{TAIL} tail", "[pem] tail"),
    3: (f"x {HEAD}\n{LINES}", "x [pem]"),
    4: (f'{{"key": "{HEAD}\\n{BODY}\\n{TAIL}\\n"}}', '{"key": "[pem]\\n"}'),
    5: (f"{HEAD}\n{LINES}\n{TAIL}\n(two)\n{HEAD}\n{LINES}\n{TAIL}!", "[pem]\n(two)\n[pem]!"),
    6: ("> " + f"{HEAD}\n{LINES}\n{TAIL}".replace("\n", "\n> ") + "\nso", "> [pem]\nso"),
    7: (f"cut {HEAD}\n{LINES} (more)", "cut [pem](more)"),
    8: (f"{HEAD}\n{LINES}\n{HEAD}\n{LINES}\n{TAIL}.", "[pem][pem]."),
    9: ("no key -----END RSA PRIVATE KEY-----", "no key -----END RSA PRIVATE KEY-----"),
}


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(k, t) for k, (t, _) in TEXTS.items()], "doc_id long, text string")


def test_redaction_leaves_nothing_of_a_key(spark, docs):
    found = {r["doc_id"]: r["text"] for r in secret_scan.redact(spark, docs).collect()}
    assert found == {k: clean for k, (_, clean) in TEXTS.items()}


def test_spans_of_keys_are_those_of_the_sql(spark, docs):
    import pandas as pd

    found = {r["doc_id"]: (r["spans"], r["base_sha256"]) for r in secret_scan.digest(secret_scan.secret_scan(spark, docs)).collect()}
    duck = duckdb.connect()
    duck.register("documents", pd.DataFrame({"doc_id": [*TEXTS], "text": [t for t, _ in TEXTS.values()]}))
    rows = duck.execute(oracle_sql()["op5_secret_scan"]).fetchdf()
    assert found == {r.doc_id: (r.spans, r.base_sha256) for r in rows.itertuples()}
    assert "pem:0:" in found[8][0]
