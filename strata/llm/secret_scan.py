"""Secret scans by one combined deterministic automaton.

All rules are compiled into one automaton of transition arrays (see automata.py). Texts are cut where a byte brings
every state back to the start, so thousands of pieces are scanned at once, one byte of each a step: all rules in one
pass over the bytes. Only pieces in which a rule has matched are looked at again, with that rule's own automaton, for
the limits of its leftmost non-overlapping matches. A rule with a head is found by it, and its whole pattern, which may
go over cuts, is then matched in the whole text.

Defined results: null and empty texts have no spans; repeated rows give repeated results; spans of different kinds may
overlap, and equal starts are ordered as the kinds are listed; an empty table gives an empty result. Time is linear in a
text's length, also where it has no byte at which it can be cut. Positions count code points, ends are exclusive.
Columns other than those named are neither read nor returned.
"""

from __future__ import annotations

import hashlib
import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, LongType

from strata.llm.automata import Automaton, compile_patterns, matches, resets, scan
from strata.llm.common import as_bytes, documents, give_back, per_batch, place_of, prepare, runs

#: Bytes of a piece, up to the next byte where a text can be cut.
PIECE = 256


@dataclass(frozen=True)
class Rule:
    """A match counts if it has at least `least` bytes after what `prefix` matches at its start.

    A match that fails has still used up its bytes. Lengths are better held here than in the pattern: counters of
    several rules multiply the states of the combined automaton. `head` is the pattern of how every match starts.
    """

    kind: str
    pattern: str
    any_case: bool = False
    prefix: str = ""
    least: int = 0
    head: str = ""


# The form of assignments, and the published forms of providers' keys.
ASSIGN_KEY = r"(?:password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?"
BASE = (
    Rule("assign", ASSIGN_KEY + r"[A-Za-z0-9+/_.=-]+", True, ASSIGN_KEY, 6),
    Rule("access", r"AKIA[A-Z0-9]+", least=20),
    Rule("hex", r"[0-9a-f]{24,}"),
)
PEM_HEAD = r"-----BEGIN [A-Z ]*PRIVATE KEY-----"
#: Up to the END line whatever is between, without it as far as headers and base64 go.
PEM_BODY = r"[A-Za-z0-9+/=:,\x20\t\r\n\\]"
PEM_REST = rf"(?:[^-]*(?:-[^-]+)*-----END [A-Z ]*PRIVATE KEY-----|{PEM_BODY}*(?:-{PEM_BODY}+)*)"
ADDED = (
    Rule("github", r"gh[pousr]_[A-Za-z0-9]+", least=40),
    Rule("slack", r"xox[abprs]-[A-Za-z0-9-]+", least=15),
    Rule("google", r"AIza[A-Za-z0-9_-]+", least=39),
    Rule("stripe", r"[sr]k_(?:live|test)_[A-Za-z0-9]+", least=24),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]+\.eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+"),
    Rule("pem", PEM_HEAD + PEM_REST, head=PEM_HEAD),
)
RULES = BASE + ADDED


@dataclass(frozen=True)
class Scanner:
    rules: tuple[Rule, ...]
    combined: Automaton
    own: tuple[Automaton, ...]
    cuts: np.ndarray


def scanner(rules: tuple[Rule, ...] = RULES) -> Scanner:
    """Compile the rules; done once, on the driver."""
    starts = [(r.head or r.pattern, r.any_case) for r in rules]
    combined = compile_patterns(starts, anywhere=True)
    return Scanner(rules, combined, tuple(compile_patterns([x], anywhere=False) for x in starts), resets(combined))


def pieces(data: np.ndarray, offsets: np.ndarray, cuts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of pieces of the texts data[offsets[i]:offsets[i + 1]], cut after bytes at which it is allowed."""
    after = np.flatnonzero(cuts[data]) + 1
    grid = np.arange(PIECE, len(data), PIECE)
    at = np.searchsorted(after, grid)
    inner = after[at[at < len(after)]]
    limits = np.unique(np.concatenate([offsets, inner]))
    return limits[:-1], limits[1:]


def spans(texts: list[bytes], s: Scanner) -> list[list[tuple[int, int, int]]]:
    """For each text its (start, rule, end) in bytes, sorted."""
    out: list[list[tuple[int, int, int]]] = [[] for _ in texts]
    whole = b"".join(texts)
    if not whole:
        return out
    offsets = np.concatenate([[0], np.cumsum([len(t) for t in texts])])
    starts, ends = pieces(np.frombuffer(whole, np.uint8), offsets, s.cuts)
    found = scan(s.combined, np.frombuffer(whole, np.uint8), starts, ends - starts)
    keys = [re.compile(r.prefix.encode(), re.IGNORECASE) for r in s.rules]
    headed: set[tuple[int, int]] = set()
    for p in np.flatnonzero(found):
        a, b = int(starts[p]), int(ends[p])
        text = int(np.searchsorted(offsets, a, side="right")) - 1
        for k, rule in enumerate(s.rules):
            if found[p] >> k & 1 and rule.head:
                headed.add((text, k))
            elif found[p] >> k & 1:
                for i, j in matches(s.own[k], whole[a:b]):
                    if not rule.least or j - i - keys[k].match(whole, a + i).end() + a + i >= rule.least:
                        out[text].append((a + i - int(offsets[text]), k, a + j - int(offsets[text])))
    for text, k in headed:
        for m in re.finditer(s.rules[k].pattern.encode(), texts[text], re.IGNORECASE if s.rules[k].any_case else 0):
            if m.end() - m.start() >= s.rules[k].least:
                out[text].append((m.start(), k, m.end()))
    for x in out:
        x.sort()
    return out


def in_code_points(text: bytes, found: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    out, byte, point = [], 0, 0
    places = {}
    for at in sorted({x for s, _, e in found for x in (s, e)}):
        point += len(text[byte:at].decode("utf-8", "replace"))
        byte = at
        places[at] = point
    for s, k, e in found:
        out.append((places[s], k, places[e]))
    return out


SCAN = "doc_id long, spans array<struct<kind:string,start:int,end:int>>"


def secret_scan(spark: SparkSession, df: DataFrame, rules: tuple[Rule, ...] = RULES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row a document: its spans by start, then kind as listed."""
    s = spark.sparkContext.broadcast(scanner(rules))

    def work(batch: pa.RecordBatch) -> dict:
        texts = as_bytes(batch.column("text"))
        found = []
        for part in runs(texts):
            found += [in_code_points(t, x) if x else [] for t, x in zip(texts[part], spans(texts[part], s.value))]
        kinds = [r.kind for r in rules]
        return {"doc_id": batch.column("doc_id"), "spans": [[{"kind": kinds[k], "start": a, "end": b} for a, k, b in x] for x in found]}

    return per_batch(spark, documents(df, id_col, text_col), SCAN, work)


def digest(scanned: DataFrame) -> DataFrame:
    """Counts of the base kinds, and spans as text."""
    said = lambda x: F.concat_ws(":", x["kind"], x["start"], x["end"])
    of = lambda kind: F.size(F.filter("spans", lambda x: x["kind"] == kind)).cast("long")
    base = F.filter("spans", lambda x: x["kind"].isin([r.kind for r in BASE]))
    joined = lambda spans: F.concat_ws(",", F.transform(spans, said))
    return scanned.select("doc_id", *[of(r.kind).alias(f"n_{r.kind}") for r in BASE], F.sha2(joined(base), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"))


def redact(spark: SparkSession, df: DataFrame, rules: tuple[Rule, ...] = RULES, text_col: str = "text", mark: str = "[{kind}]") -> DataFrame:
    """df with each span of its texts replaced by its kind's mark, and n_chars, if there and a whole number, counted anew where a text has changed.

    Overlapping spans are one, marked as the first. Null texts stay null; columns keep their order and types.
    """
    prepare(spark)
    s = spark.sparkContext.broadcast(scanner(rules))
    names = df.columns
    flat = df.toDF(*[f"_{i}" for i in range(len(names))])
    at = place_of(df, text_col)
    count = names.index("n_chars") if "n_chars" in names and isinstance(df.schema[names.index("n_chars")].dataType, (IntegerType, LongType)) else None

    def clean(text: bytes, found: list[tuple[int, int, int]]) -> bytes:
        out, end = [], 0
        for a, k, b in found:
            if a >= end:
                out += [text[end:a], mark.format(kind=rules[k].kind).encode()]
            end = max(end, b)
        return b"".join([*out, text[end:]])

    def each(batches):
        for batch in batches:
            column = batch.column(at)
            texts = as_bytes(column)
            new: list[bytes] = []
            changed = []
            for part in runs(texts):
                for t, x in zip(texts[part], spans(texts[part], s.value)):
                    new.append(clean(t, x) if x else t)
                    changed.append(bool(x))
            columns = list(batch.columns)
            columns[at] = pa.array([t if v else None for t, v in zip(new, column.is_valid().to_pylist())], pa.binary()).cast(column.type)
            if count is not None:
                old = columns[count]
                columns[count] = pa.array([len(t.decode()) if c else o for t, c, o in zip(new, changed, old.to_pylist())], old.type)
            yield pa.RecordBatch.from_arrays(columns, schema=batch.schema)
        give_back()

    return flat.mapInArrow(each, flat.schema).toDF(*names)
