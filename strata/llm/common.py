"""What the operators share: column picking and Arrow batches of texts."""

from __future__ import annotations

import contextlib
import ctypes
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from strata.tables import release, settle, workers_see_package  # noqa: F401

#: Texts are worked on in runs of about this many bytes, which bounds the arrays made per byte.
RUN_BYTES = 2 << 20
#: Rows of a batch between Spark and Python where the session has the default, which is meant for narrower rows than texts.
BATCH_ROWS = 2000
#: A worker forgets what it knows of distinct chunks beyond this many.
CACHE_ENTRIES = 400_000


def narrow(df: DataFrame, **wanted: str) -> DataFrame:
    """Columns of df under new names: narrow(df, doc_id="doc_id", text="body").

    Names are matched exactly, then without case; of equal names the first column counts. So other columns
    never clash, whatever they are called.
    """
    flat = df.toDF(*[f"_{i}" for i in range(len(df.columns))])
    return flat.select(*[F.col(f"_{place_of(df, source)}").alias(target) for target, source in wanted.items()])


def place_of(df: DataFrame, name: str) -> int:
    names, lower = df.columns, [n.lower() for n in df.columns]
    if name in names:
        return names.index(name)
    if name.lower() not in lower:
        raise ValueError(f"no column {name!r} in {names}")
    return lower.index(name.lower())


def documents(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", **more: str) -> DataFrame:
    """doc_id as long and text as string, with more columns as named."""
    out = narrow(df, doc_id=id_col, text=text_col, **more)
    return out.withColumns({"doc_id": F.col("doc_id").cast("long"), "text": F.col("text").cast("string")})


def as_bytes(column: pa.Array) -> list[bytes]:
    """UTF-8 of each text; null: empty."""
    return [x or b"" for x in column.cast(pa.binary()).to_pylist()]


def as_texts(column: pa.Array) -> list[str]:
    return [x or "" for x in column.to_pylist()]


def runs(texts: list, most: int = RUN_BYTES) -> Iterator[slice]:
    """Slices of consecutive texts of about `most` units together; a longer text stands alone."""
    return runs_of(list(map(len, texts)), most)


def runs_of(lengths: list[int], most: int = RUN_BYTES) -> Iterator[slice]:
    start, held = 0, 0
    for i, n in enumerate(lengths):
        if held and held + n > most:
            yield slice(start, i)
            start, held = i, 0
        held += n
    if start < len(lengths):
        yield slice(start, len(lengths))


def sums(values: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Sums over consecutive groups of the given sizes; empty groups give 0."""
    total = np.concatenate([[0], np.cumsum(values)])
    ends = np.cumsum(counts)
    return total[ends] - total[ends - counts]


def ranges(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """start, start + 1, ... for each of the ranges, one after another."""
    total = int(lengths.sum())
    if not total:
        return np.zeros(0, np.int64)
    ends = np.cumsum(lengths)
    return np.arange(total, dtype=np.int64) + np.repeat(starts - (ends - lengths), lengths)


def prepare(spark: SparkSession) -> None:
    """What Python workers need: the package, and batches that suit texts."""
    workers_see_package(spark)
    if spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch") == "10000":
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))


def give_back() -> None:
    """Return freed memory to the system at the end of a task: workers are used again, by other stages too."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # other C libraries have no such call
        ctypes.CDLL(None).malloc_trim(0)


def per_batch(spark: SparkSession, df: DataFrame, schema: str | StructType, work: Callable[[pa.RecordBatch], dict]) -> DataFrame:
    """mapInArrow with a function from a batch to columns of the schema."""
    prepare(spark)
    arrow = to_arrow(spark, schema)

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                made = work(batch)
                yield pa.RecordBatch.from_arrays([made[f.name] if isinstance(made[f.name], pa.Array) else pa.array(made[f.name], f.type, from_pandas=False) for f in arrow], schema=arrow)
        give_back()

    return df.mapInArrow(each, schema)


def to_arrow(spark: SparkSession, schema: str | StructType) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema

    return to_arrow_schema(StructType.fromDDL(schema) if isinstance(schema, str) else schema)


def keep_rows(spark: SparkSession, df: DataFrame, mask: Callable[..., np.ndarray], *columns: str) -> DataFrame:
    """The rows of df for which mask(arrays of the columns) holds; all columns stay as they are, whatever their names."""
    prepare(spark)
    places = [place_of(df, c) for c in columns]
    flat = df.toDF(*[f"_{i}" for i in range(len(df.columns))])

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                yield batch.filter(pa.array(np.asarray(mask(*[batch.column(i) for i in places]), bool)))
        give_back()

    return flat.mapInArrow(each, flat.schema).toDF(*df.columns)


def extend(spark: SparkSession, df: DataFrame, schema: str, work: Callable[..., dict], *columns: str) -> DataFrame:
    """df's columns as _0, _1 ..., and those that work(arrays of the columns) makes."""
    places = [place_of(df, c) for c in columns]
    flat = df.toDF(*[f"_{i}" for i in range(len(df.columns))])
    whole = StructType([*flat.schema.fields, *StructType.fromDDL(schema).fields])
    return per_batch(spark, flat, whole, lambda batch: {name: batch.column(i) for i, name in enumerate(batch.schema.names)} | work(*[batch.column(i) for i in places]))
