"""Tables in the folder that driver and executors share."""

from __future__ import annotations

import atexit
import contextlib
import contextvars
import functools
import os
import tempfile
import uuid
from collections.abc import Iterator
from pathlib import Path

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F


def workers_see_package(spark: SparkSession) -> None:
    """Python workers started from now on can import this package from where the driver has it."""
    root = str(Path(__file__).resolve().parents[1])
    env = spark.sparkContext.environment
    paths = [p for p in env.get("PYTHONPATH", "").split(os.pathsep) if p]
    if root not in paths:
        env["PYTHONPATH"] = os.pathsep.join([root, *paths])


def shared_folder(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir. Where it is unset, a temporary one in local mode, and an error on a cluster, whose executors would not see it."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    return (folder or own_folder(spark.sparkContext.master)).rstrip("/")


def own_folder(master: str) -> str:
    if not master.startswith("local") or master.startswith("local-cluster"):
        raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share: tables between steps are written there")
    return _temporary()


@functools.cache
def _temporary() -> str:
    return "file://" + tempfile.mkdtemp(prefix="strata-shared-")


_written: dict[str, tuple[SparkSession, str | None]] = {}
_owner: contextvars.ContextVar[str | None] = contextvars.ContextVar("owner", default=None)


def settle(spark: SparkSession, df: DataFrame, label: str) -> DataFrame:
    """Write df as Parquet to the shared folder and read it back: work is done once, and lost executors lose none of it.

    The files go with release(), with forget(), or when the driver's Python ends.
    """
    path = f"{shared_folder(spark)}/strata/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    _written[path] = (spark, _owner.get())
    out = spark.read.schema(df.schema).parquet(path)
    out.settled_at = path
    return out


def settle_marked(spark: SparkSession, df: DataFrame, label: str, *columns: str) -> tuple[DataFrame, tuple]:
    """settle(), and the count and sum of hashes of the rows, found as they are written: equal for equal tables."""
    seen = Observation()
    out = settle(spark, df.observe(seen, F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64(*columns).cast("decimal(38,0)")).alias("h")), label)
    return out, (seen.get["n"], seen.get["h"])


def release(*tables: DataFrame | None) -> None:
    """Delete settled tables that nothing reads any more."""
    for table in tables:
        path = getattr(table, "settled_at", None)
        if path in _written:
            _delete(path)


@contextlib.contextmanager
def owned(owner: str) -> Iterator[None]:
    """What is settled within belongs to the owner, for forget()."""
    token = _owner.set(owner)
    try:
        yield
    finally:
        _owner.reset(token)


def forget(owner: str | None = None) -> None:
    """Delete the tables that settle() has written: all, or those of an owner."""
    for path in [p for p, (_, of) in _written.items() if owner is None or of == owner]:
        _delete(path)


def _delete(path: str) -> None:
    spark, _ = _written.pop(path)
    with contextlib.suppress(Exception):  # the session may have ended before
        where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


atexit.register(forget)
