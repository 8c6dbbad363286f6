"""Keyed tables of runs: in memory, or as Parquet partitioned by key, so that one run is read without the others."""

from __future__ import annotations

import math
from collections.abc import Iterator
from pathlib import Path
from typing import Protocol

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strata.sources import text


class Store(Protocol):
    def put(self, rows: DataFrame) -> None: ...
    def get(self, run: int) -> DataFrame: ...
    def keys(self) -> list[int]: ...
    def table(self) -> DataFrame | None: ...


class MemoryStore:
    """Tables as they are, by run, in the order of their keys."""

    def __init__(self) -> None:
        self._rows: DataFrame | None = None

    def put(self, rows: DataFrame) -> None:
        """Add rows; runs that are there already are replaced."""
        old = self._rows
        self._rows = rows if old is None else old.join(rows.select("run").distinct(), "run", "left_anti").select(*rows.columns).unionByName(rows)

    def get(self, run: int) -> DataFrame:
        if run not in self.keys():
            raise KeyError(run)
        return self._rows.where(F.col("run") == run)

    def keys(self) -> list[int]:
        return [] if self._rows is None else [r["run"] for r in self._rows.select("run").distinct().orderBy("run").collect()]

    def table(self) -> DataFrame | None:
        return self._rows

    def __iter__(self) -> Iterator[int]:
        return iter(self.keys())

    def __len__(self) -> int:
        return len(self.keys())

    def __contains__(self, run: int) -> bool:
        return run in self.keys()


class ParquetStore(MemoryStore):
    """The same in a folder, one partition a run; what is there already is found when the store is opened."""

    def __init__(self, spark: SparkSession, path: str):
        self._spark, self.path = spark, path.rstrip("/")

    def _exists(self) -> bool:
        where = self._spark.sparkContext._jvm.org.apache.hadoop.fs.Path(self.path)
        return where.getFileSystem(self._spark.sparkContext._jsc.hadoopConfiguration()).exists(where)

    def put(self, rows: DataFrame) -> None:
        rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("run").parquet(self.path)

    def get(self, run: int) -> DataFrame:
        if run not in self.keys():
            raise KeyError(run)
        return self.table().where(F.col("run") == run)

    def keys(self) -> list[int]:
        """Runs in numeric order."""
        return sorted(r["run"] for r in self.table().select("run").distinct().collect()) if self._exists() else []

    def table(self) -> DataFrame | None:
        return self._spark.read.parquet(self.path) if self._exists() else None


class Codec(Protocol):
    """How a value becomes files and back; `extension` is of the file that tells that a key is there."""

    extension: str

    def write(self, value, path: str) -> None: ...
    def read(self, spark: SparkSession, path: str): ...


class ScoreMapCodec:
    """Tables (gene, score) as lines of name and score; negative scores come back too."""

    extension = ".tsv"

    def write(self, value: DataFrame, path: str) -> None:
        text.save_gene_score(path, value)

    def read(self, spark: SparkSession, path: str) -> DataFrame:
        return text.load_gene_score(spark, path, -math.inf)


class HierarchyCodec:
    """Trees (child, parent, height) and their leaves (idx, gene), as <key>.edges.tsv and <key>.genes.tsv."""

    extension = ".edges.tsv"

    @classmethod
    def genes(cls, path: str) -> str:
        if not path.endswith(cls.extension):
            raise ValueError(f"{path} does not end in {cls.extension}")
        return path.removesuffix(cls.extension) + ".genes.tsv"

    def write(self, value: tuple[DataFrame, DataFrame], path: str) -> None:
        tree, leaves = value
        text.save_index_gene(self.genes(path), leaves)
        text.save_edge_list(path, tree.select(F.col("child").alias("src"), F.col("parent").alias("dst"), F.col("height").alias("weight")))

    def read(self, spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
        tree = text.load_edge_list(spark, path).select(F.col("src").alias("child"), F.col("dst").alias("parent"), F.col("weight").alias("height"))
        return tree, text.load_index_gene(spark, self.genes(path))[0]


class DiskStore:
    """Small results by string keys, a file (or pair) each, in a folder that Spark reaches; keys in the order of their characters.

    Values are read when they are asked for. Files that are there when the store is opened are keys like any others.
    """

    def __init__(self, spark: SparkSession, folder: str, codec: Codec):
        self._spark, self.codec = spark, codec
        self.folder = str(folder).rstrip("/") if "://" in str(folder) else f"file://{Path(folder).absolute()}"

    def _path(self, key: str) -> str:
        return f"{self.folder}/{key}{self.codec.extension}"

    def put(self, key: str, value) -> None:
        self.codec.write(value, self._path(key))

    def get(self, key: str):
        if key not in self:
            raise KeyError(key)
        return self.codec.read(self._spark, self._path(key))

    __getitem__ = get

    def keys(self) -> list[str]:
        context = self._spark.sparkContext
        where = context._jvm.org.apache.hadoop.fs.Path(self.folder)
        files = where.getFileSystem(context._jsc.hadoopConfiguration())
        names = [x.getPath().getName() for x in files.listStatus(where)] if files.exists(where) else []
        return sorted(n.removesuffix(self.codec.extension) for n in names if n.endswith(self.codec.extension) and not n.startswith("."))

    def __iter__(self) -> Iterator[tuple]:
        return ((key, self.get(key)) for key in self.keys())

    def __len__(self) -> int:
        return len(self.keys())

    def __contains__(self, key: str) -> bool:
        return key in self.keys()

    def close(self) -> None:
        """Nothing is held open."""


def missing(spark: SparkSession, store: Store, runs: list[int]) -> list[int]:
    """Runs that are not in the store."""
    there = set(store.keys())
    return [r for r in runs if r not in there]


def save_matrix(similarity: DataFrame, path: str, name: str = "PPR") -> None:
    """Replace the matrix of that name among those of the folder, in single precision."""
    cells = similarity.select("i", "j", F.col("p").cast("float").alias("p"), F.lit(name).alias("name"))
    cells.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("name").parquet(path)


def load_matrix(spark: SparkSession, path: str, name: str = "PPR") -> DataFrame:
    found = spark.read.parquet(path).where(F.col("name") == name).drop("name")
    if found.isEmpty():
        raise KeyError(name)
    return found
