"""Whitespace-separated text files: readers that drop bad lines, and writers of small results.

Lines that begin with # are comments. Readers take a path, or lines as a table (value, line) in which `line` orders them;
of repeated keys the last line counts. Bad lines are left out, and counted in a warning where a path is read.
"""

from __future__ import annotations

import math
import warnings
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from strata.functions.scores import inverse_height
from strata.operators.ranking import numbered


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """(value, line): the lines of a file, numbered in its order; a file is one line table, however many tasks read it."""
    return spark.read.text(path).select("value", F.monotonically_increasing_id().alias("line"))


def _tokens(lines: DataFrame) -> DataFrame:
    return lines.where(~F.col("value").startswith("#")).withColumn("t", F.filter(F.split(F.trim(F.regexp_replace("value", r"\s+", " ")), " "), lambda x: x != "")).where(F.size("t") > 0)


def _finite(x: Column) -> Column:
    value = x.try_cast("double")
    return F.when(~F.isnan(value) & (F.abs(value) != math.inf), value)


def _integer(x: Column) -> Column:
    return F.when(x.rlike(r"^[+-]?[0-9]+$"), x.try_cast("int"))


def _warn(bad: DataFrame, what: str) -> None:
    n = bad.count()
    if n:
        warnings.warn(f"{n} lines are no {what} and are left out", UserWarning, stacklevel=3)


def parse_index(lines: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(idx, gene) by index and (gene, idx) by name: the last line of each key, for each key on its own."""
    good = _tokens(lines).where(F.size("t") == 2).select(_integer(F.col("t")[0]).alias("idx"), F.col("t")[1].alias("gene"), "line").where("idx is not null")
    return good.groupBy("idx").agg(F.max_by("gene", "line").alias("gene")), good.groupBy("gene").agg(F.max_by("idx", "line").alias("idx"))


def parse_edges(lines: DataFrame, unweighted: bool = False) -> DataFrame:
    """(src, dst, weight, seq): two tokens weigh 1; weights that are not finite numbers are left out; an endpoint that is no integer raises."""
    t = _tokens(lines).where(F.size("t").isin(2, 3))
    end = lambda k: F.coalesce(_integer(F.col("t")[k]), F.raise_error(F.concat(F.lit("an endpoint is no integer: "), "value")).cast("int"))
    weight = F.when(F.size("t") == 2, F.lit(1.0)).otherwise(_finite(F.get("t", F.lit(2))))
    out = t.select(end(0).alias("src"), end(1).alias("dst"), weight.alias("weight"), F.col("line").alias("seq")).where("weight is not null")
    return out.drop("weight") if unweighted else out


def name_edges(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges by name; those with an end that has no name are left out."""
    a, b = nodes.select(F.col("idx").alias("src"), F.col("gene").alias("u")), nodes.select(F.col("idx").alias("dst"), F.col("gene").alias("v"))
    rest = [c for c in edges.columns if c not in ("src", "dst")]
    return edges.join(a, "src").join(b, "dst").select("u", "v", *rest)


def parse_scores(lines: DataFrame, least: float = 0.0) -> DataFrame:
    """(gene, score): finite scores of `least` or more."""
    good = _tokens(lines).where(F.size("t") == 2).select(F.col("t")[0].alias("gene"), _finite(F.col("t")[1]).alias("score"), "line").where(F.col("score") >= least)
    return good.groupBy("gene").agg(F.max_by("score", "line").alias("score"))


def parse_bins(lines: DataFrame) -> DataFrame:
    """(bin_id, gene): a bin a line, tab-separated; empty lines and comments are no bins."""
    own = numbered(lines.sparkSession, lines.where(~F.col("value").startswith("#") & (F.trim("value") != "")), "line", "bin_id")
    return own.select((F.col("bin_id") - 1).alias("bin_id"), F.explode(F.split(F.trim("value"), "\t")).alias("gene"))


def parse_components(lines: DataFrame) -> DataFrame:
    """(gene) of the first line that is no comment: the largest cluster."""
    first = lines.where(~F.col("value").startswith("#")).orderBy("line").limit(1)
    return first.select(F.explode(F.split(F.trim("value"), r"\s+")).alias("gene"))


def _some(df: DataFrame, path: str, what: str) -> DataFrame:
    if df.isEmpty():
        raise ValueError(f"{path} has no {what}")
    return df


def load_index_gene(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    lines = read_lines(spark, path)
    _warn(_tokens(lines).where((F.size("t") != 2) | _integer(F.col("t")[0]).isNull()), "index and name")
    by_index, by_name = parse_index(lines)
    return _some(by_index, path, "nodes"), by_name


def load_edge_list(spark: SparkSession, path: str, nodes: DataFrame | None = None, unweighted: bool = False) -> DataFrame:
    lines = read_lines(spark, path)
    _warn(_tokens(lines).where(~F.size("t").isin(2, 3) | ((F.size("t") == 3) & _finite(F.get("t", F.lit(2))).isNull())), "edge")
    edges = _some(parse_edges(lines, unweighted), path, "edges")
    if nodes is None:
        return edges
    named = name_edges(edges, nodes)
    lost = edges.count() - named.count()
    if lost:
        warnings.warn(f"{lost} edges have an end without a name and are left out", UserWarning, stacklevel=2)
    return named


def load_gene_score(spark: SparkSession, path: str, least: float = 0.0) -> DataFrame:
    lines = read_lines(spark, path)
    _warn(_tokens(lines).where((F.size("t") != 2) | _finite(F.get("t", F.lit(1))).isNull()), "name and score")
    return _some(parse_scores(lines, least), path, "scores")


def load_bins(spark: SparkSession, path: str) -> DataFrame:
    return parse_bins(read_lines(spark, path))


def load_components(spark: SparkSession, path: str) -> DataFrame:
    return parse_components(read_lines(spark, path))


def _write(path: str, lines: list[str], end: str = "") -> None:
    """Small results go to one file, as people read them, in a local folder or a store that Spark reaches; large ones are tables."""
    said = "\n".join(lines) + end
    if "://" not in path:
        Path(path).parent.mkdir(parents=True, exist_ok=True)
        Path(path).write_text(said)
        return
    context = SparkSession.active().sparkContext
    where = context._jvm.org.apache.hadoop.fs.Path(path)
    stream = where.getFileSystem(context._jsc.hadoopConfiguration()).create(where, True)
    stream.write(bytearray(said.encode()))
    stream.close()


def save_index_gene(path: str, nodes: DataFrame) -> None:
    _write(path, [f"{r['idx']}\t{r['gene']}" for r in nodes.orderBy("idx").toLocalIterator()])


def save_edge_list(path: str, edges: DataFrame, nodes: DataFrame | None = None) -> None:
    order = [c for c in ("seq",) if c in edges.columns] or edges.columns[:2]
    named = (name_edges(edges, nodes) if nodes is not None else edges).orderBy(*[c for c in order if nodes is None or c == "seq"] or ["u", "v"])
    _write(path, ["\t".join(str(x) for c, x in r.asDict().items() if c != "seq") for r in named.toLocalIterator()])


def save_gene_score(path: str, scores: DataFrame) -> None:
    _write(path, [f"{r['gene']}\t{r['score']}" for r in scores.orderBy("gene").toLocalIterator()])


def save_bins(path: str, bins: DataFrame) -> None:
    groups = bins.groupBy("bin_id").agg(F.sort_array(F.collect_list("gene")).alias("genes")).orderBy("bin_id")
    _write(path, ["\t".join(r["genes"]) for r in groups.toLocalIterator()], "\n")


def sorted_clusters(clusters: DataFrame) -> list[list[str]]:
    """Members of each cluster, larger clusters first, equal ones by their members."""
    groups = clusters.groupBy("cluster").agg(F.sort_array(F.collect_list("node")).alias("nodes"))
    return [list(r["nodes"]) for r in groups.orderBy(F.desc(F.size("nodes")), "nodes").toLocalIterator()]


def save_clusters(path: str, result: dict, clusters: DataFrame) -> None:
    """Six lines of statistics, then a cluster a line."""
    number = lambda x: "nan" if x is None else x
    # fixed values: the lines that readers of such files expect
    head = [
        f"# Observed cut height: {result['cut_height']}",
        f"# Observed size of largest cluster at observed cut height: {result['cut_size']}",
        f"# Expected size of largest cluster at observed cut height: {number(result['expected_cut_size'])}",
        f"# Observed maximum ratio statistic: {number(result['cut_ratio']):.3f}",
        f"# Expected maximum ratio statistic: {float(number(result['expected_ratio'])):.3f}",
        f"# p-value: {number(result['p_value'])}",
        "# Clusters:",
    ]
    _write(path, head + ["\t".join(map(str, c)) for c in sorted_clusters(clusters)])


def save_curve(path: str, curve: DataFrame) -> None:
    columns = [c for c in curve.columns if c != "run"]
    head = ["# " + "\t".join(c.removesuffix("_size") for c in columns)] if len(columns) > 2 else []
    _write(path, head + ["\t".join(str(r[c]) for c in columns) for r in curve.orderBy(F.desc("height")).toLocalIterator()])


def save_points(path: str, label: str, observed: DataFrame, summary: DataFrame, cut: float) -> None:
    """What a plot of sizes over 1 / height shows, a point a line: series, x, size. Drawing is left to other programs."""
    x = inverse_height(F.col("height"))
    lines = [f"# {label}", "# series\tx\tsize"]
    for name, table, column in (("observed", observed, "size"), *((c.removesuffix("_size"), summary, c) for c in ("min_size", "expected_size", "max_size"))):
        lines += [f"{name}\t{r['x']}\t{r[column]}" for r in table.select(x.alias("x"), column, "height").orderBy(F.desc("height")).toLocalIterator()]
    _write(path, [*lines, f"cut\t{1 / max(cut, 1e-15)}\t"])


def save_consensus(nodes_path: str, edges_path: str, nodes: DataFrame, edges: DataFrame) -> None:
    _write(nodes_path, ["\t".join(map(str, c)) for c in sorted_clusters(nodes.withColumnRenamed("group_id", "cluster"))])
    _write(edges_path, [f"{r['u']}\t{r['v']}" for r in edges.orderBy("u", "v").toLocalIterator()])
