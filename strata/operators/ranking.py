"""Numbers and running values for the rows of a whole table, or of large groups, without bringing them into one task."""

from __future__ import annotations

from itertools import accumulate

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from strata.tables import settle


def dealt(spark: SparkSession, df: DataFrame, *order) -> DataFrame:
    """df in ranges of the order, with `_range`, written to the shared folder."""
    return settle(spark, df.repartitionByRange(*order).withColumn("_range", F.spark_partition_id()), "ranges")


def numbered(spark: SparkSession, df: DataFrame, order: str, name: str) -> DataFrame:
    """df with `name`: 1, 2 ... in the order of a column of distinct values.

    Rows are dealt into ranges; the ranges' counts, a number each, give where a range begins.
    """
    ranges = dealt(spark, df, order)
    counts = sorted((r["_range"], r["count"]) for r in ranges.groupBy("_range").count().collect())
    starts = dict(zip([k for k, _ in counts], accumulate([0] + [n for _, n in counts])))
    begin = spark.createDataFrame([*starts.items()], "_range int, _start bigint")
    nth = F.row_number().over(Window.partitionBy("_range").orderBy(order))
    return ranges.withColumn("_nth", nth).join(F.broadcast(begin), "_range").withColumn(name, (F.col("_start") + F.col("_nth")).cast("int")).drop("_range", "_start", "_nth")


def ranked_within(spark: SparkSession, df: DataFrame, keys: list[str], order: list[str], name: str) -> DataFrame:
    """df with `name`: 1, 2 ... within each group of the keys, by columns that make rows of a group distinct.

    A group may hold all rows: it is dealt into ranges like the rest, and the counts of its ranges before are added.
    """
    ranges = dealt(spark, df, *keys, *order)
    counts = ranges.groupBy(*keys, "_range").agg(F.count("*").alias("_n"))
    before = Window.partitionBy(*keys).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)  # a row a range
    begin = counts.select(*keys, "_range", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_begin"))
    nth = ranges.withColumn("_nth", F.row_number().over(Window.partitionBy("_range", *keys).orderBy(*order)))
    return nth.join(begin, [*keys, "_range"]).withColumn(name, F.col("_begin") + F.col("_nth")).drop("_range", "_begin", "_nth")


def running_max(spark: SparkSession, df: DataFrame, order: str, value: str) -> DataFrame:
    """df with `value` as its greatest so far, from the greatest of the order downwards. The ranges' maxima, a number each, come before each range."""
    ranges = dealt(spark, df, F.desc(order))
    tops = sorted(tuple(r) for r in ranges.groupBy("_range").agg(F.max(value)).collect())
    before = dict(zip([k for k, _ in tops], accumulate([0] + [m for _, m in tops], max)))
    begin = spark.createDataFrame([*before.items()], "_range int, _top bigint")
    own = F.max(value).over(Window.partitionBy("_range").orderBy(F.desc(order)))
    kind = dict(df.dtypes)[value]
    return ranges.withColumn("_own", own).join(F.broadcast(begin), "_range").withColumn(value, F.greatest("_own", "_top").cast(kind)).drop("_range", "_own", "_top")
