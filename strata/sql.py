"""The relational steps as SQL over temporary views, for those who would rather write statements.

register() makes views of tables; run() does so for one statement of STATEMENTS and gives its rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

STATEMENTS = {
    "canonical_edges": "select distinct least(u, v) u, greatest(u, v) v from {edges} where u <> v",
    "degrees": "select node, count(*) degree from (select explode(array(u, v)) node from {edges}) group by node",
    "isolated_nodes": "select idx, gene from {nodes} left anti join (select explode(array(src, dst)) idx from {edges}) using (idx)",
    "induced": "select u, v from {edges} left semi join {members} a on u = a.node left semi join {members} b on v = b.node",
    "combined": "select i, c.j, w * score s from {cells} c join {scores} b on c.j = b.node left semi join {scores} a on c.i = a.node",
    "votes": "select e.u, e.v, count(*) votes from {edges} e join {clusters} a on a.input = e.input and a.node = e.u join {clusters} b on b.input = e.input and b.node = e.v and b.cluster = a.cluster group by e.u, e.v",
    "summary": "select height, min(size) min_size, avg(size) expected_size, max(size) max_size from {curves} where run > 0 group by height",
    "cluster_scores": "select cluster, count(*) size, max(score) top from {clusters} join {scores} using (node) group by cluster",
}


def register(**tables: DataFrame) -> None:
    """Temporary views of the tables under their names."""
    for name, table in tables.items():
        table.createOrReplaceTempView(name)


def run(spark: SparkSession, statement: str, **tables: DataFrame) -> DataFrame:
    """A statement by its name, or one of your own with the tables' names in braces."""
    return spark.sql(STATEMENTS.get(statement, statement), **tables)
