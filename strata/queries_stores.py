"""Registered queries of files, stores, trees and the interface, and the SQL that gives the same rows.

What a query saves goes to the shared folder, and its rows are what is read back.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strata import api, sql
from strata.functions import scores as score_functions
from strata.operators import consensus, diffusion, graph, hierarchy
from strata.plans.config import PipelineConfig, StatisticsConfig
from strata.plans.pipeline import run_pipeline
from strata.queries import BETA, CENTS, CLOSED, MEDIAN, N1, N2, NATION_SCORES, RUN_CURVES, VOTES, Query, _inputs, _median, _merged, _nodes, _run_scores, _trade, _votes
from strata.sources import networks, store, text, toy
from strata.streaming import add_curves, score_runs
from strata.tables import settle, shared_folder

SQL: dict[str, str] = {}


def _place(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark)}/strata/files-{uuid.uuid4().hex}/{name}"


def _suppliers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return networks.table(spark, sf_dir, "supplier")


def _trade_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return networks.nation_trade(spark, sf_dir).select(F.col("u").alias("src"), F.col("v").alias("dst"), F.col("w").alias("weight"))


def load_index_gene(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers' numbers and names, saved and loaded."""
    text.save_index_gene(path := _place(spark, "index"), _suppliers(spark, sf_dir).select(F.col("s_suppkey").alias("idx"), F.col("s_name").alias("gene")))
    return text.load_index_gene(spark, path)[0]


SQL["load_index_gene"] = "select cast(s_suppkey as integer) idx, s_name gene from supplier"


def load_edge_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Trade with weights, saved and loaded."""
    text.save_edge_list(path := _place(spark, "edges"), _trade_edges(spark, sf_dir))
    return text.load_edge_list(spark, path).drop("seq")


SQL["load_edge_list"] = f"with {N2} select u src, v dst, cast(w as double) weight from n2"


def load_edge_list_named(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Trade by name among nations outside region 2; edges with an end that has no name are left out."""
    text.save_edge_list(path := _place(spark, "edges"), _trade_edges(spark, sf_dir))
    nodes = networks.table(spark, sf_dir, "nation").where("n_regionkey <> 2").select(F.col("n_nationkey").alias("idx"), F.col("n_name").alias("gene"))
    return text.load_edge_list(spark, path, nodes).drop("seq")


SQL["load_edge_list_named"] = f"with {N2}, nm as (select * from nation where n_regionkey <> 2) select a.n_name u, b.n_name v, cast(w as double) weight from n2 join nm a on u = a.n_nationkey join nm b on v = b.n_nationkey"


def load_edge_list_unweighted(spark: SparkSession, sf_dir: str) -> DataFrame:
    text.save_edge_list(path := _place(spark, "edges"), _trade_edges(spark, sf_dir))
    return text.load_edge_list(spark, path, unweighted=True).drop("seq")


SQL["load_edge_list_unweighted"] = f"with {N2} select u src, v dst from n2"


def load_gene_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers' balances, saved and loaded; those below zero are left out."""
    text.save_gene_score(path := _place(spark, "scores"), _suppliers(spark, sf_dir).select(F.col("s_name").alias("gene"), F.col("s_acctbal").alias("score")))
    return text.load_gene_score(spark, path)


SQL["load_gene_score"] = "select s_name gene, s_acctbal score from supplier where s_acctbal >= 0"


def score_map_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same through a store of files, where scores below zero come back."""
    scores = _suppliers(spark, sf_dir).select(F.col("s_name").alias("gene"), F.col("s_acctbal").alias("score"))
    kept = store.DiskStore(spark, _place(spark, "scores"), store.ScoreMapCodec())
    kept.put("0", scores)
    return kept["0"]


SQL["score_map_codec"] = "select s_name gene, s_acctbal score from supplier"


def disk_store_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(position, key): keys of a store of files, in the order of their characters."""
    kept = store.DiskStore(spark, _place(spark, "keys"), store.ScoreMapCodec())
    one = spark.createDataFrame([("x", 1.0)], "gene string, score double")
    for r in networks.table(spark, sf_dir, "nation").select("n_nationkey").collect():
        kept.put(str(r[0]), one)
    return spark.createDataFrame([*enumerate(kept.keys(), 1)], "position bigint, key string")


SQL["disk_store_keys"] = "select row_number() over (order by cast(n_nationkey as varchar)) position, cast(n_nationkey as varchar) \"key\" from nation"


def parquet_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nations by region as runs; region 1 is put again with other values."""
    rows = networks.table(spark, sf_dir, "nation").select(F.col("n_regionkey").alias("run"), F.col("n_name").alias("gene"), F.lit(1.0).alias("score"))
    kept = store.ParquetStore(spark, _place(spark, "runs"))
    kept.put(rows)
    kept.put(rows.where("run = 1").withColumn("score", F.lit(2.0)))
    return kept.table().select("run", "gene", "score")


def memory_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = networks.table(spark, sf_dir, "nation").select(F.col("n_regionkey").alias("run"), F.col("n_name").alias("gene"), F.lit(1.0).alias("score"))
    kept = store.MemoryStore()
    kept.put(rows)
    kept.put(rows.where("run = 1").withColumn("score", F.lit(2.0)))
    return kept.table()


SQL["parquet_store"] = SQL["memory_store"] = "select n_regionkey run, n_name gene, case when n_regionkey = 1 then 2.0 else 1.0 end::double score from nation"


def missing_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of the numbers 0 to 9, those that no region has."""
    kept = store.ParquetStore(spark, _place(spark, "runs"))
    kept.put(networks.table(spark, sf_dir, "region").select(F.col("r_regionkey").alias("run"), "r_name"))
    return spark.createDataFrame([(r,) for r in store.missing(spark, kept, [*range(10)])], "run bigint")


SQL["missing_runs"] = "select r run from range(10) t(r) where r not in (select r_regionkey from region)"


def load_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shares of trade as a matrix in single precision, beside another one."""
    cells = _trade(spark, sf_dir)
    path = _place(spark, "matrix")
    store.save_matrix(cells.select("i", "j", F.lit(0.0).alias("p")), path, "other")
    store.save_matrix(cells.select("i", "j", (F.col("w") / 1000).alias("p")), path, "share")
    return store.load_matrix(spark, path, "share").select("i", "j", "p")


SQL["load_matrix"] = f"with {N2} select v i, u j, cast(w / 1000 as float) p from n2"


def load_bins(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nations by region as bins, saved and loaded."""
    text.save_bins(path := _place(spark, "bins"), networks.table(spark, sf_dir, "nation").select(F.col("n_regionkey").alias("bin_id"), F.col("n_name").alias("gene")))
    return text.load_bins(spark, path)


SQL["load_bins"] = "select cast(dense_rank() over (order by n_regionkey) - 1 as integer) bin_id, n_name gene from nation"


def _by_nation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _suppliers(spark, sf_dir).select(F.col("s_nationkey").alias("cluster"), F.col("s_name").alias("node"))


def load_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of suppliers by nation as clusters, saved with figures: the first cluster of the file, the largest."""
    figures = {"cut_height": 1.0, "cut_size": 1, "expected_cut_size": None, "cut_ratio": 1.0, "expected_ratio": None, "p_value": None}
    text.save_clusters(path := _place(spark, "clusters"), figures, _by_nation(spark, sf_dir))
    return text.load_components(spark, path)


BY_NATION = "cl as (select s_nationkey c, count(*) n, list(s_name order by s_name) m from supplier group by 1), ord as (select *, row_number() over (order by n desc, m) position from cl)"
SQL["load_components"] = f"with {BY_NATION} select unnest(m) gene from ord where position = 1"


def cluster_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(position, node): clusters in the order in which they are written."""
    rows = [(k, x) for k, nodes in enumerate(text.sorted_clusters(_by_nation(spark, sf_dir)), 1) for x in nodes]
    return spark.createDataFrame(rows, "position bigint, node string")


SQL["cluster_order"] = f"with {BY_NATION} select position, unnest(m) node from ord"


def component_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(component, members) of the supplier network's components."""
    found = graph.connected_components(spark, settle(spark, networks.supplier_network(spark, sf_dir), "edges"))
    return found.groupBy("component").agg(F.concat_ws(" ", F.sort_array(F.collect_list("node"))).alias("members"))


REACH = f"{N1}, both_ as (select u, v from n1 union select v, u from n1), reach as (select u, v from both_ union select r.u, b.v from reach r join both_ b on r.v = b.u), comp as (select u node, least(u, min(v)) component from reach group by u)"
SQL["component_lists"] = f"with recursive {REACH} select component, string_agg(cast(node as varchar), ' ' order by node) members from comp group by 1"


def curve_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of the file of the trade hierarchy's curve."""
    text.save_curve(path := _place(spark, "curve"), hierarchy.size_curve(*_merged(spark, sf_dir)))
    return spark.read.text(path).withColumnRenamed("value", "said")


CURVE = f"{CLOSED}, at_ as (select h, u, min(v) v, count(*) n from mg group by 1, 2), st as (select h, u, 1 + sum(n) over (partition by u order by h desc) n from at_), mx as (select h, max(max(n)) over (order by h desc) n from st group by 1)"
SQL["curve_file"] = f"with {CURVE} select cast(cast(h as double) as varchar) || chr(9) || cast(n as integer) said from mx union all select 'inf' || chr(9) || '1' union all select '0.0' || chr(9) || count(*) from nodes"


def consensus_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of the file of consensus edges."""
    kept = settle(spark, consensus.consensus_edges(_votes(spark, sf_dir), 2), "consensus")
    text.save_consensus(_place(spark, "nodes"), path := _place(spark, "edges"), consensus.consensus_nodes(spark, kept), kept)
    return spark.read.text(path).withColumnRenamed("value", "said")


SQL["consensus_file"] = f"with {VOTES} select u || chr(9) || v said from vo where votes >= 2"


def example_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    edges, nodes, _ = toy.example_graph(spark)
    return graph.canonical_edges(text.name_edges(edges, nodes), "u", "v")


SQL["example_edges"] = """with e as (select i, j from range(8) a(i), range(8) b(j) where i < j union all select 8 + i, 8 + (i + s) % 8 from range(8) a(i), range(1, 3) b(s) union all select 16 + i, 16 + (i + 1) % 8 from range(8) a(i) union all select k, 24 from (values (0), (12), (18)) t(k))
select chr(cast(97 + least(i, j) as integer)) u, chr(cast(97 + greatest(i, j) as integer)) v from e"""


def example_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toy.example_graph(spark)[2]


SQL["example_scores"] = """select 'scores_1' label, chr(cast(97 + k as integer)) gene, case when k < 8 or k = 24 then 5.0 when k < 16 then 10.0 else 3.0 end::double score from range(25) t(k)
union all select 'scores_2', chr(cast(97 + k as integer)), case when k < 8 then 0.1 when k = 24 then 1.0 when k >= 16 then 0.1 + 0.1 * (k % 2) when k in (8, 11, 12, 13) then 0.6 when k in (9, 15) then 0.4 else 0.5 end::double from range(25) t(k)"""


def from_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The supplier network by names, numbered from 1 in their order."""
    names = _suppliers(spark, sf_dir).select("s_suppkey", "s_name")
    a, b = names.toDF("u", "a"), names.toDF("v", "b")
    return toy.from_pairs(networks.supplier_network(spark, sf_dir).join(a, "u").join(b, "v").select(F.col("a").alias("u"), F.col("b").alias("v")))[0]


SQL["from_pairs"] = f"with {N1}, nm as (select s_suppkey, row_number() over (order by s_name) k from supplier where s_suppkey in (select u from n1 union select v from n1)) select cast(a.k as integer) src, cast(b.k as integer) dst, 1.0::double weight from n1 join nm a on u = a.s_suppkey join nm b on v = b.s_suppkey"


def unit_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_functions.unit_scores(networks.table(spark, sf_dir, "nation").select(F.col("n_name").alias("gene")))


SQL["unit_scores"] = "select n_name gene, 1.0::double score from nation"


def unit_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_functions.unit_weights(_trade_edges(spark, sf_dir))


SQL["unit_weights"] = f"with {N2} select u src, v dst, 1.0::double weight from n2"


def index_vertices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names of the nations that trade most with others, by their place among all names."""
    nations = networks.table(spark, sf_dir, "nation").select(F.col("n_name").alias("node"))
    places = networks.table(spark, sf_dir, "region").select((F.col("r_regionkey") * 3 + 2).cast("int").alias("position"))
    return graph.index_vertices(nations, places)


SQL["index_vertices"] = "with nm as (select n_name node, row_number() over (order by n_name) p from nation) select cast(p as integer) position, node from nm where p in (select r_regionkey * 3 + 2 from region)"


def scores_in_network(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Revenue of the nations that trade, by name."""
    cells = settle(spark, _trade(spark, sf_dir), "cells")
    names, a = diffusion.dense(cells)
    nodes = networks.table(spark, sf_dir, "nation").join(_nodes(cells), F.col("n_nationkey") == F.col("node"), "left_semi").select(F.col("n_nationkey").alias("idx"), F.col("n_name").alias("gene"))
    scores = networks.nation_scores(spark, sf_dir).join(networks.table(spark, sf_dir, "nation"), F.col("node") == F.col("n_nationkey")).select(F.col("n_name").alias("gene"), "score")
    return api.scored_in_network(diffusion.long_form(spark, names, diffusion.restart_matrix(a, BETA)), nodes, scores)


SQL["scores_in_network"] = f"with {N2}, {NATION_SCORES} select n_name node, score from ns join nation on node = n_nationkey where node in (select u from n2 union select v from n2)"


def zipped_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Leaves of the trade hierarchy and of a second run of it."""
    merged, nodes = _merged(spark, sf_dir)
    runs = spark.range(2).select(F.col("id").cast("int").alias("run"))
    named = hierarchy.leaves(spark, nodes)
    return hierarchy.zipped(merged.join(F.broadcast(runs)), named.join(F.broadcast(runs)))


SQL["zipped_runs"] = f"with {N2}, nodes as (select u node from n2 union select v from n2) select cast(r as integer) run, cast(row_number() over (partition by r order by node) as integer) idx, node gene from nodes, range(2) t(r)"


def snapped_heights(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders a nation's customers have, a tenth more, as heights; snapped to the weights of trade."""
    orders = networks.table(spark, sf_dir, "orders").select("o_custkey").join(networks.table(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    heights = orders.groupBy("c_nationkey").agg((F.count("*") / 8).alias("height")).select("height")
    return hierarchy.snapped(heights, _trade(spark, sf_dir).select("w"))


SQL["snapped_heights"] = f"""with {N2}, hh as (select distinct count(*) / 8 height from orders join customer on o_custkey = c_custkey group by c_nationkey),
ab as (select height, (select max(w) from n2 where w <= height) a, (select min(w) from n2 where w >= height) b from hh)
select height, cast(case when a is null then b when b is null then a when height - a < b - height then a else b end as double) weight from ab"""


def hierarchy_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(child, parent, height) of the trade hierarchy."""
    return hierarchy.tree(spark, *_merged(spark, sf_dir))[0]


TREE = f"""{CLOSED}, at_ as (select u, h, min(v) v from mg group by 1, 2), st as (select u, h, least(u, min(v) over (partition by u order by h desc)) c from at_),
num as (select h, c, (select count(*) from nodes) + row_number() over (order by h desc, c) id from (select distinct h, c from st)),
lf as (select node, row_number() over (order by node) idx from nodes),
tr as (select distinct coalesce(lag(id) over (partition by st.u order by st.h desc), idx) child, id parent, cast(st.h as double) height from st join num on num.h = st.h and num.c = st.c join lf on node = u)"""
SQL["hierarchy_tree"] = f"with {TREE} select cast(child as integer) child, cast(parent as integer) parent, height from tr"


def hierarchy_leaves(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hierarchy.tree(spark, *_merged(spark, sf_dir))[1]


SQL["hierarchy_leaves"] = f"with {N2}, nodes as (select u node from n2 union select v from n2) select cast(row_number() over (order by node) as integer) idx, node gene from nodes"


def hierarchy_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The tree through a store of files, and back to merges."""
    kept = store.DiskStore(spark, _place(spark, "trees"), store.HierarchyCodec())
    kept.put("0", hierarchy.tree(spark, *_merged(spark, sf_dir)))
    tree, leaves = kept["0"]
    return hierarchy.merges_of_tree(spark, tree, leaves).select(F.col("u").cast("int").alias("u"), F.col("v").cast("int").alias("v"), "h")


SQL["hierarchy_codec"] = f"with {CLOSED} select u, v, cast(h as double) h from mg"


def largest_cluster(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each return flag, the first of the quartiles of suppliers."""
    return consensus.largest_cluster(_inputs(spark, sf_dir)[1]).select("input", "cluster", "node")


SQL["largest_cluster"] = f"with sl as (select l_returnflag label, l_suppkey node, {CENTS} score from lineitem group by 1, 2), cl as (select label, node, ntile(4) over (partition by label order by score, node) c from sl), sz as (select label, c, row_number() over (partition by label order by count(*) desc, min(node)) k from cl group by 1, 2) select cl.label input, cast(cl.c as integer) cluster, node from cl join sz on sz.label = cl.label and sz.c = cl.c where k = 1"


def compute_similarity_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Walks with restart on undirected trade of median weight or more, without weights."""
    cells = settle(spark, _trade(spark, sf_dir), "cells")
    found, _ = api.compute_similarity_matrix(spark, cells.where(F.col("w") >= _median(cells)).select(F.col("j").alias("src"), F.col("i").alias("dst")), beta=BETA)
    return found.select(F.col("i").cast("int").alias("i"), F.col("j").cast("int").alias("j"), F.round("p", 4).alias("p"))


def _walks_sql(steps: int) -> str:
    out = f"{N2}, {MEDIAN}, adj as (select u i, v j from n2, lim where w >= lim union select v, u from n2, lim where w >= lim), d as (select j, count(*) d from adj group by 1), wk as (select i, adj.j k, 1.0::double / d w from adj join d on d.j = adj.j), un as (select distinct i from adj), p0 as (select i, i j, 1.0::double p from un)"
    for t in range(1, steps + 1):
        out += f", p{t} as (select i, j, sum(p) p from (select wk.i, j, {1 - BETA}::double * sum(w * p) p from wk join p{t - 1} on wk.k = p{t - 1}.i group by 1, 2 union all select i, i, {BETA}::double from un) group by 1, 2)"
    return out


SQL["compute_similarity_matrix"] = f"with {_walks_sql(40)} select a.i, b.i j, round(coalesce(p, 0), 4) p from un a cross join un b left join p40 on p40.i = a.i and p40.j = b.i"


def heat_kernel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Heat diffusion on the undirected trade network, weights as shares of the greatest."""
    from strata.queries import edge_upsert

    names, a = diffusion.dense(edge_upsert(spark, sf_dir))
    found = diffusion.long_form(spark, names, diffusion.heat_matrix(a / max(a.max(), 1), 0.1))
    return found.select(F.col("i").cast("int").alias("i"), F.col("j").cast("int").alias("j"), F.round("p", 4).alias("p"))


def _heat_sql(terms: int) -> str:
    """exp(-0.1 L) by its series."""
    out = f"{N2}, one as (select least(u, v) i, greatest(u, v) j, arg_max(w, u) w from n2 group by 1, 2), sym as (select i, j, w from one union all select j, i, w from one), ad as (select i, j, w / (select cast(max(w) as double) from sym) w from sym), l as (select i, j, 0.1::double * w x from ad union all select j, j, -0.1::double * sum(w) from ad group by j), un as (select distinct i from ad), t0 as (select i, i j, 1.0::double x from un)"
    for k in range(1, terms + 1):
        out += f", t{k} as (select l.i, t.j, sum(l.x * t.x) / {k} x from l join t{k - 1} t on l.j = t.i group by 1, 2)"
    return out + ", e as (select i, j, sum(x) p from (" + " union all ".join(f"select * from t{k}" for k in range(terms + 1)) + ") group by 1, 2)"


SQL["heat_kernel"] = f"with {_heat_sql(24)} select i, j, round(p, 4) p from e"


def example_analysis(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole analysis of the example network: p-value, size of the cut's largest cluster, and clusters of each score set."""
    result = run_pipeline(spark, *toy.example_graph(spark), PipelineConfig(statistics=StatisticsConfig(1)))
    rows = [(label, r.statistics["p_value"], r.statistics["cut_size"], r.clusters.select("cluster").distinct().count()) for label, r in result.labels.items()]
    rows.append(("consensus", None, result.consensus_edges.count(), result.consensus_nodes.select("group_id").distinct().count()))
    return spark.createDataFrame(rows, "label string, p_value double, size bigint, clusters bigint")


# The published results of the example.
SQL["example_analysis"] = "select label, p_value::double p_value, size::bigint size, clusters::bigint clusters from (values ('scores_1', 0.02, 7, 19), ('scores_2', 0.05, 8, 18), ('consensus', null, 12, 1)) t(label, p_value, size, clusters)"


def streamed_curves(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Curves of runs that come as files, by a stream; the same as of run_curves."""
    names, a = diffusion.dense(_trade(spark, sf_dir))
    _run_scores(spark, sf_dir).select("run", "node", F.col("score").cast("double").alias("score")).write.parquet(folder := _place(spark, "scores"))
    kept = store.ParquetStore(spark, _place(spark, "curves"))
    add_curves(spark, score_runs(spark, folder, "int"), names, a, kept, _place(spark, "checkpoint")).awaitTermination()
    return kept.table().select("run", "height", "size")


SQL["streamed_curves"] = f"with {RUN_CURVES} select run, height, size from curve"


def degrees_in_sql(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Degrees of the supplier network by a statement over temporary views."""
    return sql.run(spark, "degrees", edges=networks.supplier_network(spark, sf_dir))


SQL["degrees_in_sql"] = f"with {N1} select node, count(*) degree from (select u node from n1 union all select v from n1) group by 1"


def components_in_sql(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nodes of each cluster of suppliers and their mean score, by a statement over temporary views."""
    clusters = _inputs(spark, sf_dir)[1].where("input = 'R'").select("cluster", "node")
    scores = networks.supplier_scores(spark, sf_dir).where("label = 'R'").select("node", "score")
    return sql.run(spark, "cluster_scores", clusters=clusters, scores=scores)


SQL["components_in_sql"] = f"with sl as (select l_suppkey node, {CENTS} score from lineitem where l_returnflag = 'R' group by 1), cl as (select node, score, ntile(4) over (order by score, node) c from sl) select cast(c as integer) cluster, count(*) size, max(score) top from cl group by 1"

OPERATORS: tuple[Query, ...] = (
    load_index_gene, load_edge_list, load_edge_list_named, load_edge_list_unweighted, load_gene_score, score_map_codec, disk_store_keys, parquet_store, memory_store,
    missing_runs, load_matrix, load_bins, load_components, cluster_order, component_lists, curve_file, consensus_file, example_edges, example_scores, from_pairs,
    unit_scores, unit_weights, index_vertices, scores_in_network, zipped_runs, snapped_heights, hierarchy_tree, hierarchy_leaves, hierarchy_codec, largest_cluster,
    compute_similarity_matrix, heat_kernel, example_analysis, streamed_curves, degrees_in_sql, components_in_sql,
)


def queries() -> dict[str, Query]:
    return {q.__name__: q for q in OPERATORS}


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
