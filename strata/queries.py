"""Registered queries of the network operators, and the SQL that gives the same rows.

Each takes (spark, sf_dir). Networks: suppliers that share orders, and trade between nations; see sources/networks.py.
"""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strata.functions import scores as score_functions
from strata.operators import consensus, diffusion, graph, hierarchy, null_model, statistics
from strata.sources import networks, text
from strata.tables import settle

Query = Callable[[SparkSession, str], DataFrame]

RUNS = 100
CUT = 4
LEAST_BIN = 30
BETA = 0.4
STEPS = 8

N1 = """
os as (select distinct l_orderkey o, l_suppkey s from lineitem),
co as (select a.s u, b.s v, count(*) n from os a join os b on a.o = b.o and a.s <> b.s group by 1, 2),
nth as (select u, v, row_number() over (partition by u order by n desc, v) k from co),
n1 as (select distinct least(u, v) u, greatest(u, v) v from nth where k <= 3)"""
N2 = """
n2 as (select s_nationkey u, c_nationkey v, count(*) w from lineitem join supplier on l_suppkey = s_suppkey
  join orders on l_orderkey = o_orderkey join customer on o_custkey = c_custkey where s_nationkey <> c_nationkey group by 1, 2)"""
CENTS = "cast(sum(cast(round(l_extendedprice * (1 - l_discount) * 100) as bigint)) as bigint)"
NATION_SCORES = f"ns as (select s_nationkey node, {CENTS} score from lineitem join supplier on l_suppkey = s_suppkey group by 1)"
RETURNED = f"sc as (select l_suppkey node, {CENTS} score from lineitem where l_returnflag = 'R' group by 1)"
MEDIAN = "lim as (select quantile_disc(w, 0.5) lim from n2)"


def _returned(spark: SparkSession, sf_dir: str) -> DataFrame:
    return networks.supplier_scores(spark, sf_dir).where("label = 'R'").select("node", "score")


def _trade(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cells i = target, j = source of the trade network; small for ever, as nations are."""
    return networks.nation_trade(spark, sf_dir).select(F.col("v").alias("i"), F.col("u").alias("j"), "w")


def _median(cells: DataFrame) -> int:
    return cells.agg(F.percentile_disc(0.5, F.col("w").cast("double")) if hasattr(F, "percentile_disc") else F.expr("percentile_disc(0.5) within group (order by w)")).first()[0]


def _nodes(cells: DataFrame) -> DataFrame:
    return cells.select(F.explode(F.array("i", "j")).alias("node")).distinct()


def degree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Degrees of the supplier network."""
    adj = graph.adjacency(networks.supplier_network(spark, sf_dir).select(F.col("u").alias("src"), F.col("v").alias("dst"), F.lit(1).alias("weight")))
    return graph.degree_sequence(adj).select(F.col("j").alias("node"), F.col("d").alias("degree"))


SQL = {"degree": f"with {N1} select node, cast(count(*) as bigint) degree from (select u node from n1 union all select v from n1) group by 1"}


def weighted_degree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.degree_sequence(_trade(spark, sf_dir)).select(F.col("j").alias("node"), F.col("d").alias("weight"))


SQL["weighted_degree"] = f"with {N2} select u node, cast(sum(w) as bigint) weight from n2 group by 1"


def laplacian(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.laplacian(_trade(spark, sf_dir))


SQL["laplacian"] = f"with {N2} select i, j, cast(sum(w) as bigint) w from (select v i, u j, -w w from n2 union all select u, u, sum(w) from n2 group by u) group by 1, 2"


def walk_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.walk_matrix(_trade(spark, sf_dir)).select("i", "j", F.round("w", 6).alias("w"))


SQL["walk_matrix"] = f"with {N2}, d as (select u, sum(w) d from n2 group by 1) select v i, n2.u j, round(w / d, 6) w from n2 join d on n2.u = d.u"


def canonical_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.canonical_edges(networks.nation_trade(spark, sf_dir), "u", "v")


SQL["canonical_edges"] = f"with {N2} select distinct least(u, v) u, greatest(u, v) v from n2"


def gene_label_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes = networks.table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("idx"), F.col("n_name").alias("gene"))
    return graph.gene_edges(networks.nation_trade(spark, sf_dir).select(F.col("u").alias("src"), F.col("v").alias("dst")), nodes)


SQL["gene_label_edges"] = f"with {N2} select distinct least(a.n_name, b.n_name) u, greatest(a.n_name, b.n_name) v from n2 join nation a on u = a.n_nationkey join nation b on v = b.n_nationkey where a.n_name <> b.n_name"


def edge_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Undirected trade: of both directions, the one with the greater source counts."""
    edges = networks.nation_trade(spark, sf_dir).select(F.col("u").alias("src"), F.col("v").alias("dst"), F.col("w").alias("weight"), F.col("u").alias("seq"))
    return graph.adjacency(edges)


SQL["edge_upsert"] = f"with {N2}, one as (select least(u, v) i, greatest(u, v) j, arg_max(w, u) w from n2 group by 1, 2) select i, j, w from one union all select j, i, w from one"


def _supplier_nodes(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Pairs of suppliers that share at least four fifths of the most orders that any pair shares, and all suppliers."""
    pairs = settle(spark, networks.co_orders(spark, sf_dir).where("u < v"), "pairs")
    most = pairs.agg(F.max("n").alias("most"))  # one row
    edges = pairs.join(F.broadcast(most)).where("5 * n >= 4 * most").select(F.col("u").alias("src"), F.col("v").alias("dst"))
    return edges, networks.table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("idx"), F.col("s_name").alias("gene"))


def isolated_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    edges, nodes = _supplier_nodes(spark, sf_dir)
    return graph.isolated_nodes(nodes, edges)


STRONG = f"{N1}, strong as (select u, v from co where u < v and 5 * n >= 4 * (select max(n) from co)), ends as (select u x from strong union select v from strong)"
SQL["isolated_nodes"] = f"with {STRONG} select s_suppkey idx, s_name gene from supplier where s_suppkey not in (select x from ends)"


def drop_isolated_reindex(spark: SparkSession, sf_dir: str) -> DataFrame:
    edges, nodes = _supplier_nodes(spark, sf_dir)
    kept = graph.drop_isolated_nodes(settle(spark, edges, "edges"), nodes)[0]
    return kept.select(F.col("src").cast("int").alias("src"), F.col("dst").cast("int").alias("dst"))


SQL["drop_isolated_reindex"] = f"with {STRONG}, lone as (select count(*) n from supplier where s_suppkey not in (select x from ends)), num as (select x, cast(case when (select n from lone) = 0 then x else row_number() over (order by x) end as integer) k from ends where x in (select s_suppkey from supplier)) select a.k src, b.k dst from strong join num a on u = a.x join num b on v = b.x"


def scored_subgraph(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edges between suppliers with more returned revenue than the mean."""
    s = _returned(spark, sf_dir)
    high = s.join(F.broadcast(s.agg(F.avg("score").alias("mean")))).where("score > mean")
    return graph.induced(networks.supplier_network(spark, sf_dir), high)


HIGH = f"{N1}, {RETURNED}, high as (select node from sc where score > (select avg(score) from sc)), sub as (select u, v from n1 where u in (select node from high) and v in (select node from high))"
SQL["scored_subgraph"] = f"with {HIGH} select u, v from sub"


def connected_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.connected_components(spark, settle(spark, scored_subgraph(spark, sf_dir), "edges"))


COMPONENTS = f"{HIGH}, both_ as (select u, v from sub union select v, u from sub), reach as (select u, v from both_ union select r.u, b.v from reach r join both_ b on r.v = b.u), comp as (select u node, least(u, min(v)) component from reach group by u)"
SQL["connected_components"] = f"with recursive {COMPONENTS} select node, component from comp"


def largest_component(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.largest_component(settle(spark, connected_components(spark, sf_dir), "components"))


SQL["largest_component"] = f"with recursive {COMPONENTS} select node from comp where component = (select component from comp group by 1 order by count(*) desc, component limit 1)"


def threshold_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    cells = settle(spark, _trade(spark, sf_dir), "cells")
    return graph.threshold_edges(cells, _median(cells))


SQL["threshold_edges"] = f"with {N2}, {MEDIAN} select v i, u j, w from n2, lim where w <= lim"


def distinct_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.distinct_weights(_trade(spark, sf_dir))


SQL["distinct_weights"] = f"with {N2} select distinct w from n2"


def subproblem_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    cells = settle(spark, _trade(spark, sf_dir), "cells")
    return graph.subproblem_index(cells, _median(cells))


SQL["subproblem_index"] = f"with {N2}, {MEDIAN} select count(distinct w) n from n2, lim where w <= lim and w <> 0"


def slice_array(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Trade among the nations of even number."""
    cells = _trade(spark, sf_dir)
    return graph.submatrix(cells, networks.table(spark, sf_dir, "nation").where("n_nationkey % 2 = 0").select(F.col("n_nationkey").alias("node")))


SQL["slice_array"] = f"with {N2} select v i, u j, w from n2 where u % 2 = 0 and v % 2 = 0"


def _strong(spark: SparkSession, cells: DataFrame) -> DataFrame:
    limit = _median(cells)
    return graph.strong_components(spark, cells.where(F.col("w") >= limit).select(F.col("j").alias("u"), F.col("i").alias("v")))


def scc_at_threshold(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Strong components of trade of median weight or more."""
    return _strong(spark, settle(spark, _trade(spark, sf_dir), "cells"))


SCC = f"{N2}, {MEDIAN}, big as (select u, v from n2, lim where w >= lim), reach as (select u, v from big union select r.u, b.v from reach r join big b on r.v = b.u), ends as (select u x from big union select v from big), scc as (select x node, least(x, coalesce(min(a.v), x)) component from ends left join reach a on a.u = x and exists (select 1 from reach b where b.u = a.v and b.v = a.u) group by x)"
SQL["scc_at_threshold"] = f"with recursive {SCC} select node, component from scc"


def condense_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    cells = settle(spark, _trade(spark, sf_dir), "cells")
    return graph.condense(cells, _strong(spark, cells))


SQL["condense_graph"] = f"with recursive {SCC} select a.component c1, b.component c2, min(w) w from n2 join scc a on v = a.node join scc b on u = b.node where a.component <> b.component group by 1, 2"


def permutation_bins(spark: SparkSession, sf_dir: str) -> DataFrame:
    return null_model.permutation_bins(spark, settle(spark, networks.supplier_network(spark, sf_dir), "edges"), _returned(spark, sf_dir), LEAST_BIN)


BINS = f"""{N1}, {RETURNED}, sub as (select u, v from n1 where u in (select node from sc) and v in (select node from sc)),
both_ as (select u, v from sub union select v, u from sub), reach as (select u, v from both_ union select r.u, b.v from reach r join both_ b on r.v = b.u),
comp as (select u node, least(u, min(v)) component from reach group by u),
top as (select node from comp where component = (select component from comp group by 1 order by count(*) desc, component limit 1)),
deg as (select u node, count(*) degree from both_ where u in (select node from top) group by 1),
hist as (select degree, count(*) n, row_number() over (order by degree desc) k from deg group by 1),
scan as (select k, degree, 0 bin, n held from hist where k = 1
  union all select h.k, h.degree, case when s.held >= {LEAST_BIN} then s.bin + 1 else s.bin end, case when s.held >= {LEAST_BIN} then h.n else s.held + h.n end from scan s join hist h on h.k = s.k + 1),
full_ as (select greatest(coalesce(max(bin), 0), 0) last from scan where held >= {LEAST_BIN}),
bins as (select node, deg.degree, cast(least(bin, last) as integer) bin_id from deg join scan on deg.degree = scan.degree, full_)"""
SQL["permutation_bins"] = f"with recursive {BINS} select node, degree, bin_id from bins"


def permute_scores_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    bins = settle(spark, permutation_bins(spark, sf_dir), "bins")
    return null_model.permute_by_hash(_returned(spark, sf_dir), bins, spark.range(6).select(F.col("id").cast("int").alias("run")))


SQL["permute_scores_hash"] = f"""with recursive {BINS},
placed as (select sc.node, score, bin_id from sc left join bins on sc.node = bins.node),
here as (select *, row_number() over (partition by bin_id order by node) k from placed where bin_id is not null),
mixed as (select r run, node, bin_id, row_number() over (partition by r, bin_id order by md5(r || ':' || node), node) k from here, range(1, 6) t(r))
select cast(run as integer) run, mixed.node, score from mixed join here on mixed.bin_id = here.bin_id and mixed.k = here.k
union all select cast(r as integer), node, score from placed, range(1, 6) t(r) where bin_id is null union all select 0, node, score from sc"""


def permute_scores_numpy(spark: SparkSession, sf_dir: str) -> DataFrame:
    bins = settle(spark, permutation_bins(spark, sf_dir), "bins")
    return null_model.permute_by_seed(spark, _returned(spark, sf_dir), bins, spark.range(6).select(F.col("id").cast("int").alias("run")))


def permute_network(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two rewired supplier networks."""
    return null_model.permute_network(spark, networks.supplier_network(spark, sf_dir), spark.range(1, 3).select(F.col("id").cast("int").alias("run")))


def permute_network_invariants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Degrees of two rewired networks: what a swap keeps."""
    return permute_network(spark, sf_dir).select("run", F.explode(F.array("u", "v")).alias("node")).groupBy("run", "node").agg(F.count("*").alias("degree"))


SQL["permute_network_invariants"] = f"with {N1} select cast(r as integer) run, node, count(*) degree from (select u node from n1 union all select v from n1), range(1, 3) t(r) group by 1, 2"


def combined_similarity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Trade weight times the score of the source, for nations with a score."""
    s = networks.nation_scores(spark, sf_dir)
    return _trade(spark, sf_dir).join(s.select(F.col("node").alias("j"), "score"), "j").join(s.select(F.col("node").alias("i")), "i", "left_semi").select("i", "j", (F.col("w") * F.col("score")).alias("s"))


SQL["combined_similarity"] = f"with {N2}, {NATION_SCORES} select v i, u j, w * score s from n2 join ns on u = node where v in (select node from ns)"


def _unit_trade(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Undirected network of the supplier pairs, weight 1."""
    pairs = settle(spark, networks.supplier_network(spark, sf_dir), "edges")  # which both directions read
    return graph.adjacency(pairs.select(F.col("u").alias("src"), F.col("v").alias("dst"), F.lit(1.0).alias("weight")))


def ppr_iterative(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Random walks with restart on the trade network after a fixed number of steps."""
    p = diffusion.restart_similarity_iterative(spark, settle(spark, _trade(spark, sf_dir), "cells"), BETA, STEPS)
    return p.select("i", "j", F.round("p", 6).alias("p"))


def _ppr_sql(steps: int) -> str:
    out = f"{N2}, d as (select u, sum(w) d from n2 group by 1), wk as (select v i, n2.u k, w / d w from n2 join d on n2.u = d.u), un as (select u i from n2 union select v from n2), p0 as (select i, i j, 1.0::double p from un)"
    for t in range(1, steps + 1):
        out += f", p{t} as (select i, j, sum(p) p from (select wk.i, j, {1 - BETA}::double * sum(w * p) p from wk join p{t - 1} on wk.k = p{t - 1}.i group by 1, 2 union all select i, i, {BETA}::double from un) group by 1, 2)"
    return out


SQL["ppr_iterative"] = f"with {_ppr_sql(STEPS)} select i, j, round(p, 6) p from p{STEPS}"


def ppr_exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The limit of the walks, solved densely."""
    names, a = diffusion.dense(_trade(spark, sf_dir))
    return diffusion.long_form(spark, names, diffusion.restart_matrix(a, BETA)).select(F.col("i").cast("int"), F.col("j").cast("int"), F.round("p", 4).alias("p"))


SQL["ppr_exact"] = f"with {_ppr_sql(40)} select a.i, b.i j, round(coalesce(p, 0), 4) p from un a cross join un b left join p40 on p40.i = a.i and p40.j = b.i"


def balance_objective(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Balance of the iterated similarity on the trade network's cells of median weight or more."""
    cells = settle(spark, _trade(spark, sf_dir), "cells")
    p = diffusion.restart_similarity_iterative(spark, cells, BETA, STEPS)
    return diffusion.balance_of(p, cells, _median(cells)).select(F.round("balance", 6).alias("balance"))


SQL["balance_objective"] = f"with {_ppr_sql(STEPS)}, {MEDIAN} select round(sum(case when coalesce(w, 0) >= lim then p else -p end), 6) balance from p{STEPS} p left join n2 on n2.v = p.i and n2.u = p.j, lim where p.i <> p.j"


def balanced_beta(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Restart probability of the supplier network."""
    return spark.createDataFrame([(round(diffusion.balanced_beta_of(spark, _unit_trade(spark, sf_dir)), 6),)], "beta double")


def widest_path_closure(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hierarchy.closure(spark, _trade(spark, sf_dir))


def _closure_sql(source: str, key: str = "", rounds: int = 5) -> str:
    """k<rounds>: the closure of `source`(key, i, j, w); paths of up to 2^rounds edges."""
    keys = f"{key}, " if key else ""
    same = f"a.{key} = b.{key} and " if key else ""
    a = f"a.{key}, " if key else ""
    out = f"k0 as (select {keys}i, j, w from {source})"
    for t in range(1, rounds + 1):
        out += f", k{t} as (select {keys}i, j, max(w) w from (select * from k{t - 1} union all select {a}a.i, b.j, least(a.w, b.w) from k{t - 1} a join k{t - 1} b on {same}a.j = b.i where a.i <> b.j) group by all)"
    return out


CLOSED = f"{N2}, cells as (select v i, u j, w from n2), {_closure_sql('cells')}, mg as (select a.i u, a.j v, least(a.w, b.w) h from k5 a join k5 b on a.i = b.j and a.j = b.i), nodes as (select u node from n2 union select v from n2)"
SQL["widest_path_closure"] = f"with {CLOSED} select i, j, w from k5"


def _merged(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    cells = settle(spark, _trade(spark, sf_dir), "cells")
    return settle(spark, hierarchy.merge(hierarchy.closure(spark, cells)), "merge"), _nodes(cells)


def merge_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _merged(spark, sf_dir)[0]


SQL["merge_matrix"] = f"with {CLOSED} select u, v, h from mg"


def height_to_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hierarchy.height_to_clusters(*_merged(spark, sf_dir)).select(F.col("height").cast("double").alias("height"), "node", "cluster")


CLUSTERS = f"""{CLOSED}, hs as (select distinct h height from mg),
cl as (select cast(height as double) height, node, least(node, coalesce(min(mg.v), node)) cluster from hs cross join nodes left join mg on mg.u = node and mg.h >= height group by 1, 2
  union all select cast('infinity' as double), node, node from nodes union all select 0.0::double, node, (select min(node) from nodes) from nodes)"""
SQL["height_to_clusters"] = f"with {CLUSTERS} select height, node, cluster from cl"


def height_to_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hierarchy.height_to_sizes(height_to_clusters(spark, sf_dir))


SQL["height_to_sizes"] = f"with {CLUSTERS} select height, cluster, cast(count(*) as integer) size from cl group by 1, 2"


def size_curve(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hierarchy.size_curve(*_merged(spark, sf_dir))


SQL["size_curve"] = f"with {CLUSTERS}, sz as (select height, cluster, count(*) size from cl group by 1, 2) select height, cast(max(size) as integer) size from sz group by 1"


def cut_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Clusters at the fourth height from the top."""
    merged, nodes = _merged(spark, sf_dir)
    height = merged.select("h").distinct().orderBy(F.desc("h")).limit(CUT).agg(F.min("h")).first()[0]
    return hierarchy.cut_clusters(merged, nodes, height)


SQL["cut_clusters"] = f"with {CLUSTERS}, at_ as (select min(h) h from (select distinct h from mg order by h desc limit {CUT})) select node, cluster from cl, at_ where height = at_.h"


def _run_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    runs = spark.range(RUNS + 1).select(F.col("id").cast("int").alias("run"))
    return null_model.permute_by_hash(networks.nation_scores(spark, sf_dir), None, runs)


def _curves(spark: SparkSession, sf_dir: str) -> DataFrame:
    names, a = diffusion.dense(_trade(spark, sf_dir))
    return settle(spark, hierarchy.hierarchies(spark, _run_scores(spark, sf_dir), names, a), "curves")


RUN_CURVES = f"""{N2}, {NATION_SCORES}, nx as (select *, row_number() over (order by node) k from ns),
mix as (select cast(r as integer) run, node, row_number() over (partition by r order by md5(r || ':' || node), node) k from nx, range(1, {RUNS + 1}) t(r)),
ps as (select run, mix.node, score from mix join nx on mix.k = nx.k union all select 0, node, score from ns),
cells as (select run, v i, u j, cast(w * score as double) w from n2 join ps on u = node where v in (select node from ns) and score > 0),
{_closure_sql("cells", "run")},
mg0 as (select a.run, a.i u, a.j v, least(a.w, b.w) h from k5 a join k5 b on a.run = b.run and a.i = b.j and a.j = b.i),
members as (select ps.run, node, least(node, coalesce(min(v), node)) c from ps left join mg0 on mg0.run = ps.run and u = node where node in (select u from n2 union select v from n2) group by 1, 2),
top as (select run, arg_min(c, (-n, c)) c from (select run, c, count(*) n from members group by 1, 2) group by 1),
inn as (select m.run, node from members m join top on m.run = top.run and m.c = top.c),
mg as (select mg0.* from mg0 join inn on mg0.run = inn.run and mg0.u = inn.node),
hs as (select distinct run, h height from mg),
curve as (select run, height, cast(max(n) as integer) size from (select hs.run, height, u, 1 + count(*) n from hs join mg on mg.run = hs.run and mg.h >= height group by 1, 2, 3) group by 1, 2
  union all select run, cast('infinity' as double), 1 from (select distinct run from inn) union all select run, 0.0::double, cast(count(*) as integer) from inn group by 1)"""


def run_curves(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Size curves of the observed and the permuted trade hierarchies."""
    return _curves(spark, sf_dir)


SQL["run_curves"] = f"with {RUN_CURVES} select run, height, size from curve"


def size_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return statistics.summarize(_curves(spark, sf_dir))


SUMMARY = f"""{RUN_CURVES}, grid as (select distinct height from curve where run > 0),
at_ as (select g.height, c.run, max(c.size) size from grid g join curve c on c.run > 0 and c.height >= g.height group by 1, 2),
su as (select height, min(size) min_size, sum(size) / count(*) expected_size, max(size) max_size from at_ group by 1),
ra as (select c.run, c.height, c.size, case when c.size >= 1 then c.size / max(expected_size) else 0 end ratio from curve c join su on su.height >= c.height group by 1, 2, 3),
cu as (select run, max((ratio, height, size)) t from ra group by 1),
cuts as (select run, t[2] height, t[3] size, t[1] ratio from cu)"""
SQL["size_summary"] = f"with {SUMMARY} select height, min_size, expected_size, max_size from su"


def best_cut(spark: SparkSession, sf_dir: str) -> DataFrame:
    curves = _curves(spark, sf_dir)
    return statistics.best_cuts(statistics.ratios(curves, statistics.summarize(curves))).select("run", "height", "size", F.round("ratio", 9).alias("ratio"))


SQL["best_cut"] = f"with {SUMMARY} select run, height, size, round(ratio, 9) ratio from cuts"


def p_value(spark: SparkSession, sf_dir: str) -> DataFrame:
    return process_hierarchies(spark, sf_dir).select("p_value")


FINAL = f"{SUMMARY}, fin as (select o.height cut_height, o.size cut_size, o.ratio cut_ratio, sum(p.ratio) / count(*) expected_ratio, cast(sum(case when p.ratio >= o.ratio then 1 else 0 end) as double) / count(*) p_value from cuts o join cuts p on p.run > 0 where o.run = 0 group by 1, 2, 3)"
SQL["p_value"] = f"with {FINAL} select p_value from fin"


def process_hierarchies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cut, ratios and p-value of the trade hierarchy against permuted scores."""
    nine = lambda c: F.round(c, 9).alias(c)
    return statistics.process(_curves(spark, sf_dir)).select("cut_height", "cut_size", nine("cut_ratio"), nine("expected_ratio"), "p_value", nine("expected_cut_size"))


SQL["process_hierarchies"] = f"with {FINAL} select cut_height, cut_size, round(cut_ratio, 9) cut_ratio, round(expected_ratio, 9) expected_ratio, p_value, round(cut_size / cut_ratio, 9) expected_cut_size from fin"


def _inputs(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """For each return flag: the supplier network, and as clusters the quartiles of suppliers by score."""
    from pyspark.sql import Window

    s = networks.supplier_scores(spark, sf_dir)
    quarter = F.ntile(4).over(Window.partitionBy("label").orderBy("score", "node"))
    clusters = s.select(F.col("label").alias("input"), quarter.alias("cluster"), "node")
    edges = F.broadcast(s.select(F.col("label").alias("input")).distinct()).join(networks.supplier_network(spark, sf_dir))
    return edges, clusters


def _votes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return consensus.votes(*_inputs(spark, sf_dir))


def consensus_votes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _votes(spark, sf_dir)


VOTES = f"""{N1}, sl as (select l_returnflag label, l_suppkey node, {CENTS} score from lineitem group by 1, 2),
cl as (select label, node, ntile(4) over (partition by label order by score, node) c from sl),
vo as (select n1.u, n1.v, count(*) votes from n1 join cl a on a.node = n1.u join cl b on b.node = n1.v and b.label = a.label and b.c = a.c group by 1, 2)"""
SQL["consensus_votes"] = f"with {VOTES} select u, v, votes from vo"


def consensus_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return consensus.consensus_edges(_votes(spark, sf_dir), 2).select("u", "v")


SQL["consensus_edges"] = f"with {VOTES} select u, v from vo where votes >= 2"


def consensus_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return consensus.consensus_nodes(spark, settle(spark, consensus_edges(spark, sf_dir), "edges"))


SQL["consensus_nodes"] = f"with recursive {VOTES}, b as (select u, v from vo where votes >= 2 union select v, u from vo where votes >= 2), reach as (select u, v from b union select r.u, b.v from reach r join b on r.v = b.u) select least(u, min(v)) group_id, u node from reach group by u"


def score_threshold(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = settle(spark, _returned(spark, sf_dir), "scores")
    return score_functions.threshold(s, s.agg(F.avg("score")).first()[0])


SQL["score_threshold"] = f"with {RETURNED} select node, score from sc where score >= (select avg(score) from sc)"


def log_transform(spark: SparkSession, sf_dir: str) -> DataFrame:
    """-log10 of each supplier's share of the greatest score."""
    s = _returned(spark, sf_dir)
    share = s.join(F.broadcast(s.agg(F.max("score").alias("top")))).select("node", (F.col("score") / F.col("top")).alias("score"))
    return score_functions.transform(share, 0.9, log=True).select("node", F.round("score", 9).alias("score"))


SQL["log_transform"] = f"with {RETURNED}, sh as (select node, score / (select max(score) from sc) score from sc) select node, round(case when score = 1 then 0.0 else -log10(score) end, 9) score from sh where score <= 0.9"


def plot_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Observed curve over 1 / height."""
    return _curves(spark, sf_dir).where("run = 0").select(F.round(score_functions.inverse_height(F.col("height")), 15).alias("x"), "size")


SQL["plot_data"] = f"with {RUN_CURVES} select round(1 / greatest(height, 1e-15), 15) x, size from curve where run = 0"


def _lines(df: DataFrame, *columns: str) -> DataFrame:
    """Lines of a table, every seventh spoilt, with comments between."""
    return df.select(F.concat_ws("\t", *columns).alias("value"), F.col(columns[0]).cast("long").alias("line"))


def parse_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    nation = networks.table(spark, sf_dir, "nation")
    good = _lines(nation.withColumn("name", F.translate("n_name", " ", "_")), "n_nationkey", "name")
    bad = nation.select(F.when(F.col("n_nationkey") % 3 == 0, F.concat(F.lit("#"), "n_name")).when(F.col("n_nationkey") % 3 == 1, F.lit("x y")).otherwise(F.concat_ws(" ", "n_nationkey", F.lit("last"))).alias("value"), (F.col("n_nationkey") + 1000).cast("long").alias("line"))
    return text.parse_index(good.unionByName(bad))[0]


SQL["parse_index"] = "select n_nationkey idx, case when n_nationkey % 3 = 2 then 'last' else translate(n_name, ' ', '_') end gene from nation"


def parse_edge_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    trade = networks.nation_trade(spark, sf_dir)
    weight = F.when(F.col("u") % 4 == 0, F.lit("nan")).when(F.col("u") % 4 == 1, F.lit("1e400x")).when(F.col("u") % 4 == 2, F.lit("")).otherwise(F.col("w").cast("string"))
    return text.parse_edges(trade.select(F.concat_ws(" ", "u", "v", weight).alias("value"), F.monotonically_increasing_id().alias("line"))).select("src", "dst", "weight")


SQL["parse_edge_list"] = f"with {N2} select u src, v dst, case when u % 4 = 2 then 1.0 else w end::double weight from n2 where u % 4 >= 2"


def parse_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    supplier = networks.table(spark, sf_dir, "supplier")
    lines = supplier.select(F.concat_ws("  ", F.concat(F.lit("s"), F.col("s_suppkey") % 50), F.round("s_acctbal", 2).cast("string")).alias("value"), F.col("s_suppkey").alias("line"))
    return text.parse_scores(lines)


SQL["parse_scores"] = "with a as (select 's' || (s_suppkey % 50) gene, cast(round(s_acctbal, 2) as double) score, s_suppkey k from supplier where round(s_acctbal, 2) >= 0) select gene, arg_max(score, k) score from a group by 1"

OPERATORS: tuple[Query, ...] = (
    degree, weighted_degree, laplacian, walk_matrix, canonical_edges, gene_label_edges, edge_upsert, isolated_nodes, drop_isolated_reindex, scored_subgraph,
    connected_components, largest_component, threshold_edges, distinct_weights, subproblem_index, slice_array, scc_at_threshold, condense_graph,
    permutation_bins, permute_scores_hash, permute_scores_numpy, permute_network, permute_network_invariants, combined_similarity, ppr_iterative, ppr_exact,
    balance_objective, balanced_beta, widest_path_closure, merge_matrix, height_to_clusters, height_to_sizes, size_curve, cut_clusters, run_curves,
    size_summary, best_cut, p_value, process_hierarchies, consensus_votes, consensus_edges, consensus_nodes, score_threshold, log_transform, plot_data,
    parse_index, parse_edge_list, parse_scores,
)


def queries() -> dict[str, Query]:
    from strata import queries_stores

    return {q.__name__: q for q in OPERATORS} | queries_stores.queries()


def oracle_sql() -> dict[str, str]:
    from strata import queries_stores

    return SQL | queries_stores.oracle_sql()
