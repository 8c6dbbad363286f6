"""The example network from end to end, stores, streams and commands."""

import json

import numpy as np
import pytest

import strata
from strata import cli, sql
from strata.operators import hierarchy
from strata.plans.config import PermutationConfig, PipelineConfig, StatisticsConfig
from strata.plans.pipeline import run_pipeline, save_result
from strata.sources.store import DiskStore, HierarchyCodec, MemoryStore, ParquetStore, ScoreMapCodec, load_matrix, missing, save_matrix
from strata.sources.text import sorted_clusters
from strata.sources.toy import example_graph
from strata.streaming import add_curves, score_runs


def test_example_results(spark, tmp_path):
    config = PipelineConfig(statistics=StatisticsConfig(1), workdir=f"file://{tmp_path}/work", reuse=True)
    result = run_pipeline(spark, *example_graph(spark), config)
    assert result.beta == pytest.approx(0.050715762239440715, abs=1e-14)
    one, two = result.labels["scores_1"], result.labels["scores_2"]
    assert (one.statistics["p_value"], one.statistics["cut_size"], len(sorted_clusters(one.clusters))) == (0.02, 7, 19)
    assert (two.statistics["p_value"], two.statistics["cut_size"], len(sorted_clusters(two.clusters))) == (0.05, 8, 18)
    assert one.statistics["cut_height"] == pytest.approx(0.9583507776260376, rel=1e-6)
    assert one.statistics["expected_ratio"] == pytest.approx(1.649197860439894, rel=1e-4)
    assert two.statistics["cut_ratio"] == pytest.approx(2.247191011235955, rel=1e-9)
    assert sorted(r["u"] + r["v"] for r in result.consensus_edges.collect()) == "ij ik io ip jk jl jp kl ln no np op".split()
    assert ["".join(c) for c in sorted_clusters(result.consensus_nodes.withColumnRenamed("group_id", "cluster"))] == ["ijklnop"]
    save_result(result, str(tmp_path / "out"))
    assert json.loads((tmp_path / "out/beta.txt").read_text()) == result.beta
    assert (tmp_path / "out/clusters_scores_1.tsv").read_text().splitlines()[7] == "i\tj\tk\tl\tn\to\tp"
    again = run_pipeline(spark, *example_graph(spark), config)  # from the curves of the first run
    assert again.labels["scores_2"].statistics == two.statistics


def test_hashed_permutations_and_reuse_without_folder(spark):
    config = PipelineConfig(PipelineConfig().similarity, PermutationConfig(5, by_hash=True), statistics=StatisticsConfig(1))
    assert 0 <= run_pipeline(spark, *example_graph(spark), config).labels["scores_1"].statistics["p_value"] <= 1
    with pytest.raises(ValueError):
        run_pipeline(spark, *example_graph(spark), PipelineConfig(reuse=True))


def test_stores(spark, tmp_path):
    rows = spark.createDataFrame([(r, float(k)) for r in (10, 2, 1) for k in range(2)], "run int, x double")
    for store in (MemoryStore(), ParquetStore(spark, f"file://{tmp_path}/store")):
        assert store.keys() == [] and missing(spark, store, [1, 3]) == [1, 3]
        store.put(rows)
        store.put(spark.createDataFrame([(2, 9.0)], "run int, x double"))
        assert store.keys() == [1, 2, 10] and len(store) == 3 and 2 in store
        assert [r["x"] for r in store.get(2).collect()] == [9.0]
        assert missing(spark, store, [1, 3]) == [3]
        with pytest.raises(KeyError):
            store.get(4)
    cells = spark.createDataFrame([(1, 2, 0.1)], "i int, j int, p double")
    save_matrix(cells, f"file://{tmp_path}/matrix", "a")
    save_matrix(cells, f"file://{tmp_path}/matrix", "b")
    assert load_matrix(spark, f"file://{tmp_path}/matrix", "a").first()["p"] == pytest.approx(0.1)
    with pytest.raises(KeyError):
        load_matrix(spark, f"file://{tmp_path}/matrix", "c")


def test_runs_that_come_as_a_stream(spark, tmp_path):
    """Also a run whose rows come at two times: its curve is of all of them."""
    names, matrix = ["a", "b", "c"], np.array([[0, 1, 2], [2, 0, 1], [1, 2, 0.0]])
    store = ParquetStore(spark, f"file://{tmp_path}/curves")

    def come(run, some):
        spark.createDataFrame([(run, x, float(k + run)) for k, x in some], "run int, node string, score double").coalesce(1).write.mode("append").parquet(f"file://{tmp_path}/scores")
        add_curves(spark, score_runs(spark, f"file://{tmp_path}/scores"), names, matrix, store, f"file://{tmp_path}/checkpoint").awaitTermination()

    every = [*enumerate(names)]
    come(1, every)
    assert store.keys() == [1]
    come(2, every[:2])
    assert store.keys() == [1, 2] and store.get(2).agg({"size": "max"}).first()[0] == 2
    come(2, every[2:])
    assert store.keys() == [1, 2] and store.get(2).agg({"size": "max"}).first()[0] == 3


def test_file_stores(spark, tmp_path):
    """String keys in the order of their characters, lazily read values, files that were there before, and both codecs."""
    store = DiskStore(spark, tmp_path / "scores", ScoreMapCodec())
    scores = spark.createDataFrame([("A", 1.5), ("B", -0.3), ("C", 2.0)], "gene string, score double")
    assert store.keys() == [] and len(store) == 0 and "1" not in store
    for key in ("10", "2", "1"):
        store.put(key, scores)
    store.put("2", scores.where("score > 1"))
    again = DiskStore(spark, tmp_path / "scores", ScoreMapCodec())
    assert again.keys() == ["1", "10", "2"] and len(again) == 3 and "10" in again
    assert {r["gene"]: r["score"] for r in again["1"].collect()} == {"A": 1.5, "B": -0.3, "C": 2.0}
    assert [(key, value.count()) for key, value in again] == [("1", 3), ("10", 3), ("2", 2)]
    with pytest.raises(KeyError):
        again["3"]
    again.close()
    again.close()
    trees = DiskStore(spark, tmp_path / "trees", HierarchyCodec())
    tree = spark.createDataFrame([(1, 4, 0.5), (2, 4, 0.5), (4, 5, 0.25), (3, 5, 0.25)], "child int, parent int, height double")
    trees.put("0", (tree, spark.createDataFrame([(1, "a"), (2, "b"), (3, "c")], "idx int, gene string")))
    assert sorted(p.name for p in (tmp_path / "trees").iterdir() if not p.name.startswith(".")) == ["0.edges.tsv", "0.genes.tsv"]
    edges, leaves = trees["0"]
    assert sorted(map(tuple, edges.collect())) == sorted(map(tuple, tree.collect())) and leaves.count() == 3
    assert {(r["u"], r["v"]): r["h"] for r in hierarchy.merges_of_tree(spark, edges, leaves).collect()} == {("a", "b"): 0.5, ("b", "a"): 0.5, **{x: 0.25 for x in (("a", "c"), ("c", "a"), ("b", "c"), ("c", "b"))}}
    with pytest.raises(ValueError):
        HierarchyCodec.genes("x.tsv")


def test_a_working_folder_is_taken_up_again(spark, tmp_path):
    """A run that is asked for more permutations makes those that are missing; one without reuse starts anew."""
    def config(n, reuse=True):
        return PipelineConfig(permutation=PermutationConfig(n, by_hash=True), statistics=StatisticsConfig(1), workdir=f"file://{tmp_path}/work", reuse=reuse)

    edges, nodes, scores = example_graph(spark)
    tables = edges, nodes, scores.where("label = 'scores_1'")
    run_pipeline(spark, *tables, config(4))
    folder = next((tmp_path / "work").iterdir()) / "scores_1" / "curves"
    before = {p.name: p.stat().st_mtime_ns for p in folder.iterdir() if p.name.startswith("run=")}
    assert sorted(before) == [f"run={k}" for k in range(5)]
    more = run_pipeline(spark, *tables, config(6))
    after = {p.name: p.stat().st_mtime_ns for p in folder.iterdir() if p.name.startswith("run=")}
    assert sorted(after) == [f"run={k}" for k in range(7)] and {k: after[k] for k in before} == before
    whole = run_pipeline(spark, *tables, PipelineConfig(permutation=PermutationConfig(6, by_hash=True), statistics=StatisticsConfig(1)))
    assert more.labels["scores_1"].statistics == whole.labels["scores_1"].statistics


def test_commands(spark, tmp_path):
    at = lambda x: str(tmp_path / x)
    assert cli.main(["--help"]) == 0 and cli.main(["nothing"]) == 2 and cli.main([]) == 2
    assert cli.main(["generate-example-graph", "-igf", at("index"), "-elf", at("edges"), "-gsfa", at("a"), "-gsfb", at("b"), "-pf", at("places")]) == 0
    assert len((tmp_path / "places").read_text().splitlines()) == 25
    assert cli.main(["construct-similarity-matrix", "-i", at("edges"), "-o", at("similarity"), "-bof", at("beta")]) == 0
    assert (tmp_path / "beta").read_text() == "0.05"
    assert cli.main(["find-permutation-bins", "-igf", at("index"), "-elf", at("edges"), "-gsf", at("a"), "-o", at("bins")]) == 0
    assert cli.main(["permute-scores", "-i", at("a"), "-bf", at("bins"), "-s", "7", "-o", at("a7")]) == 0
    assert cli.main(["permute-network", "-i", at("edges"), "-s", "7", "-q", "1", "-c", "-o", at("edges7")]) == 0
    for scores in ("a", "a7"):
        assert cli.main(["construct-hierarchy", "-smf", at("similarity"), "-smn", "PPR", "-igf", at("index"), "-gsf", at(scores), "-st", "0.5", "-helf", at(f"h_{scores}"), "-higf", at(f"g_{scores}"), "-v"]) == 0
    sizes = {x: at(f"{x}_sizes") for x in ("o", "e", "min", "max")}
    assert cli.main(["process-hierarchies", "-oelf", at("h_a"), "-oigf", at("g_a"), "-pelf", at("h_a7"), "-pigf", at("g_a7"), "-lsb", "1", "-usb", "25", "-nc", "2", "-cf", at("clusters"), "-pf", at("plot"), "-pl", "the", "example", "-osf", sizes["o"], "-esf", sizes["e"], "-minsf", sizes["min"], "-maxsf", sizes["max"], "-v"]) == 0
    head = (tmp_path / "clusters").read_text().splitlines()[:7]
    assert [x.split(":")[0] for x in head] == ["# Observed cut height", "# Observed size of largest cluster at observed cut height", "# Expected size of largest cluster at observed cut height", "# Observed maximum ratio statistic", "# Expected maximum ratio statistic", "# p-value", "# Clusters"]
    assert (tmp_path / "o_sizes").read_text().splitlines()[0] == "inf\t1" and (tmp_path / "plot").read_text().startswith("# the example\n")
    with pytest.raises(ValueError):
        cli.main(["process-hierarchies", "-oelf", at("h_a"), "-oigf", at("g_a"), "-pelf", at("h_a7")])
    twice = lambda x: [at(x), at(x)]
    own = ["perform-consensus", "-cf", *twice("clusters"), "-igf", *twice("index"), "-elf", *twice("edges"), "-n", "one", "two", "-cnf", at("nodes"), "-cef", at("agreed"), "-v"]
    assert cli.main([*own, "-s", "a", "b"]) == 0
    assert (tmp_path / "agreed").read_text()
    with pytest.raises(ValueError):
        cli.main([*own, "-s", "a"])


def test_names_of_the_interface(spark):
    """Every step by its name, from the example to the consensus."""
    edges, nodes, scores = example_graph(spark)
    one = scores.where("label = 'scores_1'").select("gene", "score")
    similarity, beta = strata.compute_similarity_matrix(spark, edges)
    assert beta == pytest.approx(0.050715762239440715, abs=1e-14) and similarity.count() == 625
    pairs = strata.gene_edges(edges, nodes)
    bins = strata.compute_permutation_bins(spark, pairs, one, min_size=5)
    assert bins.select("bin_id").distinct().count() > 1
    runs = strata.permute_scores_many(spark, one, bins, seeds=range(1, 4))
    assert sorted(map(tuple, runs.where("run = 2").select("gene", "score").collect())) == sorted(map(tuple, strata.permute_scores(spark, one, bins, seed=2).collect()))
    assert strata.permute_network_many(spark, edges, seeds=[1, 2], Q=1).groupBy("run").count().count() == 2
    assert strata.permute_network(spark, edges, seed=1, preserve_connectivity=True, Q=1).count() == 55
    tree, leaves = strata.construct_hierarchy(spark, similarity, nodes, one)
    top = max(r["parent"] for r in tree.collect())
    assert leaves.count() == 25 and sorted(r["child"] for r in tree.collect()) == list(range(1, top))
    merged = strata.construct_hierarchies(spark, similarity, nodes, runs.unionByName(one.selectExpr("0 run", "gene", "score")))
    tables = strata.construct_hierarchies(spark, similarity, nodes, one.selectExpr("0 run", "gene", "score"), kernel="sql")
    assert sorted(map(tuple, tables.collect())) == sorted(map(tuple, merged.where("run = 0").collect()))
    with pytest.raises(ValueError, match="kernel"):
        strata.construct_hierarchies(spark, similarity, nodes, kernel="fortran")
    found = strata.process_hierarchies(spark, merged, lower_size_bound=1)
    assert isinstance(found, strata.ProcessHierarchiesResult) and 0 <= found.p_value <= 1
    group = strata.largest_component(found.observed_clusters.withColumnRenamed("cluster", "component"))
    clusters = found.observed_clusters.join(group, "node", "left_semi")
    assert clusters.count() == found.observed_cut_size > 1
    agreed = strata.perform_consensus(spark, [strata.ConsensusInput(pairs, clusters)] * 2, 2)
    assert isinstance(agreed, strata.ConsensusResult) and 1 < agreed.nodes.count() <= found.observed_cut_size and agreed.edges.count() > 0
    for wrong, message in ((similarity.where("i > 1"), "square"), (similarity.where("i > 1 and j > 1"), "size")):
        with pytest.raises(ValueError, match=message):
            strata.construct_hierarchy(spark, wrong, nodes, one)
    with pytest.raises(ValueError, match="no gene"):
        strata.construct_hierarchy(spark, similarity, nodes, one.selectExpr("concat('x', gene) gene", "score"))
    assert strata.PipelineConfig().with_scoring(strata.ScoringConfig(True, 0.5)).hierarchy.log_transform and strata.RuntimeConfig().n_jobs == -1
    assert len({x for x in strata.__all__ if hasattr(strata, x)}) == len(strata.__all__)


def test_statements(spark):
    pairs = spark.createDataFrame([(1, 2), (2, 1), (2, 3), (3, 3)], "u int, v int")
    assert sorted(map(tuple, sql.run(spark, "canonical_edges", edges=pairs).collect())) == [(1, 2), (2, 3)]
    sql.register(links=pairs)
    assert spark.sql("select count(*) from links").first()[0] == 4
    assert sql.run(spark, "select max(u) from {t}", t=pairs).first()[0] == 3
