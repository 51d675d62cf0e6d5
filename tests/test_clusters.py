"""Communities, clusters, densities, storage, streams."""

import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from proxweave.operators import clusters as C
from proxweave.operators import density as D
from proxweave.operators.community import _distributed_louvain, label_propagation, leiden, louvain, modularity
from proxweave.operators.graph import ProximityGraph
from proxweave.plans.build import build_graph, communities
from proxweave.sources import store
from proxweave.streaming.edges import read_edges, windowed_pairs, write_pairs

EDGES = "src long, dst long, weight double"


@pytest.fixture(scope="module")
def two_cliques(spark):
    rows = [(a, b, 1.0) for s in (0, 5) for a in range(s, s + 5) for b in range(a + 1, s + 5)] + [(4, 5, 0.1)]
    return spark.createDataFrame(rows, EDGES), spark.range(10)


def partition(df):
    out = {}
    for r in df.collect():
        out.setdefault(r["label"], set()).add(r["id"])
    return sorted(map(sorted, out.values()))


def test_communities_of_two_cliques(spark, two_cliques):
    e, v = two_cliques
    want = [list(range(5)), list(range(5, 10))]
    assert partition(louvain(e, v)) == want
    assert partition(leiden(e, v)) == want
    far = _distributed_louvain(e, v, 1.0, True, 5, 24)
    assert partition(far) == want
    assert modularity(e, far).first()[0] == pytest.approx(modularity(e, louvain(e, v)).first()[0])
    lp = label_propagation(e, v)
    assert modularity(e, lp).first()[0] >= 0


def test_isolated_nodes_and_empty_graphs(spark):
    none = spark.createDataFrame([], EDGES)
    assert partition(louvain(none, spark.range(3))) == [[0], [1], [2]]
    assert partition(_distributed_louvain(none, spark.range(2), 1.0, False, 3, 4)) == [[0], [1]]


def test_reassign_and_interface(spark, two_cliques):
    e, v = two_cliques
    labels = spark.createDataFrame([(i, 0 if i < 4 else 2 if i == 4 else 1) for i in range(10)], "id long, label int")
    stats = labels.groupBy(F.col("label").alias("cluster_id")).agg(F.count(F.lit(1)).alias("size"))
    pruned = C.prune_clusters(stats, 2)
    assert {r["cluster_id"]: r["pruned"] for r in pruned.collect()} == {0: False, 1: False, 2: True}
    new = {r["id"]: r["label"] for r in C.reassign_pruned(e, labels, pruned).collect()}
    assert new[4] == 0
    i = C.interface_edges(e.withColumnRenamed("weight", "distance"), labels, pruned)
    assert i.count() == 5 and i.where("edge_type = 'pruned_community'").count() == 0
    s = {r["cluster_id"]: r for r in C.community_statistics(e.withColumn("distance", F.col("weight")), labels).collect()}
    assert s[0]["internal_edges"] == 6 and s[0]["external_edges"] == 4 and s[0]["edge_density"] == 1.0
    assert s[2]["conductance"] == 1.0 and s[2]["edge_density"] == 0.0
    d = {r["cluster_id"]: r for r in C.community_statistics(e.withColumn("distance", F.col("weight")), labels, double_count=True).collect()}
    assert d[0]["edge_density"] == 2.0


def test_run_comparison(spark):
    a = spark.createDataFrame([(0, 1), (1, 2)], "src long, dst long")
    b = spark.createDataFrame([(1, 2), (2, 3)], "src long, dst long")
    la = spark.createDataFrame([(i, i % 2) for i in range(4)], "id long, label int")
    r = C.compare_runs(la, la, a, b).first()
    assert r["nmi"] == pytest.approx(1.0) and r["jaccard_similarity"] == pytest.approx(1 / 3)
    lb = spark.createDataFrame([(i, i // 2) for i in range(4)], "id long, label int")
    assert C.normalized_mutual_information(la, lb).first()[0] == pytest.approx(0.0, abs=1e-12)
    m = C.pairwise_matrix({"a": a, "b": b}, "jaccard")
    assert {(x["run1"], x["run2"]): round(x["value"], 3) for x in m.collect()}["a", "b"] == 0.333
    with pytest.raises(ValueError):
        C.compare_resolutions([("a", 1.0, a), ("b", 2.0, b)], "cosine")
    with pytest.raises(ValueError):
        C.pairwise_matrix({"a": a}, "x")


def test_yeo_johnson(spark):
    x = np.random.default_rng(0).lognormal(size=300)
    df = spark.createDataFrame([(float(v),) for v in x], "x double")
    lam, mean, sd = C.fit_yeo_johnson(df, "x", rounds=4)
    t = lambda g: np.log1p(x) if abs(g) < 1e-12 else ((x + 1) ** g - 1) / g
    ll = lambda g: -len(x) / 2 * np.log(t(g).var()) + (g - 1) * np.log1p(x).sum()
    assert ll(lam) >= max(ll(g) for g in np.linspace(-2, 2, 401)) - 1e-2


def test_density(spark):
    e = spark.createDataFrame([(0, 1, 1.0), (1, 2, 2.0), (0, 2, 4.0)], EDGES)
    v = spark.range(4)
    d = {r["id"]: r["density"] for r in D.raw_density(e, v, "knn_distance", k=2, dimension=1).collect()}
    assert d[0] == pytest.approx(1 / 4) and d[1] == pytest.approx(1 / 2) and d[3] == pytest.approx(1e-6)
    one = {r["id"]: r["density"] for r in D.raw_density(e, v, "degree").collect()}
    assert one == {0: 1.0, 1: 1.0, 2: 1.0, 3: 0.0}
    with pytest.raises(ValueError):
        D.raw_density(e, v, "mass")
    with pytest.raises(ValueError):
        D.raw_density(e, v, boundary_correction="k+1")
    with pytest.raises(ValueError):
        D.smooth_density(e, D.raw_density(e, v), "melt")
    x = spark.createDataFrame([(0, 1.0), (1, 0.0), (2, 0.0), (3, 5.0)], "id long, density double")
    got = np.array([r["density"] for r in D.smooth_density(e, x, "tikhonov", lam=0.5, normalize=False).orderBy("id").collect()])
    a = np.zeros((4, 4))
    for s, t, w in ((0, 1, 1.0), (1, 2, 2.0), (0, 2, 4.0)):
        a[s, t] = a[t, s] = w
    lap = np.diag(a.sum(1)) - a
    assert np.allclose(got, np.linalg.solve(np.eye(4) + 0.5 * lap, [1, 0, 0, 5]), atol=1e-6)
    med = {r["id"]: r["density"] for r in D.smooth_density(e, x, "gaussian", iterations=1, use_median=True, normalize=False).collect()}
    assert med[3] == 5.0
    both = D.estimate_density(e, v, smooth={"iterations": 1})
    assert both.columns == ["id", "raw_density", "density"] and both.count() == 4
    with pytest.raises(ValueError):
        D.kernel_density(spark.createDataFrame([(0, [1.0])], "id long, v array<double>"))


def test_store(spark, tmp_path):
    e = spark.createDataFrame([(0, 1, 1.0), (1, 2, 2.0)], EDGES)
    g = ProximityGraph(spark.range(3).withColumn("x", F.col("id")), e)
    path = f"file://{tmp_path}/g"
    lay = spark.createDataFrame([(i, [float(i), 0.0]) for i in range(3)], "id long, y array<double>")
    store.save_graph(g, path, layout=lay)
    back = store.load_graph(spark, path)
    assert back.edges.count() == 2 and back.missing_weight == float("inf") and back.components.count() == 3
    assert json.loads((tmp_path / "g/metadata.json").read_text())["n_components"] == 1
    loader = store.GraphLoader(spark, path)
    assert loader.edge_arrays.count() == 4 and loader.labels.select("label").distinct().count() == 1
    assert "UMAP_2D_1" in loader.wrapper().nodes.columns
    runs = f"file://{tmp_path}/runs"
    for r in (1.0, 2.0):
        store.save_run(runs, "a", r, e, spark.range(2).withColumnRenamed("id", "cluster_id"))
    assert store.load_runs(spark, runs, resolution=2.0).count() == 2 and store.load_runs(spark, runs, run_name="b").count() == 0
    with pytest.raises(ValueError):
        store.load_runs(spark, runs, "nothing")
    for fmt in store.FORMATS:
        store.export_edges(e, f"file://{tmp_path}/{fmt}", fmt)
    import xml.dom.minidom as md

    for fmt in ("gexf", "graphml"):
        text = "".join(p.read_text() for p in sorted((tmp_path / fmt).glob("part-*")))
        assert len(md.parseString(text).getElementsByTagName("edge")) == 2
    with pytest.raises(ValueError):
        store.export_edges(e, path, "dot")
    with pytest.raises(ValueError):
        store.read_layout(spark, "layout.xyz")
    (tmp_path / "l.csv").write_text("id,x,y\n3,1.5,2.5\n")
    assert store.read_layout(spark, f"file://{tmp_path}/l.csv").first()["y"] == [1.5, 2.5]
    assert store.with_run_columns(g.nodes, spark.range(3).withColumn("z", F.lit(1))).columns == ["id", "x", "z"]


def test_stream(spark, tmp_path):
    rows = [(f"2026-01-01 0{h}:00:00", a, b, 1.0) for h, a, b in ((1, 1, 2), (1, 2, 1), (3, 1, 2), (5, 3, 4))]
    spark.createDataFrame(rows, "t string, src long, dst long, weight double").select(F.to_timestamp("t").alias("ts"), "src", "dst", "weight").write.parquet(f"{tmp_path}/in")
    s = windowed_pairs(read_edges(spark, f"{tmp_path}/in", "ts timestamp, src long, dst long, weight double"))
    q = write_pairs(s, f"{tmp_path}/out", f"{tmp_path}/cp")
    q.awaitTermination(60)
    got = {(r["src"], r["dst"], r["weight"]) for r in spark.read.parquet(f"{tmp_path}/out").collect()}
    assert (1, 2, 2.0) in got


def test_build_and_communities(spark, tmp_path):
    rng = np.random.default_rng(42)
    x = np.concatenate([rng.normal(c, 0.3, (20, 4)) for c in ([1, 1, 1, 1], [-1, -1, -1, -1], [1, -1, 1, -1])])
    nodes = spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(x)], "id long, embedding array<double>")
    b = build_graph(nodes, k=5, iterations=1, max_new_edges=20)
    assert b.graph.edges.columns == ["src", "dst", "weight", "euclid_dist", "is_mst"]
    assert b.history.count() == 1 and b.stats.first()["count"] == b.graph.edges.count()
    runs = communities(b.graph.edges.withColumnRenamed("weight", "distance"), nodes, [1.0], min_cluster_size=2, output=f"file://{tmp_path}/c")
    lab = {r["id"]: r["label"] for r in runs[0].labels.collect()}
    pure = sum(max(sum(lab[i] == c for i in range(s, s + 20)) for c in set(lab.values())) for s in (0, 20, 40))
    assert len(lab) == 60 and pure >= 30
    assert len({frozenset(lab[i] for i in range(s, s + 20)) for s in (0, 20, 40)}) == 3
    assert b.timings.summary(spark).count() == 4
    with pytest.raises(ValueError):
        communities(b.graph.edges, nodes, [1.0], algorithm="guess")


def test_warm_start(spark, two_cliques):
    e, v = two_cliques
    warm = spark.createDataFrame([(i, i // 5) for i in range(10)], "id long, label int")
    want = [list(range(5)), list(range(5, 10))]
    assert partition(louvain(e, v, initial=warm)) == want
    assert partition(_distributed_louvain(e, v, 1.0, False, 4, 24, warm)) == want


def test_command_line(spark, tmp_path, capsys, two_cliques):
    from proxweave.plans import cli

    e, v = two_cliques
    store.save_graph(ProximityGraph(v, e.withColumn("weight", 2 - F.col("weight"))), f"file://{tmp_path}/g")
    cli.main([f"file://{tmp_path}/g", f"file://{tmp_path}/runs", "--resolutions", "1", "2", "--coarsen-levels", "1", "--min-cluster-size", "1"])
    assert capsys.readouterr().out.count("interface edges") == 2
    assert store.load_runs(spark, f"file://{tmp_path}/runs", "labels", resolution=2.0).count() == 10


def test_layouts(spark, two_cliques):
    from proxweave.operators import layout as L

    e, v = two_cliques
    flat, deep = L.layouts(e, v, k=4, epochs=30)
    y = {r["id"]: np.array(r["y"]) for r in flat.collect()}
    near = np.mean([np.linalg.norm(y[i] - y[j]) for i in range(5) for j in range(i)])
    apart = np.mean([np.linalg.norm(y[i] - y[j]) for i in range(5) for j in range(5, 10)])
    assert near < apart and len(deep.first()["y"]) == 3
    far = L.layouts(e, v, k=4, landmark_nodes=3, n_landmarks=4, interpolation="harmonic")
    assert far[0].count() == 10 and len(far[1].first()["y"]) == 3
    with pytest.raises(ValueError):
        L.force_layout(e, v, flat, local_nodes=2)
