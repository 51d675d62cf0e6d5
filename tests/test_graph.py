"""Hand-made graphs with answers by hand, and brute force on random ones."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from proxweave.functions.vectors import diagonal_gaussian, logspace_embedding, premetric, register_premetric, scalar_premetric, vector_premetric
from proxweave.operators import components as CC
from proxweave.operators import layout as L
from proxweave.operators import paths as P
from proxweave.operators import refine as R
from proxweave.operators import sparsify as S
from proxweave.operators.graph import ProximityGraph, both_ways, canonical, degrees
from proxweave.operators.knn import hybrid_distance, knn, knn_exact, knn_ivf, mutual_edges, pairwise, reweight, symmetric_edges
from proxweave.operators.mst import boruvka, local_forest, minimum_forest

EDGES = "src long, dst long, weight double"


def graph(spark, rows, n=None):
    rows = [(a, b, float(w)) for a, b, w in rows]
    n = n if n is not None else max([max(a, b) for a, b, _ in rows], default=-1) + 1
    return spark.createDataFrame(rows, EDGES), spark.range(n)


def random_edges(n, m, seed):
    rng = random.Random(seed)
    pairs = {tuple(sorted(rng.sample(range(n), 2))) for _ in range(m)}
    return [(a, b, rng.choice([1.0, 2.0, 3.0, 5.0])) for a, b in sorted(pairs)]


def points(spark, x):
    return spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(x)], "id long, v array<double>")


@pytest.mark.parametrize("n,m,seed", [(30, 25, 1), (40, 80, 2), (60, 40, 3)])
def test_components_agree(spark, n, m, seed):
    rows = random_edges(n, m, seed)
    e, v = graph(spark, rows, n)
    want = CC.local_components([(a, b) for a, b, _ in rows])
    star = {r["id"]: r["component"] for r in CC.star_components(e).collect()}
    assert star == want
    near = {r["id"]: r["root"] for r in CC.component_roots(v, e).collect()}
    far = {r["id"]: r["root"] for r in CC.component_roots(v, e, local_edges=1).collect()}
    assert near == far == {i: want.get(i, i) for i in range(n)}


def test_components_of_a_long_path(spark):
    e, v = graph(spark, [(i, i + 1, 1) for i in range(120)])
    assert {r["component"] for r in CC.star_components(e).collect()} == {0}


def test_components_odd_input(spark):
    e, v = graph(spark, [], 3)
    assert CC.star_components(e).count() == 0
    assert [r["component"] for r in CC.component_labels(v, e).orderBy("id").collect()] == [0, 1, 2]
    loop = spark.createDataFrame([(1, 1, 1.0), (None, 2, 1.0), (2, 3, None), (2, 3, 1.0)], EDGES)
    assert {(r["id"], r["component"]) for r in CC.star_components(loop).collect()} == {(2, 2), (3, 2)}


@pytest.mark.parametrize("seed", [1, 2])
def test_forest_ties(spark, seed):
    rows = random_edges(25, 60, seed)
    e, _ = graph(spark, rows)
    want = sorted(local_forest(rows))
    assert sorted(map(tuple, boruvka(e).collect())) == want
    assert sorted(map(tuple, minimum_forest(e).collect())) == want
    parts = len(set(CC.local_components([(a, b) for a, b, _ in rows]).values()))
    nodes = {x for a, b, _ in rows for x in (a, b)}
    assert len(want) == len(nodes) - parts


def test_knn_blocks_and_ties(spark):
    x = np.random.default_rng(0).normal(size=(70, 3)).round(1)
    x[10] = x[11]
    got = {(r["src"], r["rank"]): r["dst"] for r in knn_exact(points(spark, x), 4, block_rows=16).collect()}
    for i in range(70):
        d = np.sqrt(((x - x[i]) ** 2).sum(1))
        want = sorted((j for j in range(70) if j != i), key=lambda j: (d[j], j))[:4]
        assert [got[i, r] for r in range(1, 5)] == want
    one = {(r["src"], r["dst"]) for r in knn_exact(points(spark, x), 4, "manhattan").collect()}
    two = {(r["src"], r["dst"]) for r in knn_exact(points(spark, x), 4, "manhattan", block_rows=9).collect()}
    assert one == two


def test_duplicate_points_lose_their_edge(spark):
    near = knn_exact(points(spark, [[0, 0], [0, 0], [1, 0]]), 1)
    pairs = {(r["src"], r["dst"]) for r in symmetric_edges(near).collect()}
    assert (0, 1) not in pairs
    assert (0, 1) in {(r["src"], r["dst"]) for r in symmetric_edges(near, keep_duplicates=True).collect()}
    assert {(r["src"], r["dst"]) for r in mutual_edges(near).collect()} == {(0, 1)}


def test_ivf_recall(spark):
    x = np.random.default_rng(1).normal(size=(400, 8))
    v = points(spark, x)
    exact = {(r["src"], r["dst"]) for r in knn_exact(v, 10).collect()}
    found = {(r["src"], r["dst"]) for r in knn_ivf(v, 10, cells=16, probes=8).collect()}
    assert len(exact & found) / len(exact) >= 0.9
    with pytest.raises(ValueError):
        knn(v, 3, method="magic")
    with pytest.raises(ValueError):
        knn_exact(v, 0)


def test_premetrics(spark):
    a, b = [1.0, 2.0, 0.5, 0.7], [0.0, 1.0, 0.6, 0.9]
    df = spark.createDataFrame([(a, b)], "a array<double>, b array<double>")
    want = 0.0
    for m, n, s, t in ((1.0, 0.0, 0.5, 0.6), (2.0, 1.0, 0.7, 0.9)):
        s, t = s + 1e-8, t + 1e-8
        var = (s * s + t * t) / 2 + 1e-8
        want += (m - n) ** 2 / var + math.log(var / (s * t))
    row = df.select(diagonal_gaussian(F.col("a"), F.col("b")).alias("d"), premetric("manhattan")(F.col("a"), F.col("b")).alias("m")).first()
    assert row["d"] == pytest.approx(math.sqrt(2 * want))
    assert row["m"] == pytest.approx(2.3)
    register_premetric("first", lambda x, y: F.abs(x[0] - y[0]))
    slow = scalar_premetric(lambda x, y: abs(x - y).max())
    wide = vector_premetric(lambda x, y: np.abs(x - y).max(1))
    row = df.select(premetric("first")(F.col("a"), F.col("b")).alias("f"), slow(F.col("a"), F.col("b")).alias("s"), wide(F.col("a"), F.col("b")).alias("w")).first()
    assert (row["f"], row["s"], row["w"]) == (1.0, 1.0, 1.0)
    assert premetric("proxweave.functions.vectors:euclidean") is premetric("euclidean")
    with pytest.raises(ValueError):
        premetric("nothing")
    e = df.select(logspace_embedding(F.array(F.lit(2.0)), F.array(F.lit(math.e))).alias("v")).first()["v"]
    assert e == pytest.approx([2 / math.e, math.sqrt(2)])


def test_missing_weights_go(spark):
    e = spark.createDataFrame([(0, 1, 1.0), (0, 2, 2.0), (1, 2, 1.0)], EDGES)
    f = spark.createDataFrame([(0, [0.0]), (1, [1.0]), (2, [9.0])], "id long, features array<double>")
    gap = lambda a, b: F.when(F.abs(a[0] - b[0]) > 8.5, float("inf")).otherwise(F.abs(a[0] - b[0]))
    got = {(r["src"], r["dst"]): (r["weight"], r["euclid_dist"]) for r in reweight(e, f, gap).collect()}
    assert got == {(0, 1): (1.0, 1.0), (1, 2): (8.0, 1.0)}
    h = spark.createDataFrame([(0, 1, 2.0, 1.0), (0, 2, float("inf"), 3.0), (1, 2, None, 4.0)], EDGES + ", euclid_dist double")
    assert {r["dst"] + 10 * r["src"]: r["hybrid"] for r in hybrid_distance(h).collect()} == {1: 1.0, 2: float("inf"), 12: 4.0}
    assert pairwise(e, f, "euclidean", "d").count() == 3


def knee_of(y, use_median):
    y, x = np.array(y, float), np.arange(len(y), dtype=float)
    if len(y) <= 2:
        return 0
    keep = np.arange(len(y))
    if use_median and (y >= np.median(y)).sum() > 2:
        keep = np.nonzero(y >= np.median(y))[0]
    u, v = x[keep], y[keep]
    u = (u - u.min()) / (np.ptp(u) or 1)
    v = (v - v.min()) / np.ptp(v) if np.ptp(v) else np.zeros(len(v))
    line = v[0] + (v[-1] - v[0]) * u
    return int(keep[np.argmax(line - v)])


@pytest.mark.parametrize("y", [[9, 5, 3, 2, 1.5, 1.2, 1.1, 1], [4, 4, 4, 4], [3, 1], [5], [10, 9, 8, 1, 1, 1, 1]])
@pytest.mark.parametrize("use_median", [True, False])
def test_knee(spark, y, use_median):
    c = spark.createDataFrame([(i, float(v)) for i, v in enumerate(y)], "x long, y double")
    assert R.knee_point(c, use_median).first()["knee"] == knee_of(y, use_median)


def test_prune(spark):
    rows = [(0, 1, 1), (1, 2, 1.5), (0, 2, 9), (2, 3, 8), (3, 4, 1)]
    e, v = graph(spark, rows)
    kept = lambda p: sorted((r["src"], r["dst"]) for r in p.edges.collect())
    assert kept(R.prune(e, 5.0, preserve_mst=False)) == [(0, 1), (1, 2), (3, 4)]
    p = R.prune(e, 5.0)
    assert kept(p) == [(0, 1), (1, 2), (2, 3), (3, 4)] and p.restored == 1
    assert {(r["src"], r["dst"]) for r in p.pruned.collect()} == {(0, 2), (2, 3)}
    assert len(kept(R.prune(e, float("inf"), preserve_mst=False))) == 5
    assert kept(R.prune(e, 5.0, preserve_mst=False, max_components=1, nodes=v)) == [(0, 1), (1, 2), (2, 3), (3, 4)]
    one, _ = graph(spark, [(0, 1, 1)])
    assert R.prune(one).threshold is None


def test_two_hop_and_polish(spark):
    e, v = graph(spark, [(0, 1, 1), (1, 2, 1), (2, 3, 1)])
    assert sorted(map(tuple, R.two_hop(e).collect())) == [(0, 2), (1, 3)]
    f = spark.createDataFrame([(i, [float(i)]) for i in range(4)], "id long, features array<double>")
    assert R.polish(e, f).edges.count() == 5
    assert R.polish(e, f, max_new_edges=1).added.count() == 1
    assert R.polish(e, f, max_new_edges=None).edges.count() == 3
    out, history = R.refine(e, f, iterations=2, threshold=5.0, max_new_edges="all")
    assert history.first()["n_new_edges"] == 2 and out.count() >= 5


def test_lookups(spark, tmp_path):
    e, v = graph(spark, [(0, 1, 1), (1, 2, 2)], 4)
    g = ProximityGraph(v.withColumn("x", F.col("id") * 2), e, missing_weight=-7.0)
    assert sorted((r["id"], r["weight"]) for r in g.neighbors(1).collect()) == [(0, 1.0), (2, 2.0)]
    pairs = spark.createDataFrame([(2, 1), (0, 0), (0, 3)], "src long, dst long")
    assert {(r["src"], r["dst"]): r["weight"] for r in g.edge_weights(pairs).collect()} == {(2, 1): 2.0, (0, 0): 0.0, (0, 3): -7.0}
    assert g.node(2).first()["x"] == 4 and g.nodes_of([0, 3]).count() == 2
    with pytest.raises(ValueError):
        g.node(9)
    with pytest.raises(ValueError):
        g.component(5)
    assert tuple(g.summary().first()) == (4, 2, 2)
    assert tuple(g.shortest_path(0, 2).first()) == (3.0, [0, 1, 2]) and g.shortest_path(0, 3).first()["path"] is None
    assert not g.is_connected() and g.component_data(0).count() == 3
    assert g.subgraph(spark.createDataFrame([(0,), (1,)], "id long")).edges.count() == 1
    assert g.graph_distance(0, 2).first()["distance"] == 4.0
    with pytest.raises(ValueError):
        ProximityGraph(v, None)
    assert degrees(e, v).where("degree = 0").count() == 1
    twice = spark.createDataFrame([(0, 1, 1.0), (1, 0, 3.0), (2, 2, 1.0)], EDGES)
    assert tuple(canonical(twice, "sum").first()) == (0, 1, 4.0)
    with pytest.raises(ValueError):
        canonical(twice, "nope")
    assert both_ways(e).count() == 4


@pytest.mark.parametrize("seed", [4, 5])
def test_paths_agree(spark, seed):
    rows = random_edges(18, 26, seed)
    e, v = graph(spark, rows, 18)
    near = {(r["source"], r["id"]): r["dist"] for r in P.distances(e, v).collect()}
    far = {(r["source"], r["id"]): r["dist"] for r in P.distances(e, v.where("id < 4"), local_edges=1).collect()}
    d = np.full((18, 18), np.inf)
    np.fill_diagonal(d, 0)
    for a, b, w in rows:
        d[a, b] = d[b, a] = w
    for m in range(18):
        d = np.minimum(d, d[:, m : m + 1] + d[m : m + 1, :])
    assert near == {(i, j): d[i, j] for i in range(18) for j in range(18) if np.isfinite(d[i, j])}
    assert far == {k: x for k, x in near.items() if k[0] < 4}
    for r in P.shortest_paths(e, v, 0).collect():
        if r["path"] is None:
            assert np.isinf(d[0, r["target"]])
        else:
            w = {(a, b): c for a, b, c in rows} | {(b, a): c for a, b, c in rows}
            assert sum(w[x, y] for x, y in zip(r["path"], r["path"][1:])) == d[0, r["target"]] == r["distance"]


def test_betweenness_by_hand(spark):
    e, v = graph(spark, [(0, 1, 1), (1, 2, 1), (2, 3, 1), (3, 4, 1)])
    got = {r["id"]: r["centrality"] for r in P.betweenness(e, v, normalized=False).collect()}
    assert got == {0: 0.0, 1: 3.0, 2: 4.0, 3: 3.0, 4: 0.0}
    star, sv = graph(spark, [(0, i, 1) for i in range(1, 6)])
    assert {r["id"]: r["centrality"] for r in P.betweenness(star, sv).collect()}[0] == pytest.approx(1.0)
    by_edge = {(r["src"], r["dst"]): r["centrality"] for r in P.edge_betweenness(e, v, normalized=False).collect()}
    assert by_edge == {(0, 1): 8.0, (1, 2): 12.0, (2, 3): 12.0, (3, 4): 8.0}
    assert [r["id"] for r in P.central_nodes(e, v, 2, "closeness").collect()] == [2, 1]
    with pytest.raises(ValueError):
        P.centrality(e, v, "fame")
    with pytest.raises(ValueError):
        P.betweenness(e, v, local_edges=1)


@pytest.mark.parametrize("seed", [6, 7, 8])
def test_bridges_and_cut_vertices(spark, seed):
    rows = random_edges(20, 22, seed)
    e, v = graph(spark, rows, 20)
    n = lambda r, nodes: len(nodes) - len(c := CC.local_components([(a, b) for a, b, _ in r])) + len(set(c.values()))
    base = n(rows, range(20))
    want = {(a, b) for a, b, w in rows if n([x for x in rows if x != (a, b, w)], range(20)) > base}
    assert {(r["src"], r["dst"]) for r in P.structural_bridges(e, v).collect()} == want
    cut = {i: n([x for x in rows if i not in x[:2]], set(range(20)) - {i}) - base for i in range(20)}
    assert {r["id"]: r["importance"] for r in P.articulation_points(e, v).collect()} == {i: c for i, c in cut.items() if c > 0}


def test_coarsening(spark):
    rows = [(0, 1, 5.0), (1, 2, 1.0), (2, 3, 4.0), (3, 4, 1.0)]
    e, v = graph(spark, rows)
    e = e.withColumn("distance", 10 - F.col("weight"))
    m = {r["id"]: r["meta_id"] for r in S.mutual_coarsening(e, v).collect()}
    assert m == {0: 0, 1: 0, 2: 1, 3: 1, 4: 2}
    got = sorted((r["src"], r["dst"], r["weight"], r["distance"]) for r in S.contract(e, S.mutual_coarsening(e, v)).collect())
    assert got == [(0, 1, 1.0, 9.0), (1, 2, 1.0, 9.0)]
    c = S.coarsen(e, v, levels=3, k=4)
    assert len(c.levels) == 1 and c.membership.count() == 5
    assert S.post_sparsify(c, 3).count() > 0
    with pytest.raises(ValueError):
        S.symmetrize(e, "never")
    with pytest.raises(ValueError):
        S.threshold_edges(e)
    with pytest.raises(ValueError):
        S.row_stochastic(e, "x")


def test_reductions(spark):
    x = np.random.default_rng(3).normal(size=(50, 6)) * [5, 3, 1, 0.5, 0.1, 0.01]
    v = points(spark, x)
    y, info = L.reduce_vectors(v, "pca", n_components=2)
    got = np.array([r["v"] for r in y.orderBy("id").collect()])
    c = x - x.mean(0)
    _, s, vt = np.linalg.svd(c, full_matrices=False)
    assert np.allclose(np.abs(got), np.abs(c @ vt[:2].T))
    assert info["explained_variance"] == pytest.approx((s[:2] ** 2 / 50).tolist())
    assert L.reduce_vectors(v, "ipca", variance=0.95)[1]["n_components"] == 2
    assert L.reduce_vectors(v, "rsvd", n_components=3)[0].select(F.size("v")).first()[0] == 3
    for m in ("rp", "srp"):
        assert L.reduce_vectors(v, m, n_components=4)[0].select(F.size("v")).first()[0] == 4
    assert L.reduce_vectors(v, "none")[0].count() == 50
    with pytest.raises(ValueError):
        L.reduce_vectors(v, "tsne")


def test_interpolation(spark):
    e, v = graph(spark, [(0, 1, 1), (1, 2, 1), (2, 3, 1)])
    known = spark.createDataFrame([(0, [0.0, 0.0]), (3, [3.0, 6.0])], "id long, y array<double>")
    y = {r["id"]: r["y"] for r in L.laplacian_interpolate(e, known, v, tol=1e-10).collect()}
    assert y[1] == pytest.approx([1.0, 2.0]) and y[2] == pytest.approx([2.0, 4.0]) and y[3] == [3.0, 6.0]
    p = S.row_stochastic(e)
    h = {r["id"]: r["y"] for r in L.harmonic_interpolate(p, known, v, max_iter=60, tol=1e-8).collect()}
    assert h[1] == pytest.approx([1.0, 2.0], abs=1e-3)
    b = {r["id"]: r["y"] for r in L.barycentric(p, known, v).collect()}
    assert b[1] == pytest.approx([0.0, 0.0]) and b[2] == pytest.approx([3.0, 6.0])
    marks = L.blue_noise_landmarks(e, v, 2)
    assert marks.count() == 2
    assert L.landmark_layout(e, v, 3, interpolation="barycentric").count() == 4
    assert L.with_layout(v, known).columns == ["id", "UMAP_2D_1", "UMAP_2D_2"]
    assert L.pad_low_degree(e, v, 2).count() > 3
    assert L.sampled_points(v, 2).count() == 2 and L.sampled_points(v, 2, stride=True).count() == 2
    with pytest.raises(ValueError):
        L.landmark_layout(e, v, 2, interpolation="guess")


def test_tables_are_released(spark, tmp_path):
    from proxweave import session

    before = session.materialize(spark.range(3), "kept")
    assert before.count() == 3
    session.drop_table(spark, before)
    session.drop_table(spark, spark.range(1))
    files = session.materialize(spark.range(2), "gone").inputFiles()
    assert session.release_tables(spark) >= 1 and session.release_tables(spark) == 0
    from pathlib import Path

    assert not any(Path(f.removeprefix("file://")).exists() for f in files)
