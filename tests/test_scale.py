"""Results and forms that only larger or more connected tables reach."""

from proxweave.operators.graph import ProximityGraph


def graph_of(spark, edges, n):
    return spark.createDataFrame(edges, "src long, dst long, weight double"), spark.range(n)


def test_data_of_a_component_that_is_not_there_is_empty(spark):
    e, v = graph_of(spark, [(0, 1, 1.0), (1, 2, 1.0)], 3)
    g = ProximityGraph(v, e)
    assert g.component_data(1).count() == 0 and g.component_data(0).count() == 3


def test_degree_statistics_search_nothing(spark, monkeypatch):
    from proxweave.operators import paths as P
    from proxweave.plans import queries as Q

    def none(*a, **k):
        raise AssertionError("a search")

    for f in ("reaches", "distances"):
        monkeypatch.setattr(P, f, none)
    s = {r["component"]: r["mean_degree"] for r in Q.degree_stats_by_component(spark, "/root/testdata/sf0.001").collect()}
    assert len(s) > 1 and max(s.values()) > 0


def test_padding_where_no_node_lacks_any(spark):
    from proxweave.operators.layout import pad_low_degree

    e, v = graph_of(spark, [(0, 1, 1.0), (1, 2, 1.0), (0, 2, 2.0)], 3)
    assert pad_low_degree(e, v, 2).count() == 3
    extra = {(r["src"], r["dst"]) for r in pad_low_degree(e, v, 2, always=True).collect()} - {(0, 1), (1, 2), (0, 2)}
    assert extra == {(3, 4)}
    low = pad_low_degree(e, v, 3, always=True).collect()
    assert len(low) == 3 + 3 and sum(r["dst"] > 2 for r in low) == 3


def test_pairs_of_blocks_are_not_shuffled(spark):
    from proxweave.operators.knn import knn_exact

    df = spark.range(400).selectExpr("id", "array(cast(pmod(id * 7919, 400) as double), cast(pmod(id, 7) as double)) as v")
    near = knn_exact(df, 3, block_rows=20)
    plan = near._jdf.queryExecution().optimizedPlan().toString().split("MapInArrow")[1]
    assert "Join Cross" in plan and "Repartition" not in plan.split("Join Cross")[0]
    got = [tuple(r) for r in near.orderBy("src", "rank").collect()]
    assert got == [tuple(r) for r in knn_exact(df, 3, block_rows=1000).orderBy("src", "rank").collect()]


def test_array_searches_equal_dijkstra_and_are_spread(spark):
    from collections import defaultdict

    import numpy as np

    from proxweave.operators import paths as P

    rng = np.random.default_rng(5)
    pairs = sorted({(min(a, b), max(a, b)) for a, b in rng.integers(0, 40, (70, 2)).tolist() if a != b})
    rows = [(a, b, float(rng.integers(1, 4))) for a, b in pairs]  # many ties
    e, v = graph_of(spark, rows, 42)
    adj = P.local_adjacency(e)
    want = defaultdict(float)
    for s in adj:
        for i, x in P.brandes(adj, s).items():
            want[i] += x / 2
    got = {r["id"]: r["centrality"] for r in P.betweenness(e, v, normalized=False).collect()}
    assert len(got) == 42 and np.allclose([got[i] for i in range(42)], [want[i] for i in range(42)])
    far = {r["id"]: r["farthest"] for r in P.reaches(e, v).collect()}
    assert all(far[s] == max(P.dijkstra(adj, s)[0].values()) for s in adj)
    assert P.reaches(e, v).rdd.getNumPartitions() > 100


def test_communities_of_a_million_edges_run_in_arrays():
    import inspect

    from proxweave.operators.community import louvain

    assert inspect.signature(louvain).parameters["local_edges"].default >= 1_000_000


def test_two_hops_by_bits_equal_the_join(spark):
    from proxweave.operators.refine import two_hop

    e, _ = graph_of(spark, [(i * 3, (i * j) % 97 * 3 + 1, 1.0) for i in range(60) for j in (2, 5, 7)], 1)
    e = e.selectExpr("least(src, dst) as src", "greatest(src, dst) as dst").distinct()
    by_bits = two_hop(e, wedges=0)
    assert "ArrowPython" not in two_hop(e)._jdf.queryExecution().optimizedPlan().toString()
    assert by_bits.count() == by_bits.distinct().count() and {tuple(r) for r in by_bits.collect()} == {tuple(r) for r in two_hop(e).collect()}


def test_spectral_layout_beyond_the_whole_matrix(spark):
    import numpy as np

    from proxweave.operators.layout import spectral_layout

    rng = np.random.default_rng(3)

    def ring(low, n):
        return [(low + i, low + (i + s) % n, float(rng.uniform(0.2, 1))) for i in range(n) for s in (1, 2, 5)]

    def matrix(rows, n):
        a = np.zeros((n, n))
        for i, j, w in rows:
            a[i, j] = a[j, i] = w
        scale = 1 / np.sqrt(np.maximum(a.sum(1), 1e-12))
        return scale[:, None] * a * scale[None, :]

    whole = ring(0, 60)
    e, v = graph_of(spark, whole, 60)
    dense, sparse = ({r["id"]: r["y"] for r in spectral_layout(e, v, 3, local_nodes=m).collect()} for m in (100, 0))
    assert dense.keys() == sparse.keys() and np.allclose([dense[i] for i in range(60)], [sparse[i] for i in range(60)], atol=1e-6)
    parts = ring(0, 30) + ring(30, 20)  # and nodes 50, 51 alone
    e, v = graph_of(spark, parts, 52)
    y = np.array([r["y"] for r in spectral_layout(e, v, 3, local_nodes=0).orderBy("id").collect()])
    a = matrix(parts, 52)
    want = np.sort(np.linalg.eigvalsh(np.eye(52) - a))[1:4]
    assert np.allclose(y.T @ y, np.eye(3)) and np.allclose(y - a @ y, y * want, atol=1e-6)


def test_neighbours_of_the_index_are_exact_if_asked(spark):
    import numpy as np

    from proxweave.operators.knn import knn_exact, knn_ivf

    x = np.random.default_rng(8).integers(0, 4, (600, 6)).astype(float)  # many ties and copies
    v = spark.createDataFrame([(5 * i, r) for i, r in enumerate(x.tolist())], "id long, v array<double>")
    exact = {tuple(r) for r in knn_exact(v, 4).collect()}
    options = {"cells": 40, "probes": 2}
    assert {tuple(r) for r in knn_ivf(v, 4, **options, exact=True).collect()} == exact
    assert {tuple(r) for r in knn_ivf(v, 4, **options).collect()} != exact


def test_single_precision_rules_out_no_neighbour(spark):
    import numpy as np

    from proxweave.operators import knn as K

    rng = np.random.default_rng(4)
    for shift, spread in ((0.0, 1.0), (1e6, 1.0), (1e3, 1e-4), (0.0, 1e25)):
        a, b = (shift + spread * rng.standard_normal((n, 5)) for n in (70, 900))
        d = K._exact(a[:, None, :], b[None], "euclidean")
        limit = np.sort(d, 1)[:, 9]
        i, j, x = K._within(a, b, np.arange(70), np.arange(100, 1000), limit, "euclidean")
        assert set(zip(i.tolist(), j.tolist())) == set(zip(*(z.tolist() for z in np.nonzero(d <= limit[:, None])))) and np.array_equal(x, d[i, j])


def test_blocks_of_large_tables_have_more_rows(spark, monkeypatch):
    from proxweave.operators import knn as K

    seen = []
    monkeypatch.setattr(K, "BLOCK_ROWS", 4)
    monkeypatch.setattr(K, "materialize", lambda df, label: df)
    monkeypatch.setattr(K, "_scan_pairs", lambda packed, blocks: seen.append(blocks) or packed)
    for n in (256, 1024, 4096):
        K.knn_exact(spark.range(n).selectExpr("id", "array(cast(id as double)) as v"), 2)
    assert seen == [64, 64, 256] and K.SLICES <= 4


def test_candidates_of_the_exact_search_grow_with_the_rows(spark, monkeypatch):
    from proxweave.operators import knn as K

    seen, top = [], K._top
    monkeypatch.setattr(K, "_top", lambda found, k: seen.append(found.count()) or top(found, k))
    for n in (120, 480):  # 6 and 24 blocks
        df = spark.range(n).selectExpr("id", f"array(cast(pmod(id * 7919, {n}) as double), cast(pmod(id, 7) as double)) as v")
        assert K.knn_exact(df, 3, block_rows=20).count() == 3 * n
    assert all(s <= 4 * 3 * n for s, n in zip(seen, (120, 480))) and len(seen) == 2
