"""Registered queries do the whole job of their operators."""

import numpy as np

from proxweave.operators import paths as P
from proxweave.plans import queries as Q

SF = "/root/testdata/sf0.001"


def test_betweenness_takes_every_source(spark):
    edges = {(r["src"], r["dst"]): r["weight"] for r in Q.graph(spark, SF).collect()}
    adj = {}
    for (a, b), w in edges.items():
        adj.setdefault(a, []).append((b, w))
        adj.setdefault(b, []).append((a, w))
    n, on, through = Q.ids(spark, SF).count(), dict.fromkeys(edges, 0), dict.fromkeys(adj, 0.0)
    for s in adj:
        _, prev, _ = P.dijkstra(adj, s)
        for t in prev:
            while t in prev:
                on[min(t, prev[t]), max(t, prev[t])] += 1
                t = prev[t]
                through[t] += t != s
    got = {(r["src"], r["dst"]): r["centrality"] for r in Q.edge_betweenness_centrality(spark, SF).collect()}
    assert got.keys() == on.keys() and np.allclose([got[k] for k in on], [v / (n * (n - 1) / 2) for v in on.values()])
    nodes = {r["id"]: r["centrality"] for r in Q.betweenness_centrality(spark, SF).collect()}
    assert np.allclose([nodes[i] for i in through], [v / ((n - 1) * (n - 2)) for v in through.values()])


def test_sums_of_distances_are_the_same_both_ways(spark):
    from proxweave.operators.paths import reaches

    edges = spark.createDataFrame([(1, 2, 1.0), (2, 3, 2.5), (1, 3, 4.0), (5, 6, 0.5)], "src long, dst long, weight double")
    nodes = spark.createDataFrame([(i,) for i in (1, 2, 3, 5, 6, 9)], "id long")
    want = {1: (4.5, 3.5), 2: (3.5, 2.5), 3: (6.0, 3.5), 5: (0.5, 0.5), 6: (0.5, 0.5), 9: (0.0, 0.0)}
    for limit in (100, 0):
        assert {r["id"]: (r["total"], r["farthest"]) for r in reaches(edges, nodes, local_edges=limit).collect()} == want
