"""Communities: one algorithm on arrays and on DataFrames, its phases, and their guarantees."""

import numpy as np
import pytest

from proxweave.operators.community import leiden, louvain, modularity


def planted(rng, groups, size, inside, between):
    n = groups * size
    return [(i, j, float(rng.integers(1, 5))) for i in range(n) for j in range(i) if rng.random() < (inside if i // size == j // size else between)]


def frames(spark, rows, ids):
    edges = spark.createDataFrame([(7 * a, 7 * b, w) for a, b, w in rows], "src long, dst long, weight double")
    return edges, spark.createDataFrame([(7 * i,) for i in ids], "id long")


def labels_of(df):
    return {r["id"]: r["label"] for r in df.collect()}


@pytest.mark.parametrize("refine", [False, True])
def test_arrays_and_dataframes_make_the_same_moves(spark, refine):
    rng = np.random.default_rng(1)
    edges, nodes = frames(spark, planted(rng, 4, 9, 0.6, 0.06), range(38))
    here = labels_of(louvain(edges, nodes, refine=refine, max_rounds=8, max_levels=3))
    assert here == labels_of(louvain(edges, nodes, refine=refine, max_rounds=8, max_levels=3, local_edges=0))
    assert len(here) == 38 and here[7 * 37] != here[7 * 36]


def test_warm_start_is_the_same_both_ways(spark):
    rng = np.random.default_rng(2)
    edges, nodes = frames(spark, planted(rng, 3, 7, 0.7, 0.1), range(21))
    warm = spark.createDataFrame([(7 * i, i % 4) for i in range(15)], "id long, label long")
    short = {"initial": warm, "max_rounds": 5, "max_levels": 2}
    assert labels_of(leiden(edges, nodes, **short)) == labels_of(leiden(edges, nodes, **short, local_edges=0))


@pytest.mark.parametrize("seed", range(4))
def test_leiden_finds_planted_groups_and_connected_ones(spark, seed):
    rng = np.random.default_rng(seed)
    rows = planted(rng, 6, 25, 0.35, 0.01 + 0.01 * seed)
    edges, nodes = frames(spark, rows, range(150))
    found = labels_of(leiden(edges, nodes))
    truth = spark.createDataFrame([(7 * i, i // 25) for i in range(150)], "id long, label long")
    got = modularity(edges, spark.createDataFrame(list(found.items()), "id long, label long")).first()[0]
    assert got >= 0.93 * modularity(edges, truth).first()[0]
    adj = {i: set() for i in found}
    for a, b, _ in rows:
        if found[7 * a] == found[7 * b]:
            adj[7 * a].add(7 * b)
            adj[7 * b].add(7 * a)
    for c in set(found.values()):
        members = [i for i in found if found[i] == c]
        seen, queue = {members[0]}, [members[0]]
        while queue:
            for j in adj[queue.pop()] - seen:
                seen.add(j)
                queue.append(j)
        assert seen == set(members)


def test_resolution_and_empty(spark):
    rng = np.random.default_rng(9)
    edges, nodes = frames(spark, planted(rng, 4, 12, 0.6, 0.05), range(48))
    few, many = (len(set(labels_of(leiden(edges, nodes, resolution=r)).values())) for r in (0.2, 4.0))
    assert few <= 4 < many
    none = edges.limit(0)
    for limit in (100, 0):
        assert len(set(labels_of(leiden(none, nodes, local_edges=limit)).values())) == 48


def test_turns_in_arrays_are_those_of_dataframes(spark):
    from pyspark.sql import functions as F

    from proxweave.operators.community import _halves

    ids = [0, 1, -1, 7, 2**40 + 3, -(2**62), *range(100, 400)]
    df = spark.createDataFrame([(i,) for i in ids], "id long")
    for r in (0, 1, 23):
        turn = {x["id"]: x["t"] for x in df.select("id", (F.pmod(F.xxhash64("id", F.lit(r)), F.lit(2)) == 0).alias("t")).collect()}
        assert _halves(np.array(ids), r).tolist() == [turn[i] for i in ids]


def test_moves_in_pieces_are_the_same(monkeypatch):
    from proxweave.operators import community as C

    rows = planted(np.random.default_rng(6), 5, 12, 0.5, 0.05)
    src, dst, w = (np.array(x) for x in zip(*rows))
    run = lambda: C._communities_here(src, dst, w, 3 * np.arange(60), 1.0, True, 10, 24, None)
    whole = run()
    monkeypatch.setattr(C, "ARCS", 7)
    assert (run() == whole).all() and 1 < len(set(whole)) < 60


def test_six_gigabytes_of_edges_run_in_arrays():
    import inspect

    assert inspect.signature(louvain).parameters["local_edges"].default >= 5_000_000
