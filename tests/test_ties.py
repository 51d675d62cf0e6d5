"""Ties among neighbours, and both methods for both metrics."""

import numpy as np
import pytest

from proxweave.operators.knn import knn
from proxweave.session import shared_dir


def brute(rows, k, metric):
    out = {}
    for i, v in rows:
        far = [(np.sqrt(((np.array(v) - w) ** 2).sum()) if metric == "euclidean" else np.abs(np.array(v) - w).sum(), j) for j, w in rows if j != i]
        out[i] = [j for _, j in sorted(far)[:k]]
    return out


@pytest.mark.parametrize("metric", ["euclidean", "manhattan"])
def test_any_number_of_ties_go_by_id(spark, metric):
    rows = [(i, [1.0, 2.0]) for i in range(198, -1, -1)] + [(500, [1.5, 2.0]), (600, [9.0, 9.0])]
    df = spark.createDataFrame(rows, "id long, v array<double>")
    for options in ({}, {"block_rows": 40}):
        got = {}
        for r in sorted(knn(df, 5, metric=metric, **options).collect(), key=lambda r: r["rank"]):
            got.setdefault(r["src"], []).append(r["dst"])
        assert got == brute(rows, 5, metric)


@pytest.mark.parametrize("metric", ["euclidean", "manhattan"])
def test_both_methods_take_both_metrics(spark, metric):
    rng = np.random.default_rng(3)
    rows = [(i, rng.normal(size=4).tolist()) for i in range(120)]
    df = spark.createDataFrame(rows, "id long, v array<double>")
    got = {}
    for r in sorted(knn(df, 4, metric=metric, exact_rows=1).collect(), key=lambda r: r["rank"]):
        got.setdefault(r["src"], []).append(r["dst"])
    assert got == brute(rows, 4, metric)  # the default probes reach all cells of so few rows
    with pytest.raises(ValueError):
        knn(df, 4, metric="cosine", exact_rows=1)


def test_a_cluster_needs_a_shared_folder():
    class Cluster:
        class conf:
            get = staticmethod(lambda *a: None)

        class sparkContext:
            master = "spark://host:7077"

    with pytest.raises(ValueError):
        shared_dir(Cluster)
