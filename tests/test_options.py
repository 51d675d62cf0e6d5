"""Options of the plans, and readers of array files."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from proxweave.operators.mst import spans
from proxweave.plans.build import build_graph, communities
from proxweave.sources.store import read_layout


def test_layout_of_an_array_file(spark, tmp_path):
    m = np.arange(20.0).reshape(10, 2)
    np.save(tmp_path / "y.npy", m)
    got = sorted((r["id"], r["y"]) for r in read_layout(spark, f"{tmp_path}/y.npy").collect())
    assert got == [(i, m[i].tolist()) for i in range(10)]
    with pytest.raises(ValueError):
        read_layout(spark, f"{tmp_path}/y.txt")


def test_weights_from_the_original_embedding(spark):
    rng = np.random.default_rng(0)
    x = rng.normal(size=(60, 6))
    nodes = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, embedding array<double>")
    options = {"k": 4, "reduction": "pca", "n_components": 2, "iterations": 1, "use_euclidean": True}
    whole = build_graph(nodes, weights_from="original", **options).graph.edges.collect()
    assert all(r["weight"] == pytest.approx(np.linalg.norm(x[r["src"]] - x[r["dst"]])) for r in whole)
    small = build_graph(nodes, **options).graph.edges.collect()
    assert any(r["weight"] < np.linalg.norm(x[r["src"]] - x[r["dst"]]) - 1e-6 for r in small)
    with pytest.raises(ValueError):
        build_graph(nodes, weights_from="elsewhere")


def test_similarity_of_the_user(spark):
    edges = spark.createDataFrame([(0, 1, 1.0), (1, 2, 3.0), (3, 4, 1.0)], "src long, dst long, distance double")
    run = communities(edges, spark.range(5), [1.0], similarity=lambda d: F.exp(-d), pre_k=None, post_k=None)[0]
    found = run.interface.collect()
    assert found and all(r["similarity"] == pytest.approx(np.exp(-r["distance"])) for r in found)


def test_span_check(spark):
    edges = spark.createDataFrame([(0, 1, 1.0), (1, 2, 1.0), (0, 2, 1.0), (3, 4, 1.0)], "src long, dst long, weight double")
    nodes = spark.range(6)
    good = edges.where("not (src = 0 and dst = 2)")
    assert spans(good, edges, nodes).first().asDict() == {"forest_edges": 3, "forest_components": 3, "graph_components": 3, "spans": True}
    assert not spans(edges, edges, nodes).first()["spans"]
    assert not spans(good.where("src != 3"), edges, nodes).first()["spans"]


def test_median_counts_a_frequent_value_once(spark):
    from proxweave.operators.refine import median_of

    rng = np.random.default_rng(5)
    for values in ([3.0], [1.0, 2.0], [7.0] * 50 + [1.0, 9.0], rng.integers(0, 4, 101).astype(float).tolist(), rng.normal(size=40).tolist()):
        df = spark.createDataFrame([(v,) for v in [*values, None]], "y double")
        assert median_of(df, "y").first()["median"] == pytest.approx(np.median(values))
    assert median_of(spark.createDataFrame([], "y double"), "y").first()["median"] is None
