"""End-to-end plans: building a refined graph, and communities with their interfaces."""

from __future__ import annotations

import time
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.vectors import Premetric
from ..operators.clusters import cluster_ranking, community_statistics, interface_edges, prune_clusters, reassign_pruned
from ..operators.community import label_propagation, leiden, louvain
from ..operators.graph import ProximityGraph
from ..operators.knn import distance_stats, knn, refill_euclidean, reweight, scale_factor, symmetric_edges
from ..operators.layout import reduce_vectors
from ..operators.mst import flag_forest, minimum_forest
from ..operators.refine import refine
from ..operators.sparsify import coarsen, post_sparsify, project_back, top_per_source, with_similarity
from ..session import materialize
from ..sources.store import save_run


class Timings:
    """Wall-clock seconds of named steps."""

    def __init__(self):
        self.rows: list[tuple[str, float]] = []

    def __call__(self, name: str):
        timings = self

        class Step:
            def __enter__(self):
                self.t = time.perf_counter()

            def __exit__(self, *_):
                timings.rows.append((name, time.perf_counter() - self.t))

        return Step()

    def summary(self, spark) -> DataFrame:
        """Count, total, mean, least and most seconds of each step."""
        df = spark.createDataFrame(self.rows, "step string, s double")
        return df.groupBy("step").agg(F.count("s").alias("n"), F.sum("s").alias("total"), F.avg("s").alias("mean"), F.min("s").alias("min"), F.max("s").alias("max"))


@dataclass
class Built:
    """A refined graph, its history and statistics."""

    graph: ProximityGraph
    history: DataFrame
    forest: DataFrame
    stats: DataFrame
    scale: DataFrame
    reduction: dict
    timings: Timings = field(default_factory=Timings)


def build_graph(
    nodes: DataFrame,
    *,
    embedding: str = "embedding",
    features: str | None = None,
    k: int = 10,
    distance: str | Premetric = "euclidean",
    reduction: str = "none",
    n_components: int | None = None,
    variance: float | None = None,
    knn_method: str = "auto",
    weights_from: str = "reduced",
    use_euclidean: bool = False,
    missing_weight: float = float("inf"),
    self_weight: float = 0.0,
    iterations: int = 3,
    threshold: float | None = None,
    max_new_edges: int | str | None = None,
    smooth_first: bool = False,
    use_median: bool = True,
    preserve_mst: bool = True,
    max_components: int | None = None,
) -> Built:
    """Nodes ``(id, embedding, ...)`` to a refined graph: neighbours, premetric weights, forest, prune and polish.

    Neighbours are found in the (reduced) embedding, and their Euclidean distances are those of it, or with
    ``weights_from="original"`` of the whole embedding. Weights are the premetric of ``features`` (by default
    the embedding too). Everything up to the weighted edges is one lazy plan.
    """
    if weights_from not in ("reduced", "original"):
        raise ValueError(f"unknown weights_from {weights_from!r}")
    t = Timings()
    vec = nodes.select("id", F.col(embedding).cast("array<double>").alias("v"))
    feats = nodes.select("id", F.col(features or embedding).cast("array<double>").alias("features"))
    with t("reduce"):
        small, info = reduce_vectors(vec, reduction, n_components=n_components, variance=variance)
    with t("neighbours"):
        near = symmetric_edges(knn(small, k, method=knn_method))
        if weights_from == "original" and reduction != "none":
            near = refill_euclidean(near, vec)
        edges = materialize(reweight(near, feats, distance, missing=missing_weight, use_euclidean=use_euclidean), "weighted")
    with t("forest"):
        forest = materialize(minimum_forest(edges), "forest")
    with t("refine"):
        refined, history = refine(
            edges, feats, distance, iterations=iterations, threshold=threshold, max_new_edges=max_new_edges, smooth_first=smooth_first,
            use_median=use_median, preserve_mst=preserve_mst, forest=forest, max_components=max_components,
        )
    euclid = edges.select("src", "dst", "euclid_dist")
    final = flag_forest(refined.join(euclid, ["src", "dst"], "left"))
    graph = ProximityGraph(nodes.withColumn("features", F.col(features or embedding).cast("array<double>")), materialize(final, "graph"), None, distance, self_weight, missing_weight)
    return Built(graph, history, forest, distance_stats(refined), scale_factor(edges), info, t)


@dataclass
class CommunityRun:
    """Everything one resolution yields."""

    run_id: str
    resolution: float
    labels: DataFrame
    stats: DataFrame
    interface: DataFrame


def communities(
    edges: DataFrame,
    nodes: DataFrame,
    resolutions: list[float],
    *,
    algorithm: str = "leiden",
    similarity_scale: float | str | None = "adaptive",
    similarity: Callable[[Column], Column] | None = None,
    pre_k: int | None = 80,
    post_k: int | None = 68,
    coarsen_levels: int = 0,
    min_cluster_size: int | None = None,
    rank_col: str | None = None,
    run_name: str = "run",
    warm_start: bool = True,
    output: str | None = None,
) -> list[CommunityRun]:
    """Communities of ``edges(src, dst, distance)`` at each resolution, with statistics and interface edges.

    ``similarity`` makes one of a distance in place of the Gaussian of ``similarity_scale``.
    With ``warm_start`` each resolution, in ascending order, starts from the communities of the one before.
    """
    if algorithm not in ("louvain", "leiden", "labelprop"):
        raise ValueError(f"unknown algorithm {algorithm!r}")
    sim = with_similarity(edges.select("src", "dst", "distance"), similarity_scale, fn=similarity)
    if pre_k is not None:
        sim = top_per_source(sim, pre_k)
    sim = materialize(sim, "similarity")
    work, ids, back = sim, nodes.select("id"), None
    if coarsen_levels:
        c = coarsen(sim, nodes, levels=coarsen_levels, k=post_k)
        work = materialize(post_sparsify(c, post_k, similarity_scale, similarity) if post_k else c.edges, "coarse")
        back, ids = c.membership, c.membership.select(F.col("meta_id").alias("id")).distinct()
    out, before = [], None
    for r in sorted(resolutions):
        if algorithm == "labelprop":
            found = label_propagation(work, ids)
        else:
            found = (leiden if algorithm == "leiden" else louvain)(work, ids, resolution=r, initial=before if warm_start else None)
        before = found = materialize(found, "found")
        if back is not None:
            found = project_back(found.withColumnRenamed("id", "meta_id"), back)
        labels = materialize(found, "labels")
        ranked = cluster_ranking(nodes.join(labels.withColumnRenamed("label", "cluster"), "id"), rank_col)
        pruned = materialize(prune_clusters(ranked, min_cluster_size), "clusters")
        final = materialize(reassign_pruned(sim, labels, pruned), "labels")
        stats = pruned.join(community_statistics(sim, labels).drop("size"), "cluster_id")
        inter = interface_edges(sim.select("src", "dst", "distance", F.col("weight").alias("similarity")), labels, pruned)
        run_id = f"{run_name}_res{r}"
        if output is not None:
            save_run(output, run_name, r, inter, stats, final)
        out.append(CommunityRun(run_id, r, final, stats, inter))
    return out
