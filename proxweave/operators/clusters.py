"""Cluster ranking and pruning, interface edges, statistics, and comparison of runs."""

from __future__ import annotations

import math
from functools import reduce
from itertools import combinations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.vectors import yeo_johnson
from ..session import materialize
from .components import number_rows
from .graph import both_ways
from .refine import knee_point


def fit_yeo_johnson(df: DataFrame, col: str, lo: float = -2.0, hi: float = 4.0, points: int = 13, rounds: int = 3) -> tuple[float, float, float]:
    """Lambda of the greatest likelihood, and mean and deviation after the transform.

    Each round evaluates a grid of lambdas in one aggregation and narrows it around the best.
    """
    x = F.col(col).cast("double")
    lam = 1.0
    for _ in range(rounds):
        grid = [lo + (hi - lo) * i / (points - 1) for i in range(points)]
        row = df.agg(F.sum(F.signum(x) * F.log1p(F.abs(x))).alias("j"), F.count(x).alias("n"), *[F.var_pop(yeo_johnson(x, g)).alias(f"v{i}") for i, g in enumerate(grid)]).first()
        score = [(-row["n"] / 2 * math.log(max(row[f"v{i}"] or 0.0, 1e-300)) + (g - 1) * (row["j"] or 0.0), g) for i, g in enumerate(grid)]
        lam = max(score)[1]
        step = (hi - lo) / (points - 1)
        lo, hi = lam - step, lam + step
    m = df.agg(F.avg(yeo_johnson(x, lam)).alias("m"), F.stddev_pop(yeo_johnson(x, lam)).alias("s")).first()
    return lam, m["m"] or 0.0, m["s"] or 0.0


def cluster_ranking(nodes: DataFrame, rank_col: str | None = None, normalize: bool = False) -> DataFrame:
    """``(cluster_id, size, rank_stat_mean, ranking_stat, rank)`` of ``nodes(id, cluster, ...)``.

    The ranking statistic is the mean of ``rank_col`` times the root of the size, or the size alone.
    """
    stat = F.col(rank_col).cast("double") if rank_col else None
    if rank_col and normalize:
        lam, mean, sd = fit_yeo_johnson(nodes, rank_col)
        if sd > 0:
            stat = (yeo_johnson(stat, lam) - mean) / sd
    mean = F.avg(stat) if rank_col else F.lit(None).cast("double")
    g = nodes.groupBy(F.col("cluster").alias("cluster_id")).agg(F.count(F.lit(1)).alias("size"), mean.alias("rank_stat_mean"))
    g = g.withColumn("ranking_stat", F.col("rank_stat_mean") * F.sqrt("size") if rank_col else F.col("size").cast("double"))
    return number_rows(g, [F.desc("ranking_stat"), F.col("cluster_id")], "rank").withColumn("rank", (F.col("rank") + 1).cast("int"))


def prune_clusters(stats: DataFrame, min_size: int | None = None) -> DataFrame:
    """``stats(cluster_id, size, ...)`` with ``pruned``: smaller than ``min_size``, or past the knee of sizes."""
    if min_size is not None:
        return stats.withColumn("pruned", F.col("size") < min_size)
    ranked = materialize(number_rows(stats, [F.desc("size"), F.col("cluster_id")], "__x"), "sizes")
    knee = F.broadcast(knee_point(ranked.select(F.col("__x").alias("x"), F.col("size").alias("y")), use_median=False).select("knee"))
    return ranked.crossJoin(knee).withColumn("pruned", F.col("__x") > F.col("knee")).drop("__x", "knee")


def reassign_pruned(edges: DataFrame, labels: DataFrame, pruned: DataFrame, passes: int = 3) -> DataFrame:
    """``(id, label)``: nodes of pruned clusters take the majority label around them; ties to the least label.

    All nodes of a pass see the labels before it. What is left after the passes takes the least kept label.
    """
    gone = pruned.where("pruned").select(F.col("cluster_id").alias("label"), F.lit(True).alias("__g"))
    cur = labels.join(gone, "label", "left").select("id", F.when(F.col("__g").isNull(), F.col("label")).alias("label"))
    arms = both_ways(edges.select("src", "dst"))
    for _ in range(passes):
        cur = materialize(cur, "labels")
        known = cur.where("label is not null").select(F.col("id").alias("dst"), "label")
        todo = cur.where("label is null").select(F.col("id").alias("src"))
        votes = arms.join(todo, "src").join(known, "dst").groupBy("src", "label").agg(F.count(F.lit(1)).alias("n"))
        best = votes.groupBy(F.col("src").alias("id")).agg(F.max_by("label", F.struct("n", -F.col("label"))).alias("__new"))
        cur = cur.join(best, "id", "left").select("id", F.coalesce("label", "__new").alias("label"))
    first = F.broadcast(pruned.where("not pruned").agg(F.coalesce(F.min("cluster_id"), F.lit(0)).alias("__first")))
    return cur.crossJoin(first).select("id", F.coalesce("label", "__first").alias("label"))


def with_clusters(edges: DataFrame, labels: DataFrame) -> DataFrame:
    """``edges`` with ``source_cluster`` and ``target_cluster``: two equi-joins with ``labels(id, label)``."""
    a = labels.select(F.col("id").alias("src"), F.col("label").alias("source_cluster"))
    b = labels.select(F.col("id").alias("dst"), F.col("label").alias("target_cluster"))
    return edges.join(a, "src").join(b, "dst").select(*edges.columns, "source_cluster", "target_cluster")


def interface_edges(edges: DataFrame, labels: DataFrame, pruned: DataFrame | None = None) -> DataFrame:
    """Edges between clusters (``cross_community``), and those inside one that touch a pruned one (``pruned_community``)."""
    e = with_clusters(edges, labels)
    cross = F.col("source_cluster") != F.col("target_cluster")
    if pruned is None:
        return e.where(cross).withColumn("edge_type", F.lit("cross_community"))
    gone = pruned.where("pruned").select(F.col("cluster_id").alias("target_cluster"), F.lit(True).alias("__g"))
    kind = F.when(cross, "cross_community").when(F.col("__g"), "pruned_community")
    return e.join(gone, "target_cluster", "left").select(*e.columns, kind.alias("edge_type")).where("edge_type is not null")


def community_statistics(edges: DataFrame, labels: DataFrame, *, double_count: bool = False) -> DataFrame:
    """Volume, cut, conductance, edge counts and inner distances of every cluster.

    ``edges`` has ``weight`` and ``distance``. ``double_count`` counts each edge in both directions.
    """
    e = with_clusters(edges.select("src", "dst", "weight", "distance"), labels)
    inner = F.col("source_cluster") == F.col("target_cluster")
    ends = F.explode(F.array(F.struct(F.col("source_cluster").alias("c"), F.lit(1).alias("first")), F.struct(F.col("target_cluster").alias("c"), F.lit(0).alias("first"))))
    side = e.select(ends.alias("s"), inner.alias("inner"), "weight", "distance").select("s.c", "s.first", "inner", "weight", "distance")
    one = F.col("inner") & (F.col("first") == 1)
    times = 2 if double_count else 1
    g = side.groupBy(F.col("c").alias("cluster_id")).agg(
        F.sum("weight").alias("vol"),
        F.sum(F.when(~F.col("inner"), F.col("weight")).otherwise(0.0)).alias("cut"),
        (times * F.count(F.when(one, 1))).alias("internal_edges"),
        F.count(F.when(~F.col("inner"), 1)).alias("external_edges"),
        F.avg(F.when(one, F.col("distance"))).alias("mean_edge_dist"),
        F.stddev_samp(F.when(one, F.col("distance"))).alias("std_edge_dist"),
    )
    sizes = labels.groupBy(F.col("label").alias("cluster_id")).agg(F.count(F.lit(1)).alias("size"))
    out = sizes.join(g, "cluster_id", "left").na.fill(0)
    pairs = F.col("size") * (F.col("size") - 1) / 2
    return out.select(
        "cluster_id",
        "size",
        F.when(F.col("vol") > 0, F.col("cut") / F.col("vol")).otherwise(0.0).alias("conductance"),
        "internal_edges",
        "external_edges",
        "mean_edge_dist",
        "std_edge_dist",
        F.when(pairs > 0, F.col("internal_edges") / pairs).otherwise(0.0).alias("edge_density"),
        (F.col("internal_edges") / F.col("size")).alias("edge_to_node_ratio"),
        F.when(F.col("mean_edge_dist") > 0, F.col("std_edge_dist") / F.col("mean_edge_dist")).otherwise(0.0).alias("coef_var"),
    )


def normalized_mutual_information(a: DataFrame, b: DataFrame) -> DataFrame:
    """One row ``(nmi)`` of two labelings ``(id, label)``, by the mean of both entropies; 1 if both are constant."""
    both = a.select("id", F.col("label").alias("x")).join(b.select("id", F.col("label").alias("y")), "id")
    table = both.groupBy("x", "y").agg(F.count(F.lit(1)).alias("n"))
    total = F.broadcast(table.agg(F.sum("n").alias("t")))
    ent = lambda c: table.groupBy(c).agg(F.sum("n").alias("n")).crossJoin(total).agg(F.sum(-(F.col("n") / F.col("t")) * F.log(F.col("n") / F.col("t"))).alias(f"h_{c}"))
    joint = table.crossJoin(total).agg(F.sum(-(F.col("n") / F.col("t")) * F.log(F.col("n") / F.col("t"))).alias("h_xy"))
    h = joint.crossJoin(ent("x")).crossJoin(ent("y"))  # one row each
    mean = (F.col("h_x") + F.col("h_y")) / 2
    return h.select(F.when(mean <= 0, F.lit(1.0)).otherwise((F.col("h_x") + F.col("h_y") - F.col("h_xy")) / mean).alias("nmi"))


def overlap_counts(a: DataFrame, b: DataFrame) -> DataFrame:
    """One row: edges of both, of either alone, and totals, of two tables with ``(src, dst)``."""
    pair = lambda d, c: d.select("src", "dst").distinct().withColumn(c, F.lit(1))
    j = pair(a, "x").join(pair(b, "y"), ["src", "dst"], "full")
    return j.agg(
        F.count(F.when(F.col("x").isNotNull() & F.col("y").isNotNull(), 1)).alias("common_edges"),
        F.count(F.when(F.col("y").isNull(), 1)).alias("only_in_run1"),
        F.count(F.when(F.col("x").isNull(), 1)).alias("only_in_run2"),
        F.count("x").alias("total_edges1"),
        F.count("y").alias("total_edges2"),
    )


def compare_runs(labels1: DataFrame, labels2: DataFrame, edges1: DataFrame, edges2: DataFrame) -> DataFrame:
    """One row: NMI of the labels, Jaccard similarity and counts of the interface edges."""
    c = overlap_counts(edges1, edges2)
    union = F.col("common_edges") + F.col("only_in_run1") + F.col("only_in_run2")
    jaccard = F.when(union > 0, F.col("common_edges") / union).otherwise(0.0)
    return normalized_mutual_information(labels1, labels2).crossJoin(c).select("nmi", jaccard.alias("jaccard_similarity"), *c.columns)  # one row each


def combined_edges(runs: dict[str, DataFrame]) -> DataFrame:
    """Union of the runs' interface edges: distance, and by run ``in_<run>`` and ``type_<run>``; ``run_count``."""
    names = list(runs)
    rows = reduce(DataFrame.unionByName, [d.select("src", "dst", "distance", "edge_type", F.lit(r).alias("run")) for r, d in runs.items()])
    per = []
    for r in names:
        mine = F.col("run") == r
        per += [F.max(mine).alias(f"in_{r}"), F.coalesce(F.max(F.when(mine, F.col("edge_type"))), F.lit("not_interface")).alias(f"type_{r}")]
    return rows.groupBy("src", "dst").agg(F.min("distance").alias("distance"), *per, F.count_distinct("run").alias("run_count"))


def merge_interface(runs: dict[str, DataFrame], min_overlap: int = 2) -> DataFrame:
    """``(src, dst, overlap, runs)`` of edges that at least ``min_overlap`` runs have."""
    rows = reduce(DataFrame.unionByName, [d.select("src", "dst", F.lit(r).alias("run")) for r, d in runs.items()])
    g = rows.groupBy("src", "dst").agg(F.count_distinct("run").alias("overlap"), F.array_join(F.array_sort(F.collect_set("run")), ",").alias("runs"))
    return g.where(F.col("overlap") >= min_overlap)


def overlap_distribution(merged: DataFrame) -> DataFrame:
    """``(overlap, edges)``."""
    return merged.groupBy("overlap").agg(F.count(F.lit(1)).alias("edges"))


def compare_resolutions(runs: list[tuple[str, float, DataFrame]], metric: str = "jaccard", every_pair: bool = False) -> DataFrame:
    """One row for each two runs next to each other by resolution, or for every two: edge counts, intersection, similarity."""
    if metric not in ("jaccard", "overlap"):
        raise ValueError(f"unknown metric {metric!r}")
    order = sorted(runs, key=lambda x: (x[1], x[0]))
    out = []
    for (n1, r1, a), (n2, r2, b) in combinations(order, 2) if every_pair else zip(order, order[1:]):
        c = overlap_counts(a, b)
        both, e1, e2 = F.col("common_edges"), F.col("total_edges1"), F.col("total_edges2")
        den = e1 + e2 - both if metric == "jaccard" else F.least(e1, e2)
        out.append(
            c.select(
                F.lit(n1).alias("run_id1"), F.lit(n2).alias("run_id2"), F.lit(float(r1)).alias("resolution1"), F.lit(float(r2)).alias("resolution2"),
                e1.alias("edges1"), e2.alias("edges2"), both.alias("intersection"), F.when(den > 0, both / den).otherwise(0.0).alias("similarity"),
            )
        )
    if not out:
        raise ValueError("two runs or more are needed")
    return reduce(DataFrame.unionByName, out)


def edges_per_node(edges: DataFrame) -> DataFrame:
    """``(n_edges, n_nodes)``: histogram of interface edges by node."""
    per = edges.select(F.explode(F.array("src", "dst")).alias("id")).groupBy("id").agg(F.count(F.lit(1)).alias("n_edges"))
    return per.groupBy("n_edges").agg(F.count(F.lit(1)).alias("n_nodes"))


def pairwise_matrix(runs: dict[str, DataFrame], kind: str) -> DataFrame:
    """``(run1, run2, value)`` for all ordered pairs of a few runs: ``jaccard`` of edges or ``nmi`` of labels."""
    if kind not in ("jaccard", "nmi"):
        raise ValueError(f"unknown kind {kind!r}")
    out = []
    for a in runs:
        for b in runs:
            if kind == "nmi":
                v = normalized_mutual_information(runs[a], runs[b]).select(F.col("nmi").alias("value"))
            else:
                c = overlap_counts(runs[a], runs[b])
                u = F.col("common_edges") + F.col("only_in_run1") + F.col("only_in_run2")
                v = c.select(F.when(u > 0, F.col("common_edges") / u).otherwise(0.0).alias("value"))
            out.append(v.select(F.lit(a).alias("run1"), F.lit(b).alias("run2"), "value"))
    return reduce(DataFrame.unionByName, out)
