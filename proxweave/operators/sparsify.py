"""Similarities, sparsification, pair aggregation and coarsening."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.vectors import gaussian_similarity
from ..session import materialize
from .components import number_rows
from .graph import both_ways
from .refine import median_of


def with_similarity(
    edges: DataFrame, scale: float | str | None = "adaptive", col: str = "distance", fn: Callable[[Column], Column] | None = None
) -> DataFrame:
    """``edges`` with ``weight``: Gaussian similarity of ``col``, an adaptive scale being the median, or what ``fn`` makes of it."""
    if fn is not None:
        return edges.withColumn("weight", fn(F.col(col)).cast("double"))
    if scale in (None, "adaptive"):
        m = F.broadcast(median_of(edges, col))  # one row
        out = edges.crossJoin(m).withColumn("weight", gaussian_similarity(F.col(col), F.col("median")))
        return out.drop("median")
    return edges.withColumn("weight", gaussian_similarity(F.col(col), F.lit(float(scale))))


def top_per_source(edges: DataFrame, k: int) -> DataFrame:
    """The ``k`` heaviest edges of each source of a directed table; ties by target."""
    w = Window.partitionBy("src").orderBy(F.desc("weight"), "dst")
    return edges.withColumn("__r", F.row_number().over(w)).where(F.col("__r") <= k).drop("__r")


def merge_pairs(edges: DataFrame) -> DataFrame:
    """One row a pair: the largest weight, the least distance."""
    return edges.groupBy(F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst")).agg(
        F.max("weight").alias("weight"), F.min("distance").alias("distance")
    )


def sum_pairs(edges: DataFrame) -> DataFrame:
    """One row a pair: summed weight, least distance. Spark's partial aggregation is the chunking."""
    return edges.groupBy(F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst")).agg(
        F.sum("weight").alias("weight"), F.min("distance").alias("distance")
    )


def top_undirected(edges: DataFrame, k: int) -> DataFrame:
    """Edges that are among the ``k`` heaviest of either end; ties by the other end."""
    return merge_pairs(top_per_source(both_ways(edges.select("src", "dst", "weight", "distance")), k))


def threshold_edges(edges: DataFrame, *, min_weight: float | None = None, percentile: float | None = None) -> DataFrame:
    """Edges of at least a weight, or of at least the weight at a percentile (0 to 1) of all."""
    if (min_weight is None) == (percentile is None):
        raise ValueError("give either min_weight or percentile")
    if min_weight is not None:
        return edges.where(F.col("weight") >= min_weight)
    cut = F.broadcast(edges.agg(F.percentile_approx("weight", percentile, 10_000).alias("__cut")))
    return edges.crossJoin(cut).where(F.col("weight") >= F.col("__cut")).drop("__cut")


def symmetrize(edges: DataFrame, how: str = "max") -> DataFrame:
    """Directed to undirected by max, mean, sum, or ``or`` (presence: weight 1)."""
    agg = {"max": F.max("weight"), "mean": F.avg("weight"), "sum": F.sum("weight"), "or": F.max(F.lit(1.0))}.get(how)
    if agg is None:
        raise ValueError(f"unknown way to symmetrize: {how!r}")
    return edges.where("src != dst").groupBy(F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst")).agg(agg.alias("weight"))


def mutual_coarsening(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """``(id, meta_id)``: nodes that are each other's heaviest neighbour merge.

    Ties go to the least neighbour. Pairs are numbered first, by their least node, then the others.
    """
    arms = both_ways(edges.select("src", "dst", "weight"))
    best = arms.groupBy("src").agg(F.min_by("dst", F.struct((-F.col("weight")).alias("w"), "dst")).alias("best"))
    pairs = best.alias("x").join(best.alias("y"), (F.col("x.best") == F.col("y.src")) & (F.col("y.best") == F.col("x.src")))
    mate = pairs.select(F.col("x.src").alias("id"), F.least("x.src", "x.best").alias("lead"))
    lead = nodes.select("id").join(mate, "id", "left").select("id", F.col("lead").isNull().alias("single"), F.coalesce("lead", "id").alias("lead"))
    lead = materialize(lead, "leads")
    ids = number_rows(lead.select("single", "lead").distinct(), [F.col("single"), F.col("lead")], "meta_id")
    return lead.join(ids.select("lead", "single", "meta_id"), ["single", "lead"]).select("id", "meta_id")


def contract(edges: DataFrame, membership: DataFrame) -> DataFrame:
    """Edges between meta nodes: summed weight, least distance; those inside one go."""
    m = membership.select("id", "meta_id")
    a, b = m.select(F.col("id").alias("src"), F.col("meta_id").alias("ms")), m.select(F.col("id").alias("dst"), F.col("meta_id").alias("mt"))
    e = edges.join(a, "src").join(b, "dst").where("ms != mt")
    return sum_pairs(e.select(F.col("ms").alias("src"), F.col("mt").alias("dst"), "weight", "distance"))


@dataclass
class Coarse:
    """Final edges, the map from every node to its meta node, and one row a level."""

    edges: DataFrame
    membership: DataFrame
    levels: list[dict]


def coarsen(
    edges: DataFrame, nodes: DataFrame, *, levels: int = 2, k: int | None = None, k_ratio: float = 0.9, min_nodes: int = 1000, max_ratio: float = 0.95
) -> Coarse:
    """Repeat mutual merging and contraction, with a smaller top-k each level.

    A level that shrinks to under ``min_nodes``, shrinks by less than ``max_ratio`` asks, or leaves no
    edge is still applied, and is the last.
    """
    cur, ids = edges.select("src", "dst", "weight", "distance"), nodes.select("id")
    whole = ids.select("id", F.col("id").alias("meta_id"))
    info: list[dict] = []
    k_now = k
    for level in range(1, levels + 1):
        step = materialize(mutual_coarsening(cur, ids), "membership")
        before, after = ids.count(), step.agg(F.count_distinct("meta_id")).first()[0]
        nxt = contract(cur, step)
        if k_now is not None:
            k_now = max(1, round(k_now * k_ratio))
            nxt = top_undirected(nxt, k_now)
        cur = materialize(nxt, "coarse-edges")
        whole = materialize(
            whole.withColumnRenamed("meta_id", "mid").join(step.select(F.col("id").alias("mid"), "meta_id"), "mid").select("id", "meta_id"), "membership"
        )
        ids = step.select(F.col("meta_id").alias("id")).distinct()
        n_edges = cur.count()
        info.append({"level": level, "n_nodes": before, "n_meta": after, "ratio": after / max(before, 1), "n_edges": n_edges, "k": k_now})
        if after < min_nodes or after / max(before, 1) > max_ratio or not n_edges:
            break
    return Coarse(cur, whole, info)


def post_sparsify(coarse: Coarse, k: int, scale: float | str | None = "adaptive", fn: Callable[[Column], Column] | None = None) -> DataFrame:
    """Similarity recomputed from distance, then the top ``k`` by how far the graph has shrunk."""
    ratio = coarse.levels[-1]["n_meta"] / max(coarse.levels[0]["n_nodes"], 1) if coarse.levels else 1.0
    return top_undirected(with_similarity(coarse.edges.drop("weight"), scale, fn=fn), max(1, int(k * ratio)))


def project_mode(labels: DataFrame, membership: DataFrame) -> DataFrame:
    """``(meta_id, label)``: the most frequent label of each meta node; ties by the least label."""
    counts = labels.join(membership, "id").groupBy("meta_id", "label").agg(F.count(F.lit(1)).alias("n"))
    return counts.groupBy("meta_id").agg(F.max_by("label", F.struct("n", -F.col("label"))).alias("label"))


def project_back(coarse_labels: DataFrame, membership: DataFrame) -> DataFrame:
    """``(id, label)`` of every node from ``(meta_id, label)``."""
    return membership.join(coarse_labels, "meta_id").select("id", "label")


def row_stochastic(edges: DataFrame, mode: str = "exp") -> DataFrame:
    """Directed ``(src, dst, p)``: exp(-d / (row median + 1e-9)) or 1 / (d + 1e-9), rows scaled to sum 1."""
    arms = both_ways(edges.select("src", "dst", F.col("weight").alias("d")))
    row = Window.partitionBy("src")
    if mode == "exp":
        s = arms.withColumn("s", F.exp(-F.col("d") / (F.median("d").over(row) + 1e-9)))
    elif mode == "recip":
        s = arms.withColumn("s", 1 / (F.col("d") + 1e-9))
    else:
        raise ValueError(f"unknown mode {mode!r}")
    return s.select("src", "dst", (F.col("s") / F.sum("s").over(row)).alias("p"))


def top_stochastic(p: DataFrame, k: int) -> DataFrame:
    """The ``k`` largest entries of each row, scaled to sum 1; ties by target."""
    w = Window.partitionBy("src").orderBy(F.desc("p"), "dst")
    top = p.withColumn("__r", F.row_number().over(w)).where(F.col("__r") <= k)
    return top.select("src", "dst", (F.col("p") / F.sum("p").over(Window.partitionBy("src"))).alias("p"))


def nearest_per_node(edges: DataFrame, k: int) -> DataFrame:
    """Directed ``(src, dst, weight, rank)``: the ``k`` shortest edges of each node; ties by the other end."""
    w = Window.partitionBy("src").orderBy("weight", "dst")
    return both_ways(edges.select("src", "dst", "weight")).withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
