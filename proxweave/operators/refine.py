"""Knee, pruning, two-hop polishing, and the refinement loop."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.vectors import Premetric
from ..session import materialize
from .components import number_rows, star_components
from .graph import both_ways
from .knn import distance_stats, pairwise, valid_distance
from .mst import minimum_forest


def median_of(df: DataFrame, col: str) -> DataFrame:
    """One row ``(median)``, exact, from global ranks of the distinct values, each with its count: a frequent value is one row."""
    counted = df.select(F.col(col).alias("y")).where("y is not null").groupBy("y").agg(F.count(F.lit(1)).alias("n"))
    ranked = number_rows(counted, [F.col("y")], "r", "n")
    total = F.broadcast(ranked.agg(F.sum("n").alias("t")))
    at = lambda place: F.sum(F.when(F.expr(f"{place} >= r and {place} < r + n"), F.col("y")))
    return ranked.crossJoin(total).agg(((at("floor((t - 1) / 2)") + at("floor(t / 2)")) / 2).alias("median"))  # one row


def knee_point(curve: DataFrame, use_median: bool = True) -> DataFrame:
    """One row ``(knee, y)``: the place of the point farthest below the chord of ``curve(x, y)``.

    ``x`` are places 0, 1, ... of a curve sorted by descending ``y``. With ``use_median`` only points at
    or above the median count, if they are more than two. Two points or fewer: place 0. The earliest
    of equal distances wins. A sensitivity factor would scale all distances alike, so it can't matter.
    """
    c = materialize(curve.select(F.col("x").cast("long").alias("x"), F.col("y").cast("double").alias("y")), "curve")
    n = c.count()
    if n <= 2:
        return c.where("x = 0").select(F.col("x").alias("knee"), "y")
    part = c
    if use_median:
        mid = c.where(f"x >= {(n - 1) // 2} and x <= {n // 2}").agg(F.avg("y").alias("m")).first()["m"]
        above = c.where(F.col("y") >= mid)
        part = above if above.count() > 2 else c
    s = part.agg(
        F.min("x").alias("x0"), F.max("x").alias("x1"), F.min("y").alias("y0"), F.max("y").alias("y1"),
        F.min_by("y", "x").alias("first"), F.max_by("y", "x").alias("last"),
    )
    unit = lambda v, lo, hi: F.when(F.col(hi) > F.col(lo), (F.col(v) - F.col(lo)) / (F.col(hi) - F.col(lo))).otherwise(0.0)
    scaled = part.crossJoin(F.broadcast(s)).select("x", "y", unit("x", "x0", "x1").alias("u"), unit("y", "y0", "y1").alias("v"), unit("first", "y0", "y1").alias("f"), unit("last", "y0", "y1").alias("l"))
    below = (F.col("l") - F.col("f")) * F.col("u") + F.col("f") - F.col("v")
    return scaled.agg(F.max_by(F.struct("x", "y"), F.struct(below, -F.col("x"))).alias("p")).select(F.col("p.x").alias("knee"), F.col("p.y").alias("y"))


def ranked_edges(edges: DataFrame) -> DataFrame:
    """``edges`` with ``x``: 0 for the longest; ties by (src, dst)."""
    return number_rows(edges, [F.col("weight").desc(), F.col("src"), F.col("dst")], "x")


@dataclass
class Pruned:
    """What pruning left, what it took away (forest edges put back included), and the threshold."""

    edges: DataFrame
    pruned: DataFrame
    threshold: float | None
    restored: int = 0


def _count_components(nodes: DataFrame, edges: DataFrame) -> int:
    joined = star_components(edges)
    inside = joined.agg(F.count(F.lit(1)).alias("n"), F.count_distinct("component").alias("c")).first()
    return nodes.count() - inside["n"] + inside["c"]


def prune(
    edges: DataFrame,
    threshold: float | None = None,
    *,
    use_median: bool = True,
    preserve_mst: bool = True,
    forest: DataFrame | None = None,
    max_components: int | None = None,
    nodes: DataFrame | None = None,
) -> Pruned:
    """Drop long edges: those over ``threshold``, or those up to and including the knee of the sorted lengths.

    An infinite threshold, or one not below the longest edge, changes nothing; fewer than two edges
    have no knee. The forest is put back unless ``preserve_mst`` is off; then ``max_components`` keeps
    the longest removals out that would exceed it.
    """
    e = edges.select("src", "dst", "weight")
    if threshold is not None:
        gone = e.where(F.col("weight") > threshold)
        keep = e.where(F.col("weight") <= threshold)
    else:
        ranked = materialize(ranked_edges(e), "ranked-edges")
        knee = knee_point(ranked.select("x", F.col("weight").alias("y")), use_median).first()
        if knee is None or ranked.count() < 2:
            return Pruned(e, e.limit(0), None)
        threshold = knee["y"]
        gone = ranked.where(F.col("x") <= knee["knee"]).select("src", "dst", "weight")
        keep = ranked.where(F.col("x") > knee["knee"]).select("src", "dst", "weight")
    restored = 0
    if preserve_mst:
        tree = forest if forest is not None else minimum_forest(e)
        back = materialize(tree.select("src", "dst").join(keep, ["src", "dst"], "left_anti").join(e, ["src", "dst"]).select("src", "dst", "weight"), "restored")
        restored = back.count()
        keep = keep.unionByName(back)
    elif max_components is not None:
        order = materialize(ranked_edges(gone), "removed")
        lo, hi = 0, order.count()  # remove the first lo only
        universe = nodes if nodes is not None else both_ways(e).select(F.col("src").alias("id")).distinct()
        while lo < hi:
            mid = (lo + hi + 1) // 2
            trial = keep.unionByName(order.where(F.col("x") >= mid).select("src", "dst", "weight"))
            lo, hi = (mid, hi) if _count_components(universe, trial) <= max_components else (lo, mid - 1)
        keep = keep.unionByName(order.where(F.col("x") >= lo).select("src", "dst", "weight"))
        gone = order.where(F.col("x") < lo).select("src", "dst", "weight")
    return Pruned(keep, gone, threshold, restored)


def _two_hop_bits(edges: DataFrame, ids: np.ndarray) -> DataFrame:
    """:func:`two_hop` by rows of bits, one a node: a pair is made once, however many neighbours it shares."""
    spark, n = edges.sparkSession, len(ids)
    shared = spark.sparkContext.broadcast(ids)

    def pack(table):
        row = np.zeros(n, bool)
        row[np.searchsorted(shared.value, table.column("dst").to_numpy())] = True
        return pa.table({"src": table.column("src")[:1], "bits": pa.array([np.packbits(row).tobytes()], pa.binary())})

    rows = both_ways(edges.select("src", "dst")).groupBy("src").applyInArrow(pack, "src long, bits binary").toArrow()  # n * n / 8 bytes
    bits = np.zeros((n, -(-n // 8)), np.uint8)
    for i, b in zip(np.searchsorted(ids, rows.column("src").to_numpy()), rows.column("bits")):
        bits[i] = np.frombuffer(b.as_buffer(), np.uint8)
    matrix = spark.sparkContext.broadcast(bits)

    def run(batches):
        m, names = matrix.value, shared.value
        for b in batches:
            for i in b.column(0).to_pylist():
                near = np.flatnonzero(np.unpackbits(m[i], count=n))
                reach = np.zeros(m.shape[1], np.uint8)
                for p in range(0, len(near), 1024):
                    reach |= np.bitwise_or.reduce(m[near[p : p + 1024]], axis=0)
                other = np.flatnonzero(np.unpackbits(reach & ~m[i], count=n))
                other = other[other > i]
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(other), names[i])), pa.array(names[other])], names=["src", "dst"])

    return spark.range(0, n, 1, 192).mapInArrow(run, "src long, dst long")


def two_hop(edges: DataFrame, max_degree: int | None = None, *, local_nodes: int = 20_000, wedges: int = 20_000_000) -> DataFrame:
    """``(src, dst)``: pairs with a common neighbour and no edge of their own.

    Rows grow with the sum of squared degrees. AQE splits a hub's rows; ``max_degree`` leaves out
    middle nodes of a larger degree, which changes the result, and is off by default. Where that sum is over
    ``wedges`` and there are ``local_nodes`` nodes at most, pairs come from rows of bits (50 MB at most).
    """
    arms = both_ways(edges.select("src", "dst"))
    if max_degree is None:
        degree = arms.where("src != dst").groupBy("src").agg(F.count(F.lit(1)).alias("n"))
        size = degree.agg(F.count(F.lit(1)).alias("nodes"), F.sum(F.col("n").cast("double") * F.col("n")).alias("w")).first()
        if size["nodes"] <= local_nodes and (size["w"] or 0) > wedges:
            return _two_hop_bits(edges.where("src != dst"), np.sort(degree.select("src").toArrow().column("src").to_numpy()))
    if max_degree is not None:
        hubs = arms.groupBy("src").count().where(F.col("count") > max_degree)
        arms = arms.join(hubs, "src", "left_anti")
    a = arms.select(F.col("src").alias("m"), F.col("dst").alias("p"))
    b = arms.select(F.col("src").alias("m"), F.col("dst").alias("q"))
    pairs = a.join(b, "m").where("p < q").select(F.col("p").alias("src"), F.col("q").alias("dst")).distinct()
    return pairs.join(edges.select("src", "dst"), ["src", "dst"], "left_anti")


def sample_pairs(pairs: DataFrame, n: int, seed: int = 42) -> DataFrame:
    """``n`` pairs in the order of a hash of the pair."""
    return pairs.orderBy(F.xxhash64(F.lit(seed), "src", "dst"), "src", "dst").limit(n)


@dataclass
class Polished:
    edges: DataFrame
    added: DataFrame
    removed: int


def polish(
    edges: DataFrame, features: DataFrame, fn: str | Premetric = "euclidean", *, max_new_edges: int | str | None = "all", missing: float = float("inf"), seed: int = 42
) -> Polished:
    """Add two-hop pairs with their premetric; at most ``max_new_edges`` (``"all"``: no limit, None: nothing), chosen by hash."""
    if max_new_edges is None or max_new_edges == 0:
        return Polished(edges, edges.limit(0), 0)
    pairs = two_hop(edges)
    if max_new_edges != "all":
        pairs = sample_pairs(pairs, int(max_new_edges), seed)
    weighted = materialize(pairwise(pairs, features, fn, "weight"), "polish")
    good = weighted.where(valid_distance(F.col("weight"), missing))
    added = good.select("src", "dst", "weight")
    return Polished(edges.select("src", "dst", "weight").unionByName(added), added, weighted.count() - added.count())


HISTORY = (
    "iteration int, smooth_first boolean, n_new_edges long, n_removed_smoothing long, prune_threshold double, "
    "n_pruned_edges long, n_edges long, edge_change_percent double"
)


def refine(
    edges: DataFrame,
    features: DataFrame,
    fn: str | Premetric = "euclidean",
    *,
    iterations: int = 3,
    threshold: float | None = None,
    max_new_edges: int | str | None = None,
    smooth_first: bool = False,
    use_median: bool = True,
    preserve_mst: bool = True,
    forest: DataFrame | None = None,
    max_components: int | None = None,
    discard_converged_iter: bool = True,
) -> tuple[DataFrame, DataFrame]:
    """``(edges, history)``: prune and polish by turns until the edge count changes by under one per cent.

    The round that finds that is dropped by default, though its row is in the history.
    """
    cur = materialize(edges.select("src", "dst", "weight"), "refine")
    n, rows = cur.count(), []
    if preserve_mst and forest is None:
        forest = minimum_forest(cur)
    opts = {"use_median": use_median, "preserve_mst": preserve_mst, "forest": forest, "max_components": max_components}
    for it in range(iterations):
        first = polish(cur, features, fn, max_new_edges=max_new_edges) if smooth_first else None
        cut = prune(first.edges if first else cur, threshold, **opts)
        smooth = first or polish(materialize(cut.edges, "pruned"), features, fn, max_new_edges=max_new_edges)
        nxt = materialize(cut.edges if smooth_first else smooth.edges, "refine")
        m = nxt.count()
        change = abs(m - n) / max(n, 1)
        rows.append((it, smooth_first, smooth.added.count(), smooth.removed, cut.threshold, cut.pruned.count(), m, change))
        if change < 0.01:
            if not discard_converged_iter:
                cur = nxt
            break
        cur, n = nxt, m
    return cur, edges.sparkSession.createDataFrame(rows, HISTORY)


__all__ = ["distance_stats", "knee_point", "median_of", "polish", "prune", "refine", "sample_pairs", "two_hop"]
