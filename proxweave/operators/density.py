"""Local density on a graph, and its smoothing."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import materialize
from .graph import both_ways, degrees
from .sparsify import nearest_per_node

FAR = 1e6  # distance of nodes without neighbours
TINY = 1e-10


def intrinsic_dimension(edges: DataFrame, nodes: DataFrame) -> float:
    """ceil(ln(summed weight by node / n) / ln ln n), 2 to 10. Weights stand in for degrees."""
    n = nodes.count()
    total = 2 * (edges.agg(F.sum("weight")).first()[0] or 0.0)
    if n < 3 or total <= n:
        return 2.0
    low = math.log(math.log(n))
    return float(min(max(math.ceil(math.log(total / n) / low), 2), 10)) if low > 0 else 2.0


def _offset(correction: str, k: int) -> float:
    found = {"k": float(k), "k-1": k - 1.0, "k-0.5": k - 0.5, "none": float(k)}.get(correction)
    if found is None:
        raise ValueError(f"unknown boundary correction {correction!r}")
    return found


def _core(edges: DataFrame, nodes: DataFrame, k: int) -> DataFrame:
    """``(id, core)``: distance of the k-th nearest, of the farthest if there are fewer, FAR if there is none."""
    near = nearest_per_node(edges, k).groupBy(F.col("src").alias("id")).agg(F.max("weight").alias("core"))
    return nodes.select("id").join(near, "id", "left").select("id", F.coalesce("core", F.lit(FAR)).alias("core"))


def min_max(df: DataFrame, col: str) -> DataFrame:
    """``df`` with ``col`` scaled to 0 .. 1; constant columns become 0."""
    r = F.broadcast(df.agg(F.min(col).alias("__lo"), F.max(col).alias("__hi")))
    v = F.when(F.col("__hi") > F.col("__lo"), (F.col(col) - F.col("__lo")) / (F.col("__hi") - F.col("__lo"))).otherwise(0.0)
    return df.crossJoin(r).withColumn(col, v).drop("__lo", "__hi")  # one row


def raw_density(
    edges: DataFrame, nodes: DataFrame, method: str = "knn_distance", *, k: int = 5, dimension: float | None = None, boundary_correction: str = "k-1", normalize: bool = False
) -> DataFrame:
    """``(id, density)`` by the distance of the k-th neighbour, the mean of k, the degree, or mutual reach."""
    if method not in ("knn_distance", "avg_knn_distance", "degree", "local_reach"):
        raise ValueError(f"unknown method {method!r}")
    c = _offset(boundary_correction, k)
    if method == "degree":
        d = degrees(edges, nodes)
        top = F.broadcast(d.agg(F.max("degree").alias("__m")))
        out = d.crossJoin(top).select("id", F.when(F.col("__m") > 0, F.col("degree") / F.col("__m")).otherwise(0.0).alias("density"))  # one row
    else:
        dim = intrinsic_dimension(edges, nodes) if dimension is None else float(dimension)
        power = lambda x: F.pow(x + TINY, dim)
        if method == "knn_distance":
            out = _core(edges, nodes, k).select("id", (F.lit(c) / power(F.col("core"))).alias("density"))
        else:
            near = nearest_per_node(edges, k)
            d: Column = F.col("weight")
            if method == "local_reach":
                near = near.join(_core(edges, nodes, k).withColumnRenamed("id", "dst"), "dst")
                d = F.greatest("weight", "core")
            mean = near.groupBy(F.col("src").alias("id")).agg(F.avg(d).alias("m"))
            out = nodes.select("id").join(mean, "id", "left").select("id", (F.lit(1.0) / power(F.coalesce("m", F.lit(FAR)))).alias("density"))
    return min_max(out, "density") if normalize else out


def _matvec(arms: DataFrame, x: DataFrame, col: str) -> DataFrame:
    """``(id, y)``: weighted sum over neighbours of ``x(id, col)``."""
    return arms.join(x.select(F.col("id").alias("dst"), F.col(col).alias("__x")), "dst").groupBy(F.col("src").alias("id")).agg(F.sum(F.col("weight") * F.col("__x")).alias("y"))


def smooth_density(
    edges: DataFrame, density: DataFrame, method: str = "neighborhood_avg", *, iterations: int = 2, alpha: float = 0.5, k: int = 10, use_median: bool = False,
    lam: float = 1.0, tolerance: float = 1e-8, normalize: bool = True,
) -> DataFrame:
    """``(id, density)`` smoothed over the graph; isolated nodes keep theirs.

    Neighbourhood: mean or median of the (densest ``k``) neighbours, mixed in by ``alpha``. Gaussian:
    weighted mean or median with the node itself, by exp(-(d / median distance)^2 / 2). Heat: steps of
    I - alpha L. Tikhonov: (I + lam L) x = raw, by conjugate gradients.
    """
    steps = {"neighborhood_avg": _neighborhood, "gaussian": _gaussian, "heat_diffusion": _heat, "tikhonov": _tikhonov}
    if method not in steps:
        raise ValueError(f"unknown method {method!r}")
    arms = materialize(both_ways(edges.select("src", "dst", "weight")), "arms")
    x = density.select("id", F.col("density").cast("double").alias("density"))
    if method == "tikhonov":
        x = _tikhonov(arms, x, lam, tolerance)
    else:
        for _ in range(iterations):
            x = materialize(steps[method](arms, x, alpha, k, use_median), "density")
    return min_max(x, "density") if normalize else x


def _neighborhood(arms: DataFrame, x: DataFrame, alpha: float, k: int, use_median: bool) -> DataFrame:
    near = arms.join(x.select(F.col("id").alias("dst"), F.col("density").alias("v")), "dst")
    w = Window.partitionBy("src").orderBy(F.desc("v"), "dst")
    near = near.withColumn("r", F.row_number().over(w)).where(F.col("r") <= k)
    agg = near.groupBy(F.col("src").alias("id")).agg((F.median("v") if use_median else F.avg("v")).alias("m"))
    return x.join(agg, "id", "left").select("id", F.coalesce((1 - alpha) * F.col("density") + alpha * F.col("m"), "density").alias("density"))


def _gaussian(arms: DataFrame, x: DataFrame, alpha: float, k: int, use_median: bool) -> DataFrame:
    width = arms.groupBy("src").agg(F.median("weight").alias("bw"))
    near = (
        arms.join(width, "src")
        .join(x.select(F.col("id").alias("dst"), F.col("density").alias("v")), "dst")
        .select(F.col("src").alias("id"), "v", F.exp(-0.5 * F.pow(F.col("weight") / F.greatest("bw", F.lit(1e-12)), 2)).alias("w"))
    )
    rows = near.unionByName(x.select("id", F.col("density").alias("v"), F.lit(1.0).alias("w")))
    if not use_median:
        return rows.groupBy("id").agg((F.sum(F.col("w") * F.col("v")) / F.sum("w")).alias("density"))
    order = Window.partitionBy("id").orderBy("v")
    share = F.sum("w").over(order.rowsBetween(Window.unboundedPreceding, 0)) / F.sum("w").over(Window.partitionBy("id"))
    return rows.withColumn("c", share).where(F.col("c") >= 0.5 - 1e-12).groupBy("id").agg(F.min("v").alias("density"))


def _laplacian(arms: DataFrame, x: DataFrame, col: str) -> DataFrame:
    """``x`` with ``lx``, the weighted graph Laplacian applied to ``col``."""
    deg = arms.groupBy(F.col("src").alias("id")).agg(F.sum("weight").alias("__d"))
    out = x.join(deg, "id", "left").join(_matvec(arms, x, col), "id", "left")
    return out.select(*x.columns, (F.coalesce("__d", F.lit(0.0)) * F.col(col) - F.coalesce("y", F.lit(0.0))).alias("lx"))


def _heat(arms: DataFrame, x: DataFrame, alpha: float, k: int, use_median: bool) -> DataFrame:
    return _laplacian(arms, x, "density").select("id", (F.col("density") - alpha * F.col("lx")).alias("density"))


def _tikhonov(arms: DataFrame, x: DataFrame, lam: float, tolerance: float, max_iter: int = 200) -> DataFrame:
    if arms.where("weight < 0").take(1):
        raise ValueError("Tikhonov smoothing needs weights that are not negative")
    state = materialize(_laplacian(arms, x, "density").select("id", F.col("density").alias("x"), (-lam * F.col("lx")).alias("r")).withColumn("p", F.col("r")), "cg")
    rr = state.agg(F.sum(F.col("r") * F.col("r"))).first()[0] or 0.0
    goal = tolerance**2 * max(x.agg(F.sum(F.col("density") * F.col("density"))).first()[0] or 0.0, 1e-300)
    for _ in range(max_iter):
        if rr <= goal:
            break
        ap = materialize(_laplacian(arms, state, "p").withColumn("ap", F.col("p") + lam * F.col("lx")), "cg")
        step = rr / ap.agg(F.sum(F.col("p") * F.col("ap"))).first()[0]
        nxt = ap.select("id", (F.col("x") + step * F.col("p")).alias("x"), (F.col("r") - step * F.col("ap")).alias("r"), "p")
        new = nxt.agg(F.sum(F.col("r") * F.col("r"))).first()[0]
        state = nxt.withColumn("p", F.col("r") + (new / rr) * F.col("p"))
        rr = new
    return state.select("id", F.col("x").alias("density"))


def estimate_density(edges: DataFrame, nodes: DataFrame, method: str = "knn_distance", smoothing: str = "neighborhood_avg", *, raw: dict | None = None, smooth: dict | None = None) -> DataFrame:
    """``(id, raw_density, density)``."""
    r = materialize(raw_density(edges, nodes, method, **{"normalize": True, **(raw or {})}), "raw-density")
    s = smooth_density(edges, r, smoothing, **(smooth or {}))
    return r.withColumnRenamed("density", "raw_density").join(s, "id")


def kernel_density(points: DataFrame, bandwidth: float | None = None, normalize: bool = False, block_rows: int = 2048) -> DataFrame:
    """``(id, density)``: Gaussian kernel density of ``points(id, v)`` in 2 or 3 dimensions.

    The kernel's covariance is the sample covariance times the squared factor (Scott's n^(-1/(d+4)) by
    default). Points are taken in pairs of blocks, one task a pair; only a partial sum a point and
    block is shuffled.
    """
    import numpy as np
    import pyarrow as pa

    from .knn import _pack

    d = points.select(F.size("v")).first()
    if d is None or d[0] not in (2, 3):
        raise ValueError("kernel density needs points of 2 or 3 dimensions")
    d = d[0]
    m = points.agg(F.count(F.lit(1)).alias("n"), *[F.covar_samp(F.col("v")[i], F.col("v")[j]).alias(f"c{i}{j}") for i in range(d) for j in range(d)]).first()
    n = m["n"]
    factor = bandwidth if bandwidth is not None else n ** (-1 / (d + 4))
    cov = np.array([[m[f"c{i}{j}"] or 0.0 for j in range(d)] for i in range(d)]) * factor**2
    white = np.linalg.inv(np.linalg.cholesky(cov))
    norm = 1 / (n * math.sqrt((2 * math.pi) ** d * np.linalg.det(cov)))
    blocks = max(1, -(-n // block_rows))
    packed = materialize(_pack(points.select("id", F.col("v").cast("array<double>"), F.pmod(F.xxhash64("id"), F.lit(blocks)).cast("int").alias("b")), "b"), "blocks")
    pairs = packed.select("ids", "m").crossJoin(packed.select(F.col("m").alias("m2"))).repartition(min(blocks * blocks, 2000))

    def run(batches):
        for b in batches:
            for row in b.to_pylist():
                ids = np.frombuffer(row["ids"], np.int64)
                x, y = (np.frombuffer(row[c]).reshape(-1, d) @ white.T for c in ("m", "m2"))
                sq = ((x[:, None, :] - y[None, :, :]) ** 2).sum(2)
                yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(np.exp(-sq / 2).sum(1) * norm)], names=["id", "s"])

    out = pairs.mapInArrow(run, "id long, s double").groupBy("id").agg(F.sum("s").alias("density"))
    return min_max(out, "density") if normalize else out
