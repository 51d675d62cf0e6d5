"""Dimension reduction, landmarks, interpolation, and layouts."""

from __future__ import annotations

import math
import warnings

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import materialize
from .components import component_labels, component_roots, number_rows
from .graph import both_ways, degrees
from .sparsify import nearest_per_node, row_stochastic

METHODS = ("none", "pca", "ipca", "svd", "rsvd", "rp", "srp")


def second_moments(vectors: DataFrame) -> tuple[int, np.ndarray, np.ndarray]:
    """Rows, sum vector, and sum of outer products of ``vectors(id, v)``: one partial d x d matrix a partition."""

    def run(batches):
        n, s, m = 0, None, None
        for b in batches:
            x = b.column(0).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(b.num_rows, -1)
            n, s, m = n + len(x), x.sum(0) + (0 if s is None else s), x.T @ x + (0 if m is None else m)
        if n:
            flat = np.concatenate([[n], s, m.ravel()])
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(flat))), pa.array(flat)], names=["i", "v"])

    rows = vectors.select("v").mapInArrow(run, "i long, v double").groupBy("i").agg(F.sum("v").alias("v")).toPandas()
    if rows.empty:
        return 0, np.zeros(0), np.zeros((0, 0))
    flat = rows.sort_values("i")["v"].to_numpy()
    d = int((math.isqrt(1 + 4 * (len(flat) - 1)) - 1) // 2)
    return int(flat[0]), flat[1 : d + 1], flat[d + 1 :].reshape(d, d)


def default_components(d: int, method: str) -> int:
    return max(1, min(d - 1 if method in ("svd", "rsvd") else d, max(16, d // 2)))


def dims_for_variance(values: np.ndarray, share: float) -> int:
    """How many leading variances reach ``share`` of all: one more than the first that does, 2 at least."""
    cum = np.cumsum(values) / max(values.sum(), 1e-300)
    return int(min(max(np.searchsorted(cum, share) + 1, 2), len(values)))


def reduce_vectors(vectors: DataFrame, method: str = "none", *, n_components: int | None = None, variance: float | None = None, eps: float = 0.1, seed: int = 42) -> tuple[DataFrame, dict]:
    """``(id, v)`` in fewer dimensions, and what was done.

    PCA (also incremental) and SVD come from exact moments of all rows; random projections have
    Gaussian or sparse entries, and by default as many dimensions as the Johnson-Lindenstrauss bound
    for ``eps`` asks, the vectors' own at most. Component signs: the largest entry is positive.
    """
    if method not in METHODS:
        raise ValueError(f"unknown method {method!r}")
    if method == "none":
        return vectors.select("id", "v"), {"method": method}
    first = vectors.select(F.size("v")).first()
    if first is None:
        return vectors.select("id", "v"), {"method": method, "n_components": 0}
    d = first[0]
    info: dict = {"method": method}
    if method in ("rp", "srp"):
        n = vectors.count()
        k = n_components or max(1, min(d, int(4 * math.log(max(n, 2)) / (eps**2 / 2 - eps**3 / 3))))
        rng = np.random.default_rng(seed)
        if method == "rp":
            w = rng.normal(0, 1 / math.sqrt(k), (d, k))
        else:
            s = math.sqrt(d)
            w = rng.choice([1.0, 0.0, -1.0], (d, k), p=[1 / (2 * s), 1 - 1 / s, 1 / (2 * s)]) * math.sqrt(s / k)
        mean = np.zeros(d)
    else:
        n, total, outer = second_moments(vectors)
        centred = method in ("pca", "ipca")
        mean = total / n if centred else np.zeros(d)
        values, axes = np.linalg.eigh(outer / n - np.outer(mean, mean))
        values, axes = np.maximum(values[::-1], 0), axes[:, ::-1]
        k = dims_for_variance(values, variance) if variance is not None else min(n_components or default_components(d, method), d)
        w = axes[:, :k] * np.sign(axes[np.abs(axes[:, :k]).argmax(0), np.arange(k)])
        info |= {"explained_variance": values[:k].tolist(), "explained_share": float(values[:k].sum() / max(values.sum(), 1e-300))}

    def project(batches):
        for b in batches:
            x = b.column(1).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(b.num_rows, -1)
            y = (x - mean) @ w
            yield pa.RecordBatch.from_arrays([b.column(0), pa.ListArray.from_arrays(np.arange(len(y) + 1, dtype=np.int32) * k, pa.array(y.ravel()))], names=["id", "v"])

    return vectors.select("id", "v").mapInArrow(project, "id long, v array<double>"), info | {"n_components": k}


def quotas(sizes: DataFrame, total: int) -> DataFrame:
    """``(component, quota)``: ``total`` shared out by ``size``, at least one each; largest remainders first, ties by component."""
    s = sizes.crossJoin(F.broadcast(sizes.agg(F.sum("size").alias("n"), F.count(F.lit(1)).alias("c"))))  # one row
    exact = F.greatest(F.lit(total) - F.col("c"), F.lit(0)) * F.col("size") / F.col("n")
    s = s.select("component", "size", exact.alias("x"), F.lit(total).alias("t"), "c").withColumn("base", F.floor("x"))
    rest = F.broadcast(s.agg((F.greatest(F.lit(total) - F.first("c"), F.lit(0)) - F.sum("base")).alias("rest")))
    ranked = number_rows(s, [(F.col("x") - F.col("base")).desc(), F.col("component")], "r")
    return ranked.crossJoin(rest).select("component", F.least(F.col("size"), 1 + F.col("base") + F.when(F.col("r") < F.col("rest"), 1).otherwise(0)).cast("long").alias("quota"))


def blue_noise_landmarks(edges: DataFrame, nodes: DataFrame, n_landmarks: int, *, k: int = 10, hops: int = 1, degree_bias: float = 0.5, seed: int = 42) -> DataFrame:
    """``(id)``: landmarks spread over every component.

    On the graph of each node's ``k`` shortest edges, nodes are visited in the order of -ln U over
    degree^bias, U a hash of the id; a chosen node blocks those within ``hops``. What a component lacks
    then is filled up in the same order. Components run in parallel, one task each.
    """
    short = nearest_per_node(edges, k).select(F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst")).distinct()
    labels = materialize(component_labels(nodes, edges), "labels")
    want = quotas(labels.groupBy("component").agg(F.count(F.lit(1)).alias("size")), n_landmarks)
    u = (F.pmod(F.xxhash64(F.lit(seed), "id"), F.lit(1 << 52)) + 0.5) / float(1 << 52)
    deg = degrees(short, nodes)
    key = deg.select("id", (-F.log(u) / F.pow(F.greatest("degree", F.lit(1)).cast("double"), degree_bias)).alias("key"))
    near = both_ways(short).groupBy(F.col("src").alias("id")).agg(F.collect_list("dst").alias("near"))
    rows = labels.join(key, "id").join(near, "id", "left").join(want, "component")

    def pick(pdf: pd.DataFrame) -> pd.DataFrame:
        adj = {i: ([] if n is None else n) for i, n in zip(pdf["id"], pdf["near"])}
        order = pdf.sort_values(["key", "id"])["id"].tolist()
        quota, out, blocked = int(pdf["quota"].iloc[0]), [], set()
        for i in order:
            if len(out) >= quota:
                break
            if i in blocked:
                continue
            out.append(i)
            ring = {i}
            for _ in range(hops):
                ring = {j for x in ring for j in adj.get(x, ())} | ring
            blocked |= ring
        chosen = set(out)
        out += [i for i in order if i not in chosen][: max(quota - len(out), 0)]
        return pd.DataFrame({"id": out})

    return rows.groupBy("component").applyInPandas(pick, "id long")


def barycentric(p: DataFrame, known: DataFrame, nodes: DataFrame) -> DataFrame:
    """``(id, y)``: the weighted mean of the landmarks among the neighbours; landmarks keep ``known(id, y)``; zeros without any."""
    flat = known.select(F.col("id").alias("dst"), F.posexplode("y").alias("i", "v"))
    w = p.join(known.select(F.col("id").alias("dst")), "dst").groupBy("src").agg(F.sum("p").alias("w"))
    s = p.join(flat, "dst").groupBy("src", "i").agg(F.sum(F.col("p") * F.col("v")).alias("s"))
    y = s.join(w, "src").groupBy(F.col("src").alias("id")).agg(F.transform(F.array_sort(F.collect_list(F.struct("i", (F.col("s") / (F.col("w") + 1e-12)).alias("v")))), lambda e: e["v"]).alias("y"))
    dim = known.select(F.size("y")).first()[0]
    zero = F.array(*[F.lit(0.0)] * dim)
    return nodes.select("id").join(known.select("id", F.col("y").alias("own")), "id", "left").join(y, "id", "left").select("id", F.coalesce("own", "y", zero).alias("y"))


def harmonic_interpolate(p: DataFrame, known: DataFrame, nodes: DataFrame, *, max_iter: int = 50, tol: float = 1e-4, alpha: float = 1.0) -> DataFrame:
    """``(id, y)``: repeated averaging over neighbours, landmarks held fast, until the relative change is under ``tol``."""
    y = materialize(barycentric(p, known, nodes), "layout")
    fixed = known.select("id", F.lit(True).alias("fixed"))
    for _ in range(max_iter):
        flat = y.select(F.col("id").alias("dst"), F.posexplode("y").alias("i", "v"))
        avg = p.join(flat, "dst").groupBy("src", "i").agg(F.sum(F.col("p") * F.col("v")).alias("s"))
        new = avg.groupBy(F.col("src").alias("id")).agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "s"))), lambda e: e["s"]).alias("m"))
        mixed = F.when(F.col("fixed") | F.col("m").isNull(), F.col("y")).otherwise(F.zip_with("y", "m", lambda a, b: (1 - alpha) * a + alpha * b))
        step = materialize(y.join(fixed, "id", "left").join(new, "id", "left").withColumn("fixed", F.coalesce("fixed", F.lit(False))).select("id", mixed.alias("y"), F.col("y").alias("old")), "layout")
        sq = lambda c: F.aggregate(c, F.lit(0.0), lambda a, x: a + x * x)
        c = step.agg(F.sum(sq(F.zip_with("y", "old", lambda a, b: a - b))).alias("d"), F.sum(sq(F.col("old"))).alias("n")).first()
        y = step.select("id", "y")
        if math.sqrt(c["d"] or 0.0) <= tol * max(math.sqrt(c["n"] or 0.0), 1e-12):
            break
    else:
        warnings.warn(f"harmonic interpolation did not converge in {max_iter} rounds", RuntimeWarning, stacklevel=2)
    return y


def laplacian_interpolate(edges: DataFrame, known: DataFrame, nodes: DataFrame, *, max_iter: int = 200, tol: float = 1e-6) -> DataFrame:
    """``(id, y)``: solves L_UU Y = -L_UL Y_L by conjugate gradients, one system a dimension, all at once.

    ``edges.weight`` are similarities. Nodes that no landmark reaches keep zeros.
    """
    arms = materialize(both_ways(edges.select("src", "dst", "weight")), "arms")
    dim = known.select(F.size("y")).first()[0]
    fixed = known.select(F.col("id").alias("dst"), F.lit(True).alias("fixed"))
    free = nodes.select("id").join(known.select("id"), "id", "left_anti")
    inner = materialize(arms.join(fixed, "dst", "left_anti").join(free.withColumnRenamed("id", "src"), "src", "left_semi").select("src", "dst", "weight"), "inner")
    deg = materialize(free.join(arms.groupBy(F.col("src").alias("id")).agg(F.sum("weight").alias("d")), "id", "left").select("id", F.coalesce("d", F.lit(0.0)).alias("d")), "degrees")
    cols = [F.sum(F.col("weight") * F.col("yl")[i]).alias(f"b{i}") for i in range(dim)]
    rhs = arms.join(known.select(F.col("id").alias("dst"), F.col("y").alias("yl")), "dst").groupBy(F.col("src").alias("id")).agg(*cols)
    state = deg.join(rhs, "id", "left").na.fill(0.0)
    state = state.select("id", "d", *[F.lit(0.0).alias(f"x{i}") for i in range(dim)], *[F.col(f"b{i}").alias(f"r{i}") for i in range(dim)], *[F.col(f"b{i}").alias(f"p{i}") for i in range(dim)])
    state = materialize(state, "cg")
    rr = [state.agg(F.sum(F.col(f"r{i}") ** 2)).first()[0] or 0.0 for i in range(dim)]
    goal = [tol**2 * max(v, 1e-300) for v in rr]
    for _ in range(max_iter):
        if all(a <= g for a, g in zip(rr, goal)):
            break
        px = state.select(F.col("id").alias("dst"), *[f"p{i}" for i in range(dim)])
        mv = inner.join(px, "dst").groupBy(F.col("src").alias("id")).agg(*[F.sum(F.col("weight") * F.col(f"p{i}")).alias(f"m{i}") for i in range(dim)])
        ap = state.join(mv, "id", "left").na.fill(0.0, [f"m{i}" for i in range(dim)])
        ap = materialize(ap.select(*state.columns, *[(F.col("d") * F.col(f"p{i}") - F.col(f"m{i}")).alias(f"a{i}") for i in range(dim)]), "cg")
        dot = ap.agg(*[F.sum(F.col(f"p{i}") * F.col(f"a{i}")).alias(f"q{i}") for i in range(dim)]).first()
        step = [r / dot[f"q{i}"] if dot[f"q{i}"] and rr[i] > goal[i] else 0.0 for i, r in enumerate(rr)]
        nxt = ap.select("id", "d", *[(F.col(f"x{i}") + step[i] * F.col(f"p{i}")).alias(f"x{i}") for i in range(dim)], *[(F.col(f"r{i}") - step[i] * F.col(f"a{i}")).alias(f"r{i}") for i in range(dim)], *[f"p{i}" for i in range(dim)])
        got = nxt.agg(*[F.sum(F.col(f"r{i}") ** 2).alias(f"n{i}") for i in range(dim)]).first()
        new = [got[f"n{i}"] or 0.0 for i in range(dim)]
        state = nxt.select("id", "d", *[f"x{i}" for i in range(dim)], *[f"r{i}" for i in range(dim)], *[(F.col(f"r{i}") + (new[i] / rr[i] if rr[i] else 0.0) * F.col(f"p{i}")).alias(f"p{i}") for i in range(dim)])
        rr = new
    solved = state.select("id", F.array(*[f"x{i}" for i in range(dim)]).alias("y"))
    return known.select("id", "y").unionByName(solved)


class _Arcs:
    """A symmetric matrix in arrays, by rows; products run over so many arcs at a time."""

    def __init__(self, src: np.ndarray, dst: np.ndarray, w: np.ndarray, n: int, step: int = 1 << 19):
        loop = src == dst
        rows, cols, w = np.concatenate([src, dst[~loop]]), np.concatenate([dst, src[~loop]]), np.concatenate([w, w[~loop]])
        order = np.argsort(rows, kind="stable")
        self.n, self.cols, self.w = n, cols[order], w[order]
        self.start = np.searchsorted(rows[order], np.arange(n + 1))
        self.cuts = np.unique(np.append(np.searchsorted(self.start, np.arange(0, self.start[-1], step)), n))  # hubs are whole

    def sums(self) -> np.ndarray:
        return np.bincount(np.repeat(np.arange(self.n), np.diff(self.start)), self.w, self.n)

    def dot(self, x: np.ndarray) -> np.ndarray:
        out = np.zeros_like(x)
        for lo, hi in zip(np.append(0, self.cuts), self.cuts):
            some = lo + np.nonzero(self.start[lo + 1 : hi + 1] > self.start[lo:hi])[0]
            if len(some):
                p, q = self.start[lo], self.start[hi]
                out[some] = np.add.reduceat(x[self.cols[p:q]] * self.w[p:q, None], self.start[some] - p, axis=0)
        return out


def _lowest_of_laplacian(arcs: _Arcs, part: np.ndarray, dims: int, tol: float = 1e-9, max_products: int = 100_000) -> np.ndarray:
    """``dims`` eigenvectors of the normalised Laplacian after the first, by a subspace under Chebyshev filters.

    Those of eigenvalue 0 are known: one for each part (``part`` numbers them) with weight. The first is their sum; the
    next are those of the largest parts. What is left is searched among vectors at right angles to all of them.
    """
    n, d = arcs.n, arcs.sums()
    scale, root = 1 / np.sqrt(np.maximum(d, 1e-12)), np.sqrt(np.maximum(d, 0))
    mass = np.bincount(part, root * root)
    known = np.zeros((n, 1)) + root[:, None]
    for c in np.lexsort((np.arange(len(mass)), -np.bincount(part)))[: dims + 1]:
        if mass[c] > 0:
            known = np.hstack([known, np.where(part == c, root, 0.0)[:, None]])
    q, r = np.linalg.qr(known)
    q = q[:, np.abs(np.diag(r)) > 1e-9 * np.sqrt(mass.sum())][:, 1 : dims + 1]
    want = min(dims - q.shape[1], n - int((mass > 0).sum()))
    if want <= 0:
        return q
    unit = root / np.sqrt(np.maximum(mass, 1e-300))[part]

    def clear(x):
        return x - unit[:, None] * np.stack([np.bincount(part, unit * c, len(mass)) for c in x.T], 1)[part]

    def times(x):
        return scale[:, None] * arcs.dot(scale[:, None] * x)

    x = np.linalg.qr(clear(np.random.default_rng(42).standard_normal((n, min(want + 8, n - int((mass > 0).sum()))))))[0]
    degree, made, before = 20, 0, np.inf
    while True:
        ax = times(x)
        values, turn = np.linalg.eigh(x.T @ ax)
        values, x, ax = values[::-1], x @ turn[:, ::-1], ax @ turn[:, ::-1]
        left = np.linalg.norm(ax[:, :want] - x[:, :want] * values[:want], axis=0).max()
        if left <= tol or x.shape[1] == want or made >= max_products:
            break
        degree = min(degree * 2, 640) if left > before / 100 else degree
        before, low, high = left, -1.0, min(max(values[-1], -0.9), 1 - 1e-12)
        mid, half = (high + low) / 2, (high - low) / 2
        old, cur = x, (ax - mid * x) / half
        for _ in range(degree - 1):
            old, cur = cur, (times(cur) - mid * cur) * (2 / half) - old
            big = np.abs(cur).max()
            if big > 1e100:
                old, cur = old / big, cur / big
        made += degree
        x = np.linalg.qr(clear(cur / np.maximum(np.abs(cur).max(0), 1e-300)))[0]
    if left > max(tol, 1e-7) and x.shape[1] > want:
        warnings.warn(f"spectral layout did not settle in {made} products: residual {left:.1e}", RuntimeWarning, stacklevel=3)
    return np.hstack([q, x[:, :want]])


def spectral_layout(edges: DataFrame, nodes: DataFrame, dims: int = 2, local_nodes: int = 5_000) -> DataFrame:
    """``(id, y)``: the eigenvectors of the normalised Laplacian after the first.

    Up to ``local_nodes`` nodes from the whole matrix; beyond, from arrays of the edges on the driver, whose memory and
    time for a product grow with the edges.
    """
    spark = nodes.sparkSession
    ids = np.sort(nodes.select("id").toArrow().column(0).to_numpy())
    t = edges.select("src", "dst", F.col("weight").cast("double")).toArrow()
    src, dst = (np.searchsorted(ids, t.column(c).to_numpy()) for c in ("src", "dst"))
    w = t.column("weight").to_numpy()
    if len(ids) <= local_nodes:
        a = np.zeros((len(ids), len(ids)))
        a[src, dst] = a[dst, src] = w
        scale = 1 / np.sqrt(np.maximum(a.sum(1), 1e-12))
        y = np.linalg.eigh(np.eye(len(ids)) - scale[:, None] * a * scale[None, :])[1][:, 1 : dims + 1]
    else:
        root = component_roots(nodes.select("id"), edges.where("weight > 0")).toArrow()
        place = np.searchsorted(ids, root.column("id").to_numpy())
        part = np.empty(len(ids), np.int64)
        part[place] = np.unique(root.column("root").to_numpy(), return_inverse=True)[1]
        y = _lowest_of_laplacian(_Arcs(src, dst, w, len(ids)), part, dims)
    y = np.hstack([y, np.zeros((len(ids), dims - y.shape[1]))])
    y = y * np.where(y[np.abs(y).argmax(0), np.arange(dims)] < 0, -1, 1) if len(ids) else y
    lists = pa.ListArray.from_arrays(pa.array(np.arange(len(ids) + 1, dtype=np.int32) * dims), pa.array(np.ascontiguousarray(y).ravel()))
    return spark.createDataFrame(pa.table({"id": pa.array(ids), "y": lists}), "id long, y array<double>")


def fuzzy_union(edges: DataFrame, k: int = 15) -> DataFrame:
    """``(src, dst, weight)``: the fuzzy simplicial set of each node's ``k`` nearest, joined as a + b - ab.

    Every row's scale is found by bisection so that its memberships add up to log2 k.
    """
    near = nearest_per_node(edges, k).groupBy("src").agg(F.array_sort(F.collect_list(F.struct(F.col("weight").alias("d"), F.col("dst").alias("j")))).alias("near"))

    @F.pandas_udf("array<double>")
    def member(rows: pd.Series) -> pd.Series:
        out = []
        for row in rows:
            d = np.array([x["d"] for x in row])
            d = np.maximum(d - d[0], 0)
            lo, hi = 0.0, np.inf
            s, goal = 1.0, math.log2(max(k, 2))
            for _ in range(64):
                total = np.exp(-d / s).sum()
                if abs(total - goal) < 1e-5:
                    break
                if total > goal:
                    hi = s
                    s = (lo + hi) / 2
                else:
                    lo = s
                    s = s * 2 if np.isinf(hi) else (lo + hi) / 2
            out.append(np.exp(-d / s))
        return pd.Series(out)

    one = near.withColumn("m", member("near")).select("src", F.explode(F.arrays_zip("near", "m")).alias("e")).select("src", F.col("e.near.j").alias("dst"), F.col("e.m").alias("w"))
    pair = one.groupBy(F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst")).agg(F.sum("w").alias("s"), F.product("w").alias("p"), F.count(F.lit(1)).alias("n"))
    return pair.select("src", "dst", F.when(F.col("n") > 1, F.col("s") - F.col("p")).otherwise(F.col("s")).alias("weight"))


def pad_low_degree(edges: DataFrame, nodes: DataFrame, k: int, always: bool = False) -> DataFrame:
    """``edges`` with a clique of new nodes, very far away, joined to every node of fewer than ``k`` edges.

    The clique has as many nodes as the largest lack, or as makes the low nodes and it ``k`` + 1. Where no node
    lacks any there is no clique, or with ``always`` one of ``k`` nodes that is joined to none.
    """
    low = materialize(degrees(edges, nodes).where(F.col("degree") < k), "low")
    s = low.agg(F.max(F.lit(k) - F.col("degree")).alias("lack"), F.count(F.lit(1)).alias("n")).first()
    if not s["n"] and not always:
        return edges.select("src", "dst", "weight")
    count = min(max(s["lack"] or 0, k - s["n"] + 1), k)
    top = nodes.agg(F.max("id")).first()[0]
    far = max(edges.agg(F.max("weight")).first()[0] or 1.0, 1.0) * 1e6
    extra = nodes.sparkSession.range(top + 1, top + 1 + count).select(F.col("id").alias("x"))
    ties = low.select(F.col("id").alias("src"), F.explode(F.sequence(F.lit(top + 1), F.lit(top) + F.greatest(F.lit(k) - F.col("degree"), F.lit(1)))).alias("dst"))
    clique = extra.select(F.col("x").alias("src"), F.explode(F.sequence(F.col("x"), F.lit(top + count))).alias("dst")).where("src < dst")
    return edges.select("src", "dst", "weight").unionByName(ties.unionByName(clique).withColumn("weight", F.lit(float(far))))


def landmark_layout(edges: DataFrame, nodes: DataFrame, n_landmarks: int = 1000, dims: int = 2, *, interpolation: str = "laplacian_cg", k: int = 15, **options) -> DataFrame:
    """``(id, y)``: landmarks laid out by their own graph, all other nodes interpolated."""
    if interpolation not in ("laplacian_cg", "harmonic", "barycentric"):
        raise ValueError(f"unknown interpolation {interpolation!r}")
    marks = materialize(blue_noise_landmarks(edges, nodes, n_landmarks, k=k), "landmarks")
    # landmarks are neighbours if their regions touch: the least landmark one hop away stands for a node
    near = both_ways(edges.select("src", "dst", "weight")).join(marks.withColumnRenamed("id", "dst"), "dst", "left_semi")
    owner = near.groupBy(F.col("src").alias("id")).agg(F.min_by("dst", F.struct("weight", "dst")).alias("m"))
    owner = owner.join(marks, "id", "left_anti").unionByName(marks.select("id", F.col("id").alias("m")))
    a, b = owner.select(F.col("id").alias("src"), F.col("m").alias("ms")), owner.select(F.col("id").alias("dst"), F.col("m").alias("mt"))
    links = edges.join(a, "src").join(b, "dst").where("ms != mt").groupBy(F.least("ms", "mt").alias("src"), F.greatest("ms", "mt").alias("dst")).agg(F.count(F.lit(1)).cast("double").alias("weight"))
    known = materialize(spectral_layout(links, marks, dims), "known")
    p = row_stochastic(edges)
    if interpolation == "barycentric":
        return barycentric(p, known, nodes)
    if interpolation == "harmonic":
        return harmonic_interpolate(p, known, nodes, **options)
    sim = edges.select("src", "dst", F.exp(-F.col("weight")).alias("weight"))
    return laplacian_interpolate(sim, known, nodes, **options)


def with_layout(nodes: DataFrame, layout: DataFrame, prefix: str = "UMAP") -> DataFrame:
    """``nodes`` with columns ``<prefix>_<n>D_<i>``."""
    dim = layout.select(F.size("y")).first()[0]
    cols = layout.select("id", *[F.col("y")[i].alias(f"{prefix}_{dim}D_{i + 1}") for i in range(dim)])
    return nodes.drop(*[c for c in cols.columns if c != "id"]).join(cols, "id", "left")


def neighbor_arrays(edges: DataFrame, nodes: DataFrame, k: int) -> DataFrame:
    """``(id, neighbors, distances)``: ``k`` nearest by the edges, padded with the node itself at twice the last distance."""
    near = nearest_per_node(edges, k).groupBy(F.col("src").alias("id")).agg(F.array_sort(F.collect_list(F.struct("rank", "dst", "weight"))).alias("n"))
    rows = nodes.select("id").join(near, "id", "left").withColumn("n", F.coalesce("n", F.array().cast(near.schema["n"].dataType)))
    lack = F.lit(k) - F.size("n")
    last = F.coalesce(F.get("n", F.size("n") - 1)["weight"] * 2, F.lit(1.0))
    return rows.select("id", F.concat(F.transform("n", lambda x: x["dst"]), F.array_repeat("id", lack)).alias("neighbors"), F.concat(F.transform("n", lambda x: x["weight"]), F.array_repeat(last, lack)).alias("distances"))


def sampled_edges(edges: DataFrame, n: int, strongest: bool = True, seed: int = 42) -> DataFrame:
    """``n`` edges to draw: the heaviest, or hashed."""
    order = [F.desc("weight")] if strongest else [F.xxhash64(F.lit(seed), "src", "dst")]
    return edges.orderBy(*order, "src", "dst").limit(n)


def sampled_points(nodes: DataFrame, n: int, stride: bool = False, seed: int = 42) -> DataFrame:
    """About ``n`` nodes to draw: every so many ids, or hashed."""
    if stride:
        step = max(1, nodes.count() // max(n, 1))
        return nodes.where(F.col("id") % step == 0)
    return nodes.orderBy(F.xxhash64(F.lit(seed), "id"), "id").limit(n)


def connect_components(edges: DataFrame, nodes: DataFrame, vectors: DataFrame) -> DataFrame:
    """``edges`` with a tree over the components: between their nodes of least degree, by Euclidean distance."""
    from .knn import knn_exact
    from .mst import minimum_forest

    labels = component_labels(nodes, edges)
    reps = materialize(degrees(edges, nodes).join(labels, "id").groupBy("component").agg(F.min_by("id", F.struct("degree", "id")).alias("id")).join(vectors, "id").select("id", "v"), "representatives")
    n = reps.count()
    if n < 2:
        return edges.select("src", "dst", "weight")
    pairs = knn_exact(reps, n - 1).where("src < dst").select("src", "dst", F.col("distance").alias("weight"))
    return edges.select("src", "dst", "weight").unionByName(minimum_forest(pairs))



def force_layout(
    edges: DataFrame, nodes: DataFrame, start: DataFrame, *, epochs: int = 100, negatives: int = 5, min_dist: float = 0.1, seed: int = 42, local_nodes: int = 50_000
) -> DataFrame:
    """``(id, y)``: fuzzy memberships drawn by attraction along edges and sampled repulsion, from ``start(id, y)``.

    It runs on the driver for up to ``local_nodes`` nodes; lay out landmarks and interpolate beyond.
    """
    rows = start.join(nodes.select("id"), "id", "left_semi").orderBy("id").limit(local_nodes + 1).collect()
    if len(rows) > local_nodes:
        raise ValueError(f"more than {local_nodes} nodes: lay out landmarks and interpolate")
    at = {r["id"]: i for i, r in enumerate(rows)}
    y = np.array([r["y"] for r in rows], dtype=float)
    if not len(y):
        return start.select("id", "y")
    y = 10 * (y - y.mean(0)) / max(np.abs(y - y.mean(0)).max(), 1e-12)
    e = edges.select("src", "dst", "weight").toPandas()
    a, b = e["src"].map(at).to_numpy(), e["dst"].map(at).to_numpy()
    p = (e["weight"] / max(e["weight"].max(), 1e-300)).to_numpy() if len(e) else np.zeros(0)
    rng = np.random.default_rng(seed)
    for t in range(epochs):
        rate = 0.1 * (1.0 - t / epochs)
        live = rng.random(len(p)) < p
        i, j = a[live], b[live]
        if not len(i):
            continue
        d = y[i] - y[j]
        sq = (d * d).sum(1, keepdims=True)
        pull = np.clip(-2 * d / (min_dist + sq) / (1 + sq), -4, 4) * rate
        np.add.at(y, i, pull)
        np.add.at(y, j, -pull)
        i = np.repeat(i, negatives)
        d = y[i] - y[rng.integers(0, len(y), len(i))]
        sq = (d * d).sum(1, keepdims=True)
        np.add.at(y, i, np.clip(2 * d / ((0.001 + sq) * (1 + sq)), -4, 4) * rate / negatives)
    ids = [r["id"] for r in rows]
    return nodes.sparkSession.createDataFrame([(i, [float(v) for v in r]) for i, r in zip(ids, y)], "id long, y array<double>")


def layouts(
    edges: DataFrame, nodes: DataFrame, *, k: int = 15, landmark_nodes: int = 5_000, n_landmarks: int = 1_000, interpolation: str = "laplacian_cg", epochs: int = 100, seed: int = 42
) -> tuple[DataFrame, DataFrame]:
    """A layout in two and one in three dimensions.

    Up to ``landmark_nodes`` nodes: a spectral start, drawn by forces on the fuzzy graph; the third
    dimension starts from the flat layout with a little noise. Beyond: landmarks and interpolation.
    """
    if nodes.count() > landmark_nodes:
        flat, deep = (landmark_layout(edges, nodes, n_landmarks, d, interpolation=interpolation, k=k) for d in (2, 3))
        return flat, deep
    fuzzy = materialize(fuzzy_union(edges, k), "fuzzy")
    flat = materialize(force_layout(fuzzy, nodes, spectral_layout(fuzzy, nodes, 2), epochs=epochs, seed=seed), "layout")
    noise = (F.pmod(F.xxhash64(F.lit(seed), "id"), F.lit(2001)) - 1000) / 1e6
    start = flat.select("id", F.concat("y", F.array(noise)).alias("y"))
    return flat, force_layout(fuzzy, nodes, start, epochs=epochs, seed=seed)
