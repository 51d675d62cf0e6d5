"""Shortest paths and the measures that rest on them."""

from __future__ import annotations

import heapq
from collections import defaultdict, deque

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import materialize
from .components import component_labels
from .graph import both_ways, degrees

LOCAL_EDGES = 500_000
Adjacency = dict[int, list[tuple[int, float]]]


def local_adjacency(edges: DataFrame, limit: int = LOCAL_EDGES) -> Adjacency | None:
    """Neighbour lists in id order, or None if there are more than ``limit`` edges."""
    t = edges.select("src", "dst", "weight").limit(limit + 1).toArrow()
    if t.num_rows > limit:
        return None
    adj: Adjacency = defaultdict(list)
    for s, d, w in zip(*(t.column(i).to_pylist() for i in range(3))):
        adj[s].append((d, w))
        adj[d].append((s, w))
    return {i: sorted(v) for i, v in adj.items()}


def dijkstra(adj: Adjacency, source: int) -> tuple[dict[int, float], dict[int, int], list[int]]:
    """Distances, predecessors (the least of equals), and nodes in the order they are settled."""
    dist, prev, order, heap = {source: 0.0}, {}, [], [(0.0, source)]
    done: set[int] = set()
    while heap:
        d, i = heapq.heappop(heap)
        if i in done:
            continue
        done.add(i)
        order.append(i)
        for j, w in adj.get(i, ()):
            n = d + w
            if j not in done and (j not in dist or n < dist[j] or (n == dist[j] and i < prev[j])):
                dist[j], prev[j] = n, i
                heapq.heappush(heap, (n, j))
    return dist, prev, order


def _relax(edges: DataFrame, start: DataFrame, max_rounds: int) -> DataFrame:
    """``(source, id, dist, prev)`` by rounds of relaxation from ``start``; only improved rows go on."""
    arms = materialize(both_ways(edges.select("src", "dst", "weight")), "arms")
    best = materialize(start, "distances")
    front = best
    for _ in range(max_rounds):
        step = front.join(arms, front["id"] == arms["src"]).select("source", F.col("dst").alias("id"), (F.col("dist") + F.col("weight")).alias("dist"), F.col("src").alias("prev"))
        tried = step.groupBy("source", "id").agg(F.min(F.struct("dist", "prev")).alias("k")).select("source", "id", "k.dist", "k.prev")
        old = best.select("source", "id", F.col("dist").alias("od"))
        front = materialize(tried.join(old, ["source", "id"], "left").where("od is null or dist < od").drop("od"), "front")
        if not front.take(1):
            return best
        best = materialize(best.join(front.select("source", "id"), ["source", "id"], "left_anti").unionByName(front), "distances")
    raise RuntimeError(f"distances did not settle in {max_rounds} rounds")


def distances(edges: DataFrame, sources: DataFrame, *, local_edges: int = LOCAL_EDGES, max_rounds: int = 10_000) -> DataFrame:
    """``(source, id, dist, prev)`` for each of ``sources(id)`` and every node it reaches, itself at 0.

    A graph of up to ``local_edges`` edges is shipped to the tasks that run one search a source; a
    larger one is relaxed by DataFrame rounds.
    """
    adj = local_adjacency(edges, local_edges)
    if adj is None:
        start = sources.select(F.col("id").alias("source"), "id", F.lit(0.0).alias("dist"), F.lit(None).cast("long").alias("prev"))
        return _relax(edges, start, max_rounds)
    shared = sources.sparkSession.sparkContext.broadcast(adj)

    def run(batches):
        for b in batches:
            for s in b.column(0).to_pylist():
                dist, prev, order = dijkstra(shared.value, s)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([s] * len(order), pa.int64()), pa.array(order, pa.int64()), pa.array([dist[i] for i in order], pa.float64()), pa.array([prev.get(i) for i in order], pa.int64())],
                    names=["source", "id", "dist", "prev"],
                )

    return sources.select("id").repartition(TASKS, "id").mapInArrow(run, "source long, id long, dist double, prev long")


def shortest_paths(edges: DataFrame, nodes: DataFrame, source: int, targets: list[int] | None = None, **options) -> DataFrame:
    """``(target, distance, path)`` from one node: to all others, or to ``targets``. Unreachable: infinite, null path."""
    if not nodes.where(F.col("id") == source).take(1):
        raise ValueError(f"no node {source}")
    spark = nodes.sparkSession
    found = materialize(distances(edges, spark.createDataFrame([(source,)], "id long"), **options), "paths")
    want = nodes.select(F.col("id").alias("target"))
    want = want.where(F.col("target") != source) if targets is None else want.where(F.col("target").isin(list(targets)))
    trail = want.join(found.select(F.col("id").alias("target"), "dist", "prev"), "target", "left")
    cur = trail.select("target", "dist", F.when(F.col("dist").isNotNull(), F.array("target")).alias("path"), F.col("prev").alias("at"))
    step = found.select(F.col("id").alias("at"), F.col("prev").alias("up"))
    while True:  # one round a hop
        cur = materialize(cur.join(step, "at", "left").select("target", "dist", F.when(F.col("at").isNotNull(), F.concat(F.array("at"), "path")).otherwise(F.col("path")).alias("path"), F.col("up").alias("at")), "paths")
        if not cur.where("at is not null").take(1):
            break
    return cur.select("target", F.coalesce("dist", F.lit(float("inf"))).alias("distance"), "path")


class Arms:
    """A graph in arrays: both directions of every edge, sorted by target, for searches from many sources at once."""

    def __init__(self, src: np.ndarray, dst: np.ndarray, weight: np.ndarray):
        self.ids, at = np.unique(np.concatenate([src, dst]), return_inverse=True)
        a, b = np.concatenate([at[: len(src)], at[len(src) :]]), np.concatenate([at[len(src) :], at[: len(src)]])
        order = np.lexsort((a, b))
        self.a, self.b, self.w = a[order].astype(np.int32), b[order].astype(np.int32), np.concatenate([weight, weight])[order]
        self.start = np.searchsorted(self.b, np.arange(len(self.ids)))

    def places(self, ids: np.ndarray) -> np.ndarray:
        """Places of ``ids``; -1 for nodes without edges."""
        if not len(self.ids):
            return np.full(len(ids), -1)
        at = np.minimum(np.searchsorted(self.ids, ids), len(self.ids) - 1)
        return np.where(self.ids[at] == ids, at, -1)

    def distances(self, sources: np.ndarray) -> np.ndarray:
        """Node by source: the fixpoint of relaxation, which is what Dijkstra's search gives to the last bit."""
        dist = np.full((len(self.ids), len(sources)), np.inf)
        dist[sources, np.arange(len(sources))] = 0.0
        while True:
            new = np.minimum(dist, np.minimum.reduceat(dist[self.a] + self.w[:, None], self.start, axis=0))
            if np.array_equal(new, dist):
                return dist
            dist = new

    def last_arms(self, dist: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """``(arm, source)`` of all arms that end shortest paths, nearest targets' first within each source."""
        before, after = dist[self.a], dist[self.b]
        arm, col = np.nonzero((before + self.w[:, None] == after) & (before < after))
        order = np.lexsort((self.a[arm], self.b[arm], after[arm, col], col))
        return arm[order], col[order]


def _steps(up: np.ndarray, down: np.ndarray, size: int) -> np.ndarray:
    """For each link ``up -> down`` the number of links of the longest way to ``down``; links come in an order of ways."""
    depth = np.zeros(size, np.int32)
    while True:
        new = np.zeros(size, np.int32)
        np.maximum.at(new, down, depth[up] + 1)
        if np.array_equal(new, depth):
            return depth[down]
        depth = new


def _levels(level: np.ndarray):
    order = np.argsort(level, kind="stable")
    return np.split(order, np.flatnonzero(np.diff(level[order])) + 1) if len(order) else []


def _many(rows: int) -> int:
    return max(1, min(64, (1 << 21) // max(rows, 1)))  # sources searched at once


TASKS = 192  # AQE would merge a few kilobytes of sources into one task


def local_arms(edges: DataFrame, limit: int) -> Arms | None:
    """The graph in arrays, or None if it has more than ``limit`` edges, or lengths that vanish beside others."""
    t = edges.select("src", "dst", F.col("weight").cast("double").alias("weight")).limit(limit + 1).toArrow()
    w = t.column("weight").to_numpy()
    if t.num_rows > limit or (len(w) and w.min() <= 4.5e-16 * w.sum()):
        return None
    return Arms(t.column("src").to_numpy(), t.column("dst").to_numpy(), w)


def _search(sources: DataFrame, arms: Arms, fn, schema: str) -> DataFrame:
    """``fn(arms, places, ids)`` for groups of sources; it yields or gathers record batches."""
    shared = sources.sparkSession.sparkContext.broadcast(arms)

    def run(batches):
        g = shared.value
        ids = np.concatenate([b.column(0).to_numpy() for b in batches] or [np.zeros(0, np.int64)])
        yield from fn(g, ids)

    return sources.select(F.col("id").cast("long").alias("id")).repartition(TASKS, "id").mapInArrow(run, schema)


def reaches(edges: DataFrame, nodes: DataFrame, *, local_edges: int = LOCAL_EDGES, **options) -> DataFrame:
    """``(id, total, farthest)``: sum and maximum of each node's distances to those it reaches; one row a node leaves a task."""
    arms = local_arms(edges, local_edges)
    if arms is None:
        d = distances(edges, nodes, local_edges=local_edges, **options)
        return d.groupBy(F.col("source").alias("id")).agg(F.sum("dist").alias("total"), F.max("dist").alias("farthest"))

    def run(g, ids):
        step = _many(len(g.a))
        for p in range(0, len(ids), step):
            some = ids[p : p + step]
            at = g.places(some)
            total, far = np.zeros(len(some)), np.zeros(len(some))
            if (at >= 0).any():
                dist = g.distances(at[at >= 0])
                dist[np.isinf(dist)] = 0.0
                total[at >= 0], far[at >= 0] = dist.sum(0), dist.max(0)
            yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(total), pa.array(far)], names=["id", "total", "farthest"])

    return _search(nodes, arms, run, "id long, total double, farthest double")


def closeness(edges: DataFrame, nodes: DataFrame, normalized: bool = True, **options) -> DataFrame:
    """``(id, centrality)``: (n - 1) over the summed distances to reachable nodes, by the largest; 0 without any."""
    n = nodes.count()
    d = reaches(edges, nodes, **options).select("id", F.col("total").alias("s"))
    c = nodes.select("id").join(d, "id", "left").select("id", F.when(F.col("s") > 0, (n - 1) / F.col("s")).otherwise(0.0).alias("centrality"))
    if not normalized:
        return c
    top = F.broadcast(c.agg(F.max("centrality").alias("__m")))
    return c.crossJoin(top).select("id", F.when(F.col("__m") > 0, F.col("centrality") / F.col("__m")).otherwise(0.0).alias("centrality"))  # one row


def degree_centrality(edges: DataFrame, nodes: DataFrame, normalized: bool = True) -> DataFrame:
    """``(id, centrality)``: the degree, over n - 1."""
    n = nodes.count()
    scale = 1 / (n - 1) if normalized and n > 1 else 1.0
    return degrees(edges, nodes).select("id", (F.col("degree") * scale).alias("centrality"))


def brandes(adj: Adjacency, source: int) -> dict[int, float]:
    """Dependencies of one source on every other node."""
    dist, sigma, preds, order = {source: 0.0}, defaultdict(float), defaultdict(list), []
    sigma[source] = 1.0
    heap, done = [(0.0, source)], set()
    while heap:
        d, i = heapq.heappop(heap)
        if i in done:
            continue
        done.add(i)
        order.append(i)
        for j, w in adj.get(i, ()):
            n = d + w
            if j in done:
                continue
            if j not in dist or n < dist[j]:
                dist[j], sigma[j], preds[j] = n, sigma[i], [i]
                heapq.heappush(heap, (n, j))
            elif n == dist[j]:
                sigma[j] += sigma[i]
                preds[j].append(i)
    delta: dict[int, float] = defaultdict(float)
    for j in reversed(order):
        for i in preds[j]:
            delta[i] += sigma[i] / sigma[j] * (1 + delta[j])
    delta.pop(source, None)
    return delta


def _sources(nodes: DataFrame, sample: int | None, seed: int) -> tuple[DataFrame, float]:
    n = nodes.count()
    if sample is None or sample >= n:
        return nodes.select("id"), 1.0
    return nodes.select("id").orderBy(F.xxhash64(F.lit(seed), "id"), "id").limit(sample), n / sample


def _shipped(edges: DataFrame, limit: int) -> Arms:
    arms = local_arms(edges, limit)
    if arms is None:
        raise ValueError(f"betweenness ships the graph to every task and takes {limit} edges at most, none so short that a sum of lengths loses it; sparsify it, or raise local_edges")
    return arms


def betweenness(edges: DataFrame, nodes: DataFrame, *, normalized: bool = True, sample: int | None = None, seed: int = 42, local_edges: int = LOCAL_EDGES) -> DataFrame:
    """``(id, centrality)``: shortest paths through a node, of all sources or a hashed sample scaled up."""
    arms = _shipped(edges, local_edges)
    src, scale = _sources(nodes, sample, seed)
    n = nodes.count()

    def run(g, ids):
        size, total = len(g.ids), np.zeros(len(g.ids))
        at = g.places(ids)
        at, step = at[at >= 0], _many(len(g.a))
        for p in range(0, len(at), step):
            some = at[p : p + step]
            arm, col = g.last_arms(g.distances(some))
            up, down = col * size + g.a[arm], col * size + g.b[arm]
            order = _levels(_steps(up, down, size * len(some)))
            sigma, delta = np.zeros(size * len(some)), np.zeros(size * len(some))
            sigma[np.arange(len(some)) * size + some] = 1.0
            for x in order:
                np.add.at(sigma, down[x], sigma[up[x]])
            for x in reversed(order):
                np.add.at(delta, up[x], sigma[up[x]] / sigma[down[x]] * (1 + delta[down[x]]))
            delta[np.arange(len(some)) * size + some] = 0.0
            total += delta.reshape(len(some), size).sum(0)
        used = total > 0
        yield pa.RecordBatch.from_arrays([pa.array(g.ids[used]), pa.array(total[used])], names=["id", "v"])

    sums = _search(src, arms, run, "id long, v double").groupBy("id").agg(F.sum("v").alias("v"))
    factor = scale / 2 / ((n - 1) * (n - 2) / 2 if normalized and n > 2 else 1.0)
    return nodes.select("id").join(sums, "id", "left").select("id", (F.coalesce("v", F.lit(0.0)) * factor).alias("centrality"))


def edge_betweenness(edges: DataFrame, nodes: DataFrame, *, normalized: bool = True, sample: int | None = None, seed: int = 42, local_edges: int = LOCAL_EDGES) -> DataFrame:
    """``(src, dst, centrality)``: how many paths of the sources' shortest-path trees use an edge, both directions counted."""
    arms = _shipped(edges, local_edges)
    src, scale = _sources(nodes, sample, seed)
    n = nodes.count()

    def run(g, ids):
        size, total = len(g.ids), np.zeros(len(g.a))
        at = g.places(ids)
        at, step = at[at >= 0], _many(len(g.a))
        for p in range(0, len(at), step):
            some = at[p : p + step]
            arm, col = g.last_arms(g.distances(some))
            first = np.append(True, (g.b[arm][1:] != g.b[arm][:-1]) | (col[1:] != col[:-1])) if len(arm) else np.zeros(0, bool)
            arm, col = arm[first], col[first]  # the least of equal predecessors
            up, down = col * size + g.a[arm], col * size + g.b[arm]
            below = np.zeros(size * len(some))
            for x in reversed(_levels(_steps(up, down, size * len(some)))):
                below[down[x]] += 1
                np.add.at(below, up[x], below[down[x]])
                total += np.bincount(arm[x], below[down[x]], len(total))
        used = total > 0
        a, b = g.ids[g.a[used]], g.ids[g.b[used]]
        yield pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b)), pa.array(total[used])], names=["src", "dst", "v"])

    sums = _search(src, arms, run, "src long, dst long, v double").groupBy("src", "dst").agg(F.sum("v").alias("v"))
    factor = scale / (n * (n - 1) / 2 if normalized and n > 1 else 1.0)
    return edges.select("src", "dst").join(sums, ["src", "dst"], "left").select("src", "dst", (F.coalesce("v", F.lit(0.0)) * factor).alias("centrality"))


def centrality(edges: DataFrame, nodes: DataFrame, measure: str = "degree", normalized: bool = True, **options) -> DataFrame:
    """``(id, centrality)`` by name."""
    known = {"degree": degree_centrality, "closeness": closeness, "betweenness": betweenness}
    if measure not in known:
        raise ValueError(f"unknown measure {measure!r}")
    return known[measure](edges, nodes, normalized=normalized, **options)


def central_nodes(edges: DataFrame, nodes: DataFrame, k: int = 10, measure: str = "degree", **options) -> DataFrame:
    """The ``k`` most central nodes; ties by id."""
    return centrality(edges, nodes, measure, **options).orderBy(F.desc("centrality"), "id").limit(k)


def diameters(edges: DataFrame, nodes: DataFrame, **options) -> DataFrame:
    """``(component, size, diameter)``: the largest finite distance inside each component."""
    labels = materialize(component_labels(nodes, edges), "labels")
    far = reaches(edges, nodes, **options).select("id", F.col("farthest").alias("far"))
    return labels.join(far, "id", "left").groupBy("component").agg(F.count(F.lit(1)).alias("size"), F.coalesce(F.max("far"), F.lit(0.0)).alias("diameter"))


def component_statistics(edges: DataFrame, nodes: DataFrame, **options) -> DataFrame:
    """Size, diameter and degree statistics of every component."""
    return diameters(edges, nodes, **options).join(component_degrees(edges, nodes), "component")


def component_degrees(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Degree statistics of every component, without any search."""
    labels = component_labels(nodes, edges)
    return degrees(edges, nodes).join(labels, "id").groupBy("component").agg(
        F.min("degree").alias("min_degree"), F.max("degree").alias("max_degree"), F.avg("degree").alias("mean_degree"),
        F.median("degree").alias("median_degree"), F.stddev_pop("degree").alias("std_degree"),
    )


def low_links(adj: dict[int, list[int]]) -> tuple[list[tuple[int, int, int, int]], dict[int, int]]:
    """Bridges ``(a, b, nodes on one side, nodes on the other)``, and for each cut vertex how many pieces more it leaves.

    An iterative depth-first search with low-link values.
    """
    seen: dict[int, int] = {}
    low: dict[int, int] = {}
    size: dict[int, int] = {}
    bridges: list[tuple[int, int, int, int]] = []
    cuts: dict[int, int] = defaultdict(int)
    for root in sorted(adj):
        if root in seen:
            continue
        base, children, found = len(seen), 0, []
        seen[root] = low[root] = base
        size[root] = 1
        stack = [(root, -1, iter(adj[root]))]
        while stack:
            i, up, it = stack[-1]
            for j in it:
                if j == up:
                    continue
                if j in seen:
                    low[i] = min(low[i], seen[j])
                    continue
                seen[j] = low[j] = len(seen)
                size[j] = 1
                stack.append((j, i, iter(adj[j])))
                break
            else:
                stack.pop()
                if up < 0 and not stack:
                    continue
                p = stack[-1][0]
                size[p] += size[i]
                low[p] = min(low[p], low[i])
                if low[i] > seen[p]:
                    found.append((p, i, size[i]))
                if p == root:
                    children += 1
                elif low[i] >= seen[p]:
                    cuts[p] += 1
        bridges += [(min(a, b), max(a, b), n, size[root] - n) for a, b, n in found]
        if children > 1:
            cuts[root] = children - 1
    return bridges, dict(cuts)


def _by_component(edges: DataFrame, nodes: DataFrame, fn, schema: str) -> DataFrame:
    """``fn(adjacency) -> dict of columns``, run in one task for each component."""
    labels = component_labels(nodes, edges)
    grouped = edges.select("src", "dst").join(labels.withColumnRenamed("id", "src"), "src")

    def run(table):
        adj: dict[int, list[int]] = defaultdict(list)
        for a, b in zip(table.column("src").to_pylist(), table.column("dst").to_pylist()):
            adj[a].append(b)
            adj[b].append(a)
        return pa.table(fn(adj))

    return grouped.groupBy("component").applyInArrow(run, schema)


def structural_bridges(edges: DataFrame, nodes: DataFrame, k: int | None = None) -> DataFrame:
    """``(src, dst, importance, side)``: edges whose removal splits a component; ``side`` is the smaller part's size.

    Every bridge adds one component, which is its importance; larger ``side`` first, then by pair.
    """

    def fn(adj):
        rows = [(a, b, 1, min(n, m)) for a, b, n, m in low_links(adj)[0]]
        cols = list(zip(*rows)) or [()] * 4
        return {c: pa.array(v, pa.int64()) for c, v in zip(("src", "dst", "importance", "side"), cols)}

    out = _by_component(edges, nodes, fn, "src long, dst long, importance long, side long")
    return out if k is None else out.orderBy(F.desc("side"), "src", "dst").limit(k)


def articulation_points(edges: DataFrame, nodes: DataFrame, k: int | None = None) -> DataFrame:
    """``(id, importance)``: nodes whose removal splits a component, and how many components that adds."""

    def fn(adj):
        cuts = low_links(adj)[1]
        return {"id": pa.array(list(cuts), pa.int64()), "importance": pa.array(list(cuts.values()), pa.int64())}

    out = _by_component(edges, nodes, fn, "id long, importance long")
    return out if k is None else out.orderBy(F.desc("importance"), "id").limit(k)


def tree_diameter(forest: DataFrame, local_edges: int = LOCAL_EDGES) -> float:
    """Longest path of a forest: two searches a tree."""
    adj = local_adjacency(forest, local_edges)
    if adj is None:
        raise ValueError(f"the forest has over {local_edges} edges")
    best, seen = 0.0, set()
    for i in adj:
        if i in seen:
            continue
        dist = _walk(adj, i)
        seen.update(dist)
        best = max(best, max(_walk(adj, max(dist, key=dist.get)).values()))
    return best


def _walk(adj: Adjacency, source: int) -> dict[int, float]:
    dist, queue = {source: 0.0}, deque([source])
    while queue:
        i = queue.popleft()
        for j, w in adj[i]:
            if j not in dist:
                dist[j] = dist[i] + w
                queue.append(j)
    return dist


