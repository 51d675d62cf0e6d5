"""The graph: a node table and a canonical edge table, with lookups."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.vectors import Premetric, premetric, with_features
from .components import component_labels


def canonical(edges: DataFrame, keep: str = "max") -> DataFrame:
    """``(src, dst, weight)`` with src < dst, one row a pair; of repeated pairs the max, min or sum of weights."""
    agg = {"max": F.max, "min": F.min, "sum": F.sum}.get(keep)
    if agg is None:
        raise ValueError(f"unknown way to merge pairs: {keep!r}")
    return (
        edges.where("src != dst")
        .groupBy(F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst"))
        .agg(agg("weight").alias("weight"))
    )


def both_ways(edges: DataFrame) -> DataFrame:
    """Every edge in both directions, other columns kept."""
    rest = [c for c in edges.columns if c not in ("src", "dst")]
    ends = F.explode(F.array(F.struct(F.col("src").alias("a"), F.col("dst").alias("b")), F.struct(F.col("dst").alias("a"), F.col("src").alias("b"))))
    return edges.select(ends.alias("e"), *rest).select(F.col("e.a").alias("src"), F.col("e.b").alias("dst"), *rest)


def degrees(edges: DataFrame, nodes: DataFrame | None = None) -> DataFrame:
    """``(id, degree)``; nodes without edges have 0 if the node table is given."""
    d = both_ways(edges.select("src", "dst")).groupBy(F.col("src").alias("id")).agg(F.count(F.lit(1)).alias("degree"))
    if nodes is None:
        return d
    return nodes.select("id").join(d, "id", "left").select("id", F.coalesce("degree", F.lit(0)).alias("degree"))


def induced(edges: DataFrame, ids: DataFrame) -> DataFrame:
    """Edges with both ends among ``ids(id)``."""
    keep = ids.select("id").distinct()
    return edges.join(keep.withColumnRenamed("id", "src"), "src", "left_semi").join(keep.withColumnRenamed("id", "dst"), "dst", "left_semi").select(edges.columns)


def pairs_present(pairs: DataFrame, edges: DataFrame) -> DataFrame:
    """``pairs(src, dst)`` with ``present`` and the stored ``weight``, 0 where there is none."""
    e = edges.select("src", "dst", F.col("weight").alias("__w"))
    return pairs.join(e, ["src", "dst"], "left").select(
        *pairs.columns, F.col("__w").isNotNull().alias("present"), F.coalesce("__w", F.lit(0.0)).alias("weight")
    )


@dataclass
class ProximityGraph:
    """Nodes ``(id, ...)`` and undirected edges ``(src < dst, weight, ...)``; both are lazy DataFrames."""

    nodes: DataFrame
    edges: DataFrame
    feature_cols: list[str] | None = None
    distance: str | Premetric = "euclidean"
    self_weight: float = 0.0
    missing_weight: float = float("inf")
    extras: dict = field(default_factory=dict)
    _labels: DataFrame | None = None

    def __post_init__(self):
        if self.edges is None:
            raise ValueError("a graph needs an edge table")

    def node(self, i: int) -> DataFrame:
        out = self.nodes.where(F.col("id") == i)
        if out.isEmpty():
            raise ValueError(f"no node {i}")
        return out

    def nodes_of(self, ids: list[int]) -> DataFrame:
        return self.nodes.where(F.col("id").isin(list(ids)))

    @property
    def components(self) -> DataFrame:
        """``(id, component)``: 0, 1, ... in the order of least members."""
        if self._labels is None:
            self._labels = component_labels(self.nodes, self.edges)
        return self._labels

    def component_sizes(self) -> DataFrame:
        return self.components.groupBy("component").agg(F.count(F.lit(1)).alias("size"))

    def component(self, c: int) -> DataFrame:
        out = self.components.where(F.col("component") == c).select("id")
        if out.isEmpty():
            raise ValueError(f"no component {c}")
        return out

    def component_data(self, c: int) -> DataFrame:
        """The nodes of one component; none if there are fewer components."""
        return self.nodes.join(self.components.where(F.col("component") == c), "id", "left_semi")

    def adjacency(self) -> DataFrame:
        return both_ways(self.edges)

    def neighbors(self, i: int) -> DataFrame:
        """``(id, weight)`` of the neighbours of one node; both ends are filtered at the scan, no shuffle."""
        e = self.edges
        out = e.where(F.col("src") == i).select(F.col("dst").alias("id"), "weight")
        return out.unionByName(e.where(F.col("dst") == i).select(F.col("src").alias("id"), "weight"))

    def edge_weights(self, pairs: DataFrame) -> DataFrame:
        """Weights of ``pairs(src, dst)``: the self weight on the diagonal, the missing weight without an edge."""
        key = pairs.withColumns({"a": F.least("src", "dst"), "b": F.greatest("src", "dst")})
        e = self.edges.select(F.col("src").alias("a"), F.col("dst").alias("b"), F.col("weight").alias("__w"))
        w = F.when(F.col("src") == F.col("dst"), F.lit(self.self_weight)).otherwise(F.coalesce("__w", F.lit(self.missing_weight)))
        return key.join(e, ["a", "b"], "left").select("src", "dst", w.alias("weight"))

    def edge_list(self) -> DataFrame:
        return self.edges.where("src < dst")

    def features(self) -> DataFrame:
        if "features" in self.nodes.columns and self.feature_cols is None:
            return self.nodes.select("id", "features")
        return with_features(self.nodes, "id", self.feature_cols)

    def graph_distance(self, i: int, j: int) -> DataFrame:
        """The premetric of one pair, as one row."""
        f = self.features()
        a = f.where(F.col("id") == i).select(F.col("features").alias("fa"))
        b = f.where(F.col("id") == j).select(F.col("features").alias("fb"))
        return a.crossJoin(b).select(premetric(self.distance)(F.col("fa"), F.col("fb")).alias("distance"))  # one row each

    def subgraph(self, ids: DataFrame) -> ProximityGraph:
        return ProximityGraph(self.nodes.join(ids.select("id").distinct(), "id", "left_semi"), induced(self.edges, ids), self.feature_cols, self.distance, self.self_weight, self.missing_weight)

    def degrees(self) -> DataFrame:
        return degrees(self.edges, self.nodes)

    def shortest_path(self, source: int, target: int) -> DataFrame:
        """One row: distance and path; infinite and null if the nodes are in different components."""
        from .paths import shortest_paths

        return shortest_paths(self.edges, self.nodes, source, [target]).select("distance", "path")

    def is_connected(self) -> bool:
        return self.components.select("component").distinct().count() <= 1

    def summary(self) -> DataFrame:
        """One row: nodes, edges, components."""
        n = self.nodes.agg(F.count(F.lit(1)).alias("n_nodes"))
        e = self.edges.agg(F.count(F.lit(1)).alias("n_edges"))
        c = self.components.agg(F.count_distinct("component").alias("n_components"))
        return n.crossJoin(e).crossJoin(c)  # one row each
