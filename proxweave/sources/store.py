"""Graphs, runs and edge lists on storage."""

from __future__ import annotations

import io
import json
import math
from xml.sax.saxutils import escape

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.graph import ProximityGraph

FORMATS = ("edgelist", "csv", "gexf", "graphml")


def _number(x: float) -> float | str:
    return ("inf" if x > 0 else "-inf") if math.isinf(x) else x


def _write_text(spark: SparkSession, path: str, text: str) -> None:
    """One small file through Hadoop's file system, so that any store works."""
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    out = target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).create(target, True)
    out.write(bytearray(text.encode()))
    out.close()


def _read_text(spark: SparkSession, path: str) -> str:
    return "\n".join(r["value"] for r in spark.read.text(path).collect())


def save_graph(graph: ProximityGraph, path: str, *, layout: DataFrame | None = None, layout_params: dict | None = None, distance_name: str | None = None) -> None:
    """Write nodes, edges, component labels and an optional layout as Parquet, and the rest as JSON."""
    spark = graph.edges.sparkSession
    labels = graph.components
    graph.nodes.write.mode("overwrite").parquet(f"{path}/nodes")
    graph.edges.write.mode("overwrite").parquet(f"{path}/edges")
    labels.write.mode("overwrite").parquet(f"{path}/components")
    if layout is not None:
        layout.write.mode("overwrite").parquet(f"{path}/layout")
    name = distance_name or (graph.distance if isinstance(graph.distance, str) else None)
    meta = {
        "feature_cols": graph.feature_cols,
        "n_nodes": graph.nodes.count(),
        "n_components": labels.select("component").distinct().count(),
        "self_weight": _number(graph.self_weight),
        "missing_weight": _number(graph.missing_weight),
        "distance": name,
        "has_layout": layout is not None,
        "layout_params": layout_params,
    }
    _write_text(spark, f"{path}/metadata.json", json.dumps(meta))


def load_graph(spark: SparkSession, path: str, full: bool = True) -> ProximityGraph:
    """The inverse; lazy. An unknown distance falls back to Euclidean. ``full`` also offers the layout in ``extras``."""
    meta = json.loads(_read_text(spark, f"{path}/metadata.json"))
    extras = {"metadata": meta}
    if full and meta["has_layout"]:
        extras["layout"] = spark.read.parquet(f"{path}/layout")
    return ProximityGraph(
        spark.read.parquet(f"{path}/nodes"),
        spark.read.parquet(f"{path}/edges"),
        meta["feature_cols"],
        meta["distance"] or "euclidean",
        float(meta["self_weight"]),
        float(meta["missing_weight"]),
        extras,
        spark.read.parquet(f"{path}/components"),
    )


def save_run(path: str, run_name: str, resolution: float, edges: DataFrame, stats: DataFrame | None = None, labels: DataFrame | None = None) -> None:
    """Interface edges, labels and cluster statistics of one run, in partition folders by name and resolution."""
    part = f"run_name={run_name}/resolution={resolution}"
    edges.write.mode("overwrite").parquet(f"{path}/interface/{part}")
    if labels is not None:
        labels.write.mode("overwrite").parquet(f"{path}/labels/{part}")
    if stats is not None:
        stats.write.mode("overwrite").parquet(f"{path}/stats/{part}")
        stats.write.mode("overwrite").option("header", True).csv(f"{path}/stats_csv/{part}")


def load_runs(spark: SparkSession, path: str, kind: str = "interface", run_name: str | None = None, resolution: float | None = None) -> DataFrame:
    """``interface``, ``labels`` or ``stats`` of all runs, or of one name or resolution: partitions are pruned."""
    if kind not in ("interface", "labels", "stats"):
        raise ValueError(f"unknown kind {kind!r}")
    df = spark.read.option("basePath", f"{path}/{kind}").parquet(f"{path}/{kind}")
    if run_name is not None:
        df = df.where(F.col("run_name") == run_name)
    if resolution is not None:
        df = df.where(F.col("resolution") == float(resolution))
    return df


def read_layout(spark: SparkSession, path: str) -> DataFrame:
    """``(id, y)`` from a CSV with a header (id first, coordinates after), a Parquet table of ``id, y``, or an array file.

    The rows of a ``.npy`` matrix are numbered from 0; one file is read by one task.
    """
    if path.endswith(".npy"):

        def rows(batches):
            for b in batches:
                for content in b.column(0):
                    m = np.load(io.BytesIO(content.as_py()), allow_pickle=False).astype(np.float64)
                    for i in range(0, len(m), 8192):
                        part = m[i : i + 8192]
                        y = pa.ListArray.from_arrays(np.arange(len(part) + 1, dtype=np.int32) * m.shape[1], pa.array(part.ravel()))
                        yield pa.RecordBatch.from_arrays([pa.array(np.arange(i, i + len(part))), y], names=["id", "y"])

        return spark.read.format("binaryFile").load(path).select("content").mapInArrow(rows, "id long, y array<double>")
    if path.endswith(".csv"):
        df = spark.read.option("header", True).csv(path)
        return df.select(F.col(df.columns[0]).cast("long").alias("id"), F.array(*[F.col(c).cast("double") for c in df.columns[1:]]).alias("y"))
    if path.endswith(".parquet"):
        return spark.read.parquet(path).select("id", "y")
    raise ValueError(f"unknown layout file {path!r}")


def _attributes(edges: DataFrame) -> list[str]:
    return [c for c in edges.columns if c not in ("src", "dst")]


def export_edges(edges: DataFrame, path: str, fmt: str = "edgelist") -> None:
    """Write ``(src, dst, ...)`` as text lines, CSV, GEXF or GraphML.

    Lines and XML elements are made row by row on the executors; XML parts are numbered so that,
    read in order of name, they are one document.
    """
    if fmt not in FORMATS:
        raise ValueError(f"unknown format {fmt!r}")
    attrs = _attributes(edges)
    if fmt == "csv":
        edges.write.mode("overwrite").option("header", True).csv(path)
        return
    if fmt == "edgelist":
        edges.select(F.concat_ws(" ", *[F.col(c).cast("string") for c in ("src", "dst", *attrs)]).alias("value")).write.mode("overwrite").text(path)
        return
    rows = xml_lines(edges, fmt)
    head, mid, foot = xml_frame(attrs, fmt)
    spark = edges.sparkSession
    lines = spark.createDataFrame([(0, head), (2, mid), (4, foot)], "part int, value string").unionByName(rows)
    lines.repartitionByRange(F.col("part"), F.col("value")).sortWithinPartitions("part", "value").select("value").write.mode("overwrite").text(path)


def xml_frame(attrs: list[str], fmt: str) -> tuple[str, str, str]:
    """What stands before the nodes, between nodes and edges, and after them."""
    if fmt == "gexf":
        keys = "".join(f'<attribute id="{escape(a)}" title="{escape(a)}" type="string"/>' for a in attrs)
        head = '<?xml version="1.0" encoding="UTF-8"?><gexf xmlns="http://gexf.net/1.3" version="1.3"><graph defaultedgetype="undirected">'
        return f'{head}<attributes class="edge">{keys}</attributes><nodes>', "</nodes><edges>", "</edges></graph></gexf>"
    keys = "".join(f'<key id="{escape(a)}" for="edge" attr.name="{escape(a)}" attr.type="string"/>' for a in attrs)
    head = '<?xml version="1.0" encoding="UTF-8"?><graphml xmlns="http://graphml.graphdrawing.org/xmlns">'
    return f'{head}{keys}<graph edgedefault="undirected">', "<!-- edges -->", "</graph></graphml>"


def xml_lines(edges: DataFrame, fmt: str) -> DataFrame:
    """``(part, value)``: an element for each node (part 1) and edge (part 3)."""
    safe = lambda c: F.replace(F.replace(F.replace(F.col(c).cast("string"), F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit('"'), F.lit("&quot;"))
    attrs = _attributes(edges)
    value = lambda a: F.coalesce(safe(a), F.lit(""))
    if fmt == "gexf":
        inner = [F.concat(F.lit(f'<attvalue for="{a}" value="'), value(a), F.lit('"/>')) for a in attrs]
        open_, close = "<attvalues>", "</attvalues></edge>"
    else:
        inner = [F.concat(F.lit(f'<data key="{a}">'), value(a), F.lit("</data>")) for a in attrs]
        open_, close = "", "</edge>"
    nodes = edges.select(F.explode(F.array("src", "dst")).alias("id")).distinct()
    edge = F.concat(F.lit('<edge source="'), F.col("src").cast("string"), F.lit('" target="'), F.col("dst").cast("string"), F.lit('">' + open_), *inner, F.lit(close))
    return nodes.select(F.lit(1).alias("part"), F.concat(F.lit('<node id="'), F.col("id").cast("string"), F.lit('"/>')).alias("value")).unionByName(edges.select(F.lit(3).alias("part"), edge.alias("value")))


def with_run_columns(nodes: DataFrame, run: DataFrame) -> DataFrame:
    """``nodes`` with the columns of ``run`` that it lacks, joined by id."""
    new = [c for c in run.columns if c not in nodes.columns]
    return nodes.join(run.select("id", *new), "id", "left")


class GraphLoader:
    """Lazy tables of a saved graph: nothing is read before it is used."""

    def __init__(self, spark: SparkSession, path: str):
        self.graph = load_graph(spark, path)

    @property
    def nodes(self) -> DataFrame:
        return self.graph.nodes

    @property
    def edge_arrays(self) -> DataFrame:
        """Every edge in both directions."""
        return self.graph.adjacency()

    @property
    def labels(self) -> DataFrame:
        """``(id, label)``: the ``cluster`` column if there is one, else 0."""
        c = F.col("cluster") if "cluster" in self.nodes.columns else F.lit(0)
        return self.nodes.select("id", c.cast("int").alias("label"))

    def wrapper(self, include_layout: bool = True) -> ProximityGraph:
        """The graph with layout columns on its nodes."""
        from ..operators.layout import with_layout

        g = self.graph
        if include_layout and "layout" in g.extras:
            return ProximityGraph(with_layout(g.nodes, g.extras["layout"]), g.edge_list(), g.feature_cols, g.distance, g.self_weight, g.missing_weight, g.extras, g._labels)
        return g


__all__ = ["GraphLoader", "export_edges", "load_graph", "load_runs", "read_layout", "save_graph", "save_run", "with_run_columns"]
