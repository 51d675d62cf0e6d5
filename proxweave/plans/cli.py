"""``python -m proxweave.plans.cli``: communities of a saved graph at several resolutions."""

from __future__ import annotations

import argparse

from pyspark.sql import SparkSession

from ..sources.store import load_graph
from .build import communities


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(description="Communities of a saved graph, with statistics and interface edges.")
    p.add_argument("graph", help="folder of a saved graph")
    p.add_argument("output", help="folder for the runs")
    p.add_argument("--resolutions", type=float, nargs="+", default=[1.0])
    p.add_argument("--algorithm", choices=("leiden", "louvain", "labelprop"), default="leiden")
    p.add_argument("--run-name", default="run")
    p.add_argument("--pre-k", type=int, default=80)
    p.add_argument("--post-k", type=int, default=68)
    p.add_argument("--coarsen-levels", type=int, default=0)
    p.add_argument("--min-cluster-size", type=int)
    p.add_argument("--rank-col")
    p.add_argument("--similarity-scale", type=float)
    p.add_argument("--cold", action="store_true", help="start every resolution from single nodes")
    return p


def main(args: list[str] | None = None) -> None:
    a = parser().parse_args(args)
    spark = SparkSession.builder.getOrCreate()
    g = load_graph(spark, a.graph, full=False)
    runs = communities(
        g.edges.withColumnRenamed("weight", "distance"),
        g.nodes,
        a.resolutions,
        algorithm=a.algorithm,
        similarity_scale=a.similarity_scale if a.similarity_scale is not None else "adaptive",
        pre_k=a.pre_k,
        post_k=a.post_k,
        coarsen_levels=a.coarsen_levels,
        min_cluster_size=a.min_cluster_size,
        rank_col=a.rank_col,
        run_name=a.run_name,
        warm_start=not a.cold,
        output=a.output,
    )
    for r in runs:
        print(r.run_id, r.stats.count(), "clusters,", r.interface.count(), "interface edges")


if __name__ == "__main__":
    main()
