"""Connected components of an undirected edge table by alternating star contraction."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import broadcast_if_small, drop_table, materialize


def _signature(edges: DataFrame) -> tuple[int, int]:
    row = edges.agg(
        F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")
    ).first()
    return int(row["n"]), int(row["h"] or 0)


def _star(pairs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``(u, v, m)``: every pair with ``m``, the least node in the closed neighbourhood of ``u``; and the stored table behind it.

    The least nodes are a table of their own, so that the join is a broadcast while they are few, and
    beyond that one whose hubs AQE can split.
    """
    least = materialize(pairs.groupBy("u").agg(F.min("v").alias("m")), "least")
    return pairs.join(broadcast_if_small(least), "u").select("u", "v", F.least("u", "m").alias("m")), least


def star_components(edges: DataFrame, src: str = "src", dst: str = "dst", max_rounds: int = 60) -> DataFrame:
    """``(id, component)`` for every node that has an edge to another node; ``component`` is the least id.

    Large-star and small-star steps alternate until the edge set is a forest of stars, in
    O(log^2 n) rounds. Each round is two aggregations and two joins; a hub's rows are split by
    AQE's skew join, and nothing is collected but two numbers a round.
    """
    cur = materialize(
        edges.where(F.col(src).isNotNull() & F.col(dst).isNotNull() & (F.col(src) != F.col(dst)))
        .select(F.greatest(src, dst).alias("u"), F.least(src, dst).alias("v"))
        .distinct(),
        "edges",
    )
    sig = _signature(cur)
    for _ in range(max_rounds):
        if sig[0] == 0:
            break
        both = cur.unionByName(cur.select(F.col("v").alias("u"), F.col("u").alias("v")))
        starred, first = _star(both)
        large = materialize(
            starred.where(F.col("v") > F.col("u"))
            .select(F.col("v").alias("u"), F.col("m").alias("v"))
            .where("u != v")
            .distinct(),
            "large-star",
        )
        starred, second = _star(large)
        small = (
            starred.select(F.explode(F.array(F.struct("v", "m"), F.struct(F.col("u").alias("v"), "m"))).alias("e"))
            .select(F.col("e.v").alias("u"), F.col("e.m").alias("v"))
            .where("u != v")
            .distinct()
        )
        nxt = materialize(small, "edges")
        now = _signature(nxt)
        for done in (first, second, large, cur):  # nothing reads them any more
            drop_table(cur.sparkSession, done)
        cur = nxt
        if now == sig:
            break
        sig = now
    else:
        raise RuntimeError(f"components did not converge in {max_rounds} rounds")
    roots = cur.select(F.col("v").alias("id"), F.col("v").alias("component")).distinct()
    return cur.select(F.col("u").alias("id"), F.col("v").alias("component")).unionByName(roots)


def number_rows(df: DataFrame, order: list[Column], into: str = "rank", weight: str | None = None) -> DataFrame:
    """``df`` with ``into``: 0, 1, ... in the order of ``order``, without one global sort task.

    With ``weight``, each row counts for that many, and ``into`` is how many come before it. Rows are
    range-partitioned; each partition is numbered by itself, on top of what comes before it. Only a
    number a partition reaches the driver. Rows that are equal in ``order`` share a partition, so
    ``order`` should tell rows apart.
    """
    spark = df.sparkSession
    rows = materialize(df.repartitionByRange(*order).withColumn("__p", F.spark_partition_id()), "ranged")
    one = F.lit(1).cast("long") if weight is None else F.col(weight).cast("long")
    sizes = sorted((r["__p"], r["n"]) for r in rows.groupBy("__p").agg(F.sum(one).alias("n")).collect())
    base, offsets = 0, []
    for p, n in sizes:
        offsets.append((p, base))
        base += n
    start = spark.createDataFrame(offsets, "__p int, __base long")
    inside = Window.partitionBy("__p").orderBy(*order)
    before = F.row_number().over(inside) - 1 if weight is None else F.sum(one).over(inside.rowsBetween(Window.unboundedPreceding, 0)) - one
    return rows.join(F.broadcast(start), "__p").select(*df.columns, (F.col("__base") + before).alias(into))


def dense_ids(df: DataFrame, key: str, into: str) -> DataFrame:
    """``(key, into)``: distinct keys numbered 0, 1, ... in order."""
    return number_rows(df.select(key).distinct(), [F.col(key)], into)


def local_components(pairs: list[tuple[int, int]]) -> dict[int, int]:
    """Least member of each node's component, by union-find."""
    parent: dict[int, int] = {}

    def find(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for a, b in pairs:
        parent.setdefault(a, a)
        parent.setdefault(b, b)
        a, b = find(a), find(b)
        if a != b:
            parent[max(a, b)] = min(a, b)
    return {x: find(x) for x in parent}


def component_roots(nodes: DataFrame, edges: DataFrame, local_edges: int = 200_000) -> DataFrame:
    """``(id, root)`` for every node: the least id of its component.

    Up to ``local_edges`` edges are united on the driver; more go through star contraction.
    """
    spark = edges.sparkSession
    some = edges.select("src", "dst").limit(local_edges + 1).toArrow()
    if some.num_rows <= local_edges:
        found = local_components(zip(*(some.column(i).to_pylist() for i in (0, 1))))
        roots = spark.createDataFrame(list(found.items()), "id long, root long")
    else:
        roots = materialize(star_components(edges), "roots").withColumnRenamed("component", "root")
    return nodes.select("id").join(roots, "id", "left").select("id", F.coalesce("root", "id").alias("root"))


def component_labels(nodes: DataFrame, edges: DataFrame, local_edges: int = 200_000) -> DataFrame:
    """``(id, component)``: components numbered from 0 in the order of their least members."""
    roots = component_roots(nodes, edges, local_edges)
    return roots.join(dense_ids(roots, "root", "component"), "root").select("id", F.col("component").cast("int").alias("component"))
