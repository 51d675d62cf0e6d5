"""Community detection: label propagation, and modularity optimisation with and without refinement."""

from __future__ import annotations

import warnings

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import drop_table, materialize
from .components import component_roots, dense_ids
from .graph import both_ways
from .sparsify import contract, project_back


def modularity(edges: DataFrame, labels: DataFrame, resolution: float = 1.0) -> DataFrame:
    """One row ``(modularity)`` of ``labels(id, label)`` over weighted undirected edges."""
    lab = labels.select("id", "label")
    e = edges.select("src", "dst", "weight").join(lab.select(F.col("id").alias("src"), F.col("label").alias("a")), "src").join(lab.select(F.col("id").alias("dst"), F.col("label").alias("b")), "dst")
    inside = e.agg(F.sum(F.when(F.col("a") == F.col("b"), F.col("weight")).otherwise(0.0)).alias("inside"), F.sum("weight").alias("m"))
    vol = e.select(F.explode(F.array("a", "b")).alias("c"), "weight").groupBy("c").agg(F.sum("weight").alias("v")).agg(F.sum(F.col("v") * F.col("v")).alias("vv"))
    return inside.crossJoin(vol).select((F.col("inside") / F.col("m") - resolution * F.col("vv") / (4 * F.col("m") * F.col("m"))).alias("modularity"))


def label_propagation(edges: DataFrame, nodes: DataFrame, *, max_rounds: int = 20) -> DataFrame:
    """``(id, label)``: every node takes the label of the most weight around it, synchronously.

    Half of the nodes, by a hash of id and round, move each round, which breaks oscillation. Ties go to
    the least label.
    """
    arms = materialize(both_ways(edges.select("src", "dst", "weight")), "arms")
    cur = materialize(nodes.select("id", F.col("id").alias("label")), "labels")
    still = 0
    for r in range(max_rounds):
        votes = arms.join(cur.select(F.col("id").alias("dst"), "label"), "dst").groupBy("src", "label").agg(F.sum("weight").alias("w"))
        best = votes.groupBy(F.col("src").alias("id")).agg(F.max_by("label", F.struct("w", -F.col("label"))).alias("new"))
        moves = F.pmod(F.xxhash64("id", F.lit(r)), F.lit(2)) == 0
        nxt = materialize(cur.join(best, "id", "left").select("id", F.when(moves, F.coalesce("new", "label")).otherwise(F.col("label")).alias("label"), F.col("label").alias("old")), "labels")
        changed = nxt.where("label != old").count()
        cur = nxt.select("id", "label")
        still = still + 1 if not changed else 0
        if still == 2:  # both halves had their turn
            break
    else:
        warnings.warn(f"label propagation did not settle in {max_rounds} rounds", RuntimeWarning, stacklevel=2)
    return cur


def least_member(labels: DataFrame) -> DataFrame:
    """``(id, label)`` with every label named by its least member."""
    low = labels.groupBy("label").agg(F.min("id").alias("low"))
    return labels.join(low, "label").select("id", F.col("low").alias("label"))


def _strengths(edges: DataFrame, loops: DataFrame | None, nodes: DataFrame) -> tuple[DataFrame, DataFrame, float]:
    """Edges in both directions, ``(id, k)`` with the summed weight of each node, and their total."""
    arms = materialize(both_ways(edges.where("src != dst").select("src", "dst", "weight")), "arms")
    own = arms.groupBy(F.col("src").alias("id")).agg(F.sum("weight").alias("k"))
    if loops is not None:
        own = own.unionByName(loops.select("id", (2 * F.col("weight")).alias("k"))).groupBy("id").agg(F.sum("k").alias("k"))
    k = materialize(nodes.select("id").join(own, "id", "left").select("id", F.coalesce("k", F.lit(0.0)).alias("k")), "strengths")
    return arms, k, k.agg(F.sum("k")).first()[0] or 0.0


def local_moving(
    arms: DataFrame, k: DataFrame, two_m: float, resolution: float, max_rounds: int, initial: DataFrame | None = None
) -> DataFrame:
    """``(id, label)``: synchronous moves to the neighbouring community of the greatest modularity gain.

    Gain of a move: weight into it less ``resolution * degree * volume / 2m``, against staying, to nine
    places, so that the order of a sum decides nothing; ties by the least label. Each round a hashed
    half of the nodes may move, and a community takes part in one direction only, so that two nodes
    don't swap.
    """
    start = k.select("id", "k", F.col("id").alias("label"))
    if initial is not None:
        warm = least_member(initial).withColumnRenamed("label", "warm")
        start = start.join(warm, "id", "left").select("id", "k", F.coalesce("warm", "label").alias("label"))
    cur = materialize(start, "labels")
    still = 0
    for r in range(max_rounds):
        vol = cur.groupBy("label").agg(F.sum("k").alias("vol"))
        into = arms.join(cur.select(F.col("id").alias("dst"), "label"), "dst").groupBy(F.col("src").alias("id"), "label").agg(F.sum("weight").alias("w"))
        stay = cur.select("id", "label", F.lit(0.0).alias("w"))
        options = into.unionByName(stay).groupBy("id", "label").agg(F.sum("w").alias("w")).join(vol, "label")
        me = cur.select("id", "k", F.col("label").alias("old"))
        gain = F.col("w") - resolution * F.col("k") * (F.col("vol") - F.when(F.col("label") == F.col("old"), F.col("k")).otherwise(0.0)) / two_m
        best = (
            options.join(me, "id")
            .withColumn("gain", F.round(gain, 9))
            .groupBy("id", "k", "old")
            .agg(F.max_by("label", F.struct("gain", -F.col("label"))).alias("new"), F.max("gain").alias("top"), F.max(F.when(F.col("label") == F.col("old"), F.col("gain"))).alias("base"))
        )
        turn = (F.pmod(F.xxhash64("id", F.lit(r)), F.lit(2)) == 0) & (F.col("top") > F.col("base"))
        down = F.lit(r % 4 < 2) == (F.col("new") < F.col("old"))
        nxt = materialize(best.select("id", "k", F.when(turn & down, F.col("new")).otherwise(F.col("old")).alias("label"), "old"), "labels")
        changed = nxt.where("label != old").count()
        drop_table(cur.sparkSession, cur)
        cur = nxt.select("id", "k", "label")
        still = still + 1 if not changed else 0
        if still == 4:
            break
    return cur.select("id", "label")


def refining(arms: DataFrame, k: DataFrame, two_m: float, labels: DataFrame, resolution: float, max_rounds: int) -> DataFrame:
    """``(id, label)``: each community of ``labels`` built anew from single nodes, as connected parts.

    A node that is still alone and well connected to its community joins the part of it, itself well
    connected, that gains most, if that gains at all. Well connected: the weight to the rest of the
    community is ``resolution`` times what chance expects, or more. In each round a hashed half of the
    nodes may move and only into parts that stay, so a part is always connected.
    """
    cell = k.join(labels.select("id", F.col("label").alias("s")), "id")
    vol_s = cell.groupBy("s").agg(F.sum("k").alias("vol_s"))
    side = lambda end: cell.select(F.col("id").alias(end), F.col("s").alias(f"s_{end}"))
    inside = materialize(arms.join(side("src"), "src").join(side("dst"), "dst").where("s_src = s_dst").select("src", "dst", "weight"), "inside")
    own = inside.groupBy(F.col("src").alias("id")).agg(F.sum("weight").alias("e"))
    expected = lambda v: resolution * F.col(v) * (F.col("vol_s") - F.col(v)) / two_m
    well = F.round(F.coalesce("e", F.lit(0.0)) - expected("k"), 9) >= 0
    base = materialize(cell.join(vol_s, "s").join(own, "id", "left").select("id", "k", "s", "vol_s", well.alias("well")), "refining")
    cur = materialize(base.select("*", F.col("id").alias("ref")), "refined")
    still = 0
    for r in range(max_rounds):
        bit = lambda c: F.pmod(F.xxhash64(c, F.lit(r)), F.lit(2)) == 0  # noqa: B023, E731
        parts = cur.groupBy(F.col("ref").alias("part")).agg(F.count(F.lit(1)).alias("size"), F.sum("k").alias("vol"), F.first("vol_s").alias("vol_s"))
        a, b = cur.select(F.col("id").alias("src"), F.col("ref").alias("part")), cur.select(F.col("id").alias("dst"), F.col("ref").alias("other"))
        across = inside.join(a, "src").join(b, "dst").where("part != other")
        out = across.groupBy("part").agg(F.sum("weight").alias("e"))
        sizes = materialize(parts.join(out, "part", "left").withColumn("ok", F.round(F.coalesce("e", F.lit(0.0)) - expected("vol"), 9) >= 0), "parts")
        movers = cur.join(sizes.where("size = 1").select(F.col("part").alias("ref")), "ref", "left_semi").where(F.col("well") & bit("id")).select("id", "k")
        targets = sizes.where(F.col("ok") & ((F.col("size") > 1) | ~bit("part"))).select(F.col("part").alias("other"), "vol")
        options = across.groupBy(F.col("src").alias("id"), "other").agg(F.sum("weight").alias("w")).join(movers, "id").join(targets, "other")
        gain = F.round(F.col("w") - resolution * F.col("k") * F.col("vol") / two_m, 9)
        best = options.withColumn("gain", gain).where("gain > 0").groupBy("id").agg(F.max_by("other", F.struct("gain", -F.col("other"))).alias("to"))
        best = materialize(best, "moves")
        changed = best.count()
        if changed:
            cur = materialize(cur.join(best, "id", "left").select(*base.columns, F.coalesce("to", "ref").alias("ref")), "refined")
        still = still + 1 if not changed else 0
        if still == 4:
            break
    return cur.select("id", F.col("ref").alias("label"))


def split_disconnected(edges: DataFrame, labels: DataFrame) -> DataFrame:
    """``(id, label)``: communities cut into their connected parts, each named by its least member."""
    lab = labels.select("id", "label")
    inside = (
        edges.select("src", "dst")
        .join(lab.select(F.col("id").alias("src"), F.col("label").alias("a")), "src")
        .join(lab.select(F.col("id").alias("dst"), F.col("label").alias("b")), "dst")
        .where("a = b")
    )
    return component_roots(lab, inside).select("id", F.col("root").alias("label"))


P1, P2, P3, P4, P5 = (np.uint64(x) for x in (0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5))
ARCS = 1 << 20  # arcs whose options are held at once


def _mixed(h: np.ndarray, turn: int, times: np.uint64, plus: np.uint64) -> np.ndarray:
    h = ((h << np.uint64(turn)) | (h >> np.uint64(64 - turn))) * times + plus
    h = (h ^ (h >> np.uint64(33))) * P2
    h = (h ^ (h >> np.uint64(29))) * P3
    return h ^ (h >> np.uint64(32))


def _halves(ids: np.ndarray, r: int) -> np.ndarray:
    """Whose turn it is in round ``r``: the same hash (XXH64 of id, then round) as in the DataFrame rounds."""
    x = ids.astype(np.int64).view(np.uint64) * P2
    x = ((x << np.uint64(31)) | (x >> np.uint64(33))) * P1
    h = _mixed(x ^ (np.uint64(42 + 8) + P5), 27, P1, P4)
    h = _mixed((h + P5 + np.uint64(4)) ^ (np.full(len(ids), r, np.uint64) * P1), 23, P2, P3)
    return h % np.uint64(2) == 0


def _sums(node: np.ndarray, label: np.ndarray, w: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct pairs in order, and the sum of ``w`` of each."""
    key = node.astype(np.int64) * n + label
    order = np.argsort(key, kind="stable")
    key, w = key[order], w[order]
    new = np.append(True, key[1:] != key[:-1])[: len(key)]
    kept = key[new]
    return kept // n, kept % n, np.bincount(np.cumsum(new) - 1, w, len(kept))


def _first_best(node: np.ndarray, gain: np.ndarray) -> np.ndarray:
    """Places of each node's greatest gain, the first of equal ones; nodes, and their labels, ascend."""
    if not len(node):
        return np.zeros(0, np.int64)
    start = np.nonzero(np.append(True, node[1:] != node[:-1]))[0]
    at = np.nonzero(gain == np.repeat(np.maximum.reduceat(gain, start), np.diff(np.append(start, len(node)))))[0]
    return at[np.append(True, node[at][1:] != node[at][:-1])]


def _arcs(src: np.ndarray, dst: np.ndarray, w: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Both directions, by node."""
    rows = np.append(src, dst).astype(np.int32)
    order = np.argsort(rows, kind="stable")
    return rows[order], np.append(dst, src).astype(np.int32)[order], np.append(w, w)[order]


def _moving_here(src, dst, w, ids, k, two_m, resolution, max_rounds, label) -> np.ndarray:
    """:func:`local_moving` in arrays; nodes and labels are places in ``ids``, which ascend, and so does ``src``."""
    n, still = len(ids), 0
    start = np.searchsorted(src, np.arange(n + 1))
    cuts = np.unique(np.append(np.searchsorted(start, np.arange(ARCS, len(src), ARCS)), n))
    for r in range(max_rounds):
        vol, turn, moved = np.bincount(label, k, n), _halves(ids, r), label.copy()
        for lo, hi in zip(np.append(0, cuts), cuts):
            at = start[lo] + np.nonzero(turn[src[start[lo] : start[hi]]])[0]
            every = lo + np.nonzero(turn[lo:hi])[0]
            node, lab, total = _sums(np.append(src[at], every), np.append(label[dst[at]], label[every]), np.append(w[at], np.zeros(len(every))), n)
            at_home = lab == label[node]
            gain = np.round(total - resolution * k[node] * (vol[lab] - np.where(at_home, k[node], 0.0)) / two_m, 9)
            best = _first_best(node, gain)  # one a node, in their order
            new, top, base = lab[best], gain[best], gain[at_home]
            move = (top > base) & ((r % 4 < 2) == (new < label[every]))
            moved[every[move]] = new[move]
        still = 0 if (moved != label).any() else still + 1
        label = moved
        if still == 4:
            break
    return label


def _refining_here(src, dst, w, ids, k, two_m, label, resolution, max_rounds) -> np.ndarray:
    """:func:`refining` in arrays."""
    n, still = len(ids), 0
    inside = label[src] == label[dst]
    src, dst, w = src[inside], dst[inside], w[inside]
    vol_s = np.bincount(label, k, n)[label]
    well = np.round(np.bincount(src, w, n) - resolution * k * (vol_s - k) / two_m, 9) >= 0
    ref = np.arange(n)
    for r in range(max_rounds):
        bit = _halves(ids, r)
        size, vol = np.bincount(ref, minlength=n), np.bincount(ref, k, n)
        across = ref[src] != ref[dst]
        ok = np.round(np.bincount(ref[src[across]], w[across], n) - resolution * vol * (vol_s - vol) / two_m, 9) >= 0
        target = ok & ((size > 1) | ((size == 1) & ~bit))
        use = across & (size[ref[src]] == 1) & well[src] & bit[src] & target[ref[dst]]
        node, lab, total = _sums(src[use], ref[dst[use]], w[use], n)
        gain = np.round(total - resolution * k[node] * vol[lab] / two_m, 9)
        node, lab, gain = node[gain > 0], lab[gain > 0], gain[gain > 0]
        best = _first_best(node, gain)
        ref[node[best]] = lab[best]
        still = 0 if len(best) else still + 1
        if still == 4:
            break
    return ref


def _communities_here(src, dst, w, ids, resolution: float, refine: bool, max_levels: int, max_rounds: int, initial: np.ndarray | None) -> np.ndarray:
    """The levels of :func:`_distributed_louvain` in arrays: the same rounds, and so the same communities."""
    member, loops, n = np.arange(len(ids)), np.zeros(len(ids)), len(ids)
    label = np.arange(n) if initial is None else initial
    for _ in range(max_levels):
        k = np.bincount(src, w, n) + np.bincount(dst, w, n) + 2 * loops
        two_m = k.sum()
        if two_m <= 0:
            break
        both = _arcs(src, dst, w)
        label = _moving_here(*both, ids, k, two_m, resolution, max_rounds, label)
        part = _refining_here(*both, ids, k, two_m, label, resolution, max_rounds) if refine else label
        kept, at = np.unique(part, return_inverse=True)
        if len(kept) == n:
            break
        loops = np.bincount(at, loops, len(kept)) + np.bincount(at[src[at[src] == at[dst]]], w[at[src] == at[dst]], len(kept))
        low, high = np.minimum(at[src], at[dst]), np.maximum(at[src], at[dst])
        cross = low != high
        src, dst, w = _sums(low[cross], high[cross], w[cross], len(kept))
        member, ids, n = at[member], ids[kept], len(kept)
        # the next level starts from the communities, named by their least part
        name = np.unique(label[kept], return_inverse=True)[1]
        label = np.arange(n) if not refine else np.unique(name, return_index=True)[1][name]
    return ids[label][member] if refine else ids[member]


def louvain(
    edges: DataFrame,
    nodes: DataFrame,
    *,
    resolution: float = 1.0,
    refine: bool = False,
    max_levels: int = 10,
    max_rounds: int = 24,
    initial: DataFrame | None = None,
    local_edges: int = 8_000_000,
) -> DataFrame:
    """``(id, label)``: modularity communities, numbered from 0 by descending size, then least member.

    Levels of local moving and contraction until nothing merges. With ``refine`` (Leiden) each level's
    communities are built anew from well connected parts; these are contracted, and the next level
    starts from the communities, none of which is disconnected in the end. The first level starts
    from ``initial(id, label)`` if it is given, else from single nodes. Up to ``local_edges`` edges, the
    rounds run on arrays of the driver, else on DataFrames; both make the same moves.
    """
    e = edges.where("src != dst").groupBy(F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst")).agg(F.sum("weight").alias("weight"))
    e = materialize(e, "community-edges")
    spark = edges.sparkSession
    if e.count() <= local_edges:
        t = e.toArrow()  # bounded by the count above
        ends = [t.column(c).to_numpy() for c in ("src", "dst")]
        ids = np.unique(np.concatenate(ends))
        src, dst = (np.searchsorted(ids, x) for x in ends)
        warm = None
        if initial is not None:
            known = initial.join(spark.createDataFrame(pa.table({"id": ids}), "id long"), "id", "left_semi").select("id", "label").toArrow()
            place, name = np.searchsorted(ids, known.column("id").to_numpy()), np.unique(known.column("label").to_numpy(), return_inverse=True)[1]
            least = np.full(len(place), len(ids))
            np.minimum.at(least, name, place)
            warm = np.arange(len(ids))
            warm[place] = least[name]
        found = _communities_here(src, dst, t.column("weight").to_numpy(), ids, resolution, refine, max_levels, max_rounds, warm)
        table = spark.createDataFrame(pa.table({"id": ids, "label": found}), "id long, label long")
        raw = nodes.select("id").join(table, "id", "left").select("id", F.coalesce("label", "id").alias("label"))
    else:
        raw = _distributed_louvain(e, nodes, resolution, refine, max_levels, max_rounds, initial)
    return by_size(split_disconnected(e, raw) if refine else raw)


def leiden(edges: DataFrame, nodes: DataFrame, **options) -> DataFrame:
    """:func:`louvain` with the refinement phase: all communities are connected, and built of well connected parts."""
    return louvain(edges, nodes, refine=True, **options)


def _distributed_louvain(
    e: DataFrame, nodes: DataFrame, resolution: float, refine: bool, max_levels: int, max_rounds: int, initial: DataFrame | None = None
) -> DataFrame:
    cur, loops = e, None
    ends = both_ways(e.select("src", "dst", "weight")).select(F.col("src").alias("id")).distinct()
    ids = materialize(nodes.select("id").join(ends, "id", "left_semi"), "level-nodes")
    whole = materialize(ids.select("id", F.col("id").alias("meta_id")), "membership")
    label = None if initial is None else initial.join(ids, "id", "left_semi")
    for _ in range(max_levels):
        arms, k, two_m = _strengths(cur, loops, ids)
        if two_m <= 0:
            break
        label = materialize(local_moving(arms, k, two_m, resolution, max_rounds, label), "level-labels")
        part = materialize(refining(arms, k, two_m, label, resolution, max_rounds), "level-parts") if refine else label
        if part.agg(F.count_distinct("label")).first()[0] == ids.count():
            break
        step = part.select("id", F.col("label").alias("meta_id"))
        whole = materialize(project_back(step.select(F.col("id").alias("meta_id"), F.col("meta_id").alias("label")), whole).withColumnRenamed("label", "meta_id"), "membership")
        a, b = step.select(F.col("id").alias("src"), F.col("meta_id").alias("ms")), step.select(F.col("id").alias("dst"), F.col("meta_id").alias("mt"))
        inner = cur.join(a, "src").join(b, "dst").where("ms = mt").select(F.col("ms").alias("id"), "weight")
        if loops is not None:
            inner = inner.unionByName(loops.join(step, "id").select(F.col("meta_id").alias("id"), "weight"))
        loops = materialize(inner.groupBy("id").agg(F.sum("weight").alias("weight")), "loops")
        cur = materialize(contract(cur.withColumn("distance", F.lit(0.0)), step).select("src", "dst", "weight"), "level-edges")
        ids = materialize(step.select(F.col("meta_id").alias("id")).distinct(), "level-nodes")
        label = materialize(label.join(ids, "id", "left_semi"), "level-labels") if refine else None
    found = whole.select("id", F.col("meta_id").alias("label"))
    if refine and label is not None:
        found = project_back(label.select(F.col("id").alias("meta_id"), "label"), whole)
    return nodes.select("id").join(found, "id", "left").select("id", F.coalesce("label", "id").alias("label"))


def by_size(labels: DataFrame) -> DataFrame:
    """Labels renumbered from 0: larger communities first, then by least member."""
    sizes = labels.groupBy("label").agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("low"))
    keys = sizes.select("label", F.struct((-F.col("n")).alias("n"), "low").alias("o"))
    ids = dense_ids(keys.select("o"), "o", "new")
    return labels.join(keys.join(ids, "o").select("label", "new"), "label").select("id", F.col("new").cast("int").alias("label"))

