"""Consistent-hash ring with virtual nodes and bounded loads."""

from __future__ import annotations

import struct

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import materialize

COPIES = 1 << 16  # copies of one row that one step makes


def ring(shards: int, vnodes: int, seed: int = 42) -> tuple[np.ndarray, np.ndarray]:
    """Sorted positions (signed 64-bit) of all virtual nodes and the shard of each.

    A node's position depends on its shard and its own number alone, so a new shard only adds
    positions. Equal positions are ordered by shard.
    """
    owner = np.repeat(np.arange(shards, dtype=np.int32), vnodes)
    pos = np.array(
        [xxhash.xxh64_intdigest(struct.pack("<ii", s, v), seed) for s in range(shards) for v in range(vnodes)],
        dtype=np.uint64,
    ).view(np.int64)
    order = np.lexsort((owner, pos))
    return pos[order], owner[order]


def capacities(rows: int, shards: int, epsilon: float) -> np.ndarray:
    """Most rows of each shard: ``ceil((1 + epsilon) * mean)``; at 0 exact quotas one row apart at most."""
    if epsilon < 0:
        raise ValueError("epsilon must not be negative")
    if epsilon == 0:
        return np.array([rows // shards + (s < rows % shards) for s in range(shards)], dtype=np.int64)
    return np.full(shards, int(np.ceil((1 + epsilon) * rows / shards)), dtype=np.int64)


def place(counts: np.ndarray, owner: np.ndarray, caps: np.ndarray) -> list[list[tuple[int, int, int]]]:
    """For each arc, segments ``(end, shard, shift)``: ranks below ``end`` go to ``shard`` at slot ``rank + shift``.

    Every arc first fills its own shard up to the capacity; what overflows walks clockwise to the
    next shards that have room. Works on arc counts alone, so its cost doesn't depend on the rows.
    """
    load = np.zeros(len(caps), dtype=np.int64)
    left = counts.astype(np.int64).copy()
    done = np.zeros(len(counts), dtype=np.int64)
    out: list[list[tuple[int, int, int]]] = [[] for _ in counts]

    def put(arc: int, shard: int) -> None:
        n = int(min(left[arc], caps[shard] - load[shard]))
        if n > 0:
            out[arc].append((int(done[arc]) + n, int(shard), int(load[shard] - done[arc])))
            load[shard] += n
            done[arc] += n
            left[arc] -= n

    for arc, shard in enumerate(owner):
        put(arc, shard)
    for arc in np.nonzero(left)[0]:
        step = arc
        while left[arc]:
            step = (step + 1) % len(owner)
            put(arc, owner[step])
    return out


def ring_shards(
    docs: DataFrame,
    shards: int = 24,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    vnodes: int = 64,
    epsilon: float = 0.0,
    salts: int = 16,
    seed: int = 42,
) -> DataFrame:
    """``(id, size, text_crc32, home_shard, shard, slot)``, one row for each input row.

    The ring's key is the id; ``home_shard`` is where the ring alone would put the row. A shard takes
    at most ``ceil((1 + epsilon) * rows / shards)`` rows (at 0: quotas one row apart at most), and
    keys beyond that continue clockwise. Slots of a shard are gapless from 0.

    Scale: one scan of the text leaves five narrow columns, and rows that repeat an id and a text are one
    with a count from the start. These are ranked within (arc, salt), where the salt is a hash of id
    and text, so that neither one id nor one row on a third of the table makes a large group; the
    result depends on the rows alone, not on how they are partitioned. Only arc-by-salt counts,
    ``shards * vnodes * salts`` at most, reach the driver or are broadcast. Null ids hash like any other;
    null or empty texts have size 8 and checksum 0; repeated rows each get their own slot; an empty
    table gives an empty result; other columns of the input are ignored.
    """
    if shards < 1 or vnodes < 1 or salts < 1:
        raise ValueError("shards, vnodes and salts must be positive")
    spark = docs.sparkSession
    pos, owner = ring(shards, vnodes, seed)

    @F.pandas_udf("int")
    def arc_of(key: pd.Series) -> pd.Series:
        return pd.Series((np.searchsorted(pos, key.to_numpy(np.int64)) % len(pos)).astype(np.int32))

    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(
        F.col(id_col).alias("id"),
        (F.octet_length(text).cast("long") + F.lit(8)).alias("size"),
        F.crc32(text.cast("binary")).alias("crc"),
    )
    salt = F.pmod(F.xxhash64(F.lit(seed), "id", "size", "crc"), F.lit(salts)).cast("int")
    keys = rows.groupBy("id", "size", "crc").agg(F.count(F.lit(1)).alias("copies"))
    keys = materialize(keys.select("*", arc_of(F.xxhash64("id")).alias("arc"), salt.alias("salt")), "shard-keys")

    cells = keys.groupBy("arc", "salt").agg(F.sum("copies").alias("count"), F.max("copies").alias("most")).toPandas()  # at most shards * vnodes * salts rows
    cells = cells.sort_values(["arc", "salt"], ignore_index=True)
    cells["base"] = cells.groupby("arc")["count"].cumsum() - cells["count"]
    counts = np.bincount(cells["arc"], weights=cells["count"], minlength=len(owner)).astype(np.int64)
    segments = place(counts, owner, capacities(int(counts.sum()), shards, epsilon))

    base = spark.createDataFrame(
        [(int(r.arc), int(r.salt), int(r.base)) for r in cells.itertuples()], "arc int, salt int, base long"
    )
    plan = spark.createDataFrame(
        [(a, int(owner[a]), segments[a]) for a in range(len(owner)) if segments[a]],
        "arc int, home int, segments array<struct<end:long,shard:int,shift:long>>",
    )
    order = Window.partitionBy("arc", "salt").orderBy("id", "crc", "size")
    block = F.lit(COPIES)
    ranked = (
        keys.withColumn("first", F.sum("copies").over(order) - F.col("copies"))
        .join(F.broadcast(base), ["arc", "salt"])
        .select("id", "size", "crc", "arc", "copies", (F.col("base") + F.col("first")).alias("first"))
        .withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("copies") - 1) / block))))
    )
    if len(cells) and cells["most"].max() > COPIES:
        ranked = ranked.repartition("arc", "first", "block")  # a row's copies are made by many tasks
    copy = F.sequence(F.col("first") + F.col("block") * block, F.col("first") + F.least(F.col("copies"), (F.col("block") + 1) * block) - 1)
    placed = (
        ranked.withColumn("rank", F.explode(copy))
        .join(F.broadcast(plan), "arc")
        .withColumn("to", F.filter("segments", lambda s: F.col("rank") < s["end"])[0])
    )
    return placed.select(
        F.col("id").alias(id_col),
        "size",
        F.col("crc").alias("text_crc32"),
        F.col("home").alias("home_shard"),
        F.col("to.shard").alias("shard"),
        (F.col("rank") + F.col("to.shift")).alias("slot"),
    )
