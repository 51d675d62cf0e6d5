"""Language-model scores by context-tree weighting over binary-decomposed bytes, and a word-count baseline."""

from __future__ import annotations

import math
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import broadcast_if_small, materialize

EDGE = 0xFF  # stands before the first byte and after the last; never occurs in UTF-8
END = b" "  # the end token: no word holds a space
TOP = 2  # bytes of context that the collected top of the tree ends below
CHUNK = 1 << 20


def grams(text: bytes, depth: int) -> np.ndarray:
    """For each byte and the end: ``depth`` context bytes and the byte, packed with the byte lowest."""
    b = np.frombuffer(bytes([EDGE]) * depth + text + bytes([EDGE]), np.uint8)
    n = len(b) - depth
    key = np.zeros(n, dtype=np.int64)
    for i in range(depth + 1):
        key = (key << 8) | b[i : i + n]
    return key


class GramTable:
    """Values by gram, in an open-addressing table of arrays: a lookup of many grams is a few gathers."""

    def __init__(self, keys: np.ndarray, values: np.ndarray):
        bits = max(4, (4 * len(keys)).bit_length())
        self.shift, self.mask = np.uint64(64 - bits), (1 << bits) - 1
        self.keys, self.values = np.full(1 << bits, -1, np.int64), np.zeros(1 << bits)
        slot, left = self._slot(keys), np.arange(len(keys))
        while len(left):
            free = self.keys[slot] == -1
            self.keys[slot[free]] = keys[left[free]]
            placed = self.keys[slot] == keys[left]
            self.values[slot[placed]] = values[left[placed]]
            left, slot = left[~placed], (slot[~placed] + 1) & self.mask

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return (keys.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> self.shift).view(np.int64)

    def total(self, keys: np.ndarray) -> float:
        """Sum of the values of ``keys``, all of which are in the table."""
        slot, out = self._slot(keys), 0.0
        while True:
            hit = self.keys[slot] == keys
            if hit.all():
                return out + float(self.values[slot].sum())
            out += float(self.values[slot[hit]].sum())
            keys, slot = keys[~hit], (slot[~hit] + 1) & self.mask


def add_counts(keys: np.ndarray, sums: np.ndarray, more: np.ndarray, weight: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct keys and their sums, with ``weight`` added for every item of ``more``."""
    new, n = np.unique(more, return_counts=True)
    both, at = np.unique(np.concatenate([keys, new]), return_inverse=True)
    total = np.zeros(len(both), np.int64)
    total[at[: len(keys)]] = sums
    total[at[len(keys) :]] += weight * n
    return both, total


def log_gamma(x: np.ndarray) -> np.ndarray:
    """ln of the gamma function for x >= 0.5: Stirling's series at x + 8, stepped down."""
    y = x + 8.0
    s = (y - 0.5) * np.log(y) - y + 0.5 * math.log(2 * math.pi) + 1 / (12 * y) - 1 / (360 * y**3) + 1 / (1260 * y**5)
    for i in range(8):
        s = s - np.log(x + i)
    return s


def log_kt(zeros: np.ndarray, ones: np.ndarray) -> np.ndarray:
    """ln of the Krichevsky-Trofimov probability of a sequence with these counts, in any order."""
    return log_gamma(zeros + 0.5) + log_gamma(ones + 0.5) - log_gamma(zeros + ones + 1.0) - math.log(math.pi)


class Subtree:
    """All nodes below one context of ``TOP`` bytes: bit counts by (context, bit position), bottom up.

    A node is a context of d bytes with one of the 255 places in a byte's binary decomposition. Its
    weighted probability is the mean of its own KT probability and the product of its children's.
    """

    def __init__(self, gram: np.ndarray, n: np.ndarray, depth: int):
        byte, ctx = gram & 0xFF, gram >> 8
        k = np.arange(8)
        self.bit = ((byte[:, None] >> (7 - k)) & 1).ravel()
        place = ((1 << k) | (byte[:, None] >> (8 - k))).ravel()
        weight = np.repeat(n.astype(np.float64), 8)
        key, up = np.unique((np.repeat(ctx, 8) << 8) | place, return_inverse=True)
        zeros = np.bincount(up, weight * (1 - self.bit), len(key))
        ones = np.bincount(up, weight * self.bit, len(key))
        own = log_kt(zeros, ones)
        self.levels = [(up, zeros, ones, None)]  # deepest first: index into nodes, counts, ln of the weight ratio
        below = own
        for d in range(depth - 1, TOP - 1, -1):
            parent = (key & ((1 << (8 * d + 8)) - 1)) if d else key & 0xFF
            key, up = np.unique(parent, return_inverse=True)
            zeros, ones = np.bincount(up, zeros, len(key)), np.bincount(up, ones, len(key))
            split = np.bincount(up, below, len(key))
            own = log_kt(zeros, ones)
            below = np.logaddexp(own, split) - math.log(2)
            self.levels.append((up, zeros, ones, own - split))
        self.place, self.weighted = key & 0xFF, below

    def predict(self, top: list[tuple[np.ndarray, np.ndarray, np.ndarray]]) -> np.ndarray:
        """log10 probability of each gram's byte. ``top``: (zeros, ones, ln ratio) by place, for depths TOP - 1 to 0.

        From the deepest context up, a node's estimate is mixed with what its child says in proportion
        to their probabilities of the training text; a context never seen says one half.
        """
        p = index = None
        for up, zeros, ones, ratio in self.levels:
            index = up if index is None else up[index]
            p = self._mix(p, zeros[index], ones[index], None if ratio is None else ratio[index])
        place = self.place[index]
        for zeros, ones, ratio in top:
            p = self._mix(p, zeros[place], ones[place], ratio[place])
        return np.log10(p).reshape(-1, 8).sum(1)

    def _mix(self, p, zeros, ones, ratio):
        kt = (np.where(self.bit == 1, ones, zeros) + 0.5) / (zeros + ones + 1.0)
        if p is None:
            return kt
        w = 1 / (1 + np.exp(-np.clip(ratio, -700, 700)))
        return w * kt + (1 - w) * p


def tree_log_probabilities(counts: DataFrame, depth: int) -> DataFrame:
    """``(gram, v)``: log10 probability of each gram's byte after its context, from the counts ``(gram, n)`` of all grams.

    Subtrees below each context of ``TOP`` bytes are independent and built in parallel. Only the
    256 * 255 nodes of depth 1 and the 255 of depth 0, sums over all subtrees, reach the driver. Grams
    of count 0 are those to be scored only.
    """
    keyed = counts.select(((F.shiftright("gram", 8)).bitwiseAND(F.lit((1 << 8 * TOP) - 1))).cast("int").alias("sub"), "gram", "n")

    def roots(key, table):
        g, n = table.column("gram").to_numpy(), table.column("n").to_numpy()
        tree = Subtree(g, n, depth)
        _, zeros, ones, _ = tree.levels[-1]
        last = np.full(len(tree.place), key[0].as_py() & 0xFF, np.int32)
        return pa.table({"last": last, "place": tree.place.astype(np.int32), "zeros": zeros, "ones": ones, "w": tree.weighted})

    sums = (
        keyed.groupBy("sub")
        .applyInArrow(roots, "last int, place int, zeros double, ones double, w double")
        .groupBy("last", "place")
        .agg(F.sum("zeros").alias("zeros"), F.sum("ones").alias("ones"), F.sum("w").alias("w"))
        .toPandas()
    )
    zeros, ones, split = (np.zeros((256, 256)) for _ in range(3))
    at = sums["last"].to_numpy(int), sums["place"].to_numpy(int)
    zeros[at], ones[at], split[at] = sums["zeros"], sums["ones"], sums["w"]
    own = log_kt(zeros, ones)
    ratio1, weighted = own - split, np.logaddexp(own, split) - math.log(2)
    z0, o0 = zeros.sum(0), ones.sum(0)
    ratio0 = log_kt(z0, o0) - weighted.sum(0)

    def score(key, table):
        g, n = table.column("gram").to_numpy(), table.column("n").to_numpy()
        last = key[0].as_py() & 0xFF
        v = Subtree(g, n, depth).predict([(zeros[last], ones[last], ratio1[last]), (z0, o0, ratio0)])
        return pa.table({"gram": g, "v": v})

    return keyed.groupBy("sub").applyInArrow(score, "gram long, v double")


def block_dictionary(blocks: DataFrame, depth: int) -> DataFrame:
    """``(block, gram, word, n)``: the distinct grams (``word`` null) and tokens (``gram`` null) of each block, with training counts."""

    def run(table):
        block = table.column("block")[0].as_py()
        words: Counter[bytes] = Counter()
        also: set[bytes] = set()
        keys, sums = np.zeros(0, np.int64), np.zeros(0, np.int64)
        queues: tuple[list[np.ndarray], list[np.ndarray]] = ([], [])  # held out, training
        waiting = [0, 0]

        def merge(train: bool):
            nonlocal keys, sums
            if queues[train]:
                keys, sums = add_counts(keys, sums, np.concatenate(queues[train]), int(train))
            queues[train].clear()
            waiting[train] = 0

        for t, out, copies in zip(table.column("t"), table.column("held_out"), table.column("copies").to_pylist()):
            text, train = t.as_py() or b"", not out.as_py()
            g = grams(text, depth)
            for i in range(0, len(g), CHUNK):
                if train and copies > 1:
                    keys, sums = add_counts(keys, sums, g[i : i + CHUNK], copies)
                    continue
                queues[train].append(g[i : i + CHUNK])
                waiting[train] += len(queues[train][-1])
                if waiting[train] >= CHUNK:
                    merge(train)
            tokens = text.lower().split()
            if train:
                for w, n in Counter([*tokens, END]).items() if copies > 1 else ():
                    words[w] += n * copies
                if copies == 1:
                    words.update(tokens)
                    words[END] += 1
            else:
                also.update(tokens)
        merge(False)
        merge(True)
        also.add(END)
        also.difference_update(words)
        g, w = len(keys), len(words) + len(also)
        return pa.table(
            {
                "block": pa.array(np.full(g + w, block, np.int32)),
                "gram": pa.chunked_array([pa.array(keys), pa.nulls(w, pa.int64())]),
                "word": pa.chunked_array([pa.nulls(g, pa.binary()), pa.array([*words.keys(), *also], pa.binary())]),
                "n": pa.chunked_array([pa.array(sums), pa.array([*words.values(), *[0] * len(also)], pa.int64())]),
            }
        )

    return blocks.select("block", "held_out", "copies", "t").groupBy("block").applyInArrow(run, "block int, gram long, word binary, n long")


def with_copies(rows: DataFrame) -> DataFrame:
    """``rows`` of (id, held_out, t) with ``copies``: rows equal in id and text are one, so that they fill no block by themselves."""
    same = ["id", "held_out", "th"]
    marked = rows.withColumn("th", F.xxhash64("t"))
    twice = materialize(marked.groupBy(*same).agg(F.count(F.lit(1)).alias("copies")).where("copies > 1"), "repeated-rows")
    if not twice.take(1):
        return rows.withColumn("copies", F.lit(1).cast("long"))
    match = [F.col(f"__{c}").eqNullSafe(F.col(c)) for c in same]
    keys = broadcast_if_small(twice.select(*[F.col(c).alias(f"__{c}") for c in same]))
    once = marked.join(keys, match, "left_anti").select(*rows.columns, F.lit(1).cast("long").alias("copies"))
    many = marked.join(keys, match, "left_semi").groupBy(*same).agg(F.first("t").alias("t"), F.count(F.lit(1)).alias("copies"))
    return once.unionByName(many.select(*rows.columns, "copies"))


def context_tree_scores(
    docs: DataFrame,
    held_out: Column,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    depth: int = 4,
    block_bytes: int = 8 << 20,
) -> DataFrame:
    """One row for each input row: ``held_out``, token counts, ``base_score``, ``score``, ``bits_per_byte``.

    ``score`` is the log10 probability of the text's bytes and its end under a context-tree weighting
    of ``depth`` context bytes; base is the add-one unigram of words and an end token. Both learn from
    every row where ``held_out`` isn't true. ``bits_per_byte`` is the code length by bytes plus the end.

    The model isn't bounded, so it is never broadcast. Texts are dealt into blocks of about
    ``block_bytes`` by a hash of id and text. Each block lists its distinct grams and words once, with
    counts; the lists meet the corpus' counts by key, and come back to the block with a value for each
    entry, where whole texts are summed up. A frequent gram or word is thus one row a block.

    A null text counts as empty: one token, the end. Null ids learn and score like others. Repeated
    rows stay, but are counted and scored as one. An empty table gives an empty result; other columns
    are ignored.
    """
    if not TOP <= depth <= 6:
        raise ValueError("depth must be 2 to 6")
    text = F.col(text_col).cast("binary")
    total = docs.agg(F.sum(F.octet_length(text).cast("long"))).first()[0] or 0
    n_blocks = max(1, -(-total // block_bytes))
    rows = with_copies(docs.select(F.col(id_col).alias("id"), F.coalesce(held_out, F.lit(False)).alias("held_out"), text.alias("t")))
    blocks = rows.withColumn("block", F.pmod(F.xxhash64("id", "t"), F.lit(n_blocks)).cast("int"))
    listed = materialize(block_dictionary(blocks, depth), "block-dictionary")

    # a window and not a join, which would shuffle the lists twice; a frequent word has one narrow row a block
    by_word = Window.partitionBy("word")
    words = materialize(
        listed.where("word is not null").select(
            "block", "word", F.sum("n").over(by_word).alias("c"), (F.col("block") == F.min("block").over(by_word)).alias("first")
        ),
        "word-counts",
    )
    row = words.where("first").agg(F.sum("c").alias("n"), F.count(F.when(F.col("c") > 0, 1)).alias("v")).first()
    n_train, vocabulary = int(row["n"] or 0), int(row["v"])

    listed_grams = listed.where("gram is not null").select("block", "gram", "n")
    counts = materialize(listed_grams.groupBy("gram").agg(F.sum("n").alias("n")), "gram-counts")
    values = listed_grams.select("block", "gram").join(tree_log_probabilities(counts, depth), "gram")
    answers = values.select("block", "gram", F.lit(None).cast("binary").alias("word"), "v").unionByName(
        words.select("block", F.lit(None).cast("long").alias("gram"), "word", F.col("c").cast("double").alias("v"))
    )
    scale = float(n_train + vocabulary + 1)
    kind = blocks.schema["id"].dataType.simpleString()

    def score(left, right):
        word = right.column("word")
        is_gram = right.column("gram").is_valid().to_numpy()
        v = right.column("v").to_numpy()
        values = GramTable(right.column("gram").filter(is_gram).to_numpy(), v[is_gram])
        known = dict(zip(word.filter(~is_gram).to_pylist(), v[~is_gram].tolist()))
        rows = []
        for t in left.column("t"):
            data = t.as_py() or b""
            tokens = data.lower().split()
            tokens.append(END)
            c = np.fromiter(map(known.__getitem__, tokens), np.float64, len(tokens))
            g = grams(data, depth)
            s = sum(values.total(g[i : i + CHUNK]) for i in range(0, len(g), CHUNK))
            rows.append((len(tokens), int((c > 0).sum()), float(np.log10((c + 1) / scale).sum()), s, -s / math.log10(2) / len(g)))
        cols = list(zip(*rows)) or [()] * 5
        names = ["n_tokens", "n_known", "base_score", "score", "bits_per_byte"]
        kinds = [pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.float64()]
        return pa.table(
            {"id": left.column("id"), "held_out": left.column("held_out"), "copies": left.column("copies")} | {n: pa.array(c, k) for n, c, k in zip(names, cols, kinds)}
        )

    out = (
        blocks.groupBy("block")
        .cogroup(answers.groupBy("block"))
        .applyInArrow(score, f"id {kind}, held_out boolean, copies long, n_tokens long, n_known long, base_score double, score double, bits_per_byte double")
    )
    each = out.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), "copies")))
    return each.select(
        F.col("id").alias(id_col), "held_out", "n_tokens", "n_known", F.lit(n_train).cast("long").alias("train_tokens"), "base_score", "score", "bits_per_byte"
    )
