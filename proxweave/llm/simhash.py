"""SimHash near-duplicates, joined by the generalised pigeonhole principle."""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import combinations, repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.components import star_components
from ..session import broadcast_if_small, materialize

BITS = 64
BLOCK = 1 << 15


def spread(h: np.ndarray, word: int) -> np.ndarray:
    """The ``word``-th independent hash derived from 64-bit hashes; word 0 is the hash itself."""
    if not word:
        return h
    z = h + np.uint64(word * 0x9E3779B97F4A7C15 % 2**64)
    z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return z ^ (z >> np.uint64(31))


def majority(hashes: Iterator[int], n: int, words: int = 1) -> np.ndarray:
    """The bits set in over half of ``n`` 64-bit hashes, and of ``words - 1`` more that are derived from each."""
    ones, left = np.zeros((words, BITS), dtype=np.int64), n
    while left:
        part = np.fromiter(hashes, dtype="<u8", count=min(left, BLOCK))
        for w in range(words):
            ones[w] += np.unpackbits(spread(part, w).view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
        left -= len(part)
    return np.packbits(2 * ones > n, axis=1, bitorder="little").view("<u8")[:, 0]


def shingle_hashes(text: bytes | None, shingle: int, seed: int = 42) -> tuple[Iterator[int], int]:
    """XXH64 of each shingle, repeats included, and how many there are.

    Words lie between ASCII white space, A-Z are lower-cased. Fewer words than ``shingle``: the whole
    sequence is the one shingle; none: no shingle.
    """
    tokens = (text or b"").lower().split()
    if not tokens:
        return iter(()), 0
    if len(tokens) < shingle:
        return iter([xxhash.xxh64_intdigest(b" ".join(tokens), seed)]), 1
    grams = map(b" ".join, zip(*(tokens[i:] for i in range(shingle))))
    return map(xxhash.xxh64_intdigest, grams, repeat(seed)), len(tokens) - shingle + 1


def fingerprint(text: bytes | None, shingle: int = 3, seed: int = 42) -> int:
    """64-bit SimHash of a text's shingles, repeats included; 0 for a text without words."""
    return int(majority(*shingle_hashes(text, shingle, seed))[0])


def shingle_set(text: bytes | None, shingle: int, seed: int = 42) -> np.ndarray:
    """Sorted distinct shingle hashes."""
    hashes, n = shingle_hashes(text, shingle, seed)
    return np.unique(np.fromiter(hashes, dtype="<u8", count=n))


def fingerprints(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3) -> DataFrame:
    """``(id, fp)``: the fingerprint of each row's whole text, as a signed long. A null text has no words."""

    def run(batches):
        for b in batches:
            fp = np.array([fingerprint(t.as_py(), shingle) for t in b.column(1)], dtype=np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fp)], names=["id", "fp"])

    src = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("binary").alias("t"))
    return src.mapInArrow(run, f"id {src.schema['id'].dataType.simpleString()}, fp long")


def bit_moments(fps: DataFrame, words: list[str]) -> tuple[int, np.ndarray]:
    """Rows, and the matrix of how often two bits are both set, over all fingerprints with these 64-bit ``words``."""
    size = BITS * len(words)
    upper = np.triu_indices(size)

    def run(batches):
        total, n = np.zeros((size, size)), 0
        for b in batches:
            x = np.column_stack([c.to_numpy(zero_copy_only=False) for c in b.columns]).astype("<i8").view(np.uint8)
            for i in range(0, len(x), BLOCK):
                bits = np.unpackbits(x[i : i + BLOCK], axis=1, bitorder="little").astype(np.float32)
                total += bits.T @ bits
                n += len(bits)
        if n:
            value = np.append(total[upper], n).astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(value))), pa.array(value)], names=["cell", "v"])

    sums = fps.select(*words).mapInArrow(run, "cell long, v long").groupBy("cell").agg(F.sum("v").alias("v")).toArrow()
    flat = np.zeros(len(upper[0]) + 1)  # as many numbers at any input size
    flat[sums.column("cell").to_numpy()] = sums.column("v").to_numpy()
    both = np.zeros((size, size))
    both[upper] = flat[:-1]
    return int(flat[-1]), np.maximum(both, both.T)


def correlated_groups(n: int, both: np.ndarray, bits: list[int], parts: int, rng: np.random.Generator | None = None) -> list[list[int]]:
    """Split ``bits`` into ``parts`` groups of near equal size that hold correlated bits together, greedily.

    With ``rng``, each pick chooses among a random half of the bits left, so that every call groups otherwise.
    """
    p = np.diag(both) / max(n, 1)
    sd = np.sqrt(np.maximum(p * (1 - p), 1e-12))
    corr = np.abs((both / max(n, 1) - np.outer(p, p)) / np.outer(sd, sd))
    np.fill_diagonal(corr, 0)
    left, out = list(bits), []
    for k in range(parts):
        width = -(-len(left) // (parts - k))
        group: list[int] = []
        while len(group) < width:
            some = range(len(left)) if rng is None else rng.choice(len(left), -(-len(left) // 2), replace=False)
            score = corr[np.ix_([left[i] for i in some], group or left)].sum(1)
            group.append(left.pop(int(some[int(np.argmax(score))])))
        out.append(group)
    return out


def ball(width: int, radius: int) -> int:
    """Values within ``radius`` bits of a value of ``width`` bits."""
    return sum(math.comb(width, r) for r in range(radius + 1))


def allocate(cost: list[list[float]], total: int) -> list[int]:
    """Thresholds from -1 up that add up to ``total`` at the least cost; ``cost[i][t]`` is that of ``t`` in part i.

    Dynamic programming over parts and the sum so far. -1 skips a part and costs nothing. A part has as
    many options as its list, so none can get a threshold that its width makes pointless.
    """
    best: dict[int, tuple[float, list[int]]] = {0: (0.0, [])}
    for options in cost:
        nxt: dict[int, tuple[float, list[int]]] = {}
        for done, (c, plan) in best.items():
            for t in range(-1, len(options)):
                new = c + (options[t] if t >= 0 else 0.0)
                if done + t not in nxt or new < nxt[done + t][0]:
                    nxt[done + t] = (new, [*plan, t])
        best = nxt
    return best[total][1]


def _mask(bits: list[int]) -> int:
    """The bits as a signed 64-bit mask."""
    m = sum(1 << b for b in bits)
    return m - (1 << 64) if m >= 1 << 63 else m


DENSE = 1024
ROW_COST = 100  # of a probe row, in comparisons of two fingerprints


def far(chance: np.ndarray, reach: int) -> np.ndarray:
    """Chance that at most 0 .. ``reach`` bits differ, if bit i does with ``chance[i]``."""
    dist = np.array([1.0])
    for d in chance:
        dist = np.append(dist, 0) * (1 - d) + np.append(0, dist) * d
    return np.cumsum(np.append(dist, np.zeros(reach + 1)))[: reach + 1]


def meetings(width: int, gap: int, radius: int) -> int:
    """Anchors at which two values of ``width`` bits, ``gap`` of them different, meet if both probe ``radius``."""
    return sum(
        math.comb(gap, i) * math.comb(width - gap, j)
        for i in range(gap + 1)
        for j in range(width - gap + 1)
        if max(i, gap - i) + j <= radius
    )


def part_cost(n: int, chance: np.ndarray, tau: int, equal_pairs: float | None = None) -> list[float]:
    """Estimated cost of a part at each threshold 0 .. ``tau`` under its width: its probe rows, and the pairs that meet.

    Both sides of a pair probe half of the threshold, rounded up, so that values differ in up to twice
    that; a pair counts as often as it meets. ``equal_pairs`` are counted pairs of equal values; if
    one group dominates, larger distances come from it too, so they are taken as equally many at each
    distance as chance makes them, and never fewer than counted.
    """
    width = len(chance)
    near = far(chance, tau + 2)
    exact = np.diff(near, prepend=0)
    at_zero = n * n * near[0] if equal_pairs is None else equal_pairs
    out = []
    for t in range(min(tau, width // 2) + 1):
        radius = -(-t // 2)
        pairs = sum(max(n * n * exact[g], at_zero if g else 0) * meetings(width, g, radius) for g in range(1, 2 * radius + 1))
        out.append(n * ball(width, radius) * ROW_COST + at_zero * meetings(width, 0, radius) + pairs)
    return out


def plan_parts(fps: DataFrame, tau: int) -> tuple[list[list[int]], list[int], tuple[int, np.ndarray]]:
    """Parts, their thresholds, and the bit moments.

    By the general pigeonhole principle, fingerprints within ``tau`` bits agree up to T_i bits in
    some part i if the T_i add up to ``tau - parts + 1``. The number of parts is the cheapest for even
    bits. Then candidates at T = 0 are counted exactly in each part (pairs of equal values), and
    larger T estimated from these and the bits' own frequencies.
    """
    n, both = bit_moments(fps, ["fp"])
    price = {}
    for m in range(1, tau + 2):
        cost = [part_cost(n, np.full(BITS // m + (i < BITS % m), 0.5), tau) for i in range(m)]
        plan = allocate(cost, tau - m + 1)
        price[m] = sum(c[t] for c, t in zip(cost, plan) if t >= 0)
    parts = correlated_groups(n, both, list(range(BITS)), min(price, key=price.get))
    keys = F.array(*[F.struct(F.lit(i).alias("part"), F.col("fp").bitwiseAND(F.lit(_mask(p))).alias("v")) for i, p in enumerate(parts)])
    hist = fps.select(F.explode(keys).alias("k")).groupBy("k.part", "k.v").count()
    pairs = {r["part"]: float(r["c"] or 0) for r in hist.groupBy("part").agg(F.sum(F.col("count").cast("double") * F.col("count")).alias("c")).collect()}
    freq = np.diag(both) / max(n, 1)
    cost = [part_cost(n, 2 * freq[bits] * (1 - freq[bits]), tau, pairs.get(i, 0.0)) for i, bits in enumerate(parts)]
    return parts, allocate(cost, tau - len(parts) + 1), (n, both)


def local_stars(values: np.ndarray, tau: int) -> list[tuple[int, int]]:
    """Edges from the least member to the others of each component of 64-bit values linked at ``tau`` bits or fewer.

    Breadth first; each member is compared once with those not reached yet, so no more than ``DENSE``
    squared distances are ever held.
    """
    left = np.unique(values).view(np.uint64)
    if len(left) <= DENSE:  # most buckets hold no link at all
        left = left[(np.bitwise_count(left[:, None] ^ left[None, :]) <= tau).sum(1) > 1]
    out = []
    while len(left) > 1:
        queue, seen, left = [left[0]], [left[0]], left[1:]
        while queue and len(left):
            near = np.bitwise_count(left ^ queue.pop()) <= tau
            if near.any():
                queue.extend(left[near])
                seen.extend(left[near])
                left = left[~near]
        names = np.array(seen).view(np.int64)
        low = names.min()
        out.extend((int(low), int(x)) for x in names if x != low)
    return out


BUCKET = ["part", "anchor", "sub", "key"]


def pigeonhole_links(fps: DataFrame, tau: int = 2, bucket_rows: int = 1024) -> DataFrame:
    """``(src, dst)`` edges that connect exactly what links connect.

    ``fps`` holds distinct fingerprints ``(fp)``. Two link if they differ in ``tau`` bits or fewer.
    Each is put into the buckets within half of every part's threshold around its value, so that two
    within the threshold meet. A bucket of up to ``bucket_rows`` is verified in one task, by distance,
    and leaves a star per component, never all its pairs.

    A larger bucket is split. If its part leaves enough bits, these are cut into ``tau + 1`` groups,
    one of which must agree for any two that link, and this repeats until few free bits bound the
    bucket by themselves. Else the bucket is cut into blocks, and each pair of blocks is a bucket of
    its own. No candidate is dropped.
    """
    parts, limits, (n, both) = plan_parts(fps, tau)
    none = F.array().cast("array<struct<part:int,anchor:long>>")

    def probes(part: int):
        bits, reach = parts[part], -(-limits[part] // 2)
        flips = [_mask(list(c)) for r in range(reach + 1) for c in combinations(bits, r)]
        own = F.col("fp").bitwiseAND(F.lit(_mask(bits)))
        return F.transform(F.array(*map(F.lit, flips)), lambda f: F.struct(F.lit(part).alias("part"), own.bitwiseXOR(f).alias("anchor")))

    probed = [probes(i) if t >= 0 else none for i, t in enumerate(limits)]
    zero = F.lit(0).cast("long")
    rows = fps.select("fp", F.explode(F.concat(*probed)).alias("p")).select("fp", "p.part", "p.anchor", zero.alias("sub"), zero.alias("key"))

    free = {(i, 0): [b for p in parts if p is not parts[i] for b in p] for i in range(len(parts)) if limits[i] >= 0}
    masks = {k: [] for k in free}  # bits fixed by refinement, for each (part, sub)
    links: DataFrame | None = None

    def verify(batches):
        for b in batches:
            edges = [e for bucket in b.column(0) for e in local_stars(bucket.values.to_numpy(), tau)]
            yield pa.RecordBatch.from_arrays([pa.array([e[i] for e in edges], pa.int64()) for i in (0, 1)], names=["src", "dst"])

    def verified(buckets: DataFrame, *keys) -> DataFrame:
        return buckets.groupBy(*keys).agg(F.collect_list("fp").alias("ms")).select("ms").mapInArrow(verify, "src long, dst long")

    spark = fps.sparkSession
    while True:
        sizes = materialize(rows.groupBy(*BUCKET).count().where("count > 1"), "bucket-sizes")
        bounded = [k for k, bits in free.items() if len(bits) <= 9]
        tight = F.lit(False)
        for part, sub in bounded:
            tight = tight | ((F.col("part") == part) & (F.col("sub") == sub))
        hot = sizes.where((F.col("count") > bucket_rows) & ~tight)
        split = bool(hot.take(1))
        warm = sizes.where((F.col("count") <= bucket_rows) | tight).select(*BUCKET)
        calm = rows.join(hot, BUCKET, "left_anti") if split else rows
        found = verified(calm.join(warm, BUCKET), *BUCKET)
        links = found if links is None else links.unionByName(found)
        if not split:
            return links.distinct()
        if min(map(len, free.values())) // (tau + 1) < 5:
            blocks = F.ceil(2 * F.col("count") / bucket_rows).cast("int")
            own = F.pmod(F.xxhash64("fp"), F.col("blocks")).cast("int")
            cut = rows.join(hot.withColumn("blocks", blocks), BUCKET).select("fp", *BUCKET, own.alias("own"), F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other"))
            pairs = cut.select("fp", *BUCKET, F.least("own", "other").alias("x"), F.greatest("own", "other").alias("y"))
            return links.unionByName(verified(pairs, *BUCKET, "x", "y")).distinct()
        finer, steps = {}, []
        for (part, sub), bits in free.items():
            if (part, sub) in bounded:
                continue
            for group in correlated_groups(n, both, bits, tau + 1):
                fixed = [*masks[part, sub], *group]
                finer[part, _mask(fixed)] = [b for b in bits if b not in group]
                masks[part, _mask(fixed)] = fixed
                steps.append((part, sub, _mask(fixed)))
        free = finer
        step = spark.createDataFrame(steps, "part int, sub long, finer long")
        rows = materialize(
            rows.join(hot, BUCKET, "left_semi")
            .join(F.broadcast(step), ["part", "sub"])  # 3 * (tau + 1) ** level rows
            .select("fp", "part", "anchor", F.col("finer").alias("sub"), F.col("fp").bitwiseAND(F.col("finer")).alias("key")),
            "hot-buckets",
        )


def simhash_components(
    docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3, tau: int = 2, bucket_rows: int = 1024
) -> DataFrame:
    """``(id, fp, component_id)`` for each row: its fingerprint and the least id that links reach from it.

    Exact copies share a fingerprint and are grouped before any join. Rows without words have
    fingerprint 0 and link like others. A null id never is a component's id unless all its ids are
    null. Repeated rows stay; an empty table gives an empty result; other columns are ignored.
    """
    prints = materialize(fingerprints(docs, id_col=id_col, text_col=text_col, shingle=shingle), "fingerprints")
    fps = materialize(prints.groupBy("fp").agg(F.min("id").alias("low")), "distinct-fingerprints")
    roots = materialize(star_components(pigeonhole_links(fps, tau, bucket_rows)), "roots")
    linked = fps.join(roots.withColumnRenamed("id", "fp"), "fp")
    lowest = linked.groupBy("component").agg(F.min("low").alias("least"))
    named = linked.select("fp", "component").join(lowest, "component").select("fp", "least")
    labels = materialize(fps.join(named, "fp", "left").select("fp", F.coalesce("least", "low").alias("component_id")), "labels")
    return prints.join(labels, "fp").select(F.col("id").alias(id_col), "fp", "component_id")


# Similarity: wide fingerprints, several groupings of their bits, and an exact check.


def differing(similarity: float) -> float:
    """Chance that a SimHash bit differs between sets of this Jaccard similarity (cosine 2J / (1 + J))."""
    return math.acos(2 * similarity / (1 + similarity)) / math.pi


def plan_rounds(n: int, size: int, similarity: float, recall: float) -> tuple[int, int]:
    """``(parts, rounds)``: the cheapest number of parts for ``n`` fingerprints of ``size`` bits, and of groupings.

    With ``parts`` parts at threshold 0 a grouping surely finds pairs that differ in fewer bits than it
    has parts, and others by chance; enough groupings are taken for ``recall`` at ``similarity`` itself.
    Wider parts mean fewer pairs that meet by chance, and more groupings; both follow from ``n``.
    """
    best = None
    for m in range(size // 48, size // 8 + 1):
        width = size / m
        hit = (1 - differing(similarity)) ** width
        rounds = max(1, math.ceil(math.log(1 - recall) / math.log(1 - hit) / m))
        cost = rounds * m * (max(n, 1) * ROW_COST + n * n / 2 / 2**width)
        if best is None or cost < best[0]:
            best = cost, m, rounds
    return best[1:]


def key_runs(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """Tables of whole runs of equal ``keys`` from a partition sorted by them; a run is never cut."""
    held: list[pa.RecordBatch] = []
    for b in batches:
        if not b.num_rows:
            continue
        same = np.ones(b.num_rows, dtype=bool)
        for k in keys:
            column = b.column(b.schema.get_field_index(k)).to_numpy(zero_copy_only=False)
            same &= column == column[-1]
        start = int(np.nonzero(~same)[0][-1]) + 1 if not same.all() else 0
        if start or (held and any(held[-1].column(k)[-1] != b.column(k)[0] for k in keys)):
            yield pa.Table.from_batches([*held, b.slice(0, start)])
            held = []
        held.append(b.slice(start))
    if held:
        yield pa.Table.from_batches(held)


def runs_of(*columns: np.ndarray) -> np.ndarray:
    """Where runs of equal rows begin, and the end."""
    new = np.zeros(len(columns[0]), dtype=bool)
    for c in columns:
        new[1:] |= c[1:] != c[:-1]
    return np.concatenate([[0], np.nonzero(new)[0], [len(new)]])


def close(a: np.ndarray, b: np.ndarray, wide: int) -> np.ndarray:
    """Whether rows of 64-bit words differ in ``wide`` bits or fewer."""
    return np.bitwise_count(a ^ b).sum(-1, dtype=np.int32) <= wide


def breadth_first(names: np.ndarray, near) -> list[tuple[int, int]]:
    """Edges from the least member to the others of each component; ``near(i, left)`` says which of ``left`` link to i.

    Each member is compared once with those not reached yet.
    """
    left, out = np.arange(len(names)), []
    while len(left) > 1:
        queue, seen, left = [left[0]], [left[0]], left[1:]
        while queue and len(left):
            found = near(queue.pop(), left)
            if found.any():
                queue.extend(left[found])
                seen.extend(left[found])
                left = left[~found]
        low = min(names[i] for i in seen)
        out.extend((int(low), int(names[i])) for i in seen if names[i] != low)
    return out


SMALL = 16  # buckets up to this size are compared all at once


def bucket_edges(bucket: np.ndarray, names: np.ndarray, fps: np.ndarray, wide: int) -> np.ndarray:
    """Edges, as rows of two names, that connect what differs in ``wide`` bits or fewer within each run of ``bucket``."""
    at = runs_of(bucket)
    size = np.diff(at)
    of = np.repeat(size, size)
    out = []
    for k in range(1, min(SMALL, int(size.max())) if len(size) else 0):
        i = np.nonzero((bucket[:-k] == bucket[k:]) & (of[k:] <= SMALL))[0]
        i = i[close(fps[i], fps[i + k], wide)]
        out.append(np.column_stack([names[i], names[i + k]]))
    for a, b in zip(at[:-1][size > SMALL], at[1:][size > SMALL]):
        f, own = fps[a:b], names[a:b]
        if len(f) <= DENSE:  # most buckets hold few links
            apart = np.zeros((len(f), len(f)), dtype=np.int16)
            for w in range(f.shape[1]):
                apart += np.bitwise_count(f[:, None, w] ^ f[None, :, w])
            linked = (apart <= wide).sum(1) > 1
            f, own = f[linked], own[linked]
        if len(f):
            out.append(np.array(breadth_first(own, lambda i, left: close(f[left], f[i], wide)), dtype=np.int64).reshape(-1, 2))
    return np.unique(np.concatenate(out), axis=0) if out else np.zeros((0, 2), np.int64)


def exact_edges(names: np.ndarray, fps: np.ndarray, sets: list[np.ndarray], similarity: float, wide: int) -> list[tuple[int, int]]:
    """Edges that connect what links: fingerprints ``wide`` bits or fewer apart, and Jaccard ``similarity`` or more."""
    size = np.array([len(s) for s in sets])
    code = np.unique(np.concatenate(sets), return_inverse=True)[1]
    start = np.append(0, np.cumsum(size)[:-1])
    mark = np.zeros(code.max(initial=0) + 1, dtype=np.int64)

    def near(i, left):
        small, large = np.minimum(size[left], size[i]), np.maximum(size[left], size[i])
        found = (small >= similarity * large) & close(fps[left], fps[i], wide)
        some = left[found]
        if len(some):
            own = code[start[i] : start[i] + size[i]]
            mark[own] = 1
            total = size[some]
            ends = np.cumsum(total)
            pos = np.arange(ends[-1]) + np.repeat(start[some] - ends + total, total)
            both = np.add.reduceat(mark[code[pos]], ends - total)
            mark[own] = 0
            found[found] = both >= similarity * (total + size[i] - both)
        return found

    return breadth_first(names, near)


WORDS = ["f0", "f1", "f2", "f3"]


def set_prints(docs: DataFrame, shingle: int, sets: bool = False) -> DataFrame:
    """``(id, th, name, n, f0 .. f3)`` of each ``(id, th, t)``: distinct shingles and the SimHash of their set.

    ``name`` hashes the whole set, so that equal sets share it; no shingle: 0. With ``sets``, ``hs`` holds it.
    """

    def run(batches):
        for b in batches:
            found = [shingle_set(t.as_py(), shingle) for t in b.column("t")]
            name = np.array([xxhash.xxh64_intdigest(s.tobytes()) if len(s) else 0 for s in found], dtype=np.uint64)
            f = np.array([majority(iter(s.tolist()), len(s), len(WORDS)) if len(s) else [0] * len(WORDS) for s in found], dtype=np.uint64)
            out = [b.column("id"), b.column("th"), pa.array(name.view(np.int64)), pa.array([len(s) for s in found], pa.int32())]
            out += [pa.array(np.ascontiguousarray(f.reshape(-1, len(WORDS))[:, w]).view(np.int64)) for w in range(len(WORDS))]
            if sets:
                ends = np.cumsum([0, *map(len, found)]).astype(np.int32)
                out.append(pa.ListArray.from_arrays(ends, pa.array(np.concatenate([*found, np.zeros(0, np.uint64)]).view(np.int64))))
            yield pa.RecordBatch.from_arrays(out, names=names)

    names = ["id", "th", "name", "n", *WORDS, *["hs"] * sets]
    kinds = f"id {docs.schema['id'].dataType.simpleString()}, th long, name long, n int, " + ", ".join(f"{w} long" for w in WORDS)
    return docs.mapInArrow(run, kinds + ", hs array<long>" * sets)


def coarse_links(fps: DataFrame, similarity: float, recall: float, wide: int, bucket_rows: int) -> DataFrame:
    """``(src, dst)`` edges between names, a superset of what links in buckets connect, to split the exact check.

    Bits are grouped several times over; in each grouping, thresholds are allocated by dynamic
    programming on counted pairs, as in :func:`plan_parts`. A bucket of up to ``bucket_rows`` leaves the
    edges of its components by distance. A larger one links all its members to the least, as the exact
    check may get more than it needs but never less. Nothing is dropped.
    """
    n, both = bit_moments(fps, WORDS)
    size = BITS * len(WORDS)
    m, rounds = plan_rounds(n, size, similarity, recall)
    rng = np.random.default_rng(42)
    parts = [[p for p in correlated_groups(n, both, list(range(size)), m, rng)] for _ in range(rounds)]

    def entry(part: int, bits: list[int], flip: tuple[int, ...] = ()):
        word = lambda chosen, w: F.lit(_mask([b - BITS * w for b in chosen if b // BITS == w])).cast("long")
        return F.struct(
            F.lit(part).alias("part"),
            F.array(*[word(bits, w) for w in range(len(WORDS))]).alias("m"),
            F.array(*[word(flip, w) for w in range(len(WORDS))]).alias("x"),
        )

    def probes(entries: list, *keep: str) -> DataFrame:
        key = lambda e: F.xxhash64(e["part"], *[F.col(c).bitwiseAND(e["m"][w]).bitwiseXOR(e["x"][w]) for w, c in enumerate(WORDS)])
        found = F.transform(F.array(*entries), lambda e: F.struct(e["part"].alias("part"), key(e).alias("bucket")))
        return fps.select(*keep, F.explode(found).alias("p")).select(*keep, "p.part", "p.bucket")

    flat = [(r * m + i, bits) for r, group in enumerate(parts) for i, bits in enumerate(group)]
    counted = materialize(probes([entry(i, b) for i, b in flat]).groupBy("part", "bucket").count().where("count > 1"), "bucket-sizes")
    twice = counted.groupBy("part").agg(F.sum(F.col("count").cast("double") * F.col("count")).alias("c"))
    pairs = {r["part"]: r["c"] for r in twice.collect()}  # one row a part
    freq = np.diag(both) / max(n, 1)
    entries, plain = [], True
    for r, group in enumerate(parts):
        cost = [part_cost(n, 2 * freq[b] * (1 - freq[b]), 2, n + pairs.get(r * m + i, 0.0)) for i, b in enumerate(group)]
        for i, t in enumerate(allocate(cost, 0)):
            bits = group[i]
            plain &= t == 0
            flips = [c for radius in range(-(-t // 2) + 1) for c in combinations(bits, radius)] if t >= 0 else []
            entries += [entry(r * m + i, bits, f) for f in flips]
    if not plain:
        counted = materialize(probes(entries).groupBy("part", "bucket").count().where("count > 1"), "bucket-sizes")
    hot = materialize(counted.where(F.col("count") > bucket_rows).select("bucket", F.lit(True).alias("hot")), "hot-buckets")
    rows = probes(entries, "name", *WORDS)
    calm = rows
    if hot.take(1):
        both_kinds = rows.join(broadcast_if_small(hot), "bucket", "left")
        calm = both_kinds.where("hot is null")

    def verify(batches):
        for t in key_runs(batches, ["bucket"]):
            f = np.column_stack([t.column(w).to_numpy() for w in WORDS]).view(np.uint64)
            e = bucket_edges(t.column("bucket").to_numpy(), t.column("name").to_numpy(), f, wide)
            yield pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(e[:, i])) for i in (0, 1)], names=["src", "dst"])

    sorted_rows = calm.select("bucket", "name", *WORDS).repartition("bucket").sortWithinPartitions("bucket")
    links = sorted_rows.mapInArrow(verify, "src long, dst long")
    if hot.take(1):
        members = rows.select("bucket", "name").join(broadcast_if_small(hot.select("bucket")), "bucket")
        least = members.groupBy("bucket").agg(F.min("name").alias("src"))
        links = links.unionByName(members.join(broadcast_if_small(least), "bucket").select("src", F.col("name").alias("dst")))
    return links.distinct()


def exact_links(sets: DataFrame, similarity: float, wide: int, group_shingles: int) -> DataFrame:
    """``(src, dst)`` edges between names that connect what links connect within each ``coarse`` group of ``sets``.

    A group whose sets hold up to ``group_shingles`` hashes is compared in one task. A larger one is cut
    into blocks of about half of that, and each pair of blocks is compared in a task of its own.
    """
    sizes = sets.groupBy("coarse").agg(F.sum("n").alias("total"), F.max("n").alias("most"))
    blocks = F.when(F.col("total") <= group_shingles, 1).otherwise(F.ceil(2 * F.col("total") / group_shingles)).cast("int")
    large = materialize(sizes.withColumn("blocks", blocks).where("blocks > 1").select("coarse", "blocks"), "large-groups")
    placed = sets.join(broadcast_if_small(large), "coarse", "left").withColumn("blocks", F.coalesce("blocks", F.lit(1)))
    own = F.pmod(F.xxhash64("name"), F.col("blocks")).cast("int")
    spread_out = placed.withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    # a pair of different blocks needs no look at what lies within one, but breadth first is cheaper with all
    keyed = spread_out.select("name", *WORDS, "hs", "coarse", F.least("own", "other").alias("x"), F.greatest("own", "other").alias("y"))
    keys = ["coarse", "x", "y"]

    def verify(batches):
        for t in key_runs(batches, keys):
            at = runs_of(*[t.column(k).to_numpy() for k in keys])
            names = t.column("name").to_numpy()
            f = np.column_stack([t.column(w).to_numpy() for w in WORDS]).view(np.uint64)
            lists = t.column("hs")
            edges = []
            for a, b in zip(at[:-1], at[1:]):
                if b - a > 1:
                    some = [x.values.to_numpy() for x in lists.slice(a, b - a)]
                    edges += exact_edges(names[a:b], f[a:b], some, similarity, wide)
            yield pa.RecordBatch.from_arrays([pa.array([e[i] for e in edges], pa.int64()) for i in (0, 1)], names=["src", "dst"])

    return keyed.repartition(*keys).sortWithinPartitions(*keys).mapInArrow(verify, "src long, dst long").distinct()


def similar_components(
    docs: DataFrame,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    shingle: int = 5,
    similarity: float = 0.8,
    recall: float = 0.98,
    bucket_rows: int = 4096,
    group_shingles: int = 1 << 20,
) -> DataFrame:
    """``(id, th, component, component_id)`` for each row: near-duplicates of whole texts, found by SimHash and checked exactly.

    Two texts link if the Jaccard similarity of their distinct shingles is ``similarity`` or more. Each
    set gets a 256-bit SimHash; the general pigeonhole principle finds candidates in groups of its
    bits (see :func:`plan_rounds`: at ``similarity`` itself a pair is found with a chance of ``recall``,
    more similar ones nearly always), distance sorts out chance meetings, and what is left is compared
    by its real sets. Texts with equal sets, and those without words, are one from the start.

    ``th`` is a hash of the text, which with the id tells rows apart; ``component`` names the component
    and ``component_id`` is its least id, null only if all are null. Repeated rows stay; an empty
    table gives an empty result; other columns are ignored.
    """
    p, size = differing(similarity), BITS * len(WORDS)
    wide = math.ceil(size * p + 3.5 * math.sqrt(size * p * (1 - p)))
    src = docs.select(F.col(id_col).alias("id"), F.xxhash64(text_col).alias("th"), F.col(text_col).cast("binary").alias("t"))
    prints = materialize(set_prints(src, shingle), "set-prints")
    first = F.min(F.struct(F.col("id").isNull().alias("z"), "id", "th")).alias("low")
    fps = materialize(prints.groupBy("name").agg(F.first("n").alias("n"), *[F.first(w).alias(w) for w in WORDS], first), "distinct-sets")
    coarse = materialize(star_components(coarse_links(fps.where("n > 0"), similarity, recall, wide, bucket_rows)), "coarse")
    grouped = coarse.select(F.col("id").alias("name"), F.col("component").alias("coarse"))
    chosen = fps.join(grouped, "name").select(F.col("low.id").alias("__id"), F.col("low.th").alias("__th"))
    texts = src.join(broadcast_if_small(chosen), F.col("id").eqNullSafe(F.col("__id")) & (F.col("th") == F.col("__th")), "left_semi")
    sets = materialize(set_prints(texts, shingle, sets=True).dropDuplicates(["name"]).join(grouped, "name"), "sets")
    roots = materialize(star_components(exact_links(sets, similarity, wide, group_shingles)), "roots")
    named = fps.join(roots.withColumnRenamed("id", "name"), "name", "left").select("name", "low", F.coalesce("component", "name").alias("component"))
    least = named.groupBy("component").agg(F.min("low").alias("least"))
    labels = materialize(named.join(least, "component").select("name", "component", F.col("least.id").alias("component_id")), "labels")
    return prints.join(labels, "name").select(F.col("id").alias(id_col), "th", "component", "component_id")
