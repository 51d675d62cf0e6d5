"""SentencePiece encoding as a max-plus parallel scan over chunks, and decoding."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from functools import lru_cache
from heapq import heapify, heappop, heappush

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import materialize

SPACE = "▁"
CACHE_WORDS = 1 << 20
CACHE_LENGTH = 48
NONE = -(1 << 60)  # no path


class PieceModel:
    """Pieces and scores of a SentencePiece BPE file with byte fallback, identity normaliser and a space in front."""

    def __init__(self, path: str):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        size = sp.get_piece_size()
        self.byte_ids = np.zeros(256, dtype=np.int32)
        self.raw: list[bytes] = [b""] * size
        self.score: dict[str, float] = {}
        self.ids: dict[str, int] = {}
        for i in range(size):
            piece = sp.id_to_piece(i)
            if sp.is_byte(i):
                self.byte_ids[int(piece[3:5], 16)] = i
                self.raw[i] = bytes([int(piece[3:5], 16)])
            elif not (sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i)):
                self.score[piece], self.ids[piece] = sp.get_score(i), i
                self.raw[i] = piece.replace(SPACE, " ").encode()
        if any(s != int(s) for s in self.score.values()):
            raise ValueError("only BPE files, whose scores are ranks, are supported")
        self.packed = {piece: np.int32(i).tobytes() for piece, i in self.ids.items()}
        self.reach = max(map(len, self.score))
        self.starts = {piece[:i] for piece in self.score for i in range(1, len(piece) + 1)}
        self.inside = {piece[i : i + 2] for piece in self.score for i in range(len(piece) - 1)}  # character pairs that some piece holds
        self.cut_at_space = not any(p[1] == SPACE and p[0] != SPACE for p in self.inside)
        self.cache: dict[str, bytes] = {}
        self.fits: dict[tuple[str, str], bool] = {}

    def fallback(self, c: str) -> bytes:
        """Packed ids of the bytes of a character outside the vocabulary."""
        return self.byte_ids[np.frombuffer(c.encode(), np.uint8)].tobytes()

    def merge(self, text: str) -> list[str]:
        """The symbols left of ``text`` when no two neighbours make a piece any more.

        The neighbours whose piece scores best merge first; of equal scores, the leftmost. The pairs lie
        in a heap, the symbols in a linked list.
        """
        known, n = self.score.get, len(text)
        size, after, before = [1] * n, list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(-s, i, 2) for i in range(n - 1) if (s := known(text[i : i + 2])) is not None]
        heapify(heap)
        while heap:
            _, i, both = heappop(heap)
            j = after[i]
            if not size[i] or j >= n or size[i] + size[j] != both:
                continue  # one of the two has merged since
            size[i], size[j] = both, 0
            after[i] = k = after[j]
            if k < n:
                before[k] = i
                if (s := known(text[i : i + both + size[k]])) is not None:
                    heappush(heap, (-s, i, both + size[k]))
            h = before[i]
            if h >= 0 and (s := known(text[h : i + both])) is not None:
                heappush(heap, (-s, h, size[h] + both))
        return [text[i : i + size[i]] for i in range(n) if size[i]]

    def adjacent(self, left: str, right: str) -> bool:
        """Whether ``left`` and ``right`` can follow each other: alone, their text gives just these two.

        Merges are ordered by score and place, so those inside a stretch between two final pieces' ends
        run as if it stood alone. Hence a row of pieces is a text's encoding if, and only if, all
        neighbours in it can follow each other. "" stands for a place that no piece lies across.
        """
        if not left or left[-1] + right[0] not in self.inside:
            return self.adjacent_none(right)
        key = left, right
        found = self.fits.get(key)
        if found is None:
            if len(self.fits) >= CACHE_WORDS:
                self.fits.clear()
            found = self.fits[key] = self.merge(left + right) == [left, right]
        return found

    def adjacent_none(self, piece: str) -> bool:
        return len(piece) == 1 or self.merge(piece) == [piece]

    def pieces_from(self, text: str, i: int) -> Iterator[int]:
        """Ends of the pieces of ``text`` that begin at ``i``; a character outside the vocabulary is one by itself."""
        if text[i] not in self.score:
            yield i + 1
        for j in range(i + 1, min(i + self.reach, len(text)) + 1):
            part = text[i:j]
            if part not in self.starts:
                break
            if part in self.score:
                yield j

    def states(self, text: str, at: int) -> list[tuple[int, int]]:
        """The pieces ``(begin, end)`` that begin before ``at`` and end there or later: the states of that boundary."""
        if at == 0:
            return [(0, 0)]
        return [(i, j) for i in range(max(0, at - self.reach), at) for j in self.pieces_from(text, i) if j >= at]

    def paths(self, text: str, begin: int, end: int, entries: list[tuple[int, int]]) -> dict[int, dict[int, np.ndarray]]:
        """Max-plus scores from each of ``entries`` to each piece that begins before ``end``, by its end and its begin.

        The score of a row of pieces is 0 if all neighbours can follow each other, else there is none.
        """
        node: dict[int, dict[int, np.ndarray]] = {}
        for k, (i, j) in enumerate(entries):
            start = np.full(len(entries), NONE, dtype=np.int64)
            start[k] = 0
            node.setdefault(j, {})[i] = start
        for i in range(begin, end):
            for j in self.pieces_from(text, i) if i in node else ():
                for h, score in node[i].items():
                    if self.adjacent(text[h:i], text[i:j]):
                        have = node.setdefault(j, {}).get(i)
                        node[j][i] = score if have is None else np.maximum(have, score)
        return node

    def cuts(self, text: str, begin: int, end: int) -> tuple[int, int] | None:
        """The first and the last place from ``begin`` to before ``end`` that no piece lies across."""
        safe = lambda i: i == 0 or text[i - 1 : i + 1] not in self.inside
        first = next((i for i in range(begin, end) if safe(i)), None)
        return None if first is None else (first, next(i for i in range(end - 1, first - 1, -1) if safe(i)))

    def transfer(self, text: str, begin: int, end: int) -> np.ndarray:
        """Max-plus transfer matrix of the chunk ``begin`` .. ``end`` of ``text``, from its states there to those at its end.

        ``text`` holds what lies within the reach of a piece around the chunk. If the chunk holds cuts,
        the matrix is the product of what leads to the first and what leads on from the last.
        """
        ins, outs = self.states(text, begin), self.states(text, end)
        found = self.cuts(text, begin, end)

        def leave(node: dict, entries: int) -> np.ndarray:
            none = np.full(entries, NONE, dtype=np.int64)
            return np.column_stack([node.get(j, {}).get(i, none) for i, j in outs])

        if found is None:
            return leave(self.paths(text, begin, end, ins), len(ins))
        first, last = found
        ends = self.paths(text, begin, first, ins).get(first, {})
        head = np.max([np.full(len(ins), NONE, dtype=np.int64), *ends.values()], axis=0)
        tail = leave(self.paths(text, last, end, [(last, last)]), 1)
        return np.maximum(head[:, None] + tail, NONE)

    def backtrace(self, text: str, entry: tuple[int, int], leave: tuple[int, int]) -> np.ndarray:
        """Ids of the pieces after ``entry`` up to ``leave``, the pieces at a chunk's boundaries."""
        first = text[entry[0] : entry[1]]
        return self.encode_whole(text[entry[0] : leave[1]])[0 if not first else 1 if first in self.ids else len(first.encode()) :]

    def words(self, text: str) -> list[str]:
        """Cut where no piece can lie across: before each run of spaces, or nowhere if the file has such pieces."""
        if not self.cut_at_space:
            return [text]
        parts = text.split(SPACE)
        if "" not in parts[1:-1] and parts[0] == "" and parts[-1] != "":
            return [SPACE + p for p in parts[1:]]  # single spaces only
        out, lead = [], ""
        for k, p in enumerate(parts):
            lead += SPACE if k else ""
            if p:
                out.append(lead + p)
                lead = ""
        return [*out, lead] if lead else out

    def encode_word(self, word: str) -> bytes:
        """Ids of a word between cuts as packed 32-bit numbers. It is cut again where no piece holds both characters."""
        out, a = [], 0
        for b in range(1, len(word) + 1):
            if b == len(word) or word[b - 1 : b + 1] not in self.inside:
                part = word[a:b]
                ids = self.cache.get(part)
                if ids is None:
                    ids = b"".join([self.packed.get(x) or self.fallback(x) for x in self.merge(part)])
                    self.keep(part, ids)
                out.append(ids)
                a = b
        joined = b"".join(out)
        self.keep(word, joined)
        return joined

    def keep(self, word: str, ids: bytes) -> None:
        if len(word) <= CACHE_LENGTH:
            if len(self.cache) >= CACHE_WORDS:  # memory stays bounded; results don't depend on it
                self.cache.clear()
            self.cache[word] = ids

    def encode_whole(self, text: str) -> np.ndarray:
        """Ids of a text that is one chunk."""
        get, encode = self.cache.get, self.encode_word
        return np.frombuffer(b"".join([get(w) or encode(w) for w in self.words(text)]), dtype=np.int32)

    def decode(self, ids) -> str:
        raw = self.raw
        return b"".join([raw[i] for i in ids])[1:].decode("utf-8", "replace")


def combine(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Max-plus product: associative, with ``NONE`` as its zero."""
    best = (a[..., :, :, None] + b[..., None, :, :]).max(axis=-2)
    return np.maximum(best, NONE)


def fold(matrices: list[np.ndarray]) -> np.ndarray:
    """The product of matrices in order, as a balanced tree; any grouping gives the same."""
    while len(matrices) > 1:
        matrices = [combine(*matrices[i : i + 2]) if i + 1 < len(matrices) else matrices[i] for i in range(0, len(matrices), 2)]
    return matrices[0]


def boundary_states(matrices: list[np.ndarray], entry: int = 0, leave: int | None = None) -> list[tuple[int, int]]:
    """``(entry, leave)`` of each matrix on the path from state ``entry`` before the first to ``leave`` after the last.

    A prefix scan carries the score of each boundary state; then the states are read backwards. There
    is one path at most between two states. Without ``leave``, it is the state that has one.
    """
    at = np.full((1, len(matrices[0])), NONE, dtype=np.int64)
    at[0, entry] = 0
    prefix = [at]
    for m in matrices:
        prefix.append(combine(prefix[-1], m))
    state = int(np.argmax(prefix[-1][0])) if leave is None else leave
    out = []
    for m, before in zip(reversed(matrices), reversed(prefix[:-1])):
        came = int(np.argmax(before[0] + m[:, state]))
        out.append((came, state))
        state = came
    return out[::-1]


@lru_cache(maxsize=2)
def model(path: str) -> PieceModel:
    """One model for each Python worker, so that its cache lasts."""
    return PieceModel(path)


def prepared(text: str) -> str:
    """Spaces become U+2581, with one more in front."""
    return SPACE + text.replace(" ", SPACE) if text else ""


def _matrix(cell: dict) -> np.ndarray:
    return np.frombuffer(cell["m"], np.int64).reshape(cell["rows"], -1)


def encode_pieces(
    docs: DataFrame, path: str, *, id_col: str = "doc_id", text_col: str = "text", chunk_chars: int = 1 << 15, group_chunks: int = 64
) -> DataFrame:
    """``(id, ids, n_pieces, n_chars, round_trip)``, one row for each input row.

    ``ids`` are those that the library gives for the file, whatever ``chunk_chars`` and
    ``group_chunks`` are: merges are ordered by score, then by place, so a text has one encoding.
    Characters outside the vocabulary become byte pieces, so decoding gives the very text back;
    ``round_trip`` says whether it did (not for a text that itself holds U+2581, which the format uses
    for the space). A null text counts as empty: no ids. Repeated rows stay; an empty table gives an
    empty result; other columns are ignored.

    Texts up to ``chunk_chars`` are one chunk and are encoded where they are read. Longer ones are cut
    into chunks, which travel with the characters that a piece can reach around them. Every chunk
    yields its max-plus matrix in parallel; matrices are multiplied in groups, in parallel too, the
    groups' products give the states between groups, and these the states between chunks. The
    chunks are then traced back independently.
    """
    src = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("t"))
    kind = src.schema["id"].dataType.simpleString()
    whole = F.coalesce(F.length("t") <= chunk_chars, F.lit(True))

    def direct(batches):
        m = model(path)
        for b in batches:
            texts = [t.as_py() or "" for t in b.column(1)]
            parts = [m.encode_whole(prepared(t)) for t in texts]
            ok = [m.decode(p.tolist()) == t for p, t in zip(parts, texts)]
            ends = np.cumsum([0, *map(len, parts)], dtype=np.int32)
            ids = pa.ListArray.from_arrays(ends, pa.array(np.concatenate([np.zeros(0, np.int32), *parts])))
            yield pa.RecordBatch.from_arrays([b.column(0), ids, pa.array(map(len, texts), pa.int64()), pa.array(ok)], names=["id", "ids", "n_chars", "round_trip"])

    short = src.where(whole).mapInArrow(direct, f"id {kind}, ids array<int>, n_chars long, round_trip boolean")

    def cut(batches):
        reach = model(path).reach
        for b in batches:
            for key, t in zip(b.column(0), b.column(1)):
                text, uid, plain = prepared(t.as_py()), uuid.uuid4().hex, SPACE not in t.as_py()
                starts = range(0, len(text), chunk_chars)
                rows = []
                for k, a in enumerate(starts):
                    low, end = max(0, a - reach), min(a + chunk_chars, len(text))
                    rows.append((uid, k, a - low, end - low, plain, text[low : end + reach]))
                kinds = [pa.string(), pa.int32(), pa.int32(), pa.int32(), pa.bool_(), pa.string()]
                for i in range(0, len(rows), 64):
                    part = list(zip(*rows[i : i + 64]))
                    columns = [pa.array([key.as_py()] * len(part[0]), b.schema.field(0).type), *map(pa.array, part, kinds)]
                    yield pa.RecordBatch.from_arrays(columns, names=["id", "uid", "k", "a", "z", "plain", "t"])

    # written, as the text's number is drawn anew by every run
    chunks = materialize(src.where(~whole).mapInArrow(cut, f"id {kind}, uid string, k int, a int, z int, plain boolean, t string"), "chunks")

    def matrices(batches):
        m = model(path)
        for b in batches:
            mats = [m.transfer(r["t"], r["a"], r["z"]) for r in b.to_pylist()]
            cells = [pa.array([len(x) for x in mats], pa.int32()), pa.array([x.tobytes() for x in mats], pa.binary())]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), *cells], names=["uid", "k", "rows", "m"])

    moves = materialize(chunks.select("uid", "k", "a", "z", "t").mapInArrow(matrices, "uid string, k int, rows int, m binary"), "matrices")
    grouped = moves.withColumn("g", F.floor(F.col("k") / group_chunks).cast("int"))

    def product(table):
        first = table.slice(0, 1)
        m = fold([_matrix(x) for x in table.sort_by("k").to_pylist()])
        return pa.table({"uid": first["uid"], "g": first["g"], "rows": pa.array([len(m)], pa.int32()), "m": pa.array([m.tobytes()], pa.binary())})

    products = grouped.groupBy("uid", "g").applyInArrow(product, "uid string, g int, rows int, m binary")

    def between(table):
        t = table.sort_by("g")
        states = boundary_states([_matrix(x) for x in t.to_pylist()])
        return pa.table({"uid": t["uid"], "g": t["g"], "entry": pa.array([s for s, _ in states], pa.int32()), "leave": pa.array([e for _, e in states], pa.int32())})

    outer = products.groupBy("uid").applyInArrow(between, "uid string, g int, entry int, leave int")

    def inner(table):
        t = table.sort_by("k")
        states = boundary_states([_matrix(x) for x in t.to_pylist()], t["entry"][0].as_py(), t["leave"][0].as_py())
        return pa.table({"uid": t["uid"], "k": t["k"], "entry": pa.array([s for s, _ in states], pa.int32()), "leave": pa.array([e for _, e in states], pa.int32())})

    states = grouped.join(outer, ["uid", "g"]).groupBy("uid", "g").applyInArrow(inner, "uid string, k int, entry int, leave int")

    def trace(batches):
        m = model(path)
        for b in batches:
            ids, raw = [], []
            for r in b.to_pylist():
                text, a, z = r["t"], r["a"], r["z"]
                ids.append(m.backtrace(text, m.states(text, a)[r["entry"]], m.states(text, z)[r["leave"]]))
                raw.append(text[a:z])
            ends = np.cumsum([0, *map(len, ids)], dtype=np.int32)
            lists = pa.ListArray.from_arrays(ends, pa.array(np.concatenate([np.zeros(0, np.int32), *ids])))
            yield pa.RecordBatch.from_arrays([*b.columns[:4], lists, pa.array(raw, pa.string())], names=["id", "uid", "k", "plain", "ids", "raw"])

    traced = chunks.join(states, ["uid", "k"]).select("id", "uid", "k", "plain", "a", "z", "t", "entry", "leave").mapInArrow(trace, f"id {kind}, uid string, k int, plain boolean, ids array<int>, raw string")
    ordered = F.array_sort(F.collect_list(F.struct("k", "ids", "raw")))
    gathered = traced.groupBy("uid").agg(F.first("id").alias("id"), F.first("plain").alias("plain"), ordered.alias("c"))
    gathered = gathered.select("id", F.flatten("c.ids").alias("ids"), F.array_join("c.raw", "").alias("t"), "plain")

    def check(batches):
        m = model(path)
        for b in batches:
            texts = b.column(2).to_pylist()
            ok = [p.as_py() and prepared(m.decode(i.as_py())) == t for i, t, p in zip(b.column(1), texts, b.column(3))]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array([len(t) - 1 for t in texts], pa.int64()), pa.array(ok)], names=["id", "ids", "n_chars", "round_trip"])

    long = gathered.mapInArrow(check, f"id {kind}, ids array<int>, n_chars long, round_trip boolean")
    return short.unionByName(long).select(F.col("id").alias(id_col), "ids", F.size("ids").cast("long").alias("n_pieces"), "n_chars", "round_trip")


def decode_pieces(ids: Column, path: str) -> Column:
    """The text of an array of piece ids; null for a null."""

    @F.pandas_udf("string")
    def run(s):
        m = model(path)
        return s.map(lambda x: None if x is None else m.decode(x))

    return run(ids)
