"""Byte-level BPE token counts by a heap and a linked list; no identifiers are made."""

from __future__ import annotations

import json
from functools import lru_cache
from heapq import heapify, heappop, heappush

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

CACHE_WORDS = 1 << 19
CACHE_LENGTH = 64


def byte_symbols() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies.

    Bytes that are printable in Latin-1 stand for themselves; the others follow from U+0100 on.
    """
    shown = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    spare = iter(range(0x100, 0x200))
    return [chr(b) if b in shown else chr(next(spare)) for b in range(256)]


def merge_count(symbols: list[str], ranks: dict[tuple[str, str], int]) -> int:
    """How many symbols are left after all merges: pop the lowest-rank adjacent pair, leftmost first, again and again.

    Positions form a doubly linked list. A heap entry is stale if one of its sides has been merged
    since; stale entries are dropped when popped. O(n log n) for any length.
    """
    n = len(symbols)
    if n < 2:
        return n
    sym = list(symbols)
    after, before = [*range(1, n), -1], [*range(-1, n - 1)]
    heap = [(r, i, a, b) for i, (a, b) in enumerate(zip(sym, sym[1:])) if (r := ranks.get((a, b))) is not None]
    heapify(heap)
    merges = 0
    while heap:
        _, i, a, b = heappop(heap)
        j = after[i]
        if sym[i] != a or j < 0 or sym[j] != b:
            continue
        sym[i], sym[j] = a + b, ""
        merges += 1
        after[i] = k = after[j]
        if k >= 0:
            before[k] = i
            if (r := ranks.get((sym[i], sym[k]))) is not None:
                heappush(heap, (r, i, sym[i], sym[k]))
        if (h := before[i]) >= 0 and (r := ranks.get((sym[h], sym[i]))) is not None:
            heappush(heap, (r, h, sym[h], sym[i]))
    return n - merges


class TokenCounter:
    """Counts of a ``tokenizers`` JSON file of kind byte-level BPE, special tokens in the text included."""

    def __init__(self, path: str, pattern: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        if model["type"] != "BPE" or spec["pre_tokenizer"]["type"] != "ByteLevel" or spec["normalizer"]:
            raise ValueError("only byte-level BPE files without a normalizer are supported")
        pairs = (m if isinstance(m, list) else m.split(" ") for m in model["merges"])
        self.ranks = {tuple(p): i for i, p in enumerate(pairs)}
        self.symbol = byte_symbols()
        self.split = regex.compile(pattern).findall
        added = sorted((t["content"] for t in spec["added_tokens"]), key=len, reverse=True)
        self.special = regex.compile("|".join(map(regex.escape, added))) if added else None
        self.known: dict[str, int] = {}

    def word(self, w: str) -> int:
        symbols = self.symbol
        n = merge_count([symbols[b] for b in w.encode()], self.ranks)
        if len(w) <= CACHE_LENGTH:
            if len(self.known) >= CACHE_WORDS:  # memory stays bounded; counts don't depend on it
                self.known.clear()
            self.known[w] = n
        return n

    def plain(self, text: str) -> int:
        get, word, total = self.known.get, self.word, 0
        for w in self.split(text):
            total += get(w) or word(w)
        return total

    def count(self, text: str) -> int:
        if not self.special:
            return self.plain(text)
        total, at = 0, 0
        for m in self.special.finditer(text):
            total += self.plain(text[at : m.start()]) + 1
            at = m.end()
        return total + self.plain(text[at:] if at else text)


@lru_cache(maxsize=4)
def counter(path: str, pattern: str) -> TokenCounter:
    """One counter for each Python worker, so that its word cache lasts."""
    return TokenCounter(path, pattern)


def token_counts(
    docs: DataFrame, path: str, pattern: str, *, id_col: str = "doc_id", text_col: str = "text", limit: int = 512
) -> DataFrame:
    """``(id, n_bytes, n_tokens, over_limit)``, one row for each input row, in one scan without a shuffle.

    Counts equal the library's for the file at ``path`` without added begin or end tokens, truncation
    or padding; special strings in a text count as the file defines them. ``pattern`` is the
    pre-tokenizer's expression. A null text counts as empty: 0 bytes, 0 tokens. Repeated rows stay;
    an empty table gives an empty result; other columns are ignored.
    """

    def run(batches):
        c = counter(path, pattern)
        for b in batches:
            n = [c.count(t.as_py() or "") for t in b.column(2)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(n, pa.int64())], names=["id", "n_bytes", "n_tokens"])

    src = docs.select(
        F.col(id_col).alias("id"),
        F.coalesce(F.octet_length(text_col), F.lit(0)).cast("long").alias("n_bytes"),
        F.col(text_col).cast("string").alias("t"),
    )
    kind = src.schema["id"].dataType.simpleString()
    out = src.mapInArrow(run, f"id {kind}, n_bytes long, n_tokens long")
    return out.select(F.col("id").alias(id_col), "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
