"""Personal data: exact base patterns, widened by bootstrapped contextual extraction."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import broadcast_if_small, materialize

KINDS = ("email", "ip", "card", "phone")
ADDED = (*KINDS, "secret")  # kinds that the method can add
LOCAL = re.compile(r"[A-Za-z0-9._%+-]+")
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
DOTTED = re.compile(r"[0-9]++(?:\.[0-9]++)*+")
CARD = re.compile(r"[0-9](?:[\x20-]?+[0-9])++")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
WORD = re.compile(r"[^\x20\x09-\x0D]+")
MARKED = re.compile(r"[0-9@]")
NUMERIC = re.compile(r"[0-9()+./-]*[0-9][0-9()+./-]*")
NUMBER = re.compile(r"[0-9](?:[\x20-]?[0-9])*")
QUAD = re.compile(r"[0-9]+(?:\.[0-9]+){3}")
HEX = re.compile(r"[0-9a-fA-F]{32,}")
DIGITS = re.compile(r"[0-9]")
LOCAL_CHARS = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
WHITE = " \t\n\x0b\x0c\r"


def emails(text: str) -> Iterator[tuple[int, int]]:
    """Leftmost non-overlapping matches, found from each at sign, so that long runs cost linear time."""
    end, at = 0, text.find("@")
    while at >= 0:
        if at > end and text[at - 1] in LOCAL_CHARS and (m := DOMAIN.match(text, at + 1)):
            start = at - 1
            while start > end and text[start - 1] in LOCAL_CHARS:
                start -= 1
            end = m.end()
            yield start, end
        at = text.find("@", max(at + 1, end))


def ips(text: str) -> Iterator[tuple[int, int]]:
    """Four dotted numbers at a time along each maximal dotted chain; those with a part over 255 are dropped."""
    for m in DOTTED.finditer(text):
        if m.group().count(".") < 3:
            continue
        at, parts = m.start(), m.group().split(".")
        for i in range(0, len(parts) - 3, 4):
            four = parts[i : i + 4]
            size = sum(map(len, four)) + 3
            if all(len(p := x.lstrip("0")) <= 3 and int(p or 0) <= 255 for x in four):
                yield at, at + size
            at += size + 1


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        total += d if i % 2 == 0 else (2 * d if d < 5 else 2 * d - 9)
    return total % 10 == 0


def cards(text: str) -> Iterator[tuple[int, int]]:
    for m in CARD.finditer(text):
        if m.end() - m.start() >= 12:
            digits = m.group().replace(" ", "").replace("-", "")
            if 12 <= len(digits) <= 19 and luhn(digits):
                yield m.span()


def phones(text: str) -> Iterator[tuple[int, int]]:
    for m in PHONE.finditer(text):
        if 9 <= len(DIGITS.findall(m.group())) <= 15:
            yield m.span()


FINDERS = dict(zip(KINDS, (emails, ips, cards, phones)))


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """``(start, kind, end)`` of all base matches in order; kinds by their place in ``KINDS``."""
    return sorted((s, k, e) for k, name in enumerate(KINDS) for s, e in FINDERS[name](text))


def spell(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in sorted(spans))


def shape(token: str) -> str:
    """The character classes of a token, its other ASCII marks, and its length to the next power of two."""
    kinds = {"9" if c.isdigit() else "a" if c.isalpha() else c if c < "\x7f" else "u" for c in token}
    return "".join(sorted(kinds)) + str(len(token).bit_length())


def refused(token: str) -> str | None:
    """The kind whose form a token has, but whose check it fails: it is evidence against that kind."""
    if QUAD.fullmatch(token):
        return "ip"
    if NUMBER.fullmatch(token) and 12 <= len(DIGITS.findall(token)) <= 19:
        return "card"
    return "phone" if token.startswith("+") and not 9 <= len(DIGITS.findall(token)) <= 15 else None


def seed_of(token: str) -> str | None:
    """Seeds besides the base matches: long hexadecimal strings with letters and digits may be secrets."""
    return "secret" if HEX.fullmatch(token) and not token.isdigit() and MARKED.search(token) else None


def segments(text: str, base: list[tuple[int, int, int]]) -> list[tuple[int, int, int | None]]:
    """``(start, end, kind)``: the words of a text in order, cut at base spans, which are one each whatever they hold.

    Punctuation around a word is left out unless the word is nothing else. Neighbouring numeric words are
    one, ``555 123 4567``, if one white space lies between and they have the digits of a phone number.
    """
    out: list[tuple[int, int, int | None]] = []
    at, k = 0, 0
    merged: list[tuple[int, int, int]] = []  # base spans can overlap: the first of those that do counts
    for s, kind, e in base:
        if not merged or s >= merged[-1][2]:
            merged.append((s, kind, e))
    for s, kind, e in [*merged, (len(text), -1, len(text))]:
        for m in WORD.finditer(text, at, s):
            a, z, word = m.start(), m.end(), m.group()
            if inner := word.strip("\"'()[]{}<>,;:!?.#$%&*|"):
                a += word.index(inner)
                z = a + len(inner)
            out.append((a, z, None))
        if kind >= 0:
            out.append((s, e, kind))
        at = e
    joined: list[tuple[int, int, int | None]] = []
    while k < len(out):
        s, e, kind = out[k]
        n = k + 1
        if kind is None and NUMERIC.fullmatch(text, s, e):
            digits = len(DIGITS.findall(text, s, e))
            while n < len(out) and out[n][2] is None and (gap := text[out[n - 1][1] : out[n][0]].strip("()")) in WHITE and len(gap) == 1 and NUMERIC.fullmatch(text, *out[n][:2]):
                digits += len(DIGITS.findall(text, *out[n][:2]))
                n += 1
            if n - k > 1 and 7 <= digits <= 15:
                e = out[n - 1][1]
            else:
                n = k + 1
        joined.append((s, e, kind))
        k = n
    return joined


def context_word(text: str, span: tuple[int, int, int | None]) -> str:
    """A neighbour as patterns see it: a base match by its kind, any word whole (a long one by its hash)."""
    if span[2] is not None:
        return f"<{KINDS[span[2]]}>"
    word = text[span[0] : span[1]].lower()
    return word if len(word) <= 32 else hashlib.md5(word.encode()).hexdigest()


def patterns_of(text: str, spans: list, i: int) -> list[str]:
    """The lexical patterns around a span: the words on both sides, two on the left, and one of either with the span's shape."""
    left = context_word(text, spans[i - 1]) if i else ""
    right = context_word(text, spans[i + 1]) if i + 1 < len(spans) else ""
    form = shape(text[spans[i][0] : spans[i][1]])
    out = [f"{left} * {right}"] if left and right else []
    if i > 1:
        out.append(f"{context_word(text, spans[i - 2])} {left} *")
    if left:
        out.append(f"{left} * {form}")
    if right:
        out.append(f"* {right} {form}")
    return out


MENTIONS = "id {kind}, th long, base string, start int, end int, token string, patterns array<string>, seed string, refused string"


def mentions(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """One row for each document (``start`` null) with its base spans, and one for each identifier-like span with its patterns.

    Spans are the base matches (``seed`` is their kind) and all other words that hold a digit or an at
    sign; ``seed`` of these is set for likely secrets, ``refused`` for the kind whose check one fails.
    """

    def run(batches):
        for b in batches:
            out: list[tuple] = []
            for key, th, cell in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2)):
                text = cell.as_py() or ""
                base = base_spans(text)
                out.append((key, th, spell(base), None, None, None, None, None, None))
                spans = segments(text, base) if MARKED.search(text) else []
                for i, (s, e, kind) in enumerate(spans):
                    if kind is None and not MARKED.search(text, s, e):
                        continue
                    token = text[s:e]
                    seed = seed_of(token) if kind is None else KINDS[kind]
                    name = hashlib.md5(token.encode()).hexdigest()
                    out.append((key, th, None, s, e, name, patterns_of(text, spans, i), seed, refused(token) if kind is None else None))
            if not out:
                continue
            schema = pa.schema([b.schema.field(0), *fields])
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), schema)], schema=schema)

    types = {"th": pa.int64(), "start": pa.int32(), "end": pa.int32(), "patterns": pa.list_(pa.string())}
    fields = [pa.field(n, types.get(n, pa.string())) for n in ("th", "base", "start", "end", "token", "patterns", "seed", "refused")]
    src = docs.select(F.col(id_col).alias("id"), F.xxhash64(text_col).alias("th"), F.col(text_col).alias("t"))
    return src.mapInArrow(run, MENTIONS.format(kind=src.schema["id"].dataType.simpleString()))


def bootstrap(seen: DataFrame, rounds: int, min_support: int, min_confidence: float) -> DataFrame:
    """``(kind, pattern, confidence)``: patterns learned from seeds over ``rounds`` of the pattern-instance graph.

    ``seen`` is a table of (token, patterns, seed). Each round scores a pattern, for one kind, by the
    share of its distinct instances that are believed to be of the kind, needs ``min_support`` such
    instances, and then believes in an instance as much as in its best pattern. Seeds are believed in
    for good.
    """
    believed = seen.where("seed is not null").groupBy("token", F.col("seed").alias("kind")).agg(F.lit(1.0).alias("belief"))
    edges = materialize(seen.select("token", F.explode("patterns").alias("pattern")).distinct(), "pattern-edges")
    size = materialize(edges.groupBy("pattern").agg(F.count(F.lit(1)).alias("instances")), "pattern-sizes")
    for i in range(rounds):
        score = (
            edges.join(believed, "token")
            .groupBy("kind", "pattern")
            .agg(F.sum("belief").alias("mass"), F.count(F.when(F.col("belief") >= min_confidence, 1)).alias("support"))
            .where(F.col("support") >= min_support)
            .join(size, "pattern")
            .withColumn("confidence", F.col("mass") / F.col("instances"))
            .where(F.col("confidence") >= min_confidence)
        )
        patterns = materialize(score.select("kind", "pattern", "confidence"), "patterns")
        if i + 1 == rounds or not patterns.take(1):
            return patterns
        gained = edges.join(broadcast_if_small(patterns), "pattern").select("token", "kind", F.col("confidence").alias("belief"))
        believed = believed.unionByName(gained).groupBy("token", "kind").agg(F.max("belief").alias("belief"))
    raise ValueError("rounds must be positive")


def find_pii(
    docs: DataFrame,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    rounds: int = 3,
    min_support: int = 5,
    min_confidence: float = 0.8,
) -> DataFrame:
    """``(id, th, base, spans)``, one row for each input row: base spans and all spans, as kind:start:end lists.

    Positions are code points, ends exclusive, ordered by start, then kind. Added spans are of a base kind
    or secrets; what has the form of a base kind but fails its check is never added as one. Likely
    secrets only count if a pattern confirms them. A null text counts as
    empty. Repeated rows stay, each with its spans; an empty table gives an empty result; other
    columns are ignored.

    Scale: one scan finds base spans and identifier-like words in context; only these narrow rows
    are shuffled, as distinct (instance, pattern) edges, so one text copied a million times counts
    once. Patterns are kept by score alone, with no limit on their number or on instances.
    """
    found = materialize(mentions(docs, id_col, text_col), "mentions")
    spans = found.where("start is not null")
    patterns = bootstrap(spans.select("token", "patterns", "seed"), rounds, min_support, min_confidence)
    matched = (
        spans.where(F.col("seed").isNull() | ~F.col("seed").isin(*KINDS))
        .select("id", "th", "start", "end", "refused", F.explode("patterns").alias("pattern"))
        .join(broadcast_if_small(patterns), "pattern")
        .where("refused is null or refused != kind")
    )
    best = matched.groupBy("id", "th", "start", "end").agg(F.max_by("kind", F.struct("confidence", "kind")).alias("kind"))
    added = best.select(
        "id", "th", F.lit(None).cast("string").alias("base"), F.concat_ws(":", "kind", F.col("start").cast("string"), F.col("end").cast("string")).alias("more")
    )
    rows = found.where("start is null").select("id", "th", "base", F.lit(None).cast("string").alias("more"))
    merged = (
        rows.unionByName(added)
        .groupBy("id", "th")
        .agg(F.max("base").alias("base"), F.count("base").alias("rows"), F.collect_set("more").alias("more"))
    )
    parts = F.concat(F.filter(F.split("base", ","), lambda x: x != ""), F.col("more"))
    rank = F.create_map(*[x for i, k in enumerate(ADDED) for x in (F.lit(k), F.lit(i))])
    keyed = F.transform(
        parts,
        lambda x: F.named_struct(
            F.lit("s"), F.split(x, ":")[1].cast("int"), F.lit("k"), F.element_at(rank, F.split(x, ":")[0]), F.lit("x"), x
        ),
    )
    return merged.select(
        F.col("id").alias(id_col),
        "th",
        "base",
        F.array_join(F.transform(F.array_sort(keyed), lambda y: y["x"]), ",").alias("spans"),
        F.size("more").cast("long").alias("n_added"),
        F.explode(F.sequence(F.lit(1).cast("long"), F.col("rows"))).alias("copy"),
    ).drop("copy")


def redact(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """``docs`` with all personal data in ``text_col`` replaced by its kind in brackets; columns and rows stay.

    Overlapping spans are replaced as one, by the kind of the first. Texts without any are left as
    they are, nulls too. An ``n_chars`` column follows the text.
    """

    found = find_pii(docs, id_col=id_col, text_col=text_col, **options)
    spans = found.where("spans != ''").select(F.col(id_col).alias("__id"), F.col("th").alias("__th"), F.col("spans").alias("__spans")).distinct()

    @F.pandas_udf("string")
    def masked(t, spans):
        import pandas as pd

        out = []
        for text, found_spans in zip(t, spans):
            pieces, at = [], 0
            for x in found_spans.split(",") if found_spans else ():
                kind, start, end = x.split(":")
                if int(start) >= at:
                    pieces += [text[at : int(start)], f"[{kind.upper()}]"]
                at = max(at, int(end))
            out.append("".join([*pieces, text[at:]]) if pieces else text)
        return pd.Series(out, dtype=object)

    same = (F.col("__id").eqNullSafe(F.col(id_col))) & (F.col("__th") == F.xxhash64(text_col))
    joined = docs.join(broadcast_if_small(spans), same, "left")
    text = F.when(F.col("__spans").isNull(), F.col(text_col)).otherwise(masked(F.col(text_col), F.col("__spans")))
    out = joined.withColumn(text_col, text)
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.length(text_col).cast(docs.schema["n_chars"].dataType))
    return out.select(*docs.columns)
