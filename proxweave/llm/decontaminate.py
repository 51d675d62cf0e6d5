"""Benchmark decontamination by a prefix-filtered set join. DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import broadcast_if_small, materialize, small_enough

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
NO_WORD = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def words_of(text: Column) -> Column:
    """Runs of a-z, 0-9 and non-ASCII characters, after lower-casing A-Z; none of a null."""
    return F.filter(F.split(F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER), NO_WORD), lambda w: w != "")


def benchmark_windows(benchmark: DataFrame, window: int, item_col: str, text_col: str) -> DataFrame:
    """``(item, win)``: each run of ``window`` consecutive words of an item; a shorter item is one window.

    ``item`` is a struct of the id, as a null id has windows too, but is no item to name.
    """
    items = benchmark.select(F.struct(F.col(item_col).alias("id")).alias("item"), words_of(F.col(text_col)).alias("w"))
    starts = F.sequence(F.lit(1), F.greatest(F.size("w") - (window - 1), F.lit(1)))
    return (
        items.where(F.size("w") > 0)
        .select("item", F.explode(F.transform(starts, lambda s: F.slice("w", s, window))).alias("win"))
        .distinct()
    )


def prefixes(windows: DataFrame, rarity: DataFrame) -> DataFrame:
    """``(win, items, word, at)``: each distinct window with its rarest word and that word's first place.

    A text contains a window only if it contains all its words, so of the words ordered by rarity a
    prefix of one is necessary and enough to find every candidate.
    """
    distinct = windows.groupBy("win").agg(F.collect_set("item").alias("items"))
    ranked = (
        distinct.select("win", "items", F.posexplode("win").alias("at", "word"))
        .join(broadcast_if_small(rarity), "word", "left")
        .withColumn("rank", F.row_number().over(Window.partitionBy("win").orderBy(F.coalesce("n", F.lit(0)), "word", "at")))
    )
    return ranked.where("rank = 1").select("win", "items", "word", "at")


def contaminated_spans(
    docs: DataFrame,
    benchmark: DataFrame,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_col: str = "text",
    window: int = 10,
    broadcast_bytes: int = 16 << 20,
) -> DataFrame:
    """``(id, th, rows, n_words, spans)`` for each distinct (id, text): merged word spans and items found.

    ``spans`` is an array of ``(start, n, items)``, one for each window occurrence; ``rows`` says how
    many input rows have that id and text; ``th`` is a hash of the text.

    Method: the words of all benchmark windows are counted over all documents; each window joins on
    its rarest word only. A document's word list is exploded inside one code-generated stage and
    probed against these prefixes. The window must fit (position and length bounds) and then equal
    the document's slice. An extra empty word at each list's end carries the word count, so that one
    scan serves both. The prefix table is broadcast if its estimated size is small. Beyond that single
    words and their places are shuffled, never a document's words beside each; AQE splits hot words.
    What meets is then compared with the documents' words, once for each document that has any.
    """
    windows = materialize(benchmark_windows(benchmark, window, item_col, item_text_col), "windows")
    vocabulary = windows.select(F.explode("win").alias("word")).distinct()
    texts = docs.select(F.col(id_col).alias("id"), F.xxhash64(text_col).alias("th"), words_of(F.col(text_col)).alias("w"))
    every = texts.select(F.explode("w").alias("word"))
    rarity = every.join(broadcast_if_small(vocabulary, broadcast_bytes), "word").groupBy("word").agg(F.count(F.lit(1)).alias("n"))
    first = materialize(prefixes(windows, materialize(rarity, "rarity")), "prefixes")
    start = F.col("pos") - F.col("at")
    fits = (start >= 0) & (start + F.size("win") <= F.col("n_words"))
    here = F.slice("w", F.greatest(start, F.lit(0)) + 1, F.size("win")) == F.col("win")
    if not small_enough(first, broadcast_bytes):
        placed = texts.select("id", "th", F.size("w").alias("n_words"), F.posexplode("w").alias("pos", "word"))
        near = placed.join(first.hint("merge"), "word").where(fits).select("id", "th", "pos", "at", "win", "items").distinct()
        near = materialize(near, "candidates")
        match = F.col("id").eqNullSafe(F.col("__id")) & (F.col("th") == F.col("__th"))
        has = near.select(F.col("id").alias("__id"), F.col("th").alias("__th")).distinct()
        wanted = texts.join(has, match, "left_semi").dropDuplicates(["id", "th"]).select(F.col("id").alias("__id"), F.col("th").alias("__th"), "w")
        spans = near.join(wanted, match).where(here).select("id", "th", F.lit(None).cast("int").alias("end"), start.alias("start"), F.size("win").alias("n"), "items")
        ends = texts.select("id", "th", F.size("w").alias("end"), *[F.lit(None).cast(spans.schema[c].dataType).alias(c) for c in ("start", "n", "items")])
        return ends.unionByName(spans)
    end = docs.sparkSession.range(1).select(
        F.lit(None).cast("array<string>").alias("win"), F.lit(None).cast(first.schema["items"].dataType).alias("items"), F.lit("").alias("word"), F.lit(0).alias("at")
    )
    probe = F.broadcast(first.unionByName(end))  # as large as the table checked above, but for one row
    placed = texts.select("id", "th", "w", F.size("w").alias("n_words"), F.posexplode(F.concat("w", F.array(F.lit("")))).alias("pos", "word"))
    return (
        placed.join(probe, "word")
        .where((F.col("word") == "") | (fits & here))
        .select("id", "th", F.when(F.col("word") == "", F.col("n_words")).alias("end"), start.alias("start"), F.size("win").alias("n"), "items")
    )


def decontaminate(docs: DataFrame, benchmark: DataFrame, *, id_col: str = "doc_id", **options) -> DataFrame:
    """``(id, th, n_words, n_hit, n_items, item_ids, contaminated)``, one row for each input row; ``th`` is a hash of the text.

    A document word is hit if it lies in any occurrence of a benchmark window (``window`` words; a
    shorter item, not an empty one, is one window). Rows without words have zeros; null texts have no
    windows; items without an id count as one item, which ``item_ids`` leaves out; rows that repeat an id and text get equal results; rows that share an id
    but not a text are kept apart; an empty table gives an empty result, an empty benchmark no hits.
    Other columns are ignored. Hits of one document are counted by (document, span) first, so a text
    full of passages isn't gathered before it is merged.
    """
    found = contaminated_spans(docs, benchmark, id_col=id_col, **options)
    # one row for each document and occurrence, and for each document its end mark
    spans = found.groupBy("id", "th", "end", "start", "n").agg(
        F.count(F.lit(1)).alias("times"), F.array_distinct(F.flatten(F.collect_set("items"))).alias("items")
    )
    merged = spans.groupBy("id", "th").agg(
        F.max("end").cast("long").alias("n_words"),
        F.max(F.when(F.col("end").isNotNull(), F.col("times"))).alias("rows"),
        F.array_sort(F.collect_list(F.when(F.col("end").isNull(), F.struct("start", "n")))).alias("s"),
        F.array_distinct(F.flatten(F.collect_set("items"))).alias("items"),
    )
    # spans sorted by start: each adds what lies beyond the farthest end so far
    zero = F.struct(F.lit(0).cast("long").alias("hit"), F.lit(0).alias("to"))
    step = lambda a, x: F.struct(
        (a["hit"] + F.greatest(x["start"] + x["n"] - F.greatest(a["to"], x["start"]), F.lit(0))).cast("long").alias("hit"),
        F.greatest(a["to"], x["start"] + x["n"]).alias("to"),
    )
    out = merged.select(
        F.col("id").alias(id_col),
        "th",
        "n_words",
        F.aggregate("s", zero, step)["hit"].alias("n_hit"),
        F.size("items").cast("long").alias("n_items"),
        F.array_compact(F.transform("items", lambda x: x["id"])).alias("item_ids"),
        F.explode(F.sequence(F.lit(1).cast("long"), F.col("rows"))).alias("copy"),
    ).drop("copy")
    return out.withColumn("contaminated", F.col("n_hit") > 0)
