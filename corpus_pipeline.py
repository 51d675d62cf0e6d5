"""A corpus pipeline of five stages, each an operator of ``proxweave.llm`` over all that the stage before kept.

Every stage takes ``(spark, docs, sf_dir)``; its result is written as Parquet and read again as the
next one's ``docs``. A document is a ``doc_id`` with a text: null ids are ids of their own, and rows
that share an id but not a text are judged apart. Rows that repeat both are one group of copies. All
stages but the last return the columns of ``docs``; an empty table stays empty.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from proxweave.llm.decontaminate import decontaminate
from proxweave.llm.pii import redact
from proxweave.llm.pu_quality import pu_quality
from proxweave.llm.sentence_pieces import encode_pieces
from proxweave.llm.simhash import similar_components
from proxweave.session import broadcast_if_small, drop_table, materialize, table

# Near-duplicates share this part of their distinct five-word shingles, or more (Jaccard).
SIMILARITY = 0.8


def _same(docs: DataFrame, found: DataFrame, how: str) -> DataFrame:
    """``docs`` joined with the rows ``(doc_id, th)`` of an operator's result that have the same id and text."""
    rows = found.select(F.col("doc_id").alias("__id"), F.col("th").alias("__th"))
    match = F.col("doc_id").eqNullSafe(F.col("__id")) & (F.xxhash64("text") == F.col("__th"))
    return docs.join(broadcast_if_small(rows), match, how)


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier accepts."""
    fold = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(1)) % 5
    scored = pu_quality(docs, table(spark, sf_dir, "labels"), trainable=fold != 0)
    return _same(docs, scored.where("predicted = 0"), "left_anti")


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group: that with the least id (no id only if none has one)."""
    found = materialize(similar_components(docs, shingle=5, similarity=SIMILARITY), "near-duplicates")
    order = F.struct(F.col("doc_id").isNull().alias("z"), "doc_id", "th")
    rows = found.groupBy("component").agg(F.min(order).alias("low"))
    stays = rows.select("low.doc_id", "low.th")
    twice = found.groupBy("doc_id", "th").count().where("count > 1")
    kept = _same(docs, stays, "left_semi")
    if not twice.take(1):
        return kept
    # only rows that repeat an id and its text need a shuffle of whole rows
    again = materialize(twice.select("doc_id", "th"), "repeated-rows")
    return _same(kept, again, "left_anti").unionByName(_same(kept, again, "left_semi").dropDuplicates(["doc_id", "text"]))


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without any benchmark window."""
    found = decontaminate(docs, table(spark, sf_dir, "benchmark"))
    return _same(docs, found.where("contaminated"), "left_anti")


def privacy(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with personal data replaced by the name of its kind."""
    return redact(docs)


def pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Piece ids of every document."""
    return encode_pieces(docs, public_tokenizers.path("piece_bpe_32k.model"))


STAGES = [
    ("quality classifier", quality),
    ("simhash near-dedup", near_dedup),
    ("benchmark decontamination", decontamination),
    ("pii", privacy),
    ("sentence pieces", pieces),
]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written to the shared folder and read again."""
    docs, before = table(spark, sf_dir, "documents"), None
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            docs = materialize(docs, "stage")
            if before is not None:
                drop_table(spark, before)
            before = docs
    return docs
