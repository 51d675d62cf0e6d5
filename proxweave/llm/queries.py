"""Queries over the training-data tables: one for each operator, whole tables, with their SQL where it exists."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import table
from . import pii
from .context_tree import context_tree_scores
from .decontaminate import decontaminate
from .html_text import html_text
from .pu_quality import pu_quality
from .quality_rules import ACCENT, CHARACTERS, COMMON_WORDS, DIGIT, MARKS, OTHER_SYMBOLS, SYMBOLS, UPPER_CASE, quality_rules
from .sentence_pieces import encode_pieces
from .sharding import ring_shards
from .simhash import simhash_components
from .token_counts import token_counts


def _crc_mod(n: int):
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(1)) % n


def op1_ring_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = ring_shards(table(spark, sf_dir, "documents"), 24)
    return placed.select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "home_shard"
    )


def op2_simhash_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash_components(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def op3_bootstrapped_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.find_pii(table(spark, sf_dir, "documents"))
    count = lambda k: F.size(F.filter(F.split("base", ","), lambda x: x.startswith(k + ":"))).cast("long").alias(f"n_{k}")
    return found.select("doc_id", *map(count, pii.KINDS), F.sha2("base", 256).alias("base_sha256"), "spans", "n_added")


def op4_pu_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = pu_quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), trainable=_crc_mod(5) != 0)
    return scored.select("doc_id", (_crc_mod(5) == 0).alias("held_out"), "score", "predicted", "prior")


def op5_prefix_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    ids = F.array_join(F.array_sort(F.transform("item_ids", lambda x: x.cast("string"))), ",")
    return found.select("doc_id", "n_words", "n_hit", "n_items", F.sha2(ids, 256).alias("items_sha256"), "contaminated")


def op6_bpe_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return token_counts(docs, public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.PATTERN)


def op7_html_layout_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text(table(spark, sf_dir, "pages"))


def op8_context_tree_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return context_tree_scores(table(spark, sf_dir, "documents"), _crc_mod(7) == 2)


def op9_sentence_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_pieces(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


def op10_divergence_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = quality_rules(table(spark, sf_dir, "documents"))
    return found.withColumns({c: F.round(c, 6) for c in ("word_distance", "char_distance")})


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        f.__name__: f
        for f in (
            op1_ring_sharding,
            op2_simhash_components,
            op3_bootstrapped_pii,
            op4_pu_quality,
            op5_prefix_decontamination,
            op6_bpe_token_counts,
            op7_html_layout_text,
            op8_context_tree_scores,
            op9_sentence_pieces,
            op10_divergence_rules,
        )
    }


_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_WORDS = rf"regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

OP5_SQL = rf"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, {_WORDS} AS w FROM documents),
i AS (SELECT item_id, {_WORDS} AS w FROM benchmark),
wins AS (
  SELECT DISTINCT item_id, least(len(w), 10) AS n, list_slice(w, s, s + least(len(w), 10) - 1) AS win
  FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS s FROM i WHERE len(w) > 0)
),
places AS (SELECT rid, w, unnest(range(1, len(w) + 1)) AS s FROM d),
spans AS (
  SELECT p.rid, p.s, x.n, x.item_id
  FROM places p JOIN (SELECT *, win[1] AS w1 FROM wins) x
  ON p.w[p.s] = x.w1 AND p.s + x.n - 1 <= len(p.w) AND list_slice(p.w, p.s, p.s + x.n - 1) = x.win
),
hits AS (SELECT rid, count(DISTINCT pos) AS n_hit FROM (SELECT rid, unnest(range(s, s + n)) AS pos FROM spans) GROUP BY rid),
items AS (
  SELECT rid, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS ids
  FROM (SELECT DISTINCT rid, CAST(item_id AS VARCHAR) AS item FROM spans) GROUP BY rid
)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit,
  CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN hits USING (rid) LEFT JOIN items USING (rid)
"""


_REFERENCE = ", ".join(f"('{k}', '{w}', {n / 1000})" for k, words in COMMON_WORDS.items() for w, n in words.items())
_REST = ", ".join(f"('{k}', {(1000 - sum(words.values())) / 1000})" for k, words in COMMON_WORDS.items())
_CHARS = ", ".join(f"('{k}', {i}, {', '.join(str(n / sum(c.values())) for n in c.values())})" for i, (k, c) in enumerate(CHARACTERS.items()))
_CLASSES = len(CHARACTERS["en"])


def _part(p: str, q: str) -> str:
    """One class of twice the Jensen-Shannon divergence of shares p and q."""
    return f"(CASE WHEN {p} > 0 THEN {p} * log2({p} / (({p} + {q}) / 2)) ELSE 0 END + CASE WHEN {q} > 0 THEN {q} * log2({q} / (({p} + {q}) / 2)) ELSE 0 END)"


def _matches(pattern: str) -> str:
    quoted = pattern.replace("'", "''")
    return f"len(regexp_extract_all(t, '{quoted}'))"


OP10_SQL = rf"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS t FROM documents),
w AS (SELECT rid, doc_id, t, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS w, list_filter(string_split(t, chr(10)), lambda l: regexp_matches(l, '[^\x20\x09-\x0D]')) AS lines FROM d),
win AS (SELECT rid, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS x FROM (SELECT rid, w, unnest(range(1, len(w) - 1)) AS i FROM w WHERE len(w) > 2)),
rep AS (
  SELECT rid, count(DISTINCT pos) AS n FROM (
    SELECT rid, unnest(range(i, i + 3)) AS pos FROM (SELECT *, count(*) OVER (PARTITION BY rid, x) AS c FROM win) WHERE c > 1
  ) GROUP BY rid
),
ref AS (SELECT * FROM (VALUES {_REFERENCE}) r(lang, word, q)), rest AS (SELECT * FROM (VALUES {_REST}) r(lang, q)),
cnt AS (SELECT rid, lower(x) AS word, count(*) AS n FROM (SELECT rid, unnest(w) AS x FROM w) GROUP BY 1, 2),
has AS (SELECT w.rid, ref.lang, ref.q, coalesce(cnt.n, 0) / CAST(len(w.w) AS DOUBLE) AS p FROM w CROSS JOIN ref LEFT JOIN cnt ON cnt.rid = w.rid AND cnt.word = ref.word WHERE len(w.w) >= 100),
jsl AS (SELECT has.rid, has.lang, sum({_part('p', 'has.q')}) AS s, 1 - sum(p) AS p, any_value(rest.q) AS q FROM has JOIN rest ON rest.lang = has.lang GROUP BY 1, 2),
js AS (SELECT rid, lang, sqrt(greatest((s + {_part('p', 'q')}) / 2, 0)) AS word_distance FROM jsl),
c AS (
  SELECT w.rid, doc_id, len(w) AS n_words, coalesce(CAST(list_sum(list_transform(w, lambda x: length(x))) AS BIGINT), 0) AS word_chars, length(t) AS n_chars, {_matches(ACCENT)} AS ac,
    {_matches(SYMBOLS)} AS n_symbols, {_matches(OTHER_SYMBOLS)} AS n_other, {_matches(UPPER_CASE)} AS up, {_matches(DIGIT)} AS dg, {_matches(MARKS)} AS mk,
    len(lines) - len(list_distinct(lines)) AS n_dup_lines, coalesce(rep.n, 0) AS n_repeat_words
  FROM w LEFT JOIN rep USING (rid)
),
sh AS (
  SELECT rid, greatest(word_chars - ac - up - dg - mk - n_symbols - n_other, 0) / CAST(n_chars AS DOUBLE) AS s1, ac / CAST(n_chars AS DOUBLE) AS s2, up / CAST(n_chars AS DOUBLE) AS s3,
    (n_chars - word_chars) / CAST(n_chars AS DOUBLE) AS s4, dg / CAST(n_chars AS DOUBLE) AS s5, mk / CAST(n_chars AS DOUBLE) AS s6, (n_symbols + n_other) / CAST(n_chars AS DOUBLE) AS s7
  FROM c WHERE n_words >= 100
),
chars AS (SELECT * FROM (VALUES {_CHARS}) r(lang, place, {', '.join(f'q{i + 1}' for i in range(_CLASSES))})),
pairs AS (
  SELECT js.rid, js.lang, place, word_distance, sqrt(greatest(({' + '.join(_part(f's{i + 1}', f'q{i + 1}') for i in range(_CLASSES))}) / 2, 0)) AS char_distance
  FROM js JOIN sh USING (rid) JOIN chars ON chars.lang = js.lang
),
near AS (SELECT *, round(word_distance + char_distance, 9) AS total, row_number() OVER (PARTITION BY rid ORDER BY round(word_distance + char_distance, 9), place) AS k FROM pairs),
v AS (
  SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed
  FROM c LEFT JOIN (SELECT rid, lang AS language, word_distance, char_distance, total FROM near WHERE k = 1) USING (rid)
)
SELECT doc_id, CAST(n_words AS BIGINT) AS n_words, word_chars, CAST(n_symbols AS BIGINT) AS n_symbols, CAST(n_dup_lines AS BIGINT) AS n_dup_lines, CAST(n_repeat_words AS BIGINT) AS n_repeat_words,
  base_failed, language, round(word_distance, 6) AS word_distance, round(char_distance, 6) AS char_distance, NOT base_failed AND coalesce(total <= 0.5, true) AS kept
FROM v
"""


def oracle_sql() -> dict[str, str]:
    return {"op5_prefix_decontamination": OP5_SQL, "op10_divergence_rules": OP10_SQL}
