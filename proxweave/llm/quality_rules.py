"""Document quality rules: counts, repetition, and divergence from language references. DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SPACE = r"[\x20\x09-\x0D]"
SPACE_CHARS = " \t\n\x0b\x0c\r"

# Shares of common words of running text, in per mille of all words, and shares of
# character classes in per mille of all characters. The rest of the words is one more class.
COMMON_WORDS = {
    "en": {"the": 55, "of": 30, "and": 27, "to": 24, "in": 20, "a": 20, "is": 11, "that": 11, "for": 9, "it": 9, "as": 8, "was": 8, "with": 7, "on": 7, "by": 6, "are": 5},
    "fr": {"de": 50, "la": 32, "le": 28, "et": 22, "les": 20, "des": 18, "en": 14, "un": 12, "une": 11, "du": 11, "que": 10, "dans": 8, "qui": 8, "est": 8, "pour": 7, "par": 6},
    "de": {"der": 35, "die": 35, "und": 28, "in": 18, "den": 13, "von": 11, "zu": 11, "das": 11, "mit": 9, "sich": 8, "des": 8, "ist": 8, "im": 7, "dem": 7, "nicht": 6, "ein": 6},
    "es": {"de": 60, "la": 38, "que": 30, "el": 28, "en": 26, "y": 25, "los": 17, "a": 16, "se": 13, "del": 12, "las": 11, "un": 10, "por": 9, "con": 9, "una": 8, "su": 7},
}
CHARACTERS = {
    "en": {"letter": 782, "accent": 0, "upper": 25, "space": 165, "digit": 5, "mark": 22, "symbol": 1},
    "fr": {"letter": 755, "accent": 30, "upper": 22, "space": 160, "digit": 5, "mark": 27, "symbol": 1},
    "de": {"letter": 768, "accent": 15, "upper": 55, "space": 138, "digit": 5, "mark": 18, "symbol": 1},
    "es": {"letter": 768, "accent": 22, "upper": 22, "space": 162, "digit": 5, "mark": 20, "symbol": 1},
}

SYMBOLS = r"[#*$%&|<>]"
OTHER_SYMBOLS = r"[^\x00-\x7F\p{L}\p{N}\s]|[\x00-\x08\x0E-\x1F@^_`~{}=+/\\\[\]\x7F]"
MARKS = r"""[.,;:!?'"()\-]"""

UPPER_CASE, DIGIT, ACCENT = r"\p{Lu}", r"\p{Nd}", "[ß-öø-ÿœ]"

LONG = "array<long>"


def _words(text: Column) -> Column:
    trimmed = F.btrim(text, F.lit(SPACE_CHARS))
    return F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, SPACE + "+"))


def _total(values: Column) -> Column:
    return F.aggregate(values, F.lit(0).cast("long"), lambda a, x: a + x)


def _js_distance(have: Column, total: Column, want: list[float]) -> Column:
    """Square root of the Jensen-Shannon divergence, in bits, of counts against shares; 1 at most."""
    shares = F.array(*[F.lit(float(w) / sum(want)) for w in want])

    def part(h: Column, q: Column) -> Column:
        p = h / total
        m = (p + q) / 2
        return F.when(p > 0, p * F.log2(p / m)).otherwise(0.0) + F.when(q > 0, q * F.log2(q / m)).otherwise(0.0)

    both = F.aggregate(F.zip_with(have, shares, part), F.lit(0.0), lambda a, x: a + x)
    return F.sqrt(F.greatest(both / 2, F.lit(0.0)))


def quality_rules(
    docs: DataFrame,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    min_words: int = 50,
    max_repeat_percent: int = 50,
    guard_words: int = 100,
    max_distance: float = 0.5,
) -> DataFrame:
    """One row for each input row: counts, ``base_failed``, the nearest language, both distances, ``kept``.

    Words are runs of characters other than ASCII white space. A row fails the base rules with under
    ``min_words`` words, or if over ``max_repeat_percent`` of them are in 3-word windows that occur
    twice or more. Of the others, a text is dropped if its Jensen-Shannon distances to a language's
    references, that of character classes and that of common words, add up to more than
    ``max_distance`` for every language (either is 1 at most). ``language`` is the nearest, of equal ones
    the first, and the distances are those to it. Texts of under ``guard_words`` words are too short for
    a histogram: they have no distances and pass this part.

    A null text counts as empty (0 words, base_failed). Repeated rows stay; an empty table gives an
    empty result; other columns are ignored. One scan, no shuffle, no Python: everything is per row.
    Windows are first compared by a 33-bit hash packed with their position and sorted as longs;
    only those whose hash repeats are compared as strings, so counts are exact.
    """
    base = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("t"))
    split = base.select("id", "t", _words(F.col("t")).alias("w"))
    low = F.lit((1 << 31) - 1).cast("long")
    high = F.lit(-(1 << 31)).cast("long")
    at = lambda k: k.bitwiseAND(low).cast("int")
    windows = F.transform(
        F.sequence(F.lit(0), F.size("w") - 3),
        lambda i: F.xxhash64(F.get("w", i), F.get("w", i + 1), F.get("w", i + 2)).bitwiseAND(high).bitwiseOR(i.cast("long")),
    )
    vocabulary = sorted({w for words in COMMON_WORDS.values() for w in words})
    hashed = split.select(
        "id",
        "t",
        "w",
        F.size("w").cast("long").alias("n_words"),
        F.length(F.array_join("w", "")).cast("long").alias("word_chars"),
        F.when(F.size("w") >= 3, F.sort_array(windows)).otherwise(F.array().cast(LONG)).alias("k"),
        F.concat(F.lit(" "), F.array_join(F.filter("w", lambda x: F.lower(x).isin(vocabulary)), "  "), F.lit(" ")).alias("common"),
    )
    same = lambda x, y: F.coalesce(x.bitwiseXOR(y).bitwiseAND(high) == 0, F.lit(False))
    likely = hashed.select(
        "*", F.filter("k", lambda x, j: same(x, F.get("k", j - 1)) | same(x, F.get("k", j + 1))).alias("c")
    ).drop("k")
    spelled = F.transform(
        "c",
        lambda x: F.struct(
            F.concat_ws(" ", F.get("w", at(x)), F.get("w", at(x) + 1), F.get("w", at(x) + 2)).alias("s"), at(x).alias("p")
        ),
    )
    sorted_windows = likely.select("*", F.sort_array(spelled).alias("g")).drop("c", "w")
    twice = F.filter(
        "g",
        lambda x, j: F.coalesce(x["s"] == F.get("g", j - 1)["s"], F.lit(False))
        | F.coalesce(x["s"] == F.get("g", j + 1)["s"], F.lit(False)),
    )
    placed = sorted_windows.select("*", F.sort_array(F.transform(twice, lambda x: x["p"])).alias("p")).drop("g")
    covered = F.transform("p", lambda x, j: F.least(F.lit(3), F.coalesce(F.get("p", j + 1) - x, F.lit(3))).cast("long"))

    count = lambda pattern: F.regexp_count("t", F.lit(pattern)).cast("long")
    lines = placed.select(
        "*",
        _total(covered).alias("n_repeat_words"),
        F.filter(F.split("t", "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]")).alias("lines"),
        F.length("t").cast("long").alias("n_chars"),
        count(SYMBOLS).alias("n_symbols"),
        count(OTHER_SYMBOLS).alias("n_other"),
        count(UPPER_CASE).alias("n_upper"),
        count(DIGIT).alias("n_digit"),
        count(ACCENT).alias("n_accent"),
        count(MARKS).alias("n_mark"),
        F.lower("common").alias("cw"),
    ).drop("p", "t", "common")
    padded = lambda w: F.concat(F.lit(" "), w, F.lit(" "))
    times = lambda w: (F.length("cw") - F.length(F.replace("cw", padded(w), F.lit("")))) / (F.length(w) + 2)
    counted = lines.select(
        "*",
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        *[F.transform(F.array(*map(F.lit, words)), times).alias(f"c_{k}") for k, words in COMMON_WORDS.items()],
    ).drop("lines", "cw")
    spaces = F.col("n_chars") - F.col("word_chars")
    symbols = F.col("n_symbols") + F.col("n_other")
    letters = F.greatest(F.col("word_chars") - F.col("n_accent") - F.col("n_upper") - F.col("n_digit") - F.col("n_mark") - symbols, F.lit(0))
    chars = F.array(*[c.cast("double") for c in (letters, F.col("n_accent"), F.col("n_upper"), spaces, F.col("n_digit"), F.col("n_mark"), symbols)])
    by_language = []
    for k, words in COMMON_WORDS.items():
        rest = F.col("n_words") - F.aggregate(f"c_{k}", F.lit(0.0), lambda a, x: a + x)
        have = F.concat(f"c_{k}", F.array(F.greatest(rest, F.lit(0.0))))
        by_word = _js_distance(have, F.col("n_words"), [*words.values(), 1000 - sum(words.values())])
        by_char = _js_distance(chars, F.col("n_chars"), list(CHARACTERS[k].values()))
        by_language.append(F.struct(by_word.alias("w"), by_char.alias("c"), F.lit(k).alias("k")))
    failed = (F.col("n_words") < min_words) | (100 * F.col("n_repeat_words") > max_repeat_percent * F.col("n_words"))
    # rounded, so that the last digits of a sum decide neither the language nor the verdict
    ranked = F.transform(F.array(*by_language), lambda x: F.struct(F.round(x["w"] + x["c"], 9).alias("sum"), x["w"], x["c"], x["k"]))
    first = lambda a, x: F.when(x["sum"] < a["sum"], x).otherwise(a)
    nearest = F.reduce(F.slice("d", 2, len(COMMON_WORDS)), F.get("d", F.lit(0)), first)
    scored = counted.select("*", failed.alias("base_failed"), F.when(F.col("n_words") >= guard_words, ranked).alias("d")).select("*", nearest.alias("at"))
    near = F.coalesce(F.col("at.sum") <= max_distance, F.lit(True))
    row = F.struct(
        F.col("id").alias(id_col),
        "n_words",
        "word_chars",
        "n_symbols",
        "n_dup_lines",
        "n_repeat_words",
        "base_failed",
        F.col("at.k").alias("language"),
        F.col("at.w").alias("word_distance"),
        F.col("at.c").alias("char_distance"),
        (~F.col("base_failed") & near).alias("kept"),
    )
    # a generator, as a later filter on these columns would else be pushed below the steps above and repeat them in every lambda
    return scored.select(F.inline(F.array(row)))
