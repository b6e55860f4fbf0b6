"""Quality rules, with DataFrame functions alone.

Base rules count words, word characters, symbols, repeated lines and words in repeated 8-word windows. The verdict is a
hashed n-gram log-likelihood ratio: tokens (runs of letters and digits, runs of other signs) and pairs of tokens are hashed
to 2 * BUCKETS buckets; one pass counts them over the whole raw corpus and over the trusted rows in it; a text's
score is the mean over its n-grams of log(p_trusted / p_raw), so length does not matter. Texts below `threshold` are not kept.
The trusted rows are a bounded sample, at most `max_trusted`, of rows labelled good. The model is 2 * BUCKETS weights at any size.

Windows are compared by 64-bit hashes. A null or empty text has no words and fails the base rules. Without a trusted row
every score is 0 and the base rules decide. Repeated rows count and are judged each.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import WORD, table

BUCKETS, MAX_TRUSTED, PRIOR, THRESHOLD, WINDOW = 8192, 20_000, 2000.0, -0.25, 8
TOKEN = r"[\p{L}\p{N}_]+|[^\p{L}\p{N}_\s]+"
_SYMBOLS, _SPACE = "#*$%&|<>", " \t\n\x0b\x0c\r"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value), with value computed once."""
    return F.transform(F.array(value), body)[0]


def _dropped(text: Column, chars: str) -> Column:
    return (F.length(text) - F.length(F.translate(text, chars, ""))).cast("long")


def _repeat_words(words: Column) -> Column:
    """Words in 8-word windows that occur twice or more."""

    def paired(h: Column, by: int, body: Callable[[Column], Column]) -> Column:
        """body of the hashes of each value with the one `by` places on."""
        n = F.size(h) - by
        return let(F.zip_with(F.slice(h, 1, n), F.slice(h, 1 + by, n), lambda a, b: F.xxhash64(a, b)), body)

    def covered(h: Column) -> Column:
        # windows of two words, then of four, then of eight
        return paired(h, 1, lambda two: paired(two, 2, lambda four: paired(four, 4, spread)))

    def spread(w: Column) -> Column:
        # (hash, place) in order: a window is repeated if a neighbour has its hash
        pairs = F.array_sort(F.zip_with(w, F.sequence(F.lit(0), F.size(w) - 1), lambda x, i: F.struct(x.alias("h"), i.alias("i"))))
        many = F.size(F.array_distinct(w)) < F.size(w)
        return F.when(many, let(pairs, lambda s: let(_repeated(s), _union))).otherwise(F.lit(0))

    def _repeated(s: Column) -> Column:
        same = lambda j, k: F.coalesce(F.get(s, j)["h"] == F.get(s, k)["h"], F.lit(False))
        kept = F.filter(F.sequence(F.lit(0), F.size(s) - 1), lambda j: same(j, j - 1) | same(j, j + 1))
        return F.sort_array(F.transform(kept, lambda j: F.get(s, j)["i"]))

    def _union(p: Column) -> Column:
        gaps = F.transform(F.sequence(F.lit(0), F.size(p) - 1), lambda j: F.least(F.lit(WINDOW), F.coalesce(F.get(p, j + 1) - F.get(p, j), F.lit(WINDOW))))
        return F.aggregate(gaps, F.lit(0), lambda a, x: a + x)

    return F.when(F.size(words) > WINDOW, let(F.transform(words, lambda w: F.xxhash64(w)), covered)).otherwise(F.lit(0)).cast("long")


def base_columns(text: Column) -> dict[str, Column]:
    """The base counts of a text; null counts as empty."""
    t = F.coalesce(text, F.lit(""))
    lines = F.filter(F.split(t, "\n", -1), lambda x: x.rlike(WORD))
    return {
        "n_words": F.regexp_count(t, F.lit(WORD)).cast("long"),
        "word_chars": F.length(F.translate(t, _SPACE, "")).cast("long"),
        "n_symbols": _dropped(t, _SYMBOLS),
        "n_dup_lines": let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long"),
        "n_repeat_words": _repeat_words(F.regexp_extract_all(t, F.lit(WORD), F.lit(0))),
    }


def _buckets(text: Column) -> Column:
    """Buckets of the tokens and token pairs of a text."""
    tokens = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(TOKEN), F.lit(0))

    def both(h: Column) -> Column:
        one = F.transform(h, lambda x: F.pmod(x, F.lit(BUCKETS)).cast("int"))
        two = F.zip_with(h, F.slice(h, 2, F.greatest(F.size(h) - 1, F.lit(0))), lambda a, b: F.when(b.isNotNull(), (F.pmod(F.xxhash64(a, b), F.lit(BUCKETS)) + BUCKETS).cast("int")))
        return F.concat(one, F.slice(two, 1, F.greatest(F.size(h) - 1, F.lit(0))))

    return let(F.transform(tokens, lambda t: F.xxhash64(t)), both)


def fit(docs: DataFrame, trusted: DataFrame, *, id: str = "doc_id", text: str = "text", max_trusted: int = MAX_TRUSTED, prior: float = PRIOR) -> list[float]:
    """The 2 * BUCKETS weights; trusted has the ids of good rows."""
    ids = trusted.select(F.col(id).alias("_trusted")).where("_trusted IS NOT NULL").distinct().orderBy(F.xxhash64("_trusted"), "_trusted").limit(max_trusted)
    rows = docs.select(F.col(id).alias("_id"), F.col(text).alias("_text")).join(F.broadcast(ids), F.col("_id") == F.col("_trusted"), "left")
    grams = rows.select(F.col("_trusted").isNotNull().cast("long").alias("good"), F.explode(_buckets(F.col("_text"))).alias("bucket"))
    counted = grams.groupBy("bucket").agg(F.count(F.lit(1)).alias("n"), F.sum("good").alias("good")).collect()  # at most 2 * BUCKETS rows
    out = [0.0] * (2 * BUCKETS)
    for half in (0, 1):
        own = [r for r in counted if r.bucket // BUCKETS == half]
        n, good = sum(r.n for r in own), sum(r.good for r in own)
        for r in own if good else []:
            p = r.n / n
            out[r.bucket] = math.log((r.good + prior * p) / (good + prior) / p)
    return out


def ratio(text: Column, weights: list[float]) -> Column:
    """The mean log-likelihood ratio of a text's n-grams; 0 without any."""
    held = F.split(F.lit(",".join(map(repr, weights))), ",").cast("array<double>")  # folds to one literal

    def mean(b: Column) -> Column:
        return F.aggregate(b, F.lit(0.0), lambda a, x: a + F.get(held, x)) / F.greatest(F.size(b), F.lit(1))

    return let(_buckets(text), mean)


def judged(docs: DataFrame, weights: list[float], *, id: str = "doc_id", text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """id, the base counts, base_failed, kept and llr for every row."""
    t = F.col(text)
    out = docs.select(F.col(id), *(c.alias(k) for k, c in base_columns(t).items()), F.round(ratio(t, weights), 9).alias("llr"))
    failed = (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))
    return out.withColumn("base_failed", failed).withColumn("kept", ~F.col("base_failed") & (F.col("llr") >= threshold)).select(id, "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "llr")


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    trusted = table(spark, sf_dir, "labels").where("quality = 1 AND toxic = 0")
    return judged(docs, fit(docs, trusted))
