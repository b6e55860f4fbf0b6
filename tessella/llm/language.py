"""Language identification by words, with spans.

Fit: hashed byte trigrams of lower-cased letters, boundaries included, are counted by language over a bounded sample of labelled
rows (about `per_language` of each language, chosen by a hash of the id). The `max_languages` most frequent labels are learnt (of equals
the first in code point order); rarer ones are never predicted. The model has log-probabilities of hashed buckets for each language, BUCKETS of them for
up to 64 languages and half as many for each doubling beyond, so 32 MB at most whatever the corpus and its labels, and the scripts that make up at least
one percent of each language's words.

Label: a word's script narrows its candidate languages (all stay if none writes that script); the others
get no less than FAR below the best. Viterbi over the word scores of the whole text, with a penalty for each switch, labels spans; words without a letter
go with their neighbours. The prediction is the language of most letters, its score their share.

Null texts and texts without a letter (marks alone are none) are `und` with score 0. Memory is bounded by one slice, or one longer text: a byte or
two for each of its words and languages. Without any labelled row everything is `und`. Ties go to the first language in code point order.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import crc_mod, few, mix64, raw, ship, strings, sums, table, words_of

BUCKETS, PER_LANGUAGE, MAX_LANGUAGES, PENALTY, FAR = 1 << 16, 2000, 1024, 15.0, 30.0
#: First and last code points of scripts, as Unicode lays out its blocks.
SCRIPTS = {
    "latin": [(0x41, 0x5A), (0x61, 0x7A), (0xAA, 0x24F), (0x1E00, 0x1EFF)],
    "greek": [(0x370, 0x3FF), (0x1F00, 0x1FFF)],
    "cyrillic": [(0x400, 0x52F)],
    "armenian": [(0x530, 0x58F)],
    "hebrew": [(0x590, 0x5FF)],
    "arabic": [(0x600, 0x6FF), (0x750, 0x77F)],
    "devanagari": [(0x900, 0x97F)],
    "bengali": [(0x980, 0x9FF)],
    "tamil": [(0xB80, 0xBFF)],
    "thai": [(0xE00, 0xE7F)],
    "georgian": [(0x10A0, 0x10FF)],
    "hangul": [(0x1100, 0x11FF), (0xAC00, 0xD7AF)],
    "kana": [(0x3040, 0x30FF)],
    "han": [(0x3400, 0x4DBF), (0x4E00, 0x9FFF)],
}
_CLASSES = {name: "^[" + "".join(f"\\x{{{a:X}}}-\\x{{{b:X}}}" for a, b in spans) + "]" for name, spans in SCRIPTS.items()}


def _letters(words: pa.Array) -> pa.Array:
    """Lower-cased letters of the words, and the marks on them."""
    return pc.replace_substring_regex(pc.utf8_lower(words), r"[^\pL\pM]+", "")


def _scripts(letters: pa.Array) -> np.ndarray:
    """The script of each word's first letter: its index in SCRIPTS, or -1."""
    out = np.full(len(letters), -1, np.int64)
    for i, pattern in enumerate(_CLASSES.values()):
        on = pc.match_substring_regex(letters, pattern).to_numpy(zero_copy_only=False)
        out[on & (out < 0)] = i
        if (out >= 0).all():
            break
    return out


def _trigrams(letters: pa.Array, buckets: int = BUCKETS) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of the byte trigrams of each word between boundaries, and the n + 1 offsets of the words."""
    data, at = raw(pc.binary_join_element_wise(*(pa.scalar(x, pa.large_string()) if isinstance(x, str) else x.cast(pa.large_string()) for x in ("\x00", letters, "\x01", ""))))
    n = np.maximum(np.diff(at) - 2, 0)
    ends = np.concatenate([[0], np.cumsum(n)])
    take = np.repeat(at[:-1] - ends[:-1], n) + np.arange(ends[-1])
    b = data.astype(np.uint64)
    code = (b[take] << np.uint64(16)) | (b[take + 1] << np.uint64(8)) | b[take + 2]
    return (mix64(code) % np.uint64(buckets)).astype(np.int64), ends


def fit(labelled: DataFrame, *, id: str, text: str, lang: str, per_language: int = PER_LANGUAGE, max_languages: int = MAX_LANGUAGES) -> tuple[list[str], np.ndarray, np.ndarray]:
    """Languages; log-probabilities (buckets + 1 by languages, the last row zero); which scripts each writes (languages by scripts)."""
    labelled = labelled.select(F.col(id).alias("id"), F.col(text).alias("text"), F.col(lang).alias("lang")).where("text IS NOT NULL AND lang IS NOT NULL")
    counts = dict(labelled.groupBy("lang").count().orderBy(F.desc("count"), "lang").limit(max_languages).collect())
    langs = sorted(counts)
    if not langs:
        return [], np.zeros((BUCKETS + 1, 0)), np.zeros((0, len(SCRIPTS)), bool)
    buckets_ = BUCKETS >> max(0, (len(langs) - 1).bit_length() - 6)
    top = 1 << 30
    unit = F.pmod(F.xxhash64(F.coalesce(F.col("id").cast("string"), F.lit("")), F.lit("sample")), F.lit(top))
    cut = labelled.sparkSession.createDataFrame([(x, min(top, per_language * top // counts[x])) for x in langs], "lang string, cut long")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            names = b.column(1).to_pylist()
            for x in sorted(set(names)):
                flat, _ = words_of(strings(b.column(0).filter(pc.equal(b.column(1), x))))
                letters = _letters(flat)
                letters = letters.filter(pc.not_equal(pc.binary_length(letters), 0))
                buckets, _ = _trigrams(letters, buckets_)
                grams, n = np.unique(buckets, return_counts=True)
                script, m = np.unique(_scripts(letters), return_counts=True)
                key = np.concatenate([grams, -1 - script])  # scripts go below zero; -1 - (-1) = 0 is dropped
                n = np.concatenate([n, np.where(script < 0, 0, m)])
                yield pa.RecordBatch.from_arrays([pa.array([x] * len(key), pa.string()), pa.array(key), pa.array(n)], ["lang", "bucket", "n"])

    sample = labelled.join(F.broadcast(cut), "lang").where(unit < F.col("cut")).select("text", "lang").repartition(8)
    found = sample.mapInArrow(count, "lang string, bucket long, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toArrow().to_pandas()
    table_, seen = np.zeros((buckets_, len(langs))), np.zeros((len(langs), len(SCRIPTS)))
    for x, own in found.groupby("lang"):
        i = langs.index(x)
        grams = own[own.bucket >= 0]
        table_[grams.bucket, i] = grams.n
        below = own[(own.bucket < 0) & (own.n > 0)]
        seen[i, (-1 - below.bucket).astype(int)] = below.n
    logs = np.log((table_ + 0.05) / (table_.sum(0) + 0.05 * buckets_))
    writes = seen >= 0.01 * np.maximum(seen.sum(1, keepdims=True), 1)
    return langs, np.vstack([logs, np.zeros(len(langs))]), writes


def word_scores(words: pa.Array, logs: np.ndarray, writes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Scores of the words (words by languages), relative to each word's best; the number of letters of each."""
    letters = _letters(words)
    size = pc.utf8_length(pc.replace_substring_regex(letters, r"\pM+", "")).to_numpy(zero_copy_only=False).astype(np.int64)
    buckets, ends = _trigrams(letters, len(logs) - 1)
    score = np.stack([sums(logs[buckets, j], ends) for j in range(logs.shape[1])], 1)
    script = _scripts(letters)
    able = writes.T[np.maximum(script, 0)]
    able |= (script < 0)[:, None] | ~able.any(1, keepdims=True)
    score -= np.where(able, score, -np.inf).max(1, keepdims=True)
    score = np.where(able, score, np.minimum(score, -FAR))
    score[size == 0] = 0
    return score, size


def viterbi(scores: np.ndarray, at: np.ndarray, penalty: float = PENALTY, index: np.ndarray | None = None) -> np.ndarray:
    """The best label of every word; sequences are scores[index[at[i]:at[i + 1]]], worked on side by side. Without index, scores stand in order."""
    index = np.arange(len(scores)) if index is None else index
    kind = np.min_scalar_type(max(1, scores.shape[1] - 1))
    labels = np.zeros(len(index), np.int16)
    n = np.diff(at)
    order = np.argsort(-n, kind="stable")
    start, n = at[:-1][order], n[order]
    if not len(n) or n[0] == 0:
        return labels
    active = len(n) - np.searchsorted(n[::-1], np.arange(n[0]), side="right")
    back = np.zeros((len(index), scores.shape[1]), kind)
    own = np.arange(scores.shape[1], dtype=kind)
    v = scores[index[start[: active[0]]]]
    last = np.zeros(len(n), np.int64)
    for t in range(1, n[0]):
        k = active[t]
        if k < len(v):
            last[k : len(v)] = v[k:].argmax(1)
            v = v[:k]
        best = v.argmax(1)
        top = v[np.arange(k), best] - penalty
        stay = v >= top[:, None]
        at_t = start[:k] + t
        back[at_t] = np.where(stay, own, best[:, None].astype(kind))
        v = np.where(stay, v, top[:, None]) + scores[index[at_t]]
        v -= v.max(1, keepdims=True)  # differences alone count; sums of a long text would lose digits
    last[: len(v)] = v.argmax(1)
    now = last
    for t in range(n[0] - 1, -1, -1):
        k = active[t]
        at_t = start[:k] + t
        labels[at_t] = now[:k]
        if t:
            now[:k] = back[at_t, now[:k]]
    return labels


SPANS = "array<struct<start:long,end:long,lang:string>>"


def languages(docs: DataFrame, model: tuple[list[str], np.ndarray, np.ndarray], *, id: str = "doc_id", text: str = "text", extra: tuple[tuple[str, Column], ...] = (), spans: bool = False, with_text: bool = False) -> DataFrame:
    """id, lang_pred, score and the extra columns; with_text adds the text (as `text`, last but spans), spans the labelled runs of words."""
    spark = docs.sparkSession
    ship(spark)
    langs = model[0]
    sent = spark.sparkContext.broadcast(model)  # at most 32 MB

    def label(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        _, logs, writes = sent.value
        names = np.array([*langs, "und"], object)
        for b in few(batches):
            flat, at = words_of(strings(b.column(1)))
            n = len(at) - 1
            share, best = np.zeros(n), np.full(n, len(langs))
            runs: list[list[dict]] = [[] for _ in range(n)]
            if langs and len(flat):
                coded = flat.dictionary_encode()
                index = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
                score, size = word_scores(coded.dictionary, logs, writes)
                labels = viterbi(score, at, index=index)
                weight = size[index]
                owner = np.repeat(np.arange(n), np.diff(at))
                per = np.bincount(owner * len(langs) + labels, weight, n * len(langs)).reshape(n, len(langs)).astype(np.int64)
                total = per.sum(1)
                best = np.where(total > 0, per.argmax(1), len(langs))
                share = np.where(total > 0, per.max(1) / np.maximum(total, 1), 0.0)
                if spans:
                    for i, (x, y) in enumerate(zip(at[:-1], at[1:])):
                        edge = np.concatenate([[0], np.flatnonzero(np.diff(labels[x:y])) + 1, [y - x]])
                        runs[i] = [{"start": int(p), "end": int(q), "lang": langs[labels[x + p]]} for p, q in zip(edge[:-1], edge[1:])] if y > x else []
            out = [b.column(0), pa.array(names[best], pa.string()), pa.array(share), *b.columns[2:], *b.columns[1:2] * with_text]
            if spans:
                out.append(pa.array(runs, pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("lang", pa.string())]))))
            yield pa.RecordBatch.from_arrays(out, head)

    head = [id, "lang_pred", "score", *(name for name, _ in extra)] + ["text"] * with_text + ["spans"] * spans
    rows = docs.select(F.col(id), F.col(text), *(c.alias(name) for name, c in extra))
    kinds = "".join(f", `{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields[2:])
    return rows.mapInArrow(label, f"`{id}` {rows.schema[0].dataType.simpleString()}, lang_pred string, score double{kinds}" + ", text string" * with_text + f", spans {SPANS}" * spans)


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held = crc_mod(F.col("doc_id"), 3) == 1
    model = fit(docs.where(~held), id="doc_id", text="text", lang="lang")
    return languages(docs, model, extra=(("held_out", held),)).select("doc_id", "held_out", "lang_pred", "score")
