"""From raw documents to packed sequences: language ID, near duplicates, repeated passages, mixing, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written as Parquet and read again as the next
stage's docs. All but the last return the columns of documents.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.llm.common import crc_mod, table, written
from tessella.llm.jaccard import one_of_each
from tessella.llm.language import fit, languages
from tessella.llm.mixing import mixed_documents
from tessella.llm.packing import packed
from tessella.llm.suffixes import without_repeats

#: Documents without a letter, or less than half of whose letters are in one language, are rejected.
MIN_SHARE = 0.5


def identify(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in one language; the language column keeps its labels and gets predictions where it has none."""
    learnt = docs.where(crc_mod(F.col("doc_id"), 3) != 1)
    model = fit(learnt, id="doc_id", text="text", lang="lang")
    columns, at = docs.columns, docs.columns.index("text")
    # the operator's own columns stand beside the carried ones, which go by numbers: no name of a table's can clash
    carried = tuple((f"c{i}", F.col(f"`{c}`")) for i, c in enumerate(columns) if i != at)
    named = languages(docs, model, extra=carried, with_text=True)
    kept = named.where((F.col("lang_pred") != "und") & (F.col("score") >= MIN_SHARE))
    back = {i: F.col("text") if i == at else F.col(f"c{i}") for i in range(len(columns))}
    lang = columns.index("lang")
    back[lang] = F.coalesce(back[lang], F.col("lang_pred"))
    return kept.select(*[back[i].alias(c) for i, c in enumerate(columns)])


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates: the one with the least id."""
    return one_of_each(docs)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the bytes of passages that stand elsewhere, too; n_chars follows the text. Documents of which nothing is left go."""
    out = without_repeats(docs)
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return out.where("text IS NULL OR text <> ''")


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix of sources takes them."""
    return mixed_documents(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents in sequences, with their token ids."""
    return packed(docs, public_tokenizers.path("word_bpe_49k.json"), with_ids=True)


STAGES = [
    ("language_id", identify),
    ("ngram_jaccard", near_duplicates),
    ("suffix_dedup", repeated_passages),
    ("mixing", mix),
    ("packing", pack),
]

#: SQL can express no stage of it.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
