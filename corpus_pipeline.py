"""A corpus pipeline of five stages, from raw documents to packed training sequences.

Each stage takes (spark, docs, folder of tables) and returns a DataFrame that is written as
Parquet and read again as the next one's docs.  All but the last return the columns of documents.

Odd input, for every stage: a null text counts as empty, scores like an empty one, is a copy of other empty texts of other ids, and is near nothing; a null
id is never a copy or near duplicate and stays; rows that share an id but not a text stand for themselves; rows that repeat
another, id and text, go or stay with it; an empty table gives an empty one; columns of any name, also those that operators use, stay as they are.
"""

from __future__ import annotations

from collections.abc import Callable
from fractions import Fraction

from pyspark.sql import DataFrame, SparkSession, functions as F

from docloom.llm import exact_dedup, jaccard, packing, quality, substring
from docloom.llm.common import save
from docloom.llm.queries import END_ID, tokenizer_path

#: Least score that a document stays with; similarity of near duplicates by five-word shingles; words in a repeated passage; tokens in a sequence.
QUALITY, SIMILAR, WINDOW, CAPACITY = 0.3, Fraction(4, 5), 20, 4096

#: Pieces whose ids a Python worker remembers when packing, beside what earlier stages have left in memory.
KEEP = 200_000


def good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier doesn't reject; it learns from the labels outside its held-out fifth."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    model = quality.fit(docs, labels.where(~quality.held_out("doc_id")), "quality")
    return quality.keep_good(docs, model, QUALITY)


def distinct(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts, the document with the largest id."""
    return exact_dedup.drop_copies(docs)


def dissimilar(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of near duplicates, the document with the least id."""
    return jaccard.one_of_each(docs, 5, SIMILAR)


def unrepeated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without passages that occur earlier."""
    out = substring.without_repeats(docs, WINDOW)
    return out.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in out.columns else out


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents in training sequences."""
    return packing.pack(docs, tokenizer_path(), END_ID, CAPACITY, keep=KEEP)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality_classifier", good),
    ("exact_dedup", distinct),
    ("ngram_jaccard_join", dissimilar),
    ("substring_dedup", unrepeated),
    ("packing", packed),
]

#: A learned classifier and a tokenizer are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = save(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
