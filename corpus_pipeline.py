"""The corpus pipeline: five of the corpus operators, each on what its predecessor kept.

STAGES lists (name, function); each function takes (spark, docs, sf_dir) and returns
a DataFrame, which is written as Parquet and read again as the next one's docs. All
but the last return the columns of documents. There is no SQL for the whole:
language ID, SimHash and packing can't be stated in it (ORACLE_SQL is None).

Every stage takes nulls in any column, empty and very long texts, ties, repeated
rows, empty tables and further columns; what each makes of them is said in its
operator's module, and below where it decides about a document.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from linkspan.llm import exact_dedup, language_id, mixing, near_copies, packing
from linkspan.llm.common import dropped, ship, written


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is undetermined, or has less than half of the text, go:
    null and blank texts and those without a letter are among them."""
    ship(spark)
    return language_id.identified(docs, language_id.train(docs))


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the row with the smallest identifier stays, a null one last; of rows
    that repeat that identifier one stays."""
    ship(spark)
    return exact_dedup.deduplicate(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies (five-word Jaccard of 0.8 or more)
    stays: the smallest identifier, a null one last."""
    ship(spark)
    return near_copies.deduplicate(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document as often as its source's target takes it; a null source is one of
    its own, and texts without words are taken by their source's whole copies."""
    return mixing.mix(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents with their sequences and offsets; an empty text is one
    piece with the end id alone."""
    ship(spark)
    return packing.pack(packing.pieces(docs))


STAGES = [
    ("language_id", identify_language),
    ("exact_dedup", drop_copies),
    ("simhash_dedup", drop_near_copies),
    ("mix", mix_sources),
    ("pack", pack_sequences),
]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows. A stage's table goes once its successor is written."""
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
        if before is not None:
            dropped(before)
        before = docs
    return STAGES[-1][1](spark, docs, sf_dir)
