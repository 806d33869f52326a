"""The corpus pipeline: quality rules, toxicity, SimHash near-dedup, substring dedup and best-fit packing, in this order.

Each stage gets what its predecessor kept, as a stored table with the columns of documents.

In every stage a null text is one without words, and an empty table gives an empty result; texts of any length are
read whole; other columns, whatever their names, are handed on as they are until the last stage, which returns places.
Rows without a doc_id are judged by their text in the first two stages, stay in the deduplicating ones, where nothing
can tell which of them came first, and are packed like any other. Rows that repeat a doc_id are judged each by itself;
near-dedup leaves one row of a doc_id, the one whose text has the smallest hash.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scorewright.llm import packing, quality, similar, substring, toxicity
from scorewright.llm.shared import workspace, written


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rules keep, without the lines that fail; documents without words go."""
    return quality.clean(docs)


def toxic_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score below 0.5 under a grammar learnt from this stage's labelled input; without labels all stay."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    grammar = toxicity.fit(docs, labels.where(~toxicity.held_out("doc_id")))
    return toxicity.keep_clean(docs, grammar)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest doc_id of each group of similar five-word shingles; documents without words are one
    group."""
    return similar.keep_one(docs)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the passages that an earlier one has; texts without repeats are unchanged, and a document all of
    whose words go is left out."""
    return substring.cut_repeats(docs)


def packed_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row for each piece with its place in a sequence of 2048 tokens."""
    return packing.pack_documents(docs, public_tokenizers.path("byte_bpe_50k.json"), size=2048, end_id=0, keep_ids=False)


STAGES = [
    ("quality rules", quality_rules),
    ("toxicity", toxic_documents),
    ("simhash near-dedup", near_duplicates),
    ("substring dedup", repeated_passages),
    ("best-fit packing", packed_sequences),
]

#: Fingerprints, learnt weights, token ids and packing have no SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages applied to documents, each written as Parquet and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    ws = workspace(spark)
    for k, (_, stage) in enumerate(STAGES):
        docs = written(stage(spark, docs, sf_dir), ws, f"stage{k}")
    return docs
