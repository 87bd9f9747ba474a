"""A corpus pipeline of four stages: quality rules, language ID, near-dedup, packing.

Each stage takes all that its predecessor kept. The first three return the columns of documents; the
last returns the pieces of the packed sequences.

Defined cases: a null or empty text fails the quality rules; of rows with one doc_id each text is
judged by itself, and of equal rows one stays; rows without a doc_id take part, after all others as
the first of a class; further columns of documents, whatever their names, are handed on; a very long
text is read whole; an empty table gives no rows; without labels the likelihood ratio is 0 and only the
base rules decide; without a learned language no document passes the language stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tripleloom.llm import langid, packing, quality_rules, simhash
from tripleloom.llm.common import discard, table, tokenizer_path


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rules and the likelihood ratio."""
    return quality_rules.keep(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is known."""
    return langid.keep(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The first document of each group of near copies."""
    return simhash.firsts(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of sequences of at most 4096 tokens."""
    return packing.packed_digests(docs, tokenizer_path("word_bpe_49k.json"))


STAGES = [
    ("quality rules", quality),
    ("language ID", language),
    ("SimHash near-dedup", near_duplicates),
    ("packing", packed),
]

#: SQL can express neither the tries' components nor the tokenizer; tests hold run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pieces of all documents that the stages keep. A stage's documents are removed when the next one's are written."""
    docs, written = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for k, (_, stage) in enumerate(STAGES[:-1]):
        docs = table(stage(spark, docs, sf_dir), f"stage{k}")
        if written is not None:
            discard(written)
        written = docs
    return STAGES[-1][1](spark, docs, sf_dir)
