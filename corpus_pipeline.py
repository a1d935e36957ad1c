"""The corpus pipeline: documents in, filtered, deduplicated, mixed and encoded documents out.

Every stage takes (spark, docs, sf_dir) and works on all rows that the one before
has kept. Between stages the rows are written as Parquet and read again. All but
the last return the columns of documents; the last adds ``ids``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from paylens.llm.jaccard_join import keep_one_per_component
from paylens.llm.mixing import in_mixed_order
from paylens.llm.quality_rules import keep_good
from paylens.llm.scratch import Scratch
from paylens.llm.sentence_pieces import encoded, piece_model
from paylens.llm.substring_dedup import without_repeats


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rules and the adaptive fences."""
    return keep_good(docs)


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group linked by Jaccard similarity 0.8 of five-word shingles."""
    return keep_one_per_component(docs, n=5, percent=80)


def passage_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages of 50 words or more that another document has are cut."""
    return without_repeats(docs, min_words=50, percent=80)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, in the order of the source mixture."""
    return in_mixed_order(docs)


def encoding_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents with their SentencePiece ids."""
    return encoded(docs, piece_model()).select("row_.*", "ids")


STAGES = [
    ("quality_rules", quality_stage),
    ("ngram_jaccard_join", near_duplicate_stage),
    ("substring_dedup", passage_stage),
    ("source_mixing", mixing_stage),
    ("sentence_pieces", encoding_stage),
]

# Hash-based stages; tests compare the pipeline with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of ``sf_dir``."""
    scratch = Scratch(spark, "pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (name, stage) in enumerate(STAGES):
        docs = scratch.save(stage(spark, docs, sf_dir), f"{k}-{name}")
        if k:
            scratch.drop(f"{k - 1}-{STAGES[k - 1][0]}")
    return docs
