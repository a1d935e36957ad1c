"""One query per operator: production parameters, whole tables, full results."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import byte_pairs, periodic_runs
from .block_search import top_products
from .jaccard_join import jaccard_components
from .language_id import HELD_OUT, identified, train
from .license_scan import scanned
from .mixing import mixed
from .perplexity import classified
from .quality_rules import measured
from .queries_sql import BLOCK_SEARCH, QUALITY_RULES
from .sentence_pieces import digests, piece_model
from .substring_dedup import repeated_passages
from .token_files import token_index
from .whitening import by_component

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def _query(name: str):
    def register(build):
        QUERIES[name] = build
        return build

    return register


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@_query("op1_ngram_jaccard_join")
def jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_components(_table(spark, sf_dir, "documents"), n=4, percent=85)


@_query("op10_quality_rules")
def quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source")
    return measured(docs).select(
        "row_.doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        "base_failed", "kept")


SQL["op10_quality_rules"] = QUALITY_RULES


@_query("op4_source_mixing")
def source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    return mixed(docs).select("row_.doc_id", "row_.source", "block", "slot", "place")


@_query("op6_substring_dedup")
def substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeated_passages(_table(spark, sf_dir, "documents"), min_words=50, percent=80)


@_query("op3_sentence_pieces")
def sentence_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests(_table(spark, sf_dir, "documents"), piece_model())


@_query("op2_language_id")
def language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    model = train(docs.where(f"NOT coalesce({HELD_OUT}, false)"))
    return identified(docs, model).select(
        "doc_id", F.expr(f"coalesce({HELD_OUT}, false)").alias("held_out"), "lang_pred", "score")


@_query("op9_quality_classifier")
def quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classified(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


@_query("op5_license_scan")
def license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scanned(_table(spark, sf_dir, "documents").select("doc_id", "text")).select(
        "row_.doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels",
        "score")


@_query("op8_token_files")
def token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = _table(spark, sf_dir, "documents")
    return token_index(docs, public_tokenizers.path("byte_bpe_50k.json"), end_id=2)


@_query("op7_block_search")
def block_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_products(_table(spark, sf_dir, "embeddings"), every=50, k=5)


SQL["op7_block_search"] = BLOCK_SEARCH


@_query("op11_periodic_runs")
def periodic_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    return periodic_runs.digests(_table(spark, sf_dir, "documents"), least=12)


@_query("op12_byte_pairs")
def byte_pair_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return byte_pairs.digests(_table(spark, sf_dir, "documents"), byte_pairs.many_languages())


@_query("op13_embedding_whitening")
def embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return by_component(_table(spark, sf_dir, "embeddings"), components=32)
