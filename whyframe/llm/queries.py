"""Queries of the training-data operators and, where SQL can express them, their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from whyframe.llm import oracles
from whyframe.llm.common import crc_fold
from whyframe.llm.embeddings import near_vectors
from whyframe.llm.kneser_ney import quality_by_perplexity
from whyframe.llm.line_dedup import LineIndex
from whyframe.llm.mixing import mix
from whyframe.llm.packing import pack
from whyframe.llm.prefix_trie import prefix_trie
from whyframe.llm.quality_rules import quality_rules
from whyframe.llm.sharding import shard_documents
from whyframe.llm.simhash import simhash_components
from whyframe.llm.spelling import spelling_variants
from whyframe.llm.token_counts import token_counts
from whyframe.llm.toxicity import fit_lexicon, score_documents
from whyframe.llm.urls import judge_urls

Query = Callable[[SparkSession, str], DataFrame]
MOST_TOKENS = 2048
SHARDS = 8
TARGETS = {"en": 0.4, "de": 0.2, "fr": 0.2, "es": 0.2}
URL_RULES = [("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"), ("allow", "com", "/fr/"), ("block", "com", "/de/")]


def word_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def _table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def labelled_languages(spark: SparkSession, folder: str) -> DataFrame:
    """``(doc_id, domain)``: the labelled documents with their language as domain."""
    docs = _table(spark, folder, "documents").select("doc_id", F.col("lang").alias("domain"))
    return docs.join(_table(spark, folder, "labels").select("doc_id").distinct(), "doc_id", "left_semi")


def op1_mix(spark: SparkSession, folder: str) -> DataFrame:
    rated = mix(_table(spark, folder, "documents"), labelled_languages(spark, folder), TARGETS)
    rows = rated.withColumn("_", F.explode(F.sequence(F.lit(1), F.col("k"))))
    return rows.select(F.col("id").alias("doc_id"), "tokens", *[F.col("p")[i].alias(f"p_{d}") for i, d in enumerate(TARGETS)], "rate")


def op2_near_vectors(spark: SparkSession, folder: str) -> DataFrame:
    return near_vectors(_table(spark, folder, "embeddings"))


def op3_perplexity(spark: SparkSession, folder: str) -> DataFrame:
    trusted = _table(spark, folder, "labels").where("quality = 1").select("doc_id")
    return quality_by_perplexity(_table(spark, folder, "documents"), trusted)


def op4_token_counts(spark: SparkSession, folder: str) -> DataFrame:
    return token_counts(_table(spark, folder, "documents"), word_tokenizer()).withColumn("over_limit", F.col("n_tokens") > MOST_TOKENS)


def op5_quality_rules(spark: SparkSession, folder: str) -> DataFrame:
    return quality_rules(_table(spark, folder, "documents"), cleaned=False).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "kept_words")


def op6_pack(spark: SparkSession, folder: str) -> DataFrame:
    return pack(_table(spark, folder, "documents"), word_tokenizer(), MOST_TOKENS)


def op7_line_dedup(spark: SparkSession, folder: str) -> DataFrame:
    docs = _table(spark, folder, "documents")
    return LineIndex.build(docs).clean(docs).select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


def op8_url_filter(spark: SparkSession, folder: str) -> DataFrame:
    return judge_urls(_table(spark, folder, "pages"), URL_RULES).select("page_id", "host", "path", "rule", "verdict")


def op9_simhash(spark: SparkSession, folder: str) -> DataFrame:
    found = simhash_components(_table(spark, folder, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op10_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    docs = _table(spark, folder, "documents")
    scored = score_documents(docs, fit_lexicon(docs, _table(spark, folder, "labels")))
    return scored.select("doc_id", (crc_fold(F.col("doc_id"), 5) == 0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op11_prefix_trie(spark: SparkSession, folder: str) -> DataFrame:
    return prefix_trie(_table(spark, folder, "conversations"))


def op12_sharding(spark: SparkSession, folder: str) -> DataFrame:
    placed, _ = shard_documents(_table(spark, folder, "documents"), SHARDS)
    return placed.select(F.col("id").alias("doc_id"), "size", F.col("crc").alias("text_crc32"), F.lit("bytes").alias("law"), "shard", F.col("position").cast("long").alias("slot"),
                         F.lit(None).cast("int").alias("grown_shard"), F.col("vslot").alias("virtual_slot"))


def op13_spelling_variants(spark: SparkSession, folder: str) -> DataFrame:
    return spelling_variants(_table(spark, folder, "documents"))


QUERIES: dict[str, Query] = {f.__name__: f for f in (op1_mix, op2_near_vectors, op3_perplexity, op4_token_counts, op5_quality_rules, op6_pack,
                                                     op7_line_dedup, op8_url_filter, op9_simhash, op10_toxicity, op11_prefix_trie, op12_sharding,
                                                     op13_spelling_variants)}
ORACLES: dict[str, str] = {"op7_line_dedup": oracles.OP7, "op11_prefix_trie": oracles.OP11, "op13_spelling_variants": oracles.OP13}
