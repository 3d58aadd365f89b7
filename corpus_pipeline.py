"""The corpus pipeline: toxicity, line de-duplication, near copies, mixing, packing.

Each stage takes ``(spark, docs, sf_dir)`` and returns a DataFrame that is written as Parquet and read again as the next one's ``docs``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from whyframe.llm.common import scratch
from whyframe.llm.line_dedup import LineIndex
from whyframe.llm.mixing import mix, repeated
from whyframe.llm.near_copies import keep_first
from whyframe.llm.packing import pack
from whyframe.llm.queries import MOST_TOKENS, labelled_languages, word_tokenizer
from whyframe.llm.toxicity import fit_lexicon, reject

# Shares of tokens by language. Languages below their share are repeated; no document is thinned out.
TARGETS = {"en": 0.55, "de": 0.17, "fr": 0.17, "es": 0.11}


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejected documents go, all others stay as they are."""
    return reject(docs, fit_lexicon(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Long lines that five or more documents hold stay only in the last of them."""
    return LineIndex.build(docs).clean(docs, keep=True)


def simhash(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies (Jaccard similarity of five-word shingles at least 0.8) the document with the smallest id stays."""
    return keep_first(docs)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of languages below their target are repeated as their rate says."""
    return repeated(docs, mix(docs, labelled_languages(spark, sf_dir), TARGETS, least=1.0))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row per piece of a document in a sequence."""
    return pack(docs, word_tokenizer(), MOST_TOKENS)


STAGES = [("toxicity", toxicity), ("line_dedup", line_dedup), ("simhash", simhash), ("mixing", mixing), ("packing", packing)]
# A classifier's fit, a fingerprint hash and a tokenizer are no SQL; the stages are tested against brute force instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = scratch(stage(spark, docs, sf_dir), name)
    return docs
