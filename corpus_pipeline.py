"""The corpus pipeline: stages over documents, each written as Parquet and read again.

Documents without a clear language go, one document of each near-duplicate group stays, secrets are marked out, sources
are mixed to tempered weights, and what is left is packed into sequences. A stage works on all that the one before it
kept. Nulls, empty and long texts, repeated rows, empty tables and extra columns are handled as the operators state.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from zephyrgrid.llm import jaccard, language_id, mixing, packing, secrets
from zephyrgrid.session import configure, stage

TOKENIZER = str(public_tokenizers.path("word_bpe_49k.json"))
# No source is cut: the budget is the smallest that sees every source whole, and no source is seen more than twice.
MAX_REPEATS = 2.0


def keep_known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is clear, by a model of the labelled ones among them."""
    return language_id.keep_known(docs, language_id.fit(docs))


def keep_one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document of the smallest id of each near-duplicate group."""
    return jaccard.keep_first(docs)


def mark_out_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with secrets replaced in their texts."""
    return secrets.redact_documents(docs)


def mix_to_weights(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as tempered source weights ask for."""
    return mixing.mix_sources(docs, max_repeats=MAX_REPEATS).select(*[f"`{c}`" for c in docs.columns])


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents in sequences of fixed length."""
    return packing.pack(docs, TOKENIZER)


STAGES = [
    ("language ID", keep_known_language),
    ("n-gram Jaccard join", keep_one_of_each_group),
    ("secret scans", mark_out_secrets),
    ("mixing sources to target weights", mix_to_weights),
    ("packing", pack_sequences),
]
# Compression sizes, hashes and tokens are beyond SQL; the tests compare with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents."""
    docs = configure(spark).read.parquet(f"{sf_dir}/documents.parquet")
    for name, step in STAGES:
        docs = stage(step(spark, docs, sf_dir), name.replace(" ", "-"))
    return docs
