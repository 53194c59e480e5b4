"""From raw documents to token ids: toxicity, near-dedup, secrets, mix, encoding.

All stages take null texts as empty ones and leave them null, keep rows with null ids apart by their texts, pass on columns of any
name, and make an empty table of an empty one.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from cohortcast.llm import bpe, mixing, secrets, simhash, toxicity
from cohortcast.session import materialize, ship_package
from cohortcast.sources.tables import load

RANKS_FILE = "byte_bpe_50k.tiktoken"


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity models, trained on the labelled ones among `docs`, do not reject; all of them where the labels lack a class."""
    ship_package(spark)
    return toxicity.drop_toxic(docs, toxicity.fit(docs, load(spark, sf_dir, "labels")))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of every SimHash component: that of the smallest id, null ids last; empty and null texts are one component."""
    ship_package(spark)
    return simhash.keep_one(docs)


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with their secrets replaced by a mark; repeated rows alike."""
    return secrets.redact(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix of sources: a row per pass over a document, with the words that the pass takes; a null source is one of its own, texts without words go."""
    return mixing.mixed_documents(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every text of the mix, with the digests of ids and decoded bytes."""
    ship_package(spark)
    return bpe.encode_documents(docs, public_tokenizers.path(RANKS_FILE), public_tokenizers.PATTERN)


Stage = Callable[[SparkSession, DataFrame, str], DataFrame]

STAGES: list[tuple[str, Stage]] = [
    ("toxicity", drop_toxic),
    ("simhash_near_dedup", drop_near_duplicates),
    ("secret_scan", redact_secrets),
    ("source_mixing", mix),
    ("bpe_encoding", encode),
]

# Language models, SimHash components and BPE have no SQL form.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over `documents`; each result is written and read again as the next one's input."""
    docs = load(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
