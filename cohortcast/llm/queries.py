"""Registered queries of the text operators, and the SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

import corpus_pipeline
import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortcast.llm import ann, bpe, chat, codes, langid, mixing, negatives, oracles, quality, secrets, sharding, simhash, spans, toxicity
from cohortcast.session import ship_package
from cohortcast.sources.tables import load

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

RANKS_FILE = "byte_bpe_50k.tiktoken"


def register(name: str, sql: str | None = None):
    def wrap(fn):
        @wraps(fn)
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            ship_package(spark)
            return fn(spark, sf_dir)

        QUERIES[name] = run
        if sql is not None:
            ORACLES[name] = sql
        return fn
    return wrap


@register("op1_secret_scan", oracles.secret_scan())
def op1_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.scan(load(spark, sf_dir, "documents"))


@register("op2_toxicity")
def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity(load(spark, sf_dir, "documents"), load(spark, sf_dir, "labels"))


@register("op3_substring_dedup")
def op3_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spans.drop_repeats(load(spark, sf_dir, "documents"))


@register("op4_quality_rules", oracles.quality_rules())
def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality_rules(load(spark, sf_dir, "documents"), keep_text=False)


@register("op5_mixing", oracles.mix())
def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_sources(load(spark, sf_dir, "documents"))


@register("op6_ann")
def op6_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.nearest(load(spark, sf_dir, "embeddings"))


@register("op7_chat_format")
def op7_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = load(spark, sf_dir, "conversations")
    calls, results = chat.turns_as_calls(turns)
    return chat.link_calls(calls, results, {"reply": chat.REPLY_SCHEMA}).unionByName(chat.other_turns(turns))


@register("op8_langid")
def op8_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify(load(spark, sf_dir, "documents"))


@register("op9_bpe")
def op9_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode_documents(load(spark, sf_dir, "documents"), public_tokenizers.path(RANKS_FILE), public_tokenizers.PATTERN,
                                keep_ids=False)


@register("op10_simhash")
def op10_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(load(spark, sf_dir, "documents"))


@register("op11_sharding", oracles.sharding_places())
def op11_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.assign(load(spark, sf_dir, "documents"), carry=False)


@register("op12_vector_codes", oracles.vector_codes())
def op12_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return codes.compress(load(spark, sf_dir, "embeddings")).drop("rescans")


@register("op13_hard_negatives", oracles.hard_negatives())
def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return negatives.mine(load(spark, sf_dir, "embeddings").withColumn("label", label))


register("pipeline", corpus_pipeline.ORACLE_SQL)(corpus_pipeline.run)
