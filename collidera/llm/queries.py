"""Registered queries over the operators of this subpackage, and their SQL counterparts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

import corpus_pipeline
from collidera.llm import chat_formatting, embedding_dedup, mixing, sql, warc
from collidera.llm.centroid_clustering import centroid_clustering
from collidera.llm.decontamination import decontamination
from collidera.llm.language_id import language_id
from collidera.llm.packing import pack
from collidera.llm.quality_classifier import quality
from collidera.llm.quality_rules import quality_rules
from collidera.llm.session import table
from collidera.llm.simhash import simhash_dedup
from collidera.llm.token_alignment import token_alignment
from collidera.llm.toxicity import toxicity


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules(table(spark, sf_dir, "documents"), with_text=False)


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id(table(spark, sf_dir, "documents"))


def op4_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_dedup.embedding_dedup(table(spark, sf_dir, "embeddings"))


def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mixed(table(spark, sf_dir, "documents"))


def op6_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op7_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spans are written as ``start-end,...`` so that rows compare as plain values."""
    pairs = chat_formatting.preferences(table(spark, sf_dir, "conversations"))

    def spans(column: str) -> Column:
        texts = F.transform(column, lambda s: F.concat_ws("-", s["start"], s["end"]))
        return F.array_join(texts, ",")

    return pairs.withColumns({c: spans(c) for c in ("chosen_learned", "rejected_learned")})


def op8_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.warc_round_trip(table(spark, sf_dir, "pages"))


def op9_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_dedup(table(spark, sf_dir, "documents"))


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"), with_ids=False)


def op11_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op12_centroid_clustering(spark: SparkSession, sf_dir: str) -> DataFrame:
    return centroid_clustering(table(spark, sf_dir, "embeddings"))


def op13_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_alignment(table(spark, sf_dir, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_toxicity": op1_toxicity,
        "op2_quality_rules": op2_quality_rules,
        "op3_language_id": op3_language_id,
        "op4_embedding_dedup": op4_embedding_dedup,
        "op5_mixing": op5_mixing,
        "op6_quality_classifier": op6_quality_classifier,
        "op7_chat_formatting": op7_chat_formatting,
        "op8_warc": op8_warc,
        "op9_simhash": op9_simhash,
        "op10_packing": op10_packing,
        "op11_decontamination": op11_decontamination,
        "op12_centroid_clustering": op12_centroid_clustering,
        "op13_token_alignment": op13_token_alignment,
        "pipeline": corpus_pipeline.run,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op2_quality_rules": sql.QUALITY_RULES,
        "op4_embedding_dedup": sql.EMBEDDING_DEDUP,
        "op5_mixing": mixing.ORACLE_SQL,
        "op7_chat_formatting": sql.CHAT_FORMATTING,
        "op8_warc": warc.ORACLE_SQL,
        "op11_decontamination": sql.DECONTAMINATION,
        "op12_centroid_clustering": sql.centroid_clustering(),
    }
