"""From raw documents to packed training sequences, in five stages.

Quality and toxicity are judged by models learned from ``labels`` on a bounded sample of
the documents that reach the stage; a document goes when its score says so. Of each
group of near-duplicates the document with the smallest id stays. The mix repeats and
cuts what is left to the target weights of its sources, and packing turns the result
into sequences. Every stage reads the table that the one before wrote.

Rows that repeat an id or have none are documents like any other in every stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from collidera.llm.mixing import mixed_texts
from collidera.llm.packing import pack
from collidera.llm.quality_classifier import fit_quality, quality_scorer
from collidera.llm.session import table
from collidera.llm.simhash import simhash_groups
from collidera.llm.terms import kept_by_score
from collidera.llm.toxicity import fit_toxicity, toxicity_scorer
from collidera.sources.shared_folder import new_path, settled

GOOD = 0.5
TOXIC = 0.3


def good_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier does not reject."""
    weights = fit_quality(docs, table(spark, sf_dir, "labels"), F.lit(True))
    return kept_by_score(docs, quality_scorer(spark, weights), lambda score: score >= GOOD)


def harmless_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity machine does not reject."""
    machine = fit_toxicity(docs, table(spark, sf_dir, "labels"), F.lit(True))
    return kept_by_score(docs, toxicity_scorer(spark, machine), lambda score: score < TOXIC)


def distinct_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates.

    Rows are told apart by their place, so that repeated and missing ids are documents like
    any other. The smallest id stays; of its rows the one whose text hashes lowest.
    """
    row = "_row"
    while row in docs.columns:
        row += "_"
    numbered = settled(docs.withColumn(row, F.monotonically_increasing_id())).table
    place = F.struct(
        F.col("doc_id").isNull().alias("nameless"),
        F.col("doc_id").alias("id"),
        F.xxhash64("text").alias("hash"),
        F.col(row).alias("row"),
    )
    groups = simhash_groups(numbered.select(place.alias("doc_id"), "text"))
    kept = groups.filter(F.col("doc_id.row") == F.col("component_id.row"))
    stays = kept.select(F.col("doc_id.row").alias(row))
    return numbered.join(stays, row, "left_semi").select(docs.columns)


def mixed_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts as often and as long as the target weights of their sources ask for."""
    return mixed_texts(docs)


def packed_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sequences of lexically close documents, one row per piece."""
    return pack(docs, with_ids=False)


STAGES = [
    ("quality", good_documents),
    ("toxicity", harmless_documents),
    ("near_duplicates", distinct_documents),
    ("mix", mixed_documents),
    ("pack", packed_documents),
]

#: SQL cannot run the trained models and the tokenizer; tests hold the stages to plain code.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written to the shared folder and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        path = new_path(spark, name)
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
