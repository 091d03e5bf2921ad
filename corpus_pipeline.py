"""A corpus pipeline of five stages; each works on all that the one before kept.

Every stage takes any table with the columns of documents, and keeps extra ones, whatever their names, but for the last.
Null ids, sources and languages are values like others; a null text is empty. Very long texts are worked on whole. An
empty table stays empty. Rows that repeat are told apart by nothing, so each stage treats them alike, except that the
near-dedup keeps rows by id: those that repeat the id of a kept row stay with it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veilscan.llm.lines import dedup_lines
from veilscan.llm.minhash import near_duplicates
from veilscan.llm.mixing import mixed_documents
from veilscan.llm.packing import pack
from veilscan.llm.quality import kept_documents
from veilscan.llm.work import Work


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the base rules or their language's perplexity band reject go: null and empty texts among them."""
    return kept_documents(docs)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The first of each class of lines stays; documents left without a word go, those that had none stay."""
    return dedup_lines(docs).withColumn("n_chars", F.length("text").cast("long"))


def minhash_near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of each group of near-duplicates stays; those with a null id stay."""
    kept = near_duplicates(docs).where("kept").select(F.col("doc_id").alias("_kept_id"))
    return docs.join(kept, docs["doc_id"].eqNullSafe(F.col("_kept_id")), "left_semi").select(*docs.columns)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them; a null source is a source."""
    return mixed_documents(docs)


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row per piece of a document in a training sequence; an empty text is a piece of one token."""
    return pack(docs)


STAGES = [
    ("quality rules", quality_rules),
    ("line dedup", line_dedup),
    ("minhash near-dedup", minhash_near_dedup),
    ("mixing sources", mix_sources),
    ("best-fit packing", best_fit_packing),
]

#: Quality rules need a language model: SQL can't express them.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage; each stage's are written as Parquet and read again, and freed once the next stage's are there."""
    work = Work(spark, "pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES):
        out = work.save(stage(spark, docs, sf_dir))
        if k:
            work.drop(docs)
        docs = out
    return docs
