"""The corpus pipeline: language, near copies, secrets, mixture, packed sequences.

Each stage takes what the one before kept, as a table, and hands on the columns of documents; the
last one gives the pieces of the packed sequences.  Empty tables pass through every stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from playbill.llm import langid, mixing, packing, secrets, simhash
from playbill.llm.common import table
from playbill.plans.registry import query
from playbill.session import cut


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is told clearly, with that language; the rejected ones go."""
    named = langid.identify(docs, langid.fit(docs)).filter("NOT rejected")
    return named.withColumn("lang", F.col("lang_pred")).select(*docs.columns)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies."""
    return simhash.keep_one(docs)


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with secrets replaced by the name of their kind."""
    return secrets.redact(docs)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mixture takes it."""
    return mixing.apply_mix(docs)


def sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces with their places in the packed sequences."""
    return packing.pack_documents(docs)


STAGES = [("language", language), ("near_copies", near_copies), ("secrets", secret_scan), ("mixture", mixture), ("packing", sequences)]

# Compression, packing search and tokens are not SQL; the stages are tested against plain loops.
ORACLE_SQL = None


@query("pipeline")
def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            docs = cut(docs)
    return docs
