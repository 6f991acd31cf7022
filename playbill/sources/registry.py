"""Source registry dimension; thirty-five fixed rows, so lookups may broadcast it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from playbill import vocab

SCHEMA = "key string, name string, source_type string, city string, trust_level string, enabled boolean"


def sources(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(vocab.SOURCES, SCHEMA)


def by_key(df: DataFrame, key: str = "source_key") -> DataFrame:
    """Adds the registry columns of a source key; unknown keys are dropped."""
    return df.join(F.broadcast(sources(df.sparkSession)), F.col(key) == F.col("key"), "inner").drop("key")


def enabled(df: DataFrame, keys, column: str = "source_key") -> DataFrame:
    """Rows of switched-on optional sources; unknown keys are ignored."""
    known = {row[0] for row in vocab.SOURCES}
    wanted = sorted({k for k in keys if k in known})
    return df.filter(F.col(column).isin(wanted))
