"""Similarity joins over distinct titles without comparing all pairs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from playbill.functions.text import jaccard, search_text, words


def jaccard_pairs(titles: DataFrame, floor: float = 0.0) -> DataFrame:
    """Pairs of distinct titles that share a word, with the overlap of their word sets."""
    df = titles.select("title", words(search_text("title")).alias("w"))
    parts = df.select("title", F.explode("w").alias("word"))
    pairs = (
        parts.alias("a").join(parts.alias("b"), (F.col("a.word") == F.col("b.word")) & (F.col("a.title") < F.col("b.title")))
        .select(F.col("a.title").alias("left_title"), F.col("b.title").alias("right_title")).distinct()
    )
    left, right = df.select(F.col("title").alias("left_title"), F.col("w").alias("lw")), df.select(F.col("title").alias("right_title"), F.col("w").alias("rw"))
    scored = pairs.join(left, "left_title").join(right, "right_title").withColumn("overlap", jaccard(F.col("lw"), F.col("rw")))
    return scored.filter(F.col("overlap") >= floor).select("left_title", "right_title", "overlap")
