"""Batch forms of the stateful operators; streams apply them per micro-batch."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def sightings(rows: DataFrame) -> DataFrame:
    """First and last time every listing id was seen; two partial aggregates."""
    return rows.filter(F.col("event_id").isNotNull()).groupBy("event_id").agg(F.min("seen_at").alias("first_seen_at"), F.max("seen_at").alias("last_seen_at"))


def merge_sightings(known: DataFrame, batch: DataFrame) -> DataFrame:
    """Known ids keep their first sighting."""
    return known.unionByName(batch).groupBy("event_id").agg(F.min("first_seen_at").alias("first_seen_at"), F.max("last_seen_at").alias("last_seen_at"))


def first_per_key(rows: DataFrame, keys, order: str) -> DataFrame:
    """First row per key in a total order, as a partial aggregate rather than a window over the group."""
    payload = [c for c in rows.columns if c not in keys and c != order]
    row = F.min(F.struct(order, *payload))
    return rows.groupBy(*keys).agg(row.alias("_r"), F.count("*").alias("attempts")).select(*keys, "_r.*", "attempts")


def windowed_funnel(rows: DataFrame, width: str = "1 hour") -> DataFrame:
    n = lambda s: F.count_if(F.col("step") == s)
    out = rows.groupBy(F.window("occurred_at", width)).agg(n("impression").alias("impressions"), n("open").alias("opens"), n("click").alias("booking_clicks"))
    return out.select(F.col("window.start").alias("hour"), "impressions", "opens", "booking_clicks")
