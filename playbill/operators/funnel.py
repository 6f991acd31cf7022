"""Engagement funnel, company metrics and conversion attribution."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from playbill import vocab
from playbill.functions.text import json_context, ratio


def _rates(df: DataFrame) -> DataFrame:
    i, o, b = F.col("impressions"), F.col("opens"), F.col("booking_clicks")
    return df.withColumns({"open_rate": ratio(o, i), "booking_click_rate": ratio(b, i), "click_from_open_rate": ratio(b, o)})


def listing_meta(listings: DataFrame) -> DataFrame:
    """Fallback labels of a listing; several sources are one joined label by design."""
    label = lambda c, default: F.coalesce(F.nullif(c, F.lit("")), F.lit(default))
    return listings.select(
        F.col("id").alias("event_id"),
        label(F.array_join("source_names", ", "), vocab.UNKNOWN_SOURCE).alias("m_source"),
        label(F.col("event_type"), vocab.UNKNOWN_TYPE).alias("m_type"),
        label(F.col("booking_partner"), vocab.UNKNOWN_PARTNER).alias("m_partner"),
    )


def funnel_log(engagement: DataFrame, clicks: DataFrame, meta: DataFrame | None = None) -> DataFrame:
    """Both logs as one row set with resolved source, type and partner."""
    steps = engagement.filter(F.col("action").isin("impression", "activity_open")).select(
        "event_id", F.col("partner"), "context_json", F.when(F.col("action") == "impression", "impression").otherwise("open").alias("step")
    )
    out = clicks.select("event_id", F.col("partner_name").alias("partner"), "context_json", F.lit("click").alias("step"))
    log = steps.unionByName(out).withColumn("ctx", json_context("context_json"))
    if meta is not None:
        log = log.join(meta, "event_id", "left")
    else:
        log = log.withColumns({c: F.lit(None).cast("string") for c in ("m_source", "m_type", "m_partner")})

    def pick(*cells: Column, default: str) -> Column:
        return F.coalesce(*[F.nullif(c, F.lit("")) for c in cells], F.lit(default))

    ctx = lambda k: F.try_element_at("ctx", F.lit(k))
    return log.select(
        "step",
        pick(ctx("source"), F.col("m_source"), default=vocab.UNKNOWN_SOURCE).alias("source"),
        pick(ctx("event_type"), F.col("m_type"), default=vocab.UNKNOWN_TYPE).alias("event_type"),
        pick(F.col("partner"), ctx("partner"), F.col("m_partner"), default=vocab.UNKNOWN_PARTNER).alias("partner"),
    )


def funnel_report(log: DataFrame) -> DataFrame:
    """Counts and rates in total and by source, type and partner, from one pass.

    Rows are reduced to one per (step, source, type, partner) before the grouping
    sets multiply them.
    """
    small = log.groupBy("step", "source", "event_type", "partner").agg(F.count("*").alias("n"))
    n = lambda step: F.coalesce(F.sum(F.when(F.col("step") == step, F.col("n"))), F.lit(0)).cast("bigint")
    sets = [[F.col("source")], [F.col("event_type")], [F.col("partner")], []]
    grouped = small.groupingSets(sets, "source", "event_type", "partner").agg(
        F.grouping_id().alias("_g"), n("impression").alias("impressions"), n("open").alias("opens"), n("click").alias("booking_clicks")
    )
    dim = F.when(F.col("_g") == 3, "source").when(F.col("_g") == 5, "event_type").when(F.col("_g") == 6, "partner").otherwise("total")
    named = grouped.withColumns({"dimension": dim, "name": F.coalesce("source", "event_type", "partner", F.lit(""))})
    return _rates(named.select("dimension", "name", "impressions", "opens", "booking_clicks"))


def company_metrics(engagement: DataFrame) -> DataFrame:
    count = lambda a: F.count_if(F.col("action") == a)
    out = engagement.filter(F.col("company").isNotNull()).groupBy("company").agg(
        count("sponsored_impression").alias("impressions"), count("activity_open").alias("activity_visits"),
        count("booking_outbound").alias("booking_clicks"), count("sponsored_click").alias("sponsored_clicks"),
    )
    return out.withColumn("ctr", ratio(F.col("sponsored_clicks"), F.col("impressions")))


def attribution_report(clicks: DataFrame, conversions: DataFrame) -> DataFrame:
    """Clicks, conversions and confirmed conversions per partner.

    Conversions are reduced to one row per click before the join, so a click with very
    many conversions does not multiply rows.
    """
    per_click = conversions.groupBy("click_id").agg(F.count("*").alias("n"), F.count_if(F.col("status") == "confirmed").alias("ok"))
    joined = clicks.select("click_id", "partner_key", "partner_name").join(per_click, "click_id", "left")
    total = lambda c: F.coalesce(F.sum(c), F.lit(0)).cast("bigint")
    return joined.groupBy("partner_key", "partner_name").agg(
        F.count("*").alias("clicks"), total("n").alias("conversions"), total("ok").alias("confirmed")
    )


def attribution_totals(clicks: DataFrame, conversions: DataFrame) -> DataFrame:
    confirmed = F.col("status") == "confirmed"
    money = F.coalesce(F.sum(F.when(confirmed, F.col("commission_value")).cast("decimal(28,2)")), F.lit(0).cast("decimal(28,2)"))
    totals = conversions.agg(F.count("*").alias("conversions"), F.count_if(confirmed).alias("confirmed"), money.alias("commission"))
    return clicks.agg(F.count("*").alias("clicks")).crossJoin(totals)  # one row each side
