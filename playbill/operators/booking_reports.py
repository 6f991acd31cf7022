"""Booking coverage and partner reports."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from playbill import vocab
from playbill.functions import booking


def booking_coverage(listings: DataFrame) -> DataFrame:
    """Per source: link quality counts and the partners behind bookable listings.

    Two levels: (source, partner) first, so that the partner map holds one entry per
    partner and never one per listing.
    """
    names = F.when(F.size("source_names") > 0, F.col("source_names")).otherwise(F.array(F.lit(vocab.UNKNOWN_SOURCE)))
    rows = (
        booking.with_cta(booking.with_attribution(listings))
        .select(F.col("cta_quality").alias("quality"), F.nullif("booking_partner", F.lit("")).alias("partner"), F.explode(names).alias("source"))
    )
    count = lambda q: F.count_if(F.col("quality") == q)
    by_partner = rows.groupBy("source", "partner").agg(
        F.count("*").alias("total"), *[count(q).alias(q) for q in ("bookable", "useful", "weak", "missing")]
    )
    partner = F.when(F.col("partner").isNotNull() & (F.col("bookable") > 0), F.struct((-F.col("bookable")).alias("n"), F.col("partner").alias("name")))
    out = by_partner.groupBy("source").agg(
        *[F.sum(c).alias(c) for c in ("total", "bookable", "useful", "weak", "missing")], F.array_sort(F.collect_list(partner)).alias("_p")
    )
    partners = F.transform("_p", lambda p: F.struct(p["name"].alias("name"), (-p["n"]).alias("bookable")))
    covered = F.when(F.col("total") > 0, F.col("bookable") / F.col("total")).otherwise(F.lit(0.0))
    return out.withColumns({"booking_coverage": covered, "partners": partners}).drop("_p")


def booking_totals(coverage: DataFrame) -> DataFrame:
    """Totals count a listing once per source, by definition of the report."""
    out = coverage.agg(F.coalesce(F.sum("total"), F.lit(0)).alias("total"), F.coalesce(F.sum("bookable"), F.lit(0)).alias("bookable"))
    return out.withColumn("booking_coverage", F.when(F.col("total") > 0, F.col("bookable") / F.col("total")).otherwise(F.lit(0.0)))


def partner_report(listings: DataFrame) -> DataFrame:
    rows = listings.withColumn("_link", booking.ticket_link()).filter(F.col("_link").isNotNull()).withColumn("a", booking.attribution(F.col("_link")))
    return rows.groupBy(
        F.col("a.key").alias("partner_key"), F.col("a.name").alias("partner"), F.col("a.affiliate_status").alias("affiliate_status"), F.col("a.direct").alias("direct")
    ).agg(F.count("*").alias("bookable_listings"))
