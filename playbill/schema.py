"""Declared schemas.  Nothing in the package infers a schema from data."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

SOURCE_RECORD = "struct<source:string,external_id:string,source_url:string,fetched_at:string,raw_title:string,confidence:double,payload:map<string,string>>"

LISTING_DDL = f"""
id string, title string, event_type string, category string,
start_date string, end_date string, start_time string, end_time string, door_time string, age_limit string,
venue string, city string, region string, country string,
latitude double, longitude double, venue_latitude double, venue_longitude double,
image_url string, official_url string, ticket_url string, booking_url string,
status string, source_names array<string>, source_count int,
source_records array<{SOURCE_RECORD}>,
verified_at string, created_at string, updated_at string, description string,
tags array<string>, excluded_dates array<string>, is_demo boolean,
data_quality string, quality_notes array<string>,
price_min double, price_max double, currency string, price_status string,
is_sponsored boolean, sponsor_campaign_id string, sponsor_company string,
sponsor_start_date string, sponsor_end_date string,
sponsor_geo_areas array<string>, sponsor_audiences array<string>, sponsor_priority int,
booking_partner string, booking_partner_key string, booking_partner_domain string,
affiliate_status string, affiliate_program string, affiliate_ref string,
ingest_ord bigint
"""

_DEFAULTS = {
    "status": "unknown", "source_count": 1, "description": "", "is_demo": False, "data_quality": "source_verified",
    "currency": "SEK", "price_status": "unknown", "is_sponsored": False, "sponsor_priority": 0,
    "affiliate_status": "unassessed", "region": "", "country": "", "venue": "", "city": "",
}


def listing_type() -> T.StructType:
    return T.StructType.fromDDL(LISTING_DDL)


def as_listings(df: DataFrame) -> DataFrame:
    """Fits a DataFrame to the listing schema: casts, and fills absent columns with their defaults."""
    have, out = set(df.columns), []
    for field in listing_type():
        if field.name in have:
            value = F.col(field.name).cast(field.dataType)
        elif field.name in _DEFAULTS:
            value = F.lit(_DEFAULTS[field.name]).cast(field.dataType)
        elif isinstance(field.dataType, T.ArrayType):
            value = F.array().cast(field.dataType)
        else:
            value = F.lit(None).cast(field.dataType)
        out.append(value.alias(field.name))
    return df.select(out)


def require(df: DataFrame, column: str, allowed) -> DataFrame:
    """Write-time assertion on an enumerated column."""
    bad = F.col(column).isNull() | ~F.col(column).isin(list(allowed))
    message = F.concat(F.lit(f"{column}: value outside the allowed set: "), F.coalesce(F.col(column), F.lit("null")))
    return df.withColumn(column, F.when(bad, F.raise_error(message)).otherwise(F.col(column)))


BENCHMARK_REF = "id string, title string, start_date string, city string, venue string, category string, reference_source string, reference_url string, checked_at string"
IMPORT_STATUS = "source string, status string, imported int, comment string"
ENGAGEMENT = "id bigint, occurred_at timestamp, action string, event_id string, campaign_id string, company string, partner string, context_json string"
CLICKS = "click_id string, created_at timestamp, event_id string, partner_key string, partner_name string, campaign_id string, destination_url string, context_json string"
CONVERSIONS = "recorded_at timestamp, click_id string, partner_conversion_id string, status string, order_value double, currency string, commission_value double, commission_currency string, raw_json string"
RAW_PAGES = "url string, source_key string, html string, fetched_at timestamp, page_kind string"
SNAPSHOT = (
    "source string, snapshot_day date, recorded_at timestamp, status string, candidate_events int, represented_after_dedupe int, "
    "unique_events int, overlap_events int, unique_share double, bookable int, event_types array<string>, "
    "unique_event_types array<string>, frontier_segments array<string>, unique_frontier_segments array<string>, "
    "underserved_segments array<string>, unique_events_in_underserved_segments int"
)
