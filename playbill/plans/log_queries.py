"""Engagement, attribution and state queries over the event and order tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from playbill.functions.text import json_context
from playbill.operators import funnel
from playbill.plans.registry import query
from playbill.plans.td import table


def _engagement(spark, sf):
    """Events as an engagement log: views are impressions, clicks are opens."""
    e = table(spark, sf, "events")
    action = F.when(F.col("event_type") == "view", "impression").when(F.col("event_type") == "click", "activity_open").otherwise("cta_click")
    context = F.when(F.col("event_id") % 3 == 0, F.concat(F.lit('{"source": "S'), (F.col("event_id") % 7).cast("string"), F.lit('"}'))).when(F.col("event_id") % 3 == 1, F.lit("not json")).otherwise(F.col("props"))
    return e.select(
        F.col("event_id").alias("id"), F.col("ts").alias("occurred_at"), action.alias("action"), F.col("user_id").cast("string").alias("event_id"),
        F.when(F.col("event_id") % 5 == 0, F.concat(F.lit("P"), (F.col("event_id") % 4).cast("string"))).alias("partner"), context.alias("context_json"),
    )


def _outbound(spark, sf):
    e = table(spark, sf, "events").filter(F.col("event_type") == "purchase")
    return e.select(F.col("user_id").cast("string").alias("event_id"), F.concat(F.lit("P"), (F.col("event_id") % 4).cast("string")).alias("partner_name"), F.lit("").alias("context_json"))


def _meta(spark, sf):
    c = table(spark, sf, "customer")
    return c.select(F.col("c_custkey").cast("string").alias("event_id"), F.col("c_mktsegment").alias("m_source"), F.when(F.col("c_custkey") % 2 == 0, "even").alias("m_type"), F.lit("").alias("m_partner"))


_LOG = """log AS (SELECT CASE event_type WHEN 'view' THEN 'impression' WHEN 'click' THEN 'open' ELSE 'click' END AS step, CAST(user_id AS VARCHAR) AS eid, event_id,
  CASE WHEN event_type = 'purchase' THEN 'P' || (event_id % 4) WHEN event_id % 5 = 0 THEN 'P' || (event_id % 4) END AS partner, CASE WHEN event_type <> 'purchase' AND event_id % 3 = 0 THEN 'S' || (event_id % 7) END AS csource
  FROM events WHERE event_type IN ('view', 'click', 'purchase')),
r AS (SELECT step, coalesce(csource, c_mktsegment, 'Okänd källa') AS source, CASE WHEN c_custkey % 2 = 0 THEN 'even' ELSE 'Okänd typ' END AS event_type, coalesce(partner, 'Okänd partner') AS partner
  FROM log LEFT JOIN customer ON eid = CAST(c_custkey AS VARCHAR)),
g AS (SELECT CASE WHEN grouping(source) = 0 THEN 'source' WHEN grouping(event_type) = 0 THEN 'event_type' WHEN grouping(partner) = 0 THEN 'partner' ELSE 'total' END AS dimension, coalesce(source, event_type, partner, '') AS name,
  count(*) FILTER (step = 'impression') AS impressions, count(*) FILTER (step = 'open') AS opens, count(*) FILTER (step = 'click') AS booking_clicks
  FROM r GROUP BY GROUPING SETS ((source), (event_type), (partner), ()))"""


@query("engagement_funnel", f"""WITH {_LOG} SELECT dimension, name, impressions, opens, booking_clicks, round(opens / nullif(impressions, 0), 9) AS open_rate, round(booking_clicks / nullif(impressions, 0), 9) AS booking_click_rate,
  round(booking_clicks / nullif(opens, 0), 9) AS click_from_open_rate FROM g""")
def engagement_funnel(spark, sf):
    out = funnel.funnel_report(funnel.funnel_log(_engagement(spark, sf), _outbound(spark, sf), _meta(spark, sf)))
    return out.withColumns({c: F.round(c, 9) for c in ("open_rate", "booking_click_rate", "click_from_open_rate")})


@query("company_metrics", """SELECT 'U' || (user_id % 20) AS company, count(*) FILTER (event_type = 'view') AS impressions, count(*) FILTER (event_type = 'click') AS activity_visits,
  count(*) FILTER (event_type = 'purchase') AS booking_clicks, count(*) FILTER (event_type = 'signup') AS sponsored_clicks,
  round(count(*) FILTER (event_type = 'signup') / nullif(count(*) FILTER (event_type = 'view'), 0), 9) AS ctr FROM events GROUP BY user_id % 20""")
def company_metrics(spark, sf):
    kinds = {"view": "sponsored_impression", "click": "activity_open", "purchase": "booking_outbound", "signup": "sponsored_click"}
    action = F.create_map(*[F.lit(x) for kv in kinds.items() for x in kv])[F.col("event_type")]
    log = table(spark, sf, "events").select(F.concat(F.lit("U"), (F.col("user_id") % 20).cast("string")).alias("company"), action.alias("action"))
    return funnel.company_metrics(log).withColumn("ctr", F.round("ctr", 9))


def _clicks(spark, sf):
    o = table(spark, sf, "orders")
    return o.select(F.col("o_orderkey").cast("string").alias("click_id"), F.col("o_orderpriority").alias("partner_key"), F.col("o_orderpriority").alias("partner_name"))


def _conversions(spark, sf):
    status = F.when(F.col("l_returnflag") == "A", "confirmed").when(F.col("l_returnflag") == "R", "refunded").otherwise("pending")
    return table(spark, sf, "lineitem").select(F.col("l_orderkey").cast("string").alias("click_id"), status.alias("status"), F.col("l_extendedprice").alias("commission_value"))


@query("attribution_report", """SELECT o_orderpriority AS partner_key, o_orderpriority AS partner_name, count(DISTINCT o_orderkey) AS clicks, count(l_orderkey) AS conversions,
  count(*) FILTER (l_returnflag = 'A') AS confirmed FROM orders LEFT JOIN lineitem ON o_orderkey = l_orderkey GROUP BY 1, 2""")
def attribution_report(spark, sf):
    return funnel.attribution_report(_clicks(spark, sf), _conversions(spark, sf))


@query("attribution_totals", """SELECT (SELECT count(*) FROM orders) AS clicks, count(*) AS conversions, count(*) FILTER (l_returnflag = 'A') AS confirmed,
  CAST(sum(CAST(l_extendedprice AS DECIMAL(28, 2))) FILTER (l_returnflag = 'A') AS VARCHAR) AS commission FROM lineitem""")
def attribution_totals(spark, sf):
    return funnel.attribution_totals(_clicks(spark, sf), _conversions(spark, sf)).withColumn("commission", F.col("commission").cast("string"))


@query("json_context", "SELECT event_id, json_extract_string(props, '$.k') AS k FROM events")
def json_contexts(spark, sf):
    return table(spark, sf, "events").select("event_id", F.try_element_at(json_context("props"), F.lit("k")).alias("k"))


@query("first_seen", "SELECT user_id, CAST(epoch_us(min(ts)) AS BIGINT) AS first_us, CAST(epoch_us(max(ts)) AS BIGINT) AS last_us FROM events GROUP BY user_id")
def first_seen(spark, sf):
    from playbill.streaming.state import sightings

    seen = sightings(table(spark, sf, "events").select(F.col("user_id").alias("event_id"), F.col("ts").alias("seen_at")))
    return seen.select(F.col("event_id").alias("user_id"), F.unix_micros(F.col("first_seen_at").cast("timestamp")).alias("first_us"), F.unix_micros(F.col("last_seen_at").cast("timestamp")).alias("last_us"))


@query("click_idempotent", """SELECT l_orderkey, l_linenumber, count(*) AS attempts, min(l_extendedprice) AS kept FROM lineitem GROUP BY 1, 2""")
def click_idempotent(spark, sf):
    from playbill.streaming.state import first_per_key

    rows = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_extendedprice")
    return first_per_key(rows, ["l_orderkey", "l_linenumber"], "l_extendedprice").select(
        "l_orderkey", "l_linenumber", "attempts", F.col("l_extendedprice").alias("kept")
    )


@query("impressions_once", "SELECT CAST(user_id AS VARCHAR) AS session, event_type AS listing, count(*) > 0 AS seen FROM events GROUP BY 1, 2")
def impressions_once(spark, sf):
    from playbill.streaming.streams import impressions_once as once

    rows = table(spark, sf, "events").select(F.col("user_id").cast("string").alias("session_id"), F.lit("all").alias("signature"), F.col("event_type").alias("event_id"), F.col("ts").alias("occurred_at"))
    return once(rows, streaming=False).select(F.col("session_id").alias("session"), F.col("event_id").alias("listing"), F.lit(True).alias("seen"))


@query("hourly_funnel", """SELECT CAST(epoch_us(date_trunc('hour', ts)) AS BIGINT) AS hour_us, count(*) FILTER (event_type = 'view') AS impressions, count(*) FILTER (event_type = 'click') AS opens,
  count(*) FILTER (event_type = 'purchase') AS booking_clicks FROM events WHERE event_type IN ('view', 'click', 'purchase') GROUP BY 1""")
def hourly_funnel(spark, sf):
    from playbill.streaming.state import windowed_funnel

    step = F.when(F.col("event_type") == "view", "impression").when(F.col("event_type") == "click", "open").when(F.col("event_type") == "purchase", "click")
    rows = table(spark, sf, "events").select(F.col("ts").cast("timestamp").alias("occurred_at"), step.alias("step")).filter(F.col("step").isNotNull())
    return windowed_funnel(rows).select(F.unix_micros("hour").alias("hour_us"), "impressions", "opens", "booking_clicks")
