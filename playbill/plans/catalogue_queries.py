"""Catalogue, quality and booking queries with their SQL twins."""

from __future__ import annotations

import datetime as dt
from functools import reduce

from pyspark.sql import functions as F

from playbill import vocab
from playbill.functions import booking, classify, quality, scoring
from playbill.functions.text import clean_names, search_text_py, words
from playbill.operators import booking_reports, catalogue, summaries
from playbill.plans.registry import query
from playbill.plans.td import TODAY, table, with_td, listings
from playbill.session import cut

_UP = "start_d BETWEEN DATE '1998-06-01' AND DATE '1998-07-01' AND NOT is_demo"
_LOCAL = [f"Supplier#{i:09d}" for i in range(0, 40, 3)]
_LOCAL_SQL = ", ".join(f"'{s}'" for s in _LOCAL)
_LISTED = lambda words: "(" + ", ".join(f"'{w}'" for w in words) + ")"
_GEO_CITIES = _LISTED(vocab.CITY_COORDS)
_HAS = f"""
  start_min IS NOT NULL AS h_start, end_min IS NOT NULL AS h_end, start_min IS NOT NULL AND end_min IS NOT NULL AS h_range,
  trim(venue) <> '' AS h_venue,
  lower(trim(venue)) NOT IN {_LISTED(vocab.GENERIC_VENUES)}
    AND (lower(trim(city)) = '' OR lower(trim(venue)) <> lower(trim(city))) AS h_pvenue,
  price_status IN ('known', 'free') AS h_price, age_limit IS NOT NULL AS h_age, door_min IS NOT NULL AS h_door,
  coalesce(booking_url, ticket_url) IS NOT NULL AS h_book"""


@query("coverage_snapshot", with_td(f"""
SELECT count(*) AS listings, count(*) FILTER (source_count > 1) AS multi_source, count(*) FILTER (trim(city) = '') AS missing_city,
  count(*) FILTER (latitude IS NULL AND venue_latitude IS NULL AND city NOT IN {_GEO_CITIES}) AS missing_coordinates,
  count(*) FILTER (official_url IS NULL AND ticket_url IS NULL) AS missing_url,
  count(*) FILTER (data_quality = 'partial') AS partial, count(*) FILTER (data_quality = 'review') AS needs_review, CAST(30 AS INTEGER) AS horizon_days
FROM td WHERE {_UP}"""))
def coverage_snapshot(spark, sf):
    return catalogue.coverage_snapshot(listings(spark, sf), TODAY).drop("duplicate_candidates")


@query("coverage_sources", with_td(f"SELECT s AS source, count(*) AS listings FROM (SELECT unnest(source_names) AS s FROM td WHERE {_UP}) GROUP BY s"))
def coverage_sources(spark, sf):
    return catalogue.coverage_sources(listings(spark, sf), TODAY)


@query("source_value", with_td(f"""
SELECT source, represented, unique_listings, overlap_listings, round(unique_listings * 100.0 / represented, 6)::DOUBLE AS unique_share_percent,
  CASE WHEN represented < 3 THEN 'too_little_data' WHEN unique_listings >= 3 AND unique_listings / represented >= 0.5 THEN 'high_unique_value'
    WHEN represented >= 5 AND unique_listings / represented <= 0.2 THEN 'large_overlap' ELSE 'mixed' END AS signal
FROM (SELECT s AS source, count(*) AS represented, count(*) FILTER (n = 1) AS unique_listings, count(*) FILTER (n > 1) AS overlap_listings
  FROM (SELECT unnest(source_names) AS s, len(source_names) AS n FROM td WHERE {_UP}) GROUP BY s)"""))
def source_value(spark, sf):
    return catalogue.source_value(listings(spark, sf), TODAY).withColumn("unique_share_percent", F.round("unique_share_percent", 6))


@query("source_value_horizons", with_td("""x AS (SELECT unnest(source_names) AS s, len(source_names) AS n, start_d FROM td WHERE NOT is_demo),
h AS (SELECT unnest([7, 30, 90]) AS horizon)
SELECT horizon, s AS source, count(*) AS represented, count(*) FILTER (n = 1) AS unique_listings, count(*) FILTER (n > 1) AS overlap_listings
FROM x, h WHERE start_d BETWEEN DATE '1998-06-01' AND DATE '1998-06-01' + CAST(horizon AS INTEGER) GROUP BY ALL"""))
def source_value_horizons(spark, sf):
    """Three horizons from one table of day summaries."""
    days = cut(summaries.source_days(listings(spark, sf)))
    parts = [summaries.source_value(days, TODAY, h).select(F.lit(h).alias("horizon"), "source", "represented", F.col("unique").alias("unique_listings"), F.col("overlap").alias("overlap_listings")) for h in (7, 30, 90)]
    return reduce(lambda a, b: a.unionByName(b), parts)


@query("source_value_totals", with_td(f"""
SELECT count(*) AS listings, count(*) FILTER (source_count = 1) AS sole_source, count(*) FILTER (source_count > 1) AS multi_source
FROM td WHERE {_UP} AND source_count > 0"""))
def source_value_totals(spark, sf):
    return catalogue.source_value_totals(listings(spark, sf), TODAY)


@query("source_overlap_pairs", with_td(f"""
SELECT a.s AS source_a, b.s AS source_b, count(*) AS shared_listings
FROM (SELECT id, unnest(source_names) AS s FROM td WHERE {_UP}) a JOIN (SELECT id, unnest(source_names) AS s FROM td WHERE {_UP}) b
  ON a.id = b.id AND a.s < b.s GROUP BY a.s, b.s"""))
def source_overlap_pairs(spark, sf):
    return catalogue.source_overlap_pairs(listings(spark, sf), TODAY)


@query("local_audit", with_td(f"""
SELECT source, count(*) AS represented, count(*) FILTER (n = 1) AS unique_listings, count(*) FILTER (n > 1) AS overlap_listings,
  count(DISTINCT event_type) AS category_count, count(DISTINCT event_type) FILTER (n = 1) AS unique_category_count,
  string_agg(DISTINCT event_type, '|' ORDER BY event_type) AS categories,
  count(*) FILTER (booking_url IS NOT NULL OR id::BIGINT % 10 = 1) AS bookable,
  round(count(*) FILTER (n = 1) / count(*), 9) AS unique_share
FROM (SELECT *, unnest(source_names) AS source, len(source_names) AS n FROM td WHERE {_UP}) WHERE source IN ({_LOCAL_SQL}) GROUP BY source"""))
def local_audit(spark, sf):
    out = catalogue.local_audit(listings(spark, sf), TODAY, sources=_LOCAL)
    return out.select(
        "source", "represented", "unique_listings", "overlap_listings", F.col("category_count").cast("bigint").alias("category_count"),
        F.col("unique_category_count").cast("bigint").alias("unique_category_count"), F.array_join("categories", "|").alias("categories"), "bookable",
        F.round("unique_share", 9).alias("unique_share"),
    )


def _frontier_titles(df):
    """Gives the derived listings words that the segments know."""
    words_of = {"ECONOMY": "konsert", "STANDARD": "teater", "PROMO": "marknad", "SMALL": "familj", "MEDIUM": "hockey", "LARGE": "vandring"}
    mapped = F.col("category")
    for k, v in words_of.items():
        mapped = F.regexp_replace(mapped, k, v)
    return df.withColumn("category", mapped)


_SEG_ROWS = ", ".join(f"('{s}', [{', '.join(repr(w) for w in ws)}])" for s, ws in vocab.FRONTIER_SEGMENTS.items())
_SEG_TEXT = """lower(title || ' ' || event_type || ' ' || replace(replace(replace(replace(replace(replace(category, 'ECONOMY', 'konsert'), 'STANDARD', 'teater'),
  'PROMO', 'marknad'), 'SMALL', 'familj'), 'MEDIUM', 'hockey'), 'LARGE', 'vandring') || ' ' || venue || ' ' || array_to_string(tags, ' '))"""


@query("coverage_frontier", with_td(f"""seg(segment, words) AS (VALUES {_SEG_ROWS}),
hit AS (SELECT segment, start_d, source_names FROM (SELECT start_d, source_names, {_SEG_TEXT} AS txt FROM td
    WHERE start_d BETWEEN DATE '1998-06-01' AND DATE '1998-08-30' AND NOT is_demo) JOIN seg ON len(list_filter(words, lambda w: contains(txt, w))) > 0),
cnt AS (SELECT segment, count(*) AS matched, count(*) FILTER (start_d <= DATE '1998-07-01') AS listings_30,
    count(*) FILTER (start_d <= DATE '1998-07-31') AS listings_60, count(*) AS listings_90 FROM hit GROUP BY segment),
src AS (SELECT segment, count(DISTINCT s) AS source_diversity FROM (SELECT segment, unnest(source_names) AS s FROM hit) GROUP BY segment)
SELECT segment, coalesce(matched, 0) AS matched, coalesce(listings_30, 0) AS listings_30, coalesce(listings_60, 0) AS listings_60, coalesce(listings_90, 0) AS listings_90,
  coalesce(source_diversity, 0) AS source_diversity,
  CASE WHEN coalesce(listings_30, 0) >= 4 AND coalesce(source_diversity, 0) >= 2 THEN 'good' WHEN coalesce(matched, 0) > 0 THEN 'thin' ELSE 'missing' END AS status
FROM seg LEFT JOIN cnt USING (segment) LEFT JOIN src USING (segment)"""))
def coverage_frontier(spark, sf):
    out = catalogue.coverage_frontier(_frontier_titles(listings(spark, sf)), TODAY)
    return out.select("segment", "matched", "listings_30", "listings_60", "listings_90", "source_diversity", "status")


_COVERAGE_SQL = f"""rows AS (SELECT unnest(source_names) AS source, len(source_names) AS n, {_HAS} FROM td WHERE {_UP}),
cov AS (SELECT source, count(*) AS represented, count(*) FILTER (n = 1) AS single_source, count(*) FILTER (h_start) AS start_time_listings,
  count(*) FILTER (h_end) AS end_time_listings, count(*) FILTER (h_range) AS time_range_listings, count(*) FILTER (h_venue) AS venue_listings,
  count(*) FILTER (h_pvenue) AS precise_venue_listings, count(*) FILTER (h_price) AS price_listings, count(*) FILTER (h_age) AS age_limit_listings,
  count(*) FILTER (h_door) AS door_time_listings, count(*) FILTER (h_book) AS booking_listings,
  count(*) FILTER (n = 1 AND h_start) AS s_start, count(*) FILTER (n = 1 AND h_pvenue) AS s_pvenue, count(*) FILTER (n = 1 AND h_end) AS s_end,
  count(*) FILTER (n = 1 AND h_book) AS s_book, count(*) FILTER (n = 1 AND h_price) AS s_price, count(*) FILTER (n = 1 AND h_door) AS s_door,
  count(*) FILTER (n = 1 AND h_age) AS s_age
  FROM rows GROUP BY source)"""


@query("detail_coverage", with_td(f"""{_COVERAGE_SQL},
r AS (SELECT *, start_time_listings / represented AS cs, end_time_listings / represented AS ce, precise_venue_listings / represented AS cv, price_listings / represented AS cp,
  age_limit_listings / represented AS ca, door_time_listings / represented AS cd FROM cov),
p AS (SELECT *, CAST(ce >= 0.2 AS INT) + CAST(cp >= 0.2 AS INT) + CAST(ca >= 0.2 AS INT) + CAST(cd >= 0.2 AS INT) AS pr FROM r)
SELECT source, represented, single_source, start_time_listings, end_time_listings, time_range_listings, venue_listings, precise_venue_listings, price_listings,
  age_limit_listings, door_time_listings, booking_listings, round(cs, 9) AS start_time_coverage,
  CASE WHEN represented < 3 THEN 'too_little_data' ELSE coalesce(nullif(concat_ws(',',
    CASE WHEN cs >= 0.8 AND cv >= 0.8 AND pr >= 2 THEN 'strong_practical_data' END, CASE WHEN cs >= 0.6 AND ce < 0.25 THEN 'end_time_often_missing' END,
    CASE WHEN cv < 0.7 THEN 'place_needs_work' END, CASE WHEN cp < 0.2 THEN 'price_often_missing' END, CASE WHEN pr = 0 THEN 'limited_details' END), ''), 'even_base_data') END AS flags
FROM p"""))
def detail_coverage(spark, sf):
    out = catalogue.detail_coverage(listings(spark, sf), TODAY)
    return out.select(
        "source", "represented", "single_source", *[f"{f}_listings" for f in catalogue._COVERED],
        F.round("start_time_coverage", 9).alias("start_time_coverage"), F.array_join("flags", ",").alias("flags"),
    )


@query("detail_summary", with_td(f"""
SELECT count(*) AS listings, round(avg(CAST(h_start AS INT)), 9) AS start_time_coverage, round(avg(CAST(h_end AS INT)), 9) AS end_time_coverage,
  round(avg(CAST(h_pvenue AS INT)), 9) AS precise_venue_coverage, round(avg(CAST(h_price AS INT)), 9) AS price_coverage,
  round(avg(CAST(h_book AS INT)), 9) AS booking_coverage FROM (SELECT {_HAS} FROM td WHERE {_UP})"""))
def detail_summary(spark, sf):
    out = catalogue.detail_summary(listings(spark, sf), TODAY)
    return out.select("listings", *[F.round(f"{c}_coverage", 9).alias(f"{c}_coverage") for c in ("start_time", "end_time", "precise_venue", "price", "booking")])


@query("gap_priorities", with_td(f"""{_COVERAGE_SQL},
f AS (SELECT source, represented, single_source, u.* FROM cov, LATERAL (VALUES ('start_time', start_time_listings, s_start), ('precise_venue', precise_venue_listings, s_pvenue),
  ('end_time', end_time_listings, s_end), ('booking', booking_listings, s_book), ('price', price_listings, s_price), ('door_time', door_time_listings, s_door),
  ('age_limit', age_limit_listings, s_age)) u(field, present, single_present)),
g AS (SELECT *, present / represented AS c, represented - present AS missing, single_source - single_present AS single_missing FROM f)
SELECT * FROM (SELECT source, field, missing, single_missing, round_even(c * 100, 0)::INTEGER AS coverage_pct, CASE WHEN represented < 3 THEN 'too_little_data'
  WHEN single_source >= 3 AND single_missing >= 3 AND c < 0.5 THEN 'high' WHEN missing >= 5 AND c < 0.5 THEN 'high_multi_source'
  WHEN (single_missing >= 2 OR missing >= 3) AND c < 0.75 THEN 'medium' ELSE 'low' END AS priority FROM g) WHERE priority <> 'low'"""))
def gap_priorities(spark, sf):
    out = catalogue.gap_priorities(catalogue.detail_coverage(listings(spark, sf), TODAY))
    return out.select("source", "field", "missing", "single_missing", "coverage_pct", "priority")


@query("gap_cases", with_td(f"""
SELECT id, title, start_date AS date, coalesce(start_time, '') AS start_time, coalesce(official_url, ticket_url, '') AS url,
  CASE WHEN official_url IS NOT NULL THEN 'official_url' WHEN ticket_url IS NOT NULL THEN 'ticket_url' ELSE 'none' END AS url_basis,
  source_count, array_to_string(source_names, ' · ') AS sources, source_count = 1 AS clean_attribution
FROM td WHERE {_UP} AND list_contains(source_names, 'Supplier#000000003') AND end_min IS NULL
ORDER BY source_count > 1, start_date, coalesce(start_time, '99:99'), lower(title), ingest_ord"""))
def gap_cases(spark, sf):
    out = catalogue.gap_cases(listings(spark, sf), "Supplier#000000003", "end_time", TODAY)
    return out.select("id", "title", "date", "start_time", "url", "url_basis", F.col("source_count").cast("bigint").alias("source_count"), "sources", "clean_attribution")


_STATUS_SQL = """st AS (SELECT s_name AS source, CASE s_suppkey % 6 WHEN 0 THEN 'Fel' WHEN 1 THEN 'Delvis' WHEN 2 THEN 'Pilot' WHEN 3 THEN 'Ej konfigurerad' ELSE 'OK' END AS status,
    CASE WHEN s_suppkey % 10 = 4 THEN 0 ELSE s_suppkey END AS imported FROM supplier),
seen AS (SELECT s AS source, count(*) AS n, count(*) FILTER (official_url IS NULL AND ticket_url IS NULL) AS no_url, count(*) FILTER (trim(city) = '') AS no_city
  FROM (SELECT unnest(source_names) AS s, official_url, ticket_url, city FROM td) GROUP BY s),
h0 AS (SELECT source, CAST(imported AS INTEGER) AS imported, n, no_url, no_city, CASE WHEN status = 'Fel' THEN 'error' WHEN status = 'Ej konfigurerad' THEN 'not_configured'
  WHEN imported = 0 THEN 'check' WHEN status = 'Delvis' THEN 'partial' WHEN status = 'Pilot' THEN 'pilot' ELSE 'ok' END AS s0 FROM st LEFT JOIN seen USING (source)),
health AS (SELECT source, imported, CASE WHEN s0 IN ('ok', 'pilot') AND coalesce(n, 0) >= 3 AND (no_url / n >= 0.8 OR no_city / n >= 0.8) THEN 'check' ELSE s0 END AS state FROM h0)"""


def _health(spark, sf):
    k = F.col("s_suppkey")
    status = F.when(k % 6 == 0, "Fel").when(k % 6 == 1, "Delvis").when(k % 6 == 2, "Pilot").when(k % 6 == 3, "Ej konfigurerad").otherwise("OK")
    rows = table(spark, sf, "supplier").select(
        F.col("s_name").alias("source"), status.alias("status"), F.when(k % 10 == 4, 0).otherwise(k).cast("int").alias("imported"), F.lit("").alias("comment")
    )
    return catalogue.source_health(rows, listings(spark, sf))


@query("source_health", with_td(f"{_STATUS_SQL} SELECT source, imported, state FROM health"))
def source_health(spark, sf):
    return _health(spark, sf).select("source", "imported", "state")


@query("health_states", with_td(f"{_STATUS_SQL} SELECT state, count(*) AS sources FROM health GROUP BY state"))
def health_states(spark, sf):
    return catalogue.health_states(_health(spark, sf))


@query("health_summary", with_td(f"""{_STATUS_SQL}, c AS (SELECT *, state IN ('error', 'check') AS bad, source IN ({_LOCAL_SQL}) AS core FROM health)
SELECT count(*) FILTER (bad) AS degraded, count(*) FILTER (core AND bad) AS degraded_core, count(*) FILTER (core) AS core,
  count(*) FILTER (core AND NOT bad AND imported > 0) AS healthy_core, count(*) FILTER (core) > 0 AND count(*) FILTER (core AND NOT bad AND imported > 0) < 2 AS has_public_warning FROM c"""))
def health_summary(spark, sf):
    return catalogue.health_summary(_health(spark, sf), core=_LOCAL)


_GATE_SQL = """g AS (SELECT id, title, start_date, concat_ws(',', CASE WHEN trim(title) = '' THEN 'title_missing' END, CASE WHEN trim(venue) = '' AND trim(city) = '' THEN 'place_missing' END) AS r,
  concat_ws(',', CASE WHEN price_status = 'known' AND price_min IS NULL THEN 'known_price_missing' END, CASE WHEN price_status = 'free' AND price_min <> 0 THEN 'free_but_priced' END) AS v FROM td)"""


@query("quality_gate", with_td(f"{_GATE_SQL} SELECT CASE WHEN r <> '' THEN 'restricted' WHEN v <> '' THEN 'review' ELSE 'pass' END AS level, count(*) AS listings FROM g GROUP BY 1"))
def quality_gate(spark, sf):
    return catalogue.quality_counts(listings(spark, sf))


@query("quality_rows", with_td(f"""{_GATE_SQL} SELECT id, title, start_date, CASE WHEN r <> '' THEN 'restricted' ELSE 'review' END AS level,
  CASE WHEN r <> '' AND v <> '' THEN r || ',' || v ELSE r || v END AS reasons FROM g WHERE r <> '' OR v <> ''"""))
def quality_rows(spark, sf):
    return catalogue.quality_rows(listings(spark, sf)).select("id", "title", "start_date", "level", F.array_join("reasons", ",").alias("reasons"))


def _documents_as_listings(spark, sf):
    """Documents as rows whose title is the whole text."""
    return table(spark, sf, "documents").select(
        F.col("doc_id").cast("string").alias("id"), F.col("doc_id").alias("ingest_ord"), F.col("text").alias("title"), F.lit("").alias("description"), F.array("source").alias("source_names"), F.lit("1998-06-01").alias("start_date"),
        F.array().cast("array<struct<source:string,external_id:string,source_url:string,fetched_at:string,raw_title:string,confidence:double,payload:map<string,string>>>").alias("source_records"),
    )


@query("noise_by_source", with_td("""n AS (SELECT source_names, trim(regexp_replace(lower(title), '[^a-z0-9]+', ' ', 'g')) AS t FROM td),
s AS (SELECT CASE WHEN t = '' OR t IN ('event', 'program', 'kalender') THEN 'high' WHEN length(t) <= 3 THEN 'review' ELSE 'none' END AS sev, CASE WHEN len(source_names) = 0 THEN ['Okänd källa'] ELSE source_names END AS names FROM n)
SELECT source, count(*) FILTER (sev = 'high') AS high_noise, count(*) FILTER (sev = 'review') AS review FROM (SELECT sev, unnest(names) AS source FROM s WHERE sev <> 'none') GROUP BY source"""))
def noise_by_source(spark, sf):
    return catalogue.noise_by_source(listings(spark, sf))


_BUTTONS = ", ".join(f"'{t}'" for t in sorted({search_text_py(t) for t in vocab.NOISE_TITLES}))


@query("noise_documents", f"""WITH d AS (SELECT doc_id, trim(coalesce(text, '')) AS title FROM documents),
n AS (SELECT *, trim(regexp_replace(lower(strip_accents(title)), '[^a-z0-9]+', ' ', 'g')) AS t FROM d)
SELECT CAST(doc_id AS VARCHAR) AS id, CASE WHEN t IN ('', {_BUTTONS}) OR regexp_matches(t, '^(http|https|www) ') THEN 'high' WHEN length(t) <= 3 THEN 'review' ELSE 'none' END AS severity FROM n""")
def noise_documents(spark, sf):
    return _documents_as_listings(spark, sf).select("id", quality.noise_severity().alias("severity"))


@query("title_and_metadata_issues", with_td("""n AS (SELECT *, trim(regexp_replace(lower(title), '[^a-z0-9]+', ' ', 'g')) AS t FROM td)
SELECT id, CASE WHEN t = '' THEN 'title_missing' WHEN length(t) < 4 THEN 'very_short' END AS title_issue,
  concat_ws(',', CASE WHEN venue = '' AND city = '' THEN 'place_missing' END, CASE WHEN venue = '' AND city <> '' THEN 'venue_missing' END,
    CASE WHEN start_min IS NULL AND venue = '' THEN 'time_and_venue_missing' END, CASE WHEN official_url IS NULL AND ticket_url IS NULL THEN 'no_link' END) AS issues FROM n"""))
def title_and_metadata_issues(spark, sf):
    return listings(spark, sf).select("id", quality.title_issue().alias("title_issue"), F.array_join(quality.metadata_issues(), ",").alias("issues"))


@query("precise_venue", with_td(f"SELECT venue, city, h_pvenue AS precise, count(*) AS n FROM (SELECT venue, city, {_HAS} FROM td) GROUP BY ALL"))
def precise_venue(spark, sf):
    return listings(spark, sf).groupBy("venue", "city", quality.has_precise_venue().alias("precise")).agg(F.count("*").alias("n"))


_CTA_SQL = """c AS (SELECT id, source_names, booking_url, ticket_url, official_url, coalesce(booking_url, ticket_url, official_url) AS url,
  CASE WHEN booking_url IS NOT NULL THEN 'booking' WHEN ticket_url LIKE '%ticketmaster%' OR ticket_url LIKE '%tickster%' AND ticket_url LIKE '%ticket%' THEN 'ticket'
    WHEN ticket_url LIKE '%kalender%' THEN 'schedule' ELSE 'info' END AS kind FROM td),
q AS (SELECT *, CASE WHEN url IS NULL THEN 'missing' WHEN kind = 'info' AND regexp_matches(url, '^https?://[^/]+/?$') THEN 'weak' WHEN kind IN ('booking', 'ticket') THEN 'bookable' ELSE 'useful' END AS status FROM c)"""


@query("cta_quality", with_td(f"{_CTA_SQL} SELECT id, url, CASE WHEN url IS NOT NULL THEN kind END AS kind, status FROM q"))
def cta_quality(spark, sf):
    df = booking.with_cta(listings(spark, sf))
    return df.select("id", F.col("cta.url").alias("url"), F.col("cta.kind").alias("kind"), F.col("cta_quality").alias("status"))


_PARTNER_SQL = """p AS (SELECT *, CASE WHEN l IS NULL THEN NULL ELSE regexp_extract(l, '^https?://(?:www\\.)?([^/]+)', 1) END AS h FROM (SELECT *, coalesce(booking_url, ticket_url) AS l FROM q)),
a AS (SELECT *, CASE WHEN h = 'ticketmaster.se' THEN 'Ticketmaster' WHEN h = 'secure.tickster.com' THEN 'Tickster' WHEN h = 'billetto.se' THEN 'Billetto' ELSE h END AS partner,
  CASE WHEN h = 'ticketmaster.se' THEN 'ticketmaster' WHEN h = 'secure.tickster.com' THEN 'tickster' WHEN h = 'billetto.se' THEN 'billetto' ELSE 'direct' END AS partner_key FROM p)"""


@query("partner_report", with_td(f"{_CTA_SQL}, {_PARTNER_SQL} SELECT partner_key, partner, 'unassessed' AS affiliate_status, partner_key = 'direct' AS direct, count(*) AS bookable_listings FROM a WHERE l IS NOT NULL GROUP BY ALL"))
def partner_report(spark, sf):
    return booking_reports.partner_report(listings(spark, sf))


@query("booking_coverage", with_td(f"""{_CTA_SQL}, {_PARTNER_SQL}, x AS (SELECT unnest(CASE WHEN len(source_names) = 0 THEN ['Okänd källa'] ELSE source_names END) AS source, status, partner FROM a)
, m AS (SELECT source, string_agg(partner || ':' || n, ',' ORDER BY n DESC, partner) AS partners FROM (SELECT source, partner, count(*) AS n FROM x WHERE status = 'bookable' AND partner IS NOT NULL GROUP BY ALL) GROUP BY source)
SELECT source, count(*) AS total, count(*) FILTER (status = 'bookable') AS bookable, count(*) FILTER (status = 'useful') AS useful, count(*) FILTER (status = 'weak') AS weak,
  count(*) FILTER (status = 'missing') AS missing, round(count(*) FILTER (status = 'bookable') / count(*), 9) AS booking_coverage, any_value(coalesce(partners, '')) AS partners
FROM x LEFT JOIN m USING (source) GROUP BY source"""))
def booking_coverage(spark, sf):
    out = booking_reports.booking_coverage(listings(spark, sf))
    text = F.array_join(F.transform("partners", lambda p: F.concat_ws(":", p["name"], p["bookable"].cast("string"))), ",")
    return out.select("source", "total", "bookable", "useful", "weak", "missing", F.round("booking_coverage", 9).alias("booking_coverage"), text.alias("partners"))


@query("booking_totals", with_td(f"""{_CTA_SQL}, x AS (SELECT unnest(CASE WHEN len(source_names) = 0 THEN ['Okänd källa'] ELSE source_names END) AS source, status FROM q)
SELECT count(*) AS total, count(*) FILTER (status = 'bookable') AS bookable, round(count(*) FILTER (status = 'bookable') / count(*), 9) AS booking_coverage FROM x"""))
def booking_totals(spark, sf):
    return booking_reports.booking_totals(booking_reports.booking_coverage(listings(spark, sf))).select(
        "total", "bookable", F.round("booking_coverage", 9).alias("booking_coverage")
    )


@query("partner_attribution", r"""WITH p AS (SELECT page_id, regexp_replace(rtrim(lower(regexp_extract(url, '^https?://([^/?#:]+)', 1)), '.'), '^www\.', '') AS host FROM pages)
SELECT page_id, host, CASE WHEN host = '' THEN 'unknown' WHEN regexp_matches(host, '(^|\.)ticketmaster\.(se|com)$') THEN 'ticketmaster' WHEN regexp_matches(host, '(^|\.)tickster\.com$') THEN 'tickster'
  ELSE 'direct' END AS partner_key FROM p""")
def partner_attribution(spark, sf):
    a = booking.attribution(F.col("url"))
    return table(spark, sf, "pages").select("page_id", a["domain"].alias("host"), a["key"].alias("partner_key"))


@query("url_classes", r"""WITH p AS (SELECT page_id, lower(url) AS u, lower(regexp_extract(url, '^https?://[^/?#]+([^?#]*)', 1)) AS path FROM pages),
k AS (SELECT *, CASE WHEN regexp_matches(u, 'book|boka|reserve|reservation|checkout') THEN 'booking' WHEN regexp_matches(u, 'ticket|biljett|eventim') THEN 'ticket'
  WHEN regexp_matches(u, 'time|tider|schedule|calendar|kalender') THEN 'schedule' ELSE 'info' END AS kind FROM p)
SELECT page_id, kind, CASE WHEN kind IN ('booking', 'ticket') THEN 'high' WHEN kind = 'schedule' THEN 'medium' WHEN path IN ('', '/', '/sv', '/sv/', '/en', '/en/') THEN 'low'
  WHEN length(path) - length(replace(path, '/', '')) >= 2 THEN 'medium' ELSE 'low' END AS confidence, path IN ('', '/', '/sv', '/sv/', '/en', '/en/') AS generic FROM k""")
def url_classes(spark, sf):
    return table(spark, sf, "pages").select(
        "page_id", booking.url_kind("url").alias("kind"), booking.url_confidence("url").alias("confidence"), booking.is_generic_landing("url").alias("generic")
    )


_NO_WORD = r"[^\p{L}\p{N}_]"


def _tag_sql(tag: str, patterns: list[str]) -> str:
    """The tag where one of its rules matches; word borders are spelled out, since DuckDB's know ASCII only."""
    bare = [p.removeprefix(r"\b") for p in patterns]
    ends = "|".join(f"{p.removesuffix(chr(92) + 'b')}($|{_NO_WORD})" if p.endswith(r"\b") else p for p in bare)
    return f"CASE WHEN regexp_matches(t, '(^|{_NO_WORD})({ends})') THEN '{tag}' END"


_EVERY_TAG = vocab.TAG_RULES | vocab.SPORT_TAG_RULES | {"Sport": [*vocab.TAG_RULES["Sport"], *(p for ps in vocab.SPORT_TAG_RULES.values() for p in ps)]}


# A wording of every family, and of rules that are more than one word, put behind a document's text by its id.
_WORDINGS = [next(p for p in ps if p.strip("\\b").isalpha()).replace("\\b", "") for ps in _EVERY_TAG.values()] + [
    "stand-up", "trading cards", "hållbarhet", "klossfestivalen", "leksaksmässa", "pokémon", "yu-gi-oh", "90-tal", "he man", "skridskoåkning", "e-sport", "table tennis", "ingen regel", "showen",
]


@query("classify_tags", f"""SELECT tag, count(*) AS documents FROM (
  SELECT unnest(list_filter([{', '.join(_tag_sql(*rule) for rule in _EVERY_TAG.items())}], lambda x: x IS NOT NULL)) AS tag
  FROM (SELECT lower(text || ' ' || [{', '.join(f"'{w}'" for w in _WORDINGS)}][doc_id % {len(_WORDINGS)} + 1]) AS t FROM documents)) GROUP BY tag""")
def classify_tags(spark, sf):
    wording = F.element_at(F.array(*[F.lit(w) for w in _WORDINGS]), (F.col("doc_id") % len(_WORDINGS) + 1).cast("int"))
    tags = classify.tags_of(classify.taxonomy_text(F.lit(""), F.concat_ws(" ", "text", wording)))
    return table(spark, sf, "documents").select(F.explode(tags).alias("tag")).groupBy("tag").agg(F.count("*").alias("documents"))


_TILE_NAMES = ["Vinprovning i källaren", "Dansband på Ritz", "Late night jam", "Dockteater", "Rockbar live", "Konsert i parken", "DJ Anna", "Helt annat", "Jazzkväll"]


@query("ticket_tiles", with_td(f"""x AS (SELECT id, [{', '.join(f"'{t}'" for t in _TILE_NAMES)}][CAST(id AS BIGINT) % {len(_TILE_NAMES)} + 1] AS title, lower([{', '.join(f"'{t}'" for t in _TILE_NAMES)}][CAST(id AS BIGINT) % {len(_TILE_NAMES)} + 1] || ' ' || venue) AS t FROM td)
SELECT id, CASE WHEN regexp_matches(t, '\\bkonsert\\b') THEN 'Konsert' WHEN contains(t, 'vinprovning') THEN 'Mat & dryck' WHEN contains(t, 'ritz') OR contains(t, 'dj ') OR contains(t, 'dansband') THEN 'Nattliv'
  WHEN contains(t, 'rockbar') OR contains(t, 'jazz') OR contains(t, 'konsert') OR contains(t, 'live') OR contains(t, ' late night jam') OR contains(t, 'jam ') THEN 'Konsert' WHEN contains(t, 'dockteater') THEN 'Teater' ELSE 'Evenemang' END AS tile_type,
  CASE WHEN regexp_matches(t, '\\bkonsert\\b') THEN 'Lokalt' WHEN contains(t, 'vinprovning') THEN 'Mat & dryck' WHEN contains(t, 'ritz') OR contains(t, 'dj ') OR contains(t, 'dansband') THEN 'Nattliv'
  WHEN contains(t, 'rockbar') OR contains(t, 'jazz') OR contains(t, 'konsert') OR contains(t, 'live') OR contains(t, ' late night jam') OR contains(t, 'jam ') THEN 'Musik' WHEN contains(t, 'dockteater') THEN 'Teater' ELSE 'Lokalt' END AS tile_category FROM x"""))
def ticket_tiles(spark, sf):
    name = F.element_at(F.array(*[F.lit(t) for t in _TILE_NAMES]), (F.col("ingest_ord") % len(_TILE_NAMES) + 1).cast("int"))
    return classify.classify_tile(listings(spark, sf).withColumn("title", name)).select("id", "tile_type", "tile_category")


_SPORT_WORDS = "CASE k7 WHEN 0 THEN 'fotboll derby' WHEN 1 THEN 'badminton open' WHEN 2 THEN 'konsert' WHEN 3 THEN 'golf och hockey' ELSE title END"


@query("sport_scope", with_td(f"""x AS (SELECT *, CAST(id AS BIGINT) % 7 AS k7 FROM td), y AS (SELECT id, lower({_SPORT_WORDS}) AS t, CASE WHEN k7 = 4 THEN 'Sport' ELSE event_type END AS et FROM x),
z AS (SELECT id, et = 'Sport' AS declared, regexp_matches(t, '\\b(badminton|golf)') AS ind, regexp_matches(t, '\\b(fotboll|hockey)\\b') AS team FROM y)
SELECT id, CASE WHEN NOT (declared OR ind OR team) THEN true WHEN ind THEN false WHEN team THEN true ELSE false END AS allowed FROM z"""))
def sport_scope(spark, sf):
    k7 = F.col("ingest_ord") % 7
    title = F.when(k7 == 0, "fotboll derby").when(k7 == 1, "badminton open").when(k7 == 2, "konsert").when(k7 == 3, "golf och hockey").otherwise(F.col("title"))
    df = listings(spark, sf).withColumns({"title": title, "event_type": F.when(k7 == 4, "Sport").otherwise(F.col("event_type"))})
    return df.select("id", classify.sport_allowed().alias("allowed"))


@query("themes", with_td("""SELECT CASE WHEN c LIKE '%rock%' OR c LIKE '%pop%' THEN 'music' WHEN c LIKE '%mat%' THEN 'food' WHEN c LIKE '%promo%' THEN 'other' ELSE 'other' END AS theme, count(*) AS n
FROM (SELECT lower(event_type || ' ' || category || ' ' || array_to_string(tags, ' ')) AS c FROM td) GROUP BY 1"""))
def themes(spark, sf):
    return listings(spark, sf).select(classify.theme()["theme"].alias("theme")).groupBy("theme").agg(F.count("*").alias("n"))


@query("source_trust", """SELECT s_name AS source, CAST(CASE WHEN s_suppkey % 4 = 0 THEN 3 WHEN s_suppkey % 4 = 1 THEN 2 ELSE 1 END AS INTEGER) AS trust FROM supplier""")
def source_trust(spark, sf):
    k = F.col("s_suppkey") % 4
    name = F.when(k == 0, "Örebro  Konserthus (official)").when(k == 1, "kortcentralen").otherwise(F.col("s_name"))
    return table(spark, sf, "supplier").select(F.col("s_name").alias("source"), scoring.source_trust(name).alias("trust"))


@query("verification", with_td("SELECT CASE WHEN source_count >= 2 THEN 'confirmed_by_' || source_count WHEN data_quality = 'review' THEN 'needs_review' ELSE 'check_source' END AS label, count(*) AS n FROM td GROUP BY 1"))
def verification(spark, sf):
    return listings(spark, sf).groupBy(scoring.verification_label().alias("label")).agg(F.count("*").alias("n"))


@query("array_sets", with_td("""SELECT id, list_sort(list_distinct(list_concat(source_names, tags))) = list_sort(list_distinct(list_concat(tags, source_names))) AS same,
  len(list_intersect(source_names, list_filter(source_names, lambda x: x < 'Supplier#000000050'))) AS low_names FROM td"""))
def array_sets(spark, sf):
    low = F.filter("source_names", lambda x: x < "Supplier#000000050")
    both = lambda a, b: F.array_sort(F.array_union(a, b))
    return listings(spark, sf).select(
        "id", (both("source_names", "tags") == both("tags", "source_names")).alias("same"), F.size(F.array_intersect(clean_names("source_names"), low)).cast("bigint").alias("low_names")
    )


_PARTS = ", ".join(f"CAST(coalesce(sum(CAST('0x' || substr(h, {1 + 10 * i}, 10) AS UBIGINT)), 0) AS VARCHAR)" for i in range(4))


@query("id_signature", f"""SELECT sha1(concat_ws('-', {_PARTS})) AS signature, count(*) AS ids
FROM (SELECT sha1(CAST(o_orderkey AS VARCHAR)) AS h FROM orders GROUP BY o_orderkey)""")
def id_signature(spark, sf):
    from playbill.operators.signature import id_signature as sign

    return sign(table(spark, sf, "orders").select(F.col("o_orderkey").cast("string").alias("id")))


@query("title_jaccard", """WITH t AS (SELECT DISTINCT p_name, list_distinct(string_split(p_name, ' ')) AS w FROM part)
SELECT a.p_name AS left_title, b.p_name AS right_title, round(len(list_intersect(a.w, b.w)) / len(list_distinct(list_concat(a.w, b.w))), 9) AS overlap
FROM t a JOIN t b ON a.p_name < b.p_name AND len(list_intersect(a.w, b.w)) > 0""")
def title_jaccard(spark, sf):
    from playbill.operators.similar_titles import jaccard_pairs

    return jaccard_pairs(table(spark, sf, "part").select(F.col("p_name").alias("title")).distinct()).withColumn("overlap", F.round("overlap", 9))
