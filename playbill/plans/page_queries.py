"""Page extraction queries over the raw page table."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from playbill import vocab
from playbill.functions import booking, pages
from playbill.operators import evidence
from playbill.plans.registry import query
from playbill.plans.td import TODAY, table
from playbill.session import checkpoint_dir
from playbill.sources import importer, ingest, payloads, rules
from playbill.sources import pages as page_jobs


def _pages(spark, sf):
    return table(spark, sf, "pages")


@query("page_facts")
def page_facts(spark, sf):
    out = pages.facts(_pages(spark, sf))
    return out.select("page_id", F.size("lines").alias("lines"), F.size("links").alias("links"), "door_time", "age_limit", "price", "venue", F.col("showtime.start_time").alias("start_time"), F.col("booking.url").alias("booking_url"))


@query("page_links", """SELECT page_id, len(regexp_extract_all(regexp_replace(html, '<(script|style|template|noscript)[^>]*>.*?</\\1>', '', 'gs'), '<a\\s[^>]*href')) AS links FROM pages""".replace("\\1>", "(?:script|style|template|noscript)>"))
def page_links(spark, sf):
    return _pages(spark, sf).select("page_id", F.size(pages.page_links("html")).cast("bigint").alias("links"))


@query("public_urls", r"SELECT page_id, regexp_matches(url, '^(?i)https?://[^/?#]+') AND NOT regexp_matches(lower(url), '^https?://(localhost|[^/?#]*\.local)([/:?#]|$)') AS public FROM pages")
def public_urls(spark, sf):
    return _pages(spark, sf).select("page_id", booking.is_public_http("url").alias("public"))


@query("page_evidence")
def page_evidence(spark, sf):
    fields = ["start_time", "end_time", "door_time", "age_limit", "price", "precise_venue", "booking"]
    return pages.evidence(pages.facts(_pages(spark, sf)), fields).select("page_id", "field", "status", "kind", "value", F.length("snippet").alias("snippet_chars"))


@query("page_replay")
def page_replay(spark, sf):
    """The price and start-time extractors with and without their latest rule, on every page."""
    base = _pages(spark, sf)
    new, old = pages.facts(base), pages.facts(base, start_marker=False, price_labels=("biljettpris", "entrépris", "pris"))
    value = lambda df, field, c: df.select("url", F.col("page_id"), F.lit(field).alias("field"), c.cast("string").alias("value"))
    run = lambda df: value(df, "price", F.col("price")).unionByName(value(df, "start_time", F.col("showtime.start_time")))
    return evidence.impact_audit(evidence.compare_runs(run(old), run(new), ["page_id", "field"]))


@query("page_listings")
def page_listings(spark, sf):
    """Every page read as a list page of one of the rule sources."""
    keys = F.array(*[F.lit(r[0]) for r in rules.RULES])
    # The table's pages carry no calendar dates, so each gets one dated box made from its own id and address.
    day, month = (F.col("page_id") % 28 + 1).cast("string"), F.element_at(F.array(*[F.lit(m) for m in vocab.MONTHS_SV]), (F.col("page_id") % 12 + 1).cast("int"))
    box = F.concat(F.lit("<article><h2>Kväll hos "), booking.bare_host("url"), F.lit("</h2><p>"), day, F.lit(" "), month, F.lit(' kl 19.30, 120 kronor, örebro</p><a href="/events/1">Mer</a></article>'))
    raw = _pages(spark, sf).select(
        "url", F.element_at(keys, (F.pmod("page_id", F.size(keys)) + 1).cast("int")).alias("source_key"), F.concat("html", box).alias("html"), F.lit(None).cast("timestamp").alias("fetched_at"), F.lit("list").alias("page_kind")
    )
    return page_jobs.extract(raw, TODAY).select("id", "title", "start_date", "city", "official_url", "price_status")


_IMPORT_KEYS = ["city_orebro", "elmia", "makeriet"]
_IMPORT_PAGES = 200


def _ticketing_bodies(spark, sf):
    """Orders as the ticketing service would send them: bodies of `_IMPORT_PAGES` events each."""
    k = F.col("o_orderkey")
    event = F.struct(
        k.cast("string").alias("id"), F.concat(F.lit("Order "), k).alias("name"), F.concat(F.lit("https://t.example.com/"), k).alias("url"),
        F.struct(F.struct(F.to_date("o_orderdate").cast("string").alias("localDate")).alias("start")).alias("dates"),
        F.when(F.col("o_orderstatus") != "P", F.array(F.struct(F.when(F.col("o_orderstatus") == "F", 0.0).otherwise(F.col("o_totalprice").cast("double")).alias("min"), F.lit("SEK").alias("currency")))).alias("priceRanges"),
    )
    bodies = table(spark, sf, "orders").groupBy(F.floor(k / _IMPORT_PAGES).cast("int").alias("page")).agg(F.sort_array(F.collect_list(event)).alias("events"))
    return bodies.select("page", F.to_json(F.struct(F.struct("events").alias("_embedded"))).alias("payload"), F.lit(None).cast("timestamp").alias("fetched_at"))


@query("import_pipeline", rf"""WITH o AS (SELECT o_orderkey AS k, CAST(CAST(o_orderdate AS DATE) AS VARCHAR) AS d, o_orderstatus AS s FROM orders),
t AS (SELECT 'ticketmaster' AS source, 'OK' AS status, count(*) AS imported, '' AS comment, count(*) AS listings, count_if(s = 'F') AS free, min(d) AS first_date, max(d) AS last_date FROM o),
h AS (SELECT regexp_replace(rtrim(lower(regexp_extract(url, '^https?://([^/?#:]+)', 1)), '.'), '^www\.', '') AS host, regexp_extract(url, '^(https?://[^/?#]+)', 1) AS base, page_id,
  [{', '.join(f"'{k}'" for k in _IMPORT_KEYS)}][page_id % {len(_IMPORT_KEYS)} + 1] AS source, page_id % 28 + 1 AS day, page_id % 12 + 1 AS month FROM pages),
b AS (SELECT DISTINCT source, host, base, CAST(make_date(CASE WHEN month < 6 THEN 1999 ELSE 1998 END, CAST(month AS BIGINT), CAST(day AS BIGINT)) AS VARCHAR) AS d FROM h),
p AS (SELECT source, count(*) AS n, min(d) AS first_date, max(d) AS last_date FROM b GROUP BY source)
SELECT * FROM t UNION ALL
SELECT source, CASE WHEN source = 'makeriet' THEN 'Fel' ELSE 'OK' END, CASE WHEN source = 'makeriet' THEN 0 ELSE n END,
  CASE WHEN source = 'makeriet' THEN '{vocab.IMPORT_ERROR_TEXTS["connection"]}' ELSE '' END, n, 0, first_date, last_date FROM p""")
def import_pipeline(spark, sf):
    """Two import runs over landed bodies and pages; in the second one a source cannot be reached and keeps what it had."""
    day, month = (F.col("page_id") % 28 + 1).cast("string"), F.element_at(F.array(*[F.lit(m) for m in vocab.MONTHS_SV]), (F.col("page_id") % 12 + 1).cast("int"))
    box = F.concat(F.lit("<article><h2>Kväll hos "), booking.bare_host("url"), F.lit("</h2><p>"), day, F.lit(" "), month, F.lit(' kl 19.30, 120 kronor, örebro</p><a href="/events/1">Mer</a></article>'))
    keys = F.array(*[F.lit(k) for k in _IMPORT_KEYS])
    raw = _pages(spark, sf).select("url", F.element_at(keys, (F.col("page_id") % len(_IMPORT_KEYS) + 1).cast("int")).alias("source_key"), F.concat("html", box).alias("html"), F.lit(None).cast("timestamp").alias("fetched_at"), F.lit("list").alias("page_kind"))

    def pages_of(key, reachable=True):
        def read(spark):
            if not reachable:
                raise ConnectionError(key)
            found = page_jobs.extract(raw.filter(F.col("source_key") == key), TODAY)
            return found.withColumn("ingest_ord", F.col("ingest_ord").bitwiseAND(F.lit((1 << ingest.ROW_BITS) - 1)))

        return importer.Feed(key, key, _IMPORT_KEYS.index(key) + 1, read)

    bodies = _ticketing_bodies(spark, sf)
    tickets = importer.Feed("ticketmaster", "Ticketmaster", 0, lambda spark: payloads.ticketing_listings(bodies))
    root = f"{checkpoint_dir(spark)}/playbill/import-{uuid.uuid4().hex}"
    importer.run_import(spark, root, [tickets, *map(pages_of, _IMPORT_KEYS)])
    status = importer.run_import(spark, root, [pages_of(k, k != _IMPORT_KEYS[-1]) for k in _IMPORT_KEYS])
    source = F.when(F.startswith("id", F.lit("tm-")), "ticketmaster")
    for key in _IMPORT_KEYS:
        prefix = next(r[-1] for r in rules.RULES if r[0] == key)
        source = source.when(F.startswith("id", F.lit(prefix)), key)
    counts = importer.catalogue(spark, root).groupBy(source.alias("source")).agg(F.count("*").alias("listings"), F.count_if(F.col("price_status") == "free").alias("free"), F.min("start_date").alias("first_date"), F.max("start_date").alias("last_date"))
    return status.join(counts, "source").select("source", "status", "imported", "comment", "listings", "free", "first_date", "last_date")


@query("detail_links")
def detail_links(spark, sf):
    raw = _pages(spark, sf).withColumn("source_key", F.lit("orebro_konserthus"))
    return page_jobs.detail_links(raw, "^https?://")


@query("raw_url_hosts", r"SELECT regexp_replace(rtrim(lower(regexp_extract(url, '^https?://([^/?#:]+)', 1)), '.'), '^www\.', '') AS host, count(*) AS pages FROM pages GROUP BY 1")
def raw_url_hosts(spark, sf):
    return _pages(spark, sf).groupBy(booking.bare_host("url").alias("host")).agg(F.count("*").alias("pages"))
