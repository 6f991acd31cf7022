"""A listings view over the driver's tables: one listing per order.

The same definition is written twice, as a DataFrame plan and as the SQL text
the oracle runs, so that each checks the other.  Every order is a listing; one
without line items has no title and no sources.
"""

from __future__ import annotations

import datetime as dt
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from playbill import vocab
from playbill.schema import as_listings, listing_type
from playbill.session import checkpoint_dir

TODAY = dt.date(1998, 6, 1)
NOW = dt.datetime(1998, 6, 1, 16, 30)
CITIES = list(vocab.CITY_COORDS)
TASK_LINES = 250_000  # line items whose orders are put together in one task


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def td(spark: SparkSession, sf_dir: str, items: bool = True) -> DataFrame:
    """Listings from orders; `items=False` leaves out everything that needs line items."""
    orders, customer, nation = (table(spark, sf_dir, t) for t in ("orders", "customer", "nation"))
    base = orders.join(customer, orders.o_custkey == customer.c_custkey).join(nation, customer.c_nationkey == nation.n_nationkey)
    if items:
        line, part, supplier = (table(spark, sf_dir, t) for t in ("lineitem", "part", "supplier"))
        # Suppliers come first, while a line is three numbers.  The rows of an order then meet in tasks of bounded size
        # and are aggregated there: after the join by part an aggregate before the shuffle would only sort them.
        named = (
            line.select("l_orderkey", "l_partkey", "l_suppkey")
            .join(supplier.select("s_suppkey", "s_name"), F.col("l_suppkey") == F.col("s_suppkey")).select("l_orderkey", "l_partkey", "s_name")
            .join(part.select("p_partkey", "p_name", "p_type", "p_brand"), F.col("l_partkey") == F.col("p_partkey")).drop("l_partkey", "p_partkey")
        )
        content = (
            named.repartition(line.count() // TASK_LINES + 1, "l_orderkey")
            .groupBy("l_orderkey")
            .agg(
                F.min("p_name").alias("p_name"), F.min("p_type").alias("p_type"), F.max("p_type").alias("p_type_2"),
                F.min("p_brand").alias("p_brand"), F.array_sort(F.collect_set("s_name")).alias("s_names"),
            )
        )
        base = base.join(content, F.col("o_orderkey") == F.col("l_orderkey"), "left")
    else:
        none = F.lit(None).cast("string")
        base = base.withColumns(
            {"p_name": none, "p_type": none, "p_type_2": none, "p_brand": none, "s_names": F.lit(None).cast("array<string>")}
        )
    k, n = F.col("o_orderkey"), F.col("n_nationkey")
    start = F.to_date("o_orderdate")
    minute = (k * 37) % 1440
    clock = lambda m: F.format_string("%02d:%02d", F.floor(m / 60).cast("int"), (m % 60).cast("int"))
    city = F.when(n < 20, F.element_at(F.array(*[F.lit(c) for c in CITIES]), F.least(n + 1, F.lit(20)))).otherwise(F.col("n_name"))
    names = F.coalesce("s_names", F.array().cast("array<string>"))
    key = k.cast("string")
    return as_listings(
        base.select(
            key.alias("id"),
            k.alias("ingest_ord"),
            F.coalesce("p_name", F.lit("")).alias("title"),
            F.col("o_orderpriority").alias("event_type"),
            F.coalesce("p_type", F.lit("")).alias("category"),
            start.cast("string").alias("start_date"),
            F.when(k % 5 != 0, F.date_add(start, (k % 5).cast("int")).cast("string")).alias("end_date"),
            F.when(k % 4 != 0, clock(minute)).alias("start_time"),
            F.when((k % 4 != 0) & (k % 6 == 1), clock((minute + 150) % 1440)).alias("end_time"),
            F.when(k % 8 == 3, clock((minute + 1410) % 1440)).alias("door_time"),
            F.when(k % 16 == 5, F.lit("18 år")).alias("age_limit"),
            F.when(k % 3 == 0, city).when(k % 31 == 1, F.lit("")).otherwise(F.col("c_name")).alias("venue"),
            F.when(k % 37 == 1, F.lit("")).otherwise(city).alias("city"),
            F.when(n % 5 == 1, 55.0 + n * 0.5).alias("latitude"),
            F.when(n % 5 == 1, 11.0 + n * 0.3).alias("longitude"),
            F.when(n % 5 == 2, 56.0 + n * 0.25).alias("venue_latitude"),
            F.when(n % 5 == 2, 12.0 + n * 0.2).alias("venue_longitude"),
            F.when(k % 7 != 0, F.when(k % 4 == 0, F.lit("https://www.example.com/")).otherwise(F.concat(F.lit("https://www.example.com/events/"), key))).alias("official_url"),
            F.when(k % 10 == 1, F.concat(F.lit("https://www.ticketmaster.se/event/"), key))
            .when(k % 10 == 3, F.concat(F.lit("https://secure.tickster.com/"), key))
            .when(k % 10 == 5, F.lit("https://shop.example.com/"))
            .when(k % 10 == 7, F.concat(F.lit("https://example.org/kalender/"), key)).alias("ticket_url"),
            F.when(k % 13 == 0, F.concat(F.lit("https://billetto.se/e/"), key)).alias("booking_url"),
            names.alias("source_names"),
            F.size(names).alias("source_count"),
            F.coalesce("p_brand", F.lit("")).alias("description"),
            F.array_compact(F.array(F.col("p_type_2"), F.col("c_mktsegment"))).alias("tags"),
            F.when(k % 5 == 2, F.array(start.cast("string"))).otherwise(F.array().cast("array<string>")).alias("excluded_dates"),
            (k % 50 == 0).alias("is_demo"),
            F.when(F.size(names) > 1, "multi_source").when(k % 9 == 0, "review").otherwise("partial").alias("data_quality"),
            F.when(F.col("o_orderstatus") != "P", F.floor(F.col("o_totalprice") / 500).cast("double")).alias("price_min"),
            F.when(k % 11 == 0, "EUR").otherwise("SEK").alias("currency"),
            F.when(F.col("o_orderstatus") == "F", "free").when(F.col("o_orderstatus") == "O", "known").otherwise("unknown").alias("price_status"),
            (k % 17 == 0).alias("is_sponsored"),
            F.when(k % 17 == 0, F.concat(F.lit("camp-"), (k % 5).cast("string"))).alias("sponsor_campaign_id"),
            F.when(k % 34 == 0, F.col("c_name")).alias("sponsor_company"),
            (k % 4).cast("int").alias("sponsor_priority"),
        )
    )


_WRITTEN: dict[tuple, str] = {}
SPANS = (7, 60)  # days: within a file, listings that run longer lie apart


def _state(spark: SparkSession, sf_dir: str) -> tuple:
    """What the tables' files are now, so that changed input is stored anew."""
    return tuple(f for name in ("orders", "lineitem", "customer") for f in sorted(table(spark, sf_dir, name).inputFiles()))


def layout(rows: DataFrame) -> DataFrame:
    """Adds the last day and brings every task's rows into the order of the stored table."""
    last = F.greatest("start_date", F.coalesce("end_date", "start_date"))
    days = F.datediff(F.try_to_date(last, "yyyy-MM-dd"), F.try_to_date("start_date", "yyyy-MM-dd"))
    span = F.when(days <= SPANS[0], 0).when(days <= SPANS[1], 1).otherwise(2)
    return rows.withColumns({"last_date": last, "_span": span}).sortWithinPartitions("_span", "start_date").drop("_span")


def listings(spark: SparkSession, sf_dir: str, with_last: bool = False) -> DataFrame:
    """The stored form of `td`, written once per application as the import pipeline does.

    Every file is in the order of start dates, short listings apart from long ones, and holds the last day too:
    a period prunes pages of a file from both sides, by what starts after it and by what is over before it.
    No row is shuffled for that order.
    Queries read only the columns they name; `last_date` comes on request.
    """
    key = (spark.sparkContext.applicationId, sf_dir, _state(spark, sf_dir))
    if key not in _WRITTEN:
        path = f"{checkpoint_dir(spark)}/playbill/listings-{uuid.uuid4().hex}"
        layout(td(spark, sf_dir)).write.parquet(path)
        _WRITTEN[key] = path
    found = spark.read.schema(listing_type().add("last_date", "string")).parquet(_WRITTEN[key])
    return found if with_last else found.drop("last_date")


_CITY_LIST = ", ".join(f"'{c}'" for c in CITIES)

TD_SQL = f"""
content AS (
  SELECT l_orderkey, min(p_name) AS p_name, min(p_type) AS p_type, max(p_type) AS p_type_2, min(p_brand) AS p_brand,
         list_sort(list(DISTINCT s_name)) AS s_names
  FROM lineitem JOIN part ON l_partkey = p_partkey JOIN supplier ON l_suppkey = s_suppkey
  GROUP BY l_orderkey),
base AS (
  SELECT *, o_orderkey AS k, CAST(o_orderdate AS DATE) AS sd, (o_orderkey * 37) % 1440 AS m,
         CASE WHEN n_nationkey < 20 THEN ([{_CITY_LIST}])[least(n_nationkey + 1, 20)] ELSE n_name END AS place
  FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey
  LEFT JOIN content ON o_orderkey = l_orderkey),
td AS (
  SELECT CAST(k AS VARCHAR) AS id, k AS ingest_ord, coalesce(p_name, '') AS title, o_orderpriority AS event_type,
    coalesce(p_type, '') AS category, sd AS start_d, CAST(sd AS VARCHAR) AS start_date,
    CASE WHEN k % 5 <> 0 THEN sd + CAST(k % 5 AS INTEGER) END AS end_d,
    CASE WHEN k % 4 <> 0 THEN m END AS start_min,
    CASE WHEN k % 4 <> 0 THEN printf('%02d:%02d', m // 60, m % 60) END AS start_time,
    CASE WHEN k % 4 <> 0 AND k % 6 = 1 THEN (m + 150) % 1440 END AS end_min,
    CASE WHEN k % 8 = 3 THEN (m + 1410) % 1440 END AS door_min,
    CASE WHEN k % 16 = 5 THEN '18 år' END AS age_limit,
    CASE WHEN k % 3 = 0 THEN place WHEN k % 31 = 1 THEN '' ELSE c_name END AS venue,
    CASE WHEN k % 37 = 1 THEN '' ELSE place END AS city,
    CASE WHEN n_nationkey % 5 = 1 THEN 55.0::DOUBLE + n_nationkey * 0.5::DOUBLE END AS latitude,
    CASE WHEN n_nationkey % 5 = 1 THEN 11.0::DOUBLE + n_nationkey * 0.3::DOUBLE END AS longitude,
    CASE WHEN n_nationkey % 5 = 2 THEN 56.0::DOUBLE + n_nationkey * 0.25::DOUBLE END AS venue_latitude,
    CASE WHEN n_nationkey % 5 = 2 THEN 12.0::DOUBLE + n_nationkey * 0.2::DOUBLE END AS venue_longitude,
    CASE WHEN k % 7 <> 0 THEN CASE WHEN k % 4 = 0 THEN 'https://www.example.com/' ELSE 'https://www.example.com/events/' || k END END AS official_url,
    CASE k % 10 WHEN 1 THEN 'https://www.ticketmaster.se/event/' || k WHEN 3 THEN 'https://secure.tickster.com/' || k
      WHEN 5 THEN 'https://shop.example.com/' WHEN 7 THEN 'https://example.org/kalender/' || k END AS ticket_url,
    CASE WHEN k % 13 = 0 THEN 'https://billetto.se/e/' || k END AS booking_url,
    coalesce(s_names, CAST([] AS VARCHAR[])) AS source_names, coalesce(len(s_names), 0) AS source_count,
    coalesce(p_brand, '') AS description, list_filter([p_type_2, c_mktsegment], lambda x: x IS NOT NULL) AS tags,
    k % 5 = 2 AS excludes_start, k % 50 = 0 AS is_demo,
    CASE WHEN coalesce(len(s_names), 0) > 1 THEN 'multi_source' WHEN k % 9 = 0 THEN 'review' ELSE 'partial' END AS data_quality,
    CASE WHEN o_orderstatus <> 'P' THEN floor(o_totalprice / 500) END AS price_min,
    CASE WHEN k % 11 = 0 THEN 'EUR' ELSE 'SEK' END AS currency,
    CASE o_orderstatus WHEN 'F' THEN 'free' WHEN 'O' THEN 'known' ELSE 'unknown' END AS price_status,
    k % 17 = 0 AS is_sponsored, CASE WHEN k % 17 = 0 THEN 'camp-' || (k % 5) END AS sponsor_campaign_id,
    CASE WHEN k % 34 = 0 THEN c_name END AS sponsor_company, CAST(k % 4 AS INTEGER) AS sponsor_priority
  FROM base)
"""


def with_td(body: str) -> str:
    return f"WITH {TD_SQL.strip()},\n{body.strip()}" if not body.strip().upper().startswith("SELECT") else f"WITH {TD_SQL.strip()}\n{body.strip()}"
