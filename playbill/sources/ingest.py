"""Landed payloads to the catalogue: reads, status rows, union, tagging, publish gate."""

from __future__ import annotations

import datetime as dt
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from playbill import vocab
from playbill.functions.classify import apply_taxonomy
from playbill.functions.dates import parse_day
from playbill.functions.text import nz, txt
from playbill.schema import BENCHMARK_REF, as_listings

_REF_FIELDS = [f.split()[0] for f in BENCHMARK_REF.split(", ")]


def read_reference(spark: SparkSession, path: str) -> DataFrame:
    """Reference sample CSV: header order free, byte-order mark tolerated, fields trimmed, absent columns ''."""
    df = spark.read.option("header", True).option("encoding", "UTF-8").option("multiLine", True).option("escape", '"').csv(path)
    have = {c.lstrip("﻿").strip(): c for c in df.columns}
    cols = [F.trim(F.coalesce(F.col(f"`{have[f]}`"), F.lit(""))) if f in have else F.lit("") for f in _REF_FIELDS]
    return df.select([c.alias(f) for c, f in zip(cols, _REF_FIELDS)])


def read_payloads(spark: SparkSession, path: str) -> DataFrame:
    """Landed JSON bodies, one file per fetched page, with path and text; unreadable bodies stay visible."""
    return spark.read.option("wholetext", True).text(path).select(F.col("value").alias("payload"), F.input_file_name().alias("landed_from"))


# --- exact duplicates inside one source --------------------------------------------

def _edge(rows: DataFrame, keys, order: str, pick) -> DataFrame:
    """One row per key by a partial aggregate, so a hot key never meets in one sorted group."""
    payload = [c for c in rows.columns if c not in keys]
    return rows.groupBy(*keys).agg(pick(F.struct(*payload), F.col(order)).alias("_r")).select(*keys, "_r.*")


def keep_first(rows: DataFrame, keys, order: str = "ingest_ord") -> DataFrame:
    return _edge(rows, keys, order, F.min_by).select(*rows.columns)


def keep_last(rows: DataFrame, keys, order: str = "ingest_ord") -> DataFrame:
    return _edge(rows, keys, order, F.max_by).select(*rows.columns)


def unique_in_source(rows: DataFrame, last: bool = False) -> DataFrame:
    """Exact repeats by title, day and city: the first wins, for collector sources the last."""
    keyed = rows.withColumns({"_t": F.trim(F.lower("title"))})
    out = (keep_last if last else keep_first)(keyed, ["_t", "start_date", "city"])
    return out.drop("_t")


# --- status rows ---------------------------------------------------------------------

def safe_error(error_class: Column) -> Column:
    """One of five fixed texts for an error class; never the raw message."""
    kinds = F.create_map(*[F.lit(x) for kv in vocab.IMPORT_ERROR_CLASSES.items() for x in kv])
    texts = F.create_map(*[F.lit(x) for kv in vocab.IMPORT_ERROR_TEXTS.items() for x in kv])
    return texts[F.coalesce(F.try_element_at(kinds, error_class), F.lit("other"))]


def import_status(expected: DataFrame, landed: DataFrame, errors: DataFrame) -> DataFrame:
    """One row per expected source, in configured order: failures are rows, never exceptions.

    expected(source, run_ord), landed(source, ...), errors(source, error_class).
    """
    counts = landed.groupBy("source").agg(F.count("*").cast("int").alias("imported"))
    failed = errors.groupBy("source").agg(F.min("error_class").alias("error_class"))
    df = expected.join(counts, "source", "left").join(failed, "source", "left")
    bad = F.col("error_class").isNotNull()
    seasonal = F.col("source").isin(vocab.SEASONAL_SOURCES) & F.col("imported").isNull()
    return df.select(
        "source", F.when(bad, "Fel").when(seasonal, "Säsongstom").otherwise("OK").alias("status"),
        F.when(bad, 0).otherwise(F.coalesce("imported", F.lit(0))).cast("int").alias("imported"), F.when(bad, safe_error(F.col("error_class"))).otherwise("").alias("comment"), "run_ord",
    ).orderBy("run_ord")


def completeness(pages: DataFrame) -> DataFrame:
    """Page-walk completeness per source and run: pages(source, run, page, total_pages, total_elements, failed)."""
    out = pages.groupBy("source", "run").agg(
        F.count_distinct(F.when(~F.col("failed"), F.col("page"))).alias("pages_fetched"), F.max("total_pages").alias("total_pages"),
        F.max("total_elements").alias("total_elements"), F.count_if("failed").alias("failed_pages"),
    )
    short = F.coalesce(F.col("pages_fetched") < F.col("total_pages"), F.lit(False))
    return out.withColumn("truncated", short | (F.col("failed_pages") > 0))


# --- catalogue -------------------------------------------------------------------------

SOURCE_BITS, PAGE_BITS, POS_BITS, SUB_BITS = 8, 26, 15, 14
ROW_BITS = PAGE_BITS + POS_BITS + SUB_BITS


def _fitting(value, bits: int):
    """A whole number of so many bits, null being 0; another one is an error, never a second use."""
    value = F.coalesce(value.cast("bigint"), F.lit(0))
    return F.when(value.between(0, (1 << bits) - 1), value).otherwise(F.raise_error(F.lit("ordinal out of range")).cast("bigint"))


def ordinal(page, pos, sub=None):
    """A row's ordinal within its source from page, position on it and occurrence.

    Distinct places give distinct ordinals in reading order; a place that does not fit is an error, never a second use.
    """
    out = F.lit(0).cast("bigint")
    for part, bits in ((page, PAGE_BITS), (pos, POS_BITS), (F.lit(0) if sub is None else sub, SUB_BITS)):
        out = F.shiftleft(out, bits) + _fitting(part, bits)
    return out


def source_ordinal(source_ord: Column, row_ord: Column) -> Column:
    """Position in (source, row) order, built from the two ordinals, so nothing is sorted or numbered in one task."""
    return F.shiftleft(_fitting(source_ord, SOURCE_BITS), ROW_BITS) + _fitting(row_ord, ROW_BITS)


def placed(rows: DataFrame, source_ord: int, row_ord: str = "ingest_ord") -> DataFrame:
    """The rows of one source with their place among all sources."""
    return rows.withColumn("ingest_ord", source_ordinal(F.lit(source_ord), F.col(row_ord)))


def page_ranks(raw_pages: DataFrame, *within: str) -> DataFrame:
    """(within, url, fetched_at, page): landed pages numbered from 0 by address and time, narrow rows only.

    In two levels: ranges of addresses are counted, each range starts where those before it end, and
    pages are numbered inside their range; so neither all pages nor a hot source meet in one task.
    """
    from pyspark.sql import Window

    from playbill.session import cut

    keys = [*within, "url", "fetched_at"]
    ranges = cut(raw_pages.select(*keys).distinct().repartitionByRange("url", "fetched_at").withColumn("_range", F.spark_partition_id()))
    sizes = ranges.groupBy(*within, "_range").agg(F.count("*").alias("_n"))
    before = Window.partitionBy(*within).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select(*[F.col(c).alias(f"_w{i}") for i, c in enumerate(within)], F.col("_range").alias("_r"), F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    inside = F.row_number().over(Window.partitionBy(*within, "_range").orderBy("url", "fetched_at")) - 1
    same = F.col("_range") == F.col("_r")
    for i, c in enumerate(within):
        same = same & F.col(c).eqNullSafe(F.col(f"_w{i}"))
    return ranges.withColumn("_i", inside).join(starts, same).select(*keys, (F.col("_start") + F.col("_i")).alias("page"))


def assemble(*sources: DataFrame, order=("source_ord", "row_ord")) -> DataFrame:
    """Union of all sources, tagged with the common taxonomy.

    `ingest_ord` is a position in (source, row) order.
    """
    every = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), sources)
    source_ord, row_ord = (F.col(c) for c in order)
    return apply_taxonomy(as_listings(every.withColumn("ingest_ord", source_ordinal(source_ord, row_ord))))


def only_failing_over(primary: DataFrame, fallback: DataFrame, key: str = "source_key") -> DataFrame:
    """Fallback rows only for sources whose primary feed gave none."""
    return primary.unionByName(fallback.join(primary.select(key).distinct(), key, "left_anti"), allowMissingColumns=True)


def still_running(listings: DataFrame, today: dt.date) -> DataFrame:
    return listings.filter(F.coalesce(parse_day("end_date"), parse_day("start_date")) >= F.lit(today))


def publish(candidates: DataFrame, today: dt.date, city: str = "Örebro") -> DataFrame:
    """Publish gate of audited candidates: not over, right city, a title and a web link."""
    end = parse_day(F.coalesce(F.nullif(txt("end_date"), F.lit("")), F.col("start_date")))
    ok = (end >= F.lit(today)) & (F.col("city") == city) & nz("title").isNotNull() & txt("official_url").rlike("^https?://")
    return candidates.filter(ok).withColumn("data_quality", F.lit("source_verified"))


def write_catalogue(listings: DataFrame, path: str) -> None:
    """Catalogue table by start month, so horizons prune folders."""
    month = F.coalesce(F.date_format(parse_day("start_date"), "yyyy-MM"), F.lit("unknown"))
    listings.withColumn("start_month", month).write.mode("overwrite").partitionBy("start_month").parquet(path)


def read_catalogue(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.option("mergeSchema", True).parquet(path)


def to_records(listings: DataFrame) -> DataFrame:
    """Listings as JSON text, nested fields included."""
    return listings.select("id", F.to_json(F.struct(*listings.columns)).alias("record"))


def from_records(records: DataFrame) -> DataFrame:
    from playbill.schema import listing_type

    return records.select(F.from_json("record", listing_type()).alias("r")).select("r.*")
