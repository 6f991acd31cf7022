"""Catalogue analytics: coverage, source value, detail completeness, health.

Source-level reports explode the (short) source list of each listing and group by
source: partial aggregation leaves one row per source and task before any shuffle.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from playbill import vocab
from playbill.functions import booking, quality
from playbill.functions.classify import frontier_segments
from playbill.functions.dates import in_horizon, parse_day
from playbill.functions.geo import resolve_location
from playbill.functions.quality import DETAIL_FIELDS
from playbill.functions.text import category_label, clean_names, codes, names_or_record_sources, nz, ratio, txt


def upcoming(listings: DataFrame, today: dt.date, days: int) -> DataFrame:
    return listings.filter(in_horizon("start_date", "is_demo", today, days))


def _blank(c) -> Column:
    return F.nullif(txt(c), F.lit("")).isNull()


def _no_link() -> Column:
    return _blank("official_url") & _blank("ticket_url")


# --- coverage ------------------------------------------------------------------

def coverage_snapshot(listings: DataFrame, today: dt.date, days: int = 30, reviews: DataFrame | None = None) -> DataFrame:
    """One row of catalogue counts within the horizon; `days` is reported as given."""
    count = lambda c: F.count_if(F.coalesce(c, F.lit(False)))
    out = upcoming(listings, today, days).withColumn("loc", resolve_location()).agg(
        F.count("*").alias("listings"),
        count(F.col("source_count") > 1).alias("multi_source"),
        count(nz("city").isNull()).alias("missing_city"),
        count(F.col("loc.lat").isNull() | F.col("loc.lon").isNull()).alias("missing_coordinates"),
        count(_no_link()).alias("missing_url"),
        count(F.col("data_quality") == "partial").alias("partial"),
        count(F.col("data_quality") == "review").alias("needs_review"),
    ).withColumn("horizon_days", F.lit(days))
    if reviews is None:
        return out.withColumn("duplicate_candidates", F.lit(0).cast("bigint"))
    return out.crossJoin(reviews.agg(F.count("*").alias("duplicate_candidates")))  # one row each side


def coverage_sources(listings: DataFrame, today: dt.date, days: int = 30, approximate: bool = False) -> DataFrame:
    """Listings per source within the horizon."""
    rows = upcoming(listings, today, days).select("id", F.explode(F.array_distinct("source_names")).alias("source"))
    n = F.approx_count_distinct("id") if approximate else F.count("*")
    return rows.groupBy("source").agg(n.alias("listings"))


# --- source value ----------------------------------------------------------------

def _represented(listings: DataFrame, today, days) -> DataFrame:
    return upcoming(listings, today, days).withColumn("names", clean_names("source_names")).filter(F.size("names") > 0)


def source_value(listings: DataFrame, today: dt.date, days: int = 30) -> DataFrame:
    rows = _represented(listings, today, days).select(F.size("names").alias("n"), F.explode("names").alias("source"))
    out = rows.groupBy("source").agg(
        F.count("*").alias("represented"), F.count_if(F.col("n") == 1).alias("unique_listings"), F.count_if(F.col("n") > 1).alias("overlap_listings")
    )
    share = ratio(F.col("unique_listings"), F.col("represented"))
    signal = (
        F.when(F.col("represented") < 3, "too_little_data")
        .when((F.col("unique_listings") >= 3) & (share >= 0.50), "high_unique_value")
        .when((F.col("represented") >= 5) & (share <= 0.20), "large_overlap")
        .otherwise("mixed")
    )
    return out.withColumns({"unique_share_percent": share * 100.0, "signal": signal})


def source_value_totals(listings: DataFrame, today: dt.date, days: int = 30) -> DataFrame:
    return _represented(listings, today, days).agg(
        F.count("*").alias("listings"), F.count_if(F.size("names") == 1).alias("sole_source"), F.count_if(F.size("names") > 1).alias("multi_source")
    )


def source_overlap_pairs(listings: DataFrame, today: dt.date, days: int = 30) -> DataFrame:
    """Unordered source pairs that share listings.  Pairs come from one listing's own names, never from rows."""
    names = F.col("names")
    pairs = F.flatten(
        F.transform(names, lambda a, i: F.transform(F.slice(names, i + 2, F.size(names)), lambda b: F.struct(a.alias("source_a"), b.alias("source_b"))))
    )
    return (
        _represented(listings, today, days).filter(F.size("names") > 1)
        .select(F.inline(pairs)).groupBy("source_a", "source_b").agg(F.count("*").alias("shared_listings"))
    )


def local_audit(listings: DataFrame, today: dt.date, days: int = 30, sources=tuple(vocab.LOCAL_SOURCES)) -> DataFrame:
    """As source value, for a source list; uniqueness is judged against all sources."""
    rows = (
        booking.with_cta(upcoming(listings, today, days))
        .withColumns({"names": clean_names("source_names"), "kind": category_label("event_type", "category")})
        .withColumn("bookable", F.col("cta_quality") == "bookable")
        .select("kind", "bookable", F.size("names").alias("n"), F.explode("names").alias("source"))
        .filter(F.col("source").isin(list(sources)))
    )
    sole = F.col("n") == 1
    sets = lambda c: F.array_sort(F.collect_set(c))
    out = rows.groupBy("source").agg(
        F.count("*").alias("represented"), F.count_if(sole).alias("unique_listings"), F.count_if(F.col("n") > 1).alias("overlap_listings"),
        sets("kind").alias("categories"), sets(F.when(sole, F.col("kind"))).alias("unique_categories"), F.count_if("bookable").alias("bookable"),
    )
    return out.withColumns(
        {
            "unique_share": ratio(F.col("unique_listings"), F.col("represented")),
            "category_count": F.size("categories"), "unique_category_count": F.size("unique_categories"),
            "booking_coverage": ratio(F.col("bookable"), F.col("represented")),
        }
    )


# --- coverage frontier ---------------------------------------------------------------

def segment_dimension(spark) -> DataFrame:
    return spark.createDataFrame([(s,) for s in vocab.FRONTIER_SEGMENTS], "segment string")


def coverage_frontier(listings: DataFrame, today: dt.date, horizons=(30, 60, 90)) -> DataFrame:
    """Thin and missing segments.  Counts per horizon, source diversity over the longest one."""
    longest = max(horizons)
    day = parse_day("start_date")
    rows = (
        upcoming(listings, today, longest)
        .select(day.alias("day"), clean_names("source_names").alias("names"), F.explode(frontier_segments()).alias("segment"))
    )
    within = lambda h: F.count_if(F.col("day") <= F.lit(today + dt.timedelta(days=h)))
    counts = rows.groupBy("segment").agg(F.count("*").alias("matched"), *[within(h).alias(f"listings_{h}") for h in horizons])
    # Sources per segment: distinct pairs first, so no collected set grows with the data.
    pairs = rows.select("segment", F.explode("names").alias("source")).distinct()
    sources = pairs.groupBy("segment").agg(
        F.count("*").alias("source_diversity"), F.count_if(F.col("source").isin(vocab.TRUSTED_SOURCES)).alias("trusted_sources"),
        F.array_sort(F.collect_list("source")).alias("sources"),
    )
    out = segment_dimension(listings.sparkSession).join(counts, "segment", "left").join(sources, "segment", "left")
    zero = {c: F.coalesce(F.col(c), F.lit(0)) for c in ["matched", "source_diversity", "trusted_sources"] + [f"listings_{h}" for h in horizons]}
    out = out.withColumns(zero).withColumn("sources", F.coalesce("sources", F.array().cast("array<string>")))
    first = F.col(f"listings_{30 if 30 in horizons else min(horizons)}")
    status = F.when((first >= 4) & (F.col("source_diversity") >= 2), "good").when(F.col("matched") > 0, "thin").otherwise("missing")
    return out.withColumns({"status": status, "single_source": (F.col("matched") > 0) & (F.col("source_diversity") == 1)})


# --- detail completeness ---------------------------------------------------------------

def _detail_flags(listings: DataFrame, today, days) -> DataFrame:
    flags = {f"has_{f}": quality.has_detail(f) for f in DETAIL_FIELDS}
    flags["has_venue"] = nz("venue").isNotNull()
    rows = upcoming(listings, today, days).withColumn("names", names_or_record_sources("source_names", "source_records"))
    rows = rows.withColumns(flags)
    return rows.withColumn("has_time_range", F.col("has_start_time") & F.col("has_end_time"))


_COVERED = ["start_time", "end_time", "time_range", "venue", "precise_venue", "price", "age_limit", "door_time", "booking"]


def detail_coverage(listings: DataFrame, today: dt.date, days: int = 30) -> DataFrame:
    """Per source: how many listings carry each practical detail, in total and where it is the only source."""
    rows = _detail_flags(listings, today, days).select(
        *[f"has_{f}" for f in _COVERED], F.size("names").alias("n"), F.explode("names").alias("source")
    )
    sole = F.col("n") == 1
    aggs = [F.count("*").alias("represented"), F.count_if(sole).alias("single_source"), F.count_if(F.col("n") > 1).alias("multi_source")]
    aggs += [F.count_if(f"has_{f}").alias(f"{f}_listings") for f in _COVERED]
    aggs += [F.count_if(sole & F.col(f"has_{f}")).alias(f"single_{f}_listings") for f in DETAIL_FIELDS]
    out = rows.groupBy("source").agg(*aggs)
    out = out.withColumns({f"{f}_coverage": ratio(F.col(f"{f}_listings"), F.col("represented")) for f in _COVERED})
    return out.withColumn("flags", detail_flags())


def detail_flags() -> Column:
    cov = lambda f: F.coalesce(F.col(f"{f}_coverage"), F.lit(0.0))
    practical = sum((F.when(cov(f) >= 0.20, 1).otherwise(0) for f in ("end_time", "price", "age_limit", "door_time")), F.lit(0))
    found = codes(
        ((cov("start_time") >= 0.80) & (cov("precise_venue") >= 0.80) & (practical >= 2), "strong_practical_data"),
        ((cov("start_time") >= 0.60) & (cov("end_time") < 0.25), "end_time_often_missing"),
        (cov("precise_venue") < 0.70, "place_needs_work"),
        (cov("price") < 0.20, "price_often_missing"),
        (practical == 0, "limited_details"),
    )
    return (
        F.when(F.col("represented") < 3, F.array(F.lit("too_little_data")))
        .when(F.size(found) > 0, found).otherwise(F.array(F.lit("even_base_data")))
    )


def detail_summary(listings: DataFrame, today: dt.date, days: int = 30) -> DataFrame:
    """Catalogue-wide ratios; a listing counts once however many sources it has."""
    total = _detail_flags(listings, today, days).agg(F.count("*").alias("listings"), *[F.count_if(f"has_{f}").alias(f) for f in _COVERED])
    return total.select("listings", *[ratio(F.col(f), F.col("listings")).alias(f"{f}_coverage") for f in _COVERED if f != "venue"])


def gap_priorities(coverage: DataFrame, include_low: bool = False) -> DataFrame:
    """Source x field opportunities with an explicit band; no hidden score."""
    cell = lambda f, i: F.struct(
        F.lit(f).alias("field"), F.lit(i).alias("field_ord"), F.coalesce(F.col(f"{f}_coverage"), F.lit(0.0)).alias("coverage"),
        F.col(f"{f}_listings").alias("present"), F.col(f"single_{f}_listings").alias("single_present"),
    )
    rows = coverage.select("source", "represented", "single_source", F.inline(F.array(*[cell(f, i) for i, f in enumerate(DETAIL_FIELDS)])))
    rows = rows.withColumns(
        {
            "missing": F.greatest(F.lit(0), F.col("represented") - F.col("present")),
            "single_missing": F.greatest(F.lit(0), F.col("single_source") - F.col("single_present")),
        }
    )
    few = F.col("represented") < 3
    high = (F.col("single_source") >= 3) & (F.col("single_missing") >= 3) & (F.col("coverage") < 0.50)
    multi = (F.col("missing") >= 5) & (F.col("coverage") < 0.50)
    medium = ((F.col("single_missing") >= 2) | (F.col("missing") >= 3)) & (F.col("coverage") < 0.75)
    priority = F.when(few, "too_little_data").when(high, "high").when(multi, "high_multi_source").when(medium, "medium").otherwise("low")
    band = F.when(few, 3).when(high, 0).when(multi, 1).when(medium, 2).otherwise(3)
    out = rows.withColumns({"priority": priority, "band": band, "coverage_pct": F.bround(F.col("coverage") * 100).cast("int")})
    return out if include_low else out.filter(F.col("priority") != "low")


def gap_order() -> list[Column]:
    return [F.col("band"), F.col("single_missing").desc(), F.col("missing").desc(), F.col("field_ord"), F.lower("source")]


def _source_url(source: str) -> Column:
    """struct(url, basis): the source's own record first, then the listing's links."""
    own = F.filter(F.col("source_records"), lambda r: (F.trim(r["source"]) == source) & (F.trim(F.coalesce(r["source_url"], F.lit(""))) != ""))
    record = F.trim(F.try_element_at(own, F.lit(1))["source_url"])
    official, ticket = nz("official_url"), nz("ticket_url")
    basis = F.when(record.isNotNull(), "source_record").when(official.isNotNull(), "official_url").when(ticket.isNotNull(), "ticket_url").otherwise("none")
    return F.struct(F.coalesce(record, official, ticket, F.lit("")).alias("url"), basis.alias("basis"))


def gap_cases(listings: DataFrame, source: str, field: str, today: dt.date, days: int = 30, limit: int | None = None) -> DataFrame:
    """Listings of a source that miss a field, cleanly attributable ones first."""
    rows = upcoming(listings, today, days).withColumn("names", names_or_record_sources("source_names", "source_records"))
    rows = rows.filter(F.array_contains("names", source) & quality.missing_detail(field)).withColumn("_u", _source_url(source))
    clean = F.size("names") == 1
    ordered = rows.orderBy(
        (~clean).asc(), F.col("start_date"), F.coalesce(F.nullif(txt("start_time"), F.lit("")), F.lit("99:99")), F.lower("title"), "ingest_ord"
    )
    return (
        (ordered if limit is None else ordered.limit(max(1, limit)))
        .select(
            "id", txt("title").alias("title"), F.col("start_date").alias("date"), txt("start_time").alias("start_time"), txt("venue").alias("venue"),
            F.col("_u.url").alias("url"), F.col("_u.basis").alias("url_basis"),
            F.when(clean, "single_source").otherwise("multi_source").alias("attribution"),
            F.size("names").alias("source_count"), F.array_join("names", " · ").alias("sources"), clean.alias("clean_attribution"),
        )
    )


def gap_summary(cases: DataFrame) -> DataFrame:
    out = cases.agg(
        F.count("*").alias("cases"), F.count_if("clean_attribution").alias("clean_cases"), F.count_if(F.col("url") != "").alias("cases_with_url")
    )
    return out.withColumns({"multi_source_cases": F.col("cases") - F.col("clean_cases"), "url_coverage": ratio(F.col("cases_with_url"), F.col("cases"))})


# --- source health -------------------------------------------------------------------------

def source_health(import_status: DataFrame, listings: DataFrame) -> DataFrame:
    """State of every imported source from its status row and what was actually landed."""
    miss = lambda c: F.count_if(nz(c).isNull())
    seen = (
        listings.select("city", "start_date", _no_link().alias("no_link"), F.explode("source_names").alias("source"))
        .groupBy("source").agg(F.count("*").alias("n"), F.count_if("no_link").alias("no_url"), miss("city").alias("no_city"), miss("start_date").alias("no_date"))
    )
    df = import_status.join(seen, "source", "left").withColumn("imported", F.coalesce("imported", F.lit(0)))
    status, empty = F.coalesce(F.col("status"), F.lit("")), F.col("imported") == 0
    state = (
        F.when(~status.isin(vocab.NON_ERROR_STATES), "error").when(status == "Ej konfigurerad", "not_configured")
        .when((status == "Säsongstom") | (empty & F.col("source").isin(vocab.SEASONAL_SOURCES)), "seasonal_empty")
        .when(empty, "check").when(status == "Delvis", "partial").when(status == "Pilot", "pilot").otherwise("ok")
    )
    df = df.withColumn("_state", state)
    big = F.coalesce(F.col("n") >= 3, F.lit(False))
    no_date = F.coalesce(F.col("no_date") > 0, F.lit(False))
    no_url, no_city = big & (F.col("no_url") / F.col("n") >= 0.80), big & (F.col("no_city") / F.col("n") >= 0.80)
    issues = F.array_compact(
        F.array(
            F.when(F.col("_state") == "error", "import_failed"),
            F.when(F.col("_state") == "check", "empty_import"),
            F.when(F.col("_state") == "partial", "import_truncated"),
            F.when(no_date, F.concat_ws(" ", F.lit("start_date_missing"), F.concat_ws("/", F.col("no_date").cast("string"), F.col("n").cast("string")))),
            F.when(no_url, F.concat_ws(" ", F.lit("url_missing"), F.concat_ws("/", F.col("no_url").cast("string"), F.col("n").cast("string")))),
            F.when(no_city, F.concat_ws(" ", F.lit("city_missing"), F.concat_ws("/", F.col("no_city").cast("string"), F.col("n").cast("string")))),
        )
    )
    final = F.when((no_date | no_url | no_city) & F.col("_state").isin("ok", "pilot"), "check").otherwise(F.col("_state"))
    df = df.withColumns({"issues": issues, "state": final})
    return df.select(
        "source", "state", "imported", "issues",
        F.when(F.size("issues") > 0, F.array_join("issues", "; ")).otherwise(F.coalesce(nz("comment"), F.lit("no_deviation"))).alias("summary"),
    )


def health_summary(health: DataFrame, core=tuple(vocab.CORE_SOURCES)) -> DataFrame:
    degraded, is_core = F.col("state").isin("error", "check"), F.col("source").isin(list(core))
    out = health.agg(
        F.count_if(degraded).alias("degraded"), F.count_if(is_core & degraded).alias("degraded_core"),
        F.count_if(is_core).alias("core"), F.count_if(is_core & ~degraded & (F.col("imported") > 0)).alias("healthy_core"),
    )
    return out.withColumn("has_public_warning", (F.col("core") > 0) & (F.col("healthy_core") < 2))


def health_states(health: DataFrame) -> DataFrame:
    return health.groupBy("state").agg(F.count("*").alias("sources"))


# --- quality reports -----------------------------------------------------------------------

def quality_counts(listings: DataFrame) -> DataFrame:
    return listings.groupBy(quality.quality_level().alias("level")).agg(F.count("*").alias("listings"))


def quality_rows(listings: DataFrame) -> DataFrame:
    """Listings that do not pass the gate, with their reasons."""
    df = listings.withColumns({"level": quality.quality_level(), "reasons": F.concat(quality.restricted_reasons(), quality.review_reasons())})
    return df.filter(F.col("level") != "pass").select("id", "title", "start_date", F.array_sort(F.array_distinct("source_names")).alias("sources"), "level", "reasons")


def noise_rows(listings: DataFrame) -> DataFrame:
    df = listings.withColumn("severity", quality.noise_severity()).filter(F.col("severity") != "none")
    return df.select("id", "title", "start_date", clean_names("source_names").alias("sources"), "severity")


def noise_by_source(listings: DataFrame) -> DataFrame:
    rows = noise_rows(listings).withColumn("sources", F.when(F.size("sources") > 0, F.col("sources")).otherwise(F.array(F.lit(vocab.UNKNOWN_SOURCE))))
    return rows.select("severity", F.explode("sources").alias("source")).groupBy("source").agg(
        F.count_if(F.col("severity") == "high").alias("high_noise"), F.count_if(F.col("severity") == "review").alias("review")
    )


def concentration(top: DataFrame, values: Column) -> DataFrame:
    """Most frequent value of a result list, first met on ties, with its share of the list."""
    total = top.agg(F.count("*").alias("total"))
    rows = top.select("position", F.explode(F.array_sort(F.array_distinct(F.filter(values, lambda v: v != "")))).alias("name"))
    counts = rows.groupBy("name").agg(F.count("*").alias("n"), F.min("position").alias("first"))
    best = counts.orderBy(F.col("n").desc(), "first", "name").limit(1)
    return best.crossJoin(total).select("name", F.col("n").alias("count"), (F.col("n") / F.col("total") * 100.0).alias("share_percent"))


def top_quality(ranked: DataFrame, top_n: int = 10) -> DataFrame:
    """Issues of the visible top results (`position` numbered)."""
    top = ranked.filter(F.col("position") <= max(1, top_n))
    return top.withColumns({"title_issue": quality.title_issue(), "metadata_issues": quality.metadata_issues()})


def top_quality_warnings(ranked: DataFrame, near_duplicates: DataFrame, top_n: int = 10) -> DataFrame:
    """Warning codes of a result list; inputs are bounded by `top_n`."""
    rows = top_quality(ranked, top_n)
    weak, severe = F.col("title_issue").isNotNull(), F.arrays_overlap("metadata_issues", F.array(F.lit("place_missing"), F.lit("date_missing")))
    stats = rows.agg(F.count("*").alias("n"), F.count_if(weak).alias("weak"), F.count_if(severe).alias("severe"))
    share = lambda values, name: concentration(rows, values).select(F.col("share_percent").alias(name))
    kind = F.array(F.coalesce(F.nullif(F.col("event_type"), F.lit("")), F.col("category")))
    stats = stats.join(share(clean_names("source_names"), "source_share"), how="left", on=F.lit(True))
    stats = stats.join(share(kind, "type_share"), how="left", on=F.lit(True))
    stats = stats.join(near_duplicates.agg(F.count("*").alias("pairs")), how="left", on=F.lit(True))
    codes = F.array_compact(
        F.array(
            F.when(F.col("pairs") > 0, "near_duplicates"),
            F.when((F.col("n") >= 5) & (F.col("source_share") >= 70), "source_dominates"),
            F.when((F.col("n") >= 5) & (F.col("type_share") >= 70), "type_dominates"),
            F.when(F.col("weak") >= F.greatest(F.lit(2), F.floor(F.col("n") / 3)), "weak_titles"),
            F.when(F.col("severe") > 0, "core_metadata_missing"),
        )
    )
    return stats.withColumn("warnings", codes)


def near_duplicates(ranked: DataFrame, top_n: int = 10, floor: float = vocab.NEAR_DUPLICATE_FLOOR) -> DataFrame:
    """Nearly equal titles on the same day within one visible result list (at most `top_n` rows per list)."""
    from playbill.functions.similarity import length_bound, seq_ratio
    from playbill.functions.text import search_text

    keys = [c for c in ("request_id",) if c in ranked.columns]
    top = ranked.filter(F.col("position") <= max(1, top_n)).select(
        *keys, "id", "title", "start_date", "position", search_text("title").alias("t"), search_text("city").alias("c")
    ).filter(F.col("t") != "")
    a, b = top.alias("a"), top.alias("b")
    on = (F.col("a.start_date").eqNullSafe(F.col("b.start_date"))) & (F.col("a.position") < F.col("b.position"))
    for k in keys:
        on = on & (F.col(f"a.{k}") == F.col(f"b.{k}"))
    cities = (F.col("a.c") == "") | (F.col("b.c") == "") | (F.col("a.c") == F.col("b.c"))
    pairs = a.join(b, on).filter(cities & length_bound(F.col("a.t"), F.col("b.t"), floor))
    return pairs.withColumn("similarity", seq_ratio(F.col("a.t"), F.col("b.t"))).filter(F.col("similarity") >= floor).select(
        *[F.col(f"a.{k}") for k in keys], F.col("a.id").alias("left_id"), F.col("b.id").alias("right_id"),
        F.col("a.title").alias("title_a"), F.col("b.title").alias("title_b"), F.col("a.start_date").alias("date"), "similarity",
    )
