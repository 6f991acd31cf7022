"""Explainable scores.  Every function is a column expression over a listing row."""

from __future__ import annotations

import datetime as dt
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from playbill import vocab
from playbill.functions.classify import joined
from playbill.functions.dates import days_until, parse_day
from playbill.functions.quality import is_restricted
from playbill.functions.text import codes, col, contains_any, dedupe_text, search_text, search_text_py, txt


@dataclass(frozen=True)
class SearchRequest:
    """One search: the parameters a visitor chooses."""

    request_id: str
    today: dt.date
    now: dt.datetime | None = None
    origin_city: str | None = None
    when: str = "any"
    radius_km: int | None = None
    price: str = "any"
    query: str = ""
    type_filter: str | None = None
    only_new: bool = False
    interests: tuple[str, ...] = ()
    preset: str | None = None


def with_search_columns(df, where: Column | None = None):
    """Normalised texts, once per row, before any request looks at them; with `where` only of its rows, null in the others."""
    text = search_text if where is None else lambda c: F.when(where, search_text(c))
    return df.withColumns(
        {
            "s_title": text("title"),
            "s_place_v": text("venue"),
            "s_place_c": text("city"),
            "s_tax": text(joined("event_type", "category", tags="tags")),
            "s_desc": text("description"),
            "s_interest": text(joined("title", "event_type", "category", "description", tags="tags")),
            "s_all": text(joined("title", "event_type", "category", "venue", "city", "region", "description", tags="tags")),
        }
    )


def with_request_columns(df, today: dt.date):
    """Everything a request looks at, once per row, so that each request only compares plain columns."""
    return with_plain_columns(with_search_columns(df), today)


def with_plain_columns(df, today: dt.date):
    """`with_request_columns` without the normalised texts."""
    first = parse_day("start_date")
    off = F.filter(
        F.transform(F.coalesce(col("excluded_dates"), F.array().cast("array<string>")), lambda d: F.try_to_date(d, "yyyy-MM-dd")), lambda d: d.isNotNull()
    )
    df = df.withColumns({"_d0": first, "_dx": parse_day("end_date")})
    return df.withColumns(
        {
            "_d1": F.greatest("_d0", F.coalesce("_dx", "_d0")),
            "_off": F.when(F.size("excluded_dates") > 0, F.array_distinct(off)),
            "_days": F.coalesce(F.datediff("_d0", F.lit(today)), F.lit(9999)),
            "_free": F.coalesce(col("price_status") == "free", F.lit(False)),
            "_sek": known_sek(),
            "_trust": trust_points(),
            "_sources": F.size(F.array_distinct("source_names")),
            "_broken": is_restricted(),
            "_demo": F.coalesce(col("is_demo"), F.lit(False)),
        }
    )


def runs_in(lo: dt.date, hi: dt.date) -> Column:
    """`period_matches` over the prepared columns."""
    from_day, to_day = F.greatest(col("_d0"), F.lit(lo)), F.least(col("_d1"), F.lit(hi))
    days_off = F.size(F.filter("_off", lambda d: d.between(from_day, to_day)))
    return (col("_d0") <= F.lit(hi)) & (col("_d1") >= F.lit(lo)) & (
        col("_off").isNull() | (F.datediff(to_day, from_day) + 1 > days_off)
    )


def query_matches(query: str) -> Column:
    q = search_text_py(query)
    return F.contains(F.col("s_all"), F.lit(q)) if q else F.lit(True)


def query_points(query: str) -> Column:
    q = search_text_py(query)
    if not q:
        return F.lit(0)
    has = lambda c: F.contains(F.col(c), F.lit(q))
    return F.when(has("s_title"), 26).when(has("s_place_v") | has("s_place_c"), 16).when(has("s_tax"), 13).when(has("s_desc"), 5).otherwise(0)


def _query_reason(points: Column) -> Column:
    return F.when(points == 26, "query_title").when(points == 16, "query_place").when(points == 13, "query_category").when(points == 5, "query_text")


def interest_points(interests) -> tuple[Column, Column]:
    """(points, reason): 12 for the first matching profile, 3 for each further one, 18 at most."""
    chosen = [i for i in interests or () if i in vocab.INTEREST_PROFILES]
    if not chosen:
        return F.lit(0), F.lit(None).cast("string")
    hits = codes(*[(contains_any(F.col("s_interest"), [search_text_py(k) for k in vocab.INTEREST_PROFILES[i]]), i) for i in chosen])
    n = F.size(hits)
    points = F.when(n > 0, F.least(F.lit(18), 12 + 3 * (n - 1))).otherwise(0)
    return points, F.when(n > 0, F.concat(F.lit("interests: "), F.array_join(F.slice(hits, 1, 2), ", ")))


def distance_points(distance: Column) -> Column:
    return (
        F.when(distance.isNull(), 0).when(distance <= 10, 30).when(distance <= 25, 25).when(distance <= 50, 20)
        .when(distance <= 100, 12).when(distance <= 200, 6).otherwise(2)
    )


def _distance_reason(distance: Column) -> Column:
    return F.when(distance <= 10, "very_near").when(distance <= 25, "near").when(distance <= 50, "fairly_near").when(distance.isNotNull(), "within_radius")


def time_points(days: Column) -> Column:
    return (
        F.when(days < 0, -100).when(days == 0, 30).when(days <= 2, 25).when(days <= 7, 20)
        .when(days <= 14, 15).when(days <= 30, 10).otherwise(4)
    )


def _time_reason(days: Column) -> Column:
    return (
        F.when(days < 0, F.lit(None).cast("string")).when(days == 0, "today").when(days <= 2, "soon").when(days <= 7, "within_week")
        .when(days <= 14, "within_two_weeks").when(days <= 30, "within_month")
    )


def known_sek(status="price_status", low="price_min", currency="currency") -> Column:
    """An explicit, finite, non-negative SEK amount, else null."""
    low = col(low)
    ok = (col(status) == "known") & (F.upper(F.trim(col(currency))) == "SEK") & ~F.isnan(low) & (low >= 0) & (low < F.lit(float("inf")))
    return F.when(ok, low)


def price_matches(price: str) -> Column:
    """Free passes every budget, an unknown price passes none."""
    limit = vocab.PRICE_LIMITS.get(price)
    if limit is None:
        return F.lit(True)
    free = F.coalesce(col("price_status") == "free", F.lit(False))
    return free if limit == 0 else free | F.coalesce(known_sek() <= limit, F.lit(False))


def price_points(price: str) -> Column:
    low, limit = known_sek(), vocab.PRICE_LIMITS.get(price)
    within = F.when(low <= limit * 0.5, 10).otherwise(5) if limit else F.lit(2)
    return F.when(col("price_status") == "free", 14).when(low.isNotNull(), within).otherwise(0)


def _price_reason(points: Column) -> Column:
    return F.when(points == 14, "free").when(points == 10, "well_within_budget").when(points == 5, "within_budget")


def trust_points() -> Column:
    n = F.size(F.array_distinct(F.coalesce(col("source_names"), F.array().cast("array<string>"))))
    return F.when((n >= 2) | F.coalesce(col("data_quality") == "multi_source", F.lit(False)), 5).when(col("data_quality") == "source_verified", 2).otherwise(0)


def rank_columns(request: SearchRequest, distance: Column) -> dict[str, Column]:
    """score, reasons (three at most) and distance of one listing for one request; needs `with_request_columns`."""
    sek, limit = col("_sek"), vocab.PRICE_LIMITS.get(request.price)
    within = F.when(sek <= limit * 0.5, 10).otherwise(5) if limit else F.lit(2)
    price = F.when(col("_free"), 14).when(sek.isNotNull(), within).otherwise(0)
    return summed(query_points(request.query), interest_points(request.interests), distance, price)


def summed(query: Column, interests: tuple[Column, Column], distance: Column, price: Column) -> dict[str, Column]:
    """score, reasons and distance from the points for query, interests and price; the rest comes from the prepared columns."""
    days, t = col("_days"), col("_trust")
    interest, interest_reason = interests
    raw = query + interest + distance_points(distance) + time_points(days) + price + t - F.when(col("_demo"), 100).otherwise(0)
    score = F.when(col("_broken"), F.least(raw, F.lit(vocab.QUALITY_SCORE_CAP))).otherwise(raw)
    trust_reason = F.when(t == 5, F.concat(F.lit("sources: "), F.when(col("_sources") > 0, col("_sources")).otherwise(2).cast("string")))
    parts = (_query_reason(query), interest_reason, _distance_reason(distance), _time_reason(days), _price_reason(price), trust_reason)
    # Nulls are skipped by the join, so three parts at most survive the split.
    found = F.split(F.concat_ws("\u0001", *parts), "\u0001")
    found = F.array_remove(found, "")
    reasons = F.when(col("_broken"), F.concat(F.slice(found, 1, 2), F.array(F.lit("incomplete_core")))).otherwise(F.slice(found, 1, 3))
    return {"score": score.cast("int"), "reasons": reasons, "distance_km": distance}


# --- importance and travel ---------------------------------------------------

def importance() -> Column:
    n = col("source_count")
    venues = F.create_map(*[F.lit(x) for kv in vocab.MAJOR_VENUES.items() for x in kv])
    text = F.lower(F.concat_ws(" ", txt("title"), txt("description")))
    hints = sum((F.when(F.contains(text, F.lit(h)), pts).otherwise(0) for h, pts in vocab.MAJOR_HINTS.items()), F.lit(0))
    return (
        F.when(n > 1, F.least(F.lit(10), 4 + 2 * n)).otherwise(0)
        + F.coalesce(F.try_element_at(venues, col("venue")), F.lit(0))
        + hints
        + F.when(col("event_type") == "Mässa", 2).when(col("event_type") == "Festival", 3).otherwise(0)
    ).cast("int")


def plain_interest_hits(interests) -> Column:
    """How many interests occur literally in type, category or tags."""
    hay = F.lower(joined("event_type", "category", tags="tags"))
    return sum((F.when(F.contains(hay, F.lit(i.lower())), 1).otherwise(0) for i in interests), F.lit(0))


def travel_score(today: dt.date, distance: Column, interests) -> Column:
    hits, days = plain_interest_hits(interests), days_until("start_date", today)
    band = (
        F.when(distance < 80, -8).when(distance.between(80, 250), 12)
        .when((distance > 250) & (distance <= 550), 8).when(distance > 700, -10).otherwise(0)
    )
    lead = F.when(days.between(10, 120), 8).when(days > 365, -4).otherwise(0)
    demo = F.when(F.coalesce(col("is_demo"), F.lit(False)), -40).otherwise(0)
    return (importance() + F.when(hits > 0, F.least(F.lit(30), 12 + 6 * hits)).otherwise(0) + band + lead + demo).cast("int")


# --- source trust -------------------------------------------------------------

def _trust_table() -> dict[str, int]:
    """Normalised display name or alias -> score; built from the fixed registry."""
    from playbill.functions.similarity import telling_words

    norm = lambda s: " ".join(telling_words(search_text_py(s)))
    by_key = {key: vocab.TRUST_SCORES[trust] for key, _, _, _, trust, _ in vocab.SOURCES}
    table = {norm(alias): by_key[key] for alias, key in vocab.SOURCE_ALIASES.items() if key in by_key}
    table.update({norm(name): vocab.TRUST_SCORES[trust] for _, name, _, _, trust, _ in vocab.SOURCES})
    return table


def source_trust(name: Column) -> Column:
    table = F.create_map(*[F.lit(x) for kv in _trust_table().items() for x in kv])
    return F.coalesce(F.try_element_at(table, dedupe_text(name)), F.lit(vocab.DEFAULT_TRUST))


def listing_trust(source_names="source_names") -> Column:
    return F.coalesce(F.array_max(F.transform(col(source_names), source_trust)), F.lit(vocab.DEFAULT_TRUST))


def single_source_quality() -> Column:
    """Explicit quality of an unmerged row; the legacy 'verified' is not trusted."""
    n = F.size(F.array_distinct(F.coalesce(col("source_names"), F.array().cast("array<string>"))))
    return (
        F.when(n >= 2, "multi_source").when(listing_trust() >= 3, "source_verified")
        .when(col("data_quality") == "verified", "partial").otherwise(col("data_quality"))
    )


def verification_label() -> Column:
    n = F.size(F.array_distinct(F.coalesce(col("source_names"), F.array().cast("array<string>"))))
    return (
        F.when(n >= 2, F.concat(F.lit("confirmed_by_"), n.cast("string"))).when(listing_trust() >= 3, "source_verified")
        .when(col("data_quality") == "review", "needs_review").otherwise("check_source")
    )
