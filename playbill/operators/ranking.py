"""Search, ranking, near-tie diversification and top-k reports.

A request is a handful of constants, so many requests are evaluated in one scan:
each listing row builds an array with one struct per matching request and the
array is exploded.  There is no join between requests and listings.
"""

from __future__ import annotations

from dataclasses import replace
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from playbill import vocab
from playbill.functions import dates, geo, scoring, showtimes
from playbill.functions.classify import sport_allowed
from playbill.functions.quality import is_noise
from playbill.functions.scoring import SearchRequest
from playbill.session import cut

TOP_N = 10
SCORE_BAND = 8
PAGE = 12

# Bounds of the near-tie superset; see `diversify`.
PER_SLOT = 10
PER_DAY_OR_VENUE = 120
PER_TYPE = 3360


def visible(listings: DataFrame, today) -> DataFrame:
    """Base visibility: no demo rows, no navigation noise, not over, sport within scope.

    A stored `last_date` is compared as text, which valid dates imply; it is the part that a scan can prune with.
    """
    if "last_date" in listings.columns:
        listings = listings.filter(F.col("last_date") >= today.isoformat())
    return listings.filter(
        ~F.coalesce("is_demo", F.lit(False))
        & dates.period_matches("start_date", "end_date", "excluded_dates", "any", today)
        & ~is_noise()
        & sport_allowed()
    )


def with_location(listings: DataFrame) -> DataFrame:
    return listings.withColumn("loc", geo.resolve_location())


def is_new(first_seen: Column, now) -> Column:
    """First seen within the last seven days; demo rows never are."""
    cutoff = F.lit(now).cast("timestamp") - F.expr("INTERVAL 7 DAYS")
    return F.coalesce((first_seen.cast("timestamp") >= cutoff) & ~F.coalesce(F.col("is_demo"), F.lit(False)), F.lit(False))


def request_matches(r: SearchRequest, distance: Column, *, when=None, radius=None, price=None, only_new=None) -> Column:
    """All filters of a request; single constraints can be overridden for a relaxation."""
    when = r.when if when is None else when
    price = r.price if price is None else price
    radius = r.radius_km if radius is None else radius
    only_new = r.only_new if only_new is None else only_new
    cond = scoring.runs_in(*dates.window_of(when, r.today))
    if r.type_filter:
        cond = cond & (F.col("event_type") == r.type_filter)
    if only_new:
        cond = cond & F.coalesce(F.col("is_new"), F.lit(False))
    limit = vocab.PRICE_LIMITS.get(price)
    if limit is not None:
        cond = cond & (F.col("_free") if limit == 0 else F.col("_free") | F.coalesce(F.col("_sek") <= limit, F.lit(False)))
    if r.origin_city and radius is not None:
        cond = cond & F.coalesce(distance <= radius, F.lit(False))
    if r.query:
        cond = cond & scoring.query_matches(r.query)
    if r.preset:
        cond = cond & showtimes.preset_matches(r.preset, r.now, distance)
    return F.coalesce(cond, F.lit(False))


def _distances(df: DataFrame, requests) -> tuple[DataFrame, dict]:
    """One distance column per distinct origin."""
    origins = sorted({r.origin_city for r in requests if r.origin_city})
    names = {o: f"_km_{i}" for i, o in enumerate(origins)}
    lat, lon = F.col("loc.lat"), F.col("loc.lon")
    return df.withColumns({names[o]: geo.distance_km(lat, lon, o) for o in origins}), names


def prepare(listings: DataFrame, requests) -> tuple[DataFrame, dict]:
    """Request columns, location and distances; rows outside every request's period are dropped first.

    Texts are normalised only for rows that a request with a query or interests may take by everything else it asks for.
    """
    windows = [dates.window_of(r.when, r.today) for r in requests]
    latest = max(hi for _, hi in windows)
    days = {r.today for r in requests}
    if len(days) != 1:
        raise ValueError("requests of one evaluation share their day")
    soon = listings.filter(F.col("start_date") <= latest.isoformat())
    if "last_date" in listings.columns:
        soon = soon.filter(F.col("last_date") >= min(lo for lo, _ in windows).isoformat()).drop("last_date")
    rows, names = _distances(with_location(scoring.with_plain_columns(soon, days.pop())), requests)
    readers = dict.fromkeys(replace(r, request_id="", query="", interests=(), preset=None) for r in requests if r.query or r.interests)
    read = reduce(lambda a, b: a | b, [request_matches(r, _km(names, r)) for r in readers], F.lit(False))
    return scoring.with_search_columns(rows.withColumn("_read", read), F.col("_read")).drop("_read"), names


def _km(names, r: SearchRequest) -> Column:
    return F.col(names[r.origin_city]) if r.origin_city else F.lit(None).cast("int")


def score_requests(listings: DataFrame, requests: list[SearchRequest], keep=()) -> DataFrame:
    """One row per (request, matching listing) with score, reasons and distance."""
    df, names = prepare(listings, requests)
    hits = {}
    for i, r in enumerate(requests):
        ranked = scoring.rank_columns(r, _km(names, r))
        row = F.struct(F.lit(r.request_id).alias("request_id"), *[c.alias(n) for n, c in ranked.items()])
        hits[f"_hit_{i}"] = F.when(request_matches(r, _km(names, r)), row)
    base = ["id", "ingest_ord", "title", "event_type", "venue", "start_date"]
    cols = list(dict.fromkeys(base + list(keep)))
    # The structs are columns of their own so that they are generated code; only the compaction is not.
    df = df.select(*cols, *[c.alias(n) for n, c in hits.items()])
    return df.select(*cols, F.explode(F.array_compact(F.array(*hits))).alias("_h")).select("_h.*", *cols)


def base_order() -> list[Column]:
    return [F.col("score").desc(), F.col("start_date").asc(), F.lower("title").asc(), F.col("ingest_ord").asc()]


def rank_top(scored: DataFrame, k: int, keys=("request_id",)) -> DataFrame:
    """Best `k` per request in base order, numbered from 1."""
    w = Window.partitionBy(*keys).orderBy(*base_order())
    return scored.withColumn("position", F.row_number().over(w)).filter(F.col("position") <= k)


def _pick(rows: pd.DataFrame, k: int) -> list[int]:
    """Row numbers in presentation order; `rows` is in base order."""
    n = len(rows)
    if n < 3:
        return list(range(min(n, k)))
    score = rows["score"].to_numpy()
    kind, venue, day = (rows[c].fillna("").tolist() for c in ("event_type", "venue", "start_date"))
    left, chosen = list(range(n)), []
    while left and len(chosen) < TOP_N:
        floor = score[left[0]] - SCORE_BAND
        near, last = chosen[-2:], chosen[-3:]
        best, best_value = left[0], None
        for i in left:
            if score[i] < floor:
                break
            cost = min(6, 3 * sum(kind[j] == kind[i] for j in last))
            cost += min(4, 4 * sum(venue[i] != "" and venue[j] == venue[i] for j in near))
            cost += min(2, 2 * sum(day[j] == day[i] for j in near))
            value = score[i] - cost
            if best_value is None or value > best_value:
                best, best_value = i, value
        chosen.append(best)
        left.remove(best)
    return (chosen + left)[:k]


def diversify(scored: DataFrame, k: int = PAGE, keys=("request_id",)) -> DataFrame:
    """First `k` results per request with the first ten diversified among near-ties.

    Only ten rows are picked, each from rows at most eight points below the best
    remaining one, and the penalty depends on type, venue and day alone.  A row can
    therefore never be picked when enough earlier rows of its score avoid everything
    a penalty could look at; nine taken rows, two recent venues and two recent days
    give these exact bounds, each a group limit that runs before its shuffle:

    * 10 rows per (score, type, venue, day);
    * 120 per (score, type, venue) and per (score, type, day), which hold at least
      12 days or venues once the first bound has been applied;
    * 3360 per (score, type): with at most 240 rows sharing a venue or day with any
      given row, these hold 14 rows that differ pairwise in both.
    """
    keys = list(keys)
    scored = cut(scored)  # read three times below
    top = rank_top(scored, max(k, TOP_N), keys)
    edge = top.filter(F.col("position") <= TOP_N).groupBy(*keys).agg(F.min("score").alias("_edge"))
    near = scored.join(edge, keys).filter(F.col("score") >= F.col("_edge") - SCORE_BAND).drop("_edge")
    order = [F.col("start_date"), F.lower("title"), F.col("ingest_ord")]
    for by, limit in (
        (["event_type", "venue", "start_date"], PER_SLOT),
        (["event_type", "venue"], PER_DAY_OR_VENUE),
        (["event_type", "start_date"], PER_DAY_OR_VENUE),
        (["event_type"], PER_TYPE),
    ):
        w = Window.partitionBy(*keys, "score", *by).orderBy(*order)
        near = near.withColumn("_n", F.row_number().over(w)).filter(F.col("_n") <= limit).drop("_n")
    pool = top.drop("position").unionByName(near).withColumn("_t", F.lower("title"))
    out_type = T.StructType(scored.schema.fields + [T.StructField("position", T.IntegerType())])

    def present(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.drop_duplicates("ingest_ord")
        pdf = pdf.sort_values(["score", "start_date", "_t", "ingest_ord"], ascending=[False, True, True, True]).reset_index(drop=True)
        out = pdf.iloc[_pick(pdf, k)].copy()
        out["position"] = range(1, len(out) + 1)
        return out[[f.name for f in out_type]]

    return pool.groupBy(*keys).applyInPandas(present, out_type)


# --- top-k reports -----------------------------------------------------------

def top_k(df: DataFrame, k: int, order, keys=()) -> DataFrame:
    """Per-key top k, or a plain take-ordered when there is no key."""
    if not keys:
        return df.orderBy(*order).limit(k)
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("position", F.row_number().over(w)).filter(F.col("position") <= k)


def _travel_order(score="score"):
    return [F.col(score).desc(), F.col("start_date").asc(), F.col("ingest_ord").asc()]


def recommended(listings: DataFrame, interests, limit: int = PAGE) -> DataFrame:
    hits = scoring.plain_interest_hits(interests)
    demo = F.when(F.col("is_demo"), 30).otherwise(0)
    scored = listings.withColumn("score", (hits * 20 + scoring.importance() - demo).cast("int"))
    return top_k(scored.filter(F.col("score") > 0), limit, _travel_order())


def worth_a_trip(listings: DataFrame, origin: str, interests, today, limit: int = 8) -> DataFrame:
    df = with_location(listings).withColumn("distance_km", geo.distance_km(F.col("loc.lat"), F.col("loc.lon"), origin))
    scored = df.withColumn("score", scoring.travel_score(today, F.col("distance_km"), interests))
    return top_k(scored.filter((F.col("distance_km") >= 80) & (F.col("score") > 8)), limit, _travel_order())


def big_fairs(listings: DataFrame, limit: int = 10, fair_type: str = "Mässa") -> DataFrame:
    demo = F.when(F.col("is_demo"), 30).otherwise(0)
    scored = listings.filter(F.col("event_type") == fair_type).withColumn("score", (scoring.importance() - demo).cast("int"))
    return top_k(scored, limit, _travel_order())


def this_weekend(listings: DataFrame, today) -> DataFrame:
    return listings.filter(dates.period_matches("start_date", "end_date", "excluded_dates", "weekend", today))


def newly_announced(listings: DataFrame, limit: int = 10) -> DataFrame:
    return listings.filter(F.col("is_new")).orderBy("start_date", "ingest_ord").limit(limit)


def shortlist(ranked: DataFrame, condition: Column, limit: int = 3, keys=("request_id",)) -> DataFrame:
    """First eligible results in the existing order."""
    w = Window.partitionBy(*keys).orderBy("position")
    return ranked.filter(condition).withColumn("pick", F.row_number().over(w)).filter(F.col("pick") <= max(0, limit))


def tonight_shortlist(ranked: DataFrame, limit: int = 3) -> DataFrame:
    label = F.element_at(F.array(*[F.lit(t) for t in ("best_tonight", "next_choice", "also_strong")]), F.least("position", F.lit(3)))
    label = F.when(F.col("position") <= 3, label).otherwise(F.concat(F.lit("choice_"), F.col("position").cast("string")))
    return ranked.filter(F.col("position") <= max(0, limit)).withColumn("label", label)


def not_shown(ranked: DataFrame, shown: DataFrame, keys=("request_id", "id")) -> DataFrame:
    return ranked.join(shown.select(*keys), list(keys), "left_anti")


def saved_only(listings: DataFrame, favorites: DataFrame) -> DataFrame:
    return listings.join(favorites.select(F.col("event_id").alias("id")), "id", "left_semi")


def page(ranked: DataFrame, requested: int | None = None, initial: int = PAGE) -> DataFrame:
    """Visible rows of a numbered result."""
    size = initial if requested is None else max(0, int(requested))
    return ranked.filter(F.col("position") <= size)


def page_state(counts: DataFrame, current: int, batch: int = PAGE) -> DataFrame:
    """visible / next_limit / remaining from a `total` column."""
    total, current = F.greatest(F.col("total"), F.lit(0)), max(0, int(current))
    visible_rows = F.least(total, F.lit(current))
    return counts.withColumns(
        {"visible": visible_rows, "next_limit": F.least(total, F.lit(current + max(1, batch))), "remaining": F.greatest(total - current, F.lit(0))}
    )


# --- sponsored placements ----------------------------------------------------

def campaign_active(today) -> Column:
    start, end = dates.parse_day("sponsor_start_date"), dates.parse_day("sponsor_end_date")
    raw = lambda c: F.nullif(F.col(c), F.lit(""))
    valid = (raw("sponsor_start_date").isNull() | start.isNotNull()) & (raw("sponsor_end_date").isNull() | end.isNotNull())
    inside = F.coalesce(start <= F.lit(today), F.lit(True)) & F.coalesce(end >= F.lit(today), F.lit(True))
    named = raw("sponsor_campaign_id").isNotNull() & raw("sponsor_company").isNotNull()
    return F.coalesce(F.col("is_sponsored"), F.lit(False)) & valid & inside & named


def sponsored(ranked: DataFrame, today, origin_city: str | None, interests, max_rank: int = 12, gap: int = 12) -> DataFrame:
    """Placements chosen among the best organic results; payment never changes the ranking."""
    top = ranked.filter(F.col("position") <= max_rank)
    best = F.first("score").over(Window.partitionBy("request_id").orderBy("position"))
    norm = lambda c: F.filter(F.transform(F.coalesce(F.col(c), F.array().cast("array<string>")), lambda x: F.lower(F.trim(x))), lambda x: x != "")
    geo_ok = F.lit(True)
    if origin_city:
        geo_ok = (F.size(norm("sponsor_geo_areas")) == 0) | F.array_contains(norm("sponsor_geo_areas"), origin_city.lower())
    wanted = [i.strip().lower() for i in interests or () if i.strip()]
    audience_ok = F.lit(True)
    if wanted:
        audience_ok = (F.size(norm("sponsor_audiences")) == 0) | F.arrays_overlap(norm("sponsor_audiences"), F.array(*[F.lit(x) for x in wanted]))
    rows = top.withColumn("_best", best).filter(
        campaign_active(today) & (F.col("score") >= F.col("_best") - gap) & geo_ok & audience_ok
    )
    w = Window.partitionBy("request_id").orderBy(F.col("sponsor_priority").desc(), "position", F.lower("title"))
    return rows.select(
        "request_id", "id", F.col("sponsor_campaign_id").alias("campaign_id"), F.col("sponsor_company").alias("company"),
        F.col("sponsor_priority").alias("priority"), F.row_number().over(w).alias("slot"),
    )
