"""Search, ranking and showtime queries."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from playbill.functions import dates, geo, labels, scoring, showtimes
from playbill.functions.scoring import SearchRequest
from playbill.operators import catalogue, ranking, relaxation
from playbill.plans.registry import query
from playbill.plans.td import CITIES, NOW, TODAY, table, with_td, listings
from playbill.session import cut

REQUESTS = [
    SearchRequest("near_orebro", TODAY, NOW, "Örebro", "next_30_days", 200),
    SearchRequest("weekend_stockholm", TODAY, NOW, "Stockholm", "weekend", 300),
    SearchRequest("cheap_goteborg", TODAY, NOW, "Göteborg", "next_3_months", 200, "max_250"),
    SearchRequest("free_anywhere", TODAY, NOW, None, "next_7_days", None, "free"),
    SearchRequest("query_title", TODAY, NOW, None, "next_3_months", None, "any", "Blue ANVIL"),
    SearchRequest("query_place", TODAY, NOW, "Malmö", "next_3_months", 300, "any", "malmo"),
    SearchRequest("urgent_only", TODAY, NOW, "Uppsala", "next_30_days", 200, type_filter="1-URGENT"),
    SearchRequest("today_anywhere", TODAY, NOW, None, "today", None),
    SearchRequest("far_ahead", TODAY, NOW, "Oslo", "any", 100, "max_500"),
    SearchRequest("unknown_origin", TODAY, NOW, "Atlantis", "next_30_days", 100),
]
NO_HITS = [
    SearchRequest("tiny_radius", TODAY, NOW, "Oslo", "today", 25),
    SearchRequest("cheap_today", TODAY, NOW, "Karlskoga", "today", 25, "max_100"),
    SearchRequest("no_such_word", TODAY, NOW, "Örebro", "next_7_days", 50, "any", "zzzz"),
    SearchRequest("has_hits", TODAY, NOW, "Örebro", "next_30_days", 200),
    SearchRequest("typed", TODAY, NOW, "Malmö", "weekend", 25, "free", type_filter="5-LOW"),
    SearchRequest("query_near", TODAY, NOW, "Nora", "today", 25, "any", "green widget"),
]

_COORD_ROWS = ", ".join(f"('{c}', {lat}, {lon})" for c, (lat, lon) in __import__("playbill.vocab", fromlist=["CITY_COORDS"]).CITY_COORDS.items())
GEO_SQL = f"""coords(name, clat, clon) AS (VALUES {_COORD_ROWS}),
geo AS (SELECT td.*, coalesce(latitude, venue_latitude, CAST(clat AS DOUBLE)) AS lat, coalesce(longitude, venue_longitude, CAST(clon AS DOUBLE)) AS lon,
  CASE WHEN latitude IS NOT NULL THEN 'exact' WHEN venue_latitude IS NOT NULL THEN 'venue' WHEN clat IS NOT NULL THEN 'city' ELSE 'unknown' END AS confidence
  FROM td LEFT JOIN coords ON td.city = coords.name)"""


def km_sql(lat, lon, to_lat="lat", to_lon="lon"):
    a = f"(pow(sin(radians({to_lat} - {lat}) / 2), 2) + cos(radians({lat})) * cos(radians({to_lat})) * pow(sin(radians({to_lon} - {lon}) / 2), 2))"
    return f"CAST(round_even(2 * 6371.0::DOUBLE * atan2(sqrt{a}, sqrt(1 - {a})), 0) AS INTEGER)"


def _req_rows(requests):
    rows = []
    for r in requests:
        lo, hi = dates.window_of(r.when, r.today)
        point = geo.known_origin(r.origin_city)
        limit = {"any": "NULL", "free": "0", "max_100": "100", "max_250": "250", "max_500": "500"}[r.price]
        cells = [f"'{r.request_id}'", "true" if r.origin_city else "false", str(point[0]) if point else "NULL", str(point[1]) if point else "NULL", f"DATE '{lo}'", f"DATE '{hi}'",
                 str(r.radius_km) if r.radius_km is not None else "NULL", limit, f"'{scoring.search_text_py(r.query)}'", f"'{r.type_filter}'" if r.type_filter else "NULL"]
        rows.append("(" + ", ".join(cells) + ")")
    return ", ".join(rows)


def norm_sql(c):
    return f"trim(regexp_replace(lower(strip_accents({c})), '[^a-z0-9]+', ' ', 'g'))"


VISIBLE_SQL = "NOT is_demo AND title <> '' AND greatest(start_d, coalesce(end_d, start_d)) >= DATE '1998-06-01' AND NOT (excludes_start AND end_d IS NULL)"
def search_sql(requests, req=None):
    """Matching listings of each request with their scores, as the CTE `ranked`; `req` is SQL for the rows of a request table."""
    req = req or f"VALUES {_req_rows(requests)}"
    return f"""{GEO_SQL},
vis AS (SELECT *, {norm_sql('title')} AS nt, {norm_sql('venue')} AS nv, {norm_sql('city')} AS nc, {norm_sql("event_type || ' ' || category || ' ' || array_to_string(tags, ' ')")} AS nx, {norm_sql('description')} AS nd,
  {norm_sql("title || ' ' || event_type || ' ' || category || ' ' || venue || ' ' || city || '  ' || description || ' ' || array_to_string(tags, ' ')")} AS na,
  greatest(start_d, coalesce(end_d, start_d)) AS last_d, CASE WHEN price_status = 'known' AND currency = 'SEK' AND price_min >= 0 THEN price_min END AS sek
  FROM geo WHERE {VISIBLE_SQL}),
req(request_id, has_origin, olat, olon, lo, hi, radius, price_limit, q, tf) AS ({req}),
m AS (SELECT vis.*, req.*, {km_sql('CAST(olat AS DOUBLE)', 'CAST(olon AS DOUBLE)')} AS km, greatest(start_d, lo) AS a, least(last_d, hi) AS b, start_d - DATE '1998-06-01' AS days FROM vis, req),
hit AS (SELECT * FROM m WHERE a <= b AND (b - a + 1) > (CASE WHEN excludes_start AND start_d BETWEEN a AND b THEN 1 ELSE 0 END)
  AND (tf IS NULL OR event_type = tf) AND (price_limit IS NULL OR price_status = 'free' OR (price_limit > 0 AND sek <= price_limit))
  AND (NOT has_origin OR coalesce(km <= radius, false)) AND (q = '' OR contains(na, q))),
scored AS (SELECT *, CAST(CASE WHEN q = '' THEN 0 WHEN contains(nt, q) THEN 26 WHEN contains(nv, q) OR contains(nc, q) THEN 16 WHEN contains(nx, q) THEN 13 WHEN contains(nd, q) THEN 5 ELSE 0 END
  + CASE WHEN km IS NULL THEN 0 WHEN km <= 10 THEN 30 WHEN km <= 25 THEN 25 WHEN km <= 50 THEN 20 WHEN km <= 100 THEN 12 WHEN km <= 200 THEN 6 ELSE 2 END
  + CASE WHEN days < 0 THEN -100 WHEN days = 0 THEN 30 WHEN days <= 2 THEN 25 WHEN days <= 7 THEN 20 WHEN days <= 14 THEN 15 WHEN days <= 30 THEN 10 ELSE 4 END
  + CASE WHEN price_status = 'free' THEN 14 WHEN sek IS NULL THEN 0 WHEN price_limit > 0 THEN CASE WHEN sek <= price_limit * 0.5 THEN 10 ELSE 5 END ELSE 2 END
  + CASE WHEN source_count >= 2 THEN 5 ELSE 0 END AS INTEGER) AS score0 FROM hit),
ranked AS (SELECT *, CASE WHEN venue = '' AND city = '' THEN least(score0, 18) ELSE score0 END AS score FROM scored)"""


SEARCH_SQL = search_sql(REQUESTS)


def diversified_sql(k):
    """The first k of `ranked` for each request, the first ten picked one by one among near ties, as the CTE `shown`."""
    return f"""pool AS (SELECT *, lower(title) AS lt, row_number() OVER (PARTITION BY request_id ORDER BY score DESC, start_date, lower(title), ingest_ord) AS rn, count(*) OVER (PARTITION BY request_id) AS n_all FROM ranked),
step(request_id, n, chosen, kinds, venues, days) AS (
  SELECT DISTINCT request_id, 0, CAST([] AS BIGINT[]), CAST([] AS VARCHAR[]), CAST([] AS VARCHAR[]), CAST([] AS VARCHAR[]) FROM pool WHERE n_all >= 3
  UNION ALL
  SELECT request_id, n + 1, list_append(chosen, rn), list_append(kinds, event_type), list_append(venues, venue), list_append(days, start_date) FROM (
    SELECT *, score - least(6, 3 * len(list_filter(kinds[-3:], lambda x: x = event_type))) - least(4, 4 * len(list_filter(venues[-2:], lambda x: x = venue AND x <> ''))) - least(2, 2 * len(list_filter(days[-2:], lambda x: x = start_date))) AS worth
    FROM (SELECT s.*, p.rn, p.score, p.event_type, p.venue, p.start_date, max(p.score) OVER (PARTITION BY s.request_id) AS best
          FROM step s JOIN pool p ON p.request_id = s.request_id AND NOT list_contains(s.chosen, p.rn) WHERE s.n < 10) x
    WHERE score >= best - 8) y
  QUALIFY row_number() OVER (PARTITION BY request_id ORDER BY worth DESC, rn) = 1),
picked AS (SELECT request_id, arg_max(chosen, n) AS chosen FROM step GROUP BY request_id),
placed AS (SELECT p.*, CASE WHEN list_contains(c.chosen, p.rn) THEN list_position(c.chosen, p.rn) ELSE 100000 + p.rn END AS place FROM pool p LEFT JOIN picked c USING (request_id)),
shown AS (SELECT *, CAST(row_number() OVER (PARTITION BY request_id ORDER BY place) AS INTEGER) AS position FROM placed QUALIFY row_number() OVER (PARTITION BY request_id ORDER BY place) <= {k})"""



def _visible(spark, sf):
    return ranking.visible(listings(spark, sf, with_last=True), TODAY)


@query("ranked_search", with_td(f"""{SEARCH_SQL}
SELECT request_id, id, score, CAST(km AS INTEGER) AS distance_km, CAST(row_number() OVER w AS INTEGER) AS position FROM ranked
WINDOW w AS (PARTITION BY request_id ORDER BY score DESC, start_date, lower(title), ingest_ord) QUALIFY row_number() OVER w <= 50"""))
def ranked_search(spark, sf):
    top = ranking.rank_top(ranking.score_requests(_visible(spark, sf), REQUESTS), 50)
    return top.select("request_id", "id", "score", "distance_km", "position")


@query("search_matches", with_td(f"{SEARCH_SQL} SELECT request_id, count(*) AS hits, CAST(sum(score) AS BIGINT) AS score_sum FROM ranked GROUP BY request_id"))
def search_matches(spark, sf):
    return ranking.score_requests(_visible(spark, sf), REQUESTS).groupBy("request_id").agg(F.count("*").alias("hits"), F.sum("score").alias("score_sum"))


@query("diversified_search", with_td(f"{SEARCH_SQL}, {diversified_sql(ranking.PAGE)} SELECT request_id, id, score, position FROM shown").replace("WITH ", "WITH RECURSIVE ", 1))
def diversified_search(spark, sf):
    out = ranking.diversify(ranking.score_requests(_visible(spark, sf), REQUESTS), ranking.PAGE)
    return out.select("request_id", "id", "score", "position")


def _relax_rows():
    rows = []
    for r in NO_HITS:
        for s in relaxation.scenarios(r):
            q = s.request
            lo, hi = dates.window_of(q.when, q.today)
            point = geo.known_origin(q.origin_city)
            limit = {"any": "NULL", "free": "0", "max_100": "100", "max_250": "250", "max_500": "500"}[q.price]
            rows.append(f"('{r.request_id}', '{s.kind}', {s.step}, {point[0]}, {point[1]}, DATE '{lo}', DATE '{hi}', {q.radius_km}, {limit}, '{scoring.search_text_py(q.query)}', {repr(q.type_filter) if q.type_filter else 'NULL'})")
    return ", ".join(rows)


@query("zero_hit_relaxation", with_td(f"""{SEARCH_SQL},
sc(rid, kind, step, xlat, xlon, xlo, xhi, xr, xp, xq, xt) AS (VALUES {_relax_rows()}),
sm AS (SELECT *, {km_sql('CAST(xlat AS DOUBLE)', 'CAST(xlon AS DOUBLE)')} AS xkm, greatest(start_d, xlo) AS xa, least(last_d, xhi) AS xb FROM vis, sc),
sh AS (SELECT rid, kind, step FROM sm WHERE xa <= xb AND (xb - xa + 1) > (CASE WHEN excludes_start AND start_d BETWEEN xa AND xb THEN 1 ELSE 0 END) AND (xt IS NULL OR event_type = xt)
  AND (xp IS NULL OR price_status = 'free' OR (xp > 0 AND sek <= xp)) AND coalesce(xkm <= xr, false) AND (xq = '' OR contains(na, xq))),
n AS (SELECT rid, kind, step, count(*) AS hits FROM sh GROUP BY ALL),
live AS (SELECT * FROM n WHERE kind <> 'base' AND rid NOT IN (SELECT rid FROM n WHERE kind = 'base')),
f AS (SELECT * FROM live QUALIFY row_number() OVER (PARTITION BY rid, kind ORDER BY step) = 1),
o AS (SELECT *, row_number() OVER (PARTITION BY rid ORDER BY CASE kind WHEN 'time' THEN 1 WHEN 'radius' THEN 2 WHEN 'price' THEN 3 WHEN 'new' THEN 4 ELSE 5 END) AS s FROM f)
SELECT rid AS request_id, kind, CAST(step AS INTEGER) AS step, hits, CAST(s AS INTEGER) AS suggestion FROM o WHERE CASE WHEN kind = 'time_radius' THEN s = 1 ELSE s <= 3 END"""))
def zero_hit_relaxation(spark, sf):
    return relaxation.choose(relaxation.scenario_hits(_visible(spark, sf), NO_HITS))


# A request that finds nothing, with a step of each kind that does.
SUGGESTED = [
    *NO_HITS,
    SearchRequest("all_kinds", TODAY, NOW, "Oslo", "today", 25, "free"), SearchRequest("weekend_near", TODAY, NOW, "Karlskoga", "weekend", 25, "max_100"),
    SearchRequest("title_today", TODAY, NOW, "Göteborg", "today", 25, "any", "gear"), SearchRequest("soon_far", TODAY, NOW, "Nora", "today", 50, "max_100"),
    SearchRequest("typed_today", TODAY, NOW, "Malmö", "today", 25, "any", type_filter="5-LOW"),
]
_SCENARIOS = [s.request for r in SUGGESTED for s in relaxation.scenarios(r)]
SUGGESTION_SQL = f"""{search_sql(_SCENARIOS)},
counted AS (SELECT string_split(request_id, '|') AS parts, request_id AS scenario, count(*) AS hits FROM ranked GROUP BY request_id),
kinds AS (SELECT parts[1] AS rid, parts[2] AS kind, CAST(parts[3] AS INTEGER) AS step, scenario FROM counted),
live AS (SELECT * FROM kinds WHERE kind <> 'base' AND rid NOT IN (SELECT rid FROM kinds WHERE kind = 'base')),
firsts AS (SELECT * FROM live QUALIFY row_number() OVER (PARTITION BY rid, kind ORDER BY step) = 1),
numbered AS (SELECT *, CAST(row_number() OVER (PARTITION BY rid ORDER BY CASE kind WHEN 'time' THEN 1 WHEN 'radius' THEN 2 WHEN 'price' THEN 3 WHEN 'new' THEN 4 ELSE 5 END) AS INTEGER) AS suggestion FROM firsts),
offered AS (SELECT * FROM numbered WHERE CASE WHEN kind = 'time_radius' THEN suggestion = 1 ELSE suggestion <= 3 END),
{diversified_sql(ranking.PAGE)},
cards AS (SELECT rid, kind, step, suggestion, id, score, position, CASE WHEN city <> '' AND venue <> '' AND venue <> city THEN lower(title || '|' || city || '|' || venue) ELSE id END AS card FROM shown JOIN offered ON scenario = request_id),
c1 AS (SELECT *, row_number() OVER (PARTITION BY rid ORDER BY position) AS slot FROM (SELECT * FROM cards WHERE suggestion = 1 QUALIFY row_number() OVER (PARTITION BY rid, card ORDER BY position) = 1) QUALIFY row_number() OVER (PARTITION BY rid ORDER BY position) <= 3),
c2 AS (SELECT *, row_number() OVER (PARTITION BY rid ORDER BY position) AS slot FROM (SELECT * FROM cards k WHERE suggestion = 2 AND NOT EXISTS (SELECT 1 FROM c1 WHERE c1.rid = k.rid AND c1.card = k.card) QUALIFY row_number() OVER (PARTITION BY rid, card ORDER BY position) = 1) QUALIFY row_number() OVER (PARTITION BY rid ORDER BY position) <= 3),
c3 AS (SELECT *, row_number() OVER (PARTITION BY rid ORDER BY position) AS slot FROM (SELECT * FROM cards k WHERE suggestion = 3 AND NOT EXISTS (SELECT 1 FROM c1 WHERE c1.rid = k.rid AND c1.card = k.card) AND NOT EXISTS (SELECT 1 FROM c2 WHERE c2.rid = k.rid AND c2.card = k.card)
  QUALIFY row_number() OVER (PARTITION BY rid, card ORDER BY position) = 1) QUALIFY row_number() OVER (PARTITION BY rid ORDER BY position) <= 3)
SELECT rid AS request_id, kind, step, suggestion, id, score, CAST(slot AS INTEGER) AS position FROM (SELECT * FROM c1 UNION ALL SELECT * FROM c2 UNION ALL SELECT * FROM c3)"""


@query("relaxed_suggestions", with_td(SUGGESTION_SQL).replace("WITH ", "WITH RECURSIVE ", 1))
def relaxed_suggestions(spark, sf):
    out = relaxation.suggest(_visible(spark, sf), SUGGESTED)
    return out.select("request_id", "kind", "step", "suggestion", "id", "score", "position")


_WHENS, _RADII, _PRICES = ["today", "weekend", "next_7_days", "next_30_days"], [25, 100, 300], ["any", "free", "max_250"]
_WINDOWS = [dates.window_of(w, TODAY) for w in _WHENS]
_CUSTOMER_SQL = f"""SELECT 'c' || c_custkey, c_nationkey < 20, clat, clon, [{', '.join(f"DATE '{lo}'" for lo, _ in _WINDOWS)}][c_custkey % 4 + 1], [{', '.join(f"DATE '{hi}'" for _, hi in _WINDOWS)}][c_custkey % 4 + 1],
  {_RADII}[c_custkey % 3 + 1], CASE (c_custkey // 3) % 3 WHEN 1 THEN 0 WHEN 2 THEN 250 END, CASE WHEN c_custkey % 5 = 0 THEN 'gear' ELSE '' END, CASE WHEN c_custkey % 7 = 0 THEN '5-LOW' END
  FROM customer LEFT JOIN coords ON c_nationkey < 20 AND name = ([{', '.join(f"'{c}'" for c in CITIES)}])[least(c_nationkey + 1, 20)]"""


@query("request_table_search", with_td(f"{search_sql((), _CUSTOMER_SQL)} SELECT request_id, count(*) AS hits, max(score) AS best, CAST(sum(score) AS BIGINT) AS score_sum, CAST(sum(km) AS BIGINT) AS km_sum FROM ranked GROUP BY request_id"))
def request_table_search(spark, sf):
    """Every customer is a request, all of them in one join; those who ask the same are answered together."""
    from playbill.operators import request_join

    k, n = F.col("c_custkey"), F.col("c_nationkey")
    pick = lambda values, i: F.element_at(F.array(*[F.lit(v) for v in values]), (i + 1).cast("int"))
    requests = table(spark, sf, "customer").select(
        F.concat(F.lit("c"), k.cast("string")).alias("request_id"), F.lit(TODAY).alias("today"), F.when(n < 20, pick(CITIES, F.least(n, F.lit(19)))).alias("origin_city"), pick(_WHENS, k % 4).alias("when"), pick(_RADII, k % 3).alias("radius_km"),
        pick(_PRICES, F.floor(k / 3) % 3).alias("price"), F.when(k % 5 == 0, "Gear").otherwise("").alias("query"), F.when(k % 7 == 0, "5-LOW").alias("type_filter"), F.lit(False).alias("only_new"), F.array().cast("array<string>").alias("interests"),
    )
    asked, who = request_join.shared(requests)
    found = request_join.scored(_visible(spark, sf), cut(asked))
    found = found.groupBy(F.col("request_id").alias("asked_id")).agg(F.count("*").alias("hits"), F.max("score").alias("best"), F.sum("score").alias("score_sum"), F.sum("distance_km").alias("km_sum"))
    return who.join(found, "asked_id").groupBy("request_id").agg(F.sum("hits").alias("hits"), F.max("best").alias("best"), F.sum("score_sum").alias("score_sum"), F.sum("km_sum").alias("km_sum"))


@query("text_search", with_td(f"SELECT id FROM td WHERE contains({norm_sql('title')} || '|' || {norm_sql('city')}, 'orebro') OR contains({norm_sql('title')}, 'blue')"))
def text_search(spark, sf):
    df = scoring.with_search_columns(listings(spark, sf))
    return df.filter(F.contains(F.concat_ws("|", "s_title", "s_place_c"), F.lit("orebro")) | F.contains("s_title", F.lit("blue"))).select("id")


def _period_sql(lo, hi):
    return f"""p AS (SELECT id, greatest(start_d, DATE '{lo}') AS a, least(coalesce(end_d, start_d), DATE '{hi}') AS b, excludes_start, start_d FROM td)
SELECT id FROM p WHERE a <= b AND (b - a + 1) > (CASE WHEN excludes_start AND start_d BETWEEN a AND b THEN 1 ELSE 0 END)"""


@query("period_filter", with_td(_period_sql("1998-06-01", "1998-06-08")))
def period_filter(spark, sf):
    return listings(spark, sf).filter(dates.period_matches("start_date", "end_date", "excluded_dates", "next_7_days", TODAY)).select("id")


@query("weekend_filter", with_td(_period_sql("1998-06-06", "1998-06-07")))
def weekend_filter(spark, sf):
    return ranking.this_weekend(listings(spark, sf), TODAY).select("id")


@query("price_filter", with_td("SELECT id, price_status FROM td WHERE price_status = 'free' OR (price_status = 'known' AND currency = 'SEK' AND price_min >= 0 AND price_min <= 250)"))
def price_filter(spark, sf):
    return listings(spark, sf).filter(scoring.price_matches("max_250")).select("id", "price_status")


_SEEN = "SELECT CAST(user_id AS VARCHAR) AS event_id, min(ts) AS first_seen_at FROM events GROUP BY user_id"


@query("new_only", with_td(f"seen AS ({_SEEN}) SELECT id FROM td JOIN seen ON id = event_id WHERE first_seen_at >= TIMESTAMP '2024-01-01 12:00:00' AND NOT is_demo"))
def new_only(spark, sf):
    seen = table(spark, sf, "events").groupBy(F.col("user_id").cast("string").alias("id")).agg(F.min("ts").alias("first_seen_at"))
    df = listings(spark, sf).join(seen, "id", "left")
    return df.filter(ranking.is_new(F.col("first_seen_at"), dt.datetime(2024, 1, 8, 12))).select("id")


@query("geo_distance", with_td(f"{GEO_SQL} SELECT id, confidence, round(lat, 6) AS lat, {km_sql(59.2753, 15.2134)} AS distance_km FROM geo"))
def geo_distance(spark, sf):
    df = ranking.with_location(listings(spark, sf))
    return df.select("id", F.col("loc.confidence").alias("confidence"), F.round("loc.lat", 6).alias("lat"), geo.distance_km(F.col("loc.lat"), F.col("loc.lon"), "Örebro").alias("distance_km"))


_SHOW = """t AS (SELECT *, (start_d - DATE '1998-06-01') * 1440 + start_min - 990 AS mins, (start_d - DATE '1998-06-01') AS dd,
  (coalesce(end_d, start_d) - DATE '1998-06-01' + CASE WHEN coalesce(end_d, start_d) = start_d AND end_min < start_min THEN 1 ELSE 0 END) * 1440 + end_min - 990 AS end_in FROM td)"""


@query("showtime_status", with_td(f"""{_SHOW} SELECT id, CASE WHEN start_min IS NULL THEN CASE WHEN dd = 1 THEN 'tomorrow' END WHEN coalesce(mins <= 0 AND end_in >= 0, false) THEN 'now'
  WHEN dd = 0 AND mins BETWEEN 0 AND 90 THEN 'soon' WHEN dd = 0 AND mins > 90 AND start_min >= 1020 THEN 'tonight' WHEN dd = 0 AND mins > 90 THEN 'later_today' WHEN dd = 0 THEN 'started'
  WHEN dd = 1 THEN 'tomorrow' END AS status FROM t"""))
def showtime_status(spark, sf):
    return listings(spark, sf).select("id", showtimes.status(NOW).alias("status"))


@query("last_minute", with_td(f"{_SHOW} SELECT id, CAST(mins AS INTEGER) AS minutes, CASE WHEN mins < 60 THEN 'in ' || mins || ' min' WHEN mins % 60 = 0 THEN 'in ' || mins // 60 || ' h' ELSE 'in ' || mins // 60 || ' h ' || mins % 60 || ' min' END AS label FROM t WHERE mins BETWEEN 30 AND 180"))
def last_minute(spark, sf):
    df = listings(spark, sf).withColumn("lm", showtimes.last_minute(NOW)).filter(F.col("lm").isNotNull())
    return df.select("id", F.col("lm.minutes").alias("minutes"), F.col("lm.label").alias("label"))


@query("go_now", with_td(f"""{_SHOW}, {GEO_SQL.replace('FROM td', 'FROM t').replace('td.', 't.')}, k AS (SELECT *, {km_sql(59.2753, 15.2134)} AS km FROM geo WHERE mins BETWEEN 45 AND 240)
SELECT id, CASE WHEN km <= 10 THEN 'near' WHEN km <= 25 AND mins >= 75 THEN 'fairly_near' WHEN km <= 50 AND mins >= 120 THEN 'further_away' END AS band FROM k WHERE km <= 10 OR (km <= 25 AND mins >= 75) OR (km <= 50 AND mins >= 120)"""))
def go_now(spark, sf):
    df = ranking.with_location(listings(spark, sf))
    df = df.withColumn("band", showtimes.go_now_band(NOW, geo.distance_km(F.col("loc.lat"), F.col("loc.lon"), "Örebro")))
    return df.filter(F.col("band").isNotNull()).select("id", "band")


@query("evening", with_td(f"{_SHOW} SELECT id FROM t WHERE dd = 0 AND start_min >= 1020 AND mins >= 0"))
def evening(spark, sf):
    return listings(spark, sf).filter(showtimes.evening_match(NOW)).select("id")


_IMP = "(CASE WHEN source_count > 1 THEN least(10, 4 + 2 * source_count) ELSE 0 END)"


@query("importance_topk", with_td(f"""SELECT id, CAST({_IMP} + CASE WHEN event_type = '1-URGENT' THEN 20 ELSE 0 END - CASE WHEN is_demo THEN 30 ELSE 0 END AS INTEGER) AS score FROM td
WHERE {_IMP} + CASE WHEN event_type = '1-URGENT' THEN 20 ELSE 0 END - CASE WHEN is_demo THEN 30 ELSE 0 END > 0 ORDER BY 2 DESC, start_date, ingest_ord LIMIT 12"""))
def importance_topk(spark, sf):
    return ranking.recommended(listings(spark, sf), ["1-urgent"]).select("id", "score")


@query("worth_a_trip", with_td(f"""{GEO_SQL}, k AS (SELECT *, {km_sql(59.2753, 15.2134)} AS km, start_d - DATE '1998-06-01' AS days FROM geo),
s AS (SELECT *, {_IMP} + CASE WHEN km < 80 THEN -8 WHEN km <= 250 THEN 12 WHEN km <= 550 THEN 8 WHEN km > 700 THEN -10 ELSE 0 END + CASE WHEN days BETWEEN 10 AND 120 THEN 8 WHEN days > 365 THEN -4 ELSE 0 END - CASE WHEN is_demo THEN 40 ELSE 0 END AS sc FROM k)
SELECT id, CAST(sc AS INTEGER) AS score, km AS distance_km FROM s WHERE km >= 80 AND sc > 8 ORDER BY sc DESC, start_date, ingest_ord LIMIT 8"""))
def worth_a_trip(spark, sf):
    return ranking.worth_a_trip(listings(spark, sf), "Örebro", [], TODAY).select("id", "score", "distance_km")


@query("fairs_topk", with_td(f"SELECT id, CAST({_IMP} - CASE WHEN is_demo THEN 30 ELSE 0 END AS INTEGER) AS score FROM td WHERE event_type = '5-LOW' ORDER BY 2 DESC, start_date, ingest_ord LIMIT 10"))
def fairs_topk(spark, sf):
    return ranking.big_fairs(listings(spark, sf), fair_type="5-LOW").select("id", "score")


@query("sponsored", with_td(f"""{SEARCH_SQL},
r AS (SELECT *, row_number() OVER (PARTITION BY request_id ORDER BY score DESC, start_date, lower(title), ingest_ord) AS pos FROM ranked),
e AS (SELECT *, max(score) OVER (PARTITION BY request_id) AS best FROM r WHERE pos <= 400)
SELECT request_id, id, sponsor_campaign_id AS campaign_id, sponsor_company AS company, sponsor_priority AS priority FROM e
WHERE is_sponsored AND sponsor_campaign_id IS NOT NULL AND sponsor_company IS NOT NULL AND score >= best - 40"""))
def sponsored(spark, sf):
    keep = [c for c in listings(spark, sf).columns if c.startswith(("sponsor", "is_spons"))]
    ranked = ranking.rank_top(ranking.score_requests(_visible(spark, sf), REQUESTS, keep=keep), 400)
    return ranking.sponsored(ranked, TODAY, "Örebro", [], max_rank=400, gap=40).drop("slot")


@query("shortlists", with_td(f"""{SEARCH_SQL}, r AS (SELECT *, row_number() OVER (PARTITION BY request_id ORDER BY score DESC, start_date, lower(title), ingest_ord) AS pos FROM ranked)
SELECT request_id, id, CAST(row_number() OVER (PARTITION BY request_id ORDER BY pos) AS INTEGER) AS pick FROM r WHERE pos <= 50 AND price_status = 'free' QUALIFY row_number() OVER (PARTITION BY request_id ORDER BY pos) <= 3"""))
def shortlists(spark, sf):
    top = ranking.rank_top(ranking.score_requests(_visible(spark, sf), REQUESTS, keep=["price_status"]), 50)
    return ranking.shortlist(top, F.col("price_status") == "free").select("request_id", "id", "pick")


@query("result_pages", with_td(f"{SEARCH_SQL}, n AS (SELECT request_id, count(*) AS total FROM ranked GROUP BY request_id) SELECT request_id, total, least(total, 12) AS visible, least(total, 24) AS next_limit, greatest(total - 12, 0) AS remaining FROM n"))
def result_pages(spark, sf):
    counts = ranking.score_requests(_visible(spark, sf), REQUESTS).groupBy("request_id").agg(F.count("*").alias("total"))
    return ranking.page_state(counts, ranking.PAGE)


@query("labels", with_td("""SELECT id, CASE WHEN price_status = 'free' THEN 'Gratis' WHEN price_status = 'unknown' OR price_min IS NULL THEN 'Pris saknas' ELSE 'Från ' || CAST(CAST(price_min AS BIGINT) AS VARCHAR) || CASE WHEN currency = 'SEK' THEN ' kr' ELSE ' EUR' END END AS price,
  CASE WHEN venue <> '' AND city <> '' AND lower(venue) <> lower(city) THEN venue || ', ' || city WHEN venue <> '' THEN venue WHEN city <> '' THEN city ELSE 'Plats ej angiven' END AS place,
  CASE WHEN start_d < DATE '1998-06-01' AND end_d >= DATE '1998-06-01' THEN 'Pågår till ' || ['mån','tis','ons','tors','fre','lör','sön'][isodow(end_d)] || ' ' || day(end_d) || ' ' || ['jan','feb','mar','apr','maj','jun','jul','aug','sep','okt','nov','dec'][month(end_d)]
  ELSE CASE start_d - DATE '1998-06-01' WHEN 0 THEN 'Idag' WHEN 1 THEN 'Imorgon' ELSE ['mån','tis','ons','tors','fre','lör','sön'][isodow(start_d)] || ' ' || day(start_d) || ' ' || ['jan','feb','mar','apr','maj','jun','jul','aug','sep','okt','nov','dec'][month(start_d)] END
    || coalesce(' · ' || start_time, '') || coalesce('–' || printf('%02d:%02d', end_min // 60, end_min % 60), '') END AS date FROM td"""))
def label_texts(spark, sf):
    return listings(spark, sf).select("id", labels.price_label().alias("price"), labels.place_label().alias("place"), labels.date_label(TODAY).alias("date"))


def _top(spark, sf):
    keep = ["category", "city", "start_time", "official_url", "ticket_url", "source_names"]
    return ranking.rank_top(ranking.score_requests(_visible(spark, sf), REQUESTS, keep=keep), 10)


@query("near_duplicates")
def near_duplicates(spark, sf):
    return catalogue.near_duplicates(_top(spark, sf)).withColumn("similarity", F.round("similarity", 6))


@query("top_quality", with_td(f"""{SEARCH_SQL}, r AS (SELECT *, row_number() OVER (PARTITION BY request_id ORDER BY score DESC, start_date, lower(title), ingest_ord) AS pos FROM ranked)
SELECT request_id, id, concat_ws(',', CASE WHEN venue = '' AND city = '' THEN 'place_missing' END, CASE WHEN venue = '' AND city <> '' THEN 'venue_missing' END,
  CASE WHEN start_min IS NULL AND venue = '' THEN 'time_and_venue_missing' END, CASE WHEN official_url IS NULL AND ticket_url IS NULL THEN 'no_link' END) AS issues FROM r WHERE pos <= 10"""))
def top_quality(spark, sf):
    return catalogue.top_quality(_top(spark, sf)).select("request_id", "id", F.array_join("metadata_issues", ",").alias("issues"))
