"""Requests as a table: any number of searches in one plan of constant size.

Listings and requests meet by an equality join on a period bucket and a cell of the map, and are
then tested exactly.  A listing lies in one bucket of the class of its length, so that it spans two
buckets at most, and in one cell; it also stands under "*" for requests without an end or without a
place.  A request asks the buckets of every class that its days can touch, and the cells that its
circle can touch.  So a pair meets once at most, and what does not meet is neither near nor then.

The exact tests and the scores are those of `ranking.score_requests`, with columns of the request in
place of constants.  Presets look at the clock and stay with the constant form.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from playbill import vocab
from playbill.functions import geo, scoring
from playbill.functions.dates import FAR
from playbill.functions.scoring import SearchRequest
from playbill.functions.text import codes, search_text, search_text_py
from playbill.operators import ranking, relaxation
from playbill.session import cut

REQUESTS = "request_id string, today date, origin_city string, when string, radius_km int, price string, query string, type_filter string, only_new boolean, interests array<string>"
DAYS = 32  # days of the smallest buckets; each class has buckets twice as long as the one before
CLASSES = 14
OPEN_END = 400  # a request for more days than this asks all listings of its cells
CELL_LAT, CELL_LON = 2.0, 4.0
KM_PER_DEGREE = 111.0
CELLS = 64  # a circle that touches more cells than this asks "*" and leaves the rest to the exact test
SHARES = 16  # tasks among which the listings under an open key are dealt


def request_table(spark: SparkSession, requests: list[SearchRequest]) -> DataFrame:
    """The table form of requests that are at hand as constants."""
    rows = [(r.request_id, r.today, r.origin_city, r.when, r.radius_km, r.price, r.query, r.type_filter, r.only_new, list(r.interests)) for r in requests]
    return spark.createDataFrame(rows, REQUESTS)


def shared(requests: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Requests that ask the same once, under an id of what they ask, and (request_id, asked_id) of all requests.

    Results grouped by request can so be worked out once for all who ask the same, however many they are.
    """
    asks = [c.split()[0] for c in REQUESTS.split(", ")][1:]
    named = requests.select("request_id", F.to_json(F.struct(*asks)).alias("asked_id"), *asks)
    return named.select(F.col("asked_id").alias("request_id"), *asks).distinct(), named.select("request_id", "asked_id")


def resolve(requests: DataFrame) -> DataFrame:
    """Adds the window (lo, hi), the origin's place, the price limit and the normalised query."""
    today = F.col("today")
    saturday = F.date_add(today, 5 - F.weekday(today))
    days = F.create_map(*[F.lit(x) for k, v in vocab.PRESET_DAYS.items() if v is not None for x in (k, v)])
    limits = F.create_map(*[F.lit(x) for k, v in vocab.PRICE_LIMITS.items() if v is not None for x in (k, float(v))])
    place = geo.resolve_location(F.lit(None).cast("double"), F.lit(None).cast("double"), F.lit(None).cast("double"), F.lit(None).cast("double"), "origin_city")
    weekend, known = F.col("when") == "weekend", F.try_element_at(days, F.col("when"))
    return requests.withColumns({
        "lo": F.when(weekend, F.greatest(today, saturday)).otherwise(today),
        "hi": F.when(weekend, F.date_add(saturday, 1)).when(known.isNotNull(), F.date_add(today, known)).otherwise(F.lit(FAR)),
        "has_origin": F.coalesce(F.col("origin_city"), F.lit("")) != "", "_place": place, "price_limit": F.try_element_at(limits, F.col("price")), "q": search_text("query"),
    }).withColumns({"olat": F.col("_place.lat"), "olon": F.col("_place.lon")}).drop("_place")


def _bucket(day: Column, size: Column) -> Column:
    return F.floor(F.datediff(day, F.lit("1970-01-01").cast("date")) / size).cast("bigint")


def _key(kind: Column, number: Column) -> Column:
    return F.concat(kind.cast("string"), F.lit(":"), number.cast("string"))


def _kind() -> Column:
    """The class of a prepared listing by its length; `CLASSES` for those above all classes."""
    span = F.datediff("_d1", "_d0")
    kind = F.least(F.greatest(F.ceil(F.log2(F.greatest(span, F.lit(1)) / DAYS)), F.lit(0)), F.lit(CLASSES - 1)).cast("int")
    return F.when(span > DAYS * 2 ** (CLASSES - 1), CLASSES).otherwise(kind)


def listing_keys(prepared: DataFrame) -> DataFrame:
    """Prepared listings with one row for each (period, cell, share) they stand under: their own and the open ones."""
    kind = _kind()
    own = F.when(kind == CLASSES, F.lit("long")).otherwise(_key(kind, _bucket(F.col("_d0"), F.lit(DAYS) * F.call_function("shiftleft", F.lit(1), kind))))
    cell = _key(F.floor((F.col("loc.lat") + 90) / CELL_LAT), F.pmod(F.floor((F.col("loc.lon") + 180) / CELL_LON), F.lit(int(360 / CELL_LON))))
    periods, cells = F.array(own, F.lit("*")), F.array_compact(F.array(cell, F.lit("*")))
    out = prepared.filter(F.col("_d0").isNotNull()).withColumn("_period", F.explode(periods)).withColumn("_cell", F.explode(cells))
    return out.withColumn("_share", F.when(_open(), F.pmod(F.xxhash64("id", "ingest_ord"), F.lit(SHARES)).cast("int")).otherwise(0))


def _open() -> Column:
    return (F.col("_period") == "*") | (F.col("_cell") == "*")


def request_keys(resolved: DataFrame, kinds=range(CLASSES + 1)) -> DataFrame:
    """Requests with one row for each (period, cell, share) that they ask; `kinds` are the classes that listings have."""
    def buckets(kind: int) -> Column:
        if kind == CLASSES:
            return F.array(F.lit("long"))
        size = F.lit(DAYS * 2**kind)
        # A listing of this class may have begun a bucket's length before.
        first = _bucket(F.date_sub("lo", DAYS * 2**kind), size)
        return F.transform(F.sequence(first, _bucket(F.least("hi", F.date_add("lo", OPEN_END)), size)), lambda n: _key(F.lit(kind), n))

    closed = F.datediff("hi", "lo") <= OPEN_END
    none = F.array().cast("array<string>")
    periods = F.when(closed, F.concat(none, *[buckets(k) for k in sorted(kinds)])).otherwise(F.array(F.lit("*")))
    high = (F.col("radius_km") + 1) / KM_PER_DEGREE
    widest = F.cos(F.radians(F.least(F.lit(89.0), F.abs(F.col("olat")) + high)))
    wide = F.least(F.lit(180.0), high / widest)
    row = lambda lat: F.floor((lat + 90) / CELL_LAT)
    column = lambda lon: F.floor((lon + 180) / CELL_LON)
    south, north, west, east = row(F.col("olat") - high), row(F.col("olat") + high), column(F.col("olon") - wide), column(F.col("olon") + wide)
    columns = F.array_distinct(F.transform(F.sequence(west, east), lambda n: F.pmod(n, F.lit(int(360 / CELL_LON)))))
    around = F.flatten(F.transform(F.sequence(south, north), lambda a: F.transform(columns, lambda b: _key(a, b))))
    local = F.col("has_origin") & F.col("radius_km").isNotNull()
    # A circle around an unknown place holds nothing.
    many = (north - south + 1) * (east - west + 1) > CELLS
    cells = F.when(~local | (F.col("olat").isNotNull() & many), F.array(F.lit("*"))).when(F.col("olat").isNotNull(), around).otherwise(none)
    out = resolved.withColumn("_period", F.explode(periods)).withColumn("_cell", F.explode(cells))
    return out.withColumn("_share", F.explode(F.when(_open(), F.sequence(F.lit(0), F.lit(SHARES - 1))).otherwise(F.array(F.lit(0)))))


def _matches() -> Column:
    """All filters of a request over the joined columns."""
    from_day, to_day = F.greatest("_d0", "lo"), F.least("_d1", "hi")
    runs = (F.col("_d0") <= F.col("hi")) & (F.col("_d1") >= F.col("lo")) & (F.col("_off").isNull() | (F.datediff(to_day, from_day) + 1 > F.size(F.filter("_off", lambda d: d.between(from_day, to_day)))))
    kind = (F.coalesce("type_filter", F.lit("")) == "") | (F.col("event_type") == F.col("type_filter"))
    fresh = ~F.coalesce("only_new", F.lit(False)) | F.coalesce("is_new", F.lit(False))
    price = F.col("price_limit").isNull() | F.col("_free") | ((F.col("price_limit") > 0) & F.coalesce(F.col("_sek") <= F.col("price_limit"), F.lit(False)))
    near = ~F.col("has_origin") | F.col("radius_km").isNull() | F.coalesce(F.col("distance_km") <= F.col("radius_km"), F.lit(False))
    return F.coalesce(runs & kind & fresh & price & near & ((F.col("q") == "") | F.contains("s_all", "q")), F.lit(False))


def pairs(listings: DataFrame, requests: DataFrame) -> DataFrame:
    """One row per (request, matching listing) with the prepared columns of both."""
    resolved = resolve(requests)
    bounds = resolved.agg(F.min("lo"), F.max("hi"), F.min("today"), F.max("today")).first()  # four dates
    if bounds[0] is None:
        bounds = (FAR, FAR, FAR, FAR)
    if bounds[2] != bounds[3]:
        raise ValueError("requests of one evaluation share their day")
    soon = listings.filter(F.col("start_date") <= bounds[1].isoformat())
    if "last_date" in soon.columns:
        soon = soon.filter(F.col("last_date") >= bounds[0].isoformat()).drop("last_date")
    prepared = ranking.with_location(scoring.with_request_columns(soon, bounds[2]))
    if "is_new" not in prepared.columns:
        prepared = prepared.withColumn("is_new", F.lit(False))
    kinds = [r.kind for r in prepared.select(_kind().alias("kind")).filter(F.col("kind").isNotNull()).distinct().collect()]  # CLASSES + 1 numbers at most
    # The keys are many times the requests, which the size that Spark expects does not show: never sent through the driver.
    met = listing_keys(prepared).join(request_keys(resolved, kinds).hint("merge"), ["_period", "_cell", "_share"]).drop("_share")
    km = F.when(F.col("has_origin"), F.bround(geo.haversine_km(F.col("olat"), F.col("olon"), F.col("loc.lat"), F.col("loc.lon"))).cast("int"))
    return met.withColumn("distance_km", km).filter(_matches())


def _interests() -> tuple[Column, Column]:
    """Points and reason for the interests of the request's own row."""
    hits = codes(*[
        (F.array_contains("interests", name) & F.exists(F.array(*[F.lit(search_text_py(k)) for k in words]), lambda k: F.contains("s_interest", k)), name)
        for name, words in vocab.INTEREST_PROFILES.items()
    ])
    # In the order in which the request names them.
    hits = F.filter(F.coalesce("interests", F.array().cast("array<string>")), lambda i: F.array_contains(hits, i))
    n = F.size(hits)
    points = F.when(n > 0, F.least(F.lit(18), 12 + 3 * (n - 1))).otherwise(0)
    return points, F.when(n > 0, F.concat(F.lit("interests: "), F.array_join(F.slice(hits, 1, 2), ", ")))


def scored(listings: DataFrame, requests: DataFrame, keep=()) -> DataFrame:
    """The rows that `ranking.score_requests` gives for the same requests."""
    q = F.col("q")
    has = lambda c: F.contains(c, q)
    query = F.when(q == "", 0).when(has("s_title"), 26).when(has("s_place_v") | has("s_place_c"), 16).when(has("s_tax"), 13).when(has("s_desc"), 5).otherwise(0)
    within = F.when(F.coalesce("price_limit", F.lit(0.0)) > 0, F.when(F.col("_sek") <= F.col("price_limit") * 0.5, 10).otherwise(5)).otherwise(2)
    price = F.when(F.col("_free"), 14).when(F.col("_sek").isNotNull(), within).otherwise(0)
    ranked = scoring.summed(query, _interests(), F.col("distance_km"), price)
    base = list(dict.fromkeys(["id", "ingest_ord", "title", "event_type", "venue", "start_date", *keep]))
    return pairs(listings, requests).select("request_id", *[c.alias(n) for n, c in ranked.items()], *base)


# --- relaxation over the same table ------------------------------------------------------

def scenarios(requests: DataFrame) -> DataFrame:
    """Every request as it is and with one constraint widened, in the table's own form, with base_id, kind and step."""
    wider = F.create_map(*[x for k, v in vocab.WIDER_PERIODS.items() for x in (F.lit(k), F.array(*[F.lit(p) for p in v]) if v else F.array().cast("array<string>"))])
    periods = F.coalesce(F.try_element_at(wider, F.col("when")), F.array().cast("array<string>"))
    steps = F.filter(F.array(*[F.lit(x) for x in vocab.RADIUS_STEPS]), lambda x: x > F.col("radius_km"))
    radii = F.when((F.coalesce(F.col("origin_city"), F.lit("")) != "") & F.col("radius_km").isNotNull(), steps).otherwise(F.array().cast("array<int>"))
    made = lambda kind, step, when=F.col("when"), radius=F.col("radius_km"), price=F.col("price"), new=F.coalesce("only_new", F.lit(False)): F.struct(
        F.lit(kind).alias("kind"), step.cast("int").alias("step"), when.alias("when"), radius.cast("int").alias("radius_km"), price.alias("price"), new.alias("only_new"),
    )
    zero = F.lit(0)
    none = F.array().cast("array<struct<kind:string,step:int,when:string,radius_km:int,price:string,only_new:boolean>>")
    both = F.flatten(F.transform(periods, lambda p, i: F.transform(radii, lambda x, j: made("time_radius", i * F.size(radii) + j, when=p, radius=x))))
    every = F.concat(
        none, F.array(made("base", zero)), F.transform(periods, lambda p, i: made("time", i, when=p)), F.transform(radii, lambda x, i: made("radius", i, radius=x)),
        F.when(F.col("price") != "any", F.array(made("price", zero, price=F.lit("any")))).otherwise(none), F.when(F.coalesce("only_new", F.lit(False)), F.array(made("new", zero, new=F.lit(False)))).otherwise(none), both,
    )
    out = requests.withColumn("_s", F.explode(every)).withColumns({"base_id": F.col("request_id"), **{c: F.col(f"_s.{c}") for c in ("kind", "step", "when", "radius_km", "price", "only_new")}}).drop("_s")
    return out.withColumn("request_id", F.concat_ws("|", "base_id", "kind", F.col("step").cast("string")))


def hits(listings: DataFrame, requests: DataFrame) -> DataFrame:
    """(request_id, kind, step, hits) of the scenarios that find something."""
    asked = scenarios(requests)
    counts = pairs(listings, asked.select(*[c.split()[0] for c in REQUESTS.split(", ")])).groupBy("request_id").agg(F.count("*").alias("hits"))
    return counts.join(asked.select("request_id", "base_id", "kind", "step"), "request_id").select(F.col("base_id").alias("request_id"), "kind", "step", "hits")


def choose(found: DataFrame) -> DataFrame:
    """The relaxations to offer; requests that find something themselves need none."""
    return relaxation.choose(found)


def suggest(listings: DataFrame, requests: DataFrame, per_suggestion: int = 3) -> DataFrame:
    """Chosen relaxations with their best listings, each shown once for a request."""
    offered = cut(choose(hits(listings, requests))).withColumnRenamed("request_id", "base_id")
    asked = cut(scenarios(requests).join(offered.select("base_id", "kind", "step"), ["base_id", "kind", "step"], "left_semi"))
    best = ranking.diversify(scored(listings, asked.select(*[c.split()[0] for c in REQUESTS.split(", ")]), keep=relaxation.SHOWN), ranking.PAGE)
    named = best.join(asked.select("request_id", "base_id", "kind", "step"), "request_id").join(offered.select("base_id", "kind", "step", "suggestion"), ["base_id", "kind", "step"])
    return relaxation.claim(named, per_suggestion).withColumn("request_id", F.col("base_id")).drop("base_id")
