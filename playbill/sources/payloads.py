"""API payloads to listings: each body is parsed once and exploded."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from playbill import vocab
from playbill.functions.booking import host
from playbill.functions.classify import guess_linked_data_type
from playbill.functions.dates import parse_day, strict_clock
from playbill.functions.text import stable_id, txt
from playbill.schema import as_listings
from playbill.sources.ingest import keep_first, ordinal, page_ranks


def _record(source: str, external_id: Column, url: Column, title: Column, payload: Column | None = None) -> Column:
    none = F.lit(None)
    return F.array(
        F.struct(
            F.lit(source).alias("source"), external_id.alias("external_id"), url.alias("source_url"), F.col("fetched_at").cast("string").alias("fetched_at"), title.alias("raw_title"),
            F.lit(1.0).alias("confidence"), (none.cast("map<string,string>") if payload is None else payload).alias("payload"),
        )
    )


def _common(source: str) -> dict[str, Column]:
    return {"source_names": F.array(F.lit(source)), "source_count": F.lit(1), "verified_at": F.col("fetched_at").cast("string")}


# --- ticketing API (S1) -----------------------------------------------------------------

TICKETING = """_embedded struct<events:array<struct<id:string,name:string,url:string,info:string,pleaseNote:string,
dates:struct<start:struct<localDate:string,localTime:string>,status:struct<code:string>>,
classifications:array<struct<segment:struct<name:string>,genre:struct<name:string>>>,priceRanges:array<struct<min:double,max:double,currency:string>>,
images:array<struct<url:string,width:int>>,
_embedded:struct<venues:array<struct<name:string,city:struct<name:string>,state:struct<name:string>,country:struct<name:string>,location:struct<latitude:string,longitude:string>>>>>>>,
page struct<totalPages:int,totalElements:int>"""


def ticketing_listings(pages: DataFrame) -> DataFrame:
    """pages(payload, page, fetched_at) -> listings in page order."""
    body = pages.withColumn("b", F.from_json("payload", TICKETING)).select("page", "fetched_at", F.posexplode("b._embedded.events").alias("pos", "e"))
    e = F.col("e")
    first = lambda c: F.try_element_at(c, F.lit(1))
    filled = lambda c, default: F.coalesce(F.nullif(c, F.lit("")), F.lit(default))
    venue, kind, price = first(e["_embedded"]["venues"]), first(e["classifications"]), first(e["priceRanges"])
    segment = filled(kind["segment"]["name"], "Evenemang")
    genre = F.coalesce(F.nullif(kind["genre"]["name"], F.lit("")), segment)
    lo, hi = price["min"], price["max"]
    widest = F.array_max(F.transform(e["images"], lambda im, i: F.struct(F.coalesce(im["width"], F.lit(0)).alias("w"), (-i).alias("i"), im["url"].alias("url"))))["url"]
    lat, lon = (venue["location"][k].try_cast("double") for k in ("latitude", "longitude"))
    ext = txt(e["id"])
    return as_listings(
        body.select(
            F.concat(F.lit("tm-"), ext).alias("id"), filled(e["name"], "Okänt evenemang").alias("title"),
            F.when(F.lower(segment) == "music", "Konsert").otherwise("Evenemang").alias("event_type"), genre.alias("category"),
            txt(e["dates"]["start"]["localDate"]).alias("start_date"), e["dates"]["start"]["localTime"].alias("start_time"), txt(venue["name"]).alias("venue"),
            txt(venue["city"]["name"]).alias("city"), txt(venue["state"]["name"]).alias("region"), filled(venue["country"]["name"], "Sverige").alias("country"),
            lat.alias("latitude"), lon.alias("longitude"), lat.alias("venue_latitude"), lon.alias("venue_longitude"), widest.alias("image_url"),
            e["url"].alias("official_url"), e["url"].alias("ticket_url"), filled(e["dates"]["status"]["code"], "unknown").alias("status"),
            F.coalesce(F.nullif(e["info"], F.lit("")), e["pleaseNote"], F.lit("")).alias("description"), F.array(segment, genre).alias("tags"), F.lit("verified").alias("data_quality"),
            lo.alias("price_min"), hi.alias("price_max"), F.when(price.isNotNull(), filled(price["currency"], "SEK")).otherwise("SEK").alias("currency"),
            F.when(lo.isNull(), "unknown").when((lo <= 0) & (hi.isNull() | (hi <= 0)), "free").otherwise("known").alias("price_status"),
            _record("Ticketmaster", ext, e["url"], e["name"]).alias("source_records"), ordinal(F.col("page"), F.col("pos")).alias("ingest_ord"),
            *[c.alias(n) for n, c in _common("Ticketmaster").items()],
        )
    )


def ticketing_pages(pages: DataFrame) -> DataFrame:
    """Page-walk metadata for `completeness`; an unreadable body is a failed page."""
    b = F.from_json("payload", TICKETING)
    return pages.select(
        F.lit("Ticketmaster").alias("source"), F.lit(1).alias("run"), "page", b["page"]["totalPages"].alias("total_pages"), b["page"]["totalElements"].alias("total_elements"),
        F.try_parse_json("payload").isNull().alias("failed"),
    )


# --- linked data (S2) ---------------------------------------------------------------------

def _get(item: Column, path: str, kind: str = "variant") -> Column:
    return F.try_variant_get(item, path, kind)


def _is(value: Column, kind: str) -> Column:
    return F.coalesce(F.schema_of_variant(value).startswith(kind), F.lit(False))


def _aliased(item: Column, name: str) -> Column:
    """First present spelling of a property; of a list, its first member."""
    value = F.coalesce(*[_get(item, f"$['{p}{name}']") for p in ("http://schema.org/", "", "schema:")])
    return F.when(_is(value, "ARRAY"), _get(value, "$[0]")).otherwise(value)


def _nested(item: Column, name: str) -> Column:
    return F.coalesce(_get(item, f"$['{name}']"), _get(item, f"$['http://schema.org/{name}']"))


def _words(value: Column) -> Column:
    """Text of a string, of a language-tagged value, or of a list of them."""

    def plain(v):
        tagged = F.coalesce(F.nullif(_get(v, "$['@value']", "string"), F.lit("")), _get(v, "$.name", "string"))
        return F.when(_is(v, "OBJECT"), tagged).when(v.isNotNull() & ~_is(v, "ARRAY"), v.cast("string"))

    items = F.from_json(F.to_json(value), "array<struct<`@value`:string,`@language`:string>>")
    spoken = F.filter(items, lambda x: (F.coalesce(x["@value"], F.lit("")) != "") & (x["@language"].isNull() | x["@language"].isin("sv", "se", "en")))
    listed = F.coalesce(F.try_element_at(spoken, F.lit(1))["@value"], plain(_get(value, "$[0]")))
    return F.when(_is(value, "ARRAY"), listed).otherwise(plain(value))


def _json_clock(raw: Column) -> Column:
    hour, minute = F.regexp_extract(raw, r"T(\d{2}):(\d{2})", 1), F.regexp_extract(raw, r"T(\d{2}):(\d{2})", 2)
    return F.when(hour != "", F.concat(hour, F.lit(":"), minute))


def linked_data_listings(pages: DataFrame, source: str = "Visit Sweden") -> DataFrame:
    """pages(payload, page, fetched_at) of JSON-LD; a record needs a title and a start."""
    v = F.try_parse_json("payload")
    df = pages.withColumn("v", v)
    graph = F.coalesce(*[F.when(_is(_get(F.col("v"), f"$['{k}']"), "ARRAY"), _get(F.col("v"), f"$['{k}']")) for k in ("@graph", "results", "entries")])
    df = df.withColumn("items", F.when(_is(F.col("v"), "ARRAY"), F.col("v")).otherwise(graph))
    listed = df.filter(F.col("items").isNotNull()).select("page", "fetched_at", F.posexplode(F.col("items").try_cast("array<variant>")).alias("pos", "x"))
    single = df.filter(F.col("items").isNull() & _is(F.col("v"), "OBJECT")).select("page", "fetched_at", F.lit(0).alias("pos"), F.col("v").alias("x"))
    df = listed.unionByName(single).filter(_is(F.col("x"), "OBJECT"))
    x = F.col("x")
    parts = {n: _aliased(x, a) for n, a in (("v_name", "name"), ("v_start", "startDate"), ("v_end", "endDate"), ("v_desc", "description"), ("v_url", "url"), ("loc", "location"))}
    df = df.withColumns(parts).withColumns({f"t_{n[2:]}": _words(F.col(n)) for n in parts if n.startswith("v_")})
    df = df.filter((txt("t_name") != "") & (txt("t_start") != "")).withColumns({"addr": _nested(F.col("loc"), "address"), "geo": _nested(F.col("loc"), "geo")})
    number = lambda k: F.coalesce(_get(_nested(F.col("geo"), k), "$", "double"), _get(_nested(F.col("geo"), k), "$", "string").try_cast("double"))
    end, title, url = txt("t_end"), F.col("t_name"), F.col("t_url")
    ext = F.coalesce(F.nullif(_get(x, "$['@id']", "string"), F.lit("")), F.nullif(_get(x, "$.id", "string"), F.lit("")), F.concat(F.lit("offset-"), (F.col("page") * 100 + F.col("pos")).cast("string")))
    return as_listings(
        df.withColumn("ext", ext).select(
            stable_id("vs-", "ext").alias("id"), title.alias("title"), guess_linked_data_type(title, "t_desc").alias("event_type"), F.lit("Okategoriserat").alias("category"),
            F.substring("t_start", 1, 10).alias("start_date"), F.when(end != "", F.substring(end, 1, 10)).alias("end_date"), _json_clock(F.col("t_start")).alias("start_time"), _json_clock(end).alias("end_time"),
            txt(_words(_nested(F.col("loc"), "name"))).alias("venue"), txt(_words(_nested(F.col("addr"), "addressLocality"))).alias("city"), txt(_words(_nested(F.col("addr"), "addressRegion"))).alias("region"),
            F.lit("Sverige").alias("country"), number("latitude").alias("latitude"), number("longitude").alias("longitude"), number("latitude").alias("venue_latitude"), number("longitude").alias("venue_longitude"),
            url.alias("official_url"), F.lit("confirmed").alias("status"), txt("t_desc").alias("description"), F.lit("partial").alias("data_quality"), F.array(F.lit("category_normalised_conservatively")).alias("quality_notes"),
            _record(source, F.col("ext"), url, title).alias("source_records"), ordinal(F.col("page"), F.col("pos")).alias("ingest_ord"), *[c.alias(n) for n, c in _common(source).items()],
        )
    )


# --- city API with schedules (S3) -----------------------------------------------------------

CITY_API = """count int, next string, total_pages int, results array<struct<id:string,title:variant,description:variant,city:variant,venue_name:variant,url:string,external_website_url:string,
categories:array<struct<slug:string>>,location:struct<latitude:string,longitude:string>,
schedule:struct<range:struct<start:string,end:string,excluded:array<string>>,dates:array<struct<date:string,start_time:string,end_time:string>>>,
start_date:string,end_date:string,start_time:string,end_time:string,created_at:string,modified_at:string>>"""


def _local(value: Column) -> Column:
    spoken = F.coalesce(F.nullif(_get(value, "$.sv", "string"), F.lit("")), F.nullif(_get(value, "$.en", "string"), F.lit("")))
    return F.trim(F.coalesce(F.when(_is(value, "OBJECT"), spoken).when(_is(value, "STRING"), value.cast("string")), F.lit("")))


def _bounded(raw: Column, limit: int) -> Column:
    number = raw.try_cast("double")
    return F.when(~F.isnan(number) & (F.abs(number) <= limit), number)


def city_api_listings(pages: DataFrame, today: dt.date, source: str = "Visit Stockholm") -> DataFrame:
    """pages(payload, page, fetched_at) -> one listing per occurrence: the running range and single days outside it."""
    base = pages.select("page", "fetched_at", F.posexplode(F.from_json("payload", CITY_API)["results"]).alias("pos", "r")).select("page", "fetched_at", "pos", "r.*")
    slug = F.when(F.col("url").rlike(r"(?U)^[\w-]+$"), F.concat(F.lit("https://www.visitstockholm.com/events/"), F.col("url"), F.lit("/")))
    other = F.col("external_website_url")
    safe = F.when(F.lower(F.try_parse_url(other, F.lit("PROTOCOL"))).isin("http", "https") & (host(other) != "") & F.try_parse_url(other, F.lit("USERINFO")).isNull(), other)
    base = base.withColumns({"t": _local(F.col("title")), "c": _local(F.col("city")), "info": F.coalesce(slug, safe), "ext": txt("id")})
    base = base.filter((F.col("t") != "") & (F.col("ext") != "") & (F.col("c") != "") & F.col("info").isNotNull())
    day = lambda c: F.try_to_date(c, "yyyy-MM-dd")
    occ = lambda s, e, clock, end_clock, off, ranged: F.struct(s.alias("s"), e.alias("e"), clock.alias("clock"), end_clock.alias("end_clock"), off.alias("off"), F.lit(ranged).alias("ranged"))
    none, no_days = F.lit(None).cast("string"), F.array().cast("array<date>")
    rs, re_ = day(F.col("schedule.range.start")), day(F.col("schedule.range.end"))
    off = F.array_sort(F.array_distinct(F.filter(F.transform(F.coalesce("schedule.range.excluded", F.array().cast("array<string>")), lambda d: F.try_to_date(d, "yyyy-MM-dd")), lambda d: d.between(rs, re_))))
    base = base.withColumn("range", F.when(rs <= re_, occ(rs, re_, none, none, off, True)))
    covered = lambda d: F.coalesce(d.between(F.col("range.s"), F.col("range.e")) & ~F.array_contains("range.off", d), F.lit(False))
    singles = F.filter(
        F.transform(F.coalesce("schedule.dates", F.array().cast("array<struct<date:string,start_time:string,end_time:string>>")), lambda x: occ(day(x["date"]), day(x["date"]), strict_clock(x["start_time"]), strict_clock(x["end_time"]), no_days, False)),
        lambda o: o["s"].isNotNull() & ~covered(o["s"]),
    )
    ps, pe = day(F.col("start_date")), day(F.col("end_date"))
    multi = F.coalesce(pe != ps, F.lit(False))
    plain = occ(ps, F.coalesce(pe, ps), F.when(~multi, strict_clock("start_time")), F.when(~multi, strict_clock("end_time")), no_days, False)
    plain_ok = ps.isNotNull() & (pe.isNull() | (ps <= pe))
    empty = F.array().cast("array<struct<s:date,e:date,clock:string,end_clock:string,off:array<date>,ranged:boolean>>")
    scheduled = F.concat(F.when(F.col("range").isNotNull(), F.array("range")).otherwise(empty), singles)
    every = F.when(F.col("schedule").isNotNull(), scheduled).when(plain_ok, F.array(plain)).otherwise(empty)
    rows = base.select("*", F.posexplode(every).alias("o_pos", "o"))
    o = F.col("o")
    occ_id = F.when(o["ranged"], F.concat("ext", F.lit(":range"))).otherwise(F.concat("ext", F.lit(":"), o["s"].cast("string"), F.lit(":"), txt(o["clock"])))
    kinds = F.create_map(*[F.lit(x) for kv in vocab.CITY_API_TYPES.items() for x in kv])
    hits = F.filter(F.transform("categories", lambda k: F.try_element_at(kinds, k["slug"])), lambda k: k.isNotNull())
    rows = rows.withColumns({"occ_id": occ_id, "kind": F.coalesce(F.try_element_at(hits, F.lit(1)), F.lit("Evenemang"))})
    attribution = F.create_map(F.lit("license_url"), F.lit("https://creativecommons.org/licenses/by/4.0/"))
    plain_text = F.trim(F.regexp_replace(F.regexp_replace(_local(F.col("description")), "<[^>]*>", " "), r"\s+", " "))
    out = rows.filter(o["e"] >= F.lit(today)).select(
        F.concat(F.lit("visitstockholm-"), "occ_id").alias("id"), F.col("t").alias("title"), F.col("kind").alias("event_type"), F.col("kind").alias("category"),
        o["s"].cast("string").alias("start_date"), F.when(o["e"] != o["s"], o["e"].cast("string")).alias("end_date"), o["clock"].alias("start_time"), o["end_clock"].alias("end_time"),
        F.transform(o["off"], lambda d: d.cast("string")).alias("excluded_dates"), _local(F.col("venue_name")).alias("venue"), F.col("c").alias("city"),
        F.when(F.col("c") == "Stockholm", "Stockholms län").otherwise("").alias("region"), F.lit("Sverige").alias("country"), F.col("info").alias("official_url"),
        _bounded(F.col("location.latitude"), 90).alias("latitude"), _bounded(F.col("location.longitude"), 180).alias("longitude"), plain_text.alias("description"), F.array("kind").alias("tags"),
        "created_at", F.col("modified_at").alias("updated_at"), _record(source, F.col("occ_id"), F.col("info"), F.col("t"), attribution).alias("source_records"),
        ordinal(F.col("page"), F.col("pos"), F.col("o_pos")).alias("ingest_ord"), *[c.alias(n) for n, c in _common(source).items()],
    )
    return keep_first(as_listings(out), ["id"])


# --- sports schedule (S4) ---------------------------------------------------------------------

def schedule_listings(pages: DataFrame, home_word: str, arena_word: str, source: str, source_key: str, city: str, tags=("Sport",)) -> DataFrame:
    """pages(payload, url, fetched_at) -> home fixtures only; team and arena spellings vary between feeds."""
    v = F.try_parse_json("payload")
    same = [F.col(f"p.{c}").eqNullSafe(F.col(f"r.{c}")) for c in ("url", "fetched_at")]
    df = pages.alias("p").join(page_ranks(pages).withColumnRenamed("page", "_page").alias("r"), same[0] & same[1]).select("p.*", "r._page").withColumn("v", v)
    games = F.coalesce(_get(F.col("v"), "$.gameInfo"), _get(F.col("v"), "$.games"))
    games = F.when(_is(games, "OBJECT"), F.coalesce(_get(games, "$.content"), _get(games, "$.items"))).otherwise(games)
    rows = df.select("url", "fetched_at", "_page", F.posexplode(F.when(_is(games, "ARRAY"), games.try_cast("array<variant>"))).alias("pos", "g"))
    g = F.col("g")

    def name(*keys):
        value = F.coalesce(*[_get(g, f"$.{k}") for k in keys])
        inner = [_get(value, p, "string") for p in ("$.displayName", "$.name", "$.teamNames.longSite", "$.teamNames.long", "$.teamNames.short")]
        return F.trim(F.coalesce(F.when(_is(value, "STRING"), value.cast("string")), *[F.nullif(i, F.lit("")) for i in inner], F.lit("")))

    start = F.coalesce(*[F.nullif(_get(g, f"$.{k}", "string"), F.lit("")) for k in ("startDateTime", "startTime", "date")], F.lit(""))
    rows = rows.withColumns({"home": name("homeTeam", "teamHome"), "away": name("awayTeam", "teamAway"), "arena": name("arena", "venue", "location"), "raw": start})
    day = F.regexp_extract("raw", r"^(20\d{2}-\d{2}-\d{2})(?:[T ](\d{2}:\d{2}))?", 1)
    rows = rows.filter(F.contains(F.lower("home"), F.lit(home_word.lower())) & F.contains(F.lower("arena"), F.lit(arena_word.lower())) & (day != "") & (F.col("away") != ""))
    title = F.concat("home", F.lit(" – "), "away")
    ext = F.coalesce(*[F.nullif(_get(g, f"$.{k}", "string"), F.lit("")) for k in ("uuid", "id")], F.concat_ws("|", title, "raw", "arena"))
    rows = rows.withColumns({"title": title, "day": day, "_key": F.lower(title), "ext": ext, "ingest_ord": ordinal(F.col("_page"), F.col("pos"))})
    rows = keep_first(rows.drop("g"), ["_key", "day"])
    return as_listings(
        rows.select(
            stable_id(f"{source_key}-", "ext").alias("id"), "title", F.lit("Sport").alias("event_type"), F.lit("Sport").alias("category"), F.col("day").alias("start_date"), F.nullif(F.regexp_extract("raw", r"[T ](\d{2}:\d{2})", 1), F.lit("")).alias("start_time"),
            F.col("arena").alias("venue"), F.lit(city).alias("city"), F.lit("Sverige").alias("country"), F.col("url").alias("official_url"), F.lit("confirmed").alias("status"), F.array(*[F.lit(t) for t in tags]).alias("tags"),
            F.lit("source_verified").alias("data_quality"), _record(source, F.col("ext"), F.col("url"), F.col("title")).alias("source_records"), "ingest_ord", *[c.alias(n) for n, c in _common(source).items()],
        )
    )
