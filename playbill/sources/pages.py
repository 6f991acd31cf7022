"""Landed pages to listings, and detail pages to practical facts."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from playbill import vocab
from playbill.functions import booking, pages
from playbill.functions.classify import guess_calendar_type
from playbill.functions.dates import explicit_price, make_day, month_number, numeric_day, numeric_prefix, swedish_range
from playbill.functions.text import nz, stable_id, txt
from playbill.schema import as_listings
from playbill.sources import registry, rules



def rule_table(spark) -> DataFrame:
    """Twenty-odd fixed rows with the registry's display names."""
    names = registry.sources(spark).select(F.col("key").alias("source_key"), F.col("name").alias("source"))
    return spark.createDataFrame(rules.RULES, rules.FIELDS).join(names, "source_key")


def _matches(value: Column, rx: Column, default: bool) -> Column:
    return F.coalesce(F.regexp_like(value, F.concat(F.lit("(?U)"), rx)), F.lit(default))


def _iso_day(text: Column) -> Column:
    return F.try_to_date(F.regexp_extract(text, r"\b(20\d{2}-\d{2}-\d{2})\b", 1), "yyyy-MM-dd")


def _heading_day(text: Column) -> Column:
    rx = r"(?U)\b(\d{1,2}) (" + "|".join(vocab.MONTHS_SV) + r") (20\d{2})\b"
    got = lambda i: F.regexp_extract(F.lower(text), rx, i)
    return F.when(got(1) != "", make_day(got(3).cast("int"), month_number(got(2)), got(1).cast("int")))


def blocks(raw_pages: DataFrame) -> DataFrame:
    """One row per heading or link in page order, with the last date heading carried forward."""
    df = raw_pages.filter(F.coalesce("page_kind", F.lit("list")) == "list").join(F.broadcast(rule_table(raw_pages.sparkSession)), "source_key")
    df = df.filter(F.col("mode") != "line").filter(F.col("mode") != "fixture")
    df = df.select("*", F.posexplode(pages.page_blocks("html")).alias("block_no", "b")).drop("html")
    # Pages are bounded, so the window holds one page's blocks.
    by_page = Window.partitionBy("url").orderBy("block_no")
    is_heading = F.col("b.tag") != "a"
    return df.withColumn("heading_day", F.last(F.when(is_heading, _heading_day(F.col("b.text"))), True).over(by_page))


def _from_blocks(raw_pages: DataFrame, today: dt.date) -> DataFrame:
    df = blocks(raw_pages).filter(F.col("mode") != "page")
    b, mode = F.col("b"), F.col("mode")
    is_link = b["tag"] == "a"
    wanted = (
        F.when(mode.isin("box_link", "dated_link", "link"), is_link).when(mode == "box_heading", ~is_link & (b["tag"] != "h1")).otherwise(F.lit(True))
    )
    boxed = F.coalesce(b["box"], b["text"])
    title = F.when((mode == "box_link") & b["heading"].isNotNull(), b["heading"]).when(is_link, F.coalesce(nz(b["hint"]), b["text"])).otherwise(b["text"])
    text = F.when(mode == "link", b["text"]).otherwise(boxed)
    df = df.filter(wanted).withColumns({"title": F.trim(title), "text": text, "href": F.coalesce(nz(b["href"]), nz(b["box_href"]))})
    # A link whose own text carries the date keeps what stands before it as the title.
    cut_rx = r"(?iuU)^(.*?)[ ·–—-]*\b\d{1,2} (?:" + "|".join(vocab.MONTHS_SV) + r") 20\d{2}\b"
    df = df.withColumn("title", F.when((mode == "link") & F.col("title").rlike(cut_rx), F.trim(F.regexp_extract("title", cut_rx, 1))).otherwise(F.col("title")))
    df = df.withColumn("link", F.coalesce(booking.absolute_url("url", "href"), F.col("url")))
    dates = F.col("dates")
    df = df.withColumns({"sv": F.when(dates == "swedish", swedish_range("text", today)), "num": F.when(dates == "numeric", numeric_day("text", today))})
    start = F.when(dates == "numeric", F.col("num")).when(dates == "heading", F.col("heading_day")).otherwise(F.col("sv.start"))
    end = F.when(dates == "swedish", F.col("sv.end"))
    return df.withColumns({"start": start, "end": end, "place": F.lit(None).cast("string")}).filter(_matches(F.col("link"), F.col("link_like"), True))


def _from_lines(raw_pages: DataFrame, today: dt.date) -> DataFrame:
    """Editorial lists: '9/9-12/9 Title. Venue', year taken from the page."""
    df = raw_pages.filter(F.coalesce("page_kind", F.lit("list")) == "list").join(F.broadcast(rule_table(raw_pages.sparkSession)), "source_key").filter(F.col("mode") == "line")
    df = df.withColumn("all", pages.page_lines("html")).drop("html")
    years = F.transform(F.regexp_extract_all(F.array_join("all", "\n"), F.lit(r"\b(20\d{2})\b"), F.lit(1)), lambda y: y.cast("int"))
    df = df.withColumn("year", F.coalesce(F.array_max(years), F.lit(today.year))).select("*", F.posexplode("all").alias("block_no", "line")).drop("all")
    df = df.withColumn("p", numeric_prefix("line", F.col("year"))).filter(F.col("p").isNotNull())
    bare = F.trim(F.regexp_replace(F.col("p.rest"), r"(?iuU)\s*\((?:G|Fri entr[eé])\)\s*", " "), F.lit(" ."))
    head, tail = F.regexp_extract(bare, r"^(.*?)\. (.*)$", 1), F.regexp_extract(bare, r"^(.*?)\. (.*)$", 2)
    return df.withColumns(
        {
            "title": F.when(head != "", F.trim(head, F.lit(" ."))).otherwise(bare), "place": F.when(head != "", F.nullif(F.trim(tail, F.lit(" .")), F.lit(""))), "text": F.col("line"), "start": F.col("p.start"),
            "end": F.col("p.end"), "link": F.col("url"),
        }
    )


def _fixtures(raw_pages: DataFrame, today: dt.date) -> DataFrame:
    """Fixture lists: a 'home - away' line with date, clock and arena on the lines around it."""
    df = raw_pages.filter(F.coalesce("page_kind", F.lit("list")) == "list").join(F.broadcast(rule_table(raw_pages.sparkSession)), "source_key").filter(F.col("mode") == "fixture")
    df = df.select("*", F.posexplode(pages.page_lines("html")).alias("block_no", "line")).drop("html")
    by_page = Window.partitionBy("url").orderBy("block_no")
    near = lambda a, b: F.array_join(F.collect_list("line").over(by_page.rowsBetween(a, b)), "\n")
    df = df.withColumns({"around": near(-rules.LINE_LOOK_BACK, rules.LINE_LOOK_AHEAD), "ahead": near(0, rules.LINE_LOOK_AHEAD)})
    versus = r"(?U)^([\p{L}][\p{L}\d .&]{1,60}?)\s+[-–]\s+([\p{L}][\p{L}\d .&]{1,60})$"
    home = F.lower(F.regexp_extract("line", versus, 1))
    at_home = home.rlike("^(?:.*\\b)?(" + "|".join(rules.HOME_WORDS) + ")")
    df = df.filter((home != "") & at_home & _matches(F.lower("ahead"), F.col("need"), True))
    df = df.withColumns({"sv1": swedish_range("ahead", today), "sv2": swedish_range("around", today)})
    day = F.coalesce(_iso_day(F.col("ahead")), F.col("sv1.start"), _iso_day(F.col("around")), F.col("sv2.start"))
    return df.withColumns({"title": F.col("line"), "text": F.col("ahead"), "start": day, "end": day, "link": F.col("url"), "place": F.lit(None).cast("string")})


def _whole_pages(raw_pages: DataFrame, today: dt.date) -> DataFrame:
    """One listing per detail page: its main heading and the first date phrase."""
    df = raw_pages.join(F.broadcast(rule_table(raw_pages.sparkSession)), "source_key").filter(F.col("mode") == "page")
    df = df.withColumns({"text": F.array_join(pages.page_lines("html"), " "), "_b": pages.page_blocks("html")}).drop("html")
    head = F.try_element_at(F.filter("_b", lambda x: x["tag"] == "h1"), F.lit(1))["text"]
    day = swedish_range("text", today)["start"]
    return df.withColumns({"title": F.trim(head), "start": day, "end": day, "link": F.col("url"), "place": F.lit(None).cast("string"), "block_no": F.lit(0)}).drop("_b")


_COLUMNS = ["url", "source_key", "source", "fetched_at", "block_no", "title", "text", "link", "place", "start", "end", "skip_title", "need", "forbid", "min_len", "max_len", "venue", "city", "region", "event_type", "free_like", "tags", "id_prefix"]


def extract(raw_pages: DataFrame, today: dt.date) -> DataFrame:
    """Dated listings from all landed list pages, by rule; undated blocks are dropped, nothing is invented."""
    from playbill.sources.ingest import SUB_BITS, keep_first, ordinal, page_ranks, source_ordinal

    found = _from_blocks(raw_pages, today).select(*_COLUMNS)
    for part in (_from_lines, _fixtures, _whole_pages):
        found = found.unionByName(part(raw_pages, today).select(*_COLUMNS))
    same = [F.col(f"f.{c}").eqNullSafe(F.col(f"r.{c}")) for c in ("source_key", "url", "fetched_at")]
    found = found.alias("f").join(page_ranks(raw_pages, "source_key").alias("r"), same[0] & same[1] & same[2]).select("f.*", "r.page")
    source_ord = F.array_position(F.array(*[F.lit(r[0]) for r in rules.RULES]), F.col("source_key"))
    low = F.lower("text")
    ok = (
        F.col("start").isNotNull() & F.length("title").between(F.col("min_len"), F.col("max_len")) & ~_matches(F.lower("title"), F.col("skip_title"), False)
        & _matches(low, F.col("need"), True) & ~_matches(F.concat_ws(" ", low, F.lower("link")), F.col("forbid"), False)
    )
    places = F.lit("")
    for place in reversed(rules.KNOWN_PLACES):
        places = F.when(F.contains(low, F.lit(place.lower())), place).otherwise(places)
    price = explicit_price("text")
    free = _matches(low, F.col("free_like"), False)
    clock_rx = r"(?iuU)(?:\bkl\.?\s*)?\b([01]?\d|2[0-3])[:.]([0-5]\d)\b"
    clock = F.when(F.col("text").rlike(clock_rx), F.concat(F.lpad(F.regexp_extract("text", clock_rx, 1), 2, "0"), F.lit(":"), F.regexp_extract("text", clock_rx, 2)))
    external = F.concat_ws("|", "link", "title", F.col("start").cast("string"))
    df = found.filter(ok).withColumns({"ext": external, "price": price, "free": free, "clock": clock, "found_city": F.coalesce("city", places)})
    df = df.withColumn("kind", F.coalesce("event_type", guess_calendar_type(F.lit(""), "title")))
    record = F.array(
        F.struct(
            F.col("source"), F.col("ext").alias("external_id"), F.col("link").alias("source_url"), F.col("fetched_at").cast("string").alias("fetched_at"), F.col("title").alias("raw_title"), F.lit(1.0).alias("confidence"),
            F.lit(None).cast("map<string,string>").alias("payload"),
        )
    )
    rows = df.select(
        F.concat("id_prefix", F.substring(F.sha1("ext"), 1, 20)).alias("id"), "title", F.col("kind").alias("event_type"), F.col("kind").alias("category"), F.col("start").cast("string").alias("start_date"),
        F.when(F.col("end") != F.col("start"), F.col("end").cast("string")).alias("end_date"), F.col("clock").alias("start_time"), F.coalesce("place", "venue", "city").alias("venue"), F.col("found_city").alias("city"), "region", F.lit("Sverige").alias("country"),
        F.col("link").alias("official_url"), F.lit("confirmed").alias("status"), F.array("source").alias("source_names"), record.alias("source_records"), "tags", F.lit("partial").alias("data_quality"),
        F.when(F.col("free"), 0.0).otherwise(F.col("price.low")).alias("price_min"), F.when(F.col("free"), 0.0).otherwise(F.col("price.high")).alias("price_max"),
        F.when(F.col("free"), "free").otherwise(F.col("price.status")).alias("price_status"), source_ordinal(source_ord, ordinal(F.col("page"), F.floor(F.col("block_no") / (1 << SUB_BITS)), F.col("block_no") % (1 << SUB_BITS))).alias("ingest_ord"), F.lower("title").alias("_t"), "link",
    )
    # First block wins on (title, day, link), as a partial aggregate.
    return as_listings(keep_first(rows, ["_t", "start_date", "link"]))


def detail_links(raw_pages: DataFrame, link_like: str, limit: int | None = None) -> DataFrame:
    """Distinct detail URLs of each list page in page order, all of them unless a limit is asked for."""
    links = raw_pages.select("url", "source_key", F.posexplode(pages.page_links("html")).alias("pos", "l"))
    links = links.withColumn("target", booking.absolute_url("url", F.col("l.href"))).filter(F.col("target").rlike(link_like) & (F.rtrim("target", F.lit("/")) != F.rtrim("url", F.lit("/"))))
    first = links.groupBy("url", "source_key", "target").agg(F.min("pos").alias("pos"))
    w = Window.partitionBy("url").orderBy("pos")
    ranked = first.withColumn("n", F.row_number().over(w))
    return (ranked if limit is None else ranked.filter(F.col("n") <= limit)).select("source_key", F.col("url").alias("list_url"), F.col("target").alias("url"), "n")


def detail_pages(raw_pages: DataFrame, links: DataFrame) -> DataFrame:
    """Landed detail pages behind the links."""
    return raw_pages.filter(F.col("page_kind") == "detail").join(links.select("url").distinct(), "url", "left_semi")


# --- enrichment (S6) ----------------------------------------------------------------------

TIME_NOTE, FACT_NOTE, LINK_NOTE = "showtime_from_detail_page", "facts_from_detail_page", "booking_link_from_detail_page"


def enrich(listings: DataFrame, raw_pages: DataFrame) -> DataFrame:
    """Fills only what a listing lacks from its landed detail page, and notes it."""
    keep = listings.columns
    html = raw_pages.filter(F.col("page_kind") == "detail").groupBy("url").agg(F.max_by("html", "fetched_at").alias("html"))
    wanted = listings.filter(txt("official_url") != "").select(F.col("official_url").alias("url"), F.col("start_time").alias("known"), "ingest_ord")
    got = pages.facts(wanted.join(html, "url"), F.col("known")).select(
        "ingest_ord", F.col("showtime.start_time").alias("x_start"), F.col("showtime.end_time").alias("x_end"), F.col("door_time").alias("x_door"), F.col("age_limit").alias("x_age"),
        F.col("venue").alias("x_venue"), F.col("price").alias("x_price"), F.col("booking.url").alias("x_link"),
    )
    df = listings.join(got, "ingest_ord", "left")
    empty = lambda c: nz(c).isNull()
    vague = empty("venue") | (F.lower(F.trim("venue")) == "conventum")
    priced = F.col("x_price").isNotNull() & (F.coalesce("price_status", F.lit("unknown")) == "unknown")
    link = F.when(empty("booking_url"), F.col("x_link"))
    a = booking.attribution(link)
    has_time = F.col("x_start").isNotNull()
    has_fact = (F.col("x_door").isNotNull() & empty("door_time")) | (F.col("x_age").isNotNull() & empty("age_limit")) | (F.col("x_venue").isNotNull() & vague) | priced
    note = lambda cond, text: F.when(F.coalesce(cond, F.lit(False)), F.array(F.lit(text))).otherwise(F.array().cast("array<string>"))
    notes = F.array_distinct(F.concat("quality_notes", note(has_time, TIME_NOTE), note(has_fact, FACT_NOTE), note(link.isNotNull(), LINK_NOTE)))
    fill = lambda c, x: F.coalesce(nz(c), F.col(x))
    return df.withColumns(
        {
            "start_time": fill("start_time", "x_start"), "end_time": fill("end_time", "x_end"), "door_time": fill("door_time", "x_door"), "age_limit": fill("age_limit", "x_age"),
            "venue": F.when(vague & F.col("x_venue").isNotNull(), F.col("x_venue")).otherwise(F.col("venue")),
            "price_min": F.when(priced, F.col("x_price")).otherwise(F.col("price_min")), "price_max": F.when(priced, F.col("x_price")).otherwise(F.col("price_max")),
            "currency": F.when(priced, "SEK").otherwise(F.col("currency")), "price_status": F.when(priced, F.when(F.col("x_price") <= 0, "free").otherwise("known")).otherwise(F.col("price_status")),
            "booking_url": F.coalesce(nz("booking_url"), link), "ticket_url": F.coalesce(nz("ticket_url"), link),
            **{c: F.when(link.isNotNull(), a[f]).otherwise(F.col(c)) for c, f in (("booking_partner_key", "key"), ("booking_partner", "name"), ("booking_partner_domain", "domain"), ("affiliate_status", "affiliate_status"))},
            "quality_notes": notes,
        }
    ).select(*keep)
