"""Payloads, pages and status rows."""

import datetime as dt
import json

from pyspark.sql import functions as F

from playbill.functions import booking
from playbill.functions import pages as page_functions
from playbill.operators import evidence
from playbill.sources import ingest, payloads
from playbill.sources import pages as page_jobs
from playbill.sources import registry
from tests.factory import listings

TODAY = dt.date(2026, 9, 10)


def landed(spark, *bodies):
    rows = [(b if isinstance(b, str) else json.dumps(b), i + 1, f"https://x.se/{i}", "2026-09-10") for i, b in enumerate(bodies)]
    return spark.createDataFrame(rows, "payload string, page int, url string, fetched_at string")


def test_ticketing_pages(spark):
    event = dict(
        id="A1", name="Rock", url="https://t.se/1", info="", pleaseNote="obs", dates=dict(start=dict(localDate="2026-10-01", localTime="19:00:00"), status=dict(code="onsale")),
        classifications=[dict(segment=dict(name="Music"), genre=dict(name="Rock"))], priceRanges=[dict(min=0, max=0)], images=[dict(url="small", width=10), dict(url="big", width=90), dict(url="big2", width=90)],
        _embedded=dict(venues=[dict(name="Arena", city=dict(name="Örebro"), location=dict(latitude="59.2", longitude="x"))]),
    )
    body = dict(_embedded=dict(events=[event, dict(id="A2", priceRanges=[dict(min=100)])]), page=dict(totalPages=3, totalElements=5))
    df = landed(spark, body, "not json")
    one, two = payloads.ticketing_listings(df).orderBy("ingest_ord").collect()
    assert (one.id, one.event_type, one.category, one.price_status, one.image_url, one.city, one.latitude, one.longitude, one.description) == ("tm-A1", "Konsert", "Rock", "free", "big", "Örebro", 59.2, None, "obs")
    assert (two.title, two.price_status, two.price_min, two.category, two.country) == ("Okänt evenemang", "known", 100.0, "Evenemang", "Sverige")
    assert one.source_records[0].external_id == "A1"
    walk = ingest.completeness(payloads.ticketing_pages(df)).first()
    assert (walk.pages_fetched, walk.total_pages, walk.failed_pages, walk.truncated) == (1, 3, 1, True)


def test_linked_data_spellings(spark):
    graph = {
        "@graph": [
            {"@id": "u1", "http://schema.org/name": [{"@value": "Höstmässa", "@language": "sv"}], "http://schema.org/startDate": "2026-10-03T18:30:00", "schema:endDate": {"@value": "2026-10-04T20:00"},
             "location": {"name": "Hallen", "address": {"addressLocality": "Kumla"}, "geo": {"latitude": "59.1", "longitude": 15.1}}},
            {"name": "Utan datum"}, "skräp", {"id": "u2", "name": "Konsert i parken", "startDate": "2026-10-05"},
        ]
    }
    rows = payloads.linked_data_listings(landed(spark, graph, [{"name": "Lista", "startDate": "2026-11-01"}])).orderBy("ingest_ord").collect()
    assert [(r.title, r.start_date, r.start_time, r.end_date, r.end_time, r.event_type) for r in rows] == [
        ("Höstmässa", "2026-10-03", "18:30", "2026-10-04", "20:00", "Mässa"), ("Konsert i parken", "2026-10-05", None, None, None, "Konsert"), ("Lista", "2026-11-01", None, None, None, "Evenemang"),
    ]
    assert (rows[0].venue, rows[0].city, rows[0].latitude, rows[0].longitude) == ("Hallen", "Kumla", 59.1, 15.1)


def test_city_api_occurrences(spark):
    item = dict(
        id="7", title=dict(sv="Utställning", en="Exhibition"), city="Stockholm", venue_name=dict(en="Museet"), url="slug-1", categories=[dict(slug="exhibitions")], location=dict(latitude="95", longitude="18.0"),
        schedule=dict(range=dict(start="2026-09-01", end="2026-09-20", excluded=["2026-09-12", "2027-01-01", "bad"]), dates=[dict(date="2026-09-05"), dict(date="2026-09-12", start_time="18:00"), dict(date="2026-10-01", start_time="99:00"), dict(date="2025-01-01")]),
    )
    plain = dict(id="8", title="Match", city=dict(sv="Solna"), external_website_url="https://u:p@x.se/", start_date="2026-09-11")
    ok = dict(plain, id="9", external_website_url="https://x.se/m", start_time="19:00", end_date="2026-09-11")
    rows = {r.id: r for r in payloads.city_api_listings(landed(spark, dict(results=[item, plain, ok]), dict(results=[ok])), TODAY).collect()}
    assert set(rows) == {"visitstockholm-7:range", "visitstockholm-7:2026-09-12:18:00", "visitstockholm-7:2026-10-01:", "visitstockholm-9:2026-09-11:19:00"}
    span = rows["visitstockholm-7:range"]
    assert (span.end_date, span.excluded_dates, span.event_type, span.region, span.latitude, span.longitude, span.venue) == ("2026-09-20", ["2026-09-12"], "Utställning", "Stockholms län", None, 18.0, "Museet")
    assert rows["visitstockholm-9:2026-09-11:19:00"].end_date is None


def test_schedules_keep_home_games(spark):
    games = [
        dict(homeTeam=dict(teamNames=dict(longSite="Örebro Hockey")), awayTeam="AIK", venue=dict(name="Behrn Arena"), startDateTime="2026-10-01T19:00:00"),
        dict(homeTeam="AIK", awayTeam="Örebro Hockey", venue="Annan", startDateTime="2026-10-02"), dict(homeTeam="Örebro Hockey", awayTeam="", venue="Behrn Arena", date="2026-10-03"),
    ]
    for body in (dict(gameInfo=games), dict(games=dict(content=games))):
        rows = payloads.schedule_listings(landed(spark, body), "örebro", "behrn arena", "Örebro Hockey", "orebro_hockey", "Örebro").collect()
        assert [(r.title, r.start_date, r.start_time, r.venue) for r in rows] == [("Örebro Hockey – AIK", "2026-10-01", "19:00", "Behrn Arena")]


def test_reference_csv_tolerates_a_byte_order_mark(spark, tmp_path):
    path = tmp_path / "ref.csv"
    path.write_text("﻿id,title,start_date,city\n1, Konsert ,2026-09-10,Örebro\n", encoding="utf-8")
    row = ingest.read_reference(spark, str(path)).first()
    assert (row.id, row.title, row.city, row.venue) == ("1", "Konsert", "Örebro", "")


def test_one_failed_source_is_a_status_row(spark):
    expected = spark.createDataFrame([("A", 0), ("B", 1), ("Lov Örebro", 2)], "source string, run_ord int")
    got = ingest.import_status(expected, spark.createDataFrame([("A",), ("A",)], "source string"), spark.createDataFrame([("B", "ReadTimeout")], "source string, error_class string")).collect()
    assert [(r.source, r.status, r.imported) for r in got] == [("A", "OK", 2), ("B", "Fel", 0), ("Lov Örebro", "Säsongstom", 0)]
    assert got[1].comment == "Tidsgränsen för källan överskreds."


def test_first_and_last_wins_and_publish_gate(spark):
    rows = [dict(title="A ", venue="1", start_date="2026-09-12", city="Örebro", official_url="https://a.se"), dict(title="a", venue="2", start_date="2026-09-12", city="Örebro"), dict(title="B", start_date="2026-09-01", city="Örebro", official_url="https://a.se"), dict(title="C", start_date="2026-09-12", city="Kumla", official_url="https://a.se")]
    df = listings(spark, rows)
    assert sorted(r.venue for r in ingest.unique_in_source(df).filter("start_date = '2026-09-12' and city = 'Örebro'").collect()) == ["1"]
    assert sorted(r.venue for r in ingest.unique_in_source(df, last=True).filter("start_date = '2026-09-12' and city = 'Örebro'").collect()) == ["2"]
    assert [(r.title, r.data_quality) for r in ingest.publish(df, TODAY).collect()] == [("A ", "source_verified")]
    assert ingest.from_records(ingest.to_records(df)).count() == 4
    assert registry.enabled(spark.createDataFrame([("elmia",), ("x",)], "source_key string"), ["elmia", "nope"]).count() == 1


def test_assemble_tags_and_orders(spark, tmp_path):
    a = listings(spark, [dict(title="Rock konsert", tags=["Musik"])]).withColumns({"source_ord": F.lit(0), "row_ord": F.lit(0)})
    b = listings(spark, [dict(title="Okänt")]).withColumns({"source_ord": F.lit(1), "row_ord": F.lit(0)})
    out = ingest.assemble(b, a).orderBy("ingest_ord")
    assert [(r.title, r.tags) for r in out.collect()] == [("Rock konsert", ["Konsert", "Musik"]), ("Okänt", [])]
    ingest.write_catalogue(out, str(tmp_path / "c"))
    assert ingest.read_catalogue(spark, str(tmp_path / "c")).count() == 2


EXPECTATIONS = [
    # One page for each rule, with the value it must or must not give.
    ("start_time", "<section><p>Föreställning</p><p>17.15-19.40</p></section>", "17:15"),
    ("end_time", "<section><p>Föreställning</p><p>17.15-19.40</p></section>", "19:40"),
    ("start_time", "<p>Mingel från 16:10</p><p>16:45 - start i trädgården</p>", "16:45"),
    ("end_time", "<p>16:45 - start i trädgården</p>", None),
    ("end_time", "<p>21:05 - slut på visningen</p>", None),
    ("start_time", "<p>Kundservice svarar under evenemang 08:30-15:45</p>", None),
    ("start_time", "<p>Evenemang 25:10-26:40</p>", None),
    ("price", "<ul><li>Pris: från 75 kronor</li><li>Fika ingår</li></ul>", "75.0"),
    ("price", "<ul><li>Parkering kostar 45 kr</li><li>Program 15 kr</li></ul>", None),
    ("price", "<div>Entrépris - 240,00 kr i dörren</div>", "240.0"),
    ("door_time", "<p>Insläpp sker kl. 17.05 från parken</p>", "17:05"),
    ("door_time", "<p>Dörrar öppnar 18.20</p><p>Insläpp 17.50</p>", "17:50"),
    ("age_limit", "<p>åldersgräns - 15 år utan vuxen</p>", "15 år utan vuxen"),
    ("age_limit", "<h3>Åldersgräns:</h3><p>Ingen</p>", "Ingen"),
    ("venue", "<h4>Hitta till Conventum Kongress.</h4>", "Conventum Kongress"),
    ("venue", "<h4>Hitta till trädgården</h4>", None),
    ("booking_url", '<p><a href="https://www.tickster.com/sv/visning-9">Boka biljett</a></p>', "https://www.tickster.com/sv/visning-9"),
    ("booking_url", '<p><a href="../biljetter/visning">Boka</a></p>', "https://www.conventum.se/biljetter/visning"),
    ("booking_url", '<p><a href="https://www.instagram.com/p/9">Boka biljett</a></p>', None),
    ("booking_url", '<p><a href="mailto:kassan@conventum.se">Boka biljett</a></p>', None),
    ("booking_url", '<p><a href="https://kassa.example/9">Boka biljett</a></p>', None),
]


def test_expectation_table(spark):
    rows = [(i, "Conventum", f, h, e, "https://www.conventum.se/event/1") for i, (f, h, e) in enumerate(EXPECTATIONS)]
    table = spark.createDataFrame(rows, "id int, source string, field string, html string, expected string, url string")
    got = page_functions.facts(table.drop("expected", "source"))
    cells = {"start_time": "showtime.start_time", "end_time": "showtime.end_time", "booking_url": "booking.url"}
    value = F.coalesce(*[F.when(F.col("field") == f, F.col(cells.get(f, f)).cast("string")) for f in ("start_time", "end_time", "price", "door_time", "age_limit", "venue", "booking_url")])
    checked = evidence.check_expectations(table, got.select("id", value.alias("value")))
    assert [(r.field, r.actual, r.expected) for r in checked.filter(~F.col("passed")).collect()] == []
    summary = evidence.expectation_summary(checked).first()
    assert (summary.total, summary.failed) == (len(EXPECTATIONS), 0)


def test_known_start_makes_a_range_sure_and_is_the_start_of_a_marked_end(spark):
    cases = [
        ("Reception 09:20-16:50", "09:20", ("09:20", "16:50", "explicit_range")), ("09:20-16:50", None, None), ("Kvällen 22:15 – Slut", "18:40:00", ("18:40", "22:15", "explicit_end_marker")),
        ("Kvällen 18:40 - start", "18:50", None), ("Tider 10:00-11:00, sedan 18:40-22:15", "18:40", ("18:40", "22:15", "explicit_range")), ("", None, None), (None, "18:40", None),
    ]
    df = spark.createDataFrame([(i, t, k) for i, (t, k, _) in enumerate(cases)], "i int, text string, known string")
    got = df.select("i", page_functions.stated_showtime(F.col("text"), F.col("known")).alias("s")).orderBy("i").collect()
    assert [r.s and tuple(r.s) for r in got] == [want or (None, None, None) for *_, want in cases]


def test_links_are_resolved_segment_by_segment(spark):
    cases = [("../../../../x", "/x"), ("../x?a=../b", "/a/b/c/x?a=../b"), ("./y", "/a/b/c/d/y"), ("..", "/a/b/c/"), ("/p/./q/../r/", "/p/r/"), ("z", "/a/b/c/d/z"), ("../../../../../../v", "/v")]
    df = spark.createDataFrame([("https://c.se/a/b/c/d/e", h, w) for h, w in cases], "page string, href string, want string")
    got = df.select(booking.absolute_url("page", "href").alias("got"), "want").collect()
    assert [r.got for r in got] == ["https://c.se" + r.want for r in got]


def test_all_links_of_a_page_are_kept(spark):
    html = "".join(f'<a href="/v/{i}">visning</a>' for i in range(60))
    raw = spark.createDataFrame([("https://c.se/", "conventum", html)], "url string, source_key string, html string")
    assert page_jobs.detail_links(raw, "/v/").count() == 60 and page_jobs.detail_links(raw, "/v/", 7).count() == 7


def test_snippets_are_found_in_the_page_spelling(spark):
    df = spark.createDataFrame([("https://c.se/1", "<p>Biljettpris: 80 kr</p><p>Föreställning 09.05-10.30</p>")], "url string, html string")
    rows = {r.field: r for r in page_functions.evidence(page_functions.facts(df), ["start_time", "end_time", "price"]).collect()}
    assert all(r.status == "parser_candidate" for r in rows.values())
    assert "80 kr" in rows["price"].snippet and "09.05" in rows["start_time"].snippet and "10.30" in rows["end_time"].snippet


def test_evidence_never_claims_without_a_value(spark):
    df = spark.createDataFrame([("https://a.se/1", "<p>Längd ca 90 minuter. Pris se kassan.</p>"), ("https://a.se/2", ""), ("https://a.se/3", "<p>Biljettpris: 80 kr</p>")], "url string, html string")
    rows = {(r.url[-1], r.field): r for r in page_functions.evidence(page_functions.facts(df), ["end_time", "price", "booking"]).collect()}
    assert (rows["1", "end_time"].status, rows["1", "end_time"].kind) == ("no_exact_value", "duration_only")
    assert rows["1", "price"].status == "manual_review" and "Pris" in rows["1", "price"].snippet
    assert rows["2", "price"].kind == "empty_page" and rows["3", "price"].value == "80.0" and rows["3", "booking"].status == "analysed_elsewhere"


def test_rules_read_different_calendars(spark):
    box = lambda title, when, href="/e/1": f'<article><h3><a href="{href}">{title}</a></h3><p>{when}</p></article>'
    pages = [
        ("https://elmia.se/k", "elmia", box("Stormässan", "9 - 13 sep. 2026") + box("Utan datum", "snart")),
        ("https://c.se/k/", "conventum", box("Kväll", "tisdag 8/9", "/arrangemang/kvall") + box("Fel länk", "9/9", "/om")),
        ("https://v.se/a", "visitorebro_editorial", "<p>Sommaren 2026</p><p>9/9–12/9 Jazzdagar. Parken (G)</p><p>10/9 Ö</p>"),
        ("https://www.orebroteater.se/f", "orebro_teater", '<h2>12 september 2026</h2><a href="/forestallningar/x">Pjäsen</a><a href="/k">Köp biljett</a><h2>Mer</h2><a href="/forestallningar/y">Andra pjäsen</a>'),
        ("https://www.oru.se/k", "orebro_university", '<a href="/1">Öppen föreläsning 15 september 2026 18:00 Örebro Öppet för alla</a><a href="/2">Internt 15 september 2026 Örebro</a>'),
        ("https://osk.se/m", "osk_fotboll", "<div>2026-09-20</div><div>15:00</div><div>ÖSK - AIK</div><div>Behrn Arena</div><div>2026-09-20</div><div>AIK - ÖSK</div><div>Friends</div>"),
        ("https://kh.se/e/1", "orebro_konserthus", "<h1>Symfoni</h1><p>Lördag 3 oktober 2026 kl 16.00, 150-300 kronor</p>"),
    ]
    raw = spark.createDataFrame([(u, k, h, None, "list") for u, k, h in pages], "url string, source_key string, html string, fetched_at timestamp, page_kind string")
    got = {r.title: r for r in page_jobs.extract(raw, TODAY).collect()}
    assert (got["Stormässan"].start_date, got["Stormässan"].end_date, got["Stormässan"].city) == ("2026-09-09", "2026-09-13", "Jönköping")
    assert got["Kväll"].official_url == "https://c.se/arrangemang/kvall" and "Fel länk" not in got and "Utan datum" not in got
    assert (got["Jazzdagar"].venue, got["Jazzdagar"].price_status, got["Jazzdagar"].end_date) == ("Parken", "free", "2026-09-12")
    assert got["Pjäsen"].start_date == got["Andra pjäsen"].start_date == "2026-09-12" and "Köp biljett" not in got
    assert got["Öppen föreläsning"].start_time == "18:00" and "Internt" not in got
    assert got["ÖSK - AIK"].start_date == "2026-09-20" and "AIK - ÖSK" not in got
    assert (got["Symfoni"].price_min, got["Symfoni"].price_max, got["Symfoni"].start_time) == (150.0, 300.0, "16:00")


def test_enrichment_fills_gaps_only(spark):
    html = '<h2>HITTA TILL CONVENTUM ARENA</h2><p>Dörrarna öppnar 18:00</p><p>Biljettpris: 395 kr</p><p>Evenemang 19:00–22:30</p><a href="https://secure.tickster.com/e/1">Köp biljett</a>'
    raw = spark.createDataFrame([("https://c.se/1", "conventum", html, None, "detail")], "url string, source_key string, html string, fetched_at timestamp, page_kind string").withColumn("fetched_at", F.lit("2026-09-10").cast("timestamp"))
    rows = [dict(official_url="https://c.se/1", venue="Conventum"), dict(official_url="https://c.se/1", venue="Annan", start_time="19:00", price_status="free", booking_url="https://b.se/x"), dict(official_url="https://c.se/2")]
    got = page_jobs.enrich(listings(spark, rows), raw).orderBy("ingest_ord").collect()
    assert (got[0].start_time, got[0].end_time, got[0].door_time, got[0].venue, got[0].price_min, got[0].price_status, got[0].booking_partner) == ("19:00", "22:30", "18:00", "Conventum Arena", 395.0, "known", "Tickster")
    assert got[0].quality_notes == [page_jobs.TIME_NOTE, page_jobs.FACT_NOTE, page_jobs.LINK_NOTE]
    assert (got[1].venue, got[1].price_status, got[1].booking_url, got[1].end_time) == ("Annan", "free", "https://b.se/x", "22:30") and got[2].quality_notes == []
    links = page_jobs.detail_links(spark.createDataFrame([("https://c.se/", "conventum", '<a href="/e/1">a</a><a href="/e/2">b</a><a href="/e/1">c</a><a href="/">d</a>')], "url string, source_key string, html string"), "/e/")
    assert [(r.url, r.n) for r in links.orderBy("n").collect()] == [("https://c.se/e/1", 1), ("https://c.se/e/2", 2)]


def test_ordinals_differ_across_pages_and_events(spark):
    from playbill.sources.ingest import ordinal

    places = [(p, i, o) for p in (0, 1) for i in (0, 999, 1000, 1001) for o in (0, 1000, 1001)]
    rows = spark.createDataFrame(places, "p int, i int, o int").select("p", "i", "o", ordinal(F.col("p"), F.col("i"), F.col("o")).alias("n")).collect()
    assert [r["n"] for r in sorted(rows, key=lambda r: (r["p"], r["i"], r["o"]))] == sorted({r["n"] for r in rows}) and len({r["n"] for r in rows}) == len(places)


def test_two_pages_of_one_source_share_no_ordinal(spark):
    import datetime as dt

    from playbill.sources import pages, rules

    key = next(r[0] for r in rules.RULES)
    box = lambda n: f"<html><body><article><h2>Kväll nummer {n}</h2><p>{n} oktober 2026 kl 19.30, örebro</p><a href='/events/{n}'>Mer</a></article></body></html>"
    raw = spark.createDataFrame([(f"https://a.example.org/{n}", key, box(n), None, "list") for n in (3, 4)], "url string, source_key string, html string, fetched_at timestamp, page_kind string")
    found = [r["ingest_ord"] for r in pages.extract(raw, dt.date(2026, 9, 1)).collect()]
    assert len(found) == len(set(found))
