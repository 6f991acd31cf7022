"""Column functions against hand-written expectations and the standard library."""

import datetime as dt
import re
import unicodedata

from pyspark.sql import functions as F

from playbill.functions import booking, classify, dates, geo, labels, quality, scoring, showtimes, text
from tests.factory import listings

TODAY = dt.date(2026, 9, 10)


def column(spark, expr, values, kind="string"):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, x {kind}")
    return [r.y for r in df.select("i", expr(F.col("x")).alias("y")).orderBy("i").collect()]


def test_normalisers_equal_the_standard_library_on_all_letters(spark):
    chars = [chr(c) for c in range(0x20, 0x3400)] + ["ﬁ", "Ａ", "𝐀", "½", "№"]
    values = [f"a{c}b" for c in chars] + ["Café LIVE 2026 tour", "Örebro kommun", "x & y"]

    def decomposed(v):
        return "".join(c for c in unicodedata.normalize("NFKD", v) if not unicodedata.combining(c))

    squeeze = lambda v: " ".join(re.sub(r"[^a-z0-9]+", " ", v).split())
    want = [squeeze(decomposed(v).lower()) for v in values]
    assert column(spark, text.search_text, values) == want
    assert [text.search_text_py(v) for v in values] == want
    ascii_only = [unicodedata.normalize("NFKD", v).encode("ascii", "ignore").decode() for v in values]
    drop = lambda v: squeeze(re.sub(r"\b(kommun|stad|city|sweden|sverige)\b", " ", v, flags=re.I).lower())
    assert column(spark, text.city_key, values) == [drop(v) for v in ascii_only]


def test_title_identity(spark):
    got = column(spark, text.title_identity, ["Stand-Up kväll", "ösk - AIK", "Kväll kl 19:00", "Kväll - 19.30", "X – extrainsatt matinéföreställning", "Show LIVE 2026", None])
    assert got == ["standup kvall", "orebro sk aik", "kvall", "kvall", "x", "show", ""]


def test_clean_names_ignore_blanks_and_repeats(spark):
    df = spark.createDataFrame([([" B", "A", "", "A ", "C000"],)], "n array<string>")
    assert df.select(text.clean_names("n").alias("n")).first().n == ["A", "B", "C000"]


def test_swedish_phrases(spark):
    phrases = ["9 - 13 sep. 2026", "30 sep. - 1 okt. 2026", "3 november", "28–29 september", "12 maj – 15 augusti", "5 januari", "31 februari", "inget datum", "26 › 27 SEP 2027"]
    got = column(spark, lambda c: dates.swedish_range(c, TODAY), phrases)
    day = lambda r: (str(r.start), str(r.end)) if r else None
    assert [day(r) for r in got] == [
        ("2026-09-09", "2026-09-13"), ("2026-09-30", "2026-10-01"), ("2026-11-03", "2026-11-03"), ("2026-09-28", "2026-09-29"), ("2027-05-12", "2027-08-15"), ("2027-01-05", "2027-01-05"),
        None, None, ("2027-09-26", "2027-09-27"),
    ]


def test_numeric_dates(spark):
    got = column(spark, lambda c: dates.numeric_day(c, TODAY), ["tisdag 8/9", "8/3", "31/2", "1/1/2028", "x"])
    assert [str(x) if x else None for x in got] == ["2026-09-08", "2027-03-08", None, "2028-01-01", None]
    lines = ["9/9 Konsert. Parken", "9-12/9 Utställning", "30/9–2/10 Mässa. Hallen", "Nyheter 9/9"]
    got = column(spark, lambda c: dates.numeric_prefix(c, F.lit(2026)), lines)
    assert [(str(r.start), str(r.end), r.rest) if r else None for r in got] == [
        ("2026-09-09", "2026-09-09", "Konsert. Parken"), ("2026-09-09", "2026-09-12", "Utställning"), ("2026-09-30", "2026-10-02", "Mässa. Hallen"), None,
    ]


def test_price_text_is_never_guessed(spark):
    got = column(spark, dates.explicit_price, ["Fri entré", "120-250 kronor", "90 kronor", "Garderob 30", None])
    assert [(r.low, r.high, r.status) for r in got] == [(None, None, "free"), (120.0, 250.0, "known"), (90.0, 90.0, "known"), (None, None, "unknown"), (None, None, "unknown")]


def test_periods(spark):
    rows = [
        dict(start_date="2026-09-08", end_date="2026-09-12"), dict(start_date="2026-09-12", end_date="2026-09-12", excluded_dates=["2026-09-12"]), dict(start_date="not-a-date"),
        dict(start_date="2026-09-20", end_date="2026-09-01"), dict(start_date="2026-09-17"), dict(start_date="2026-09-18"), dict(start_date="20260911"),
    ]
    df = listings(spark, rows)
    hit = lambda preset, today=TODAY: [r.ingest_ord for r in df.filter(dates.period_matches("start_date", "end_date", "excluded_dates", preset, today)).orderBy("ingest_ord").collect()]
    assert hit("today") == [0]
    assert hit("weekend") == [0]
    assert hit("next_7_days") == [0, 4]
    assert hit("any") == [0, 3, 4, 5]
    assert dates.window_of("weekend", dt.date(2026, 9, 13)) == (dt.date(2026, 9, 13), dt.date(2026, 9, 13))


def test_budget_never_accepts_unknown_prices(spark):
    rows = [
        dict(price_status="free"), dict(price_status="known", price_min=80.0), dict(price_status="known", price_min=float("nan")), dict(price_status="known", price_min=float("inf")),
        dict(price_status="known", price_min=-1.0), dict(price_status="known", price_min=50.0, currency="EUR"), dict(price_status="unknown", price_min=10.0), dict(price_status="known"),
    ]
    got = [r.ingest_ord for r in listings(spark, rows).filter(scoring.price_matches("max_100")).collect()]
    assert sorted(got) == [0, 1]


def test_locations_are_not_invented(spark):
    rows = [dict(city="örebro kommun"), dict(city="Okänd ort"), dict(city="", latitude=59.0, longitude=15.0), dict(city="Gothenburg", venue_latitude=57.0, venue_longitude=12.0), dict(city="Malmö")]
    got = listings(spark, rows).select("ingest_ord", geo.resolve_location().alias("l")).orderBy("ingest_ord").collect()
    assert [r.l.confidence for r in got] == ["city", "unknown", "exact", "venue", "city"]
    km = listings(spark, rows).withColumn("l", geo.resolve_location()).select(geo.distance_km(F.col("l.lat"), F.col("l.lon"), "Örebro").alias("km")).collect()
    assert km[0].km == 0 and km[1].km is None and km[4].km > 400
    assert geo.known_origin("Atlantis") is None


def test_showtimes(spark):
    now = dt.datetime(2026, 9, 10, 16, 30)
    rows = [
        dict(start_date="2026-09-10", start_time="17:30"), dict(start_date="2026-09-10", start_time="19:00"), dict(start_date="2026-09-10", start_time="15:00"),
        dict(start_date="2026-09-10", start_time="15:00", end_time="17:00"), dict(start_date="2026-09-11"), dict(start_date="2026-09-11", start_time="10:00"), dict(start_date="2026-09-10"),
        dict(start_date="2026-09-10", start_time="16:00", end_time="01:00"), dict(start_date="2026-09-10", start_time="25:00"),
    ]
    df = listings(spark, rows).orderBy("ingest_ord")
    assert [r.s for r in df.select(showtimes.status(now).alias("s")).collect()] == ["soon", "tonight", "started", "now", "tomorrow", "tomorrow", None, "now", None]
    assert [r.m.label if r.m else None for r in df.select(showtimes.last_minute(now).alias("m")).collect()][:2] == ["in 1 h", "in 2 h 30 min"]
    band = lambda km: [r.b for r in df.select(showtimes.go_now_band(now, F.lit(km)).alias("b")).collect()][:2]
    assert band(5) == ["near", "near"] and band(12) == [None, "fairly_near"] and band(40) == [None, "further_away"]


def test_a_dst_night_counts_clock_time(spark):
    df = listings(spark, [dict(start_date="2026-10-25", start_time="04:00")])
    assert df.select(showtimes.minutes_to_start(dt.datetime(2026, 10, 25, 1, 0)).alias("m")).first().m == 180


def test_booking_claims_are_conservative(spark):
    rows = [
        dict(booking_url="https://x.se/a"), dict(ticket_url="https://www.ticketmaster.se/event/1"), dict(ticket_url="https://x.se/kalender/1"), dict(ticket_url="https://x.se/"),
        dict(official_url="https://x.se/boka/1"), dict(official_url="https://x.se/sv"), dict(),
    ]
    got = booking.with_cta(listings(spark, rows)).orderBy("ingest_ord").select("cta_quality", "cta.label", "cta.confidence").collect()
    assert [tuple(r) for r in got] == [
        ("bookable", "book", "high"), ("bookable", "buy_ticket", "high"), ("useful", "see_times", "medium"), ("weak", "read_more", "low"), ("useful", "read_more", "high"), ("weak", "read_more", "low"), ("missing", None, None),
    ]
    urls = ["https://secure.tickster.com/x", "https://www.nortic.se", "https://mytickster.com", "http://WWW.Ex.se", "nonsense", None]
    assert [r.key for r in column(spark, booking.attribution, urls)] == ["tickster", "nortic", "direct", "direct", "unknown", "unknown"]
    assert column(spark, booking.is_public_http, ["https://a.se/x", "http://localhost/", "http://10.0.0.1/x", "ftp://a.se", "https://a.local/", "http://172.20.1.1"]) == [True, False, False, False, False, False]
    joined = spark.createDataFrame([("https://a.se/x/y?q=1", h) for h in ("/b", "b", "../b", "https://c.se/d", "//c.se/d", "?p=2", "#top")], "p string, h string").select(booking.absolute_url("p", "h").alias("u"))
    assert [r.u for r in joined.collect()] == ["https://a.se/b", "https://a.se/x/b", "https://a.se/b", "https://c.se/d", "https://c.se/d", "https://a.se/x/y?p=2", "https://a.se/x/y?q=1#top".replace("?q=1", "")]


def test_taxonomy_upgrades_only_generic_buckets(spark):
    rows = [dict(title="Stand-up kväll", event_type="Evenemang", category="Okategoriserat"), dict(title="Fotboll: derby", event_type="Konsert", category="Okategoriserat"), dict(title="Pokémon expo", event_type="Evenemang", category="Okategoriserat"), dict(title="ÖREBRO SK möter", event_type="", category="")]
    got = classify.apply_taxonomy(listings(spark, rows)).orderBy("ingest_ord").collect()
    assert [(r.event_type, r.category) for r in got] == [("Stand-up", "Stand-up"), ("Konsert", "Sport"), ("Mässa", "Samlarkort"), ("Sport", "Sport")]
    assert got[2].tags == ["Samlarkort"]


def test_sport_scope(spark):
    rows = [
        dict(title="Badminton open", event_type="Sport"), dict(title="Hockey: hemma", event_type="Sport"), dict(title="Konsert", event_type="Konsert", description="tennis"), dict(title="Lagmatch", event_type="Sport"),
        dict(title="A – B", event_type="Sport", description="Allsvenskan"), dict(title="Marknad", event_type="Evenemang"),
    ]
    got = listings(spark, rows).orderBy("ingest_ord").select(classify.sport_allowed().alias("ok")).collect()
    assert [r.ok for r in got] == [False, True, True, False, True, True]


def test_quality_and_noise(spark):
    rec = lambda t: dict(source="S", external_id="1", source_url=None, fetched_at=None, raw_title=t, confidence=1.0, payload=None)
    rows = [
        dict(title="Konsert i parken", start_date="2026-09-10", city="Örebro"), dict(title="Köp biljett", start_date="2026-09-10", city="Örebro"), dict(title="12/9", start_date="2026-09-10", city="Örebro"),
        dict(title="AB", start_date="2026-09-10", end_date="2026-09-01", city=""), dict(title="Konserten", start_date="x", venue="V", source_records=[rec("Helt annat"), rec("Något annat")]),
    ]
    df = listings(spark, rows).orderBy("ingest_ord")
    assert [r.n for r in df.select(quality.noise_severity().alias("n")).collect()] == ["none", "high", "high", "review", "review"]
    got = df.select(quality.quality_level().alias("l"), quality.restricted_reasons().alias("r")).collect()
    assert [r.l for r in got] == ["pass", "pass", "pass", "restricted", "restricted"]
    assert got[3].r == ["end_before_start", "place_missing"] and got[4].r == ["start_invalid"]


def test_labels(spark):
    rows = [dict(price_status="known", price_min=120.0, price_max=250.5, start_date="2026-09-11", start_time="19:00:00", end_time="21:00", venue="V", city="Örebro"), dict(start_date="2026-09-01", end_date="2026-09-12", city="Örebro", venue="örebro")]
    got = listings(spark, rows).orderBy("ingest_ord").select(labels.price_label().alias("p"), labels.date_label(TODAY).alias("d"), labels.place_label().alias("v")).collect()
    assert [tuple(r) for r in got] == [("120–250.5 kr", "Imorgon · 19:00–21:00", "V, Örebro"), ("Pris saknas", "Pågår till lör 12 sep", "örebro")]
