"""Requests as a table against requests as constants."""

import datetime as dt
import random

from pyspark.sql import functions as F

from playbill import vocab
from playbill.functions.scoring import SearchRequest
from playbill.operators import ranking, relaxation, request_join
from tests.factory import listings

TODAY, NOW = dt.date(2026, 9, 10), dt.datetime(2026, 9, 10, 12)
CITIES = ["Örebro", "Stockholm", "Malmö", "Kumla", "Oslo", "Köpenhamn", "", "Atlantis"]


def catalogue(spark, n, seed=1):
    rnd = random.Random(seed)
    rows = []
    for i in range(n):
        start = TODAY + dt.timedelta(days=rnd.randint(-200, 200))
        end = rnd.choice([None, None, start + dt.timedelta(days=rnd.choice([0, 1, 5, 31, 33, 70, 300, 3000]))])
        point = rnd.random() < 0.3
        rows.append(dict(
            id=f"e{i}", title=rnd.choice(["Jazz i parken", "Rockkväll", "Teater för barn", ""]), event_type=rnd.choice(["Konsert", "Teater", "Mässa"]), city=rnd.choice(CITIES), venue=rnd.choice(["", "Slottet", "Örebro"]),
            start_date=rnd.choice([start.isoformat()] * 9 + ["bad"]), end_date=end and end.isoformat(), latitude=rnd.uniform(54, 66) if point else None, longitude=rnd.uniform(9, 22) if point else None,
            price_status=rnd.choice(["free", "known", "unknown"]), price_min=rnd.choice([0.0, 60.0, 180.0, 900.0]), excluded_dates=rnd.choice([[], [start.isoformat()]]), description=rnd.choice(["", "musik och mat"]), source_names=rnd.choice([["A"], ["A", "B"]]),
        ))
    return listings(spark, rows).withColumn("is_new", F.expr("ingest_ord % 3 = 0"))


def requests(n, seed=2):
    rnd = random.Random(seed)
    return [
        SearchRequest(
            f"r{i}", TODAY, NOW, rnd.choice([None, *CITIES[:-2], "Atlantis", "Malmö kommun"]), rnd.choice([*vocab.PRESET_DAYS, "any"]), rnd.choice([None, 10, 25, 100, 300, 5000, 20000]), rnd.choice(list(vocab.PRICE_LIMITS)),
            rnd.choice(["", "", "jazz", "Örebro", "MUSIK", "zzz"]), rnd.choice([None, None, "Teater"]), rnd.random() < 0.1, tuple(rnd.sample(list(vocab.INTEREST_PROFILES), rnd.randint(0, 3))),
        )
        for i in range(n)
    ]


def test_the_join_gives_what_the_constants_give(spark):
    df, asked = catalogue(spark, 250), requests(60)
    want = sorted((r.request_id, r.ingest_ord, r.score, tuple(r.reasons), r.distance_km) for r in ranking.score_requests(df, asked).collect())
    got = sorted((r.request_id, r.ingest_ord, r.score, tuple(r.reasons), r.distance_km) for r in request_join.scored(df, request_join.request_table(spark, asked)).collect())
    assert len(want) > 200 and got == want


def test_the_plan_does_not_grow_with_the_requests(spark):
    df = catalogue(spark, 50)
    plans = []
    for n in (10, 10_000):
        asked = spark.range(n).selectExpr(
            "concat('q', id) AS request_id", f"date'{TODAY}' AS today", "element_at(array('Örebro', 'Malmö', 'Oslo'), cast(id % 3 + 1 AS int)) AS origin_city", "'next_7_days' AS when", "cast(50 AS int) AS radius_km",
            "'any' AS price", "'' AS query", "cast(null AS string) AS type_filter", "false AS only_new", "cast(array() AS array<string>) AS interests",
        )
        out = request_join.scored(df, asked)
        plans.append(out._jdf.queryExecution().analyzed().toString().count("\n"))
        if n == 10_000:
            assert out.groupBy("request_id").count().count() <= n
    assert plans[0] == plans[1]


def test_relaxation_by_table_equals_relaxation_by_constants(spark):
    df = catalogue(spark, 120, 5)
    asked = [r for r in requests(40, 7) if r.radius_km != 20000]
    key = lambda rows: sorted((r.request_id, r.kind, r.step, r.hits, r.suggestion) for r in rows)
    table = request_join.request_table(spark, asked)
    want = key(relaxation.choose(relaxation.scenario_hits(df, asked)).collect())
    assert want and key(request_join.choose(request_join.hits(df, table)).collect()) == want
    shown = lambda rows: sorted((r.request_id, r.suggestion, r.position, r.id, r.score) for r in rows)
    assert shown(request_join.suggest(df, table).collect()) == shown(relaxation.suggest(df, asked).collect())


def test_a_listing_is_offered_once(spark):
    rows = [dict(title="Svansjön", event_type="Teater", start_date=f"2026-09-{d}", city="Örebro", price_status="known", price_min=900.0) for d in (12, 13, 25)] + [dict(title=f"Kväll {i}", start_date="2026-09-12", city="Kumla", price_status="known", price_min=900.0) for i in range(5)]
    asked = [SearchRequest("r", TODAY, NOW, "Örebro", "weekend", 5, "max_100")]
    got = relaxation.suggest(listings(spark, rows), [SearchRequest("r", TODAY, NOW, "Örebro", "today", 25)]).orderBy("suggestion", "position").collect()
    assert asked and [(r.kind, r.position) for r in got] and len({r.id for r in got}) == len(got)
    assert sum(r.title == "Svansjön" for r in got) == 1


def test_no_requests_and_no_listings(spark):
    df, none = catalogue(spark, 5), request_join.request_table(spark, [])
    assert request_join.scored(df, none).collect() == [] and request_join.hits(df, none).collect() == []
    assert request_join.scored(df.limit(0), request_join.request_table(spark, requests(3))).collect() == []
