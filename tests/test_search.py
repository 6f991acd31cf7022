"""Ranking, diversification and relaxation against plain loops."""

import datetime as dt
import random

from pyspark.sql import functions as F

from playbill.functions.scoring import SearchRequest
from playbill.operators import ranking, relaxation
from tests.factory import listings

TODAY, NOW = dt.date(2026, 9, 10), dt.datetime(2026, 9, 10, 12)


def diversified(rows):
    """Rows (score, type, venue, day, title, ord) in base order -> presentation order."""
    left, done = sorted(rows, key=lambda r: (-r[0], r[3], r[4].lower(), r[5])), []
    if len(left) < 3:
        return left
    while left and len(done) < 10:
        best = left[0][0]

        def key(r):
            cost = min(6, 3 * sum(x[1] == r[1] for x in done[-3:])) + min(4, 4 * sum(bool(r[2]) and x[2] == r[2] for x in done[-2:])) + min(2, 2 * sum(x[3] == r[3] for x in done[-2:]))
            return (-(r[0] - cost), -r[0], r[3], r[4].lower())

        pick = min((r for r in left if r[0] >= best - 8), key=key)
        done.append(pick)
        left.remove(pick)
    return done + left


def test_diversification_equals_the_plain_loop_and_hot_slots_are_pruned(spark):
    rnd = random.Random(3)
    rows = []
    for q in range(12):
        n = rnd.choice([1, 2, 5, 40, 300])
        for i in range(n):
            rows.append((f"q{q}", rnd.choice([40, 41, 43, 47, 50]), ["x"], None, f"e{i}", i, rnd.choice("ABCdef"), rnd.choice(["T1", "T2", "T3"]), rnd.choice(["", "V1", "V2", "V3"]), f"2026-09-{rnd.randint(10, 14)}"))
    df = spark.createDataFrame(rows, "request_id string, score int, reasons array<string>, distance_km int, id string, ingest_ord bigint, title string, event_type string, venue string, start_date string")
    got = {}
    for r in ranking.diversify(df, 20).collect():
        got.setdefault(r.request_id, []).append((r.position, r.ingest_ord))
    for q in {r[0] for r in rows}:
        want = diversified([(r[1], r[7], r[8], r[9], r[6], r[5]) for r in rows if r[0] == q])[:20]
        assert [o for _, o in sorted(got[q])] == [w[5] for w in want], q


def test_scores_are_explainable(spark):
    rows = [
        dict(title="Jazzkväll", start_date="2026-09-10", city="Örebro", price_status="free", source_names=["A", "B"]), dict(title="Rock", start_date="2026-09-15", city="Kumla"),
        dict(title="", start_date="2026-09-10", city="Örebro"), dict(title="Teater", start_date="2026-09-10", city="Malmö"), dict(title="Demo", start_date="2026-09-10", city="Örebro", is_demo=True),
    ]
    r = SearchRequest("r", TODAY, NOW, "Örebro", "next_30_days", 50)
    got = {x.ingest_ord: x for x in ranking.score_requests(listings(spark, rows), [r]).collect()}
    assert set(got) == {0, 1, 2, 4}
    assert (got[0].score, got[0].reasons) == (30 + 30 + 14 + 5, ["very_near", "today", "free"])
    assert got[1].score == 25 + 20 + 2 and got[2].score == 18 and got[2].reasons == ["very_near", "today", "incomplete_core"] and got[4].score < 0


def test_interests_and_query_points(spark):
    rows = [dict(title="Rockfestival i Örebro", start_date="2026-09-30", city="Nora"), dict(title="Kväll", venue="Rockbaren", start_date="2026-09-30"), dict(title="Kväll", description="rock", start_date="2026-09-30", city="Nora")]
    r = SearchRequest("r", TODAY, NOW, None, "any", None, "any", "röck", interests=("Musik", "Sport"))
    got = {x.ingest_ord: (x.score, x.reasons[0]) for x in ranking.score_requests(listings(spark, rows), [r]).collect()}
    assert got[0] == (26 + 12 + 10 + 2, "query_title") and got[1][0] == 16 + 10 + 2 and got[2][0] == 5 + 12 + 10 + 2


def test_visible_hides_noise_demo_and_past(spark):
    rows = [dict(title="Konsert", start_date="2026-09-12"), dict(title="Läs mer", start_date="2026-09-12"), dict(title="Förr", start_date="2026-09-01"), dict(title="Demo", start_date="2026-09-12", is_demo=True), dict(title="Golf", event_type="Sport", start_date="2026-09-12")]
    assert [r.title for r in ranking.visible(listings(spark, rows), TODAY).collect()] == ["Konsert"]


def test_relaxation_changes_one_constraint_first(spark):
    rows = [dict(title="Långt fram", start_date="2026-09-30", city="Örebro"), dict(title="Längre bort", start_date="2026-09-10", city="Karlskoga"), dict(title="Dyr", start_date="2026-09-10", city="Örebro", price_status="known", price_min=900.0)]
    near = SearchRequest("near", TODAY, NOW, "Örebro", "today", 25, "max_100")
    hit = SearchRequest("hit", TODAY, NOW, "Örebro", "today", 25)
    word = SearchRequest("word", TODAY, NOW, "Örebro", "today", 25, "any", "finns inte")
    both = SearchRequest("both", TODAY, NOW, "Kumla", "today", 25, "any", "längre fram")
    df = listings(spark, rows + [dict(title="Längre fram", start_date="2026-09-15", city="Karlskoga")])
    got = [(r.request_id, r.kind, r.step, r.hits) for r in relaxation.choose(relaxation.scenario_hits(df, [near, hit, word, both])).orderBy("request_id", "suggestion").collect()]
    assert got == [("both", "time_radius", 0, 1), ("near", "price", 0, 1)]
    free = [dict(r, price_status="free") for r in rows]
    got = relaxation.suggest(listings(spark, free[:2]), [near]).orderBy("suggestion", "position").collect()
    assert [(r.kind, r.step, r.id) for r in got] == [("time", 1, "e0"), ("radius", 0, "e1")]


def test_sponsor_never_lifts_an_irrelevant_listing(spark):
    base = dict(is_sponsored=True, sponsor_campaign_id="c", sponsor_company="C")
    rows = [dict(x, city="Nora") for x in (dict(title="A", start_date="2026-09-10"), dict(base, title="B", start_date="2026-09-10", sponsor_priority=1), dict(base, title="C", start_date="2027-09-10"), dict(base, title="D", start_date="2026-09-10", sponsor_start_date="bad"))]
    df = listings(spark, rows)
    keep = [c for c in df.columns if c.startswith(("sponsor", "is_sp"))]
    ranked = ranking.rank_top(ranking.score_requests(df, [SearchRequest("r", TODAY, NOW)], keep=keep), 12)
    assert [(r.id, r.slot) for r in ranking.sponsored(ranked, TODAY, None, []).collect()] == [("e1", 1)]
    short = ranking.shortlist(ranked, F.col("title") != "A", 2).orderBy("pick").collect()
    assert [r.id for r in short] == ["e1", "e3"]
    assert ranking.not_shown(ranked, ranking.shortlist(ranked, F.col("title") != "A", 2)).count() == 2
