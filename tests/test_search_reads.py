"""Rows that no request can take, or that name no candidate, cost no text work."""

import datetime as dt
import random

from playbill import vocab
from playbill.functions import quality, scoring
from playbill.functions.scoring import SearchRequest
from playbill.functions.text import search_text_py
from playbill.operators import candidates, ranking
from tests.factory import listings

TODAY, NOW = dt.date(2026, 9, 10), dt.datetime(2026, 9, 10, 12)


def rows(n=80, seed=2):
    rnd = random.Random(seed)
    pick = lambda *values: rnd.choice(values)
    day = lambda: pick(None, "no day", *[(TODAY + dt.timedelta(days=d)).isoformat() for d in (-3, 0, 5, 20, 70, 200)])
    return [
        dict(
            title=pick("Jazz i Örebro", "Läs mer", "Rock", "", None), source_count=1, start_date=day(), end_date=day(), city=pick("Örebro", "Malmö", "", None), venue=pick("Rockbaren", None),
            event_type=pick("Konsert", "Mässa", None), price_status=pick("free", "known", None), price_min=pick(50.0, 900.0, None), is_demo=pick(True, False, None),
            source_names=pick(["A"], ["A", "B"], ["B", "B"], ["C", None], [], None), excluded_dates=pick([], None, [TODAY.isoformat(), None]), tags=pick([], ["rock"], [None]),
        )
        for _ in range(n)
    ]


REQUESTS = [
    SearchRequest("rock", TODAY, NOW, None, "next_7_days", None, "any", "rock"), SearchRequest("near_rock", TODAY, NOW, "Örebro", "next_30_days", 50, "max_100", "ROCK!"),
    SearchRequest("music", TODAY, NOW, None, "today", interests=("Musik",)), SearchRequest("any", TODAY, NOW), SearchRequest("marks", TODAY, NOW, "Malmö", "today", 25, "any", "!!"),
]


def test_texts_are_normalised_only_for_rows_that_a_reading_request_may_take(spark):
    df = listings(spark, rows())
    prepared, _ = ranking.prepare(df, REQUESTS)
    got = {r.ingest_ord: r.s_all for r in prepared.select("ingest_ord", "s_all").collect()}
    far = [i for i, r in enumerate(rows()) if r["start_date"] and r["start_date"] > "2026-10-10" and r["start_date"][0] == "2"]
    assert far and all(got[i] is None for i in far if i in got) and any(got.values())


def test_scores_are_those_of_texts_of_all_rows(spark, monkeypatch):
    df = listings(spark, rows())
    key = lambda found: sorted((r.request_id, r.ingest_ord, r.score, tuple(r.reasons), r.distance_km) for r in found.collect())
    got = key(ranking.score_requests(df, REQUESTS))
    plain = scoring.with_search_columns
    monkeypatch.setattr(scoring, "with_search_columns", lambda df, where=None: plain(df))
    assert got == key(ranking.score_requests(df, REQUESTS)) and {g[0] for g in got} >= {"rock", "near_rock", "music", "any"}


def test_visibility_reads_the_title_alone_for_noise(spark, tmp_path):
    listings(spark, rows()).write.parquet(str(tmp_path / "l"))
    plan = ranking.visible(spark.read.parquet(str(tmp_path / "l")), TODAY).select("id")._jdf.queryExecution().executedPlan().toString()
    assert "source_records" not in plan
    titles = [*vocab.NOISE_TITLES, "Läs  mer!", "program 2", "http x", "https://a.se", "www", "httpx y", "", None, "   ", "!!!", "12 maj", "19:30", "kl 19", "Jazz\nprogram", "program\n", "Öl"]
    df = listings(spark, [dict(title=t) for t in titles])
    got = {r.ingest_ord: r for r in df.select("ingest_ord", quality.is_noise().alias("high"), quality.noise_severity().alias("severity")).collect()}
    buttons = {search_text_py(t) for t in vocab.NOISE_TITLES}
    for i, t in enumerate(titles):
        norm = search_text_py(t)
        if norm in buttons or norm == "" or norm.startswith(("http ", "https ", "www ")):
            assert got[i].high, t
        assert (got[i].severity == "high") == got[i].high, t
    assert not any(got[titles.index(t)].high for t in ("program 2", "httpx y", "Jazz\nprogram", "www"))


def test_candidate_audit_drops_other_listings_first_and_reads_each_side_once_for_its_sets(spark, tmp_path):
    data = rows(120, 5)
    listings(spark, data).write.parquet(str(tmp_path / "l"))
    df = spark.read.parquet(str(tmp_path / "l"))
    audit = candidates.candidate_value_audit(df, df, df, ["A", "B", "Z"], TODAY)
    plan = audit._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("arrays_overlap(source_names") == 4  # two counts, and one pass of each side for all sets
    for r in audit.collect():
        mine = [x for x in data if r.source in (x["source_names"] or [])]
        sole = [x for x in mine if len(set(x["source_names"])) == 1]
        kinds = lambda found: sorted({x["event_type"] or vocab.UNKNOWN for x in found})
        assert (r.candidate_events, r.unique_events, r.overlap_events) == (len(mine), len(sole), len(mine) - len(sole))
        assert (r.event_types, r.unique_event_types) == (kinds(mine), kinds(sole)) and set(r.underserved_segments) <= set(r.unique_frontier_segments) <= set(r.frontier_segments)
        assert r.frontier_segments == sorted(set(r.frontier_segments)) and bool(r.frontier_segments) == bool(mine)
