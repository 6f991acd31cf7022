"""Catalogue reports, funnel, candidates and evidence."""

import datetime as dt

from pyspark.sql import functions as F

from playbill.operators import booking_reports, candidates, catalogue, evidence, funnel, signature
from playbill.schema import ENGAGEMENT, SNAPSHOT
from tests.factory import listings

TODAY = dt.date(2026, 9, 10)


def test_source_value_and_pairs(spark):
    rows = [dict(start_date="2026-09-12", source_names=[" A", "B"]), dict(start_date="2026-09-12", source_names=["A"]), dict(start_date="not-a-date", source_names=["A"]), dict(start_date="2026-10-10", source_names=["A"]), dict(start_date="2026-10-11", source_names=["A"]), dict(start_date="2026-09-12", source_names=["A"], is_demo=True)]
    df = listings(spark, rows)
    got = {r.source: r for r in catalogue.source_value(df, TODAY).collect()}
    assert (got["A"].represented, got["A"].unique_listings, got["A"].signal) == (3, 2, "mixed") and got["B"].signal == "too_little_data"
    assert [tuple(r) for r in catalogue.source_overlap_pairs(df, TODAY).collect()] == [("A", "B", 1)]
    totals = catalogue.source_value_totals(df, TODAY).first()
    assert (totals.listings, totals.sole_source, totals.multi_source) == (3, 2, 1)


def test_local_uniqueness_is_against_all_sources(spark):
    df = listings(spark, [dict(start_date="2026-09-12", source_names=["Conventum", "Other"], event_type="Konsert", booking_url="https://b.se/x"), dict(start_date="2026-09-12", source_names=["Conventum"], category="Kultur")])
    row = catalogue.local_audit(df, TODAY).first()
    assert (row.unique_listings, row.overlap_listings, row.bookable, row.categories, row.unique_categories) == (1, 1, 1, ["Konsert", "Kultur"], ["Kultur"])


def test_frontier_keeps_empty_segments_and_inner_words(spark):
    df = listings(spark, [dict(title="Match", start_date=f"2026-09-{d}", source_names=[s]) for d, s in ((11, "A"), (12, "B"), (13, "A"), (14, "Conventum"))] + [dict(title="Jul", start_date="2026-12-01", source_names=["A"])])
    got = {r.segment: r for r in catalogue.coverage_frontier(df, TODAY).collect()}
    assert len(got) == 16 and got["Publiksport"].status == "good" and got["Mat & dryck"].listings_30 == 4
    assert (got["Publiksport"].source_diversity, got["Publiksport"].trusted_sources) == (3, 1)
    season = got["Säsong & högtid"]
    assert (season.status, season.listings_30, season.listings_90, season.single_source) == ("thin", 0, 1, True) and got["Nattliv & klubb"].status == "missing"


def test_detail_coverage_gaps_and_cases(spark):
    rec = dict(source="A", external_id="1", source_url="https://a.se/1", fetched_at=None, raw_title=None, confidence=1.0, payload=None)
    rows = [dict(start_date="2026-09-12", start_time="19:00", venue="Örebro", city="Örebro", source_names=["A"], official_url="https://o.se") for _ in range(3)] + [dict(start_date="2026-09-11", venue="Scenen", source_names=["A", "B"], source_records=[rec], price_status="free")]
    df = listings(spark, rows)
    cov = {r.source: r for r in catalogue.detail_coverage(df, TODAY).collect()}
    a = cov["A"]
    assert (a.represented, a.single_source, a.precise_venue_listings, a.price_listings, a.single_start_time_listings) == (4, 3, 1, 1, 3)
    assert cov["B"].flags == ["too_little_data"] and "end_time_often_missing" in a.flags and "place_needs_work" in a.flags
    gaps = {(r.source, r.field): r.priority for r in catalogue.gap_priorities(catalogue.detail_coverage(df, TODAY)).collect()}
    assert gaps["A", "end_time"] == "high" and ("A", "start_time") not in gaps and gaps["B", "price"] == "too_little_data"
    cases = catalogue.gap_cases(df, "A", "end_time", TODAY).collect()
    assert [c.clean_attribution for c in cases] == [True, True, True, False] and (cases[3].url, cases[3].url_basis) == ("https://a.se/1", "source_record")
    total = catalogue.gap_summary(catalogue.gap_cases(df, "A", "end_time", TODAY)).first()
    assert (total.cases, total.clean_cases, total.url_coverage) == (4, 3, 1.0)
    assert catalogue.detail_summary(df, TODAY).first().listings == 4


def test_health_states(spark):
    status = spark.createDataFrame([("A", "OK", 3, ""), ("B", "Fel", 0, "x"), ("Lov Örebro", "OK", 0, ""), ("D", "OK", 0, ""), ("E", "Delvis", 9, ""), ("Conventum", "OK", 1, "")], "source string, status string, imported int, comment string")
    df = listings(spark, [dict(source_names=["A"], city="Örebro", start_date="2026-09-12") for _ in range(3)] + [dict(source_names=["Conventum"], city="", start_date="", official_url="u")])
    health = catalogue.source_health(status, df)
    got = {r.source: (r.state, r.summary) for r in health.collect()}
    assert got["A"] == ("check", "url_missing 3/3") and got["B"][0] == "error" and got["Lov Örebro"][0] == "seasonal_empty" and got["D"][0] == "check" and got["E"][0] == "partial"
    assert got["Conventum"] == ("check", "start_date_missing 1/1")
    top = catalogue.health_summary(health).first()
    assert (top.degraded, top.core, top.has_public_warning) == (4, 1, True)


def test_top_result_warnings(spark):
    titles = ["Show", "Kvällskonsert A", "Kvällskonsert B", "X", "Marknad i byn"]
    df = listings(spark, [dict(title=t, start_date="2026-09-12", city="", event_type="Konsert", source_names=["A"]) for t in titles]).withColumn("position", F.col("ingest_ord").cast("int") + 1)
    near = catalogue.near_duplicates(df)
    assert [(r.left_id, r.right_id) for r in near.collect()] == [("e1", "e2")]
    warnings = catalogue.top_quality_warnings(df, near).first().warnings
    assert warnings == ["near_duplicates", "source_dominates", "type_dominates", "weak_titles", "core_metadata_missing"]


def test_booking_coverage_counts_per_source(spark):
    df = listings(spark, [dict(source_names=["A", "B"], ticket_url="https://billetto.se/e/1"), dict(source_names=["A"])])
    got = {r.source: r for r in booking_reports.booking_coverage(df).collect()}
    assert (got["A"].total, got["A"].bookable, got["A"].missing, got["B"].total) == (2, 0, 1, 1)
    df = listings(spark, [dict(source_names=["A"], booking_url="https://billetto.se/e/1"), dict(source_names=["A"], booking_url="https://x.se/1")])
    row = booking_reports.booking_coverage(df).first()
    assert [(p.name, p.bookable) for p in row.partners] == [("Billetto", 1), ("x.se", 1)] and row.booking_coverage == 1.0


def test_funnel_fallbacks(spark):
    log = spark.createDataFrame(
        [(1, None, "impression", "e1", None, None, None, '{"source": ""}'), (2, None, "activity_open", "e1", None, None, "P", "not json"), (3, None, "cta_click", "e1", None, None, None, None)], ENGAGEMENT
    )
    clicks = spark.createDataFrame([("e9", "Q", None)], "event_id string, partner_name string, context_json string")
    meta = funnel.listing_meta(listings(spark, [dict(id="e1", source_names=["A", "B"], event_type="Konsert")]))
    got = {(r.dimension, r.name): r for r in funnel.funnel_report(funnel.funnel_log(log, clicks, meta)).collect()}
    assert (got["source", "A, B"].impressions, got["source", "A, B"].opens, got["source", "A, B"].open_rate) == (1, 1, 1.0)
    assert got["source", "Okänd källa"].booking_clicks == 1 and got["source", "Okänd källa"].open_rate is None
    assert (got["total", ""].impressions, got["total", ""].booking_clicks) == (1, 1) and ("partner", "P") in got and ("partner", "Q") in got


def snaps(spark, source, runs):
    rows = []
    for i, (status, unique, share, types) in enumerate(runs):
        rows.append((source, dt.date(2026, 9, 1 + i), None, status, 5, 5, unique, 1, share, 0, [], types, [], [], [], 0))
    return spark.createDataFrame(rows, SNAPSHOT)


def test_decisions(spark):
    df = snaps(spark, "good", [("OK", 4, 0.5, ["Konsert"])] * 3).unionByName(snaps(spark, "unstable", [("Fel", 9, 0.9, ["X"]), ("fel", 0, None, []), ("ok", 9, 0.9, []), ("Fel", 0, None, [])]))
    df = df.unionByName(snaps(spark, "redundant", [("ok", 0, 0.05, [])] * 4)).unionByName(snaps(spark, "young", [("ok", 4, 0.5, ["A"])] * 2))
    got = {r.source: r for r in candidates.decisions(df).collect()}
    assert {s: r.decision for s, r in got.items()} == {"good": "activate", "unstable": "reject", "redundant": "reject", "young": "keep_measuring"}
    assert got["young"].reasons[0] == "needs_3_snapshots_on_3_days 2/2" and got["unstable"].median_unique_events == 9.0
    plan = {r.source: (r.priority, r.evidence) for r in candidates.portfolio(df).collect()}
    assert plan == {"good": ("activation_candidate", "activation_ready"), "unstable": ("low", "stable"), "redundant": ("low", "stable"), "young": ("keep_measuring", "growing")}


def test_snapshots_replace_one_day(spark, tmp_path):
    path, at = str(tmp_path / "snap"), dt.datetime(2026, 9, 10, 8)
    df = listings(spark, [dict(title="Konsert", start_date="2026-09-12", city="Örebro", event_type="Konsert", source_names=["Makeriet i Örebro"]), dict(title="Mässa", start_date="2026-09-12", source_names=["Wadköping", "Conventum"])])
    audit = candidates.candidate_value_audit(df, df.limit(0), df, ["Makeriet i Örebro", "Wadköping"], TODAY)
    got = {r.source: r for r in audit.collect()}
    assert (got["Makeriet i Örebro"].unique_events, got["Makeriet i Örebro"].unique_events_in_underserved_segments, got["Wadköping"].overlap_events) == (1, 1, 1)
    health = spark.createDataFrame([("Makeriet i Örebro", "OK"), ("Karlslund", None)], "source string, status string")
    rows = candidates.snapshot_rows(audit, health, at)
    candidates.write_snapshots(rows, path, at.date())
    candidates.write_snapshots(rows.filter(F.col("source") == "Wadköping").withColumn("unique_events", F.lit(7)), path, at.date())
    back = {r.source: (r.status, r.unique_events) for r in candidates.history(spark, path).collect()}
    assert back == {"Makeriet i Örebro": ("OK", 1), "Karlslund": ("Fel", 0), "Wadköping": ("Okänd", 7)}


def test_evidence_needs_recurrence(spark):
    rows = [("A", "price", i, f"u{i}", s, k, str(i), True) for i, (s, k) in enumerate([("parser_candidate", "x"), ("parser_candidate", "y"), ("parser_candidate", "y"), ("not_reviewable", ""), ("not_found", "")])]
    df = spark.createDataFrame(rows, "source string, field string, case_ord int, url string, status string, kind string, value string, clean_attribution boolean")
    row = evidence.batch_audit(df).first()
    assert (row.reviewed, row.analyzable, row.candidate_rate, row.classification) == (5, 4, 0.75, "recurring_candidate")
    pattern = evidence.evidence_patterns(df).first()
    assert (pattern.dominant_kind, pattern.dominant_count, [e.url for e in pattern.examples]) == ("y", 2, ["u0", "u1", "u2"])
    assert evidence.evidence_patterns(df.filter("case_ord > 1")).count() == 0
    assert evidence.batch(df, 2).count() == 2 and evidence.status_counts(df).count() == 3


def test_replay_outcomes(spark):
    old = spark.createDataFrame([("1", "price", None), ("2", "price", "a"), ("3", "price", "a"), ("4", "price", "a")], "url string, field string, value string")
    new = spark.createDataFrame([("1", "price", "b"), ("2", "price", "a"), ("3", "price", None), ("4", "price", "b")], "url string, field string, value string")
    assert [r.outcome for r in evidence.compare_runs(old, new).orderBy("url").collect()] == ["recovered", "unchanged", "regression", "changed"]
    assert evidence.impact_audit(evidence.compare_runs(old, new)).first().classification == "check_deviation"


def test_signatures_ignore_order(spark):
    a, b = (spark.createDataFrame([(x,) for x in ids], "id string") for ids in (["2", "1", "1", None], ["1", "2"]))
    assert signature.id_signature(a).first() == signature.id_signature(b).first()
