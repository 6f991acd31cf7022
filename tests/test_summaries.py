"""Day summaries against the exact reports."""

import datetime as dt
import random
import statistics

from playbill.operators import catalogue, summaries
from tests.factory import listings

TODAY = dt.date(2026, 9, 10)


def catalogue_rows(n, seed=1):
    rnd = random.Random(seed)
    day = lambda: (TODAY + dt.timedelta(days=rnd.randint(-20, 120))).isoformat()
    return [dict(id=f"e{rnd.randint(0, n)}", title="x", start_date=rnd.choice([day(), day(), day(), "not-a-date"]), source_names=rnd.sample(["A", "B", "C", " "], rnd.randint(0, 3)), is_demo=rnd.random() < 0.1) for _ in range(n)]


def test_counts_of_any_horizon_are_those_of_the_listings(spark):
    df = listings(spark, catalogue_rows(600))
    days = summaries.source_days(df)
    for horizon in (1, 30, 90):
        want = {r.source: (r.represented, r.unique_listings, r.overlap_listings) for r in catalogue.source_value(df, TODAY, horizon).collect()}
        got = summaries.source_value(days, TODAY, horizon).collect()
        assert {r.source: (r.represented, r.unique, r.overlap) for r in got} == want


def test_parts_merge_to_the_whole_and_ids_are_counted_once(spark):
    df = listings(spark, catalogue_rows(4000, 2))
    parts = [summaries.source_days(df.filter(f"ingest_ord % 3 = {i}")) for i in range(3)]
    whole = {(r.source, r.day): (r.represented, r.unique) for r in summaries.source_days(df).collect()}
    both = summaries.merged(parts[0].unionByName(parts[1]).unionByName(parts[2]))
    assert {(r.source, r.day): (r.represented, r.unique) for r in both.collect()} == whole
    exact = {}
    for r in catalogue.upcoming(df, TODAY, 90).selectExpr("id", "explode(array_distinct(source_names)) AS s").collect():
        exact.setdefault(r.s.strip(), set()).add(r.id)
    for r in summaries.source_value(both, TODAY, 90).collect():
        assert abs(r.listed - len(exact[r.source])) <= 0.05 * len(exact[r.source])


def test_medians_of_runs(spark):
    rnd = random.Random(4)
    rows = [(rnd.choice("AB"), dt.date(2026, 9, rnd.randint(1, 28)), rnd.choice(["OK", "ok", "Fel", None]), rnd.randint(0, 500), rnd.random(), rnd.randint(0, 9)) for _ in range(3000)] + [("C", TODAY, "Fel", 1, 0.5, 1)]
    df = spark.createDataFrame(rows, "source string, snapshot_day date, status string, unique_events int, unique_share double, unique_events_in_underserved_segments int")
    days = summaries.run_days(df)
    for since in (None, dt.date(2026, 9, 15)):
        for r in summaries.evidence(days, since).collect():
            mine = [x for x in rows if x[0] == r.source and (since is None or x[1] >= since)]
            good = sorted(x[3] for x in mine if (x[2] or "").lower() == "ok")
            assert (r.snapshots, r.distinct_days) == (len(mine), len({x[1] for x in mine}))
            if good:
                rank = sum(x <= r.median_unique_events for x in good) / len(good)
                assert abs(rank - 0.5) < 0.04 and abs(r.median_unique_share - statistics.median(x[4] for x in mine if (x[2] or "").lower() == "ok")) < 0.06
            else:
                assert r.median_unique_events is None and r.success_rate == 0
