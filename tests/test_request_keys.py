"""The keys under which requests and listings meet."""

import datetime as dt

from playbill.functions.scoring import SearchRequest
from playbill.operators import request_join
from tests.factory import listings

TODAY, NOW = dt.date(2026, 9, 10), dt.datetime(2026, 9, 10, 12)
ASKED = [SearchRequest(f"r{i}", TODAY, NOW, city, "next_30_days", km, "any") for i, (city, km) in enumerate([("Örebro", 25), ("Örebro", 300), ("Örebro", 20000), (None, None)])]


def test_keys_never_go_through_the_driver(spark):
    rows = [dict(id=f"e{i}", title="Jazz", city="Örebro", start_date=(TODAY + dt.timedelta(days=i)).isoformat()) for i in range(40)]
    met = request_join.pairs(listings(spark, rows), request_join.request_table(spark, ASKED))
    plan = met._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin [_period" in plan and "_share" in plan
    # Every pair is met once, also under an open key that is dealt among tasks.
    got = sorted((r.request_id, r.id) for r in met.select("request_id", "id").collect())
    assert got == sorted((f"r{k}", f"e{i}") for k in range(4) for i in range(31))


def test_keys_of_a_request_are_bounded(spark):
    resolved = request_join.resolve(request_join.request_table(spark, ASKED))
    counts = {r.request_id: r["count"] for r in request_join.request_keys(resolved, [0]).groupBy("request_id").count().collect()}
    assert len(counts) == 4 and max(counts.values()) <= 4 * request_join.CELLS
    assert counts["r2"] == counts["r3"] and counts["r3"] % request_join.SHARES == 0
