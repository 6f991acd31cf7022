"""Greedy duplicate resolution: rules on small rows, and both distributed paths against a plain loop."""

import random

from pyspark.sql import functions as F

from playbill.operators import dedupe
from playbill.schema import listing_type
from tests.factory import listings


def run_all(spark, rows, small_block):
    df = listings(spark, rows)
    return {r.ord: (r.leader, r.best, round(r.score, 9)) for r in dedupe.assign(df, small_block).collect()}, df


def plain(spark, df):
    """All rows of all days in one loop, without blocks."""
    rows = [r.asDict() for r in dedupe.match_columns(df).orderBy("ord").collect()]
    out = {}
    for day in {r["d"] for r in rows}:
        for ord_, leader, best, score in dedupe.greedy([r for r in rows if r["d"] == day]):
            out[ord_] = (leader, best, round(score, 9))
    return out


TITLES = ["Stora Rockkonserten", "Stora rock konserten", "Rockkonserten", "Stand-up med Anna", "Standup med Anna", "Julmarknad", "Julmarknaden i parken", "Jul marknad i parken", ""]
VENUES = ["", "Conventum", "Conventum Arena", "Conventum Kongress", "Örebro", "Parken", "Stadsparken"]
SOURCES = ["Conventum", "Kortcentralen", "Bloggen", "Visit Sweden"]


def random_rows(seed, n):
    rnd = random.Random(seed)
    rows = []
    for i in range(n):
        source = rnd.choice(SOURCES)
        rows.append(
            dict(
                id=f"e{i}", ingest_ord=i, title=rnd.choice(TITLES), start_date=rnd.choice(["2026-09-10", "2026-09-11"]), city=rnd.choice(["Örebro", "Örebro", "Kumla", ""]),
                venue=rnd.choice(VENUES), start_time=rnd.choice([None, None, "19:00", "20:00"]), event_type=rnd.choice(["Evenemang", "Konsert", "Sport"]), category=rnd.choice(["", "Lokalt", "Musik"]),
                source_names=[source], price_status=rnd.choice(["unknown", "known", "free"]), price_min=float(rnd.randint(0, 300)), price_max=float(rnd.randint(300, 600)),
                source_records=[dict(source=source, external_id=rnd.choice(["", "", "x1", "x2"]), source_url=None, fetched_at=None, raw_title=None, confidence=1.0, payload=None)],
            )
        )
    return rows


def test_small_and_large_paths_equal_the_plain_loop(spark):
    for seed in (2,):
        rows = random_rows(seed, 80)
        got_small, df = run_all(spark, rows, 10_000)
        want = plain(spark, df)
        assert got_small == want
        got_large, _ = run_all(spark, rows, 0)
        assert got_large == want


def test_each_trust_level_can_take_over_values(spark, monkeypatch):
    from playbill.functions import scoring

    levels = {"bloggen": 0, "kalendern": 1, "portalen": 2}
    monkeypatch.setattr(scoring, "_trust_table", lambda: levels)
    row = lambda i, source, venue: dict(id=f"e{i}", ingest_ord=i, title="Stora Rockkonserten", start_date="2026-09-10", city="Örebro", venue=venue, source_names=[source])
    rows = [row(0, "Bloggen", "Conventum"), row(1, "Bloggen", "Conventum"), row(2, "Kalendern", "Conventum Arena")]
    for small_block in (10_000, 0):
        df = listings(spark, rows)
        merged = dedupe.merge(df, dedupe.assign(df, small_block)).collect()
        assert [(r.venue, r.members) for r in merged] == [("Conventum Arena", 3)]


def test_hot_group_of_copies_goes_through_rounds(spark):
    rows = random_rows(3, 30)
    copies = [dict(rows[0], id=f"c{i}", ingest_ord=100 + i, title="Samma titel", city="Örebro", start_date="2026-09-10") for i in range(150)]
    got, df = run_all(spark, rows + copies, 0)
    want = plain(spark, df)
    assert {k: v[0] for k, v in got.items()} == {k: v[0] for k, v in want.items()}


def merged_by_hand(rows, assigned):
    """Fold of the scalar fields over all members, not only the ones the plan picks."""
    groups = {}
    for r in sorted(rows, key=lambda r: r["ingest_ord"]):
        groups.setdefault(assigned[r["ingest_ord"]][0], []).append(r)
    return groups


def test_merge_folds_members(spark):
    rows = random_rows(5, 80)
    assigned, df = run_all(spark, rows, 10_000)
    table = dedupe.assign(df)
    merged = {r.ingest_ord: r for r in dedupe.merge(df, table).collect()}
    full = df.withColumn("trust", dedupe.listing_trust()).withColumn("ord", F.col("ingest_ord"))
    by_ord = {r.ord: r.asDict() for r in full.collect()}
    groups = merged_by_hand(rows, assigned)
    assert set(groups) == set(merged)
    for leader, members in groups.items():
        full_rows = [by_ord[m["ingest_ord"]] for m in members]
        kept, spans = dedupe._fold(full_rows)
        got = merged[leader]
        for c in ("title", "event_type", "category", "venue", "city", "start_time", "description", "price_status"):
            assert (got[c] or "") == (kept[c] or ""), (leader, c)
        assert got.source_names == sorted({s for r in full_rows for s in r["source_names"]})
        assert got.members == len(members)
        if len(members) > 1:
            last = spans[-1] if spans else None
            if last and last[2] == "known":
                inside = [r for r in full_rows if r["ord"] >= last[0] and r["price_status"] == "known"]
                assert got.price_min == min(r["price_min"] for r in inside) and got.price_max == max(r["price_max"] for r in inside)
            noted = [n for n in got.quality_notes if n.startswith("Priskonflikt")]
            kinds = {r["price_status"] for r in full_rows} - {"unknown"}
            assert bool(noted) == (len(kinds) > 1)


def _pair(spark, a, b):
    rows = [dict(id="a", ingest_ord=1, source_names=["S1"], **a), dict(id="b", ingest_ord=2, source_names=["S2"], **b)]
    return run_all(spark, rows, 10_000)[0]


BASE = dict(title="Kvällskonsert", start_date="2026-09-10", city="Örebro", venue="Parken")


def test_two_clock_times_stay_apart(spark):
    got = _pair(spark, dict(BASE, start_time="14:00"), dict(BASE, start_time="19:00"))
    assert got[2][0] == 2


def test_similar_opponents_of_one_team_are_not_merged(spark):
    a, b = (dict(BASE, title=f"Hemmalaget - {x}", event_type="Sport") for x in ("Gästlaget A", "Gästlaget B"))
    assert _pair(spark, a, b)[2][0] == 2


def test_title_clock_counts_like_the_clock_field(spark):
    got = _pair(spark, dict(BASE, title="Kvällskonsert kl 19:00"), dict(BASE, start_time="19:00"))
    assert got[2][0] == 1


def test_listing_schema_is_kept(spark):
    df = listings(spark, random_rows(7, 10))
    out = dedupe.merge(df, dedupe.assign(df))
    assert out.drop("members").schema.simpleString() == listing_type().simpleString()


def scan(rows):
    """Every row against every kept row, in order."""
    kept, out = [], []
    for row in rows:
        ids = set(row["ids"])
        found = [(dedupe.pair_score(k, row, bool(ids & k["ids"])), -no) for no, k in enumerate(kept)]
        score, no = max(found, default=(0.0, 0))
        best = kept[-no] if score >= dedupe.vocab.REVIEW_SCORE else None
        merged = best is not None and score >= dedupe.vocab.MERGE_SCORE
        out.append((row["ord"], best["ord"] if merged else row["ord"], best and best["ord"], score if best else 0.0))
        if merged:
            dedupe.absorb(best, row)
            best["ids"] |= ids
        else:
            kept.append({**row, "ids": ids})
    return out


def test_indexed_loop_equals_a_scan_of_all_kept_rows(spark):
    for seed in (3, 4, 5):
        rows = [r.asDict() for r in dedupe.match_columns(listings(spark, random_rows(seed, 150))).orderBy("ord").collect()]
        rows = [r for r in rows if r["d"] == "2026-09-10"]
        assert dedupe.greedy([dict(r) for r in rows]) == scan([dict(r) for r in rows])


def test_a_long_day_of_few_comparisons_is_no_large_block(spark, monkeypatch):
    monkeypatch.setattr(dedupe, "_large", lambda rows: 1 / 0)
    rows = random_rows(6, 80)
    for i, row in enumerate(rows):
        row.update(city=f"Stad {i % 20}" if i else "", start_date="2026-09-10")
    df = listings(spark, rows)
    got = {r.ord: (r.leader, r.best, round(r.score, 9)) for r in dedupe.assign(df, 40).collect()}
    want = scan([r.asDict() for r in dedupe.match_columns(df).orderBy("ord").collect()])
    assert got == {o: (leader, best, round(score, 9)) for o, leader, best, score in want}


def test_provenance_sends_no_records_through_the_driver(spark):
    df = listings(spark, random_rows(7, 20))
    assigned = dedupe.assign(df)
    assert "BroadcastHashJoin" not in dedupe.provenance(df, assigned)._jdf.queryExecution().executedPlan().toString()
