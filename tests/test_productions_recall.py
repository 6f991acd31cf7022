"""Leader clustering and one-to-one matching against plain loops."""

import random

from pyspark.sql import functions as F

from playbill import vocab
from playbill.functions.similarity import title_match, venue_match
from playbill.operators import productions, recall, title_pairs
from tests.factory import listings

TITLES = ["Svansjön", "Svan sjön", "Nötknäpparen balett", "Nötknäpparens balett", "Konstrundan i parken", "Konstrundan i parken med Anna", "Matchen", "", "Cirkus Cirkör presenterar sommar", "Cirkus Cirkör presenterar sommar!"]


def rows(seed, n):
    rnd = random.Random(seed)
    return [
        dict(
            id=f"e{i}", ingest_ord=i, title=rnd.choice(TITLES), event_type=rnd.choice(["Teater", "Konsert", "Dans", "Sport", "Utställning"]), city=rnd.choice(["Örebro", "Kumla", ""]),
            venue=rnd.choice(["", "Stora teatern", "Stora teatern stora scenen", "Örebro", "Slottet"]), start_date=f"2026-09-{rnd.randint(1, 28):02d}", start_time=rnd.choice([None, "19:00"]),
            end_date=rnd.choice([None, None, "2026-09-30"]), official_url=rnd.choice([None, "https://a.se/events/1", "https://a.se/x"]),
        )
        for i in range(n)
    ]


def same(a, b):
    if a["c"] and b["c"] and a["c"] != b["c"] or not a["t"] or not b["t"] or a["sport"] or b["sport"]:
        return False
    if title_match(a["t"], b["t"], vocab.PRODUCTION_TITLE_FLOOR) < vocab.PRODUCTION_TITLE_FLOOR:
        return False
    if a["v"] and b["v"] and venue_match(a["v"], b["v"]) < vocab.PRODUCTION_VENUE_FLOOR:
        return False
    exact = a["t"] == b["t"]
    if a["staged"] and b["staged"] or exact and (a["staged"] and b["interval"] or b["staged"] and a["interval"]):
        return True
    return exact and bool(a["c"]) and a["c"] == b["c"] and (bool(a["v"]) and a["v"] == b["v"] or bool(a["page"]) and a["page"] == b["page"])


def test_cards_equal_the_plain_loop(spark):
    for seed in (2,):
        df = listings(spark, rows(seed, 120)).withColumn("position", F.col("ingest_ord") + 1)
        got = {r.position: r.leader_position for r in productions.assign(df, keys=()).collect()}
        assert got == {r.position: r.leader_position for r in productions.assign(df, keys=(), batch=3).collect()}
        leaders, want = [], {}
        for r in productions.production_columns(df.withColumn("g", F.lit(""))).orderBy("position").collect():
            r = r.asDict()
            lead = next((x for x in leaders if same(x, r)), None)
            if lead is None:
                leaders.append(r)
            want[r["position"]] = (lead or r)["position"]
        assert got == want


def test_title_keys_miss_no_similar_title(spark):
    rnd = random.Random(4)
    base = ["".join(rnd.choice("abcdeinorst ") for _ in range(rnd.randint(3, 40))).strip() for _ in range(120)]
    titles = {" ".join(t.split()) for t in base}
    for t in list(titles):
        if len(t) > 4:
            i = rnd.randrange(len(t))
            titles |= {t[:i] + t[i + 1:], t[:i] + rnd.choice("xyz") + t[i:], t + " med kor"}
    titles = sorted({" ".join(t.split()) for t in titles} - {""})
    df = spark.createDataFrame([(t,) for t in titles], "t string")
    got = {(r.first, r.second) for r in title_pairs.similar_titles(df).collect()}
    want = {(a, b) for a in titles for b in titles if title_match(a, b, 0.92) >= 0.92}
    assert got == want


def test_collapse_lists_other_dates_once(spark):
    a = dict(title="Svansjön", event_type="Dans", city="Örebro", venue="Slottet")
    df = listings(spark, [dict(a, start_date="2026-09-10"), dict(a, start_date="2026-09-12", start_time="19:00"), dict(a, start_date="2026-09-11"), dict(a, start_date="2026-09-10")])
    card = productions.collapse(df.withColumn("position", F.col("ingest_ord") + 1), keys=()).collect()
    assert len(card) == 1 and card[0].alternate_dates == ["2026-09-11", "2026-09-12"]
    assert [x.date for x in card[0].alternates] == ["2026-09-10", "2026-09-11", "2026-09-12"]


def test_matching_is_one_to_one_in_reference_order(spark):
    rnd = random.Random(8)
    names = ["Höstmarknad", "Höstmarknaden", "Höstmarknad & loppis", "Sommarkonsert", "Sommarkonserten 2"]
    day = lambda: rnd.choice(["2026-09-10", "2026-09-11"])
    cat = [dict(id=f"e{i}", ingest_ord=i, title=rnd.choice(names), start_date=day(), city="Örebro") for i in range(40)]
    refs = [(i, rnd.choice(names), day(), "orebro") for i in range(30)]
    df, rdf = listings(spark, cat), spark.createDataFrame(refs, "ref_ord bigint, title string, start_date string, city string")
    got = {r.ref_ord: r.listing_ord for r in recall.match(rdf, df).collect()}
    pool = {}
    for r in recall.candidates(rdf, df).collect():
        pool.setdefault(r.ref_ord, []).append((-r.score, r.listing_ord))
    used, want = set(), {}
    for ref in sorted(pool):
        free = sorted(x for x in pool[ref] if x[1] not in used)
        if free:
            want[ref] = free[0][1]
            used.add(free[0][1])
    assert got == want


def test_matching_in_order_equals_rounds_over_pairs_and_writes_none(spark, monkeypatch):
    titles = ["Stora Rockkonserten", "Stora rock konserten", "Rockkonserten stora", "Julmarknad"]
    rows = [dict(id=f"e{i}", ingest_ord=i, title=titles[i % 3 if i % 5 else 3], start_date="2026-09-1" + str(i % 2), city=["Örebro", "Kumla"][i % 3 % 2]) for i in range(40)]
    df = listings(spark, rows)
    # One reference comes twice, one lies on two days.
    asked = [(i, titles[i * 7 % 4], "2026-09-1" + str(i % 2), ["Örebro", "Kumla"][i % 2]) for i in range(30)]
    refs = lambda more: spark.createDataFrame(asked + more, "ref_ord bigint, title string, start_date string, city string")
    key = lambda found: sorted((r.ref_ord, r.listing_ord, round(r.score, 9)) for r in found.collect())
    want = key(recall.match(refs([]), df, loop_rows=0))
    odd = refs([asked[3], (4, titles[0], "2026-09-11", "Kumla")])
    assert key(recall.match(odd, df)) == key(recall.match(odd, df, loop_rows=0))
    monkeypatch.setattr(recall, "_pairs", lambda *a: 1 / 0)
    assert want and key(recall.match(refs([asked[3]]), df)) == want
