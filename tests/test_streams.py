"""The same rows in one batch and in several micro-batches give the same result."""

import base64
import datetime as dt
import hashlib
import hmac
import json
import os

import pytest
from pyspark.sql import functions as F

from playbill.schema import CLICKS, CONVERSIONS, ENGAGEMENT
from playbill.streaming import keyed, state, streams

T0 = dt.datetime(2026, 9, 10, 12)
SECRET = "s" * 32


def at(minutes):
    return (T0 + dt.timedelta(minutes=minutes)).isoformat()


def write(path, *batches):
    path.mkdir(parents=True, exist_ok=True)
    for i, batch in enumerate(batches):
        file = path / f"{i:03d}.json"
        file.write_text("\n".join(json.dumps(r) for r in batch))
        os.utime(file, (1_700_000_000 + i, 1_700_000_000 + i))  # files are read in the order of their times
    return str(path)


def one_file_at_a_time(spark, path, schema):
    return spark.readStream.format("json").schema(schema).option("maxFilesPerTrigger", 1).load(path)


def drain(df, tmp_path, name, mode="append"):
    out = str(tmp_path / f"out-{name}")
    streams.run(df, streams.into_files(out), str(tmp_path / f"chk-{name}"), mode).awaitTermination()
    return df.sparkSession.read.parquet(out)


def test_engagement_rejects_unknown_actions(spark, tmp_path):
    path = write(tmp_path / "in", [dict(id=1, occurred_at=at(0), action="impression"), dict(id=2, occurred_at=at(1), action="hack")], [dict(id=3, occurred_at=at(2), action="ad_click")])
    good, bad = streams.valid_engagement(one_file_at_a_time(spark, path, ENGAGEMENT))
    assert sorted(r.id for r in drain(good, tmp_path, "good").collect()) == [1, 3]
    assert [r.reason for r in drain(bad, tmp_path, "bad").collect()] == ["unknown_action"]


def test_sightings_merge_equals_one_batch(spark, tmp_path):
    rows = [[dict(event_id=e, seen_at=at(m)) for e, m in batch] for batch in ([("a", 5), ("b", 6)], [("a", 1)], [("a", 9), ("c", 7)])]
    path = write(tmp_path / "in", *rows)
    schema = "event_id string, seen_at timestamp"
    table = str(tmp_path / "seen")
    streams.run(one_file_at_a_time(spark, path, schema), keyed.sightings_sink(table, 4), str(tmp_path / "chk")).awaitTermination()
    key = lambda df: sorted((r.event_id, r.first_seen_at, r.last_seen_at) for r in df.collect())
    assert key(keyed.sighting_table(table, 4).read(spark)) == key(state.sightings(spark.read.schema(schema).json(path)))


def test_clicks_are_idempotent(spark, tmp_path):
    click = lambda i, m, **k: dict(click_id=i, created_at=at(m), event_id="e", partner_key="p", partner_name="P", destination_url="https://a.se", **k)
    path = write(tmp_path / "in", [click("upc_1", 0), click("bad", 0)], [click("upc_1", 1), click("upc_2", 2)])
    good, bad = streams.idempotent_clicks(one_file_at_a_time(spark, path, CLICKS))
    got = drain(good, tmp_path, "clicks")
    assert sorted(r.click_id for r in got.collect()) == ["upc_1", "upc_2"]
    late_first = write(tmp_path / "late", [click("upc_1", 9), click("upc_1", 4), click("upc_1", 7)])
    assert [r.created_at for r in streams.idempotent_clicks(spark.read.schema(CLICKS).json(late_first), streaming=False)[0].collect()] == [
        r.created_at for r in spark.read.schema(CLICKS).json(late_first).orderBy("created_at").limit(1).collect()
    ]
    assert streams.idempotent_clicks(spark.read.schema(CLICKS).json(path), streaming=False)[0].count() == 2
    assert streams.unseen(got, got.filter("click_id = 'upc_1'")).count() == 1
    fresh = streams.new_clicks(spark.createDataFrame([(None,), ("upc_x",)], "click_id string")).collect()
    assert fresh[0].click_id.startswith("upc_") and len(fresh[0].click_id) == 36 and fresh[1].click_id == "upc_x"


def test_conversions(spark, tmp_path):
    conv = lambda click, pid, status="confirmed", m=0: dict(recorded_at=at(m), click_id=click, partner_conversion_id=pid, status=status, commission_value=10.0)
    path = write(tmp_path / "in", [conv("c1", "x"), conv("c1", None), conv("nope", "y")], [conv("c1", "x", "pending", 3), conv("c1", None, m=1), conv("c2", "z", "weird")])
    clicks = spark.createDataFrame([("c1",), ("c1",), ("c2",)], "click_id string")
    batch = spark.read.schema(CONVERSIONS).json(path)
    good, bad = streams.accept_conversions(batch, clicks)
    assert sorted((r.partner_conversion_id or "", r.status) for r in good.collect()) == [("", "confirmed"), ("", "confirmed"), ("x", "confirmed")]
    assert sorted(r.reason for r in bad.collect()) == ["unknown_click", "unsupported_status"]
    live = drain(streams.conversions_stream(one_file_at_a_time(spark, path, CONVERSIONS), clicks), tmp_path, "conv")
    assert live.count() == 3


def token(secret=SECRET, **over):
    payload = dict(v=1, jti="j1", iat=int(T0.replace(tzinfo=dt.timezone.utc).timestamp()), event_id="e1", partner_key="tickster", partner_name="Tickster", campaign_id=None, source="A, B", event_type="Konsert", destination_url="https://a.se/ö")
    payload.update(over)
    body = base64.urlsafe_b64encode(json.dumps(payload).encode()).rstrip(b"=").decode()
    return body + "." + base64.urlsafe_b64encode(hmac.new(secret.encode(), body.encode(), hashlib.sha256).digest()).rstrip(b"=").decode()


def test_signed_clicks(spark):
    iat = int(T0.replace(tzinfo=dt.timezone.utc).timestamp())
    cases = {
        token(): None, token("t" * 32): "invalid_signature", token(iat=iat - 1801): "expired", token(iat=iat + 61): "issued_in_future", token(destination_url="http://a.se"): "unsafe_destination",
        token(v=2): "incomplete", token(event_id=""): "incomplete", "rubbish": "malformed", token(iat=iat - 1800, jti="j2"): None,
    }
    df = spark.createDataFrame([(t, T0) for t in cases], "token string, received_at timestamp")
    good, bad = streams.verify_clicks(df, SECRET, now=iat)
    assert {r.token: r.reason for r in bad.collect()} == {t: r for t, r in cases.items() if r}
    rows = good.orderBy("click_id").collect()
    assert [r.click_id for r in rows] == ["upc_j1", "upc_j2"] and json.loads(rows[0].context_json)["source"] == "A, B" and rows[0].destination_url == "https://a.se/ö"
    with pytest.raises(ValueError):
        streams.verify_clicks(df, "short")


def test_impressions_and_windows(spark, tmp_path):
    imp = lambda s, e, m: dict(session_id=s, signature="f", event_id=e, occurred_at=at(m))
    path = write(tmp_path / "imp", [imp("s1", "a", 0), imp("s1", "a", 1)], [imp("s1", "a", 2), imp("s1", "b", 2), imp("s2", "a", 3)])
    schema = "session_id string, signature string, event_id string, occurred_at timestamp"
    assert drain(streams.impressions_once(one_file_at_a_time(spark, path, schema)), tmp_path, "imp").count() == 3
    assert streams.impressions_once(spark.read.schema(schema).json(path), streaming=False).count() == 3
    step = lambda u, s, m: dict(user_id=u, step=s, occurred_at=at(m))
    path = write(tmp_path / "steps", [step("u", "impression", 1), step("u", "open", 2)], [step("u", "impression", 70), step("v", "click", 71)], [step("w", "open", 300)])
    schema = "user_id string, step string, occurred_at timestamp"
    batch = {tuple(r) for r in state.windowed_funnel(spark.read.schema(schema).json(path)).collect()}
    live = {tuple(r) for r in drain(streams.funnel_stream(one_file_at_a_time(spark, path, schema)), tmp_path, "funnel").collect()}
    assert {r[:4] for r in live} == {r for r in batch if r[0] < T0 + dt.timedelta(hours=4)}
    sessions = drain(streams.sessions_stream(one_file_at_a_time(spark, path, schema)), tmp_path, "sessions").collect()
    assert sorted((r.user_id, r.steps) for r in sessions) == [("u", 1), ("u", 2), ("v", 1)]


def test_the_first_click_wins_for_ever(spark, tmp_path):
    click = lambda i, m, e="e", **k: dict(click_id=i, created_at=at(m), event_id=e, partner_key="p", partner_name="P", destination_url="https://a.se", **k)
    batches = [[click("upc_1", 50, "first"), click("bad", 0)], [click("upc_1", 1, "earlier, but later seen"), click("upc_2", 2), click("upc_2", 1, "earliest")], [click(f"upc_{i}", 90) for i in range(40)], [click("upc_1", 90_000, "weeks later")]]
    path, root = write(tmp_path / "in", *batches), str(tmp_path / "table")
    sink = keyed.clicks_sink(root, CLICKS, 8)
    streams.run(one_file_at_a_time(spark, path, CLICKS), sink, str(tmp_path / "chk")).awaitTermination()
    table = keyed.click_table(root, CLICKS, 8)
    rows = {r.click_id: r.event_id for r in table.read(spark).collect()}
    assert len(rows) == table.read(spark).count() == 40 and rows["upc_1"] == "first" and rows["upc_2"] == "earliest"
    assert [r.reason for r in spark.read.json(f"{root}/clicks/quarantine/*").collect()] == ["invalid_click_id"]


def test_replayed_and_failed_batches_change_nothing(spark, tmp_path):
    schema = "id string, at int, v string"
    table = keyed.KeyedTable(str(tmp_path / "t"), schema, ["id"], keep_known := keyed.keep_known(["id"], "at"), 4)
    rows = lambda *x: spark.createDataFrame(list(x), schema)
    assert keep_known and table.apply(rows(("a", 2, "x"), ("b", 1, "y"), ("a", 1, "w")), 0)
    # A batch that was written but not entered is as good as not there, and is written anew.
    rows(("zz", 0, "left behind")).write.parquet(str(tmp_path / "t" / "batch-1" / "bucket=0"))
    before = {tuple(r) for r in table.read(spark).collect()}
    assert before == {("a", 1, "w"), ("b", 1, "y")}
    assert table.apply(rows(("c", 1, "z"), ("a", 0, "too late")), 1) and not table.apply(rows(("c", 0, "again"), ("d", 1, "new")), 1)
    assert {tuple(r) for r in table.read(spark).collect()} == before | {("c", 1, "z")}
    assert table.apply(rows(), 2) and not table.apply(rows(("q", 1, "q")), 2) and table.read(spark).count() == 3


def test_only_touched_buckets_are_rewritten(spark, tmp_path):
    table = keyed.sighting_table(str(tmp_path), 16)
    first = spark.range(500).selectExpr("cast(id AS string) AS event_id", "timestamp'2026-01-01' AS first_seen_at", "timestamp'2026-01-01' AS last_seen_at")
    table.apply(first, 0)
    table.apply(first.filter("event_id = '7'").withColumn("last_seen_at", F.expr("timestamp'2026-02-01'")), 1)
    assert len(list((tmp_path / "sightings" / "batch-1").glob("bucket=*"))) == 1 and len(list((tmp_path / "sightings" / "batch-0").glob("bucket=*"))) == 16
    got = {r.event_id: str(r.last_seen_at)[:10] for r in table.read(spark).collect()}
    assert len(got) == 500 and got["7"] == "2026-02-01" and got["8"] == "2026-01-01"
    assert 0 < table.around(first.filter("event_id = '7'")).count() < 100


def test_conversions_keep_rejects_and_partner_ids(spark, tmp_path):
    conv = lambda click, pid, status="confirmed", m=0: dict(recorded_at=at(m), click_id=click, partner_conversion_id=pid, status=status, commission_value=10.0)
    path = write(tmp_path / "in", [conv("c1", "x"), conv("c1", None), conv("nope", "y")], [conv("c1", "x", "pending", 9_000), conv("c1", None, m=1), conv("c2", "z", "weird"), conv("c2", "x")])
    clicks = keyed.click_table(str(tmp_path / "t"), CLICKS, 4)
    clicks.apply(spark.createDataFrame([(c, T0) for c in ("c1", "c2")], "click_id string, created_at timestamp").select(*[F.col(n) if n in ("click_id", "created_at") else F.lit(None).cast("string").alias(n) for n in [c.split()[0] for c in CLICKS.split(", ")]]), 0)
    root = str(tmp_path / "t")
    sink = keyed.conversions_sink(root, CONVERSIONS, clicks, 4)
    streams.run(one_file_at_a_time(spark, path, CONVERSIONS), sink, str(tmp_path / "chk")).awaitTermination()
    rows = keyed.conversions(spark, root, CONVERSIONS, 4).collect()
    assert sorted((r.click_id, r.partner_conversion_id or "", r.status) for r in rows) == [("c1", "", "confirmed"), ("c1", "", "confirmed"), ("c1", "x", "confirmed"), ("c2", "x", "confirmed")]
    assert sorted(r.reason for r in spark.read.json(f"{root}/conversions/quarantine/*").collect()) == ["unknown_click", "unsupported_status"]
