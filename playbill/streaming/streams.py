"""Structured Streaming jobs over landed files; state lives in Spark or in keyed tables."""

from __future__ import annotations

import base64
import hashlib
import hmac

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from playbill import vocab
from playbill.functions.text import impression_key
from playbill.schema import CLICKS, CONVERSIONS, ENGAGEMENT
from playbill.streaming.state import sightings, windowed_funnel

LATE = "30 minutes"  # a click token is void after that long


def read_stream(spark: SparkSession, path: str, schema: str, fmt: str = "json") -> DataFrame:
    return spark.readStream.format(fmt).schema(schema).load(path)


def read_engagement(spark: SparkSession, path: str) -> DataFrame:
    return read_stream(spark, path, ENGAGEMENT)


def valid_engagement(log: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(accepted, quarantined) rows of an engagement log."""
    known = F.coalesce(F.col("action").isin(vocab.ENGAGEMENT_ACTIONS), F.lit(False)) & F.col("occurred_at").isNotNull()
    return log.filter(known), log.filter(~known).withColumn("reason", F.lit("unknown_action"))


def run(df: DataFrame, sink, checkpoint: str, mode: str = "append", once: bool = True):
    """Starts a query that hands every micro-batch to `sink(batch, id)`."""
    writer = df.writeStream.outputMode(mode).option("checkpointLocation", checkpoint).foreachBatch(sink)
    return (writer.trigger(availableNow=True) if once else writer).start()


def into_files(path: str, partition_by: str | None = None):
    """Batch folders named by the batch id: a replayed batch overwrites itself."""

    def sink(batch: DataFrame, batch_id: int) -> None:
        writer = batch.write.mode("overwrite")
        (writer.partitionBy(partition_by) if partition_by else writer).parquet(f"{path}/batch={batch_id}")

    return sink


# --- first and last sightings (T2) ------------------------------------------------------

def sightings_stream(rows: DataFrame) -> DataFrame:
    """Running first/last sighting per listing id, kept in Spark state (update mode)."""
    return sightings(rows)


# --- clicks and conversions (T3, T4) -------------------------------------------------------

def new_clicks(requests: DataFrame) -> DataFrame:
    """Fresh ids for clicks that arrive without one."""
    fresh = F.concat(F.lit(vocab.CLICK_PREFIX), F.replace(F.uuid(), F.lit("-"), F.lit("")))
    return requests.withColumn("click_id", F.coalesce("click_id", fresh))


def first_of(rows: DataFrame, keys: list[str], at: str) -> DataFrame:
    """The earliest row of each key; of rows of one instant the one whose JSON text is smallest."""
    payload = F.struct(*[c for c in rows.columns if c not in keys])
    first = rows.groupBy(*keys).agg(F.min_by(payload, F.struct(F.col(at), F.to_json(payload))).alias("_r"))
    return first.select(*keys, "_r.*").select(*rows.columns)


def idempotent_clicks(clicks: DataFrame, streaming: bool = True) -> tuple[DataFrame, DataFrame]:
    """(clicks with one row per id, rejected ids); in a batch the earliest row wins, in a stream a repeated id within the watermark is dropped."""
    good = F.coalesce(F.startswith("click_id", F.lit(vocab.CLICK_PREFIX)), F.lit(False))
    ok, bad = clicks.filter(good), clicks.filter(~good).withColumn("reason", F.lit("invalid_click_id"))
    ok = ok.withWatermark("created_at", LATE).dropDuplicatesWithinWatermark(["click_id"]) if streaming else first_of(ok, ["click_id"], "created_at")
    return ok, bad


def unseen(batch: DataFrame, table: DataFrame, key: str = "click_id") -> DataFrame:
    """Rows of a micro-batch whose key the table does not hold yet (insert-or-ignore)."""
    return batch.join(table.select(key), key, "left_anti")


def accept_conversions(conversions: DataFrame, clicks: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(accepted, rejected).  The click must be known and the state one of four.

    (click, partner conversion id) is unique; rows without a partner id never collide.
    """
    state_ok = F.col("status").isin(vocab.CONVERSION_STATES)
    known = clicks.select("click_id").distinct().withColumn("_known", F.lit(True))
    joined = conversions.join(known, "click_id", "left")
    ok = F.coalesce(state_ok, F.lit(False)) & F.col("_known").isNotNull()
    reason = F.when(~F.coalesce(state_ok, F.lit(False)), "unsupported_status").otherwise("unknown_click")
    good, bad = joined.filter(ok).drop("_known"), joined.filter(~ok).withColumn("reason", reason).drop("_known")
    once = first_of(good.filter(F.col("partner_conversion_id").isNotNull()), ["click_id", "partner_conversion_id"], "recorded_at")
    return once.unionByName(good.filter(F.col("partner_conversion_id").isNull())), bad


def conversions_stream(conversions: DataFrame, clicks: DataFrame) -> DataFrame:
    """Stream-static form: known clicks, and one row per partner conversion within the watermark."""
    ok = conversions.filter(F.col("status").isin(vocab.CONVERSION_STATES)).join(clicks.select("click_id"), "click_id", "left_semi")
    timed = ok.withWatermark("recorded_at", LATE)
    # A null partner id never collides, so such rows pass beside the state.
    named = timed.filter(F.col("partner_conversion_id").isNotNull()).dropDuplicatesWithinWatermark(["click_id", "partner_conversion_id"])
    return named.unionByName(timed.filter(F.col("partner_conversion_id").isNull()))


# --- signed clicks (T5) ----------------------------------------------------------------------

def _signature_ok(secret: str):
    key = secret.encode("utf-8")

    @F.pandas_udf(T.BooleanType())
    def check(body: pd.Series, signature: pd.Series) -> pd.Series:
        def one(b, s):
            want = base64.urlsafe_b64encode(hmac.new(key, (b or "").encode("utf-8"), hashlib.sha256).digest()).rstrip(b"=").decode("ascii")
            return hmac.compare_digest(want.encode(), (s or "").encode("utf-8"))

        return pd.Series([one(b, s) for b, s in zip(body, signature)], dtype=bool)

    return check


TOKEN = "v int, jti string, iat bigint, event_id string, partner_key string, partner_name string, campaign_id string, source string, event_type string, destination_url string"


def verify_clicks(tokens: DataFrame, secret: str, now=None) -> tuple[DataFrame, DataFrame]:
    """(clicks, rejected with reason) of signed tokens: token string, received_at timestamp."""
    if not secret or len(secret) < 32:
        raise ValueError("signing secret must have 32 characters or more")
    parts = F.split("token", r"\.", 2)
    df = tokens.withColumns({"_body": parts[0], "_sig": F.try_element_at(parts, F.lit(2))})
    standard = F.translate("_body", "-_", "+/")
    padded = F.concat(standard, F.repeat(F.lit("="), F.pmod(-F.length(standard), F.lit(4)).cast("int")))
    text = F.try_to_binary(padded, F.lit("base64"))
    df = df.withColumns({"_ok": _signature_ok(secret)("_body", "_sig"), "p": F.from_json(F.try_validate_utf8(text.cast("string")), TOKEN)})
    at = F.unix_seconds(F.col("received_at")) if now is None else F.lit(int(now)).cast("bigint")
    url = F.col("p.destination_url")
    https = F.coalesce((F.try_parse_url(url, F.lit("PROTOCOL")) == "https") & (F.coalesce(F.try_parse_url(url, F.lit("HOST")), F.lit("")) != ""), F.lit(False))
    blank = lambda c: F.coalesce(F.col(c), F.lit("")) == ""
    issued = F.coalesce("p.iat", F.lit(0))
    reason = (
        F.when(F.col("_sig").isNull(), "malformed").when(~F.col("_ok"), "invalid_signature").when(F.col("p").isNull(), "malformed")
        .when((F.coalesce("p.v", F.lit(0)) != 1) | blank("p.jti") | blank("p.event_id"), "incomplete")
        .when(issued > at + vocab.TOKEN_FUTURE_SKEW_SECONDS, "issued_in_future").when(at - issued > vocab.TOKEN_TTL_SECONDS, "expired").when(~https, "unsafe_destination")
    )
    df = df.withColumn("reason", reason)
    context = F.to_json(F.struct(F.lit(1).alias("redirect_version"), F.col("p.source").alias("source"), F.col("p.event_type").alias("event_type"), F.col("p.partner_name").alias("partner")))
    good = df.filter(F.col("reason").isNull()).select(
        F.concat(F.lit(vocab.CLICK_PREFIX), F.col("p.jti")).alias("click_id"), F.col("received_at").alias("created_at"), F.col("p.event_id").alias("event_id"), F.col("p.partner_key").alias("partner_key"),
        F.col("p.partner_name").alias("partner_name"), F.col("p.campaign_id").alias("campaign_id"), url.alias("destination_url"), context.alias("context_json"),
    )
    return good, df.filter(F.col("reason").isNotNull()).select("token", "received_at", "reason")


# --- impressions and windows (T6, T8) ----------------------------------------------------------

def impressions_once(log: DataFrame, streaming: bool = True) -> DataFrame:
    """One impression per session, filter signature and listing: log(session_id, signature, event_id, occurred_at)."""
    keyed = log.withColumn("_k", impression_key("signature", "event_id"))
    if streaming:
        return keyed.withWatermark("occurred_at", LATE).dropDuplicatesWithinWatermark(["session_id", "_k"]).drop("_k")
    return keyed.dropDuplicates(["session_id", "_k"]).drop("_k")


def funnel_stream(steps: DataFrame, width: str = "1 hour") -> DataFrame:
    """Hourly funnel; a window closes once the watermark has passed it."""
    return windowed_funnel(steps.withWatermark("occurred_at", LATE), width)


def sessions_stream(steps: DataFrame, gap: str = "30 minutes") -> DataFrame:
    """Steps per user session."""
    rows = steps.withWatermark("occurred_at", LATE).groupBy("user_id", F.session_window("occurred_at", gap).alias("w"))
    return rows.agg(F.count("*").alias("steps")).select("user_id", F.col("w.start").alias("started"), F.col("w.end").alias("ended"), "steps")


# --- daily snapshot (T7) -------------------------------------------------------------------------

def snapshot_sink(path: str):
    """Replaces the (source, day) rows of each micro-batch in the snapshot table."""
    from playbill.operators.candidates import write_snapshots

    def sink(batch: DataFrame, batch_id: int) -> None:
        for row in batch.select("snapshot_day").distinct().collect():  # the days of one micro-batch
            write_snapshots(batch.filter(F.col("snapshot_day") == F.lit(row.snapshot_day)), path, row.snapshot_day)

    return sink


SCHEMAS = {"engagement": ENGAGEMENT, "clicks": CLICKS, "conversions": CONVERSIONS}
