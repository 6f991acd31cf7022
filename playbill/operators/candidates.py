"""Candidate sources: value audit, daily snapshots, decisions and portfolio."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from playbill import vocab
from playbill.functions import booking
from playbill.functions.classify import frontier_segments
from playbill.functions.text import ratio
from playbill.operators import catalogue

_SETS = ["event_types", "unique_event_types", "frontier_segments", "unique_frontier_segments", "underserved_segments"]


def candidate_value_audit(merged: DataFrame, existing: DataFrame, candidates: DataFrame, names, today: dt.date) -> DataFrame:
    """What each candidate source would add.

    `merged` is the deduplicated union of existing and candidate listings.  Listings without a
    candidate are dropped before anything is worked out of their texts.  Sets are built from
    distinct (source, value) pairs, so nothing is collected per listing.
    """
    names = sorted(set(names))
    none = F.array().cast("array<string>")
    frontier = catalogue.coverage_frontier(existing, today)
    underserved = frontier.filter(F.col("status") != "good").agg(F.array_sort(F.collect_list("segment")).alias("_u"))  # sixteen at most
    asked = F.array(*[F.lit(n) for n in names]).cast("array<string>")
    own = lambda df: df.filter(F.arrays_overlap("source_names", asked)).withColumn("_names", F.array_distinct("source_names"))
    is_candidate = F.col("source").isin(names)

    raw = own(candidates).select(frontier_segments().alias("segments"), F.explode("_names").alias("source")).filter(is_candidate)
    raw_counts = raw.groupBy("source").agg(F.count("*").alias("candidate_events"))

    rows = (
        booking.with_cta(own(merged))
        .withColumns(
            {
                "segments": frontier_segments(), "kind": F.coalesce(F.nullif("event_type", F.lit("")), F.lit(vocab.UNKNOWN)),
                "bookable": F.col("cta_quality") == "bookable",
            }
        )
        .crossJoin(F.broadcast(underserved))  # one row
        .select("segments", "kind", "bookable", "_u", F.size("_names").alias("n"), F.explode("_names").alias("source"))
        .filter(is_candidate)
        .withColumns({"sole": F.col("n") == 1, "gap": F.array_intersect("segments", "_u")})
    )
    gap_hit = F.col("sole") & (F.size("gap") > 0)
    counts = rows.groupBy("source").agg(
        F.count_if("sole").alias("unique_events"), F.count_if(~F.col("sole")).alias("overlap_events"), F.count_if("bookable").alias("bookable"),
        F.count_if(gap_hit).alias("unique_events_in_underserved_segments"),
    )

    def entries(label, values: Column, cond=F.lit(True)):
        return F.when(cond, F.transform(values, lambda v: F.struct(F.lit(label).alias("label"), v.alias("value")))).otherwise(F.array())

    found = F.concat(
        entries("event_types", F.array("kind")), entries("unique_event_types", F.array("kind"), F.col("sole")),
        entries("unique_frontier_segments", F.col("segments"), F.col("sole")), entries("underserved_segments", F.col("gap"), F.col("sole")),
    )
    sets = (
        rows.select("source", F.inline(found))
        .unionByName(raw.select("source", F.inline(entries("frontier_segments", F.col("segments")))))
        .distinct().groupBy("source").agg(*[F.array_sort(F.collect_list(F.when(F.col("label") == s, F.col("value")))).alias(s) for s in _SETS])
    )
    every = candidates.sparkSession.createDataFrame([(n,) for n in names], "source string")
    out = every.join(raw_counts, "source", "left").join(counts, "source", "left").join(sets, "source", "left")
    zero = ["candidate_events", "unique_events", "overlap_events", "bookable", "unique_events_in_underserved_segments"]
    out = out.withColumns({c: F.coalesce(F.col(c), F.lit(0)) for c in zero}).withColumns({s: F.coalesce(F.col(s), none) for s in _SETS})
    total = F.col("unique_events") + F.col("overlap_events")
    return out.withColumns({"represented_after_dedupe": total, "unique_share": ratio(F.col("unique_events"), total)})


# --- daily snapshots -----------------------------------------------------------------

_COUNTS = ["candidate_events", "represented_after_dedupe", "unique_events", "overlap_events", "bookable", "unique_events_in_underserved_segments"]


def snapshot_rows(audit: DataFrame, health: DataFrame, recorded_at: dt.datetime) -> DataFrame:
    """Snapshot rows of one run: audited sources with their status, and failed sources without an audit row as zeros."""
    none = F.array().cast("array<string>")
    joined = audit.withColumn("_audited", F.lit(True)).join(health.select("source", F.nullif("status", F.lit("")).alias("status")), "source", "full_outer")
    status = F.coalesce("status", F.when(F.col("_audited"), "Okänd").otherwise("Fel"))
    return joined.select(
        "source", F.lit(recorded_at.date()).alias("snapshot_day"), F.lit(recorded_at).cast("timestamp").alias("recorded_at"), status.alias("status"),
        *[F.coalesce(c, F.lit(0)).cast("int").alias(c) for c in _COUNTS[:4]], F.col("unique_share"), F.coalesce("bookable", F.lit(0)).cast("int").alias("bookable"),
        *[F.coalesce(s, none).alias(s) for s in _SETS],
        F.coalesce(_COUNTS[5], F.lit(0)).cast("int").alias(_COUNTS[5]),
    )


def replace_snapshots(existing: DataFrame, new: DataFrame) -> DataFrame:
    """History with the new rows replacing any row of the same source and day."""
    return existing.join(new.select("source", "snapshot_day"), ["source", "snapshot_day"], "left_anti").unionByName(new)


def write_snapshots(new: DataFrame, path: str, day: dt.date) -> None:
    """Replaces the day's rows of the given sources; other sources and days stay.

    The day's partition is rebuilt beside the table and overwritten on its own, so a
    lost executor or a repeated run leaves the same table.
    """
    from playbill.schema import SNAPSHOT
    from playbill.session import cut

    spark = new.sparkSession
    jvm_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    rows = new
    if jvm_path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(jvm_path):
        today = spark.read.schema(SNAPSHOT).parquet(path).filter(F.col("snapshot_day") == F.lit(day))
        rows = replace_snapshots(today, new)
    cut(rows).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("snapshot_day").parquet(path)


def history(spark, path: str, source: str | None = None) -> DataFrame:
    from playbill.schema import SNAPSHOT

    df = spark.read.schema(SNAPSHOT).parquet(path)
    return (df.filter(F.col("source") == source) if source else df).orderBy("snapshot_day", "source")


# --- decisions -------------------------------------------------------------------------

def _evidence(snapshots: DataFrame, keys=("source",)) -> DataFrame:
    """Medians over successful runs only; days and run counts over all runs."""
    ok = F.lower(F.coalesce("status", F.lit(""))) == "ok"
    only = lambda c: F.when(ok, F.col(c))
    out = snapshots.groupBy(*keys).agg(
        F.count("*").alias("snapshots"), F.count_distinct("snapshot_day").alias("distinct_days"), F.count_if(ok).alias("successes"),
        F.median(only("unique_events")).alias("median_unique_events"), F.median(only("unique_share")).alias("median_unique_share"),
        F.median(only("unique_events_in_underserved_segments")).alias("median_gap_events"),
        F.avg(F.when(ok, (F.col("unique_events") == 0).cast("double"))).alias("zero_unique_rate"),
        *[F.array_sort(F.array_distinct(F.flatten(F.collect_set(only(s))))).alias(s) for s in _SETS[1:2] + _SETS[3:]],
    )
    return out.withColumn("success_rate", ratio(F.col("successes"), F.col("snapshots")))


def decisions(snapshots: DataFrame) -> DataFrame:
    """activate, keep_measuring or reject.  Rejections are tested before activation."""
    e = _evidence(snapshots)
    n, days, rate = F.col("snapshots"), F.col("distinct_days"), F.col("success_rate")
    med, share, gap = F.col("median_unique_events"), F.col("median_unique_share"), F.col("median_gap_events")
    has = lambda c: F.size(c) > 0
    yes = lambda c: F.coalesce(c, F.lit(False))
    unstable = (n >= 4) & yes(rate <= 0.50)
    redundant = (n >= 4) & yes(share <= 0.10) & ~has("unique_event_types") & ~has("unique_frontier_segments")
    enough = (n >= 3) & (days >= 3) & yes(rate >= 0.80)
    volume, strong_share = yes(med >= 3), yes(share >= 0.35)
    frontier = has("underserved_segments") & yes(gap >= 1)
    valuable = (volume | strong_share) & (has("unique_event_types") | has("unique_frontier_segments") | frontier | yes(med >= 5))
    activate = enough & valuable
    decision = F.when(unstable | redundant, "reject").when(activate, "activate").otherwise("keep_measuring")
    pct = lambda c: F.format_string("%.0f", c * 100)
    open_case = ~unstable & ~redundant & ~enough
    live = ~unstable & ~redundant & activate
    reasons = F.array_compact(
        F.array(
            F.when(unstable, F.concat(F.lit("parser_success "), pct(rate))),
            F.when(~unstable & redundant, F.concat(F.lit("median_share "), pct(share))),
            F.when(~unstable & redundant, F.lit("no_unique_type_or_segment")),
            F.when(live, F.concat(F.lit("stable "), pct(rate))),
            F.when(live & volume, F.concat(F.lit("median_unique "), F.format_string("%.0f", med))),
            F.when(live & strong_share, F.concat(F.lit("median_share "), pct(share))),
            F.when(live & has("unique_event_types"), F.concat(F.lit("unique_types: "), F.array_join("unique_event_types", ", "))),
            F.when(live & frontier, F.concat(F.lit("gap_segments: "), F.array_join("underserved_segments", ", "))),
            F.when(~unstable & ~redundant & enough & ~valuable, F.lit("value_not_yet_strong")),
            F.when(open_case & ((n < 3) | (days < 3)), F.concat(F.lit("needs_3_snapshots_on_3_days "), n.cast("string"), F.lit("/"), days.cast("string"))),
            F.when(open_case & yes(rate < 0.80), F.concat(F.lit("stability_below_80 "), pct(rate))),
            F.when(open_case & med.isNotNull(), F.concat(F.lit("median_unique "), F.format_string("%.0f", med))),
            F.when(open_case & share.isNotNull(), F.concat(F.lit("median_share "), pct(share))),
        )
    )
    return e.withColumns({"decision": decision, "reasons": reasons})


def portfolio(snapshots: DataFrame) -> DataFrame:
    """Work priority per candidate; the decision stays with `decisions`."""
    d = decisions(snapshots).drop("reasons")
    n, days, rate = F.col("snapshots"), F.col("distinct_days"), F.col("success_rate")
    gap, med, share = (F.coalesce(c, F.lit(0.0)) for c in ("median_gap_events", "median_unique_events", "median_unique_share"))
    yes = lambda c: F.coalesce(c, F.lit(False))
    priority = (
        F.when(F.col("decision") == "activate", "activation_candidate")
        .when(F.col("decision") == "reject", "low")
        .when((n >= 4) & yes(rate < 0.80), "parser_problem")
        .when((days >= 4) & yes(F.col("zero_unique_rate") >= 0.75) & (gap == 0), "low")
        .when((days >= 3) & (gap >= 1), "prioritise_measuring")
        .when((days >= 3) & ((med >= 2) | (share >= 0.30)), "prioritise_measuring")
        .otherwise("keep_measuring")
    )
    evidence = (
        F.when((days >= 4) & (n >= 4), "stable").when((days >= 3) & (n >= 3), "activation_ready").when(days >= 2, "growing").otherwise("too_little")
    )
    rank = F.create_map(*[F.lit(x) for kv in {"activation_candidate": 0, "prioritise_measuring": 1, "parser_problem": 2, "keep_measuring": 3, "low": 4}.items() for x in kv])
    return d.withColumns({"priority": priority, "evidence": evidence}).withColumn("priority_ord", rank[F.col("priority")])
