"""Day summaries that merge: any horizon is a sum over its days, no listing or run is read again.

Counts add up.  Distinct ids are HyperLogLog sketches, medians KLL sketches; both merge without
loss beyond their own error.  The exact reports over listings and runs stay beside them; counts
from summaries are exact too, since a listing lies in one day.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from playbill.functions.dates import parse_day
from playbill.functions.text import clean_names, ratio

LG_K = 12  # 4,096 registers: distinct counts within about 1.6 %
MEDIANS = ["unique_events", "unique_share", "unique_events_in_underserved_segments"]


def source_days(listings: DataFrame) -> DataFrame:
    """(source, day, represented, unique, overlap, ids): what each source lists for each day; demo rows and rows without a day are left out."""
    live = listings.filter(~F.coalesce("is_demo", F.lit(False))).select("id", parse_day("start_date").alias("day"), clean_names("source_names").alias("names")).filter(F.col("day").isNotNull())
    rows = live.select("id", "day", F.size("names").alias("n"), F.explode("names").alias("source"))
    return rows.groupBy("source", "day").agg(
        F.count("*").alias("represented"), F.count_if(F.col("n") == 1).alias("unique"), F.count_if(F.col("n") > 1).alias("overlap"), F.hll_sketch_agg("id", F.lit(LG_K)).alias("ids"),
    )


def source_value(days: DataFrame, today: dt.date, horizon: int) -> DataFrame:
    """Represented, unique and overlapping listings of each source from today on, for so many days; `listed` estimates the distinct ids."""
    inside = days.filter(F.col("day").between(F.lit(today), F.lit(today + dt.timedelta(days=max(1, horizon)))))
    out = inside.groupBy("source").agg(*[F.sum(c).alias(c) for c in ("represented", "unique", "overlap")], F.hll_sketch_estimate(F.hll_union_agg("ids")).alias("listed"))
    return out.withColumn("unique_share", ratio(F.col("unique"), F.col("represented")))


def merged(days: DataFrame) -> DataFrame:
    """Summaries of the same source and day as one, as when late rows or another part of the catalogue come in."""
    return days.groupBy("source", "day").agg(*[F.sum(c).alias(c) for c in ("represented", "unique", "overlap")], F.hll_union_agg("ids").alias("ids"))


def run_days(snapshots: DataFrame) -> DataFrame:
    """(source, day, runs, successes, one KLL sketch for each measure) of candidate runs; medians look at successful runs alone."""
    ok = F.lower(F.coalesce("status", F.lit(""))) == "ok"
    sketch = lambda c: F.kll_sketch_agg_double(F.when(ok, F.col(c)).cast("double")).alias(c)
    return snapshots.groupBy("source", F.col("snapshot_day").alias("day")).agg(F.count("*").alias("runs"), F.count_if(ok).alias("successes"), *[sketch(c) for c in MEDIANS])


def _median(sketch: Column) -> Column:
    return F.when(F.kll_sketch_get_n_double(sketch) > 0, F.kll_sketch_get_quantile_double(sketch, F.lit(0.5)))


def evidence(days: DataFrame, since: dt.date | None = None) -> DataFrame:
    """(source, snapshots, distinct_days, success_rate, medians) over all days, or those since a date."""
    inside = days if since is None else days.filter(F.col("day") >= F.lit(since))
    out = inside.groupBy("source").agg(
        F.sum("runs").alias("snapshots"), F.count_distinct("day").alias("distinct_days"), F.sum("successes").alias("successes"), *[F.kll_merge_agg_double(c).alias(c) for c in MEDIANS],
    )
    return out.select("source", "snapshots", "distinct_days", ratio(F.col("successes"), F.col("snapshots")).alias("success_rate"), *[_median(F.col(c)).alias(f"median_{c}") for c in MEDIANS])
