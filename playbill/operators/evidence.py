"""Evidence about extractors: batch audits, replay comparisons, expectation checks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from playbill.functions.text import ratio, txt

FAILED = "not_reviewable"
CANDIDATE = "parser_candidate"
COMPARED_FIELDS = ["start_time", "price"]


def batch(cases: DataFrame, limit: int | None = None, keys=("source", "field")) -> DataFrame:
    """Cases with a URL; with a limit the first ones per source and field, in case order (`case_ord`)."""
    linked = cases.filter(F.trim(txt("url")) != "")
    if limit is None:
        return linked
    w = Window.partitionBy(*keys).orderBy("case_ord")
    return linked.withColumn("_n", F.row_number().over(w)).filter(F.col("_n") <= max(1, limit)).drop("_n")


def batch_audit(reviews: DataFrame, keys=("source", "field")) -> DataFrame:
    """Status counts per source and field.  Failures are visible but not part of the rate."""
    is_ = lambda s: F.count_if(F.col("status") == s)
    out = reviews.groupBy(*keys).agg(
        F.count("*").alias("reviewed"), is_(FAILED).alias("failed"), is_(CANDIDATE).alias("parser_candidates"),
        F.count_if(F.coalesce(F.col("clean_attribution"), F.lit(False)) & (F.col("status") != FAILED)).alias("clean_reviewed"),
    )
    out = out.withColumn("analyzable", F.col("reviewed") - F.col("failed"))
    rate = ratio(F.col("parser_candidates"), F.col("analyzable"))
    verdict = (
        F.when(F.col("analyzable") < 3, "too_little_evidence")
        .when((F.col("parser_candidates") >= 3) & (rate >= 0.60), "recurring_candidate")
        .when(F.col("parser_candidates") == 0, "no_trend").otherwise("mixed_evidence")
    )
    return out.withColumns({"candidate_rate": rate, "classification": verdict})


def status_counts(reviews: DataFrame, keys=("source", "field")) -> DataFrame:
    return reviews.groupBy(*keys, "status").agg(F.count("*").alias("n"))


def evidence_patterns(reviews: DataFrame, keys=("source", "field"), examples: int = 3) -> DataFrame:
    """Dominant evidence kind of recurring candidates (first met on ties) with up to three examples.

    Counts and examples are found separately, so candidates are never collected.
    """
    keys = list(keys)
    recurring = batch_audit(reviews, keys).filter((F.col("classification") == "recurring_candidate") & (F.col("parser_candidates") >= 3))
    found = reviews.filter(F.col("status") == CANDIDATE).withColumn("kind", F.coalesce(F.nullif("kind", F.lit("")), F.lit("okänd")))
    kinds = found.groupBy(*keys, "kind").agg(F.count("*").alias("n"), F.min("case_ord").alias("first"))
    best = kinds.groupBy(*keys).agg(F.max_by("kind", F.struct("n", -F.col("first"))).alias("dominant_kind"), F.max("n").alias("dominant_count"))
    w = Window.partitionBy(*keys).orderBy("case_ord")
    few = found.withColumn("_n", F.row_number().over(w)).filter(F.col("_n") <= examples)
    shown = few.groupBy(*keys).agg(
        F.transform(F.array_sort(F.collect_list(F.struct("_n", "url", "value", "kind"))), lambda x: F.struct(x["url"].alias("url"), x["value"].alias("value"), x["kind"].alias("kind"))).alias("examples")
    )
    out = recurring.join(best, keys).join(shown, keys)
    return out.withColumn("dominant_share", ratio(F.col("dominant_count"), F.col("parser_candidates")))


# --- replay of two extractor versions ---------------------------------------------------

def replay_outcome(old: Column, new: Column) -> Column:
    return (
        F.when(old.eqNullSafe(new), "unchanged").when(old.isNull(), "recovered").when(new.isNull(), "regression").otherwise("changed")
    )


def compare_runs(old: DataFrame, new: DataFrame, keys=("url", "field")) -> DataFrame:
    """Two extraction runs on the same pages (`value` columns), row by row."""
    joined = old.select(*keys, F.col("value").alias("old_value")).join(new.select(*keys, F.col("value").alias("new_value")), list(keys), "full_outer")
    return joined.withColumn("outcome", replay_outcome(F.col("old_value"), F.col("new_value")))


def impact_audit(rows: DataFrame, keys=("field",), supported=COMPARED_FIELDS) -> DataFrame:
    """Recovered, lost and changed values per field; unreadable pages are not analysed."""
    is_ = lambda o: F.count_if(F.col("outcome") == o)
    known = F.col("field").isin(list(supported))
    out = rows.groupBy(*keys).agg(
        F.count("*").alias("reviewed"), F.count_if((F.col("outcome") != FAILED) & known).alias("analyzable"),
        is_("recovered").alias("recovered"), is_("regression").alias("regressions"), is_("changed").alias("changed"),
    )
    verdict = (
        F.when(~known, "field_not_compared").when(F.col("analyzable") < 3, "too_little_evidence")
        .when((F.col("regressions") > 0) | (F.col("changed") > 0), "check_deviation")
        .when(F.col("recovered") >= 2, "measurable_improvement").when(F.col("recovered") == 0, "no_effect").otherwise("small_effect")
    )
    return out.withColumn("classification", verdict)


# --- expectations -------------------------------------------------------------------------

def check_expectations(expected: DataFrame, actual: DataFrame, key: str = "id") -> DataFrame:
    """Expected against extracted values; a missing extraction counts as null."""
    joined = expected.join(actual.select(key, F.col("value").alias("actual")), key, "left")
    return joined.withColumn("passed", F.col("actual").eqNullSafe(F.col("expected")))


def expectation_summary(checked: DataFrame) -> DataFrame:
    out = checked.groupBy("source").agg(F.count("*").alias("total"), F.count_if("passed").alias("passed"))
    return out.withColumn("failed", F.col("total") - F.col("passed"))
