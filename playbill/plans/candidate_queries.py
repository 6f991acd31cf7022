"""Candidate source and evidence queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from playbill.operators import candidates, evidence
from playbill.plans.registry import query
from playbill.plans.td import TODAY, table, with_td, listings


def _snapshots(spark, sf):
    """Line items as daily runs of candidate sources: supplier, ship date, ok when the line is finished."""
    rows = table(spark, sf, "lineitem")
    q = F.col("l_quantity").cast("int")
    one = lambda cond, value: F.when(cond, F.array(value)).otherwise(F.array().cast("array<string>"))
    return rows.select(
        F.concat(F.lit("S"), (F.col("l_suppkey") * 10 + F.col("l_linenumber")).cast("string")).alias("source"),
        F.to_date(F.date_trunc("year", "l_shipdate")).alias("snapshot_day"), F.when((F.col("l_linestatus") == "F") | (F.col("l_partkey") % 3 > 0), "ok").otherwise("Fel").alias("status"),
        (q % 7).alias("unique_events"), F.when(q % 11 != 0, (q % 10) / 20.0).alias("unique_share"), one((F.col("l_suppkey") % 3 == 0) & (q > 48), F.col("l_returnflag")).alias("unique_event_types"),
        one((F.col("l_suppkey") % 5 == 0) & (q > 45), F.col("l_linestatus")).alias("unique_frontier_segments"), one((F.col("l_suppkey") % 4 == 0) & (q > 40), F.lit("gap")).alias("underserved_segments"),
        (q % 3).alias("unique_events_in_underserved_segments"),
    )


_E = """s AS (SELECT 'S' || (l_suppkey * 10 + l_linenumber) AS source, CAST(date_trunc('year', l_shipdate) AS DATE) AS day, l_linestatus = 'F' OR l_partkey % 3 > 0 AS ok, CAST(l_quantity AS INTEGER) AS q, l_suppkey AS sk, l_returnflag, l_linestatus FROM lineitem),
e AS (SELECT source, count(*) AS n, count(DISTINCT day) AS days, count(*) FILTER (ok) / count(*) AS rate, median(q % 7) FILTER (ok) AS med, median(CASE WHEN q % 11 <> 0 THEN (q % 10) / 20.0::DOUBLE END) FILTER (ok) AS share,
  median(q % 3) FILTER (ok) AS gap, avg(CAST(q % 7 = 0 AS INT)) FILTER (ok) AS zero_rate, count(*) FILTER (ok AND sk % 3 = 0 AND q > 48) > 0 AS has_type, count(*) FILTER (ok AND sk % 5 = 0 AND q > 45) > 0 AS has_seg, count(*) FILTER (ok AND sk % 4 = 0 AND q > 40) > 0 AS has_gap
  FROM s GROUP BY source),
d AS (SELECT *, CASE WHEN n >= 4 AND rate <= 0.5 THEN 'reject' WHEN n >= 4 AND share <= 0.1 AND NOT has_type AND NOT has_seg THEN 'reject'
  WHEN n >= 3 AND days >= 3 AND rate >= 0.8 AND (coalesce(med >= 3, false) OR coalesce(share >= 0.35, false)) AND (has_type OR has_seg OR (has_gap AND coalesce(gap >= 1, false)) OR coalesce(med >= 5, false)) THEN 'activate' ELSE 'keep_measuring' END AS decision FROM e)"""


@query("candidate_decisions", f"WITH {_E} SELECT source, n AS snapshots, days AS distinct_days, round(rate, 9) AS success_rate, round(med, 6)::DOUBLE AS median_unique_events, round(share, 6)::DOUBLE AS median_unique_share, decision FROM d")
def candidate_decisions(spark, sf):
    out = candidates.decisions(_snapshots(spark, sf))
    return out.select("source", "snapshots", "distinct_days", *[F.round(c, n).alias(c) for c, n in (("success_rate", 9), ("median_unique_events", 6), ("median_unique_share", 6))], "decision")


@query("candidate_portfolio", f"""WITH {_E} SELECT source, decision, CASE WHEN decision = 'activate' THEN 'activation_candidate' WHEN decision = 'reject' THEN 'low' WHEN n >= 4 AND rate < 0.8 THEN 'parser_problem'
  WHEN days >= 4 AND zero_rate >= 0.75 AND coalesce(gap, 0) = 0 THEN 'low' WHEN days >= 3 AND coalesce(gap, 0) >= 1 THEN 'prioritise_measuring' WHEN days >= 3 AND (coalesce(med, 0) >= 2 OR coalesce(share, 0) >= 0.3) THEN 'prioritise_measuring' ELSE 'keep_measuring' END AS priority,
  CASE WHEN days >= 4 AND n >= 4 THEN 'stable' WHEN days >= 3 AND n >= 3 THEN 'activation_ready' WHEN days >= 2 THEN 'growing' ELSE 'too_little' END AS evidence FROM d""")
def candidate_portfolio(spark, sf):
    return candidates.portfolio(_snapshots(spark, sf)).select("source", "decision", "priority", "evidence")


@query("snapshot_replace", """WITH old AS (SELECT l_suppkey AS source, CAST(l_shipdate AS DATE) AS day, count(*) AS n FROM lineitem GROUP BY 1, 2),
new AS (SELECT l_suppkey AS source, DATE '2000-01-01' AS day, -count(*) AS n FROM lineitem GROUP BY 1) SELECT source, CAST(day AS VARCHAR) AS day, n FROM (SELECT * FROM old ANTI JOIN new USING (source, day) UNION ALL SELECT * FROM new)""")
def snapshot_replace(spark, sf):
    rows = table(spark, sf, "lineitem").select(F.col("l_suppkey").alias("source"), F.to_date("l_shipdate").alias("snapshot_day"))
    old = rows.groupBy("source", "snapshot_day").agg(F.count("*").alias("n"))
    new = rows.groupBy("source").agg((-F.count("*")).alias("n")).select("source", F.lit("2000-01-01").cast("date").alias("snapshot_day"), "n")
    return candidates.replace_snapshots(old, new).select("source", F.col("snapshot_day").cast("string").alias("day"), "n")


_AUDIT = ["Supplier#000000001", "Supplier#000000002", "Supplier#000000003", "Supplier#999999999"]


@query("candidate_value_audit", with_td(f"""c AS (SELECT unnest(source_names) AS source, event_type, len(source_names) AS n FROM td)
SELECT x.source, count(c.source) AS candidate_events, count(*) FILTER (n = 1) AS unique_events, count(*) FILTER (n > 1) AS overlap_events, coalesce(string_agg(DISTINCT event_type, '|' ORDER BY event_type), '') AS event_types
FROM (VALUES {', '.join(f"('{s}')" for s in _AUDIT)}) x(source) LEFT JOIN c ON x.source = c.source GROUP BY x.source"""))
def candidate_value_audit(spark, sf):
    df = listings(spark, sf)
    out = candidates.candidate_value_audit(df, df, df, _AUDIT, TODAY)
    return out.select("source", "candidate_events", "unique_events", "overlap_events", F.array_join("event_types", "|").alias("event_types"))


def _reviews(spark, sf):
    """Labelled documents as reviewed pages: the quality label says whether a value was found."""
    d, l = table(spark, sf, "documents"), table(spark, sf, "labels")
    status = F.when(F.col("quality").isNull(), evidence.FAILED).when(F.col("quality") == 1, evidence.CANDIDATE).otherwise("not_found")
    return d.join(l, "doc_id", "left").select(
        "source", F.lit("price").alias("field"), F.col("doc_id").alias("case_ord"), F.col("doc_id").cast("string").alias("url"), status.alias("status"), F.col("lang").alias("kind"),
        F.col("n_chars").cast("string").alias("value"), (F.col("doc_id") % 2 == 0).alias("clean_attribution"), "quality", "toxic",
    )


_V = "v AS (SELECT source, doc_id, lang, n_chars, quality, toxic, CASE WHEN quality IS NULL THEN 'not_reviewable' WHEN quality = 1 THEN 'parser_candidate' ELSE 'not_found' END AS status FROM documents LEFT JOIN labels USING (doc_id))"
_B = f"""{_V}, b AS (SELECT source, count(*) AS reviewed, count(*) FILTER (status <> 'not_reviewable') AS analyzable, count(*) FILTER (status = 'parser_candidate') AS parser_candidates,
  count(*) FILTER (doc_id % 2 = 0 AND status <> 'not_reviewable') AS clean_reviewed FROM v GROUP BY source),
c AS (SELECT *, CASE WHEN analyzable < 3 THEN 'too_little_evidence' WHEN parser_candidates >= 3 AND parser_candidates / analyzable >= 0.6 THEN 'recurring_candidate' WHEN parser_candidates = 0 THEN 'no_trend' ELSE 'mixed_evidence' END AS classification FROM b)"""


@query("evidence_batch", f"WITH {_B} SELECT source, reviewed, analyzable, parser_candidates, clean_reviewed, round(parser_candidates / nullif(analyzable, 0), 9) AS candidate_rate, classification FROM c")
def evidence_batch(spark, sf):
    out = evidence.batch_audit(_reviews(spark, sf))
    return out.select("source", "reviewed", "analyzable", "parser_candidates", "clean_reviewed", F.round("candidate_rate", 9).alias("candidate_rate"), "classification")


@query("evidence_pattern", f"""WITH {_B}, k AS (SELECT source, lang, count(*) AS n, min(doc_id) AS first FROM v WHERE status = 'parser_candidate' GROUP BY ALL)
SELECT c.source, k.lang AS dominant_kind, k.n AS dominant_count, x.urls AS examples FROM c JOIN k ON c.source = k.source
JOIN (SELECT source, string_agg(CAST(doc_id AS VARCHAR), ',' ORDER BY doc_id) AS urls FROM (SELECT * FROM v WHERE status = 'parser_candidate' QUALIFY row_number() OVER (PARTITION BY source ORDER BY doc_id) <= 3) GROUP BY source) x ON x.source = c.source
WHERE classification = 'recurring_candidate' QUALIFY row_number() OVER (PARTITION BY c.source ORDER BY k.n DESC, k.first) = 1""")
def evidence_pattern(spark, sf):
    out = evidence.evidence_patterns(_reviews(spark, sf))
    return out.select("source", "dominant_kind", "dominant_count", F.array_join(F.transform("examples", lambda x: x["url"]), ",").alias("examples"))


def _runs(spark, sf):
    l = table(spark, sf, "labels")
    value = lambda c: F.when(F.col(c) == 1, F.lit("v")).when(F.col("doc_id") % 5 == 0, F.lit("w"))
    base = [F.col("doc_id").cast("string").alias("url"), F.when(F.col("doc_id") % 2 == 0, "price").otherwise("start_time").alias("field")]
    return l.select(*base, value("quality").alias("value")), l.select(*base, value("toxic").alias("value"))


_R = "r AS (SELECT CASE WHEN doc_id % 2 = 0 THEN 'price' ELSE 'start_time' END AS field, CASE WHEN quality = 1 THEN 'v' WHEN doc_id % 5 = 0 THEN 'w' END AS o, CASE WHEN toxic = 1 THEN 'v' WHEN doc_id % 5 = 0 THEN 'w' END AS n FROM labels)"


@query("replay_impact", f"""WITH {_R}, x AS (SELECT field, count(*) AS reviewed, count(*) FILTER (o IS NULL AND n IS NOT NULL) AS recovered, count(*) FILTER (o IS NOT NULL AND n IS NULL) AS regressions, count(*) FILTER (o <> n) AS changed FROM r GROUP BY field)
SELECT *, CASE WHEN reviewed < 3 THEN 'too_little_evidence' WHEN regressions > 0 OR changed > 0 THEN 'check_deviation' WHEN recovered >= 2 THEN 'measurable_improvement' WHEN recovered = 0 THEN 'no_effect' ELSE 'small_effect' END AS classification FROM x""")
def replay_impact(spark, sf):
    old, new = _runs(spark, sf)
    return evidence.impact_audit(evidence.compare_runs(old, new)).drop("analyzable")


@query("expectations", "SELECT source, count(*) AS total, count(*) FILTER (quality IS NOT DISTINCT FROM toxic) AS passed, count(*) - count(*) FILTER (quality IS NOT DISTINCT FROM toxic) AS failed FROM documents LEFT JOIN labels USING (doc_id) GROUP BY source")
def expectations(spark, sf):
    l, d = table(spark, sf, "labels"), table(spark, sf, "documents")
    expected = d.join(l, "doc_id", "left").select(F.col("doc_id").alias("id"), "source", F.col("quality").alias("expected"))
    actual = l.select(F.col("doc_id").alias("id"), F.col("toxic").alias("value"))
    return evidence.expectation_summary(evidence.check_expectations(expected, actual))
