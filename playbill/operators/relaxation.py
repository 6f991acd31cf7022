"""Zero-result relaxation: the smallest single widening that finds something.

All scenarios of all requests are constants, so one scan counts the hits of every
scenario; the counts (a few rows per request) decide, and a second scan ranks the
chosen scenarios only.  Query and type are never relaxed.
"""

from __future__ import annotations

from dataclasses import dataclass, replace

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from playbill import vocab
from playbill.functions.scoring import SearchRequest
from playbill.operators import productions, ranking

KIND_ORDER = {"time": 1, "radius": 2, "price": 3, "new": 4, "time_radius": 5}
MAX_SUGGESTIONS = 3


@dataclass(frozen=True)
class Scenario:
    request: SearchRequest  # with the relaxed constraint already applied
    base_id: str
    kind: str
    step: int


def scenarios(r: SearchRequest) -> list[Scenario]:
    periods = vocab.WIDER_PERIODS.get(r.when, [])
    radii = [x for x in vocab.RADIUS_STEPS if r.radius_km is not None and x > r.radius_km] if r.origin_city else []
    made = [("base", 0, r)]
    made += [("time", i, replace(r, when=p)) for i, p in enumerate(periods)]
    made += [("radius", i, replace(r, radius_km=x)) for i, x in enumerate(radii)]
    if r.price != "any":
        made.append(("price", 0, replace(r, price="any")))
    if r.only_new:
        made.append(("new", 0, replace(r, only_new=False)))
    both = [(p, x) for p in periods for x in radii]
    made += [("time_radius", i, replace(r, when=p, radius_km=x)) for i, (p, x) in enumerate(both)]
    return [Scenario(replace(q, request_id=f"{r.request_id}|{kind}|{step}"), r.request_id, kind, step) for kind, step, q in made]


def scenario_hits(listings: DataFrame, requests: list[SearchRequest]) -> DataFrame:
    """(request_id, kind, step, hits) of every scenario, zero counts included."""
    plans = [s for r in requests for s in scenarios(r)]
    df, names = ranking.prepare(listings, [s.request for s in plans])
    counts = df.agg(*[F.count_if(ranking.request_matches(s.request, ranking._km(names, s.request))).alias(f"n{i}") for i, s in enumerate(plans)])
    rows = F.array(
        *[
            F.struct(F.lit(s.base_id).alias("request_id"), F.lit(s.kind).alias("kind"), F.lit(s.step).alias("step"), F.col(f"n{i}").alias("hits"))
            for i, s in enumerate(plans)
        ]
    )
    return counts.select(F.inline(rows))


def choose(hits: DataFrame) -> DataFrame:
    """First step with hits per kind, for requests without base hits; the combined kind only as a last resort."""
    by_request = Window.partitionBy("request_id")
    # Scenarios without hits may be left out, the base too.
    base = F.coalesce(F.max(F.when(F.col("kind") == "base", F.col("hits"))).over(by_request), F.lit(0))
    live = hits.withColumn("_base", base).filter((F.col("_base") == 0) & (F.col("kind") != "base") & (F.col("hits") > 0))
    first = live.withColumn("_n", F.row_number().over(Window.partitionBy("request_id", "kind").orderBy("step"))).filter(F.col("_n") == 1)
    order = F.create_map(*[F.lit(x) for kv in KIND_ORDER.items() for x in kv])[F.col("kind")]
    ranked = first.withColumn("suggestion", F.row_number().over(by_request.orderBy(order)))
    keep = F.when(F.col("kind") == "time_radius", F.col("suggestion") == 1).otherwise(F.col("suggestion") <= MAX_SUGGESTIONS)
    return ranked.filter(keep).select("request_id", "kind", "step", "hits", "suggestion")


SHOWN = ["city", "category", "tags", "end_date", "official_url"]  # what a production is told by, besides the ranked columns


def claim(ranked: DataFrame, per_suggestion: int) -> DataFrame:
    """The cards of each suggestion: what an earlier suggestion of the request shows is not shown again.

    Suggestions take in their order.  A listing, or any listing of a production, belongs to the first
    that takes it; the later ones go on with their next ranks.  At most `MAX_SUGGESTIONS` first pages
    of a request meet in a group.
    """
    rows = productions.production_columns(ranked.withColumn("g", F.lit("")))
    out = T.StructType([*ranked.drop("position", *SHOWN).schema.fields, T.StructField("position", T.IntegerType())])
    names = [f.name for f in out]

    def take(pdf: pd.DataFrame) -> pd.DataFrame:
        order = pdf.sort_values(["suggestion", "position"]).index
        records = dict(zip(pdf.index, pdf.astype(object).where(lambda x: x.notna(), None).to_dict("records")))
        taken: list[dict] = []
        shown: dict[int, list] = {}
        for i in order:
            row = records[i]
            cards = shown.setdefault(row["suggestion"], [])
            if len(cards) < per_suggestion and not any(x["id"] == row["id"] or productions.same_card(x, row) for x in taken):
                cards.append(i)
                taken.append(row)
        kept = pdf.loc[[i for cards in shown.values() for i in cards]].copy()
        kept["position"] = [n for cards in shown.values() for n in range(1, len(cards) + 1)]
        return kept[names]

    return rows.groupBy("base_id").applyInPandas(take, out)


def suggest(listings: DataFrame, requests: list[SearchRequest], per_suggestion: int = 3) -> DataFrame:
    """Chosen relaxations with their best listings, none of them shown twice for a request."""
    plans = {s.request.request_id: s for r in requests for s in scenarios(r)}
    picked = choose(scenario_hits(listings, requests)).collect()  # at most three rows per request
    chosen = [plans[f"{p.request_id}|{p.kind}|{p.step}"] for p in picked] or [next(iter(plans.values()))]
    source = listings if picked else listings.limit(0)
    best = ranking.diversify(ranking.score_requests(source, [s.request for s in chosen], keep=SHOWN), ranking.PAGE)
    info = {s.request.request_id: p for s, p in zip(chosen, picked)}

    def field(get, kind: str) -> Column:
        return F.create_map(*[F.lit(x) for key, p in info.items() for x in (key, get(p))])[F.col("request_id")] if info else F.lit(None).cast(kind)

    named = best.withColumns({"kind": field(lambda p: p.kind, "string"), "step": field(lambda p: p.step, "int"), "suggestion": field(lambda p: p.suggestion, "int"), "base_id": field(lambda p: p.request_id, "string")})
    return claim(named, per_suggestion).withColumn("request_id", F.col("base_id")).drop("base_id")
