"""Recall of an independent reference sample against the catalogue."""

from __future__ import annotations

from collections import defaultdict

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from playbill import vocab
from playbill.functions.classify import recall_segment
from playbill.functions.similarity import letter_counts, plain_recall_score, ratio_bound, seq_ratio
from playbill.functions.text import ratio, recall_title, txt
from playbill.session import cut


LOOP_ROWS = 200_000  # references and listings of a day and city that one task takes in order


def _scored_titles(refs: DataFrame, listings: DataFrame, floor: float) -> tuple[DataFrame, DataFrame, DataFrame]:
    """References, listings and (d, c, rt, lt, score) of their titles on the same day and in the same city.

    Scored on distinct titles per side, and at most as many listings per (day, city,
    title) as the day and city have references: further copies can never be used up.
    """
    r = refs.select(F.col("ref_ord"), txt("start_date").alias("d"), recall_title("city").alias("c"), recall_title("title").alias("rt"))
    block = r.groupBy("d", "c").agg(F.count("*").alias("n_refs"))
    rows = listings.filter(~F.coalesce("is_demo", F.lit(False))).select(
        F.col("ingest_ord").alias("listing_ord"), txt("start_date").alias("d"), recall_title("city").alias("c"), recall_title("title").alias("lt")
    ).join(block, ["d", "c"])
    w = Window.partitionBy("d", "c", "lt").orderBy("listing_ord")
    # The literal bound lets every task drop surplus copies before they are shuffled together.
    most = block.agg(F.coalesce(F.max("n_refs"), F.lit(0)).alias("m")).first().m
    rows = cut(rows.withColumn("copy", F.row_number().over(w)).filter((F.col("copy") <= most) & (F.col("copy") <= F.col("n_refs"))))
    a, b = F.col("rt"), F.col("lt")
    titles = rows.select("d", "c", "lt").distinct().withColumn("ln", letter_counts(b))
    pairs = r.select("d", "c", "rt").distinct().withColumn("rn", letter_counts(a)).join(titles, ["d", "c"])
    # Python sees a pair only where the letters of both leave its sequence ratio a chance to decide.
    bounded = pairs.select("d", "c", "rt", "lt", plain_recall_score(a, b).alias("plain"), F.when((a == "") | (b == ""), 0.0).otherwise(ratio_bound(a, b, F.col("rn"), F.col("ln"))).alias("bound"))
    undecided = (F.col("bound") > F.col("plain")) & (F.col("bound") >= floor)
    settled = bounded.filter(~undecided & (F.col("plain") >= floor)).withColumn("score", F.col("plain"))
    open_ = bounded.filter(undecided).withColumn("score", F.greatest("plain", seq_ratio(a, b))).filter(F.col("score") >= floor)
    return r, rows, settled.unionByName(open_).select("d", "c", "rt", "lt", "score")


def _pairs(r: DataFrame, rows: DataFrame, scored: DataFrame) -> DataFrame:
    return scored.join(r, ["d", "c", "rt"]).join(rows, ["d", "c", "lt"]).select("ref_ord", "listing_ord", "score")


def candidates(refs: DataFrame, listings: DataFrame, floor: float = vocab.RECALL_TITLE_FLOOR) -> DataFrame:
    """(ref_ord, listing_ord, score) of pairs on the same day and in the same city."""
    return _pairs(*_scored_titles(refs, listings, floor))


def in_order(options: list[tuple], stock: dict[str, list[int]], refs: list[tuple]) -> list[tuple]:
    """(ref_ord, listing_ord, score) of a day and city: (ref_ord, title) in order each take their best unused listing.

    Of a title only the first unused listing can be the best, so titles are compared, not listings.
    """
    by_title, used, out = defaultdict(list), defaultdict(int), []
    for rt, lt, score in options:
        if lt in stock:
            by_title[rt].append((score, lt))
    for ref_ord, rt in refs:
        best = max(((score, -stock[lt][used[lt]], lt) for score, lt in by_title.get(rt, ()) if used[lt] < len(stock[lt])), default=None)
        if best is not None:
            used[best[2]] += 1
            out.append((ref_ord, -best[1], best[0]))
    return out


def _loops(r: DataFrame, rows: DataFrame, scored: DataFrame) -> DataFrame:
    """Days with their cities one after the other within sorted partitions; one is in memory at a time."""
    import pyarrow as pa

    schema = pa.schema([("ref_ord", pa.int64()), ("listing_ord", pa.int64()), ("score", pa.float64())])
    none = lambda kind: F.lit(None).cast(kind)
    block = F.concat_ws("\u0001", "d", "c").alias("block")
    parts = [
        scored.select(block, F.lit(0).alias("kind"), none("bigint").alias("ord"), "rt", "lt", "score"),
        rows.select(block, F.lit(1).alias("kind"), F.col("listing_ord").alias("ord"), none("string").alias("rt"), "lt", none("double").alias("score")).distinct(),
        r.select(block, F.lit(2).alias("kind"), F.col("ref_ord").alias("ord"), "rt", none("string").alias("lt"), none("double").alias("score")).distinct(),
    ]

    def run(batches):
        def settled(held):
            options, stock, refs = held
            return pa.RecordBatch.from_pylist([dict(zip(schema.names, x)) for x in in_order(options, stock, refs)], schema)

        now, held = None, None
        for batch in batches:
            for block, kind, no, rt, lt, score in zip(*(c.to_pylist() for c in batch.columns)):
                if block != now:
                    if held:
                        yield settled(held)
                    now, held = block, ([], {}, [])
                if kind == 0:
                    held[0].append((rt, lt, score))
                elif kind == 1:
                    held[1].setdefault(lt, []).append(no)
                else:
                    held[2].append((no, rt))
        if held:
            yield settled(held)

    stream = parts[0].unionByName(parts[1]).unionByName(parts[2])
    return stream.repartition("block").sortWithinPartitions("block", "kind", "ord").mapInArrow(run, "ref_ord bigint, listing_ord bigint, score double")


def _rounds(options: DataFrame) -> DataFrame:
    """All listings prefer the earlier reference, so proposing in rounds, with every
    listing keeping the earliest proposer, ends in exactly that assignment.
    """
    options = cut(options)
    while True:
        w = Window.partitionBy("ref_ord").orderBy(F.col("score").desc(), "listing_ord")
        proposals = options.withColumn("_n", F.row_number().over(w)).filter(F.col("_n") == 1).drop("_n")
        held = proposals.groupBy("listing_ord").agg(F.min("ref_ord").alias("holder"))
        refused = proposals.join(held, "listing_ord").filter(F.col("ref_ord") != F.col("holder")).select("ref_ord", "listing_ord")
        refused = cut(refused)
        if refused.isEmpty():
            return proposals.select("ref_ord", "listing_ord", "score")
        options = cut(options.join(refused, ["ref_ord", "listing_ord"], "left_anti"))


def match(refs: DataFrame, listings: DataFrame, floor: float = vocab.RECALL_TITLE_FLOOR, loop_rows: int = LOOP_ROWS) -> DataFrame:
    """(ref_ord, listing_ord, score): each reference in order takes its best unused listing.

    A day and city is taken in order in one task; no pair of a reference and a listing is written for it.
    One with more rows than `loop_rows`, or with a key that is null or lies elsewhere too, is matched in rounds over its pairs.
    """
    r, rows, scored = _scored_titles(refs, listings, floor)
    r, scored, place = cut(r), cut(scored), ["d", "c"]

    def odd(df, key, title):
        keys = df.select(key, *place, title).distinct().groupBy(key).agg(F.count("*").alias("n"))
        keys = keys.filter((F.col("n") > 1) | F.col(key).isNull()).select(F.col(key).alias("_k"))
        return df.join(keys, F.col(key).eqNullSafe(F.col("_k")), "left_semi").select(*place)

    sizes = r.groupBy(*place).count().unionByName(rows.groupBy(*place).count()).groupBy(*place).agg(F.sum("count").alias("n"))
    apart = cut(sizes.filter(F.col("n") > loop_rows).select(*place).unionByName(odd(r, "ref_ord", "rt")).unionByName(odd(rows, "listing_ord", "lt")).distinct())
    if apart.isEmpty():
        return _loops(r, rows, scored)
    looped, paired = ([df.join(apart, place, how) for df in (r, rows, scored)] for how in ("left_anti", "left_semi"))
    return _loops(*looped).unionByName(_rounds(_pairs(*paired)).select("ref_ord", "listing_ord", "score"))


_DIMS = ["source", "category", "segment", "venue"]


def report(refs: DataFrame, matched: DataFrame) -> DataFrame:
    """Reference, matched and missed counts in total and per source, category, segment and venue."""
    label = lambda c: F.coalesce(F.nullif(txt(c), F.lit("")), F.lit(vocab.UNKNOWN))
    rows = refs.join(matched.select("ref_ord", F.lit(1).alias("hit")), "ref_ord", "left").select(
        F.coalesce("hit", F.lit(0)).alias("hit"), label("reference_source").alias("source"), label("category").alias("category"),
        recall_segment("category").alias("segment"), label("venue").alias("venue"),
    )
    small = rows.groupBy("source", "category", "segment", "venue").agg(F.count("*").alias("n"), F.sum("hit").alias("h"))
    sets = [[F.col(d)] for d in _DIMS] + [[]]
    out = small.groupingSets(sets, *_DIMS).agg(F.grouping_id().alias("_g"), F.sum("n").alias("reference_events"), F.sum("h").alias("matched"))
    dim = F.create_map(*[F.lit(x) for kv in {7: "source", 11: "category", 13: "segment", 14: "venue", 15: "total"}.items() for x in kv])[F.col("_g").cast("int")]
    out = out.withColumns({"dimension": dim, "name": F.coalesce(*_DIMS, F.lit("")), "missed": F.col("reference_events") - F.col("matched")})
    return out.select("dimension", "name", "reference_events", "matched", "missed", (ratio(F.col("matched"), F.col("reference_events")) * 100).alias("coverage_percent"))


def gaps(report_rows: DataFrame) -> DataFrame:
    """Names with missed references, most missed first."""
    rows = report_rows.filter((F.col("missed") > 0) & (F.col("dimension") != "total"))
    return rows.orderBy("dimension", F.col("missed").desc(), "coverage_percent", F.lower("name"))


def sample_quality(refs: DataFrame) -> DataFrame:
    """Counts per category, source and segment of the sample itself."""
    label = lambda c: F.coalesce(F.nullif(txt(c), F.lit("")), F.lit(vocab.UNKNOWN))
    cells = F.array(
        F.struct(F.lit("category").alias("dimension"), label("category").alias("name")), F.struct(F.lit("source").alias("dimension"), label("reference_source").alias("name")),
        F.struct(F.lit("segment").alias("dimension"), recall_segment(label("category")).alias("name")),
    )
    return refs.select(F.inline(cells)).groupBy("dimension", "name").agg(F.count("*").alias("n"))


def dominant(quality: DataFrame) -> DataFrame:
    """Largest value per dimension (larger name on ties) with its share."""
    out = quality.groupBy("dimension").agg(F.max_by("name", F.struct("n", "name")).alias("name"), F.max("n").alias("count"), F.sum("n").alias("total"))
    return out.select("dimension", "name", "count", (F.col("count") / F.col("total") * 100).alias("share_percent"))


def sample_warnings(quality: DataFrame) -> DataFrame:
    """One row: size, missing segments and warning codes."""
    spark = quality.sparkSession
    expected = spark.createDataFrame([(s,) for s, _ in vocab.RECALL_SEGMENTS], "name string")
    missing = expected.join(quality.filter(F.col("dimension") == "segment"), "name", "left_anti").agg(F.array_sort(F.collect_list("name")).alias("missing_segments"))
    top = dominant(quality).groupBy().agg(
        F.max(F.when(F.col("dimension") == "category", F.col("share_percent"))).alias("cat"), F.max(F.when(F.col("dimension") == "source", F.col("share_percent"))).alias("src")
    )
    total = quality.filter(F.col("dimension") == "category").agg(F.coalesce(F.sum("n"), F.lit(0)).alias("reference_events"))
    df = total.crossJoin(missing).crossJoin(top)  # one row each
    # Shares are compared as published, rounded to one decimal.
    from playbill.functions.text import codes

    warn = codes((F.col("reference_events") < 40, "small_sample"), (F.round("cat", 1) >= 50, "category_dominates"), (F.round("src", 1) >= 60, "source_dominates"), (F.size("missing_segments") > 0, "segments_missing"))
    return df.select("reference_events", "missing_segments", warn.alias("warnings"))
