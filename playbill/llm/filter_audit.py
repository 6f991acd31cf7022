"""Audit of how filters interact over all orders of applying them, by folds of higher-order functions.

Every document fails some of the filters; the failures are one bit mask.  Documents are counted by
part and mask, so a part has at most 2 ** filters cells whatever its size.  Each cell is folded over
the array of all orders, a constant of the plan: `transform` walks the orders, `aggregate` walks the
steps of one order and keeps what the steps before removed.  That gives one weighted struct for
each order and step, 600 for five filters, and the structs of a part's cells are added element by
element.  No document is read for an order: the work beyond the cells depends on the parts alone.

The duplicate filter asks whether a smaller id has the same text anywhere.  Texts meet as SHA-256
digests, one narrow row each; of every digest the smallest id is found by an aggregation that
combines on the map side, and the rows are not joined back: those of the smallest id are subtracted
from all rows of their cell.  So a text that a third of all documents share is no hot group.

Defined cases: null text is empty, null source is the part '' together with an empty one; rows
without id are no duplicates, nor are others duplicates of them, and no label is theirs; repeated
rows of one id are not duplicates of each other; a label counts for an id if any of its rows holds
1; an empty table gives no parts and so no rows; further columns are not looked at.
"""

from __future__ import annotations

import itertools

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from playbill.llm.common import WORD

# Name, and the failure as whole-number arithmetic on the measurements; the last filter is the duplicate one.
CONDITIONS: tuple[tuple[str, str], ...] = (
    ("A", "n_words < 50"),
    ("B", "100 * n_distinct < 65 * n_words"),
    ("C", "100 * n_capitals > 5 * n_chars"),
    ("D", "has_symbol"),
)
DUPLICATE = "E"
COUNTS = ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost")


def orders(filters: int) -> list[tuple[int, ...]]:
    return list(itertools.permutations(range(filters)))


def measured(docs: DataFrame) -> DataFrame:
    """(doc_id, part, digest, and what the conditions measure) of every whole text."""
    text = F.coalesce("text", F.lit(""))
    words = F.regexp_extract_all(text, F.lit(WORD), F.lit(0))
    # The word array is bound once and measured twice.
    sizes = F.transform(F.array(words), lambda w: F.struct(F.size(w).alias("n"), F.size(F.array_distinct(w)).alias("d")))[0]
    return docs.select(
        "doc_id", F.coalesce("source", F.lit("")).alias("part"), F.unhex(F.sha2(text.cast("binary"), 256)).alias("digest"), sizes.alias("words"),
        F.regexp_count(text, F.lit("[A-Z]")).cast("bigint").alias("n_capitals"), F.length(text).cast("bigint").alias("n_chars"), text.rlike("[#$%&*|]").alias("has_symbol"),
    ).withColumns({"n_words": F.col("words.n").cast("bigint"), "n_distinct": F.col("words.d").cast("bigint")}).drop("words")


def masks(docs: DataFrame, conditions=CONDITIONS) -> DataFrame:
    """(doc_id, part, digest, mask): a bit for each failed condition, in their order."""
    bits = [F.when(F.expr(c), F.lit(1 << i)).otherwise(0) for i, (_, c) in enumerate(conditions)]
    return measured(docs).select("doc_id", "part", "digest", sum(bits, F.lit(0)).cast("int").alias("mask"))


def cells(docs: DataFrame, labels: DataFrame, conditions=CONDITIONS) -> DataFrame:
    """(part, mask, n, good, toxic): documents by part and failed filters, the duplicate bit being the highest."""
    twin = 1 << len(conditions)
    # Copies of one id are counted here, so neither a hot id nor a hot text travels row by row.
    rows = masks(docs, conditions).groupBy("digest", "doc_id", "part", "mask").agg(F.count("*").alias("n"))
    known = rows.filter("doc_id IS NOT NULL")
    # One row for each text and part, the one of the smallest id there; then the smallest of the parts.
    least = known.groupBy("digest", "part", "mask").agg(F.min(F.struct("doc_id", "n")).alias("first"))
    smallest = least.groupBy("digest").agg(F.min("first.doc_id").alias("doc_id"), F.collect_list(F.struct("part", "mask", "first")).alias("parts"))
    first = smallest.select("doc_id", F.explode(F.filter("parts", lambda p: p["first"]["doc_id"] == F.col("doc_id"))).alias("p")).select("doc_id", "p.part", "p.mask", F.lit(0).alias("n"), F.col("p.first.n").alias("firsts"))
    by_id = known.select("doc_id", "part", "mask", "n", F.lit(0).cast("bigint").alias("firsts")).unionByName(first)
    by_id = by_id.groupBy("doc_id", "part", "mask").agg(F.sum("n").alias("n"), F.sum("firsts").alias("firsts"))
    marks = labels.filter("doc_id IS NOT NULL").groupBy(F.col("doc_id").alias("label_id")).agg(F.max((F.col("quality") == 1).cast("bigint")).alias("good"), F.max((F.col("toxic") == 1).cast("bigint")).alias("toxic"))
    one = by_id.join(marks, by_id.doc_id == marks.label_id, "left").select("part", "mask", "n", "firsts", F.coalesce("good", F.lit(0)).alias("good"), F.coalesce("toxic", F.lit(0)).alias("toxic"))
    one = one.unionByName(rows.filter("doc_id IS NULL").select("part", "mask", "n", F.col("n").alias("firsts"), F.lit(0).cast("bigint").alias("good"), F.lit(0).cast("bigint").alias("toxic")))
    both = one.select("part", "good", "toxic", F.explode(F.array(F.struct("mask", F.col("firsts").alias("n")), F.struct((F.col("mask") + twin).alias("mask"), (F.col("n") - F.col("firsts")).alias("n")))).alias("c"))
    total = lambda flag: F.sum(F.col("c.n") * F.col(flag)).alias(flag)
    return both.groupBy("part", F.col("c.mask").alias("mask")).agg(F.sum("c.n").alias("n"), total("good"), total("toxic"))


def _steps(cell: Column, order: Column) -> Column:
    """The structs of one cell along one order: array of COUNTS, one for each step."""

    def step(acc: Column, bit: Column) -> Column:
        fails = cell["mask"].bitwiseAND(bit) != 0
        weigh = lambda test, by: F.when(test, cell[by]).otherwise(F.lit(0).cast("bigint"))
        here, alive = fails & acc["alive"], acc["alive"] & ~fails
        counts = (weigh(alive, "n"), weigh(here, "n"), weigh(fails & ~acc["alive"], "n"), weigh(cell["mask"] == bit, "n"), weigh(here, "good"), weigh(here, "toxic"))
        return F.struct(alive.alias("alive"), F.array_append(acc["out"], F.struct(*[c.alias(n) for c, n in zip(counts, COUNTS, strict=True)])).alias("out"))

    none = F.array().cast(f"array<struct<{','.join(f'{n}:bigint' for n in COUNTS)}>>")
    return F.aggregate(order, F.struct(F.lit(True).alias("alive"), none.alias("out")), step, lambda acc: acc["out"])


def fold(counted: DataFrame, names: str) -> DataFrame:
    """(part, filter_order, step, counts, shapley) of cells (part, mask, n, good, toxic); `names` holds a letter for each bit."""
    every = orders(len(names))
    listed = lambda items: f"array({', '.join(items)})"
    plan = F.expr(listed(listed(str(1 << f) for f in order) for order in every))
    zeros = F.array_repeat(F.struct(*[F.lit(0).cast("bigint").alias(n) for n in COUNTS]), len(every) * len(names))
    add = lambda a, b: F.struct(*[(a[n] + b[n]).alias(n) for n in COUNTS])
    weighted = lambda cell: F.flatten(F.transform(plan, lambda order: _steps(cell, order)))
    merged = F.aggregate("cells", zeros, lambda acc, cell: F.zip_with(acc, weighted(cell), add))
    # At most 2 ** filters cells meet in a part.
    parts = counted.groupBy("part").agg(F.collect_list(F.struct("mask", "n", "good", "toxic")).alias("cells")).select("part", merged.alias("steps"))
    spelled = F.expr(listed(f"'{''.join(names[f] for f in order)}'" for order in every))
    placed = F.transform("steps", lambda s, i: F.struct(
        F.element_at(spelled, (F.floor(i / len(names)) + 1).cast("int")).alias("filter_order"), (i % len(names) + 1).cast("int").alias("step"),
        *[s[n].alias(n) for n in COUNTS],
    ))
    letter = lambda row: F.substring(row["filter_order"], row["step"], 1)
    removed = lambda name: F.aggregate("rows", F.lit(0).cast("bigint"), lambda acc, row: acc + F.when(letter(row) == name, row["removed"]).otherwise(0))
    shares = F.create_map(*[x for name in names for x in (F.lit(name), removed(name))])
    flat = parts.select("part", placed.alias("rows")).withColumn("shares", shares).select("part", "shares", F.explode("rows").alias("row"))
    return flat.select("part", "row.*", F.element_at("shares", F.expr("substring(row.filter_order, row.step, 1)")).alias("shapley"))


def audit(docs: DataFrame, labels: DataFrame, conditions=CONDITIONS) -> DataFrame:
    return fold(cells(docs, labels, conditions), "".join(n for n, _ in conditions) + DUPLICATE)
