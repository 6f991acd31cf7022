"""Mixing sources to target weights by exponential keys (weighted sampling without replacement).

Every document draws a key -ln(u) / quality, u from a hash of its id and text, so reruns agree.  A source
is taken in complete epochs first; what is left of its target goes to the documents with the
smallest keys, by a prefix sum of sizes, up to the document whose middle reaches the rest.

The prefix sum has two levels: sums of (source, key bucket), then a window inside one bucket, so
a hot source is spread over `BUCKETS` groups.  No text is shuffled.

Defined cases: null text or a text without words has size 0 and quality 1; null sources are a
source of their own, last in order; equal keys go by id, then size; repeated rows are documents
of their own; an empty table gives no rows; further columns of the input are not looked at.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from playbill.llm.common import WORD, carried, fold_id, with_key
from playbill.session import cut

WEIGHTS = (5, 2, 1)
MOST_EPOCHS = 3
BUCKETS = 4096
SEED = "mix-1:"
SYMBOLS = "#*$%&|<>!"


def measured(docs: DataFrame) -> DataFrame:
    """(doc_id, _id, _k, source, size, key): one narrow row per document."""
    text = F.coalesce("text", F.lit(""))
    size = F.regexp_count(text, F.lit(WORD)).cast("bigint")
    marks = F.length(text) - F.length(F.translate(text, SYMBOLS, ""))
    # The text takes part, so that rows without id, or with one and the same, draw apart.
    draw = F.md5(F.concat(F.lit(SEED), F.coalesce(F.col("doc_id").cast("string"), F.lit("null")), F.lit(":"), F.md5(text.cast("binary"))).cast("binary"))
    u = (F.conv(F.substring(draw, 1, 12), 16, 10).cast("double") + 0.5) / float(1 << 48)
    quality = F.when(F.col("size") > 0, F.greatest(F.lit(0.1), 1.0 - F.col("marks") / F.col("size"))).otherwise(1.0)
    return (
        with_key(docs).select("doc_id", "_id", "_k", "source", size.alias("size"), marks.alias("marks"), u.alias("u"))
        .select("doc_id", "_id", "_k", "source", "size", (-F.log("u") / quality).alias("key"))
    )


def bucket_of(key: Column) -> Column:
    """A bucket that rises with the key.

    Keys are exponential with a rate from 0.1 to 1.  The mean of the two extreme distributions makes no
    bucket much more than twice the mean one, whatever the qualities are.
    """
    return F.floor((1.0 - (F.exp(-key) + F.exp(-key / 10.0)) / 2.0) * BUCKETS)


def targets(rows: DataFrame, weights: tuple[int, ...] = WEIGHTS, cap: int = MOST_EPOCHS) -> DataFrame:
    """(source, source_size, target): weighted shares of all sizes, stopped at `cap` times the source.

    The level of the shares is found in one pass over the sources sorted by cap per weight: the
    first ones that the level floods are full, the others share the rest.
    """
    sizes = rows.groupBy("source").agg(F.sum("size").alias("source_size"))
    order = Window.orderBy(F.col("source").asc_nulls_last())
    every = Window.partitionBy()
    place = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), ((F.row_number().over(order) - 1) % len(weights) + 1).cast("int"))
    sized = sizes.withColumn("weight", place).withColumn("most", (F.col("source_size") * cap).cast("double"))
    rising = Window.orderBy(F.col("most") / F.col("weight"), F.col("source").asc_nulls_last())
    before = rising.rowsBetween(Window.unboundedPreceding, -1)
    left = F.sum("source_size").over(every) - F.coalesce(F.sum("most").over(before), F.lit(0.0))
    level = left / (F.sum("weight").over(every) - F.coalesce(F.sum("weight").over(before), F.lit(0.0)))
    # A source is full if the level of what it and the later ones share exceeds its own cap.
    marked = sized.withColumn("level", level).withColumn("full", F.col("level") * F.col("weight") >= F.col("most"))
    final = F.coalesce(F.min(F.when(~F.col("full"), F.struct(F.col("most") / F.col("weight"), F.col("level")))).over(every)["level"], F.lit(float("inf")))
    return marked.withColumn("final", final).select("source", "source_size", F.when(F.col("full"), F.col("most")).otherwise(F.col("final") * F.col("weight")).alias("target"))


def mix(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, cap: int = MOST_EPOCHS) -> DataFrame:
    """One row per document: size, source_size, target, epochs, picked, copies, taken."""
    rows = cut(measured(docs).withColumn("bucket", bucket_of(F.col("key"))))
    aims = targets(rows, weights, cap).withColumn("_s", fold_id("source")).drop("source")
    rows = rows.withColumn("_s", fold_id("source"))
    bucket = Window.partitionBy("_s").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    sums = rows.groupBy("_s", "bucket").agg(F.sum("size").alias("in_bucket")).select("_s", "bucket", F.coalesce(F.sum("in_bucket").over(bucket), F.lit(0)).alias("before"))
    # Offsets and targets meet first: both are small, and the rows are joined once.
    offsets = sums.join(aims, "_s")
    inside = Window.partitionBy("_s", "bucket").orderBy("key", "_id", "size").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    run = F.col("before") + F.sum("size").over(inside)
    epochs = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("bigint")
    rest = F.col("target") - F.col("epochs") * F.col("source_size")
    return (
        rows.join(offsets, ["_s", "bucket"])
        .withColumn("run", run).withColumn("epochs", epochs)
        .withColumn("picked", (F.col("run") - F.col("size") / 2.0 <= rest) & (F.col("epochs") < cap))
        .withColumn("copies", F.col("epochs") + F.col("picked").cast("bigint"))
        .select("doc_id", "_id", "_k", "source", "size", "source_size", "target", "epochs", "picked", "copies", (F.col("size") * F.col("copies")).alias("taken"))
    )


def apply_mix(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, cap: int = MOST_EPOCHS) -> DataFrame:
    """The documents themselves, each as often as the mix takes it, with their own columns."""
    same = Window.partitionBy("_id", "_k")
    plan = mix(docs, weights, cap).select("_id", "_k", F.row_number().over(same.orderBy("copies")).alias("_n"), "copies")
    numbered = carried(docs, "doc_id", "text").withColumn("_n", F.row_number().over(same.orderBy("_k")))
    taken = numbered.join(plan.filter("copies > 0"), ["_id", "_k", "_n"])
    return taken.withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("copies")))).select("_row.*")
