"""Connected components and hot-group slots shared by the near-duplicate operators."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from playbill.session import cut


def components(edges: DataFrame) -> DataFrame:
    """(node, root): the smallest node that each node of the edges (a, b) reaches.

    Alternates the two star contractions: every node hands its larger neighbours, then its smaller
    ones, to the smallest.  Chains halve, so rounds grow with the logarithm of the longest path.
    Each round is written out; the edges never exceed those given.
    """
    now = cut(edges.filter("a != b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    before = None
    while True:
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u != v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        joined = large.join(least, "u")
        small = joined.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v")))
        now = cut(small.filter("u != v").distinct())
        # The state is compared by a count and a sum of hashes: two numbers for the driver.
        state = tuple(now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if state == before:
            break
        before = state
    roots = now.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return roots.unionByName(roots.select(F.col("root").alias("node"), "root").distinct())


def in_slots(rows: DataFrame, keys: list[str], node: str, most: int) -> DataFrame:
    """Adds `slot` and `part`, so that no (keys, slot, part) has much more than `most` home and `most` guest rows, and no pair is lost.

    Homes and guests of a group are dealt into blocks.  `slot` is the block of the homes, `part` that
    of their partners: a home block that is not earlier, or a guest block.  Homes meet each other where
    slot = part, together with the first guest block; elsewhere only homes and guests are to be
    compared.  So each pair of homes, and each home with each guest, meets exactly once.
    """
    blocks = lambda n: F.greatest(F.lit(1), F.ceil(n / most)).cast("int")
    sizes = rows.groupBy(*keys).agg(F.count_if(~F.col("guest")).alias("_n"), F.count_if("guest").alias("_m")).filter((F.col("_n") > most) | (F.col("_m") > most))
    hot = sizes.select(*keys, blocks(F.col("_n")).alias("_homes"), blocks(F.col("_m")).alias("_guests"))
    dealt = rows.join(hot, keys, "left").withColumns({"_homes": F.coalesce("_homes", F.lit(1)), "_guests": F.coalesce("_guests", F.lit(1))})
    own = F.pmod(F.xxhash64(node, F.lit("slot")), F.when(F.col("guest"), F.col("_guests")).otherwise(F.col("_homes"))).cast("int")
    dealt = dealt.withColumn("_own", own)
    home = """concat(
        transform(sequence(_own, _homes - 1), p -> named_struct('slot', _own, 'part', p, 'guest', false)),
        transform(filter(sequence(0, _own), s -> s < _own), s -> named_struct('slot', s, 'part', _own, 'guest', true)),
        transform(filter(sequence(_homes, _homes + _guests - 1), p -> p > _homes), p -> named_struct('slot', _own, 'part', p, 'guest', false)))"""
    guest = "transform(sequence(0, _homes - 1), s -> named_struct('slot', s, 'part', if(_own = 0, s, _homes + _own), 'guest', true))"
    out = dealt.withColumn("_place", F.explode(F.expr(f"if(guest, {guest}, {home})")))
    return out.select(*[c for c in rows.columns if c != "guest"], "_place.slot", "_place.part", "_place.guest")


def joined(matrix, start: int, labels) -> None:
    """Merges labels along a boolean block whose rows are nodes start, start+1, ... of the label array."""
    import numpy as np

    for i in np.flatnonzero(matrix.any(axis=1)):
        near = np.flatnonzero(matrix[i])
        other = np.unique(labels[near][labels[near] != labels[start + i]])
        if len(other):
            group = np.append(other, labels[start + i])
            labels[np.isin(labels, group)] = group.min()
