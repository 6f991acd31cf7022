"""SimHash near-duplicates with vantage-point trees.

A fingerprint has 64 bits.  Two that differ in at most `DISTANCE` bits differ in at most one bit
of one of three bands (pigeonhole), so there is one vantage-point tree per band, over the Hamming
distance of that band: an inner node splits at a distance to its vantage point, and a query with
radius 1 enters a side only if the triangle bound lets it.  Leaves are shards: a fingerprint lives
in one and is a guest in those that its ball overlaps, on one side of each split only, since the
other partner need not travel too.  Inside a shard all 64 bits are compared, so pairs are exact.

Trees are built from at most `SAMPLE` fingerprints; where they split changes the work, never the
result.  Shards with more than `SHARD` homes or guests are cut into blocks, and each pair
of blocks is a group of its own.

Defined cases: null or empty texts have fingerprint 0 and are linked like any other; fewer than
four words are one shingle; repeated rows share fingerprint and component; null ids do not give a
component its id; an empty table gives no rows; further columns are not looked at.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from playbill.llm.common import carried, map_columns, with_key
from playbill.llm.components import components, in_slots, joined
from playbill.session import cut

WORDS = re.compile(rb"[^\x20\x09-\x0D]+")
SHINGLE = 4
SEED = 42
DISTANCE = 4
BANDS = ((0, 22), (22, 21), (43, 21))  # first bit and width
RADIUS = DISTANCE // len(BANDS)
SAMPLE = 20_000
SHARD = 2_000


def fingerprint(text: str | None) -> int:
    """64 majority bits over the shingles' hashes, as a signed long."""
    import numpy as np
    from xxhash import xxh64_intdigest

    words = WORDS.findall((text or "").encode("utf-8", "surrogatepass").lower())  # lower() of bytes is A-Z only
    if not words:
        return 0
    joined_words = b" ".join(words)
    ends, at = [], -1
    for w in words:
        at += len(w) + 1
        ends.append(at)
    starts = [0, *(e + 1 for e in ends[:-1])]
    n = max(1, len(words) - SHINGLE + 1)
    hashes = np.fromiter((xxh64_intdigest(joined_words[a:b], SEED) for a, b in zip(starts[:n], ends[min(SHINGLE, len(words)) - 1 :])), dtype=np.uint64, count=n)
    ones = np.unpackbits(hashes.view(np.uint8).reshape(n, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > n, bitorder="little").view(np.int64)[0])


def fingerprints(docs: DataFrame) -> DataFrame:
    """(doc_id, _id, _k, fp)"""
    kind = docs.schema["doc_id"].dataType.simpleString()
    rows = with_key(docs).select("doc_id", "_id", "_k", "text")
    return map_columns(rows, lambda i, d, k, t: [i, d, k, [fingerprint(x) for x in t]], f"doc_id {kind}, _id string, _k bigint, fp bigint")


class Tree:
    """A vantage-point tree of one band; nodes are (point, limit, near child, far child), leaves numbers."""

    def __init__(self, sample, band: tuple[int, int], leaf: int):
        import numpy as np

        self.shift, self.mask = np.uint64(band[0]), np.uint64((1 << band[1]) - 1)
        self.leaves = 0
        self.root = self._grow(self._bits(sample), leaf, np.random.default_rng(band[0]))

    def _bits(self, fps):
        return (fps >> self.shift) & self.mask

    def _grow(self, bits, leaf: int, rng):
        import numpy as np

        best = None
        if len(bits) > leaf:
            for point in rng.choice(bits, 12):
                d = np.bitwise_count(bits ^ point)
                middle = int(np.median(d))
                for limit in (middle - 1, middle, middle + 1):
                    near = int((d <= limit).sum())
                    crossing = int(((d > limit - RADIUS) & (d <= limit + RADIUS)).sum())
                    # Cost of a split: the larger side, and the guests that cross.
                    cost = max(near, len(bits) - near) + crossing
                    if 0 < near < len(bits) and (best is None or cost < best[0]):
                        best = (cost, point, limit, d <= limit)
        if best is None or best[0] > 1.6 * len(bits):
            self.leaves += 1
            return self.leaves - 1
        _, point, limit, near = best
        return (point, limit, self._grow(bits[near], leaf, rng), self._grow(bits[~near], leaf, rng))

    def route(self, fps):
        """(positions, leaf, guest) for every shard that a fingerprint lives in or visits."""
        import numpy as np

        bits, out = self._bits(fps), []
        everyone = np.arange(len(fps))
        stack = [(self.root, everyone, np.zeros(len(fps), dtype=bool))]
        while stack:
            node, at, guest = stack.pop()
            if not len(at):
                continue
            if not isinstance(node, tuple):
                out.append((at, np.full(len(at), node), guest))
                continue
            point, limit, near, far = node
            d = np.bitwise_count(bits[at] ^ point).astype(np.int64)
            inside = d <= limit
            to_near = np.where(guest, d - RADIUS <= limit, inside | (d - RADIUS <= limit))
            to_far = np.where(guest, d + RADIUS > limit, ~inside)
            stack.append((near, at[to_near], (guest | ~inside)[to_near]))
            stack.append((far, at[to_far], guest[to_far]))
        return [np.concatenate(x) for x in zip(*out)]


def shards(fps: DataFrame, count: int, sample: list[int], size: int = SHARD) -> DataFrame:
    """(fp, band, leaf, guest) of distinct fingerprints."""
    import numpy as np

    picked = np.array(sample, dtype=np.int64).view(np.uint64)
    leaf = max(8, round(size / 2 * len(picked) / max(1, count)))
    trees = [Tree(picked, band, leaf) for band in BANDS]

    def run(values):
        found = np.array(values, dtype=np.int64)
        out = [[], [], [], []]
        for b, tree in enumerate(trees):
            at, leaf_no, guest = tree.route(found.view(np.uint64))
            for column, part in zip(out, (found[at], np.full(len(at), b, dtype=np.int32), leaf_no.astype(np.int32), guest)):
                column.append(part)
        return [np.concatenate(x) for x in out]

    return map_columns(fps.select("fp"), run, "fp bigint, band int, leaf int, guest boolean")


def _links(key, frame):
    """Within one shard: each linked fingerprint with the smallest one that it reaches there."""
    import numpy as np
    import pandas as pd

    frame = frame.sort_values("guest", kind="stable")
    fps = frame["fp"].to_numpy()
    bits, homes = fps.view(np.uint64), int((~frame["guest"]).sum())
    labels = np.argsort(np.argsort(fps, kind="stable"), kind="stable")
    step = max(1, 8_000_000 // max(1, len(bits)))
    for start in range(0, homes, step):
        block = np.bitwise_count(bits[start : min(homes, start + step), None] ^ bits[None, :]) <= DISTANCE
        block[np.arange(len(block)), np.arange(start, start + len(block))] = False
        if key[2] != key[3]:  # homes meet each other in another group
            block[:, :homes] = False
        joined(block, start, labels)
    order = np.sort(fps)
    linked = labels != np.argsort(np.argsort(fps, kind="stable"), kind="stable")
    return pd.DataFrame({"a": fps[linked], "b": order[labels[linked]]})


def edges(fps: DataFrame, size: int = SHARD) -> DataFrame:
    """Enough exact links (a, b) between distinct fingerprints to give their components."""
    count = fps.count()
    share = min(1.0, 2.0 * SAMPLE / max(1, count))
    near = fps.filter(F.pmod(F.xxhash64("fp"), F.lit(1 << 30)).cast("double") < F.lit(share * (1 << 30))).orderBy(F.xxhash64("fp")).limit(SAMPLE)
    sample = [r["fp"] for r in near.collect()]
    routed = cut(shards(fps, count, sample, size)) if sample else fps.selectExpr("fp", "0 AS band", "0 AS leaf", "false AS guest")
    dealt = in_slots(routed, ["band", "leaf"], "fp", size)
    # Dealt by the whole key: the blocks of a hot shard are not to stay where its rows met to be counted.
    return dealt.select("band", "leaf", "slot", "part", "fp", "guest").repartition("band", "leaf", "slot", "part").groupBy("band", "leaf", "slot", "part").applyInPandas(_links, "a bigint, b bigint").distinct()


def near_duplicates(docs: DataFrame, size: int = SHARD) -> DataFrame:
    """(doc_id, _id, _k, fp, root, component_id): root is the smallest fingerprint that links reach, component_id the smallest id."""
    rows = cut(fingerprints(docs))
    nodes = rows.groupBy("fp").agg(F.min("doc_id").alias("least"))
    roots = components(edges(nodes.select("fp"), size))
    grouped = nodes.join(roots, nodes.fp == roots.node, "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    least = grouped.groupBy("root").agg(F.min("least").alias("component_id"))
    named = grouped.join(least, "root").select("fp", "root", "component_id")
    return rows.join(named, "fp").select("doc_id", "_id", "_k", "fp", "root", "component_id")


def report(docs: DataFrame) -> DataFrame:
    return near_duplicates(docs).select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def keep_one(docs: DataFrame) -> DataFrame:
    """The documents without near copies: of each component the row with the smallest id, then text hash; rows without id come last.

    Components are told apart by their root fingerprint: unrelated texts may share an id.
    """
    order = F.struct(F.col("doc_id").isNull(), "doc_id", "_id", "_k")
    first = near_duplicates(docs).groupBy("root").agg(F.min(order).alias("first")).select("first._id", "first._k")
    kept = carried(docs, "doc_id", "text").join(first, ["_id", "_k"], "left_semi").dropDuplicates(["_id", "_k"])
    return kept.select("_row.*")
