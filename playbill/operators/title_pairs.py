"""Pairs of similar titles, with work in proportion to the titles.

Two titles match if their sequence ratio, or the overlap of their words, reaches a floor, if their
words are the same, or if one names the guests of the other.  Each way has keys of its own, made so
that a matching pair shares one, while a pair that does not match rarely does:

* A ratio of f leaves at most (1 - f) of all characters of both unmatched, each one a letter put in
  or left out.  The shorter title is cut into parts with a budget of such edits each; if every part
  exceeded its budget, there would be more edits than allowed.  So some part keeps to it, and the
  part of one title and the piece of the other are equal once so many letters are left out of
  both.  The first part lies at the start of both titles, the last one at their ends, those between
  are shifted by no more than the edits.  Two edits a part make parts of two or three words.
* Equal word sets share a hash; an overlap above the floor without being equal misses one word of
  the larger set, so the smaller one equals it without that word; sets so large that two words may
  be missing share one of their longest words.
* A title with guests starts with the plain title and "med".

Titles are sent as hashes, with a sketch of their letters: a pair that shares a key is written only
if the sketches allow it, so nearly all that is written matches.  Keys that many titles share are compared in tiles of bounded size.
"""

from __future__ import annotations

from functools import lru_cache
from math import floor as whole

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from playbill import vocab
from playbill.functions.similarity import length_bound, title_similarity
from playbill.functions.text import jaccard, words
from playbill.operators.tiles import similar_texts
from playbill.session import cut

FLOOR = vocab.PRODUCTION_TITLE_FLOOR
HOT = 40_000  # pairs that one key may emit
BAND = 1.12  # lengths of one band: from n to n * BAND
WEIGHT = {1: 5, 2: 7}  # share of the letters that a part with this budget gets
GUESTS, PLAIN = " med ", 12
_EPS = 1e-9


def longest_partner(n: int, floor: float) -> int:
    return whole(n * (2 - floor) / floor + _EPS)


def edits(n: int, floor: float) -> int:
    """Letters that may be put in or left out between a title of n letters and one that is not shorter."""
    return whole((1 - floor) * (n + longest_partner(n, floor)) + _EPS)


@lru_cache(maxsize=None)
def band(n: int, floor: float) -> tuple[int, int]:
    """First and last length of the band that n lies in; one length each while the whole title is one part."""
    lo = 1
    while True:
        hi = lo if edits(lo, floor) <= 2 else max(lo, whole(lo * BAND))
        if lo <= n <= hi:
            return lo, hi
        lo = hi + 1


def budgets(most: int) -> list[int]:
    """Budgets of the parts: one more edit than each allows would be more than `most` in sum."""
    if most <= 2:
        return [most]
    if most == 3:
        return [1, 1]
    return [2, *[1] * ((most - 4) // 2), 2 if most % 2 else 1]


@lru_cache(maxsize=None)
def parts(lo: int, hi: int, floor: float) -> list[tuple[str, int, int, int]]:
    """(anchor, offset, letters, budget) of every part of titles of this band."""
    budget = budgets(edits(hi, floor))
    if len(budget) == 1:
        return [("all", 0, lo, budget[0])]
    share = sum(WEIGHT[b] for b in budget)
    ends = [round(lo * sum(WEIGHT[b] for b in budget[: i + 1]) / share) for i in range(len(budget))]
    out, at = [], 0
    for i, (b, end) in enumerate(zip(budget, ends)):
        out.append(("start" if i == 0 else "end" if i == len(budget) - 1 else "middle", at, end - at, b))
        at = end
    return out


def without(text: str, n: int) -> set[str]:
    """What is left of a text without n of its letters."""
    out = {text}
    for _ in range(n):
        out = {t[:i] + t[i + 1 :] for t in out for i in range(len(t))}
    return out


def _moves(budget: int):
    return [(a, b) for a in range(budget + 1) for b in range(budget + 1 - a)]


def shorter_keys(text: str, floor: float = FLOOR) -> set[str]:
    """Keys of a title as the shorter one of a pair."""
    lo, hi = band(len(text), floor)
    out = set()
    for no, (anchor, at, n, budget) in enumerate(parts(lo, hi, floor)):
        piece = text[len(text) - n :] if anchor == "end" else text[at : at + n]
        for left, right in _moves(budget):
            out.update(f"{lo}.{no}.{left}{right}.{t}" for t in without(piece, left))
    return out


def longer_keys(text: str, floor: float = FLOOR) -> set[str]:
    """Keys of a title as the one that is not shorter, for the bands of all its partners."""
    m, out = len(text), set()
    n = next(n for n in range(1, m + 1) if longest_partner(n, floor) >= m)
    while n <= m:
        lo, hi = band(n, floor)
        n = hi + 1
        most = edits(hi, floor)
        for no, (anchor, at, size, budget) in enumerate(parts(lo, hi, floor)):
            for left, right in _moves(budget):
                length = size + right - left
                if length < right or length > m or anchor == "all" and length != m:
                    continue
                starts = [0] if anchor in ("all", "start") else [m - length] if anchor == "end" else range(max(0, at - most), min(m - length, at + most) + 1)
                for start in starts:
                    out.update(f"{lo}.{no}.{left}{right}.{t}" for t in without(text[start : start + length], right))
    return out


def sketch(text: str) -> int:
    """How often letters of each of sixteen groups occur, four bits a group; one edit changes one count by one at most."""
    counts = [0] * 16
    for c in text:
        counts[ord(c) % 16] += 1
    return sum(min(n, 15) << 4 * i for i, n in enumerate(counts))


def _apart(a: str, b: str) -> Column:
    """Edits that two sketches need at the least."""
    group = lambda c, i: F.shiftrightunsigned(c, 4 * i).bitwiseAND(F.lit(15))
    return sum((F.abs(group(a, i) - group(b, i)) for i in range(16)), F.lit(0))


def edit_keys(titles: DataFrame, floor: float = FLOOR) -> DataFrame:
    """(key, h, shorter, n, sketch): keys of every title in both roles, as hashes."""

    def run(batches):
        import numpy as np
        import pyarrow as pa
        from xxhash import xxh3_64_intdigest

        for batch in batches:
            for h, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                for shorter, found in ((True, shorter_keys(t, floor)), (False, longer_keys(t, floor))):
                    keys = np.fromiter((xxh3_64_intdigest(k) for k in found), dtype=np.uint64, count=len(found)).view(np.int64)
                    same = [np.full(len(keys), x) for x in (h, shorter, np.int32(len(t)), np.uint64(sketch(t)).view(np.int64))]
                    yield pa.RecordBatch.from_arrays([pa.array(keys), *map(pa.array, same)], names=["key", "h", "shorter", "n", "sketch"])

    return titles.select("h", "t").mapInArrow(run, "key bigint, h bigint, shorter boolean, n int, sketch bigint")


def _telling() -> Column:
    """Words of `t` that are no filler."""
    return F.filter(words("t"), lambda w: ~F.rlike(w, F.lit(f"^(?:{vocab.FILLER_WORDS_RE})$")))


def word_keys(titles: DataFrame, floor: float = FLOOR) -> DataFrame:
    """(key, h, shorter, sure): keys of word sets; `sure` ones need no further test."""
    base = titles.select("h", "t", F.array_sort(words("t")).alias("w"), F.array_sort(_telling()).alias("k")).withColumn("n", F.size("k"))
    hashed = lambda kind, c: F.xxhash64(F.lit(kind), F.array_join(c, " "))
    both = F.explode(F.array(F.lit(True), F.lit(False))).alias("shorter")
    missing = F.floor((F.col("n") + F.col("n") / F.lit(floor)) * F.lit((1 - floor) / (1 + floor)) + F.lit(_EPS))
    same = base.select(hashed("all", "w").alias("key"), "h", both, F.lit(True).alias("sure"))
    telling = base.filter("n > 0").select(hashed("telling", "k").alias("key"), "h", both, F.lit(True).alias("sure"))
    # The larger set without one word, where one may be missing.
    full = base.filter(missing >= 1).select(hashed("one", "k").alias("key"), "h", F.lit(True).alias("shorter"), F.lit(True).alias("sure"))
    one_less = F.transform("k", lambda x, i: hashed("one", F.concat(F.slice("k", F.lit(1), i), F.slice("k", i + 2, F.size("k")))))
    less = base.filter(missing >= 1).select(F.explode(one_less).alias("key"), "h", F.lit(False).alias("shorter"), F.lit(True).alias("sure"))
    longest = F.array_sort(F.transform("k", lambda x: F.struct((-F.length(x)).alias("n"), x.alias("x"))))
    some = F.transform(F.slice(longest, F.lit(1), (missing + 1).cast("int")), lambda s: F.xxhash64(F.lit("word"), s["x"]))
    many = base.filter(missing >= 2).select(F.explode(some).alias("key"), "h").select("key", "h", both, F.lit(False).alias("sure"))
    return same.unionByName(telling).unionByName(full).unionByName(less).unionByName(many)


def guest_keys(titles: DataFrame) -> DataFrame:
    """(key, h, shorter, sure): plain titles, and what stands before a "med" in longer ones."""
    pieces = F.split("t", GUESTS)
    heads = F.transform(F.sequence(F.lit(1), F.greatest(F.size(pieces) - 1, F.lit(1))), lambda i: F.array_join(F.slice(pieces, F.lit(1), i), GUESTS))
    plain = titles.filter(F.length("t") >= PLAIN).select(F.xxhash64(F.lit("guest"), "t").alias("key"), "h", F.lit(True).alias("shorter"), F.lit(True).alias("sure"))
    longer = titles.filter(F.contains("t", F.lit(GUESTS))).select("h", F.explode(heads).alias("head")).filter(F.length("head") >= PLAIN)
    return plain.unionByName(longer.select(F.xxhash64(F.lit("guest"), "head").alias("key"), "h", F.lit(False).alias("shorter"), F.lit(True).alias("sure")))


def candidates(titles: DataFrame, floor: float = FLOOR, hot: int = HOT) -> tuple[DataFrame, DataFrame]:
    """Pairs (left, right, sure) of title hashes that share a key, one row each, and the rows (key, h) of keys too common for that."""
    by_words = word_keys(titles, floor).unionByName(guest_keys(titles)).withColumns({"n": F.lit(None).cast("int"), "sketch": F.lit(None).cast("bigint")})
    rows = cut(edit_keys(titles, floor).withColumn("sure", F.lit(False)).unionByName(by_words))
    sizes = rows.groupBy("key").agg(F.count_if("shorter").alias("a"), F.count_if(~F.col("shorter")).alias("b"), (F.min("h") != F.max("h")).alias("met"))
    useful = cut(rows.join(sizes.filter("a > 0 AND b > 0 AND met").drop("met"), "key").withColumn("hot", F.col("a") * F.col("b") > hot))
    cold = useful.filter("NOT hot")
    a, b = cold.filter("shorter").alias("a"), cold.filter("NOT shorter").alias("b")
    near = F.col("a.n").isNull() | (_apart("a.sketch", "b.sketch") <= (F.col("a.n") + F.col("b.n")) * (1 - floor) + _EPS)
    met = a.join(b, (F.col("a.key") == F.col("b.key")) & (F.col("a.h") != F.col("b.h")) & near)
    pairs = met.groupBy(F.least("a.h", "b.h").alias("left"), F.greatest("a.h", "b.h").alias("right")).agg(F.bool_or("a.sure").alias("sure"))
    return pairs, useful.filter("hot").select("key", "h").distinct()


def similar_titles(titles: DataFrame, floor: float = FLOOR, hot: int = HOT) -> DataFrame:
    """(first, second) ordered pairs of distinct titles at or above the floor, equal ones included."""
    named = titles.filter("t <> ''").select(F.xxhash64("t").alias("h"), "t")
    pairs, common = candidates(named, floor, hot)
    side = lambda name: named.select(F.col("h").alias(f"{name}_h"), F.col("t").alias(name))
    spelled = pairs.join(side("first"), F.col("left") == F.col("first_h")).join(side("second"), F.col("right") == F.col("second_h"))
    overlap = jaccard(F.filter(words("first"), _no_filler), F.filter(words("second"), _no_filler)) >= floor
    # What a hash says is tested on the texts themselves; only letters need Python.
    same = (F.array_sort(words("first")) == F.array_sort(words("second"))) | _guests("first", "second") | _guests("second", "first") | overlap
    known, open_ = spelled.filter(same), spelled.filter(~same & length_bound(F.col("first"), F.col("second"), floor))
    # The ratio depends on which title comes first, so it is asked both ways.
    scored = _both_ways(open_).withColumn("s", title_similarity(floor)(F.col("first"), F.col("second"))).filter(F.col("s") >= floor)
    tiled = similar_texts(common.join(named, "h").select(F.col("key").cast("string").alias("block"), F.col("t").alias("text")), floor, floor)
    found = _both_ways(known).unionByName(scored.select("first", "second")).unionByName(tiled.filter("first <> second").select("first", "second")).distinct()
    return found.unionByName(named.select(F.col("t").alias("first"), F.col("t").alias("second")))


def _both_ways(pairs: DataFrame) -> DataFrame:
    return pairs.select("first", "second").unionByName(pairs.select(F.col("second").alias("first"), F.col("first").alias("second")))


def _no_filler(word: Column) -> Column:
    return ~F.rlike(word, F.lit(f"^(?:{vocab.FILLER_WORDS_RE})$"))


def _guests(plain: str, longer: str) -> Column:
    return (F.length(plain) >= PLAIN) & F.startswith(longer, F.concat(plain, F.lit(GUESTS)))
