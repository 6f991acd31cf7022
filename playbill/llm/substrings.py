"""Removal of repeated byte strings by prefix-free parsing.

A rolling hash over `GRAM` bytes triggers phrases: every `LENGTH`-byte window belongs to the place
of its smallest gram hash, so equal windows have equal triggers at equal offsets, wherever they
stand.  Window starts of one trigger form a phrase with the bytes that those windows cover.

* parse: one row per phrase of a document (trigger hash, phrase hash, document, place);
* dictionary: the distinct phrases with their counts.

Windows are ordered only as far as repetition needs it.  A phrase whose trigger is unique in the
corpus holds no repeated window and leaves the parse at once.  A phrase that the dictionary counts
twice holds nothing but repeated windows.  Only phrases that share a trigger with a different one
(the edges of copied passages) are opened, each distinct phrase once: first into blocks of `BLOCK`
suffixes by the same two tests (the bytes that all windows of a block share, then all its bytes),
then the blocks left into single suffixes, `LENGTH` bytes long, compared through two 64-bit
hashes.  So classes of equal suffixes take the place of their sorted order; a copy of a passage,
however often it occurs, costs a constant number of rows a phrase, and no pairs are formed.

Defined cases: null texts are empty; texts shorter than `LENGTH` keep every byte; repeated rows
are copies of each other; overlapping repeats of one document count; an empty table gives no rows;
further columns are not looked at.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from playbill.llm.common import semi_join
from playbill.session import cut

LENGTH = 200
GRAM = 32
BLOCK = 16
CHUNK = 1 << 20  # bytes that are hashed at once
STEPS = 1 << 8
PLACE = STEPS * STEPS  # a place is start * PLACE + (trigger - last start) * STEPS + number of windows


def _table(seed: int):
    import numpy as np

    return np.random.default_rng(seed).integers(1, 2**64, size=(256,), dtype=np.uint64)


def _factors(seed: int):
    import numpy as np

    return np.random.default_rng(seed + 1).integers(1, 2**64, size=(16,), dtype=np.uint64) | np.uint64(1)


def rolling(data, sizes: list[int], seed: int) -> dict:
    """Hashes of the strings of the given power-of-two sizes that start at each byte."""
    import numpy as np

    factors, h, size, out = _factors(seed), _table(seed)[data], 1, {}
    for level in range(max(sizes).bit_length()):
        if size in sizes:
            out[size] = h
        if size == max(sizes):
            break
        ahead = np.zeros_like(h)
        ahead[:-size] = h[size:]
        h = h * factors[level] + ahead
        h ^= h >> np.uint64(31)
        size *= 2
    return out


def triggers(data, length: int = LENGTH):
    """(place of the smallest gram hash of the window that starts at each byte, gram hashes)."""
    import numpy as np

    gram = rolling(data, [GRAM], 11)[GRAM] * np.uint64(0x9E3779B97F4A7C15)
    low = np.uint64((1 << 32) - 1)
    v = (gram & ~low) | np.arange(len(data), dtype=np.uint64)
    width, span = length - GRAM + 1, 1
    while span * 2 <= width:
        ahead = np.full_like(v, ~np.uint64(0))
        ahead[:-span] = v[span:]
        v = np.minimum(v, ahead)
        span *= 2
    ahead = np.full_like(v, ~np.uint64(0))
    if width > span:
        ahead[: -(width - span)] = v[width - span :]
    return (np.minimum(v, ahead) & low).astype(np.int64), gram


def phrases(texts: list[bytes], length: int = LENGTH):
    """(row of the text, place, trigger hash, phrase hash) of every phrase, as arrays."""
    import numpy as np
    from xxhash import xxh3_64_intdigest

    joined = b"".join(texts)
    data = np.frombuffer(joined, dtype=np.uint8)
    sizes = np.fromiter(map(len, texts), dtype=np.int64, count=len(texts))
    begin = np.cumsum(sizes) - sizes
    of, gram = triggers(data, length)
    counts = np.maximum(0, sizes - length + 1)
    row = np.repeat(np.arange(len(texts)), counts)
    at = np.arange(len(row)) - np.repeat(np.cumsum(counts) - counts, counts) + begin[row]
    place = of[at]
    first = np.flatnonzero(np.diff(place, prepend=-1))
    n = np.diff(np.append(first, len(at)))
    lo, own = at[first], row[first]
    c = np.fromiter((xxh3_64_intdigest(joined[a : a + k + length - 1], 5) for a, k in zip(lo.tolist(), n.tolist())), dtype=np.uint64, count=len(lo))
    return own, (lo - begin[own]) * PLACE + (place[first] - (lo + n - 1)) * STEPS + n, gram[place[first]], c


def _chunks(texts: list[bytes | None]):
    at, size = 0, 0
    for i, t in enumerate(texts):
        size += len(t)
        if size >= CHUNK:
            yield at, i + 1
            at, size = i + 1, 0
    if at < len(texts):
        yield at, len(texts)


def _bytes(texts) -> list[bytes]:
    return [(t or "").encode("utf-8", "surrogatepass") for t in texts.to_pylist()]


def parse(keyed: DataFrame, length: int = LENGTH) -> DataFrame:
    """(k, seg, g, c) of every phrase of every text."""

    def run(batches):
        import numpy as np
        import pyarrow as pa

        for batch in batches:
            keys, texts = batch.column(0).to_numpy(zero_copy_only=False), _bytes(batch.column(1))
            for a, b in _chunks(texts):
                if any(len(t) >= length for t in texts[a:b]):
                    own, seg, g, c = phrases(texts[a:b], length)
                    yield pa.RecordBatch.from_arrays([pa.array(keys[a:b][own]), pa.array(seg), pa.array(g.view(np.int64)), pa.array(c.view(np.int64))], names=["k", "seg", "g", "c"])

    return keyed.select("k", "text").mapInArrow(run, "k bigint, seg bigint, g bigint, c bigint")


def zipped(keyed: DataFrame) -> DataFrame:
    """(doc_id, k, z): texts are shuffled compressed."""
    from pyspark.sql.types import BinaryType, StructField, StructType

    def run(batches):
        import pyarrow as pa
        import zstandard

        pack = zstandard.ZstdCompressor(level=1).compress
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([pack(t) for t in _bytes(batch.column(2))], type=pa.binary())], names=["doc_id", "k", "z"])

    rows = keyed.select("doc_id", "k", "text")
    return rows.mapInArrow(run, StructType([*rows.schema.fields[:2], StructField("z", BinaryType())]))


def blocks(opened: DataFrame, length: int = LENGTH) -> DataFrame:
    """(k, seg, g, c, often): the blocks of the opened phrases, from (k, z, segs of (seg, often)).

    Blocks are counted from the trigger, so equal windows lie in blocks of the same number; g is of
    the bytes that every window of that block holds, c of all bytes of those the phrase has.
    """

    def run(batches):
        import pyarrow as pa
        import zstandard
        from xxhash import xxh3_64_intdigest

        unpack, signed = zstandard.ZstdDecompressor().decompress, lambda h: h - (1 << 64) if h >> 63 else h
        for batch in batches:
            out: list[list] = [[], [], [], [], []]
            for k, z, segs in zip(*(c.to_pylist() for c in batch.columns)):
                data = unpack(z)
                for s in segs:
                    lo, ahead, n = s["seg"] // PLACE, s["seg"] // STEPS % STEPS, s["seg"] % STEPS
                    t = lo + n - 1 + ahead
                    for j in range(ahead // BLOCK, (t - lo) // BLOCK + 1):
                        a, b = max(lo, t - BLOCK * j - BLOCK + 1), min(lo + n - 1, t - BLOCK * j)
                        core = data[t - BLOCK * j : t - BLOCK * j - BLOCK + 1 + length]
                        for column, value in zip(out, (k, a * PLACE + b - a + 1, signed(xxh3_64_intdigest(core, j)), signed(xxh3_64_intdigest(data[a : b + length], 6)), s["often"])):
                            column.append(value)
            yield pa.RecordBatch.from_arrays([pa.array(c, type=t) for c, t in zip(out, [pa.int64()] * 4 + [pa.bool_()])], names=["k", "seg", "g", "c", "often"])

    return opened.mapInArrow(run, "k bigint, seg bigint, g bigint, c bigint, often boolean")


def suffixes(opened: DataFrame, length: int = LENGTH) -> DataFrame:
    """(w1, w2, k, p, often): every window of the opened places, from (k, z, segs of (seg, often))."""

    def run(batches):
        import numpy as np
        import pyarrow as pa
        import zstandard

        unpack = zstandard.ZstdDecompressor().decompress
        for batch in batches:
            for k, z, segs in zip(*(c.to_pylist() for c in batch.columns)):
                data = np.frombuffer(unpack(z), dtype=np.uint8)
                place = np.array([s["seg"] for s in segs], dtype=np.int64)
                lo, n = place // PLACE, place % STEPS
                p = np.repeat(lo - (np.cumsum(n) - n), n) + np.arange(n.sum())
                often = np.repeat(np.array([s["often"] for s in segs]), n)
                hashes = []
                for seed in (101, 202):
                    parts, at, total = rolling(data, [1 << i for i in range(length.bit_length()) if length >> i & 1], seed), p, np.zeros(len(p), dtype=np.uint64)
                    for size in sorted(parts, reverse=True):
                        total = (total ^ (total >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9) + parts[size][at]
                        at = at + size
                    hashes.append(total.view(np.int64))
                yield pa.RecordBatch.from_arrays([*map(pa.array, hashes), pa.array(np.full(len(p), k)), pa.array(p), pa.array(often)], names=["w1", "w2", "k", "p", "often"])

    return opened.mapInArrow(run, "w1 bigint, w2 bigint, k bigint, p bigint, often boolean")


def keyed_rows(docs: DataFrame) -> DataFrame:
    """doc_id, k, text: k tells (id, text) pairs apart; a salt is tried until no two share one."""
    salt = 0
    while True:
        key = lambda s: F.xxhash64(F.lit(s), "doc_id", "text")
        pairs = docs.select(key(salt).alias("k"), F.xxhash64("text", F.lit(salt), "doc_id").alias("check"))
        if pairs.groupBy("k").agg(F.min("check").alias("a"), F.max("check").alias("b")).filter("a <> b").isEmpty():
            return docs.select("doc_id", key(salt).alias("k"), "text")
        salt += 1


def _open(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(dictionary, opened) of rows (g, c, k, seg, often): distinct strings, and those to look into.

    `often` says that a string occurs twice or more; the rows of a string that does need no look
    themselves, but their string is one that others may partly equal.
    """
    weight = F.sum(F.when(F.col("often"), 2).otherwise(1))
    dictionary = rows.groupBy("g", "c").agg((weight > 1).alias("often"), F.count("*").alias("n"), F.min(F.struct("k", "seg")).alias("one"))
    dictionary = cut(dictionary.select("g", "c", "often", "n", "one.k", "one.seg"))
    shared = dictionary.groupBy("g").agg(F.count("*").alias("n")).filter("n > 1")
    opened = semi_join(dictionary.drop("n"), shared, ["g"]).groupBy("k").agg(F.collect_list(F.struct("seg", "often")).alias("segs"))
    return dictionary, opened


def repeated(keyed: DataFrame, length: int = LENGTH) -> DataFrame:
    """(k, seg): places whose windows all occur elsewhere."""
    texts = zipped(keyed).drop("doc_id").dropDuplicates(["k"])
    rows = cut(parse(keyed, length))
    rows = cut(semi_join(rows, rows.groupBy("g").agg(F.count("*").alias("n")).filter("n > 1"), ["g"]))
    dictionary, opened = _open(rows.withColumn("often", F.lit(False)))
    whole = semi_join(rows, dictionary.filter("often"), ["g", "c"]).select("k", "seg")
    # The texts that are opened, once, for both steps.
    opened = cut(opened.join(texts, "k").select("k", "z", "segs"))
    parts = cut(blocks(opened, length))
    inner, left = _open(parts)
    in_blocks = semi_join(parts.filter("NOT often"), inner.filter("often"), ["g", "c"]).select("k", "seg")
    windows = cut(suffixes(left.join(opened.select("k", "z"), "k").select("k", "z", "segs"), length))
    weight = F.sum(F.when(F.col("often"), 2).otherwise(1))
    again = windows.groupBy("w1", "w2").agg(weight.alias("n"), F.bool_or(~F.col("often")).alias("single")).filter("n > 1 AND single")
    edges = semi_join(windows.filter("NOT often"), again, ["w1", "w2"]).select("k", (F.col("p") * PLACE + 1).alias("seg"))
    return whole.unionByName(in_blocks).unionByName(edges)


def spans(places: list[int], length: int = LENGTH) -> list[tuple[int, int]]:
    """Maximal byte runs that the windows at the places cover."""
    import numpy as np

    if not places:
        return []
    at = np.sort(np.array(places, dtype=np.int64))
    lo = at // PLACE
    end = np.maximum.accumulate(lo + at % STEPS - 1 + length)
    new = np.flatnonzero(np.append(True, lo[1:] > end[:-1]))
    return list(zip(lo[new].tolist(), end[np.append(new[1:] - 1, len(end) - 1)].tolist()))


def dedup(docs: DataFrame, length: int = LENGTH, with_text: bool = False) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256, and the byte spans; the kept bytes on request."""
    keyed = keyed_rows(docs)
    marks = repeated(keyed, length).groupBy("k").agg(F.collect_set("seg").alias("segs"))
    rows = zipped(keyed).join(marks, "k", "left").select("doc_id", "z", "segs")
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches):
        import pyarrow as pa
        import zstandard

        unpack = zstandard.ZstdDecompressor().decompress
        for batch in batches:
            out: list[list] = [[], [], [], [], [], []]
            for z, segs in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                data, gone = unpack(z), spans(segs or [], length)
                kept = b"".join(data[a:b] for a, b in zip([0, *(e for _, e in gone)], [*(s for s, _ in gone), len(data)]))
                for column, value in zip(out, (len(data), len(data) - len(kept), len(gone), hashlib.sha256(kept).hexdigest(), [{"start": a, "end": b} for a, b in gone], kept)):
                    column.append(value)
            types = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])), pa.binary()]
            names = ["n_bytes", "n_removed", "n_spans", "kept_sha256", "removed", "kept"][: 5 + with_text]
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, type=t) for c, t, _ in zip(out, types, names))], names=["doc_id", *names])

    schema = f"doc_id {kind}, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string, removed array<struct<start:bigint,end:bigint>>" + ", kept binary" * with_text
    return rows.mapInArrow(run, schema)
