"""Best-fit packing of token sequences by bin completion.

Every document becomes its ids and one end id.  Only documents longer than a sequence are cut;
their first piece is the short one, so at most one piece of a document is not full.  Lengths are
whole numbers up to the sequence length, so the packing problem is the histogram of lengths: at
most `SEQUENCE` rows, however many documents there are.  Bin completion runs on that histogram in
the driver: it fills a bin around the largest length left, tries undominated fillings of least
waste first, applies a filling as often as the counts allow, prunes by the waste that the best
solution so far allows, and takes a best-fit packing of what is left as a new solution at every
`FIT_EVERY`-th node.  The plan is a list of patterns; pieces find their place by their rank among pieces of the
same length, counted in two levels, so a hot length is spread over `BUCKETS` groups.

Defined cases: null and empty texts are the end id alone; repeated rows are pieces of their own
(equal ones may swap places); an empty table gives no rows; further columns are not looked at.
`NODES` and `STEPS` bound the search, not the rows: the best solution found is always complete.
"""

from __future__ import annotations

import re
import zlib
from bisect import bisect_left
from collections import Counter
from math import ceil

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from playbill.llm.common import fold_id, map_columns
from playbill.session import cut

SEQUENCE = 1024
END_ID = 2
BUCKETS = 1024
NODES, FIT_EVERY = 400, 64
STEPS = 2_000  # partial fillings looked at in one node
VOCABULARY, RANKS = "byte_bpe_50k.json", "byte_bpe_50k.tiktoken"
CACHED = 600_000  # chunks whose ids a worker remembers

# Unicode white space but for the blank and the line feed.
_RARE_SPACE = "\t\x0b\x0c\r\x1c\x1d\x1e\x1f\x85                 　"
_RARE = re.compile(f"[{_RARE_SPACE}]")
_ENCODERS: dict[tuple[str, str], "Encoder"] = {}


class _Chunks(dict):
    """Ids of blank-led chunks as little-endian bytes; emptied when full."""

    def __init__(self, encode):
        super().__init__()
        self.encode = encode

    def __missing__(self, chunk: str) -> bytes:
        if len(self) >= CACHED:
            self.clear()
        self[chunk] = ids = self.encode(" " + chunk)
        return ids


class Encoder:
    """Texts to ids as bytes.

    The tokenizer never joins a blank to what stands before it, so a text whose white space is
    single blanks and line feeds between words falls into independent chunks, and frequent chunks
    are looked up.  Other texts go through the tokenizer whole.  Chunks are encoded from the rank
    file, which holds the same vocabulary and is several times faster; tests compare the two.
    """

    def __init__(self, vocabulary: str, ranks: str):
        import base64

        import numpy as np
        import public_tokenizers
        import tiktoken
        from tokenizers import Tokenizer

        pairs = (line.split() for line in open(ranks, "rb"))
        core = tiktoken.Encoding("chunks", pat_str=public_tokenizers.PATTERN, mergeable_ranks={base64.b64decode(a): int(b) for a, b in pairs}, special_tokens={})
        self.whole = Tokenizer.from_file(vocabulary)
        self.whole.encode_special_tokens = True
        self.pack = lambda ids: np.asarray(ids, dtype="<u4").tobytes()
        self.part = lambda text: self.pack(core.encode_ordinary(text))
        self.chunks = _Chunks(self.part)

    def __call__(self, text: str) -> bytes:
        if not text:
            return b""
        if "  " in text or " \n" in text or "\n " in text or text[0] in " \n" or text[-1] in " \n" or not text.isascii() and _RARE.search(text) or any(c in text for c in "\t\r\x0b\x0c\x1c\x1d\x1e\x1f"):
            return self.pack(self.whole.encode(text, add_special_tokens=False).ids)
        first, *rest = text.split(" ")
        return self.part(first) + b"".join(map(self.chunks.__getitem__, rest))


def encoder(vocabulary: str, ranks: str) -> Encoder:
    if (key := (vocabulary, ranks)) not in _ENCODERS:
        _ENCODERS[key] = Encoder(vocabulary, ranks)
    return _ENCODERS[key]


def paths() -> tuple[str, str]:
    import public_tokenizers

    return public_tokenizers.path(VOCABULARY), public_tokenizers.path(RANKS)


def pieces(docs: DataFrame, sequence: int = SEQUENCE, end_id: int = END_ID, with_ids: bool = False, files: tuple[str, str] | None = None) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32), and `ids` on request."""
    vocabulary, ranks = files or paths()
    end = end_id.to_bytes(4, "little")

    def run(doc_ids, texts):
        import numpy as np

        encode = encoder(vocabulary, ranks)
        out: list[list] = [[], [], [], [], [], []]
        for doc_id, text in zip(doc_ids, texts, strict=True):
            data = encode(text or "") + end
            n = len(data) // 4
            edges = [0, *range(n % sequence or sequence, n + 1, sequence)]
            for i, (a, b) in enumerate(zip(edges, edges[1:])):
                part = data[4 * a : 4 * b]
                for column, value in zip(out, (doc_id, i, a, b - a, zlib.crc32(part), np.frombuffer(part, "<u4").astype("int32") if with_ids else None)):
                    column.append(value)
        return out[: 5 + with_ids]

    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, piece int, start bigint, length bigint, ids_crc32 bigint" + ", ids array<int>" * with_ids
    return map_columns(docs.select("doc_id", "text"), run, schema)


def best_fit(counts: Counter, size: int) -> list[tuple[tuple[int, ...], int]]:
    """Best-fit decreasing on a histogram: (lengths of a bin, number of such bins)."""
    rooms: dict[int, list] = {}
    open_rooms = 0  # a bit for each room that some bin has
    done = []
    for s in sorted(counts, reverse=True):
        n = counts[s]
        while n:
            fitting = open_rooms >> s
            room = s + (fitting & -fitting).bit_length() - 1 if fitting else size
            bins, m = rooms[room].pop() if fitting else ((), -(-n // (size // s)))
            if fitting and not rooms[room]:
                open_rooms ^= 1 << room
            q = room // s
            full = min(m, n // q)
            groups = [(q, full)] + ([(n % q, 1)] if full < m and n // q == full and n % q else [])
            for q_, m_ in groups:
                if q_ and m_:
                    n -= q_ * m_
                    m -= m_
                    rooms.setdefault(room - q_ * s, []).append((bins + (s,) * q_, m_))
                    open_rooms |= 1 << (room - q_ * s)
            if m and bins:
                rooms.setdefault(room, []).append((bins, m))
                open_rooms |= 1 << room
    for r in rooms.values():
        done += r
    return done


def least_bins(counts: Counter, size: int) -> int:
    """Lower bound: lengths above size - k need bins of their own, those from k on share what is left there."""
    total = sum(s * n for s, n in counts.items())
    most = ceil(total / size)
    for k in sorted({s for s in counts if s <= size // 2}):
        alone = sum(n for s, n in counts.items() if s > size - k)
        half = sum(n for s, n in counts.items() if size // 2 < s <= size - k)
        free = half * size - sum(s * n for s, n in counts.items() if size // 2 < s <= size - k)
        small = sum(s * n for s, n in counts.items() if k <= s <= size // 2)
        most = max(most, alone + half + max(0, ceil((small - free) / size)))
    return max(most, sum(n for s, n in counts.items() if 2 * s > size))


def fillings(counts: list[int], room: int, waste: int, steps: int = STEPS) -> list[tuple[int, ...]]:
    """Undominated fillings of a room that leave at most `waste`, least waste first and then the longest lengths.

    A filling is dominated if a further length fits, or if one of its lengths can be swapped for a longer one.
    Any number of lengths is put together, longest first; `steps` bounds how many are looked at.
    """
    lengths = [s for s in range(min(room, len(counts) - 1), 0, -1) if counts[s]]
    below = [-s for s in lengths]
    used: Counter = Counter()
    out: list[tuple[int, tuple[int, ...]]] = []
    free = lambda s: counts[s] > used[s]

    def undominated(chosen: tuple[int, ...], left: int) -> bool:
        if any(map(free, lengths[bisect_left(below, -left):])):
            return False
        return not any(free(s) for a in set(chosen) for s in lengths[bisect_left(below, -(a + left)) : bisect_left(below, -a)])

    stack: list[tuple[int, int, tuple[int, ...]]] = [(0, room, ())]
    while stack and steps:
        at, left, chosen = stack.pop()
        steps -= 1
        used.clear()
        used.update(chosen)
        if left <= waste and undominated(chosen, left):
            out.append((left, chosen))
        for i in range(len(lengths) - 1, max(at, bisect_left(below, -left)) - 1, -1):
            if free(lengths[i]):
                stack.append((i, left - lengths[i], (*chosen, lengths[i])))
    return [chosen for _, chosen in sorted(out, key=lambda x: (x[0], [-s for s in x[1]]))]


def _completions(left: list[int], steps: tuple, used: int, lost: int, largest: int, size: int, spare: int):
    """The nodes below one: each filling around the largest length as often as the counts allow, then half as often, down to once."""
    others = left.copy()
    others[largest] -= 1
    for chosen in fillings(others, size - largest, spare):
        need = Counter((largest, *chosen))
        gap = size - largest - sum(chosen)
        times = min(min(left[s] // n for s, n in need.items()), spare // gap if gap else left[largest])
        while times:
            after = left.copy()
            for s, n in need.items():
                after[s] -= n * times
            yield after, (((largest, *chosen), times), steps), used + times, lost + gap * times
            times //= 2


def bin_completion(histogram: Counter, size: int = SEQUENCE, nodes: int = NODES) -> list[tuple[tuple[int, ...], int]]:
    """Few bins that hold every length of the histogram: (lengths in falling order, number of bins)."""
    histogram = Counter({s: n for s, n in histogram.items() if n})
    best = best_fit(histogram, size)
    total = sum(s * n for s, n in histogram.items())
    fewest, floor, seen = sum(m for _, m in best), least_bins(histogram, size), 0
    stack = [iter([([histogram[s] for s in range(size + 1)], (), 0, 0)])]  # counts left, chain of steps, bins, waste
    while stack and fewest > floor and seen < nodes:
        if (node := next(stack[-1], None)) is None:
            stack.pop()
            continue
        left, steps, used, lost = node
        spare = (fewest - 1) * size - total - lost  # waste that a better solution may still have
        if spare < 0:
            continue
        largest = max((s for s, n in enumerate(left) if n), default=0)
        if seen % FIT_EVERY == 0 or not largest:
            rest = best_fit(Counter({s: n for s, n in enumerate(left) if n}), size)
            if used + sum(m for _, m in rest) < fewest:
                done, at = [], steps
                while at:
                    done.append(at[0])
                    at = at[1]
                best, fewest = done + rest, used + sum(m for _, m in rest)
        seen += 1
        if largest:
            stack.append(_completions(*node, largest, size, spare))
    return best


def pack(cut_pieces: DataFrame, sequence: int = SEQUENCE) -> DataFrame:
    """Adds sequence_id and offset to stored pieces."""
    spark = cut_pieces.sparkSession
    keyed = cut_pieces.withColumn("_b", F.pmod(F.xxhash64(fold_id(), "piece", "ids_crc32"), F.lit(BUCKETS)))
    groups = cut(keyed.groupBy("length", "_b").agg(F.count("*").alias("n")))
    histogram = Counter({r["length"]: r["n"] for r in groups.groupBy("length").agg(F.sum("n").alias("n")).collect()})  # one row a length
    slots, taken, first = [], Counter(), 0
    for lengths, times in bin_completion(histogram, sequence):
        at = 0
        for s, n in sorted(Counter(lengths).items(), reverse=True):
            slots.append((s, taken[s], taken[s] + n * times, first, n, at))
            taken[s] += n * times
            at += s * n
        first += times
    places = spark.createDataFrame(slots, "length bigint, lo bigint, hi bigint, first bigint, per_bin bigint, at bigint")
    before = Window.partitionBy("length").orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    offsets = groups.select("length", "_b", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    inside = Window.partitionBy("length", "_b").orderBy(fold_id(), "piece", "start", "ids_crc32")
    ranked = keyed.withColumn("rank", F.row_number().over(inside) - 1).join(offsets, ["length", "_b"]).withColumn("rank", F.col("rank") + F.col("before"))
    # The slots are a few for each of at most `sequence` lengths, so they may be sent to all.
    placed = ranked.join(F.broadcast(places), "length").filter((F.col("rank") >= F.col("lo")) & (F.col("rank") < F.col("hi")))
    step = F.col("rank") - F.col("lo")
    return placed.select(
        *[F.col(f"`{c}`") for c in cut_pieces.columns],
        (F.col("first") + F.floor(step / F.col("per_bin"))).cast("bigint").alias("sequence_id"),
        (F.col("at") + (step % F.col("per_bin")) * F.col("length")).cast("bigint").alias("offset"),
    )


def pack_documents(docs: DataFrame, sequence: int = SEQUENCE, with_ids: bool = False) -> DataFrame:
    return pack(cut(pieces(docs, sequence, with_ids=with_ids)), sequence)
