"""Embedding near-duplicates by cross-polytope hashing.

Vectors are normalised, padded to a power of two and turned by three rounds of random signs and a
fast Hadamard transform.  The coordinate of largest magnitude, with its sign, is one hash; a bucket
joins some of them, and there are several tables: as many hashes as keep the mean bucket within
`MEAN_BUCKET` vectors, and the more hashes, the more tables, so recall stays where it is while the
corpus grows.  A vector lives in its own bucket and is a guest in those where one hash is its second choice.  Pairs that meet are verified by the cosine in
double precision; a pair is counted in the first table where it meets.  No pair is written: each
bucket gives, per vector, the links found there and the smallest vector it reaches.

Equal vectors are one node with a count.  Buckets with more than `BUCKET` homes or guests are cut
into blocks, and each pair of blocks is a group of its own.

Defined cases: null or zero vectors, and those with null or non-finite components, have no link
and are their own component; vectors of different length never link; rows with the same id but
different vectors are different nodes, whose ids may coincide; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from playbill.llm.components import components, in_slots, joined
from playbill.session import cut

COSINE = 0.95
TABLES = {2: 5, 3: 10, 4: 18}  # tables for that many hashes
MEAN_BUCKET = 64
ROUNDS = 3
BUCKET = 1_000
SHARD_ROWS = 4_000  # rows that one task call takes; buckets are only gathered into shards to save calls
_SIGNS: dict[tuple[int, int], list] = {}


def width_of(dim: int) -> int:
    return 1 << max(0, (dim - 1).bit_length())


def hashes_for(count: int, dim: int) -> int:
    """Hashes that a bucket joins, so that `count` vectors of this length fill the buckets with `MEAN_BUCKET` on the mean."""
    return next((h for h in sorted(TABLES) if (2 * width_of(dim)) ** h * MEAN_BUCKET >= count), max(TABLES))


def signs(dim: int, hashes: int):
    import numpy as np

    if (dim, hashes) not in _SIGNS:
        rng = np.random.default_rng(1_000 + dim)
        _SIGNS[dim, hashes] = rng.choice([-1.0, 1.0], size=(TABLES[hashes], hashes, ROUNDS, dim))
    return _SIGNS[dim, hashes]


def hadamard(x):
    """Fast Walsh-Hadamard transform along the last axis."""
    import numpy as np

    n, h = x.shape[-1], 1
    while h < n:
        x = x.reshape(*x.shape[:-1], n // (2 * h), 2, h)
        x = np.stack([x[..., 0, :] + x[..., 1, :], x[..., 0, :] - x[..., 1, :]], axis=-2).reshape(*x.shape[:-3], n)
        h *= 2
    return x


def unit(vectors):
    import numpy as np

    x = np.asarray(vectors, dtype=np.float64)
    x = x / np.abs(x).max(axis=1, keepdims=True)  # squares can neither overflow nor vanish
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def codes(vectors, table: int, hashes: int):
    """(home bucket, guest buckets) of unit vectors in one table."""
    import numpy as np

    width = width_of(vectors.shape[1])
    padded = np.zeros((len(vectors), width))
    padded[:, : vectors.shape[1]] = vectors
    first, second = [], []
    for s in signs(width, hashes)[table]:
        x = padded
        for r in range(ROUNDS):
            x = hadamard(x * s[r])
        size = np.abs(x)
        order = np.argsort(-size, axis=1, kind="stable")[:, :2]
        if width == 1:
            order = np.repeat(order[:, :1], 2, axis=1)
        for to, column in ((first, order[:, 0]), (second, order[:, 1])):
            to.append(2 * column + (x[np.arange(len(x)), column] < 0))
    base = 2 * width
    home = sum(c * base**i for i, c in enumerate(first))
    guests = [sum((second[i] if i == j else c) * base**i for i, c in enumerate(first)) for j in range(hashes)]
    return home, guests


def buckets(nodes: DataFrame, count: int) -> DataFrame:
    """(node, n, embedding, dim, tab, bucket, guest) of about `count` nodes."""
    from pyspark.sql.types import BooleanType, IntegerType, LongType, StructField, StructType

    schema = StructType([
        *nodes.select("node", "n", "embedding").schema.fields, StructField("dim", IntegerType()), StructField("tab", IntegerType()), StructField("bucket", LongType()), StructField("guest", BooleanType()),
    ])

    def run(batches):
        import numpy as np
        import pyarrow as pa
        import pyarrow.compute as pc

        for batch in batches:
            dims = pc.list_value_length(batch.column(2)).to_numpy(zero_copy_only=False)
            for dim in np.unique(dims):
                rows = np.flatnonzero(dims == dim)
                x = unit(np.array(batch.column(2).take(pa.array(rows)).flatten()).reshape(len(rows), dim))
                hashes = hashes_for(count, int(dim))
                for t in range(TABLES[hashes]):
                    home, guests = codes(x, t, hashes)
                    for is_guest, column in ((False, home), *((True, g) for g in guests)):
                        use = np.flatnonzero(column != home) if is_guest else np.arange(len(rows))
                        own = batch.take(pa.array(rows[use]))
                        n = len(use)
                        yield pa.RecordBatch.from_arrays(
                            [*own.columns, pa.array(np.full(n, dim, np.int32)), pa.array(np.full(n, t, np.int32)), pa.array(column[use].astype(np.int64)), pa.array(np.full(n, is_guest))],
                            names=["node", "n", "embedding", "dim", "tab", "bucket", "guest"],
                        )

    return nodes.select("node", "n", "embedding").mapInArrow(run, schema)


def _verify(cosine: float, count: int):
    import numpy as np
    import pandas as pd

    def run(key, frame):
        # Homes first within each bucket; buckets of one row, and those without a home, have no pair.
        frame = frame.iloc[np.lexsort((frame["guest"].to_numpy(), frame["bucket"].to_numpy()))]
        nodes, weight, guest = frame["node"].to_numpy(), frame["n"].to_numpy(), frame["guest"].to_numpy()
        x = unit(np.stack(frame["embedding"].to_numpy()))
        edges = np.flatnonzero(np.diff(frame["bucket"].to_numpy(), prepend=np.nan, append=np.nan))
        parts = [one(int(key[1]), nodes[a:b], weight[a:b], x[a:b], int((~guest[a:b]).sum()), key[3] == key[4]) for a, b in zip(edges, edges[1:]) if b - a > 1 and not guest[a]]
        parts = [p for p in parts if p is not None]
        return pd.DataFrame(dict(zip(("node", "links", "root"), map(np.concatenate, zip(*parts))))) if parts else pd.DataFrame({"node": [], "links": [], "root": []}).astype("int64")

    def one(table, nodes, weight, x, homes, inner):
        if len(nodes) <= 64 and not (np.triu(x[:homes] @ x.T, 1) >= cosine).any():  # most buckets
            return None
        order = np.argsort(np.argsort(nodes, kind="stable"), kind="stable")
        labels, links, linked = order.copy(), np.zeros(len(nodes), dtype=np.int64), np.zeros(len(nodes), dtype=bool)
        kept = None
        step = max(1, 2_000_000 // max(1, len(nodes)))
        for start in range(0, homes, step):
            end = min(homes, start + step)
            block = x[start:end] @ x.T >= cosine
            block &= nodes[start:end, None] != nodes[None, :]
            # Each pair of homes once, and in one group only.
            block[:, :homes] &= inner & (np.arange(start, end)[:, None] < np.arange(homes)[None, :])
            if not block.any():
                continue
            if kept is None:
                kept = [codes(x, t, hashes_for(count, x.shape[1])) for t in range(table + 1)]
            joined(block, start, labels)
            left, right = np.nonzero(block)
            left += start
            new = np.ones(len(left), dtype=bool)
            for t, (home, guests) in enumerate(kept):
                to_left = np.any([g[right] == home[left] for g in guests], axis=0)
                to_right = np.any([g[left] == home[right] for g in guests], axis=0)
                same = home[left] == home[right]
                if t < table:
                    new &= ~(same | to_left | to_right)
                else:  # both may visit each other: the home with the smaller node counts the pair
                    new &= same | ~(to_left & to_right) | (nodes[left] < nodes[right])
            left, right = left[new], right[new]
            np.add.at(links, left, weight[right])
            np.add.at(links, right, weight[left])
        linked = (links > 0) | (labels != order)
        ranked = np.empty_like(nodes)
        ranked[order] = nodes
        return nodes[linked], links[linked], ranked[labels[linked]]

    return run


def near_duplicates(rows: DataFrame, cosine: float = COSINE, bucket: int = BUCKET, expected: int | None = None) -> DataFrame:
    """One row per vector: vec_id, n_links, component_id, kept.  `expected` sets the hashes as for so many vectors."""
    size = F.aggregate("embedding", F.lit(0.0), lambda a, x: a + F.abs(x.cast("double")))
    odd = F.exists("embedding", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    usable = F.col("embedding").isNotNull() & F.coalesce(~odd, F.lit(False)) & (F.coalesce(size, F.lit(0.0)) > 0)
    named = cut(rows.select("vec_id", F.when(usable, F.xxhash64("embedding")).alias("node"), F.when(usable, F.col("embedding")).alias("embedding")))
    nodes = named.filter("node IS NOT NULL").groupBy("node").agg(F.count("*").alias("n"), F.min("vec_id").alias("least"), F.first("embedding").alias("embedding"))
    total = expected or named.select("node").distinct().count()
    routed = cut(buckets(nodes, total))
    keys = ["dim", "tab", "bucket"]
    count = routed.filter("tab = 0").count()
    shard = F.pmod(F.xxhash64("bucket"), F.lit(-(-count // SHARD_ROWS) or 1)).cast("int")
    dealt = in_slots(routed, keys, "node", bucket).select("dim", "tab", "bucket", "slot", "part", "node", "n", "embedding", "guest", shard.alias("shard"))
    # Dealt by the whole key: the blocks of a hot bucket are not to stay where its rows met to be counted.
    found = cut(dealt.repartition("dim", "tab", "shard", "slot", "part").groupBy("dim", "tab", "shard", "slot", "part").applyInPandas(_verify(cosine, total), "node bigint, links bigint, root bigint"))
    links = found.groupBy("node").agg(F.sum("links").alias("links"))
    roots = components(found.select(F.col("node").alias("a"), F.col("root").alias("b"))).withColumnRenamed("node", "member")
    copies = named.filter("node IS NOT NULL").groupBy("node").agg(F.count("*").alias("n"), F.min("vec_id").alias("least"))
    grouped = (
        copies.join(links, "node", "left").join(roots, F.col("node") == F.col("member"), "left")
        .select("node", "least", (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("n_links"), F.coalesce("root", "node").alias("root"))
    )
    least = grouped.groupBy("root").agg(F.min("least").alias("component_id"))
    of_node = grouped.join(least, "root").select("node", "n_links", "component_id")
    out = named.select("vec_id", "node").join(of_node, "node", "left")
    component = F.coalesce("component_id", "vec_id")
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("bigint").alias("n_links"), component.alias("component_id"), (F.col("vec_id").eqNullSafe(component)).alias("kept"))
