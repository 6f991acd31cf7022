"""Helpers shared by the training-data operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def crc_mod(doc_id: str | Column, n: int) -> Column:
    """crc32 of the id as text, modulo n; a null id counts as the empty text."""
    col = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.crc32(F.coalesce(col.cast("string"), F.lit("")).cast("binary")) % n


def fold_id(doc_id: str = "doc_id") -> Column:
    """An id that joins by equality although it may be null."""
    return F.coalesce(F.col(doc_id).cast("string"), F.lit("\u0000null"))


def with_key(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Adds `_id` and `_k`: together they tell rows apart but for exact repeats of id and text."""
    return docs.withColumns({"_id": fold_id(id_col), "_k": F.xxhash64(F.col(text_col), F.length(text_col))})


def carried(docs: DataFrame, *needed: str) -> DataFrame:
    """The needed columns and the key, with the whole row kept in `_row`, so that no name can clash."""
    return with_key(docs.select(*needed, F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row")))


def bound(value: Column, use) -> Column:
    """use(value) with the value worked out once, however often it is used."""
    return F.transform(F.array(value), use)[0]


def running(values: Column, join=None) -> Column:
    """Running sums of an array of whole numbers, or what else `join` gives of two; it reaches twice as far from round to round."""
    join = join or (lambda a, b: a + b)
    reach = lambda acc, x, at: F.when(at >= 0, join(x, F.get(acc, at))).otherwise(x)
    step = lambda acc, k: F.transform(acc, lambda x, i: reach(acc, x, i - F.call_function("shiftleft", F.lit(1), k)))
    rounds = F.sequence(F.lit(0), F.length(F.bin((F.size(values) - 1).cast("bigint"))) - 1)
    return F.when(F.size(values) < 2, values).otherwise(F.aggregate(rounds, values, step))


def spans(text: Column, pattern: str, context: int = 0) -> Column:
    """Matches of a Java pattern, leftmost and not overlapping: array of (start, end, hit) in code points.

    The matches and the gaps between them are cut by the same pattern, so running lengths give the
    places; n matches cost n log n steps.  With a context, `before` is at most so many characters
    ahead of the match, back to the start of the match before it, and `after` the next character.
    """
    hits, gaps = F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), F.split(text, pattern, -1)
    fields = "start:bigint,end:bigint,hit:string" + ",before:string,after:string" * bool(context)
    lengths = lambda h, g: F.zip_with(F.slice(g, F.lit(1), F.size(h)), h, lambda a, x: (F.length(a) + F.length(x)).cast("bigint"))

    def placed(h: Column, g: Column, ends: Column) -> Column:
        def one(x: Column, i: Column) -> Column:
            end = F.get(ends, i)
            around = [
                F.right(F.concat(F.coalesce(F.get(h, i - 1), F.lit("")), F.get(g, i)), F.lit(context)).alias("before"), F.left(F.get(g, i + 1), F.lit(1)).alias("after"),
            ] if context else []
            return F.struct((end - F.length(x)).cast("bigint").alias("start"), end.alias("end"), x.alias("hit"), *around)

        return F.transform(h, one)

    found = bound(F.struct(hits.alias("h"), gaps.alias("g")), lambda x: bound(running(lengths(x["h"], x["g"])), lambda ends: placed(x["h"], x["g"], ends)))
    return F.when(text.rlike(pattern), found).otherwise(F.array().cast(f"array<struct<{fields}>>"))


def spell(found: Column) -> Column:
    """kind:start:end of every span, comma-joined in the order of the array."""
    return F.array_join(F.transform(found, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")


def map_columns(df: DataFrame, fn, schema: str) -> DataFrame:
    """Runs fn(columns as lists) -> columns as lists on every Arrow batch; fn(None) is not called for empty input."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string

    arrow = to_arrow_schema(_parse_datatype_string(schema))

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            if batch.num_rows:
                out = fn(*[c.to_pylist() for c in batch.columns])
                yield pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(out, arrow, strict=True)], schema=arrow)

    return df.mapInArrow(run, schema)


def add_columns(df: DataFrame, inputs: list[str], fn, added: str) -> DataFrame:
    """The rows of df with the columns that fn(columns as lists) gives; columns of these names are replaced."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType, _parse_datatype_string

    new = _parse_datatype_string(added)
    kept = df.drop(*new.names)
    schema = StructType(kept.schema.fields + new.fields)
    arrow = to_arrow_schema(new)
    names, wanted = list(kept.columns), list(df.columns)

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            if batch.num_rows:
                out = fn(*[batch.column(wanted.index(c)).to_pylist() for c in inputs])
                columns = [batch.column(wanted.index(c)) for c in names] + [pa.array(c, type=f.type) for c, f in zip(out, arrow, strict=True)]
                yield pa.RecordBatch.from_arrays(columns, names=names + arrow.names)

    return df.mapInArrow(run, schema)


def hash_sample(rows: DataFrame, group: str, h: Column, most: int) -> DataFrame:
    """At most `most` rows of each group, those with the smallest hashes; equal hashes count once.

    A threshold keeps about three times as many before anything is ranked.
    """
    from pyspark.sql import Window

    hashed = rows.withColumn("_h", h)
    sizes = hashed.groupBy(group).agg(F.count("*").alias("_n"))
    # One row for each label or language that is learned, so it may be sent to all; the texts stay where they are.
    near = hashed.join(F.broadcast(sizes), group).filter(F.pmod("_h", F.lit(1 << 30)).cast("double") * F.col("_n") < F.lit(3.0 * most * (1 << 30)))
    ranked = near.dropDuplicates([group, "_h"]).withColumn("_r", F.row_number().over(Window.partitionBy(group).orderBy("_h")))
    return ranked.filter(F.col("_r") <= most).drop("_n", "_r")


HEAVY = 10_000  # shares of all rows from which a key counts as hot


def semi_join(rows: DataFrame, keys: DataFrame, on: list[str]) -> DataFrame:
    """The stored rows whose key is among the keys (one row each, with `n`, how many of the rows have it).

    A key that more than one row in `HEAVY` has is sent to the rows, there being at most `HEAVY` such
    keys; the other rows are shuffled, so no task gets many more rows than that share.
    """
    limit = rows.count() / HEAVY
    heavy = F.broadcast(keys.filter(F.col("n") > limit).select(*on))
    light = keys.filter(F.col("n") <= limit).select(*on)
    return rows.join(heavy, on, "left_semi").unionByName(rows.join(heavy, on, "left_anti").join(light, on, "left_semi"))
