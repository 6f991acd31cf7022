"""Order-free digest of an id set."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def id_signature(ids: DataFrame, column: str = "id") -> DataFrame:
    """Digest of any number of distinct ids: an order-free sum of per-id hashes, combined on the map side."""
    clean = ids.filter(F.coalesce(F.col(column), F.lit("")) != "").select(column).distinct()
    part = lambda i: F.conv(F.substring(F.sha1(column), 1 + 10 * i, 10), 16, 10).cast("decimal(38,0)")
    total = F.concat_ws("-", *[F.coalesce(F.sum(part(i)), F.lit(0)).cast("string") for i in range(4)])
    return clean.agg(F.sha1(total).alias("signature"), F.count("*").alias("ids"))
