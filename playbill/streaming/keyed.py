"""Tables with one row per key, kept by micro-batches.

Rows lie in buckets by the hash of their key.  A batch reads and rewrites only the buckets that its
keys fall into, into a folder of its own, and is then entered in the manifest in one step: bucket by
bucket, which folder holds it now.  A reader follows the manifest, so it sees all of a batch or
nothing; a batch that is already entered changes nothing when it is replayed, and what a batch that
failed has left behind is overwritten.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from playbill.streaming.state import merge_sightings, sightings
from playbill.streaming.streams import accept_conversions, first_of, idempotent_clicks

BUCKETS = 64
_MANIFEST = "batch bigint, bucket int, folder string"


class KeyedTable:
    """A table below `path` with the given key columns; `merge(known, fresh)` gives the new rows of touched buckets."""

    def __init__(self, path: str, schema: str, keys: list[str], merge: Callable[[DataFrame, DataFrame], DataFrame], buckets: int = BUCKETS):
        self.path, self.schema, self.keys, self.merge, self.buckets = path.rstrip("/"), schema, list(keys), merge, buckets

    def _bucket(self, rows: DataFrame) -> DataFrame:
        return rows.withColumn("bucket", F.pmod(F.xxhash64(*self.keys), F.lit(self.buckets)).cast("int"))

    def _entries(self, spark: SparkSession) -> DataFrame:
        try:
            return spark.read.schema(_MANIFEST).json(f"{self.path}/manifest")
        except AnalysisException:  # nothing has been entered yet
            return spark.createDataFrame([], _MANIFEST)

    def _folders(self, spark: SparkSession, of: list[int] | None = None) -> list[str]:
        now = self._entries(spark).filter("bucket >= 0").groupBy("bucket").agg(F.max_by("folder", "batch").alias("folder"))
        rows = (now if of is None else now.filter(F.col("bucket").isin(of))).collect()  # one row a bucket
        return [f"{self.path}/{r['folder']}/bucket={r['bucket']}" for r in rows]

    def _rows(self, spark: SparkSession, folders: list[str]) -> DataFrame:
        return spark.read.schema(self.schema).parquet(*folders) if folders else spark.createDataFrame([], self.schema)

    def read(self, spark: SparkSession) -> DataFrame:
        """All rows as of the last batch that was entered."""
        return self._rows(spark, self._folders(spark))

    def around(self, rows: DataFrame) -> DataFrame:
        """The rows of those buckets alone that the keys of the given rows fall into."""
        return self._rows(rows.sparkSession, self._folders(rows.sparkSession, self._touched(self._bucket(rows))))

    @staticmethod
    def _touched(rows: DataFrame) -> list[int]:
        return sorted(r["bucket"] for r in rows.select("bucket").distinct().collect())  # at most one row a bucket

    def apply(self, fresh: DataFrame, batch_id: int) -> bool:
        """Merges a micro-batch; False if it had been merged before."""
        spark = fresh.sparkSession
        if not self._entries(spark).filter(F.col("batch") == batch_id).isEmpty():
            return False
        names = StructType.fromDDL(self.schema).names
        fresh = self._bucket(fresh.select(*names))
        touched = self._touched(fresh)
        if touched:
            known = self._rows(spark, self._folders(spark, touched))
            merged = self._bucket(self.merge(known, fresh.drop("bucket")).select(*names))
            # One file a bucket; the bucket's rows meet in one task, so their number is what `buckets` is for.
            merged.repartition(self.buckets, "bucket").write.mode("overwrite").partitionBy("bucket").parquet(f"{self.path}/batch-{batch_id}")
        entry = [(batch_id, b, f"batch-{batch_id}") for b in touched] or [(batch_id, -1, "")]  # a batch without rows is entered too
        spark.createDataFrame(entry, _MANIFEST).coalesce(1).write.mode("append").json(f"{self.path}/manifest")
        return True


def keep_known(keys: list[str], at: str):
    """Insert or ignore: a known key keeps its row for ever; of new rows the earliest comes in."""

    def merge(known: DataFrame, fresh: DataFrame) -> DataFrame:
        new = first_of(fresh, keys, at).join(known.select(*keys), keys, "left_anti")
        return known.unionByName(new)

    return merge


def quarantine(rows: DataFrame, path: str, batch_id: int) -> None:
    """Rejected rows with their reason, in a folder named by the batch, so a replay overwrites its own."""
    rows.write.mode("overwrite").json(f"{path}/quarantine/batch={batch_id}")


def click_table(path: str, schema: str, buckets: int = BUCKETS) -> KeyedTable:
    return KeyedTable(f"{path}/clicks", schema, ["click_id"], keep_known(["click_id"], "created_at"), buckets)


def clicks_sink(path: str, schema: str, buckets: int = BUCKETS):
    """The first click of an id wins for ever, however late another comes; ids of a wrong form are kept aside."""
    table = click_table(path, schema, buckets)

    def sink(batch: DataFrame, batch_id: int) -> None:
        good, bad = idempotent_clicks(batch, streaming=False)
        quarantine(bad, f"{path}/clicks", batch_id)
        table.apply(good, batch_id)

    return sink


def conversion_table(path: str, schema: str, buckets: int = BUCKETS) -> KeyedTable:
    keys = ["click_id", "partner_conversion_id"]
    return KeyedTable(f"{path}/conversions", schema, keys, keep_known(keys, "recorded_at"), buckets)


def conversions_sink(path: str, schema: str, clicks: KeyedTable, buckets: int = BUCKETS):
    """Conversions of known clicks, once for each partner id; the others are kept aside with the reason.

    Rows without a partner id never collide, so they are files named by the batch.
    """
    table = conversion_table(path, schema, buckets)

    def sink(batch: DataFrame, batch_id: int) -> None:
        good, bad = accept_conversions(batch, clicks.around(batch))
        quarantine(bad, f"{path}/conversions", batch_id)
        good.filter(F.col("partner_conversion_id").isNull()).write.mode("overwrite").parquet(f"{path}/conversions/unnamed/batch={batch_id}")
        table.apply(good.filter(F.col("partner_conversion_id").isNotNull()), batch_id)

    return sink


def conversions(spark: SparkSession, path: str, schema: str, buckets: int = BUCKETS) -> DataFrame:
    """All accepted conversions."""
    named = conversion_table(path, schema, buckets).read(spark)
    try:
        return named.unionByName(spark.read.schema(schema).parquet(f"{path}/conversions/unnamed/*"))
    except AnalysisException:
        return named


_SEEN = "event_id string, first_seen_at timestamp, last_seen_at timestamp"


def sighting_table(path: str, buckets: int = BUCKETS) -> KeyedTable:
    return KeyedTable(f"{path}/sightings", _SEEN, ["event_id"], merge_sightings, buckets)


def sightings_sink(path: str, buckets: int = BUCKETS):
    """First and last sighting of every listing; only the buckets of the batch's listings are rewritten."""
    table = sighting_table(path, buckets)
    return lambda batch, batch_id: table.apply(sightings(batch), batch_id) and None
