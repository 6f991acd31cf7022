"""Import runs: staged tables by source, and a manifest that is published in one step.

Every source is read, tagged and written into a folder of its own.  A source that fails becomes a
status row and keeps the folder of its last good run; the others are not touched by it.  When all
are done, the manifest of the next version names the folder of each source: readers see the old
version or the new one.  A rerun may be limited to the sources that failed.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterable
from concurrent.futures import ThreadPoolExecutor
from typing import NamedTuple

from pyspark import inheritable_thread_target
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from playbill import vocab
from playbill.functions.classify import apply_taxonomy
from playbill.schema import as_listings, listing_type
from playbill.sources.ingest import completeness, placed, safe_error

THREADS = 6  # sources read at a time
FAILED, EMPTY_SEASON, PARTIAL, FINE = "Fel", "Säsongstom", "Delvis", "OK"
MANIFEST = (
    "source string, name string, source_ord int, status string, imported bigint, comment string, run string, folder string, "
    "pages_fetched bigint, total_pages int, failed_pages bigint, truncated boolean"
)


class Feed(NamedTuple):
    """A source: how its landed data become listings (`ingest_ord` within the source), and its page walk for the completeness check."""

    key: str
    name: str
    source_ord: int
    read: Callable[[SparkSession], DataFrame]
    walk: Callable[[SparkSession], DataFrame] | None = None


def _versions(spark: SparkSession, root: str) -> DataFrame:
    try:
        return spark.read.schema(f"version bigint, {MANIFEST}").json(f"{root}/manifest")
    except AnalysisException:  # nothing has been published
        return spark.createDataFrame([], f"version bigint, {MANIFEST}")


def manifest(spark: SparkSession, root: str, version: int | None = None) -> DataFrame:
    """One row per source of a version, the last one by default."""
    rows = _versions(spark, root)
    if version is None:
        version = rows.agg(F.max("version")).first()[0]
    return rows.filter(F.col("version") == version).drop("version").orderBy("source_ord")


def _stage(spark: SparkSession, root: str, run: str, feed: Feed) -> dict:
    """Status row of one source; whatever goes wrong in it stays in it."""
    row = dict.fromkeys([c.split()[0] for c in MANIFEST.split(", ")]) | {"source": feed.key, "name": feed.name, "source_ord": feed.source_ord, "run": run, "imported": 0, "comment": ""}
    try:
        folder = f"staged/{feed.key}/{run}"
        apply_taxonomy(as_listings(placed(feed.read(spark), feed.source_ord))).write.mode("overwrite").parquet(f"{root}/{folder}")
        n = spark.read.schema(listing_type()).parquet(f"{root}/{folder}").count()
        walk = completeness(feed.walk(spark)).first() if feed.walk else None  # one row: a run of one source
        row |= {"folder": folder, "imported": n, "status": EMPTY_SEASON if n == 0 and feed.name in vocab.SEASONAL_SOURCES else FINE}
        if walk is not None:
            row |= {k: walk[k] for k in ("pages_fetched", "total_pages", "failed_pages", "truncated")}
            row["status"] = PARTIAL if walk["truncated"] else row["status"]
    except Exception as error:  # noqa: BLE001  one source never stops the others
        row |= {"status": FAILED, "comment": type(error).__name__}
    return row


def run_import(spark: SparkSession, root: str, feeds: Iterable[Feed], enabled: Iterable[str] | None = None, only: Iterable[str] | None = None, threads: int = THREADS) -> DataFrame:
    """Runs the sources and publishes the next version; returns its status rows in source order.

    `enabled` switches sources on by key, unknown keys are ignored; `only` limits the run, the other
    sources keep what they have.
    """
    run = uuid.uuid4().hex
    before = {r["source"]: r.asDict() for r in manifest(spark, root).collect()}  # one row a source
    wanted = [f for f in feeds if (enabled is None or f.key in set(enabled)) and (only is None or f.key in set(only))]
    with ThreadPoolExecutor(max(1, threads)) as pool:
        done = {r["source"]: r for r in pool.map(inheritable_thread_target(spark)(lambda f: _stage(spark, root, run, f)), wanted)}
    for key, row in done.items():
        if row["status"] == FAILED and key in before:
            row["folder"] = before[key]["folder"]
    rows = sorted((before | done).values(), key=lambda r: (r["source_ord"], r["source"]))
    entries = spark.createDataFrame(rows, MANIFEST)
    text = F.when(F.col("status") == FAILED, F.when(F.col("run") == run, safe_error(F.col("comment"))).otherwise(F.col("comment"))).otherwise(F.col("comment"))
    version = (_versions(spark, root).agg(F.max("version")).first()[0] or 0) + 1
    # One file, moved into its place when it is whole: this is the step that publishes.
    entries.withColumn("comment", text).coalesce(1).write.mode("errorifexists").json(f"{root}/manifest/version={version}")
    return status(spark, root)


def status(spark: SparkSession, root: str, version: int | None = None) -> DataFrame:
    return manifest(spark, root, version).drop("folder", "run")


def failed(spark: SparkSession, root: str) -> list[str]:
    """Keys of the sources that a rerun is for."""
    return [r["source"] for r in manifest(spark, root).filter(F.col("status") == FAILED).select("source").collect()]


def catalogue(spark: SparkSession, root: str, version: int | None = None) -> DataFrame:
    """The listings of all sources of a version, in one scan."""
    folders = [f"{root}/{r['folder']}" for r in manifest(spark, root, version).filter("folder IS NOT NULL").select("folder").collect()]
    return spark.read.schema(listing_type()).parquet(*folders) if folders else spark.createDataFrame([], listing_type())
