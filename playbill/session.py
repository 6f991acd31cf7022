"""Session helpers shared by operators that iterate."""

from __future__ import annotations

import gc
import tempfile
import uuid
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

_CHECKPOINT_KEY = "spark.checkpoint.dir"


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder named by the cluster; a temporary one only where none is set and all tasks run in this process (tests)."""
    shared = spark.conf.get(_CHECKPOINT_KEY, None)
    if not shared:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError(f"set {_CHECKPOINT_KEY} to a folder that driver and executors share")
        shared = tempfile.mkdtemp(prefix="playbill-checkpoint-")
        spark.conf.set(_CHECKPOINT_KEY, shared)
    return shared.rstrip("/")


def cut(df: DataFrame) -> DataFrame:
    """Writes a table to the shared folder and reads it back: lineage ends here and executors may be lost."""
    path = f"{checkpoint_dir(df.sparkSession)}/playbill/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def records(batch) -> list[dict]:
    """Rows of an Arrow batch as dicts, whole columns at a time."""
    import pyarrow as pa

    def values(c):
        plain = pa.types.is_string(c.type) or pa.types.is_boolean(c.type) or (pa.types.is_integer(c.type) and not c.null_count)
        return c.to_numpy(zero_copy_only=False).tolist() if plain else c.to_pylist()

    return [dict(zip(batch.schema.names, r)) for r in zip(*[values(c) for c in batch.columns])]


@contextmanager
def uncollected():
    """Rows hold no cycles: without the cyclic collector, which would walk over all of them again and again."""
    on = gc.isenabled()
    gc.disable()
    try:
        yield
    finally:
        if on:
            gc.enable()


def ship(spark: SparkSession) -> SparkSession:
    """Makes the package importable in Python workers, once per Spark context."""
    import pathlib
    import zipfile

    context = spark.sparkContext
    if not getattr(context, "_playbill_shipped", False):
        root = pathlib.Path(__file__).resolve().parent
        target = pathlib.Path(tempfile.mkdtemp(prefix="playbill-code-")) / "playbill.zip"
        with zipfile.ZipFile(target, "w") as archive:
            for source in sorted(root.rglob("*.py")):
                archive.write(source, source.relative_to(root.parent))
        context.addPyFile(str(target))
        context._playbill_shipped = True
    return spark
