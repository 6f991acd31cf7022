"""Tiny listings for tests."""

from pyspark.sql import Row  # noqa: F401

from playbill.schema import _DEFAULTS, listing_type


def listings(spark, rows):
    schema = listing_type()
    out = []
    for i, row in enumerate(rows):
        full = {}
        for f in schema:
            if f.name in row:
                full[f.name] = row[f.name]
            elif f.name in _DEFAULTS:
                full[f.name] = _DEFAULTS[f.name]
            elif f.dataType.typeName() == "array":
                full[f.name] = []
            else:
                full[f.name] = None
        if full["ingest_ord"] is None:
            full["ingest_ord"] = i
        if full["id"] is None:
            full["id"] = f"e{i}"
        if "source_count" not in row:
            full["source_count"] = max(1, len(full["source_names"]))
        out.append(tuple(full[f.name] for f in schema))
    return spark.createDataFrame(out, schema)
