"""Import runs: failure isolation, published versions, reruns of what failed, page numbers in two levels."""

import pytest
from pyspark.sql import functions as F

from playbill.sources import importer, ingest
from tests.factory import listings


def feed(key, n, ord_, fail=None, walk=None):
    def read(spark):
        if fail and fail():
            raise TimeoutError("secret detail of the network")
        return listings(spark, [dict(id=f"{key}{i}", title=f"Rock konsert {i}", start_date="2026-09-10", ingest_ord=i) for i in range(n)])

    return importer.Feed(key, key.title(), ord_, read, walk)


def test_a_failing_source_keeps_its_last_version(spark, tmp_path):
    root, broken = str(tmp_path), {"on": False}
    feeds = [feed("a", 3, 0), feed("b", 2, 1, lambda: broken["on"]), feed("c", 0, 2)]
    first = importer.run_import(spark, root, feeds).collect()
    assert [(r.source, r.status, r.imported) for r in first] == [("a", "OK", 3), ("b", "OK", 2), ("c", "OK", 0)]
    assert sorted(r.id for r in importer.catalogue(spark, root).collect()) == ["a0", "a1", "a2", "b0", "b1"]
    broken["on"] = True
    rows = {r.source: r for r in importer.run_import(spark, root, [feed("a", 4, 0), *feeds[1:]]).collect()}
    assert (rows["b"].status, rows["b"].imported, rows["a"].imported) == ("Fel", 0, 4) and "secret" not in rows["b"].comment and rows["b"].comment
    assert importer.catalogue(spark, root).count() == 6 and importer.failed(spark, root) == ["b"]
    assert importer.catalogue(spark, root, version=1).count() == 5
    broken["on"] = False
    again = {r.source: r for r in importer.run_import(spark, root, [feed("a", 9, 0), *feeds[1:]], only=importer.failed(spark, root)).collect()}
    assert (again["b"].status, again["b"].comment, again["a"].imported) == ("OK", "", 4) and importer.failed(spark, root) == []


def test_a_source_that_never_worked_is_a_status_row(spark, tmp_path):
    rows = importer.run_import(spark, str(tmp_path), [feed("a", 1, 0), feed("b", 2, 1, lambda: True)]).collect()
    assert [(r.source, r.status) for r in rows] == [("a", "OK"), ("b", "Fel")]
    assert importer.catalogue(spark, str(tmp_path)).count() == 1
    assert importer.catalogue(spark, str(tmp_path / "nothing")).count() == 0


def test_switched_groups_and_page_walks(spark, tmp_path):
    walk = lambda spark: spark.createDataFrame([("A", 1, 0, 3, 9, False), ("A", 1, 1, 3, 9, True)], "source string, run int, page int, total_pages int, total_elements int, failed boolean")
    rows = importer.run_import(spark, str(tmp_path), [feed("a", 2, 0, walk=walk), feed("b", 2, 1)], enabled=["a", "unknown"]).collect()
    assert [(r.source, r.status, r.pages_fetched, r.total_pages, r.truncated) for r in rows] == [("a", "Delvis", 1, 3, True)]


def test_listings_are_tagged_and_ordered_by_source(spark, tmp_path):
    importer.run_import(spark, str(tmp_path), [feed("b", 2, 1), feed("a", 2, 0)])
    rows = importer.catalogue(spark, str(tmp_path)).orderBy("ingest_ord").collect()
    assert [r.id for r in rows] == ["a0", "a1", "b0", "b1"] and all("Konsert" in r.tags for r in rows)


def test_ordinals_that_do_not_fit_are_errors(spark):
    ok = spark.range(3).select(ingest.source_ordinal(F.lit(255), F.col("id")).alias("o")).collect()
    assert len({r.o for r in ok}) == 3 and min(r.o for r in ok) > 0
    for source, row in ((256, 0), (0, 1 << ingest.ROW_BITS), (-1, 0)):
        with pytest.raises(Exception, match="ordinal out of range"):
            spark.range(1).select(ingest.source_ordinal(F.lit(source), F.lit(row))).collect()


def test_pages_are_numbered_in_two_levels(spark):
    rows = [(f"s{i % 3}", f"https://a.se/{i:04d}", None if i % 5 else i) for i in range(700)] + [("s0", "https://a.se/0000", 0)] * 5 + [(None, "https://b.se/", None)]
    pages = spark.createDataFrame(rows, "source_key string, url string, fetched_at int")
    got = {(r.source_key, r.url, r.fetched_at): r.page for r in ingest.page_ranks(pages, "source_key").collect()}
    for key in {r[0] for r in rows}:
        want = sorted({r for r in rows if r[0] == key}, key=lambda r: (r[1], -1 if r[2] is None else r[2]))
        assert [got[r] for r in want] == list(range(len(want)))
    alone = ingest.page_ranks(pages.drop("source_key")).collect()
    assert sorted(r.page for r in alone) == list(range(len({r[1:] for r in rows})))
