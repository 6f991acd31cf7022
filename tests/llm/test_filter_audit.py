"""The filter audit against plain loops over documents, orders and steps."""

import itertools
import re
from collections import defaultdict

from playbill.llm import filter_audit

SCHEMA = "doc_id bigint, text string, lang string, source string, mask int, n int, part string, digest int, cells int, first int"
LABELS = "doc_id bigint, quality int, toxic int, part string"
NAMES = "ABCDE"


def plain(docs, labels):
    """docs: (doc_id, text, source); labels: (doc_id, quality, toxic)"""
    good, toxic = ({i for i, *v in labels if i is not None and v[k] == 1} for k in (0, 1))
    fails = []
    for doc_id, text, source in docs:
        text = text or ""
        words = re.findall(r"[^\x20\x09-\x0D]+", text)
        twin = doc_id is not None and any(i is not None and i < doc_id and (t or "") == text for i, t, _ in docs)
        fails.append((source or "", doc_id, {
            "A": len(words) < 50, "B": 100 * len(set(words)) < 65 * len(words), "C": 100 * len(re.findall("[A-Z]", text)) > 5 * len(text),
            "D": bool(re.search("[#$%&*|]", text)), "E": twin,
        }))
    out, shares = {}, defaultdict(int)
    for part in {p for p, *_ in fails}:
        for order in itertools.permutations(NAMES):
            alive = [f for f in fails if f[0] == part]
            gone = []
            for step, name in enumerate(order):
                here = [f for f in alive if f[2][name]]
                alive = [f for f in alive if not f[2][name]]
                only = [f for f in fails if f[0] == part and f[2][name] and sum(f[2].values()) == 1]
                out[part, "".join(order), step + 1] = (len(alive), len(here), sum(f[2][name] for f in gone), len(only), sum(f[1] in good for f in here), sum(f[1] in toxic for f in here))
                shares[part, name] += len(here)
                gone += here
    return {k: (*v, shares[k[0], k[1][k[2] - 1]]) for k, v in out.items()}


def result(frame):
    return {(r["part"], r["filter_order"], r["step"]): tuple(r[c] for c in (*filter_audit.COUNTS, "shapley")) for r in frame.collect()}


def made(spark, rows):
    return spark.createDataFrame([(i, t, None, s, 1, 2, "x", 4, 5, 6) for i, t, s in rows], SCHEMA)


def test_orders_steps_and_odd_rows(spark):
    many = " ".join(f"word{i}" for i in range(60))
    rows = [
        (1, many, "a"), (2, many, "b"), (2, many, "b"), (3, many, "a"), (None, many, "a"), (None, many, None), (4, None, None), (5, "", ""), (6, "  \n", "a"), (7, many.upper(), "a"),
        (8, many + " # x", "b"), (9, "same " * 80, "b"), (10, "SAME $ " * 9, "b"), (11, "SAME $ " * 9, "a"), (3, "another text of id three", "a"), (12, "ÉÀ \U0001f600 " * 30, "b"), (0, "SAME $ " * 9, "c"),
        (13, "long text & " * 20_000, "c"),
    ]
    labels = [(1, 1, 0), (2, 0, 1), (2, 1, None), (None, 1, 1), (7, 1, 1), (10, None, 1), (99, 1, 1), (11, 1, 0)]
    frame = filter_audit.audit(made(spark, rows), spark.createDataFrame([(*x, "p") for x in labels], LABELS))
    want = plain(rows, labels)
    assert len(want) == 600 * 4 and result(frame) == want
    assert frame.count() == len(want)


def test_empty_tables(spark):
    none = spark.createDataFrame([], LABELS)
    assert filter_audit.audit(made(spark, []), none).collect() == []
    alone = result(filter_audit.audit(made(spark, [(1, "x", "a")]), none))
    assert alone["a", "ABCDE", 1] == (0, 1, 0, 1, 0, 0, 120) and alone["a", "BACDE", 1] == (1, 0, 0, 0, 0, 0, 0)


def test_fewer_filters(spark):
    rows = [(1, "one # two", "a"), (2, "one two", "a"), (3, "one two", "a")]
    frame = filter_audit.audit(made(spark, rows), spark.createDataFrame([(2, 1, 0, "p")], LABELS), (("D", "has_symbol"),))
    assert result(frame) == {("a", "DE", 1): (2, 1, 0, 1, 0, 0, 2), ("a", "DE", 2): (1, 1, 0, 1, 0, 0, 2), ("a", "ED", 1): (2, 1, 0, 1, 0, 0, 2), ("a", "ED", 2): (1, 1, 0, 1, 0, 0, 2)}


def test_a_text_that_most_rows_share_stays_narrow(spark):
    rows = spark.range(4000).selectExpr("id AS doc_id", "if(id % 3 > 0, 'copy', concat('t', id)) AS text", "'a' AS source")
    got = result(filter_audit.audit(rows, spark.createDataFrame([], LABELS)))
    copies = sum(i % 3 > 0 for i in range(4000))
    assert got["a", "EABCD", 1][:2] == (4000 - copies + 1, copies - 1) and got["a", "EABCD", 2][:3] == (0, 4000 - copies + 1, copies - 1)
