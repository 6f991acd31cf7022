"""Texts with very many matches, and rows of one id that are not copies of each other."""

import random
import re
import time

from pyspark.sql import functions as F

from playbill.llm import pii, secrets, simhash
from playbill.llm.common import running, spans

MAIL = r"[a-z]+@[a-z]+\.com"


def test_spans_with_context_against_a_plain_search(spark):
    rng = random.Random(2)
    texts = ["".join(rng.choice(["x@b.com", " ", "é", "\U0001f600", "yy@c.com,", "words before ", "\n"]) for _ in range(n)) for n in (0, 1, 2, 3, 7, 40, 400)]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, text string").select("i", spans(F.col("text"), MAIL, 8).alias("s")).collect()
    for r in rows:
        text, at, want = texts[r["i"]], 0, []
        for m in re.finditer(MAIL, text):
            want.append((m.start(), m.end(), m.group(), text[at : m.start()][-8:], text[m.end() : m.end() + 1]))
            at = m.start()
        assert [tuple(x)[:3] + tuple(x)[3:4] for x in r["s"]] == [w[:4] for w in want]
        # The character behind a match is not told where the next match begins at once.
        assert all(x["after"] in (w[4], "") for x, w in zip(r["s"], want))


def test_running_values(spark):
    for n in range(9):
        values = [5, 3, 9, 1, 9, 2, 4, 8][:n]
        row = spark.createDataFrame([(values,)], "v array<bigint>").select(running(F.col("v")), running(F.col("v"), F.greatest)).first()
        assert row[0] == [sum(values[: i + 1]) for i in range(n)] and row[1] == [max(values[: i + 1]) for i in range(n)]


def _seconds(spark, n):
    text = "".join(f"word x{'y' * (i % 7)}@b.com " for i in range(n))
    frame = spark.createDataFrame([(text,)], "text string").select(F.size(spans(F.col("text"), MAIL)).alias("n"))
    best = 1e9
    for _ in range(3):
        start = time.time()
        assert frame.first()["n"] == n
        best = min(best, time.time() - start)
    return best


def test_twice_the_matches_take_about_twice_the_time(spark):
    _seconds(spark, 1_000)
    assert _seconds(spark, 64_000) <= 2.5 * _seconds(spark, 32_000) + 0.3


def test_a_log_like_text_does_not_hold_up_the_scans(spark):
    text = " ".join(f"user{i}@mail.example.com 10.0.0.{i % 256} 415-555-{i % 10000:04d} token=abcdef{i:06d}" for i in range(16_000))
    docs = spark.createDataFrame([(1, text)], "doc_id bigint, text string")
    start = time.time()
    row = pii.report(docs).first()
    assert (row["n_email"], row["n_ip"]) == (16_000, 16_000)
    assert secrets.report(docs).first()["n_assign"] == 16_000
    assert secrets.redact(docs).first()["text"] == re.sub("token=[a-z0-9]+", "<assign>", text)
    assert time.time() - start < 60


def test_redaction_joins_overlapping_spans(spark):
    hex_, long = "0123456789abcdef" * 2, "z " * 5_000
    texts = [f"token={hex_} end", f"é {hex_}", long + f"\U0001f600 password: {hex_}x tail " + long, "token=abcdefgh", f"AKIA{'A' * 16}token=abcdefg{hex_}", "none"]
    got = {r["doc_id"]: r["text"] for r in secrets.redact(spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")).collect()}
    assert got == {0: "<assign> end", 1: "é <hex>", 2: long + "\U0001f600 <assign> tail " + long, 3: "<assign>", 4: "<access><assign>", 5: "none"}


def test_added_spans_overlap_no_base_span(spark):
    rng = random.Random(6)
    kinds = list(pii.PATTERNS)
    rows, want = [], set()
    for i in range(60):
        found = {(rng.choice(kinds), rng.randrange(40)): rng.randint(1, 9) for _ in range(rng.randrange(12))}
        spans_ = [(k, s, s + n) for (k, s), n in found.items()]
        rows += [(str(i), i, kinds.index(k), s, e, k) for k, s, e in spans_]
        base = [(s, e) for k, s, e in spans_ if k in pii.BASE]
        want |= {(str(i), k, s, e) for k, s, e in spans_ if k not in pii.BASE and not any(b < e and s < c for b, c in base)}
    frame = spark.createDataFrame(rows + rows[:50], "_id string, _k bigint, ord int, start bigint, end bigint, kind string")
    got = [(r["_id"], c["kind"], c["start"], c["end"]) for r in pii.unopposed(frame, F.lit(True)).collect() for c in r["chosen"]]
    assert len(got) == len(want) and set(got) == want


def test_unrelated_texts_of_one_id_both_stay(spark):
    words = [" ".join(f"{c}{i}" for i in range(60)) for c in "abc"]
    docs = spark.createDataFrame([(6, words[0], 1), (6, words[1], 1), (7, words[2], 1)], "doc_id bigint, text string, root int")
    assert {r["text"] for r in simhash.keep_one(docs).collect()} == set(words)


def test_near_copies_without_ids_leave_one(spark):
    text = " ".join(f"word{i} of{i} text{i}" for i in range(400))
    near = [text, text + " more", text + " end"]
    fps = [simhash.fingerprint(t) for t in near]
    assert len(set(fps)) > 1
    docs = spark.createDataFrame([(None, t) for t in near + near] + [(None, "another text altogether " * 3)], "doc_id bigint, text string")
    assert len({r["text"] for r in simhash.keep_one(docs).collect()}) == simhash.keep_one(docs).count() == 2
    with_id = docs.unionByName(spark.createDataFrame([(5, near[1])], docs.schema))
    assert {r["doc_id"] for r in simhash.keep_one(with_id).collect()} == {5, None}
