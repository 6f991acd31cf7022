"""Spelling variants against plain loops: words, near words, forms and roots."""

import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from playbill.llm import spelling

DATA = "/root/testdata/sf0.001"
SCHEMA = "doc_id bigint, text string, lang string, source string, word int, n int, root int, form int, shard int, v int"
LOW = str.maketrans(spelling.UPPER, spelling.LOWER)


def plain_words(rows):
    counts = Counter()
    for doc_id, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            low = run.translate(LOW)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{low}".encode())
            counts[low[: h % len(low)] + low[h % len(low) + 1 :] if h % 199 == 0 else low] += 1
    return {w: n for w, n in counts.items() if n >= 5 and len(w) >= 6}


def plain_near(words):
    """Near words by the keys of one left-out letter, letters compared one by one."""
    keys = {}
    for w in words:
        for i in range(len(w)):
            keys.setdefault((len(w), i, w[:i], w[i + 1 :]), []).append(w)
    near = {w: set() for w in words}
    for group in keys.values():
        for a in group:
            near[a].update(b for b in group if b != a)
    for w in words:
        for i in range(len(w)):
            short = w[:i] + w[i + 1 :]
            if short in near:
                near[w].add(short)
                near[short].add(w)
    return near


def plain_variants(rows):
    words = plain_words(rows)
    near, form = plain_near(words), {}
    for w, others in near.items():
        best = min(others, key=lambda o: (-words[o], o), default=None)
        form[w] = best if best is not None and words[best] >= 5 * words[w] else None
    out = {}
    for w in words:
        root = w
        while form[root] is not None:
            root = form[root]
        out[w] = (form[w], root, words[w], len(near[w]), None if form[w] is None else words[form[w]])
    return out


def result(frame):
    got = [(r["word"], (r["form"], r["root"], r["n"], r["n_near"], r["form_n"])) for r in frame.collect()]
    assert len(got) == len(dict(got))
    return dict(got)


def made(spark, rows):
    return spark.createDataFrame([(i, t, None, "a", 1, 2, 3, 4, 5, 6) for i, t in rows], SCHEMA)


def test_all_documents(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    want = plain_variants([(r["doc_id"], r["text"]) for r in docs.collect()])
    assert len(want) > 800 and any(v[0] for v in want.values())
    assert result(spelling.variants(docs)) == want


def test_odd_rows_chains_ties_and_small_shards(spark):
    rng = random.Random(3)
    base = ["abcdef", "élèvesç", "straßenß", "ÀÉÎÕÜÿ", "mississippi", "aaaaaaaa", "Kanaltunnel", "abcdefg", "bcdefg×÷"]
    letters = "abcdefgéüsßx÷"
    rows = []
    for i in range(60):
        out = []
        for w in base:
            v = list(w)
            for _ in range(rng.choice([0, 0, 1, 1, 2])):
                at = rng.randrange(len(v))
                rng.choice([lambda: v.insert(at, rng.choice(letters)), lambda: v.__setitem__(at, rng.choice(letters)), lambda: len(v) > 6 and v.pop(at)])()
            out += ["".join(v)] * rng.choice([1, 5, 6, 30, 31, 160, 900])
        rows.append((rng.choice([None, i, 7]), rng.choice([" ", "-", "1"]).join(out)))
    rows += [rows[0], (99, None), (100, ""), (101, "short 123 é"), (102, "Longword " * 20_000)]
    want = plain_variants(rows)
    assert any(v[1] not in (k, v[0]) for k, v in want.items())  # a chain of two forms or more
    for groups, size in ((10, 2000), (4, 5), (10, 1)):
        assert result(spelling.variants(made(spark, rows), groups, size)) == want
    assert spelling.variants(made(spark, rows[:1]).limit(0)).collect() == []


def test_the_walk_of_the_trie_loses_no_vector():
    rng = np.random.default_rng(1)
    homes, queries = rng.integers(0, 3, (400, 6)), rng.integers(0, 3, (300, 6))
    change = queries[:, None, :] - homes[None]
    want = set(zip(*map(np.ndarray.tolist, np.nonzero((np.maximum(change, 0).sum(axis=2) <= 1) & (np.maximum(-change, 0).sum(axis=2) <= 1)))))
    for leaf in (1, 8, 1000):
        got = list(zip(*(x.tolist() for x in spelling.search(homes, queries, leaf))))
        assert len(got) == len(set(got)) and set(got) == want


def test_one_edit():
    assert spelling.one_edit("abc", "abd") and spelling.one_edit("abc", "abcd") and spelling.one_edit("bc", "abc") and spelling.one_edit("aab", "ab")
    assert not spelling.one_edit("abc", "acb") and not spelling.one_edit("abc", "abcde") and not spelling.one_edit("abcd", "bcda")


def test_hub_word_and_shards_are_cut(spark):
    """One frequent word with hundreds of variants, all letters of which fall into few shards."""
    variants = {("hubword" * 3)[:i] + c + ("hubword" * 3)[i:] for i in range(21) for c in "abcdefghijklmn"}
    rows = [(i, f"{w} " * 5) for i, w in enumerate(sorted(variants))] + [(10_000 + i, "hubwordhubwordhubword " * 500) for i in range(4)]
    docs = made(spark, rows)
    got = result(spelling.variants(docs, 10, 20))
    assert got == plain_variants(rows) and got["hubwordhubwordhubword"][3] > 200
    vocabulary = spelling.words(docs)
    letters = spelling.letter_groups(vocabulary)
    dealt = spelling.in_slots(spelling.shards(vocabulary, letters, 3), ["shard"], "word", 20)
    assert max(r["count"] for r in dealt.groupBy("shard", "slot", "part").count().collect()) <= 100


@pytest.mark.parametrize("run", ["ÀB", "abC", "ß÷×Ÿ", "ZéÉ"])
def test_only_ascii_letters_are_lowered(spark, run):
    assert spark.range(1).select(spelling.lowered(F.lit(run))).first()[0] == run.translate(LOW)
