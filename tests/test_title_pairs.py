"""The linear title join: no pair lost, work in proportion to the titles; components."""

import random

import pytest

from playbill.functions.similarity import title_match
from playbill.operators import title_pairs
from playbill.operators.components import components


def words_of(rnd, n):
    return ["".join(rnd.choice("bcdfghklmnprstv") + rnd.choice("aeiouy") for _ in range(rnd.randint(2, 4))) for _ in range(n)]


def typos(rnd, t, n):
    for _ in range(n):
        i = rnd.randrange(len(t))
        t = rnd.choice([t[:i] + t[i + 1 :], t[:i] + rnd.choice("aeinrst ") + t[i:], t[:i] + rnd.choice("aeinrst") + t[i + 1 :]])
    return " ".join(t.split())


def made(seed, n, per_title=5, vocabulary=400):
    """Titles of words of a vocabulary, a tenth of them near copies of others."""
    rnd = random.Random(seed)
    known = words_of(rnd, vocabulary)
    titles = {" ".join(rnd.choice(known) for _ in range(per_title)) for _ in range(n)}
    for t in sorted(titles)[: n // 10]:
        titles.add(typos(rnd, t, rnd.randint(1, 4)))
    return sorted(titles - {""})


def plain(titles, floor=0.92):
    return {(a, b) for a in titles for b in titles if title_match(a, b, floor) >= floor}


def frame(spark, titles):
    return spark.createDataFrame([(t,) for t in titles], "t string")


@pytest.mark.parametrize(("per_title", "vocabulary"), [(2, 12), (4, 25), (5, 60), (8, 40), (12, 60), (15, 25)])
def test_no_pair_is_lost(spark, per_title, vocabulary):
    titles = made(per_title, 150, per_title, vocabulary)
    rnd = random.Random(per_title)
    for t in titles[:40]:
        parts = t.split()
        rnd.shuffle(parts)
        titles += [" ".join(parts), " ".join(t.split()[:-1]), t + " med " + titles[3]]
        titles.append(typos(rnd, t, max(1, len(t) // 14)))
    titles = sorted({t for t in titles if t})
    got = [(r.first, r.second) for r in title_pairs.similar_titles(frame(spark, titles)).collect()]
    assert len(got) == len(set(got)) and set(got) == plain(titles)


def test_hot_keys_in_tiles_lose_nothing(spark):
    rnd = random.Random(9)
    titles = sorted({"stand up comedy med kvallens " + typos(rnd, "gast", rnd.randint(0, 3)) for _ in range(60)} | {"stand up comedy"})
    assert {(r.first, r.second) for r in title_pairs.similar_titles(frame(spark, titles), hot=20).collect()} == plain(titles)


def test_candidates_grow_with_the_titles(spark):
    counts = []
    for n in (2_000, 20_000):
        titles = made(1, n, 5, 3_000)
        pairs, common = title_pairs.candidates(frame(spark, titles).selectExpr("xxhash64(t) AS h", "t"))
        counts.append(pairs.count() + common.count())
    assert counts[0] > 100 and counts[1] <= 15 * counts[0]


def test_budgets_cannot_all_be_exceeded():
    for n in range(1, 200):
        lo, hi = title_pairs.band(n, 0.92)
        parts = title_pairs.parts(lo, hi, 0.92)
        assert sum(b + 1 for *_, b in parts) > title_pairs.edits(hi, 0.92) and sum(size for _, _, size, _ in parts) <= lo
    assert title_pairs.without("aab", 1) == {"ab", "aa"} and title_pairs.edits(30, 0.92) == 5


def test_components(spark):
    chain = [(f"n{i:03d}", f"n{i + 1:03d}") for i in range(100)] + [("x", "y"), ("z", "y"), ("q", "q")]
    got = {r["node"]: r["root"] for r in components(spark.createDataFrame(chain, "a string, b string")).collect()}
    assert got == {**{f"n{i:03d}": "n000" for i in range(101)}, "x": "x", "y": "x", "z": "x"}
    rnd = random.Random(3)
    edges = [(rnd.randrange(80), rnd.randrange(80)) for _ in range(60)]
    root = {n: n for e in edges for n in e}
    for _ in range(80):
        for a, b in edges:
            root[a] = root[b] = min(root[a], root[b])
    got = {r["node"]: r["root"] for r in components(spark.createDataFrame(edges, "a int, b int")).collect()}
    assert got == {n: r for n, r in root.items() if any(n in e and e[0] != e[1] for e in edges)}
    assert components(spark.createDataFrame([], "a int, b int")).collect() == []
