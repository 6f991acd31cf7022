"""Online packing: every id in one place, the sum-of-squares choice against a plain search, little padding."""

import zlib
from collections import defaultdict

import numpy as np
import pytest

from playbill.llm import online_packing, packing

DATA = "/root/testdata/sf0.01"
SCHEMA = "doc_id bigint, text string, lang string, source string, start int, length int, ids int, sequence_id int"


def tokenizer():
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(packing.paths()[0])
    t.encode_special_tokens = True
    return t


def check_places(pieces, size=1024):
    """Gapless windows that are never too long; returns their lengths."""
    windows = defaultdict(list)
    for p in pieces:
        windows[p["sequence_id"]].append((p["offset"], p["length"]))
    sizes = []
    for parts in windows.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at and length > 0
            at += length
        assert at <= size
        sizes.append(at)
    return sizes


def check_documents(pieces, want):
    """want: (doc_id, ids) of every row; each id lies in exactly one piece."""
    by_doc, ids_of = defaultdict(list), defaultdict(list)
    for p in pieces:
        by_doc[p["doc_id"]].append((p["start"], p["length"], p["ids_crc32"], p["doc_tokens"]))
    for doc_id, ids in want:
        ids_of[doc_id].append(ids)
    assert set(by_doc) == set(ids_of)
    for doc_id, texts in ids_of.items():
        assert sum(x[1] for x in by_doc[doc_id]) == sum(map(len, texts))
        if len(texts) == 1:
            at = 0
            for start, length, crc, tokens in sorted(by_doc[doc_id]):
                assert start == at and tokens == len(texts[0])
                assert crc == zlib.crc32(np.array(texts[0][start : start + length], "<u4").tobytes())
                at += length


def test_all_documents_against_the_tokenizer(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "text").repartition(3)
    rows = docs.collect()
    encoded = tokenizer().encode_batch([r["text"] or "" for r in rows], add_special_tokens=False)
    got = online_packing.pack_online(docs).collect()
    check_documents(got, [(r["doc_id"], [*e.ids, 0]) for r, e in zip(rows, encoded)])
    sizes = check_places(got)
    assert sum(map(online_packing.padding, sizes)) == 0
    assert sum(s < 1024 for s in sizes) <= 3 * 10  # binary digits of what each stream leaves over
    again = {(r["doc_id"], r["start"]): r["ids_crc32"] for r in online_packing.pack_online(docs, with_ids=True).collect()}
    assert len(again) == len(got)


def test_odd_rows_and_empty_tables(spark):
    long = "the quick brown fox " * 30_000
    rows = [(1, "one two"), (1, "one two"), (2, None), (3, ""), (None, "no id"), (None, None), (4, long), (5, "\U0001f600 é \n\n  x\t"), (5, "other text of id five")]
    docs = spark.createDataFrame([(i, t, None, "a", 1, 2, 3, 4) for i, t in rows], SCHEMA)
    got = online_packing.pack_online(docs, with_ids=True).collect()
    t = tokenizer()
    check_documents(got, [(i, [*t.encode(x or "", add_special_tokens=False).ids, 0]) for i, x in rows])
    check_places(got)
    assert all(zlib.crc32(np.array(r["ids"], "<u4").tobytes()) == r["ids_crc32"] for r in got)
    assert online_packing.pack_online(docs.limit(0)).collect() == []
    with pytest.raises(ValueError):
        online_packing.pack_online(docs, 1000)


def plain_choice(counts, n, size, cut):
    """Tries every move and squares all counts anew."""
    def squares(changes):
        now = counts.copy()
        for fill, change in changes:
            if 0 < fill < size:
                now[fill] += change
        return sum(int(c) ** 2 for c in now)

    whole = [(squares([(f, -1), (f + n, 1)]), -f, False) for f in range(size - n + 1) if f == 0 or counts[f]]
    parted = [(squares([(f, -1), (f + n - size, 1)]) + cut, -f, True) for f in range(size - n + 1, size) if counts[f]]
    least = min(whole)
    if parted and min(parted)[0] < least[0]:
        least = min(parted)
    return -least[1], least[2]


def test_each_choice_has_the_least_sum_of_squares():
    rng = np.random.default_rng(5)
    for draw in (lambda: int(rng.integers(1, 64)), lambda: int(rng.choice([20, 21, 33, 40])), lambda: 40):
        stream = online_packing.Stream(64, 6)
        for i in range(400):
            n = draw()
            assert stream.best(n) == plain_choice(stream.level, n, 64, 6)
            stream.add(i, np.full(n, i, "<u4").tobytes())
            assert [len(w) for w in stream.open] == [int(c) for c in stream.level[:64]]
        assert max(stream.level) <= 8


def test_open_windows_stay_few_where_nothing_fits():
    for length in (600, 1023, 513, 342):
        stream = online_packing.Stream()
        for i in range(20_000):
            stream.add(i, bytes(4 * length))
        assert sum(map(int, stream.level)) < 600
        stream.finish()
        sizes = [sum(len(p[2]) // 4 for p in w) for w in stream.taken()]
        assert sum(sizes) == 20_000 * length and sum(map(online_packing.padding, sizes)) == 0 and len(sizes) <= 20_000 * length // 1024 + 10


def test_few_documents_are_cut():
    rng = np.random.default_rng(7)
    stream, pieces = online_packing.Stream(), 0
    lengths = rng.integers(1, 1024, 60_000)
    for i, n in enumerate(lengths):
        stream.add(i, bytes(4 * int(n)))
    pieces = sum(map(len, stream.done)) + sum(len(w) for f in stream.open for w in f)
    assert pieces < 1.1 * len(lengths) and sum(map(int, stream.level)) < 3_000
    assert all(sum(len(p[2]) // 4 for p in w) == 1024 for w in stream.done)
