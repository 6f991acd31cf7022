"""Models against plain loops, hot keys, and recall where the corpus asks for more hashes."""

import random

import numpy as np
import zstandard
from pyspark.sql import functions as F

from playbill.llm import embeddings, langid, mixing, quality
from playbill.llm.common import semi_join

DATA = "/root/testdata/sf0.01"


def test_language_against_plain_compression(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    model = langid.fit(docs, docs_share := (F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 != 2))
    got = langid.identify(docs, model).filter(~docs_share).collect()
    right = 0
    for r in got[:150]:
        low = "".join(c if c.isalpha() or not c.isascii() else " " for c in r["text"].lower())
        data = " ".join(low.encode().decode().split(" ")).encode()
        data = b" ".join(data.split())
        sizes = []
        for raw in model.dictionaries:
            params = zstandard.ZstdCompressionParameters.from_level(12, dict_size=len(raw), source_size=1536, write_content_size=False, write_checksum=False, write_dict_id=False, format=zstandard.FORMAT_ZSTD1_MAGICLESS)
            pack = zstandard.ZstdCompressor(dict_data=zstandard.ZstdCompressionDict(raw, dict_type=zstandard.DICT_TYPE_RAWCONTENT), compression_params=params)
            sizes.append(sum(len(pack.compress(data[i : i + 1536])) for i in range(0, len(data), 1536)))
        right += model.languages[int(np.argmin(sizes))] == r["lang_pred"]
    assert right >= 148  # a compressor whose dictionary is not laid out beforehand may save a byte here and there


def test_a_long_body_outweighs_a_short_quotation_of_many_words(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    model = langid.fit(docs)
    texts = {lang: [r["text"] for r in docs.filter((F.col("lang") == lang) & (F.length("text") > 1500)).limit(30).collect()] for lang in model.languages}
    for body in texts:
        for other in texts:
            if body != other:
                words = list(dict.fromkeys(w for t in texts[other] for w in t.split()))[:780]
                long = " ".join((texts[body][0].split() * 60)[:3200])
                short = " ".join(texts[body][0].split()[:200])
                assert langid.classify(f"{long} {' '.join(words)}", model)[0] == body
                assert langid.classify(f"{short} {' '.join(words * 3)}", model)[0] == other
    score = lambda n: langid.classify(" ".join((texts["en"][0].split() * 60)[:n]) + " " + " ".join(texts["de"][0].split()[:80]), model)[1]
    assert score(3200) > score(400)


def test_language_training_collects_passages_only(spark):
    docs = spark.createDataFrame([(i, "wort " * 50_000 if i % 2 else "word" * 50_000, "de" if i % 2 else "en") for i in range(6)], "doc_id bigint, text string, lang string")
    model = langid.fit(docs)
    assert model.languages == ("de", "en") and max(map(len, model.dictionaries)) <= langid.DICTIONARY_BYTES


def test_quality_network_against_plain_loops():
    rng = np.random.default_rng(1)
    net = {"embed": rng.normal(size=(257, quality.EMBED)), "filters": rng.normal(size=(quality.WIDTH * quality.EMBED, 5)), "shift": rng.normal(size=5), "out": rng.normal(size=5), "bias": np.array(0.3)}
    net["embed"][quality.PAD] = 0
    for text in ("", "short", "é" * 300, "a b " * 700):
        data, logits, at = text.encode(), [], 0
        while True:  # chunks from every step on, until all is covered
            chunk = [*data[at : at + quality.CHUNK]]
            chunk += [quality.PAD] * (quality.CHUNK - len(chunk))
            answers = []
            for f in range(5):
                best = max(
                    sum(net["embed"][chunk[p + w]][e] * net["filters"][w * quality.EMBED + e][f] for w in range(quality.WIDTH) for e in range(quality.EMBED))
                    for p in range(0, quality.CHUNK - quality.WIDTH + 1, quality.STRIDE)
                )
                answers.append(max(best + net["shift"][f], 0))
            logits.append(sum(a * o for a, o in zip(answers, net["out"])) + net["bias"])
            if at + quality.CHUNK >= len(data):
                break
            at += quality.CHUNK - quality.OVERLAP
        assert abs(quality.score_text(text, net) - 1 / (1 + np.exp(-np.mean(logits)))) < 1e-9


def test_quality_training_takes_one_text_an_id(spark):
    docs = spark.createDataFrame([(1, f"good text number {i} of one id") for i in range(300)] + [(2, "## bad ##"), (2, "## worse ##")], "doc_id bigint, text string")
    labels = spark.createDataFrame([(1, 1), (2, 0)], "doc_id bigint, quality int")
    net = quality.fit(docs, labels)
    assert quality.score_text("good text number 5 of one id", net) > quality.score_text("## bad ##", net)


def test_rows_without_id_draw_apart(spark):
    rows = mixing.measured(spark.range(5000).select(F.lit(None).cast("bigint").alias("doc_id"), F.concat(F.lit("text "), "id").alias("text"), F.lit("a").alias("source")))
    assert rows.select("key").distinct().count() == 5000
    assert max(r["count"] for r in rows.groupBy(mixing.bucket_of(F.col("key")).alias("b")).count().collect()) < 20


def test_hot_keys_are_not_shuffled(spark):
    rng = random.Random(3)
    rows = [(0 if rng.random() < 0.4 else rng.randrange(3000), i) for i in range(20_000)]
    stored = spark.createDataFrame(rows, "g int, i int")
    keys = stored.groupBy("g").agg(F.count("*").alias("n")).filter("g % 3 = 0")
    frame = semi_join(stored, keys, ["g"])
    assert {(r["g"], r["i"]) for r in frame.collect()} == {r for r in rows if r[0] % 3 == 0} and frame.count() == sum(r[0] % 3 == 0 for r in rows)


def test_recall_with_more_hashes(spark):
    rng = np.random.default_rng(5)
    for dim, expected in ((64, 10**6), (64, 10**7), (64, 10**10), (768, 10**9)):
        a = rng.normal(size=(250, dim))
        a /= np.linalg.norm(a, axis=1, keepdims=True)
        z = rng.normal(size=a.shape)
        z -= (z * a).sum(axis=1, keepdims=True) * a
        z /= np.linalg.norm(z, axis=1, keepdims=True)
        x = np.concatenate([a, 0.9502 * a + np.sqrt(1 - 0.9502**2) * z])
        x /= np.linalg.norm(x, axis=1, keepdims=True)
        true = int((np.triu(x @ x.T, 1) >= 0.95).sum())
        table = spark.createDataFrame([(i, v) for i, v in enumerate(x.tolist())], "vec_id bigint, embedding array<double>")
        assert embeddings.hashes_for(expected, dim) == {(64, 10**6): 2, (64, 10**7): 3, (64, 10**10): 4, (768, 10**9): 3}[dim, expected]
        links = sum(r["n_links"] for r in embeddings.near_duplicates(table, expected=expected).collect()) / 2
        assert 0.93 * true <= links <= true


def test_repeated_vector_ids(spark):
    v, w = [1.0] * 24, [(-1.0) ** i for i in range(24)]
    rows = [(1, v), (1, v), (1, w), (2, v), (None, w)]
    got = sorted((r["vec_id"] or 0, r["n_links"], r["component_id"], r["kept"]) for r in embeddings.near_duplicates(spark.createDataFrame(rows, "vec_id bigint, embedding array<double>")).collect())
    assert got == [(0, 1, 1, False), (1, 1, 1, True), (1, 2, 1, True), (1, 2, 1, True), (2, 2, 1, False)]
