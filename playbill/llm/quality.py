"""Quality classifier: a byte-level convolutional network in numpy.

A text is read as UTF-8 bytes in overlapping chunks that cover all of it.  Each byte is embedded, a
learned bank of filters slides over the chunk, each filter keeps its largest answer, and a linear
layer turns these into the chunk's logit; the mean of the logits gives one probability.

The network is fitted in the driver on at most `SAMPLE_TEXTS` texts per label, up to `PASSAGES`
chunks each; scoring reads every byte of every text.

Defined cases: null and empty texts are one empty chunk and get its score; labels that are null or
not 0/1 are not learned from; a document with several labels counts for each; without labels of
both kinds every score is the share of label 1, or 0.5; repeated rows get equal scores; an empty
table gives no rows; further columns stay as they are.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from playbill.llm.common import add_columns, hash_sample, map_columns

SAMPLE_TEXTS = 900
PASSAGES = 2
CHUNK, OVERLAP = 1024, 64
EMBED, WIDTH, STRIDE, FILTERS = 6, 8, 2, 40
EPOCHS, BATCH, RATE, DECAY = 8, 64, 0.004, 1e-4
THRESHOLD = 0.3
PAD = 256


def chunks(data: bytes):
    """Rows of byte numbers, `CHUNK` long, each `OVERLAP` bytes into the one before; the last is padded."""
    import numpy as np

    raw = np.frombuffer(data, dtype=np.uint8)
    step = CHUNK - OVERLAP
    n = max(1, -(-(len(raw) - OVERLAP) // step))
    padded = np.full((n - 1) * step + CHUNK, PAD, dtype=np.int16)
    padded[: len(raw)] = raw
    return np.lib.stride_tricks.sliding_window_view(padded, CHUNK)[::step]


def _windows(embedded):
    """(chunks, places, WIDTH * EMBED) of embedded chunks: filters see whole bytes only."""
    import numpy as np

    n, length, e = embedded.shape
    flat = np.ascontiguousarray(embedded).reshape(n, length * e)
    return np.lib.stride_tricks.sliding_window_view(flat, WIDTH * e, axis=1)[:, :: STRIDE * e]


def logits(rows, net: dict):
    import numpy as np

    out = []
    for i in range(0, len(rows), BATCH):
        seen = _windows(net["embed"][rows[i : i + BATCH]])
        n, places, width = seen.shape
        answer = (seen.reshape(n * places, width) @ net["filters"]).reshape(n, places, -1).max(axis=1)
        out.append(np.maximum(answer + net["shift"], 0) @ net["out"] + net["bias"])
    return np.concatenate(out)


def train(rows, labels, seed: int = 7) -> dict:
    """Adam on the logistic loss of single chunks."""
    import numpy as np

    rng = np.random.default_rng(seed)
    f32 = np.float32
    net = {
        "embed": rng.normal(0, 0.5, (PAD + 1, EMBED)).astype(f32), "filters": rng.normal(0, (WIDTH * EMBED) ** -0.5, (WIDTH * EMBED, FILTERS)).astype(f32),
        "shift": np.zeros(FILTERS, f32), "out": rng.normal(0, FILTERS**-0.5, FILTERS).astype(f32), "bias": np.zeros((), f32),
    }
    net["embed"][PAD] = 0
    first, second, step = {k: np.zeros_like(v) for k, v in net.items()}, {k: np.zeros_like(v) for k, v in net.items()}, 0
    weight = np.where(labels == 1, 0.5 / max(1, (labels == 1).sum()), 0.5 / max(1, (labels == 0).sum())) * len(labels)
    for _ in range(EPOCHS):
        for at in np.array_split(rng.permutation(len(rows)), max(1, len(rows) // BATCH)):
            x = rows[at]
            seen = _windows(net["embed"][x])
            n, places, width = seen.shape
            answer = (seen.reshape(n * places, width) @ net["filters"]).reshape(n, places, FILTERS)
            top = answer.argmax(axis=1)
            pooled = np.take_along_axis(answer, top[:, None], axis=1)[:, 0] + net["shift"]
            hidden = np.maximum(pooled, 0)
            chance = 1 / (1 + np.exp(-(hidden @ net["out"] + net["bias"])))
            slip = ((chance - labels[at]) * weight[at] / n).astype(f32)
            back = slip[:, None] * net["out"] * (pooled > 0)
            best = seen[np.arange(n)[:, None], top]  # the window that each filter chose
            grads = {"out": hidden.T @ slip, "bias": slip.sum(), "shift": back.sum(axis=0), "filters": np.einsum("nfw,nf->wf", best, back), "embed": np.zeros_like(net["embed"])}
            spread = (back[:, :, None] * net["filters"].T[None]).reshape(n, FILTERS, WIDTH, EMBED)
            places_of = top[:, :, None] * STRIDE + np.arange(WIDTH)
            np.add.at(grads["embed"], np.take_along_axis(x[:, None, :].repeat(FILTERS, 1), places_of, axis=2), spread)
            grads["embed"][PAD] = 0
            step += 1
            for k in net:
                g = grads[k] + DECAY * net[k]
                first[k] = 0.9 * first[k] + 0.1 * g
                second[k] = 0.999 * second[k] + 0.001 * g * g
                net[k] = (net[k] - RATE * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.999**step)) + 1e-8)).astype(f32)
    return net


def fit(docs: DataFrame, labels: DataFrame, usable: Column | None = None, texts: int = SAMPLE_TEXTS) -> dict | float:
    """The trained network, or a constant where the labels have one kind only; `usable` is asked of doc_id."""
    import numpy as np

    known = labels.filter(F.col("quality").isin(0, 1) & (F.lit(True) if usable is None else usable)).select(F.col("doc_id").alias("_doc"), F.col("quality").cast("int").alias("quality")).distinct()
    # Ids are drawn first, so the sample of `texts` ids a label is what is sent to the documents.
    drawn = hash_sample(known, "quality", F.xxhash64(F.col("_doc").cast("string"), F.lit("quality")), texts)
    picked = docs.select("doc_id", "text").join(F.broadcast(drawn), F.col("doc_id") == F.col("_doc")).groupBy("quality", "_h").agg(F.min_by("text", F.xxhash64("text")).alias("text"))  # one text an id

    def cut_passages(quality, h, text):
        out = [[], [], []]
        for q, x, t in zip(quality, h, text):
            parts = chunks((t or "").encode("utf-8", "surrogatepass"))
            for i in sorted({(x + 7919 * j) % len(parts) for j in range(PASSAGES)}):
                for to, value in zip(out, (q, x, bytes(parts[i][parts[i] != PAD].astype(np.uint8)))):
                    to.append(value)
        return out

    found = sorted(map(tuple, map_columns(picked, cut_passages, "quality int, h bigint, passage binary").collect()))
    y = np.array([q for q, _, _ in found])
    if len(set(y.tolist())) < 2:
        return float(y.mean()) if len(y) else 0.5
    return train(np.concatenate([chunks(bytes(p))[:1] for _, _, p in found]), y)


def score_text(text: str | None, net: dict | float) -> float:
    import numpy as np

    if isinstance(net, float):
        return net
    return float(1 / (1 + np.exp(-np.clip(logits(chunks((text or "").encode("utf-8", "surrogatepass")), net).mean(dtype=np.float64), -60, 60))))


def score(docs: DataFrame, net: dict | float, threshold: float = THRESHOLD) -> DataFrame:
    """Every row of docs with score and predicted."""

    def run(texts):
        scores = [score_text(t, net) for t in texts]
        return [scores, [int(s >= threshold) for s in scores]]

    return add_columns(docs, ["text"], run, "score double, predicted int")
