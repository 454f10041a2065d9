"""Language identification by a byte convolutional network.

Training (numpy, on the driver): a bounded sample of labelled rows, those with
the least hash of doc_id: ``SAMPLE`` documents and ``SAMPLE_BYTES`` of text at
most, each text whole, in windows of ``LENGTH`` bytes; rows of fold 1 or without
a doc_id are never seen, and of rows that share a doc_id the least is learned.
Bytes are embedded, convolved by filters of widths two, three and four, max-pooled over a window of ``LENGTH`` bytes, and classified by
softmax; Adam on the cross-entropy.

Application: every text is cut into windows of ``LENGTH`` bytes that cover all
of it (each begins three bytes before the last one ended, so no filter position
is missed) and windows of many texts are evaluated together. All filters at a
position see a pair of bytes and the pair after it, so the convolution is two
lookups in tables of byte pairs. Log-probabilities of a text's windows are
averaged by their bytes and renormalised.

Defined results: ``und`` with score 0 where the text is null or has no letter;
equal texts have equal results; a null doc_id counts as not held out; with no
labelled row every answer is ``und``; with one label every text with a letter
gets it; an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import fold_of, held_out, sampled, ship

ship(__name__)

LENGTH = 256
SAMPLE = 1600
SAMPLE_BYTES = 4 << 20
WIDTHS = (2, 3, 4)
FILTERS = 8
EMBED = 8
OVERLAP = max(WIDTHS) - 1
BATCH = 512


@dataclass
class Network:
    labels: list[str]
    embedding: np.ndarray  # (256, EMBED)
    taps: np.ndarray  # (4, EMBED, all filters); taps beyond a filter's width stay zero
    bias: np.ndarray
    dense: np.ndarray
    offset: np.ndarray

    def tables(self) -> tuple[np.ndarray, np.ndarray]:
        """Contribution of a byte pair at taps 0-1 and at taps 2-3."""
        t = np.einsum("be,kef->kbf", self.embedding, self.taps)
        pair = lambda a, b: (a[:, None, :] + b[None, :, :]).reshape(65536, -1).astype(np.float32)
        return pair(t[0], t[1]) + self.bias.astype(np.float32), pair(t[2], t[3])


def tap_mask() -> np.ndarray:
    width = np.repeat(WIDTHS, FILTERS)
    return (np.arange(4)[:, None] < width[None, :])[:, None, :].astype(np.float64)


def windows(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Windows that cover the bytes, zero-padded at the end, and how many new bytes each holds."""
    step = LENGTH - OVERLAP
    n = max(1, -(-(len(data) - OVERLAP) // step))
    padded = np.zeros(n * step + OVERLAP, np.uint8)
    padded[: len(data)] = np.frombuffer(data, np.uint8)
    fresh = np.full(n, step)
    fresh[-1] = max(1, len(data) - (n - 1) * step)
    return np.lib.stride_tricks.sliding_window_view(padded, LENGTH)[::step], fresh


def train(texts: list[str], labels: list[str], epochs: int = 6, rate: float = 0.01) -> Network:
    names = sorted(set(labels))
    rng = np.random.default_rng(7)
    x, y = [], []
    for text, label in zip(texts, labels):
        found = windows((text or "").encode("utf-8", "replace"))[0]
        x.append(found)
        y += [names.index(label)] * len(found)
    x, y = np.concatenate(x), np.array(y)
    f, k = FILTERS * len(WIDTHS), len(names)
    mask = tap_mask()
    p = [rng.normal(0, 0.3, (256, EMBED)), rng.normal(0, 0.3, (4, EMBED, f)) * mask, np.zeros(f), rng.normal(0, 0.3, (f, k)), np.zeros(k)]
    m, v, t = [np.zeros_like(q) for q in p], [np.zeros_like(q) for q in p], 0
    weight = len(y) / (k * np.bincount(y, minlength=k))
    for _ in range(epochs):
        order = rng.permutation(len(y))
        for at in range(0, len(order), 64):
            rows = order[at : at + 64]
            e, taps, bias, dense, offset = p
            xb, b = x[rows], len(rows)
            emb = e[xb]  # b, LENGTH, EMBED
            n = LENGTH - OVERLAP
            conv = sum(emb[:, j : j + n] @ taps[j] for j in range(4)) + bias
            best = conv.argmax(1)  # b, f
            top = np.take_along_axis(conv, best[:, None, :], 1)[:, 0]
            pooled = np.maximum(top, 0)
            z = pooled @ dense + offset
            z = np.exp(z - z.max(1, keepdims=True))
            z /= z.sum(1, keepdims=True)
            z[np.arange(b), y[rows]] -= 1
            z *= weight[y[rows]][:, None] / b
            g_pool = (z @ dense.T) * (top > 0)
            g_taps, g_e = np.zeros_like(taps), np.zeros_like(e)
            for j in range(4):
                at_j = np.take_along_axis(xb, best + j, 1)  # the byte under tap j of each filter's best place
                g_taps[j] = np.einsum("bfe,bf->ef", e[at_j], g_pool)
                np.add.at(g_e, at_j, g_pool[:, :, None] * taps[j].T[None])
            grads = [g_e, g_taps * mask, g_pool.sum(0), pooled.T @ z, z.sum(0)]
            t += 1
            for q, g, a, c in zip(p, grads, m, v):
                a += 0.1 * (g - a)
                c += 0.001 * (g * g - c)
                q -= rate * (a / (1 - 0.9**t)) / (np.sqrt(c / (1 - 0.999**t)) + 1e-8)
    return Network(names, *p)


def classify(texts: list[str | None], net: Network, tables: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """Probabilities (texts, labels) from the windows of the whole texts, BATCH windows at a time."""
    first, second = tables
    sums, total = np.zeros((len(texts), len(net.labels))), np.zeros(len(texts))
    held: list[tuple[int, np.ndarray, np.ndarray]] = []

    def flush() -> None:
        if not held:
            return
        x = np.concatenate([w for _, w, _ in held]).astype(np.int32)
        owner = np.repeat([i for i, _, _ in held], [len(w) for _, w, _ in held])
        fresh = np.concatenate([n for _, _, n in held]).astype(float)
        pairs = x[:, :-1] * 256 + x[:, 1:]
        conv = np.take(first, pairs[:, : LENGTH - OVERLAP], axis=0)
        conv += np.take(second, pairs[:, 2:], axis=0)
        z = np.maximum(conv.max(1), 0) @ net.dense + net.offset
        z -= z.max(1, keepdims=True)
        z -= np.log(np.exp(z).sum(1, keepdims=True))
        np.add.at(sums, owner, z * fresh[:, None])
        np.add.at(total, owner, fresh)
        held.clear()

    count = 0
    for i, text in enumerate(texts):
        w, n = windows((text or "").encode("utf-8", "replace"))
        for at in range(0, len(w), BATCH):
            held.append((i, w[at : at + BATCH], n[at : at + BATCH]))
            count += len(held[-1][1])
            if count >= BATCH:
                flush()
                count = 0
    flush()
    z = sums / np.maximum(total, 1)[:, None]
    z = np.exp(z - z.max(1, keepdims=True))
    return z / z.sum(1, keepdims=True)


def _predictor(shared):
    @F.pandas_udf(T.StructType([T.StructField("lang", T.StringType()), T.StructField("score", T.DoubleType())]))
    def predict(texts: pd.Series) -> pd.DataFrame:
        net, tables = shared.value
        p = classify(list(texts), net, tables)
        best = p.argmax(1)
        return pd.DataFrame({"lang": [net.labels[k] for k in best], "score": p[np.arange(len(best)), best]})

    return predict


def learn(docs: DataFrame, sample: int = SAMPLE, sample_bytes: int = SAMPLE_BYTES) -> Network | None:
    rows = docs.where(F.col("lang").isNotNull() & F.col("text").rlike(r"\p{L}") & F.coalesce(fold_of(F.col("doc_id")) != 1, F.lit(False)))
    rows = rows.select("lang", "text", F.xxhash64(F.col("doc_id"), F.lit("sample")).alias("h"))
    # one row for each sampled document leaves the executors, however often its id repeats
    got = sampled(rows, "h", sample, sample_bytes).groupBy("h").agg(F.min(F.struct("lang", "text")).alias("r")).collect()
    got = sorted(got, key=lambda r: r["h"])
    return train([r["r"]["text"] for r in got], [r["r"]["lang"] for r in got]) if got else None


def identify(docs: DataFrame, net: Network | None) -> DataFrame:
    """Adds nothing but ``lang_pred`` and ``score`` to doc_id and held_out."""
    base = docs.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), F.col("text"))
    has_letter = F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False))
    if net is None:
        return base.select("doc_id", "held_out", F.lit("und").alias("lang_pred"), F.lit(0.0).alias("score"))
    shared = docs.sparkSession.sparkContext.broadcast((net, net.tables()))
    said = base.withColumn("_p", _predictor(shared)(F.col("text"))).withColumn("_l", has_letter)
    return said.select("doc_id", "held_out", F.when(F.col("_l"), F.col("_p.lang")).otherwise("und").alias("lang_pred"), F.when(F.col("_l"), F.col("_p.score")).otherwise(0.0).alias("score"))


def op10_language_id(docs: DataFrame) -> DataFrame:
    return identify(docs, learn(docs))
