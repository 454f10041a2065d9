"""Quality classifier: a linear-chain conditional random field over the lines of a document.

Each line has features of its own (shares of character classes, word statistics,
repetition) and of its two neighbours; the field labels it good or bad. The mean
of the forward-backward marginals of "good", weighted by line length, and a
logistic calibration of that mean give the document's score.

Training (numpy, on the driver): a bounded sample of labelled rows, those with
the least hash of doc_id: ``SAMPLE`` documents and ``SAMPLE_BYTES`` of text at
most, each text whole; fold 1 is never seen. Of rows that share a doc_id the
least text is learned. Labels are of documents:
all lines of a good one are good; lines of a bad one start as bad, and after
each of ``ROUNDS`` rounds those that the field holds for good become good, save
the one it likes least.

Defined results: a null text counts as empty, and an empty text is one empty
line with a score of its own; equal texts have equal scores; a null doc_id counts as
not held out; with no labelled row every score is 0.5; labels that repeat for a
doc_id count once, the least quality of them; an empty table gives no rows;
extra columns are ignored.
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

SAMPLE = 4000
SAMPLE_BYTES = 32 << 20
ROUNDS = 3
STEPS = 80

_KINDS = ("other", "letter", "upper", "digit", "space", "symbol", "pipe", "bang", "high")
_OWN = 15
_SHOWN = [2, 3, 4, 5, 10, 11]  # what a line shows its neighbours


def _kind_table() -> np.ndarray:
    t = np.zeros(256, np.int64)
    for name, chars in (("letter", range(97, 123)), ("upper", range(65, 91)), ("digit", range(48, 58)), ("space", [9, 10, 11, 12, 13, 32]), ("symbol", b"#$%&*@^~\\/<>=+{}[]_"), ("pipe", b"|"), ("bang", b"!?"), ("high", range(128, 256))):
        t[list(chars)] = _KINDS.index(name)
    return t


_KIND = _kind_table()


def line_features(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """Features (lines, N) and weights (length plus one) of a text's lines."""
    lines = (text or "").split("\n")
    n = len(lines)
    data = np.frombuffer((text or "").encode("utf-8", "replace"), np.uint8)
    at = np.cumsum(data == 10) - (data == 10)
    counts = np.bincount(at * len(_KINDS) + _KIND[data], minlength=n * len(_KINDS)).reshape(n, -1).astype(float)
    size = np.maximum(counts.sum(1), 1)
    letters = np.maximum(counts[:, 1] + counts[:, 2] + counts[:, 8], 1)
    f = np.zeros((n, _OWN))
    f[:, 0] = 1
    f[:, 1] = np.log1p(size) / 8
    f[:, 2], f[:, 3], f[:, 4] = 8 * counts[:, 5] / size, 8 * counts[:, 6] / size, 8 * counts[:, 7] / size
    f[:, 5] = counts[:, 2] / letters
    f[:, 6], f[:, 7], f[:, 8] = counts[:, 3] / size, 8 * counts[:, 0] / size, counts[:, 8] / size
    seen: dict[str, int] = {}
    for line in lines:
        seen[line] = seen.get(line, 0) + 1
    for i, line in enumerate(lines):
        words = line.split()
        k = len(words)
        f[i, 9] = len(line) / (10 * (k + 1))
        if k:
            f[i, 10] = 3 * sum(map(str.__eq__, words, words[1:])) / k
            f[i, 11] = len(set(words)) / k
            f[i, 12] = words[-1][-1] in ".!?"
        f[i, 13] = seen[line] > 1 and k > 0
        f[i, 14] = k < 3
    shown, edge = f[:, _SHOWN], np.zeros((1, len(_SHOWN)))
    first, last = np.zeros((n, 1)), np.zeros((n, 1))
    first[0], last[-1] = 1, 1
    before, after = np.vstack([edge, shown[:-1]]), np.vstack([shown[1:], edge])
    return np.hstack([f, before, after, first, last]), np.array([len(x) + 1.0 for x in lines])


@dataclass
class Field:
    weights: np.ndarray  # (N, 2)
    steps: np.ndarray  # (2, 2)
    slope: float
    middle: float


def _sum_exp(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis, keepdims=True)
    return np.log(np.exp(x - top).sum(axis)) + top.squeeze(axis)


def marginals(emit: np.ndarray, steps: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Forward-backward over padded chains (B, T, 2): state marginals, and summed step marginals (2, 2) per chain."""
    b, t, _ = emit.shape
    real = np.arange(t)[None, :] < length[:, None]
    ahead, back = np.zeros_like(emit), np.zeros_like(emit)
    ahead[:, 0] = emit[:, 0]
    for i in range(1, t):
        ahead[:, i] = _sum_exp(ahead[:, i - 1][:, :, None] + steps[None], 1) + emit[:, i]
    for i in range(t - 2, -1, -1):
        step = _sum_exp(steps[None] + (emit[:, i + 1] + back[:, i + 1])[:, None, :], 2)
        back[:, i] = np.where(real[:, i + 1][:, None], step, 0)
    joint = ahead + back
    state = np.exp(joint - _sum_exp(joint, 2)[:, :, None]) * real[:, :, None]
    if t == 1:
        return state, np.zeros((b, 2, 2))
    pair = ahead[:, :-1][:, :, :, None] + steps[None, None] + (emit[:, 1:] + back[:, 1:])[:, :, None, :]
    flat = pair.reshape(b, t - 1, 4)
    flat = np.exp(flat - _sum_exp(flat, 2)[:, :, None]) * real[:, 1:][:, :, None]
    return state, flat.sum(1).reshape(b, 2, 2)


def _chains(sizes: np.ndarray) -> list[np.ndarray]:
    """Chains of like length together (powers of two), few enough that their padded lines stay within a bound."""
    out = []
    level = np.ceil(np.log2(np.maximum(sizes, 1))).astype(int)
    for k in np.unique(level):
        rows = np.nonzero(level == k)[0]
        per = max(1, 65536 >> int(k))
        out += [rows[at : at + per] for at in range(0, len(rows), per)]
    return out


def _padded(items: list[np.ndarray], rows: np.ndarray) -> np.ndarray:
    out = np.zeros((len(rows), max(len(items[r]) for r in rows), *items[rows[0]].shape[1:]))
    for k, r in enumerate(rows):
        out[k, : len(items[r])] = items[r]
    return out


def line_marginals(features: list[np.ndarray], weights: np.ndarray, steps: np.ndarray) -> list[np.ndarray]:
    """P(good) of every line of every document."""
    sizes = np.array([len(x) for x in features])
    out: list[np.ndarray] = [np.zeros(0)] * len(features)
    emits = [x @ weights for x in features]
    for rows in _chains(sizes):
        state, _ = marginals(_padded(emits, rows), steps, sizes[rows])
        for k, r in enumerate(rows):
            out[r] = state[k, : sizes[r], 1]
    return out


def train(texts: list[str | None], labels: list[int]) -> Field:
    found = [line_features(t) for t in texts]
    features, lengths = [f for f, _ in found], [w for _, w in found]
    y = np.array(labels)
    sizes = np.array([len(f) for f in features])
    states = [np.full(len(f), q) for f, q in zip(features, y)]
    balance = len(y) / (2 * np.maximum(np.bincount(y, minlength=2), 1))
    doc_weight = balance[y] / sizes / len(y)
    groups = _chains(sizes)
    batches = [(rows, _padded(features, rows)) for rows in groups]
    w, steps = np.zeros((features[0].shape[1], 2)), np.zeros((2, 2))
    for _ in range(ROUNDS):
        gold = [_padded([np.eye(2)[s] for s in states], rows) for rows in groups]
        params, moments, squares = [w, steps], [np.zeros_like(w), np.zeros_like(steps)], [np.zeros_like(w), np.zeros_like(steps)]
        for t in range(1, STEPS + 1):
            g_w, g_s = 1e-4 * w, 1e-3 * steps
            for (rows, x), want in zip(batches, gold):
                state, pairs = marginals(x @ w, steps, sizes[rows])
                c = doc_weight[rows]
                g_w += np.einsum("btn,bts,b->ns", x, state - want, c)
                g_s += np.einsum("bij,b->ij", pairs - np.einsum("bti,btj->bij", want[:, :-1], want[:, 1:]), c)
            for p, g, m, v in zip(params, [g_w, g_s], moments, squares):
                m += 0.1 * (g - m)
                v += 0.01 * (g * g - v)
                p -= 0.1 * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-9)
        good = line_marginals(features, w, steps)
        states = [np.full(len(g), 1) if q else np.where(g == g.min(), 0, (g >= 0.5).astype(int)) for g, q in zip(good, y)]
    share = np.array([(g * n).sum() / n.sum() for g, n in zip(line_marginals(features, w, steps), lengths)])
    return Field(w, steps, *calibrated(share, y))


def calibrated(share: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and middle of a rising logistic curve from share of good to label, by damped Newton steps."""
    a, b = 4.0, -2.0
    for _ in range(60):
        p = 1 / (1 + np.exp(-(a * share + b)))
        x = np.stack([share, np.ones_like(share)], 1)
        h = (x * (p * (1 - p))[:, None]).T @ x + np.eye(2) * 1e-2 * max(1, len(y) / 1000)
        a, b = np.array([a, b]) - np.clip(np.linalg.solve(h, x.T @ (p - y)), -1, 1)
        a = max(a, 1.0)
    return float(a), float(-b / a)


def score(texts: list[str | None], field: Field, rows: int = 256) -> np.ndarray:
    out = []
    for at in range(0, len(texts), rows):
        found = [line_features(t) for t in texts[at : at + rows]]
        good = line_marginals([f for f, _ in found], field.weights, field.steps)
        out += [(g * n).sum() / n.sum() for g, (_, n) in zip(good, found)]
    return 1 / (1 + np.exp(-np.clip(field.slope * (np.array(out) - field.middle), -500, 500)))


def _scorer(shared):
    @F.pandas_udf(T.DoubleType())
    def scores(texts: pd.Series) -> pd.Series:
        return pd.Series(score(list(texts), shared.value), dtype="float64")

    return scores


def learn(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, sample_bytes: int = SAMPLE_BYTES) -> Field | None:
    told = labels.where("quality IS NOT NULL").groupBy("doc_id").agg(F.min("quality").alias("quality"))
    told = told.where(F.coalesce(fold_of(F.col("doc_id")) != 1, F.lit(False))).withColumn("h", F.xxhash64(F.col("doc_id"), F.lit("sample")))
    picked = told.orderBy("h", "doc_id").limit(sample)
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).join(F.broadcast(picked), "doc_id")
    # one row for each sampled document leaves the executors, however often its id repeats
    rows = sampled(rows, "h", sample, sample_bytes).groupBy("h", "doc_id", "quality").agg(F.min("text").alias("text")).collect()
    rows = sorted(rows, key=lambda r: (r["h"], r["doc_id"]))
    return train([r["text"] for r in rows], [int(r["quality"] > 0) for r in rows]) if rows else None


def score_of(docs: DataFrame, field: Field | None):
    """The score of column ``text``."""
    return F.lit(0.5) if field is None else _scorer(docs.sparkSession.sparkContext.broadcast(field))(F.col("text"))


def op4_quality(docs: DataFrame, labels: DataFrame) -> DataFrame:
    out = docs.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), score_of(docs, learn(docs, labels)).alias("score"))
    return out.select("doc_id", "held_out", "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def accepted(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of ``docs`` that the classifier does not reject."""
    return docs.where(score_of(docs, learn(docs, labels)) >= 0.5)
