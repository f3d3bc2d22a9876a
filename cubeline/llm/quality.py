"""Document quality by attention-based multiple-instance learning.

A document is a bag of passages of ``PASSAGE`` words; only the bag has a label.
Every passage of the whole text becomes a vector of shares and ratios (kinds of
characters, repeated words, lengths, line ends), which a small layer encodes.
Gated attention (Ilse, Tomczak and Welling 2018) weighs the passages,
``a = softmax(w . (tanh(V h) * sigmoid(U h)))``, and a logistic unit scores the
weighted sum. All layers are learned together from document labels, by Adam, on
every passage of a sample of labelled documents: at most ``sample`` documents with
at most ``passages`` passages in all (see labelled.py). Scoring reads every passage,
some at a time, with a running softmax.

Only the text is an input. Rows that are held out are not learned from.

Defined cases: null and empty texts are one passage without words; documents that
repeat an id are scored each; an id with conflicting labels counts by their mean;
null ids or labels are not learned from; without labels of both kinds the score is
the share of label 1, or a half; an empty table gives an empty result; other
columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .blocks import blocks, id_text
from .labelled import held_out, labelled_sample
from .textvec import _cut, _words

PASSAGE = 64
SAMPLE, PASSAGES = 6000, 1_000_000
HIDDEN, GATE = 16, 12
EPOCHS, BATCH, RATE = 24, 64, 0.01
THRESHOLD = 0.3

#: Kinds of bytes: lower, upper, digit, line feed, other space, full stop, comma, other sentence marks, bar, quotes and hyphens, brackets, other symbols, parts of non-ASCII characters.
_KINDS = 13
_KIND = np.full(256, 11, np.int64)
_KIND[128:] = 12
for _k, _chars in enumerate((b"abcdefghijklmnopqrstuvwxyz", b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789", b"\n", b" \t\r\x0b\x0c", b".", b",", b"!?;:", b"|", b"'\"-", b"()[]{}<>")):
    _KIND[list(_chars)] = _k
N_FEATURES = _KINDS + 10


def passage_blocks(text: str) -> Iterator[np.ndarray]:
    """A row of N_FEATURES for each passage, block by block; one row if there are no words."""
    none = True
    for piece in _cut(text.encode("utf-8", "surrogatepass")):
        if len(x := _piece_features(piece)):
            none = False
            yield x
    if none:
        yield np.zeros((1, N_FEATURES), np.float32)


def passage_features(text: str) -> np.ndarray:
    return np.concatenate(list(passage_blocks(text)))


def _piece_features(data: bytes) -> np.ndarray:
    buf = np.frombuffer(data, np.uint8)
    starts, ends, words = _words(data)
    n = len(words)
    if not n:
        return np.zeros((0, N_FEATURES), np.float32)
    count = max(1, round(n / PASSAGE))
    first = np.arange(count) * n // count
    passage = np.repeat(np.arange(count), np.diff(np.append(first, n)))
    bounds = np.append(starts[first], len(buf))
    kinds = _KIND[buf]
    of_byte = np.zeros(len(buf), np.int64)
    of_byte[bounds[1:-1]] = 1
    of_byte = np.cumsum(of_byte)
    chars = np.bincount(of_byte * _KINDS + kinds, minlength=count * _KINDS).reshape(count, _KINDS).astype(float)
    total = chars.sum(1, keepdims=True)
    sizes = np.bincount(passage, minlength=count).astype(float)

    def share(x: np.ndarray) -> np.ndarray:
        return np.bincount(passage, x, count) / sizes

    length = (ends - starts).astype(float)
    same = np.zeros(n)
    same[1:] = words[1:] == words[:-1]
    order = np.lexsort((words, passage))
    w, p = words[order], passage[order]
    new = np.ones(n)
    new[1:] = (w[1:] != w[:-1]) | (p[1:] != p[:-1])
    distinct = np.bincount(p, new, count) / sizes
    head, last = kinds[starts], kinds[ends - 1]
    columns = [
        share(length) / 10,
        share(length <= 3),
        share(length >= 12),
        share(same),
        distinct,
        share(head == 1),
        share((last == 5) | (last == 6) | (last == 7)),
        share(last == 11),
        share((length == 1) & (head >= 5)),
        np.log1p(sizes) / 5,
    ]
    return np.hstack((chars / total, np.stack(columns, 1))).astype(np.float32)


# --- the model ------------------------------------------------------------------------------------


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * (1 + np.tanh(0.5 * x))


def initial(seed: int = 7) -> dict[str, np.ndarray]:
    r = np.random.RandomState(seed)
    shape = {"E": (N_FEATURES, HIDDEN), "e": (HIDDEN,), "V": (HIDDEN, GATE), "U": (HIDDEN, GATE), "w": (GATE,), "c": (HIDDEN,), "b": (1,)}
    return {k: r.normal(0, 0.4 if len(s) > 1 or k in "wc" else 0, s) for k, s in shape.items()}


def forward(m: dict, x: np.ndarray, starts: np.ndarray):
    """x: passages of all bags, one bag after the other; starts: the first passage of each bag. (scores, what gradients need)"""
    h = np.tanh(x @ m["E"] + m["e"])
    t, g = np.tanh(h @ m["V"]), _sigmoid(h @ m["U"])
    s = (t * g) @ m["w"]
    bag = np.repeat(np.arange(len(starts)), np.diff(np.append(starts, len(x))))
    a = np.exp(s - np.maximum.reduceat(s, starts)[bag])
    a /= np.add.reduceat(a, starts)[bag]
    z = np.add.reduceat(a[:, None] * h, starts, axis=0)
    return _sigmoid(z @ m["c"] + m["b"][0]), (h, t, g, bag, a, z)


def gradients(m: dict, x: np.ndarray, starts: np.ndarray, y: np.ndarray) -> dict:
    """Of the mean cross-entropy."""
    p, (h, t, g, bag, a, z) = forward(m, x, starts)
    d = (p - y) / len(y)
    dz = d[:, None] * m["c"]
    da = (dz[bag] * h).sum(1)
    ds = a * (da - np.add.reduceat(a * da, starts)[bag])
    dt, dg = ds[:, None] * m["w"] * g * (1 - t * t), ds[:, None] * m["w"] * t * g * (1 - g)
    dh = (a[:, None] * dz[bag] + dt @ m["V"].T + dg @ m["U"].T) * (1 - h * h)
    return {"E": x.T @ dh, "e": dh.sum(0), "V": h.T @ dt, "U": h.T @ dg, "w": (t * g).T @ ds, "c": z.T @ d, "b": np.array([d.sum()])}


def fit(bags: list[np.ndarray], labels: np.ndarray, epochs: int = EPOCHS, seed: int = 7) -> dict[str, np.ndarray]:
    """The model, with the means and deviations that features are scaled by."""
    y = np.asarray(labels, float)
    if not len(y) or y.min() == y.max():
        share = y.mean() if len(y) else 0.5
        m = {k: v * 0 for k, v in initial(seed).items()}
        return m | {"b": np.array([np.log((share + 1e-3) / (1 - share + 1e-3))]), "mean": np.zeros(N_FEATURES), "scale": np.ones(N_FEATURES)}
    every = np.concatenate(bags)
    mean, scale = every.mean(0), every.std(0) + 1e-3
    bags = [(b - mean) / scale for b in bags]
    m, r = initial(seed), np.random.RandomState(seed)
    first, second = ({k: np.zeros_like(v) for k, v in m.items()} for _ in range(2))
    step = 0
    for epoch in range(epochs):
        rate = RATE * 0.5 * (1 + np.cos(np.pi * epoch / epochs))
        order = r.permutation(len(y))
        for a in range(0, len(y), BATCH):
            own = order[a : a + BATCH]
            x = np.concatenate([bags[k] for k in own])
            starts = np.cumsum([0, *(len(bags[k]) for k in own[:-1])])
            step += 1
            for k, d in gradients(m, x, starts, y[own]).items():
                d = d + 1e-4 * m[k]
                first[k] = 0.9 * first[k] + 0.1 * d
                second[k] = 0.999 * second[k] + 0.001 * d * d
                m[k] = m[k] - rate * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.999**step)) + 1e-8)
    return m | {"mean": mean, "scale": scale}


def score_blocks(m: dict, blocks: Iterator[np.ndarray]) -> float:
    """The score of one bag whose passages come in blocks."""
    top, total, z = -np.inf, 0.0, np.zeros(HIDDEN)
    for x in blocks:
        h = np.tanh((x - m["mean"]) / m["scale"] @ m["E"] + m["e"])
        s = (np.tanh(h @ m["V"]) * _sigmoid(h @ m["U"])) @ m["w"]
        higher = max(top, s.max())
        a = np.exp(s - higher)
        before = np.exp(top - higher)
        total, z, top = total * before + a.sum(), z * before + a @ h, higher
    return float(_sigmoid(z / total @ m["c"] + m["b"][0]))


def score(model: dict, texts: list[str]) -> np.ndarray:
    return np.array([score_blocks(model, passage_blocks(t)) for t in texts])


# --- on tables ------------------------------------------------------------------------------------


def _bags(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for ids, texts in blocks(batches):
        found = [passage_features(t) for t in texts]
        yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array([len(x) for x in found], pa.int64()), pa.array([x.tobytes() for x in found], pa.binary())], names=["id", "size", "data"])


def learn(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", label: str = "quality", sample: int = SAMPLE, passages: int = PASSAGES) -> dict[str, np.ndarray]:
    """The model from labelled documents that are not held out: at most ``sample``, with at most ``passages`` in all."""
    rows = labelled_sample(docs, labels, doc_id, text, (label,), sample, passages, _bags)
    return fit([np.frombuffer(x, np.float32).reshape(-1, N_FEATURES) for _, x in rows], np.array([y for (y,), _ in rows]))


def score_quality(docs: DataFrame, model: dict[str, np.ndarray], doc_id: str = "doc_id", text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, held_out, score, predicted), a row for each document."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, texts in blocks(batches):
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(score(model, texts), pa.float64())], names=["doc_id", "score"])

    scored = id_text(docs, doc_id, text).mapInArrow(rows, "doc_id long, score double")
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def keep_quality(docs: DataFrame, model: dict[str, np.ndarray], text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """The rows of docs whose text scores at least ``threshold``; no shuffle, columns as they were."""

    @F.pandas_udf("double")
    def scored(texts):
        import pandas as pd

        return pd.Series(score(model, [t or "" for t in texts]))

    return docs.filter(scored(F.col(f"`{text}`")) >= threshold)
