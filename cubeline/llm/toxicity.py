"""Toxicity by a chain of linear classifiers.

Categories are predicted one after the other (Read et al. 2011): the model of each
sees the words of the text and the probabilities of all categories before it. In
training these probabilities are out-of-fold predictions, so a later model learns
from what an earlier one says about texts it has not seen: a fold's terms, grades
and models are made without its documents.

A text is the set of its words (ASCII case and punctuation aside), hashed. Models
are logistic regressions on the ``terms`` words that part the labelled texts most
(by a z-score of their document counts), learned on a sample of labelled documents:
at most ``sample`` documents with at most ``words`` distinct words in all (see
labelled.py). Sampled and scored texts are read whole.

Categories are label columns. ``graded`` derives finer ones from a single label,
by how many of the label's typical words a document holds. The threshold of the
last category is chosen on documents that the whole procedure, terms and grades
included, has not seen. Rows that are held out (one id in five) are not learned from
at all, so that the result can be judged on them.

Defined cases: null and empty texts have no words; an id with conflicting labels
counts by their mean; null ids or labels are not learned from; a category with one
label only is predicted as its share; rows that repeat are scored each; an empty
table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .blocks import blocks, id_text
from .labelled import held_out, labelled_sample
from .textvec import LETTERS, word_hashes

SAMPLE, WORDS, TERMS, FOLDS = 6000, 8_000_000, 256, 3


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * (1 + np.tanh(0.5 * x))


def choose_terms(words: list[np.ndarray], y: np.ndarray, terms: int = TERMS, least: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """(the sorted words that part the labels most, their z-scores)."""
    of = np.repeat(y, [len(w) for w in words])
    distinct, inverse = np.unique(np.concatenate(words) if words else np.zeros(0, np.uint64), return_inverse=True)
    n = np.bincount(inverse, minlength=len(distinct)).astype(float)
    hits = np.bincount(inverse, of, len(distinct))
    share = y.mean() if len(y) else 0.0
    z = (hits - n * share) / np.sqrt(n * share * (1 - share) + 1e-9)
    z[n < least] = 0
    keep = np.sort(np.argsort(-np.abs(z), kind="stable")[:terms])
    keep = keep[np.abs(z[keep]) > 2]
    return distinct[keep], z[keep]


def presence(words: list[np.ndarray], terms: np.ndarray) -> np.ndarray:
    out = np.zeros((len(words), len(terms)))
    if len(terms):
        for k, w in enumerate(words):
            at = np.minimum(np.searchsorted(terms, w), len(terms) - 1)
            out[k, at[terms[at] == w]] = 1
    return out


def fit_linear(x: np.ndarray, y: np.ndarray, ridge: float = 1.0, rounds: int = 20) -> np.ndarray:
    """Weights and, last, the intercept, by Newton steps."""
    x1 = np.hstack((x, np.ones((len(x), 1))))
    w = np.zeros(x1.shape[1])
    if not len(y) or y.min() == y.max():
        share = y.mean() if len(y) else 0.0
        w[-1] = np.log((share + 1e-3) / (1 - share + 1e-3))
        return w
    penalty = np.full(len(w), ridge)
    penalty[-1] = 1e-6
    for _ in range(rounds):
        p = _sigmoid(x1 @ w)
        g = x1.T @ (p - y) + penalty * w
        h = (x1 * np.maximum(p * (1 - p), 1e-6)[:, None]).T @ x1 + np.diag(penalty)
        step = np.linalg.solve(h, g)
        w = w - step
        if np.abs(step).max() < 1e-4:
            break
    return w


def fit_chain(words: list[np.ndarray], y: np.ndarray, terms: int = TERMS, folds: int = FOLDS, grade: bool = False) -> tuple[np.ndarray, list[np.ndarray]]:
    """(terms, a model for each column of labels, fed the out-of-fold probabilities of those before it).

    grade: y has one column, and is graded.
    """
    fold = np.arange(len(words)) % folds

    def prepared(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        own = [words[k] for k in rows]
        found, z = choose_terms(own, y[rows].any(1).astype(float), terms)
        return found, graded(own, y[rows, 0], found, z) if grade else y[rows].astype(float)

    whole, labels = prepared(np.arange(len(words)))
    x = presence(words, whole)
    parts = []
    for f in range(folds):
        rest, here = np.flatnonzero(fold != f), np.flatnonzero(fold == f)
        found, of_rest = prepared(rest)
        parts.append((rest, here, presence(words, found), of_rest))
    models, earlier = [], np.zeros((len(words), 0))
    for k in range(labels.shape[1]):
        models.append(fit_linear(np.hstack((x, earlier)), labels[:, k]))
        out = np.zeros(len(words))
        for rest, here, own, of_rest in parts:
            own = np.hstack((own, earlier))
            out[here] = _apply(fit_linear(own[rest], of_rest[:, k]), own[here])
        earlier = np.hstack((earlier, out[:, None]))
    return whole, models


def unseen(words: list[np.ndarray], y: np.ndarray, terms: int = TERMS, folds: int = FOLDS, grade: bool = False) -> np.ndarray:
    """The probability of the last category for each document, by a chain that was fitted without it."""
    # other folds than those within the chain
    fold, out = np.arange(len(words)) // folds % folds, np.zeros(len(words))
    for f in range(folds):
        rest, here = np.flatnonzero(fold != f), np.flatnonzero(fold == f)
        if len(here):
            found, models = fit_chain([words[k] for k in rest], y[rest], terms, folds, grade)
            out[here] = predict_chain(models, presence([words[k] for k in here], found))[:, -1]
    return out


def best_threshold(p: np.ndarray, y: np.ndarray) -> float:
    """Middle of the gap with the highest F1; a half without labels of both kinds."""
    if not len(y) or y.min() == y.max():
        return 0.5
    order = np.argsort(-p, kind="stable")
    p, hits = p[order], np.cumsum(y[order])
    f1 = 2 * hits / (np.arange(1, len(p) + 1) + y.sum())
    f1[:-1][p[:-1] == p[1:]] = -1  # equal probabilities are not parted
    k = int(np.argmax(f1))
    return float((p[k] + (p[k + 1] if k + 1 < len(p) else 0)) / 2)


def _apply(w: np.ndarray, x: np.ndarray) -> np.ndarray:
    return _sigmoid(x @ w[:-1] + w[-1])


def predict_chain(models: list[np.ndarray], x: np.ndarray) -> np.ndarray:
    earlier = np.zeros((len(x), 0))
    for w in models:
        earlier = np.hstack((earlier, _apply(w, np.hstack((x, earlier)))[:, None]))
    return earlier


def graded(words: list[np.ndarray], y: np.ndarray, terms: np.ndarray, z: np.ndarray) -> np.ndarray:
    """Label columns (strong, mild, the label): strong documents of the label hold more typical words than its median one, mild ones do not."""
    typical = terms[z > max(4.0, z.max(initial=0) / 4)]
    hits = presence(words, typical).sum(1)
    middle = np.median(hits[y > 0.5]) if (y > 0.5).any() else 0
    return np.stack(((y > 0.5) & (hits > middle), (y > 0.5) & (hits <= middle), y > 0.5), 1).astype(float)


CATEGORIES = ("strong", "mild", "toxic")


def _distinct(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for ids, texts in blocks(batches):
        for first, block in word_hashes(texts, LETTERS):
            found = [np.unique(w) for w in block]
            yield pa.RecordBatch.from_arrays([pa.array(ids[first : first + len(block)], pa.int64()), pa.array([len(w) for w in found], pa.int64()), pa.array([w.tobytes() for w in found], pa.binary())], names=["id", "size", "data"])


def learn_chain(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", categories: tuple[str, ...] = ("toxic",), sample: int = SAMPLE, words: int = WORDS, terms: int = TERMS, hold_out: bool = True) -> dict:
    """{terms, models, names, threshold}: the chain over the label columns, in their order; a single one is graded.

    threshold: of the last category. hold_out: rows that are held out are not learned from.
    """
    rows = labelled_sample(docs, labels, doc_id, text, tuple(categories), sample, words, _distinct, hold_out)
    sets = [np.frombuffer(w, np.uint64) for _, w in rows]
    y = np.array([v for v, _ in rows], float).reshape(len(rows), len(categories)) > 0.5
    grade = len(categories) == 1
    found, models = fit_chain(sets, y, terms, grade=grade)
    names = CATEGORIES[:-1] + tuple(categories) if grade else tuple(categories)
    return {"terms": found, "models": models, "names": names, "threshold": best_threshold(unseen(sets, y, terms, grade=grade), y[:, -1].astype(float))}


def score_toxicity(docs: DataFrame, chain: dict, doc_id: str = "doc_id", text: str = "text", threshold: float | None = None) -> DataFrame:
    """(doc_id, held_out, p_<category> of each, predicted): the last category decides, by the learned threshold if none is given."""
    columns = [f"p_{n}" for n in chain["names"]]

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, texts in blocks(batches):
            for first, block in word_hashes(texts, LETTERS):
                p = predict_chain(chain["models"], presence(block, chain["terms"]))
                yield pa.RecordBatch.from_arrays([pa.array(ids[first : first + len(block)], pa.int64()), *(pa.array(c) for c in p.T)], names=["doc_id", *columns])

    scored = id_text(docs, doc_id, text).mapInArrow(rows, "doc_id long, " + ", ".join(f"`{c}` double" for c in columns))
    scored = scored.withColumn("held_out", held_out(F.col("doc_id")))
    return scored.withColumn("predicted", (F.col(f"`{columns[-1]}`") >= (chain["threshold"] if threshold is None else threshold)).cast("int"))
