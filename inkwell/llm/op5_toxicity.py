"""Toxicity by a chain of classifiers.

Categories are predicted one after another; each is a logistic regression over
the words of the text and the probabilities that the chain gave earlier
categories.  Later models are trained with out-of-fold probabilities of the
earlier ones, so they meet in training what they will meet in use.  Training takes at most
``SAMPLE`` labelled rows; every text is scored whole.

A feature is a word (letters only, case folded for ASCII) or a word's beginning
that at least ``MIN_ROWS`` training rows hold, or a band of a text statistic.  It
counts by its smoothed log-odds ratio with the category, and a ridge holds it
back; neither asks for a number of labelled rows.  A category's cut is where
out-of-fold F1 is highest.

Cases: null and empty texts have no words and get the probability of such.  A
null label is left out of its category's training.  Labels repeated for one
doc_id count as their largest.  Without labels of both kinds a category has
probability 0 everywhere.  Repeated rows are each returned; empty tables give
empty results; extra columns are ignored.
"""

from __future__ import annotations

from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import as_binary, read, slices

#: Labelled rows at most, fewest training rows with a word, folds, steps of training.
SAMPLE, MIN_ROWS, FOLDS, STEPS = 5000, 3, 4, 150
#: Bytes of the longest text that trains; longer ones are scored like all others.
LONGEST = 1 << 16
#: Rows added to each cell of a feature's two-by-two table with a category.
ADDED = 0.5
#: Bytes of the word beginnings that are features too, for inflected words.
BEGINNINGS = (5, 7)

_LETTERS = bytes(c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or c >= 128 else 32 for c in range(256))
_SYMBOLS = bytes(c for c in range(256) if chr(c).isalnum() or c >= 128 or c in b" \t\n\r.,'-")
_UPPER = bytes(c for c in range(256) if not 65 <= c <= 90)


def words(text: bytes) -> set[bytes]:
    """Distinct words, word beginnings, and bands of the text's length, symbols and capitals (named so that no word is equal)."""
    n = len(text) + 1
    bands = {b"%d %d" % (i, min(9, int(20 * len(text.translate(None, keep)) / n))) for i, keep in ((1, _SYMBOLS), (2, _UPPER))}
    own = set(text.translate(_LETTERS).split())
    begun = {b"^" + w[:k] for k in BEGINNINGS for w in own if len(w) > k}
    return {*own, *begun, *bands, b"3 %d" % n.bit_length()}


def _evidence(held: np.ndarray, both: np.ndarray, n: int, pos: float) -> np.ndarray:
    """Smoothed log-odds ratio, without its sign, of features with a category: ``held`` of n rows have the feature, ``both`` of the category's ``pos``."""
    cells = [x + ADDED for x in (both, n - pos - (held - both), held - both, pos - both)]
    return np.abs(np.log(cells[0] * cells[1] / (cells[2] * cells[3])))


def _logistic(rows: list[np.ndarray], extra: np.ndarray, y: np.ndarray, size: int) -> np.ndarray:
    """Weights (size + extra columns + intercept) by Adam on the class-balanced loss with a ridge."""
    if not len(rows) or y.min() == y.max():
        w = np.zeros(size + extra.shape[1] + 1)
        w[-1] = -30.0
        return w
    flat = np.concatenate(rows)
    row = np.repeat(np.arange(len(rows)), [len(r) for r in rows])
    # A feature counts by its evidence, so the ridge holds back those that hardly go with the category.
    scale = _evidence(np.bincount(flat, minlength=size), np.bincount(flat, y[row], size), len(y), y.sum())
    x = scale[flat]
    weight = np.where(y == 1, 0.5 / y.mean(), 0.5 / (1 - y.mean())) / len(y)
    w, a, b = (np.zeros(size + extra.shape[1] + 1) for _ in range(3))
    for step in range(1, STEPS + 1):
        z = np.bincount(row, w[flat] * x, len(rows)) + extra @ w[size:-1] + w[-1]
        d = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - y) * weight
        g = np.concatenate([np.bincount(flat, d[row] * x, size), extra.T @ d, [d.sum()]])
        g[:size] += 1e-3 * w[:size]
        a += 0.1 * (g - a)
        b += 0.01 * (g * g - b)
        w -= 0.3 * (1 - 0.9 * step / STEPS) * (a / (1 - 0.9**step)) / (np.sqrt(b / (1 - 0.99**step)) + 1e-8)
    w[:size] *= scale
    return w


def _odds(w: np.ndarray, rows: list[np.ndarray], extra: np.ndarray, size: int) -> np.ndarray:
    z = np.array([w[r].sum() for r in rows]) if rows else np.zeros(0)
    return np.clip(z + extra @ w[size:-1] + w[-1], -30, 30)


def probability(odds: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-odds))


def _best_cut(odds: np.ndarray, y: np.ndarray) -> float:
    """The middle of the gap after which F1 is highest."""
    if not len(y) or y.min() == y.max():
        return 0.0
    order = np.argsort(-odds, kind="stable")
    hit = np.cumsum(y[order])
    f1 = 2 * hit / (np.arange(1, len(y) + 1) + y.sum())
    k = int(f1.argmax())
    return float((odds[order[k]] + odds[order[min(k + 1, len(y) - 1)]]) / 2)


def train(rows: list[tuple[bytes, list[int | None]]], folds: int = FOLDS) -> dict:
    """The chain, from (text, labels in the chain's order)."""
    # Words are made twice rather than held: the driver's memory is small.
    count = Counter(w for t, _ in rows for w in words(t))
    index = {w: i for i, w in enumerate(sorted(w for w, n in count.items() if n >= MIN_ROWS))}
    del count
    size = len(index)
    coded = [np.array(sorted(index[w] for w in words(t) if w in index), np.int64) for t, _ in rows]
    labels = np.array([[np.nan if v is None else v for v in y] for _, y in rows], float).reshape(len(rows), -1)
    extra = np.zeros((len(rows), 0))
    models, cuts = [], []
    fold = np.arange(len(rows)) % folds
    for j in range(labels.shape[1]):
        y = labels[:, j]
        known = ~np.isnan(y)

        def fitted(mask, y=y, extra=extra):
            at = np.flatnonzero(mask)
            return _logistic([coded[i] for i in at], extra[at], y[at], size)

        held = np.zeros(len(rows))
        for f in range(folds):
            at = np.flatnonzero(fold == f)
            held[at] = _odds(fitted(known & (fold != f)), [coded[i] for i in at], extra[at], size)
        models.append(fitted(known))
        cuts.append(_best_cut(held[known], y[known]))
        extra = np.column_stack([extra, probability(held)])
    return {"index": index, "models": models, "cuts": cuts}


def predict(model: dict, texts: list[bytes]) -> np.ndarray:
    """Log-odds (text, category), each model fed with the probabilities that the ones before it gave."""
    index = model["index"]
    coded = [np.array([index[w] for w in words(t) if w in index], np.int64) for t in texts]
    odds, extra = np.zeros((len(texts), 0)), np.zeros((len(texts), 0))
    for w in model["models"]:
        odds = np.column_stack([odds, _odds(w, coded, extra, len(index))])
        extra = probability(odds)
    return odds


def fit(docs: DataFrame, labels: DataFrame, categories: list[tuple[str, str]]) -> dict:
    """From at most SAMPLE labelled ids, those whose hashes are lowest; only these meet the texts.

    Of rows with one id the smallest text counts, and texts over LONGEST bytes
    don't train, so what comes to the driver is bounded in rows and bytes.
    """
    named = labels.where("doc_id is not null").groupBy("doc_id").agg(*[F.max(F.expr(e)).alias(n) for n, e in categories])
    some = named.withColumn("__h", F.xxhash64("doc_id")).orderBy("__h").limit(SAMPLE)
    texts = docs.select(F.col("doc_id"), F.col("text").cast("string").alias("text")).where(F.coalesce(F.octet_length("text"), F.lit(0)) <= LONGEST)
    # SAMPLE rows at most are broadcast; the texts that match meet by id, a hot id's after a partial minimum.
    rows = texts.join(F.broadcast(some), "doc_id").groupBy("doc_id").agg(F.min("text").alias("text"), *[F.first(c).alias(c) for c in some.columns if c != "doc_id"]).collect()
    rows.sort(key=lambda r: (r["__h"], r.text or ""))
    if not rows:
        return {"index": {}, "models": [_logistic([], np.zeros((0, j)), np.zeros(0), 0) for j in range(len(categories))], "cuts": [0.0] * len(categories)}
    return train([((r.text or "").encode(), [r[n] for n, _ in categories]) for r in rows])


def score(docs: DataFrame, model: dict, names: list[str]) -> DataFrame:
    """docs(doc_id, text) -> doc_id, p_<name> and is_<name> of each category."""
    cuts = np.array(model["cuts"])

    def run(batches):
        for batch in slices(batches):
            odds = predict(model, as_binary(batch.column("text")))
            p = probability(odds)
            cols = [batch.column("doc_id")]
            cols += [pa.array(p[:, j]) for j in range(len(names))] + [pa.array(odds[:, j] > cuts[j]) for j in range(len(names))]
            yield pa.record_batch(cols, names=["doc_id", *[f"p_{n}" for n in names], *[f"is_{n}" for n in names]])

    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return docs.mapInArrow(run, "doc_id long, " + ", ".join([f"p_{n} double" for n in names] + [f"is_{n} boolean" for n in names]))


#: The chain of the query: labelled quality first, then toxicity.
CHAIN = [("low_quality", "1 - quality"), ("toxic", "toxic")]


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    return score(docs, fit(docs, read(spark, sf_dir, "labels"), CHAIN), [n for n, _ in CHAIN])
