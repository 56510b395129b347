"""Toxicity by a chain of linear classifiers.

Categories are predicted one after another; the model of a category sees the words and the probabilities that
the models before it give. While training, those probabilities come from models that have not seen the row
(out-of-fold), as they will for new documents.

The labels at hand name two categories: low quality (quality = 0) and toxic; the chain takes them in this
order and others by `categories`.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .bpe import slices
from .words import WORDS, distinct
from .workers import bounded, task

#: Labelled rows that a chain is fitted on at most (those with the smallest hashes of their ids); the
#: driver holds their word hashes. Words chosen as features, and documents of the sample that must hold one.
TRAIN_ROWS, FEATURES, LEAST_DOCUMENTS, FOLDS, RIDGE = 6000, 1500, 4, 5, 2.0
#: Chi-square (one degree of freedom, p = 0.001) below which a word tells nothing.
LEAST_CHI_SQUARE = 10.83

#: ASCII letters in lower case and digits stay, other ASCII parts words, bytes beyond stay.
_TABLE = bytes((c | 32) if 65 <= c <= 90 else c if c >= 128 or 48 <= c <= 57 or 97 <= c <= 122 else 32 for c in range(256))


def words(text: str | None) -> np.ndarray:
    return WORDS.of((text or "").encode().translate(_TABLE).split())


@dataclass
class Linear:
    weights: np.ndarray  # of words, then of the categories before
    bias: float

    def logits(self, x: np.ndarray, before: np.ndarray) -> np.ndarray:
        n = x.shape[1]
        return x @ self.weights[:n] + before @ self.weights[n:] + self.bias


@dataclass
class Chain:
    categories: tuple[str, ...]
    features: np.ndarray  # sorted word hashes
    models: list[Linear]
    thresholds: list[float]  # of probabilities

    def logits(self, x: np.ndarray) -> np.ndarray:
        out = np.zeros((len(x), 0))
        for m in self.models:
            out = np.column_stack([out, m.logits(x, _sigmoid(out))])
        return out


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


def _fit(x: np.ndarray, before: np.ndarray, y: np.ndarray) -> Linear:
    """Ridge logistic regression by accelerated gradient steps with restarts."""
    a = np.column_stack([x, before, np.ones(len(x))]).astype(np.float32)
    prior = np.clip(y.mean(), 1e-3, 1 - 1e-3)
    w = np.zeros(a.shape[1])
    w[-1] = np.log(prior / (1 - prior))
    ridge = np.full(a.shape[1], RIDGE)
    ridge[-1] = 0
    v = np.random.default_rng(0).standard_normal(a.shape[1])
    for _ in range(20):  # largest curvature
        v = a.T @ (a @ (v / np.linalg.norm(v)).astype(np.float32)).astype(np.float64)
    step = 1 / (0.3 * np.linalg.norm(v) + RIDGE)
    last, momentum, t = w, w, 1.0
    for _ in range(200):
        g = a.T @ (_sigmoid((a @ momentum.astype(np.float32)).astype(np.float64)) - y).astype(np.float32) + ridge * momentum
        w = momentum - step * g
        if g @ (w - last) > 0:
            t = 1.0
        s = (1 + np.sqrt(1 + 4 * t * t)) / 2
        momentum, last, t = w + (t - 1) / s * (w - last), w, s
    return Linear(w[:-1], float(w[-1]))


def _choose(sets: list[np.ndarray], labels: np.ndarray) -> np.ndarray:
    """The words that tell most about any category, by chi-square; ties by hash."""
    flat = np.concatenate(sets) if sets else np.zeros(0, np.uint64)
    row = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    found, back, count = np.unique(flat, return_inverse=True, return_counts=True)
    best = np.zeros(len(found))
    n = len(sets)
    for y in labels.T:
        p = y.mean() if n else 0
        seen = np.bincount(back, weights=y[row], minlength=len(found))
        spread = count * p * (1 - p) * np.maximum(1 - count / max(n, 1), 1e-9)
        best = np.maximum(best, np.divide((seen - count * p) ** 2, spread, out=np.zeros(len(found)), where=spread > 0))
    best[count < LEAST_DOCUMENTS] = 0
    order = np.lexsort((found, -best))[:FEATURES]
    return np.sort(found[order[best[order] >= LEAST_CHI_SQUARE]])


def matrix(sets: list[np.ndarray], features: np.ndarray) -> np.ndarray:
    """1 where a text (its word hashes, repeats allowed) has a feature."""
    out = np.zeros((len(sets), len(features)), np.float32)
    if len(features) and sets:
        flat = np.concatenate(sets)
        row = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
        at = np.minimum(np.searchsorted(features, flat), len(features) - 1)
        hit = features[at] == flat
        out[row[hit], at[hit]] = 1
    return out


def _threshold(p: np.ndarray, y: np.ndarray) -> float:
    """Probability with the best F1 out of fold, halfway to the next; 0.5 where there is nothing to learn."""
    if not 0 < y.sum() < len(y):
        return 0.5 if not y.sum() else 0.0
    order = np.argsort(-p, kind="stable")
    true = np.cumsum(y[order])
    f1 = 2 * true / (np.arange(1, len(y) + 1) + y.sum())
    k = int(np.argmax(f1))
    low = p[order[k + 1]] if k + 1 < len(y) else 0.0
    return float((p[order[k]] + low) / 2)


def out_of_fold(x: np.ndarray, before: np.ndarray, y: np.ndarray, fold: np.ndarray) -> np.ndarray:
    """Log-odds of each row from a model fitted on the other folds."""
    out = np.zeros(len(x))
    for f in range(FOLDS):
        held = fold == f
        if held.any() and not held.all():
            out[held] = _fit(x[~held], before[~held], y[~held]).logits(x[held], before[held])
    return out


def fit(sets: list[np.ndarray], labels: np.ndarray, categories: tuple[str, ...]) -> Chain:
    """Fit a chain on word-hash sets and their 0/1 labels (a column for each category)."""
    features = _choose(sets, labels)
    x = matrix(sets, features)
    fold = np.arange(len(sets)) % FOLDS
    unseen = np.zeros((len(sets), 0))
    models, thresholds = [], []
    for k in range(len(categories)):
        y, before = labels[:, k].astype(np.float64), _sigmoid(unseen)
        out = out_of_fold(x, before, y, fold)
        models.append(_fit(x, before, y) if len(sets) else Linear(np.zeros(len(features) + k), -40.0))
        thresholds.append(_threshold(_sigmoid(out), y))
        unseen = np.column_stack([unseen, out])
    return Chain(categories, features, models, thresholds)


def _hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        sets = [distinct(words(x.as_py())) for x in b.column(0)]
        ends = np.cumsum([0] + [len(s) for s in sets]).astype(np.int32)
        flat = np.concatenate(sets).astype(np.int64) if sets else np.zeros(0, np.int64)
        yield pa.RecordBatch.from_arrays([pa.ListArray.from_arrays(pa.array(ends), pa.array(flat)), *(b.column(i) for i in range(1, b.num_columns))], ["words", *b.schema.names[1:]])


def train(docs: DataFrame, labels: DataFrame, categories: dict[str, Column] | None = None, rows: int = TRAIN_ROWS, id_col: str = "doc_id", text_col: str = "text") -> Chain:
    """Fit a chain on at most `rows` labelled documents. Labels that are null count as 0; labels without a
    document, and documents without a label, are left out. Without labels nothing is toxic."""
    categories = categories or {"low_quality": F.col("quality") == 0, "toxic": F.col("toxic") == 1}
    named = labels.where(F.col("doc_id").isNotNull()).select("doc_id", *(F.coalesce(c.cast("int"), F.lit(0)).alias(f"y{i}") for i, c in enumerate(categories.values())))
    picked = named.orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)
    sample = docs.select(F.col(text_col).alias("text"), F.col(id_col).alias("doc_id")).join(F.broadcast(picked), "doc_id")
    ys = [f"y{i}" for i in range(len(categories))]
    # words are hashed where the texts are; an id may stand for several rows
    hashed = bounded(sample).select("text", *ys, F.xxhash64("doc_id", "text").alias("o")).mapInArrow(task(_hashed, "words"), "words array<long>, " + ", ".join(f"{y} int" for y in ys) + ", o long")
    got = hashed.orderBy("o").limit(rows).toArrow()
    got = got.take(np.argsort(got.column("o").to_numpy(), kind="stable")) if got.num_rows else got
    sets = [np.array(x.values).astype(np.uint64) for x in got.column("words")]
    y = np.column_stack([got.column(c).to_numpy() for c in ys]) if got.num_rows else np.zeros((0, len(ys)))
    return fit(sets, y, tuple(categories))


def score(docs: DataFrame, chain: Chain, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """`id`, and for each category c p_c (probability) and c (boolean), for every row; null and empty texts
    have no words. Whole texts are read, row by row, without a shuffle; a task holds a batch bounded by bytes,
    and of a longer text its words. Repeated rows and equal ids are each scored, other columns don't matter,
    and an empty table has no rows."""
    source = bounded(docs).select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    id_type = source.schema["id"].dataType.simpleString()
    names = chain.categories

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = b.column(1).to_pylist()
            for s, t in slices([x or "" for x in texts]):
                p = _sigmoid(chain.logits(matrix([words(x) for x in texts[s:t]], chain.features)))
                columns = [x for k in range(len(names)) for x in (pa.array(p[:, k]), pa.array(p[:, k] >= chain.thresholds[k]))]
                yield pa.RecordBatch.from_arrays([b.column(0).slice(s, t - s), *columns], ["id", *(x for c in names for x in (f"p_{c}", c))])

    return source.mapInArrow(task(run, "words"), f"id {id_type}, " + ", ".join(f"p_{c} double, {c} boolean" for c in names)).withColumnRenamed("id", id_col)


def classify(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, p_low_quality, low_quality, p_toxic, toxic, for every row; see `train` and `score`."""
    return score(docs, train(docs, labels))


def reject(docs: DataFrame, chain: Chain, category: str = "toxic", text_col: str = "text") -> DataFrame:
    """The rows of `docs`, all their columns as they are, that don't fall into the category. Null and empty
    texts are judged as texts without words, repeated rows alike; an empty table stays empty."""
    at, k = docs.columns.index(text_col), chain.categories.index(category)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = b.column(at).to_pylist()
            for s, t in slices([x or "" for x in texts]):
                p = _sigmoid(chain.logits(matrix([words(x) for x in texts[s:t]], chain.features)))[:, k]
                yield b.slice(s, t - s).filter(pa.array(p < chain.thresholds[k]))

    return bounded(docs).mapInArrow(task(run, "words"), docs.schema)
