"""Toxicity by classifier chains.

A chain predicts the categories one after the other. Each model is a logistic regression on
the presence of word features and, from the second category on, the log odds of the earlier
categories. While training, the earlier categories' log odds of a document come from models
that did not see it (out-of-fold), as they will when new documents are scored.

Features are exact 64-bit hashes: of words (runs of letters, A-Z lower-cased), of runs of
other marks, and of a word that repeats the one before; plus whether most letters are capital.
A model uses the features whose presence depends on its category in the training rows.

The models are fitted on at most `LABELLED` labelled documents (those with the smallest hash
of their identifier), a bounded sample; every document's whole text is scored. The threshold
of a category is the one with the best F1 score of the out-of-fold probabilities.

Defined results: a null text counts as empty and has the probabilities of a document without
features; a category of which the sample has one value only gets that value's probability
(without any labels: 0) and its flag follows it; repeated labels of a document are averaged (0.5 and more is 1), null ones
left out; repeated rows repeat; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .tables import small_batches
from .words import Words, mix, slices

LABELLED = 12_000
FOLDS = 5
#: A feature needs so many training documents and so large a chi-squared statistic.
LEAST_DOCS = 4
LEAST_CHI2 = 24.0
RIDGE = 0.02
STEPS = 200

_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
_LETTER = np.zeros(256, dtype=bool)
_LETTER[[*range(ord("A"), ord("Z") + 1), *range(ord("a"), ord("z") + 1), *range(0x80, 0x100)]] = True
_CAPITALS, _AGAIN = np.uint64(0xC0FFEE), np.uint64(0xC0FFEF)


def features(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(text number, feature) of all features of the texts, repeats included."""
    words = Words(column, lower=True, between=~_LETTER)
    marks = Words(column, between=_LETTER | _SPACE)
    hashes = words.hashes()
    again = np.flatnonzero((hashes[1:] == hashes[:-1]) & (words.text[1:] == words.text[:-1])) + 1
    capital = (marks.data >= ord("A")) & (marks.data <= ord("Z"))
    letters, capitals = (np.diff(np.append(0, np.cumsum(x))[marks.offsets]) for x in (_LETTER[marks.data], capital))
    most = np.flatnonzero(2 * capitals > letters)
    text = np.concatenate([words.text, marks.text, words.text[again], most])
    return text, np.concatenate([hashes, mix(marks.hashes() + np.uint64(1)), np.full(len(again), _AGAIN),
                                 np.full(len(most), _CAPITALS)])


def distinct_features(column: pa.Array) -> list[np.ndarray]:
    """Each text's distinct features, sorted."""
    text, value = features(column)
    order = np.argsort(text, kind="stable")
    edge, value = np.searchsorted(text[order], np.arange(len(column) + 1)), value[order]
    return [np.unique(value[a:b]) for a, b in zip(edge[:-1].tolist(), edge[1:].tolist(), strict=True)]


@dataclass
class Present:
    """Which of some known features documents have: distinct pairs (doc, col)."""
    doc: np.ndarray
    col: np.ndarray
    n_docs: int

    @staticmethod
    def of(doc: np.ndarray, value: np.ndarray, n_docs: int, known: np.ndarray) -> Present:
        at = np.minimum(np.searchsorted(known, value), max(len(known) - 1, 0))
        hit = known[at] == value if len(known) else np.zeros(len(value), dtype=bool)
        pair = np.unique(doc[hit] * max(len(known), 1) + at[hit])
        return Present(*np.divmod(pair, max(len(known), 1)), n_docs)

    def dot(self, weights: np.ndarray) -> np.ndarray:
        return np.bincount(self.doc, weights[self.col], minlength=self.n_docs)


@dataclass
class Model:
    """log odds = bias + weights of the known features present + extra . earlier log odds."""
    known: np.ndarray
    weights: np.ndarray
    extra: np.ndarray
    bias: float

    def log_odds(self, doc: np.ndarray, value: np.ndarray, earlier: np.ndarray) -> np.ndarray:
        return Present.of(doc, value, len(earlier), self.known).dot(self.weights) + earlier @ self.extra + self.bias


def chosen_features(doc: np.ndarray, value: np.ndarray, y: np.ndarray) -> np.ndarray:
    """The features whose presence depends on y, by a chi-squared test with Yates' correction."""
    known, at = np.unique(value, return_inverse=True)
    n, ones = len(y), y.sum()
    df = np.bincount(at, minlength=len(known)).astype(float)
    both = np.bincount(at, y[doc], minlength=len(known))
    gap = np.maximum(np.abs(both * n - df * ones) - n / 2, 0)
    chi2 = n * gap ** 2 / np.maximum(df * (n - df) * ones * (n - ones), 1)
    return known[(df >= LEAST_DOCS) & (chi2 >= LEAST_CHI2)]


def train(doc: np.ndarray, value: np.ndarray, earlier: np.ndarray, y: np.ndarray) -> Model:
    """Ridge logistic regression by accelerated gradient steps, each coordinate at its own pace."""
    n, k = earlier.shape
    if not n or y.min() == y.max():
        share = (y.sum() + 1e-3) / (n + 2e-3) if n else 1e-9
        return Model(np.zeros(0, np.uint64), np.zeros(0), np.zeros(k), float(np.log(share / (1 - share))))
    known = chosen_features(doc, value, y)
    x, m = Present.of(doc, value, n, known), len(known)
    # a diagonal bound of the curvature: a quarter of each column's sum of row norms
    row = np.bincount(x.doc, minlength=n) + np.abs(earlier).sum(axis=1) + 1
    bound = 0.25 * np.concatenate([np.bincount(x.col, row[x.doc], minlength=m), np.abs(earlier).T @ row, [row.sum()]])
    bound += RIDGE
    w = np.zeros(m + k + 1)
    w[-1] = np.log(y.mean() / (1 - y.mean()))
    ahead = w.copy()
    for step in range(STEPS):
        odds = x.dot(ahead[:m]) + earlier @ ahead[m:m + k] + ahead[-1]
        error = 1 / (1 + np.exp(-odds)) - y
        gradient = np.concatenate([np.bincount(x.col, error[x.doc], minlength=m), earlier.T @ error, [error.sum()]])
        gradient[:-1] += RIDGE * ahead[:-1]
        new = ahead - gradient / bound
        ahead = new + step / (step + 3) * (new - w)
        w = new
    return Model(known, w[:m], w[m:m + k], float(w[-1]))


@dataclass
class Chain:
    models: list[Model]
    thresholds: list[float]  # of the log odds

    def log_odds(self, doc: np.ndarray, value: np.ndarray, n_docs: int) -> np.ndarray:
        """One column a category."""
        out = np.zeros((n_docs, 0))
        for model in self.models:
            out = np.column_stack([out, np.clip(model.log_odds(doc, value, out), -30, 30)])
        return out


def train_chain(texts: list[np.ndarray], labels: np.ndarray, folds: int = FOLDS) -> Chain:
    """Fits the chain to documents' distinct features and labels (0 or 1, one column a category)."""
    n, fold = len(texts), np.arange(len(texts)) % folds
    doc = np.repeat(np.arange(n), [len(t) for t in texts])
    value = np.concatenate(texts) if n else np.zeros(0, np.uint64)
    models, thresholds, earlier = [], [], np.zeros((n, 0))
    for y in labels.T:
        unseen = np.zeros(n)
        for f in range(folds):
            out = fold == f
            number = np.cumsum(~out) - 1
            mine = ~out[doc]
            model = train(number[doc[mine]], value[mine], earlier[~out], y[~out])
            number = np.cumsum(out) - 1
            unseen[out] = model.log_odds(number[doc[~mine]], value[~mine], earlier[out])
        models.append(train(doc, value, earlier, y))
        thresholds.append(best_threshold(unseen, y))
        earlier = np.column_stack([earlier, np.clip(unseen, -30, 30)])
    return Chain(models, thresholds)


def best_threshold(log_odds: np.ndarray, y: np.ndarray) -> float:
    """The middle of the gap below the best F1 score; 0 where there is no choice."""
    if not len(y) or y.min() == y.max():
        return 0.0
    order = np.argsort(-log_odds, kind="stable")
    odds, hits = log_odds[order], np.cumsum(y[order])
    f1 = 2 * hits / (np.arange(1, len(y) + 1) + y.sum())
    f1[:-1][odds[1:] == odds[:-1]] = -1  # equal log odds stay together
    best = int(np.argmax(f1))
    return float((odds[best] + odds[min(best + 1, len(odds) - 1)]) / 2)


def fit(docs: DataFrame, labels: DataFrame, categories: Sequence[str], id_col: str = "doc_id",
        text_col: str = "text", most: int = LABELLED) -> Chain:
    """The chain of the categories (columns of `labels`, 0 or 1), fitted to a bounded sample."""
    each = labels.select(F.col(f"`{id_col}`").alias("label_id"), *[F.col(f"`{c}`").cast("double").alias(f"y{i}")
                                                                   for i, c in enumerate(categories)])
    ys = [f"y{i}" for i in range(len(categories))]
    each = (each.where(" and ".join(["label_id is not null", *[f"{y} is not null and not isnan({y})" for y in ys]]))
            .groupBy("label_id").agg(*[(F.avg(y) >= 0.5).cast("int").alias(y) for y in ys]))
    sample = each.orderBy(F.xxhash64("label_id"), "label_id").limit(most)  # so it may be broadcast
    rows = (docs.select(F.col(f"`{id_col}`").alias("id"), F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("text"))
            .join(F.broadcast(sample), F.col("id") == F.col("label_id")).dropDuplicates(["label_id"]).drop("id"))
    types = {"label_id": sample.schema["label_id"].dataType.simpleString(), **dict.fromkeys(ys, "int"), "features": "binary"}

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b in slices(batch.column("text")):
                part = batch.slice(a, b - a)
                found = distinct_features(part.column("text"))
                yield pa.RecordBatch.from_arrays([*[part.column(c) for c in ("label_id", *ys)],
                                                  pa.array([x.tobytes() for x in found], pa.binary())], names=list(types))

    table = small_batches(rows).mapInArrow(extract, ", ".join(f"{k} {v}" for k, v in types.items())).orderBy("label_id").toArrow()
    texts = [np.frombuffer(x, dtype=np.uint64) for x in table.column("features").to_pylist()]
    return train_chain(texts, np.column_stack([table.column(y).to_numpy() for y in ys]).astype(float))


def score(docs: DataFrame, chain: Chain, categories: Sequence[str], id_col: str = "doc_id",
          text_col: str = "text") -> DataFrame:
    """One row per document: identifier, a probability `p_<category>` and a flag `<category>` each."""
    rows = docs.select(F.col(f"`{id_col}`").alias("id"), F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("text"))
    id_type = rows.schema["id"].dataType.simpleString()
    shared = docs.sparkSession.sparkContext.broadcast(chain)

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chain = shared.value
        for batch in batches:
            for a, b in slices(batch.column("text")):
                part = batch.slice(a, b - a)
                odds = chain.log_odds(*features(part.column("text")), b - a)
                out = [part.column("id")]
                for i, threshold in enumerate(chain.thresholds):
                    out += [pa.array(1 / (1 + np.exp(-odds[:, i]))), pa.array(odds[:, i] >= threshold)]
                yield pa.RecordBatch.from_arrays(out, names=names)

    names = ["id", *[x for i in range(len(categories)) for x in (f"p{i}", f"is{i}")]]
    kinds = [id_type, *["double", "boolean"] * len(categories)]
    out = small_batches(rows).mapInArrow(scored, ", ".join(f"{n} {k}" for n, k in zip(names, kinds, strict=True)))
    return out.select(F.col("id").alias(id_col), *[F.col(x).alias(y) for i, c in enumerate(categories)
                                                   for x, y in ((f"p{i}", f"p_{c}"), (f"is{i}", c))])


def classify(docs: DataFrame, labels: DataFrame, categories: Sequence[str], id_col: str = "doc_id",
             text_col: str = "text") -> DataFrame:
    """Fits the chain and scores every document."""
    return score(docs, fit(docs, labels, categories, id_col, text_col), categories, id_col, text_col)
