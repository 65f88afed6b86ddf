"""Toxicity by a classifier chain.

Categories are predicted one after another by linear models; each later model also sees the probabilities of the
categories before it. In training those are out-of-fold predictions, so a later model learns how far to trust what it
will see at prediction time. Features are a text's distinct words and their beginnings of 4, 5 and 6 letters (present
or not), and a few shares of its characters.

The models are trained on the driver on a bounded sample of labelled rows: up to SAMPLE of each class of the last
labelled category, those with the least hash of doc_id, among texts of LONGEST characters at most. Prediction covers all
rows, a block of texts at once. The model is a few thousand weights and travels with the function.

Categories of the registered query, in order: low_quality (label quality = 0), toxic (label toxic = 1), and
severe_toxic. The labels know one toxicity only; severe_toxic is made out of it (toxic, with at least SEVERE_MARKS
occurrences of words that mark toxic documents), and low_quality is there for what it tells the models after it.

Defined results: a null or empty text gets the probabilities of a text without words; a text of any length is read whole;
rows whose label is null are not trained on; a category with one class in the sample is predicted as that class's share;
without labelled rows every probability is 0.5; repeated rows give repeated results; an empty table gives an empty
result; extra columns are not read, whatever they are called.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field
from zlib import crc32

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import runs, table

#: Labelled rows of each class, and characters of a text, that training takes at most.
SAMPLE, LONGEST = 3000, 200_000
FOLDS, SEVERE_MARKS, THRESHOLD = 4, 6, 0.5
#: How far a feature's share must differ between the classes, in standard errors, and in how many texts it must occur.
TELLING, SUPPORT = 5.0, 3
_SHARES = [r"[#*$%&|<>@^~{}\[\]\\/_=+]", "[A-ZÀ-ÖØ-Þ]", "[0-9]"]
_EDGE = "\t\n.,;:!?'\"()[]{}<>*#$%&|-_/\\+=~^@`…“”‘’«»"
#: Bytes of text scored at once, and of text whose features the driver computes at once.
BLOCK, TRAINED = 8_000_000, 500_000
DENSE = len(_SHARES)
MASK = (1 << 22) - 1


def word_features(word: str) -> list[int]:
    """A word's own feature and those of its beginnings, hashed to 22 bits."""
    return [crc32(x.encode()) & MASK for x in (word, *(f"{word[:n]}~" for n in (4, 5, 6) if len(word) >= n))]


@dataclass
class Linear:
    """A logistic model over chosen features, the dense ones and the earlier probabilities."""

    features: dict[int, int] = field(default_factory=dict)
    weights: np.ndarray = field(default_factory=lambda: np.zeros(DENSE + 1))
    prior: float | None = None


class _Rows:
    """Documents' features: for each presence, its document and its feature, documents in order, features ascending. With
    `wanted`, only those features."""

    def __init__(self, texts: pa.Array, wanted: np.ndarray | None = None, block: int | None = None):
        self.n = len(texts)
        #: For each run of texts of `block` bytes (all of them at once, if None): each occurrence of a word that has
        #: features, its document and the word, and the words' numbers of features and the features.
        self.parts = []
        rows, features, extra = [], [], []
        for start, n in runs(texts, block) if block else [(0, self.n)]:
            some = texts.slice(start, n)
            row, feature = self._read(pc.utf8_split_whitespace(pc.utf8_lower(some)), start, wanted)
            rows.append(row)
            features.append(feature)
            length = np.maximum(pc.utf8_length(some).to_numpy(), 1)
            extra.append(np.stack([pc.count_substring_regex(some, p).to_numpy() / length for p in _SHARES], axis=1).reshape(n, DENSE))
        self.row = np.concatenate([np.empty(0, dtype=np.int32), *rows])
        self.feature = np.concatenate([np.empty(0, dtype=np.int32), *features])
        self.extra = np.concatenate([np.empty((0, DENSE)), *extra])

    def _read(self, cut: pa.Array, start: int, wanted: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
        """The presences of a run of texts, of which the first is document `start`."""
        coded = cut.flatten().dictionary_encode()
        found = [word_features(w) if w else [] for w in pc.utf8_trim(coded.dictionary, characters=_EDGE).to_pylist()]
        sizes = np.fromiter(map(len, found), dtype=np.int64, count=len(found))
        of = np.fromiter((f for fs in found for f in fs), dtype=np.int64, count=int(sizes.sum()))
        if wanted is not None:
            word = np.repeat(np.arange(len(found)), sizes)
            word, of = word[wanted[of]], of[wanted[of]]
            sizes = np.bincount(word, minlength=len(found))
        at, word = np.repeat(np.arange(len(cut)), np.diff(cut.offsets.to_numpy())), coded.indices.to_numpy()
        some = sizes[word] > 0
        at, word, starts = at[some], word[some], np.cumsum(sizes) - sizes
        self.parts.append(((at + start).astype(np.int32), word.astype(np.int32), sizes, of))
        once = np.unique(at * max(1, len(found)) + word)
        at, word = once // max(1, len(found)), once % max(1, len(found))
        k = sizes[word]
        place = np.repeat(starts[word] - (np.cumsum(k) - k), k) + np.arange(int(k.sum()))
        keys = np.unique(np.repeat(at, k) * (MASK + 1) + of[place])
        return (keys // (MASK + 1) + start).astype(np.int32), (keys % (MASK + 1)).astype(np.int32)

    def chosen(self, features: dict[int, int]) -> tuple[np.ndarray, np.ndarray]:
        to = np.full(MASK + 1, -1, dtype=np.int32)
        to[list(features)] = list(features.values())
        col = to[self.feature]
        return self.row[col >= 0], col[col >= 0]

    def occurrences(self, telling: np.ndarray) -> np.ndarray:
        """How many words of each document have a feature that is `telling` (by feature)."""
        out = np.zeros(self.n)
        for at, word, sizes, of in self.parts:
            has = np.bincount(np.repeat(np.arange(len(sizes)), sizes), weights=telling[of], minlength=len(sizes)) > 0
            out += np.bincount(at, weights=has[word], minlength=self.n)
        return out


def _choose(rows: _Rows, y: np.ndarray, train: np.ndarray, limit: int = 600) -> dict[int, int]:
    """The features whose presence among the documents in `train` differs most between the classes, by number where
    equal."""
    one, zero = train & (y == 1), train & (y == 0)
    a = np.bincount(rows.feature[one[rows.row]], minlength=MASK + 1)
    b = np.bincount(rows.feature[zero[rows.row]], minlength=MASK + 1)
    known = np.flatnonzero(a + b >= SUPPORT)
    a, b = a[known], b[known]
    n1, n0 = max(int(one.sum()), 1), max(int(zero.sum()), 1)
    p = (a + b) / (n1 + n0)
    z = np.abs(a / n1 - b / n0) / np.sqrt(p * (1 - p) * (1 / n1 + 1 / n0) + 1e-12)
    at = np.flatnonzero(z > TELLING)
    return {int(f): i for i, f in enumerate(known[at[np.lexsort((at, -z[at]))][:limit]])}


def _fit(at: np.ndarray, col: np.ndarray, extra: np.ndarray, y: np.ndarray, n_features: int, l2: float = 1e-4, steps: int = 600) -> np.ndarray:
    """Logistic regression with balanced classes, by Nesterov's accelerated gradient"""
    n = len(y)
    x_extra = np.c_[extra, np.ones(n)]
    size = n_features + x_extra.shape[1]
    weight = np.where(y == 1, 0.5 / max(y.mean(), 1e-9), 0.5 / max(1 - y.mean(), 1e-9)) / n
    row_norm = np.bincount(at, minlength=n) + (x_extra**2).sum(axis=1)
    step = 4.0 / (np.percentile(row_norm, 95) * 2)
    w = v = np.zeros(size)
    t = 1.0
    reg = np.r_[np.full(size - 1, l2), 0.0]
    for _ in range(steps):
        z = np.bincount(at, weights=v[col], minlength=n) + x_extra @ v[n_features:]
        g = weight * (1 / (1 + np.exp(-np.clip(z, -30, 30))) - y)
        grad = np.r_[np.bincount(col, weights=g[at], minlength=n_features), x_extra.T @ g] + reg * v
        new = v - step * grad
        t2 = (1 + np.sqrt(1 + 4 * t * t)) / 2
        v = new + (t - 1) / t2 * (new - w)
        w, t = new, t2
    return w


def _train(rows: _Rows, extra: np.ndarray, y: np.ndarray, train: np.ndarray) -> Linear:
    if len(set(y[train].tolist())) < 2:
        return Linear(prior=float(y[train].mean()) if train.any() else 0.5)
    features = _choose(rows, y, train)
    row, col = rows.chosen(features)
    inside = train[row]
    return Linear(features, _fit((np.cumsum(train) - 1)[row[inside]], col[inside], extra[train], y[train], len(features)))


def _predict(model: Linear, rows: _Rows, extra: np.ndarray) -> np.ndarray:
    if model.prior is not None:
        return np.full(rows.n, model.prior)
    row, col = rows.chosen(model.features)
    z = np.bincount(row, weights=model.weights[col], minlength=rows.n) + np.c_[extra, np.ones(rows.n)] @ model.weights[len(model.features) :]
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def _column(texts: list[str | None]) -> pa.Array:
    return pa.array([t or "" for t in texts], pa.large_string())


def train_chain(texts: list[str], labels: np.ndarray, folds: int = FOLDS) -> list[Linear]:
    """A model for each column of `labels` (0 or 1, documents x categories), in order."""
    rows = _Rows(_column(texts), block=TRAINED)
    extra = rows.extra
    fold = np.arange(len(texts)) % folds
    every = np.ones(len(texts), dtype=bool)
    models = []
    for k in range(labels.shape[1]):
        y = labels[:, k].astype(np.float64)
        models.append(_train(rows, extra, y, every))
        if k + 1 < labels.shape[1]:
            out = np.full(len(texts), 0.5)
            for f in range(folds):
                if (fold == f).any() and (fold != f).any():
                    out[fold == f] = _predict(_train(rows, extra, y, fold != f), rows, extra)[fold == f]
            extra = np.c_[extra, out]
    return models


class Chain:
    """Prediction: each model sees the probabilities of those before it."""

    def __init__(self, models: list[Linear]):
        self.models = models
        self.wanted = np.zeros(MASK + 1, dtype=bool)
        for m in models:
            self.wanted[list(m.features)] = True

    def predict(self, texts: pa.Array) -> np.ndarray:
        """Documents x categories, of a large_string array without nulls."""
        rows = _Rows(texts, self.wanted)
        extra = rows.extra
        for m in self.models:
            extra = np.c_[extra, _predict(m, rows, extra)]
        return extra[:, DENSE:]


def labelled_sample(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> tuple[list[str], np.ndarray]:
    """Texts and (low_quality, toxic) of up to `sample` toxic and as many other labelled rows, by the least hash; of them,
    those of LONGEST characters at most."""
    chosen = labels.filter("doc_id is not null and quality is not null and toxic is not null").groupBy("doc_id").agg(F.min("quality").alias("quality"), F.max("toxic").alias("toxic"))
    picks = [chosen.filter(F.col("toxic") == c).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample) for c in (1, 0)]
    one = docs.filter(F.col("doc_id").isNotNull() & (F.coalesce(F.length("text"), F.lit(0)) <= LONGEST)).select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    got = one.join(F.broadcast(picks[0].union(picks[1])), "doc_id").groupBy("doc_id").agg(F.min("text").alias("text"), F.min("quality").alias("quality"), F.max("toxic").alias("toxic"))
    rows = got.orderBy(F.xxhash64("doc_id"), "doc_id").collect()  # 2 * sample rows at most, of bounded length
    return [r["text"] for r in rows], np.array([[int(r["quality"] == 0), int(r["toxic"] == 1)] for r in rows]).reshape(len(rows), 2)


def severe(texts: list[str], toxic: np.ndarray, marks: int = SEVERE_MARKS) -> np.ndarray:
    """Toxic texts with `marks` or more occurrences of words that have a feature found in toxic texts almost only."""
    rows = _Rows(_column(texts), block=TRAINED)
    pos = np.bincount(rows.feature[(toxic == 1)[rows.row]], minlength=MASK + 1)
    neg = np.bincount(rows.feature[(toxic == 0)[rows.row]], minlength=MASK + 1)
    return ((toxic == 1) & (rows.occurrences((pos >= 5) & (neg * 50 <= pos)) >= marks)).astype(int)


def score(docs: DataFrame, models: list[Linear], names: list[str], keep: list[str]) -> DataFrame:
    """The columns `keep` and one probability for each category."""
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.select(*keep).schema.fields)
    held = docs.sparkSession.sparkContext.broadcast(models)  # a few thousand weights
    columns = [f"p_{n}" for n in names]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chain = Chain(held.value)
        for b in batches:
            texts = pc.fill_null(b.column(0).cast(pa.large_string()), "")
            for at, n in runs(texts, BLOCK):
                p = chain.predict(pa.concat_arrays([texts.slice(at, n)]))
                yield pa.RecordBatch.from_arrays([*(c.slice(at, n) for c in b.columns[1:]), *(pa.array(p[:, k]) for k in range(len(columns)))], names=[*b.schema.names[1:], *columns])

    return docs.select("text", *keep).mapInArrow(run, f"{fields}, " + ", ".join(f"{c} double" for c in columns))


def op8_toxicity(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    texts, labels = labelled_sample(docs, table(spark, sf_dir, "labels"))
    names = ["low_quality", "toxic", "severe_toxic"]
    labels = np.c_[labels, severe(texts, labels[:, 1])] if len(texts) else np.zeros((0, 3), dtype=int)
    out = score(docs, train_chain(texts, labels), names, ["doc_id"])
    return out.withColumn("toxic", F.col("p_toxic") >= THRESHOLD)
