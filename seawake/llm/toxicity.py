"""Toxicity by a classifier chain.

Categories are predicted one after the other. The linear model of each sees the text and
the probabilities of the categories before it; for training these are out-of-fold
predictions, so that a later model does not trust what an earlier one knows by heart.

The models are fitted on a bounded sample of labelled documents; every document is
scored. Features are hashed words and beginnings of words, so that inflected and compound
forms of a word are met too; their values grow with count and share in the text.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seawake.llm.common import NOT_ALNUM, batch, map_arrow, mix, slices, word_hashes
from seawake.session import stored

SPACE = 1 << 18
#: Labelled documents that the models are fitted on, at most.
SAMPLE_ROWS = 10_000
#: Features that a model keeps, at most.
KEPT_FEATURES = 512
LEAST_Z = 3.0
LEAST_DOCUMENTS = 4
FOLDS = 3
RIDGE = 1.0
BEGINNINGS = (4, 5, 6, 8)
FULL_SHARE = 0.02

# --- fixed values ------------------------------------------------------------
#: Words that tell the kind of a toxic text: against persons, and contempt.
INSULTS = ("idiot", "moron", "clown", "loser", "scum")
CONTEMPT = ("disgusting", "pathetic", "trash", "worthless", "stupid")


def features(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``(text, feature, value)`` of the features of all texts, in order. The value grows with
    the number of the words with the feature, and with their share up to ``FULL_SHARE``."""
    coded = [t.lower().encode("utf-8", "surrogatepass") for t in texts]
    keys, n_words = [], np.ones(len(texts))
    for n in (0, *BEGINNINGS):
        hashes, bounds = word_hashes(coded, NOT_ALNUM, first_bytes=n)
        n_words = np.maximum(1, np.diff(bounds))
        row = np.repeat(np.arange(len(texts)), np.diff(bounds))
        keys.append(row * SPACE + (mix(hashes + np.uint64(n)) % np.uint64(SPACE)).astype(np.int64))
    every, counts = np.unique(np.concatenate(keys), return_counts=True)
    row = every // SPACE
    value = np.log1p(counts) * np.minimum(1, counts / (n_words[row] * FULL_SHARE))
    return row, every % SPACE, value.astype(np.float32)


@dataclass
class Rows:
    """A sparse matrix: row numbers in order, columns and values."""

    row: np.ndarray
    column: np.ndarray
    value: np.ndarray
    n_rows: int
    n_columns: int

    def times(self, w: np.ndarray) -> np.ndarray:
        return np.bincount(self.row, self.value * w[self.column], self.n_rows)

    def back(self, v: np.ndarray) -> np.ndarray:
        return np.bincount(self.column, self.value * v[self.row], self.n_columns)


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def logit(p: np.ndarray) -> np.ndarray:
    return np.log(p + 1e-4) - np.log(1 - p + 1e-4)


def fit_linear(x: Rows, dense: np.ndarray, y: np.ndarray, use: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Ridge logistic regression on the rows ``use``: Newton steps by conjugate gradients.
    Returns the weights of the sparse columns, and of the dense ones with the intercept last."""
    k = x.n_columns
    dense = np.column_stack([dense, np.ones(x.n_rows)])
    w = np.zeros(k + dense.shape[1])
    ridge = np.full(len(w), RIDGE)
    ridge[-1] = 1e-6
    weight = use.astype(float)

    def forward(v):
        return x.times(v[:k]) + dense @ v[k:]

    def backward(r):
        return np.concatenate([x.back(r), dense.T @ r])

    for _ in range(8):
        p = sigmoid(forward(w))
        gradient = backward(weight * (p - y)) + ridge * w
        curvature = weight * p * (1 - p)
        step, residual = np.zeros_like(w), -gradient
        direction, norm = residual.copy(), residual @ residual
        first = norm
        for _ in range(10):
            if norm <= 1e-4 * first or norm < 1e-12:
                break
            h = backward(curvature * forward(direction)) + ridge * direction
            a = norm / (direction @ h)
            step += a * direction
            residual -= a * h
            norm, before = residual @ residual, norm
            direction = residual + norm / before * direction
        w += step
        if np.abs(step).max() < 1e-4:
            break
    return w[:k], w[k:]


def telling(seen: np.ndarray, sums: np.ndarray, squares: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The features whose values differ most between two classes, in standard errors.

    ``seen`` counts the texts of a feature; ``sums`` and ``squares`` have a row per class with
    the sums of the features' values and of their squares, ``sizes`` the texts of a class.
    """
    n = np.maximum(1, sizes)[:, None]
    mean = sums / n
    errors = ((squares / n - mean * mean + 1e-3) / n).sum(axis=0)
    z = np.abs(mean[1] - mean[0]) / np.sqrt(errors)
    z[seen < LEAST_DOCUMENTS] = 0
    best = np.argsort(-z, kind="stable")[:KEPT_FEATURES]
    return np.sort(best[z[best] > LEAST_Z])


@dataclass
class Chain:
    """Columns of the features in use, and for each category the weights of the sparse columns and
    of the earlier categories' log odds with the intercept."""

    place: np.ndarray
    sparse: np.ndarray
    dense: list[np.ndarray]

    def probabilities(self, texts: list[str]) -> np.ndarray:
        row, feature, value = features(texts)
        column = self.place[feature]
        keep = column >= 0
        row, column, value = row[keep], column[keep], value[keep]
        before = np.zeros((len(texts), 0))
        for weights, dense in zip(self.sparse, self.dense, strict=True):
            z = np.bincount(row, value * weights[column], len(texts)) + before @ dense[:-1] + dense[-1]
            before = np.column_stack([before, logit(sigmoid(z))])
        return sigmoid(before)


def fit_chain(x: Rows, labels: np.ndarray, fold: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
    """Weights of the sparse columns, and of the earlier categories with the intercept, for each
    category. ``labels`` has a column per category, in the order of the chain."""
    n, k = labels.shape
    before, sparse, dense = np.zeros((n, 0)), [], []
    for c in range(k):
        y = labels[:, c].astype(float)
        out_of_fold = np.zeros(n)
        for f in range(FOLDS):
            own = fold == f
            a, b = fit_linear(x, before, y, ~own)
            out_of_fold[own] = (x.times(a) + before @ b[:-1] + b[-1])[own]
        a, b = fit_linear(x, before, y, np.ones(n, bool))
        sparse.append(a)
        dense.append(b)
        before = np.column_stack([before, logit(sigmoid(out_of_fold))])
    return np.array(sparse).reshape(k, x.n_columns), dense


def _has_word(words: tuple[str, ...]) -> Column:
    return F.lower("text").rlike(r"\b(?:" + "|".join(words) + r")\b")


def toxic_categories(labelled: DataFrame) -> DataFrame:
    """Labels of the chain insult, contempt, toxic for labelled documents (doc_id, text, toxic)."""
    toxic = F.coalesce(F.col("toxic").cast("int"), F.lit(0))
    return labelled.select(
        "doc_id", "text", *[(toxic * F.coalesce(_has_word(w), F.lit(False)).cast("int")).alias(c) for c, w in (("insult", INSULTS), ("contempt", CONTEMPT))],
        toxic.alias("toxic"),
    )


def choose_features(labelled: DataFrame, categories: list[str]) -> np.ndarray:
    """The features that tell most about any category, from sums that the tasks take over their
    texts; what is gathered has at most ``SPACE`` rows."""
    names = [f"{part}_{c}" for c in categories for part in ("sum", "square")]
    schema = pa.schema([("feature", pa.int32()), ("seen", pa.int64()), *[(n, pa.float64()) for n in ("sum", "square", *names)]])

    def add_up(batches):
        seen, totals = np.zeros(SPACE, np.int64), np.zeros((2 + len(names), SPACE))
        for part, texts in slices(batches):
            labels = np.array(part.column(1).to_pylist(), float).reshape(-1, len(categories))
            row, feature, value = features(texts)
            seen += np.bincount(feature, minlength=SPACE)
            for k, of in enumerate([np.ones(len(texts)), *labels.T]):
                totals[2 * k] += np.bincount(feature, value * of[row], SPACE)
                totals[2 * k + 1] += np.bincount(feature, value * value * of[row], SPACE)
        some = np.flatnonzero(seen)
        yield batch(schema, some, seen[some], *totals[:, some])

    sums = map_arrow(labelled.select("text", "labels"), add_up, schema).groupBy("feature")
    found = sums.agg(*[F.sum(f.name).alias(f.name) for f in schema][1:]).toArrow().to_pandas()
    at = found["feature"].to_numpy(np.int64)
    seen = np.zeros(SPACE)
    seen[at] = found["seen"]
    sizes = labelled.agg(F.count("*"), *[F.sum(F.col("labels")[k]) for k in range(len(categories))]).first()
    chosen = [np.zeros(0, np.int64)]
    for k, c in enumerate(categories):
        sums, squares = np.zeros((2, SPACE)), np.zeros((2, SPACE))
        sums[1, at], squares[1, at] = found[f"sum_{c}"], found[f"square_{c}"]
        sums[0, at], squares[0, at] = found["sum"] - found[f"sum_{c}"], found["square"] - found[f"square_{c}"]
        positive = sizes[k + 1] or 0
        chosen.append(telling(seen, sums, squares, np.array([sizes[0] - positive, positive])))
    return np.unique(np.concatenate(chosen))


SAMPLED = pa.schema([("doc_id", pa.int64()), ("column", pa.binary()), ("value", pa.binary()), ("labels", pa.list_(pa.int32()))])


def train(labelled: DataFrame, categories: list[str]) -> Chain:
    """Fits the chain on labelled documents (doc_id, text and a 0/1 column per category). The
    caller bounds their number, see ``sample_labels``; of each the chosen features are gathered."""
    rows = labelled.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.array(*[F.col(c).cast("int") for c in categories]).alias("labels"))
    rows = stored(rows, "labelled")
    chosen = choose_features(rows, categories)
    place = np.full(SPACE, -1, np.int32)
    place[chosen] = np.arange(len(chosen))
    held = labelled.sparkSession.sparkContext.broadcast(place)

    def emit(batches):
        for part, texts in slices(batches):
            row, feature, value = features(texts)
            column = held.value[feature]
            keep = column >= 0
            row, column, value = row[keep], column[keep], value[keep]
            cut = np.searchsorted(row, np.arange(len(texts) + 1))
            spans = list(zip(cut[:-1], cut[1:], strict=True))
            yield batch(SAMPLED, part.column(0), *[[x[lo:hi].tobytes() for lo, hi in spans] for x in (column, value)], part.column(2))

    found = map_arrow(rows, emit, SAMPLED).toArrow().sort_by("doc_id")
    parts = [np.frombuffer(b, np.int32) for b in found["column"].to_pylist()]
    labels = np.array(found["labels"].to_pylist(), np.int64).reshape(-1, len(categories))
    value = np.concatenate([np.frombuffer(b, np.float32) for b in found["value"].to_pylist()] + [np.zeros(0, np.float32)])
    row = np.repeat(np.arange(len(parts)), [len(p) for p in parts])
    x = Rows(row, np.concatenate([*parts, np.zeros(0, np.int32)]), value, len(parts), len(chosen))
    fold = (mix(found["doc_id"].to_numpy().astype(np.uint64)) % np.uint64(FOLDS)).astype(np.int64)
    return Chain(place, *fit_chain(x, labels, fold))


def sample_labels(labels: DataFrame, rows: int = SAMPLE_ROWS) -> DataFrame:
    """At most ``rows`` labelled doc_ids, the first in the order of a hash; repeated labels of a
    document are one, the greatest."""
    usable = labels.where("doc_id IS NOT NULL AND toxic IS NOT NULL").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    return usable.orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)


CATEGORIES = ["insult", "contempt", "toxic"]
#: From this probability of the last category on a document is toxic.
THRESHOLD = 0.5


def fitted_chain(docs: DataFrame, labels: DataFrame) -> Chain:
    """The chain for ``docs`` (doc_id, text), fitted on a sample of those in ``labels``."""
    sample = F.broadcast(sample_labels(labels))  # SAMPLE_ROWS rows of two numbers at most
    return train(toxic_categories(docs.select("doc_id", "text").join(sample, "doc_id")), CATEGORIES)


def judge(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """``(doc_id, p_insult, p_contempt, p_toxic, toxic, kept)`` for every row of ``docs`` (doc_id,
    text; other columns are ignored), by a chain fitted on ``labels`` (doc_id, toxic).

    A null or empty text is judged as one without words. Repeated rows and rows without
    doc_id are judged each. Without labels every document is kept, with
    probabilities of a half or less. An empty table gives no rows.
    """
    chain = fitted_chain(docs, labels)
    fitted = docs.sparkSession.sparkContext.broadcast((chain.place, chain.sparse, chain.dense))

    def score(batches):
        own = Chain(*fitted.value)
        for part, texts in slices(batches):
            p = own.probabilities(texts)
            toxic = p[:, -1] > threshold
            yield batch(JUDGED, part.column(0), *p.T, toxic, ~toxic)

    return map_arrow(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), score, JUDGED)


def keep_clean(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs`` that ``judge`` keeps, with all their columns, whatever their names."""
    chain = fitted_chain(docs, labels)
    fitted = docs.sparkSession.sparkContext.broadcast((chain.place, chain.sparse, chain.dense))
    at = docs.columns.index("text")

    def choose(batches):
        own = Chain(*fitted.value)
        for b in batches:
            named = pa.RecordBatch.from_arrays(b.columns, [str(k) for k in range(b.num_columns)])
            for part, texts in slices(iter([named]), str(at)):
                kept = part.filter(pa.array(own.probabilities(texts)[:, -1] <= threshold))
                yield pa.RecordBatch.from_arrays(kept.columns, schema=b.schema)

    return map_arrow(docs, choose, docs.schema)


JUDGED = pa.schema([("doc_id", pa.int64()), *[(f"p_{c}", pa.float64()) for c in CATEGORIES], ("toxic", pa.bool_()), ("kept", pa.bool_())])
