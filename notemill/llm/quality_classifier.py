"""Quality classifier (operator 1): random-indexing word vectors, pooled by document, and a two-layer network.

Every word and every word shape (case, symbols, digits, length, echo of what came before) has a sparse ternary index
vector drawn from its hash; a word's vector is the sum of its neighbours' index vectors in the training texts. A
document is the mean of its words' vectors, the mean of its shapes' vectors and its length. A network of one hidden layer
gives a logit, and a temperature fitted on a fifth of the sample that the network did not see calibrates it.

Vectors, network and temperature are fitted on at most ``TRAIN_DOCS`` labelled documents outside the held-out fold, chosen by a
hash of the id; every document is scored, whole. The only input of a score is the text.

Defined results: null text is empty; an empty text is scored like any other, by a document vector of zeros; without labels
of both kinds every score is the share of good labels (0.5 without any); equal texts get equal scores; a null doc_id
stays null; other columns are ignored (or passed through by ``filter_documents``); an empty table gives an empty result.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import textcore as tc
from .folds import fold, labelled_sample
from .worker import release, releasing

TRAIN_DOCS, DIM, HIDDEN, MIN_COUNT, WINDOW = 1500, 64, 32, 3, 2
THRESHOLD = 0.3
#: Words whose vectors are summed at once.
POOL_WORDS = 1 << 16
_CLASS = {name: np.isin(np.arange(256), list(chars)) for name, chars in {
    "symbol": b"#*$%&<>|~^=@\\", "upper": range(65, 91), "letter": [*range(65, 91), *range(97, 123), *range(128, 256)], "bang": b"!?", "digit": range(48, 58), "stop": b".,;:",
}.items()}


def shapes(t: tc.Texts) -> np.ndarray:
    """Small integer that says what each word looks like."""
    n = {k: tc.count_in(v, t.buf, t.start, t.end) for k, v in _CLASS.items()}
    size = t.end - t.start
    echo = np.zeros(len(size), bool)
    echo[1:] = t.hash[1:] == t.hash[:-1]
    bits = [n["symbol"] > 0, n["bang"] > 0, n["digit"] > 0, n["stop"] > 0, (n["upper"] > 1) & (2 * n["upper"] >= n["letter"]), n["letter"] == 0, echo, tc.repeat_words(t)]
    out = np.digitize(size, [3, 6, 10, 16, 40])
    for b in bits:
        out = 2 * out + b
    return out


def index_vectors(h: np.ndarray) -> np.ndarray:
    """Ternary vectors with six entries drawn from each hash."""
    out, rows = np.zeros((len(h), DIM), np.float32), np.arange(len(h))
    for k in range(6):
        h = tc.mix(h + np.uint64(0x9E3779B97F4A7C15))
        np.add.at(out, (rows, (h % np.uint64(DIM)).astype(np.int64)), np.where(h >> np.uint64(63), 1.0, -1.0).astype(np.float32))
    return out


@dataclass(frozen=True)
class Model:
    words: np.ndarray  # sorted hashes
    vectors: np.ndarray  # of the words, then one of zeros for others
    shape_vectors: np.ndarray
    centre: np.ndarray
    scale: np.ndarray
    layers: tuple[np.ndarray, ...]
    temperature: float
    constant: float | None = None

    def ids(self, h: np.ndarray) -> np.ndarray:
        at = np.searchsorted(self.words, h)
        at[at == len(self.words)] = 0
        return np.where(self.words[at] == h, at, len(self.words)) if len(self.words) else np.zeros(len(h), np.int64)

    def pool(self, t: tc.Texts) -> np.ndarray:
        n = np.maximum(t.n_words, 1)[:, None]
        out = np.zeros((t.n, 2 * DIM + 1), np.float32)
        if len(t.start):
            shape = shapes(t)
            # Each text is cut from its own first word, so that equal texts have equal sums wherever they stand.
            parts = -(-t.n_words // POOL_WORDS)
            of = np.repeat(np.arange(t.n), parts)
            at = t.first[of] + POOL_WORDS * (np.arange(len(of)) - np.repeat(np.cumsum(parts) - parts, parts))
            ends = np.append(at[1:], len(t.start))
            i = 0
            while i < len(at):
                j = max(i + 1, int(np.searchsorted(ends, at[i] + POOL_WORDS, side="right")))
                some = slice(at[i], ends[j - 1])
                for k, v in ((0, self.vectors[self.ids(t.hash[some])]), (DIM, self.shape_vectors[shape[some]])):
                    np.add.at(out[:, k : k + DIM], of[i:j], np.add.reduceat(v.astype(np.float32), at[i:j] - at[i]))
                i = j
        out[:, : 2 * DIM] /= n
        out[:, -1] = np.log1p(t.n_words)
        return out

    def logits(self, x: np.ndarray) -> np.ndarray:
        w1, b1, w2, b2 = self.layers
        return np.tanh(((x - self.centre) / self.scale) @ w1 + b1) @ w2 + b2

    def score(self, t: tc.Texts) -> np.ndarray:
        if self.constant is not None:
            return np.full(t.n, self.constant)
        return 1 / (1 + np.exp(-np.clip(self.logits(self.pool(t)) / self.temperature, -30, 30)))


def _constant(share: float) -> Model:
    none = np.zeros(0, np.uint64)
    return Model(none, np.zeros((1, DIM)), np.zeros((2048, DIM)), np.zeros(1), np.ones(1), (), 1.0, share)


def _word_vectors(texts: list[str]):
    """(words, vectors, shape vectors) from the neighbours of each occurrence."""
    parts = [(t.hash, shapes(t), t.doc_of_word() + i) for i, _, t in tc.chunks(pa.array(texts, pa.large_string()))]
    h, shape, doc = (np.concatenate(x) for x in zip(*parts, strict=True))
    words, count = np.unique(h, return_counts=True)
    words = words[count >= MIN_COUNT]
    at = np.searchsorted(words, h)
    at[at == len(words)] = 0
    ids = np.where(words[at] == h, at, len(words)) if len(words) else np.zeros(len(h), np.int64)
    index = np.vstack([index_vectors(words), np.zeros((1, DIM), np.float32)])
    shape_index = index_vectors(tc.mix(np.arange(2048, dtype=np.uint64)))
    out, shape_out = np.zeros((len(words) + 1, DIM), np.float32), np.zeros((2048, DIM), np.float32)
    for d in range(DIM):
        around = np.zeros(len(h), np.float32)
        value = index[ids, d] + shape_index[shape, d]
        for k in range(1, WINDOW + 1):
            same = doc[k:] == doc[:-k]
            around[k:] += np.where(same, value[:-k], 0)
            around[:-k] += np.where(same, value[k:], 0)
        out[:, d] = np.bincount(ids, around, len(words) + 1)
        shape_out[:, d] = np.bincount(shape, around + shape_index[shape, d], 2048)

    def unit(v):
        return (v / np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-9)).astype(np.float16)

    out[-1] = 0
    return words, unit(out), unit(shape_out)


def _network(x: np.ndarray, y: np.ndarray, steps: int = 300, l2: float = 1e-3) -> tuple[np.ndarray, ...]:
    rng = np.random.default_rng(7)
    params = [rng.normal(0, x.shape[1] ** -0.5, (x.shape[1], HIDDEN)), np.zeros(HIDDEN), rng.normal(0, HIDDEN**-0.5, HIDDEN), np.zeros(1)]
    m, v = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]
    for step in range(1, steps + 1):
        w1, b1, w2, b2 = params
        hid = np.tanh(x @ w1 + b1)
        err = (1 / (1 + np.exp(-np.clip(hid @ w2 + b2, -30, 30))) - y) / len(y)
        back = np.outer(err, w2) * (1 - hid**2)
        grads = [x.T @ back + l2 * w1, back.sum(0), hid.T @ err + l2 * w2, np.array([err.sum()])]
        for k, g in enumerate(grads):
            m[k], v[k] = 0.9 * m[k] + 0.1 * g, 0.99 * v[k] + 0.01 * g**2
            params[k] = params[k] - 0.02 * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.99**step)) + 1e-8)
    return tuple(params)


def train(sample: list[tuple[str, int]]) -> Model:
    y = np.array([label for _, label in sample], float)
    if len(set(y.tolist())) < 2:
        return _constant(float(y.mean()) if len(y) else 0.5)
    texts = [text for text, _ in sample]
    words, vectors, shape_vectors = _word_vectors(texts)
    model = Model(words, vectors, shape_vectors, np.zeros(1), np.ones(1), (), 1.0)
    x = np.concatenate([model.pool(t) for _, _, t in tc.chunks(pa.array(texts, pa.large_string()))])
    held = np.arange(len(y)) % 5 == 0
    if len(set(y[~held].tolist())) < 2:
        held[:] = False
    centre, scale = x[~held].mean(0), np.maximum(x[~held].std(0), 1e-4)
    layers = _network((x[~held] - centre) / scale, y[~held])
    model = Model(words, vectors, shape_vectors, centre, scale, layers, 1.0)
    test = held if held.any() else ~held
    logit = model.logits(x[test])
    loss = {t: np.logaddexp(0, -np.where(y[test] > 0, 1, -1) * logit / t).mean() for t in np.exp(np.linspace(-1.0, 2.0, 31))}
    return Model(words, vectors, shape_vectors, centre, scale, layers, float(min(loss, key=loss.get)))


def fit_on_labels(spark: SparkSession, documents: DataFrame, labels: DataFrame, bound: int = TRAIN_DOCS) -> Model:
    try:
        return train(labelled_sample(documents, labels, "quality", bound))
    finally:
        release()  # what fitting used of the driver's memory


def classify(documents: DataFrame, model: Model) -> DataFrame:
    """doc_id, held_out, score, predicted of each document."""

    def run(batches):
        for batch in batches:
            for i, j, t in tc.chunks(batch.column(2)):
                score = model.score(t).astype(np.float64)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(i, j - i), batch.column(1).slice(i, j - i), pa.array(score), pa.array((score >= THRESHOLD).astype(np.int32))],
                    names=["doc_id", "held_out", "score", "predicted"],
                )

    rows = documents.select(documents["doc_id"].cast("long").alias("doc_id"), (fold(documents["doc_id"], 5) == 0).alias("held_out"), F.col("text").cast("string"))
    return rows.mapInArrow(releasing(run), "doc_id long, held_out boolean, score double, predicted int")


def filter_documents(documents: DataFrame, model: Model) -> DataFrame:
    """The documents predicted good, with all their columns."""
    at = documents.columns.index("text")

    def run(batches):
        for batch in batches:
            for i, j, t in tc.chunks(batch.column(at)):
                yield batch.slice(i, j - i).filter(pa.array(model.score(t) >= THRESHOLD))

    return documents.mapInArrow(releasing(run), documents.schema)
