"""Quality rules by line sequence labelling (operator 8).

Every line of a text is content or boilerplate, as a linear-chain conditional random field says (Viterbi); the share
of words in content lines decides retention. Plain counts over words come first and can reject by themselves.

The field is trained here on a bounded sample of labelled documents (``TRAIN_DOCS``): lines of good documents are
content; those of bad ones start as boilerplate and are relabelled once by the field itself, as only part
of a bad document need be bad. Without labels of both kinds every line is content.

Defined results: null or empty text has no words and fails the base rules; equal rows get equal results; a text of
any length is taken whole; a null doc_id stays null; columns other than doc_id and text are ignored (or, in
``filter_documents``, passed through untouched whatever their names); an empty table gives an empty result.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from . import textcore as tc
from .folds import labelled_sample
from .worker import release, releasing

#: Most labelled documents the field is trained on.
TRAIN_DOCS = 1000
SYMBOLS = b"#*$%&|<>"
_CLASS = {name: np.isin(np.arange(256), list(chars)) for name, chars in {
    "symbol": SYMBOLS, "upper": range(65, 91), "lower": [*range(97, 123)], "digit": range(48, 58), "bang": b"!?", "pipe": b"|", "stop": b".,;:", "other": range(128, 256),
}.items()}
N_FEATURES = 14


@dataclass(frozen=True)
class Base:
    n_words: np.ndarray
    word_chars: np.ndarray
    n_symbols: np.ndarray
    n_dup_lines: np.ndarray
    n_repeat_words: np.ndarray

    def failed(self, least: int = 50, repeat_percent: int = 50) -> np.ndarray:
        return (self.n_words < least) | (100 * self.n_repeat_words > repeat_percent * self.n_words)


def base_and_lines(t: tc.Texts):
    """Base counts of each text, and of each line with a word: (features, text, words)."""
    begin, stop = t.offsets[:-1], t.offsets[1:]
    chars = (t.buf & 0xC0) != 0x80
    repeat = tc.repeat_words(t)
    start, end, doc = t.lines()
    lo, hi = np.searchsorted(t.start, start), np.searchsorted(t.start, end)
    real = hi > lo
    start, end, doc, lo, hi = start[real], end[real], doc[real], lo[real], hi[real]
    dup, _ = tc.repeated(t.span_hashes(start, end), doc)
    base = Base(
        t.n_words.astype(np.int64),
        tc.per_span(chars & t.solid, begin, stop),
        tc.per_span(_CLASS["symbol"][t.buf], begin, stop),
        np.bincount(doc[dup], minlength=t.n).astype(np.int64),
        tc.per_span(repeat, t.first[:-1], t.first[1:]),
    )
    words = hi - lo
    n = {k: tc.count_in(v, t.buf, start, end).astype(float) for k, v in _CLASS.items()}
    size = tc.per_span(t.solid, start, end).astype(float)
    echo = np.zeros(len(t.start), bool)
    if len(echo):
        echo[1:] = t.hash[1:] == t.hash[:-1]
        echo[np.minimum(t.first[:-1][t.n_words > 0], len(echo) - 1)] = False
    letters = n["upper"] + n["lower"] + n["other"]
    x = np.stack([
        np.ones(len(words)), np.log1p(words), n["symbol"] / size * 4, n["upper"] / np.maximum(letters, 1), n["digit"] / size * 4, n["bang"] / size * 4,
        n["pipe"] / words, n["stop"] / words, np.minimum(size / words, 30) / 10, tc.per_span(repeat, lo, hi) / words, tc.per_span(echo, lo, hi) / words,
        dup.astype(float), (words < 3).astype(float), np.minimum(n["symbol"] / words, 3),
    ], 1)
    return base, x, doc, words


def viterbi(gain: np.ndarray, begins: np.ndarray, trans: np.ndarray) -> np.ndarray:
    """Best label (1: content) of each line. gain: score of label 1 over label 0; begins: does a text begin here."""
    (s00, s01), (s10, s11) = trans.tolist()
    first, margin = begins.tolist(), [0.0] * len(gain)
    back0, back1 = bytearray(len(gain)), bytearray(len(gain))
    d = 0.0
    for i, g in enumerate(gain.tolist()):
        if first[i]:
            d = g
        else:
            back0[i], back1[i] = d + s10 > s00, d + s11 > s01
            d = max(s01, d + s11) + g - max(s00, d + s10)
        margin[i] = d
    out, y = np.zeros(len(gain), np.int8), 0
    for i in range(len(gain) - 1, -1, -1):
        if i + 1 == len(gain) or first[i + 1]:
            y = int(margin[i] >= 0)
        out[i] = y
        y = (back1 if y else back0)[i]
    return out


@dataclass(frozen=True)
class LineField:
    """Weights of the conditional random field: of label 1 over 0 for each feature, and of label pairs."""

    weights: np.ndarray
    trans: np.ndarray
    scale: np.ndarray

    def labels(self, x: np.ndarray, doc: np.ndarray) -> np.ndarray:
        begins = np.ones(len(doc), bool)
        begins[1:] = doc[1:] != doc[:-1]
        return viterbi((x / self.scale) @ self.weights, begins, self.trans)


ALL_CONTENT = LineField(np.eye(N_FEATURES)[0], np.zeros((2, 2)), np.ones(N_FEATURES))


def _segments(doc: np.ndarray, longest: int = 24) -> np.ndarray:
    """Line numbers of pieces of at most longest lines of one text each, -1 where a piece is shorter."""
    change = np.ones(len(doc), bool)
    change[1:] = doc[1:] != doc[:-1]
    at = np.arange(len(doc)) - np.maximum.accumulate(np.where(change, np.arange(len(doc)), 0))
    starts = np.flatnonzero(at % longest == 0)
    length = np.diff(np.append(starts, len(doc)))
    grid = starts[:, None] + np.arange(longest)
    return np.where(np.arange(longest) < length[:, None], grid, -1)[:, : max(1, length.max(initial=1))]


def _fit(x: np.ndarray, y: np.ndarray, doc: np.ndarray, steps: int = 60, l2: float = 1e-3) -> LineField:
    """Maximum likelihood by Adam; forward-backward over all segments at once."""
    scale = np.maximum(np.abs(x).max(0), 1e-9)
    x = x / scale
    seg = _segments(doc)
    here = seg >= 0
    xs, ys = np.where(here[:, :, None], x[seg], 0), np.where(here, y[seg], 0)
    n, length = seg.shape
    params, m, v = np.zeros(x.shape[1] + 4), 0.0, 0.0
    pair = here[:, 1:] & here[:, :-1]
    seen = np.zeros(x.shape[1] + 4)
    seen[:-4] = (xs * ys[:, :, None]).sum((0, 1))
    for a in (0, 1):
        for b in (0, 1):
            seen[x.shape[1] + 2 * a + b] = (pair & (ys[:, :-1] == a) & (ys[:, 1:] == b)).sum()
    for step in range(1, steps + 1):
        g, trans = xs @ params[:-4], params[-4:].reshape(2, 2)
        node = np.stack([np.zeros_like(g), g], 2)
        fwd, bwd = np.zeros((n, length, 2)), np.zeros((n, length, 2))
        fwd[:, 0] = node[:, 0]
        for t in range(1, length):
            now = np.logaddexp(fwd[:, t - 1, 0, None] + trans[0], fwd[:, t - 1, 1, None] + trans[1]) + node[:, t]
            fwd[:, t] = np.where(here[:, t, None], now, fwd[:, t - 1])
        for t in range(length - 2, -1, -1):
            nxt = node[:, t + 1] + bwd[:, t + 1]
            now = np.logaddexp(trans[:, 0] + nxt[:, 0, None], trans[:, 1] + nxt[:, 1, None])
            bwd[:, t] = np.where(here[:, t + 1, None], now, 0)
        z = np.logaddexp(fwd[:, -1, 0], fwd[:, -1, 1])
        p1 = np.where(here, np.exp(fwd[:, :, 1] + bwd[:, :, 1] - z[:, None]), 0)
        grad = np.zeros_like(params)
        grad[:-4] = np.tensordot(p1, xs, ((0, 1), (0, 1)))
        for a in (0, 1):
            for b in (0, 1):
                joint = fwd[:, :-1, a] + trans[a, b] + node[:, 1:, b] + bwd[:, 1:, b] - z[:, None]
                grad[x.shape[1] + 2 * a + b] = np.where(pair, np.exp(joint), 0).sum()
        grad = (grad - seen) / max(len(doc), 1) + l2 * params
        m, v = 0.9 * m + 0.1 * grad, 0.99 * v + 0.01 * grad**2
        params = params - 0.2 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
    return LineField(params[:-4], params[-4:].reshape(2, 2), scale)


def train(sample: list[tuple[str, int]], rounds: int = 1) -> LineField:
    """Fit the field on (text, quality) pairs."""
    if len({y for _, y in sample}) < 2:
        return ALL_CONTENT
    quality = np.array([y for _, y in sample])
    x, doc = [], []
    for i, _, t in tc.chunks(pa.array([text for text, _ in sample], pa.large_string())):
        _, f, d, _ = base_and_lines(t)
        x.append(f)
        doc.append(d + i)
    x, doc = np.concatenate(x), np.concatenate(doc)
    y = quality[doc]
    if len(set(y.tolist())) < 2:
        return ALL_CONTENT
    field = _fit(x, y, doc)
    for _ in range(rounds):
        guess = field.labels(x, doc)
        guess[quality[doc] == 1] = 1
        bad = np.bincount(doc[guess == 0], minlength=len(sample))
        guess[(quality[doc] == 0) & (bad[doc] == 0)] = 0
        field = _fit(x, guess, doc)
    return field


def fit_on_labels(spark: SparkSession, documents: DataFrame, labels: DataFrame, bound: int = TRAIN_DOCS) -> LineField:
    try:
        return train(labelled_sample(documents, labels, "quality", bound))
    finally:
        release()  # what fitting used of the driver's memory


def judge(t: tc.Texts, field: LineField, least_share: float):
    """(base counts, base_failed, content share, kept) of a chunk of texts."""
    base, x, doc, words = base_and_lines(t)
    label = field.labels(x, doc)
    content = np.bincount(doc, weights=words * label, minlength=t.n)
    share = np.where(t.n_words > 0, content / np.maximum(t.n_words, 1), 0.0)
    failed = base.failed()
    return base, failed, share, ~failed & (share >= least_share)


SCHEMA = "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, content_share double"


def quality_rules(documents: DataFrame, field: LineField, least_share: float = 0.5) -> DataFrame:
    """A row of counts and verdicts for each document."""

    def run(batches):
        for batch in batches:
            for i, j, t in tc.chunks(batch.column(1)):
                base, failed, share, kept = judge(t, field, least_share)
                cols = [base.n_words, base.word_chars, base.n_symbols, base.n_dup_lines, base.n_repeat_words, failed, kept, share]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), *map(pa.array, cols)], names=[c.split()[0] for c in SCHEMA.split(", ")])

    return documents.select(documents["doc_id"].cast("long"), documents["text"].cast("string")).mapInArrow(releasing(run), SCHEMA)


def filter_documents(documents: DataFrame, field: LineField, least_share: float = 0.5) -> DataFrame:
    """The documents that are kept, with all their columns."""
    at = documents.columns.index("text")

    def run(batches):
        for batch in batches:
            for i, j, t in tc.chunks(batch.column(at)):
                yield batch.slice(i, j - i).filter(pa.array(judge(t, field, least_share)[3]))

    return documents.mapInArrow(releasing(run), documents.schema)
