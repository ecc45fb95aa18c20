"""Language identification (operator 5): unigram pieces with all segmentations summed.

Each language has probabilities over a fixed public piece vocabulary. A word's probability is the sum over all its
segmentations into all pieces of the vocabulary, by a forward pass over its bytes, however long it is; a text's is the product over its words (lower-cased, each
with the vocabulary's word-begin mark before it). Single bytes are pieces too, so everything has a segmentation. The
probabilities are fitted by expectation-maximisation over the same lattices, on word counts of at most ``TRAIN_DOCS``
documents of each language outside the held-out fold, chosen by a hash of the id; every text is scored whole.

The score is the posterior of the best language under equal priors, with log-likelihoods averaged over the square root of the
number of words, so that long texts do not saturate at once.

Defined results: null text, and text without a letter, is ``und`` with score 0; without training documents everything is
``und``; ties go to the language that sorts first; a null doc_id stays null; other columns are ignored; an empty table
gives an empty result.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import textcore as tc
from .folds import fold
from .worker import releasing

TRAIN_DOCS, ROUNDS, SMOOTHING = 300, 4, 0.5
#: Words of more bytes are summed one by one in logarithms, as their sums would leave the range of numbers.
LONGEST_WORD = 64
MARK = "▁".encode()
#: Forward values are scaled by this for each byte, which cancels at the end.
GAIN = 64.0
#: Sums below this lose digits.
FAINT = 1e-250


def vocabulary(path: str) -> Pieces:
    """The pieces of a public vocabulary, and all single bytes."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    pieces = {model.id_to_piece(i).lower().encode() for i in range(model.get_piece_size()) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i))}
    return pieces_of(sorted(p for p in pieces if len(p) > 1))


@dataclass(frozen=True)
class Pieces:
    hashes: np.ndarray  # ascending span hashes
    sizes: tuple[int, ...]  # lengths in bytes that occur


def pieces_of(pieces: list[bytes]) -> Pieces:
    return Pieces(np.unique(_hash_all(pieces + [bytes([b]) for b in range(256)])), tuple(sorted({1, *map(len, pieces)})))


def _hash_all(words: list[bytes]) -> np.ndarray:
    buf = np.frombuffer(b"".join(words), np.uint8)
    end = np.cumsum([len(w) for w in words])
    return tc.SpanHasher(buf, both=False)(end - np.array([len(w) for w in words]), end)


@dataclass
class Lattice:
    """All pieces in a list of words: edges sorted by their end within the word."""

    n: int
    length: np.ndarray
    word: np.ndarray
    begin: np.ndarray
    end: np.ndarray
    piece: np.ndarray
    cuts: np.ndarray  # edges cuts[e]:cuts[e + 1] end at byte e


class Lattices:
    def __init__(self, pieces: Pieces):
        self.pieces, self.sizes = pieces.hashes, pieces.sizes
        bits = 20
        self.shift = np.uint64(64 - bits)
        self.filter = np.zeros(1 << bits, bool)
        self.filter[(self.pieces >> self.shift).astype(np.int64)] = True

    def __call__(self, words: list[bytes]) -> Lattice:
        words = [MARK + w for w in words]
        length = np.array([len(w) for w in words], np.int64)
        buf = np.frombuffer(b"".join(words), np.uint8)
        stop = np.cumsum(length)
        start = stop - length
        word = np.repeat(np.arange(len(words)), length)
        spans, pos = tc.SpanHasher(buf, both=False), np.arange(len(buf))
        found = []
        for size in self.sizes:
            pos = pos[pos + size <= stop[word[pos]]]
            if not len(pos):
                break
            at = pos
            h = spans(at, at + size)
            maybe = self.filter[(h >> self.shift).astype(np.int64)]
            at, h = at[maybe], h[maybe]
            k = np.searchsorted(self.pieces, h)
            k[k == len(self.pieces)] = 0
            hit = self.pieces[k] == h
            at, k = at[hit], k[hit]
            found.append((word[at], at - start[word[at]], at + size - start[word[at]], k))
        word, begin, end, piece = (np.concatenate(x) for x in zip(*found, strict=True))
        order = np.argsort(end, kind="stable")
        word, begin, end, piece = word[order], begin[order], end[order], piece[order]
        return Lattice(len(words), length, word, begin, end, piece, np.searchsorted(end, np.arange(length.max(initial=0) + 2)))


def forward(lat: Lattice, p: np.ndarray) -> np.ndarray:
    """Scaled sum over segmentations up to each byte, (words, longest + 1)."""
    alpha = np.zeros((lat.n, len(lat.cuts) - 1))
    alpha[:, 0] = 1
    gain = p[lat.piece] * GAIN ** (lat.end - lat.begin)
    for e in range(1, len(lat.cuts) - 1):
        s = slice(lat.cuts[e], lat.cuts[e + 1])
        alpha[:, e] = np.bincount(lat.word[s], alpha[lat.word[s], lat.begin[s]] * gain[s], lat.n)
    return alpha


def _one(lat: Lattice, w: int) -> Lattice:
    """The lattice of one of the words."""
    s, length = np.flatnonzero(lat.word == w), int(lat.length[w])
    return Lattice(1, lat.length[w : w + 1], np.zeros(len(s), np.int64), lat.begin[s], lat.end[s], lat.piece[s], np.searchsorted(lat.end[s], np.arange(length + 2)))


def _faint(lat: Lattice, alpha: np.ndarray) -> np.ndarray:
    """Words whose sums come near the least number that there is; they are summed by logarithms."""
    return np.flatnonzero(((alpha > 0) & (alpha < FAINT)).any(1) | (alpha[np.arange(lat.n), lat.length] < FAINT))


def log_probability(lat: Lattice, p: np.ndarray) -> np.ndarray:
    alpha = forward(lat, p)
    out = np.log(np.maximum(alpha[np.arange(lat.n), lat.length], FAINT)) - lat.length * np.log(GAIN)
    for w in _faint(lat, alpha).tolist():
        out[w] = long_forward(_one(lat, w), np.log(p)[None])[0, -1]
    return out


def expected(lat: Lattice, p: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """Expected piece counts over all segmentations."""
    alpha = forward(lat, p)
    faint = _faint(lat, alpha)
    beta = np.zeros_like(alpha)
    beta[np.arange(lat.n), lat.length] = 1
    gain = p[lat.piece] * GAIN ** (lat.end - lat.begin)
    for e in range(len(lat.cuts) - 2, 0, -1):
        s = slice(lat.cuts[e], lat.cuts[e + 1])
        np.add.at(beta, (lat.word[s], lat.begin[s]), beta[lat.word[s], e] * gain[s])
    share = weight / np.maximum(alpha[np.arange(lat.n), lat.length], FAINT)
    share[faint] = 0
    out = np.bincount(lat.piece, alpha[lat.word, lat.begin] * gain * beta[lat.word, lat.end] * share[lat.word], len(p))
    for w in faint.tolist():
        out += long_expected(_one(lat, w), np.log(p), float(weight[w]))
    return out


def long_forward(lat: Lattice, logp: np.ndarray) -> np.ndarray:
    """Logarithms of the sums over segmentations of one word up to each byte; logp: (languages, pieces)."""
    out = np.full((len(logp), len(lat.cuts) - 1), -np.inf)
    out[:, 0] = 0
    for e in range(1, out.shape[1]):
        s = slice(lat.cuts[e], lat.cuts[e + 1])
        x = out[:, lat.begin[s]] + logp[:, lat.piece[s]]
        most = x.max(1)
        out[:, e] = most + np.log(np.exp(x - most[:, None]).sum(1))
    return out


def long_expected(lat: Lattice, logp: np.ndarray, weight: float) -> np.ndarray:
    """Expected piece counts over all segmentations of one word."""
    ahead, n = long_forward(lat, logp[None])[0], int(lat.length[0])
    back = np.full(n + 1, -np.inf)
    back[n] = 0
    order = np.argsort(lat.begin, kind="stable")
    cuts = np.searchsorted(lat.begin[order], np.arange(n + 1))
    for b in range(n - 1, -1, -1):
        s = order[cuts[b] : cuts[b + 1]]
        x = back[lat.end[s]] + logp[lat.piece[s]]
        back[b] = x.max() + np.log(np.exp(x - x.max()).sum())
    return np.bincount(lat.piece, weight * np.exp(ahead[lat.begin] + logp[lat.piece] + back[lat.end] - ahead[n]), len(logp))


@dataclass(frozen=True)
class LanguageModel:
    langs: tuple[str, ...]
    pieces: Pieces
    p: np.ndarray  # (langs, pieces)


def train(counts: dict[str, dict[bytes, int]], pieces: Pieces) -> LanguageModel:
    """Fit piece probabilities to word counts of each language."""
    build, langs, rows, size = Lattices(pieces), tuple(sorted(counts)), [], len(pieces.hashes)
    for lang in langs:
        words = sorted(w for w in counts[lang] if len(w) <= LONGEST_WORD)
        longs = [(build([w]), float(n)) for w, n in sorted(counts[lang].items()) if len(w) > LONGEST_WORD]
        lat, weight = build(words) if words else None, np.array([counts[lang][w] for w in words], float)
        p = np.full(size, 1 / size)
        for _ in range(ROUNDS):
            found = np.full(size, SMOOTHING)
            if lat is not None:
                found += expected(lat, p, weight)
            for one, n in longs:
                found += long_expected(one, np.log(p), n)
            p = found / found.sum()
        rows.append(p)
    return LanguageModel(langs, pieces, np.array(rows).reshape(len(langs), size))


_COUNTS = "lang string, word binary, n long"


def _count_words(batches):
    for batch in batches:
        for lang, text in zip(batch.column(0).to_pylist(), pc.utf8_lower(tc.large_text(batch.column(1))), strict=True):
            t = next(tc.chunks(pa.array([text], pa.large_string()), size=1 << 62))[2]
            _, at, n = np.unique(t.hash, return_index=True, return_counts=True)
            raw = t.buf.tobytes()
            words = [raw[a:b] for a, b in zip(t.start[at].tolist(), t.end[at].tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(words), pa.string()), pa.array(words, pa.binary()), pa.array(n.astype(np.int64))], names=["lang", "word", "n"])


def word_counts(documents: DataFrame, bound: int = TRAIN_DOCS) -> dict[str, dict[bytes, int]]:
    """Counts of lower-cased words in at most bound training documents of each language, counted on the executors."""
    known = documents.select(documents["doc_id"].cast("long").alias("_id"), documents["lang"].cast("string").alias("_lang"), documents["text"].cast("string").alias("_text"))
    known = known.where(F.col("_lang").isNotNull() & (fold("_id", 5) != 0)).withColumn("_hash", F.xxhash64("_text"))
    order = Window.partitionBy("_lang").orderBy(F.xxhash64("_id"), "_id", "_hash")
    picked = known.select("_id", "_lang", "_hash").withColumn("_at", F.row_number().over(order)).where(F.col("_at") <= bound)
    rows = known.join(F.broadcast(picked), (known["_lang"] == picked["_lang"]) & (known["_hash"] == picked["_hash"]) & known["_id"].eqNullSafe(picked["_id"]), "left_semi")  # bound rows a language
    counted = rows.dropDuplicates(["_id", "_lang", "_hash"]).select("_lang", "_text").mapInArrow(releasing(_count_words), _COUNTS).groupBy("lang", "word").agg(F.sum("n").alias("n"))
    out: dict[str, dict[bytes, int]] = {}
    for lang, w, n in counted.collect():
        out.setdefault(lang, {})[bytes(w)] = n
    return out


#: Log-probabilities of words already met by this worker process, by model.
_known: dict[str, tuple[np.ndarray, np.ndarray]] = {}
KNOWN_WORDS = 200_000


class Scorer:
    def __init__(self, model: LanguageModel, name: str):
        self.model, self.name, self.build = model, name, Lattices(model.pieces)

    def words(self, words: list[bytes]) -> np.ndarray:
        """Log-probability of each word in each language."""
        out = np.zeros((len(words), len(self.model.langs)))
        short = [k for k, w in enumerate(words) if len(w) <= LONGEST_WORD]
        if short:
            lat = self.build([words[k] for k in short])
            out[short] = np.stack([log_probability(lat, p) for p in self.model.p], 1)
        if len(short) < len(words):
            logp = np.log(self.model.p)
            for k, w in enumerate(words):
                if len(w) > LONGEST_WORD:
                    out[k] = long_forward(self.build([w]), logp)[:, -1]
        return out

    def texts(self, t: tc.Texts) -> np.ndarray:
        """Log-likelihood of each text in each language."""
        h, at, back = np.unique(t.hash, return_index=True, return_inverse=True)
        keys, values = _known.get(self.name, (np.zeros(0, np.uint64), np.zeros((0, len(self.model.langs)), np.float64)))
        k = np.searchsorted(keys, h)
        k[k == len(keys)] = 0
        have = keys[k] == h if len(keys) else np.zeros(len(h), bool)
        logp = np.zeros((len(h), len(self.model.langs)))
        if have.any():
            logp[have] = values[k[have]]
        if not have.all():
            new = np.flatnonzero(~have)
            raw = t.buf.tobytes()
            logp[new] = self.words([raw[a:b] for a, b in zip(t.start[at[new]].tolist(), t.end[at[new]].tolist(), strict=True)])
            if len(keys) + len(new) > KNOWN_WORDS:
                keys, values = keys[:0], values[:0]
            keys, values = np.concatenate([keys, h[new]]), np.concatenate([values, logp[new]])
            order = np.argsort(keys)
            _known.clear()
            _known[self.name] = keys[order], values[order]
        out = np.zeros((t.n, len(self.model.langs)))
        some = t.n_words > 0
        if some.any():
            out[some] = np.add.reduceat(logp[back], t.first[:-1][some])
        return out


def has_letter(text: str | None) -> bool:
    return text is not None and any(map(str.isalpha, text))


def identify(documents: DataFrame, model: LanguageModel) -> DataFrame:
    """doc_id, held_out, lang_pred, score of each document."""
    name = uuid.uuid4().hex

    def run(batches):
        scorer = Scorer(model, name)
        for batch in batches:
            lower = pc.utf8_lower(tc.large_text(batch.column(2)))
            for i, j, t in tc.chunks(lower):
                letters = np.array([has_letter(x) for x in batch.column(2).slice(i, j - i).to_pylist()])
                if model.langs:
                    log = scorer.texts(t) / np.sqrt(np.maximum(t.n_words, 1))[:, None]
                    p = np.exp(log - log.max(1, keepdims=True))
                    best = p.argmax(1)
                    score = np.where(letters, 1 / p.sum(1), 0.0)
                    lang = [model.langs[b] if ok else "und" for b, ok in zip(best.tolist(), letters.tolist(), strict=True)]
                else:
                    score, lang = np.zeros(t.n), ["und"] * t.n
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(i, j - i), batch.column(1).slice(i, j - i), pa.array(lang, pa.string()), pa.array(score)],
                    names=["doc_id", "held_out", "lang_pred", "score"],
                )

    rows = documents.select(documents["doc_id"].cast("long").alias("doc_id"), (fold(documents["doc_id"], 5) == 0).alias("held_out"), documents["text"].cast("string").alias("text"))
    return rows.mapInArrow(releasing(run), "doc_id long, held_out boolean, lang_pred string, score double")


def fit(spark: SparkSession, documents: DataFrame, path: str, bound: int = TRAIN_DOCS) -> LanguageModel:
    return train(word_counts(documents, bound), vocabulary(path))
