"""Benchmark decontamination (operator 9): BM25 index of test items, block-max WAND, overlap verification.

The index holds the test items; each posting is the share of the item's own BM25 score that the word brings, so one
threshold suits all items. Items are in blocks, and every word has an upper bound for each block. Training documents
are cut into overlapping passages at least as long as the longest item, and each passage is a query: where no block's bounds add up
to the threshold it is passed over, else WAND with block maxima retrieves every item above the threshold. A retrieved item
counts as leaked if enough three-word shingles of both its question and its answer stand in the passage; a part of one or
two words is looked up as a whole among the passage's runs of that many words. Without an
answer column the last third of an item's words is its answer (an item of one or two words has none).

An index holds about ``INDEX_ITEMS`` items; more items are dealt into several, with the document frequencies and lengths of all
items, so that results are those of one index. A scan of the documents searches ``PASS_INDEXES`` of them. Defined results: null or
empty documents and items match nothing; repeated documents are judged alike, equal items count once; a null doc_id or
item_id stays null; other columns are ignored (or passed through by ``filter_documents``); an empty table on either side
gives no leaks. Documents of any length are taken whole.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import textcore as tc
from .worker import releasing

INDEX_ITEMS, PASS_INDEXES, BLOCK = 512, 8, 4
#: Word-passage pairs whose bounds are added up at once.
PAIRS = 1 << 15
K1, B = 1.2, 0.75
SCORE, OVERLAP, SHINGLE = 0.6, 0.5, 3
LEAKS = "doc_id long, item_id long, score double, question_overlap double, answer_overlap double"


@dataclass(frozen=True)
class Index:
    item_ids: pa.Array
    terms: np.ndarray  # sorted word hashes
    first: np.ndarray  # postings first[t]:first[t + 1]
    items: np.ndarray
    shares: np.ndarray
    most: np.ndarray  # (terms, blocks)
    question: tuple[np.ndarray, ...]  # shingle hashes of each item
    answer: tuple[np.ndarray, ...]
    sizes: tuple[tuple[int, int], ...]  # words in a shingle of each item's question and answer
    passage: int

    def lookup(self, h: np.ndarray) -> np.ndarray:
        at = np.searchsorted(self.terms, h)
        at[at == len(self.terms)] = 0
        return np.where(self.terms[at] == h, at, -1)


def lowered(column: pa.Array) -> pa.Array:
    """Lower-cased texts (all scripts), null as empty."""
    return pc.utf8_lower(tc.large_text(column))


def shingle_hashes(h: np.ndarray, size: int = SHINGLE) -> np.ndarray:
    """Distinct shingles of size words of a word sequence; a shorter one is a shingle by itself."""
    if not len(h):
        return h
    size = min(size, len(h))
    out = np.zeros(len(h) - size + 1, np.uint64)
    for k in range(size):
        out = out * np.uint64(0x9FB21C651E98DF25) + h[k : len(h) - size + 1 + k]
    return np.unique(tc.mix(out))


def cut_items(items: list[tuple[int | None, str | None, str | None]]) -> list[tuple[int | None, np.ndarray, np.ndarray]]:
    """Word hashes of the question and the answer of each of (item_id, text or question, answer or None) that has words."""
    split = []
    for item, question, answer in items:
        t = next(tc.chunks(lowered(pa.array([question, answer], pa.large_string())), size=1 << 40))[2]
        q, a = t.hash[: t.first[1]], t.hash[t.first[1] :]
        if not len(a) and len(q) > 2:
            q, a = q[: -(len(q) // 3)], q[-(len(q) // 3) :]
        if len(q) + len(a):
            split.append((item, q, a))
    return sorted(split, key=lambda x: (x[0] is None, x[0]))


class Statistics:
    """Of all items, however many indexes they are dealt to: their number, lengths and the words' document frequencies."""

    def __init__(self):
        self.n, self.words, self.longest = 0, 0, 0
        self.terms, self.df = np.zeros(0, np.uint64), np.zeros(0, np.int64)

    def add(self, split: list[tuple[int | None, np.ndarray, np.ndarray]]) -> Statistics:
        sizes = [len(q) + len(a) for _, q, a in split]
        self.n, self.words, self.longest = self.n + len(split), self.words + sum(sizes), max([self.longest, *sizes])
        found = np.concatenate([self.terms, *(np.unique(np.concatenate([q, a])) for _, q, a in split)])
        self.terms, at = np.unique(found, return_inverse=True)
        self.df = np.bincount(at, np.concatenate([self.df, np.ones(len(found) - len(self.df), np.int64)]), len(self.terms)).astype(np.int64)
        return self


def build(split: list[tuple[int | None, np.ndarray, np.ndarray]], statistics: Statistics | None = None) -> Index | None:
    """Index of cut items, by the statistics of all (of these alone if not given)."""
    if not split:
        return None
    statistics = statistics or Statistics().add(split)
    n = len(split)
    whole = [np.concatenate([q, a]) for _, q, a in split]
    length = np.array([len(w) for w in whole], float)
    pairs = [np.unique(w, return_counts=True) for w in whole]
    terms = np.unique(np.concatenate([u for u, _ in pairs]))
    df = statistics.df[np.searchsorted(statistics.terms, terms)]
    idf = np.log1p((statistics.n - df + 0.5) / (df + 0.5))
    item = np.repeat(np.arange(n), [len(u) for u, _ in pairs])
    term = np.searchsorted(terms, np.concatenate([u for u, _ in pairs]))
    tf = np.concatenate([c for _, c in pairs]).astype(float)
    impact = idf[term] * tf * (K1 + 1) / (tf + K1 * (1 - B + B * length[item] * statistics.n / statistics.words))
    share = impact / np.bincount(item, impact, n)[item]
    order = np.lexsort((item, term))
    term, item, share = term[order], item[order], share[order]
    most = np.zeros((len(terms), (n + BLOCK - 1) // BLOCK), np.float32)
    np.maximum.at(most, (term, item // BLOCK), share)
    return Index(
        pa.array([i for i, _, _ in split], pa.int64()), terms, np.searchsorted(term, np.arange(len(terms) + 1)), item, share, most,
        tuple(shingle_hashes(q) for _, q, _ in split), tuple(shingle_hashes(a) for _, _, a in split),
        tuple((min(SHINGLE, len(q)), min(SHINGLE, len(a))) for _, q, a in split), 2 * statistics.longest,
    )


def wand(index: Index, terms: np.ndarray, threshold: float) -> list[tuple[int, float]]:
    """(item number, score) of all items whose words among terms bring at least threshold."""
    top = index.most[terms].max(1)
    cursors = [[int(index.first[t]), int(index.first[t + 1]), float(u), int(t)] for t, u in zip(terms, top, strict=True)]
    items, shares, out = index.items, index.shares, []

    def seek(c: list, target: int) -> None:
        c[0] += int(np.searchsorted(items[c[0] : c[1]], target))

    while True:
        cursors = [c for c in cursors if c[0] < c[1]]
        cursors.sort(key=lambda c: items[c[0]])
        total, pivot = 0.0, None
        for k, c in enumerate(cursors):
            total += c[2]
            if total >= threshold - 1e-6:
                pivot = k
                break
        if pivot is None:
            return out
        d = items[cursors[pivot][0]]
        while pivot + 1 < len(cursors) and items[cursors[pivot + 1][0]] == d:
            pivot += 1
        block = d // BLOCK
        if index.most[[c[3] for c in cursors[: pivot + 1]], block].sum() < threshold - 1e-5:
            # no item of this block can reach the threshold before a further list begins
            target = (block + 1) * BLOCK
            if pivot + 1 < len(cursors):
                target = min(target, items[cursors[pivot + 1][0]])
            for c in cursors[: pivot + 1]:
                seek(c, max(target, d + 1))
        elif items[cursors[0][0]] == d:
            score = sum(float(shares[c[0]]) for c in cursors[: pivot + 1])
            if score >= threshold - 1e-9:
                out.append((int(d), score))
            for c in cursors[: pivot + 1]:
                c[0] += 1
        else:
            for c in cursors[:pivot]:
                if items[c[0]] < d:
                    seek(c, d)


def search(t: tc.Texts, index: Index) -> list[tuple[int, int, float, float, float]]:
    """(text, item number, score, question overlap, answer overlap) of each verified leak in a chunk, best passage first."""
    size, stride = index.passage, index.passage // 2
    n_passages = np.where(t.n_words > 0, np.maximum(0, -(-(t.n_words - size) // stride)) + 1, 0)
    base = np.concatenate([[0], np.cumsum(n_passages)])
    term = index.lookup(t.hash)
    at = np.flatnonzero(term >= 0)
    if not len(at):
        return []
    doc = np.searchsorted(t.first, at, side="right") - 1
    k = (at - t.first[doc]) // stride
    keys = []
    for back in (0, 1):
        ok = (k - back >= 0) & (k - back < n_passages[doc])
        keys.append((base[doc[ok]] + k[ok] - back) * len(index.terms) + term[at[ok]])
    keys = np.unique(np.concatenate(keys))
    passage, term = keys // len(index.terms), keys % len(index.terms)
    begin = np.flatnonzero(np.append(True, passage[1:] != passage[:-1]))
    stop = np.append(begin[1:], len(passage))
    bound, i = np.zeros(len(begin)), 0
    while i < len(begin):
        j = max(i + 1, int(np.searchsorted(begin, begin[i] + PAIRS)))
        bound[i:j] = np.add.reduceat(index.most[term[begin[i] : stop[j - 1]]], begin[i:j] - begin[i]).max(1)
        i = j
    best: dict[tuple[int, int], tuple] = {}
    for i in np.flatnonzero(bound >= SCORE - 1e-5):
        p = passage[begin[i]]
        d = int(np.searchsorted(base, p, side="right")) - 1
        found = wand(index, term[begin[i] : stop[i]], SCORE)
        if not found:
            continue
        lo = t.first[d] + (p - base[d]) * stride
        words = t.hash[lo : min(lo + size, t.first[d + 1])]
        here = {k: shingle_hashes(words, k) for k in {k for item, _ in found for k in index.sizes[item]} if k}
        for item, score in found:
            shares = [float(np.isin(x, here[k]).mean()) if len(x) else 1.0 for x, k in zip((index.question[item], index.answer[item]), index.sizes[item], strict=True)]
            if min(shares) >= OVERLAP:
                got = (sum(shares), score, *shares)
                if got > best.get((d, item), (0.0,)):
                    best[d, item] = got
    return [(d, item, *got[1:]) for (d, item), got in sorted(best.items())]


def indexes(benchmark: DataFrame, answer: str | None = None) -> list[Index]:
    """Indexes of all items, each of about INDEX_ITEMS; that many texts reach the driver at a time. Equal items count once."""
    rows = benchmark.select(F.col("item_id").cast("long").alias("i"), F.col("text").cast("string").alias("q"), (F.col(answer) if answer else F.lit(None)).cast("string").alias("a")).distinct()
    shards = max(1, -(-rows.count() // INDEX_ITEMS))
    splits, statistics = [], Statistics()
    for k in range(shards):
        splits.append(cut_items([tuple(r) for r in rows.where(F.pmod(F.xxhash64("i", "q", "a"), F.lit(shards)) == k).collect()]))
        statistics.add(splits[-1])
    return [x for x in (build(s, statistics) for s in splits) if x is not None]


def _passes(indexes: list[Index]) -> list[list[Index]]:
    """Indexes that one scan of the documents searches, a bounded number of items."""
    return [indexes[k : k + PASS_INDEXES] for k in range(0, len(indexes), PASS_INDEXES)]


def leaks(documents: DataFrame, indexes: list[Index]) -> DataFrame:
    """A row for each document and item leaked into it."""
    rows = documents.select(documents["doc_id"].cast("long").alias("doc_id"), documents["text"].cast("string").alias("text"))

    def runner(own: list[Index]):
        def run(batches):
            for batch in batches:
                for i, j, t in tc.chunks(lowered(batch.column(1))):
                    for index in own:
                        found = search(t, index)
                        ids = batch.column(0).slice(i, j - i).take(pa.array([f[0] for f in found], pa.int64()))
                        cols = [index.item_ids.take(pa.array([f[1] for f in found], pa.int64())), *(pa.array([f[c] for f in found], pa.float64()) for c in (2, 3, 4))]
                        yield pa.RecordBatch.from_arrays([ids, *cols], names=[c.split()[0] for c in LEAKS.split(", ")])

        return run

    if not indexes:
        return rows.sparkSession.createDataFrame([], LEAKS)
    return reduce(DataFrame.unionByName, [rows.mapInArrow(releasing(runner(x)), LEAKS) for x in _passes(indexes)])


def filter_documents(documents: DataFrame, indexes: list[Index]) -> DataFrame:
    """The documents into which no item leaked, with all their columns."""
    at, out = documents.columns.index("text"), documents

    def runner(own: list[Index]):
        def run(batches):
            for batch in batches:
                for i, j, t in tc.chunks(lowered(batch.column(at))):
                    clean = np.ones(t.n, bool)
                    for index in own:
                        clean[[f[0] for f in search(t, index)]] = False
                    yield batch.slice(i, j - i).filter(pa.array(clean))

        return run

    for x in _passes(indexes):
        out = out.mapInArrow(releasing(runner(x)), documents.schema)
    return out
