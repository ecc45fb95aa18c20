"""Language-model scoring by a hierarchical Pitman-Yor model (operator 6).

Tokens are lower-cased words and one end for each text. A token is drawn in the restaurant of its context, the two words
before it. Contexts with the same last word share that word's restaurant as their parent, and all of those share the root, over a
uniform base on all training words and one unknown. Customers are all training tokens. Gibbs sweeps draw the tables of every
dish from their conditional distribution (``restaurants``), parents' distributions from their posterior, and discounts and
strengths from theirs; the predictive probability of a token is averaged over the sweeps kept.

A word that is the last one of more than ``MOST`` contexts' tokens has several restaurants, one for each class of the word before
it, so that no restaurant and no group of rows grows with its frequency. First tokens have no word before; if there are more than
``MOST`` training texts, a first token is drawn in two steps: its class, which is a share of the vocabulary and has a probability by counts of
all texts, then the token in that class's restaurant, over the root's distribution within the class. So the counts of
one word stay together, and probabilities add up to one whatever ``MOST`` is.

Work is dealt so that nothing gathers beyond a bounded group: texts are tokenised into blocks; words are numbered by ranges of their
64-bit hashes; restaurants with all their contexts are dealt to shards of about ``SHARD_TOKENS`` tokens. A block tells each
shard the (context, word) pairs it holds, and gets the probability of each. Between the sweeps that warm up and those that are
kept, shards send each word's tables to the range that owns the word, which seats the root once. Discounts and strengths of contexts and
parents are sampled, the root's are fixed. All numbers of groups
follow from the tokens counted, so scores don't depend on partitions.

Defined results: null text is empty and has the end alone; a null doc_id stays null and counts as the empty id in the fold;
repeated rows are counted and scored row by row; other columns are ignored; an empty table gives an empty result; without
training texts every token is unknown. Texts of any length are taken whole.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import restaurants as r
from . import textcore as tc
from .folds import fold
from .scratch import Scratch
from .worker import releasing

#: Sweeps of a shard before the root is seated, and before and while probabilities are averaged.
WARM_UP, BURN_IN, SAMPLES = 2, 2, 3
BLOCK_BYTES = 4 << 20
SHARD_TOKENS = 600_000
RANGE_TOKENS = 20_000_000
MOST = 200_000
#: Bits of a number that holds a parent, a word before and a token, where they fit.
KEY_BITS = 62
#: Discount and strength of contexts, parents and root until they are sampled.
FIRST = ((0.8, 1.0), (0.8, 2.0), (0.6, 50.0))
END = np.uint64(0xE7037ED1A0B428DB)
#: Answers are negative logarithms (base 10) in steps of this size.
STEP = 2.0**-19


def pack(a: np.ndarray) -> bytes:
    """Compressed non-negative integers: bytes of equal weight stand together."""
    kind = np.min_scalar_type(int(a.max())) if len(a) else np.dtype(np.uint8)
    raw = np.ascontiguousarray(a.astype(kind).view(np.uint8).reshape(-1, kind.itemsize).T).tobytes()
    return bytes([kind.itemsize]) + len(raw).to_bytes(8, "little") + pa.compress(raw, codec="zstd", asbytes=True)


def unpack(b: bytes) -> np.ndarray:
    size, n = b[0], int.from_bytes(b[1:9], "little")
    raw = np.frombuffer(pa.decompress(b[9:], n, codec="zstd", asbytes=True), np.uint8).reshape(size, -1)
    return np.ascontiguousarray(raw.T).view(f"<u{size}").reshape(-1).astype(np.int64)


def pack_ascending(a: np.ndarray) -> bytes:
    return pack(np.diff(a, prepend=0))


def unpack_ascending(b: bytes) -> np.ndarray:
    return np.cumsum(unpack(b))


def codes(a: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct values in ascending order, and each value's place among them."""
    found = pa.array(a).dictionary_encode()
    values, place = np.asarray(found.dictionary), np.asarray(found.indices)
    order = np.argsort(values)
    rank = np.empty(len(order), np.int64)
    rank[order] = np.arange(len(order))
    return values[order], rank[place]


def _runs(keys: np.ndarray) -> np.ndarray:
    """Where new values begin in ascending keys."""
    return np.flatnonzero(np.append(np.ones(min(1, len(keys)), bool), keys[1:] != keys[:-1]))


def _batch(rows: list[tuple], schema: str) -> pa.RecordBatch:
    names = [c.split() for c in schema.split(", ")]
    kinds = [{"long": pa.int64(), "binary": pa.binary(), "array<double>": pa.list_(pa.float64())}[k] for _, k in names]
    return pa.RecordBatch.from_arrays([pa.array([x[i] for x in rows], k) for i, k in enumerate(kinds)], names=[n for n, _ in names])


def _table(rows: list[tuple], schema: str) -> pa.Table:
    return pa.Table.from_batches([_batch(rows, schema)])


# Blocks: words are ascending hashes, counts those of training tokens, tokens the places of the texts' words (ends left out).
_BLOCKS = "block long, doc_ids binary, id_null binary, held binary, n_words binary, tokens binary, words binary, counts binary, n_tokens long"


def _blocks(batches):
    def block(number: int, held: list) -> pa.RecordBatch:
        ids = pa.concat_arrays([h[0].combine_chunks() if isinstance(h[0], pa.ChunkedArray) else h[0] for h in held])
        out, n_words = np.concatenate([h[1] for h in held]), np.concatenate([h[2] for h in held]).astype(np.int64)
        words, place = codes(np.append(np.concatenate([h[3] for h in held]), END))
        counts = np.bincount(place[:-1], np.repeat(~out, n_words), len(words)).astype(np.int64)
        counts[place[-1]] += int((~out).sum())
        row = (
            (TaskContext.get().partitionId() << 32) | number, np.asarray(ids.fill_null(0)).astype(np.int64).tobytes(), np.asarray(ids.is_null()).tobytes(), out.tobytes(), pack(n_words),
            pack(place[:-1]), words.tobytes(), pack(counts), int(n_words.sum()) + len(n_words),
        )
        return _batch([row], _BLOCKS)

    number, held, size = 0, [], 0
    for batch in batches:
        for i, j, t in tc.chunks(batch.column(2), lower=True):
            held.append((batch.column(0).slice(i, j - i), np.asarray(batch.column(1).slice(i, j - i)).astype(bool), t.n_words, t.hash))
            size += len(t.buf)
            if size >= BLOCK_BYTES:
                yield block(number, held)
                held, size, number = [], 0, number + 1
    if held:
        yield block(number, held)


# Words: a number is rank * ranges + range, ranks going by count; so frequent words have small numbers.
_WORD_ASKS = "range long, block long, words binary, counts binary"
_NUMBERS = "block long, range long, ranks binary, counts binary, n long, kinds long, curve array<double>"


def _word_asks(ranges: int):
    edges = np.array([(j << 64) // ranges for j in range(1, ranges)], np.uint64)

    def run(batches):
        for batch in batches:
            for row in batch.select(["block", "words", "counts"]).to_pylist():
                words, counts = np.frombuffer(row["words"], np.uint64), unpack(row["counts"])
                cut = [0, *np.searchsorted(words, edges).tolist(), len(words)]
                yield _batch([(j, row["block"], words[a:b].tobytes(), pack(counts[a:b])) for j, (a, b) in enumerate(zip(cut[:-1], cut[1:], strict=True)) if a < b], _WORD_ASKS)

    return run


def _number(key: tuple[pa.Scalar, ...], group: pa.Table) -> pa.Table:
    """Rank and count of every word asked for; totals and the counts at ranks 1, 2, 4, ... in the last row."""
    rows = group.to_pylist()
    words = [np.frombuffer(x["words"], np.uint64) for x in rows]
    distinct, back = codes(np.concatenate(words))
    counts = np.bincount(back, np.concatenate([unpack(x["counts"]) for x in rows]), len(distinct)).astype(np.int64)
    order = np.lexsort((distinct, -counts))
    rank = np.empty_like(order)
    rank[order] = np.arange(len(order))
    cut, me = np.cumsum([0, *(len(w) for w in words)]), key[0].as_py()
    out = [(x["block"], me, pack(rank[back[a:b]]), pack(counts[back[a:b]]), 0, 0, None) for x, a, b in zip(rows, cut[:-1], cut[1:], strict=True)]
    at = 1 << np.arange(40)
    curve = np.where(at <= len(order), counts[order][np.minimum(at, len(order)) - 1], 0)
    return _table([*out, (-1, me, b"", b"", int(counts.sum()), int((counts > 0).sum()), curve.astype(float).tolist())], _NUMBERS)


# Coded blocks: numbers are those of its words, ascending; tokens are places among them; hot ones are those of more than MOST training tokens.
_CODED = "block long, doc_ids binary, id_null binary, held binary, n_words binary, known binary, base binary, numbers binary, tokens binary, hot binary, hot_counts binary, unknown binary, end long, end_number long, end_count long"


def _code(ranges: int, n: int, kinds: int, most: int):
    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        out = []
        for row in left.to_pylist():
            answers = sorted(right.to_pylist(), key=lambda x: x["range"])
            number = np.concatenate([unpack(x["ranks"]) * ranges + x["range"] for x in answers])
            order = np.argsort(number)
            count = np.concatenate([unpack(x["counts"]) for x in answers])[order]
            rank = np.empty_like(order)
            rank[order] = np.arange(len(order))
            place, n_words = rank[unpack(row["tokens"])], unpack(row["n_words"])
            end = int(rank[np.searchsorted(np.frombuffer(row["words"], np.uint64), END)])
            base = np.log10((count + 0.1) / (n + 0.1 * (kinds + 1)))
            stop = np.cumsum(n_words)
            known = tc.per_span(count[place] > 0, stop - n_words, stop) + int(count[end] > 0)
            sums = np.zeros(len(place) + 1)
            np.cumsum(base[place], out=sums[1:])
            hot = np.flatnonzero(count > most)
            out.append((
                row["block"], row["doc_ids"], row["id_null"], row["held"], row["n_words"], pack(known), (sums[stop] - sums[stop - n_words] + base[end]).tobytes(), pack_ascending(number[order]), pack(place),
                pack(hot), pack(count[hot]), pack_ascending(np.flatnonzero(count == 0)), end, int(number[order][end]), int(count[end]),
            ))
        return _table(out, _CODED)

    return run


def classes(count: np.ndarray, most: int) -> np.ndarray:
    """Restaurants of a word that so many training tokens follow."""
    return np.maximum(1, -(-count // most))


def start_classes(texts: int, ranges: int, most: int) -> int:
    """Classes of first tokens: shares of each range of words, a word's class being its number modulo this; unknown words are of class 0."""
    return 1 if texts <= most else ranges * -(-texts // (most * ranges))


def _hash(a: np.ndarray) -> np.ndarray:
    return tc.mix(a.astype(np.uint64) + np.uint64(0x9E3779B97F4A7C15))


class Triples:
    """A block's tokens as distinct (last word, class, word before, token), in the order of shards."""

    def __init__(self, row: dict, shards: int, places: bool, most: int, starts: int):
        n_words, end, numbers = unpack(row["n_words"]), row["end"], unpack_ascending(row["numbers"])
        n_tokens = n_words + 1
        stop = np.cumsum(n_tokens)
        self.n_words, self.starts = n_words, stop - n_tokens
        w = np.full(int(stop[-1]), end, np.int64)
        inner = np.ones(len(w), bool)
        inner[stop - 1] = False
        w[inner] = unpack(row["tokens"])
        v, u = np.empty_like(w), np.empty_like(w)
        v[1:], u[2:] = w[:-1], w[:-2]
        v[self.starts] = end
        u[self.starts[n_words > 0] + 1] = end
        # words before are numbered on for the classes of first tokens
        begin = numbers % starts
        begin[unpack_ascending(row["unknown"])] = 0
        begin = begin[w[self.starts]]
        u[self.starts] = len(numbers) + begin
        befores = np.append(numbers, np.arange(int(begin.max()) + 1))
        split = np.ones(len(numbers), np.int64)
        split[unpack(row["hot"])] = classes(unpack(row["hot_counts"]), most)
        split[end] = starts
        first = np.cumsum(split) - split
        parent = first[v]
        several = np.flatnonzero((split[v] > 1) & (v != end))
        parent[several] += (_hash(befores[u[several]]) >> np.uint64(20)).astype(np.int64) % split[v[several]]
        parent[self.starts] += begin
        seen = np.zeros(int(split.sum()), bool)
        seen[parent] = True
        kept = np.flatnonzero(seen)
        word = np.searchsorted(first, kept, side="right") - 1
        self.parent_word, self.parent_class = numbers[word], kept - first[word]
        shard = (_hash(self.parent_word * np.int64(0x10001) + self.parent_class) % np.uint64(shards)).astype(np.int64)
        order = np.argsort(shard, kind="stable")
        rank = np.zeros(len(seen), np.int64)
        rank[kept[order]] = np.arange(len(order))
        self.parent_word, self.parent_class, shard = self.parent_word[order], self.parent_class[order], shard[order]
        # a key holds parent, word before, token and whether the text is held out
        bits_u, bits_w = len(befores).bit_length(), len(numbers).bit_length()
        context, values = (rank[parent] << bits_u) | u, None
        if len(order).bit_length() + bits_u + bits_w > KEY_BITS:
            values, context = codes(context)
        key = (context << bits_w) | w
        out = np.repeat(np.frombuffer(row["held"], bool), n_tokens)
        if places:
            sort = np.argsort(key)
            key, out = key[sort], out[sort]
            new = _runs(key)
            self.at = np.empty_like(sort)
            self.at[sort] = np.repeat(np.arange(len(new)), np.diff(np.append(new, len(key))))
            counts = np.add.reduceat((~out).astype(np.int64), new)
        else:
            key = np.sort((key << 1) | out)
            out, key = key & 1, key >> 1
            new = _runs(key)
            counts = np.add.reduceat(1 - out, new)
        self.keys, self.counts = key[new], counts
        context = self.keys >> bits_w
        at = _runs(context)
        pairs = context[at] if values is None else values[context[at]]
        self.token, self.before, context_parent = numbers[self.keys & ((1 << bits_w) - 1)], befores[pairs & ((1 << bits_u) - 1)], pairs >> bits_u
        self.per_context, self.per_parent = np.diff(np.append(at, len(context))), np.bincount(context_parent, minlength=len(order))
        self.context_parent = context_parent
        self.parent_cut = np.searchsorted(shard, np.arange(shards + 1))
        self.context_cut = np.append(0, np.cumsum(self.per_parent))[self.parent_cut]
        self.cut = np.append(0, np.cumsum(self.per_context))[self.context_cut]

    def asks(self, block: int) -> list[tuple]:
        """What each shard is told: parents with how many contexts each, those with how many tokens each, and the tokens' counts."""
        out = []
        for s in np.flatnonzero(np.diff(self.cut)).tolist():
            p, c, t = (slice(x[s], x[s + 1]) for x in (self.parent_cut, self.context_cut, self.cut))
            out.append((
                s, block, pack_ascending(self.parent_word[p]), pack(self.parent_class[p]), pack(self.per_parent[p]), pack(self.before[c]), pack(self.per_context[c]), pack(self.token[t]), pack(self.counts[t]),
            ))
        return out


_ASKS = "shard long, block long, parents binary, classes binary, contexts binary, befores binary, sizes binary, tokens binary, counts binary"


def _asks(shards: int, most: int, starts: int):
    def run(batches):
        for batch in batches:
            for row in batch.to_pylist():
                yield _batch(Triples(row, shards, False, most, starts).asks(row["block"]), _ASKS)

    return run


class Shard:
    """All restaurants of a shard: contexts (2) and their parents (1), with the dishes of each.

    Dishes of one customer always have one table; sweeps go over the others (live) and the restaurants that have such.
    """

    def __init__(self, rows: list[dict], end: int):
        parent, kind, per_parent, before, per_context, token, count = ([f(x[c]) for x in rows] for f, c in (
            (unpack_ascending, "parents"), (unpack, "classes"), (unpack, "contexts"), (unpack, "befores"), (unpack, "sizes"), (unpack, "tokens"), (unpack, "counts")))
        self.cut = np.cumsum([0, *map(len, token)]).tolist()
        self.words, w = codes(np.concatenate(token))
        held, parent = codes((np.concatenate(parent) << 24) | np.concatenate(kind))
        # restaurants of first tokens, and the class of each
        self.first, self.kind = held >> 24 == end, held & 0xFFFFFF
        befores, u = codes(np.concatenate(before))
        bits_u, bits_w = len(befores).bit_length(), len(self.words).bit_length()
        self.n1 = int(parent.max()) + 1
        context, values = (np.repeat(parent, np.concatenate(per_parent)) << bits_u) | u, None
        if self.n1.bit_length() + bits_u + bits_w > KEY_BITS:
            values, context = codes(context)
        key = (np.repeat(context, np.concatenate(per_context)) << bits_w) | w
        sort = np.argsort(key)
        key = key[sort]
        new = _runs(key)
        self.of = np.empty_like(sort)
        self.of[sort] = np.repeat(np.arange(len(new)), np.diff(np.append(new, len(key))))
        self.c2 = np.add.reduceat(np.concatenate(count)[sort], new)
        key = key[new]
        starts = _runs(key >> bits_w)
        self.n2 = len(starts)
        self.restaurant2 = np.repeat(np.arange(self.n2), np.diff(np.append(starts, len(key))))
        of_parent = (key >> bits_w if values is None else values[key >> bits_w]) >> bits_u
        mids, self.up = codes((of_parent << bits_w) | (key & ((1 << bits_w) - 1)))
        self.restaurant1, self.word1 = mids >> bits_w, mids & ((1 << bits_w) - 1)
        self.t2 = np.minimum(self.c2, 1)
        self.live2 = np.flatnonzero(self.c2 > 1)
        self.up_live = self.up[self.live2]
        self.fixed1 = self._customers(np.flatnonzero(self.c2 == 1))
        self.c1 = self.fixed1 + self._customers(self.live2)
        self.t1 = np.minimum(self.c1, 1)
        self.live1 = np.flatnonzero(np.bincount(self.up, self.c2, len(mids)) > 1)
        self.asked1, self.asked = codes(self.up_live)

    def texts(self) -> np.ndarray:
        """Training texts whose first token is of each restaurant's class, for restaurants of first tokens."""
        return np.bincount(self.restaurant1[self.up], self.c2, self.n1)

    def base(self, p0: np.ndarray, share: np.ndarray) -> np.ndarray:
        """Probability of each parent's dish in the root; share: the root's probability of a restaurant's class, 1 for others."""
        return p0[self.word1] / share[self.restaurant1]

    def _customers(self, dishes: np.ndarray) -> np.ndarray:
        return np.bincount(self.up[dishes], self.t2[dishes], len(self.word1)).astype(np.int64)

    def sweep(self, rng: np.random.Generator, p0: np.ndarray, parameters: list[tuple[float, float]]) -> None:
        """Draws the tables of all dishes anew; p0: probability of each parent's dish in the root (base)."""
        p1 = r.distribution(rng, self.c1, self.t1, self.restaurant1, self.n1, p0, *parameters[1], self.asked1)
        self.t2[self.live2] = r.resample(rng, self.c2, self.t2, self.restaurant2, self.n2, p1[self.asked], *parameters[0], self.live2)
        self.c1 = self.fixed1 + np.bincount(self.up_live, self.t2[self.live2], len(self.word1)).astype(np.int64)
        self.t1 = np.minimum(self.t1, self.c1)
        self.t1[self.live1] = r.resample(rng, self.c1, self.t1, self.restaurant1, self.n1, p0[self.live1], *parameters[1], self.live1)

    def probabilities(self, p0: np.ndarray, parameters: list[tuple[float, float]]) -> np.ndarray:
        p1 = r.predictive(self.c1, self.t1, self.restaurant1, self.n1, p0, *parameters[1])
        return r.predictive(self.c2, self.t2, self.restaurant2, self.n2, p1[self.up], *parameters[0])


def _ordered(group: pa.Table) -> list[dict]:
    return sorted(group.to_pylist(), key=lambda x: x["block"])


_TABLES = "range long, shard long, ranks binary, tables binary, likelihood array<double>"


def _warm_up(ranges: int, n: int, curve: np.ndarray, end: int, texts: int, starts: int):
    """Sweeps with a root made of how often words of each rank occur; each word's tables go to its range."""

    def run(key: tuple[pa.Scalar, ...], group: pa.Table) -> pa.Table:
        me, shard = key[0].as_py(), Shard(_ordered(group), end)
        rng = np.random.default_rng([6, me])
        p0 = np.exp2(np.interp(np.log2(shard.words // ranges + 1), np.arange(len(curve)), np.log2(curve + 0.1))) / max(n, 1)
        p0 = shard.base(p0, np.where(shard.first & (starts > 1), (shard.texts() + 1) / (texts + starts), 1.0))
        for _ in range(WARM_UP):
            shard.sweep(rng, p0, FIRST)
        tables = np.bincount(shard.word1, shard.t1, len(shard.words)).astype(np.int64)
        fit = np.concatenate([r.likelihoods(shard.c2, shard.t2, shard.restaurant2, shard.n2), r.likelihoods(shard.c1, shard.t1, shard.restaurant1, shard.n1)]).reshape(-1)
        mine, out = shard.words % ranges, [(-1, me, b"", b"", fit.tolist())]
        for j in np.unique(mine).tolist():
            out.append((j, me, pack_ascending(shard.words[mine == j] // ranges), pack(tables[mine == j]), None))
        return _table(out, _TABLES)

    return run


_ROOT = "shard long, range long, customers binary, tables binary, n long, t long, held array<double>, kinds array<double>"


def _seat_root(kinds: int, subs: int):
    """Seats the root's customers, the tables of all shards, word by word of a range; the last row has what classes of first tokens hold."""

    def run(key: tuple[pa.Scalar, ...], group: pa.Table) -> pa.Table:
        me, rows = key[0].as_py(), sorted(group.to_pylist(), key=lambda x: x["shard"])
        ranks = [unpack_ascending(x["ranks"]) for x in rows]
        distinct, back = codes(np.concatenate(ranks))
        customers = np.bincount(back, np.concatenate([unpack(x["tables"]) for x in rows]), len(distinct)).astype(np.int64)
        discount, strength = FIRST[2]
        x = np.full(len(customers), (strength + discount * kinds) / (kinds + 1))  # every word has one table at first
        tables = r.draw_tables(np.random.default_rng([7, me]), customers, x, discount)
        cut = np.cumsum([0, *(len(a) for a in ranks)])
        out = [(x["shard"], me, pack(customers[back[a:b]]), pack(tables[back[a:b]]), 0, 0, None, None) for x, a, b in zip(rows, cut[:-1], cut[1:], strict=True)]
        held = np.bincount(distinct % subs, customers - discount * tables, subs)
        own = np.bincount(distinct % subs, customers > 0, subs)
        return _table([*out, (-1, me, b"", b"", int(customers.sum()), int(tables.sum()), held.tolist(), own.tolist())], _ROOT)

    return run


_ANSWERS = "block long, shard long, answers binary"


def _answer(ranges: int, kinds: int, parameters: list[tuple[float, float]], root: tuple[int, int], end: int, texts: int, mass: np.ndarray):
    """Averages the probability of every dish over sweeps, and answers each block in the order of its tokens."""

    def run(key: tuple[pa.Scalar, ...], left: pa.Table, right: pa.Table) -> pa.Table:
        rows = _ordered(left)
        if not rows:
            return _table([], _ANSWERS)
        me, shard = key[0].as_py(), Shard(rows, end)
        p0, mine, (discount, strength) = np.empty(len(shard.words)), shard.words % ranges, parameters[2]
        for x in right.to_pylist():
            c, t = unpack(x["customers"]), unpack(x["tables"])
            p0[mine == x["range"]] = (c - discount * t + (strength + discount * root[1]) / (kinds + 1)) / (strength + root[0])
        of_class = shard.first & (len(mass) > 1)
        p0 = shard.base(p0, np.where(of_class, mass[np.where(of_class, shard.kind, 0)], 1.0))
        chosen = np.where(of_class, (shard.texts() + 1) / (texts + np.count_nonzero(mass)), 1.0)  # classes without words are never chosen
        rng, p = np.random.default_rng([8, me]), np.zeros(len(shard.c2))
        for k in range(BURN_IN + SAMPLES):
            shard.sweep(rng, p0, parameters)
            if k >= BURN_IN:
                p += shard.probabilities(p0, parameters) / SAMPLES
        p *= chosen[shard.restaurant1[shard.up]]
        steps = np.rint(-np.log10(p) / STEP).astype(np.int64)[shard.of]
        return _table([(x["block"], me, pack(steps[a:b])) for x, a, b in zip(rows, shard.cut[:-1], shard.cut[1:], strict=True)], _ANSWERS)

    return run


_SCORES = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"


def _score(shards: int, n: int, most: int, starts: int):
    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        out = []
        for row in left.to_pylist():
            b = Triples(row, shards, True, most, starts)
            log = -STEP * np.concatenate([unpack(x["answers"]) for x in sorted(right.to_pylist(), key=lambda x: x["shard"])])
            out.append(pa.table([
                pa.array(np.frombuffer(row["doc_ids"], np.int64), mask=np.frombuffer(row["id_null"], bool)), pa.array(np.frombuffer(row["held"], bool)), pa.array(b.n_words + 1), pa.array(unpack(row["known"])),
                pa.array(np.full(len(b.n_words), n)), pa.array(np.frombuffer(row["base"], float)), pa.array(np.add.reduceat(log[b.at], b.starts)),
            ], names=[c.split()[0] for c in _SCORES.split(", ")]))
        return pa.concat_tables(out)

    return run


def score(spark: SparkSession, documents: DataFrame, parts: int = 10, most: int = MOST) -> DataFrame:
    """The contract's columns for each row of documents; rows of fold 0 are not learnt from."""
    scratch = Scratch(spark, "pitman-yor")
    rows = documents.select(documents["doc_id"].cast("long").alias("doc_id"), (fold(documents["doc_id"], parts) == 0).alias("held"), documents["text"].cast("string").alias("text"))
    blocks = scratch.write(rows.mapInArrow(releasing(_blocks), _BLOCKS), "blocks")
    tokens = blocks.agg(F.sum("n_tokens")).first()[0]
    if tokens is None:
        return spark.createDataFrame([], _SCORES)
    shards, ranges = -(-tokens // SHARD_TOKENS), -(-tokens // RANGE_TOKENS)

    numbers = scratch.write(blocks.mapInArrow(_word_asks(ranges), _WORD_ASKS).groupBy("range").applyInArrow(_number, _NUMBERS), "numbers")
    n, kinds = numbers.agg(F.sum("n"), F.sum("kinds")).first()
    curve = [x[0] for x in numbers.where("block < 0").select(F.posexplode("curve").alias("at", "c")).groupBy("at").agg(F.avg("c").alias("c")).orderBy("at").select("c").collect()]
    coded = blocks.drop("counts").groupBy("block").cogroup(numbers.where("block >= 0").groupBy("block")).applyInArrow(_code(ranges, n, kinds, most), _CODED)
    coded = scratch.write(coded, "coded")
    scratch.drop("blocks")
    scratch.drop("numbers")

    end, texts = coded.select("end_number", "end_count").first()
    starts = start_classes(texts, ranges, most)
    subs = max(1, starts // ranges)
    # a task takes a few shards, however many there are
    asks = coded.mapInArrow(_asks(shards, most, starts), _ASKS).repartition(-(-shards // 4), "shard")
    tables = scratch.write(asks.groupBy("shard").applyInArrow(_warm_up(ranges, n, np.array(curve), end, texts, starts), _TABLES), "tables")
    fit = [x[0] for x in tables.where("range < 0").select(F.posexplode("likelihood").alias("at", "x")).groupBy("at").agg(F.sum("x").alias("x")).orderBy("at").select("x").collect()]
    rng, half = np.random.default_rng(6), len(fit) // 2
    parameters = [r.sample_parameters(rng, np.array(fit[:half])), r.sample_parameters(rng, np.array(fit[half:])), FIRST[2]]
    seated = scratch.write(tables.where("range >= 0").groupBy("range").applyInArrow(_seat_root(kinds, subs), _ROOT), "root")
    root = tuple(seated.agg(F.sum("n"), F.sum("t")).first())
    mass = np.ones(1)
    if starts > 1:  # a number for each MOST texts
        discount, strength = parameters[2]
        held, own = np.zeros(starts), np.zeros(starts)
        for x in seated.where("shard < 0").select("range", "held", "kinds").collect():
            held[x["range"] :: ranges], own[x["range"] :: ranges] = x["held"], x["kinds"]
        own[0] += 1  # the unknown word
        mass = (held + (strength + discount * root[1]) * own / (kinds + 1)) / (strength + root[0])
    answers = asks.groupBy("shard").cogroup(seated.where("shard >= 0").groupBy("shard")).applyInArrow(_answer(ranges, kinds, parameters, root, end, texts, mass), _ANSWERS)
    return coded.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(_score(shards, n, most, starts), _SCORES)
