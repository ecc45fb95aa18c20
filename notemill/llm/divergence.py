r"""Source divergence audit (operator 12): how each source of a language differs from its other sources and from all.

Terms are runs of ASCII letters and bytes from 0x80, with A-Z in lower case. A NumPy table of the 256 bytes, looked up
over the concatenated UTF-8 buffer of many texts, finds their bounds; 64-bit xxHash groups the slices, and every slice
is compared with its group's first byte by byte, so a collision cannot merge two terms. Counts of (language, source,
term), and of documents, leave a task summed; Spark sums them over tasks by exact strings and keeps the terms in at
least `min_documents` documents of a language.

Kept terms are cut into blocks of about BLOCK_TERMS by hash. A block is a CSR matrix of sources by terms whose entries
are counts; terms that a source lacks all have one share, so sums over a row are `reduceat` over its entries and a
multiple of the rest. Blocks give partial sums and their best terms, which Spark adds and ranks. All arithmetic is in
whole numbers; shares are in thousand-millionths, rounded down, plus one.

Defined results: null text, lang and source are empty; every row is a document, repeated rows too; a source without
terms has every share, and a language without kept terms gives pairs of value 0 and no terms; ties are in UTF-8 order;
other columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import textcore
from .scratch import Scratch
from .worker import releasing

MIN_DOCUMENTS = 3
TOP = 200
SCALE = 1_000_000_000
BLOCK_TERMS = 16_384
CHUNK_BYTES = 4 << 20
#: Entries of a block's pair sums held at once.
TILE = 1 << 21

IS_TERM = np.zeros(256, bool)
IS_TERM[0x80:] = IS_TERM[ord("A") : ord("Z") + 1] = IS_TERM[ord("a") : ord("z") + 1] = True
LOWERED = np.arange(256, dtype=np.uint8)
LOWERED[ord("A") : ord("Z") + 1] += 32

# The primes of 64-bit xxHash.
P1 = np.uint64(11400714785074694791)
P2 = np.uint64(14029467366897019727)
P3 = np.uint64(1609587929392839161)
P4 = np.uint64(9650029242287828579)
P5 = np.uint64(2870177450012600261)


def spans(buf: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(start, end) of the terms of texts that lie one after another in buf."""
    inside = np.zeros(len(buf) + 1, bool)
    inside[:-1] = IS_TERM[buf]
    cut = np.zeros(len(buf) + 1, bool)
    cut[offsets] = True
    begins = inside.copy()
    begins[1:] &= ~inside[:-1] | cut[1:]
    ends = np.zeros(len(buf) + 1, bool)
    ends[1:] = inside[:-1] & (~inside[1:] | cut[1:])
    return np.flatnonzero(begins), np.flatnonzero(ends)


def _rotl(x: np.ndarray, n: int) -> np.ndarray:
    return (x << np.uint64(n)) | (x >> np.uint64(64 - n))


def _words(buf: np.ndarray) -> np.ndarray:
    """The 8 bytes at each place of buf as one little-endian number; zeros follow its end."""
    padded = np.concatenate([buf, np.zeros(8, np.uint8)])
    return np.ndarray((len(buf) + 1,), "<u8", padded, strides=(1,))


def hashes(buf: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit xxHash of each slice; slices of 32 bytes or more go to the library one by one."""
    size = end - start
    words = _words(buf)
    out = size.astype(np.uint64) + P5
    for k in (0, 8, 16):
        on = np.flatnonzero(size >= k + 8)
        out[on] = _rotl(out[on] ^ (_rotl(words[start[on] + k] * P2, 31) * P1), 27) * P1 + P4
    at, left = end - (size & 7), size & 7
    on = np.flatnonzero(left >= 4)
    out[on] = _rotl(out[on] ^ ((words[at[on]] & np.uint64(0xFFFFFFFF)) * P1), 23) * P2 + P3
    at, left = at + (left & 4), left & 3
    for k in range(3):
        on = np.flatnonzero(left > k)
        out[on] = _rotl(out[on] ^ (buf[at[on] + k].astype(np.uint64) * P5), 11) * P1
    out ^= out >> np.uint64(33)
    out *= P2
    out ^= out >> np.uint64(29)
    out *= P3
    out ^= out >> np.uint64(32)
    for i in np.flatnonzero(size >= 32).tolist():
        out[i] = xxhash.xxh64_intdigest(buf[start[i] : end[i]].tobytes())
    return out


def same_bytes(buf: np.ndarray, start: np.ndarray, end: np.ndarray, other: np.ndarray) -> np.ndarray:
    """Is each slice byte for byte the slice numbered in other."""
    size = end - start
    same = size == size[other]
    words = _words(buf)
    full = np.uint64(0xFFFFFFFFFFFFFFFF)
    k, on = 0, np.flatnonzero(same)
    while len(on):
        rest = np.minimum(size[on] - k, 8).astype(np.uint64)
        differ = (words[start[on] + k] ^ words[start[other[on]] + k]) & (full >> (np.uint64(64) - np.uint64(8) * rest))
        same[on[differ != 0]] = False
        k += 8
        on = on[(size[on] > k) & (differ == 0)]
    return same


def count_terms(buf: np.ndarray, offsets: np.ndarray, group: np.ndarray, hashed=hashes) -> tuple[pa.Array, np.ndarray, np.ndarray, np.ndarray]:
    """(term, group, occurrences, documents) of texts whose group numbers ascend."""
    buf = LOWERED[buf]
    start, end = spans(buf, offsets)
    doc = np.searchsorted(offsets, start, side="right") - 1
    key = hashed(buf, start, end)
    order = np.argsort(key, kind="stable")
    sorted_key = key[order]
    new = np.ones(len(order), bool)
    new[1:] = sorted_key[1:] != sorted_key[:-1]
    first = np.empty(len(order), np.int64)
    first[order] = order[np.flatnonzero(new)][np.cumsum(new) - 1]
    if not same_bytes(buf, start, end, first).all():
        # Different slices with one hash: group by the bytes themselves.
        known: dict[bytes, int] = {}
        key = np.array([known.setdefault(buf[a:b].tobytes(), len(known)) for a, b in zip(start.tolist(), end.tolist(), strict=True)], np.uint64)
        order = np.argsort(key, kind="stable")
        new[1:] = key[order][1:] != key[order][:-1]
    doc, of_group = doc[order], group[doc[order]]
    new_pair, new_doc = new.copy(), new.copy()
    new_pair[1:] |= of_group[1:] != of_group[:-1]
    new_doc[1:] |= doc[1:] != doc[:-1]
    pairs = np.flatnonzero(new_pair)
    n = np.diff(np.append(pairs, len(order)))
    docs = np.add.reduceat(new_doc.astype(np.int64), pairs) if len(pairs) else n
    at = order[new]
    terms = pa.array([], pa.string()) if not len(at) else _slices(buf, start[at], end[at])
    return terms.take(pa.array(np.cumsum(new)[pairs] - 1)), of_group[pairs], n, docs


def _slices(buf: np.ndarray, start: np.ndarray, end: np.ndarray) -> pa.Array:
    size = end - start
    offsets = np.zeros(len(size) + 1, np.int64)
    np.cumsum(size, out=offsets[1:])
    place = np.arange(offsets[-1]) + np.repeat(start - offsets[:-1], size)
    return pa.StringArray.from_buffers(len(size), pa.py_buffer(offsets.astype(np.int32)), pa.py_buffer(buf[place]))


def term_counts(documents: DataFrame) -> DataFrame:
    """(lang, source, term, n, docs), summed over each batch of documents only."""

    def run(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            codes = [c.dictionary_encode() for c in (batch.column(0), batch.column(1))]
            group = codes[0].indices.to_numpy().astype(np.int64) * len(codes[1].dictionary) + codes[1].indices.to_numpy()
            order = np.argsort(group, kind="stable")
            group = group[order]
            buf, offsets = textcore.buffers(textcore.large_text(batch.column(2)).take(pa.array(order)))
            i = 0
            while i < len(group):
                j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + CHUNK_BYTES, side="right")) - 1)
                term, of, n, docs = count_terms(buf[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i], group[i:j])
                names = [codes[0].dictionary.take(pa.array(of // len(codes[1].dictionary))), codes[1].dictionary.take(pa.array(of % len(codes[1].dictionary)))]
                yield pa.RecordBatch.from_arrays([*names, term, pa.array(n, pa.int64()), pa.array(docs, pa.int64())], names=["lang", "source", "term", "n", "docs"])
                i = j

    return documents.select("lang", "source", "text").mapInArrow(releasing(run), "lang string, source string, term string, n long, docs long")


def share(n: np.ndarray, total: int) -> np.ndarray:
    """1 + SCALE * (n + 1) / total, rounded down; exact for any n."""
    if total <= 0:
        return np.zeros(len(n), np.int64)
    if len(n) and int(n.max()) >= (1 << 62) // SCALE:
        return np.array([1 + SCALE * (x + 1) // total for x in n.tolist()], np.int64)
    return 1 + SCALE * (n.astype(np.int64) + 1) // np.int64(total)


def divergence(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    return (p - q) * (p - q) // q


def block_sums(row: np.ndarray, column: np.ndarray, n: np.ndarray, n_columns: int, totals: np.ndarray, vocabulary: int) -> np.ndarray:
    """Sums over a block's columns of the divergence of every row from every other; entries are sorted by (row, column)."""
    rows = len(totals)
    out = np.zeros((rows, rows), np.int64)
    if not n_columns:
        return out
    bounds = np.searchsorted(row, np.arange(rows + 1))
    full = np.flatnonzero(np.diff(bounds))  # rows with entries; reduceat needs spans that are not empty
    none = np.array([share(np.zeros(1, np.int64), int(t) + vocabulary)[0] for t in totals], np.int64)
    p = np.concatenate([share(n[a:b], int(t) + vocabulary) for a, b, t in zip(bounds[:-1], bounds[1:], totals, strict=True)]) if rows else n
    lacking = none[row]
    for b in range(rows):
        entries = slice(bounds[b], bounds[b + 1])
        q = np.full(n_columns, none[b])
        q[column[entries]] = p[entries]
        # As if no row had an entry: b's own entries against each row's share of nothing, and the rest of the columns.
        own = p[entries]
        tile = max(1, TILE // max(1, len(own)))
        for a in range(0, rows, tile):
            out[a : a + tile, b] = divergence(none[a : a + tile, None], own[None, :]).sum(axis=1)
        out[:, b] += divergence(none, none[b]) * (n_columns - len(own))
        # Then every entry takes the place of its share of nothing.
        if len(full):
            out[full, b] += np.add.reduceat(divergence(p, q[column]) - divergence(lacking, q[column]), bounds[full])
    return out


def _block(entries: pa.Table, groups: pa.Table, top: int) -> pa.Table:
    """Partial pair sums and best terms of one block of one language."""
    lang = groups["lang"][0].as_py()
    groups = groups.sort_by("source")
    sources, totals = groups["source"].to_pylist(), groups["total"].to_numpy()
    vocabulary, lang_total = groups["vocabulary"][0].as_py(), groups["lang_total"][0].as_py()
    coded = entries["term"].combine_chunks().dictionary_encode() if entries.num_rows else pa.array([], pa.string()).dictionary_encode()
    coded = pa.concat_arrays(coded.chunks) if isinstance(coded, pa.ChunkedArray) else coded
    column = coded.indices.to_numpy().astype(np.int64)
    row = pc.index_in(entries["source"], pa.array(sources, pa.string())).to_numpy().astype(np.int64)
    order = np.lexsort((column, row))
    row, column, n, all_n = row[order], column[order], entries["n"].to_numpy()[order], entries["lang_n"].to_numpy()[order]
    sums = block_sums(row, column, n, len(coded.dictionary), totals, vocabulary)
    out = {"source": [], "part": [], "item": [], "value": []}

    def add(source: str, part: str, items: list[str], values: list[int]) -> None:
        out["source"] += [source] * len(items)
        out["part"] += [part] * len(items)
        out["item"] += items
        out["value"] += values

    bounds = np.searchsorted(row, np.arange(len(sources) + 1))
    for a, source in enumerate(sources):
        others = [b for b in range(len(sources)) if b != a]
        add(source, "pair", [sources[b] for b in others], sums[a, others].tolist())
        e = slice(bounds[a], bounds[a + 1])
        p, q = share(n[e], int(totals[a]) + vocabulary), share(all_n[e], lang_total + vocabulary)
        over = np.flatnonzero((p > q) & (n[e] > 0))
        value = divergence(p[over], q[over])
        if len(over) > top:  # with all that tie with the last
            over = over[value >= np.partition(value, len(value) - top)[len(value) - top]]
            value = divergence(p[over], q[over])
        names = coded.dictionary.take(pa.array(column[e][over])).to_pylist()
        best = sorted(zip((-value).tolist(), [x.encode() for x in names], strict=True))[:top]
        add(source, "term", [x.decode() for _, x in best], [-v for v, _ in best])
    kinds = {"source": pa.string(), "part": pa.string(), "item": pa.string(), "value": pa.int64()}
    return pa.table({"lang": pa.array([lang] * len(out["item"]), pa.string())} | {k: pa.array(v, kinds[k]) for k, v in out.items()})


def kept_terms(documents: DataFrame, min_documents: int) -> DataFrame:
    """(lang, term, source, n, lang_n, lead): counts of the kept terms; lead marks one row of each (lang, term)."""
    # Tasks have summed their texts already, so rows go straight to where the windows need them.
    counts = term_counts(documents).repartition("lang", "term").groupBy("lang", "term", "source").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))
    of_term = Window.partitionBy("lang", "term")
    held = counts.select(
        "lang", "term", "source", "n", F.sum("n").over(of_term).alias("lang_n"), F.sum("docs").over(of_term).alias("held"), (F.row_number().over(of_term.orderBy("source")) == 1).alias("lead")
    )
    return held.where(F.col("held") >= min_documents).drop("held")


def audit(documents: DataFrame, min_documents: int = MIN_DOCUMENTS, top: int = TOP, block_terms: int = BLOCK_TERMS) -> DataFrame:
    """lang, source, part, item, value, rank: every other source of the language (part pair), and the terms that the source has more of than its language (part term)."""
    scratch = Scratch(documents.sparkSession, "audit")
    docs = documents.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source", "text")])
    kept = scratch.write(kept_terms(docs, min_documents), "kept")
    per_source = kept.groupBy("lang", "source").agg(F.sum("n").alias("total"), F.sum(F.col("lead").cast("long")).alias("terms"))
    groups = docs.select("lang", "source").distinct().join(per_source, ["lang", "source"], "left")
    of_lang = Window.partitionBy("lang")
    groups = groups.select("lang", "source", F.coalesce("total", F.lit(0)).alias("total"), F.coalesce(F.sum("total").over(of_lang), F.lit(0)).alias("lang_total"), F.coalesce(F.sum("terms").over(of_lang), F.lit(0)).alias("vocabulary"))
    groups = scratch.write(groups.withColumn("blocks", F.greatest(F.lit(1), F.ceil(F.col("vocabulary") / block_terms)).cast("long")), "groups")

    blocks = groups.groupBy("lang").agg(F.max("blocks").alias("blocks"))
    entries = kept.join(blocks, "lang").select("lang", F.pmod(F.xxhash64("term"), "blocks").alias("block"), "term", "source", "n", "lang_n")
    needed = groups.select("lang", "source", "total", "lang_total", "vocabulary", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)).alias("block"))
    parts = entries.groupBy("lang", "block").cogroup(needed.groupBy("lang", "block")).applyInArrow(lambda x, y: _block(x, y, top), "lang string, source string, part string, item string, value long")
    parts = scratch.write(parts, "parts")

    best = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    pairs = parts.where("part = 'pair'").groupBy("lang", "source", "part", "item").agg(F.sum("value").alias("value")).withColumn("rank", F.row_number().over(best))
    terms = parts.where("part = 'term'").withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= top)
    return pairs.unionByName(terms)
