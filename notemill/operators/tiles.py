"""Block-wise search: all queries against blocks of notes or vectors, of which only the best of each query leave.

Rows are dealt to blocks by a hash of their key; every block gets the queries, a stated set, beside its rows. A block adds up
token overlaps from its own postings, or multiplies query by note vectors, in NumPy, and returns `depth` rows a query at
most, in the order of the whole result (score, then newest, then path). As any row of the whole result is among the best
of its block, the best of all blocks hold it. No pair of a query and a note leaves a task otherwise, no token's list is in
one task (its notes are in all blocks), and memory is bounded by a block and a tile of queries.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from ..functions import text as t
from ..schema import Settings

BLOCK_ROWS = 65_536
#: Rows that make a block of their own while there are fewer blocks than cores.
LEAST_ROWS = 1_000
#: Scores of a tile of queries that are held at once.
TILE = 1 << 21
#: Digits of a cosine that count, unless the caller says how many.
DIGITS = 12


@dataclass(frozen=True)
class Vectors:
    """Vectors of notes (rel_path, embedding) and of queries (query_id, query_vector)."""

    notes: DataFrame
    queries: DataFrame


def n_blocks(rows: DataFrame) -> int:
    """Blocks for so many rows; they are counted."""
    n = rows.count()
    return max(1, -(-n // BLOCK_ROWS), min(rows.sparkSession.sparkContext.defaultParallelism, -(-n // LEAST_ROWS)))


def _block(key: str, blocks: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(blocks)).alias("block")


def _everywhere(queries: DataFrame, blocks: int) -> DataFrame:
    return queries.withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long"))))


def _ddl(df: DataFrame, *names: str) -> list[str]:
    kinds = {f.name: f.dataType.simpleString() for f in df.schema.fields}
    return [f"`{n}` {kinds[n]}" for n in names]


class _Postings:
    """Hits (token, note, n, g) of a block by token."""

    def __init__(self, token: pa.Array, note: np.ndarray, n: np.ndarray, g: np.ndarray):
        coded = token.dictionary_encode()
        codes = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        order = np.argsort(codes, kind="stable")
        self.place = {x: i for i, x in enumerate(coded.dictionary.to_pylist())}
        self.cut = np.searchsorted(codes[order], np.arange(len(self.place) + 1))
        self.note, self.n, self.g = note[order], n[order], g[order]

    def counts(self, tokens: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(note, lexical count, tag count) of the notes that hold any of the tokens."""
        at = [np.arange(self.cut[i], self.cut[i + 1]) for x in tokens if (i := self.place.get(x)) is not None]
        if not at:
            none = np.zeros(0, np.int64)
            return none, none, none
        at = np.concatenate(at)
        notes, back = np.unique(self.note[at], return_inverse=True)
        return notes, np.bincount(back, self.n[at], len(notes)).astype(np.int64), np.bincount(back, self.g[at], len(notes)).astype(np.int64)


def _whole(column: pa.ChunkedArray) -> pa.Array:
    column = column.combine_chunks()
    return pa.concat_arrays(column.chunks) if isinstance(column, pa.ChunkedArray) else column


def _age(notes: pa.Table) -> np.ndarray:
    """Place of each note, the newest first, then by path downwards."""
    order = pc.sort_indices(notes.select(["updated", "rel_path"]), sort_keys=[("updated", "descending"), ("rel_path", "descending")]).to_numpy()
    place = np.empty(len(order), np.int64)
    place[order] = np.arange(len(order))
    return place


def _best(score: np.ndarray, age: np.ndarray, depth: int) -> np.ndarray:
    """Places of the best scores, ties by age."""
    some = np.arange(len(score))
    if len(score) > depth:
        some = np.flatnonzero(score >= np.partition(score, len(score) - depth)[len(score) - depth])
    return some[np.lexsort((age[some], -score[some]))[:depth]]


def _equal(column: pa.Array, value: str) -> np.ndarray:
    return pc.fill_null(pc.equal(column, value), False).to_numpy(zero_copy_only=False)


def _true(column: pa.ChunkedArray) -> list[bool]:
    return [bool(x) for x in column.to_pylist()]


def overlap_best(queries: DataFrame, postings: DataFrame, carried: tuple[str, ...], depth: int, blocks: int) -> DataFrame:
    """query_id, rel_path, carried, lexical_count, tag_count of pairs that share a token: of each block the best by the coarse score
    (rank.coarse_score). Queries of all scopes get pairs with a positive score alone.

    postings: token, rel_path, n, g, carried. Those of tokens that nobody asks for don't leave the scan.
    """
    asked = queries.select(F.explode("query_tokens").alias("token")).distinct()
    own = t.canonical_scope(F.coalesce("scope", F.lit("")))
    hits = postings.select("token", "rel_path", "n", "g", *carried).join(asked, "token").withColumns({"own_scope": own, "block": _block("rel_path", blocks)})
    sent = _everywhere(queries.select("query_id", "query_tokens", "query_scope", "history", "loop", "pref"), blocks)
    names = ["rel_path", *carried]
    schema = ", ".join([*_ddl(queries, "query_id"), *_ddl(postings, *names), "lexical_count long", "tag_count long"])

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        picked, who, lexical, tags = [], [], [], []
        if left.num_rows:
            coded = _whole(left["rel_path"]).dictionary_encode()
            note = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
            _, first = np.unique(note, return_index=True)
            notes = left.take(pa.array(first))
            kind, status, scope, age = _whole(notes["type"]), _whole(notes["status"]), _whole(notes["own_scope"]), _age(notes)
            loop, pref = _equal(kind, "loop"), _equal(kind, "pref")
            closed, is_open = loop & _equal(status, "closed"), loop & _equal(status, "open")
            index = _Postings(_whole(left["token"]), note, left["n"].to_numpy(), left["g"].to_numpy())
            asks = zip(right["query_tokens"].to_pylist(), right["query_scope"].to_pylist(), *(_true(right[c]) for c in ("history", "loop", "pref")), strict=True)
            for q, (tokens, where, history, loops, prefers) in enumerate(asks):
                at, n, g = index.counts(tokens or [])
                size = max(1, len(tokens or []))
                match = np.ones(len(at)) if where == "all" else _equal(scope.take(pa.array(at)), where).astype(float) if where is not None else np.zeros(len(at))
                score = 0.70 * (n / size) + 0.20 * (g / size) + 0.10 * match
                score = score + (0.0 if where == "all" else np.where(match >= 1, 0.03, -0.03))
                score = score + np.where(closed[at], 0.05 if history else -0.05, 0.0)
                score = score + np.where(is_open[at], 0.04 if loops else 0.0, 0.0)
                score = score + np.where(pref[at], 0.04 if prefers else 0.0, 0.0)
                if where == "all":
                    kept = score > 0
                    at, n, g, score = at[kept], n[kept], g[kept], score[kept]
                best = _best(score, age[at], depth)
                picked.append(at[best])
                lexical.append(n[best])
                tags.append(g[best])
                who.append(np.full(len(best), q))
        none = [np.zeros(0, np.int64)]
        picked, who, lexical, tags = (np.concatenate(x or none).astype(np.int64) for x in (picked, who, lexical, tags))
        rows = (notes if left.num_rows else left).select(names).take(pa.array(picked))
        return pa.table({"query_id": right["query_id"].take(pa.array(who))} | {c: rows[c] for c in names} | {"lexical_count": lexical, "tag_count": tags})

    return hits.groupBy("block").cogroup(sent.groupBy("block")).applyInArrow(run, schema)


def _matrix(column: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """(vectors, lengths) of a list column as numbers; null and zero vectors have length 0, null entries are 0."""
    if not len(column):
        return np.zeros((0, 0)), np.zeros(0)
    lists = _whole(column)
    size = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False)
    out = np.zeros((len(lists), int(size.max())))
    at = np.arange(int(size.sum())) - np.repeat(np.cumsum(size) - size, size)
    out[np.repeat(np.arange(len(lists)), size), at] = pc.fill_null(lists.flatten().cast(pa.float64()), 0.0).to_numpy(zero_copy_only=False)
    return out, np.sqrt((out * out).sum(1))


def cosines(a: np.ndarray, norm_a: np.ndarray, b: np.ndarray, norm_b: np.ndarray) -> np.ndarray:
    """Cosines of all rows of a with all of b, 0 for zero vectors."""
    dims = max(a.shape[1], b.shape[1])
    wide = lambda m: np.pad(m, ((0, 0), (0, dims - m.shape[1])))
    norm = norm_a[:, None] * norm_b[None, :]
    with np.errstate(divide="ignore", invalid="ignore"):
        return np.round(np.where(norm > 0, wide(a) @ wide(b).T / norm, 0.0), DIGITS)


def half_away(x: np.ndarray, digits: int) -> np.ndarray:
    """x rounded to digits in floating point, halves away from zero, as SQL engines do."""
    with np.errstate(invalid="ignore"):
        scaled = np.abs(x) * 10.0**digits
        whole = np.trunc(scaled)
        return np.copysign((whole + (scaled - whole >= 0.5)) / 10.0**digits, x)


def _in_order(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Products of rows, summed from the first entry to the last, so that they don't depend on where a row stands."""
    return np.cumsum(x * y, axis=-1)[..., -1] if x.shape[-1] else np.zeros(len(x))


def _copies(rows: np.ndarray) -> np.ndarray:
    """Number of each row's vector, the same for equal ones."""
    if not rows.size:
        return np.zeros(len(rows), np.int64)
    return np.unique(np.ascontiguousarray(rows).view(f"V{rows.shape[1] * rows.itemsize}").ravel(), return_inverse=True)[1].ravel()


def _null(column: pa.ChunkedArray) -> np.ndarray:
    return column.is_null().to_numpy()


def nearest(vectors: DataFrame, queries: DataFrame, limit: int, digits: int = DIGITS, undefined: bool = False) -> DataFrame:
    """query_id, id, cosine, tied of the best vectors (id, embedding) of each query (query_id, query_vector) in each block, by the cosine rounded
    to digits (tied), then by id, null last.

    Products of whole blocks say which rows may be among the best; their cosines are then summed in order, once for equal vectors.
    Without a direction the cosine is 0. With `undefined` only a zero vector's is: another's is NaN against a zero query or with entries that
    aren't finite, and comes first; null vectors and queries have none, and come last.
    """
    blocks = n_blocks(vectors)
    schema = ", ".join([*_ddl(queries, "query_id"), *_ddl(vectors, "id"), "cosine double", "tied double"])

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        left = left.sort_by("id")
        (rows, norm), (asked, asked_norm) = _matrix(left["embedding"]), _matrix(right["query_vector"])
        dims = max(rows.shape[1], asked.shape[1])
        rows, asked = (np.pad(m, ((0, 0), (0, dims - m.shape[1]))) for m in (rows, asked))
        none, no_query, copy = _null(left["embedding"]), _null(right["query_vector"]), _copies(rows)
        picked, who, found, keys, tile = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0)], [np.zeros(0)], max(1, TILE // max(1, len(rows)))
        for i in range(0, len(asked) if len(rows) else 0, tile):
            some = slice(i, i + tile)
            with np.errstate(divide="ignore", invalid="ignore", over="ignore"):
                c = asked[some] @ rows.T / (asked_norm[some, None] * norm)
            c[np.isnan(c)] = np.inf if undefined else 0.0
            if undefined:
                c[no_query[some]] = -np.inf
                c[:, none] = -np.inf
                c[:, ~none & (norm == 0)] = 0.0
            for q in range(len(c)):
                last = np.partition(c[q], len(rows) - limit)[len(rows) - limit] if len(rows) > limit else -np.inf
                at = np.flatnonzero(c[q] >= last - 1.1 * 10.0**-digits - 1e-12)
                value, live = c[q][at], np.isfinite(c[q][at]) & (norm[at] > 0) & (asked_norm[i + q] > 0)
                _, first, back = np.unique(copy[at[live]], return_index=True, return_inverse=True)
                x, y = rows[at[live][first]], asked[i + q][None, :]
                value[live] = np.clip(_in_order(x, y) / np.sqrt(_in_order(x, x) * _in_order(y, y)), -1, 1)[back]
                key = half_away(value, digits)
                best = np.lexsort((at, -key))[:limit]
                picked.append(at[best])
                who.append(np.full(len(best), i + q))
                found.append(value[best])
                keys.append(key[best])
        cosine, tied = np.concatenate(found), np.concatenate(keys)
        cosine = pa.array(np.where(cosine == np.inf, np.nan, cosine), mask=cosine == -np.inf, from_pandas=False)
        return pa.table({"query_id": right["query_id"].take(pa.array(np.concatenate(who))), "id": left["id"].take(pa.array(np.concatenate(picked))), "cosine": cosine, "tied": tied})

    rows = vectors.select("id", "embedding", _block("id", blocks))
    return rows.groupBy("block").cogroup(_everywhere(queries.select("query_id", "query_vector"), blocks).groupBy("block")).applyInArrow(run, schema)


def hybrid_best(queries: DataFrame, entries: DataFrame, postings: DataFrame, vectors: Vectors, recency: Column, depth: int, settings: Settings) -> DataFrame:
    """query_id, rel_path, cosine, lexical_count, tag_count: of each block the best notes of each query by the hybrid score (rank.hybrid)."""
    blocks = n_blocks(entries)
    asked = queries.select(F.explode("query_tokens").alias("token")).distinct()
    hits = postings.select("token", "rel_path", "n", "g").join(asked, "token").groupBy("rel_path").agg(F.collect_list(F.struct("token", "n", "g")).alias("hits"))  # a note's own tokens
    own = t.canonical_scope(F.coalesce("scope", F.lit("")))
    rows = entries.select("rel_path", "updated", own.alias("own_scope"), recency.alias("recency")).join(vectors.notes.select("rel_path", "embedding"), "rel_path", "left").join(hits, "rel_path", "left")
    sent = queries.select("query_id", "query_tokens", "query_scope").join(vectors.queries.select("query_id", "query_vector"), "query_id", "left")
    schema = ", ".join([*_ddl(queries, "query_id"), "rel_path string, cosine double, lexical_count long, tag_count long"])
    s = settings

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        out: dict[str, list] = {"who": [], "at": [], "cosine": [], "n": [], "g": []}
        if left.num_rows:
            age, scope, recent = _age(left), _whole(left["own_scope"]), left["recency"].to_numpy()
            held = _whole(left["hits"])
            flat = held.flatten()
            note = np.repeat(np.arange(len(held)), pc.fill_null(pc.list_value_length(held), 0).to_numpy(zero_copy_only=False))
            index = _Postings(flat.field("token"), note, flat.field("n").to_numpy(zero_copy_only=False), flat.field("g").to_numpy(zero_copy_only=False))
            (known, norm), (asked, asked_norm) = _matrix(left["embedding"]), _matrix(right["query_vector"])
            every, tokens_of, scopes = np.arange(len(held)), right["query_tokens"].to_pylist(), right["query_scope"].to_pylist()
            tile = max(1, TILE // len(held))
            for i in range(0, len(asked), tile):
                c = np.clip(cosines(asked[i : i + tile], asked_norm[i : i + tile], known, norm), 0, 1)
                for q in range(len(c)):
                    tokens, where = tokens_of[i + q] or [], scopes[i + q]
                    at, n, g = index.counts(tokens)
                    size, lexical, all_n, all_g = max(1, len(tokens)), np.zeros(len(held)), np.zeros(len(held), np.int64), np.zeros(len(held), np.int64)
                    all_n[at], all_g[at] = n, g
                    lexical[at] = np.clip(0.70 * (n / size) + 0.30 * (g / size), 0, 1)
                    match = 1.0 if where == "all" else _equal(scope, where).astype(float) if where is not None else 0.0
                    score = s.hybrid_vector * c[q] + s.hybrid_lexical * lexical + s.hybrid_scope * match + s.hybrid_recency * recent
                    some = every[(c[q] > 0) | (lexical > 0)]
                    best = some[_best(np.clip(score[some], 0, 1), age[some], depth)]
                    for name, x in (("who", np.full(len(best), i + q)), ("at", best), ("cosine", c[q][best]), ("n", all_n[best]), ("g", all_g[best])):
                        out[name].append(x)
        who, at, cosine, n, g = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in out.values())
        return pa.table({
            "query_id": right["query_id"].take(pa.array(who.astype(np.int64))), "rel_path": left["rel_path"].take(pa.array(at.astype(np.int64))), "cosine": cosine.astype(float),
            "lexical_count": n.astype(np.int64), "tag_count": g.astype(np.int64),
        })

    return rows.withColumn("block", _block("rel_path", blocks)).groupBy("block").cogroup(_everywhere(sent, blocks).groupBy("block")).applyInArrow(run, schema)


def okapi(pool: DataFrame, settings: Settings) -> DataFrame:
    """pool (query_id, query_tokens, dl, note_tokens, a short list for each query) with bm25 in [0, 1] in place of note_tokens: Okapi over each
    query's own rows, divided by its maximum."""
    kept = [c for c in pool.columns if c != "note_tokens"]
    schema = StructType([*[f for f in pool.schema.fields if f.name != "note_tokens"], StructField("bm25", DoubleType())])
    k1, b, epsilon = settings.bm25_k1, settings.bm25_b, settings.bm25_epsilon

    def run(rows: pa.Table) -> pa.Table:
        lists, dl = _whole(rows["note_tokens"]), rows["dl"].to_numpy().astype(float)
        coded, doc = lists.flatten().dictionary_encode(), np.repeat(np.arange(len(lists)), pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False))
        code = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        raw = np.zeros(len(lists))
        if len(code):
            df = np.bincount(code, minlength=len(coded.dictionary))
            idf = np.log(len(lists) - df + 0.5) - np.log(df + 0.5)
            idf = np.where(idf < 0, epsilon * idf.mean(), idf)
            wanted = pc.is_in(coded.dictionary, pa.array(rows["query_tokens"][0].as_py() or [], coded.dictionary.type)).to_numpy(zero_copy_only=False)
            hit = wanted[code]
            raw = np.bincount(doc[hit], idf[code[hit]], len(lists)) * (k1 + 1) / (1 + k1 * (1 - b + b * dl / dl.mean())) if hit.any() else raw
        top = raw.max(initial=0)
        return rows.select(kept).append_column("bm25", pa.array(np.maximum(0.0, raw / top) if top > 0 else np.zeros(len(raw))))

    return pool.groupBy("query_id").applyInArrow(run, schema)
