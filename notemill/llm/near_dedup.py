"""Near-duplicate groups by HyperMinHash (operator 10).

A document's set is its distinct 5-word shingles (ASCII letters lower-cased). A sketch has ``BANDS * ROWS`` registers;
each keeps, of the least hash of its own random permutation of the set, the count of leading zeros and the mantissa bits
after them, in 16 bits. Four registers make a band; sets that share a band's registers are candidates. At similarity 0.75
a pair misses all 32 bands once in 190,000 times; no candidate is capped or sampled away.

No step emits the pairs of a group: copies of one set are one node; in a bucket all nodes are first tried against the
bucket's least node, then only nodes still in different components against each other, first each with its most similar
one, last all that remain, of which a task gives out only those that sets of shortened hashes don't rule out. Every try passes the
collision-corrected Jaccard estimate of the sketches (``LEAST_ESTIMATE``, over six standard errors below the threshold: it drops
less than one pair in 10 ** 9) and is then confirmed on the full sets. Large buckets are compared block by block, and blocks by
size of set, as sets of unlike size can't be linked; so no task holds a bucket whole.

A node is a set, known by a 128-bit signature; its text is found again by id and a hash of the text, and by the signature.

Defined results: a text without words has an empty set, no links, and is its own component; fewer words than a shingle
make one shingle of all; rows of one doc_id are judged each by its own text; a null doc_id takes the component of the
rows that its text is linked with, null if none has an id, and is kept only then; other columns are ignored; an empty
table gives an empty result. Texts of any length are taken whole.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import textcore as tc
from .scratch import Scratch
from .worker import releasing

SHINGLE, BANDS, ROWS, MANTISSA = 5, 32, 4, 10
REGISTERS = BANDS * ROWS
THRESHOLD = 75
LEAST_ESTIMATE = 0.50
#: Of the last 32 registers at least so many must agree; a pair at the threshold has fewer once in 10 ** 9 times.
LEAST_AGREE = 8
#: Members of a bucket that are compared in one task at once.
BLOCK = 1024
_draw = np.random.default_rng(20240229)
_MULTIPLY = _draw.integers(0, 2**63, REGISTERS, np.uint64) * np.uint64(2) + np.uint64(1)
_ADD = _draw.integers(0, 2**63, REGISTERS, np.uint64) * np.uint64(2) + np.uint64(1)


def sketch(h: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Registers (uint16) of each non-empty set; set i is h[bounds[i]:bounds[i + 1]]."""
    starts = bounds[:-1][bounds[1:] > bounds[:-1]]
    least = np.empty((len(starts), REGISTERS), np.uint64)
    if len(starts):
        for i in range(REGISTERS):
            v = h * _MULTIPLY[i]
            v += _ADD[i]
            least[:, i] = np.minimum.reduceat(v, starts)
    zeros = np.uint64(53) - np.frexp((least >> np.uint64(11)).astype(np.float64))[1].astype(np.uint64)
    mantissa = (least << (zeros + np.uint64(1))) >> np.uint64(64 - MANTISSA)
    return ((zeros << np.uint64(MANTISSA)) | mantissa).astype(np.uint16)


def collision(n: np.ndarray, m: np.ndarray) -> np.ndarray:
    """Chance that registers of unrelated sets of n and m shingles agree."""
    k = np.arange(1, 54)

    def at(size):
        size = np.asarray(size, float)[..., None]
        upto = -np.expm1(size * np.log1p(-np.minimum(2.0 ** -(k - 1.0), 1 - 1e-16)))
        over = -np.expm1(size * np.log1p(-(2.0**-k)))
        return np.clip(upto - over, 0, 1)

    return (at(n) * at(m)).sum(-1) / 2**MANTISSA


def estimate(equal: np.ndarray, n: np.ndarray, m: np.ndarray) -> np.ndarray:
    """Jaccard similarity from the share of equal registers, corrected for chance collisions."""
    c = collision(n, m)
    return np.clip((equal / REGISTERS - c) / (1 - c), 0, 1)


def signatures(h: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """128-bit identity of each set, as two 64-bit sums; 0 for an empty one."""
    out = []
    for salt in (0x5851F42D4C957F2D, 0x14057B7EF767814F):
        total = np.zeros(len(h) + 1, np.uint64)
        np.cumsum(tc.mix(h ^ np.uint64(salt)), out=total[1:])
        out.append((total[bounds[1:]] - total[bounds[:-1]]).view(np.int64))
    return out[0], out[1]


def _sketches(batches):
    for batch in batches:
        for i, j, t in tc.chunks(batch.column(2), lower=True):
            h, bounds = t.shingles(SHINGLE)
            n = np.diff(bounds).astype(np.int64)
            registers = sketch(h, bounds)
            full = np.zeros((t.n, REGISTERS), np.uint16)
            full[n > 0] = registers
            flat = pa.array([r.tobytes() if k else None for r, k in zip(full, n, strict=True)], pa.binary())
            s1, s2 = signatures(h, bounds)
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), batch.column(1).slice(i, j - i), pa.array(n), pa.array(s1), pa.array(s2), flat], names=["doc_id", "text_hash", "n_shingles", "s1", "s2", "registers"])


def _sets(batches):
    """Sets of the texts that have the signature of their node."""
    for batch in batches:
        for i, j, t in tc.chunks(batch.column(3), lower=True):
            h, bounds = t.shingles(SHINGLE)
            s1, s2 = signatures(h, bounds)
            ok = pa.array((s1 == np.asarray(batch.column(1).slice(i, j - i))) & (s2 == np.asarray(batch.column(2).slice(i, j - i))))
            sets = [pa.array([x[a:b].tobytes() for a, b in zip(bounds[:-1], bounds[1:], strict=True)], pa.binary()) for x in (h, (h >> np.uint64(32)).astype(np.uint32))]
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), *sets], names=["node", "set", "short"]).filter(ok)


def _registers(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint16).reshape(-1, REGISTERS)


def _likely(batches):
    """Pairs whose sizes and sketches allow the threshold."""
    for batch in batches:
        if not batch.num_rows:
            continue
        n, m = np.asarray(batch.column(2)), np.asarray(batch.column(3))
        equal = (_registers(batch.column(4)) == _registers(batch.column(5))).sum(1)
        ok = (estimate(equal, n, m) >= LEAST_ESTIMATE) & (100 * np.minimum(n, m) >= THRESHOLD * np.maximum(n, m))
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], names=["a", "b"]).filter(pa.array(ok))


def _linked(batches):
    """Pairs whose full sets reach the threshold."""
    for batch in batches:
        ok = []
        for x, y in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
            x, y = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
            both = len(np.intersect1d(x, y, assume_unique=True))
            ok.append(100 * both >= THRESHOLD * (len(x) + len(y) - both))
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], names=["a", "b"]).filter(pa.array(ok, pa.bool_()))


def _absent(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Which entries of x are not in the sorted array y."""
    at = np.searchsorted(y, x)
    at[at == len(y)] = 0
    return y[at] != x


def _across(best_only: bool):
    """Pairs of one bucket's blocks (i, j) in different components that the sketches allow."""

    def run(group: pa.Table) -> pa.Table:
        group = group.sort_by([("n", "ascending"), ("node", "ascending")])
        node, comp, n, rep = (np.asarray(group.column(c)) for c in ("node", "comp", "n", "rep"))
        band, blk, i, j = (np.asarray(group.column(c)) for c in ("band", "blk", "i", "j"))
        reg = np.frombuffer(b"".join(group.column("registers").to_pylist()), np.uint16).reshape(-1, REGISTERS)
        short = [] if best_only else group.column("short").to_pylist()
        hi, out_a, out_b = np.searchsorted(n, 100 * n // THRESHOLD, side="right"), [], []
        best: dict[int, tuple[float, int]] = {}
        earlier = int(band[0]) * ROWS if len(band) else 0
        for x in range(len(node)):
            y = np.arange(x + 1, hi[x])
            y = y[(comp[y] != comp[x]) & (node[y] != rep[x]) & (node[x] != rep[x]) & ((i[0] == j[0]) | (blk[y] != blk[x]))]
            if not len(y):
                continue
            y = y[(reg[y, -32:] == reg[x, -32:]).sum(1) >= LEAST_AGREE]
            same = reg[y] == reg[x]
            if earlier and len(y) and not best_only:  # a pair that shares an earlier band is met there
                fresh = ~same[:, :earlier].reshape(len(y), -1, ROWS).all(2).any(1)
                y, same = y[fresh], same[fresh]
            if not len(y):
                continue
            e = estimate(same.sum(1), np.full(len(y), n[x]), n[y])
            y, e = y[e >= LEAST_ESTIMATE], e[e >= LEAST_ESTIMATE]
            if not best_only:  # sorted 32-bit hashes bound the intersection from above, so no link is lost
                mine = np.frombuffer(short[x], np.uint32)
                most = np.array([len(mine) - np.count_nonzero(_absent(mine, np.frombuffer(short[z], np.uint32))) for z in y.tolist()], np.int64)
                y = y[100 * most >= THRESHOLD * (n[x] + n[y] - most)]
            if best_only:
                for q, z in zip(e.tolist(), y.tolist(), strict=True):
                    for one, other in ((x, z), (z, x)):
                        if q > best.get(one, (0.0, 0))[0]:
                            best[one] = (q, other)
            else:
                out_a += [int(node[x])] * len(y)
                out_b += node[y].tolist()
        for one, (_, other) in best.items():
            out_a.append(int(node[one]))
            out_b.append(int(node[other]))
        a, b = np.array(out_a, np.int64), np.array(out_b, np.int64)
        return pa.table({"a": np.minimum(a, b), "b": np.maximum(a, b)})

    return run


def components(scratch: Scratch, edges: DataFrame, name: str) -> DataFrame:
    """(node, comp) of every node that has an edge; comp is the least node of its component.

    Alternating large-star and small-star steps, each a few aggregations and joins on small rows.
    """
    e = edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct()
    e = scratch.write(e, f"{name}0")
    state, step = None, 0
    while True:
        now = e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == state or not now[0]:
            scratch.release()
            return e.select(F.col("u").alias("node"), F.col("v").alias("comp")).unionByName(e.select(F.col("v").alias("node"), F.col("v").alias("comp")).distinct())
        state, step = now, step + 1
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        root = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(root, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        e = scratch.write(small.unionByName(root.select("u", F.col("m").alias("v"))).distinct(), f"{name}{step}")
        scratch.drop(f"{name}{step - 1}")


def _keyed(documents: DataFrame) -> DataFrame:
    """Each row whole, beside its id as a number, its text and a hash of that, by which it is found again."""
    text = documents["text"].cast("string")
    return documents.select(F.struct(*[documents[c] for c in documents.columns]).alias("_row"), documents["doc_id"].cast("long").alias("_id"), text.alias("_text"), F.xxhash64(F.coalesce(text, F.lit(""))).alias("_hash"))


def _blocked(members: DataFrame, any_large: bool) -> DataFrame:
    """Members of buckets once for each pair of blocks (i, j) that they are compared in; a small bucket is one block.

    A large bucket's blocks are of one class of set sizes each; classes are a little over a factor of 4/3 wide, so links lie
    within one class or between neighbours.
    """
    zero = F.lit(0).cast("long")
    small = members.where(F.col("size") <= BLOCK).withColumns({"blk": zero, "i": zero, "j": zero})
    if not any_large:
        return small
    large = members.where(F.col("size") > BLOCK).withColumn("width", F.floor(F.log(F.col("n").cast("double")) / float(np.log(1.01 * 100 / THRESHOLD))))
    sizes = large.groupBy("key", "width").agg(F.ceil(F.count("*") / BLOCK).alias("blocks"))
    near = sizes.select("key", F.explode(F.array(F.col("width") - 1, F.col("width"), F.col("width") + 1)).alias("width"), F.col("width").alias("of"), F.col("blocks").alias("others"))
    near = near.join(sizes, ["key", "width"]).groupBy("key", "width", "blocks").agg(F.collect_list(F.struct("of", "others")).alias("near"))  # three at most
    placed = large.join(near, ["key", "width"])
    name = lambda width, at: width * F.lit(1 << 32) + at
    others = F.flatten(F.transform("near", lambda x: F.transform(F.sequence(zero, x["others"] - 1), lambda k: name(x["of"], k))))
    dealt = placed.withColumn("blk", name(F.col("width"), F.pmod(F.xxhash64("node"), "blocks"))).withColumn("other", F.explode(others))
    dealt = dealt.withColumns({"i": F.least("blk", "other"), "j": F.greatest("blk", "other")})
    return small.unionByName(dealt.select(small.columns))


def classes(spark: SparkSession, documents: DataFrame) -> DataFrame:
    """_id, _hash, n_shingles, class_id of each row: rows of one class are linked, directly or through others; null without a set."""
    scratch = Scratch(spark, "near-dedup")
    docs = _keyed(documents).drop("_row")
    columns = "doc_id long, text_hash long, n_shingles long, s1 long, s2 long, registers binary"
    sketches = scratch.write(docs.select("_id", "_hash", "_text").mapInArrow(releasing(_sketches), columns), "sketches")
    full = sketches.where("n_shingles > 0")
    found = full.groupBy("s1", "s2").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "text_hash")).alias("first"), F.first("n_shingles").alias("n"), F.first("registers").alias("registers"))
    nodes = scratch.write(found.select(F.monotonically_increasing_id().alias("node"), "s1", "s2", "n", "registers", "first.doc_id", "first.text_hash"), "nodes")

    keys = F.array(*[F.xxhash64(F.lit(b), F.substring("registers", 2 * ROWS * b + 1, 2 * ROWS)) for b in range(BANDS)])
    banded = nodes.select("node", F.posexplode(keys).alias("band", "key"))
    shared = banded.groupBy("key").agg(F.min("node").alias("rep"), F.count("*").alias("size")).where("size > 1")
    hits = scratch.write(banded.join(shared, "key"), "hits")

    any_large = hits.where(F.col("size") > BLOCK).limit(1).count() > 0
    wanted = nodes.join(hits.select("node").distinct(), "node", "left_semi").select("node", "s1", "s2", "doc_id", "text_hash")
    texts = docs.join(wanted, (docs["_hash"] == wanted["text_hash"]) & docs["_id"].eqNullSafe(wanted["doc_id"])).select("node", "s1", "s2", "_text")
    if full.groupBy("doc_id", "text_hash").count().where("count > 1").limit(1).count():  # repeated rows
        texts = texts.dropDuplicates(["node"])
    sets = scratch.write(texts.mapInArrow(releasing(_sets), "node long, set binary, short binary"), "sets")
    scratch.release()
    size = nodes.select("node", "n", "registers")

    def confirmed(pairs: DataFrame, name: str, estimated: bool) -> DataFrame:
        if not estimated:
            one = size.select(F.col("node").alias("a"), F.col("n").alias("na"), F.col("registers").alias("ra"))
            two = size.select(F.col("node").alias("b"), F.col("n").alias("nb"), F.col("registers").alias("rb"))
            pairs = pairs.join(one, "a").join(two, "b").select("a", "b", "na", "nb", "ra", "rb").mapInArrow(releasing(_likely), "a long, b long")
        one, two = sets.select(F.col("node").alias("a"), F.col("set").alias("x")), sets.select(F.col("node").alias("b"), F.col("set").alias("y"))
        tried = pairs.join(one, "a").join(two, "b").select("a", "b", "x", "y")
        links = scratch.write(tried.mapInArrow(releasing(_linked), "a long, b long"), name)
        scratch.release()
        return links

    stars = hits.where("node <> rep").select(F.col("rep").alias("a"), F.col("node").alias("b")).distinct()
    comps = components(scratch, confirmed(stars, "edges0", False), "comps0-")
    for turn, best_only in ((1, True), (2, False)):
        placed = hits.join(comps, "node", "left").withColumn("comp", F.coalesce("comp", "node"))
        mixed = placed.groupBy("key").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).where("lo <> hi").select("key")
        # in steps of their own: the driver holds each plan whole, and plans it anew after every shuffle
        members = scratch.write(placed.join(mixed, "key").join(size.select("node", "n"), "node"), f"members{turn}")
        dealt = _blocked(members, any_large).join(size.select("node", "registers"), "node")
        columns = ["key", "band", "node", "comp", "n", "rep", "registers", "blk", "i", "j"]
        if not best_only:
            dealt, columns = dealt.join(sets.select("node", "short"), "node"), [*columns, "short"]
        pairs = dealt.select(*columns).groupBy("key", "i", "j").applyInArrow(_across(best_only), "a long, b long").distinct()
        more = confirmed(scratch.write(pairs, f"pairs{turn}"), f"edges{turn}", True)
        scratch.drop(f"members{turn}")
        scratch.drop(f"pairs{turn}")
        if more.limit(1).count():  # the components so far stand for the links that made them
            comps = components(scratch, more.unionByName(comps.toDF("a", "b")), f"comps{turn}-")

    # the first document of a class is found among its nodes, so that rows, of which many can be copies, are joined once
    placed = nodes.select("s1", "s2", "node", F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id").alias("id"), F.col("text_hash").alias("hash")).alias("of")).join(comps, "node", "left")
    placed = placed.withColumn("class_id", F.coalesce("comp", "node"))
    first = placed.groupBy("class_id").agg(F.min("of").alias("first"))
    placed = placed.join(first, "class_id").select("s1", "s2", "class_id", "first")
    rows = sketches.drop("registers").withColumn("s1", F.when(F.col("n_shingles") > 0, F.col("s1")))
    return rows.join(placed, ["s1", "s2"], "left").select(F.col("doc_id").alias("_id"), F.col("text_hash").alias("_hash"), "n_shingles", "class_id", "first")


def near_duplicates(spark: SparkSession, documents: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id, kept, a row for each row of documents."""
    component = F.when(F.col("n_shingles") > 0, F.col("first.id")).otherwise(F.col("_id"))
    out = classes(spark, documents).select(F.col("_id").alias("doc_id"), "n_shingles", component.alias("component_id"))
    return out.withColumn("kept", F.when(F.col("component_id").isNull(), F.lit(True)).otherwise(F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(False))))


def filter_documents(spark: SparkSession, documents: DataFrame) -> DataFrame:
    """The documents without near duplicates, their columns untouched: of each class the row of the least id (then of the least hash of its
    text), and all rows without words. Rows that are linked with nothing stay, whatever ids they share."""
    scratch = Scratch(spark, "near-dedup-filter")
    rows = classes(spark, documents).where("class_id IS NULL OR (_id <=> first.id AND _hash = first.hash)")
    rows = rows.groupBy(F.col("_id").alias("k_id"), F.col("_hash").alias("k_hash"), F.col("class_id").isNull().alias("bare")).agg(F.count("*").alias("n"))
    rows = scratch.write(rows, "kept")
    scratch.release()
    kept, bare = rows.where("NOT bare"), rows.where("bare")
    docs = _keyed(documents)
    same = lambda keys: (docs["_hash"] == keys["k_hash"]) & docs["_id"].eqNullSafe(keys["k_id"])
    chosen = docs.join(kept, same(kept), "left_semi")
    if kept.where("n > 1").limit(1).count():  # else no row can stand for a repeated one
        repeated = kept.where("n > 1")
        several = docs.join(repeated, same(repeated), "left_semi").dropDuplicates(["_id", "_hash"])
        single = kept.where("n = 1")
        chosen = docs.join(single, same(single), "left_semi").unionByName(several)
    return chosen.unionByName(docs.join(bare, same(bare), "left_semi")).select("_row.*")
