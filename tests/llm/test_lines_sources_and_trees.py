"""Line dedup, source audit and Merkle manifest against brute force."""

import collections
import hashlib
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F

from notemill.llm import divergence, line_dedup, merkle

SCHEMA = "doc_id long, source string, lang string, n_chars long, text string, pos long, keeper long, h1 string, digest string, tree string, block long"
LOWER = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))


def table(spark, rows):
    """(doc_id, source, lang, text) with columns of names that the operators use themselves."""
    return spark.createDataFrame([(i, s, g, None if x is None else len(x), x, 1, 2, "x", "y", "z", 3) for i, s, g, x in rows], SCHEMA)


# Lines ----------------------------------------------------------------------------------------------------------------


def brute_lines(rows, least=3):
    key = lambda line: line.strip(" \t\n\x0b\x0c\r").encode().translate(LOWER).decode()
    ids = collections.defaultdict(set)
    for i, x in rows:
        for line in (x or "").split("\n"):
            if len(key(line)) >= 20:
                ids[key(line)].add(i)
    out = []
    for i, x in rows:
        lines = (x or "").split("\n")
        largest = lambda k: max((j for j in ids[k] if j is not None), default=None)
        kept = [line for line in lines if not (len(ids.get(key(line), ())) >= least and largest(key(line)) is not None and largest(key(line)) != i)]
        out.append((i, len(lines), len(lines) - len(kept), "\n".join(kept)))
    return sorted(out, key=str)


def line_rows():
    rng = random.Random(11)
    lines = [f"Line {k} of a passage that repeats" for k in range(12)] + ["short", "", "  padded line that is long enough \t", "æøå" * 7, "ÆØÅ" * 7, "x" * 19, "y" * 20, " " * 40]
    rows = [(k, "\n".join(rng.choice([x, x.upper(), f" {x}\t"]) for x in rng.choices(lines, k=rng.randrange(9)))) for k in range(60)]
    rows += [(100, None), (101, ""), (102, "\n\n"), (103, "y" * 20 + "\r\n" + "Y" * 20), (7, rows[7][1]), (8, "other text of a repeated id\n" + lines[0]), (None, lines[0] + "\nonly null ids hold this line"), (None, "only null ids hold this line")]
    return rows + [(104, "\n".join(f"line {k} of a passage that repeats" for k in range(12)) * 1) , (105, "\n".join(f"a very long text has line {k % 3000}" for k in range(9000)))]


@pytest.mark.parametrize(("batches", "fanout", "hot"), [(1, 2, 4096), (5, 2, 2), (4, 3, 0)])
def test_line_dedup(spark, batches, fanout, hot):
    rows = line_rows()
    df = table(spark, [(i, "s", "g", x) for i, x in rows]).repartition(3)
    got = line_dedup.dedup_lines(spark, df, batches=batches, fanout=fanout, hot=hot)
    assert got.columns == ["doc_id", "text", "n_lines", "n_dropped"]
    assert sorted(((r.doc_id, r.n_lines, r.n_dropped, r.text) for r in got.collect()), key=str) == brute_lines(rows)


def test_no_lines(spark):
    assert line_dedup.digest(line_dedup.dedup_lines(spark, table(spark, []))).count() == 0
    got = line_dedup.digest(line_dedup.dedup_lines(spark, table(spark, [(1, None, None, None)]))).first()
    assert (got.n_lines, got.n_dropped, got.kept_sha256) == (1, 0, hashlib.sha256(b"").hexdigest())


def test_runs_are_levelled_and_found_again(spark, tmp_path):
    keys = lambda *ks, doc: spark.createDataFrame([(k, -k, 1, doc) for k in ks], "h1 long, h2 long, n long, keeper long")
    runs = line_dedup.LineRuns(spark, str(tmp_path), fanout=2)
    runs.add(keys(1, 2, doc=9))
    runs.add(keys(2, 3, doc=8))
    assert [len(x) for x in runs.levels] == [0, 1]
    runs.add(keys(1, 2, 4, doc=7))
    assert [len(x) for x in runs.levels] == [1, 1]
    again = line_dedup.LineRuns(spark, str(tmp_path), fanout=2)
    assert again.levels == runs.levels and again.version == runs.version
    assert {r.h1: r.fresh for r in again.rows().where("n = 1 AND h1 IN (1, 2, 4)").collect() if not r.fresh} == {1: False, 2: False}, "keys that older runs hold are no fresh ones"
    assert {(r.h1, r.n, r.keeper) for r in again.frequent(1).collect()} == {(1, 2, 9), (2, 3, 9), (3, 1, 8), (4, 1, 7)}
    again.add(keys(5, doc=6))
    assert [len(x) for x in again.levels] == [0, 0, 1]


# Sources --------------------------------------------------------------------------------------------------------------


def test_hashes_are_xxhash():
    rng = np.random.default_rng(1)
    buf = rng.integers(0, 256, 4000).astype(np.uint8)
    start = rng.integers(0, 3900, 500)
    end = start + rng.integers(0, 80, 500)
    want = [xxhash.xxh64_intdigest(buf[a:b].tobytes()) for a, b in zip(start, end, strict=True)]
    assert divergence.hashes(buf, start, end).tolist() == want
    assert divergence.hashes(buf[:3], np.array([0, 3]), np.array([3, 3])).tolist() == [xxhash.xxh64_intdigest(buf[:3].tobytes()), xxhash.xxh64_intdigest(b"")]


@pytest.mark.parametrize("hashed", [divergence.hashes, lambda buf, a, b: np.zeros(len(a), np.uint64), lambda buf, a, b: (b - a).astype(np.uint64)])
def test_terms_of_a_chunk(hashed):
    """Also if all slices, or all of a length, had one hash."""
    texts = ["The cat, the CAT! cat-like", "", "naïve Æther1æther", "x" * 70 + " " + "x" * 70 + "y", "ends", "the"]
    group = np.array([0, 0, 1, 1, 2, 2])
    raw = [x.encode() for x in texts]
    offsets = np.cumsum([0, *map(len, raw)])
    term, of, n, docs = divergence.count_terms(np.frombuffer(b"".join(raw), np.uint8), offsets, group, hashed)
    want, held = collections.Counter(), collections.Counter()
    for g, x in zip(group.tolist(), raw, strict=True):
        found = [w.translate(LOWER).decode() for w in re.findall(rb"[A-Za-z\x80-\xff]+", x)]
        want.update((g, w) for w in found)
        held.update((g, w) for w in set(found))
    got = list(zip(of.tolist(), term.to_pylist(), strict=True))
    assert dict(zip(got, n.tolist(), strict=True)) == dict(want) and dict(zip(got, docs.tolist(), strict=True)) == dict(held)


def brute_audit(rows, least=3, top=200):
    counts, held = collections.defaultdict(collections.Counter), collections.defaultdict(collections.Counter)
    sources = collections.defaultdict(set)
    for _, s, g, x in rows:
        s, g, x = s or "", g or "", x or ""
        sources[g].add(s)
        found = [w.encode().translate(LOWER).decode() for w in re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", x)]
        counts[g, s].update(found)
        held[g].update(set(found))
    out = []
    for g, names in sources.items():
        kept = sorted(w for w, d in held[g].items() if d >= least)
        share = lambda c: {w: 1 + 10**9 * (c[w] + 1) // (sum(c[w] for w in kept) + len(kept)) for w in kept}  # noqa: E731, B023
        p, whole = {s: share(counts[g, s]) for s in names}, share(sum((counts[g, s] for s in names), collections.Counter()))
        f = lambda a, b: (a - b) * (a - b) // b
        for s in names:
            pairs = [(t, sum(f(p[s][w], p[t][w]) for w in kept)) for t in names if t != s]
            terms = [(w, f(p[s][w], whole[w])) for w in kept if counts[g, s][w] > 0 and p[s][w] > whole[w]]
            for part, items in (("pair", pairs), ("term", terms)):
                ranked = sorted(items, key=lambda x: (-x[1], x[0].encode()))
                out += [(g, s, part, item, value, k) for k, (item, value) in enumerate(ranked[: top if part == "term" else None], 1)]
    return sorted(out)


@pytest.mark.parametrize(("block_terms", "top"), [(16_384, 200), (7, 3)])
def test_source_audit(spark, block_terms, top):
    rng = random.Random(12)
    words = [f"w{chr(97 + k % 26)}{chr(97 + k // 26)}" for k in range(60)] + ["Æ", "ÆØ", "ñandú", "The", "the", "x" * 90]
    rows = [(k, rng.choice(["s1", "s1", "s2", "s3", None]), rng.choice(["en", "en", "fr", None]), " ".join(rng.choices(words, k=rng.randrange(40))) + "3-4") for k in range(80)]
    rows += [(90, "only numbers", "en", "1 2 3"), (91, "s1", "xx", "few few few"), (92, "s2", "xx", None), (93, "s9", "en", ""), (5, "s1", "en", rows[5][3]), (None, "s1", "en", "the same row"), (None, "s1", "en", "the same row"), (94, "lone", "yy", "a b c")]
    rows.append((95, "s3", "fr", " ".join(rng.choices(words, k=30_000))))
    got = divergence.audit(table(spark, rows).repartition(4), top=top, block_terms=block_terms)
    assert got.columns == ["lang", "source", "part", "item", "value", "rank"]
    assert sorted(map(tuple, got.collect())) == brute_audit(rows, top=top)


def test_audit_of_nothing_and_of_large_counts(spark):
    assert divergence.audit(table(spark, [])).count() == 0
    big = np.array([10**13, 5, 0])
    assert divergence.share(big, 3 * 10**13).tolist() == [1 + 10**9 * (int(x) + 1) // (3 * 10**13) for x in big]
    assert divergence.share(np.zeros(2, np.int64), 0).tolist() == [0, 0]


# Trees ----------------------------------------------------------------------------------------------------------------


def h(parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def brute_tree(leaves, arity=8):
    """(root, proofs): for each leaf its (left, right) siblings, level by level."""
    nodes, where, proofs = list(leaves), list(range(len(leaves))), [[] for _ in leaves]
    while len(nodes) > 1:
        for i, at in enumerate(where):
            run = nodes[at // arity * arity : at // arity * arity + arity]
            proofs[i].append(("".join(run[: at % arity]), "".join(run[at % arity + 1 :])))
            where[i] = at // arity
        nodes = [h(nodes[k : k + arity]) for k in range(0, len(nodes), arity)]
    return nodes[0], proofs


@pytest.mark.parametrize("arity", [2, 3, 8])
def test_traversal_of_a_block(arity):
    for n in [*range(1, 20), arity**2, arity**2 + 1, 2 * arity**2 + arity, arity**3]:
        leaves = [h([str(n), str(k)]) for k in range(n)]
        levels = merkle.depth(n, arity)
        root, proofs = brute_tree(leaves, arity)
        assert merkle.block_root(leaves, levels, arity) == root and list(merkle.traverse(leaves, levels, arity)) == proofs
    # a last block of a tall tree keeps its levels
    assert merkle.block_root([h(["x"])], 2, arity) == h([h([h(["x"])])])


def test_the_walk_holds_few_nodes(monkeypatch):
    """Beside the leaves, a run of siblings and a stack for each level."""
    leaves, most = [h([str(k)]) for k in range(512)], 0
    levels = [merkle._Level(leaves, k, 8) for k in range(3)]
    for i in range(len(leaves)):
        for level in levels:
            level.advance(1)
            if (i + 1) % level.span == 0:
                level.turn()
        most = max(most, sum(len(x.run) + len(x.stack.nodes) + sum(map(len, x.stack.runs)) for x in levels))
    assert most <= 3 * (8 + 8 + 3 * 8)


def brute_manifest(rows, arity=8):
    told = lambda v: "-" if v is None else f"{len(str(v).encode())}:{v}"
    leaf = lambda i, s, g, x: h([told(v) for v in (i, s, g, None if x is None else len(x), x)])
    cut = lambda i, s, g, x: h([told(v) for v in (i, s, g, None if x is None else len(x), None if x is None else x.encode().translate(LOWER).decode())])
    groups = collections.defaultdict(list)
    for row in rows:
        groups[row[2]].append((leaf(*row), row))
    names = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    trees = {}
    for g in names:
        groups[g].sort(key=lambda x: (x[1][0] is not None, x[1][0] or 0, x[0]))
        trees[g] = brute_tree([x for x, _ in groups[g]], arity)
    root, tops = brute_tree([trees[g][0] for g in names], arity)
    out = []
    for g, top in zip(names, tops, strict=True):
        for (x, row), proof in zip(groups[g], trees[g][1], strict=True):
            path = [*proof, *top]
            tampered = zlib.crc32(("" if row[0] is None else str(row[0])).encode()) % 3 == 0
            folded = cut(*row) if tampered else x
            for left, right in path:
                folded = h([left, folded, right])
            out.append((row[0], x, trees[g][0], root, h([a + b for a, b in path]), folded, folded == root))
    return sorted(out, key=str)


@pytest.mark.parametrize(("arity", "height"), [(8, 3), (2, 2)])
def test_manifest(spark, arity, height):
    rng = random.Random(13)
    rows = [(k * 3, rng.choice(["s", None, ""]), rng.choice(["en", "en", "en", "de", "ÆØ", "z"]), rng.choice(["Some Text", "lower", "", None, "Ærlig ÆØÅ", "x" * 5000])) for k in range(150)]
    rows += [(600, "s", None, "no language"), (601, "s", "lone", "One"), (6, "s", "en", "a repeated id"), rows[4], rows[4], (None, "s", "en", "NULL"), (None, None, "en", None), (-5, "s", "", "Empty language")]
    df = table(spark, rows).repartition(5)
    got = merkle.digest(merkle.manifest(df, {"tampered": merkle.tampered_leaf()}, arity, height))
    assert got.columns == ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]
    assert sorted((tuple(r) for r in got.collect()), key=str) == brute_manifest(rows, arity)


def test_manifest_of_little(spark):
    assert merkle.digest(merkle.manifest(table(spark, []), {"tampered": merkle.tampered_leaf()})).count() == 0
    one = merkle.manifest(table(spark, [(1, "s", "en", "text")])).first()
    assert one.leaf == one.subroot == one.root and one.proof == [] and one.lang == "en"
    proved = merkle.manifest(table(spark, [(k, "s", "en", "text") for k in range(9)]))
    wrong = proved.withColumn("leaf", F.sha2(F.lit("other"), 256))
    fold = lambda df: {r[0] for r in df.select(merkle.fold(F.col("leaf"), F.col("proof")) == F.col("root")).collect()}
    assert fold(proved) == {True} and fold(wrong) == {False}


def test_terms_are_whole_strings():
    assert divergence._slices(np.frombuffer("aæb".encode(), np.uint8), np.array([0, 1]), np.array([1, 4])).equals(pa.array(["a", "æb"]))
