"""Merkle manifest of a dataset with a proof for every row (operator 13).

Leaves are hashed and put in order by Spark, a tree for each group (a language), and every `ARITY` consecutive nodes
become their hash until one remains; the groups' subroots likewise become the root. Trees are cut into aligned blocks
of ARITY ** HEIGHT leaves. A first pass hashes each block to its root with a treehash stack; block roots are leaves of
the next round, so any number of rows takes a few rounds, and no task sees more than a block. A second pass walks each
block leaf by leaf as Merkle traversal does: a path of ARITY - 1 siblings a level is held, and while one run of
siblings is in use, a treehash stack for each level builds the next, a few leaves a step, so beside the block's digests
the walk holds a number of nodes that grows with the height. The shared path from the block's root up is appended.

A digest is lowercase hex sha256 of the concatenated inputs, digests as text. A proof lists for each level, from the
leaf up, the siblings left and right of the way, concatenated; `fold` recomputes the root from it.

Defined results: a null value is `-`, any other its UTF-8 byte count, `:` and the value, so empty and null differ; rows
with equal doc_id are leaves in the order of their digests, and equal rows stand one after another; a null doc_id comes
first in its group, the null group first of all groups; a lone leaf is its group's subroot and a lone subroot the
root; other columns are left out; an empty table gives an empty manifest.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .folds import fold as id_fold
from .line_dedup import lower_ascii
from .scratch import Scratch

ARITY = 8
HEIGHT = 3
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")


def hashed(parts: list[str]) -> str:
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf(*columns: Column) -> Column:
    """The digest of a row's values."""

    def told(c: Column) -> Column:
        text = c.cast("string")
        return F.when(c.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text))

    return F.sha2(F.concat(*map(told, columns)).cast("binary"), 256)


def depth(n: int, arity: int) -> int:
    """Levels above n leaves until one node remains."""
    levels = 0
    while n > 1:
        n, levels = -(-n // arity), levels + 1
    return levels


class Treehash:
    """The nodes of one level, built from leaves that are pushed in order: a stack of unfinished runs, one a level."""

    def __init__(self, level: int, arity: int):
        self.runs: list[list[str]] = [[] for _ in range(level)]
        self.arity, self.nodes = arity, []

    def push(self, digest: str) -> None:
        for run in self.runs:
            run.append(digest)
            if len(run) < self.arity:
                return
            digest = hashed(run)
            run.clear()
        self.nodes.append(digest)

    def finish(self) -> list[str]:
        """All nodes of the level; the last of them may stand over fewer leaves."""
        for k, run in enumerate(self.runs):
            if run:
                digest = hashed(run)
                run.clear()
                for above in self.runs[k + 1 :]:
                    above.append(digest)
                    if len(above) < self.arity:
                        break
                    digest = hashed(above)
                    above.clear()
                else:
                    self.nodes.append(digest)
        return self.nodes


def block_root(leaves: list[str], levels: int, arity: int) -> str:
    stack = Treehash(levels, arity)
    for x in leaves:
        stack.push(x)
    return stack.finish()[0]


class _Level:
    """Siblings at one level of the walk: the run in use, and the stack that builds the run after it."""

    def __init__(self, leaves: list[str], level: int, arity: int):
        self.leaves, self.level, self.arity = leaves, level, arity
        self.span = arity ** (level + 1)
        self.next_leaf, self.stack = 0, Treehash(level, arity)
        self.advance(self.span)
        self.turn()

    def advance(self, steps: int) -> None:
        """Let the stack take some more of the leaves that its run stands over."""
        end = min(self.next_leaf + steps, len(self.leaves))
        for i in range(self.next_leaf, end):
            self.stack.push(self.leaves[i])
        self.next_leaf = end

    def turn(self) -> None:
        self.run = self.stack.finish()
        self.stack = Treehash(self.level, self.arity)


def traverse(leaves: list[str], levels: int, arity: int) -> Iterator[list[tuple[str, str]]]:
    """The (left, right) siblings of each leaf in turn, level by level."""
    held = [_Level(leaves, k, arity) for k in range(levels)]
    for i in range(len(leaves)):
        path = []
        for k, level in enumerate(held):
            at = i // arity**k % arity
            path.append(("".join(level.run[:at]), "".join(level.run[at + 1 :])))
        yield path
        for level in held:
            level.advance(1)
            if (i + 1) % level.span == 0:
                level.turn()


def ordered(rows: DataFrame, group: str, *order: Column) -> DataFrame:
    """rows with pos, their place in their group, and n, its size. Places come from counts of each range of rows."""
    spark, scratch = rows.sparkSession, Scratch(rows.sparkSession, "leaves")
    ranged = rows.repartitionByRange(F.col(group), *order).sortWithinPartitions(F.col(group), *order)
    placed = scratch.write(ranged.withColumn("_at", F.monotonically_increasing_id()), "ranges").withColumn("_part", F.shiftright("_at", 33))
    counts = placed.groupBy("_part", group).agg(F.min("_at").alias("_first"), F.count(F.lit(1)).alias("_n"))
    of_group = Window.partitionBy(group)
    before = F.coalesce(F.sum("_n").over(of_group.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = counts.select("_part", group, "_first", before.alias("_before"), F.sum("_n").over(of_group).alias("n"))
    return placed.join(starts, ["_part", group]).withColumn("pos", F.col("_before") + F.col("_at") - F.col("_first")).drop("_part", "_at", "_first", "_before")


def _in_block(n: int, arity: int, height: int) -> int:
    """Levels of a block of a tree of n leaves."""
    return height if n > arity**height else depth(n, arity)


def _roots(nodes: DataFrame, arity: int, height: int) -> DataFrame:
    """(tree, n, pos, digest) of the block roots of nodes with those columns: the next round's nodes."""
    size = arity**height

    def run(batch: pa.Table) -> pa.Table:
        batch = batch.sort_by("pos")
        n = batch["n"][0].as_py()
        root = block_root(batch["digest"].to_pylist(), _in_block(n, arity, height), arity)
        return pa.table({"tree": [batch["tree"][0].as_py()], "n": [-(-n // size)], "pos": [batch["block"][0].as_py()], "digest": [root]})

    blocks = nodes.select("tree", "n", "pos", "digest", F.expr(f"pos div {size}").alias("block"))
    return blocks.groupBy("tree", "block").applyInArrow(run, "tree string, n long, pos long, digest string")


#: A proof: siblings left and right of the way, for each level.
PROOF = "array<struct<left:string,right:string>>"
_PROOF = pa.list_(pa.struct([("left", pa.string()), ("right", pa.string())]))


def _paths(nodes: DataFrame, above: DataFrame, carry: list[str], arity: int, height: int) -> DataFrame:
    """tree, digest, carry, proof, subroot, root of every node; above has (tree, block, upper, subroot, root), the way up from each block's root."""
    size = arity**height
    kept = nodes.select("tree", "n", "pos", "digest", *carry, F.expr(f"pos div {size}").alias("block"))
    types = {f.name: f.dataType.simpleString() for f in kept.schema.fields}
    schema = ", ".join(["tree string", "digest string", *[f"`{c}` {types[c]}" for c in carry], f"proof {PROOF}", "subroot string", "root string"])

    def run(batch: pa.Table, up: pa.Table) -> pa.Table:
        batch = batch.sort_by("pos")
        digests = batch["digest"].to_pylist()
        levels = _in_block(batch["n"][0].as_py(), arity, height) if digests else 0
        shared = up["upper"][0].as_py()
        proofs = [[{"left": a, "right": b} for a, b in path] + shared for path in traverse(digests, levels, arity)]
        ends = {c: pa.array([up[c][0].as_py()] * len(digests), pa.string()) for c in ("subroot", "root")}
        return pa.table({c: batch[c] for c in ["tree", "digest", *carry]} | {"proof": pa.array(proofs, _PROOF)} | ends)

    return kept.groupBy("tree", "block").cogroup(above.groupBy("tree", "block")).applyInArrow(run, schema)


def climb(leaves: DataFrame, arity: int = ARITY, height: int = HEIGHT) -> tuple[list[DataFrame], DataFrame]:
    """(rounds, roots) of leaves (tree, n, pos, digest), one tree for each value of tree: the nodes of each round, and (tree, digest) of the roots."""
    scratch, size = Scratch(leaves.sparkSession, "climb"), arity**height
    rounds, most = [leaves], leaves.agg(F.max("n")).first()[0] or 0
    # A tree that ends in an early round is a lone leaf of later ones, with nothing left to hash.
    while most > size:
        rounds.append(scratch.write(_roots(rounds[-1], arity, height), f"round{len(rounds)}"))
        most = -(-most // size)
    return rounds, scratch.write(_roots(rounds[-1], arity, height).select("tree", "digest"), "roots")


def descend(rounds: list[DataFrame], ends: DataFrame, carry: list[str], arity: int = ARITY, height: int = HEIGHT) -> DataFrame:
    """tree, digest, carry, proof, subroot, root of every leaf; ends has (tree, upper, subroot, root) for each tree."""
    scratch = Scratch(ends.sparkSession, "descend")
    above = ends.select("tree", F.lit(0).cast("long").alias("block"), "upper", "subroot", "root")
    for k in range(len(rounds) - 1, 0, -1):
        up = _paths(rounds[k].withColumn("place", F.col("pos")), above, ["place"], arity, height)
        above = scratch.write(up.select("tree", F.col("place").alias("block"), F.col("proof").alias("upper"), "subroot", "root"), f"up{k}")
    return _paths(rounds[0], above, carry, arity, height)


def fold(digest: Column, proof: Column) -> Column:
    """The root that a leaf and a proof lead to."""
    return F.aggregate(proof, digest, lambda acc, level: F.sha2(F.concat(level["left"], acc, level["right"]).cast("binary"), 256))


def proof_digest(proof: Column) -> Column:
    return F.sha2(F.array_join(F.transform(proof, lambda level: F.concat(level["left"], level["right"])), "").cast("binary"), 256)


def manifest(documents: DataFrame, carry: dict[str, Column] | None = None, arity: int = ARITY, height: int = HEIGHT) -> DataFrame:
    """doc_id, lang, leaf, proof (to the root), subroot, root and the carried expressions over the table's columns."""
    carry = carry or {}
    columns = [F.col(c).cast("long" if c in ("doc_id", "n_chars") else "string").alias(c) for c in FIELDS]
    rows = documents.select(*columns).select(
        "doc_id",
        # The null group sorts first, other groups by their bytes.
        F.coalesce(F.concat(F.lit("="), F.col("lang")), F.lit("")).alias("tree"),
        leaf(*map(F.col, FIELDS)).alias("digest"),
        *[c.alias(f"carry_{k}") for k, c in carry.items()],
    )
    scratch = Scratch(documents.sparkSession, "manifest")
    leaves = scratch.write(ordered(rows, "tree", F.col("doc_id").asc_nulls_first(), F.col("digest").asc()), "leaves")
    rounds, subroots = climb(leaves, arity, height)
    tops = scratch.write(ordered(subroots.select(F.lit("all").alias("tree"), F.col("tree").alias("of"), "digest"), "tree", F.col("of").asc()), "tops")
    top_rounds, top = climb(tops, arity, height)
    bare = top.select("tree", F.expr(f"CAST(array() AS {PROOF})").alias("upper"), F.col("digest").alias("subroot"), F.col("digest").alias("root"))
    shared = descend(top_rounds, bare, ["of"], arity, height).select(F.col("of").alias("tree"), F.col("proof").alias("upper"), F.col("digest").alias("subroot"), "root")
    return descend(rounds, scratch.write(shared, "shared"), ["doc_id", *[f"carry_{k}" for k in carry]], arity, height).select(
        "doc_id",
        F.when(F.col("tree") != "", F.expr("substring(tree, 2)")).alias("lang"),
        F.col("digest").alias("leaf"),
        "proof",
        "subroot",
        "root",
        *[F.col(f"carry_{k}").alias(k) for k in carry],
    )


def tampered_leaf() -> Column:
    """The leaf of a row whose text lost its capitals A-Z, where 3 divides crc32 of the id; else null."""
    text = F.col("text").cast("string")
    return F.when(id_fold("doc_id", 3) == 0, leaf(F.col("doc_id").cast("long"), F.col("source").cast("string"), F.col("lang").cast("string"), F.col("n_chars").cast("long"), lower_ascii(text)))


def digest(proved: DataFrame) -> DataFrame:
    """The columns of an audit: what each row's proof makes of its leaf, or of the carried tampered one."""
    return proved.select(
        "doc_id", "leaf", "subroot", "root", proof_digest(F.col("proof")).alias("proof_sha256"), fold(F.coalesce("tampered", "leaf"), F.col("proof")).alias("folded_root")
    ).withColumn("verified", F.col("folded_root") == F.col("root"))
