"""Sequence packing (operator 4): bounded-space online best fit.

Each task streams its documents' ids into a fixed number of open windows. A piece goes into the window that it fits
with least space left; if it fits none and no window may be opened, the fullest one is closed: its gap is filled by
cutting the piece where at least ``min_cut`` ids go in, else padded. Windows still open at a task's end are merged by
the same rule, ``FAN_IN`` tasks at a time, level by level; the last level fills windows one after another, so that
at most its last one is short.

Defined results: null text is empty and has the end id alone; rows with equal or null doc_id are packed row by row; a
document longer than a window fills windows of its own; other columns are ignored; an empty table gives no piece.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import tokenise
from .scratch import Scratch
from .worker import releasing

FAN_IN = 64
#: closed: the window is done; tokens: little-endian 32-bit ids of the piece; padded_length: of its sequence.
PIECES = "doc_id long, start long, length long, doc_tokens long, sequence_id long, offset long, padded_length long, closed boolean, part long, tokens binary"
_NAMES = [c.split()[0] for c in PIECES.split(", ")]


class Packer:
    def __init__(self, capacity: int = 4096, open_windows: int = 16, min_cut: int = 64):
        self.capacity, self.most, self.min_cut = capacity, open_windows, min_cut
        self.open: list[list] = []  # [ids used, pieces]
        self.done: list[list] = []

    def add(self, doc_id, start: int, ids: bytes, doc_tokens: int) -> None:
        n = len(ids) // 4
        while n >= self.capacity:
            self.done.append([self.capacity, [(doc_id, start, ids[: 4 * self.capacity], doc_tokens)]])
            ids, start, n = ids[4 * self.capacity :], start + self.capacity, n - self.capacity
        while n:
            best = max((w for w in self.open if w[0] + n <= self.capacity), key=lambda w: w[0], default=None)
            if best is None and len(self.open) < self.most:
                best = [0, []]
                self.open.append(best)
            if best is not None:
                self._put(best, doc_id, start, ids, doc_tokens)
                return
            full = max(self.open, key=lambda w: w[0])
            gap = self.capacity - full[0]
            if self.min_cut <= gap < n:
                self._put(full, doc_id, start, ids[: 4 * gap], doc_tokens)
                ids, start, n = ids[4 * gap :], start + gap, n - gap
            else:
                self._close(full)

    def _put(self, window: list, doc_id, start, ids, doc_tokens) -> None:
        window[1].append((doc_id, start, ids, doc_tokens))
        window[0] += len(ids) // 4
        if window[0] == self.capacity:
            self._close(window)

    def _close(self, window: list) -> None:
        self.open = [w for w in self.open if w is not window]
        self.done.append(window)

    def finish(self) -> None:
        """Fill windows one after another with what is open."""
        pieces = [p for w in sorted(self.open, key=lambda w: -w[0]) for p in w[1]]
        self.open, now = [], [0, []]
        for doc_id, start, ids, doc_tokens in pieces:
            while ids:
                take = min(len(ids) // 4, self.capacity - now[0])
                now[1].append((doc_id, start, ids[: 4 * take], doc_tokens))
                now[0], ids, start = now[0] + take, ids[4 * take :], start + take
                if now[0] == self.capacity:
                    self.done.append(now)
                    now = [0, []]
        if now[1]:
            self.done.append(now)


class _Rows:
    """Numbers the windows of a task and makes record batches of their pieces."""

    def __init__(self, level: int, capacity: int):
        self.part, self.capacity = TaskContext.get().partitionId(), capacity
        self.next_id = (level << 56) | (self.part << 24)

    def batch(self, windows: list[list], closed: bool) -> pa.RecordBatch:
        rows = []
        for used, pieces in windows:
            offset = 0
            padded = used if used & (used - 1) == 0 else self.capacity
            for doc_id, start, ids, doc_tokens in pieces:
                rows.append((doc_id, start, len(ids) // 4, doc_tokens, self.next_id, offset, padded, closed, self.part, ids))
                offset += len(ids) // 4
            self.next_id += 1
        columns = list(zip(*rows, strict=True)) or [()] * len(_NAMES)
        kinds = [pa.int64()] * 7 + [pa.bool_(), pa.int64(), pa.binary()]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=_NAMES)


def pack(spark: SparkSession, documents: DataFrame, vocabulary: str, end_id: int = 2, capacity: int = 4096, open_windows: int = 16) -> DataFrame:
    """A row for each piece (PIECES); all windows are closed."""
    end = np.array([end_id], "<u4").tobytes()
    scratch = Scratch(spark, "packing")

    def first(batches):
        packer, rows = Packer(capacity, open_windows), _Rows(0, capacity)
        encode = tokenise.encoder(vocabulary)
        for batch in batches:
            for i, j, texts in tokenise.slices(batch.column(1)):
                for doc_id, ids in zip(batch.column(0).slice(i, j - i).to_pylist(), encode(texts), strict=True):
                    ids += end
                    packer.add(doc_id, 0, ids, len(ids) // 4)
                if packer.done:
                    yield rows.batch(packer.done, True)
                    packer.done = []
        yield rows.batch(packer.open, False)

    def merge(level: int, last: bool):
        def run(batches):
            packer, rows = Packer(capacity, open_windows), _Rows(level, capacity)
            for batch in batches:
                for doc_id, start, ids, doc_tokens in zip(*(batch.column(k).to_pylist() for k in range(4)), strict=True):
                    packer.add(doc_id, start, ids, doc_tokens)
            if last:
                packer.finish()
            yield rows.batch(packer.done, True)
            yield rows.batch(packer.open, False)

        return run

    rows = documents.select(documents["doc_id"].cast("long").alias("doc_id"), F.coalesce(documents["text"].cast("string"), F.lit("")).alias("text"))
    table = scratch.write(rows.mapInArrow(releasing(first), PIECES), "level0")
    out, level = table.where("closed"), 0
    while True:
        left, level = table.where("not closed"), level + 1
        parts = left.agg(F.max("part")).first()[0]
        if parts is None:
            return out
        last = parts < FAN_IN
        group = F.floor(F.col("part") / FAN_IN)
        dealt = left.repartition(max(1, parts // FAN_IN + 1), group).sortWithinPartitions(group, "sequence_id", "offset")
        table = scratch.write(dealt.select("doc_id", "start", "tokens", "doc_tokens").mapInArrow(releasing(merge(level, last)), PIECES), f"level{level}")
        out = out.unionByName(table.where("closed"))


def digest(pieces: DataFrame, keep_tokens: bool = False) -> DataFrame:
    """The pieces with the crc32 of their ids, and the ids themselves only if asked for."""
    kept = ["doc_id", "start", "length", "doc_tokens", "sequence_id", "offset", "padded_length"]
    return pieces.select(*kept, F.crc32("tokens").alias("ids_crc32"), *["tokens"] * keep_tokens)
