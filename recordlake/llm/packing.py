"""Sum-of-squares online packing of token ids into windows.

Every input partition packs its documents in order. Windows that are neither
empty nor full are counted by fill level, and a piece goes to the level (an empty
window included) that makes the sum of the squared counts smallest. No rows move
between partitions, so a shard is one partition and needs no shuffle.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterable, Iterator

import numpy as np
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .common import id_and_text, in_batches
from .tokens import definition, encoder


class Levels:
    """The count of open windows per fill level and the open windows themselves.

    A piece is (doc_id, doc_tokens, start, ids). Full windows come back from
    :meth:`place` as lists of pieces. More than ``most_open`` open windows are
    closed early by cutting pieces, which bounds the memory of a shard.
    """

    def __init__(self, window: int, most_open: int = 4096):
        self.window, self.most_open, self.n_open = window, most_open, 0
        self.count = np.zeros(window + 1, dtype=np.int64)
        self.open: list[list[list[tuple]]] = [[] for _ in range(window)]

    def best(self, size: int) -> int:
        """The fill level to put a piece of ``size`` on; 0 is a new window. Ties: the fullest."""
        before = self.count[1 : self.window - size + 1]
        after = self.count[1 + size : self.window + 1]
        # the square sum changes by 2 * (after - before) + 2; full windows do not count
        change = np.where(before > 0, 2 * (after - before) + 2, np.iinfo(np.int64).max)
        if len(change):
            change[-1] -= bool(before[-1])
        new = 2 * self.count[size] + 1
        if len(change):
            at = len(change) - 1 - int(np.argmin(change[::-1]))
            if before[at] > 0 and change[at] <= new:
                return at + 1
        return 0

    def place(self, piece: tuple) -> Iterator[list[tuple]]:
        size = len(piece[3]) // 4
        if size == self.window:
            yield [piece]
            return
        level = self.best(size)
        if level:
            held = self.open[level].pop()
            self.count[level] -= 1
            self.n_open -= 1
        else:
            held = []
        held.append(piece)
        if level + size == self.window:
            yield held
            return
        self.open[level + size].append(held)
        self.count[level + size] += 1
        self.n_open += 1
        if self.n_open > self.most_open:
            yield from self.drain()

    def drain(self) -> Iterator[list[tuple]]:
        """Fill the fullest windows with cut pieces of the emptiest; at most one stays open."""
        windows = [w for level in reversed(self.open) for w in level]
        self.open = [[] for _ in range(self.window)]
        self.count[:] = 0
        first, last, fill = 0, len(windows) - 1, None
        while first < last:
            fill = sum(len(p[3]) for p in windows[first]) // 4 if fill is None else fill
            doc, n, start, ids = windows[last].pop()
            take = min(self.window - fill, len(ids) // 4)
            windows[first].append((doc, n, start, ids[: 4 * take]))
            if 4 * take < len(ids):
                windows[last].append((doc, n, start + take, ids[4 * take :]))
            fill += take
            if not windows[last]:
                last -= 1
            if fill == self.window:
                yield windows[first]
                first, fill = first + 1, None
        self.n_open = 0
        if first == last and windows[first]:
            fill = sum(len(p[3]) for p in windows[first]) // 4
            if fill == self.window:
                yield windows[first]
            else:
                self.open[fill] = [windows[first]]
                self.count[fill] = self.n_open = 1

    def finish(self) -> Iterator[list[tuple]]:
        """Close all windows; the last, if not full, is cut at powers of two, which need no padding."""
        yield from self.drain()
        for pieces in [w for level in self.open for w in level]:
            left = sum(len(p[3]) for p in pieces) // 4
            queue = pieces[::-1]
            while left:
                room = 1 << (left.bit_length() - 1)
                left -= room
                out = []
                while room:
                    doc, n, start, ids = queue.pop()
                    take = min(room, len(ids) // 4)
                    out.append((doc, n, start, ids[: 4 * take]))
                    if 4 * take < len(ids):
                        queue.append((doc, n, start + take, ids[4 * take :]))
                    room -= take
                yield out


def pack_ids(documents: Iterable[tuple], window: int, most_open: int = 4096) -> Iterator[list[tuple]]:
    """Windows as lists of pieces (doc_id, doc_tokens, start, ids) from (doc_id, ids as bytes)."""
    levels = Levels(window, most_open)
    for doc, ids in documents:
        n = len(ids) // 4
        for start in range(0, n, window):
            yield from levels.place((doc, n, start, ids[4 * start : 4 * (start + window)]))
    yield from levels.finish()


def pack(
    docs: DataFrame, tokenizer: str, end_id: int, window: int = 2048, most_open: int = 4096,
    id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False, keep_pieces: int = 1_000_000,
) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, and the ids on demand.

    ``docs`` should be a stored table, so that a task that runs again sees the same
    rows. Null and empty texts are documents of the end id alone. Repeated rows
    and ids are packed as often as they occur; other columns are not read. Long
    documents fill whole windows and one rest. No document: no row. A worker keeps the
    ids of at most ``keep_pieces`` words; fewer take less memory and more time.
    """
    spark, id_type = docs.sparkSession, docs.schema[id_col].dataType
    schema = T.StructType(
        [T.StructField("doc_id", id_type)]
        + [T.StructField(n, T.LongType()) for n in ("start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")]
        + ([T.StructField("ids", T.BinaryType())] if with_ids else [])
    )
    stated = spark.sparkContext.broadcast(definition(tokenizer))
    end = np.array([end_id], dtype="<u4").tobytes()

    def rows(batches):
        encode = encoder(stated.value, keep_pieces).ids
        shard = TaskContext.get().partitionId() << 32
        documents = (
            (doc, encode(text) + end)
            for b in batches
            for doc, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True)
        )
        for at, pieces in enumerate(pack_ids(documents, window, most_open)):
            offset = 0
            for doc, n, start, ids in pieces:
                length = len(ids) // 4
                yield (doc, start, length, zlib.crc32(ids), n, shard + at, offset, *([ids] if with_ids else []))
                offset += length

    return id_and_text(docs, id_col, text_col).mapInArrow(lambda it: in_batches(schema, rows(it)), schema)
