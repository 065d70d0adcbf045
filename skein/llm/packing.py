"""Packing by the sum-of-squares rule for online bin packing.

Every partition packs its documents as they come, without a shuffle. Whole windows of a long document are closed at once;
its rest goes into the fill level for which the sum of squared counts of partially filled windows becomes smallest,
counts being kept in an array over the levels. When the partition ends, the windows still open are poured together, the
emptiest into the fullest, cutting where they meet; the last one is cut into powers of two, which need no padding.

A partition holds at most its open windows (their number grows with the square root of its documents at most, each of
one sequence's size). Defined results: null text counts as empty (one piece, the end id), repeated rows are packed each,
a null doc_id stays null, other columns are not looked at, an empty table gives no piece.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skein.llm.common import id_text, real_id, small_batches, table
from skein.llm.tokens import encoder, shared_tokenizer

LENGTH = 2048
PIECE = "doc_id long, start long, length long, doc_tokens long, sequence_id long, offset long, ids binary"


class Packer:
    """pieces: (doc, start, ids, doc_tokens). Closed windows come out as lists of pieces in order."""

    def __init__(self, length: int = LENGTH):
        self.length = length
        self.levels = np.zeros(length + 1, np.int64)  # how many open windows have each fill
        self.open: list[list[list]] = [[] for _ in range(length)]  # by fill: the windows

    def level_for(self, size: int) -> int:
        """The fill (0: a new window) whose window takes the rest at the least sum of squares; the fullest of equals."""
        top = self.length - size
        n = self.levels
        cost = 2 * (n[size : self.length + 1] - n[: top + 1]) + 2
        cost[top] -= 2 * n[self.length] + 1  # a full window is no longer counted
        cost[1:][n[1 : top + 1] == 0] = np.iinfo(np.int64).max
        cost[0] = 2 * n[size] + 1 if size < self.length else 0
        return top - int(np.argmin(cost[::-1]))

    def add(self, doc, ids: np.ndarray) -> Iterator[list]:
        total, whole = len(ids), len(ids) // self.length * self.length
        for at in range(0, whole, self.length):
            yield [(doc, at, ids[at : at + self.length], total)]
        size = total - whole
        if not size:
            return
        piece = (doc, whole, ids[whole:], total)
        level = self.level_for(size)
        window = self.open[level].pop() if level else []
        self.levels[level] -= bool(level)
        window.append(piece)
        fill = level + size
        if fill == self.length:
            yield window
        else:
            self.open[fill].append(window)
            self.levels[fill] += 1

    def finish(self) -> Iterator[list]:
        """Pours the open windows together and cuts the last into powers of two."""
        rest = [(fill, w) for fill in range(self.length - 1, 0, -1) for w in self.open[fill]]
        low, high = len(rest) - 1, 0
        while high < low:
            fill, window = rest[high]
            while fill < self.length and low > high:
                have, source = rest[low]
                doc, at, ids, total = source.pop()
                take = min(len(ids), self.length - fill)
                window.append((doc, at, ids[:take], total))
                fill += take
                if take < len(ids):
                    source.append((doc, at + take, ids[take:], total))
                rest[low] = (have - take, source)
                if have == take:
                    low -= 1
            if fill == self.length:
                yield window
                high += 1
            else:
                rest[high] = (fill, window)
        if high == low:
            fill, window = rest[high]
            if fill == self.length:
                yield window
                return
            while fill:
                size, part = 1 << (fill.bit_length() - 1), []
                need = size
                while need:
                    doc, at, ids, total = window.pop(0)
                    take = min(need, len(ids))
                    part.append((doc, at, ids[:take], total))
                    if take < len(ids):
                        window.insert(0, (doc, at + take, ids[take:], total))
                    need -= take
                yield part
                fill -= size
        self.open = [[] for _ in range(self.length)]
        self.levels[:] = 0


def _pack(batches: Iterator[pa.RecordBatch], spec, length: int) -> Iterator[pa.RecordBatch]:
    packer, base, sequence = Packer(length), TaskContext.get().partitionId() << 40, 0
    cols: list[list] = [[] for _ in range(7)]

    def take(window):
        nonlocal sequence
        offset = 0
        for doc, at, ids, total in window:
            for col, v in zip(cols, (doc, at, len(ids), total, base + sequence, offset, ids.astype("<u4").tobytes()), strict=True):
                col.append(v)
            offset += len(ids)
        sequence += 1

    def batch():
        names = ["doc_id", "start", "length", "doc_tokens", "sequence_id", "offset"]
        out = pa.record_batch([*[pa.array(c, pa.int64()) for c in cols[:6]], pa.array(cols[6], pa.binary())], [*names, "ids"])
        for c in cols:
            c.clear()
        return out

    for b in batches:
        ids, at = encoder(spec).encode(b["_text"])
        for k, doc in enumerate(b["_id"].to_pylist()):
            for window in packer.add(doc, ids[at[k] : at[k + 1]].copy()):
                take(window)
        if len(cols[0]) >= 500:
            yield batch()
    for window in packer.finish():
        take(window)
        if len(cols[0]) >= 500:
            yield batch()
    if cols[0]:
        yield batch()


def pack(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, tokenizer: str | None = None) -> DataFrame:
    """One row per piece, with its ids as little-endian unsigned 32-bit integers; a sequence is the pieces of one sequence_id by offset."""
    small_batches(df.sparkSession)
    spec = shared_tokenizer(df.sparkSession, tokenizer)
    pieces = id_text(df, id_col, text_col).mapInArrow(lambda it: _pack(it, spec, length), PIECE)
    return pieces.withColumn("doc_id", real_id("doc_id"))


def digest(pieces: DataFrame) -> DataFrame:
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def op6_packing(spark, sf_dir: str) -> DataFrame:
    return digest(pack(table(spark, sf_dir, "documents")))
