"""What the corpus operators share: bounded Arrow batches, shared folders, word and shingle hashing."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Stands for a null id inside an operator, so that nulls sort first; it is turned back at the end.
NULL_ID = -(2**63)
#: Rows and bytes of one Arrow batch handed to a Python worker.
BATCH_ROWS, BATCH_BYTES = 1000, 4 << 20
#: Bytes of text that are hashed at once.
SLICE = 1 << 20

_U = np.uint64
_MUL = _U(0x9E3779B97F4A7C15)
_POW = np.empty(0, np.uint64)
_TABLE = np.random.default_rng(20240501).integers(1, 2**63, 256, dtype=np.uint64) * _U(2) + _U(1)
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, 9, 10, 11, 12, 13]] = True


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def small_batches(spark: SparkSession) -> None:
    """Keeps what a Python worker holds at once to a few MB whatever the texts' lengths."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS)
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)
    # what a finished query has shuffled is of no use to the next
    spark.conf.set("spark.sql.classic.shuffleDependency.fileCleanup.enabled", True)


def shared_dir(spark: SparkSession, label: str) -> str:
    """A new folder below the one that driver and executors share (spark.checkpoint.dir); where it is unset, a local one if Spark is local, as in tests, else an error."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not re.fullmatch(r"local(\[[^-]*\])?", spark.sparkContext.master):
            raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
        base = "file://" + tempfile.mkdtemp(prefix="skein-")
        spark.conf.set("spark.checkpoint.dir", base)
    return f"{base.rstrip('/')}/{label}-{uuid.uuid4().hex}"


def stored(df: DataFrame, label: str, made: list[str] | None = None) -> DataFrame:
    """The rows written as a table in the shared folder and read again: cuts the lineage and survives lost executors. made gets the table's path, for removed()."""
    path = shared_dir(df.sparkSession, label)
    df.write.parquet(path)
    if made is not None:
        made.append(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def removed(spark: SparkSession, path: str) -> None:
    """Deletes a folder of shared_dir() that nothing reads any more, by the file system that Spark uses."""
    jvm = spark.sparkContext._jvm
    place = jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(place, True)


def partitions_for(df: DataFrame, each: int) -> int:
    """As many partitions as Spark is set to, or more, so that none has more than so many bytes by the plan's own estimate (which a scan takes from its files' sizes; an estimate beyond all bounds counts for nothing)."""
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), size // each if size < 1 << 60 else 0)


def packed_rows(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(_id, _text, _row): the whole row travels in one struct, so that no column name can clash."""
    return df.select(F.coalesce(F.col(f"`{id_col}`").cast("long"), F.lit(NULL_ID)).alias("_id"), F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("_text"), F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("_row"))


def id_text(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    return df.select(F.coalesce(F.col(f"`{id_col}`").cast("long"), F.lit(NULL_ID)).alias("_id"), F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("_text"))


def real_id(col):
    return F.when(F.col(col) != NULL_ID, F.col(col)) if isinstance(col, str) else F.when(col != NULL_ID, col)


def utf8_buffer(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column and its n+1 offsets; nulls are empty."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    col = col.cast(pa.large_binary()) if not pa.types.is_large_binary(col.type) else col
    if col.null_count:
        col = col.fill_null(b"")
    offsets = np.frombuffer(col.buffers()[1], np.int64)[col.offset : col.offset + len(col) + 1]
    data = np.frombuffer(col.buffers()[2], np.uint8) if col.buffers()[2] is not None and offsets[-1] else np.empty(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def mix64(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser."""
    x = x ^ (x >> _U(30))
    x = x * _U(0xBF58476D1CE4E5B9)
    x = x ^ (x >> _U(27))
    x = x * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def _powers(n: int) -> np.ndarray:
    global _POW
    if len(_POW) < n:
        size = max(1024, 1 << (n - 1).bit_length())
        with np.errstate(over="ignore"):
            _POW = np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(size - 1, _MUL)]))
    return _POW


def _slice_hashes(data: np.ndarray, starts: np.ndarray, lower: bool) -> tuple[np.ndarray, np.ndarray]:
    """(places where words begin, their hashes); starts: places at which a text begins."""
    space = _SPACE[data]
    edge = np.empty(len(data), bool)
    edge[0] = True
    edge[1:] = space[:-1]
    edge[starts] = True
    edge &= ~space
    begin = np.flatnonzero(edge)
    if not len(begin):
        return begin, np.empty(0, np.uint64)
    word_of = np.cumsum(edge, dtype=np.int32) - np.int32(1)
    keep = np.flatnonzero(~space)
    w = word_of[keep]
    place = keep - begin[w]
    letters = data[keep]
    if lower:
        letters = LOWER[letters]
    with np.errstate(over="ignore"):
        value = _TABLE[letters] * _powers(int(place.max()) + 1)[place]
        cut = np.flatnonzero(np.concatenate([[True], w[1:] != w[:-1]]))
        sums = np.add.reduceat(value, cut)
        lengths = np.diff(np.append(cut, len(w))).astype(np.uint64)
        return begin, mix64(sums + lengths * _MUL)


def placed_hashes(data: np.ndarray, offsets: np.ndarray, lower: bool = True) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """64-bit hashes of the words [^\\x20\\x09-\\x0D]+ of all texts, in order, the n+1 offsets of each text's words, and where each word begins. Works through the bytes in slices, so that its arrays stay small whatever the texts' lengths."""
    begins, hashes, a, n = [], [], 0, len(data)
    while a < n:
        b = min(a + SLICE, n)
        while b < n:  # move to where no word is cut, by space or by the end of a text
            ahead = _SPACE[data[b : b + 4096]]
            stop = int(np.argmax(ahead)) if ahead.any() else len(ahead)
            after = np.searchsorted(offsets, b)
            end = int(offsets[after]) if after < len(offsets) else n
            if end <= b + stop or ahead.any():
                b = min(b + stop, end)
                break
            b += len(ahead)
        starts = offsets[np.searchsorted(offsets, a) : np.searchsorted(offsets, b)]
        begin, hashed = _slice_hashes(data[a:b], starts - a, lower)
        begins.append(begin + a)
        hashes.append(hashed)
        a = b
    if not begins:
        return np.empty(0, np.uint64), np.zeros(len(offsets), np.int64), np.empty(0, np.int64)
    begin = np.concatenate(begins)
    return np.concatenate(hashes), np.searchsorted(begin, offsets).astype(np.int64), begin


def word_hashes(data: np.ndarray, offsets: np.ndarray, lower: bool = True) -> tuple[np.ndarray, np.ndarray]:
    return placed_hashes(data, offsets, lower)[:2]


def runs(offsets: np.ndarray, size: int) -> Iterator[tuple[int, int]]:
    """The items whose n+1 offsets are given, in runs (first, end) that span at most size; an item that is longer is a run by itself."""
    a, n = 0, len(offsets) - 1
    while a < n:
        b = max(a + 1, int(np.searchsorted(offsets, offsets[a] + size, "right")) - 1)
        yield a, b
        a = b


def owners(at: np.ndarray, a: int, b: int) -> np.ndarray:
    """The documents of the places a to b, of which at has the n+1 offsets."""
    first, last = int(np.searchsorted(at, a, "right")) - 1, int(np.searchsorted(at, b - 1, "right"))
    ends = np.clip(at[first : last + 1], a, b)
    return np.repeat(np.arange(first, last, dtype=np.int32), np.diff(ends))


def shingle_sets(data: np.ndarray, offsets: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Each text's sorted distinct hashes of its shingles of so many words, flat, and n+1 offsets. A text of fewer words is one shingle; without words it has none. Works through runs of texts of SLICE bytes."""
    flat, sizes = [np.empty(0, np.uint64)], [np.zeros(1, np.int64)]
    for a, b in runs(offsets, SLICE):
        found, at = _run_sets(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a], width)
        flat.append(found)
        sizes.append(np.diff(at))
    return np.concatenate(flat), np.cumsum(np.concatenate(sizes))


def _run_sets(data: np.ndarray, offsets: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    words, at = word_hashes(data, offsets)
    n = len(offsets) - 1
    count = np.diff(at)
    per = np.where(count >= width, count - width + 1, (count > 0).astype(np.int64))
    out_at = np.concatenate([[0], np.cumsum(per)])
    doc = np.repeat(np.arange(n), per)
    if not len(doc):
        return np.empty(0, np.uint64), np.zeros(n + 1, np.int64)
    start = np.repeat(at[:-1] - out_at[:-1], per) + np.arange(len(doc))
    end = np.minimum(start + width, np.repeat(at[1:], per))
    with np.errstate(over="ignore"):
        h = np.full(len(doc), _U(0x243F6A8885A308D3), np.uint64)
        for k in range(width):
            there = start + k < end
            step = mix64(h * _U(0xD6E8FEB86659FD93) + words[np.minimum(start + k, len(words) - 1)] + _U(k + 1))
            h = np.where(there, step, h)
    order = np.lexsort((h, doc))
    doc, h = doc[order], h[order]
    new = np.concatenate([[True], (doc[1:] != doc[:-1]) | (h[1:] != h[:-1])])
    doc, h = doc[new], h[new]
    return h, np.searchsorted(doc, np.arange(n + 1)).astype(np.int64)


WORD = re.compile(rb"[^\x20\x09-\x0D]+")
