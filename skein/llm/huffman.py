"""Token ids in a binary format: canonical length-limited Huffman codes in independent blocks with bit-offset checkpoints.

Writing deals the texts out in ranges of ascending doc_id, tokenizes them there and stores plain blocks of ids in the
shared folder. All ids are counted as they are made, in one row a range, and summed by id; from the counts
package-merge gives code lengths of at most LIMIT bits. Each plain block then becomes a coded one, with its documents' ids
and token counts, its bits, and the bit offset of every STEP-th token. The lengths and the tokens of each range (one number
a range) make the manifest.

Reading needs a block and the manifest only. One table lookup a token decodes it; the checkpoints let all stretches of a
block be decoded side by side, one token of each at a time.

Files are Parquet tables of blocks in the shared folder, so that any store that Spark can write holds them.
Defined results: null text counts as empty (the end id alone), null ids sort first, rows with equal ids are written each,
other columns are not looked at, an empty table gives no block.
"""

from __future__ import annotations

import json
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skein.llm.common import id_text, partitions_for, real_id, removed, shared_dir, small_batches, table
from skein.llm.tokens import encoder, shared_tokenizer

#: Most bits of a code, tokens between checkpoints, and tokens after which a block ends (with the document).
LIMIT, STEP, BLOCK = 18, 256, 1 << 18
#: Bytes of a range of documents, by the files' sizes.
RANGE = 128 << 20
BLOCKS = "part int, block int, doc_ids array<long>, doc_tokens array<long>, tokens long, bits binary, checkpoints binary"
PLAIN = BLOCKS + ", seen binary"


def code_lengths(counts: np.ndarray, limit: int = LIMIT) -> np.ndarray:
    """Package-merge: for each count the length of its code, 0 where the count is 0, at the least total of count times length."""
    used = np.flatnonzero(counts)
    out = np.zeros(len(counts), np.uint8)
    if len(used) < 2:
        out[used] = 1
        return out
    limit = max(limit, int(len(used) - 1).bit_length())
    order = used[np.argsort(counts[used], kind="stable")]
    leaves = counts[order].astype(np.float64)
    lists, packages = [], np.empty(0)
    for _ in range(limit):
        both = np.concatenate([leaves, packages])
        rank = np.argsort(both, kind="stable")
        lists.append(rank < len(leaves))
        both = both[rank]
        packages = both[: len(both) // 2 * 2].reshape(-1, 2).sum(axis=1)
    length, take = np.zeros(len(order), np.int64), 2 * len(order) - 2
    for leaf in reversed(lists):
        n = int(leaf[:take].sum())
        length[:n] += 1
        take = 2 * (take - n)
    out[order] = length
    return out


def canonical_codes(lengths: np.ndarray) -> np.ndarray:
    """Codes that ascend by length, then by id."""
    codes = np.zeros(len(lengths), np.uint32)
    code = last = 0
    for i in np.lexsort((np.arange(len(lengths)), lengths)):
        if n := int(lengths[i]):
            code = (code << (n - last)) if last else 0
            codes[i], last = code, n
            code += 1
    return codes


def decode_table(lengths: np.ndarray) -> tuple[int, np.ndarray, np.ndarray]:
    """(width, id, length) for every value of the next width bits."""
    width = int(lengths.max(initial=1))
    symbol, size = np.zeros(1 << width, np.uint32), np.ones(1 << width, np.uint8)
    codes = canonical_codes(lengths)
    for i in np.flatnonzero(lengths):
        n = int(lengths[i])
        a = int(codes[i]) << (width - n)
        symbol[a : a + (1 << (width - n))], size[a : a + (1 << (width - n))] = i, n
    return width, symbol, size


def encode_block(ids: np.ndarray, lengths: np.ndarray, codes: np.ndarray) -> tuple[bytes, bytes]:
    """The bits, high bit first, and the offsets of every STEP-th token."""
    n = lengths[ids].astype(np.int64)
    at = np.cumsum(n) - n
    total = int(n.sum())
    word, shift = at >> 5, 64 - (at & 31) - n
    value = codes[ids].astype(np.uint64) << shift.astype(np.uint64)
    size = (total + 31) // 32 + 3
    high, low = (value >> np.uint64(32)).astype(np.float64), (value & np.uint64(0xFFFFFFFF)).astype(np.float64)
    words = np.bincount(word, weights=high, minlength=size) + np.bincount(word + 1, weights=low, minlength=size)
    return words.astype(">u4").tobytes(), at[::STEP].astype("<u4").tobytes()


def decode_block(bits: bytes, checkpoints: bytes, tokens: int, tables: tuple[int, np.ndarray, np.ndarray]) -> np.ndarray:
    width, symbol, size = tables
    words = np.frombuffer(bits, ">u4").astype(np.uint64)
    at = np.frombuffer(checkpoints, "<u4").astype(np.int64)
    out = np.zeros((STEP, len(at)), np.uint32)
    rest = tokens - (len(at) - 1) * STEP if len(at) else 0
    mask = np.uint64((1 << width) - 1)
    for k in range(STEP):
        live = len(at) if k < rest else len(at) - 1
        if live <= 0:
            break
        p = at[:live]
        w = p >> 5
        pair = (words[w] << np.uint64(32)) | words[w + 1]
        key = ((pair >> (64 - width - (p & 31)).astype(np.uint64)) & mask).astype(np.int64)
        out[k, :live] = symbol[key]
        at[:live] = p + size[key]
    return out.T.reshape(-1)[:tokens]


def _plain(batches: Iterator[pa.RecordBatch], spec) -> Iterator[pa.RecordBatch]:
    """Blocks of ids, in 16 bits each where all fit; at last a row without a block, with the ids of all and how often each was there."""
    part, block = TaskContext.get().partitionId(), 0
    total = np.zeros(1 << 16, np.int64)
    docs, counts, held, size = [], [], [], 0

    def close():
        nonlocal total
        ids = np.concatenate(held)
        got = np.bincount(ids, minlength=len(total))
        total = np.concatenate([total, np.zeros(len(got) - len(total), np.int64)]) + got
        wide = ids.max(initial=0) >= 1 << 16
        row = [[part], [block], [docs], [counts], [size], [ids.astype("<u4" if wide else "<u2").tobytes()], [bytes([4 if wide else 2])]]
        return _with_seen(_block(row), b"")

    for b in batches:
        ids, at = encoder(spec).encode(b["_text"])
        names, begin = b["_id"].to_pylist(), 0
        for k, doc in enumerate(names):
            docs.append(doc)
            counts.append(int(at[k + 1] - at[k]))
            size += counts[-1]
            if size >= BLOCK:
                held.append(ids[at[begin] : at[k + 1]])
                yield close()
                docs, counts, held, size, block, begin = [], [], [], 0, block + 1, k + 1
        if begin < len(names):
            held.append(ids[at[begin] :])
    if docs:
        yield close()
    used = np.flatnonzero(total)
    yield _with_seen(_block([[part], [-1], [[]], [[]], [0], [b""], [b""]]), np.concatenate([used, total[used]]).astype("<i8").tobytes())


def _with_seen(block: pa.RecordBatch, seen: bytes) -> pa.RecordBatch:
    return pa.record_batch([*block.columns, pa.array([seen], pa.binary())], [*block.schema.names, "seen"])


def _block(row: list) -> pa.RecordBatch:
    types = [pa.int32(), pa.int32(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.int64(), pa.binary(), pa.binary()]
    return pa.record_batch([pa.array(v, t) for v, t in zip(row, types, strict=True)], ["part", "block", "doc_ids", "doc_tokens", "tokens", "bits", "checkpoints"])


def _ids_of(bits: bytes, mark: bytes) -> np.ndarray:
    return np.frombuffer(bits, f"<u{mark[0]}")


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total = np.zeros(1 << 16, np.int64)
    for b in batches:
        for seen in b["seen"].to_pylist():
            ids, n = np.frombuffer(seen, "<i8").reshape(2, -1)
            total = np.concatenate([total, np.zeros(max(0, ids.max(initial=0) + 1 - len(total)), np.int64)])
            total[ids] += n
    used = np.flatnonzero(total)
    yield pa.record_batch([pa.array(used, pa.int64()), pa.array(total[used], pa.int64())], ["id", "n"])


def _code(batches: Iterator[pa.RecordBatch], lengths: np.ndarray) -> Iterator[pa.RecordBatch]:
    codes = canonical_codes(lengths)
    for b in batches:
        for row in b.to_pylist():
            bits, checkpoints = encode_block(_ids_of(row["bits"], row["checkpoints"]), lengths, codes)
            yield _block([[row["part"]], [row["block"]], [row["doc_ids"]], [row["doc_tokens"]], [row["tokens"]], [bits], [checkpoints]])


def _read(batches: Iterator[pa.RecordBatch], lengths: np.ndarray) -> Iterator[pa.RecordBatch]:
    tables = decode_table(lengths)
    for b in batches:
        for begin, docs, counts, n, bits, checkpoints in zip(*[b[c].to_pylist() for c in ("begin", "doc_ids", "doc_tokens", "tokens", "bits", "checkpoints")], strict=True):
            ids = decode_block(bits, checkpoints, n, tables).astype("<u4")
            ends = np.concatenate([[0], np.cumsum(counts)]).astype(np.int64)
            for k in range(0, len(docs), 500):
                part_ids = [ids[a:e].tobytes() for a, e in zip(ends[k : k + 500], ends[k + 1 : k + 501], strict=False)]
                m = len(part_ids)
                yield pa.record_batch(
                    [pa.array(docs[k : k + m], pa.int64()), pa.array(begin + ends[k : k + m], pa.int64()), pa.array(counts[k : k + m], pa.int64()), pa.array(part_ids, pa.binary())],
                    ["doc_id", "start", "n_tokens", "ids"],
                )


def write(df: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", tokenizer: str | None = None) -> None:
    """Writes path/blocks and path/manifest."""
    spark = df.sparkSession
    small_batches(spark)
    spec, source = shared_tokenizer(spark, tokenizer), id_text(df, id_col, text_col)
    ranged, plain = source.repartitionByRange(partitions_for(source, RANGE), "_id").sortWithinPartitions("_id"), shared_dir(spark, "ids")
    ranged.mapInArrow(lambda it: _plain(it, spec), PLAIN).write.option("compression", "zstd").parquet(plain)
    stored_ids = spark.read.schema(PLAIN).parquet(plain)
    # one row per id of the vocabulary reaches the driver
    seen = stored_ids.select("seen").filter("length(seen) > 0").mapInArrow(_count, "id long, n long").groupBy("id").agg(F.sum("n").alias("n")).collect()
    counts = np.zeros(max([r["id"] for r in seen], default=0) + 1, np.int64)
    for r in seen:
        counts[r["id"]] = r["n"]
    lengths = code_lengths(counts)
    stored_ids.filter("block >= 0").drop("seen").mapInArrow(lambda it: _code(it, lengths), BLOCKS).write.parquet(f"{path}/blocks")
    removed(spark, plain)
    # a number for each block's tokens, summed by range: one row per range reaches the driver
    sums = spark.read.schema(BLOCKS).parquet(f"{path}/blocks").groupBy("part").agg(F.sum("tokens").alias("n")).collect()
    bases, total = [], 0
    for part, n in sorted((r["part"], r["n"]) for r in sums):
        bases.append([part, total])
        total += n
    manifest = json.dumps({"lengths": lengths.tolist(), "bases": bases, "tokens": total})
    spark.createDataFrame([(manifest,)], "manifest string").coalesce(1).write.parquet(f"{path}/manifest")


def read(spark: SparkSession, path: str) -> DataFrame:
    """One row per document in the files: doc_id, start, n_tokens, ids (little-endian unsigned 32-bit integers)."""
    manifest = json.loads(spark.read.parquet(f"{path}/manifest").first()["manifest"])
    lengths = np.array(manifest["lengths"], np.uint8)
    blocks = spark.read.schema(BLOCKS).parquet(f"{path}/blocks")
    # where each block begins: tokens of the ranges before it (manifest) and of the blocks before it in its range
    from pyspark.sql import Window

    bases = spark.createDataFrame(manifest["bases"] or [[-1, 0]], "part int, base long")
    before = Window.partitionBy("part").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    begins = blocks.select("part", "block", "tokens").withColumn("b", F.coalesce(F.sum("tokens").over(before), F.lit(0))).join(F.broadcast(bases), "part").select("part", "block", (F.col("b") + F.col("base")).alias("begin"))
    # the coded blocks move, not the ids
    docs = blocks.join(begins, ["part", "block"]).mapInArrow(lambda it: _read(it, lengths), "doc_id long, start long, n_tokens long, ids binary")
    return docs.withColumn("doc_id", real_id("doc_id"))


def op5_token_file(spark, sf_dir: str) -> DataFrame:
    path = shared_dir(spark, "tokens")
    write(table(spark, sf_dir, "documents"), path)
    return read(spark, path).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))
