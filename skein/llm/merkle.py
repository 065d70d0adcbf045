"""Fingerprints of documents: a Merkle tree over sections, paragraphs and short runs of words.

A paragraph is a line; its digest covers its exact bytes. Sections are runs of paragraphs that end after a blank line or
where a paragraph's own digest says so, so an edit moves no far boundary. The root covers the sections' digests: roots are
equal if and only if the texts are. Below the paragraphs lie runs of words that end where a word's hash says so; their
24-bit codes are the leaves.

A fingerprint is `root;section:leaves;section:leaves...`, so two fingerprints alone tell equality, which sections differ,
and how alike the texts are: twice the shared leaves over all leaves (1 if the roots are equal). Its length follows the
text's (about an eighth).

Neighbours: documents are dealt out in ranges of doc_id, in one shuffle, and read in order with one row of look-ahead; with
each range comes one more row, the first text of the next range. Defined results: null text counts as empty, null ids sort
first, rows with equal id are neighbours in order of their texts (in bytes), a single row is its own next, other columns are not
looked at, an empty table gives an empty result.
"""

from __future__ import annotations

import base64
import hashlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skein.llm.common import id_text, mix64, placed_hashes, real_id, small_batches, table, utf8_buffer

#: One word of so many ends a leaf, one paragraph of so many ends a section; most words of a leaf.
LEAF, SECTION, LONGEST = 4, 4, 64
_U = np.uint64


def _leaves(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(24-bit codes of all leaves, each leaf's text, each leaf's line in its text)."""
    data, offsets = utf8_buffer(pa.array(texts, pa.large_binary()))
    words, at, begin = placed_hashes(data, offsets, lower=False)
    doc = np.repeat(np.arange(len(texts)), np.diff(at))
    breaks = np.flatnonzero(data == 10)
    line = np.searchsorted(breaks, begin) - np.searchsorted(breaks, offsets[:-1])[doc]
    if not len(words):
        return np.empty(0, np.int64), doc, line
    ends = mix64(words ^ _U(0xA5A5A5A5)) % _U(LEAF) == 0
    new = np.ones(len(words), bool)
    new[1:] = ends[:-1] | (doc[1:] != doc[:-1]) | (line[1:] != line[:-1])
    first = np.flatnonzero(new)
    place = np.arange(len(words)) - first[np.cumsum(new) - 1]
    long = place % LONGEST == 0
    first = np.flatnonzero(new | long)
    place = np.arange(len(words)) - first[np.cumsum(new | long) - 1]
    with np.errstate(over="ignore"):
        value = mix64(words + place.astype(np.uint64) * _U(0x9E3779B97F4A7C15))
        sums = mix64(np.add.reduceat(value, first))
    return (sums >> _U(40)).astype(np.int64), doc[first], line[first]


def _digest(data: bytes) -> bytes:
    return hashlib.blake2b(data, digest_size=16).digest()


def fingerprints(texts: list[str]) -> list[str]:
    raw = [t.encode() for t in texts]
    codes, doc, line = _leaves(raw)
    at = np.searchsorted(doc, np.arange(len(raw) + 1))
    triple = np.stack([codes >> 16, codes >> 8 & 255, codes & 255], axis=1).astype(np.uint8)
    out = []
    for k, text in enumerate(raw):
        lines, parts, held, begin, lo = text.split(b"\n"), [], [], 0, int(at[k])
        own = line[at[k] : at[k + 1]]
        roots = hashlib.blake2b(digest_size=16)
        for i, paragraph in enumerate(lines):
            held.append(d := _digest(paragraph))
            if i == len(lines) - 1 or not paragraph.strip() or d[0] % SECTION == 0:
                section = _digest(b"".join(held))
                roots.update(section)
                hi = int(at[k]) + int(np.searchsorted(own, i, "right"))
                parts.append(f"{section[:4].hex()}:{base64.b64encode(triple[lo:hi].tobytes()).decode()}")
                held, begin, lo = [], i + 1, hi
        out.append(f"{roots.hexdigest()};{';'.join(parts)}")
    return out


def leaves(fingerprint: str) -> Counter:
    found: Counter = Counter()
    for part in fingerprint.split(";")[1:]:
        code = base64.b64decode(part.partition(":")[2])
        found.update(code[i : i + 3] for i in range(0, len(code), 3))
    return found


def likeness(a: str, b: str, of_a: Counter | None = None, of_b: Counter | None = None) -> float:
    """0 to 1; 1 only if the roots are equal."""
    if a.partition(";")[0] == b.partition(";")[0]:
        return 1.0
    x, y = of_a if of_a is not None else leaves(a), of_b if of_b is not None else leaves(b)
    if len(x) > len(y):
        x, y = y, x
    shared, whole = sum(min(n, y[c]) for c, n in x.items() if c in y), x.total() + y.total()
    return min(2 * shared / whole, 1 - 1 / (whole + 1)) if whole else 0.0


def differing_sections(a: str, b: str) -> tuple[list[int], list[int]]:
    """The places of the sections of either that the other lacks: where an edit lies."""
    x, y = a.split(";")[1:], b.split(";")[1:]
    return [i for i, p in enumerate(x) if p not in set(y)], [i for i, p in enumerate(y) if p not in set(x)]


def edited(text: str, following: str) -> str:
    """The last half (rounded down) of the code points replaced by the first as many of the following text."""
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


OUT = "_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
_NAMES = [c.split()[0] for c in OUT.split(", ")]
_TYPES = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]
#: Ranges for each shuffle partition.
RANGES = 4


def compare(rows: list[tuple[int, str, str]]) -> list[tuple]:
    """rows: (id, text, following text)."""
    changed = [edited(t, n) for _, t, n in rows]
    prints = fingerprints([x for (_, t, n), e in zip(rows, changed, strict=True) for x in (t, e, n)])
    out = []
    for k, ((i, t, _), e) in enumerate(zip(rows, changed, strict=True)):
        a, b, c = prints[3 * k : 3 * k + 3]
        of = leaves(a)
        out.append((i, len(t), hashlib.sha256(e.encode()).hexdigest(), a, b, likeness(a, b, of), likeness(a, c, of)))
    return out


def _walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows come by range, ids and texts; the one with following set is the next range's first."""
    last, pairs = None, []

    def done():
        rows = compare(pairs)
        pairs.clear()
        return pa.record_batch([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), _TYPES, strict=True)], _NAMES)

    for b in batches:
        for i, text, following in zip(b["_id"].to_pylist(), b["_text"].to_pylist(), b["following"].to_pylist(), strict=True):
            if last is not None:
                pairs.append((*last, text))
            last = None if following else (i, text)
            if len(pairs) >= 200:
                yield done()
    if pairs:
        yield done()


def _ranged(batches: Iterator[pa.RecordBatch], bounds: np.ndarray) -> Iterator[pa.RecordBatch]:
    for b in batches:
        at = np.searchsorted(bounds, b["_id"].to_numpy(), "right")
        yield pa.record_batch([pa.array(at, pa.int32()), pa.array(np.zeros(len(b), bool)), b["_id"], b["_text"]], ["range", "following", "_id", "_text"])


def neighbour_prints(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next."""
    spark = df.sparkSession
    small_batches(spark)
    docs, parts = id_text(df, id_col, text_col), int(spark.conf.get("spark.sql.shuffle.partitions"))
    n = RANGES * parts
    # two numbers a range reach the driver: where it begins and its first id
    bounds = np.unique(np.array(docs.approxQuantile("_id", [k / n for k in range(1, n)], min(0.001, 0.1 / n)), np.float64)).astype(np.int64)
    schema = "range int, following boolean, _id long, _text string"
    firsts = docs.select("_id", F.lit("").alias("_text")).mapInArrow(lambda it: _ranged(it, bounds), schema).groupBy("range").agg(F.min("_id").alias("first")).orderBy("range").collect()
    before = [(firsts[k - 1]["range"], r["first"]) for k, r in enumerate(firsts)]
    edges = docs.join(F.broadcast(spark.createDataFrame(before, "range int, _id long")), "_id").groupBy("range", "_id").agg(F.min("_text").alias("_text"))
    rows = docs.mapInArrow(lambda it: _ranged(it, bounds), schema).unionByName(edges.select("range", F.lit(True).alias("following"), "_id", "_text"))
    walked = rows.repartition(parts, "range").sortWithinPartitions("range", "following", "_id", "_text").select("_id", "_text", "following").mapInArrow(_walk, OUT)
    return walked.withColumn("doc_id", real_id("_id")).select("doc_id", *_NAMES[1:])


def op10_merkle_prints(spark, sf_dir: str) -> DataFrame:
    return neighbour_prints(table(spark, sf_dir, "documents"))
