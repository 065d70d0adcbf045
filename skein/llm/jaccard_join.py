"""Jaccard self-join of documents on word n-gram sets, by T-occurrence search (DivideSkip).

Possible partners are brought together by prefixes of parts. A set's n-grams fall by hash into more parts than twice what
two linked sets of its size class can differ in; each n-gram in one set only spoils one part at most, so linked sets agree
wholly in a known number of parts, and in any order of all parts share one among the first few of each. The order is by
strength: how many n-grams a part has and how rare they are. Two other sets hardly ever agree in all of a strong part, also
when single n-grams are no longer known to be rare. Below t = 0.75 the parts are single n-grams, n - ceil(t n) + 1 of them.

0. Rarity. Chunks of documents send the hashes of COUNTED of their n-grams (each at most twice a chunk, sorted, as packed
   differences) to buckets by hash; there they are counted. What reaches the driver and is broadcast is a table of CELLS
   bytes, for each range of hashes the logarithm of the largest count in it; 0 means that no n-gram of the range is in two
   documents. Its size is fixed: with more n-grams it tells less, and the results stay the same.
1. Signatures. A part of a document's prefix, with the document's size class or the next, is a key; parts with an n-gram that
   no other document has are left out. Chunks collapse equal sets to the smallest id and equal keys to one entry, so that a group of
   copies or near copies of any size sends one entry a key and chunk. Keys are dealt out as packed blocks; of each key the
   entries form a star. The stars' components are coarse groups: no pair above t spans two of them.
2. Search. In each coarse group an inverted index is built and every document is a query: the required overlap T follows
   from the sizes, the L longest of its lists are set aside, the short ones are merged by a heap, ids found at least T-L
   times are probed in the long lists by binary search, and those reaching T are links. When the heap's least id can't
   reach T-L, or is connected with the query already, the lists jump by binary search to the next id that may matter; runs
   of connected ids are remembered, so a large group of near copies costs a few jumps a query, not a visit of each pair.
3. Groups over POSTINGS are searched in blocks: first all documents against one block, each slice of queries with its own
   copy of it; then only documents outside the largest component so far, against all blocks.
4. The links' components, by way of equal sets and equal ids, give component_id.

An n-gram is known by a hash of 64 bits and a set by two sums of such hashes and its size; texts are not compared again.
Defined results: null text counts as empty; a text of fewer words than n is one shingle, without words it has none and is
linked with nothing; rows of equal id are one document, linked with all that any of its texts is linked with; a null id
gets a null component; other columns are not looked at.
"""

from __future__ import annotations

import heapq
import math
from array import array
from bisect import bisect_left
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skein.llm.common import NULL_ID, id_text, mix64, real_id, removed, runs, shingle_sets, small_batches, stored, table, utf8_buffer
from skein.llm.components import _forest, components

#: Bytes of text of a chunk, n-grams of an index block.
CHUNK_BYTES, POSTINGS = 12 << 20, 2_000_000
#: Ranges of hashes whose n-grams are counted, as a power of two; bits of a hash that are counted by; the share of hashes that is.
CELLS, BITS, COUNTED = 24, 40, 0.5
#: Parts of a set at least; the strength of a part that only one document can have; a threshold t has parts if PARTED (1 - t) <= 1.
PARTS, UNIQUE, PARTED = 16, 0xFFFF, 4
#: What an n-gram adds to a part's strength, by the powers of two that it is more frequent than most; at last one that isn't counted. What is frequent is mostly in lines that many documents have as a whole, so more of it says little.
WEIGHTS = np.array([23, 18, 8, 3, 2, 1, 12], np.float64)
#: N-grams that are worked on at once.
GRAMS = 1 << 17
#: DivideSkip's weight of a probe against a merge step.
MU = 0.01
_U = np.uint64


def level_bounds(largest: int, num: int, den: int) -> np.ndarray:
    """Sizes at which levels begin, such that partners lie in the same or neighbouring levels."""
    bounds = [1]
    while bounds[-1] <= largest:
        b = bounds[-1]
        bounds.append(max(b + 1, (b - 1) * den // num + 1))
    return np.array([*bounds, max(bounds[-1] + 1, (bounds[-1] - 1) * den // num + 1)], np.int64)


def _mixed(flat: np.ndarray) -> np.ndarray:
    return mix64(flat ^ _U(0x5851F42D4C957F2D))


def prefix_keys(flat: np.ndarray, at: np.ndarray, num: int, den: int, cells: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(keys, document) of the sets' prefixes at their own and the next size class; what no other document can have is left out."""
    size = np.diff(at)
    doc = np.repeat(np.arange(len(size)), size)
    mixed = _mixed(flat)
    counted = _counted(mixed)
    times = cells[mixed >> _U(64 - CELLS)]
    bounds = level_bounds(int(size.max(initial=1)), num, den)
    level = np.searchsorted(bounds, size, "right") - 1
    keys, owner = [], []
    if PARTED * (den - num) > den:
        # n-grams that aren't counted come last
        rarity = np.where(counted, times, np.uint8(255))
        order = np.lexsort((rarity.astype(np.uint64) << _U(56) | mixed >> _U(8), doc))
        place = np.arange(len(flat)) - np.repeat(at[:-1], size)
        use = order[(place < (size + 1 + -num * size // den)[doc]) & (rarity[order] > 0)]
        for up in (0, 1):
            keys.append(_key(mixed[use], 0, (level + up)[doc[use]]))
            owner.append(doc[use])
        return np.concatenate(keys), np.concatenate(owner)
    more = np.maximum(times.astype(np.int64) - int(np.median(cells[:: max(1, len(cells) >> 14)])), 0)
    weight, alone = np.where(counted, WEIGHTS[np.minimum(more, len(WEIGHTS) - 2)], WEIGHTS[-1]), counted & (times == 0)
    spread = mixed >> _U(16) & _U(0xFFFFFFFF)
    for up in (0, 1):
        top = bounds[level + up + 1] - 1
        parts = np.maximum(PARTS, 2 * (2 * top * (den - num) // (den + num) + 1))
        taken = (size + np.minimum(top, size * den // num)) * (den - num) // (den + num) + 1
        begin = np.concatenate([[0], np.cumsum(parts)])
        slot = begin[doc] + (spread * parts[doc].astype(np.uint64) >> _U(32)).astype(np.int64)
        held = np.zeros(begin[-1], np.uint64)
        with np.errstate(over="ignore"):
            np.add.at(held, slot, mixed)
        strength = np.clip(np.bincount(slot, weight, begin[-1]), 0, UNIQUE - 1).astype(np.uint64)
        strength[slot[alone]] = UNIQUE
        of = np.repeat(np.arange(len(size)), parts)
        place = np.arange(begin[-1]) - begin[of]
        key = _key(held, place, (level + up)[of])
        order = np.lexsort(((_U(UNIQUE) - strength) << _U(48) | key >> _U(16), of))
        use = order[(place < taken[of]) & (strength[order] < UNIQUE)]
        keys.append(key[use])
        owner.append(of[use])
    return np.concatenate(keys), np.concatenate(owner)


def _key(held: np.ndarray, part, level: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        return mix64(held + np.asarray(part).astype(np.uint64) * _U(0xD6E8FEB86659FD93) + level.astype(np.uint64) * _U(0x9E3779B97F4A7C15))


def _counted(mixed: np.ndarray) -> np.ndarray:
    """By the hash's low bits, which say nothing of its cell."""
    return (mixed & _U(0xFFFF)) < _U(COUNTED * 0x10000)


def _counts(batches, width: int, bits: int):
    """(bucket, bytes of a number, numbers): a chunk's counted hashes by their first bits, the others as differences."""
    for ids, flat, at, first, _ in _chunks(batches, width):
        head = (first == np.arange(len(ids))) & (ids != NULL_ID)
        found = []
        for a, b in runs(at, GRAMS):
            mixed = _mixed(flat[at[a] : at[b]][np.repeat(head[a:b], np.diff(at[a : b + 1]))])
            found.append((mixed[_counted(mixed)] >> _U(64 - BITS)).astype(np.int64))
        value = np.sort(np.concatenate(found)) if found else np.empty(0, np.int64)
        twice = np.ones(len(value), bool)
        twice[2:] = value[2:] != value[:-2]
        value = value[twice]
        begins = np.arange((1 << bits) + 1) << (BITS - bits)
        cuts = np.searchsorted(value, begins)
        rows = []
        for k in np.flatnonzero(np.diff(cuts)).tolist():
            steps = np.diff(value[cuts[k] : cuts[k + 1]], prepend=begins[k])
            size = max(1, (int(steps.max()).bit_length() + 7) // 8)
            rows.append((k, size, np.ascontiguousarray(steps.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :size]).tobytes()))
        for k in range(0, len(rows), 500):
            part = rows[k : k + 500]
            yield pa.record_batch([pa.array([r[0] for r in part], pa.int32()), pa.array([r[1] for r in part], pa.int32()), pa.array([r[2] for r in part], pa.binary())], ["bucket", "size", "steps"])


def _cells(batches, bits: int):
    """(bucket, cells): for each range of hashes the logarithm of the largest count. Rows come sorted by bucket."""

    def close(bucket, held):
        value, times = np.unique(np.concatenate(held), return_counts=True)
        more = times > 1
        cells = np.zeros(1 << (CELLS - bits), np.uint8)
        np.maximum.at(cells, value[more] >> (BITS - CELLS), np.minimum(np.log2(times[more]), 254).astype(np.uint8))
        return pa.record_batch([pa.array([bucket], pa.int32()), pa.array([cells.tobytes()], pa.binary())], ["bucket", "cells"])

    at, held = None, []
    for b in batches:
        for bucket, size, steps in zip(*[b[c].to_pylist() for c in ("bucket", "size", "steps")], strict=True):
            if bucket != at:
                if held:
                    yield close(at, held)
                at, held = bucket, []
            wide = np.zeros((len(steps) // size, 8), np.uint8)
            wide[:, :size] = np.frombuffer(steps, np.uint8).reshape(-1, size)
            held.append(np.cumsum(wide.view("<i8").reshape(-1)))
    if held:
        yield close(at, held)


def rarity_cells(docs: DataFrame, width: int) -> np.ndarray:
    """The table of step 0, of fixed size."""
    partitions = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    bits = min(16, max(4, (4 * partitions - 1).bit_length()))
    counts = docs.mapInArrow(lambda it: _counts(it, width, bits), "bucket int, size int, steps binary")
    found = counts.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(lambda it: _cells(it, bits), "bucket int, cells binary").toArrow()
    cells = np.zeros((1 << bits, 1 << (CELLS - bits)), np.uint8)
    for bucket, part in zip(found["bucket"].to_pylist(), found["cells"].to_pylist(), strict=True):
        cells[bucket] = np.frombuffer(part, np.uint8)
    return cells.reshape(-1)


def _chunks(batches: Iterator[pa.RecordBatch], width: int):
    """(ids, n-grams flat, offsets, place of the first document with the same set) of bounded chunks."""

    def close(held):
        part = pa.Table.from_batches(held)
        ids = part["_id"].to_numpy()
        flat, at = shingle_sets(*utf8_buffer(part["_text"]), width)
        size = np.diff(at)
        sums = [np.zeros(len(size), np.uint64) for _ in range(2)]
        for a, b in runs(at, GRAMS):
            there = a + np.flatnonzero(size[a:b])
            for salt in (1, 2) if len(there) else ():
                with np.errstate(over="ignore"):
                    sums[salt - 1][there] = np.add.reduceat(mix64(flat[at[a] : at[b]] * _U(2 * salt + 1) + _U(salt)), at[there] - at[a])
        order = np.lexsort((ids, sums[1], sums[0], size))
        same = np.ones(len(ids), bool)
        if len(ids):
            a, b = order[1:], order[:-1]
            same[1:] = ~((size[a] == size[b]) & (sums[0][a] == sums[0][b]) & (sums[1][a] == sums[1][b]) & (size[a] > 0) & (ids[b] != NULL_ID))
        first = np.empty(len(ids), np.int64)
        first[order] = order[same][np.cumsum(same) - 1]
        return ids, flat, at, first, sums

    held, nbytes = [], 0
    for b in batches:
        held.append(b)
        nbytes += b.nbytes
        if nbytes >= CHUNK_BYTES:
            yield close(held)
            held, nbytes = [], 0
    if sum(map(len, held)):
        yield close(held)


def _members(batches, width: int):
    for ids, _, at, first, sums in _chunks(batches, width):
        yield pa.record_batch([pa.array(ids), pa.array(np.diff(at)), pa.array(ids[first]), pa.array(sums[0].view(np.int64)), pa.array(sums[1].view(np.int64))], ["id", "n", "head", "h1", "h2"])


def _stars(keys: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """One entry a key with its smallest id; the distinct edges from the other ids to it."""
    order = np.lexsort((ids, keys))
    keys, ids = keys[order], ids[order]
    new = np.concatenate([[True], keys[1:] != keys[:-1]]) if len(keys) else np.empty(0, bool)
    least = ids[new][np.cumsum(new) - 1] if len(keys) else ids
    more = ids != least
    return keys[new], ids[new], np.unique(np.stack([ids[more], least[more]], axis=1), axis=0) if more.any() else np.empty((0, 2), np.int64)


def _signatures(batches, width: int, num: int, den: int, buckets: int, cells):
    """Packed (key, id) entries by bucket; the edges within the chunk go along in some bucket."""
    for ids, flat, at, first, _ in _chunks(batches, width):
        use = np.flatnonzero((first == np.arange(len(ids))) & (np.diff(at) > 0) & (ids != NULL_ID))
        if not len(use):
            continue
        size = np.diff(at)[use]
        ends = np.concatenate([[0], np.cumsum(size)])
        found = []
        for a, b in runs(ends, GRAMS):
            pick = np.arange(ends[b] - ends[a]) + np.repeat(at[use[a:b]] - ends[a:b] + ends[a], size[a:b])
            key, doc = prefix_keys(flat[pick], ends[a : b + 1] - ends[a], num, den, cells.value)
            found.append((key, ids[use[a:b]][doc]))
        keys, owner, edges = _stars(*(np.concatenate([x[k] for x in found]) for k in (0, 1)))
        if not len(keys):
            continue
        bucket = ((keys >> _U(32)) * _U(buckets) >> _U(32)).astype(np.int32)
        order = np.lexsort((owner, bucket))
        keys, owner, bucket = keys[order], owner[order], bucket[order]
        cuts = np.flatnonzero(np.concatenate([[True], bucket[1:] != bucket[:-1], [True]]))
        rows = [(int(bucket[a]), *_packed(keys[a:b], owner[a:b]), b"") for a, b in zip(cuts, cuts[1:], strict=False)]
        if len(edges):
            rows.append((int(edges[0, 0]) % buckets, b"", b"", b"", edges.astype(np.int64).tobytes()))
        for k in range(0, len(rows), 500):
            part = rows[k : k + 500]
            yield pa.record_batch([pa.array([r[0] for r in part], pa.int32()), *[pa.array([r[i] for r in part], pa.binary()) for i in range(1, 5)]], ["bucket", "keys", "ids", "counts", "edges"])


def _packed(keys: np.ndarray, owner: np.ndarray) -> tuple[bytes, bytes, bytes]:
    """Entries sorted by id in few bytes: 40 bits of each key (the bucket has the high ones; a chance agreement is only one more comparison), and of each id its distance to the one before and the number of its keys."""
    new = np.concatenate([[True], owner[1:] != owner[:-1]])
    ids = owner[new]
    counts = np.diff(np.append(np.flatnonzero(new), len(owner)))
    return keys.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :5].tobytes(), np.diff(ids, prepend=0).astype("<i8").tobytes(), counts.astype("<u4").tobytes()


def _unpacked(keys: bytes, ids: bytes, counts: bytes) -> tuple[np.ndarray, np.ndarray]:
    wide = np.zeros((len(keys) // 5, 8), np.uint8)
    wide[:, :5] = np.frombuffer(keys, np.uint8).reshape(-1, 5)
    return wide.view("<u8").reshape(-1).astype(np.uint64), np.repeat(np.cumsum(np.frombuffer(ids, "<i8")), np.frombuffer(counts, "<u4"))


def _edges(batches):
    """The stars of all keys of a partition, bucket by bucket (rows come sorted by bucket)."""

    def close(keys, ids):
        if keys:
            edges = _stars(np.concatenate(keys), np.concatenate(ids))[2]
            if len(edges):
                yield _pairs(edges)

    bucket, keys, ids = None, [], []
    for b in batches:
        for at, k, i, c, e in zip(*[b[n].to_pylist() for n in ("bucket", "keys", "ids", "counts", "edges")], strict=True):
            if e:
                yield _pairs(np.frombuffer(e, np.int64).reshape(-1, 2))
                continue
            if at != bucket:
                yield from close(keys, ids)
                bucket, keys, ids = at, [], []
            more = _unpacked(k, i, c)
            keys.append(more[0])
            ids.append(more[1])
    yield from close(keys, ids)


def _pairs(edges: np.ndarray) -> pa.RecordBatch:
    return pa.record_batch([pa.array(np.ascontiguousarray(edges[:, k])) for k in (0, 1)], ["u", "v"])


class Index:
    """Inverted lists of a block of sets."""

    def __init__(self, sets: list[np.ndarray], num: int, den: int):
        self.num, self.den, self.docs = num, den, len(sets)
        self.size = np.array([len(s) for s in sets], np.int64)
        flat, doc = np.concatenate(sets), np.repeat(np.arange(len(sets)), self.size)
        order = np.lexsort((doc, flat))
        flat, self.doc = flat[order], doc[order]
        new = np.concatenate([[True], flat[1:] != flat[:-1]])
        self.grams = flat[new]
        self.begin = np.append(np.flatnonzero(new), len(flat))
        self.posting = (np.cumsum(new) - 1) * len(sets) + self.doc  # ascending: list, then document
        self.ids, self.at = array("q", self.doc.tobytes()), self.begin.tolist()

    def required(self, a: int, b):
        return -(-self.num * (a + b) // (self.num + self.den))

    def search(self, query: np.ndarray, wanted: Callable[[int], int]) -> Iterator[int]:
        """Documents whose similarity to the query reaches num/den, ascending. wanted(doc): the least document from doc on that is still of interest; it is asked again after each result."""
        place = np.searchsorted(self.grams, query)
        place = np.minimum(place, len(self.grams) - 1)
        lists = place[self.grams[place] == query]
        n = len(query)
        least = self.required(n, -(-self.num * n // self.den))
        if len(lists) < least:
            return
        lengths = self.begin[lists + 1] - self.begin[lists]
        lists = lists[np.argsort(lengths, kind="stable")]
        long = min(least - 1, int(least / (MU * math.log2(int(lengths.max()) + 1) + 1)))
        short, long_lists = lists[: len(lists) - long], lists[len(lists) - long :] * self.docs
        for doc, times in self._merge(short, least - long, wanted):
            size = int(self.size[doc])
            need = self.required(n, size)
            if size * self.den < self.num * n or n * self.den < self.num * size or times + long < need:
                continue
            if times < need:
                probe = long_lists + doc
                where = np.minimum(np.searchsorted(self.posting, probe), len(self.posting) - 1)
                times += np.count_nonzero(self.posting[where] == probe)
            if times >= need:
                yield doc

    def _merge(self, lists: np.ndarray, threshold: int, wanted: Callable[[int], int]) -> Iterator[tuple[int, int]]:
        """Wanted documents that occur in at least threshold of the lists, and how often, ascending."""
        ids, push, pop = self.ids, heapq.heappush, heapq.heappop
        first, end = wanted(0), self.docs
        heap: list[tuple[int, int, int]] = []  # document, its place, the list's end

        def move(place: int, stop: int, to: int):
            place = bisect_left(ids, to, place, stop)
            if place < stop:
                push(heap, (ids[place], place, stop))

        for k in lists.tolist():
            move(self.at[k], self.at[k + 1], first)
        while len(heap) >= threshold:
            doc = heap[0][0]
            to = wanted(doc)
            if to >= end:
                return
            popped = []
            if to > doc:  # all lists that stand before it jump there
                while heap and heap[0][0] < to:
                    popped.append(pop(heap))
            else:
                while heap and heap[0][0] == doc:
                    popped.append(pop(heap))
                to = doc + 1
                if len(popped) >= threshold:
                    yield doc, len(popped)
                else:  # MergeSkip: drop as many as can't matter, then jump to the next possible document
                    while len(popped) < threshold - 1 and heap:
                        popped.append(pop(heap))
                    to = max(to, heap[0][0]) if heap else end
            for _, place, stop in popped:
                move(place, stop, to)


class Connected:
    """Union-find over an index's documents and one query at a time; by runs it finds the next document not connected with another."""

    def __init__(self, labels: list):
        number = {x: k for k, x in enumerate(dict.fromkeys(labels))}
        self.number, self.up = number, list(range(len(number)))
        self.of = [number[x] for x in labels]
        self.after = list(range(1, len(labels) + 1))  # all documents before after[d], from d on, are connected with d

    def add(self, label) -> int:
        if label not in self.number:
            self.number[label] = len(self.up)
            self.up.append(len(self.up))
        return self.number[label]

    def root(self, x: int) -> int:
        up = self.up
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    def join(self, a: int, b: int) -> None:
        a, b = self.root(a), self.root(b)
        self.up[max(a, b)] = min(a, b)

    def next(self, doc: int, mine: int, end: int) -> int:
        """The least document from doc on, below end, that is not connected with mine; else the number of documents."""
        mine, of, after, run = self.root(mine), self.of, self.after, []
        while doc < end and self.root(of[doc]) == mine:
            run.append(doc)
            doc = after[doc]
        for d in run:
            after[d] = doc
        return doc if doc < end else len(of)


def _search(batches, width: int, num: int, den: int):
    """Rows come sorted by (grp, slice, role): 0 indexed and asked, 1 indexed, 2 asked. label: ids of one label are connected already."""
    out: list[tuple[int, int]] = []
    key, ids, sets, labels, roles, index, same = None, [], [], [], [], None, None

    def build():
        nonlocal index, same
        index, same = Index(sets, num, den), Connected(labels)

    def ask(query, me, label, before):
        mine = same.add(label)
        for doc in index.search(query, lambda doc: same.next(doc, mine, before)):
            out.append((me, ids[doc]))
            same.join(mine, same.of[doc])

    def close():
        """Asks the rows that are both, once all are in the index."""
        if roles and roles[0] == 0:
            build()
            for k in range(1, len(ids)):
                if len(sets[k]):
                    ask(sets[k], ids[k], labels[k], k)

    for b in batches:
        flat, at = shingle_sets(*utf8_buffer(b["_text"]), width)
        for k, (grp, part, role, doc, label) in enumerate(zip(*[b[c].to_pylist() for c in ("grp", "slice", "role", "_id", "label")], strict=True)):
            if (grp, part) != key:
                close()
                key, ids, sets, labels, roles, index, same = (grp, part), [], [], [], [], None, None
            grams = flat[at[k] : at[k + 1]]
            if role == 2:
                if index is None and sets:
                    build()
                if index is not None:
                    ask(grams, doc, label, len(ids))
            else:
                ids.append(doc)
                sets.append(grams.copy())
                labels.append(label)
                roles.append(role)
        if out:
            yield pa.record_batch([pa.array([x[0] for x in out], pa.int64()), pa.array([x[1] for x in out], pa.int64())], ["u", "v"])
            out = []
    close()
    if out:
        yield pa.record_batch([pa.array([x[0] for x in out], pa.int64()), pa.array([x[1] for x in out], pa.int64())], ["u", "v"])


def jaccard_components(df: DataFrame, width: int = 5, num: int = 80, den: int = 100, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of df: doc_id, n_shingles, component_id (the smallest id reachable by links den*|both| >= num*|either|)."""
    spark = df.sparkSession
    small_batches(spark)
    docs = id_text(df, id_col, text_col)
    buckets, made = 4 * int(spark.conf.get("spark.sql.shuffle.partitions")), []  # made: tables to remove at the end
    members = stored(docs.mapInArrow(lambda it: _members(it, width), "id long, n long, head long, h1 long, h2 long"), "sets")
    # 1: equal sets and equal ids, then coarse groups
    real = members.filter(f"n > 0 and id != {NULL_ID}")
    heads = real.filter("id = head").select("id", "n", "h1", "h2").distinct()
    equal = heads.groupBy("n", "h1", "h2").agg(F.min("id").alias("first"))
    firsts = stored(heads.join(equal, ["n", "h1", "h2"]).select("id", "first", "n"), "first", made)
    several = real.groupBy("id").agg(F.min("head").alias("a"), F.max("head").alias("b")).filter("a != b").select("id")
    ties = firsts.filter("id != first").select(F.col("id").alias("u"), F.col("first").alias("v")).union(real.join(several, "id").filter("id != head").select(F.col("id").alias("u"), F.col("head").alias("v")))
    ties = stored(ties.distinct(), "ties", made)
    cells = spark.sparkContext.broadcast(rarity_cells(docs, width))
    signs = docs.mapInArrow(lambda it: _signatures(it, width, num, den, buckets, cells), "bucket int, keys binary, ids binary, counts binary, edges binary")
    stars = stored(signs.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(lambda it: _forest(_edges(it)), "u long, v long"), "stars", made)
    coarse = components(stars.union(ties), made=made)
    # 2 and 3: the search in each group of two or more different sets
    nodes = coarse.join(firsts.filter("id = first").groupBy(F.col("id").alias("node")).agg(F.sum("n").alias("n")), "node")
    sizes = nodes.groupBy("component").agg(F.sum("n").alias("total"), F.count("*").alias("sets")).filter("sets > 1").withColumn("blocks", F.ceil(F.col("total") / POSTINGS).cast("int"))
    placed = nodes.join(sizes, "component").select(F.col("component").alias("grp"), F.col("node").alias("_id"), "blocks", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int").alias("block"))
    placed = stored(docs.join(placed, "_id").select("grp", "blocks", "block", "_id", "_text"), "groups", made)

    def search(rows: DataFrame) -> DataFrame:
        dealt = rows.select("grp", "slice", "role", "_id", "label", "_text").repartition("grp", "slice").sortWithinPartitions("grp", "slice", "role", "_id")
        return stored(dealt.mapInArrow(lambda it: _search(it, width, num, den), "u long, v long"), "links", made)

    own = F.col("_id").alias("label")
    small = placed.filter("blocks = 1").select("grp", F.lit(0).alias("slice"), F.lit(0).alias("role"), "_id", own, "_text")
    large = placed.filter("blocks > 1")
    asked = large.select("grp", F.col("block").alias("slice"), F.lit(2).alias("role"), "_id", own, "_text")
    copies = large.filter("block = 0").select("grp", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("slice"), F.lit(1).alias("role"), "_id", own, "_text")
    some = not large.isEmpty()
    links = search(small.union(asked).union(copies) if some else small)
    if some:
        sofar = components(links, made=made)
        held = large.join(sofar.withColumnRenamed("node", "_id"), "_id", "left").withColumn("label", F.coalesce("component", "_id"))
        parts = held.groupBy("grp", "label").count()
        most = parts.groupBy("grp").agg(F.max_by("label", F.struct("count", "label")).alias("most"), F.count("*").alias("parts"))
        held = held.join(most.filter("parts > 1"), "grp")
        rest = held.filter("label != most").select("grp", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("slice"), F.lit(2).alias("role"), "_id", "label", "_text")
        indexed = held.select("grp", F.col("block").alias("slice"), F.lit(1).alias("role"), "_id", "label", "_text")
        if not rest.isEmpty():
            links = links.union(search(indexed.union(rest)))
    # 4: back to all rows
    final = components(links.union(ties)).withColumnRenamed("node", "head")
    for path in made:
        removed(spark, path)
    return members.join(final, "head", "left").select(real_id("id").alias("doc_id"), F.col("n").alias("n_shingles"), real_id(F.when(F.col("n") > 0, F.coalesce("component", "head")).otherwise(F.col("id"))).alias("component_id"))


def one_of_each(df: DataFrame, width: int = 5, num: int = 80, den: int = 100, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """df without the rows whose component has a smaller id; rows without id stay. All columns as they were."""
    found = jaccard_components(df, width, num, den, id_col, text_col)
    gone = found.filter("component_id < doc_id").select(F.col("doc_id").alias("_gone")).distinct()
    return df.join(gone, df[id_col].cast("long") == gone["_gone"], "left_anti")


def op2_ngram_jaccard_join(spark, sf_dir: str) -> DataFrame:
    return jaccard_components(table(spark, sf_dir, "documents"), 3, 90, 100)
