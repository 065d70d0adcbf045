"""Differences between two contents, as piece tables: the new content is a row of spans of the old one, of bytes that the
difference itself holds, and of other blobs named by their hash. Edits cut and join spans and never copy the old content.

difference() finds common runs by blocks: the old content's aligned blocks of BLOCK bytes are known by a rolling hash, which
is computed for all windows of the new content at once; a window that is a known block is compared byte by byte and
extended both ways. Every run of 2 * BLOCK - 1 bytes holds an aligned block, so none of those is missed where it goes on
from its first place in the old content. Time and memory grow in proportion to the contents.
"""

from __future__ import annotations

import struct
from bisect import bisect_right
from collections.abc import Callable
from itertools import accumulate

import numpy as np
import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Bytes of a block, and of one in contents of under SHORT bytes.
BLOCK, SMALL, SHORT = 16, 8, 4096
#: Sources of spans: the old content, the difference's own bytes, and from here on the blobs.
OLD, OWN, BLOBS = 0, 1, 2
_FACTOR = 0x9E3779B97F4A7C15
_HEAD, _SPAN = struct.Struct("<4sIIQ"), struct.Struct("<IQQ")
_NAME = b"PT01"


class Diff:
    """spans: (source, start, stop); own: the bytes held; blobs: names of the sources from BLOBS on."""

    def __init__(self, spans: list[tuple[int, int, int]], own: bytes = b"", blobs: list[str] | None = None):
        self.spans, self.own, self.blobs = [s for s in spans if s[1] < s[2]], bytearray(own), list(blobs or [])

    @classmethod
    def unchanged(cls, size: int) -> Diff:
        return cls([(OLD, 0, size)])

    def __len__(self) -> int:
        return sum(stop - start for _, start, stop in self.spans)

    def _between(self, start: int, stop: int) -> list[tuple[int, int, int]]:
        ends = list(accumulate(b - a for _, a, b in self.spans))
        out = []
        for k in range(bisect_right(ends, start), len(ends)):
            source, a, b = self.spans[k]
            begin = ends[k] - (b - a)
            if begin >= stop:
                break
            out.append((source, a + max(0, start - begin), b - max(0, ends[k] - stop)))
        return out

    def _put(self, start: int, count: int, middle: list[tuple[int, int, int]]) -> None:
        size = len(self)
        if start > size:  # a gap is filled with zero bytes
            middle, start, count = [*self._held(bytes(start - size)), *middle], size, 0
        joined: list[tuple[int, int, int]] = []
        for source, a, b in [*self._between(0, start), *middle, *self._between(min(start + count, size), size)]:
            if joined and joined[-1][0] == source and joined[-1][2] == a:
                joined[-1] = (source, joined[-1][1], b)
            elif a < b:
                joined.append((source, a, b))
        self.spans = joined

    def _held(self, content: bytes) -> list[tuple[int, int, int]]:
        at = len(self.own)
        self.own += content
        return [(OWN, at, at + len(content))]

    def splice(self, start: int, count: int, content: bytes = b"") -> None:
        """count bytes at a place are taken away, content comes there."""
        self._put(start, count, self._held(content))

    def set(self, start: int, content: bytes) -> None:
        self.splice(start, len(content), content)

    def insert_blob(self, start: int, name: str, size: int) -> None:
        """A whole blob of so many bytes comes at a place, by name only."""
        if name not in self.blobs:
            self.blobs.append(name)
        self._put(start, 0, [(BLOBS + self.blobs.index(name), 0, size)])

    def byte(self, at: int, old: bytes, fetch: Callable[[str], bytes] | None = None) -> int:
        part = Diff(self._between(at, at + 1), self.own, self.blobs).content(old, fetch)
        if not part:
            raise IndexError(at)
        return part[0]

    def set_byte(self, at: int, value: int) -> None:
        self.set(at, bytes([value]))

    def content(self, old: bytes, fetch: Callable[[str], bytes] | None = None) -> bytes:
        """The new content; fetch gives blobs by name."""
        sources = [old, bytes(self.own), *([fetch(name) for name in self.blobs] if fetch else [])]
        return b"".join(sources[source][a:b] for source, a, b in self.spans)

    def pack(self) -> bytes:
        """As bytes: head, spans, length and name of each blob, own bytes."""
        names = b"".join(struct.pack("<H", len(n.encode())) + n.encode() for n in self.blobs)
        return _HEAD.pack(_NAME, len(self.spans), len(self.blobs), len(self.own)) + b"".join(_SPAN.pack(*s) for s in self.spans) + names + bytes(self.own)

    @classmethod
    def unpack(cls, data: bytes) -> Diff:
        if not data:
            return cls([])
        name, spans, blobs, own = _HEAD.unpack_from(data)
        if name != _NAME:
            raise ValueError("no difference")
        at, names = _HEAD.size + spans * _SPAN.size, []
        made = [_SPAN.unpack_from(data, _HEAD.size + k * _SPAN.size) for k in range(spans)]
        for _ in range(blobs):
            (n,) = struct.unpack_from("<H", data, at)
            names.append(data[at + 2 : at + 2 + n].decode())
            at += 2 + n
        return cls(made, data[at : at + own], names)

    def __str__(self) -> str:
        name = lambda s: "old" if s == OLD else "own" if s == OWN else f"blob {self.blobs[s - BLOBS]}"
        return ", ".join(f"{name(s)} {a}:{b}" for s, a, b in self.spans)


def _windows(data: np.ndarray, block: int) -> np.ndarray:
    """A hash of every window of a block's size: sums of bytes times powers of an odd factor, brought to a common power; all modulo 2 to the 64."""
    n = len(data) - block + 1
    powers = np.full(len(data), _FACTOR, np.uint64)
    powers[0] = 1
    back = np.full(n, pow(_FACTOR, -1, 1 << 64), np.uint64)
    back[0] = 1
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(data * np.cumprod(powers))])
    return (sums[block:] - sums[:-block]) * np.cumprod(back)


def _common(a: memoryview, b: memoryview) -> int:
    """Bytes that two contents begin with alike."""
    n, step = 0, 64
    most = min(len(a), len(b))
    while n < most:
        x, y = a[n : n + step], b[n : n + step]
        size = min(len(x), len(y))
        if x[:size] != y[:size]:
            return n + int(np.argmax(np.frombuffer(x[:size], np.uint8) != np.frombuffer(y[:size], np.uint8)))
        n, step = n + size, min(2 * step, 1 << 20)
    return n


def difference(old: bytes, new: bytes) -> Diff:
    made, block = Diff([]), BLOCK if len(old) >= SHORT else SMALL
    if len(old) < block or len(new) < block:
        made.splice(0, 0, new)
        return made
    a, b = memoryview(old), memoryview(new)
    back_a, back_b = memoryview(old[::-1]), memoryview(new[::-1])
    blocks = _windows(np.frombuffer(old, np.uint8).astype(np.uint64), block)[::block]
    known, first = np.unique(blocks, return_index=True)
    seen = _windows(np.frombuffer(new, np.uint8).astype(np.uint64), block)
    place = np.minimum(np.searchsorted(known, seen), len(known) - 1)
    hits = np.flatnonzero(known[place] == seen)
    sources = first[place[hits]] * block
    spans, own, done, k = [], [], 0, 0
    while k < len(hits):
        i, j = int(hits[k]), int(sources[k])
        if spans and spans[-1] and (follow := spans[-1][2] + i - done) + block <= len(old) and i - done < block and a[follow : follow + block] == b[i : i + block]:
            j = follow  # the run before goes on beyond a small change
        if a[j : j + block] != b[i : i + block]:
            k += 1
            continue
        before = _common(back_a[len(old) - j : len(old) - j + i - done], back_b[len(new) - i : len(new) - done])
        after = _common(a[j:], b[i:])
        if i - before > done:
            own.append((len(spans), done, i - before))
            spans.append(None)
        spans.append((OLD, j - before, j + after))
        done = i + after
        k = int(np.searchsorted(hits, done))
    if done < len(new):
        own.append((len(spans), done, len(new)))
        spans.append(None)
    for k, start, stop in own:
        spans[k] = made._held(new[start:stop])[0]
    made.spans = spans
    return made


@F.pandas_udf(T.BinaryType())
def create_diff(old: pd.Series, new: pd.Series) -> pd.Series:
    return pd.Series([difference(bytes(a or b""), bytes(b or b"")).pack() for a, b in zip(old, new, strict=True)])


@F.pandas_udf(T.BinaryType())
def patch(old: pd.Series, diff: pd.Series) -> pd.Series:
    return pd.Series([Diff.unpack(bytes(d or b"")).content(bytes(a or b"")) for a, d in zip(old, diff, strict=True)])
