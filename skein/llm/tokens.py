"""Ids of whole texts by the tokenizers library, with what it said of a word kept for the next time.

word_bpe_49k drops white space and never joins bytes across it, so a text's ids are its words' ids in order. A word of
letters followed by ASCII punctuation is two pieces for its pre-tokenizer, so both are looked up by themselves, in ASCII
lower case. Every distinct piece is encoded by the library, once as long as the bounded memory of a worker lasts.
"""

from __future__ import annotations

import os
import unicodedata

import numpy as np
import pyarrow as pa
from pyspark.sql import SparkSession

from skein.llm.common import utf8_buffer

#: Words and pieces that a worker remembers at most; beyond, it forgets them all and starts again.
WORDS, PIECES = 450_000, 350_000
END_ID = 1

_TAIL = b".,!?%&*#$|;:"
_ENCODERS: dict[int, "Encoder"] = {}
_VERIFIED: set[str] = set()


def tokenizer_path(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


#: Texts on which a tokenizer's ids and those made here are compared before it is used.
PROBES = ["The QUICK brown-fox, jumped... (over) it's 42,000 dogs!", "  tabs\tand\nlines\r\n  ", "Größe naïve œuvre ÉTÉ \u212b \u0130x", "日本語 テスト 中文。", "a<|endoftext|>b <|startoftext|>", "x_y|z;:*&#$% ##% 1st 2nd", "🙂👍🏽 e\u0301 \u00a0 \u3000 \u200b end", "don't DON'T we'll", ""]


def shared_tokenizer(spark: SparkSession, path: str | None = None):
    """The tokenizer's file, read by the driver and broadcast (under 2 MB), so executors need no local copy. A file whose ids for PROBES aren't those of the rules used here is refused."""
    with open(path or tokenizer_path(), encoding="utf-8") as f:
        spec = f.read()
    if spec not in _VERIFIED:
        made = Encoder(spec)
        ids, at = made.encode(pa.array(PROBES), None)
        if any(ids[a:b].tolist() != made.tokenizer.encode(t, add_special_tokens=False).ids for t, a, b in zip(PROBES, at[:-1], at[1:], strict=True)):
            raise ValueError(f"{path}: not a tokenizer of lower-case words with word ends")
        _VERIFIED.add(spec)
    return spark.sparkContext.broadcast(spec)


def _letters(text: str) -> bool:
    """Letters only, also as the tokenizer's normalizers leave them (some letters fall into a letter and a mark)."""
    return text.isalpha() if text.isascii() else unicodedata.normalize("NFC", text).lower().isalpha()


class _Numbered(dict):
    """Gives each new key the next number and remembers it as new."""

    def __init__(self):
        self.new: list[bytes] = []

    def __missing__(self, key):
        self[key] = n = len(self)
        self.new.append(key)
        return n


class Encoder:
    def __init__(self, spec: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_str(spec)
        vocabulary = self.tokenizer.get_vocab()
        self.word_end = np.zeros(max(vocabulary.values()) + 1, bool)
        self.word_end[[i for t, i in vocabulary.items() if t.endswith("</w>")]] = True
        self._forget()

    def _forget(self):
        self.words, self.pieces = _Numbered(), _Numbered()
        self.first, self.second = np.empty(1 << 16, np.int32), np.empty(1 << 16, np.int32)  # the pieces of each word
        self.flat, self.size = np.empty(1 << 16, np.uint32), 0  # the ids of all pieces, one after another
        self.at, self.count = np.empty(1 << 16, np.int64), np.empty(1 << 16, np.int32)
        self.pieces[b""]
        self._learn()

    def _library(self, pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all pieces, flat, and their counts. Pieces of letters go to the library in lines of many: each ends with its only id of a word end."""
        parts, counts, line = [], [], []

        def flush():
            ids = np.array(self.tokenizer.encode_batch_fast([" ".join(line)], add_special_tokens=False)[0].ids, np.uint32)
            ends = np.flatnonzero(self.word_end[ids]) + 1
            if len(ends) == len(line):
                parts.append(ids)
                counts.extend(np.diff(ends, prepend=0).tolist())
            else:
                one_by_one(line)
            line.clear()

        def one_by_one(texts):
            for got in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False):
                parts.append(np.array(got.ids, np.uint32))
                counts.append(len(got.ids))

        for piece in pieces:
            text = piece.decode()
            if _letters(text):
                line.append(text)
                if len(line) == 1000:
                    flush()
            else:
                if line:
                    flush()
                one_by_one([text])
        if line:
            flush()
        return np.concatenate(parts) if parts else np.empty(0, np.uint32), np.array(counts, np.int32)

    def _learn(self):
        new, self.words.new = self.words.new, []
        number, first, second = self.pieces.__getitem__, [], []
        for w in new:
            core = w.rstrip(_TAIL)
            if len(core) == len(w) or not core or not (core.isalpha() or _letters(core.decode())):
                first.append(number(w if b"<|" in w else w.lower()))
                second.append(0)
            else:
                first.append(number(core.lower()))
                second.append(number(w[len(core) :]))
        n = len(self.words)
        while n > len(self.first):
            self.first, self.second = np.concatenate([self.first, self.first]), np.concatenate([self.second, self.second])
        self.first[n - len(new) : n], self.second[n - len(new) : n] = first, second
        wanted, self.pieces.new = self.pieces.new, []
        ids, counts = self._library(wanted)
        n = len(self.pieces)
        while n > len(self.at):
            self.at, self.count = np.concatenate([self.at, self.at]), np.concatenate([self.count, self.count])
        self.count[n - len(wanted) : n] = counts
        self.at[n - len(wanted) : n] = self.size + np.cumsum(counts) - counts
        while self.size + len(ids) > len(self.flat):
            self.flat = np.concatenate([self.flat, self.flat])
        self.flat[self.size : self.size + len(ids)] = ids
        self.size += len(ids)

    def encode(self, texts: pa.Array, end_id: int | None = END_ID) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the texts, flat, and the n+1 offsets; each text's ids end with end_id."""
        data, offsets = utf8_buffer(texts)
        raw, number, counts, parts = data.tobytes(), self.words.__getitem__, [], []
        for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True):
            words = raw[a:b].split()
            counts.append(len(words))
            parts.append(np.fromiter(map(number, words), np.int32, len(words)))
        word = np.concatenate(parts) if parts else np.empty(0, np.int32)
        if self.words.new:
            self._learn()
        piece = np.stack([self.first[word], self.second[word]], axis=1).reshape(-1)
        n = self.count[piece].astype(np.int64)
        ends = np.concatenate([[0], np.cumsum(n)])
        place = np.arange(ends[-1]) + np.repeat(self.at[piece] - ends[:-1], n)
        ids = self.flat[place]
        at = ends[2 * np.concatenate([[0], np.cumsum(counts)]).astype(np.int64)]
        if len(self.words) > WORDS or len(self.pieces) > PIECES:
            self._forget()
        if end_id is None:
            return ids, at
        more = np.arange(len(at))
        out = np.empty(len(ids) + len(counts), np.uint32)
        there = np.ones(len(out), bool)
        there[at[1:] + more[:-1]] = False
        out[there] = ids
        out[~there] = end_id
        return out, at + more


def encoder(broadcast) -> Encoder:
    """The worker's encoder for a broadcast tokenizer; it lives as long as the worker."""
    spec = broadcast.value
    key = hash(spec)
    if key not in _ENCODERS:
        _ENCODERS.clear()
        _ENCODERS[key] = Encoder(spec)
    return _ENCODERS[key]
