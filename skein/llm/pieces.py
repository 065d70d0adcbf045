"""SentencePiece encoding and decoding by a streaming Viterbi search.

A search keeps, for the places of a window, the best piece that ends there and where it begins. Every W characters (W: the
longest piece) the paths back from all starts that may still go on are followed; where they meet at one boundary, the ids
before it are final and leave the window. So the window spans a few pieces, whatever the text's length: it is a ring that
holds 4 W places and grows only while paths do not meet. Two kinds of model, told by the model file:

- unigram: of the pieces ending at a place the one with the largest sum of scores wins, of equal sums the longest piece.
- bpe: a segmentation is the model's if and only if no neighbouring pair would be merged otherwise, that is, if encoding
  the two pieces' text gives the two pieces. So a piece may follow another only if that holds, and for every place one
  piece at most can end there. The results are the sentencepiece library's own.

Many searches advance side by side, a character at a time, as columns of arrays. For that, long texts are dealt out in
lanes of LANE characters or more; a lane begins at a place that no piece spans (its two characters stand side by side in no
piece), where all paths meet whatever comes before and after, so the ids are those of the whole text.
Defined results: null text counts as empty (no ids); U+2581 in a text is a space to the model and comes back as one;
characters without a piece become byte pieces; other columns are not looked at. A model that changes characters or
white space before it looks for pieces, or has no byte pieces, or is of another kind, is refused.
"""

from __future__ import annotations

import hashlib
import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skein.llm.common import id_text, real_id, small_batches, table, utf8_buffer

SPACE = "▁"
#: Least characters of a lane; lanes side by side; pairs of pieces that a worker remembers at most; characters looked at at once for places to cut.
LANE, GROUP, PAIRS, LOOK = 256, 8192, 1_000_000, 1 << 19
#: Number of a piece from which on it stands for a character without a piece: code point and this.
UNKNOWN = 1 << 24


def _fields(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    """(number, value) of the fields of a protocol buffer message."""
    at = 0

    def varint():
        nonlocal at
        value = shift = 0
        while True:
            byte = data[at]
            at += 1
            value |= (byte & 127) << shift
            shift += 7
            if byte < 128:
                return value

    while at < len(data):
        key = varint()
        if key & 7 == 0:
            yield key >> 3, varint()
        else:
            size = varint() if key & 7 == 2 else 8 if key & 7 == 1 else 4
            yield key >> 3, data[at : at + size]
            at += size


def load_model(path: str | None = None) -> dict:
    """Kind, pieces and scores of a model file (read by the driver; 32,000 pieces are under 1 MB)."""
    import sentencepiece

    if path is None:
        import public_tokenizers

        path = public_tokenizers.path("piece_bpe_32k.model")
    m = sentencepiece.SentencePieceProcessor(model_file=path)
    # fixed values of the file format: the specs are fields 2 and 3, the kind is field 3 of the former and 1 unigram, 2 bpe
    specs = {number: dict(_fields(value)) for number, value in _fields(m.serialized_model_proto()) if number in (2, 3)}
    kind, rules = {1: "unigram", 2: "bpe"}.get(specs.get(2, {}).get(3, 1)), specs.get(3, {})
    n = m.get_piece_size()
    bytes_ = {int(m.id_to_piece(i)[3:5], 16): i for i in range(n) if m.is_byte(i)}
    if kind is None or rules.get(2) or not rules.get(3, 1) or rules.get(4, 1) or not rules.get(5, 1) or len(bytes_) < 256:
        raise ValueError(f"{path}: a unigram or bpe model with byte pieces and without rules on characters is needed")
    return {
        "kind": kind, "pieces": [m.id_to_piece(i) for i in range(n)], "scores": [m.get_score(i) for i in range(n)], "bytes": bytes_,
        "plain": [not (m.is_byte(i) or m.is_control(i) or m.is_unknown(i) or m.is_unused(i)) for i in range(n)],
    }


def by_rank(spec: dict) -> dict:
    """A unigram model of another model's pieces: a piece's score is the logarithm of a Zipf share by its rank among the pieces."""
    rank = sorted((i for i, plain in enumerate(spec["plain"]) if plain), key=lambda i: (-spec["scores"][i], i))
    scores = [0.0] * len(spec["pieces"])
    for k, i in enumerate(rank):
        scores[i] = float(np.float32(-math.log(k + 10)))
    return spec | {"kind": "unigram", "scores": scores}


class Table:
    """Numbers by non-negative integer keys, by open addressing in arrays."""

    def __init__(self, keys: np.ndarray, values: np.ndarray, room: int = 0):
        bits = max(4, (4 * max(len(keys), room)).bit_length())
        self.shift, self.mask, self.count = np.uint64(64 - bits), (1 << bits) - 1, 0
        self.keys, self.values = np.full(1 << bits, -1, np.int64), np.full(1 << bits, -1, np.int32)
        self.add(keys, values)

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        slot = keys.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        slot >>= self.shift
        return slot.view(np.int64)

    def add(self, keys: np.ndarray, values: np.ndarray) -> None:
        """New distinct keys."""
        keys, values, self.count = keys.astype(np.int64), values.astype(np.int32), self.count + len(keys)
        slot = self._slot(keys)
        while len(keys):
            free = self.keys[slot] < 0
            self.keys[slot[free]] = keys[free]
            here = self.keys[slot] == keys
            self.values[slot[here]] = values[here]
            keys, values, slot = keys[~here], values[~here], (slot[~here] + 1) & self.mask

    def get(self, keys: np.ndarray) -> np.ndarray:
        """Their numbers, -1 for those that aren't there."""
        slot = self._slot(keys)
        found = self.keys[slot]
        out = self.values[slot]  # -1 where the slot is empty
        todo = np.flatnonzero(found != keys)
        todo = todo[found[todo] >= 0]
        slot = slot[todo]
        out[todo] = -1
        while len(todo):
            slot = (slot + 1) & self.mask
            found = self.keys[slot]
            here = found == keys[todo]
            out[todo[here]] = self.values[slot[here]]
            on = ~here & (found >= 0)
            todo, slot = todo[on], slot[on]
        return out


class Model:
    def __init__(self, spec: dict):
        self.kind, self.names, self.scores, self.bytes = spec["kind"], spec["pieces"], spec["scores"], spec["bytes"]
        self.ids = {p: i for i, p in enumerate(self.names) if spec["plain"][i]}
        self.window = max(map(len, self.ids), default=1)
        self.least = min(self.scores, default=0.0) - 10.0
        self.score = np.array(self.scores, float)
        # characters of pieces by number, 0 for all others
        letters = {c: k + 1 for k, c in enumerate(sorted({c for p in self.ids for c in p}))}
        self.letter = np.zeros(0x110000, np.int32)
        self.letter[[ord(c) for c in letters]] = list(letters.values())
        self.letters = len(letters) + 1
        # a tree of the pieces' characters: (node, letter) to node, and the piece that ends at a node
        nodes, ends, histories = {}, [-1], {}
        for p, i in self.ids.items():
            if self.kind == "bpe":
                steps: list = []
                if self.merges(p, steps) != [p]:
                    continue  # a piece that is never made
                histories[i] = steps
            node = 0
            for c in p:
                key = node * self.letters + letters[c]
                if key not in nodes:
                    nodes[key] = len(ends)
                    ends.append(-1)
                node = nodes[key]
            ends[node] = i
        keys = np.fromiter(nodes, np.int64, len(nodes))
        # the last entry stands for no node
        self.tree, self.end = Table(keys, np.fromiter(nodes.values(), np.int64, len(nodes))), np.array([*ends, -1], np.int32)
        self.inner = np.zeros(len(ends) + 1, bool)
        self.inner[keys // self.letters] = True
        # two characters that stand side by side in no piece: nothing goes on across that place
        joined = np.array(sorted({letters[p[k]] * self.letters + letters[p[k + 1]] for p in self.ids for k in range(len(p) - 1)}), np.int64)
        self.joined = Table(joined, np.ones(len(joined)))
        if self.kind == "bpe":
            self._histories(histories)
        raw = [bytes([b]) for b in range(256)]
        text = [raw[int(p[3:5], 16)] if i in set(self.bytes.values()) else p.replace(SPACE, " ").encode() if spec["plain"][i] else b"" for i, p in enumerate(self.names)]
        self.piece_at = np.concatenate([[0], np.cumsum([len(t) for t in text])]).astype(np.int64)
        self.piece_bytes = np.frombuffer(b"".join(text), np.uint8)

    def merges(self, text: str, steps: list | None = None) -> list[str]:
        """The model's own rule on a short string: merge the best-scored neighbours, the leftmost of equals, until none is a piece. steps gets (first part, last part, the next merge's score) before every merge."""
        parts = list(text)
        while len(parts) > 1:
            best, where = None, -1
            for k in range(len(parts) - 1):
                i = self.ids.get(parts[k] + parts[k + 1])
                if i is not None and (best is None or self.scores[i] > best):
                    best, where = self.scores[i], k
            if where < 0:
                break
            if steps is not None:
                steps.append((parts[0], parts[-1], best))
            parts[where : where + 2] = [parts[where] + parts[where + 1]]
        return parts

    def name(self, number: int) -> str:
        """A piece's text; numbers under 0 are characters without a piece."""
        return self.names[number] if number >= 0 else chr(-1 - number)

    def _histories(self, histories: dict[int, list]) -> None:
        """Of every piece that is made: its first and last part before each merge that makes it, and the merges' scores; and which parts make a piece together."""
        number = {c: len(self.names) + k for k, c in enumerate(sorted({c for p in self.ids for c in p} - set(self.ids)))} | self.ids  # single characters too
        deep = max((len(h) for h in histories.values()), default=0) + 1
        self.first, self.last, self.next = (np.full((len(self.names), deep), x, t) for x, t in ((-1, np.int32), (-1, np.int32), (-np.inf, np.float64)))
        for i, steps in histories.items():
            for k, (a, b, score) in enumerate(steps):
                self.first[i, k], self.last[i, k], self.next[i, k] = number[a], number[b], score
            self.first[i, len(steps)] = self.last[i, len(steps)] = i
        together = {number[p[:k]] << 24 | number[p[k:]]: i for p, i in self.ids.items() for k in range(1, len(p)) if p[:k] in number and p[k:] in number}
        self.together = Table(np.fromiter(together, np.int64, len(together)), np.fromiter(together.values(), np.int64, len(together)))
        self.pairs = Table(np.empty(0, np.int64), np.empty(0), 1 << 12)

    def _apart(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Whether the rule on two pieces' text gives the two pieces: their merges are followed by score, the left piece's first of equals, and none of them comes after one across the border."""
        out, todo = np.ones(len(a), bool), np.arange(len(a))
        i, j = np.zeros(len(a), np.int64), np.zeros(len(a), np.int64)
        while len(todo):
            across = self.together.get(self.last[a, i].astype(np.int64) << 24 | self.first[b, j])
            left, right, score = self.next[a, i], self.next[b, j], np.where(across >= 0, self.score[across], -np.inf)
            merged = (across >= 0) & (score > left) & (score >= right)
            out[todo[merged]] = False
            on = ~merged & ((left > -np.inf) | (right > -np.inf))
            step = left >= right
            todo, a, b, i, j = todo[on], a[on], b[on], (i + step)[on], (j + ~step)[on]
        return out

    def _remember(self, keys: np.ndarray, made: np.ndarray) -> None:
        """More pairs: in a table of twice the room if this one is half full, in an empty one beyond PAIRS."""
        pairs = self.pairs
        if pairs.count + len(keys) > PAIRS:
            pairs = self.pairs = Table(np.empty(0, np.int64), np.empty(0), len(keys))
        elif 2 * (pairs.count + len(keys)) > pairs.mask:
            old = pairs.keys >= 0
            pairs = self.pairs = Table(pairs.keys[old], pairs.values[old], 2 * (pairs.count + len(keys)))
        pairs.add(keys, made)

    def possible(self, before: np.ndarray, number: np.ndarray) -> np.ndarray:
        """Whether a bpe model would leave the pieces side by side, each with the one before (-1: nothing is before)."""
        ok = np.ones(len(number), bool)
        both = np.flatnonzero((number < UNKNOWN) & (before >= 0) & (before < UNKNOWN))
        keys = before[both].astype(np.int64) << 24 | number[both]
        found = self.pairs.get(keys)
        if (new := found < 0).any():
            fresh = np.unique(keys[new])
            made = self._apart(fresh >> 24, fresh & UNKNOWN - 1)
            self._remember(fresh, made)
            found[new] = made[np.searchsorted(fresh, keys[new])]
        ok[both] = found > 0
        return ok

    def viterbi(self, text: str | Iterator[str]) -> Iterator[int]:
        """The numbers of a text's pieces, each as soon as it is final; a character without a piece is -1 less its code point."""
        search, i = Search(self, 1), 0

        def final(end: bool):
            _, _, pieces = search.commit(np.array([i]) if end else None)
            return [n if n < UNKNOWN else UNKNOWN - 1 - n for n in pieces[::-1].tolist()]

        for c in text:
            search.step(np.array([ord(c)], np.int32))
            i += 1
            if i % self.window == 0:
                yield from final(False)
        yield from final(True)

    def _lanes(self, codes: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where lanes begin, and their texts."""
        long = np.flatnonzero(np.diff(at) > 2 * LANE)
        begins, texts = [at[:-1]], [np.arange(len(at) - 1)]
        if len(long):
            letter, cuts = self.letter[codes], []
            for a in range(0, len(codes) - 1, LOOK):
                part = letter[a : a + LOOK + 1]
                cuts.append(a + 1 + np.flatnonzero(self.joined.get(part[:-1].astype(np.int64) * self.letters + part[1:]) < 0))
            cuts = np.concatenate(cuts)
            for k in long.tolist():
                own, place = [], int(at[k])
                mine = cuts[np.searchsorted(cuts, place) : np.searchsorted(cuts, at[k + 1])]
                while (j := int(np.searchsorted(mine, place + LANE))) < len(mine):
                    place = int(mine[j])
                    own.append(place)
                begins.append(np.array(own, np.int64))
                texts.append(np.full(len(own), k))
        begin, text = np.concatenate(begins), np.concatenate(texts)
        order = np.lexsort((begin, text))
        return begin[order], text[order]

    def _search(self, codes: np.ndarray, begin: np.ndarray, end: np.ndarray, out: np.ndarray) -> "Search":
        """Puts the numbers of the lanes' pieces (the longest lane first) where they end."""
        search, size = Search(self, len(begin)), end - begin
        alive = len(size) - np.searchsorted(size[::-1], np.arange(size[0]), "right")
        for t, m in enumerate(alive.tolist()):
            search.step(codes[begin[:m] + t])
            if (t + 1) % self.window == 0 or t + 1 == len(alive):
                lanes, places, pieces = search.commit(size)
                out[begin[lanes] + places] = pieces
        return search

    def encode(self, texts: pa.Array, counts: list | None = None) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the texts, flat, and the n+1 offsets. counts gets each text's number of commits and the widest window."""
        raw = [t or "" for t in texts.to_pylist()]
        at = np.concatenate([[0], np.cumsum([len(t) + 1 if t else 0 for t in raw])]).astype(np.int64)
        codes = np.frombuffer("".join([SPACE + t for t in raw if t]).replace(" ", SPACE).encode("utf-32-le"), np.int32)
        begin, text = self._lanes(codes, at)
        end = np.append(begin[1:], len(codes))
        order = np.argsort(begin - end, kind="stable")
        out, commits, widest = np.full(len(codes) + 1, -1, np.int32), np.zeros(len(begin), np.int64), np.zeros(len(begin), np.int64)
        for a in range(0, len(order), GROUP):
            own = order[a : a + GROUP]
            search = self._search(codes, begin[own], end[own], out)
            commits[own], widest[own] = search.commits, search.widest
        if counts is not None:
            counts += [np.bincount(text, weights=commits, minlength=len(raw)).astype(np.int64), np.zeros(len(raw), np.int64)]
            np.maximum.at(counts[1], text, widest)
        # places of the ids' ends, and bytes for characters without a piece
        place = np.flatnonzero(out >= 0)
        ids = out[place]
        if (odd := ids >= UNKNOWN).any():
            made = [[self.bytes[b] for b in chr(c).encode()] for c in (ids[odd] - UNKNOWN).tolist()]
            n = np.ones(len(ids), np.int64)
            n[odd] = [len(x) for x in made]
            place, spread = np.repeat(place, n), np.repeat(~odd, n)
            flat = np.empty(len(place), np.int32)
            flat[spread], flat[~spread] = ids[~odd], [b for x in made for b in x]
            ids = flat
        return ids, np.searchsorted(place, at, "right")

    def decode(self, ids: np.ndarray, at: np.ndarray) -> list[bytes]:
        """The texts' bytes: the pieces' bytes one after another, without the space put first."""
        n = (self.piece_at[1:] - self.piece_at[:-1])[ids]
        ends = np.concatenate([[0], np.cumsum(n)])
        data = self.piece_bytes[np.arange(ends[-1]) + np.repeat(self.piece_at[ids] - ends[:-1], n)].tobytes()
        out = [data[ends[a] : ends[b]] for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]
        return [t[1:] if t[:1] == b" " else t for t in out]


class Search:
    """Viterbi searches side by side. Lane k ends no later than lane k - 1; step() takes a character of each that goes on."""

    def __init__(self, model: Model, lanes: int):
        self.model, self.at, self.room = model, 0, 1 << (4 * model.window - 1).bit_length()
        # of each place of the windows: length and number of the piece that ends there (length 0: none does), sum of scores
        self.length, self.piece = np.zeros((self.room, lanes), np.int32), np.full((self.room, lanes), -1, np.int32)
        self.total = np.zeros((self.room, lanes)) if model.kind == "unigram" else None
        self.row, self.start, self.node = np.empty(0, np.int64), np.empty(0, np.int32), np.empty(0, np.int64)  # starts that may go on, the latest first; node times letters
        self.reached = np.ones(lanes, bool)  # whether a piece ends at the present place
        self.done, self.ended = np.zeros(lanes, np.int64), np.zeros(lanes, bool)
        self.commits, self.widest = np.zeros(lanes, np.int64), np.zeros(lanes, np.int64)

    def step(self, codes: np.ndarray) -> None:
        model, t, m, mask = self.model, self.at, len(codes), self.room - 1
        fresh = np.flatnonzero(self.reached[:m])
        stay = slice(None) if m == len(self.reached) else self.row < m
        row = np.concatenate([fresh, self.row[stay]])
        start = np.concatenate([np.full(len(fresh), t, np.int32), self.start[stay]])
        key = model.letter[codes][row].astype(np.int64)
        key[len(fresh) :] += self.node[stay]
        node = model.tree.get(key)
        piece = model.end[node]  # of node -1 the last
        alone = np.flatnonzero(piece[: len(fresh)] < 0)
        piece[alone] = UNKNOWN + codes[fresh[alone]]
        self.at, slot = t + 1, t + 1 & mask
        self.length[slot, :m] = 0
        found = np.flatnonzero(piece >= 0)
        r, s, p = row[found], start[found], piece[found]
        if self.total is None:
            ok = model.possible(self.piece[s & mask, r], p)
        else:
            total = self.total[s & mask, r] + np.where(p < UNKNOWN, model.score[np.minimum(p, len(model.score) - 1)], model.least)
            best = np.full(m, -np.inf)
            np.maximum.at(best, r, total)
            ok = total == best[r]
            self.total[slot, :m] = best
        r = r[ok]
        self.length[slot, r], self.piece[slot, r] = t + 1 - s[ok], p[ok]  # of equal ones the last, that is the longest
        self.reached = self.length[slot, :m] > 0
        on = np.flatnonzero(model.inner[node])
        self.row, self.start, self.node = row[on], start[on], node[on] * np.int64(model.letters)

    def commit(self, size: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(lanes, places, pieces that end there) that have become final, the last ones of a lane first: up to where all paths meet, or to the end of lanes (size: where lanes end)."""
        t, mask = self.at, self.room - 1
        lanes = len(self.done)
        over = size <= t if size is not None else np.zeros(lanes, bool)
        meet = np.where(over & ~self.ended, size if size is not None else 0, self.done)
        going = np.flatnonzero(~over)
        window = np.where(over, 0, t - self.done)
        np.maximum(self.widest, window, out=self.widest)
        # the starts that go on, as bits by their distance from the present place
        alive = np.zeros(lanes, np.uint64)
        back = t - self.start
        near = back < 64
        np.bitwise_or.at(alive, self.row[near], np.uint64(1) << back[near].astype(np.uint64))
        alive[: len(self.reached)] |= self.reached.astype(np.uint64)
        alive[self.row[~near]] = 0
        todo = going[alive[going] > 0]
        while len(todo):
            bits = alive[todo]
            last = bits & (~bits + np.uint64(1))
            k = np.log2(last.astype(float)).astype(np.int64)
            single = bits == last
            meet[todo[single]] = t - k[single]
            todo, bits, last, k = todo[~single], bits[~single], last[~single], k[~single]
            k += self.length[t - k & mask, todo]
            inside = k < 64
            todo = todo[inside]
            alive[todo] = bits[inside] ^ last[inside] | np.uint64(1) << k[inside].astype(np.uint64)
        self.commits += meet > self.done
        rows, places, pieces = [], [], []
        lane, place = np.flatnonzero(meet > self.done), meet[meet > self.done]
        while len(lane):
            rows.append(lane)
            places.append(place)
            pieces.append(self.piece[place & mask, lane])
            place = place - self.length[place & mask, lane]
            on = place > self.done[lane]
            lane, place = lane[on], place[on]
        self.done, self.ended = np.maximum(self.done, meet), over
        if len(going) and t + self.model.window - int(self.done[going].min()) >= self.room:
            self._grow()
        none = [np.empty(0, np.int64)]
        return np.concatenate(rows or none), np.concatenate(places or none), np.concatenate(pieces or none)

    def _grow(self) -> None:
        """Twice the room, every place where it belongs then."""
        old, self.room = self.room, 2 * self.room
        places = np.arange(max(0, self.at - old + 1), self.at + 1)
        for name in ("length", "piece", "total"):
            if (was := getattr(self, name)) is not None:
                wide = np.zeros((self.room, was.shape[1]), was.dtype)
                wide[places & self.room - 1] = was[places & old - 1]
                setattr(self, name, wide)


_MODELS: dict[int, Model] = {}


def _model(broadcast) -> Model:
    key = broadcast.value["key"]
    if key not in _MODELS:
        _MODELS.clear()
        _MODELS[key] = Model(broadcast.value)
    return _MODELS[key]


def _encode(batches: Iterator[pa.RecordBatch], spec) -> Iterator[pa.RecordBatch]:
    for b in batches:
        model = _model(spec)
        ids, at = model.encode(b["_text"])
        parts = [ids[x:y].astype("<u4").tobytes() for x, y in zip(at[:-1], at[1:], strict=True)]
        yield pa.record_batch([b["_id"], pa.array(np.diff(at)), pa.array(parts, pa.binary())], ["doc_id", "n_ids", "ids"])


def _decode(batches: Iterator[pa.RecordBatch], spec) -> Iterator[pa.RecordBatch]:
    for b in batches:
        ids = [np.frombuffer(x, "<u4") for x in b["ids"].to_pylist()]
        at = np.concatenate([[0], np.cumsum([len(x) for x in ids])]).astype(np.int64)
        texts = _model(spec).decode(np.concatenate(ids).astype(np.int64) if ids else np.empty(0, np.int64), at)
        yield pa.record_batch([b["doc_id"], b["n_ids"], b["ids"], pa.array([t.decode("utf-8", "replace") for t in texts], pa.string())], ["doc_id", "n_ids", "ids", "text"])


def shared_model(spark, path: str | None = None, change=None):
    spec = load_model(path)
    spec = change(spec) if change else spec
    return spark.sparkContext.broadcast(spec | {"key": zlib.crc32(repr(spec).encode())})


def encode(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", model: str | None = None) -> DataFrame:
    """doc_id, n_ids, ids (little-endian unsigned 32-bit integers) of every row."""
    small_batches(df.sparkSession)
    spec = shared_model(df.sparkSession, model)
    return id_text(df, id_col, text_col).mapInArrow(lambda it: _encode(it, spec), "doc_id long, n_ids long, ids binary").withColumn("doc_id", real_id("doc_id"))


def decode(encoded: DataFrame, model: str | None = None) -> DataFrame:
    """Adds text to the rows of encode()."""
    small_batches(encoded.sparkSession)
    spec = shared_model(encoded.sparkSession, model)
    return encoded.select("doc_id", "n_ids", "ids").mapInArrow(lambda it: _decode(it, spec), "doc_id long, n_ids long, ids binary, text string")


def _round(batches: Iterator[pa.RecordBatch], spec) -> Iterator[pa.RecordBatch]:
    for b in batches:
        model, counts = _model(spec), []
        ids, at = model.encode(b["_text"], counts)
        crc = [zlib.crc32(ids[x:y].astype("<u4").tobytes()) for x, y in zip(at[:-1], at[1:], strict=True)]
        back = model.decode(ids, at)
        data, offsets = utf8_buffer(b["_text"])
        raw, mark = data.tobytes(), SPACE.encode()
        same = [t == raw[x:y].replace(mark, b" ") for t, x, y in zip(back, offsets[:-1], offsets[1:], strict=True)]
        yield pa.record_batch(
            [b["_id"], pa.array(np.diff(at)), pa.array(crc, pa.int64()), pa.array([hashlib.sha256(t).hexdigest() for t in back]), pa.array(same), pa.array(counts[0]), pa.array(counts[1])],
            ["doc_id", "n_ids", "ids_crc32", "decoded_sha256", "round_trip", "commits", "widest"],
        )


def round_trip(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", model: str | None = None, change=None) -> DataFrame:
    """Per row: doc_id, n_ids, ids_crc32, decoded_sha256, whether decoding gave the text back, how often ids became final, and the most characters that were held till then; encoded and decoded in one pass. change: makes another model of the file's."""
    small_batches(df.sparkSession)
    spec = shared_model(df.sparkSession, model, change)
    out = id_text(df, id_col, text_col).mapInArrow(lambda it: _round(it, spec), "doc_id long, n_ids long, ids_crc32 long, decoded_sha256 string, round_trip boolean, commits long, widest long")
    return out.withColumn("doc_id", real_id("doc_id"))


def op7_sentencepiece(spark, sf_dir: str) -> DataFrame:
    return round_trip(table(spark, sf_dir, "documents"))


def sentencepiece_unigram(spark, sf_dir: str) -> DataFrame:
    """The same for a unigram model: the public pieces with scores by rank."""
    return round_trip(table(spark, sf_dir, "documents"), change=by_rank)
