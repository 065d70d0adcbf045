import zlib

import numpy as np
import public_tokenizers
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st

from skein.llm import pieces
from skein.llm.common import table

LIBRARY = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
SPEC = pieces.load_model()
MODEL = pieces.Model(SPEC)
WORDS = ["the", "tion", "er", "ing", "straße", "œuvre", "été", "aaaa", "    ", " ", "\n", "\t", "▁", "🙂", "xyz", "123", "();\r", "\x00", "ﬁ", "über", "こん", "A", "b", "'s", "<0x41>", "</s>"]


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from(WORDS) | st.text(max_size=4), max_size=12))
def test_equals_the_library(parts):
    import pyarrow as pa

    text = "".join(parts)
    ids, at = MODEL.encode(pa.array([text, None, "", text]))
    assert ids[: at[1]].tolist() == LIBRARY.encode(text) == ids[at[3] :].tolist() and at[1] == at[2] == at[3]
    assert MODEL.decode(ids, at)[0].decode() == text.replace("▁", " ")


@settings(max_examples=60, deadline=None)
@given(st.text(alphabet="abcd", min_size=1, max_size=60), st.integers(0, 99))
def test_unigram_is_the_best_path_and_streams(text, seed):
    rng = np.random.default_rng(seed)
    names = list({"".join(rng.choice(list("abcd"), size=rng.integers(1, 5))) for _ in range(12)} | set("abcd"))
    model = pieces.Model({"kind": "unigram", "pieces": names, "scores": rng.uniform(-9, -1, len(names)).tolist(), "bytes": {}, "plain": [True] * len(names)})
    got = [model.name(i) for i in model.viterbi(iter(text))]
    best = [0.0] + [-1e18] * len(text)
    for i in range(1, len(text) + 1):
        for p, s in zip(names, model.scores, strict=True):
            if text[:i].endswith(p):
                best[i] = max(best[i], best[i - len(p)] + s)
    assert "".join(got) == text and abs(sum(model.scores[names.index(p)] for p in got) - best[-1]) < 1e-6


def test_ids_come_before_the_text_ends():
    taken = []

    def letters():
        for c in SPACE_TEXT:
            taken.append(c)
            yield c

    SPACE_TEXT = ("▁the▁nation▁oferson" * 200)
    next(MODEL.viterbi(letters()))
    assert len(taken) < 10 * MODEL.window


def test_op7_on_whole_documents(spark, sf):
    want = {r.doc_id: LIBRARY.encode(r.text or "") for r in table(spark, sf, "documents").select("doc_id", "text").collect()}
    got = pieces.op7_sentencepiece(spark, sf).collect()
    assert len(got) == len(want) and all(r.round_trip for r in got)
    assert all((r.n_ids, r.ids_crc32) == (len(w := want[r.doc_id]), zlib.crc32(np.array(w, "<u4").tobytes())) for r in got)


def test_odd_rows(odd_docs, no_docs):
    got = pieces.decode(pieces.encode(odd_docs)).collect()
    key = lambda p: (p[0] is not None, p[0] or 0, p[1])
    assert sorted(((r.doc_id, r.text) for r in got), key=key) == sorted(((r.doc_id, r.text or "") for r in odd_docs.collect()), key=key)
    assert pieces.round_trip(no_docs).count() == 0


def as_unigram(kind=1):
    """The library with the public file's pieces as a unigram model with scores by rank: kind and scores are changed in the file's bytes."""
    data, at, out = LIBRARY.serialized_model_proto(), 0, []
    scores = iter(pieces.by_rank(SPEC)["scores"])

    def size(at):
        value = shift = 0
        while True:
            byte, at = data[at], at + 1
            value, shift = value | (byte & 127) << shift, shift + 7
            if byte < 128:
                return value, at

    while at < len(data):
        field, begin = data[at] >> 3, at
        n, at = size(at + 1)
        part = bytearray(data[at : at + n])
        if field == 1:  # a piece: its score is four bytes after the tag of field 2
            k = 2 + part[1]
            assert part[k] == 0x15
            part[k + 1 : k + 5] = np.float32(next(scores)).tobytes()
        if field == 2:  # the trainer's spec: field 3 is the kind
            k = 0
            while part[k] >> 3 != 3:
                k = k + 2 + part[k + 1] if part[k] & 7 == 2 else k + 2
            assert part[k : k + 2] == b"\x18\x02"
            part[k + 1] = kind
        out.append(data[begin:at] + bytes(part))
        at += n
    proto = b"".join(out)
    return sentencepiece.SentencePieceProcessor(model_proto=proto) if kind == 1 else proto


def best_path(model, text):
    """Plain Viterbi over a whole text; the best sum and the numbers of pieces."""
    text = "▁" + text.replace(" ", "▁")
    best = [(0.0, None, 0)] + [None] * len(text)
    for i in range(1, len(text) + 1):
        for j in range(max(0, i - model.window), i):
            number = model.ids.get(text[j:i], -1 - ord(text[j]) if i - j == 1 else None)
            if number is not None:
                total = best[j][0] + (model.scores[number] if number >= 0 else model.least)
                if best[i] is None or total > best[i][0]:
                    best[i] = (total, number, j)
    out, i = [], len(text)
    while i:
        out.append(best[i][1])
        i = best[i][2]
    return best[-1][0], out[::-1]


def test_the_unigram_query_equals_a_plain_search_and_the_library(spark, sf):
    docs = {r.doc_id: r.text or "" for r in table(spark, sf, "documents").select("doc_id", "text").collect()}
    model, library = pieces.Model(pieces.by_rank(SPEC)), as_unigram()
    got = {r.doc_id: r for r in pieces.sentencepiece_unigram(spark, sf).collect()}
    assert got.keys() == docs.keys() and all(r.round_trip for r in got.values())
    equal = 0
    for k, (doc, text) in enumerate(docs.items()):
        ids = library.encode(text)
        equal += (got[doc].n_ids, got[doc].ids_crc32) == (len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        if k % 10 == 0 and text:
            mine = [i if i < pieces.UNKNOWN else pieces.UNKNOWN - 1 - i for i in numbers(model, text)]
            total, want = best_path(model, text)
            assert mine == want or abs(sum(model.scores[i] if i >= 0 else model.least for i in mine) - total) < 1e-6 * max(1, len(want))
    assert equal >= 0.97 * len(docs)  # the library adds in single precision


def numbers(model, text):
    """The numbers of a text's pieces through the lanes."""
    codes = np.frombuffer(("▁" + text.replace(" ", "▁")).encode("utf-32-le"), np.int32)
    begin, _ = model._lanes(codes, np.array([0, len(codes)]))
    end = np.append(begin[1:], len(codes))
    order = np.argsort(begin - end, kind="stable")
    out = np.full(len(codes) + 1, -1, np.int32)
    model._search(codes, begin[order], end[order], out)
    return out[out >= 0].tolist()


def test_ids_become_final_all_along_the_registered_tables(spark, sf):
    for rows in (pieces.op7_sentencepiece(spark, sf).collect(), pieces.sentencepiece_unigram(spark, sf).collect()):
        long = [r for r in rows if r.n_ids > 200]
        assert len(long) > 50
        for r in long:
            assert r.commits > r.n_ids // 20 and 0 < r.widest <= 4 * MODEL.window


def test_windows_grow_where_paths_do_not_meet():
    """Two ways through a run of one letter stay equally alive till its end."""
    names, scores = ["a", "aa", "aaa", "b"], [-5.0, -1.0, -1.5, -1.0]
    model = pieces.Model({"kind": "unigram", "pieces": names, "scores": scores, "bytes": {}, "plain": [True] * 4})
    for n in (1, 2, 63, 64, 65, 200, 1001):
        got = [model.name(i) for i in model.viterbi("a" * n + "b")]
        best = [0.0, -5.0, -1.0]
        for i in range(3, n + 1):
            best.append(max(best[i - 1] - 5, best[i - 2] - 1, best[i - 3] - 1.5))
        assert "".join(got) == "a" * n + "b" and abs(sum(scores[names.index(p)] for p in got) - best[n] + 1) < 1e-6


@settings(max_examples=150, deadline=None)
@given(st.lists(st.sampled_from(WORDS), min_size=1, max_size=8).map("".join), st.lists(st.sampled_from(WORDS), min_size=1, max_size=8).map("".join))
def test_pairs_are_judged_as_by_the_merges(x, y):
    ids = [i for t in (x, y) for i in LIBRARY.encode(t)]
    ids = np.array([i for i in ids if MODEL.names[i] in MODEL.ids and MODEL.merges(MODEL.names[i]) == [MODEL.names[i]]], np.int64)
    if len(ids):
        a, b = np.repeat(ids, len(ids)), np.tile(ids, len(ids))
        want = [MODEL.merges(MODEL.names[p] + MODEL.names[q]) == [MODEL.names[p], MODEL.names[q]] for p, q in zip(a, b, strict=True)]
        assert MODEL._apart(a, b).tolist() == want


def test_kinds_of_models(tmp_path):
    import pytest

    assert SPEC["kind"] == "bpe"
    place = tmp_path / "u.model"
    place.write_bytes(as_unigram().serialized_model_proto())
    assert pieces.load_model(str(place))["kind"] == "unigram" and pieces.Model(pieces.load_model(str(place))).kind == "unigram"
    place.write_bytes(as_unigram(4))  # of characters
    with pytest.raises((ValueError, RuntimeError)):
        pieces.load_model(str(place))
