import numpy as np
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st

from skein.llm import common


@settings(max_examples=300, deadline=None)
@given(st.lists(st.text(alphabet="ab A\n\x0b\x85é ", max_size=12) | st.just("aB " * 7) | st.none(), max_size=6), st.integers(1, 9))
def test_words_hash_alike_however_they_are_sliced(texts, size):
    old, common.SLICE = common.SLICE, size
    try:
        h, at = common.word_hashes(*common.utf8_buffer(pa.array(texts, pa.string())))
    finally:
        common.SLICE = old
    words = [w for t in texts for w in (t or "").encode().lower().split()]
    assert np.diff(at).tolist() == [len((t or "").encode().split()) for t in texts]
    seen = {}
    for w, x in zip(words, h.tolist(), strict=True):
        assert seen.setdefault(w, x) == x
    assert len(set(seen.values())) == len(seen)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text(alphabet="ab ", max_size=12), max_size=6), st.integers(1, 4))
def test_shingle_sets(texts, width):
    flat, at = common.shingle_sets(*common.utf8_buffer(pa.array(texts, pa.string())), width)
    names = {}
    for k, t in enumerate(texts):
        w = t.split()
        want = {tuple(w[i : i + width]) for i in range(len(w) - width + 1)} or ({tuple(w)} if w else set())
        got = flat[at[k] : at[k + 1]].tolist()
        assert len(got) == len(want) and got == sorted(got)
        names.setdefault(frozenset(want), got)
        assert names[frozenset(want)] == got
