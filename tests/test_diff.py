import random
import time

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from skein.functions.diffs import BLOCK, Diff, difference

TEXTS = st.lists(st.sampled_from([b"the same line again\n", b"0123456789abcdef", b"x", b"", b"alpha beta gamma ", bytes(range(40))]), max_size=20).map(b"".join) | st.binary(max_size=200)


@settings(max_examples=400, deadline=None)
@given(TEXTS, TEXTS)
def test_patching_gives_the_new_content(old, new):
    made = difference(old, new)
    assert made.content(old) == new and len(made) == len(new)
    assert Diff.unpack(made.pack()).content(old) == new and str(Diff.unpack(made.pack())) == str(made)


def test_edited_texts_are_copied_but_for_the_edits():
    rng = random.Random(3)
    for _ in range(60):
        old = bytes(rng.choice(b"abcdefgh ") for _ in range(rng.randrange(500, 4000)))
        new, changed = bytearray(old), 0
        for _ in range(rng.randrange(1, 6)):
            at, n = rng.randrange(len(new) + 1), rng.randrange(6)
            new[at : at + rng.randrange(4)] = bytes(rng.choice(b"xyz") for _ in range(n))
            changed += n + 2 * (2 * BLOCK - 1)
        made = difference(old, bytes(new))
        assert made.content(old) == bytes(new) and len(made.own) <= changed


def test_long_texts():
    old = b"the same line again\n" * 10_000
    new = b"edited " + old[:100_000] + b"!" + old[100_000:]
    began = time.process_time()
    made = difference(old, new)
    assert made.content(old) == new and len(made.pack()) < 1000
    rng = random.Random(5)
    noise = rng.randbytes(1_000_000)
    assert difference(noise, rng.randbytes(1_000_000)).content(noise) and len(difference(noise, noise[::-1])) == len(noise)
    assert time.process_time() - began < 3


@settings(max_examples=200, deadline=None)
@given(st.binary(max_size=60), st.lists(st.tuples(st.sampled_from(["splice", "set", "set_byte", "blob"]), st.integers(0, 80), st.integers(0, 20), st.binary(max_size=9)), max_size=8))
def test_edits_equal_those_of_a_plain_string(old, edits):
    made, plain, blobs = Diff.unchanged(len(old)), bytearray(old), {}
    for kind, at, count, content in edits:
        if at > len(plain):
            plain += bytes(at - len(plain))
            count = 0 if kind == "splice" else count
        if kind == "splice":
            made.splice(at, count, content)
            plain[at : at + count] = content
        elif kind == "set":
            made.set(at, content)
            plain[at : at + len(content)] = content
        elif kind == "set_byte":
            made.set_byte(at, count)
            plain[at : at + 1] = bytes([count])
        else:
            blobs[name := f"b{count}"] = bytes([count]) * count
            made.insert_blob(at, name, count)
            plain[at:at] = blobs[name]
        assert made.content(old, blobs.get) == plain and len(made) == len(plain)
    again = Diff.unpack(made.pack())
    assert again.content(old, blobs.get) == plain
    for k in range(0, len(plain), 7):
        assert again.byte(k, old, blobs.get) == plain[k]
    with pytest.raises(IndexError):
        again.byte(len(plain), old, blobs.get)
