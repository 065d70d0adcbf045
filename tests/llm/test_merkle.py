import hashlib

from hypothesis import given, settings
from hypothesis import strategies as st

from skein.llm import merkle
from skein.llm.common import table

TEXT = st.text(alphabet=st.sampled_from(list("ab \n\tçé🙂")), max_size=60)


@settings(max_examples=200, deadline=None)
@given(st.lists(TEXT, min_size=1, max_size=6))
def test_equal_texts_only_have_equal_prints(texts):
    prints = merkle.fingerprints(texts)
    for a, p in zip(texts, prints, strict=True):
        assert p == merkle.fingerprints([a])[0]
        for b, q in zip(texts, prints, strict=True):
            assert (p == q) == (a == b) == (merkle.likeness(p, q) == 1.0)
            assert 0 <= merkle.likeness(p, q) <= 1 and abs(merkle.likeness(p, q) - merkle.likeness(q, p)) < 1e-12


def test_an_edit_is_located():
    lines = [f"line {i} has words {i * i} and more of them {i * 7}" for i in range(200)]
    a = merkle.fingerprints(["\n".join(lines)])[0]
    lines[100] = "something else"
    b = merkle.fingerprints(["\n".join(lines)])[0]
    x, y = merkle.differing_sections(a, b)
    assert 1 <= len(x) <= 3 and 1 <= len(y) <= 3 and merkle.likeness(a, b) > 0.95


def brute(rows):
    rows = sorted((d, t or "") for d, t in rows)
    out = {}
    for k, (d, t) in enumerate(rows):
        n = rows[(k + 1) % len(rows)][1]
        e = t[: len(t) - len(t) // 2] + n[: len(t) // 2]
        p, q, r = merkle.fingerprints([t, e, n])
        out[d] = (len(t), hashlib.sha256(e.encode()).hexdigest(), p, q, merkle.likeness(p, q), merkle.likeness(p, r))
    return out


def test_op10_equals_brute_force(spark, sf):
    rows = [(r.doc_id, r.text) for r in table(spark, sf, "documents").select("doc_id", "text").collect()]
    want = brute(rows)
    for df in (table(spark, sf, "documents").repartition(5), table(spark, sf, "documents")):
        got = merkle.neighbour_prints(df).collect()
        assert len(got) == len(rows) and {r.doc_id: (r.n_chars, r.edited_sha256, r.fingerprint, r.edited_fingerprint, r.near_edited, r.near_next) for r in got} == want
    near = [w[4] for w in want.values() if w[0] > 200]
    assert sum(0.25 < x < 0.8 for x in near) > 0.9 * len(near)


def test_odd_rows(spark, odd_docs, no_docs):
    assert merkle.neighbour_prints(odd_docs).count() == odd_docs.count() and merkle.neighbour_prints(no_docs).count() == 0
    one = merkle.neighbour_prints(spark.createDataFrame([(5, "abcd")], "doc_id long, text string")).first()
    assert one.n_chars == 4 and one.near_next == 1.0 and one.edited_sha256 == hashlib.sha256(b"abab").hexdigest()
