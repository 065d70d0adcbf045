import random
from collections import defaultdict

import numpy as np
import pytest

from skein.llm import jaccard_join as J
from skein.llm.common import table
from skein.llm.components import forest


def grams(text, width):
    w = tuple((text or "").encode().lower().split())
    return {w[i : i + width] for i in range(len(w) - width + 1)} or ({w} if w else set())


def brute(rows, width, num, den):
    """{id: (n, component)} by comparing all pairs that share an n-gram."""
    sets = {d: grams(t, width) for d, t in rows}
    up = {d: d for d in sets}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    at, pairs = defaultdict(list), set()
    for d, s in sets.items():
        for g in s:
            at[g].append(d)
    for ds in at.values():
        pairs.update((a, b) for i, a in enumerate(ds) for b in ds[:i])
    for a, b in pairs:
        both = len(sets[a] & sets[b])
        if den * both >= num * (len(sets[a]) + len(sets[b]) - both):
            x, y = root(a), root(b)
            up[max(x, y)] = min(x, y)
    return {d: (len(s), root(d)) for d, s in sets.items()}


@pytest.mark.parametrize("width,num", [(3, 90), (5, 80)])
def test_equals_all_pairs(spark, sf, width, num):
    docs = table(spark, sf, "documents")
    rows = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in J.jaccard_components(docs, width, num, 100).collect()}
    assert got == brute(rows, width, num, 100)


@pytest.mark.parametrize("width,num,postings", [(1, 50, 10**6), (2, 80, 60), (3, 90, 300), (1, 75, 40)])
def test_near_copies_in_blocks(spark, width, num, postings, monkeypatch):
    monkeypatch.setattr(J, "POSTINGS", postings)
    rng = random.Random(num + width)
    rows = [(i, None) for i in range(3)]
    for base in range(8):
        words = [f"w{rng.randrange(60)}" for _ in range(rng.choice([1, 3, 9, 14, 40, 41]))]
        for _ in range(15):
            copy = list(words)
            for _ in range(rng.randrange(4)):
                copy[rng.randrange(len(copy))] = f"w{rng.randrange(60)}"
            if rng.random() < 0.3:
                copy = copy[: rng.randrange(len(copy) + 1)]
            rows.append((len(rows), " ".join(copy).upper() if rng.random() < 0.3 else "\t".join(copy)))
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in J.jaccard_components(df, width, num, 100).collect()}
    assert got == brute(rows, width, num, 100)


def test_odd_rows(odd_docs, no_docs):
    got = sorted(J.jaccard_components(odd_docs).collect(), key=lambda r: (r.doc_id is None, r.doc_id or 0, r.n_shingles))
    assert [(r.doc_id, r.component_id) for r in got][:9] == [(1, 1), (1, 1), (2, 1), (3, 3), (4, 4), (6, 6), (7, 6), (8, 8), (9, 9)]
    assert [r.component_id for r in got[9:]] == [None, None] and got[3].n_shingles == got[7].n_shingles == 0
    assert sorted((r.doc_id or 0) for r in J.one_of_each(odd_docs).collect()) == [0, 0, 1, 1, 3, 4, 6, 8, 9]
    assert J.one_of_each(odd_docs).columns == odd_docs.columns and J.one_of_each(no_docs).count() == 0


def at_the_bound(rng, num, den):
    """Sets of a group of copies of 100 to 2,000 n-grams, most of which agree in exactly as many as the bound asks for, the others in one fewer."""
    sets, fresh = [], iter(range(10**6, 10**7))
    for base in range(3):
        size = rng.randrange(100, 2000) // (num + den) * (num + den) or num + den
        common = rng.sample(range(10**5), size)
        least = -(-2 * num * size // (num + den))
        sets.append(common)
        for k in range(6):
            left = rng.sample(common, least - (k == 5))
            sets.append(left + [next(fresh) for _ in range(size - len(left))])
        part = rng.sample(common, size * num // den)
        sets += [part, part[1:]]
    rng.shuffle(sets)
    return [np.array(sorted(s), np.uint64) for s in sets]


@pytest.mark.parametrize("num", [50, 80, 90])
def test_search_finds_all_at_the_bound(num):
    sets = at_the_bound(random.Random(num), num, 100)
    index = J.Index(sets, num, 100)
    plain = [set(s.tolist()) for s in sets]
    links = 0
    for q, a in enumerate(plain):
        want = [d for d, b in enumerate(plain) if 100 * len(a & b) >= num * len(a | b)]
        assert list(index.search(sets[q], lambda doc: doc)) == want
        links += len(want) - 1
    assert links >= 3 * 6


@pytest.mark.parametrize("num", [50, 75, 80, 90])
def test_prefixes_share_a_key_at_the_bound(num):
    sets = at_the_bound(random.Random(num + 1), num, 100) + [np.arange(a, a + n, dtype=np.uint64) for n in range(1, 30) for a in (0, 1)]
    keys, doc = J.prefix_keys(np.concatenate(sets), np.cumsum([0] + [len(s) for s in sets]), num, 100, np.full(1 << J.CELLS, 3, np.uint8))
    plain, of = [set(s.tolist()) for s in sets], [set(keys[doc == d].tolist()) for d in range(len(sets))]
    for q, a in enumerate(plain):
        assert all(of[q] & of[d] for d, b in enumerate(plain) if 100 * len(a & b) >= num * len(a | b))


@pytest.mark.parametrize("num", [80, 90])
def test_prefixes_of_unlike_sets_stay_apart_when_nothing_is_known_as_rare(num):
    """As in tables so large that every range of hashes has n-grams of several documents: chance must not make one group of all."""
    rng = random.Random(num)
    sets = [np.array(sorted(rng.sample(range(20_000), 300)), np.uint64) for _ in range(400)]
    keys, doc = J.prefix_keys(np.concatenate(sets), np.cumsum([0] + [len(s) for s in sets]), num, 100, np.full(1 << J.CELLS, 3, np.uint8))
    assert len(set(doc.tolist())) == 400
    u, v = J._stars(keys, doc.astype(np.int64))[2].T
    assert np.unique(forest(u, v)[1], return_counts=True)[1].max(initial=0) < 40


def test_merge_counts_every_list():
    rng = random.Random(5)
    for _ in range(300):
        lists = [sorted(rng.sample(range(12), rng.randrange(1, 7))) for _ in range(rng.randrange(1, 9))]
        sets = [np.array([k for k, p in enumerate(lists) if d in p], np.uint64) for d in range(12)]
        index = J.Index(sets, 50, 100)
        for threshold in range(1, len(lists) + 1):
            assert dict(index._merge(np.arange(len(lists)), threshold, lambda doc: doc)) == {d: len(s) for d, s in enumerate(sets) if len(s) >= threshold}


def test_rows_of_one_id_are_one_document(spark):
    a, b, c, d = (" ".join(f"{x}{i}" for i in range(40)) for x in "abcd")
    rows = [(1, a), (5, a), (5, b), (2, b), (7, b + " more"), (8, c), (8, d), (9, c + " x"), (3, d + " y"), (4, "alone")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    for parts in (1, 10):
        got = sorted({(r.doc_id, r.component_id) for r in J.jaccard_components(df.repartition(parts)).collect()})
        assert got == [(1, 1), (2, 1), (3, 3), (4, 4), (5, 1), (7, 1), (8, 3), (9, 3)]


def test_connected_documents_are_skipped_not_lost():
    """Searching on from what is connected finds the same components as searching all, and far fewer links."""
    rng = random.Random(11)
    sets = []
    for base in range(4):
        common = [base * 1000 + k for k in range(100)]
        sets += [np.array(sorted(rng.sample(common, 96)), np.uint64) for _ in range(60)]
    rng.shuffle(sets)
    index, same, links = J.Index(sets, 80, 100), J.Connected(list(range(len(sets)))), 0
    for q in range(len(sets)):
        for doc in index.search(sets[q], lambda doc: same.next(doc, same.of[q], q)):
            same.join(q, doc)
            links += 1
    roots = defaultdict(set)
    for q, s in enumerate(sets):
        roots[int(s[0]) // 1000].add(same.root(q))
    assert all(len(r) == 1 for r in roots.values()) and links == len(sets) - 4


@pytest.mark.parametrize("chunk", [1, 7, 50, 10**6])
def test_components_of_any_graph(spark, chunk):
    from skein.llm.components import components, forest

    rng = random.Random(chunk)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(200)] + [(1000 + k, 1001 + k) for k in range(60)] + [(2000, 2001 + k) for k in range(40)] + [(-5, 3), (2020, 2020)]
    up = {x: x for e in edges for x in e}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in edges:
        a, b = root(a), root(b)
        up[max(a, b)] = min(a, b)
    want = {x: root(x) for x in {y for e in edges for y in e if e[0] != e[1]}}
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "u long, v long").repartition(4), chunk).collect()}
    assert got == want
    nodes, tops = forest(*np.array(edges).T)
    assert dict(zip(nodes.tolist(), tops.tolist(), strict=True)) == {x: r for x, r in want.items() if x != r}
