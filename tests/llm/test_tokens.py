import zlib
from collections import defaultdict

import numpy as np
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st

from skein.llm import huffman, packing
from skein.llm.common import table
from skein.llm.tokens import Encoder, tokenizer_path

ENCODER = Encoder(open(tokenizer_path(), encoding="utf-8").read())


def brute(rows):
    """doc_id, ids with the end id, by the library on whole texts."""
    got = ENCODER.tokenizer.encode_batch([t or "" for _, t in rows], add_special_tokens=False)
    return [(d, g.ids + [1]) for (d, _), g in zip(rows, got, strict=True)]


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(alphabet=st.sampled_from(list("abZé'ſİΣσיִ ́\n\t\x1c\x85 .,!?%&*#$|<>;:12½²🙂　endoftxs")), max_size=30), min_size=1, max_size=5))
def test_words_give_the_ids_of_the_text(texts):
    texts = [*texts, "<|endoftext|>" + texts[0], texts[0] + "'s <|startoftext|>"]
    ids, at = ENCODER.encode(pa.array(texts))
    for k, (_, want) in enumerate(brute([(0, t) for t in texts])):
        assert ids[at[k] : at[k + 1]].tolist() == want


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 10**9), min_size=1, max_size=60), st.integers(0, 3))
def test_code_lengths_are_a_full_code_and_round_trip(counts, seed):
    counts = np.array(counts, np.int64)
    lengths = huffman.code_lengths(counts, 8)
    used = lengths[lengths > 0].astype(float)
    assert (lengths > 0).sum() == (counts > 0).sum() and lengths.max(initial=0) <= 8
    if len(used):
        assert (2.0**-used).sum() == (1 if len(used) > 1 else 0.5)
        ids = np.random.default_rng(seed).choice(np.flatnonzero(counts), size=777)
        bits, marks = huffman.encode_block(ids, lengths, huffman.canonical_codes(lengths))
        assert (huffman.decode_block(bits, marks, len(ids), huffman.decode_table(lengths)) == ids).all()


def test_code_lengths_are_optimal_where_the_limit_is_loose():
    import heapq

    counts = np.random.default_rng(1).integers(1, 10_000, 300)
    heap, cost = counts.tolist(), 0
    heapq.heapify(heap)
    while len(heap) > 1:
        heapq.heappush(heap, x := heapq.heappop(heap) + heapq.heappop(heap))
        cost += x
    assert (huffman.code_lengths(counts, 30) * counts).sum() == cost


def test_op5_equals_the_library(spark, sf):
    rows = sorted((r.doc_id, r.text) for r in table(spark, sf, "documents").select("doc_id", "text").collect())
    want, start = {}, 0
    for doc, ids in brute(rows):
        want[doc] = (start, len(ids), crc(ids))
        start += len(ids)
    got = {r.doc_id: (r.start, r.n_tokens, r.ids_crc32) for r in huffman.op5_token_file(spark, sf).collect()}
    assert got == want


def test_files_of_odd_rows(spark, odd_docs, no_docs, tmp_path):
    huffman.write(odd_docs, f"file://{tmp_path}/a")
    got = huffman.read(spark, f"file://{tmp_path}/a").collect()
    rows = [(r.doc_id, r.text) for r in odd_docs.collect()]
    assert sorted((r.doc_id is not None, r.doc_id, bytes(r.ids)) for r in got) == sorted((d is not None, d, np.array(i, "<u4").tobytes()) for d, i in brute(rows))
    ends = sorted((r.start, r.start + r.n_tokens) for r in got)
    assert ends[0][0] == 0 and all(a[1] == b[0] for a, b in zip(ends, ends[1:], strict=False))
    huffman.write(no_docs, f"file://{tmp_path}/b")
    assert huffman.read(spark, f"file://{tmp_path}/b").count() == 0


def check_pieces(pieces, rows, length=packing.LENGTH):
    seqs, docs = defaultdict(list), defaultdict(list)
    for p in pieces:
        seqs[p.sequence_id].append((p.offset, p.length))
        docs[p.doc_id].append((p.start, p.length, bytes(p.ids), p.doc_tokens))
    padding = 0
    for parts in seqs.values():
        at = 0
        for offset, n in sorted(parts):
            assert offset == at and n > 0
            at += n
        assert at <= length
        padding += 0 if at & (at - 1) == 0 else length - at
    for doc, ids in brute(rows):
        whole = b"".join(x[2] for x in sorted(docs[doc]))
        assert whole == np.array(ids, "<u4").tobytes() and all(x[3] == len(ids) for x in docs[doc])
    return padding


def test_op6_holds_every_id_once_without_padding(spark, sf):
    docs = table(spark, sf, "documents")
    rows = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    assert check_pieces(packing.pack(docs).collect(), rows) == 0
    one = packing.op6_packing(spark, sf).first()
    assert set(one.asDict()) >= {"doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"}


def test_pack_odd_rows(odd_docs, no_docs):
    pieces = packing.pack(odd_docs, length=256).collect()
    assert sum(p.length for p in pieces) == sum(len(i) for _, i in brute([(r.doc_id, r.text) for r in odd_docs.collect()]))
    assert packing.pack(no_docs).count() == 0


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 70), max_size=60))
def test_level_is_the_least_sum_of_squares(sizes):
    packer = packing.Packer(32)
    for doc, n in enumerate(sizes):
        rest = n % 32
        if rest:
            level = packer.level_for(rest)
            costs = {}
            for h in range(32 - rest + 1):
                if h == 0 or packer.levels[h]:
                    after = packer.levels[:32].copy()
                    if h:
                        after[h] -= 1
                    if h + rest < 32:
                        after[h + rest] += 1
                    costs[h] = (after**2).sum()
            assert costs[level] == min(costs.values())
        list(packer.add(doc, np.arange(n, dtype=np.uint32)))
    assert sum(packer.levels[h] for h in range(1, 32)) == sum(map(len, packer.open))
    left = list(packer.finish())
    assert all((f := sum(len(p[2]) for p in w)) == 32 or f & (f - 1) == 0 for w in left)


def test_reading_moves_coded_blocks_and_counting_reads_no_ids(spark, sf, tmp_path, monkeypatch):
    read = []
    monkeypatch.setattr(huffman, "_count", lambda batches, f=huffman._count: f(b for b in batches if b.schema.names == ["seen"]))
    monkeypatch.setattr(huffman, "code_lengths", lambda counts, f=huffman.code_lengths: read.append(counts) or f(counts))
    path = f"file://{tmp_path}/c"
    huffman.write(table(spark, sf, "documents"), path)
    got = huffman.read(spark, path)
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("MapInArrow") < plan.index("Join")  # what stands above comes first
    ids = np.concatenate([np.frombuffer(r.ids, "<u4") for r in got.select("ids").collect()])
    assert (np.bincount(ids, minlength=len(read[0])) == read[0]).all()
