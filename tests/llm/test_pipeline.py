import sys

sys.path.insert(0, __import__("os").path.dirname(__file__))
import corpus_pipeline as P
from test_jaccard import brute
from test_tokens import brute as tokens

from skein.llm import language_id, quality
from skein.llm.common import table


def test_pipeline_equals_plain_steps(spark, sf):
    docs = table(spark, sf, "documents")
    good = {r.doc_id for r in quality.score(docs, table(spark, sf, "labels")).collect() if r.kept}
    rows = {r.doc_id: r.text for r in docs.collect() if r.doc_id in good}
    known = {r.doc_id for r in language_id.of_documents(docs.filter(docs.doc_id.isin(list(good)))).collect() if r.kept}
    last: dict = {}
    for d in sorted(known):
        last[rows[d]] = d
    left = [(d, rows[d]) for d in last.values()]
    left = [(d, rows[d]) for d, (_, c) in brute(left, 5, 80, 100).items() if c == d]
    want = {d: len(ids) for d, ids in tokens(left)}
    got: dict = {}
    for r in P.run(spark, sf).collect():
        got[r.doc_id] = got.get(r.doc_id, 0) + r.length
    assert got == want and 0 < len(got) < docs.count()


def test_stages_keep_the_columns_and_take_odd_rows(spark, sf, odd_docs, no_docs):
    for df in (odd_docs, no_docs):
        for _, stage in P.STAGES[:-1]:
            assert stage(spark, df, sf).columns == df.columns
        assert P.STAGES[-1][1](spark, df, sf).count() >= df.count()
