import numpy as np

from skein.operators import vector
from skein.plans.catalogue import t


def test_recall_of_the_index(spark, sf):
    """Of the exact top 10 over the whole table the probed cells hold nine of ten."""
    df = t(spark, sf, "embeddings")
    rows = vector.signatures(df, 64, 8, 16).select("vec_id", "embedding", "_cells").orderBy("vec_id").collect()
    x, cells = np.array([r.embedding for r in rows], float), [set(r._cells) for r in rows]
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    hits = asked = 0
    for k in [k for k, r in enumerate(rows) if r.vec_id % 50 == 0 or r.vec_id == 7]:
        score = unit @ unit[k]
        top = [i for i in np.argsort(-score, kind="stable")[:10] if score[i] >= 0]
        probe = set(vector.probed_cells(x[k].tolist(), 8, 16, 16))
        hits, asked = hits + sum(bool(probe & cells[i]) for i in top), asked + len(top)
        assert cells[k] <= probe
    assert asked and hits >= 0.9 * asked
    # the operator itself finds those that share a cell
    q = next(k for k, r in enumerate(rows) if r.vec_id == 7)
    score, probe = unit @ unit[q], set(vector.probed_cells(x[q].tolist(), 8, 16, 16))
    want = [rows[i].vec_id for i in np.argsort(-score, kind="stable") if probe & cells[i]][:10]
    assert [r.vec_id for r in vector.approximate_top_k(df, x[q].tolist(), 10).collect()] == want
