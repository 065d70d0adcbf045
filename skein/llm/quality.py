"""Quality by co-training: a classifier of the text and one of the metadata teach each other, and together score all rows.

Both are additive models over binned features whose parameters follow from sums (text: least squares, from the products of
bin indicators; metadata: naive Bayes, from counts), so a round's pseudo-labels of all rows become a grouped sum of bounded
size, never a collected set.

1. Text features of every row (shares of kinds of characters, word lengths, repetition, lines) and metadata (source, lang,
   length) are computed once and stored, some dozens of numbers a row.
2. At most LABELLED labelled rows are looked up (those with the least hashed ids). Their quantiles give the bins; four of
   five rows count, the fifth is for calibration. Where those held back are not of both kinds (few labels), all do both.
3. In each of ROUNDS rounds every unlabelled row that one view is sure of (SURE) counts for the other view under that label.
4. Each view's score is calibrated on the rows held back (Platt), so a view that knows nothing, or runs against the labels,
   stays at the base rate; the calibrated log-odds add up, less the base rate's.

Defined results: null text counts as empty, null metadata is a value of its own, rows of equal id share their label (the
lesser of two), repeated rows are scored each, without labels of both kinds every row is kept with score null.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from skein.llm.common import NULL_ID, SLICE, owners, real_id, runs, small_batches, stored, table, utf8_buffer, word_hashes

LABELLED, ROUNDS, SURE = 20_000, 3, 0.97
#: Quantiles at which bins begin; close to each other at the ends, where junk is.
QUANTILES = [0.002, 0.005, 0.01, 0.02, 0.03, 0.05, 0.08, 0.12, 0.2, 0.3, 0.5, 0.7, 0.8, 0.88, 0.92, 0.95, 0.97, 0.98, 0.99, 0.995, 0.998]
BINS = len(QUANTILES)
#: Weight of a pseudo-labelled row against a labelled one; values of hashed metadata.
PSEUDO, HASHED = 0.25, 1024
#: Rows are kept from this probability of good quality on.
KEEP = 0.5

_KIND = np.zeros(256, np.int32)  # 0 other, 1 lower, 2 upper, 3 digit, 4 space, 5 sentence marks, 6 symbols, 7 bars
for _c in range(256):
    _s = chr(_c)
    _KIND[_c] = 1 if _s.islower() and _c < 128 or _c >= 128 else 2 if "A" <= _s <= "Z" else 3 if "0" <= _s <= "9" else 5 if _s in ".,;:'\"-" else 7 if _s == "|" else 4 if _c in (9, 10, 11, 12, 13, 32) else 6
TEXT = ["lower", "upper", "digit", "space", "marks", "symbols", "bars", "word_length", "distinct", "repeats", "commonest", "line_length", "long_words", "words"]


def text_features(col: pa.Array) -> np.ndarray:
    """(rows, features): see TEXT. Works through runs of texts of about SLICE bytes; of a longer text only the words' hashes are held at once."""
    data, offsets = utf8_buffer(col)
    out = [_run_features(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]) for a, b in runs(offsets, SLICE)]
    return np.concatenate([np.zeros((0, len(TEXT))), *out])


def _run_features(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    n, size = len(offsets) - 1, np.diff(offsets).astype(float)
    kinds, lines = np.zeros(8 * n), np.ones(n)
    for a in range(0, len(data), SLICE):
        part = data[a : a + SLICE]
        doc = owners(offsets, a, a + len(part))
        kinds += np.bincount(doc * np.int32(8) + _KIND[part], minlength=8 * n)
        lines += np.bincount(doc[part == 10], minlength=n)
    kinds = kinds.reshape(n, 8)
    share = kinds[:, 1:] / np.maximum(size, 1)[:, None]
    words, at = word_hashes(data, offsets)
    count = np.diff(at).astype(float)
    distinct, commonest, repeats = np.zeros(n), np.zeros(n), np.zeros(n)
    for k in range(n):
        w = words[at[k] : at[k + 1]]
        if len(w):
            repeats[k] = np.count_nonzero(w[1:] == w[:-1])
            w = np.sort(w)
            ends = np.flatnonzero(np.append(w[1:] != w[:-1], True))
            distinct[k], commonest[k] = len(ends), np.diff(ends, prepend=-1).max()
    letters = size - kinds[:, 4]
    least = np.maximum(count, 1)
    mean = letters / least
    return np.column_stack([share, mean, distinct / np.sqrt(least), repeats / least, commonest / least, count / lines, np.maximum(mean - 8, 0), np.log1p(count)])


def _features(batches: Iterator[pa.RecordBatch], rows: bool = False) -> Iterator[pa.RecordBatch]:
    for b in batches:
        x = text_features(b["_text"])
        flat = pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1) * x.shape[1], pa.int32()), pa.array(x.reshape(-1)))
        yield pa.record_batch([b["_id"], flat, b["m"], *([b["_row"]] if rows else [])], ["_id", "x", "m", *(["_row"] if rows else [])])


def _inputs(df: DataFrame, id_col: str, text_col: str) -> list:
    size = F.coalesce(F.char_length(f"`{text_col}`"), F.lit(0))
    hashed = [F.pmod(F.xxhash64(F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("\0"))), F.lit(HASHED)).cast("int") for c in ("source", "lang") if c in df.columns]
    meta = F.array(F.floor(F.log2(size + 1) * 2).cast("int"), *hashed)
    return [F.coalesce(F.col(f"`{id_col}`").cast("long"), F.lit(NULL_ID)).alias("_id"), F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("_text"), meta.alias("m")]


class Views:
    """text: products of the bins' indicators, and in the last row their sums by label (-1, 1); meta: (feature, value, class)."""

    def __init__(self, edges: np.ndarray, metas: int):
        self.edges, self.n_text, self.metas = edges, len(edges), metas
        self.width = self.n_text * (BINS + 1)
        self.text = np.zeros((self.width + 1, self.width))
        self.meta = np.zeros((metas, HASHED, 2))
        self.calibration = [(1.0, 0.0), (1.0, 0.0)]
        self.base = 0.0

    def bins(self, x: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(e, x[:, k], "right") for k, e in enumerate(self.edges)], axis=1) if len(x) else np.zeros((0, self.n_text), np.int64)

    @staticmethod
    def _odds(counts: np.ndarray) -> np.ndarray:
        whole = counts.sum(axis=1, keepdims=True)
        rate = (counts.sum(axis=(0, 1)) + 1) / (counts.sum() + 2)
        smooth = counts + 10 * rate  # towards the base rate, as much as ten rows
        p = smooth / (whole + 10 * rate * counts.shape[1])
        return np.log(p[..., 1]) - np.log(p[..., 0])

    def indicators(self, bins: np.ndarray) -> np.ndarray:
        out = np.zeros((len(bins), self.width))
        out[np.arange(len(bins))[:, None], bins + np.arange(self.n_text) * (BINS + 1)] = 1
        return out

    def products(self, bins: np.ndarray, label: float) -> np.ndarray:
        z = self.indicators(bins)
        return np.vstack([z.T @ z, label * z.sum(axis=0)])

    def fit(self):
        self.text_odds = np.linalg.solve(self.text[:-1] + np.eye(self.width), self.text[-1]).reshape(self.n_text, BINS + 1)
        self.meta_odds = self._odds(self.meta)

    def scores(self, x: np.ndarray, m: np.ndarray) -> np.ndarray:
        b = self.bins(x)
        text = sum((self.text_odds[k, b[:, k]] for k in range(self.n_text)), np.zeros(len(x)))
        meta = sum((self.meta_odds[k, m[:, k] % HASHED] for k in range(self.metas)), np.zeros(len(x))) + self.base
        return np.stack([text, meta], axis=1)

    def calibrated(self, scores: np.ndarray) -> np.ndarray:
        return np.stack([a * scores[:, k] + c for k, (a, c) in enumerate(self.calibration)], axis=1)

    def combined(self, scores: np.ndarray) -> np.ndarray:
        odds = self.calibrated(scores).sum(axis=1) - self.base
        return 1 / (1 + np.exp(-np.clip(odds, -50, 50)))


def platt(score: np.ndarray, good: np.ndarray) -> tuple[float, float]:
    """a, c of the logistic curve a * score + c through the rows, by damped Newton steps with a slight pull to 0. A score that runs against the labels gets a = 0 and the base rate's c."""
    base = float(np.log((good.sum() + 1) / ((1 - good).sum() + 1)))

    def loss(at: np.ndarray) -> float:
        return float(np.logaddexp(0, -(2 * good - 1) * (at[0] * score + at[1])).sum() + 0.005 * at[0] ** 2)

    at = np.array([0.0, base])
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(at[0] * score + at[1], -500, 500)))
        w = p * (1 - p) + 1e-9
        gradient = np.array([((p - good) * score).sum() + 0.01 * at[0], (p - good).sum()])
        hessian = np.array([[(w * score**2).sum() + 0.01, (w * score).sum()], [(w * score).sum(), w.sum()]])
        step = np.linalg.solve(hessian, gradient)
        while loss(at - step) > loss(at) and np.abs(step).max() > 1e-9:  # rows that a line parts draw a full step too far
            step /= 2
        at = at - step
        if np.abs(step).max() < 1e-9:
            break
    a, c = float(at[0]), float(at[1])
    return (a, c) if a > 0 else (0.0, base)


def _arrays(b) -> tuple[np.ndarray, np.ndarray]:
    n = max(len(b), 1)
    x, m = b["x"].flatten().to_numpy(zero_copy_only=False), b["m"].flatten().to_numpy(zero_copy_only=False)
    return x.reshape(len(b), len(x) // n), m.reshape(len(b), len(m) // n).astype(np.int64)


def _pseudo(batches: Iterator[pa.RecordBatch], views: Views, labelled: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Sums of the rows that a view is sure of, for the other view."""
    text, meta = np.zeros_like(views.text), np.zeros_like(views.meta)
    limit = np.log(SURE / (1 - SURE))
    for b in batches:
        x, m = _arrays(b)
        free = ~np.isin(b["_id"].to_numpy(), labelled)
        odds = views.calibrated(views.scores(x, m))
        bins = views.bins(x)
        for cls, sure in ((1, odds > limit), (0, odds < -limit)):
            to_text, to_meta = free & sure[:, 1], free & sure[:, 0]
            if to_text.any():
                text += views.products(bins[to_text], 2.0 * cls - 1)
            for k in range(views.metas):
                meta[k, :, cls] += np.bincount(m[to_meta, k] % HASHED, minlength=HASHED)
    sums = np.concatenate([text.reshape(-1), meta.reshape(-1)])
    place = np.flatnonzero(sums)
    yield pa.record_batch([pa.array(place), pa.array(sums[place])], ["place", "n"])


def train(features: DataFrame, labels: DataFrame) -> Views | None:
    """features: _id, x, m. labels: doc_id, quality."""
    label = labels.filter("doc_id is not null and quality is not null").groupBy(F.col("doc_id").cast("long").alias("_id")).agg(F.min("quality").alias("q")).orderBy(F.xxhash64("_id"), "_id").limit(LABELLED)
    seen = features.join(F.broadcast(label), "_id").groupBy("_id").agg(F.min(F.struct("x", "m", "q")).alias("r")).select("_id", "r.*").orderBy("_id").collect()  # LABELLED rows at most
    good = np.array([float(r["q"] > 0) for r in seen])
    if not len(seen) or good.min() == good.max():
        return None
    x, m = np.array([r["x"] for r in seen]), np.array([r["m"] for r in seen], np.int64)
    edges = np.quantile(x, QUANTILES, axis=0).T
    ids = np.array([r["_id"] for r in seen], np.int64)
    held = np.arange(len(seen)) % 5 == 4
    used = ~held
    if not held.any() or good[held].min() == good[held].max():
        held[:] = used[:] = True
    views = Views(edges, m.shape[1])
    bins = views.bins(x)
    for cls in (0, 1):
        own = used & (good == cls)
        views.text += views.products(bins[own], 2.0 * cls - 1)
        for k in range(views.metas):
            views.meta[k, :, cls] += np.bincount(m[own, k] % HASHED, minlength=HASHED)
    known = views.text.copy(), views.meta.copy()

    def refit():
        views.fit()
        views.base = float(np.log((good[held].sum() + 1) / ((1 - good[held]).sum() + 1)))
        scores = views.scores(x[held], m[held])
        views.calibration = [platt(scores[:, k], good[held]) for k in (0, 1)]

    refit()
    for _ in range(ROUNDS):
        sums = features.mapInArrow(lambda it: _pseudo(it, views, ids), "place long, n double").groupBy("place").agg(F.sum("n").alias("n")).toArrow()
        flat = np.concatenate([known[0].reshape(-1), known[1].reshape(-1)])
        flat[sums["place"].to_numpy()] += PSEUDO * sums["n"].to_numpy()
        views.text, views.meta = flat[: known[0].size].reshape(known[0].shape), flat[known[0].size :].reshape(known[1].shape)
        refit()
    return views


def _score(batches: Iterator[pa.RecordBatch], views: Views) -> Iterator[pa.RecordBatch]:
    for b in batches:
        x, m = _arrays(b)
        scores = views.scores(x, m)
        odds, p = views.calibrated(scores), views.combined(scores)
        one = 1 / (1 + np.exp(-np.clip(odds, -50, 50)))
        yield pa.record_batch([b["_id"], pa.array(one[:, 0]), pa.array(one[:, 1]), pa.array(p), pa.array(p >= KEEP)], ["doc_id", "text_score", "metadata_score", "score", "kept"])


def score(df: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of df: doc_id, text_score, metadata_score, score (probabilities of good quality), kept."""
    small_batches(df.sparkSession)
    features = stored(df.select(*_inputs(df, id_col, text_col)).mapInArrow(_features, "_id long, x array<double>, m array<int>"), "quality")
    views = train(features, labels)
    if views is None:
        none = F.lit(None).cast("double")
        return features.select(real_id("_id").alias("doc_id"), none.alias("text_score"), none.alias("metadata_score"), none.alias("score"), F.lit(True).alias("kept"))
    return features.mapInArrow(lambda it: _score(it, views), "doc_id long, text_score double, metadata_score double, score double, kept boolean").withColumn("doc_id", real_id("doc_id"))


def _keep(batches: Iterator[pa.RecordBatch], views: Views) -> Iterator[pa.RecordBatch]:
    for b in _features(batches, rows=True):
        x, m = _arrays(b)
        kept = views.combined(views.scores(x, m)) >= KEEP
        yield pa.record_batch([b["_row"].filter(pa.array(kept))], ["_row"])


def keep_good(df: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """df without the rejected rows, all columns as they were; rows don't leave their partition."""
    small_batches(df.sparkSession)
    inputs = _inputs(df, id_col, text_col)
    features = stored(df.select(*inputs).mapInArrow(_features, "_id long, x array<double>, m array<int>"), "quality")
    views = train(features, labels)
    if views is None:
        return df
    packed = df.select(*inputs, F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("_row"))
    kept = packed.mapInArrow(lambda it: _keep(it, views), T.StructType([packed.schema["_row"]]))
    return kept.select([F.col("_row").getField(c).alias(c) for c in df.columns])


def op1_quality_classifier(spark, sf_dir: str) -> DataFrame:
    return score(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
