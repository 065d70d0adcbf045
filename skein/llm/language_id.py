"""Language identification by Bayesian fusion of what the text, its markup, its address and its host say.

For each language: posterior ~ host prior x P(text | language) x P(declared | language) x P(address suffix | language).

- Text: a multinomial model over hashed words and byte trigrams, one language for each value that is declared anywhere in
  the table, fitted on at most SAMPLE rows of each (those with the least hashes; the counts are a grouped sum). The weights
  take 256 KB a language. The log-likelihood is discounted, as neighbouring features depend on each other.
- Declared language and suffix (a language code in the path, or else the top-level domain): how often each goes with each
  language is counted over all rows, by what the text alone says, and smoothed.
- Host prior: the text-only posteriors of all rows are summed by host, by domain and in all; a host's prior is smoothed
  towards its domain's and that towards the whole. Sums are partial where the rows lie; a host is one row afterwards.

Rejected (kept is false): rows without words or with a posterior under CONFIDENT. Defined results: null or empty text has
language `und`; without any declared language in the table every row is `und`; null hosts and declarations are evidence of
their own kind; rows are judged one by one, so repeated rows and ties are judged alike (the first language by name wins).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from skein.llm.common import LOWER, NULL_ID, SLICE, mix64, owners, real_id, small_batches, stored, table, utf8_buffer, word_hashes

#: Rows of each declared language that the text model is fitted on, at most; hashed features of each kind.
SAMPLE, FEATURES = 1000, 1 << 15
#: Strength of the smoothing of hosts and domains, kinds of suffixes, least posterior of a kept row.
STRENGTH, SUFFIXES, CONFIDENT = 20.0, 1024, 0.5


def text_features(col: pa.Array) -> tuple[np.ndarray, Iterator[tuple[np.ndarray, np.ndarray]]]:
    """Words of each document; (features, their documents) of at most SLICE words or byte trigrams at a time, so that arrays stay small whatever the texts' lengths."""
    data, offsets = utf8_buffer(col)
    words, at = word_hashes(data, offsets)

    def slices():
        for a in range(0, len(words), SLICE):
            part = words[a : a + SLICE]
            yield (part >> np.uint64(49)).astype(np.int32), owners(at, a, a + len(part))
        for a in range(0, len(data) - 2, SLICE):
            low = LOWER[data[a : a + SLICE + 2]].astype(np.uint32)
            tri = (low[:-2] << np.uint32(16)) | (low[1:-1] << np.uint32(8)) | low[2:]
            inside = np.ones(len(tri), bool)
            ends = offsets[np.searchsorted(offsets, a, "right") : np.searchsorted(offsets, a + len(tri) + 2, "right")] - a
            for back in (1, 2):  # no trigram goes on into the next text
                place = ends - back
                inside[place[(place >= 0) & (place < len(tri))]] = False
            doc = owners(offsets, a, a + len(tri))
            yield FEATURES + (mix64(tri[inside].astype(np.uint64)) >> np.uint64(49)).astype(np.int32), doc[inside]

    return np.diff(at), slices()


def _count(batches: Iterator[pa.RecordBatch], names: list[str]) -> Iterator[pa.RecordBatch]:
    total = np.zeros(len(names) * 2 * FEATURES, np.int64)
    number = {n: k for k, n in enumerate(names)}
    for b in batches:
        _, slices = text_features(b["_text"])
        lang = np.array([number[x] for x in b["declared"].to_pylist()], np.int64)
        for feature, doc in slices:
            found, times = np.unique(lang[doc] * (2 * FEATURES) + feature, return_counts=True)
            total[found] += times
    place = np.flatnonzero(total)
    yield pa.record_batch([pa.array(place), pa.array(total[place])], ["place", "n"])


def _score(batches: Iterator[pa.RecordBatch], shared) -> Iterator[pa.RecordBatch]:
    """shared: the broadcast (languages, features) log-probabilities."""
    for b in batches:
        words, slices = text_features(b["_text"])
        ll, n = np.zeros((len(words), len(shared.value))), np.zeros(len(words))
        for feature, doc in slices:
            if len(doc):
                first, last = int(doc[0]), int(doc[-1]) + 1
                n[first:last] += np.bincount(doc - first, minlength=last - first)
                for k, weight in enumerate(shared.value):
                    ll[first:last, k] += np.bincount(doc - first, weights=weight[feature], minlength=last - first)
        # as if only so many of n dependent features were seen
        ll *= (np.minimum(n, 4 * np.sqrt(n)) / np.maximum(n, 1))[:, None]
        flat = pa.ListArray.from_arrays(pa.array(np.arange(len(words) + 1) * ll.shape[1], pa.int32()), pa.array(ll.reshape(-1)))
        yield pa.record_batch([b["_id"], b["declared"], b["suffix"], b["host"], flat, pa.array(words)], ["_id", "declared", "suffix", "host", "ll", "words"])


def _softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def _matrix(b: pa.RecordBatch, name: str, width: int) -> np.ndarray:
    return np.array(b[name].flatten().to_numpy(zero_copy_only=False)).reshape(-1, width)


def _sums(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[pa.RecordBatch]:
    """Text-only posteriors, to be summed by host and so on."""
    for b in batches:
        post = _softmax(_matrix(b, "ll", width)) * (b["words"].to_numpy() > 0)[:, None]
        yield pa.record_batch([b["declared"], b["suffix"], b["host"], *[pa.array(post[:, k]) for k in range(width)]], ["declared", "suffix", "host", *[f"p{k}" for k in range(width)]])


def _fuse(batches: Iterator[pa.RecordBatch], names: list[str], declared: dict, suffix: dict) -> Iterator[pa.RecordBatch]:
    width = len(names)
    for b in batches:
        ll = _matrix(b, "ll", width)
        total = ll + np.log(_matrix(b, "prior", width))
        for column, table_ in (("declared", declared), ("suffix", suffix)):
            other = table_.get("other", np.zeros(width))
            total += np.array([table_.get(x, other) for x in b[column].to_pylist()])
        post = _softmax(total)
        best, there = post.argmax(axis=1), b["words"].to_numpy() > 0
        sure = post[np.arange(len(post)), best]
        name = [names[k] if t else "und" for k, t in zip(best, there, strict=True)]
        alone = [names[k] if t else "und" for k, t in zip(ll.argmax(axis=1), there, strict=True)]
        yield pa.record_batch([b["_id"], b["declared"], pa.array(name), pa.array(alone), pa.array(np.where(there, sure, 0.0)), pa.array(there & (sure >= CONFIDENT))], ["doc_id", "declared", "language", "text_language", "confidence", "kept"])


def _keep(batches: Iterator[pa.RecordBatch], weight, names: list[str], declared: dict, suffix: dict) -> Iterator[pa.RecordBatch]:
    """The packed rows that are kept, each by its own posterior."""
    for b in batches:
        scored = next(_score(iter([b]), weight))
        scored = pa.RecordBatch.from_arrays([*scored.columns, b["prior"]], [*scored.schema.names, "prior"])
        kept = next(_fuse(iter([scored]), names, declared, suffix))["kept"]
        yield pa.record_batch([b["_row"].filter(kept)], ["_row"])


OUT = "doc_id long, declared string, language string, text_language string, confidence double, kept boolean"


def _inputs(rows: DataFrame, *more: str) -> DataFrame:
    return rows.select(F.coalesce("_id", F.lit(NULL_ID)).alias("_id"), F.coalesce("_text", F.lit("")).alias("_text"), F.lower("declared").alias("declared"), F.pmod(F.xxhash64(F.coalesce(F.lower("suffix"), F.lit(""))), F.lit(SUFFIXES)).cast("int").alias("suffix"), F.coalesce("host", F.lit("")).alias("host"), *more)


def _fit(rows: DataFrame):
    """(scored rows, names, weight, P(declared), P(suffix), hosts' priors), or None without a declared language."""
    spark = rows.sparkSession
    many = {r["declared"]: r["count"] for r in rows.filter("declared is not null").groupBy("declared").count().collect()}
    names = sorted(many)
    if not names:
        return None
    width = len(names)
    # hashes thin every language out to about twice SAMPLE rows, of which the least ones are taken
    share = F.create_map(*[F.lit(x) for n in names for x in (n, min(1.0, 2 * SAMPLE / many[n]))])
    thinned = rows.filter("declared is not null").select("_text", "declared", F.xxhash64("_id", F.length("_text")).alias("_hash")).filter(F.pmod("_hash", F.lit(1 << 30)) < share[F.col("declared")] * (1 << 30))
    chosen = thinned.withColumn("_place", F.row_number().over(Window.partitionBy("declared").orderBy("_hash", "_text"))).filter(F.col("_place") <= SAMPLE)
    counts = np.full((width, 2 * FEATURES), 0.1)
    found = chosen.select("_text", "declared").mapInArrow(lambda it: _count(it, names), "place long, n long").groupBy("place").agg(F.sum("n").alias("n")).toArrow()
    counts.reshape(-1)[found["place"].to_numpy()] += found["n"].to_numpy()
    for half in (slice(0, FEATURES), slice(FEATURES, 2 * FEATURES)):
        counts[:, half] /= counts[:, half].sum(axis=1, keepdims=True)
    weight = spark.sparkContext.broadcast(np.log(counts).astype(np.float32))
    scored = stored(rows.select("_id", "_text", "declared", "suffix", "host").mapInArrow(lambda it: _score(it, weight), "_id long, declared string, suffix int, host string, ll array<double>, words long"), "languages")
    posts = scored.select("declared", "suffix", "host", "ll", "words").mapInArrow(lambda it: _sums(it, width), "declared string, suffix int, host string, " + ", ".join(f"p{k} double" for k in range(width)))
    sums = [F.sum(f"p{k}").alias(f"p{k}") for k in range(width)]
    small = stored(posts.groupBy("declared", "suffix", "host").agg(*sums), "evidence")

    def likelihood(column: str, kinds: int) -> dict:
        """log P(value | language) for the values of a bounded column."""
        got = {r[column]: np.array([r[f"p{k}"] for k in range(width)]) for r in small.groupBy(column).agg(*sums).collect()}
        whole = sum(got.values(), np.zeros(width))
        return {v: np.log((x + 1.0) / (whole + kinds)) for v, x in got.items()}

    declared, suffix = likelihood("declared", width + 2), likelihood("suffix", max(2, SUFFIXES // 64))
    whole = small.agg(*sums).first()
    base = np.array([(whole[f"p{k}"] or 0.0) + 1.0 for k in range(width)])
    base /= base.sum()
    # host towards domain (its last two labels) towards the whole
    domain = F.regexp_extract("host", r"([^.]*\.?[^.]*)$", 1)
    hosts = small.groupBy("host").agg(*sums).withColumn("domain", domain)
    domains = hosts.groupBy("domain").agg(*[F.sum(f"p{k}").alias(f"d{k}") for k in range(width)])
    n_host, n_domain = sum((F.col(f"p{k}") for k in range(1, width)), F.col("p0")), sum((F.col(f"d{k}") for k in range(1, width)), F.col("d0"))
    smooth = [(F.col(f"p{k}") + STRENGTH * (F.col(f"d{k}") + STRENGTH * float(base[k])) / (n_domain + STRENGTH)) / (n_host + STRENGTH) for k in range(width)]
    priors = hosts.join(domains, "domain").select("host", F.array(*smooth).alias("prior"))
    return scored, names, weight, declared, suffix, priors


def identify(rows: DataFrame) -> DataFrame:
    """rows: _id, _text, declared, suffix, host (strings or null). One row out for each row in."""
    small_batches(rows.sparkSession)
    rows = _inputs(rows)
    model = _fit(rows)
    if model is None:
        return rows.select(real_id("_id").alias("doc_id"), "declared", F.lit("und").alias("language"), F.lit("und").alias("text_language"), F.lit(0.0).alias("confidence"), F.lit(False).alias("kept"))
    scored, names, _, declared, suffix, priors = model
    fused = scored.join(priors, "host").select("_id", "declared", "suffix", "ll", "words", "prior")
    return fused.mapInArrow(lambda it: _fuse(it, names, declared, suffix), OUT).withColumn("doc_id", real_id("doc_id"))


def _evidence(id_col: str = "doc_id", text_col: str = "text", declared_col: str = "lang", host_col: str = "source") -> list:
    return [F.col(f"`{id_col}`").cast("long").alias("_id"), F.col(f"`{text_col}`").alias("_text"), F.col(f"`{declared_col}`").alias("declared"), F.lit(None).cast("string").alias("suffix"), F.col(f"`{host_col}`").alias("host")]


def of_documents(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", declared_col: str = "lang", host_col: str = "source") -> DataFrame:
    """Documents: the declared language is a column, the source stands for the host, there is no address."""
    return identify(df.select(*_evidence(id_col, text_col, declared_col, host_col)))


def of_pages(pages: DataFrame) -> DataFrame:
    """Pages (page_id, url, html; text as html_text.extract() puts beside them): markup language, suffix and host come from html and url. One row out for each row in."""
    markup = F.nullif(F.regexp_extract("html", r"(?i)<html\b[^>]*?\blang\s*=\s*[\"']?([A-Za-z]{2,3})", 1), F.lit(""))
    host = F.lower(F.regexp_extract("url", r"^[a-zA-Z]+://(?:[^/@]*@)?([^/:?#]+)", 1))
    code, top = F.regexp_extract("url", r"^[a-zA-Z]+://[^/]+/([a-z]{2})(?:[/?#]|$)", 1), F.regexp_extract(host, r"\.([a-z]+)$", 1)
    return identify(pages.select(F.col("page_id").cast("long").alias("_id"), F.col("text").alias("_text"), markup.alias("declared"), F.when(code != "", code).otherwise(top).alias("suffix"), host.alias("host")))


def keep_identified(df: DataFrame) -> DataFrame:
    """df without the rejected rows, all columns as they were; each row is judged by itself, whatever its id."""
    small_batches(df.sparkSession)
    packed = df.select(*_evidence(), F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("_row"))
    model = _fit(_inputs(df.select(*_evidence())))
    if model is None:
        return df.filter(F.lit(False))
    _, names, weight, declared, suffix, priors = model
    rows = _inputs(packed, "_row").join(priors, "host")
    kept = rows.mapInArrow(lambda it: _keep(it, weight, names, declared, suffix), T.StructType([packed.schema["_row"]]))
    return kept.select([F.col("_row").getField(c).alias(c) for c in df.columns])


def op8_language_id(spark, sf_dir: str) -> DataFrame:
    return of_documents(table(spark, sf_dir, "documents"))


def language_id_pages(spark, sf_dir: str) -> DataFrame:
    from skein.llm import html_text

    return of_pages(html_text.extract(table(spark, sf_dir, "pages"), with_html=True)).withColumnRenamed("doc_id", "page_id")
