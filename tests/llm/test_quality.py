from pyspark.sql import functions as F

from skein.llm import exact_dedup, quality
from skein.llm.common import table


def test_held_out_accuracy(spark, sf):
    big = sf.replace("sf0.001", "sf0.1")
    docs, labels = table(spark, big, "documents"), table(spark, big, "labels")
    shown, hidden = labels.filter("doc_id % 3 > 0"), labels.filter("doc_id % 3 = 0")
    got = quality.score(docs, shown).join(hidden, "doc_id").select("kept", "quality", "metadata_score").collect()
    good, bad = [r.kept for r in got if r.quality], [r.kept for r in got if not r.quality]
    assert sum(good) >= 0.99 * len(good) and sum(bad) <= 0.05 * len(bad)


def test_views_teach_each_other(spark):
    """The source tells the quality of most rows, the text that of the others; labels are few."""
    rows, labels = [], []
    for i in range(900):
        good, known = i % 2, i % 3
        text = ("the man went to the house and saw that it was good " if good else "|| || %% || $$ ") * (3 + i % 4) if known else "word " * 9
        rows.append((i, text, "en", ("good" if good else "bad") + str(i % 5), len(text)))
        if i % 7 == 0:
            labels.append((i, good, 0))
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    got = {r.doc_id: r for r in quality.score(docs, spark.createDataFrame(labels, "doc_id long, quality int, toxic int")).collect()}
    assert sum(got[i].kept == bool(i % 2) for i in range(900)) >= 0.95 * 900


def test_odd_rows(spark, odd_docs, no_docs, sf):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert [r.kept for r in quality.score(odd_docs, none).collect()] == [True] * odd_docs.count()
    labels = table(spark, sf, "labels").unionByName(spark.createDataFrame([(None, 1, 0), (4, None, None), (1, 1, 0), (1, 0, 0)], "doc_id long, quality int, toxic int"))
    docs = table(spark, sf, "documents").unionByName(odd_docs, allowMissingColumns=True)
    assert quality.score(docs, labels).count() == docs.count()
    kept = quality.keep_good(docs, labels)
    assert kept.columns == docs.columns and kept.count() == quality.score(docs, labels).filter("kept").count()
    assert quality.score(no_docs, labels).count() == 0 and quality.keep_good(no_docs, labels).count() == 0


def test_exact_dedup(spark, sf, odd_docs, no_docs, monkeypatch):
    rows = exact_dedup.decisions(odd_docs).collect()
    key = lambda r: (r.doc_id is not None, r.doc_id or 0, r.kept)
    got = [(r.doc_id, r.keep_id, r.group_size, r.kept) for r in sorted(rows, key=key)]
    assert got == [(None, 4, 3, False), (None, None, 1, True), (1, 2, 3, False), (1, 2, 3, False), (2, 2, 3, True), (3, 4, 3, False), (4, 4, 3, True), (6, 6, 1, True), (7, 7, 1, True), (8, 8, 1, True), (9, 9, 1, True)]
    assert exact_dedup.decisions(no_docs).count() == 0 and exact_dedup.distinct_rows(odd_docs).columns == odd_docs.columns
    assert sorted(r.doc_id or 0 for r in exact_dedup.distinct_rows(odd_docs).collect()) == [0, 2, 4, 6, 7, 8, 9]


def test_exact_dedup_without_large_runs_stores_nothing_on_the_way(spark, monkeypatch):
    made = []
    monkeypatch.setattr(exact_dedup, "shared_dir", lambda s, label, f=exact_dedup.shared_dir: made.append(label) or f(s, label))
    df = spark.createDataFrame([(k, f"text {k % 7}") for k in range(50)], "doc_id long, text string")
    got = {(r.doc_id, r.keep_id, r.kept) for r in exact_dedup.decisions(df).collect()}
    assert got == {(k, max(range(k % 7, 50, 7)), k + 7 >= 50) for k in range(50)} and not made


def test_exact_dedup_of_large_runs(spark, monkeypatch):
    """Runs over the limit are streamed or dealt out by further digits; results stay those of a plain grouping."""
    import random

    rng = random.Random(3)
    stem = "s" * 300
    texts = [stem + rng.choice("ab") * 40 + rng.choice(["", "x"]) for _ in range(400)] + ["same"] * 300 + [f"{stem}{i:040d}" for i in range(200)] + ["", None]
    rng.shuffle(texts)
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)
    want = {r.doc_id: tuple(r) for r in df.withColumn("t", F.coalesce("text", F.lit(""))).selectExpr("doc_id", "max(doc_id) over (partition by t) keep_id", "count(*) over (partition by t) group_size").collect()}
    for chunk, run in ((200, 2000), (200, 300), (5000, 100_000), (1 << 20, 50)):
        monkeypatch.setattr(exact_dedup, "CHUNK_BYTES", chunk)
        monkeypatch.setattr(exact_dedup, "RUN_BYTES", run)
        got = exact_dedup.decisions(df).collect()
        assert {r.doc_id: (r.doc_id, r.keep_id, r.group_size) for r in got} == want
        assert all(r.kept == (r.doc_id == r.keep_id) for r in got)
