"""Both trained operators against plain versions: one row at a time, without slices, partial sums or Spark."""

import math
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from skein.llm import html_text, language_id, quality
from skein.llm.common import mix64, table, word_hashes

# -- language identification ------------------------------------------------------------------------------------------


def features(text):
    raw = bytes(c + 32 if 65 <= c <= 90 else c for c in text.encode())
    words = re.findall(rb"[^\x20\x09-\x0D]+", raw)
    hashed = [int(word_hashes(np.frombuffer(w, np.uint8), np.array([0, len(w)]))[0][0]) >> 49 for w in words]
    tri = [raw[k] << 16 | raw[k + 1] << 8 | raw[k + 2] for k in range(len(raw) - 2)]
    return hashed + [language_id.FEATURES + (int(x) >> 49) for x in mix64(np.array(tri, np.uint64))], len(words)


def softmax(x):
    e = [math.exp(v - max(x)) for v in x]
    return [v / sum(e) for v in e]


def plain_languages(rows, fused=True):
    """{id: (language, language by the text, confidence)} of rows (id, text, declared, suffix, host)."""
    found = {i: features(t or "") for i, t, *_ in rows}
    names = sorted({d.lower() for _, _, d, _, _ in rows if d})
    counts = {n: Counter() for n in names}
    for i, _, d, _, _ in rows:
        if d:
            counts[d.lower()].update(found[i][0])
    F = language_id.FEATURES
    whole = {n: [0.1 * F + sum(c for f, c in counts[n].items() if f // F == half) for half in (0, 1)] for n in names}
    ll, post, evidence = {}, {}, {"declared": defaultdict(lambda: [0.0] * len(names)), "suffix": defaultdict(lambda: [0.0] * len(names)), "host": defaultdict(lambda: [0.0] * len(names)), "domain": defaultdict(lambda: [0.0] * len(names))}
    for i, _, d, s, h in rows:
        fs, n_words = found[i]
        n = len(fs)
        ll[i] = [sum(float(np.float32(math.log((counts[x][f] + 0.1) / whole[x][f // F]))) for f in fs) * min(n, 4 * math.sqrt(n)) / max(n, 1) for x in names]
        post[i] = softmax(ll[i]) if n_words else [0.0] * len(names)
        for kind, value in (("declared", d.lower() if d else None), ("suffix", (s or "").lower()), ("host", h or ""), ("domain", re.search(r"([^.]*\.?[^.]*)$", h or "")[1])):
            evidence[kind][value] = [a + b for a, b in zip(evidence[kind][value], post[i], strict=True)]
    total = [sum(p[k] for p in post.values()) for k in range(len(names))]
    base = [(t + 1) / (sum(total) + len(names)) for t in total]
    out, S = {}, language_id.STRENGTH
    for i, _, d, s, h in rows:
        score = list(ll[i])
        for k in range(len(names)) if fused else ():
            host, domain = evidence["host"][h or ""], evidence["domain"][re.search(r"([^.]*\.?[^.]*)$", h or "")[1]]
            score[k] += math.log((host[k] + S * (domain[k] + S * base[k]) / (sum(domain) + S)) / (sum(host) + S))
            score[k] += math.log((evidence["declared"][d.lower() if d else None][k] + 1) / (total[k] + len(names) + 2))
            score[k] += math.log((evidence["suffix"][(s or "").lower()][k] + 1) / (total[k] + max(2, language_id.SUFFIXES // 64)))
        p = softmax(score)
        there = found[i][1] > 0
        out[i] = (names[p.index(max(p))], names[ll[i].index(max(ll[i]))], max(p)) if there else ("und", "und", 0.0)
    return out


def same(got, want):
    assert got.keys() == want.keys()
    for i, r in got.items():
        assert (r.language, r.text_language) == want[i][:2] and r.confidence == pytest.approx(want[i][2], abs=1e-4)
        assert r.kept == (want[i][2] >= language_id.CONFIDENT)


def test_languages_of_documents_equal_a_plain_version(spark, sf):
    docs = table(spark, sf, "documents").filter("n_chars < 4000")
    rows = [(r.doc_id, r.text, r.lang, None, r.source) for r in docs.collect()]
    same({r.doc_id: r for r in language_id.of_documents(docs).collect()}, plain_languages(rows))


def test_languages_of_pages_equal_a_plain_version(spark, sf):
    pages = table(spark, sf, "pages").collect()
    rows = []
    for r in pages:
        lang, host = re.search(r"(?i)<html\b[^>]*?\blang\s*=\s*[\"']?([A-Za-z]{2,3})", r.html), re.match(r"[a-zA-Z]+://(?:[^/@]*@)?([^/:?#]+)", r.url)
        host = host[1].lower() if host else ""
        code, top = re.match(r"[a-zA-Z]+://[^/]+/([a-z]{2})(?:[/?#]|$)", r.url), re.search(r"\.([a-z]+)$", host)
        rows.append((r.page_id, " ".join(html_text.main_blocks(r.html)), lang[1] if lang else None, code[1] if code else top[1] if top else "", host))
    same({r.page_id: r for r in language_id.language_id_pages(spark, sf).collect()}, plain_languages(rows))


def test_each_kind_of_evidence_changes_results(spark):
    """Short texts that say little: hosts, declarations and suffixes turn some of them; without fusing none."""
    en, de = "the of and with that ", "der die und mit das "
    rows = [(i, (en if i % 2 else de) * 8, "en" if i % 2 else "de", "en" if i % 2 else "de", "en.example" if i % 2 else "de.example") for i in range(60)]
    rows += [(100 + k, "xq the", d, s, h) for k, (d, s, h) in enumerate((d, s, h) for d in ("de", None) for s in ("de", None) for h in ("de.example", "new.site"))]
    rows += [(200, "zz", "DE", None, None), (201, "", "de", "de", "de.example"), (202, None, None, None, None)]
    got = {r.doc_id: r for r in language_id.identify(spark.createDataFrame(rows, "_id long, _text string, declared string, suffix string, host string")).collect()}
    want, alone = plain_languages(rows), plain_languages(rows, fused=False)
    same(got, want)
    assert sum(want[i][0] != alone[i][0] for i in range(100, 108)) >= 3


def test_more_languages_than_thirty_two(spark):
    rows = [(40 * k + i, " ".join(f"{chr(97 + k % 26)}{chr(97 + k // 26)}{w}" for w in range(i, i + 12)), f"l{k:02d}", None, None) for k in range(40) for i in range(10)]
    got = language_id.identify(spark.createDataFrame(rows, "_id long, _text string, declared string, suffix string, host string")).collect()
    assert all(r.language == r.declared and r.kept for r in got) and len({r.language for r in got}) == 40


def test_pages_are_judged_one_by_one(spark):
    page = "<html lang=en><article><p>the of and with that the of and with that the of and with that the of and</p></article>"
    df = spark.createDataFrame([(1, "http://a.example/", page), (1, "http://a.example/", page), (None, "http://b.example/", page), (2, None, None)], "page_id long, url string, html string")
    got = language_id.of_pages(html_text.extract(df, with_html=True)).collect()
    assert sorted((r.doc_id or 0, r.language) for r in got) == [(0, "en"), (1, "en"), (1, "en"), (2, "und")]


# -- quality ----------------------------------------------------------------------------------------------------------


def text_numbers(text):
    raw = text.encode()
    kinds = Counter()
    for c in raw:
        s = chr(c)
        kinds["lower" if "a" <= s <= "z" or c >= 128 else "upper" if "A" <= s <= "Z" else "digit" if s.isdigit() else "marks" if s in ".,;:'\"-" else "bars" if s == "|" else "space" if c in (9, 10, 11, 12, 13, 32) else "symbols"] += 1
    words = re.findall(rb"[^\x20\x09-\x0D]+", raw.lower())
    n, size = max(1, len(words)), max(1, len(raw))
    times = Counter(words)
    mean = (len(raw) - kinds["space"]) / n
    return [kinds[k] / size for k in quality.TEXT[:7]] + [mean, len(times) / math.sqrt(n), sum(a == b for a, b in zip(words, words[1:], strict=False)) / n, max(times.values(), default=0) / n, len(words) / (raw.count(b"\n") + 1), max(mean - 8, 0), math.log1p(len(words))]


def logistic(score, good):
    """Slope and intercept of least loss, for each slope the best intercept, both by halving intervals; the base rate where the slope is not positive."""
    base = math.log((sum(good) + 1) / (len(good) - sum(good) + 1))
    rate = lambda v: 1 / (1 + math.exp(-max(-500.0, min(500.0, v))))

    def halved(f, low, high):
        for _ in range(80):
            middle = (low + high) / 2
            low, high = (middle, high) if f(middle) < 0 else (low, middle)
        return (low + high) / 2

    def intercept(a):
        return halved(lambda c: sum(rate(a * s + c) - y for s, y in zip(score, good, strict=True)), -3000, 3000)

    def slope(a):
        c = intercept(a)
        return sum((rate(a * s + c) - y) * s for s, y in zip(score, good, strict=True)) + 0.01 * a

    a = halved(slope, -300, 300)
    return (a, intercept(a)) if a > 0 else (0.0, base)


def plain_quality(docs, labels, rounds=quality.ROUNDS):
    """{id: (text score, metadata score, score)} of docs {id: (text, source, lang)} with labels {id: 0 or 1}."""
    x = {i: text_numbers(t or "") for i, (t, _, _) in docs.items()}
    m = {i: (math.floor(math.log2(len(t or "") + 1) * 2), s, g) for i, (t, s, g) in docs.items()}
    ids = sorted(i for i in labels if i in docs)
    held = [i for k, i in enumerate(ids) if k % 5 == 4]
    edges = [np.quantile([x[i][k] for i in ids], quality.QUANTILES) for k in range(len(quality.TEXT))]
    bins = {i: [k * (quality.BINS + 1) + sum(v >= e for e in edges[k]) for k, v in enumerate(x[i])] for i in docs}
    width = len(quality.TEXT) * (quality.BINS + 1)
    base = math.log((sum(labels[i] for i in held) + 1) / (sum(1 - labels[i] for i in held) + 1))
    train = [i for i in ids if i not in set(held)]
    taught = [(i, labels[i], 1.0) for i in train], [(i, labels[i], 1.0) for i in train]
    for turn in range(rounds + 1):
        z, y, w = np.zeros((len(taught[0]), width)), np.array([2.0 * c - 1 for _, c, _ in taught[0]]), np.array([v for _, _, v in taught[0]])
        for k, (i, _, _) in enumerate(taught[0]):
            z[k, bins[i]] = 1
        odds = np.linalg.solve((z * w[:, None]).T @ z + np.eye(width), (z * w[:, None]).T @ y)
        counts = [defaultdict(lambda: [0.0, 0.0]) for _ in range(3)]
        for i, c, v in taught[1]:
            for k in range(3):
                counts[k][m[i][k]][c] += v
        sums = [sum(v[c] for n in counts for v in n.values()) for c in (0, 1)]
        rate = [(s + 1) / (sum(sums) + 2) for s in sums]

        def meta(i):
            out = base
            for k in range(3):
                p = [(counts[k][m[i][k]][c] + 10 * rate[c]) / (sum(v[c] for v in counts[k].values()) + 10 * rate[c] * quality.HASHED) for c in (0, 1)]  # noqa: B023
                out += math.log(p[1]) - math.log(p[0])
            return out

        scores = {i: (float(odds[bins[i]].sum()), meta(i)) for i in docs}
        curve = [logistic([scores[i][v] for i in held], [labels[i] for i in held]) for v in (0, 1)]
        sure = {i: [a * s + c for (a, c), s in zip(curve, scores[i], strict=True)] for i in docs}
        if turn < rounds:
            limit = math.log(quality.SURE / (1 - quality.SURE))
            free = [i for i in docs if i not in labels]
            taught = tuple([(i, labels[i], 1.0) for i in train] + [(i, int(sure[i][1 - v] > 0), quality.PSEUDO) for i in free if abs(sure[i][1 - v]) > limit] for v in (0, 1))
    one = lambda v: 1 / (1 + math.exp(-max(-50.0, min(50.0, v))))
    return {i: (one(a), one(b), one(a + b - base)) for i, (a, b) in sure.items()}


def compare(spark, docs, labels):
    df = spark.createDataFrame([(i, t, g, s) for i, (t, s, g) in docs.items()], "doc_id long, text string, lang string, source string")
    marks = spark.createDataFrame([(i, q) for i, q in labels.items()], "doc_id long, quality int")
    want = plain_quality(docs, labels)
    got = {r.doc_id: r for r in quality.score(df.repartition(3), marks).collect()}
    assert got.keys() == want.keys()
    for i, r in got.items():
        assert (r.text_score, r.metadata_score, r.score) == pytest.approx(want[i], abs=1e-3) and (r.kept == (want[i][2] >= quality.KEEP) or abs(want[i][2] - quality.KEEP) < 1e-3)
    return want


def test_quality_of_documents_equals_a_plain_version(spark, sf):
    docs = {r.doc_id: (r.text, r.source, r.lang) for r in table(spark, sf, "documents").collect()}
    compare(spark, docs, {r.doc_id: r.quality for r in table(spark, sf, "labels").collect() if r.doc_id in docs})


def test_views_exchange_what_they_are_sure_of(spark):
    """Against the plain version; without rounds the scores are others."""
    docs, labels = {}, {}
    for i in range(400):
        good, known = i % 2, i % 3
        text = ("the man went to the house and saw that it was good " if good else "|| || %% || $$ ") * (3 + i % 4) if known else "word " * 9
        docs[i] = (text, ("good" if good else "bad") + str(i % 5), "en")
        if i % 7 == 0:
            labels[i] = good
    want, alone = compare(spark, docs, labels), plain_quality(docs, labels, 0)
    assert sum(abs(want[i][2] - alone[i][2]) > 0.01 for i in docs) > 50


def test_a_view_against_the_labels_stays_at_the_base_rate():
    rng = np.random.default_rng(3)
    good = (rng.random(400) < 0.8).astype(float)
    a, c = quality.platt(-2 * good + rng.normal(size=400), good)
    assert a == 0 and c == pytest.approx(math.log((good.sum() + 1) / ((1 - good).sum() + 1)))
