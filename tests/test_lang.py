import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from skein.functions import scalars as S
from skein.functions.diffs import OLD, Diff, difference
from skein.plans import lang
from skein.plans.lang import Clause, Group, parse, tokenize
from skein.plans.predicates import View, compile_any


def test_tokens():
    assert [t.text for t in tokenize("READ a, 'b c' x='y z' # note\n // more\n d\\ e %1 k=%2", ["one", "two"])] == ["READ", "a", "b c", "x=y z", "d e", "one", "k=two"]
    with pytest.raises(lang.SyntaxProblem):
        tokenize("READ 'open")


def test_statements():
    s = parse("READ id name WHERE region=ASIA price >= 3 OR name has 'a b' AND x EMPTY FOLLOW WHERE parent_id=parent.id REPEATFOLLOW a!=parent.b UNTIL stop=1 ASSERT z==2 LIMIT 5 PAGE 2 AS 7")
    assert (s.columns, s.limit, s.page, s.tx) == (["id", "name"], 5, 2, 7)
    assert s.groups == [
        Group("where", [Clause("region", "=", "ASIA"), Clause("price", ">=", "3")]), Group("where", [Clause("name", "has", "a b"), Clause("x", "empty")], True), Group("follow", [Clause("parent_id", "=", "parent.id")]),
        Group("repeat", [Clause("a", "!=", "parent.b")]), Group("until", [Clause("stop", "=", "1")]), Group("assert", [Clause("z", "==", "2")]),
    ]
    s = parse("WRITE id=5 name='x y' empty= WHERE id=5")
    assert s.values == {"id": "5", "name": "x y", "empty": ""} and s.groups[0].clauses == [Clause("id", "=", "5")]
    assert parse("CAT[2:5] /a").span == (2, 5) and parse("CAT /a[4]").span == (4, 5) and parse("CAT /a[:3]").span == (0, 3) and parse("CAT /a[5:]").span == (5, 0)
    assert parse("READ * WHERE a=1").columns == [] and parse("READ* WHERE a=1").columns == [] and parse("FROB x").verb == "FROB"
    with pytest.raises(lang.SyntaxProblem):
        parse("READ a WHERE b")


def plain(clause, row):
    """What a clause means, row by row."""
    c, v = row.get(clause.col) or "", clause.value
    num = S.number_of
    if clause.op == "empty":
        return c == ""
    if clause.op == "=":
        return c == v
    if clause.op == "!=":
        return c != v
    if clause.op == "has":
        return v in c
    if clause.op == "!has":
        return v not in c
    a, b = num(c), num(v)
    if a is None or b is None:
        return False
    return {"==": a == b, "<": a < b, ">": a > b, "<=": a <= b, ">=": a >= b}[clause.op]


def test_predicates_equal_the_plain_meaning(spark):
    rng = random.Random(5)
    words = ["", None, "a", "b", "ab", "30", "30abc", " 7 ", "-1.5e1x", ".5", "x9", "1e", "+3"]
    rows = [{"k": i, "x": rng.choice(words) or None, "y": rng.choice(words) or None} for i in range(200)]
    df = spark.createDataFrame([(r["k"], r["x"], r["y"]) for r in rows], "k int, x string, y string").cache()
    ops = ["=", "!=", "==", "<", ">", "<=", ">=", "has", "!has", "empty"]
    for _ in range(40):
        groups = [Group("where", [Clause(rng.choice("xyz"), rng.choice(ops), rng.choice([w for w in words if w is not None])) for _ in range(rng.randint(1, 3))], g > 0) for g in range(rng.randint(1, 3))]
        got = {r.k for r in df.filter(compile_any(groups, View(df))).collect()}
        assert got == {r["k"] for r in rows if any(all(plain(c, r) for c in g.clauses) for g in groups)}, groups


def test_filters_reach_the_scan(spark, sf):
    df = spark.read.parquet(f"{sf}/customer.parquet")
    plan = df.filter(compile_any([Group("where", [Clause("c_mktsegment", "=", "BUILDING"), Clause("c_acctbal", ">", "5000"), Clause("c_name", "has", "00")])], View(df))).select("c_custkey")
    text = plan._jdf.queryExecution().explainString(plan.sparkSession._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))
    assert "EqualTo(c_mktsegment,BUILDING)" in text and "GreaterThan(c_acctbal,5000" in text and "StringContains(c_name,00)" in text


@settings(max_examples=200, deadline=None)
@given(st.binary(max_size=60), st.binary(max_size=60), st.integers(0, 40), st.integers(0, 20))
def test_diffs(a, b, at, n):
    d = difference(a, b)
    assert d.content(a) == b and Diff.unpack(d.pack()).spans == d.spans
    d.splice(min(at, len(b)), n, b"zz")
    at = min(at, len(b))
    assert d.content(a) == b[:at] + b"zz" + b[at + n :]


def test_diff_edits():
    old, new = b"the quick brown fox jumps over the lazy dog", b"the quick brown cat jumps over the lazy dog"
    d = difference(old, new)
    assert sum(source == OLD for source, _, _ in d.spans) >= 2 and d.content(old) == new
    d = difference(b"abXYZfgh", b"abXYZfgh")
    d.splice(0, 1, b"z")
    assert d.content(b"abXYZfgh") == b"zbXYZfgh"
    d.splice(2, 3, b"12")
    assert d.content(b"abXYZfgh") == b"zb12fgh"


def test_patterns():
    import re

    cases = [("*.cpp", "/a.cpp", True), ("/a/**", "/a", True), ("/a/**", "/a/b/c", True), ("/a/*", "/a/b/c", False), (r"/a/\*", "/a/*", True), (r"/a/\*", "/a/b", False), (r"/a/.*\.cpp", "/a/x.cpp", True), ("/**/f?.txt", "/r/d/f1.txt", True), ("/a/(b|c)", "/a/c", True)]
    for pattern, path, want in cases:
        assert bool(re.search(S.path_regex(pattern), path)) == want, pattern
    assert S.literal_prefix("/a/b/*/c") == "/a/b" and S.literal_prefix("*") == ""


def test_shell_paths():
    from skein.shell import resolve, rewrite

    assert resolve("/a/b", "../c/./d") == "/a/c/d" and resolve("/a", "/x//y/..") == "/x" and resolve("/", "..") == "/"
    assert rewrite("/a", "CP x /y") == "CP /a/x /y" and rewrite("/a", "LS") == "LS /a" and rewrite("/a", "READ * WHERE x=1") == "READ * WHERE x=1" and rewrite("/a", "CAT[2:5] f") == "CAT[2:5] /a/f"


def test_signature_is_a_keyed_digest(spark):
    import hashlib
    import hmac

    from pyspark.sql import functions as F

    df = spark.createDataFrame([("x", "y"), (None, "z")], "b string, a string")
    for key in (b"k", b"long" * 40):
        got = [r[0] for r in df.select(S.signature({"b": F.col("b"), "a": F.col("a")}, key)).collect()]
        assert got == [hmac.new(key, text, hashlib.sha256).hexdigest() for text in (b"a=y;b=x;", b"a=z;b=;")]


def test_encryption_and_byte_edits(spark):
    from pyspark.sql import functions as F

    key, wrong = b"0123456789abcdef", b"fedcba9876543210"
    row = spark.createDataFrame([("0123456789",)], "c string").select(
        S.decrypt(S.encrypt(F.col("c"), key), [wrong, key]).alias("ok"), S.decrypt(S.encrypt(F.col("c"), key), [wrong]).alias("no"),
        *[S.byte_slice(F.col("c"), a, b).alias(f"s{k}") for k, (a, b) in enumerate([(2, 5), (5, None), (None, 5), (12, None), (0, 0)])],
        S.overwrite_at(F.col("c"), F.lit("ab"), 12).alias("gap"), S.insert_at(F.col("c"), F.lit("ab"), 12).alias("late"),
    ).first()
    assert bytes(row.ok) == b"0123456789" and row.no is None
    assert [bytes(row[f"s{k}"]) for k in range(5)] == [b"234", b"56789", b"01234", b"", b"0123456789"]
    assert bytes(row.gap) == bytes(row.late) == b"0123456789\0\0ab"
