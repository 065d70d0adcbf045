"""The scenarios of a multi-model store, end to end."""

import random

import pytest
from pyspark.sql import functions as F

from skein.operators import acl, blobs, graph, pipeline, versions
from skein.operators.engine import CONFLICT, LOCKED, OK, Engine
from skein.plans import lang
from skein.plans.lang import assert_, follow, repeat_follow, until, where
from skein.sources import tree


@pytest.fixture
def engine(spark, tmp_path):
    return Engine(spark, f"file://{tmp_path}/store")


def test_log_of_500(spark, engine):
    rows = [(str(i), "log" if i % 2 else "transaction", "failed" if i % 5 == 0 else "success") for i in range(500)]
    engine.insert_rows(spark.createDataFrame(rows, "id string, type string, status string").repartition(4))
    assert engine.query("READ id WHERE type=transaction")[0] == 250 and engine.query("READ id WHERE status=failed")[0] == 100
    assert engine.query("WRITE status=recovered WHERE status=failed")[0] == OK
    assert engine.query("READ id WHERE status=failed")[0] == 0 and engine.query("READ id WHERE status=recovered")[0] == 100
    assert engine.query("READ *")[0] == 500 and engine.query("WRITE id=7 type=other")[0] == OK and engine.query("READ * WHERE type=other")[0] == 0
    assert engine.query("WRITE x=1 ASSERT status=nothing ASSERT status=recovered WHERE id=1")[0] == 2
    assert len({r["_rid"] for r in engine._versions().select("_rid").collect()}) == 500
    again = Engine(spark, engine.path)
    assert again.query("READ id WHERE status=recovered")[0] == 100 and again.query("WRITE id=900")[0] == OK and again.query("READ *")[0] == 501


def test_watches(engine):
    seen = []
    a, b = engine.watch([where(("action", "=", "reboot"))]), engine.watch([where(("event", "has", "x"))], seen.append)
    engine.query("WRITE id=1 action:watch=reboot _type=command")
    engine.query("WRITE id=2 event=xyz")
    assert len(engine.pull(a)) == 1 and engine.pull(a) == [] and len(seen) == 1
    assert engine.query("READ * WHERE action=reboot")[0] == 0 and engine.query(f"PULL {a}")[0] == 0
    assert engine.unwatch(a) and not engine.unwatch(a)


def test_empty_and_ranges(engine):
    engine.query("WRITE id=1 exists=yes empty_val=''")
    assert engine.query("READ * WHERE empty_val=''")[0] == 1 == engine.query("READ * WHERE absent_col=''")[0]
    engine.query("WRITE exists='' WHERE id=1")
    assert engine.query("READ * WHERE exists EMPTY")[0] == 1
    engine.tee("/range_test.txt", "0123456789")
    for span, want in (("2:5", b"234"), ("5:", b"56789"), (":5", b"01234"), ("4", b"4")):
        assert bytes(engine.query(f"CAT[{span}] /range_test.txt")[1].first()[0]) == want == bytes(engine.query(f"CAT /range_test.txt[{span}]")[1].first()[0])
    engine.write({"content[+]": " APPENDED"}, [where(("name", "=", "range_test.txt"))])
    assert engine.cat("/range_test.txt") == b"0123456789 APPENDED"
    engine.write({"content[2:4]": "XY"}, [where(("name", "=", "range_test.txt"))])
    engine.write({"content[1+]": "__"}, [where(("name", "=", "range_test.txt"))])
    assert engine.cat("/range_test.txt") == b"0__1XY456789 APPENDED"


def test_paths(engine):
    for name, up in (("root", None), ("src", "root"), ("Security", "src"), ("Crypto.cpp", "Security"), ("Writ.cpp", "Security"), ("*", "Security"), ("main.cpp", "src")):
        engine.write({"id": name, "name": name, "content": "c" + name if "." in name else "", **({"parent_id": up} if up else {})})
    count = lambda p: engine.read(groups=[where(("name", "path", p))]).count()
    assert (count("root/src/Security/*.cpp"), count(r"root/src/Security/\*"), count(r"root/src/Security/.*\.cpp"), count("root/**"), count("/root/src/*")) == (2, 1, 2, 7, 2)
    assert engine.query("LS /root/src")[0] == 2 and engine.query("CP /root/src /copy/here")[0] == OK and count("/copy/here/**") == 6
    assert engine.cat("/copy/here/main.cpp") == b"cmain.cpp" == engine.cat("/root/src/main.cpp")
    assert engine.query("MV /copy/here/main.cpp /moved/m.cpp")[0] == OK and engine.cat("/moved/m.cpp") == b"cmain.cpp" and engine.cat("/copy/here/main.cpp") is None
    assert engine.query("RM /copy")[0] == OK and count("/copy/**") == 0 and engine.query("CAT /none")[0] == LOCKED


def test_snapshots_locks_and_conflicts(engine):
    engine.query("WRITE id=9100 tag=t value=v1")
    code, _ = engine.query("COMMIT")
    engine.query("WRITE value=v2 WHERE id=9100")
    old = lambda: [r.value for r in engine.query(f"READ value WHERE id=9100 AS {code}")[1].collect()]
    assert old() == ["v1"] and engine.query("READ value WHERE id=9100 value=v2")[0] == 1
    engine.query("RM WHERE id=9100")
    assert old() == ["v1"] and engine.query("READ * WHERE id=9100")[0] == 0
    engine.rollback(code)
    with pytest.raises(KeyError):
        engine.read(tx=code)
    engine.query("WRITE id=1 tag=locked_tag")
    engine.query("WRITE id=2 tag=free_tag")
    lock = engine.query("LOCK WHERE tag=locked_tag")[0]
    assert engine.query("WRITE content=x WHERE id=1")[0] == LOCKED and engine.query("WRITE content=x WHERE id=2")[0] == OK
    assert engine.query("WRITE id=3 tag=locked_tag")[0] == LOCKED and engine.query("RM WHERE id=1")[0] == LOCKED
    assert engine.query(f"WRITE content=mine WHERE id=1 AS {lock}")[0] == OK and engine.query(f"UNLOCK {lock}")[0] == OK
    assert engine.query("READ * WHERE id=1 content=mine")[0] == 1
    tx = engine.begin([where(("id", "=", "1"))], blocking=False)
    engine.write({"content": "theirs"}, [where(("id", "=", "1"))])
    engine.write({"content": "late"}, [where(("id", "=", "1"))], tx)
    assert engine.unlock(tx) == CONFLICT and engine.query("READ * WHERE content=theirs")[0] == 1
    everything = engine.begin()
    assert engine.query("WRITE id=77")[0] == LOCKED and engine.rollback(everything) and engine.query("WRITE id=77")[0] == OK


def test_burn_compact_volatile_overlay_hooks(spark, engine):
    engine.query("WRITE id=9200 tag=burn_me")
    engine.query("WRITE tag=burnt WHERE id=9200")
    engine.query("WRITE id=9201 tag=stay")
    engine.query("BURN WHERE id=9200")
    assert engine._versions().filter("id = '9200'").count() == 0 and engine.query("READ *")[0] == 1
    engine.query("WRITE tag=stays WHERE id=9201")
    engine.compact()
    assert engine._versions().count() == 1
    engine.query("WRITEVOLATILE id=5 volatile_key=k")
    assert engine.query("READ * WHERE volatile_key=k")[0] == 1 and Engine(spark, engine.path).query("READ * WHERE volatile_key=k")[0] == 0
    engine.on_read(lambda e, g: spark.createDataFrame([("99999", "overlay_test")], "id string, tag string"))
    assert engine.query("READ * WHERE tag=overlay_test")[0] == 1
    engine.on_query("PING", lambda e, text: (42, None))
    assert engine.query("ping now")[0] == 42 and engine.query("NOPE")[0] == -99
    assert engine.query("WRITE id:generate=1 tag=made")[0] == OK and engine.query("READ * WHERE tag=made")[0] == 1


def test_closures_equal_plain_search(spark):
    rng = random.Random(11)
    for size in (1, 12, 40):
        edges = [(str(i), str(rng.randrange(size)) if rng.random() < 0.9 else None, rng.random() < 0.2) for i in range(size)]
        df = spark.createDataFrame(edges, "id string, parent_id string, halt boolean").repartition(3)
        for stop in (False, True):
            seen, todo = {"0"}, ["0"]
            while todo:
                at = todo.pop()
                if stop and edges[int(at)][2]:
                    continue
                for i, up, _ in edges:
                    if up == at and i not in seen:
                        seen.add(i)
                        todo.append(i)
            groups = [where(("id", "=", "0")), repeat_follow(("parent_id", "=", "parent.id"))] + ([until(("halt", "=", "true"))] if stop else [])
            assert {r.id for r in pipeline.match(df, groups, "id").collect()} == seen


def test_theta_hops(spark):
    df = spark.createDataFrame([(i, i * i % 7, f"w{i % 4}") for i in range(30)], "id int, v int, w string")
    rows = [r.asDict() for r in df.collect()]
    for op, test in (("<", lambda a, b: a < b), (">=", lambda a, b: a >= b), ("!=", lambda a, b: a != b)):
        got = {r.id for r in pipeline.match(df, [where(("id", "<", "4")), follow(("v", op, "parent.v"), ("id", ">", "9"))], "id").collect()}
        assert got == {r["id"] for r in rows if r["id"] > 9 and any(test(r["v"], p["v"]) for p in rows if p["id"] < 4)}
    assert pipeline.match(df, [where(("id", "<", "0")), follow(("v", "<", "parent.v"))], "id").count() == 0


def test_gates(spark):
    df = spark.createDataFrame([(1, "a"), (2, "a"), (3, "b")], "id int, k string")
    assert pipeline.match(df, [where(("k", "=", "a")), assert_(("id", "<", "3"))], "id").count() == 2
    assert pipeline.match(df, [where(("k", "=", "a")), assert_(("id", "<", "2"))], "id").count() == 0
    assert pipeline.match(df, [assert_(("id", "<", "9"))], "id").count() == 0 and pipeline.exists(df, [assert_(("k", "=", "z")), assert_(("k", "=", "b"))]) == 2


def test_access(spark):
    rows = spark.createDataFrame([("doc1", "/data/doc1", "a"), ("doc2", "/data/x/doc2", "b")], "id string, _path string, owner string")
    rules = acl.compiled([("read_own", "**", "a"), ("read", "data/*/*", "b"), ("write", "data/**", "b")], spark)
    see = lambda u: {r.id for r in acl.readable(rows, rules, u, owner="owner").collect()}
    assert see("a") == {"doc1"} and see("b") == {"doc2"} and see("c") == set()
    assert acl.allowed(rules, "b", "write", "/data/doc1") and not acl.allowed(rules, "a", "write", "/data/doc1")
    assert acl.readable(rows, rules.limit(0), "c").count() == 2


def test_blobs_and_versions(spark):
    df = spark.createDataFrame([("1", b"same"), ("2", b"same"), ("3", b"other")], "ref string, data binary")
    kept = blobs.store(df, "data")
    assert sorted((r.size, r.refs) for r in kept.collect()) == [(4, 2), (5, 1)]
    assert blobs.release(kept, blobs.references(df.filter("ref < 3"), "data")).count() == 1 and blobs.put(kept, df, "data").agg(F.sum("refs")).first()[0] == 6
    old, new = spark.createDataFrame([(1, b"0123456789abcdef" * 4)], "k int, c binary"), spark.createDataFrame([(1, b"0123456789abcdefX" * 4)], "k int, c binary")
    assert blobs.history(old, new, "k", "c").count() == 1 and blobs.handles(kept).select("ref").distinct().count() == 2
    v = spark.createDataFrame([(1, 1, False, "a"), (1, 2, False, "b"), (1, 3, True, None), (2, 2, False, "c")], "_rid long, _seq long, _tombstone boolean, value string")
    assert [r.value for r in versions.snapshot(v, 2).orderBy("_rid").collect()] == ["b", "c"] and versions.snapshot(v).count() == 1
    assert versions.collect_garbage(v, [1]).count() == 3


def test_import_and_export(spark, tmp_path):
    (tmp_path / "in/a/b").mkdir(parents=True)
    (tmp_path / "in/a/b/f.txt").write_bytes(b"hello")
    (tmp_path / "in/g.bin").write_bytes(b"\x00" * 600)
    df = tree.import_tree(spark, f"file://{tmp_path}/in")
    assert {(r.name, r.type) for r in df.collect()} == {("a", "dir"), ("b", "dir"), ("f.txt", "file"), ("g.bin", "file")}
    assert df.filter("is_blob").count() == 1 and tuple(tree.totals(df).first()) == (2, 605)
    assert graph.with_paths(df.drop("_path")).filter("_path = '/a/b/f.txt'").count() == 1
    tree.export_tree(df, str(tmp_path / "out"))
    assert (tmp_path / "out/a/b/f.txt").read_bytes() == b"hello"


def test_hidden_rows_stay_hidden(engine):
    for name, up in (("perms", None), ("read", "perms"), ("doc", "read"), ("data", None), ("open", "data")):
        engine.write({"id": name, "name": name, **({"parent_id": up} if up else {})})
    assert engine.query("READ *")[0] == 2 == engine.query("READ * WHERE id reg .")[0]
    assert engine.query("READ * WHERE name path **")[0] == 2 and engine.query("READ * WHERE name path /perms/read/*")[0] == 1
    assert engine.query("LS")[0] == 1 and engine.query("LS /perms/read")[0] == 1 and engine.query("WRITE x=1 WHERE id=doc")[0] == OK
    assert engine.query("READ * WHERE x=1 OR name path /perms/**")[0] == 3 and engine.query("READ * WHERE x=1")[0] == 0


def test_equal_ids_in_one_batch(spark, engine):
    rows = spark.createDataFrame([("z", "first"), ("z", "second"), (None, "a"), (None, "b"), ("y", "only")], "id string, note string").coalesce(1)
    engine.insert_rows(rows)
    engine.insert_rows(rows)
    assert sorted((r.id or "", r.note) for r in engine.read(["id", "note"]).collect()) == [("", "a"), ("", "a"), ("", "b"), ("", "b"), ("y", "only"), ("z", "first")]


def test_a_commit_that_breaks_off_leaves_the_one_before(spark, engine, tmp_path):
    engine.query("WRITE id=1 note=kept")
    engine.query("WRITE id=2 note=kept")
    (tmp_path / "store/manifests/.half").write_text('{"parts": ["nowh')
    again = Engine(spark, engine.path)
    assert again.query("READ * WHERE note=kept")[0] == 2 and again.manifest == engine.manifest
    assert again.query("WRITE id=3 note=kept")[0] == OK and Engine(spark, engine.path).query("READ *")[0] == 3
    for k in range(4, 9):
        again.query(f"WRITE id={k}")
    assert len(again._manifests()) == 3 and Engine(spark, engine.path).query("READ *")[0] == 8
    with pytest.raises(OSError):  # the first engine's state is old by now
        engine.query("WRITE id=99")
    engine._delete(again.parts[0])
    with pytest.raises(Exception):  # a lost part is an error, not an empty table
        Engine(spark, engine.path).query("READ *")


def test_a_transaction_is_done_whole_or_not_at_all(spark, engine):
    engine.query("WRITE id=1 tag=a")
    engine.query("WRITE id=2 tag=b")
    before = engine.manifest
    tx = engine.query("COMMIT")[0]
    engine.query(f"WRITE note=x WHERE id=1 AS {tx}")
    engine.query(f"WRITE id=3 tag=c AS {tx}")
    lock = engine.query("LOCK WHERE tag=b")[0]
    engine.query(f"WRITE note=x WHERE id=2 AS {tx}")
    assert engine.query(f"UNLOCK {tx}")[0] == LOCKED and engine.manifest == before
    for e in (engine, Engine(spark, engine.path)):
        assert e.query("READ * WHERE note=x")[0] == 0 and e.query("READ *")[0] == 2
    engine.rollback(lock)
    tx = engine.query("COMMIT")[0]
    engine.query(f"WRITE note=x WHERE id=1 AS {tx}")
    engine.query(f"BURN WHERE id=2 AS {tx}")
    assert engine.query(f"UNLOCK {tx}")[0] == OK and engine.manifest == before + 1 and Engine(spark, engine.path).query("READ * WHERE note=x")[0] == 1


def test_blobs_and_their_history(spark, engine):
    long = "0123456789" * 100
    engine.tee("/a.txt", long)
    engine.tee("/b.txt", long)
    engine.tee("/small.txt", "few")
    assert engine.cat("/a.txt", 3, 6) == b"345" and engine.cat("/small.txt") == b"few"
    assert engine._chain().count() == 1 and engine._stored().filter("content = 'few'").count() == 1 and engine._stored().filter("length(content) > 600").count() == 0
    again = Engine(spark, engine.path)
    assert again.read(["content:hash"], [where(("name", "=", "a.txt"))]).first()["content"] == again.read(["content:hash"], [where(("name", "=", "b.txt"))]).first()["content"]
    again.tee("/a.txt", "!", "+")
    diff = again.read(["content:diff"], [where(("name", "=", "b.txt"))]).first()["content"]
    from skein.functions.diffs import Diff

    assert len(diff) < 200 and Diff.unpack(bytes(diff)).content((long + "!").encode()) == long.encode() == again.cat("/b.txt")
    assert bytes(again.read(["content:diff"], [where(("name", "=", "a.txt"))]).first()["content"]).decode() == long + "!"
    again.query("BURN WHERE name=a.txt")
    assert again._chain().filter("base is null").count() == 1 == again._chain().count() and again.cat("/b.txt") == long.encode()
    again.query("BURN WHERE name=b.txt")
    assert again._chain().count() == 0 and again.read(groups=[where(("content", "has", "ew"))]).count() == 1


def test_empty_contents_are_blobs(spark, engine):
    rows = [("1", "one"), ("2", ""), ("3", ""), ("4", None)]
    engine.insert_rows(spark.createDataFrame(rows, "id string, content string"), inside=["content"])
    contents = lambda **more: {r["id"]: r["content"] for r in engine.read(["id", "content"], **more).collect()}
    assert contents() == dict(rows) and engine._chain().count() == 2 and engine._stored().filter("`#content` is not null").count() == 3
    tx = engine.query("COMMIT")[0]
    engine.write({"content[+]": "more"}, [where(("id", "=", "2"))])
    assert contents() == dict(rows) | {"2": "more"} and contents(tx=tx) == dict(rows) and engine._chain().count() == 3
    engine.query(f"ROLLBACK {tx}")
    engine.query("BURN WHERE id=2")
    assert contents() == {"1": "one", "3": "", "4": None} and engine._chain().filter("base is null").count() == 2 == engine._chain().count()
    engine.query("BURN WHERE id=3")
    assert engine._chain().count() == 1


def test_sealed_values(spark, tmp_path):
    one, two = b"0123456789abcdef", b"fedcba9876543210"
    engine = Engine(spark, f"file://{tmp_path}/sealed", [one, two])
    engine.write({"id": "1", "name": "secret one"}, key=one)
    engine.write({"id": "2", "name": "secret two"}, key=two)
    engine.write({"id": "3", "name": "open"})
    names = lambda e: sorted(r["name"] or "-" for r in e.read(["name"]).collect())
    assert names(engine) == ["open", "secret one", "secret two"] and names(Engine(spark, engine.path, [two])) == ["-", "open", "secret two"]
    assert engine.query("READ * WHERE name has secret")[0] == 2 and engine._stored().filter("name like 'secret%'").count() == 0
    assert engine.query("WRITE note=x WHERE name='secret two'")[0] == OK and names(engine) == ["open", "secret one", "secret two"]


def test_rules_on_writes_and_removals(spark, engine):
    ann, bob = acl.Session(engine, "ann"), acl.Session(engine, "bob")
    assert ann.write({"id": "free", "name": "free"}) == OK and bob.write({"note": "x"}, [where(("id", "=", "free"))]) == OK  # open without rules
    engine.insert_rows(acl.rule_rows(spark, [("/create/**", "ann"), ("/read/me/**", "ann"), ("/modify/me/**", "ann"), ("/own/*/doc1", "ann"), ("/read/*/free", "bob"), ("/modify/*/doc1", "bob"), ("/disown/*/doc1", "ann")]))
    assert ann.write({"id": "d", "name": "doc1", "content": "secret"}) == OK and bob.write({"id": "e", "name": "doc2"}) == acl.DENIED
    owners = lambda: sorted(r["owner"] for r in engine.read(["owner"], [where(("name", "path", "/perms/owning/doc1"))]).collect())
    seen = lambda s: sorted(r["name"] for r in s.read(["name"]).collect())
    assert owners() == ["ann"] and seen(ann) == ["doc1"] and seen(bob) == ["free"]
    owning = engine._folders(["perms", "owning"])
    assert ann.write({"id": "o", "name": "doc1", "parent_id": owning, "owner": "bob"}) == OK and owners() == ["ann", "bob"]
    assert ann.write({"content": "changed"}, [where(("id", "=", "d"))]) == OK and owners() == ["ann"]
    assert ann.remove([where(("name", "path", "/perms/owning/doc1"))]) == OK and owners() == []
    assert bob.write({"owner": "bob"}, [where(("name", "path", "/perms/modify/**"))]) == acl.DENIED


def test_signed_writes(spark, engine):
    from skein.functions import scalars as S

    key, values = b"ann's key", {"id": "1", "name": "n"}
    sign = lambda v: spark.range(1).select(S.signature({k: F.lit(x) for k, x in v.items()}, key).alias("s")).first()["s"]
    ann = acl.Session(engine, "ann", key)
    assert ann.write(values | {"owning": f"ann:{sign(values)}"}) == OK and ann.write({"id": "2", "name": "n", "owning": f"ann:{sign(values)}"}) == acl.DENIED
    assert ann.write(values | {"owning": f"bob:{sign(values)}"}) == acl.DENIED == acl.Session(engine, "ann").write(values | {"owning": f"ann:{sign(values)}"})


def test_deep_trees_and_closures(spark):
    n = 24
    chain = spark.createDataFrame([(str(i), str(i - 1) if i else None, f"n{i}") for i in range(n)], "id string, parent_id string, name string")
    paths = {r["id"]: r["_path"] for r in graph.with_paths(chain).collect()}
    assert len(paths) == n and paths["22"] == "".join(f"/n{i}" for i in range(23))
    assert [r["id"] for r in graph.at_path(chain, paths["20"]).collect()] == ["20"] and graph.at_path(chain, "/n0/none").count() == 0
    assert {r["id"] for r in graph.with_paths(chain, pattern="/n0/n1/*/**").collect()} == {str(i) for i in range(2, n)}
    assert {r["id"] for r in graph.with_paths(chain, pattern="**").collect()} == {str(i) for i in range(n)} and graph.with_paths(chain, pattern="/n0/n?").count() == 1
    assert graph.with_paths(chain.filter("id > '0'")).count() == 0  # nothing hangs on a root


def test_alternatives_of_hops_are_joins_by_key(spark):
    df = spark.createDataFrame([(i, i * 7 % 11, i % 5, f"w{i % 4}") for i in range(40)] + [(3, 1, 1, "w1")], "id int, a int, b int, w string")
    rows = [r.asDict() for r in df.collect()]
    groups = [where(("id", "<", "4")), follow(("a", "=", "parent.b")), lang.or_(follow(("b", "=", "parent.a"), ("id", ">", "9"))), lang.or_(follow(("w", "=", "parent.w"), ("a", "=", "parent.a")))]
    found = pipeline.match(df, groups, "id")
    top = [r for r in rows if r["id"] < 4]
    want = sorted(r["id"] for r in rows if any(r["a"] == p["b"] or r["b"] == p["a"] and r["id"] > 9 or r["w"] == p["w"] and r["a"] == p["a"] for p in top))
    assert sorted(r["id"] for r in found.collect()) == want
    assert "NestedLoop" not in found._jdf.queryExecution().executedPlan().toString()


def test_patterns_are_java_s(spark):
    df = spark.createDataFrame([("abc",), ("Abc",)], "t string")
    count = lambda p: pipeline.match(df, [where(("t", "reg", p))], "t").count()
    assert (count(r"\p{Upper}bc"), count("(?<n>a)bc"), count("(?P<n>a)"), count("(")) == (1, 1, 0, 0)


def test_gates_on_paths(engine):
    for name, up in (("a", None), ("b", "a"), ("c", "b")):
        engine.write({"id": name, "name": name, "kind": "x", **({"parent_id": up} if up else {})})
    read = lambda text: engine.query(f"READ id WHERE kind=x {text}")[0]
    assert (read("ASSERT name path /a/b"), read("ASSERT name path /a/z"), read("ASSERT parent_id='' ASSERT FOLLOW parent_id=parent.id")) == (3, 0, 3)
    assert (read("ASSERT parent_id='' ASSERT FOLLOW parent_id=parent.id name=z"), read("ASSERT name path /a ASSERT REPEATFOLLOW parent_id=parent.id"), read("ASSERT name path /a ASSERT kind=x")) == (0, 3, 3)
    assert engine.query("READ id ASSERT name path /a")[0] == 0 and read("ASSERT name path /a ASSERT kind=y") == 0


def test_digests(spark):
    import hashlib
    import zlib

    from skein.plans.catalogue import QUERIES, t

    sf = "/root/testdata/sf0.001"
    want = {r.doc_id: hashlib.blake2b(r.text.encode(), digest_size=16).hexdigest() for r in t(spark, sf, "documents").collect()}
    assert {r.doc_id: r.text for r in QUERIES["blake2b_hash"](spark, sf).collect()} == want
    assert {r.p_partkey: r.crc for r in QUERIES["crc32_hash"](spark, sf).collect()} == {r.p_partkey: zlib.crc32(r.p_name.encode()) for r in t(spark, sf, "part").collect()}
