"""Registered queries that go through an Engine: its table is made of a driver's table, then statements change and read it."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skein.functions import scalars as S
from skein.functions.diffs import patch
from skein.functions.trees import as_yaml, parsed_yaml, tree_as_yaml
from skein.operators import acl, blobs
from skein.operators.engine import Engine
from skein.operators.storage import saved, shared_folder
from skein.plans.lang import or_, repeat_follow, where
from skein.plans.registry import query
from skein.sources.tree import geography

GEO = "geo AS (SELECT 'r' || r_regionkey AS id, NULL::VARCHAR AS parent_id, r_name AS name, 'region' AS type FROM region UNION ALL SELECT 'n' || n_nationkey, 'r' || n_regionkey, n_name, 'nation' FROM nation UNION ALL SELECT 'c' || c_custkey, 'n' || c_nationkey, c_name, 'customer' FROM customer)"


def t(spark, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def made(spark, rows: DataFrame | None = None, keys: list[bytes] | None = None, **more) -> Engine:
    """A new engine in the shared folder, with some rows."""
    engine = Engine(spark, f"{shared_folder(spark)}/engine-{uuid.uuid4().hex}", keys)
    if rows is not None:
        engine.insert_rows(rows, **more)
    return engine


def customers(spark, sf_dir: str, *columns: str) -> DataFrame:
    return t(spark, sf_dir, "customer").select(F.col("c_custkey").cast("string").alias("id"), *columns)


def by_key(rows: DataFrame) -> DataFrame:
    return rows.withColumn("c_custkey", F.col("id").cast("long")).drop("id")


def codes(spark, **found) -> DataFrame:
    return spark.createDataFrame([(k, int(v)) for k, v in found.items()], "step string, code long")


def expected(**found) -> str:
    return "SELECT * FROM (VALUES " + ", ".join(f"('{k}', {v}::BIGINT)" for k, v in found.items()) + ") v(step, code)"


# -- changes ----------------------------------------------------------------------------------------------------------
@query("insert_dedup", "SELECT c_custkey, c_name FROM customer UNION ALL SELECT k, 'new ' || k FROM (SELECT c_custkey + 100000000 AS k FROM customer WHERE c_custkey % 3 = 0)")
def insert_dedup(spark, sf_dir):
    """Of the new rows every id comes twice, and every other one is known."""
    engine = made(spark, customers(spark, sf_dir, "c_name"))
    keys = t(spark, sf_dir, "customer").filter("c_custkey % 3 = 0").select(F.explode(F.expr("array(c_custkey, c_custkey + 100000000, c_custkey, c_custkey + 100000000)")).alias("id")).withColumn("id", F.col("id").cast("string"))
    engine.insert_rows(keys.withColumn("c_name", F.concat(F.lit("new "), "id")))
    return by_key(engine.read(["id", "c_name"]))


@query("update_set", "SELECT c_custkey, CASE WHEN c_acctbal < 0 THEN 'DEBT' ELSE c_mktsegment END AS c_mktsegment FROM customer")
def update_set(spark, sf_dir):
    engine = made(spark, customers(spark, sf_dir, "c_acctbal", "c_mktsegment"))
    engine.query("WRITE c_mktsegment=DEBT WHERE c_acctbal<0")
    return by_key(engine.read(["id", "c_mktsegment"]))


@query("update_remove_col", "SELECT c_custkey, CASE WHEN c_mktsegment = 'BUILDING' THEN NULL ELSE c_name END AS c_name FROM customer")
def update_remove_col(spark, sf_dir):
    engine = made(spark, customers(spark, sf_dir, "c_mktsegment", "c_name"))
    engine.query("WRITE c_name='' WHERE c_mktsegment=BUILDING")
    return by_key(engine.read(["id", "c_name"]))


@query("engine_remove", "SELECT c_custkey, c_name FROM customer WHERE NOT (c_mktsegment = 'BUILDING' OR c_acctbal < 0)")
def engine_remove(spark, sf_dir):
    engine = made(spark, customers(spark, sf_dir, "c_mktsegment", "c_acctbal", "c_name"))
    engine.query("RM WHERE c_mktsegment=BUILDING OR c_acctbal<0")
    return by_key(engine.read(["id", "c_name"]))


@query("engine_burn", "SELECT c_custkey, 2::BIGINT AS versions FROM customer WHERE c_mktsegment <> 'BUILDING'")
def engine_burn(spark, sf_dir):
    """Versions of each row that are left in the parts after all were changed and some burnt."""
    engine = made(spark, customers(spark, sf_dir, "c_mktsegment"))
    engine.query("WRITE seen=yes WHERE c_mktsegment!=''")
    engine.query("BURN WHERE c_mktsegment=BUILDING")
    return by_key(engine._stored().groupBy("id").agg(F.count("*").alias("versions")))


@query("engine_compact", "SELECT c_custkey, 1::BIGINT AS versions FROM customer WHERE c_acctbal >= 0")
def engine_compact(spark, sf_dir):
    engine = made(spark, customers(spark, sf_dir, "c_acctbal"))
    engine.query("WRITE seen=yes WHERE c_acctbal>=0")
    engine.query("RM WHERE c_acctbal<0")
    engine.query("VACUUM")
    return by_key(Engine(spark, engine.path)._stored().groupBy("id").agg(F.count("*").alias("versions")))


@query("volatile_union", "SELECT c_custkey, c_name FROM customer UNION ALL SELECT -s_suppkey - 1, s_name FROM supplier")
def volatile_union(spark, sf_dir):
    engine = made(spark, customers(spark, sf_dir, "c_name"))
    engine.insert_rows(t(spark, sf_dir, "supplier").select((-F.col("s_suppkey") - 1).cast("string").alias("id"), F.col("s_name").alias("c_name")), volatile=True)
    return by_key(engine.read(["id", "c_name"]))


@query("volatile_lost", "SELECT c_custkey, c_name FROM customer")
def volatile_lost(spark, sf_dir):
    """What another engine sees of the same table: volatile rows are this one's only."""
    engine = made(spark, customers(spark, sf_dir, "c_name"))
    engine.query("WRITEVOLATILE id=-5 c_name=passing")
    return by_key(Engine(spark, engine.path).read(["id", "c_name"]))


@query("virtual_cols", "SELECT event_id, user_id FROM events WHERE event_type <> 'click'")
def virtual_cols(spark, sf_dir):
    """Columns with virtual names are not stored, whatever their values."""
    events = t(spark, sf_dir, "events").select("event_id", "user_id", F.col("event_type").alias("_type"), F.col("event_type").alias("kind:watch"))
    return made(spark, events.filter(F.col("_type") != "click")).read()


@query("overlay_read", "SELECT c_custkey, c_name, CASE WHEN c_custkey % 10 = 0 THEN 'gold' END AS tier FROM customer UNION ALL SELECT -1, NULL, 'new'")
def overlay_read(spark, sf_dir):
    engine, base = made(spark, customers(spark, sf_dir, "c_name")), customers(spark, sf_dir)
    engine.on_read(lambda e, groups: base.filter(F.col("id").cast("long") % 10 == 0).withColumn("tier", F.lit("gold")).unionByName(spark.createDataFrame([("-1", "new")], "id string, tier string")))
    return by_key(engine.read(["id", "c_name", "tier"]))


@query("overlay_write", "SELECT 'taken' AS id, 'to the sink' AS note")
def overlay_write(spark, sf_dir):
    """A sink takes the writes of its kind; the table gets the others."""
    engine, sink = made(spark, customers(spark, sf_dir)), []
    engine.on_write(lambda values, groups: bool(values.get("kind") == "external" and (sink.append(values) or True)))
    engine.query("WRITE id=taken kind=external note='to the sink'")
    assert engine.query("READ id WHERE id=taken")[0] == 0
    return spark.createDataFrame([(v["id"], v["note"]) for v in sink], "id string, note string")


# -- transactions -----------------------------------------------------------------------------------------------------
@query("lock_codes", expected(locked=-1, other=0, insert=-1, remove=-1, mine=0, unlock=0, conflict=-2, everything=-1, rolled=0))
def lock_codes(spark, sf_dir):
    engine = made(spark, customers(spark, sf_dir, "c_mktsegment"))
    lock = engine.query("LOCK WHERE c_mktsegment=BUILDING")[0]
    some = {s: t(spark, sf_dir, "customer").filter(F.col("c_mktsegment") == s).agg(F.min("c_custkey")).first()[0] for s in ("BUILDING", "MACHINERY")}
    found = {"locked": engine.query(f"WRITE note=x WHERE id={some['BUILDING']}")[0], "other": engine.query(f"WRITE note=x WHERE id={some['MACHINERY']}")[0]}
    found["insert"] = engine.query("WRITE id=-1 c_mktsegment=BUILDING")[0]
    found["remove"] = engine.query("RM WHERE c_mktsegment=BUILDING")[0]
    found["mine"] = engine.query(f"WRITE note=mine WHERE id={some['BUILDING']} AS {lock}")[0]
    found["unlock"] = engine.query(f"UNLOCK {lock}")[0]
    late = engine.query(f"COMMIT WHERE id={some['MACHINERY']}")[0]
    engine.query(f"WRITE note=first WHERE id={some['MACHINERY']}")
    engine.query(f"WRITE note=late WHERE id={some['MACHINERY']} AS {late}")
    found["conflict"] = engine.query(f"UNLOCK {late}")[0]
    all_ = engine.query("LOCK")[0]
    found["everything"] = engine.query("WRITE id=-2")[0]
    found["rolled"] = engine.query(f"ROLLBACK {all_}")[0]
    return codes(spark, **found)


@query("transaction_rows", "SELECT c_custkey, CASE WHEN c_acctbal < 0 THEN 'DEBT' WHEN c_acctbal > 9000 THEN 'RICH' ELSE c_mktsegment END AS c_mktsegment FROM customer WHERE c_mktsegment <> 'BUILDING' UNION ALL SELECT -7, 'NEW'")
def transaction_rows(spark, sf_dir):
    """Four changes become visible together."""
    engine = made(spark, customers(spark, sf_dir, "c_acctbal", "c_mktsegment"))
    tx, before = engine.query("COMMIT")[0], engine.manifest
    for statement in ("WRITE c_mktsegment=DEBT WHERE c_acctbal<0 c_mktsegment!=BUILDING", "WRITE c_mktsegment=RICH WHERE c_acctbal>9000 c_mktsegment!=BUILDING", "RM WHERE c_mktsegment=BUILDING", "WRITE id=-7 c_mktsegment=NEW"):
        engine.query(f"{statement} AS {tx}")
    assert engine.manifest == before and engine.query(f"UNLOCK {tx}")[0] == 0 and engine.manifest == before + 1
    return by_key(Engine(spark, engine.path).read(["id", "c_mktsegment"]))


@query("snapshot_rows", "SELECT c_custkey, c_mktsegment FROM customer")
def snapshot_rows(spark, sf_dir):
    """What a transaction sees after others have changed and removed all rows."""
    engine = made(spark, customers(spark, sf_dir, "c_mktsegment"))
    tx = engine.query("COMMIT")[0]
    engine.query("WRITE c_mktsegment=GONE WHERE c_mktsegment!=''")
    engine.query("RM WHERE c_mktsegment=GONE")
    return by_key(engine.query(f"READ id c_mktsegment AS {tx}")[1])


@query("watch_pull", "SELECT 'w' || n_nationkey AS id, n_name AS name FROM nation WHERE n_regionkey = 2")
def watch_pull(spark, sf_dir):
    engine = made(spark)
    number = engine.query("WATCH WHERE region=2")[0]
    for r in t(spark, sf_dir, "nation").filter("n_nationkey < 50").collect():
        engine.write({"id": f"w{r['n_nationkey']}", "name": r["n_name"], "region:watch": r["n_regionkey"]})
    return engine.query(f"PULL {number}")[1].select("id", "name")


# -- trees ------------------------------------------------------------------------------------------------------------
PATHS = f"{GEO}, paths AS (SELECT id, parent_id, name, type, '/' || name AS path FROM geo WHERE parent_id IS NULL UNION ALL SELECT g.id, g.parent_id, g.name, g.type, p.path || '/' || g.name FROM geo g JOIN paths p ON g.parent_id = p.id)"


def with_path(engine: Engine, pattern: str) -> DataFrame:
    return engine._nodes(None, [where(("name", "path", pattern))]).filter("_path is not null").select(F.col("_path").alias("path"), "type")


@query("ls", f"WITH {GEO} SELECT id, name, type FROM geo WHERE parent_id = 'n3'")
def ls(spark, sf_dir):
    place = t(spark, sf_dir, "nation").filter("n_nationkey = 3").join(t(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey")).first()
    return made(spark, geography(spark, sf_dir)).query(f"LS /{place['r_name']}/{place['n_name']}")[1].select("id", "name", "type")


@query("ls_root", "SELECT 'r' || r_regionkey AS id, r_name AS name FROM region")
def ls_root(spark, sf_dir):
    return made(spark, geography(spark, sf_dir)).query("LS")[1].select("id", "name")


@query("hidden_perms", "SELECT o_orderkey FROM orders WHERE o_orderstatus <> 'F'")
def hidden_perms(spark, sf_dir):
    """Half the rows lie below /perms, at two depths; only a clause on that path would show them."""
    folders = spark.createDataFrame([("perms", None, "perms"), ("read", "perms", "read"), ("data", None, "data")], "id string, parent_id string, name string")
    up = F.when(F.col("o_orderstatus") != "F", "data").when(F.col("o_orderkey") % 2 == 0, "perms").otherwise("read")
    rows = t(spark, sf_dir, "orders").select(F.col("o_orderkey").cast("string").alias("id"), up.alias("parent_id"), F.col("o_orderkey").cast("string").alias("name"), "o_orderkey")
    engine = made(spark, folders.unionByName(rows, allowMissingColumns=True))
    return engine.query("READ o_orderkey WHERE id reg ^[0-9]")[1].select("o_orderkey")


@query("shown_perms", "SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F'")
def shown_perms(spark, sf_dir):
    folders = spark.createDataFrame([("perms", None, "perms"), ("read", "perms", "read")], "id string, parent_id string, name string")
    rows = t(spark, sf_dir, "orders").select(F.col("o_orderkey").cast("string").alias("id"), F.when(F.col("o_orderstatus") == "F", "read").alias("parent_id"), F.col("o_orderkey").cast("string").alias("name"), "o_orderkey")
    return made(spark, folders.unionByName(rows, allowMissingColumns=True)).query("READ o_orderkey WHERE name path /perms/read/*")[1].select("o_orderkey")


@query("path_assert", f"WITH RECURSIVE {PATHS} SELECT id, name, parent_id FROM geo WHERE type = 'nation' AND EXISTS (SELECT 1 FROM paths WHERE path = '/ASIA/NATION_12')")
def path_assert(spark, sf_dir):
    return made(spark, geography(spark, sf_dir)).query("READ id WHERE type=nation ASSERT name path /ASIA/NATION_12")[1]


@query("path_assert_fails", f"WITH {GEO} SELECT id, name, parent_id FROM geo WHERE false")
def path_assert_fails(spark, sf_dir):
    """The path is there, but what is led on to is not."""
    return made(spark, geography(spark, sf_dir)).query("READ id WHERE type=nation ASSERT name path /ASIA ASSERT FOLLOW parent_id=parent.id name=NOWHERE")[1]


@query("path_assert_closure", f"WITH {GEO} SELECT id, name, parent_id FROM geo WHERE type = 'nation'")
def path_assert_closure(spark, sf_dir):
    return made(spark, geography(spark, sf_dir)).query("READ id WHERE type=nation ASSERT parent_id='' name=ASIA ASSERT REPEATFOLLOW parent_id=parent.id")[1]


@query("engine_cat", "SELECT p_partkey, substr(p_name, 3, 6) AS part FROM part WHERE p_partkey < 4")
def engine_cat(spark, sf_dir):
    parts = t(spark, sf_dir, "part")
    files = parts.select(F.concat(F.lit("f"), "p_partkey").alias("id"), F.lit("d").alias("parent_id"), F.concat(F.lit("part"), "p_partkey").alias("name"), F.col("p_name").alias("content"))
    engine = made(spark, files.unionByName(spark.createDataFrame([("d", "parts")], "id string, name string"), allowMissingColumns=True))
    found = [(r["p_partkey"], bytes(engine.query(f"CAT[2:8] /parts/part{r['p_partkey']}")[1].first()["content"]).decode()) for r in parts.filter("p_partkey < 4").select("p_partkey").collect()]
    return spark.createDataFrame(found, "p_partkey long, part string")


@query("engine_tee", "SELECT * FROM (VALUES ('/a', 'dir', NULL), ('/a/b', 'dir', NULL), ('/a/b/new.txt', 'file', 'once more'), ('/a/long.txt', 'file', sha256(repeat('0123456789', 100) || '!')), ('/top.txt', 'file', 'abXYef')) v(path, type, content)")
def engine_tee(spark, sf_dir):
    """Files are made with their folders, written again, edited in place, and longer ones kept as blobs."""
    engine = made(spark)
    engine.query("TEE /a/b/new.txt first")
    engine.query("TEE /a/b/new.txt 'once more'")
    engine.tee("/a/long.txt", "0123456789" * 100)
    engine.tee("/a/long.txt", "!", "+")
    engine.tee("/top.txt", "abcdef")
    engine.tee("/top.txt", "XY", "2:4")
    nodes = engine._nodes(None, None)
    return nodes.select(F.col("_path").alias("path"), "type", F.when(F.length("content") > 500, F.sha2("content", 256)).otherwise(F.col("content")).alias("content"))


@query("engine_cp", f"WITH RECURSIVE {PATHS} SELECT '/COPY/' || 'EAST' || substr(path, 6) AS path, type FROM paths WHERE path = '/ASIA' OR starts_with(path, '/ASIA/') UNION ALL SELECT '/COPY', 'dir'")
def engine_cp(spark, sf_dir):
    engine = made(spark, geography(spark, sf_dir))
    engine.query("CP /ASIA /COPY/EAST")
    return with_path(engine, "/COPY/**")


@query("engine_mv", f"WITH RECURSIVE {PATHS} SELECT '/NEW/EAST' || substr(path, 6) AS path, type FROM paths WHERE path = '/ASIA' OR starts_with(path, '/ASIA/') UNION ALL SELECT path, type FROM paths WHERE NOT (path = '/ASIA' OR starts_with(path, '/ASIA/')) UNION ALL SELECT '/NEW', 'dir'")
def engine_mv(spark, sf_dir):
    engine = made(spark, geography(spark, sf_dir))
    engine.query("MV /ASIA /NEW/EAST")
    return with_path(engine, "**")


@query("engine_rm", f"WITH RECURSIVE {PATHS} SELECT path, type FROM paths WHERE NOT (path = '/ASIA' OR starts_with(path, '/ASIA/'))")
def engine_rm(spark, sf_dir):
    engine = made(spark, geography(spark, sf_dir))
    engine.query("RM /ASIA")
    return with_path(engine, "**")


@query("graph_mutation", f"WITH {GEO} SELECT id, name, parent_id FROM geo WHERE id <> 'r1' AND (parent_id IS NULL OR parent_id <> 'r1' AND parent_id NOT IN (SELECT id FROM geo WHERE parent_id = 'r1'))")
def graph_mutation(spark, sf_dir):
    """A closure is marked, then all that is marked removed."""
    engine = made(spark, geography(spark, sf_dir))
    engine.write({"mark": "x"}, [where(("id", "=", "r1")), repeat_follow(("parent_id", "=", "parent.id"))])
    engine.query("RM WHERE mark=x")
    return engine.read(["id"])


# -- blobs, seals -----------------------------------------------------------------------------------------------------
def documents(spark, sf_dir: str) -> DataFrame:
    return t(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("id"), F.col("text").alias("content"))


@query("blob_column", "SELECT doc_id, sha256(text) AS content FROM documents")
def blob_column(spark, sf_dir):
    found = made(spark, documents(spark, sf_dir), inside=["content"]).query("READ id content:blob")[1]
    return found.select(F.col("id").cast("long").alias("doc_id"), F.sha2("content", 256).alias("content"))


@query("blob_column_counts", "SELECT count(DISTINCT text) AS blobs, count(*) AS rows, sum(strlen(text))::BIGINT AS bytes FROM documents")
def blob_column_counts(spark, sf_dir):
    """Every content is kept once, an empty one too; those of burnt rows go. The rows have no id in the engine, so documents with a repeated or missing doc_id all count."""
    docs = documents(spark, sf_dir).select("content", F.lit("keep").alias("kind"))
    engine = made(spark, docs.unionByName(docs.select(F.concat("content", F.lit("!")).alias("content"), F.lit("burn").alias("kind"))), inside=["content"])
    engine.query("BURN WHERE kind=burn")
    kept = engine._chain().agg(F.count("*").alias("blobs"))
    return kept.crossJoin(engine.read(["content"]).agg(F.count("*").alias("rows"), F.sum(F.octet_length("content")).alias("bytes")))


@query("blob_history", "SELECT doc_id, sha256(text) AS before, sha256(text || ' and more') AS after, true AS smaller FROM documents")
def blob_history(spark, sf_dir):
    """After an edit of all contents the former ones are kept as differences, from which a snapshot still reads them."""
    docs = documents(spark, sf_dir)
    engine = made(spark, docs, inside=["content"])
    tx = engine.query("COMMIT")[0]
    engine.write({"content[+]": " and more"}, [where(("id", "!=", ""))])
    old, new = engine.read(["id", "content"], tx=tx), engine.read(["id", "content"])
    kept = engine._chain().agg(F.sum(F.when(F.col("base").isNotNull(), F.octet_length("content"))).alias("d"), F.sum(F.when(F.col("base").isNull(), F.octet_length("content"))).alias("w"))
    small = bool(kept.select((F.col("d") < F.col("w")).alias("s")).first()["s"])
    both = old.select("id", F.sha2("content", 256).alias("before")).join(new.select("id", F.sha2("content", 256).alias("after")), "id")
    return both.select(F.col("id").cast("long").alias("doc_id"), "before", "after", F.lit(small).alias("smaller"))


@query("blob_diff_column", "SELECT p_partkey, p_name AS restored FROM part")
def blob_diff_column(spark, sf_dir):
    """`content:diff` of rows whose content another row has moved on from is the difference; with the new content it gives theirs back."""
    rows = t(spark, sf_dir, "part").select(F.concat(F.lit("a"), "p_partkey").alias("id"), F.concat(F.col("p_partkey").cast("string"), F.lit(" "), "p_name", F.lit(" ")).alias("content"), F.lit("keep").alias("kind"))
    engine = made(spark, rows.unionByName(rows.withColumn("id", F.concat(F.lit("b"), F.substring("id", 2, 20))).withColumn("kind", F.lit("edit"))), inside=["content"])
    engine.write({"content[+]": "edited"}, [where(("kind", "=", "edit"))])
    kept = engine.read(["id", "content:diff"], [where(("kind", "=", "keep"))]).select(F.substring("id", 2, 20).alias("key"), F.col("content").alias("diff"))
    new = engine.read(["id", "content"], [where(("kind", "=", "edit"))]).select(F.substring("id", 2, 20).alias("key"), "content")
    whole = F.decode(patch(S.raw(F.col("content")), F.col("diff")), "UTF-8")
    return kept.join(new, "key").select(F.col("key").cast("long").alias("p_partkey"), F.regexp_replace(whole, "^[0-9]+ (.*) $", "$1").alias("restored"))


@query("blob_chain_merge", "SELECT doc_id, sha256(text) AS first, sha256(text || ' two three') AS last, 2::BIGINT AS kept FROM documents")
def blob_chain_merge(spark, sf_dir):
    """Three states of every text, each a difference from the next; the middle one goes, and the first becomes a difference from the last."""
    docs = t(spark, sf_dir, "documents").select("doc_id", F.concat(F.col("doc_id").cast("string"), F.lit(":"), "text").alias("text"))
    states = saved(docs.select("doc_id", *[F.concat("text", F.lit(end)).alias(f"t{k}") for k, end in enumerate(("", " two", " two three"))]), "states")
    digest = lambda k: F.sha2(f"t{k}", 256)
    chain = states.select(F.explode(F.array(*[F.struct(digest(k).alias("hash"), S.raw(F.col(f"t{k}")).alias("content")) for k in range(3)])).alias("b")).select("b.*", F.lit(None).cast("string").alias("base"))
    for k in (0, 1):
        chain = saved(blobs.superseded(chain, states.select(digest(k).alias("old"), digest(k + 1).alias("new"))), "chain")
    kept = saved(blobs.merged(chain, states.select(F.explode(F.array(digest(0), digest(2))).alias("hash"))), "chain")
    whole = blobs.materialised(kept, kept.select("hash"))
    text = lambda k, name: states.select("doc_id", digest(k).alias("hash")).join(whole, "hash").select("doc_id", F.sha2(F.regexp_replace(F.decode("content", "UTF-8"), "^[0-9]+:", ""), 256).alias(name))
    counts = kept.join(states.select("doc_id", F.explode(F.array(*[digest(k) for k in range(3)])).alias("hash")), "hash").groupBy("doc_id").agg(F.count("*").alias("kept"))
    return text(0, "first").join(text(2, "last"), "doc_id").join(counts, "doc_id")


@query("blob_range", "SELECT doc_id, CAST(substr(lang || ':' || source, 2, 4) AS VARCHAR) AS part FROM documents")
def blob_range(spark, sf_dir):
    docs = t(spark, sf_dir, "documents").select("doc_id", F.concat("lang", F.lit(":"), "source").alias("text"))
    return blobs.read_range(blobs.references(docs, "text"), blobs.store(docs, "text"), 1, 5).select("doc_id", F.decode("content", "UTF-8").alias("part"))


@query("blob_remove", "SELECT sha256(text) AS hash, count(*) AS refs FROM documents WHERE sha256(text) >= '8' GROUP BY 1")
def blob_remove(spark, sf_dir):
    kept = blobs.store(t(spark, sf_dir, "documents"), "text")
    return blobs.remove(kept, blobs.handles(kept).filter("hash < '8'").select("ref")).select("hash", "refs")


@query("sealed_rows", "SELECT c_custkey, CASE WHEN c_custkey % 2 = 0 THEN c_name END AS c_name, c_mktsegment FROM customer WHERE c_mktsegment <> 'BUILDING'")
def sealed_rows(spark, sf_dir):
    """Values sealed with two keys, read by an engine that has the second only; clauses see what it can read."""
    first, second = b"0123456789abcdef", b"fedcba9876543210"
    rows = customers(spark, sf_dir, "c_name").withColumn("kind", F.col("id").cast("long") % 2)
    engine = made(spark, customers(spark, sf_dir).limit(0))
    for kind, key in ((0, second), (1, first)):
        names = rows.filter(F.col("kind") == kind).select("id", "c_name")
        open_ = t(spark, sf_dir, "customer").select(F.col("c_custkey").cast("string").alias("id"), "c_mktsegment")
        sealed = engine._seal(names, ["c_name"], key)
        engine.insert_rows(sealed.join(open_, "id"))
    return by_key(Engine(spark, engine.path, [second]).query("READ id c_name c_mktsegment WHERE c_mktsegment!=BUILDING")[1])


@query("sealed_clause", "SELECT c_custkey, c_name FROM customer WHERE c_name = 'Customer#000000007'")
def sealed_clause(spark, sf_dir):
    key = b"0123456789abcdef"
    engine = made(spark, customers(spark, sf_dir, "c_name").filter("id != '7'"), [key], key=key)
    engine.write({"id": "7", "c_name": "Customer#000000007"}, key=key)
    assert engine._stored().filter("c_name like 'Customer%'").isEmpty()
    return engine.query("READ c_name id WHERE c_name='Customer#000000007'")[1].transform(by_key).withColumn("c_custkey", F.col("c_custkey").cast("long"))


# -- rules ------------------------------------------------------------------------------------------------------------
def ruled(spark, sf_dir: str, *rules: tuple[str, str]) -> Engine:
    """The tree of regions, nations and customers, and rules (path below /perms, owner)."""
    return made(spark, geography(spark, sf_dir).unionByName(acl.rule_rows(spark, list(rules)), allowMissingColumns=True))


@query("acl_session_read", f"WITH RECURSIVE {PATHS} SELECT id, name FROM paths WHERE regexp_full_match(path, '/ASIA(/.*)?') OR path = '/EUROPE'")
def acl_session_read(spark, sf_dir):
    engine = ruled(spark, sf_dir, ("read/*/ASIA/**", "ann"), ("read/*/EUROPE", "ann"), ("read/*/AFRICA/**", "bob"))
    return acl.Session(engine, "ann").read(["id", "name"]).select("id", "name")


@query("acl_write_codes", expected(create=0, refused=-3, modify_own=0, modify_other=-3, modify_all=0, disowned=-3, own_other=-3, own_self=0, forbidden=-3, remove_own=-3, remove_all=0))
def acl_write_codes(spark, sf_dir):
    engine = ruled(spark, sf_dir, ("create/ASIA/*", "ann"), ("modify/me/ASIA/**", "ann"), ("modify/*/ASIA/**", "bob"), ("own/me/EUROPE", "ann"), ("unlink/*/ASIA/**", "bob"))
    ann, bob = acl.Session(engine, "ann"), acl.Session(engine, "bob")
    asia = engine._at("/ASIA").first()["id"]
    new = {"id": "note", "name": "note", "parent_id": asia, "content": "one"}
    mine = [where(("id", "=", "note"))]
    nation = [where(("type", "=", "nation"), ("parent_id", "=", asia))]
    found = {"create": ann.write(new), "refused": bob.write(new | {"id": "other", "name": "other"})}
    found["modify_own"] = ann.write({"content": "two"}, mine)
    found["modify_other"] = ann.write({"content": "two"}, nation)
    found["modify_all"] = bob.write({"content": "three"}, mine)
    found["disowned"] = ann.write({"content": "four"}, mine)
    owning = engine._folders(["perms", "owning"])
    rule = {"id": "o1", "name": "EUROPE", "parent_id": owning}
    found["own_other"] = ann.write(rule | {"owner": "bob"})
    found["own_self"] = ann.write(rule | {"owner": "ann"})
    found["forbidden"] = ann.write({"owner": "bob"}, [where(("name", "path", "/perms/owning/EUROPE"))])
    found["remove_own"] = ann.remove(mine)
    found["remove_all"] = bob.remove(mine)
    return codes(spark, **found)


# -- rows as text -----------------------------------------------------------------------------------------------------
@query("rows_as_json", """SELECT c_custkey, '{"c_custkey":' || c_custkey || ',"c_name":"' || c_name || '","c_mktsegment":"' || c_mktsegment || '"}' AS row FROM customer""")
def rows_as_json(spark, sf_dir):
    return t(spark, sf_dir, "customer").select("c_custkey", F.to_json(F.struct("c_custkey", "c_name", "c_mktsegment")).alias("row"))


@query("rows_as_yaml", """SELECT c_custkey, '- c_custkey: ' || c_custkey || chr(10) || '  c_name: "' || c_name || '"' || chr(10) || CASE WHEN c_mktsegment = 'BUILDING' THEN '' ELSE '  c_mktsegment: "' || c_mktsegment || '"' || chr(10) END AS row FROM customer""")
def rows_as_yaml(spark, sf_dir):
    rows = t(spark, sf_dir, "customer").select("c_custkey", "c_name", F.nullif("c_mktsegment", F.lit("BUILDING")).alias("c_mktsegment"))
    return rows.select("c_custkey", as_yaml(rows).alias("row"))


@query("yaml_column", "SELECT o_orderkey, o_orderstatus AS status, o_custkey AS customer FROM orders")
def yaml_column(spark, sf_dir):
    made_ = t(spark, sf_dir, "orders").select("o_orderkey", F.concat(F.lit("order:\n  status: "), "o_orderstatus", F.lit("\n  parties: [first, "), F.col("o_custkey").cast("string"), F.lit("]\n")).alias("tree"))
    tree = made_.select("o_orderkey", F.parse_json(parsed_yaml("tree")).alias("tree"))
    return tree.select("o_orderkey", F.variant_get("tree", "$.order.status", "string").alias("status"), F.variant_get("tree", "$.order.parties[1]", "bigint").alias("customer"))


@query("tree_as_yaml", "SELECT r_regionkey, 'id: \"r' || r_regionkey || '\"' || chr(10) || 'name: \"' || r_name || '\"' || chr(10) || 'children:' || chr(10) || string_agg('  - id: \"n' || n_nationkey || '\"' || chr(10) || '    name: \"' || n_name || '\"' || chr(10), '' ORDER BY 'n' || n_nationkey) AS yaml FROM region JOIN nation ON n_regionkey = r_regionkey GROUP BY r_regionkey, r_name")
def tree_yaml(spark, sf_dir):
    rows = geography(spark, sf_dir).filter("type != 'customer'").select("id", "parent_id", "name")
    return tree_as_yaml(rows).select(F.substring("id", 2, 20).cast("long").alias("r_regionkey"), "yaml")


__all__ = ["made", "or_"]
