"""The registered queries: each operator of the clause language over the driver's tables, with the SQL it must equal."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skein.functions import diffs
from skein.functions import scalars as S
from skein.operators import acl, blobs, graph, overlay, pipeline, vector, versions
from skein.plans import engine_catalogue
from skein.plans.lang import assert_, follow, or_, repeat_follow, until, where
from skein.plans.registry import QUERIES, SQL, query
from skein.sources.tree import geography

__all__ = ["QUERIES", "SQL", "engine_catalogue"]


def t(spark, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def over(table: str, key: str, text: str, name: str, sql: str, args=None):
    """Registers a READ statement over a table."""
    query(name, sql)(lambda spark, sf_dir: pipeline.query(t(spark, sf_dir, table), text, key, args))


# -- scans, projections -----------------------------------------------------------------------------------------------
over("customer", "c_custkey", "READ c_custkey c_name c_acctbal WHERE c_mktsegment=BUILDING c_acctbal>5000 LIMIT 20", "flagship", "SELECT c_custkey, c_name, c_acctbal FROM customer WHERE c_mktsegment = 'BUILDING' AND c_acctbal > 5000 ORDER BY c_custkey LIMIT 20")
over("customer", "c_custkey", "READ *", "scan_all", "SELECT * FROM customer")
over("orders", "o_orderkey", "READ o_orderkey, o_orderstatus", "project", "SELECT o_orderkey, o_orderstatus FROM orders")


@query("project_range", "SELECT doc_id, substr(lang, 1, 1) AS lang, substr(source, 4) AS source FROM documents")
def project_range(spark, sf_dir):
    df = pipeline.query(t(spark, sf_dir, "documents"), "READ doc_id lang[0] source[3:]", "doc_id")
    return df.select("doc_id", F.decode("lang", "UTF-8").alias("lang"), F.decode("source", "UTF-8").alias("source"))


@query("project_hash", "SELECT doc_id, sha256(text) AS text_hash FROM documents")
def project_hash(spark, sf_dir):
    return pipeline.query(t(spark, sf_dir, "documents"), "READ doc_id text:sha256", "doc_id").withColumnRenamed("text", "text_hash")


@query("blake2b_hash")
def blake2b_hash(spark, sf_dir):
    return pipeline.query(t(spark, sf_dir, "documents"), "READ doc_id text:hash", "doc_id")


# -- predicates -------------------------------------------------------------------------------------------------------
over("customer", "c_custkey", "READ c_custkey WHERE c_mktsegment=MACHINERY", "where_eq", "SELECT c_custkey FROM customer WHERE c_mktsegment = 'MACHINERY'")
over("lineitem", "l_orderkey", "READ l_orderkey l_linenumber WHERE l_quantity == '30 pieces' l_linenumber<3", "where_num_eq", "SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_quantity = 30 AND l_linenumber < 3")
over("lineitem", "l_orderkey", "READ l_orderkey l_linenumber l_quantity WHERE l_quantity<3 l_discount>=0.05", "where_lt_ge", "SELECT l_orderkey, l_linenumber, l_quantity FROM lineitem WHERE l_quantity < 3 AND l_discount >= 0.05")
over("part", "p_partkey", "READ p_partkey WHERE p_size>40 p_retailprice<=1200", "where_gt_le", "SELECT p_partkey FROM part WHERE p_size > 40 AND p_retailprice <= 1200")
over("documents", "doc_id", "READ doc_id WHERE text has 'tion of'", "where_has", "SELECT doc_id FROM documents WHERE contains(text, 'tion of')")
over("documents", "doc_id", "READ doc_id WHERE text !has the lang != en", "where_not_has", "SELECT doc_id FROM documents WHERE NOT contains(text, 'the') AND lang <> 'en'")
over("part", "p_partkey", "READ p_partkey p_name WHERE p_name reg '^(red|blue) .*t$'", "where_reg", "SELECT p_partkey, p_name FROM part WHERE regexp_matches(p_name, '^(red|blue) .*t$')")
over("orders", "o_orderkey", "READ o_orderkey WHERE o_orderstatus=F o_totalprice>300000 OR o_orderpriority=1-URGENT o_totalprice<2000", "and_or_groups", "SELECT o_orderkey FROM orders WHERE (o_orderstatus = 'F' AND o_totalprice > 300000) OR (o_orderpriority = '1-URGENT' AND o_totalprice < 2000)")
over("orders", "o_orderkey", "READ o_orderkey WHERE o_orderstatus=F WHERE o_totalprice>200000", "union_all_where", "SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F' UNION ALL SELECT o_orderkey FROM orders WHERE o_totalprice > 200000")
over("customer", "c_custkey", "READ c_custkey c_name WHERE c_name=%1 OR c_custkey=%2", "where_arguments", "SELECT c_custkey, c_name FROM customer WHERE c_name = 'Customer#000000007' OR c_custkey = 11", ["Customer#000000007", "11"])


def sparse(spark, sf_dir):
    return t(spark, sf_dir, "customer").withColumn("c_mktsegment", F.nullif("c_mktsegment", F.lit("BUILDING")))


@query("where_ne_absent", "SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING' OR c_mktsegment <> 'MACHINERY'")
def where_ne_absent(spark, sf_dir):
    return pipeline.query(sparse(spark, sf_dir), "READ c_custkey WHERE c_mktsegment!=MACHINERY", "c_custkey")


@query("where_empty", "SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING'")
def where_empty(spark, sf_dir):
    return pipeline.query(sparse(spark, sf_dir), "READ c_custkey WHERE c_mktsegment EMPTY OR c_mktsegment=''", "c_custkey")


@query("where_prefix_num", "SELECT p_partkey, concat(p_size, 'cm') AS messy FROM part WHERE try_cast(regexp_extract(concat(p_size, 'cm'), '^([0-9]+)', 1) AS DOUBLE) >= 45")
def where_prefix_num(spark, sf_dir):
    df = t(spark, sf_dir, "part").withColumn("messy", F.concat(F.col("p_size").cast("string"), F.lit("cm")))
    return pipeline.query(df, "READ p_partkey messy WHERE messy >= 45", "p_partkey")


@query("where_hash", "SELECT d.doc_id FROM documents d WHERE sha256(lang) = sha256('fr')")
def where_hash(spark, sf_dir):
    import hashlib

    return pipeline.query(t(spark, sf_dir, "documents"), f"READ doc_id WHERE lang hash {hashlib.sha256(b'fr').hexdigest()}", "doc_id")


@query("where_custom_operator", "SELECT p_partkey FROM part WHERE p_size % 7 = 3")
def where_custom_operator(spark, sf_dir):
    from skein.plans.predicates import register

    register("mod7", lambda c, v: c % 7 == int(v))
    return pipeline.query(t(spark, sf_dir, "part"), "READ p_partkey WHERE p_size mod7 3", "p_partkey")


# -- hops and closures ------------------------------------------------------------------------------------------------
GEO = "geo AS (SELECT 'r' || r_regionkey AS id, NULL::VARCHAR AS parent_id, r_name AS name, 'region' AS type FROM region UNION ALL SELECT 'n' || n_nationkey, 'r' || n_regionkey, n_name, 'nation' FROM nation UNION ALL SELECT 'c' || c_custkey, 'n' || c_nationkey, c_name, 'customer' FROM customer)"
PATHS = f"{GEO}, paths AS (SELECT id, parent_id, name, type, '/' || name AS path FROM geo WHERE parent_id IS NULL UNION ALL SELECT g.id, g.parent_id, g.name, g.type, p.path || '/' || g.name FROM geo g JOIN paths p ON g.parent_id = p.id)"


@query("follow_equi", f"WITH {GEO} SELECT id, name, parent_id FROM geo WHERE parent_id IN (SELECT id FROM geo WHERE type = 'region' AND name <> 'ASIA')")
def follow_equi(spark, sf_dir):
    return pipeline.query(geography(spark, sf_dir), "READ id WHERE type=region name!=ASIA FOLLOW parent_id=parent.id")


@query("follow_khop", f"WITH {GEO} SELECT id, name, parent_id, type FROM geo WHERE parent_id IN (SELECT id FROM geo WHERE parent_id IN ('r1', 'r3'))")
def follow_khop(spark, sf_dir):
    return pipeline.query(geography(spark, sf_dir), "READ * WHERE id=r1 OR id=r3 FOLLOW parent_id=parent.id FOLLOW parent_id=parent.id")


@query("follow_theta", "SELECT p_partkey, p_size FROM part WHERE p_size < (SELECT max(p_size) FROM part WHERE p_retailprice < 905) AND p_retailprice > 1500")
def follow_theta(spark, sf_dir):
    part = t(spark, sf_dir, "part")
    return pipeline.read(part, [where(("p_retailprice", "<", "905")), follow(("p_size", "<", "parent.p_size"), ("p_retailprice", ">", "1500"))], ["p_partkey", "p_size"], "p_partkey")


@query("follow_or", "SELECT n_nationkey, n_name FROM nation WHERE EXISTS (SELECT 1 FROM nation p WHERE p.n_nationkey IN (3, 4) AND (nation.n_regionkey = p.n_nationkey OR nation.n_nationkey = p.n_regionkey))")
def follow_or(spark, sf_dir):
    nation = t(spark, sf_dir, "nation")
    return pipeline.read(nation, [where(("n_nationkey", "=", "3")), or_(where(("n_nationkey", "=", "4"))), follow(("n_regionkey", "=", "parent.n_nationkey")), or_(follow(("n_nationkey", "=", "parent.n_regionkey")))], ["n_nationkey", "n_name"], "n_nationkey")


@query("follow_join_orders", "SELECT o_orderkey FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_acctbal < 0)")
def follow_join_orders(spark, sf_dir):
    poor = pipeline.query(t(spark, sf_dir, "customer"), "READ c_custkey WHERE c_acctbal<0", "c_custkey")
    return graph.follow(poor, t(spark, sf_dir, "orders"), [follow(("o_custkey", "=", "parent.c_custkey"))]).select("o_orderkey")


@query("repeatfollow_tree", f"WITH RECURSIVE {GEO}, r AS (SELECT id FROM geo WHERE id = 'r2' UNION ALL SELECT g.id FROM geo g JOIN r ON g.parent_id = r.id) SELECT id, name, parent_id FROM geo WHERE id IN (SELECT id FROM r)")
def repeatfollow_tree(spark, sf_dir):
    return pipeline.query(geography(spark, sf_dir), "READ id WHERE id=r2 REPEATFOLLOW parent_id=parent.id")


@query("repeatfollow_recursive_sql", f"WITH RECURSIVE {GEO}, r AS (SELECT id FROM geo WHERE id = 'r2' UNION ALL SELECT g.id FROM geo g JOIN r ON g.parent_id = r.id) SELECT id, name, parent_id, type FROM geo WHERE id IN (SELECT id FROM r)")
def repeatfollow_recursive_sql(spark, sf_dir):
    return graph.tree_closure(geography(spark, sf_dir), F.col("id") == "r2")


@query("repeatfollow_cycle", "WITH RECURSIVE r AS (SELECT 4 AS k UNION SELECT (k + 7) % 25 FROM r) SELECT n_nationkey, n_name FROM nation WHERE n_nationkey IN (SELECT k FROM r)")
def repeatfollow_cycle(spark, sf_dir):
    ring = t(spark, sf_dir, "nation").select("n_nationkey", "n_name", ((F.col("n_nationkey") + 7) % 25).alias("next"))
    groups = [where(("n_nationkey", "=", "4")), repeat_follow(("n_nationkey", "=", "parent.next"))]
    return pipeline.read(ring, groups, ["n_nationkey", "n_name"], "n_nationkey")


@query("follow_until", f"WITH {GEO} SELECT id, name, parent_id FROM geo WHERE id = 'r1' OR parent_id = 'r1' OR parent_id IN (SELECT id FROM geo WHERE parent_id = 'r1' AND name <> 'NATION_6')")
def follow_until(spark, sf_dir):
    groups = [where(("id", "=", "r1")), repeat_follow(("parent_id", "=", "parent.id")), until(("name", "=", "NATION_6"))]
    return pipeline.read(geography(spark, sf_dir), groups, ["id"])


@query("nested_children", f"WITH {GEO} SELECT parent_id AS id, count(*) AS children FROM geo WHERE parent_id IS NOT NULL GROUP BY parent_id")
def nested_children(spark, sf_dir):
    return graph.nested(geography(spark, sf_dir)).select("id", F.size("children").cast("long").alias("children"))


# -- gates ------------------------------------------------------------------------------------------------------------
over("orders", "o_orderkey", "READ o_orderkey WHERE o_totalprice>400000 ASSERT o_totalprice>100000", "assert_all", "SELECT o_orderkey FROM orders WHERE o_totalprice > 400000 AND (SELECT bool_and(o_totalprice > 100000) FROM orders WHERE o_totalprice > 400000)")
over("orders", "o_orderkey", "READ o_orderkey WHERE o_totalprice>1000 ASSERT o_orderstatus=F", "assert_fails", "SELECT o_orderkey FROM orders WHERE o_totalprice > 1000 AND (SELECT bool_and(o_orderstatus = 'F') FROM orders WHERE o_totalprice > 1000)")


@query("write_assert_code", "SELECT CASE WHEN (SELECT count(*) FROM orders WHERE o_totalprice < 0) > 0 THEN 1 WHEN (SELECT count(*) FROM orders WHERE o_orderstatus = 'F') > 0 THEN 2 ELSE 0 END::BIGINT AS code")
def write_assert_code(spark, sf_dir):
    code = pipeline.exists(t(spark, sf_dir, "orders"), [assert_(("o_totalprice", "<", "0")), or_(assert_(("o_orderstatus", "=", "F")))])
    return spark.createDataFrame([(code,)], "code long")


# -- paths ------------------------------------------------------------------------------------------------------------
def on_paths(name: str, pattern: str, condition: str):
    @query(name, f"WITH RECURSIVE {PATHS} SELECT id, name, parent_id, path FROM paths WHERE {condition}")
    def run(spark, sf_dir):
        df = graph.with_paths(geography(spark, sf_dir)).withColumn("path", F.col("_path"))
        return pipeline.read(df, [where(("name", "path", pattern))], ["id", "path"])


on_paths("path_literal", "/ASIA/NATION_12", "path = '/ASIA/NATION_12'")
on_paths("path_star", "ASIA/*", "regexp_full_match(path, '/ASIA/[^/]*')")
on_paths("path_globstar", "/AMERICA/**", "regexp_full_match(path, '/AMERICA(/.*)?')")
on_paths("path_glob", "/*/NATION_1?/*7", "regexp_full_match(path, '/[^/]*/NATION_1[^/]/[^/]*7')")
on_paths("path_regex", "/*/NATION_(3|4)", "regexp_full_match(path, '/[^/]*/NATION_(3|4)')")
on_paths("path_escape", r"/ASIA/\*", "path = '/ASIA/*'")


@query("cat_range", "SELECT doc_id, substr(lang || ':' || source, 2, 4) AS part FROM documents")
def cat_range(spark, sf_dir):
    return t(spark, sf_dir, "documents").select("doc_id", F.decode(S.byte_slice(F.concat("lang", F.lit(":"), "source"), 1, 5), "UTF-8").alias("part"))


# -- vectors, pages ---------------------------------------------------------------------------------------------------
COSINE = "WITH q AS (SELECT embedding::DOUBLE[] AS v FROM embeddings WHERE vec_id = 7), s AS (SELECT vec_id, label, list_cosine_similarity(embedding::DOUBLE[], q.v) AS score FROM embeddings, q) SELECT vec_id, label, round(score, 6) AS score FROM s WHERE score >= 0 ORDER BY s.score DESC, vec_id"


def probe(spark, sf_dir) -> list[float]:
    return [float(x) for x in t(spark, sf_dir, "embeddings").filter("vec_id = 7").first()["embedding"]]


@query("cos_topk", f"{COSINE} LIMIT 10")
def cos_topk(spark, sf_dir):
    return vector.top_k(t(spark, sf_dir, "embeddings"), probe(spark, sf_dir), 10).select("vec_id", "label", F.round("score", 6).alias("score"))


@query("cos_page2", f"{COSINE} LIMIT 10 OFFSET 10")
def cos_page2(spark, sf_dir):
    df = vector.top_k(t(spark, sf_dir, "embeddings"), probe(spark, sf_dir), 10, page=2)
    return df.select("vec_id", "label", F.round("score", 6).alias("score"))


@query("cos_clause", f"SELECT vec_id, label FROM ({COSINE} LIMIT 5)")
def cos_clause(spark, sf_dir):
    return pipeline.read(t(spark, sf_dir, "embeddings"), [where(("embedding", "cos", probe(spark, sf_dir)))], ["vec_id", "label"], "vec_id", 5)


@query("cos_approximate")
def cos_approximate(spark, sf_dir):
    return vector.approximate_top_k(t(spark, sf_dir, "embeddings"), probe(spark, sf_dir), 10).select("vec_id", "label", F.round("score", 6).alias("score"))


for _name, _page in (("page_1", 1), ("page_2", 2), ("page_last", 15)):
    over("customer", "c_custkey", f"READ c_custkey c_name WHERE c_custkey>=0 LIMIT 100 PAGE {_page}", _name, f"SELECT c_custkey, c_name FROM customer ORDER BY c_custkey LIMIT 100 OFFSET {(_page - 1) * 100}")


# -- federation, access -----------------------------------------------------------------------------------------------
@query("overlay_merge", "WITH o AS (SELECT c_custkey, 'gold' AS tier, 'AUTOMOBILE' AS c_mktsegment FROM customer WHERE c_custkey % 10 = 0 UNION ALL SELECT -1, 'new', NULL) SELECT coalesce(o.c_custkey, c.c_custkey) AS c_custkey, c.c_name, coalesce(o.c_mktsegment, c.c_mktsegment) AS c_mktsegment, o.tier FROM customer c FULL JOIN o ON c.c_custkey = o.c_custkey")
def overlay_merge(spark, sf_dir):
    base = t(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_mktsegment")
    gold = base.filter("c_custkey % 10 = 0").select("c_custkey", F.lit("gold").alias("tier"), F.lit("AUTOMOBILE").alias("c_mktsegment"))
    return overlay.merge(base, gold.unionByName(spark.createDataFrame([(-1, "new", None)], "c_custkey long, tier string, c_mktsegment string")), "c_custkey")


@query("acl_read_filter", "SELECT c_custkey FROM customer WHERE starts_with(c_mktsegment, 'B') OR c_mktsegment = 'MACHINERY' OR c_custkey = 17")
def acl_read_filter(spark, sf_dir):
    rows = t(spark, sf_dir, "customer").withColumn("_path", F.concat(F.lit("/"), "c_mktsegment", F.lit("/"), F.col("c_custkey").cast("string")))
    rules = acl.compiled([("read", "B*/**", "ann"), ("read", "MACHINERY/*", "ann"), ("read", "/HOUSEHOLD/*", "bob"), ("read", "/FURNITURE/17", "ann"), ("read", "/AUTOMOBILE/17", "ann"), ("read", "/HOUSEHOLD/17", "ann")], spark)
    return acl.readable(rows, rules, "ann").select("c_custkey")


# -- changes ----------------------------------------------------------------------------------------------------------
def history(spark, sf_dir) -> DataFrame:
    e = t(spark, sf_dir, "events")
    return e.select(F.col("user_id").alias("_rid"), F.col("event_id").alias("_seq"), (F.col("event_type") == "error").alias("_tombstone"), "value")


NEWEST = "SELECT user_id AS _rid, event_id AS _seq, event_type = 'error' AS _tombstone, value FROM events {} QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) = 1"


@query("snapshot_read", f"SELECT * FROM ({NEWEST.format('WHERE event_id <= 5000')}) WHERE NOT _tombstone")
def snapshot_read(spark, sf_dir):
    return versions.snapshot(history(spark, sf_dir), 5000)


@query("latest_read", f"SELECT * FROM ({NEWEST.format('')}) WHERE NOT _tombstone")
def latest_read(spark, sf_dir):
    return versions.snapshot(history(spark, sf_dir))


@query("delete_tombstone", f"SELECT _rid FROM ({NEWEST.format('')}) WHERE _tombstone")
def delete_tombstone(spark, sf_dir):
    return versions.snapshot(history(spark, sf_dir), deleted=True).filter("_tombstone").select("_rid")


@query("conflict_check", "SELECT DISTINCT user_id AS _rid FROM events WHERE user_id < 20 AND user_id IN (SELECT user_id FROM events WHERE event_id > 900)")
def conflict_check(spark, sf_dir):
    h = history(spark, sf_dir)
    return versions.conflicts(h, h.filter("_rid < 20"), 900)


@query("gc_versions", f"SELECT _rid, _seq FROM ({NEWEST.format('')}) UNION SELECT _rid, _seq FROM ({NEWEST.format('WHERE event_id <= 500')})")
def gc_versions(spark, sf_dir):
    return versions.collect_garbage(history(spark, sf_dir), [500]).select("_rid", "_seq")


@query("burn", "SELECT event_id FROM events WHERE user_id NOT IN (SELECT user_id FROM events WHERE event_type = 'purchase' AND value > 90)")
def burn(spark, sf_dir):
    h = history(spark, sf_dir)
    gone = t(spark, sf_dir, "events").filter("event_type = 'purchase' AND value > 90").select(F.col("user_id").alias("_rid"))
    return versions.burn(h, gone).select(F.col("_seq").alias("event_id"))


# -- blobs ------------------------------------------------------------------------------------------------------------
@query("blob_dedup", "SELECT sha256(text) AS hash, any_value(text) AS content, any_value(strlen(text))::BIGINT AS size, count(*) AS refs FROM documents GROUP BY 1")
def blob_dedup(spark, sf_dir):
    return blobs.store(t(spark, sf_dir, "documents"), "text")


@query("blob_refcount", "WITH a AS (SELECT sha256(text) AS hash, count(*) AS n, count(*) FILTER (WHERE source = 'src1') AS m FROM documents GROUP BY 1) SELECT hash, n - m AS refs FROM a WHERE n > m")
def blob_refcount(spark, sf_dir):
    docs = t(spark, sf_dir, "documents")
    return blobs.release(blobs.store(docs, "text"), blobs.references(docs.filter("source = 'src1'"), "text")).select("hash", "refs")


@query("blob_resolve", "SELECT doc_id, strlen(text) AS size FROM documents")
def blob_resolve(spark, sf_dir):
    docs = t(spark, sf_dir, "documents").select("doc_id", "text")
    return blobs.resolve(blobs.references(docs, "text"), blobs.store(docs, "text")).select("doc_id", F.octet_length("content").cast("long").alias("size"))


def _edited(made):
    return lambda spark, sf_dir: t(spark, sf_dir, "part").select("p_partkey", F.decode(made(F.col("p_name")), "UTF-8").alias("p_name"))


query("blob_append", "SELECT p_partkey, p_name || ' APPENDED' AS p_name FROM part")(_edited(lambda c: S.append(c, F.lit(" APPENDED"))))
query("blob_insert", "SELECT p_partkey, substr(p_name, 1, 3) || '<ins>' || substr(p_name, 4) AS p_name FROM part")(_edited(lambda c: S.insert_at(c, F.lit("<ins>"), 3)))
query("blob_overwrite", "SELECT p_partkey, substr(p_name, 1, 2) || 'XY' || substr(p_name, 5) AS p_name FROM part")(_edited(lambda c: S.overwrite_at(c, F.lit("XY"), 2)))


@query("diff_roundtrip", "SELECT doc_id, sha256(text) AS restored FROM documents")
def diff_roundtrip(spark, sf_dir):
    docs = t(spark, sf_dir, "documents").select("doc_id", "text")
    new = docs.select("doc_id", F.concat(F.lit("edited "), F.regexp_replace("text", "the", "a")).alias("text"))
    kept = blobs.history(docs, new, "doc_id", "text")
    return new.join(kept, "doc_id").select("doc_id", F.sha2(diffs.patch(S.raw(F.col("text")), F.col("diff")), 256).alias("restored"))


@query("encrypt_roundtrip", "SELECT c_custkey, c_name FROM customer")
def encrypt_roundtrip(spark, sf_dir):
    key, wrong = b"0123456789abcdef", b"fedcba9876543210"
    df = t(spark, sf_dir, "customer").select("c_custkey", S.encrypt(F.col("c_name"), key).alias("secret"))
    return df.select("c_custkey", F.decode(S.decrypt(F.col("secret"), [wrong, key]), "UTF-8").alias("c_name"))


@query("crc32_hash")
def crc32_hash(spark, sf_dir):
    return t(spark, sf_dir, "part").select("p_partkey", F.crc32("p_name").alias("crc"))


# -- watches, volatile rows -------------------------------------------------------------------------------------------
@query("watch_filter", "SELECT event_id, event_type, value FROM events WHERE event_type = 'purchase' AND value > 50")
def watch_filter(spark, sf_dir):
    from skein.streaming.watch import Watch

    events = t(spark, sf_dir, "events")
    folder = graph.saved(events.select("event_id", "event_type", "value"), "changes")
    log = folder.inputFiles()[0].rsplit("/", 1)[0]
    return Watch(spark, log, folder.schema, [where(("event_type", "=", "purchase"), ("value", ">", "50"))]).pull()


@query("tree_column", "SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events WHERE CAST(json_extract(props, '$.k') AS BIGINT) >= 50")
def tree_column(spark, sf_dir):
    tree = t(spark, sf_dir, "events").select("event_id", F.try_parse_json("props").alias("tree"))
    return tree.select("event_id", F.try_variant_get("tree", "$.k", "bigint").alias("k")).filter("k >= 50")


@query("signed_rows", "SELECT c_custkey FROM customer WHERE c_custkey % 5 <> 0")
def signed_rows(spark, sf_dir):
    """Rows whose signature over their columns holds; every fifth was changed after it was signed."""
    key = b"secret"
    rows = t(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_mktsegment")
    sign = lambda: S.signature({c: F.col(c) for c in ("c_custkey", "c_name", "c_mktsegment")}, key)
    kept = rows.withColumn("owning", sign()).withColumn("c_name", F.when(F.col("c_custkey") % 5 == 0, F.concat("c_name", F.lit("!"))).otherwise(F.col("c_name")))
    return kept.filter(sign() == F.col("owning")).select("c_custkey")


@query("import_totals", "SELECT count(*) AS files, sum(strlen(text))::BIGINT AS bytes FROM documents")
def import_totals(spark, sf_dir):
    from skein.sources.tree import totals

    return totals(t(spark, sf_dir, "documents").select(F.lit("file").alias("type"), F.col("text").cast("binary").alias("content")))
