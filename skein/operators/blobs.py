"""Content-addressed blobs: one row per distinct content, named by its digest, with counted references; older contents as
differences from newer ones."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skein.functions import scalars as S
from skein.functions.diffs import create_diff, patch
from skein.operators.storage import saved


def store(rows: DataFrame, content: str, key: str | None = None) -> DataFrame:
    """(hash, content, size, refs) of a column's distinct contents. Contents of one digest are equal, so partial aggregation sends each once a task."""
    made = rows.filter(F.col(content).isNotNull()).withColumn("hash", F.sha2(S.raw(F.col(content)), 256))
    return made.groupBy("hash").agg(F.first(content).alias("content"), F.octet_length(S.raw(F.first(content))).cast("long").alias("size"), F.count("*").alias("refs"))


def references(rows: DataFrame, content: str) -> DataFrame:
    """The rows with the content's digest in place of the content."""
    return rows.withColumn("hash", F.sha2(S.raw(F.col(content)), 256)).drop(content)


def resolve(rows: DataFrame, blobs: DataFrame) -> DataFrame:
    return rows.join(blobs.select("hash", "content"), "hash", "left")


def read_range(rows: DataFrame, blobs: DataFrame, start: int, end: int = 0) -> DataFrame:
    """resolve(), but of each content only the bytes [start:end); they are cut before the join."""
    return rows.join(blobs.select("hash", S.byte_slice(F.col("content"), start, end).alias("content")), "hash", "left")


def put(blobs: DataFrame, new: DataFrame, content: str) -> DataFrame:
    """The store with more contents: known ones gain references only."""
    return blobs.unionByName(store(new, content)).groupBy("hash").agg(F.first("content").alias("content"), F.first("size").alias("size"), F.sum("refs").alias("refs"))


def release(blobs: DataFrame, gone: DataFrame) -> DataFrame:
    """The store after rows (hash) let go; contents without references leave it."""
    less = gone.groupBy("hash").agg(F.count("*").alias("less"))
    return blobs.join(less, "hash", "left").withColumn("refs", F.col("refs") - F.coalesce("less", F.lit(0))).drop("less").filter("refs > 0")


def handles(blobs: DataFrame) -> DataFrame:
    """A number for every digest that stays the same from session to session: its first 15 hexadecimal digits."""
    return blobs.withColumn("ref", F.conv(F.substring("hash", 1, 15), 16, 10).cast("long"))


def remove(blobs: DataFrame, refs: DataFrame) -> DataFrame:
    """The store without the contents of some handles (ref), whatever refers to them."""
    return handles(blobs).join(refs.select("ref").distinct(), "ref", "left_anti").drop("ref")


def history(old: DataFrame, new: DataFrame, key: str, content: str) -> DataFrame:
    """Old contents as differences from the new: (key, diff); patch(new, diff) gives the old one."""
    return old.select(key, F.col(content).alias("_old")).join(new.select(key, F.col(content).alias("_new")), key).select(key, create_diff(S.raw(F.col("_new")), S.raw(F.col("_old"))).alias("diff"))


# -- chains: (hash, content binary, base); with a base the content is a difference from the base's content ------------------


def superseded(chain: DataFrame, pairs: DataFrame) -> DataFrame:
    """The chain after contents were replaced (old, new: hashes, of an old one one new one): whole old ones become differences from the new."""
    whole = chain.filter("base is null").select("hash", "content")
    pair = pairs.filter("old != new").groupBy("old").agg(F.min("new").alias("new"))
    old = whole.join(pair, whole["hash"] == F.col("old")).select("old", "new", F.col("content").alias("_old"))
    full = materialised(chain, pair.select(F.col("new").alias("hash")))
    made = old.join(full.select(F.col("hash").alias("new"), F.col("content").alias("_new")), "new").select(F.col("old").alias("hash"), create_diff(S.raw(F.col("_new")), S.raw(F.col("_old"))).alias("content"), F.col("new").alias("base"))
    made = saved(made, "superseded")
    return chain.join(made.select("hash"), "hash", "left_anti").select("hash", "content", "base").unionByName(made)


def materialised(chain: DataFrame, wanted: DataFrame) -> DataFrame:
    """(hash, content) of the wanted hashes, whole: from each the bases are followed to a whole content, then the differences are undone one after another. As many joins as the longest chain has links."""
    links = chain.select("hash", "base")
    paths = saved(wanted.select("hash").distinct().join(links, "hash").select(F.col("hash").alias("want"), F.col("hash").alias("at"), "base", F.lit(0).alias("far")), "chain")
    steps, level = [paths], paths
    while not (more := level.filter("base is not null")).isEmpty():
        level = saved(more.select("want", F.col("base").alias("hash"), "far").join(links, "hash").select("want", F.col("hash").alias("at"), "base", (F.col("far") + 1).alias("far")), "chain")
        steps.append(level)
    done = None
    for far in range(len(steps) - 1, -1, -1):
        here = steps[far].join(chain.select(F.col("hash").alias("at"), "content"), "at")
        now = here.filter("base is null").select("want", "content")
        if done is not None:
            now = now.unionByName(here.filter("base is not null").select("want", F.col("content").alias("_diff")).join(done.withColumnRenamed("content", "_base"), "want").select("want", patch(F.col("_base"), F.col("_diff")).alias("content")))
        done = saved(now, "chain")
    return done.withColumnRenamed("want", "hash")


def merged(chain: DataFrame, used: DataFrame) -> DataFrame:
    """The chain with the used hashes only: those whose base goes are made differences from the next base that stays, or whole contents where none does."""
    kept = saved(chain.join(used.select("hash").distinct(), "hash", "left_semi").select("hash", "base"), "merge")
    links, stay, at = chain.select(F.col("hash").alias("base"), F.col("base").alias("_next")), kept.select(F.col("hash").alias("base"), F.lit(True).alias("_stays")), kept
    while True:
        looked = saved(at.join(stay, "base", "left").join(links, "base", "left"), "merge")
        if looked.filter("base is not null and _stays is null").isEmpty():
            break
        at = looked.select("hash", F.when(F.col("_stays").isNull(), F.col("_next")).otherwise(F.col("base")).alias("base"))
    moved = at.join(kept.withColumnRenamed("base", "_before"), "hash").filter("not (base <=> _before)").select("hash", "base")
    whole = saved(materialised(chain, moved.select("hash").union(moved.filter("base is not null").select(F.col("base").alias("hash")))), "merge")
    again = moved.join(whole, "hash").join(whole.select(F.col("hash").alias("base"), F.col("content").alias("_base")), "base", "left")
    again = again.select("hash", F.when(F.col("base").isNull(), S.raw(F.col("content"))).otherwise(create_diff(F.col("_base"), F.col("content"))).alias("content"), "base")
    same = chain.join(kept.join(moved.select("hash"), "hash", "left_anti").select("hash"), "hash", "left_semi").select("hash", "content", "base")
    return same.unionByName(saved(again, "merge"))
