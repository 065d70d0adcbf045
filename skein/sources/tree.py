"""Trees of rows from and to file systems."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Contents over so many bytes are blobs.
INLINE = 512


def import_tree(spark: SparkSession, path: str) -> DataFrame:
    """(id, parent_id, name, type, content, is_blob) of a folder, read by Spark's file source: files are rows, and so are all folders above them."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    root = path.split("://")[-1].rstrip("/")
    rel = F.regexp_replace(F.regexp_replace("path", r"^[a-z]+:/*", "/"), "^" + root.replace(".", r"\."), "")
    files = files.select(rel.alias("_path"), "content")
    parts = F.filter(F.split("_path", "/"), lambda x: x != "")
    dirs = files.select(parts.alias("p")).filter("size(p) > 1").select(F.explode(F.transform(F.sequence(F.lit(1), F.size("p") - 1), lambda n: F.concat(F.lit("/"), F.array_join(F.slice(F.col("p"), 1, n), "/")))).alias("_path")).distinct()
    every = files.withColumn("type", F.lit("file")).unionByName(dirs.withColumn("type", F.lit("dir")).withColumn("content", F.lit(None).cast("binary")))
    up = F.regexp_replace("_path", "/[^/]*$", "")
    return every.select(F.md5("_path").alias("id"), F.when(up != "", F.md5(up)).alias("parent_id"), F.regexp_extract("_path", "([^/]*)$", 1).alias("name"), "type", "content", (F.octet_length("content") > INLINE).alias("is_blob"), "_path")


def export_tree(files: DataFrame, target: str) -> None:
    """Writes rows with _path and content below a folder that all workers share."""

    def put(rows):
        for r in rows:
            if r["content"] is not None:
                to = target + r["_path"]
                os.makedirs(os.path.dirname(to), exist_ok=True)
                with open(to, "wb") as f:
                    f.write(r["content"] if isinstance(r["content"], (bytes, bytearray)) else r["content"].encode())

    files.select("_path", "content").foreachPartition(put)


def totals(files: DataFrame) -> DataFrame:
    return files.filter("type = 'file'").agg(F.count("*").alias("files"), F.coalesce(F.sum(F.octet_length("content")), F.lit(0)).alias("bytes"))


def geography(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Regions, their nations and the nations' customers as one tree: id, parent_id, name, type."""
    t = lambda n: spark.read.parquet(f"{sf_dir}/{n}.parquet")
    s = lambda p, c: F.concat(F.lit(p), F.col(c).cast("string"))
    r = t("region").select(s("r", "r_regionkey").alias("id"), F.lit(None).cast("string").alias("parent_id"), F.col("r_name").alias("name"), F.lit("region").alias("type"))
    n = t("nation").select(s("n", "n_nationkey").alias("id"), s("r", "n_regionkey").alias("parent_id"), F.col("n_name").alias("name"), F.lit("nation").alias("type"))
    c = t("customer").select(s("c", "c_custkey").alias("id"), s("n", "c_nationkey").alias("parent_id"), F.col("c_name").alias("name"), F.lit("customer").alias("type"))
    return r.unionByName(n).unionByName(c)
