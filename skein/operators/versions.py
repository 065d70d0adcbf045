"""Version-appended tables: every change adds a row (_rid, _seq, _tombstone, columns); reads take the newest."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def snapshot(versions: DataFrame, seq: int | None = None, deleted: bool = False) -> DataFrame:
    """The rows as they were at seq (or are): the newest version of each, gone if that is a tombstone. One shuffle on _rid, with partial maxima before it."""
    seen = versions if seq is None else versions.filter(F.col("_seq") <= seq)
    rest = [c for c in versions.columns if c != "_rid"]
    newest = seen.groupBy("_rid").agg(F.max_by(F.struct(*rest), "_seq").alias("_v")).select("_rid", *[F.col(f"_v.`{c}`").alias(c) for c in rest])
    return newest if deleted else newest.filter(~F.col("_tombstone"))


def conflicts(versions: DataFrame, touched: DataFrame, seq: int) -> DataFrame:
    """The touched rows (_rid) that changed after seq."""
    changed = versions.filter(F.col("_seq") > seq).select("_rid").distinct()
    return touched.select("_rid").distinct().join(changed, "_rid", "left_semi")


def collect_garbage(versions: DataFrame, snapshots: list[int]) -> DataFrame:
    """The newest version of each row, be it a tombstone, and those that the given snapshots see."""
    keys = ["_rid", "_seq"]
    kept = versions.groupBy("_rid").agg(F.max("_seq").alias("_seq"))
    for s in snapshots:
        kept = kept.unionByName(versions.filter(F.col("_seq") <= s).groupBy("_rid").agg(F.max("_seq").alias("_seq")))
    return versions.join(kept.distinct(), keys, "left_semi")


def burn(versions: DataFrame, rids: DataFrame) -> DataFrame:
    """The history without some rows at all."""
    return versions.join(rids.select("_rid"), "_rid", "left_anti")
