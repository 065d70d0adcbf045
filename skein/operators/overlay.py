"""Federation: rows of other providers merged over a table's."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def merge(base: DataFrame, over: DataFrame, key: str = "id", arrival: str | None = None) -> DataFrame:
    """Rows of the overlay update those of equal key, column by column, and add the others; of several overlay rows the last by arrival wins; rows without key are appended."""
    keyed = over.filter(F.col(key).isNotNull())
    if arrival:
        newest = Window.partitionBy(key).orderBy(F.desc(arrival))
        keyed = keyed.withColumn("_n", F.row_number().over(newest)).filter("_n = 1").drop("_n", arrival)
    columns = [*base.columns, *[c for c in keyed.columns if c not in base.columns]]
    joined = base.alias("b").join(keyed.alias("o"), F.col(f"b.{key}") == F.col(f"o.{key}"), "full_outer")
    side = lambda c: [F.col(f"{a}.`{c}`") for a, df in (("o", keyed), ("b", base)) if c in df.columns]
    merged = joined.select(*[F.coalesce(*side(c)).alias(c) for c in columns])
    loose = over.filter(F.col(key).isNull()).drop(*([arrival] if arrival else []))
    return merged.unionByName(loose, allowMissingColumns=True)
