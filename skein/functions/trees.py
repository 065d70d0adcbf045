"""Rows and trees as YAML, and YAML in cells. A JSON scalar is a YAML scalar, so texts are written as JSON does."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from skein.operators.storage import saved


def _scalar(df: DataFrame, name: str) -> Column:
    """A cell as a JSON scalar; null gives null."""
    text = F.to_json(F.struct(F.col(f"`{name}`").alias("v")))
    return F.when(F.col(f"`{name}`").isNotNull(), F.substring(text, 6, 2**31 - 1).substr(F.lit(1), F.length(text) - 6))


def as_yaml(df: DataFrame, first: str = "- ", rest: str = "  ") -> Column:
    """A row as an entry of a YAML list: a line for each cell that is not null."""
    lines = F.filter(F.array(*[F.concat(F.lit(f"{c}: "), _scalar(df, c)) for c in df.columns]), lambda x: x.isNotNull())
    return F.concat(F.lit(first), F.array_join(lines, f"\n{rest}"), F.lit("\n"))


@F.pandas_udf(T.StringType())
def parsed_yaml(texts: pd.Series) -> pd.Series:
    """YAML texts as JSON; null for null, and for what is no YAML."""
    import yaml

    def one(text):
        try:
            return None if text is None else json.dumps(yaml.safe_load(text), default=str)
        except yaml.YAMLError:
            return None

    return texts.map(one)


def tree_as_yaml(rows: DataFrame, key: str = "id", parent: str = "parent_id") -> DataFrame:
    """(key, yaml) of every root, its children nested below it by key, level by level from the leaves; parent links are left out. A tree's text is one cell, as long as the tree: for trees that are to be read."""
    plain = [c for c in rows.columns if c != parent]
    above = rows.select(F.col(key).alias("_up"))
    level, levels = saved(rows.filter(F.col(parent).isNull()), "tree"), []
    while not level.isEmpty():
        levels.append(level)
        level = saved(rows.join(level.select(F.col(key).alias("_up")), rows[parent] == F.col("_up"), "left_semi"), "tree")
        if len(levels) > above.count():
            raise ValueError("ids repeat along a path")
    below = None
    for depth in range(len(levels) - 1, -1, -1):
        here = levels[depth]
        own = here.select(key, parent, as_yaml(here.select(*plain), "", "").alias("_own"))
        if below is not None:
            indented = F.concat(F.lit("  - "), F.regexp_replace(F.rtrim(F.col("yaml"), F.lit("\n")), "\n", "\n    "), F.lit("\n"))
            inner = below.select(F.col(parent).alias("_up"), F.struct(F.col(key).alias("k"), indented.alias("y")).alias("c")).groupBy("_up").agg(F.array_join(F.transform(F.sort_array(F.collect_list("c")), lambda c: c["y"]), "").alias("_inner"))
            own = own.join(inner, own[key] == F.col("_up"), "left")
            own = own.select(key, parent, F.when(F.col("_inner").isNull(), F.col("_own")).otherwise(F.concat("_own", F.lit("children:\n"), "_inner")).alias("yaml"))
        else:
            own = own.withColumnRenamed("_own", "yaml")
        below = own
    return below.select(key, "yaml") if below is not None else rows.select(key, F.lit("").alias("yaml")).limit(0)
