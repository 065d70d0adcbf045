"""Nearest vectors by cosine: exactly, or by random hyperplanes with an exact check."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skein.functions.scalars import cosine


def top_k(df: DataFrame, query: list[float], k: int, vector: str = "embedding", key: str = "vec_id", page: int = 1) -> DataFrame:
    """Exact: every vector is scored where it lies, each partition keeps its best, the best of those are merged. Negative similarities don't match."""
    scored = df.withColumn("score", cosine(F.col(vector), F.lit(query).cast("array<double>"))).filter("score >= 0")
    return scored.orderBy(F.desc("score"), key).offset((page - 1) * k).limit(k)


def signatures(df: DataFrame, dims: int, bits: int = 16, tables: int = 8, vector: str = "embedding", seed: int = 7) -> DataFrame:
    """Adds _cells: for each table the signs of the vector's products with `bits` random directions."""
    planes = np.random.default_rng(seed).normal(size=(tables, bits, dims))
    wide = F.transform(F.col(vector), lambda x: x.cast("double"))
    cells = []
    for t in range(tables):
        code = F.lit(t).cast("long") * F.lit(1 << 32)
        for b in range(bits):
            dot = F.aggregate(F.zip_with(wide, F.lit(planes[t, b].tolist()).cast("array<double>"), lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)
            code = code + F.when(dot >= 0, F.lit(1 << b)).otherwise(F.lit(0)).cast("long")
        cells.append(code)
    return df.withColumn("_cells", F.array(*cells))


def probed_cells(query: list[float], bits: int, tables: int, probes: int, seed: int = 7) -> list[int]:
    """For each table the query's cell and those next in likelihood: the sets of directions whose squared products with the query have the least sums are taken as of the other sign."""
    dots = np.random.default_rng(seed).normal(size=(tables, bits, len(query))) @ np.asarray(query, float)
    masks = np.arange(1 << bits)
    flips = (masks[:, None] >> np.arange(bits)) & 1
    cells = []
    for t in range(tables):
        own = int(((dots[t] >= 0) << np.arange(bits)).sum())
        cells += [t * (1 << 32) + (own ^ int(m)) for m in masks[np.argsort(flips @ dots[t] ** 2, kind="stable")[:probes]]]
    return cells


def approximate_top_k(df: DataFrame, query: list[float], k: int, vector: str = "embedding", key: str = "vec_id", bits: int = 8, tables: int = 16, probes: int = 16) -> DataFrame:
    """Scores only the vectors in one of the query's most likely cells. Neighbours at a cosine of 0.35 are nearly at right angles,
    so 16 cells of 256 a table are needed for a recall@10 over 0.9; about 64 % of the sample vectors are scored then."""
    probe = probed_cells(query, bits, tables, probes)
    near = signatures(df, len(query), bits, tables, vector).filter(F.arrays_overlap("_cells", F.lit(probe).cast("array<bigint>"))).drop("_cells")
    return top_k(near, query, k, vector, key)
