"""Exact deduplication by distributed MSD radix partitioning.

A document's radix string is its byte length followed by its UTF-8 bytes, so no string is a proper prefix of another and a
group whose bytes are used up holds equal texts; equality never rests on a digest.

1. Where the rows lie, chunks of bounded size are split by successive bytes and each group of equal texts becomes one row
   (its text once, its ids, the largest id), so a group of copies that holds a third of all rows sends one row a chunk.
2. These rows are dealt out by their first digit (length and first bytes) and sorted by it. A task reads one run of equal
   digits after another and splits it by the following bytes until groups are single or ended.
3. A run whose distinct texts exceed RUN_BYTES is dealt out anew by its next, wider digit, and so on. A run that is large
   only because it has many equal rows is streamed: its rows leave at once under a group number, and the totals follow.

Defined results: null text counts as empty, null ids sort first, of rows with equal text and id one stays, an empty table
gives an empty result, other columns are carried as they are whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from skein.llm.common import packed_rows, real_id, shared_dir, small_batches, table

#: Bytes of text that one local split holds, and that a run may hold in a task before it is dealt out by its next digit.
CHUNK_BYTES, RUN_BYTES = 16 << 20, 48 << 20
#: Ids in one row at most.
MEMBERS = 8192
#: Bytes of the first digit after the length; each further digit is eight times as wide.
DIGIT = 32

SETTLED, PENDING, TOTAL, DEFERRED = 0, 1, 2, 3


def msd_groups(texts: list[bytes]) -> list[list[int]]:
    """Groups of equal byte strings, as lists of their places: split by successive bytes, in digits of growing width, until a group is single or all its bytes are used."""
    done: list[list[int]] = []
    work = [(list(range(len(texts))), 0, 8)]
    while work:
        group, at, width = work.pop()
        if len(group) == 1:
            done.append(group)
            continue
        parts: dict[bytes, list[int]] = {}
        for i in group:
            parts.setdefault(texts[i][at : at + width], []).append(i)
        for digit, part in parts.items():
            if len(digit) < width:  # ended: these have no bytes left
                done.append(part)
            else:
                work.append((part, at + width, width * 2))
    return done


def _digit(level: int) -> tuple[int, int]:
    """Where the digit of a level begins and ends, in bytes."""
    begin = 0
    for k in range(level):
        begin += DIGIT * 8**k
    return begin, begin + DIGIT * 8**level


def _combine(batches: Iterator[pa.RecordBatch], rows: bool) -> Iterator[pa.RecordBatch]:
    """One row for each group of equal texts in a chunk; with rows, the row of its largest id too."""
    held, size = [], 0

    def split():
        part = pa.Table.from_batches(held)
        ids = part["_id"].to_numpy()
        texts = part["_text"].cast(pa.binary()).to_pylist()
        keep, members, counts = [], [], []
        for group in msd_groups(texts):
            group.sort(key=lambda i: ids[i], reverse=True)
            for k in range(0, len(group), MEMBERS):
                piece = group[k : k + MEMBERS]
                keep.append(piece[0])
                members.append(ids[piece])
                counts.append(len(piece))
        lengths = np.array([len(texts[i]) for i in keep], np.int64)
        offsets = np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)
        out = {
            "length": pa.array(lengths),
            "digit": pa.array([texts[i][:DIGIT] for i in keep], pa.binary()),
            "text": pa.array([texts[i] for i in keep], pa.binary()),
            "members": pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(members))),
        }
        if rows:
            out["_row"] = part["_row"].combine_chunks().take(pa.array(keep))
        yield from pa.table(out).combine_chunks().to_batches(max_chunksize=2000)

    for batch in batches:
        held.append(batch)
        size += batch.nbytes
        if size >= CHUNK_BYTES:
            yield from split()
            held, size = [], 0
    if held and sum(map(len, held)):
        yield from split()


def _settle(batches: Iterator[pa.RecordBatch], level: int, rows: bool) -> Iterator[pa.RecordBatch]:
    """The rows of a partition, sorted by length and digit, with their groups: see the kinds above."""
    begin, end = _digit(level + 1)

    def lead(tbl: pa.Table) -> np.ndarray:
        return np.array([m[0].as_py() for m in tbl["members"]], np.int64) if len(tbl) else np.empty(0, np.int64)

    def out(tbl: pa.Table, kind, keep, size, sha, keeper, gid=None, deferred=False):
        n = len(tbl)
        cols = {
            "kind": pa.array(np.full(n, kind, np.int32)),
            "members": tbl["members"],
            "keep_id": pa.array(keep, pa.int64()),
            "group_size": pa.array(size, pa.int64()),
            "sha": pa.array(sha, pa.string()),
            "keeper": pa.array(keeper, pa.bool_()),
            "gid": pa.array(gid if gid is not None else [None] * n, pa.string()),
            "length": tbl["length"],
            "digit": pa.array([t[begin:end] for t in tbl["text"].to_pylist()], pa.binary()) if deferred else pa.nulls(n, pa.binary()),
            "text": tbl["text"] if deferred else pa.nulls(n, pa.binary()),
        }
        if rows:
            row = tbl["_row"].combine_chunks()
            if not deferred and kind == SETTLED:
                row = pa.array([None] * n, row.type) if not any(keeper) else pa.concat_arrays([row, pa.nulls(1, row.type)]).take(pa.array([i if k else n for i, k in enumerate(keeper)]))
            cols["_row"] = row
        return pa.table(cols).combine_chunks().to_batches(max_chunksize=1000)

    def settle(tbl: pa.Table, runs: list[tuple[int, int]]):
        """All runs lie whole in the table."""
        if not len(tbl):
            return
        texts, sizes = tbl["text"].to_pylist(), np.diff(tbl["members"].combine_chunks().offsets.to_numpy())
        heads, n = lead(tbl), len(tbl)
        keep, size, sha, keeper = heads.copy(), sizes.astype(np.int64), [None] * n, np.ones(n, bool)
        for a, b in runs:
            groups = [[a]] if b - a == 1 else [[a + i for i in g] for g in msd_groups(texts[a:b])]
            for g in groups:
                digest = hashlib.sha256(texts[g[0]]).hexdigest()
                for i in g:
                    sha[i] = digest
                if len(g) > 1:
                    best = max(g, key=lambda i: heads[i])
                    keep[g], size[g], keeper[g] = heads[best], sizes[g].sum(), False
                    keeper[best] = True
        yield from out(tbl, SETTLED, keep, size, sha, keeper)

    held: pa.Table | None = None  # the last run so far
    key, large = None, None  # large: of a run that is streamed or deferred
    prefix = f"{level}"

    def close():
        """The totals of a streamed run."""
        if large and large["mode"] == "stream":
            for text, g in large["groups"].items():
                yield from pa.table({
                    "kind": pa.array([TOTAL], pa.int32()), "members": pa.array([None], pa.list_(pa.int64())), "keep_id": pa.array([g["max"]], pa.int64()), "group_size": pa.array([g["n"]], pa.int64()),
                    "sha": pa.array([hashlib.sha256(text).hexdigest()]), "keeper": pa.array([False]), "gid": pa.array([g["gid"]]), "length": pa.array([len(text)], pa.int64()), "digit": pa.nulls(1, pa.binary()), "text": pa.nulls(1, pa.binary()),
                } | ({"_row": pa.nulls(1, row_type)} if rows else {})).to_batches()

    def feed(tbl: pa.Table):
        if large["mode"] == "defer":
            yield from out(tbl, DEFERRED, [None] * len(tbl), [None] * len(tbl), [None] * len(tbl), [False] * len(tbl), deferred=True)
            return
        texts, groups = tbl["text"].to_pylist(), large["groups"]
        known = list(groups)
        heads, sizes = lead(tbl), np.diff(tbl["members"].combine_chunks().offsets.to_numpy())
        gid = [None] * len(tbl)
        for g in msd_groups(known + texts):
            g.sort()
            new = [i - len(known) for i in g if i >= len(known)]
            if not new:
                continue
            text = known[g[0]] if g[0] < len(known) else texts[new[0]]
            entry = groups.setdefault(text, {"gid": f"{prefix}:{heads[new[0]]}:{len(text)}", "n": 0, "max": heads[new[0]]})
            for i in new:
                entry["n"] += int(sizes[i])
                entry["max"] = max(entry["max"], heads[i])
                gid[i] = entry["gid"]
        yield from out(tbl, PENDING, heads, sizes, [None] * len(tbl), [False] * len(tbl), gid)

    row_type = None
    for batch in batches:
        tbl = pa.Table.from_batches([batch])
        if rows and row_type is None:
            row_type = batch.schema.field("_row").type
        if held is not None:
            tbl = pa.concat_tables([held, tbl])
            held = None
        if not len(tbl):
            continue
        lengths, digits = tbl["length"].to_numpy(), tbl["digit"].to_pylist()
        cuts = [0] + [i for i in range(1, len(tbl)) if lengths[i] != lengths[i - 1] or digits[i] != digits[i - 1]] + [len(tbl)]
        runs = list(zip(cuts, cuts[1:], strict=False))
        if large:
            if (lengths[0], digits[0]) == key:
                yield from feed(tbl.slice(*[runs[0][0], runs[0][1]]))
                runs = runs[1:]
                if not runs:
                    continue
            yield from close()
            large = None
        whole, (a, b) = runs[:-1], runs[-1]
        if whole:
            lo = whole[0][0]
            yield from settle(tbl.slice(lo, whole[-1][1] - lo).combine_chunks(), [(x - lo, y - lo) for x, y in whole])
        held, key = tbl.slice(a, b - a).combine_chunks(), (lengths[a], digits[a])
        if held["text"].nbytes > RUN_BYTES:
            texts = held["text"].to_pylist()
            distinct = sum(len(texts[g[0]]) for g in msd_groups(texts))
            large = {"mode": "stream" if distinct <= RUN_BYTES // 2 or begin >= key[0] else "defer", "groups": {}}
            yield from feed(held)
            held = None
    if large:
        yield from close()
    if held is not None:
        yield from settle(held, [(0, len(held))])


def radix_groups(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", rows: bool = False) -> DataFrame:
    """(members, keep_id, group_size, sha, keeper[, _row]): the rows of step 1 with their groups; of each group one row has keeper, and with rows the whole row that stays."""
    spark = df.sparkSession
    small_batches(spark)
    source = packed_rows(df, id_col, text_col)
    row = [T.StructField("_row", source.schema["_row"].dataType)] if rows else []
    local = T.StructType([T.StructField("length", T.LongType()), T.StructField("digit", T.BinaryType()), T.StructField("text", T.BinaryType()), T.StructField("members", T.ArrayType(T.LongType())), *row])
    ended = T.StructType([T.StructField("kind", T.IntegerType()), T.StructField("members", T.ArrayType(T.LongType())), T.StructField("keep_id", T.LongType()), T.StructField("group_size", T.LongType()), T.StructField("sha", T.StringType()), T.StructField("keeper", T.BooleanType()), T.StructField("gid", T.StringType()), *local.fields[:3], *row])
    names = ["members", "keep_id", "group_size", "sha", "keeper", *[f.name for f in row]]
    work = source.select("_id", "_text", *[f.name for f in row]).mapInArrow(lambda it: _combine(it, rows), local)
    # with no run over the limit, nothing is streamed or dealt out again, and the rows need not be stored on the way
    size = F.octet_length("_text").cast("long")
    most = source.groupBy(size.alias("n"), F.substring(F.col("_text").cast("binary"), 1, DIGIT).alias("d")).agg(F.sum(size + 64).alias("s")).agg(F.max("s").alias("s")).first()["s"]
    if (most or 0) <= RUN_BYTES:
        dealt = work.repartition("length", "digit").sortWithinPartitions("length", "digit")
        return dealt.mapInArrow(lambda it: _settle(it, 0, rows), ended).select(*names)
    level, path, parts = 0, shared_dir(spark, "radix"), []
    while True:
        dealt = work.repartition("length", "digit").sortWithinPartitions("length", "digit")
        settled = dealt.mapInArrow(lambda it, level=level: _settle(it, level, rows), ended)
        settled.write.parquet(f"{path}/{level}")
        found = spark.read.schema(ended).parquet(f"{path}/{level}")
        parts.append(found.drop("text", "digit", "length"))
        deferred = found.filter(F.col("kind") == DEFERRED)
        if deferred.isEmpty():
            break
        work, level = deferred.select(*local.names), level + 1
    every = parts[0]
    for part in parts[1:]:
        every = every.unionByName(part)
    out = every.filter(F.col("kind") == SETTLED).select(*names)
    streamed = every.filter(F.col("kind") == PENDING)
    if not streamed.isEmpty():
        total = every.filter(F.col("kind") == TOTAL).select("gid", F.col("keep_id").alias("k"), F.col("group_size").alias("n"), F.col("sha").alias("s"))
        first = streamed.groupBy("gid").agg(F.max("keep_id").alias("m"), F.max_by(F.element_at("members", -1), "keep_id").alias("_"))
        joined = streamed.join(total, "gid").join(first.select("gid", "m"), "gid")
        # several rows may have the largest id (repeated rows); one of them keeps it
        mark = F.row_number().over(Window.partitionBy("gid", "keep_id").orderBy(F.size("members").desc(), F.hash("members"))) if rows else F.lit(1)
        late = joined.withColumn("_one", mark).select("members", F.col("k").alias("keep_id"), F.col("n").alias("group_size"), F.col("s").alias("sha"), ((F.col("keep_id") == F.col("m")) & (F.col("_one") == 1)).alias("keeper"), *[f.name for f in row])
        out = out.unionByName(late)
    return out


def decisions(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of df: doc_id, keep_id, group_size, kept, text_sha256."""
    spark = df.sparkSession
    groups = radix_groups(df, id_col, text_col)
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    one = groups.repartition(n).select("keep_id", "group_size", "sha", "keeper", F.posexplode("members").alias("_at", "_id"))
    return one.select(
        real_id("_id").alias("doc_id"), real_id("keep_id").alias("keep_id"), "group_size", (F.col("keeper") & (F.col("_at") == 0)).alias("kept"), F.col("sha").alias("text_sha256")
    )


def distinct_rows(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of df without the copies: of equal texts the row with the largest id, all columns as they were."""
    return radix_groups(df, id_col, text_col, rows=True).filter("keeper").select([F.col("_row").getField(c).alias(c) for c in df.columns])


def op3_exact_dedup(spark, sf_dir: str) -> DataFrame:
    return decisions(table(spark, sf_dir, "documents"))


SQL = """
SELECT doc_id, max(doc_id) OVER (PARTITION BY coalesce(text, '')) AS keep_id, count(*) OVER (PARTITION BY coalesce(text, '')) AS group_size,
       doc_id = max(doc_id) OVER (PARTITION BY coalesce(text, '')) AS kept, sha256(coalesce(text, '')) AS text_sha256
FROM documents
"""
