"""An engine over one schemaless table: conditional writes, snapshots, locks, watches, paths, blobs and overlays.

The table is a version-appended Parquet folder (every write a new part). Its state is a numbered manifest: the parts, their
columns and types, and which columns hold sealed values or blobs. A commit writes the next manifest beside its place and
renames it, so a crash leaves the one before; a transaction's writes are one commit. State that is small by nature
(locks, watches, registries) lives in the driver, which is the only writer.

Sealed values are texts `sealed:` with the encrypted bytes, unsealed on reading by the first registered key that fits (null
by none). A column with blobs has its contents in a table by digest, and the digest in a column `#name` of the row.
"""

from __future__ import annotations

import json
import random
import uuid
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from skein.functions import scalars as S
from skein.operators import blobs, graph, pipeline, versions
from skein.operators.overlay import merge
from skein.plans import lang
from skein.plans.lang import Clause, Group, Statement
from skein.plans.predicates import View, compile_any

OK, LOCKED, CONFLICT = 0, -1, -2
SYSTEM = ("_rid", "_seq", "_tombstone")
#: Contents of files over so many bytes are blobs; manifests that are kept; what sealed values begin with.
INLINE, MANIFESTS, SEALED = 512, 3, "sealed:"
TREE = ("parent_id", "name", "type", "content", "perms")
BASE = "_rid long, _seq long, _tombstone boolean"


@dataclass
class Transaction:
    number: int
    seq: int
    groups: list[Group]
    blocking: bool
    pending: list[tuple] = field(default_factory=list)
    touched: list[DataFrame] = field(default_factory=list)


@dataclass
class Inbox:
    groups: list[Group]
    callback: Callable | None
    rows: list[dict] = field(default_factory=list)


def virtual(name: str) -> bool:
    return name.startswith("_") or name.endswith((":watch", ":virtual"))


class Engine:
    def __init__(self, spark: SparkSession, path: str, keys: list[bytes] | None = None):
        self.spark, self.path, self.keys = spark, path.rstrip("/"), list(keys or [])
        self.transactions: dict[int, Transaction] = {}
        self.watches: dict[int, Inbox] = {}
        self.readers: list[Callable] = []
        self.writers: list[Callable] = []
        self.verbs: dict[str, Callable] = {}
        self.volatile: list[DataFrame] = []
        self.numbers = 0
        self.staged: list[str] | None = None  # folders to delete once a transaction's manifest stands
        self._mount()

    # -- the table ----------------------------------------------------------------------------------------------------

    def _files(self, path: str):
        place = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        return place.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), place

    def _manifests(self) -> list[int]:
        """Numbers of the manifests, ascending."""
        fs, place = self._files(f"{self.path}/manifests")
        names = [f.getPath().getName() for f in fs.listStatus(place)] if fs.exists(place) else []
        return sorted(int(n) for n in names if n.isdigit())

    def _mount(self) -> None:
        self.parts, self.chains, self.sealed, self.blobs = [], [], set(), set()
        self.schema = T.StructType.fromDDL(BASE)
        self.rid = self.seq = self.manifest = 0
        self.hidden: dict[tuple, DataFrame | None] = {}
        self.paths: dict[tuple, DataFrame] = {}
        found = self._manifests()
        if not found:
            return
        self.manifest = found[-1]
        state = json.loads(self.spark.read.text(f"{self.path}/manifests/{self.manifest}", wholetext=True).first()["value"])
        self.parts, self.chains, self.sealed, self.blobs = state["parts"], state["chains"], set(state["sealed"]), set(state["blobs"])
        self.schema, self.rid, self.seq = T.StructType.fromJson(state["schema"]), state["rid"], state["seq"]

    def _commit(self, gone: list[str] | None = None) -> None:
        """Writes the next manifest; then folders that it no longer lists, and the oldest manifests, are deleted. Inside a transaction all that waits for its end."""
        if self.staged is not None:
            self.staged += gone or []
            return
        state = {"parts": self.parts, "chains": self.chains, "sealed": sorted(self.sealed), "blobs": sorted(self.blobs), "schema": self.schema.jsonValue(), "rid": self.rid, "seq": self.seq}
        fs, beside = self._files(f"{self.path}/manifests/.{uuid.uuid4().hex}")
        out = fs.create(beside)
        out.write(bytearray(json.dumps(state).encode()))
        out.close()
        if self._manifests()[-1:] not in ([], [self.manifest]) or not fs.rename(beside, self._files(f"{self.path}/manifests/{self.manifest + 1}")[1]):
            raise OSError(f"{self.path} has a later manifest than {self.manifest}: another engine writes to it")
        self.manifest += 1
        for p in gone or []:
            self._delete(p)
        for n in self._manifests()[:-MANIFESTS]:
            self._delete(f"{self.path}/manifests/{n}")

    def _state(self) -> tuple:
        return list(self.parts), list(self.chains), set(self.sealed), set(self.blobs), list(self.volatile), self.schema, self.rid, self.seq

    def _restore(self, state: tuple) -> None:
        self.parts, self.chains, self.sealed, self.blobs, self.volatile, self.schema, self.rid, self.seq = state

    def _stored(self) -> DataFrame:
        return self.spark.read.schema(self.schema).parquet(*self.parts) if self.parts else self.spark.createDataFrame([], self.schema)

    def _versions(self) -> DataFrame:
        stored = self._stored()
        for df in self.volatile:
            stored = stored.unionByName(df, allowMissingColumns=True)
        return stored

    def _append(self, rows: DataFrame, volatile: bool = False) -> None:
        """A new part; columns that are known get their known types."""
        known = {f.name: f.dataType for f in self.schema}
        rows = rows.select(*[F.col(f"`{c}`").cast(known.get(c, kind.dataType)).alias(c) for c, kind in zip(rows.columns, rows.schema, strict=True)])
        self.schema = T.StructType([*self.schema, *[T.StructField(f.name, f.dataType) for f in rows.schema if f.name not in known]])
        if volatile:
            self.volatile.append(rows)
            return
        part = f"{self.path}/rows/{uuid.uuid4().hex}"
        rows.write.parquet(part)
        self.parts.append(part)
        self._commit()

    def _unsealed(self, rows: DataFrame) -> DataFrame:
        for c in self.sealed & set(rows.columns):
            text = F.col(f"`{c}`")
            plain = F.decode(S.decrypt(F.unbase64(F.substring(text, len(SEALED) + 1, 2**31 - 1)), self.keys), "UTF-8")
            rows = rows.withColumn(c, F.when(text.startswith(SEALED), plain).otherwise(text))
        return rows

    def _nodes(self, seq: int | None = None, groups: list[Group] | None = None, hidden: bool = False, names: list[str] | None = None) -> DataFrame:
        """The rows as they are (or were at seq). With path clauses in the groups, or without groups, rows get their _path. Rows of the tree /perms are left out unless hidden ones are asked for. names: the columns that are needed, of which those with blobs are resolved (None: all)."""
        now = self._unsealed(versions.snapshot(self._versions(), seq))
        for c in ("id", *TREE) if groups is None or any(c.op == "path" for g in groups for c in g.clauses) else ():
            if c not in now.columns:
                now = now.withColumn(c, F.lit(None).cast("string"))
        paths = None if groups is None else {str(c.value) for g in groups for c in g.clauses if c.op == "path"}
        asks = hidden or paths is not None and any(p.strip("/'\"").startswith("perms/") for g in groups for c in g.clauses for p in [str(c.value)])
        whole = now
        if not asks and (below := self._hidden(now, seq)) is not None:
            now = now.join(below, "_rid", "left_anti")
        if paths is None or paths:
            walked = [self._walked(whole, seq, p) for p in sorted(paths)] if paths else [self._walked(whole, seq)]
            known = graph._all(walked)
            now = now.join(known.distinct() if len(walked) > 1 else known, "_rid", "left")
        return self._resolved(now, names if groups is None or names is None else [*names, *[c.col for g in groups for c in g.clauses]])

    def _walked(self, now: DataFrame, seq: int | None, pattern: str | None = None) -> DataFrame:
        """(_rid, _path) of the rows that hang on a root, or whose path matches. Walks of any depth go over a small table of their own, and that of the whole tree is kept until the table changes."""
        tree = now.select("_rid", "id", "parent_id", "name")
        if pattern is not None and "**" not in pattern:
            return graph.with_paths(tree, pattern=pattern).select("_rid", "_path")
        key = (seq, self.seq, self.manifest, len(self.parts), len(self.volatile))
        if key in self.paths:
            return self.paths[key] if pattern is None else self.paths[key].filter(F.col("_path").rlike(S.path_regex(pattern)))
        found = graph.with_paths(graph.saved(tree, "tree"), pattern=pattern).select("_rid", "_path")
        if pattern is None:
            self.paths = {key: found}
        return found

    def _hidden(self, now: DataFrame, seq: int | None) -> DataFrame | None:
        """Numbers (_rid) of the rows of the tree /perms, if there is one; kept until the table changes."""
        if not {"name", "id", "parent_id"} <= set(now.columns):
            return None
        key = (seq, self.seq, self.manifest, len(self.parts), len(self.volatile))
        if key not in self.hidden:
            tree = now.select("_rid", "id", "parent_id", "name")
            top = tree.filter(F.col("parent_id").isNull() & (F.col("name") == "perms"))
            below = None if top.isEmpty() else graph.closure(top, graph.saved(tree, "tree"), [lang.follow(("parent_id", "=", "parent.id"))], "_rid").select("_rid")
            self.hidden = {key: below}
        return self.hidden[key]

    def _resolved(self, rows: DataFrame, names: list[str] | None = None) -> DataFrame:
        """Contents in place of digests; with `name:diff` among the names the difference that a content is stored as, in _diff_name."""
        bare = None if names is None else {n.split(":")[0].split("[")[0] for n in names}
        for c in sorted(self.blobs & set(rows.columns)):
            if bare is not None and c not in bare or f"#{c}" not in rows.columns:
                continue
            digest, chain = F.col(f"`#{c}`"), self._chain()
            whole = blobs.materialised(chain, rows.filter(digest.isNotNull()).select(digest.alias("hash"))).select(F.col("hash").alias("_hash"), F.col("content").alias("_content"))
            content = F.decode("_content", "UTF-8") if dict(rows.dtypes)[c] == "string" else F.col("_content")
            rows = rows.join(whole, digest == F.col("_hash"), "left").withColumn(c, F.coalesce(F.col(f"`{c}`"), content)).drop("_hash", "_content")
            if names is not None and f"{c}:diff" in names:
                kept = chain.filter("base is not null").select(F.col("hash").alias("_hash"), F.col("content").alias(f"_diff_{c}"))
                rows = rows.join(kept, digest == F.col("_hash"), "left").drop("_hash")
        return rows

    def _chain(self) -> DataFrame:
        """(hash, content, base): what blobs are stored as; of several writings the last counts."""
        empty = self.spark.createDataFrame([], "hash string, content binary, base string")
        found = [self.spark.read.parquet(p).withColumn("_n", F.lit(n)) for n, p in enumerate(self.chains)]
        return graph._all(found).groupBy("hash").agg(F.max_by(F.struct("content", "base"), "_n").alias("v")).select("hash", "v.content", "v.base") if found else empty

    def _put_blobs(self, chain: DataFrame) -> None:
        part = f"{self.path}/blobs/{uuid.uuid4().hex}"
        chain.select("hash", S.raw(F.col("content")).alias("content"), "base").write.parquet(part)
        self.chains.append(part)

    def _blobbed(self, rows: DataFrame, columns: list[str], all_: bool = True) -> DataFrame:
        """The rows with digests in place of some columns' contents, which are stored, empty ones too; or only where there was a digest before."""
        for c in columns:
            kind, content = dict(rows.dtypes)[c], S.raw(F.col(f"`{c}`"))
            before = F.col(f"`#{c}`").isNotNull() if f"#{c}" in rows.columns else F.lit(False)
            digest = F.coalesce(S.blake2b(content), F.lit(S.blake2b_of(b"")))  # the clause language has no digest of an empty text; as a content it is one like others
            rows = graph.saved(rows.withColumn(f"#{c}", F.when(content.isNotNull() & (F.lit(all_) | before), digest)), "blobs")
            new = rows.filter(F.col(f"`#{c}`").isNotNull()).groupBy(F.col(f"`#{c}`").alias("hash")).agg(F.first(content).alias("content"))
            self._put_blobs(new.join(self._chain().select("hash"), "hash", "left_anti").withColumn("base", F.lit(None).cast("string")))
            rows = rows.withColumn(c, F.when(F.col(f"`#{c}`").isNull(), F.col(f"`{c}`")).cast(kind))
            self.blobs.add(c)
        return rows

    def _seq_of(self, tx: int | None) -> int | None:
        if not tx:
            return None
        if tx not in self.transactions:
            raise KeyError(f"no transaction {tx}")
        return self.transactions[tx].seq

    # -- reading and writing ------------------------------------------------------------------------------------------

    def read(self, columns: list[str] | None = None, groups: list[Group] | None = None, limit: int = 0, page: int = 0, tx: int | None = None) -> DataFrame:
        groups = groups or []
        nodes = self._nodes(self._seq_of(tx), groups, names=columns or None)
        for provider in self.readers:
            extra = provider(self, groups)
            if extra is not None:
                mark = extra.withColumn("_rid", -F.xxhash64(*extra.columns))
                nodes = merge(nodes, mark, "id")
        found = pipeline.read(nodes, groups, columns, "_rid", limit, page)
        return found.drop(*[c for c in found.columns if c in (*SYSTEM, "_path", "_depth") or c.startswith(("#", "_diff_"))])

    def _blocked(self, rows: DataFrame, me: int | None) -> bool:
        """Whether rows match what another transaction has locked."""
        for t in self.transactions.values():
            if t.number == me or not t.groups:
                continue
            if t.blocking and not rows.filter(F.coalesce(compile_any(t.groups, View(rows)), F.lit(False))).isEmpty():
                return True
        return False

    def _notify(self, values: dict) -> None:
        if not self.watches:
            return
        plain = {k.split(":")[0]: str(v) for k, v in values.items() if v not in (None, "")}
        row = self.spark.createDataFrame([tuple(plain.values())], T.StructType([T.StructField(k, T.StringType()) for k in plain])) if plain else None
        for box in self.watches.values():
            if row is not None and (not box.groups or not row.filter(F.coalesce(compile_any(box.groups, View(row)), F.lit(False))).isEmpty()):
                if box.callback:
                    box.callback(plain)
                else:
                    box.rows.append(plain)

    def _values(self, values: dict) -> dict:
        out = {}
        for k, v in values.items():
            base, _, suffix = k.partition(":") if "[" not in k else (k, "", "")
            if suffix.startswith("generate"):
                v = self.new_id(base)
            out[base if suffix in ("generate", "blob") else k] = v
        return out

    def write(self, values: dict, groups: list[Group] | None = None, tx: int | None = None, volatile: bool = False, key: bytes | None = None) -> int:
        """0, a positive number if that ASSERT group matched a row, -1 if locked, -2 on conflict. With a key the values are sealed; columns `name:blob` are stored as blobs."""
        groups = groups or []
        inside = {k.split(":")[0].split("[")[0] for k in values if k.endswith(":blob") or ":blob[" in k}
        values = self._values(values)
        for writer in self.writers:
            if writer(values, groups):
                return OK
        if any(t.blocking and not t.groups and t.number != tx for t in self.transactions.values()):
            return LOCKED
        gates, rest = [g for g in groups if g.kind == "assert"], [g for g in groups if g.kind != "assert"]
        nodes = self._nodes(None, groups)
        if code := pipeline.exists(nodes, gates):
            return code
        if tx:
            t = self.transactions[tx]
            t.pending.append(("write", {**{k: v for k, v in values.items() if k not in inside}, **{f"{k}:blob": values[k] for k in inside if k in values}}, groups, (volatile, key)))
            if rest:
                t.touched.append(pipeline.match(self._nodes(t.seq, groups), rest, "_rid").select("_rid"))
            return OK
        stored = {k: v for k, v in values.items() if not virtual(k)}
        if not rest:
            code = self._insert(nodes, {k: v for k, v in stored.items() if v not in (None, "")}, tx, volatile, inside, key)
        else:
            code = self._update(pipeline.match(nodes, rest, "_rid"), stored, tx, volatile, inside, key)
        if code == OK:
            self._notify(values)
        return code

    def _seal(self, rows: DataFrame, columns: list[str], key: bytes | None) -> DataFrame:
        for c in [c for c in columns if dict(rows.dtypes).get(c) == "string"] if key else []:
            rows = rows.withColumn(c, F.concat(F.lit(SEALED), F.base64(S.encrypt(F.col(f"`{c}`"), key))))
            self.sealed.add(c)
        return rows

    def _insert(self, nodes: DataFrame, values: dict, tx: int | None, volatile: bool, inside: set[str], key: bytes | None) -> int:
        if not values:
            return OK
        if "id" in values and "id" in nodes.columns and not nodes.filter(F.col("id") == str(values["id"])).isEmpty():
            return OK
        kind = lambda v: T.BinaryType() if isinstance(v, bytes) else T.ArrayType(T.FloatType()) if isinstance(v, (list, tuple)) else T.StringType()
        plain = {k: v if isinstance(v, (bytes, list, tuple)) else str(v) for k, v in values.items()}
        row = self.spark.createDataFrame([tuple(plain.values())], T.StructType([T.StructField(k, kind(v)) for k, v in plain.items()]))
        if self._blocked(row, tx):
            return LOCKED
        row = self._seal(self._blobbed(row, sorted(inside & set(row.columns))), [c for c in row.columns if c not in inside and c != "id"], key)
        self.rid, self.seq = self.rid + 1, self.seq + 1
        self._append(row.withColumns({"_rid": F.lit(self.rid).cast("long"), "_seq": F.lit(self.seq).cast("long"), "_tombstone": F.lit(False)}), volatile)
        return OK

    def insert_rows(self, rows: DataFrame, volatile: bool = False, inside: list[str] | None = None, key: bytes | None = None) -> None:
        """Adds many rows at once; those with a known id are left out, of several with one id the first stays. Numbers follow from a place within each partition and the partitions' sizes. inside: columns stored as blobs."""
        rows = rows.drop(*[c for c in rows.columns if virtual(c)])
        if "id" in rows.columns:
            rows = graph.saved(rows, "rows").withColumn("_order", F.monotonically_increasing_id())
            first = rows.filter("id is not null").groupBy("id").agg(F.min("_order").alias("_order"))
            rows = rows.join(first.select("_order"), "_order", "left_semi").unionByName(rows.filter("id is null")).drop("_order")
            known = self._unsealed(versions.snapshot(self._versions()))
            rows = rows.join(known.select("id"), "id", "left_anti") if "id" in known.columns else rows
        rows = self._seal(self._blobbed(rows, inside or []), [c for c in rows.columns if c not in (inside or []) and c != "id"], key)
        rows = graph.saved(rows.withColumn("_part", F.spark_partition_id()).withColumn("_place", F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1)), "insert")
        starts, base = {}, self.rid
        for r in rows.groupBy("_part").agg(F.max("_place").alias("top")).orderBy("_part").collect():
            starts[r["_part"]] = base + 1
            base += r["top"] + 1
        self.seq += 1
        if not starts:
            return
        at = self.spark.createDataFrame(list(starts.items()), "_part int, _start long")
        numbered = rows.join(F.broadcast(at), "_part").withColumn("_rid", F.col("_start") + F.col("_place")).withColumn("_seq", F.lit(self.seq).cast("long")).withColumn("_tombstone", F.lit(False))
        self.rid = base
        self._append(numbered.drop("_part", "_place", "_start"), volatile)

    def _update(self, found: DataFrame, values: dict, tx: int | None, volatile: bool, inside: set[str], key: bytes | None) -> int:
        found = graph.saved(found.dropDuplicates(["_rid"]).drop("_path", "_depth"), "update")
        changed, touched = found, []
        for k, v in values.items():
            base, span = (k[: k.index("[")], k[k.index("[") + 1 : k.index("]")]) if "[" in k else (k, None)
            base = base.split(":")[0]
            touched.append(base)
            old = F.col(f"`{base}`") if base in changed.columns else F.lit(None).cast("string")
            if span is not None:
                new = F.lit(v if isinstance(v, bytes) else str(v))
                at = int(span.split(":")[0].rstrip("+") or 0)
                col = S.append(old, new) if span == "+" else S.insert_at(old, new, at) if span.endswith("+") else S.overwrite_at(old, new, at)
                col = col if dict(changed.dtypes).get(base) == "binary" else F.decode(col, "UTF-8")
            elif v in (None, ""):
                col = F.lit(None).cast(dict(changed.dtypes).get(base, "string"))
            else:
                col = F.lit(v if isinstance(v, bytes) else str(v)).cast(dict(changed.dtypes).get(base, "string"))
            changed = changed.withColumn(base, col)
        if self._blocked(found, tx) or self._blocked(changed, tx):
            return LOCKED
        if found.isEmpty():
            return OK
        self.seq += 1
        # what was a blob stays one; its former content becomes a difference from the new one
        was = [c for c in sorted(self.blobs) if f"#{c}" in found.columns and c in changed.columns]
        for c in sorted({*inside, *was} & set(changed.columns)):
            if c not in touched:
                changed = changed.withColumn(c, F.when(F.col(f"`#{c}`").isNull(), F.col(f"`{c}`")))
                continue
            changed = graph.saved(self._blobbed(changed, [c], c in inside), "update")
            if c in was:
                pairs = found.select("_rid", F.col(f"`#{c}`").alias("old")).join(changed.select("_rid", F.col(f"`#{c}`").alias("new")), "_rid").filter("old is not null and new is not null").select("old", "new")
                old = blobs.superseded(self._chain(), pairs)
                self._put_blobs(old.join(pairs.select(F.col("old").alias("hash")), "hash", "left_semi").filter("base is not null"))
        sealed = [c for c in self.sealed if c in changed.columns]
        changed = self._seal(changed, sorted({c for c in (touched if key else sealed) if c not in self.blobs}), key or (self.keys[0] if self.keys else None))
        self._append(changed.withColumn("_seq", F.lit(self.seq).cast("long")).withColumn("_tombstone", F.lit(False)), volatile)
        return OK

    def remove(self, groups: list[Group], tx: int | None = None, burn: bool = False) -> bool:
        """Deletes by tombstones, or with burn takes the rows, their history and the blobs that nothing else refers to out of every part. Nothing without clauses."""
        if not groups:
            return True
        if tx:
            t = self.transactions[tx]
            t.pending.append(("remove", None, groups, burn))
            t.touched.append(pipeline.match(self._nodes(t.seq, groups, True), groups, "_rid", True).select("_rid"))
            return True
        found = graph.saved(pipeline.match(self._nodes(None, groups, True), groups, "_rid", True).dropDuplicates(["_rid"]).drop("_path", "_depth"), "remove")
        if self._blocked(found, tx):
            return False
        if burn:
            self.volatile = [versions.burn(v, found) for v in self.volatile]
            self._rewritten(versions.burn(self._stored(), found))
        else:
            self.remove_rows(found.select("_rid"))
        return True

    def remove_rows(self, rids: DataFrame) -> None:
        """Tombstones for rows by their numbers (_rid)."""
        gone = graph.saved(versions.snapshot(self._versions()).join(rids, "_rid", "left_semi"), "remove")
        if not gone.isEmpty():
            self.seq += 1
            self._append(gone.withColumn("_seq", F.lit(self.seq).cast("long")).withColumn("_tombstone", F.lit(True)))

    def _rewritten(self, rows: DataFrame) -> None:
        """One part in place of all, and of the blobs those that its rows refer to."""
        old, part = [*self.parts, *self.chains], f"{self.path}/rows/{uuid.uuid4().hex}"
        rows.write.parquet(part)
        self.parts = [part]
        used = [self._stored().select(F.col(f"`#{c}`").alias("hash")) for c in sorted(self.blobs) if f"#{c}" in self.schema.names]
        if self.chains:
            kept = blobs.merged(self._chain(), graph._all(used).filter("hash is not null")) if used else self._chain().limit(0)
            self.chains = []
            self._put_blobs(kept)
        self._commit(old)

    def _delete(self, path: str) -> None:
        fs, place = self._files(path)
        fs.delete(place, True)

    def compact(self) -> None:
        """Keeps what the newest state and open transactions need, in one part; rows of which only tombstones are left go altogether."""
        if self.parts:
            kept = versions.collect_garbage(self._stored(), [t.seq for t in self.transactions.values()])
            self._rewritten(kept.join(kept.filter(~F.col("_tombstone")).select("_rid").distinct(), "_rid", "left_semi"))

    def new_id(self, column: str = "id") -> str:
        nodes = versions.snapshot(self._versions())
        while True:
            made = str(random.getrandbits(63))
            if column not in nodes.columns or nodes.filter(F.col(column) == made).isEmpty():
                return made

    # -- transactions -------------------------------------------------------------------------------------------------

    def begin(self, groups: list[Group] | None = None, blocking: bool = True) -> int:
        self.numbers += 1
        t = Transaction(self.numbers, self.seq, groups or [], blocking)
        if groups:
            t.touched.append(graph.saved(pipeline.match(self._nodes(None, groups), groups, "_rid").select("_rid"), "locked"))
        self.transactions[t.number] = t
        return t.number

    def unlock(self, number: int) -> int:
        """Commits: -2 if a row that the transaction read for writing has changed since; else its writes are done in order and become visible by one manifest. If one fails, none is done and its code is returned."""
        t = self.transactions.pop(number)
        if t.pending:
            for touched in t.touched:
                if not versions.conflicts(self._versions(), touched, t.seq).isEmpty():
                    return CONFLICT
        before, self.staged = self._state(), []
        try:
            for kind, values, groups, flag in t.pending:
                code = self.write(values, groups, None, *flag) if kind == "write" else OK if self.remove(groups, None, flag) else LOCKED
                if code != OK:
                    self._restore(before)
                    return code
        except BaseException:
            self._restore(before)
            raise
        finally:
            gone, self.staged = self.staged, None
        if t.pending:
            self._commit(gone)
        return OK

    def rollback(self, number: int) -> bool:
        return self.transactions.pop(number, None) is not None

    # -- watches ------------------------------------------------------------------------------------------------------

    def watch(self, groups: list[Group] | None = None, callback: Callable | None = None) -> int:
        self.numbers += 1
        self.watches[self.numbers] = Inbox(groups or [], callback)
        return self.numbers

    def pull(self, number: int) -> list[dict]:
        box = self.watches.get(number)
        rows, box.rows = (box.rows, []) if box else ([], None)
        return rows

    def unwatch(self, number: int) -> bool:
        return self.watches.pop(number, None) is not None

    # -- paths --------------------------------------------------------------------------------------------------------

    def _at(self, path: str, hidden: bool = True, names: tuple = ()) -> DataFrame:
        nodes = self._nodes(None, [], hidden, list(names))
        for c in ("id", *TREE):
            nodes = nodes if c in nodes.columns else nodes.withColumn(c, F.lit(None).cast("string"))
        return graph.at_path(nodes, path)

    def cat(self, path: str, start: int = 0, end: int = 0) -> bytes | None:
        found = self._at(path, names=("content",)).filter("content is not null").select(S.byte_slice(F.col("content"), start, end).alias("c")).first()
        return bytes(found["c"]) if found else None

    def ls(self, path: str = "/") -> DataFrame:
        columns = ("id", "name", "parent_id", "type", "perms")
        if not path.strip("/"):
            nodes = self._nodes(None, [], names=[])
            nodes = nodes.withColumns({c: F.lit(None).cast("string") for c in columns if c not in nodes.columns})
            return nodes.filter("parent_id is null").select(*columns).orderBy("name")
        nodes = self._nodes(None, [], path.strip("/").split("/")[0] == "perms", [])
        nodes = nodes.withColumns({c: F.lit(None).cast("string") for c in columns if c not in nodes.columns})
        above = graph.at_path(nodes, path).select(F.col("id").alias("_up"))
        return nodes.join(above, nodes["parent_id"] == F.col("_up"), "left_semi").select(*columns).orderBy("name")

    def tee(self, path: str, content: str | bytes, span: str | None = None, key: bytes | None = None) -> int:
        """Writes a file's content, or a span of it; folders above it are made. Contents over INLINE bytes are blobs."""
        size = len(content if isinstance(content, bytes) else content.encode())
        column = "content:blob" if size > INLINE else "content"
        found = self._at(path).select("id").first()
        if found is not None:
            return self.write({f"content[{span}]" if span else column: content}, [lang.where(("id", "=", found["id"]))], key=key)
        parts = [p for p in path.split("/") if p]
        up = self._folders(parts[:-1])
        return self.write({"id": self.new_id(), "name": parts[-1], "type": "file", "perms": "644", column: content, **({"parent_id": up} if up else {})}, key=key)

    def _folders(self, parts: list[str], **more: str) -> str | None:
        """The id of a folder; it and those above it are made where they are missing."""
        nodes = self._at("/".join(parts)) if parts else None
        if not parts or (found := nodes.select("id").first()) is not None:
            return found["id"] if parts else None
        up = self._folders(parts[:-1])
        made = self.new_id()
        self.write({"id": made, "name": parts[-1], "type": "dir", "perms": "755", **({"parent_id": up} if up else {}), **more})
        return made

    def rm(self, path: str, burn: bool = False) -> bool:
        groups = self._subtree(path)
        return self.remove(groups, burn=burn) if groups else True

    def _subtree(self, path: str) -> list[Group]:
        """The rows at a path and all below them, as groups; none if nothing is there."""
        at = [lang.where(("id", "=", r["id"])) for r in self._at(path).select("id").distinct().collect()]
        return [*at[:1], *map(lang.or_, at[1:]), lang.repeat_follow(("parent_id", "=", "parent.id"))] if at else []

    def mv(self, source: str, target: str) -> int:
        found = self._at(source).select("id").first()
        if found is None:
            return LOCKED
        parts = [p for p in target.split("/") if p]
        up = self._folders(parts[:-1])
        return self.write({"name": parts[-1], "parent_id": up or ""}, [lang.where(("id", "=", found["id"]))])

    def cp(self, source: str, target: str) -> int:
        """Copies a subtree in one pass: every id gets a new one, and parents follow by a join of old ids to new."""
        groups = self._subtree(source)
        if not groups:
            return LOCKED
        nodes = self._nodes(None, [], True)
        tree = graph.saved(pipeline.match(nodes, groups, "_rid", True), "copy")
        tops = [g.clauses[0].value for g in groups if g.kind == "where"]
        parts = [p for p in target.split("/") if p]
        up = self._folders(parts[:-1])
        salt = uuid.uuid4().hex
        new = lambda c: F.conv(F.substring(F.md5(F.concat(F.col(c), F.lit(salt))), 1, 15), 16, 10)
        top = F.col("id").isin(tops)
        copy = tree.withColumn("name", F.when(top, F.lit(parts[-1])).otherwise(F.col("name"))).withColumn("parent_id", F.when(top, F.lit(up)).otherwise(new("parent_id"))).withColumn("id", new("id"))
        self.insert_rows(copy.drop(*SYSTEM, "_path", "_depth", *[f"#{c}" for c in self.blobs]), inside=[c for c in self.blobs if c in copy.columns])
        return OK

    # -- statements ---------------------------------------------------------------------------------------------------

    def query(self, text: str, args: list[str] | None = None) -> tuple[int, DataFrame | None]:
        """(code, rows): for READ and LS the code is the number of rows."""
        words = text.split(None, 1)
        if words and (hook := self.verbs.get(words[0].upper())):
            return hook(self, text)
        s = lang.parse(text, args)
        return self.execute(s)

    def execute(self, s: Statement) -> tuple[int, DataFrame | None]:
        v, w = s.verb, s.words
        if v == "READ":
            df = self.read(s.columns, s.groups, s.limit, s.page, s.tx)
            return df.count(), df
        if v in ("WRITE", "WRITEVOLATILE"):
            return self.write(s.values, s.groups, s.tx, v == "WRITEVOLATILE"), None
        if v in ("RM", "REMOVE", "UNLINK", "BURN"):
            done = self.rm(w[0], v == "BURN") if w else self.remove(s.groups, s.tx, v == "BURN")
            return (OK if done else LOCKED), None
        if v in ("LOCK", "COMMIT"):
            return self.begin(s.groups, v == "LOCK"), None
        if v == "UNLOCK":
            return self.unlock(int(w[0])), None
        if v == "ROLLBACK":
            return (OK if self.rollback(int(w[0])) else LOCKED), None
        if v == "WATCH":
            return self.watch(s.groups), None
        if v == "PULL":
            rows = self.pull(int(w[0]))
            names = sorted({k for r in rows for k in r})
            schema = T.StructType([T.StructField(k, T.StringType()) for k in names])
            return len(rows), self.spark.createDataFrame([tuple(r.get(k) for k in names) for r in rows], schema) if names else None
        if v == "UNWATCH":
            return (OK if self.unwatch(int(w[0])) else LOCKED), None
        if v == "CAT":
            got = self.cat(w[0], *(s.span or (0, 0)))
            return (LOCKED, None) if got is None else (OK, self.spark.createDataFrame([(got,)], "content binary"))
        if v == "TEE":
            span = f"{s.span[0]}:{s.span[1]}" if s.span else None
            return self.tee(w[0], " ".join(w[1:]), span), None
        if v == "LS":
            df = self.ls(w[0] if w else "/")
            return df.count(), df
        if v in ("CP", "MV"):
            return getattr(self, v.lower())(w[0], w[1]), None
        if v in ("VACUUM", "VACCUM"):
            self.compact()
            return OK, None
        if v == "DESTROY":
            self._delete(self.path)
            self.volatile = []
            self._mount()
            return OK, None
        if v in ("FORMAT", "MOUNT", "MEMORY", "FREEZE", "THAW"):
            return OK, None  # block devices are Spark's concern
        return lang.UNKNOWN, None

    def on_read(self, provider: Callable) -> None:
        self.readers.append(provider)

    def on_write(self, sink: Callable) -> None:
        self.writers.append(sink)

    def on_query(self, verb: str, hook: Callable) -> None:
        self.verbs[verb.upper()] = hook


__all__ = ["Clause", "Engine"]
