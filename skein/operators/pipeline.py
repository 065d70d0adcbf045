"""Groups of clauses to a DataFrame: filter, union-all, hops, closures, gates, cosine order, pages, projection."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skein.functions import scalars as S
from skein.operators import graph
from skein.plans.lang import Group
from skein.plans.predicates import View, compile_any, score

IMPLICIT = ("id", "name", "parent_id")


def steps(groups: list[Group]) -> list[tuple[str, list[Group]]]:
    """Runs of groups of one kind that OR connects."""
    out: list[tuple[str, list[Group]]] = []
    for g in groups:
        if g.alternative and out and out[-1][0] == g.kind:
            out[-1][1].append(g)
        else:
            out.append((g.kind, [g]))
    return out


def gate(current: DataFrame, groups: list[Group]) -> bool:
    """READ's ASSERT: there are rows, and every one satisfies some group."""
    ok = F.coalesce(compile_any(groups, View(current)), F.lit(False))
    return bool(current.agg(F.coalesce(F.bool_and(ok), F.lit(False)).alias("ok")).first()["ok"])


def exists(nodes: DataFrame, groups: list[Group]) -> int:
    """WRITE's ASSERT: the number (from 1) of the first group that some row satisfies, or 0. One pass with one result row."""
    if not groups:
        return 0
    hits = nodes.agg(*[F.bool_or(F.coalesce(compile_any([g], View(nodes)), F.lit(False))).alias(f"g{k}") for k, g in enumerate(groups)]).first()
    return next((k + 1 for k in range(len(groups)) if hits[f"g{k}"]), 0)


def match(nodes: DataFrame, groups: list[Group], key: str, hidden: bool = False) -> DataFrame:
    """The rows that the steps select. Without any step: all rows. Consecutive WHEREs append (UNION ALL); a gate that fails empties the result. An ASSERT on paths or on the roots is a gate over rows of its own, which ASSERT FOLLOW and ASSERT REPEATFOLLOW lead on: it holds if any are left."""
    if "_path" in nodes.columns and not hidden and not any(str(c.value).lstrip("/").startswith("perms/") for g in groups for c in g.clauses):
        nodes = nodes.filter(F.col("_path").isNull() | ~((F.col("_path") == "/perms") | F.col("_path").startswith("/perms/")))
    current: DataFrame | None = None
    side: DataFrame | None = None  # rows of an ASSERT on paths
    run = steps(groups)
    for k, (kind, part) in enumerate(run):
        stop = run[k + 1][1] if k + 1 < len(run) and run[k + 1][0] == "until" else None
        if kind == "where":
            found = nodes.filter(compile_any(part, View(nodes)))
            current = found if current is None else current.unionAll(found)
        elif kind == "assert" and any(on_paths(g) for g in part):
            side = nodes.filter(compile_any(part, View(nodes)))
        elif kind == "assert_follow" and side is not None:
            side = graph.follow(side, nodes, part)
        elif kind == "assert_repeat" and side is not None:
            side = graph.closure(side, nodes, part, key, stop)
        elif kind == "assert":
            if current is None or not gate(current, part):
                return nodes.filter(F.lit(False))
        elif kind == "follow":
            current = graph.follow(current if current is not None else nodes, nodes, part)
        elif kind == "repeat":
            current = graph.closure(current if current is not None else nodes, nodes, part, key, stop)
        if side is not None and (k + 1 == len(run) or run[k + 1][0] not in ("assert_follow", "assert_repeat", "until")):
            if side.isEmpty():
                return nodes.filter(F.lit(False))
            side = None
    if current is None and any(kind.startswith("assert") for kind, _ in run):
        return nodes.filter(F.lit(False))
    return nodes if current is None else current


def on_paths(group: Group) -> bool:
    """Whether an ASSERT group looks at rows by path or at the roots, not at the rows found so far."""
    return any(c.op == "path" or c.col == "parent_id" and (c.op == "empty" or c.op == "=" and c.value in ("", None)) for c in group.clauses)


def ordered(found: DataFrame, groups: list[Group], key: str, limit: int = 0, page: int = 0) -> DataFrame:
    """By cosine if that is the very first clause, else by key; then the page (pages count from 1). Sort and limit together are one top-k per partition and a merge."""
    first = groups[0].clauses[0] if groups and groups[0].clauses else None
    if first is not None and first.op == "cos":
        found = found.withColumn("_score", score(first, View(found)))
        order = [F.desc("_score"), F.col(key)]
    else:
        order = [F.col(key)]
    if limit:
        found = found.orderBy(*order)
        if page > 1:
            found = found.offset((page - 1) * limit)
        found = found.limit(limit)
    return found


def project(found: DataFrame, columns: list[str]) -> DataFrame:
    """Columns with suffixes: `c:hash` (BLAKE2b), `c:sha256`, `c:blob`, `c:diff` (the difference a blob is stored as, if it is), `c[a:b]`; id, name and parent_id come along where there are any."""
    if not columns:
        return found.drop("_score") if "_score" in found.columns else found
    out, taken = [], set()
    for c in columns:
        base, _, suffix = c.partition(":") if "[" not in c else (c, "", "")
        span = None
        if "[" in base:
            base, span = base[: base.index("[")], base[base.index("[") + 1 : -1]
            base = base.split(":")[0]
        if base not in found.columns or base in taken:
            continue
        taken.add(base)
        col = F.col(f"`{base}`")
        if suffix == "hash":
            col = S.blake2b(col)
        elif suffix == "sha256":
            col = F.sha2(S.raw(col), 256)
        elif suffix == "diff" and f"_diff_{base}" in found.columns:
            col = F.coalesce(F.col(f"`_diff_{base}`"), S.raw(col))
        elif span is not None:
            a, colon, b = span.partition(":")
            start = int(a or 0)
            col = S.byte_slice(col, start, (int(b or 0) if colon else start + 1))
        out.append(col.alias(base))
    out += [F.col(c) for c in IMPLICIT if c in found.columns and c not in taken]
    return found.select(*out)


def read(nodes: DataFrame, groups: list[Group], columns: list[str] | None = None, key: str = "id", limit: int = 0, page: int = 0) -> DataFrame:
    return project(ordered(match(nodes, groups, key), groups, key, limit, page), columns or [])


def query(nodes: DataFrame, text: str, key: str = "id", args: list[str] | None = None) -> DataFrame:
    """A READ statement over any DataFrame."""
    from skein.plans.lang import parse

    s = parse(text, args)
    if s.verb != "READ":
        raise ValueError(f"{s.verb} changes rows; an Engine does that")
    return read(nodes, s.groups, s.columns, key, s.limit, s.page)
