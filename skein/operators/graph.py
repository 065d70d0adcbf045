"""Graph traversal over rows: one hop (FOLLOW) and transitive closure (REPEATFOLLOW), safe on cycles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skein.functions import scalars as S
from skein.operators.storage import saved
from skein.plans.lang import Group
from skein.plans.predicates import View, compile_any

#: Levels of a tree after which its rows are counted once, to find ids that repeat along a path.
DEEP = 500
_THETA = {"<": "max", "<=": "max", ">": "min", ">=": "min"}


def follow(current: DataFrame, nodes: DataFrame, groups: list[Group]) -> DataFrame:
    """The distinct nodes that satisfy the groups with parent.x taken from some current row: a left-semi join, for which equalities give hash or sort-merge joins. A lone inequality is a comparison with the parents' least or greatest value (two numbers), not a join. Of several groups each is a join of its own, with the rows that no group before has matched."""
    refs = sorted({c.value[7:] for g in groups for c in g.clauses if isinstance(c.value, str) and c.value.startswith("parent.")})
    if not refs:
        return nodes.filter(compile_any(groups, View(nodes))) if not current.isEmpty() else nodes.filter(F.lit(False))
    if len(groups) > 1:
        found, left = None, nodes
        for g in groups:
            part = follow(current, left, [g])
            found = part if found is None else found.unionByName(part)
            left = _unmatched(current, left, g)
        return found
    if len(groups) == 1:
        theta = [c for c in groups[0].clauses if isinstance(c.value, str) and c.value.startswith("parent.")]
        view, above = View(nodes), View(current)
        if len(theta) == 1 and theta[0].op in _THETA and view.numeric(theta[0].col) and above.numeric(theta[0].value[7:]):
            bound = current.agg(getattr(F, _THETA[theta[0].op])(theta[0].value[7:])).first()[0]
            if bound is None:
                return nodes.filter(F.lit(False))
            c, b = view.col(theta[0].col), F.lit(bound)
            test = {"<": c < b, "<=": c <= b, ">": c > b, ">=": c >= b}[theta[0].op]
            rest = [c for c in groups[0].clauses if c is not theta[0]]
            return nodes.filter(test & compile_any([Group("where", rest)], view))
    return _against(current, nodes, groups[0], "left_semi")


def _references(group: Group) -> list[str]:
    return sorted({c.value[7:] for c in group.clauses if isinstance(c.value, str) and c.value.startswith("parent.")})


def _against(current: DataFrame, nodes: DataFrame, group: Group, how: str) -> DataFrame:
    parents = current.select(*[f"`{r}`" for r in _references(group) if r in current.columns]).distinct()
    condition = compile_any([group], View(nodes, "c."), View(parents, "p."))
    return nodes.alias("c").join(parents.alias("p"), condition, how)


def _unmatched(current: DataFrame, nodes: DataFrame, group: Group) -> DataFrame:
    """The nodes that satisfy a group with no current row."""
    if _references(group):
        return _against(current, nodes, group, "left_anti")
    return nodes.filter(~F.coalesce(compile_any([group], View(nodes)), F.lit(False))) if not current.isEmpty() else nodes


def closure(start: DataFrame, nodes: DataFrame, groups: list[Group], key: str, stop: list[Group] | None = None) -> DataFrame:
    """The start rows and all that can be reached from them; rows that satisfy stop are reached but not followed. Breadth first: each hop joins the frontier only, visited keys leave by an anti-join, and every frontier is a written table, so plans don't grow."""
    frontier = saved(start.dropDuplicates([key]), "hop")
    parts = [frontier]
    while True:
        source = frontier.filter(~F.coalesce(compile_any(stop, View(frontier)), F.lit(False))) if stop else frontier
        found = follow(source, nodes, groups)
        for part in parts if len(parts) < 8 else [_all(parts)]:
            found = found.join(part.select(key), key, "left_anti")
        frontier = saved(found.select(*start.columns), "hop")
        if frontier.isEmpty():
            break
        parts.append(frontier)
        if len(parts) >= 32:
            parts = [saved(_all(parts), "reached")]
    return _all(parts)


def _all(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def tree_closure(nodes: DataFrame, start: Column, key: str = "id", parent: str = "parent_id", depth: int = 100) -> DataFrame:
    """Closure along parent links that form a tree of at most so many levels, as one recursive query of any number of rows (deeper trees end in an error; closure() has no limit)."""
    spark = nodes.sparkSession
    spark.conf.set("spark.sql.cteRecursionRowLimit", -1)
    name = f"tree_{abs(hash(nodes.semanticHash()))}"
    nodes.createOrReplaceTempView(name)
    nodes.filter(start).createOrReplaceTempView(f"{name}_start")
    return spark.sql(
        f"WITH RECURSIVE r MAX RECURSION LEVEL {depth} AS (SELECT `{key}` AS k FROM {name}_start UNION ALL SELECT n.`{key}` FROM r JOIN {name} n ON n.`{parent}` = r.k) SELECT n.* FROM {name} n LEFT SEMI JOIN r ON n.`{key}` = r.k"
    )


def with_paths(nodes: DataFrame, key: str = "id", parent: str = "parent_id", name: str = "name", pattern: str | None = None) -> DataFrame:
    """nodes with _path (`/a/b`) and _depth, by walking the levels of the tree from the roots; rows that hang on no root have no path and are left out. With a pattern only the paths that match it, and only rows whose names fit its segments are walked."""
    step = F.coalesce(F.col(name).cast("string"), F.lit(""))
    if pattern is None:
        return _walked(nodes, key, parent, step, [None])
    tests = [None if x == "**" else step.rlike(S.path_regex(x).replace("^/", "^", 1)) | step.contains("/") for x in pattern.strip("'\"").split("/") if x]
    return _walked(nodes, key, parent, step, tests).filter(F.col("_path").rlike(S.path_regex(pattern)))


def at_path(nodes: DataFrame, path: str, key: str = "id", parent: str = "parent_id", name: str = "name") -> DataFrame:
    """The rows at one path, taken literally, with _path: a filter on the name and a join with the rows above for every level, in one plan."""
    parts = [x for x in path.split("/") if x]
    if not parts:
        return nodes.filter(F.lit(False)).withColumn("_path", F.lit(""))
    level = nodes.filter(F.col(parent).isNull() & (F.col(name) == parts[0]))
    for x in parts[1:]:
        above = level.select(F.col(key).alias("_up")).filter("_up is not null")
        level = nodes.filter(F.col(name) == x).join(above, F.col(parent) == F.col("_up"), "left_semi")
    return level.withColumn("_path", F.lit("/" + "/".join(parts)))


def _walked(nodes: DataFrame, key: str, parent: str, step: Column, tests: list[Column | None]) -> DataFrame:
    """Rows by levels, those that fit the level's test; a test of None and all after it are open to any depth. So many levels as there are tests are one plan; of an open depth each level is a written table."""
    level = nodes.filter(F.col(parent).isNull()).withColumn("_path", F.concat(F.lit("/"), step)).withColumn("_depth", F.lit(0))
    parts, total, known = [], None, next((k for k, x in enumerate(tests) if x is None), len(tests))
    while True:
        depth = len(parts)
        if depth < known:
            level = level.filter(tests[depth])
        level = saved(level, "paths") if known < len(tests) else level
        parts.append(level)
        if depth + 1 >= known if known == len(tests) else level.isEmpty():
            return _all(parts)
        if depth == DEEP:
            total = nodes.count()
        if total is not None and depth > total:
            raise ValueError("ids repeat along a path")
        above = level.select(F.col(key).alias("_up"), F.col("_path").alias("_above")).filter("_up is not null")
        level = nodes.join(above, nodes[parent] == F.col("_up")).withColumn("_path", F.concat("_above", F.lit("/"), step)).withColumn("_depth", F.lit(depth + 1)).drop("_up", "_above")


def nested(nodes: DataFrame, key: str = "id", parent: str = "parent_id") -> DataFrame:
    """The children of every node as a list of structs; a node with children only."""
    child = F.struct(*[F.col(c) for c in nodes.columns])
    return nodes.filter(F.col(parent).isNotNull()).groupBy(F.col(parent).alias(key)).agg(F.sort_array(F.collect_list(child)).alias("children"))
