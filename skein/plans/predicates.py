"""Clauses to Column expressions that can be pushed to the scan. Absent and empty are the same and stored as NULL."""

from __future__ import annotations

import json
import re
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from skein.functions import scalars as S
from skein.plans.lang import Clause, Group

NUMERIC = ("tinyint", "smallint", "int", "bigint", "float", "double", "decimal")
#: User operators: name -> function of (column, value) giving a boolean Column.
OPERATORS: dict[str, Callable] = {}


def valid_regex(pattern: str) -> bool:
    """Whether Java, which matches, takes the pattern."""
    from py4j.protocol import Py4JJavaError
    from pyspark.errors import PySparkException

    try:
        SparkSession.active()._jvm.java.util.regex.Pattern.compile(pattern)
    except (Py4JJavaError, PySparkException):
        return False
    return True


class View:
    """How clauses see a DataFrame: a column by name (null if there is none) and its type."""

    def __init__(self, df: DataFrame, prefix: str = "", map_col: str | None = None):
        self.types, self.prefix, self.map_col = dict(df.dtypes), prefix, map_col

    def col(self, name: str) -> Column:
        if name in self.types:
            return F.col(f"{self.prefix}`{name}`")
        if self.map_col:
            return F.col(f"{self.prefix}`{self.map_col}`")[name]
        return F.lit(None).cast("string")

    def type(self, name: str) -> str:
        return self.types.get(name, "string")

    def numeric(self, name: str) -> bool:
        return self.type(name).startswith(NUMERIC)


def vector_literal(value) -> list[float]:
    return [float(x) for x in (json.loads(value) if isinstance(value, str) else value)]


def score(clause: Clause, view: View) -> Column:
    return S.cosine(view.col(clause.col), F.lit(vector_literal(clause.value)).cast("array<double>"))


def compile_clause(clause: Clause, view: View, parent: View | None = None) -> Column:
    op, c, v = clause.op, view.col(clause.col), clause.value
    if op in OPERATORS:
        return OPERATORS[op](c, v)
    if op == "empty":
        return c.isNull()
    if op == "cos":
        return score(clause, view) >= 0
    numeric = view.numeric(clause.col)
    text = c if view.type(clause.col) == "string" else c.cast("string")
    if parent is not None and isinstance(v, str) and v.startswith("parent."):
        name = v[len("parent.") :]
        p = parent.col(name)
        both = numeric and parent.numeric(name)
        ptext = p if parent.type(name) == "string" else p.cast("string")
        if op == "=":
            return c == p if both else text == ptext
        if op == "!=":
            return p.isNotNull() & (c.isNull() | (c != p if both else text != ptext))
        if op in ("==", "<", ">", "<=", ">="):
            return _compare(op, c if numeric else S.num(text), p if parent.numeric(name) else S.num(ptext))
        if op == "has":
            return F.contains(text, ptext)
        if op == "!has":
            return p.isNotNull() & (c.isNull() | ~F.contains(text, ptext))
        if op == "reg":
            return F.regexp_like(F.coalesce(text, F.lit("")), ptext)
        raise ValueError(f"{op} with a parent's column")
    v = "" if v is None else v if isinstance(v, str) else str(v)
    if op == "=":
        if v == "":
            return c.isNull()
        if numeric:
            return c == F.lit(float(v) if "." in v or "e" in v.lower() else int(v)) if re.fullmatch(r"[+-]?\d+(\.\d+)?([eE][+-]?\d+)?", v) else F.lit(False)
        return text == F.lit(v)
    if op == "!=":
        return c.isNotNull() if v == "" else c.isNull() | ~compile_clause(Clause(clause.col, "=", v), view)
    if op in ("==", "<", ">", "<=", ">="):
        n = S.number_of(v)
        if n is None:
            return F.lit(False)
        made = _compare(op, c if numeric else S.num(text), F.lit(int(n) if n.is_integer() and abs(n) < 2**53 else n))
        return made & ~F.isnan(c) if view.type(clause.col) in ("float", "double") else made
    if op == "has":
        return F.lit(True) if v == "" else F.contains(text, F.lit(v))
    if op == "!has":
        return F.lit(False) if v == "" else c.isNull() | ~F.contains(text, F.lit(v))
    if op == "reg":
        return F.coalesce(text, F.lit("")).rlike(v) if valid_regex(v) else F.lit(False)
    if op == "hash":
        return S.blake2b(text) == v.lower() if len(v) == 32 else F.sha2(S.raw(c), 256) == v.lower()
    if op == "path":
        prefix = S.literal_prefix(v)
        path = view.col("_path")
        match = path.rlike(S.path_regex(v))
        return path.startswith(prefix) & match if prefix else match
    raise ValueError(f"no operator {op}")


def _compare(op: str, a: Column, b: Column) -> Column:
    made = {"==": a == b, "<": a < b, ">": a > b, "<=": a <= b, ">=": a >= b}[op]
    return made


def compile_group(group: Group, view: View, parent: View | None = None) -> Column:
    return reduce(lambda x, y: x & y, [compile_clause(c, view, parent) for c in group.clauses], F.lit(True)) if group.clauses else F.lit(True)


def compile_any(groups: list[Group], view: View, parent: View | None = None) -> Column:
    return reduce(lambda x, y: x | y, [compile_group(g, view, parent) for g in groups])


def register(name: str, made: Callable) -> None:
    """A user operator: made(column, value) -> boolean Column, or a UDF used so."""
    from skein.plans import lang

    OPERATORS[name] = made
    if name not in lang.WORD_OPS:
        lang.WORD_OPS = (*lang.WORD_OPS, name)
