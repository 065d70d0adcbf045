"""Row-level access: rules (action, pattern, owner) say who may do what below which path."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skein.functions.scalars import glob_regex, signature
from skein.operators import graph, pipeline
from skein.operators.storage import saved
from skein.plans.lang import Group


#: Rules without wildcards that are broadcast; the code of a refused change.
EXACT, DENIED = 10_000, -3


def compiled(rules: list[tuple[str, str, str]], spark) -> DataFrame:
    """(action, owner, pattern, prefix, exact): patterns as regular expressions, with the literal part before the first wildcard."""
    rows = []
    for action, pattern, owner in rules:
        path = "/" + pattern.strip("/")
        star = path.find("*")
        regex = "^" + "".join("(?:/.*)?" if p == "**" else "/" + glob_regex(p, "[^/]*", "[^/]") for p in path.strip("/").split("/")) + "$"
        rows.append((action, owner, regex, path if star < 0 else path[:star], star < 0))
    return spark.createDataFrame(rows, "action string, owner string, pattern string, prefix string, exact boolean")


def rule_rows(spark, rules: list[tuple[str, str]]) -> DataFrame:
    """Rows of the tree /perms for rules (`action/path`, owner), for Engine.insert_rows: the folders above them once, with ids that follow from their paths."""
    made: dict[str, tuple] = {}
    for n, (rule, owner) in enumerate(rules):
        parts = ["perms", *[p for p in rule.split("/") if p]]
        place = lambda k: "perm:" + "/".join(parts[:k])  # noqa: B023, E731
        for k in range(1, len(parts)):
            made[place(k)] = (place(k), place(k - 1) if k > 1 else None, parts[k - 1], "dir", None)
        made[f"{place(len(parts))}#{n}"] = (f"{place(len(parts))}#{n}", place(len(parts) - 1), parts[-1], "rule", owner)
    return spark.createDataFrame(list(made.values()), "id string, parent_id string, name string, type string, owner string")


def readable(rows: DataFrame, rules: DataFrame, user: str, path: str = "_path", owner: str | None = None) -> DataFrame:
    """Rows that the user may read: by a rule `read`, or their own by `read_own`. Rules without wildcards are looked up by path, in a broadcast set of at most EXACT rules or else by an equality join; the others (a rule set is written by hand, its size is checked) become one regular expression."""
    if rules.isEmpty():
        return rows  # open until there is a rule
    mine = rules.filter((F.col("owner") == user) & F.col("action").isin("read", "read_own"))
    exact = mine.filter("exact").groupBy(F.col("prefix").alias("_rule")).agg(F.bool_or(F.col("action") == "read").alias("_any"))
    few = exact.limit(EXACT + 1).collect()
    if len(few) <= EXACT:
        exact = F.broadcast(rows.sparkSession.createDataFrame(few, exact.schema))
    wild = mine.filter("not exact").limit(10_001).collect()
    if len(wild) > 10_000:
        raise ValueError("more than 10,000 wildcard rules for one user")
    own = F.col(owner) == user if owner else F.lit(False)
    test = F.lit(False)
    for action, guard in (("read", F.lit(True)), ("read_own", own)):
        patterns = [r["pattern"] for r in wild if r["action"] == action]
        if patterns:
            test = test | (guard & F.col(path).rlike("|".join(f"(?:{p})" for p in patterns)))
    marked = rows.join(exact, rows[path] == F.col("_rule"), "left")
    return marked.filter(test | F.coalesce(F.col("_any") | own, F.lit(False))).drop("_rule", "_any")


def allowed(rules: DataFrame, user: str, action: str, path: str) -> bool:
    """Whether a rule lets the user act on a path."""
    if rules.isEmpty():
        return True
    return not rules.filter((F.col("owner") == user) & (F.col("action") == action) & F.regexp_like(F.lit(path), F.col("pattern"))).isEmpty()


class Session:
    """An engine as one user sees it, by the rules in its own tree: a row at `/perms/<action>/<path>` with owner = user lets the
    user act on that path; names `*` and `**` in it are wildcards. Without any row below /perms all is open.

    Reading takes read/*, or read/me for one's own rows; making a row create on its path; changing rows modify/*, or modify/me
    for one's own; removing them unlink/* or rm/*, or unlink/me or rm/me. One's own are rows with one's name as owner or in
    owning, and those at a path with a rule `owning`. Who makes a row becomes its owner, who changes one its only owner.
    Rows of rules: below /perms/owning, making one takes own/* (own/me for oneself), changing is refused, removing takes
    disown/* (disown/me for oneself); of other rules, making and changing takes create on the rule's path, removing rm/* or
    unlink/*. A signature given as owning must be that of the written columns under the user's key."""

    def __init__(self, engine, user: str, key: bytes | None = None):
        self.engine, self.user, self.key = engine, user, key
        self.kept: tuple | None = None

    def _rules(self) -> DataFrame:
        """(rule, owner) of all rules; read again when the table has changed."""
        state = (self.engine.seq, self.engine.manifest, len(self.engine.parts), len(self.engine.volatile))
        if self.kept is None or self.kept[0] != state:
            nodes = self.engine._nodes(None, None, True, [])
            owner = F.col("owner") if "owner" in nodes.columns else F.lit(None).cast("string").alias("owner")
            rules = saved(nodes.filter(F.col("_path").rlike("^/perms/[^/]+/")).select(F.expr("substring(_path, 7)").alias("rule"), owner), "rules")
            mine, starred = rules.filter(F.col("owner") == self.user).select("rule").distinct(), F.col("rule").rlike(r"^/[^/]+/(?:[^/]*/)*\*{1,2}(?:/|$)")
            wild = mine.filter(starred).limit(10_001).collect()
            if len(wild) > 10_000:
                raise ValueError("more than 10,000 wildcard rules for one user")
            patterns = "|".join("".join("(?:/.*)?" if p == "**" else "/" + glob_regex(p, "[^/]*", "[^/]") for p in r["rule"].strip("/").split("/")) for r in wild)
            self.kept = (state, rules, rules.isEmpty(), patterns, mine.filter(~starred).select(F.col("rule").alias("_rule"), F.lit(True).alias("_there")))
        return self.kept[1]

    def _open(self) -> bool:
        self._rules()
        return self.kept[2]

    def _marked(self, rows: DataFrame, **actions: str) -> DataFrame:
        """rows (_path) with a boolean column for each action: whether a rule of the user grants it there. Rules without wildcards are an equality join, the others, whose number is checked, one regular expression."""
        self._rules()
        _, _, _, patterns, exact = self.kept
        for name, action in actions.items():
            place = F.concat(F.lit(f"/{action}"), F.col("_path"))
            rows = rows.join(exact, place == F.col("_rule"), "left").withColumn(name, F.coalesce("_there", F.lit(False)) | (place.rlike(f"^(?:{patterns})$") if patterns else F.lit(False))).drop("_rule", "_there")
        return rows

    def may(self, action: str, path: str) -> bool:
        one = self.engine.spark.createDataFrame([("/" + path.strip("/"),)], "_path string")
        return bool(self._marked(one, granted=action).first()["granted"])

    def _owned(self, rows: DataFrame) -> DataFrame:
        """rows with _own: whether they are the user's."""
        mark = self._marked(rows, _ruled="owning")
        column = lambda c: F.col(c) if c in rows.columns else F.lit(None).cast("string")
        named = F.when(column("owning").isNotNull(), F.contains(column("owning"), F.lit(self.user))).otherwise(column("owner") == self.user)
        return mark.withColumn("_own", F.coalesce(named, F.lit(False)) | F.col("_ruled")).drop("_ruled")

    def read(self, columns: list[str] | None = None, groups: list[Group] | None = None, limit: int = 0, page: int = 0) -> DataFrame:
        if self._open():
            return self.engine.read(columns, groups, limit, page)
        groups = groups or []
        nodes = self.engine._nodes(None, groups, names=None)
        if "_path" not in nodes.columns:
            paths = self.engine._nodes(None, None, True).select("_rid", "_path")
            nodes = nodes.join(paths, "_rid", "left")
        marked = self._owned(self._marked(nodes, _mine="read/me", _any="read/*"))
        seen = marked.filter(F.col("_any") | F.col("_own") & F.col("_mine")).drop("_mine", "_any", "_own")
        found = pipeline.read(seen, groups, columns, "_rid", limit, page)
        return found.drop(*[c for c in found.columns if c.startswith(("_", "#"))])

    def _signed(self, values: dict) -> bool:
        if not values.get("owning"):
            return True
        if self.key is None:
            return False
        return self.engine.spark.range(1).select(signature({k: F.lit(str(v)) for k, v in values.items() if k != "owning"}, self.key).alias("s")).first()["s"] == values["owning"].split(":")[-1] and values["owning"].split(":")[0] == self.user

    def _target(self, values: dict) -> str:
        up = values.get("parent_id")
        nodes = self.engine._nodes(None, None, True)
        above = nodes.filter(F.col("id") == str(up)).select("_path").first() if up else None
        return f"{above['_path'] if above else ''}/{values.get('name', '')}"

    def _matched(self, groups: list[Group]) -> DataFrame:
        nodes = self.engine._nodes(None, None, True)
        return saved(pipeline.match(nodes, [g for g in groups if not g.kind.startswith("assert")], "_rid", True).dropDuplicates(["_rid"]).filter("_path is not null"), "matched")

    def write(self, values: dict, groups: list[Group] | None = None, **more) -> int:
        """As Engine.write, or DENIED."""
        groups = groups or []
        if not self._signed(values):
            return DENIED
        open_, rest = self._open(), [g for g in groups if not g.kind.startswith("assert")]
        if not rest:
            path = self._target(values)
            if not open_ and not self._may_make(path, values):
                return DENIED
            code = self.engine.write(values, groups, **more)
            if code == 0 and not path.startswith("/perms/") and not open_:
                self._own(path)
            return code
        rows = self._matched(rest)
        if not open_:
            marked = self._owned(self._marked(rows, _mine="modify/me", _any="modify/*", _make="create"))
            rule = F.col("_path").startswith("/perms/")
            fine = F.when(F.col("_path").startswith("/perms/owning/"), F.lit(False)).when(rule, F.col("_make")).otherwise(F.col("_any") | F.col("_own") & F.col("_mine"))
            if not marked.filter(~fine).isEmpty():
                return DENIED
        code = self.engine.write(values, groups, **more)
        if code == 0 and not open_:
            self._own_only(rows.filter(~F.col("_path").startswith("/perms")).select("_path"))
        return code

    def _may_make(self, path: str, values: dict) -> bool:
        if path.startswith("/perms/owning/"):
            target = path[len("/perms/owning") :]
            return self.may("own/*", target) or values.get("owner") == self.user and self.may("own/me", target)
        return self.may("create", path)

    def _own(self, path: str) -> None:
        parts = ["perms", "owning", *[p for p in path.split("/") if p]]
        up = self.engine._folders(parts[:-1])
        self.engine.write({"id": self.engine.new_id(), "name": parts[-1], "parent_id": up, "owner": self.user})

    def _own_only(self, paths: DataFrame) -> None:
        """Others lose the paths, the user gets them: one tombstone part for all, and a row for each path that isn't the user's yet."""
        rules = self._rules()
        places = saved(paths.select(F.concat(F.lit("/owning"), "_path").alias("rule")).distinct(), "paths")
        held = saved(rules.join(places, "rule"), "owners")
        if not held.filter(F.col("owner") != self.user).isEmpty():
            nodes = self.engine._nodes(None, None, True)
            others = nodes.filter(F.col("owner").isNotNull() & (F.col("owner") != self.user)).join(places, F.col("_path") == F.concat(F.lit("/perms"), places["rule"]), "left_semi")
            self.engine.remove_rows(others.select("_rid"))
        for r in places.join(held.filter(F.col("owner") == self.user), "rule", "left_anti").toLocalIterator():
            self._own(r["rule"][len("/owning") :])

    def remove(self, groups: list[Group], burn: bool = False) -> int:
        """0, or DENIED, or -1 if locked."""
        if not self._open():
            rows = self._matched(groups)
            marked = self._owned(self._marked(rows, _mine="unlink/me", _mine2="rm/me", _any="unlink/*", _any2="rm/*"))
            target = marked.withColumn("_kept", F.col("_path")).withColumn("_path", F.regexp_replace("_path", "^/perms/owning", ""))
            marked = self._marked(target, _off="disown/me", _offall="disown/*")
            owner = F.col("owner") if "owner" in rows.columns else F.lit(None).cast("string")
            fine = F.when(F.col("_kept").startswith("/perms/owning/") & owner.isNotNull(), F.when(owner == self.user, F.col("_off") | F.col("_offall")).otherwise(F.col("_offall")))
            fine = fine.otherwise(F.col("_any") | F.col("_any2") | ~F.col("_kept").startswith("/perms/") & F.col("_own") & (F.col("_mine") | F.col("_mine2")))
            if not marked.filter(~fine).isEmpty():
                return DENIED
        return 0 if self.engine.remove(groups, burn=burn) else -1
