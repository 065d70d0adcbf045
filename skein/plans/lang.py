"""The clause language: text to statements.

    READ cols  WHERE|MATCH group (OR group)*  (FOLLOW|REPEATFOLLOW group [UNTIL group])*
         (ASSERT [FOLLOW|REPEATFOLLOW] group)*  LIMIT n PAGE p
    WRITE|WRITEVOLATILE col=value ...  the same clauses;  RM|REMOVE|BURN ...;  LOCK|COMMIT|UNLOCK|ROLLBACK;
    WATCH|PULL|UNWATCH;  CAT[a:b] path, TEE path content, LS, RM, CP, MV, UNLINK path;  AS tx
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

WORD_OPS = ("has", "!has", "empty", "reg", "hash", "cos", "path")
SYMBOL_OPS = ("==", "!=", "<=", ">=", "=", "<", ">")
STEP = {"WHERE": "where", "MATCH": "where", "ASSERT": "assert", "FOLLOW": "follow", "REPEATFOLLOW": "repeat", "UNTIL": "until"}
VERBS = """READ WRITE WRITEVOLATILE RM REMOVE UNLINK BURN LOCK COMMIT UNLOCK ROLLBACK WATCH PULL UNWATCH CAT TEE LS CP MV FORMAT MOUNT DESTROY MEMORY VACUUM VACCUM FREEZE THAW""".split()
UNKNOWN = -99


class SyntaxProblem(ValueError):
    pass


@dataclass
class Clause:
    col: str
    op: str
    value: object = ""


@dataclass
class Group:
    kind: str  # where, assert, assert_follow, assert_repeat, follow, repeat, until
    clauses: list[Clause]
    alternative: bool = False  # joined to the group before by OR


@dataclass
class Statement:
    verb: str
    columns: list[str] = field(default_factory=list)
    values: dict[str, object] = field(default_factory=dict)
    groups: list[Group] = field(default_factory=list)
    words: list[str] = field(default_factory=list)
    limit: int = 0
    page: int = 0
    tx: int | None = None
    span: tuple[int, int] | None = None


@dataclass
class Token:
    text: str
    quoted: bool = False


def tokenize(text: str, args: list[str] | None = None) -> list[Token]:
    """White space separates; quotes keep it; a backslash escapes inside and outside; # and // begin comments; %1 to %9 are arguments."""
    out: list[Token] = []
    pattern = re.compile(r"\s+|(?:#|//)[^\n]*|(['\"])((?:\\.|(?!\1).)*)\1|%([1-9])(?!\w)|((?:\\.|[^\s'\"\\]|\\$)+(?:(['\"])((?:\\.|(?!\5).)*)\5)?)", re.S)
    at = 0
    while at < len(text):
        m = pattern.match(text, at)
        if not m:
            raise SyntaxProblem(f"open quote at {at}")
        at = m.end()
        unescape = lambda s: re.sub(r"\\(['\"\\ ])", r"\1", s)
        if m[1]:
            out.append(Token(unescape(m[2]), True))
        elif m[3]:
            if int(m[3]) > len(args or []):
                raise SyntaxProblem(f"no argument %{m[3]}")
            out.append(Token(str(args[int(m[3]) - 1]), True))
        elif m[4]:
            word = m[4] if m[5] is None else m[4][: -len(m[6]) - 2] + m[6]
            word = re.sub(r"%([1-9])(?!\w)", lambda a: str(args[int(a[1]) - 1]) if args and int(a[1]) <= len(args) else a[0], word)
            word = unescape(word)
            word = word if "=" in word else word.rstrip(",")
            if word:
                out.append(Token(word))
    return out


def split_clause(word: str) -> Clause | None:
    """`col<op>value`: the leftmost operator, the longest there."""
    m = re.match(r"([^=!<>]+)(==|!=|<=|>=|=|<|>)(.*)$", word, re.S)
    return Clause(m[1], m[2], m[3]) if m else None


def parse_groups(tokens: list[Token], at: int = 0) -> tuple[list[Group], int]:
    groups: list[Group] = []
    current: Group | None = None
    while at < len(tokens):
        t = tokens[at]
        word = "" if t.quoted else t.text.upper()
        if word in ("LIMIT", "PAGE", "AS", "SET"):
            break
        if word in STEP:
            current = Group(STEP[word], [])
            groups.append(current)
            at += 1
            after = tokens[at].text.upper() if at < len(tokens) and not tokens[at].quoted else ""
            if word in ("FOLLOW", "REPEATFOLLOW") and after == "WHERE":
                at += 1
            elif word == "ASSERT" and after in ("FOLLOW", "REPEATFOLLOW"):
                current.kind = {"FOLLOW": "assert_follow", "REPEATFOLLOW": "assert_repeat"}[after]
                at += 1
            continue
        if word == "OR":
            at += 1
            if current is None:
                raise SyntaxProblem("OR without a group")
            if at < len(tokens) and not tokens[at].quoted and tokens[at].text.upper() in STEP:
                at += 1
            current = Group(current.kind, [], True)
            groups.append(current)
            continue
        if word == "AND":
            at += 1
            continue
        if current is None:
            current = Group("where", [])
            groups.append(current)
        after = tokens[at + 1] if at + 1 < len(tokens) else None
        if after and not after.quoted and after.text.lower() == "empty":
            current.clauses.append(Clause(t.text, "empty"))
            at += 2
        elif after and not after.quoted and (after.text in SYMBOL_OPS or after.text.lower() in WORD_OPS):
            if at + 2 >= len(tokens):
                raise SyntaxProblem(f"{t.text} {after.text} needs a value")
            current.clauses.append(Clause(t.text, after.text.lower(), tokens[at + 2].text))
            at += 3
        elif not t.quoted and (clause := split_clause(t.text)):
            if clause.value == "" and after and after.quoted:
                clause.value = after.text
                at += 1
            current.clauses.append(clause)
            at += 1
        else:
            raise SyntaxProblem(f"no clause: {t.text}")
    return groups, at


def parse(text: str, args: list[str] | None = None) -> Statement:
    tokens = tokenize(text, args)
    if not tokens:
        raise SyntaxProblem("empty")
    m = re.fullmatch(r"([A-Za-z]+)(\*)?(?:\[(\d*)(:?)(\d*)\])?", tokens[0].text)
    verb = m[1].upper() if m else tokens[0].text.upper()
    s = Statement(verb)
    if verb not in VERBS:
        return s
    if m[3] or m[4] or m[5]:
        start = int(m[3] or 0)
        s.span = (start, int(m[5] or 0) if m[4] else start + 1)
    at = 1
    if verb in ("READ", "WRITE", "WRITEVOLATILE"):
        while at < len(tokens) and (tokens[at].quoted or tokens[at].text.upper() not in (*STEP, "LIMIT", "PAGE", "AS", "SET")):
            t = tokens[at].text
            if verb == "READ":
                s.columns.append(t)
            elif clause := split_clause(t):
                if clause.value == "" and at + 1 < len(tokens) and tokens[at + 1].quoted:
                    at += 1
                    clause.value = tokens[at].text
                s.values[clause.col] = clause.value
            else:
                s.values[t] = None
            at += 1
        if s.columns == ["*"] or m[2]:
            s.columns = []
    elif verb in ("CAT", "TEE", "LS", "CP", "MV", "UNLINK", "PULL", "UNLOCK", "ROLLBACK", "UNWATCH", "MEMORY") or verb in ("RM", "BURN") and at < len(tokens) and tokens[at].text.startswith("/"):
        s.words = [t.text for t in tokens[at:]]
        if s.words and (span := re.search(r"\[(\d*)(:?)(\d*)\]$", s.words[0])) and verb == "CAT":
            start = int(span[1] or 0)
            s.span, s.words[0] = (start, int(span[3] or 0) if span[2] else start + 1), s.words[0][: span.start()]
        return s
    s.groups, at = parse_groups(tokens, at)
    while at < len(tokens):
        word = tokens[at].text.upper()
        if word == "SET":
            at += 1
            while at < len(tokens) and (clause := split_clause(tokens[at].text)):
                s.values[clause.col] = clause.value
                at += 1
            continue
        if at + 1 >= len(tokens):
            raise SyntaxProblem(f"{word} needs a number")
        n = int(tokens[at + 1].text, 0)
        if word == "LIMIT":
            s.limit = n
        elif word == "PAGE":
            s.page = n
        elif word == "AS":
            s.tx = n
        else:
            raise SyntaxProblem(f"unexpected {word}")
        at += 2
    return s


# -- the same from Python ---------------------------------------------------------------------------------------------


def where(*clauses: tuple) -> Group:
    return Group("where", [Clause(*c) for c in clauses])


def follow(*clauses: tuple) -> Group:
    return Group("follow", [Clause(*c) for c in clauses])


def repeat_follow(*clauses: tuple) -> Group:
    return Group("repeat", [Clause(*c) for c in clauses])


def until(*clauses: tuple) -> Group:
    return Group("until", [Clause(*c) for c in clauses])


def assert_(*clauses: tuple) -> Group:
    return Group("assert", [Clause(*c) for c in clauses])


def assert_follow(*clauses: tuple) -> Group:
    return Group("assert_follow", [Clause(*c) for c in clauses])


def assert_repeat(*clauses: tuple) -> Group:
    return Group("assert_repeat", [Clause(*c) for c in clauses])


def or_(group: Group) -> Group:
    return Group(group.kind, group.clauses, True)
