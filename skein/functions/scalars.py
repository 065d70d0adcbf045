"""Scalar functions of the clause language as Column expressions (and Arrow UDFs where Spark has no such function)."""

from __future__ import annotations

import hashlib
import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: The numeric prefix of a text, as strtod reads it (without hexadecimal, infinity and not-a-number).
NUMBER = r"^\s*([+-]?(?:\d+\.?\d*|\.\d+)(?:[eE][+-]?\d+)?)"


def num(c: Column) -> Column:
    """The number a text begins with, or null."""
    return F.regexp_extract(c.cast("string"), NUMBER, 1).try_cast("double")


def number_of(text: str) -> float | None:
    m = re.match(NUMBER, text)
    return float(m[1]) if m else None


@F.pandas_udf(T.StringType())
def blake2b(values: pd.Series) -> pd.Series:
    """Hex BLAKE2b-128 of texts or bytes; null and empty give null."""
    return values.map(lambda v: hashlib.blake2b(v if isinstance(v, bytes) else str(v).encode(), digest_size=16).hexdigest() if v is not None and len(v) else None)


def blake2b_of(value: str | bytes) -> str:
    return hashlib.blake2b(value if isinstance(value, bytes) else value.encode(), digest_size=16).hexdigest()


def cosine(a: Column, b: Column) -> Column:
    """Cosine in double precision; -1 if the sizes differ or either is null, 0 if either is all zeros."""
    add = lambda s, x: s + x
    wide = lambda v: F.transform(v, lambda x: x.cast("double"))
    dot = F.aggregate(F.zip_with(wide(a), wide(b), lambda x, y: x * y), F.lit(0.0), add)
    norm = lambda v: F.sqrt(F.aggregate(F.transform(wide(v), lambda x: x * x), F.lit(0.0), add))
    whole = norm(a) * norm(b)
    return F.when(F.coalesce(F.size(a) == F.size(b), F.lit(False)), F.when(whole == 0, F.lit(0.0)).otherwise(dot / whole)).otherwise(F.lit(-1.0))


def raw(c: Column) -> Column:
    """The bytes of a text column; binary columns as they are."""
    return c.cast("binary")


def byte_slice(c: Column, start: int | None, end: int | None) -> Column:
    """Bytes [start:end) ; an end of 0 or none is open, a start beyond the end gives no bytes."""
    start = start or 0
    size = F.octet_length(raw(c))
    stop = F.least(size, F.lit(end)) if end else size
    return F.when(F.lit(start) >= size, F.lit(b"")).otherwise(F.substring(raw(c), F.lit(start + 1), F.greatest(stop - start, F.lit(0))))


def append(c: Column, v: Column) -> Column:
    return F.concat(F.coalesce(raw(c), F.lit(b"")), raw(v))


def _zeros(n: Column) -> Column:
    return F.when(n > 0, F.unhex(F.repeat(F.lit("00"), n))).otherwise(F.lit(b""))


def insert_at(c: Column, v: Column, at: int) -> Column:
    """Bytes put in at a place, what follows moving on; a gap before it is filled with zero bytes."""
    old = F.coalesce(raw(c), F.lit(b""))
    return F.concat(F.substring(old, 1, at), _zeros(F.lit(at) - F.octet_length(old)), raw(v), F.substring(old, at + 1, 2**31 - 1 - at))


def overwrite_at(c: Column, v: Column, at: int) -> Column:
    """Bytes written over those at a place; the old ones beyond stay, a gap before it is filled with zero bytes."""
    old = F.coalesce(raw(c), F.lit(b""))
    rest = F.lit(at) + F.octet_length(raw(v))
    return F.concat(F.substring(old, 1, at), _zeros(F.lit(at) - F.octet_length(old)), raw(v), F.substring(old, rest + 1, F.greatest(F.octet_length(old) - rest, F.lit(0))))


def encrypt(c: Column, key: bytes) -> Column:
    return F.aes_encrypt(raw(c), F.lit(key))


def decrypt(c: Column, keys: list[bytes]) -> Column:
    """Decrypted by the first key that fits, or null."""
    return F.coalesce(*[F.try_aes_decrypt(c, F.lit(k)) for k in keys], F.lit(None).cast("binary"))


def signature(columns: dict[str, Column], key: bytes) -> Column:
    """Keyed digest over `column=value;` in order of the column names: HMAC-SHA-256, inner and outer pads as in RFC 2104."""
    block = key.ljust(64, b"\0") if len(key) <= 64 else hashlib.sha256(key).digest().ljust(64, b"\0")
    text = F.concat(*[F.concat(F.lit(f"{k}="), F.coalesce(columns[k].cast("string"), F.lit("")), F.lit(";")) for k in sorted(columns)])
    inner = F.sha2(F.concat(F.lit(bytes(b ^ 0x36 for b in block)), raw(text)), 256)
    return F.sha2(F.concat(F.lit(bytes(b ^ 0x5C for b in block)), F.unhex(inner)), 256)


# -- patterns ---------------------------------------------------------------------------------------------------------


def is_regex(segment: str) -> bool:
    """Whether a path segment is meant as a regular expression rather than a glob."""
    bare = re.sub(r"\\[*?]", "", segment)
    return bool(re.search(r"[\[(^$|+]|\\[dwsbDWSB]|\.[*+]", bare))


def glob_regex(glob: str, star: str = ".*", any_one: str = ".") -> str:
    """Regular expression of a glob of one segment; `\\*` and `\\?` are literal."""
    out = []
    for m in re.finditer(r"\\([*?\\])|(\*+)|(\?)|(.)", glob, re.S):
        out.append(re.escape(m[1]) if m[1] else star if m[2] else any_one if m[3] else re.escape(m[4]))
    return "".join(out)


def path_regex(pattern: str) -> str:
    """Anchored regular expression over whole paths `/a/b`; `**` as a segment is the node itself and all below it."""
    parts = [p for p in pattern.strip("'\"").split("/") if p]
    out = ""
    for p in parts:
        if p == "**":
            out += "(?:/.*)?" if out else "/.*"
        elif is_regex(p):
            out += "/(?:" + p.replace(".*", "[^/]*").replace(".+", "[^/]+") + ")"
        else:
            out += "/" + glob_regex(p, "[^/]*", "[^/]")
    return f"^{out}$" if out else "^/$"


def literal_prefix(pattern: str) -> str:
    """The leading part of a path pattern that is literal, for a startswith that can be pushed to the scan."""
    out = ""
    for p in [p for p in pattern.strip("'\"").split("/") if p]:
        if re.search(r"[*?\\]", p) or is_regex(p):
            break
        out += "/" + p
    return out
