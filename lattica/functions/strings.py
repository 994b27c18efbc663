"""String functions; positions are counted from 0, and -1 means absent."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F


def _set(chars: str) -> str:
    return "[" + re.sub(r"([\\\]\[\^\-&~|])", r"\\\1", chars) + "]"


def strlen(s: Column) -> Column:
    return F.length(s)


def lower(s: Column) -> Column:
    return F.lower(s)


def upper(s: Column) -> Column:
    return F.upper(s)


def strpos(s: Column, sub: str, start: int = 0) -> Column:
    """Index of the first `sub` at or after `start`, or -1."""
    return F.when(F.lit(start) > F.length(s), -1).otherwise(F.locate(sub, s, start + 1) - 1)


def strcount(s: Column, sub: str) -> Column:
    """How often `sub` occurs, without overlap."""
    return ((F.length(s) - F.length(F.replace(s, F.lit(sub), F.lit("")))) / max(1, len(sub))).cast("int")


def strsub(s: Column, start: int, count: int) -> Column:
    return F.substring(s, start + 1, count)


def strloc(s: Column, sub: str) -> Column:
    """The rest of s from `sub` on; empty if absent."""
    at = F.locate(sub, s)
    return F.when(at > 0, F.substring(s, at, F.length(s))).otherwise("")


def strskp(s: Column, sub: str) -> Column:
    """The rest of s after `sub`; empty if absent."""
    at = F.locate(sub, s)
    return F.when(at > 0, F.substring(s, at + len(sub), F.length(s))).otherwise("")


def strpbrk(s: Column, chars: str) -> Column:
    """The rest of s from its first character of a set; empty if there is none."""
    return F.regexp_extract(s, f"(?s){_set(chars)}.*", 0)


def skipc(s: Column, chars: str) -> Column:
    """s without its leading characters of a set."""
    return F.regexp_replace(s, f"^{_set(chars)}+", "")


def strtrim(s: Column) -> Column:
    """s without trailing blanks and control characters."""
    return F.regexp_replace(s, r"[\x00-\x20]+$", "")


def strreplace(s: Column, old: str, new: str, times: int = 0) -> Column:
    """`old` replaced by `new`, the first `times` of them (0: all)."""
    if not times:
        return F.replace(s, F.lit(old), F.lit(new))
    parts = F.split(s, re.escape(old), times + 1)
    return F.array_join(parts, new)


def strtok(s: Column, delimiters: str) -> Column:
    """The tokens between runs of delimiters."""
    return F.filter(F.split(s, f"{_set(delimiters)}+"), lambda x: x != "")


def regex(s: Column, pattern: str, case: bool = True) -> Column:
    """All parts of the first match (the whole first), null if there is none."""
    p = pattern if case else f"(?i){pattern}"
    groups = re.compile(pattern).groups
    return F.when(s.rlike(p), F.array(*(F.regexp_extract(s, p, k) for k in range(groups + 1))))


def strtol(s: Column, base: int = 10) -> Column:
    """Leading whole number of s in a base; 0 if there is none."""
    digits = "0123456789abcdefghijklmnopqrstuvwxyz"[:base]
    found = F.regexp_extract(F.lower(s), f"^\\s*([+-]?)([{digits}]+)", 2)
    value = F.conv(found, base, 10).cast("bigint")
    return F.when(found == "", 0).otherwise(F.when(F.regexp_extract(s, r"^\s*(-)", 1) == "-", -value).otherwise(value))


def istring(v: Column, width: int = 0, zeros: bool = False) -> Column:
    """A whole number as text of at least `width` characters."""
    text = v.cast("bigint").cast("string")
    return F.when(F.length(text) >= width, text).otherwise(F.lpad(text, width, "0" if zeros else " "))


def fstring(form: str, *values: Column) -> Column:
    """C-format string."""
    return F.format_string(form, *values)


def smap(v: Column) -> Column:
    return v.cast("string")


def sscanf(s: Column, form: str) -> Column:
    """Values of a string read by a format of %d, %f and %s parts, as a struct v0, v1, ...; null where it does not fit."""
    kinds = re.findall(r"%[dfs]", form)
    pattern = "".join({"%d": r"\s*([+-]?\d+)", "%f": r"\s*([+-]?\d*\.?\d+(?:[eE][+-]?\d+)?)", "%s": r"\s*(\S+)"}.get(p) or re.sub(r"\s+", r"\\s*", re.escape(p).replace("\\ ", " ")) for p in re.split(r"(%[dfs])", form) if p)
    cast = {"%d": "bigint", "%f": "double", "%s": "string"}
    return F.struct(*(F.when(s.rlike("^" + pattern), F.regexp_extract(s, "^" + pattern, i + 1)).try_cast(cast[k]).alias(f"v{i}") for i, k in enumerate(kinds)))
