"""Column kernels whose meaning has to equal Python's string and URL functions; all but ``unescaped`` stay inside the JVM."""

from __future__ import annotations

import fnmatch
import html
import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

# What Python's str.isspace calls white space, and what str.splitlines ends a line at.
WHITE = r"\t-\r\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
LINE_END = r"\r\n|[\n\r\x0b\x0c\x1c-\x1e\x{85}\x{2028}\x{2029}]"


def col(c: str | Column | None) -> Column:
    """A column by its name; None stands for a null."""
    return F.col(c) if isinstance(c, str) else F.lit(None) if c is None else c


def bind(value: Column, use) -> Column:
    """``use(value)`` with the value computed once per row: Catalyst pastes a named column into each of its uses."""
    return F.transform(F.array(value), use)[0]


def strip(c: str | Column) -> Column:
    """``str.strip()``."""
    return F.regexp_replace(col(c), f"^[{WHITE}]+|[{WHITE}]+\\z", "")


def rstrip(c: str | Column, chars: str = WHITE) -> Column:
    """``str.rstrip()``, of white space or of the given class of characters."""
    return F.regexp_replace(col(c), f"[{chars}]+\\z", "")


def squeeze(c: str | Column) -> Column:
    """``" ".join(s.split())``."""
    return strip(F.regexp_replace(col(c), f"[{WHITE}]+", " "))


def _ranges(chars: list[str]) -> str:
    """The characters as a Java regex class."""
    out: list[list[int]] = []
    for c in sorted(map(ord, chars)):
        if out and out[-1][1] == c - 1:
            out[-1][1] = c
        else:
            out.append([c, c])
    return "[" + "".join(f"\\x{{{a:x}}}-\\x{{{b:x}}}" for a, b in out) + "]"


# Lower-case characters that fold to something else, by the rule of str.casefold: to one character, and to several.
_FOLDED = {c: c.casefold() for c in map(chr, range(0x20000)) if not 0xD800 <= ord(c) < 0xE000 and c.lower() == c != c.casefold()}
_ONE, _MANY = ({c: f for c, f in _FOLDED.items() if (len(f) == 1) == one} for one in (True, False))
_LONG = _ranges(list(_MANY))


def casefold(c: str | Column) -> Column:
    """``str.casefold()``. Only texts with a character that folds to several are taken apart."""
    low = F.translate(F.lower(col(c)), "".join(_ONE), "".join(_ONE.values()))
    table = F.create_map(*[F.lit(y) for pair in _MANY.items() for y in pair])
    return bind(low, lambda x: F.when(x.rlike(_LONG), F.array_join(F.transform(F.split(x, ""), lambda y: F.coalesce(F.try_element_at(table, y), y)), "")).otherwise(x))


def splitlines(c: str | Column) -> Column:
    """``str.splitlines()``: no empty element behind a last line end, none at all for an empty text."""
    parts = F.split(col(c), LINE_END, -1)
    return F.when(F.element_at(parts, -1) == "", F.slice(parts, 1, F.size(parts) - 1)).otherwise(parts)


def byte_length(c: str | Column) -> Column:
    return F.octet_length(col(c)).cast("bigint")


def round3(c: Column) -> Column:
    """Round to three digits, half to even, as Python's ``round(x, 3)`` does on these ratios."""
    return F.bround(c, 3)


def glob_regex(pattern: str) -> str:
    """A case-sensitive shell pattern as a Java regex over the whole value; ``*`` crosses slashes."""
    body = fnmatch.translate(pattern)
    return "^" + re.sub(r"\(\?>(.*?)\)", r"(?:\1)", body.replace(r"\Z", r"\z"))


def path_regex(pattern: str) -> str:
    """A right-anchored path pattern as a Java regex: ``*`` and ``**`` stay inside one segment."""
    segments = []
    for seg in pattern.strip("/").split("/"):
        inner = fnmatch.translate(re.sub(r"\*+", "*", seg))
        inner = re.sub(r"^\(\?s:|\)\\[zZ]$", "", inner)
        segments.append(re.sub(r"\(\?>(.*?)\)", r"(?:\1)", inner).replace(".*", "[^/]*"))
    return ("^/" if pattern.startswith("/") else "(?:^|/)") + "/".join(segments) + r"\z"


def any_match(columns: list[str | Column], patterns: list[str]) -> Column:
    """Does any shell pattern match any of the columns? Null columns match nothing; no patterns, no match."""
    hit = F.lit(False)
    for p in patterns:
        for c in columns:
            hit = hit | F.coalesce(col(c).rlike(glob_regex(p)), F.lit(False))
    return hit


def sha256(c: str | Column) -> Column:
    """SHA-256 of the UTF-8 bytes, in hex."""
    return F.sha2(F.encode(col(c), "UTF-8"), 256)


def quote(c: str | Column) -> Column:
    """Percent-encoding of everything but letters, digits and ``_.-~``."""
    return F.replace(F.replace(F.replace(F.url_encode(col(c)), F.lit("+"), F.lit("%20")), F.lit("*"), F.lit("%2A")), F.lit("%7E"), F.lit("~"))


def url_part(c: str | Column, part: str) -> Column:
    """A part of a URL, '' if it has none: ``scheme``, ``netloc``, ``path``, ``query`` or ``fragment``."""
    group = {"scheme": 2, "netloc": 4, "path": 5, "query": 7, "fragment": 9}[part]
    out = F.regexp_extract(col(c), r"^(([A-Za-z][A-Za-z0-9+.-]*):)?(//([^/?#]*))?([^?#]*)(\?([^#]*))?(#(.*))?", group)
    return F.lower(out) if part == "scheme" else out


def join_url(base: str | Column, ref: str | Column) -> Column:
    """What ``ref`` means on the page ``base`` (both http or https): absolute, from the host, from the folder, a query or a fragment."""
    b, r = col(base), col(ref)
    root = F.regexp_extract(b, r"^[^:]+://[^/?#]*", 0)
    path = F.when(url_part(b, "path") == "", "/").otherwise(url_part(b, "path"))
    mine = url_part(r, "path")
    full = F.when(mine.startswith("/"), mine).otherwise(F.concat(F.regexp_replace(path, r"[^/]*\z", ""), mine))
    # Dot segments are folded up; one at the end leaves a slash.
    last = F.element_at(F.split(full, "/", -1), -1)
    kept = F.aggregate(F.split(full, "/", -1), F.array().cast("array<string>"), lambda a, x: F.when(x == "..", F.slice(a, 1, F.greatest(F.size(a) - 1, F.lit(1)))).when(x == ".", a).otherwise(F.concat(a, F.array(x))))
    clean = F.when(full.rlike(r"(^|/)\.\.?(/|\z)"), F.concat(F.array_join(kept, "/"), F.when(last.isin(".", ".."), F.lit("/")).otherwise(""))).otherwise(full)
    tail = F.concat(F.when(r.contains("?"), F.concat(F.lit("?"), url_part(r, "query"))).otherwise(""), F.regexp_extract(r, r"#.*\z", 0))
    own = F.regexp_extract(b, r"^[^?#]*", 0)
    return (F.when(r == "", b).when(r.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*:"), r).when(r.startswith("//"), F.concat(url_part(b, "scheme"), F.lit(":"), r)).when(r.startswith("#"), F.concat(F.regexp_extract(b, r"^[^#]*", 0), r))
            .when(r.startswith("?"), F.concat(own, r)).otherwise(F.concat(root, clean, tail)))


@F.pandas_udf(StringType())
def unescaped(texts: pd.Series) -> pd.Series:
    """Character references of HTML as the characters they stand for."""
    return texts.map(lambda t: html.unescape(t) if isinstance(t, str) and "&" in t else t)
