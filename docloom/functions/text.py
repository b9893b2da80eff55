"""Small string expressions shared by the operators."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DataType

# The characters that count as white space when names and contexts are trimmed.
SPACE_CHARS = (
    "\t\n\x0b\x0c\r \u00a0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007"
    "\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000\ufeff"
)
SPACE_CLASS = r"[\t\n\x0B\f\r \u00a0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000\ufeff]"


def bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of a value that is computed once, also where ``use`` looks at it from within a lambda."""
    return F.element_at(F.transform(F.array(value), use), 1)


def strip(c: Column) -> Column:
    """Trim white space of every kind on both sides."""
    return F.btrim(c, F.lit(SPACE_CHARS))


def is_blank(c: Column) -> Column:
    return c.isNull() | (F.length(strip(c)) == 0)


def lines_of(c: Column) -> Column:
    return F.split(c, "\n", -1)


def moment(value: object, kind: DataType) -> Column:
    """A constant time of the given type; its wall-clock text is taken as it stands in every zone."""
    return F.lit(str(value)).cast(kind)


def basename(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def extension(path: Column) -> Column:
    """Lower-case suffix without its dot; a leading dot alone makes no suffix."""
    return F.lower(F.regexp_extract(basename(path), r"^.+\.([^.]*)$", 1))


def last_suffix(path: Column) -> Column:
    """What follows the last dot of the path, the whole path if there is none."""
    return F.substring_index(path, ".", -1)


def contains_any(c: Column, words: tuple[str, ...] | list[str]) -> Column:
    hit = F.lit(False)
    for word in words:
        hit = hit | c.contains(word)
    return hit


def contains_folded(c: Column, needle: str | Column) -> Column:
    """Substring test that ignores case, as LIKE does."""
    needle = F.lit(needle) if isinstance(needle, str) else needle
    return F.contains(F.lower(c), F.lower(needle))


def find_all(c: Column, pattern: str, group: int = 0) -> Column:
    return F.regexp_extract_all(c, F.lit(pattern), F.lit(group))


def first_line(c: Column) -> Column:
    return F.substring_index(c, "\n", 1)


def quoted_regex(text: str) -> str:
    """A pattern that matches ``text`` literally."""
    return "\\Q" + text.replace("\\E", "\\E\\\\E\\Q") + "\\E"


def md5_hash(c: Column) -> Column:
    return F.md5(c.cast("binary"))


def token_estimate(c: Column) -> Column:
    """Tokens estimated as a quarter of the bytes, whole number."""
    return F.floor(F.octet_length(c) / 4).cast("long")
