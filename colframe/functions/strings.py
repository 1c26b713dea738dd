"""String functions; NULL stays NULL unless said otherwise."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from colframe.functions.math import col


def java(pattern: str) -> str:
    """A pattern with named groups written the Java way."""
    return re.sub(r"\(\?P<(\w+)>", r"(?<\1>", pattern)


def quoted(text: str) -> str:
    return "\\Q" + text.replace("\\E", "\\E\\\\E\\Q") + "\\E" if text else ""


def lower(c):
    return F.lower(col(c))


def upper(c):
    return F.upper(col(c))


def strip(c, characters: str | None = None) -> Column:
    return F.btrim(col(c), F.lit(characters)) if characters else F.regexp_replace(col(c), r"^\s+|\s+$", "")


def lstrip(c, characters: str | None = None) -> Column:
    return F.ltrim(col(c), F.lit(characters)) if characters else F.regexp_replace(col(c), r"^\s+", "")


def rstrip(c, characters: str | None = None) -> Column:
    return F.rtrim(col(c), F.lit(characters)) if characters else F.regexp_replace(col(c), r"\s+$", "")


def length(c) -> Column:
    """Characters; 0 for a missing value."""
    return F.coalesce(F.length(col(c)), F.lit(0))


def contains(c, pattern: str, regex: bool = True, na: bool = False) -> Column:
    return F.coalesce(col(c).rlike(java(pattern)) if regex else col(c).contains(pattern), F.lit(na))


def startswith(c, prefix: str) -> Column:
    return col(c).startswith(prefix)


def endswith(c, suffix: str) -> Column:
    return col(c).endswith(suffix)


def replace(c, old: str, new: str, regex: bool = False) -> Column:
    return F.regexp_replace(col(c), java(old), re.sub(r"\\(\d)", r"$\1", new)) if regex else F.replace(col(c), F.lit(old), F.lit(new))


def split(c, separator: str | None = None) -> Column:
    """An array; without a separator, at runs of white space."""
    if separator is None:
        return F.filter(F.split(strip(c), r"\s+"), lambda x: x != "")
    return F.split(col(c), quoted(separator))


def split_columns(df: DataFrame, c: str, separator: str, parts: int, prefix: str = "part") -> DataFrame:
    pieces = split(c, separator)
    return df.withColumns({f"{prefix}{i}": F.get(pieces, F.lit(i)) for i in range(parts)})


def cat(df: DataFrame, c: str, order_by: str, separator: str = "") -> DataFrame:
    """All values that are not missing, joined in order: one row ``value``."""
    rows = F.sort_array(F.collect_list(F.when(F.col(c).isNotNull(), F.struct(order_by, F.col(c).alias("v")))))
    return df.agg(F.array_join(F.transform(rows, lambda x: x["v"]), separator).alias("value"))


def get(c, i: int) -> Column:
    """The character at a position; NULL outside, and for minus the length."""
    c = col(c)
    return F.when(F.length(c) > abs(i), F.substring(c, i + 1 if i >= 0 else i, 1))


def slice_(c, start: int | None = None, stop: int | None = None) -> Column:
    """Characters from ``start`` to ``stop``, which count from the end where negative."""
    c = col(c)
    n = F.length(c)

    def place(i: int | None, default: Column) -> Column:
        return default if i is None else F.least(F.lit(i), n) if i >= 0 else F.greatest(n + i, F.lit(0))

    a, b = place(start, F.lit(0)), place(stop, n)
    return F.when(c.isNotNull(), F.substring(c, a + 1, F.greatest(b - a, F.lit(0))))


def isnumeric(c) -> Column:
    return col(c).rlike(r"^\p{N}+$")


def isalpha(c) -> Column:
    return col(c).rlike(r"^\p{L}+$")


def pad(c, width: int, side: str = "left", fill: str = " ") -> Column:
    c = col(c)
    return F.when(F.length(c) < width, F.lpad(c, width, fill) if side == "left" else F.rpad(c, width, fill)).otherwise(c)


def zfill(c, width: int) -> Column:
    """Zeros after a sign."""
    c = col(c)
    signed = F.concat(F.substring(c, 1, 1), F.lpad(F.substring(c, F.lit(2), F.length(c)), width - 1, "0"))
    return F.when(F.length(c) >= width, c).when(c.rlike("^[+-]"), signed).otherwise(F.lpad(c, width, "0"))


def extract(c, pattern: str, group: int = 1) -> Column:
    return F.when(col(c).rlike(java(pattern)), F.regexp_extract(col(c), java(pattern), group))


def count(c, text: str) -> Column:
    """Occurrences of a literal text that don't overlap."""
    return F.regexp_count(col(c), F.lit(quoted(text)))


def findall(c, pattern: str, group: int = 0) -> Column:
    return F.regexp_extract_all(col(c), F.lit(java(pattern)), F.lit(group))
