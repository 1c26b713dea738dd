"""Arithmetic, comparison and element-wise functions: ``Column -> Column``."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def safe_div(a: Column | str, b: Any) -> Column:
    """Quotient as double; NULL for a zero divisor."""
    return F.try_divide(col(a).cast("double"), F.lit(b).cast("double") if not isinstance(b, (Column, str)) else col(b).cast("double"))


def floor_div(a: Column | str, b: Any) -> Column:
    """Quotient rounded towards minus infinity."""
    return F.floor(safe_div(a, b)).cast("long")


def floor_mod(a: Column | str, b: Any) -> Column:
    """Remainder with the sign of the divisor."""
    d = col(b) if isinstance(b, (Column, str)) else F.lit(b)
    return col(a) - d * floor_div(a, b)


def clip(c: Column | str, lower: Any = None, upper: Any = None) -> Column:
    """Values limited to a range; NULL stays NULL."""
    c = col(c)
    out = c
    if upper is not None:
        out = F.when(c > upper, F.lit(upper)).otherwise(out)
    if lower is not None:
        out = F.when(c < lower, F.lit(lower)).otherwise(out)
    return out


def round_even(c: Column | str, decimals: int = 0) -> Column:
    return F.bround(col(c), decimals)


def replace_values(c: Column | str, pairs: Mapping[Any, Any]) -> Column:
    """Pairs applied one after the other, so that a result can be replaced again."""
    return reduce(lambda x, p: F.when(x == p[0], F.lit(p[1])).otherwise(x), pairs.items(), col(c))


def map_values(c: Column | str, table: Mapping[Any, Any]) -> Column:
    """Lookup in a small literal table; NULL for a value that it doesn't have."""
    if not table:
        return F.lit(None)
    found = F.create_map(*(F.lit(x) for kv in table.items() for x in kv))
    return F.when(col(c).isNotNull(), F.try_element_at(found, col(c)))


def map_by_table(df: DataFrame, column: str, table: DataFrame, key: str, value: str, name: str) -> DataFrame:
    """Lookup in a table of any size; the join strategy is the planner's."""
    t = table.select(F.col(key).alias("_key"), F.col(value).alias(name)).dropDuplicates(["_key"])
    return df.join(t, F.col(column) == F.col("_key"), "left").drop("_key")


def is_in(c: Column | str, values: Sequence[Any], match_text: bool = False) -> Column:
    """Membership; ``match_text`` also compares the text forms."""
    c = col(c)
    found = c.isin(*values) if values else F.lit(False)
    if match_text:
        found = found | c.cast("string").isin(*map(str, values))
    return F.coalesce(found, F.lit(False))


def between(c: Column | str, low: Any, high: Any, inclusive: str = "both") -> Column:
    c = col(c)
    left = c >= low if inclusive in ("both", "left") else c > low
    right = c <= high if inclusive in ("both", "right") else c < high
    return F.coalesce(left & right, F.lit(False))


def not_equal(a: Column | str, b: Any) -> Column:
    """Inequality that is true where a side is missing."""
    return F.coalesce(col(a) != b, F.lit(True))


def nan_to_null(df: DataFrame) -> DataFrame:
    """NaN becomes NULL, the only mark of a missing value here."""
    kinds = {"double", "float"}
    return df.withColumns({c: F.when(~F.isnan(c), F.col(c)) for c, k in df.dtypes if k in kinds}) if any(k in kinds for _, k in df.dtypes) else df
