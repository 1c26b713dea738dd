"""Wide and long forms, categories, bins, lists."""

from __future__ import annotations

from collections.abc import Sequence
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from colframe.operators.aggregates import REDUCTIONS
from colframe.operators.ordering import keys

#: Most categories that become columns.
MOST_COLUMNS = 10_000


def categories(df: DataFrame, column: str) -> list[Any]:
    """The different values of a column, sorted by their text; an error if they are too many for columns."""
    found = [r[0] for r in df.select(column).filter(F.col(column).isNotNull()).distinct().limit(MOST_COLUMNS + 1).collect()]
    if len(found) > MOST_COLUMNS:
        raise ValueError(f"{column} has over {MOST_COLUMNS} values")
    return sorted(found, key=str)


def get_dummies(df: DataFrame, columns: Sequence[str] | None = None, prefix: str | None = None, missing: bool = False) -> DataFrame:
    """A 0/1 column for each value of each (by default: text) column, in its place at the end."""
    columns = list(columns or (c for c, k in df.dtypes if k == "string"))
    out = {}
    for c in columns:
        for v in categories(df, c):
            out[f"{prefix or c}_{v}"] = F.coalesce((F.col(c) == F.lit(v)).cast("double"), F.lit(0.0))
        if missing:
            out[f"{prefix or c}_nan"] = F.col(c).isNull().cast("double")
    return df.withColumns(out).drop(*columns)


def melt(df: DataFrame, id_vars: Sequence[str], value_vars: Sequence[str] | None = None, var_name: str = "variable", value_name: str = "value") -> DataFrame:
    """Columns to rows; values of different kinds become text."""
    values = list(value_vars or (c for c in df.columns if c not in id_vars))
    kinds = {k for c, k in df.dtypes if c in values}
    if "string" in kinds and len(kinds) > 1:
        df = df.withColumns({c: F.col(c).cast("string") for c in values})
    return df.unpivot(list(id_vars), values, var_name, value_name)


def pivot_table(df: DataFrame, values: str, index: str | Sequence[str], columns: str, aggfunc: str = "mean", fill_value: Any = None) -> DataFrame:
    found = categories(df, columns)
    out = df.groupBy(*keys(index)).pivot(columns, found).agg(REDUCTIONS[aggfunc](values))
    return out if fill_value is None else out.fillna(fill_value)


def crosstab(df: DataFrame, a: str, b: str) -> DataFrame:
    return df.filter(F.col(a).isNotNull()).groupBy(a).pivot(b, categories(df, b)).count().fillna(0)


def cut(c: Column | str, edges: Sequence[float], labels: Sequence[str] | None = None) -> Column:
    """The label of the bin ``[edge, next edge)`` that a value lies in; NULL outside, on the last edge, or missing."""
    c = F.col(c) if isinstance(c, str) else c
    names = labels or [f"({a}, {b}]" for a, b in zip(edges, edges[1:])]
    out = F.lit(None).cast("string")
    for a, b, name in reversed(list(zip(edges, edges[1:], names))):
        out = F.when((c >= a) & (c < b), F.lit(name)).otherwise(out)
    return out


def quantile_edges(df: DataFrame, column: str, q: int | Sequence[float]) -> list[float]:
    points = [i / q for i in range(q + 1)] if isinstance(q, int) else list(q)
    found = list(df.agg(F.percentile(column, F.array(*map(F.lit, points)))).first()[0])
    found[0] -= 1e-9
    found[-1] += 1e-9
    return found


def qcut(df: DataFrame, column: str, q: int | Sequence[float], name: str, labels: Sequence[str] | None = None) -> DataFrame:
    return df.withColumn(name, cut(column, quantile_edges(df, column, q), labels))


def explode(df: DataFrame, column: str) -> DataFrame:
    """A row for each element; an empty list drops its row, a missing one stays."""
    kind = df.schema[column].dataType
    return df.withColumn(column, F.explode(F.coalesce(F.col(column), F.array(F.lit(None).cast(kind.elementType)))))
