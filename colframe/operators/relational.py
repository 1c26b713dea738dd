"""Selection, renaming, sorting, duplicates, combination of tables, missing values."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from functools import reduce
from typing import Any

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from colframe.operators.ordering import fresh, keys, sort_columns, with_row_index

NUMERIC = ("tinyint", "smallint", "int", "bigint", "float", "double")


def numeric_columns(df: DataFrame) -> list[str]:
    return [c for c, k in df.dtypes if k in NUMERIC or k.startswith("decimal")]


# Selection


def select(df: DataFrame, columns: str | Sequence[str]) -> DataFrame:
    return df.select(*keys(columns))


def filter_columns(df: DataFrame, items: Sequence[str] | None = None, like: str | None = None) -> DataFrame:
    """Columns by name or part of a name."""
    wanted = set(items or ())
    return df.select(*(c for c in df.columns if (items is not None and c in wanted) or (like is not None and like in c)))


def iloc(df: DataFrame, order_by: str | Sequence[str], start: int | None = None, stop: int | None = None, step: int = 1, columns: Sequence[int] | None = None) -> DataFrame:
    """Rows of a range of positions in the order of the keys; negative ends count from the last row."""
    n = df.count() if (start or 0) < 0 or (stop or 0) < 0 else None
    a, b = (x + n if x is not None and x < 0 else x for x in (start, stop))
    row = fresh(df, "_row")
    out = with_row_index(df, order_by, row).filter(F.col(row) >= (a or 0))
    if b is not None:
        out = out.filter(F.col(row) < b)
    if step != 1:
        out = out.filter((F.col(row) - (a or 0)) % step == 0)
    out = out.drop(row)
    return out.select(*(out.columns[i] for i in columns)) if columns is not None else out


def iloc_rows(df: DataFrame, order_by: str | Sequence[str], positions: Sequence[int]) -> DataFrame:
    row = fresh(df, "_row")
    return with_row_index(df, order_by, row).filter(F.col(row).isin(*positions)).drop(row)


def loc(df: DataFrame, label: str, labels: Any | Sequence[Any], columns: Sequence[str] | None = None) -> DataFrame:
    """Rows whose label is one of those given."""
    labels = labels if isinstance(labels, (list, tuple, set)) else [labels]
    out = df.filter(F.col(label).isin(*labels))
    return out.select(*columns) if columns else out


def loc_slice(df: DataFrame, label: str, first: Any, last: Any) -> DataFrame:
    """Rows with labels from ``first`` to ``last``, both included."""
    return df.filter(F.col(label).between(first, last))


def assign(df: DataFrame, **columns: Any) -> DataFrame:
    """New columns; a callable is given the table so far."""
    for name, value in columns.items():
        value = value(df) if callable(value) and not isinstance(value, Column) else value
        df = df.withColumn(name, value if isinstance(value, Column) else F.lit(value))
    return df


def drop(df: DataFrame, columns: Sequence[str] = (), labels: Sequence[Any] = (), label: str | None = None) -> DataFrame:
    out = df.drop(*columns)
    return out.filter(~F.coalesce(F.col(label).isin(*labels), F.lit(False))) if labels and label else out


def rename(df: DataFrame, columns: Mapping[str, str] | Callable[[str], str]) -> DataFrame:
    return df.toDF(*(columns(c) if callable(columns) else columns.get(c, c) for c in df.columns))


def astype(df: DataFrame, kinds: str | Mapping[str, str], errors: str = "raise") -> DataFrame:
    kinds = dict.fromkeys(df.columns, kinds) if isinstance(kinds, str) else kinds
    return df.withColumns({c: F.col(c).try_cast(k) if errors == "coerce" else F.col(c).cast(k) for c, k in kinds.items()})


def head(df: DataFrame, n: int = 5, order_by: str | Sequence[str] | None = None) -> DataFrame:
    return df.orderBy(*keys(order_by)).limit(n) if order_by else df.limit(n)


def tail(df: DataFrame, order_by: str | Sequence[str], n: int = 5) -> DataFrame:
    k = keys(order_by)
    return df.orderBy(*(F.desc(c) for c in k)).limit(n).orderBy(*k)


def sample(df: DataFrame, key: str | Sequence[str], n: int | None = None, frac: float | None = None, seed: int = 0, replace: bool = False) -> DataFrame:
    """Exactly ``n`` rows (or that share of all), chosen by a seeded hash of the key; with ``replace`` rows may repeat."""
    n = int(frac * df.count()) if n is None else n
    if replace:
        total, row = df.count(), fresh(df, "_row")
        picks = df.sparkSession.range(n).select(F.pmod(F.xxhash64("id", F.lit(seed)), F.lit(total)).alias(row))
        return picks.join(with_row_index(df, key, row), row).drop(row)
    return df.orderBy(F.xxhash64(*keys(key), F.lit(seed)), *keys(key)).limit(n)


def equals(a: DataFrame, b: DataFrame) -> bool:
    """Whether two tables have the same columns and rows, in any order."""
    return a.dtypes == b.dtypes and a.exceptAll(b).isEmpty() and b.exceptAll(a).isEmpty()


def info(df: DataFrame) -> DataFrame:
    """A row for each column: its type and how many values it has."""
    counts = df.agg(*(F.count(c).alias(c) for c in df.columns))
    kinds = F.create_map(*(F.lit(x) for ck in df.dtypes for x in ck))
    return counts.unpivot([], list(df.columns), "column", "non_null").withColumn("type", kinds[F.col("column")])


# Order and duplicates


def sort_values(df: DataFrame, by: str | Sequence[str], ascending: bool | Sequence[bool] = True) -> DataFrame:
    """Lexicographic; a missing value is the largest."""
    return df.orderBy(*sort_columns(by, ascending, nulls_largest=True))


def sorted_rows(df: DataFrame, by: str | Sequence[str], ascending: bool | Sequence[bool] = True, name: str = "row", rows: int | None = None) -> DataFrame:
    """The table with each row's position in the order of ``sort_values``, for what has to outlive the sort."""
    return with_row_index(df, by, name, rows, ascending, nulls_largest=True)


def nlargest(df: DataFrame, n: int, column: str, tie: str | Sequence[str]) -> DataFrame:
    return df.orderBy(F.col(column).desc_nulls_first(), *keys(tie)).limit(n)


def nsmallest(df: DataFrame, n: int, column: str, tie: str | Sequence[str]) -> DataFrame:
    return df.orderBy(F.col(column).asc_nulls_last(), *keys(tie)).limit(n)


def duplicated(df: DataFrame, order_by: str | Sequence[str], subset: Sequence[str] | None = None, keep: str | bool = "first", name: str = "duplicated") -> DataFrame:
    """Marks rows that repeat another in the subset; ``keep=False`` marks all of them."""
    subset = list(subset or df.columns)
    if keep is False:
        return df.withColumn(name, F.count("*").over(Window.partitionBy(*subset)) > 1)
    order = [F.asc(c) if keep == "first" else F.desc(c) for c in keys(order_by)]
    return df.withColumn(name, F.row_number().over(Window.partitionBy(*subset).orderBy(*order)) > 1)


def drop_duplicates(df: DataFrame, order_by: str | Sequence[str], subset: Sequence[str] | None = None, keep: str | bool = "first") -> DataFrame:
    dup = fresh(df, "_dup")
    return duplicated(df, order_by, subset or df.columns, keep, dup).filter(~F.col(dup)).drop(dup)


# Combination


def concat_rows(*tables: DataFrame) -> DataFrame:
    """All rows, by column name; absent columns are NULL."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), tables)


def concat_columns(*tables: tuple[DataFrame, str]) -> DataFrame:
    """Tables side by side in the order of each one's key; shorter ones are padded, a name taken gets a number."""
    out, names = None, set()
    row = fresh([c for df, _ in tables for c in df.columns], "_row")
    for df, key in tables:
        renamed = []
        for c in df.columns:
            name, k = c, 1
            while name in names:
                name, k = f"{c}_{k}", k + 1
            names.add(name)
            renamed.append(name)
        indexed = with_row_index(df, key, row).toDF(*renamed, row)
        out = indexed if out is None else out.join(indexed, row, "full")
    return out.drop(row)


def set_operation(a: DataFrame, b: DataFrame, how: str) -> DataFrame:
    return {"union": lambda: a.unionByName(b).distinct(), "union_all": lambda: a.unionByName(b), "intersect": lambda: a.intersect(b), "except": lambda: a.subtract(b)}[how]()


# Missing values


def fillna(df: DataFrame, value: Any | Mapping[str, Any]) -> DataFrame:
    return df.fillna(value)


def dropna(df: DataFrame, how: str = "any", subset: Sequence[str] | None = None) -> DataFrame:
    return df.dropna(how, subset=list(subset) if subset else None)


def dropna_columns(df: DataFrame, how: str = "any") -> DataFrame:
    """Without the columns that have a missing value, or nothing else."""
    n, *has = df.agg(F.count("*"), *(F.count(c) for c in df.columns)).first()
    return df.select(*(c for c, k in zip(df.columns, has) if (k == n if how == "any" else k > 0)))


def isna(df: DataFrame) -> DataFrame:
    return df.select(*(F.col(c).isNull().alias(c) for c in df.columns))


def combine_first(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """Missing values of ``a`` from the row of ``b`` with the same key; columns of ``b`` alone are added."""
    theirs = {c: fresh([*a.columns, *b.columns], f"_b_{c}") for c in b.columns if c != key}
    out = a.join(b.select(key, *(F.col(c).alias(n) for c, n in theirs.items())), key, "left")
    shared = [F.coalesce(F.col(c), F.col(theirs[c])).alias(c) if c in theirs else F.col(c) for c in a.columns]
    return out.select(*shared, *(F.col(n).alias(c) for c, n in theirs.items() if c not in a.columns))


def update(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """Values of ``b``, missing ones too, where it has a row with the same key."""
    theirs = {c: fresh([*a.columns, *b.columns], f"_b_{c}") for c in b.columns if c in a.columns and c != key}
    met = fresh([*a.columns, *theirs.values()], "_met")
    out = a.join(b.select(key, F.lit(True).alias(met), *(F.col(c).alias(n) for c, n in theirs.items())), key, "left")
    return out.select(*(F.when(F.col(met), F.col(theirs[c])).otherwise(F.col(c)).alias(c) if c in theirs else F.col(c) for c in a.columns))
