"""Whole-column and grouped aggregates, each in one distributed ``agg``."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from colframe.operators.ordering import by_block, fresh, keys
from colframe.operators.relational import numeric_columns


def _n(c: str) -> Column:
    return F.count(c).cast("double")


def spread(c: str, ddof: int = 1, variance: bool = False) -> Column:
    """Standard deviation or variance with ``n - ddof``; NULL where that isn't positive."""
    if ddof == 1:
        return F.var_samp(c) if variance else F.stddev_samp(c)
    if ddof == 0:
        return F.var_pop(c) if variance else F.stddev_pop(c)
    v = F.when(_n(c) > ddof, F.var_pop(c) * _n(c) / (_n(c) - ddof))
    return v if variance else F.sqrt(v)


def skew(c: str) -> Column:
    """Bias-corrected skewness; NULL under 3 values."""
    n = _n(c)
    return F.when(n >= 3, F.skewness(c) * F.sqrt(n * (n - 1)) / (n - 2))


def kurt(c: str) -> Column:
    """Bias-corrected excess kurtosis; NULL under 4 values."""
    n = _n(c)
    return F.when(n >= 4, (n - 1) / ((n - 2) * (n - 3)) * ((n + 1) * F.kurtosis(c) + 6))


def sem(c: str, ddof: int = 1) -> Column:
    return spread(c, ddof) / F.sqrt(_n(c))


def nunique(c: str, dropna: bool = True) -> Column:
    n = F.count_distinct(c)
    return n if dropna else n + F.max(F.when(F.col(c).isNull(), 1).otherwise(0))


def quantile(c: str, q: float | Sequence[float] = 0.5) -> Column:
    """Exact, with linear interpolation."""
    return F.percentile(c, F.lit(q) if isinstance(q, float) else F.array(*map(F.lit, q)))


REDUCTIONS: dict[str, Callable[[str], Column]] = {
    "sum": lambda c: F.coalesce(F.sum(c), F.lit(0)),
    "mean": F.avg,
    "min": F.min,
    "max": F.max,
    "count": F.count,
    "std": spread,
    "var": lambda c: spread(c, variance=True),
    "median": F.median,
    "any": F.bool_or,
    "all": F.bool_and,
    "nunique": nunique,
    "skew": skew,
    "kurt": kurt,
    "sem": sem,
    "prod": F.product,
}


def reduce_columns(df: DataFrame, how: str | Sequence[str], columns: Sequence[str] | None = None) -> DataFrame:
    """One row: each reduction of each column, named ``column_how``."""
    hows = keys(how)
    return df.agg(*(REDUCTIONS[h](c).alias(f"{c}_{h}") for c in columns or numeric_columns(df) for h in hows))


def describe(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """A row for each numeric column: count, mean, std, min, exact quartiles, max."""
    columns = list(columns or numeric_columns(df))
    one = lambda c: F.struct(F.lit(c).alias("column"), F.count(c).alias("count"), F.avg(c).alias("mean"), F.stddev_samp(c).alias("std"), F.min(c).cast("double").alias("min"), *(F.percentile(c, q).alias(n) for n, q in (("q25", 0.25), ("q50", 0.5), ("q75", 0.75))), F.max(c).cast("double").alias("max"))
    return df.agg(F.array(*map(one, columns)).alias("x")).select(F.inline("x"))


def value_counts(df: DataFrame, column: str, ascending: bool = False) -> DataFrame:
    """Counts of each value, missing too; the most first, equal counts by descending value."""
    out = df.groupBy(column).agg(F.count("*").alias("count"))
    return out.orderBy("count", column) if ascending else out.orderBy(F.desc("count"), F.desc(column))


def unique(df: DataFrame, column: str) -> DataFrame:
    return df.select(column).distinct().orderBy(column)


def mode(df: DataFrame, column: str) -> DataFrame:
    """All values that occur most, ascending."""
    n = fresh([column], "_n")
    counts = df.filter(F.col(column).isNotNull()).groupBy(column).agg(F.count("*").alias(n))
    most = counts.agg(F.max(n).alias(n))
    return counts.join(F.broadcast(most), n).select(column).orderBy(column)  # one row


def modes(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """One row: of each column the value that occurs most, the least of equal ones."""
    return df.agg(*(F.mode(c, True).alias(c) for c in columns or df.columns))


def idx(df: DataFrame, column: str, label: str, order_by: str, largest: bool = True) -> DataFrame:
    """The label of the first extreme value: one row ``label``."""
    rows = df.filter(F.col(column).isNotNull())
    order = [F.desc(column) if largest else F.asc(column), F.asc(order_by)]
    return rows.orderBy(*order).limit(1).select(F.col(label).alias("label"))


def idx_across(columns: Sequence[str], largest: bool = True) -> Column:
    """The name of the column that has a row's extreme value, the first of equal ones."""
    best = (F.greatest if largest else F.least)(*columns)
    out = F.lit(None).cast("string")
    for c in reversed(columns):
        out = F.when(F.col(c) == best, F.lit(c)).otherwise(out)
    return out


def autocorr(df: DataFrame, column: str, order_by: str, lag: int = 1, partition_by: Sequence[str] = (), rows: int | None = None) -> DataFrame:
    """Correlation with the value ``lag`` rows before, within groups or over the whole table in blocks."""
    before = fresh(df, "_lag")
    add = lambda w: {before: F.lag(column, lag).over(w)}
    made = df.withColumns(add(Window.partitionBy(*partition_by).orderBy(order_by))) if partition_by else by_block(df, order_by, lag, add, rows)
    return made.agg(F.corr(column, before).alias("autocorr"))


# Groups

GROUPED: dict[str, Callable[[str], Column]] = {k: REDUCTIONS[k] for k in ("mean", "min", "max", "count", "std", "var", "median", "skew", "kurt", "sem", "any", "all", "prod")} | {"sum": F.sum, "nunique": lambda c: nunique(c, dropna=False)}


def first_last(c: str, order_by: str, last: bool = False) -> Column:
    """The first or last value that isn't missing, in order."""
    has = F.when(F.col(c).isNotNull(), F.col(order_by))
    return F.max_by(c, has) if last else F.min_by(c, has)


class Groups:
    """A table grouped by keys; rows with a missing key are left out."""

    def __init__(self, df: DataFrame, by: str | Sequence[str], order_by: str | None = None):
        self.by, self.order_by = keys(by), order_by
        self.df = df.dropna("any", subset=self.by)

    def _one(self, c: str, how: str | Callable) -> Column:
        if callable(how):
            return how(c)
        if how in ("first", "last"):
            return first_last(c, self.order_by, how == "last")
        return F.count("*") if how == "size" else GROUPED[how](c)

    def agg(self, how: str | Sequence[str] | Mapping[str, str | Sequence[str]], columns: Sequence[str] | None = None) -> DataFrame:
        """A name for all columns, several names, or a mapping from columns to names; several give ``column_how``."""
        if isinstance(how, Mapping):
            several = any(not isinstance(h, str) and not callable(h) for h in how.values())
            out = [self._one(c, h).alias(f"{c}_{h}" if several and isinstance(h, str) else c) for c, hs in how.items() for h in (hs if isinstance(hs, (list, tuple)) else [hs])]
        else:
            columns = columns or [c for c in numeric_columns(self.df) if c not in self.by]
            out = [self._one(c, h).alias(c if isinstance(how, str) else f"{c}_{h}") for c in columns for h in keys(how)]
        return self.df.groupBy(*self.by).agg(*out)

    def size(self) -> DataFrame:
        return self.df.groupBy(*self.by).agg(F.count("*").alias("size"))


def groupby(df: DataFrame, by: str | Sequence[str], order_by: str | None = None) -> Groups:
    return Groups(df, by, order_by)
