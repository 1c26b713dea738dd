"""Functions of the user over columns, rows, groups and batches, in Arrow batches."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def scalar(fn: Callable, kind: str) -> Callable[..., Column]:
    """A function of values, run over pandas Series."""
    import pandas as pd

    def run(s):
        return s.map(fn)

    run.__annotations__ = {"s": pd.Series, "return": pd.Series}
    return F.pandas_udf(run, kind)


def apply_rows(df: DataFrame, fn: Callable[[dict], object], name: str, kind: str) -> DataFrame:
    """A function of a row as a dict, added as a column."""
    fields = ", ".join(f"`{c}` {k}" for c, k in df.dtypes)

    def run(frames):
        for f in frames:
            yield f.assign(**{name: [fn(r) for r in f.to_dict("records")]})

    return df.mapInPandas(run, f"{fields}, `{name}` {kind}")


def group_apply(df: DataFrame, by: Sequence[str], fn: Callable, kind: str) -> Callable[[str], Column]:
    """An aggregate of the values of a group as a pandas Series."""
    import pandas as pd

    def run(s: pd.Series) -> float:
        return fn(s)

    run.__annotations__ = {"s": pd.Series, "return": float}
    return F.pandas_udf(run, kind)


def map_batches(df: DataFrame, fn: Callable, schema: str) -> DataFrame:
    return df.mapInPandas(lambda frames: map(fn, frames), schema)


def apply_columns(df: DataFrame, fn: Callable, columns: Sequence[str], kind: str = "double") -> DataFrame:
    """One row: a function of each column's values as a pandas Series, which one task holds."""
    return df.agg(*(group_apply(df, [], fn, kind)(c).alias(c) for c in columns))
