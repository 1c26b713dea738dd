"""Tables with one column marked as labels, their constructors and their shape.

A Spark table has no row labels: ``Indexed`` names the column that has them, and
only what is written here depends on it.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Mapping, Sequence
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, DoubleType, LongType, StringType, StructField, StructType

from colframe.operators.ordering import fresh, named, with_row_index

#: Rows that ``transposed`` makes columns of at most.
MOST_COLUMNS = 10_000
#: Bytes of a value by type; others are measured as text.
WIDTHS = {"tinyint": 1, "boolean": 1, "smallint": 2, "int": 4, "float": 4, "date": 4, "bigint": 8, "double": 8, "timestamp": 8, "timestamp_ntz": 8}


# Constructors


def _value(v: Any) -> Any:
    """A plain value; NaN is a missing one."""
    v = v.item() if hasattr(v, "item") and not isinstance(v, (bytes, str)) else v
    return None if isinstance(v, float) and v != v else v


def _kind(values: list):
    """Whole numbers stay so, also with missing values; numbers of both kinds are doubles; mixed kinds are text."""
    kinds = {type(v) for v in values if v is not None}
    if not kinds:
        return DoubleType()
    if kinds == {bool}:
        return BooleanType()
    if kinds == {int}:
        return LongType()
    if kinds <= {int, float, bool}:
        return DoubleType()
    return StringType() if str in kinds or len(kinds) > 1 else None


def from_dict(spark: SparkSession, data: Mapping[str, Any], columns: Sequence[str] | None = None, index: Sequence | None = None) -> Indexed:
    """Columns of values; a single value is a column of one row.  Labels are 0, 1, .. where none are given."""
    names = list(columns or data)
    made = {c: [_value(v) for v in (data[c] if hasattr(data[c], "__iter__") and not isinstance(data[c], (str, bytes)) else [data[c]])] for c in names}
    sizes = {len(v) for v in made.values()}
    if len(sizes) > 1:
        raise ValueError(f"columns of different lengths: { {c: len(v) for c, v in made.items()} }")
    n = sizes.pop() if sizes else 0
    label = fresh(names, "index")
    made = {label: [_value(v) for v in index] if index is not None else list(range(n))} | made
    fields = []
    for c, values in made.items():
        kind = _kind(values)
        if isinstance(kind, StringType):
            made[c] = [v if v is None or isinstance(v, str) else str(v) for v in values]
        elif isinstance(kind, DoubleType):
            made[c] = [v if v is None else float(v) for v in values]
        fields.append((c, kind))
    if all(k is not None for _, k in fields):
        return Indexed(spark.createDataFrame(list(zip(*made.values())), StructType([StructField(c, k) for c, k in fields])), label)
    return Indexed(spark.createDataFrame(list(zip(*made.values())), [c for c, _ in fields]), label)


def from_records(spark: SparkSession, rows: Sequence[Mapping[str, Any]], index: Sequence | None = None) -> Indexed:
    """Rows as mappings; what one lacks is missing."""
    names = list(dict.fromkeys(k for r in rows for k in r))
    return from_dict(spark, {c: [r.get(c) for r in rows] for c in names}, names, index)


def from_array(spark: SparkSession, rows: Any, columns: Sequence[str] | None = None, index: Sequence | None = None) -> Indexed:
    """A list of rows or a two-dimensional array; columns are named by position where no names are given."""
    rows = [list(r) if hasattr(r, "__iter__") and not isinstance(r, str) else [r] for r in rows]
    names = list(columns or (str(i) for i in range(len(rows[0]) if rows else 0)))
    return from_dict(spark, {c: [r[i] for r in rows] for i, c in enumerate(names)}, names, index)


def series(spark: SparkSession, values: Any, name: str = "value", index: Sequence | None = None) -> Indexed:
    """One column, from a list or from a mapping of labels to values."""
    if isinstance(values, Mapping):
        return from_dict(spark, {name: list(values.values())}, index=list(values) if index is None else index)
    return from_dict(spark, {name: values}, index=index)


class Indexed:
    """A table and the name of the column that labels its rows."""

    def __init__(self, df: DataFrame, index: str):
        self.df, self.index = df, index

    @property
    def columns(self) -> list[str]:
        return [c for c in self.df.columns if c != self.index]

    def renamed(self, names: Sequence[str]) -> Indexed:
        """Other names for all columns, in order; the labels keep theirs."""
        given = dict(zip(self.columns, names, strict=True))
        return Indexed(self.df.toDF(*(given.get(c, c) for c in self.df.columns)), self.index)

    def labelled(self, labels: Column) -> Indexed:
        """Other labels, from the columns."""
        return Indexed(self.df.withColumn(self.index, labels), self.index)

    def __getitem__(self, label: Any) -> dict[str, Any]:
        """The row of a label, the first one in the order of its values; KeyError without one."""
        found = self.df.filter(F.col(self.index) == F.lit(label)).select(*named(self.columns)).orderBy(*named(self.columns)).first()
        if found is None:
            raise KeyError(label)
        return found.asDict()

    def put(self, label: Any, **values: Any) -> Indexed:
        """The table with other values in the rows of a label."""
        here = F.col(self.index) == F.lit(label)
        return Indexed(self.df.withColumns({c: F.when(here, F.lit(v)).otherwise(F.col(c)) for c, v in values.items()}), self.index)

    def __contains__(self, column: str) -> bool:
        return column in self.columns

    def __len__(self) -> int:
        return self.df.count()

    def __iter__(self) -> Iterator[str]:
        return iter(self.columns)

    @property
    def shape(self) -> tuple[int, int]:
        return len(self), len(self.columns)

    @property
    def size(self) -> int:
        return len(self) * len(self.columns)

    @property
    def ndim(self) -> int:
        return 2

    @property
    def empty(self) -> bool:
        return not self.columns or self.df.isEmpty()

    @property
    def dtypes(self) -> dict[str, str]:
        return {c: k for c, k in self.df.dtypes if c != self.index}

    def set_index(self, column: str) -> Indexed:
        """Another column labels the rows; the labels so far go."""
        return Indexed(self.df.drop(self.index), column)

    def reset_index(self, order_by: str | Sequence[str] | None = None, drop: bool = False) -> Indexed:
        """Labels 0, 1, .. in the order of the keys (the labels, where none are given); the old ones become column ``index``."""
        new = fresh([*self.df.columns, "index"], "row")
        out = with_row_index(self.df, order_by or self.index, new)
        kept = [] if drop else [F.col(self.index).alias("index" if "index" not in self.columns else fresh(self.columns, "index"))]
        return Indexed(out.select(new, *kept, *named(self.columns)), new)

    def sort_index(self, ascending: bool = True) -> Indexed:
        key = F.col(self.index)
        return Indexed(self.df.orderBy(key.asc_nulls_last() if ascending else key.desc_nulls_first()), self.index)

    def copy(self) -> Indexed:
        """The same: a table doesn't change."""
        return Indexed(self.df, self.index)

    def pipe(self, fn: Callable, *args: Any, **kwargs: Any) -> Any:
        return fn(self, *args, **kwargs)

    def to_list(self, column: str) -> list:
        """A column's values in the order of the labels, on the driver."""
        return [r[0] for r in self.df.orderBy(self.index).select(*named([column])).toLocalIterator()]

    def to_frame(self) -> DataFrame:
        return self.df.select(*named([self.index, *self.columns]))


def set_index(df: DataFrame, column: str) -> Indexed:
    return Indexed(df, column)


def memory_usage(df: DataFrame) -> DataFrame:
    """``(column, bytes)``: of values of fixed width their width, of others the length of their text."""
    one = lambda c, k: F.sum(F.when(F.col(c).isNotNull(), F.lit(WIDTHS[k]) if k in WIDTHS else F.octet_length(F.col(c) if k in ("string", "binary") else F.to_json(F.struct(c))))).cast("long")
    rows = F.array(*(F.struct(F.lit(c).alias("column"), F.coalesce(one(c, k), F.lit(0)).cast("long").alias("bytes")) for c, k in df.dtypes))
    return df.agg(rows.alias("x")).select(F.inline("x"))


def transposed(df: DataFrame, index: str) -> DataFrame:
    """Columns as rows and rows as columns named by their labels, as text; an error with too many rows."""
    labels = [r[0] for r in df.select(F.col(index).cast("string")).distinct().orderBy(index).limit(MOST_COLUMNS + 1).collect()]
    if len(labels) > MOST_COLUMNS:
        raise ValueError(f"over {MOST_COLUMNS} rows")
    values = [c for c in df.columns if c != index]
    long = df.select(F.col(index).cast("string").alias("label"), *(F.col(c).cast("string").alias(c) for c in values)).unpivot(["label"], values, "column", "value")
    return long.groupBy("column").pivot("label", labels).agg(F.first("value"))
