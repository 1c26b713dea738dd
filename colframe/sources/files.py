"""Readers and writers of files, and interchange with pandas, Arrow and NumPy."""

from __future__ import annotations

import json
import tempfile
import uuid
from collections.abc import Iterator, Sequence
from html.parser import HTMLParser
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from colframe.functions.math import nan_to_null


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the folder that all executors share; a temporary one only for a local master."""
    there = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not there:
        master = spark.sparkContext.master
        if not (master == "local" or master.startswith("local[")):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        there = "file://" + tempfile.mkdtemp(prefix="colframe-")
        spark.sparkContext.setCheckpointDir(there)
    return f"{there.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def _cut(df: DataFrame, usecols: Sequence[str] | None, nrows: int | None) -> DataFrame:
    out = df.select(*usecols) if usecols else df
    return nan_to_null(out if nrows is None else out.limit(nrows))


def read_csv(spark: SparkSession, path: str, schema: str | None = None, usecols: Sequence[str] | None = None, nrows: int | None = None, **options: Any) -> DataFrame:
    reader = spark.read.options(**({"header": True} | options))
    return _cut(reader.schema(schema).csv(path) if schema else reader.option("inferSchema", True).csv(path), usecols, nrows)


def read_parquet(spark: SparkSession, path: str, usecols: Sequence[str] | None = None) -> DataFrame:
    return _cut(spark.read.parquet(path), usecols, None)


def read_json(spark: SparkSession, source: str, lines: bool = False, schema: str | None = None) -> DataFrame:
    """A file, or a literal text that begins with ``[`` or ``{``."""
    if source.lstrip()[:1] in ("[", "{"):
        rows = json.loads(source)
        return spark.createDataFrame(rows if isinstance(rows, list) else [rows], schema)
    reader = spark.read.option("multiLine", not lines)
    return nan_to_null((reader.schema(schema) if schema else reader).json(source))


def read_orc(spark: SparkSession, path: str) -> DataFrame:
    return nan_to_null(spark.read.orc(path))


def read_feather(spark: SparkSession, path: str) -> DataFrame:
    import pyarrow.feather as feather

    return spark.createDataFrame(feather.read_table(path))


def read_excel(spark: SparkSession, path: str, sheet: str | int | None = 0) -> DataFrame | dict[str, DataFrame]:
    """One sheet, or all of them by name; needs pandas' spreadsheet reader."""
    import pandas as pd

    found = pd.read_excel(path, sheet_name=sheet)
    return {k: spark.createDataFrame(v) for k, v in found.items()} if isinstance(found, dict) else spark.createDataFrame(found)


class _Tables(HTMLParser):
    def __init__(self):
        super().__init__()
        self.tables: list[list[list[str]]] = []
        self.cell: list[str] | None = None

    def handle_starttag(self, tag, attrs):
        if tag == "table":
            self.tables.append([])
        elif tag == "tr" and self.tables:
            self.tables[-1].append([])
        elif tag in ("td", "th") and self.tables:
            if not self.tables[-1]:
                self.tables[-1].append([])
            self.cell = []

    def handle_data(self, data):
        if self.cell is not None:
            self.cell.append(data)

    def handle_endtag(self, tag):
        if tag in ("td", "th") and self.cell is not None:
            self.tables[-1][-1].append("".join(self.cell).strip())
            self.cell = None


def html_tables(html: str) -> list[list[list[str]]]:
    """Cells of each table of a page."""
    parser = _Tables()
    parser.feed(html or "")
    return parser.tables


def read_html(spark: SparkSession, html: str) -> list[DataFrame]:
    """A table for each one in a page; the first row names the columns."""
    out = []
    for rows in html_tables(html):
        if rows:
            names = rows[0]
            body = [(r + [None] * len(names))[: len(names)] for r in rows[1:]]
            out.append(spark.createDataFrame(body, ", ".join(f"`{n or i}` string" for i, n in enumerate(names))))
    return out


def tables_of_pages(df: DataFrame, key: str, html: str) -> DataFrame:
    """``(key, table, row, cells)`` of all tables of a column of pages, in Arrow batches."""
    kind = df.schema[key].dataType.simpleString()

    def run(frames: Iterator) -> Iterator:
        import pandas as pd

        for f in frames:
            rows = [(k, t, r, cells) for k, h in zip(f[key], f[html]) for t, table in enumerate(html_tables(h)) for r, cells in enumerate(table)]
            yield pd.DataFrame(rows, columns=[key, "table", "row", "cells"])

    from colframe.shipping import ship

    ship(df.sparkSession)
    return df.select(key, html).mapInPandas(run, f"`{key}` {kind}, `table` int, `row` int, cells array<string>")


def to_csv(df: DataFrame, path: str, mode: str = "overwrite", **options: Any) -> None:
    df.write.mode(mode).options(**({"header": True} | options)).csv(path)


def to_parquet(df: DataFrame, path: str, mode: str = "overwrite", partition_by: Sequence[str] = ()) -> None:
    df.write.mode(mode).partitionBy(*partition_by).parquet(path)


def to_orc(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    df.write.mode(mode).orc(path)


def to_json(df: DataFrame, path: str | None = None, mode: str = "overwrite") -> str | None:
    """A folder of JSON lines, or without a path one text with an array of records (on the driver)."""
    if path is None:
        return "[" + ",".join(r[0] for r in df.select(F.to_json(F.struct(*df.columns), {"ignoreNullFields": "false"})).toLocalIterator()) + "]"
    df.write.mode(mode).json(path)
    return None


def to_excel(df: DataFrame, path: str) -> None:
    df.toPandas().to_excel(path, index=False)


def from_pandas(spark: SparkSession, frame) -> DataFrame:
    return nan_to_null(spark.createDataFrame(frame))


def to_pandas(df: DataFrame):
    return df.toPandas()


def to_numpy(df: DataFrame):
    return df.toPandas().to_numpy()


def to_dict(df: DataFrame, orient: str = "dict") -> Any:
    rows = [r.asDict() for r in df.collect()]
    if orient == "records":
        return rows
    columns = {c: [r[c] for r in rows] for c in df.columns}
    if orient == "list":
        return columns
    if orient == "dict":
        return {c: dict(enumerate(v)) for c, v in columns.items()}
    raise ValueError(orient)


def rows(df: DataFrame) -> Iterator[dict[str, Any]]:
    """Rows one by one, a partition at a time on the driver."""
    return (r.asDict() for r in df.toLocalIterator(prefetchPartitions=True))


def tensors(df: DataFrame, target: str | None = None, batch: int = 1024) -> Iterator[tuple]:
    """Batches of float32 arrays (features, target) for training loops; one partition at a time is on the driver."""
    import numpy as np

    names = [c for c in df.columns if c != target]
    held: list[tuple] = []

    def made() -> tuple:
        x = np.array(held, dtype="float32")
        return (x[:, : len(names)], x[:, len(names)]) if target else (x, None)

    for row in df.select(*names, *([target] if target else [])).toLocalIterator(prefetchPartitions=True):
        held.append(tuple(row))
        if len(held) == batch:
            yield made()
            held.clear()
    if held:
        yield made()


def features_and_target(df: DataFrame, target: str, columns: Sequence[str] | None = None):
    """Arrays of the features and the target, on the driver."""
    import numpy as np

    names = list(columns or (c for c in df.columns if c != target))
    rows_ = df.select(*names, target).collect()
    return np.array([r[:-1] for r in rows_], dtype="float64").reshape(-1, len(names)), np.array([r[-1] for r in rows_])


def to_torch(df: DataFrame, target: str | None = None, batch: int = 1024) -> Iterator[tuple]:
    """``tensors`` as PyTorch's; needs torch."""
    try:
        import torch
    except ImportError as e:
        raise ImportError("to_torch needs torch") from e
    return ((torch.from_numpy(x), None if y is None else torch.from_numpy(y)) for x, y in tensors(df, target, batch))


def to_tensorflow(df: DataFrame, target: str | None = None, batch: int = 1024):
    """``tensors`` as a TensorFlow dataset; needs tensorflow."""
    try:
        import tensorflow as tf
    except ImportError as e:
        raise ImportError("to_tensorflow needs tensorflow") from e
    width = len(df.columns) - (target is not None)
    x = tf.TensorSpec((None, width), tf.float32)
    if target is None:
        return tf.data.Dataset.from_generator(lambda: (x for x, _ in tensors(df, None, batch)), output_signature=x)
    return tf.data.Dataset.from_generator(lambda: tensors(df, target, batch), output_signature=(x, tf.TensorSpec((None,), tf.float32)))
