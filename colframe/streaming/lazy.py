"""Recorded steps over tables read in splits, and the same steps over streams."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from colframe.operators.relational import concat_rows
from colframe.sources.files import read_csv


class LazyFrame:
    """Steps that run when something is asked for; Spark's splits are the chunks."""

    def __init__(self, df: DataFrame):
        self.df = df

    @classmethod
    def from_frames(cls, *tables: DataFrame) -> LazyFrame:
        return cls(concat_rows(*tables))

    def filter(self, condition: Callable[[DataFrame], Column] | Column | str) -> LazyFrame:
        return LazyFrame(self.df.filter(condition(self.df) if callable(condition) and not isinstance(condition, Column) else condition))

    def select(self, columns: Sequence[str]) -> LazyFrame:
        return LazyFrame(self.df.select(*columns))

    def map(self, fn: Callable[[DataFrame], DataFrame]) -> LazyFrame:
        return LazyFrame(self.df.transform(fn))

    def map_batches(self, fn: Callable, schema: str) -> LazyFrame:
        """An opaque function from a pandas frame to one, for each Arrow batch."""
        return LazyFrame(self.df.mapInPandas(lambda frames: map(fn, frames), schema))

    def sum(self, column: str) -> Any:
        return self.df.agg(F.sum(column)).first()[0]

    def mean(self, column: str) -> Any:
        return self.df.agg(F.avg(column)).first()[0]

    def count(self) -> int:
        return self.df.count()

    def collect(self) -> DataFrame:
        return self.df

    def __iter__(self) -> Iterator[dict]:
        return (r.asDict() for r in self.df.toLocalIterator())


def read_csv_chunked(spark: SparkSession, path: str, **options: Any) -> LazyFrame:
    return LazyFrame(read_csv(spark, path, **options))


def windowed_counts(events: DataFrame, time: str, keys: Sequence[str], width: str = "10 minutes", late: str | None = None, slide: str | None = None) -> DataFrame:
    """Counts by time window and keys, of a table or a stream; events over ``late`` behind are dropped in a stream."""
    if late and events.isStreaming:
        events = events.withWatermark(time, late)
    w = F.window(time, width, slide) if slide else F.window(time, width)
    return events.groupBy(w.alias("w"), *keys).agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), *keys, "n")


def sessions(events: DataFrame, time: str, keys: Sequence[str], gap: str = "30 minutes", late: str | None = None) -> DataFrame:
    """Sessions of each key: events with no gap between them as long as ``gap``."""
    if late and events.isStreaming:
        events = events.withWatermark(time, late)
    return events.groupBy(F.session_window(time, gap).alias("w"), *keys).agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), *keys, "n")
