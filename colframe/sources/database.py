"""SQL over named tables, catalogs and databases."""

from __future__ import annotations

import json
import sqlite3
from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession


def sql_query(query: str, tables: Mapping[str, DataFrame]) -> DataFrame:
    """A query over tables by their names; the names are views only while it is analysed."""
    spark = next(iter(tables.values())).sparkSession
    taken = {name: spark.table(name) for name in tables if spark.catalog.tableExists(name)}
    for name, df in tables.items():
        df.createOrReplaceTempView(name)
    try:
        out = spark.sql(query)
        out.schema  # noqa: B018  analysed while the views stand
        return out
    finally:
        for name in tables:
            if name in taken:
                taken[name].createOrReplaceTempView(name)
            else:
                spark.catalog.dropTempView(name)


def sql(df: DataFrame, query: str, table: str = "df") -> DataFrame:
    return sql_query(query, {table: df})


#: Rows of a SQLite result that its column types are read from, and rows fetched at once.
SEEN, FETCHED = 1000, 10_000


def _kind(values: list) -> str:
    kinds = {type(v) for v in values if v is not None}
    return "bigint" if kinds == {int} else "double" if kinds and kinds <= {int, float} else "binary" if kinds == {bytes} else "string"


def _sqlite_source():
    """The data source of SQLite files; made when it is used, since its base needs a session's Python."""
    from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

    class Part(InputPartition):
        def __init__(self, query: str):
            self.query = query

    class Reader(DataSourceReader):
        def __init__(self, options: dict, kinds: list[str]):
            self.path, self.queries, self.kinds = options["path"], json.loads(options["queries"]), kinds

        def partitions(self):
            return [Part(q) for q in self.queries]

        def read(self, part):
            import contextlib

            cast = [{"double": float, "string": str}.get(k) for k in self.kinds]
            with contextlib.closing(sqlite3.connect(f"file:{self.path}?mode=ro", uri=True)) as con:
                found = con.execute(part.query)
                while rows := found.fetchmany(FETCHED):
                    for r in rows:
                        yield tuple(v if v is None or c is None else c(v) for v, c in zip(r, cast))

    class Sqlite(DataSource):
        @classmethod
        def name(cls):
            return "colframe_sqlite"

        def schema(self):
            return self.options["schema"]

        def reader(self, schema):
            return Reader(dict(self.options), [f.dataType.simpleString() for f in schema.fields])

    return Sqlite


def read_sqlite(spark: SparkSession, path: str, query: str, column: str | None = None, bounds: Sequence[int] = ()) -> DataFrame:
    """The result of a query to a SQLite file, read by tasks (the file has to be where they run).

    With a whole-number ``column`` of the result and ``bounds``, each range between bounds is a task's.  Column
    types are those of the first ``SEEN`` rows; a column whose later values are of another kind is text or double.
    """
    from colframe.shipping import ship

    ship(spark)
    with sqlite3.connect(path) as con:
        found = con.execute(query)
        names, rows = [d[0] for d in found.description], found.fetchmany(SEEN)
    schema = ", ".join(f"`{n}` {_kind([r[i] for r in rows])}" for i, n in enumerate(names))
    queries = [query]
    if column and bounds:
        ranges = [f"c < {bounds[0]} OR c IS NULL", *(f"c >= {a} AND c < {b}" for a, b in zip(bounds, bounds[1:])), f"c >= {bounds[-1]}"]
        queries = [f'SELECT {", ".join(chr(34) + n + chr(34) for n in names)} FROM (SELECT *, "{column}" AS c FROM ({query})) WHERE {r}' for r in ranges]
    spark.dataSource.register(_sqlite_source())
    return spark.read.format("colframe_sqlite").options(path=path, queries=json.dumps(queries), schema=schema).load()


def write_sqlite(df: DataFrame, path: str, table: str, if_exists: str = "replace") -> None:
    """Rows go through the driver, a partition at a time: a SQLite file has one writer."""
    with sqlite3.connect(path) as con:
        if if_exists == "replace":
            con.execute(f'DROP TABLE IF EXISTS "{table}"')
        con.execute(f'CREATE TABLE IF NOT EXISTS "{table}" ({", ".join(f"{chr(34)}{c}{chr(34)}" for c in df.columns)})')
        con.executemany(f'INSERT INTO "{table}" VALUES ({", ".join("?" * len(df.columns))})', (tuple(r) for r in df.toLocalIterator()))


def read_sql(spark: SparkSession, query: str, con: str, **options: str) -> DataFrame:
    """By URL: ``jdbc:`` and server URLs through JDBC (partitioned by the options given), else a SQLite file."""
    if con.startswith("jdbc:"):
        return spark.read.format("jdbc").options(url=con, query=query, **options).load()
    if "://" in con and not con.startswith("sqlite"):
        return spark.read.format("jdbc").options(url="jdbc:" + con, query=query, **options).load()
    return read_sqlite(spark, con.removeprefix("sqlite:///"), query)


def to_sql(df: DataFrame, table: str, con: str, if_exists: str = "replace", **options: str) -> None:
    if con.startswith("jdbc:") or ("://" in con and not con.startswith("sqlite")):
        df.write.format("jdbc").mode("overwrite" if if_exists == "replace" else "append").options(url=con if con.startswith("jdbc:") else "jdbc:" + con, dbtable=table, **options).save()
    else:
        write_sqlite(df, con.removeprefix("sqlite:///"), table, if_exists)


class Database:
    """Queries and tables of a session's catalog, or of a database behind a URL."""

    def __init__(self, spark: SparkSession, url: str | None = None, **options: str):
        self.spark, self.url, self.options = spark, url, options

    @classmethod
    def sqlite(cls, spark: SparkSession, path: str) -> Database:
        return cls(spark, f"sqlite:///{path}")

    @classmethod
    def postgres(cls, spark: SparkSession, host: str, database: str, **options: str) -> Database:
        return cls(spark, f"jdbc:postgresql://{host}/{database}", **options)

    @classmethod
    def mysql(cls, spark: SparkSession, host: str, database: str, **options: str) -> Database:
        return cls(spark, f"jdbc:mysql://{host}/{database}", **options)

    @classmethod
    def duckdb(cls, spark: SparkSession, path: str) -> Database:
        return cls(spark, f"jdbc:duckdb:{path}")

    def query(self, text: str) -> DataFrame:
        return read_sql(self.spark, text, self.url, **self.options) if self.url else self.spark.sql(text)

    def execute(self, text: str) -> None:
        if self.url and self.url.startswith("sqlite"):
            with sqlite3.connect(self.url.removeprefix("sqlite:///")) as con:
                con.executescript(text)
        else:
            self.spark.sql(text)

    def write(self, df: DataFrame, table: str, if_exists: str = "replace") -> None:
        if self.url:
            to_sql(df, table, self.url, if_exists, **self.options)
        else:
            df.write.mode("overwrite" if if_exists == "replace" else "append").saveAsTable(table)

    def tables(self) -> list[str]:
        if self.url and self.url.startswith("sqlite"):
            return [r[0] for r in self.query("SELECT name FROM sqlite_master WHERE type = 'table' ORDER BY name").collect()]
        if self.url:
            return [r[0] for r in self.query("SELECT table_name FROM information_schema.tables WHERE table_schema NOT IN ('information_schema', 'pg_catalog') ORDER BY 1").collect()]
        return sorted(t.name for t in self.spark.catalog.listTables())

    def close(self) -> None:
        """Nothing is held open."""
