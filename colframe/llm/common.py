"""What the operators of this subpackage share: scratch space, word patterns, Arrow maps."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from colframe.shipping import ship

#: White space as the word pattern ``[^\x20\x09-\x0D]+`` sees it.
BLANKS = " \t\n\x0b\x0c\r"
#: The same class inside a Java regular expression.
BLANK_CLASS = r"[\x20\x09-\x0D]"


_made: dict[str, list[str]] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors see: ``spark.checkpoint.dir``; a temporary one only where it is unset and the master is local."""
    there = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not there:
        master = spark.sparkContext.master
        if not (master == "local" or master.startswith("local[")):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        there = "file://" + tempfile.mkdtemp(prefix="colframe-")
        spark.sparkContext.setCheckpointDir(there)
    return there.rstrip("/")


def scratch(spark: SparkSession, name: str) -> str:
    """A new path under the shared folder."""
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    _made.setdefault(spark.sparkContext.applicationId, []).append(path)
    return path


def discard(spark: SparkSession) -> int:
    """Deletes all that this application's operators have written to the shared folder, when their results are read or written elsewhere."""
    paths = _made.pop(spark.sparkContext.applicationId, [])
    for path in paths:
        remove(spark, path)
    return len(paths)


def remove(spark: SparkSession, path: str) -> None:
    """Deletes a scratch path on whatever file system holds it."""
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def fresh(df: DataFrame, name: str) -> str:
    """``name``, with underscores added until no column of ``df`` has it."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def written(df: DataFrame, name: str, rows: int | None = None) -> DataFrame:
    """``df`` as a Parquet table in the shared folder, read again: smaller than a checkpoint.  ``rows``: a bound of its rows."""
    path = scratch(df.sparkSession, name)
    df = df if rows is None else gathered(df, rows)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


#: Rows that a partition of an intermediate table holds at least, where a bound of its rows is known.
LEAST_ROWS = 250_000


def gathered(df: DataFrame, rows: int) -> DataFrame:
    """``df`` in no more partitions than ``rows``, a bound of its rows, are worth: many empty ones would be as many files."""
    most = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    parts = rows // LEAST_ROWS + 1
    return df.coalesce(parts) if parts < most else df


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def words_of(text: Column) -> Column:
    """Words ``[^\\x20\\x09-\\x0D]+`` of a text, in order; none for NULL."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), BLANK_CLASS + "+"), "")


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with ``value`` computed once a row, also where ``use`` names it inside lambdas."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def map_columns(df: DataFrame, schema: str, make: Callable[[], Callable[[pa.RecordBatch], dict]]) -> DataFrame:
    """``mapInArrow``: ``make()`` runs once a task and returns the function from a batch to columns."""
    target = to_arrow(df.sparkSession, schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        step = make()
        for batch in slices(batches, 1024):
            if batch.num_rows:
                columns = step(batch)
                yield pa.RecordBatch.from_arrays([pa.array(columns[f.name], type=f.type) for f in target], schema=target)

    return df.mapInArrow(run, schema)


def to_arrow(spark: SparkSession, schema: str) -> pa.Schema:
    """The Arrow form of a DDL schema, for functions that run in Python workers."""
    ship(spark)
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    return to_arrow_schema(StructType.fromDDL(schema))


def slices(batches: Iterator[pa.RecordBatch], rows: int = 256) -> Iterator[pa.RecordBatch]:
    """Batches in pieces of a few rows, so that only these become Python objects at once."""
    for batch in batches:
        for lo in range(0, batch.num_rows, rows):
            yield batch.slice(lo, rows)
