"""Connected components of an edge table, by alternating large-star and small-star rounds.

Each round replaces every node's edges by edges to the least node it knows of;
a node's least neighbour comes from a partial aggregate, which is written and
joined back: a hub's edges meet one row of it, so a join that finds them too many
for a task can split them.  Each round is written to the shared folder, and the
loop ends when a round changes nothing.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from colframe.llm.common import gathered, remove, scratch


def _table(df: DataFrame, used: list[str], rows: int) -> DataFrame:
    path = scratch(df.sparkSession, "stars")
    gathered(df, rows).write.parquet(path)
    used.append(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _least(edges: DataFrame, used: list[str], rows: int) -> DataFrame:
    """Least of a node and its neighbours, by node."""
    return _table(edges.groupBy(F.col("a").alias("u")).agg(F.least(F.min("b"), F.first("a")).alias("m")), used, rows)


def _large_star(edges: DataFrame, used: list[str], rows: int) -> DataFrame:
    both = edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    joined = both.join(_least(both, used, rows), both.a == F.col("u"))
    return joined.filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).union(joined.filter("m < a").select("a", F.col("m").alias("b")))


def _small_star(edges: DataFrame, used: list[str], rows: int) -> DataFrame:
    down = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    joined = down.join(_least(down, used, rows), down.a == F.col("u"))
    return joined.filter("b != m").select(F.col("b").alias("a"), F.col("m").alias("b")).union(joined.select("a", F.col("m").alias("b")))


def components(edges: DataFrame) -> DataFrame:
    """``(node, root)`` for every node with an edge ``(a, b)``; root: the least node of its component.

    Repeated edges and loops are allowed; an edge with a NULL end is ignored.  ``edges`` is read several times.
    """
    spark = edges.sparkSession
    now = edges.filter("a is not null and b is not null and a != b").select("a", "b")
    seen, old, rows = None, [], 2 * now.count()
    while True:
        used: list[str] = []
        large = _table(_large_star(now, used, rows).distinct(), used, rows)
        now = _table(_small_star(large, used, rows).filter("a != b").distinct(), used, rows)
        mark = now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        for path in [*old, *used[:-1]]:
            remove(spark, path)
        if mark == seen:
            break
        seen, old = mark, used[-1:]
    return now.select(F.col("a").alias("node"), F.col("b").alias("root")).union(now.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
