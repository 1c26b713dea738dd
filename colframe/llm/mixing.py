"""Operator 10: mixing sources to target weights.

Method: a source's words, document after document, are packed into blocks of
``BLOCK`` words (the last may be shorter).  Every source gets a quota of blocks
from its target.  A source's counts in the output shards are drawn from a
multinomial with equal chances for all shards, so that each shard's counts of
the sources follow the mix (given its size, they are a draw from the quotas) and
the quotas are met exactly.  That is drawn in two steps, for groups of shards and
within them, each from a generator of its own.  A source's slots are numbered
over the shards; slot ``i`` takes the block ``perm(i mod n)`` in round ``i div
n``, by a pseudorandom permutation of the source's ``n`` block numbers (a
Feistel network with cycle walking, one key for each source and round).  Slots
and blocks then meet in a join by source and block number.

Within a source, documents stand in the order of (bucket, doc_id), where
buckets are hashes of the row: positions are running sums within buckets plus
the sums of the buckets before, so a source with a third of all rows is spread
over many tasks.  Everything depends on the rows and the seed alone.

Sources are a table (``plan``), numbered in blocks of their order; on the driver
are sums over them.  The plan is sent to all tasks while it has ``SMALL`` rows
at most, and meets the rows in a shuffle beyond that.  Words are counted once
and their numbers written.

Defined cases: NULL text: size 0; documents of size 0 take nothing; very long
texts are cut into as many blocks as they have; a NULL source is a source, the
last in order; repeated rows are separate documents; rows of one source and
bucket with equal ids are ordered by a hash of the row; an empty table gives an
empty table; other columns are kept by ``mixed``, and their names don't matter.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from colframe.llm.common import documents, let, to_arrow, words_of, written
from colframe.operators.ordering import with_row_index

#: Words in a block.
BLOCK = 128
SEED = 7
#: Most times that a source's words may be taken.
REPEATS = 3
#: Weights of the sources in order, repeating.
WEIGHTS = (1, 2, 3)
#: Blocks of an output shard, on average.
SHARD_BLOCKS = 4096
#: Sources whose plan (a row each) may be sent to all tasks; more meet the rows in a shuffle.
SMALL = 10_000
#: Rows of a source that one bucket holds on average.
BUCKET_ROWS = 4000


def generator(*key: object) -> np.random.Generator:
    return np.random.Generator(np.random.PCG64(xxhash.xxh64_intdigest("\0".join(map(repr, key)))))


def shares(count: int, parts: int, *key: object) -> np.ndarray:
    """A multinomial draw of ``count`` over ``parts`` with equal chances."""
    return generator(*key).multinomial(count, np.full(parts, 1 / parts))


def permuted(i: np.ndarray, n: int, key: int) -> np.ndarray:
    """The pseudorandom permutation of ``range(n)`` with this key, at the positions ``i``."""
    half = max(1, (max(n - 1, 1).bit_length() + 1) // 2)
    low = np.uint64((1 << half) - 1)
    x = i.astype(np.uint64)
    todo = np.ones(len(x), bool)
    while todo.any():
        a, b = x[todo] >> np.uint64(half), x[todo] & low
        for r in range(4):
            z = (b + np.uint64((key + 0x9E3779B97F4A7C15 * (r + 1)) & 0xFFFFFFFFFFFFFFFF)) * np.uint64(0xBF58476D1CE4E5B9)
            z = (z ^ (z >> np.uint64(29))) * np.uint64(0x94D049BB133111EB)
            a, b = b, a ^ ((z >> np.uint64(32)) & low)
        x[todo] = a << np.uint64(half) | b
        todo &= x >= n
    return x.astype(np.int64)


def key_of(source: str | None, turn: int, seed: int = SEED) -> int:
    return xxhash.xxh64_intdigest(f"{turn}:{'' if source is None else '=' + source}", seed)


class Mix:
    """A plan for one table: its sources' quotas, and the tables of positions, blocks and slots."""

    def __init__(self, df: DataFrame, block: int = BLOCK, seed: int = SEED, weights: tuple[int, ...] = WEIGHTS, repeats: int = REPEATS):
        self.df, self.block, self.seed = df, block, seed
        self.spark = df.sparkSession
        self.sizes = written(self._measured(), "sizes")
        sources = self.sizes.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("rows"))
        sources = with_row_index(sources, "source", "sid", nulls_largest=True)
        weight = F.get(F.array(*(F.lit(w).cast("long") for w in weights)), (F.col("sid") % len(weights)).cast("int"))
        count = self.sizes.count()
        sources = written(sources.withColumn("weight", weight), "sources", count // 100)
        full = F.lit(repeats) * F.col("source_size")
        total = sources.agg(F.sum("source_size")).first()[0] or 0
        over, share, before = F.lit(False), F.lit(0.0), -1
        while True:  # what sources over their most leave is shared again by the others, until none is over
            n, taken, open_ = sources.agg(F.count_if(over), F.sum(F.when(over, full).otherwise(0)), F.sum(F.when(over, 0).otherwise(F.col("weight")))).first()
            if n == before or not open_:
                break
            before, share = n, F.lit(total - taken) * F.col("weight") / F.lit(open_)
            over = share > full
        n = F.ceil(F.col("source_size") / block)
        target = F.when(over, full.cast("double")).otherwise(share)
        quota = F.when(F.col("source_size") > 0, F.least(repeats * n, F.rint(target * n / F.col("source_size")).cast("long"))).otherwise(0)
        plan = sources.select("sid", "source", "source_size", target.alias("target"), F.greatest(F.lit(1), F.col("rows") / BUCKET_ROWS).cast("long").alias("buckets"), n.cast("long").alias("n"), quota.cast("long").alias("quota"))
        self.plan = written(plan, "plan", count // 100)
        self.small = self.plan.count() <= SMALL

    def _plan(self, *columns: str) -> DataFrame:
        plan = self.plan.withColumnRenamed("source", "_source").select(*columns)
        return F.broadcast(plan) if self.small else plan.hint("shuffle_merge")

    def _measured(self, *carried: str) -> DataFrame:
        df = self.df
        size = F.size(words_of(F.col("text"))).cast("long").alias("size")
        return df.select("doc_id", "source", size, F.xxhash64(*df.columns).alias("hash"), F.struct(*carried).alias("row") if carried else F.lit(None).cast("int").alias("row"))

    def positions(self, *carried: str) -> DataFrame:
        """Every row: ``sid``, ``start`` (its first word's position in the source), ``size``, ``at`` (unique), and the columns named."""
        rows = (self._measured(*carried) if carried else self.sizes).withColumnRenamed("source", "_src")
        rows = rows.join(self._plan("sid", "_source", "buckets"), F.col("_src").eqNullSafe(F.col("_source"))).withColumn("bucket", F.pmod("hash", "buckets")).drop("_src", "_source", "buckets")
        here = Window.partitionBy("sid", "bucket").orderBy("doc_id", "hash")
        local = rows.withColumns({"end": F.sum("size").over(here.rowsBetween(Window.unboundedPreceding, 0)), "nth": F.row_number().over(here)})
        before = Window.partitionBy("sid").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
        small = self.sizes.withColumnRenamed("source", "_src").join(self._plan("sid", "_source", "buckets"), F.col("_src").eqNullSafe(F.col("_source"))).withColumn("bucket", F.pmod("hash", "buckets"))
        sums = small.groupBy("sid", "bucket").agg(F.sum("size").alias("sum")).withColumn("base", F.coalesce(F.sum("sum").over(before), F.lit(0))).select("sid", "bucket", "base")
        return local.join(sums.hint("shuffle_merge"), ["sid", "bucket"]).select("sid", F.struct("bucket", "nth").alias("at"), "doc_id", (F.col("base") + F.col("end") - F.col("size")).alias("start"), "size", "row")

    def segments(self) -> DataFrame:
        """The words of each document in each block: ``sid, at, doc_id, block, first`` (word of the document), ``words``."""
        b = self.block
        each = self.positions().filter("size > 0").select("sid", "at", "doc_id", "start", "size", F.explode(F.expr(f"sequence(start div {b}, (start + size - 1) div {b})")).alias("block"))
        first = F.greatest(F.col("block") * b - F.col("start"), F.lit(0))
        last = F.least((F.col("block") + 1) * b - F.col("start"), F.col("size"))
        return each.select("sid", "at", "doc_id", "block", first.alias("first"), (last - first).alias("words"))

    def slots(self) -> DataFrame:
        """The output: ``shard, place`` (within the source's part of the shard), ``sid, block, turn``."""
        spark, seed = self.spark, self.seed
        total = self.plan.agg(F.sum("quota")).first()[0] or 0
        shards = max(1, -(-total // SHARD_BLOCKS))
        groups = int(np.ceil(np.sqrt(shards)))
        each = -(-shards // groups)
        shards = groups * each
        grouped = "sid long, source string, n long, part int, first long, count long"
        schema = "shard long, place long, sid long, block long, turn int"
        of_group, target = to_arrow(spark, grouped), to_arrow(spark, schema)

        def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for row in (r for b in batches for r in b.to_pylist()):
                counts = shares(row["quota"], groups, seed, row["source"])
                first, part = np.cumsum(counts) - counts, np.flatnonzero(counts)
                same = lambda v, f: pa.array([v] * len(part), f.type)
                yield pa.RecordBatch.from_arrays([*(same(row[f.name], f) for f in list(of_group)[:3]), pa.array(part.astype(np.int32)), pa.array(first[part]), pa.array(counts[part])], schema=of_group)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for row in (r for b in batches for r in b.to_pylist()):
                counts = shares(row["count"], each, seed, row["source"], row["part"])
                ends = np.cumsum(counts)
                for lo in range(0, row["count"], 65536):
                    at = np.arange(lo, min(lo + 65536, row["count"]))
                    shard = np.searchsorted(ends, at, "right")
                    slot = at + row["first"]
                    turn, block = slot // row["n"], slot % row["n"]
                    for t in np.unique(turn).tolist():
                        block[turn == t] = permuted(block[turn == t], row["n"], key_of(row["source"], t, seed))
                    yield pa.RecordBatch.from_arrays([pa.array(shard + row["part"] * each), pa.array(at - (ends - counts)[shard]), pa.array(np.full(len(at), row["sid"])), pa.array(block), pa.array(turn.astype(np.int32))], schema=target)

        parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
        drawn = self.plan.filter("quota > 0").select("sid", "source", "n", "quota").mapInArrow(split, grouped)
        return drawn.repartition(parts, "sid", "part").mapInArrow(run, schema)

    def packed(self) -> DataFrame:
        """The shards' contents by reference: ``shard, sid, place, turn, doc_id, first, words``."""
        return self.slots().join(self.segments().hint("shuffle_merge"), ["sid", "block"]).select("shard", "sid", "place", "turn", "doc_id", "first", "words")

    def taken(self) -> DataFrame:
        """``(doc_id, size, source_size, target, taken)`` for every row of the table."""
        times = self.slots().groupBy("sid", "block").agg(F.count("*").alias("times"))
        words = self.segments().join(times.hint("shuffle_merge"), ["sid", "block"]).groupBy("sid", "at").agg(F.sum(F.col("times") * F.col("words")).alias("taken"))
        rows = self.positions().join(words.hint("shuffle_merge"), ["sid", "at"], "left")
        return rows.join(self._plan("sid", "source_size", "target"), "sid").select("doc_id", "size", "source_size", "target", F.coalesce("taken", F.lit(0)).cast("long").alias("taken"))

    def mixed(self) -> DataFrame:
        """The mix in the columns of the table: a row for each document and round, with the words taken then.

        A document that a round takes whole keeps its text as it is; of another the words taken stay, in
        order, joined by spaces.  ``n_chars``, where there is one, is the new text's length.
        """
        df = self.df
        parts = self.slots().select("sid", "block", "turn").join(self.segments().hint("shuffle_merge"), ["sid", "block"])
        parts = parts.groupBy("sid", "at", "turn").agg(F.sum("words").alias("sum"), F.sort_array(F.collect_list(F.struct("first", "words"))).alias("parts"))
        rows = self.positions(*df.columns).filter("size > 0").join(parts.hint("shuffle_merge"), ["sid", "at"])
        pieces = let(words_of(F.col("row.text")), lambda w: F.transform("parts", lambda p: F.slice(w, p["first"].cast("int") + 1, p["words"].cast("int"))))
        text = F.when(F.col("sum") == F.col("size"), F.col("row.text")).otherwise(F.array_join(F.flatten(pieces), " "))
        rows = rows.select(*(F.col(f"row.`{c}`").alias(c) for c in df.columns if c != "text"), text.alias("text"))
        if "n_chars" in df.columns:
            rows = rows.withColumn("n_chars", F.length("text").cast(df.schema["n_chars"].dataType))
        return rows.select(*df.columns)


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All of ``documents``: how many of its words the mix takes from each."""
    return Mix(documents(spark, sf_dir)).taken()
