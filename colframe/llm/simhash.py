"""Operator 3: SimHash near-duplicates by pigeonhole blocks.

Method: a text's 64-bit fingerprint is the bitwise majority of the XXH64 of
its word shingles.  Fingerprints are cut into ``n`` blocks; two that differ in
at most ``d`` bits agree on at least ``n - d`` blocks, so each fingerprint is
filed under every choice of ``n - d`` blocks, and only those filed together
are compared, by popcount.  ``n`` grows with the number of distinct
fingerprints, so that chance meetings stay few; the result does not depend on
it.

A file with many fingerprints (near copies of one text) is not compared as a
whole: its members are filed again by the bits that the first choice left
free, cut in groups of about four, which bounds each new file by 2^13
distinct fingerprints whatever the group's size.  Files emit the edges of a
spanning forest, never all pairs.

Defined cases: NULL or blank texts have fingerprint zero and are linked like
any other; texts with fewer words than a shingle hash the whole sequence;
equal texts share a fingerprint and are one node; texts of any length are
hashed whole, with 8 bytes for each shingle; a NULL ``doc_id`` never
becomes a component's id (NULL only if the component has no other); repeated
rows stay; an empty table gives an empty table; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations, repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from colframe.llm.common import documents, fresh, map_columns, to_arrow, written
from colframe.llm.components import components

BITS = 64
SEED = 42
#: Distinct fingerprints of one file that a task compares directly.
DENSE = 4096


def fingerprint(text: str | None, shingle: int = 3) -> int:
    """The fingerprint of one text, as a signed 64-bit number."""
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    width = min(shingle, len(words))
    spans = zip(starts[: len(words) - width + 1].tolist(), ends[width - 1 :].tolist())
    n = len(words) - width + 1
    hashes = np.fromiter(map(xxhash.xxh64_intdigest, [joined[s:e] for s, e in spans], repeat(SEED)), "<u8", n)
    counts = np.zeros(BITS, np.int64)
    for i in range(0, n, 16384):
        counts += np.unpackbits(hashes[i : i + 16384].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * counts > n, bitorder="little").view("<i8")[0])


def fingerprints(df: DataFrame, shingle: int = 3, keys: tuple[str, ...] = ("doc_id",), text: str = "text") -> DataFrame:
    """``(keys, fp long)`` for every row."""

    def make():
        return lambda batch: {k: batch.column(i) for i, k in enumerate(keys)} | {"fp": [fingerprint(t.as_py(), shingle) for t in batch.column(len(keys))]}

    kinds = ", ".join(f"`{k}` {df.schema[k].dataType.simpleString()}" for k in keys)
    return map_columns(df.select(*keys, text), f"{kinds}, fp long", make)


def _cut(bits: list[int], n: int) -> list[list[int]]:
    return [list(x) for x in np.array_split(bits, n)]


def _mask(bits) -> int:
    return int(np.array([sum(1 << int(b) for b in bits)], "<u8").view("<i8")[0])


def scheme(count: int, distance: int) -> int:
    """Blocks to cut fingerprints into, so that ``count`` random ones rarely meet by chance."""
    return next((n for n in range(distance + 3, distance + 9) if count < 1 << (BITS * (n - distance) // n)), distance + 9)


def _forest(x: np.ndarray, distance: int) -> tuple[np.ndarray, np.ndarray]:
    """Edges that join what is linked among these fingerprints: each to the first of its component."""
    label = np.arange(len(x))
    for i in range(len(x) - 1):
        near = np.flatnonzero(np.bitwise_count(x[i] ^ x[i + 1 :]) <= distance) + i + 1
        if len(near):
            met = np.unique(np.append(label[near], label[i]))
            if len(met) > 1:
                label[np.isin(label, met[1:])] = met[0]
    at = np.flatnonzero(label != np.arange(len(x)))
    return x[label[at]], x[at]


def _scan(distance: int, dense: int, schema: pa.Schema):
    """Compares runs of rows ``(part, key, fp)`` in order; rows of runs over ``dense`` go on as ``(part, fp)``."""

    def compared(part: np.ndarray, key: np.ndarray, fp: np.ndarray) -> pa.RecordBatch | None:
        starts = np.flatnonzero(np.r_[True, (part[1:] != part[:-1]) | (key[1:] != key[:-1])])
        sizes = np.diff(np.r_[starts, len(fp)])
        a, b = [], []
        small = np.repeat(np.where(sizes <= 24, sizes, 0), sizes) - (np.arange(len(fp)) - np.repeat(starts, sizes))
        for d in range(1, 24):
            i = np.flatnonzero(small > d)
            if not len(i):
                break
            i = i[np.bitwise_count(fp[i] ^ fp[i + d]) <= distance]
            a.append(fp[i])
            b.append(fp[i + d])
        for s, n in zip(starts[sizes > 24].tolist(), sizes[sizes > 24].tolist()):
            x, y = _forest(fp[s : s + n], distance)
            a.append(x)
            b.append(y)
        return packed(np.concatenate(a).view("<i8"), np.concatenate(b).view("<i8"), None) if a else None

    def packed(a, b, part) -> pa.RecordBatch:
        n = len(a)
        none = pa.nulls(n, pa.int64())
        return pa.RecordBatch.from_arrays([pa.array(a), none if b is None else pa.array(b), pa.nulls(n, pa.int32()) if part is None else pa.array(part)], schema=schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = (np.empty(0, np.int32), np.empty(0, np.int64), np.empty(0, np.uint64))
        hot = None
        for batch in batches:
            cols = tuple(c.to_numpy(zero_copy_only=False) for c in batch.columns)
            part, key, fp = (np.concatenate((h, c)) for h, c in zip(held, (cols[0], cols[1], cols[2].view("<u8"))))
            if hot:
                n = int(np.argmin((part == hot[0]) & (key == hot[1]))) if not ((part == hot[0]) & (key == hot[1])).all() else len(part)
                if n:
                    yield packed(fp[:n].view("<i8"), None, part[:n])
                part, key, fp = part[n:], key[n:], fp[n:]
                if not len(part):
                    held = (part, key, fp)
                    continue
                hot = None
            new = np.flatnonzero(np.r_[True, (part[1:] != part[:-1]) | (key[1:] != key[:-1])])
            ends = np.r_[new[1:], len(part)]
            over = ends - new > dense
            keep = np.repeat(~over, ends - new)
            keep[new[-1] :] = False
            if keep.any() and (found := compared(part[keep], key[keep], fp[keep])) is not None and found.num_rows:
                yield found
            for s, e in zip(new[over].tolist(), ends[over].tolist()):
                yield packed(fp[s:e].view("<i8"), None, part[s:e])
            if over[-1]:
                hot = (part[-1], key[-1])
                held = (part[:0], key[:0], fp[:0])
            else:
                held = (part[new[-1] :], key[new[-1] :], fp[new[-1] :])
        if len(held[0]) > 1 and (found := compared(*held)) is not None and found.num_rows:
            yield found

    return run


def _filed(rows: DataFrame, distance: int, dense: int) -> DataFrame:
    """Scans ``rows (part, key, fp)`` by file; ``(a, b, NULL)`` edges and ``(fp, NULL, part)`` of dense files."""
    schema = "a long, b long, part int"
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return rows.repartition(parts, "part", "key").sortWithinPartitions("part", "key", "fp").mapInArrow(_scan(distance, dense, to_arrow(rows.sparkSession, schema)), schema)


def links(fps: DataFrame, distance: int = 3, dense: int = DENSE, blocks: int | None = None) -> DataFrame:
    """Edges ``(a, b)`` whose components are those of all pairs of distinct ``fp`` within ``distance`` bits."""
    fps = fps.filter("fp is not null").select("fp").distinct()
    cuts = _cut(list(range(BITS)), blocks or scheme(fps.count(), distance))
    kept = [[b for block in c for b in block] for c in combinations(cuts, len(cuts) - distance)]
    first = F.explode(F.array(*(F.struct(F.lit(i).alias("part"), F.col("fp").bitwiseAND(F.lit(_mask(bits)).cast("long")).alias("key")) for i, bits in enumerate(kept))))
    found = written(_filed(fps.select("fp", first.alias("x")).select("x.part", "x.key", "fp"), distance, dense), "files")
    edges = found.filter("part is null").select("a", "b")
    if found.filter("part is not null").isEmpty():
        return edges.distinct()
    hot = found.filter("part is not null").select("part", F.col("a").alias("fp"))
    finer = []
    for bits in kept:
        groups = _cut([b for b in range(BITS) if b not in set(bits)], 8)
        finer.append(F.array(*(F.lit(_mask([*bits, *(b for g in c for b in g)])).cast("long") for c in combinations(groups, 8 - distance))))
    hot = hot.select("part", "fp", F.posexplode(F.get(F.array(*finer), F.col("part"))).alias("sub", "mask"))
    again = hot.select((F.col("part") * 1000 + F.col("sub")).cast("int").alias("part"), F.col("fp").bitwiseAND(F.col("mask")).alias("key"), "fp")
    return edges.union(_filed(again, distance, 1 << BITS // 2).select("a", "b")).distinct()


def linked(docs: DataFrame, distance: int = 3) -> DataFrame:
    """``docs (doc_id, fp, ..)``, which is read several times, with ``root`` and ``component_id``.

    ``root`` names the component by a fingerprint, also where all its ids are NULL.
    """
    count = docs.count()
    found = components(written(links(docs, distance), "edges", 2 * count))
    nodes = docs.groupBy("fp").agg(F.min("doc_id").alias("least")).join(found.withColumnRenamed("node", "fp"), "fp", "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    nodes = written(nodes, "nodes", count)
    named = written(nodes.groupBy("root").agg(F.min("least").alias("component_id")), "roots", count)
    # a table joined to a table: copies of one text, however many, can be split over tasks
    return docs.join(written(nodes.select("fp", "root").join(named, "root"), "components", count), "fp")


def keep_one(df: DataFrame, shingle: int = 3, distance: int = 3) -> DataFrame:
    """The rows of ``df`` without near copies: of each component the row with the least id, ties by a hash of the row.

    NULL ids come last; of wholly equal rows one stays.
    """
    one, two = fresh(df, "_row1"), fresh(df, "_row2")
    keyed = df.withColumns({one: F.xxhash64(*df.columns), two: F.xxhash64(F.lit(1), *df.columns)})
    docs = written(fingerprints(keyed.select("doc_id", F.col(one).alias("row1"), F.col(two).alias("row2"), "text"), shingle, ("doc_id", "row1", "row2")), "fingerprints")
    first = linked(docs, distance).groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNull().alias("no"), "doc_id", "row1", "row2")).alias("x"))
    first = first.select(F.col("x.row1").alias(one), F.col("x.row2").alias(two))
    nth = fresh(df, "_nth")
    same = F.row_number().over(Window.partitionBy(one, two).orderBy(one))
    return keyed.join(first, [one, two], "left_semi").withColumn(nth, same).filter(F.col(nth) == 1).select(*df.columns)


def op3_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every whole text of ``documents``: its fingerprint and the least id it is linked to."""
    found = linked(written(fingerprints(documents(spark, sf_dir)), "fingerprints"))
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
