"""Near copies by word shingles: documents whose shingle sets have a Jaccard similarity of 0.8 or more.

Method: SimHash, then an exact join for what it doesn't reach.  A text is the
set of the XXH64 of its shingles of ``SHINGLE`` lower-cased words, and has
operator 3's fingerprint, of shingles of ``PRINTED`` words.  Operator 3 links
fingerprints that differ in at most ``APART`` bits (pigeonhole blocks, popcount,
spanning forests); each link is checked on the two whole sets, and the checked
ones make the first components.

64 bits can't reach every similar pair, so the rest is found by an exact
set-similarity join by prefixes, in which pairs that SimHash has put in one
component are done and aren't compared again.  All sets are sorted by
one global order; two sets of similarity ``s`` share at least ``s`` of the
larger one, so the first ``n - ceil(s n) + 1`` shingles of each have one in
common.  Those prefixes are filed by shingle, sets that meet in a file and
whose sizes and places in it allow it become candidates, and every candidate is checked against
the two whole sets.  So nothing is missed and nothing is linked on an estimate.

Any global order is right; shingles that are frequent in a sample of the sets
come last in it, which keeps files short.  In a file of over ``LONG`` sets, each
is first paired with the file's first and with its next ones; then sets that
those edges left in different components are held against each other by a
sketch of ``SKETCH`` bits, the parities of their shingles' hashes.  Sketches
differ in no more bits than the sets differ in shingles, so only pairs whose
sketches are that close become candidates, and none that is similar is left
out.  So neither a group of near copies nor the documents that share a frequent
passage become pairs.

Defined cases: texts with fewer words than a shingle hash the whole sequence;
texts without words have the empty set and are one group; equal sets are one
node, named by a 64-bit hash of the set; sets are compared by 64-bit hashes of
their shingles.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from colframe.llm import simhash
from colframe.llm.common import fresh, map_columns, slices, to_arrow, written
from colframe.llm.components import components

SEED = 42
SHINGLE, PERCENT = 5, 80
#: Words of a fingerprint's shingles, and bits in which linked fingerprints differ at most.
PRINTED, APART = 2, 3
#: Sets of one file of which all pairs are candidates, and the next ones that each is paired with in longer files.
LONG, NEXT = 6, 1
#: One set in so many is counted to find frequent shingles; fewest sets there of a frequent one, and most frequent ones.
SAMPLE, OFTEN, MOST = 8, 2, 200_000
#: Candidates whose row hashes are sent to all tasks; more of them meet their texts in a shuffle.
SENT = 1_000_000
#: Bits of a sketch; a power of two.
SKETCH = 1024


def shingles(text: str | None, shingle: int = SHINGLE) -> np.ndarray:
    """The sorted distinct hashes of a text's shingles."""
    words = (text or "").encode().lower().split()
    if not words:
        return np.empty(0, np.uint64)
    width = min(shingle, len(words))
    n = len(words) - width + 1
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    spans = zip(starts[:n].tolist(), ends[width - 1 :].tolist())
    return np.unique(np.fromiter(map(xxhash.xxh64_intdigest, [joined[s:e] for s, e in spans], repeat(SEED)), np.uint64, n))


def _named(x: np.ndarray) -> int:
    return int(np.uint64(xxhash.xxh64_intdigest(x.tobytes(), SEED)).view(np.int64))


def sketch(x: np.ndarray) -> bytes:
    """For each of ``SKETCH`` classes of hashes whether a set has an odd number of it."""
    return np.packbits(np.bincount((x & np.uint64(SKETCH - 1)).astype(np.int64), minlength=SKETCH) & 1).tobytes()


def _sets(df: DataFrame, shingle: int) -> DataFrame:
    """``(node, hashes)``: the whole set of every row's ``text``."""

    def make():
        def step(batch):
            sets = [shingles(t.as_py(), shingle) for t in batch.column(0)]
            return {"node": [_named(x) for x in sets], "hashes": [x.tobytes() for x in sets]}

        return step

    return map_columns(df.select("text"), "node long, hashes binary", make)


def _mapped(df: DataFrame, schema: str, of, rows: int = 256) -> DataFrame:
    """``mapInArrow`` of a function from a batch to tuples of column arrays, which are put together."""
    target = to_arrow(df.sparkSession, schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, rows):
            parts = [x for x in of(batch) if len(x[0])]
            if parts:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c), f.type) for c, f in zip(zip(*parts), target)], schema=target)

    return df.mapInArrow(run, schema)


def _frequent(rows: DataFrame, shingle: int) -> np.ndarray:
    """Shingles that are in many of a sample of the sets, sorted; they only order prefixes."""

    def of(batch):
        return [(shingles(t.as_py(), shingle).view("<i8"),) for t in batch.column(0)]

    counted = _mapped(rows.filter(F.pmod("row1", F.lit(SAMPLE)) == 0).select("text"), "h long", of).groupBy("h").agg(F.count("*").alias("n"))
    top = counted.filter(F.col("n") >= OFTEN).orderBy(F.desc("n"), "h").limit(MOST)
    return np.sort(np.array([r.h for r in top.select("h").collect()], np.int64).view(np.uint64))


def _prefixes(rows: DataFrame, shingle: int, percent: int, frequent: np.ndarray) -> DataFrame:
    """``(doc_id, row1, row2, node, fp, n, prefix, sketch)`` for every row ``(doc_id, row1, row2, text)``; the prefix as bytes."""

    def prefix(x: np.ndarray) -> bytes:
        n = len(x)
        if n and len(frequent):
            at = np.minimum(np.searchsorted(frequent, x), len(frequent) - 1)
            x = x[np.argsort(frequent[at] == x, kind="stable")]
        return x[: n - -(-n * percent // 100) + 1 if n else 0].tobytes()

    def make():
        def step(batch):
            texts = batch.column(3).to_pylist()
            sets = [shingles(t, shingle) for t in texts]
            known = {k: batch.column(i) for i, k in enumerate(("doc_id", "row1", "row2"))}
            known |= {"fp": [simhash.fingerprint(t, PRINTED) for t in texts]}
            return known | {"node": [_named(x) for x in sets], "n": [len(x) for x in sets], "prefix": [prefix(x) for x in sets], "sketch": [sketch(x) for x in sets]}

        return step

    kind = rows.schema["doc_id"].dataType.simpleString()
    return map_columns(rows.select("doc_id", "row1", "row2", "text"), f"doc_id {kind}, row1 long, row2 long, node long, fp long, n int, prefix binary, sketch binary", make)


def _entries(docs: DataFrame) -> DataFrame:
    """``(key, node, n, at)`` for the shingles of every prefix; ``at`` is the place in the set's order."""

    def of(batch):
        for node, n, prefix in zip(*batch.columns):
            x = np.frombuffer(prefix.as_py(), "<i8")
            yield x, np.full(len(x), node.as_py(), np.int64), np.full(len(x), n.as_py(), np.int32), np.arange(len(x), dtype=np.int32)

    return _mapped(docs.select("node", "n", "prefix"), "key long, node long, n int, at int", of)


def _runs(change, schema: pa.Schema):
    """``mapInArrow`` over whole runs of equal first columns; ``change(columns, starts, sizes)`` gives columns."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[list[np.ndarray]] = []

        def flush(cols):
            if not len(cols[0]):
                return
            starts = np.flatnonzero(np.r_[True, cols[0][1:] != cols[0][:-1]])
            for out in change(cols, starts, np.diff(np.r_[starts, len(cols[0])])):
                if len(out[0]):
                    yield pa.RecordBatch.from_arrays([pa.nulls(len(out[0]), f.type) if c is None else pa.array(c, f.type) for c, f in zip(out, schema)], schema=schema)

        for batch in batches:
            cols = [c.to_numpy(zero_copy_only=False) for c in batch.columns]
            if not len(cols[0]):
                continue
            new = np.flatnonzero(np.r_[not held or held[-1][0][-1] != cols[0][0], cols[0][1:] != cols[0][:-1]])
            if not len(new):
                held.append(cols)
                continue
            done = [*held, [c[: new[-1]] for c in cols]]
            held = [[c[new[-1] :] for c in cols]]
            yield from flush([np.concatenate(c) for c in zip(*done)])
        if held:
            yield from flush([np.concatenate(c) for c in zip(*held)])

    return run


def _allowed(n: np.ndarray, at: np.ndarray, m: np.ndarray, to: np.ndarray, percent: int) -> np.ndarray:
    """Whether sets of sizes ``n`` and ``m`` can be that similar if what they share starts at these places of theirs.

    What similar sets share first passes, so each such pair passes in one of its files.
    """
    n, m = n.astype(np.int64), np.asarray(m, np.int64)
    return (100 + percent) * np.minimum(n - at, m - to) >= percent * (n + m)


def _pairs(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return np.minimum(a, b), np.maximum(a, b)


def _met(entries: DataFrame, percent: int) -> DataFrame:
    """``(a, b, NULL, NULL, NULL)`` for candidates, and ``(NULL, node, key, n, at)`` for the sets of long files."""

    def change(cols, starts, sizes):
        same = np.r_[False, (cols[0][1:] == cols[0][:-1]) & (cols[1][1:] == cols[1][:-1])]
        if same.any():  # copies of one set
            cols = [c[~same] for c in cols]
            starts = np.flatnonzero(np.r_[True, cols[0][1:] != cols[0][:-1]])
            sizes = np.diff(np.r_[starts, len(cols[0])])
        key, node, n, at = cols
        left = np.repeat(sizes, sizes) - (np.arange(len(key)) - np.repeat(starts, sizes))
        long = np.repeat(sizes > LONG, sizes)
        for d in range(1, LONG):
            i = np.flatnonzero((left > d) & (~long | (d <= NEXT)))
            if not len(i):
                break
            i = i[_allowed(n[i], at[i], n[i + d], at[i + d], percent)]
            yield *_pairs(node[i], node[i + d]), None, None, None
        if long.any():
            i, first = np.flatnonzero(long), np.repeat(starts, sizes)[long]
            yield pa.nulls(len(i), pa.int64()), node[i], key[i], n[i], at[i]
            ok = (i != first) & _allowed(n[i], at[i], n[first], at[first], percent)
            yield *_pairs(node[i[ok]], node[first[ok]]), None, None, None

    schema = "a long, b long, key long, n int, at int"
    parts = int(entries.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return entries.repartition(parts, "key").sortWithinPartitions("key", "node").mapInArrow(_runs(change, to_arrow(entries.sparkSession, schema)), schema)


def _unlinked(files: DataFrame, percent: int) -> DataFrame:
    """Candidates ``(a, b)`` with different labels in one file, of ``files (key, label, node, n, at, sketch)``."""

    def change(cols, starts, sizes):
        _, label, node, n, at, sketches = cols
        for s, size in zip(starts.tolist(), sizes.tolist()):
            ends = s + np.flatnonzero(np.r_[label[s + 1 : s + size] != label[s : s + size - 1], True]) + 1
            if len(ends) == 1:
                continue
            bits = np.frombuffer(b"".join(sketches[s : s + size]), np.uint64).reshape(size, -1)
            a, b, held = [], [], 0
            for i in range(s, s + size):
                j = np.arange(ends[np.searchsorted(ends, i, "right")], s + size)
                j = j[_allowed(n[i], at[i], n[j], at[j], percent)]
                apart = np.bitwise_count(bits[i - s] ^ bits[j - s]).sum(1, dtype=np.int64)
                j = j[(100 + percent) * apart <= (100 - percent) * (n[j].astype(np.int64) + int(n[i]))]
                a.append(np.full(len(j), node[i]))
                b.append(node[j])
                held += len(j)
                if held > 1 << 16:
                    yield _pairs(np.concatenate(a), np.concatenate(b))
                    a, b, held = [], [], 0
            if a:
                yield _pairs(np.concatenate(a), np.concatenate(b))

    parts = int(files.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    schema = "a long, b long"
    return files.repartition(parts, "key").sortWithinPartitions("key", "label", "node").mapInArrow(_runs(change, to_arrow(files.sparkSession, schema)), schema)


def _similar(pairs: DataFrame, whole: Callable[[DataFrame], DataFrame], percent: int, rows: int) -> DataFrame:
    """The pairs ``(a, b)`` whose whole sets are that similar."""

    def of(batch):
        a, b, x, y = batch.columns
        for i in range(batch.num_rows):
            p, q = np.frombuffer(x[i].as_py(), "<u8"), np.frombuffer(y[i].as_py(), "<u8")
            both = len(np.intersect1d(p, q, assume_unique=True))
            ok = 100 * both >= percent * (len(p) + len(q) - both)
            yield np.array([a[i].as_py()] * ok, np.int64), np.array([b[i].as_py()] * ok, np.int64)

    pairs = written(pairs.distinct(), "pairs", rows)
    held = written(whole(pairs.select(F.col("a").alias("node")).union(pairs.select(F.col("b").alias("node"))).distinct()), "held")
    one = held.select(F.col("node").alias("a"), F.col("hashes").alias("x"))
    two = held.select(F.col("node").alias("b"), F.col("hashes").alias("y"))
    return _mapped(pairs.join(one, "a").join(two, "b").select("a", "b", "x", "y"), "a long, b long", of)


def _near(docs: DataFrame, count: int) -> DataFrame:
    """Candidates ``(a, b)`` of SimHash among ``docs (node, fp)``: sets of one fingerprint, and of linked ones.

    A fingerprint stands for its least set, to which its others are paired.
    """
    prints = written(docs.select("node", "fp").distinct(), "fingerprints", count)
    least = written(prints.groupBy("fp").agg(F.min("node").alias("least")), "least", count)
    met = written(simhash.links(prints, APART), "linked", 2 * count)
    one, two = (least.select(F.col("fp").alias(c), F.col("least").alias(f"_{c}")) for c in "ab")
    pairs = met.join(one, "a").join(two, "b").select(F.col("_a").alias("a"), F.col("_b").alias("b"))
    pairs = pairs.union(prints.join(least, "fp").select("least", "node")).filter("a != b")
    return pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))


def _apart(pairs: DataFrame, roots: DataFrame) -> DataFrame:
    """The pairs ``(a, b)`` that aren't in one component yet."""
    one, two = (roots.select(F.col("node").alias(c), F.col("root").alias(f"_{c}")) for c in "ab")
    return pairs.distinct().join(one, "a", "left").join(two, "b", "left").filter("_a is null or _b is null or _a != _b").select("a", "b")


def links(docs: DataFrame, whole: Callable[[DataFrame], DataFrame], percent: int = PERCENT) -> DataFrame:
    """Edges ``(a, b)`` whose components are those of all pairs of sets that similar.

    ``docs (node, fp, n, prefix, sketch)`` may repeat sets; ``whole`` gives ``(node, hashes)`` for a table of nodes.
    """
    count = docs.count()
    near = written(_similar(_near(docs, count), whole, percent, 3 * count), "near")
    found = written(_met(_entries(docs), percent), "met")
    rows = found.count()
    rest = _apart(found.filter("key is null").select("a", "b"), components(near))
    edges = written(near.union(_similar(rest, whole, percent, rows)), "edges")
    files = found.filter("key is not null").select("key", F.col("b").alias("node"), "n", "at")
    if files.isEmpty():
        return edges
    sketches = docs.join(files.select("node").distinct(), "node", "left_semi").groupBy("node").agg(F.min("sketch").alias("sketch"))
    labelled = files.join(components(edges), "node", "left").join(sketches, "node").select("key", F.coalesce("root", "node").alias("label"), "node", "n", "at", "sketch")
    return edges.union(written(_similar(written(_unlinked(labelled, percent), "unlinked", rows), whole, percent, rows), "edges"))


def keep_one(df: DataFrame, shingle: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """The rows of ``df`` without near copies: of each component the row with the least id, ties by a hash of the row.

    NULL ids come last; of wholly equal rows one stays.
    """
    one, two = fresh(df, "_row1"), fresh(df, "_row2")
    keyed = df.withColumns({one: F.xxhash64(*df.columns), two: F.xxhash64(F.lit(1), *df.columns)})
    rows = keyed.select("doc_id", F.col(one).alias("row1"), F.col(two).alias("row2"), "text")
    docs = written(_prefixes(rows, shingle, percent, _frequent(rows, shingle)), "prefixes")
    nodes = written(docs.groupBy("node").agg(F.min(F.struct(F.col("doc_id").isNull().alias("no"), "doc_id", "row1", "row2")).alias("x")), "nodes", docs.count())
    again = not docs.groupBy("row1", "row2").count().filter("count > 1").isEmpty()

    def whole(wanted: DataFrame) -> DataFrame:
        """Sets again from the text of one row each: few are candidates, and all of them are larger than the texts."""
        at = written(nodes.join(wanted, "node").select("x.row1", "x.row2"), "wanted", nodes.count())
        at = F.broadcast(at) if at.count() <= SENT else at
        sets = _sets(rows.join(at, ["row1", "row2"], "left_semi"), shingle)
        return sets.dropDuplicates(["node"]) if again else sets

    roots = components(links(docs, whole, percent))
    kept = nodes.join(roots, "node", "left").groupBy(F.coalesce("root", "node").alias("root")).agg(F.min("x").alias("x"))
    kept = kept.select(F.col("x.row1").alias(one), F.col("x.row2").alias(two))
    nth = fresh(df, "_nth")
    same = F.row_number().over(Window.partitionBy(one, two).orderBy(one))
    return keyed.join(kept, [one, two], "left_semi").withColumn(nth, same).filter(F.col(nth) == 1).select(*df.columns)
