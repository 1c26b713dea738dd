"""Operator 1: I-Match document fingerprints with randomised lexicons.

Method: terms are the distinct lower-cased words of a text without outer
punctuation.  The lexicon is the terms whose inverse document frequency lies
in a band, counted over the whole table: terms in ``LEAST_SHARE`` to
``MOST_SHARE`` of the documents.  The first part of a fingerprint hashes all
of a document's lexicon terms, sorted; the others hash those in one of several
random subsets of the lexicon, each term's membership drawn from its SHA-256.
Subsets come in several densities, so that texts of all lengths have subsets
with few of their terms: an edit leaves some of these unchanged.  Likeness is
the share of equal parts among those that are not empty in both.

The lexicon has at most (mean distinct terms of a document) / ``LEAST_SHARE``
terms, whatever the number of documents.  It is sent to all executors if it
takes ``LEXICON_BYTES`` there at most; beyond that, terms meet it in a join.

For the next document in ascending id, ids are cut into blocks at points of a
sample, a block's rows are sorted in one task and read as a stream, and the
first rows of the next block go along with each block.

Defined cases: NULL text is an empty text; a text without lexicon terms is
hashed by all its terms; very long texts are read whole; equal texts have equal
fingerprints; NULL ids come
first in order, equal ids are ordered by text; a lone document is its own next;
an empty table gives an empty table; other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from colframe.llm.common import documents, slices, to_arrow, written
from colframe.operators.ordering import with_block

#: The band: shares of the documents that have a term, least and most (idf = -ln share).
LEAST_SHARE, MOST_SHARE = 0.0005, 0.2
#: Random lexicons: how many of each density (one term in so many).
SUBSETS = ((8, 16), (24, 128), (24, 512), (8, 2048))
PARTS = sum(n for n, _ in SUBSETS)
PART_DIGITS, WHOLE_DIGITS = 4, 16
EMPTY = "-" * PART_DIGITS
#: Bytes of the lexicon that each Python worker may hold, and bytes of a term beside its letters (object, number, memberships).
LEXICON_BYTES, TERM_BYTES = 160_000_000, 250
#: Rows of an ordered block, at most.
BLOCK_ROWS = 100_000
#: Terms counted in a task before it hands the counts on.
COUNTED = 150_000
PUNCTUATION = ".,;:!?\"'()[]{}<>|*#$%&-_=+/\\"
FIRST_ID = -(1 << 63)


def terms_of(text: str | None) -> set[str]:
    found = {w.strip(PUNCTUATION) for w in set((text or "").lower().split())}
    found.discard("")
    return found


def memberships(term: str) -> tuple[int, ...]:
    """The random lexicons that a term is in."""
    digits = "".join(hashlib.sha256(f"{term}:{i}".encode()).hexdigest() for i in range(-(-PARTS // 16)))
    out, k = [], 0
    for n, density in SUBSETS:
        for _ in range(n):
            if int(digits[4 * k : 4 * k + 4], 16) * density < 65536:
                out.append(k)
            k += 1
    return tuple(out)


def fingerprint(terms: set[str], lexicon) -> str:
    """The fingerprint of a document's terms; ``lexicon`` maps its terms to their memberships."""
    known = sorted(terms & lexicon.keys()) if len(terms) < len(lexicon) else sorted(t for t in lexicon if t in terms)
    parts: list[list[str]] = [[] for _ in range(PARTS)]
    for t in known:
        for k in lexicon[t]:
            parts[k].append(t)
    md5 = lambda x: hashlib.md5(x.encode(), usedforsecurity=False).hexdigest()
    whole = md5(" ".join(known)) if known else md5("\n" + " ".join(sorted(terms)))
    return whole[:WHOLE_DIGITS] + "".join(md5(" ".join(p))[:PART_DIGITS] if p else EMPTY for p in parts)


def likeness(a: str, b: str) -> float:
    """Share of equal parts among those that are not empty in both fingerprints."""
    if a == b:
        return 1.0
    same, n = int(a[:WHOLE_DIGITS] == b[:WHOLE_DIGITS]), 1
    for i in range(WHOLE_DIGITS, len(a), PART_DIGITS):
        x, y = a[i : i + PART_DIGITS], b[i : i + PART_DIGITS]
        if x != EMPTY or y != EMPTY:
            n += 1
            same += x == y
    return same / n


def lexicon_of(df: DataFrame, text: str = "text", least: float = LEAST_SHARE, most: float = MOST_SHARE) -> DataFrame:
    """``(term, n)``: the terms in the band, and how many documents have each."""
    schema = "term string, n long"
    target = to_arrow(df.sparkSession, schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter = Counter()
        flush = lambda: pa.RecordBatch.from_arrays([pa.array(counts.keys(), pa.string()), pa.array(counts.values(), pa.int64())], schema=target)
        for part in slices(batches):
            for t in part.column(0):
                counts.update(terms_of(t.as_py()))
                if len(counts) > COUNTED:
                    yield flush()
                    counts.clear()
        if counts:
            yield flush()

    n = df.count()
    return df.select(text).mapInArrow(run, schema).groupBy("term").agg(F.sum("n").alias("n")).filter((F.col("n") >= least * n) & (F.col("n") <= most * n))


def ordered_blocks(df: DataFrame, keys: str = "doc_id", text: str = "text") -> DataFrame:
    """``(block, halo, doc_id, text)`` partitioned by block and sorted: each block's rows, then the row after it."""
    spark = df.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    key = F.coalesce(F.col(keys).cast("long"), F.lit(FIRST_ID))
    rows = df.select(F.col(keys).alias("doc_id"), F.col(text).alias("text"), key.alias("key"))
    rows = with_block(rows, "key", max(1, min(BLOCK_ROWS, -(-df.count() // (4 * parts)))), "block")
    firsts = sorted((r[0], r[1]) for r in rows.groupBy("block").agg(F.min("key")).collect())
    before = [firsts[i - 1][0] for i in range(len(firsts))]  # of the first: the last
    at = F.array_position(F.array(*(F.lit(f) for _, f in firsts)).cast("array<bigint>"), F.col("key")).cast("int")
    to = F.get(F.array(*map(F.lit, before)).cast("array<int>"), at - 1)
    here = F.struct(F.col("block"), F.lit(0).alias("halo"))
    there = F.struct(to.alias("block"), F.lit(1).alias("halo"))
    rows = rows.withColumn("to", F.explode(F.when(at > 0, F.array(here, there)).otherwise(F.array(here))))
    return rows.select("to.block", "to.halo", "doc_id", "text", "key").repartition(parts, "block").sortWithinPartitions("block", "halo", "key", F.col("text").asc_nulls_first()).select("block", "halo", "doc_id", "text")


def edited(text: str, other: str) -> str:
    """``text`` with its last half replaced by as much of the beginning of ``other``."""
    half = len(text) // 2
    return text[: len(text) - half] + other[:half]


def compared(df: DataFrame, lexicon: DataFrame | None = None) -> DataFrame:
    """Fingerprints of each text, of its edited text, and their likeness to each other and to the next document."""
    spark = df.sparkSession
    lexicon = written(lexicon if lexicon is not None else lexicon_of(df), "lexicon")
    schema = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
    target = to_arrow(spark, schema)
    terms, letters = lexicon.agg(F.count("*"), F.coalesce(F.sum(F.octet_length("term")), F.lit(0))).first()
    if terms * TERM_BYTES + letters > LEXICON_BYTES:
        return _joined(df, lexicon)
    known = spark.sparkContext.broadcast({r["term"]: memberships(r["term"]) for r in lexicon.collect()})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, out, last = known.value, [], None
        for batch in slices(batches):
            for block, halo, doc_id, text in zip(*(c.to_pylist() for c in batch.columns)):
                text = text or ""
                fp = fingerprint(terms_of(text), words)
                if last and last[0] == block and not last[1]:
                    new = edited(last[3], text)
                    efp = fingerprint(terms_of(new), words)
                    out.append({"doc_id": last[2], "n_chars": len(last[3]), "edited_sha256": hashlib.sha256(new.encode()).hexdigest(), "fingerprint": last[4], "edited_fingerprint": efp, "near_edited": likeness(last[4], efp), "near_next": likeness(last[4], fp)})
                last = (block, halo, doc_id, text, fp)
                if len(out) >= 1000:
                    yield pa.RecordBatch.from_pylist(out, schema=target)
                    out = []
        if out:
            yield pa.RecordBatch.from_pylist(out, schema=target)

    return ordered_blocks(df).mapInArrow(run, schema)


def _pairs(df: DataFrame) -> DataFrame:
    """``(doc_id, n_chars, id, text, edited)``: each text and its edited text, with an id of the row."""
    schema = "doc_id long, text string, next string, edited string"
    target = to_arrow(df.sparkSession, schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, out = None, []
        for batch in slices(batches):
            for block, halo, doc_id, text in zip(*(c.to_pylist() for c in batch.columns)):
                text = text or ""
                if last and last[0] == block and not last[1]:
                    out.append({"doc_id": last[2], "text": last[3], "next": text, "edited": edited(last[3], text)})
                last = (block, halo, doc_id, text)
                if len(out) >= 500:
                    yield pa.RecordBatch.from_pylist(out, schema=target)
                    out = []
        if out:
            yield pa.RecordBatch.from_pylist(out, schema=target)

    return ordered_blocks(df).mapInArrow(run, schema)


def in_lexicon(texts: DataFrame, lexicon: DataFrame) -> DataFrame:
    """``(sha, fp)`` for each distinct text of ``texts (text)``: its terms meet the lexicon in a join."""
    spark = texts.sparkSession
    schema = "sha binary, term string"
    target = to_arrow(spark, schema)

    def explode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for t in batch.column(0).to_pylist():
                terms = sorted(terms_of(t))
                yield pa.RecordBatch.from_arrays([pa.array([hashlib.sha256(t.encode()).digest()] * (len(terms) + 1)), pa.array([*terms, None], pa.string())], schema=target)

    each = texts.mapInArrow(explode, schema)
    kept = each.join(lexicon.select("term", F.lit(True).alias("known")), "term", "left").groupBy("sha").agg(F.collect_set("term").alias("all"), F.collect_set(F.when(F.col("known"), F.col("term"))).alias("known"))
    out = "sha binary, fp string"
    done = to_arrow(spark, out)

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = [fingerprint(set(a), {t: memberships(t) for t in k}) for a, k in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist())]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fps, pa.string())], schema=done)

    return kept.mapInArrow(hashed, out)


def _joined(df: DataFrame, lexicon: DataFrame) -> DataFrame:
    """``compared`` for a lexicon of any size."""
    pairs = written(_pairs(df), "pairs")
    texts = pairs.select(F.explode(F.array("text", "edited")).alias("text")).distinct()
    fps = written(in_lexicon(texts, lexicon), "fingerprints")
    out = pairs
    for c in ("text", "edited", "next"):
        out = out.join(fps.select(F.col("sha").alias(f"{c}_sha"), F.col("fp").alias(f"{c}_fp")), F.unhex(F.sha2(c, 256)) == F.col(f"{c}_sha"), "left")
    parts = lambda c: F.array(F.substring(c, 1, WHOLE_DIGITS), *(F.substring(c, WHOLE_DIGITS + 1 + PART_DIGITS * i, PART_DIGITS) for i in range(PARTS)))

    def near(a: str, b: str):
        both = F.filter(F.arrays_zip(parts(a).alias("x"), parts(b).alias("y")), lambda p: ~((p["x"] == EMPTY) & (p["y"] == EMPTY)))
        return F.when(F.col(a) == F.col(b), F.lit(1.0)).otherwise(F.size(F.filter(both, lambda p: p["x"] == p["y"])) / F.size(both))

    return out.select("doc_id", F.length("text").cast("long").alias("n_chars"), F.sha2("edited", 256).alias("edited_sha256"), F.col("text_fp").alias("fingerprint"), F.col("edited_fp").alias("edited_fingerprint"), near("text_fp", "edited_fp").alias("near_edited"), near("text_fp", "next_fp").alias("near_next"))


def op1_imatch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every whole text of ``documents`` and its edited text."""
    return compared(documents(spark, sf_dir).select("doc_id", "text"))
