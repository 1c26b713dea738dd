"""Operator 7: token ids in length-delimited binary record files.

Method: each document's ids (with the end id) are one record::

    u64 length | u32 masked crc of those 8 bytes | payload | u32 masked crc of the payload

all little-endian.  The payload is a flag byte (bit 0: the document id is not
NULL; bit 1: ids take 4 bytes, else 2), the document id as i64, then the ids.
A checksum is the CRC-32 of the bytes, rotated right by 15 bits plus a
constant, so that a checksum stored inside data is never mistaken for the
checksum of that data.  Beside each file, ``.idx`` has for each record its
byte offset and the ids before it in the file (two u64), so that readers can
fetch records in any order.

Document ids are cut into ranges at points of a sample, and each range makes
one file, so files in order of their number hold the documents in ascending id
(NULL ids first, ties by text).  A task writes under a name of its own and
renames at the end: a repeated or speculative task leaves one whole file.

Files are written through ``pyarrow.fs``: the folder can be a path, or a URI
that it knows (``file``, ``hdfs``, ``s3``, ``gs``); ``s3a`` and ``s3n`` are read
as ``s3``.

Defined cases: NULL or empty text: a record with the end id alone; very long
texts are one record, as long as they are; rows with equal ids: one record each;
an empty table: no files and no rows; other columns are not read, and their
names don't matter.
"""

from __future__ import annotations

import os
import struct
import uuid
import zlib
from array import array
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from colframe.llm.bpe import ChunkCache, chunks_of
from colframe.llm.common import documents, scratch, slices, to_arrow
from colframe.operators.ordering import with_block

END_ID = 0
MASK_DELTA = 0xA282EAD8
#: Records that one reading task fetches.
READ_RECORDS = 4096
#: Chunks in each generation of a writing worker's cache.
LIBRARY_CACHE = 1_100_000
#: New words that the library gets as one string.
JOINED = 64
#: Records that one file is meant to hold at most.
FILE_RECORDS = 200_000


def masked_crc(data: bytes) -> int:
    crc = zlib.crc32(data)
    return ((crc >> 15 | crc << 17) + MASK_DELTA) & 0xFFFFFFFF


def frame(payload: bytes) -> bytes:
    size = struct.pack("<Q", len(payload))
    return b"".join((size, struct.pack("<I", masked_crc(size)), payload, struct.pack("<I", masked_crc(payload))))


def unframe(data: memoryview | bytes, at: int) -> tuple[bytes, int]:
    """The payload of the record at an offset, and the offset after it; ValueError if a checksum fails."""
    size = bytes(data[at : at + 8])
    if len(size) < 8 or struct.unpack_from("<I", data, at + 8)[0] != masked_crc(size):
        raise ValueError(f"broken length at byte {at}")
    end = at + 12 + struct.unpack("<Q", size)[0]
    payload = bytes(data[at + 12 : end])
    if len(data) < end + 4 or struct.unpack_from("<I", data, end)[0] != masked_crc(payload):
        raise ValueError(f"broken record at byte {at}")
    return payload, end + 4


def pack(doc_id: int | None, ids: np.ndarray, wide: bool) -> bytes:
    return struct.pack("<Bq", (doc_id is not None) | wide << 1, doc_id or 0) + ids.astype("<u4" if wide else "<u2").tobytes()


def unpack(payload: bytes) -> tuple[int | None, np.ndarray]:
    flags, doc_id = struct.unpack_from("<Bq", payload)
    return doc_id if flags & 1 else None, np.frombuffer(payload, "<u4" if flags & 2 else "<u2", offset=9)


def opened(path: str):
    """The file system of a path or URI, and the path in it."""
    from pyarrow import fs

    scheme, colon, rest = path.partition("://")
    if colon:
        return fs.FileSystem.from_uri({"s3a": "s3", "s3n": "s3"}.get(scheme, scheme) + colon + rest)
    return fs.FileSystem.from_uri(path if path.startswith(("/", "file:")) else os.path.abspath(path))


class LibraryEncoder(ChunkCache):
    """The tokenizers library behind a bounded cache of chunks; ids as bytes of ``kind``."""

    def __init__(self, path: str, size: int = LIBRARY_CACHE):
        super().__init__(size)
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.library.no_truncation()
        self.library.no_padding()
        self.kind = "<u4" if self.library.get_vocab_size() > 0x10000 else "<u2"
        self.new: set[str] = set()
        self.words: set[str] = set()
        sizes = np.zeros(1 + max(self.library.get_vocab(with_added_tokens=True).values(), default=0), np.int64)
        for token, i in self.library.get_vocab(with_added_tokens=False).items():
            sizes[i] = len(token)  # a character a byte
        self.sizes = sizes

    def __missing__(self, key: str) -> bytes | None:
        """The ids, or None and the chunk is asked for."""
        found = self.old.get(key)
        if found is None:
            if key.isalpha():
                self.words.add(key)
                return None
            if not (parts := self.parts(key)):
                self.new.add(key)
                return None
            each = list(map(self.__getitem__, parts))
            if None in each:
                return None
            found = b"".join(each)
        self[key] = found
        return found

    def _ids(self, strings: list[str]) -> list[bytes]:
        kind = "I" if self.kind == "<u4" else "H"
        return [array(kind, e.ids).tobytes() for e in self.library.encode_batch_fast(strings, add_special_tokens=False)]

    def _joined(self, words: list[str]) -> list[bytes]:
        """Ids of each space-led word, from strings of many; alone where tokens don't end where words do."""
        strings = [" " + w for w in words]
        data = b"".join(self._ids(["".join(strings[i : i + JOINED]) for i in range(0, len(strings), JOINED)]))
        ends = np.cumsum(self.sizes[np.frombuffer(data, self.kind)])
        wanted = np.cumsum(np.fromiter((len(x.encode()) for x in strings), np.int64, len(strings)))
        at = np.searchsorted(ends, wanted)
        if len(ends) == 0 or ends[-1] != wanted[-1] or (ends[at] != wanted).any():
            return self._ids(strings)
        at = ((at + 1) * np.dtype(self.kind).itemsize).tolist()
        return [data[i:j] for i, j in zip([0, *at], at)]

    def encode_all(self, texts: list[str | None]) -> list[np.ndarray]:
        """Ids of whole texts; chunks not met before go to the library together."""
        self.turn()
        keys, ids = [], []
        for text in texts:
            first, rest = chunks_of(text or "")
            rest.insert(0, "\0" + first)
            keys.append(rest)
            ids.append(list(map(self.__getitem__, rest)))
        new, words = list(self.new), list(self.words)
        self.new.clear()
        self.words.clear()
        self.update(zip(new, self._ids(list(map(self.string, new)))))
        if words:
            self.update(zip(words, self._joined(words)))
            new += words
        for key, found in zip(keys, ids):
            for at in [i for i, x in enumerate(found) if x is None]:
                found[at] = self[key[at]]
        whole = [np.frombuffer(b"".join(found), self.kind) for found in ids]
        for rest in keys:
            if len(rest[0]) > 64:
                self.pop(rest[0], None)
        for c in new:
            if len(c) > 64:
                self.pop(c, None)
        return whole


@lru_cache(maxsize=2)
def library_encoder(path: str) -> LibraryEncoder:
    return LibraryEncoder(path)


def write_records(df: DataFrame, folder: str, vocabulary: str, key: str = "doc_id", text: str = "text", end_id: int = END_ID) -> DataFrame:
    """Writes the files and returns their manifest: number, file, records, ids, first id's position.

    The manifest has one row a file; a file has ``FILE_RECORDS`` records at most, about.
    """
    spark = df.sparkSession
    schema = "number int, file string, records long, ids long"
    target = to_arrow(spark, schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tok = library_encoder(vocabulary)
        wide = tok.kind == "<u4" or end_id > 0xFFFF
        end, mine = np.array([end_id], "<u4" if wide else tok.kind), f".{uuid.uuid4().hex}"
        store, base = opened(folder)
        store.create_dir(base, recursive=True)
        number, out, index, done = None, None, None, []

        def close() -> None:
            out.close()
            index.close()
            store.move(file + ".idx" + mine, file + ".idx")
            store.move(file + mine, file)
            done.append({"number": number, "file": file, "records": records, "ids": ids_before})

        for part in slices(batches):
            for block, doc_id, ids in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), tok.encode_all(part.column(2).to_pylist())):
                if block != number:
                    if out is not None:
                        close()
                    number, at, records, ids_before = block, 0, 0, 0
                    file = f"{base}/part-{number:06d}.rec"
                    out, index = store.open_output_stream(file + mine), store.open_output_stream(file + ".idx" + mine)
                ids = np.append(ids, end)
                out.write(record := frame(pack(doc_id, ids, wide)))
                index.write(struct.pack("<QQ", at, ids_before))
                at, records, ids_before = at + len(record), records + 1, ids_before + len(ids)
        if out is not None:
            close()
            yield pa.RecordBatch.from_pylist(done, schema=target)

    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = df.select(F.col(key).cast("long").alias("id"), F.col(text).alias("text"))
    rows = with_block(rows, "id", max(1, min(FILE_RECORDS, -(-df.count() // (2 * parts)))), "block").select("block", "id", "text")
    ordered = rows.repartition(parts, "block").sortWithinPartitions("block", F.col("id").asc_nulls_first(), "text")
    made = sorted(map(tuple, ordered.mapInArrow(run, schema).collect()))
    starts = np.cumsum([0, *(m[3] for m in made)]).tolist()
    return spark.createDataFrame([(*m, s) for m, s in zip(made, starts)], schema + ", start long")


def read_records(manifest: DataFrame, folder: str) -> DataFrame:
    """``(doc_id, start, n_tokens, ids_crc32)`` of every record, read through the index in ranges."""
    spark = manifest.sparkSession
    schema = "doc_id long, start long, n_tokens long, ids_crc32 long"
    target = to_arrow(spark, schema)
    step = READ_RECORDS
    ranges = manifest.select("file", "start", F.explode(F.sequence(F.lit(0).cast("long"), F.col("records") - 1, F.lit(step).cast("long"))).alias("first"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store = opened(folder)[0]
        for row in (r for b in batches for r in b.to_pylist()):
            with store.open_input_file(row["file"] + ".idx") as f:
                f.seek(16 * row["first"])
                index = np.frombuffer(f.read(16 * (step + 1)), "<u8").reshape(-1, 2)
            with store.open_input_file(row["file"]) as f:
                begin = int(index[0, 0])
                f.seek(begin)
                data = memoryview(f.read((int(index[step, 0]) if len(index) > step else f.size()) - begin))
            index = index[:step].astype(np.int64)
            found = [unpack(unframe(data, at)[0]) for at in (index[:, 0] - begin).tolist()]
            sums = [zlib.crc32(ids.astype("<u4")) for _, ids in found]
            yield pa.RecordBatch.from_arrays([pa.array([d for d, _ in found], pa.int64()), pa.array(index[:, 1] + row["start"]), pa.array([len(x) for _, x in found], pa.int64()), pa.array(sums, pa.int64())], schema=target)

    tasks = max(1, min(4096, manifest.count()))
    return ranges.repartition(tasks, "file", "first").mapInArrow(run, schema)


def op7_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every whole text of ``documents`` encoded, written to record files, and read back from them."""
    import public_tokenizers

    folder = scratch(spark, "records")
    return read_records(write_records(documents(spark, sf_dir), folder, public_tokenizers.path("byte_bpe_50k.json")), folder)
