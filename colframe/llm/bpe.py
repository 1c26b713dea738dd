"""Operator 2: byte-level BPE encoding and decoding.

Method: contiguous rank array.  A word's bytes start as single parts.  Two
arrays of equal layout hold the part boundaries and the rank of each adjacent
pair; the smallest rank is found by a scan (leftmost on ties), its right
boundary is deleted, and only the ranks of the two neighbours are looked up
again.  Words over ``LONG_WORD`` bytes go through a heap over a linked list,
with the same result, since the scan is quadratic in the word.

Texts are cut at single spaces between non-blank characters, where the
pre-tokenizer's pattern always starts a new piece, so a chunk's ids do not
depend on its neighbours and are kept in a bounded cache.

Defined cases: a NULL text encodes as an empty one (no ids); texts of any
length are encoded whole; equal rows give equal rows; an empty table gives an
empty table; other columns of the input are not read.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import re
from array import array
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession

from colframe.llm.common import documents, map_columns

#: Longest word, in bytes, that the scanned rank array takes.
LONG_WORD = 192
#: Chunks in each of the two generations of a worker's cache (about 170 bytes each).
CACHE = 500_000
NO_RANK = 1 << 60
#: The pattern of the byte-level pre-tokenizer.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
_BETWEEN = re.compile(r"(?<=\S)(?= \S)")
_LINES = re.compile(r"(?<=[^\s\0])(?=\n\S)")
_MARKS = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"


def byte_alphabet() -> list[str]:
    """The printable stand-in of each byte in byte-level vocabularies."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = iter(range(256, 512))
    return [chr(b) if b in set(plain) else chr(next(rest)) for b in range(256)]


def chunks_of(text: str) -> tuple[str, list[str]]:
    """The first chunk, and the others without the single space that each begins with.

    Chunks are pre-tokenized alone as they are in the text.
    """
    if " \0" in text:
        return text, []
    if "  " in text:
        first, *rest = _BETWEEN.split(text)
        return first, [x[1:] for x in rest]
    rest = text.split(" ")
    return rest.pop(0), rest


class ChunkCache(dict):
    """Chunks to id bytes, by key: a space-led chunk without that space, or NUL and a chunk as it is.

    In two generations: a full one becomes the old one, and what is used again comes back.
    """

    def __init__(self, size: int = CACHE):
        super().__init__()
        self.old: dict[str, bytes] = {}
        self.size = size

    def turn(self) -> None:
        if len(self) >= self.size:
            self.old = dict(self)
            self.clear()

    @staticmethod
    def string(key: str) -> str:
        return key[1:] if key[:1] == "\0" else " " + key

    @staticmethod
    def parts(key: str) -> list[str] | None:
        """Keys of chunks that join to this one and are pre-tokenized alone as in it; None if it stays whole.

        A line end between other characters begins a piece, and so do closing marks after letters.
        """
        if "\n" in key[2:] and len(pieces := _LINES.split(key)) > 1:
            return [pieces[0], *("\0" + p for p in pieces[1:])]
        word = key.rstrip(_MARKS)
        if len(word) < len(key):
            letters = word[2:] if word[:2] == "\0\n" else word
            if letters.isalpha() and max(letters) < "\u0250":
                return [word, "\0" + key[len(word) :]]
        return None


class RankBPE(ChunkCache):
    """An encoder and decoder of one vocabulary file, and its cache."""

    def __init__(self, path: str):
        super().__init__()
        with open(path, encoding="utf-8") as f:
            model = json.load(f)
        vocab = model["model"]["vocab"]
        to_byte = {c: b for b, c in enumerate(byte_alphabet())}
        added = {x["content"]: x["id"] for x in model["added_tokens"]}
        size = 1 + max([*vocab.values(), *added.values()])
        self.bytes_of = [b""] * size
        for token, i in vocab.items():
            self.bytes_of[i] = bytes(to_byte[c] for c in token)
        for token, i in added.items():
            self.bytes_of[i] = token.encode()
        self.id_of_byte = [vocab[c] for c in byte_alphabet()]
        self.rank: dict[int, int] = {}
        self.merged: list[int] = []
        for a, b in (m if isinstance(m, list) else m.split(" ") for m in model["model"]["merges"]):
            self.rank.setdefault(vocab[a] << 32 | vocab[b], len(self.merged))
            self.merged.append(vocab[a + b])
        self.added = added
        self.split_added = re.compile("(" + "|".join(map(re.escape, sorted(added, key=len, reverse=True))) + ")") if added else None
        self.cut_at_spaces = not any(" " in x for x in added)
        self.plain_words = not any(x.strip().isalpha() for x in added)
        self.find = regex.compile(PATTERN).findall

    def word(self, data: bytes) -> list[int]:
        """Ids of one pre-tokenized word."""
        part = [self.id_of_byte[b] for b in data]
        return self._scanned(part) if len(part) <= LONG_WORD else self._heaped(part)

    def _scanned(self, part: list[int]) -> list[int]:
        rank_of, merged = self.rank.get, self.merged
        ranks = [rank_of(a << 32 | b, NO_RANK) for a, b in zip(part, part[1:])]
        while ranks:
            least = min(ranks)
            if least == NO_RANK:
                break
            at = ranks.index(least)
            part[at] = merged[least]
            del part[at + 1], ranks[at]
            if at:
                ranks[at - 1] = rank_of(part[at - 1] << 32 | part[at], NO_RANK)
            if at < len(ranks):
                ranks[at] = rank_of(part[at] << 32 | part[at + 1], NO_RANK)
        return part

    def _heaped(self, part: list[int]) -> list[int]:
        n = len(part)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(r, i, part[i], part[i + 1]) for i in range(n - 1) if (r := self.rank.get(part[i] << 32 | part[i + 1])) is not None]
        heapq.heapify(heap)
        while heap:
            r, i, a, b = heapq.heappop(heap)
            j = after[i]
            if part[i] != a or j >= n or part[j] != b:
                continue
            part[i], part[j] = self.merged[r], -1
            after[i] = after[j]
            if after[i] < n:
                before[after[i]] = i
            for x, y in ((before[i], i), (i, after[i])):
                if x >= 0 and y < n and (r := self.rank.get(part[x] << 32 | part[y])) is not None:
                    heapq.heappush(heap, (r, x, part[x], part[y]))
        return [x for x in part if x >= 0]

    def chunk(self, text: str) -> list[int]:
        ids: list[int] = []
        for piece in self.split_added.split(text) if self.split_added else [text]:
            if piece in self.added:
                ids.append(self.added[piece])
            else:
                for word in self.find(piece):
                    ids += self.word(word.encode())
        return ids

    def __missing__(self, key: str) -> bytes:
        found = self.old.get(key)
        if found is None:
            if self.plain_words and key.isalpha() and max(key) < "\u0250":  # one word to the pre-tokenizer
                found = array("I", self.word((" " + key).encode())).tobytes()
            else:
                parts = self.parts(key)
                found = b"".join(map(self.__getitem__, parts)) if parts else array("I", self.chunk(self.string(key))).tobytes()
        if len(key) <= 64:
            self.turn()
            self[key] = found
        return found

    def encode(self, text: str | None) -> np.ndarray:
        """Ids of a whole text."""
        if not self.cut_at_spaces:
            return np.array(self.chunk(text or ""), "<u4")
        first, rest = chunks_of(text or "")
        return np.frombuffer(self["\0" + first] + b"".join(map(self.__getitem__, rest)), "<u4")

    def decode(self, ids: list[int]) -> str:
        of = self.bytes_of
        return b"".join([of[i] for i in ids]).decode("utf-8", "replace")


@lru_cache(maxsize=4)
def encoder(path: str) -> RankBPE:
    return RankBPE(path)


def encode(df: DataFrame, vocabulary: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Rows ``(key, ids array<int>)``: the whole text's ids."""
    kind = df.schema[key].dataType.simpleString()

    def make():
        bpe = encoder(vocabulary)

        def step(batch: pa.RecordBatch) -> dict:
            return {key: batch.column(0), "ids": [bpe.encode(x).astype(np.int32) for x in batch.column(1).to_pylist()]}

        return step

    return map_columns(df.select(key, text), f"`{key}` {kind}, ids array<int>", make)


def decode(df: DataFrame, vocabulary: str, key: str = "doc_id", ids: str = "ids") -> DataFrame:
    """Rows ``(key, text)``: the bytes of the ids' tokens as UTF-8 (NULL ids: an empty text)."""
    kind = df.schema[key].dataType.simpleString()

    def make():
        bpe = encoder(vocabulary)
        return lambda batch: {key: batch.column(0), "text": [bpe.decode(x or []) for x in batch.column(1).to_pylist()]}

    return map_columns(df.select(key, ids), f"`{key}` {kind}, text string", make)


def digests(df: DataFrame, vocabulary: str) -> DataFrame:
    """Encodes and decodes each text; rows ``(doc_id, n_tokens, ids_sha256, decoded_sha256)``."""

    def make():
        bpe = encoder(vocabulary)
        decimal = [str(i) for i in range(len(bpe.bytes_of))]
        sha = lambda x: hashlib.sha256(x).hexdigest()

        def step(batch: pa.RecordBatch) -> dict:
            out: dict = {"doc_id": batch.column(0), "n_tokens": [], "ids_sha256": [], "decoded_sha256": []}
            for text in batch.column(1):
                ids = bpe.encode(text.as_py()).tolist()
                out["n_tokens"].append(len(ids))
                out["ids_sha256"].append(sha(",".join([decimal[i] for i in ids]).encode()))
                out["decoded_sha256"].append(sha(bpe.decode(ids).encode()))
            return out

        return step

    return map_columns(df.select("doc_id", "text"), "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string", make)


def tokenized(df: DataFrame, vocabulary: str, carried: tuple[str, ...] = ("doc_id",), text: str = "text") -> DataFrame:
    """The carried columns, ``n_tokens``, ``ids``, and ``round_trip``: whether the ids decode to the text."""

    def make():
        bpe = encoder(vocabulary)

        def step(batch: pa.RecordBatch) -> dict:
            out: dict = {c: batch.column(i) for i, c in enumerate(carried)} | {"n_tokens": [], "ids": [], "round_trip": []}
            for t in batch.column(len(carried)):
                t = t.as_py() or ""
                ids = bpe.encode(t)
                out["n_tokens"].append(len(ids))
                out["ids"].append(ids.astype(np.int32))
                out["round_trip"].append(bpe.decode(ids.tolist()) == t)
            return out

        return step

    kinds = ", ".join(f"`{c}` {df.schema[c].dataType.simpleString()}" for c in carried)
    return map_columns(df.select(*carried, text), f"{kinds}, n_tokens long, ids array<int>, round_trip boolean", make)


def op2_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every whole text of ``documents`` through the rank-array encoder and back."""
    import public_tokenizers

    return digests(documents(spark, sf_dir), public_tokenizers.path("byte_bpe_50k.json"))
