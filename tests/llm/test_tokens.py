"""BPE and record files against the tokenizers library; recovery and damage of record files."""

import hashlib
import itertools
import random
import zlib

import numpy as np
import pytest

pytest.importorskip("public_tokenizers")
import public_tokenizers
from tokenizers import Tokenizer

from colframe.llm import bpe, imatch, records
from colframe.llm.common import scratch

PATH = public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


def test_like_the_library(library):
    r = random.Random(4)
    own, cached = bpe.encoder(PATH), records.LibraryEncoder(PATH)
    pieces = [" ", "  ", "\n", "\t", "\x00", " ", "\x85", "a", "the", " of", "'s", "'ll", "12", "½", "é", "中", "!", "###", "<|endoftext|>", "<|end", "\r\n", "word.\nNext", "😀"]
    for _ in range(3000):
        s = "".join(r.choice(pieces) for _ in range(r.randint(0, 12)))
        want = library.encode(s, add_special_tokens=False).ids
        assert own.encode(s).tolist() == want and cached.encode_all([s])[0].tolist() == want, s
        assert own.decode(want) == library.decode(want, skip_special_tokens=False)


def test_long_word(library):
    word = "abc" * 400 + "é" * 300
    own = bpe.encoder(PATH)
    assert own.encode(word).tolist() == library.encode(word).ids
    part = [own.id_of_byte[b] for b in word.encode()]
    assert own._heaped(list(part)) == own._scanned(list(part))


def test_cache_turns(library):
    cached = records.LibraryEncoder(PATH, 50)
    texts = [f"word{i} and more{i % 7}.\nLine{i}" for i in range(300)]
    own = bpe.RankBPE(PATH)
    own.size = 50
    assert own.encode(" ".join(texts)).tolist() == library.encode(" ".join(texts)).ids and len(own) <= 50 and len(own.old) <= 50
    for i in range(0, 300, 20):
        for t, ids in zip(texts[i : i + 20], cached.encode_all(texts[i : i + 20])):
            assert ids.tolist() == library.encode(t).ids


def test_table(docs, none, rows, library):
    got = sorted(map(tuple, bpe.digests(docs, PATH).collect()), key=str)
    want = []
    for r in rows:
        ids = library.encode(r[1] or "", add_special_tokens=False).ids
        sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
        want.append((r[0], len(ids), sha(",".join(map(str, ids))), sha(r[1] or "")))
    assert got == sorted(want, key=str)
    assert bpe.digests(none, PATH).count() == 0
    coded = bpe.encode(docs, PATH)
    assert sorted(r.text for r in bpe.decode(coded, PATH).collect()) == sorted(r[1] or "" for r in rows)


def test_records(spark, docs, none, rows, library):
    folder = scratch(spark, "records")
    got = records.read_records(records.write_records(docs, folder, PATH), folder).orderBy("start").collect()
    want, start = [], 0
    for r in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, r[1] or "")):
        ids = np.array([*library.encode(r[1] or "", add_special_tokens=False).ids, 0], "<u4")
        want.append((r[0], start, len(ids), zlib.crc32(ids.tobytes())))
        start += len(ids)
    assert [tuple(x) for x in got] == want
    empty = scratch(spark, "records")
    assert records.read_records(records.write_records(none, empty, PATH), empty).count() == 0


def test_ids_at_the_ends_of_their_range(spark, library):
    rows = [(i, "a b" * (i % 5)) for i in (-(1 << 63) + 1, -5, 0, 7, (1 << 62), (1 << 63) - 2, (1 << 63) - 1)] * 3
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    folder = scratch(spark, "records")
    got = [(r.doc_id, r.n_tokens) for r in records.read_records(records.write_records(df, folder, PATH), folder).orderBy("start").collect()]
    assert got == sorted((i, len(library.encode(t).ids) + 1) for i, t in rows)
    assert imatch.compared(df).count() == len(rows)


def test_damage_is_seen():
    good = records.frame(records.pack(7, np.arange(5), False))
    payload, end = records.unframe(good, 0)
    assert end == len(good) and records.unpack(payload)[0] == 7
    for i in range(len(good)):
        bad = bytearray(good)
        bad[i] ^= 1
        with pytest.raises(ValueError):
            records.unframe(bytes(bad), 0)
    assert records.unpack(records.pack(None, np.array([70000]), True))[1].tolist() == [70000]


def test_new_words_go_to_the_library_joined(monkeypatch):
    """Ids of joined words are those of each alone; the library gets few strings for many words."""
    words = ["".join(c) for c in itertools.product("aehqtzéß語", repeat=3)] + ["the", "a", "x" * 3000]
    text = "start " + " ".join(words)
    tok = records.LibraryEncoder(PATH)
    whole = tok.library.encode(text, add_special_tokens=False).ids
    asked = []
    ids = tok._ids
    monkeypatch.setattr(tok, "_ids", lambda strings: (asked.append(len(strings)), ids(strings))[1])
    assert tok.encode_all([text])[0].tolist() == tok.encode_all([text])[0].tolist() == whole
    assert sum(asked) < len(words) / 10
    assert tok._joined(words) == ids([" " + w for w in words])
    tok.sizes[:] = 2  # ends that don't fit: each word alone
    assert tok._joined(words) == ids([" " + w for w in words])
