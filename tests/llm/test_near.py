"""Fingerprints, SimHash, lines and repeated substrings against plain versions."""

import hashlib
import random
import re
from collections import Counter
from pathlib import Path

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from colframe.llm import imatch, lines, simhash, suffixes
from colframe.llm.components import components


DATA = Path("/root/testdata/sf0.001")


def find(parent, x):
    while parent[x] != x:
        x = parent[x]
    return x


def plain_imatch(rows):
    """Fingerprints, edited texts and likenesses of rows ``(id, text)``, written from the description alone."""
    marks = ".,;:!?\"'()[]{}<>|*#$%&-_=+/\\"
    densities = [16] * 8 + [128] * 24 + [512] * 24 + [2048] * 8

    def terms(text):
        return {w.strip(marks) for w in (text or "").lower().split()} - {""}

    def member(term, k):
        digits = hashlib.sha256(f"{term}:{k // 16}".encode()).hexdigest()
        return int(digits[4 * (k % 16) : 4 * (k % 16) + 4], 16) / 65536 < 1 / densities[k]

    rows = sorted(rows)
    counts = Counter(t for _, text in rows for t in terms(text))
    band = {t for t, k in counts.items() if 0.0005 * len(rows) <= k <= 0.2 * len(rows)}
    md5 = lambda x: hashlib.md5(x.encode()).hexdigest()

    def prints(text):
        own = sorted(terms(text) & band)
        parts = [[t for t in own if member(t, k)] for k in range(64)]
        return [(md5(" ".join(own)) if own else md5("\n" + " ".join(sorted(terms(text)))))[:16], *(md5(" ".join(p))[:4] if p else "----" for p in parts)]

    def like(a, b):
        seen = [(x, y) for x, y in zip(a, b) if (x, y) != ("----", "----")]
        return sum(x == y for x, y in seen) / len(seen)

    out = {}
    for i, (doc, text) in enumerate(rows):
        text, after = text or "", rows[(i + 1) % len(rows)][1] or ""
        half = len(text) // 2
        new = text[: len(text) - half] + after[:half]
        a, b, c = prints(text), prints(new), prints(after)
        out[doc] = (len(text), hashlib.sha256(new.encode()).hexdigest(), "".join(a), "".join(b), round(like(a, b), 9), round(like(a, c), 9))
    return out


@pytest.mark.parametrize("bound", [imatch.LEXICON_BYTES, 0])
def test_imatch_is_the_plain_result(unique_docs, unique, monkeypatch, bound):
    monkeypatch.setattr(imatch, "LEXICON_BYTES", bound)
    got = {r.doc_id: (r.n_chars, r.edited_sha256, r.fingerprint, r.edited_fingerprint, round(r.near_edited, 9), round(r.near_next, 9)) for r in imatch.compared(unique_docs).collect()}
    assert got == plain_imatch([r[:2] for r in unique])


def test_imatch(spark, docs, unique_docs, unique, none):
    n = len(unique)
    counts = Counter()
    for r in unique:
        counts.update(imatch.terms_of(r[1]))
    lexicon = {t: imatch.memberships(t) for t, k in counts.items() if imatch.LEAST_SHARE * n <= k <= imatch.MOST_SHARE * n}
    order = sorted(unique)
    want = {}
    for i, r in enumerate(order):
        text, after = r[1] or "", order[(i + 1) % n][1] or ""
        new = imatch.edited(text, after)
        a, b, c = (imatch.fingerprint(imatch.terms_of(x), lexicon) for x in (text, new, after))
        want[r[0]] = (r[0], len(text), hashlib.sha256(new.encode()).hexdigest(), a, b, imatch.likeness(a, b), imatch.likeness(a, c))
    assert {r.doc_id: tuple(r) for r in imatch.compared(unique_docs).collect()} == want
    joined = imatch._joined(unique_docs, imatch.lexicon_of(unique_docs))
    assert {r.doc_id: tuple(r)[:5] for r in joined.collect()} == {k: v[:5] for k, v in want.items()}
    assert {r.doc_id: [round(x, 12) for x in tuple(r)[5:]] for r in joined.collect()} == {k: [round(x, 12) for x in v[5:]] for k, v in want.items()}
    assert imatch.compared(docs).count() == docs.count()
    assert imatch.compared(none).count() == 0


def test_lone_document_is_its_own_next(spark):
    df = spark.createDataFrame([(5, "abcd")], "doc_id long, text string")
    r = imatch.compared(df).first()
    assert r.edited_sha256 == hashlib.sha256(b"abab").hexdigest() and r.near_next == 1.0


def test_components(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 100 + i) for i in range(1, 30)] + [(7, 7), (None, 3), (500, 501), (500, 501)]
    got = {r.node: r.root for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**dict.fromkeys(range(41), 0), **dict.fromkeys(range(100, 130), 100), 500: 500, 501: 500}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


@pytest.mark.parametrize("dense", [4096, 3])
@pytest.mark.parametrize("blocks", [4, 6, 8])
def test_links(spark, dense, blocks):
    r = np.random.Generator(np.random.PCG64(3))
    centres = r.integers(0, 1 << 63, 12, dtype=np.uint64)
    values = set(r.integers(0, 1 << 63, 60, dtype=np.uint64).tolist())
    for c in centres.tolist():
        for _ in range(40):
            for b in r.choice(64, r.integers(0, 4), replace=False).tolist():
                c ^= 1 << b
            values.add(c)
    x = np.array(sorted(values), np.uint64)
    parent = list(range(len(x)))
    for i in range(len(x)):
        for j in np.flatnonzero(np.bitwise_count(x[i] ^ x[i + 1 :]) <= 3) + i + 1:
            parent[find(parent, int(j))] = find(parent, i)
    signed = x.view(np.int64).tolist()
    groups = {}
    for i in range(len(x)):
        groups.setdefault(find(parent, i), set()).add(signed[i])
    got = {}
    fps = spark.createDataFrame([(v,) for v in signed] * 2 + [(None,)], "fp long")
    for row in components(simhash.links(fps, 3, dense, blocks)).collect():
        got.setdefault(row.root, set()).add(row.node)
    assert sorted(map(sorted, got.values())) == sorted(sorted(g) for g in groups.values() if len(g) > 1)


def test_simhash(docs, none, rows):
    docs_fp = simhash.fingerprints(docs)
    found = simhash.linked(docs_fp.cache()).collect()
    assert len(found) == len(rows)
    by_text = {}
    for r in rows:
        fp = simhash.fingerprint(r[1])
        by_text.setdefault(fp, []).append(r[0])
    parent = {f: f for f in by_text}
    for a in by_text:
        for b in by_text:
            if ((a ^ b) & (1 << 64) - 1).bit_count() <= 3:
                parent[find(parent, a)] = find(parent, b)
    ids = {}
    for f, d in by_text.items():
        ids.setdefault(find(parent, f), []).extend(x for x in d if x is not None)
    for r in found:
        assert r.component_id == min(ids[find(parent, r.fp)], default=None)
    assert simhash.fingerprint(None) == simhash.fingerprint(" \n") == 0
    assert simhash.linked(simhash.fingerprints(none)).count() == 0


def plain_fingerprint(text):
    """The majority of each bit over the shingles' hashes, as an unsigned number."""
    words = re.findall(rb"[^\x20\x09-\x0D]+", re.sub(rb"[A-Z]", lambda m: bytes([m[0][0] + 32]), (text or "").encode()))
    if not words:
        return 0
    grams = [b" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or [b" ".join(words)]
    hashes = [xxhash.xxh64(g, seed=42).intdigest() for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


@pytest.mark.skipif(not DATA.exists(), reason="no test tables")
def test_op3_is_the_plain_result(spark):
    import duckdb

    rows = duckdb.sql(f"SELECT doc_id, text FROM '{DATA}/documents.parquet'").fetchall()
    fps = {i: plain_fingerprint(t) for i, t in rows}
    parent = {f: f for f in fps.values()}
    for a in parent:
        for b in parent:
            if (a ^ b).bit_count() <= 3:
                parent[find(parent, a)] = find(parent, b)
    least = {}
    for i, f in sorted(fps.items()):
        least.setdefault(find(parent, f), i)
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in simhash.op3_simhash(spark, str(DATA)).collect()}
    assert got == {i: (f"{f:016x}", least[find(parent, f)]) for i, f in fps.items()}
    assert any(i != c for i, (_, c) in got.items())


def test_texts_whose_fingerprints_differ_in_the_highest_bit(spark):
    r = random.Random(2)
    bit = 1 << 63
    base = next(t for t in (" ".join(r.choice("abcdefgh") for _ in range(400)) for _ in iter(int, 1)) if abs(2 * sum(x >> 63 for x in (xxhash.xxh64(" ".join(t.split()[i : i + 3]), seed=42).intdigest() for i in range(398))) - 398) <= 4)
    for _ in range(2000):
        words = base.split()
        words[r.randrange(400)] = r.choice("abcdefgh")
        other = " ".join(words)
        if (plain_fingerprint(base) ^ plain_fingerprint(other)) & bit and (plain_fingerprint(base) ^ plain_fingerprint(other)).bit_count() <= 3:
            break
    else:
        raise AssertionError("no such text")
    df = spark.createDataFrame([(4, base), (9, other)], "doc_id long, text string")
    assert {x.component_id for x in simhash.linked(simhash.fingerprints(df)).collect()} == {4}


def test_keep_one(docs, rows):
    kept = simhash.keep_one(docs)
    assert kept.columns == docs.columns
    groups = {r.root for r in simhash.linked(simhash.fingerprints(docs).cache()).collect()}
    assert kept.count() == len(groups)


def close(a, b, t):
    if abs(len(a) - len(b)) > t:
        return False
    before = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        now = [i]
        for j, y in enumerate(b, 1):
            now.append(min(before[j] + 1, now[-1] + 1, before[j - 1] + (x != y)))
        before = now
    return before[-1] <= t


def plain_lines(rows, least=lines.LEAST_WORDS):
    blanks, first = " \t\n\x0b\x0c\r", {}
    for doc, text in sorted(rows, key=lambda r: (r[0] is None, r[0] or 0)):
        for k, line in enumerate((text or "").split("\n")):
            if line := line.strip(blanks):
                first.setdefault(line, ((doc is None, doc or 0), k))
    words = {x: re.findall(r"[^\x20\x09-\x0D]+", x) for x in first}
    long_ = [x for x in first if len(words[x]) >= least]
    near = {x for x in long_ for y in long_ if first[y] < first[x] and x != y and close(words[x], words[y], 1)}
    out = {}
    for doc, text in rows:
        n = exact = 0
        gone, kept = 0, []
        for k, line in enumerate((text or "").split("\n")):
            x = line.strip(blanks)
            n += bool(x)
            if x and first[x] != ((doc is None, doc or 0), k):
                exact += 1
            elif x and x in near:
                gone += 1
            else:
                kept.append(line)
        out[doc] = (n, exact, gone, None if text is None else "\n".join(kept))
    return out


def decided(df, **how):
    return {r.record.doc_id: (r.n_lines, r.n_exact, r.n_near, r.kept) for r in lines.decided(df, **how).collect()}


def variants(seed=2):
    """Lines of words with up to three words put in, left out or replaced, repeated words, and other blanks."""
    r = random.Random(seed)
    base = [[r.choice("abcdef") * r.randint(1, 2) for _ in range(r.randint(9, 20))] for _ in range(6)]
    rows = []
    for i in range(120):
        parts = []
        for _ in range(3):
            line = list(r.choice(base))
            for _ in range(r.randint(0, 3)):
                at = r.randrange(len(line))
                if (k := r.randint(0, 2)) == 0:
                    line[at] = r.choice("xyz")
                elif k == 1:
                    line.insert(at, r.choice("axyz"))
                else:
                    line.pop(at)
            parts.append(r.choice((" ", " ", "  ")).join(line))
        rows.append((i, "\n".join([*parts, "short", ""])))
    return rows + [(None, rows[0][1]), (200, None), (201, "")]


@pytest.mark.parametrize("dense", [1000, 8, 1])
def test_lines(spark, dense):
    rows = variants()
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    assert decided(df, dense=dense) == plain_lines(rows)


def test_lines_shuffled(spark, monkeypatch):
    monkeypatch.setattr(lines, "SMALL", 0)
    rows = variants(5)
    assert decided(spark.createDataFrame(rows, "doc_id long, text string")) == plain_lines(rows)


def test_very_long_near_equal_lines(spark):
    """Texts of one line of 60,000 characters, differing in a word at the end, at the front or in length."""
    words = ["w%04d" % (i * 7919 % 10000) for i in range(10000)]
    rows = []
    for i in range(40):
        w = list(words)
        if i % 4 == 0:
            w[-1 - i % 3] = "end%d" % i
        elif i % 4 == 1:
            w[i % 3] = "front%d" % i
        elif i % 4 == 2:
            w.insert(5000 + i, "more%d" % i)
        else:
            w[100 + i], w[200 + i] = "two%d" % i, "words%d" % i
        rows.append((i, " ".join(w)))
    got = decided(spark.createDataFrame(rows, "doc_id long, text string"))
    kept = [i for i, r in got.items() if not r[2]]
    assert got == {i: (1, 0, int(i not in kept), "" if i not in kept else t) for i, t in rows}
    # only lines that change the same word are an edit apart
    alike = lambda i: ("end", i % 3) if i % 4 == 0 else ("front", i % 3) if i % 4 == 1 else i
    seen, want = set(), []
    for i, _ in rows:
        if alike(i) not in seen:
            seen.add(alike(i))
            want.append(i)
    assert sorted(kept) == want


def test_two_thousand_variants_of_a_line(spark):
    words = ["v%d" % i for i in range(24)]
    rows = []
    for i in range(2000):
        w = list(words)
        w[i % 24] = "new%d" % i
        if i % 5 == 0:
            w[(i + 7) % 24] = "other%d" % i
        rows.append((i, " ".join(w)))
    got = decided(spark.createDataFrame(rows, "doc_id long, text string"))
    first, want = {}, set()
    for i, _ in rows:
        if i % 5 and first.setdefault(i % 24, i) != i:
            want.add(i)
    # every fifth line has two words changed, neither as in another line
    assert {i for i, r in got.items() if r[2]} == want


def test_line_cases(docs, unique_docs, unique, none):
    assert decided(unique_docs) == plain_lines([r[:2] for r in unique])
    assert lines.decided(docs).count() == docs.count()
    out = lines.dedup(docs)
    assert out.columns == docs.columns and lines.dedup(none).count() == 0


def plain_removed(rows, length=suffixes.LENGTH):
    seen, out = set(), {}
    for doc, text in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0)):
        b = (text or "").encode()
        over = np.zeros(len(b) + 1, int)
        for i in range(len(b) - length + 1):
            s = b[i : i + length]
            if s in seen:
                over[i] += 1
                over[i + length] -= 1
            seen.add(s)
        gone = np.cumsum(over)[: len(b)] > 0
        runs = int((gone & ~np.r_[False, gone[:-1]]).sum()) if len(b) else 0
        out[doc] = (len(b), int(gone.sum()), runs, hashlib.sha256(bytes(x for x, g in zip(b, gone) if not g)).hexdigest())
    return out


@pytest.mark.parametrize(("few", "dense"), [(suffixes.FEW, suffixes.DENSE), (2, 2), (1, 50)])
def test_removed(spark, unique_docs, unique, few, dense):
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in suffixes.removed(unique_docs, few=few, dense=dense).collect()}
    assert got == plain_removed([r[:2] for r in unique])


@pytest.mark.parametrize("piece", [suffixes.PIECE, 300])
def test_removed_edges(spark, monkeypatch, piece):
    """Passages of 95 to 110 bytes in different surroundings, at text ends, periodic, and over pieces' ends."""
    monkeypatch.setattr(suffixes, "PIECE", piece)
    r = random.Random(8)
    noise = lambda n: "".join(r.choice("abcdefghij é") for _ in range(n))
    passages = [noise(k) for k in (95, 99, 100, 101, 110, 250)]
    rows = [(i, r.choice(["", noise(r.randint(0, 400))]) + r.choice(passages) + r.choice(["", noise(r.randint(0, 500))]) + r.choice(passages)[: r.randint(60, 250)]) for i in range(80)]
    rows += [(100, "ab" * 200), (101, "ab" * 90 + "c" + "ab" * 90), (102, "x" * 99), (103, "x" * 99), (104, "x" * 101), (None, passages[-1])]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    got = {x.doc_id: (x.n_bytes, x.n_removed, x.n_spans, x.kept_sha256) for x in suffixes.removed(df).collect()}
    assert got == plain_removed(rows)


def test_removed_cases(docs, none):
    assert suffixes.removed(docs).count() == docs.count()
    assert suffixes.removed(none).count() == 0


def test_levels_stay_few():
    index = suffixes.Levels()
    made = [suffixes.rows_of([0], [f"{i:0>100}".encode()]) for i in range(2000)]
    for i in random.Random(1).sample(range(200), 200):
        index.add(np.concatenate(made[i * 10 : i * 10 + 10]))
    assert len(index.levels) <= 12 and sum(len(v[0]) for v in index.levels) == 2000
    for rows, whole, _ in index.levels:
        assert (whole[1:] > whole[:-1]).all() and (suffixes._whole(rows) == whole).all()
    asked = [suffixes.rows_of([0], [x.encode().rjust(100, b"0")]) for x in ("5", "1999", "2000")]
    assert index.has(suffixes._whole(np.concatenate(asked))).tolist() == [True, True, False]


def test_common_lengths():
    r = random.Random(9)
    for _ in range(300):
        text = [bytes(r.choice(b"ab\0") for _ in range(r.randint(100, 168))) for _ in range(2)]
        before = [r.randint(0, min(68, len(t) - 32)) for t in text]
        text = [t[: b + 100] for t, b in zip(text, before)]
        rows = suffixes.rows_of(before, text)
        behind, ahead = suffixes.common(rows[:1], rows[1:])
        (a, b), (x, y) = text, before
        same = lambda p, q: next((i for i, (u, v) in enumerate(zip(p, q)) if u != v), min(len(p), len(q)))
        assert (behind[0], ahead[0]) == (same(a[:x][::-1], b[:y][::-1]), same(a[x:], b[y:]))


@pytest.mark.parametrize("bits", [2, 12])
def test_hashes_that_collide_remove_nothing(spark, monkeypatch, tmp_path, bits):
    """With hashes of a few bits nearly all suffixes are candidates of each other; results stay exact."""
    full = suffixes.sampled

    def few(pieces):
        number, offset, right, key, context, sides = full(pieces)
        low, one = np.uint64((1 << bits) - 1), np.uint64(1)
        cut = lambda x: np.where(x > 0, x & low | one, x)
        return number, offset, right, key & low | one, context & low, cut(sides >> np.uint64(32)) << np.uint64(32) | cut(sides & np.uint64(0xFFFFFFFF))

    monkeypatch.setattr(suffixes, "sampled", few)
    r = random.Random(8)
    noise = lambda n: "".join(r.choice("abcdefghij é") for _ in range(n))
    passages = [noise(k) for k in (99, 100, 101, 250)]
    rows = [(i, noise(r.randint(0, 200)) + r.choice(passages) + noise(r.randint(0, 200))) for i in range(60)]
    batch = suffixes.pa.RecordBatch.from_arrays([suffixes.pa.array([i for i, _ in rows]), suffixes.pa.array([0] * 60), suffixes.pa.array([t for _, t in rows])], ["doc", "tie", "text"])
    schema = suffixes.to_arrow(spark, suffixes._SAMPLES)
    made = [b for one in (batch.slice(0, 30), batch.slice(30)) for b in suffixes._sample(schema, np.empty(0, np.uint64))(iter([one]))]
    table = suffixes.pa.Table.from_batches(made).sort_by("key").combine_chunks()
    found = list(suffixes._candidates(suffixes.to_arrow(spark, suffixes._FOUND))(iter(table.to_batches(max_chunksize=50))))
    spans, asked = {}, []
    for x in (x for b in found for x in b.to_pylist()):
        if x["key"] is None:
            spans.setdefault(x["doc"], []).append(x["spans"])
        else:
            asked.append((x["doc"], x["tie"], x["at"]))
    raw = dict((i, t.encode()) for i, t in rows)
    contexts = [(d, t, at, min(at, 68), raw[d][max(0, at - 68) : at + 100]) for d, t, at in sorted(asked)]
    kinds = suffixes.pa.schema([("doc", "int64"), ("tie", "int64"), ("at", "int64"), ("before", "int32"), ("context", "binary")])
    whole = suffixes.pa.RecordBatch.from_arrays([suffixes.pa.array(c, f.type) for c, f in zip(zip(*contexts), kinds)], schema=kinds)
    scanned = suffixes._scan(suffixes.to_arrow(spark, "doc long, tie long, spans binary"))(iter([whole.slice(i, 70) for i in range(0, whole.num_rows, 70)]))
    for x in (x for b in scanned for x in b.to_pylist()):
        spans.setdefault(x["doc"], []).append(x["spans"])
    want = plain_removed(rows)
    for i, _ in rows:
        pairs = np.frombuffer(b"".join(spans.get(i, [])), "<i8").reshape(-1, 2)
        gone = sum((b - a for a, b in zip(*suffixes.merged(pairs[:, 0], pairs[:, 1]))), 0) if len(pairs) else 0
        assert gone == want[i][1]


def test_leaders_find_what_pairs_do(monkeypatch):
    """Contexts that part from each other at many places, some with few letters, against all pairs."""
    monkeypatch.setattr(suffixes, "FEW", 3)
    r = random.Random(6)
    for letters in (b"ab", b"abcdefgh"):
        for _ in range(30):
            noise = lambda n: bytes(r.choice(letters) for _ in range(n))
            trunk = [noise(68), noise(100)]
            before, contexts = [], []
            for _ in range(r.randint(4, 60)):
                b, a = bytearray(r.choice((trunk[0], contexts[-1][: before[-1]] if contexts else trunk[0]))), bytearray(trunk[1])
                for part in (b, a):
                    for _ in range(r.randint(0, 2)):
                        if part:
                            part[r.randrange(len(part))] = r.choice(letters)
                b = b[r.choice((0, 0, r.randint(0, len(b)))) :]
                before.append(len(b))
                contexts.append(bytes(b + a)[: len(b) + r.choice((100, 100, r.randint(32, 100)))])
            rows = suffixes.rows_of(before, contexts)
            want = suffixes.Reach(len(rows))
            i, j = np.triu_indices(len(rows), 1)
            want.add(j, *suffixes.common(rows[i], rows[j]))
            got = suffixes.settle(rows)
            assert (got.behind == want.behind).all() and (got.ahead == want.ahead).all()


@pytest.mark.parametrize(("few", "dense"), [(1, 1), (3, 3), (1, 1000)])
@pytest.mark.parametrize("length", [100, 150, 400])
def test_crowded_prefixes(spark, monkeypatch, few, dense, length):
    """Passages in surroundings that some share for a while, behind and ahead; shorter and longer than contexts."""
    monkeypatch.setattr(suffixes, "SENT", 0 if dense == 3 else suffixes.SENT)
    r = random.Random(length)
    noise = lambda n: "".join(r.choice("abcde é") for _ in range(n))
    passage, before, after = noise(length), [noise(60) for _ in range(3)], [noise(60) for _ in range(3)]
    cut = lambda x: x[: r.choice((0, 1, 7, 30, 60))]
    rows = [(i, noise(r.randint(0, 90)) + cut(r.choice(before)[::-1])[::-1] + passage + cut(r.choice(after)) + noise(r.randint(0, 90))) for i in range(50)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    got = {x.doc_id: (x.n_bytes, x.n_removed, x.n_spans, x.kept_sha256) for x in suffixes.removed(df, few=few, dense=dense).collect()}
    assert got == plain_removed(rows)


def test_frequent_prefixes_are_spread(spark, monkeypatch):
    monkeypatch.setattr(suffixes, "SAMPLE", 1)
    monkeypatch.setattr(suffixes, "OFTEN", 3)
    monkeypatch.setattr(suffixes, "RUN", 4)
    r = random.Random(5)
    noise = lambda n: "".join(r.choice("abcdefghij ") for _ in range(n))
    passage = noise(300)
    rows = [(i, noise(r.randint(0, 150)) + passage + noise(r.randint(0, 150))) for i in range(40)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    for few in (suffixes.FEW, 5, 1):
        got = {x.doc_id: (x.n_bytes, x.n_removed, x.n_spans, x.kept_sha256) for x in suffixes.removed(df, few=few, dense=8).collect()}
        assert got == plain_removed(rows)
