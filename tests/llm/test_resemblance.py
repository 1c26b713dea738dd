"""Near copies by shingles against a plain version."""

import random

import corpus_pipeline
import numpy as np
import pytest
from pyspark.sql import functions as F

from colframe.llm import resemblance, simhash


def grams(text):
    words = (text or "").lower().split()
    return frozenset(tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))) if words else frozenset()


def plain(rows):
    """Ids that stay, of rows ``(id, text)`` with unique ids, by comparing all pairs."""
    sets, root = {i: grams(t) for i, t in rows}, {i: i for i, _ in rows}
    ids = sorted(root)
    for k, a in enumerate(ids):
        for b in ids[k + 1 :]:
            x, y = sets[a], sets[b]
            if (x == y or 5 * len(x & y) >= 4 * len(x | y)) and root[a] != root[b]:
                least, other = sorted((root[a], root[b]))
                root = {i: least if r == other else r for i, r in root.items()}
    return {i for i, r in root.items() if i == r}


def corpus(n, seed):
    """Texts, and copies of them with a few words changed, from nearly equal to below the bound."""
    r = random.Random(seed)
    word = lambda: "w%d" % r.randrange(3000)
    rows = []
    for i in range(n):
        text = [word() for _ in range(r.randint(1, 160))]
        if i % 2 and rows:
            text = rows[r.randrange(len(rows))][1].split()
            for _ in range(r.randint(1, 5)):
                text[r.randrange(len(text))] = word()
        rows.append((i, " ".join(text)))
    hub = [word() for _ in range(120)]
    for i in range(n, n + 70):
        text = list(hub)
        for _ in range(r.randint(0, 4)):
            text[r.randrange(120)] = word()
        rows.append((i, " ".join(text)))
    return [*rows, (n + 70, ""), (n + 71, " \n"), (n + 72, None), (n + 73, "one two"), (n + 74, "One two")]


@pytest.mark.parametrize("seed, sample", [(1, 8), (2, 1)])
def test_keep_one_is_the_plain_result(spark, monkeypatch, seed, sample):
    monkeypatch.setattr(resemblance, "SAMPLE", sample)
    rows = corpus(300, seed)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    kept = [r.doc_id for r in resemblance.keep_one(df).collect()]
    assert len(kept) == len(set(kept)) and set(kept) == plain(rows)


def test_sketches_differ_in_no_more_bits_than_sets():
    r = np.random.Generator(np.random.PCG64(5))
    for n in (1, 5, 200, 5000):
        x = np.unique(r.integers(0, 1 << 63, n, dtype=np.uint64))
        for k in (0, 1, n // 10, n):
            y = np.unique(np.r_[x[k:], r.integers(0, 1 << 63, k // 2, dtype=np.uint64)])
            bits = int.from_bytes(resemblance.sketch(x)) ^ int.from_bytes(resemblance.sketch(y))
            assert bits.bit_count() <= len(np.setxor1d(x, y))


def test_files_of_unlike_texts_with_one_passage(spark, monkeypatch):
    """A passage that is most of many short texts: they meet in long files, and few become pairs."""
    passage = " ".join("p%d" % i for i in range(30))
    rows = [(i, " ".join("x%d" % (i * 40 + k) for k in range(25)) + " " + passage) for i in range(60)]
    rows += [(100 + i, rows[i][1] + " y") for i in range(10)]
    monkeypatch.setattr(resemblance, "_frequent", lambda rows, shingle: np.empty(0, np.uint64))
    kept = [r.doc_id for r in resemblance.keep_one(spark.createDataFrame(rows, "doc_id long, text string")).collect()]
    assert set(kept) == plain(rows) == set(range(60))


def test_stage_drops_near_copies_that_are_many_bits_apart(spark):
    base = ["b%d" % i for i in range(150)]
    near = [w + "x" if i in (20, 70, 130) else w for i, w in enumerate(base)]
    far = [w + "y" if i % 15 == 0 else w for i, w in enumerate(base)]
    rows = [(1, " ".join(base)), (2, " ".join(near)), (3, " ".join(far))]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert {r.doc_id for r in corpus_pipeline.near_dedup(spark, df, "").collect()} == {1, 3} == plain(rows)


def test_keep_one_keeps_columns_and_ties(docs, none):
    kept = resemblance.keep_one(docs)
    assert kept.columns == docs.columns
    assert kept.filter(F.length(F.trim(F.coalesce("text", F.lit("")))) == 0).count() <= 1
    assert resemblance.keep_one(none).count() == 0


def test_stage_links_by_simhash_and_checks_the_links(spark, monkeypatch):
    """SimHash alone, without the join for the rest, drops a copy within its bits, and nothing that is unlike."""
    base = ["b%d" % i for i in range(400)]
    texts = [base, [*base[:-1], "z"], ["x"] * 60 + ["p", "q", "r", "s"], ["x"] * 60 + ["t", "u", "v", "w"], ["x"] * 61 + base[:9]]
    rows = [(i, " ".join(t)) for i, t in enumerate(texts)]
    prints = [simhash.fingerprint(t, resemblance.PRINTED) for _, t in rows]
    assert prints[2] == prints[3] == prints[4] and (prints[0] ^ prints[1]).bit_count() <= resemblance.APART
    df = spark.createDataFrame(rows, "doc_id long, text string")
    met = resemblance._met
    monkeypatch.setattr(resemblance, "_met", lambda entries, percent: met(entries, percent).limit(0))
    assert {r.doc_id for r in corpus_pipeline.near_dedup(spark, df, "").collect()} == {0, 2, 3, 4} == plain(rows)


def test_pairs_that_simhash_has_linked_are_not_compared_again(spark, monkeypatch):
    base = ["b%d" % i for i in range(400)]
    rows = [(0, " ".join(base)), (1, " ".join([*base[:-1], "z"])), (2, " ".join(w + "s" if i % 50 == 7 else w for i, w in enumerate(base)))]
    prints = [simhash.fingerprint(t, resemblance.PRINTED) for _, t in rows]
    assert [(prints[0] ^ p).bit_count() <= resemblance.APART for p in prints] == [True, True, False]
    similar, compared = resemblance._similar, []
    monkeypatch.setattr(resemblance, "_similar", lambda pairs, *more: (compared.append(pairs.distinct().count()), similar(pairs, *more))[1])
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert {r.doc_id for r in resemblance.keep_one(df).collect()} == {0} == plain(rows)
    assert compared == [1, 2]
