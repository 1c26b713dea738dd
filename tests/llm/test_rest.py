"""Quality, personal data, licences, mixing and the pipeline."""

import hashlib
import random
import re
from collections import Counter
from pathlib import Path

import duckdb
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from colframe.llm import licences, mixing, pii, pii_table, quality, registry

WORD = re.compile(r"[^\x20\x09-\x0D]+")
DATA = Path("/root/testdata/sf0.001")


def test_quality(docs, rows, none):
    want = []
    for r in rows:
        text = r[1] or ""
        w = WORD.findall(text)
        windows = Counter(tuple(w[k : k + 8]) for k in range(len(w) - 7))
        over = {k + j for k in range(len(w) - 7) if windows[tuple(w[k : k + 8])] > 1 for j in range(8)}
        some = [x for x in text.split("\n") if WORD.search(x)]
        want.append((r[0], len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text), len(some) - len(set(some)), len(over), len(w) < 20 or 100 * len(over) > 30 * len(w)))
    found = quality.judged(docs).select("row.doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept").collect()
    assert sorted((tuple(r)[:7] for r in found), key=str) == sorted(want, key=str)
    assert not any(r.kept and r.base_failed for r in found)
    kept = quality.keep(docs)
    assert kept.columns == docs.columns and kept.count() == sum(r.kept for r in found)
    assert quality.judged(none).count() == 0


def test_quality_lowers_words_and_knows_those_of_half_a_percent(spark):
    plain = " ".join(["tone"] * 3 + ["w%d" % i for i in range(397)])
    df = spark.createDataFrame([(1, plain, "en"), (2, plain.upper(), "en")], "doc_id long, text string, lang string")
    known = quality.references(df).filter("lang = 'en'").first().words
    assert "tone" in known and not any(w != w.lower() for w in known)
    got = {r.doc_id: r.word_distance for r in quality.judged(df).select("row.doc_id", "word_distance").collect()}
    assert got[1] == got[2] < 1e-6


def test_repeats_of_exactly_one_window(spark):
    texts = ["a b c d e f g h", "a b c d e f g h " * 2, "x a b c d e f g h y a b c d e f g h z", "a " * 9, "a b " * 7]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    got = {r.doc_id: r.n for r in df.select("doc_id", quality.repeat_words(quality.words_of(F.col("text"))).alias("n")).collect()}
    assert got == {0: 0, 1: 16, 2: 16, 3: 9, 4: 14}


@pytest.mark.skipif(not DATA.exists(), reason="no test tables")
def test_quality_keeps_the_good(spark):
    found = quality.judged(spark.read.parquet(str(DATA / "documents.parquet"))).select("row.doc_id", "kept", "base_failed")
    rows = found.join(spark.read.parquet(str(DATA / "labels.parquet")), "doc_id").collect()
    good = [r for r in rows if r.quality == 1 and not r.base_failed]
    assert good and sum(not r.kept for r in good) <= 0.02 * len(good)


def plain_spans(text):
    out = []
    for kind, pattern in enumerate((r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", r"[0-9]([\x20-]?[0-9])+", r"\+[0-9][\x20().0-9-]+[0-9]")):
        for m in re.finditer(pattern, text):
            digits = re.sub("[^0-9]", "", m[0])
            if (True, all(int(x) <= 255 for x in m[0].split(".")) if kind == 1 else False, 12 <= len(digits) <= 19 and pii.luhn(digits), 9 <= len(digits) <= 15)[kind]:
                out.append((m.start(), kind, m.end()))
    return sorted(out)


def test_patterns():
    r = random.Random(3)
    for _ in range(20000):
        text = "".join(r.choice("a1.@+- ()%_x9\n5,") for _ in range(r.randint(0, 30)))
        assert pii.base_spans(text) == plain_spans(text), text
    assert pii.base_spans("a" * 200000 + " " + "1" * 200000) == []


HELD_OUT = """
Please ring {phone|(303) 555-0112} or {phone|303.555.0113} today, 5 May 2020.
fax {phone|555-321-7788} and mail to {email|ops [at] example [dot] org}
Contact {email|lee (at) work.example} or {email|max.muster@example.de}!
from {ip|2001:db8:0:1::9} to {ip|2001:db8::ff} in 30 ms, 64 bytes
deny {ip|203[.]0[.]113[.]44} since 2019, allow {ip|10.20.30.40}
card {card|4539.1488.0343.6467} due 04/25, or {card|4539 1488 0343 6467}
api_key = "{secret|5baa61e4c9b93f3f0682250b6cf8331b7ee68fd8}" # set in 2021
password: {secret|S3cure!pass99}
token={secret|ghp_9aF3c0De71Bb52Xy84Zq10Lm36Np58Rs72Tu}
Mobile {phone|0172 555 9080}, after 18:00.
tel {phone|1-888-555-0142}; email {email|desk@office3}
The mail {email|x.y(at)post(dot)example(dot)com} is closed.
secret: "{secret|8xKq/2LmN0pQrStUvWxYz+1234567890abcdEFGH}"
Section 2.4.6, page 1023, of 15 June 1998; vol. 3-4.
It costs 12.50 to 14.75 for 3-5 items; 2000 sold in 2010.
The token of 1850 is worth 25 000 now.
build 10.2.33 failed after 3 600 s on 4 May
Meet at 12:30 on 2022-01-05 or 2022/01/06, gate B22.
Her 21st birthday, 3 cakes, 45 guests and 1 band.
a12 b7 c3 x99 2nd 10x 5% 7-8 9/10 #12 $5 3,5
"""


def test_field_on_held_out_text():
    """Each kind's recall and precision on text that the labelled table doesn't have, over the spans in the end."""
    lines = [pii_table.marked(x) for x in HELD_OUT.strip().split("\n")]
    texts = [t for t, _ in lines]
    base = [pii.base_spans(t) for t in texts]
    found = [{(a, e, pii.KINDS[k]) for a, k, e in b + m} for b, m in zip(base, pii.added_spans(texts, pii.model(), base))]
    for kind in pii.KINDS:
        want = {(i, *x) for i, (_, s) in enumerate(lines) for x in s if x[2] == kind}
        got = {(i, *x) for i, s in enumerate(found) for x in s if x[2] == kind}
        assert len(want & got) >= 0.75 * len(want) and len(want & got) >= 0.75 * len(got), (kind, want - got, got - want)
    assert not any(found[-7:])
    trained = {t for t, _ in map(pii_table.marked, pii_table.TABLE.strip().split("\n"))}
    assert not trained & set(texts)


def whole_labels(crf, words):
    """Labels of a text's words by Viterbi over all of them."""
    import numpy as np

    emit = np.array([crf.score(-1, words[t - 1] if t else "") + crf.score(0, w) + crf.score(1, words[t + 1] if t + 1 < len(words) else "") for t, w in enumerate(words)])
    emit[~np.array(pii.possible(words)), 1:] = -1e9
    best, came = crf.moves[0] + emit[0], []
    for e in emit[1:]:
        ways = best[:, None] + crf.moves
        came.append(ways.argmax(0))
        best = ways.max(0) + e
    path = [int((best + crf.moves[:, 0]).argmax())]
    for c in reversed(came):
        path.append(int(c[path[-1]]))
    return path[::-1]


@pytest.mark.parametrize("blank", [" ", "\n", " " * 300, "\t \n"])
def test_runs_decode_as_whole_texts(blank):
    """Words that can only be none cut a text into independent runs: the same labels as in one run, also over
    long gaps and beside long words."""
    crf = pii.model()
    texts = ["call (268) 555-6289 or +1 (468) 555-0333 now 10.0.0.1, mail me@x.org", "me [at] x [dot] org 12 [at] 3 a [dot] [at] b", "[at] a", "5 [dot]", "phone " + "x" * 500 + " 0171 555 2368 " + "y" * 500, "1" * 500 + " token 2"]
    texts += [" ".join(w for s, _ in pii_table.sentences()[i : i + 5] for w in s) for i in range(0, 70, 5)]
    for text in texts:
        words = text.split(" ")
        text, starts, at = blank.join(words), {}, 0
        for i, w in enumerate(words):
            starts[at] = i
            at += len(w) + len(blank)
        want = whole_labels(crf, words)
        runs = pii.runs_of(text)
        got = {starts[s]: int(y) for r, labels in zip(runs, crf.decode([x[:3] for x in runs])) for s, y in zip(r[3], labels)}
        assert sorted(got) == [i for i, p in enumerate(pii.possible(words)) if p]
        assert {i: want[i] for i in got} == got


def test_pii_table(spark, docs, rows, none):
    """Counts, digest and spans of whole rows against the plain patterns; the field's spans beside them."""
    more = [x for x, _ in map(pii_table.marked, pii_table.TABLE.strip().split("\n"))] + ["a@b.c d@e.f +12345678901 4111111111111111 1.2.3.4", None, "", "é" * 50 + " x@y.zz " * 3]
    df = docs.select("doc_id", "text", "kept", "key").union(spark.createDataFrame([(5000 + i, t, "x", "y") for i, t in enumerate(more)], "doc_id long, text string, kept string, key string"))
    texts = Counter((r[0], r[1]) for r in rows) + Counter((5000 + i, t) for i, t in enumerate(more))
    got = pii.spans(df).collect()
    assert len(got) == sum(texts.values()) and pii.spans(none).count() == 0
    want = Counter()
    for (i, t), n in texts.items():
        base = plain_spans(t or "")
        written = ",".join(f"{pii.KINDS[k]}:{a}:{e}" for a, k, e in base)
        counts = [sum(k == j for _, k, _ in base) for j in range(4)]
        want[i, *counts, hashlib.sha256(written.encode()).hexdigest()] += n
    assert Counter((r.doc_id, r.n_email, r.n_ip, r.n_card, r.n_phone, r.base_sha256) for r in got) == want
    for r in got:
        found = [x.split(":") for x in r.spans.split(",") if x]
        assert len(found) == r.n_spans == r.n_email + r.n_ip + r.n_card + r.n_phone + r.n_added
        order = [(int(a), pii.KINDS.index(k)) for k, a, _ in found]
        assert order == sorted(order)
    assert sum(r.n_added for r in got) >= 30


MIT = """MIT License

Permission is hereby granted, free of charge, to any person obtaining a copy
of this software and associated documentation files (the "Software"), to deal
in the Software without restriction, including without limitation the rights
to use, copy, modify, merge, publish, distribute, sublicense, and/or sell
copies of the Software, and to permit persons to whom the Software is
furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all
copies or substantial portions of the Software."""


BSD = """Copyright (c) 2020, Some Body
All rights reserved.

Redistribution and use in source and binary forms, with or without
modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this
   list of conditions and the following disclaimer.

2. Redistributions in binary form must reproduce the above copyright notice,
   this list of conditions and the following disclaimer in the documentation
   and/or other materials provided with the distribution.
"""
THIRD = """
3. Neither the name of Some Body, Inc. nor the names of its contributors may be used to
   endorse or promote products derived from this software without specific
   prior written permission.
"""
DISCLAIMED = """
THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR
IMPLIED WARRANTIES ARE DISCLAIMED."""
APACHE = """Copyright 2019 Some Body

Licensed under the Apache License, Version 2.0 (the "License");
you may not use this file except in compliance with the License.
You may obtain a copy of the License at

    http://www.apache.org/licenses/LICENSE-2.0

Unless required by applicable law or agreed to in writing, software
distributed under the License is distributed on an "AS IS" BASIS,
WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.
See the License for the specific language governing permissions and
limitations under the License."""
GNU = """    This program is free software: you can redistribute it and/or modify
    it under the terms of the GNU {}General Public License as published by
    the Free Software Foundation, either version {} of the License, or
    (at your option) any later version.

    This program is distributed in the hope that it will be useful,
    but WITHOUT ANY WARRANTY; without even the implied warranty of
    MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.  See the
    GNU {}General Public License for more details."""
MPL = """This Source Code Form is subject to the terms of the Mozilla Public
License, v. 2.0. If a copy of the MPL was not distributed with this
file, You can obtain one at https://mozilla.org/MPL/2.0/."""
ISC = """Copyright (c) 2021 Some Body
Permission to use, copy, modify, and/or distribute this software for any
purpose with or without fee is hereby granted, provided that the above
copyright notice and this permission notice appear in all copies."""


def commented(text, mark, first="", last=""):
    return first + "\n".join((mark + " " + x).rstrip() for x in text.split("\n")) + last


@pytest.mark.parametrize("wrap", [lambda t: t, lambda t: commented(t, " *", "/*\n", "\n */\nint main() {}"), lambda t: commented(t, "#"), lambda t: commented(t, "//"), lambda t: "before it.\n\n" + t + "\n\nafter it.", lambda t: t.replace("\n", "\r\n")])
def test_published_notices(spark, wrap):
    want = {
        MIT: "MIT:1", BSD + DISCLAIMED: "BSD-2-Clause:1", BSD + THIRD + DISCLAIMED: "BSD-3-Clause:1", APACHE: "Apache-2.0:1", MPL: "MPL-2.0:1", ISC: "ISC:1", GNU.format("", 3, ""): "GPL-3.0-or-later:1", GNU.format("", 2, "").replace(":", ";"): "GPL-2.0-or-later:1",
        GNU.format("Lesser ", 3, "Lesser "): "LGPL-3.0-or-later:1", GNU.format("Lesser ", 2.1, "Lesser ").replace("program", "library"): "LGPL-2.1-or-later:1", GNU.format("Affero ", 3, "Affero ").replace("This program", "The Name of It"): "AGPL-3.0-or-later:1",
        "SPDX-License-Identifier: BSD-3-Clause": "BSD-3-Clause:1", BSD.replace("1.", "*").replace("2.", "*"): "BSD-2-Clause:1", BSD.replace("1.", "(a)").replace("2.", "(b)") + THIRD.replace("3.", "(c)"): "BSD-3-Clause:1",
    }
    df = spark.createDataFrame([(i, wrap(t)) for i, t in enumerate(want)], "doc_id long, text string")
    assert {r.doc_id: r.licenses for r in licences.scan(df).collect()} == dict(enumerate(want.values()))


def test_near_misses(spark):
    texts = [BSD.replace("source code", "any code"), GNU.format("", 4, ""), MPL.replace("2.0", "1.1"), APACHE.replace("2.0", "1.1"), "The terms of the GNU General Public License apply to other files.", "Permission is hereby granted to enter the building.", MIT.replace("free of charge", "for a fee"), "licensed under the terms of its owner"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert {r.licenses for r in licences.scan(df).collect()} == {""}


def test_licence_sequences(spark):
    texts = [MIT, "x y\nReleased under the MIT License.\nmore", "Licensed under CC BY-NC 4.0. Licensed under CC BY-NC 4.0.", "the software is fine", None, "", MIT + "\n\n" + APACHE, (MIT + "\n\n") * 300]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: (r.n_sentences, r.licenses) for r in licences.scan(df).collect()}
    assert got == {0: (2, "MIT:1"), 1: (1, "MIT:1"), 2: (2, "CC-BY-NC-4.0:2"), 3: (0, ""), 4: (0, ""), 5: (0, ""), 6: (4, "Apache-2.0:1,MIT:1"), 7: (600, "MIT:300")}


def test_licence_cases(docs, none):
    assert licences.scan(docs).count() == docs.count() and licences.scan(none).count() == 0
    assert all(any(w in s for w in licences.STEMS) for s in licences.SENTENCES.values())
    assert len(set(licences.SENTENCES.values())) == len(licences.SENTENCES)


def plain_targets(sizes, weights=mixing.WEIGHTS, repeats=mixing.REPEATS):
    w = [weights[i % len(weights)] for i in range(len(sizes))]
    full = set()
    while True:
        rest = sum(sizes) - sum(repeats * sizes[i] for i in full)
        open_ = sum(x for i, x in enumerate(w) if i not in full)
        out = [float(repeats * s) if i in full else rest * w[i] / open_ for i, s in enumerate(sizes)]
        over = {i for i, s in enumerate(sizes) if i not in full and out[i] > repeats * s}
        if not over:
            return out
        full |= over


def plain_mix(found, block):
    """Target and words taken of each row, from rows ``(source, at, doc_id, size)``: only the order is the operator's."""
    names = sorted({r[0] for r in found}, key=lambda x: (x is None, x or ""))
    sizes = [sum(r[3] for r in found if r[0] == x) for x in names]
    wanted, out = plain_targets(sizes), []
    for source, size, target in zip(names, sizes, wanted):
        rows = sorted(r for r in found if r[0] == source) if source is not None else sorted((r for r in found if r[0] is None), key=lambda r: r[1])
        n = -(-size // block)
        quota = min(3 * n, round(target * n / size)) if size else 0
        times = Counter()
        for t in range(3):
            perm = mixing.permuted(mixing.np.arange(n), n, mixing.key_of(source, t)).tolist() if n else []
            times.update(perm[: max(0, min(n, quota - t * n))])
        at = 0
        for r in rows:
            out.append((r[2], r[3], size, target, sum(times[p // block] for p in range(at, at + r[3]))))
            at += r[3]
    return out


def test_targets(spark):
    sizes = [1000, 10, 500, 0]
    df = spark.createDataFrame([(i, "x " * n, f"s{i}") for i, n in enumerate(sizes)], "doc_id long, text string, source string")
    t = [r.target for r in mixing.Mix(df).plan.orderBy("sid").collect()]
    assert t == plain_targets(sizes) and abs(sum(t) - 1510) < 1e-9 and t[1] == 30


@pytest.mark.parametrize("small", [10_000, 0])
def test_mixing_is_the_plain_mix(docs, monkeypatch, small):
    monkeypatch.setattr(mixing, "SMALL", small)
    monkeypatch.setattr(mixing, "BUCKET_ROWS", 7)
    mix = mixing.Mix(docs, block=16)
    source = dict(mix.plan.select("sid", "source").collect())
    found = [(source[r.sid], tuple(r["at"]), r.doc_id, r["size"]) for r in mix.positions().collect()]
    got = Counter((r.doc_id, r["size"], r.source_size, round(r.target, 6), r.taken) for r in mix.taken().collect())
    assert got == Counter((d, n, s, round(t, 6), k) for d, n, s, t, k in plain_mix(found, 16))


def test_permutations():
    for n in (1, 2, 3, 7, 64, 1000):
        assert sorted(mixing.permuted(mixing.np.arange(n), n, 12345).tolist()) == list(range(n))


def test_draws_meet_quotas_and_follow_the_mix(spark, monkeypatch):
    monkeypatch.setattr(mixing, "SHARD_BLOCKS", 40)
    df = spark.createDataFrame([(i, "w " * 300, "abc"[i % 3]) for i in range(300)], "doc_id long, text string, source string")
    mix = mixing.Mix(df, block=16)
    slots = mix.slots().collect()
    quota = {r.sid: r.quota for r in mix.plan.collect()}
    assert Counter(s.sid for s in slots) == quota
    shards = Counter(s.shard for s in slots)
    assert len(shards) > 100 and max(shards.values()) < 100
    places = {(s.shard, s.sid): [] for s in slots}
    for s in slots:
        places[s.shard, s.sid].append(s.place)
    assert all(sorted(v) == list(range(len(v))) for v in places.values())
    # a shard's counts are like a multinomial draw: chi-square of a whole table about its degrees of freedom
    total = sum(quota.values())
    chi = sum((len(places.get((k, i), [])) - n * q / total) ** 2 / (n * q / total) for k, n in shards.items() for i, q in quota.items())
    free = (len(shards) - 1) * (len(quota) - 1)
    assert abs(chi - free) < 5 * (2 * free) ** 0.5


def test_mixing(docs, rows, none):
    mix = mixing.Mix(docs, block=16)
    got = mix.taken().collect()
    assert sorted((r.doc_id, r["size"]) for r in got if r.doc_id is not None) == sorted((r[0], len(WORD.findall(r[1] or ""))) for r in rows if r[0] is not None)
    assert all(0 <= r.taken <= 3 * r["size"] for r in got)
    by = Counter()
    for r in got:
        by[r.source_size, r.target] += r.taken
    assert all(abs(v - t) <= 32 + 0.02 * t for (_, t), v in by.items())
    assert sorted(map(tuple, mixing.Mix(docs.repartition(2), block=16).taken().collect()), key=str) == sorted(map(tuple, got), key=str)
    mixed = mix.mixed()
    assert mixed.columns == docs.columns
    assert sum(len(WORD.findall(r.text)) for r in mixed.collect()) == sum(r.taken for r in got)
    assert sum(r.words for r in mix.packed().collect()) == sum(r.taken for r in got)
    assert mixing.Mix(none).taken().count() == 0 and mixing.Mix(none).mixed().count() == 0


def test_buckets_do_not_matter_for_sums(docs, monkeypatch):
    monkeypatch.setattr(mixing, "BUCKET_ROWS", 3)
    mix = mixing.Mix(docs, block=16)
    spans = sorted((r.sid, r.start, r["size"]) for r in mix.positions().filter("size > 0").collect())
    for a, b in zip(spans, spans[1:]):
        assert a[0] != b[0] or a[1] + a[2] == b[1]


def test_pipeline(spark, docs):
    df = docs.select("doc_id", "text", "lang", "source", "n_chars")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, df, "")
        assert out.columns == df.columns
        df = spark.createDataFrame(out.collect(), out.schema)
    last = corpus_pipeline.STAGES[-1][1](spark, df, "").collect()
    assert len(last) == df.count() and all(r.round_trip and r.n_tokens == len(r.ids) for r in last)
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality rules", "line dedup", "simhash near-dedup", "mixing", "bpe"]


@pytest.mark.skipif(not DATA.exists(), reason="no test tables")
@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_sql(spark, name):
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{DATA}/documents.parquet'")
    df, sql = registry.QUERIES[name](spark, str(DATA)), con.sql(registry.ORACLES[name])
    order = sorted(df.columns)
    assert order == sorted(sql.columns)
    assert sorted(map(str, (tuple(r[c] for c in order) for r in df.collect()))) == sorted(map(str, sql.select(", ".join(f'"{c}"' for c in order)).fetchall()))


def test_scratch_goes(spark, docs):
    from pathlib import Path as P

    from colframe.llm import common

    common.discard(spark)
    df = common.written(docs.select("doc_id"), "some")
    path = P(common._made[spark.sparkContext.applicationId][0].removeprefix("file://").removeprefix("file:"))
    assert df.count() == docs.count() and path.exists()
    assert common.discard(spark) == 1 and not path.exists() and common.discard(spark) == 0
