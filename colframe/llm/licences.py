"""Operator 8: licence scans by sentence rules, in DataFrame functions only.

Method: a text is cut into sentences, each is normalised and mapped to the
identifier of a known licence sentence, or to none.  The sequence of
identifiers is matched against the licence rules in their order, longest
first; a rule takes its sentences, so a shorter rule doesn't count them again.
Sentences of a rule must follow each other; what stands between them in
published texts (list numbers, the address where a licence can be had) is left
out of the sequence.

Before the cut, the text is lower-cased, signs of comments at line ends and
beginnings go, list marks and copyright lines become ends of a paragraph, and
the point of "v. 2.0" goes.  A sentence ends at a point, question or
exclamation mark before white space, at an empty line, or at a colon before a
list mark.  Other characters than a-z and 0-9 become one space; the holder's
name in the BSD licence's last condition and a program's name in the notices of
the GNU licences become the usual ones.

Since licence texts are wrapped at line ends while notices stand on lines of
their own, a text is read twice: with line ends inside sentences, and with
each as the end of one.  A rule counts as often as the reading that has it
more often says.

The known sentences are literals in the plan: their number is that of the
lists below, whatever the corpus.

Defined cases: NULL text: no sentences; whole texts are read, however long;
of rules with equal numbers of sentences the first in the list goes first;
repeated rows are scanned each; an empty table gives an empty table; other
columns are not read.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from colframe.llm.common import documents, let


def plain(text: str) -> str:
    """A fixed value as it stands in normalised texts."""
    return " ".join("".join(c if c.isascii() and c.isalnum() else " " for c in text.lower()).split())


#: Sentences of public licences and notices.
SENTENCES = {
    "mit-grant": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions",
    "mit-notice": "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software",
    "mit-warranty": "The Software is provided as is, without warranty of any kind, express or implied, including but not limited to the warranties of merchantability, fitness for a particular purpose and noninfringement",
    "mit-liability": "In no event shall the authors or copyright holders be liable for any claim, damages or other liability, whether in an action of contract, tort or otherwise, arising from, out of or in connection with the Software or the use or other dealings in the Software",
    "isc-grant": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies",
    "isc-grant-and": "Permission to use, copy, modify, and distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies",
    "bsd-grant": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
    "bsd-source": "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer",
    "bsd-binary": "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution",
    "bsd-names": "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission",
    "apache-notice": "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License",
    "apache-short": "Licensed under the Apache License, Version 2.0",
    "apache-warranty": "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an as is basis, without warranties or conditions of any kind, either express or implied",
    "gpl3-notice": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version",
    "gpl2-notice": "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version",
    "gpl2-only-notice": "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License version 2 as published by the Free Software Foundation",
    "lgpl3-notice": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version",
    "lgpl21-notice": "This program is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version",
    "agpl3-notice": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version",
    "gpl3-short": "This work is licensed under the GNU General Public License version 3",
    "gpl-warranty": "This program is distributed in the hope that it will be useful, but without any warranty; without even the implied warranty of merchantability or fitness for a particular purpose",
    "mpl2-notice": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0",
    "unlicense": "This is free and unencumbered software released into the public domain",
    "zlib-grant": "Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions",
    "epl2-notice": "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at https://www.eclipse.org/legal/epl-2.0/",
    "epl2-notice-http": "This program and the accompanying materials are made available under the terms of the Eclipse Public License v2.0 which accompanies this distribution, and is available at http://www.eclipse.org/legal/epl-v20.html",
    "bsl-notice": "Distributed under the Boost Software License, Version 1.0",
    "bsl-grant": "Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the Software) to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative works of the Software, and to permit third-parties to whom the Software is furnished to do so, all subject to the following",
    "cc0": "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work",
}
#: What stands between the sentences of a rule in published texts, or before and after them.
BETWEEN = (
    "The MIT License", "MIT License", "The MIT License (MIT)", "ISC License", "BSD 2-Clause License", "BSD 3-Clause License", "All rights reserved", "You may obtain a copy of the License at", "http://www.apache.org/licenses/LICENSE-2.0", "https://www.apache.org/licenses/LICENSE-2.0",
    "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0", "You may obtain a copy of the License at https://www.apache.org/licenses/LICENSE-2.0", "or (at your option) any later version",
)
#: Identifiers of licences, and how short notices name them.
NAMES = {
    "MIT": ("MIT",), "ISC": ("ISC",), "Apache-2.0": ("Apache 2.0", "Apache License 2.0"), "BSD-2-Clause": ("BSD 2-Clause",), "BSD-3-Clause": ("BSD 3-Clause",), "MPL-2.0": ("Mozilla Public License 2.0", "MPL 2.0"), "GPL-2.0-only": (), "GPL-2.0-or-later": (), "GPL-3.0-only": ("GNU General Public License v3.0", "GPLv3", "GPL 3.0"),
    "GPL-3.0-or-later": (), "LGPL-2.1-only": (), "LGPL-2.1-or-later": (), "LGPL-3.0-only": ("LGPLv3",), "LGPL-3.0-or-later": (), "AGPL-3.0-only": ("AGPLv3",), "AGPL-3.0-or-later": (), "Unlicense": ("Unlicense",), "Zlib": ("zlib",), "EPL-2.0": ("Eclipse Public License 2.0",), "BSL-1.0": ("Boost Software",), "CC0-1.0": ("CC0 1.0",),
}
#: The Creative Commons licences of version 4.0.
CREATIVE_COMMONS = {"CC-BY-4.0": "Attribution", "CC-BY-SA-4.0": "Attribution-ShareAlike", "CC-BY-NC-4.0": "Attribution-NonCommercial", "CC-BY-NC-SA-4.0": "Attribution-NonCommercial-ShareAlike", "CC-BY-ND-4.0": "Attribution-NoDerivatives", "CC-BY-NC-ND-4.0": "Attribution-NonCommercial-NoDerivatives"}
#: The rules, a licence and the sentences that follow each other; longer ones come first.
RULES = [
    ("MIT", ("mit-grant", "mit-notice", "mit-warranty", "mit-liability")),
    ("BSD-3-Clause", ("bsd-grant", "bsd-source", "bsd-binary", "bsd-names")),
    ("BSD-2-Clause", ("bsd-grant", "bsd-source", "bsd-binary")),
    ("Apache-2.0", ("apache-notice", "apache-warranty")),
    ("GPL-3.0-or-later", ("gpl3-notice", "gpl-warranty")),
    ("GPL-2.0-or-later", ("gpl2-notice", "gpl-warranty")),
    ("GPL-2.0-only", ("gpl2-only-notice", "gpl-warranty")),
    ("LGPL-3.0-or-later", ("lgpl3-notice", "gpl-warranty")),
    ("LGPL-2.1-or-later", ("lgpl21-notice", "gpl-warranty")),
    ("AGPL-3.0-or-later", ("agpl3-notice", "gpl-warranty")),
    ("MIT", ("mit-grant", "mit-notice")),
    ("ISC", ("isc-grant",)),
    ("ISC", ("isc-grant-and",)),
    ("Apache-2.0", ("apache-notice",)),
    ("Apache-2.0", ("apache-short",)),
    ("GPL-3.0-or-later", ("gpl3-notice",)),
    ("GPL-2.0-or-later", ("gpl2-notice",)),
    ("GPL-2.0-only", ("gpl2-only-notice",)),
    ("LGPL-3.0-or-later", ("lgpl3-notice",)),
    ("LGPL-2.1-or-later", ("lgpl21-notice",)),
    ("AGPL-3.0-or-later", ("agpl3-notice",)),
    ("GPL-3.0-only", ("gpl3-short",)),
    ("MPL-2.0", ("mpl2-notice",)),
    ("Unlicense", ("unlicense",)),
    ("Zlib", ("zlib-grant",)),
    ("EPL-2.0", ("epl2-notice",)),
    ("EPL-2.0", ("epl2-notice-http",)),
    ("BSL-1.0", ("bsl-notice",)),
    ("BSL-1.0", ("bsl-grant",)),
    ("CC0-1.0", ("cc0",)),
]


def _notices() -> dict[str, tuple[str, str]]:
    """Short notices and tags: an identifier, the licence and the sentence of each."""
    out = {f"spdx-{k}": (k, f"SPDX-License-Identifier: {k}") for k in (*NAMES, *CREATIVE_COMMONS)}
    for k, names in NAMES.items():
        for n in names:
            for i, start in enumerate(("Released under the", "Licensed under the", "Distributed under the", "This project is licensed under the", "This software is released under the")):
                out[f"notice-{n}-{i}"] = (k, f"{start} {n} License")
                if n.endswith("License") or "License " in n:
                    out[f"notice-{n}-{i}-name"] = (k, f"{start} {n}")
    for k, words in CREATIVE_COMMONS.items():
        out[f"{k}-short"] = (k, "Licensed under " + k.replace("CC-", "CC ").replace("-4.0", " 4.0"))
        out[f"{k}-work"] = (k, f"This work is licensed under a Creative Commons {words} 4.0 International License")
    return out


SENTENCES |= {name: sentence for name, (_, sentence) in _notices().items()}
SENTENCES = {name: plain(sentence) for name, sentence in SENTENCES.items()}
RULES += [(licence, (name,)) for name, (licence, _) in _notices().items()]
LICENCES = tuple(sorted({name for name, _ in RULES}))
#: Every known sentence has one of these; letters that stand together there do so in the text.
STEMS = ("licens", "permission", "copyright", "software", "redistribution", "warranty")
#: Before the cut, in order: a pattern of lower-cased text and what it becomes.
CLEANED = (
    (r"(^|\n)[ \t]*(?:/\*+|\*+/|//+|#+|\*+|;+|--+|%+|<!-+)", "\n"),
    (r"\*+/|-->", "\n"),
    (r"(^|\n)[ \t]*(?:\(?[0-9]{1,2}[.)]|\(?[a-z][.)]|-)[ \t]+", "\n\n"),
    (r"(^|\n)[ \t]*(?:copyright[ \t]+(?:\(c\)|[0-9]{4})|\(c\)[ \t]*[0-9]{4})[^\n]*", "\n\n"),
    (r"\bv\.[ \n\t]*([0-9])", "v {1}"),
    (r"\b(inc|ltd|corp|co)\.([ \n\t]+nor\b)", "{1}{2}"),
)
#: Between sentences; in the second reading at any line end too.
_END = r"[.!?][\"')]*[ \t\n\x0b\x0c\r]+|\n[ \t\r]*\n|:[ \t\n\r]+\(?[0-9a-z][.)][ \t\n\r]+"
ENDS = (_END, _END + r"|\n")
#: Of a normalised sentence: names that differ from text to text.
USUAL = (
    (r"^[a-z0-9 ]+ is (free software you can|distributed in the hope)", "this program is {1}"),
    (r"^(?:neither the names? of .+ nor the names of (?:its|other) contributors|the name of the author) may(?: not)? be used", "neither the name of the copyright holder nor the names of its contributors may be used"),
)
#: Longest sentence that isn't one: a list number or mark.
MARK = 2
_KNOWN = tuple(SENTENCES)
_BETWEEN = tuple(dict.fromkeys(map(plain, BETWEEN)))


def code(name: str) -> str:
    return f"<{_KNOWN.index(name) + 1}>"


def sequence(text: Column, end: str) -> Column:
    """The identifiers of a text's sentences as a string, a point for each that is not known."""
    known, between = F.array(*map(F.lit, SENTENCES.values())), F.array(*map(F.lit, _BETWEEN))
    each = F.split(F.regexp_replace(F.regexp_replace(text, end, "\x01"), "[^a-z0-9\x01]+", " "), "\x01")

    def usual(s: Column) -> Column:
        for pattern, to in USUAL:
            s = F.regexp_replace(s, pattern, to.replace("{1}", "$1"))
        return s

    def one(s: Column) -> Column:
        skipped = (F.length(s) <= MARK) | F.array_contains(between, s)
        name = lambda at: F.when(at == 0, F.lit(".")).otherwise(F.concat(F.lit("<"), at.cast("string"), F.lit(">")))
        return F.when(skipped, F.lit("")).otherwise(let(F.array_position(known, s), name))

    return F.array_join(F.transform(each, lambda s: let(usual(F.trim(s)), one)), "")


def cleaned(text: Column) -> Column:
    text = F.lower(text)
    for pattern, to in CLEANED:
        text = F.regexp_replace(text, pattern, to.replace("{1}", "$1").replace("{2}", "$2"))
    return text


def counts(ids: Column) -> Column:
    """How often each of ``LICENCES`` is matched by its rules in a sequence of identifiers."""

    marks = ["".join(map(code, sentences)) for _, sentences in RULES]
    rules = F.array(*(F.struct(F.lit(m).alias("mark"), F.lit(LICENCES.index(name)).alias("licence"), F.lit(len(m) - 1).alias("shorter")) for m, (name, _) in zip(marks, RULES)))

    def step(so_far: Column, rule: Column) -> Column:
        def counted(rest: Column) -> Column:
            n = ((F.length(so_far["left"]) - F.length(rest)) / rule["shorter"]).cast("int")
            return F.struct(rest.alias("left"), F.transform(so_far["n"], lambda c, i: c + F.when(i == rule["licence"], n).otherwise(F.lit(0))).alias("n"))

        return let(F.replace(so_far["left"], rule["mark"], F.lit(".")), counted)

    none = F.array(*(F.lit(0) for _ in LICENCES))
    return F.when(F.instr(ids, "<") == 0, none).otherwise(F.aggregate(rules, F.struct(ids.alias("left"), none.alias("n")), step)["n"])


def scan(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``(key, n_sentences, licenses, n_licenses)``: known sentences, licences with their counts, and how many."""
    t = F.coalesce(F.col(text), F.lit(""))
    hinted = F.when(let(F.lower(t), lambda x: reduce(lambda a, b: a | b, (F.contains(x, F.lit(w)) for w in STEMS))), t).otherwise(F.lit(""))
    rows = df.select(F.col(key), hinted.alias("hinted"))
    rows = rows.select(F.col(key), cleaned(F.col("hinted")).alias("cleaned"))
    t = F.col("cleaned")
    rows = rows.select(F.col(key), F.transform(F.array(*map(F.lit, (0, 1))), lambda i: F.when(i == 0, sequence(t, ENDS[0])).otherwise(sequence(t, ENDS[1]))).alias("ids"))
    each = F.transform("ids", counts)
    most = let(each, lambda c: F.zip_with(F.get(c, F.lit(0)), F.get(c, F.lit(1)), lambda a, b: F.greatest(a, b)))
    found = let(most, lambda c: F.filter(F.arrays_zip(F.array(*map(F.lit, LICENCES)).alias("name"), c.alias("n")), lambda x: x["n"] > 0))
    rows = rows.select(key, F.array_max(F.transform("ids", lambda x: F.length(x) - F.length(F.replace(x, F.lit("<"), F.lit(""))))).cast("long").alias("n_sentences"), found.alias("found"))
    return rows.select(key, "n_sentences", F.array_join(F.transform("found", lambda x: F.concat(x["name"], F.lit(":"), x["n"].cast("string"))), ",").alias("licenses"), F.size("found").cast("long").alias("n_licenses"))


def op8_licences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every whole text of ``documents``: the licences that its sentences state."""
    return scan(documents(spark, sf_dir))


def _sql() -> str:
    quoted = lambda x: "'" + x.replace("'", "''") + "'"
    listed = lambda xs: "[" + ", ".join(map(quoted, xs)) + "]"
    swap = lambda x, pattern, to: f"regexp_replace({x}, {quoted(pattern)}, {quoted(to.replace('{1}', chr(92) + '1').replace('{2}', chr(92) + '2'))}, 'g')"
    clean = reduce(lambda x, c: swap(x, *c), CLEANED, "lower(t)")
    sentence = reduce(lambda x, c: swap(x, *c), USUAL, "trim(s)")

    def reading(end: str) -> str:
        cut = f"regexp_replace(regexp_replace(c, {quoted(end)}, chr(1), 'g'), '[^a-z0-9\\x01]+', ' ', 'g')"
        return f"list_transform(list_transform(string_split({cut}, chr(1)), lambda s: {sentence}), lambda s: CASE WHEN length(s) <= {MARK} OR list_contains({listed(_BETWEEN)}, s) THEN -1 ELSE coalesce(list_position({listed(SENTENCES.values())}, s), 0) END)"

    joined = "coalesce(array_to_string(list_transform({}, lambda i: CASE WHEN i = -1 THEN '' WHEN i = 0 THEN '.' ELSE '<' || i || '>' END), ''), '')"
    # rules of several sentences one after the other, then those of one, which can't take from each other
    longer, steps = [r for r in RULES if len(r[1]) > 1], []
    columns = {x: [] for x in "ab"}
    for i, (name, sentences) in enumerate(longer):
        mark = "".join(map(code, sentences))
        steps.append(f"s{i + 1} AS (SELECT *, " + ", ".join(f"replace({x}{i}, '{mark}', '.') AS {x}{i + 1}" for x in "ab") + f" FROM s{i})")
        for x in "ab":
            columns[x].append((name, f"(length({x}{i}) - length({x}{i + 1})) // {len(mark) - 1}"))
    n = len(longer)
    for name, sentences in RULES:
        if len(sentences) == 1:
            for x in "ab":
                columns[x].append((name, f"(length({x}{n}) - length(replace({x}{n}, '{code(sentences[0])}', ''))) // {len(code(sentences[0]))}"))
    each = []
    for k in LICENCES:
        a, b = (" + ".join(c for m, c in columns[x] if m == k) for x in "ab")
        each.append(f"{{'name': '{k}', 'n': greatest({a}, {b})}}")
    return f"""WITH s AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
c AS (SELECT doc_id, {clean} AS c FROM s),
ids AS (SELECT doc_id, {reading(ENDS[0])} AS x, {reading(ENDS[1])} AS y FROM c),
s0 AS (SELECT doc_id, {joined.format('x')} AS a0, {joined.format('y')} AS b0, greatest(len(list_filter(x, lambda i: i > 0)), len(list_filter(y, lambda i: i > 0))) AS n_sentences FROM ids),
{', '.join(steps)},
f AS (SELECT doc_id, n_sentences, list_filter([{', '.join(each)}], lambda z: z.n > 0) AS found FROM s{n})
SELECT doc_id, CAST(n_sentences AS BIGINT) AS n_sentences, coalesce(array_to_string(list_transform(found, lambda z: z.name || ':' || CAST(z.n AS BIGINT)), ','), '') AS licenses, CAST(len(found) AS BIGINT) AS n_licenses FROM f"""


ORACLE = _sql()
