"""Operator 4: near-duplicate lines by a segment-partition edit join, in DataFrame functions only.

Edits are of words: a line is near another if at most ``THRESHOLD`` words are
put in, left out or replaced between them, and both have ``LEAST_WORDS`` words
or more, so that an edit is a tenth of the line at most.  A line is removed if
an equal one, or a near one of another text, stands earlier (by doc_id, then
line); what is removed is judged on the input.  Lines are compared without
outer blanks; blank lines stay.

Method: a line is cut into ``threshold + 1`` segments of words.  If two lines
are within ``threshold`` edits, one segment of the shorter stands unchanged in
the longer, near its place: so each line files its segments in an index by
segment number and line length, and probes the indexes of its own length and of
up to ``threshold`` shorter ones with the substrings that the multi-match-aware
rule leaves.  Lines that meet are verified by a banded bit-parallel edit
distance over their words, one word of ``2 * threshold + 2`` bits per column.

An index entry in which over ``DENSE`` different lines meet (variants of one
line, or a common beginning of unlike ones) is not joined with itself.  The
part of its lines that the entry leaves open is cut again, into ``CUTS``
segments, all but one of which stand unchanged in a line one edit away; so the
lines are filed by all that is outside of each segment, and so on with what is
still crowded, until the open part is a word.  Lines that differ in that word
alone are all near each other, and one that has a word more is near those that
have one of its two: that takes the least place of each file and no pairs.  What
is outside is known by two 64-bit hashes there.

Equal lines are one node throughout, however often they occur, and what is
counted by key is counted before it is sent.  The texts of lines that met are
looked up by their hashes, which are sent to all tasks while they are ``SMALL``
in number and meet the lines in a shuffle beyond that.  Whole texts are moved
once, to write what is kept.

Defined cases: NULL text stays NULL and has no lines; NULL ids come last in
order; rows with equal id and text have the same place and keep the same
lines; very long texts, and texts of one very long line, are read whole, in
time and memory linear in them; an empty table gives an empty table; other
columns are carried along.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from colframe.llm.common import BLANKS, documents, fresh, let, words_of, written

#: Most edits (of words) between near-duplicate lines.
THRESHOLD = 1
#: Words of a line that may differ in an edit; lines with fewer are only compared for equality.
LEAST_WORDS = 10
#: Different lines that may meet in one index entry and still be compared with each other.
DENSE = 32
#: Segments that the open part of a crowded entry's lines is cut into.
CUTS = 8
#: Line hashes (of 8 bytes) that may be sent to all tasks.
SMALL = 2_000_000


def segment_bounds(length: Column, threshold: int) -> list[tuple[Column, Column]]:
    """Start (from 0) and length of each segment of a line: the last ones are longer by one where it doesn't divide."""
    parts = threshold + 1
    short = F.floor(length / parts).cast("int")
    longer = length - short * parts
    out, start = [], F.lit(0)
    for i in range(parts):
        size = short + F.when(F.lit(parts - i) <= longer, F.lit(1)).otherwise(F.lit(0))
        out.append((start, size))
        start = start + size
    return out


def filed(words: Column, length: Column, threshold: int) -> list[tuple[Column, bool]]:
    """Index entries and probes of a line of words: ``(key, probe)``; key hashes segment number, length and words."""
    entries = []
    for shorter in range(threshold + 1):
        for i, (start, size) in enumerate(segment_bounds(length - shorter, threshold), 1):
            left, right = max(-(i - 1), shorter - (threshold + 1 - i)), min(i - 1, shorter + threshold + 1 - i)
            for shift in range(left, right + 1):
                key = F.xxhash64(F.slice(words, start + shift + 1, size), F.lit(i), length - shorter)
                entries.append((key, shorter > 0 or shift != 0))
    return entries


def distance_within(a: Column, b: Column, threshold: int) -> Column:
    """Whether two arrays are within ``threshold`` edits: banded bit-parallel columns over ``b``.

    Bit ``k`` of a word stands for row ``j + threshold - width + 1 + k`` in column ``j``: the band moves down
    with the column.  The distance is followed down the lowest diagonal to the last row, then along it.  Both
    must have more than ``threshold`` elements.
    """
    width = 2 * threshold + 2
    ones, top = (1 << width) - 1, 1 << width - 1
    word = lambda n: F.lit(n).cast("bigint")
    flip = lambda x: x.bitwiseXOR(word(ones))

    def column(s: Column, j: Column) -> Column:
        c = F.get(b, j)
        match = word(0)
        for k in range(width):
            row = j + (threshold - width + 1 + k)
            match = match + F.when((row >= 0) & (F.get(a, F.greatest(row, F.lit(0))) == c), word(1 << k)).otherwise(word(0))
        vp, vn = s["vp"], s["vn"]

        def rest(d0: Column, hp: Column, hn: Column) -> Column:
            down = F.shiftright(d0, 1)
            on = F.size(a) - threshold  # columns before the last row comes into the band's lowest bit
            across = F.call_function("shiftright", word(top), F.least(j - on + 1, F.lit(width - 1)))
            step = F.when(j < on, F.when(d0.bitwiseAND(word(top)) == 0, 1).otherwise(0)).otherwise(F.when(hp.bitwiseAND(across) != 0, 1).when(hn.bitwiseAND(across) != 0, -1).otherwise(0))
            return F.struct(hn.bitwiseOR(flip(down.bitwiseOR(hp))).alias("vp"), down.bitwiseAND(hp).alias("vn"), (s["dist"] + step).alias("dist"))

        sum_ = lambda m: (m.bitwiseAND(vp) + vp).bitwiseAND(word(ones)).bitwiseXOR(vp).bitwiseOR(m).bitwiseOR(vn)
        return let(let(match, sum_), lambda d0: rest(d0, vn.bitwiseOR(flip(d0.bitwiseOR(vp))), d0.bitwiseAND(vp)))

    start = F.struct(word(ones ^ (1 << width - threshold - 1) - 1).alias("vp"), word(0).alias("vn"), F.lit(threshold).alias("dist"))
    found = F.aggregate(F.sequence(F.lit(0), F.size(b) - 1), start, column)["dist"] <= threshold
    return F.when(F.abs(F.size(a) - F.size(b)) > threshold, F.lit(False)).otherwise(found)


def line_table(df: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """``(doc, row, line, words, h, h2)`` of every line that isn't blank; ``row`` hashes the text, ``h`` and ``h2`` the line."""
    each = df.select(F.col(key).alias("doc"), F.xxhash64(text).alias("row"), F.posexplode(F.split(text, "\n")).alias("line", "raw"))
    each = each.withColumn("words", F.btrim("raw", F.lit(BLANKS))).filter(F.length("words") > 0)
    return each.select("doc", "row", "line", "words", F.xxhash64("words").alias("h"), F.xxhash64(F.lit(1), "words").alias("h2"))


def _index(lines: DataFrame, least: int) -> tuple[DataFrame, int]:
    """``(key, h, entry, guest)`` of each different line with enough words, once, and their number; guests probe a shorter line's entry."""
    # words are cut out once a line, by a generator that isn't merged into the filter on it
    cut = lines.select("h", F.explode(F.array(words_of(F.col("words")))).alias("x")).filter(F.size("x") >= least)
    keys = filed(F.col("x"), F.size("x"), THRESHOLD)
    once = cut.select("h", *(k.alias(f"k{i}") for i, (k, _) in enumerate(keys))).groupBy("h").agg(*(F.min(f"k{i}").alias(f"k{i}") for i in range(len(keys))))
    once = written(once, "index")
    each = F.array(*(F.struct(F.col(f"k{i}").alias("key"), F.lit(i).alias("entry"), F.lit(probe).alias("guest")) for i, (_, probe) in enumerate(keys)))
    return once.select("h", F.explode(each).alias("e")).select("e.key", "h", "e.entry", "e.guest"), once.count() * len(keys)


def _met(files: DataFrame, rows: int, dense: int) -> tuple[DataFrame, DataFrame]:
    """Of that many rows, pairs ``(a, b)`` of lines ``h`` that meet in a file ``key``, and the rows of files with too many to be paired."""
    keys = files.groupBy("key").agg(F.count("*").alias("n"), F.min("guest").alias("guests")).filter("n > 1 and not guests")
    keys = written(keys.select("key", "n"), "keys", rows // 2)
    few = files.join(keys.filter(F.col("n") <= dense), "key").groupBy("key").agg(F.collect_list(F.when(~F.col("guest"), F.col("h"))).alias("own"), F.collect_list("h").alias("every"))
    pair = lambda a, b: F.struct(F.least(a, b).alias("a"), F.greatest(a, b).alias("b"))
    pairs = few.select(F.explode(F.flatten(F.transform("own", lambda a: F.transform("every", lambda b: pair(a, b))))).alias("x")).select("x.a", "x.b").filter("a != b")
    many = written(files.join(keys.filter(F.col("n") > dense).select("key"), "key").drop("key"), "crowded", rows)
    return written(pairs.distinct(), "pairs", rows), many


def _only(lines: DataFrame, found: DataFrame) -> DataFrame:
    """The lines with a hash in ``found (h)``: sent to all tasks if it is small, else met in a shuffle."""
    small = found.count() <= SMALL
    return lines.join(F.broadcast(found) if small else found.hint("shuffle_merge"), "h", "left_semi")


def _told(lines: DataFrame, asked: DataFrame, rows: int) -> DataFrame:
    """``(h, h2, at, words)`` of the lines with a hash in ``asked (h)``: their first place and their text."""
    place = F.struct(F.col("doc").isNull().alias("no"), "doc", "row", "line")
    asked = written(asked.distinct(), "asked", rows)
    return written(_only(lines, asked).groupBy("h", "h2").agg(F.min(place).alias("at"), F.first("words").alias("words")), "told", 4 * asked.count())


def _near_pairs(told: DataFrame, pairs: DataFrame) -> DataFrame:
    """``(h, h2)`` of the later line of each pair that is near."""
    a, b = (told.select(*(F.col(c).alias(f"{c}_{s}") for c in ("h", "h2", "at", "words"))) for s in "ab")
    both = pairs.join(a, F.col("a") == F.col("h_a")).join(b, F.col("b") == F.col("h_b"))
    # here too, once a pair
    words = F.explode(F.array(F.struct(words_of(F.col("words_a")).alias("x"), words_of(F.col("words_b")).alias("y"))))
    near = both.select("h_a", "h2_a", "at_a", "h_b", "h2_b", "at_b", words.alias("w")).filter(distance_within(F.col("w.x"), F.col("w.y"), THRESHOLD))
    later = F.when(F.col("at_a") > F.col("at_b"), F.struct(F.col("h_a").alias("h"), F.col("h2_a").alias("h2"))).otherwise(F.struct(F.col("h_b").alias("h"), F.col("h2_b").alias("h2")))
    return near.select(later.alias("x")).select("x.h", "x.h2")


def _opened(many: DataFrame, told: DataFrame) -> DataFrame:
    """``(h, guest, size, lo, hi)`` of crowded entries: what they leave open, in places of a line of ``size`` words."""
    many = many.join(told.select("h", F.size(words_of(F.col("words"))).alias("size")), "h")
    many = many.withColumn("size", F.col("size") - F.col("guest").cast("int"))
    half = (F.col("size") / 2).cast("int")
    first = F.col("entry") % 2 == 0  # entries are those of the first and second half, of this length and of the shorter one
    return many.select("h", "guest", "size", F.when(first, half).otherwise(0).alias("lo"), F.when(first, F.col("size")).otherwise(half).alias("hi"))


def _outside(seed: int) -> Column:
    """A hash of the words before and after the open part; a guest's open part is longer by a word."""
    after = F.col("size") - F.col("hi")
    return F.xxhash64(F.lit(seed), F.col("size"), F.col("lo"), F.slice("w", F.lit(1), F.col("lo")), F.slice("w", F.size("w") - after + 1, after))


def _cut(opened: DataFrame, told: DataFrame) -> DataFrame:
    """``(key, h, guest, size, lo, hi)`` for each segment of the open part."""
    n = F.col("hi") - F.col("lo")
    parts = F.least(F.lit(CUTS), n)
    at = lambda d: (F.col("lo") + F.floor(n * d / parts)).cast("int")
    each = opened.select("h", "guest", "size", F.explode(F.transform(F.sequence(F.lit(0), parts - 1), lambda d: F.struct(at(d).alias("lo"), at(d + 1).alias("hi")))).alias("x"))
    each = each.select("h", "guest", "size", "x.lo", "x.hi").join(told.select("h", words_of(F.col("words")).alias("w")), "h")
    return written(each.select(_outside(0).alias("key"), "h", "guest", "size", "lo", "hi"), "segments", CUTS * opened.count())


def _near_but_a_word(last: DataFrame, told: DataFrame) -> DataFrame:
    """``(h, h2)`` of lines with an earlier one in a file of which one word is open."""
    each = last.join(told.select("h", "h2", "at", words_of(F.col("words")).alias("w")), "h")
    word = lambda role, w: F.struct(F.lit(role).alias("role"), w.alias("word"))
    mine = F.array(word("one", F.lit(None).cast("string")), word("own", F.get("w", F.col("lo"))))
    guests = F.array(word("guest", F.get("w", F.col("lo"))), word("guest", F.get("w", F.col("lo") + 1)))
    files = each.select("h", "h2", "at", _outside(1).alias("x1"), _outside(2).alias("x2"), F.explode(F.when(F.col("guest"), guests).otherwise(mine)).alias("f"))
    rows = 2 * last.count()
    files = written(files.select("h", "h2", "at", "x1", "x2", (F.col("f.role") == "one").alias("one"), F.coalesce("f.word", F.lit("")).alias("word"), "f.role"), "files", rows)
    file = ["x1", "x2", "one", "word"]
    least = files.groupBy(*file).agg(F.count("*").alias("n"), *(F.min(F.when(F.col("role") == r, F.col("at"))).alias(f"{r}_at") for r in ("one", "own", "guest"))).filter("n > 1")
    least = written(least.drop("n"), "least", rows)
    earlier = F.when(F.col("role") == "one", F.col("one_at")).when(F.col("role") == "own", F.col("guest_at")).otherwise(F.col("own_at"))
    return files.join(least, file).filter(earlier < F.col("at")).select("h", "h2")


def near_lines(lines: DataFrame, least: int, dense: int) -> DataFrame:
    """``(h, h2)`` of the lines of ``line_table`` with an earlier near one."""
    index, rows = _index(lines, least)
    pairs, many = _met(index, rows, dense)
    told = _told(lines, pairs.select(F.explode(F.array("a", "b")).alias("h")).union(many.select("h")), rows)
    near, open_ = _near_pairs(told, pairs), _opened(many, told)
    while not open_.isEmpty():
        segments = _cut(open_, told)
        pairs, many = _met(segments, segments.count(), dense)
        near = near.union(_near_pairs(told, pairs)).union(_near_but_a_word(many.filter("hi - lo = 1"), told))
        open_ = written(many.filter("hi - lo > 1").distinct(), "open", many.count())
    return written(near.distinct(), "near", told.count())


def decided(df: DataFrame, least_words: int = LEAST_WORDS, dense: int = DENSE, text: str = "text", key: str = "doc_id") -> DataFrame:
    """``df`` in a column ``record`` with ``n_lines``, ``n_exact`` and ``n_near`` removed, and ``kept`` (the text)."""
    lines = line_table(df, text, key)
    place = F.struct(F.col("doc").isNull().alias("no"), "doc", "row", "line")
    near = near_lines(lines, least_words, dense).withColumn("near", F.lit(True))
    firsts = lines.groupBy("h", "h2").agg(F.min(place).alias("at")).join(near, ["h", "h2"], "left")
    stay = firsts.groupBy(F.col("at.doc").alias("doc"), F.col("at.row").alias("row")).agg(F.collect_list(F.when(F.col("near").isNull(), F.col("at.line"))).alias("stay"), F.count("near").alias("n_near"))
    docs = df.select(F.col(key).alias("id"), F.xxhash64(text).alias("row_"), F.struct(*df.columns).alias("record"))
    same = F.col("id").eqNullSafe(F.col("doc")) & (F.col("row_") == F.col("row"))
    out = docs.join(stay, same, "left")
    numbers = F.coalesce("stay", F.array().cast("array<int>"))

    def of(each: Column) -> Column:
        blank = F.filter(F.sequence(F.lit(0), F.size(each) - 1), lambda i: F.length(F.btrim(F.get(each, i), F.lit(BLANKS))) == 0)
        kept = let(blank, lambda b: F.array_join(F.transform(F.array_sort(F.concat(numbers, b)), lambda i: F.get(each, i)), "\n"))
        return F.struct((F.size(each) - F.size(blank)).cast("long").alias("n_lines"), kept.alias("kept"))

    whole = F.col(f"record.`{text}`")
    read = let(F.split(F.coalesce(whole, F.lit("")), "\n"), of)
    n_near = F.coalesce("n_near", F.lit(0))
    out = out.select("record", F.explode(F.array(read)).alias("x"), F.size(numbers).alias("n_stay"), n_near.alias("n_near"))
    return out.select("record", "x.n_lines", (F.col("x.n_lines") - F.col("n_stay") - F.col("n_near")).cast("long").alias("n_exact"), F.col("n_near").cast("long").alias("n_near"), F.when(whole.isNotNull(), F.col("x.kept")).alias("kept"))


def dedup(df: DataFrame, text: str = "text", key: str = "doc_id", **how) -> DataFrame:
    """``df`` with the removed lines taken out of its texts; documents left without a line that isn't blank go."""
    found = decided(df, text=text, key=key, **how).filter((F.col("n_lines") == 0) | (F.col("n_exact") + F.col("n_near") < F.col("n_lines")))
    n_chars = fresh(df, "_kept")
    out = found.select("record.*", F.col("kept").alias(n_chars)).withColumn(text, F.col(n_chars))
    if "n_chars" in df.columns:
        out = out.withColumn("n_chars", F.length(text).cast(df.schema["n_chars"].dataType))
    return out.select(*df.columns)


def op4_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every whole text of ``documents``: its lines, how many are removed, and a digest of the rest."""
    found = decided(documents(spark, sf_dir))
    return found.select("record.doc_id", "n_lines", "n_exact", "n_near", F.sha2(F.coalesce("kept", F.lit("")), 256).alias("kept_sha256"))


#: For ids and rows that don't repeat. One edit leaves the first or the last half of the fewest words alone; what
#: is left of two lines without their common beginning and end is at most one word if they are an edit apart.
ORACLE = f"""WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS raw, generate_subscripts(string_split(text, chr(10)), 1) AS k FROM documents),
t AS (SELECT *, trim(raw, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS x FROM l),
f AS (SELECT x, min({{'d': doc_id, 'k': k}}) AS at FROM t WHERE x <> '' GROUP BY x),
w AS (SELECT *, list_filter(string_split_regex(x, '[\\x20\\x09-\\x0D]+'), lambda z: z <> '') AS ws FROM f),
e AS (SELECT *, len(ws) AS n FROM w WHERE len(ws) >= {LEAST_WORDS}),
p AS (SELECT a.x, a.ws AS a, b.ws AS b, a.n, b.n AS m FROM e a JOIN e b ON a.ws[1:{LEAST_WORDS // 2}] = b.ws[1:{LEAST_WORDS // 2}] AND a.at > b.at AND abs(a.n - b.n) <= 1 UNION ALL SELECT a.x, a.ws, b.ws, a.n, b.n FROM e a JOIN e b ON a.ws[-{LEAST_WORDS // 2}:] = b.ws[-{LEAST_WORDS // 2}:] AND a.at > b.at AND abs(a.n - b.n) <= 1),
q AS (SELECT *, coalesce(list_position(list_transform(list_zip(a[1:least(n, m)], b[1:least(n, m)]), lambda z: z[1] <> z[2]), true) - 1, least(n, m)) AS head FROM p),
n AS (SELECT DISTINCT x FROM q WHERE CASE WHEN n = m THEN a[head + 2:] = b[head + 2:] WHEN n > m THEN a[head + 2:] = b[head + 1:] ELSE a[head + 1:] = b[head + 2:] END),
j AS (SELECT t.doc_id, t.k, t.raw, t.x <> '' AS line, t.x <> '' AND f.at <> {{'d': t.doc_id, 'k': t.k}} AS exact, t.x <> '' AND f.at = {{'d': t.doc_id, 'k': t.k}} AND t.x IN (SELECT x FROM n) AS near FROM t LEFT JOIN f ON t.x = f.x),
o AS (SELECT doc_id, count(*) FILTER (WHERE line) AS n_lines, count(*) FILTER (WHERE exact) AS n_exact, count(*) FILTER (WHERE near) AS n_near, string_agg(raw, chr(10) ORDER BY k) FILTER (WHERE NOT coalesce(exact, false) AND NOT near) AS kept FROM j GROUP BY doc_id)
SELECT d.doc_id, coalesce(n_lines, 0) AS n_lines, coalesce(n_exact, 0) AS n_exact, coalesce(n_near, 0) AS n_near, sha256(coalesce(kept, '')) AS kept_sha256 FROM documents d LEFT JOIN o ON d.doc_id = o.doc_id"""
