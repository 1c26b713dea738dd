"""Operator 5: quality rules by distribution divergence, in DataFrame functions only.

Method: for each language the whole table gives two reference histograms: of
character classes, and of its common words (words with at least
``COMMON_SHARE`` of all words of the language, lower-cased, and one bin for
all others).  A document is compared with its language's references by the
Jensen-Shannon distance (square root of the divergence, base 2: 0 to 1), and
is rejected if either is over its threshold.  Guards: short histograms are
noise, so documents of fewer than ``LEAST_WORDS`` words are not judged by
divergence, nor those of a language with fewer than ``REFERENCE_WORDS`` words
in all.  Documents without a language are compared with all documents together.

A language has at most ``1 / COMMON_SHARE`` common words.  Tables with a row
for each language are sent to all tasks while they have ``LANGUAGES`` rows at
most, and meet the others in a shuffle beyond that; words are counted by
language and word before they are sent.

The base rules (word counts, repeated 8-word windows, repeated lines, symbols)
come with it.  A window that occurs twice is found by the XXH64 of its words
within one document, sorted beside its position.

Defined cases: NULL text: no words, base failed; texts of any length are read
whole; repeated rows are judged each; an empty table gives an empty table;
other columns are kept by ``keep``, and their names do not matter.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from colframe.llm.common import BLANKS, documents, let, words_of, written

#: Base rules: fewest words, words of a repeated window, most percent of words in repeated windows.
FEWEST, WINDOW, MOST_REPEATED = 20, 8, 30
SYMBOLS = "#*$%&|<>"
#: Divergence: fewest words to judge, thresholds of the two distances.
LEAST_WORDS = 30
CHARACTER_LIMIT, WORD_LIMIT = 0.33, 0.42
COMMON_SHARE, REFERENCE_WORDS = 0.005, 500
#: Languages whose references (a few KB each) may be sent to all tasks.
LANGUAGES = 5000
#: Character classes that are counted one by one, after letters a-z and blanks are taken out.
CLASSES = {
    "upper": "ABCDEFGHIJKLMNOPQRSTUVWXYZ",
    "digit": "0123456789",
    "mark": ".,;:!?'\"()-",
    "symbol": SYMBOLS + "@=/\\_+~^`[]{}",
}
#: All classes: blanks, those above, other characters, and letters a-z.
CLASS_NAMES = ("blank", *CLASSES, "other", "lower")


def without(text: Column, characters: str) -> Column:
    """How many of these characters a text has."""
    return (F.length(text) - F.length(F.translate(text, characters, ""))).cast("long")


def measures(words: Column, text: Column) -> Column:
    """A struct of a text's measures: words, their characters, symbols, and characters by class."""

    def of(w: Column, rest: Column) -> Column:
        word_chars = F.length(F.array_join(w, "")).cast("long")
        blank = F.length(text) - word_chars
        each = [without(rest, c) for c in CLASSES.values()]
        return let(
            F.struct(word_chars.alias("word_chars"), blank.cast("long").alias("blank"), F.length(rest).cast("long").alias("rest"), *(c.alias(k) for k, c in zip(CLASSES, each))),
            lambda m: F.struct(
                F.size(w).cast("long").alias("n_words"),
                m["word_chars"].alias("word_chars"),
                without(rest, SYMBOLS).alias("n_symbols"),
                F.array(m["blank"], *(m[k] for k in CLASSES), m["rest"] - reduce(lambda x, y: x + y, (m[k] for k in CLASSES)), F.length(text) - m["blank"] - m["rest"]).alias("classes"),
            ),
        )

    return let(F.regexp_replace(text, r"[a-z\x20\x09-\x0D]+", ""), lambda rest: of(words, rest))


def repeat_words(words: Column) -> Column:
    """Words in windows of ``WINDOW`` words that occur twice or more in this array, the first included."""

    def covered(at: Column) -> Column:
        marked = F.array_sort(at)
        total = F.aggregate(marked, F.struct(F.lit(0).alias("sum"), F.lit(-WINDOW).alias("last")), lambda a, p: F.struct((a["sum"] + F.least(F.lit(WINDOW), p - a["last"])).alias("sum"), p.alias("last")))
        return total["sum"]

    def twins(hashes: Column) -> Column:
        sorted_ = F.array_sort(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
        return let(
            sorted_,
            lambda s: covered(
                F.transform(
                    F.filter(
                        F.transform(s, lambda x, i: F.struct(x["i"].alias("i"), ((x["h"] == F.get(s, i + 1)["h"]) | (F.get(s, i - 1)["h"] == x["h"])).alias("twin"))),
                        lambda x: x["twin"],
                    ),
                    lambda x: x["i"],
                )
            ),
        )

    def paired(h: Column, apart: int) -> Column:
        return F.transform(h, lambda x, i: F.xxhash64(x, F.get(h, i + apart)))

    def windows(w: Column) -> Column:
        """A hash of each ``WINDOW`` words: of words, then of pairs of hashes, doubling."""
        hashes = F.transform(w, lambda x: F.xxhash64(x))
        return let(hashes, lambda h: let(paired(h, 1), lambda h: let(paired(h, 2), lambda h: F.slice(paired(h, 4), 1, F.size(w) - WINDOW + 1))))

    unlike = lambda h: F.size(F.array_distinct(h)) == F.size(h)
    return F.when(F.size(words) <= WINDOW, F.lit(0)).otherwise(let(windows(words), lambda h: F.when(unlike(h), F.lit(0)).otherwise(twins(h)))).cast("long")


def duplicate_lines(text: Column) -> Column:
    """Lines with a word that equal an earlier line."""
    lines = F.filter(F.split(text, "\n"), lambda x: F.length(F.btrim(x, F.lit(BLANKS))) > 0)
    return let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long")


def _shares(counts: Column, total: Column) -> Column:
    return F.transform(counts, lambda c: F.try_divide(c.cast("double"), total.cast("double")))


def _language(df: DataFrame, lang: str) -> Column:
    return F.col(lang) if lang in df.columns else F.lit(None).cast("string")


def _sent(by_language: DataFrame) -> DataFrame:
    """A table with a row for each language, sent to all tasks if it is small enough."""
    return F.broadcast(by_language) if by_language.count() <= LANGUAGES else by_language.hint("shuffle_merge")


def references(df: DataFrame, text: str = "text", lang: str = "lang") -> DataFrame:
    """A row for each language with enough words and one (NULL) for all documents: ``lang, classes, words, shares``."""
    docs = df.select(_language(df, lang).alias("lang"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    names = list(CLASS_NAMES)
    counted = written(docs.select("lang", F.explode(words_of(F.col("text"))).alias("word")).groupBy("lang", "word").agg(F.count("*").alias("n")), "words")
    # by language
    lengths = docs.groupBy(F.col("lang").alias("of")).agg(F.sum(F.length("text")).alias("chars"))
    of_word = counted.select("lang", "n", measures(F.array("word"), F.col("word"))["classes"].alias("classes"))
    sums = of_word.groupBy("lang").agg(F.sum("n").alias("total"), *(F.sum(F.col("n") * F.col("classes")[i]).alias(k) for i, k in enumerate(names)))
    sums = lengths.join(sums, F.col("of").eqNullSafe(F.col("lang")), "left").select("of", "chars", *(F.coalesce(k, F.lit(0)).alias(k) for k in ("total", *names)))
    sums = written(sums, "languages", 0)
    counted = counted.groupBy("lang", F.lower("word").alias("word")).agg(F.sum("n").alias("n"))
    common = counted.join(_sent(sums.select("of", "total")), F.col("lang").eqNullSafe(F.col("of"))).filter(F.col("n") >= COMMON_SHARE * F.col("total")).select("lang", "word", "n")
    # of all: a word with that share of all words has it in some language
    every = sums.groupBy().agg(*(F.sum(k).alias(k) for k in ("chars", "total", *names))).select(F.lit(None).cast("string").alias("of"), "*")
    overall = counted.join(common.select("word").distinct(), "word").groupBy("word").agg(F.sum("n").alias("n")).select(F.lit(None).cast("string").alias("lang"), "word", "n")
    sums = sums.filter("of is not null").unionByName(every).filter(F.col("total") >= REFERENCE_WORDS).withColumn("blank", F.col("chars") - reduce(lambda x, y: x + y, map(F.col, names)))
    shares_of = common.filter("lang is not null").unionByName(overall).join(_sent(sums.select("of", "total")), F.col("lang").eqNullSafe(F.col("of"))).filter(F.col("n") >= COMMON_SHARE * F.col("total"))
    shares_of = shares_of.groupBy("of").agg(F.sort_array(F.collect_list(F.struct("word", (F.col("n") / F.col("total")).alias("share")))).alias("common"))
    sums = sums.select(F.col("of").alias("lang"), _shares(F.array(*names), F.col("chars")).alias("classes"))
    none = F.array().cast("array<struct<word:string,share:double>>")
    found = sums.join(shares_of, F.col("lang").eqNullSafe(F.col("of")), "left").select("lang", "classes", F.coalesce("common", none).alias("common"))
    words, shares = F.transform("common", lambda x: x["word"]), F.transform("common", lambda x: x["share"])
    return written(found.select("lang", "classes", words.alias("words"), F.concat(shares, F.array(F.lit(1.0) - F.aggregate(shares, F.lit(0.0), lambda a, x: a + x))).alias("shares")), "references", 0)


def jensen_shannon(p: Column, q: Column) -> Column:
    """The distance of two arrays of shares; NULL if one is."""

    def part(x: Column, m: Column) -> Column:
        return F.when(x > 0, x * F.log2(x / m)).otherwise(F.lit(0.0))

    terms = F.zip_with(p, q, lambda a, b: (part(a, (a + b) / 2) + part(b, (a + b) / 2)) / 2)
    return F.sqrt(F.greatest(F.lit(0.0), F.aggregate(terms, F.lit(0.0), lambda a, x: a + x)))


def word_counts(words: Column, common: Column) -> Column:
    """How often each common word occurs among the words, and last how many are none of them."""
    each = F.transform(common, lambda c: F.size(words) - F.size(F.array_remove(words, c)))
    return let(each, lambda n: F.concat(n, F.array(F.size(words) - F.aggregate(n, F.lit(0), lambda a, x: a + x))))


def judged(df: DataFrame, text: str = "text", lang: str = "lang") -> DataFrame:
    """``df`` in a column ``row`` with the base measures, ``base_failed``, both distances and ``kept``."""
    rows = df.select(F.struct(*df.columns).alias("row"), F.col(text).alias("text"), _language(df, lang).alias("key"))
    joined = rows.join(_sent(references(df, text, lang)), F.col("key").eqNullSafe(F.col("lang")), "left")
    t = F.coalesce(F.col("text"), F.lit(""))
    measured = let(
        words_of(F.col("text")),
        lambda w: F.struct(
            measures(w, t).alias("m"),
            repeat_words(w).alias("n_repeat_words"),
            let(let(F.transform(w, lambda x: F.lower(x)), lambda v: word_counts(v, F.col("words"))), lambda c: jensen_shannon(_shares(c, F.size(w)), F.col("shares"))).alias("word_distance"),
        ),
    )
    # a generator, since a filter on its output isn't pushed below it, which would measure again for each use
    out = joined.select("row", "classes", F.explode(F.array(measured)).alias("x"), duplicate_lines(t).alias("n_dup_lines"))
    characters = let(_shares(F.col("x.m.classes"), F.aggregate("x.m.classes", F.lit(0).cast("long"), lambda a, n: a + n)), lambda p: jensen_shannon(p, F.col("classes")))
    out = out.select("row", "x.m.n_words", "x.m.word_chars", "x.m.n_symbols", "n_dup_lines", "x.n_repeat_words", characters.alias("character_distance"), "x.word_distance")
    failed = (F.col("n_words") < FEWEST) | (100 * F.col("n_repeat_words") > MOST_REPEATED * F.col("n_words"))
    far = (F.col("n_words") >= LEAST_WORDS) & ((F.col("character_distance") > CHARACTER_LIMIT) | (F.col("word_distance") > WORD_LIMIT))
    return out.withColumn("base_failed", failed).withColumn("kept", ~F.col("base_failed") & ~F.coalesce(far, F.lit(False)))


def keep(df: DataFrame, text: str = "text", lang: str = "lang") -> DataFrame:
    """The rows of ``df`` that all rules keep."""
    return judged(df, text, lang).filter("kept").select("row.*")


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every whole text of ``documents``: base measures, both distances and the verdict."""
    names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "character_distance", "word_distance")
    found = judged(documents(spark, sf_dir)).select("row.doc_id", *names)
    return found.withColumns({c: F.round(c, 6) for c in names[-2:]})


def _sql() -> str:
    count = lambda t, c: f"length({t}) - length(translate({t}, '{c}', ''))"
    quoted = {k: c.replace("'", "''") for k, c in CLASSES.items()}
    blank = "[\\x20\\x09-\\x0D]"
    term = lambda x: f"CASE WHEN {x} > 0 THEN {x} * log2({x} / ((z[1] + z[2]) / 2)) ELSE 0 END"
    distance = lambda p, q: f"sqrt(greatest(0, list_sum(list_transform(list_zip({p}, {q}), lambda z: ({term('z[1]')} + {term('z[2]')}) / 2))))"
    classes = ", ".join(["blank", *(count("rest", c) for c in quoted.values()), "length(rest) - (" + " + ".join(count("rest", c) for c in quoted.values()) + ")", "length(t) - blank - length(rest)"])
    return f"""WITH d AS (SELECT doc_id, lang, coalesce(text, '') AS t FROM documents),
w AS (SELECT *, list_filter(string_split_regex(t, '{blank}+'), lambda x: x <> '') AS ws, regexp_replace(t, '[a-z\\x20\\x09-\\x0D]+', '', 'g') AS rest, length(t) - length(regexp_replace(t, '{blank}+', '', 'g')) AS blank, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS ls FROM d),
m AS (SELECT doc_id, lang, t, ws, len(ws) AS n_words, length(t) - blank AS word_chars, {count('t', SYMBOLS)} AS n_symbols, len(ls) - len(list_distinct(ls)) AS n_dup_lines, [{classes}] AS classes FROM w),
g AS (SELECT doc_id, i, array_to_string(ws[i:i + {WINDOW - 1}], ' ') AS g FROM (SELECT doc_id, ws, unnest(range(1, n_words - {WINDOW - 2})) AS i FROM m)),
o AS (SELECT doc_id, i FROM (SELECT *, count(*) OVER (PARTITION BY doc_id, g) AS k FROM g) WHERE k > 1),
r AS (SELECT doc_id, sum(least({WINDOW}, coalesce(i - p, {WINDOW}))) AS n FROM (SELECT *, lag(i) OVER (PARTITION BY doc_id ORDER BY i) AS p FROM o) GROUP BY 1),
u AS (SELECT lang, lower(unnest(ws)) AS word FROM m),
k AS (SELECT lang, word, count(*) AS n FROM u WHERE lang IS NOT NULL GROUP BY ALL UNION ALL SELECT NULL, word, count(*) FROM u GROUP BY word),
s AS (SELECT lang, word, n / sum(n) OVER (PARTITION BY lang) AS share, sum(n) OVER (PARTITION BY lang) AS total FROM k),
c AS (SELECT lang, list(word ORDER BY word) AS words, list(share ORDER BY word) AS shares FROM s WHERE share >= {COMMON_SHARE} AND total >= {REFERENCE_WORDS} GROUP BY lang),
x AS (SELECT lang, classes, length(t) AS chars FROM m WHERE lang IN (SELECT lang FROM c) UNION ALL SELECT NULL, classes, length(t) FROM m),
q AS (SELECT lang, {'[' + ', '.join(f'sum(classes[{i + 1}]) / sum(chars)' for i in range(len(CLASS_NAMES))) + ']'} AS q FROM x GROUP BY lang),
j AS (SELECT m.*, coalesce(r.n, 0) AS n_repeat_words, words, list_append(shares, 1 - list_sum(shares)) AS shares, q FROM m LEFT JOIN r ON m.doc_id = r.doc_id LEFT JOIN c ON c.lang IS NOT DISTINCT FROM m.lang LEFT JOIN q ON q.lang IS NOT DISTINCT FROM m.lang),
p AS (SELECT *, list_transform(classes, lambda v: v / length(t)) AS cp, list_transform(words, lambda v: len(list_filter(ws, lambda y: lower(y) = v)) / n_words) AS hits FROM j),
z AS (SELECT *, CASE WHEN q IS NOT NULL THEN {distance('cp', 'q')} END AS cd, CASE WHEN words IS NOT NULL THEN {distance('list_append(hits, 1 - list_sum(hits))', 'shares')} END AS wd, n_words < {FEWEST} OR 100 * n_repeat_words > {MOST_REPEATED} * n_words AS base_failed FROM p)
SELECT doc_id, CAST(n_words AS BIGINT) AS n_words, CAST(word_chars AS BIGINT) AS word_chars, CAST(n_symbols AS BIGINT) AS n_symbols, CAST(n_dup_lines AS BIGINT) AS n_dup_lines, CAST(n_repeat_words AS BIGINT) AS n_repeat_words, base_failed, NOT base_failed AND NOT coalesce(n_words >= {LEAST_WORDS} AND (cd > {CHARACTER_LIMIT} OR wd > {WORD_LIMIT}), false) AS kept, round(cd, 6) AS character_distance, round(wd, 6) AS word_distance FROM z"""


ORACLE = _sql()
