"""Documents with the cases that every operator defines."""

import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, fp long, root string, row string, h long, kept string, key string"


def made(n=60, seed=1):
    r = random.Random(seed)
    vocabulary = ["".join(r.choice("abcdefgé") for _ in range(r.randint(1, 7))) for _ in range(120)] + ["the", "of", "and", "a"] * 20
    sentence = lambda k: " ".join(r.choice(vocabulary) for _ in range(k)).capitalize() + "."
    passage = sentence(40)
    rows = []
    for i in range(n):
        text = "\n".join(sentence(r.randint(3, 30)) for _ in range(r.randint(1, 6)))
        if i % 7 == 3:
            text = rows[r.randrange(len(rows))][1] or text  # an exact copy
        if i % 9 == 4:
            text = (rows[r.randrange(len(rows))][1] or text) + " x"  # a near copy
        if i % 8 == 5:
            text += "\n" + passage + "\n" + sentence(5)
        rows.append((i * 3, text, r.choice(["en", "de", None]), r.choice(["s1", "s2", "s1", None])))
    rows += [(1000, None, "en", "s1"), (1003, "", "en", None), (1006, " \n\t ", "fr", "s3"), (1009, "one", "en", "s3"), (1012, "the quick brown fox " * 3000, "en", "s2"), (1015, "aaaa" * 2000, "en", "s2")]
    rows += [rows[5], rows[5], (None, rows[6][1], "en", "s1"), (None, "an id is missing here", "en", "s1"), (rows[7][0], "another text with the id of a row before", "de", "s2")]
    return rows


@pytest.fixture(scope="session")
def rows():
    return made()


def frame(spark, rows):
    return spark.createDataFrame([(*r, len(r[1]) if r[1] is not None else None, 1, "r", "w", 2, "k", "y") for r in rows], SCHEMA).repartition(3)


@pytest.fixture(scope="session")
def docs(spark, rows):
    df = frame(spark, rows).cache()
    df.count()
    return df


@pytest.fixture(scope="session")
def unique(spark, rows):
    """The rows with an id of their own."""
    seen, out = set(), []
    for r in rows:
        if r[0] is not None and r[0] not in seen:
            seen.add(r[0])
            out.append(r)
    return out


@pytest.fixture(scope="session")
def unique_docs(spark, unique):
    df = frame(spark, unique).cache()
    df.count()
    return df


@pytest.fixture(scope="session")
def none(docs):
    return docs.limit(0)
