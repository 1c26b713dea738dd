"""Small checks of what the catalogue's SQL can't hold: files, errors, order, sizes."""

import pytest
from pyspark.sql import functions as F

from colframe.functions import dates, expressions, strings
from colframe.operators import aggregates, joins, ordering, relational, reshape, stats
from colframe.sources import database, files
from colframe.streaming import lazy


@pytest.fixture
def ab(spark):
    return spark.createDataFrame([(1, 4.0), (2, 5.0), (3, 6.0)], "a long, b double")


def test_round_trips(spark, ab, tmp_path):
    for name, write, read in (("csv", files.to_csv, files.read_csv), ("parquet", files.to_parquet, files.read_parquet), ("orc", files.to_orc, files.read_orc)):
        write(ab, str(tmp_path / name))
        back = read(spark, str(tmp_path / name))
        assert sorted(map(tuple, back.select(F.col("a").cast("long"), "b").collect())) == [(1, 4.0), (2, 5.0), (3, 6.0)]
    files.to_json(ab, str(tmp_path / "json"))
    assert files.read_json(spark, str(tmp_path / "json"), lines=True).count() == 3
    assert files.read_json(spark, files.to_json(ab)).count() == 3


def test_csv_options(spark, tmp_path):
    (tmp_path / "x.csv").write_text("a;b\n1;x\n2;y\n3;z\n")
    got = files.read_csv(spark, str(tmp_path / "x.csv"), usecols=["b"], nrows=2, sep=";")
    assert [r.b for r in got.collect()] == ["x", "y"]


def test_feather(spark, tmp_path):
    import pandas as pd

    pd.DataFrame({"a": [1, 2]}).to_feather(tmp_path / "x.feather")
    assert files.read_feather(spark, str(tmp_path / "x.feather")).count() == 2


def test_html(spark):
    page = "<table><tr><th>a<th>b</tr><tr><td>1<td>2</tr></table><p>x</p><table><tr><td>c</td></tr><tr><td>7</td></tr></table>"
    found = files.read_html(spark, "<table><tr><th>a</th><th>b</th></tr><tr><td>1</td><td>2</td></tr></table>")
    assert [tuple(r) for r in found[0].collect()] == [("1", "2")]
    df = spark.createDataFrame([(1, page), (2, None)], "page_id long, html string")
    assert files.tables_of_pages(df, "page_id", "html").count() == 4


def test_sqlite(spark, ab, tmp_path):
    db = database.Database.sqlite(spark, str(tmp_path / "x.db"))
    db.write(ab, "t")
    assert db.tables() == ["t"]
    assert [tuple(r) for r in db.query("SELECT sum(a) AS s, avg(b) AS m FROM t").collect()] == [(6, 5.0)]


def test_views_are_restored(spark, ab):
    ab.filter("a = 1").createOrReplaceTempView("df")
    assert database.sql(ab, "SELECT count(*) AS n FROM df").first().n == 3
    assert spark.table("df").count() == 1
    spark.catalog.dropTempView("df")


def test_expressions_refuse_code(ab):
    for text in ("__import__('os')", "a.real", "[x for x in a]", "open('x')", "a if b else 1", "zzz + 1"):
        with pytest.raises(expressions.ExpressionError):
            expressions.query(ab, text)
    assert expressions.query(ab, "a in [1, 3] and b < 6").count() == 1


def test_merge_rejects(ab):
    with pytest.raises(ValueError):
        joins.merge(ab, ab, "a", "sideways")


def test_row_index_blocks(spark):
    df = spark.range(1000).select((F.col("id") * 7 % 1000).alias("k"))
    got = ordering.with_row_index(df, "k", "row", rows=64).filter("k != row").count()
    assert got == 0


def test_sample_sizes(spark):
    df = spark.range(500)
    a, b = relational.sample(df, "id", n=40, seed=1), relational.sample(df, "id", frac=0.1, seed=2)
    assert a.count() == 40 and b.count() == 50 and not relational.equals(a, b)
    assert relational.sample(df, "id", n=900, replace=True).count() == 900


def test_splits(spark):
    df = spark.range(103)
    train, test = stats.train_test_split(df, "id", 0.25, seed=3)
    assert (train.count(), test.count()) == (77, 26) and train.join(test, "id").count() == 0


def test_asof_ties(spark):
    left = spark.createDataFrame([(1, 10), (2, 20), (None, 30)], "t long, l long")
    right = spark.createDataFrame([(1, 7), (1, 8), (3, 9)], "t long, r long")
    got = {r.l: r.r for r in joins.merge_asof(left, right, "t").collect()}
    assert got == {10: 8, 20: 8, 30: None}
    assert {r.l: r.r for r in joins.merge_asof(left, right, "t", "forward").collect()} == {10: 7, 20: 9, 30: None}
    assert {r.l: r.r for r in joins.merge_asof(left, right, "t", "nearest").collect()} == {10: 8, 20: 8, 30: None}


def test_empty_tables(spark, ab):
    none = ab.limit(0)
    assert ordering.with_row_index(none, "a").count() == 0
    assert aggregates.describe(none, ["b"]).first()["count"] == 0
    assert stats.value_distribution(none, "b").count() == 0
    assert joins.merge(none, ab, "a", "outer").count() == 3
    assert reshape.melt(none, ["a"]).count() == 0


def test_many_categories_fail(spark, monkeypatch):
    monkeypatch.setattr(reshape, "MOST_COLUMNS", 5)
    with pytest.raises(ValueError):
        reshape.crosstab(spark.range(9).select("id", F.col("id").alias("b")), "id", "b")


def test_strings(spark):
    df = spark.createDataFrame([("-5",), ("12345",), (None,)], "s string")
    assert [r[0] for r in df.select(strings.zfill("s", 4)).collect()] == ["-005", "12345", None]
    assert [r[0] for r in df.select(strings.length("s")).collect()] == [2, 5, 0]
    assert dates.pattern("%Y-%m-%dT%H:%M") == "yyyy-MM-dd'T'HH:mm"


def test_lazy(spark, ab):
    assert lazy.LazyFrame.from_frames(ab, ab).filter("a > 1").sum("b") == 22.0


def test_streaming_windows(spark, tmp_path):
    rows = spark.createDataFrame([("2024-01-01 00:01:00", "x"), ("2024-01-01 00:07:00", "x"), ("2024-01-01 00:12:00", "y")], "ts string, k string").withColumn("ts", F.to_timestamp("ts"))
    rows.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in"))
    q = lazy.windowed_counts(stream, "ts", ["k"], "10 minutes", late="1 hour").writeStream.outputMode("complete").format("memory").queryName("counted").trigger(availableNow=True).start()
    q.awaitTermination(60)
    assert sorted(r.n for r in spark.table("counted").collect()) == [1, 2]
