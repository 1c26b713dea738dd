"""Row order over several blocks, names that clash, index labels, and plain versions of what has no SQL."""

import datetime as dt
import itertools
import random

import pytest
from pyspark.sql import functions as F

from colframe.functions import udf
from colframe.operators import aggregates, indexed, joins, ordering, relational, stats, windows
from colframe.sources import database, files


def shuffled(values, seed=1):
    return random.Random(seed).sample(list(values), len(values))


@pytest.mark.parametrize("rows", [7, 40, 1000])
@pytest.mark.parametrize(
    ("kind", "values"),
    [
        ("string", ["", *(f"k{i:03d}é" for i in range(120)), None]),
        ("date", [None, *(dt.date(2020, 1, 1) + dt.timedelta(i) for i in range(120))]),
        ("timestamp", [None, *(dt.datetime(2020, 1, 1) + dt.timedelta(seconds=i, microseconds=i) for i in range(120))]),
        ("decimal(20,3)", [None, *range(-60, 60)]),
        ("double", [None, *(i / 7 for i in range(-60, 60))]),
        ("long", [None, *range((1 << 62), (1 << 62) + 120)]),
        ("boolean", [None, False, True]),
    ],
)
def test_row_index_of_any_key(spark, rows, kind, values):
    from decimal import Decimal

    values = [Decimal(v) if kind.startswith("decimal") and v is not None else v for v in values]
    df = spark.createDataFrame([(v,) for v in shuffled(values)], f"k {kind}").repartition(3)
    order = sorted(values, key=lambda v: (v is not None, v))
    got = ordering.with_row_index(df, "k", "row", rows)
    assert [r.k for r in got.orderBy("row").collect()] == order
    assert sorted(r.row for r in got.collect()) == list(range(len(values)))
    last = relational.sorted_rows(df, "k", False, rows=rows)
    assert [r.k for r in last.orderBy("row").collect()] == [None, *reversed(order[1:])]


def test_equal_first_keys_and_mixed_directions(spark):
    pairs = [(i % 3 if i % 7 else None, i) for i in range(200)]
    df = spark.createDataFrame(shuffled(pairs), "a long, b long").repartition(4)
    blocks = ordering.with_block(df, ["a", "b"], 20).groupBy("_block").count().collect()
    assert len(blocks) > 5 and max(r["count"] for r in blocks) < 60
    got = relational.sorted_rows(df, ["a", "b"], [False, True], rows=20).orderBy("row").collect()
    assert [(r.a, r.b) for r in got] == sorted(pairs, key=lambda p: (p[0] is not None, -(p[0] or 0), p[1]))


def test_one_key_for_all_rows(spark):
    df = spark.range(100).select(F.lit("x").alias("k"), "id")
    assert sorted(r.row for r in ordering.with_row_index(df, "k", "row", 10).collect()) == list(range(100))


def test_many_blocks_are_bisected(spark):
    df = spark.range(3000).select((F.col("id") * 7 % 3000).alias("k"))
    got = ordering.with_row_index(df, "k", "row", 20)
    assert got.filter("k != row").count() == 0


HELPERS = "_nth _row _block _base _halo _v _r _p _a _b _x _m _n _dup _s _q _z _h _at _chunk _mean _d _end _local _last _lag _value _code _order _upto _place _met _part _f _l _k _lo _hi _back _fore l r k x".split()


@pytest.fixture(scope="module")
def clashing(spark):
    rows = [(i, float(i * 37 % 100) if i % 4 else None, *(f"{c}{i}" for c in HELPERS)) for i in range(60)]
    return spark.createDataFrame(rows, "id long, val double, " + ", ".join(f"`{c}` string" for c in HELPERS)).repartition(3)


@pytest.mark.parametrize(
    "use",
    [
        lambda d: ordering.with_row_index(d, "id", "pos", 10),
        lambda d: ordering.by_block(d, "id", 3, lambda w: {"new": F.sum("val").over(w.rowsBetween(-2, 0))}, 10),
        lambda d: ordering.cumulative(d, "id", "val", "new", 10),
        lambda d: windows.ranked(d, "val", "new", rows=10),
        lambda d: windows.ranked(d, "val", "new", "first", tie="id", rows=10),
        lambda d: windows.filled(d, "val", "id", "new", rows=10),
        lambda d: windows.interpolate(d, "val", "id", "new", rows=10),
        lambda d: windows.interpolate(d, "val", "id", "new", ["_row"]),
        lambda d: windows.ewm(d, "val", "id", "new", span=3, rows=10),
        lambda d: windows.expanding_median(d, "val", "id", "new"),
        lambda d: relational.iloc(d, "id"),
        lambda d: relational.drop_duplicates(d, "id", ["id"]),
        lambda d: relational.combine_first(d, d.select("id", "val"), "id"),
        lambda d: relational.update(d, d.select("id", "val"), "id"),
        lambda d: stats.detect_outliers(d, "val", "zscore"),
        lambda d: stats.kfold(d, "id", 3, seed=1),
        lambda d: stats.LabelEncoder().fit(d, "_x").transform(d, "new"),
        lambda d: joins.index_join(d, d.select("id", F.col("val").alias("other")), "id", "other"),
        lambda d: joins.merge_asof(d, d.select("id", "val"), "id", rows=10),
        lambda d: joins.merge_asof(d, d.select("id", "val"), "id", "nearest", rows=10),
    ],
)
def test_no_column_is_lost_to_a_helper(clashing, use):
    out = use(clashing)
    assert [c for c in HELPERS if c not in out.columns] == []
    rows = out.collect()
    assert len(rows) == 60 and all(r[c] == f"{c}{r.id}" for r in rows for c in HELPERS)


def test_asof_by_columns_named_as_helpers(spark):
    left = spark.createDataFrame([(1, "a", 5), (4, "b", 6)], "t long, _k string, l long")
    right = spark.createDataFrame([(0, "a", 7), (2, "b", 8), (3, "a", 9)], "t long, _k string, r long")
    got = {x.l: x.r for x in joins.merge_asof(left, right, "t", by="_k").collect()}
    assert got == {5: 7, 6: 8}


def test_merge_names_that_are_taken(spark):
    left = spark.createDataFrame([(1, 2, 3)], "k long, v long, v_r long")
    right = spark.createDataFrame([(1, 9)], "k long, v long")
    out = joins.merge(left, right, "k")
    assert out.columns == ["k", "v", "v_r", "v_r_r"] and tuple(out.first()) == (1, 2, 3, 9)


def test_kendall_is_the_plain_count(spark):
    r = random.Random(4)
    for spread in (3, 50, 1000):
        points = [(r.randrange(spread) if r.random() > 0.1 else None, r.randrange(spread)) for _ in range(150)]
        has = [p for p in points if None not in p]
        sign = lambda v: (v > 0) - (v < 0)
        s = sum(sign(a[0] - b[0]) * sign(a[1] - b[1]) for a, b in itertools.combinations(has, 2))
        below = 1.0
        for k in (0, 1):
            below *= sum(a[k] != b[k] for a, b in itertools.combinations(has, 2))
        got = stats.kendall(spark.createDataFrame(points, "x long, y long"), "x", "y", rows=20)
        assert got == pytest.approx(s / below**0.5)
    assert stats.kendall(spark.createDataFrame([], "x long, y long"), "x", "y") is None
    assert stats.kendall(spark.createDataFrame([(1, 1), (1, 2)], "x long, y long"), "x", "y") is None


@pytest.mark.parametrize("adjust", [True, False])
@pytest.mark.parametrize("alpha", [0.02, 0.3, 1.0])
def test_ewm_is_the_plain_recurrence(spark, alpha, adjust):
    r = random.Random(3)
    values = [r.uniform(-5, 5) if r.random() > 0.2 else None for _ in range(2500)]
    df = spark.createDataFrame(list(enumerate(values)), "id long, v double").repartition(3)
    got = {x.id: x.e for x in windows.ewm(df, "v", "id", "e", alpha=alpha, adjust=adjust, rows=400).collect()}
    n = d = 0.0
    mean = None
    for i, v in enumerate(values):
        if v is not None:
            n, d = n * (1 - alpha) + v, d * (1 - alpha) + 1
            mean = n / d if adjust else v if mean is None else mean * (1 - alpha) + alpha * v
        assert got[i] == (None if mean is None else pytest.approx(mean, rel=1e-9, abs=1e-12))


def test_fill_limits_over_blocks(spark):
    values = [i if i % 9 == 4 else None for i in range(100)]
    df = spark.createDataFrame(list(enumerate(values)), "id long, v long").repartition(3)
    for limit, backward in itertools.product((None, 1, 3, 20), (False, True)):
        got = [x.v for x in windows.filled(df, "v", "id", backward=backward, limit=limit, rows=8).orderBy("id").collect()]
        want = []
        for i in range(100):
            reach = range(i, 100 if limit is None else min(100, i + limit + 1)) if backward else range(i, -1 if limit is None else max(-1, i - limit - 1), -1)
            want.append(next((values[j] for j in reach if values[j] is not None), None))
        assert got == want


def test_whole_table_functions_of_empty_tables(spark):
    none = spark.createDataFrame([], "id long, v double")
    assert windows.ranked(none, "v", "r").count() == windows.filled(none, "v", "id").count() == windows.ewm(none, "v", "id", "e").count() == 0
    assert windows.interpolate(none, "v", "id").count() == windows.expanding_median(none, "v", "id", "m").count() == 0
    assert aggregates.autocorr(none, "v", "id").first()[0] is None and relational.sorted_rows(none, "v").count() == 0


def test_constructors(spark):
    a = indexed.from_dict(spark, {"a": [3, 1, 2], "b": ["x", 1, None]})
    assert a.shape == (3, 2) and a.size == 6 and a.ndim == 2 and "a" in a and "index" not in a and not a.empty and list(a) == ["a", "b"]
    assert a.dtypes == {"a": "bigint", "b": "string"} and a.to_list("b") == ["x", "1", None]
    assert indexed.from_records(spark, [{"a": 1}, {"b": 2.5}]).to_list("b") == [None, 2.5]
    assert indexed.from_array(spark, [[1, 2], [3, 4]]).columns == ["0", "1"]
    assert indexed.series(spark, {"p": 1, "q": 2}, "v")["q"] == {"v": 2}
    assert indexed.from_dict(spark, {"a": 7}).to_list("a") == [7] and indexed.from_dict(spark, {}).empty
    with pytest.raises(ValueError):
        indexed.from_dict(spark, {"a": [1], "b": [1, 2]})


def test_labels(spark):
    a = indexed.from_dict(spark, {"k": ["q", "p", "r"], "v": [1, 2, 3]}).set_index("k")
    assert a.columns == ["v"] and a["p"] == {"v": 2} and a.put("p", v=9)["p"] == {"v": 9}
    with pytest.raises(KeyError):
        a["z"]
    assert [r.k for r in a.sort_index().df.collect()] == ["p", "q", "r"]
    again = a.reset_index()
    assert again.columns == ["index", "v"] and again.to_list("index") == ["p", "q", "r"] and a.reset_index(drop=True).columns == ["v"]
    assert a.renamed(["w"]).columns == ["w"] and a.labelled(F.upper("k"))["P"] == {"v": 2}
    assert a.copy().pipe(lambda x, n: len(x) + n, 1) == 4
    assert tuple(indexed.transposed(a.df, "k").first()) == ("v", "2", "1", "3")


def test_functions_of_columns_and_batches(spark):
    df = spark.createDataFrame([(1, 2.0), (5, 4.0)], "a long, b double")
    assert tuple(udf.apply_columns(df, lambda s: float(s.sum()), ["a", "b"]).first()) == (6.0, 6.0)
    batches = list(files.tensors(df, "b", 1))
    assert [x.tolist() for x, _ in batches] == [[[1.0]], [[5.0]]] and [y.tolist() for _, y in batches] == [[2.0], [4.0]]
    x, y = files.features_and_target(df, "b")
    assert x.tolist() == [[1.0], [5.0]] and y.tolist() == [2.0, 4.0]


def test_absent_libraries_are_named(spark):
    import importlib.util

    for name, make in (("torch", files.to_torch), ("tensorflow", files.to_tensorflow)):
        if importlib.util.find_spec(name) is None:
            with pytest.raises(ImportError, match=name):
                make(spark.range(3))


def test_scratch_paths_differ(spark):
    assert files.scratch(spark, "a") != files.scratch(spark, "a")


def test_sqlite_ranges(spark, tmp_path):
    path = str(tmp_path / "x.db")
    database.write_sqlite(spark.range(100).select("id", (F.col("id") / 2).alias("h"), F.when(F.col("id") % 3 == 0, F.col("id").cast("string")).alias("s")), path, "t")
    got = database.read_sqlite(spark, path, "SELECT * FROM t WHERE id < 90", "id", [10, 50])
    assert got.rdd.getNumPartitions() == 3 and got.dtypes == [("id", "bigint"), ("h", "double"), ("s", "string")]
    assert sorted(tuple(r) for r in got.collect()) == [(i, i / 2, str(i) if i % 3 == 0 else None) for i in range(90)]
