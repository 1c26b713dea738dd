"""Statistics, preprocessing, splits and scores."""

from __future__ import annotations

from collections.abc import Sequence
from typing import Any

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from colframe.operators.aggregates import kurt, skew
from colframe.operators.ordering import fresh, keys, with_block, with_row_index
from colframe.operators.relational import numeric_columns
from colframe.operators.windows import ranked


def _matrix(df: DataFrame, columns: Sequence[str], pair) -> DataFrame:
    row = lambda a: F.struct(F.lit(a).alias("column"), *(pair(a, b).alias(b) for b in columns))
    return df.agg(F.array(*map(row, columns)).alias("x")).select(F.inline("x"))


def corr(df: DataFrame, columns: Sequence[str] | None = None, method: str = "pearson") -> DataFrame:
    """A row for each column with its correlation to the others."""
    columns = list(columns or numeric_columns(df))
    if method == "spearman":
        df = df.dropna("any", subset=columns).select(*columns)
        for c in columns:
            df = ranked(df, c, c)
    elif method == "kendall":
        return _matrix_of(df, columns)
    elif method != "pearson":
        raise ValueError(method)
    return _matrix(df, columns, F.corr)


def kendall(df: DataFrame, a: str, b: str, rows: int | None = None) -> float | None:
    """Kendall's tau-b of two columns, from counts of inversions without a join of pairs.

    Both columns become dense ranks.  Two ranks of ``b`` part at one binary digit, the first that differs: at each
    digit, those with equal digits before are a file, and running sums along ``a`` say how many smaller ones of the
    other digit a value has.  Running sums are made within blocks of ``a`` and over the sums of the blocks before.
    """
    has = df.dropna("any", subset=[a, b]).select(F.col(a).cast("double").alias("x"), F.col(b).cast("double").alias("y"))
    pairs = ranked(ranked(has, "x", "i", "dense", rows=rows), "y", "j", "dense", rows=rows).groupBy("i", "j").agg(F.count("*").alias("n"))
    ends = pairs.agg(F.max("j"), F.sum("n")).first()
    if ends[1] is None:
        return None
    digits = F.transform(F.sequence(F.lit(0), F.lit(max(ends[0].bit_length() - 1, 0))), lambda d: d)
    each = with_block(pairs, "i", rows, "block").select("i", "n", "block", F.col("j"), F.explode(digits).alias("d"))
    shift = lambda k: F.call_function("shiftright", F.col("j"), k)
    each = each.select("i", "block", "n", "d", shift(F.col("d") + 1).alias("file"), shift(F.col("d")).bitwiseAND(F.lit(1).cast("long")).alias("bit"))
    each = each.groupBy("d", "file", "block", "i").agg(*(F.sum(F.when(F.col("bit") == k, F.col("n")).otherwise(0)).alias(f"n{k}") for k in (0, 1)))
    whole = each.groupBy("d", "file", "block").agg(*(F.sum(f"n{k}").alias(f"s{k}") for k in (0, 1)))
    line = Window.partitionBy("d", "file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    whole = whole.select("d", "file", "block", *(F.coalesce(F.sum(f"s{k}").over(line), F.lit(0)).alias(f"b{k}") for k in (0, 1)))
    here = Window.partitionBy("d", "file", "block").orderBy("i").rowsBetween(Window.unboundedPreceding, -1)
    each = each.withColumns({f"r{k}": F.coalesce(F.sum(f"n{k}").over(here), F.lit(0)) for k in (0, 1)}).join(whole, ["d", "file", "block"])
    wide = lambda c: F.col(c).cast("double")
    s = each.agg(F.sum(wide("n1") * (wide("r0") + wide("b0")) - wide("n0") * (wide("r1") + wide("b1")))).first()[0] or 0.0
    n = float(ends[1])
    ties = lambda c: pairs.groupBy(c).agg(F.sum("n").cast("double").alias("t")).agg(F.sum(F.col("t") * (F.col("t") - 1) / 2)).first()[0] or 0.0
    total = n * (n - 1) / 2
    below = ((total - ties("i")) * (total - ties("j"))) ** 0.5
    return s / below if below else None


def _matrix_of(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    rows = [(a, *((kendall(df, a, b) if a != b else 1.0) for b in columns)) for a in columns]
    return df.sparkSession.createDataFrame(rows, "column string, " + ", ".join(f"`{c}` double" for c in columns))


def cov(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    return _matrix(df, list(columns or numeric_columns(df)), F.covar_samp)


def zscore(df: DataFrame, column: str, name: str = "zscore") -> DataFrame:
    mean, std = df.agg(F.avg(column), F.stddev_pop(column)).first()
    return df.withColumn(name, (F.col(column) - F.lit(mean)) / F.lit(std or 1.0))


def detect_outliers(df: DataFrame, column: str, method: str = "iqr", threshold: float = 3.0, name: str = "outlier") -> DataFrame:
    if method == "zscore":
        z = fresh(df, "_z")
        return zscore(df, column, z).withColumn(name, F.abs(z) > threshold).drop(z)
    low, high = df.agg(F.percentile(column, F.array(F.lit(0.25), F.lit(0.75)))).first()[0] or (None, None)
    width = (high - low or 1e-9) if low is not None else None
    out = (F.col(column) < low - 1.5 * width) | (F.col(column) > high + 1.5 * width) if low is not None else F.lit(None).cast("boolean")
    return df.withColumn(name, out)


def value_distribution(df: DataFrame, column: str, bins: int = 10) -> DataFrame:
    """``(bin, low, high, count)`` of equal-width bins; the last is closed, empty ones count 0."""
    low, high = df.agg(F.min(F.col(column).cast("double")), F.max(F.col(column).cast("double"))).first()
    if low is None:
        return df.sparkSession.createDataFrame([], "bin int, low double, high double, count long")
    high = high if high > low else low + 1
    width = (high - low) / bins
    number = F.least(F.floor((F.col(column) - low) / width), F.lit(bins - 1)).cast("int")
    counts = df.filter(F.col(column).isNotNull()).groupBy(number.alias("bin")).agg(F.count("*").alias("count"))
    every = df.sparkSession.range(bins).select(F.col("id").cast("int").alias("bin"))
    return every.join(counts, "bin", "left").select("bin", (F.lit(low) + F.col("bin") * width).alias("low"), (F.lit(low) + (F.col("bin") + 1) * width).alias("high"), F.coalesce("count", F.lit(0)).alias("count"))


def summary_stats(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """A row for each numeric column: count, share missing, mean, std, quartiles, skewness, kurtosis."""
    one = lambda c: F.struct(F.lit(c).alias("column"), F.count(c).alias("count"), (F.lit(100.0) * (F.count("*") - F.count(c)) / F.count("*")).alias("missing_pct"), F.avg(c).alias("mean"), F.stddev_samp(c).alias("std"), F.percentile(c, 0.5).alias("median"), skew(c).alias("skew"), kurt(c).alias("kurt"))
    return df.agg(F.array(*map(one, columns or numeric_columns(df))).alias("x")).select(F.inline("x"))


# Preprocessing: ``fit`` reads one aggregate, ``transform`` is a projection


class _Fitted:
    def __init__(self, columns: Sequence[str] | None = None):
        self.columns, self.fitted = columns, {}

    def statistics(self, c: str) -> dict[str, Column]:
        raise NotImplementedError

    def column(self, c: str, s: dict[str, Any]) -> Column:
        raise NotImplementedError

    def fit(self, df: DataFrame):
        self.columns = list(self.columns or numeric_columns(df))
        row = df.agg(*(x.alias(f"{c}\0{k}") for c in self.columns for k, x in self.statistics(c).items())).first().asDict()
        self.fitted = {c: {k.split("\0")[1]: v for k, v in row.items() if k.split("\0")[0] == c} for c in self.columns}
        return self

    def transform(self, df: DataFrame) -> DataFrame:
        return df.withColumns({c: self.column(c, self.fitted[c]) for c in self.columns})

    def fit_transform(self, df: DataFrame) -> DataFrame:
        return self.fit(df).transform(df)


class SimpleImputer(_Fitted):
    def __init__(self, strategy: str = "mean", fill_value: Any = None, columns: Sequence[str] | None = None):
        super().__init__(columns)
        self.strategy, self.fill_value = strategy, fill_value

    def statistics(self, c):
        return {"v": {"mean": F.avg(c), "median": F.median(c), "most_frequent": F.mode(c, True), "constant": F.max(F.lit(self.fill_value))}[self.strategy]}

    def column(self, c, s):
        return F.coalesce(F.col(c), F.lit(s["v"]))


class StandardScaler(_Fitted):
    def statistics(self, c):
        return {"m": F.avg(c), "s": F.stddev_pop(c)}

    def column(self, c, s):
        return (F.col(c) - F.lit(s["m"])) / F.lit(s["s"] or 1.0)

    def inverse_transform(self, df: DataFrame) -> DataFrame:
        return df.withColumns({c: F.col(c) * F.lit(s["s"] or 1.0) + F.lit(s["m"]) for c, s in self.fitted.items()})


class MinMaxScaler(_Fitted):
    def __init__(self, feature_range: tuple[float, float] = (0.0, 1.0), columns: Sequence[str] | None = None):
        super().__init__(columns)
        self.range = feature_range

    def statistics(self, c):
        return {"lo": F.min(F.col(c).cast("double")), "hi": F.max(F.col(c).cast("double"))}

    def column(self, c, s):
        lo, hi = self.range
        return F.lit(lo) + (F.col(c) - F.lit(s["lo"])) / F.lit((s["hi"] or 0) - (s["lo"] or 0) or 1.0) * F.lit(hi - lo)


class RobustScaler(_Fitted):
    def statistics(self, c):
        return {"q": F.percentile(c, F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75)))}

    def column(self, c, s):
        a, m, b = s["q"]
        return (F.col(c) - F.lit(m)) / F.lit((b - a) or 1.0)


class LabelEncoder:
    """Codes from 0 in the order of the values' text; unseen or missing values have none."""

    def fit(self, df: DataFrame, column: str) -> LabelEncoder:
        w = Window.orderBy(F.col("value").cast("string"))
        values = df.select(F.col(column).alias("value")).filter("value is not null").distinct()
        self.column, self.codes = column, values.withColumn("code", (F.row_number().over(w) - 1).cast("long"))
        return self

    def transform(self, df: DataFrame, name: str = "code") -> DataFrame:
        value = fresh(df, "_value")
        codes = self.codes.select(F.col("value").alias(value), F.col("code").alias(name))
        return df.join(codes, F.col(self.column) == F.col(value), "left").drop(value)

    def inverse_transform(self, df: DataFrame, code: str = "code", name: str = "value") -> DataFrame:
        key = fresh(df, "_code")
        return df.join(self.codes.select(F.col("code").alias(key), F.col("value").alias(name)), F.col(code) == F.col(key), "left").drop(key)


class OneHotEncoder:
    """0/1 columns of the categories that ``fit`` saw."""

    def __init__(self, columns: Sequence[str]):
        self.columns = list(columns)

    def fit(self, df: DataFrame) -> OneHotEncoder:
        from colframe.operators.reshape import categories

        self.categories = {c: categories(df, c) for c in self.columns}
        return self

    def transform(self, df: DataFrame) -> DataFrame:
        made = {f"{c}_{v}": F.coalesce((F.col(c) == F.lit(v)).cast("double"), F.lit(0.0)) for c, vs in self.categories.items() for v in vs}
        return df.withColumns(made).drop(*self.columns)


# Splits and scores


def train_test_split(df: DataFrame, key: str | Sequence[str], test_size: float | int = 0.25, seed: int | None = None) -> tuple[DataFrame, DataFrame]:
    """Exact sizes: the first rows by key, or by a seeded hash of it, are for training."""
    n = df.count()
    train = n - test_size if isinstance(test_size, int) else int(n * (1 - test_size))
    row = fresh(df, "_row")
    marked = _numbered(df, key, seed, row)
    return marked.filter(F.col(row) < train).drop(row), marked.filter(F.col(row) >= train).drop(row)


def _numbered(df: DataFrame, key: str | Sequence[str], seed: int | None, row: str) -> DataFrame:
    if seed is None:
        return with_row_index(df, key, row)
    h = fresh([*df.columns, row], "_h")
    return with_row_index(df.withColumn(h, F.xxhash64(*keys(key), F.lit(seed))), [h, *keys(key)], row).drop(h)


def kfold(df: DataFrame, key: str | Sequence[str], n_splits: int = 5, seed: int | None = None, name: str = "fold") -> DataFrame:
    """Adds a fold number; the last fold has the remainder."""
    size, row = df.count() // n_splits, fresh([*df.columns, name], "_row")
    return _numbered(df, key, seed, row).withColumn(name, F.least(F.floor(F.col(row) / max(size, 1)), F.lit(n_splits - 1)).cast("int")).drop(row)


def regression_scores(df: DataFrame, truth: str, predicted: str) -> DataFrame:
    t, p = F.col(truth).cast("double"), F.col(predicted).cast("double")
    rest, total = F.sum((t - p) * (t - p)), F.sum(t * t) - F.sum(t) * F.sum(t) / F.count("*")
    return df.agg(F.avg((t - p) * (t - p)).alias("mse"), F.avg(F.abs(t - p)).alias("mae"), F.when(total == 0, 0.0).otherwise(F.lit(1.0) - F.try_divide(rest, total)).alias("r2"))


def classification_scores(df: DataFrame, truth: str, predicted: str, positive: Any = 1) -> DataFrame:
    t, p = F.col(truth) == positive, F.col(predicted) == positive
    hit, said, is_ = F.count_if(t & p), F.count_if(p), F.count_if(t)
    ratio = lambda a, b: F.coalesce(F.try_divide(a.cast("double"), b.cast("double")), F.lit(0.0))
    return df.agg(F.avg((F.col(truth) == F.col(predicted)).cast("double")).alias("accuracy"), ratio(hit, said).alias("precision"), ratio(hit, is_).alias("recall"), ratio(2 * hit, said + is_).alias("f1"))


def make_pipeline(*steps: tuple[str, Any]):
    """Steps with ``fit`` and ``transform``, one after the other."""

    class Pipeline:
        def fit(self, df: DataFrame):
            for _, s in steps:
                df = s.fit(df).transform(df)
            return self

        def transform(self, df: DataFrame) -> DataFrame:
            for _, s in steps:
                df = s.transform(df)
            return df

    return Pipeline()
