"""Rolling, expanding and exponentially weighted windows, shifts, running functions, ranks, filling.

Each function gives a ``Column`` for a window specification ``W(order_by,
partition_by)``; ``ordering.by_block`` runs moving ones over a whole table
without gathering it in one task.  Functions of a table (``ranked``, ``filled``,
``interpolate``, ``ewm``, ``expanding_median``, ``rolling_apply``) do so
themselves where no groups are given.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from colframe.operators.ordering import by_block, carried, cumulative, fresh, keys, named, with_row_index


def W(order_by: str | Sequence[str], partition_by: str | Sequence[str] = ()) -> WindowSpec:
    return Window.partitionBy(*keys(partition_by) if partition_by else []).orderBy(*keys(order_by))


_PLAIN: dict[str, Callable[[str], Column]] = {"mean": F.avg, "sum": F.sum, "min": F.min, "max": F.max, "std": F.stddev_samp, "var": F.var_samp, "count": F.count}


def _middle(values: Column) -> Column:
    n = F.size(values)
    low, high = F.get(values, ((n - 1) / 2).cast("int")), F.get(values, (n / 2).cast("int"))
    return F.when(n > 0, (low + high) / 2)


def _framed(c: str, how: str, frame: WindowSpec, least: int) -> Column:
    if how == "count":
        return F.count(c).over(frame)
    value = _middle(F.array_sort(F.collect_list(F.col(c).cast("double")).over(frame))) if how == "median" else _PLAIN[how](c).over(frame)
    return F.when(F.count(c).over(frame) >= least, value)


def rolling(c: str, how: str, window: int, w: WindowSpec, min_periods: int | None = None, center: bool = False) -> Column:
    """Over the last ``window`` rows, or those around the row; NULL with fewer values than ``min_periods``."""
    ahead = (window - 1) // 2 if center else 0
    return _framed(c, how, w.rowsBetween(ahead - window + 1, ahead), min_periods or window)


def expanding(c: str, how: str, w: WindowSpec, min_periods: int = 1) -> Column:
    return _framed(c, how, w.rowsBetween(Window.unboundedPreceding, 0), min_periods)


def expanding_median(df: DataFrame, c: str, order_by: str, name: str, partition_by: str | Sequence[str] = ()) -> DataFrame:
    """Adds the median of the values so far, by two heaps over each group's sorted rows: n log n in its rows.

    A group is read by one task, which holds its values.
    """
    import heapq

    part = keys(partition_by)
    n_keys = len(part)
    schema = ", ".join(f"`{k}` {dict(df.dtypes)[k]}" for k in [*part, order_by]) + f", `{name}` double"

    def run(frames):
        group, low, high = None, [], []
        for f in frames:
            out = []
            for row in f.itertuples(index=False, name=None):
                key = tuple(None if v != v else v for v in row[:n_keys])
                if key != group:
                    group, low, high = key, [], []
                v = row[-1]
                if v is not None and v == v:
                    heapq.heappush(high, -heapq.heappushpop(low, -float(v)))
                    if len(high) > len(low):
                        heapq.heappush(low, -heapq.heappop(high))
                out.append(None if not low else -low[0] if len(low) > len(high) else (high[0] - low[0]) / 2)
            yield f.iloc[:, :-1].assign(**{name: out})

    rows = df.select(*part, order_by, F.col(c).cast("double").alias(fresh([*part, order_by], "_v")))
    rows = rows.repartition(*part) if part else rows.coalesce(1)
    made = rows.sortWithinPartitions(*part, order_by).mapInPandas(run, schema)
    theirs = {k: fresh([*df.columns, name], f"_of_{k}") for k in [*part, order_by]}
    value = fresh([*df.columns, *theirs.values()], f"_of_{name}")
    made = made.toDF(*theirs.values(), value)
    out = df.join(made, [F.col(k).eqNullSafe(F.col(n)) for k, n in theirs.items()])
    return out.select(*named(x for x in df.columns if x != name), F.col(value).alias(name))


def rolling_apply(df: DataFrame, c: str, fn: Callable, window: int, order_by: str, name: str, kind: str = "double", partition_by: Sequence[str] = (), min_periods: int | None = None) -> DataFrame:
    """Adds a function of the last ``window`` values that aren't missing, as a pandas Series; NULL with fewer than ``min_periods``."""
    import pandas as pd

    def run(s: pd.Series) -> pd.Series:
        return s.map(lambda v: fn(pd.Series(v)))

    run.__annotations__ = {"s": pd.Series, "return": pd.Series}
    least = min_periods or window

    def add(w: WindowSpec) -> dict[str, Column]:
        values = F.collect_list(c).over(w.rowsBetween(1 - window, 0))
        return {name: F.when(F.size(values) >= least, values)}

    made = df.withColumns(add(W(order_by, partition_by))) if partition_by else by_block(df, order_by, window - 1, add)
    return made.withColumn(name, F.when(F.col(name).isNotNull(), F.pandas_udf(run, kind)(F.coalesce(name, F.array().cast(made.schema[name].dataType)))))


def ewm(df: DataFrame, c: str, order_by: str, name: str, span: float | None = None, alpha: float | None = None, adjust: bool = True, partition_by: Sequence[str] = (), rows: int | None = None) -> DataFrame:
    """Adds the exponentially weighted mean of the values so far; missing values have no weight and repeat the last mean.

    Values are cut into chunks in order, so long that weights fall below what a double holds; sums of decayed
    values run within a chunk, and the sums of the two chunks before are handed on.
    """
    a = alpha if alpha is not None else 2 / (span + 1) if span is not None else 0.5
    rest = 1 - a
    size = 1 if rest <= 0 else max(1, math.ceil(math.log(1e-18) / math.log(rest)))
    part = list(partition_by)
    taken = [*df.columns, name]
    at, chunk, mean = (fresh(taken, x) for x in ("_at", "_chunk", "_mean"))
    sums = {k: fresh(taken, f"_{k}") for k in ("n", "d")}
    has = df.filter(F.col(c).isNotNull()).select(*part, order_by, F.col(c).cast("double").alias(mean))
    if part:
        has = has.withColumn(at, F.row_number().over(W(order_by, part)) - 1)
    else:
        has = with_row_index(has, order_by, at, rows)
    has = has.withColumn(chunk, F.floor(F.col(at) / size))
    j = F.col(at) - F.col(chunk) * size
    grown = F.pow(F.lit(1 / rest), j) if rest > 0 else F.lit(1.0)
    weight = F.lit(1.0) if adjust else F.when(F.col(at) == 0, 1.0).otherwise(a)
    values = {"n": F.col(mean) * weight * grown, "d": grown}
    running = W(at, [*part, chunk]).rowsBetween(Window.unboundedPreceding, 0)
    has = has.withColumns({sums[k]: F.sum(v).over(running) for k, v in values.items()})
    totals = has.groupBy(*part, chunk).agg(*(F.max_by(sums[k], at).alias(sums[k]) for k in sums))
    decay = rest ** (size - 1) if rest > 0 else 0.0
    for back in (1, 2):
        names = {k: f"{sums[k]}{back}" for k in sums}
        before = totals.select(*(F.col(p).alias(f"{p}__") for p in part), (F.col(chunk) + back).alias(f"{chunk}__"), *((F.col(sums[k]) * decay).alias(names[k]) for k in sums))
        on = [F.col(p).eqNullSafe(F.col(f"{p}__")) for p in part] + [F.col(chunk) == F.col(f"{chunk}__")]
        has = has.join(before, on, "left").drop(f"{chunk}__", *(f"{p}__" for p in part))
    faded = (lambda k: F.pow(F.lit(rest), k)) if rest > 0 else (lambda k: F.when(k == 0, 1.0).otherwise(0.0))
    total = {k: F.col(v) * faded(j) + F.coalesce(f"{v}1", F.lit(0.0)) * faded(j + 1) + F.coalesce(f"{v}2", F.lit(0.0)) * faded(j + 1 + size) for k, v in sums.items()}
    theirs = {k: fresh([*taken, mean], f"_of_{k}") for k in [*part, order_by]}
    means = has.select(*(F.col(k).alias(n) for k, n in theirs.items()), (F.try_divide(total["n"], total["d"]) if adjust else total["n"]).alias(mean))
    out = df.join(means, [F.col(k).eqNullSafe(F.col(n)) for k, n in theirs.items()], "left")
    out = out.select(*named(x for x in df.columns if x != name), mean)
    if part:
        return out.withColumn(name, F.last(mean, True).over(W(order_by, part).rowsBetween(Window.unboundedPreceding, 0))).drop(mean)
    last = fresh([*out.columns, name], "_last")
    return carried(out, order_by, mean, last, rows=rows).withColumn(name, F.col(last)["v"]).drop(mean, last, f"{last}_at")


def shift(c: str, w: WindowSpec, periods: int = 1) -> Column:
    return F.lag(c, periods).over(w)


def diff(c: str, w: WindowSpec, periods: int = 1) -> Column:
    return F.col(c) - F.lag(c, periods).over(w)


def pct_change(c: str, w: WindowSpec, periods: int = 1) -> Column:
    before = F.lag(c, periods).over(w)
    return F.try_divide(F.col(c) - before, before)


def cumsum(c: str, w: WindowSpec) -> Column:
    return F.when(F.col(c).isNotNull(), F.sum(c).over(w.rowsBetween(Window.unboundedPreceding, 0)))


def cumprod(c: str, w: WindowSpec) -> Column:
    return F.when(F.col(c).isNotNull(), F.product(c).over(w.rowsBetween(Window.unboundedPreceding, 0)))


def cummax(c: str, w: WindowSpec) -> Column:
    return F.max(c).over(w.rowsBetween(Window.unboundedPreceding, 0))


def cummin(c: str, w: WindowSpec) -> Column:
    return F.min(c).over(w.rowsBetween(Window.unboundedPreceding, 0))


def rank(c: str, method: str = "average", ascending: bool = True, partition_by: Sequence[str] = (), tie: str | None = None) -> Column:
    """Ranks from 1 within groups; NULL for a missing value, which takes no rank.  ``ranked`` ranks a whole table."""
    key = F.col(c).asc_nulls_last() if ascending else F.col(c).desc_nulls_last()
    w = Window.partitionBy(*partition_by).orderBy(key)
    peers = F.count("*").over(Window.partitionBy(*partition_by, c))
    least = F.rank().over(w).cast("long")
    out = {
        "min": lambda: least,
        "max": lambda: least + peers - 1,
        "average": lambda: least + (peers - 1) / 2,
        "dense": lambda: F.dense_rank().over(w).cast("long"),
        "first": lambda: F.row_number().over(Window.partitionBy(*partition_by).orderBy(key, F.col(tie))).cast("long"),
    }[method]()
    return F.when(F.col(c).isNotNull(), out)


def ranked(df: DataFrame, c: str, name: str, method: str = "average", ascending: bool = True, tie: str | None = None, rows: int | None = None) -> DataFrame:
    """Adds the rank of a value in the whole table, from running counts of the different values; NULL for a missing one."""
    taken = [*df.columns, name]
    n, upto, value, place = (fresh(taken, x) for x in ("_n", "_upto", "_value", "_place"))
    has = df.filter(F.col(c).isNotNull())
    if method == "first":
        numbered = with_row_index(has, [c, tie], place, rows, [ascending, True])
        missing = df.filter(F.col(c).isNull()).withColumn(place, F.lit(None).cast("long"))
        out = numbered.unionByName(missing).withColumn(name, F.col(place) + 1)
        return out.select(*named(x for x in df.columns if x != name), name)
    counts = has.groupBy(F.col(c).alias(value)).agg(F.count("*").alias(n))
    if method == "dense":
        counts = with_row_index(counts, value, place, rows, ascending).withColumn(place, F.col(place) + 1)
    else:
        order = fresh(taken, "_order")
        counts = with_row_index(counts, value, order, rows, ascending)
        counts = cumulative(counts, order, n, upto, rows).drop(order)
        least = F.col(upto) - F.col(n) + 1
        counts = counts.withColumn(place, {"min": least, "max": F.col(upto), "average": least + (F.col(n) - 1) / 2}[method])
    out = df.join(counts.select(value, place), F.col(c) == F.col(value), "left").withColumn(name, F.col(place))
    return out.select(*named(x for x in df.columns if x != name), name)


def filled(df: DataFrame, c: str, order_by: str, name: str | None = None, backward: bool = False, limit: int | None = None, rows: int | None = None) -> DataFrame:
    """``fill`` over a whole table in the order of a key."""
    name, last = name or c, fresh([*df.columns, name or c], "_last")
    at = f"{last}_at"
    out = carried(df, order_by, c, last, backward, rows)
    near = F.lit(True) if limit is None else F.abs(F.col(at) - F.col(last)["at"]) <= limit
    out = out.withColumn(name, F.when(near, F.col(last)["v"]))
    return out.select(*named(x for x in df.columns if x != name), name)


def fill(c: str, w: WindowSpec, backward: bool = False, limit: int | None = None) -> Column:
    """The last value before a missing one (or the next after it), at most ``limit`` rows on."""
    if limit is not None:
        frame = w.rowsBetween(0, limit) if backward else w.rowsBetween(-limit, 0)
    else:
        frame = w.rowsBetween(0, Window.unboundedFollowing) if backward else w.rowsBetween(Window.unboundedPreceding, 0)
    return F.first(c, True).over(frame) if backward else F.last(c, True).over(frame)


def interpolate(df: DataFrame, c: str, order_by: str, name: str | None = None, partition_by: Sequence[str] = (), rows: int | None = None) -> DataFrame:
    """Missing values on the line between their neighbours by position; at the ends the nearest value."""
    name = name or c
    p, a, b = (fresh([*df.columns, name], x) for x in ("_p", "_a", "_b"))
    if partition_by:
        w = W(order_by, partition_by)
        at = F.when(F.col(c).isNotNull(), F.struct(F.col(p).alias("at"), F.col(c).cast("double").alias("v")))
        out = df.withColumn(p, F.row_number().over(w))
        out = out.withColumns({a: F.last(at, True).over(w.rowsBetween(Window.unboundedPreceding, 0)), b: F.first(at, True).over(w.rowsBetween(0, Window.unboundedFollowing))})
    else:
        out = carried(df, order_by, c, a, False, rows)
        out = carried(out, order_by, c, b, True, rows).withColumn(p, F.col(f"{a}_at"))
    x, y = F.col(a), F.col(b)
    v = lambda s: s["v"].cast("double")
    line = v(x) + (v(y) - v(x)) * (F.col(p) - x["at"]) / (y["at"] - x["at"])
    value = F.when(F.col(c).isNotNull(), F.col(c).cast("double")).when(x.isNotNull() & y.isNotNull(), line).otherwise(F.coalesce(v(x), v(y)))
    return out.withColumn(name, value).select(*named(z for z in df.columns if z != name), name)
