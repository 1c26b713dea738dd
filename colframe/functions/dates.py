"""Date and time functions; text is read as a timestamp, and what can't be read is NULL."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from colframe.functions.math import col

#: Strftime directives and the patterns that mean the same.
DIRECTIVES = {"Y": "yyyy", "m": "MM", "d": "dd", "H": "HH", "M": "mm", "S": "ss", "f": "SSSSSS", "y": "yy", "j": "DDD", "b": "MMM", "B": "MMMM", "a": "EEE", "A": "EEEE", "p": "a", "I": "hh"}
#: Frequencies of a fixed length, in seconds.
SECONDS = {"s": 1, "S": 1, "min": 60, "T": 60, "h": 3600, "H": 3600, "D": 86400}


def pattern(fmt: str) -> str:
    """A strftime format as a Spark date pattern."""
    out = ""
    for directive, text in re.findall(r"%(.)|([^%]+)", fmt):
        if directive:
            out += "'%'" if directive == "%" else DIRECTIVES[directive]
        else:
            out += re.sub(r"[A-Za-z]+", lambda m: f"'{m[0]}'", text.replace("'", "''"))
    return out


def to_datetime(c, fmt: str | None = None, errors: str = "raise") -> Column:
    f = [F.lit(pattern(fmt))] if fmt else []
    return (F.try_to_timestamp if errors == "coerce" else F.to_timestamp)(col(c), *([f[0]] if errors == "coerce" and f else [pattern(fmt)] if fmt else []))


def year(c):
    return F.year(col(c))


def month(c):
    return F.month(col(c))


def day(c):
    return F.dayofmonth(col(c))


def hour(c):
    return F.hour(col(c))


def minute(c):
    return F.minute(col(c))


def second(c):
    return F.second(col(c))


def dayofweek(c):
    """Monday is 0."""
    return F.weekday(col(c))


def dayofyear(c):
    return F.dayofyear(col(c))


def quarter(c):
    return F.quarter(col(c))


def date(c):
    return F.to_date(col(c))


def time(c):
    return F.date_format(col(c), "HH:mm:ss.SSSSSS")


def strftime(c, fmt: str) -> Column:
    return F.date_format(col(c), pattern(fmt))


def _step(freq: str) -> int:
    n, unit = re.fullmatch(r"(\d*)([A-Za-z]+)", freq).groups()
    return int(n or 1) * SECONDS[unit]


def floor(c, freq: str) -> Column:
    """The start of the period of a frequency like ``15min``, ``h`` or ``D``, counted from the epoch."""
    step = _step(freq)
    seconds = F.unix_seconds(col(c).cast("timestamp"))
    return F.timestamp_seconds(seconds - F.pmod(seconds, F.lit(step))).cast("timestamp_ntz")


def ceil(c, freq: str) -> Column:
    low = floor(c, freq)
    return F.when(low == col(c).cast("timestamp_ntz"), low).otherwise(F.timestamp_seconds(F.unix_seconds(low.cast("timestamp")) + _step(freq)).cast("timestamp_ntz"))


def date_range(spark: SparkSession, start: str, end: str | None = None, periods: int | None = None, freq: str = "D") -> DataFrame:
    """A table ``date`` of regular times; ``ME`` gives month ends."""
    first = F.lit(start).cast("timestamp_ntz")
    if freq == "ME":
        last = F.add_months(F.lit(start).cast("date"), periods - 1) if periods is not None else F.lit(end).cast("date")
        months = F.explode(F.sequence(F.trunc(F.lit(start).cast("date"), "month"), F.trunc(last, "month"), F.expr("interval 1 month")))
        days = spark.range(1).select(months.alias("month")).select(F.last_day("month").alias("date"))
        days = days.filter(F.col("date") >= F.lit(start).cast("date"))
        return (days if end is None else days.filter(F.col("date") <= F.lit(end).cast("date"))).select(F.col("date").cast("timestamp_ntz").alias("date"))
    step = _step(freq)
    stop = F.lit(end).cast("timestamp_ntz") if end else first + F.make_dt_interval(secs=F.lit((periods - 1) * step).cast("decimal(18,6)"))
    return spark.range(1).select(F.explode(F.sequence(first, stop, F.expr(f"interval {step} seconds"))).alias("date"))
