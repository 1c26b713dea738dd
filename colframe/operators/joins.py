"""Joins: equality, ordered, by index, and the nearest row in order."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from colframe.operators.ordering import fresh, keys, with_block

HOW = {"inner": "inner", "left": "left", "right": "right", "outer": "full"}


def merge(left: DataFrame, right: DataFrame, on: str | Sequence[str] | None = None, how: str = "inner", left_on: str | Sequence[str] | None = None, right_on: str | Sequence[str] | None = None, null_safe: bool = False) -> DataFrame:
    """Equality join; without keys on the common columns, and the product if there are none.

    Columns of the right with a name that is taken get ``_r``, until it is free.  Keys of one name appear once; of different names
    both stay.  NULL matches NULL only with ``null_safe``.
    """
    if how not in HOW:
        raise ValueError(f"how={how}")
    lk = keys(left_on or on or [c for c in left.columns if c in right.columns])
    rk = keys(right_on or on or lk)
    if not lk:
        return left.crossJoin(right)
    own = {c: fresh([*left.columns, *right.columns], f"_r_{c}") for c in right.columns}
    r = right.select(*(F.col(c).alias(n) for c, n in own.items()))
    equal = [F.col(a).eqNullSafe(F.col(own[b])) if null_safe else F.col(a) == F.col(own[b]) for a, b in zip(lk, rk)]
    joined = left.join(r, equal, HOW[how])
    shared = {a for a, b in zip(lk, rk) if a == b}
    out = [F.coalesce(F.col(c), F.col(own[c])).alias(c) if c in shared else F.col(c) for c in left.columns]
    names = list(left.columns)
    for c in right.columns:
        if c not in shared:
            name = c
            while name in names:
                name += "_r"
            names.append(name)
            out.append(F.col(own[c]).alias(name))
    return joined.select(*out)


def merge_ordered(left: DataFrame, right: DataFrame, on: str, how: str = "outer") -> DataFrame:
    return merge(left, right, on, how).orderBy(on)


def semi(left: DataFrame, right: DataFrame, on: str | Sequence[str], anti: bool = False) -> DataFrame:
    return left.join(right.select(*keys(on)), keys(on), "left_anti" if anti else "left_semi")


def index_join(left: DataFrame, right: DataFrame, on: str, order_by: str | Sequence[str], how: str = "left", suffix: str = "_r") -> DataFrame:
    """Join by an index column; for ``left`` with the first row of the right for each index."""
    if how == "left":
        first = Window.partitionBy(on).orderBy(*keys(order_by))
        n = fresh(right, "_n")
        right = right.withColumn(n, F.row_number().over(first)).filter(F.col(n) == 1).drop(n)
    out = merge(left, right, on, how)
    return out if suffix == "_r" else out.toDF(*(c[:-2] + suffix if c.endswith("_r") and c[:-2] in left.columns else c for c in out.columns))


def merge_asof(left: DataFrame, right: DataFrame, on: str, direction: str = "backward", by: str | Sequence[str] = (), rows: int | None = None) -> DataFrame:
    """Each left row with the right row nearest in ``on``: the last not after it, the first not before it, or the nearer.

    Both sides are stacked and read in one sorted window, of ``by`` if there is one, else of blocks of the left
    key's quantiles with the last or first right row of the other blocks carried along.  Of right rows with equal
    keys the last (forward: first) in the order of all their columns is taken; equal gaps go backward.
    """
    by = keys(by) if by else []
    values = [c for c in right.columns if c != on and c not in by]
    names = {c: f"{c}_r" if c in left.columns else c for c in values}
    l, r, k, block, lo, hi = (fresh(by, x) for x in ("_l", "_r", "_k", "_block", "_lo", "_hi"))  # noqa: E741
    tagged_l = left.select(F.struct(*left.columns).alias(l), F.lit(None).alias(r), F.col(on).alias(k), *by)
    tagged_r = right.select(F.lit(None).alias(l), F.struct(F.col(on).alias("k"), *(F.col(c).alias(f"v{i}") for i, c in enumerate(values))).alias(r), F.col(on).alias(k), *by)
    tagged_l = tagged_l.withColumn(r, F.lit(None).cast(tagged_r.schema[r].dataType))
    both = tagged_l.unionByName(tagged_r.withColumn(l, F.lit(None).cast(tagged_l.schema[l].dataType))).filter(F.col(k).isNotNull() | F.col(l).isNotNull())
    if not by:
        both = with_block(both, k, rows, block)
    part = by or [block]
    right_first = F.when(F.col(l).isNull(), 0).otherwise(1)
    line = Window.orderBy(block)
    ends = None if by else both.filter(F.col(l).isNull()).groupBy(block).agg(F.max(r).alias(hi), F.min(r).alias(lo))
    blocks = None if by else both.select(block).distinct().join(ends, block, "left")  # a row a block

    def nearest(back: bool) -> Column:
        """The last right row not after (or the first not before), of the block and of those beyond it."""
        order = (F.col(k).asc_nulls_first(), right_first, F.col(r)) if back else (F.col(k).desc_nulls_last(), right_first, F.desc(r))
        return F.last(r, True).over(Window.partitionBy(*part).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))

    found = {"backward": ("back",), "forward": ("fore",), "nearest": ("back", "fore")}[direction]
    at = {x: fresh([*by, l, r, k, block], f"_{x}") for x in found}
    both = both.withColumns({at[x]: nearest(x == "back") for x in found})
    if not by:
        beyond = {"back": F.last(hi, True).over(line.rowsBetween(Window.unboundedPreceding, -1)), "fore": F.first(lo, True).over(line.rowsBetween(1, Window.unboundedFollowing))}
        carried = blocks.select(block, *(beyond[x].alias(f"{at[x]}_end") for x in found))
        both = both.join(F.broadcast(carried), block).withColumns({at[x]: F.coalesce(at[x], f"{at[x]}_end") for x in found})
    has = F.col(k).isNotNull()
    b, f = (F.when(has, F.col(at[x])) if x in at else None for x in ("back", "fore"))
    if direction == "nearest":
        number = (lambda c: F.unix_micros(c.cast("timestamp"))) if left.schema[on].dataType.typeName().startswith("timestamp") else (lambda c: c)
        nearer = f["k"].isNull() | (number(F.col(k)) - number(b["k"]) <= number(f["k"]) - number(F.col(k)))
        best = F.when(b["k"].isNotNull() & nearer, b).otherwise(f)
    else:
        best = b if direction == "backward" else f
    out = both.filter(F.col(l).isNotNull()).select(l, best.alias(r))
    return out.select(f"{l}.*", *(F.col(r)[f"v{i}"].alias(names[c]) for i, c in enumerate(values)))
