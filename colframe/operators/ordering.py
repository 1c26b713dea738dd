"""Row order, which Spark doesn't have by itself: every positional operator names its key.

A row index is made in two passes without a one-partition window: rows are cut
into blocks at points of a sample of their keys, numbered within each block,
and each block gets the number of rows before it.  Keys can be of any type that
can be sorted, and several.  Global running and moving functions use the same
blocks (``by_block``, ``cumulative``, ``carried``).

Helper columns take names that the table doesn't have.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Rows that one block of a global order is meant to hold, and most blocks (then they hold more rows).
BLOCK_ROWS, MOST_BLOCKS = 1_000_000, 20_000
#: Sampled keys a block, from which its ends are taken.
SAMPLED = 30
#: Blocks whose number is found by a scan of all ends; by bisection beyond.
FEW_BLOCKS = 16


def keys(order_by: str | Sequence[str]) -> list[str]:
    return [order_by] if isinstance(order_by, str) else list(order_by)


def fresh(df: DataFrame | Sequence[str], name: str) -> str:
    """``name``, with underscores added until no column has it."""
    taken = {c.lower() for c in (df.columns if isinstance(df, DataFrame) else df)}
    while name.lower() in taken:
        name += "_"
    return name


def named(names: Iterable[str]) -> list[Column]:
    """Columns by their whole names, also with points in them."""
    return [F.col("`" + n.replace("`", "``") + "`") for n in names]


def directions(n: int, ascending: bool | Sequence[bool]) -> list[bool]:
    return [ascending] * n if isinstance(ascending, bool) else list(ascending)


def sort_columns(order_by: str | Sequence[str], ascending: bool | Sequence[bool] = True, nulls_largest: bool = False) -> list[Column]:
    """Sort keys; a missing value is the least one, or the largest."""
    by = keys(order_by)
    up = directions(len(by), ascending)
    if nulls_largest:
        return [F.col(c).asc_nulls_last() if a else F.col(c).desc_nulls_first() for c, a in zip(by, up)]
    return [F.col(c).asc_nulls_first() if a else F.col(c).desc_nulls_last() for c, a in zip(by, up)]


def _not_after(cut: Column, by: list[str], up: list[bool], nulls_largest: bool) -> Column:
    """Whether the keys ``cut.k0, cut.k1 ..`` come before a row's, or are equal to them."""
    out = F.lit(True)
    for i, (c, a) in reversed(list(enumerate(zip(by, up)))):
        x, y = cut[f"k{i}"], F.col(c)
        missing_first = a != nulls_largest
        before = F.when(x.isNull(), y.isNotNull() if missing_first else F.lit(False)).when(y.isNull(), F.lit(not missing_first)).otherwise(x < y if a else x > y)
        out = before | (x.eqNullSafe(y) & out)
    return out


def _ends(df: DataFrame, by: list[str], up: list[bool], nulls_largest: bool, blocks: int, n: int) -> Column | None:
    """An array of structs, the keys at the ends of blocks in order; values go through text and back, exactly."""
    share = min(1.0, blocks * SAMPLED / n)
    some = df.select(*by) if share == 1 else df.select(*by).sample(share, 7)
    some = some.orderBy(*sort_columns(by, up, nulls_largest))
    kinds = [df.schema[c].dataType for c in by]
    as_is = ("string", "binary", "boolean")
    rows = some.select(*(F.col(c) if k.typeName() in as_is else F.col(c).cast("string") for c, k in zip(by, kinds))).collect()
    picked = [tuple(rows[len(rows) * i // blocks]) for i in range(1, blocks)] if rows else []
    picked = list(dict.fromkeys(map(lambda r: tuple(bytes(v) if isinstance(v, bytearray) else v for v in r), picked)))
    if not picked:
        return None
    return F.array(*(F.struct(*(F.lit(v).cast(k).alias(f"k{i}") for i, (v, k) in enumerate(zip(r, kinds)))) for r in picked))


def with_block(df: DataFrame, order_by: str | Sequence[str], rows: int | None = None, name: str = "_block", ascending: bool | Sequence[bool] = True, nulls_largest: bool = False) -> DataFrame:
    """Adds a block number that grows with the keys: blocks in order, about ``rows`` rows each.

    Rows with equal keys share a block.  A table of one block's size has block 0 alone.
    """
    by, rows = keys(order_by), rows or BLOCK_ROWS
    up = directions(len(by), ascending)
    n = df.count()
    blocks = min(MOST_BLOCKS, -(-n // rows))
    ends = _ends(df, by, up, nulls_largest, blocks, n) if blocks > 1 else None
    if ends is None:
        return df.withColumn(name, F.lit(0))
    if blocks <= FEW_BLOCKS:
        return df.withColumn(name, F.size(F.filter(ends, lambda x: _not_after(x, by, up, nulls_largest))))

    def halved(s: Column, step: Column) -> Column:
        middle = F.floor((s["lo"] + s["hi"]) / 2).cast("int")
        after = F.when(s["lo"] >= s["hi"], F.lit(None).cast("boolean")).otherwise(_not_after(F.get(ends, middle), by, up, nulls_largest))
        return F.struct(F.when(after, middle + 1).otherwise(s["lo"]).alias("lo"), F.when(~after, middle).otherwise(s["hi"]).alias("hi"))

    steps = F.sequence(F.lit(1), F.lit(math.ceil(math.log2(blocks)) + 1))
    return df.withColumn(name, F.aggregate(steps, F.struct(F.lit(0).alias("lo"), F.size(ends).alias("hi")), halved)["lo"])


def _before(blocked: DataFrame, block: str, value: Column, name: str) -> DataFrame:
    """``(block, name)``: the sum of an aggregate over the blocks before; a row a block."""
    line = Window.orderBy(block).rowsBetween(Window.unboundedPreceding, -1)
    sums = blocked.groupBy(block).agg(value.alias("x"))
    return F.broadcast(sums.select(block, F.coalesce(F.sum("x").over(line), F.lit(0)).alias(name)))


def with_row_index(df: DataFrame, order_by: str | Sequence[str], name: str = "row", rows: int | None = None, ascending: bool | Sequence[bool] = True, nulls_largest: bool = False) -> DataFrame:
    """Adds positions from 0 in the order of the keys."""
    block, nth, base = (fresh([*df.columns, name], x) for x in ("_block", "_nth", "_base"))
    blocked = with_block(df, order_by, rows, block, ascending, nulls_largest)
    here = Window.partitionBy(block).orderBy(*sort_columns(order_by, ascending, nulls_largest))
    numbered = blocked.withColumn(nth, F.row_number().over(here)).join(_before(blocked, block, F.count("*"), base), block)
    return numbered.withColumn(name, (F.col(base) + F.col(nth) - 1).cast("long")).select(*named(c for c in df.columns if c != name), name)


def by_block(df: DataFrame, order_by: str | Sequence[str], reach: int, add, rows: int | None = None, ahead: bool = False) -> DataFrame:
    """Adds columns of a moving window over the whole table: ``add(window)`` gives them by name.

    Each block also gets the ``reach`` rows before it (or after it), which are dropped again; ``add`` is given the
    window specification of a block.
    """
    rows = max(rows or BLOCK_ROWS, reach)
    row, block, halo = (fresh(df, x) for x in ("_row", "_block", "_halo"))
    indexed = with_row_index(df, order_by, row, rows)
    at = F.floor(F.col(row) / rows)
    own = indexed.withColumn(block, at).withColumn(halo, F.lit(False))
    reached = F.col(row) % rows < reach if ahead else F.col(row) % rows >= rows - reach
    lent = indexed.withColumn(block, at - 1 if ahead else at + 1).filter(reached).withColumn(halo, F.lit(True))
    made = own.unionByName(lent).withColumns(add(Window.partitionBy(block).orderBy(row)))
    return made.filter(~F.col(halo)).drop(block, halo, row)


def cumulative(df: DataFrame, order_by: str | Sequence[str], value: Column | str, name: str, rows: int | None = None) -> DataFrame:
    """Adds a running sum over the whole table: sums within blocks plus the sums of the blocks before."""
    value = F.col(value) if isinstance(value, str) else value
    v, block, base, r = (fresh([*df.columns, name], x) for x in ("_v", "_block", "_base", "_r"))
    blocked = with_block(df.withColumn(v, value), order_by, rows, block)
    here = Window.partitionBy(block).orderBy(*sort_columns(order_by)).rowsBetween(Window.unboundedPreceding, 0)
    out = blocked.withColumn(r, F.coalesce(F.sum(v).over(here), F.lit(0))).join(_before(blocked, block, F.sum(v), base), block)
    out = out.withColumn(name, F.when(F.col(v).isNotNull(), F.col(base) + F.col(r)))
    return out.select(*named(c for c in df.columns if c != name), name)


def carried(df: DataFrame, order_by: str, value: str, name: str, backward: bool = False, rows: int | None = None) -> DataFrame:
    """Adds ``name``, the last row (or the next) with a value as ``(at, v)``, and ``name_at``, the row's own position.

    Within blocks by a window, over blocks by the ends that each hands on.
    """
    block, end, local = (fresh([*df.columns, name, f"{name}_at"], x) for x in ("_block", "_end", "_local"))
    rows = rows or BLOCK_ROWS
    at = f"{name}_at"
    indexed = with_row_index(df, order_by, at, rows).withColumn(block, F.floor(F.col(at) / rows))
    has = F.when(F.col(value).isNotNull(), F.struct(F.col(at).alias("at"), F.col(value).alias("v")))
    w, line = Window.partitionBy(block).orderBy(at), Window.orderBy(block)
    if backward:
        mine = F.first(has, True).over(w.rowsBetween(0, Window.unboundedFollowing))
        ends = indexed.groupBy(block).agg(F.min(has).alias("x")).select(block, F.first("x", True).over(line.rowsBetween(1, Window.unboundedFollowing)).alias(end))
    else:
        mine = F.last(has, True).over(w.rowsBetween(Window.unboundedPreceding, 0))
        ends = indexed.groupBy(block).agg(F.max(has).alias("x")).select(block, F.last("x", True).over(line.rowsBetween(Window.unboundedPreceding, -1)).alias(end))
    out = indexed.withColumn(local, mine).join(F.broadcast(ends), block, "left")  # a row a block
    return out.withColumn(name, F.coalesce(local, end)).drop(block, end, local)
