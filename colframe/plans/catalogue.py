"""Every registered query of the dataframe surface, and its SQL, by name."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from colframe.functions import dates as D
from colframe.functions import expressions as X
from colframe.functions import math as M
from colframe.functions import strings as S
from colframe.functions import udf as U
from colframe.operators import aggregates as A
from colframe.operators import indexed as N
from colframe.operators import joins as J
from colframe.operators import ordering as O
from colframe.operators import relational as R
from colframe.operators import reshape as P
from colframe.operators import stats as T
from colframe.operators import windows as V
from colframe.sources import database as B
from colframe.sources import files as I
from colframe.streaming import lazy as L

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


class Tables:
    """The tables of a folder, by name."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder

    def __getattr__(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")


def add(name: str, make: Callable[[Tables], DataFrame], sql: str | None = None) -> None:
    QUERIES[name] = lambda spark, folder: make(Tables(spark, folder))
    if sql:
        ORACLES[name] = sql


def money(c: str):
    return F.col(c).cast("double")


def holed(t: Tables) -> DataFrame:
    """Events with every seventh value missing."""
    return t.events.select("event_id", "user_id", "event_type", F.when(F.col("event_id") % 7 != 0, F.col("value")).alias("v"))


HOLED = "(SELECT event_id, user_id, event_type, CASE WHEN event_id % 7 <> 0 THEN value END AS v FROM events)"
r6 = lambda c: F.round(c, 6)

# Scan, project, filter

add("scan_parquet", lambda t: t.nation, "SELECT * FROM nation")
add("select_cols", lambda t: R.select(t.part, ["p_partkey", "p_name"]), "SELECT p_partkey, p_name FROM part")
add("filter_cmp", lambda t: t.events.filter(F.col("value") > 5).select("event_id", "value"), "SELECT event_id, value FROM events WHERE value > 5")
add(
    "query_expr",
    lambda t: X.query(t.events, "value > 5 and user_id % 2 == 0 and not (event_id < 100)").select("event_id"),
    "SELECT event_id FROM events WHERE value > 5 AND user_id % 2 = 0 AND NOT (event_id < 100)",
)
add(
    "eval_expr",
    lambda t: X.evaluate(t.events, "where(value > 5, sqrt(abs(value)), value * 2 - 1)", "e").select("event_id", r6("e").alias("e")),
    "SELECT event_id, round(CASE WHEN value > 5 THEN sqrt(abs(value)) ELSE value * 2 - 1 END, 6) AS e FROM events",
)
add(
    "eval_power",
    lambda t: X.evaluate(t.events, "user_id ** 2 - value ** 0.5", "e").select("event_id", r6("e").alias("e")),
    "SELECT event_id, round(pow(user_id, 2) - pow(value, 0.5), 6) AS e FROM events",
)
add(
    "eval_signs",
    lambda t: X.evaluate(t.events, "-value + user_id * 2 - 3 / 4 + user_id // 7 + user_id % 7", "e").select("event_id", r6("e").alias("e")),
    "SELECT event_id, round(-value + user_id * 2 - 0.75 + user_id // 7 + user_id % 7, 6) AS e FROM events",
)
add(
    "query_not",
    lambda t: X.query(t.events, "not (value > 5) or not user_id < 50").select("event_id"),
    "SELECT event_id FROM events WHERE NOT (value > 5) OR NOT user_id < 50",
)
add(
    "comparisons",
    lambda t: X.query(t.events, "value >= 2 and value <= 8 and user_id != 7 and (user_id < 40 or user_id == 55) and -value < -1").select("event_id"),
    "SELECT event_id FROM events WHERE value >= 2 AND value <= 8 AND user_id <> 7 AND (user_id < 40 OR user_id = 55) AND -value < -1",
)
add(
    "assign_expr",
    lambda t: R.assign(t.customer, twice=lambda d: d["c_custkey"] * 2, one=1).select("c_custkey", "twice", "one"),
    "SELECT c_custkey, c_custkey * 2 AS twice, 1 AS one FROM customer",
)
add("filter_like_cols", lambda t: R.filter_columns(t.part, like="key"), "SELECT p_partkey FROM part")
add(
    "rename_drop",
    lambda t: R.drop(R.rename(t.customer, {"c_name": "name"}), [c for c in t.customer.columns if c not in ("c_custkey", "c_name")]),
    "SELECT c_custkey, c_name AS name FROM customer",
)
add(
    "iloc_slice",
    lambda t: R.iloc(t.events, "event_id", 10, 50, 3).select("event_id"),
    "SELECT event_id FROM (SELECT event_id, row_number() OVER (ORDER BY event_id) - 1 AS r FROM events) WHERE r >= 10 AND r < 50 AND (r - 10) % "
    "3 = 0",
)
add(
    "iloc_rows",
    lambda t: R.iloc_rows(t.events, "event_id", [0, 3, 5]).select("event_id"),
    "SELECT event_id FROM (SELECT event_id, row_number() OVER (ORDER BY event_id) - 1 AS r FROM events) WHERE r IN (0, 3, 5)",
)
add(
    "loc_labels",
    lambda t: R.loc(t.orders, "o_orderkey", [1, 2, 3, 7], ["o_orderkey", "o_custkey"]),
    "SELECT o_orderkey, o_custkey FROM orders WHERE o_orderkey IN (1, 2, 3, 7)",
)
add(
    "loc_slice",
    lambda t: R.loc_slice(t.orders, "o_orderkey", 10, 20).select("o_orderkey"),
    "SELECT o_orderkey FROM orders WHERE o_orderkey BETWEEN 10 AND 20",
)
add("head", lambda t: R.head(t.customer, 5, "c_custkey").select("c_custkey"), "SELECT c_custkey FROM customer ORDER BY c_custkey LIMIT 5")
add("tail", lambda t: R.tail(t.customer, "c_custkey", 5).select("c_custkey"), "SELECT c_custkey FROM customer ORDER BY c_custkey DESC LIMIT 5")
add(
    "row_index",
    lambda t: O.with_row_index(t.events, "event_id", "row", 1000).select("event_id", "row"),
    "SELECT event_id, row_number() OVER (ORDER BY event_id) - 1 AS row FROM events",
)
add(
    "isin",
    lambda t: t.events.select("event_id", M.is_in("event_type", ["click", "view"]).alias("hit")),
    "SELECT event_id, event_type IN ('click', 'view') AS hit FROM events",
)
add(
    "between",
    lambda t: t.events.select("event_id", M.between("value", 2, 5, "left").alias("hit")),
    "SELECT event_id, value >= 2 AND value < 5 AS hit FROM events",
)
add(
    "clip",
    lambda t: t.events.select("event_id", M.clip("value", 1.0, 5.0).alias("c")),
    "SELECT event_id, least(greatest(value, 1.0), 5.0) AS c FROM events",
)
add(
    "round_even",
    lambda t: t.region.select("r_regionkey", M.round_even(F.col("r_regionkey") + 0.5).alias("r")),
    "SELECT r_regionkey, round_even(r_regionkey + 0.5::DOUBLE, 0) AS r FROM region",
)
add(
    "floor_div_mod",
    lambda t: t.events.select("event_id", M.floor_div(F.col("user_id") - 50, 7).alias("d"), M.floor_mod(F.col("user_id") - 50, 7).cast("long").alias("m")),
    "SELECT event_id, CAST(floor((user_id - 50) / 7.0) AS BIGINT) AS d, CAST((user_id - 50) - 7 * floor((user_id - 50) / 7.0) AS BIGINT) AS m "
    "FROM events",
)
add(
    "safe_division",
    lambda t: t.events.select("event_id", r6(M.safe_div("value", F.col("user_id") % 3)).alias("q")),
    "SELECT event_id, round(CASE WHEN user_id % 3 <> 0 THEN value / (user_id % 3) END, 6) AS q FROM events",
)
add(
    "replace_values",
    lambda t: t.events.select("event_id", M.replace_values("event_type", {"click": "view", "view": "seen"}).alias("e")),
    "SELECT event_id, CASE WHEN event_type IN ('click', 'view') THEN 'seen' ELSE event_type END AS e FROM events",
)
add(
    "map_dict",
    lambda t: t.events.select("event_id", M.map_values("event_type", {"click": 1, "view": 2}).alias("code")),
    "SELECT event_id, CASE event_type WHEN 'click' THEN 1 WHEN 'view' THEN 2 END AS code FROM events",
)
add(
    "map_table",
    lambda t: M.map_by_table(t.customer, "c_nationkey", t.nation, "n_nationkey", "n_name", "nation").select("c_custkey", "nation"),
    "SELECT c_custkey, n_name AS nation FROM customer LEFT JOIN nation ON c_nationkey = n_nationkey",
)
add(
    "astype_coerce",
    lambda t: R.astype(t.customer.select("c_custkey", F.substring("c_name", 17, 2).alias("p")), {"p": "int"}, "coerce"),
    "SELECT c_custkey, TRY_CAST(substr(c_name, 17, 2) AS INTEGER) AS p FROM customer",
)
add(
    "info",
    lambda t: R.info(t.region).select("column", "non_null"),
    "SELECT 'r_regionkey' AS \"column\", count(r_regionkey) AS non_null FROM region UNION ALL SELECT 'r_name', count(r_name) FROM region",
)

add(
    "set_index",
    lambda t: N.set_index(t.orders.select("o_custkey", "o_orderkey"), "o_orderkey").to_frame(),
    "SELECT o_orderkey, o_custkey FROM orders",
)
add(
    "reset_index",
    lambda t: N.set_index(t.customer.select("c_name", "c_custkey"), "c_name").reset_index().to_frame(),
    "SELECT row_number() OVER (ORDER BY c_name) - 1 AS row, c_name AS index, c_custkey FROM customer",
)
add(
    "sort_index",
    lambda t: N.set_index(t.part.select("p_partkey", "p_size"), "p_partkey").sort_index(False).to_frame(),
    "SELECT p_partkey, p_size FROM part ORDER BY p_partkey DESC",
)
add(
    "memory_usage",
    lambda t: N.memory_usage(t.events.select("event_id", "event_type")),
    "SELECT 'event_id' AS \"column\", count(event_id) * 8 AS bytes FROM events UNION ALL SELECT 'event_type', CAST(sum(strlen(event_type)) AS BIGINT) FROM events",
)
add(
    "transposed",
    lambda t: N.transposed(t.region, "r_name").select("column", "ASIA", "EUROPE"),
    "SELECT 'r_regionkey' AS \"column\", max(CAST(r_regionkey AS VARCHAR)) FILTER (WHERE r_name = 'ASIA') AS ASIA, max(CAST(r_regionkey AS VARCHAR)) FILTER (WHERE r_name = 'EUROPE') AS EUROPE FROM region",
)
add(
    "shape",
    lambda t: t.spark.createDataFrame([(*N.set_index(t.orders, "o_orderkey").shape, N.set_index(t.orders, "o_orderkey").size)], "n long, columns long, size long"),
    "SELECT count(*) AS n, 5 AS columns, count(*) * 5 AS size FROM orders",
)
add(
    "from_dict",
    lambda t: N.from_dict(t.spark, {"a": [1, 2, None], "b": ["x", None, "z"], "c": [1, 2.5, float("nan")]}).to_frame(),
    "SELECT * FROM (VALUES (0, 1, 'x', 1.0::DOUBLE), (1, 2, NULL, 2.5), (2, NULL, 'z', NULL)) v(index, a, b, c)",
)
add(
    "from_array",
    lambda t: N.from_array(t.spark, [[1, 2.0], [3, 4.5]], ["a", "b"], index=["p", "q"]).to_frame(),
    "SELECT * FROM (VALUES ('p', 1, 2.0::DOUBLE), ('q', 3, 4.5)) v(index, a, b)",
)

# Missing values

add("fillna", lambda t: R.fillna(holed(t), {"v": 0.0}).select("event_id", "v"), f"SELECT event_id, coalesce(v, 0) AS v FROM {HOLED}")
add("dropna", lambda t: R.dropna(holed(t), "any", ["v"]).select("event_id"), f"SELECT event_id FROM {HOLED} WHERE v IS NOT NULL")
add(
    "isna",
    lambda t: R.isna(holed(t).select("v")).groupBy("v").agg(F.count("*").alias("n")),
    f"SELECT v IS NULL AS v, count(*) AS n FROM {HOLED} GROUP BY 1",
)
add(
    "ffill_bfill",
    lambda t: holed(t).select("event_id", V.fill("v", V.W("event_id", "user_id")).alias("f"), V.fill("v", V.W("event_id", "user_id"), backward=True).alias("b")),
    f"SELECT event_id, last_value(v IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY event_id) AS f, first_value(v IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS b FROM {HOLED}",
)
add(
    "ffill_limit",
    lambda t: t.events.select("event_id", F.when(F.col("event_id") % 5 == 0, F.col("value")).alias("v")).select("event_id", "v").transform(lambda d: V.filled(d, "v", "event_id", "f", limit=2, rows=1000)).select("event_id", "f"),
    "SELECT event_id, last_value(CASE WHEN event_id % 5 = 0 THEN value END IGNORE NULLS) OVER (ORDER BY event_id ROWS BETWEEN 2 PRECEDING AND "
    "CURRENT ROW) AS f FROM events",
)
add("interpolate", lambda t: V.interpolate(holed(t), "v", "event_id", "i", ["user_id"]).select("event_id", r6("i").alias("i")), f"""WITH p AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS p FROM {HOLED}),
w AS (SELECT event_id, p, v, last_value(v IGNORE NULLS) OVER a AS va, last_value(CASE WHEN v IS NOT NULL THEN p END IGNORE NULLS) OVER a AS pa, first_value(v IGNORE NULLS) OVER b AS vb, first_value(CASE WHEN v IS NOT NULL THEN p END IGNORE NULLS) OVER b AS pb FROM p WINDOW a AS (PARTITION BY user_id ORDER BY event_id), b AS (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))
SELECT event_id, round(CASE WHEN v IS NOT NULL THEN v WHEN va IS NOT NULL AND vb IS NOT NULL THEN va + (vb - va) * (p - pa) / (pb - pa) ELSE coalesce(va, vb) END, 6) AS i FROM w""")
add(
    "combine_first",
    lambda t: R.combine_first(holed(t).select("event_id", "v"), t.events.select("event_id", F.lit(-1.0).alias("v"), "user_id"), "event_id"),
    f"SELECT event_id, coalesce(v, -1.0) AS v, user_id FROM {HOLED}",
)
add(
    "update",
    lambda t: R.update(t.events.select("event_id", "value"), holed(t).select((F.col("event_id") + 50).alias("event_id"), F.col("v").alias("value")), "event_id"),
    f"SELECT e.event_id, CASE WHEN h.event_id IS NOT NULL THEN h.v ELSE e.value END AS value FROM events e LEFT JOIN (SELECT event_id + 50 AS event_id, v FROM {HOLED}) h ON e.event_id = h.event_id",
)
add(
    "fill_global",
    lambda t: V.filled(holed(t).withColumn("v", F.when(F.col("event_id") % 3 == 0, F.col("v"))), "v", "event_id", "f", rows=1000).select("event_id", "f"),
    f"SELECT event_id, last_value(CASE WHEN event_id % 3 = 0 THEN v END IGNORE NULLS) OVER (ORDER BY event_id) AS f FROM {HOLED}",
)
add(
    "fill_back_limit",
    lambda t: V.filled(holed(t).withColumn("v", F.when(F.col("event_id") % 5 == 0, F.col("v"))), "v", "event_id", "f", backward=True, limit=2, rows=1000).select("event_id", "f"),
    f"SELECT event_id, first_value(CASE WHEN event_id % 5 = 0 THEN v END IGNORE NULLS) OVER (ORDER BY event_id ROWS BETWEEN CURRENT ROW AND 2 FOLLOWING) AS f FROM {HOLED}",
)
add("interpolate_global", lambda t: V.interpolate(holed(t), "v", "event_id", "i", rows=1000).select("event_id", r6("i").alias("i")), f"""WITH p AS (SELECT *, row_number() OVER (ORDER BY event_id) AS p FROM {HOLED}),
w AS (SELECT event_id, p, v, last_value(v IGNORE NULLS) OVER a AS va, last_value(CASE WHEN v IS NOT NULL THEN p END IGNORE NULLS) OVER a AS pa, first_value(v IGNORE NULLS) OVER b AS vb, first_value(CASE WHEN v IS NOT NULL THEN p END IGNORE NULLS) OVER b AS pb FROM p WINDOW a AS (ORDER BY event_id), b AS (ORDER BY event_id ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))
SELECT event_id, round(CASE WHEN v IS NOT NULL THEN v WHEN va IS NOT NULL AND vb IS NOT NULL THEN va + (vb - va) * (p - pa) / (pb - pa) ELSE coalesce(va, vb) END, 6) AS i FROM w""")

# Joins

# all orders, a third of them without a customer's key; all customers, with keys a hundred higher: unmatched rows on both sides
_ORD = "SELECT o_orderkey AS k, CASE WHEN o_orderkey % 3 <> 0 THEN o_custkey END AS c FROM orders"
_CUS = "SELECT c_custkey + 100 AS c, c_name AS name FROM customer"
_ord = lambda t: t.orders.select(F.col("o_orderkey").alias("k"), F.when(F.col("o_orderkey") % 3 != 0, F.col("o_custkey")).alias("c"))
_cus = lambda t: t.customer.select((F.col("c_custkey") + 100).alias("c"), F.col("c_name").alias("name"))
for _how in ("inner", "left", "right", "outer"):
    add(
        f"merge_{_how}",
        lambda t, h=_how: J.merge(_ord(t), _cus(t), "c", h),
        f"SELECT k, coalesce(l.c, r.c) AS c, name FROM ({_ORD}) l {'FULL' if _how == 'outer' else _how.upper()} JOIN ({_CUS}) r ON l.c = r.c",
    )
add("merge_natural", lambda t: J.merge(_ord(t), _cus(t)), f"SELECT k, c, name FROM ({_ORD}) NATURAL JOIN ({_CUS})")
add("merge_cross", lambda t: J.merge(t.region.select("r_name"), t.nation.select("n_name")), "SELECT r_name, n_name FROM region, nation")
add(
    "merge_diff_keys",
    lambda t: J.merge(t.nation.select("n_name", "n_regionkey"), t.region.select("r_regionkey", "r_name"), left_on="n_regionkey", right_on="r_regionkey"),
    "SELECT n_name, n_regionkey, r_regionkey, r_name FROM nation JOIN region ON n_regionkey = r_regionkey",
)
add(
    "merge_clash",
    lambda t: J.merge(t.nation.select(F.col("n_regionkey").alias("k"), F.col("n_name").alias("name")), t.region.select(F.col("r_regionkey").alias("k"), F.col("r_name").alias("name")), "k"),
    "SELECT n_regionkey AS k, n_name AS name, r_name AS name_r FROM nation JOIN region ON n_regionkey = r_regionkey",
)
add(
    "merge_null_keys",
    lambda t: J.merge(t.nation.select("n_name", F.when(F.col("n_regionkey") > 0, F.col("n_regionkey")).alias("k")), t.region.select("r_name", F.when(F.col("r_regionkey") > 0, F.col("r_regionkey")).alias("k")), "k", null_safe=True).select("n_name", "r_name"),
    "SELECT n_name, r_name FROM nation JOIN region ON nullif(n_regionkey, 0) IS NOT DISTINCT FROM nullif(r_regionkey, 0)",
)
add("merge_ordered", lambda t: J.merge_ordered(_ord(t), _cus(t), "c"), ORACLES["merge_outer"])
add(
    "semi_join",
    lambda t: J.semi(t.customer, t.orders.select(F.col("o_custkey").alias("c_custkey")), "c_custkey").select("c_custkey"),
    "SELECT c_custkey FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders)",
)
add(
    "anti_join",
    lambda t: J.semi(t.customer, t.orders.select(F.col("o_custkey").alias("c_custkey")), "c_custkey", anti=True).select("c_custkey"),
    "SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders)",
)
add(
    "index_join_first",
    lambda t: J.index_join(t.customer.select(F.col("c_custkey").alias("i")), t.orders.select(F.col("o_custkey").alias("i"), "o_orderkey"), "i", "o_orderkey"),
    "SELECT c_custkey AS i, min(o_orderkey) AS o_orderkey FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY c_custkey",
)
# all events on both sides, the right ones half a minute later
_left = lambda t: t.events.select("event_id", "ts")
_right = lambda t: t.events.select((F.col("ts") + F.expr("INTERVAL 30 SECONDS")).alias("ts"), F.col("event_id").alias("other"))
_LR = "(SELECT event_id, ts FROM events) l ASOF LEFT JOIN (SELECT ts + INTERVAL 30 SECOND AS ts, event_id AS other FROM events) r ON l.ts {} r.ts"
add(
    "merge_asof_backward",
    lambda t: J.merge_asof(_left(t), _right(t), "ts", "backward"),
    f"SELECT event_id, l.ts AS ts, other FROM {_LR.format('>=')}",
)
add("merge_asof_forward", lambda t: J.merge_asof(_left(t), _right(t), "ts", "forward"), f"SELECT event_id, l.ts AS ts, other FROM {_LR.format('<=')}")
add("merge_asof_blocks", lambda t: J.merge_asof(_left(t), _right(t), "ts", "backward", rows=700), ORACLES["merge_asof_backward"])
add(
    "merge_asof_nearest",
    lambda t: J.merge_asof(_left(t), _right(t), "ts", "nearest", rows=700),
    f"SELECT b.event_id, b.ts, CASE WHEN b.other IS NULL THEN f.other WHEN f.other IS NULL OR b.ts - bt <= ft - b.ts THEN b.other ELSE f.other END AS other FROM (SELECT event_id, l.ts AS ts, other, r.ts AS bt FROM {_LR.format('>=')}) b JOIN (SELECT event_id, other, r.ts AS ft FROM {_LR.format('<=')}) f ON b.event_id = f.event_id",
)
add(
    "merge_asof_by",
    lambda t: J.merge_asof(t.events.select("event_id", "ts", "user_id"), t.events.select((F.col("ts") + F.expr("INTERVAL 30 SECONDS")).alias("ts"), "user_id", F.col("event_id").alias("other")), "ts", by="user_id"),
    "SELECT event_id, l.ts AS ts, l.user_id AS user_id, other FROM events l ASOF LEFT JOIN (SELECT ts + INTERVAL 30 SECOND AS ts, user_id, event_id AS other FROM events) r ON l.user_id = r.user_id AND l.ts >= r.ts",
)

# Aggregates

add(
    "reduce_all",
    lambda t: A.reduce_columns(holed(t), ["sum", "mean", "min", "max", "count", "std", "var", "median"], ["v"]).select(*(r6(c).alias(c) if c != "v_count" else c for c in ("v_sum", "v_mean", "v_min", "v_max", "v_count", "v_std", "v_var", "v_median"))),
    f"SELECT round(sum(v), 6) AS v_sum, round(avg(v), 6) AS v_mean, round(min(v), 6) AS v_min, round(max(v), 6) AS v_max, count(v) AS v_count, round(stddev_samp(v), 6) AS v_std, round(var_samp(v), 6) AS v_var, round(median(v), 6) AS v_median FROM {HOLED}",
)
add(
    "any_all",
    lambda t: t.events.agg(A.REDUCTIONS["any"](F.col("value") > 9).alias("a"), A.REDUCTIONS["all"](F.col("value") > 0).alias("b")),
    "SELECT bool_or(value > 9) AS a, bool_and(value > 0) AS b FROM events",
)
add(
    "describe",
    lambda t: A.describe(t.events, ["value"]).select("column", "count", *(r6(c).alias(c) for c in ("mean", "std", "min", "q25", "q50", "q75", "max"))),
    "SELECT 'value' AS \"column\", count(value) AS count, round(avg(value), 6) AS mean, round(stddev_samp(value), 6) AS std, round(min(value), 6) AS min, round(quantile_cont(value, 0.25), 6) AS q25, round(quantile_cont(value, 0.5), 6) AS q50, round(quantile_cont(value, 0.75), 6) AS q75, round(max(value), 6) AS max FROM events",
)
add("value_counts", lambda t: A.value_counts(t.events, "event_type"), "SELECT event_type, count(*) AS count FROM events GROUP BY 1")
add("unique", lambda t: A.unique(t.part, "p_brand"), "SELECT DISTINCT p_brand FROM part")
add(
    "modes",
    lambda t: A.modes(t.part, ["p_size", "p_brand"]),
    "SELECT (SELECT p_size FROM part GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1) AS p_size, (SELECT p_brand FROM part GROUP BY 1 ORDER BY "
    "count(*) DESC, 1 LIMIT 1) AS p_brand",
)
add(
    "mode",
    lambda t: A.mode(t.part, "p_size"),
    "SELECT p_size FROM (SELECT p_size, count(*) AS n FROM part GROUP BY 1) WHERE n = (SELECT max(n) FROM (SELECT count(*) AS n FROM part GROUP "
    "BY p_size))",
)
add(
    "quantile",
    lambda t: t.events.agg(A.quantile("value", [0.1, 0.9]).alias("q")).select(r6(F.col("q")[0]).alias("q10"), r6(F.col("q")[1]).alias("q90")),
    "SELECT round(quantile_cont(value, 0.1), 6) AS q10, round(quantile_cont(value, 0.9), 6) AS q90 FROM events",
)
add(
    "skew_kurt",
    lambda t: t.events.agg(r6(A.skew("value")).alias("s"), r6(A.kurt("value")).alias("k")),
    "SELECT round(skewness(value), 6) AS s, round(kurtosis(value), 6) AS k FROM events",
)
add("sem", lambda t: t.events.agg(r6(A.sem("value")).alias("s")), "SELECT round(stddev_samp(value) / sqrt(count(value)), 6) AS s FROM events")
add(
    "nunique",
    lambda t: holed(t).agg(A.nunique("v").alias("n"), A.nunique("v", dropna=False).alias("m")),
    f"SELECT count(DISTINCT v) AS n, count(DISTINCT v) + 1 AS m FROM {HOLED}",
)
add(
    "corr_cov",
    lambda t: t.events.agg(r6(F.corr("value", "user_id")).alias("r"), r6(F.covar_samp("value", "user_id")).alias("c")),
    "SELECT round(corr(value, user_id), 6) AS r, round(covar_samp(value, user_id), 6) AS c FROM events",
)
add(
    "autocorr",
    lambda t: A.autocorr(t.events, "value", "event_id", 2, rows=1000).select(r6("autocorr").alias("a")),
    "SELECT round(corr(value, x), 6) AS a FROM (SELECT value, lag(value, 2) OVER (ORDER BY event_id) AS x FROM events)",
)
add(
    "idxmax",
    lambda t: A.idx(t.events, "value", "event_id", "event_id"),
    "SELECT event_id AS label FROM events ORDER BY value DESC, event_id LIMIT 1",
)
add(
    "idxmin",
    lambda t: A.idx(holed(t), "v", "event_id", "event_id", largest=False),
    f"SELECT event_id AS label FROM {HOLED} WHERE v IS NOT NULL ORDER BY v, event_id LIMIT 1",
)
add(
    "idx_across",
    lambda t: t.orders.select("o_orderkey", A.idx_across(["o_orderkey", "o_custkey"]).alias("c")),
    "SELECT o_orderkey, CASE WHEN o_orderkey >= o_custkey THEN 'o_orderkey' ELSE 'o_custkey' END AS c FROM orders",
)
_SQLF = {"sum": "sum(v)", "mean": "avg(v)", "min": "min(v)", "max": "max(v)", "count": "count(v)", "std": "stddev_samp(v)", "var": "var_samp(v)", "median": "median(v)", "nunique": "count(DISTINCT v) + max(CASE WHEN v IS NULL THEN 1 ELSE 0 END)", "first": "arg_min(v, event_id) FILTER (WHERE v IS NOT NULL)", "last": "arg_max(v, event_id) FILTER (WHERE v IS NOT NULL)"}
for _f, _s in _SQLF.items():
    _whole = _f in ("count", "nunique")
    add(
        f"groupby_{_f}",
        lambda t, f=_f, w=_whole: A.groupby(holed(t), "event_type", "event_id").agg(f, ["v"]).select("event_type", F.col("v") if w else r6("v").alias("v")),
        f"SELECT event_type, {_s if _whole else f'round({_s}, 6)'} AS v FROM {HOLED} GROUP BY 1",
    )
add("groupby_size", lambda t: A.groupby(t.events, "event_type").size(), "SELECT event_type, count(*) AS size FROM events GROUP BY 1")
add(
    "groupby_multi_key",
    lambda t: A.groupby(t.lineitem, ["l_returnflag", "l_linestatus"]).agg({"l_quantity": "sum", "l_discount": "mean"}).select("l_returnflag", "l_linestatus", F.round(money("l_quantity"), 4).alias("q"), F.round(money("l_discount"), 4).alias("d")),
    "SELECT l_returnflag, l_linestatus, round(CAST(sum(l_quantity) AS DOUBLE), 4) AS q, round(CAST(avg(l_discount) AS DOUBLE), 4) AS d FROM "
    "lineitem GROUP BY ALL",
)
add(
    "groupby_agg_list",
    lambda t: A.groupby(t.events, "event_type").agg(["min", "max"], ["value"]),
    "SELECT event_type, min(value) AS value_min, max(value) AS value_max FROM events GROUP BY 1",
)
add(
    "groupby_agg_dict",
    lambda t: A.groupby(t.events, "event_type").agg({"value": "max", "user_id": "min"}),
    "SELECT event_type, max(value) AS value, min(user_id) AS user_id FROM events GROUP BY 1",
)
add(
    "groupby_udaf",
    lambda t: t.events.groupBy("event_type").agg(r6(U.group_apply(t.events, ["event_type"], lambda s: float(s.max() - s.min()), "double")("value")).alias("range")),
    "SELECT event_type, round(max(value) - min(value), 6) AS range FROM events GROUP BY 1",
)

# Windows

for _f, _s in {"mean": "avg", "sum": "sum", "min": "min", "max": "max", "std": "stddev_samp", "var": "var_samp", "median": "median"}.items():
    add(
        f"rolling_{_f}",
        lambda t, f=_f: holed(t).select("event_id", r6(V.rolling("v", f, 5, V.W("event_id", "user_id"), 3)).alias("r")),
        f"SELECT event_id, CASE WHEN count(v) OVER w >= 3 THEN round({_s}(v) OVER w, 6) END AS r FROM {HOLED} WINDOW w AS (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN 4 PRECEDING AND CURRENT ROW)",
    )
    _expanding = (lambda t: V.expanding_median(holed(t), "v", "event_id", "r", "user_id")) if _f == "median" else (lambda t, f=_f: holed(t).withColumn("r", V.expanding("v", f, V.W("event_id", "user_id"))))
    add(
        f"expanding_{_f}",
        lambda t, e=_expanding: e(t).select("event_id", r6("r").alias("r")),
        f"SELECT event_id, round({_s}(v) OVER w, 6) AS r FROM {HOLED} WINDOW w AS (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)",
    )
add(
    "rolling_count",
    lambda t: holed(t).select("event_id", V.rolling("v", "count", 4, V.W("event_id", "user_id")).alias("r")),
    f"SELECT event_id, count(v) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN 3 PRECEDING AND CURRENT ROW) AS r FROM {HOLED}",
)
add(
    "rolling_center",
    lambda t: t.events.select("event_id", r6(V.rolling("value", "mean", 5, V.W("event_id", "user_id"), 1, center=True)).alias("r")),
    "SELECT event_id, round(avg(value) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING), 6) AS r FROM "
    "events",
)
add(
    "rolling_global",
    lambda t: O.by_block(t.events.select("event_id", "value"), "event_id", 4, lambda w: {"r": V.rolling("value", "mean", 5, w, 5)}, rows=1000).select("event_id", r6("r").alias("r")),
    "SELECT event_id, CASE WHEN count(*) OVER w >= 5 THEN round(avg(value) OVER w, 6) END AS r FROM events WINDOW w AS (ORDER BY event_id ROWS "
    "BETWEEN 4 PRECEDING AND CURRENT ROW)",
)
add(
    "expanding_count",
    lambda t: holed(t).select("event_id", V.expanding("v", "count", V.W("event_id", "user_id")).alias("r")),
    f"SELECT event_id, count(v) OVER (PARTITION BY user_id ORDER BY event_id) AS r FROM {HOLED}",
)
add(
    "rolling_apply",
    lambda t: V.rolling_apply(t.events.select("event_id", "value"), "value", lambda s: float(s.max() - s.min()), 4, "event_id", "r").select("event_id", r6("r").alias("r")),
    "SELECT event_id, CASE WHEN count(*) OVER w >= 4 THEN round(max(value) OVER w - min(value) OVER w, 6) END AS r FROM events WINDOW w AS "
    "(ORDER BY event_id ROWS BETWEEN 3 PRECEDING AND CURRENT ROW)",
)
add(
    "cumsum_blocks",
    lambda t: O.cumulative(t.events.select("event_id", "user_id"), "event_id", "user_id", "r", rows=1000).select("event_id", F.col("r").cast("long").alias("r")),
    "SELECT event_id, CAST(sum(user_id) OVER (ORDER BY event_id) AS BIGINT) AS r FROM events",
)
add(
    "cumsum_global",
    lambda t: O.cumulative(t.events.select("event_id", "user_id"), "event_id", "user_id", "r").select("event_id", F.col("r").cast("long").alias("r")),
    "SELECT event_id, CAST(sum(user_id) OVER (ORDER BY event_id) AS BIGINT) AS r FROM events",
)
add("ewm_mean", lambda t: V.ewm(holed(t), "v", "event_id", "e", span=5, partition_by=["user_id"]).select("event_id", F.round("e", 5).alias("e")), f"""WITH RECURSIVE h AS (SELECT event_id, user_id, v, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS p FROM {HOLED}),
s AS (SELECT event_id, user_id, p, coalesce(v, 0.0) AS n, CASE WHEN v IS NULL THEN 0.0 ELSE 1.0 END::DOUBLE AS d FROM h WHERE p = 1
UNION ALL SELECT h.event_id, h.user_id, h.p, CASE WHEN v IS NULL THEN n ELSE n * (2.0::DOUBLE / 3) + v END, CASE WHEN v IS NULL THEN d ELSE d * (2.0::DOUBLE / 3) + 1 END FROM s JOIN h ON h.user_id = s.user_id AND h.p = s.p + 1)
SELECT event_id, round(CASE WHEN d > 0 THEN n / d END, 5) AS e FROM s""")
add("ewm_global", lambda t: V.ewm(holed(t), "v", "event_id", "e", alpha=0.5, adjust=False, rows=1000).select("event_id", F.round("e", 5).alias("e")), f"""WITH h AS (SELECT event_id, row_number() OVER (ORDER BY event_id) AS p, v FROM {HOLED}), g AS (SELECT event_id, p, v, row_number() OVER (ORDER BY p) AS q FROM h WHERE v IS NOT NULL),
e AS (SELECT a.event_id, a.p, sum(b.v * CASE WHEN b.q = 1 THEN 1.0::DOUBLE ELSE 0.5 END * pow(0.5::DOUBLE, a.q - b.q)) AS e FROM g a JOIN g b ON b.q BETWEEN a.q - 80 AND a.q GROUP BY a.event_id, a.p)
SELECT h.event_id, round(last_value(e.e IGNORE NULLS) OVER (ORDER BY h.p), 5) AS e FROM h LEFT JOIN e ON h.event_id = e.event_id""")
add(
    "shift_diff",
    lambda t: t.events.select("event_id", V.shift("value", V.W("event_id", "user_id"), 2).alias("s"), r6(V.diff("value", V.W("event_id", "user_id"), -1)).alias("d")),
    "SELECT event_id, lag(value, 2) OVER w AS s, round(value - lead(value) OVER w, 6) AS d FROM events WINDOW w AS (PARTITION BY user_id ORDER "
    "BY event_id)",
)
add(
    "pct_change",
    lambda t: t.events.select("event_id", r6(V.pct_change("value", V.W("event_id", "user_id"))).alias("p")),
    "SELECT event_id, round(CASE WHEN lag(value) OVER w <> 0 THEN (value - lag(value) OVER w) / lag(value) OVER w END, 6) AS p FROM events "
    "WINDOW w AS (PARTITION BY user_id ORDER BY event_id)",
)
add(
    "cumulatives",
    lambda t: holed(t).select("event_id", r6(V.cumsum("v", V.W("event_id", "user_id"))).alias("s"), V.cummax("v", V.W("event_id", "user_id")).alias("hi"), V.cummin("v", V.W("event_id", "user_id")).alias("lo")),
    f"SELECT event_id, CASE WHEN v IS NOT NULL THEN round(sum(v) OVER w, 6) END AS s, max(v) OVER w AS hi, min(v) OVER w AS lo FROM {HOLED} WINDOW w AS (PARTITION BY user_id ORDER BY event_id)",
)
add(
    "cumprod",
    lambda t: t.events.withColumn("x", F.lit(1) + F.col("user_id") % 2 * 0.01).select("event_id", F.round(V.cumprod("x", V.W("event_id", "user_id")), 5).alias("p")),
    "SELECT event_id, round(product(1 + user_id % 2 * 0.01::DOUBLE) OVER (PARTITION BY user_id ORDER BY event_id), 5) AS p FROM events",
)
for _f, _s in {"min": "rank() OVER w", "dense": "dense_rank() OVER w", "average": "rank() OVER w + (count(*) OVER (PARTITION BY p_size) - 1) / 2.0::DOUBLE", "max": "rank() OVER w + count(*) OVER (PARTITION BY p_size) - 1", "first": "row_number() OVER (ORDER BY p_size, p_partkey)"}.items():
    add(
        f"rank_{_f}",
        lambda t, f=_f: V.ranked(t.part, "p_size", "r", f, tie="p_partkey", rows=500).select("p_partkey", "r"),
        f"SELECT p_partkey, {_s} AS r FROM part WINDOW w AS (ORDER BY p_size)",
    )
add(
    "rank_groups",
    lambda t: t.part.select("p_partkey", V.rank("p_retailprice", "min", False, ["p_brand"]).alias("r")),
    "SELECT p_partkey, rank() OVER (PARTITION BY p_brand ORDER BY p_retailprice DESC) AS r FROM part",
)
add(
    "duplicated",
    lambda t: R.duplicated(t.orders, "o_orderkey", ["o_custkey"], "last").select("o_orderkey", "duplicated"),
    "SELECT o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey DESC) > 1 AS duplicated FROM orders",
)

# Sort, sets

add(
    "sort_multi",
    lambda t: R.sorted_rows(t.part, ["p_size", "p_partkey"], [False, True]).select("p_partkey", "row"),
    "SELECT p_partkey, row_number() OVER (ORDER BY p_size DESC, p_partkey) - 1 AS row FROM part",
)
add(
    "sort_nulls",
    lambda t: R.sorted_rows(holed(t), ["v", "event_id"], [False, True], rows=1000).select("event_id", "row"),
    f"SELECT event_id, row_number() OVER (ORDER BY v DESC NULLS FIRST, event_id) - 1 AS row FROM {HOLED}",
)
add(
    "sort_text",
    lambda t: R.sorted_rows(t.customer, ["c_mktsegment", "c_name"], [True, False], rows=100).select("c_custkey", "row"),
    "SELECT c_custkey, row_number() OVER (ORDER BY c_mktsegment, c_name DESC) - 1 AS row FROM customer",
)
add(
    "sort_values",
    lambda t: R.sort_values(t.orders, ["o_orderdate", "o_orderkey"]).select("o_orderkey", "o_orderdate"),
    "SELECT o_orderkey, o_orderdate FROM orders",
)
add(
    "nlargest",
    lambda t: R.nlargest(t.events, 10, "value", "event_id").select("event_id"),
    "SELECT event_id FROM events ORDER BY value DESC, event_id LIMIT 10",
)
add(
    "nsmallest",
    lambda t: R.nsmallest(t.events, 10, "value", "event_id").select("event_id"),
    "SELECT event_id FROM events ORDER BY value, event_id LIMIT 10",
)
for _k, _s in {"first": "row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) = 1", "last": "row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey DESC) = 1", "none": "count(*) OVER (PARTITION BY o_custkey) = 1"}.items():
    add(
        f"drop_duplicates_{_k}",
        lambda t, k=_k: R.drop_duplicates(t.orders, "o_orderkey", ["o_custkey"], False if k == "none" else k).select("o_orderkey"),
        f"SELECT o_orderkey FROM (SELECT o_orderkey, {_s} AS x FROM orders) WHERE x",
    )
add(
    "concat_rows",
    lambda t: R.concat_rows(t.nation.select("n_name"), t.nation.select("n_name", "n_regionkey")),
    "SELECT n_name, NULL::INTEGER AS n_regionkey FROM nation UNION ALL SELECT n_name, n_regionkey FROM nation",
)
add(
    "concat_columns",
    lambda t: R.concat_columns((t.region.select("r_regionkey", "r_name"), "r_regionkey"), (t.nation.select("n_nationkey", "n_name"), "n_nationkey")),
    "SELECT r_regionkey, r_name, n_nationkey, n_name FROM (SELECT *, row_number() OVER (ORDER BY r_regionkey) AS x FROM region) a FULL JOIN "
    "(SELECT n_nationkey, n_name, row_number() OVER (ORDER BY n_nationkey) AS x FROM nation) b USING (x)",
)
for _k, _s in {"union": "UNION", "intersect": "INTERSECT", "except": "EXCEPT"}.items():
    add(
        f"set_{_k}",
        lambda t, k=_k: R.set_operation(t.customer.select(F.col("c_nationkey").alias("n")), t.nation.filter("n_nationkey < 10").select(F.col("n_nationkey").alias("n")), k),
        f"SELECT c_nationkey AS n FROM customer {_s} SELECT n_nationkey FROM nation WHERE n_nationkey < 10",
    )

# Reshape

add(
    "get_dummies",
    lambda t: P.get_dummies(t.region.select("r_regionkey", "r_name"), ["r_name"], "r").select("r_regionkey", "r_ASIA", "r_EUROPE"),
    "SELECT r_regionkey, CAST(r_name = 'ASIA' AS DOUBLE) AS r_ASIA, CAST(r_name = 'EUROPE' AS DOUBLE) AS r_EUROPE FROM region",
)
add(
    "melt",
    lambda t: P.melt(t.nation.select("n_name", "n_nationkey", "n_regionkey"), ["n_name"]),
    "SELECT n_name, 'n_nationkey' AS variable, n_nationkey AS value FROM nation UNION ALL SELECT n_name, 'n_regionkey', n_regionkey FROM nation",
)
_KINDS = ("click", "error", "purchase", "signup", "view")
add(
    "pivot_table",
    lambda t: P.pivot_table(t.events, "value", "user_id", "event_type", "max").select("user_id", *_KINDS),
    "SELECT user_id, " + ", ".join(f"max(value) FILTER (WHERE event_type = '{k}') AS {k}" for k in _KINDS) + " FROM events GROUP BY 1",
)
add(
    "crosstab",
    lambda t: P.crosstab(t.lineitem, "l_returnflag", "l_linestatus").select("l_returnflag", "F", "O"),
    "SELECT l_returnflag, count(*) FILTER (WHERE l_linestatus = 'F') AS F, count(*) FILTER (WHERE l_linestatus = 'O') AS O FROM lineitem GROUP "
    "BY 1",
)
add(
    "cut",
    lambda t: t.events.select("event_id", P.cut("value", [0, 2, 5, 10]).alias("bin")),
    "SELECT event_id, CASE WHEN value >= 0 AND value < 2 THEN '(0, 2]' WHEN value >= 2 AND value < 5 THEN '(2, 5]' WHEN value >= 5 AND value < "
    "10 THEN '(5, 10]' END AS bin FROM events",
)
add(
    "qcut",
    lambda t: P.qcut(t.events, "value", 4, "bin", ["a", "b", "c", "d"]).groupBy("bin").agg(F.count("*").alias("n")),
    "WITH q AS (SELECT quantile_cont(value, 0.25) AS a, quantile_cont(value, 0.5) AS b, quantile_cont(value, 0.75) AS c FROM events) SELECT CASE "
    "WHEN value < a THEN 'a' WHEN value < b THEN 'b' WHEN value < c THEN 'c' ELSE 'd' END AS bin, count(*) AS n FROM events, q GROUP BY 1",
)
add(
    "explode",
    lambda t: P.explode(t.part.select("p_partkey", S.split("p_name").alias("w")), "w"),
    "SELECT p_partkey, unnest(list_filter(string_split_regex(p_name, '\\s+'), lambda x: x <> '')) AS w FROM part",
)

# Text and time

_texts = {
    "lower": (lambda: S.lower("p_name"), "lower(p_name)"),
    "upper": (lambda: S.upper("p_name"), "upper(p_name)"),
    "strip": (lambda: S.strip(F.concat(F.lit(" \t"), "p_name", F.lit("\n"))), "p_name"),
    "lstrip": (lambda: S.lstrip(F.concat(F.lit(" \t"), "p_name", F.lit("\n"))), "p_name || chr(10)"),
    "rstrip": (lambda: S.rstrip(F.concat(F.lit(" \t"), "p_name", F.lit("\n"))), "' ' || chr(9) || p_name"),
    "len": (lambda: S.length("p_name"), "CAST(length(p_name) AS INTEGER)"),
    "contains": (lambda: S.contains("p_name", "a.b|e"), "regexp_matches(p_name, 'a.b|e')"),
    "startswith": (lambda: S.startswith("p_type", "STANDARD"), "starts_with(p_type, 'STANDARD')"),
    "endswith": (lambda: S.endswith("p_type", "TIN"), "ends_with(p_type, 'TIN')"),
    "replace": (lambda: S.replace("p_name", "e", "EE"), "replace(p_name, 'e', 'EE')"),
    "replace_regex": (lambda: S.replace("p_name", "([aeiou])", r"<\1>", regex=True), "regexp_replace(p_name, '([aeiou])', '<\\1>', 'g')"),
    "get": (lambda: S.get("p_name", 2), "CASE WHEN length(p_name) > 2 THEN p_name[3] END"),
    "slice": (lambda: S.slice_("p_name", 1, -2), "substr(p_name, 2, greatest(length(p_name) - 3, 0))"),
    "isnumeric": (lambda: S.isnumeric(F.col("p_size").cast("string")), "regexp_matches(CAST(p_size AS VARCHAR), '^[0-9]+$')"),
    "isalpha": (lambda: S.isalpha("p_brand"), "regexp_matches(p_brand, '^[A-Za-z]+$')"),
    "zfill": (lambda: S.zfill(F.col("p_size").cast("string"), 5), "lpad(CAST(p_size AS VARCHAR), 5, '0')"),
    "pad": (lambda: S.pad("p_brand", 12, "right", "*"), "rpad(p_brand, 12, '*')"),
    "extract": (lambda: S.extract("p_brand", r"(\d+)"), "CASE WHEN regexp_matches(p_brand, '\\d+') THEN regexp_extract(p_brand, '(\\d+)', 1) END"),
    "count": (lambda: S.count("p_name", "e"), "CAST(length(p_name) - length(replace(p_name, 'e', '')) AS INTEGER)"),
    "findall": (lambda: F.array_join(S.findall("p_name", "[aeiou]+"), "|"), "array_to_string(regexp_extract_all(p_name, '[aeiou]+'), '|')"),
    "split": (lambda: F.array_join(S.split("p_name", " "), "|"), "array_to_string(string_split(p_name, ' '), '|')"),
}
for _k, (_m, _s) in _texts.items():
    add(f"str_{_k}", lambda t, m=_m: t.part.select("p_partkey", m().alias("x")), f"SELECT p_partkey, {_s} AS x FROM part")
add("str_cat", lambda t: S.cat(t.nation, "n_name", "n_nationkey", ","), "SELECT string_agg(n_name, ',' ORDER BY n_nationkey) AS value FROM nation")
_times = {
    "year": (lambda: D.year("ts"), "CAST(year(ts) AS INTEGER)"), "month": (lambda: D.month("ts"), "CAST(month(ts) AS INTEGER)"), "day": (lambda: D.day("ts"), "CAST(day(ts) AS INTEGER)"), "hour": (lambda: D.hour("ts"), "CAST(hour(ts) AS INTEGER)"),
    "minute": (lambda: D.minute("ts"), "CAST(minute(ts) AS INTEGER)"), "second": (lambda: D.second("ts"), "CAST(second(ts) AS INTEGER)"), "dayofweek": (lambda: D.dayofweek("ts"), "CAST(isodow(ts) - 1 AS INTEGER)"), "dayofyear": (lambda: D.dayofyear("ts"), "CAST(dayofyear(ts) AS INTEGER)"),
    "quarter": (lambda: D.quarter("ts"), "CAST(quarter(ts) AS INTEGER)"), "date": (lambda: D.date("ts").cast("string"), "CAST(CAST(ts AS DATE) AS VARCHAR)"), "time": (lambda: D.time("ts"), "strftime(ts, '%H:%M:%S.%f')"), "strftime": (lambda: D.strftime("ts", "%Y/%m/%d at %H"), "strftime(ts, '%Y/%m/%d at %H')"),
    "floor": (lambda: D.floor("ts", "15min").cast("string"), "CAST(time_bucket(INTERVAL 15 MINUTE, ts) AS VARCHAR)"), "ceil": (lambda: D.ceil("ts", "D").cast("string"), "CAST(CASE WHEN date_trunc('day', ts) = ts THEN ts ELSE date_trunc('day', ts) + INTERVAL 1 DAY END AS VARCHAR)"),
    "to_datetime": (lambda: D.to_datetime(F.date_format("ts", "yyyy-MM-dd HH:mm"), "%Y-%m-%d %H:%M").cast("string"), "strftime(date_trunc('minute', ts), '%Y-%m-%d %H:%M:%S')"),
}
for _k, (_m, _s) in _times.items():
    add(f"dt_{_k}", lambda t, m=_m: t.events.select("event_id", m().alias("x")), f"SELECT event_id, {_s} AS x FROM events")
add(
    "date_range",
    lambda t: D.date_range(t.spark, "2024-01-01", periods=10, freq="D").select(F.col("date").cast("string").alias("d")),
    "SELECT strftime(x, '%Y-%m-%d %H:%M:%S') AS d FROM (SELECT unnest(generate_series(TIMESTAMP '2024-01-01', TIMESTAMP '2024-01-10', INTERVAL 1 "
    "DAY)) AS x)",
)
add(
    "date_range_month_ends",
    lambda t: D.date_range(t.spark, "2024-01-15", periods=3, freq="ME").select(F.col("date").cast("string").alias("d")),
    "SELECT * FROM (VALUES ('2024-01-31 00:00:00'), ('2024-02-29 00:00:00'), ('2024-03-31 00:00:00')) v(d)",
)

# SQL

add(
    "sql_group_order",
    lambda t: B.sql(t.events, "SELECT event_type, AVG(value) AS m FROM df GROUP BY event_type ORDER BY m").select("event_type", r6("m").alias("m")),
    "SELECT event_type, round(avg(value), 6) AS m FROM events GROUP BY 1",
)
add(
    "sql_join_filter",
    lambda t: B.sql_query("SELECT n_name, r_name FROM n JOIN r ON n_regionkey = r_regionkey WHERE r_name <> 'ASIA'", {"n": t.nation, "r": t.region}),
    "SELECT n_name, r_name FROM nation JOIN region ON n_regionkey = r_regionkey WHERE r_name <> 'ASIA'",
)
add(
    "sql_recursive_cte",
    lambda t: B.sql_query("WITH RECURSIVE f(n, a, b) AS (SELECT 1, 0L, 1L UNION ALL SELECT n + 1, b, a + b FROM f WHERE n < 20) SELECT n, a FROM f", {"r": t.region}),
    "WITH RECURSIVE f(n, a, b) AS (SELECT 1, 0::BIGINT, 1::BIGINT UNION ALL SELECT n + 1, b, a + b FROM f WHERE n < 20) SELECT n, a FROM f",
)
add(
    "sql_window",
    lambda t: B.sql_query("SELECT c_custkey, rank() OVER (PARTITION BY c_nationkey ORDER BY c_custkey) AS r FROM c", {"c": t.customer}).withColumn("r", F.col("r").cast("long")),
    "SELECT c_custkey, rank() OVER (PARTITION BY c_nationkey ORDER BY c_custkey) AS r FROM customer",
)
add(
    "sql_correlated",
    lambda t: B.sql_query("SELECT n_name FROM n WHERE EXISTS (SELECT 1 FROM c WHERE c_nationkey = n_nationkey AND c_custkey < 20)", {"n": t.nation, "c": t.customer}),
    "SELECT n_name FROM nation WHERE EXISTS (SELECT 1 FROM customer WHERE c_nationkey = n_nationkey AND c_custkey < 20)",
)

# Statistics and preparation

add(
    "zscore",
    lambda t: T.zscore(t.events, "value").select("event_id", r6("zscore").alias("z")),
    "SELECT event_id, round((value - (SELECT avg(value) FROM events)) / (SELECT stddev_pop(value) FROM events), 6) AS z FROM events",
)
add(
    "outliers_iqr",
    lambda t: T.detect_outliers(t.events, "value").filter("outlier").select("event_id"),
    "WITH q AS (SELECT quantile_cont(value, 0.25) AS a, quantile_cont(value, 0.75) AS b FROM events) SELECT event_id FROM events, q WHERE value "
    "< a - 1.5 * (b - a) OR value > b + 1.5 * (b - a)",
)
add(
    "outliers_z",
    lambda t: T.detect_outliers(t.events, "value", "zscore", 2.0).filter("outlier").select("event_id"),
    "SELECT event_id FROM events WHERE abs(value - (SELECT avg(value) FROM events)) / (SELECT stddev_pop(value) FROM events) > 2",
)
add(
    "histogram",
    lambda t: T.value_distribution(t.events, "value", 8).select("bin", "count"),
    "WITH m AS (SELECT min(value) AS a, max(value) AS b FROM events), c AS (SELECT least(floor((value - a) / ((b - a) / 8)), 7) AS bin, count(*) "
    "AS n FROM events, m GROUP BY 1) SELECT CAST(i AS INTEGER) AS bin, coalesce(n, 0) AS count FROM range(8) r(i) LEFT JOIN c ON c.bin = i",
)
add(
    "corr_matrix",
    lambda t: T.corr(t.events.select("value", "user_id"), ["value", "user_id"]).select("column", r6("value").alias("value"), r6("user_id").alias("user_id")),
    "SELECT 'value' AS \"column\", 1.0::DOUBLE AS value, round(corr(value, user_id), 6) AS user_id FROM events UNION ALL SELECT 'user_id', round(corr(value, user_id), 6), 1.0 FROM events",
)
add(
    "cov_matrix",
    lambda t: T.cov(t.events.select("value", "user_id"), ["value", "user_id"]).select("column", F.round("value", 4).alias("value"), F.round("user_id", 4).alias("user_id")),
    "SELECT 'value' AS \"column\", round(covar_samp(value, value), 4) AS value, round(covar_samp(value, user_id), 4) AS user_id FROM events UNION ALL SELECT 'user_id', round(covar_samp(value, user_id), 4), round(covar_samp(user_id, user_id), 4) FROM events",
)
add(
    "spearman",
    lambda t: T.corr(t.part.select(F.col("p_size").alias("a"), F.col("p_partkey").alias("b")), ["a", "b"], "spearman").filter("column = 'a'").select(F.round("b", 5).alias("r")),
    "WITH r AS (SELECT rank() OVER (ORDER BY p_size) + (count(*) OVER (PARTITION BY p_size) - 1) / 2.0 AS a, rank() OVER (ORDER BY p_partkey) AS "
    "b FROM part) SELECT round(corr(a, b), 5) AS r FROM r",
)
add(
    "kendall",
    lambda t: t.spark.createDataFrame([(round(T.kendall(t.customer, "c_acctbal", "c_nationkey", rows=400), 6),)], "tau double"),
    "WITH c AS (SELECT c_acctbal AS x, c_nationkey AS y FROM customer), p AS (SELECT sum(sign(b.y - a.y)) AS s FROM c a JOIN c b ON a.x < b.x), "
    "n AS (SELECT count(*) * (count(*) - 1) / 2.0 AS t FROM c), u AS (SELECT sum(k * (k - 1) / 2.0) AS u FROM (SELECT count(*) AS k FROM c GROUP "
    "BY y)), v AS (SELECT sum(k * (k - 1) / 2.0) AS v FROM (SELECT count(*) AS k FROM c GROUP BY x)) SELECT round(s / sqrt((t - v) * (t - u)), "
    "6) AS tau FROM p, n, u, v",
)
for _k, _s in {"mean": "avg(v)", "median": "median(v)", "most_frequent": "(SELECT v FROM {0} WHERE v IS NOT NULL GROUP BY v ORDER BY count(*) DESC, v LIMIT 1)", "constant": "7.5"}.items():
    _s = f"any_value({_s.format(HOLED)})" if _k == "most_frequent" else _s
    add(
        f"impute_{_k}",
        lambda t, k=_k: T.SimpleImputer(k, 7.5, ["v"]).fit_transform(holed(t)).select("event_id", r6("v").alias("v")),
        f"SELECT event_id, round(coalesce(v, (SELECT {_s} FROM {HOLED})), 6) AS v FROM {HOLED}" if _k != "constant" else f"SELECT event_id, round(coalesce(v, 7.5), 6) AS v FROM {HOLED}",
    )
add("scale_standard", lambda t: T.StandardScaler(["value"]).fit_transform(t.events).select("event_id", r6("value").alias("z")), ORACLES["zscore"])
add(
    "scale_minmax",
    lambda t: T.MinMaxScaler((0.0, 1.0), ["value"]).fit_transform(t.events).select("event_id", r6("value").alias("z")),
    "SELECT event_id, round((value - (SELECT min(value) FROM events)) / (SELECT max(value) - min(value) FROM events), 6) AS z FROM events",
)
add(
    "scale_robust",
    lambda t: T.RobustScaler(["value"]).fit_transform(t.events).select("event_id", r6("value").alias("z")),
    "WITH q AS (SELECT quantile_cont(value, 0.25) AS a, median(value) AS m, quantile_cont(value, 0.75) AS b FROM events) SELECT event_id, "
    "round((value - m) / (b - a), 6) AS z FROM events, q",
)
add(
    "label_encode",
    lambda t: T.LabelEncoder().fit(t.events, "event_type").transform(t.events).select("event_id", "code"),
    "SELECT event_id, dense_rank() OVER (ORDER BY event_type) - 1 AS code FROM events",
)
add(
    "one_hot",
    lambda t: T.OneHotEncoder(["r_name"]).fit(t.region).transform(t.region.select("r_regionkey", "r_name")).select("r_regionkey", "r_name_ASIA"),
    "SELECT r_regionkey, CAST(r_name = 'ASIA' AS DOUBLE) AS r_name_ASIA FROM region",
)
add(
    "split_ordered",
    lambda t: T.train_test_split(t.orders, "o_orderkey", 0.2)[1].select("o_orderkey"),
    "SELECT o_orderkey FROM (SELECT o_orderkey, row_number() OVER (ORDER BY o_orderkey) - 1 AS r, count(*) OVER () AS n FROM orders) WHERE r >= "
    "CAST(floor(n * 0.8) AS BIGINT)",
)
add(
    "kfold",
    lambda t: T.kfold(t.orders, "o_orderkey", 7).groupBy("fold").agg(F.count("*").alias("n")),
    "SELECT CAST(least((row_number - 1) // (n // 7), 6) AS INTEGER) AS fold, count(*) AS n FROM (SELECT row_number() OVER (ORDER BY o_orderkey) "
    "AS row_number, count(*) OVER () AS n FROM orders) GROUP BY 1",
)
add(
    "split_seeded",
    lambda t: t.spark.createDataFrame([tuple(x.count() for x in T.train_test_split(t.orders, "o_orderkey", 0.2, seed=5))], "train long, test long"),
    "SELECT CAST(floor(count(*) * 0.8) AS BIGINT) AS train, count(*) - CAST(floor(count(*) * 0.8) AS BIGINT) AS test FROM orders",
)
add("kfold_seeded", lambda t: T.kfold(t.orders, "o_orderkey", 7, seed=5).groupBy("fold").agg(F.count("*").alias("n")), ORACLES["kfold"])
add(
    "prep_pipeline",
    lambda t: T.make_pipeline(("impute", T.SimpleImputer("mean", columns=["v"])), ("scale", T.MinMaxScaler(columns=["v"]))).fit(holed(t)).transform(holed(t)).select("event_id", r6("v").alias("v")),
    f"WITH m AS (SELECT avg(v) AS m FROM {HOLED}), i AS (SELECT event_id, coalesce(v, m) AS v FROM {HOLED}, m) SELECT event_id, round((v - (SELECT min(v) FROM i)) / (SELECT max(v) - min(v) FROM i), 6) AS v FROM i",
)
add(
    "metrics_regression",
    lambda t: T.regression_scores(t.events.withColumn("p", F.col("value") * 0.9), "value", "p").select(*(r6(c).alias(c) for c in ("mse", "mae", "r2"))),
    "WITH e AS (SELECT value AS t, value * 0.9 AS p FROM events) SELECT round(avg((t - p) ** 2), 6) AS mse, round(avg(abs(t - p)), 6) AS mae, "
    "round(1 - sum((t - p) ** 2) / sum((t - (SELECT avg(t) FROM e)) ** 2), 6) AS r2 FROM e",
)
add(
    "metrics_classification",
    lambda t: T.classification_scores(t.labels, "quality", "toxic").select(*(r6(c).alias(c) for c in ("accuracy", "precision", "recall", "f1"))),
    "WITH c AS (SELECT count(*) FILTER (WHERE quality = 1 AND toxic = 1) AS h, count(*) FILTER (WHERE toxic = 1) AS s, count(*) FILTER (WHERE "
    "quality = 1) AS i, avg(CASE WHEN quality = toxic THEN 1.0 ELSE 0.0 END) AS a FROM labels) SELECT round(a, 6) AS accuracy, round(coalesce(h "
    "/ nullif(s, 0), 0), 6) AS precision, round(coalesce(h / nullif(i, 0), 0), 6) AS recall, round(coalesce(2 * h / nullif(s + i, 0), 0), 6) AS "
    "f1 FROM c",
)
add(
    "summary_stats",
    lambda t: T.summary_stats(t.events, ["value"]).select("count", "missing_pct", r6("skew").alias("skew"), r6("kurt").alias("kurt")),
    "SELECT count(value) AS count, 0.0::DOUBLE AS missing_pct, round(skewness(value), 6) AS skew, round(kurtosis(value), 6) AS kurt FROM events",
)

# Functions of the user, reading pages, lazy steps, time windows

add(
    "scalar_udf",
    lambda t: t.nation.select("n_nationkey", U.scalar(lambda x: x * 2 + 1, "long")(F.col("n_nationkey").cast("long")).alias("y")),
    "SELECT n_nationkey, n_nationkey::BIGINT * 2 + 1 AS y FROM nation",
)
add(
    "row_udf",
    lambda t: U.apply_rows(t.nation.select("n_nationkey", "n_regionkey"), lambda r: r["n_nationkey"] + r["n_regionkey"], "s", "long").select("n_nationkey", "s"),
    "SELECT n_nationkey, CAST(n_nationkey + n_regionkey AS BIGINT) AS s FROM nation",
)
add(
    "map_in_pandas",
    lambda t: U.map_batches(t.events.select("event_id", "value"), lambda f: f[f["value"] > 5][["event_id"]], "event_id long"),
    "SELECT event_id FROM events WHERE value > 5",
)
add(
    "column_udaf",
    lambda t: U.apply_columns(t.events, lambda s: float(s.max() - s.min()), ["value", "user_id"]).select(r6("value").alias("value"), r6("user_id").alias("user_id")),
    "SELECT round(max(value) - min(value), 6) AS value, CAST(max(user_id) - min(user_id) AS DOUBLE) AS user_id FROM events",
)


def _again(t: Tables, df: DataFrame, write: Callable, read: Callable) -> DataFrame:
    """A table written and read again."""
    path = I.scratch(t.spark, "files")
    write(df, path)
    return read(t.spark, path)


_FLAT = "SELECT event_id, event_type, value FROM events"
_flat = lambda t: t.events.select("event_id", "event_type", "value")
_KINDS_OF = "event_id long, event_type string, value double"
add("csv_again", lambda t: _again(t, _flat(t), I.to_csv, lambda s, p: I.read_csv(s, p, _KINDS_OF)), _FLAT)
add(
    "csv_chunked",
    lambda t: _again(t, _flat(t), I.to_csv, lambda s, p: L.read_csv_chunked(s, p, schema=_KINDS_OF).filter("value > 5").collect()),
    _FLAT + " WHERE value > 5",
)
add(
    "pandas_again",
    lambda t: I.from_pandas(t.spark, I.to_pandas(t.nation)).select("n_name", F.col("n_nationkey").cast("int").alias("n_nationkey")),
    "SELECT n_name, n_nationkey FROM nation",
)
add("dict_again", lambda t: t.spark.createDataFrame(I.to_dict(t.region, "records"), "r_regionkey int, r_name string"), "SELECT * FROM region")
add(
    "json_text_again",
    lambda t: I.read_json(t.spark, I.to_json(t.region)).select("r_name", F.col("r_regionkey").cast("int").alias("r_regionkey")),
    "SELECT r_name, r_regionkey FROM region",
)
add("json_again", lambda t: _again(t, _flat(t), I.to_json, lambda s, p: I.read_json(s, p, True, _KINDS_OF)), _FLAT)
add("orc_again", lambda t: _again(t, _flat(t), I.to_orc, I.read_orc), _FLAT)
add("parquet_again", lambda t: _again(t, _flat(t), lambda d, p: I.to_parquet(d, p, partition_by=["event_type"]), I.read_parquet), _FLAT)
add(
    "lazy_totals",
    lambda t: t.spark.createDataFrame([(round(x.sum("value"), 4), round(x.mean("value"), 6), x.count()) for x in [L.LazyFrame.from_frames(_flat(t), _flat(t))]], "s double, m double, n long"),
    "SELECT round(2 * sum(value), 4) AS s, round(avg(value), 6) AS m, 2 * count(*) AS n FROM events",
)
add(
    "html_tables",
    lambda t: I.tables_of_pages(t.nation.select("n_nationkey", F.concat(F.lit("<p>x</p><table><tr><th>k</th><th>name</th></tr><tr><td>"), F.col("n_nationkey").cast("string"), F.lit("</td><td> "), "n_name", F.lit("</td></tr></table>")).alias("html")), "n_nationkey", "html").select("n_nationkey", "table", "row", F.array_join("cells", "|").alias("cells")),
    "SELECT n_nationkey, 0 AS \"table\", 0 AS row, 'k|name' AS cells FROM nation UNION ALL SELECT n_nationkey, 0, 1, n_nationkey || '|' || n_name FROM nation",
)
add("read_html", lambda t: I.tables_of_pages(t.pages, "page_id", "html"))
add(
    "sample_exact",
    lambda t: R.sample(t.orders, "o_orderkey", n=100, seed=3).agg(F.count("*").alias("n")),
    "SELECT least(count(*), 100) AS n FROM orders",
)
add(
    "lazy_chain",
    lambda t: L.LazyFrame(t.events).filter(lambda d: d["value"] > 5).select(["event_id", "value"]).map(lambda d: d.withColumn("twice", d["value"] * 2)).collect(),
    "SELECT event_id, value, value * 2 AS twice FROM events WHERE value > 5",
)
add(
    "time_windows",
    lambda t: L.windowed_counts(t.events, "ts", ["event_type"], "1 hour").select(F.col("start").cast("string").alias("start"), "event_type", "n"),
    "SELECT strftime(date_trunc('hour', ts), '%Y-%m-%d %H:%M:%S') AS start, event_type, count(*) AS n FROM events GROUP BY ALL",
)
add(
    "session_windows",
    lambda t: L.sessions(t.events, "ts", ["user_id"], "30 minutes").groupBy("user_id").agg(F.count("*").alias("sessions")),
    "SELECT user_id, count(*) AS sessions FROM (SELECT user_id, ts, lag(ts) OVER (PARTITION BY user_id ORDER BY ts) AS p FROM events) WHERE p IS "
    "NULL OR ts >= p + INTERVAL 30 MINUTE GROUP BY 1",
)
add(
    "flagship_revenue",
    lambda t: t.lineitem.join(t.orders, F.col("l_orderkey") == F.col("o_orderkey")).join(t.customer, F.col("o_custkey") == F.col("c_custkey")).join(t.nation, F.col("c_nationkey") == F.col("n_nationkey")).groupBy("n_name", F.year("o_orderdate").alias("year")).agg(F.round(F.sum(money("l_extendedprice") * (F.lit(1.0) - money("l_discount"))), 2).alias("revenue")).withColumn("place", F.rank().over(Window.partitionBy("year").orderBy(F.desc("revenue"))).cast("long")),
    "SELECT n_name, year, revenue, rank() OVER (PARTITION BY year ORDER BY revenue DESC) AS place FROM (SELECT n_name, CAST(year(o_orderdate) AS "
    "INTEGER) AS year, round(sum(CAST(l_extendedprice AS DOUBLE) * (1 - CAST(l_discount AS DOUBLE))), 2) AS revenue FROM lineitem JOIN orders ON "
    "l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey GROUP BY 1, 2)",
)
