"""Text expressions over columns, compiled from a checked syntax tree; nothing is evaluated."""

from __future__ import annotations

import ast
import operator
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from colframe.functions.math import floor_div, floor_mod, not_equal, safe_div

_BINARY: dict[type, Callable] = {
    ast.Add: operator.add, ast.Sub: operator.sub, ast.Mult: operator.mul, ast.Div: safe_div, ast.FloorDiv: floor_div, ast.Mod: floor_mod,
    ast.Pow: F.pow, ast.BitAnd: operator.and_, ast.BitOr: operator.or_,
}
_COMPARE: dict[type, Callable] = {ast.Eq: operator.eq, ast.NotEq: not_equal, ast.Lt: operator.lt, ast.LtE: operator.le, ast.Gt: operator.gt, ast.GtE: operator.ge}
_CALLS: dict[str, Callable] = {
    "abs": F.abs, "sqrt": F.sqrt, "exp": F.exp, "log": F.ln, "log10": F.log10, "floor": F.floor, "ceil": F.ceil, "sign": F.signum, "power": F.pow, "sin": F.sin, "cos": F.cos, "tan": F.tan,
    "where": lambda c, a, b: F.when(c, a).otherwise(b), "isnan": lambda c: c.isNull(), "maximum": F.greatest, "minimum": F.least, "round": F.bround,
}


class ExpressionError(ValueError):
    """The text has something other than columns, constants, operators and listed functions."""


def compiled(text: str, columns: list[str]) -> Column:
    """The column that a text like ``"a > 3 and abs(b) < c"`` describes."""

    def of(node: ast.AST) -> Column:
        if isinstance(node, ast.Constant) and (node.value is None or isinstance(node.value, (int, float, str, bool))):
            return F.lit(node.value)
        if isinstance(node, ast.Name):
            if node.id not in columns:
                raise ExpressionError(f"no column {node.id}")
            return F.col(f"`{node.id}`")
        if isinstance(node, ast.BinOp) and type(node.op) in _BINARY:
            return _BINARY[type(node.op)](of(node.left), of(node.right))
        if isinstance(node, ast.UnaryOp):
            x = of(node.operand)
            if isinstance(node.op, ast.USub):
                return -x
            if isinstance(node.op, (ast.Not, ast.Invert)):
                return ~x
            if isinstance(node.op, ast.UAdd):
                return x
        if isinstance(node, ast.BoolOp):
            parts = list(map(of, node.values))
            out = parts[0]
            for p in parts[1:]:
                out = out & p if isinstance(node.op, ast.And) else out | p
            return out
        if isinstance(node, ast.Compare):
            sides = [node.left, *node.comparators]
            out = None
            for a, op, b in zip(sides, node.ops, sides[1:]):
                if isinstance(op, (ast.In, ast.NotIn)) and isinstance(b, (ast.List, ast.Tuple)):
                    found = of(a).isin(*(e.value for e in b.elts if isinstance(e, ast.Constant)))
                    found = ~found if isinstance(op, ast.NotIn) else found
                elif type(op) in _COMPARE:
                    found = _COMPARE[type(op)](of(a), of(b))
                else:
                    raise ExpressionError(ast.unparse(node))
                out = found if out is None else out & found
            return out
        if isinstance(node, ast.Call) and not node.keywords:
            name = node.func.id if isinstance(node.func, ast.Name) else node.func.attr if isinstance(node.func, ast.Attribute) and isinstance(node.func.value, ast.Name) and node.func.value.id == "np" else ""
            if name in _CALLS:
                return _CALLS[name](*map(of, node.args))
        raise ExpressionError(f"not allowed: {ast.unparse(node)}")

    try:
        return of(ast.parse(text, mode="eval").body)
    except SyntaxError as e:
        raise ExpressionError(str(e)) from e


def query(df: DataFrame, text: str) -> DataFrame:
    """The rows where the expression is true."""
    return df.filter(compiled(text, df.columns))


def evaluate(df: DataFrame, text: str, name: str | None = None) -> DataFrame:
    """A condition filters; another expression becomes the column ``name``, beside the others or alone without a name."""
    c = compiled(text, df.columns)
    kind = df.select(c.alias("x")).schema["x"].dataType.simpleString()
    if kind == "boolean" and name is None:
        return df.filter(c)
    return df.withColumn(name, c) if name else df.select(c.alias("value"))
