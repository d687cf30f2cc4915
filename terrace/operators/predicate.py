"""Filter conditions as text, compiled to Column expressions.

A condition is `field op value`, joined by AND or OR (any case), which bind equally and from left to right. Operators are
= == != > < >= <=. Values are one word or quoted; fields may reach into structs with dots. Values are cast to the column's
type, and what can't be cast matches nothing. Comparisons with null match nothing.
"""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from terrace.errors import DataError

_TOKEN = re.compile(r"""\s*(?:"([^"]*)"|'([^']*)'|(==|!=|>=|<=|=|>|<)|([^\s=!<>"']+))""")
_OPERATORS = {"=", "==", "!=", ">", "<", ">=", "<="}
_NUMERIC = (T.NumericType, T.DecimalType)


def _tokens(condition: str) -> list[tuple[str, bool]]:
    """Tokens and whether each was quoted."""
    out, at, text = [], 0, condition.strip()
    while at < len(text):
        m = _TOKEN.match(text, at)
        if not m:
            raise DataError(f"can't read the condition at: {text[at:]!r}")
        quoted = m[1] if m[1] is not None else m[2]
        out.append((quoted, True) if quoted is not None else (m[3] or m[4], False))
        at = m.end()
    return out


def field_type(schema: T.StructType, field: str) -> T.DataType:
    """Type behind a dotted name."""
    kind: T.DataType = schema
    for part in field.split("."):
        if not isinstance(kind, T.StructType) or part not in kind.names:
            raise DataError(f"no field {field!r}")
        kind = kind[part].dataType
    return kind


def field_column(field: str) -> Column:
    """The column behind a dotted name."""
    return F.col(".".join(f"`{p}`" for p in field.split(".")))


def comparison(schema: T.StructType, field: str, operator: str, value: str) -> Column:
    if operator not in _OPERATORS:
        raise DataError(f"unknown operator {operator!r}")
    kind, column = field_type(schema, field), field_column(field)
    literal = F.lit(value)
    if isinstance(kind, _NUMERIC):
        target = kind if isinstance(kind, T.DecimalType) else T.DoubleType()
        # numbers compare as doubles, but whole numbers exactly
        if isinstance(kind, T.IntegralType) and re.fullmatch(r"[+-]?\d{1,18}", value):
            target = T.LongType()
        left, right = (column if target == kind else column.cast(target)), literal.try_cast(target)
    elif isinstance(kind, (T.BooleanType, T.DateType, T.TimestampType)):
        left, right = column, literal.try_cast(kind)
    elif isinstance(kind, T.StringType):
        numeric = operator not in ("=", "==", "!=") and re.fullmatch(r"[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?", value)
        left, right = (column.try_cast("double"), literal.cast("double")) if numeric else (column, literal)
    else:
        raise DataError(f"field {field!r} of type {kind.simpleString()} can't be compared")
    return {"=": left == right, "==": left == right, "!=": left != right, ">": left > right, "<": left < right, ">=": left >= right, "<=": left <= right}[operator]


def compile_condition(schema: T.StructType, condition: str) -> Column:
    """The condition over columns of ``schema``; joined from left to right."""
    tokens = _tokens(condition)
    if not tokens:
        raise DataError("the condition is empty")
    result, at, joiner = None, 0, None
    while True:
        part = tokens[at : at + 3]
        if len(part) < 3:
            raise DataError("a comparison needs field, operator and value")
        (field, _), (operator, quoted), (value, _) = part
        if quoted:
            raise DataError(f"unknown operator {operator!r}")
        one = comparison(schema, field, operator, value)
        result = one if result is None else (result & one if joiner == "AND" else result | one)
        at += 3
        if at == len(tokens):
            return result
        joiner = tokens[at][0].upper()
        if tokens[at][1] or joiner not in ("AND", "OR"):
            raise DataError(f"expected AND or OR, not {tokens[at][0]!r}")
        at += 1
        if at == len(tokens):
            raise DataError(f"nothing follows {joiner}")
