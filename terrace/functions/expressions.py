"""Small expressions as text, such as `x * 2` or `x % 2 == 0`, compiled to Columns and never evaluated as code."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from terrace.errors import DataError

_TOKEN = re.compile(r"""\s*(?:(\d+\.\d*|\.\d+|\d+)|("[^"]*"|'[^']*')|([A-Za-z_]\w*)|(==|!=|<=|>=|&&|\|\||[-+*/%<>!()]))""")
_LEVELS = (("||",), ("&&",), ("==", "!="), ("<", "<=", ">", ">="), ("+", "-"), ("*", "/", "%"))


class _Parser:
    def __init__(self, text: str, names: dict[str, Column], whole: set[str]):
        self.tokens: list[tuple[str, str]] = []
        at = 0
        text = text.rstrip()
        while at < len(text):
            m = _TOKEN.match(text, at)
            if not m:
                raise DataError(f"can't read the expression at {text[at:]!r}")
            kind = next(k for k, g in zip(("number", "text", "name", "sign"), m.groups()) if g is not None)
            self.tokens.append((kind, m[m.lastindex]))
            at = m.end()
        self.at, self.names, self.whole = 0, names, whole

    def next_is(self, signs: tuple[str, ...]) -> str | None:
        if self.at < len(self.tokens) and self.tokens[self.at][0] == "sign" and self.tokens[self.at][1] in signs:
            self.at += 1
            return self.tokens[self.at - 1][1]
        return None

    def level(self, k: int) -> tuple[Column, bool]:
        """Value, and whether it is a whole number for sure."""
        if k == len(_LEVELS):
            return self.atom()
        left, whole = self.level(k + 1)
        while sign := self.next_is(_LEVELS[k]):
            right, other = self.level(k + 1)
            both = whole and other
            if sign == "/":
                left = F.try_divide(left, right) if not both else F.when(right != 0, F.floor(F.abs(left) / F.abs(right)) * F.sign(left.cast("double")) * F.sign(right.cast("double"))).cast("long")
            else:
                left = {"||": lambda a, b: a | b, "&&": lambda a, b: a & b, "==": lambda a, b: a == b, "!=": lambda a, b: a != b, "<": lambda a, b: a < b, "<=": lambda a, b: a <= b, ">": lambda a, b: a > b, ">=": lambda a, b: a >= b, "+": lambda a, b: a + b, "-": lambda a, b: a - b, "*": lambda a, b: a * b, "%": lambda a, b: F.try_mod(a, b)}[sign](left, right)
            whole = both and sign in ("+", "-", "*", "/", "%")
        return left, whole

    def atom(self) -> tuple[Column, bool]:
        if self.next_is(("-",)):
            value, whole = self.atom()
            return -value, whole
        if self.next_is(("!",)):
            return ~self.atom()[0], False
        if self.next_is(("(",)):
            value = self.level(0)
            if not self.next_is((")",)):
                raise DataError("a parenthesis is not closed")
            return value
        if self.at >= len(self.tokens):
            raise DataError("the expression ends too early")
        kind, text = self.tokens[self.at]
        self.at += 1
        if kind == "number":
            return (F.lit(float(text)), False) if "." in text else (F.lit(int(text)), True)
        if kind == "text":
            return F.lit(text[1:-1]), False
        if kind == "name" and text in self.names:
            return self.names[text], text in self.whole
        if kind == "name" and text in ("true", "false"):
            return F.lit(text == "true"), False
        raise DataError(f"unexpected {text!r}")


def compile_expression(text: str, names: dict[str, Column], whole: set[str] = frozenset()) -> Column:
    """The expression over named columns; names in ``whole`` hold whole numbers, whose quotients are cut to whole ones."""
    parser = _Parser(text, names, set(whole))
    value, _ = parser.level(0)
    if parser.at != len(parser.tokens):
        raise DataError(f"unexpected {parser.tokens[parser.at][1]!r}")
    return value
