"""The expression language of ``eval`` and the filter language of ``query``, compiled to columns."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..semantics import col, divide

_TOKEN = re.compile(r"\s*(?:(\d+(?:\.\d*)?|\.\d+)|('[^']*')|([A-Za-z_]\w*)|(>=|<=|==|!=|[-+*/()<>=&|!]))")


class ParseError(ValueError):
    pass


def tokenize(text: str) -> list[tuple[str, str]]:
    out, at = [], 0
    text = text.rstrip()
    while at < len(text):
        m = _TOKEN.match(text, at)
        if not m:
            raise ParseError(f"unexpected {text[at:at + 10]!r}")
        number, string, name, sign = m.groups()
        if number:
            out.append(("number", number))
        elif string is not None:
            out.append(("string", string[1:-1]))
        elif name:
            out.append((name, name) if name in ("and", "or", "not") else ("name", name))
        else:
            out.append((sign, sign))
        at = m.end()
    return [*out, ("end", "")]


class Parser:
    """or > and > not > comparison > sum > product > sign > atom; arithmetic is double, division by zero null."""

    def __init__(self, text: str, columns: set[str]):
        self.tokens, self.at, self.columns = tokenize(text), 0, columns

    def take(self, *kinds: str) -> str | None:
        if self.tokens[self.at][0] in kinds:
            self.at += 1
            return self.tokens[self.at - 1][0]
        return None

    def parse(self) -> tuple[Column, bool]:
        out = self.either()
        if self.tokens[self.at][0] != "end":
            raise ParseError(f"unexpected {self.tokens[self.at][1]!r}")
        return out

    def either(self):
        left, logical = self.both()
        while self.take("or", "|"):
            left, logical = left | self.both()[0], True
        return left, logical

    def both(self):
        left, logical = self.inverse()
        while self.take("and", "&"):
            left, logical = left & self.inverse()[0], True
        return left, logical

    def inverse(self):
        if self.take("not", "!"):
            return ~self.inverse()[0], True
        return self.compare()

    def compare(self):
        left, logical = self.sum()
        op = self.take(">", "<", ">=", "<=", "==", "!=", "=")
        if not op:
            return left, logical
        right, _ = self.sum()
        made = {">": left > right, "<": left < right, ">=": left >= right, "<=": left <= right, "==": left == right, "=": left == right, "!=": left != right}
        return made[op], True

    def sum(self):
        left, logical = self.product()
        while op := self.take("+", "-"):
            right = self.product()[0]
            a, b = left.cast("double"), right.cast("double")
            left, logical = (a + b if op == "+" else a - b), False
        return left, logical

    def product(self):
        left, logical = self.sign()
        while op := self.take("*", "/"):
            right = self.sign()[0]
            left, logical = (left.cast("double") * right.cast("double") if op == "*" else divide(left, right)), False
        return left, logical

    def sign(self):
        if self.take("-"):
            return -(self.sign()[0].cast("double")), False
        return self.atom()

    def atom(self):
        kind, text = self.tokens[self.at]
        self.at += 1
        if kind == "number":
            return F.lit(float(text)), False
        if kind == "string":
            return F.lit(text), False
        if kind == "name":
            if text in ("true", "false") and text not in self.columns:
                return F.lit(text == "true"), True
            if text not in self.columns:
                raise ParseError(f"no column {text!r}")
            return col(text), False
        if kind == "(":
            out = self.either()
            if not self.take(")"):
                raise ParseError("missing )")
            return out
        raise ParseError(f"unexpected {text!r}")


def compile_expression(df: DataFrame, text: str) -> tuple[Column, bool]:
    """(column, whether it is a condition)."""
    made, logical = Parser(text, set(df.columns)).parse()
    if not logical and isinstance(df.select(made.alias("x")).schema["x"].dataType, T.BooleanType):
        logical = True
    return made, logical


def evaluate(df: DataFrame, text: str) -> DataFrame:
    """A condition filters; 'name = expression' sets a column; anything else is added as 'result'."""
    m = re.match(r"\s*([A-Za-z_]\w*)\s*=(?!=)", text)
    if m:
        return df.withColumn(m[1], compile_expression(df, text[m.end() :])[0])
    made, logical = compile_expression(df, text)
    return df.where(made) if logical else df.withColumn("result", made)


_PART = re.compile(r"^\s*(\w+)\s*(>=|<=|==|!=|=|>|<)\s*(.+?)\s*$")


def query_condition(df: DataFrame, text: str) -> Column:
    """Comparisons joined by 'or' of 'and's, without parentheses; literals take the column's type."""
    alternatives = []
    for arm in re.split(r"\s+or\s+|\|\|", text, flags=re.I):
        parts = [_comparison(df, p) for p in re.split(r"\s+and\s+|&&", arm, flags=re.I)]
        made = parts[0]
        for p in parts[1:]:
            made = made & p
        alternatives.append(made)
    out = alternatives[0]
    for a in alternatives[1:]:
        out = out | a
    return out


def _comparison(df: DataFrame, text: str) -> Column:
    m = _PART.match(text)
    if not m or m[1] not in df.columns:
        raise ParseError(f"cannot read {text.strip()!r}")
    c, op, raw = col(m[1]), m[2], m[3]
    if len(raw) > 1 and raw[0] == raw[-1] and raw[0] in "'\"":
        raw = raw[1:-1]
    kind = df.schema[m[1]].dataType
    if isinstance(kind, (T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.FloatType, T.DoubleType, T.DecimalType)):
        value = F.lit(float(raw)) if re.search(r"[.eE]", raw) else F.lit(int(raw))
    elif isinstance(kind, T.StringType):
        value = F.lit(raw)
    else:
        value = F.lit(raw).cast(kind)
    return {">": c > value, "<": c < value, ">=": c >= value, "<=": c <= value, "==": c == value, "=": c == value, "!=": c != value}[op]
