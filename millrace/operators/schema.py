"""Schema checks: every rule is a counter of one aggregate; all errors are collected."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..semantics import col, missing


class SchemaError(ValueError):
    def __init__(self, errors: list[str]):
        super().__init__("; ".join(errors))
        self.errors = errors


@dataclass
class FrameSchema:
    """Fluent rules: columns with type, nulls, uniqueness, range, pattern, allowed values and checks; row counts."""

    columns: dict[str, dict] = field(default_factory=dict)
    only: bool = False
    rows: tuple[int | None, int | None] = (None, None)
    no_duplicates: bool = False
    checks: list[tuple[str, Column]] = field(default_factory=list)

    def column(self, name: str, dtype: str | None = None, *, no_nulls: bool = False, unique: bool = False, minimum=None, maximum=None, pattern: str | None = None, allowed: Sequence | None = None, check: Column | None = None) -> FrameSchema:
        self.columns[name] = {"dtype": dtype, "no_nulls": no_nulls, "unique": unique, "minimum": minimum, "maximum": maximum, "pattern": pattern, "allowed": allowed, "check": check}
        return self

    def has_columns(self, *names: str) -> FrameSchema:
        for n in names:
            self.columns.setdefault(n, {})
        return self

    def no_extra_columns(self) -> FrameSchema:
        self.only = True
        return self

    def min_rows(self, n: int) -> FrameSchema:
        self.rows = (n, self.rows[1])
        return self

    def max_rows(self, n: int) -> FrameSchema:
        self.rows = (self.rows[0], n)
        return self

    def no_duplicate_rows(self) -> FrameSchema:
        self.no_duplicates = True
        return self

    def check(self, label: str, condition: Column) -> FrameSchema:
        self.checks.append((label, condition))
        return self

    def errors(self, df: DataFrame) -> list[str]:
        """All violations; empty if the frame is valid."""
        out = [f"column {n!r} is missing" for n in self.columns if n not in df.columns]
        if self.only:
            out += [f"column {n!r} is not expected" for n in df.columns if n not in self.columns]
        aggs: list[Column] = [F.count(F.lit(1)).alias("__rows")]
        labels: list[str] = []

        def count(label: str, value: Column) -> None:
            aggs.append(value.alias(f"__{len(labels)}"))
            labels.append(label)

        for n, r in self.columns.items():
            if n not in df.columns:
                continue
            kind = df.schema[n].dataType.simpleString()
            if r.get("dtype") and kind != r["dtype"]:
                out.append(f"column {n!r} is {kind}, not {r['dtype']}")
                continue
            c, gone = col(n), missing(df, n)
            if r.get("no_nulls"):
                count(f"column {n!r} has missing values", F.count_if(gone))
            if r.get("unique"):
                count(f"column {n!r} repeats values", F.count(F.when(~gone, c)) - F.countDistinct(F.when(~gone, c)))
            if r.get("minimum") is not None:
                count(f"column {n!r} has values under {r['minimum']}", F.count_if(~gone & (c < r["minimum"])))
            if r.get("maximum") is not None:
                count(f"column {n!r} has values over {r['maximum']}", F.count_if(~gone & (c > r["maximum"])))
            if r.get("pattern") is not None:
                count(f"column {n!r} has values that do not match {r['pattern']}", F.count_if(~gone & ~c.rlike(r["pattern"])))
            if r.get("allowed") is not None:
                count(f"column {n!r} has values that are not allowed", F.count_if(~gone & ~c.isin(list(r["allowed"]))))
            if r.get("check") is not None:
                count(f"column {n!r} fails its check", F.count_if(~gone & ~F.coalesce(r["check"], F.lit(False))))
        for label, cond in self.checks:
            count(label, F.count_if(~F.coalesce(cond, F.lit(False))))
        row = df.agg(*aggs).first()
        out += [f"{label} ({row[f'__{i}']})" for i, label in enumerate(labels) if row[f"__{i}"]]
        lo, hi = self.rows
        if lo is not None and row["__rows"] < lo:
            out.append(f"{row['__rows']} rows, fewer than {lo}")
        if hi is not None and row["__rows"] > hi:
            out.append(f"{row['__rows']} rows, more than {hi}")
        if self.no_duplicates and not df.groupBy(*map(col, df.columns)).count().where("count > 1").isEmpty():
            out.append("rows repeat")
        return out

    def is_valid(self, df: DataFrame) -> bool:
        return not self.errors(df)

    def validate(self, df: DataFrame) -> DataFrame:
        found = self.errors(df)
        if found:
            raise SchemaError(found)
        return df


def rule_counts(df: DataFrame, rules: dict[str, Column]) -> DataFrame:
    """(rule, violations) of boolean rules, by one aggregate."""
    rows = F.array(*[F.struct(F.lit(n).alias("rule"), F.count_if(~F.coalesce(c, F.lit(False))).alias("violations")) for n, c in rules.items()])
    return df.agg(rows.alias("r")).select(F.inline("r"))
