"""Missing values, numeric policy and ordering rules, as column expressions.

The single place that decides how the library differs from plain Spark: NaN counts as missing, sorts put missing
values last, rounding is half-to-even, division never raises, sums of nothing are zero in the
pandas-like surface and null in the SQL-like one.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

NUMERIC = (T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.FloatType, T.DoubleType, T.DecimalType)
FLOATING = (T.FloatType, T.DoubleType)


def col(c: str | Column) -> Column:
    """A column by exact name (dots allowed) or as given."""
    return F.col("`" + c.replace("`", "``") + "`") if isinstance(c, str) else c


def is_floating(df: DataFrame, name: str) -> bool:
    return isinstance(df.schema[name].dataType, FLOATING)


def is_numeric(df: DataFrame, name: str) -> bool:
    return isinstance(df.schema[name].dataType, NUMERIC)


def numeric_columns(df: DataFrame, exclude: Sequence[str] = ()) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, NUMERIC) and f.name not in exclude]


def present(df: DataFrame, name: str) -> Column:
    """The column with NaN as null."""
    c = col(name)
    return F.when(~F.isnan(c), c) if is_floating(df, name) else c


def missing(df: DataFrame, name: str) -> Column:
    c = col(name)
    return (c.isNull() | F.isnan(c)) if is_floating(df, name) else c.isNull()


def sort_keys(df: DataFrame, by: Sequence[str], ascending: bool | Sequence[bool] = True) -> list[Column]:
    """Order expressions that put missing values last in both directions."""
    flags = [ascending] * len(by) if isinstance(ascending, bool) else list(ascending)
    if len(flags) != len(by):
        raise ValueError("ascending must have one flag for each column")
    out = []
    for name, up in zip(by, flags, strict=True):
        c = present(df, name)
        out.append(c.asc_nulls_last() if up else c.desc_nulls_last())
    return out


def reversed_keys(df: DataFrame, by: Sequence[str]) -> list[Column]:
    """The exact reverse of ``sort_keys``: missing values first, all keys turned round."""
    return [present(df, name).desc_nulls_first() for name in by]


def divide(a: Column, b: Column, ieee: bool = False) -> Column:
    """Double division; by zero null, or signed infinity/NaN with ``ieee``."""
    a, b = a.cast("double"), b.cast("double")
    out = F.try_divide(a, b)
    if ieee:
        zero = F.when(a > 0, float("inf")).when(a < 0, float("-inf")).when(a.isNotNull(), float("nan"))
        out = F.when(b == 0, zero).otherwise(out)
    return out


def round_even(c: Column, digits: int = 0) -> Column:
    return F.bround(c, digits)


def to_int(c: Column, kind: str = "int") -> Column:
    """Half-to-even conversion of a number; what does not fit is null."""
    return F.bround(c.cast("double"), 0).try_cast(kind)


def key_equal(left: DataFrame, right: DataFrame, l: str, r: str, null_equals: bool) -> Column:
    """Join condition: NaN never matches; null matches null if ``null_equals``."""
    a, b = left[l], right[r]
    cond = a.eqNullSafe(b) if null_equals else a == b
    if is_floating(left, l):
        cond = cond & ~F.isnan(F.coalesce(a, F.lit(0.0)))
    return cond


def skewness(c: Column) -> Column:
    """Adjusted Fisher-Pearson skewness; null under three values, 0 for a constant."""
    n = F.count(c).cast("double")
    g = F.when(F.stddev_pop(c) == 0, 0.0).otherwise(F.skewness(c))
    return F.when(n >= 3, g * F.sqrt(n * (n - 1)) / F.nullif(n - 2, F.lit(0.0)))


def kurtosis(c: Column) -> Column:
    """Sample excess kurtosis; null under four values, 0 for a constant."""
    n = F.count(c).cast("double")
    body = ((n + 1) * F.kurtosis(c) + 6) * (n - 1) / F.nullif((n - 2) * (n - 3), F.lit(0.0))
    return F.when(n >= 4, F.when(F.stddev_pop(c) == 0, 0.0).otherwise(body))


#: name -> aggregate of a column without NaN
AGGREGATES = {
    "sum": lambda c: F.coalesce(F.sum(c).cast("double"), F.lit(0.0)),
    "sum_or_null": lambda c: F.sum(c).cast("double"),
    "mean": lambda c: F.avg(c),
    "median": lambda c: F.percentile(c, 0.5),
    "std": lambda c: F.stddev_samp(c),
    "var": lambda c: F.var_samp(c),
    "min": lambda c: F.min(c),
    "max": lambda c: F.max(c),
    "count": lambda c: F.count(c),
    "nunique": lambda c: F.countDistinct(c),
    "prod": lambda c: F.product(c),
    "skew": skewness,
    "kurtosis": kurtosis,
    "sem": lambda c: F.stddev_samp(c) / F.sqrt(F.count(c)),
}


def quantile(c: Column, q: float | list[float]) -> Column:
    """Exact, linear interpolation at q (n - 1)."""
    return F.percentile(c, q if isinstance(q, float) else F.array(*[F.lit(float(x)) for x in q]))
