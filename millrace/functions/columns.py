"""Column arithmetic, comparison, binning and masks."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from itertools import pairwise

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..semantics import col, divide, present, round_even, to_int

# arithmetic ---------------------------------------------------------------


def add(a, b):
    return col(a) + (col(b) if isinstance(b, (str, Column)) else F.lit(b))


def subtract(a, b):
    return col(a) - (col(b) if isinstance(b, (str, Column)) else F.lit(b))


def multiply(a, b):
    return col(a) * (col(b) if isinstance(b, (str, Column)) else F.lit(b))


def safe_divide(a, b, ieee: bool = False):
    return divide(col(a), col(b) if isinstance(b, (str, Column)) else F.lit(b), ieee)


def negate(a):
    return -col(a)


def absolute(a):
    return F.abs(col(a))


def rounded(a, digits: int = 0):
    return round_even(col(a), digits)


def sqrt(a):
    return F.sqrt(col(a))


def log(a):
    return F.ln(col(a))


def log10(a):
    return F.log10(col(a))


def power(a, k):
    return F.pow(col(a), F.lit(k))


# comparison: false for a missing operand -----------------------------------


def _mask(c: Column) -> Column:
    return F.coalesce(c, F.lit(False))


def gt(a, v):
    return _mask(col(a) > v)


def gte(a, v):
    return _mask(col(a) >= v)


def lt(a, v):
    return _mask(col(a) < v)


def lte(a, v):
    return _mask(col(a) <= v)


def eq(a, v):
    return _mask(col(a) == v)


def between(a, lo, hi):
    return _mask(col(a).between(lo, hi))


def is_in(a, values: Sequence):
    return _mask(col(a).isin(list(values)))


def mask_and(*masks: Column):
    return reduce(lambda x, y: x & y, masks)


def mask_or(*masks: Column):
    return reduce(lambda x, y: x | y, masks)


def mask_not(m: Column):
    return ~m


def mask_xor(a: Column, b: Column):
    return a != b


# transforms -----------------------------------------------------------------


def clip(a, lo=None, hi=None):
    c = col(a)
    out = c if lo is None else F.greatest(c, F.lit(lo))
    out = out if hi is None else F.least(out, F.lit(hi))
    return F.when(c.isNotNull(), out)


def where(a, keep: Column, other):
    """The column where ``keep`` holds, ``other`` elsewhere."""
    return F.when(_mask(keep), col(a)).otherwise(F.lit(other))


def replace_values(a, mapping: dict):
    """Values by dictionary; others stay."""
    c = col(a)
    if not mapping:
        return c
    out = None
    for old, new in mapping.items():
        cond = c.isNull() if old is None else c == F.lit(old)
        out = F.when(cond, F.lit(new)) if out is None else out.when(cond, F.lit(new))
    return out.otherwise(c)


def cast(df: DataFrame, name: str, kind: str) -> Column:
    """Conversion that gives null where it fails; floats become integers half-to-even."""
    source = df.schema[name].dataType.simpleString()
    c = present(df, name)
    if source in ("float", "double") and kind in ("int", "bigint", "long", "smallint", "tinyint"):
        return to_int(c, kind)
    return c.try_cast(kind)


# whole-column values: one aggregate row, joined to every row ------------------


def with_aggregates(df: DataFrame, **aggregates: Column) -> DataFrame:
    """Columns that repeat whole-frame aggregates on each row (a one-row join, no one-task window)."""
    return df.join(F.broadcast(df.agg(*[v.alias(k) for k, v in aggregates.items()])))


def normalize_min_max(df: DataFrame, name: str, out: str | None = None) -> DataFrame:
    c = present(df, name)
    wide = with_aggregates(df, __lo=F.min(c), __hi=F.max(c))
    value = F.when(F.col("__hi") == F.col("__lo"), F.when(c.isNotNull(), 0.5)).otherwise((c - F.col("__lo")) / (F.col("__hi") - F.col("__lo")))
    return wide.withColumn(out or name, value).drop("__lo", "__hi")


def normalize_z(df: DataFrame, name: str, out: str | None = None) -> DataFrame:
    c = present(df, name)
    wide = with_aggregates(df, __m=F.avg(c), __s=F.stddev_samp(c))
    return wide.withColumn(out or name, F.when(F.col("__s") > 0, (c - F.col("__m")) / F.col("__s"))).drop("__m", "__s")


def _label(lo: float, hi: float) -> str:
    return f"({lo:.6g}, {hi:.6g}]"


def cut_by_edges(df: DataFrame, name: str, edges: Sequence[float], labels: Sequence[str] | None = None, out: str | None = None) -> DataFrame:
    """Right-closed bins (a, b]; at or under the first edge is the first bin, above the last is null."""
    names = list(labels) if labels else [_label(a, b) for a, b in pairwise(edges)]
    if len(names) != len(edges) - 1:
        raise ValueError("one label for each bin")
    c, bins = present(df, name), None
    for label, hi in zip(names, edges[1:], strict=True):
        bins = F.when(c <= hi, label) if bins is None else bins.when(c <= hi, label)
    return df.withColumn(out or f"{name}_bin", bins)


def cut(df: DataFrame, name: str, bins: int, labels: Sequence[str] | None = None) -> DataFrame:
    """Equal-width bins; the first edge lies 0.1 % of a width lower."""
    lo, hi = df.agg(F.min(present(df, name)), F.max(present(df, name))).first()
    if lo is None:
        return df.withColumn(f"{name}_bin", F.lit(None).cast("string"))
    width = (float(hi) - float(lo)) / bins
    edges = [float(lo) + i * width for i in range(bins)] + [float(hi)]
    edges[0] -= width * 0.001
    return cut_by_edges(df, name, edges, labels)


def qcut(df: DataFrame, name: str, bins: int, labels: Sequence[str] | None = None, approximate: bool = False) -> DataFrame:
    """Bins between quantiles (``approximate`` uses a bounded sketch)."""
    points = [i / bins for i in range(bins + 1)]
    c = present(df, name)
    if approximate:
        edges = df.agg(F.percentile_approx(c, points, 10_000)).first()[0]
    else:
        from ..operators.quantiles import exact_quantiles

        edges = exact_quantiles(df, {name: c}, points)[name]
    if edges is None or edges[0] is None:
        return df.withColumn(f"{name}_bin", F.lit(None).cast("string"))
    edges = sorted({float(e) for e in edges})
    if len(edges) == 1:
        edges = [edges[0] - 1, edges[0]]
    return cut_by_edges(df, name, edges, labels)


def arg_extreme(df: DataFrame, name: str, order_by: str, largest: bool) -> Column:
    """Aggregate: the ``order_by`` value of the first row with the extreme."""
    c = present(df, name)
    return F.min(F.when(c.isNotNull(), F.struct((-c if largest else c).alias("v"), col(order_by).alias("o"))))["o"]


def any_true(a):
    return F.coalesce(F.bool_or(col(a)), F.lit(False))


def all_true(a):
    return F.coalesce(F.bool_and(col(a)), F.lit(True))


def count_true(a):
    return F.count_if(col(a))
