"""Row order at scale: positions, cumulative values and row windows over a whole frame.

A window without PARTITION BY is one task in Spark. Here rows are cut by borders over all order keys
into range buckets of about ROWS rows; each bucket is sorted alone and the buckets' totals, one row each, give the offsets. Row windows
then run in blocks of consecutive positions, with the rows a window needs from the next blocks copied over.

Borders come from a sample, which takes two jobs over the key columns while the plan is built (a count and the sample). Verbs take
``borders`` found before, so that several verbs over one order share them. Rows that tie in all keys share a bucket.
"""

from __future__ import annotations

import json
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .semantics import col, present, sort_keys

#: Rows of a bucket, about; most buckets (so that the driver holds a bounded sample); sampled rows for each.
ROWS, MOST_BUCKETS, SAMPLES = 1_000_000, 16_384, 16
POSITION = "__pos"
_BUCKET = "__bucket"


@dataclass(frozen=True)
class Borders:
    """Key rows, ascending in the order they were made for, and how many rows the frame had."""

    keys: tuple[str, ...]
    ascending: tuple[bool, ...]
    rows: int
    values: tuple[tuple, ...]


def with_row_id(df: DataFrame, name: str = "__row_id") -> DataFrame:
    """A hidden increasing id: the ingest order, stable for a deterministic scan."""
    return df.withColumn(name, F.monotonically_increasing_id())


def _flags(by: Sequence[str], ascending: bool | Sequence[bool]) -> tuple[bool, ...]:
    return (ascending,) * len(by) if isinstance(ascending, bool) else tuple(ascending)


def _comparable(df: DataFrame, name: str) -> tuple[Column, str]:
    """(the key as a number or text in the same order, its type)."""
    c, kind = present(df, name), df.schema[name].dataType
    if isinstance(kind, T.BooleanType):
        return c.cast("int"), "int"
    if isinstance(kind, (T.TimestampType, T.TimestampNTZType, T.DateType)):
        return F.unix_micros(c.cast("timestamp")), "long"
    if isinstance(kind, T.BinaryType):
        return F.hex(c), "string"
    if isinstance(kind, (T.StringType, T.DecimalType)):
        return c, kind.simpleString()
    if isinstance(kind, (T.FloatType, T.DoubleType)):
        return c.cast("double"), "double"
    return c.cast("long"), "long"


def find_borders(df: DataFrame, by: Sequence[str], ascending: bool | Sequence[bool] = True, buckets: int | None = None) -> Borders:
    """Borders of about equal ranges of ``df`` in the order of all keys ``by`` (missing last). At most SAMPLES rows a bucket reach the driver."""
    flags, keys = _flags(by, ascending), [_comparable(df, c)[0].alias(f"k{i}") for i, c in enumerate(by)]
    n = df.count()
    wanted = buckets or max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-n // ROWS))
    wanted = max(1, min(wanted, MOST_BUCKETS, n))
    share = min(1.0, wanted * SAMPLES / max(1, n))
    drawn = [tuple(r) for r in df.select(*keys).sample(fraction=share, seed=7).collect()] if n else []
    for i in reversed(range(len(keys))):
        known = sorted((r for r in drawn if r[i] is not None), key=lambda r: r[i], reverse=not flags[i])
        drawn = known + [r for r in drawn if r[i] is None]
    picked = [drawn[len(drawn) * i // wanted] for i in range(1, wanted)] if drawn else []
    return Borders(tuple(by), flags, n, tuple(dict.fromkeys(picked)))


def _after(keys: list[Column], flags: Sequence[bool], border: Column) -> Column:
    """The row stands after the border."""
    out = F.lit(False)
    for i in reversed(range(len(keys))):
        k, b = keys[i], border[f"k{i}"]
        beyond = F.coalesce(k > b if flags[i] else k < b, k.isNull() & b.isNotNull())
        out = beyond | (k.eqNullSafe(b) & out)
    return out


def range_bucket(df: DataFrame, by: str | Sequence[str], ascending: bool | Sequence[bool] = True, borders: Borders | None = None) -> tuple[DataFrame, Borders]:
    """Adds a bucket number that follows the order of all keys ``by``: a binary search in the borders, which are one literal."""
    by = [by] if isinstance(by, str) else list(by)
    borders = borders or find_borders(df, by, ascending)
    if borders.keys != tuple(by) or borders.ascending != _flags(by, ascending):
        raise ValueError("the borders were found for another order")
    if not borders.values:
        return df.withColumn(_BUCKET, F.lit(0)), borders
    keys = [_comparable(df, c) for c in by]
    rows = "[" + ",".join(json.dumps({f"k{i}": str(x) if keys[i][1].startswith("decimal") and x is not None else x for i, x in enumerate(r)}) for r in borders.values) + "]"
    literal = F.from_json(F.lit(rows), "array<struct<" + ",".join(f"k{i}:{kind}" for i, (_, kind) in enumerate(keys)) + ">>")

    def step(acc: Column, _: Column) -> Column:
        middle = F.shiftright(acc["lo"] + acc["hi"], 1)
        up, open_ = _after([k for k, _ in keys], borders.ascending, F.get(literal, middle)), acc["lo"] < acc["hi"]
        return F.struct(F.when(open_ & up, middle + 1).otherwise(acc["lo"]).alias("lo"), F.when(open_ & ~up, middle).otherwise(acc["hi"]).alias("hi"))

    steps = F.sequence(F.lit(1), F.lit(len(borders.values).bit_length()))
    number = F.aggregate(steps, F.struct(F.lit(0).alias("lo"), F.lit(len(borders.values)).alias("hi")), step, lambda acc: acc["lo"])
    return df.withColumn(_BUCKET, number), borders


def with_position(df: DataFrame, by: Sequence[str], ascending: bool | Sequence[bool] = True, name: str = POSITION, borders: Borders | None = None, keep_bucket: bool = False) -> DataFrame:
    """0-based position in the whole frame's order, without a one-task window."""
    bucketed, borders = range_bucket(df, by, ascending, borders)
    sizes = bucketed.groupBy(_BUCKET).agg(F.count(F.lit(1)).alias("__n"))
    before = sizes.withColumn("__before", F.coalesce(F.sum("__n").over(Window.orderBy(_BUCKET).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("__n")
    within = F.row_number().over(Window.partitionBy(_BUCKET).orderBy(*sort_keys(df, by, borders.ascending)))
    out = bucketed.join(F.broadcast(before), _BUCKET).withColumn(name, F.col("__before") + within - 1).drop("__before")  # one row a bucket
    return out if keep_bucket else out.drop(_BUCKET)


def cumulative(df: DataFrame, by: Sequence[str], specs: dict[str, tuple[str, Column]], partition_by: Sequence[str] = (), borders: Borders | None = None) -> DataFrame:
    """Running sum, count, min, max or prod: name -> (function, column), nulls skipped and null where the row is null.

    With ``partition_by`` a plain window; else the two-pass form over range buckets.
    """
    funcs = {"sum": F.sum, "count": F.count, "min": F.min, "max": F.max}
    keys = sort_keys(df, by)
    if partition_by:
        w = Window.partitionBy(*map(col, partition_by)).orderBy(*keys).rowsBetween(Window.unboundedPreceding, 0)
        return df.withColumns({name: F.when(c.isNotNull(), _product(c, w) if f == "prod" else funcs[f](c).over(w)) for name, (f, c) in specs.items()})
    bucketed, _ = range_bucket(df, by, borders=borders)
    parts = {f"__p{i}": F.product(c) if f == "prod" else funcs[f](c) for i, (f, c) in enumerate(specs.values())}
    totals = bucketed.groupBy(_BUCKET).agg(*[v.alias(k) for k, v in parts.items()])
    w = Window.orderBy(_BUCKET).rowsBetween(Window.unboundedPreceding, -1)  # one row a bucket
    before = totals.select(_BUCKET, *[(_product(F.col(f"__p{i}"), w) if f == "prod" else (F.sum if f == "count" else funcs[f])(f"__p{i}").over(w)).alias(f"__o{i}") for i, (f, _) in enumerate(specs.values())])
    out = bucketed.join(F.broadcast(before), _BUCKET)
    inner = Window.partitionBy(_BUCKET).orderBy(*keys).rowsBetween(Window.unboundedPreceding, 0)
    joins = {"sum": _plus, "count": _plus, "prod": lambda a, b: a * F.coalesce(b, F.lit(1.0)), "min": F.least, "max": F.greatest}
    made = {}
    for i, (name, (f, c)) in enumerate(specs.items()):
        own, offset = (_product(c, inner) if f == "prod" else funcs[f](c).over(inner)), F.col(f"__o{i}")
        made[name] = F.when(c.isNotNull(), joins[f](own, offset))
    return out.withColumns(made).drop(_BUCKET, *[f"__o{i}" for i in range(len(specs))])


def _plus(a: Column, b: Column) -> Column:
    return a + F.coalesce(b, F.lit(0))


def running_moments(df: DataFrame, by: Sequence[str], c: Column, partition_by: Sequence[str] = (), borders: Borders | None = None) -> DataFrame:
    """__n, __mean and __m2 (squares about the mean) of the present values so far; 0, null and null where there are none.

    Each bucket's moments are taken about its own mean and merged pairwise, so a large offset of the values costs no digits.
    """
    if partition_by:
        w = Window.partitionBy(*map(col, partition_by)).orderBy(*sort_keys(df, by)).rowsBetween(Window.unboundedPreceding, 0)
        return df.withColumns({"__n": F.count(c).over(w), "__mean": F.avg(c).over(w), "__m2": F.var_pop(c).over(w) * F.count(c).over(w)})
    bucketed, _ = range_bucket(df.withColumn("__c", c.cast("double")), by, borders=borders)
    c = F.col("__c")
    totals = bucketed.groupBy(_BUCKET).agg(F.count(c).alias("n"), F.avg(c).alias("mean"), (F.var_pop(c) * F.count(c)).alias("m2"))
    shift = F.avg("mean").over(Window.partitionBy())  # one row a bucket
    totals = totals.withColumn("off", F.coalesce(F.col("mean") - shift, F.lit(0.0))).withColumn("shift", shift)
    w = Window.orderBy(_BUCKET).rowsBetween(Window.unboundedPreceding, -1)
    n, first, second = (F.sum(x).over(w) for x in ("n", F.col("n") * F.col("off"), F.coalesce("m2", F.lit(0.0)) + F.col("n") * F.col("off") * F.col("off")))
    before = totals.select(_BUCKET, n.alias("__n1"), (F.col("shift") + first / F.nullif(n, F.lit(0))).alias("__mean1"), (second - first * first / F.nullif(n, F.lit(0))).alias("__m21"))
    inner = Window.partitionBy(_BUCKET).orderBy(*sort_keys(df, by)).rowsBetween(Window.unboundedPreceding, 0)
    own = {"__n2": F.count(c).over(inner), "__mean2": F.avg(c).over(inner), "__m22": F.var_pop(c).over(inner) * F.count(c).over(inner)}
    out = bucketed.join(F.broadcast(before), _BUCKET).withColumns(own)
    n1, n2, gap = F.coalesce("__n1", F.lit(0)), F.col("__n2"), F.col("__mean2") - F.col("__mean1")
    total = n1 + n2
    merged = {
        "__n": total,
        "__mean": F.coalesce(F.col("__mean1") + gap * n2 / F.nullif(total, F.lit(0)), "__mean2", "__mean1"),
        "__m2": F.coalesce(F.col("__m21") + F.col("__m22") + gap * gap * n1 * n2 / F.nullif(total, F.lit(0)), "__m22", "__m21"),
    }
    return out.withColumns(merged).drop(_BUCKET, "__c", *own, "__n1", "__mean1", "__m21")


def _product(c: Column, w) -> Column:
    """A running product from logarithms, signs and zeros (Spark has no product window that merges)."""
    c = c.cast("double")
    size = F.exp(F.sum(F.when(c != 0, F.ln(F.abs(c)))).over(w))
    sign = F.when(F.sum(F.when(c < 0, 1).otherwise(0)).over(w) % 2 == 1, -1.0).otherwise(1.0)
    return F.when(F.max(F.when(c == 0, 1).otherwise(0)).over(w) == 1, 0.0).otherwise(F.coalesce(size, F.lit(1.0)) * sign)


def row_windows(df: DataFrame, by: Sequence[str], make, before: int, after: int, partition_by: Sequence[str] = (), block: int | None = None, borders: Borders | None = None) -> DataFrame:
    """Columns from row windows that reach ``before`` rows back and ``after`` rows on.

    ``make(window)`` gives name -> expression for a window spec without frame. Without ``partition_by``
    rows are blocked by position, and the rows next to a border are copied to the other side.
    """
    keys = sort_keys(df, by)
    if partition_by:
        return df.withColumns(make(Window.partitionBy(*map(col, partition_by)).orderBy(*keys)))
    borders = borders or find_borders(df, by)
    share = -(-borders.rows // (len(borders.values) + 1))
    size = max(block or min(max(share, 1000), ROWS), 10 * (before + after))
    at = with_position(df, by, borders=borders)
    home = F.floor(F.col(POSITION) / size)
    rest = F.pmod(F.col(POSITION), F.lit(size))
    homes = F.array(home, F.when(rest >= size - before, home + 1), F.when((rest < after) & (home > 0), home - 1))
    copies = at.withColumn("__home", home).withColumn("__block", F.explode(F.array_compact(homes)))
    made = copies.withColumns(make(Window.partitionBy("__block").orderBy(POSITION)))
    return made.where("__home = __block").drop("__home", "__block", POSITION)
