"""Rolling, expanding and exponentially weighted windows, cumulative values, shifts and ranks.

Every function takes the order explicitly and optional partition columns; without those, rows are processed in range
buckets or position blocks (see ``ordering``), never in one task.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..ordering import cumulative, row_windows, running_moments, with_position
from ..semantics import col, present, sort_keys

_FUNCS: dict[str, Callable[[Column], Column]] = {"mean": F.avg, "sum": F.sum, "min": F.min, "max": F.max, "std": F.stddev_samp, "var": F.var_samp, "count": F.count}


def rolling(df: DataFrame, name: str, size: int, how: str, order_by: Sequence[str], partition_by: Sequence[str] = (), min_periods: int | None = None, center: bool = False, out: str | None = None, block: int | None = None) -> DataFrame:
    """A statistic of the last ``size`` rows (or the rows around, with ``center``), null under ``min_periods`` present values."""
    least = size if min_periods is None else min_periods
    before, after = (size // 2, size - 1 - size // 2) if center else (size - 1, 0)
    c = present(df, name)

    def make(w):
        frame = w.rowsBetween(-before, after)
        return {out or f"{name}_rolling_{how}": F.when(F.count(c).over(frame) >= max(least, 1), _FUNCS[how](c).over(frame))}

    return row_windows(df, order_by, make, before, after, partition_by, block)


def rolling_apply(df: DataFrame, name: str, size: int, f: Callable, order_by: Sequence[str], partition_by: Sequence[str], out: str | None = None) -> DataFrame:
    """f(list of present values) -> number over full windows, by a grouped-aggregate pandas function."""
    @F.pandas_udf("double")
    def run(v: pd.Series) -> float:
        v = v.dropna()
        return float(f(v.tolist())) if len(v) >= size else float("nan")

    w = Window.partitionBy(*map(col, partition_by)).orderBy(*sort_keys(df, order_by)).rowsBetween(-(size - 1), 0)
    value = run(col(name).cast("double")).over(w)
    target = out or f"{name}_rolling_apply"
    return df.withColumn(target, value).withColumn(target, F.when(~F.isnan(target), F.col(target)))


def expanding(df: DataFrame, name: str, how: str, order_by: Sequence[str], partition_by: Sequence[str] = (), min_periods: int = 1, out: str | None = None) -> DataFrame:
    """A statistic of all rows so far."""
    c, target = present(df, name), out or f"{name}_expanding_{how}"
    filled = df.withColumn("__v", c)
    if partition_by:
        w = Window.partitionBy(*map(col, partition_by)).orderBy(*sort_keys(df, order_by)).rowsBetween(Window.unboundedPreceding, 0)
        value = _FUNCS[how](F.col("__v")).over(w)
        return filled.withColumn(target, F.when(F.count("__v").over(w) >= min_periods, value)).drop("__v")
    # a missing row still sees what came before: count and sums of 0, extremes of a neutral value
    v = F.col("__v").cast("double")
    if how in ("mean", "std", "var"):
        run, n = running_moments(filled, order_by, v), F.col("__n")
        var = F.when(n > 1, F.col("__m2") / (n - 1))
        value = {"mean": F.col("__mean"), "var": var, "std": F.when(var.isNotNull(), F.sqrt(F.greatest(var, F.lit(0.0))))}[how]
        return run.withColumn(target, F.when(n >= min_periods, value)).drop("__v", "__n", "__mean", "__m2")
    specs = {"__n": ("sum", F.when(F.col("__v").isNotNull(), 1).otherwise(0))}
    if how in ("min", "max"):
        specs["__e"] = (how, F.coalesce(v, F.lit(float("inf") if how == "min" else float("-inf"))))
    elif how == "sum":
        specs["__e"] = ("sum", F.coalesce(v, F.lit(0.0)))
    elif how != "count":
        raise ValueError(how)
    run = cumulative(filled, order_by, specs)
    value = F.col("__n") if how == "count" else F.col("__e")
    return run.withColumn(target, F.when(F.col("__n") >= min_periods, value)).drop("__v", *specs)


def ewm_mean(df: DataFrame, name: str, order_by: Sequence[str], partition_by: Sequence[str], span: float | None = None, alpha: float | None = None, out: str | None = None) -> DataFrame:
    """Recursive exponential mean, alpha = 2 / (span + 1); a missing value gives null and keeps the state.

    Sequential in each series, so each partition is one numpy loop in a pandas function.
    """
    a = alpha if alpha is not None else 2.0 / (span + 1.0)
    target, order = out or f"{name}_ewm", list(order_by)
    if not partition_by:
        raise ValueError("an exponential mean is sequential: name the series columns")

    def run(pdf):
        pdf = pdf.sort_values(order)
        values, state, made = pdf[name].to_numpy(float), None, []
        for v in values:
            if v != v:
                made.append(None)
                continue
            state = v if state is None else a * v + (1 - a) * state
            made.append(state)
        return pdf.drop(columns=[target], errors="ignore").assign(**{target: made})

    return df.groupBy(*map(col, partition_by)).applyInPandas(run, T.StructType([*[f for f in df.schema.fields if f.name != target], T.StructField(target, T.DoubleType())]))


def cum(df: DataFrame, name: str, how: str, order_by: Sequence[str], partition_by: Sequence[str] = (), out: str | None = None) -> DataFrame:
    """Running sum, prod, min, max or count; null where the value is missing."""
    return cumulative(df, order_by, {out or f"{name}_cum{how}": (how, present(df, name))}, partition_by)


def _lagged(c: Column, k: int, w) -> Column:
    return (F.lag(c, k) if k >= 0 else F.lead(c, -k)).over(w)


def shift(df: DataFrame, name: str, k: int, order_by: Sequence[str], partition_by: Sequence[str] = (), out: str | None = None) -> DataFrame:
    return row_windows(df, order_by, lambda w: {out or f"{name}_shift_{k}": _lagged(col(name), k, w)}, max(k, 0), max(-k, 0), partition_by)


def diff(df: DataFrame, name: str, k: int, order_by: Sequence[str], partition_by: Sequence[str] = (), out: str | None = None) -> DataFrame:
    c = present(df, name)
    return row_windows(df, order_by, lambda w: {out or f"{name}_diff": c - _lagged(c, k, w)}, max(k, 0), max(-k, 0), partition_by)


def pct_change(df: DataFrame, name: str, k: int, order_by: Sequence[str], partition_by: Sequence[str] = (), out: str | None = None) -> DataFrame:
    c = present(df, name).cast("double")
    return row_windows(df, order_by, lambda w: {out or f"{name}_pct_change": F.try_divide(c - _lagged(c, k, w), _lagged(c, k, w))}, max(k, 0), max(-k, 0), partition_by)


def rank(df: DataFrame, name: str, method: str = "average", ascending: bool = True, partition_by: Sequence[str] = (), tie_break: Sequence[str] = (), out: str | None = None) -> DataFrame:
    """average, min, max, first or dense rank as a double; missing values have none.

    Without partitions, ranks come from positions of the distinct values (counted first), not from a global window.
    """
    c, target = present(df, name), out or f"{name}_rank"
    if partition_by or method == "first":
        if not partition_by:
            ranked = with_position(df.withColumn("__v", c), ["__v", *tie_break], [ascending] + [True] * len(tie_break), "__p")
            return ranked.withColumn(target, F.when(F.col("__v").isNotNull(), (F.col("__p") + 1).cast("double"))).drop("__v", "__p")
        order = c.asc_nulls_last() if ascending else c.desc_nulls_last()
        w = Window.partitionBy(*map(col, partition_by)).orderBy(order)
        same = F.count(F.lit(1)).over(Window.partitionBy(*map(col, partition_by), c))
        low = F.rank().over(w)
        value = {"min": low, "max": low + same - 1, "average": low + (same - 1) / 2, "dense": F.dense_rank().over(w), "first": F.row_number().over(Window.partitionBy(*map(col, partition_by)).orderBy(order, *map(col, tie_break)))}[method]
        return df.withColumn(target, F.when(c.isNotNull(), value.cast("double")))
    counts = df.select(c.alias("__v")).where("__v IS NOT NULL").groupBy("__v").agg(F.count(F.lit(1)).alias("__n"))
    counts = counts.withColumn("__o", F.col("__v") if ascending else -F.col("__v").cast("double"))
    if method == "dense":
        counts = with_position(counts, ["__o"], True, "__p").withColumn("__r", F.col("__p") + 1)
    else:
        counts = cumulative(counts, ["__o"], {"__hi": ("sum", F.col("__n"))}).withColumn("__r", {"min": F.col("__hi") - F.col("__n") + 1, "max": F.col("__hi"), "average": F.col("__hi") - (F.col("__n") - 1) / 2}[method])
    ranks = counts.select("__v", F.col("__r").cast("double").alias(target))
    base = df.withColumn("__v", c)
    return base.join(ranks, "__v", "left").select(*[col(x) for x in df.columns], target)


def cumcount(df: DataFrame, name: str, order_by: Sequence[str], partition_by: Sequence[str] = (), out: str | None = None) -> DataFrame:
    """0-based number of the present values so far."""
    target = out or f"{name}_cumcount"
    made = cumulative(df, order_by, {target: ("count", present(df, name))}, partition_by)
    return made.withColumn(target, F.col(target) - 1)
