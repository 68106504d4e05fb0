"""Resampling and feature columns, all as column expressions."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import datetimes as dt
from ..operators.groupby import Grouped
from ..ordering import row_windows, with_position
from ..semantics import col, present, sort_keys


def resample(df: DataFrame, ts: str, width: str, keys: Sequence[str] = ()) -> Grouped:
    """Groups by time bucket (weeks start on Monday); empty buckets are absent."""
    return Grouped(df.withColumn(ts, dt.floor(ts, width)), [ts, *keys], [ts])


def lag_features(df: DataFrame, name: str, lags: Sequence[int], order_by: Sequence[str], partition_by: Sequence[str] = ()) -> DataFrame:
    """name_lag_k as doubles."""
    c = col(name).cast("double")
    return row_windows(df, order_by, lambda w: {f"{name}_lag_{k}": F.lag(c, k).over(w) for k in lags}, max(lags), 0, partition_by)


def rolling_features(df: DataFrame, name: str, windows: Sequence[int], order_by: Sequence[str], partition_by: Sequence[str] = ()) -> DataFrame:
    """mean, std, min and max of the last w rows, full windows only; std of one row is 0."""
    c = present(df, name).cast("double")

    def make(w):
        out = {}
        for k in windows:
            frame = w.rowsBetween(-(k - 1), 0)
            full = F.count(F.lit(1)).over(frame) == k
            std = F.lit(0.0) if k == 1 else F.stddev_samp(c).over(frame)
            out |= {f"{name}_roll_{k}_mean": F.when(full, F.avg(c).over(frame)), f"{name}_roll_{k}_std": F.when(full, std), f"{name}_roll_{k}_min": F.when(full, F.min(c).over(frame)), f"{name}_roll_{k}_max": F.when(full, F.max(c).over(frame))}
        return out

    return row_windows(df, order_by, make, max(windows) - 1, 0, partition_by)


def datetime_features(df: DataFrame, ts: str) -> DataFrame:
    """_day_of_week (Sunday 0), _month, _quarter, _is_weekend, _day_of_year."""
    d = dt.day_of_week(ts)
    return df.withColumns({f"{ts}_day_of_week": d, f"{ts}_month": dt.month(ts), f"{ts}_quarter": dt.quarter(ts), f"{ts}_is_weekend": d.isin(0, 6), f"{ts}_day_of_year": dt.day_of_year(ts)})


def fourier_features(df: DataFrame, periods: Sequence[float], harmonics: int = 3, index: str | None = None, order_by: Sequence[str] = ()) -> DataFrame:
    """fourier_p{P}_k{k}_sin and _cos of days since the first row (dates), a value, or the row position."""
    if index is None:
        base, t, extra = with_position(df, order_by, name="__t"), F.col("__t").cast("double"), ["__t"]
    elif df.schema[index].dataType.simpleString().startswith(("timestamp", "date")):
        first = df.agg(F.min(dt.micros(index)).alias("__first"))
        base = df.join(F.broadcast(first))
        t, extra = (dt.micros(index) - F.col("__first")) / F.lit(86_400_000_000.0), ["__first"]
    else:
        base, t, extra = df, col(index).cast("double"), []
    made = {}
    for p in periods:
        for k in range(1, harmonics + 1):
            angle = t * (2 * math.pi * k / p)
            made |= {f"fourier_p{p:g}_k{k}_sin": F.sin(angle), f"fourier_p{p:g}_k{k}_cos": F.cos(angle)}
    return base.withColumns(made).drop(*extra)


def autocorrelation(df: DataFrame, name: str, lags: int, order_by: Sequence[str], partition_by: Sequence[str]) -> DataFrame:
    """(keys, lag, acf): biased autocorrelation, lag 0 is 1; lagged products summed in one pass per series set."""
    keys = list(partition_by)
    c = present(df, name).cast("double")
    means = df.groupBy(*map(col, keys)).agg(F.avg(c).alias("__m"), F.sum((c * c)).alias("__q"), F.count(c).alias("__n"))
    base = df.join(means, keys).withColumn("__d", c - F.col("__m"))
    w = Window.partitionBy(*map(col, keys)).orderBy(*sort_keys(df, order_by))
    for k in range(lags + 1):
        base = base.withColumn(f"__p{k}", F.col("__d") * (F.lag("__d", k).over(w) if k else F.col("__d")))
    sums = base.groupBy(*map(col, keys)).agg(*[F.sum(f"__p{k}").alias(f"__p{k}") for k in range(lags + 1)])
    rows = F.array(*[F.struct(F.lit(k).alias("lag"), F.coalesce(F.try_divide(F.col(f"__p{k}"), F.col("__p0")), F.lit(None).cast("double")).alias("acf")) for k in range(lags + 1)])
    return sums.select(*map(col, keys), F.inline(rows))
