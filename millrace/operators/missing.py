"""Missing data: null, or NaN in floating columns."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..ordering import POSITION, range_bucket, with_position
from ..semantics import reversed_keys, col, missing, present, sort_keys


def is_na(df: DataFrame, name: str):
    return missing(df, name)


def not_na(df: DataFrame, name: str):
    return ~missing(df, name)


def fill_value(df: DataFrame, values: dict) -> DataFrame:
    """Missing values by constant."""
    return df.withColumns({c: F.coalesce(present(df, c), F.lit(v).cast(df.schema[c].dataType)) for c, v in values.items()})


def fill_direction(df: DataFrame, name: str, forward: bool, order_by: Sequence[str], partition_by: Sequence[str] = (), out: str | None = None) -> DataFrame:
    """The last present value before (or the first after) in order."""
    c, target = F.col("__c"), out or name
    base = df.withColumn("__c", present(df, name))
    # backward runs over the reversed order: a frame that ends with the partition is quadratic
    keys = sort_keys(df, order_by) if forward else reversed_keys(df, order_by)

    def pick(*parts):
        return F.last(c, ignorenulls=True).over(Window.partitionBy(*parts).orderBy(*keys).rowsBetween(Window.unboundedPreceding, 0))

    if partition_by:
        return base.withColumn(target, pick(*map(col, partition_by))).drop("__c")
    bucketed, _ = range_bucket(base, order_by)
    place = F.struct(*[F.struct(missing(df, k), col(k)).alias(f"o{i}") for i, k in enumerate(order_by)])
    best = (F.max_by if forward else F.min_by)(c, F.when(c.isNotNull(), place))
    edges = bucketed.groupBy("__bucket").agg(best.alias("__e"))
    if forward:
        w, f = Window.orderBy("__bucket").rowsBetween(Window.unboundedPreceding, -1), F.last
    else:
        w, f = Window.orderBy("__bucket").rowsBetween(1, Window.unboundedFollowing), F.first
    carried = edges.select("__bucket", f("__e", ignorenulls=True).over(w).alias("__carried"))  # one row a bucket
    joined = bucketed.join(F.broadcast(carried), "__bucket")
    return joined.withColumn(target, F.coalesce(pick("__bucket"), F.col("__carried"))).drop("__c", "__bucket", "__carried")


def _fill_both(df: DataFrame, partition_by: Sequence[str]) -> DataFrame:
    """__before and __after: the nearest present __k each way by position, in one pass over the buckets that gave the positions."""
    k, keys = F.col("__k"), [col(c) for c in partition_by]
    if not keys:
        keys = [F.col("__bucket")]
        edges = df.groupBy("__bucket").agg(F.max_by(k, F.when(k.isNotNull(), F.col(POSITION))).alias("__hi"), F.min_by(k, F.when(k.isNotNull(), F.col(POSITION))).alias("__lo"))
        w = Window.orderBy("__bucket")  # one row a bucket
        edges = edges.select("__bucket", F.last("__hi", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, -1)).alias("__p"), F.first("__lo", ignorenulls=True).over(w.rowsBetween(1, Window.unboundedFollowing)).alias("__n"))
        df = df.join(F.broadcast(edges), "__bucket")
    up, down = (Window.partitionBy(*keys).orderBy(o).rowsBetween(Window.unboundedPreceding, 0) for o in (F.col(POSITION), F.desc(POSITION)))
    before, after = F.last(k, ignorenulls=True).over(up), F.last(k, ignorenulls=True).over(down)
    if not partition_by:
        before, after = F.coalesce(before, F.col("__p")), F.coalesce(after, F.col("__n"))
    return df.withColumns({"__before": before, "__after": after}).drop("__bucket", "__p", "__n")


def drop_na(df: DataFrame, threshold: int | None = None, subset: Sequence[str] | None = None) -> DataFrame:
    """Rows with at least ``threshold`` present values (all, if not given)."""
    cols = list(subset or df.columns)
    n = sum((F.when(missing(df, c), 0).otherwise(1) for c in cols), F.lit(0))
    return df.where(n >= (len(cols) if threshold is None else threshold))


def drop_na_columns(df: DataFrame, threshold: int | None = None) -> DataFrame:
    """Columns with at least ``threshold`` present values (all rows', if not given); one aggregate."""
    stats = df.agg(F.count(F.lit(1)).alias("__n"), *[F.count(present(df, c)).alias(c) for c in df.columns]).first()
    least = stats["__n"] if threshold is None else threshold
    return df.select(*[col(c) for c in df.columns if stats[c] >= least])


def interpolate_linear(df: DataFrame, name: str, order_by: Sequence[str], partition_by: Sequence[str] = (), out: str | None = None) -> DataFrame:
    """Linear by row position between the nearest present values; the ends take the nearest one."""
    if partition_by:
        at = df.withColumn(POSITION, F.row_number().over(Window.partitionBy(*map(col, partition_by)).orderBy(*sort_keys(df, order_by))))
    else:
        at = with_position(df, order_by, keep_bucket=True)
    c = present(df, name).cast("double")
    at = at.withColumn("__k", F.when(c.isNotNull(), F.struct(c.alias("v"), F.col(POSITION).alias("p"))))
    at = _fill_both(at, partition_by)
    a, b = F.col("__before"), F.col("__after")
    value = F.coalesce(c, F.when(a.isNull(), b["v"]).when(b.isNull(), a["v"]).otherwise(a["v"] + (b["v"] - a["v"]) * (F.col(POSITION) - a["p"]) / F.nullif(b["p"] - a["p"], F.lit(0))))
    return at.withColumn(out or name, value).drop(POSITION, "__k", "__before", "__after")


def neville(xs: np.ndarray, ys: np.ndarray, x: float) -> float:
    """The value at x of the polynomial through the points."""
    table = ys.astype(float).copy()
    n = len(xs)
    for width in range(1, n):
        table[: n - width] = ((x - xs[width:]) * table[: n - width] + (xs[: n - width] - x) * table[1 : n - width + 1]) / (xs[: n - width] - xs[width:])
    return float(table[0])


def natural_spline(xs: np.ndarray, ys: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Natural cubic spline through the points, at ``at``; outside, the end pieces go on."""
    n = len(xs)
    if n == 1:
        return np.full(len(at), ys[0])
    h = np.diff(xs)
    m = np.zeros(n)
    if n > 2:
        a = np.zeros((3, n - 2))
        a[1] = 2 * (h[:-1] + h[1:])
        a[0, 1:], a[2, :-1] = h[1:-1], h[1:-1]
        rhs = 6 * (np.diff(ys[1:]) / h[1:] - np.diff(ys[:-1]) / h[:-1])
        for i in range(1, n - 2):  # forward elimination of the tridiagonal system
            f = a[0, i] / a[1, i - 1]
            a[1, i] -= f * a[2, i - 1]
            rhs[i] -= f * rhs[i - 1]
        for i in range(n - 3, -1, -1):
            m[i + 1] = (rhs[i] - (a[2, i] * m[i + 2] if i < n - 3 else 0)) / a[1, i]
    k = np.clip(np.searchsorted(xs, at, "right") - 1, 0, n - 2)
    left, right, w = at - xs[k], xs[k + 1] - at, h[k]
    return (m[k] * right**3 + m[k + 1] * left**3) / (6 * w) + (ys[k] / w - m[k] * w / 6) * right + (ys[k + 1] / w - m[k + 1] * w / 6) * left


def interpolate_series(df: DataFrame, name: str, method: str, order_by: Sequence[str], partition_by: Sequence[str], out: str | None = None) -> DataFrame:
    """'polynomial' (through the three nearest points) or 'spline' (natural cubic), by position in each series."""
    if method not in ("polynomial", "spline", "cubic", "pchip"):
        raise ValueError(method)
    target, order = out or name, list(order_by)
    kept = [T.StructField(f.name, T.DoubleType() if f.name == target else f.dataType) for f in df.schema.fields]
    schema = T.StructType(kept if target in df.columns else [*kept, T.StructField(target, T.DoubleType())])

    def run(pdf):
        pdf = pdf.sort_values(order).reset_index(drop=True)
        y = pdf[name].to_numpy(float).copy()
        known = np.flatnonzero(~np.isnan(y))
        gaps = np.flatnonzero(np.isnan(y))
        if len(known) and len(gaps):
            if method == "polynomial":
                for g in gaps:
                    near = np.sort(known[np.argsort(np.abs(known - g), kind="stable")[:3]])
                    y[g] = neville(near.astype(float), y[near], float(g))
            else:
                y[gaps] = natural_spline(known.astype(float), y[known], gaps.astype(float))
        return pdf.assign(**{target: y})

    return df.groupBy(*map(col, partition_by)).applyInPandas(run, schema)
